"""Reading tables, sheets and file inventories; appending and publishing results."""
