"""Roster compliance analytics as Spark jobs."""
