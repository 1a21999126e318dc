"""Auction shortest paths with integer costs, and the least path by its labels.

A price for each node keeps every arc's reduced cost at zero or more. A path grows from the origin: at its last
node, if no arc is tight (price equal to cost plus the price behind it), the price rises to the best arc and
the path contracts by a node; else it extends along a tight arc. When it reaches the target, the prices are
an optimal dual: every shortest path has tight arcs only, and every path of tight arcs is shortest. So the
shortest path of the least labels is traced along tight arcs that lead to the target.
"""

from __future__ import annotations

from math import inf

Arcs = list[list[tuple[int, str, int]]]  # by node: cost, label, next node


def auction(arcs: Arcs, price: list[float], origin: int, target: int) -> bool:
    """Raise feasible prices in place until a tight path leads to the target; False if none can."""
    path = [origin]
    while path[-1] != target:
        at = path[-1]
        best, ahead = inf, -1
        for cost, _, to in arcs[at]:
            if cost + price[to] < best:
                best, ahead = cost + price[to], to
        if price[at] < best:
            price[at] = best
            if len(path) > 1:
                path.pop()
            elif best == inf:
                return False
        elif best == inf:
            return False
        else:
            path.append(ahead)
    return True


def traced(arcs: Arcs, price: list[float], origin: int, target: int) -> str:
    """Labels of the least path of tight arcs. Labels that leave a node are not prefixes of one another, but for the empty one, which ends the path."""
    tight = [[(label, to) for cost, label, to in out if price[at] == cost + price[to] < inf] for at, out in enumerate(arcs)]
    behind: list[list[int]] = [[] for _ in arcs]
    for at, out in enumerate(tight):
        for _, to in out:
            behind[to].append(at)
    leads, stack = {target}, [target]
    while stack:
        for at in behind[stack.pop()]:
            if at not in leads:
                leads.add(at)
                stack.append(at)
    labels, at = [], origin
    while at != target:
        label, at = min(x for x in tight[at] if x[1] in leads)
        labels.append(label)
    return "".join(labels)


def cheapest(arcs: Arcs, price: list[float], origin: int, target: int) -> tuple[int, str] | None:
    """Cost and labels of the best path. `price` holds feasible prices, 0 at the target."""
    price = list(price)
    if not auction(arcs, price, origin, target):
        return None
    return int(price[origin] - price[target]), traced(arcs, price, origin, target)
