"""Communities of a small weighted graph by modularity (Louvain's method).

Runs inside a grouped map on a graph of screens.  Nodes are visited in an order
drawn from the seed over sorted names, so rows in another order give the same
communities.
"""

from __future__ import annotations

import random
from collections import defaultdict

Graph = dict[str, dict[str, float]]


def undirected(edges: list[tuple[str, str, float]]) -> Graph:
    """Weights of both directions added up; a loop stands once."""
    g: Graph = defaultdict(lambda: defaultdict(float))
    for a, b, w in sorted(edges):
        g[a][b] += w
        if a != b:
            g[b][a] += w
    return {a: dict(sorted(n.items())) for a, n in sorted(g.items())}


def degrees(g: Graph) -> dict[str, float]:
    """Weighted degree; a loop counts twice."""
    return {a: sum(w * (2 if a == b else 1) for b, w in n.items()) for a, n in g.items()}


def modularity(g: Graph, community: dict[str, int], resolution: float = 1.0) -> float:
    deg = degrees(g)
    total = sum(deg.values())
    if not total:
        return 0.0
    inside: dict[int, float] = defaultdict(float)
    around: dict[int, float] = defaultdict(float)
    for a, n in g.items():
        around[community[a]] += deg[a]
        for b, w in n.items():
            if community[a] == community[b]:
                inside[community[a]] += w * (2 if a == b else 1)
    return sum(inside[c] / total - resolution * (around[c] / total) ** 2 for c in around)


def _one_level(g: Graph, rng: random.Random, resolution: float) -> dict[str, int]:
    names = list(g)
    of = {a: i for i, a in enumerate(names)}
    deg = degrees(g)
    total = sum(deg.values())
    around = [deg[a] for a in names]
    order = names[:]
    rng.shuffle(order)
    moved = True
    while moved:
        moved = False
        for a in order:
            own = of[a]
            near: dict[int, float] = defaultdict(float)
            for b, w in g[a].items():
                if b != a:
                    near[of[b]] += w
            around[own] -= deg[a]
            best, gain = own, near[own] - resolution * around[own] * deg[a] / total
            for c, w in near.items():
                new = w - resolution * around[c] * deg[a] / total
                if new > gain + 1e-12:
                    best, gain = c, new
            around[best] += deg[a]
            if best != own:
                of[a], moved = best, True
    return of


def communities(edges: list[tuple[str, str, float]], seed: int = 0, resolution: float = 1.0) -> dict[str, int]:
    """Community number of each node: heaviest first, ties by the least name."""
    g = undirected(edges)
    if not g or not sum(degrees(g).values()):
        return {}
    rng = random.Random(seed)
    member = {a: a for a in g}
    level = g
    while True:
        of = _one_level(level, rng, resolution)
        if len(set(of.values())) == len(level):
            break
        label = {a: f"{of[a]:09d}" for a in level}
        member = {a: label[m] for a, m in member.items()}
        merged: dict[tuple[str, str], float] = defaultdict(float)
        for a, n in level.items():
            for b, w in n.items():
                if a <= b:
                    merged[tuple(sorted((label[a], label[b])))] += w
        level = undirected([(a, b, w) for (a, b), w in merged.items()])
    deg = degrees(g)
    groups: dict[str, list[str]] = defaultdict(list)
    for a, m in member.items():
        groups[m].append(a)
    ranked = sorted(groups.values(), key=lambda x: (-sum(deg[a] for a in x), min(x)))
    return {a: i for i, x in enumerate(ranked) for a in x}
