"""Plain-Python answers for small graphs."""

from __future__ import annotations

import random
from collections import deque


def random_digraph(n, m, seed, weights=49):
    rng = random.Random(seed)
    edges = {}
    while len(edges) < m:
        a, b = rng.randrange(n), rng.randrange(n)
        if a != b:
            edges[(f"v{a:03d}", f"v{b:03d}")] = rng.randint(1, weights)
    return [(a, b, w) for (a, b), w in edges.items()]


def reachable(edges, start, gone=()):
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    if start in gone:
        return {}
    dist, queue = {start: 0}, deque([start])
    while queue:
        u = queue.popleft()
        for v in out.get(u, ()):
            if v not in dist and v not in gone:
                dist[v] = dist[u] + 1
                queue.append(v)
    return dist


def pairs(edges, sources, targets, gone=()):
    return {(s, m) for s in sources for m in targets if m in reachable(edges, s, gone) and s not in gone}


def max_flow(edges, sources, targets, gone=()):
    """Unit capacities: one breadth-first augmenting path at a time."""
    residual = {}
    for a, b in edges:
        if a not in gone and b not in gone:
            residual.setdefault(a, {})[b] = residual.get(a, {}).get(b, 0) + 1
            residual.setdefault(b, {}).setdefault(a, 0)
    total = 0
    while True:
        parent = {s: None for s in sources if s not in gone}
        queue, end = deque(parent), None
        while queue and end is None:
            u = queue.popleft()
            for v, room in residual.get(u, {}).items():
                if room > 0 and v not in parent:
                    parent[v] = u
                    if v in targets:
                        end = v
                        break
                    queue.append(v)
        if end is None:
            return total
        while parent[end] is not None:
            residual[parent[end]][end] -= 1
            residual[end][parent[end]] += 1
            end = parent[end]
        total += 1


def core_numbers(edges, vertices):
    near = {v: set() for v in vertices}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    core, level, left = {}, 0, {v: set(n) for v, n in near.items()}
    while left:
        v = min(left, key=lambda x: len(left[x]))
        level = max(level, len(left[v]))
        core[v] = level
        for u in left.pop(v):
            left[u].discard(v)
    return core


def betweenness(edges, vertices, starts, goals):
    score = {v: 0.0 for v in vertices}
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)

    def paths(s):
        dist, sigma, queue = {s: 0}, {s: 1}, deque([s])
        while queue:
            u = queue.popleft()
            for v in out.get(u, ()):
                if v not in dist:
                    dist[v], sigma[v] = dist[u] + 1, 0
                    queue.append(v)
                if dist[v] == dist[u] + 1:
                    sigma[v] += sigma[u]
        return dist, sigma

    info = {v: paths(v) for v in vertices}
    for s in starts:
        for t in goals:
            if s != t and t in info[s][0]:
                for v in vertices:
                    if v not in (s, t) and v in info[s][0] and t in info[v][0] and info[s][0][v] + info[v][0][t] == info[s][0][t]:
                        score[v] += info[s][1][v] * info[v][1][t] / info[s][1][t]
    return score
