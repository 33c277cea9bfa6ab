"""Clustering of small groups in NumPy, each group one Arrow task: linkage, silhouette, communities."""

from __future__ import annotations

import numpy as np


def linkage(distance: np.ndarray, method: str = "complete") -> list[tuple[int, int, float]]:
    """Agglomerative merges (a, b, height) of a distance matrix; cluster n + i is made by merge i.

    Nearest-neighbour chains: O(n²) time for complete and average linkage.
    """
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, name, live = np.ones(n), list(range(n)), np.ones(n, bool)
    raw: list[tuple[int, int, float]] = []
    chain: list[int] = []
    while live.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(live)[0])]
        i = chain[-1]
        row = np.where(live, d[i], np.inf)
        j = int(np.argmin(row))
        if len(chain) > 1 and row[chain[-2]] <= row[j]:
            j = chain[-2]
        if len(chain) > 1 and j == chain[-2]:
            chain = chain[:-2]
            raw.append((i, j, float(d[i, j])))
            merged = np.maximum(d[i], d[j]) if method == "complete" else (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
            d[i], d[:, i] = merged, merged
            d[i, i] = np.inf
            size[i] += size[j]
            live[j] = False
            d[j], d[:, j] = np.inf, np.inf
        else:
            chain.append(j)
    out = []
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for step, (i, j, h) in enumerate(sorted(raw, key=lambda m: m[2])):
        a, b = find(i), find(j)
        out.append((min(name[a], name[b]), max(name[a], name[b]), h))
        root[b] = a
        name[a] = n + step
    return out


def cut(n: int, merges: list[tuple[int, int, float]], height: float) -> np.ndarray:
    """Flat cluster of each item: merges up to ``height`` hold; clusters are numbered by first item."""
    root = list(range(n + len(merges)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, (a, b, h) in enumerate(merges):
        if h <= height:
            root[find(a)] = n + i
            root[find(b)] = n + i
    labels: dict[int, int] = {}
    return np.array([labels.setdefault(find(i), len(labels)) for i in range(n)])


def silhouette(distance: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette; −1 unless there are at least two clusters and one of them has two items."""
    n, k = len(labels), labels.max(initial=-1) + 1
    if k < 2 or k >= n:
        return -1.0
    member = np.eye(k)[labels]
    sums, sizes = distance @ member, member.sum(0)
    own = sizes[labels]
    a = sums[np.arange(n), labels] / np.maximum(own - 1, 1)
    other = np.where(member > 0, np.inf, sums / sizes)
    b = other.min(1)
    s = np.where(own > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0.0)
    return float(s.mean())


def best_height(distance: np.ndarray, merges, least: int, most: int, steps: int = 100) -> tuple[float, float]:
    """(height, silhouette) of the best cut among ``steps`` heights in [0.1, 0.95]; (0.5, −1) if none has an allowed count."""
    best = (0.5, -1.0)
    for h in np.linspace(0.1, 0.95, steps):
        labels = cut(len(distance), merges, h)
        if least <= labels.max(initial=-1) + 1 <= most:
            s = silhouette(distance, labels)
            if s > best[1]:
                best = (float(h), s)
    return best


def communities(edges: list[tuple[int, int, float]], n: int, resolution: float = 1.0, rounds: int = 50) -> list[int]:
    """Louvain communities of a small weighted graph, nodes visited in order and ties to the lower number."""
    group = list(range(n))
    total = sum(w for _, _, w in edges) or 1.0
    level_nodes = [[i] for i in range(n)]
    level = [dict() for _ in range(n)]
    loops = [0.0] * n
    for a, b, w in edges:
        if a == b:
            loops[a] += w
        else:
            level[a][b] = level[a].get(b, 0) + w
            level[b][a] = level[b].get(a, 0) + w
    while True:
        m = len(level)
        com = list(range(m))
        degree = [sum(level[i].values()) + 2 * loops[i] for i in range(m)]
        weight = degree[:]
        moved_any = False
        for _ in range(rounds):
            moved = False
            for i in range(m):
                links: dict[int, float] = {}
                for j, w in level[i].items():
                    links[com[j]] = links.get(com[j], 0) + w
                weight[com[i]] -= degree[i]
                gain = {c: w - resolution * weight[c] * degree[i] / (2 * total) for c, w in links.items()}
                stay = gain.get(com[i], -resolution * weight[com[i]] * degree[i] / (2 * total))
                best = max(sorted(gain), key=lambda c: gain[c], default=com[i])
                if best != com[i] and gain[best] > stay + 1e-12:
                    com[i], moved = best, True
                weight[com[i]] += degree[i]
            moved_any |= moved
            if not moved:
                break
        if not moved_any:
            break
        names = {c: k for k, c in enumerate(dict.fromkeys(com))}
        new_nodes = [[] for _ in names]
        new_level: list[dict] = [dict() for _ in names]
        new_loops = [0.0] * len(names)
        for i in range(m):
            c = names[com[i]]
            new_nodes[c] += level_nodes[i]
            new_loops[c] += loops[i]
            for j, w in level[i].items():
                d = names[com[j]]
                if c == d:
                    new_loops[c] += w / 2
                else:
                    new_level[c][d] = new_level[c].get(d, 0) + w
        level, level_nodes, loops = new_level, new_nodes, new_loops
    for c, nodes in enumerate(level_nodes):
        for i in nodes:
            group[i] = c
    names = {}
    return [names.setdefault(g, len(names)) for g in group]


def kmeans_split(x: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Two clusters of rows (seeded by the two farthest along the main direction) and their silhouette."""
    if len(x) < 3:
        return np.zeros(len(x), int), -1.0
    c = x - x.mean(0)
    axis = np.linalg.svd(c, full_matrices=False)[2][0]
    p = c @ axis
    centres = x[[int(p.argmin()), int(p.argmax())]]
    labels = np.zeros(len(x), int)
    for _ in range(rounds):
        d = ((x[:, None] - centres[None]) ** 2).sum(2)
        new = d.argmin(1)
        if (new == labels).all() and _:
            break
        labels = new
        if len(set(labels)) < 2:
            return labels, -1.0
        centres = np.stack([x[labels == k].mean(0) for k in (0, 1)])
    distance = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    return labels, silhouette(distance, labels)
