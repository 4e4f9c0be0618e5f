"""BK-trees of many shards at once, by numpy: 128-bit fingerprints under Hamming distance.

Rows come sorted by shard. The first row of a shard is the root of its tree; a child hangs on the edge
of its distance to its parent, and rows with a node's very fingerprint are joined to it. A probe follows, from each
node, only the edges whose distance is within the radius of its own. Trees of all shards grow and are searched level by level.
"""

from __future__ import annotations

import numpy as np

#: Pairs of a probe and a node that one block of probes may visit.
VISITS = 250_000


def join(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels (the least position of each component) after the links (u, v)."""
    while u.size:
        a, b = label[u], label[v]
        low = np.minimum(a, b)
        for at in (a, b):
            np.minimum.at(label, at, low)
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
        open_links = label[u] != label[v]
        u, v = u[open_links], v[open_links]
    return label


def components(shard: np.ndarray, late: np.ndarray, prints: tuple[np.ndarray, np.ndarray], radius: int) -> np.ndarray:
    """For each row the first row of its component: rows of a shard at most ``radius`` bits apart are linked.

    Rows of a shard that are not ``late`` come first and make its tree. Where a shard has late rows, only they are probes;
    else each row probes those before it."""
    n = len(shard)
    label = np.arange(n)
    begins = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
    ends = np.append(begins[1:], n)
    root = np.repeat(begins, ends - begins)
    paired = np.repeat(late[ends - 1], ends - begins)
    first, second = prints

    def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (np.bitwise_count(first[x] ^ first[y]) + np.bitwise_count(second[x] ^ second[y])).astype(np.int64)

    own_node = ~late
    at, keys, nodes = root.copy(), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    growing = np.flatnonzero(~late & (root != np.arange(n)))
    while growing.size:
        gap = distance(growing, at[growing])
        equal = growing[gap == 0]
        label[equal] = at[equal]
        own_node[equal] = False
        growing, gap = growing[gap > 0], gap[gap > 0]
        edge, begun, which = np.unique(at[growing] << 8 | gap, return_index=True, return_inverse=True)
        child = growing[begun]
        keys.append(edge)
        nodes.append(child)
        at[growing] = child[which]
        growing = growing[growing != child[which]]
    key, node = np.concatenate(keys), np.concatenate(nodes)
    order = np.argsort(key)
    length, node = key[order] & 255, node[order]
    children = np.bincount(key >> 8, minlength=n)
    start = np.cumsum(children) - children

    label = join(label, np.arange(n), label.copy())
    probes = np.flatnonzero(np.where(paired, late & ~late[root], own_node & (root != np.arange(n))))
    block = np.cumsum(probes - root[probes] + 1) // VISITS
    for x in np.split(probes, np.flatnonzero(block[1:] != block[:-1]) + 1):
        y, found = root[x], []
        while x.size:
            gap = distance(x, y)
            hit = gap <= radius
            found.append((x[hit], y[hit]))
            many = children[y]
            of = np.repeat(np.arange(len(x)), many)
            edge = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[y], many)
            # a child comes after its parent, so those of later rows lead to later rows only
            follow = (np.abs(length[edge] - gap[of]) <= radius) & (node[edge] < x[of])
            x, y = x[of[follow]], node[edge[follow]]
        if found:
            label = join(label, *map(np.concatenate, zip(*found)))
    return label
