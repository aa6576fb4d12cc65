"""What a task does with one shard of a proximity graph: best-first search for a block of queries at once, insertion in
batches, and edges to nodes that none leads to.

A shard is x [node][element] and, for each layer, links [node][slot] of node numbers, -1 where a slot is free, nearest first.
All steps treat queries or nodes of a block together; none depends on anything but its input.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .codes import distances

#: Queries and queries x nodes of a block, elements of pairwise distances held at a time, nodes that are inserted together.
QUERIES, SEEN, PAIRS, BATCH = 512, 1 << 26, 1 << 23, 1024


@dataclass
class Shard:
    """x, links of the ground layer and of those above, and where a search enters."""

    x: np.ndarray
    links: list[np.ndarray] = field(default_factory=list)
    entry: int = 0


def _pairs(q: np.ndarray, x: np.ndarray, kind: str) -> np.ndarray:
    """Distances of rows of q and x, one to one."""
    d = np.einsum("pd,pd->p", q, x)
    return (q * q).sum(axis=1) + (x * x).sum(axis=1) - 2 * d if kind == "L2" else -d


def walk(x: np.ndarray, links: np.ndarray, starts: np.ndarray, q: np.ndarray, ef: int, kind: str, wide: int = 1, keep: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-first search from starts [query][s]: of each query the ef best nodes (-1 if fewer), nearest first, their
    distances, and how many nodes it was compared with. A step expands the ``wide`` nearest nodes not expanded yet; a
    search ends when all of its pool are. keep: that many of the best nodes it looked at are told, if it is more than ef."""
    out = [_walk(x, links, starts[s : s + step], q[s : s + step], ef, kind, wide, max(ef, keep)) for step in [max(1, min(QUERIES, SEEN // max(1, len(x))))] for s in range(0, len(q), step)]
    if not out:
        return np.zeros((0, max(ef, keep)), np.int64), np.zeros((0, max(ef, keep))), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _walk(x, links, starts, q, ef, kind, wide, keep):
    n = len(q)
    ids, dist, done = np.full((n, keep), -1), np.full((n, keep), np.inf), np.ones((n, keep), bool)
    seen, compared = np.zeros((n, len(x)), bool), np.zeros(n, np.int64)

    def look(rows: np.ndarray, found: np.ndarray) -> None:
        """Compare the queries ``rows`` with nodes found [row][c], -1 for none, and keep the best."""
        r, c = np.nonzero(found >= 0)
        node = found[r, c]
        new = ~seen[rows[r], node]
        r, c, node = r[new], c[new], node[new]
        _, first = np.unique(r * len(x) + node, return_index=True)
        r, c, node = r[first], c[first], node[first]
        seen[rows[r], node] = True
        compared[rows] += np.bincount(r, minlength=len(rows))
        d = np.full(found.shape, np.inf)
        d[r, c] = _pairs(q[rows[r]], x[node], kind)
        all_d = np.concatenate((dist[rows], d), axis=1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :keep]
        dist[rows] = np.take_along_axis(all_d, best, 1)
        ids[rows] = np.where(np.isfinite(dist[rows]), np.take_along_axis(np.concatenate((ids[rows], found), axis=1), best, 1), -1)
        done[rows] = np.take_along_axis(np.concatenate((done[rows], ~np.isfinite(d)), axis=1), best, 1)

    active = np.arange(n)
    look(active, starts)
    while True:
        nth = np.cumsum(~done[active, :ef], axis=1)
        active, nth = active[nth[:, -1] > 0], nth[nth[:, -1] > 0]
        if not len(active):
            return ids, dist, compared
        take = ~done[active, :ef] & (nth <= wide)
        r, c = np.nonzero(take)
        node = np.full((len(active), wide), -1)
        node[r, nth[take] - 1] = ids[active[r], c]
        done[active[r], c] = True
        look(active, np.where(node[:, :, None] >= 0, links[node], -1).reshape(len(active), -1))


def descended(shard: Shard, q: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Where a pool of one ends on the layers above [query][1], and how many nodes it was compared with there."""
    at, compared = np.full((len(q), 1), shard.entry), np.zeros(len(q), np.int64)
    for links in shard.links[:0:-1]:
        at, _, n = walk(shard.x, links, at, q, 1, kind)
        compared += n
    return at, compared


def search(shard: Shard, q: np.ndarray, ef: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`walk` on the ground layer, from where a pool of one ends on the layers above and from the entry, which leads to all
    nodes; distances are summed in the order of the elements, and equal ones rank by node."""
    at, compared = descended(shard, q, kind)
    at = np.column_stack((at, np.full(len(q), shard.entry)))
    ids, dist, n = walk(shard.x, shard.links[0], at, q, ef, kind)
    for s in range(0, len(q), QUERIES):
        r, c = np.nonzero(ids[s : s + QUERIES] >= 0)
        dist[s + r, c] = distances(q[s + r], shard.x[ids[s + r, c]], kind)
    order = np.lexsort((ids, dist), axis=1)
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1), compared + n


def pruned(x: np.ndarray, ids: np.ndarray, dist: np.ndarray, cap: int, kind: str, angle: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Of candidates ids [row][c], nearest first, those that no kept one is nearer to than the row's node, or (angle, squared L2
    only) that are not seen under less than 60 degrees from a kept one, at most cap."""
    width = ids.shape[1]
    out, out_d = np.full((len(ids), cap), -1), np.full((len(ids), cap), np.inf)
    step = max(1, PAIRS // max(1, width * max(width, x.shape[1])))
    for s in range(0, len(ids), step):
        i, d = ids[s : s + step], dist[s : s + step]
        y = x[i]
        g = y @ y.transpose(0, 2, 1)
        if kind == "L2":
            yy = np.einsum("bcd,bcd->bc", y, y)
            g = yy[:, :, None] + yy[:, None, :] - 2 * g
        else:
            g = -g
        kept, n = np.zeros(i.shape, bool), np.zeros(len(i), np.int64)
        far = np.where(i >= 0, d, 0.0)
        for c in range(width):
            hide = far[:, c, None] + far[:, :c] - g[:, c, :c] > np.sqrt(np.maximum(far[:, c, None] * far[:, :c], 1e-300)) if angle else g[:, c, :c] < d[:, c, None]
            ok = (i[:, c] >= 0) & (n < cap) & ~(kept[:, :c] & hide).any(axis=1)
            kept[:, c] = ok
            n += ok
        r, c = np.nonzero(kept)
        at = np.cumsum(kept, axis=1)[r, c] - 1
        out[s + r, at], out_d[s + r, at] = i[r, c], d[r, c]
    return out, out_d


def _nearest_first(ids: np.ndarray, dist: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, dist), axis=1)[:, :cap]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def _link_back(x: np.ndarray, links: np.ndarray, dist: np.ndarray, src: np.ndarray, dst: np.ndarray, d: np.ndarray, kind: str) -> None:
    """Give dst an edge to src; a node whose list is then too long is pruned. Of many at once the nearest ``cap`` are looked at."""
    cap = links.shape[1]
    order = np.lexsort((src, d, dst))
    src, dst, d = src[order], dst[order], d[order]
    nodes, first = np.unique(dst, return_index=True)
    place = np.arange(len(dst)) - np.repeat(first, np.diff(np.append(first, len(dst))))
    row = np.searchsorted(nodes, dst)
    src, d, place, row = (a[place < cap] for a in (src, d, place, row))
    ids, near = np.full((len(nodes), 2 * cap), -1), np.full((len(nodes), 2 * cap), np.inf)
    ids[:, :cap], near[:, :cap] = links[nodes], dist[nodes]
    old = ids[:, :cap]
    again = (old[row] == src[:, None]).any(axis=1)
    ids[row[~again], cap + place[~again]], near[row[~again], cap + place[~again]] = src[~again], d[~again]
    ids, near = _nearest_first(ids, near, 2 * cap)
    many = (ids >= 0).sum(axis=1) > cap
    links[nodes[~many]], dist[nodes[~many]] = ids[~many, :cap], near[~many, :cap]
    links[nodes[many]], dist[nodes[many]] = pruned(x, ids[many], near[many], cap, kind)


def _mates(x: np.ndarray, own: np.ndarray, most: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """For nodes inserted together, the nearest of the others."""
    y = x[own]
    d = -(y @ y.T)
    if kind == "L2":
        yy = (y * y).sum(axis=1)
        d = yy[:, None] + yy + 2 * d
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :most]
    near = np.take_along_axis(d, order, 1)
    return np.where(np.isfinite(near), own[order], -1), near


def inserted(shard: Shard, level: np.ndarray, m: int, width: int, kind: str, had: int = 0) -> Shard:
    """The shard with its nodes from number ``had`` on inserted: batches double up to BATCH nodes; each node searches the graph
    so far with a pool of ``width``, and with what it finds, and its batch, is linked and linked back. m edges a new node,
    2 * m at most on the ground layer and m above."""
    n, top = len(shard.x), int(level.max(initial=0))
    links = [np.full((n, 2 * m if k == 0 else m), -1) for k in range(top + 1)]
    dist = [np.full(a.shape, np.inf) for a in links]
    for k, old in enumerate(shard.links):
        links[k][: len(old), : old.shape[1]] = old
        r, c = np.nonzero(links[k] >= 0)
        for s in range(0, len(r), PAIRS // max(1, shard.x.shape[1])):
            part = slice(s, s + PAIRS // max(1, shard.x.shape[1]))
            dist[k][r[part], c[part]] = _pairs(shard.x[r[part]], shard.x[links[k][r[part], c[part]]], kind)
    entry, a = shard.entry, had
    while a < n:
        b = min(n, a + min(BATCH, max(64, a)))
        own = np.arange(a, b)
        at = np.full((b - a, 1), entry if a else -1)
        for k in range(top, -1, -1):
            here = level[a:b] >= k
            if a and k <= level[entry]:
                low = np.flatnonzero(~here)
                at[low] = walk(shard.x, links[k], at[low], shard.x[own[low]], 1, kind)[0]
            if not here.any():
                continue
            rows, ids, near = np.flatnonzero(here), *_mates(shard.x, own[here], width, kind)
            if a and k <= level[entry]:
                found, d, _ = walk(shard.x, links[k], at[rows], shard.x[own[rows]], width, kind, wide=4)
                at[rows] = found[:, :1]
                ids, near = np.concatenate((ids, found), axis=1), np.concatenate((near, d), axis=1)
            ids, near = pruned(shard.x, *_nearest_first(ids, near, max(width, m)), m, kind)
            links[k][own[rows], :m], dist[k][own[rows], :m] = ids, near
            r, c = np.nonzero(ids >= 0)
            _link_back(shard.x, links[k], dist[k], own[rows][r], ids[r, c], near[r, c], kind)
        if not a or level[a:b].max() > level[entry]:
            entry = a + int(level[a:b].argmax())
        a = b
    out = Shard(shard.x, links, entry)
    for _ in range(PASSES if n > 2 * m else 0):
        links[0], dist[0] = _relinked(shard.x, links[0], entry, width, 2 * m, kind)
    attach(out, dist[0], kind)
    return out


#: Times that the finished ground layer is searched anew: nodes inserted early were linked when little was there.
PASSES = 2


def _relinked(x: np.ndarray, links: np.ndarray, entry: int, width: int, cap: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Links of up to cap a node, of its old ones and what it finds in the graph with a pool of ``width``, and reverse ones."""
    out, dist = np.full((len(x), cap), -1), np.full((len(x), cap), np.inf)
    for s in range(0, len(x), BATCH):
        own = np.arange(s, min(len(x), s + BATCH))
        found, d, _ = walk(x, links, np.full((len(own), 1), entry), x[own], width, kind, wide=4)
        d[found == own[:, None]] = np.inf
        found[~np.isfinite(d)] = -1
        old = np.where((links[own][:, :, None] == found[:, None, :]).any(axis=2), -1, links[own])
        near, (r, c) = np.full(old.shape, np.inf), np.nonzero(old >= 0)
        near[r, c] = _pairs(x[own[r]], x[old[r, c]], kind)
        out[own], dist[own] = pruned(x, *_nearest_first(np.concatenate((found, old), axis=1), np.concatenate((d, near), axis=1), width + cap), cap, kind)
    near, d = out.copy(), dist.copy()
    for s in range(0, len(x), BATCH):
        r, c = np.nonzero(near[s : s + BATCH] >= 0)
        _link_back(x, out, dist, s + r, near[s + r, c], d[s + r, c], kind)
    return out, dist


def reached(links: np.ndarray, entry: int) -> np.ndarray:
    seen = np.zeros(len(links), bool)
    front = np.array([entry])[: len(links)]
    while len(front):
        seen[front] = True
        near = links[front].ravel()
        front = np.unique(near[(near >= 0)])
        front = front[~seen[front]]
    return seen


#: Lost nodes that are strung on one node in a round, besides those as far as the last one, as copies are.
CHAIN = 8


def attach(shard: Shard, dist: np.ndarray, kind: str, pool: int = 32) -> None:
    """Make every node reachable from the entry on the ground layer, within the lists' length.

    A lost node is looked for like a query; the nearest node found gives it an edge, and where several want that node they form
    a chain. Where a list is full, the lost node takes its farthest edge over: what that led to is then reached through
    the lost node, so no reached node is lost.
    """
    x, links = shard.x, shard.links[0]

    def put(a: int, b: int) -> int | None:
        """An edge from a to b; the node that it drives out of a's list, if that is full."""
        if b in links[a]:
            return None
        slot, out = int((links[a] >= 0).sum()), None
        if slot == links.shape[1]:
            slot, out = slot - 1, int(links[a, -1])
        links[a, slot], dist[a, slot] = b, _pairs(x[a : a + 1], x[b : b + 1], kind)[0]
        links[a], dist[a] = (c[0] for c in _nearest_first(links[a : a + 1], dist[a : a + 1], links.shape[1]))
        return out

    while len(lost := np.flatnonzero(~reached(links, shard.entry))):
        found, d, _ = walk(x, links, np.full((len(lost), 1), shard.entry), x[lost], pool, kind)
        room = np.where(found >= 0, links[found, -1] < 0, False)
        # Without room anywhere near, lost nodes spread over all that were found, so that a round attaches many.
        pick = np.where(room.any(axis=1), room.argmax(axis=1), np.arange(len(lost)) % (found >= 0).sum(axis=1))
        at, near = found[np.arange(len(lost)), pick], d[np.arange(len(lost)), pick]
        order = np.lexsort((lost, near, at))
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        for s, e in zip(first, np.append(first[1:], len(order)), strict=True):
            a = int(at[order[s]])
            own = order[s:e]
            far = np.flatnonzero((np.arange(len(own)) >= CHAIN) & (near[own] != near[np.append(own[:1], own[:-1])]))
            for v in lost[own[: far[0] if len(far) else len(own)]].tolist():
                out = put(a, v)
                if out is not None and out != v:
                    put(v, out)
                a = v
