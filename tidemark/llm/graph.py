"""Nearest vectors by a robust-pruned directed graph, built and searched in blocks."""

from __future__ import annotations

import numpy as np


class PrunedGraph:
    """Directed graph over unit vectors whose edges lead a greedy search to a query's neighbours.

    Points enter in growing blocks. For each block a beam search over the graph
    so far proposes neighbours; relaxed distance pruning keeps an edge p→q only
    if no kept edge p→r has ``alpha * d(r, q) <= d(p, q)``, so the kept ones
    point different ways and some are long. Then each kept edge gets its
    reverse, and a point with too many edges is pruned again. All steps work on
    whole blocks of points as arrays.
    """

    def __init__(self, x: np.ndarray, degree: int = 16, slack: int = 16, beam: int = 32, alpha: float = 1.05, block: int = 1024, entries: int = 768, seed: int = 5):
        self.x = x
        self.n = len(x)
        self.degree, self.width, self.alpha2 = degree, degree + slack, np.float32(alpha * alpha)
        self.edges = np.full((self.n, self.width), -1, np.int32)
        self.count = np.zeros(self.n, np.int64)
        self.inserted = 0
        order = np.random.default_rng(seed).permutation(self.n).astype(np.int32)
        first = min(self.n, 192)
        self.entries = order[:first]
        if first > 1:
            self._join(order[:first], None)
        at = first
        while at < self.n:
            size = min(block, max(192, at // 2), self.n - at)
            ids = order[at : at + size]
            self._join(ids, self.search(x[ids], beam, path=True)[0])
            at += size
            self.entries = order[: min(at, entries)]
        full = np.flatnonzero(self.count > degree)
        for s in range(0, len(full), block):
            self._prune_rows(full[s : s + block])

    def _join(self, ids: np.ndarray, found: np.ndarray | None) -> None:
        if found is None:  # the first block: all are each other's candidates
            dots = self.x[ids] @ self.x[ids].T
            np.fill_diagonal(dots, -9)
            c = min(len(ids) - 1, 2 * self.width)
            found = ids[np.argpartition(-dots, c - 1, axis=1)[:, :c]]
        kept = self._prune(ids, found)
        n = kept.shape[1]
        self.edges[ids, :n] = kept
        self.edges[ids, n:] = -1
        self.count[ids] = (kept >= 0).sum(axis=1)
        self._reverse(ids, kept)

    def _prune(self, ids: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """Up to ``degree`` diverse ones of each row's candidates (-1: none); kept ones come first."""
        x, b = self.x, len(ids)
        valid = (cand >= 0) & (cand != ids[:, None])
        safe = np.where(valid, cand, 0)
        v = x[safe]
        d = 2 - 2 * np.einsum("bcd,bd->bc", v, x[ids])
        d[~valid] = np.inf
        order = np.argsort(d, axis=1, kind="stable")
        rows = np.arange(b)[:, None]
        d, safe, v = d[rows, order], safe[rows, order], v[rows, order]
        between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
        between *= self.alpha2
        alive = np.isfinite(d)
        out = np.full((b, self.degree), -1, np.int32)
        lines = np.arange(b)
        for r in range(self.degree):
            pick = alive.argmax(axis=1)
            some = alive[lines, pick]
            if not some.any():
                break
            out[some, r] = safe[lines[some], pick[some]]
            alive &= between[lines, pick] > d
            alive[lines, pick] = False
        return out

    def _prune_rows(self, rows: np.ndarray) -> None:
        kept = self._prune(rows.astype(np.int32), self.edges[rows])
        self.edges[rows] = -1
        self.edges[rows, : self.degree] = kept
        self.count[rows] = (kept >= 0).sum(axis=1)

    def _reverse(self, ids: np.ndarray, kept: np.ndarray) -> None:
        source = np.repeat(ids, kept.shape[1])
        target = kept.ravel()
        ok = target >= 0
        source, target = source[ok], target[ok]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        while len(target):
            starts = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
            place = np.arange(len(target)) - np.repeat(starts, np.diff(np.append(starts, len(target))))
            at = self.count[target] + place
            fits = at < self.width
            self.edges[target[fits], at[fits]] = source[fits]
            np.add.at(self.count, target[fits], 1)
            source, target = source[~fits], target[~fits]
            if len(target):
                rows = np.unique(target)
                for s in range(0, len(rows), 1024):
                    self._prune_rows(rows[s : s + 1024])

    def search(self, q: np.ndarray, beam: int, at_once: int = 4, path: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best points met on the way to each query, best first: ids (-1: none) and dot products.

        A search begins at the best of the entry points, the first points of the
        graph's random order. With ``path``, where it began comes after the best.
        """
        b, width = len(q), self.width
        seen = np.full((b, self.n), -1, np.int16)
        best = np.full((b, beam), -1, np.int32)
        score = np.full((b, beam), -np.inf, np.float32)
        done = np.ones((b, beam), bool)
        m = min(12, len(self.entries), beam)
        dots = q @ self.x[self.entries].T
        top = np.argpartition(-dots, m - 1, axis=1)[:, :m]
        lines = np.arange(b)[:, None]
        top = top[lines, np.argsort(-dots[lines, top], axis=1, kind="stable")]
        start = self.entries[top]
        best[:, :m], score[:, :m], done[:, :m] = start, dots[lines, top], False
        seen[lines, start] = 0
        live = np.arange(b)
        while len(live):
            open_score = np.where(done[live], -np.inf, score[live])
            if at_once < beam:
                pick = np.argpartition(-open_score, at_once - 1, axis=1)[:, :at_once]
            else:
                pick = np.broadcast_to(np.arange(beam), open_score.shape)
            rows = np.arange(len(live))[:, None]
            valid = np.isfinite(open_score[rows, pick])
            nodes = np.where(valid, best[live[:, None], pick], -1)
            done[live[:, None], pick] = True
            around = np.where((nodes >= 0)[:, :, None], self.edges[nodes], -1).reshape(len(live), -1)
            r, c = np.nonzero(around >= 0)
            node = around[r, c]
            line = live[r]
            fresh = seen[line, node] < 0
            r, c, node, line = r[fresh], c[fresh], node[fresh], line[fresh]
            seen[line, node] = c  # of a node met twice in one step one column's write stays
            once = seen[line, node] == c
            r, node, line = r[once], node[once], line[once]
            dots = np.einsum("ij,ij->i", self.x[node], q[line])
            better = dots > score[line, -1]
            r, node, line, dots = r[better], node[better], line[better], dots[better]
            counts = np.bincount(r, minlength=len(live))
            most = int(counts.max()) if len(counts) else 0
            if most:
                col = np.arange(len(r)) - np.repeat(np.cumsum(counts) - counts, counts)
                ids = np.full((len(live), beam + most), -1, np.int32)
                val = np.full((len(live), beam + most), -np.inf, np.float32)
                fin = np.zeros((len(live), beam + most), bool)
                ids[:, :beam], val[:, :beam], fin[:, :beam] = best[live], score[live], done[live]
                fin[:, beam:] = True
                ids[r, beam + col], val[r, beam + col], fin[r, beam + col] = node, dots, False
                top = np.argsort(-val, axis=1, kind="stable")[:, :beam]
                best[live], score[live], done[live] = ids[rows, top], val[rows, top], fin[rows, top]
            live = live[(~done[live]).any(axis=1)]
        if path:
            known = (start[:, :, None] == best[:, None, :]).any(axis=2)
            best = np.concatenate([best, np.where(known, -1, start)], axis=1)
        return best, score


def nearest_in_shard(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: np.ndarray, query_beam: int = 96, block: int = 512, **options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query position, id and similarity of each query's best other members of one shard.

    Equal vectors are one point of the graph and come apart again afterwards,
    so any number of copies costs one search and none is lost: of a point's
    members the smallest ids are taken, as many as the query asks for. A query
    is not its own neighbour.
    """
    if not len(x) or not len(q):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    raw = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 4))).ravel()
    _, first, inverse = np.unique(raw, return_index=True, return_inverse=True)
    order = np.lexsort((ids, inverse))
    members, sizes = ids[order], np.bincount(inverse)
    begin = np.cumsum(sizes) - sizes
    graph = PrunedGraph(np.ascontiguousarray(x[first]), **options)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for s in range(0, len(q), block):
        part, want = q[s : s + block], k[s : s + block]
        best, score = graph.search(part, max(query_beam, 2 * int(want.max(initial=1)) + 2))
        best, score = best[:, : int(want.max(initial=1)) + 1], score[:, : int(want.max(initial=1)) + 1]
        r, c = np.nonzero(best >= 0)
        node = best[r, c]
        take = np.minimum(sizes[node], want[r] + 1)
        at = np.repeat(begin[node] - (np.cumsum(take) - take), take) + np.arange(int(take.sum()))
        row, got, sim = np.repeat(r, take), members[at], np.repeat(score[r, c], take)
        other = got != q_ids[s : s + block][row]
        row, got, sim = row[other], got[other], sim[other]
        o = np.lexsort((got, -sim, row))
        row, got, sim = row[o], got[o], sim[o]
        starts = np.searchsorted(row, np.arange(len(part)))
        keep = np.arange(len(row)) - starts[row] < want[row]
        out.append((row[keep] + s, got[keep], sim[keep]))
    return tuple(np.concatenate(z) for z in zip(*out))  # type: ignore[return-value]
