"""Clusters of similar vectors by bisecting k-means over the whole table."""

from __future__ import annotations

import heapq
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.vectors import DIMS, from_binary, to_binary
from tidemark.operators.components import connected_components
from tidemark.runtime import discard, staged

NODE_ROWS = 32_768
SAMPLE_ROWS = 65_536
BLOCK_LEAVES = 65_536


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v * v).sum(axis=-1, keepdims=True))
    return (v / np.where(n > 0, n, 1)).astype(np.float32)


def two_means(v: np.ndarray, rng: np.random.Generator, rounds: int = 4) -> np.ndarray:
    """Which side each row falls on; both sides have rows."""
    n = len(v)
    pairs = rng.integers(0, n, (2, 12))
    worst = int(np.argmin(np.einsum("ij,ij->i", v[pairs[0]], v[pairs[1]])))
    a, b = v[pairs[0, worst]], v[pairs[1, worst]]
    side = None
    for _ in range(rounds):
        new = v @ (b - a) > 0
        k = int(new.sum())
        if k in (0, n):
            break
        if side is not None and (new == side).all():
            break
        side = new
        right = v[side].sum(axis=0)
        a, b = _unit(v.sum(axis=0) - right), _unit(right)
    if side is None:  # the seeds were equal: part by the farthest row
        far = v[int(np.argmin(v @ v.mean(axis=0)))]
        close = v @ far
        side = close > np.median(close)
        if side.all() or not side.any():
            side = np.arange(n) < n // 2
    return side


def bisect(x: np.ndarray, compact: float, link: float, seed: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Split until every leaf is compact: leaf of each row, its similarity to the leaf's centre, the leaves' centres and pivots.

    The node of the largest dispersion (rows less the length of their sum) is
    split next. A leaf is compact if all its members are at least ``compact``
    similar to its centre and at least ``link`` similar to its pivot, the
    member nearest to the centre; so its members belong together through the
    pivot alone. In the end, leaves whose pivots are linked, directly or
    through others, are one leaf if that is ``compact`` too: then a split only
    cut it.
    """
    n = len(x)
    rng = np.random.default_rng(seed)
    order = np.arange(n)
    v = x.copy()
    leaf = np.empty(n, np.int64)
    pivots: list[int] = []
    heap = [(0.0, 0, n)] if n else []
    while heap:
        _, lo, hi = heapq.heappop(heap)
        part = v[lo:hi]
        centre = _unit(part.sum(axis=0, dtype=np.float64))
        d = part @ centre
        top = int(d.argmax())
        if hi - lo == 1 or (d.min() >= compact and (part @ part[top]).min() >= link):
            leaf[order[lo:hi]] = len(pivots)
            pivots.append(int(order[lo + top]))
            continue
        side = two_means(part, rng)
        k = int((~side).sum())
        v[lo:hi] = np.concatenate([part[~side], part[side]])
        order[lo:hi] = np.concatenate([order[lo:hi][~side], order[lo:hi][side]])
        for a, b in ((lo, lo + k), (lo + k, hi)):
            heapq.heappush(heap, (float(np.linalg.norm(v[a:b].sum(axis=0, dtype=np.float64))) - (b - a), a, b))
    return _rejoined(x, leaf, np.array(pivots, np.int64), compact, link)


def _linked_roots(p: np.ndarray, link: float) -> np.ndarray:
    """For each row the first of those it is linked with, directly or through others."""
    root = np.arange(len(p))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for s in range(0, len(p), 512):
        i, j = np.nonzero(p[s : s + 512] @ p[s:].T >= link)
        for a, b in zip((i[i < j] + s).tolist(), (j[i < j] + s).tolist()):
            ra, rb = find(a), find(b)
            if ra != rb:
                root[max(ra, rb)] = min(ra, rb)
    return np.array([find(a) for a in range(len(p))], np.int64)


def _centres(x: np.ndarray, leaf: np.ndarray, leaves: int) -> np.ndarray:
    order = np.argsort(leaf, kind="stable")
    starts = np.searchsorted(leaf[order], np.arange(leaves))
    return _unit(np.add.reduceat(x[order].astype(np.float64), starts, axis=0)) if leaves else np.zeros((0, x.shape[1]), np.float32)


def _rejoined(x: np.ndarray, leaf: np.ndarray, pivots: np.ndarray, compact: float, link: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leaves that a split cut apart as one, with centres, similarities to them and pivots."""
    whole = _linked_roots(x[pivots], link)
    joint = whole[leaf]
    _, joint = np.unique(joint, return_inverse=True)
    n = int(joint.max(initial=-1)) + 1
    least = np.full(n, 2.0, np.float32)
    np.minimum.at(least, joint, np.einsum("ij,ij->i", x, _centres(x, joint, n)[joint]))
    _, leaf = np.unique(np.where(least[joint] >= compact, joint, n + leaf), return_inverse=True)
    n = int(leaf.max(initial=-1)) + 1
    centres = _centres(x, leaf, n)
    dots = np.einsum("ij,ij->i", x, centres[leaf]) if len(x) else np.zeros(0, np.float32)
    best = np.lexsort((-dots, leaf))
    return leaf, dots.astype(np.float32), centres, best[np.searchsorted(leaf[best], np.arange(n))]


class SplitTree:
    """The upper part of the bisecting tree; sends a row to one of its leaves."""

    def __init__(self, sample: np.ndarray, most: int, compact: float, seed: int):
        """Bisects a sample until a leaf has at most ``most`` rows of it or is compact."""
        rng = np.random.default_rng(seed)
        self.children: list[tuple[int, int]] = []
        self.parent: list[int] = []
        self.leaves = 0
        left, right = [], []
        stack = [(np.arange(len(sample)), -1, 0)]
        while stack:
            rows, parent, which = stack.pop()
            part = sample[rows]
            done = len(rows) <= most
            if not done:
                centre = _unit(part.sum(axis=0, dtype=np.float64))
                done = (part @ centre).min() >= compact
            if done:
                me = -1 - self.leaves
                self.leaves += 1
            else:
                side = two_means(part, rng)
                me = len(self.children)
                self.children.append((0, 0))
                left.append(_unit(part[~side].sum(axis=0)))
                right.append(_unit(part[side].sum(axis=0)))
                stack += [(rows[~side], me, 0), (rows[side], me, 1)]
            if parent >= 0:
                a, b = self.children[parent]
                self.children[parent] = (me, b) if which == 0 else (a, me)
        self.left = np.array(left, np.float32).reshape(-1, sample.shape[1])
        self.right = np.array(right, np.float32).reshape(-1, sample.shape[1])
        self.kids = np.array(self.children, np.int64).reshape(-1, 2)

    def route(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of each row."""
        if not len(self.kids):
            return np.zeros(len(x), np.int64)
        at = np.zeros(len(x), np.int64)
        way = self.right - self.left
        while True:
            inner = np.flatnonzero(at >= 0)
            if not len(inner):
                return -1 - at
            node = at[inner]
            to_right = np.einsum("ij,ij->i", x[inner], way[node]) > 0
            at[inner] = np.where(to_right, self.kids[node, 1], self.kids[node, 0])

    def refine(self, sums: np.ndarray) -> None:
        """New centres of every split from the sums of all rows by leaf."""
        total: dict[int, np.ndarray] = {}

        for node in range(len(self.kids) - 1, -1, -1):  # children come after their parents
            parts = [sums[-1 - c] if c < 0 else total[c] for c in self.kids[node]]
            total[node] = parts[0] + parts[1]
            for side, own in ((self.left, parts[0]), (self.right, parts[1])):
                if np.any(own):
                    side[node] = _unit(own)


def _leaf_stats(vectors: DataFrame, tree: SplitTree, centres: np.ndarray | None, compact: float) -> dict[int, tuple[int, int, np.ndarray, np.ndarray | None, int]]:
    """Per leaf of the tree: rows, rows near its centre, their sum, and the row nearest to the centre."""
    dims = tree.left.shape[1] if len(tree.left) else DIMS

    def one(batches):
        count = np.zeros(tree.leaves, np.int64)
        core = np.zeros(tree.leaves, np.int64)
        sums = np.zeros((tree.leaves, dims))
        best = np.full(tree.leaves, -9.0)
        pivot = np.zeros((tree.leaves, dims), np.float32)
        pivot_id = np.zeros(tree.leaves, np.int64)
        for b in batches:
            x = from_binary(b.column(1), dims)
            ids = b.column(0).to_numpy()
            leaf = tree.route(x)
            order = np.argsort(leaf, kind="stable")
            ls = leaf[order]
            starts = np.flatnonzero(np.concatenate([[True], ls[1:] != ls[:-1]])) if len(ls) else np.zeros(0, np.int64)
            if not len(starts):
                continue
            sums[ls[starts]] += np.add.reduceat(x[order].astype(np.float64), starts, axis=0)
            count += np.bincount(leaf, minlength=tree.leaves)
            if centres is not None:
                d = np.einsum("ij,ij->i", x, centres[leaf])
                core += np.bincount(leaf[d >= compact], minlength=tree.leaves)
                o = np.lexsort((ids, -d, leaf))
                first = o[np.flatnonzero(np.concatenate([[True], leaf[o][1:] != leaf[o][:-1]]))]
                first = first[d[first] > best[leaf[first]]]
                best[leaf[first]], pivot[leaf[first]], pivot_id[leaf[first]] = d[first], x[first], ids[first]
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int64()), pa.array(count[some]), pa.array(core[some]), pa.array([s.tobytes() for s in sums[some]], pa.binary()), pa.array(best[some]), pa.array([p.tobytes() for p in pivot[some]], pa.binary()), pa.array(pivot_id[some])],
            ["leaf", "n", "core", "total", "best", "pivot", "pivot_id"],
        )

    schema = "leaf bigint, n bigint, core bigint, total binary, best double, pivot binary, pivot_id bigint"

    def merge(group: pa.Table) -> pa.Table:
        total = np.frombuffer(b"".join(group.column("total").to_pylist()), np.float64).reshape(-1, dims).sum(axis=0)
        best = group.column("best").to_numpy()
        ids = group.column("pivot_id").to_numpy()
        top = int(np.lexsort((ids, -best))[0])
        return pa.table({"leaf": group.column("leaf").slice(0, 1), "n": [int(group.column("n").to_numpy().sum())], "core": [int(group.column("core").to_numpy().sum())], "total": pa.array([total.tobytes()], pa.binary()), "best": [float(best[top])], "pivot": pa.array([group.column("pivot")[top].as_py()], pa.binary()), "pivot_id": [int(ids[top])]})

    parts = vectors.select("id", "vec").mapInArrow(one, schema)
    rows = parts.groupBy("leaf").applyInArrow(merge, schema).collect()  # one row per leaf of the upper tree, whose size is bounded
    return {r.leaf: (r.n, r.core, np.frombuffer(r.total, np.float64), np.frombuffer(r.pivot, np.float32), r.pivot_id) for r in rows}


MEMBER = "id bigint, vec binary, leaf bigint, part int, dot float"


def _bisect_group(group: pa.Table, compact: float, link: float) -> pa.Table:
    ids = group.column("id").to_numpy()
    o = np.argsort(ids, kind="stable")
    ids, x = ids[o], from_binary(group.column("vec"))[o]
    leaf, dots, _, pivots = bisect(x, compact, link)
    return pa.table({"id": ids, "vec": to_binary(x), "leaf": ids[pivots][leaf], "part": np.zeros(len(ids), np.int32), "dot": pa.array(dots, pa.float32())})


def compact_leaves(vectors: DataFrame, link: float, compact: float, node_rows: int, sample_rows: int, seed: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tables of members ``(id, vec, leaf, part, dot)`` that together hold every vector once, and the staged tables they are read from.

    A leaf's key is the id of its pivot; a leaf too large for a task comes in
    several parts. ``vectors`` is a staged table, which is discarded as soon as
    the nodes hold it. Rounds over the cluster split nodes of more than ``node_rows`` vectors: a bounded
    sample proposes splits, all rows correct their centres and measure their
    leaves. A leaf too large for a task is finished where it lies if it is
    compact: rows near its centre and linked to its pivot stay together without
    being moved, the others go on. The rest is bisected to the end in one task
    a node. Where a round leaves nearly all rows open, as splits by the sample
    don't part them, the next nodes are cut by a hash; what that parts is joined
    by the links of leaves as everything else is.
    """
    out: list[DataFrame] = []
    read = [vectors]

    def finish(nodes: DataFrame) -> None:
        out.append(nodes.groupBy("node").applyInArrow(lambda g: _bisect_group(g, compact, link), MEMBER))

    rest, total, level = vectors, vectors.count(), 0
    while total > node_rows:
        rate = min(1.0, sample_rows / total)
        picked = rest.where(F.expr(f"pmod(xxhash64(id, {seed + level}), 1000003) < {rate} * 1000003")).select("vec")
        sample = from_binary(picked.toArrow().column("vec"))  # about ``sample_rows``, since ids are distinct
        most = max(48, int(len(sample) * 0.6 * node_rows / total))
        tree = SplitTree(sample, most, compact, seed + level)
        stats = _leaf_stats(rest, tree, None, compact)
        sums = np.zeros((tree.leaves, sample.shape[1]))
        for k, v in stats.items():
            sums[k] = v[2]
        tree.refine(sums)
        centres = _unit(sums)
        stats = _leaf_stats(rest, tree, centres, compact)
        state = np.zeros(tree.leaves, np.int8)  # 0: to a task, 1: core stays, 2: open
        sections = np.ones(tree.leaves, np.int64)
        pivots = np.zeros((tree.leaves, sample.shape[1]), np.float32)
        pivot_ids = np.full(tree.leaves, -1, np.int64)
        for k, (n, core, _, pivot, pivot_id) in stats.items():
            pivots[k], pivot_ids[k] = pivot, pivot_id
            if n > node_rows:
                state[k] = 1 if 2 * core >= n else 2
                sections[k] = max(1, -(-2 * core // node_rows))
        routed = staged(_route(rest, tree, centres, pivots, pivot_ids, state, sections, compact, link), f"p6-routed{level}")
        if not level:
            discard(read.pop())
        read.append(routed)
        out.append(routed.where("leaf is not null").select("id", "vec", "leaf", "part", "dot"))
        finish(routed.where("node is not null").select("node", "id", "vec"))
        rest = routed.where("leaf is null and node is null").select("id", "vec")
        left = rest.count()
        if left > 0.9 * total:
            finish(rest.select(F.pmod(F.xxhash64("id"), F.lit(-(-2 * left // node_rows))).alias("node"), "id", "vec"))
            return out, read
        total, level = left, level + 1
    if total:
        finish(rest.select(F.lit(0).alias("node"), "id", "vec"))
    return out, read


def _route(vectors: DataFrame, tree: SplitTree, centres: np.ndarray, pivots: np.ndarray, pivot_ids: np.ndarray, state: np.ndarray, sections: np.ndarray, compact: float, link: float) -> DataFrame:
    def run(batches):
        for b in batches:
            ids, x = b.column(0).to_numpy(), from_binary(b.column(1))
            leaf = tree.route(x)
            kind = state[leaf]
            d = np.einsum("ij,ij->i", x, centres[leaf])
            stays = (kind == 1) & (d >= compact) & (np.einsum("ij,ij->i", x, pivots[leaf]) >= link)
            stays |= (kind == 1) & (ids == pivot_ids[leaf])
            node = np.where((kind == 0), leaf, -1)
            key = np.where(stays, pivot_ids[leaf], 0)
            part = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % sections[leaf]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(node, pa.int64(), mask=node < 0), pa.array(key, pa.int64(), mask=~stays), pa.array(part, pa.int32()), pa.array(d, pa.float32())],
                ["id", "vec", "node", "leaf", "part", "dot"],
            )

    return vectors.select("id", "vec").mapInArrow(run, "id bigint, vec binary, node bigint, leaf bigint, part int, dot float")


class _Sets:
    """Sets of numbers that are joined many pairs at a time; ``root`` has the smallest number of each one's set."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            o = np.lexsort((low, high))
            first = o[np.flatnonzero(np.concatenate([[True], high[o][1:] != high[o][:-1]]))]
            self.root[high[first]] = low[first]
            while not ((up := self.root[self.root]) == self.root).all():
                self.root = up


class _Block:
    """Members of some leaves, parts of a leaf each by itself, with the centre, the pivot and the own angle of each."""

    def __init__(self, files: list[str]):
        columns: list[list[np.ndarray]] = [[], [], [], []]
        for f in files:
            filesystem, path = pafs.FileSystem.from_uri(f)
            with filesystem.open_input_file(path) as opened:
                for batch in pq.ParquetFile(opened).iter_batches(65_536, columns=["leaf", "part", "id", "vec"], use_threads=False):
                    vec = batch.column("vec")  # all of one width, so the bytes lie side by side
                    start = np.frombuffer(vec.buffers()[1], np.int32)[vec.offset]
                    own = [batch.column(c).to_numpy() for c in ("leaf", "part", "id")]
                    for c, v in zip(columns, [*own, np.frombuffer(vec.buffers()[2], np.float32, len(vec) * DIMS, int(start)).reshape(-1, DIMS)]):
                        c.append(v.copy())
        leaf, part, self.ids, self.x = (np.concatenate(c) for c in columns)
        del columns
        if not ((leaf[1:] > leaf[:-1]) | ((leaf[1:] == leaf[:-1]) & (part[1:] >= part[:-1]))).all():
            o = np.lexsort((part, leaf))
            leaf, part, self.ids, self.x = leaf[o], part[o], self.ids[o], self.x[o]
        self.starts = np.flatnonzero(np.concatenate([[True], (leaf[1:] != leaf[:-1]) | (part[1:] != part[:-1])]))
        self.counts = np.diff(np.append(self.starts, len(leaf)))
        self.keys = leaf[self.starts]
        self.centres = _unit(np.add.reduceat(self.x, self.starts, axis=0))
        unit = np.repeat(np.arange(len(self.keys)), self.counts)
        dots = np.concatenate([np.einsum("ij,ij->i", self.x[s : s + 65_536], self.centres[unit[s : s + 65_536]]) for s in range(0, len(unit), 65_536)])
        self.angle = np.arccos(np.clip(np.minimum.reduceat(dots, self.starts).astype(np.float64), -1, 1))
        self.pivots = self.x[np.lexsort((-dots, unit))[self.starts]]


def _reach(one: _Block, i: np.ndarray, other: _Block, j: np.ndarray, link: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs ``i, j`` have members of ``i`` that a member of ``j`` may be linked with: place of the pair and row of the member."""
    least = np.cos(np.minimum(other.angle + np.arccos(link) + 1e-4, np.pi)).astype(np.float32)
    ends = np.cumsum(one.counts[i])
    pairs, rows = [], []
    s = 0
    while s < len(i):  # as many pairs as have some 32,768 members
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + 32_768, "right")))
        n = one.counts[i[s:e]]
        pair = np.repeat(np.arange(s, e), n)
        row = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(one.starts[i[s:e]], n)
        at = j[pair]
        near = np.einsum("ij,ij->i", one.x[row], other.centres[at]) >= least[at]
        pairs.append(pair[near])
        rows.append(row[near])
        s = e
    return (np.concatenate(pairs), np.concatenate(rows)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _links_of_blocks(a: _Block, b: _Block, link: float, chunk: int) -> pa.Table:
    """Links of the leaves of two blocks, or of one: enough ``sure`` ones ``a, b`` to connect all that are linked.

    Members of two leaves can be linked only if the angle between the centres
    is at most the sum of the leaves' own and the link's. With half the link's
    added to each leaf's, that is one product of extended centres. Of the pairs
    that pass and that nothing connects yet, first the pivots, then the members
    that reach the other leaf are held against each other. Where more than
    ``chunk`` members of both leaves do, they come out with ids and vectors instead.
    """
    alone = a is b
    n = len(a.keys)
    sets = _Sets(n if alone else n + len(b.keys))
    shift = 0 if alone else n
    keys = a.keys if alone else np.concatenate([a.keys, b.keys])
    o = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[o][1:] == keys[o][:-1])
    sets.join(o[same], o[same + 1])  # parts of one leaf

    def extended(block: _Block, sign: int) -> np.ndarray:
        wide = block.angle + (np.arccos(link) + 1e-4) / 2
        c = np.where(wide[:, None] > np.pi / 2, np.float32(0), block.centres)  # so wide a leaf meets everything
        wide = np.minimum(wide, np.pi / 2)[:, None]
        return np.concatenate([c, (sign * np.cos(wide)).astype(np.float32), np.sin(wide).astype(np.float32)], axis=1)

    one, other = extended(a, -1), extended(b, 1)
    large: list[pa.Table] = []
    for s in range(0, n, 512):
        for t in range(s if alone else 0, len(b.keys), 8_192):
            i, j = np.nonzero(one[s : s + 512] @ other[t : t + 8_192].T >= -1e-5)
            i, j = i + s, j + t
            if alone:
                i, j = i[i < j], j[i < j]
            for p in range(0, len(i), 65_536):
                _decide(a, i[p : p + 65_536], b, j[p : p + 65_536], shift, link, chunk, sets, large)
    moved = np.flatnonzero(sets.root != np.arange(len(keys)))
    moved = moved[keys[moved] != keys[sets.root[moved]]]
    return pa.concat_tables([_reaching(keys[moved], keys[sets.root[moved]]), *large])


def _decide(a: _Block, i: np.ndarray, b: _Block, j: np.ndarray, shift: int, link: float, chunk: int, sets: _Sets, large: list[pa.Table]) -> None:
    """Join the sets of those candidates that have linked members; what is too large for that goes to ``large``."""

    def apart(*columns: np.ndarray) -> list[np.ndarray]:
        keep = sets.root[columns[0]] != sets.root[columns[1] + shift]
        return [c[keep] for c in columns]

    i, j = apart(i, j)
    sure = np.einsum("ij,ij->i", a.pivots[i], b.pivots[j]) >= link
    sets.join(i[sure], j[sure] + shift)
    several = ~sure & ((a.counts[i] > 1) | (b.counts[j] > 1))  # of single members the pivots are all
    i, j = apart(i[several], j[several])
    fewer = a.counts[i] <= b.counts[j]
    for one, other, x, y, turned in ((a, b, i[fewer], j[fewer], False), (b, a, j[~fewer], i[~fewer], True)):
        pair, row = _reach(one, x, other, y, link)
        hit, first = np.unique(pair, return_index=True)
        back, back_row = _reach(other, y[hit], one, x[hit], link)
        bounds, ends = np.append(first, len(row)), np.searchsorted(back, np.arange(len(hit) + 1))
        for k, at in enumerate(hit.tolist()):
            mine, theirs = row[bounds[k] : bounds[k + 1]], back_row[ends[k] : ends[k + 1]]
            u, v = (y[at], x[at]) if turned else (x[at], y[at])
            if sets.root[u] == sets.root[v + shift] or not len(theirs):
                continue
            if min(len(mine), len(theirs)) > chunk:
                for block, leaf, rows, far in ((one, one.keys[x[at]], mine, other.keys[y[at]]), (other, other.keys[y[at]], theirs, one.keys[x[at]])):
                    large.append(_reaching(np.full(len(rows), leaf), np.full(len(rows), far), block.ids[rows], block.x[rows]))
            elif any((one.x[mine[s : s + 1024]] @ other.x[theirs].T >= link).any() for s in range(0, len(mine), 1024)):
                sets.join(np.array([u]), np.array([v + shift]))


def _reaching(a: np.ndarray, b: np.ndarray, ids: np.ndarray | None = None, x: np.ndarray | None = None) -> pa.Table:
    """Sure links ``a, b``, or members of ``a`` that reach ``b``."""
    n = len(a)
    sure = ids is None
    return pa.table({"a": a, "b": b, "sure": np.full(n, sure), "id": pa.nulls(n, pa.int64()) if sure else pa.array(ids), "vec": pa.nulls(n, pa.binary()) if sure else to_binary(x)}, schema=REACHING)


def _apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs ``a, b`` and further columns whose leaves the links so far don't connect."""
    roots = staged(connected_components(links), "p6-roots")
    for side in ("a", "b"):
        root = roots.select(F.col("node").alias(side), F.col("component").alias(f"{side}_root"))
        pairs = pairs.join(root, side, "left").withColumn(f"{side}_root", F.coalesce(f"{side}_root", side))
    return pairs.where("a_root <> b_root").drop("a_root", "b_root")


REACHING = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_()), ("id", pa.int64()), ("vec", pa.binary())])


def _member_links(reaching: DataFrame, link: float, chunk: int) -> DataFrame:
    """Pairs ``a, b`` of which a member is linked with a member, by all that reach each other's leaf; large sides in chunks."""
    low = F.least("a", "b")
    rows = reaching.where("not sure").select(low.alias("x"), F.greatest("a", "b").alias("y"), (F.col("a") == low).alias("first"), "id", "vec")
    sizes = rows.groupBy("x", "y").agg(F.ceil(F.count_if("first") / chunk).cast("int").alias("n"), F.ceil(F.count_if(~F.col("first")) / chunk).cast("int").alias("m")).where("n > 0 and m > 0")
    rows = rows.join(sizes, ["x", "y"])
    own = F.pmod(F.xxhash64("id"), F.when(F.col("first"), F.col("n")).otherwise(F.col("m"))).cast("int")
    rows = rows.withColumn("own", own).withColumn("meets", F.explode(F.sequence(F.lit(0), F.when(F.col("first"), F.col("m")).otherwise(F.col("n")) - 1)))
    rows = rows.select("x", "y", "first", F.when(F.col("first"), F.col("own")).otherwise(F.col("meets")).alias("i"), F.when(F.col("first"), F.col("meets")).otherwise(F.col("own")).alias("j"), "vec")

    def run(group: pa.Table) -> pa.Table:
        first, v = group.column("first").to_numpy(zero_copy_only=False), from_binary(group.column("vec"))
        p, q = v[first], v[~first]
        hit = any((p[s : s + 1024] @ q.T >= link).any() for s in range(0, len(p), 1024)) if len(q) else False
        return pa.table({"a": group.column("x").slice(0, int(hit)), "b": group.column("y").slice(0, int(hit))})

    return rows.groupBy("x", "y", "i", "j").applyInArrow(run, "a bigint, b bigint").distinct()


def _leaf_links(members: DataFrame, link: float, chunk: int) -> DataFrame:
    """All links ``(a, b)`` that connect leaves of one group.

    ``members`` is a staged table by ``block``. Blocks meet in pairs; a task
    reads the files of two and decides every pair of their leaves where it is
    (:func:`_links_of_blocks`), so nothing that grows with the pairs is written
    or moved, only links. None is left out, as candidates come from a bound.
    The work grows with the square of the leaves, whose number grows with the
    groups, not with the rows.
    """
    files: dict[int, list[str]] = defaultdict(list)
    for f in members.inputFiles():
        files[int(re.search(r"/block=(\d+)/", f).group(1))].append(f)
    blocks = sorted(files)
    pairs = [(x, y) for k, x in enumerate(blocks) for y in blocks[k:]]

    def run(batches):
        held: dict[int, _Block] = {}
        for batch in batches:
            for k in batch.column(0).to_pylist():
                for x in [x for x in held if x not in pairs[k]]:
                    del held[x]
                for x in pairs[k]:
                    if x not in held:
                        held[x] = _Block(files[x])
                yield from _links_of_blocks(held[pairs[k][0]], held[pairs[k][1]], link, chunk).to_batches()

    tasks = max(min(len(pairs), 64), len(pairs) // 4)
    found = members.sparkSession.range(0, len(pairs), 1, max(1, tasks)).mapInArrow(run, "a bigint, b bigint, sure boolean, id bigint, vec binary")
    found = staged(found, "p6-links")
    links = found.where("sure").select("a", "b")
    large = found.where("not sure")
    return links if large.isEmpty() else links.unionByName(_member_links(_apart(large, links), link, chunk))


def similarity_groups(vectors: DataFrame, link: float = 0.78, compact: float = 0.89, node_rows: int = NODE_ROWS, sample_rows: int = SAMPLE_ROWS, block_leaves: int = BLOCK_LEAVES, seed: int = 6) -> DataFrame:
    """``id, leaf, dot, group``: every vector's leaf and group, by bisecting k-means.

    ``vectors(id, vec)`` holds packed unit vectors. Nodes are split in two,
    largest dispersion first, until each leaf is compact (see :func:`bisect`);
    leaves that one group was cut into are joined again where members are at
    least ``link`` similar (:func:`_leaf_links`). ``group`` is the smallest leaf
    key of the group, ``dot`` the similarity to the leaf's centre.

    Groups are exactly those of the relation "similarity of at least ``link``,
    directly or through others" (in 32-bit arithmetic), whatever their form and
    ``node_rows``; for groups that are compact and lie apart few leaves come
    near each other and it is cheap. A block of leaves holds about four times
    ``block_leaves`` rows, of which a task has two in memory. All rows are used, also for the centres;
    samples only propose splits. Repeated ids count once; equal vectors share a
    leaf. An empty table gives no rows.
    """
    v = staged(vectors.select("id", "vec").dropDuplicates(["id"]), "p6-vectors")
    n = v.count()
    parts, read = compact_leaves(v, link, compact, node_rows, sample_rows, seed)
    if not parts:
        return v.select("id", F.col("id").alias("leaf"), F.lit(0).cast("float").alias("dot"), F.col("id").alias("group"))
    members = parts[0]
    for p in parts[1:]:
        members = members.unionByName(p)
    blocks = max(1, -(-n // (4 * block_leaves)), min(4, n // node_rows))
    members = members.withColumn("block", F.pmod(F.xxhash64("leaf", "part"), F.lit(blocks)).cast("int"))
    members = staged(members.repartition(blocks, "block").sortWithinPartitions("block", "leaf", "part"), "p6-members", ["block"])
    discard(*read)
    links = _leaf_links(members, link, node_rows // 2)
    roots = connected_components(links, "a", "b").select(F.col("node").alias("leaf"), F.col("component"))
    return members.select("id", "leaf", "dot").join(roots, "leaf", "left").select("id", "leaf", "dot", F.coalesce("component", "leaf").alias("group"))


def describe_groups(groups: DataFrame, labels: DataFrame, typical: int = 3) -> DataFrame:
    """``first_id, size, typical, labels``: each group's smallest id, size, most typical members and label counts.

    ``labels(id, label)`` may lack ids; a null label is not counted. Typical
    members are the nearest to their leaf's centre, of the group's leaf with
    most members. Ties fall to the smaller id.
    """
    sizes = groups.groupBy("group", "leaf").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    whole = sizes.groupBy("group").agg(F.sum("n").alias("size"), F.min("first").alias("first_id"), F.max_by("leaf", F.struct("n", -F.col("leaf"))).alias("main"))
    in_main = groups.join(whole.select(F.col("group").alias("g"), "main"), (F.col("group") == F.col("g")) & (F.col("leaf") == F.col("main")))
    # A few per slice first, so that no large leaf is sorted in one task.
    slice_ = in_main.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(64)))
    first = slice_.withColumn("r", F.row_number().over(W.partitionBy("group", "slice").orderBy(F.desc("dot"), "id"))).where(f"r <= {typical}")
    best = first.withColumn("r", F.row_number().over(W.partitionBy("group").orderBy(F.desc("dot"), "id"))).where(f"r <= {typical}")
    best = best.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("r", "id"))).alias("t")).select("group", F.col("t.id").alias("typical"))
    per_label = groups.join(labels, "id").where("label is not null").groupBy("group", "label").agg(F.count(F.lit(1)).alias("c"))
    counted = per_label.groupBy("group").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "c")))).alias("labels"))
    return whole.join(best, "group", "left").join(counted, "group", "left").select("first_id", "size", "typical", "labels")
