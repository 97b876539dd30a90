"""Near-duplicate vectors by cover trees and dual traversal.

Unit vectors x, y have cosine >= t iff their distance is <= sqrt(2 - 2t). Equal unit vectors form one weighted point. Points are dealt to
the cells of at most ``PIVOTS`` pivots and, within a cell, to blocks of about ``BLOCK`` points. Every block gets a cover tree: nested
levels of centres with halving radii, each node with its actual covering radius. Pairs of blocks, then pairs of their nodes, are pruned by the
covering-radius bound d(a, b) - r_a - r_b > distance; pairs of nodes that are near as a whole are counted without opening them.

Trees are written once, to files of up to ``SHELF`` blocks in the shared folder, with the vectors in the type they came in. A task takes a pair of ranges
of shelves, reads their files and sends what it found, so disk and shuffle hold each vector a fixed number of times, however many blocks it is compared with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sylvan.llm.components import components
from sylvan.llm.files import get, put
from sylvan.llm.shared import cut, fresh_path
from sylvan.llm.simhash import forest

BLOCK, PIVOTS = 2048, 1024
#: Blocks in a file, and shelves in a side of what one task compares; fewer in small tables, for the sake of parallel tasks.
SHELF, SIDE = 16, 16
#: A point's number is its shelf and its place there.
PLACES = 1 << 24
RADII = [2.0 / 2**k for k in range(8)]
#: Bounds are widened by so much, far above what rounding moves a distance.
SLACK = 1e-6
#: Rows of a matrix that are looked through at a time.
STRIP = 256


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors of rows, the same bits for the same row whatever rows it stands among."""
    x = np.ascontiguousarray(x, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True)) + 0.0


def raw_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows that take part and their vectors as they came, by length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = column.type.value_type.to_pandas_dtype()
    edge, known = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    values = column.values
    whole = np.r_[0, np.cumsum(values.is_null().to_numpy(zero_copy_only=False))] if values.null_count else np.zeros(len(values) + 1, np.int64)
    values = values.fill_null(0).to_numpy() if values.null_count else values.to_numpy()
    size = np.where(known & (whole[edge[1:]] == whole[edge[:-1]]), np.diff(edge), 0)
    for n in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == n)
        x = values[edge[rows][:, None] + np.arange(n)].astype(kind, copy=False)
        good = np.isfinite(x).all(1) & (x != 0).any(1)
        if good.any():
            yield rows[good], x[good]


def keys(x: np.ndarray) -> np.ndarray:
    """128 bits of a digest of each row, as two numbers."""
    return np.frombuffer(b"".join(hashlib.sha256(r).digest()[:16] for r in unit(x)), np.int64).reshape(-1, 2)


def source(vectors: DataFrame) -> DataFrame:
    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind if kind == "array<float>" else "array<double>").alias("embedding")).where("vec_id is not null")


def keyed(vectors: DataFrame) -> DataFrame:
    """``(vec_id, size, k1, k2)`` of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in raw_rows(batch.column(1)):
                k = keys(x)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), x.shape[1], np.int64)), pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy())], ["vec_id", "size", "k1", "k2"])

    return source(vectors).mapInArrow(run, "vec_id long, size long, k1 long, k2 long")


def pivots_of(vectors: DataFrame, x: DataFrame, wanted: dict[int, int], counts: dict[int, int]) -> dict[int, np.ndarray]:
    """For each length the vectors of so many smallest keys; what lies above a bound on the keys isn't sorted."""
    spark = vectors.sparkSession
    bounds = [(s, k, min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, (4 * k + 64) / counts[s])))) for s, k in wanted.items()]
    few = x.join(F.broadcast(spark.createDataFrame(bounds, "size long, k long, top long")), "size").where("k1 <= top").select("size", "k", "k1", "k2").distinct()
    few = few.withColumn("nr", F.row_number().over(Window.partitionBy("size").orderBy("k1", "k2"))).where("nr <= k")
    chosen = {(r.k1, r.k2) for r in few.collect()}

    def run(batches):
        seen = set()
        for batch in batches:
            for _, v in raw_rows(batch.column(1)):
                for k, row in zip(map(tuple, keys(v).tolist()), v):
                    if k in chosen and k not in seen:
                        seen.add(k)
                        yield pa.RecordBatch.from_pydict({"k1": [k[0]], "k2": [k[1]], "v": pa.array([unit(row[None])[0].tobytes()], pa.binary())})

    found = {(r.k1, r.k2): np.frombuffer(r.v) for r in source(vectors).mapInArrow(run, "k1 long, k2 long, v binary").collect()}
    out: dict[int, list] = {}
    for _, v in sorted(found.items()):
        out.setdefault(len(v), []).append(v)
    return {s: np.stack(v) for s, v in out.items()}


def nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The number of each unit vector's nearest pivot; near ties are decided by sums that don't depend on the other rows."""
    cell = np.empty(len(x), np.int64)
    for s in range(0, len(x), 1024):
        dot = x[s : s + 1024] @ pivots.T
        cell[s : s + 1024] = dot.argmax(1)
        close = dot >= dot.max(1, keepdims=True) - 1e-9
        for i in np.flatnonzero(close.sum(1) > 1):
            near = np.flatnonzero(close[i])
            cell[s + i] = near[(pivots[near] * x[s + i]).sum(1).argmax()]
    return cell


def cells(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``(size, cell, n)``: about how many points each cell has."""

    def run(batches):
        for batch in batches:
            for _, x in raw_rows(batch.column(1)):
                k = keys(x)[:, 0].copy()
                yield pa.RecordBatch.from_pydict({"size": np.full(len(x), x.shape[1], np.int64), "cell": nearest(unit(x), pivots[x.shape[1]]), "k1": k})

    return source(vectors).mapInArrow(run, "size long, cell long, k1 long").groupBy("size", "cell").agg(F.approx_count_distinct("k1").alias("n"))


class Layout:
    """Numbers of the blocks of each cell, of shelves and of the pairs of shelf ranges (tiles), by vector length."""

    def __init__(self, pivots: dict[int, np.ndarray], known: dict[tuple[int, int], int]):
        self.sizes, self.first, self.salts, self.shelf0, self.shelves, self.deep, self.side, self.tile0 = sorted(pivots), {}, {}, {}, {}, {}, {}, [0]
        shelf = 0
        for s in self.sizes:
            n = np.array([max(1, -(-known.get((s, c), 1) // BLOCK)) for c in range(len(pivots[s]))])
            self.salts[s], self.first[s] = n, np.r_[0, np.cumsum(n)]
            blocks = int(n.sum())
            self.deep[s] = min(SHELF, max(1, blocks // 12))
            self.shelf0[s], self.shelves[s] = shelf, -(-blocks // self.deep[s])
            shelf += self.shelves[s]
            self.side[s] = min(SIDE, max(1, self.shelves[s] // 40))
            k = -(-self.shelves[s] // self.side[s])
            self.tile0.append(self.tile0[-1] + k * (k + 1) // 2)

    def tile(self, t: int) -> tuple[int, range, range]:
        """The vector length and the two ranges of shelves of a tile."""
        at = int(np.searchsorted(self.tile0, t, "right")) - 1
        s, t = self.sizes[at], t - self.tile0[at]
        b = int((np.sqrt(8.0 * t + 1) - 1) / 2)
        b += (b + 1) * (b + 2) // 2 <= t
        b -= b * (b + 1) // 2 > t
        a = t - b * (b + 1) // 2
        own = lambda k: range(self.shelf0[s] + k * self.side[s], self.shelf0[s] + min(self.shelves[s], (k + 1) * self.side[s]))
        return s, own(a), own(b)


def deal(vectors: DataFrame, pivots: dict[int, np.ndarray], layout: Layout) -> DataFrame:
    """``(shelf, block, k1, k2, rep, weight, raw)``: rows of equal unit vectors in a batch become one."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, x in raw_rows(batch.column(1)):
                s, k = x.shape[1], keys(x)
                _, at, group, weight = np.unique(k, axis=0, return_index=True, return_inverse=True, return_counts=True)
                rep = np.full(len(at), np.iinfo(np.int64).max)
                np.minimum.at(rep, group.ravel(), ids[rows])
                k, x = k[at], np.ascontiguousarray(x[at])
                cell = nearest(unit(x), pivots[s])
                block = layout.first[s][cell] + (k[:, 1].view(np.uint64) % layout.salts[s][cell].astype(np.uint64)).astype(np.int64)
                raw = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * x.itemsize * s).astype(np.int32)), pa.py_buffer(x)])
                yield pa.RecordBatch.from_arrays([pa.array(layout.shelf0[s] + block // layout.deep[s]), pa.array(block), pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), pa.array(rep), pa.array(weight.astype(np.int64)), raw], ["shelf", "block", "k1", "k2", "rep", "weight", "raw"])

    return source(vectors).mapInArrow(run, "shelf long, block long, k1 long, k2 long, rep long, weight long, raw binary")


def tree(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Order of the points; for each level the nodes' first places (one entry more) and radii. A node's centre is its first point. Levels that the next one hardly divides are left out."""
    n = len(x)
    d = np.sqrt(np.maximum(0, 2 - 2 * (x @ x.T)))
    order, starts = np.arange(n), np.array([0, n])
    levels, radii = [starts], [np.array([d[0].max()])]
    for r in RADII[1:]:
        if len(starts) == n + 1:
            break
        parts, edge = [], [0]
        for a, b in zip(starts[:-1], starts[1:]):
            rest = order[a:b]
            while len(rest):
                near = d[rest[0], rest] <= r
                near[0] = True
                parts.append(rest[near])
                edge.append(edge[-1] + len(parts[-1]))
                rest = rest[~near]
        order, starts = np.concatenate(parts), np.array(edge)
        levels.append(starts)
        radii.append(np.array([d[p[0], p].max() for p in parts]))
    if len(starts) < n + 1:
        levels.append(np.arange(n + 1))
        radii.append(np.zeros(n))
    keep = [len(levels) - 1]
    for k in range(len(levels) - 2, 0, -1):
        if (len(levels[k]) - 1) * 4 <= (len(levels[keep[0]]) - 1) * 3:
            keep.insert(0, k)
    if keep[0]:
        keep.insert(0, 0)
    return order, [levels[k] for k in keep], [radii[k] for k in keep]


def shelve(dealt: DataFrame, pivots: dict[int, np.ndarray], layout: Layout, kind: str, folder: str) -> DataFrame:
    """Writes the trees, one file per shelf -> ``(k1, k2, pid, rep, weight, block, far)``, one row per point; block and far (the largest distance to the pivot) at the first of a block only."""

    def build(table: pa.Table) -> pa.Table:
        shelf, block = table.column("shelf")[0].as_py(), table.column("block").to_numpy()
        k = np.stack([table.column("k1").to_numpy(), table.column("k2").to_numpy()], 1)
        order = np.lexsort((k[:, 1], k[:, 0], block))
        k, block = k[order], block[order]
        first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(1) | (block[1:] != block[:-1])])
        rep = np.minimum.reduceat(table.column("rep").to_numpy()[order], first)
        weight = np.add.reduceat(table.column("weight").to_numpy()[order], first)
        k, block = k[first], block[first]
        lists = table.column("raw").take(pa.array(order[first])).to_pylist()
        raw = np.frombuffer(b"".join(lists), kind).reshape(len(first), -1)
        size, edge = raw.shape[1], np.r_[np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), len(first)]
        place, nodes, near, depth, mark, fars = [], [], [], [], np.full(len(first), -1), np.full(len(first), np.nan)
        for a, b in zip(edge[:-1], edge[1:]):
            x = unit(raw[a:b])
            own, levels, radii = tree(x)
            place.append(a + own)
            nodes += levels
            near += radii
            depth.append(len(levels))
            cell = int(np.searchsorted(layout.first[size], block[a], "right")) - 1
            mark[a], fars[a] = block[a], np.sqrt(np.maximum(0, 2 - 2 * (x @ pivots[size][cell]))).max()
        place = np.concatenate(place)
        up = np.nextafter(np.concatenate(near).astype(np.float32), np.float32(np.inf))
        counts = np.array([len(n) for n in nodes])
        put(f"{folder}/{shelf}", [np.array([size]), block[edge[:-1]], edge, np.array(depth), counts, np.concatenate(nodes).astype(np.int32), up, rep[place], weight[place], raw[place].ravel()])
        return pa.table({"k1": k[place, 0], "k2": k[place, 1], "pid": shelf * PLACES + np.arange(len(place)), "rep": rep[place], "weight": weight[place], "block": pa.array(mark, mask=mark < 0), "far": pa.array(fars, mask=mark < 0)})

    return dealt.groupBy("shelf").applyInArrow(build, "k1 long, k2 long, pid long, rep long, weight long, block long, far double")


def unshelve(path: str, basis: dict[int, np.ndarray]) -> tuple[np.ndarray, list[tuple]]:
    """Reps of a shelf, and its blocks: (number, first place, tree)."""
    (size,), number, edge, depth, counts, nodes, radii, rep, weight, raw = get(path)
    raw, out, at, rad = raw.reshape(-1, int(size)), [], 0, 0
    ends = np.r_[0, np.cumsum(depth)]
    for k, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
        levels, rs = [], []
        for n in counts[ends[k] : ends[k + 1]].tolist():
            levels.append(nodes[at : at + n].astype(np.int64))
            rs.append(radii[rad : rad + n - 1].astype(np.float64))
            at, rad = at + n, rad + n - 1
        parents = [np.zeros(1, np.int64), *(np.searchsorted(p, q[:-1], "right") - 1 for p, q in zip(levels[:-1], levels[1:]))]
        x = unit(raw[a:b])
        out.append((int(number[k]), a, (x @ basis[int(size)], weight[a:b], x, levels, rs, parents)))
    return np.array(rep), out


def dual(a: tuple, b: tuple, cos: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Traverses two trees (or one against itself): what to add to the links of a's and b's points, and links (a's place, b's place) that join whatever is linked."""
    (fa, wa, xa, la, ra, pa_), (fb, wb, xb, lb, rb, pb_) = a, b
    far = np.sqrt(2 - 2 * cos)
    na, nb = np.zeros(len(xa), np.int64), np.zeros(len(xb), np.int64)
    i, j, links = np.zeros(1, np.int64), np.zeros(1, np.int64), []
    depth = max(len(la), len(lb))
    for level in range(depth):
        ka, kb = min(level, len(la) - 1), min(level, len(lb) - 1)
        ca, cb = la[ka][:-1], lb[kb][:-1]
        if level:
            up_a, up_b = pa_[ka] if ka == level else np.arange(len(ca)), pb_[kb] if kb == level else np.arange(len(cb))
            if (np.bincount(up_a)[i] * np.bincount(up_b)[j]).sum() * 8 > len(ca) * len(cb):
                i, j = screened(i, j, up_a, up_b, fa[ca], fb[cb], ra[ka], rb[kb], far)
            else:
                i, j = children(i, j, up_a if ka == level else None, up_b if kb == level else None)
            if same:
                keep = i <= j
                i, j = i[keep], j[keep]
        last = level == depth - 1
        if not len(i):
            break
        dot = dots(xa, xb, ca, cb, i, j)
        if last:
            hit = dot >= cos
            if same:
                hit &= i != j
            i, j = i[hit], j[hit]
            np.add.at(na, i, wb[j])
            np.add.at(nb, j, wa[i])
            links.append(np.stack([i, j]))
            break
        d = np.sqrt(np.maximum(0, 2 - 2 * dot))
        reach = ra[ka][i] + rb[kb][j]
        whole = d + reach <= far - SLACK
        if same:
            whole &= i != j
        for p, q in zip(i[whole].tolist(), j[whole].tolist()):
            sa, sb = slice(*la[ka][p : p + 2]), slice(*lb[kb][q : q + 2])
            na[sa] += wb[sb].sum()
            nb[sb] += wa[sa].sum()
            in_a, in_b = np.arange(sa.start, sa.stop), np.arange(sb.start, sb.stop)
            links += [np.stack([in_a, np.full(len(in_a), sb.start)]), np.stack([np.full(len(in_b), sa.start), in_b])]
        near = (d - reach <= far + SLACK) & ~whole
        i, j = i[near], j[near]
    found = np.concatenate(links, 1) if links else np.zeros((2, 0), np.int64)
    return na, nb, found[0], found[1]


def screened(i, j, up_a, up_b, ca, cb, ra, rb, far):
    """Children of the pairs i, j, without those that the covering radii rule out in a subspace (where distances are smaller) and in single precision, its rounding allowed for.

    (far + ra + rb)^2 - |ca - cb|^2 is one matrix product: its terms in ra, rb and the squares are three more columns.
    """
    far = far + SLACK
    left = np.column_stack([2 * ca, far * far + ra * ra + 2 * far * ra - (ca * ca).sum(1), np.ones(len(ca)), 2 * ra]).astype(np.float32)
    right = np.zeros((left.shape[1], -(-len(cb) // 8) * 8), np.float32)
    right[:, : len(cb)] = np.column_stack([cb, np.ones(len(cb)), rb * rb + 2 * far * rb - (cb * cb).sum(1), rb]).T
    right[-2, len(cb) :] = -1e9
    least = np.float32(-2.4e-7 * (ca.shape[1] + 11) * (4 + 2 * (far + ra.max() + rb.max()) ** 2))
    p, q = [], []
    for s in range(0, len(left), STRIP):
        near = ((left[s : s + STRIP] @ right) >= least).reshape(-1, 8)
        eight = np.flatnonzero(near.view(np.uint64))
        at, bit = np.nonzero(near[eight])
        at = eight[at] * 8 + bit
        p.append(at // right.shape[1] + s)
        q.append(at % right.shape[1])
    p, q = np.concatenate(p), np.concatenate(q)
    open_ = np.zeros((up_a[-1] + 1, up_b[-1] + 1), bool)
    open_[i, j] = True
    if not open_.all():
        near = open_[up_a[p], up_b[q]]
        p, q = p[near], q[near]
    return p, q


def children(i, j, up_a, up_b):
    """Pairs of the nodes' children; None: that side stays at its last level."""
    for side, up in ((0, up_a), (1, up_b)):
        if up is None:
            continue
        edge = np.searchsorted(up, np.arange(up[-1] + 2))
        own = (i, j)[side]
        n = edge[own + 1] - edge[own]
        row = np.repeat(np.arange(len(own)), n)
        child = edge[own][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        i, j = (child, j[row]) if side == 0 else (i[row], child)
    return i, j


def dots(xa, xb, ca, cb, i, j):
    """Inner products of centres: one matrix product if the pairs are dense, else pair by pair."""
    if len(i) * 8 > len(ca) * len(cb):
        return (xa[ca] @ xb[cb].T)[i, j]
    out = np.empty(len(i))
    for s in range(0, len(i), 65536):
        e = slice(s, s + 65536)
        out[e] = np.einsum("ij,ij->i", xa[ca[i[e]]], xb[cb[j[e]]])
    return out


def compare(tiles: DataFrame, folder: str, there: np.ndarray, wanted: dict[int, np.ndarray], basis: dict[int, np.ndarray], layout: Layout, cos: float) -> DataFrame:
    """Tiles -> ``(pid, rep, n, root)``: links to add to a point, and the rep of a point that it is linked with in the tile (its own if with none)."""

    def tile(t: int) -> pa.RecordBatch:
        size, left, right = layout.tile(t)
        blocks, last = layout.deep[size], int(layout.salts[size].sum())
        cell = lambda shelf: np.searchsorted(layout.first[size], np.arange((shelf - layout.shelf0[size]) * blocks, min(last, (shelf - layout.shelf0[size] + 1) * blocks)), "right") - 1
        base, reps, ns, label = {}, [], [], np.zeros(0, np.int64)

        def load(shelf):
            nonlocal label
            rep, trees = unshelve(f"{folder}/{shelf}", basis)
            if shelf not in base:
                base[shelf] = len(label)
                reps.append((shelf, rep))
                ns.append(np.zeros(len(rep), np.int64))
                label = np.r_[label, np.arange(len(label), len(label) + len(rep))]
            return trees, ns[list(base).index(shelf)]

        for sa in left:
            if sa not in alive:
                continue
            one = None
            for sb in right:
                if sb < sa or sb not in alive or not wanted[size][np.ix_(cell(sa), cell(sb))].any():
                    continue
                one = one or load(sa)
                (ta, na), (tb, nb) = one, one if sa == sb else load(sb)
                edges = []
                for ka, (xa, pa_, a) in enumerate(ta):
                    ca = int(np.searchsorted(layout.first[size], xa, "right")) - 1
                    for xb, pb_, b in tb[ka:] if sa == sb else tb:
                        if not wanted[size][ca, int(np.searchsorted(layout.first[size], xb, "right")) - 1]:
                            continue
                        more_a, more_b, p, q = dual(a, b, cos, xa == xb)
                        na[pa_ : pa_ + len(more_a)] += more_a
                        nb[pb_ : pb_ + len(more_b)] += more_b
                        p, q = label[base[sa] + pa_ + p], label[base[sb] + pb_ + q]
                        if (apart := p != q).any():
                            edges.append(np.unique(np.stack([p[apart], q[apart]]), axis=1) if apart.sum() > 65536 else np.stack([p[apart], q[apart]]))
                            if sum(e.shape[1] for e in edges) > 1 << 20:
                                label, edges = forest(*np.concatenate(edges, 1), len(label))[label], []
                if edges:
                    label = forest(*np.concatenate(edges, 1), len(label))[label]
        if not base:
            return None
        rep, n = np.concatenate([r for _, r in reps]), np.concatenate(ns)
        pid = np.concatenate([s * PLACES + np.arange(len(r)) for s, r in reps])
        changed = (n > 0) | (label != np.arange(len(label)))
        return pa.RecordBatch.from_pydict({"pid": pid[changed], "rep": rep[changed], "n": n[changed], "root": rep[label][changed]})

    alive = set(there.tolist())

    def run(batches):
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if (found := tile(t)) is not None:
                    yield found

    return tiles.mapInArrow(run, "pid long, rep long, n long, root long")


def subspace(pivots: np.ndarray, cos: float) -> np.ndarray:
    """Orthonormal directions in which the pivots differ most, as many as it takes for chance distances to be well over the one sought."""
    size = pivots.shape[1]
    k = min(size, max(16, int(np.ceil(2.5 * (2 - 2 * cos) * size))))
    main = np.linalg.svd(pivots - pivots.mean(0), full_matrices=False)[2][:k].T
    return np.linalg.qr(np.column_stack([main, np.random.default_rng(0).normal(size=(size, k))]))[0][:, :k]


def near_vectors(vectors: DataFrame, cos: float = 0.95) -> DataFrame:
    """``vectors(vec_id, embedding, ...)`` -> ``(vec_id, n_links, component_id, kept)``, one row per input row.

    Cosine in double precision; pairs at or above ``cos`` are linked. Null, empty, zero or non-finite vectors, and those with a null
    component, link with nothing; vectors of different lengths never link. Rows that share a vec_id count as vectors of their
    own, and each gets the sum of what its id links. A null vec_id has a null component. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    kind = "f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "f8"
    x = cut(keyed(vectors), "keys")
    counts = {r[0]: max(1, r[1]) for r in x.groupBy("size").agg(F.approx_count_distinct("k1")).collect()}
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    if not counts:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    pivots = pivots_of(vectors, x, {s: min(PIVOTS, -(-n // BLOCK)) for s, n in counts.items()}, counts)
    layout = Layout(pivots, {(r["size"], r["cell"]): r["n"] for r in cells(vectors, pivots).collect()})
    folder = fresh_path(spark, "trees")
    points = cut(shelve(deal(vectors, pivots, layout), pivots, layout, kind, folder), "points")
    known = points.where("block is not null").select(F.floor(F.col("pid") / PLACES).alias("shelf"), "block", "far").collect()
    there = np.unique(np.array([r["shelf"] for r in known], np.int64))
    limit, wanted = np.sqrt(2 - 2 * cos) + SLACK, {}
    for size in layout.sizes:
        far = np.full(len(pivots[size]), -np.inf)
        own = [r for r in known if layout.shelf0[size] <= r["shelf"] < layout.shelf0[size] + layout.shelves[size]]
        np.maximum.at(far, np.searchsorted(layout.first[size], [r["block"] for r in own], "right") - 1, [r["far"] for r in own])
        d = np.sqrt(np.maximum(0, 2 - 2 * pivots[size] @ pivots[size].T))
        wanted[size] = d - far[:, None] - far <= limit
    basis = {s: subspace(pivots[s], cos) for s in layout.sizes}
    n = layout.tile0[-1]
    tasks = min(n, max(8 * spark.sparkContext.defaultParallelism, n // 4))
    found = cut(compare(spark.range(0, n, 1, tasks), folder, there, wanted, basis, layout, cos), "found")
    links = found.groupBy("pid").agg(F.sum("n").alias("n"))
    comp = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("vertex", "rep")
    linked = points.join(links, "pid", "left").join(comp, "rep", "left").select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component_id", "rep").alias("component_id"))
    per_id = x.join(linked, ["k1", "k2"]).groupBy("vec_id").agg(F.sum("n").alias("n"), F.min("component_id").alias("component_id"))
    out = ids.join(per_id, "vec_id", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").isNotNull() & F.col("vec_id").eqNullSafe(F.col("component_id")))
