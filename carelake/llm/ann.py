"""Approximate nearest neighbours: stable projections indexed by kd-trees.

Vectors are lifted so that the largest inner product is the smallest Euclidean
distance (queries, whose own length changes no order, are given the length of the
lifted vectors), and projected on a few Gaussian directions. The squared ratio of
projected to true distance then follows a chi-square law with as many degrees of
freedom as directions. Vectors of about equal norms form a band with a lift of its
own, so that long vectors don't make all distances alike. The projected space is
cut into cells by a kd-tree fitted to a bounded sample (max_sample); every vector
is indexed in a block of its cell. A query verifies a block's vectors on the
original components in projected order, nearest first, and stops at the first one
that is so far that the chi-square law leaves the k-th distance found so far
standing with the wanted confidence. It searches its own cell first and then, with
the distance found there, only cells whose nearest corner passes the same test.

A block's vectors reach a task once, before the queries that visit the block, which
stream past them: neither blocks nor queries are gathered. Blocks of a cell with
very many visits are dealt to several tasks.

Copies of a vector beyond the k + 1 smallest ids can't be among the k nearest and
are not indexed; as queries they take part. Ties go to smaller ids.

Cases: vectors that are null, empty, zero or hold null or non-finite components
take no part, nor do rows of a null id, nor those whose length is not that of
most vectors (the longer one in a tie); an empty table gives an empty result;
repeated ids are each candidates and queries of their own; other columns are
never read, whatever their names.
"""

from __future__ import annotations

from math import erfc, exp, gamma, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

MAX_SAMPLE = 20_000
MAX_CELLS = 4096
#: Bands of norms at most; the last one takes all that is shorter.
MAX_BANDS = 24
#: Vectors of a block, queries compared with it at once, visits of a block in one task.
BLOCK, CHUNK, VISITS = 8192, 256, 1 << 20
#: The first candidates of a block that are verified before the test is made again.
STEPS = (128,)


def chi_square_quantile(p: float, freedom: int) -> float:
    """By bisection on the regularised incomplete gamma function."""

    def below(x: float) -> float:
        half, h = x / 2, freedom / 2
        if freedom % 2 == 0:
            term, total = 1.0, 1.0
            for k in range(1, freedom // 2):
                term *= half / k
                total += term
            return 1 - exp(-half) * total
        total, a = erfc(sqrt(half)), 0.5
        while a < h - 0.1:
            total += exp(-half) * half**a / gamma(a + 1)
            a += 1
        return 1 - total

    lo, hi = 0.0, 10.0 * freedom + 100
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def _splits(points: np.ndarray, cells: int) -> list:
    """A kd-tree as nested (axis, threshold, left, right); leaves are cell numbers."""
    count = [0]

    def cut(p: np.ndarray, parts: int):
        if parts > 1 and len(p) > 1:
            axis = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
            at = float(np.median(p[:, axis]))
            left = p[:, axis] <= at
            if 0 < left.sum() < len(p):
                return (axis, at, cut(p[left], parts // 2), cut(p[~left], parts - parts // 2))
        count[0] += 1
        return count[0] - 1

    return [cut(points, cells), count]


def _cell(tree, p: np.ndarray) -> np.ndarray:
    out = np.zeros(len(p), np.int32)

    def go(node, rows):
        if not isinstance(node, tuple):
            out[rows] = node
            return
        left = p[rows, node[0]] <= node[1]
        go(node[2], rows[left])
        go(node[3], rows[~left])

    go(tree, np.arange(len(p)))
    return out


def _box_distance(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared projected distances of queries to boxes."""
    out = np.zeros((len(q), len(lo)))
    for d in range(q.shape[1]):
        gap = np.maximum(np.maximum(lo[None, :, d] - q[:, d, None], q[:, d, None] - hi[None, :, d]), 0)
        out += gap * gap
    return out


def _scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows; equal rows give equal sums wherever they stand."""
    return (x * y).sum(axis=1)


def _merge(best_s, best_i, q, s, i, k: int) -> None:
    """Puts the candidates (query number, score, id) into the sorted best of each query."""
    if not len(q):
        return
    order = np.lexsort((i, -s, q))
    q, s, i = q[order], s[order], i[order]
    place = np.arange(len(q)) - np.searchsorted(q, q, "left")
    q, s, i, place = (x[place < k] for x in (q, s, i, place))
    rows = np.unique(q)
    new_s, new_i = np.full((len(rows), k), -np.inf), np.full((len(rows), k), np.iinfo(np.int64).max)
    new_s[np.searchsorted(rows, q), place], new_i[np.searchsorted(rows, q), place] = s, i
    both_s, both_i = np.concatenate([best_s[rows], new_s], axis=1), np.concatenate([best_i[rows], new_i], axis=1)
    order = np.lexsort((both_i, -both_s), axis=1)[:, :k]
    best_s[rows], best_i[rows] = np.take_along_axis(both_s, order, 1), np.take_along_axis(both_i, order, 1)


def search_block(vec, ids, rows, proj, top: float, qvec, qrows, qproj, bound, k: int, limit: float):
    """Ids and scores (padded with -inf) of each query's k best in the block, and how many of it were verified.

    top is the square of the band's norm, qproj the projection of queries of length 1; bound is the k-th score known
    for each query, or -infinity.
    """
    n, r = len(qvec), len(vec)
    best_i, best_s = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -np.inf)
    scale, qproj = sqrt(top) / np.sqrt((qvec * qvec).sum(axis=1)), sqrt(top) * qproj
    far = np.maximum((qproj * qproj).sum(axis=1)[:, None] + (proj * proj).sum(axis=1)[None, :] - 2 * (qproj @ proj.T), 0)
    open_ = qrows[:, None] != rows[None, :]
    seen = np.zeros(n, np.int64)

    def reach() -> np.ndarray:
        """The projected distance up to which the law doesn't rule a candidate out."""
        kth = np.maximum(bound, best_s[:, -1])
        return np.where(np.isfinite(kth), limit * np.maximum(2 * top - 2 * scale * kth, 0) + 1e-9 * top, np.inf)[:, None]

    def verify(q: np.ndarray, v: np.ndarray, kth: np.ndarray) -> None:
        for lo in range(0, len(q), 1 << 15):
            a, b = q[lo : lo + (1 << 15)], v[lo : lo + (1 << 15)]
            s = _scores(qvec[a], vec[b])
            good = s >= kth[a]
            _merge(best_s, best_i, a[good], s[good], ids[b[good]], k)

    for step in [x for x in STEPS if x < r]:
        at = np.argpartition(far, step - 1, axis=1)[:, :step]
        hit = (np.take_along_axis(far, at, 1) <= reach()) & np.take_along_axis(open_, at, 1)
        q, c = np.nonzero(hit)
        np.put_along_axis(open_, at, False, 1)
        seen += hit.sum(axis=1)
        verify(q, at[q, c], np.maximum(bound, best_s[:, -1]))
    admitted = open_ & (far <= reach())
    seen += admitted.sum(axis=1)
    kth = np.maximum(bound, best_s[:, -1])
    if admitted.mean() > 0.05:
        # many: their products at once; those near the bound are computed again, one by one, for equal sums of equal rows
        s = np.where(admitted, qvec @ vec.T, -np.inf)
        if k < r:
            kth = np.maximum(kth, np.partition(s, r - k, axis=1)[:, r - k])
        q, v = np.nonzero(s >= (kth - 1e-9 * np.maximum(1, np.abs(kth)) if np.isfinite(kth).all() else np.where(np.isfinite(kth), kth - 1e-9 * np.maximum(1, np.abs(kth)), -np.finfo(float).max))[:, None])
        verify(q, v, np.maximum(bound, best_s[:, -1]))
    else:
        verify(*np.nonzero(admitted), kth)
    return best_i, best_s, seen


def _usable(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """Rows (id, dim, vec, square): vec is the bytes of the components in their own width."""
    narrow = df.schema[vector].dataType.simpleString() == "array<float>"
    kind = "f4" if narrow else "f8"

    def run(batches):
        for b in batches:
            v = b.column(1)
            flat, size = v.flatten(), v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become not-a-number
            at = np.r_[0, np.cumsum(size)]
            total = lambda y: np.diff(np.r_[0, np.cumsum(y)][at])
            finite = np.isfinite(x)
            square = np.array([x[lo:hi] @ x[lo:hi] for lo, hi in zip(at[:-1], at[1:])])
            good = np.flatnonzero((total(~finite) == 0) & (total(np.where(finite, x, 0) != 0) > 0) & ~b.column(0).is_null().to_numpy(zero_copy_only=False))
            data = x.astype(kind)
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(good)), pa.array(size[good].astype(np.int32)), pa.array([data[at[g] : at[g + 1]].tobytes() for g in good], pa.binary()), pa.array(square[good]),
            ], ["id", "dim", "vec", "square"])

    d = df.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<float>" if narrow else "array<double>").alias("v"))
    return d.mapInArrow(run, "id long, dim int, vec binary, square double")


def _array(column, kind: str) -> np.ndarray:
    """A column of equally long byte strings as rows of doubles."""
    return np.frombuffer(b"".join(x.as_py() for x in column), kind).reshape(len(column), -1).astype(np.float64)


def _bytes(x: np.ndarray, kind: str) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x.astype(kind))], pa.binary())


def search(df: DataFrame, is_query: Column, k: int = 20, id_: str = "vec_id", vector: str = "embedding", directions: int = 24, confidence: float = 0.9, seed: int = 11, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """Rows (query_id, rank, vec_id, score, n_verified): for each row that is_query (an expression of id) its k nearest others."""
    spark = df.sparkSession
    good = _usable(df, id_, vector)
    kind = "f4" if df.schema[vector].dataType.simpleString() == "array<float>" else "f8"
    sizes = good.groupBy("dim").agg(F.count("*").alias("n"), F.max("square").alias("top")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, n_verified long")
    dim, n, top = sizes[0]
    good = good.where(F.col("dim") == dim)
    rng = np.random.default_rng(seed)
    plane = rng.standard_normal((dim + 1, directions))
    limit = chi_square_quantile(confidence, directions)

    def band_of(square: np.ndarray) -> np.ndarray:
        return np.minimum(np.floor(2 * np.log2(top / square)), MAX_BANDS - 1).astype(np.int32)

    def band_top(band: np.ndarray) -> np.ndarray:
        return top * 2.0 ** (-band / 2)

    def lifted(v: np.ndarray, square: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(band_top(band_of(square)) - square, 0))
        return np.concatenate([v, lift[:, None]], axis=1) @ plane

    # about max_sample vectors, by a hash: whatever their number, the same share of every partition
    drawn = good.where(F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 30)) <= F.lit(int(min(1.0, 1.1 * max_sample / n) * (1 << 30)))).select("vec", "square").limit(2 * max_sample).toArrow().slice(0, max_sample)
    sample = lifted(_array(drawn.column("vec").combine_chunks(), kind), drawn.column("square").to_numpy())
    tree = spark.sparkContext.broadcast(_splits(sample, int(min(MAX_CELLS, max(1, -(-n // BLOCK)))))[0])

    def place(batches):
        for b in batches:
            if b.num_rows:
                square = b.column(3).to_numpy()
                p = lifted(_array(b.column(2), kind), square)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), _bytes(p, "f4"), pa.array(band_of(square)), pa.array(_cell(tree.value, p))], ["id", "row", "vec", "p", "band", "cell"])

    numbered = good.select("id", F.monotonically_increasing_id().alias("row"), "vec", "square")
    placed = written(numbered.mapInArrow(place, "id long, row long, vec binary, p binary, band int, cell int"), "placed")
    # copies beyond the k + 1 smallest ids: in two rounds, so that a common vector is not gathered at once
    base = placed.withColumn("h", F.xxhash64("vec"))
    crowded = written(base.groupBy("h").count().where(F.col("count") > k + 1).select("h"), "crowded")
    if not crowded.isEmpty():
        order = [F.col("id"), F.col("row")]
        few = base.join(crowded, "h").withColumn("r", F.row_number().over(Window.partitionBy("h", "vec", F.pmod("row", F.lit(64))).orderBy(*order))).where(F.col("r") <= k + 1)
        few = few.withColumn("r", F.row_number().over(Window.partitionBy("h", "vec").orderBy(*order))).where(F.col("r") <= k + 1).drop("r")
        base = written(base.join(crowded, "h", "left_anti").unionByName(few.select(*base.columns)), "indexed")
    base = base.drop("h")

    def boxes_of(batches):
        """Of each batch the bounds of its cells."""
        for b in batches:
            if b.num_rows:
                p, key = _array(b.column(0), "f4"), np.stack([b.column(1).to_numpy(), b.column(2).to_numpy()])
                keys, at = np.unique(key, axis=1, return_inverse=True)
                at = at.reshape(-1)
                order = np.argsort(at, kind="stable")
                first = np.searchsorted(at[order], np.arange(keys.shape[1]))
                lo, hi = (f.reduceat(p[order], first, axis=0) for f in (np.minimum, np.maximum))
                lists = [pa.array(x.tolist(), pa.list_(pa.float64())) for x in (lo, hi)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[0].astype(np.int32)), pa.array(keys[1].astype(np.int32)), pa.array(np.bincount(at).astype(np.int64)), *lists], ["band", "cell", "n", "lo", "hi"])

    # MAX_CELLS rows for each band at most
    cells = base.select("p", "band", "cell").mapInArrow(boxes_of, "band int, cell int, n long, lo array<double>, hi array<double>").groupBy("band", "cell").agg(
        F.sum("n").alias("n"), F.array(*[F.min(F.col("lo")[d]) for d in range(directions)]).alias("lo"), F.array(*[F.max(F.col("hi")[d]) for d in range(directions)]).alias("hi"),
    ).orderBy("band", "cell").collect()
    bands, numbers = (np.array([r[c] for r in cells], np.int64) for c in ("band", "cell"))
    lo, hi = (np.array([r[c] for r in cells]) for c in ("lo", "hi"))
    parts = np.array([-(-r["n"] // BLOCK) for r in cells], np.int64)
    index = spark.sparkContext.broadcast((bands, numbers, lo, hi, parts, np.array([r["n"] > k for r in cells])))
    n_blocks = int(parts.sum())

    def blocked(batches):
        """Base rows with the box and the part of it that they are in."""
        bands, numbers, parts = (index.value[x] for x in (0, 1, 4))
        for b in batches:
            key = b.column(4).to_numpy().astype(np.int64) * MAX_CELLS + b.column(5).to_numpy()
            box = np.searchsorted(bands * MAX_CELLS + numbers, key)
            part = (b.column(1).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % parts[box]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(4)), pa.array(box.astype(np.int32)), pa.array(part.astype(np.int32))], ["id", "row", "vec", "p", "box", "part"])

    base = base.select("id", "row", "vec", "p", "band", "cell").mapInArrow(blocked, "id long, row long, vec binary, p binary, box int, part int")
    queries = placed.where(is_query).select("id", "row", "vec", "cell")

    def hits(b: pa.RecordBatch, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query rows and the boxes that they visit: the one of k neighbours or more that promises the largest product, or all others within reach; and the queries' projections."""
        bands, numbers, lo, hi, _, full = index.value
        v = _array(b.column(2), kind)
        norm = np.sqrt((v * v).sum(axis=1))
        p, tops = v @ plane[:-1] / norm[:, None], band_top(bands)
        far = np.concatenate([_box_distance(p * sqrt(band_top(x)), lo[bands == x], hi[bands == x]) for x in np.unique(bands)], axis=1)  # boxes are ordered by bands
        near = np.where(numbers[None, :] == b.column(3).to_numpy()[:, None], far * 1e-3 - 1e-9 * top, far)
        # by the product of a vector as far as the box: (top - distance / 2) of the scaled query, scaled back
        home = np.argmax((tops - near / (2 * directions)) / np.sqrt(tops) - np.where(full, 0, 3 * sqrt(top)), axis=1)
        if first:
            return np.arange(len(p)), home, p
        kth = b.column(4).to_numpy(zero_copy_only=False)
        reach = 2 * tops[None, :] - 2 * np.sqrt(tops)[None, :] * (kth / norm)[:, None]
        hit = far <= limit * np.maximum(reach, 0) + 1e-9 * top
        hit[np.arange(len(p)), home] = False
        return (*np.nonzero(hit), p)

    def counted(batches):
        """Visits of each box, of each batch."""
        for b in batches:
            if b.num_rows:
                box, many = np.unique(hits(b, False)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(box.astype(np.int32)), pa.array(many.astype(np.int64))], ["box", "n"])

    def run(q: DataFrame, first: bool) -> DataFrame:
        """Rows (row, id, s, i, n): a query's best in a block and how many were verified."""
        split = {}
        if not first:
            split = {r["box"]: -(-r["n"] // VISITS) for r in q.mapInArrow(counted, "box int, n long").groupBy("box").agg(F.sum("n").alias("n")).where(F.col("n") > VISITS).collect()}
        shares = np.ones(len(parts), np.int64)
        shares[list(split)] = list(split.values())

        def visits(batches):
            parts = index.value[4]
            for b in batches:
                if not b.num_rows:
                    continue
                at, box, p = hits(b, first)
                times = parts[box]
                at, box = np.repeat(at, times), np.repeat(box, times)
                part = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                share = b.column(1).to_numpy()[at] % shares[box]
                proj = _bytes(p, "f4")
                for x in range(0, len(at), 1 << 14):
                    y = slice(x, x + (1 << 14))
                    pick = pa.array(at[y])
                    kth = np.full(len(at[y]), -np.inf) if first else b.column(4).to_numpy(zero_copy_only=False)[at[y]]
                    yield pa.RecordBatch.from_arrays([
                        b.column(0).take(pick), b.column(1).take(pick), b.column(2).take(pick), proj.take(pick), pa.array(box[y].astype(np.int32)), pa.array(part[y].astype(np.int32)), pa.array(share[y].astype(np.int32)), pa.array(kth),
                    ], ["id", "row", "vec", "p", "box", "part", "share", "kth"])

        def dealt(batches):
            for b in batches:
                times = shares[b.column(4).to_numpy()]
                pick = np.repeat(np.arange(b.num_rows), times)
                c = b.take(pa.array(pick)) if (times > 1).any() else b
                share = np.arange(len(pick)) - np.repeat(np.cumsum(times) - times, times)
                yield pa.RecordBatch.from_arrays([*c.columns, pa.array(share.astype(np.int32)), pa.array(np.full(c.num_rows, np.nan))], [*c.schema.names, "share", "kth"])

        schema = "id long, row long, vec binary, p binary, box int, part int, share int, kth double"
        both = base.mapInArrow(dealt, schema).withColumn("query", F.lit(0)).unionByName(q.mapInArrow(visits, schema).withColumn("query", F.lit(1)))
        tasks = int(min(20_000, max(spark.sparkContext.defaultParallelism, 2 * (n_blocks + sum(split.values())))))
        key = ["box", "part", "share"]
        return both.repartition(tasks, *key).sortWithinPartitions(*key, "query").mapInArrow(lambda b: _streamed(b, index.value[0], band_top, kind, k, limit), "row long, id long, s array<double>, i array<long>, n long")

    near = written(run(queries, True), "near")
    pairs = lambda d: d.select("row", "id", F.explode(F.arrays_zip("s", "i")).alias("b")).select("row", "id", "b.s", "b.i")
    ranked = lambda d: d.withColumn("r", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("s"), "i")))
    kth = ranked(pairs(near)).where(F.col("r") == k).select("row", F.col("s").alias("kth"))
    again = queries.join(kth, "row", "left").select("id", "row", "vec", "cell", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))
    both = written(near.unionByName(run(written(again, "begun"), False)), "found")
    seen = both.groupBy("row").agg(F.sum("n").alias("n_verified"))
    out = ranked(pairs(both)).where(F.col("r") <= k).join(seen, "row")
    return out.select(F.col("id").alias("query_id"), F.col("r").cast("int").alias("rank"), F.col("i").alias("vec_id"), F.col("s").alias("score"), "n_verified")


def _streamed(batches, bands, band_top, kind: str, k: int, limit: float):
    """Sorted rows: each block's vectors, then its queries, in batches as they come."""
    held: list[pa.RecordBatch] = []
    block, now = None, None
    for b in batches:
        key = np.stack([b.column(c).to_numpy().astype(np.int64) for c in (4, 5, 6)])
        query = b.column(8).to_numpy()
        cut = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0) | (query[1:] != query[:-1])])
        for lo, hi in zip(cut, np.r_[cut[1:], b.num_rows]):
            part, here = b.slice(lo, hi - lo), tuple(key[:, lo])
            if here != now:
                held, block, now = [], None, here
            if not query[lo]:
                held.append(part)
                continue
            if block is None and held:
                t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                block = (_array(t.column(2), kind), t.column(0).to_numpy(), t.column(1).to_numpy(), _array(t.column(3), "f4"), float(band_top(bands[here[0]])))
                held = []
            for x in range(0, part.num_rows if block else 0, CHUNK):
                q = part.slice(x, CHUNK)
                floor = q.column(7).to_numpy()
                i, s, seen = search_block(*block, _array(q.column(2), kind), q.column(1).to_numpy(), _array(q.column(3), "f4"), floor, k, limit)
                real = np.isfinite(s)
                offsets = pa.array(np.r_[0, np.cumsum(real.sum(axis=1))].astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(y[real])) for y in (s, i)]
                yield pa.RecordBatch.from_arrays([q.column(1), q.column(0), *lists, pa.array(seen)], ["row", "id", "s", "i", "n"])
