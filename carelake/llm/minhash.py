"""MinHash near-dedup: universal hash minima, banding, verification, components.

Texts are lower-cased (A-Z), cut into words and word shingles; a text with fewer
words than a shingle is one shingle, a text without words has none and is linked
with nothing. Identical texts are one node. The nodes' signatures are cut into
bands; nodes that share a band's bucket are candidates. A bucket's members are
compared with a pivot first: one order of all nodes gives every bucket its pivot,
so that the buckets of a group mostly agree on it. Then the members outside a
bucket's largest component are compared with all others that are not in their own
component, in blocks that keep track of the components they join and give only
links that join two, so that no link between different groups is lost and no
block gives more links than it has members. A candidate is checked on
signatures, then on whole shingle sets.

Cases: null text counts as empty; a null doc_id takes part as a node, but can't
name a component unless all of the group's ids are null; rows that repeat a
doc_id are nodes by their texts, each judged by its own text, and rows that
repeat the smallest doc_id of a group all count as that document; an empty table
gives an empty result; other columns are never read, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, row_slices, text_column, written
from .components import components
from .wordhash import U, mix, words

#: 48 bands of 6 minima: a pair of similarity 0.8 shares no bucket once in 2 million.
BANDS, ROWS = 48, 6
#: Estimates from signatures down to this many deviations below the threshold pass.
DEVIATIONS = 5
#: A bucket with more pairs to compare than SMALL is compared in blocks of members, of MASS shingles at most but for longer texts.
SMALL, BLOCK, MASS = 64, 256, 1 << 20


@lru_cache(2)
def _family(seed: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=U) + U(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    a, b = (x >> U(32)).astype(np.uint32)[::2] | np.uint32(1), (x >> U(32)).astype(np.uint32)[1::2]
    return a[:, None], b[:, None]


def shingle_sets(arr: pa.StringArray, size: int):
    """For each text its sorted distinct shingle hashes."""
    w = words(arr, lower=True)
    n = len(w.hashes)
    joined = w.hashes.copy()
    for k in range(1, size):
        joined[: n - k] = mix(joined[: n - k] * U(3) + w.hashes[k:]) if n > k else joined[: n - k]
    for i in range(len(arr)):
        lo, hi = w.first[i], w.first[i + 1]
        if hi - lo >= size:
            yield np.unique(joined[lo : hi - size + 1])
        elif hi > lo:
            h = w.hashes[lo]
            for x in w.hashes[lo + 1 : hi]:
                h = mix(np.array([h * U(3) + x]))[0]
            yield np.array([~h], U)  # apart from shingles of the full size
        else:
            yield np.zeros(0, U)


def signature(s: np.ndarray, seed: int = 7) -> bytes:
    """16 bits of each minimum."""
    a, b = _family(seed)
    x = (s >> U(32)).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 256):
        low = np.minimum(low, (a * x[None, k : k + 256] + b).min(axis=1))
    return (mix(low.astype(U)) >> U(48)).astype(np.uint16).tobytes()


def _signed(batches, size: int):
    for b in batches:
        arr = text_column(b, "text")
        for lo, hi in row_slices(arr):
            part = arr.slice(lo, hi - lo)
            nodes = [hashlib.sha256(t.as_buffer()).digest()[:16] for t in part]
            sets = [(len(s), signature(s) if len(s) else None) for s in shingle_sets(part, size)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(nodes, pa.binary()), pa.array([n for n, _ in sets], pa.int64()), pa.array([s for _, s in sets], pa.binary())], ["doc_id", "node", "n", "sig"])
        release()


def _bucketed(batches):
    for b in batches:
        h = _band_names(np.frombuffer(b"".join(x.as_py() for x in b.column(1)), np.uint16))
        yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], ["bucket", "nid"])


def _band_names(sig: np.ndarray) -> np.ndarray:
    """Bucket hashes of signatures, a row for each node."""
    s = sig.reshape(-1, BANDS, ROWS).astype(U)
    h = np.broadcast_to(mix(np.arange(BANDS, dtype=U) + U(0x5BD1)), s.shape[:2]).copy()
    for k in range(ROWS):
        h = mix(h * U(5) + s[:, :, k])
    return h


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_py() for v in column), np.uint16).reshape(len(column), -1)


def _least(percent: int) -> float:
    """The lowest estimate of a pair at the threshold, but for one in millions."""
    s = percent / 100
    return s - DEVIATIONS * (s * (1 - s) / (BANDS * ROWS)) ** 0.5


def _estimated(batches, least: float):
    """Pairs (a, b, x, y) whose signatures estimate least or more."""
    for b in batches:
        ok = (_signatures(b.column(2)) == _signatures(b.column(3))).mean(axis=1) >= least if b.num_rows else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def _block(t: pa.Table, percent: int) -> pa.Table:
    """Links between a block of members outside the largest component (side 0) and one of all members of a bucket (side 1).

    A pair is compared in the first bucket that it shares only, and not once
    earlier links have joined its components; so the links form a forest.
    """
    nid, label, side, outside = (t.column(k).to_numpy().copy() for k in ("nid", "comp", "side", "outside"))
    sigs = _signatures(t.column("sig").combine_chunks())
    names = _band_names(sigs)
    own = int(np.flatnonzero(names[0] == t.column("bucket").to_numpy()[:1].view(U))[0])
    sets = [v.values.to_numpy().view(U) for v in t.column("set").combine_chunks()]
    least, right, out = _least(percent), np.flatnonzero(side == 1), []
    for i in np.flatnonzero(side == 0):
        j = right[(label[right] != label[i]) & ~(outside[right] & (nid[right] < nid[i]))]
        e = (sigs[j] == sigs[i]).mean(axis=1)
        likely = e >= least
        j, e = j[likely], e[likely]
        for x in j[np.argsort(-e, kind="stable")]:
            if label[x] == label[i] or (names[x][:own] == names[i][:own]).any():
                continue
            k = _common(sets[i], sets[x])
            if 100 * k >= percent * (len(sets[i]) + len(sets[x]) - k):
                out.append((nid[i], nid[x]))
                label[label == label[x]] = label[i]
    ab = np.array(out, np.int64).reshape(-1, 2)
    return pa.table({"a": ab[:, 0], "b": ab[:, 1]})


def _sets(batches, size: int):
    """(nid, sig, text) become (nid, sig, set)."""
    for b in batches:
        arr = text_column(b, "text")
        for lo, hi in row_slices(arr):
            sets = [s.view(np.int64) for s in shingle_sets(arr.slice(lo, hi - lo), size)]
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(s) for s in sets])], pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), lists], ["nid", "sig", "set"])


def _node() -> Column:
    """The name of a text: equal texts are one node."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256), 1, 32))


def _components(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Rows (doc_id, node, n_shingles, component_id), one for each row of docs."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(slim.mapInArrow(lambda b: _signed(b, size), "doc_id long, node binary, n long, sig binary"), "signed")
    nodes = written(
        signed.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("sig").alias("sig"), F.first("n").alias("mass")).withColumn("nid", F.monotonically_increasing_id()),
        "nodes",
    )
    bands = nodes.select("nid", "sig").mapInArrow(_bucketed, "bucket long, nid long")
    shared = bands.groupBy("bucket").agg(F.min("nid").alias("lo"), F.max("nid").alias("hi")).where("lo < hi").select("bucket")
    members = written(bands.join(shared, "bucket", "left_semi"), "members")
    # signatures and whole sets of the nodes that share a bucket
    wanted = nodes.join(members.select("nid").distinct(), "nid", "left_semi")
    whole = slim.withColumn("node", _node()).join(wanted, "node").where(F.col("doc_id").eqNullSafe(F.col("least"))).dropDuplicates(["node"]).select("nid", "sig", "text")
    known = written(whole.mapInArrow(lambda b: _sets(b, size), "nid long, sig binary, set array<long>"), "known")

    def both_of(pairs: DataFrame, column: str) -> DataFrame:
        """The column of both ends, as x and y."""
        return pairs.join(known.select(F.col("nid").alias("a"), F.col(column).alias("x")), "a").join(known.select(F.col("nid").alias("b"), F.col(column).alias("y")), "b")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose signatures and then whole sets are similar enough."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        least = _least(percent)
        likely = both_of(pairs, "sig").select("a", "b", "x", "y").mapInArrow(lambda b: _estimated(b, least), "a long, b long")
        both = both_of(likely, "set").withColumn("common", F.size(F.array_intersect("x", "y")))
        return both.where(100 * F.col("common") >= percent * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b")

    # every member with the pivot of its bucket: most links' components come of it
    pivots = members.groupBy("bucket").agg(F.min_by("nid", F.struct(F.xxhash64("nid"), "nid")).alias("pivot"))
    comp = components(confirmed(members.join(pivots, "bucket").where("nid <> pivot").select(F.col("nid").alias("a"), F.col("pivot").alias("b"))))
    # then those members of a bucket that lie outside its largest component with the others: few pairs by a join, many in blocks
    placed = members.join(comp.select(F.col("node").alias("nid"), "component"), "nid", "left").select("bucket", "nid", F.coalesce("component", "nid").alias("comp")).join(nodes.select("nid", "mass"), "nid")
    groups = placed.groupBy("bucket", "comp").agg(F.count("*").alias("k"), F.sum("mass").alias("m"))
    mixed = groups.groupBy("bucket").agg(
        F.sum("k").alias("n"), F.sum("m").alias("m"), F.max(F.struct("k", "comp", "m")).alias("top"), (F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))).alias("twice"),
    ).where("twice > 0")
    parts = lambda n, m: F.greatest(F.ceil(n / BLOCK), F.ceil(m / MASS)).cast("int")
    mixed = mixed.select(
        "bucket", "twice", F.col("top.comp").alias("top"), parts(F.col("n"), F.col("m")).alias("blocks"), parts(F.col("n") - F.col("top.k"), F.col("m") - F.col("top.m")).alias("outer"),
    )
    placed = written(placed.join(mixed, "bucket"), "placed")
    few = placed.where(F.col("twice") <= 2 * SMALL).select("bucket", "nid", "comp")
    pairs = few.join(few.select("bucket", F.col("nid").alias("other"), F.col("comp").alias("comp2")), "bucket").where("comp < comp2").select(F.col("nid").alias("a"), F.col("other").alias("b"))
    many = placed.where(F.col("twice") > 2 * SMALL).withColumn("outside", F.col("comp") != F.col("top"))
    block = lambda n: F.pmod(F.xxhash64("nid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = many.where("outside").select("bucket", "nid", "comp", "outside", F.lit(0).alias("side"), block("outer").alias("i"), every("blocks").alias("j"))
    right = many.select("bucket", "nid", "comp", "outside", F.lit(1).alias("side"), every("outer").alias("i"), block("blocks").alias("j"))
    cells = left.unionByName(right).join(known, "nid").groupBy("bucket", "i", "j").applyInArrow(lambda t: _block(t, percent), "a long, b long")
    rest = written(confirmed(pairs).unionByName(cells), "rest")
    if not rest.isEmpty():
        comp = components(rest.unionByName(comp.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))))
    named = nodes.select("nid", "node", "least").join(comp.select(F.col("node").alias("nid"), "component"), "nid", "left").withColumn("component", F.coalesce("component", "nid"))
    named = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component_id")
    out = signed.select("doc_id", "node", F.col("n").alias("n_shingles")).join(named, "node", "left")
    return out.withColumn("component_id", F.coalesce("component_id", "doc_id"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of docs.

    Links: 100 * |A and B| >= percent * |A or B|. component_id is the smallest
    doc_id of the connected documents; kept marks doc_id = component_id.
    """
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return _components(docs, size, percent).select("doc_id", "n_shingles", "component_id", kept)


def dedup(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, without those whose text belongs to a smaller doc_id's component; rows of a null doc_id stay."""
    gone = _components(docs, size, percent).where("doc_id <> component_id").select("doc_id", "node").distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("keep"), F.col("doc_id").cast("long").alias("doc_id"), _node().alias("node"))
    return rows.join(gone, ["doc_id", "node"], "left_anti").select("keep.*")
