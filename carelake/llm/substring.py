"""Substring dedup with fixed-block anchors.

Every text is cut into non-overlapping reference blocks of half the window; each
window that repeats holds one whole block of the other copy, so probing the block
index with every rolling window of all texts misses no repeat. Hits are extended
to all windows around them, whose owners are compared by the smallest doc_id;
neighbouring repeated windows join to maximal exact repeats (spans of words).

A text that equals an earlier document's whole text is a repeat from its first to
its last word; such copies are found by hash groups first and enter no index.

The index is dealt by ranges of the hash: a task holds the blocks of a range, and
the rolling windows of that range stream past it, packed to four bytes each. Every
text is scanned twice, however many there are. False hits of the short codes, and
of the filter in which the hits go back to the texts, only cost shuffling: windows
are compared by 128 bits.

Cases: null and empty texts and those shorter than a window keep all words; rows
with a null doc_id are neither judged nor earlier copies; rows that repeat a
doc_id are judged each on its own text, by smaller ids only; an empty table gives
an empty result. Other columns are never read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, row_slices, text_column, written
from .wordhash import U, mix, windows, words

#: Cells of a filter at most (64 MB of 64-bit cells); a filter is as big as what it holds needs.
MAX_CELLS = 1 << 23
_CELL_BITS = 4
#: Rolling windows of a range of the index, about; windows that a task packs at once, more where there are many ranges.
RANGE, PACK = 1 << 21, 1 << 19
#: A window that more than one in HOT of all rows have is compared apart: there are fewer than HOT such windows.
HOT = 1000
#: End of a copy's span: its last word, wherever that is.
TO_END = (1 << 31) - 1


def _cells(h: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each hash and its bits within the cell."""
    mask = np.zeros(len(h), U)
    for k in range(_CELL_BITS):
        mask |= U(1) << ((h >> U(6 * k)) & U(63))
    return ((h >> U(32)) & U(cells - 1)).astype(np.int32), mask


def _names(name: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Which 64-bit names a filter may hold."""
    cell, mask = _cells(name.view(U), len(have))
    return have[cell] & mask == mask


def _named(df: DataFrame):
    """A broadcast filter of df(name long) as big as its rows need, up to MAX_CELLS."""
    n, cells = df.count(), 1 << 10
    while cells < MAX_CELLS and cells * 3 < n:
        cells *= 2

    def masks(batches):
        for b in batches:
            cell, mask = _cells(b.column(0).to_numpy().view(U), cells)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(mask.view(np.int64))], ["cell", "mask"])

    got = df.mapInArrow(masks, "cell int, mask long").groupBy("cell").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(cells, U)
    if got.num_rows:
        out[got.column("cell").to_numpy()] = got.column("mask").to_numpy().view(U)
    return df.sparkSession.sparkContext.broadcast(out.tobytes())


def _rolling(batch: pa.RecordBatch, width: int) -> Iterator[tuple]:
    """For slices of the batch: first row, words, hashes of blocks, first words of these, row of each."""
    arr = text_column(batch, "text")
    for lo, hi in row_slices(arr):
        w = words(arr.slice(lo, hi - lo))
        h, at = windows(w.hashes, w.first, width)
        row = np.searchsorted(w.first, at, "right") - 1
        yield lo, w, h, at, row
    release()


def _code(h: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The range of each hash (ascending with it) and its code within."""
    return ((h >> U(48)) * U(ranges)) >> U(16), (h >> U(16)).astype(np.uint32)


def _hit_name(part: np.ndarray, code: np.ndarray) -> np.ndarray:
    return mix((part.astype(U) << U(32)) | code.astype(U))


def _packed(batches, block: int, ranges: int):
    """Rows (part, own, codes): blocks (own 1, each twice at most) and other rolling windows (own 0, once) by range."""

    def flush(held: list[list[np.ndarray]]):
        for own in (0, 1):
            h, n = np.unique(np.concatenate(held[own]), return_counts=True) if held[own] else (np.zeros(0, U), np.zeros(0, np.int64))
            h = np.repeat(h, np.minimum(n, 2)) if own else h
            part, code = _code(h, ranges)
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(h) else np.zeros(0, np.int64)
            codes = [code[a:b].tobytes() for a, b in zip(cut, np.r_[cut[1:], len(h)])]
            yield pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int32)), pa.array(np.full(len(cut), own, np.int32)), pa.array(codes, pa.binary())], ["part", "own", "codes"])
            held[own].clear()

    held: list[list[np.ndarray]] = [[], []]
    size = 0
    for b in batches:
        for _, w, h, at, row in _rolling(b, block):
            own = (at - w.first[row]) % block == 0
            # what a text repeats of itself is no repeat: each of its blocks once, and no window that equals one of them
            name = mix(h ^ (row.astype(U) * U(0x9E3779B97F4A7C15)))
            mine, first = np.unique(name[own], return_index=True)
            held[0].append(h[~own & ~np.isin(name, mine)])
            held[1].append(h[own][first])
            size += len(h)
            if size >= max(PACK, 32 * ranges):
                yield from flush(held)
                size = 0
    yield from flush(held)


def _matched(batches):
    """Rows sorted by range, blocks first, become the names of the blocks that are met again."""
    now, blocks, codes, twice = None, [], None, None

    def settled() -> tuple[np.ndarray, np.ndarray]:
        codes, n = np.unique(np.concatenate(blocks), return_counts=True) if blocks else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        return codes, n > 1

    def met(part: int, codes: np.ndarray, twice: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array(_hit_name(np.full(int(twice.sum()), part), codes[twice]).view(np.int64))], ["name"])

    for b in batches:
        for part, own, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if part != now:
                if now is not None:
                    yield met(now, *((codes, twice) if codes is not None else settled()))
                now, blocks, codes = part, [], None
            got = np.frombuffer(raw.as_buffer(), np.uint32)
            if own:
                blocks.append(got)
                continue
            if codes is None:
                codes, twice = settled()
                blocks = []
            if len(codes):
                at = np.minimum(np.searchsorted(codes, got), len(codes) - 1)
                twice[at[codes[at] == got]] = True
    if now is not None:
        yield met(now, *((codes, twice) if codes is not None else settled()))


def repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """Maximal exact repeats: rows (doc_id, key, spans array<struct<begin,end>>) of documents that have any.

    key is the text's xxhash64, which tells apart rows that share a doc_id; the span
    of a copy of a whole earlier text ends at TO_END.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    spark, block = docs.sparkSession, window // 2
    # a window has a character and a space for each word
    src = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") >= 2 * window - 1).withColumn("key", F.xxhash64("text"))
    # copies of whole texts, by two independent hashes
    slim = src.select("doc_id", "key", F.xxhash64(F.lit(1), "text").alias("other"))
    least = slim.groupBy("key", "other").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    copies = written(slim.join(least, ["key", "other"]).where("doc_id > least").select("doc_id", "key").distinct(), "copies")
    fresh = written(src.join(copies, ["doc_id", "key"], "left_anti").select("doc_id", "key", "text"), "fresh")
    size = fresh.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = int(min(1 << 16, max(1, size // (6 * RANGE))))
    packed = fresh.select("text").mapInArrow(lambda b: _packed(b, block, ranges), "part int, own int, codes binary")
    tasks = int(min(ranges, max(4096, spark.sparkContext.defaultParallelism)))
    hits = written(packed.repartition(tasks, "part").sortWithinPartitions("part", F.desc("own")).mapInArrow(_matched, "name long"), "hits")
    repeated = _named(hits)

    def extend(batches):
        have = np.frombuffer(repeated.value, U)
        for b in batches:
            ids, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
            for lo, w, h, at, row in _rolling(b, block):
                hit = _names(_hit_name(*_code(h, ranges)), have)
                size = len(w.hashes) + 1
                # windows that hold a hit block; one of the document's own blocks is among the hits of a repeat
                own = hit & ((at - w.first[row]) % block == 0)
                live = [np.bincount(np.maximum(x - (window - block), 0), minlength=size) - np.bincount(x + 1, minlength=size) for x in (at[hit], at[own])]
                long, begin = windows(w.hashes, w.first, window)
                keep = (np.cumsum(live[0])[begin] > 0) & (np.cumsum(live[1])[begin] > 0)
                other, _ = windows(w.hashes, w.first, window, salt=0x6A09E667F3BCC908) if keep.any() else (long, begin)
                row = np.searchsorted(w.first, begin[keep], "right") - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(long[keep].view(np.int64)), pa.array(other[keep].view(np.int64)), pa.array(ids[row + lo]), pa.array(keys[row + lo]), pa.array((begin[keep] - w.first[row]).astype(np.int32)),
                ], ["h", "g", "doc_id", "key", "at"])

    wide = written(fresh.mapInArrow(extend, "h long, g long, doc_id long, key long, at int"), "windows")
    repeated.unpersist()
    first = wide.groupBy("h", "g").agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest"), F.count("*").alias("n")).where("earliest < latest").select("h", "g", "earliest", "n")
    first = written(first, "first")
    many = wide.count() // HOT
    common, rest = F.broadcast(first.where(F.col("n") > many)), first.where(F.col("n") <= many)  # fewer than HOT rows are common
    both = wide.join(common, ["h", "g"]).unionByName(wide.join(common, ["h", "g"], "left_anti").join(rest, ["h", "g"]))
    later = both.where("doc_id > earliest").groupBy("doc_id", "key").agg(F.collect_set("at").alias("at"))

    def joined(batches):
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            spans = []
            for at in b.column(2):
                a = np.sort(at.values.to_numpy())
                cut = np.flatnonzero(np.diff(a) > 1)
                begins, ends = a[np.r_[0, cut + 1]], a[np.r_[cut, len(a) - 1]] + window
                spans.append([{"begin": int(x), "end": int(y)} for x, y in zip(begins, ends)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, kind)], ["doc_id", "key", "spans"])

    spans = later.mapInArrow(joined, "doc_id long, key long, spans array<struct<begin:int,end:int>>")
    return spans.unionByName(copies.select("doc_id", "key", F.expr(f"array(named_struct('begin', 0, 'end', {TO_END}))").alias("spans")))


def _cut(batches, full: bool, window: int):
    """Rows (keep, doc_id, text, spans) without the words in the spans.

    full: (keep, text), the text with its own spacing where nothing goes; else counts and a digest.
    """
    for b in batches:
        arr, spans = text_column(b, "text"), b.column(3)
        n_words, n_removed, out = [], [], []
        for text, span in zip(arr, spans):
            data = text.as_buffer().to_pybytes()
            w = data.split()
            gone = np.zeros(len(w), bool)
            for s in (span.as_py() or ()) if len(w) >= window else ():
                gone[s["begin"] : s["end"]] = True
            k = int(gone.sum())
            n_words.append(len(w))
            n_removed.append(k)
            kept = b" ".join(x for x, g in zip(w, gone) if not g) if k else b" ".join(w)
            out.append((kept if k else data).decode() if full else hashlib.sha256(kept).hexdigest())
        if full:
            new = pc.if_else(b.column(2).is_null(), pa.scalar(None, pa.string()), pa.array(out, pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), new], ["keep", "text"])
        else:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out)], ["doc_id", "n_words", "n_removed", "kept_sha256"])
        del arr, out
        release()


def _apply(docs: DataFrame, window: int, full: bool) -> DataFrame:
    """Joins the spans to the documents that have any; a filter of these spares the others' texts the shuffle."""
    found = written(repeats(docs, window), "repeats")
    index = _named(found.select(F.xxhash64("doc_id", "key").alias("name")))
    others = [docs[c] for c in docs.columns if c != "text"] if full else []
    keep = F.struct(*others) if others else F.struct(F.lit(None).cast("string").alias("none"))
    rows = docs.select(keep.alias("keep"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text")).withColumn("name", F.xxhash64("doc_id", "key"))
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    schema = rows.select("keep", "text").schema if full else "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def side(batches, maybe: bool):
        have = np.frombuffer(index.value, U)
        for b in batches:
            hit = _names(b.column(4).to_numpy(), have) == maybe
            for lo, hi in row_slices(text_column(b, "text"), 1 << 20):
                if hit[lo:hi].any():
                    yield b.slice(lo, hi - lo).filter(pa.array(hit[lo:hi]))
        release()

    def without(batches):
        """Documents that have no spans for certain, in the same pass that tells them apart."""
        for b in side(batches, False):
            yield from _cut([pa.RecordBatch.from_arrays([*b.columns[:3], pa.nulls(b.num_rows, kind)], ["keep", "doc_id", "text", "spans"])], full, window)

    free = rows.mapInArrow(without, schema)
    held = rows.mapInArrow(lambda b: side(b, True), rows.schema).join(found, ["doc_id", "key"], "left").select("keep", "doc_id", "text", "spans")
    return free.unionByName(held.mapInArrow(lambda b: _cut(b, full, window), schema))


def digest(docs: DataFrame, window: int = 50) -> DataFrame:
    """For each document: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space)."""
    return _apply(docs.select("doc_id", "text"), window, False)


def strip(docs: DataFrame, window: int = 50) -> DataFrame:
    """The documents, all columns, without the words of earlier documents' passages; texts that lose none are unchanged."""
    return _apply(docs, window, True).select(*[F.col("text") if c == "text" else F.col(f"keep.`{c}`") for c in docs.columns])
