"""URL filters: a Bloom filter cascade over the corpus's complete universe of keys.

A url's keys are the pairs of a suffix of its host (at label bounds) and a prefix
of its path, of the lengths that rules have. The first level encodes the listed
keys, the second the keys of the corpus that pass the first though not listed,
the third the listed ones that pass the second, and so on until a level errs on
no key of the universe. The first level that lacks a key then decides it exactly,
so that judging the corpus needs no join. A level is an array of 64-bit words in
the plan; its size follows from the number of listed keys, which is checked.

Cases: a null url or one without ``://`` has an empty host and path, no rule and
the verdict allow; repeated rows are each judged; an empty table gives an empty
result; an empty rule list allows everything; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: Listed keys at most; the first level takes about 30 bits for each.
MAX_RULES = 1_000_000


class Level(NamedTuple):
    words: list[int]
    hashes: int


def _bits(key: Column, level: int, size: int, hashes: int) -> list[Column]:
    h = F.xxhash64(key, F.lit(level))
    a, b = h.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(h, 32)  # sums stay far from overflow
    return [F.pmod(a + F.lit(k) * b, F.lit(size).cast("long")) for k in range(hashes)]


def _has(key: Column, n: int, level: Level) -> Column:
    words, out = F.split(F.lit(",".join(map(str, level.words))), ",").cast("array<bigint>"), F.lit(True)  # folded to a constant
    for p in _bits(key, n, 64 * len(level.words), level.hashes):
        out = out & (F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1)
    return out


def member(key: Column, levels: Sequence[Level]) -> Column:
    """Whether a key of the universe is listed."""
    out = F.lit(False)
    for n in reversed(range(len(levels))):
        out = _has(key, n, levels[n]) & (~out if n + 1 < len(levels) else F.lit(True))
    return out if levels else F.lit(False)


def _level(keys: DataFrame, n: int, count: int, rate: float) -> Level:
    """A filter of df(key) with the given rate of false positives."""
    hashes = max(1, round(-math.log2(rate)))
    size = max(1, math.ceil(count * hashes / math.log(2) / 64))
    at = keys.select(F.explode(F.array(*_bits(F.col("key"), n, 64 * size, hashes))).alias("p"))
    at = at.groupBy(F.shiftright("p", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(pmod(p, 64)))")).alias("mask"))
    words = [0] * size
    for r in at.collect():  # size rows at most
        words[r[0]] = r[1]
    return Level(words, hashes)


def cascade(universe: DataFrame, listed: Sequence[str]) -> list[Level]:
    """The levels for df(key), keys once or more, and the listed keys."""
    if len(set(listed)) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} listed keys")
    if not listed:
        return []
    spark = universe.sparkSession
    inside = spark.createDataFrame([(k,) for k in sorted(set(listed))], "key string")
    count = len(set(listed))
    others = max(1, universe.agg(F.approx_count_distinct("key")).first()[0])
    levels = [_level(inside, 0, count, min(0.5, max(2.0**-40, count / math.sqrt(2) / others)))]
    # of the corpus's keys only those that pass the first level are ever gathered: in number like the listed ones
    passed = universe.where(_has(F.col("key"), 0, levels[0])).groupBy("key").agg(F.lit(False).alias("listed"))
    outside = written(passed.unionByName(inside.withColumn("listed", F.lit(True))).groupBy("key").agg(F.max("listed").alias("listed")).where("not listed").select("key"), "outside")
    true, false = inside, outside
    while count_false := false.count():
        levels.append(_level(false, len(levels), count_false, 0.5))
        true, false = false, true.where(_has(F.col("key"), len(levels) - 1, levels[-1]))
    return levels


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"(?s)^[^?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.coalesce(path, F.lit(""))


def _keys(rules: Sequence[Rule]) -> Column:
    """Candidate keys of columns host and path, longest first."""
    most = max((r.host.count(".") for r in rules), default=0) + 1
    labels = F.split("host", r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(most))), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    ends = F.array(*[F.lit(x) for x in sorted({len(r.path) for r in rules})]) if rules else F.array(F.lit(0))
    fit = F.filter(ends, lambda k: k <= F.length("path"))
    both = F.flatten(F.transform(suffixes, lambda s: F.transform(fit, lambda k: F.struct((F.length(s) + k).alias("size"), F.length(s).alias("host"), F.concat(s, F.substr("path", F.lit(1), k)).alias("key")))))
    return F.when((F.col("host") != "") & F.lit(bool(rules)), F.transform(F.sort_array(both, asc=False), lambda x: x["key"])).otherwise(F.array().cast("array<string>"))


def judge(pages: DataFrame, rules: Sequence[Rule], *keep: str, url: str = "url") -> DataFrame:
    """The columns of keep with host, path, rule (host and path, or null) and verdict (the rule's, else allow)."""
    host, path = parts(F.col(url).cast("string"))
    d = pages.select(*keep, host.alias("host"), path.alias("path")).withColumn("keys", _keys(rules))
    universe = d.select(F.explode("keys").alias("key"))
    levels = {v: cascade(universe, [r.host + r.path for r in rules if r.verdict == v]) for v in ("allow", "block")}
    first = lambda v: F.get(F.filter("keys", lambda k: member(k, levels[v])), F.lit(0))
    d = d.withColumns({"allowed": first("allow"), "blocked": first("block")})
    # the longer key wins; of equal ones the blocking
    blocks = F.col("blocked").isNotNull() & (F.col("allowed").isNull() | (F.length("blocked") >= F.length("allowed")))
    return d.select(*keep, "host", "path", F.when(blocks, F.col("blocked")).otherwise(F.col("allowed")).alias("rule"), F.when(blocks, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))
