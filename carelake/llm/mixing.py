"""Mixing sources to target weights: hierarchical budgets and seeded token-prefixes.

A tree of domain, language and source carries weights. A total of tokens flows
down it by the weights; what a leaf can't supply (its tokens times max_epochs) goes
to its siblings by their weights, and only what no sibling can take goes up to
the ancestors' siblings. A leaf's budget is met by whole epochs and then by a
prefix of the documents in an order seeded for that epoch: a document is taken
while the tokens before it in this order are below the budget.

The order is by a hash, whose leading bits cut each leaf into slices. Slices are
summed first; only the slice in which the budget ends is ordered row by row, so a
leaf of any size is never gathered in one task.

Cases: null text has no tokens; null languages and sources are leaves of their
own; documents without tokens are never taken; ties of the hash are broken by
doc_id and text, repeated rows are interchangeable; a leaf of weight zero takes
part only if named so and then gets nothing; an empty table gives an empty
result; other columns pass through take() and are never read otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Leaves at most; their budgets are computed on the driver and sent to the executors.
MAX_LEAVES = 100_000
SLICES = 1 << 16


def share_out(total: float, weights: Mapping[str, float], room: Mapping[str, float]) -> dict[str, float]:
    """Deals total by weights; what is beyond one's room goes to the others by their weights."""
    got, open_ = dict.fromkeys(weights, 0.0), {k for k in weights if weights[k] > 0 and room[k] > 0}
    left = min(total, sum(room[k] for k in open_))
    while open_ and left > 1e-9:
        whole = sum(weights[k] for k in open_)
        full = {k for k in open_ if left * weights[k] / whole >= room[k] - got[k]}
        if not full:
            for k in open_:
                got[k] += left * weights[k] / whole
            break
        for k in full:
            left -= room[k] - got[k]
            got[k] = room[k]
        open_ -= full
    return got


def budgets(total: float, leaves: Mapping[tuple, float], weight) -> dict[tuple, float]:
    """Tokens for each leaf (a path); leaves has what each can supply, weight(path) a node's weight among its siblings."""

    def down(prefix: tuple, amount: float, below: list[tuple]) -> dict[tuple, float]:
        depth = len(prefix) + 1
        if depth > len(below[0]):
            return {below[0]: amount}
        kids: dict[tuple, list[tuple]] = {}
        for leaf in below:
            kids.setdefault(leaf[:depth], []).append(leaf)
        room = {k: room_of(k, v) for k, v in kids.items()}
        out = {}
        for k, part in share_out(amount, {k: weight(k) for k in kids}, room).items():
            out |= down(k, part, kids[k])
        return out

    def room_of(node: tuple, below: list[tuple]) -> float:
        """What the node's subtree can take: nothing under a weight of zero."""
        return sum(leaves[x] for x in below if all(weight(x[:d]) > 0 for d in range(len(node) + 1, len(x) + 1)))

    return down((), total, sorted(leaves, key=str)) if leaves else {}


def tokens() -> Column:
    """Words of the text."""
    return F.size(F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def domain() -> Column:
    """A document's domain by its source: the number at its end, modulo three; sources without one are other."""
    number = F.regexp_extract(F.coalesce(F.col("source").cast("string"), F.lit("")), r"(\d{1,15})$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("code")), (number.try_cast("long") % 3 + 1).cast("int")))


#: Default weights among siblings, by a node's last part or whole path; others have weight 1.
WEIGHTS: dict = {"web": 5.0, "books": 3.0, "code": 2.0, "en": 6.0, "de": 2.0, "fr": 2.0, "es": 1.0}


def _planned(docs: DataFrame, *keep: str, weights: Mapping | None = None, fraction: float = 0.7, max_epochs: int = 1, seed: int = 17) -> DataFrame:
    """Rows of docs: __keep (a struct of the columns of keep), domain, lang, source, n_tokens, copies: how often each is taken, 0 included.

    The total is fraction times all tokens of docs; fraction may exceed 1 where
    max_epochs does. A leaf's prefix is kept as the last place in its order that
    is taken, so that the decision on a row needs no join with other rows.
    """
    weights = WEIGHTS if weights is None else weights
    weight = lambda path: float(weights.get(path, weights.get(path[-1], 1.0)))
    path = ["domain", "__lang", "__source"]
    leaf = [domain().alias("domain"), F.col("lang").cast("string").alias("__lang"), F.col("source").cast("string").alias("__source")]
    place = lambda epoch, id_, text: F.struct(F.xxhash64(F.lit(seed), epoch, id_, text).alias("o"), id_.alias("i"), text.alias("t"))
    slim = written(docs.select(*leaf, tokens().alias("n"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text")), "leaves")
    sums = slim.groupBy(*path).agg(F.sum("n").alias("n")).limit(MAX_LEAVES + 1).collect()
    if len(sums) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    have = {tuple(r[:3]): int(r[3]) for r in sums}
    named = {k: v for k, v in have.items() if v}
    dealt = budgets(fraction * sum(named.values()), {k: v * max_epochs for k, v in named.items()}, weight)
    rows = [(*k, n, int(dealt.get(k, 0.0) // v) if v else 0, float(dealt.get(k, 0.0) % v) if v else 0.0) for n, (k, v) in enumerate(have.items())]
    # one row for each leaf, MAX_LEAVES at most; so are those of ends and cuts
    leaves = docs.sparkSession.createDataFrame(rows, "domain string, __lang string, __source string, __leaf int, __epochs int, __rest double")
    same = lambda d, p: d["domain"].eqNullSafe(p["domain"]) & d["__lang"].eqNullSafe(p["__lang"]) & d["__source"].eqNullSafe(p["__source"])

    partly = F.broadcast(leaves.where("__rest > 0"))
    placed = slim.join(partly, same(slim, partly)).select("__leaf", "__rest", "n", place(F.col("__epochs"), F.col("id"), F.col("text")).alias("place"))
    placed = placed.withColumn("slice", F.shiftright("place.o", 48).cast("int"))
    slices = placed.groupBy("__leaf", "slice").agg(F.sum("n").alias("s"), F.first("__rest").alias("rest"))  # SLICES rows a leaf at most
    slices = slices.withColumn("upto", F.sum("s").over(Window.partitionBy("__leaf").orderBy("slice")))
    ends = slices.where("upto >= rest and upto - s < rest").groupBy("__leaf").agg(F.min("slice").alias("slice"), F.min_by(F.col("rest") - F.col("upto") + F.col("s"), "slice").alias("last"))
    inner = placed.drop("__rest").join(F.broadcast(ends), ["__leaf", "slice"])
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = inner.withColumn("before", before).where("before < last").groupBy("__leaf").agg(F.max("place").alias("__cut"))
    marks = F.broadcast(leaves.join(F.broadcast(cuts), "__leaf", "left"))

    d = docs.select(F.struct(*keep).alias("__keep") if keep else F.lit(None).alias("__keep"), *[c.alias(f"__{k}") for k, c in enumerate(leaf)], tokens().alias("__n"), F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__text"))
    marks = marks.select(*[F.col(c).alias(f"__m{k}") for k, c in enumerate(path)], F.col("__epochs"), "__cut")
    d = d.join(marks, F.col("__0").eqNullSafe(F.col("__m0")) & F.col("__1").eqNullSafe(F.col("__m1")) & F.col("__2").eqNullSafe(F.col("__m2")), "left")
    taken = F.coalesce(place(F.col("__epochs"), F.col("__id"), F.col("__text")) <= F.col("__cut"), F.lit(False)).cast("int")
    copies = F.when(F.col("__n") == 0, F.lit(0)).otherwise(F.col("__epochs") + taken)
    return d.select("__keep", F.col("__0").alias("domain"), F.col("__1").alias("lang"), F.col("__2").alias("source"), F.col("__n").alias("n_tokens"), copies.cast("int").alias("copies"))


def plan(docs: DataFrame, *keep: str, **options) -> DataFrame:
    """The columns of keep with domain, lang, source, n_tokens and copies."""
    d = _planned(docs, *keep, **options)
    return d.select("__keep.*", *d.columns[1:]) if keep else d.drop("__keep")


def take(docs: DataFrame, **options) -> DataFrame:
    """The documents taken, all columns, each as often as its copies."""
    d = _planned(docs, *docs.columns, **options).where("copies > 0")
    return d.select("__keep", F.explode(F.sequence(F.lit(1), "copies"))).select("__keep.*")
