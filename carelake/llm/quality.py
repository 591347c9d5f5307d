"""Quality rules: document statistics as native expressions and a learned decision list over them.

The list is learned by sequential covering: a rule is grown, one threshold
condition at a time, by information gain on two thirds of the labelled rows that
pass the base rules, and pruned on the rest, any condition in turn; bounds on one
feature become one; rules that stay precise become, in order, the branches of one
conditional expression that names the first rule a document meets. Learning reads
a bounded sample of labelled documents (max_labels, the smallest by a hash of
doc_id); statistics and verdicts cover every document.

Cases: null text counts as empty (no words, base_failed); a null doc_id is judged
like any other; repeated rows are each judged; conflicting labels of a doc_id
count as the lower one, and of its texts one, by a hash, is learned from; without labels, or with one class only, the list is empty
and the base rules alone decide; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
MAX_LABELS = 20_000
#: A rule needs this share of low-quality rows among those it meets.
PRECISION = 0.97
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share")
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *FEATURES[1:])


def _count(chars: str) -> Column:
    return (F.length("text") - F.length(F.regexp_replace("text", chars, ""))).cast("long")


def _statistics(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns as the struct __keep, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the shares of FEATURES."""
    keep = ["__keep"]
    d = docs.select(F.struct(*columns).alias("__keep"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.select(
        *keep,
        F.transform(F.array_remove(F.split("text", SPACE + "+"), ""), lambda w: F.xxhash64(w)).alias("h"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.regexp_replace("text", SPACE + "+", "")).cast("long").alias("word_chars"),
        _count(r"[^#*$%&|<>]").alias("others"),
        F.length("text").alias("chars"),
        _count("[A-Z]").alias("n_upper"),
        _count("[!?]").alias("n_marks"),
    )
    d = d.select(
        *keep, "word_chars", "n_upper", "n_marks", "h",
        F.size("h").cast("long").alias("n_words"),
        (F.col("chars") - F.col("others")).cast("long").alias("n_symbols"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    three = F.transform(F.slice("h", F.lit(1), F.greatest(F.size("h") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("h", i + 1), F.get("h", i + 2)))
    d = d.withColumn("three", three).drop("h")
    # positions of equal windows meet when sorted; the words they cover are counted once
    d = d.withColumn("sorted", F.when(F.size(F.array_distinct("three")) < F.size("three"), F.sort_array(F.transform("three", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))).drop("three")
    same = lambda s, t: F.coalesce(s["x"] == t["x"], F.lit(False))
    twice = F.filter(F.transform("sorted", lambda s, k: F.when(same(s, F.get("sorted", k - 1)) | same(s, F.get("sorted", k + 1)), s["i"])), lambda i: i.isNotNull())
    d = d.withColumn("twice", F.sort_array(twice)).drop("sorted")
    d = d.withColumn("n_repeat_words", F.coalesce(F.aggregate(F.transform("twice", lambda i, k: F.least(F.coalesce(F.get("twice", k + 1) - i, F.lit(3)), F.lit(3)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop("twice")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return d.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("word_chars", "n_words").alias("mean_word"), share("n_symbols", "word_chars").alias("symbol_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("n_upper", "word_chars").alias("upper_share"), share("n_marks", "word_chars").alias("mark_share"),
    )


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns of keep with the statistics."""
    return _statistics(docs, *keep).select("__keep.*", *NAMES)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, above, threshold): value > threshold if above, else value <= threshold."""

    conditions: tuple[tuple[str, bool, float], ...]

    def expression(self) -> Column:
        tests = [F.col(f) > F.lit(t) if above else F.col(f) <= F.lit(t) for f, above, t in self.conditions]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    def __str__(self) -> str:
        return " and ".join(f"{f} {'>' if above else '<='} {t:.6g}" for f, above, t in self.conditions)

    def meets(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, t in self.conditions:
            v = x[:, FEATURES.index(f)]
            out &= v > t if above else v <= t
        return out


def _grow(x: np.ndarray, bad: np.ndarray, most: int) -> Rule:
    """Adds the condition of largest gain until only bad rows are met."""
    live, conditions = np.ones(len(x), bool), []
    while len(conditions) < most:
        p, n = int(bad[live].sum()), int((~bad[live]).sum())
        if not p or not n:
            break
        base, best = np.log2(p / (p + n)), (1e-9, None, None)
        for k, f in enumerate(FEATURES):
            v = x[live, k]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, 65)[:-1]))
            if len(cuts) < 2:
                continue
            order = np.argsort(v, kind="stable")
            up = np.searchsorted(v[order], cuts, "right")  # rows at or below each cut
            hit = np.r_[0, np.cumsum(bad[live][order])][up]
            for above, ps, all_ in ((False, hit, up), (True, p - hit, len(v) - up)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(ps > 0, ps * (np.log2(ps / np.maximum(all_, 1)) - base), -1)
                j = int(np.argmax(gain))
                if gain[j] > best[0]:
                    best = (gain[j], (f, above, float(cuts[j])), None)
        if best[1] is None:
            break
        conditions.append(best[1])
        live &= Rule((best[1],)).meets(x)
    return Rule(tuple(conditions))


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    met = rule.meets(x)
    p, n = int(bad[met].sum()), int((~bad[met]).sum())
    return (p - n) / (p + n) if p + n else -1.0


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """Drops the condition whose loss does most good, or no harm, as long as there is one; then joins bounds on a feature."""
    worth = _worth(rule, x, bad)
    while len(rule.conditions) > 1:
        shorter = [Rule(rule.conditions[:k] + rule.conditions[k + 1 :]) for k in range(len(rule.conditions))]
        best = max(shorter, key=lambda r: _worth(r, x, bad))
        if _worth(best, x, bad) < worth:
            break
        rule, worth = best, _worth(best, x, bad)
    bounds: dict[tuple[str, bool], float] = {}
    for f, above, t in rule.conditions:
        bounds[f, above] = t if (f, above) not in bounds else (max if above else min)(t, bounds[f, above])
    return Rule(tuple((f, above, t) for (f, above), t in bounds.items()))


def learn(x: np.ndarray, bad: np.ndarray, most_rules: int = 12, most_conditions: int = 4, precision: float = PRECISION) -> list[Rule]:
    """An ordered decision list from rows of FEATURES and their low-quality marks."""
    rules: list[Rule] = []
    third = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    least = max(3, int(0.002 * len(x)))
    while len(rules) < most_rules and bad[left].sum() >= least:
        rule = _grow(x[left & ~third], bad[left & ~third], most_conditions)
        at = _prune(rule, x[left & third], bad[left & third])
        met = at.meets(x) & left if at.conditions else np.zeros(len(x), bool)
        if met.sum() < least or bad[met].mean() < precision:
            break
        rules.append(at)
        left &= ~met
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> list[Rule]:
    """The decision list for docs (doc_id, text) from labels (doc_id, quality)."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(max_labels)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), F.col("text"))
    got = statistics(texts.join(F.broadcast(known), "id"), "id", "quality", "h")  # max_labels rows at most
    one = got.groupBy("id", "quality").agg(F.min(F.struct("h", failed().alias("failed"), *FEATURES)).alias("x"))
    rows = one.select("id", "quality", "x.failed", *[f"x.{f}" for f in FEATURES]).collect()
    rows = sorted(tuple(r) for r in rows if not r["failed"])  # not by a filter, which would be pushed into the statistics and multiply them
    x = np.array([[float(v) for v in r[3:]] for r in rows]).reshape(len(rows), len(FEATURES))
    return learn(x, np.array([r[1] == 0 for r in rows], bool))


def failed() -> Column:
    """The base rules, over statistics()."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """The first rule that a row of statistics() meets, as text; null if none."""
    if not rules:
        return F.lit(None).cast("string")
    out = F.when(rules[0].expression(), F.lit(str(rules[0])))
    for r in rules[1:]:
        out = out.when(r.expression(), F.lit(str(r)))
    return out


def _judged(docs: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
    rules = fit(docs, labels)
    d = _statistics(docs, *columns).withColumns({"base_failed": failed(), "rule": verdict(rules)})
    return d.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def judge(docs: DataFrame, labels: DataFrame, *keep: str) -> DataFrame:
    """For each document the columns of keep, the statistics, base_failed, rule (the first met, else null) and kept."""
    return _judged(docs, labels, *keep).select("__keep.*", *NAMES, "base_failed", "rule", "kept")


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, that are kept."""
    # a column that must not be computed twice keeps the filter from being pushed into, and multiplying, the statistics
    return _judged(docs, labels, *docs.columns).withColumn("__row", F.monotonically_increasing_id()).where("kept and __row >= 0").select("__keep.*")
