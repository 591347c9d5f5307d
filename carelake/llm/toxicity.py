"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Words are runs of letters, digits and the signs that stand in for letters. The
features of a text are densities of a lexicon (a hand-written seed, and words
found in far more toxic than other labelled documents), how near such words stand
to second-person words, shares of capitals and punctuation, and rates of
obfuscated words (those that only match once stand-ins are read as letters).

Learning reads a bounded sample of labelled documents (max_labels, the smallest
by a hash of doc_id) in FOLDS parts: a labelled row's features come of a lexicon of
the other parts' words, and its margin, by which the scores are calibrated, of trees
grown on the other parts. Scores cover every document.

Cases: null and empty texts get the score of a text without words; a null doc_id
is scored like any other; conflicting labels of a doc_id count as the higher one,
and of its texts one, by a hash, is learned from;
without labels of both classes every score is the mean label, or 0; repeated rows
are each scored; an empty table gives an empty result; columns other than doc_id
and text are never read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_slices, text_column, written
from .wordhash import U, Words, mix, powers

MAX_LABELS = 20_000
MAX_LEXICON = 400
FOLDS = 3

#: The seed lexicon and second-person words of four languages.
SEED = ("idiot", "moron", "stupid", "loser", "trash", "pathetic", "disgusting", "worthless", "clown", "dumb", "scum", "garbage", "shut", "hate", "ugly", "filthy", "imbecile", "fool", "jerk", "creep", "dumm", "idiota", "imbécil", "estúpido", "basura", "asqueroso", "stupide", "imbécile", "nul", "dégoûtant", "ordure", "abruti", "trottel", "dummkopf", "abschaum", "ekelhaft", "wertlos", "versager")
PERSON = ("you", "your", "yours", "you're", "u", "ur", "tu", "te", "toi", "ton", "vous", "votre", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tú", "ti", "usted", "ustedes", "vosotros", "su")
#: Signs read as letters.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""}

_WORD = np.zeros(256, bool)
_WORD[np.r_[48:58, 65:91, 97:123, 128:256]] = True
_WORD[[ord(c) for c in "@$*'"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[np.r_[65:91, 97:123, 128:256]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in STANDS_FOR]] = True

FEATURES = ("n_words", "hits", "hit_density", "weight", "weight_density", "near_person", "person_density", "hidden", "hidden_density", "mixed_density", "capitals", "shouted", "marks", "seed_hits", "best_weight")


def _values(read: bool) -> np.ndarray:
    of = np.arange(256)
    of = np.where((of >= 65) & (of <= 90), of + 32, of)
    if read:
        for a, b in STANDS_FOR.items():
            of[ord(a)] = ord(b) if b else 0
    v = mix(of.astype(U) * U(0xD1342543DE82EF95) + U(0x2545F4914F6CDD1D))
    v[of == 0] = 0
    return v


_PLAIN, _READ = _values(False), _values(True)


def _tokens(arr: pa.StringArray) -> tuple[Words, np.ndarray]:
    """Words of a text column under their plain hashes, and hashes with signs read as letters (without regard to dropped signs' places)."""
    n = len(arr)
    off = np.frombuffer(arr.buffers()[1], np.int32, n + 1, arr.offset * 4).astype(np.int64)
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and len(raw) else np.zeros(0, np.uint8)
    off = off - off[0]
    if not len(data):
        return Words(np.zeros(0, U), off[:0], off[:0], np.zeros(n + 1, np.int64), data), np.zeros(0, U)
    solid = _WORD[data]
    begin, finish = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    finish[:-1] &= ~solid[1:]
    edge = off[(off > 0) & (off < len(data))]
    begin[edge] = solid[edge]
    finish[edge - 1] = solid[edge - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    # dropped signs take no place, so that s*tupid reads as stupid with a sign less
    step = np.where(_READ[data] == 0, 0, 1)
    place = np.cumsum(step) - step
    sums = []
    for values, at in ((_PLAIN, None), (_READ, place)):
        total = np.zeros(len(data) + 1, U)
        p, q = powers(len(data)), powers(len(data), True)
        np.cumsum(values[data] * (p if at is None else p[at]), out=total[1:])
        s = starts if at is None else at[starts]
        sums.append(mix((total[ends] - total[starts]) * q[s]))
    return Words(sums[0], starts, ends, np.searchsorted(starts, off), data), sums[1]


def word_hash(words: tuple[str, ...] | list[str]) -> np.ndarray:
    return np.array([_tokens(pa.array([w]))[0].hashes[0] for w in words], U)


@dataclass
class Model:
    lexicon: np.ndarray  # sorted word hashes
    weights: np.ndarray
    trees: list[tuple] = field(default_factory=list)
    start: float = 0.0
    steps: tuple[np.ndarray, np.ndarray] | None = None  # isotonic: margins and probabilities
    mean: float = 0.0

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for t in self.trees:
            out += _apply(t, x)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.steps is None:
            return np.full(len(x), self.mean)
        return np.clip(np.interp(self.margins(x), *self.steps), 0.0, 1.0)


def features(arr: pa.StringArray, lexicon: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """FEATURES of each text; per text, sums are taken over runs of words or bytes."""
    w, read = _tokens(arr)
    n, k = len(arr), len(w.hashes)
    off = np.frombuffer(arr.buffers()[1], np.int32, n + 1, arr.offset * 4).astype(np.int64)
    off = off - off[0]

    def per_text(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(x)][bounds])

    def find(h):
        at = np.minimum(np.searchsorted(lexicon, h), max(len(lexicon) - 1, 0))
        return np.where(lexicon[at] == h, weights[at], 0.0) if len(lexicon) else np.zeros(len(h))

    plain, hidden = find(w.hashes), find(read)
    value = np.maximum(plain, hidden)
    hit = value > 0
    veiled = (hidden > 0) & (plain == 0)
    person = np.isin(w.hashes, _PERSON_HASHES)
    near = np.zeros(k, bool)
    row = np.repeat(np.arange(n), np.diff(w.first))
    at = np.flatnonzero(hit)
    for d in range(-4, 5):
        j = at + d
        ok = (j >= 0) & (j < k)
        ok[ok] &= row[j[ok]] == row[at[ok]]
        near[at[ok]] |= person[j[ok]]
    data = w.data
    letters, signs = np.r_[0, np.cumsum(_LETTER[data])], np.r_[0, np.cumsum(_SIGN[data])]
    upper = np.r_[0, np.cumsum((data >= 65) & (data <= 90))]
    many = letters[w.ends] - letters[w.starts]
    mixed = (many > 0) & (signs[w.ends] - signs[w.starts] > 0)
    shouted = (upper[w.ends] - upper[w.starts] == w.ends - w.starts) & (w.ends - w.starts > 2)
    words = per_text(np.ones(k), w.first)
    base, size = np.maximum(words, 1), np.maximum(np.diff(off), 1)
    sums = lambda x: per_text(x.astype(float), w.first)
    hits, weight, persons, hid = sums(hit), sums(value), sums(person), sums(veiled)
    best = np.zeros(n)
    np.maximum.at(best, row, value)
    marks = per_text(((data == 33) | (data == 63)).astype(float), off)
    capitals = per_text(((data >= 65) & (data <= 90)).astype(float), off)
    seed = sums(np.isin(w.hashes, _SEED_HASHES))
    return np.stack([words, hits, hits / base, weight, weight / base, sums(near), persons / base, hid, hid / base, sums(mixed) / base, capitals / size, sums(shouted) / base, marks / size, seed, best], axis=1)


_SEED_HASHES, _PERSON_HASHES = np.sort(word_hash(SEED)), np.sort(word_hash(PERSON))


def _apply(tree, x: np.ndarray) -> np.ndarray:
    """A tree is a leaf's value or (feature, threshold, left, right); rows at or below the threshold go left."""
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, t, a, b = tree
    left = x[:, f] <= t
    out = np.empty(len(x))
    out[left], out[~left] = _apply(a, x[left]), _apply(b, x[~left])
    return out


def _grow(bins, cuts, g, h, rows, depth, least=8.0, ridge=1.0, rate=0.15):
    """One tree of second-order gain on binned features."""
    gs, hs = g[rows].sum(), h[rows].sum()
    if depth:
        best, at = 1e-6, None
        for f in range(bins.shape[1]):
            m = len(cuts[f]) + 1
            if m < 2:
                continue
            b = bins[rows, f]
            ga, ha = np.cumsum(np.bincount(b, g[rows], m))[:-1], np.cumsum(np.bincount(b, h[rows], m))[:-1]
            na = np.cumsum(np.bincount(b, minlength=m))[:-1]
            gain = ga**2 / (ha + ridge) + (gs - ga) ** 2 / (hs - ha + ridge) - gs**2 / (hs + ridge)
            gain[(na < least) | (len(rows) - na < least)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, at = gain[k], (f, k)
        if at:
            left = bins[rows, at[0]] <= at[1]
            return (at[0], float(cuts[at[0]][at[1]]), _grow(bins, cuts, g, h, rows[left], depth - 1, least, ridge, rate), _grow(bins, cuts, g, h, rows[~left], depth - 1, least, ridge, rate))
    return float(-gs / (hs + ridge) * rate)


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3) -> tuple[float, list]:
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 49)[1:-1]))[:-1] if len(np.unique(x[:, f])) > 48 else np.unique(x[:, f])[:-1] for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    p = y.mean()
    start = float(np.log(p / (1 - p)))
    margin, out = np.full(len(y), start), []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        tree = _grow(bins, cuts, q - y, q * (1 - q), np.arange(len(y)), depth)
        out.append(tree)
        margin += _apply(tree, x)
    return start, out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block means over ascending margins, with one pseudo-row of each label in all."""
    values, back = np.unique(margin, return_inverse=True)
    blocks: list[list[float]] = []  # sum, weight, first and last margin
    for v, s, n in zip(values, np.bincount(back, y), np.bincount(back)):
        blocks.append([s, n, v, v])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s2, n2, _, e = blocks.pop()
            blocks[-1][0] += s2
            blocks[-1][1] += n2
            blocks[-1][3] = e
    at, p = [], []
    for s, n, a, b in blocks:
        at += [a, b] if b > a else [a]
        p += [(s + y.mean()) / (n + 1)] * (2 if b > a else 1)
    return np.array(at), np.maximum.accumulate(np.array(p))


def _of_sample(docs: DataFrame, labels: DataFrame, max_labels: int, learn_from: Column) -> DataFrame:
    """doc_id, toxic, fold and text of the sample, one row for each doc_id."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.where(learn_from).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(known), "doc_id")  # max_labels rows at most
    one = found.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    return one.select("doc_id", "toxic", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), "text")


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, max_labels: int = MAX_LABELS) -> Model:
    sample = written(_of_sample(docs, labels, max_labels, F.lit(True) if learn_from is None else learn_from), "labelled")

    def seen(batches):
        for b in batches:
            arr, y, fold = text_column(b, "text"), b.column(1).to_numpy().astype(np.int64), b.column(2).to_numpy()
            for lo, hi in row_slices(arr):
                w, _ = _tokens(arr.slice(lo, hi - lo))
                row = np.repeat(np.arange(hi - lo), np.diff(w.first))
                pairs = np.unique(np.stack([row.astype(np.int64), w.hashes.view(np.int64)]), axis=1)
                keys, back = np.unique(np.stack([pairs[1], fold[lo:hi][pairs[0]]]), axis=1, return_inverse=True)
                toxic = np.bincount(back.reshape(-1), y[lo:hi][pairs[0]])
                yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1].astype(np.int32)), pa.array(toxic.astype(np.int64)), pa.array(np.bincount(back.reshape(-1)).astype(np.int64))], ["h", "fold", "toxic", "n"])

    totals = {r["fold"]: (r["n"], r["t"]) for r in sample.groupBy("fold").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).collect()}
    many, toxic = (sum(x[k] for x in totals.values()) for k in (0, 1))
    if not 0 < toxic < many:
        return Model(np.zeros(0, U), np.zeros(0), mean=float(toxic / many) if many else 0.0)
    # the last lexicon is of all parts and scores the corpus; the others leave one part out
    left_out = [*range(FOLDS), -1]
    prior = [(toxic - totals.get(k, (0, 0))[1]) / max(many - totals.get(k, (0, 0))[0], 1) for k in left_out]
    counts = sample.mapInArrow(seen, "h long, fold int, toxic long, n long").groupBy("h").agg(*[F.sum(F.when(F.col("fold") != k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in left_out for c in ("toxic", "n")])

    def bound(k: int) -> Column:
        """A lower bound of a word's share of toxic documents."""
        n = F.col(f"n{k}")
        share = (F.col(f"toxic{k}") + 2 * F.lit(prior[k])) / (n + 2)
        return share - 2 * F.sqrt(share * (1 - share) / (n + 2))

    each = F.array(*[F.struct(F.lit(k).alias("k"), bound(k).alias("bound"), F.col(f"n{k}").alias("n"), F.lit(2 * prior[k]).alias("least")) for k in left_out])
    best = counts.select("h", F.explode(each).alias("e")).where("e.n >= 5 and e.bound > e.least")
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("e.k").orderBy(F.desc("e.bound"), F.desc("e.n"), "h"))).where(F.col("r") <= MAX_LEXICON).select("h", "e.k", "e.bound").collect()
    lexicons = []
    for k in left_out:
        weights = dict.fromkeys(_SEED_HASHES.tolist(), 0.5) | {r["h"] % (1 << 64): float(r["bound"]) for r in best if r["k"] == k}
        words = np.array(sorted(weights), U)
        lexicons.append((words, np.array([weights[int(h)] for h in words])))

    def dense(batches):
        for b in batches:
            arr, fold = text_column(b, "text"), b.column(2).to_numpy()
            for lo, hi in row_slices(arr):
                x = np.zeros((hi - lo, len(FEATURES)))
                for k in np.unique(fold[lo:hi]):
                    at = np.flatnonzero(fold[lo:hi] == k)
                    x[at] = features(arr.take(pa.array(at + lo)), *lexicons[k])
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in range(3)), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))], ["doc_id", "toxic", "fold", "x"])

    rows = sorted(sample.mapInArrow(dense, "doc_id long, toxic int, fold int, x array<double>").collect())  # max_labels rows at most
    x, y, fold = np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float), np.array([r["fold"] for r in rows])
    model = Model(*lexicons[-1])
    model.start, model.trees = boost(x, y)
    margin = model.margins(x)
    for k in range(FOLDS):
        rest = fold != k
        if 0 < y[rest].sum() < rest.sum():  # else, in tiny samples, the trees of all rows serve
            margin[~rest] = Model(*lexicons[-1], *reversed(boost(x[rest], y[rest]))).margins(x[~rest])
    model.steps = isotonic(margin, y)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score), one for each document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # MAX_LEXICON words and a fixed number of trees

    def run(batches):
        m = sent.value
        for b in batches:
            arr = text_column(b, "text")
            for lo, hi in row_slices(arr):
                s = m.score(features(arr.slice(lo, hi - lo), m.lexicon, m.weights))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(s.astype(float))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def held_out() -> Column:
    """Rows kept out of learning: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted); nothing is learned from held-out rows."""
    model = fit(docs, labels, ~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
