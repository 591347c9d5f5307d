"""SentencePiece encoding and decoding with seeded merge-dropout.

A text is turned into symbols (one for each character the vocabulary knows) and
pairs of neighbours whose concatenation is a piece are merged by the pieces'
scores, best first and leftmost among equals. A keyed hash of the seed, the
doc_id, the pair's place in the text and its piece skips a share of the candidate
merges for good, so that each occurrence of a word is cut by itself while every
segmentation spells the same text. Characters without a piece, and a literal U+2581, are
spelled by byte pieces, so decoding gives back every text exactly.

No piece joins characters across the start of a run of blanks or across a
character without a piece, so a text is cut there into units. Equal units are
encoded once in each slice of a batch without dropout, noting every candidate
merge; an occurrence takes this over where none of these candidates is skipped,
since its merges are the same then. All other occurrences are encoded by
themselves. Units are encoded at the same time, a merge of each in every round;
those too long for that run through the agenda one by one.

Cases: null and empty texts have no pieces and decode to the empty text; nulls in
doc_id are keyed as 0; repeated rows are encoded alike; an empty table gives an
empty result; other columns are never read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, row_slices, text_column
from .wordhash import U, mix, powers

MODEL = "piece_bpe_32k.model"
BLANK = 0x2581
#: Longest unit that is merged side by side with others.
WIDE = 48
NEVER = np.int32(1 << 30)
_ALL = (1 << 64) - 1


def read_model(path: str) -> bytes:
    """The serialised model. On a cluster the driver reads it once and sends it to the executors (half a MB)."""
    with open(path, "rb") as f:
        return f.read()


def default_model() -> bytes:
    import public_tokenizers

    return read_model(public_tokenizers.path(MODEL))


def _skips(place: int, piece: int, key: int, dropout: float) -> bool:
    """Codec.skipped for one merge, in plain integers."""
    x = (place << 32) ^ piece ^ key
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _ALL
    return ((x ^ (x >> 31)) >> 11) * 2.0**-53 < dropout


class Codec:
    """A BPE model with byte fallback as arrays."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        byte = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(byte) != 256:
            raise ValueError("the model has no byte fallback")
        self.byte = np.array([byte[b] for b in range(256)], np.int32)
        self.of = {self.pieces[i]: i for i in plain}
        if any(chr(BLANK) in p.lstrip(chr(BLANK)) for p in self.of):
            raise ValueError("a piece spans words")
        order = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        self.rank = np.full(n, NEVER, np.int32)
        self.rank[order] = np.arange(len(order), dtype=np.int32)
        self.by_rank = np.array(order, np.int32)
        self.single = np.full(0x110000, -1, np.int32)
        for p, i in self.of.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        left, right, to = [], [], []
        for p, i in self.of.items():
            for k in range(1, len(p)):
                a, b = self.of.get(p[:k]), self.of.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), to.append(i)
        self.pair, self.ranks = dict(zip(zip(left, right), to)), self.rank.tolist()
        # the same as an open table of pairs
        key = np.array(left, np.int64) * n + np.array(right, np.int64)
        self.size = 1 << (max(len(key), 1) * 4 - 1).bit_length()
        self.keys, self.to, self.n = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int32), n
        at, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            slot = at[todo]
            free = self.keys[slot] < 0
            _, first = np.unique(np.where(free, slot, -1 - todo), return_index=True)
            placed = first[free[first]]
            self.keys[slot[placed]], self.to[slot[placed]] = key[todo[placed]], np.array(to, np.int32)[todo[placed]]
            todo = np.delete(todo, placed)
            at[todo] = (at[todo] + 1) & (self.size - 1)
        spelled = [(b"" if self.rank[i] == NEVER else self.pieces[i].replace(chr(BLANK), " ").encode()) for i in range(n)]
        for b, i in byte.items():
            spelled[i] = bytes([b])
        self.spell_len = np.array([len(s) for s in spelled], np.int64)
        self.spell_at = np.r_[0, np.cumsum(self.spell_len)]
        self.spell = np.frombuffer(b"".join(spelled), np.uint8)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix(key.astype(U)) >> U(20)).astype(np.int64) & (self.size - 1)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair spells, else -1; -1 in a or b never merges."""
        out = np.full(len(a), -1, np.int32)
        live = np.flatnonzero((a >= 0) & (b >= 0))
        key = a[live].astype(np.int64) * self.n + b[live]
        at = self._slot(key)
        while len(live):
            have = self.keys[at]
            same = have == key
            out[live[same]] = self.to[at[same]]
            on = ~same & (have >= 0)
            live, key, at = live[on], key[on], (at[on] + 1) & (self.size - 1)
        return out

    def keyed(self, doc: np.ndarray, seed: int) -> np.ndarray:
        """The keys of documents by their doc_id."""
        return mix(doc.astype(U) + U(seed * 0x9E3779B97F4A7C15 % (1 << 64)))

    def skipped(self, place: np.ndarray, piece: np.ndarray, key: np.ndarray, dropout: float) -> np.ndarray:
        """Whether the merge to piece at a place in the text is dropped."""
        h = mix((place.astype(U) << U(32)) ^ piece.astype(U) ^ key)
        return (h >> U(11)).astype(np.float64) * 2.0**-53 < dropout

    def agenda(self, symbols: np.ndarray, doc: int, seed: int, dropout: float, place: int = 0) -> list[int]:
        """One unit that begins at a place in the text through a priority queue of candidate merges; the positions left over hold the pieces."""
        key = self.keyed(np.array([doc]), seed)
        s, n, pair, rank = symbols.tolist(), len(symbols), self.pair, self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pairs(np.asarray(symbols), np.zeros(n, np.int32)) if n else np.zeros(0, np.int32)
        at = np.flatnonzero(first >= 0)
        if dropout:
            at = at[~self.skipped(place + at, first[at], key, dropout)]
        queue = [(rank[p], i, s[i], s[i + 1], p) for i, p in zip(at.tolist(), first[at].tolist())]
        heapq.heapify(queue)
        one, push, pop = int(key[0]), heapq.heappush, heapq.heappop
        gone = [False] * n
        while queue:
            _, i, a, b, p = pop(queue)
            j = after[i]
            if gone[i] or j >= n or s[i] != a or s[j] != b:
                continue
            s[i], gone[j], after[i] = p, True, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else n
                if y < n:
                    q = pair.get((s[x], s[y]))
                    if q is not None and not (dropout and _skips(place + x, q, one, dropout)):
                        push(queue, (rank[q], x, s[x], s[y], q))
        return [x for x, g in zip(s, gone) if not g]

    def pairs(self, s: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The pieces of all pairs of neighbours within a unit, else -1."""
        p = np.full(len(s), -1, np.int32)
        p[:-1] = np.where(u[1:] == u[:-1], self.merged(s[:-1], s[1:]), -1)
        return p

    def together(self, flat: np.ndarray, unit: np.ndarray, offset: np.ndarray, doc: np.ndarray, seed: int, dropout: float, place: np.ndarray | None = None, pairs: np.ndarray | None = None, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Many units at once, symbols flat with unit numbers ascending and offsets within the unit: pieces and their units.

        doc and place are those of each unit, pairs is what pairs() gives for flat;
        seen takes the units, offsets and pieces of all candidate merges.
        """
        if dropout:
            key = self.keyed(doc, seed)
            begin = np.zeros(len(doc), np.int64) if place is None else place
        step = WIDE + 2

        def offered(pos, p):
            """What candidate merges at places of flat are taken by: rank, then offset."""
            order, at = np.full(len(p), NEVER, np.int32), np.flatnonzero(p >= 0)
            u, o, q = unit[pos[at]], offset[pos[at]], p[at]
            if seen is not None:
                seen.append((u, o, q))
            if dropout:
                stay = np.flatnonzero(~self.skipped(begin[u] + o, q, key[u], dropout))
                at, o, q = at[stay], o[stay], q[stay]
            order[at] = self.rank[q] * step + o
            return order

        s, pos = flat.copy(), np.arange(len(flat), dtype=np.int32)
        r = offered(pos, self.pairs(flat, unit) if pairs is None else pairs)
        first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]) if len(s) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(s)])
        out, left = np.empty(len(flat), np.int32), np.zeros(len(flat), bool)
        while len(s):
            low = np.minimum.reduceat(r, first)
            open_ = low < NEVER
            live = np.repeat(open_, size)
            if not open_.all():
                end = np.flatnonzero(~live)
                out[pos[end]], left[pos[end]] = s[end], True
            at = np.flatnonzero(r == np.repeat(np.where(open_, low, -1), size))  # one in each open unit
            s[at] = self.by_rank[low[open_] // step]
            live[at + 1] = False
            keep = np.flatnonzero(live)
            s, pos, r = s[keep], pos[keep], r[keep]
            was, size = first[open_], size[open_] - 1
            first = np.cumsum(size) - size
            at += first - was  # merged places after removal
            r[at] = NEVER
            near = np.r_[at[at > first] - 1, at[at + 1 < first + size]]
            r[near] = offered(pos[near], self.merged(s[near], s[near + 1]))
        return out[left], unit[left]

    @staticmethod
    def _spread(symbol: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbols of units, their unit numbers and their offsets."""
        unit = np.repeat(np.arange(len(starts), dtype=np.int32), size)
        offset = (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        return symbol[np.repeat(starts, size) + offset], unit, offset

    def encode(self, texts: list[str], docs: np.ndarray, seed: int, dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and where each text's begin."""
        cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lens = np.array([len(t) for t in texts], np.int64)
        live = lens > 0
        at = np.r_[0, np.cumsum(lens[live])][:-1]
        # a blank before each text, as the model has it
        cp = np.insert(cp, at, 32)
        row = np.repeat(np.flatnonzero(live), lens[live] + 1)
        first = at + np.arange(len(at))
        blank = cp == 32
        symbol = np.where(cp == BLANK, -1, self.single[np.where(blank, BLANK, cp)]).astype(np.int32)
        strange = symbol < 0
        begin = blank.copy()
        begin[1:] &= ~blank[:-1]
        begin |= strange
        begin[1:] |= strange[:-1]
        begin[first] = True
        starts = np.flatnonzero(begin)
        size = np.diff(np.r_[starts, len(cp)])
        total = np.zeros(len(cp) + 1, U)
        np.cumsum(mix(cp.astype(U) + U(0x1F83D9AB)) * powers(len(cp)), out=total[1:])
        name = mix(((total[starts + size] - total[starts]) * powers(len(cp) + 1, True)[starts]) ^ (size.astype(U) << U(48)))
        _, which, back = np.unique(name, return_index=True, return_inverse=True)
        back = back.reshape(-1)
        wide = size > WIDE
        if dropout:  # wide units are hardly ever free of skipped merges: each occurrence runs by itself
            alone = np.flatnonzero(wide)
        else:
            alone = which[wide[which]]
        kinds = which[~wide[which]]
        k = len(kinds)
        # what is encoded: the kinds of narrow units without dropout, narrow occurrences with skipped merges, wide units
        use = np.zeros(len(which), np.int64)
        use[back[kinds]] = np.arange(k)
        use = use[back]
        flat, unit, offset = self._spread(symbol, starts[kinds], size[kinds])
        pairs, seen = self.pairs(flat, unit), []
        ids, unit = self.together(flat, unit, offset, np.zeros(k, np.int64), seed, 0.0, pairs=pairs, seen=seen if dropout else None)
        us = starts[kinds]
        if dropout:
            doc, place = docs[row[starts]], starts - first[np.searchsorted(first, starts, "right") - 1]
            cu, co, to = (np.concatenate(x) for x in zip(*seen))
            order = np.argsort(cu, kind="stable")
            co, to, many = co[order], to[order], np.bincount(cu, minlength=k)
            narrow = np.flatnonzero(~wide)
            each = many[use[narrow]]
            at = np.repeat((np.cumsum(many) - many)[use[narrow]] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            gone = self.skipped(np.repeat(place[narrow], each) + co[at], to[at], np.repeat(self.keyed(doc[narrow], seed), each), dropout)
            own = narrow[np.unique(np.repeat(np.arange(len(narrow)), each)[gone])]
            flat, mine, offset = self._spread(symbol, starts[own], size[own])
            opened = (np.cumsum(size[kinds]) - size[kinds])[use[own]]
            got, mine = self.together(flat, mine, offset, doc[own], seed, dropout, place[own], pairs[opened[mine] + offset])
            use[own] = k + np.arange(len(own))
            ids, unit, us = np.r_[ids, got], np.r_[unit, mine + k], np.r_[us, starts[own]]
            k += len(own)
            use[alone] = k + np.arange(len(alone))
            extra = [np.array(self.agenda(symbol[a : a + n], int(d), seed, dropout, int(x)), np.int32) for a, n, d, x in zip(starts[alone], size[alone], doc[alone], place[alone])]
        else:
            moved = np.zeros(len(which), np.int64)
            moved[back[alone]] = k + np.arange(len(alone))
            use = np.where(wide, moved[back], use)
            extra = [np.array(self.agenda(symbol[a : a + n], 0, seed, 0.0), np.int32) for a, n in zip(starts[alone], size[alone])]
        # a character without a piece is a unit of its own: its bytes follow
        lone = np.flatnonzero(ids < 0)
        count = np.bincount(unit, minlength=k) if k else np.zeros(0, np.int64)
        if len(lone):
            spelled = [self.byte[np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8)] for c in cp[us[unit[lone]]]]
            count[unit[lone]] = [len(x) for x in spelled]
            ids = np.concatenate([x for a, b, s in zip(np.r_[0, lone + 1], np.r_[lone, len(ids)], [*spelled, np.zeros(0, np.int32)]) for x in (ids[a:b], s)])
        ids = np.concatenate([ids, *extra])
        count = np.r_[count, [len(x) for x in extra]].astype(np.int64)
        begins = np.cumsum(count) - count
        got = count[use]
        out = ids[np.repeat(begins[use] - (np.cumsum(got) - got), got) + np.arange(got.sum())] if len(use) else np.zeros(0, np.int32)
        per = np.zeros(len(texts), np.int64)
        np.add.at(per, row[starts], got)
        return out.astype(np.int32), np.r_[0, np.cumsum(per)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The UTF-8 texts of flat ids; the blank before each text goes."""
        size = self.spell_len[ids]
        ends = np.cumsum(size)
        data = self.spell[np.repeat(self.spell_at[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        at = np.r_[0, ends][offsets]
        return [data[a + 1 : b] if b > a else b"" for a, b in zip(at[:-1], at[1:])]


@lru_cache(2)
def codec(model: bytes) -> Codec:
    return Codec(model)


def _run(batches: Iterator[pa.RecordBatch], model, seed: int, dropout: float, check: bool):
    c = codec(model.value)
    for b in batches:
        ids, arr = b.column(0), text_column(b, "text")
        docs = ids.fill_null(0).to_numpy(zero_copy_only=False)
        for lo, hi in row_slices(arr):
            part = arr.slice(lo, hi - lo)
            texts = part.to_pylist()
            got, off = c.encode(texts, docs[lo:hi], seed, dropout)
            tokens = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(got))
            cols, names = [ids.slice(lo, hi - lo), tokens, pa.array(np.diff(off).astype(np.int32))], ["doc_id", "ids", "n_tokens"]
            if check:
                cols.append(pa.array([x == t.encode("utf-8", "surrogatepass") for x, t in zip(c.decode(got, off), texts)]))
                names.append("lossless")
            yield pa.RecordBatch.from_arrays(cols, names)
        release()


def _shared(spark: SparkSession, model: bytes | None):
    return spark.sparkContext.broadcast(default_model() if model is None else model)


def encode(docs: DataFrame, model: bytes | None = None, seed: int = 5, dropout: float = 0.1, check: bool = True) -> DataFrame:
    """Rows (doc_id, ids, n_tokens[, lossless]); lossless tells whether decoding the ids gave the text back."""
    shared = _shared(docs.sparkSession, model)
    schema = "doc_id long, ids array<int>, n_tokens int" + ", lossless boolean" * check
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda b: _run(b, shared, seed, dropout, check), schema)


def decode(encoded: DataFrame, model: bytes | None = None) -> DataFrame:
    """Rows (doc_id, text) of rows (doc_id, ids); null ids decode to the empty text."""
    shared = _shared(encoded.sparkSession, model)

    def run(batches):
        c = codec(shared.value)
        for b in batches:
            lists = b.column(1)
            rows = [np.asarray(x.values.to_numpy(zero_copy_only=False), np.int32) if x.is_valid else np.zeros(0, np.int32) for x in lists]
            off = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int64)
            texts = c.decode(np.concatenate(rows) if rows else np.zeros(0, np.int32), off)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
