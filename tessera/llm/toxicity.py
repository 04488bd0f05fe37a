"""Toxicity: restore disguised words with a noisy-channel model, then score the restored text.

Channel: a letter may have been written as a look-alike sign, its letters spaced out or repeated, a sign inserted.  A
token that shows none of this has only itself in its lattice and passes unchanged; any other becomes a lattice of
(letters, cost) choices per sign, and Viterbi takes the path that is likeliest under channel and a character trigram
model.  That model is counted over all documents (a table of ALPHABET ** 3 counts, whatever the input).

Spacing: two or more single letters or signs on end, parted by white space of any kind or by . - _ *, are one token; each
gap in its lattice is a choice of nothing or a word's end, so the model decides which letters make a word.  In a gap that
is wider than the token's narrowest one, nothing costs DROP; in any other, a word's end costs BREAK.

Score: logistic regression on log counts of FEATURES restored words and word beginnings, fitted on at most SAMPLE
labelled rows (those first by a hash of the key).  Only the sample's keys, the selected features and the sparse sample
matrix reach the driver; all are bounded by these parameters.

Edge cases: null and empty texts get the score of a text without features; equal texts, and so repeated rows, get equal
scores; several labels of a document count as toxic if one is; without labels, or with labels of one kind only, all get
that kind's share; of equally likely readings of a token the last in order is taken; texts of any length are read whole,
in time linear in it; an empty table gives no rows; other columns pass through, and one that has the output's name is
refused.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import Cache
from tessera.llm.common import Scratch, enter, new_column

__all__ = ["CharModel", "Scorer", "count_characters", "fit", "is_held_out", "predict", "restore"]

SAMPLE, FEATURES, LEAST = 12_000, 3_000, 4
#: a-z, other letters, and what is no letter.
OTHER, EDGE, ALPHABET = 26, 27, 28
STARTS = (4, 5, 6)
#: Look-alikes (fixed values): the letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou"}
#: Log costs of the channel.
SWAP, DROP, KEEP, BREAK = -1.5, -4.0, -9.0, -3.0
#: A letter, digit or look-alike by itself, or several parted by signs; signs around it.
_DOTTED = r"[^\W_](?:[.\-_*]+[^\W_])%s"
_SINGLE = rf"(?>[^\w\s]{{0,3}}{_DOTTED % '*'}[^\w\s]{{0,3}}|[@$!|+(€*])(?!\S)"
SPACED = re.compile(rf"(?<!\S)(?:{_SINGLE}(?:\s+{_SINGLE})+|[^\w\s]{{0,3}}{_DOTTED % '+'}[^\w\s]{{0,3}}(?!\S))")
UNIT = re.compile(r"[^\W_]|(?<!\S)[@$!|+(€*](?!\S)")
REPEATED = re.compile(r"([^\W\d_])\1\1")
SIGNS = re.compile(r"[0134578@$!|+(€*9.\-_]")
LETTERS = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.full(0x10000, EDGE, np.uint8)
    for i in range(0x10000):
        c = chr(i).lower()
        if c.isalpha():
            base = unicodedata.normalize("NFKD", c)[0]
            out[i] = ord(base) - 97 if "a" <= base <= "z" else OTHER
    return out


def _codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _classes()[np.minimum(raw, 0xFFFF)].astype(np.int64)


def count_characters(df: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram counts over all texts, [ALPHABET] * 3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        total, held, size = np.zeros(ALPHABET**3, np.int64), [], 0

        def add(texts: list[str]) -> None:
            c = _codes(f"  {'  '.join(texts)}  ")  # two blanks: no trigram with letters spans two texts
            total[:] += np.bincount((c[:-2] * ALPHABET + c[1:-1]) * ALPHABET + c[2:], minlength=ALPHABET**3)

        for b in batches:
            for t in b.column(0):
                held.append(t.as_py() or "")
                size += len(held[-1])
                if size > 1 << 19:
                    add(held)
                    held, size = [], 0
        add(held)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["code", "n"])

    counts = df.select(text).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    out = np.zeros(ALPHABET**3, np.int64)
    for code, n in counts.collect():
        out[code] = n
    return out.reshape(ALPHABET, ALPHABET, ALPHABET)


@dataclass
class CharModel:
    logs: list  # log p(c | a, b), nested lists

    @classmethod
    def of(cls, counts: np.ndarray) -> CharModel:
        c = counts + 0.1
        return cls(np.log(c / c.sum(-1, keepdims=True)).tolist())

    def decode(self, token: str) -> str:
        """Likeliest letters behind a lower-case token; signs kept by the best path part words."""
        steps: list[list[tuple[str, float]]] = []
        i = 0
        while i < len(token):
            c = token[i]
            run = 1
            while c.isalpha() and i + run < len(token) and token[i + run] == c:
                run += 1
            if c.isalpha():
                steps.append([(c, 0.0), (c * 2, 0.0)] if run > 2 else [(c * run, 0.0)])
            else:
                steps.append([(x, SWAP) for x in LEET.get(c, "")] + [("", DROP), (" ", KEEP)])
            i += run
        return self.best(steps)

    def decode_spaced(self, run: str) -> str:
        """Likeliest words behind letters and signs that stand apart."""
        units = list(UNIT.finditer(run))
        gaps = [b.start() - a.end() for a, b in zip(units, units[1:])]
        least = min(gaps, default=0)
        steps: list[list[tuple[str, float]]] = []
        i = 0
        while i < len(units):
            c, n = units[i].group(), 1
            if c.isalpha():
                while i + n < len(units) and units[i + n].group() == c and gaps[i + n - 1] == least:
                    n += 1
                if n < 3:
                    n = 1
                steps.append([(c, 0.0), (c * 2, 0.0)] if n > 2 else [(c, 0.0)])
            else:
                steps.append([(x, SWAP) for x in LEET.get(c, "")] + [("", DROP), (" ", KEEP)])
            i += n
            if i < len(units):
                steps.append([("", DROP), (" ", 0.0)] if gaps[i - 1] > least else [("", 0.0), (" ", BREAK)])
        return self.best(steps)

    def best(self, steps: list[list[tuple[str, float]]]) -> str:
        """Viterbi: the letters of the likeliest path, of equal ones the last in order."""
        best: dict[tuple[int, int], tuple[float, tuple]] = {(EDGE, EDGE): (0.0, ())}
        for choices in steps:
            following: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (score, said) in best.items():
                for letters, cost in choices:
                    p, q, total = a, b, score + cost
                    for x in letters:
                        k = _class_of(x)
                        total += self.logs[p][q][k]
                        p, q = q, k
                    if (p, q) not in following or following[p, q][0] < total:
                        following[p, q] = (total, (said, letters))
            best = following
        ends = [(score + self.logs[a][b][EDGE], said) for (a, b), (score, said) in best.items()]
        top = max(score for score, _ in ends)
        return max(_said(said) for score, said in ends if score == top)


def _said(path: tuple) -> str:
    out = []
    while path:
        path, letters = path
        out.append(letters)
    return "".join(reversed(out))


def _class_of(c: str) -> int:
    return int(_classes()[min(ord(c), 0xFFFF)])


def restore(token: str, model: CharModel) -> list[str]:
    """Words behind a lower-case token without white space (or a spaced-out one)."""
    if token.isalpha() and not REPEATED.search(token):
        return [token]
    core = token.rstrip("!?.,;:*#&%~=\"')]}>|-_")
    core = core.lstrip("?.,;:*#&%~=\"'([{<-_")
    while len(core) > 2 and core[-1] == core[-2] and not core[-1].isalnum():
        core = core.rstrip(core[-1])
    if SPACED.fullmatch(token):
        core = model.decode_spaced(core)
    elif any(c.isalpha() for c in core) and (SIGNS.search(core) or REPEATED.search(core)):
        core = model.decode(core)
    return LETTERS.findall(core)


def names(word: str) -> list[str]:
    """Features of a restored word: itself and how it begins."""
    return [f"={word}", *(f"{word[:n]}-" for n in STARTS if len(word) > n)]


def _tokens(text: str | None, spaced: bool = False) -> list[str]:
    """Tokens in lower case; spaced-out ones as they stand, for restore(), or else as their letters and signs in a row."""
    low, out, at = (text or "").lower(), [], 0
    for m in SPACED.finditer(low):
        if any(map(str.isalpha, m.group())):
            out += low[at : m.start()].split()
            out.append(m.group() if spaced else "".join(UNIT.findall(m.group())))
            at = m.end()
    return out + low[at:].split()


@dataclass
class Scorer:
    characters: CharModel
    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_cache"}

    def ids(self, token: str) -> tuple[int, ...]:
        return tuple(i for w in restore(token, self.characters) for f in names(w) if (i := self.index.get(f)) is not None)

    def vectors(self, texts) -> Iterator[Counter]:
        cache = self.__dict__.setdefault("_cache", Cache(self.ids))
        for t in texts:
            yield Counter(chain.from_iterable(map(cache.__getitem__, _tokens(t, True))))

    def scores(self, texts) -> Iterator[float]:
        for v in self.vectors(texts):
            z = self.bias + sum(self.weights[i] * math.log1p(n) for i, n in v.items())
            yield 1 / (1 + math.exp(-min(max(z, -500), 500)))


def is_held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def logistic(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, rounds: int = 400, ridge: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent over a sparse matrix."""
    n = len(y)
    base = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    w, bias = np.zeros(width), math.log(base / (1 - base))
    if base in (1e-6, 1 - 1e-6) or not len(rows):
        return w, bias
    norm = float(np.bincount(rows, values**2, n).max()) + 1
    step = 1 / (0.25 * min(norm, 25.0) + ridge)
    v, vb, ahead, ahead_b = w.copy(), bias, w.copy(), bias
    for k in range(rounds):
        z = np.bincount(rows, ahead[columns] * values, n) + ahead_b
        r = 1 / (1 + np.exp(-z)) - y
        grad = np.bincount(columns, r[rows] * values, width) / n + ridge * ahead
        new, new_b = ahead - step * grad, ahead_b - step * float(r.mean())
        pull = k / (k + 3)
        ahead, ahead_b = new + pull * (new - v), new_b + pull * (new_b - vb)
        v, vb = new, new_b
    return v, vb


def fit(df: DataFrame, labels: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Scorer:
    """labels (key, label) holds no held-out rows."""
    model = CharModel.of(count_characters(df, text))
    drawn = labels.where(F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("label")).orderBy(F.xxhash64(key), key).limit(SAMPLE)
    # The drawn keys are at most SAMPLE rows of two numbers.
    sample = scratch.save(df.select(key, text).join(F.broadcast(drawn), key).select(F.col("label").cast("int").alias("label"), F.col(text).alias("text")), "sample")
    totals = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    scorer = Scorer(model)
    if not totals:
        return scorer
    pos, neg = totals.get(1, 0), sum(totals.values()) - totals.get(1, 0)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        cache = Cache(lambda t: tuple(f for w in restore(t, model) for f in names(w)))
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held = sorted(set(chain.from_iterable(map(cache.__getitem__, set(_tokens(t, True))))))
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array([int(y == 1)] * len(held), pa.int64())], ["name", "y"])

    per = sample.mapInArrow(seen, "name string, y long").groupBy("name").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where(F.col("a") >= LEAST)
    # Signed root of the likelihood ratio's main part: how far the share among toxic rows is off, for its size.
    worth = (F.col("a") / max(pos, 1) - F.col("b") / max(neg, 1)) / F.sqrt((F.col("a") + F.col("b")) / (pos + neg))
    chosen = per.orderBy(F.desc(F.abs(worth)), "name").limit(FEATURES).select("name")
    scorer.index = {r[0]: i for i, r in enumerate(chosen.collect())}

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        for b in batches:
            found = [sorted(v.items()) for v in scorer.vectors(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([[i for i, _ in v] for v in found], pa.list_(pa.int32())), pa.array([[n for _, n in v] for v in found], pa.list_(pa.int32()))], ["y", "i", "n"]
            )

    matrix = sample.mapInArrow(rows_of, "y int, i array<int>, n array<int>").toArrow()
    y = (np.array(matrix["y"].to_pylist()) == 1).astype(float)
    size = np.array([len(x) for x in matrix["i"].to_pylist()], np.int64)
    columns = np.array(list(chain.from_iterable(matrix["i"].to_pylist())), np.int64)
    values = np.log1p(np.array(list(chain.from_iterable(matrix["n"].to_pylist())), float))
    scorer.weights, scorer.bias = logistic(np.repeat(np.arange(len(y)), size), columns, values, y, len(scorer.index))
    return scorer


def predict(df: DataFrame, scorer: Scorer, text: str = "text", out: str = "score") -> DataFrame:
    """All columns of df and the score."""
    held = df.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        known = None
        for b in batches:
            if known is None:
                known = held.value
            scores = list(known.scores(b.column(b.schema.get_field_index(text)).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, out])

    return new_column(df, out).mapInArrow(run, df.withColumn(out, F.lit(0.0)).schema)
