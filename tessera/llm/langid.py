"""Language identification by bit-sliced Bloom filters over character trigrams.

Each slot of one array holds a bit mask over all languages, so a lookup (the AND of K slots) gives every language that
has the trigram at once.  A text's bits are counted per language and corrected for that language's false-positive rate,
fill ** K: (seen - n * rate) / (1 - rate).  The language with the largest corrected count wins; equal counts go to
the language with more training rows.

Learning reads a bounded sample: about SAMPLE rows of each language, taken by a hash of the key, whatever the input's
size.  A trigram belongs to a language if its share of that language's trigrams is at least SHARE of its largest share
in any language; a language's filter has room for GRAMS trigrams, those of the largest shares.  The model (SLOTS masks
of 64 languages each) is the only thing that is broadcast, and its size is fixed by the number of languages, which is
taken to be small: their row counts reach the driver.

Edge cases: a text that is null or has no letter is `und` with score 0; a letter without evidence gets the commonest
language with score 0; with nothing learned (an empty table, no label), all is `und`.  Equal texts get equal answers;
of languages with equal counts the one with more rows wins, then the one whose name comes first.  Texts of any length
are read whole.  Other columns pass through; one that has the name of an output is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, enter, new_column

__all__ = ["Model", "fit", "is_held_out", "predict", "shows"]

SAMPLE, GRAMS, SHARE = 3000, 60_000, 0.3
SLOTS, K = 1 << 18, 3
UND = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case letter of each character up to U+FFFF, a blank for all else."""
    return np.array([ord(c) if (c := chr(i)).isalpha() else 0x20 for i in range(0x10000)], np.uint32)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all trigrams around a letter, the text of each, and whether each text has a letter.

    Each text is blank at both ends; a trigram has its letter in the middle.
    """
    joined = [f" {t.lower()} " for t in texts]
    raw = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in joined])
    a = _letters()[np.minimum(raw, 0xFFFF)]
    for c in np.unique(raw[raw > 0xFFFF]):
        a[raw == c] = c if chr(c).isalpha() else 0x20
    a = a.astype(np.uint64)
    mid = np.flatnonzero(a[1:-1] != 0x20) + 1 if len(a) > 2 else np.empty(0, np.int64)
    codes = a[mid - 1] << np.uint64(42) | a[mid] << np.uint64(21) | a[mid + 1]
    has = np.bincount(owner[mid], minlength=len(texts)) > 0
    return codes, owner[mid], has


def slots(codes: np.ndarray) -> list[np.ndarray]:
    """K slots of each code: three fields of one mixed word."""
    h = codes * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return [(h >> np.uint64(18 * i) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(K)]


@dataclass
class Model:
    languages: list[str]  # commonest first, then by name
    masks: np.ndarray  # [words of 64 languages, SLOTS]
    rates: np.ndarray  # of false positives, by language

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        known = [t or "" for t in texts]
        codes, owner, has = trigrams(known)
        n = np.bincount(owner, minlength=len(known))
        at = slots(codes)
        seen = np.zeros((len(self.languages), len(known)))
        for w, masks in enumerate(self.masks):
            hit = masks[at[0]] & masks[at[1]] & masks[at[2]]
            for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                bit = (hit >> np.uint64(i % 64) & np.uint64(1)).astype(bool)
                seen[i] = np.bincount(owner[bit], minlength=len(known))
        true = np.maximum(0, (seen - n * self.rates[:, None]) / (1 - self.rates[:, None]))
        out = []
        for i in range(len(known)):
            if not has[i] or not self.languages:
                out.append((UND, 0.0))
                continue
            best = int(true[:, i].argmax())
            total = true[:, i].sum()
            out.append((self.languages[best], float(min(1.0, true[best, i] / total)) if total > 0 else 0.0))
        return out


def is_held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def _groups(texts: list, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enter("langid")
    for b in batches:
        langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for lang in sorted(set(langs)):
            mine = [t or "" for t, x in zip(texts, langs, strict=True) if x == lang]
            for i, j in _groups(mine):
                code, count = np.unique(trigrams(mine[i:j])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code.astype(np.int64)), pa.array(count)], ["lang", "gram", "n"])


def fit(df: DataFrame, label: str = "lang", text: str = "text", key: str = "doc_id") -> Model:
    """From the rows of df with a label; the caller has taken held-out rows away."""
    rows = df.where(F.col(label).isNotNull())
    sizes = {str(r[0]): r[1] for r in rows.groupBy(label).count().collect()}
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    words = max(1, -(-len(languages) // 64))
    masks, rates = np.zeros((words, SLOTS), np.uint64), np.zeros(len(languages))
    if languages:
        scratch = Scratch(df.sparkSession, "langid")
        # Literals, as a list of rows would start Python workers of another kind that stay beside the others.
        rates_of = F.explode(F.array(*[F.struct(F.lit(x).alias("lang"), F.lit(min(1.0, SAMPLE / sizes[x])).alias("share")) for x in languages]))
        drawn = df.sparkSession.range(1).select(rates_of.alias("x")).select("x.*")
        marked = rows.select(F.col(label).cast("string").alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(key), F.lit(1 << 20)).alias("draw"))
        sample = marked.join(F.broadcast(drawn), "lang").where(F.col("draw") < F.col("share") * (1 << 20)).select("lang", "text")
        counts = scratch.save(sample.mapInArrow(_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "counts")
        totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
        shares = counts.join(F.broadcast(totals), "lang").select("gram", "lang", (F.col("n") / F.col("total")).alias("share"))
        held = shares.withColumn("top", F.max("share").over(Window.partitionBy("gram"))).where(F.col("share") >= F.col("top") * SHARE)
        # At most GRAMS of each language, by share, reach the driver; each task sorts out its own first.
        place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("share"), "gram"))
        kept = held.withColumn("place", place).where(F.col("place") <= GRAMS).select("lang", "gram").toArrow()
        scratch.drop(counts)
        of, codes = kept["lang"].to_numpy(), kept["gram"].to_numpy().view(np.uint64)
        for i, x in enumerate(languages):
            for at in slots(codes[of == x]):
                np.bitwise_or.at(masks[i // 64], at, np.uint64(1 << (i % 64)))
        for i in range(len(languages)):
            fill = float(((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean())
            rates[i] = fill**K
    return Model(languages, masks, rates)


def predict(df: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of df, and the language and score of each text."""
    known = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("langid")
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            found = [x for i, j in _groups(texts) for x in known.value.predict(texts[i:j])]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*b.schema.names, lang, score]
            )

    return new_column(df, lang, score).mapInArrow(run, df.withColumn(lang, F.lit("")).withColumn(score, F.lit(0.0)).schema)


def shows(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of df whose text shows a language: a score over 0.  Rows are dropped where they are read."""
    known = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("langid")
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            yield b.filter(pa.array([x[1] > 0 for i, j in _groups(texts) for x in known.value.predict(texts[i:j])], pa.bool_()))

    return df.mapInArrow(run, df.schema)
