"""Nearest targets by TF-IDF cosine, block by block: no pair of postings is ever a row.

The queries of a country are dealt to blocks; a block's task gets its queries, all targets of the country as text and the
vocabularies, and keeps the best of each query while it goes through the targets piece by piece.  A second kind of terms may
then rescore what was kept.  So the shuffle holds each target's text once a block, and what leaves a task are results.
A task holds its queries, their best, a piece of weights, and the country's vocabularies, ids and texts.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: Queries of a block: at least, so that a country's targets are not read too often, and at most, for the memory of a task.
QUERIES = (512, 16384)
#: Targets of a piece, postings of one step, and rows of a batch of results.
PIECE, STEP, BATCH = 8192, 1 << 20, 1 << 16
#: Scores are compared and returned in millionths; a key is the distance of a score from LIMIT, then the target's place.
SCALE, LIMIT, PLACE = 1e6, 1 << 21, (1 << 32) - 1
#: Longer words are cut into n-grams one by one.
LONG = 64


@dataclass(frozen=True)
class Stage:
    """A kind of terms ("words" or "chars", as retrieval.word_terms and char_terms) and the (country, term, idf) that count."""

    kind: str
    vocabulary: DataFrame


def _words(texts: pa.Array, row: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All parts between blanks, and the row of each."""
    parts = pc.split_pattern(texts, " ")
    return parts.flatten(), np.repeat(row, pc.list_value_length(parts).to_numpy(zero_copy_only=False))


def _mask(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False).astype(bool)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1 and so on up to size[0] of them, then those of start[1] and so on."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


def _places(terms: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    """Place of each term in the vocabulary, -1 if it has none."""
    return pc.fill_null(pc.index_in(terms, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def word_places(texts: pa.Array, row: np.ndarray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of each occurrence of a term."""
    word, at = _words(texts, row)
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(pc.split_pattern(texts, " ")).to_numpy(zero_copy_only=False))
    long = _mask(pc.greater_equal(pc.utf8_length(word), 2))
    word, at, text = word.filter(pa.array(long)), at[long], text[long]
    near = text[:-1] == text[1:]
    pairs = pc.binary_join_element_wise(word[:-1], word[1:], " ").filter(pa.array(near))
    place = np.concatenate([_places(word, vocabulary), _places(pairs, vocabulary)])
    at = np.concatenate([at, at[:-1][near]])
    return at[place >= 0], place[place >= 0]


def gram_places(texts: pa.Array, row: np.ndarray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of each occurrence of an n-gram; each distinct word is cut once."""
    word, at = _words(texts, row)
    some = _mask(pc.not_equal(word, ""))
    coded = word.filter(pa.array(some)).dictionary_encode()
    at, code = at[some], coded.indices.to_numpy(zero_copy_only=False)
    padded = pc.binary_join_element_wise("", coded.dictionary, "", " ")
    length = pc.utf8_length(padded).to_numpy(zero_copy_only=False)
    grams, owners = [], []
    for n in (3, 4):
        who = np.flatnonzero((length >= n) & (length <= LONG))
        i, left = 0, padded.take(pa.array(who))
        while len(who):
            grams.append(pc.utf8_slice_codeunits(left, i, i + n))
            owners.append(who)
            i += 1
            more = length[who] >= i + n
            who, left = who[more], left.filter(pa.array(more))
        for w in np.flatnonzero(length > LONG):
            x = padded[int(w)].as_py()
            grams.append(pa.array([x[j : j + n] for j in range(len(x) - n + 1)], padded.type))
            owners.append(np.full(len(x) - n + 1, w))
    if not grams:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, owner = _places(pa.concat_arrays(grams), vocabulary), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    order = order[place[order] >= 0]
    place, size = place[order], np.bincount(owner[order], minlength=len(padded))
    start = np.cumsum(size) - size
    return np.repeat(at, size[code]), place[_ranges(start[code], size[code])]


_TERMS: dict[str, Callable] = {"words": word_places, "chars": gram_places}


class Vectors:
    """Unit vectors of records, a row of the sparse matrix each: start, place of the term, weight."""

    def __init__(self, kind: str, texts: pa.ListArray, vocabulary: pa.Array, idf: np.ndarray):
        n, size = len(texts), pc.list_value_length(texts).to_numpy(zero_copy_only=False)
        row, place = _TERMS[kind](texts.flatten(), np.repeat(np.arange(n), size), vocabulary)
        keys = np.sort(row * max(len(vocabulary), 1) + place)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(keys)))
        self.row, self.place = np.divmod(keys[first], max(len(vocabulary), 1))
        raw = (1 + np.log(count)) * idf[self.place]
        norm = np.sqrt(np.bincount(self.row, raw * raw, n))
        self.w = raw / norm[self.row]
        self.size = np.bincount(self.row, minlength=n)
        self.start = np.cumsum(self.size) - self.size


def _millionths(score: np.ndarray) -> np.ndarray:
    return np.floor(score * SCALE + 0.5).astype(np.int64)


def _keep(best: list[np.ndarray], worst: np.ndarray, queries: Vectors, piece: Vectors, n: int, first: int, k: int, terms: int) -> None:
    """Let the n targets of a piece, whose first has the place `first`, join the k best of each query."""
    order = np.argsort(piece.place, kind="stable")
    row, w = piece.row[order], piece.w[order]
    size = np.bincount(piece.place, minlength=terms)
    start = np.cumsum(size) - size
    lo, of = start[queries.place], size[queries.place]
    met = np.concatenate([[0], np.cumsum(of)])
    ends = np.append(queries.start, len(queries.place))
    q = 0
    while q < len(best):
        # As many queries as fit in one step, one at least.
        to = int(np.searchsorted(met[ends], met[ends[q]] + STEP, "right")) - 1
        to = max(q + 1, min(to, q + max(1, STEP // n), len(best)))
        part = slice(ends[q], ends[to])
        at = _ranges(lo[part], of[part])
        if len(at):
            mine = np.repeat(queries.row[part] - q, of[part])
            score = np.bincount(mine * n + row[at], np.repeat(queries.w[part], of[part]) * w[at], (to - q) * n)
            hit = np.flatnonzero(score)
            who, target = np.divmod(hit, n)
            key = (LIMIT - _millionths(score[hit]) << 32) + first + target
            better = key < worst[who + q]
            who, key = who[better], key[better]
            cut = np.searchsorted(who, np.arange(to - q + 1))
            for i in np.flatnonzero(np.diff(cut)):
                new = key[cut[i] : cut[i + 1]]
                both = np.concatenate([best[q + i], new]) if len(best[q + i]) else new.copy()
                if len(both) > k:
                    both = np.partition(both, k - 1)[:k].copy()
                if len(both) == k:
                    worst[q + i] = both.max()
                best[q + i] = both
        q = to


def _rescore(query: np.ndarray, target: np.ndarray, asked: Vectors, texts: pa.ListArray, kind: str, vocabulary: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Millionths of the cosine of each pair, -1 if it shares no term.  Pairs are sorted by query."""
    out = np.full(len(query), -1, np.int64)
    dense = np.zeros(len(vocabulary))
    for first in range(0, len(texts), PIECE):
        here = np.flatnonzero((target >= first) & (target < first + PIECE))
        if not len(here):
            continue
        wanted, local = np.unique(target[here], return_inverse=True)
        piece = Vectors(kind, texts.take(pa.array(wanted)), vocabulary, idf)
        some = piece.size[local] > 0
        here, local = here[some], local[some]
        cut = np.flatnonzero(np.diff(query[here], prepend=-1, append=-1))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            q, rows = query[here[a]], local[a:b]
            mine = slice(asked.start[q], asked.start[q] + asked.size[q])
            dense[asked.place[mine]] = asked.w[mine]
            size = piece.size[rows]
            at = _ranges(piece.start[rows], size)
            score = np.add.reduceat(dense[piece.place[at]] * piece.w[at], np.cumsum(size) - size)
            out[here[a:b]] = np.where(score > 0, _millionths(score), -1)
            dense[asked.place[mine]] = 0
    return out


def _block(table: pa.Table, kinds: list[str], k: int, keep: int | None, least: float | None) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    """(query id, target id, score, rank) of a block."""
    part = table["part"].to_numpy()
    of = lambda p, *names: [table[n].filter(pa.array(part == p)).combine_chunks() for n in names]
    vocabularies = [of(i, "term", "idf") for i in range(len(kinds))]
    vocabularies = [(t, w.to_numpy(zero_copy_only=False)) for t, w in vocabularies]
    (asker, asked), (found, texts) = of(-2, "s1_id", "x"), of(-1, "target_id", "x")
    by_id = pc.sort_indices(found)
    found, texts = found.take(by_id), texts.take(by_id)
    terms, idf = vocabularies[0]
    queries = Vectors(kinds[0], asked, terms, idf)
    best, worst = [np.zeros(0, np.int64)] * len(asked), np.full(len(asked), np.iinfo(np.int64).max)
    for first in range(0, len(texts), PIECE):
        piece = texts.slice(first, PIECE)
        _keep(best, worst, queries, Vectors(kinds[0], piece, terms, idf), len(piece), first, k, len(terms))
    query = np.repeat(np.arange(len(best)), [len(x) for x in best])
    key = np.concatenate([np.zeros(0, np.int64), *best])
    if len(kinds) > 1:
        target = key & PLACE
        score = _rescore(query, target, Vectors(kinds[1], asked, *vocabularies[1]), texts, kinds[1], *vocabularies[1])
        query, key = query[score >= 0], (LIMIT - score[score >= 0] << 32) + target[score >= 0]
    order = np.lexsort((key, query))
    query, key = query[order], key[order]
    size = np.bincount(query, minlength=len(best))
    rank = np.arange(len(query)) - (np.cumsum(size) - size)[query] + 1
    score = (LIMIT - (key >> 32)) / SCALE
    some = np.full(len(query), True)
    if keep is not None:
        some &= rank <= keep
    if least is not None:
        some &= score >= least
    query, key, score, rank = query[some], key[some], score[some], rank[some]
    for i in range(0, len(query), BATCH):
        j = slice(i, i + BATCH)
        yield asker.take(pa.array(query[j])), found.take(pa.array(key[j] & PLACE)), score[j], rank[j].astype(np.int32)


def _let_go() -> None:
    """Hand back to the system what this worker has freed; it stays for later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _results(batches: Iterator[pa.RecordBatch], kinds: list[str], k: int, keep: int | None, least: float | None) -> Iterator[pa.RecordBatch]:
    """The results of a block, from its rows; of these and of what the search has built nothing stays in the worker."""
    for a, b, score, rank in _block(pa.Table.from_batches(list(batches)), kinds, k, keep, least):
        yield pa.RecordBatch.from_arrays([a, b, pa.array(score), pa.array(rank)], ["s1_id", "target_id", "score", "rank"])
        del a, b, score, rank
    _let_go()


def merge(docs: DataFrame) -> DataFrame:
    """(country, id, x): the texts of each id of a country as one array.  Texts are what is shuffled; what is cut from them stays."""
    n = 2 * docs.sparkSession.sparkContext.defaultParallelism
    return docs.select("country", "id", "x").repartition(n, "country", "id").groupBy("country", "id").agg(F.collect_list("x").alias("x"))


def nearest(s1: DataFrame, targets: DataFrame, stages: list[Stage], k: int, keep: int | None = None, least: float | None = None) -> DataFrame:
    """(s1_id, target_id, score, rank): of each query's k best targets of its country by the first stage's terms, those that share
    a term of the last stage, by its score; the `keep` best of these, of at least `least`, if given.  Ties go to the smaller id.

    Inputs have (country, id, x); records of one id and country count as one.  An id of s1 stands in one country.
    """
    spark = s1.sparkSession
    s1_id, target_id = s1.schema["id"].dataType, targets.schema["id"].dataType
    spread = spark.sparkContext.defaultParallelism
    counts = s1.where("country IS NOT NULL").groupBy("country").agg(F.count("*").alias("n"))
    total, countries = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    most = max(QUERIES[0], min(QUERIES[1], -(-total // (2 * spread))))
    # Tasks get blocks in turn; of many small countries, several.
    tasks = max(1, total // most + min(countries, 4 * spread))
    before = Window.orderBy("country").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.withColumn("blocks", F.ceil(F.col("n") / most)).select("country", "blocks", F.coalesce(F.sum("blocks").over(before), F.lit(0)).alias("first"))
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)

    def rows(part: int, df: DataFrame, every: bool, **columns) -> DataFrame:
        """Rows for the one block of an id, or for every block of the country."""
        first, n = F.col("first"), F.col("blocks")
        block = F.explode(F.sequence(first, first + n - 1)) if every else first + F.pmod(F.xxhash64("s1_id"), n)
        fields = {"s1_id": s1_id, "target_id": target_id, "x": S.ArrayType(S.StringType()), "term": S.StringType(), "idf": S.DoubleType()}
        return df.join(F.broadcast(blocks), "country").select(block.alias("block"), F.lit(part).alias("part"), *[columns[n].alias(n) if n in columns else none(n, t) for n, t in fields.items()])

    def merged(df: DataFrame, name: str) -> DataFrame:
        return merge(df).withColumnRenamed("id", name)

    c = F.col
    feed = rows(-2, merged(s1, "s1_id"), False, s1_id=c("s1_id"), x=c("x")).unionByName(rows(-1, merged(targets, "target_id"), True, target_id=c("target_id"), x=c("x")))
    for i, stage in enumerate(stages):
        feed = feed.unionByName(rows(i, stage.vocabulary, True, term=c("term"), idf=c("idf")))
    kinds = [stage.kind for stage in stages]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _results(batches, kinds, k, keep, least)

    schema = S.StructType([S.StructField("s1_id", s1_id), S.StructField("target_id", target_id), S.StructField("score", S.DoubleType()), S.StructField("rank", S.IntegerType())])
    dealt = feed.withColumn("task", (F.col("block") % tasks).cast("int"))
    return dealt.repartitionById(tasks, F.col("task")).groupBy("task", "block").applyInArrow(run, schema)
