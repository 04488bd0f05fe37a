"""Token-id files: Simple-8b words in segments with block offsets.

A 64-bit word holds a 4-bit selector and 60 payload bits.  Selector s < 15 says how many ids of how many bits the
word packs; selector 15 is an escape whose payload is a row of the segment's table of ids of 60 bits and more.  Ids are
packed greedily, never across a block of BLOCK ids, and the segment stores the word at which each block begins, so that
a reader decodes any block alone and all blocks of a segment at once with array operations.

Segment layout (little-endian): magic, n_docs, n_ids, n_words, n_escapes, n_blocks, key bytes as 7 x u64; then id offsets
of documents (u64, n_docs + 1), word offsets of blocks (u64, n_blocks + 1), escapes (u64), words (u64), and the documents'
keys as an Arrow stream of one column, so that they keep their type and nulls.

Segments are rows (part, seq, rel_start, n_ids, payload) of a table: Spark's writer commits them, so a lost executor's
half-written file is never read.  Parts ascend with the document key; rel_start counts from the part's first id.  A
segment closes at the first document end past SEGMENT ids, so its size is bounded by that and one document.

Encoding: the ranks of the tokenizer's merges, by the byte-pair routine of tiktoken.  A text takes the library itself if
it holds an added token's string, a character outside PLAIN (classes of the others are the same in both), or a stretch of
over LONG bytes without or of white space only; so does every text if the vocabulary is not one of ranks.

Edge cases: null texts are empty documents, which still hold the end id; equal keys keep an order fixed by their text;
null keys come first; an empty table gives an empty file; texts of any length are encoded whole; other columns, whatever
their names, are left out.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import byte_alphabet
from tessera.llm.common import held

__all__ = ["Segment", "encoder", "pack", "read_segments", "read_table", "unpack", "write_segments", "write_table"]

#: Ids of a word and bits of each, by selector (fixed values of the Simple-8b format).
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2])
#: The first two selectors are runs of zeros; a lone id at the end of a block is a pair with one member.
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30])
ESCAPE = 15
SELECTOR = np.full(256, ESCAPE, np.uint8)
SELECTOR[COUNTS] = np.arange(len(COUNTS))
MAGIC = 0x3242385345544F4B
BLOCK = 8192
SEGMENT = 1 << 18
#: Latin, Greek, Cyrillic, general punctuation, kana, common ideographs, hangul.
ODD = re.compile("[^\x00-\u052f\u2010-\u2027\u2030-\u205e\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")
LONG = 1000
#: How a byte-level vocabulary parts a text (a fixed value of the public format).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    high = ids >> np.uint64(32)
    low = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], low).astype(np.uint8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, block offsets and escapes of ids (u64).  Ids of over 30 bits are escaped."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.zeros(1, np.uint64), np.empty(0, np.uint64)
    # Widest member of each run of 2, 3, ... ids, a block a row; what follows a block is too wide for any word.
    wide = np.full((-(-n // BLOCK), BLOCK + int(COUNTS[0])), 255, np.uint8)
    flat = np.full(wide.shape[0] * BLOCK, 255, np.uint8)
    flat[:n] = bit_lengths(ids)
    wide[:, :BLOCK] = flat.reshape(-1, BLOCK)
    take = np.ones_like(wide)
    top, span = wide, 1
    least = int(flat.min())
    for count, width in zip(COUNTS[::-1].tolist(), WIDTHS[::-1].tolist(), strict=True):
        if width < least:
            break
        while span < count:
            step = min(span, count - span)
            top = np.maximum(top[:, : top.shape[1] - step], top[:, step:])
            span += step
        np.putmask(take[:, : top.shape[1]], top <= width, count)
    take = take[:, :BLOCK].reshape(-1)[:n]
    kind = SELECTOR[take]
    last = np.append(np.arange(BLOCK - 1, n - 1, BLOCK), n - 1)
    lone = last[(take[last] == 1) & (flat[last] <= 30)]  # a pair with one member, told by the end of the block
    kind[lone] = 14
    steps, heads, i = take.tolist(), [], 0
    while i < n:
        heads.append(i)
        i += steps[i]
    at = np.array(heads, np.int64)
    sel = kind[at]
    words = sel.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(1, np.uint64)])
    for s, (count, width) in enumerate(zip(COUNTS.tolist(), WIDTHS.tolist(), strict=True)):
        mine = np.flatnonzero(sel == s)
        if width and len(mine):
            alone = take[at[mine]] == 1 if count == 2 else np.zeros(len(mine), bool)
            for j in range(count):
                where = np.where(alone & (j > 0), n, at[mine] + j)
                words[mine] |= padded[where] << np.uint64(j * width)
    escaped = np.flatnonzero(sel == ESCAPE)
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64)
    blocks = np.searchsorted(at, np.arange(0, n + BLOCK, BLOCK).clip(max=n)).astype(np.uint64)
    return words, blocks[: -(-n // BLOCK) + 1], ids[at[escaped]]


def unpack(words: np.ndarray, blocks: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """Ids (u64) of all blocks at once."""
    if not len(words):
        return np.empty(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = np.append(COUNTS, 1)[sel]
    ends = blocks[1:].astype(np.int64) - 1  # the last word of a block may hold one id of a pair
    before = np.concatenate([[0], np.cumsum(counts)])
    firsts = blocks[:-1].astype(np.int64)
    size = np.minimum(BLOCK, n - BLOCK * np.arange(len(firsts)))
    counts[ends] -= before[ends + 1] - before[firsts] - size
    starts = np.cumsum(counts) - counts
    out = np.zeros(n, np.uint64)
    for s, (count, width) in enumerate(zip(COUNTS.tolist(), WIDTHS.tolist(), strict=True)):
        mine = np.flatnonzero(sel == s)
        if width and len(mine):
            mask = np.uint64((1 << width) - 1)
            for j in range(count):
                live = mine if j == 0 or count != 2 else mine[counts[mine] > j]
                out[starts[live] + j] = (words[live] >> np.uint64(j * width)) & mask
    mine = np.flatnonzero(sel == ESCAPE)
    out[starts[mine]] = escapes[(words[mine] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


def to_segment(keys: pa.Array, ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate([*ids, np.empty(0, np.uint32)]).astype(np.uint64)
    words, blocks, escapes = pack(flat)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("key", keys.type)])) as stream:
        stream.write_batch(pa.record_batch([keys], ["key"]))
    named = sink.getvalue().to_pybytes()
    head = np.array([MAGIC, len(keys), len(flat), len(words), len(escapes), len(blocks) - 1, len(named)], np.uint64)
    offsets = np.cumsum([0, *map(len, ids)]).astype(np.uint64)
    return b"".join([*(x.tobytes() for x in (head, offsets, blocks, escapes, words)), named])


class Segment:
    """A segment's parts; ids are unpacked only as they are asked for."""

    def __init__(self, raw: bytes):
        magic, docs, self.n_ids, n_words, n_escapes, n_blocks, named = map(int, np.frombuffer(raw, np.uint64, 7))
        if magic != MAGIC:
            raise ValueError("not a token segment")
        cut = np.cumsum([7, docs + 1, n_blocks + 1, n_escapes, n_words]).tolist()
        a = np.frombuffer(raw, np.uint64, cut[-1])
        self.offsets, self.blocks, self.escapes, self.words = (a[i:j] for i, j in zip(cut, cut[1:], strict=False))
        self._named = pa.py_buffer(raw).slice(8 * cut[-1], named)

    def keys(self) -> pa.Array:
        return pa.ipc.open_stream(self._named).read_all().column(0).combine_chunks()

    def ids(self) -> np.ndarray:
        return unpack(self.words, self.blocks, self.escapes, self.n_ids)

    def block(self, i: int) -> np.ndarray:
        """Ids of one block, from its words alone."""
        a, z = map(int, self.blocks[i : i + 2])
        return unpack(self.words[a:z], np.array([0, z - a], np.uint64), self.escapes, min(BLOCK, self.n_ids - i * BLOCK))

    def document(self, i: int) -> np.ndarray:
        """Ids of one document, from the blocks that hold it."""
        a, z = map(int, self.offsets[i : i + 2])
        if a == z:
            return np.empty(0, np.uint64)
        first = a // BLOCK
        return np.concatenate([self.block(b) for b in range(first, (z - 1) // BLOCK + 1)])[a - first * BLOCK : z - first * BLOCK]


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Bytes of each token, if ids follow the order of merges; a merged token then tells its merge."""
    model = spec["model"]
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix") or spec["normalizer"]:
        return None
    before = spec["pre_tokenizer"] or {}
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    merged = ["".join(x if isinstance(x, list) else x.split(" ")) for x in model["merges"]]
    ids = [model["vocab"][m] for m in merged]
    special = {a["content"] for a in spec["added_tokens"]}
    if ids != sorted(set(ids)) or len(ids) + 256 != len(model["vocab"].keys() - special):
        return None
    back = {c: b for b, c in enumerate(byte_alphabet())}
    return {bytes(back[c] for c in s): i for s, i in model["vocab"].items() if s not in special}


def _simple(text: str) -> bool:
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        if ODD.search(text):
            return False
        raw = text.encode()
    if len(raw) <= LONG:
        return True
    blank = np.frombuffer(raw, np.uint8) <= 32
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    return len(edge) > 0 and int(max(edge[0], len(raw) - edge[-1], np.diff(edge).max(initial=0))) <= LONG


def _encoder(path: str) -> Callable[[str], bytes]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    marks = [x.content for x in lib.get_added_tokens_decoder().values()]
    with open(path, encoding="utf-8") as f:
        ranks = _ranks(json.load(f))
    fast = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def run(text: str) -> bytes:
        if fast and not any(m in text for m in marks) and _simple(text):
            return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return np.array(lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    return run


def encoder(path: str) -> Callable[[str], bytes]:
    """Text to bytes of ids, as the tokenizers library gives them."""
    return held("token_codec", path, lambda: _encoder(path))


def write_segments(df: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (part, seq, rel_start, n_ids, payload) in ascending order of key; lazily, for a writer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = encoder(path), np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        seq, start, size, keys, ids = 0, 0, 0, [], []

        def close():
            nonlocal seq, start, size, keys, ids
            row = [[part], [seq], [start], [size], [to_segment(pa.concat_arrays(keys), ids)]]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], ["part", "seq", "rel_start", "n_ids", "payload"])
            seq, start, size, keys, ids = seq + 1, start + size, 0, [], []
            return out

        for b in batches:
            first = 0
            for i, t in enumerate(b.column(1)):
                ids.append(np.frombuffer(ids_of(t.as_py() or "") + end, "<u4"))
                size += len(ids[-1])
                if size >= SEGMENT:
                    keys.append(b.column(0).slice(first, i + 1 - first))
                    first = i + 1
                    yield close()
            keys.append(b.column(0).slice(first))
        if ids:
            yield close()

    ordered = df.select(F.col(key).alias("key"), F.col(text).alias("text")).repartitionByRange("key").sortWithinPartitions("key", "text")
    return ordered.mapInArrow(run, "part int, seq long, rel_start long, n_ids long, payload binary")


def read_segments(segments: DataFrame, row, fields: str, names: list[str], key: str = "doc_id", kind: str = "long") -> DataFrame:
    """key and what row(start, ids) gives (fields, names), for each document; kind is the type of the keys.

    Starts: the sums of earlier parts, broadcast.  Its size is proven: a row per partition of the writing job.
    """
    sums = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = segments.join(F.broadcast(base), "part").select((F.col("base") + F.col("rel_start")).alias("start"), "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, raw in zip(b.column(0), b.column(1), strict=True):
                one = Segment(raw.as_py())
                offsets, ids = one.offsets.astype(np.int64).tolist(), one.ids()
                rows = [row(start.as_py() + i, ids[i:j]) for i, j in zip(offsets, offsets[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([one.keys(), *(pa.array(v) for v in zip(*rows, strict=True))], [key, *names])

    return placed.mapInArrow(run, f"{key} {kind}, {fields}")


def write_table(df: DataFrame, at: str, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    write_segments(df, path, end_id, key, text).write.parquet(at)


def read_table(segments: DataFrame, key: str = "doc_id", kind: str = "long") -> DataFrame:
    """key, start, n_tokens, ids_crc32 of each document."""

    def row(start: int, ids: np.ndarray):
        return start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())

    return read_segments(segments, row, "start long, n_tokens long, ids_crc32 long", ["start", "n_tokens", "ids_crc32"], key, kind)
