"""Byte-pair encoding by backtracking over Aho-Corasick matches, and decoding through an offset table.

A tokenizer file (public JSON layout: vocab, merges, added tokens) is a parameter.  Encoding never replays the merge
loop over a text.  An Aho-Corasick automaton over the vocabulary reports every token match of a piece in one pass;
the encoder walks from the left, takes the longest match and keeps it only if it is compatible with the token before
it, else tries the next shorter one, else steps back.  Two tokens are compatible when merging their joined units gives
exactly these two tokens; a sequence whose neighbours are all compatible is *the* merge result, and each prefix has
one such sequence, so a position that failed once is never entered again and the walk is linear.

Edge cases: null and empty texts give no ids.  Strings of added tokens inside a text give those tokens' ids.  Texts of
any length are encoded whole.  Repeated rows give repeated results; an empty table gives none.  A column that has the
name of an operator's output is refused.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held, new_column

__all__ = ["Bpe", "Cache", "bpe", "decode", "default_path", "encode", "round_trip_digests"]

END = "\x00"  # stands for the end-of-word mark; the byte alphabet has no such character
SPACE = "\t-\r \x85\xa0  -     　"
#: Entries of a generation of a chunk cache; two generations are kept.
CACHE = 150_000
#: Entries of a generation of the pair-compatibility table.
PAIRS = 200_000


def default_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_alphabet() -> list[str]:
    """Character of each byte: printable Latin-1 ones stand for themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in out:
            out[b] = chr(0x100 + len(out) - len(shown))
    return [out[b] for b in range(256)]


def chunker(spaced: bool):
    """Splits a text into chunks that hold whole pieces, so that each is encoded once and looked up after that.

    A run of common letters ends a chunk where white space or ASCII punctuation but for an apostrophe follows, else
    white space does.  spaced: white space belongs to the pieces; a blank goes with the word after it.
    """
    letters = r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+" + rf"(?=[{SPACE}!-&(-/:-@\[-`{{-~]|\Z)"
    if spaced:
        return re.compile(rf" ?{letters}| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
    return re.compile(rf"{letters}|[^{SPACE}]+").findall


class Cache(dict):
    """Chunk to value; two generations, so that memory is bounded and frequent chunks stay."""

    def __init__(self, make, most: int = CACHE):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


class Bpe:
    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.tokens: list[str] = [""] * (1 + max([*model["vocab"].values(), *(a["id"] for a in spec["added_tokens"])]))
        for s, i in model["vocab"].items():
            self.tokens[i] = s
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for s, i in self.special.items():
            self.tokens[i] = s
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.lower = bool(spec["normalizer"])  # the word vocabulary: NFC, then lower case character by character
        self.alphabet = byte_alphabet()
        key = {s: self._key(s) for s in model["vocab"]}
        self.id_of = {key[s]: i for s, i in model["vocab"].items()}
        self.merge: dict[int, int] = {}  # both tokens to the merge's rank and the token it gives, 32 bits each
        for rank, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in model["merges"]):
            a, b = self._key(a), self._key(b)
            self.merge.setdefault(self.id_of[a] << 32 | self.id_of[b], rank << 32 | self.id_of[a + b])
        self.keys = {i: s for s, i in self.id_of.items()}
        self.match = ahocorasick.Automaton()
        for s, i in self.id_of.items():
            self.match.add_word(s, (len(s), i))
        self.match.make_automaton()
        self.compatible = Cache(self._fits, PAIRS)
        self.alone = Cache(lambda b: self.merged(self._units(self.keys[b])) == [b], len(self.keys))
        words, rest = r"'s|'t|'re|'ve|'m|'ll|'d|", rf"[^{SPACE}\p{{L}}\p{{N}}]+"
        self.pieces = regex.compile(
            words + rf"\p{{L}}+|\p{{N}}|{rest}" if self.lower else words + rf" ?\p{{L}}+| ?\p{{N}}+| ?{rest}|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
        )
        self.chunks_of = chunker(spaced=not self.lower)
        self.chunks = Cache(self._chunk)
        if spec["decoder"] is None:  # tokens joined by a space
            parts = [(t + " ").encode() for t in self.tokens]
        else:
            back = {c: b for b, c in enumerate(self.alphabet)}
            parts = [bytes(back[c] for c in t) if i not in self.special.values() else t.encode() for i, t in enumerate(self.tokens)]
        self.joined = spec["decoder"] is None
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.offsets = np.cumsum([0, *map(len, parts)], dtype=np.int64)
        del self.tokens
        # Of the vocabulary only single characters are looked up by their string from here on.
        self.id_of = {s: i for s, i in self.id_of.items() if len(s.removesuffix(END)) == 1}

    def _key(self, s: str) -> str:
        return s[: -len(self.suffix)] + END if self.suffix and s.endswith(self.suffix) else s

    def _units(self, s: str) -> list[int]:
        if s.endswith(END):
            return [self.id_of[c] for c in s[:-2]] + [self.id_of[s[-2:]]]
        return [self.id_of[c] for c in s]

    def merged(self, units: list[int]) -> list[int]:
        """The merge loop itself; only pairs of tokens and single tokens ever go through it."""
        units = list(units)
        while len(units) > 1:
            ranked = [(m, i) for i, (a, b) in enumerate(zip(units, units[1:], strict=False)) if (m := self.merge.get(a << 32 | b)) is not None]
            if not ranked:
                break
            m, i = min(ranked)
            units[i : i + 2] = [m & 0xFFFFFFFF]
        return units

    def _fits(self, pair: int) -> bool:
        """Whether the second token of a pair (a << 32 | b) may follow the first."""
        a, b = pair >> 32, pair & 0xFFFFFFFF
        return self.merged(self._units(self.keys[a]) + self._units(self.keys[b])) == [a, b]

    def piece(self, s: str) -> list[int]:
        """Ids of a piece in the byte alphabet, with END if the vocabulary marks word ends."""
        n = len(s)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (length, i) in self.match.iter(s):
            at[end - length + 1].append((length, i))  # ends ascend, so the longest comes last
        out: list[int] = []
        starts: list[int] = []
        dead = bytearray(n + 1)
        pos, compatible, alone = 0, self.compatible, self.alone
        while pos < n:
            before = out[-1] << 32 if out else -1
            for length, i in reversed(at[pos]):
                if not dead[pos + length] and (before < 0 or compatible[before | i]) and alone[i]:
                    out.append(i)
                    starts.append(pos)
                    pos += length
                    break
            else:
                dead[pos] = 1
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                out.pop()
                pos = starts.pop()
        return out

    def _chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        for part in self.special_split.split(chunk) if self.special else [chunk]:
            if part in self.special:
                ids.append(self.special[part])
                continue
            if self.lower:
                part = "".join(c.lower() for c in unicodedata.normalize("NFC", part))
            for p in self.pieces.findall(part):
                mapped = "".join([self.alphabet[b] for b in p.encode()])
                ids += self.piece(mapped + END if self.suffix else mapped)
        return np.array(ids, "<u4").tobytes()

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids of a whole text, little-endian 32-bit."""
        if not text:
            return b""
        # Added tokens split a text before anything else does.
        parts = self.special_split.split(text) if self.special else [text]
        chunks = self.chunks
        return b"".join(x for p in parts for x in map(chunks.__getitem__, [p] if p in self.special else self.chunks_of(p)))

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), "<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """One gather: token lengths from the offset table give the place of each output byte."""
        if not len(ids):
            return b""
        start = self.offsets[ids]
        size = self.offsets[ids + 1] - start
        ends = np.cumsum(size)
        out = self.blob[np.repeat(start - (ends - size), size) + np.arange(ends[-1])].tobytes()
        return out[:-1] if self.joined else out

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


def bpe(path: str) -> Bpe:
    return held("bpe", path, lambda: Bpe(path))


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns of df and `out`, the ids of each whole text as array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for b in batches:
            ids = [model.encode(t.as_py()).astype(np.int32) for t in b.column(b.schema.get_field_index(text))]
            lists = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate([*ids, np.empty(0, np.int32)]))
            )
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, out])

    return new_column(df, out).mapInArrow(run, df.withColumn(out, F.lit(None).cast("array<int>")).schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of df and `out`, the text of each list of ids (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for b in batches:
            texts = [model.decode(np.array(x.as_py() or [], np.int64)) for x in b.column(b.schema.get_field_index(ids))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, out])

    return new_column(df, out).mapInArrow(run, df.withColumn(out, F.lit(None).cast("string")).schema)


def round_trip_digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, so that ids never cross to the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for b in batches:
            rows = []
            for t in b.column(1):
                raw = model.encode_bytes(t.as_py())
                back = model.decode_bytes(np.frombuffer(raw, "<u4").astype(np.int64))
                if not model.joined:
                    back = back.decode("utf-8", "replace").encode()
                rows.append((len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(back).hexdigest()))
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
