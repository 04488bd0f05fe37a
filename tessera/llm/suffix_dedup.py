"""Removal of repeated byte strings by a sparse suffix array over content-defined anchors.

Rule: a byte goes if a SPAN-byte string that covers it also starts earlier (in a smaller key, or earlier in the same
text); strings are judged on the input.

1. Each window of SPAN bytes has an anchor: its first SEED-byte gram of least hash.  Equal windows have equal anchors at
   equal offsets, so only windows of anchors with equal grams need comparing.  The windows of one anchor in one text
   form a stretch; stretches of equal bytes repeat each other's windows, and all but the first of each go at once.
   Each task settles the copies within its own rows and passes on one stretch per distinct content.
2. Stretches meet by gram, one row per gram group piece.  The first of each distinct stretch stays; if a gram has several
   distinct stretches, some of their windows may still be equal.  A window with HALF bytes or more before its gram can
   only equal one with the same HALF bytes there, any other only one with the same HALF bytes behind the gram; hashes
   of both sides tell which windows are left, and only their bytes are fetched.
3. Suffixes: the windows of those stretches are suffixes of their bytes.  Stretches travel by gram, and are taken apart
   where they meet; of a gram with more than HOT stretches each window travels by its own bytes instead, and of equal
   ones in a task only the earliest.  Suffixes are ordered by deep-shallow sorting: multikey quicksort, eight bytes a key, down to SHALLOW bytes, then a blind trie
   per group that shares them all.  Neighbours with a common prefix of SPAN bytes are equal windows, and all but the
   earliest are covered.
4. Covered runs of a document are joined and cut from its text.

Between steps are written tables.  A gram or a passage that a third of the rows hold gives one row per task and
distinct stretch, and no part has to hold the windows of a gram that many texts share.

Edge cases: null and empty texts and texts under SPAN bytes lose nothing; null keys come before all others and rows
with equal keys are taken in the order of their text, and each gets its own result (a table with such rows, or with keys
that are no whole numbers, is sorted and written once, with a number per row that stands for the key in all steps); very
long texts are processed whole, in slices that overlap; an empty table gives no rows; other columns are left out,
whatever their names.

Hashes: polynomials modulo 2 ** 64, which long strings can be written to defeat, are used for grams, stretches and sides
of at most a few hundred bytes, far under the length that takes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, enter, numbered

__all__ = ["anchors", "deep_shallow", "dedup", "equal_runs", "merge"]

SPAN, SEED, SHALLOW = 100, 24, 32
HALF = (SPAN - SEED) // 2
#: Anchors that a task holds before it passes them on.
HELD = 600_000
#: Stretches of a gram that one part may hold.
HOT = 20_000
#: Pieces that gram groups and suffixes are dealt to, per shuffle partition.
PIECES = 4

_rng = np.random.default_rng(19990723)
_BYTE = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95
_OTHER = np.uint64(0x2545F4914F6CDD1D)
SLICE = 1 << 19


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = (np.full(n, x, np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers(SLICE + (1 << 13))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _slice_anchors(raw: np.ndarray) -> tuple[np.ndarray, ...]:
    """gram, content, first, last, place, before, behind of each stretch of a slice: windows [first, last] have one anchor."""
    n, width = len(raw), SPAN - SEED + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _UP[:n], out=total[1:])
    gram = _mix((total[SEED:] - total[:-SEED]) * _DOWN[: n - SEED + 1])
    # Least of each run of `width` grams, the first of equal ones: place in the low bits, running minima in blocks.
    key = (gram & ~np.uint64((1 << 20) - 1)) | np.arange(len(gram), dtype=np.uint64)
    padded = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - SPAN + 1
    at = (np.minimum(right[:windows], left[width - 1 : width - 1 + windows]) & np.uint64((1 << 20) - 1)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    last = np.append(first[1:] - 1, windows - 1)
    place = at[first]
    end = last + SPAN
    content = (total[end] - total[first]) * _DOWN[first]
    # The stretch's bytes, its length and the anchor's place in it.
    content = _mix(content + _OTHER * ((end - first).astype(np.uint64) << np.uint64(20) | (place - first).astype(np.uint64)))
    before = _side(total, np.maximum(place - HALF, 0))
    behind = _side(total, np.minimum(place + SEED, n - HALF))
    return gram[place], content, first, last, place, before, behind


def _side(total: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hashes of HALF bytes; a side that the text is too short for has no window that asks for it."""
    return (_mix((total[start + HALF] - total[start]) * _DOWN[start]) >> np.uint64(48)).astype(np.uint16)


def anchors(text: bytes) -> tuple[np.ndarray, ...]:
    """What _slice_anchors gives, over a whole text; slices share SPAN - 1 bytes, so no window is lost or doubled.

    A stretch that a slice's end cuts is two; both ends still hold all their windows.
    """
    raw = np.frombuffer(text, np.uint8)
    if len(raw) < SPAN:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.uint16, np.uint16))
    parts = []
    for s in range(0, len(raw) - SPAN + 1, SLICE):
        gram, content, first, last, place, *sides = _slice_anchors(raw[s : s + SLICE + SPAN - 1])
        parts.append((gram, content, first + s, last + s, place + s, *sides))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of half-open ranges; touching ones are one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]


def _keys(rows: np.ndarray, depth: int) -> np.ndarray:
    """Eight bytes of each row from depth on, as one number in their order."""
    return np.ascontiguousarray(rows[:, depth : depth + 8]).view(">u8").ravel().astype(np.uint64)


def _blind_trie(rows: np.ndarray, members: np.ndarray, depth: int) -> list[int]:
    """Order of members by their bytes from depth on.

    A node knows only where its children first differ and by which byte; a string is put in by walking down blindly,
    comparing once with any leaf it reached, and splitting the path where the two differ.
    """
    root: list = [int(members[0])]  # leaf: equal strings; node: (place, {byte: child})

    def leaf(node):
        while isinstance(node, tuple):
            node = next(iter(node[1].values()))
        return node

    for m in map(int, members[1:]):
        mine, node = rows[m], root
        while isinstance(node, tuple):
            node = node[1].get(int(mine[node[0]])) or leaf(node)
        other = rows[node[0]]
        differ = np.flatnonzero(mine[depth:] != other[depth:])
        if not len(differ):
            node.append(m)
            continue
        place = int(differ[0]) + depth
        above, byte, node = None, 0, root
        while isinstance(node, tuple) and node[0] < place:
            above, byte = node, int(mine[node[0]])
            node = node[1][byte]
        if isinstance(node, tuple) and node[0] == place:
            node[1][int(mine[place])] = [m]
            continue
        split = (place, {int(other[place]): node, int(mine[place]): [m]})
        if above is None:
            root = split
        else:
            above[1][byte] = split
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        else:
            out += node
    return out


def deep_shallow(rows: np.ndarray) -> np.ndarray:
    """Order of equally long byte strings (a row each).

    Shallow: all groups are parted at once by their next eight bytes, as multikey quicksort does by one, down to
    SHALLOW bytes.  Deep: each group left has one blind trie.
    """
    n, width = rows.shape
    order, group = np.arange(n), np.zeros(n, np.int64)
    live = np.arange(n)
    for depth in range(0, min(SHALLOW, width - 7), 8):
        key = _keys(rows[order[live]], depth)
        by = np.lexsort((key, group[live]))
        order[live] = order[live][by]
        parted = group[live][by]
        key = key[by]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (parted[1:] != parted[:-1])])
        group[live] = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        size = np.diff(np.append(np.flatnonzero(new), len(live)))
        live = live[np.repeat(size, size) > 1]
        if not len(live):
            return order
    heads = np.flatnonzero(np.concatenate([[True], group[live][1:] != group[live][:-1]]))
    for a, z in zip(heads, np.append(heads[1:], len(live)), strict=True):
        at = live[a:z]
        order[at] = _blind_trie(rows, order[at], min(SHALLOW, width))
    return order


def equal_runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and the number of each suffix's run of equal strings."""
    if not len(rows):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = deep_shallow(rows)
    new = np.concatenate([[True], (rows[order[1:]] != rows[order[:-1]]).any(1)])
    return order, np.cumsum(new) - 1


_LINE = np.dtype([("gram", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("first", "<i4"), ("last", "<i4"), ("place", "<i4"), ("before", "<u2"), ("behind", "<u2")])
_ROUTED = pa.schema([("piece", pa.int32()), ("kind", pa.int8()), ("payload", pa.binary())])
_SPANS = np.dtype([("doc", "<i8"), ("start", "<i4"), ("end", "<i4")])


def _planes(a: np.ndarray) -> bytes:
    """Byte by byte, lowest first: the high bytes of small numbers become runs of zeros, which Spark's codec packs."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _from_planes(raw: memoryview, kind: str) -> np.ndarray:
    a = np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(a.T).view(kind).ravel()


def _to_payload(lines: np.ndarray) -> bytes:
    """Columns of lines in the order of documents; documents as differences, places from the first window."""
    lines = lines[np.lexsort((lines["first"], lines["doc"]))]
    doc, first = np.diff(lines["doc"], prepend=np.int64(0)), np.ascontiguousarray(lines["first"])
    short = [(lines[c] - first).astype(np.uint8) for c in ("last", "place")]
    return b"".join([_planes(doc), _planes(first), *(x.tobytes() for x in short), *(np.ascontiguousarray(lines[c]).tobytes() for c in ("gram", "content", "before", "behind"))])


def _from_payload(raw: bytes) -> np.ndarray:
    n = len(raw) // 34
    at, out = memoryview(raw), np.empty(n, _LINE)
    out["doc"], out["first"] = np.cumsum(_from_planes(at[: 8 * n], "<i8")), _from_planes(at[8 * n : 12 * n], "<i4")
    out["last"] = out["first"] + np.frombuffer(at[12 * n : 13 * n], np.uint8)
    out["place"] = out["first"] + np.frombuffer(at[13 * n : 14 * n], np.uint8)
    for c, a, z in (("gram", 14, 22), ("content", 22, 30), ("before", 30, 32), ("behind", 32, 34)):
        out[c] = np.frombuffer(at[a * n : z * n], _LINE[c])
    return out


def _repeats(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines by gram, content, document and place; and whether each repeats the one before."""
    lines = lines[np.lexsort((lines["first"], lines["doc"], lines["content"], lines["gram"]))]
    again = np.concatenate([[False], (lines["gram"][1:] == lines["gram"][:-1]) & (lines["content"][1:] == lines["content"][:-1])])
    return lines, again


def _covered(lines: np.ndarray) -> np.ndarray:
    """Merged spans of repeated lines, document by document."""
    lines = lines[np.lexsort((lines["first"], lines["doc"]))]
    # One axis for all documents: each has its own range, wider than any text.
    start = lines["first"].astype(np.int64)
    end = lines["last"].astype(np.int64) + SPAN
    wide = int(end.max(initial=0)) + 2
    _, number = np.unique(lines["doc"], return_inverse=True)
    a, z = merge(start + number * wide, end + number * wide)
    docs = np.unique(lines["doc"])
    out = np.empty(len(a), _SPANS)
    out["doc"], out["start"], out["end"] = docs[a // wide] if len(docs) else 0, a % wide, z - a // wide * wide if len(a) else z
    return out


def _route_anchors(pieces: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("suffix_dedup")
        held, size = [], 0

        def close():
            lines, again = _repeats(np.concatenate(held))
            rows: list[tuple[int, int, bytes]] = []
            spans = _covered(lines[again])
            rows += _dealt(spans, (spans["doc"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(pieces), 1)
            lines = lines[~again]
            rows += _dealt(lines, lines["gram"] % np.uint64(pieces), 0)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ROUTED.types, strict=True)], schema=_ROUTED)

        for b in batches:
            for doc, t in zip(b.column(0), b.column(1), strict=True):
                gram, content, first, last, place, before, behind = anchors((t.as_py() or "").encode("utf-8", "surrogatepass"))
                if len(gram):
                    lines = np.empty(len(gram), _LINE)
                    lines["gram"], lines["content"], lines["doc"] = gram, content, doc.as_py()
                    lines["first"], lines["last"], lines["place"] = first, last, place
                    lines["before"], lines["behind"] = before, behind
                    held.append(lines)
                    size += len(lines)
                    if size >= HELD:
                        yield close()
                        held, size = [], 0
        if held:
            yield close()

    return run


def _dealt(lines: np.ndarray, piece: np.ndarray, kind: int) -> list[tuple[int, int, bytes]]:
    """A row per piece that has lines."""
    if not len(lines):
        return []
    order = np.argsort(piece, kind="stable")
    piece, lines = piece[order].astype(np.int64), lines[order]
    cut = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]])) 
    packed = _to_payload if kind == 0 else (lambda x: x.tobytes())
    return [(int(piece[a]), kind, packed(lines[a:z])) for a, z in zip(cut, np.append(cut[1:], len(piece)), strict=True)]


def _shared(gram: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Whether another line has the same gram and side."""
    order = np.lexsort((side, gram))
    same = (gram[order][1:] == gram[order][:-1]) & (side[order][1:] == side[order][:-1])
    out = np.zeros(len(gram), bool)
    out[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(gram) else False
    return out


_FOUND = "kind tinyint, doc long, first int, last int, place int, gram long"


def _found(kind: int, doc, first, last, place=None, gram=None) -> pa.RecordBatch:
    n = len(doc)
    zero = np.zeros(n, np.int32)
    columns = [np.full(n, kind, np.int8), doc, first, last, zero if place is None else place, np.zeros(n, np.int64) if gram is None else gram]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["kind", "doc", "first", "last", "place", "gram"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 1: spans that go; kind 0: windows to compare, of distinct stretches of grams that have several; kind 2: those of hot grams."""
    now, held, spans = None, [], []

    def close():
        lines, again = _repeats(np.concatenate([_from_payload(x) for x in held]))
        gone = _covered(lines[again])
        yield _found(1, gone["doc"], gone["start"], gone["end"])
        lines = lines[~again]
        left, right = (_shared(lines["gram"], lines[side]) for side in ("before", "behind"))
        first = np.where(left, lines["first"], np.maximum(lines["first"], lines["place"] - HALF + 1))
        last = np.where(right, lines["last"], np.minimum(lines["last"], lines["place"] - HALF))
        some = (left | right) & (first <= last)
        _, group, size = np.unique(lines["gram"], return_inverse=True, return_counts=True)
        hot = size[group] > HOT if len(group) else some
        for kind, one in ((0, some & ~hot), (2, some & hot)):
            yield _found(kind, lines["doc"][one], first[one], last[one], lines["place"][one], lines["gram"][one].view(np.int64))

    for b in batches:
        for piece, kind, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if kind == 1:
                s = np.frombuffer(payload.as_py(), _SPANS)
                yield _found(1, s["doc"], s["start"], s["end"])
                continue
            if piece != now and held:
                yield from close()
                held = []
            now = piece
            held.append(payload.as_py())
    if held:
        yield from close()


_SUFFIX = pa.schema([("piece", pa.int32()), ("doc", pa.int64()), ("start", pa.int32()), ("suffix", pa.binary())])


def _suffixes(pieces: int):
    """Rows (piece, doc, start, bytes): every SPAN bytes of a row's bytes are a window.  Piece -1: a window that goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, tuple[int, int]] = {}  # of the hot windows so far, begun anew when it is large
        for b in batches:
            piece, docs, starts, found = [], [], [], []

            def add(to, doc, start, raw):
                piece.append(to)
                docs.append(doc)
                starts.append(start)
                found.append(raw)

            for doc, text, asked in zip(b.column(0), b.column(1), b.column(2), strict=True):
                raw, doc = (text.as_py() or "").encode("utf-8", "surrogatepass"), doc.as_py()
                for x in asked.as_py():
                    if x["kind"] == 0:
                        add((x["gram"] & ((1 << 64) - 1)) % pieces, doc, x["first"], raw[x["first"] : x["last"] + SPAN])
                        continue
                    for start in range(x["first"], x["last"] + 1):
                        window = raw[start : start + SPAN]
                        if (doc, start) > first.setdefault(window, (doc, start)):
                            add(-1, doc, start, None)
                        else:
                            first[window] = (doc, start)
                            add(xxhash.xxh3_64_intdigest(window) % pieces, doc, start, window)
            if len(first) > 400_000:
                first.clear()
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(docs, pa.int64()), pa.array(starts, pa.int32()), pa.array(found, pa.binary())], schema=_SUFFIX)

    return run


def _order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of windows that equal an earlier one, part by part."""
    now, held = None, []

    def close():
        docs, starts = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        rows = np.concatenate([x[2] for x in held])
        order, run = equal_runs(rows)
        by = np.lexsort((starts[order], docs[order], run))
        again = np.concatenate([[False], run[by][1:] == run[by][:-1]])
        late = order[by][again]
        yield _found(1, docs[late], starts[late], starts[late] + SPAN)

    for b in batches:
        piece = b.column(0).to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]])) if len(piece) else []
        for a, z in zip(cut, [*cut[1:], len(piece)], strict=True):
            if piece[a] < 0:
                starts = b.column(2).to_numpy()[a:z]
                yield _found(1, b.column(1).to_numpy()[a:z], starts, starts + SPAN)
                continue
            if piece[a] != now and held:
                yield from close()
                held = []
            now = piece[a]
            raw = b.column(3).slice(a, z - a).to_pylist()
            size = np.array([len(x) for x in raw]) - SPAN + 1
            base = np.cumsum([0, *map(len, raw)])[:-1]
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            at = np.repeat(base, size) + inner
            rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join(raw), np.uint8), SPAN)[at]
            held.append((np.repeat(b.column(1).to_numpy()[a:z], size), np.repeat(b.column(2).to_numpy()[a:z], size) + inner.astype(np.int32), rows))
    if held:
        yield from close()


def _cut(key: str, texts: bool):
    names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("suffix_dedup")
        for b in batches:
            n, removed, spans, digest, left = [], [], [], [], []
            for text, asked in zip(b.column(1), b.column(2), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                s = asked.as_py() or []
                start, end = merge(np.array([x["first"] for x in s], np.int64), np.array([x["last"] for x in s], np.int64))
                kept, at = [], 0
                for a, z in zip(start.tolist(), end.tolist(), strict=True):
                    kept.append(raw[at:a])
                    at = z
                kept = b"".join([*kept, raw[at:]]) if kept else raw
                n.append(len(raw))
                removed.append(len(raw) - len(kept))
                spans.append(len(start))
                digest.append(hashlib.sha256(kept).hexdigest())
                if texts:
                    left.append(kept)
            columns = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, *([pa.array(left, pa.binary())] if texts else [])], names)

    return run


def dedup(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 of every row, and with `texts` kept (binary), what is left."""
    spark = docs.sparkSession
    pieces = PIECES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = numbered(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), scratch, pieces)
    rows = keyed.select("doc", "text")

    def first() -> DataFrame:
        routed = rows.mapInArrow(_route_anchors(pieces), "piece int, kind tinyint, payload binary")
        return routed.repartition("piece").sortWithinPartitions("piece").mapInArrow(_meet, _FOUND)

    def second() -> DataFrame:
        asked = met.where("kind <> 1").groupBy("doc").agg(F.collect_list(F.struct("kind", "first", "last", "place", "gram")).alias("asked"))
        found = rows.join(asked, "doc").select("doc", "text", "asked").mapInArrow(_suffixes(pieces), "piece int, doc long, start int, suffix binary")
        # Settled rows (piece -1) travel by their document.
        dealt = found.withColumn("to", F.when(F.col("piece") < 0, F.col("doc")).otherwise(F.col("piece").cast("long")))
        return dealt.repartition("to").sortWithinPartitions("piece").select("piece", "doc", "start", "suffix").mapInArrow(_order, _FOUND)

    met = scratch.save(first(), "met")
    late = scratch.save(second(), "late")
    gone = met.where("kind = 1").union(late).select("doc", "first", "last")
    spans = gone.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    fields = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return keyed.join(spans, "doc", "left").select("key", "text", "spans").mapInArrow(_cut(key, texts), fields)
