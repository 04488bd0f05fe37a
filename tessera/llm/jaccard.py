"""Exact Jaccard join of word-shingle sets by signature trees, and the components of its links.

1. Equal sets are one class; its smallest key represents it.
2. Two sets at the threshold share one of their first tokens (a prefix of n - ceil(t * n) + 1) in any order common to
   all.  A token is a shingle's hash under its commonness, the sum of the logarithms of its words' counts over all
   documents; shingles that are themselves frequent come last, by their counts (tables of at most COMMON words and COMMON
   shingles, the most frequent ones).  So shingles of rare words come first, and neither chance nor a passage which many
   documents share brings documents together.  Which order holds changes the work, never the result.
3. Each prefix token leads to the smallest key that has it.  All sets led to one key, and of neighbouring sizes (classes
   in the ratio of the threshold, each set in its own and the next), are a block; every pair that shares a prefix token
   and may reach the threshold meets in one, so joining within blocks loses no pair.  Blocks first see bitmaps of a
   bit a token only: a set that no other of its block can overlap enough leaves it.
4. A block is joined by a signature tree: nodes over sets in order of size hold OR- and AND-combined bitmaps and
   the range of sizes.  A dual traversal drops node pairs whose largest possible overlap is too small, and pairs whose
   sets are all connected already; what is left is compared exactly.  Only links that connect something are
   returned, so a block of many near copies gives as many links as it has members.
5. A block of more than BLOCK sets or TOKENS tokens is dealt out in parts that each hold its first set.  Sets that did not get connected
   to it there visit the other parts in a second step; connected ones need no more links.
6. Components: stars are merged until nothing changes, with written tables between rounds.

Broadcast: the tables of common words and shingles (bounded by COMMON), and the blocks of sets only while they take
BROADCAST bytes at most; beyond that the documents are joined by a shuffle.

Tokens are compared, not texts: two shingles count as one if their hashes of HASH_BITS bits (of 64-bit word hashes, which
no text can be written to make collide but by search) are equal, for which the odds are 2 ** -HASH_BITS a pair.

Words are what white space [\\x20\\x09-\\x0D] parts, after A-Z are lowered.  Edge cases: texts without words and nulls
have no shingles and are linked with nothing, so each is its own component; fewer words than a shingle's are one shingle;
texts of any length are read whole.  Rows whose keys repeat or are null, and keys that are no whole numbers, are numbered
first (`numbered`), so each row is linked by its own text; a component's id is then its smallest key that is not null.
Ties cannot occur, as links do not depend on any order; an empty table gives no rows; other columns are left out,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, enter, numbered, small

__all__ = ["Forest", "Table", "components", "connected", "join_block", "keep_first", "needed", "shingle_lists", "shingles"]

COMMON = 1 << 18
BLOCK, TOKENS = 3000, 4_000_000
WORDS64 = 32  # 64-bit words of a bitmap
FANOUT = 8
#: Words that a task counts at a time, and the count from which it reports a word or a shingle.
HELD, REPORT = 1_000_000, 4
#: A token's commonness takes its top bits: up to PLAIN by its words, above by its own count, if that is FREQUENT or more.
SCALE, HASH_BITS, PLAIN, FREQUENT = 3.0, 48, 95, 64
#: Words of more bytes are hashed one by one.
LONG = 256

_rng = np.random.default_rng(20240229)
_PLACE = _rng.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ h >> np.uint64(33)


class _Lookup:
    """Numbers of at most COMMON hashes; a table of bits turns most others away."""

    def __init__(self, hashes: np.ndarray, numbers: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], numbers[order].astype(np.int16)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int16)
        maybe = np.flatnonzero(self.bits[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if len(maybe):
            asked = hashes[maybe]
            at = np.minimum(np.searchsorted(self.hashes, asked), len(self.hashes) - 1)
            out[maybe] = np.where(self.hashes[at] == asked, self.numbers[at], 0)
        return out


class Table:
    """Commonness of words (scaled logarithms of counts) and of frequent shingles (over PLAIN, by count)."""

    def __init__(self, words: tuple[np.ndarray, np.ndarray], frequent: tuple[np.ndarray, np.ndarray]):
        self.words = _Lookup(words[0], np.round(np.log2(words[1].astype(float)) * SCALE))
        steps = np.log2(frequent[1].astype(float) / FREQUENT)
        self.frequent = _Lookup(frequent[0], np.minimum(PLAIN + 1 + steps * 1.25, 127).astype(np.int16))

    def levels(self, word: np.ndarray, shingle: np.ndarray) -> np.ndarray:
        """Of shingles (hashes of HASH_BITS) of the words, one beginning at each word but the last."""
        k = len(word) - len(shingle) + 1
        total = np.concatenate([[0], np.cumsum(self.words.of(word), dtype=np.int64)])
        plain = np.minimum(total[k:] - total[:-k], PLAIN)
        return np.maximum(plain, self.frequent.of(shingle)).astype(np.uint64)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, one text after another, and the number of words of each text.

    A word's bytes go through the mixer eight at a time, its length first.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    raw = b" ".join([*parts, bytes(8)])
    n = len(raw) - 8
    space = np.concatenate([[True], _SPACE[np.frombuffer(raw, np.uint8, n)], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, left = edge[::2], edge[1::2] - edge[::2]
    counts = np.bincount(np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), start, side="right"), minlength=len(parts))
    h = _mix(left.astype(np.uint64) * _ODD)
    eight = np.ndarray((n + 1,), "<u8", raw, strides=(1,))
    for i in np.flatnonzero(left > LONG):
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : start[i] + left[i]])
    live = np.flatnonzero(left <= LONG)
    at, left = start[live], left[live]
    while len(live):
        block = eight[at] & _MASK[np.minimum(left, 8)]
        h[live] = _mix(h[live] + block * _ODD)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h, counts


def _combined(word: np.ndarray, k: int) -> np.ndarray:
    """Hashes of HASH_BITS bits of each k consecutive words."""
    n = len(word) - k + 1
    h = np.full(max(n, 0), k, np.uint64)
    for j in range(k if n > 0 else 0):
        h += word[j : n + j] * _PLACE[j]
    return _mix(h) >> np.uint64(64 - HASH_BITS)


def shingle_lists(texts: list[str | None], words: int, table: Table | None = None) -> Iterator[np.ndarray]:
    """Tokens of the distinct shingles of each text, ascending: rare ones first."""
    for i, j in _groups(texts):
        word, counts = word_hashes(texts[i:j])
        token = _combined(word, words)
        if table is not None and len(token):
            token |= table.levels(word, token) << np.uint64(HASH_BITS)
        first = 0
        for n in counts.tolist():
            if n >= words or not n:
                yield np.unique(token[first : first + n - words + 1]) if n else np.empty(0, np.uint64)
            else:
                own = word[first : first + n]
                one = _combined(own, n)
                yield one if table is None else one | table.levels(own, one) << np.uint64(HASH_BITS)
            first += n


def shingles(text: str | None, words: int, table: Table | None = None) -> np.ndarray:
    return next(shingle_lists([text], words, table))


def _groups(texts: list, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about `most` characters together."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of n with any other at the threshold."""
    return -(-percent * n // 100)


def _common(docs: DataFrame, words: int) -> Table:
    """The words and the shingles with the highest counts; the lowest binary order of counts that fits COMMON begins each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("jaccard")
        held, size = ([], []), 0

        def close():
            found = [np.unique(np.concatenate([*x, np.empty(0, np.uint64)]), return_counts=True) for x in held]
            kinds = np.repeat(np.arange(2, dtype=np.int8), [int((n >= REPORT).sum()) for _, n in found])
            hashes, n = (np.concatenate([x[i][x[1] >= REPORT] for x in found]) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(hashes.view(np.int64)), pa.array(n)], ["kind", "hash", "n"])

        for b in batches:
            texts = b.column(0).to_pylist()
            for i, j in _groups(texts):
                word, _ = word_hashes(texts[i:j])
                held[0].append(word)
                held[1].append(_combined(word, words))  # those across two texts are too rare to matter
                size += len(word)
                if size >= HELD:
                    yield close()
                    held, size = ([], []), 0
        yield close()

    scratch = Scratch(docs.sparkSession, "words")
    counts = scratch.save(docs.select("text").mapInArrow(run, "kind tinyint, hash long, n long").groupBy("kind", "hash").agg(F.sum("n").alias("n")).where(f"kind = 0 OR n >= {FREQUENT}"), "counts")
    sizes = counts.groupBy("kind", F.floor(F.log2("n")).alias("size")).count().collect()
    found = []
    for kind in (0, 1):
        per = {r[1]: r[2] for r in sizes if r[0] == kind}
        least, total = 64, 0
        for size in sorted(per, reverse=True):
            total += per[size]
            if total > COMMON:
                break
            least = size
        got = counts.where((F.col("kind") == kind) & (F.floor(F.log2("n")) >= least)).select("hash", "n").toArrow()
        found.append((got["hash"].to_numpy().view(np.uint64), got["n"].to_numpy()))
    scratch.drop(counts)
    return Table(*found)


def _sets(docs: DataFrame, table, words: int, percent: int) -> DataFrame:
    """doc, n, sig, prefix, bits of each row; sig is the same for equal sets only.  table: a broadcast Table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("jaccard")
        for b in batches:
            n, sig, first, bits = [], [], [], []
            for s in shingle_lists(b.column(1).to_pylist(), words, table.value):
                n.append(len(s))
                sig.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bits.append(bitmap(s).tobytes() if len(s) else None)
                first.append(s[: len(s) - needed(len(s), percent) + 1].view(np.int64) if len(s) else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, first)]), pa.int32()), pa.array(np.concatenate([*first, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), lists, pa.array(bits, pa.binary())], ["doc", "n", "sig", "prefix", "bits"])

    return docs.select("doc", "text").mapInArrow(run, "doc long, n long, sig binary, prefix array<long>, bits binary")


def pack(tokens: np.ndarray) -> bytes:
    """The hashes of tokens without their commonness, which only orders them, in as few bytes as they have."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : HASH_BITS // 8].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    few = np.frombuffer(raw, np.uint8).reshape(-1, HASH_BITS // 8)
    out = np.zeros((len(few), 8), np.uint8)
    out[:, : HASH_BITS // 8] = few
    return out.view("<u8").ravel()


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """A bit a token, to a power of two; a larger bitmap's halves joined are the smaller one's."""
    words = max(1, 1 << (len(tokens) - 1).bit_length() >> 6)
    out = np.zeros(words, np.uint64)
    np.bitwise_or.at(out, (tokens >> np.uint64(6) & np.uint64(words - 1)).astype(np.int64), np.uint64(1) << (tokens & np.uint64(63)))
    return out


def live(sizes: list[int], bits: list[np.ndarray], percent: int) -> list[bool]:
    """Which sets some other one can overlap enough, as far as sizes and bitmaps tell."""
    order = sorted(range(len(sizes)), key=lambda i: sizes[i])
    n = np.array([sizes[i] for i in order])
    out = np.zeros(len(order), bool)
    folded: dict[int, np.ndarray] = {}
    for a, i in enumerate(order):
        z = int(np.searchsorted(n, 100 * n[a] // percent, side="right"))
        if z <= a + 1 or out[a:z].all():
            continue
        words = len(bits[i])
        if words not in folded:  # of the sets from here on, none has fewer words
            folded = {words: np.stack([np.bitwise_or.reduce(bits[j].reshape(-1, words), axis=0) for j in order[a:]])}
            base = a
        mine, others = folded[words][a - base], folded[words][a + 1 - base : z - base]
        over = np.minimum(n[a] - np.bitwise_count(mine & ~others).sum(1, dtype=np.int64), n[a + 1 : z] - np.bitwise_count(others & ~mine).sum(1, dtype=np.int64))
        fits = over * (100 + percent) >= percent * (n[a] + n[a + 1 : z])
        out[a + 1 : z] |= fits
        out[a] |= bool(fits.any())
    return [bool(x) for _, x in sorted(zip(order, out, strict=True))]


class Forest:
    """Union-find over the positions of a block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * same >= percent * (len(a) + len(b) - same)


class _Tree:
    """Levels of nodes over sets in order of size; level 0 holds the sets themselves."""

    def __init__(self, sets: list[np.ndarray]):
        any_ = np.zeros((len(sets), WORDS64), np.uint64)
        for i, s in enumerate(sets):
            np.bitwise_or.at(any_[i], (s >> np.uint64(6) & np.uint64(WORDS64 - 1)).astype(np.int64), np.uint64(1) << (s & np.uint64(63)))
        size = np.array([len(s) for s in sets])
        self.levels = [(any_, any_, size, size)]
        while len(self.levels[-1][0]) > 1:
            any_, all_, low, high = self.levels[-1]
            cut = np.arange(0, len(any_), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(any_, cut), np.bitwise_and.reduceat(all_, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Whether members of nodes i and j can reach the threshold: by sizes, and by bits that one side surely lacks."""
        any_, all_, low, high = self.levels[level]
        least, most = np.maximum(low[i], low[j]), np.minimum(high[i], high[j])
        fits = 100 * most >= percent * least
        over = np.minimum(high[i] - np.bitwise_count(all_[i] & ~any_[j]).sum(1, dtype=np.int64), high[j] - np.bitwise_count(all_[j] & ~any_[i]).sum(1, dtype=np.int64))
        # overlap * (100 + percent) >= percent * (sum of sizes), with the smallest sizes the nodes allow
        return fits & (np.minimum(over, most) * (100 + percent) >= percent * (low[i] + low[j]))


def join_block(sets: list[np.ndarray], percent: int, first: int = 0, known: list[int] | None = None, home: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links between positions that connect all that is linked, given groups (`known`) that are connected already.

    With `home`, only pairs of one set at home and one that is not are compared: the others were before.
    """
    forest, out = Forest(len(sets)), []
    seen: dict[int, int] = {}
    for i, g in enumerate(known or ()):
        if g in seen:
            forest.join(seen[g], i)
        seen.setdefault(g, i)

    def compare(i: int, j: int) -> None:
        if (home is None or home[i] != home[j]) and forest.root(i) != forest.root(j) and _linked(sets[i], sets[j], percent):
            forest.join(i, j)
            out.append((i, j))

    if len(sets) <= 3:
        for i in range(len(sets)):
            for j in range(i):
                compare(i, j)
        return out
    if home is None:
        for i in range(len(sets)):  # the leader first: it connects most of its near copies
            if i != first:
                compare(first, i)
    order = sorted(range(len(sets)), key=lambda i: (home is not None and not home[i], len(sets[i]), sets[i][0]))
    homes = sum(home) if home is not None else None
    if len({forest.root(i) for i in order}) == 1:
        return out
    tree = _Tree([sets[i] for i in order])

    def uniform(level: int, node: int) -> int:
        """The root that all sets below a node share, or -1."""
        a, z = node * FANOUT**level, min((node + 1) * FANOUT**level, len(order))
        root = forest.root(order[a])
        return root if all(forest.root(order[i]) == root for i in range(a + 1, z)) else -1

    stack = [(len(tree.levels) - 1, 0, 0)]
    while stack:
        level, i, j = stack.pop()
        if level == 0:
            compare(order[i], order[j])
            continue
        if homes is not None and (max(i, j) * FANOUT**level + FANOUT**level <= homes or min(i, j) * FANOUT**level >= homes):
            continue
        if (root := uniform(level, i)) >= 0 and root == uniform(level, j):
            continue
        n = len(tree.levels[level - 1][0])
        a, b = np.arange(i * FANOUT, min((i + 1) * FANOUT, n)), np.arange(j * FANOUT, min((j + 1) * FANOUT, n))
        p, q = (x.ravel() for x in np.meshgrid(a, b, indexing="ij"))
        keep = (p <= q if level > 1 else p < q) if i == j else np.ones(len(p), bool)
        p, q = p[keep], q[keep]
        fits = tree.possible(level - 1, p, q, percent)
        stack += [(level - 1, int(x), int(y)) for x, y in zip(p[fits], q[fits], strict=True)]
    return out


def _joined(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the rows (block, class, part, id, known, home, tokens) of each block's part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("jaccard")
        now, ids, sets, known, home = None, [], [], [], []

        def close():
            one: dict[int, int] = {}
            for p, i in enumerate(ids):
                one.setdefault(i, p)
            at = sorted(one.values())
            first = min(range(len(at)), key=lambda q: ids[at[q]])
            links = join_block([sets[p] for p in at], percent, first, [known[p] for p in at], None if home[0] is None else [home[p] for p in at])
            return [(ids[at[i]], ids[at[j]]) for i, j in links]

        for b in batches:
            found = []
            for *place, i, group, here, raw in zip(*(b.column(c).to_pylist() for c in range(7)), strict=True):
                if place != now:
                    found += close() if len(ids) > 1 else []
                    now, ids, sets, known, home = place, [], [], [], []
                ids.append(i)
                known.append(group)
                home.append(here)
                sets.append(unpack(raw))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["a", "b"])
        if len(ids) > 1:
            found = close()
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["a", "b"])

    keys = ("block", "class", "part")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def _live(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (block, class, part, parts, id) whose set can still be linked; blocks in several parts stay whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("jaccard")
        now, held = None, []

        def close():
            if held[0][3] > 1:
                return held
            keep = live([x[5] for x in held], [np.frombuffer(x[6], np.uint64) for x in held], percent)
            return [x for x, k in zip(held, keep, strict=True) if k]

        def batch(found):
            columns = list(zip(*found, strict=True))[:5] if found else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["block", "class", "part", "parts", "id"])

        for b in batches:
            found = []
            for row in zip(*(b.column(c).to_pylist() for c in range(7)), strict=True):
                if row[:3] != now:
                    found += close() if held else []
                    now, held = row[:3], []
                held.append(row)
            yield batch(found)
        if held:
            yield batch(close())

    keys = ("block", "class", "part")
    return rows.select(*keys, "parts", "id", "n", "bits").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "block long, class long, part int, parts int, id long")


def _with_tokens(docs: DataFrame, members: DataFrame, table, words: int) -> DataFrame:
    """members (id, block, class, part, known, home) with the tokens of their documents."""
    per = members.groupBy("id").agg(F.collect_list(F.struct("block", "class", "part", "known", "home")).alias("to"))
    names = ["block", "class", "part", "id", "known", "home", "tokens"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("jaccard")
        rows, size = [], 0

        def batch():
            columns = zip(*rows, strict=True) if rows else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for b in batches:
            found = shingle_lists(b.column(1).to_pylist(), words, table.value)
            for i, s, to in zip(b.column(0).to_pylist(), found, b.column(2), strict=True):
                raw = pack(s)
                for x in to.as_py():
                    rows.append((x["block"], x["class"], x["part"], i, x["known"], x["home"], raw))
                    size += len(raw) + 64
                    if size >= 1 << 22:
                        yield batch()
                        rows, size = [], 0
        yield batch()

    joined = docs.select(F.col("doc").alias("id"), "text").join(small(per, F.size("to") * 48 + 8), "id").select("id", "text", "to")
    return joined.mapInArrow(run, "block long, class long, part int, id long, known long, home boolean, tokens binary")


def connected(links: DataFrame, scratch: Scratch) -> DataFrame:
    """id, root: the smallest id of each component, for every id of links (a, b) but the roots themselves."""
    now = scratch.save(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.save(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        small = scratch.save(small, "small")
        scratch.drop(large)
        scratch.drop(now)
        now = small
        found = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if found == state:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
        state = found


def _blocks(led: DataFrame, percent: int) -> DataFrame:
    """block, class, first, parts of the blocks to join, from (block, id, own), own being a set's size class.

    Class k holds the sets of own classes k and k - 1.  It is left out if it has none of k (k - 1 holds all of it), or if
    it has none of k - 1 while k + 1 has some (k + 1 holds all of it): any pair of equal or neighbouring classes stays.
    """
    per = led.groupBy("block", "own").agg(F.count("*").alias("c"), F.min("id").alias("i"))
    row = Window.partitionBy("block").orderBy("own")  # one row a size class, a logarithm of the largest set
    below, above = F.lag("own").over(row) == F.col("own") - 1, F.lead("own").over(row) == F.col("own") + 1
    near = per.select("*", F.coalesce(below, F.lit(False)).alias("below"), F.coalesce(above, F.lit(False)).alias("above"), F.lag("c").over(row).alias("cb"), F.lag("i").over(row).alias("ib"))
    held = near.where("below or not above").select(
        "block", F.col("own").alias("class"), F.expr("if(below, least(i, ib), i)").alias("first"), F.expr("c + if(below, cb, 0)").alias("count")
    )
    # A class tells how large its sets may be.
    largest = F.pow(F.lit(100 / percent), F.col("class") + 1) if percent < 100 else F.col("class")
    parts = F.greatest(F.ceil(F.col("count") / BLOCK), F.ceil(F.col("count") * largest / TOKENS))
    return held.where("count > 1").select("block", "class", "first", F.least(parts, F.col("count")).cast("int").alias("parts"))


def _linked_rows(rows: DataFrame, scratch: Scratch, words: int, percent: int) -> DataFrame:
    """doc, n_shingles, root of rows (doc, text): the smallest doc of each component."""
    common = rows.sparkSession.sparkContext.broadcast(_common(rows, words))
    whole = scratch.save(_sets(rows, common, words, percent), "whole")
    sets = scratch.save(whole.select("doc", "n", "sig"), "sets")
    names = scratch.save(sets.where("n > 0").groupBy("sig").agg(F.min("doc").alias("id")), "names")
    again = scratch.save(sets.where("n > 0").join(names, "sig").where("doc <> id").select("doc"), "again")
    # One row a class: few rows go, so as long as these are small the sets stay where they are.
    classes = whole.where("n > 0").join(small(again, 8), "doc", "left_anti").withColumnRenamed("doc", "id")
    size = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int") if percent < 100 else F.col("n").cast("int")
    postings = classes.select("id", size.alias("own"), F.explode("prefix").alias("token"))
    # Frequent shingles are known by their level and at most COMMON, so their leaders are broadcast; of any other few sets have each.
    frequent = F.col("token") >= (PLAIN + 1) << HASH_BITS
    many = postings.where(frequent).groupBy("token").agg(F.min("id").alias("block"), F.count("*").alias("c")).where("c > 1").select("token", "block")
    one = Window.partitionBy("token")
    few = postings.where(~frequent).select("id", "own", F.min("id").over(one).alias("block"), F.count("*").over(one).alias("c")).where("c > 1")
    found = few.select("block", "id", "own").union(postings.where(frequent).join(F.broadcast(many), "token").select("block", "id", "own"))
    led = scratch.save(found.select("block", "id", F.col("own").cast("long").alias("own")).distinct(), "led")
    blocks = _blocks(led, percent)
    members = led.select("block", "id", F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("class"))
    # The first set of a block is in every part of it.
    every, one = F.sequence(F.lit(0), F.col("parts") - 1), F.array(F.pmod(F.xxhash64("id"), "parts").cast("int"))
    dealt = members.join(blocks, ["block", "class"]).select("block", "class", "id", "parts", F.explode(F.when(F.col("id") == F.col("first"), every).otherwise(one)).alias("part"))
    dealt = scratch.save(_live(dealt.join(classes.select("id", "n", "bits"), "id"), percent), "dealt")
    scratch.drop(whole, led, again)
    apart = F.lit(None).cast("boolean")
    links = scratch.save(_joined(_with_tokens(rows, dealt.select("block", "class", "id", "part", F.col("id").alias("known"), apart.alias("home")), common, words), percent), "links")
    roots = scratch.save(connected(links, scratch), "roots")
    large = scratch.save(dealt.where("parts > 1"), "split")
    scratch.drop(dealt)
    if large.count():
        named = large.join(roots, "id", "left").select("block", "class", "id", "parts", "part", F.coalesce("root", "id").alias("known"))
        lead = named.groupBy("block", "class").agg(F.min_by("known", "id").alias("lead"))
        stray = scratch.save(named.join(lead, ["block", "class"]).where("known <> lead").drop("lead"), "stray")
        if stray.count():
            here = named.join(stray.select("block", "class").distinct(), ["block", "class"], "left_semi").withColumn("home", F.lit(True))
            away = stray.withColumn("to", F.explode(every)).where("to <> part").withColumn("part", F.col("to")).withColumn("home", F.lit(False))
            again = here.unionByName(away.drop("to"))
            more = _joined(_with_tokens(rows, again, common, words), percent)
            links = scratch.save(links.union(more), "links-again")
            roots = scratch.save(connected(links, scratch), "roots-again")
    common.unpersist()
    scratch.keep_only(sets, names, roots, *([rows] if _written(rows) else []))
    named = names.join(roots, "id", "left").select("sig", F.coalesce("root", "id").alias("root"))
    return sets.join(named, "sig", "left").select("doc", F.col("n").alias("n_shingles"), F.coalesce("root", "doc").alias("root"))


def _written(rows: DataFrame) -> bool:
    """Whether rows have numbers of their own, other than the keys."""
    return hasattr(rows, "_tessera_path")


def _numbered(docs: DataFrame, scratch: Scratch, key: str, text: str, *more) -> DataFrame:
    pieces = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return numbered(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *more), scratch, pieces)


def components(docs: DataFrame, scratch: Scratch, words: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id of every row."""
    rows = _numbered(docs, scratch, key, text)
    out = _linked_rows(rows, scratch, words, percent)
    if not _written(rows):
        kind = docs.schema[key].dataType
        return out.select(F.col("doc").cast(kind).alias(key), "n_shingles", F.col("root").cast(kind).alias("component_id"))
    out = out.join(rows.select("doc", F.col("key").alias(key)), "doc")
    least = out.groupBy("root").agg(F.min(key).alias("component_id"))
    return out.join(least, "root").select(key, "n_shingles", "component_id")


def keep_first(docs: DataFrame, scratch: Scratch, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs, with all its columns, of each component: that of the smallest key (of equal ones, the first by text)."""
    rows = _numbered(docs, scratch, key, text, F.struct(*docs.columns).alias("row"))
    # Only rows that are not their group's first travel; rows without shingles are their own group.
    gone = scratch.save(_linked_rows(rows, scratch, words, percent).where("root <> doc").select("doc"), "gone")
    scratch.keep_only(gone, *([rows] if _written(rows) else []))
    return rows.join(gone, "doc", "left_anti").select("row.*")
