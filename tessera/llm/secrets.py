"""Secret scan: fixed patterns, and a randomness test battery under length-aware false-discovery control.

Fixed patterns (assign, access, hex) are always reported.  Beyond them, each other run of LEAST or more characters of an
encoding's alphabet is a candidate.  Its encoding is the smallest known alphabet that holds it.

Battery: three tests ask whether the run could be drawn uniformly from that alphabet: chi-squared over equal ranges of the
alphabet, runs above and below its middle, and lag-one serial correlation; Fisher's method combines them to p, and
p under FAIR ends a candidate.

Control: passing the battery does not make a run random, as short structured runs may pass.  What written runs look like
is learned from the corpus itself: the transitions between characters in all runs too short to be candidates, over all
documents (a table of SIGNS ** 2 counts); the model is the mean of these and a prior (PRIOR), so that transitions which
the corpus happens to lack are no evidence by themselves.  A candidate's evidence e is how much
likelier the uniform draw makes it than that model does, over the number of alphabets.  For a written run of any length,
e is 1 on average at most, so e is an e-value; it grows with the run's length, a short run needs less usual transitions.
Over all candidates of the corpus the e-values' step-up rule (the largest k with k runs of e >= candidates / (RATE * k))
keeps the expected share of written runs among those reported under RATE, whatever the candidates' dependence.  Its
threshold needs a histogram of log e only (BINS rows).  The rule is the same for one candidate and for millions.

Edge cases: null and empty texts have no spans; offsets are code points, ends exclusive; ties keep the order of KINDS;
a candidate that a fixed span covers in part is dropped; equal texts get equal spans, repeated rows count each; texts of
any length are scanned whole; an empty table gives no rows and reports nothing; other columns are left out of `scan`,
whatever their names, and pass through `redact`.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import enter

__all__ = ["Model", "base_spans", "battery", "candidates", "fit", "redact", "scan", "spans_of"]

KINDS = ("assign", "access", "hex", "random")
#: Shortest candidate; the battery's p that ends one; the share of written runs among those reported, at most.
LEAST, FAIR, RATE = 20, 0.01, 0.1
#: Bins of log e, from 0 on.
BINS = 100

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}")
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
SETS = [(name, frozenset(a), {c: i for i, c in enumerate(a)}) for name, a in ALPHABETS.items()]


#: Characters of candidates, by class: lower case, upper case, digits, signs; all else is 0.
CLASSES = (ALPHABETS["lower"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_-")
SIGNS = 1 + sum(map(len, CLASSES))
CODE = np.zeros(256, np.uint8)
CODE[np.frombuffer("".join(CLASSES).encode(), np.uint8)] = np.arange(1, SIGNS)
#: The prior of written runs: the weight of a row in counts, and the shares of classes (as above) at the start and after one of each class.
WEIGHT = 64
PRIOR = ((0.60, 0.25, 0.13, 0.02), (0.96, 0.005, 0.01, 0.025), (0.60, 0.35, 0.02, 0.03), (0.05, 0.02, 0.85, 0.08), (0.55, 0.15, 0.25, 0.05))


def base_spans(text: str, long: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns by start, then kind as listed; long: whether a run of LEAST may be there."""
    out = []
    low = text.encode().lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if long:
        if "AKIA" in text:
            out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _groups(texts: list, most: int = 1 << 19) -> Iterator[list]:
    """Neighbouring texts of about `most` characters together."""
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the texts' bytes, a 0 between any two; start and end of their runs of LEAST or more; where each text ends."""
    parts = [t.encode() for t in texts]
    code = CODE[np.frombuffer(b"\0".join([b"", *parts, b""]), np.uint8)]
    edge = np.flatnonzero((code[1:] > 0) != (code[:-1] > 0)) + 1
    start, end = edge[::2], edge[1::2]
    long = end - start >= LEAST
    return code, start[long], end[long], np.cumsum([len(p) + 1 for p in parts])


def long_runs(texts: list[str]) -> np.ndarray:
    """Whether each text has a run of LEAST or more."""
    out = np.zeros(len(texts), bool)
    _, start, _, ends = _runs(texts)
    out[np.searchsorted(ends, start)] = True
    return out


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(x: np.ndarray, m: int) -> float:
    """p of the joined tests that positions x were drawn uniformly from an alphabet of m."""
    n = len(x)
    k = min(m, max(2, n // 5))
    cell = x * k // m
    size = np.bincount(np.arange(m) * k // m, minlength=k) / m * n
    chi = float((((np.bincount(cell, minlength=k) - size) ** 2) / size).sum())
    df = k - 1  # Wilson and Hilferty's normal form of chi-squared
    p1 = 0.5 * math.erfc(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)) / math.sqrt(2))
    above = x * 2 >= m
    a = int(above.sum())
    b = n - a
    if a and b:
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p2 = _two_sided((1 + int((above[1:] != above[:-1]).sum()) - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p2 = 2.0 ** (1 - n)
    y = x - x.mean()
    var = float(y @ y)
    p3 = _two_sided((float(y[1:] @ y[:-1]) / var + 1 / n) * math.sqrt(n)) if var > 0 else 0.0
    s = -sum(math.log(max(p, 1e-300)) for p in (p1, p2, p3))
    return math.exp(-s) * (1 + s + s * s / 2)


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, alphabet) of runs that no fixed span touches."""
    out = []
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        if any(a < e and s < b for a, b, _ in taken):
            continue
        letters = set(m.group())
        if found := next((name for name, known, _ in SETS if letters <= known), None):
            out.append((s, e, found))
    return out


@dataclass
class Model:
    """Logarithms of transitions in written runs, [SIGNS, SIGNS]; row 0: the start.  least: the log e from which on a run is reported."""

    logs: np.ndarray
    least: float = math.inf

    @classmethod
    def of(cls, counts: np.ndarray) -> Model:
        width = [len(c) for c in CLASSES]
        prior = np.repeat(np.array(PRIOR)[np.repeat(np.arange(5), [1, *width])] / width, width, axis=1)
        rows = counts[:, 1:] + WEIGHT * prior
        logs = np.zeros((SIGNS, SIGNS))
        logs[:, 1:] = np.log((rows / rows.sum(1, keepdims=True) + prior) / 2)
        return cls(logs)

    def evidence(self, token: str, alphabet: str) -> float:
        """log e of a run: 0 or more; nothing for one that the battery ends."""
        _, _, place = next(x for x in SETS if x[0] == alphabet)
        if battery(np.array([place[c] for c in token]), len(place)) < FAIR:
            return 0.0
        code = CODE[np.frombuffer(token.encode(), np.uint8)]
        written = self.logs[np.concatenate([[0], code[:-1]]), code].sum()
        return max(0.0, float(-len(token) * math.log(len(place)) - written) - math.log(len(SETS)))


def threshold(bins: np.ndarray) -> float:
    """Lowest whole log e that the step-up rule allows, by the numbers of candidates of each."""
    kept = np.cumsum(bins[::-1])[::-1]
    fits = np.exp(np.minimum(np.arange(BINS), 700.0)) * RATE * kept >= bins.sum()
    found = np.flatnonzero(fits & (kept > 0))
    return float(found[0]) if len(found) else math.inf


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enter("secrets")
    total = np.zeros(SIGNS * SIGNS, np.int64)
    for b in batches:
        for texts in _groups(b.column(0).to_pylist()):
            code, start, end, _ = _runs(texts)
            for s, e in zip(start.tolist(), end.tolist(), strict=True):
                code[s:e] = 0
            total += np.bincount(code[:-1].astype(np.int32) * SIGNS + code[1:], minlength=SIGNS * SIGNS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["code", "n"])


def fit(df: DataFrame, text: str = "text") -> Model:
    """From all texts; SIGNS ** 2 and BINS rows at most reach the driver, whatever the input."""
    counts = np.zeros(SIGNS * SIGNS)
    for code, n in df.select(text).mapInArrow(_transitions, "code int, n long").groupBy("code").agg(F.sum("n")).collect():
        counts[code] = n
    model = Model.of(counts.reshape(SIGNS, SIGNS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("secrets")
        total = np.zeros(BINS, np.int64)
        for b in batches:
            for texts in _groups(b.column(0).to_pylist()):
                for i in np.flatnonzero(long_runs(texts)):
                    for s, e, name in candidates(texts[i], base_spans(texts[i])):
                        total[min(int(model.evidence(texts[i][s:e], name)), BINS - 1)] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bin", "n"])

    bins = np.zeros(BINS, np.int64)
    for i, n in df.select(text).mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n")).collect():
        bins[i] = n
    model.least = threshold(bins)
    return model


def spans_of(text: str, model: Model, long: bool = True) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Fixed spans, and all spans."""
    base = base_spans(text, long)
    more = [(s, e, "random") for s, e, name in candidates(text, base) if model.evidence(text[s:e], name) >= model.least] if long else []
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, n_random, base_sha256, spans of every text."""
    model = fit(df, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("secrets")
        for b in batches:
            rows = []
            for texts in _groups(b.column(1).to_pylist()):
                for t, long in zip(texts, long_runs(texts).tolist(), strict=True):
                    base, found = spans_of(t, model, long)
                    kinds = [k for _, _, k in found]
                    rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)))
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in zip(*rows, strict=True))], [key, "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def _mask(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    out, at = [], 0
    for s, e, kind in spans:
        if e > at:
            out += [text[at : max(s, at)], mark.format(kind)] if s >= at else []
            at = e
    return "".join(out) + text[at:]


def redact(df: DataFrame, text: str = "text", mark: str = "[{}]") -> DataFrame:
    """All rows and columns of df, with each span of the text replaced by its kind."""
    model = fit(df, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("secrets")
        for b in batches:
            at = b.schema.get_field_index(text)
            given = b.column(at).to_pylist()
            long = [x for texts in _groups(given) for x in long_runs(texts).tolist()]
            texts = [t if not t else _mask(t, spans_of(t, model, x)[1], mark) for t, x in zip(given, long, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return df.mapInArrow(run, df.schema)
