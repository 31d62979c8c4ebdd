r"""Quality rules: hashed n-gram logistic regression beside a few counts.

Features are hashed word unigrams and bigrams and hashed character (code point)
trigrams and 4-grams, each kind as shares of its own total. A logistic
regression is fitted on a bounded sample of labelled rows, calibrated by
Platt's method on a held-out part of it, and scores whole texts in Arrow
batches against fixed thresholds.

Words are ``[^\x20\x09-\x0D]+``. Null and empty texts have zero words, fail the
base rules and get the model's intercept as score. Very long texts are read
block by block, each with what stands before it, so that every n-gram counts
once. Repeated rows score alike; clashing columns are replaced; empty tables
give empty results. Without labelled rows of both classes the probability is
the share of good labels (1 without any).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.llm.arrow_map import add_columns

#: Fixed thresholds.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_PROBABILITY = 0.5
#: Bounds of the sample that the model is fitted on: rows of each class.
TRAIN_ROWS = 800
HASH_BITS = 16
KINDS = ("word1", "word2", "char3", "char4")
#: Characters that are worked on at a time, up to the end of the last word.
BLOCK = 1 << 20

_SPACES = " \t\n\x0b\x0c\r"
_GAP = re.compile(r"[ \t\n\x0b\x0c\r]")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        size = max(n, 1 << 16)
        for k, b in enumerate((_BASE, inverse)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            p = np.cumprod(p, dtype=np.uint64)
            _powers[k : k + 1] = [p]
    return _powers[0], _powers[1]


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each word in an array of bytes or code points and a 64-bit hash of its members."""
    edge = np.diff(np.concatenate(([True], _SPACE[np.minimum(buf, 255)], [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers_to(len(buf) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], dtype=np.uint64)))
    h = (total[end] - total[start]) * down[start]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return start, h


def block_features(text: str, begin: int, start: int, end: int) -> list[np.ndarray]:
    """Hashed ids, one array per kind, of the n-grams that end in ``text[start:end]``; ``begin`` is where the first of them may begin."""
    buf = np.frombuffer(text[begin:end].encode("utf-32-le", "surrogatepass"), np.uint32)
    new = start - begin
    at, h = word_hashes(buf)
    own = int(np.searchsorted(at, new))
    shift = np.uint64(64 - HASH_BITS)
    mixed = h * np.uint64(0xBF58476D1CE4E5B9)
    pair = (h[:-1] * np.uint64(0x94D049BB133111EB) + mixed[1:]) * np.uint64(_BASE)
    c = [buf[k:].astype(np.uint32) for k in range(4)]
    n3, n4 = max(len(buf) - 2, 0), max(len(buf) - 3, 0)
    low = np.uint32(32 - HASH_BITS)
    step = np.uint32(0x85EBCA77)
    tri = ((c[0][:n3] * step + c[1][:n3]) * step + c[2][:n3]) * np.uint32(0x9E3779B1)
    quad = (((c[0][:n4] * step + c[1][:n4]) * step + c[2][:n4]) * step + c[3][:n4]) * np.uint32(0xC2B2AE3D)
    words, pairs = (mixed[own:] >> shift), (pair[max(own - 1, 0) :] >> shift)
    return [words.astype(np.int32), pairs.astype(np.int32), (tri[max(new - 2, 0) :] >> low).astype(np.int32), (quad[max(new - 3, 0) :] >> low).astype(np.int32)]


def blocks(text: str):
    """(begin, start, end) of stretches of about BLOCK characters; none cuts a word, and ``begin`` takes in the word and the three characters before."""
    start = 0
    while start < len(text) or not start:
        end = start + BLOCK
        if end < len(text):
            gap = _GAP.search(text, end - 1)
            end = gap.end() if gap else len(text)
        else:
            end = len(text)
        last = start
        while last and text[last - 1] in _SPACES:
            last -= 1
        last = max(text.rfind(c, 0, last) for c in _SPACES) + 1
        yield min(last, max(start - 3, 0)), start, end
        start = end
        if not text:
            return


@dataclass(frozen=True)
class QualityModel:
    """Weights (kinds, 2**HASH_BITS), intercept, and Platt's slope and offset."""

    weights: np.ndarray
    intercept: float
    slope: float
    offset: float

    def probability(self, text: str | None) -> float:
        sums, counts = np.zeros(len(KINDS)), np.zeros(len(KINDS))
        for part in blocks(text or ""):
            for k, ids in enumerate(block_features(text or "", *part)):
                sums[k] += self.weights[k][ids].sum(dtype=np.float64)
                counts[k] += len(ids)
        z = self.intercept + (sums / np.maximum(counts, 1)).sum()
        return float(1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -50, 50))))


def sparse_shares(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature ids (over all kinds) and their shares of their kind."""
    got: list[list[np.ndarray]] = [[] for _ in KINDS]
    for part in blocks(text or ""):
        for k, ids in enumerate(block_features(text or "", *part)):
            got[k].append(ids)
    all_ids, all_shares = [], []
    for k, parts in enumerate(got):
        ids, n = np.unique(np.concatenate(parts), return_counts=True)
        all_ids.append(ids.astype(np.int32) + (k << HASH_BITS))
        all_shares.append((n / max(n.sum(), 1)).astype(np.float32))
    return np.concatenate(all_ids), np.concatenate(all_shares)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", where=None) -> DataFrame:
    """At most ``per_class`` labelled rows of each class, the first by a hash of the id: (id, text, y).

    A doc_id with several labels counts with the smallest, one with several texts with the first by a hash; null ids and labels don't count.
    """
    ids = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
    ids = ids.where(where) if where is not None else ids
    ids = ids.groupBy(id_col).agg(F.min(label).cast("int").alias("_y"))
    chosen = [ids.where(F.col("_y") == y).orderBy(F.xxhash64(id_col), id_col).limit(per_class) for y in (0, 1)]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * per_class short rows
    rows = docs.select(F.col(id_col), F.col("text")).where(F.col("text").isNotNull()).join(picked, id_col)
    return rows.groupBy(id_col).agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("_y").alias("y"))


def _logistic(ids, shares, at, y, n_features: int, steps: int = 150, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Full-batch Adam on sparse rows; ``at`` are the rows of the entries. Classes weigh the same."""
    n = len(y)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max(n - y.sum(), 1))
    w, b = np.zeros(n_features), 0.0
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(at, w[ids] * shares, n) + b
        g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * weight
        gw = np.bincount(ids, g[at] * shares, n_features) + decay * w / n_features
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        b -= 0.1 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-7)
    return w, b


def newton_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 40) -> np.ndarray:
    """Weights of a small dense logistic regression; the last column of ``x`` is the intercept."""
    beta = np.zeros(x.shape[1])
    weight = np.ones(len(y)) if weight is None else weight
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        beta -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
    return beta


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> QualityModel:
    """Fit on at most ``rows`` labelled rows of each class; features come to the driver, texts don't."""
    n_features = len(KINDS) << HASH_BITS

    def work():
        def each(texts):
            pairs = [sparse_shares(t) for t in texts]
            return [[i.tobytes() for i, _ in pairs], [s.tobytes() for _, s in pairs]]

        return each

    fields = [T.StructField("ids", T.BinaryType()), T.StructField("shares", T.BinaryType())]
    got = add_columns(labelled_sample(docs, labels, "quality", rows), "text", fields, work).select("doc_id", "y", "ids", "shares").collect()
    got.sort(key=lambda r: (r["doc_id"], r["ids"]))
    y = np.array([r["y"] for r in got], np.float64)
    if len(got) < 8 or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 1.0, 1e-6, 1 - 1e-6))
        return QualityModel(np.zeros((len(KINDS), 1 << HASH_BITS), np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    rows_ = [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in got]
    del got
    held = np.arange(len(y)) % 4 == 3
    own = np.flatnonzero(~held)
    ids = np.concatenate([rows_[k][0] for k in own])
    shares = np.concatenate([rows_[k][1] for k in own]).astype(np.float64)
    at = np.repeat(np.arange(len(own)), [len(rows_[k][0]) for k in own])
    w, b = _logistic(ids, shares, at, y[own], n_features)
    z = np.array([w[i] @ s + b for i, s in rows_])
    use = held if 0 < y[held].sum() < held.sum() else np.ones(len(y), bool)
    scale = max(np.abs(z[use]).mean(), 1e-9)
    # Platt's targets keep the slope finite where the classes separate
    n1, n0 = y[use].sum(), (1 - y[use]).sum()
    target = np.where(y[use] == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, offset = newton_logistic(np.stack([z[use] / scale, np.ones(use.sum())], 1), target)
    return QualityModel(w.reshape(len(KINDS), -1).astype(np.float32), float(b), float(max(slope, 1e-6) / scale), float(offset))


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "replace").split()
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(words), chars, symbols, len(lines) - len(set(lines)), _repeated(words)


def _repeated(words: list[bytes]) -> int:
    """Words inside three-word windows that are found twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pairs, n = ids[:-1] * len(number) + ids[1:], len(number)
    if n > 2_000_000:
        _, pairs = np.unique(pairs, return_inverse=True)
    code = pairs[:-1] * n + ids[2:]
    _, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    inside = np.zeros(len(ids), bool)
    for k in range(3):
        inside[k : len(ids) - 2 + k] |= twice
    return int(inside.sum())


FIELDS = [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("probability", T.DoubleType()),
    T.StructField("kept", T.BooleanType()),
]


def apply_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """Every row of ``docs`` with its counts, base verdict, probability and final verdict."""

    def work():
        def each(texts):
            counts = [text_counts(t) for t in texts]
            failed = [c[0] < MIN_WORDS or 100 * c[4] > MAX_REPEAT_PERCENT * c[0] for c in counts]
            p = [model.probability(t) for t in texts]
            kept = [not f and q >= min_probability for f, q in zip(failed, p, strict=True)]
            return [*(list(c) for c in (zip(*counts, strict=True) if counts else [[]] * 5)), failed, p, kept]

        return each

    return add_columns(docs, text_col, FIELDS, work)
