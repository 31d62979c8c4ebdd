r"""Toxicity: a linear-chain conditional random field over words.

Two tags, clean and toxic. Labels are given per document, so the labelled
tokens are projected from them: in toxic documents, a token is tagged toxic
when its word or one of its stems stands almost only in toxic documents (a
likelihood-ratio test over a bounded sample of labelled rows, near copies
counted once). The field has hashed features of the word itself (the word,
prefixes, a suffix, its shape), start weights and a tag-transition matrix, and is fitted by gradient ascent
on the exact likelihood. Forward-backward gives each token its marginal; a small logistic model,
fitted on rows that the field hasn't seen, turns their sum, maximum and share
into a document score. Tokens whose marginal passes a threshold are the
offending spans.

Only the text enters a score. Words are ``[^\x20\x09-\x0D]+``. Null and empty
texts have no tokens and get the score of all-zero evidence. Texts of any
length run whole: chains of one batch advance together and long ones alone,
in O(words) memory. Repeated rows score alike; clashing columns are replaced;
empty tables give empty results. Without labelled rows of both classes every
score is the share of toxic labels (0 without any).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.llm.arrow_map import add_columns
from vitalgrid.llm.quality import labelled_sample, newton_logistic

#: Fixed threshold of a predicted document, and of an offending token.
MIN_SCORE = 0.7
MIN_MARGINAL = 0.5
#: Bounds of the sample that the models are fitted on: rows of each class, windows of one row, windows of all (half of
#: them may hold marked tokens and half not; the rest, chosen by hash, isn't fitted on), words of a window.
TRAIN_ROWS = 1500
ROW_WINDOWS = 64
TRAIN_WINDOWS = 3000
WINDOW = 128
FEATURE_BITS = 18
#: Least log-likelihood ratio, and least share of toxic documents, for a stem to mark tokens.
MIN_RATIO, MIN_SHARE = 10.83, 0.95  # of a ratio: one chance in a thousand
#: A task keeps scores of so many words.
CACHE_WORDS = 200_000
#: Chains longer than this run by themselves.
ALONE = 2000
_PUNCTUATION = ".,;:!?\"'()[]{}<>|#*$%&+-=_/\\~`^@…“”‘’«»¿¡"


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def bare(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower().strip(_PUNCTUATION)


def stems(w: str) -> list[str]:
    """What may mark a token as toxic: the word and its prefixes."""
    return [f"w{w}"] + [f"{k}{w[:k]}" for k in (4, 5, 6) if len(w) > k]


def _seed(prefix: str) -> int:
    return zlib.crc32(prefix.encode())


_WHOLE, _PREFIXES, _THREE, _LAST, _SHIFT = _seed("w"), [(k, _seed(str(k))) for k in (4, 5, 6)], _seed("3"), _seed("-"), 32 - FEATURE_BITS
_ASCII_PUNCTUATION = "".join(c for c in _PUNCTUATION if c.isascii()).encode()
_shapes: dict[tuple, int] = {}


def features(word: bytes) -> list[int]:
    """Hashed features of a word. In ASCII a character is a byte, so there they are made from slices of the bytes, each hashed on from its prefix."""
    if not word.isascii():
        return _features(word)
    w, crc = word.lower().strip(_ASCII_PUNCTUATION), zlib.crc32
    plain = word.isalpha()
    key = (word.isupper(), word.istitle(), not plain and any(48 <= c <= 57 for c in word), not plain and not word.isalnum(), min(len(w), 12))
    shape = _shapes.get(key)
    if shape is None:
        shape = _shapes[key] = crc(b"s%d%d%d%d%d" % key) >> _SHIFT
    return [crc(w, _WHOLE) >> _SHIFT, *(crc(w[:k], s) >> _SHIFT for k, s in _PREFIXES if len(w) > k), crc(w[:3], _THREE) >> _SHIFT, crc(w[-3:], _LAST) >> _SHIFT, shape]


def _features(word: bytes) -> list[int]:
    w = bare(word)
    raw = word.decode("utf-8", "replace")
    shape = f"s{raw.isupper():d}{raw.istitle():d}{any(c.isdigit() for c in raw):d}{any(not c.isalnum() for c in raw):d}{min(len(w), 12)}"
    names = [*stems(w), f"3{w[:3]}", f"-{w[-3:]}", shape]
    return [zlib.crc32(n.encode()) >> (32 - FEATURE_BITS) for n in names]


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of the toxic tag, start odds, transitions (2, 2) as logs, and the document model."""

    weights: np.ndarray
    start: float
    transition: np.ndarray
    document: np.ndarray
    base: float | None = None

    def scorer(self):
        """A function from texts to [(score, marginals, words)], with its own cache of word scores."""
        cache: dict[bytes, float] = {}
        w = self.weights.tolist()  # a few of them at a time: a list gives them faster than an array

        def odds(words: list[bytes]) -> list[float]:
            if len(cache) > CACHE_WORDS:
                cache.clear()
            out = []
            for x in words:
                u = cache.get(x)
                if u is None:
                    u = cache[x] = sum([w[k] for k in features(x)])
                out.append(u)
            return out

        def run(texts: list):
            words = [split_words(t) for t in texts]
            marginals = chain_marginals([odds(x) for x in words], self.start, self.transition)
            return [(self.score(m), m, x) for m, x in zip(marginals, words, strict=True)]

        return run

    def score(self, marginals: np.ndarray) -> float:
        if self.base is not None:
            return self.base
        z = float(evidence(marginals) @ self.document)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def evidence(m: np.ndarray) -> np.ndarray:
    """Document features from token marginals: sum, maximum, share, and one."""
    if not len(m):
        return np.array([0.0, 0.0, 0.0, 1.0])
    s = float(m.sum())
    return np.array([math.log1p(s), float(m.max()), min(1.0, 10 * s / len(m)), 1.0])


def chain_marginals(odds: list[list[float]], start: float, transition: np.ndarray) -> list[np.ndarray]:
    """P(toxic) of every token of every chain, by forward-backward."""
    out: list[np.ndarray] = [np.zeros(0)] * len(odds)
    together = sorted((k for k in range(len(odds)) if 0 < len(odds[k]) <= ALONE), key=lambda k: -len(odds[k]))
    if together:
        lengths = np.array([len(odds[k]) for k in together])
        u = np.zeros((lengths[0], len(together)))
        for col, k in enumerate(together):
            u[: lengths[col], col] = odds[k]
        p = _forward_backward(u, lengths, start, transition)[0]
        for col, k in enumerate(together):
            out[k] = p[: lengths[col], col].copy()
    for k, x in enumerate(odds):
        if len(x) > ALONE:
            out[k] = _alone(x, start, transition)
    return out


def _forward_backward(u: np.ndarray, lengths: np.ndarray, start: float, transition: np.ndarray):
    """Marginals (time, chain), forward and backward vectors. Chains are in falling order of length."""
    steps, n = u.shape
    e = np.exp(np.clip(u, -30, 30))
    t = np.exp(transition)
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # chains longer than each time
    f1, b1 = np.zeros((steps, n)), np.full((steps, n), 0.5)
    a0, a1 = np.ones(n), e[0] * math.exp(start)
    f1[0] = a1 / (a0 + a1)
    for k in range(1, steps):
        c = active[k]
        p1 = f1[k - 1, :c]
        p0 = 1 - p1
        x1 = (p0 * t[0, 1] + p1 * t[1, 1]) * e[k, :c]
        f1[k, :c] = x1 / (p0 * t[0, 0] + p1 * t[1, 0] + x1)
    for k in range(steps - 2, -1, -1):
        c = active[k + 1]
        q1 = b1[k + 1, :c] * e[k + 1, :c]
        q0 = 1 - b1[k + 1, :c]
        y1 = t[1, 0] * q0 + t[1, 1] * q1
        b1[k, :c] = y1 / (t[0, 0] * q0 + t[0, 1] * q1 + y1)
    both = f1 * b1
    return both / np.maximum(both + (1 - f1) * (1 - b1), 1e-300), f1, b1, e, t, active


def _alone(x: list[float], start: float, transition: np.ndarray) -> np.ndarray:
    t = np.exp(transition)
    t00, t01, t10, t11 = (float(v) for v in t.ravel())
    e = np.exp(np.clip(np.array(x), -30, 30)).tolist()
    n = len(e)
    f, b = [0.0] * n, [0.5] * n
    a = e[0] * math.exp(start)
    p = f[0] = a / (1 + a)
    for k in range(1, n):
        x1 = ((1 - p) * t01 + p * t11) * e[k]
        p = f[k] = x1 / ((1 - p) * t00 + p * t10 + x1)
    q = 0.5
    for k in range(n - 2, -1, -1):
        q1, q0 = q * e[k + 1], 1 - q
        y1 = t10 * q0 + t11 * q1
        q = b[k] = y1 / (t00 * q0 + t01 * q1 + y1)
    f_, b_ = np.array(f), np.array(b)
    return f_ * b_ / np.maximum(f_ * b_ + (1 - f_) * (1 - b_), 1e-300)


def excerpt(text: str | None) -> str:
    """What the fit sees of a text: all of it, or ROW_WINDOWS windows spread evenly from its first word to its last."""
    words = split_words(text)
    if len(words) <= ROW_WINDOWS * WINDOW:
        return text or ""
    starts = np.linspace(0, len(words) - WINDOW, ROW_WINDOWS).astype(int).tolist()
    return b" ".join(w for s in starts for w in words[s : s + WINDOW]).decode("utf-8", "replace")


def _toxic_stems(docs: Iterable[set[str]], y: np.ndarray) -> set[str]:
    """Stems that stand almost only in toxic documents, by a likelihood-ratio test; one document's stems are held at a time."""
    toxic: dict[str, int] = {}
    clean: dict[str, int] = {}
    for got, label in zip(docs, y, strict=True):
        count = toxic if label else clean
        for s in got:
            count[s] = count.get(s, 0) + 1
    n1, n0 = float(y.sum()), float((1 - y).sum())
    out = set()
    for s, a in toxic.items():
        b = clean.get(s, 0)
        rate = a / n1
        if rate / (rate + b / n0) < MIN_SHARE:
            continue
        total = a + b
        ratio = 2 * (a * math.log(a * (n1 + n0) / (total * n1)) + (b * math.log(b * (n1 + n0) / (total * n0)) if b else 0.0))
        if ratio >= MIN_RATIO:
            out.add(s)
    return out


def _apart(texts: list[list[bytes]]) -> list[int]:
    """Indices of texts without those that share a low shingle hash with an earlier one (near copies)."""
    seen: set[tuple[int, int]] = set()
    out = []
    for k, words in enumerate(texts):
        low = [w.lower() for w in words]
        marks = []
        for seed in (1, 2):
            shingles = [b" ".join(low[i : i + 5]) for i in range(max(1, len(low) - 4))]
            marks.append((seed, min((zlib.crc32(s, seed * 0x9E3779B1 & 0xFFFFFFFF) * 2654435761 & 0xFFFFFFFF for s in shingles), default=0)))
        if not any(m in seen for m in marks):
            out.append(k)
        seen.update(marks)
    return out


def _fit_chain(chains: list[tuple[list[bytes], np.ndarray]], steps: int = 60, rate: float = 0.3, decay: float = 2e-3) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, start odds and transitions by Adam on the mean log-likelihood of tagged windows."""
    chains = sorted(chains, key=lambda c: -len(c[0]))
    lengths = np.array([len(c[0]) for c in chains])
    kinds: dict[bytes, int] = {}
    rows = np.full((lengths[0], len(chains)), -1, np.int64)
    tags = np.zeros(rows.shape)
    for col, (words, tag) in enumerate(chains):
        rows[: len(words), col] = [kinds.setdefault(w, len(kinds)) for w in words]
        tags[: len(words), col] = tag
    got = [features(w) for w in kinds]
    at = np.repeat(np.arange(len(got)), [len(g) for g in got])
    ids = np.concatenate([np.array(g) for g in got])
    real = rows >= 0
    follows = real[1:]
    n_tokens, size = real.sum(), 1 << FEATURE_BITS
    target = np.array([[((1 - tags[:-1]) * (1 - tags[1:]))[follows].sum(), ((1 - tags[:-1]) * tags[1:])[follows].sum()], [(tags[:-1] * (1 - tags[1:]))[follows].sum(), (tags[:-1] * tags[1:])[follows].sum()]])
    theta = [np.zeros(size), np.zeros(1), np.zeros((2, 2))]
    first = [np.zeros_like(x) for x in theta]
    second = [np.zeros_like(x) for x in theta]
    for step in range(1, steps + 1):
        w, s, tr = theta
        u = np.bincount(at, w[ids], len(got))[np.maximum(rows, 0)] * real
        p, f1, b1, e, t, _ = _forward_backward(u, lengths, float(s[0]), tr)
        diff = ((tags - p) * real).ravel()
        by_kind = np.bincount(np.maximum(rows, 0).ravel(), diff, len(got))
        # pairwise marginals
        left = np.stack([1 - f1[:-1], f1[:-1]])
        right = np.stack([1 - b1[1:], b1[1:] * e[1:]])
        pair = left[:, None] * t[:, :, None, None] * right[None]
        pair = pair / np.maximum(pair.sum((0, 1)), 1e-300) * follows
        grads = [np.bincount(ids, by_kind[at], size) / n_tokens, np.array([(tags[0] - p[0]).sum() / len(chains)]), (target - pair.sum((2, 3))) / n_tokens]
        for k, g in enumerate(grads):
            g = g - decay * theta[k] / len(chains)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            theta[k] = theta[k] + rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return theta[0].astype(np.float32), float(theta[1][0]), theta[2]


def fit_toxicity(docs: DataFrame, labels: DataFrame, where=None, rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fit on at most ``rows`` labelled rows of each class (``where``: a condition on ``labels``), of very long ones on windows over the whole text."""
    sample = labelled_sample(docs, labels, "toxic", rows, where=where)
    cut = add_columns(sample, "text", [T.StructField("excerpt", T.StringType())], lambda: lambda texts: [[excerpt(t) for t in texts]])
    got = sorted(cut.select("doc_id", F.col("excerpt").alias("text"), "y").collect(), key=lambda r: (r["doc_id"], r["text"]))
    blank = ToxicityModel(np.zeros(1 << FEATURE_BITS, np.float32), 0.0, np.zeros((2, 2)), np.zeros(4))
    totals = {r["y"]: r["n"] for r in (labels.where(where) if where is not None else labels).where(F.col("toxic").isin(0, 1)).groupBy(F.col("toxic").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = totals.get(1, 0) / max(sum(totals.values()), 1)
    if len({r["y"] for r in got}) < 2:
        return ToxicityModel(blank.weights, 0.0, blank.transition, blank.document, base=float(share))
    words = [split_words(r["text"]) for r in got]
    y = np.array([r["y"] for r in got], np.float64)
    own = [k for k in _apart(words) if zlib.crc32(got[k]["text"].encode("utf-8", "replace")) % 3]  # two thirds fit the field
    if len({y[k] for k in own}) < 2:
        own = list(range(len(got)))
    held = [k for k in range(len(got)) if zlib.crc32(got[k]["text"].encode("utf-8", "replace")) % 3 == 0]
    if len({y[k] for k in held}) < 2:
        held = list(range(len(got)))
    marks = _toxic_stems(({s for w in {bare(x) for x in words[k]} for s in stems(w) if w} for k in own), y[own])
    windows = []
    for k in own:
        tag = np.array([float(y[k] == 1 and not marks.isdisjoint(stems(bare(x)))) for x in words[k]])
        for i in range(0, len(tag), WINDOW):
            windows.append((tag[i : i + WINDOW].any(), zlib.crc32(b" ".join(words[k][i : i + WINDOW])), words[k][i : i + WINDOW], tag[i : i + WINDOW]))
    windows.sort(key=lambda x: x[1])
    tagged, plain = [x for x in windows if x[0]], [x for x in windows if not x[0]]
    chosen = tagged[: TRAIN_WINDOWS // 2] + plain[: TRAIN_WINDOWS // 2]
    w, start, transition = _fit_chain([(x[2], x[3]) for x in chosen])
    field = ToxicityModel(w, start, transition, blank.document)
    run = field.scorer()
    x = np.array([evidence(m) for k in held for _, m, _ in run([got[k]["text"]])])
    counts = {c: (y[held] == c).sum() for c in (0, 1)}
    weight = np.array([(totals[int(c)] / counts[c]) for c in y[held]])  # as many as there are labels, not as sampled
    document = newton_logistic(x, y[held], weight / weight.mean(), ridge=1e-2)
    return ToxicityModel(w, start, transition, document)


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("marginal", T.DoubleType())])
FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("spans", T.ArrayType(SPAN))]


def toxic_spans(text: str | None, words: list[bytes], marginals: np.ndarray, least: float = MIN_MARGINAL) -> list[dict]:
    """Character offsets of tokens whose marginal is at least ``least``; neighbours are joined."""
    hits = np.flatnonzero(marginals >= least)
    if not len(hits):
        return []
    data = (text or "").encode("utf-8", "replace")
    out: list[dict] = []
    byte = char = token = 0
    last = -2
    for h in hits.tolist():
        while True:  # place of word h
            at = data.index(words[token], byte)
            char += len(data[byte:at].decode("utf-8", "replace"))
            length = len(words[token].decode("utf-8", "replace"))
            byte = at + len(words[token])
            token += 1
            if token > h:
                break
            char += length
        if last == h - 1:
            out[-1]["end"] = char + length
            out[-1]["marginal"] = max(out[-1]["marginal"], float(marginals[h]))
        else:
            out.append({"start": char, "end": char + length, "marginal": float(marginals[h])})
        char += length
        last = h
    return out


def apply_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """Every row of ``docs`` with its score, predicted label and offending spans."""

    def work():
        run = model.scorer()

        def each(texts):
            got = run(texts)
            scores = [s for s, _, _ in got]
            return [scores, [int(s >= min_score) for s in scores], [toxic_spans(t, w, m) for t, (_, m, w) in zip(texts, got, strict=True)]]

        return each

    return add_columns(docs, text_col, FIELDS, work)
