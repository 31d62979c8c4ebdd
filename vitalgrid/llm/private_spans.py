r"""Personal data: spans of four fixed patterns, and what a semi-Markov conditional random field adds to them.

The fixed patterns find e-mail and IP addresses, card and phone numbers as they
are usually written. The field finds other writings of the same kinds: ``name at
host dot org``, ``10[.]0[.]0[.]1``, ``(017) 555-7713`` without a plus, cards
grouped by dots. Its units are whole candidate segments of a text's atoms (runs
of digits, runs of letters, single other characters): features describe a segment as a whole (its digit
groups, separators, check sum, the plain form it stands for, its neighbours), weights are
per kind, and transitions tell a segment after text from one after a segment. A segment has
at most ``MAX_ATOMS`` atoms, so the sum over all segmentations, and the best one, take time
linear in the text. The best segmentation chooses boundaries and kinds together; a
segment is added if its marginal is at least ``MIN_MARGINAL`` and it touches no
span of the fixed patterns, which always stay.

There are no labels: the field is fitted to the spans of the fixed patterns in a sample
of at most about ``TRAIN_ROWS`` rows with a digit or an at sign (chosen by a hash of their text, ``ROW_ISLANDS``
pieces of each), to the same spans in other writings, and to near misses of them (failed check sums,
parts over 255, dates, amounts, numbers too short or too long) as text. A kind that the sample
doesn't have is never added; without any, nothing is.

Null and empty texts have no spans. Texts of any length run whole in linear
time: segments are only sought where digits, at signs or their spelt forms
stand, and pieces between these can hold none. Offsets are code points. Repeated rows are
treated alike; clashing columns are replaced; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.llm.arrow_map import add_columns, bound_batches

#: Fixed order of the kinds.
KINDS = ("email", "ip", "card", "phone")
#: Bounds of the sample that the field is fitted on: rows, and pieces of a row.
TRAIN_ROWS = 3000
ROW_ISLANDS = 16
#: Other writings, and near misses, that a span of the sample is turned into.
FORMS = 4
MAX_ATOMS = 32
MAX_CHARS = 96
MIN_MARGINAL = 0.5
FEATURE_BITS = 12
#: Characters that are looked at on both sides of a spelt at or dot.
REACH = 64

# Fixed patterns of the contract, in forms that never go over a character twice.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGITS = re.compile(r"[0-9]+")
_NOT_DIGITS = re.compile(r"[^0-9]+")
_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|\s|.", re.S)
_NUMERIC = re.compile(r"[+(]?[0-9](?:[0-9 ().,/\-\[\]+:]*[0-9])?")
_SIGN = re.compile(r"@|[\[({]\s?(?:at|dot)\s?[\])}]|\sdot\s", re.I)
_AT = re.compile(r"\s?(?:@|[\[({]\s?at\s?[\])}]|\sat\s)\s?", re.I)
_DOT = re.compile(r"\s?(?:\.|[\[({]\s?(?:dot|\.)\s?[\])}]|\sdot\s)\s?", re.I)


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the fixed patterns, leftmost and without overlaps inside a kind."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if _DIGITS.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGITS.sub("", m[0])) <= 19 and luhn(d):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGITS.sub("", m[0])) <= 15]
    return out


# ---------------------------------------------------------------- candidates


def islands(text: str) -> list[tuple[int, int]]:
    """Pieces of a text that can hold segments: numbers with their separators, and surroundings of at signs and spelt dots."""
    found = [m.span() for m in _NUMERIC.finditer(text) if m.end() - m.start() >= 7]
    if any(s in text for s in ("@", "dot", "Dot", "DOT", "at)", "at]", "at}", "AT)", "AT]", "AT}")):
        for m in _SIGN.finditer(text):
            lo, hi = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
            found.append((max(lo, text.rfind("\n", lo, m.start()) + 1), hi if (end := text.find("\n", m.end(), hi)) < 0 else end))
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(found):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _side(c: str) -> str:
    return "d" if c in "0123456789" and c else "w" if c.isalpha() else "_" if c.isspace() else c


def plain_email(s: str) -> str | None:
    """The address that a segment spells, with an at sign and dots; None if it has not exactly one at."""
    sides = _AT.split(s)
    return f"{sides[0]}@{_DOT.sub('.', sides[1])}" if len(sides) == 2 else None


def describe(s: str, left: str, right: str) -> list[str]:
    """Features of a segment as a whole and of its neighbours."""
    around = [f"<{_side(left)}", f">{_side(right)}"]
    if any(c.isalpha() for c in s):
        plain = plain_email(s)
        whole = bool(plain) and _emails(plain) == [(0, len(plain))]
        at = "".join(_AT.findall(s)).lower()
        dots = sorted({d.lower() for d in _DOT.findall(_AT.split(s)[-1])})
        last = re.split(r"[^A-Za-z0-9]+", s)[-1]
        names = [f"whole{whole:d}", f"at{at}{whole:d}", f"dots{dots}{whole:d}", f"tld{min(len(last), 6)}{last.isalpha():d}", f"form{at}{dots}{whole:d}", f"words{len(s.split())}{whole:d}{'.' in dots or '@' in at:d}"]
        return ["email", *names, *around, f"{around}{whole:d}"]
    groups = _DIGITS.findall(s)
    total, sizes = sum(map(len, groups)), [len(g) for g in groups]
    between = sorted({x for x in _DIGITS.split(s)[1:-1]})
    first = _DIGITS.split(s)[0]
    check = 13 <= total <= 19 and luhn("".join(groups))
    parts = len(groups) == 4 and all(int(g) <= 255 and (g == "0" or g[0] != "0") for g in groups if len(g) <= 3) and max(sizes) <= 3
    dotted = all("." in x for x in between)
    card, phone, ip = 16 <= total <= 19 and check, 8 <= total <= 15, parts and dotted
    even = len(set(sizes[:-1])) <= 1
    names = [f"n{total}", f"groups{len(groups)}", f"sizes{sizes}", f"between{between}", f"first{first}", f"card{card:d}{even:d}", f"check{total >= 16:d}{check:d}", f"ip{ip:d}", f"parts{parts:d}{dotted:d}", f"phone{phone:d}{first}{'(' in s:d}"]
    names += [f"form{sizes}{first}", f"alike{len(between) <= 1:d}{card:d}{ip:d}", f"shape{first}{between}{phone:d}{ip:d}{card:d}"]
    return ["digits", *names, *around, f"{around}{card:d}{ip:d}{phone:d}"]


def feature_ids(s: str, left: str, right: str) -> np.ndarray:
    return np.unique([zlib.crc32(n.encode("utf-8", "replace")) >> (32 - FEATURE_BITS) for n in describe(s, left, right)])


_NUMBER_ATOMS = frozenset(" ().,/-[]+:")


def candidates(text: str, lo: int, hi: int, taken: list[tuple[int, int]] = []) -> tuple[list[tuple[int, int]], list[tuple[int, int, str]]]:  # noqa: B006
    """Atoms of text[lo:hi] from the first segment to the last, and all segments (first atom, atom after the last, "email" or "digits") that touch nothing ``taken`` (in order)."""
    atoms = [m.span() for m in _ATOM.finditer(text, lo, hi)]
    kind = ["d" if "0" <= text[a] <= "9" else "a" if text[a].isascii() and text[a].isalpha() else "n" if text[a] in _NUMBER_ATOMS else "x" for a, _ in atoms]
    blocked, reach, at = [], 0, 0
    for a, b in atoms:
        while at < len(taken) and taken[at][0] < b:
            reach, at = max(reach, taken[at][1]), at + 1
        blocked.append(reach > a)
    word = [text[a:b].lower() if k == "a" else text[a:b] for (a, b), k in zip(atoms, kind, strict=True)]
    signs = [w in ("@", "at") for w in word]
    out = []
    for i in range(len(atoms)):
        if blocked[i]:
            continue
        opens = text[atoms[i][0]] in "+(" and i + 1 < len(atoms) and kind[i + 1] in "dn"
        if kind[i] == "d" or opens:
            digits = 0
            for j in range(i, min(len(atoms), i + MAX_ATOMS)):
                if blocked[j] or kind[j] not in "dn" or digits > 19:
                    break
                if kind[j] == "d":
                    digits += atoms[j][1] - atoms[j][0]
                    if 4 <= digits <= 19 and (j - i >= 6 or digits >= 7):
                        out.append((i, j + 1, "digits"))
        if (kind[i] in "da" or text[atoms[i][0]] in "._%+-") and text[atoms[i][0] - 1 : atoms[i][0]] not in _LOCAL:
            sign = dots = 0
            for j in range(i, min(len(atoms), i + MAX_ATOMS)):
                if blocked[j] or atoms[j][1] - atoms[i][0] > MAX_CHARS or "\n" in word[j] or (not sign and j > i and kind[j] == "x" and word[j] not in "@_%{}" ):
                    break
                sign += signs[j] and j > i
                dots += sign > 0 and word[j] in (".", "dot")
                if sign > 1:
                    break
                if dots and kind[j] in "da" and word[j] not in ("dot", "at") and (j + 1 == len(atoms) or kind[j + 1] not in "da"):
                    out.append((i, j + 1, "email"))
    if not out:
        return [], []
    lead, end = min(c[0] for c in out), max(c[1] for c in out)  # atoms outside can only be text
    return atoms[lead:end], [(i - lead, j - lead, form) for i, j, form in out]


# ---------------------------------------------------------------- the field


def segment_marginals(n: np.ndarray, owner: np.ndarray, at: np.ndarray, to: np.ndarray, scores: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(segment, kind) of every candidate, and per piece the log of the sum over all segmentations and the expected transitions.

    ``n`` has the atoms of each piece; candidate k is atoms ``at[k]`` to ``to[k]`` of piece ``owner[k]``, with
    a row of ``scores`` by kind. States are 0 (a single atom of text) and 1 (a segment of some kind). All pieces advance together.
    """
    (t00, t01), (t10, t11) = transition.tolist()
    most, add, each = int(n.max(initial=0)), np.logaddexp, np.arange(len(n))
    joint = add.reduce(scores, axis=1)
    f, b = np.full((2, most + 1, len(n)), -math.inf), np.full((2, most + 1, len(n)), -math.inf)
    f[0, 0], b[:, n, each] = 0.0, 0.0
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(most + 2))
    for j in range(1, most + 1):
        f[0, j] = add(f[0, j - 1] + t00, f[1, j - 1] + t10)
        if cuts[j] < cuts[j + 1]:
            k = order[cuts[j] : cuts[j + 1]]
            e, i = owner[k], at[k]
            add.at(f[1, j], e, joint[k] + add(f[0, i, e] + t01, f[1, i, e] + t11))
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(most + 1))
    for i in range(most - 1, -1, -1):
        inside = i < n
        b[0, i, inside], b[1, i, inside] = b[0, i + 1, inside] + t00, b[0, i + 1, inside] + t10
        if cuts[i] < cuts[i + 1]:
            k = order[cuts[i] : cuts[i + 1]]
            rest = joint[k] + b[1, to[k], owner[k]]
            add.at(b[0, i], owner[k], t01 + rest)
            add.at(b[1, i], owner[k], t11 + rest)
    z = b[0, 0]
    expected = np.zeros((len(n), 2, 2))
    expected[:, 0, 0] = np.exp(f[0, :-1] + t00 + b[0, 1:] - z).sum(0)
    expected[:, 1, 0] = np.exp(f[1, :-1] + t10 + b[0, 1:] - z).sum(0)
    rest = joint + b[1, to, owner] - z[owner]
    x0, x1 = np.exp(np.minimum(f[0, at, owner] + t01 + rest, 0)), np.exp(np.minimum(f[1, at, owner] + t11 + rest, 0))
    np.add.at(expected, (owner, 0, 1), x0)
    np.add.at(expected, (owner, 1, 1), x1)
    return (x0 + x1)[:, None] * np.exp(scores - joint[:, None]), z, expected


def best_segmentation(n: int, segments: Sequence[tuple[int, int]], scores: np.ndarray, transition: np.ndarray) -> list[tuple[int, int]]:
    """(candidate, kind) of the best segmentation's segments, in order."""
    (t00, t01), (t10, t11) = transition.tolist()
    kinds = scores.argmax(axis=1).tolist() if len(segments) else []
    top = scores.max(axis=1).tolist() if len(segments) else []
    ends: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (_, j) in enumerate(segments):
        ends[j].append(k)
    low = -math.inf
    v0, v1, back = [0.0] + [low] * n, [low] * (n + 1), [-1] * (n + 1)
    for j in range(1, n + 1):
        v0[j] = max(v0[j - 1] + t00, v1[j - 1] + t10)
        for k in ends[j]:
            i = segments[k][0]
            if (v := top[k] + max(v0[i] + t01, v1[i] + t11)) > v1[j]:
                v1[j], back[j] = v, k
    out, j, state = [], n, int(v1[n] > v0[n])
    while j > 0:
        if state:
            k = back[j]
            out.append((k, kinds[k]))
            j = segments[k][0]
            state = int(v1[j] + t11 > v0[j] + t01)
        else:
            j -= 1
            state = int(v1[j] + t10 > v0[j] + t00)
    return out[::-1]


@dataclass(frozen=True)
class PrivateModel:
    """Weights (feature, kind), transitions as logs, and the kinds that the sample had."""

    weights: np.ndarray
    transition: np.ndarray
    known: tuple[bool, ...]

    def scores(self, found: list[tuple[str, np.ndarray]]) -> np.ndarray:
        """A row per candidate; kinds that can't be are minus infinity, or close to it."""
        out = np.full((len(found), len(KINDS)), -1e9)
        for k, (form, ids) in enumerate(found):
            for c in (0,) if form == "email" else (1, 2, 3):
                if self.known[c]:
                    out[k, c] = self.weights[ids, c].sum()
        return out

    def added(self, text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int, float]]:
        """(kind, start, end, marginal) of what the field finds beside ``base``."""
        if not any(self.known):
            return []
        out, taken = [], sorted(s for spans in base.values() for s in spans)
        starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
        for lo, hi in islands(text):
            at = bisect_left(starts, hi)
            first = bisect_right(reach, lo, 0, at)
            near = taken[first:at]
            if any(s <= lo and e >= hi for s, e in near):
                continue
            atoms, cuts = candidates(text, lo, hi, near)
            if not cuts:
                continue
            scores = self.scores([(form, _ids(text, atoms, i, j)) for i, j, form in cuts])
            segments = [c[:2] for c in cuts]
            best = best_segmentation(len(atoms), segments, scores, self.transition)
            if best:
                at, to = np.array(segments).T
                p = segment_marginals(np.array([len(atoms)]), np.zeros(len(at), int), at, to, scores, self.transition)[0]
                out += [(KINDS[c], atoms[segments[k][0]][0], atoms[segments[k][1] - 1][1], float(p[k, c])) for k, c in best if p[k, c] >= MIN_MARGINAL]
        return out


def _ids(text: str, atoms: list[tuple[int, int]], i: int, j: int) -> np.ndarray:
    a, b = atoms[i][0], atoms[j - 1][1]
    return feature_ids(text[a:b], text[a - 1 : a] if a else "", text[b : b + 1])


# ---------------------------------------------------------------- fitting


def other_writings(kind: str, s: str) -> list[str]:
    """The same data as people write it to be read by people."""
    if kind == "email":
        user, host = s.split("@")
        parts = host.split(".")
        return [f"{user} at {' dot '.join(parts)}", f"{user}(at){host}", f"{user}[at]{'[dot]'.join(parts)}", f"{user} @ {host}", f"{user} (at) {' (dot) '.join(parts)}", f"{user}@{'[.]'.join(parts)}", f"{user} [at] {host}", f"{user}@{' dot '.join(parts)}", f"{user} AT {' DOT '.join(parts)}"]
    if kind == "ip":
        parts = s.split(".")
        return ["[.]".join(parts), " . ".join(parts), "(.)".join(parts), ". ".join(parts)]
    d = _NOT_DIGITS.sub("", s)
    if kind == "card":
        fours = [d[k : k + 4] for k in range(0, len(d), 4)]
        return [".".join(fours), "/".join(fours), "  ".join(fours), " - ".join(fours), ", ".join(fours), f"{d[:4]}.{d[4:10]}.{d[10:]}"]
    own, area, a, b = d[:-10], d[-10:-7], d[-7:-4], d[-4:]
    if len(own) < 1:
        return []
    return [f"({area}) {a}-{b}", f"({area}) {a} {b}", f"{own}-{area}-{a}-{b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}", f"{own} ({area}) {a}-{b}", f"00{own} {area} {a} {b}", f"({area}){a}-{b}", f"+{own}/{area}/{a}{b}", f"{own}.{area}.{a}.{b}"]


def near_misses(kind: str, s: str) -> list[str]:
    """What looks like a span of the kind and isn't one."""
    d = _NOT_DIGITS.sub("", s)
    if kind == "email":
        user, host = s.split("@")
        parts = host.split(".")
        return [f"{user} at {parts[0]}", f"{user}@{parts[0]}", f"@{host}", f"{parts[0]} dot {parts[-1]}", f"{user} at the {parts[0]}. {parts[-1]}", f"{user} at {parts[0]}. {parts[-1].title()}"]
    if kind == "ip":
        p = s.split(".")
        return [".".join([*p[:3], "3" + p[3].zfill(3)[-3:].replace("0", "7")]), ".".join(p[:3]), "[.]".join([*p[:2], "512", p[3]]), " ".join(p), ", ".join(p), f"{p[0]}:{p[1]}:{p[2]}", f"v{p[0]}.{p[1]}.{p[2]}"]
    if kind == "card":
        wrong = d[:-1] + str((int(d[-1]) + 3) % 10)
        fours = [wrong[k : k + 4] for k in range(0, len(wrong), 4)]
        return [wrong, " ".join(fours), ".".join(fours), "-".join(fours), d + wrong, d[:12], " - ".join(fours), "/".join(fours)]
    a, b, c = d[-10:-7], d[-7:-4], d[-4:]
    return [f"{b}-{c}", d, f"20{c[:2]}-{b[:2]}-{a[:2]} {a[:2]}:{b[:2]}:{c[:2]}", f"{a[:2]}/{b[:2]}/19{c[:2]}-{a[:2]}/{b[:2]}/20{c[:2]}", f"{a},{b},{a}.{c[:2]}", f"{a} {b}", f"{a}.{b}", f"{c} {a}{c}", f"{a[:2]} {b[:2]} {c[:2]} {c[2:]} {a[1:]}", f"19{c[:2]}-20{c[2:]}", f"20{a[:2]}{b[:2]}{c[:2]}", f"20{a[:2]}-{b[:2]}-{c[:2]}", f"({b}) {a}", f"{c}-{c}-{c}-{c}"]


@dataclass(frozen=True)
class Example:
    """A piece as the field sees it; pieces that look alike to it are one example, counted."""

    n_atoms: int
    segments: tuple[tuple[int, int], ...]
    forms: tuple[str, ...]
    ids: tuple[tuple[int, ...], ...]
    gold: tuple[tuple[int, int], ...]


def example(text: str, lo: int, hi: int, spans: list[tuple[str, int, int]]) -> Example | None:
    """A piece with its true segments; None if one of them can't be a candidate."""
    atoms, cuts = candidates(text, lo, hi)
    place = {(atoms[i][0], atoms[j - 1][1], form): k for k, (i, j, form) in enumerate(cuts)}
    gold = [(place.get((a, b, "email" if kind == "email" else "digits")), KINDS.index(kind)) for kind, a, b in spans]
    if not cuts or any(k is None for k, _ in gold):
        return None
    return Example(len(atoms), tuple(c[:2] for c in cuts), tuple(c[2] for c in cuts), tuple(tuple(_ids(text, atoms, i, j).tolist()) for i, j, _ in cuts), tuple(gold))


def examples_of(text: str, spans: list[tuple[str, int, int]]) -> list[Example]:
    """The piece as it stands, and with each span in other writings and replaced by near misses (``FORMS`` of each, in turn by a hash of the piece)."""
    turn = zlib.crc32(text.encode("utf-8", "replace"))
    some = lambda x: [x[(turn + k) % len(x)] for k in range(min(FORMS, len(x)))]
    out = [example(text, lo, hi, [s for s in spans if lo <= s[1] and s[2] <= hi]) for lo, hi in islands(text)]
    for kind, a, b in spans:
        for true, written in [(True, x) for x in some(other_writings(kind, text[a:b]))] + [(False, x) for x in some(near_misses(kind, text[a:b]))]:
            if any(base_spans(written).values()):
                continue
            put = text[:a] + written + text[b:]
            span = (a, a + len(written))
            base = [(k, *s) for k, found in base_spans(put).items() for s in found]
            if any(s < span[1] and span[0] < e for _, s, e in base):
                continue
            for lo, hi in islands(put):
                if lo < span[1] and span[0] < hi:
                    out.append(example(put, lo, hi, [s for s in base if lo <= s[1] and s[2] <= hi] + [(kind, *span)] * true))
    return [x for x in out if x]


def fit_field(examples: list[Example], steps: int = 100, rate: float = 0.3, decay: float = 1e-3) -> PrivateModel:
    """Weights and transitions by Adam on the exact log-likelihood of true segmentations."""
    size = 1 << FEATURE_BITS
    counted = Counter(examples)
    examples, weight = list(counted), np.array(list(counted.values()), float)
    known = tuple(any(c == k for x in examples for _, c in x.gold) for k in range(len(KINDS)))
    theta = [np.zeros((size, len(KINDS))), np.zeros((2, 2))]
    if not any(known):
        return PrivateModel(theta[0], theta[1], known)
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    flat = np.concatenate([i for x in examples for i in x.ids])
    owner = np.repeat(np.arange(sum(len(x.ids) for x in examples)), [len(i) for x in examples for i in x.ids])
    allowed = np.array([[(form == "email") == (c == 0) and known[c] for c in range(len(KINDS))] for x in examples for form in x.forms])
    cuts = np.cumsum([0, *(len(x.ids) for x in examples)])
    n, piece = np.array([x.n_atoms for x in examples]), np.repeat(np.arange(len(examples)), [len(x.ids) for x in examples])
    at, to = np.array([s for x in examples for s in x.segments]).T
    rows = np.repeat(weight, [len(x.ids) for x in examples])
    true, moved = np.zeros(allowed.shape), np.zeros((2, 2))
    for x, start, many in zip(examples, cuts, weight, strict=False):
        for k, c in x.gold:
            true[start + k, c] = 1
        segments = sorted(x.segments[k] for k, _ in x.gold)
        covered = {j for _, j in segments}
        i = 0
        while i < x.n_atoms:
            was = int(i in covered)
            now = next((s for s in segments if s[0] == i), None)
            moved[was, int(now is not None)] += many
            i = now[1] if now else i + 1
    for step in range(1, steps + 1):
        w, transition = theta
        scores = np.stack([np.bincount(owner, w[flat, c], len(allowed)) for c in range(len(KINDS))], axis=1)
        scores = np.where(allowed, scores, -1e9)
        p, _, e = segment_marginals(n, piece, at, to, scores, transition)
        expected = (weight[:, None, None] * e).sum(0)
        diff = (true - p) * rows[:, None]
        grads = [np.stack([np.bincount(flat, diff[owner, c], size) for c in range(len(KINDS))], axis=1) / weight.sum(), (moved - expected) / weight.sum()]
        for k, g in enumerate(grads):
            g = g - decay * theta[k] / math.sqrt(weight.sum())
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            theta[k] = theta[k] + rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return PrivateModel(theta[0].astype(np.float32), theta[1], known)


def pieces(text: str) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """At most ``ROW_ISLANDS`` pieces with their surroundings, spread over the whole text, and the spans in them."""
    found = islands(text)
    if len(found) > ROW_ISLANDS:
        found = [found[k] for k in np.linspace(0, len(found) - 1, ROW_ISLANDS).astype(int)]
    out = []
    for lo, hi in found:
        near = text[max(0, lo - 8) : min(hi, lo + 400) + 8]
        out.append((near, [(k, *s) for k, spans in base_spans(near).items() for s in spans]))
    return out


def fit_private(docs: DataFrame, text_col: str = "text", rows: int = TRAIN_ROWS) -> PrivateModel:
    """Fit on about ``rows`` rows, chosen by a hash of their text among those that have a digit or an at sign."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(f"`{text_col}`").alias("text")).where(F.col("text").rlike("[0-9@]"))
    n = texts.count()
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < max(1, min(1 << 20, rows * (1 << 20) // max(n, 1))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [near for t in batch.column(0).to_pylist() for near, _ in pieces(t)]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.string())], names=["piece"])

    got = sorted({r["piece"] for r in sample.mapInArrow(cut, "piece string").limit(2 * rows * ROW_ISLANDS).collect()})
    labelled = [(t, [(k, *s) for k, spans in base_spans(t).items() for s in spans]) for t in got]
    return fit_field([x for t, spans in labelled for x in examples_of(t, spans)])


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("fixed", T.BooleanType()), T.StructField("marginal", T.DoubleType())])
FIELDS = [T.StructField("private_spans", T.ArrayType(SPAN)), T.StructField("redacted", T.StringType())]


def redact(text: str, spans: list[dict]) -> str:
    """The text with every span replaced by its kind in brackets; spans that overlap go as one, under the first one's kind."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind']}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def find_private(text: str | None, model: PrivateModel) -> list[dict]:
    """All spans, by kind in fixed order, then start."""
    if not text:
        return []
    base = base_spans(text)
    found = [(k, a, b, True, 1.0) for k, spans in base.items() for a, b in spans] + [(k, a, b, False, p) for k, a, b, p in model.added(text, base)]
    return [dict(zip(SPAN.names, s, strict=True)) for s in sorted(found, key=lambda s: (KINDS.index(s[0]), s[1]))]


def apply_private(docs: DataFrame, model: PrivateModel, text_col: str = "text", redacted: bool = True) -> DataFrame:
    """Every row of ``docs`` with ``private_spans`` and, if wanted, its ``redacted`` text."""

    def work():
        def each(texts):
            spans = [find_private(t, model) for t in texts]
            return [spans, [redact(t, s) if t else t for t, s in zip(texts, spans, strict=True)]][: 1 + redacted]

        return each

    return add_columns(docs, text_col, FIELDS[: 1 + redacted], work)
