r"""Token ids of whole texts by the tokenizers library, with encoded units kept.

Both vocabularies split a text into units by a fixed pattern and run their
merges inside each unit. The pattern is read from the vocabulary file; where
it is one of the two known here, texts of plain characters are cut by the same
pattern, many texts at a time in arrays, and only units that a worker doesn't
hold go to the library's model. Plain are ASCII, Latin-1 and Cyrillic letters
and common punctuation: there, white space, letters and digits mean the same
everywhere, lower-casing is one to one, and no character joins its neighbour
under normalisation. They are few enough for a byte each, so a unit of up to
16 characters is two numbers, which are looked up as they are.

All other texts are encoded by the library in one go: those with another
character, those that hold an added token's string (the library gives its id),
and all texts of a vocabulary with another pattern.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain
from operator import attrgetter

import numpy as np

#: A worker keeps ids of so many units; then it begins anew.
CACHE_UNITS = 1 << 20
#: Units looked up at once. Both together fill at most five eighths of the table.
SLICE_UNITS = 1 << 18
#: Longer units are encoded each time.
LONG_UNIT = 16
#: Texts are cut into units in stretches of about so many characters.
STRETCH = 1 << 20
#: New units given to the library's model in one call.
TOGETHER = 32
_SLOT_BITS = 21
_ID = attrgetter("id")
_BETWEEN = re.compile(r"\S(?= \S)")

# The vocabularies' own patterns, as their files have them; the first is what a byte-level splitter without a pattern uses.
_SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BARE = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""

# Plain characters: each has a code, and each code a kind; code 0 ends a text.
_END, _WHITE, _LETTER, _DIGIT, _OTHER = range(5)
_LETTERS = [*range(0x41, 0x5B), *range(0x61, 0x7B), *(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)), 0x401, *range(0x410, 0x450), 0x451]
_PLAIN = "".join(map(chr, sorted({9, 10, 13, *range(0x20, 0x7F), *_LETTERS, *map(ord, "“”‘’„–—…«»¿¡€£§°")})))
_CODE = np.zeros(1 << 16, np.uint8)
_CODE[[ord(c) for c in _PLAIN]] = np.arange(1, len(_PLAIN) + 1)
_CHARACTER = np.array([0, *map(ord, _PLAIN)], "<u2")
_KIND = np.array([_END, *(_WHITE if c in "\t\n\r " else _LETTER if ord(c) in _LETTERS else _DIGIT if c in "0123456789" else _OTHER for c in _PLAIN)], np.uint8)
_FOLDED = _CODE[[0, *(ord(c.lower()) for c in _PLAIN)]]
_SPACE, _QUOTE, _S, _T, _M, _D, _R, _E, _V, _L = (int(_CODE[ord(c)]) for c in " 'stmdrevl")
#: The bytes of a word that belong to a unit with so many characters in it.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _codes(text: str) -> np.ndarray:
    """A text's codes; 0 where a character isn't plain. In stretches, as numpy widens places to eight bytes."""
    parts = [_CODE[np.frombuffer(text[k : k + STRETCH].encode("utf-16-le"), "<u2")] for k in range(0, len(text), STRETCH)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _units(codes: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each unit of texts that end in a 0 each, by _SPACED or _BARE."""
    n, kind = len(codes), _KIND[codes]
    start = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    if spaced:  # of white space before something else the last character is a unit, or the beginning of what follows if it is a space
        last = (kind[:-1] == _WHITE) & (kind[1:] > _WHITE)
        start[:-1] |= last
        start[1:] &= ~(last & (codes[:-1] == _SPACE))
    else:
        start |= kind == _DIGIT
    at = np.flatnonzero(start & (codes == _QUOTE))
    if len(at):
        first, second = codes[np.minimum(at + 1, n - 1)], codes[np.minimum(at + 2, n - 1)]
        one = (first == _S) | (first == _T) | (first == _M) | (first == _D)
        two = ((first == _R) | (first == _V)) & (second == _E) | (first == _L) & (second == _L)
        start[at[one | two] + 1] = False
        start[at[one] + 2] = True
        start[at[two] + 3] = True
    at = np.flatnonzero(start)
    length, keep = np.diff(at, append=n), kind[at] > (_END if spaced else _WHITE)
    return at[keep], length[keep]


def byte_characters() -> dict[int, str]:
    """The character that a byte-level vocabulary writes for each byte: printable ones stand for themselves, the others for what follows 255."""
    own = {b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _splitter(config: dict) -> tuple[str | None, bool]:
    """The pattern of a vocabulary file (None if it isn't known here), and whether texts are lower-cased before."""
    pre, normal = config.get("pre_tokenizer") or {}, config.get("normalizer")
    parts = pre.get("pretokenizers") if pre.get("type") == "Sequence" else [pre]
    last = parts[-1] if parts else {}
    if config["model"]["type"] != "BPE" or config["model"].get("dropout") or last.get("type") != "ByteLevel" or last.get("add_prefix_space"):
        return None, False
    if len(parts) == 1 and last.get("use_regex") and normal is None:
        return _SPACED, False
    split = parts[0]
    known = len(parts) == 2 and split.get("type") == "Split" and split.get("invert") and split.get("behavior") == "Removed" and not last.get("use_regex")
    steps = [s["type"] for s in (normal or {}).get("normalizers", [])]
    if known and steps == ["NFC", "Replace", "Lowercase"] and normal["normalizers"][1]["pattern"] == {"Regex": r"\s+"}:
        return (_BARE if split["pattern"].get("Regex") == _BARE else None), True
    return None, False


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.pattern, self.folds = _splitter(config)
        self.added = [t["content"] for t in config.get("added_tokens", [])]
        self.largest = max(self.tokenizer.get_vocab().values())
        if not self.pattern:
            return
        own = config["model"]  # the same merges without the library's cache, which units that are held here never reach
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in own["merges"]]
        suffix = {"end_of_word_suffix": own["end_of_word_suffix"]} if own.get("end_of_word_suffix") else {}
        self.model = BPE(vocab=own["vocab"], merges=merges, cache_capacity=0, ignore_merges=bool(own.get("ignore_merges")), **suffix)
        written_as = byte_characters()
        self.written_as = np.array([ord(written_as[b]) for b in range(256)], "<u2")
        # the zero byte is not plain; where it merges with nothing and a word's ends don't count, units on both sides of it are encoded as if alone
        self.between = written_as[0]
        alone = not suffix and not own.get("ignore_merges") and not own.get("continuing_subword_prefix") and not any(self.between in part for m in merges for part in m)
        self.between_id = own["vocab"].get(self.between) if alone else None
        self._begin()

    def _begin(self) -> None:
        self.words = np.zeros((1 << _SLOT_BITS, 2), np.uint64)  # of a slot: a unit's codes
        self.place = np.zeros(1 << _SLOT_BITS, np.int64)  # of a slot: where its ids begin in ``ids``, then in eight bits how many they are; 0 if they aren't known yet
        self.ids, self.used, self.held = np.zeros(1 << 16, np.uint32), 1, 0

    def whole(self, text: str) -> bytes:
        """Ids of a text by the library alone."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, codes: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place in ``ids`` and number of the ids of these units, by the library; written behind what is in use."""
        stops = np.cumsum(length + 1)
        joined = np.zeros(int(stops[-1]), np.uint8)  # a 0 after each
        inside = np.ones(len(joined), bool)
        inside[stops - 1] = False
        joined[inside] = codes[np.repeat(at - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]
        data = _CHARACTER[joined].tobytes().decode("utf-16-le").encode()
        units = self.written_as[np.frombuffer(data, np.uint8)].tobytes().decode("utf-16-le").split(self.between)[:-1]
        alone = self.between_id is None
        calls = units if alone else [self.between.join(units[k : k + TOGETHER]) + self.between for k in range(0, len(units), TOGETHER)]
        found = list(map(self.model.tokenize, calls)) if alone else map(self.model.tokenize, calls)
        ids = np.fromiter(map(_ID, chain.from_iterable(found)), np.uint32)
        if alone:
            many = np.fromiter(map(len, found), np.int64, len(found))
        else:
            end = ids == self.between_id
            many, ids = np.diff(np.flatnonzero(end), prepend=-1) - 1, ids[~end]
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + len(ids), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        return self.used + np.cumsum(many) - many, many

    def _slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of each unit; units that aren't held get one. Those of one hash stand in the slots that follow."""
        mixed = words[:, 0] * np.uint64(0x9E3779B97F4A7C15) + words[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        slot = (mixed >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        open_ = np.arange(len(words))
        while len(open_):
            at, own = slot[open_], words[open_]
            free = self.words[at, 0] == 0  # a unit's first code isn't 0
            self.words[at[free]] = own[free]  # of several units the last one stays, the others go on
            other = (np.take(self.words, at, axis=0) != own).any(1)
            open_ = open_[other]
            slot[open_] = (slot[open_] + 1) & ((1 << _SLOT_BITS) - 1)
        return slot

    def _look_up(self, codes: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these units one after another, and how many each has."""
        if self.held > CACHE_UNITS:
            self._begin()
        word = np.ndarray(len(codes) - 7, "<u8", codes, strides=(1,))  # the eight codes from each place on
        short = length <= LONG_UNIT
        a, n = (at, length) if short.all() else (at[short], length[short])
        slot = self._slots(np.stack([word[a] & _MASK[np.minimum(n, 8)], word[a + 8] & _MASK[np.clip(n - 8, 0, 8)]], 1))
        place = self.place[slot]
        new = np.flatnonzero(place == 0)
        if len(new):
            fresh, k = np.unique(slot[new], return_index=True)
            begin, many = self._learn(codes, a[new[k]], n[new[k]])
            self.place[fresh] = begin << 8 | many
            self.used, self.held = int(begin[-1] + many[-1]), self.held + len(fresh)
            place[new] = self.place[slot[new]]
        first, count = place >> 8, place & 0xFF
        if len(a) < len(at):
            both = np.zeros((2, len(at)), np.int64)
            both[:, short] = first, count
            both[:, ~short] = self._learn(codes, at[~short], length[~short])
            first, count = both
        stops = np.cumsum(count)
        return self.ids[np.repeat(first - (stops - count), count) + np.arange(int(count.sum()))], count

    def _plain(self, parts: list[np.ndarray]) -> list[bytes]:
        edge = np.cumsum([len(p) + 1 for p in parts])
        codes = np.zeros(int(edge[-1]) + LONG_UNIT, np.uint8)  # words are read beyond the end
        for p, stop in zip(parts, edge.tolist(), strict=True):
            codes[stop - 1 - len(p) : stop - 1] = p
        at, length = _units(codes[: edge[-1]], self.pattern == _SPACED)
        found = [self._look_up(codes, at[k : k + SLICE_UNITS], length[k : k + SLICE_UNITS]) for k in range(0, len(at), SLICE_UNITS)]
        if not found:
            return [b""] * len(parts)
        ids, before = np.concatenate([f[0] for f in found]), np.concatenate([[0], np.cumsum(np.concatenate([f[1] for f in found]))])
        stops = before[np.searchsorted(at, edge)].tolist()
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip([0, *stops], stops, strict=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null is empty."""
        out = [b""] * len(texts)
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush():
            nonlocal held, size
            for (k, _), ids in zip(held, self._plain([p for _, p in held]), strict=True):
                out[k] += ids
            held, size = [], 0

        for k, t in enumerate(texts):
            if not t:
                continue
            codes = _codes(t) if self.pattern else None
            if codes is None or not codes.all() or any(a in t for a in self.added):
                out[k] = self.whole(t)
                continue
            if self.folds:
                codes = _FOLDED[codes]
            at = 0
            for part in stretches(t):
                if size + len(part) > STRETCH and held:
                    flush()
                held.append((k, codes[at : at + len(part)]))
                at += len(part)
                size += len(part)
        if held:
            flush()
        return out


def stretches(text: str, size: int = STRETCH):
    """The text in parts of about ``size`` characters, cut before single spaces, where no unit goes on."""
    at = 0
    while len(text) - at > size:
        cut = _BETWEEN.search(text, at + size - 1)
        if not cut:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:] if at else text


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
