r"""Benchmark decontamination by greedy string tiling.

A test item and a document are compared as word sequences (A-Z lower-cased,
words are ``[^\x20\x09-\x0D]+`` without punctuation at their ends). Windows of
SEED_WORDS words that both hold are the seeds that join documents to items.
For a pair, the longest matches that overlap no tile yet are marked, again and
again, until none of at least MIN_TILE words is left; candidate matches of a
length are found by Karp-Rabin hashes and checked word by word. Tiles may
stand in any order, so reordered passages are caught. A pair is contaminated
if its tiles cover at least MIN_COVERAGE of the item's words.

The test items are a stated query set: they are read in blocks of at most
BLOCK_WORDS words, and each block passes over all documents. Within a pass each
document is worked through alone, so a passage that very many documents share
costs each of them no more.

Defined results: items or documents with null or empty text match nothing;
items shorter than MIN_TILE words match when their whole word sequence stands
in the document; of equally long matches the one earliest in the item, then in
the document, is marked first; repeated rows give repeated results; extra
columns are ignored; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.llm.arrow_map import bound_batches
from vitalgrid.llm.common import settle

#: Words of a seed window, of the shortest tile, and the least share of an item's words in tiles.
SEED_WORDS = 5
MIN_TILE = 5
MIN_COVERAGE = 0.6
#: Items are matched in blocks of at most so many words (or one item).
BLOCK_WORDS = 500_000
_EDGE = b".,;:!?\"'()[]{}<>|#*$%&+-=_/\\~`^@"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    out = [w.strip(_EDGE) for w in (text or "").encode("utf-8", "replace").lower().split()]
    return [w for w in out if w]


def _window_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes modulo 2**64 of all windows of ``length`` ids."""
    if len(ids) < length:
        return np.zeros(0, np.uint64)
    power = np.full(len(ids) + 1, _FACTOR, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    total = np.zeros(len(ids) + 1, np.uint64)
    # h[i] = sum of mixed[i + k] * factor ** (length - 1 - k), by a reversed running sum
    n = len(ids)
    weight = power[:n][::-1]
    np.cumsum(mixed * weight, dtype=np.uint64, out=total[1:])
    h = total[length:] - total[:-length]  # still carries factor ** (n - length - i)
    inverse = np.full(n + 1, np.uint64(pow(int(_FACTOR), -1, 1 << 64)), np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse, dtype=np.uint64)
    return h * inverse[: n - length + 1][::-1]


def greedy_tiles(item: np.ndarray, doc: np.ndarray, min_tile: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Tiles (item start, doc start, length) of two id sequences; ids below 0 match nothing."""
    free_item, free_doc = item >= 0, doc >= 0
    tiles: list[tuple[int, int, int]] = []
    length = _longest(item, doc, free_item, free_doc, min_tile)
    while length >= min_tile:
        for i, d in _matches(item, doc, free_item, free_doc, length):
            if free_item[i : i + length].all() and free_doc[d : d + length].all():
                free_item[i : i + length] = False
                free_doc[d : d + length] = False
                tiles.append((i, d, length))
        length = _longest(item, doc, free_item, free_doc, min_tile, length)
    return sorted(tiles)


def _free_windows(ids: np.ndarray, free: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows without a marked word, and their hashes."""
    taken = np.concatenate(([0], np.cumsum(~free)))
    if len(ids) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(taken[length:] == taken[:-length])
    return at, _window_hashes(ids, length)[at]


def _matches(item, doc, free_item, free_doc, length):
    """Pairs of starts of equal free windows, by item, then document, one at a time."""
    at_i, h_i = _free_windows(item, free_item, length)
    at_d, h_d = _free_windows(doc, free_doc, length)
    if not len(at_i) or not len(at_d):
        return
    hit = np.isin(h_d, h_i)
    places: dict[int, list[int]] = defaultdict(list)
    for d, h in zip(at_d[hit].tolist(), h_d[hit].tolist(), strict=True):
        places[h].append(d)
    for i, h in zip(at_i.tolist(), h_i.tolist(), strict=True):
        yield from ((i, d) for d in places.get(h, ()) if np.array_equal(item[i : i + length], doc[d : d + length]))


def _longest(item, doc, free_item, free_doc, least: int, most: int | None = None) -> int:
    """Length of the longest free match, 0 if it is under ``least``. A match of n words holds one of n - 1, so halving works."""
    low, high = least - 1, min(most or len(item), len(item), len(doc))
    while low < high:
        mid = (low + high + 1) // 2
        if next(_matches(item, doc, free_item, free_doc, mid), None):
            low = mid
        else:
            high = mid - 1
    return low if low >= least else 0


class ItemBlock:
    """A block of test items, indexed by their seed windows."""

    def __init__(self, items: list[tuple[int, str | None]], seed: int, min_tile: int, coverage: float):
        self.seed, self.min_tile, self.coverage = seed, min_tile, coverage
        self.number: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        hashes, owners = [], []
        self.short: dict[int, list[int]] = defaultdict(list)
        for item_id, text in items:
            ids = np.array([self.number.setdefault(w, len(self.number)) for w in words_of(text)], np.int64)
            if not len(ids):
                continue
            k = len(self.items)
            self.items.append((item_id, ids))
            width = min(seed, min_tile, len(ids))
            if width < min(seed, min_tile):
                self.short[width].append(k)
            else:
                h = np.unique(_window_hashes(ids, width))
                hashes.append(h)
                owners.append(np.full(len(h), k))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.owners = (np.concatenate(owners) if owners else np.zeros(0, np.int64))[order]

    def candidates(self, doc: np.ndarray) -> list[int]:
        found: set[int] = set()
        width = min(self.seed, self.min_tile)
        known = np.flatnonzero(np.convolve(doc >= 0, np.ones(width, int), "valid") == width) if len(doc) >= width else np.zeros(0, int)
        if len(known) and len(self.hashes):
            h = np.unique(_window_hashes(doc, width)[known])
            low, high = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
            for a, b in zip(low[high > low].tolist(), high[high > low].tolist(), strict=True):
                found.update(self.owners[a:b].tolist())
        for width, ks in self.short.items():
            if len(doc) >= width:
                h = set(_window_hashes(doc, width).tolist())
                found.update(k for k in ks if int(_window_hashes(self.items[k][1], width)[0]) in h)
        return sorted(found)

    def check(self, text: str | None) -> list[tuple[int, int, int, float, list[tuple[int, int, int]]]]:
        """(item id, item words, covered words, coverage, tiles) of every item that contaminates the text."""
        get = self.number.get
        doc = np.array([get(w, -1) for w in words_of(text)], np.int64)
        out = []
        for k in self.candidates(doc):
            item_id, ids = self.items[k]
            tiles = greedy_tiles(ids, doc, min(self.min_tile, len(ids)))
            covered = sum(t[2] for t in tiles)
            if tiles and covered >= self.coverage * len(ids):
                out.append((item_id, len(ids), covered, covered / len(ids), tiles))
        return out


TILE = T.StructType([T.StructField("item_start", T.LongType()), T.StructField("doc_start", T.LongType()), T.StructField("words", T.LongType())])


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int):
    """Lists of (id, text) of at most ``block_words`` words, one at a time on the driver."""
    block, size = [], 0
    for r in benchmark.where(F.col(text_col).isNotNull() & F.col(item_col).isNotNull()).select(item_col, text_col).toLocalIterator():
        n = len(r[1].split())
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    if block:
        yield block


def contaminated_pairs(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    seed: int = SEED_WORDS, min_tile: int = MIN_TILE, coverage: float = MIN_COVERAGE, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Rows (id, item id, item_words, covered_words, coverage, tiles) of contaminated pairs."""
    bound_batches(docs.sparkSession)
    base = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_text"))
    schema = T.StructType([T.StructField(id_col, base.schema[id_col].dataType), T.StructField(item_col, benchmark.schema[item_col].dataType), T.StructField("item_words", T.LongType()), T.StructField("covered_words", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("tiles", T.ArrayType(TILE))])
    out = base.sparkSession.createDataFrame([], schema)
    names = [f.name for f in TILE]
    for items in item_blocks(benchmark, item_col, item_text_col, block_words):

        def run(batches, items=items):
            from pyspark.sql.pandas.types import to_arrow_schema

            block, arrow = ItemBlock(items, seed, min_tile, coverage), to_arrow_schema(schema)
            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    rows += [(ids[k], *f[:4], [dict(zip(names, t, strict=True)) for t in f[4]]) for f in block.check(text)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(arrow), arrow, strict=True)], schema=arrow)

        out = out.unionByName(base.mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: float = MIN_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, judged row by row.

    Between blocks of items the rows left are written, so that a task holds one block at a time.
    """
    bound_batches(docs.sparkSession)
    position = docs.columns.index(text_col)
    for k, items in enumerate(item_blocks(benchmark, "item_id", "text", block_words)):
        docs = settle(docs, "clean") if k else docs

        def run(batches, items=items):
            block = ItemBlock(items, SEED_WORDS, MIN_TILE, coverage)
            for batch in batches:
                yield batch.filter(pa.array([not block.check(t) for t in batch.column(position).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
