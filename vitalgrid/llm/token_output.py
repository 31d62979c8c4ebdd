"""Token-id files under a Re-Pair grammar.

Documents are encoded, ordered by id and written in blocks. In each block the
most frequent pairs of neighbouring symbols are replaced by new symbols, round
after round, until no pair is left that occurs LEAST times. Pairs of one round
share no symbol in opposite places, so their replacements don't overlap, and
no pair spans two documents. Replacing pairs never makes another old pair more
frequent, so a place whose pair has become rare is looked at again only when a
new symbol comes to stand there. A block holds the pairs, the number of ids
that every new symbol stands for, and the symbols left, so any stretch of a
document is decoded from the few symbols over it.

File: blocks one after another, each with its byte length in front; a length of
zero; the index: place, documents and ids of every block; the number of
blocks. ``read_span`` finds a stretch of one document through the index. Block:
magic, six counts, the rounds' first symbols, pairs, expansion lengths,
document ids with a mask of nulls, symbols and ids per document, and the symbols
in three bytes (four if one needs them). All numbers are little-endian.

A grammar is a block's own, of BLOCK_IDS ids or one longer document: that
bounds a task's memory, whatever the size of its file.

Each sort partition writes one file, in order, so starts follow from the files'
totals. A task names its file by a fresh id and only committed tasks' files are
in the manifest. Null texts are empty (the end id alone); null document ids
come first; rows of one id keep the order of the scan. Repeated rows
are written each for itself; extra columns are ignored; an empty table gives no
files and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.arrow_map import bound_batches
from vitalgrid.llm.common import parts_for, scratch_path, settle
from vitalgrid.llm.tokens import encoder
from vitalgrid.llm.warc import filesystem

END_ID = 2
#: Ids of a block; a longer document is a block of its own.
BLOCK_IDS = 1 << 20
#: Pairs of fewer places aren't replaced: by size they pay from five places on, but they are one percent of it and many rounds.
LEAST = 8
#: Text bytes of a sort partition.
PART_BYTES = 64 << 20
_SLOT_BITS = 20
_MAGIC = b"RPG1"
_COUNTS = struct.Struct("<6Q")
_SIZE = struct.Struct("<Q")
_INDEX = struct.Struct("<3Q")


def _choose(pair: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The most frequent pairs of which no symbol is left in one and right in another, most frequent first."""
    order = np.argsort(-count, kind="stable")
    left, right, out = set(), set(), []
    for k in pair[order].tolist():
        a, b = k >> 32, k & 0xFFFFFFFF
        if a in right or b in left or (a == b and (a in left or b in right)):
            continue
        left.add(a)
        right.add(b)
        if a == b:  # takes both sides
            left.add(b)
            right.add(a)
        out.append(k)
    return np.array(out, np.int64)


def _slots(key: np.ndarray) -> np.ndarray:
    return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).view(np.int64)


def compress(ids: np.ndarray, ends: np.ndarray, least: int = LEAST):
    """(symbols, last-of-document mask, left, right, first new symbol of each round)."""
    n = len(ids)
    fresh = int(ids.max()) + 1 if n else 0
    kept = np.int32 if fresh + n < 1 << 31 else np.int64  # short numbers: most of the time goes into fetching them
    symbols = np.append(ids.astype(kept), kept(-1))
    follower, leader = np.arange(1, n + 2, dtype=kept), np.arange(-1, n, dtype=kept)
    follower[:n][ends] = n  # n is no place
    leader[1 : n + 1][ends] = n
    leader[:1] = n
    open_, live = np.append(~ends, False), np.ones(n, bool)
    lefts, rights, bases = [], [], []
    kind, slot_of = np.zeros(1 << _SLOT_BITS, np.uint8), np.zeros(1 << _SLOT_BITS, np.int32)  # of a slot: none, a frequent pair, a chosen one
    while True:
        at = np.flatnonzero(open_)
        key = symbols[at].astype(np.int64)
        key <<= 32
        key |= symbols[follower[at]]
        slot = _slots(key)
        held = np.sort(key)
        edge = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1], [True]))) if len(held) else np.zeros(1, np.int64)
        count = np.diff(edge)
        often = count >= least
        if not often.any():
            break
        pair = held[edge[:-1]][often]
        chosen = _choose(pair, count[often])
        all_slots, chosen_slots = _slots(pair), _slots(chosen)
        kind[all_slots] = 1
        kind[chosen_slots] = 2
        # of pairs in one slot the most frequent is written last, the others wait for a later round
        slot_of[chosen_slots[::-1]] = np.arange(len(chosen))[::-1]
        found = kind[slot]
        kind[all_slots] = 0
        open_[at] = found > 0
        hit = np.flatnonzero(found == 2)
        at, which = at[hit], slot_of[slot[hit]]
        same = chosen[which] == key[hit]
        at, which = at[same], which[same]
        twice = (chosen >> 32) == (chosen & 0xFFFFFFFF)
        if twice.any():
            # a symbol with itself overlaps: of neighbouring hits every second one counts
            own = np.flatnonzero(twice[which])
            there, kind_of = at[own], which[own]
            place = np.arange(len(own))
            starts = np.concatenate(([True], (follower[there[:-1]] != there[1:]) | (kind_of[1:] != kind_of[:-1])))[: len(own)]
            odd = (place - np.maximum.accumulate(np.where(starts, place, 0))) & 1 == 1
            at, which = np.delete(at, own[odd]), np.delete(which, own[odd])
        bases.append(fresh)
        lefts.append(chosen >> 32)
        rights.append(chosen & 0xFFFFFFFF)
        gone = follower[at]
        after = follower[gone]
        symbols[at] = fresh + which
        live[gone] = False
        open_[gone] = False
        follower[at] = after
        leader[after] = at
        open_[at] = True
        open_[leader[at]] = True
        open_[at[after == n]] = False
        open_[n] = False
        fresh += len(chosen)
    left = np.flatnonzero(live)
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return symbols[left].astype(np.int64), follower[left] == n, join(lefts), join(rights), np.array(bases, np.int64)


def _unfold(symbols: np.ndarray, first: int, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Symbols with those from ``first`` on replaced by their stretches of ``flat``."""
    new = symbols >= first
    rule = np.where(new, symbols - first, 0)
    many = np.where(new, length[rule], 1)
    begin = np.where(new, start[rule], len(flat) + np.arange(len(symbols)))  # old symbols stand behind
    return np.concatenate([flat, symbols])[np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]


def expand(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, bases: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for; each round's pairs are spelled out by those of the rounds before."""
    symbols = symbols.astype(np.int64)
    if not len(bases):
        return symbols.astype(np.uint32)
    first, length = int(bases[0]), expansion_lengths(left, right, bases)
    start = np.cumsum(length) - length
    flat = np.zeros(int(length.sum()), np.int64)
    edges = [*(bases - first).tolist(), len(left)]
    for a, b in zip(edges, edges[1:], strict=False):
        both = np.stack([left[a:b], right[a:b]], 1).ravel()
        spelled = _unfold(both, first, flat, start, length)
        flat[start[a] : start[a] + len(spelled)] = spelled
    return _unfold(symbols, first, flat, start, length).astype(np.uint32)


def expansion_lengths(left: np.ndarray, right: np.ndarray, bases: np.ndarray) -> np.ndarray:
    n = np.ones(len(left), np.int64)
    edges = [*bases.tolist(), (bases[0] if len(bases) else 0) + len(left)]
    first = edges[0]
    length = lambda s: np.where(s < first, 1, n[np.maximum(s - first, 0)])
    for a, b in zip(edges, edges[1:], strict=False):
        part = slice(a - first, b - first)
        n[part] = length(left[part]) + length(right[part])
    return n


class Block:
    """A block in memory; ``pack`` and ``unpack`` give and take its bytes."""

    def __init__(self, doc_ids, known, n_symbols, n_ids, left, right, bases, lengths, symbols):
        self.doc_ids, self.known, self.n_symbols, self.n_ids = doc_ids, known, n_symbols, n_ids
        self.left, self.right, self.bases, self.lengths, self.symbols = left, right, bases, lengths, symbols

    @classmethod
    def build(cls, doc_ids: list[int | None], texts: list[bytes]) -> Block:
        """From the ids of whole documents (unsigned 32-bit, none empty)."""
        n_ids = np.array([len(t) // 4 for t in texts], np.int64)
        ids = np.frombuffer(b"".join(texts), np.uint32)
        ends = np.zeros(len(ids), bool)
        ends[np.cumsum(n_ids) - 1] = True
        symbols, last, left, right, bases = compress(ids, ends)
        stops = np.flatnonzero(last) + 1
        known = np.array([d is not None for d in doc_ids], bool)
        return cls(np.array([d or 0 for d in doc_ids], np.int64), known, np.diff(stops, prepend=0), n_ids, left, right, bases, expansion_lengths(left, right, bases), symbols)

    def pack(self) -> bytes:
        width = 3 if not len(self.symbols) or self.symbols.max() < 1 << 24 else 4
        body = self.symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
        counts = _COUNTS.pack(len(self.doc_ids), len(self.symbols), len(self.left), len(self.bases), int(self.n_ids.sum()), width)
        small = [x.astype("<u4").tobytes() for x in (self.bases, self.left, self.right, self.lengths)]
        docs = [self.doc_ids.astype("<i8").tobytes(), self.known.astype(np.uint8).tobytes(), self.n_symbols.astype("<u4").tobytes(), self.n_ids.astype("<u4").tobytes()]
        return b"".join([_MAGIC, counts, *small, *docs, body])

    @classmethod
    def unpack(cls, data: bytes) -> Block:
        if data[:4] != _MAGIC:
            raise ValueError("not a block of ids")
        docs, symbols, rules, rounds, _, width = _COUNTS.unpack_from(data, 4)
        at = 4 + _COUNTS.size

        def read(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        bases, left, right, lengths = (read("<u4", n).astype(np.int64) for n in (rounds, rules, rules, rules))
        doc_ids, known, n_symbols, n_ids = read("<i8", docs), read("u1", docs).astype(bool), read("<u4", docs).astype(np.int64), read("<u4", docs).astype(np.int64)
        raw = np.zeros((symbols, 4), np.uint8)
        raw[:, :width] = read("u1", symbols * width).reshape(symbols, width)
        return cls(doc_ids, known, n_symbols, n_ids, left, right, bases, lengths, raw.view("<u4").ravel().astype(np.int64))

    def documents(self):
        """(document id, ids) of each document, in order."""
        ids, at = expand(self.symbols, self.left, self.right, self.bases), 0
        for d, k, n in zip(self.doc_ids.tolist(), self.known.tolist(), self.n_ids.tolist(), strict=True):
            yield (d if k else None), ids[at : at + n]
            at += n

    def span(self, k: int, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n`` of the k-th document, from the symbols over them alone."""
        first = int(self.n_symbols[:k].sum())
        own = self.symbols[first : first + int(self.n_symbols[k])]
        base = self.bases[0] if len(self.bases) else 1 << 40
        stops = np.cumsum(np.where(own < base, 1, self.lengths[np.maximum(own - base, 0)] if len(self.lengths) else 1))
        a, b = np.searchsorted(stops, start, "right"), np.searchsorted(stops, start + n, "left") + 1
        skipped = int(stops[a - 1]) if a else 0
        return expand(own[a:b], self.left, self.right, self.bases)[start - skipped : start - skipped + n]


def framed(block: Block) -> bytes:
    data = block.pack()
    return _SIZE.pack(len(data)) + data


def index_bytes(rows: list[tuple[int, int, int]]) -> bytes:
    """The end of a file: no further block, the index, and its number of rows."""
    return b"".join([_SIZE.pack(0), *(_INDEX.pack(*r) for r in rows), _SIZE.pack(len(rows))])


def write_ids(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, block_ids: int = BLOCK_IDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """Write all documents in id order; returns the manifest (part, file, documents, ids, bytes)."""
    spark = docs.sparkSession
    bound_batches(spark)
    folder, tail = scratch_path(spark, "ids"), np.array([end_id], np.uint32).tobytes()
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"), F.monotonically_increasing_id().alias("_n"))
    ordered = base.repartitionByRange(parts_for(docs, text_col, part_bytes), "_id", "_n").sortWithinPartitions("_id", "_n").select("_id", "_text")

    def run(batches):
        enc, (store, inside) = encoder(vocabulary), filesystem(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.rpg"
        sink, docs_, ids_, index = None, 0, 0, []
        doc_ids, texts, size = [], [], 0

        def flush():
            nonlocal sink, docs_, ids_, doc_ids, texts, size
            if not texts:
                return
            if sink is None:
                store.create_dir(inside, recursive=True)
                sink = store.open_output_stream(f"{inside}/{name}", compression=None)
            index.append((sink.tell(), len(texts), size // 4))
            sink.write(framed(Block.build(doc_ids, texts)))
            docs_, ids_ = docs_ + len(texts), ids_ + size // 4
            doc_ids, texts, size = [], [], 0

        for batch in batches:
            for d, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                if size + len(ids) + 4 > 4 * block_ids:
                    flush()
                doc_ids.append(d)
                texts.append(ids + tail)
                size += len(ids) + 4
        flush()
        if sink is not None:
            sink.write(index_bytes(index))
            total = sink.tell()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([f"{folder}/{name}"]), *(pa.array([v], pa.int64()) for v in (docs_, ids_, total))], names=["part", "file", "documents", "ids", "bytes"])

    return settle(ordered.mapInArrow(run, "part long, file string, documents long, ids long, bytes long"), "manifest")


def read_blocks(file: str):
    """The blocks of a file, one at a time."""
    store, inside = filesystem(file)
    with store.open_input_stream(inside, compression=None) as f:
        while n := _SIZE.unpack(f.read(_SIZE.size))[0]:
            yield Block.unpack(f.read(n))


def read_index(f) -> np.ndarray:
    """Rows (place, documents, ids), one for each block of an open file."""
    f.seek(f.size() - _SIZE.size)
    n = _SIZE.unpack(f.read(_SIZE.size))[0]
    f.seek(f.size() - _SIZE.size - n * _INDEX.size)
    return np.frombuffer(f.read(n * _INDEX.size), "<u8").astype(np.int64).reshape(n, 3)


def read_span(file: str, k: int, start: int, n: int) -> np.ndarray:
    """Ids ``start`` to ``start + n`` of the file's k-th document; only its block is read, only the symbols over the stretch are decoded."""
    store, inside = filesystem(file)
    with store.open_input_file(inside) as f:
        index = read_index(f)
        block = int(np.searchsorted(np.cumsum(index[:, 1]), k, "right"))
        f.seek(int(index[block, 0]))
        return Block.unpack(f.read(*_SIZE.unpack(f.read(_SIZE.size)))).span(k - int(index[:block, 1].sum()), start, n)


def read_ids(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, decoded from the files."""
    spark = manifest.sparkSession
    rows = sorted(manifest.select("part", "file", "ids").collect())  # one row per sort partition
    before, starts = 0, []
    for _, file, ids in rows:
        starts.append((file, before))
        before += ids
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    files = spark.createDataFrame(starts, "file string, start long").repartition(max(1, len(starts)))

    def run(batches):
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for block in read_blocks(file):
                    out = []
                    for d, ids in block.documents():
                        data = ids.astype("<u4").tobytes()
                        out.append((d, start, len(ids), zlib.crc32(data), data)[: len(names)])
                        start += len(ids)
                    kinds = [pa.int64()] * 4 + [pa.binary()] * with_ids
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return files.mapInArrow(run, schema)
