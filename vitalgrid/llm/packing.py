"""Best-fit packing with patterns fitted by non-negative least squares.

The lengths' histogram has at most ``capacity`` rows, so planning is the same
work at any size. On a grid of cells, all patterns of a few lengths that fill
a sequence are enumerated; repeat counts are fitted to the histogram
by non-negative least squares and rounded; each pattern takes its pieces
longest first, the last one the longest that still fits. What is left is
packed best fit, longest first, into the room
that the patterns leave and into new sequences. The plan is made for a few
grids and the one with the fewest sequences is kept.

A plan maps (length, rank among pieces of that length) to (sequence, offset).
Each task numbers its pieces of a length while it writes them, and the tasks'
counts of each length are summed up, so a length that very many pieces share is
no one task's and pieces aren't shuffled to be ranked.

Lengths must be 1 to the capacity. Repeated rows are packed each for itself; an
empty table packs into nothing. Columns named like the added ones are
replaced.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.llm.arrow_map import bound_batches
from vitalgrid.llm.common import settle
from vitalgrid.llm.tokens import encoder

CAPACITY = 4096
END_ID = 1
#: Grids that are tried: cells that a sequence is divided into, and most documents of a pattern. Fine grids have short patterns, so that all can be enumerated.
GRIDS = ((128, 3), (64, 4), (32, 6))
_RANK_BITS = 44


def fill_patterns(cells: int, max_docs: int) -> np.ndarray:
    """Columns: how often each cell count 1..cells stands in a pattern of at most ``max_docs`` that sums to ``cells``."""
    found: list[tuple[int, ...]] = []

    def grow(parts: tuple[int, ...], left: int, most: int) -> None:
        if left == 0:
            found.append(parts)
            return
        if len(parts) == max_docs:
            return
        for p in range(min(left, most), 0, -1):
            if p * (max_docs - len(parts)) < left:
                break
            grow((*parts, p), left - p, p)

    grow((), cells, cells)
    a = np.zeros((cells, len(found)))
    for k, parts in enumerate(found):
        for p in parts:
            a[p - 1, k] += 1
    return a


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 1000) -> np.ndarray:
    """Non-negative least squares by an active set (Lawson and Hanson's scheme)."""
    n = a.shape[1]
    x, inside = np.zeros(n), np.zeros(n, bool)
    gram, right = a.T @ a, a.T @ b
    tolerance = 1e-9 * max(1.0, np.abs(right).max())
    for _ in range(steps):
        gain = right - gram @ x
        gain[inside] = -np.inf
        k = int(gain.argmax())
        if gain[k] <= tolerance:
            break
        inside[k] = True
        while True:
            used = np.flatnonzero(inside)
            z = np.linalg.solve(gram[np.ix_(used, used)] + 1e-12 * np.eye(len(used)), right[used])
            if (z > 0).all():
                break
            bad = z <= 0
            step = (x[used][bad] / np.maximum(x[used][bad] - z[bad], 1e-300)).min()
            x[used] += step * (z - x[used])
            inside[used[x[used] <= 1e-12]] = False
            x[~inside] = 0
            if not inside.any():
                break
        x[:] = 0
        used = np.flatnonzero(inside)
        x[used] = z[: len(used)] if len(z) == len(used) else 0
    return x


class Plan:
    """Where each piece goes: per length, runs of ranks that go to runs of sequences."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.entries: list[tuple[int, int, int, int, int]] = []  # length, first rank, first sequence, copies each, offset
        self.next_rank: dict[int, int] = defaultdict(int)
        self.n_sequences = 0
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free room: runs (first sequence, how many)
        self.rooms: list[int] = []

    def _give(self, free: int, first: int, n: int) -> None:
        if n and free:
            if not self.room[free]:
                insort(self.rooms, free)
            self.room[free].append((first, n))

    def _assign(self, length: int, first: int, n: int, copies: int, offset: int) -> None:
        self.entries.append((length, self.next_rank[length], first, copies, offset))
        self.next_rank[length] += n * copies

    def pattern(self, lengths: list[int], n: int) -> None:
        """``n`` new sequences of one piece of each of the lengths."""
        for k, length in enumerate(lengths):
            same = lengths[:k].count(length)
            if not same:  # equal lengths stand side by side and go in as one run of copies
                self._assign(length, self.n_sequences, n, lengths.count(length), sum(lengths[:k]))
        self._give(self.capacity - sum(lengths), self.n_sequences, n)
        self.n_sequences += n

    def best_fit(self, length: int, count: int) -> None:
        """Pieces of one length, each to the fullest sequence that has room."""
        while count:
            k = bisect_left(self.rooms, length)
            if k == len(self.rooms):
                n = -(-count // (self.capacity // length))
                self._give(self.capacity, self.n_sequences, n)
                self.n_sequences += n
                continue
            free = self.rooms[k]
            first, n = self.room[free].pop()
            if not self.room[free]:
                self.rooms.pop(k)
            copies = min(free // length, count)
            m = min(n, count // copies)
            self._assign(length, first, m, copies, self.capacity - free)
            self._give(free - copies * length, first, m)
            self._give(free, first + m, n - m)
            count -= m * copies


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, grids: tuple[tuple[int, int], ...] = GRIDS) -> Plan:
    """The plan with the fewest sequences over the grids."""
    if histogram and not (1 <= min(histogram) and max(histogram) <= capacity):
        raise ValueError(f"lengths must be 1 to {capacity}")
    plans = [_plan(histogram, capacity, min(cells, capacity), docs) for cells, docs in grids]
    return min(plans, key=lambda p: p.n_sequences)


class Stock:
    """Pieces not packed yet, by length."""

    def __init__(self, histogram: dict[int, int]):
        self.count = {n: c for n, c in histogram.items() if c}
        self.lengths = sorted(self.count)

    def longest(self, most: int, used: list[int], least: int = 1) -> int | None:
        """The longest length of ``least`` to ``most`` with a piece beyond those in ``used``."""
        k = bisect_right(self.lengths, most) - 1
        while k >= 0 and self.lengths[k] >= least:
            if self.count[self.lengths[k]] > used.count(self.lengths[k]):
                return self.lengths[k]
            k -= 1
        return None

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length]
            self.lengths.pop(bisect_left(self.lengths, length))


def _plan(histogram: dict[int, int], capacity: int, cells: int, max_docs: int) -> Plan:
    plan, cell, stock = Plan(capacity), -(-capacity // cells), Stock(histogram)
    b = np.zeros(cells)
    for length, n in histogram.items():
        b[-(-length // cell) - 1] += n
    if b.sum():
        a = fill_patterns(cells, max_docs)
        weight = np.sqrt(np.arange(1, cells + 1) / cells)[:, None]  # a long piece that is left over costs more
        x = nnls(a * weight, b * weight[:, 0] / b.sum()) * b.sum()
        for k in np.argsort(-x, kind="stable"):
            n = round(x[k])
            parts = [q + 1 for q in np.flatnonzero(a[:, k])[::-1] for _ in range(int(a[q, k]))]
            while n > 0:
                # all but the last piece come from their cells; the last is the longest that still fits
                lengths: list[int] = []
                for q in parts[:-1]:
                    got = stock.longest(q * cell, lengths, (q - 1) * cell + 1)
                    if got is None:
                        break
                    lengths.append(got)
                last = stock.longest(capacity - sum(lengths), lengths) if len(lengths) == len(parts) - 1 else None
                if last is None:
                    break
                lengths = sorted([*lengths, last], reverse=True)
                m = min(n, *(stock.count[v] // lengths.count(v) for v in lengths))
                plan.pattern(lengths, m)
                for v in lengths:
                    stock.take(v, m)
                n -= m
    for length in sorted(stock.count, reverse=True):
        plan.best_fit(length, stock.count[length])
    return plan


def pack(pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY, grids: tuple[tuple[int, int], ...] = GRIDS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (longs); offsets are gapless from 0 in a sequence."""
    added = {"sequence_id", "offset"}
    pieces = pieces.select(*(F.col(f"`{c}`") for c in pieces.columns if c.lower() not in added))
    place = pieces.columns.index(length_col)
    bound_batches(pieces.sparkSession)
    numbered = T.StructType([*pieces.schema.fields, T.StructField("_part", T.LongType()), T.StructField("_own", T.LongType())])

    def number(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            n = batch.column(place).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(n) and not (n.min() >= 1 and n.max() <= capacity):
                raise ValueError(f"lengths must be 1 to {capacity}")
            order = np.argsort(n, kind="stable")
            sorted_ = n[order]
            own = np.empty(len(n), np.int64)
            own[order] = np.arange(len(n)) - np.searchsorted(sorted_, sorted_) + seen[sorted_]
            seen += np.bincount(n, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, np.int64)), pa.array(own)], names=numbered.names)

    written = settle(pieces.mapInArrow(number, numbered), "pieces", "zstd")
    counts = settle(written.groupBy("_part", F.col(f"`{length_col}`").cast("long").alias("_n")).agg(F.count(F.lit(1)).alias("_many")), "lengths")
    histogram = {r["_n"]: r["many"] for r in counts.groupBy("_n").agg(F.sum("_many").alias("many")).collect()}  # at most ``capacity`` rows
    plan = plan_packing(histogram, capacity, grids)
    # a window over the tasks' counts of one length
    before = Window.partitionBy("_n").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumnRenamed("_part", "_p").select("_p", "_n", F.coalesce(F.sum("_many").over(before), F.lit(0)).alias("_base"))
    base = settle(base, "ranks")  # broadcast or joined by its measured size
    ranked = written.join(base, (F.col("_part") == F.col("_p")) & (F.col(f"`{length_col}`") == F.col("_n")))
    ranked = ranked.select(*(F.col(f"`{c}`") for c in pieces.columns), (F.col("_base") + F.col("_own")).alias("_rank"))
    entries = np.array(sorted(plan.entries), np.int64).reshape(-1, 5)
    out = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def assign(batches):
        keys = (entries[:, 0] << _RANK_BITS) | entries[:, 1]
        for batch in batches:
            n = batch.column(place).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            e = entries[np.searchsorted(keys, (n << _RANK_BITS) | rank, "right") - 1] if len(n) else entries[:0]
            inside = rank - e[:, 1]
            sequence, offset = e[:, 2] + inside // e[:, 3], e[:, 4] + inside % e[:, 3] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=out.names)

    return ranked.mapInArrow(assign, out)


def token_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False, id_type: str = "<u4") -> DataFrame:
    """Pieces (id, piece, start, length, ids_crc32[, ids]) of every document's ids and the end id.

    ``ids`` holds numbers of ``id_type``; ``ids_crc32`` is always that of 32-bit ids.

    Only documents longer than ``capacity`` are cut. Null text is empty: its one piece is the end id.
    """
    bound_batches(docs.sparkSession)
    base = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_text"))
    schema = T.StructType([base.schema.fields[0], T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32"))])
    if with_ids:
        schema = schema.add("ids", T.BinaryType())
    tail = np.array([end_id], np.uint32).tobytes()

    def run(batches):
        enc = encoder(vocabulary)
        if max(enc.largest, end_id) > np.iinfo(id_type).max:
            raise ValueError(f"ids of the vocabulary don't fit {id_type}")
        for batch in batches:
            kind, cols = batch.schema.field(0).type, [[] for _ in range(6)]
            for k, ids in enumerate(enc.encode(batch.column(1).to_pylist())):
                ids += tail
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for c, v in zip(cols, (k, piece, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4").astype(id_type).tobytes() if with_ids else None), strict=True):
                        c.append(v)
            arrays = [batch.column(0).take(pa.array(cols[0], pa.int32())).cast(kind), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(cols[5], pa.binary())] if with_ids else []), names=schema.names)

    return base.mapInArrow(run, schema)


def sequences(packed: DataFrame, members: tuple[str, ...] = ()) -> DataFrame:
    """(sequence_id, ids, starts[, members]): the ids of each sequence joined, from pieces that were cut with their ids.

    ``members`` names columns of the pieces that are kept, in the order of ``starts``.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", *members)))  # a sequence has at most ``capacity`` pieces
    kept = [F.transform("p", lambda x: F.struct(*(x[m].alias(m) for m in members))).alias("members")] if members else []
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.expr("aggregate(p.ids, cast('' as binary), (a, x) -> concat(a, x))").alias("ids"), F.col("p.offset").alias("starts"), *kept)


def write_sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The sequences of ``packed`` pieces with the pieces they hold, written to the shared folder and read back."""
    return settle(sequences(packed, (id_col, "piece", "start")), "sequences", "zstd")


def read_pieces(written: DataFrame, id_type: str = "<u4") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece in written sequences, from their ids."""
    held = written.schema["members"].dataType.elementType.fields
    schema = T.StructType([*held, *(T.StructField(n, T.LongType()) for n in ("length", "ids_crc32", "sequence_id", "offset"))])
    width = np.dtype(id_type).itemsize

    def run(batches):
        for batch in batches:
            cols = [[] for _ in range(4)]
            for sequence, ids, starts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                whole = np.frombuffer(ids, id_type).astype("<u4")
                for at, end in zip(starts, [*starts[1:], len(ids) // width], strict=True):
                    for c, v in zip(cols, (end - at, zlib.crc32(whole[at:end]), sequence, at), strict=True):
                        c.append(v)
            own = batch.column(3).flatten()
            yield pa.RecordBatch.from_arrays([*(own.field(k) for k in range(len(held))), *(pa.array(c, pa.int64()) for c in cols)], names=schema.names)

    return written.select("sequence_id", "ids", "starts", "members").mapInArrow(run, schema)
