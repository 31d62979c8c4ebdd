r"""Jaccard join over word shingles by parity sketches.

A document's set holds its distinct five-word shingles (A-Z lower-cased, words
``[^\x20\x09-\x0D]+``); with fewer words its whole word sequence is the one
shingle. Sets x and y of similarity J >= 0.75 differ in at most
d = (|x| + |y|) / 7 shingles.

Sketch: every shingle falls by its hash into one of m cells of 64 bits and is
XORed into it. A differing shingle changes one cell, so the number of differing
cells is at most d. m follows from the size band (a power of two; sets under
SMALL use a cell per shingle), and a set near its band's lower end also
enters the band below. Pigeonhole: under one order of all cell values, the
first common cell of two sets is among the first d + 1 cells of both, so each
set is filed under its first D + 1 cells, D being the most that its band
allows. The order puts cells last that hold only very frequent shingles.
A set with fewer than D + 1 cells in use would break the bound; the hash is
then seeded anew, until no set has.

Equal sets are one class from the start. Classes that share a key are
candidates. A parity sketch of SKETCH_BITS bits per class, whose Hamming
distance can't exceed the symmetric difference, drops most pairs that are too
far apart, and for sets of WIDE shingles or more one of at least two bits a shingle; exact verification reads the texts of the others again.

Keys are dealt to parts by their hash and put side by side in arrays, part by
part; only buckets of two classes or more are kept. Components take a spanning
set of links only: first each bucket's classes meet the smallest of them and the one
before them by size, then all pairs of classes that share a
bucket and whose components differ. A hub's partners are dealt out in
portions, each with the hub's text once. Linked classes are in one component,
so all links are found inside components: a component's classes are dealt to
blocks, each pair of blocks is one portion of work, in which sketches and then
intersection counts are compared in arrays. Links are kept as lists of
partners by class and pair of blocks, never as rows of pairs.

Defined results: null texts and texts without words have no set, and are
linked with nothing (component_id is the own id); a component's id is its
smallest doc_id; rows with a null id take part and take their component's id;
repeated rows are copies; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.llm.arrow_map import bound_batches, giving_back
from vitalgrid.llm.common import settle
from vitalgrid.llm.quality import word_hashes

WORDS = 5
#: The similarity as a fraction: 100 * intersection >= 75 * union.
SHARE, OF = 75, 100
#: Sets under this size have a cell for every shingle.
SMALL = 64
#: Bits of the parity sketch that pairs are screened by.
SKETCH_BITS = 512
SKETCH = [f"s{k}" for k in range(SKETCH_BITS // 64)]
#: Sets from this size on have a second sketch, as long as they are.
WIDE = 256
#: Texts are hashed in stretches of about so many bytes.
STRETCH = 1 << 17
#: Frequent shingles are looked for in runs of so many, and at most so many are told to all tasks. They only order cells.
COUNTED_AT_ONCE = 1 << 20
MOST_FREQUENT = 50_000
#: A class carries so many of its keys, to tell that a pair meets more than once.
FIRST_KEYS = 8
#: Parts of the keys for each shuffle partition, keys that a task holds before it puts them side by side, and shingles of a part (a set has fewer keys).
PARTS, HELD_KEYS, PART_SHINGLES = 3, 1 << 20, 1 << 22
#: Keys that a task holds before it deals them out; what is dealt comes to its reader in batches as large.
DEALT_KEYS = 1 << 18
#: Bits of a key inside its part: what falls together by them is one more candidate, never one less.
KEY_BITS = 40
#: Partners that a hub meets in one portion.
PORTION = 64
#: Words of 64 marks that tell which texts are wanted; so few wanted rows are told to all tasks, and their texts stay where they are until they are dealt out.
MARK_WORDS, TOLD_ROWS = 1 << 18, 50_000
#: Classes and shingles of a block of a component, and shingles that are compared at a time.
BLOCK_CLASSES, BLOCK_SHINGLES, AT_ONCE = 128, 1 << 18, 1 << 15
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    out: list[np.ndarray] = []
    stretch: list[bytes] = []
    size = 0

    def flush():
        nonlocal stretch, size
        if not stretch:
            return
        buf = np.frombuffer(b"\n".join(stretch), np.uint8)
        start, h = word_hashes(buf)
        n = max(0, len(h) - WORDS + 1)
        s = np.zeros(n, np.uint64)
        for k in range(WORDS):
            s += h[k : k + n] * _C[k]
        s = mix(s)
        edges = np.cumsum([0] + [len(t) + 1 for t in stretch])
        at = np.searchsorted(start, edges)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= WORDS:
                x = np.sort(s[a : b - WORDS + 1])
                out.append(x[np.concatenate((x[:1] == x[:1], x[1:] != x[:-1]))])
            elif b > a:
                with np.errstate(over="ignore"):
                    short = np.array([sum((int(h[a + k]) * int(_C[k]) for k in range(b - a)), b - a) & 0xFFFFFFFFFFFFFFFF], np.uint64)
                out.append(mix(mix(short)))
            else:
                out.append(np.zeros(0, np.uint64))
        stretch, size = [], 0

    for t in texts:
        data = (t or "").encode("utf-8", "replace").lower()
        if size + len(data) > STRETCH:
            flush()
        stretch.append(data)
        size += len(data) + 1
    flush()
    return out


def class_of(s: np.ndarray) -> int:
    """64-bit name of a set (signed), from its size and all its hashes."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([np.bitwise_xor.reduce(s) + s.sum(dtype=np.uint64) * _C[1] + np.uint64(len(s)) * _C[2]], np.uint64)).view(np.int64)[0]) if len(s) else 0


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the shingles that fall on each bit, as signed 64-bit words."""
    at = (mix(s ^ _C[1]) >> np.uint64(33)) % np.uint64(SKETCH_BITS)
    odd = np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def wide_sketch(s: np.ndarray) -> bytes | None:
    """Parities of the shingles on a power of two of bits, at least two for each shingle; none for small sets."""
    if len(s) < WIDE:
        return None
    bits = 1 << (2 * len(s) - 1).bit_length()
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def wide_distance(a: bytes, b: bytes) -> int:
    """Differing bits of two wide sketches; the longer one is folded to the length of the other."""
    x, y = (np.frombuffer(v, np.uint64) for v in sorted((a, b), key=len))
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def _near(a: str, b: str) -> Column:
    """Whether two sketches (columns with prefixes) leave room for the similarity; sizes are the columns ``n``."""
    distance = sum((F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in SKETCH), F.lit(0))
    return distance * 7 <= F.col(f"{a}n") + F.col(f"{b}n")


def bands(n: int) -> list[tuple[int, int]]:
    """(cells, D) of each band that a set of n shingles enters; 0 cells: one for each shingle."""
    top = OF * n // SHARE  # the largest partner
    if n < SMALL:
        return [(0, (n + top) // 7)]
    low = 1 << (n.bit_length() - 1)
    own = (low, (n + min(top, 2 * low - 1)) // 7)
    if SHARE * n > OF * (low - 1):
        return [own]
    return [own, (low // 2 if low > SMALL else 0, (n + low - 1) // 7)]


def _seeded(s: np.ndarray, seed: int) -> np.ndarray:
    return mix(s + np.uint64(seed * int(_C[4]) & 0xFFFFFFFFFFFFFFFF))


def cells_of(s: np.ndarray, cells: int, seed: int, frequent: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set's cells in the common order, and whether there are any; keys are signed 64-bit."""
    own = _seeded(s, seed)
    rate = np.zeros(len(s), np.int64)
    if len(frequent) and len(s):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        rate = np.where(frequent[at] == s, often[at], 0)
    if cells == 0:
        value, many, rare = own, np.ones(len(s), np.int64), rate
    else:
        cell = (own >> np.uint64(20)) & np.uint64(cells - 1)
        order = np.argsort(cell, kind="stable")
        edge = np.flatnonzero(np.diff(cell[order], prepend=np.uint64(cells)))
        value = np.bitwise_xor.reduceat(own[order], edge)
        many = np.diff(np.append(edge, len(s)))
        rare = np.minimum.reduceat(rate[order], edge)
    key = mix(value + np.uint64(cells * int(_C[3]) & 0xFFFFFFFFFFFFFFFF))
    return key[np.lexsort((key, -many, rare))].view(np.int64), rare


def _edges(sets: list[np.ndarray]) -> np.ndarray:
    return np.cumsum([0, *map(len, sets)])


def summaries(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``class_of`` and ``parity_sketch`` of many sets at a time."""
    edge, name, bits = _edges(sets), np.zeros(len(sets), np.uint64), np.zeros((len(sets), SKETCH_BITS), np.uint8)
    if edge[-1]:
        s, n = np.concatenate(sets), np.diff(edge)
        some = np.flatnonzero(n)
        at = edge[:-1][some]
        name[some] = mix(np.bitwise_xor.reduceat(s, at) + np.add.reduceat(s, at) * _C[1] + n[some].astype(np.uint64) * _C[2])
        place = ((mix(s ^ _C[1]) >> np.uint64(33)) % np.uint64(SKETCH_BITS)).astype(np.int64) + np.repeat(np.arange(len(sets)) * SKETCH_BITS, n)
        bits = (np.bincount(place, minlength=bits.size) & 1).astype(np.uint8).reshape(bits.shape)
    return name.view(np.int64), np.packbits(bits, axis=1, bitorder="little").view(np.int64)


def too_few(sets: list[np.ndarray], seed: int) -> np.ndarray:
    """1 for each set that has no more than D cells in use in one of its bands."""
    out = np.zeros(len(sets), np.int64)
    edge = _edges(sets)
    entered = [(k, cells, d) for k, s in enumerate(sets) if len(s) for cells, d in bands(len(s)) if cells]
    if not entered:
        return out
    cell = _seeded(np.concatenate(sets), seed) >> np.uint64(20)
    owner, cells, most = (np.array(x, np.int64) for x in zip(*entered, strict=True))
    start = np.cumsum(cells) - cells
    used = np.zeros(int(cells.sum()), bool)
    for (k, m, _), at in zip(entered, start.tolist(), strict=True):
        used[at + (cell[edge[k] : edge[k + 1]] & np.uint64(m - 1)).astype(np.int64)] = True
    out[owner[np.add.reduceat(used, start, dtype=np.int64) <= most]] = 1
    return out


def first_cells(sets: list[np.ndarray], seed: int, frequent: np.ndarray, often: np.ndarray) -> list[np.ndarray]:
    """For each set that isn't empty the keys that it is filed under: in each band those of its first D + 1 cells, with all that stand level with the last of them.

    The order is that of ``cells_of`` with rates under 2**20, sizes under 256 and 36 bits of the keys; what is level in it is all taken, so no pair is lost.
    """
    edge, s = _edges(sets), np.concatenate(sets)
    own, rate = _seeded(s, seed), np.zeros(len(s), np.uint64)
    if len(frequent):
        may = np.zeros(1 << 20, bool)  # few shingles are frequent: most are told apart by their first bits
        may[frequent >> np.uint64(44)] = True
        look = np.flatnonzero(may[s >> np.uint64(44)])
        at = np.minimum(np.searchsorted(frequent, s[look]), len(frequent) - 1)
        rate[look] = np.where(frequent[at] == s[look], np.minimum(often[at], (1 << 20) - 1), 0)
    cell, out = own >> np.uint64(20), []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        keys = []
        for cells, d in bands(b - a):
            if cells == 0:
                value, rank = own[a:b], (rate[a:b] << np.uint64(44)) | np.uint64(254 << 36)
            else:
                place = cell[a:b] & np.uint64(cells - 1)
                order = np.argsort(place.astype(np.uint16) if cells <= 1 << 16 else place, kind="stable")  # short numbers are sorted by counting
                place = place[order]
                first = np.concatenate((np.zeros(1, np.int64), np.flatnonzero(place[1:] != place[:-1]) + 1))
                many = np.minimum(np.diff(first, append=b - a), 255).astype(np.uint64)
                value = np.bitwise_xor.reduceat(own[a:b][order], first)
                rank = (np.minimum.reduceat(rate[a:b][order], first) << np.uint64(44)) | ((np.uint64(255) - many) << np.uint64(36))
            key = mix(value + np.uint64(cells * int(_C[3]) & 0xFFFFFFFFFFFFFFFF))
            rank |= key >> np.uint64(28)
            keys.append(key[rank <= np.partition(rank, d)[d]] if d < len(rank) else key)
        out.append(np.concatenate(keys).view(np.int64))
    return out


def _classes(docs: DataFrame, id_col: str, text_col: str, seed: int) -> tuple[DataFrame, DataFrame, int, int]:
    """(id, h, n, class, sketches) of every row, h a hash of its text; frequent shingles with their counts; how many sets break the bound under the seed; how many shingles there are."""
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(f"`{text_col}`").alias("text"))
    count = T.StructType([T.StructField("h", T.LongType()), T.StructField("c", T.LongType())])
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("h", T.LongType()), T.StructField("n", T.LongType()), T.StructField("class", T.LongType()), T.StructField("short", T.IntegerType()), *(T.StructField(k, T.LongType()) for k in SKETCH), T.StructField("wide", T.BinaryType()), T.StructField("counts", T.ArrayType(count))])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * len(SKETCH), pa.binary(), pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64())]))]
    none = np.zeros(0, np.uint64)

    def run(batches):
        held, size, rows = [], 0, 0

        def counted():
            nonlocal held, size, rows
            h = np.sort(np.concatenate(held)) if held else none
            edge = np.flatnonzero(np.concatenate((h[:1] == h[:1], h[1:] != h[:-1])))
            h, c = h[edge], np.diff(edge, append=len(h))
            keep = c >= max(4, rows // 200)
            out = [{"h": int(a), "c": int(b)} for a, b in zip(h[keep].view(np.int64), c[keep], strict=True)]
            held, size, rows = [], 0, 0
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((None, None, -1, 0, 0, *[0] * len(SKETCH), None, out), kinds, strict=True)], names=schema.names)

        for batch in batches:
            sets = shingle_sets(batch.column(2).to_pylist())
            name, sketch = summaries(sets)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, k) for v, k in zip(([len(s) for s in sets], name, too_few(sets, seed), *sketch.T, [wide_sketch(s) for s in sets], [None] * len(sets)), kinds[2:], strict=True))], names=schema.names)
            held += sets
            size, rows = size + sum(map(len, sets)), rows + len(sets)
            if size >= COUNTED_AT_ONCE:
                yield counted()
        if held:
            yield counted()

    got = settle(base.mapInArrow(giving_back(run), schema), "sets")
    rows = got.where(F.col("n") >= 0)
    frequent = got.where(F.col("n") < 0).select(F.explode("counts").alias("x")).groupBy("x.h").agg(F.sum("x.c").alias("c"))
    short, shingles = (v or 0 for v in rows.agg(F.sum("short"), F.sum("n")).first())
    return rows.select("id", "h", "n", "class", *SKETCH, "wide"), frequent, short, shingles


def _dealt(keys: np.ndarray, classes: np.ndarray, sizes: np.ndarray, parts: int) -> pa.RecordBatch:
    """One row for each part that keys fall into: the keys' last bits, and the runs of keys that a class has there."""
    key = keys.view(np.uint64)
    part = ((key >> np.uint64(KEY_BITS)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    key, part, name = key[order], part[order], classes[order]
    low, high = key.astype("<u4"), (key >> np.uint64(32)).astype(np.uint8)
    edge = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (name[1:] != name[:-1]))))
    run, own, size = np.diff(edge, append=len(key)).astype("<i4"), name[edge], sizes[order[edge]].astype("<i4")
    at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    stop, first = np.append(at[1:], len(key)).tolist(), np.searchsorted(edge, at)
    last = np.append(first[1:], len(edge)).tolist()
    cut = lambda v, a, b: [v[x:y].tobytes() for x, y in zip(a, b, strict=True)]
    at_, first_ = at.tolist(), first.tolist()
    columns = [cut(low, at_, stop), cut(high, at_, stop), cut(own, first_, last), cut(size, first_, last), cut(run, first_, last)]
    return pa.RecordBatch.from_arrays([pa.array(part[at], pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["part", "low", "high", "classes", "sizes", "runs"])


def side_by_side(key: np.ndarray, name: np.ndarray, size: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns (key, class) of the buckets of two classes or more, with the partners that a class meets first: the bucket's smallest and the one before it by size; 0 where there is none of a fitting size. Beside them the places of one class of every bucket."""
    order = np.lexsort((name, size, key))
    key, name, size = key[order], name[order], size[order]
    new = np.concatenate((key[:1] == key[:1], (key[1:] != key[:-1]) | (name[1:] != name[:-1])))
    order, key, name, size = order[new], key[new], name[new], size[new]
    start = np.flatnonzero(np.concatenate((key[:1] == key[:1], key[1:] != key[:-1])))
    many = np.diff(start, append=len(key))
    at = np.arange(len(key))
    first = np.repeat(start, many)
    held = np.repeat(many, many) > 1
    partners = []
    for other in (first, np.maximum(at - 1, first)):
        a, b = np.minimum(size[other], size), np.maximum(size[other], size)
        partners.append(np.where((other != at) & (OF * a >= SHARE * b), name[other], 0)[held])
    return [key[held], name[held], *partners], order[start]


def _shared(docs: DataFrame, text_col: str, seed: int, frequent: np.ndarray, often: np.ndarray, shingles: int) -> DataFrame:
    """(key, class, one, before): each class under those of its first D + 1 cells of each band that another class has too, with the partners that it meets first."""
    base = docs.select(F.col(f"`{text_col}`").alias("text"))
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(PARTS * width, -(-shingles // PART_SHINGLES))

    def deal(batches):
        seen: set[int] = set()
        held, size = [], 0

        def dealt():
            nonlocal held, size
            out = _dealt(*(np.concatenate(c) for c in zip(*held, strict=True)), parts)
            held, size = [], 0
            return out

        for batch in batches:
            sets, fresh = shingle_sets(batch.column(0).to_pylist()), {}
            for s, name in zip(sets, summaries(sets)[0].tolist(), strict=True):
                if len(s) and name not in seen:
                    seen.add(name)
                    fresh[name] = s
            if fresh:
                keys = first_cells(list(fresh.values()), seed, frequent, often)
                many = [len(k) for k in keys]
                held.append((np.concatenate(keys), np.repeat(np.array(list(fresh), np.int64), many), np.repeat(np.array([len(s) for s in fresh.values()], np.int32), many)))
                size += sum(many)
                if size >= DEALT_KEYS:
                    yield dealt()
        if held:
            yield dealt()

    def meet(batches):
        part, held, size, most = None, [], 0, HELD_KEYS

        def met(last: bool):
            nonlocal held, size, most
            k, c, n = (np.concatenate(x) for x in zip(*held, strict=True))
            columns, one = side_by_side(k, c, n)
            # of a bucket that may go on one class stays, so that what follows meets it; what stays is bounded by the part's different keys
            held, size = ([], 0) if last else ([(k[one], c[one], n[one])], len(one))
            most = max(HELD_KEYS, 2 * size)
            for a in range(0, len(columns[0]), HELD_KEYS):
                key, name, *others = (v[a : a + HELD_KEYS] for v in columns)
                yield pa.RecordBatch.from_arrays([pa.array(key | (part << KEY_BITS)), pa.array(name), *(pa.array(o, mask=o == 0) for o in others)], names=["key", "class", "one", "before"])

        for batch in batches:
            for p, low, high, own, sizes, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    if held:
                        yield from met(True)
                    part, most = p, HELD_KEYS
                key = np.frombuffer(low, "<u4").astype(np.int64) | (np.frombuffer(high, np.uint8).astype(np.int64) << 32)
                run = np.frombuffer(runs, "<i4")
                held.append((key, np.repeat(np.frombuffer(own, np.int64), run), np.repeat(np.frombuffer(sizes, "<i4"), run)))
                size += len(key)
                if size >= most:
                    yield from met(False)
        if held:
            yield from met(True)

    dealt = base.mapInArrow(giving_back(deal), "part int, low binary, high binary, classes binary, sizes binary, runs binary")
    dealt = dealt.repartition(width, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(giving_back(meet), "key long, class long, one long, before long")


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(a) + len(b) - len(np.unique(np.concatenate((a, b))))
    return OF * both >= SHARE * (len(a) + len(b) - both)


def _row_key(id_col, h):
    """Columns that equal rows share, also where the id is null."""
    return [F.coalesce(id_col, F.lit(0)).alias("_i"), id_col.isNull().alias("_z"), h.alias("_h")]


def _with_texts(rows: DataFrame, names: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``rows`` (a column ``class`` and others) with the ``text`` of each one's class, that of its first row; repeated rows repeat it."""
    wanted = settle(rows.join(names.select("class", *_row_key(F.col("first.id"), F.col("first.h"))), "class"), "wanted")
    own = F.col(f"`{id_col}`").cast("long")
    base = docs.select(*_row_key(own, F.xxhash64(text_col)), F.col(f"`{text_col}`").alias("text"))
    few = wanted.count() <= TOLD_ROWS
    # texts that nobody wants stay where they are: of fixed size are the marks of the wanted hashes, by which nearly all others are told
    word, bit = (lambda h: F.pmod(F.shiftright(h, 6), F.lit(MARK_WORDS))), (lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")))
    marks = wanted.groupBy(word(F.col("_h")).alias("_w")).agg(F.bit_or(bit(F.col("_h"))).alias("_marks"))
    may = base.join(F.broadcast(marks), word(F.col("_h")) == F.col("_w")).where(F.col("_marks").bitwiseAND(bit(F.col("_h"))) != 0).select(*base.columns)
    return may.join(F.broadcast(wanted) if few else wanted, ["_i", "_z", "_h"]).select(*rows.columns, "text")


def _grouped(batches, width: int):
    """Runs of rows with the same first ``width`` columns, from batches in that order; a run may span batches."""
    held, last = [], None
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for r in rows:
            if held and r[:width] != last:
                yield last, held
                held = []
            last = r[:width]
            held.append(r[width:])
    if held:
        yield last, held


def _verified(pairs: DataFrame, names: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar enough."""
    ends = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class")))
    degree = settle(ends.groupBy("class").agg(F.count(F.lit(1)).alias("k")), "degrees")
    both = pairs.join(degree.select(F.col("class").alias("a"), F.col("k").alias("ka")), "a").join(degree.select(F.col("class").alias("b"), F.col("k").alias("kb")), "b")
    turned = F.col("ka") < F.col("kb")
    hub, other = F.when(turned, F.col("b")).otherwise(F.col("a")), F.when(turned, F.col("a")).otherwise(F.col("b"))
    portion = F.pmod(F.xxhash64(other), F.ceil(F.greatest("ka", "kb") / PORTION))
    dealt = settle(both.select(hub.alias("hub"), portion.cast("int").alias("portion"), other.alias("class")), "dealt")
    hubs = dealt.select("hub", "portion").distinct().select("hub", "portion", F.col("hub").alias("class"))
    meet = _with_texts(hubs.unionByName(dealt), names, docs, id_col, text_col).withColumn("class", F.when(F.col("class") != F.col("hub"), F.col("class")))
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    meet = meet.repartition(width, "hub", "portion").sortWithinPartitions("hub", "portion", F.col("class").asc_nulls_first())

    def check(batches):
        last, own = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            sets = shingle_sets(batch.column(3).to_pylist())
            keep = []
            for hub, other, s in zip(a, b, sets, strict=True):
                if other is None:
                    last, own = hub, s
                keep.append(other is not None and hub == last and _similar(own, s))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, y in zip(v, keep, strict=True) if y], pa.int64()) for v in (a, b)], names=["a", "b"])

    return settle(meet.mapInArrow(giving_back(check), "a long, b long"), "links")


def alike(first: list[np.ndarray], second: list[np.ndarray]) -> np.ndarray:
    """Which sets of two lists are similar enough: sketches are compared, then the intersections of what is left."""
    x, y = (np.array([parity_sketch(s) for s in sets]).view(np.uint64).reshape(len(sets), -1) for sets in (first, second))
    nx, ny = np.array([len(s) for s in first]), np.array([len(s) for s in second])
    total = nx[:, None] + ny[None, :]
    out = np.zeros(total.shape, bool)
    apart = np.zeros(total.shape, np.int64)
    for k in range(x.shape[1]):
        apart += np.bitwise_count(x[:, None, k] ^ y[None, :, k])
    may = 7 * apart <= total
    rows, cols = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
    if not len(rows):
        return out
    parts = [first[k] for k in rows] + [second[k] for k in cols]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    _, column = np.unique(np.concatenate(parts), return_inverse=True)
    left = owner < len(rows)
    in_left, in_right = np.bincount(column[left], minlength=column.max() + 1), np.bincount(column[~left], minlength=column.max() + 1)
    use = np.cumsum((in_left > 0) & (in_right > 0)) - 1  # shingles on one side alone add nothing
    shared = ((in_left > 0) & (in_right > 0))[column]
    owner, column = owner[shared], use[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(rows), len(cols)), np.float64)
    for at in range(0, int(column.max()) + 1 if len(column) else 0, AT_ONCE):
        a, b = np.searchsorted(column, (at, at + AT_ONCE))
        width = min(AT_ONCE, int(column.max()) + 1 - at)
        matrix = np.zeros((len(parts), width), np.float32)
        matrix[owner[a:b], column[a:b] - at] = 1
        common += matrix[: len(rows)] @ matrix[len(rows) :].T
    union = nx[rows][:, None] + ny[cols][None, :] - common
    out[np.ix_(rows, cols)] = OF * common >= SHARE * union
    return out


def _partners(own: DataFrame, names: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(class, partners, rows): the linked classes of a class that one pair of blocks has, and their number of rows; ``own`` has (class, n, m, root)."""
    sizes = own.groupBy("root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("shingles")).where("k > 1")
    blocks = F.greatest(F.ceil(F.col("k") / BLOCK_CLASSES), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    members = settle(own.join(sizes.select("root", blocks.cast("int").alias("blocks")), "root"), "blocks")
    block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    met = members.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "class", "m")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = _with_texts(met, names, docs, id_col, text_col).repartition(width, "root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "class")
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.int64()]

    def check(batches):
        for (_, lo, hi), rows in _grouped(batches, 3):
            rows = list({r[1]: r for r in rows}.values())  # a repeated row's text comes more than once
            sets = shingle_sets([r[3] for r in rows])
            name, many = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
            sides = [np.array([k for k, r in enumerate(rows) if r[0] == side], np.int64) for side in (lo, hi)]
            same = alike(*([sets[k] for k in side] for side in sides)) if len(sides[0]) and len(sides[1]) else np.zeros((0, 0), bool)
            if lo == hi and len(same):
                np.fill_diagonal(same, False)
            out = []
            for these, those, linked_ in [(sides[0], sides[1], same)] + [(sides[1], sides[0], same.T)] * (lo != hi):
                out += [(int(name[these[k]]), name[those[linked_[k]]].tolist(), int(many[those[linked_[k]]].sum())) for k in range(len(linked_)) if linked_[k].any()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["class", "partners", "rows"])

    return settle(met.mapInArrow(giving_back(check), "class long, partners array<long>, rows long"), "partners")


def connected(links: DataFrame) -> DataFrame:
    """(node, root): components of the links (a, b), root the smallest node; by alternating large and small stars."""
    edges = settle(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = settle(both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = settle(small.where(F.col("u") != F.col("v")).distinct(), "edges")
        # done when all are stars: no root has an edge of its own, and no node has two roots
        ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("root")))
        if ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or (up > 0 and root > 0)").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _fits(small, large):
    """Sizes of which the smaller can have the similarity."""
    return F.least(small, large) * OF >= F.greatest(small, large) * SHARE


def _labelled(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return members.withColumn("root", F.col("class"))
    return members.join(roots, F.col("class") == F.col("node"), "left").select("key", "class", F.coalesce("root", "class").alias("root"))


def _screened(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose wide sketches, where both have one, leave room for the similarity."""
    wide = names.where("wide is not null")
    for side in ("a", "b"):
        pairs = pairs.join(wide.select(F.col("class").alias(side), F.col("n").alias(f"n_{side}"), F.col("wide").alias(f"wide_{side}")), side, "left")

    def screen(batches):
        for batch in batches:
            a, b, na, x, nb, y = (batch.column(c) for c in ("a", "b", "n_a", "wide_a", "n_b", "wide_b"))
            near = [p is None or q is None or 7 * wide_distance(p, q) <= m + n for p, q, m, n in zip(x.to_pylist(), y.to_pylist(), na.to_pylist(), nb.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    return pairs.mapInArrow(giving_back(screen), "a long, b long")


def _first_pairs(shared: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that meet first in their buckets, where the sketches leave room."""
    met = shared.select("class", F.explode(F.array("one", "before")).alias("other")).where("other is not null")
    pairs = met.select(F.least("other", "class").alias("a"), F.greatest("other", "class").alias("b")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(names.select(F.col("class").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("n", *SKETCH))), side)
    return pairs.where(_near("a_", "b_")).select("a", "b")


def _candidates(members: DataFrame, names: DataFrame, done: DataFrame | None) -> DataFrame:
    """All pairs (a, b) of classes in different components that share a bucket and weren't verified yet."""
    # only buckets that span components
    spans = members.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where(F.col("x") != F.col("y")).select("key")
    base = settle(members.join(spans, "key", "left_semi").select("key", "class", "root").distinct(), "spanning")
    firsts = base.groupBy("class").agg(F.slice(F.array_sort(F.collect_set("key")), 1, FIRST_KEYS).alias("keys"))  # a class has at most D + 1 keys a band
    held = settle(base.join(names.select("class", "n", *SKETCH), "class").join(firsts, "class"), "held")
    side = lambda p: held.select(*(F.col(c).alias(f"{p}{c}") for c in ("key", "class", "root", "n", *SKETCH, "keys")))
    apart = (F.col("a_class") < F.col("b_class")) & (F.col("a_root") != F.col("b_root")) & _fits(F.col("a_n"), F.col("b_n")) & _near("a_", "b_")
    # a pair that is known to meet under a smaller key comes from there; under its smallest one it always comes
    once = F.coalesce(F.array_min(F.array_intersect("a_keys", "b_keys")) >= F.col("a_key"), F.lit(True))
    pairs = side("a_").join(side("b_"), (F.col("a_key") == F.col("b_key")) & apart & once).select(F.col("a_class").alias("a"), F.col("b_class").alias("b")).distinct()
    return pairs if done is None else pairs.join(done, ["a", "b"], "left_anti")


def _found(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, h, n, class), classes (class, n, m, first, sketch), and (class, n, m, root, least): each class's component and its smallest id."""
    spark = docs.sparkSession
    bound_batches(spark)
    seed = 0
    rows, counts, short, shingles = _classes(docs, id_col, text_col, seed)
    while short:
        seed += 1
        rows, counts, short, shingles = _classes(docs, id_col, text_col, seed)
    frequent = sorted((r["h"] % (1 << 64), r["c"]) for r in counts.orderBy(F.desc("c"), "h").limit(MOST_FREQUENT).collect())
    first = F.min(F.struct(F.col("id").isNull().alias("z"), "id", "h")).alias("first")  # null ids last
    names = settle(rows.where(F.col("n") > 0).groupBy("class").agg(first, F.min("n").alias("n"), F.count(F.lit(1)).alias("m"), *(F.min(k).alias(k) for k in (*SKETCH, "wide"))), "classes")
    shared = settle(_shared(docs, text_col, seed, np.array([f[0] for f in frequent], np.uint64), np.array([f[1] for f in frequent], np.int64), shingles), "shared")
    links, done, roots = None, None, None
    for all_pairs in (False, True):
        pairs = settle(_screened(_candidates(_labelled(shared, roots), names, done) if all_pairs else _first_pairs(shared, names), names), "pairs")
        if pairs.isEmpty():
            continue
        done = pairs if done is None else done.unionByName(pairs)
        found = _verified(pairs, names, docs, id_col, text_col)
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            roots = settle(connected(links), "roots")
    own = names.select("class", "n", "m", "first.id").withColumn("root", F.col("class"))
    if roots is not None:
        own = own.drop("root").join(roots, F.col("class") == F.col("node"), "left").select("class", "n", "m", "id", F.coalesce("root", "class").alias("root"))
    least = own.groupBy("root").agg(F.min("id").alias("least"))
    return rows, names, settle(own.join(least, "root").select("class", "n", "m", "root", "least"), "components")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(class, partners, rows), lists of linked classes (a class may have several, without repeats), and (id, n_shingles, class), the class of every row.

    Rows of one class have equal sets, so they are linked too; rows without a set have no class.
    """
    rows, names, own = _found(docs, id_col, text_col)
    members = rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class")).alias("class"))
    return _partners(own.select("class", "n", "m", "root"), names, docs, id_col, text_col), members


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, n_links) of every row; ``n_links`` is the number of other rows that it is linked with."""
    rows, names, own = _found(docs, id_col, text_col)
    found = _partners(own.select("class", "n", "m", "root"), names, docs, id_col, text_col)
    others = found.groupBy(F.col("class").alias("node")).agg(F.sum("rows").alias("others"))
    own = own.join(others, F.col("class") == F.col("node"), "left")
    own = settle(own.select(F.col("class").alias("_c"), "least", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "members")
    out = rows.select("id", "n", "class").join(own, (F.col("class") == F.col("_c")) & (F.col("n") > 0), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one row of each component, the one with the smallest id, and all rows without a set.

    Rows are told apart by id and text, so rows that share an id alone are judged each for itself; null ids come last.
    """
    rows, _, own = _found(docs, id_col, text_col)
    held = rows.where(F.col("n") > 0).groupBy(*_row_key(F.col("id"), F.col("h"))).agg(F.min("class").alias("class"), F.count(F.lit(1)).alias("many"))
    held = settle(held.join(own.select("class", "root"), "class"), "held")
    keep = held.groupBy("root").agg(F.min(F.struct("_z", "_i", "_h")).alias("kept"))
    judged = held.join(keep, "root").select("_i", "_z", "_h", "many", (F.struct("_z", "_i", "_h") == F.col("kept")).alias("stays"))
    odd = settle(judged.where("not stays or many > 1"), "judged")  # all others stay as they are
    key = ["_i", "_z", "_h"]
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    keyed = docs.select(own, *_row_key(F.col(f"`{id_col}`").cast("long"), F.xxhash64(text_col)))
    once = keyed.join(odd.where("stays").select(*key), key, "left_semi").dropDuplicates(key)
    return keyed.join(odd.select(*key), key, "left_anti").unionByName(once).select("_row.*")
