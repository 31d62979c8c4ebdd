"""WARC archives and a globally ordered capture index.

Writing: every row becomes a WARC/1.1 record in its own gzip member. Of records
with equal payloads the one with the largest id is the response and the others
are revisit records that refer to it. Archives are files in the shared folder;
a task names its files by a fresh id and only a committed task's files are in
the manifest, so retries and lost executors leave no doubles.

Index: each archive is read back and its captures, sorted by URL key,
timestamp and id, are written as a run. The runs are merged k ways by a loser
tree: groups of at most FAN_IN runs at a time while there are more, then all
at once in ranges of the key order, one task a range. A merge holds one batch
of each run. The output is globally ordered: capture histories stand together,
by time.

Defined results: null payloads are empty ones and empty payloads are equal
payloads too; a null URL has an empty key; a null id is the smallest; rows
that repeat both the largest id and its payload are all responses; control
characters and blanks in URLs are percent-encoded in the archive. Extra
columns are ignored. An empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.arrow_map import bound_batches
from vitalgrid.llm.common import scratch_path, settle

#: An archive ends after so many bytes or records.
ARCHIVE_BYTES = 64 << 20
ARCHIVE_RECORDS = 50_000
LEVEL = 3
#: Runs that are merged at once, captures in a batch of a run, and split points sampled for the last merge.
FAN_IN = 128
RUN_BATCH = 2048
MAX_FENCES = 20_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURE = pa.schema(
    [("url_key", pa.string()), ("timestamp", pa.string()), ("record_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("at", pa.int64())]
)
CAPTURE_DDL = "url_key string, timestamp string, record_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, at long"


def filesystem(path: str):
    """A pyarrow filesystem and the path inside it; any URI that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Sort key: reversed host labels, then path and query, A-Z lower-cased; no scheme, no fragment."""
    if not url:
        return ""
    rest = url.partition("://")[2] or url
    host, path = re.match(r"([^/?#]*)([^#]*)", rest, re.S).groups()
    return (",".join(reversed(host.split("."))) + ")" + (path or "/")).lower()


def warc_date(seconds: int | None) -> str:
    """Seconds since 1970 as a WARC date; null is 1970. Kept within four-digit years."""
    s = min(max(seconds or 0, -62135596800), 253402300799)
    return (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=s)).strftime("%Y-%m-%dT%H:%M:%SZ").rjust(20, "0")


def record(rid: int | None, url: str | None, seconds: int | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; with ``refers_to`` a revisit without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if rid is None else rid}>", f"WARC-Date: {warc_date(seconds)}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(source, chunk: int = 1 << 20):
    """(offset, bytes) of each gzip member of a file."""
    at = start = 0
    buf, inflate, out = b"", None, []
    while True:
        data = buf or source.read(chunk)
        if not data:
            break
        if inflate is None:
            inflate, out, start = zlib.decompressobj(31), [], at
        out.append(inflate.decompress(data))
        buf = inflate.unused_data
        at += len(data) - len(buf)
        if inflate.eof:
            yield start, b"".join(out)
            inflate = None
    if inflate is not None:
        raise ValueError("the archive ends inside a record")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:size]


def _id(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def capture(data: bytes, archive: str, at: int) -> tuple:
    """The index entry of a record; a response's payload is held against its digest."""
    fields, block = parse(data)
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"{archive} at {at}: the payload differs from its digest")
    refers = _id(fields.get("WARC-Refers-To")) if kind == "revisit" else None
    return url_key(fields.get("WARC-Target-URI")), fields["WARC-Date"], _id(fields["WARC-Record-ID"]), size, digest, kind, refers, archive, at


def order_of(c) -> tuple:
    """Sort key of a capture; nulls first."""
    return c[0], c[1], c[2] is not None, c[2] or 0, c[7], c[8]


def find_originals(pages: DataFrame, id_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """(_sha, _of): the largest id of each payload that more than one row has."""
    sha = F.sha1(F.coalesce(F.col(payload_col), F.lit("")))
    size = F.coalesce(F.octet_length(payload_col), F.lit(0))
    groups = pages.where(size >= least_bytes).groupBy(sha.alias("_sha")).agg(F.max(id_col).alias("_of"), F.count(F.lit(1)).alias("_n"))
    return groups.where(F.col("_n") > 1).drop("_n")


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", seconds_col: str = "seconds", least_bytes: int = 0) -> DataFrame:
    """Write all rows; returns the manifest (archive, records, bytes)."""
    spark = pages.sparkSession
    bound_batches(spark)
    folder = scratch_path(spark, "warc")
    originals = settle(find_originals(pages, id_col, payload_col, least_bytes), "originals")  # a small table is then broadcast by its measured size
    sha = F.sha1(F.coalesce(F.col(payload_col), F.lit("")))
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), F.col(payload_col).alias("_payload"), F.col(seconds_col).cast("long").alias("_s"), sha.alias("_sha"))
    small = F.coalesce(F.octet_length("_payload"), F.lit(0)) < least_bytes
    refers = F.when(small | F.col("_of").isNull() | F.col("_of").eqNullSafe(F.col("_id")), None).otherwise(F.col("_of").cast("long"))
    rows = rows.join(originals, "_sha", "left").select("_id", "_url", "_payload", "_s", refers.alias("_refers"))

    def run(batches):
        store, inside = filesystem(folder)
        store.create_dir(inside, recursive=True)
        part = TaskContext.get().partitionId()
        done, sink, path, records = [], None, "", 0
        for batch in batches:
            for rid, url, payload, seconds, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    path, records = f"part-{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.warc.gz", 0
                    sink = store.open_output_stream(f"{inside}/{path}", compression=None)
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = record(rid, url, seconds, (payload or "").encode("utf-8", "replace"), refers_to)
                sink.write(packer.compress(data) + packer.flush())
                records += 1
                if sink.tell() >= ARCHIVE_BYTES or records >= ARCHIVE_RECORDS:
                    done.append((f"{folder}/{path}", records, sink.tell()))
                    sink.close()
                    sink = None
        if sink is not None:
            done.append((f"{folder}/{path}", records, sink.tell()))
            sink.close()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True) if done else [[]] * 3, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["archive", "records", "bytes"])

    return settle(rows.mapInArrow(run, "archive string, records long, bytes long"), "manifest")


class Run:
    """A sorted run of captures in an Arrow file, read a batch at a time from a given key on."""

    def __init__(self, path: str):
        store, inside = filesystem(path)
        self.file = store.open_input_file(inside)
        self.reader = pa.ipc.open_file(self.file)

    def _rows(self, k: int) -> list[tuple]:
        return list(zip(*(c.to_pylist() for c in self.reader.get_batch(k).columns), strict=True))

    def entries(self, low: tuple | None = None, high: tuple | None = None):
        """Captures from ``low`` on and before ``high``."""
        first, last = 0, self.reader.num_record_batches
        while low is not None and last - first > 1:
            mid = (first + last) // 2
            if order_of(self._rows(mid)[0]) < low:
                first = mid
            else:
                last = mid
        for k in range(first, self.reader.num_record_batches):
            for c in self._rows(k):
                key = order_of(c)
                if high is not None and key >= high:
                    return
                if low is None or key >= low:
                    yield c

    def close(self):
        self.file.close()


def write_run(path: str, captures) -> tuple[int, list[tuple]]:
    """Write sorted captures; returns their number and the first key of each batch."""
    store, inside = filesystem(path)
    fences, n, batch = [], 0, []
    with store.open_output_stream(inside, compression=None) as sink, pa.ipc.new_file(sink, CAPTURE) as writer:
        for c in captures:
            if not batch:
                fences.append(order_of(c))
            batch.append(c)
            if len(batch) == RUN_BATCH:
                writer.write_batch(_batch(batch))
                n, batch = n + len(batch), []
        if batch:
            writer.write_batch(_batch(batch))
            n += len(batch)
    return n, fences


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(CAPTURE), CAPTURE, strict=True)], schema=CAPTURE)


def loser_tree(sources: list):
    """Merge sorted iterators: inner nodes keep the loser of their match, the winner moves up."""
    k = len(sources)
    if k == 0:
        return
    heads = [next(s, None) for s in sources]
    keys = [None if h is None else order_of(h) for h in heads]

    def beats(a: int, b: int) -> bool:
        if keys[a] is None or keys[b] is None:
            return keys[b] is None and (keys[a] is not None or a < b)
        return (keys[a], a) < (keys[b], b)

    losers = [-1] * k
    winners = [-1] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    top = winners[1] if k > 1 else 0
    while keys[top] is not None:
        yield heads[top]
        heads[top] = next(sources[top], None)
        keys[top] = None if heads[top] is None else order_of(heads[top])
        node = (top + k) // 2
        while node:
            if beats(losers[node], top):
                losers[node], top = top, losers[node]
            node //= 2


_RUN_DDL = "run string, n long, fences array<struct<url_key:string,timestamp:string,present:boolean,id:long,archive:string,at:long>>"
_FENCE = pa.struct([("url_key", pa.string()), ("timestamp", pa.string()), ("present", pa.bool_()), ("id", pa.int64()), ("archive", pa.string()), ("at", pa.int64())])


def _described(path: str, n: int, fences: list[tuple]) -> pa.RecordBatch:
    rows = [dict(zip((f.name for f in _FENCE), x, strict=True)) for x in fences]
    return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([rows], pa.list_(_FENCE))], names=["run", "n", "fences"])


def _spread(df: DataFrame, n: int) -> DataFrame:
    """One row a task; ``df`` has as many rows as there are files."""
    return df.repartition(max(1, n))


def index_archives(manifest: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """All captures of the archives in global order of URL key, timestamp and id."""
    spark = manifest.sparkSession
    folder = scratch_path(spark, "runs")

    def sort_archives(batches):
        store, inside = filesystem(folder)
        store.create_dir(inside, recursive=True)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                source, place = filesystem(archive)
                with source.open_input_stream(place, compression=None) as f:
                    captures = sorted((capture(data, archive, at) for at, data in members(f)), key=order_of)
                path = f"{folder}/{uuid.uuid4().hex}.arrow"
                yield _described(path, *write_run(path, captures))

    def merge_group(batches):
        for batch in batches:
            for paths in batch.column(0).to_pylist():
                runs = [Run(p) for p in paths]
                path = f"{folder}/{uuid.uuid4().hex}.arrow"
                yield _described(path, *write_run(path, loser_tree([r.entries() for r in runs])))
                for r in runs:
                    r.close()

    n = manifest.count()
    runs = settle(_spread(manifest.select("archive"), n).mapInArrow(sort_archives, _RUN_DDL), "runs")
    while n > fan_in:
        # names are random, so their hash deals the runs into groups of about half the fan-in
        groups = -(-2 * n // fan_in)
        grouped = runs.groupBy(F.pmod(F.xxhash64("run"), F.lit(groups)).alias("g")).agg(F.collect_list("run").alias("paths")).select("paths")
        runs = settle(_spread(grouped, groups).mapInArrow(merge_group, _RUN_DDL), "runs")
        n = runs.count()
    paths = [r["run"] for r in runs.select("run").collect()]  # at most fan_in
    fences = runs.select(F.explode("fences").alias("f")).select("f.*")
    stride = max(1, -(-fences.count() // MAX_FENCES))
    keys = sorted(tuple(r) for r in fences.where(F.pmod(F.xxhash64("url_key", "timestamp", "id", "at"), F.lit(stride)) == 0).collect())
    pieces = max(1, min(len(keys), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = [keys[len(keys) * k // pieces] for k in range(1, pieces)] if keys else []
    bounds = list(zip([None, *cuts], [*cuts, None], strict=True))

    def merge_range(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                low, high = bounds[k]
                opened = [Run(p) for p in paths]
                rows = []
                for c in loser_tree([r.entries(low, high) for r in opened]):
                    rows.append(c)
                    if len(rows) == RUN_BATCH:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)
                for r in opened:
                    r.close()

    return spark.range(0, len(bounds), 1, len(bounds)).mapInArrow(merge_range, CAPTURE_DDL)


def read_capture(archive: str, at: int) -> tuple[dict[str, str], bytes]:
    """Header fields and block of the record at an offset of an archive."""
    store, inside = filesystem(archive)
    with store.open_input_file(inside) as f:
        f.seek(at)
        return parse(next(members(f))[1])
