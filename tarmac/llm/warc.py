"""WARC archives and their capture index by external merge.

Writing: one WARC/1.1 record per page; equal payloads of at least ``REVISIT_BYTES`` are stored once
and revisited by the others.  The records are text (UTF-8 payloads), so Spark's own text writer
commits them, with the record end as line separator, to any file system; an archive holds a bounded
number of records.  Reading: every archive is parsed by its Content-Lengths, payload digests are
verified, and its captures leave as one run sorted by URL key and timestamp.  Merging: runs are cut
at common range bounds over (URL key, timestamp, page id) - a hot URL splits by time - and each range
merges its k run segments with a loser tree; ranges in order give the global order.

Defined results: a NULL html is an empty payload; a NULL url has the empty URL key; a NULL page id
is below every id; rows that share the largest id of a group are all responses; repeated rows are
records of their own; an empty table gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Batches, quoted, scratch_path, sized_broadcast, written

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 32 * 1024 * 1024     # aimed size of an archive before compression
MERGE_ROWS = 100_000                 # captures of one merge range: bounds a task's memory
FIRST_CAPTURE = 1_704_067_200        # 2024-01-01T00:00:00Z; pages carry no time, so one second per id
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(page_id: Column) -> Column:
    """Record id of a page: an urn:uuid from the md5 of the id."""
    h = F.md5(F.concat(F.lit("record|"), F.coalesce(page_id.cast("string"), F.lit(""))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def revisits(pages: DataFrame) -> DataFrame:
    """``page_id, digest, refers_to`` of the pages that revisit another (columns page_id, payload)."""
    keys = written(pages.select("page_id", F.sha1(F.col("payload").cast("binary")).alias("digest"),
                                F.octet_length("payload").alias("bytes")).where(F.col("bytes") >= REVISIT_BYTES), "payloads")
    groups = written(keys.groupBy("digest", "bytes").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
                     .where("n > 1 and refers_to is not null").select(F.col("digest").alias("_digest"), "refers_to"), "copies")
    return written(keys.join(groups, F.col("digest") == F.col("_digest"))
                   .where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
                   .select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to").distinct(), "revisits")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the pages as gzip-compressed WARC files under ``path``.  Payloads do not shuffle while
    the table of revisits is small enough to broadcast (counted); beyond it is joined by shuffle."""
    rows = pages.select(quoted(id_col).cast("bigint").alias("page_id"), quoted(url_col).cast("string").alias("url"),
                        F.coalesce(quoted(html_col).cast("string"), F.lit("")).alias("payload"))
    back = revisits(rows)
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("bytes", F.octet_length("payload"))
    rows = rows.join(sized_broadcast(back, 200_000), F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    again = F.col("refers_to").isNotNull()
    block = F.when(again, http).otherwise(F.concat(http, "payload"))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    when = F.date_format(F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10 ** 9))),
                         "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def header(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")), F.lit(CRLF),
        header("WARC-Record-ID", _urn(F.col("page_id"))), header("WARC-Date", when), header("WARC-Target-URI", uri),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        header("WARC-Refers-To", F.when(again, _urn(F.col("refers_to")))),
        header("WARC-Profile", F.when(again, F.lit(PROFILE))),
        header("X-Page-ID", F.col("page_id").cast("string")), header("X-Refers-To-Page-ID", F.col("refers_to").cast("string")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        header("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF), block)
    size = rows.agg(F.avg("bytes")).first()[0] or 0
    (rows.select(record.alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip")
     .option("maxRecordsPerFile", max(1, int(archive_bytes // (size + 600)))).text(path))


def url_key(url: str) -> str:
    """Sort key of a URL: host labels reversed, without scheme, www and fragment."""
    m = re.match(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)(:\d+)?([^#]*)", url)
    if not m:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", m[1].lower())
    port = "" if (m[2] or "") in ("", ":80", ":443") else m[2]
    return ",".join(reversed(host.split("."))) + port + ")" + (m[3] or "/")


def parse_archive(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of every record of a gzip-compressed archive, read as a stream."""
    source, at, offset, buffer = zlib.decompressobj(31), 0, 0, b""

    def more() -> bool:
        nonlocal source, at, buffer
        while at < len(content):
            data = source.decompress(source.unconsumed_tail or content[at:at + (1 << 18)], 1 << 20)
            if not source.unconsumed_tail:
                at += 1 << 18
            if source.eof and source.unused_data:       # the next gzip member
                content_left = source.unused_data
                source = zlib.decompressobj(31)
                data += source.decompress(content_left)
            if data:
                buffer += data
                return True
        return False
    while True:
        while b"\r\n\r\n" not in buffer:
            if not more():
                if buffer.strip():
                    raise ValueError("archive ends within a record header")
                return
        head, _, rest = buffer.partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at offset {offset}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        need = int(fields["Content-Length"])
        buffer = rest
        while len(buffer) < need + 4:
            if not more():
                raise ValueError("archive ends within a record")
        yield offset, fields, buffer[:need]
        offset += len(head) + 4 + need + 4
        buffer = buffer[need + 4:]


RUN_SCHEMA = ("run string, urlkey string, timestamp string, page_id long, record_type string, payload_digest string, "
              "payload_bytes long, refers_to long, offset long")
RUN_FIELDS = ("run", "urlkey", "timestamp", "page_id", "record_type", "payload_digest", "payload_bytes", "refers_to", "offset")
_TYPES = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]


def _key(row: tuple) -> tuple:
    return row[1], row[2], row[3] is not None, row[3] or 0, row[0], row[8]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _TYPES)], names=list(RUN_FIELDS))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of every archive under ``path``, each archive's as one sorted run."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for offset, h, block in parse_archive(content.as_py()):
                    _, _, payload = block.partition(b"\r\n\r\n")
                    length = int(re.search(rb"Content-Length: (\d+)", block)[1])
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (length, digest):
                        raise ValueError(f"payload of the record at {offset} of {name} does not match its digest")
                    page, refers = h.get("X-Page-ID"), h.get("X-Refers-To-Page-ID")
                    rows.append((name, url_key(h.get("WARC-Target-URI", "")), re.sub(r"\D", "", h["WARC-Date"]),
                                 int(page) if page else None, h["WARC-Type"], digest, length, int(refers) if refers else None, offset))
                rows.sort(key=_key)
                yield _batch(rows)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(run, RUN_SCHEMA)


class LoserTree:
    """k-way merge of sorted lists: inner nodes keep the loser of their match, so the next smallest
    row costs one match per level on the winner's path."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at, self.k = runs, [0] * len(runs), max(1, len(runs))
        self.heads = [_key(r[0]) if r else None for r in runs] or [None]
        self.losers = [-1] * self.k
        self.winner = self._play(1) if self.k > 1 else 0

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        a, b = (a, b) if self._less(a, b) else (b, a)
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator[tuple]:
        while self.heads[self.winner] is not None:
            w = self.winner
            run = self.runs[w]
            yield run[self.at[w]]
            self.at[w] += 1
            self.heads[w] = _key(run[self.at[w]]) if self.at[w] < len(run) else None
            node = (w + self.k) // 2
            while node >= 1 and self.k > 1:
                if self._less(self.losers[node], w):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


def merge_runs(runs: DataFrame, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """The globally ordered index: ``runs`` plus ``part`` and ``pos``; (part, pos) is the order of
    (urlkey, timestamp, page_id).  ``runs`` must be a written table."""
    def run(batches: Batches) -> Batches:
        segments: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                segments.setdefault(row[0], []).append(row)
        for rows in segments.values():      # a segment arrives in its run's order; checked, not assumed
            keys = [_key(r) for r in rows]
            if any(a > b for a, b in zip(keys, keys[1:])):
                rows.sort(key=_key)
        part, pos, out = TaskContext.get().partitionId(), 0, []
        for row in LoserTree([segments[name] for name in sorted(segments)]):
            out.append(row)
            if len(out) == 10_000:
                yield _placed(out, part, pos)
                pos, out = pos + len(out), []
        if out:
            yield _placed(out, part, pos)

    def _placed(rows: list[tuple], part: int, pos: int) -> pa.RecordBatch:
        b = _batch(rows)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(rows), pa.int32()),
                                           pa.array(range(pos, pos + len(rows)), pa.int64())], names=[*RUN_FIELDS, "part", "pos"])
    ranges = max(1, -(-runs.count() // merge_rows))
    return (runs.repartitionByRange(ranges, "urlkey", "timestamp", "page_id", "run", "offset")
            .mapInArrow(run, RUN_SCHEMA + ", part int, pos long"))


def capture_index(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """Write the archives (to a new shared folder by default), read them back and merge their runs."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, html_col)
    return merge_runs(written(read_runs(spark, path), "runs"))


def with_rank(index: DataFrame) -> DataFrame:
    """``index`` plus ``capture_rank``, the place of a capture in the global order (from 1): its place
    in its range after the captures of the ranges before, which are counted (one row a range)."""
    index = written(index, "index")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = (index.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
              .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    return (index.join(F.broadcast(starts), "part")
            .withColumn("capture_rank", F.col("start") + F.col("pos") + 1).drop("start"))
