"""WARC archives and their globally ordered capture index (operator 9).

Every page becomes a WARC/1.1 record. Of records with equal payloads of ``revisit_bytes`` at least, the
one with the largest page id is a response, the others are revisits that refer to it. Records are
written by Spark's text sink - the record separator CR LF CR LF is the line separator - into
gzip-compressed part files in the shared folder, so any store Spark can write to will do. The archives
are then read back whole file by whole file (``file_bytes`` bounds a file's text), cut by
Content-Length, and each file gives a run of index entries sorted by URL key and timestamp. The runs are
dealt into ranges of the key, and inside each range a loser tree merges them; the ranges' sizes then give every
capture its rank in the global order of capture histories (URL key, timestamp, page).

A response's block is an HTTP message, whose body is the payload; a revisit has the message's head only.

Defined results: a null html is an empty payload, a null URL an empty target; carriage returns and line
feeds in a URL are percent-encoded in the header; ties for the largest page id are all responses; a null
page id counts as the smallest; records of under ``revisit_bytes`` are responses; without a timestamp
column all captures carry ``DEFAULT_TIME``; ties of key, time and page are ranked by file and offset; repeated rows are
records of their own; a payload of any length is one record of one file; an empty table gives an empty index; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farelens.llm.joins import join_unique
from farelens.sources.staging import materialize, new_path
from farelens.llm.tables import table

REVISIT_BYTES = 1000
#: Text bytes of an archive file, about; a record is never split.
FILE_BYTES = 16 << 20
#: Index entries that one merge task holds, about.
RANGE_ROWS = 100_000
DEFAULT_TIME = "2024-01-01T00:00:00Z"
_END = "\r\n\r\n"

_INDEX = "page_id long, url string, url_key string, timestamp string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, record_offset long"


def _surt(url: str) -> str:
    """A key that sorts a site's pages together: host labels reversed, then the rest."""
    m = re.match(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)(.*)$", url)
    if not m:
        return url
    host, _, port = m[1].lower().partition(":")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + m[2].partition("#")[0]


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None, revisit_bytes: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> str:
    """Writes one record per page and returns the folder of archives."""
    spark = pages.sparkSession
    page = F.col(id_col).cast("long")
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    time = F.lit(DEFAULT_TIME) if time_col is None else F.coalesce(F.date_format(time_col, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(DEFAULT_TIME))
    url = F.replace(F.replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(page.alias("page_id"), url.alias("url"), time.alias("time"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("_place"))
    small = pages.select(page.alias("page_id"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("bytes"))
    # partial sums per task first, then a payload of a third of all pages is joined where its rows are
    shared = materialize(small.groupBy("digest", "bytes").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1"), "warc-payloads")
    total = small.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.col("bytes") + 700), F.lit(0)).alias("bytes")).first()
    again = shared.where(F.col("bytes") >= revisit_bytes).select("digest", "first_id")
    marked = join_unique(rows, again, ["digest"], shared.select("digest", "n"), total["rows"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    refers = F.when(revisit, F.col("first_id"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(_END))
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("html")))
    record = F.concat(
        F.lit("WARC/1.1\r\n"), _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", _uuid(F.col("page_id"), F.col("digest"))), _header("WARC-Date", F.col("time")), _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _header("WARC-Refers-To", F.when(revisit, _uuid(refers, F.col("digest")))), _header("X-Refers-To-Page", refers.cast("string")),
        _header("X-Page-ID", F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), _header("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block,
    )
    files = max(1, -(-total["bytes"] // file_bytes))
    path = new_path(spark, "warc")
    dealt = marked.select(record.alias("value"), F.xxhash64("_place", "page_id").alias("_deal")).repartition(files, "_deal").select("value")
    dealt.write.option("lineSep", _END).option("compression", "gzip").text(path)
    return path


def parse_archive(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset in the unpacked text, headers, block) of every record of a gzip-compressed archive."""
    text = zlib.decompress(data, wbits=47)
    at = 0
    while at < len(text):
        head = text.index(b"\r\n\r\n", at)
        lines = text[at:head].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        end = head + 4 + int(headers["Content-Length"])
        yield at, headers, text[head + 4 : end]
        if text[end : end + 4] != _END.encode():
            raise ValueError(f"the record at {at} does not end where its length says")
        at = end + 4


def _long(value: str | None) -> int | None:
    return None if value is None else int(value)


def _entry(file: str, offset: int, headers: dict[str, str], block: bytes) -> dict:
    url, kind = headers.get("WARC-Target-URI", ""), headers["WARC-Type"]
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    message, _, payload = block.partition(_END.encode())
    if kind == "response":
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)  # noqa: S324 - the format's digest
    else:
        size = int(message.rpartition(b"Content-Length: ")[2])
    return {
        "page_id": _long(headers.get("X-Page-ID")), "url": url, "url_key": _surt(url), "timestamp": headers["WARC-Date"], "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": _long(headers.get("X-Refers-To-Page")), "file": file, "record_offset": offset,
    }


def _order(entry: dict) -> tuple:
    return entry["url_key"], entry["timestamp"], entry["page_id"] is not None, entry["page_id"] or 0, entry["file"], entry["record_offset"]


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """Reads archives back; each file's entries come sorted by URL key and timestamp, numbered in its run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                name = file.as_py().rsplit("/", 1)[-1]
                entries = sorted((_entry(name, *x) for x in parse_archive(content.as_py())), key=_order)
                for at in range(0, len(entries), 5000):
                    yield pa.RecordBatch.from_pylist([{**e, "rank_in_run": at + i} for i, e in enumerate(entries[at : at + 5000])], schema=_arrow_schema())

    # one archive per Arrow batch: files are large, rows are few
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, f"{_INDEX}, rank_in_run long")


def _arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in f"{_INDEX}, rank_in_run long".split(", "))])


class LoserTree:
    """Merges k sorted lists; each step replays one path of the tree."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.at = [0] * self.k
        self.head = [self._next(i) for i in range(self.k)]
        self.tree = [-1] * max(1, self.k)  # tree[0] is the winner, the others are losers
        for i in range(self.k):
            self._play(i)

    def _next(self, i: int):
        return (0, self.key(self.runs[i][self.at[i]])) if self.at[i] < len(self.runs[i]) else (1, ())

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = i  # first round: wait for the rival
                return
            if self.head[other] < self.head[i]:
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        while self.k and self.head[self.tree[0]][0] == 0:
            i = self.tree[0]
            yield self.runs[i][self.at[i]]
            self.at[i] += 1
            self.head[i] = self._next(i)
            self._play(i)


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All entries with ``capture_rank``, their place in the global order (from 0)."""
    n = runs.count()
    ranges = max(1, -(-n // range_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        by_run: dict[str, list[dict]] = {}
        for batch in batches:
            for entry in batch.to_pylist():
                by_run.setdefault(entry["file"], []).append(entry)
        out, rank = [], 0
        for entry in LoserTree([by_run[f] for f in sorted(by_run)], _order):
            out.append({**{k: v for k, v in entry.items() if k != "rank_in_run"}, "key_range": number, "rank_in_range": rank})
            rank += 1
            if len(out) == 5000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([*list(_arrow_schema())[:-1], ("key_range", pa.int64()), ("rank_in_range", pa.int64())])
    # the range is of key, time, page and place, so a URL with a third of all captures is split as well
    dealt = runs.repartitionByRange(ranges, "url_key", "timestamp", F.col("page_id").asc_nulls_first(), "file", "record_offset")
    merged = materialize(dealt.sortWithinPartitions("file", "rank_in_run").mapInArrow(run, f"{_INDEX}, key_range long, rank_in_range long"), "warc-index")
    sizes = merged.groupBy("key_range").agg(F.count("*").alias("n"))  # as many rows as ranges
    before = sizes.select("key_range", F.coalesce(F.sum("n").over(Window.orderBy("key_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = merged.join(F.broadcast(before), "key_range").withColumn("capture_rank", F.col("before") + F.col("rank_in_range"))
    return ranked.drop("rank_in_range", "before")


def archive_pages(pages: DataFrame, time_col: str | None = None, file_bytes: int = FILE_BYTES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Writes ``pages`` as WARC archives, reads them back and returns the ordered capture index."""
    path = write_archives(pages, time_col=time_col, file_bytes=file_bytes)
    return merge_runs(materialize(capture_runs(pages.sparkSession, path), "warc-runs"), range_rows)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive_pages(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_rank")


ORACLE_SQL = rf"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') AS url FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, url,
             regexp_extract(url, '(?s)^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)(.*)$', ['site', 'rest']) AS u,
             regexp_matches(url, '(?s)^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)(.*)$') AS absolute FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT *, row_number() OVER (ORDER BY url_key, page_id NULLS FIRST) - 1 AS capture_rank FROM (SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id IS DISTINCT FROM top THEN top END AS refers_to,
       CASE WHEN absolute THEN array_to_string(list_reverse(string_split(split_part(lower(u.site), ':', 1), '.')), ',')
            || CASE WHEN instr(u.site, ':') > 0 THEN ':' || substr(u.site, instr(u.site, ':') + 1) ELSE '' END || ')' || split_part(u.rest, '#', 1) ELSE url END AS url_key
FROM m)
"""
