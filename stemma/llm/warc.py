"""WARC archives: writing, reading back, and a globally ordered index of captures.

Pages are sorted by URL key within the partition they are in (payloads aren't shuffled for it) and
written by Spark's text writer with the WARC record end as its line end, so archives are plain
WARC/1.1 files on any file system Spark can write. Reading parses each archive by Content-Length and
gives one capture run per file, locally sorted by URL key and time. The runs are dealt out by ranges
of (URL key, time, page), so a URL with very many captures spreads over ranges, and a loser tree
merges the runs of a range. The merged order numbers every capture within its URL's history and
links it to the capture before it; what a range can't know of the ranges before it comes from a
summary of two rows a range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, shared_path

#: Payloads below this many bytes are always stored.
LEAST_REVISIT = 1000
#: Payload bytes aimed at for one archive file.
ARCHIVE_BYTES = 16 << 20
#: Larger payloads go to archives of their own, of which none exceeds MOST_ARCHIVE (binary files end at 2 GB).
LARGE_BYTES = 1 << 20
MOST_ARCHIVE = 1 << 30
#: A table of integers and keys is broadcast up to this many rows, and joined by a shuffle beyond.
BROADCAST_ROWS = 200_000
#: Captures start here, one second apart by page_id, as the pages table holds no times.
EPOCH = 1_700_000_000
_END = b"\r\n\r\n"


def url_key(url):
    """The sort key of a URL: host labels reversed, then the path and query in lower case; scheme, port, www. and fragment go.

    ``http://www.B.a.com:80/X?q=1#f`` gives ``com,a,b)/x?q=1``. White space inside becomes ``%20``. A
    null URL gives an empty key.
    """
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"(?s)#.*$", "")
    bare = F.regexp_replace(bare, r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?", "")
    host = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*", 0), r"^www\d*\.|:\d+$", "")
    rest = F.regexp_extract(bare, r"(?s)^[^/?]*(.*)$", 1)
    labels = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    key = F.when(bare == "", "").otherwise(F.concat(labels, F.lit(")"), F.when(rest == "", "/").otherwise(rest)))
    return F.regexp_replace(key, r"\s", "%20")


def utc_text(seconds):
    """Seconds since 1970 as ``2023-11-14T22:13:20Z``, whatever the session's time zone."""
    return F.concat(F.replace((F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))).cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def _record(kind: str):
    """The record's text up to its payload's end, as a column over url, page_id, ts, digest, payload and refers_to."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    body = F.concat(http, F.col("payload")) if kind == "response" else http
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"\s", "%20")
    return F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\n"),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Target-URI", uri),
        line("WARC-Date", utc_text(F.col("ts"))),
        line("X-URL-Key", F.col("urlkey")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        *([line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")))] if kind == "revisit" else []),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
    )


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes one record per page under ``path``; of equal payloads of LEAST_REVISIT bytes or more the largest page_id is stored.

    A null html is an empty payload. Each partition's file is sorted by URL key, time and page_id. A
    row with a null page_id is a response with an empty page number, captured at EPOCH. Rows that
    repeat a page_id with different payloads are captures of their own. An empty table writes an
    archive without records.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    base = base.withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("urlkey", url_key(F.col("url")))
    base = base.withColumn("ts", F.lit(EPOCH) + F.coalesce("page_id", F.lit(0)))
    # one pass over the payloads; what follows looks at a digest and a size per page
    sized = checkpoint(base.select("page_id", "digest", F.octet_length("payload").alias("size")))
    large = sized.filter(F.col("size") >= LEAST_REVISIT)
    stored = large.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select("digest", "first_id")
    revisits = large.join(stored, "digest").filter("page_id <> first_id").select("page_id", "digest", F.col("first_id").alias("refers_to"))
    revisits = checkpoint(revisits.groupBy("page_id", "digest").agg(F.max("refers_to").alias("refers_to")))
    few = revisits.count() <= BROADCAST_ROWS
    joined = base.join(F.broadcast(revisits) if few else revisits, ["page_id", "digest"], "left")
    text = F.when(F.col("refers_to").isNull(), _record("response")).otherwise(_record("revisit"))
    huge = F.col("size") > LARGE_BYTES
    of = sized.agg(F.avg(F.when(~huge, F.col("size"))).alias("usual"), F.max(F.when(huge, F.col("size"))).alias("most")).first()
    kinds = [(F.octet_length("payload") <= LARGE_BYTES, min(MOST_ARCHIVE // max(1, LARGE_BYTES), int(ARCHIVE_BYTES / ((of.usual or 0) + 500))))]
    if of.most:
        kinds.append((F.octet_length("payload") > LARGE_BYTES, MOST_ARCHIVE // max(1, of.most)))
    for mine, per_file in kinds:
        laid = joined.filter(mine).sortWithinPartitions("urlkey", "ts", "page_id")
        laid.select(text.alias("value")).write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", max(1, per_file)).text(path)


_ENTRY = "urlkey string, ts long, page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, file string, offset long, length long"


def parse_archive(data: bytes) -> Iterator[dict]:
    """The records of one archive: headers in lower case, offset, length, and the HTTP payload."""
    at, view = 0, memoryview(data)
    while at < len(data):
        head = data.index(_END, at)
        lines = data[at:head].decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no record at byte {at}: {lines[0][:40]!r}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        begin = head + 4
        end = begin + int(fields["content-length"])
        if data[end : end + 4] != _END:
            raise ValueError(f"record at byte {at} doesn't end where it says")
        payload = data.index(_END, begin, end) + 4
        yield {**fields, "offset": at, "length": end + 4 - at, "payload": view[payload:end]}
        at = end + 4


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _captures(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in _ENTRY.split(", ")]
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"]):
            rows = []
            for r in parse_archive(bytes(content)):
                revisit = r["warc-type"] == "revisit"
                digest = r["warc-payload-digest"].removeprefix("sha1:")
                if not revisit and hashlib.sha1(r["payload"]).hexdigest() != digest:
                    raise ValueError(f"{path}: payload at byte {r['offset']} doesn't match its digest")
                when = int(pd.Timestamp(r["warc-date"]).timestamp())
                rows.append((r.get("x-url-key", ""), when, _page(r["warc-record-id"]), r["warc-type"], _page(r["warc-refers-to"]) if revisit else None, digest, None if revisit else len(r["payload"]), path.rsplit("/", 1)[-1], r["offset"], r["length"]))
                if len(rows) >= 4096:
                    yield _frame(rows, names)
                    rows = []
            yield _frame(rows, names)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"ts": "Int64", "page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64", "offset": "Int64", "length": "Int64"})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One capture run per archive file, in the file's order; a response's digest is checked against its payload."""
    return spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "content").mapInPandas(_captures, _ENTRY)


class LoserTree:
    """Merges sorted runs: inner nodes hold losers, and each item taken replays one path to the root."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs, self.k = runs, max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b)) if x is not None else False

    def _play(self, i: int) -> None:
        at, winner = (i + self.k) // 2, i
        while at:
            if self.tree[at] == -1:  # the first to come waits for its rival
                self.tree[at] = winner
                return
            if self._less(self.tree[at], winner):
                self.tree[at], winner = winner, self.tree[at]
            at //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while (item := self.heads[self.tree[0]]) is not None:
            winner = self.tree[0]
            yield item
            self.heads[winner] = next(self.runs[winner], None)
            self._play(winner)


_MERGED = f"{_ENTRY}, range long, place long, in_range long, before long, edge boolean"


def _merged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merges the runs of one range.

    in_range and before: place among the URL's captures of this range, and the page before it there;
    edge: the last capture, in this range, of the range's first or last URL.
    """
    parts = list(frames)
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True)
    runs = []
    for _, run in rows.groupby("file", sort=True):
        run = run.sort_values("offset")  # a file's order is its sort order
        ids = run["page_id"].fillna(-(1 << 63)).astype("int64")  # a null id comes first
        runs.append(zip(run["urlkey"].str.encode("utf-8"), run["ts"], ids, run.index))
    out = rows.loc[[item[3] for item in LoserTree(runs)]].reset_index(drop=True)
    out["range"], out["place"] = TaskContext.get().partitionId(), out.index
    out["in_range"] = out.groupby("urlkey").cumcount() + 1
    out["before"] = out.groupby("urlkey")["page_id"].shift(1).astype("Int64")
    out["edge"] = ~out["urlkey"].duplicated(keep="last") & out["urlkey"].isin([out["urlkey"].iloc[0], out["urlkey"].iloc[-1]])
    yield out


def merge_index(captures: DataFrame, rows_per_range: int = 50_000) -> DataFrame:
    """The capture runs merged into one history ordered by URL key, time and page_id, over range and place.

    A range holds about ``rows_per_range`` index rows, never payloads. Ties keep file order. Adds
    range and place, history_no (from 1, over a URL's captures) and previous_page_id (of the capture
    before; null for the first). The merged index is written once to the shared folder, in its order.
    """
    spark = captures.sparkSession
    ranges = max(1, -(-captures.count() // rows_per_range))
    path = shared_path(spark, "index")
    captures.repartitionByRange(ranges, "urlkey", "ts", "page_id").mapInPandas(_merged, _MERGED).write.parquet(path)
    index = spark.read.schema(_MERGED).parquet(path)
    # a URL's captures lie in ranges that follow each other, so only the ends of a range can go on in another
    order = Window.partitionBy("urlkey").orderBy("range")
    carried = index.filter("edge").select("range", "urlkey", F.sum("in_range").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"), F.lag("page_id").over(order).alias("last"))
    carried = checkpoint(carried.filter("earlier IS NOT NULL"))
    carried = F.broadcast(carried) if carried.count() <= BROADCAST_ROWS else carried
    out = index.join(carried, ["range", "urlkey"], "left")
    first = F.col("in_range") == 1
    return out.select(*(x.split()[0] for x in _ENTRY.split(", ")), "range", "place", (F.col("in_range") + F.coalesce("earlier", F.lit(0))).alias("history_no"), F.when(first, F.col("last")).otherwise(F.col("before")).alias("previous_page_id"))


def with_stored_size(captures: DataFrame) -> DataFrame:
    """The captures with the payload size of each revisit, taken from the response that holds its digest."""
    revisits = captures.filter("record_type = 'revisit'")
    asked = checkpoint(revisits.select("payload_digest").distinct())
    few = asked.count() <= BROADCAST_ROWS
    stored = captures.filter("record_type = 'response'").join(F.broadcast(asked) if few else asked, "payload_digest", "left_semi")
    stored = stored.groupBy("payload_digest").agg(F.max("payload_bytes").alias("stored_bytes"))
    full = revisits.join(F.broadcast(stored) if few else stored, "payload_digest", "left").withColumn("payload_bytes", F.col("stored_bytes"))
    return captures.filter("record_type = 'response'").unionByName(full.select(captures.columns))


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes the pages as WARC archives, reads them back and merges their index.

    One row per page: page_id, payload_bytes and payload_digest (hex SHA-1) of the full payload,
    record_type, refers_to (revisits only), then urlkey, ts (seconds), history_no and
    previous_page_id (place among the URL key's captures by time, and the capture before), file,
    offset and length. A revisit's size comes from the response it refers to, as read back. Null ids
    and urls, repeated ids and repeated rows are captures of their own (ties of key, time and id in
    any order); other columns are ignored, and an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path)
    index_path = shared_path(spark, "cdx")
    read_archives(spark, path).write.parquet(index_path)
    captures = spark.read.schema(_ENTRY).parquet(index_path)
    merged = merge_index(with_stored_size(captures))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "ts", "history_no", "previous_page_id", "file", "offset", "length")
