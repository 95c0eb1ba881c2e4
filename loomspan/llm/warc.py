"""WARC archives: writing captures as records, reading them back, and joining the
request, response and metadata records of each transaction.

Archives are written and read by Spark's own file readers and writers, so they can
lie in any store that Spark reaches. A record ends with two line breaks, which is
the text writer's line separator; inside an archive, records are told apart by
their Content-Length alone.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm._base import dropped, new_path, stored, table, text_or_empty

BREAK = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(kind: str, key) -> F.Column:
    x = F.md5(F.concat(F.lit(f"{kind}:"), key.cast("string")).cast("binary"))
    cut = [F.substring(x, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(headers: list[tuple[str, F.Column | str]], block) -> F.Column:
    """A record without its closing line breaks; headers that are null are left out."""
    lines = [F.concat(F.lit(f"{k}: "), F.lit(v) if isinstance(v, str) else v.cast("string")) for k, v in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws(BREAK, F.lit("WARC/1.1"), *lines, length), F.lit(BREAK * 2), block)


def write_captures(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
    least_bytes: int = 100, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 6000, run: str | None = None,
) -> None:
    """Write a request, a response or revisit, and a metadata record for each row of ``pages`` to
    gzip-compressed archives in folders under ``path``.

    Of pages with equal payloads of ``least_bytes`` or more, one with the smallest id (null
    after all others) is stored as response and the others as revisits that refer to it. A record's
    id comes from the row and ``run`` (a random name if none is given), so that rows that share an id,
    or have none, stay apart. Null payloads are empty, null URLs give no Target-URI; control characters
    in URLs become %-codes; other columns are ignored; an empty table gives no archive with records.

    An archive holds ``records_per_file`` records of payloads of 64 KB at most, an eighth as
    many where payloads have up to eight times that, and so on: its bytes are bounded.
    """
    spark = pages.sparkSession
    raw = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_or_empty(body_col).alias("body"))
    # written, so that a row has one number however often it is read
    rows = stored(raw.withColumn("size", F.octet_length("body")).withColumn("digest", F.sha2(F.col("body").cast("binary"), 256)).withColumn("row", F.monotonically_increasing_id()), "captures")
    least = F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"]
    first = rows.where(F.col("size") >= least_bytes).groupBy("digest").agg(least.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    copies = stored(first, "copies")
    most = rows.agg(F.max("size")).first()[0] or 0
    low, bound = -1, 1 << 16
    run = run or uuid.uuid4().hex
    while low < most or low < 0:
        # a written table has a known size: without many copies Spark moves it to the pages, not the pages to it
        part = rows.where((F.col("size") > low) & (F.col("size") <= bound)).join(copies, "digest", "left").withColumn("again", F.coalesce(F.col("first") != F.col("row"), F.lit(False)))
        records = _records(part, run, date)
        records.write.option("lineSep", BREAK * 2).option("compression", "gzip").option("maxRecordsPerFile", max(1, records_per_file)).text(f"{path}/upto-{bound}")
        low, bound, records_per_file = bound, bound * 8, records_per_file // 8
    dropped(spark, copies)
    dropped(spark, rows)


def _records(rows: DataFrame, run: str, date: str) -> DataFrame:
    """The three records of each row, as texts."""
    key, clean = F.concat(F.lit(f"{run}:"), F.col("row").cast("string")), F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    mine = _urn("capture", key)
    host, target = F.coalesce(F.try_parse_url(clean, F.lit("HOST")), F.lit("unknown")), F.coalesce(F.regexp_extract(clean, r"^[^:]+://[^/]*(/.*)$", 1), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.col("size").cast("string"), F.lit(BREAK * 2))
    common = [("WARC-Date", date), ("WARC-Target-URI", clean)]
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    response = _record([("WARC-Type", "response"), ("WARC-Record-ID", mine), *common, digest, ("Content-Type", "application/http; msgtype=response")], F.concat(http, F.col("body")))
    revisit = _record(
        [("WARC-Type", "revisit"), ("WARC-Record-ID", mine), *common, digest, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn("capture", F.concat(F.lit(f"{run}:"), F.col("first").cast("string")))), ("Content-Type", "application/http; msgtype=response")],
        http,
    )
    ask = F.concat(F.lit("GET "), F.when(target == "", F.lit("/")).otherwise(target), F.lit(f" HTTP/1.1{BREAK}Host: "), host, F.lit(BREAK * 2))
    request = _record([("WARC-Type", "request"), ("WARC-Record-ID", _urn("request", key)), *common, ("WARC-Concurrent-To", mine), ("Content-Type", "application/http; msgtype=request")], ask)
    note = F.concat_ws(BREAK, F.concat(F.lit("page-id: "), F.col("id").cast("string")), F.lit("via: table"), F.lit(""))
    metadata = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", _urn("metadata", key)), *common, ("WARC-Concurrent-To", mine), ("Content-Type", "application/warc-fields")], note)
    return rows.select(F.explode(F.array(request, F.when(F.col("again"), revisit).otherwise(response), metadata)).alias("value"))


RECORD = (
    "record_id string, type string, concurrent_to array<string>, refers_to string, uri string, date string, digest string, "
    "http_status int, http_length long, payload_bytes long, payload_sha256 string, fields map<string,string>, payload binary"
)


def _unpacked(data: bytes):
    """The bytes of an archive; of a compressed one, all its members."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data.lstrip(b"\0")
    return b"".join(out)


def _lines(block: bytes) -> list[tuple[str, str]]:
    pairs = (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n"))
    return [(k.strip().lower(), v.strip()) for k, sep, v in pairs if sep]


def records_of(data: bytes, keep_payload: bool):
    """The records of an archive, as tuples by RECORD. A damaged end is left out."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        top = data.find(b"\r\n\r\n", at)
        if top < 0:
            return
        headers = _lines(data[data.find(b"\r\n", at) + 2 : top])
        h = dict(headers)
        try:
            size = int(h["content-length"])
        except (KeyError, ValueError):
            at = top
            continue
        begin, end = top + 4, top + 4 + size
        if end > len(data):
            return
        kind, status, length, fields = h.get("warc-type"), None, None, None
        body = begin
        if kind in ("response", "revisit", "request") and h.get("content-type", "").startswith("application/http"):
            cut = data.find(b"\r\n\r\n", begin, end)
            body = end if cut < 0 else cut + 4
            head = data[begin:body]
            if kind != "request":
                word = head.split(b" ", 2)
                status = int(word[1]) if len(word) > 1 and word[1][:3].isdigit() else None
                http = dict(_lines(head.partition(b"\r\n")[2]))
                length = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
        elif h.get("content-type") == "application/warc-fields":
            fields = _lines(data[begin:end])
        payload = memoryview(data)[body:end]
        full = kind == "response"
        yield (
            h.get("warc-record-id"), kind, [v for k, v in headers if k == "warc-concurrent-to"], h.get("warc-refers-to"), h.get("warc-target-uri"),
            h.get("warc-date"), h.get("warc-payload-digest"), status, length, len(payload), hashlib.sha256(payload).hexdigest() if full else None,
            list(dict(fields).items()) if fields is not None else None, bytes(payload) if keep_payload and full else None,
        )
        at = end


def _read(keep_payload: bool, batch_bytes: int = 8_000_000):
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), *[pa.string()] * 4, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = [x.strip().split(" ")[0] for x in RECORD.replace("map<string,string>", "map").split(",")]

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for record in records_of(_unpacked(content.as_py()), keep_payload):
                    rows.append(record)
                    size += 300 + len(record[-1] or b"")
                    if size > batch_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def read_records(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """A row by RECORD for every record of the archives under ``path``. An archive is
    read by one task, so archives should stay well below an executor's memory."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(_read(keep_payload), RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, capture (its response or revisit), request
    (the one with the smallest id if there are several) and metadata (an array by id).

    Records belong to the capture that their WARC-Concurrent-To names, in either
    direction, or to that of a record they name, however far away (a round of joins for each
    step); of the nearest captures to the one with the smallest id. Requests and metadata that lead
    to no capture come in a row of their own without one. Records without an id are left out, records
    that repeat an id count once. A capture's metadata are one nested value, as long as there are such
    records of it. An empty table gives none.
    """
    records = stored(records.where("record_id IS NOT NULL").dropDuplicates(["record_id"]), "records")
    is_capture = F.coalesce(F.col("type").isin("response", "revisit"), F.lit(False))
    captures, others = records.where(is_capture), records.where(~is_capture)
    named = records.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b"))
    links = stored(named.union(named.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    owned = captures.select("record_id", F.col("record_id").alias("capture_id"))
    reach = owned
    while not reach.isEmpty():
        found = links.join(reach.withColumnRenamed("record_id", "b"), "b").groupBy(F.col("a").alias("record_id")).agg(F.min("capture_id").alias("capture_id"))
        # names of records that the archives don't hold lead nowhere, but may join others
        reach = stored(found.join(owned, "record_id", "left_anti"), "owned")
        owned = owned.union(reach)
    others = others.join(owned, "record_id", "left").withColumn("capture_id", F.coalesce("capture_id", "record_id"))
    whole = F.struct(*others.drop("capture_id").columns)
    parts = others.groupBy("capture_id").agg(
        F.min_by(F.when(F.col("type") == "request", whole), F.when(F.col("type") == "request", F.col("record_id"))).alias("request"),
        F.collect_list(F.when(~F.col("type").eqNullSafe("request"), F.struct("record_id", "type", "uri", "date", "fields"))).alias("metadata"),
    )
    by_id = lambda x, y: F.when(x["record_id"] < y["record_id"], -1).when(x["record_id"] > y["record_id"], 1).otherwise(0)
    captures = captures.select(F.col("record_id").alias("capture_id"), F.struct(*captures.columns).alias("capture"))
    return captures.join(parts, "capture_id", "full").select("capture_id", "capture", "request", F.array_sort(F.coalesce("metadata", F.array()), by_id).alias("metadata"))


def op1_warc(spark, sf_dir):
    """A row per row of ``pages``, also where page_ids repeat or are null: each is a capture of its own. Of equal
    payloads of 100 bytes or more exactly one is the response, with the smallest page_id, nulls last."""
    path = new_path(spark, "warc")
    write_captures(table(spark, sf_dir, "pages"), path)
    rows = transactions(read_records(spark, path).drop("payload")).where("capture IS NOT NULL").select(
        "capture_id", "capture.refers_to", "capture.type",
        F.when(F.col("capture.type") == "response", F.col("capture.payload_bytes")).otherwise(F.col("capture.http_length")).alias("payload_bytes"),
        F.coalesce("capture.payload_sha256", F.substring_index("capture.digest", ":", -1)).alias("payload_digest"),
        F.expr("try_cast(metadata[0].fields['page-id'] AS long)").alias("page_id"),
    )
    rows = stored(rows, "transactions")
    first, again = rows.where("type = 'response'"), rows.where("type = 'revisit'")
    origin = first.select(F.col("capture_id").alias("refers_to"), F.col("page_id").alias("origin"))
    out = first.withColumn("origin", F.lit(None).cast("long")).unionByName(again.join(origin, "refers_to", "left"))
    return out.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("origin").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
