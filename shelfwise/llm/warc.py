"""WARC archives: one request, response and metadata record per page, and transactions assembled again.

Writing is plain text output: a WARC record ends in two line breaks, so records written as rows with that
separator make a WARC file, in any store, with Spark's own commit of finished tasks. A page whose payload
another page has, too, is written as a revisit of the response with the smallest page id.

Reading takes archives as binary files, plain or gzipped, whole or record by record, and cuts them by
``Content-Length``. The records of a transaction name each other by ``WARC-Concurrent-To``; every record is
brought to its capture (a response, revisit or resource) through these identifiers, also by way of a
request, and one nested row per capture comes out.

Rows: a missing html is an empty payload; of several pages with the smallest id of their payload all are
responses; a page without id sorts after all ids; repeated rows keep a record each; extra columns are
dropped; an empty table makes an archive without records. Rows alike in id, address and payload have the
same record ids; they come back as one transaction with their number in ``copies``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import new_table, stored

BREAK = "\r\n"
END = BREAK * 2  # after each record
VERSION = "WARC/1.1"
LEAST_REVISIT = 100  # payload bytes
PAGES_A_FILE = 2000
CAPTURES = ("response", "revisit", "resource")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WHEN = datetime(2024, 1, 1)  # capture time of tables without one

RECORD = """path string, offset long, type string, record_id string, concurrent_to array<string>, uri string,
refers_to string, headers map<string,string>, http map<string,string>, payload binary, payload_bytes long, payload_digest string"""


# writing


def with_types(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Adds payload_bytes, payload_digest, record_type, refers_to and refers_to_url."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    named = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("html"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"),
    )
    firsts = (
        named.where(F.col("payload_bytes") >= least)
        .groupBy("payload_digest")
        .agg(F.min(F.struct(F.col("page_id").isNull().alias("missing"), "page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select("payload_digest", F.lit(True).alias("shared"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    )
    joined = named.join(firsts, "payload_digest", "left")
    revisit = F.coalesce(F.col("shared"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"), F.when(revisit, F.col("first_url")).alias("refers_to_url"),
    )


def _id(part: str, page: Column, url: Column) -> Column:
    """A record id in the form of a UUID, made of the part's name, page id, address and payload."""
    key = [F.coalesce(c.cast("string"), F.lit("null")) for c in (page, F.col("payload_digest"), url)]
    digest = F.md5(F.concat_ws(":", F.lit(part), *key))
    cuts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _record(kind: Column | str, page: Column, part: str, fields: dict[str, Column | str], block: Column) -> Column:
    """The text of a record without the two line breaks at its end; fields that are null are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), _id(part, page, F.col("url")))]
    lines += [F.concat(F.lit(f"{name}: "), F.lit(v) if isinstance(v, str) else v) for name, v in fields.items()]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(BREAK, *lines), F.lit(END), block)


def records(typed: DataFrame) -> DataFrame:
    """``value``: the request, the capture and the metadata record of each page, in that order."""
    page, when = F.col("page_id"), WHEN.strftime("%Y-%m-%dT%H:%M:%SZ")
    one_line = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")
    uri = F.when(one_line != "", one_line)
    host, path = F.regexp_extract(one_line, r"^\w+://([^/?#]+)", 1), F.regexp_extract(one_line, r"^\w+://[^/?#]+([^#]*)", 1)
    capture = _id("capture", page, F.col("url"))
    revisit = F.col("record_type") == "revisit"
    common = {"WARC-Date": when, "WARC-Target-URI": uri}
    reply_head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(END),
    )
    asked = _record(
        "request", page, "request",
        {**common, "WARC-Concurrent-To": capture, "Content-Type": "application/http; msgtype=request"},
        F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(f" HTTP/1.1{BREAK}Host: "), host, F.lit(END)),
    )
    captured = _record(
        F.col("record_type"), page, "capture",
        {
            **common,
            "WARC-Payload-Digest": F.concat(F.lit("sha256:"), F.col("payload_digest")),
            "WARC-Refers-To": F.when(revisit, _id("capture", F.col("refers_to"), F.col("refers_to_url"))),
            "WARC-Profile": F.when(revisit, PROFILE),
            "Content-Type": "application/http; msgtype=response",
        },
        F.concat(reply_head, F.when(revisit, "").otherwise(F.col("html"))),
    )
    described = _record(
        "metadata", page, "metadata", {**common, "WARC-Concurrent-To": capture, "Content-Type": "application/warc-fields"},
        F.concat(F.coalesce(F.concat(F.lit("page-id: "), page.cast("string"), F.lit(BREAK)), F.lit("")), F.lit(f"via: {BREAK}")),
    )
    return typed.select(F.explode(F.array(asked, captured, described)).alias("value"))


def write_archives(pages: DataFrame, path: str, compression: str = "gzip", pages_a_file: int = PAGES_A_FILE) -> None:
    """Writes the pages as WARC files into the folder ``path``."""
    out = records(with_types(pages))
    writer = out.write.option("lineSep", END).option("compression", compression)
    writer.option("maxRecordsPerFile", 3 * pages_a_file).text(path)


# reading


def _plain(data: bytes) -> bytes:
    """The bytes of an archive, with all its gzip members unpacked."""
    if not data.startswith(b"\x1f\x8b"):
        return data
    out, rest = [], data
    while rest.startswith(b"\x1f\x8b"):
        unpack = zlib.decompressobj(31)
        out.append(unpack.decompress(rest) + unpack.flush())
        rest = unpack.unused_data.lstrip(b"\0")
    return b"".join(out)


def _fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split(BREAK)[1:]:
        name, colon, value = line.partition(":")
        if colon:
            name, value = name.strip().lower(), value.strip()
            out[name] = f"{out[name]} {value}" if name in out else value
    return out


def parse_archive(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, fields (names in lower case, repeated ones joined by a space) and block of each record."""
    data, at = _plain(data), 0
    while (at := data.find(b"WARC/", at)) >= 0:
        gap = data.find(b"\r\n\r\n", at)
        if gap < 0:
            raise ValueError(f"a record without end of its head at {at}")
        fields = _fields(data[at:gap])
        start = gap + 4
        stop = start + int(fields["content-length"])
        if stop > len(data):
            raise ValueError(f"a record cut off at {at}")
        yield at, fields, data[start:stop]
        at = stop


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives in ``path``; ``payloads=False`` leaves the bytes out, not their digest."""
    schema = pa.schema([
        ("path", pa.string()), ("offset", pa.int64()), ("type", pa.string()), ("record_id", pa.string()),
        ("concurrent_to", pa.list_(pa.string())), ("uri", pa.string()), ("refers_to", pa.string()),
        ("headers", pa.map_(pa.string(), pa.string())), ("http", pa.map_(pa.string(), pa.string())),
        ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ])

    def row(file: str, offset: int, fields: dict[str, str], block: bytes) -> dict:
        http: dict[str, str] = {}
        if fields.get("content-type", "").startswith("application/http"):
            head, _, block = block.partition(b"\r\n\r\n")
            http = _fields(head)
        elif fields.get("content-type") == "application/warc-fields":
            http = _fields(b"\r\n" + block)
        return {
            "path": file, "offset": offset, "type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"),
            "concurrent_to": fields.get("warc-concurrent-to", "").split(), "uri": fields.get("warc-target-uri"),
            "refers_to": fields.get("warc-refers-to"), "headers": list(fields.items()), "http": list(http.items()),
            "payload": block if payloads else None, "payload_bytes": len(block),
            "payload_digest": hashlib.sha256(block).hexdigest(),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                rows, size = [], 0
                for record in parse_archive(content.as_py()):
                    rows.append(row(file.as_py(), *record))
                    size += len(record[2]) * payloads + 500
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(run, RECORD)


def transactions(found: DataFrame) -> DataFrame:
    """One row per capture: its id and ``capture``, ``request`` and ``metadata`` as nested records.

    A capture's key is its own id. Any other record is brought to the capture it names, to the capture
    that names it, or, through one record more, to the capture of the record it names.
    """
    is_capture = F.col("type").isin(*CAPTURES)
    names = found.select("record_id", "type", F.explode("concurrent_to").alias("other"))
    captures = found.where(is_capture).select(F.col("record_id").alias("capture_id"))
    direct = names.where(~is_capture).join(captures, F.col("other") == F.col("capture_id")).select("record_id", "capture_id")
    reverse = names.where(is_capture).select(F.col("other").alias("record_id"), F.col("record_id").alias("capture_id"))
    known = direct.union(reverse)
    far = names.where(~is_capture).join(known.withColumnRenamed("record_id", "other"), "other").select("record_id", "capture_id")
    placed = known.union(far).distinct()
    others = found.where(~is_capture).join(placed, "record_id")
    keyed = found.where(is_capture).withColumn("capture_id", F.col("record_id")).unionByName(others)
    record = F.struct(*[c for c in found.columns])

    def only(test: Column) -> Column:
        return F.first(F.when(test, record), ignorenulls=True)

    return keyed.groupBy("capture_id").agg(
        only(is_capture).alias("capture"),
        only(F.col("type") == "request").alias("request"),
        only(F.col("type") == "metadata").alias("metadata"),
        F.count_if(is_capture).alias("copies"),
    )


def op7_warc(pages: DataFrame) -> DataFrame:
    """Writes the pages, reads the archives back and gives each page as it was found there."""
    spark, path = pages.sparkSession, new_table(pages.sparkSession, "warc")
    write_archives(pages, path)
    found = stored(read_records(spark, path, payloads=False), "warc-records")
    capture = F.col("capture")
    whole = capture["type"] != "revisit"
    back = transactions(found).select(
        "capture_id",
        F.element_at("metadata.http", "page-id").cast("long").alias("page_id"),
        F.when(whole, capture["payload_bytes"]).otherwise(F.element_at(capture["http"], "content-length").cast("long")).alias("payload_bytes"),
        F.when(whole, capture["payload_digest"])
        .otherwise(F.regexp_replace(F.element_at(capture["headers"], "warc-payload-digest"), "^sha256:", ""))
        .alias("payload_digest"),
        capture["type"].alias("record_type"),
        capture["refers_to"].alias("first_id"),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"),
    )
    back = stored(back, "warc-pages")
    firsts = back.where("record_type <> 'revisit'").select(F.col("capture_id").alias("first_id"), F.col("page_id").alias("refers_to")).distinct()
    joined = back.join(firsts, "first_id", "left")
    return joined.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH named AS (SELECT page_id, CAST(strlen(COALESCE(html, '')) AS BIGINT) AS payload_bytes, sha256(COALESCE(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, MIN(page_id) AS first_id FROM named WHERE payload_bytes >= 100 GROUP BY 1 HAVING COUNT(*) > 1)
SELECT page_id, payload_bytes, n.payload_digest,
  CASE WHEN f.payload_digest IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.payload_digest IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM named n LEFT JOIN firsts f ON n.payload_digest = f.payload_digest
"""
