"""WARC archives with revisit resolution.

Headers (page, payload digest, payload size) are reduced by digest to the page that keeps the payload, the largest page_id; pages join that
reduced table on (digest, salt), so a payload that a third of all pages share spreads over SALTS join keys, and adaptive execution may split
those further. Records are then written afresh: response records with their payload, revisit records with headers only.

Archives are plain WARC/1.1, written by Spark's text writer: a record is one string, CRLF CRLF ends it. Every file begins with the archive's warcinfo record. Every other
record's first named field is the id of that one, drawn anew for each archive, so the reader may split files at that line without mistaking a payload for it; each block is then
checked against its Content-Length. read_foreign() reads archives of any other writer, whole files at a time.

Nulls: a null payload is empty; a null page_id counts as smaller than any other and becomes null again when read. Payloads below min_bytes are always
responses. Rows that repeat both the largest page_id and the payload are responses each, their other copies revisits. Empty tables give an
archive without records. Columns other than those named are not read.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, new_path

MIN_BYTES = 1000
SALTS = 16
_END = "\r\n\r\n"
_INFO = "WARC/1.1\r\nWARC-Type: warcinfo\r\n"


def headers(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest (SHA-1, bare lower-case hex)."""
    body = F.coalesce(F.col(payload), F.lit(""))
    df = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    return df.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1(F.encode("payload", "UTF-8")))


def resolve(records: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """records (of headers()) with record_type and refers_to."""
    shared = (
        records.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
        .agg(F.count("*").alias("copies"), F.max("page_id").alias("original")).where("copies > 1")
        .select(F.col("payload_digest").alias("d"), "original", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = records.withColumn("own_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(shared, (F.col("payload_digest") == F.col("d")) & (F.col("own_salt") == F.col("salt")), "left")
    again = (F.col("payload_bytes") >= min_bytes) & F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return joined.select(
        *records.columns,
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("original")).alias("refers_to"),
    )


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), F.regexp_replace(value, "[\\r\\n]+", " "), F.lit("\r\n"))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:ampliweave:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def render(resolved: DataFrame, archive: str) -> DataFrame:
    """One column, record: each row of resolve() as a WARC record without the CRLF CRLF that ends it; a partition's first has the warcinfo record before it."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(_END))
    block = F.when(revisit, F.col("http")).otherwise(F.concat("http", "payload"))
    head = F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Warcinfo-ID: <urn:uuid:{archive}>\r\n"),
        _field("WARC-Type", F.col("record_type")),
        _field("WARC-Record-ID", _urn(F.col("page_id"))),
        F.lit("WARC-Date: 2000-01-01T00:00:00Z\r\n"),
        F.coalesce(_field("WARC-Target-URI", F.col("url")), F.lit("")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(
            revisit,
            F.concat(
                F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Truncated: length\r\n"),
                _field("WARC-Refers-To", _urn(F.col("refers_to"))),
            ),
        ).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"),
        F.lit(_END),
    )
    about = "software: ampliweave\r\nformat: WARC File Format 1.1\r\n"
    info = f"{_INFO}WARC-Record-ID: <urn:uuid:{archive}>\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(about)}{_END}{about}{_END}"
    leads = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    rows = resolved.withColumn("http", http).withColumn("block", block)
    return rows.select(F.concat(F.when(leads, F.lit(info)).otherwise(""), head, "block").alias("record"))


def write(resolved: DataFrame, path: str, compression: str = "gzip") -> str:
    """Write the archive and return its id, which read() needs. Files are as large as the partitions of resolved."""
    archive = str(uuid.uuid4())
    render(resolved, archive).write.option("lineSep", _END).option("compression", compression).text(path)
    return archive


def read(spark: SparkSession, path: str, archive: str) -> DataFrame:
    """url, payload, page_id, payload_bytes, payload_digest, record_type, refers_to of the records of an archive that write() made.

    Raises where a record's block hasn't the length that its header gives, or a response's payload not the digest.
    """
    start = f"WARC/1.1\r\nWARC-Warcinfo-ID: <urn:uuid:{archive}>\r\n"
    raw = spark.read.option("lineSep", start).text(path).where((F.octet_length("value") > 0) & ~F.col("value").startswith(_INFO))
    cut = raw.select(F.substring_index("value", _END, 1).alias("head"), "value")
    named = lambda name: F.nullif(F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))
    page = lambda name: F.regexp_extract("head", rf"(?m)^{name}: <urn:ampliweave:page:(-?[0-9]+|none)>", 1).try_cast("long")
    rest = F.expr(f"substring(value, length(head) + {len(_END) + 1})")
    df = cut.select("head", rest.alias("rest"), named("WARC-Type").alias("record_type"), page("WARC-Record-ID").alias("page_id"), page("WARC-Refers-To").alias("refers_to"),
                    named("WARC-Target-URI").alias("url"), F.regexp_extract("head", r"(?m)^Content-Length: ([0-9]+)", 1).cast("long").alias("size"),
                    F.regexp_extract("head", r"(?m)^WARC-Payload-Digest: sha1:([0-9a-f]+)", 1).alias("payload_digest"))
    df = df.withColumn("block", F.expr(f"substring(rest, 1, length(rest) - {len(_END)})"))
    df = df.withColumn("http", F.substring_index("block", _END, 1))
    df = df.withColumn("payload_bytes", F.regexp_extract("http", r"Content-Length: ([0-9]+)", 1).cast("long"))
    df = df.withColumn("payload", F.when(F.col("record_type") == "response", F.expr(f"substring(block, length(http) + {len(_END) + 1})")))
    sound = (F.octet_length("block") == F.col("size")) & (
        (F.col("record_type") == "revisit") | (F.col("payload_digest") == F.sha1(F.encode("payload", "UTF-8"))) & (F.octet_length("payload") == F.col("payload_bytes"))
    )
    checked = F.when(sound, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("damaged record: "), F.col("head"))).cast("boolean"))
    return df.where(checked).select("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields, block) of each record of a WARC file, gzip members or plain; stops at the first that is not whole."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while True:
        while data.startswith(b"\r\n", at):
            at += 2
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = fields.get("content-length", "")
        if not lines[0].startswith("WARC/") or not size.isdigit() or end + 4 + int(size) > len(data):
            return
        yield fields, data[end + 4 : end + 4 + int(size)]
        at = end + 4 + int(size)


def read_foreign(spark: SparkSession, path: str) -> DataFrame:
    """type, record_id, url, digest, refers_to, block of the records under a path; a task holds one file at a time."""

    def rows(contents: list) -> Iterator[tuple]:
        for data in contents:
            for f, block in parse_records(data):
                yield f.get("warc-type"), f.get("warc-record-id"), f.get("warc-target-uri"), f.get("warc-payload-digest"), f.get("warc-refers-to"), block

    return map_rows(spark.read.format("binaryFile").load(path).select("content"), rows, "type string, record_id string, url string, digest string, refers_to string, block binary")


def archive_pages(pages: DataFrame, path: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the pages' deduplicated archive (by default in the session's shared folder) and read it back."""
    path = path or new_path(pages.sparkSession, "warc")
    return read(pages.sparkSession, path, write(resolve(headers(pages), min_bytes), path))
