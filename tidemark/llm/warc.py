"""A content-addressed WARC archive: payload bytes once by digest, record headers apart, records by a join.

``write_archive`` writes two Parquet tables under a folder:

* ``payloads``: sha256 (the address), sha1, length and the payload bytes, one row for each content;
* ``headers``: the exact header block of each record, CRLF line ends included, and the address.

``read_archive`` joins them, checks each payload against its address and its header's digest, and
gives back whole records. Payloads of at least ``min_bytes`` that equal another's are stored as
revisit records that name the response, the one with the largest id.

Defined results: a null payload is an empty one; a null url makes ``WARC-Target-URI: urn:null``;
payloads of any length are stored whole; rows that repeat an id are records of their own, and of records tied for response (the same largest
id and payload) all are responses; an empty table gives an empty archive; other columns are ignored.
"""

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Digits of base 32 as a number base and of RFC 4648, and WARC 1.1 field names and profile.
_NUMBER_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_RFC_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base 32 of the SHA-1: four groups of 40 bits make eight digits each."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), _NUMBER_DIGITS, _RFC_DIGITS)


def _header(kind: Column, date: str) -> Column:
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("urn:null")), r"\r", "%0D"), r"\n", "%0A")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(kind == "revisit", F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("response_id").cast("string"), F.lit(">"))),
        F.when(kind == "revisit", F.lit(f"WARC-Profile: {_REVISIT_PROFILE}")),
        F.concat(F.lit("X-Payload-Length: "), F.col("length").cast("string")),
        F.concat(F.lit("Content-Length: "), F.when(kind == "revisit", F.lit("0")).otherwise(F.col("length").cast("string"))),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))


def write_archive(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str | None = None) -> None:
    """Write ``df`` as an archive under ``path``; ``date`` (UTC, as WARC/1.1 writes it; by default now) is that of all records.

    Equal payloads meet in an aggregate that keeps one copy and the largest id, after a partial one
    in each task, so a payload that a third of the rows share travels once a task. Headers then join
    the light (address, response) pairs; the bytes are not part of that join.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    pages = df.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b"")).alias("payload")
    )
    addressed = pages.withColumn("sha256", F.sha2("payload", 256))
    (
        addressed.groupBy("sha256")
        .agg(F.first("payload").alias("payload"), F.max("id").alias("response_id"))
        .select("sha256", base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("length"), "response_id", "payload")
        .write.parquet(f"{path}/payloads")
    )
    owners = df.sparkSession.read.parquet(f"{path}/payloads").select("sha256", "sha1", "length", "response_id")
    records = addressed.select("id", "url", "sha256").join(owners, "sha256")
    kind = F.when((F.col("length") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("response_id")) & F.col("response_id").isNotNull(), "revisit").otherwise("response")
    records.select("id", "sha256", _header(kind, date).alias("header")).write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of an archive: id, header, parsed fields, whether the bytes match their digests, payload.

    The digest of each payload is computed again from the stored bytes, once for each content; a
    record is ``verified`` if address, SHA-1 and length all agree with the bytes. Without
    ``with_payload`` the bytes are checked but don't travel through the join.
    """
    stored = spark.read.parquet(f"{path}/payloads").select(
        "sha256",
        base32_sha1(F.col("payload")).alias("stored_sha1"),
        F.octet_length("payload").cast("long").alias("stored_length"),
        (F.sha2("payload", 256) == F.col("sha256")).alias("intact"),
        *(["payload"] if with_payload else []),
    )

    def field(name: str) -> Column:
        found = F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1)
        return F.when(found != "", found)

    heads = spark.read.parquet(f"{path}/headers")
    joined = heads.join(stored, "sha256", "left").withColumns({
        "record_type": field("WARC-Type"),
        "payload_digest": F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", ""),
        "payload_bytes": field("X-Payload-Length").cast("long"),
        "refers_to": F.regexp_extract(field("WARC-Refers-To"), r"urn:page:(-?\d+)", 1).cast("long"),
    })
    verified = F.coalesce(F.col("intact") & (F.col("stored_sha1") == F.col("payload_digest")) & (F.col("stored_length") == F.col("payload_bytes")), F.lit(False))
    return joined.withColumn("verified", verified).drop("stored_sha1", "stored_length", "intact")


def rebuilt(spark: SparkSession, path: str) -> DataFrame:
    """All records with their lengths and digests: id, record_type, payload_bytes, payload_digest, refers_to, verified.

    Each response is put together again, header block, payload and line ends, by a join of the two tables, and its
    columns are taken from those bytes; that is one row for each content, so no key is hot. Revisits have no block of
    their own: their headers are checked against the stored content's digests.
    """
    records = read_archive(spark, path, with_payload=False)
    heads = records.filter("record_type = 'response'").select("id", "sha256", "header", F.struct("payload_bytes", "payload_digest").alias("said"), "record_type", "refers_to")
    whole = spark.read.parquet(f"{path}/payloads").select("sha256", "payload").join(heads.hint("shuffle_hash"), "sha256")
    whole = whole.withColumn("record", record_bytes(whole))
    before = F.octet_length("header")
    body = F.substring(F.col("record"), before + 1, F.octet_length("record") - before - 4)
    made = whole.select("id", "record_type", "said", "refers_to", "sha256", body.alias("body"))
    made = made.select("id", "record_type", "refers_to", F.octet_length("body").cast("long").alias("payload_bytes"), base32_sha1(F.col("body")).alias("payload_digest"), "said", (F.sha2("body", 256) == F.col("sha256")).alias("intact"))
    columns = ["id", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    agree = F.coalesce(F.col("intact") & (F.struct("payload_bytes", "payload_digest") == F.col("said")), F.lit(False))
    return made.select(*columns, agree.alias("verified")).unionByName(records.filter("record_type <> 'response'").select(*columns, "verified"))


def record_bytes(records: DataFrame) -> Column:
    """The whole record as it stands in a WARC file: header, block (none for a revisit) and two line ends."""
    block = F.when(records["record_type"] == "revisit", F.lit(b"")).otherwise(records["payload"])
    return F.concat(F.encode(records["header"], "UTF-8"), block, F.lit((CRLF + CRLF).encode()))
