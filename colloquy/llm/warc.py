"""A content-addressed archive of WARC records.

An archive is two Parquet tables in one folder.  ``payloads`` holds each distinct payload once, under its
SHA-256 digest.  ``headers`` holds each record's header bytes exactly as they were made, up to and with the
empty line, and the digest of its payload.  Joining the two gives every record back, byte for byte; a
payload is only accepted if its own digest is the one it is filed under.

Of records with the same payload of ``least`` bytes or more, that with the smallest id is the
response and the others revisit it.  A revisit's record has no block; its headers name the response
and the payload's digest, from which the full payload is found.

A url's control characters and line or paragraph separators are percent-encoded in its header, so that no url can
end its line; header lines end with CR LF, and nothing else ends one when they are read.

Nulls: a null payload is empty, a null url has no header.  Payloads of any length are binary values of one row.
Ties: of repeated ids with one payload the first row is the response.  An empty table is an archive of no records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import NO_ID, cut_lineage, remove_at_exit, shared_folder, table

LEAST = 100
#: Records in a list that is broadcast: some 20 MB.
SHORT_LIST = 200_000
#: Every record of an archive carries this date, unless the caller has a column for it.
DATE = "2024-01-01T00:00:00Z"
CONTROL = r"[\x00-\x1F\x7F-\u009F\u2028\u2029]"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def one_line(text: Column) -> Column:
    """A header's value: what could end its line, and other control characters, as percent escapes."""
    escape = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    escaped = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1)), lambda c: F.when(c.rlike(CONTROL), escape(c)).otherwise(c)), "")
    return F.when(text.rlike(CONTROL), escaped).otherwise(text)


def write_archive(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> None:
    """Writes ``pages`` as an archive into ``folder``, which must not hold one.

    A null payload is empty; a null url leaves its header out; a row without an id comes after all
    others and is never revisited by rows with one.  Of repeated ids with the same payload the first
    row, and only one, is the response.  Only the three named columns are read.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("rank"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    )
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    plain = cut_lineage(rows.drop("payload").withColumn("row", F.monotonically_increasing_id()))
    first = plain.groupBy("digest").agg(F.min(F.struct("rank", "row")).alias("first"), F.count("*").alias("n"))
    first = cut_lineage(first.where("n > 1").select("digest", "first"))

    told = plain.join(first, "digest", "left")
    again = F.col("first").isNotNull() & (F.struct("rank", "row") != F.col("first"))
    revisits = again & (F.col("size") >= least)
    refers = F.when(F.col("first.rank") != NO_ID, F.col("first.rank"))
    kind = F.when(revisits, F.lit("revisit")).otherwise(F.lit("response"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), one_line(F.col("url")))),
        F.when(revisits, F.concat(F.lit("WARC-Refers-To: "), record_id(refers))),
        F.when(revisits, F.lit(f"WARC-Profile: {REVISIT}")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("Content-Length: "), F.when(revisits, F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit(""),
        F.lit(""),
    ]
    headers = told.select(F.col("digest"), F.encode(F.concat_ws("\r\n", *lines), "UTF-8").alias("header"))
    headers.write.parquet(f"{folder}/headers")
    # one row of each digest keeps its payload; while the list of others is short no payload moves for it
    others = cut_lineage(told.where(again).select("digest", "rank", (F.col("rank") == F.col("first.rank")).alias("same_id")))
    listed = others.where(~F.col("same_id")).select("digest", "rank").distinct()
    if others.count() <= SHORT_LIST:
        listed = F.broadcast(listed)
    kept = rows.join(listed, ["digest", "rank"], "left_anti")
    if others.where("same_id").limit(1).count():
        kept = kept.dropDuplicates(["digest"])
    kept.select("digest", "payload").write.parquet(f"{folder}/payloads")


def header_value(name: str) -> Column:
    """The value of the first header line with this name; null if there is none, or nothing in it."""
    found = F.regexp_extract(F.decode("header", "UTF-8"), rf"\A(?:[^\r\n]*+\r\n)*?{name}: ([^\r\n]*+)\r\n", 1)
    return F.when(found != "", found)


def read_archive(spark, folder: str) -> DataFrame:
    """(header, payload, digest) of each record, payloads joined in and held against their digests."""
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads")
    good = F.sha2("payload", 256) == F.col("digest")
    checked = F.when(good, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest: "), F.col("digest"))))
    payloads = payloads.select("digest", checked.alias("payload"))
    headers = spark.read.schema("digest string, header binary").parquet(f"{folder}/headers")
    return headers.join(payloads, "digest", "left").select(
        "header", F.coalesce("payload", F.raise_error(F.concat(F.lit("no payload under "), F.col("digest"))).cast("binary")).alias("payload"), "digest"
    )


def records(archive: DataFrame) -> DataFrame:
    """The archive's records as bytes: header, block and the two line ends that close a record."""
    block = F.when(header_value("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return archive.select(F.concat(F.col("header"), block, F.lit(b"\r\n\r\n")).alias("record"))


def parsed(archive: DataFrame) -> DataFrame:
    """What the records' headers say, beside the payload they stand for."""
    page = lambda name: F.regexp_extract(F.coalesce(header_value(name), F.lit("")), r"^<urn:page:(-?\d+)>$", 1)
    number = lambda x: F.when(x != "", x.cast("long"))
    return archive.select(
        number(page("WARC-Record-ID")).alias("page_id"),
        header_value("WARC-Target-URI").alias("url"),
        header_value("WARC-Type").alias("record_type"),
        F.regexp_extract(header_value("WARC-Payload-Digest"), r"^sha256:([0-9a-f]{64})$", 1).alias("payload_digest"),
        number(page("WARC-Refers-To")).alias("refers_to"),
        number(header_value("Content-Length")).alias("content_length"),
        "payload",
    )


def op8_warc(spark, sf_dir: str) -> DataFrame:
    folder = remove_at_exit(spark, shared_folder(spark, "warc"))
    write_archive(table(spark, sf_dir, "pages"), folder)
    found = parsed(read_archive(spark, folder))
    return found.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha256(html) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM d LEFT JOIN f USING (digest)
"""
