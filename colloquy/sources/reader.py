"""Files to texts: whole files, decoded by their byte order mark, as told, or by what their bytes look like."""

from __future__ import annotations

import codecs
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from colloquy.functions.text import byte_order_mark, decoded
from colloquy.schema import ConfigurationError
from colloquy.sources.discovery import FileFilter, as_pattern, file_lengths, files_reader, unscanned
from colloquy.sources.scratch import scratch

NATIVE = ("utf-8", "utf-8-sig", "utf-16-le", "utf-16-be")

#: Bytes that are looked at to tell an encoding, and the share of characters that have to look right.
SAMPLE = 65_536
CONFIDENCE = 0.7

#: Paths of a list that the driver holds at once.
PATHS = 5_000
CONTENTS = "key string, content binary, n long"

# Encodings that are tried on bytes that aren't UTF-8, each with the characters that speak for it.
GUESSES = (
    ("euc-kr", ((0xAC00, 0xD7A3),)),
    ("cp949", ((0xAC00, 0xD7A3),)),
    ("shift_jis", ((0x3040, 0x30FF),)),
    ("euc-jp", ((0x3040, 0x30FF),)),
    ("gb18030", ((0x4E00, 0x9FFF),)),
    ("windows-1252", ((0xC0, 0xFF), (0x2018, 0x201D))),
)


def guess_encoding(content: bytes) -> str:
    """The first encoding in which the bytes decode and enough of their characters beyond ASCII are of its own kind; else UTF-8."""
    sample = content[:SAMPLE]
    for name, ranges in GUESSES:
        try:  # a character may be cut off at the sample's end
            text = codecs.getincrementaldecoder(name)().decode(sample, final=len(content) <= SAMPLE)
        except UnicodeDecodeError:
            continue
        beyond = [ord(c) for c in text if ord(c) >= 0x80]
        if sum(any(a <= c <= b for a, b in ranges) for c in beyond) > CONFIDENCE * len(beyond):
            return name
    return "utf-8"


def _decoded_others(content: Column, encoding: Column) -> Column:
    """encoding and text of contents that the JVM can't decode; nulls for null contents."""

    @F.pandas_udf(StructType().add("encoding", StringType()).add("text", StringType()))
    def decode(content: pd.Series, encoding: pd.Series) -> pd.DataFrame:
        rows = []
        for c, e in zip(content, encoding, strict=True):
            if c is None:
                rows.append((None, None))
                continue
            name = e or guess_encoding(bytes(c))
            try:
                rows.append((name, bytes(c).decode(name, errors="replace")))
            except LookupError:
                rows.append((name, None))
        return pd.DataFrame(rows, columns=["encoding", "text"])

    return decode(content, encoding)


def decode_contents(files: DataFrame, encoding: str | None = None) -> DataFrame:
    """Adds ``text`` and ``encoding`` to rows with ``content``.

    ``encoding``, or a column of that name for each row, tells the charset; where neither does, a byte order
    mark decides, then whether the bytes are UTF-8, then what they look like.  Malformed bytes are replaced; the text
    is null where the charset is unknown.  Only contents that the JVM can't decode go through Python.
    """
    if encoding is not None:
        try:
            codecs.lookup(encoding)
        except LookupError as e:
            raise ConfigurationError(f"no such encoding: {encoding}") from e
    told = F.lit(encoding) if encoding else F.col("encoding") if "encoding" in files.columns else F.lit(None).cast("string")
    content = F.col("content")
    utf8 = F.when(F.is_valid_utf8(content.cast("string")), F.lit("utf-8"))
    files = files.withColumn("encoding", F.coalesce(F.nullif(F.lower(told), F.lit("")), byte_order_mark(content), utf8))
    native = F.coalesce(F.col("encoding").isin(*NATIVE), F.lit(False))
    if encoding and encoding.lower() in NATIVE:
        return files.withColumn("text", decoded(content, F.col("encoding")))
    files = files.withColumn("_other", _decoded_others(F.when(~native, content), F.col("encoding")))
    text = F.when(native, decoded(content, F.col("encoding"))).otherwise(F.col("_other.text"))
    return files.withColumns({"text": text, "encoding": F.coalesce("encoding", "_other.encoding")}).drop("_other")


def _key(path: str) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def _contents(spark: SparkSession, files: DataFrame) -> DataFrame:
    """key, content and length (n) of the files that are there.

    A list of paths costs the driver memory for as long as its table is in use.  A longer one than ``PATHS`` is read
    in turns, each put into one table of the shared folder before the next is asked for.
    """
    wanted = files.toLocalIterator()
    turns = iter(lambda: [r["path"] for r in islice(wanted, PATHS)], [])
    table = None
    for turn in turns:
        paths = [as_pattern(p) for p, n in zip(turn, file_lengths(spark, turn), strict=True) if n is not None]  # a missing one would end the read
        if not paths:
            continue
        part = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(paths).select(_key("path").alias("key"), "content", F.col("length").alias("n"))
        if table is None and len(turn) < PATHS:
            return part
        table = table or scratch(spark, "contents") + "/table"
        part.write.mode("append").parquet(table)
    return spark.read.schema(CONTENTS).parquet(table) if table else spark.createDataFrame([], CONTENTS)


def read_texts(spark: SparkSession, files: DataFrame | list[str], encoding: str | None = None) -> DataFrame:
    """doc_id (the path), text, encoding and length of files; a file that can't be read has an error instead of a text.

    ``files``: paths, or a DataFrame with ``path``, ``length``, of which empty files get an empty text, and perhaps ``encoding``.
    Paths are taken as they are, whatever characters they have.  They pass the driver, as any list of paths to Spark
    does, but no more than ``PATHS`` at once; ``scan_texts`` reads folders without that.
    """
    if isinstance(files, list):
        files = spark.createDataFrame(list(zip(files, file_lengths(spark, files), strict=True)), "path string, length long")
    told = F.col("encoding") if "encoding" in files.columns else F.lit(None).cast("string")
    listed = files.select("path", "length", told.alias("told"), _key("path").alias("key"))
    found = _contents(spark, listed.where("length > 0").select("path").distinct())
    joined = decode_contents(listed.withColumnRenamed("told", "encoding").join(found, "key", "left"), encoding)
    return _finished(joined, F.col("content").isNull() & (F.coalesce("length", F.lit(1)) > 0))


def _finished(files: DataFrame, missing: Column) -> DataFrame:
    error = F.when(missing, F.concat(F.lit("cannot read "), F.col("path")))
    error = F.coalesce(error, F.when(F.col("content").isNotNull() & F.col("text").isNull(), F.concat(F.lit("unknown encoding "), F.col("encoding"))))
    return files.select(
        F.col("path").alias("doc_id"),
        F.when(error.isNull(), F.coalesce("text", F.lit(""))).alias("text"),
        F.coalesce("encoding", F.lit("utf-8")).alias("encoding"),
        F.coalesce(F.col("n") if "n" in files.columns else F.lit(None), "length", F.lit(0)).cast("long").alias("length"),
        error.alias("error"),
    )


def scan_texts(spark: SparkSession, directory: str, where: FileFilter = FileFilter(), encoding: str | None = None, exact: bool = True) -> DataFrame:
    """The same columns for a folder's files by Spark's own listing: their paths and contents don't pass the driver.

    Spark's listing leaves out empty and hidden files and follows links.  With ``exact`` a listing on the driver adds the empty
    files, with an empty text, and the hidden ones, which Spark refuses to read, with an error, and takes the links away.
    """
    content = files_reader(spark, directory, where).load(directory).where(where.condition())
    texts = _finished(decode_contents(content.select("path", "length", "content"), encoding), F.lit(False))
    if not exact:
        return texts
    others = unscanned(spark, directory, where)
    missing = others.where("not link").select(
        F.col("path").alias("doc_id"),
        F.when(F.col("length") == 0, "").alias("text"),
        F.lit(encoding.lower() if encoding else "utf-8").alias("encoding"),
        "length",
        F.when(F.col("length") > 0, F.concat(F.lit("cannot read hidden file "), F.col("path"))).alias("error"),
    )
    links = others.where("link").select(_key("path").alias("_key"))
    return texts.join(links, _key("doc_id") == F.col("_key"), "left_anti").unionByName(missing)
