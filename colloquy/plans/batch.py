"""Files to transcripts: read, parse, merge, sum up, with errors as rows."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.operators.merge import merge_segments
from colloquy.operators.parse import parse_labelled, parse_timestamped
from colloquy.operators.transcripts import summary_columns, summed_up, violations_of
from colloquy.schema import BatchOptions
from colloquy.sources.discovery import FileFilter, SortOrder, ordered, scan
from colloquy.sources.reader import read_texts, scan_texts


@dataclass(frozen=True)
class Batch:
    """``texts`` and ``segments`` (merged, if asked for) of all files; ``transcripts`` and ``errors`` are disjoint.

    ``status`` has both: a transcript's columns and ``error`` for each document.
    """

    texts: DataFrame
    segments: DataFrame
    transcripts: DataFrame
    errors: DataFrame
    status: DataFrame


def process_texts(texts: DataFrame, options: BatchOptions = BatchOptions()) -> Batch:
    """``texts`` has doc_id and text, and may have error, which marks a document that couldn't be read.

    A document with a segment that breaks a constraint fails as a whole: it becomes a row of ``errors``, or
    with ``skip_on_error`` off raises as soon as its transcript is read.

    Texts are parsed once, and everything that is asked of a document shares the partitioning by document that the
    parser's clock makes: whether one of its segments is broken is a window over it, and its totals and its
    error are one aggregation.
    """
    if "error" not in texts.columns:
        texts = texts.withColumn("error", F.lit(None).cast("string"))
    if options.max_concurrent is not None:
        texts = texts.coalesce(options.max_concurrent)
    parse = parse_timestamped if options.parser == "timestamped" else parse_labelled
    readable = texts.where("error is null").select("doc_id", "text")
    segments = parse(readable, default_speaker=options.default_speaker, default_confidence=options.default_confidence)
    if options.merge_segments:
        segments = merge_segments(segments, options.merge)
    found = F.array_join(violations_of(), ", ")
    segments = segments.withColumn("_found", F.when(found != "", F.concat(F.lit("invalid segment "), F.col("seg_id"), F.lit(": "), found)))

    totals = segments.groupBy("doc_id").agg(*summed_up(), F.min("_found").alias("_found"))
    status = texts.select("doc_id", "error").join(totals, "doc_id", "left").withColumn("error", F.coalesce("error", "_found"))
    status = status.select("doc_id", *summary_columns(), "error")
    good = F.col("error").isNull()
    first_found = F.min("_found").over(Window.partitionBy("doc_id"))
    kept = segments.withColumn("error", first_found).drop("_found")
    if not options.skip_on_error:
        raised = F.raise_error(F.concat_ws(": ", F.col("doc_id").cast("string"), "error")).cast("boolean")
        good = F.when(good, F.lit(True)).otherwise(raised)
    return Batch(texts, kept.where(good).drop("error"), status.where(good).drop("error"), status.where("error is not null").select("doc_id", "error"), status)


def summary(batch: Batch) -> DataFrame:
    """One row: files, successes, failures, the share of successes, segments and seconds.

    The errors themselves stay rows, in ``batch.errors``.
    """
    good = F.col("error").isNull()
    counted = batch.status.agg(
        F.count("*").alias("total_files"),
        F.count_if(good).alias("successful_files"),
        F.count_if(~good).alias("failed_files"),
        F.coalesce(F.sum(F.when(good, F.col("segment_count"))), F.lit(0)).alias("total_segments"),
        F.coalesce(F.sum(F.when(good, F.col("duration_seconds"))), F.lit(0.0)).alias("total_duration_seconds"),
    )
    rate = F.when(F.col("total_files") == 0, F.lit(1.0)).otherwise(F.col("successful_files") / F.col("total_files"))
    return counted.select("total_files", "successful_files", "failed_files", rate.alias("success_rate"), "total_segments", "total_duration_seconds")


def process_files(spark: SparkSession, paths: list[str] | DataFrame, options: BatchOptions = BatchOptions()) -> Batch:
    """``paths``: a list, or a DataFrame with path and length, and perhaps an encoding for each file."""
    return process_texts(read_texts(spark, paths, options.encoding), options)


def process_directory(
    spark: SparkSession,
    directory: str,
    pattern: str = "*.txt",
    recursive: bool = False,
    options: BatchOptions = BatchOptions(),
    *,
    where: FileFilter | None = None,
    exact: bool = True,
) -> Batch:
    """All files of a folder, or those that pass ``where``, which then has the pattern as well.

    The listing and the reading are Spark's own.  ``exact`` lists the folder on the driver as well, for the empty and hidden
    files that Spark leaves out and the links that it follows; turn that off for folders of many millions of files.
    """
    where = where or FileFilter(pattern=pattern, recursive=recursive)
    return process_texts(scan_texts(spark, directory, where, options.encoding, exact), options)


def in_order(transcripts: DataFrame, files: DataFrame, order: SortOrder = SortOrder.NAME) -> DataFrame:
    """Transcripts of files in an order of their files; ``files`` as ``sources.discovery`` lists them."""
    listed = transcripts.join(files.withColumnRenamed("path", "doc_id"), "doc_id")
    return ordered(listed.withColumn("path", F.col("doc_id").cast("string")), order).select(*transcripts.columns)


def discover(spark: SparkSession, directory: str, where: FileFilter = FileFilter(), order: SortOrder | None = SortOrder.NAME) -> DataFrame:
    """The files that ``process_directory`` would take, in order, but for empty and hidden ones."""
    return scan(spark, directory, where, order)


def process_single(spark: SparkSession, path: str, options: BatchOptions = BatchOptions()) -> Batch:
    return process_files(spark, [path], replace(options, max_concurrent=None))
