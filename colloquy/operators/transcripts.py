"""Transcripts and speakers' totals from segments, and the filters over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.schema import IMPORTANCE, LEAST_DURATION


def by_speaker(segments: DataFrame, speaker: str) -> DataFrame:
    return segments.where(F.col("speaker") == speaker)


def overlaps(start: Column, end: Column) -> Column:
    """Whether a segment shares more than a moment with the time from start to end."""
    return (F.col("start_time") < end) & (F.col("end_time") > start)


def in_range(segments: DataFrame, start: float, end: float) -> DataFrame:
    return segments.where(overlaps(F.lit(float(start)), F.lit(float(end))))


#: Widths of the slots that intervals are laid on: powers of this many seconds.
SLOT_BASE = 16


def in_ranges(segments: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pairs of ``ranges`` (range_id, range_start, range_end) and the segments that overlap them.

    An interval's level is the least power of ``SLOT_BASE`` seconds that is no shorter, and it lies in at most two slots of that
    width, or of any larger one.  A pair meets at the larger of its two levels, so that an interval becomes
    two rows for its own level and each larger one of the other side, however long it is.  Intervals with a null
    or without a length, or a reversed one, overlap nothing.
    """
    length = lambda a, b: F.col(b) - F.col(a)
    level = lambda a, b: F.greatest(F.lit(0), F.ceil(F.log(float(SLOT_BASE), length(a, b)))).cast("int")
    slot = lambda c, at: F.floor(F.col(c) / F.pow(F.lit(float(SLOT_BASE)), at)).cast("long")
    left = segments.where(length("start_time", "end_time") > 0).withColumn("_own", level("start_time", "end_time"))
    right = ranges.where(length("range_start", "range_end") > 0).withColumn("_own2", level("range_start", "range_end"))
    levels = lambda df, own: sorted(r[0] for r in df.select(own).distinct().collect())  # noqa: E731  a dozen for any doubles that are times

    def laid(df: DataFrame, own: str, start: str, end: str, others: list[int], at: str) -> DataFrame:
        wanted = F.array_union(F.array(own), F.filter(F.array(*(F.lit(x) for x in others)).cast("array<int>"), lambda x: x > F.col(own)))
        df = df.withColumn(at, F.explode(wanted))
        return df.withColumn(f"{at}_slot", F.explode(F.sequence(slot(start, F.col(at)), slot(end, F.col(at)))))

    of_ranges = levels(right, "_own2")
    left = laid(left, "_own", "start_time", "end_time", of_ranges, "_at")
    right = laid(right, "_own2", "range_start", "range_end", levels(left, "_own"), "_at2")
    pairs = left.join(right, (F.col("_at") == F.col("_at2")) & (F.col("_at_slot") == F.col("_at2_slot")))
    met = (F.col("_at") == F.greatest("_own", "_own2")) & (F.col("_at_slot") == F.greatest(slot("start_time", F.col("_at")), slot("range_start", F.col("_at"))))
    return pairs.where(overlaps(F.col("range_start"), F.col("range_end")) & met).drop("_own", "_own2", "_at", "_at2", "_at_slot", "_at2_slot")


def with_duration(segments: DataFrame) -> DataFrame:
    return segments.withColumn("duration", F.col("end_time") - F.col("start_time"))


def speaker_stats(segments: DataFrame, *keys: str) -> DataFrame:
    """Total duration and number of segments of each speaker, or of each within ``keys``."""
    return segments.groupBy(*keys, "speaker").agg(F.sum(F.col("end_time") - F.col("start_time")).alias("total_duration"), F.count("*").alias("segment_count"))


def counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy("doc_id").agg(F.count("*").alias("segment_count"), F.count_distinct("speaker").alias("speaker_count"))


def speakers_first_seen(segments: DataFrame) -> DataFrame:
    """Each document's speakers in the order of their first segments; a row a speaker is gathered, not a row a segment."""
    first = segments.groupBy("doc_id", "speaker").agg(F.min("ord").alias("ord"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "speaker")))
    return first.groupBy("doc_id").agg(F.transform(ordered, lambda x: x["speaker"]).alias("speakers"))


def summed_up() -> list[Column]:
    """Aggregates of a document's segments."""
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda x: x["content"]), "\n")
    return [F.max("end_time").alias("duration"), F.sort_array(F.collect_set("speaker")).alias("speakers"), F.count("*").alias("segment_count"), content.alias("content")]


def summary_columns() -> list[Column]:
    """A transcript's columns from those aggregates, which are null for a document without segments."""
    duration = F.when(F.coalesce("duration", F.lit(0.0)) == 0, F.lit(LEAST_DURATION)).otherwise(F.col("duration"))
    return [
        duration.alias("duration_seconds"),
        F.coalesce("speakers", F.array().cast("array<string>")).alias("speakers"),
        F.coalesce("segment_count", F.lit(0)).alias("segment_count"),
        F.coalesce("content", F.lit("")).alias("content"),
    ]


def summaries(segments: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """A row for each transcript: duration, speakers in alphabetical order, number of segments, content.

    ``docs`` (doc_id) adds those without segments; they have the least duration and no speakers.
    """
    found = segments.groupBy("doc_id").agg(*summed_up())
    if docs is not None:
        found = docs.select("doc_id").join(found, "doc_id", "left")
    return found.select("doc_id", *summary_columns())


def nested(segments: DataFrame, as_of: str, docs: DataFrame | None = None, mode: str | None = None) -> DataFrame:
    """Transcripts with their segments as an array, an id, a date (``as_of``) and metadata, among it the processing ``mode`` if given."""
    row = F.struct("ord", F.col("seg_id").alias("id"), "speaker", "start_time", "end_time", "content", "confidence")
    found = segments.groupBy("doc_id").agg(*summed_up(), F.array_sort(F.collect_list(row)).alias("segments"))
    if docs is not None:
        found = docs.select("doc_id").join(found, "doc_id", "left")
    told = [F.lit("processing_mode"), F.lit(mode)] if mode is not None else []
    found = found.select("doc_id", *summary_columns(), F.coalesce("segments", F.array().cast(found.schema["segments"].dataType)).alias("segments"))
    return found.select(
        F.concat(F.lit("transcript_"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 8)).alias("id"),
        F.col("doc_id").cast("string").alias("file_path"),
        F.lit(as_of).cast("timestamp").alias("date"),
        "duration_seconds",
        "speakers",
        "content",
        "segments",
        F.create_map(
            F.lit("source_file"), F.col("doc_id").cast("string"), F.lit("segment_count"), F.col("segment_count").cast("string"), F.lit("processing_date"), F.lit(as_of), *told
        ).alias("metadata"),
    )


def minutes_and_hours(transcripts: DataFrame) -> DataFrame:
    return transcripts.withColumns({"minutes": F.col("duration_seconds") / 60, "hours": F.col("duration_seconds") / 3600})


def violations_of() -> Column:
    """Names of the constraints that a segment breaks."""
    rules = {
        "start_negative": F.col("start_time") < 0,
        "end_not_positive": F.col("end_time") <= 0,
        "end_before_start": F.col("end_time") <= F.col("start_time"),
        "confidence_out_of_range": ~F.col("confidence").between(0, 1),
    }
    return F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))


def violations(segments: DataFrame) -> DataFrame:
    """Segments that break a constraint, with the names of those they break."""
    return segments.withColumn("violations", violations_of()).where(F.size("violations") > 0)


def of_importance(evidence: DataFrame, importance: str) -> DataFrame:
    if importance not in IMPORTANCE:
        raise ValueError(f"no such importance: {importance}")
    return evidence.where(F.col("importance") == importance)
