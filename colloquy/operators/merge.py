"""Merging of continuous segments, and checks of their continuity.

Segments of one speaker that follow each other without a gap beyond the tolerance form an island.
Whether a segment continues its predecessor depends on the two alone, because a merged segment
ends where its last one does, so islands are a running sum of breaks.  Their confidences are folded in order:
each step weighs by durations that include gaps, and so is not associative.  All windows and
aggregations of this module share the partitioning by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from colloquy.functions.text import joined_content
from colloquy.schema import MergeOptions

#: Seconds of overlap, and of silence, from which neighbours are reported.
MOST_OVERLAP = 1.0
MOST_GAP = 10.0


def by_doc() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("ord")


def continues(options: MergeOptions = MergeOptions()) -> Column:
    """Whether a segment is to be merged with the one before it; false for a document's first."""
    gap = F.col("start_time") - F.lag("end_time").over(by_doc())
    return F.coalesce((F.lag("speaker").over(by_doc()) == F.col("speaker")) & (gap <= F.lit(options.time_tolerance)), F.lit(False))


def merge_flags(segments: DataFrame, options: MergeOptions = MergeOptions()) -> DataFrame:
    return segments.withColumn("continues", continues(options))


def split_pairs(segments: DataFrame, options: MergeOptions = MergeOptions()) -> DataFrame:
    """Positions of neighbours that look like one segment cut in two."""
    place = F.row_number().over(by_doc()) - 1
    flagged = segments.select("doc_id", place.cast("long").alias("second"), continues(options).alias("c")).where("c")
    return flagged.select("doc_id", (F.col("second") - 1).alias("first"), "second")


def islands(segments: DataFrame, options: MergeOptions = MergeOptions()) -> DataFrame:
    """Adds the number of each segment's island within its document, from 1."""
    breaks = F.when(F.col("continues"), 0).otherwise(1)
    running = F.sum(breaks).over(by_doc().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return merge_flags(segments, options).withColumn("island", running).drop("continues")


def merged_confidence(a: Column, b: Column) -> Column:
    """Mean by duration, within [0, 1]; the plain mean if both have none."""
    da, db = a["end_time"] - a["start_time"], b["end_time"] - b["start_time"]
    total = da + db
    weighted = (a["confidence"] * da + b["confidence"] * db) / total
    return F.when(total == 0, (a["confidence"] + b["confidence"]) / 2).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), weighted)))


def folded(members: Column) -> Column:
    """One segment from an island's, which are in order."""

    def step(done: Column, x: Column) -> Column:
        return F.struct(
            done["ord"].alias("ord"),
            done["seg_id"].alias("seg_id"),
            done["start_time"].alias("start_time"),
            x["end_time"].alias("end_time"),
            joined_content(done["content"], x["content"]).alias("content"),
            merged_confidence(done, x).alias("confidence"),
        )

    return F.aggregate(F.slice(members, 2, F.greatest(F.size(members) - 1, F.lit(0))), F.element_at(members, 1), step)


def merge_segments(segments: DataFrame, options: MergeOptions = MergeOptions()) -> DataFrame:
    """Each island as one segment; its id is the first one's, marked once for each merge, and ``n_merged`` counts them."""
    member = F.struct("ord", "seg_id", "start_time", "end_time", "content", "confidence")
    grouped = islands(segments, options).groupBy("doc_id", "island").agg(
        F.first("speaker").alias("speaker"), F.sort_array(F.collect_list(member)).alias("members")
    )
    one = grouped.withColumn("m", F.when(F.size("members") == 1, F.element_at("members", 1)).otherwise(folded(F.col("members"))))
    return one.select(
        "doc_id",
        F.col("m.ord").alias("ord"),
        F.concat(F.col("m.seg_id"), F.repeat(F.lit("_merged"), F.size("members") - 1)).alias("seg_id"),
        "speaker",
        F.col("m.start_time").alias("start_time"),
        F.col("m.end_time").alias("end_time"),
        F.col("m.content").alias("content"),
        F.col("m.confidence").alias("confidence"),
        F.size("members").alias("n_merged"),
    )


def merge_pair(a: Column, b: Column) -> Column:
    """Two segments, as structs, as one; raises if their speakers differ."""
    differ = F.concat(F.lit("speakers differ: "), a["speaker"], F.lit(" and "), b["speaker"])
    one = F.struct(
        a["ord"].alias("ord"),
        F.concat(a["seg_id"], F.lit("_merged")).alias("seg_id"),
        a["speaker"].alias("speaker"),
        a["start_time"].alias("start_time"),
        b["end_time"].alias("end_time"),
        joined_content(a["content"], b["content"]).alias("content"),
        merged_confidence(a, b).alias("confidence"),
    )
    return F.when(a["speaker"] == b["speaker"], one).otherwise(F.raise_error(differ))


def merge_stats(segments: DataFrame, options: MergeOptions = MergeOptions()) -> DataFrame:
    """One row: segments received, merged and put out, and the ratio of merges to segments."""
    flagged = merge_flags(segments, options).agg(F.count("*").alias("received"), F.count_if("continues").alias("merged"))
    ratio = F.when(F.col("received") == 0, F.lit(0.0)).otherwise(F.col("merged") / F.col("received"))
    return flagged.select("received", "merged", (F.col("received") - F.col("merged")).alias("output"), ratio.alias("merge_ratio"))


def two_decimals(x: Column) -> Column:
    """As C's ``%.2f`` up to 2^63: the exact binary value decides and a tie goes to the even digit; Java's rounds the shortest decimals, ties up."""
    whole = F.floor(x)
    cents = F.call_function("format_number", x - whole, F.lit("0.00")).cast("decimal(3,2)")
    exact = (whole.cast("decimal(20,0)") + cents).cast("string")
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x < 2.0**63, exact).otherwise(F.format_string("%.2f", x))


def continuity_errors(segments: DataFrame) -> DataFrame:
    """Overlaps and gaps between neighbours beyond the limits, with a message for each."""
    place = F.row_number().over(by_doc()) - 1
    gap = F.col("start_time") - F.lag("end_time").over(by_doc())
    found = segments.select("doc_id", place.cast("long").alias("second"), gap.alias("gap")).withColumn("first", F.col("second") - 1)
    overlap = F.format_string("Segment %d and %d have significant overlap: %ss", "first", "second", two_decimals(-F.col("gap")))
    silence = F.format_string("Large gap between segment %d and %d: %ss", "first", "second", two_decimals(F.col("gap")))
    message = F.when(F.col("gap") < -MOST_OVERLAP, overlap).when(F.col("gap") > MOST_GAP, silence)
    return found.select("doc_id", "first", "second", message.alias("message")).where("message is not null")
