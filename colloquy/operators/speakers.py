"""Speakers' names and aliases, analysis periods and evidence: the lookups.

The speakers come from a configuration file, so their table is small by nature; joins leave it to the
planner, which broadcasts a side whose size it knows to be below the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def aliases(speakers: DataFrame) -> DataFrame:
    """(name, id, canonical): each name or alias once, for the first speaker in order who has it."""
    names = speakers.select("ord", "id", F.col("name").alias("canonical"), F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("name"))
    first = names.groupBy("name").agg(F.min(F.struct("ord", "id", "canonical")).alias("x"))
    return first.select("name", F.col("x.id").alias("id"), F.col("x.canonical").alias("canonical"))


def resolve(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """Adds speaker_id and canonical name; null for a name that no speaker has."""
    known = aliases(speakers).select(F.col("name").alias("speaker"), F.col("id").alias("speaker_id"), F.col("canonical").alias("canonical_name"))
    return segments.join(known, "speaker", "left")


def by_id(speakers: DataFrame, ids: DataFrame) -> DataFrame:
    """The first speaker in order with each id of ``ids``; null where there is none."""
    return ids.join(first_of_id(speakers), "id", "left")


def first_of_id(speakers: DataFrame) -> DataFrame:
    """Speakers without those whose id an earlier one has."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy("ord"))
    return speakers.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def add_speakers(speakers: DataFrame, new: DataFrame) -> DataFrame:
    """``speakers`` and those of ``new`` whose id it lacks."""
    return speakers.unionByName(first_of_id(new).join(speakers.select("id"), "id", "left_anti"))


def has_alias(name: str) -> Column:
    return F.coalesce(F.array_contains("aliases", name), F.lit(False)) | (F.col("name") == name)


def in_period(ts: Column, start: str, end: str) -> Column:
    """From the start's midnight to the end's: later times of the last day lie outside."""
    return ts.between(F.lit(start).cast("date").cast("timestamp"), F.lit(end).cast("date").cast("timestamp"))


def with_context(segments: DataFrame) -> DataFrame:
    """Adds the contents of the segments before and after, empty at a document's ends."""
    order = Window.partitionBy("doc_id").orderBy("ord")
    around = lambda f: F.coalesce(f("content").over(order), F.lit(""))
    return segments.withColumns({"context_before": around(F.lag), "context_after": around(F.lead)})


def evidence_segments(evidence: DataFrame, segments: DataFrame) -> DataFrame:
    """A row for each segment that evidence names."""
    wanted = evidence.select("id", F.col("transcript_id").alias("doc_id"), "importance", F.explode("segment_ids").alias("seg_id"))
    return wanted.join(segments, ["doc_id", "seg_id"])
