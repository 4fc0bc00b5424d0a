"""Segments, texts and lookup tables derived from the test tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions.text import strip
from colloquy.operators.parse import with_clock
from colloquy.schema import SPEAKER, MergeOptions
from colloquy.sources.scratch import scratch

#: Events of a user count as one segment up to six hours apart.
EVENT_MERGE = MergeOptions(time_tolerance=21600.0)

SPEAKERS = [
    (0, "s1", "Customer", ["user", "caller"]),
    (1, "s2", "Agent", ["assistant", "user"]),
    (2, "s3", "system", []),
    (3, "s1", "Late entry", ["late"]),
]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_id(df: DataFrame) -> DataFrame:
    return df.withColumn("seg_id", F.concat(F.lit("seg_"), F.col("doc_id").cast("string"), F.lit("_"), F.col("ord").cast("string")))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment for each turn of a conversation."""
    turns = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.col("role").alias("speaker"), F.col("text").alias("content"))
    return _with_id(with_clock(turns).withColumn("confidence", F.lit(1.0)))


def subsegments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment for each line of a turn that isn't blank."""
    lines = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.col("role").alias("speaker"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select("doc_id", (F.col("turn") * 100000 + F.col("pos")).alias("ord"), "speaker", strip(F.col("line")).alias("content")).where("content <> ''")
    return _with_id(with_clock(lines).withColumn("confidence", (F.length("content") % 10 + 1) / F.lit(10.0)))


def event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment for each event, in wall-clock seconds, with gaps and overlaps."""
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    start = ts / F.lit(1e6)
    found = load(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), ts.alias("ord"), F.col("event_type").alias("speaker"), start.alias("start_time"), (start + F.col("value") + 1).alias("end_time"),
        F.col("event_type").alias("content"), F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"),
    )
    return _with_id(found)


def raw_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as texts of labelled turns."""
    turns = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.struct("turn", F.concat_ws(": ", "role", "text").alias("line")).alias("t"))
    return turns.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["line"]), "\n").alias("text"))


def labelled_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file of labelled turns for each conversation, under a folder named by its id."""
    folder = scratch(spark, "files") + "/[labelled] 100%"
    raw_labelled(spark, sf_dir).select("doc_id", "text").write.partitionBy("doc_id").text(folder)
    return folder


def doc_id_of(path: str) -> Column:
    return F.regexp_extract(path, r"/doc_id=(\d+)/", 1).cast("long")


def raw_timestamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as texts of timestamped turns, ten seconds apart."""
    s = F.col("turn") * 10
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    stamp = F.concat(F.lit("["), two(F.floor(s / 3600)), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60), F.lit("] "))
    turns = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.struct("turn", F.concat(stamp, F.col("role"), F.lit(": "), F.col("text")).alias("line")).alias("t"))
    return turns.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["line"]), "\n").alias("text"))


def raw_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without labels; every third line is followed by a blank one."""
    lines = F.split("text", "\n")
    spaced = F.transform(lines, lambda x, i: F.when(i % 3 == 2, F.concat(x, F.lit("\n"))).otherwise(x))
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(spaced, "\n").alias("text"))


def speakers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SPEAKERS, SPEAKER)


def first_ranked(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")


SEG = """
seg0 AS (SELECT conv_id AS doc_id, turn AS ord, role AS speaker, text AS content, 1.0::DOUBLE AS confidence,
                sum(greatest(0.5::DOUBLE, length(text) / 750.0::DOUBLE * 60.0::DOUBLE)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS end_time FROM conversations),
seg AS (SELECT *, coalesce(lag(end_time) OVER (PARTITION BY doc_id ORDER BY ord), 0.0::DOUBLE) AS start_time, 'seg_' || doc_id || '_' || ord AS seg_id FROM seg0)"""

SUB = """
sub0 AS (SELECT conv_id AS doc_id, turn, role AS speaker, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM conversations),
sub1 AS (SELECT doc_id, turn * 100000 + pos AS ord, speaker, trim(line, ' ' || chr(9) || chr(13)) AS content FROM sub0),
sub2 AS (SELECT *, (length(content) % 10 + 1) / 10.0::DOUBLE AS confidence,
                sum(greatest(0.5::DOUBLE, length(content) / 750.0::DOUBLE * 60.0::DOUBLE)) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS end_time FROM sub1 WHERE content <> ''),
sub AS (SELECT *, coalesce(lag(end_time) OVER (PARTITION BY doc_id ORDER BY ord), 0.0::DOUBLE) AS start_time, 'seg_' || doc_id || '_' || ord AS seg_id FROM sub2)"""

EV = """
ev AS (SELECT user_id AS doc_id, epoch_us(ts) AS ord, event_type AS speaker, epoch_us(ts) / 1e6::DOUBLE AS start_time, epoch_us(ts) / 1e6::DOUBLE + value + 1 AS end_time,
              event_type AS content, least(1.0::DOUBLE, value / 100) AS confidence, 'seg_' || user_id || '_' || epoch_us(ts) AS seg_id FROM events)"""


def flagged(table: str, tolerance: float) -> str:
    return f"""
{table}_f AS (SELECT *, coalesce(lag(speaker) OVER w = speaker AND start_time - lag(end_time) OVER w <= {tolerance}::DOUBLE, false) AS continues FROM {table} WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
{table}_i AS (SELECT *, sum(CASE WHEN continues THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM {table}_f)"""


SPEAKER_SQL = """
dim(ord, id, name, aliases) AS (VALUES (0, 's1', 'Customer', ['user', 'caller']), (1, 's2', 'Agent', ['assistant', 'user']), (2, 's3', 'system', []::VARCHAR[]), (3, 's1', 'Late entry', ['late']))"""
