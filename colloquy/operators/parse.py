"""Texts to segments: labelled turns, timestamped entries, and paragraphs.

A text is parsed whole.  Turns are found by one regular expression in the JVM and exploded with
their positions; the clock is a running sum over the document.  The expressions look for labels only
where a text has a colon at all, since looking for one is quadratic in a line without.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import SPACE, clock_seconds, estimated_seconds, strip
from colloquy.schema import DEFAULT_CONFIDENCE, DEFAULT_SPEAKER

# The formats of labelled turns and of timestamped entries.
TURN = r"([^\n:]+?):\s*(.+?)(?=\n[^\n:]+:|\n\n|\z)"
LABELLED = f"(?s){TURN}"
TIMESTAMPED = r"(?s)[\[\(]?(?:(\d{1,2}):)?(\d{1,2}):(\d{2})[\]\)]?\s*(?:([^\n:]+?):\s*)?(.+?)(?=[\[\(]?\d{1,2}:|\n\n|\z)"


def _groups(text: Column, pattern: str, n: int) -> Column:
    """All matches as structs g1..gn; an empty array where the text has no colon or is null."""
    found = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(f"g{i}") for i in range(1, n + 1)))
    empty = F.array().cast("array<struct<" + ",".join(f"g{i}:string" for i in range(1, n + 1)) + ">>")
    return F.when(F.instr(text, ":") > 0, found).otherwise(empty)


def paragraphs(text: Column) -> Column:
    """Paragraphs as an array: blocks between blank lines, cut by one expression over the whole text.

    Splitting at blank lines first keeps the work linear in the text's length.
    """
    blocks = F.split(text, f"\\n(?:[{SPACE}&&[^\\n]]*\\n)+")
    joined = F.transform(blocks, lambda b: F.array_join(F.filter(F.transform(F.split(b, "\n"), strip), lambda x: x != ""), " "))
    return F.filter(joined, lambda p: p != "")


def _identified(turns: DataFrame) -> DataFrame:
    """Adds a segment id that depends on the document and the position only."""
    return turns.withColumn("seg_id", F.concat(F.lit("seg_"), F.substring(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("ord").cast("string")), 256), 1, 8)))


def with_clock(turns: DataFrame) -> DataFrame:
    """Adds start and end times: each segment begins as the one before it ends and lasts as long as it takes to say."""
    order = Window.partitionBy("doc_id").orderBy("ord")
    ends = F.sum(estimated_seconds(F.col("content"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    timed = turns.withColumn("end_time", ends)
    return timed.withColumn("start_time", F.coalesce(F.lag("end_time").over(order), F.lit(0.0)))


def _finished(turns: DataFrame, confidence: float) -> DataFrame:
    return _identified(turns).withColumn("confidence", F.lit(float(confidence))).select("doc_id", "ord", "seg_id", "speaker", "start_time", "end_time", "content", "confidence")


def _labelled_turns(texts: DataFrame, default_speaker: str) -> DataFrame:
    text = F.col("text")
    found = texts.select("doc_id", _groups(text, LABELLED, 2).alias("m"), "text")
    plain = F.transform(paragraphs(text), lambda p: F.struct(F.lit("").alias("g1"), p.alias("g2")))
    turns = found.select("doc_id", F.posexplode(F.when(F.size("m") > 0, F.col("m")).otherwise(plain)).alias("pos", "m"))
    turns = turns.select("doc_id", "pos", strip(F.col("m.g1")).alias("speaker"), strip(F.col("m.g2")).alias("content")).where("content <> ''")
    ord_ = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    speaker = F.when(F.col("speaker") == "", F.lit(default_speaker)).otherwise(F.col("speaker"))
    return turns.select("doc_id", ord_.cast("long").alias("ord"), speaker.alias("speaker"), "content")


def parse_labelled(texts: DataFrame, *, default_speaker: str = DEFAULT_SPEAKER, default_confidence: float = DEFAULT_CONFIDENCE) -> DataFrame:
    """Segments of ``texts`` (doc_id, text): labelled turns, or paragraphs where no label is found.

    Once a text has a label, what stands outside labelled turns is dropped.
    """
    return _finished(with_clock(_labelled_turns(texts.select("doc_id", "text"), default_speaker)), default_confidence)


def parse_paragraphs(texts: DataFrame, *, default_speaker: str = DEFAULT_SPEAKER, default_confidence: float = DEFAULT_CONFIDENCE) -> DataFrame:
    """Segments of ``texts``, one for each paragraph, whatever colons they have."""
    turns = texts.select("doc_id", F.posexplode(paragraphs(F.col("text"))).alias("ord", "content"))
    turns = turns.select("doc_id", F.col("ord").cast("long").alias("ord"), F.lit(default_speaker).alias("speaker"), "content")
    return _finished(with_clock(turns), default_confidence)


def parse_timestamped(texts: DataFrame, *, default_speaker: str = DEFAULT_SPEAKER, default_confidence: float = DEFAULT_CONFIDENCE) -> DataFrame:
    """Segments of ``texts`` whose entries carry their start times; an entry ends as the next begins.

    The last one lasts as long as it takes to say.  Texts without such an entry are parsed as labelled.
    """
    texts = texts.select("doc_id", "text").withColumn("m", _groups(F.col("text"), TIMESTAMPED, 5))
    entries = texts.where(F.size("m") > 0).select("doc_id", F.posexplode("m").alias("ord", "m"))
    entries = entries.select(
        "doc_id",
        F.col("ord").cast("long").alias("ord"),
        F.when(strip(F.col("m.g4")) == "", F.lit(default_speaker)).otherwise(strip(F.col("m.g4"))).alias("speaker"),
        strip(F.col("m.g5")).alias("content"),
        clock_seconds(F.col("m.g1"), F.col("m.g2"), F.col("m.g3")).cast("double").alias("start_time"),
    )
    following = F.lead("start_time").over(Window.partitionBy("doc_id").orderBy("ord"))
    entries = entries.withColumn("end_time", F.coalesce(following, F.col("start_time") + estimated_seconds(F.col("content"))))
    others = texts.where(F.coalesce(F.size("m"), F.lit(0)) <= 0).select("doc_id", "text")
    labelled = parse_labelled(others, default_speaker=default_speaker, default_confidence=default_confidence)
    return _finished(entries, default_confidence).unionByName(labelled)
