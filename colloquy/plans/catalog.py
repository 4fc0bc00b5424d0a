"""The library's registered queries and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from colloquy.functions import text as fn
from colloquy.operators import merge, parse, speakers, transcripts
from colloquy.plans import batch
from colloquy.plans import inputs as data
from colloquy.plans.inputs import EV, EVENT_MERGE, SEG, SPEAKER_SQL, SUB, flagged
from colloquy.schema import SEGMENT
from colloquy.sources import discovery, reader
from colloquy.streaming import incremental, parsing

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


@query(f"""WITH {SEG} SELECT doc_id, ord, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, round(end_time - start_time, 6) AS duration FROM seg""")
def segment_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.with_duration(data.segments(spark, sf_dir)).select("doc_id", "ord", r6("start_time"), r6("end_time"), r6("duration"))


@query("SELECT conv_id AS doc_id, turn AS ord, text AS content FROM conversations WHERE role = 'assistant'")
def segments_by_speaker(spark, sf_dir):
    return transcripts.by_speaker(data.segments(spark, sf_dir), "assistant").select("doc_id", "ord", "content")


@query(f"WITH {SEG} SELECT doc_id, ord, round(start_time, 6) AS start_time FROM seg WHERE start_time < 60 AND end_time > 10")
def segments_in_range(spark, sf_dir):
    return transcripts.in_range(data.segments(spark, sf_dir), 10, 60).select("doc_id", "ord", r6("start_time"))


@query(f"""WITH {SEG}, r(range_id, range_start, range_end) AS (VALUES (1, 0.0::DOUBLE, 15.0::DOUBLE), (2, 10.0, 200.0), (3, 150.0, 150.5), (4, 1000.0, 5000.0))
SELECT range_id, doc_id, ord FROM seg JOIN r ON start_time < range_end AND end_time > range_start""")
def range_join_probe(spark, sf_dir):
    ranges = spark.createDataFrame([(1, 0.0, 15.0), (2, 10.0, 200.0), (3, 150.0, 150.5), (4, 1000.0, 5000.0)], "range_id int, range_start double, range_end double")
    return transcripts.in_ranges(data.segments(spark, sf_dir), ranges).select("range_id", "doc_id", "ord")


@query(f"WITH {SEG} SELECT doc_id, round(max(end_time) / 60, 6) AS minutes, round(max(end_time) / 3600, 6) AS hours FROM seg GROUP BY doc_id")
def transcript_minutes_hours(spark, sf_dir):
    return transcripts.minutes_and_hours(transcripts.summaries(data.segments(spark, sf_dir))).select("doc_id", r6("minutes"), r6("hours"))


@query(f"WITH {SEG} SELECT doc_id, speaker, round(sum(end_time - start_time), 6) AS total_duration, count(*) AS segment_count FROM seg GROUP BY doc_id, speaker")
def speaker_stats(spark, sf_dir):
    return transcripts.speaker_stats(data.segments(spark, sf_dir), "doc_id").select("doc_id", "speaker", r6("total_duration"), "segment_count")


@query("SELECT conv_id AS doc_id, count(*) AS segment_count, count(DISTINCT role) AS speaker_count FROM conversations GROUP BY conv_id")
def transcript_counts(spark, sf_dir):
    return transcripts.counts(data.segments(spark, sf_dir))


@query("""SELECT doc_id, string_agg(speaker, ',' ORDER BY ord) AS speakers FROM (SELECT conv_id AS doc_id, role AS speaker, min(turn) AS ord FROM conversations GROUP BY ALL) GROUP BY doc_id""")
def speakers_first_seen(spark, sf_dir):
    return transcripts.speakers_first_seen(data.segments(spark, sf_dir)).select("doc_id", F.array_join("speakers", ",").alias("speakers"))


SUMMARY_SQL = f"""WITH {SUB}, {flagged("sub", 0.5)},
isl AS (SELECT doc_id, island, any_value(speaker) AS speaker, max(end_time) AS e FROM sub_i GROUP BY doc_id, island)
SELECT doc_id, round(max(e), 6) AS duration_seconds, array_to_string(list_sort(list(DISTINCT speaker)), ',') AS speakers, count(*) AS segment_count FROM isl GROUP BY doc_id"""


@query(SUMMARY_SQL)
def transcript_summary(spark, sf_dir):
    found = transcripts.summaries(merge.merge_segments(data.subsegments(spark, sf_dir)))
    return found.select("doc_id", r6("duration_seconds"), F.array_join("speakers", ",").alias("speakers"), "segment_count")


@query(f"WITH {SUB}, {flagged('sub', 0.5)} SELECT doc_id, ord, continues FROM sub_f")
def should_merge_flags(spark, sf_dir):
    return merge.merge_flags(data.subsegments(spark, sf_dir)).select("doc_id", "ord", "continues")


@query(f"""WITH {SUB}, {flagged('sub', 0.5)}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS i FROM sub_f)
SELECT doc_id, (i - 1)::BIGINT AS first, i::BIGINT AS second FROM n WHERE continues""")
def split_pairs(spark, sf_dir):
    return merge.split_pairs(data.subsegments(spark, sf_dir))


@query(f"""WITH {EV}, {flagged('ev', 21600.0)} SELECT doc_id, island, any_value(speaker) AS speaker, round(min(start_time), 6) AS start_time, count(*) AS n FROM ev_i GROUP BY doc_id, island""")
def merge_islands(spark, sf_dir):
    found = merge.islands(data.event_segments(spark, sf_dir), EVENT_MERGE)
    return found.groupBy("doc_id", "island").agg(F.first("speaker").alias("speaker"), F.round(F.min("start_time"), 6).alias("start_time"), F.count("*").alias("n"))


@query(f"""WITH {EV}, {flagged('ev', 21600.0)},
l AS (SELECT doc_id, island, list({{'s': start_time, 'e': end_time, 'c': confidence, 'w': end_time - start_time}} ORDER BY ord) AS xs, min(ord) AS ord FROM ev_i GROUP BY doc_id, island),
f AS (SELECT doc_id, ord, list_reduce(xs, lambda x, y: {{'s': x.s, 'e': y.e, 'c': CASE WHEN x.w + y.w = 0 THEN (x.c + y.c) / 2 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (x.c * x.w + y.c * y.w) / (x.w + y.w))) END, 'w': y.e - x.s}}) AS m, len(xs) AS n FROM l)
SELECT doc_id, ord, round(m.s, 6) AS start_time, round(m.e, 6) AS end_time, round(m.c, 6) AS confidence, n::INTEGER AS n_merged FROM f""")
def merge_confidence_fold(spark, sf_dir):
    return merge.merge_segments(data.event_segments(spark, sf_dir), EVENT_MERGE).select("doc_id", "ord", r6("start_time"), r6("end_time"), r6("confidence"), "n_merged")


@query(f"""WITH {SUB}, {flagged('sub', 0.5)},
l AS (SELECT doc_id, island, min(ord) AS ord, list(content ORDER BY ord) AS xs FROM sub_i GROUP BY doc_id, island)
SELECT doc_id, ord, list_reduce(xs, lambda x, y: CASE WHEN regexp_matches(right(x, 1), '^[a-z]$') AND regexp_matches(left(y, 1), '^[a-z]$') THEN x || y
  WHEN regexp_matches(right(x, 1), '^[\\x{{AC00}}-\\x{{D7A3}}\\x{{1100}}-\\x{{11FF}}\\x{{3130}}-\\x{{318F}}]$') AND regexp_matches(left(y, 1), '^[\\x{{AC00}}-\\x{{D7A3}}\\x{{1100}}-\\x{{11FF}}\\x{{3130}}-\\x{{318F}}]$') THEN x || y
  ELSE x || ' ' || y END) AS content FROM l""")
def merge_content(spark, sf_dir):
    return merge.merge_segments(data.subsegments(spark, sf_dir)).select("doc_id", "ord", "content")


@query(f"""WITH {SUB}, {flagged('sub', 0.5)} SELECT doc_id, min(ord) AS ord, arg_min(seg_id, ord) || repeat('_merged', (count(*) - 1)::INTEGER) AS seg_id FROM sub_i GROUP BY doc_id, island""")
def merged_ids(spark, sf_dir):
    return merge.merge_segments(data.subsegments(spark, sf_dir)).select("doc_id", "ord", "seg_id")


@query(f"""WITH {EV}, {flagged('ev', 21600.0)} SELECT count(*) AS received, count(*) FILTER (continues) AS merged, count(*) FILTER (NOT continues) AS output,
round(count(*) FILTER (continues) / count(*)::DOUBLE, 6) AS merge_ratio FROM ev_f""")
def merge_stats(spark, sf_dir):
    return merge.merge_stats(data.event_segments(spark, sf_dir), EVENT_MERGE).withColumn("merge_ratio", F.round("merge_ratio", 6))


@query(f"""WITH {EV}, g AS (SELECT doc_id, row_number() OVER w - 1 AS i, start_time - lag(end_time) OVER w AS gap FROM ev WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
SELECT doc_id, (i - 1)::BIGINT AS first, i::BIGINT AS second,
  CASE WHEN gap < -1 THEN printf('Segment %d and %d have significant overlap: %.2fs', i - 1, i, -gap) ELSE printf('Large gap between segment %d and %d: %.2fs', i - 1, i, gap) END AS message
FROM g WHERE gap < -1 OR gap > 10""")
def continuity_errors(spark, sf_dir):
    return merge.continuity_errors(data.event_segments(spark, sf_dir))


@query("SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS ord, role AS speaker, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS content FROM conversations")
def parse_labelled(spark, sf_dir):
    return parse.parse_labelled(data.raw_labelled(spark, sf_dir)).select("doc_id", "ord", "speaker", "content")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
s AS (SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13)) AS line, pos // 3 AS g FROM l),
b AS (SELECT *, g + sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) * 1000000 AS k FROM s),
p AS (SELECT doc_id, min(pos) AS pos, string_agg(line, ' ' ORDER BY pos) AS content FROM b WHERE line <> '' GROUP BY doc_id, k)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::BIGINT AS ord, content FROM p""")
def parse_paragraphs(spark, sf_dir):
    return parse.parse_paragraphs(data.raw_plain(spark, sf_dir)).select("doc_id", "ord", "content")


@query("""WITH t AS (SELECT conv_id AS doc_id, (row_number() OVER w - 1)::BIGINT AS ord, role AS speaker, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS content, turn * 10.0::DOUBLE AS start_time, lead(turn * 10.0::DOUBLE) OVER w AS next
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT doc_id, ord, speaker, content, start_time, round(coalesce(next, start_time + greatest(0.5::DOUBLE, length(content) / 750.0::DOUBLE * 60.0::DOUBLE)), 6) AS end_time FROM t""")
def parse_timestamped(spark, sf_dir):
    return parse.parse_timestamped(data.raw_timestamped(spark, sf_dir)).select("doc_id", "ord", "speaker", "content", "start_time", r6("end_time"))


BAD_SQL = f"""{EV}, bad AS (SELECT doc_id, ord, CASE WHEN ord % 7 = 0 THEN -start_time ELSE start_time END AS start_time, end_time, CASE WHEN ord % 11 = 0 THEN confidence + 1 ELSE confidence END AS confidence FROM ev)"""


def _bad(spark, sf_dir):
    found = data.event_segments(spark, sf_dir)
    start = F.when(F.col("ord") % 7 == 0, -F.col("start_time")).otherwise(F.col("start_time"))
    return found.withColumns({"start_time": start, "confidence": F.when(F.col("ord") % 11 == 0, F.col("confidence") + 1).otherwise(F.col("confidence"))})


@query(f"""WITH {BAD_SQL} SELECT doc_id, ord, concat_ws(',', CASE WHEN start_time < 0 THEN 'start_negative' END, CASE WHEN end_time <= 0 THEN 'end_not_positive' END,
  CASE WHEN end_time <= start_time THEN 'end_before_start' END, CASE WHEN NOT confidence BETWEEN 0 AND 1 THEN 'confidence_out_of_range' END) AS violations FROM bad
WHERE start_time < 0 OR end_time <= 0 OR end_time <= start_time OR NOT confidence BETWEEN 0 AND 1""")
def quality_violations(spark, sf_dir):
    return transcripts.violations(_bad(spark, sf_dir)).select("doc_id", "ord", F.array_join("violations", ",").alias("violations"))


ALIAS_SQL = f"""{SPEAKER_SQL}, al AS (SELECT ord, id, name AS canonical, unnest(list_distinct(list_prepend(name, aliases))) AS name FROM dim),
known AS (SELECT name, arg_min(id, ord) AS id, arg_min(canonical, ord) AS canonical FROM al GROUP BY name)"""


@query(f"WITH {ALIAS_SQL} SELECT conv_id AS doc_id, turn AS ord, role AS speaker, id AS speaker_id, canonical AS canonical_name FROM conversations LEFT JOIN known ON role = name")
def alias_resolution(spark, sf_dir):
    return speakers.resolve(data.segments(spark, sf_dir), data.speakers(spark)).select("doc_id", "ord", "speaker", "speaker_id", "canonical_name")


@query(f"""WITH {SPEAKER_SQL}, d AS (SELECT id, arg_min(name, ord) AS name FROM dim GROUP BY id), ids(id) AS (VALUES ('s1'), ('s2'), ('s9')) SELECT id, name FROM ids LEFT JOIN d USING (id)""")
def speaker_by_id(spark, sf_dir):
    return speakers.by_id(data.speakers(spark), spark.createDataFrame([("s1",), ("s2",), ("s9",)], "id string")).select("id", "name")


@query(f"WITH {SPEAKER_SQL} SELECT id, arg_min(name, ord) AS name, min(ord) AS ord FROM dim GROUP BY id")
def speaker_dedupe(spark, sf_dir):
    dim = data.speakers(spark)
    return speakers.add_speakers(speakers.first_of_id(dim), dim).select("id", "name", "ord")


@query("""SELECT count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'""")
def analysis_period(spark, sf_dir):
    inside = data.load(spark, sf_dir, "events").where(speakers.in_period(F.col("ts").cast("timestamp"), "2024-01-05", "2024-01-20"))
    return inside.agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query(f"""WITH {SEG}, c AS (SELECT *, coalesce(lag(content) OVER w, '') AS context_before, coalesce(lead(content) OVER w, '') AS context_after FROM seg WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
SELECT seg_id, CASE WHEN length(content) > 200 THEN 'HIGH' ELSE 'MEDIUM' END AS importance, context_before, context_after FROM c WHERE content LIKE '%the%' AND length(content) > 200""")
def evidence_context(spark, sf_dir):
    found = speakers.with_context(data.segments(spark, sf_dir))
    hits = found.where(F.col("content").contains("the"))
    evidence = hits.select(F.concat(F.lit("ev_"), "seg_id").alias("id"), F.col("doc_id").alias("transcript_id"), F.array("seg_id").alias("segment_ids"), F.when(F.length("content") > 200, "HIGH").otherwise("MEDIUM").alias("importance"))
    high = transcripts.of_importance(evidence, "HIGH")
    return speakers.evidence_segments(high, found).select("seg_id", "importance", "context_before", "context_after")


WORD_PAIRS = [("Hel", "lo"), ("Hello", "World"), ("안녕하", "세요"), ("Hello!", "World"), ("a", "B"), ("ᄀ", "힣"), ("é", "a"), ("x", "")]


@query("""WITH p(a, b) AS (VALUES ('Hel', 'lo'), ('Hello', 'World'), ('안녕하', '세요'), ('Hello!', 'World'), ('a', 'B'), ('ᄀ', '힣'), ('é', 'a'), ('x', ''))
SELECT a, b, (regexp_matches(right(a, 1), '^[a-z]$') AND regexp_matches(left(b, 1), '^[a-z]$')) OR (regexp_matches(right(a, 1), '^[\\x{AC00}-\\x{D7A3}\\x{1100}-\\x{11FF}\\x{3130}-\\x{318F}]$') AND regexp_matches(left(b, 1), '^[\\x{AC00}-\\x{D7A3}\\x{1100}-\\x{11FF}\\x{3130}-\\x{318F}]$')) AS splits FROM p""")
def word_split_boundary(spark, sf_dir):
    return spark.createDataFrame(WORD_PAIRS, "a string, b string").select("a", "b", fn.splits_word(F.col("a"), F.col("b")).alias("splits"))


@query("""SELECT doc_id, regexp_matches(text || CASE WHEN doc_id % 3 = 0 THEN '가' ELSE '' END, '[\\x{AC00}-\\x{D7A3}\\x{1100}-\\x{11FF}\\x{3130}-\\x{318F}]') AS hangul FROM documents""")
def hangul_flag(spark, sf_dir):
    text = F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.lit("가")).otherwise(F.lit("")))
    return data.load(spark, sf_dir, "documents").select("doc_id", fn.has_hangul(text).alias("hangul"))


BYTES = ["48656C6C6F", "48656C6C6FC3", "54657374EAB0", "486920F09F98", "EAB080", "FF", "C3A9", ""]


@query("""SELECT * FROM (VALUES ('48656C6C6F', true, 1, 5), ('48656C6C6FC3', false, 1, 5), ('54657374EAB0', false, 1, 4), ('486920F09F98', false, 1, 3), ('EAB080', true, 3, 3), ('FF', false, 0, 1), ('C3A9', true, 2, 2), ('', true, 0, 0)) t(bytes, valid, lead_length, complete)""")
def utf8_validity(spark, sf_dir):
    raw = F.unhex("bytes")
    lead = F.when(F.octet_length(raw) > 0, fn.utf8_length(fn.byte_at(raw, 1))).otherwise(F.lit(0))
    return spark.createDataFrame([(b,) for b in BYTES], "bytes string").select("bytes", fn.is_valid_utf8(raw).alias("valid"), lead.alias("lead_length"), F.coalesce(fn.complete_bytes(raw), F.lit(0)).alias("complete"))


@query(f"""WITH {SEG}, t AS (SELECT doc_id, count(*) AS n, max(end_time) AS e FROM (SELECT *, sum(CASE WHEN speaker = p THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM (SELECT *, lag(speaker) OVER (PARTITION BY doc_id ORDER BY ord) AS p FROM seg)) WHERE p IS NULL OR p <> speaker GROUP BY doc_id),
d AS (SELECT DISTINCT conv_id AS doc_id FROM conversations), e AS (SELECT doc_id, max(end_time) AS e FROM seg GROUP BY doc_id)
SELECT count(*) AS total_files, count(*) FILTER (doc_id % 10 <> 0) AS successful_files, count(*) FILTER (doc_id % 10 = 0) AS failed_files, round(count(*) FILTER (doc_id % 10 <> 0) / count(*)::DOUBLE, 6) AS success_rate,
  (sum(t.n) FILTER (doc_id % 10 <> 0))::BIGINT AS total_segments, count(*) FILTER (doc_id % 10 = 0) AS n_errors FROM d JOIN t USING (doc_id) JOIN e USING (doc_id)""")
def batch_summary(spark, sf_dir):
    texts = data.raw_labelled(spark, sf_dir).withColumn("error", F.when(F.col("doc_id") % 10 == 0, F.lit("injected")))
    found = batch.summary(batch.process_texts(texts))
    return found.select("total_files", "successful_files", "failed_files", F.round("success_rate", 6).alias("success_rate"), "total_segments", F.col("failed_files").alias("n_errors"))


def _paths(spark, sf_dir):
    pages = data.load(spark, sf_dir, "pages")
    path = F.regexp_extract("url", "^[^?#]*", 0)
    return pages.select(path.alias("path"), F.length("html").cast("long").alias("length"), F.timestamp_seconds(F.col("page_id")).alias("modificationTime"))


EXT_SQL = "coalesce(nullif(lower(regexp_extract(regexp_extract(url, '^[^?#]*'), '[^/](\\.[^./]+)$', 1)), ''), '(no extension)')"


@query(f"SELECT {EXT_SQL} AS extension, count(*) AS n FROM pages GROUP BY 1")
def ext_counts(spark, sf_dir):
    return discovery.count_by_extension(_paths(spark, sf_dir))


@query("SELECT sum(length(html))::BIGINT AS total_size FROM pages")
def total_size(spark, sf_dir):
    return discovery.total_size(_paths(spark, sf_dir))


ORDER_SQL = {
    "NAME": "name, path, length",
    "NAME_DESC": "name DESC, path, length",
    "SIZE": "length, path",
    "SIZE_DESC": "length DESC, path",
    "DATE": "modified, path, length",
    "DATE_DESC": "modified DESC, path, length",
}


@query(f"""WITH f AS (SELECT regexp_extract(url, '^[^?#]*') AS path, length(html) AS length, page_id AS modified, {EXT_SQL} AS ext FROM pages),
n AS (SELECT *, lower(list_last(string_split(path, '/'))) AS name FROM f WHERE length BETWEEN 1000 AND 9000 AND ext = '.html')
SELECT o AS "order", path, length::BIGINT AS length FROM ("""
    + " UNION ALL ".join(f"SELECT '{k}' AS o, path, length, row_number() OVER (ORDER BY {v}) AS r FROM n" for k, v in ORDER_SQL.items())
    + ") WHERE r <= 10")
def file_sort(spark, sf_dir):
    """The first ten files by each order."""
    where = discovery.FileFilter(pattern="*", min_size=1000, max_size=9000, extensions=(".HTML",))
    files = _paths(spark, sf_dir).where(where.condition())
    found = [discovery.ordered(files, order).limit(10).select(F.lit(order.name).alias("order"), "path", "length") for order in discovery.SortOrder]
    return reduce(DataFrame.unionByName, found)


RAW_SQL = "raw AS (SELECT conv_id AS doc_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) || chr(10) AS text FROM conversations GROUP BY conv_id)"


@query(f"WITH {RAW_SQL} SELECT doc_id, strlen(text)::BIGINT AS length FROM raw WHERE strlen(text) >= 500")
def directory_files(spark, sf_dir):
    """Files of a folder, by Spark's listing and by the driver's, which agree."""
    folder, where = data.labelled_files(spark, sf_dir), discovery.FileFilter(recursive=True, min_size=500)
    scanned, listed = (find(spark, folder, where).select(data.doc_id_of("path").alias("doc_id"), "length") for find in (discovery.scan, discovery.find_files))
    return scanned.intersectAll(listed)


@query(f"""WITH {SEG} SELECT doc_id, round(max(end_time), 6) AS duration_seconds, array_to_string(list_sort(list(DISTINCT speaker)), ',') AS speakers,
(SELECT count(*) FROM (SELECT doc_id AS d, speaker, lag(speaker) OVER (PARTITION BY doc_id ORDER BY ord) AS p FROM seg) x WHERE x.d = seg.doc_id AND (p IS NULL OR p <> speaker)) AS segment_count FROM seg GROUP BY doc_id""")
def directory_transcripts(spark, sf_dir):
    """Files of a folder to transcripts."""
    found = batch.process_directory(spark, data.labelled_files(spark, sf_dir), recursive=True).transcripts
    return found.select(data.doc_id_of("doc_id").alias("doc_id"), r6("duration_seconds"), F.array_join("speakers", ",").alias("speakers"), "segment_count")


@query(f"""WITH {RAW_SQL} SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE strlen(text)::BIGINT END AS length, doc_id % 5 = 0 AS failed FROM raw""")
def files_by_path(spark, sf_dir):
    """Files by their paths; every fifth path is wrong and becomes an error row."""
    folder = data.labelled_files(spark, sf_dir)
    files = discovery.scan(spark, folder, discovery.FileFilter(recursive=True)).withColumn("doc", data.doc_id_of("path"))
    files = files.select(F.when(F.col("doc") % 5 == 0, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("path"), "length")
    found = batch.process_files(spark, files)
    texts = found.texts.select("doc_id", F.when(F.col("error").isNull(), F.octet_length("text").cast("long")).alias("length"))
    return texts.join(found.status, "doc_id").select(data.doc_id_of("doc_id").alias("doc_id"), "length", F.col("error").isNotNull().alias("failed"))


@query("""SELECT conv_id AS doc_id, turn AS ord, CASE turn % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-8-sig' WHEN 2 THEN 'utf-16-le' ELSE 'utf-16-be' END AS encoding,
CASE WHEN turn % 4 >= 2 THEN chr(65279) ELSE '' END || text AS text FROM conversations""")
def decoded_by_mark(spark, sf_dir):
    """Texts in four encodings, told by their byte order marks."""
    kind, marked = F.col("turn") % 4, F.concat(F.lit("\ufeff"), F.col("text"))
    encode = lambda text, name: F.encode(text, name)
    content = F.when(kind == 0, encode("text", "UTF-8")).when(kind == 1, encode(marked, "UTF-8")).when(kind == 2, encode(marked, "UTF-16LE")).otherwise(encode(marked, "UTF-16BE"))
    turns = data.load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), content.alias("content"))
    return reader.decode_contents(turns).select("doc_id", "ord", "encoding", "text")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'iso-8859-1' ELSE 'utf-8' END AS encoding, text FROM documents WHERE NOT regexp_matches(text, '[^\\x{0}-\\x{FF}]')")
def decoded_by_row(spark, sf_dir):
    """Texts whose rows name their encodings."""
    texts = data.load(spark, sf_dir, "documents").where(~F.col("text").rlike(r"[^\x{0}-\x{FF}]"))
    name = F.when(F.col("doc_id") % 2 == 0, F.lit("ISO-8859-1")).otherwise(F.lit("UTF-8"))
    content = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return reader.decode_contents(texts.select("doc_id", content.alias("content"), name.alias("encoding"))).select("doc_id", "encoding", "text")


def _streamed(spark: SparkSession, rows: DataFrame, transform) -> DataFrame:
    """A bounded input as a stream, run to its end."""
    folder = data.scratch(spark, "stream")
    rows.write.parquet(f"{folder}/in")
    stream = transform(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS ord, role AS speaker, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS content FROM conversations")
def stream_parse(spark, sf_dir):
    """Labelled texts in pieces of 500 characters, parsed as a stream."""
    texts = data.raw_labelled(spark, sf_dir)
    starts = F.sequence(F.lit(0), F.floor(F.length("text") / 500).cast("int"))
    pieces = texts.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.explode(starts).alias("k"))
    piece = F.substr("text", F.col("k") * 500 + 1, F.lit(500))
    pieces = pieces.select("doc_id", F.col("k").cast("long").alias("seq"), piece.alias("text"), (F.col("k") == F.floor(F.length("text") / 500)).alias("is_last"))
    return _streamed(spark, pieces, parsing.parse_stream).select(F.col("doc_id").cast("long").alias("doc_id"), "ord", "speaker", "content")


@query(f"""WITH {SUB}, {flagged('sub', 0.5)} SELECT doc_id, min(ord) AS ord, arg_min(seg_id, ord) || repeat('_merged', (count(*) - 1)::INTEGER) AS seg_id, round(min(start_time), 6) AS start_time, round(max(end_time), 6) AS end_time, count(*)::INTEGER AS n_merged FROM sub_i GROUP BY doc_id, island""")
def stream_merge(spark, sf_dir):
    """Segments merged as a stream; a row without an order ends each document."""
    fields = StructType.fromDDL(SEGMENT)
    names = fields.names
    rows = data.subsegments(spark, sf_dir).select(*(F.col(f.name).cast(f.dataType) for f in fields))
    ends = rows.select("doc_id").distinct().select("doc_id", *(F.lit(None).cast(fields[n].dataType).alias(n) for n in names[1:]))
    found = _streamed(spark, rows.unionByName(ends), incremental.merge_stream)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "ord", "seg_id", r6("start_time"), r6("end_time"), "n_merged")


@query(f"""WITH {SUB}, {flagged('sub', 0.5)}, isl AS (SELECT doc_id, island, min(ord) AS ord, arg_min(seg_id, ord) || repeat('_merged', (count(*) - 1)::INTEGER) AS seg_id FROM sub_i GROUP BY doc_id, island)
SELECT 'transcript_' || left(sha256(doc_id::VARCHAR), 8) AS id, doc_id::VARCHAR AS file_path, string_agg(seg_id, ',' ORDER BY ord) AS seg_ids, count(*)::VARCHAR AS segment_count, 'async' AS processing_mode FROM isl GROUP BY doc_id""")
def nested_transcripts(spark, sf_dir):
    """Transcripts with their segments nested, and metadata."""
    found = transcripts.nested(merge.merge_segments(data.subsegments(spark, sf_dir)), "2025-01-01 00:00:00", mode="async")
    ids = F.array_join(F.transform("segments", lambda s: s["id"]), ",")
    return found.select("id", "file_path", ids.alias("seg_ids"), F.col("metadata")["segment_count"].alias("segment_count"), F.col("metadata")["processing_mode"].alias("processing_mode"))


@query(f"""WITH {SUB}, p AS (SELECT *, lead(speaker) OVER w AS s2, lead(end_time) OVER w AS e2, lead(confidence) OVER w AS c2, lead(start_time) OVER w AS b2 FROM sub WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
SELECT doc_id, ord, seg_id || '_merged' AS seg_id, round(start_time, 6) AS start_time, round(e2, 6) AS end_time,
  round((confidence * (end_time - start_time) + c2 * (e2 - b2)) / (end_time - start_time + e2 - b2), 6) AS confidence FROM p WHERE s2 = speaker""")
def merged_neighbours(spark, sf_dir):
    """Neighbours of one speaker, merged pair by pair."""
    segments = data.subsegments(spark, sf_dir)
    one = F.struct("ord", "seg_id", "speaker", "start_time", "end_time", "content", "confidence")
    pairs = segments.select("doc_id", one.alias("a"), F.lead(one).over(merge.by_doc()).alias("b")).where("a.speaker = b.speaker")
    return pairs.select("doc_id", merge.merge_pair(F.col("a"), F.col("b")).alias("m")).select("doc_id", "m.ord", "m.seg_id", *(F.round(f"m.{c}", 6).alias(c) for c in ("start_time", "end_time", "confidence")))


@query(f"""WITH {SEG} SELECT doc_id, round(max(end_time), 6) AS duration_seconds, array_to_string(list_sort(list(DISTINCT speaker)), ',') AS speakers,
(SELECT count(*) FROM (SELECT doc_id AS d, speaker, lag(speaker) OVER (PARTITION BY doc_id ORDER BY ord) AS p FROM seg) x WHERE x.d = seg.doc_id AND (p IS NULL OR p <> speaker)) AS segment_count FROM seg GROUP BY doc_id""")
def transcript_pipeline(spark, sf_dir):
    found = batch.process_texts(data.raw_labelled(spark, sf_dir)).transcripts
    return found.select("doc_id", r6("duration_seconds"), F.array_join("speakers", ",").alias("speakers"), "segment_count")
