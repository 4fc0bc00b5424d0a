import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import speakers, transcripts
from colloquy.plans import batch
from colloquy.schema import SEGMENT, SPEAKER, BatchOptions


@pytest.fixture(scope="module")
def three(spark):
    return spark.createDataFrame(
        [("d", 0, "s0", "speaker_1", 0.0, 10.0, "one", 1.0), ("d", 1, "s1", "speaker_2", 10.0, 20.0, "two", 1.0), ("d", 2, "s2", "speaker_1", 25.0, 35.0, "three", 1.0)], SEGMENT
    )


def test_ranges_are_strict(spark, three):
    ids = lambda df: {r["seg_id"] for r in df.collect()}
    assert ids(transcripts.in_range(three, 0, 15)) == {"s0", "s1"}
    assert ids(transcripts.in_range(three, 10, 20)) == {"s1"}
    ranges = spark.createDataFrame([(1, 0.0, 15.0), (2, 10.0, 20.0)], "range_id int, range_start double, range_end double")
    assert {(r["range_id"], r["seg_id"]) for r in transcripts.in_ranges(three, ranges).collect()} == {(1, "s0"), (1, "s1"), (2, "s1")}


def test_ranges_of_any_length_against_brute_force(spark):
    rng = random.Random(3)
    segs = [("d", i, f"s{i}", "a", s, s + rng.choice([0.0, 0.5, 1, 15.9, 16, 300, 90_000.0]), "c", 1.0) for i, s in enumerate(rng.choice([0.0, 15.5, 16.0, 3600.0, 1e9]) + rng.uniform(-20, 400) for _ in range(80))]
    given = [(i, s, s + rng.choice([-5.0, 0.0, 0.1, 16.0, 1000.0, 4e7, 3e9])) for i, s in enumerate(rng.choice([-1.0, 0.0, 16.0, 3500.0, 1e9]) + rng.uniform(0, 300) for _ in range(60))]
    given += [(100, None, 5.0), (101, 0.0, None)]
    expected = sorted((r, x[2]) for r, a, b in given if a is not None and b is not None and a < b for x in segs if x[4] < x[5] and x[4] < b and x[5] > a)
    found = transcripts.in_ranges(spark.createDataFrame(segs, SEGMENT), spark.createDataFrame(given, "range_id int, range_start double, range_end double"))
    assert sorted((r["range_id"], r["seg_id"]) for r in found.collect()) == expected


def test_summaries_keep_empty_documents(spark, three):
    docs = spark.createDataFrame([("d",), ("e",)], "doc_id string")
    found = {r["doc_id"]: r for r in transcripts.summaries(three, docs).collect()}
    assert (found["d"]["duration_seconds"], found["d"]["speakers"], found["d"]["content"]) == (35.0, ["speaker_1", "speaker_2"], "one\ntwo\nthree")
    assert (found["e"]["duration_seconds"], found["e"]["speakers"], found["e"]["segment_count"]) == (0.1, [], 0)


def test_speakers_and_nested(three):
    stats = {r["speaker"]: (r["total_duration"], r["segment_count"]) for r in transcripts.speaker_stats(three).collect()}
    assert stats == {"speaker_1": (20.0, 2), "speaker_2": (10.0, 1)}
    assert transcripts.speakers_first_seen(three).first()["speakers"] == ["speaker_1", "speaker_2"]
    nested = transcripts.nested(three, "2025-01-01 00:00:00").first()
    assert [s["id"] for s in nested["segments"]] == ["s0", "s1", "s2"]
    assert nested["metadata"]["segment_count"] == "3"


def test_minutes(spark):
    row = transcripts.minutes_and_hours(spark.createDataFrame([(3665.0,)], "duration_seconds double")).first()
    assert row["minutes"] == pytest.approx(61.083, abs=1e-3)
    assert row["hours"] == pytest.approx(1.018, abs=1e-3)


def test_aliases(spark, three):
    dim = spark.createDataFrame([(0, "a", "Ann", ["speaker_1"]), (1, "b", "Bob", ["speaker_1", "speaker_2"]), (2, "a", "Later", None)], SPEAKER)
    found = {r["speaker"]: r["speaker_id"] for r in speakers.resolve(three, dim).collect()}
    assert found == {"speaker_1": "a", "speaker_2": "b"}
    assert speakers.add_speakers(dim.limit(1), dim).count() == 2
    assert [r["x"] for r in dim.orderBy("ord").select(speakers.has_alias("speaker_2").alias("x")).collect()] == [False, True, False]


def test_period_ends_at_midnight(spark):
    given = spark.createDataFrame([("2025-06-01 00:00:00",), ("2025-12-31 00:00:00",), ("2025-12-31 00:00:01",)], "t string")
    found = given.select(speakers.in_period(F.col("t").cast("timestamp"), "2025-06-01", "2025-12-31").alias("x")).collect()
    assert [r["x"] for r in found] == [True, True, False]


def test_bad_documents_are_rows_or_errors(spark):
    texts = spark.createDataFrame([("good", "[00:01] A: x\n[00:05] B: y"), ("bad", "[00:09] A: x\n[00:05] B: y")], "doc_id string, text string")
    options = BatchOptions(parser="timestamped")
    found = batch.process_texts(texts, options)
    assert [r["doc_id"] for r in found.transcripts.collect()] == ["good"]
    assert [r["doc_id"] for r in found.errors.collect()] == ["bad"]
    row = batch.summary(found).first()
    assert (row["total_files"], row["failed_files"], row["success_rate"]) == (2, 1, 0.5)
    assert [(r["doc_id"], r["error"].split(" seg_")[0]) for r in found.errors.collect()] == [("bad", "invalid segment")]
    assert {r["doc_id"] for r in found.segments.collect()} == {"good"}
    with pytest.raises(Exception, match="invalid segment"):
        batch.process_texts(texts, BatchOptions(parser="timestamped", skip_on_error=False)).transcripts.collect()


def test_one_parse_and_one_exchange(spark, sf_dir):
    texts = spark.createDataFrame([("a", "X: hello\nY: you")], "doc_id string, text string").repartition(3)
    plan = batch.process_texts(texts).transcripts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all(text") <= 2  # the turns' labels and their contents, in one projection
    assert plan.count("Generate ") == 1
