import pytest
from pyspark.sql import functions as F

from colloquy.operators import merge
from colloquy.schema import SEGMENT, ConfigurationError, MergeOptions


def rows(spark, *given):
    """(speaker, start, end, content, confidence) in order, of one document."""
    full = [("d", i, f"seg_{i:03d}", *(g + ("Test", 0.9)[len(g) - 3 :] if len(g) < 5 else g)) for i, g in enumerate(given)]
    return spark.createDataFrame([(d, o, s, sp, float(a), float(b), c, float(k)) for d, o, s, sp, a, b, c, k in full], SEGMENT)


@pytest.mark.parametrize(
    ("second", "expected"),
    [(("a", 1.3, 2), True), (("a", 5, 6), False), (("b", 1, 2), False), (("a", 0.5, 3), True), (("a", 1.5, 2), True), (("a", 1.51, 2), False)],
)
def test_should_merge(spark, second, expected):
    flags = merge.merge_flags(rows(spark, ("a", 0, 1), second)).orderBy("ord").collect()
    assert [r["continues"] for r in flags] == [False, expected]


@pytest.mark.parametrize(
    ("left", "right", "joined"),
    [("Hello", "World", "Hello World"), ("Hel", "lo", "Hello"), ("안녕하", "세요", "안녕하세요"), ("Hello!", "World", "Hello! World"), ("", "Hello", "Hello"), ("Hi ", " ", "Hi"), ("a\t", "\nB", "a B")],
)
def test_content(spark, left, right, joined):
    one = merge.merge_segments(rows(spark, ("a", 0, 1, left, 1.0), ("a", 1, 2, right, 1.0))).collect()
    assert [r["content"] for r in one] == [joined]


def test_confidence_by_duration_and_id(spark):
    one = merge.merge_segments(rows(spark, ("a", 0, 1, "A", 0.9), ("a", 1, 4, "B", 0.7))).first()
    assert one["confidence"] == pytest.approx(0.75)
    assert (one["seg_id"], one["end_time"], one["n_merged"]) == ("seg_000_merged", 4.0, 2)


def test_fold_counts_gaps(spark):
    options = MergeOptions(time_tolerance=10)
    found = merge.merge_segments(rows(spark, ("a", 0, 1, "x", 1.0), ("a", 5, 6, "y", 0.0), ("a", 6, 7, "z", 1.0)), options).first()
    assert found["confidence"] == pytest.approx((0.5 * 6 + 1.0) / 7)


def test_islands_and_splits(spark):
    given = rows(spark, ("a", 0, 1), ("a", 1, 2), ("a", 10, 11), ("a", 11, 12))
    assert merge.merge_segments(given).count() == 2
    assert {tuple(r)[1:] for r in merge.split_pairs(given).collect()} == {(0, 1), (2, 3)}
    assert merge.merge_segments(rows(spark, *[("a", i * 10, i * 10 + 1) for i in range(100)])).count() == 100


def test_idempotent_and_stats(spark):
    once = merge.merge_segments(rows(spark, ("a", 0, 1), ("a", 1, 2), ("b", 2, 3), ("b", 9, 10)))
    again = merge.merge_segments(once)
    assert once.drop("n_merged").collect() == again.drop("n_merged").collect()
    stats = merge.merge_stats(rows(spark, ("a", 0, 1), ("a", 1, 2), ("b", 2, 3))).first()
    assert tuple(stats) == (3, 1, 2, pytest.approx(1 / 3))
    assert merge.merge_stats(rows(spark, ("a", 0, 1)).limit(0)).first()["merge_ratio"] == 0


def test_continuity(spark):
    overlap = merge.continuity_errors(rows(spark, ("a", 0, 5), ("a", 2, 6))).first()["message"]
    gap = merge.continuity_errors(rows(spark, ("a", 0, 1), ("a", 20, 21))).first()["message"]
    assert overlap == "Segment 0 and 1 have significant overlap: 3.00s"
    assert gap == "Large gap between segment 0 and 1: 19.00s"


def test_continuity_seconds_round_as_sql_does(spark):
    duckdb = pytest.importorskip("duckdb")
    gaps = [10.125, 10.375, 10.625, 20.005, 20.015, 1e7 + 0.125, 1e15 + 0.125, 1e18, 10.999, -1.125, -2.675, -3.625, -1000.005, float("inf"), float("nan")]
    given = spark.createDataFrame([(k, i, "a", (0.0, g)[i], 0.0) for k, g in enumerate(gaps) for i in (0, 1)], "doc_id long, ord long, speaker string, start_time double, end_time double")
    found = {r["doc_id"]: r["message"].split(": ")[1] for r in merge.continuity_errors(given).collect()}
    assert found == {k: duckdb.execute("SELECT printf('%.2fs', ?::DOUBLE)", [abs(g)]).fetchone()[0] for k, g in enumerate(gaps)}


def test_options():
    with pytest.raises(ConfigurationError):
        MergeOptions(time_tolerance=-1)


def test_merge_pair(spark):
    struct = "struct<ord:long,seg_id:string,speaker:string,start_time:double,end_time:double,content:string,confidence:double>"
    pair = lambda speaker: spark.createDataFrame([((0, "x", "a", 0.0, 2.0, "Hel", 1.0), (1, "y", speaker, 2.0, 4.0, "lo", 0.5))], f"a {struct}, b {struct}")
    merged = lambda df: df.select(merge.merge_pair(F.col("a"), F.col("b")).alias("m")).select("m.*")
    assert tuple(merged(pair("a")).first()) == (0, "x_merged", "a", 0.0, 4.0, "Hello", 0.75)
    with pytest.raises(Exception, match="speakers differ: a and b"):
        merged(pair("b")).collect()


def test_one_exchange(spark):
    """Window, islands and fold share the partitioning by document."""
    plan = merge.merge_segments(rows(spark, ("a", 0, 1)).repartition(3))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1
    assert F is not None
