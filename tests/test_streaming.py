import pytest
from pyspark.sql import functions as F

from colloquy.operators.merge import merge_segments
from colloquy.operators.parse import parse_labelled
from colloquy.schema import SEGMENT
from colloquy.streaming.incremental import merge_stream, pending
from colloquy.streaming.parsing import PIECE, parse_stream
from colloquy.streaming.progress import NoActiveFileError, ProgressTracker, task_progress


def test_stream_equals_batch(spark, tmp_path):
    first = [("d", 0, "a", "x", 0.0, 1.0, "Hel", 0.9), ("d", 1, "b", "x", 1.0, 4.0, "lo", 0.7), ("e", 0, "c", "y", 0.0, 1.0, "only", 1.0)]
    second = [("d", 2, "f", "x", 4.2, 5.0, "World", 0.5), ("d", 3, "g", "y", 5.0, 6.0, "Bye", 1.0)]
    end = [("d", None, None, None, None, None, None, None), ("e", None, None, None, None, None, None, None)]
    for i, rows in enumerate((first, second, end)):
        spark.createDataFrame(rows, SEGMENT).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(SEGMENT).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = merge_stream(stream).writeStream.format("memory").queryName("merged").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = {(r["doc_id"], r["ord"], r["seg_id"], r["content"], round(r["confidence"], 9), r["n_merged"]) for r in spark.table("merged").collect()}
    batch = merge_segments(spark.createDataFrame(first + second, SEGMENT)).collect()
    assert found == {(r["doc_id"], r["ord"], r["seg_id"], r["content"], round(r["confidence"], 9), r["n_merged"]) for r in batch}


def test_pending_segments(spark, tmp_path):
    rows = [("d", 0, "a", "x", 0.0, 1.0, "Hel", 0.9), ("d", 1, "b", "x", 1.0, 4.0, "lo", 0.7), ("e", 0, "c", "y", 0.0, 1.0, "one", 1.0), ("e", 1, "f", "z", 1.0, 2.0, "two", 1.0)]
    spark.createDataFrame(rows, SEGMENT).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = merge_stream(spark.readStream.schema(SEGMENT).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("left").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r["doc_id"], r["content"], r["n_merged"]) for r in pending(spark, f"{tmp_path}/ck").collect()} == {("d", "Hello", 2), ("e", "two", 1)}


def test_progress():
    seen = []
    tracker = ProgressTracker(2)
    tracker.add_callback(lambda t: seen.append(t.progress))
    tracker.add_callback(lambda t: 1 / 0)
    tracker.start_file("a", 100)
    tracker.update_progress(0.5)
    assert tracker.progress == 0.25
    tracker.start_file("b", 0)
    assert (tracker.files_completed, tracker.files_remaining, tracker.progress) == (1, 1, 0.5)
    tracker.finish_file()
    assert tracker.percent == 100
    assert seen == sorted(seen)
    with pytest.raises(NoActiveFileError):
        tracker.update_bytes(1)
    with pytest.raises(ValueError):
        ProgressTracker(-1)


def test_parsing_pieces_equals_parsing_whole_texts(spark, tmp_path):
    texts = {"a": "pre\nAnn: Hello,\nhow are you?\nBob: Fine.\n\nlost\nAnn: Good: yes\nBob:\nlate", "b": "no label\nhere\n\n and there \n", "c": "", "d": "X: " + "long " * 50}
    cuts = [(d, i, t[i : i + 7], False) for d, t in texts.items() for i in range(0, len(t), 7)]
    cuts += [(d, 10_000, "", True) for d in texts]
    for part in range(3):
        rows = [c for c in cuts if (c[1] // 20 if c[1] < 10_000 else 9) in ([0, 1], [2, 3, 4], list(range(5, 50)))[part]]
        spark.createDataFrame(rows, PIECE).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(PIECE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = parse_stream(stream).writeStream.format("memory").queryName("parsed").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(120)
    whole = parse_labelled(spark.createDataFrame(list(texts.items()), "doc_id string, text string"))
    as_rows = lambda df: sorted(map(str, df.select("doc_id", "ord", "seg_id", "speaker", "start_time", "end_time", "content").collect()))
    assert as_rows(spark.table("parsed")) == as_rows(whole)


def test_progress_follows_a_job_group(spark):
    tracker = ProgressTracker(1)
    tracker.start_file("a", 1000)
    tracker.follow(spark, "no such group")
    assert tracker.progress == 0
    spark.sparkContext.setJobGroup("counting", "a test")
    spark.range(0, 100, 1, 4).groupBy((F.col("id") % 3).alias("k")).count().collect()
    spark.sparkContext._jsc.clearJobGroup()
    assert task_progress(spark, "counting") == 1
    tracker.follow(spark, "counting")
    assert tracker.progress == 1
