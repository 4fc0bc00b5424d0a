"""Incremental merging: segments arrive in micro-batches, islands leave as soon as they are broken.

The state of a document is its pending segment.  ``flush`` ends a document: a row whose ``ord`` is null,
or the timeout that is given, puts out what is pending.  Segments of a document must arrive in their
order across batches; within one they are sorted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from colloquy.functions.text import HANGUL
from colloquy.schema import MergeOptions

OUTPUT = "doc_id string, ord long, seg_id string, speaker string, start_time double, end_time double, content string, confidence double, n_merged int"
STATE = "ord long, seg_id string, speaker string, start_time double, end_time double, content string, confidence double, n_merged int"
FIELDS = ("ord", "seg_id", "speaker", "start_time", "end_time", "content", "confidence", "n_merged")

LOWER = re.compile(r"[a-z]\Z")
KOREAN = re.compile(f"[{HANGUL}]")


def joined(a: str, b: str) -> str:
    a, b = a.rstrip(), b.lstrip()
    if not a or not b:
        return a or b
    within = (LOWER.match(a[-1]) and LOWER.match(b[0])) or (KOREAN.match(a[-1]) and KOREAN.match(b[0]))
    return a + b if within else f"{a} {b}"


def merged(a: dict, b: dict) -> dict:
    da, db = a["end_time"] - a["start_time"], b["end_time"] - b["start_time"]
    mean = (a["confidence"] * da + b["confidence"] * db) / (da + db) if da + db else (a["confidence"] + b["confidence"]) / 2
    return a | {
        "seg_id": f"{a['seg_id']}_merged",
        "end_time": b["end_time"],
        "content": joined(a["content"], b["content"]),
        "confidence": min(1.0, max(0.0, mean)) if da + db else mean,
        "n_merged": a["n_merged"] + 1,
    }


def merge_stream(segments: DataFrame, options: MergeOptions = MergeOptions(), timeout_ms: int | None = None) -> DataFrame:
    """Merged segments of a stream of segments, in append mode."""
    tolerance = options.time_tolerance

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending = dict(zip(FIELDS, state.get, strict=True)) if state.exists else None
        out: list[dict] = []
        if state.hasTimedOut:
            out, pending = [pending], None
        else:
            rows = [r for batch in batches for r in batch.to_dict("records")]
            ends = any(pd.isna(r["ord"]) for r in rows)
            for row in sorted((r for r in rows if not pd.isna(r["ord"])), key=lambda r: r["ord"]):
                new = {k: row[k] for k in FIELDS[:-1]} | {"n_merged": 1}
                if pending is None:
                    pending = new
                elif pending["speaker"] == new["speaker"] and new["start_time"] - pending["end_time"] <= tolerance:
                    pending = merged(pending, new)
                else:
                    out.append(pending)
                    pending = new
            if ends and pending is not None:
                out.append(pending)
                pending = None
        if pending is None:
            if state.exists:
                state.remove()
        else:
            state.update(tuple(int(pending[k]) if k in ("ord", "n_merged") else pending[k] for k in FIELDS))
            if timeout_ms is not None:
                state.setTimeoutDuration(timeout_ms)
        if out:
            yield pd.DataFrame([{"doc_id": key[0]} | x for x in out], columns=["doc_id", *FIELDS]).astype({"ord": "int64", "n_merged": "int32"})

    timeout = GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return segments.groupBy("doc_id").applyInPandasWithState(step, OUTPUT, STATE, "append", timeout)


def pending(spark: SparkSession, checkpoint: str) -> DataFrame:
    """doc_id and the pending segment of each document, as a query with this checkpoint location left them."""
    state = spark.read.format("statestore").load(checkpoint)
    found = state.select(F.col("key.doc_id").alias("doc_id"), F.col("value.groupState").alias("s"))
    return found.where("s is not null").select("doc_id", "s.*")
