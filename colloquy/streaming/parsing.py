"""Incremental parsing: texts arrive in pieces, turns leave as soon as the next one has begun.

The state of a document is the text not yet parsed, the clock and the number of segments.  A document
ends with a piece that says so.  The segments are those that ``operators.parse.parse_labelled``
finds in the whole text, wherever it was cut; without any label they leave when the document ends,
since only then it is known to have none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from colloquy.functions.text import CHARS_PER_MINUTE, LEAST_SECONDS
from colloquy.operators import parse
from colloquy.schema import DEFAULT_CONFIDENCE, DEFAULT_SPEAKER, SEGMENT

#: Pieces: ``seq`` orders those of a document, ``is_last`` ends it.
PIECE = "doc_id string, seq long, text string, is_last boolean"
STATE = "buffer string, clock double, n long, labelled boolean"

#: The same format as for whole texts; Python writes the end of a text differently.
TURN = re.compile(parse.TURN.replace(r"\z", r"\Z"), re.S)


def paragraphs(text: str) -> list[str]:
    found: list[list[str]] = [[]]
    for line in map(str.strip, text.split("\n")):
        if line:
            found[-1].append(line)
        else:
            found.append([])
    return [" ".join(p) for p in found if p]


def take_turns(buffer: str, ends: bool) -> tuple[list[tuple[str, str]], str]:
    """Turns that no further text can change, and the text that is left."""
    found = list(TURN.finditer(buffer)) if ":" in buffer else []
    done = found if ends else found[:-1]
    rest = "" if ends else buffer[found[-1].start() :] if found else buffer
    return [(m[1].strip(), m[2].strip()) for m in done], rest


def parse_stream(pieces: DataFrame, *, default_speaker: str = DEFAULT_SPEAKER, default_confidence: float = DEFAULT_CONFIDENCE) -> DataFrame:
    """Segments of a stream of pieces, in append mode; pieces must arrive in order across batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, clock, n, labelled = state.get if state.exists else ("", 0.0, 0, False)
        out = []
        rows = sorted((r for batch in batches for r in batch.to_dict("records")), key=lambda r: r["seq"])
        buffer += "".join(r["text"] or "" for r in rows)
        ends = any(r["is_last"] for r in rows)
        turns, rest = take_turns(buffer, ends)
        if turns:
            labelled = True
        elif ends and not labelled:
            turns = [("", p) for p in paragraphs(buffer)]
        for speaker, content in turns:
            if content:
                end = clock + max(LEAST_SECONDS, len(content) / CHARS_PER_MINUTE * 60.0)
                code = hashlib.sha256(f"{key[0]}|{n}".encode()).hexdigest()[:8]
                out.append((key[0], n, f"seg_{code}", speaker or default_speaker, clock, end, content, default_confidence))
                clock, n = end, n + 1
        if ends:
            if state.exists:
                state.remove()
        else:
            state.update((rest, float(clock), int(n), bool(labelled)))
        if out:
            yield pd.DataFrame(out, columns=["doc_id", "ord", "seg_id", "speaker", "start_time", "end_time", "content", "confidence"])

    return pieces.groupBy("doc_id").applyInPandasWithState(step, SEGMENT, STATE, "append", GroupStateTimeout.NoTimeout)
