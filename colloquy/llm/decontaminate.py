"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the benchmark's windows of ``window`` words; an item of fewer words is one
shorter pattern.  The text is a row of words, and a block is two of them.  The search looks at
the block that ends a possible occurrence.  The shift table says how far the text can move
before that block could end one; most blocks are in no pattern, so that nearly a whole window
is skipped.  A block with shift 0 names the suffix bucket, the first block of the position
selects the patterns in the bucket, and a direct comparison of the words confirms them.

Patterns reach the workers in blocks of ``PATTERNS_PER_BLOCK``, whatever the benchmark's size.
Each block is one pass over the texts, which adds its hits to those of the passes before it.
Every text is searched whole, in the task that reads it: nothing is shuffled.  With more than one block the texts with
the hits so far are written between passes, so that a worker holds the tables of one block at a time.

Nulls: a null text has no words.  A very long text is one row, whose words are held while it is searched.  Repeated
documents have equal hits; items with equal windows all count.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from colloquy.llm.common import Sent, arrow_map, table, utf8, written

WINDOW = 10

#: Patterns that one pass sends to the workers: of 10 words, some 60 MB.
PATTERNS_PER_BLOCK = 100_000

#: A-Z to lower case; every other ASCII character but digits and letters to a space.
FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)

HITS = "n_words long, spans array<struct<start:long,end:long>>, item_ids array<string>"


def folded_words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class WuManber:
    """Finds patterns of one length ``m`` in rows of words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]]):
        self.m = m = len(next(iter(patterns)))
        self.b = b = min(2, m)
        self.skip = m - b + 1
        self.items = patterns
        self.shift: dict = {}
        self.buckets: dict = defaultdict(lambda: defaultdict(list))
        for pattern in patterns:
            for end in range(b, m + 1):
                block = self.block(pattern, end)
                self.shift[block] = min(self.shift.get(block, self.skip), m - end)
            self.buckets[self.block(pattern, m)][self.block(pattern, b)].append(pattern)
        self.buckets = {k: dict(v) for k, v in self.buckets.items()}

    def block(self, words, end: int):
        return (words[end - 2], words[end - 1]) if self.b == 2 else words[end - 1]

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(start, item ids) of each occurrence, in order of their starts."""
        m, n, shift, skip = self.m, len(words), self.shift.get, self.skip
        end = m
        two = self.b == 2
        while end <= n:
            block = (words[end - 2], words[end - 1]) if two else words[end - 1]
            step = shift(block, skip)
            if step:
                end += step
                continue
            start = end - m
            for pattern in self.buckets[block].get(self.block(words, start + self.b), ()):
                if tuple(words[start:end]) == pattern:
                    yield start, self.items[pattern]
            end += 1


def windows_of(items: Iterable[tuple[str, bytes | None]], window: int) -> Iterator[tuple[str, tuple[bytes, ...]]]:
    for item, text in items:
        words = folded_words(text)
        size = min(window, len(words))
        for start in range(len(words) - size + 1 if size else 0):
            yield item, tuple(words[start : start + size])


def matchers(found: Iterable[tuple[str, tuple[bytes, ...]]]) -> list[WuManber]:
    by_length: dict = defaultdict(lambda: defaultdict(list))
    for item, pattern in found:
        own = by_length[len(pattern)][pattern]
        if item not in own:
            own.append(item)
    return [WuManber(dict(v)) for _, v in sorted(by_length.items())]


def pattern_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, per_block: int):
    """The benchmark's windows in lists of at most ``per_block``; one list is held at a time."""
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("binary")).toLocalIterator()
    block: list = []
    for found in windows_of(((item, text and bytes(text)) for item, text in rows if item is not None), window):
        block.append(found)
        if len(block) == per_block:
            yield block
            block = []
    if block:
        yield block


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def search(words: list[bytes], found: list[WuManber]) -> tuple[list[tuple[int, int]], set[str]]:
    """Maximal spans of words that lie in occurrences, and the items that occur."""
    spans, items = [], set()
    for w in found:
        for start, ids in w.find(words):
            spans.append((start, start + w.m))
            items.update(ids)
    return joined(spans), items


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    benchmark_text_col: str = "text",
    window: int = WINDOW,
    per_block: int = PATTERNS_PER_BLOCK,
) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (hit words, from and to) and ``item_ids`` added.

    Null and empty texts have no words, so no hits; items without an id or without words give
    no pattern; an empty benchmark gives no hits; repeated items count once by their id.
    Columns of ``docs`` with the added names are replaced.
    """
    spark = docs.sparkSession
    found = docs.drop("n_words", "spans", "item_ids")
    at = found.schema.names.index(text_col)
    plain = found.schema.fields
    schema = StructType([*plain, *StructType.fromDDL(HITS).fields])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def one_pass(df: DataFrame, block: list) -> DataFrame:
        sent = Sent(spark, matchers(block))
        sents.append(sent)

        def scan(batch: pa.RecordBatch):
            n_words, spans, items = [], [], []
            earlier = batch.num_columns > len(plain)
            spans_before = batch.column(len(plain) + 1).to_pylist() if earlier else [()] * batch.num_rows
            items_before = batch.column(len(plain) + 2).to_pylist() if earlier else [()] * batch.num_rows
            for text, spans_had, items_had in zip(utf8(batch.column(at)), spans_before, items_before, strict=True):
                words = folded_words(text)
                hit, ids = search(words, sent.value)
                hit = joined([*hit, *((s["start"], s["end"]) for s in spans_had)])
                n_words.append(len(words))
                spans.append([{"start": s, "end": e} for s, e in hit])
                items.append(sorted(ids.union(items_had)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(plain)], pa.array(n_words, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))],
                names=[*batch.schema.names[: len(plain)], "n_words", "spans", "item_ids"],
            )

        return arrow_map(df, scan, schema)

    sents: list[Sent] = []
    blocks = pattern_blocks(benchmark, item_col, benchmark_text_col, window, per_block)
    found = one_pass(found, next(blocks, []))
    for block in blocks:
        found = written(found, "hits")
        sents.pop().release()
        found = one_pass(found, block)
    return found


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE item_id IS NOT NULL),
p AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS m, array_to_string(ws[s : s + least(10, len(ws)) - 1], ' ') AS pat
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS s FROM b WHERE len(ws) > 0)),
lengths AS (SELECT DISTINCT m FROM p),
dw AS (
  SELECT rid, m, s, array_to_string(ws[s : s + m - 1], ' ') AS pat
  FROM (SELECT rid, ws, m, unnest(range(1, len(ws) - m + 2)) AS s FROM w, lengths WHERE len(ws) >= m)),
hit AS (SELECT rid, dw.m, s, item_id FROM dw JOIN p ON p.m = dw.m AND p.pat = dw.pat),
words AS (SELECT rid, count(DISTINCT i) AS n_hit FROM (SELECT rid, unnest(range(s, s + m)) AS i FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
