"""Substring dedup: windows of 50 words that an earlier document has, found with FM-indexes.

Every window has an anchor, the least of its 24-word codes; windows with the same words have the
same anchor.  A document's windows with one anchor follow each other, and the words they cover
are a snippet.  So a window can only recur among the snippets of its anchor, and an index need
not meet texts that share no anchor with it.

1. Each document gives its snippets' anchor, content code and place, but no text.
2. Anchors of one document only are dropped; of equal snippets the earliest document keeps the
   only copy to be indexed, and later documents are covered by it whole.
3. The kept snippets of anchors that have several go to the shard of their anchor.  A shard builds
   an FM-index of its snippets and streams them through it: backward search gives each position's
   longest match in an earlier document, and positions with a match of 50 words or more are
   windows to remove.  An anchor with many different snippets is split into blocks, and each pair of
   blocks is a shard of its own, so that no task holds more than two blocks of it.
4. The spans found meet their document again, which drops the words.

What is shuffled is in proportion to the number of snippets, about two for each 27 words, and to
the text in repeats.  Whole texts are shuffled only where a snippet is cut from them or a span
dropped; while the list of such documents is short (its length is checked) it is broadcast, so that
the others stay where they are, and beyond that all texts meet it in a shuffle.

Nulls: a null text has no words, a row without an id comes after all others.  Very long texts are taken in strips of
windows.  Ties: of equal snippets in one document the first is kept.  Rows with one id, repeated ones too, lose
nothing to each other.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from colloquy.llm.common import WordCodes, arrow_map, cut_lineage, doc_key, free_names, gram_codes, slices, table, text_key, utf8, written
from colloquy.llm.decontaminate import joined
from colloquy.llm.fm_index import FMIndex

WINDOW = 50
ANCHOR_WORDS = 24

#: Snippets of one anchor in a block, and words in a shard.
BLOCK = 256
SHARD_WORDS = 200_000
LEAST_SHARDS = 64

#: Documents, and spans, of lists that are broadcast: 10 to 30 MB.
SHORT_LIST = 400_000

#: Windows of a text that are handled at a time.
STRIP = 1 << 20

#: Columns that the operator adds on the way.
INTERNAL = ("__doc", "__text_code", "__kept", "__spans")

SNIPPET = "anchor long, content long, doc long, text_code long, first long, last long"
SPANS = "array<struct<start:long,end:long>>"


def snippets(codes: np.ndarray, window: int, k: int):
    """(anchor code, first window, last window) of each snippet, as arrays."""
    grams = gram_codes(codes, k)
    span = window - k + 1
    low = np.uint64((1 << 24) - 1)
    anchors, firsts, lasts = [], [], []
    for strip in slices(len(codes) - window + 1, STRIP):
        part = grams[strip.start : strip.stop + span - 1]
        key = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        step = 1
        while step * 2 <= span:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        if step < span:
            key = np.minimum(key[: len(key) - (span - step)], key[span - step :])
        place = (key & low).astype(np.int64)
        turn = np.flatnonzero(np.diff(place)) + 1
        first = np.concatenate([[0], turn])
        anchors.append(part[place[first]])
        firsts.append(first + strip.start)
        lasts.append(np.concatenate([turn - 1, [len(place) - 1]]) + strip.start)
    return np.concatenate(anchors), np.concatenate(firsts), np.concatenate(lasts)


def snippet_rows(docs: DataFrame, window: int, k: int) -> DataFrame:
    """The snippets of all documents; ``docs`` has doc, text_code and text."""
    codes_of = WordCodes()

    def scan(batch: pa.RecordBatch):
        for part in slices(batch.num_rows, 1000):
            rows = batch.slice(part.start, part.stop - part.start)
            out: list[list] = [[], [], [], [], [], []]
            ids, text_codes = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            for doc, text_code, text in zip(ids, text_codes, utf8(rows.column(2)), strict=True):
                words = text.split() if text else []
                if len(words) < window:
                    continue
                codes = codes_of.of(words)
                anchor, first, last = snippets(codes, window, k)
                raw = memoryview(codes.tobytes())
                content = [xxhash.xxh3_64_intdigest(raw[8 * a : 8 * (b + window)]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                n = len(anchor)
                for column, values in zip(out, (anchor.view(np.int64), np.array(content, np.uint64).view(np.int64), np.full(n, doc), np.full(n, text_code), first, last), strict=True):
                    column.append(values)
            if out[0]:
                names = ["anchor", "content", "doc", "text_code", "first", "last"]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], names=names)

    return arrow_map(docs, scan, SNIPPET)


def cut_snippets(held: DataFrame, text_at: int, window: int) -> DataFrame:
    """The snippets to index, a row for each shard they go to; ``held``: documents with the list of those they hold."""
    at = held.schema.names.index

    def scan(batch: pa.RecordBatch):
        for part in slices(batch.num_rows, 500):
            rows = batch.slice(part.start, part.stop - part.start)
            shards, anchors, contents, docs, roles, words_out = [], [], [], [], [], []
            for doc, text, kept in zip(rows.column(at("__doc")).to_pylist(), utf8(rows.column(text_at)), rows.column(at("__kept")).to_pylist(), strict=True):
                words = text.split()
                for x in kept:
                    raw = b" ".join(words[x["first"] : x["last"] + window])
                    for to in x["to"]:
                        shards.append(to["shard"])
                        roles.append(to["role"])
                        anchors.append(x["anchor"])
                        contents.append(x["content"])
                        docs.append(doc)
                        words_out.append(raw)
            long = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards, long), pa.array(roles, pa.int32()), pa.array(anchors, long), pa.array(contents, long), pa.array(docs, long), pa.array(words_out, pa.binary())],
                names=["shard", "role", "anchor", "content", "doc", "words"],
            )

    return arrow_map(held, scan, "shard long, role int, anchor long, content long, doc long, words binary")


def search_shard(window: int):
    """Of a shard's rows, those whose role has bit 1 are indexed and those with bit 2 streamed."""
    codes_of = WordCodes()

    def run(rows: pa.Table) -> pa.Table:
        role = rows.column("role").to_numpy()
        docs = rows.column("doc").to_numpy()
        words = [codes_of.of(x.split()) for x in rows.column("words").to_pylist()]
        indexed, asked = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        anchors, contents, spans = [], [], []
        if len(indexed) and len(asked):
            index = FMIndex([words[i] for i in indexed], docs[indexed])
            found = index.matching_statistics([words[i] for i in asked], docs[asked])
            anchor, content = rows.column("anchor").to_numpy(), rows.column("content").to_numpy()
            for i, longest in zip(asked, found, strict=True):
                above = np.flatnonzero(longest >= window)
                if len(above):
                    turn = np.flatnonzero(np.diff(above) > 1)
                    first, last = above[np.concatenate([[0], turn + 1])], above[np.concatenate([turn, [len(above) - 1]])]
                    anchors.append(anchor[i])
                    contents.append(content[i])
                    spans.append([{"start": s, "end": e + window} for s, e in zip(first.tolist(), last.tolist(), strict=True)])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"anchor": pa.array(anchors, pa.int64()), "content": pa.array(contents, pa.int64()), "found": pa.array(spans, span)})

    return run


def merged(spans: DataFrame) -> DataFrame:
    """The spans of each document in order, those that touch or overlap as one."""
    at = spans.schema.names.index("__spans")

    def scan(batch: pa.RecordBatch):
        out = [[{"start": s, "end": e} for s, e in joined((x["start"], x["end"]) for x in own)] for own in batch.column(at).to_pylist()]
        columns = [pa.array(out, batch.column(i).type) if i == at else batch.column(i) for i in range(batch.num_columns)]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return arrow_map(spans, scan, spans.schema)


def drop_words(spanned: DataFrame, text_at: int, columns: list) -> DataFrame:
    """The documents with the words in ``__spans`` dropped."""
    at = spanned.schema.names.index
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = StructType([*columns, *StructType.fromDDL(f"n_words long, n_removed long, removed {SPANS}, kept_text string").fields])
    kept_at = [at(f.name) for f in columns]

    def scan(batch: pa.RecordBatch):
        for part in slices(batch.num_rows, 1000):
            rows = batch.slice(part.start, part.stop - part.start)
            n_words, n_removed, removed, kept_text = [], [], [], []
            for text, spans in zip(utf8(rows.column(text_at)), rows.column(at("__spans")).to_pylist(), strict=True):
                words = text.split() if text else []
                done, kept = 0, []
                for x in spans or ():
                    kept.extend(words[done : x["start"]])
                    done = x["end"]
                kept.extend(words[done:])
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                removed.append(spans or [])
                kept_text.append(b" ".join(kept).decode())
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(i) for i in kept_at), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, span_type), pa.array(kept_text, pa.string())],
                names=schema.names,
            )

    return arrow_map(spanned, scan, schema)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``removed`` (word spans) and ``kept_text`` added.

    A word goes if a window over it also starts in a document with a smaller id; of rows with
    the same id none is the smaller one.  A null text has no words; a row without an id comes after
    all others; texts of fewer words than a window lose none.  Columns of ``docs`` with the added
    names are replaced.
    """
    own = ["n_words", "n_removed", "removed", "kept_text"]
    docs = docs.drop(*own)
    clashing = [c for c in docs.columns if c.lower() in INTERNAL]
    if clashing:
        names = dict(zip(clashing, free_names(docs, *(f"own{c}" for c in clashing)), strict=True))
        found = remove_repeats(docs.withColumnsRenamed(names), id_col=names.get(id_col, id_col), text_col=names.get(text_col, text_col), window=window, anchor_words=anchor_words)
        return found.withColumnsRenamed({v: k for k, v in names.items()})
    keyed = docs.withColumns({"__doc": doc_key(id_col), "__text_code": text_key(text_col)})
    text_at = keyed.schema.names.index(text_col)
    runs = written(snippet_rows(keyed.select("__doc", "__text_code", text_col), window, min(anchor_words, window)), "snippets")

    several = cut_lineage(runs.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("anchor"))
    shared = written(runs.join(several, "anchor"), "snippets-shared")
    held = shared.groupBy("anchor", "content").agg(F.min(F.struct("doc", "text_code", "first", "last")).alias("x"))
    held = cut_lineage(held.select("anchor", "content", "x.*"))
    per_anchor = cut_lineage(held.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    placed = held.join(per_anchor, "anchor")
    words = placed.agg(F.sum(F.col("last") - F.col("first") + window)).first()[0] or 0
    n_shards = max(-(-words // SHARD_WORDS), LEAST_SHARDS)

    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    block = F.pmod(F.xxhash64("content"), blocks)
    cell = lambda i, j, role: F.struct((F.lit(-1) - F.pmod(F.xxhash64("anchor", i, j), F.lit(1 << 40))).alias("shard"), F.lit(role).alias("role"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda i: i != block)
    cells = F.concat(
        F.array(cell(block, block, 3)),
        F.transform(others, lambda j: cell(block, j, 1)),
        F.transform(others, lambda i: cell(i, block, 2)),
    )
    one = F.array(F.struct(F.pmod("anchor", F.lit(n_shards)).alias("shard"), F.lit(3).alias("role")))
    placed = placed.withColumn("to", F.when(F.col("n") <= BLOCK, one).otherwise(cells))
    kept = placed.groupBy(F.col("doc").alias("__doc"), F.col("text_code").alias("__text_code")).agg(F.collect_list(F.struct("anchor", "content", "first", "last", "to")).alias("__kept"))
    kept = written(kept, "snippets-held")
    holders = kept.select("__doc", "__text_code")
    texts = keyed.join(F.broadcast(holders), ["__doc", "__text_code"], "left_semi") if kept.count() <= SHORT_LIST else keyed
    pieces = cut_snippets(texts.join(kept, ["__doc", "__text_code"]).select(*keyed.columns, "__kept"), text_at, window)
    found = pieces.groupBy("shard").applyInArrow(search_shard(window), f"anchor long, content long, found {SPANS}")
    found = cut_lineage(found)

    first_doc = held.select("anchor", "content", F.col("doc").alias("holder"))
    copies = shared.join(first_doc, ["anchor", "content"]).where("doc > holder")
    copies = copies.select("doc", "text_code", F.array(F.struct(F.col("first").alias("start"), (F.col("last") + window).alias("end"))).alias("spans"))
    moved = F.transform("found", lambda x: F.struct((x["start"] + F.col("first")).alias("start"), (x["end"] + F.col("first")).alias("end")))
    inside = held.join(found, ["anchor", "content"]).select("anchor", "content", "doc", "found")
    inside = shared.join(inside, ["anchor", "content", "doc"]).select("doc", "text_code", moved.alias("spans"))
    spans = copies.unionByName(inside).groupBy(F.col("doc").alias("__doc"), F.col("text_code").alias("__text_code"))
    spans = written(merged(spans.agg(F.flatten(F.collect_list("spans")).alias("__spans"))), "spans")
    if (spans.agg(F.sum(F.size("__spans"))).first()[0] or 0) <= SHORT_LIST:
        spans = F.broadcast(spans)
    spanned = keyed.join(spans, ["__doc", "__text_code"], "left").select(keyed["*"], "__spans")
    return drop_words(spanned, text_at, docs.schema.fields)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS id,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT rid, id, s, sha256(array_to_string(ws[s : s + 49], ' ')) AS h
      FROM (SELECT rid, id, ws, unnest(range(1, len(ws) - 48)) AS s FROM d WHERE len(ws) >= 50)),
least AS (SELECT h, min(id) AS id FROM w GROUP BY h),
gone AS (SELECT DISTINCT rid, unnest(range(s, s + 50)) AS i FROM w JOIN least USING (h) WHERE w.id > least.id),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
         FROM (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d) x
         ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
