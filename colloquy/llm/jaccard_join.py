"""N-gram Jaccard join: MinHash bands name candidates, full 5-word shingle sets decide.

1. Each text gives the code of its shingle set and its band hashes; no text is shuffled.  Texts
   with the same set are one class from here on, so that copies cost a row each and no pairs.
2. Classes meet on their band hashes.  A bucket links its classes to its least one, not to each
   other, and connected buckets form candidate clusters: a pair that shares a band lies in one.
3. The clusters' texts are shuffled once more as shingle sets.  A cluster within the limits of a block is
   verified as a whole.  A larger one is cut into blocks: classes under the same least bucket-mate (a star)
   stay together, large stars are cut up and small ones packed.  Two blocks meet in a cell only if they share a
   bucket, and a class goes to a cell only if one of its own buckets reaches the other block.  So clusters
   that chance collisions chain together cost what their buckets hold, not the square of their size.
4. In a cell all pairs are counted exactly, over shingles that two or more sets share, and each pair lies in one
   cell.  No pair ever becomes a row: a cell gives each class its number of links and the least class of its
   component there.  These are aggregated by class before anything is joined, so that links
   towards the components are one for each class and one for each of the cells' least classes.
5. Components of verified links give the class id of each document.

``rows_and_bands`` takes the most rows a band with which the recall of a pair just at the threshold
reaches the target within the number of hashes allowed; at 0.8 that is 6 rows and 23 bands, which miss
fewer than one such pair in 1,000, and fewer the more alike they are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import NO_ID, WordCodes, arrow_map, cut_lineage, doc_key, gram_codes, mix, slices, table, text_key, utf8
from colloquy.llm.components import components

SHINGLE = 5
THRESHOLD = (4, 5)  # as a fraction: decided in whole numbers
RECALL = 0.999
MOST_HASHES = 144

#: Classes and shingles that a block has on the average at most.
BLOCK = 1024
BLOCK_SHINGLES = 400_000

#: Sets that share a shingle: up to here they are counted as pairs, beyond as bits, so many shingles at a time.
FEW = 16
BIT_COLUMNS = 4096

#: Shingles in a group of whole clusters, and the least number of such groups.
GROUP_SHINGLES = 500_000
LEAST_GROUPS = 256


def rows_and_bands(threshold: float, recall: float, most: int) -> tuple[int, int]:
    best = None
    for rows in range(1, most + 1):
        miss = 1 - threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(miss)) if miss > 0 else 1
        if rows * bands <= most:
            best = rows, bands
    if best is None:
        raise ValueError("no band count reaches this recall within the hashes allowed")
    return best


def shingle_set(words: list[bytes], codes_of: WordCodes, k: int) -> np.ndarray:
    """Sorted distinct codes of the runs of ``k`` words; a shorter text is one run."""
    return np.unique(gram_codes(codes_of.of(words), min(k, len(words)))) if words else np.empty(0, np.uint64)


def band_hashes(shingles: np.ndarray, factors: np.ndarray, offsets: np.ndarray, rows: int) -> np.ndarray:
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for strip in slices(len(shingles), 1024):
        hashed = np.multiply.outer(factors, shingles[strip])
        hashed += offsets[:, None]
        np.minimum(least, hashed.min(axis=1), out=least)
    return gram_rows(least.reshape(-1, rows))


def gram_rows(x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x), np.uint64)
    for column in x.T:
        total = mix(total ^ column) * np.uint64(0x9E3779B97F4A7C15)
    return mix(total)


def signatures(docs: DataFrame, k: int, rows: int, bands: int) -> DataFrame:
    codes_of = WordCodes()
    seeds = np.random.default_rng(7).integers(1, 1 << 63, size=(2, rows * bands), dtype=np.uint64)
    factors, offsets = seeds[0] | np.uint64(1), seeds[1]

    def scan(batch: pa.RecordBatch):
        for part in slices(batch.num_rows, 1000):
            rows_in = batch.slice(part.start, part.stop - part.start)
            sets, sizes, bands_out = [], [], []
            for text in utf8(rows_in.column(2)):
                own = shingle_set(text.split() if text else [], codes_of, k)
                sizes.append(len(own))
                sets.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                bands_out.append(band_hashes(own, factors, offsets, rows).view(np.int64) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [rows_in.column(0), rows_in.column(1), pa.array(sets, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands_out, pa.list_(pa.int64()))],
                names=["doc", "text_code", "set", "size", "bands"],
            )

    return arrow_map(docs, scan, "doc long, text_code long, set binary, size long, bands array<long>")


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Shingles that each of the rows ``left`` of ``sets`` has in common with each of the rows ``right``."""
    n = len(sets)
    where = np.unique(np.concatenate(sets), return_inverse=True)[1]
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(where, kind="stable")
    row, where = row[order], where[order]
    counts = np.bincount(where)
    first = np.cumsum(counts) - counts
    pairs = [np.empty(0, np.int64)]
    for d in range(2, FEW + 1):
        owners = row[first[counts == d][:, None] + np.arange(d)]  # a line for each shingle that d sets share
        for i in range(d - 1):
            pairs.append((owners[:, i, None] * n + owners[:, i + 1 :]).ravel())
    place = np.full((2, n), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros(len(left) * len(right), np.int64)
    pairs = np.concatenate(pairs)
    for x, y in ((pairs // n, pairs % n), (pairs % n, pairs // n)):
        x, y = place[0, x], place[1, y]
        inside = (x >= 0) & (y >= 0)
        out += np.bincount(x[inside] * len(right) + y[inside], minlength=len(out))
    out = out.reshape(len(left), len(right))
    often = counts > FEW
    column = np.cumsum(often) - 1
    row, where = row[often[where]], column[where[often[where]]]
    for strip in slices(int(often.sum()), BIT_COLUMNS):
        own = slice(*np.searchsorted(where, (strip.start, strip.stop)))
        bits = np.zeros((n, BIT_COLUMNS), bool)
        bits[row[own], where[own] - strip.start] = True
        words = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        b = words[right]
        for i, x in enumerate(words[left]):
            out[i] += np.bitwise_count(x & b).sum(axis=1, dtype=np.int64)
    same = np.intersect1d(left, right)  # a row has all of its own shingles, also those of no other
    out[place[0, same], place[1, same]] = [len(sets[i]) for i in same]
    return out


def verified(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Which pairs of the rows ``left`` and ``right`` of ``sets`` reach the threshold."""
    sizes = np.array([len(s) for s in sets], np.int64)
    common = common_counts(sets, left, right)
    union = sizes[left][:, None] + sizes[right][None, :] - common
    return common * threshold[1] >= union * threshold[0]


def link_group(threshold: tuple[int, int]):
    def run(rows: pa.Table) -> pa.Table:
        cluster, cell_a, cell_b = (rows.column(c).to_numpy() for c in ("cluster", "cell_a", "cell_b"))
        block, rep, copies = (rows.column(c).to_numpy() for c in ("block", "rep", "copies"))
        raw = rows.column("shingles").to_pylist()
        order = np.lexsort((rep, cell_b, cell_a, cluster))
        turn = np.flatnonzero((np.diff(cluster[order]) != 0) | (np.diff(cell_a[order]) != 0) | (np.diff(cell_b[order]) != 0)) + 1
        out_rep, out_root, out_links, out_texts = [], [], [], []
        for members in np.split(order, turn):
            sets = [np.frombuffer(raw[i], np.uint64) for i in members]
            a, b = cell_a[members[0]], cell_b[members[0]]
            left, right = np.flatnonzero(block[members] == a), np.flatnonzero(block[members] == b)
            if len(left) == 0 or len(right) == 0:
                continue
            hit = verified(sets, left, right, threshold)
            if a == b:
                np.fill_diagonal(hit, False)
            degree, texts = np.zeros(len(members), np.int64), np.zeros(len(members), np.int64)
            weight = copies[members]
            degree[left] += hit @ weight[right]
            texts[left] += hit.sum(axis=1)
            if a != b:
                degree[right] += weight[left] @ hit
                texts[right] += hit.sum(axis=0)
            root = np.arange(len(members))
            while True:  # members are in the order of rep: the least position is the least rep
                new = root.copy()
                low = np.where(hit, root[right][None, :], len(members)).min(axis=1)
                new[left] = np.minimum(new[left], low)
                low = np.where(hit, root[left][:, None], len(members)).min(axis=0)
                new[right] = np.minimum(new[right], low)
                new = new[new]
                if (new == root).all():
                    break
                root = new
            for i in np.flatnonzero(texts):
                out_rep.append(rep[members[i]])
                out_root.append(rep[members[root[i]]])
                out_links.append(degree[i])
                out_texts.append(texts[i])
        return pa.table({n: pa.array(v, pa.int64()) for n, v in (("rep", out_rep), ("root", out_root), ("links", out_links), ("texts", out_texts))})

    return run


def shingle_rows(clustered: DataFrame, text_at: int, k: int) -> DataFrame:
    codes_of = WordCodes()
    at = clustered.schema.names.index
    names = ["cluster", "rep", "copies", "block", "others"]

    def scan(batch: pa.RecordBatch):
        for part in slices(batch.num_rows, 500):
            rows = batch.slice(part.start, part.stop - part.start)
            sets = [shingle_set(t.split(), codes_of, k).tobytes() for t in utf8(rows.column(text_at))]
            yield pa.RecordBatch.from_arrays([*(rows.column(at(n)) for n in names), pa.array(sets, pa.binary())], names=[*names, "shingles"])

    return arrow_map(clustered, scan, "cluster long, rep long, copies long, block long, others array<long>, shingles binary")


def bucket_members(classes: DataFrame) -> DataFrame:
    """rep, bucket and the bucket's least rep, for buckets of two classes or more."""
    every = classes.select("rep", F.posexplode("bands").alias("band", "hash"))
    full = every.groupBy("band", "hash").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").drop("most")
    return every.join(cut_lineage(full), ["band", "hash"]).select("rep", F.xxhash64("band", "hash").alias("bucket"), "least")


def in_blocks(members: DataFrame, most: int, most_shingles: int) -> DataFrame:
    """Adds ``block`` to the members of clusters that are too large for one; it is null for others."""
    needed = lambda: F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum("size") / most_shingles)).cast("long")
    large = cut_lineage(members.groupBy("cluster").agg(needed().alias("blocks")).where("blocks > 1").select("cluster"))
    stars = members.join(large, "cluster", "left_semi").groupBy("cluster", "star").agg(needed().alias("blocks"), F.count("*").alias("m"), F.sum("size").alias("total"))
    stars = cut_lineage(stars)
    packed = F.greatest(F.ceil(F.sum("m") / most), F.ceil(F.sum("total") / most_shingles)).cast("long")
    packed = stars.where("blocks = 1").groupBy("cluster").agg(packed.alias("packs"))
    stars = stars.select("cluster", "star", "blocks").join(packed, "cluster", "left")
    cut = F.xxhash64(F.lit(1), "cluster", "star", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    pack = F.xxhash64(F.lit(2), "cluster", F.pmod(F.xxhash64("star"), F.col("packs")))
    block = F.when(F.col("blocks") > 1, cut).when(F.col("blocks") == 1, pack)
    return members.join(stars, ["cluster", "star"], "left").withColumn("block", block).drop("blocks", "packs", "star")


def cells_of(held: DataFrame, members: DataFrame) -> DataFrame:
    """rep and ``others``: the blocks, but its own, that the buckets of a class reach.

    A bucket tells its list of blocks by the list's code: large stars have many buckets with the same list, and a
    class takes each list once.
    """
    placed = members.where("block is not null").select("rep", "block")
    lists = held.join(placed, "rep").select("bucket", "block").distinct().groupBy("bucket").agg(F.array_sort(F.collect_list("block")).alias("blocks"))
    lists = cut_lineage(lists.where(F.size("blocks") > 1).withColumn("list", F.xxhash64("blocks")))
    taken = held.join(lists.select("bucket", "list"), "bucket").select("rep", "list").distinct()
    reached = taken.join(lists.select("list", "blocks").dropDuplicates(["list"]), "list").groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("blocks"))
    reached = reached.join(placed, "rep").select("rep", F.filter("blocks", lambda b: b != F.col("block")).alias("others"))
    return cut_lineage(reached.where(F.size("others") > 0))


def root_links(linked: DataFrame) -> DataFrame:
    """a and b: each class with the least root that its cells (or buckets) gave it, and that root with their other roots."""
    least = F.min("root").over(Window.partitionBy("rep"))
    told = linked.select("rep", "root", least.alias("least"))
    links = told.select(F.explode(F.array(F.struct(F.col("rep").alias("a"), F.col("least").alias("b")), F.struct(F.col("root").alias("a"), F.col("least").alias("b")))).alias("x"))
    return links.select("x.*").where("a <> b").distinct()


def jaccard_classes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    threshold: tuple[int, int] = THRESHOLD,
    recall: float = RECALL,
    most_hashes: int = MOST_HASHES,
    block: int = BLOCK,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """One row per row of ``docs``: doc, text_code, class_id, class_text, n_links, n_copies and copy_id.

    ``class_id`` is the least id that a chain of links reaches (``class_text`` the code of that row's text), ``n_links`` the number of other rows
    whose shingle sets are at least ``threshold`` alike, equal ones included; ``copy_id`` is the least id
    with the same set and ``n_copies`` the number of rows with it.  A text of fewer than
    ``shingle`` words is one shingle; null and empty texts have none and link to nothing.  A row without
    an id counts as the largest id.  Other columns of ``docs`` are not read.
    """
    rows, bands = rows_and_bands(threshold[0] / threshold[1], recall, most_hashes)
    keyed = docs.select(doc_key(id_col).alias("doc"), text_key(text_col).alias("text_code"), F.col(text_col).alias("text"))
    signed = cut_lineage(signatures(keyed, shingle, rows, bands))
    classes = signed.where("set is not null").groupBy("set").agg(
        F.min(F.struct("doc", "text_code")).alias("x"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands")
    )
    classes = cut_lineage(classes.select("set", F.xxhash64("set").alias("rep"), F.col("x.doc").alias("doc"), F.col("x.text_code").alias("text_code"), "copies", "size", "bands"))

    held = cut_lineage(bucket_members(classes))
    clusters = components(root_links(held.select("rep", F.col("least").alias("root"))))
    stars = held.groupBy("rep").agg(F.min("least").alias("star"))
    members = classes.join(clusters.withColumnRenamed("node", "rep"), "rep").join(stars, "rep")
    members = cut_lineage(in_blocks(members.select("doc", "text_code", "rep", "copies", "size", F.col("root").alias("cluster"), "star"), block, block_shingles))
    members = members.join(cells_of(held, members), "rep", "left")
    apart = keyed.dropDuplicates(["doc", "text_code"]) if repeated(signed) else keyed
    sets = shingle_rows(apart.join(members, ["doc", "text_code"]), 2, shingle)

    total = members.where("block is null").agg(F.sum("size")).first()[0] or 0
    n_groups = max(LEAST_GROUPS, total // GROUP_SHINGLES)
    whole = F.pmod(F.xxhash64("cluster"), F.lit(n_groups)).cast("long")
    cell = F.lit(-1).cast("long") - F.pmod(F.xxhash64("cell_a", "cell_b"), F.lit(1 << 40))
    own = F.coalesce("block", F.lit(0).cast("long"))
    to = F.concat(F.array(own), F.coalesce("others", F.array().cast("array<long>")))
    dealt = sets.select("cluster", "rep", "copies", "shingles", own.alias("own"), F.explode(to).alias("other"), F.col("block").isNull().alias("whole"))
    dealt = dealt.select("cluster", "rep", "copies", "shingles", F.col("own").alias("block"), F.least("own", "other").alias("cell_a"), F.greatest("own", "other").alias("cell_b"), "whole")
    groups = dealt.withColumn("group", F.when(F.col("whole"), whole).otherwise(cell)).drop("whole").groupBy("group")
    linked = cut_lineage(groups.applyInArrow(link_group(threshold), "rep long, root long, links long, texts long"))

    roots = components(root_links(linked))
    degree = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    ids = classes.join(roots, classes["rep"] == roots["node"], "left").select("set", "rep", "doc", "text_code", "copies", F.coalesce("root", "rep").alias("root"))
    least = ids.groupBy("root").agg(F.min(F.struct("doc", "text_code")).alias("least"))
    least = least.select("root", F.col("least.doc").alias("class_id"), F.col("least.text_code").alias("class_text"))
    told = cut_lineage(ids.join(least, "root").join(degree, "rep", "left").select("set", "class_id", "class_text", "copies", F.col("doc").alias("copy_id"), F.coalesce("links", F.lit(0)).alias("links")))
    out = signed.join(told, "set", "left")
    return out.select(
        "doc",
        "text_code",
        F.coalesce("class_id", "doc").alias("class_id"),
        F.coalesce("class_text", "text_code").alias("class_text"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("copy_id", "doc").alias("copy_id"),
    )


def repeated(signed: DataFrame) -> bool:
    """Whether whole rows recur, id and text."""
    return signed.groupBy("doc", "text_code").count().where("count > 1").limit(1).count() > 0


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    found = jaccard_classes(table(spark, sf_dir, "documents"))
    return found.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "class_id", "n_links", "n_copies", "copy_id")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(ws[i : i + least(5, len(ws)) - 1], ' ') AS g
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
c AS (SELECT a.rid AS i, b.rid AS j, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL),
l AS (SELECT i, j, c, x.n AS ni, y.n AS nj FROM c JOIN n x ON x.rid = i JOIN n y ON y.rid = j WHERE 5 * c >= 4 * (x.n + y.n - c)),
r(a, b) AS (SELECT rid, rid FROM d UNION SELECT r.a, l.j FROM r JOIN l ON l.i = r.b),
k AS (SELECT a AS rid, min(id) AS class_id FROM r JOIN d ON d.rid = r.b GROUP BY a),
m AS (SELECT i AS rid, count(*) AS n_links, count(*) FILTER (c = ni AND c = nj) AS same, min(d.id) FILTER (c = ni AND c = nj) AS first FROM l JOIN d ON d.rid = l.j GROUP BY i)
SELECT doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, (coalesce(same, 0) + 1)::BIGINT AS n_copies, least(coalesce(first, id), id) AS copy_id
FROM d JOIN k USING (rid) LEFT JOIN m USING (rid)
"""
