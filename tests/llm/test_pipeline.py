"""The pipeline's stages against brute force, and the subpackage's queries against their SQL."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from colloquy.llm import mixing, queries
from colloquy.llm import toxicity as toxic
from tests.conftest import same_rows
from tests.llm.test_edges import DOCS, brute_repeats, documents, toxic_rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    same_rows(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_covers_its_table(spark, sf_dir, name):
    found = queries.QUERIES[name](spark, sf_dir)
    key = "page_id" if "page_id" in found.columns else "doc_id"
    rows = spark.read.parquet(f"{sf_dir}/{'pages' if key == 'page_id' else 'documents'}.parquet").count()
    assert found.select(key).distinct().count() == rows if name != "op1_mixing" else found.count() > 0.8 * rows


def shingles(text, k=5):
    words = (text or "").split()
    k = min(k, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def brute_classes(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)), key=lambda n: rows[n][0])
                parent[y] = x
    return [rows[find(i)][0] for i in range(len(rows))], links


def corpus(spark, sf_dir, n=200):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(n)


def test_jaccard_equals_brute_force(spark, sf_dir):
    rows = sorted((r["doc_id"], r["text"]) for r in corpus(spark, sf_dir).collect())
    classes, links = brute_classes(rows)
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in queries.QUERIES["op7_jaccard_join"](spark, sf_dir).collect()}
    assert found == {d: (c, n) for (d, _), c, n in zip(rows, classes, links, strict=True)}


def test_near_duplicates_keeps_one_of_each_group(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    docs = docs.unionByName(docs.where("doc_id < 5"))  # repeated rows
    rows = sorted((r["doc_id"], r["text"]) for r in docs.distinct().collect())
    classes, _ = brute_classes(rows)
    found = pipeline.near_duplicates(spark, docs, sf_dir)
    assert found.columns == docs.columns
    assert sorted(r["doc_id"] for r in found.collect()) == sorted(set(classes))


def test_rows_without_ids_are_documents_of_their_own(spark, sf_dir):
    rows = [(None, "a b c d e f g", "en", "s", 1), (None, "other words are here for you", "en", "s", 1), (None, None, None, None, None), (3, "a b c d e f g", "en", "s", 1)]
    found = pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), sf_dir).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in found) == [(-1, ""), (-1, "other words are here for you"), (3, "a b c d e f g")]


def test_rows_without_words_stay(spark, sf_dir):
    rows = [(None, None), (None, ""), (None, ""), (4, ""), (4, None), (5, " \n"), (5, " \n"), (3, "a b c d e f g"), (3, "a b c d e f g")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    found = pipeline.near_duplicates(spark, docs, sf_dir).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in found) == sorted((i or -1, t or "") for i, t in rows[:-1])


def test_decontaminate_stage_knows_items_without_ids(spark, tmp_path):
    item = "one two three four five six seven eight nine ten eleven"
    spark.createDataFrame([(None, item), (None, "other words"), (1, "alpha beta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate((f"so {item} it is", "clean text", "an alpha beta", "the other words"))], DOCS)
    assert [r["doc_id"] for r in pipeline.decontaminate(spark, docs, str(tmp_path)).collect()] == [1]


def test_substring_stage(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = {d: (kept if gone else text) for (d, n, gone, kept), (_, text) in zip(brute_repeats(rows), rows, strict=True) if n == 0 or gone < n}
    found = pipeline.substring(spark, docs, sf_dir)
    assert {r["doc_id"]: r["text"] for r in found.collect()} == expected
    assert found.columns == docs.columns


def test_toxic_stage(spark, tmp_path):
    rows, labels = toxic_rows(400)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r["doc_id"] for r in pipeline.toxicity(spark, spark.createDataFrame(rows, DOCS), str(tmp_path)).collect()}
    toxic = {d for d, _, t in labels if t}
    assert len(kept & toxic) <= 5
    assert len({d for d, _, t in labels if not t} - kept) <= 5


def plain_words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def contaminated(text, items):
    words = plain_words(text)
    for item in items:
        size = min(10, len(item))
        windows = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)}
        if size and any(tuple(words[i : i + size]) in windows for i in range(len(words) - size + 1)):
            return True
    return False


def test_stages_equal_brute_force(spark, sf_dir, tmp_path):
    """Each stage on all that its predecessor kept; the first by its own scores, of which the cut is checked."""
    docs = corpus(spark, sf_dir)
    stage = dict(pipeline.STAGES)

    def step(name, docs):
        stage[name](spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        found = spark.read.parquet(f"{tmp_path}/{name}")
        return found, sorted((r["doc_id"], r["text"]) for r in found.collect())

    scored = toxic.score_toxicity(docs, toxic.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).collect()
    docs, rows = step("toxicity", docs)
    assert rows == sorted((r["doc_id"], r["text"]) for r in scored if r["score"] < 0.3)
    classes, _ = brute_classes(rows)
    expected = [r for r in rows if r[0] in set(classes)]
    docs, rows = step("near_duplicates", docs)
    assert rows == expected
    expected = [(d, kept if gone else text) for (d, n, gone, kept), (_, text) in zip(brute_repeats(rows), rows, strict=True) if n == 0 or gone < n]
    docs, rows = step("substring_dedup", docs)
    assert rows == expected
    items = [plain_words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    expected = [r for r in rows if not contaminated(r[1], items)]
    assert len(expected) < len(rows)
    docs, rows = step("decontaminate", docs)
    assert rows == expected
    expected = sorted((r["doc_id"], r["text"], r["pass"]) for r in mixing.mix_sources(docs).collect())
    found = stage["mix"](spark, docs, sf_dir)
    assert sorted((r["doc_id"], r["text"], r["pass"]) for r in found.collect()) == expected


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_stages_keep_all_columns(spark, sf_dir, name, stage):
    """Extra columns named like those that the operators add or use, null rows, and an empty table."""
    names = ["n_words", "n_removed", "kept_text", "removed", "weight", "score", "predicted", "spans", "item_ids", "doc", "__doc", "__rest", "row", "pass"]
    docs = documents(spark).withColumns({n: F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in names})
    found = stage(spark, docs, sf_dir)
    assert found.columns[: len(docs.columns)] == docs.columns
    assert [f.dataType for f in found.schema][: len(docs.columns)] == [f.dataType for f in docs.schema]
    rows = found.collect()
    assert rows and all(r[n] == f"{n} of {'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for n in names)
    assert any(r["text"] is None for r in rows)
    assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_run_applies_all_stages(spark, sf_dir):
    found = pipeline.run(spark, sf_dir)
    docs = corpus(spark, sf_dir)
    assert 0 < found.select("doc_id").distinct().count() < docs.count()
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "decontaminate", "mix"]
