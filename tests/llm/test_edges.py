"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for each operator."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.llm import decontaminate, gru, html_text, jaccard_join, mixing, substring_dedup, topk, toxicity, url_filter, warc, weak_labels

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))


def documents(spark):
    rows = [
        (1, "alpha beta gamma delta epsilon zeta " + PASSAGE, "en", "a", 1),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, LONG, "en", "b", 5),
        (5, LONG, "en", "b", 5),
        (5, LONG, "en", "b", 5),
        (None, PASSAGE + " tail", "en", None, 3),
        (None, None, None, None, None),
        (6, "  \t\n ", "en", "a", 2),
        (7, "one two", "en", "a", 2),
        (8, "one two", "en", "a", 2),
        (9, "über straße 日本語 ☃ " * 20, "de", "c", 9),
    ]
    return spark.createDataFrame(rows, DOCS)


def crowded(df, *names):
    """With extra columns named like those that the operator uses."""
    return df.withColumns({n: F.lit("extra") for n in names})


def benchmark(spark):
    return spark.createDataFrame([(1, "Alpha, BETA gamma delta"), (2, None), (3, ""), (None, "one two"), (4, "日本語 ☃ über"), (4, "日本語 ☃ über")], "item_id long, text string")


def test_decontaminate(spark):
    docs = crowded(documents(spark), "spans", "item_id", "words", "n_words")
    for per_block in (1, 100):
        found = decontaminate.find_contamination(docs, benchmark(spark), per_block=per_block)
        rows = found.select("doc_id", "n_words", "item_ids", F.size("spans").alias("n")).collect()
        assert len(rows) == 12
        assert {r["doc_id"]: r["item_ids"] for r in rows if r["n"]} == {1: ["1"], 9: ["4"]}
    assert decontaminate.find_contamination(docs.limit(0), benchmark(spark)).count() == 0
    assert decontaminate.find_contamination(docs, benchmark(spark).limit(0)).where(F.size("spans") > 0).count() == 0


def brute_repeats(rows, window=50):
    first = {}
    for doc, text in rows:
        words = (text or "").split()
        for s in range(len(words) - window + 1):
            key, rank = tuple(words[s : s + window]), float("inf") if doc is None else doc
            first[key] = min(first.get(key, rank), rank)
    out = []
    for doc, text in rows:
        words, rank = (text or "").split(), float("inf") if doc is None else doc
        gone = {i for s in range(len(words) - window + 1) if first[tuple(words[s : s + window])] < rank for i in range(s, s + window)}
        out.append((doc, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def test_substring_dedup(spark, monkeypatch):
    docs = crowded(documents(spark), "doc", "spans", "words", "anchor", "kept", "text_code", "n_removed", "__doc", "__text_code", "__kept", "__spans", "own__doc")
    expected = sorted(map(repr, brute_repeats([(r["doc_id"], r["text"]) for r in docs.collect()])))
    for block, short in ((256, 1000), (1, 0)):
        monkeypatch.setattr(substring_dedup, "BLOCK", block)
        monkeypatch.setattr(substring_dedup, "SHORT_LIST", short)
        found = substring_dedup.remove_repeats(docs)
        assert set(docs.columns) <= set(found.columns)
        got = sorted(repr(tuple(r)) for r in found.select("doc_id", "n_words", "n_removed", "kept_text").collect())
        assert got == expected
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_substring_dedup_of_a_crowded_anchor(spark, monkeypatch):
    """A passage in many contexts, some of them shared by a few documents only."""
    passage = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join([*(f"a{i % 7}.{j}" for j in range(25)), *passage, *(f"b{i % 5}.{j}" for j in range(25))])) for i in range(40)]
    rows += [(100 + i, " ".join([f"x{i}", *passage, *(f"y{i}.{j}" for j in range(30))])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted(map(repr, brute_repeats(rows)))
    for block in (1, 8, 30):
        monkeypatch.setattr(substring_dedup, "BLOCK", block)
        found = substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_text")
        assert sorted(repr(tuple(r)) for r in found.collect()) == expected


def test_jaccard(spark):
    words = [f"v{i}" for i in range(200)]
    near = [(100 + j, " ".join([*words[:50], f"x{j}", *words[51:]]), "en", "s", 1) for j in range(12)]
    docs = documents(spark).unionByName(spark.createDataFrame(near, DOCS))
    docs = crowded(docs, "doc", "set", "rep", "cluster", "block")
    for block in (1024, 3):
        found = jaccard_join.jaccard_classes(docs, block=block).collect()
        assert len(found) == 24
        by = {r["doc"]: r for r in found}
        assert {by[100 + j]["class_id"] for j in range(12)} == {100}
        assert {by[100 + j]["n_links"] for j in range(12)} == {11}
        assert (by[5]["class_id"], by[5]["n_links"], by[8]["class_id"], by[3]["class_id"], by[6]["n_links"]) == (4, 2, 7, 3, 0)
    assert jaccard_join.jaccard_classes(docs.limit(0)).count() == 0


def test_mixing(spark):
    docs = crowded(documents(spark), "total", "whole", "passes", "tokens", "pass", "weight", "_source", "row")
    found = mixing.mix_sources(docs)
    assert found.where("text is null").count() == 2
    assert found.where("doc_id = 4 and pass = 0").count() <= 1
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mix_sources(documents(spark).where("doc_id = 3")).count() == 1


def test_mixing_meets_budgets(spark):
    rows = [(i, "t " * 20, "en", "big" if i % 10 else "small", 1) for i in range(4000)]
    docs = spark.createDataFrame(rows, DOCS)
    found = mixing.mix_sources(docs, evenness=1.0, most_passes=3.0)
    got = {r["source"]: (r["n"], r["w"]) for r in found.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.first("weight").alias("w")).collect()}
    assert got["small"][1] == pytest.approx(0.3, abs=1e-6)  # three passes over a tenth
    for n, weight in got.values():
        assert n == pytest.approx(weight * 80_000, rel=0.02)
    copies = {r["c"] for r in found.where("source = 'small'").groupBy("doc_id").agg(F.count("*").alias("c")).collect()}
    assert copies <= {2, 3}


def toxic_rows(n):
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [f"{a}{b}" for a in ("ka", "lo", "mi") for b in ("ra", "to", "su", "ne")]
        text = [words[(i * 7 + j * 5 + j * j) % 12] for j in range(10 + i % 60)]
        if toxic:
            text[i % len(text)] = ("awful", "rotten")[i // 4 % 2]
        rows.append((i, " ".join(text), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_learns_and_handles_edges(spark):
    rows, labels = toxic_rows(400)
    docs = spark.createDataFrame(rows, DOCS)
    known = spark.createDataFrame([*labels, (None, 1, 1), (1, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, known)
    everything = crowded(docs.unionByName(documents(spark).where("doc_id is null or doc_id in (2, 3, 6, 9)")), "toxic", "score", "id", "bag")
    found = {r["doc_id"]: r for r in toxicity.score_toxicity(everything, model).collect() if r["doc_id"] is not None}
    held = [i for i in range(10, 400) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum(found[i]["predicted"] == labels[i][2] for i in held)
    assert right / len(held) > 0.95
    echo = spark.createDataFrame([(i, f"{w} " * 40, "en", "s", 1) for i, w in enumerate(rows[21][1].split()[:5])], DOCS)
    assert all(r["predicted"] == 0 for r in toxicity.score_toxicity(echo, model).collect())
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_toxicity_scores_every_window(spark):
    class Heard:  # a window's logit is high only if it begins with this word's row
        h = 1

        def projected(self, words):
            return np.array([[float(w == b"first")] * 6 for w in words], np.float32)

        def logits(self, gates, mask):
            return gates[0, :, 0]

        def every_logit(self, gates, length):
            return gates[0, : gates.shape[1] - length + 1]

    for at in (0, 5, 12, 35):
        words = [b"w%d" % i for i in range(60)]
        words[at] = b"first"
        found = toxicity.Scorer(Heard()).features([words, words[:3]])
        assert found[0, 0] == 1 and found[0, 2] == pytest.approx(np.log(60 - toxicity.LENGTH + 1))
    assert [len(p) for p in toxicity.parts([None, b"x" * toxicity.PART, b"y", b"z"])] == [2, 2]
    assert toxicity.parts([]) == []


def test_toxicity_without_labels(spark):
    docs = documents(spark)
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["score"] for r in toxicity.score_toxicity(docs, model).collect()} == {0.0}


def test_held_out_is_crc32(spark):
    found = spark.range(200).withColumnRenamed("id", "doc_id").select("doc_id", toxicity.held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)


def test_url_filter(spark):
    urls = ["https://X.Example.COM/en/1", "https://www.example.com/en/1?x", "http://a.net/es/1", "http://net/fr/", "http://a.org/1", "http://a.com", "no scheme", "", None, "http://a.net/en/ü", "http://notnet/es/1"]
    pages = crowded(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), "rule", "text", "host", "cells", "said", "row", "cut")
    found = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert [found[i]["rule"] for i in range(11)] == ["example.com/en/", "www.example.com/en/", "net/es/", "net/fr/", None, None, None, None, None, None, None]
    assert (found[0]["host"], found[0]["path"]) == ("x.example.com", "/en/1")
    assert (found[8]["host"], found[8]["path"], found[5]["path"]) == ("", "", "")
    assert {r["verdict"] for r in found.values()} <= {"allow", "block"}
    assert url_filter.judge(pages.limit(0)).count() == 0
    nothing = url_filter.judge(pages.where("page_id = 4")).first()
    assert nothing["verdict"] == "allow"


def test_url_filter_is_native(spark, sf_dir):
    plan = url_filter.op5_url_filter(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_topk(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]), (7, []), (8, [-1.0]), (None, [9.0, 9.0]), (9, [1.0, 0.0])]
    table = topk.whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    for query_block in (1, 100):
        found = [tuple(r) for r in topk.top_k(crowded(table, "id", "v", "score"), table.where("vec_id % 50 = 0"), query_block=query_block).orderBy("query_id", "rank").collect()]
        assert found[:5] == [(0, 1, 1, 65536), (0, 2, 2, 65536), (0, 3, 9, 65536), (0, 4, 50, 32768), (0, 5, 7, 0)]
        assert [x[2] for x in found[5:]] == [0, 1, 2, 9, 7]
    assert topk.top_k(table.limit(0), table.limit(0)).count() == 0


def test_topk_refuses_inexact_products(spark):
    rows = spark.createDataFrame([(1, [2**30, 1]), (2, [2**30, 5])], "vec_id long, vector array<long>")
    with pytest.raises(Exception, match="exactly"):
        topk.top_k(rows, rows).collect()


def test_topk_asks_each_of_repeated_queries(spark, duck):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (50, [1.0, 1.0]), (50, [1.0, 1.0]), *((i, [i / 16, 1 - i / 16]) for i in range(1, 9)), (3, [0.5, 0.25])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = topk.whole_numbers(table)
    expected = duck.execute(topk.ORACLE_SQL.replace("FROM embeddings", "FROM (VALUES " + ", ".join(f"({i}::BIGINT, {v}::DOUBLE[])" for i, v in rows) + ") t(vec_id, embedding)")).fetchall()
    for query_block in (1, 100):
        found = topk.top_k(whole, whole.where("vec_id % 50 = 0"), query_block=query_block)
        assert sorted(tuple(r) for r in found.collect()) == sorted(expected)


def test_warc_round_trip(spark, tmp_path):
    same = "<p>" + "x" * 200
    rows = [(5, "http://a/\r\nX: y", same), (2, "http://b/", same), (9, None, same), (1, "u", "short"), (3, "u", "short"), (4, "v", None), (6, "v", ""), (None, "w", same), (7, "ü", "é" * 60), (2, "http://again/", same)]
    pages = crowded(spark.createDataFrame(rows, "page_id long, url string, html string"), "digest", "payload", "rank", "size", "row")
    folder = f"file://{tmp_path}/archive"
    warc.write_archive(pages, folder)
    assert spark.read.parquet(f"{folder}/payloads").count() == 4
    archive = warc.read_archive(spark, folder)
    found = [(r["page_id"], r["record_type"], r["refers_to"], len(r["payload"])) for r in warc.parsed(archive).collect()]
    expected = [(5, "revisit", 2, 203), (2, "response", None, 203), (2, "revisit", 2, 203), (9, "revisit", 2, 203), (None, "revisit", 2, 203), (7, "response", None, 120)]
    expected += [(i, "response", None, n) for i, n in ((1, 5), (3, 5), (4, 0), (6, 0))]
    assert sorted(map(str, found)) == sorted(map(str, expected))
    for r in warc.records(archive).collect():
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        length = int(dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])[b"Content-Length"])
        assert rest[length:] == b"\r\n\r\n"
    empty = f"file://{tmp_path}/empty"
    warc.write_archive(pages.limit(0), empty)
    assert warc.read_archive(spark, empty).count() == 0


def test_warc_headers_hold_any_url(spark, tmp_path):
    forged = "WARC-Refers-To: <urn:page:77>{0}WARC-Payload-Digest: sha256:" + "0" * 64
    ends = ["\r\n", "\n", "\r", "\u0085", "\u2028", "\u2029", "\x0b", "\x0c", "\x00", "\x1e"]
    rows = [(i, f"http://a/{i}{e}" + forged.format(e), f"{i}" * 200) for i, e in enumerate(ends)]
    rows += [(50, "http://ü/%20?q=日本", "x" * 300), (51, "WARC-Refers-To: <urn:page:7>\\r\\n", "𝒳\n" * 100_000)]
    folder = f"file://{tmp_path}/archive"
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    found = {r["page_id"]: r for r in warc.parsed(warc.read_archive(spark, folder)).collect()}
    assert len(found) == len(rows)
    for page, url, html in rows:
        r = found[page]
        assert (r["record_type"], r["refers_to"], bytes(r["payload"]).decode()) == ("response", None, html)
        assert r["payload_digest"] == hashlib.sha256(html.encode()).hexdigest()
        assert r["url"] == (url if page >= 50 else r["url"])
    assert found[3]["url"].startswith("http://a/3%C2%85WARC-Refers-To") and found[0]["url"].startswith("http://a/0%0D%0AWARC")


def test_warc_refuses_a_changed_payload(spark, tmp_path):
    folder = f"file://{tmp_path}/archive"
    warc.write_archive(spark.createDataFrame([(1, "u", "body")], "page_id long, url string, html string"), folder)
    spark.createDataFrame([("0" * 64, bytearray(b"other"))], "digest string, payload binary").write.mode("append").parquet(f"{folder}/payloads")
    headers = spark.read.parquet(f"{folder}/headers").withColumn("digest", F.lit("0" * 64))
    headers.write.mode("append").parquet(f"{folder}/headers")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archive(spark, folder).collect()


PAGES = "page_id long, url string, html string"


def texts(spark, rows, *extra):
    pages = crowded(spark.createDataFrame(rows, PAGES), *extra)
    return {r["page_id"]: r["main_text"] for r in html_text.extract_text(pages).collect()}


def test_html_markup(spark):
    page = (
        '<html><head><title>T</title><style>p{}</style></head><body><header>H</header><nav><ul><li><a href="/x">X</a></ul></nav>'
        '<div class="cookie-notice">We use <b>cookies</b></div><article class="post"><h1>One &amp; two</h1><p>a <b>b</b>c<br>d<p>e&nbsp; f'
        '<script>var t = "</p>";</script><form><input>go</form><div class="comments"><p>hi</p></div><aside>s</aside><ul><li>g<li>h</ul></article><footer>&copy;</footer>'
    )
    found = texts(spark, [(1, "http://a/1", page), (2, None, None), (3, "http://a/2", ""), (None, "x", "plain"), (4, "http://b/1", "<p>cut <b>off"), (5, "http://b/2", "<!-- open")], "main_text", "n_shared", "host", "path", "kinds", "page", "code", "drop", "_drop")
    assert found == {1: "One & two a bc d e f g h", 2: "", 3: "", None: "plain", 4: "cut off", 5: ""}
    assert html_text.extract_text(spark.createDataFrame([], PAGES)).count() == 0


def test_html_tags_and_names(spark):
    inside = {
        "<p title=don't>Hello world</p><p>it's second</p>": "Hello world it's second",
        '<p title="a > b" data-x=\'"\'>one</p>': "one",
        '<p class="it>odd</p><p>next</p>': "odd next",
        "<section id='social-history'><p>Labour</p></section>": "Labour",
        "<div class='post-header'><h1>Title</h1></div><div class=search-results>kept</div>": "Title kept",
        "<div class='comment-list'>no</div><div class='cookieBanner x'>no</div><aside>no</aside><div class='share'>no</div><p>yes</p>": "yes",
        "<div id=sidebar-2>no</div><div role=navigation>no</div><p>a&amp;b &#x41;&nbsp;c</p>": "a&b A c",
    }
    rows = [(i, f"http://h{i}/", f"<body><div>out</div><article>{x}</article></body>") for i, x in enumerate(inside)]
    assert list(dict(sorted(texts(spark, rows).items())).values()) == list(inside.values())
    long = "<p>" + "</p><p>".join(f"word{i} &lt;" for i in range(60_000))
    assert len(texts(spark, [(1, "http://a/1", long), (2, "http://a/2", long + "<p>more")])[1].split()) == 120_000


def test_html_doubtful_lines_are_judged_by_differencing(spark):
    page = lambda *p: "<body><article>" + "".join(p) + "</article></body>"
    header, own = "<div class='post-header'>The Site</div>", lambda x: f"<div class='post-header'>{x}</div>"
    rows = [(1, "http://h/1", page(header, own("First"), "<p>same passage</p><p>one</p>")), (2, "http://h/2", page(header, own("Second"), "<p>same passage</p><p>two</p>"))]
    found = {r["page_id"]: (r["main_text"], r["n_shared"]) for r in html_text.extract_text(spark.createDataFrame(rows, PAGES), id_col="page_id").collect()}
    # the doubtful line that both have goes; the article's own passage stays though both have it
    assert found == {1: ("First same passage one", 1), 2: ("Second same passage two", 1)}


def test_html_differencing(spark):
    shell = lambda *p: "<body><div>Site name</div><div>Home</div>" + "".join(f"<p>{x}</p>" for x in p) + "<div>All rights reserved</div></body>"
    rows = [(1, "http://h/a/1", shell("first", "shared? no")), (2, "http://h/a/2", shell("second")), (3, "http://h/a/2", shell("second")), (4, "http://other/a/2", shell("alone"))]
    found = texts(spark, rows)
    assert found[1] == "first shared? no"
    assert found[2] == "second"
    assert found[4] == "Site name Home alone All rights reserved"
    mirror = [(1, "http://h/1", shell("same")), (2, "http://h/2", shell("same"))]
    assert texts(spark, mirror) == {1: "Site name Home same All rights reserved", 2: "Site name Home same All rights reserved"}


def test_html_copies_share_their_deletions(spark, monkeypatch):
    shell = lambda *p, nav="": f"<body><nav>{nav}</nav><div>Site name</div><div>Home</div>" + "".join(f"<p>{x}</p>" for x in p) + "<div>All rights reserved</div></body>"
    copies = [(10 + i, f"http://h/a/2?ref={i}", shell("second", nav=f"item {i % 3}")) for i in range(7)]
    rows = [(1, "http://h/a/1", shell("first")), *copies, (None, "http://h/a/2", shell("second")), (3, "http://h/a/3", shell("third")), (4, "http://h/a/2/x", None)]
    # the nearest page of k/2 has all of its lines, the other one doesn't
    rows += [(5, "http://k/1", shell("one")), (6, "http://k/2", shell("two")), (7, "http://k/22", shell("two", "more"))]
    for short_list in (html_text.SHORT_LIST, 0):
        monkeypatch.setattr(html_text, "SHORT_LIST", short_list)
        found = texts(spark, rows)
        assert {found[r[0]] for r in copies} | {found[None]} == {"second"}
        assert (found[1], found[3], found[4], found[6]) == ("first", "third", "", "two")


def test_quality(spark):
    good = [(i, f"The cat of the house {i} sat in the sun and it is warm. It was a day of rest.\nThe end of it came to us.\nAnd that is all of it." * 3, "en", "s", 1) for i in range(60)]
    poor = [(100 + i, "BUY!! NOW!! $$$ ### %%% 12345 " * (5 + i % 3), "en", "s", 1) for i in range(30)]
    docs = crowded(spark.createDataFrame([*good, *poor], DOCS).unionByName(documents(spark)), "quality", "kept", "n", "length")
    _, scorer = weak_labels.fit_quality(docs)
    found = {r["doc_id"]: r["kept"] for r in weak_labels.score_quality(docs, scorer).collect()}
    assert sum(found[i] for i in range(10, 60)) >= 49
    assert not any(found[100 + i] for i in range(30))
    assert weak_labels.score_quality(docs.limit(0), scorer).count() == 0
    assert weak_labels.fit_quality(docs.limit(0))[0] is None


def test_quality_learns_from_different_texts(spark, monkeypatch):
    rows = [(i, f"The cat of the house {i} sat in the sun and it is warm." if i % 2 else f"BUY!! {i} NOW!! $$$ ### %%% 12345", "en", "s", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    taken = []
    train = weak_labels.train_scorer
    monkeypatch.setattr(weak_labels, "train_scorer", lambda examples, good, counts: taken.append((sorted(float(v.sum()) for _, v in examples), sorted(counts))) or train(examples, good, counts))
    crowd = docs.where("doc_id in (0, 1, 2)").crossJoin(spark.range(700).select(F.col("id").alias("copy"))).drop("copy")
    for table in (docs.unionByName(crowd), docs.unionByName(crowd).repartition(7)):
        weak_labels.fit_quality(table, sample=20)
    assert len(taken[0][0]) == 20 and taken[0] == taken[1]
    weak_labels.fit_quality(docs.unionByName(crowd), sample=60)
    assert taken[2][1] == [1] * 37 + [weak_labels.MOST] * 3


def test_toxicity_trains_in_a_task(spark, monkeypatch):
    """The sampled texts don't pass the driver."""
    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "toArrow", lambda self: pytest.fail("texts on the driver"))
    docs = spark.createDataFrame([(i, f"plain words of number {i}" + " vile" * (i % 2)) for i in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    found = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, toxicity.fit(docs, labels, epochs=40)).collect()}
    assert sum(found[i] for i in range(1, 60, 2)) > sum(found[i] for i in range(0, 60, 2))


def test_toxicity_scorer_forgets_and_keeps_scores(monkeypatch):
    """Words met often stay, the others are projected anew: a word's gate inputs are a copy at most, whatever was dropped."""
    network = toxicity.Network(seed=2)
    texts = [[[b"w%d" % (k * 7 + i) for i in range(30)] + [b"the", b"of"] * 5] for k in range(12)]
    monkeypatch.setattr(toxicity, "VOCABULARY", 40)
    scorer = toxicity.Scorer(network)
    for own in texts:
        assert np.allclose(scorer.features(own), toxicity.Scorer(network).features(own), atol=1e-6)
        assert len(scorer.known) <= 40 + 32
    assert {b"the", b"of"} <= set(scorer.known)
    assert np.allclose(scorer.gates[scorer.known[b"the"]], network.projected([b"the"])[0], atol=1e-6)


def test_toxicity_keeps_inputs_not_gates():
    """What is kept of a word is no wider than its input and a one; logits from it are the plain ones, word for word."""
    network = toxicity.Network(seed=6)
    words = [b"a" * n for n in (1, 2, 95, 96, 97, 98, 300)] + [b"w%d" % i for i in range(40)]
    scorer = toxicity.Scorer(network)
    rows = scorer.rows([words])
    assert scorer.gates.shape[1] == network.p["grams"].shape[1] + 1 and not scorer.gates[0].any()
    means = gru.gram_means(network.p["grams"], *gru.gram_table(words, len(network.p["grams"])))
    assert np.allclose(scorer.gates[rows][:, :-1], network.p["words"][gru.word_rows(words, len(network.p["words"]))] + means, atol=1e-5)
    every = network.every_logit(np.ascontiguousarray(scorer.gates[rows].T), 24)
    one_by_one = [network.logits(scorer.gates[rows[s : s + 24]][:, None], np.ones((24, 1), bool))[0] for s in range(len(words) - 23)]
    assert np.allclose(every, one_by_one, atol=1e-5)


def test_toxicity_trains_without_the_texts(monkeypatch):
    """The sampled texts are freed before training, which outlasts all else in its task."""
    held = []
    monkeypatch.setattr(toxicity, "train", lambda *given, **named: held.append(pa.total_allocated_bytes()))
    before = pa.total_allocated_bytes()
    rows = 40
    made = lambda: pa.table({"id": [str(i) for i in range(rows)], "toxic": pa.array([i % 2 for i in range(rows)], pa.int32()), "text": [f"w{i} " * 5_000 for i in range(rows)]})
    assert toxicity.trained(made(), 1, 1)[2] == {0: rows // 2, 1: rows // 2}
    assert held[0] - before < 100_000


def test_toxicity_vocabulary_is_no_cycle():
    """A vocabulary that is dropped goes at once, not with the next collection: what numbers new words doesn't hold it."""
    known = toxicity.numbers([b"a", b"b"])
    assert [known[w] for w in (None, b"b", b"c", b"a", b"c", b"d")] == [0, 2, 3, 1, 3, 4]
    assert known.default_factory.__self__ is not known
