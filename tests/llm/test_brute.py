"""Operators that SQL can't express, against plain versions of themselves."""

import math
import os.path
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from colloquy.llm import html_text, mixing, toxicity, weak_labels
from colloquy.llm.gru import GRAMS, Network
from colloquy.llm.url_filter import host_of, path_of


def plain_gram_row(gram, size):
    mask, total = 2**64 - 1, len(gram)
    for c in gram:
        total = (total * 0x100000001B3 + c) & mask
    total ^= total >> 29
    total = total * 0xBF58476D1CE4E5B9 & mask
    return (total >> 24) % size


def plain_input(p, word):
    core = bytes(c for c in word if c >= 128 or chr(c).isalnum()) or word
    out = p["words"][1 + xxhash.xxh3_64_intdigest(core) % (len(p["words"]) - 1)].astype(float)
    marked = b"<" + word + b">"
    rows = [plain_gram_row(marked[i : i + n], len(p["grams"])) for n in GRAMS for i in range(len(marked) - n + 1)]
    return out + sum(p["grams"][r].astype(float) for r in rows) / max(1, len(rows))


def plain_logit(p, h, words):
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    states = {}
    for way in "fb":
        state, own = np.zeros(h), []
        for word in words if way == "f" else words[::-1]:
            a = plain_input(p, word) @ p[f"W{way}"] + p[f"c{way}"]
            g = state @ p[f"U{way}"]
            z, r = sigmoid(a[:h] + g[:h]), sigmoid(a[h : 2 * h] + g[h : 2 * h])
            new = np.tanh(a[2 * h :] + r * g[2 * h :])
            state = (1 - z) * new + z * state
            own.append(state)
        states[way] = own if way == "f" else own[::-1]
    both = [np.concatenate(x) for x in zip(states["f"], states["b"], strict=True)]
    weights = np.exp([s @ p["v"] for s in both])
    return sum(w * s for w, s in zip(weights, both, strict=True)) / weights.sum() @ p["w"] + p["b"][0]


def test_toxicity_equals_a_plain_network():
    network = Network(seed=4)
    network.p["words"] = np.random.default_rng(5).normal(0, 0.5, network.p["words"].shape).astype(np.float32)
    texts = ["Bad bad BAD bad f*ck! you", "x", "one two. three " * 12 + "f.u.c.k off", "über straße — 日本語 ?! " * 9, "a " * 30]
    words = [toxicity.read_words(t.encode()) for t in texts]
    assert words[0] == [b"bad", b"bad", b"bad", b"bad", b"f*ck!", b"you"]
    found = toxicity.Scorer(network).features(words)
    for own, x in zip(words, found, strict=True):
        logits = sorted((plain_logit(network.p, network.h, own[s : s + toxicity.LENGTH]) for s in range(max(1, len(own) - toxicity.LENGTH + 1))), reverse=True)
        three = [logits[min(i, len(logits) - 1)] for i in range(3)]
        assert x == pytest.approx([logits[0], sum(three) / 3, math.log(len(logits))], abs=2e-4)
    once, often = toxicity.Scorer(network).features([[b"x"], [b"x"] * 3])[:, 0]
    assert abs(once - often) > 1e-4


def test_toxicity_sample_is_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(i % 50, "word " * (i % 50)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    picked, counts = toxicity.sampled(docs, labels, "doc_id", "text", 10, 600)
    rows = picked.collect()
    assert len(rows) == len({r["id"] for r in rows}) <= 20 and counts[0] + counts[1] > 20
    for label in (0, 1):
        own = [r for r in rows if r["toxic"] == label]
        assert 0 < sum(len(r["text"]) for r in own) <= 600
        assert all(r["text"] == "word " * int(r["id"]) for r in own)


def plain_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_html_equals_brute_force(spark, sf_dir):
    """Pairs, deletions and texts of all pages; sf0.01 if it is there."""
    top = os.path.join(os.path.dirname(sf_dir), "sf0.01")
    pages = spark.read.parquet(f"{top if os.path.isdir(top) else sf_dir}/pages.parquet")
    found = {r["page_id"]: (r["main_text"], r["n_shared"]) for r in html_text.extract_text(pages).collect()}
    rows = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).collect()
    hosts = defaultdict(dict)
    lines = {r["page_id"]: html_text.page_lines(r["html"] or "") for r in rows}
    for r in sorted(rows, key=lambda r: (r["path"], r["page_id"])):
        content = tuple(x for x in lines[r["page_id"]] if x[1] != html_text.NOISE)
        hosts[r["host"]].setdefault(content, []).append(r)
    changed = 0
    for contents in hosts.values():
        groups = sorted(contents.values(), key=lambda g: g[0]["path"].encode())
        assert len({g[0]["path"] for g in groups}) == len(groups)  # no ties to break in the given tables
        open_lines = [[x for x, k in lines[g[0]["page_id"]] if k != html_text.MAIN] for g in groups]
        for i, group in enumerate(groups):
            near = [j for j in (i - 1, i + 1) if 0 <= j < len(groups)]
            near.sort(key=lambda j: -len(os.path.commonprefix([groups[j][0]["path"], group[0]["path"]])))
            gone, own = set(), lines[group[0]["page_id"]]
            for j in near:
                drop = html_text.common_subsequence(open_lines[i], open_lines[j])
                assert len(drop) == plain_subsequence(open_lines[i], open_lines[j])
                gone = {open_lines[i][n] for n in drop}
                if gone and (any(k == html_text.MAIN for _, k in own) or any(k != html_text.NOISE and x not in gone for x, k in own)):
                    break
                gone = set()
            for r in group:
                has_main = any(k in (html_text.MAIN, html_text.DOUBT) for _, k in lines[r["page_id"]])
                text = [x for x, k in lines[r["page_id"]] if k == html_text.MAIN or (k == (html_text.DOUBT if has_main else html_text.PLAIN) and x not in gone)]
                shared = sum(k != html_text.MAIN and x in gone for x, k in lines[r["page_id"]])
                assert found[r["page_id"]] == (" ".join(text), shared)
                changed += shared > 0
    assert changed > 0


def test_mixing_equals_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    found = mixing.mix_sources(docs, evenness=0.97, most_passes=3.0).collect()
    rows = docs.select("doc_id", "source", mixing.token_count(F.col("text")).alias("n"), F.pmod(F.xxhash64(F.lit(11), F.col("doc_id").cast("string"), "text"), F.lit(1024)).cast("int").alias("block")).collect()
    totals = Counter()
    for r in rows:
        totals[r["source"]] += r["n"]
    everything, small = sum(totals.values()), min(totals.values())
    power = lambda e: {s: (t / everything) ** e for s, t in totals.items()}

    def entropy(e):
        x = power(e)
        return -sum(v / sum(x.values()) * math.log(v / sum(x.values())) for v in x.values())

    def passes(e):
        x = power(e)
        return (small / everything) ** e / sum(x.values()) * everything / small

    tries = [i / 20_000 for i in range(20_001)]
    exponent = max([e for e in tries if entropy(e) >= 0.97 * math.log(len(totals))], default=0)
    if passes(exponent) > 3.0:
        exponent = min(e for e in tries if passes(e) <= 3.0)
    x = power(exponent)
    assert {r["source"]: r["weight"] for r in found if r["n_tokens"]} == pytest.approx({s: v / sum(x.values()) for s, v in x.items()}, abs=1e-3)
    exact = {r["source"]: r["weight"] for r in found if r["n_tokens"]}
    blocks = defaultdict(Counter)
    for r in rows:
        blocks[r["source"]][r["block"]] += r["n"]
    whole = {s: math.floor(math.floor(exact[s] * everything) / t) for s, t in totals.items()}
    order = spark.createDataFrame([(s, whole[s], b) for s in totals for b in blocks[s]], "s string, w int, b int")
    order = {(r["s"], r["b"]): r["h"] for r in order.select("s", "b", F.xxhash64(F.lit(11), "s", "w", "b").alias("h")).collect()}
    times = {}
    for s, t in totals.items():
        rest, before = math.floor(exact[s] * everything) - whole[s] * t, 0
        for b in sorted(blocks[s], key=lambda b: (order[s, b], b)):
            times[s, b] = whole[s] + (before < rest)
            before += blocks[s][b]
    expected = Counter({r["doc_id"]: times[r["source"], r["block"]] if r["n"] else 1 for r in rows})
    assert Counter(r["doc_id"] for r in found) == +expected
    assert all(sorted(r["pass"] for r in found if r["doc_id"] == d) == list(range(n)) for d, n in list(expected.items())[:50] if n)


def plain_em(patterns, counts, rounds):
    """The same estimates, one vote at a time."""
    m = len(patterns[0])
    good = [1 / (1 + math.exp(-4 * sum(p) / m)) for p in patterns]
    for _ in range(rounds):
        weight = [[c * (1 - g) for c, g in zip(counts, good, strict=True)], [c * g for c, g in zip(counts, good, strict=True)]]
        share = (sum(weight[1]) + 2) / (sum(counts) + 4)
        rates = [[[2 * ((3, 2, 1) if k == 0 else (1, 2, 3))[v] for v in range(3)] for _ in range(m)] for k in (0, 1)]
        for i, p in enumerate(patterns):
            for j, v in enumerate(p):
                for k in (0, 1):
                    rates[k][j][v + 1] += weight[k][i]
        rates = [[[x / sum(row) for x in row] for row in side] for side in rates]
        odds = [math.log(share / (1 - share)) + sum(math.log(rates[1][j][v + 1] / rates[0][j][v + 1]) for j, v in enumerate(p)) for p in patterns]
        good = [1 / (1 + math.exp(-max(-30, min(30, o)))) for o in odds]
    return good


def test_votes_equal_a_plain_estimate():
    rng = np.random.default_rng(2)
    patterns = np.unique(rng.integers(-1, 2, (40, 5)), axis=0)
    counts = rng.integers(1, 50, len(patterns)).astype(float)
    model = weak_labels.VoteModel(patterns, counts, rounds=7)
    assert model.posterior(patterns) == pytest.approx(plain_em(patterns.tolist(), counts.tolist(), 7), abs=1e-9)


def test_features_equal_a_plain_count():
    for text in (b"", "The cat — the CAT sat.\nThe cat 12".encode(), b"aa  bb aa\n\naa"):
        keys, values = weak_labels.Features().of(text)
        words, weights = text.split(), Counter()
        n = max(1, len(words))
        for w in words:
            shape = weak_labels.RUNS.sub(rb"\1", bytes(weak_labels.SHAPE[c] for c in w))
            weights[xxhash.xxh3_64_intdigest(shape, 1) % weak_labels.BUCKETS] += 1 / n
            weights[xxhash.xxh3_64_intdigest(w, 2) % weak_labels.BUCKETS] += 1 / n
        for c, k in Counter(text).items():
            weights[c * 251 % weak_labels.BUCKETS] += math.sqrt(k / len(text))
        lines = text.split(b"\n")
        echoes = sum(a == b for a, b in zip(words, words[1:], strict=False))
        for name, value in ((b"words", math.log2(n)), (b"lines", math.log2(len(lines))), (b"distinct", 10 * len(set(lines)) / len(lines)), (b"mean", len(text) / n), (b"echoes", 10 * echoes / n)):
            weights[xxhash.xxh3_64_intdigest(b"%s:%d" % (name, int(value)), 3) % weak_labels.BUCKETS] += 0.5
        weights[0] += 1.0
        length = math.sqrt(sum(weights.values()))
        assert dict(zip(keys.tolist(), values, strict=True)) == pytest.approx({k: math.sqrt(v) / length for k, v in weights.items()})


def test_quality_does_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scores = []
    for n in (4, 211):
        table = docs.repartition(n)
        _, scorer = weak_labels.fit_quality(table, sample=100)
        scores.append({r["doc_id"]: r["quality"] for r in weak_labels.score_quality(docs, scorer).collect()})
    assert scores[0] == scores[1]
