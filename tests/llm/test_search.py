"""Wu-Manber, FM-index, longest common subsequence and M-tree against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm import jaccard_join
from colloquy.llm.decontaminate import joined, matchers, search, windows_of
from colloquy.llm.fm_index import FMIndex, RangeMin, WaveletTree
from colloquy.llm.html_text import common_subsequence
from colloquy.llm.jaccard_join import rows_and_bands, verified
from colloquy.llm.mixing import bisect
from colloquy.llm.topk import MTree

WORDS = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40)


@settings(max_examples=150, deadline=None)
@given(WORDS, st.lists(WORDS, max_size=5), st.integers(1, 5))
def test_wu_manber(text, items, window):
    named = [(str(i), b" ".join(x)) for i, x in enumerate(items)]
    spans, ids = search(text, matchers(windows_of(named, window)))
    hits, expected = set(), set()
    for item, words in named:
        words = words.split()
        m = min(window, len(words))
        for s in range(len(words) - m + 1 if m else 0):
            for at in range(len(text) - m + 1):
                if text[at : at + m] == words[s : s + m]:
                    hits.update(range(at, at + m))
                    expected.add(item)
    assert {i for s, e in spans for i in range(s, e)} == hits
    assert ids == expected


def test_joined():
    assert joined([(5, 7), (0, 2), (2, 4), (6, 9)]) == [(0, 4), (5, 9)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=200), st.data())
def test_wavelet_tree(symbols, data):
    tree = WaveletTree(np.array(symbols), 7)
    at = data.draw(st.integers(0, len(symbols)))
    for c in range(7):
        assert tree.rank(np.array([c]), np.array([at]))[0] == symbols[:at].count(c)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=70), st.data())
def test_range_min(values, data):
    table = RangeMin(np.array(values))
    at, limit = data.draw(st.integers(0, len(values) - 1)), data.draw(st.integers(0, 10))
    left = [i for i in range(at + 1) if values[i] < limit]
    right = [i for i in range(at, len(values)) if values[i] < limit]
    assert table.left_below(np.array([at]), np.array([limit]))[0] == (left[-1] if left else 0)
    assert table.right_below(np.array([at]), np.array([limit]))[0] == (right[0] if right else len(values))
    hi = data.draw(st.integers(at + 1, len(values)))
    assert table.of(np.array([at]), np.array([hi]))[0] == min(values[at:hi])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 3), min_size=1, max_size=25), st.integers(0, 4)), min_size=1, max_size=6))
def test_matching_statistics(rows):
    texts = [np.array(t, np.uint64) for t, _ in rows]
    docs = np.array([d for _, d in rows], np.int64)
    found = FMIndex(texts, docs).matching_statistics([*texts, np.array([9, 1, 9], np.uint64)], np.append(docs, 5))
    for (query, bound), got in zip([*rows, ([9, 1, 9], 5)], found, strict=True):
        for i in range(len(query)):
            best = 0
            for text, doc in rows:
                if doc < bound:
                    for j in range(len(text)):
                        n = 0
                        while i + n < len(query) and j + n < len(text) and query[i + n] == text[j + n]:
                            n += 1
                        best = max(best, n)
            assert got[i] == best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_common_subsequence(a, b):
    length = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            length[i + 1][j + 1] = length[i][j] + 1 if x == y else max(length[i][j + 1], length[i + 1][j])
    places = common_subsequence(a, b)
    assert len(places) == length[-1][-1]
    rest = iter(b)
    assert all(a[i] in rest for i in places)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 400), st.integers(1, 6), st.integers(0, 10**6), st.integers(1, 3))
def test_m_tree(n, k, seed, spread):
    rng = np.random.default_rng(seed)
    rows = rng.integers(-spread, spread + 1, (n, 3))
    ids = rng.permutation(n)
    tree = MTree(rows, ids)
    query, best = rng.integers(-3, 4, 3).astype(float), []
    tree.search(query, 0, k, best)
    expected = sorted((-float(r @ query), int(i)) for r, i in zip(rows, ids, strict=True) if i != 0)[:k]
    assert sorted((-s, -x) for s, x in best) == expected


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1), min_size=2, max_size=8), st.integers(1, 7), st.sampled_from([1, 2, 16]))
def test_verified(sets, cut, few):
    rows = [np.array(sorted(s), np.uint64) for s in sets]
    every = np.arange(len(rows))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(jaccard_join, "FEW", few)
        patch.setattr(jaccard_join, "BIT_COLUMNS", 64)
        for left, right in ((every, every), (every[:cut], every[cut:])):
            hit = verified(rows, left, right, (4, 5))
            for i, a in enumerate(left):
                for j, b in enumerate(right):
                    a_set, b_set = sets[a], sets[b]
                    assert hit[i, j] == (5 * len(a_set & b_set) >= 4 * len(a_set | b_set))


def near_copies(n, length=120, seed=5):
    """Copies of one text with some words replaced: some pairs are links, many only just or not."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(length)]
    out = []
    for i in range(n):
        words = list(base)
        for j in rng.choice(length, rng.integers(0, 3), replace=False):
            words[j] = f"x{i}.{j}"
        out.append(" ".join(words))
    return out


def test_links_of_near_copies_grow_linearly(spark, monkeypatch):
    edges = []
    root_links = jaccard_join.root_links
    monkeypatch.setattr(jaccard_join, "root_links", lambda linked: edges.append(found := root_links(linked)) or found)
    sizes = (100, 200, 400)
    for n in sizes:
        docs = spark.createDataFrame(list(enumerate(near_copies(n))), "doc_id long, text string")
        assert jaccard_join.jaccard_classes(docs, block=16).where("n_links > 0").count() > 0.9 * n
    assert all(e.count() < 1.5 * n for e, n in zip(edges, sizes, strict=True))


def test_jaccard_in_blocks(spark):
    """Clusters of many blocks, some of which share no bucket, against brute force."""
    from tests.llm.test_pipeline import brute_classes

    texts = near_copies(60, 60) + [" ".join(f"y{i}.{j}" for j in range(40)) for i in range(20)] + near_copies(40, 30, 6)
    rows = list(enumerate(texts))
    classes, links = brute_classes(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (1024, 8, 1):
        found = {r["doc"]: (r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_classes(docs, block=block).collect()}
        assert found == {d: (c, n) for (d, _), c, n in zip(rows, classes, links, strict=True)}


def test_bands_reach_the_recall():
    rows, bands = rows_and_bands(0.8, 0.999, 144)
    assert rows * bands <= 144
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_bisect():
    assert abs(bisect(lambda x: x <= 0.3) - 0.3) < 1e-9
    assert bisect(lambda x: True) == 1.0
    assert bisect(lambda x: False) == 0.0
