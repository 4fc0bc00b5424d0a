"""Components of links: against union by hand, and the rows that the joins see."""

import numpy as np
import pytest

from colloquy.llm import components as found
from colloquy.llm import jaccard_join


def plain(links):
    root = {x: x for link in links for x in link}

    def of(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        low, high = sorted((of(a), of(b)))
        root[high] = low
    return {x: of(x) for x in root}


@pytest.mark.parametrize("kind", ["chain", "back", "star", "random", "loops", "none"])
def test_components_are_those_of_a_plain_union(spark, kind):
    rng = np.random.default_rng(3)
    links = {
        "chain": [(i, i + 1) for i in range(40)],
        "back": [(int(a), int(b)) for a, b in np.lib.stride_tricks.sliding_window_view(rng.permutation(40), 2)],
        "star": [(100, i) for i in range(30)] + [(-5, 100), (7, 7)],
        "random": [tuple(map(int, x)) for x in rng.integers(0, 60, (45, 2))],
        "loops": [(1, 1), (2, 2)],
        "none": [],
    }[kind]
    got = {r["node"]: r["root"] for r in found.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == plain([x for x in links if x[0] != x[1]])


def test_few_links_follow_labels(spark, monkeypatch):
    """Of classes that share 20 buckets each, what is followed in rounds is far less than the buckets' links."""
    seen = []
    monkeypatch.setattr(found, "propagated", lambda links, old=found.propagated: seen.append(links.distinct().count()) or old(links))
    rng = np.random.default_rng(5)
    least = {(i, k): int(rng.integers(0, 12)) for i in range(12, 300) for k in range(20)}
    held = spark.createDataFrame([(i, x) for (i, _), x in least.items()], "rep long, root long")
    got = {r["root"] for r in found.components(jaccard_join.root_links(held)).collect()}
    assert got == {0} and max(seen) <= 12
