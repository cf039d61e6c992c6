"""Rounds of connected components have tasks by their links, not by the shuffle partitions."""

import random

import pytest

from loamstream.llm import shared


@pytest.fixture
def dealt_wide(spark):
    """Many shuffle partitions that are not put together again, as on a cluster of many cores."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _links():
    """A chain, a star, a loop, a pair both ways and twice, and random links."""
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(200, 200), (301, 300), (300, 301), (301, 300)]
    return links + [(rng.randrange(400, 480), rng.randrange(400, 480)) for _ in range(45)]


def _plain(links):
    root = {x: x for l in links for x in l}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(root[a], root[b])
            moved |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return {x: r for x, r in root.items() if x != r}


@pytest.mark.parametrize("links_a_task", [7, shared.LINKS])
def test_few_links_are_dealt_to_few_tasks(spark, monkeypatch, dealt_wide, links_a_task):
    monkeypatch.setattr(shared, "LINKS", links_a_task)
    links = _links()
    found = shared.components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.root for r in found.collect() if r.node != r.root} == _plain(links)
    assert found.rdd.getNumPartitions() <= 1 + len(links) // links_a_task < 64


def test_no_links(spark, dealt_wide):
    assert shared.components(spark.createDataFrame([], "a long, b long")).collect() == []
