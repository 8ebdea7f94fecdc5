"""Components against union-find, and the folder they leave."""

import os
import random

from test_odd_rows import roots

from armwave.llm import graph
from armwave.session import shared_dir


def test_components(spark):
    draw = random.Random(9)
    pairs = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(500, 500 + i) for i in range(1, 60)] + [(600 + i, 601 + i) for i in range(40)] + [(7, 7)]
    got = {r.id: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots(700, pairs)
    assert got == {i: r for i, r in enumerate(want) if i != r}


def test_rounds_are_removed(spark):
    folder = shared_dir(spark).removeprefix("file:")
    before = {x for x in os.listdir(folder) if "links" in x}
    graph.components(spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")).count()
    assert len({x for x in os.listdir(folder) if "links" in x} - before) == 1


def test_no_links(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
