"""Components against union-find, and helpers."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from tessera.llm import common


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rnd.randint(100, 400), rnd.randint(100, 400)) for _ in range(180)] + [(500, i) for i in range(501, 560)] + [(-5, -9), (7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_slices():
    col = pa.array(["ab", None, "ccc", "", "dddd"])
    data, offsets = common.string_buffers(col.slice(1))
    assert offsets.tolist() == [0, 0, 3, 3, 7] and bytes(data) == b"cccdddd"
    assert list(common.row_slices(offsets, 3)) == [(0, 3), (3, 4)]
    assert len(np.unique(common.mix64(np.arange(1000, dtype=np.uint64)))) == 1000


def test_driver_gives_native_memory_back(spark):
    """The JVM of the tests (17) has the command; without it the driver goes on."""
    assert common.trim_driver(spark) is True
    common.drop_unused(spark)
