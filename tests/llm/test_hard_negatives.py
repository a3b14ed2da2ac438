"""Exact products of residues, and hard negatives against brute force."""

import math

import numpy as np
import pytest

from skytally.llm import hard_negatives as hn
from skytally.llm import queries


def brute(rows, every, positives, negatives, low, high, scale):
    rows = sorted({(i, l, tuple(math.floor(scale * c) for c in v)) for i, l, v in rows})
    out = []
    for i, label, x in rows:
        if i % every:
            continue
        near = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j, other) for j, other, y in rows)
        for s, j in [(-s, j) for s, j, other in near if other == label and j != i][:positives]:
            found = [(-t, k) for t, k, other in near if other != label and low * s <= -100 * t <= high * s][:negatives]
            out += [(i, j, r + 1, k, s, t) for r, (t, k) in enumerate(found)]
    return sorted(out)


def mined(frame, **options):
    return sorted(tuple(r) for r in hn.hard_negatives(frame, **options).collect())


@pytest.mark.parametrize("length, size", [(1, 10), (64, 150), (64, 2**24), (300, 2**25), (1000, 40), (5, 2**28)])
def test_products_are_exact(length, size):
    draw = np.random.default_rng(length)
    a, b = draw.integers(-size, size + 1, (7, length)), draw.integers(-size, size + 1, (9, length))
    a[0], b[0], b[1] = size, size, -size
    primes = hn.primes_for(length, length * size * size)
    got = hn.product([hn.residues(a, p) for p in primes], [hn.residues(b, p) for p in primes], primes)
    assert got.tolist() == (a.astype(object) @ b.astype(object).T).tolist()


def test_ties_and_windows_against_brute_force(spark):
    draw = np.random.default_rng(3)
    rows = [(i, int(draw.integers(0, 3)), draw.normal(size=6).round(1).tolist()) for i in range(-20, 180)]
    rows += [(200 + i, i % 2, [0.5, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(60)] + rows[:10]
    rows += [(10, 0, [1.0, 1.0, 1.0, 1.0, 1.0, 1.0])]  # a second row of one id
    odd = [(400, 1, None), (410, None, [0.1] * 6), (None, 1, [0.1] * 6), (420, 1, [float("nan")] * 6), (430, 1, [float("inf")] + [1.0] * 5),
           (440, 2, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (450, 1, []), (460, 1, [1.0])]
    frame = spark.createDataFrame([(*r, 5, "x") for r in rows + odd], "vec_id long, label int, embedding array<double>, block int, anchor string").repartition(5)
    expected = brute(rows, 10, 5, 3, 50, 95, 256)
    assert len(expected) > 100
    assert mined(frame, every=10) == expected
    assert mined(frame, every=10, block=17, group=4) == expected


def test_few_and_none(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert mined(spark.createDataFrame([], schema)) == []
    assert mined(spark.createDataFrame([(0, 1, [1.0])], schema)) == []
    few = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.5]), (2, 2, [0.75, 9.0]), (3, 2, [0.25, 0.0])]
    assert mined(spark.createDataFrame(few, schema)) == [(0, 1, 1, 2, 65536, 49152)]
    with pytest.raises(ValueError):
        mined(spark.createDataFrame([(0, 1, [1e9]), (1, 1, [1e9])], schema))


def test_query_against_brute_force(spark, folder):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    rows = [(i, (l + 1) % 10 if i % 7 == 0 else l, v) for i, l, v in rows if l is not None and v is not None]
    got = sorted(tuple(r) for r in queries.op12_hard_negatives(spark, folder).collect())
    assert got == brute(rows, 50, 5, 3, 50, 95, 256) and got
