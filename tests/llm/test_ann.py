"""The multi-index against brute force: recall, exact scores, ties, odd vectors."""

import numpy as np

from skytally.llm import ann, queries
from skytally.llm.common import table


def brute(rows, every, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for i, v in zip(ids, x, strict=True):
        if i % every == 0:
            scores = (x * v).sum(1)
            order = np.lexsort((ids, -scores))
            out[int(i)] = [(int(ids[j]), scores[j]) for j in order if ids[j] != i][:k]
    return out


def test_recall_and_scores(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, folder, "embeddings").collect()]
    true, vectors, got = brute(rows, 20, 20), dict(rows), {}
    for r in queries.op6_ann(spark, folder).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(true)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        for _, i, s in found:
            assert abs(s - float(np.dot(np.array(vectors[q], np.float64), np.array(vectors[i], np.float64)))) < 1e-12
        hits += len({i for _, i, _ in found} & {i for i, _ in true[q]})
    assert hits / (20 * len(true)) >= 0.9


def test_cells_come_in_order():
    draw = np.random.default_rng(1)
    books = ann.Codebooks(draw.normal(size=(9, 4)), draw.normal(size=(7, 4)))
    query = draw.normal(size=8)
    order = list(books.order(query))
    summed = -(books.first @ query[:4])[:, None] - (books.second @ query[4:])[None]
    assert sorted(order) == list(range(63))
    assert np.all(np.diff(summed.ravel()[order]) >= -1e-12)


def test_copies_ties_and_odd_vectors(spark):
    draw = np.random.default_rng(4)
    vectors = draw.normal(size=(60, 6)).round(2).tolist()
    rows = [(i, vectors[i % 60]) for i in range(90)] + [(100 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(80)]
    odd = [(200, None), (220, [0.0] * 6), (240, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (260, [float("nan")] * 6), (280, [float("inf")] + [1.0] * 5), (300, []),
           (320, [1.0]), (None, [1.0] * 6)]
    docs = spark.createDataFrame([(*r, 1) for r in rows + odd + rows[:5]], "vec_id long, embedding array<double>, cell int").repartition(4)
    got = {}
    for r in ann.nearest(docs, every=20, k=20, recall=1.0, block=10, group=3).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], round(r["score"], 9))
    true = brute(rows, 20, 20)
    assert set(got) == set(true)
    for q, found in true.items():
        if q >= 100 or q == 0:  # copies of one vector: only ids decide
            assert [got[q][r][0] for r in range(1, 21)] == [i for i, _ in found]
        assert len(got[q]) == 20


def test_few_and_none(spark):
    docs = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (3, [5.0, 5.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(docs).orderBy("rank").collect()] == [(0, 1, 3, 15.0), (0, 2, 1, 4.0)]
    assert ann.nearest(docs.limit(0)).collect() == []
    one = spark.createDataFrame([(0, [2.0]), (20, [3.0])], "vec_id long, embedding array<float>")
    assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in ann.nearest(one).collect()) == [(0, 20, 6.0), (20, 0, 6.0)]
