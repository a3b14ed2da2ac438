"""Near duplicates against brute force over all pairs."""

import itertools
import random

import pytest

from skytally.llm import near_dup, queries


def sets_of(text, k=5):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, threshold=85):
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= threshold * len(a | b):
            parent[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    low = {g: min((x for x in v if x is not None), default=None) for g, v in groups.items()}
    return [(d, len(sets[i]), low[root(i)], d == low[root(i)]) for i, (d, _) in enumerate(rows)]


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query(spark, size):
    folder = f"/root/testdata/{size}"
    rows = [(r["doc_id"], r["text"]) for r in queries.documents(spark, folder).collect()]
    assert ordered(queries.op8_near_dup(spark, folder).collect()) == ordered(brute(rows))


def test_chains_and_large_groups(spark):
    draw = random.Random(3)
    word = lambda: "".join(draw.choices("abcdefgh", k=5))
    rows, base = [], [word() for _ in range(120)]
    for i in range(60):  # a chain: each differs a little from the last, the ends differ much
        base = base[:]
        base[draw.randrange(120)] = word()
        rows.append((1000 - i, " ".join(base)))
    rows += [(2000 + i, " ".join(base[:110] + [word()])) for i in range(60)]
    rows += [(3000 + i, "one passage that many documents share word for word " * 3 + " ".join(word() for _ in range(40))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = near_dup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")
    assert ordered(out.collect()) == ordered(brute(rows))


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  b"), (6, "a b c"), (7, "x y z v w"), (7, "x y z v w"), (8, long), (9, long + " more"),
            (10, "É a é b c d"), (11, "é a é b c d")]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, class int, key string")
    out = near_dup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")
    assert ordered(out.collect()) == ordered(brute(rows))
    kept = near_dup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 6, 7, 8, 10, 11]
    assert near_dup.near_duplicates(docs.limit(0)).collect() == []
    nameless = spark.createDataFrame([(None, "p q r s t u"), (None, "p q r s t u"), (None, None)], "doc_id long, text string")
    assert {(r["component_id"], r["n_shingles"]) for r in near_dup.near_duplicates(nameless).collect()} == {(None, 2), (None, 0)}
    assert near_dup.one_of_each(nameless).count() == 2
