"""The language model: exact base scores, proper probabilities, better than the base on held-out text."""

import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd

from skytally.llm import lm, queries


def words(text):
    return (text or "").encode().lower().split() + [None]


def held(doc):
    return zlib.crc32(str("" if doc is None else doc).encode()) % 7 == 2


def check_base(rows, out):
    counts = Counter(w for d, t in rows if not held(d) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    expected = sorted(((d, held(d), len(words(t)), sum(counts[w] > 0 for w in words(t)), n) for d, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in out), key=repr) == expected
    base = sorted(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t)) for _, t in rows)
    assert np.allclose(sorted(r["base_score"] for r in out), base, rtol=1e-9)


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in queries.documents(spark, folder).collect()]
    out = queries.op7_lm(spark, folder).collect()
    check_base(rows, out)
    assert all(r["score"] < 0 for r in out)
    for fold in (True, False):
        assert sum(r["score"] for r in out if r["held_out"] == fold) > sum(r["base_score"] for r in out if r["held_out"] == fold)


def test_many_blocks_and_shards(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in queries.documents(spark, folder).collect()]
    small = lm.Settings(block_bytes=60_000, shard_tokens=5_000)
    out = lm.score(queries.documents(spark, folder), settings=small).collect()
    check_base(rows, out)
    whole = {r["doc_id"]: r["score"] for r in queries.op7_lm(spark, folder).collect()}
    parted = {r["doc_id"]: r["score"] for r in out}
    assert abs(sum(parted.values()) / sum(whole.values()) - 1) < 0.02


def test_odd_rows(spark):
    rows = [(1, None), (3, ""), (4, "A a É é"), (4, "A a É é"), (None, "x y"), (5, "w " * 300_000 + "z"), (6, "\x0b\x0c\x1c x")]
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, held boolean")
    check_base(rows, lm.score(docs).collect())
    assert lm.score(docs.limit(0)).collect() == []


def test_probabilities_sum_to_one():
    settings = lm.Settings(contexts=8)
    draw = np.random.default_rng(5)
    v = 40
    keys, count = np.unique(draw.integers(0, v, 3000) * draw.integers(0, 2, 3000) * 8 + draw.integers(0, 8, 3000), return_counts=True)
    word, context = keys // 8, keys % 8
    present, word = np.unique(word, return_inverse=True)
    samples = lm.sampled(word, context, count, len(present), 1, settings, draw)
    totals = lm.Totals(int(count.sum()), len(present), np.array([s[1].sum() for s in samples], float), np.array([s[2].sum() for s in samples], float),
                       np.array([np.bincount(context, x, minlength=8) for x in (count, *[s[0] for s in samples])]))
    customers, roots = (np.hstack([np.array([s[i] for s in samples], float), np.zeros((settings.samples, 1))]) for i in (1, 2))  # and the unknown word
    for c in range(8):
        n, t = np.zeros(len(present) + 1), np.zeros(len(present) + 1)
        here = context == c
        n[word[here]], t[word[here]] = count[here], sum(s[0] for s in samples)[here]
        p = lm.pair_probabilities(n, t, np.arange(len(present) + 1), np.full(len(present) + 1, c), customers, roots, totals, settings)
        assert abs(p.sum() - 1) < 1e-9 and (p > 0).all()


def test_seating_follows_the_rule():
    draw = np.random.default_rng(6)
    n, weight, d, trials = 30, 0.7, 0.5, 20_000
    got = lm.seated(np.full(trials, n), np.full(trials, weight), d, draw).mean()
    slow = []
    for _ in range(3000):
        t = 1
        for k in range(1, n):
            t += draw.random() < weight / (weight + k - d * t)
        slow.append(t)
    assert abs(got - np.mean(slow)) < 0.1
    large = lm.seated(np.full(2000, 5000), np.full(2000, 3.0), 0.0, draw).mean()
    assert abs(large - 3 * math.log(5000 / 3)) / (3 * math.log(5000 / 3)) < 0.1


def test_every_word_is_a_context_of_its_own(spark):
    # 40,000 different words, more than there once were classes of contexts, and each is followed by a word that tells it from the others.
    n = 40_000
    rows = [(i, " ".join(f"a{j} b{j}" for j in range(i * 100, i * 100 + 100)), False) for i in range(n // 100)]
    rows += [(10_000, "a7 b7", True), (10_001, "a7 b8", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(4)
    settings = lm.Settings(block_bytes=60_000, shard_tokens=20_000)
    blocks = lm.stored(lm.blocks_of(docs, docs["held"], settings), "blocks")
    figures = lm.stored(lm.seat(lm.counts_of(blocks, 4, settings), 4, settings), "figures")
    asked, answers = {}, {}
    for r in blocks.collect():
        asked[r["block"]] = lm.contexts_of(np.frombuffer(r["words"], np.uint64), r["first"], None)
    for r in lm.context_figures(blocks, figures, 4, settings).orderBy("part").collect():
        answers.setdefault(r["block"], []).append(lm.unpacked(r["per_context"], np.uint64).reshape(settings.samples + 1, -1))
    customers = {}
    for block, contexts in asked.items():
        found = np.concatenate(answers[block], axis=1)[0]
        assert len(found) == len(contexts)
        for c, x in zip(contexts.tolist(), found.tolist()):
            assert customers.setdefault(c, x) == x
    # Every word, the end excepted, is followed once, the start of a text by as many as there are training texts.
    assert customers.pop(int(lm.START)) == n // 100 and customers.pop(int(lm.END)) == 0
    assert len(customers) == 2 * n and set(customers.values()) == {1}
    out = {r["doc_id"]: r["score"] for r in lm.score(docs, docs["held"], settings).where("doc_id >= 10000").collect()}
    assert out[10_000] > out[10_001] + 1


def test_shard_memory():
    """What a shard sums up takes a bounded number of bytes for each pair of its blocks, also on the way."""
    draw, rows, entries = np.random.default_rng(3), [], 0
    words = np.sort(draw.integers(1, 2**63, 300, dtype=np.uint64))
    common = draw.integers(1, 2**63, 5_000, dtype=np.uint64)
    for block in range(40):
        met = np.unique(np.concatenate([common, draw.integers(1, 2**63, 2_000, dtype=np.uint64)]))
        pairs = [np.flatnonzero(draw.random(len(met)) < 0.01) for _ in words]
        size, counts = np.array([len(p) for p in pairs]), draw.integers(0, 3, sum(map(len, pairs)))
        entries += int(size.sum())
        rows.append((0, block, words.tobytes(), lm.packed(size, np.uint32), met.tobytes(), lm.packed(np.concatenate(pairs), np.uint32), lm.packed(counts, np.uint32)))
    rows = pd.DataFrame(rows, columns=[c.split()[0] for c in lm.COUNTS.split(", ")])
    tracemalloc.start()
    lm.Shard(rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 75 * entries
