"""The character model against a plain Kneser-Ney, and its decisions against held-out labels."""

import math
import random
from collections import Counter, defaultdict

import numpy as np

from skytally.llm import quality, queries
from skytally.llm.common import table


def plain_model(texts, alphabet, order):
    """Interpolated modified Kneser-Ney with dictionaries."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        s = [0] * (order - 1) + list(alphabet.symbols(t)) + [0]
        for i in range(order - 1, len(s)):
            counts[order][tuple(int(x) for x in s[i - order + 1:i + 1])] += 1
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    tables = []
    for n in range(1, order + 1):
        n1, n2, n3, n4 = (sum(c == k for c in counts[n].values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        drop = {1: max(0.05, 1 - 2 * y * n2 / max(n1, 1)), 2: max(0.05, 2 - 3 * y * n3 / max(n2, 1)), 3: max(0.05, 3 - 4 * y * n4 / max(n3, 1))}
        total, taken = defaultdict(float), defaultdict(float)
        for g, c in counts[n].items():
            total[g[:-1]] += c
            taken[g[:-1]] += drop[min(c, 3)]
        tables.append((counts[n], drop, total, taken))

    def p(gram):
        if not gram:
            return 1 / alphabet.size
        seen, drop, total, taken = tables[len(gram) - 1]
        low = p(gram[1:])
        if gram[:-1] not in total:
            return low
        c = seen.get(gram, 0)
        return ((c - drop[min(c, 3)]) if c else 0) / total[gram[:-1]] + taken[gram[:-1]] / total[gram[:-1]] * low

    return p


def test_model_equals_plain_model(spark):
    texts = ["the cat sat on the mat.", "a cat and a hat", "the end", "xyzzy", "über den Wolken"] * 2 + ["one more"]
    order = 3
    model = quality.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), order)
    alphabet = quality.Alphabet(model.characters, order)
    p = plain_model(texts, alphabet, order)
    for text in ["the cat", "zebra!", "", "Ω"]:
        s = [0] * (order - 1) + [int(x) for x in alphabet.symbols(text)] + [0]
        expected = -sum(math.log(p(tuple(s[i - order + 1:i + 1]))) for i in range(order - 1, len(s)))
        sizes, nats = quality.entropies([text], alphabet, model)
        assert sizes[0] == len(text) + 1 and math.isclose(nats[0], expected, rel_tol=1e-5)
    logs = model.logs(np.arange(alphabet.size**order), alphabet.size)
    total = np.exp(logs.reshape(-1, alphabet.size).astype(np.float64)).sum(axis=1)
    assert np.allclose(total, 1, atol=1e-4)


def test_decisions(spark):
    folder = "/root/testdata/sf0.1"
    labels = table(spark, folder, "labels")
    out = quality.classify(queries.documents(spark, folder), labels).join(labels, "doc_id").select("quality", "toxic", "accepted").collect()
    clean = [r["accepted"] for r in out if r["quality"] == 1 and not r["toxic"]]
    junk = [r["accepted"] for r in out if r["quality"] == 0]
    assert sum(clean) / len(clean) > 0.99
    assert sum(junk) / len(junk) < 0.35


def test_odd_rows(spark):
    rows = [(1, "plain words here and there", "en"), (2, None, "en"), (3, "", None), (4, "§§§" * 4000, "xx"), (5, "plain words", None), (None, "words", "en")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, entropy int")
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, None), (5, 1, None), (4, 0, 0), (99, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(out) == 6 and out[2]["accepted"] and out[3]["accepted"] and out[1]["accepted"] and not out[4]["accepted"]
    assert all(r["accepted"] and r["perplexity"] is None for r in quality.classify(docs, labels.limit(0)).collect())
    assert quality.classify(docs.limit(0), labels).collect() == []


def test_rare_language(spark):
    draw = random.Random(4)
    lexicon = {x: ["".join(draw.choices(letters, k=draw.randrange(2, 9))) for _ in range(300)] for x, letters in (("en", "abcdefghij "), ("es", "klmnñopqrstuvwxyz"), ("zu", "αβγδεζηθικλ"))}
    n = {"en": 6000, "es": 60, "zu": 20}
    rows = [(x, " ".join(draw.choices(lexicon[x], k=draw.randrange(30, 200)))) for x, k in n.items() for _ in range(k)]
    rows.append(("es", "klm" * 4000))
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string")
    # Half of the Spanish documents and none in Zulu are trusted.
    trusted = [(i, 1, 0) for i, (x, t) in enumerate(rows[:-1]) if x == "en" or x == "es" and i % 2]
    out = quality.classify(docs, spark.createDataFrame(trusted, "doc_id long, quality int, toxic int"), sample=200).collect()
    share = {x: [r["accepted"] for r in out if r["lang"] == x and r["doc_id"] < len(rows) - 1] for x in n}
    assert sum(share["en"]) / n["en"] > 0.99 and sum(share["es"]) / n["es"] > 0.95 and all(share["zu"])
    limits = {r["lang"]: (r["lowest"], r["highest"]) for r in out}
    assert limits["es"] != limits["en"] and limits["zu"] == (None, None)
    assert not next(r["accepted"] for r in out if r["doc_id"] == len(rows) - 1)


def test_scripts_of_many_characters(spark):
    draw = random.Random(9)
    words = ["".join(chr(0x4E00 + draw.randrange(3000)) for _ in range(2)) for _ in range(800)]
    latin = ["".join(draw.choices("abcdefghij", k=5)) for _ in range(300)]
    rows = [("zh", "".join(draw.choices(words, k=draw.randrange(60, 200)))) for _ in range(600)]
    rows += [("en", " ".join(draw.choices(latin, k=100))) for _ in range(600)]
    trusted = [(i, 1, 0) for i in range(len(rows)) if i % 2]
    # The same characters in any order, and characters of the block that no trusted text has.
    junk = [("zh", "".join(draw.sample(t, len(t)))) for _, t in rows[:40]] + [("zh", "".join(chr(0x7000 + draw.randrange(3000)) for _ in range(200))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(rows + junk)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame(trusted, "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r["accepted"] for r in quality.classify(docs, labels).collect()}
    assert sum(out[i] for i in range(len(rows))) > 0.99 * len(rows)
    assert not any(out[i] for i in range(len(rows), len(rows) + len(junk)))


def test_sample_is_bounded_by_characters(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 20, "en") for i in range(50)] + [(60, "long " * 5000, "en")] + [(61, "again", "en")] * 500,
                                 "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(50), 60, 61]], "doc_id long, quality int, toxic int")
    model, _ = quality.fit(docs, labels, characters=1000)
    assert 0 < len(model.probabilities[-1][0]) <= 1000 + 10
    blocks = quality.BLOCK
    quality.BLOCK = 7
    try:
        alphabet = quality.Alphabet(model.characters, model.order)
        cut = quality.entropies(["text 5 text 6", "", "a"], alphabet, model)
    finally:
        quality.BLOCK = blocks
    whole = quality.entropies(["text 5 text 6", "", "a"], alphabet, model)
    assert np.array_equal(cut[0], whole[0]) and np.allclose(cut[1], whole[1])


def test_all_trusted_text_is_counted(spark):
    # More trusted documents than the model once was counted on: each has a word of its own that the model must know.
    rows = [(i, f"common words and {chr(0x4E00 + i)}{chr(0x4E01 + i)}{chr(0x4E02 + i)}", "en") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(9000)], "doc_id long, quality int, toxic int")
    model, _ = quality.fit(docs, labels)
    assert len(model.characters) >= 9000 and model.folds
    out = quality.classify(docs, labels).select("doc_id", "n_symbols", "perplexity").where("doc_id % 1000 = 0").collect()
    alphabet = quality.Alphabet(model.characters, model.order)
    sizes, nats = quality.entropies([rows[r["doc_id"]][1] for r in out], alphabet, model)
    assert [r["n_symbols"] for r in out] == sizes.tolist()
    assert np.allclose([math.log(r["perplexity"]) for r in out], nats / sizes, rtol=1e-4)


def test_limits_see_unseen_text(spark):
    draw = random.Random(3)
    lexicon = ["".join(draw.choices("abcdefghijklm", k=6)) for _ in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(draw.choices(lexicon, k=60)), "en") for i in range(400)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == 400 and sum(r["accepted"] for r in out if r["doc_id"] % 2) > 190


def test_text_is_not_shuffled(spark):
    docs = spark.createDataFrame([(i, f"some text {i}", "en") for i in range(50)], "doc_id long, text string, lang string")
    blocks = quality.in_blocks(docs)
    assert sorted((r["doc_id"], r["text"]) for r in blocks.collect()) == sorted((i, f"some text {i}") for i in range(50))
    wanted = blocks.where("doc_id % 2 = 0").select("doc_id", "q_row", "q_block")
    out = quality.texts_at(blocks, wanted)
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(i, f"some text {i}") for i in range(0, 50, 2)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("\n") if "Exchange" in line]
    assert "Bucketed: true" in plan and len(exchanges) <= 2  # that of the wanted rows, before and after it ran
