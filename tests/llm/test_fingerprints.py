"""Winnowing against a plain version, and the edited texts against Python's."""

import hashlib
import random
import re

from skytally.llm import fingerprints, queries


def expected_edits(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for i, (doc, text) in enumerate(rows):
        half = len(text) // 2
        edited = text[:len(text) - half] + rows[(i + 1) % len(rows)][1][:half]
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(rows, out):
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out), key=repr) == expected_edits(rows)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)


def test_query(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in queries.documents(spark, folder).collect()]
    out = queries.op9_fingerprints(spark, folder).collect()
    check(rows, out)
    texts, prints = dict(rows), {}
    for r in out:
        assert prints.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    mean = lambda name: sum(r[name] for r in out) / len(out)
    assert mean("near_edited") > 0.25 > mean("near_next")


def test_many_buckets(spark):
    draw = random.Random(1)
    rows = [(draw.randrange(-500, 500) if draw.random() < 0.97 else None, " ".join(draw.choices("abcé", k=draw.randrange(20)))) for _ in range(400)]
    rows += [(7, None), (8, ""), (7, "x"), (7, "x"), (9, "é" * 30_000 + " word" * 30_000)]
    docs = spark.createDataFrame([(*r, 0, 1) for r in rows], "doc_id long, text string, bucket int, ord int").repartition(5)
    check(rows, fingerprints.fingerprints(docs, rows_per_bucket=7).collect())
    check([(1, "only one")], fingerprints.fingerprints(docs.sparkSession.createDataFrame([(1, "only one")], "doc_id long, text string")).collect())
    assert fingerprints.fingerprints(docs.limit(0)).collect() == []


def plain_winnow(grams, window):
    if not grams:
        return []
    out = []
    for i in range(max(1, len(grams) - window + 1)):
        part = grams[i:i + window]
        low = min(part)
        p = i + max(j for j, g in enumerate(part) if g == low)
        if not out or out[-1] != (low, p):
            out.append((low, p))
    return out


def test_winnowing_guarantee_and_ties(spark):
    draw = random.Random(2)
    k, window = 3, 4
    texts = [" ".join(draw.choices(["a", "b", "c"], k=n)) for n in (0, 1, 2, 3, 5, 6, 7, 40, 200)] + ["a " * 50, " \t lead and\ntrail  "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # Hashes of all runs are those of a window of one; the plain version then has to choose the same.
    every, some = ({d: [(h, p) for d2, h, p in rows if d2 == d] for d in range(len(texts))} for rows in (
        [tuple(r) for r in fingerprints.spans(fingerprints.with_marks(docs, "text", k, w).drop("text"), "text_marks").collect()] for w in (1, window)))
    for d, text in enumerate(texts):
        n = len(re.findall(r"\S+", text))
        runs = [h for h, _ in sorted(every[d], key=lambda x: x[1])]
        assert len(runs) == (max(1, n - k + 1) if n else 0)
        assert some[d] == plain_winnow(runs, window)


def test_only_sql_functions(spark, folder):
    plan = queries.op9_fingerprints(spark, folder)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_short_and_unspaced_texts(spark):
    draw = random.Random(3)
    word = lambda: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randrange(4, 9)))
    texts = [" ".join(word() for _ in range(n)) for n in range(4, 20) for _ in range(6)]
    texts += ["".join(chr(draw.randrange(0x4E00, 0x5200)) for _ in range(n)) for n in (20, 100, 5000)] + [" ".join(word() for _ in range(60)), "x" * 40]
    draw.shuffle(texts)
    texts += [" ".join(f"w{i}" for i in range(15)), " ".join(f"w{i}" for i in range(25)), "\n \t"]
    out = {r["doc_id"]: r for r in fingerprints.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    n = len(texts)
    assert all(out[d]["near_edited"] > 0 for d in range(n - 1))
    assert out[n - 1]["fingerprint"] == "" and out[n - 3]["near_next"] > 0.3
    assert sum(out[d]["near_next"] for d in range(n - 4)) / (n - 4) < 0.05


def test_edited_texts_have_the_fingerprints_of_their_text(spark):
    """Also where an edit changes between runs of words and of characters."""
    draw = random.Random(4)
    word = lambda: "".join(draw.choices("abcdefghij", k=draw.randrange(3, 8)))
    texts = [" ".join(word() for _ in range(draw.choice([2, 12, 19, 20, 30]))) if draw.random() < 0.8 else "".join(word() for _ in range(20)) for _ in range(60)]
    once = {r["doc_id"]: r for r in fingerprints.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    edited = [t[:len(t) - len(t) // 2] + texts[(i + 1) % len(texts)][:len(t) // 2] for i, t in enumerate(texts)]
    again = {r["doc_id"]: r for r in fingerprints.fingerprints(spark.createDataFrame(list(enumerate(edited)), "doc_id long, text string")).collect()}
    assert all(once[i]["edited_fingerprint"] == again[i]["fingerprint"] for i in range(len(texts)))
    kinds = spark.createDataFrame(list(zip(texts, edited, strict=True)), "a string, b string").selectExpr(f"{fingerprints.by_characters('a')} AS a", f"{fingerprints.by_characters('b')} AS b")
    assert kinds.where("a <> b").count() > 0
