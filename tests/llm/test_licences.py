"""Phrases and licence notices against brute force, with edits, odd texts and clean documents."""

import re

import numpy as np

from skytally.llm import licences, queries
from skytally.llm.licence_texts import NOTICES, PHRASES

ODD = [None, "", " ", "...", "a" * 5000, "ñandú CC-BY été", "MIT\x00License", "mit  \n license", "mit. license", "smit license", "mit licenses", "mitÄ license",
       "cc by" * 3, "CC BY CC BY cc by", "ſmit license", "GNU General Public License, GNU general\tPUBLIC license", "apache 2 license"]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def base(text):
    words, places = words_of(text), []
    for phrase, label in PHRASES.items():
        phrase = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i:i + len(phrase)] == phrase]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def frame(spark, texts):
    rows = [(i if i else None, t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, label string, n_words int").repartition(3)


def test_base_against_brute_force(spark):
    texts = ODD + ODD[-3:] + [" ".join(["word"] * 300 + ["Apache", "License"] + ["word"] * 200_000 + ["(MIT License)"])]
    got = {r["doc_id"]: r for r in licences.labelled(licences.scan(frame(spark, texts))).collect()}
    for i, text in enumerate(texts):
        r = got[i if i else None]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(text), repr(text)[:60]
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_words_are_read_in_parts():
    templates = licences.Templates()
    text = "the mit license " * 50 + "é" * 40 + " apache license"
    assert templates.words_in(text, part=7).tolist() == templates.words_in(text).tolist()
    assert len(templates.words_in("x" * 100, part=7)) == 1


def test_every_notice_is_found_with_edits(spark):
    draw, texts = np.random.default_rng(2), []
    filler = ["lorem", "ipsum", "software", "the", "of", "work", "license"]
    for _, text, keys in NOTICES:
        words = text.split()
        fixed = {i + j for k in keys for i in range(len(words)) if words[i:i + len(k.split())] == k.split() for j in range(len(k.split()))}
        if len(words) > 40:  # every twentieth other word replaced, a few inserted
            words = [w if i in fixed or draw.random() > 0.05 else "changed" for i, w in enumerate(words)]
            free = next(i for i in range(20, len(words)) if i not in fixed)
            words[free:free] = ["an", "insertion"]
        texts.append(" ".join([*draw.choice(filler, 300), *[w.upper() if i % 2 else w for i, w in enumerate(words)], *draw.choice(filler, 200)]))
    clean = [" ".join(draw.choice(filler + ["permission", "granted", "warranty", "version", "2", "0", "public"], 400)) for _ in range(20)]
    got = {r["doc_id"]: r for r in licences.labelled(licences.scan(frame(spark, [""] + texts + clean))).collect()}
    for i, (label, _, _) in enumerate(NOTICES):
        assert label in got[i + 1]["labels"].split(","), label
        assert 0.6 <= got[i + 1]["score"] <= 1
    for i in range(len(clean)):
        r = got[len(texts) + 1 + i]
        assert (r["labels"], r["score"]) == ("", 0.0)


def test_every_place_is_reported(spark):
    line = "Released under the MIT License. "
    text = "one two three " + (line + "filler " * 40) * 3
    row = licences.scan(frame(spark, ["", text])).where("doc_id = 1").first()
    assert row["n_base"] == 3
    assert [m["first_word"] for m in row["matches"] if m["coverage"] == 1.0] == [3, 48, 93]


def test_empty_table(spark):
    assert licences.labelled(licences.scan(frame(spark, ODD).limit(0))).collect() == []


def test_query_against_brute_force(spark, folder):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op13_licences(spark, folder).collect()
    assert len(rows) == len(docs)
    assert any(r["n_base"] for r in rows)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(docs[r["doc_id"]])
        assert (r["score"] > 0) == bool(r["labels"])
