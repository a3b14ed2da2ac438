"""Cross-parsing against a direct search, and accuracy on the held-out fold."""

import random
import zlib

import numpy as np

from skytally.llm import langid, queries


def phrases_by_search(text, sample):
    count, i = 0, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i:j + 1] in sample and text[i] in sample:
            j += 1
        count, i = count + 1, j
    return count


def model_of(samples):
    characters = "".join(sorted(set("".join(samples.values()))))
    code = {c: langid.FIRST + i for i, c in enumerate(characters)}
    rows = [np.array(langid.suffix_automaton([code[c] for c in t]), np.int64).reshape(-1, 3) for t in samples.values()]
    return langid.Model(list(samples), characters, rows, [len(t) for t in samples.values()])


def test_phrases():
    samples = {"a": "abracadabra abba", "b": "the quick brown fox", "c": "zz"}
    texts = ["abra abba", "", "quick fox zz", "???", "a", "brownabra" * 5, "zzzz"]
    reader = langid.Reader(model_of(samples), segment=1000)
    got = reader.phrases(texts)
    for k, sample in enumerate(samples.values()):
        assert got[k].tolist() == [phrases_by_search(t, sample) for t in texts]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    lang = {r["doc_id"]: r["lang"] for r in queries.documents(spark, folder).select("doc_id", "lang").collect()}
    out = queries.op10_langid(spark, folder).collect()
    assert len(out) == len(lang)
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en", 1.0), (4, "der hund und die katze", "de", 1.0), (2, None, "en", 1.0), (3, "123 !!", None, 1.0), (5, "日本語", None, 1.0),
            (None, "the dog", None, 1.0), (6, "und die " * 9000, None, 1.0), (7, "", "de", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    out = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert len(out) == 8 and [out[k]["lang_pred"] for k in (2, 3, 7)] == ["und"] * 3
    if not out[4]["held_out"]:
        assert out[6]["lang_pred"] == "de"
    assert {r["lang_pred"] for r in langid.identify(docs.where("lang is null")).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).collect() == []


def test_many_scripts(spark):
    draw = random.Random(8)
    han, latin = [chr(c) for c in range(0x4E00, 0x4E00 + 900)], "abcdefghijklmnopqrstuvwxyzäöüßéè"
    alphabets = {"de": latin, "el": "αβγδεζηθικλμνξοπρστυφχψω", "en": latin, "ja": han[:300] + [chr(c) for c in range(0x3041, 0x3094)],
                 "ko": [chr(c) for c in range(0xAC00, 0xAC00 + 600)], "ru": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "sup": [chr(c) for c in range(0x20000, 0x20000 + 300)],
                 "yue": han, "zh": han}
    lexicon = {x: ["".join(draw.choices(letters, k=draw.randrange(2, 6))) for _ in range(400)] for x, letters in alphabets.items()}
    rows = [(x, ("" if x in ("zh", "yue") else " ").join(draw.choices(words, k=100))) for x, words in lexicon.items() for _ in range(40)]
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string")
    out = langid.identify(docs).where("held_out").collect()
    assert {rows[r["doc_id"]][0] for r in out} == set(alphabets)
    assert all(r["lang_pred"] == rows[r["doc_id"]][0] and r["score"] > 0.1 for r in out)
    assert langid.recognised(docs, langid.train(docs)).count() == len(rows)


def test_large_alphabet_phrases():
    draw = random.Random(9)
    sample = "".join(chr(0x4E00 + int(300 * draw.random() ** 2)) for _ in range(2000))
    texts = ["".join(chr(0x4E00 + int(320 * draw.random() ** 2)) for _ in range(n)) for n in (0, 1, 50, 400)] + [sample[300:900], "abc"]
    samples = {"a": "abracadabra", "zh": sample}
    reader = langid.Reader(model_of(samples), segment=1000)
    assert reader.automata[1].table is None
    assert reader.phrases(texts).tolist() == [[phrases_by_search(t, s) for t in texts] for s in samples.values()]


def invented(draw, languages, words=150):
    letters = "abcdefghijklmnopqrstuvwxyz"
    return {f"x{k:03d}": ["".join(draw.choices(letters, k=draw.randrange(3, 8))) for _ in range(words)] for k in range(languages)}


def test_common_opening(spark):
    """Texts of three languages that all open with the same 7,600 characters."""
    draw = random.Random(10)
    opening = " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(1200))[:7600]
    rows = [(x, opening + " " + " ".join(draw.choices(w, k=350))) for x, w in invented(draw, 3).items() for _ in range(40)]
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string")
    out = langid.identify(docs).where("held_out").collect()
    assert len(out) > 15 and all(r["lang_pred"] == rows[r["doc_id"]][0] for r in out)


def test_150_languages(spark):
    draw = random.Random(11)
    lexicon = invented(draw, 150)
    rows = [(x, " ".join(draw.choices(w, k=60))) for x, w in lexicon.items() for _ in range(3 if x > "x100" else 6)]
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string")
    learned = langid.train(docs.where(~langid.in_fold(4, 2)))
    assert len(learned.languages) >= 145  # all labels outside the held-out fold
    out = [r for r in langid.identify(docs).collect() if r["held_out"] and rows[r["doc_id"]][0] in learned.languages]
    assert sum(r["lang_pred"] == rows[r["doc_id"]][0] for r in out) / len(out) > 0.9
    shared = langid.train(docs, documents=200, characters=60_000)
    assert len(shared.languages) == 150 and sum(shared.sizes) <= 60_000


def test_repeated_rows_and_ties(spark):
    rows = [(1, "ab cd ef", "a"), (1, "ab cd ef", "a"), (4, "ab cd ef", "b"), (5, "ab cd ef", "b"), (6, "ab cd ef", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.sizes == [8, 8]  # a text counts once a language
    out = langid.with_language(docs, model).collect()
    assert {(r["lang_pred"], r["score"]) for r in out} == {("a", 0.0)} and len(out) == 5  # ties go to the first name


def test_tables_and_lookups_agree():
    draw = random.Random(12)
    sample = "".join(draw.choices("abcde ", k=500))
    rows = model_of({"a": sample}).transitions[0]
    wide, narrow = langid.Automaton(rows, 9), langid.Automaton(rows, 9, entries=10)
    assert wide.table is not None and narrow.table is None
    state, symbol = np.array(draw.choices(range(1, 400), k=300)), np.array(draw.choices(range(1, 8), k=300))
    assert (wide.step(state, symbol) == narrow.step(state, symbol)).all()
