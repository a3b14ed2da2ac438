"""Language identification by cross-parsing.

A suffix automaton of labelled text per language reads every text and cuts it into phrases, each the longest
match with that language's text. The language that needs the fewest phrases, normalised by the logarithm of
its text's length, wins. Automata are built on a bounded, documented sample per language; every
whole text is read by all of them, many texts side by side.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skytally.llm.common import in_fold, kept, pieces, stored

#: Automata of more symbols than this look their steps up instead of keeping one for every state and symbol, and so do all
#: whose full tables would together pass so many entries.
DENSE, ENTRIES = 128, 50_000_000
#: Symbol 0 marks the end of a segment, 1 a character that a language's sample does not have.
NONE, OTHER, FIRST = 0, 1, 2
LETTER = regex.compile(r"\p{L}")
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")


def letters_only(text: str | None) -> str:
    """Lower case, with one space for every run of other characters; empty without a letter."""
    out = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return out if LETTER.search(out) else ""


def suffix_automaton(symbols) -> list[tuple[int, int, int]]:
    """Transitions (state, symbol, next state) of the automaton of all substrings; state 0 is the start."""
    after, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        new = len(after)
        after.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(after)
                after.append(dict(after[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return [(s, c, t) for s, steps in enumerate(after) for c, t in steps.items()]


@dataclass
class Model:
    """What a task needs to read texts; its size follows the sample per language, not the corpus."""

    languages: list[str]
    characters: str  # all characters of all samples; each language has those in its transitions
    transitions: list  # per language an array (state, symbol, next)
    sizes: list[int]  # characters of each language's text


class Automaton:
    """Steps of one automaton over the symbols of its own sample: next state times two, plus one where a new phrase begins."""

    def __init__(self, rows: np.ndarray, symbols: int, entries: int = ENTRIES):
        own, local = np.unique(rows[:, 1], return_inverse=True)
        self.width = FIRST + len(own)
        self.local = np.full(symbols, OTHER, np.uint8 if self.width <= 256 else np.int32)
        self.local[NONE] = NONE
        self.local[own] = FIRST + np.arange(len(own))
        states = int(rows[:, [0, 2]].max()) + 1 if len(rows) else 1
        state, symbol, after = rows[:, 0], FIRST + local.ravel(), rows[:, 2]
        first = state == 0
        self.root = np.ones(self.width, np.int32)
        self.root[symbol[first]] = after[first] * 2 + 1
        state, symbol, after = state[~first], symbol[~first], after[~first]
        self.table = self.keys = None
        if self.width <= DENSE and states * self.width <= entries:
            table = np.tile(self.root, (states, 1))
            table[state, symbol] = after * 2
            table[:, NONE] = np.arange(states) * 2
            self.table = table.ravel()
        else:
            keys = state.astype(np.int64) * self.width + symbol
            order = np.argsort(keys)
            self.keys, self.after = np.append(keys[order], np.iinfo(np.int64).max), np.append(after[order] * 2, 0).astype(np.int32)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table.take(state * self.width + symbol)
        key = state.astype(np.int64) * self.width + symbol
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.after[at], self.root[symbol])


class Reader:
    """All automata, each over its own alphabet."""

    def __init__(self, model: Model, segment: int = 512):
        self.model, self.segment = model, segment
        self.codes = np.full(0x110000, OTHER, np.int32)
        for i, c in enumerate(model.characters):
            self.codes[ord(c)] = FIRST + i
        share = ENTRIES // max(len(model.transitions), 1)
        self.automata = [Automaton(rows, FIRST + len(model.characters), share) for rows in model.transitions]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text in each language, shape (languages, texts). Long texts are read in segments."""
        out = np.zeros((len(self.automata), len(texts)), np.int64)
        coded = [self.codes[np.frombuffer(t.encode("utf-32-le"), "<u4")] for t in texts]
        size = self.segment
        owner = np.concatenate([np.full(-(-len(c) // size), i) for i, c in enumerate(coded)]).astype(np.int64) if coded else np.zeros(0, np.int64)
        if not len(owner):
            return out
        cut = [c[a:a + size] for c in coded for a in range(0, len(c), size)]
        lengths = np.array([len(c) for c in cut])
        order = np.argsort(-lengths, kind="stable")
        matrix = np.zeros((size, len(cut)), np.int32)
        for j, i in enumerate(order.tolist()):
            matrix[:lengths[i], j] = cut[i]
        active = np.searchsorted(-lengths[order], -np.arange(size), side="left")
        for k, automaton in enumerate(self.automata):
            symbols = automaton.local[matrix]
            state, count = np.zeros(len(cut), np.int32), np.zeros(len(cut), np.int32)
            for t in range(int(lengths.max())):
                n = active[t]
                step = automaton.step(state[:n], symbols[t, :n])
                count[:n] += step & 1
                state[:n] = step >> 1
            out[k] = np.bincount(owner[order], count, minlength=len(texts))
        return out


def train(docs: DataFrame, documents: int = 6_000, documents_per_language: int = 60, characters: int = 3_000_000,
          characters_per_language: int = 30_000, parts: int = 5) -> Model | None:
    """Automata of every ``lang`` value with text; None without any.

    The sample per language is at most ``documents_per_language`` distinct texts (by hash of their id) and
    ``characters_per_language`` letters; with so many languages that ``documents`` or ``characters`` in all would be passed, every
    language gets an equal, smaller share, and none is left out. A text longer than its share gives ``parts`` runs from places
    spread over all of it by the hash, so what texts open with is not all that is learned. Texts count once however often they repeat.
    """
    rows = docs.where("lang is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    named = rows.select("lang", F.xxhash64("text").alias("same"), F.struct(F.xxhash64("doc_id").alias("h"), "doc_id").alias("place"))
    distinct = stored(named.groupBy("lang", "same").agg(F.min("place").alias("place")), "labelled")
    languages = distinct.select("lang").distinct().count()
    if not languages:
        return None
    per_language = min(documents_per_language, max(1, documents // languages))
    letters = min(characters_per_language, max(2, characters // languages))
    share = max(letters // min(per_language, 20), parts)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("place", "same"))
    chosen = distinct.withColumn("nth", nth).where(F.col("nth") <= per_language).select("lang", "same", F.col("place.doc_id").alias("doc_id"))
    # ``chosen`` has at most max(documents, languages) rows, and of each at most ``share`` characters come to the driver.
    run = share // parts
    room = F.greatest(F.length("text") - run, F.lit(0))
    starts = [1 + F.floor(room * (F.lit(i) + F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(1000)) / 1000) / parts).cast("int") for i in range(parts)]
    spread = F.concat_ws(" ", *[F.substring(F.col("text"), start, F.lit(run)) for start in starts])
    sample = F.when(F.length("text") <= share, F.col("text")).otherwise(spread)
    matched = F.broadcast(chosen.withColumnRenamed("lang", "_lang").withColumnRenamed("doc_id", "_doc"))
    found = rows.withColumn("_same", F.xxhash64("text")).join(
        matched, (F.col("lang") == F.col("_lang")) & (F.col("_same") == F.col("same")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    texts = found.select("lang", "same", "doc_id", sample.alias("text")).distinct().orderBy("lang", F.xxhash64("doc_id"), "doc_id", "same", "text")
    found_parts: dict[str, list[str]] = {}
    for r in texts.collect():
        found_parts.setdefault(r["lang"], []).append(letters_only(r["text"])[:share])
    samples = {k: " ".join(x for x in dict.fromkeys(v) if x)[:letters] for k, v in found_parts.items()}
    samples = {k: v for k, v in sorted(samples.items()) if v}
    if not samples:
        return None
    alphabet = "".join(sorted(set().union(*samples.values())))
    code = {c: FIRST + i for i, c in enumerate(alphabet)}
    rows_of = [np.array(suffix_automaton([code[c] for c in text]), np.int64).reshape(-1, 3) for text in samples.values()]
    return Model(list(samples), alphabet, rows_of, [len(t) for t in samples.values()])


def judged(texts: list[str | None], reader: Reader) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Language (``und`` without letters), score, letters read and phrases of the winner."""
    clean = [letters_only(t) for t in texts]
    sizes = np.array([len(t) for t in clean], np.int64)
    counts = reader.phrases(clean)
    rates = counts * np.log2(np.maximum(reader.model.sizes, 2))[:, None]
    best = rates.argmin(axis=0)  # the first language of equals, in order of their names
    lowest = rates.min(axis=0)
    others = np.partition(rates, 1, axis=0)[1] if len(rates) > 1 else np.maximum(sizes * np.log2(max(reader.model.sizes[0], 2)), 1)
    score = np.where(sizes > 0, 1 - lowest / np.maximum(others, 1e-9), 0.0).clip(0, 1)
    names = [reader.model.languages[b] if n else "und" for b, n in zip(best.tolist(), sizes.tolist(), strict=True)]
    return names, score, sizes, np.where(sizes > 0, counts[best, np.arange(len(texts))], 0)


def with_language(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``score``, ``n_letters``, ``n_phrases``.

    Null text and text without letters are ``und`` with score 0, and so is everything if no language was learned.
    The score is one minus the ratio of the winner's normalised phrases to the runner-up's; ties go to the
    first name. Repeated rows get equal results; an empty table gives no rows; columns of the new names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "n_letters", "n_phrases")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "n_letters": F.lit(0).cast("long"), "n_phrases": F.lit(0).cast("long")})
    key = ("language", uuid.uuid4().hex)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in pieces(batches):
            reader = kept(key, lambda: Reader(shipped.value))
            names, score, sizes, phrases = judged(batch.column("text").to_pylist(), reader)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(score), pa.array(sizes), pa.array(phrases, pa.int64())],
                names=[*batch.schema.names, "lang_pred", "score", "n_letters", "n_phrases"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double, n_letters long, n_phrases long")


def identify(docs: DataFrame, **options) -> DataFrame:
    """Languages of all documents, learned from those outside the held-out fold (crc32 of the id, modulo 4, is 2)."""
    held = in_fold(4, 2)
    out = with_language(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
                        train(docs.where(~held), **options))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_letters", "n_phrases")


def recognised(docs: DataFrame, model: Model | None, excess: float = 1.8, prior: int = 100) -> DataFrame:
    """Rows of ``docs`` in a learned language: not ``und``, and not over ``excess`` times the phrases per letter usual
    (median over all documents given that language). Short texts count as if ``prior`` usual letters came with them."""
    if model is None:
        return docs
    plain = docs.select(F.col("text").cast("string").alias("text"))
    scored = stored(with_language(plain, model).select("lang_pred", "n_letters", "n_phrases"), "languages")
    usual = scored.where("n_letters > 0").groupBy("lang_pred").agg(F.percentile_approx(F.col("n_phrases") / F.col("n_letters"), 0.5, 10_000).alias("usual"))
    rate = F.lit(None).cast("double")
    for r in usual.collect():  # one row per learned language
        rate = F.when(F.col("lang_pred") == r["lang_pred"], F.lit(r["usual"])).otherwise(rate)
    found = with_language(docs, model)
    fits = (F.col("n_phrases") + prior * rate) / (F.col("n_letters") + prior) <= excess * rate
    return found.where((F.col("lang_pred") != "und") & F.coalesce(fits, F.lit(True))).select(*docs.columns)
