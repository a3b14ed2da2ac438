"""Licence notices in texts by a positional index of rare words.

The index holds, for every word of the templates, its postings (template, position). How rare a word is
is counted over all documents. In a file the rarest of a template's words that it has are looked up; every occurrence
and every posting propose the place where the template would begin, and places close together that enough of the
rare words agree on are candidates. A candidate is a match if its words include the template's mandatory
phrases and enough of its neighbouring pairs of words. Phrases go the same way: all places of their rarest word,
and all their words by relative position.

The index is built from the templates alone, so its size does not depend on the corpus; files are scanned where they lie.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytally.llm.common import pieces, texts_of
from skytally.llm.licence_texts import NOTICES, PHRASES

#: Bytes of words stand for themselves (letters in lower case), all others are blanks.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCANNED = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
           "matches array<struct<label: string, first_word: long, coverage: double>>")


class Templates:
    """Templates and phrases as word numbers (from 1), and the postings of every word."""

    def __init__(self, notices=NOTICES, phrases=PHRASES):
        self.vocabulary: dict[bytes, int] = {}
        self.labels = [label for label, _, _ in notices]
        self.texts = [self.numbers(text) for _, text, _ in notices]
        self.mandatory = [[self.numbers(p) for p in keys] for _, _, keys in notices]
        self.phrases = [(label, self.numbers(phrase)) for phrase, label in phrases.items()]
        self.size = len(self.vocabulary) + 1
        self.postings = [{w: np.flatnonzero(text == w) for w in np.unique(text).tolist()} for text in self.texts]
        self.pairs = [np.unique(text[:-1].astype(np.int64) * self.size + text[1:]) for text in self.texts]

    def numbers(self, text: str) -> np.ndarray:
        words = text.encode().translate(WORD_BYTES).split()
        return np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int32)

    def words_in(self, text: str | None, part: int = 4_000_000) -> np.ndarray:
        """Every word of a text as its number; 0 for words of no template. Long texts are read in parts cut at blanks."""
        blank, out, start = (text or "").encode().translate(WORD_BYTES), [], 0
        while start < len(blank):
            end = len(blank) if len(blank) - start <= part else blank.find(b" ", start + part)
            end = len(blank) if end < 0 else end
            words = blank[start:end].split()
            out.append(np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words)))
            start = end
        return np.concatenate(out) if out else np.zeros(0, np.int32)


def rarity(docs: DataFrame, templates: Templates) -> np.ndarray:
    """Inverse document frequency of every template word over all documents; the figures have the size of the vocabulary."""

    def run(batches):
        counts, n = np.zeros(templates.size, np.int64), 0
        for batch in pieces(batches):
            for text in batch.column("text").to_pylist():
                counts[np.flatnonzero(np.bincount(templates.words_in(text), minlength=templates.size))] += 1
                n += 1
        counts[0] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(templates.size)), pa.array(counts)], names=["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(templates.size)
    for r in rows:
        counts[r["word"]] = r["n"]
    return np.log((counts[0] + 1) / (counts + 0.5)).clip(1e-6)


class Scanner:
    def __init__(self, templates: Templates, idf: np.ndarray, rare: int, agreement: float, coverage: float):
        self.templates, self.idf, self.rare, self.agreement, self.coverage = templates, idf, rare, agreement, coverage
        self.weights = np.zeros((len(templates.texts), templates.size))
        for t, postings in enumerate(templates.postings):
            self.weights[t, list(postings)] = idf[list(postings)]
        self.totals = self.weights.sum(1)

    def places(self, phrase: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Where the phrase's words stand one after the other."""
        at = int(np.argmax(self.idf[phrase]))
        starts = np.flatnonzero(words == phrase[at]) - at
        starts = starts[(starts >= 0) & (starts <= len(words) - len(phrase))]
        for j, w in enumerate(phrase.tolist()):
            starts = starts[words[starts + j] == w]
        return starts

    def matches(self, words: np.ndarray) -> list[tuple[str, int, float]]:
        """Label, first word and coverage of every verified place of a template."""
        present = np.bincount(words, minlength=self.templates.size) > 0
        present[0] = False
        likely = np.flatnonzero(self.weights @ present >= self.agreement * self.totals)
        out = []
        for t in likely.tolist():
            keys = [self.places(phrase, words) for phrase in self.templates.mandatory[t]]
            if not all(len(k) for k in keys):
                continue
            postings = self.templates.postings[t]
            rarest = sorted((w for w in postings if present[w]), key=lambda w: (-self.idf[w], w))[:self.rare]
            slack = max(2, len(self.templates.texts[t]) // 10)
            offsets = [(np.flatnonzero(words == w)[:, None] - postings[w]).ravel() for w in rarest]
            owner = np.repeat(np.arange(len(rarest)), [len(o) for o in offsets])
            starts = np.concatenate(offsets)
            order = np.argsort(starts, kind="stable")
            starts, owner = starts[order], owner[order]
            group = np.concatenate([[0], np.cumsum(np.diff(starts) > slack)])
            seen = np.unique(group * len(rarest) + owner)
            weight = self.idf[rarest]
            agreed = np.bincount(seen // len(rarest), weights=weight[seen % len(rarest)])
            firsts = np.flatnonzero(np.diff(group, prepend=-1))
            lasts = np.append(firsts[1:], len(starts)) - 1
            for g in np.flatnonzero(agreed >= self.agreement * weight.sum()).tolist():
                low = max(0, int(starts[firsts[g]]) - slack)
                high = min(len(words), int(starts[lasts[g]]) + len(self.templates.texts[t]) + slack)
                if all(np.searchsorted(k, low) < np.searchsorted(k, high - len(phrase), side="right") for k, phrase in zip(keys, self.templates.mandatory[t], strict=True)):
                    own = words[low:high].astype(np.int64)
                    share = float(np.isin(self.templates.pairs[t], own[:-1] * self.templates.size + own[1:]).mean())
                    if share >= self.coverage:
                        out.append((self.templates.labels[t], max(0, int(starts[firsts[g]])), share))
        return sorted(out)

    def scan(self, text: str | None) -> tuple:
        words = self.templates.words_in(text)
        found = {}
        if words.any():
            found = {label: p for label, phrase in self.templates.phrases if len(p := self.places(phrase, words))}
        every = np.concatenate(list(found.values())) if found else np.zeros(0, np.int64)
        return (len(words), len(every), int(every.min()) if found else None, int(every.max()) if found else None, sorted(found),
                self.matches(words) if words.any() else [])


def scan(docs: DataFrame, notices=NOTICES, phrases=PHRASES, rare: int = 8, agreement: float = 0.5, coverage: float = 0.6) -> DataFrame:
    """Phrases and licence notices of every document.

    Per row of ``docs``: ``doc_id``, ``n_words``, ``n_base`` (places of phrases), ``first_word`` and ``last_word`` (the smallest and
    largest of them), ``base_labels`` (sorted), ``matches`` (label, first word, coverage). A template matches where at least
    ``agreement`` of the weight of the file's ``rare`` rarest words of it agree on a place (within a tenth of its length), all its
    mandatory phrases stand there, and ``coverage`` of its neighbouring pairs of words. Null and empty texts have no words; whole texts
    are read however long; repeated rows and null ids are rows like others; other columns are left behind; an empty
    table gives no rows.
    """
    templates = Templates(notices, phrases)
    rows = texts_of(docs)
    idf = rarity(rows, templates)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()),
             pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("coverage", pa.float64())]))]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "matches"]

    def run(batches):
        scanner = Scanner(templates, idf, rare, agreement, coverage)
        for batch in pieces(batches):
            columns = list(zip(*map(scanner.scan, batch.column("text").to_pylist()), strict=True))
            columns[5] = [[dict(zip(("label", "first_word", "coverage"), m, strict=True)) for m in row] for row in columns[5]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)

    return rows.mapInArrow(run, SCANNED)


def labelled(scanned: DataFrame) -> DataFrame:
    """Digest of a scan: ``base_labels``, ``labels`` (those of matches too), both sorted and comma-joined, and ``score``, the best
    coverage found; the place of a phrase counts as 1."""
    every = F.array_sort(F.array_distinct(F.concat("base_labels", F.col("matches.label"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max("matches.coverage"), F.lit(0.0)))
    return scanned.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                          F.array_join(every, ",").alias("labels"), score.alias("score"), F.size("matches").cast("long").alias("n_matches"))
