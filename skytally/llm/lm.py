"""Language-model scoring with a hierarchical Pitman-Yor model.

Every context is a restaurant whose dishes are words and whose tables are customers of one shared parent restaurant
of single words; below that lies a uniform base over the training vocabulary and one unknown word. The context of
a word is the one before it, each a restaurant of its own. Seating is sampled by Gibbs sweeps: all customers of a dish
in a restaurant are seated anew by the Chinese-restaurant rule, given everyone else's tables. After the burn-in,
predictive probabilities are averaged over the samples.

The corpus is cut into blocks of bounded size that carry their documents' words as numbers. Each block counts its
pairs of context and word before anything is shuffled; counts are summed, and tables sampled, in shards of the
word's hash, whose number follows the corpus. The totals of contexts are summed in as many parts of the context's hash. Every block
gets back the figures of its own words and contexts only; no vocabulary is ever gathered in one place. While it samples, a shard takes
the tables of a restaurant it shares to be its own times the ratio of the different words that follow there, in all shards, to its own ones; the
probabilities use the true totals of all shards.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytally.llm.common import in_fold, pieces, stored, texts_of
from skytally.llm.words import WordHashes, mix

#: Hashes of the end of a text, as a word, and of its start, as a context.
END, START = np.uint64(0x656E64), np.uint64(0x7374617274)
SPACE = re.compile(rb"[ \t-\r]")

BLOCKS = "block long, row array<long>, doc_id array<long>, held array<boolean>, first array<long>, size array<int>, words binary, codes binary"
COUNTS = "shard int, block long, words binary, pairs binary, met binary, contexts binary, counts binary"
TYPES = "part int, shard int, met binary, types binary"
FIGURES = "shard int, block long, pair_count binary, pair_tables binary, word_count binary, word_tables binary, word_roots binary, totals array<long>, part int, met binary, per_context binary"
SCORES = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


@dataclass(frozen=True)
class Settings:
    contexts: int | None = None  # classes that the word before is folded into; None: every word is a context of its own
    discount: float = 0.8
    strength: float = 1.0
    root_discount: float = 0.6
    root_strength: float = 1.0
    burn_in: int = 2
    samples: int = 3
    block_bytes: int = 16_000_000
    shard_tokens: int = 3_000_000
    seed: int = 11


def packed(values: np.ndarray, kind) -> bytes:
    """Integers as compressed planes of bytes, low bytes first."""
    values = np.ascontiguousarray(values, kind)
    planes = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    raw, width = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def context_of(hashes: np.ndarray, contexts: int | None) -> np.ndarray:
    return hashes if contexts is None else mix(hashes ^ START) % np.uint64(contexts)


def contexts_of(words: np.ndarray, first: np.ndarray, contexts: int | None) -> np.ndarray:
    """All contexts that a block may have, ascending: those of its words and those its segments begin in."""
    return np.unique(np.concatenate([context_of(words, contexts), np.asarray(first, np.int64).view(np.uint64)]))


def places(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's part of ascending hashes begins, and the end; shards are ranges of the hash."""
    limits = np.array([(s << 64) // shards for s in range(1, shards)], np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, limits), [len(hashes)]]).astype(np.int64)


def merged(parts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different values of ascending arrays, ascending, and where each array's values are among them."""
    every = np.concatenate(parts)
    every.sort()
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    every = every[new]
    return every, [np.searchsorted(every, p).astype(np.int32) for p in parts]


def word_parts(text: str | None, size: int = 1_000_000):
    """Words of a text in runs that come from at most about ``size`` bytes each."""
    data = (text or "").encode().lower()
    start = 0
    while len(data) - start > size:
        cut = SPACE.search(data, start + size)
        if cut is None:
            break
        yield data[start:cut.start()].split()
        start = cut.start()
    yield data[start:].split()


class Block:
    """Segments of documents gathered until they are large enough for one row."""

    def __init__(self):
        self.rows, self.hashes, self.bytes = [], [], 0

    def add(self, row, doc, held, first, hashes, size):
        self.rows.append((row, doc, held, int(first.view(np.int64)), len(hashes)))
        self.hashes.append(hashes)
        self.bytes += size

    def batch(self, number: int) -> pa.RecordBatch:
        every = np.concatenate(self.hashes)
        words, codes, n = np.unique(every, return_inverse=True, return_counts=True)
        often = np.argsort(-n, kind="stable")
        place = np.empty(len(often), np.uint32)
        place[often] = np.arange(len(often), dtype=np.uint32)
        columns = list(zip(*self.rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), *[pa.array([list(c)], pa.list_(k)) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32()), strict=True)],
             pa.array([words[often].tobytes()], pa.binary()), pa.array([packed(place[codes], np.uint32)], pa.binary())],
            names=["block", "row", "doc_id", "held", "first", "size", "words", "codes"])


def blocks_of(docs: DataFrame, held: F.Column, settings: Settings) -> DataFrame:
    """All documents as blocks: per segment its row, id, fold, first context and length; the words by frequency; their numbers."""

    def run(batches):
        task, known, block, number, row = TaskContext.get().partitionId() << 32, WordHashes(), Block(), 0, 0
        for batch in pieces(batches):
            for doc, text, held_out in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "held")), strict=True):
                first, waiting = context_of(np.array([START]), settings.contexts)[0], np.zeros(0, np.uint64)
                for words in word_parts(text):
                    known.trim()
                    if len(waiting):
                        block.add(task + row, doc, held_out, first, waiting, 8 * len(waiting))
                        first = context_of(waiting[-1:], settings.contexts)[0]
                    waiting = known.of(words)
                    if block.bytes > settings.block_bytes:
                        yield block.batch(task + number)
                        block, number = Block(), number + 1
                block.add(task + row, doc, held_out, first, np.append(waiting, END), 8 * len(waiting))
                row += 1
                if block.bytes > settings.block_bytes:
                    yield block.batch(task + number)
                    block, number = Block(), number + 1
        if block.rows:
            yield block.batch(task + number)

    return texts_of(docs.withColumn("held", held), "held").mapInArrow(run, BLOCKS)


@dataclass
class Opened:
    """A block's words and contexts in order of hash, its different pairs in order of word and context, and where its tokens have them."""

    words: np.ndarray
    contexts: np.ndarray
    word_of_pair: np.ndarray
    context_of_pair: np.ndarray
    token_pair: np.ndarray
    sizes: np.ndarray
    held: np.ndarray

    @classmethod
    def of(cls, first, size, held, words, codes, contexts: int | None) -> Opened:
        words, codes = np.frombuffer(words, np.uint64), unpacked(codes, np.uint32)
        order = np.argsort(words, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order)) << 32
        every = contexts_of(words, first, contexts)
        classes = np.searchsorted(every, context_of(words, contexts)).astype(np.int32)
        context = np.empty(len(codes), np.int32)
        context[1:] = classes[codes[:-1]]
        sizes = np.asarray(size, np.int64)
        context[np.cumsum(sizes) - sizes] = np.searchsorted(every, np.asarray(first, np.int64).view(np.uint64))
        keys = place[codes]
        keys |= context
        del codes, context, place, classes
        by_pair = np.argsort(keys)
        keys = keys[by_pair]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        token_pair = np.empty(len(keys), np.int32)
        token_pair[by_pair] = np.cumsum(new, dtype=np.int32) - 1
        del by_pair
        pairs = keys[new]
        return cls(words[order], every, (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32), token_pair, sizes, np.asarray(held, bool))

    def cuts(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each shard's words and pairs begin."""
        at_word = places(self.words, shards)
        return at_word, np.searchsorted(self.word_of_pair, at_word)


def counts_of(blocks: DataFrame, shards: int, settings: Settings) -> DataFrame:
    """Per block and shard: the words met there, the contexts they follow, and the training count of every pair met there (nought if only held out)."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                b = Opened.of(r["first"], r["size"], r["held"], r["words"], r["codes"], settings.contexts)
                training = np.repeat(~b.held, b.sizes)
                counts = np.bincount(b.token_pair[training], minlength=len(b.word_of_pair))
                per_word = np.bincount(b.word_of_pair, minlength=len(b.words))
                at_word, at_pair = b.cuts(shards)
                rows = []
                for s, (w0, w1, p0, p1) in enumerate(zip(at_word[:-1], at_word[1:], at_pair[:-1], at_pair[1:], strict=True)):
                    if w1 > w0:
                        met, context = np.unique(b.context_of_pair[p0:p1], return_inverse=True)
                        rows.append((s, r["block"], b.words[w0:w1].tobytes(), packed(per_word[w0:w1], np.uint32), b.contexts[met].tobytes(), packed(context, np.uint32), packed(counts[p0:p1], np.uint32)))
                kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["shard", "block", "words", "pairs", "met", "contexts", "counts"])

    return blocks.mapInArrow(run, COUNTS)


class Shard:
    """The counts of one shard summed over all blocks: its words, the pairs met, and the pairs and contexts of training text.

    ``word_at`` and ``pair_at`` have the places of every row's words and pairs; a row's pairs are all different. Rows are
    opened one after the other, so that no more than the keys of all pairs is held at once.
    """

    def __init__(self, rows: pd.DataFrame):
        self.words, self.word_at = merged([np.frombuffer(x, np.uint64) for x in rows["words"]])
        contexts, context_at = merged([np.frombuffer(x, np.uint64) for x in rows["met"]])
        keys = []
        for pairs, context, word, met in zip(rows["pairs"], rows["contexts"], self.word_at, context_at, strict=True):
            keys.append(np.repeat(word.astype(np.int64) << 32, unpacked(pairs, np.uint32)) | met[unpacked(context, np.uint32)])
        del context_at
        self.keys, self.pair_at = merged(keys)
        del keys
        count = np.zeros(len(self.keys), np.int64)
        for at, counts in zip(self.pair_at, rows["counts"], strict=True):
            count[at] += unpacked(counts, np.uint32)
        self.trained = np.flatnonzero(count)
        self.count = count[self.trained]
        trained = self.keys[self.trained]
        self.word = (trained >> 32).astype(np.int32)
        trained = (trained & 0xFFFFFFFF).astype(np.int32)
        used = np.flatnonzero(np.bincount(trained, minlength=len(contexts)))
        self.context = np.searchsorted(used, trained).astype(np.int32)
        self.contexts = contexts[used]
        self.types = np.bincount(self.context, minlength=len(used))

    def parts(self, shards: int):
        """Number and range of the contexts of each part that has any."""
        at = places(self.contexts, shards)
        return [(i, slice(a, b)) for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]


def types_of(counts: DataFrame, shards: int) -> DataFrame:
    """For every shard, by parts of the context's hash: the different words that follow each of its contexts, in all shards."""

    def own(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["shard"].iat[0])
        shard = Shard(rows)
        out = [(i, number, shard.contexts[p].tobytes(), packed(shard.types[p], np.uint32)) for i, p in shard.parts(shards)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in TYPES.split(", ")])

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        met = [np.frombuffer(m, np.uint64) for m in rows["met"]]
        contexts, at = np.unique(np.concatenate(met), return_inverse=True)
        total = np.bincount(at, np.concatenate([unpacked(t, np.uint32) for t in rows["types"]]), minlength=len(contexts))
        ends = np.cumsum([len(m) for m in met])
        types = [packed(total[at[e - len(m):e]], np.uint64) for m, e in zip(met, ends, strict=True)]
        return pd.DataFrame({"shard": rows["shard"], "part": rows["part"], "types": types})

    return counts.groupBy("shard").applyInPandas(own, TYPES).groupBy("part").applyInPandas(summed, "shard int, part int, types binary")


def seated(customers: np.ndarray, weight: np.ndarray, discount: float, draw: np.random.Generator, exact: int = 48) -> np.ndarray:
    """Tables of each dish when its customers come one after the other: a new table has ``weight``, the others the
    customers before less ``discount`` per table. Past ``exact`` customers the number of new tables is drawn at once."""
    tables = (customers > 0).astype(np.int64)
    many = np.flatnonzero(customers > 1)
    many = many[np.argsort(-customers[many], kind="stable")]
    n, a, t = customers[many], weight[many], np.ones(len(many))
    for k in range(1, exact):
        live = int(np.searchsorted(-n, -k, side="left"))
        if not live:
            break
        t[:live] += draw.random(live) < a[:live] / (a[:live] + k - discount * t[:live])
    live = int(np.searchsorted(-n, -exact, side="left"))
    if live:
        now, left = np.maximum(a[:live] - discount * t[:live], -exact + 1.0), n[:live] - exact
        t[:live] += np.minimum(draw.poisson(a[:live] * np.log((now + n[:live]) / (now + exact))), left)
    tables[many] = t.astype(np.int64)
    return tables


def sampled(word: np.ndarray, context: np.ndarray, count: np.ndarray, words: int, shards: int, settings: Settings, draw, share=None) -> list[tuple]:
    """Gibbs samples of one shard: tables per pair, and per word the parent's customers and tables. ``share`` is by how much
    each restaurant's tables are more in all shards than in this one; without it, by as much as there are shards."""
    share = shards if share is None else share
    tables = np.ones(len(count), np.int64)
    out = []
    vocabulary = max(1, int((np.bincount(word, count, minlength=words) > 0).sum())) * shards
    roots = np.ones(words, np.int64)
    for sweep in range(settings.burn_in + settings.samples):
        customers = np.bincount(word, tables, minlength=words).astype(np.int64)
        spread = settings.root_strength + settings.root_discount * shards * float(roots[customers > 0].sum())
        roots = seated(customers, np.full(words, spread / (vocabulary + 1)), settings.root_discount, draw)
        parent = (customers - settings.root_discount * roots + spread / (vocabulary + 1)) / (settings.root_strength + shards * float(customers.sum()))
        laid = np.bincount(context, tables) * share
        tables = seated(count, (settings.strength + settings.discount * laid[context]) * parent[word], settings.discount, draw)
        if sweep >= settings.burn_in:
            customers = np.bincount(word, tables, minlength=words).astype(np.int64)
            out.append((tables, customers, np.minimum(roots, np.maximum(customers, 0))))
    return out


def seat(counts: DataFrame, shards: int, settings: Settings) -> DataFrame:
    """Sums the counts of each shard over all blocks, samples, and returns to every block the figures of its pairs and
    words; more rows per shard, with a null block, hold its totals and, by parts, those of its contexts."""

    def run(rows: pd.DataFrame, types: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block", kind="stable")
        number = int(rows["shard"].iat[0])
        shard = Shard(rows)
        words, word, context, count = len(shard.words), shard.word, shard.context, shard.count
        everywhere = [unpacked(t, np.uint64) for t in types.sort_values("part")["types"]]
        share = np.concatenate([np.zeros(0), *everywhere]) / shard.types
        samples = sampled(word, context, count, words, shards, settings, np.random.default_rng((settings.seed, number)), share)
        pair_count, tables = np.zeros(len(shard.keys), np.int64), np.zeros(len(shard.keys), np.int64)
        pair_count[shard.trained], tables[shard.trained] = count, sum(s[0] for s in samples)
        word_count = np.bincount(word, count, minlength=words).astype(np.int64)
        out = []
        for block, p, w in zip(rows["block"], shard.pair_at, shard.word_at, strict=True):
            out.append((number, block, packed(pair_count[p], np.uint32), packed(tables[p], np.uint32), packed(word_count[w], np.uint64),
                        packed(np.concatenate([s[1][w] for s in samples]), np.uint64), packed(np.concatenate([s[2][w] for s in samples]), np.uint64), None, None, None, None))
        totals = [int(word_count.sum()), int((word_count > 0).sum()), *[int(s[1].sum()) for s in samples], *[int(s[2].sum()) for s in samples]]
        out.append((number, *[None] * 6, totals, None, None, None))
        per_context = [np.bincount(context, x, minlength=len(shard.contexts)) for x in (count, *[s[0] for s in samples])]
        for part, p in shard.parts(shards):
            out.append((number, *[None] * 7, part, shard.contexts[p].tobytes(), packed(np.concatenate([x[p] for x in per_context]), np.uint64)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in FIGURES.split(", ")]).astype({"block": "Int64", "part": "Int32"})

    return counts.groupBy("shard").cogroup(types_of(counts, shards).groupBy("shard")).applyInPandas(run, FIGURES)


def context_figures(blocks: DataFrame, figures: DataFrame, shards: int, settings: Settings) -> DataFrame:
    """For every block, by parts of the context's hash: the customers and, per sample, the tables of each of its contexts in all shards."""

    def ask(batches):
        for batch in batches:
            for block, words, first in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "first")), strict=True):
                contexts = contexts_of(np.frombuffer(words, np.uint64), first, settings.contexts)
                at = places(contexts, shards)
                rows = [(i, block, contexts[a:b].tobytes()) for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["part", "block", "contexts"])

    def run(asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        met = [np.frombuffer(m, np.uint64) for m in found["met"]]
        contexts, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *met]), return_inverse=True)
        sums, start = np.zeros((settings.samples + 1, len(contexts) + 1), np.int64), 0  # the last column is of contexts without training text
        for m, values in zip(met, found["per_context"], strict=True):
            sums[:, at[start:start + len(m)]] += unpacked(values, np.uint64).astype(np.int64).reshape(settings.samples + 1, -1)
            start += len(m)
        out = []
        for block, part, wanted in zip(asked["block"], asked["part"], asked["contexts"], strict=True):
            wanted = np.frombuffer(wanted, np.uint64)
            place = np.searchsorted(contexts, wanted)
            place[np.append(contexts, np.uint64(0))[place] != wanted] = len(contexts)
            out.append((block, part, packed(sums[:, place].ravel(), np.uint64)))
        return pd.DataFrame(out, columns=["block", "part", "per_context"])

    asked = blocks.select("block", "words", "first").mapInArrow(ask, "part int, block long, contexts binary")
    found = figures.where("part IS NOT NULL").select("part", "met", "per_context")
    return asked.groupBy("part").cogroup(found.groupBy("part")).applyInPandas(run, "block long, part int, per_context binary")


@dataclass
class Totals:
    """Sums over all shards: training tokens and vocabulary, the parent's customers and tables per sample; and, for the contexts
    at hand, the customers and, per sample, the tables."""

    tokens: int
    vocabulary: int
    customers: np.ndarray
    roots: np.ndarray
    per_context: np.ndarray | None = None


def totals_of(figures: DataFrame, settings: Settings) -> Totals:
    own = figures.where("totals IS NOT NULL")
    n, k = 2 + 2 * settings.samples, settings.samples
    sums = own.select(*[F.coalesce(F.sum(F.col("totals")[i]), F.lit(0)) for i in range(n)]).first()
    return Totals(sums[0], sums[1], np.array(sums[2:2 + k], np.float64), np.array(sums[2 + k:], np.float64))


def pair_probabilities(count, tables, word, context, customers, roots, totals: Totals, settings: Settings) -> np.ndarray:
    """Predictive probability of each pair, averaged over the samples; ``tables`` are summed over them."""
    k, d, d0 = settings.samples, settings.discount, settings.root_discount
    spread = (settings.root_strength + d0 * totals.roots) / (totals.vocabulary + 1)
    parent = (customers - d0 * roots + spread[:, None]) / (settings.root_strength + totals.customers)[:, None]
    back = np.zeros(len(count))
    for s in range(k):
        back += (settings.strength + d * totals.per_context[1 + s][context]) * parent[s][word]
    return (count - d * tables / k + back / k) / (settings.strength + totals.per_context[0][context])


def scored(blocks: DataFrame, figures: DataFrame, shards: int, totals: Totals, settings: Settings) -> DataFrame:
    """Scores of every segment, from its block and the figures the shards returned to it."""
    shipped = blocks.sparkSession.sparkContext.broadcast(totals)  # fixed size

    def run(block: pd.DataFrame, returned: pd.DataFrame) -> pd.DataFrame:
        totals, rows = shipped.value, []
        for r in block.itertuples():
            b = Opened.of(r.first, r.size_, r.held, r.words, r.codes, settings.contexts)
            at_word, at_pair = b.cuts(shards)
            count, tables = np.zeros(len(b.word_of_pair)), np.zeros(len(b.word_of_pair))
            known, customers, roots = np.zeros(len(b.words)), np.zeros((settings.samples, len(b.words))), np.zeros((settings.samples, len(b.words)))
            per_context = [np.zeros((settings.samples + 1, 0))]
            for f in returned.sort_values("part").itertuples():
                if not pd.isna(f.part):
                    per_context.append(unpacked(f.per_context, np.uint64).reshape(settings.samples + 1, -1))
                    continue
                shard = int(f.shard)
                pairs, words = slice(at_pair[shard], at_pair[shard + 1]), slice(at_word[shard], at_word[shard + 1])
                count[pairs], tables[pairs] = unpacked(f.pair_count, np.uint32), unpacked(f.pair_tables, np.uint32)
                known[words] = unpacked(f.word_count, np.uint64)
                customers[:, words] = unpacked(f.word_tables, np.uint64).reshape(settings.samples, -1)
                roots[:, words] = unpacked(f.word_roots, np.uint64).reshape(settings.samples, -1)
            here = replace(totals, per_context=np.concatenate(per_context, axis=1).astype(np.float64))
            p = np.log10(pair_probabilities(count, tables, b.word_of_pair, b.context_of_pair, customers, roots, here, settings))
            base = np.log10((known + 1) / (totals.tokens + totals.vocabulary + 1))
            starts, token_word = np.cumsum(b.sizes) - b.sizes, b.word_of_pair[b.token_pair]
            sums = [np.add.reduceat(x[at], starts) for x, at in (((known > 0).astype(np.int64), token_word), (base, token_word), (p, b.token_pair))]
            rows.append(pd.DataFrame({"row": r.row, "doc_id": pd.array(r.doc_id, dtype="Int64"), "held_out": b.held, "n_tokens": b.sizes, "n_known": sums[0], "base_score": sums[1], "score": sums[2]}))
        return pd.concat(rows) if rows else pd.DataFrame(columns=[c.split()[0] for c in SCORES.split(", ")])

    renamed = blocks.withColumnRenamed("size", "size_")
    own = figures.where("block IS NOT NULL").drop("totals", "part", "met", "per_context")
    returns = own.unionByName(context_figures(blocks, figures, shards, settings), allowMissingColumns=True)
    return renamed.groupBy("block").cogroup(returns.groupBy("block")).applyInPandas(run, SCORES)


def score(docs: DataFrame, held: F.Column | None = None, settings: Settings | None = None) -> DataFrame:
    """Scores of all documents by a model of those that ``held`` (default: crc32 of the id, modulo 7, is 2) leaves out.

    Columns ``doc_id``, ``held_out``, ``n_tokens`` (with the end), ``n_known``, ``train_tokens``, ``base_score`` (add-one) and ``score``,
    both log10 probabilities of the whole text. Null text counts as empty and has the end alone. Every row is a
    document of its own, repeated or without id; other columns are left behind. Without training documents all words
    are unknown; an empty table gives no rows.
    """
    settings = settings or Settings()
    blocks = stored(blocks_of(docs, in_fold(7, 2) if held is None else held, settings), "blocks")
    tokens = blocks.select(F.coalesce(F.sum(F.expr("aggregate(size, 0L, (a, x) -> a + x)")), F.lit(0))).first()[0]
    shards = max(1, -(-tokens // settings.shard_tokens))
    figures = stored(seat(counts_of(blocks, shards, settings), shards, settings), "figures")
    totals = totals_of(figures, settings)
    found = scored(blocks, figures, shards, totals, settings).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score")
