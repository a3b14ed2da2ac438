"""Quality classifier: interpolated modified Kneser-Ney character model of trusted text.

The model is counted on all trusted labelled documents. Counts, discounts, context
totals and interpolated probabilities are Spark aggregates and joins sharded by gram and context. Every character of the trusted text
is a symbol of its own, whatever its script; only decimal digits share one. The model stays a table: documents are put into
blocks, each block asks for its different grams once, these are joined with the counts, and the block gets back the
logarithms of its own grams only. Every whole document gets its entropy per character (the
logarithm of its perplexity). The documents accepted are those between two quantiles of the trusted documents of their
language, which are taken over all trusted documents and widened towards those of all languages where
they are few. Trusted documents are in two folds by the hash of their id, and each counts twice there: with its entropy by the whole
model, which has seen it, and by the counts of the other fold, which have not.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skytally.llm.common import pieces, stored, stored_by

#: Symbols 0 and 1 stand for the ends of a text and for characters that the trusted text does not have.
END, OTHER, FIRST = 0, 1, 2
#: Positions whose grams are made and looked up at a time.
BLOCK = 1 << 20
#: Bytes of text whose grams are looked up together.
BLOCK_BYTES = 16_000_000
#: Counts of all trusted text, and of those in the first and in the second fold.
MODELS = range(3)


def most_symbols(order: int) -> int:
    """Symbols of which ``order`` make a number of 63 bits: 55,108 at order 4, more than the characters in common use."""
    return min(2**16, int(2 ** (63 / order)))


@cache
def folded() -> np.ndarray:
    """The code point that stands for each: ``0`` for every decimal digit, since which number it is tells nothing of quality."""
    table = np.arange(0x110000, dtype="<u4")
    table[[c for c in range(len(table)) if chr(c).isdecimal()]] = ord("0")
    return table


def code_points(text: str) -> np.ndarray:
    return folded()[np.frombuffer(text.encode("utf-32-le"), "<u4")]


class Alphabet:
    """Every character of the trusted text as a symbol, the most frequent first; all others share one."""

    def __init__(self, characters: str, order: int):
        codes = np.frombuffer(characters.encode("utf-32-le"), "<u4")[: most_symbols(order) - FIRST]
        self.size = FIRST + len(codes)
        self.table = np.full(0x110000, OTHER, np.uint16)
        self.table[codes] = np.arange(FIRST, self.size)
        self.table = self.table[folded()]

    def symbols(self, text: str) -> np.ndarray:
        return self.table[np.frombuffer(text.encode("utf-32-le"), "<u4")]


def grams(texts: list[np.ndarray], order: int, size: int):
    """Keys (base ``size`` numbers) of the ``order`` symbols that end at each symbol and at each text's end, in blocks."""
    pad, end = np.full(order - 1, END, np.uint16), np.zeros(1, np.uint16)
    flat = np.concatenate([x for t in texts for x in (pad, t, end)])
    # Keys that end in the padding of the following text are left out.
    keep = np.ones(len(flat), bool)
    place = 0
    for t in texts:
        keep[place:place + order - 1] = False
        place += len(t) + order
    for start in range(order - 1, len(flat), BLOCK):
        stop = min(start + BLOCK, len(flat))
        key = np.zeros(stop - start, np.int64)
        for j in range(1 - order, 1):
            key = key * size + flat[start + j:stop + j]
        yield key[keep[start:stop]]


def looked_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    """The value of each key, or what ``otherwise`` has in its place if it is not among the ``known`` (ascending)."""
    if not len(known):
        return otherwise
    place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[place] == keys, values[place], otherwise)


def names(prefix: str) -> list[str]:
    return [f"{prefix}{i}" for i in MODELS]


@dataclass
class Model:
    """Per order, the tables of the grams seen (``k``, probabilities ``p0`` to ``p2``) and of their contexts (``context``, the weights
    ``w0`` to ``w2`` that go to the shorter context), by each of the ``MODELS``; null where one has not seen them."""

    characters: str
    order: int
    grams: list
    contexts: list
    folds: bool  # whether both folds have text

    def logs_of(self, keys: DataFrame) -> DataFrame:
        """Natural log probabilities ``l0`` to ``l2`` of the last symbol of the different grams ``k``; shorter contexts fill what was not seen."""
        size, low = FIRST + len(self.characters), None
        for n in range(self.order):
            wanted = keys if n == self.order - 1 else keys.select((F.col("k") % size ** (n + 1)).alias("k")).distinct()
            found = wanted.withColumn("context", F.expr(f"k div {size}")).join(self.grams[n], "k", "left").join(self.contexts[n], "context", "left")
            if low is not None:
                found = found.withColumn("low_key", F.col("k") % size**n).join(low, "low_key")
            shorter = [F.lit(1 / size) if low is None else F.col(x) for x in names("low")]
            values = [F.coalesce(p, s * F.coalesce(w, F.lit(1.0))) for p, s, w in zip(names("p"), shorter, map(F.col, names("w")), strict=True)]
            low = stored(found.select(F.col("k").alias("low_key"), *[v.alias(x) for v, x in zip(values, names("low"), strict=True)]), "logs")
        return low.select(F.col("low_key").alias("k"), *[F.log(x).cast("float").alias(y) for x, y in zip(names("low"), names("l"), strict=True)])

    # The model of all trusted text on one machine, for a look at small ones; documents are scored by the tables.

    @cached_property
    def probabilities(self) -> list:
        return [self._arrays(t, "k", "p0") for t in self.grams]

    @cached_property
    def weights(self) -> list:
        return [self._arrays(t, "context", "w0") for t in self.contexts]

    @staticmethod
    def _arrays(df: DataFrame, key: str, value: str):
        keys, values = (c.to_numpy() for c in df.select(key, value).where(F.col(value).isNotNull()).toArrow().columns)
        ascending = np.argsort(keys)
        return keys[ascending], values[ascending].astype(np.float32)

    def logs(self, keys: np.ndarray, size: int) -> np.ndarray:
        codes, distinct = pd.factorize(keys, sort=True)
        value = np.full(len(distinct), 1.0 / size)
        for n in range(self.order):
            gram = distinct % size ** (n + 1)
            value = looked_up(gram, *self.probabilities[n], value * looked_up(gram // size, *self.weights[n], np.ones(len(gram))))
        return np.log(value).astype(np.float32)[codes]


def train(texts: DataFrame, order: int = 4) -> Model | None:
    """Count all ``texts`` (column ``text``, and ``q_fold``, 0 or 1, if they are in folds) and build the model; None without any text."""
    if "q_fold" not in texts.columns:
        texts = texts.withColumn("q_fold", F.lit(0))

    def frequent(batches):
        for batch in batches:
            counts = np.zeros(0x110000, np.int64)
            for t in batch.column("text").to_pylist():
                values, n = np.unique(code_points(t or ""), return_counts=True)
                counts[values] += n
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen])], names=["c", "n"])

    letters = texts.mapInArrow(frequent, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").limit(most_symbols(order) - FIRST)
    characters = "".join(chr(r["c"]) for r in letters.collect())
    if not characters:
        return None

    size = FIRST + len(characters)

    def count(batches):
        alphabet = Alphabet(characters, order)
        for batch in pieces(batches):
            folds = batch.column("q_fold").to_numpy()
            for fold in np.unique(folds):
                chosen = batch.filter(pa.array(folds == fold))
                for block in grams([alphabet.symbols(t or "") for t in chosen.column("text").to_pylist()], order, size):
                    codes, keys = pd.factorize(block)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), fold), pa.int32()), pa.array(keys, pa.int64()), pa.array(np.bincount(codes), pa.int64())], names=["q_fold", "k", "n"])

    own = [F.sum(F.when(F.col("q_fold") == fold, F.col("n")).otherwise(0)) for fold in (0, 1)]
    longest = texts.mapInArrow(count, "q_fold int, k long, n long").groupBy("k").agg(F.sum("n").alias("n0"), *[x.alias(f"n{i}") for i, x in enumerate(own, 1)])
    counts = [stored(longest, "grams")]
    for n in range(order - 1, 0, -1):  # a shorter gram counts the different symbols before it
        counts.insert(0, stored(counts[0].groupBy((F.col("k") % size**n).alias("k")).agg(*[F.count_if(F.col(x) > 0).alias(x) for x in names("n")]), "grams"))
    low, found, weights = None, [], []
    for n, rows in enumerate(counts):
        rows = rows.withColumn("context", F.expr(f"k div {size}"))
        few = rows.agg(*[F.count_if(F.col(x) == c).alias(f"{x}_{c}") for x in names("n") for c in (1, 2, 3, 4)], *[F.max(x).alias(x) for x in names("n")]).first()
        taken = []
        for x in names("n"):
            ones = [few[f"{x}_{c}"] for c in (1, 2, 3, 4)]
            y = ones[0] / (ones[0] + 2 * ones[1]) if ones[0] + ones[1] else 0.5
            drop = [max(0.05, c - (c + 1) * y * ones[c] / max(ones[c - 1], 1)) for c in (1, 2, 3)]
            taken.append(F.when(F.col(x) == 0, 0.0).when(F.col(x) == 1, drop[0]).when(F.col(x) == 2, drop[1]).otherwise(drop[2]))
        totals = rows.groupBy("context").agg(*[F.sum(x).alias(f"t{i}") for i, x in enumerate(names("n"))], *[F.sum(d).alias(f"d{i}") for i, d in enumerate(taken)])
        totals = totals.select("context", *[f"t{i}" for i in MODELS], *[F.when(F.col(f"t{i}") > 0, F.col(f"d{i}") / F.col(f"t{i}")).alias(f"w{i}") for i in MODELS])
        joined = rows.join(totals, "context").withColumn("low_key", F.col("k") % size**n)
        if low is not None:
            joined = joined.join(low, "low_key")
        shorter = [F.lit(1 / size) if low is None else F.col(x) for x in names("low")]
        values = [F.when(F.col(f"n{i}") > 0, (F.col(f"n{i}") - taken[i]) / F.col(f"t{i}") + F.col(f"w{i}") * shorter[i]).alias(f"p{i}") for i in MODELS]
        value = stored(joined.select("k", *values), "probabilities")
        low = value.select(F.col("k").alias("low_key"), *[F.col(f"p{i}").alias(f"low{i}") for i in MODELS])
        found.append(value)
        weights.append(stored(totals.select("context", *names("w")), "weights"))
    return Model(characters, order, found, weights, few["n1"] > 0 and few["n2"] > 0)


def entropies(texts: list[str | None], alphabet: Alphabet, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (with the end) and summed negative log probability of each text, by the model on one machine."""
    symbols = [alphabet.symbols(t or "") for t in texts]
    sizes = np.array([len(s) + 1 for s in symbols], np.int64)
    values = np.concatenate([model.logs(block, alphabet.size) for block in grams(symbols, model.order, alphabet.size)])
    return sizes, -np.add.reduceat(values, np.cumsum(sizes) - sizes, dtype=np.float64)


def in_blocks(docs: DataFrame) -> DataFrame:
    """``docs``, stored by block, with a number ``q_row`` of each row, its fold ``q_fold``, the block ``q_block`` that it is in and whether it has ``q_letters``."""

    def run(batches):
        row = block = TaskContext.get().partitionId() << 32
        filled = 0
        for batch in pieces(batches):
            numbers = [pa.array(np.arange(row, row + batch.num_rows)), pa.array(np.full(batch.num_rows, block))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *numbers], names=[*batch.schema.names, "q_row", "q_block"])
            row, filled = row + batch.num_rows, filled + (pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0)
            if filled > BLOCK_BYTES:
                block, filled = block + 1, 0

    docs = docs.withColumn("text", F.col("text").cast("string"))
    docs = docs.withColumn("q_letters", F.coalesce("text", F.lit("")).rlike(r"\p{L}")).withColumn("q_fold", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(2)).cast("int"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return stored_by(docs.mapInArrow(run, f"{kinds}, q_row long, q_block long"), "documents", "q_block", compression="zstd")


def texts_at(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``q_fold`` of the rows ``wanted`` (``doc_id``, ``q_row``, ``q_block``); the text of a block is read where it lies."""

    def run(texts: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        return texts.merge(wanted, left_on="q_row", right_on="w_row")[["w_id", "text", "q_fold"]].rename(columns={"w_id": "doc_id"})

    texts = blocks.select("q_block", "q_row", "q_fold", F.coalesce("text", F.lit("")).alias("text"))
    wanted = wanted.select(F.col("doc_id").alias("w_id"), F.col("q_row").alias("w_row"), F.col("q_block").alias("w_block"))
    return texts.groupBy("q_block").cogroup(wanted.groupBy("w_block")).applyInPandas(run, "doc_id long, text string, q_fold int")


def with_logs(blocks: DataFrame, model: Model) -> DataFrame:
    """Of every row of ``blocks``: ``q_row``, ``q_symbols``, ``q_nats`` by the whole model and ``q_unseen`` by that of the other fold."""
    characters, order, folds = model.characters, model.order, model.folds

    def ask(batches):
        alphabet, asked, block = Alphabet(characters, order), [], None
        for batch in pieces(batches):
            numbers = batch.column("q_block").to_numpy()
            for number in np.unique(numbers):
                if number != block and asked:
                    yield table_of(block, asked)
                    asked = []
                block = number
                texts = batch.filter(pa.array(numbers == number)).column("text").to_pylist()
                asked += [pd.unique(keys) for keys in grams([alphabet.symbols(t or "") for t in texts], order, alphabet.size)]
                if sum(map(len, asked)) > 4 * BLOCK:
                    asked = [np.unique(np.concatenate(asked))]
        if asked:
            yield table_of(block, asked)

    def table_of(block, asked):
        keys = np.unique(np.concatenate(asked))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block)), pa.array(keys)], names=["q_block", "k"])

    def run(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        answers = answers.sort_values("k")
        known, values = answers["k"].to_numpy(), [answers[x].to_numpy() for x in names("l")]
        if not len(texts):
            return pd.DataFrame(columns=["q_row", "q_symbols", "q_nats", "q_unseen"])
        alphabet, out = Alphabet(characters, order), []
        ends = np.cumsum(texts["text"].str.len().to_numpy() + order) // BLOCK
        for _, part in texts.groupby(ends, sort=False):  # about as many characters as are made into grams at a time
            symbols = [alphabet.symbols(t) for t in part["text"]]
            sizes = np.array([len(s) + 1 for s in symbols], np.int64)
            places = []
            for keys in grams(symbols, order, alphabet.size):
                codes, distinct = pd.factorize(keys)
                places.append(np.searchsorted(known, distinct).astype(np.int32)[codes])
            place, starts = np.concatenate(places), np.cumsum(sizes) - sizes
            nats = [-np.add.reduceat(v[place], starts, dtype=np.float64) for v in (values if folds else values[:1])]
            unseen = np.where(part["q_fold"] == 0, nats[2], nats[1]) if folds else nats[0]
            out.append(pd.DataFrame({"q_row": part["q_row"], "q_symbols": sizes, "q_nats": nats[0], "q_unseen": unseen}))
        return pd.concat(out)

    asked = stored(blocks.select("q_block", "text").mapInArrow(ask, "q_block long, k long"), "asked", compression="zstd")
    answers = asked.join(model.logs_of(asked.select("k").distinct()), "k").select("q_block", "k", *names("l"))
    texts = blocks.select("q_block", "q_row", "q_fold", F.coalesce("text", F.lit("")).alias("text"))
    return stored(texts.groupBy("q_block").cogroup(answers.groupBy("q_block")).applyInPandas(run, "q_row long, q_symbols long, q_nats double, q_unseen double"), "entropies")


@dataclass
class Limits:
    """Usual entropy, lowest and highest accepted: ``of`` has them as ``q_limits`` for each language ``q_lang`` with trusted text,
    ``anywhere`` holds for text of no language. Other languages have no limits."""

    of: DataFrame | None
    anywhere: tuple
    prior: int

    def join(self, scored: DataFrame) -> DataFrame:
        """Adds ``entropy``, ``lowest`` and ``highest`` to rows with ``lang``, ``q_letters``, ``q_symbols`` and ``q_nats``."""
        found = scored.join(self.of, F.col("lang").cast("string") == F.col("q_lang"), "left")
        no_language = F.col("lang").isNull() | ~F.col("q_letters")
        anywhere = F.struct(*[F.lit(v).cast("double").alias(n) for n, v in zip(("usual", "lowest", "highest"), self.anywhere, strict=True)])
        found = found.withColumn("q_limits", F.when(F.col("q_limits").isNotNull(), F.col("q_limits")).when(no_language, anywhere))
        usual = F.col("q_limits.usual")
        entropy = F.coalesce(shrunk(usual, self.prior), F.col("q_nats") / F.col("q_symbols"))
        return found.withColumns({"entropy": entropy, "lowest": F.col("q_limits.lowest"), "highest": F.col("q_limits.highest")}).drop("q_lang", "q_limits")


def shrunk(usual: F.Column, prior: int) -> F.Column:
    """Entropy per character. Short texts say little: they count as if ``prior`` characters of usual entropy came with them."""
    return (F.col("q_nats") + prior * usual) / (F.col("q_symbols") + prior)


def limits(scores: DataFrame, trusted: DataFrame, low: float, high: float, prior: int, pool: int = 200) -> Limits:
    """Quantiles over all trusted documents of each language that has any, however few, each as counted and as unseen.

    The usual entropy of a language is its median, shrunk towards that of all by the variance within languages over that
    between them. Its limits are its own quantiles around that, widened towards those of all languages around theirs by
    ``pool / (n + pool)`` for ``n`` documents, and never narrower than its own.
    """
    both = F.explode(F.array("q_nats", "q_unseen")).alias("q_nats")
    mine = stored(scores.join(trusted.select("doc_id").distinct(), "doc_id").select("lang", "q_symbols", both), "trusted-scores")
    raw = F.col("q_nats") / F.col("q_symbols")
    center = mine.agg(F.percentile_approx(raw, 0.5, 10_000)).first()[0]
    if center is None:
        return Limits(None, (None, None, None), prior)
    groups = mine.groupBy("lang").agg((F.count(F.lit(1)) / 2).alias("n"), F.percentile_approx(raw, 0.5, 10_000).alias("median"), F.var_pop(raw).alias("within"))
    within, between = groups.agg(F.sum(F.col("n") * F.col("within")) / F.sum("n"), F.var_samp("median")).first()
    few = within / between if between else 0.0
    groups = groups.select(F.col("lang").alias("q_lang"), "n", ((F.col("n") * F.col("median") + few * center) / (F.col("n") + few)).alias("usual"))
    around = mine.join(groups, F.col("lang").eqNullSafe(F.col("q_lang"))).withColumn("away", shrunk(F.col("usual"), prior) - F.col("usual"))
    cuts = F.percentile_approx("away", [low, high], 100_000)
    every = around.agg(cuts).first()[0]
    own = around.groupBy("q_lang").agg(F.first("n").alias("n"), F.first("usual").alias("usual"), cuts.alias("own"))
    share = pool / (F.col("n") + pool)

    def widened(i, wider):  # one document more than the median was taken of: the variance grows by 1 / n
        return F.col("usual") + wider(F.col("own")[i], (1 - share) * F.col("own")[i] + share * every[i] * F.sqrt(1 + 1 / F.col("n")))

    of = stored(own.select("q_lang", F.struct("usual", widened(0, F.least).alias("lowest"), widened(1, F.greatest).alias("highest")).alias("q_limits")), "limits")
    ends = of.agg(F.min("q_limits.lowest"), F.max("q_limits.highest")).first()
    return Limits(of, (center, *ends), prior)


def _fitted(docs: DataFrame, labels: DataFrame, low: float = 0.0005, high: float = 0.999, prior: int = 200, order: int = 4,
            sample: int | None = None, characters: int | None = None) -> tuple[Model | None, Limits, DataFrame]:
    """Model, limits, and the rows of ``docs`` with what ``with_logs`` adds to them."""
    trusted = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    blocks = in_blocks(docs)
    rows = blocks.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "q_row", "q_block")
    chosen = trusted
    if sample is not None:
        present = stored(rows.select("doc_id").join(trusted, "doc_id").distinct(), "trusted-ids")
        chosen = present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(min(sample, -(-present.count() // 2)))
    texts = texts_at(blocks, rows.drop("lang").join(chosen, "doc_id")).where("text != ''")
    if characters is not None:
        texts = texts.where(F.length("text") <= characters)
    texts = stored(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("q_fold").alias("q_fold")), "trusted-texts", compression="zstd")
    if characters is not None:
        before = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        counted = texts.select("doc_id", F.length("text").alias("n")).withColumn("n", F.sum("n").over(before)).where(F.col("n") <= characters)
        texts = texts.join(counted, "doc_id")
    model = train(texts.select("text", "q_fold"), order)
    if model is None:
        return None, Limits(None, (None, None, None), prior), blocks
    logs = with_logs(blocks, model)
    if sample is not None or characters is not None:  # the trusted documents left out are unseen
        logs = logs.withColumn("q_unseen", F.col("q_nats"))
    bounds = limits(rows.select("q_row", "doc_id", "lang").join(logs, "q_row"), trusted, low, high, prior)
    return model, bounds, blocks.join(logs, "q_row")


def fit(docs: DataFrame, labels: DataFrame, **options) -> tuple[Model | None, Limits]:
    """Model and limits. All trusted documents are counted; of rows that share an id the one of smallest text. Trusted are those
    labelled ``quality`` 1 and not ``toxic``. Options: quantiles ``low`` and ``high``, ``prior`` characters, ``order``, and, for trials on less, ``sample``
    documents (by hash of their id, half of them at most) or the first of them that have up to ``characters`` characters together."""
    return _fitted(docs, labels, **options)[:2]


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """All columns of ``docs`` with ``n_symbols``, ``perplexity``, ``entropy`` (shrunk), ``lowest``, ``highest`` and ``accepted``.

    Null and empty text count as text without characters: usual entropy, accepted. A language with few trusted documents
    has wider limits of its own; a language without any has none, and its documents are accepted with null limits. A null
    ``lang``, or there a text without letters, is rejected if it lies outside the limits of every language. Without any
    trusted text nothing is rejected and the scores are null. Repeated rows get equal scores; an empty table gives no rows. Columns of ``docs`` that have one of
    the new names are replaced.
    """
    new = ("n_symbols", "perplexity", "entropy", "lowest", "highest", "accepted")
    own = ("q_symbols", "q_nats", "q_unseen", "q_lang", "q_limits", "q_row", "q_fold", "q_block", "q_letters")
    model, bounds, scored = _fitted(docs.drop(*new, *own), labels, **options)
    if model is None:
        nothing = {n: F.lit(None).cast("double") for n in new[1:5]}
        return scored.withColumns({"n_symbols": F.lit(None).cast("long")} | nothing | {"accepted": F.lit(True)}).drop(*own)
    out = bounds.join(scored.withColumns({"n_symbols": F.col("q_symbols"), "perplexity": F.exp(F.col("q_nats") / F.col("q_symbols"))}))
    inside = (F.col("entropy") >= F.col("lowest")) & (F.col("entropy") <= F.col("highest"))
    return out.withColumn("accepted", F.coalesce(inside, F.lit(True)) | (F.col("q_symbols") <= 1)).drop(*own)
