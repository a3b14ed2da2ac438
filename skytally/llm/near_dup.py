"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of ``bands`` signatures (``rows`` minhashes each) are computed per document; a table
key is a pair, one signature of each collection. ``bands`` squared tables thus cost 2 * bands * rows
minhashes, about the square root of what independent tables cost. Documents with a key in common are
candidates, and every link is confirmed on the full shingle sets.

Copies with equal sets are one class from the start. Within a table bucket all members are first compared
with the one that shares most buckets; only members that are still in different components afterwards are compared with one
another, so a bucket of copies costs one comparison a member, no link between components is lost, and nothing
is capped. The result is the same whichever links were confirmed. Pairs whose sizes or parity sketches prove that they
differ too much leave before the sets are fetched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytally.llm.common import lists, pieces, stored
from skytally.llm.words import M1, WordHashes, mix, runs, words_of

SIGNED = "row_key long, doc_id long, n_shingles long, class long, bands_a array<long>, bands_b array<long>, sketch array<long>"
#: Bits of the parity sketch, in longs.
SKETCH = 8


def row_key() -> F.Column:
    """Names a row by its content, so that rows without an id and repeated ids are told apart."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def keyed(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("row_key", row_key())


class Shingler:
    def __init__(self, k: int):
        self.k, self.hashes = k, WordHashes()

    def sets(self, texts) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text; of all its words if they are fewer than ``k``."""
        words = [words_of(t) for t in texts]
        self.hashes.trim()
        counts = np.array([len(w) for w in words], np.int64)
        values = self.hashes.of([x for w in words for x in w])
        every, start, out = runs(values, self.k), 0, []
        for n in counts.tolist():
            if n >= self.k:
                out.append(np.unique(every[start:start + n - self.k + 1]))
            else:
                out.append(runs(values[start:start + n], n) if n else np.zeros(0, np.uint64))
            start += n
        return out


def minhashes(values: np.ndarray, starts: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """Minimum of ``count`` random hash functions over each run of values; shape (count, runs)."""
    draw = np.random.default_rng(seed)
    odd = draw.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = draw.integers(0, 2**63, count, dtype=np.uint64)
    out = np.empty((count, len(starts)), np.uint64)
    for j in range(count):
        out[j] = np.minimum.reduceat(values * odd[j] + add[j], starts)
    return out


def sketches(values: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """Per set ``SKETCH`` longs: each element flips the bit it falls on. Two sets differ in at least as many elements
    as their sketches do in bits."""
    bits = 64 * SKETCH
    flips = np.bincount(owner * bits + (mix(values * M1) % np.uint64(bits)).astype(np.int64), minlength=count * bits) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64).reshape(count, SKETCH)


def signed(docs: DataFrame, shingle: int = 5, bands: int = 10, rows: int = 3) -> DataFrame:
    """Set size, class of equal sets and the two collections of band signatures of every document."""

    def run(batches):
        shingler = Shingler(shingle)
        for batch in pieces(batches, 2_000_000):
            sets = shingler.sets(batch.column("text").to_pylist())
            sizes = np.array([len(s) for s in sets], np.int64)
            filled = np.flatnonzero(sizes)
            classes, bands_ab = np.zeros(len(sets), np.int64), np.zeros((2 * bands, len(sets)), np.int64)
            flipped = np.zeros((len(sets), SKETCH), np.int64)
            if len(filled):
                values = np.concatenate(sets)
                starts = (np.cumsum(sizes) - sizes)[filled]
                sums = np.add.reduceat(mix(values + M1), starts)
                others = np.add.reduceat(mix(values ^ M1), starts)
                classes[filled] = mix(mix(sums) * M1 + others + sizes[filled].astype(np.uint64)).view(np.int64)
                flipped = sketches(values, np.repeat(np.arange(len(sets)), sizes), len(sets))
                lows = minhashes(values, starts, 2 * bands * rows)
                for b in range(2 * bands):
                    key = np.full(len(filled), b + 1, np.uint64)
                    for r in range(rows):
                        key = mix(key * M1 + lows[b * rows + r])
                    bands_ab[b, filled] = key.view(np.int64)
            n = np.full(len(sets), bands)
            n[sizes == 0] = 0
            halves = [lists(np.ascontiguousarray(bands_ab[h:h + bands].T)[sizes > 0].ravel(), n) for h in (0, bands)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key"), batch.column("doc_id"), pa.array(sizes), pa.array(classes, mask=sizes == 0), *halves,
                 lists(flipped.ravel(), np.full(len(sets), SKETCH))],
                names=["row_key", "doc_id", "n_shingles", "class", "bands_a", "bands_b", "sketch"])

    return keyed(docs).mapInArrow(run, SIGNED)


def shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``class`` and its full set, for the classes named in ``wanted`` (row_key, class)."""

    def run(batches):
        shingler = Shingler(shingle)
        for batch in pieces(batches, 2_000_000):
            sets = shingler.sets(batch.column("text").to_pylist())
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("class"), lists(values, [len(s) for s in sets])], names=["class", "shingles"])

    rows = keyed(docs).select("row_key", "text").join(wanted, "row_key").dropDuplicates(["row_key"])
    return rows.select("class", "text").mapInArrow(run, "class long, shingles array<long>")


def candidate_keys(classes: DataFrame) -> DataFrame:
    """Table keys (``class``, ``key``) of classes that share a signature of either collection with another.

    Only such signatures can make a shared key, so the pairs are formed from these alone.
    """
    def side(column, tag):
        return classes.select("class", F.lit(tag).alias("side"), F.explode(column).alias("band"))

    bands = side("bands_a", 0).unionByName(side("bands_b", 1))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("band")
    kept = bands.join(shared, "band").groupBy("class").agg(
        F.expr("collect_list(band) FILTER (WHERE side = 0)").alias("a"), F.expr("collect_list(band) FILTER (WHERE side = 1)").alias("b"))
    pairs = kept.select("class", "b", F.explode("a").alias("one")).select("class", "one", F.explode("b").alias("two"))
    return pairs.select("class", F.xxhash64("one", "two").alias("key"))


def comparable(threshold: int) -> str:
    """Filter by size and sketch that no pair at or over the threshold fails: such sets differ in at most
    (100 - threshold) / (100 + threshold) of their summed sizes."""
    flipped = " + ".join(f"bit_count(sketch[{i}] ^ other_sketch[{i}])" for i in range(SKETCH))
    return f"{100 + threshold} * greatest({flipped}, abs(n - other_n)) <= {100 - threshold} * (n + other_n)"


def other_side(rows: DataFrame) -> DataFrame:
    """``rows`` with every column but ``key`` named for the other side of a pair."""
    return rows.select(*[F.col(c).alias(c if c == "key" else f"other_{c}" if c != "class" else "other") for c in rows.columns])


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Of ``pairs`` (class, n, other, other_n) those whose sets reach the threshold in percent."""
    full = pairs.join(sets, "class").join(sets.select(F.col("class").alias("other"), F.col("shingles").alias("other_shingles")), "other")
    both = full.select("class", "other", "n", "other_n", F.size(F.array_intersect("shingles", "other_shingles")).cast("long").alias("both"))
    return both.where(f"100 * both >= {threshold} * (n + other_n - both)").select("class", "other")


def components(links: DataFrame) -> DataFrame:
    """``class`` and the smallest class reachable, for all classes in ``links``; rounds of large and small stars.

    Every round is written to the shared folder. Hubs have one row per neighbour and are never gathered.
    """
    links = stored(links.where("class != other").select(F.greatest("class", "other").alias("u"), F.least("class", "other").alias("v")).distinct(), "links")
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").selectExpr("v as u", "m as v").where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").selectExpr("v as u", "m as v").unionByName(low.selectExpr("u", "m as v")).where("u != v").distinct()
        after = stored(small, "links")
        mark = ["count(*) as n", "coalesce(sum(xxhash64(u, v) % 1000000007), 0) as s"]
        if links.selectExpr(*mark).first() == after.selectExpr(*mark).first():
            return after.selectExpr("u as class", "v as component")
        links = after


def near_duplicates(docs: DataFrame, threshold: int = 85, shingle: int = 5, bands: int = 10, rows: int = 3) -> DataFrame:
    """Components of documents linked by 100 * intersection >= threshold * union of their shingle sets.

    Columns ``doc_id``, ``n_shingles``, ``component_id`` (smallest ``doc_id`` reachable), ``kept``, and
    ``row_key`` and ``component`` (null without words) for use by other steps. Null text and text without words have an empty set and are linked with nothing: their component is their
    own ``doc_id``. A null ``doc_id`` never names a component; repeated rows are one class and all come
    back; other columns are left behind; an empty table gives no rows.
    """
    every = stored(signed(docs, shingle, bands, rows), "signed")
    classes = every.where("class is not null").groupBy("class").agg(
        F.min("n_shingles").alias("n"), F.min("row_key").alias("row_key"), F.first("bands_a").alias("bands_a"), F.first("bands_b").alias("bands_b"),
        F.first("sketch").alias("sketch"))
    outlines = stored(classes.select("class", "n", "sketch"), "outlines")
    keys = stored(candidate_keys(classes), "keys")
    members = stored(keys.join(keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "key"), "members")
    # The member that shares most buckets with others is the likeliest to be like all of them.
    shared = members.groupBy("class").agg(F.sum("m").alias("shared"))
    leaders = members.join(shared, "class").groupBy("key").agg(F.max(F.struct("shared", "class")).alias("top")).selectExpr("key", "top.class as leader")
    stars = members.join(leaders, "key").where("class != leader").select(F.greatest("class", "leader").alias("class"), F.least("class", "leader").alias("other"))
    stars = stars.distinct().join(outlines, "class").join(other_side(outlines), "other").where(comparable(threshold))
    stars = stored(stars.select("class", "n", "other", "other_n"), "stars")
    in_buckets = members.select("class").distinct()
    wanted = every.where("class is not null").groupBy("class").agg(F.min("row_key").alias("row_key")).join(in_buckets, "class", "left_semi")
    sets = stored(shingle_sets(docs, wanted, shingle), "sets")
    links = stored(confirmed(stars, sets, threshold), "confirmed")
    found = components(links)

    placed = members.join(found, "class", "left").select("key", "class", F.coalesce("component", "class").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
    rest = stored(placed.join(mixed, "key").join(outlines, "class"), "mixed")
    across = rest.join(other_side(rest), "key").where(f"component != other_component AND class > other AND {comparable(threshold)}")
    across = across.select("class", "n", "other", "other_n").distinct().join(stars.select("class", "other"), ["class", "other"], "left_anti")
    more = stored(confirmed(across, sets, threshold), "confirmed")
    if not more.isEmpty():
        found = components(links.unionByName(more))

    joined = every.join(found, "class", "left").withColumn("component", F.coalesce("component", "class"))
    # Written first, so that the join back reads plain tables and the planner can split a large component.
    names = stored(joined.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("name")), "names")
    named = joined.join(names, "component", "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("name")))
    return named.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "row_key", "component")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs``, all columns: of every component the row of smallest ``doc_id``, equal rows once.

    Documents without words all stay. A component whose ids are all null keeps its row of smallest key.
    """
    found = near_duplicates(docs, **options)
    first = found.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("low"))
    chosen = first.select("low.row_key").unionByName(found.where("component is null").select("row_key"))
    marked = docs.withColumn("__row_key", row_key()).join(chosen.toDF("__row_key"), "__row_key", "left_semi")
    return marked.dropDuplicates(["__row_key"]).drop("__row_key")
