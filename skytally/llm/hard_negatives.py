"""Hard negatives by exact integer scores from products of residues.

Components are scaled and floored to integers. A score is an integer inner product; matrices of scores are
computed in single precision, exactly: the integers are reduced modulo several small primes, so small that the sums of
a product of residue matrices stay whole numbers in float32, and the signed scores come back from their
residues by Chinese remaindering. The primes are chosen so that their product exceeds the range of scores, which
the longest vector bounds (Cauchy-Schwarz).

The rows lie in blocks and the anchors in groups, both of bounded size by hashes of whole rows; a task scores one
group against one block. The first round finds each anchor's positives, the second, by windows around the
positives' scores, the negatives. Each block returns no more than what the answer can hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skytally.llm.common import stored

#: Components per product; sums of longer vectors are reduced in between.
CHUNK = 256


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def primes_for(length: int, bound: int) -> list[int]:
    """The largest primes whose residue products sum exactly in float32, as many as tell scores of up to ``bound`` apart."""
    most = 2 * int((2**23 / max(1, min(length, CHUNK))) ** 0.5) + 1
    out, product = [], 1
    for p in range(most, 2, -1):
        if product > 4 * (bound + most):
            return out
        if is_prime(p):
            out.append(p)
            product *= p
    if product > 4 * (bound + most):
        return out
    raise ValueError("vectors are too long for exact scores")


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Remainders nearest to zero, as float32."""
    out = np.remainder(x, p)
    return np.where(out > p // 2, out - p, out).astype(np.float32)


def product(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact ``a @ b.T`` as int64, from the residues of both modulo every prime."""
    found, modulus = None, 1
    for left, right, p in zip(a, b, primes, strict=True):
        total = np.zeros((len(left), len(right)), np.float32)
        for start in range(0, left.shape[1], CHUNK):
            total += left[:, start:start + CHUNK] @ right[:, start:start + CHUNK].T
            total -= np.rint(total * np.float32(1 / p)) * np.float32(p)
        digits = total.astype(np.int64)
        if found is None:
            found = digits
        else:  # the next digit in mixed radix, nearest to zero
            digits = np.remainder((digits - np.remainder(found, p)) * pow(modulus, -1, p), p)
            digits[digits > p // 2] -= p
            found = found + digits * modulus
        modulus *= p
    return found


def first(scores: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` of these places with the highest scores; ties go to the smaller place."""
    if len(places) > k:
        own = scores[places]
        places = places[own >= np.partition(own, len(own) - k)[len(own) - k]]
    return places[np.lexsort((places, -scores[places]))[:k]]


def usable(vectors: DataFrame, scale: float, id_column: str, vector_column: str, label: F.Column) -> DataFrame:
    """``vec_id``, ``label``, ``x`` (integers): rows with all three and finite components, of the commonest length; equal rows once."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('inf'))")
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (length["n"] if length else 0))
    return rows.selectExpr("vec_id", "label", f"transform(v, c -> floor({float(scale)}D * c)) AS x").distinct()


class Tiles:
    """Rows in blocks and anchors in groups, and the two rounds over all pairs of them."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, block: int, group: int):
        figures = rows.selectExpr("count(1) AS n", "max(size(x)) AS length", "max(aggregate(x, 0D, (s, c) -> s + double(c) * double(c))) AS square",
                                  "max(array_max(transform(x, c -> abs(double(c))))) AS most").first()
        bound = int((figures["square"] or 0) * (1 + 1e-9)) + 1
        if bound >= 2**60:
            raise ValueError("scores would pass 64 bits")
        self.primes = primes_for(figures["length"] or 1, bound)
        kind = next(k for k, bits in (("short", 15), ("int", 31), ("long", 63)) if (figures["most"] or 0) < 2**bits)
        self.n_blocks, self.n_groups = max(1, -(-figures["n"] // block)), max(1, -(-anchors.count() // group))
        whole = F.xxhash64("vec_id", "label", "x")
        rows, anchors = (d.withColumn("x", F.col("x").cast(f"array<{kind}>")) for d in (rows, anchors))
        self.rows = stored(rows.withColumn("block", F.pmod(whole, F.lit(self.n_blocks))), "blocks")
        self.anchors = anchors.withColumn("part", F.pmod(whole, F.lit(self.n_groups)))

    def scored(self, anchors: DataFrame, pick, schema: str) -> DataFrame:
        """What ``pick(anchor row, scores, ids, labels)`` gives for every anchor and block."""
        held = self.rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.n_groups - 1).cast("long"))))
        asked = anchors.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.n_blocks - 1).cast("long"))))
        primes, names = self.primes, [f.split()[0] for f in schema.split(", ")]

        def matrix(table: pa.Table) -> np.ndarray:
            column = table.column("x").combine_chunks()
            return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(table.num_rows, -1)

        def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if rows.num_rows and asked.num_rows:
                rows = rows.sort_by([("vec_id", "ascending"), ("label", "ascending")])
                ids, labels = (rows.column(c).to_numpy() for c in ("vec_id", "label"))
                x = matrix(rows)
                right = [residues(x, p) for p in primes]
                for start in range(0, asked.num_rows, 256):
                    some = asked.slice(start, 256)
                    y = matrix(some)
                    scores = product([residues(y, p) for p in primes], right, primes)
                    for anchor, row in zip(some.drop_columns(["x"]).to_pylist(), scores, strict=True):
                        out += pick(anchor, row, ids, labels)
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)

        return held.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(run, schema)

    def positives(self, count: int) -> DataFrame:
        def pick(anchor, scores, ids, labels):
            same = np.flatnonzero((labels == anchor["label"]) & (ids != anchor["vec_id"]))
            return [(anchor["anchor"], int(ids[i]), int(scores[i])) for i in first(scores, same, count)]

        found = self.scored(self.anchors, pick, "anchor long, positive_id long, positive_score long")
        nth = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id"))
        return found.withColumn("nth", nth).where(F.col("nth") <= count)

    def negatives(self, positives: DataFrame, count: int, low: int, high: int) -> DataFrame:
        windows = positives.groupBy("anchor").agg(F.collect_list(F.struct("nth", "positive_id", "positive_score")).alias("positives"))

        def pick(anchor, scores, ids, labels):
            other, out = labels != anchor["label"], []
            for p in anchor["positives"]:
                score = p["positive_score"]
                least, most = -(-low * score // 100), high * score // 100
                within = np.flatnonzero(other & (scores >= least) & (scores <= most)) if least <= most else np.zeros(0, np.int64)
                out += [(anchor["anchor"], anchor["vec_id"], p["nth"], p["positive_id"], score, int(ids[i]), int(scores[i])) for i in first(scores, within, count)]
            return out

        found = self.scored(self.anchors.join(windows, "anchor"), pick,
                            "anchor long, anchor_id long, nth long, positive_id long, positive_score long, negative_id long, negative_score long")
        rank = F.row_number().over(Window.partitionBy("anchor", "nth").orderBy(F.desc("negative_score"), "negative_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= count)


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256,
                   block: int = 8_000, group: int = 4_000, id_column: str = "vec_id", vector_column: str = "embedding", label: F.Column | None = None) -> DataFrame:
    """For every anchor (an id divisible by ``every``) and each of its ``positives`` nearest rows of the same label, the ``negatives`` nearest
    rows of other labels whose score is ``low`` to ``high`` per cent of the positive's.

    Columns ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``. Nearness is
    the exact inner product of the components floored after scaling; ties go to the smaller id. A null id, label,
    vector or component, a number that is not finite, or a length other than the commonest keeps a row out. Equal rows count once; an id
    with two different rows is an anchor twice, and no row is a positive of an anchor of its own id. Fewer rows than asked
    for give fewer results, an empty table none. Other columns are left behind. Squared lengths of 2**60 and more
    after scaling are an error, as scores would no longer fit their columns.
    """
    rows = stored(usable(vectors, scale, id_column, vector_column, F.col("label") if label is None else label), "vectors")
    anchors = stored(rows.where(F.col("vec_id") % every == 0).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    tiles = Tiles(rows, anchors, block, group)
    found = tiles.negatives(stored(tiles.positives(positives), "positives"), negatives, low, high)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
