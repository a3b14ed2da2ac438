"""Best-fit packing by minimum bin slack.

Every bin starts with the longest piece left; a bitset subset-sum over the lengths still available then finds
the fullest combination that fits, which is removed. How a bin is filled depends on the lengths alone, so
the bins are planned on the histogram of lengths (at most ``capacity`` rows, whatever the corpus), one pattern
repeated as often as its lengths last. The pieces themselves stay distributed: each has a rank among those
of its length, and the plan gives the sequence and offset of every rank.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skytally.llm.common import pieces, stored, texts_of
from skytally.llm.tokens import encoder_of

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length fill ``room`` best, longer lengths preferred; never more than there are."""
    everything, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x, n in counts.items() if n > 0 and x <= room), reverse=True):
        for _ in range(min(counts[length], room // length)):
            wider = (reach | reach << length) & everything
            if wider == reach:
                break
            steps.append((length, reach))
            reach = wider
        if reach >> room & 1:
            break
    left, chosen = reach.bit_length() - 1, {}
    for length, earlier in reversed(steps):
        if left and not earlier >> left & 1:
            chosen[length] = chosen.get(length, 0) + 1
            left -= length
    return chosen


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Bins as (how many alike, how many pieces of each length in one), longest first."""
    counts, bins = {x: n for x, n in counts.items() if n > 0}, []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        one = fullest(counts, capacity - longest)
        counts[longest] += 1
        one[longest] = one.get(longest, 0) + 1
        times = min(counts[x] // n for x, n in one.items())
        bins.append((times, one))
        for x, n in one.items():
            counts[x] -= times * n
            if not counts[x]:
                del counts[x]
    return bins


def places(bins: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Per pattern and length: length, first rank, pieces per bin, first sequence, offset in the bin; in order."""
    rows, used, sequence = [], {}, 0
    for times, one in bins:
        offset = 0
        for length in sorted(one, reverse=True):
            rows.append((length, used.get(length, 0), one[length], sequence, offset))
            used[length] = used.get(length, 0) + times * one[length]
            offset += length * one[length]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of every whole document with their length, checksum and rank among the task's pieces of that length.

    Documents over ``capacity`` tokens are cut so that only the first piece is shorter. Null text counts as
    empty and has the end id alone.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        encoder, seen, part = encoder_of(shipped.value), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in pieces(batches):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                begins = [0, *range(n % capacity or capacity, n, capacity), n]
                for k, (a, b) in enumerate(zip(begins[:-1], begins[1:], strict=True)):
                    rows.append((doc, k, a, b - a, zlib.crc32(ids[4 * a:4 * b]), part, int(seen[b - a])))
                    seen[b - a] += 1
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

    return texts_of(docs).mapInArrow(cut, PIECES)


def place(cut: DataFrame, capacity: int) -> DataFrame:
    """Sequence and offset of stored pieces. Ranks come from counts per task and length, not from a global sort."""
    per_part = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    bases = per_part.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row per length
    plan = cut.sparkSession.sparkContext.broadcast(places(plan_bins(counts, capacity)))

    def assign(batches):
        rows = plan.value
        keys = rows[:, 0] << 44 | rows[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            own = rows[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            nth = rank - own[:, 1]
            kept = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(own[:, 3] + nth // own[:, 2]), pa.array(own[:, 4] + nth % own[:, 2] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("local_rank")).drop("base", "local_rank", "part")
    return ranked.mapInArrow(assign, PLACED)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """All documents in few sequences of at most ``capacity`` tokens, one row per piece.

    Null or empty text is the end id alone; null ``doc_id`` and repeated rows are kept, each row a document of
    its own; other columns are left behind; an empty table gives no rows.
    """
    return place(stored(token_pieces(docs, vocabulary, capacity, end_id), "pieces"), capacity)
