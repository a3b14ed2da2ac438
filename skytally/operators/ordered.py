"""Running columns per key in time order, safe when one key holds a large share of the rows.

A plain window sends every row of a key to one task. Here the rows are first cut, in order of key
and time, into slices of about equal row counts (``split_hot_keys``); a key that two cuts or more go through
is windowed per (key, slice), and what a slice needs from the slices before it is
brought in from a small table with a row or two per cut, checkpointed. The result is the same as
the plain window over the whole key. Bursts, equal times and missing times are cut like any
other rows. Where no key has two cuts the plan is the plain window: one shuffle, one sort.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType
from pyspark.sql.window import Window, WindowSpec

from skytally.operators.stages import compute_once, cut_lineage

ROWS_PER_SLICE = 1_000_000
#: Rows looked at per slice to find the cuts, and in all; more slices get fewer each, and stay less even.
SAMPLE_PER_SLICE = 100
SAMPLE = 1_000_000


def as_list(names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def slice_column(keys) -> str:
    return "_slice__" + "__".join(as_list(keys))


def micros(ts: str | Column) -> Column:
    """Timestamp as microseconds, with or without time zone."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / 1_000_000.0


def _cuts(sample: Callable[[float], DataFrame], columns: list[str], slices: int, total: int) -> list[tuple]:
    """``slices`` - 1 rows that cut the sorted rows about evenly."""
    if slices < 2:
        return []
    wanted = min(SAMPLE, SAMPLE_PER_SLICE * slices)
    # About ``SAMPLE`` rows at most. Dealt out first, as a sort reads its input twice.
    drawn = sample(min(1.0, wanted / total)).select(*columns).repartition(-(-wanted // 100_000)).orderBy(*columns).collect()
    return [tuple(drawn[i * len(drawn) // slices]) for i in range(1, slices)] if drawn else []


def _of_hot_keys(cuts: list[tuple], width: int) -> list[tuple]:
    """Cuts whose key, their first ``width`` values, has another cut. A key with a single one has fewer than two slices' rows."""

    def same(a: tuple, b: tuple) -> bool:
        return all(x == y or (x != x and y != y) for x, y in zip(a[:width], b[:width], strict=True))

    after = [same(a, b) for a, b in zip(cuts, cuts[1:])]
    return [c for i, c in enumerate(cuts) if any(after[max(i - 1, 0):i + 1])]


def split_hot_keys(df: DataFrame, keysets, order, rows_per_slice: int = ROWS_PER_SLICE, rows: int | None = None,
                   sample: Callable[[float], DataFrame] | None = None) -> DataFrame:
    """Mark the slices of keys that do not fit into two slices of about ``rows_per_slice`` rows.

    ``keysets`` is a column name, a list of them, or a list of such lists; slices of a key also serve every
    finer key. ``order`` is the total order that later scans use, the time first. ``rows`` is the
    row count, or a bound of it, if it is known; ``sample`` draws a share of the rows where that costs less than making
    them all. The output has one more integer column per key set
    whose keys were cut: 0 for rows of whole keys, 1 and up for the slices of the others.
    """
    order = as_list(order)
    if isinstance(keysets, str):
        keysets = [[keysets]]
    elif keysets and isinstance(keysets[0], str):
        keysets = [list(keysets)]
    done: list[set[str]] = []
    for keys in sorted((as_list(k) for k in keysets), key=len):
        if any(d <= set(keys) for d in done):
            continue
        done.append(set(keys))
        columns = [*keys, *order]
        total = df.select(*columns).count() if rows is None else rows
        drawn = sample or (lambda share, of=df.select(*columns): of.sample(share, seed=7))
        cuts = _of_hot_keys(_cuts(drawn, columns, -(-total // rows_per_slice), total), len(keys))
        if not cuts:
            continue
        step = max(1, int(len(cuts) ** 0.5))
        tuples = ArrayType(StructType([df.schema[c] for c in columns]))
        one = df.sparkSession.createDataFrame([(cuts, cuts[step - 1::step])], StructType([StructField("_cuts", tuples), StructField("_coarse", tuples)]))
        kept, row = df.columns, "struct(" + ", ".join(f"`{c}`" for c in columns) + ")"

        def same_key(at: str) -> str:
            return " AND ".join(f"`{k}` <=> get(_cuts, {at}).`{k}`" for k in keys)

        marked = df.crossJoin(F.broadcast(one))  # one row
        marked = compute_once(marked, {"_low": f"{step} * size(filter(_coarse, c -> c <= {row}))"})
        marked = compute_once(marked, {"_at": f"_low + size(filter(slice(_cuts, _low + 1, {step}), c -> c <= {row}))"})
        cut = f"(_at > 0 AND {same_key('_at - 1')}) OR (_at < {len(cuts)} AND {same_key('_at')})"
        number = F.expr(f"CASE WHEN {cut} THEN _at + 1 ELSE 0 END")
        df = marked.select(*[f"`{c}`" for c in kept], number.alias(slice_column(keys), metadata={"order": order}))
    return df


def slice_of(df: DataFrame, keys) -> str | None:
    """The slice column that serves a key: its own, or that of a part of the key.

    Slices follow time, so the slices of an address also cut each track of that address.
    """
    keys, present = as_list(keys), set(df.columns)
    for size in range(len(keys), 0, -1):
        for part in combinations(keys, size):
            if slice_column(part) in present:
                return slice_column(part)
    return None


def is_sliced(df: DataFrame, keys) -> bool:
    return slice_of(df, keys) is not None


def partition_columns(df: DataFrame, keys) -> list[str]:
    """Columns that keep a task's share bounded: the key, and its slice if it was split."""
    keys = as_list(keys)
    return [*keys, slice_of(df, keys)] if is_sliced(df, keys) else keys


def drop_slices(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_slice__")])


# --- running columns --------------------------------------------------------------------


@dataclass(frozen=True)
class Previous:
    """Value of the row before, as ``lag``."""

    value: Column
    backward = False

    def within(self, w: WindowSpec, upto: WindowSpec) -> Column:
        return F.lag(F.struct(self.value.alias("v"))).over(w)

    def summary(self, order) -> Column:
        return F.max_by(F.struct(self.value.alias("v")), F.struct(*order))

    def carry(self, summary: Column, before: WindowSpec) -> Column:
        return F.last(summary, ignorenulls=True).over(before)

    def combine(self, inner: Column, carried: Column) -> Column:
        return F.coalesce(inner, carried)

    def finish(self, inner: Column) -> Column:
        return inner["v"]


@dataclass(frozen=True)
class Next:
    """Value of the row after, as ``lead``."""

    value: Column
    backward = True

    def within(self, w, upto):
        return F.lead(F.struct(self.value.alias("v"))).over(w)

    def summary(self, order):
        return F.min_by(F.struct(self.value.alias("v")), F.struct(*order))

    def carry(self, summary, before):
        return F.last(summary, ignorenulls=True).over(before)

    def combine(self, inner, carried):
        return F.coalesce(inner, carried)

    def finish(self, inner):
        return inner["v"]


@dataclass(frozen=True)
class Total:
    """Running sum of a numeric column up to and including the row."""

    value: Column
    backward = False

    def within(self, w, upto):
        return F.sum(self.value).over(upto)

    def summary(self, order):
        return F.sum(self.value)

    def carry(self, summary, before):
        return F.sum(summary).over(before)

    def combine(self, inner, carried):
        return F.when(carried.isNull(), inner).otherwise(F.coalesce(inner, F.lit(0)) + carried)

    def finish(self, inner):
        return inner


@dataclass(frozen=True)
class Highest:
    """Running maximum up to and including the row."""

    value: Column
    backward = False

    def within(self, w, upto):
        return F.max(self.value).over(upto)

    def summary(self, order):
        return F.max(self.value)

    def carry(self, summary, before):
        return F.max(summary).over(before)

    def combine(self, inner, carried):
        return F.greatest(inner, carried)

    def finish(self, inner):
        return inner


@dataclass(frozen=True)
class Latest:
    """Newest value for which ``when`` held, up to and including the row.

    Without ``when`` the newest non-null value. With it a null value counts, so that a
    null report overwrites an older value.
    """

    value: Column
    when: Column | None = None
    backward = False

    def _taken(self):
        condition = self.value.isNotNull() if self.when is None else F.coalesce(self.when, F.lit(False))
        return F.when(condition, F.struct(self.value.alias("v")))

    def within(self, w, upto):
        return F.last(self._taken(), ignorenulls=True).over(upto)

    def summary(self, order):
        taken = self._taken()
        return F.max_by(taken, F.when(taken.isNotNull(), F.struct(*order)))

    def carry(self, summary, before):
        return F.last(summary, ignorenulls=True).over(before)

    def combine(self, inner, carried):
        return F.coalesce(inner, carried)

    def finish(self, inner):
        return inner["v"]


@dataclass(frozen=True)
class RowsAfter:
    """Number of rows of the key after this one."""

    backward = True

    def summary(self, order):
        return F.count(F.lit(1))

    def carry(self, summary, before):
        return F.sum(summary).over(before)

    def combine(self, inner, carried):
        return inner + F.coalesce(carried, F.lit(0))

    def finish(self, inner):
        return inner


def row_numbers() -> Total:
    """Row number within the key, from 1."""
    return Total(F.lit(1).cast("long"))


def scan(df: DataFrame, keys, order, **columns) -> DataFrame:
    """Add running columns over the rows of each key in the given total order.

    All columns of one call share one shuffle and one sort. ``order`` must be total, and the one that
    the slices were made in, or one that only breaks its ties.
    """
    keys, order = as_list(keys), as_list(order)
    part = partition_columns(df, keys)
    w = Window.partitionBy(*part).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*part)

    def inner(spec):
        if isinstance(spec, RowsAfter):
            return F.count(F.lit(1)).over(whole) - F.row_number().over(w)
        return spec.within(w, upto)

    order_cols = [F.col(c) for c in order]
    if not is_sliced(df, keys):
        return df.withColumns({name: spec.finish(inner(spec)) for name, spec in columns.items()})

    slice_name = slice_of(df, keys)
    made_in = df.schema[slice_name].metadata.get("order", order)
    if list(made_in) != order[:len(made_in)]:
        raise ValueError(f"the slices follow {made_in}, not {order}")
    names = {name: f"_sum_{name}" for name in columns}
    summaries = (
        df.where(F.col(slice_name) > 0)
        .groupBy(*part)
        .agg(*[spec.summary(order_cols).alias(names[name]) for name, spec in columns.items()])
    )
    # A cut lies in one key, so there are at most two rows per cut; a key finer than the one that was cut has more.
    forward = Window.partitionBy(*keys).orderBy(F.col(slice_name)).rowsBetween(Window.unboundedPreceding, -1)
    backward = Window.partitionBy(*keys).orderBy(F.col(slice_name).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = summaries.select(
        *[F.col(c).alias(f"_at_{c}") for c in part],
        *[spec.carry(F.col(names[name]), backward if spec.backward else forward).alias(f"_carry_{name}")
          for name, spec in columns.items()],
    )
    # Settled now: left in the plan, every later scan would compute the ones before it again.
    carried = cut_lineage(carried)
    out = df.withColumns({f"_in_{name}": inner(spec) for name, spec in columns.items()})
    match = [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in part]
    out = out.join(carried, match, "left")
    out = out.withColumns({
        name: spec.finish(spec.combine(F.col(f"_in_{name}"), F.col(f"_carry_{name}")))
        for name, spec in columns.items()
    })
    return out.drop(*[f"_at_{c}" for c in part], *[f"_in_{n}" for n in columns], *[f"_carry_{n}" for n in columns])
