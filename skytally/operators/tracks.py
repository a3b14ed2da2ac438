"""Tracks: sessions, state by merge rules, counters, altitude, life cycle, registry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytally.operators.folds import interval_micros
from skytally.operators.ordered import Latest, Next, Previous, Total, as_list, drop_slices, micros, scan

# Fixed limits of a plausible altitude in feet.
MIN_ALTITUDE_FT, MAX_ALTITUDE_FT = -2000, 126700


def sessionize(df: DataFrame, key, ts: str, timeout="60 seconds", order=None, name: str = "session") -> DataFrame:
    """Number the tracks of a key: a silence longer than the time-out starts a new one."""
    order = order or [ts]
    limit = interval_micros(df.sparkSession, timeout)
    out = scan(df, key, order, _before=Previous(micros(ts)))
    start = F.when(F.col("_before").isNull() | (micros(ts) - F.col("_before") > limit), 1).otherwise(0)
    out = out.withColumn("_start", start.cast("long"))
    return scan(out, key, order, **{name: Total(F.col("_start"))}).drop("_before", "_start")


@dataclass(frozen=True)
class Rule:
    """How a state field is merged, as SQL text.

    ``overwrite`` takes the value of the newest row with ``when``, null included.
    Otherwise the newest non-null value (of rows with ``when``, if given) is kept.
    """

    name: str
    value: str
    when: str = "true"
    overwrite: bool = False

    @property
    def taken(self) -> str:
        return f"({self.when})" if self.overwrite else f"({self.when}) AND ({self.value}) IS NOT NULL"


def overwrite(name: str, value: str | None = None, when: str = "true") -> Rule:
    return Rule(name, value or name, when, True)


def keep_known(name: str, value: str | None = None, when: str = "true") -> Rule:
    return Rule(name, value or name, when, False)


def latest_state(df: DataFrame, keys, order, rules: list[Rule], extra=()) -> DataFrame:
    """One row per key, each field merged by its rule, and the ``extra`` aggregates.

    Rows of a key are combined before the shuffle, so a hot key costs one row per task.
    Fields that share a condition share one aggregate.
    """
    keys, order = as_list(keys), as_list(order)
    position = ", ".join(f"`{c}`" for c in order)
    groups: dict[str, list[Rule]] = {}
    for rule in rules:
        groups.setdefault(rule.taken, []).append(rule)
    aggregates, fields = [], {}
    for i, (taken, members) in enumerate(groups.items()):
        # The order is total, so the greatest struct is the newest row's.
        values = ", ".join(f"{r.value} AS `{r.name}`" for r in members)
        aggregates.append(F.expr(f"max(CASE WHEN {taken} THEN struct({position}, struct({values}) AS v) END).v AS _g{i}"))
        fields.update({r.name: f"_g{i}.`{r.name}` AS `{r.name}`" for r in members})
    state = df.groupBy(*keys).agg(*aggregates, *extra)
    own = {*keys, *[f"_g{i}" for i in range(len(groups))]}
    others = [f"`{c}`" for c in state.columns if c not in own]
    return state.selectExpr(*[f"`{k}`" for k in keys], *[fields[r.name] for r in rules], *others)


def state_as_of(df: DataFrame, key, order, rules: list[Rule], session: str | None = None) -> DataFrame:
    """The state after every row: the columns of ``rules`` as running values.

    With ``session`` the state starts empty in every session of the key. Fields that share a condition share one running value.
    """
    groups: dict[str, list[Rule]] = {}
    for rule in rules:
        groups.setdefault(rule.taken, []).append(rule)
    specs, values = {}, {}
    for i, (taken, members) in enumerate(groups.items()):
        own = ", ".join(f"{r.value} AS `{r.name}`" for r in members)
        specs[f"_r{i}"] = Latest(F.expr(f"struct({f'`{session}`' if session else '1'} AS s, struct({own}) AS v)"), F.expr(taken))
        same = "" if session is None else f" AND `_r{i}`.s = `{session}`"
        values.update({r.name: F.expr(f"CASE WHEN `_r{i}` IS NOT NULL{same} THEN `_r{i}`.v.`{r.name}` END") for r in members})
    out = scan(df, key, order, **specs)
    return out.withColumns({r.name: values[r.name] for r in rules}).drop(*specs)


POSITION_KINDS = ("airborne_position", "surface_position")


def counter_aggregates(ts: str, kind: str, position=POSITION_KINDS, velocity=("velocity",),
                       identification=("identification",)) -> list[Column]:
    """Message counts by family, first / last seen, seconds seen and since the last position."""

    def counted(kinds):
        return F.count_if(F.col(kind).isin(*kinds))

    last_position = F.max(F.when(F.col(kind).isin(*position), micros(ts)))
    last = F.max(micros(ts))
    return [
        F.count(F.lit(1)).alias("total_messages"),
        counted(position).alias("position_messages"),
        counted(velocity).alias("velocity_messages"),
        counted(identification).alias("identification_messages"),
        F.min(ts).alias("first_seen"),
        F.max(ts).alias("last_seen"),
        ((last - F.min(micros(ts))) / 1e6).alias("seen_seconds"),
        ((last - last_position) / 1e6).alias("seen_pos_seconds"),
    ]


def message_counters(df: DataFrame, keys, ts: str, kind: str, position=POSITION_KINDS, velocity=("velocity",),
                     identification=("identification",)) -> DataFrame:
    """``counter_aggregates`` per key."""
    return df.groupBy(*as_list(keys)).agg(*counter_aggregates(ts, kind, position, velocity, identification))


def derive_altitude(df: DataFrame, key, order, barometric: str = "baro_report", geometric: str = "geo_report",
                    delta: str = "delta_report", barometric_only: str | None = None,
                    session: str | None = None) -> DataFrame:
    """Barometric and geometric altitude and their difference after every row.

    A barometric position report with a known difference also sets the geometric altitude
    (if within limits); a geometric report with a known barometric altitude sets the
    difference. ``barometric_only`` names replies that set the barometric altitude alone.
    Each of the three is a newest-value scan over the one before, so no fold is needed.
    """
    both = f"coalesce({barometric}, {barometric_only})" if barometric_only else barometric
    out = state_as_of(df, key, order, [keep_known("baro_ft", both)], session)
    measured = f"CASE WHEN {geometric} IS NOT NULL AND baro_ft IS NOT NULL THEN {geometric} - baro_ft ELSE {delta} END"
    out = state_as_of(out, key, order, [keep_known("delta_ft", measured)], session)
    derived = f"({barometric} + delta_ft)"
    computed = (f"CASE WHEN {geometric} IS NOT NULL THEN {geometric} "
                f"WHEN {derived} BETWEEN {MIN_ALTITUDE_FT} AND {MAX_ALTITUDE_FT} THEN {derived} END")
    return state_as_of(out, key, order, [keep_known("geo_ft", computed)], session)


def lifecycle_events(df: DataFrame, key, ts: str, timeout="60 seconds", order=None, as_of: Column | None = None) -> DataFrame:
    """``added``, ``updated`` and ``expired`` events with their time.

    A track expires one time-out after its last row, if the next row or ``as_of`` is later.
    """
    order = order or [ts]
    keys = as_list(key)
    limit = interval_micros(df.sparkSession, timeout)
    rows = sessionize(df, keys, ts, timeout, order)
    rows = scan(rows, keys, order, _prev=Previous(F.col("session")), _next=Next(micros(ts)))
    rows = rows.withColumn("_until", F.coalesce(F.col("_next"), micros(as_of)) if as_of is not None else F.col("_next"))
    gone = F.col("_until") - micros(ts) > limit
    first = F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col("session")), "added").otherwise("updated")
    expiry = F.timestamp_micros(micros(ts) + limit).cast(df.schema[ts].dataType)
    events = F.array_compact(F.array(
        F.struct(first.alias("event"), F.col(ts).alias("at")),
        F.when(gone, F.struct(F.lit("expired").alias("event"), expiry.alias("at"))),
    ))
    out = rows.select(*keys, "session", *[c for c in order if c != ts], F.inline(events))
    return drop_slices(out)


def active_at(df: DataFrame, keys, ts: str, at: Column, timeout="60 seconds", order=None,
              rules: list[Rule] | None = None) -> DataFrame:
    """Keys seen within the time-out before ``at``, with their state, ordered by key.

    Only rows up to ``at`` count, and of those only the ones no older than the time-out
    can decide, unless ``rules`` need earlier ones.
    """
    keys = as_list(keys)
    limit = interval_micros(df.sparkSession, timeout)
    past = df.where(F.col(ts) <= at)
    if not rules:  # older rows cannot make a key active; without rules they add nothing to its state either
        past = past.where(F.col(ts) >= F.timestamp_micros(micros(at) - limit).cast(df.schema[ts].dataType))
    state = latest_state(past, keys, order or [ts], [overwrite("last_seen", ts), *(rules or [])])
    return state.where(micros(at) - micros("last_seen") <= limit).orderBy(*keys)


def mlat_aggregate(source: str = "source", kind: str | None = None, position=POSITION_KINDS) -> Column:
    mlat = F.col(source) == "Mlat"
    if kind:
        mlat = mlat & F.col(kind).isin(*position)
    return F.coalesce(F.bool_or(mlat), F.lit(False)).alias("had_mlat")


def mlat_flag(df: DataFrame, keys, source: str = "source", kind: str | None = None, position=POSITION_KINDS) -> DataFrame:
    """Per key, whether any position came from multilateration."""
    return df.groupBy(*as_list(keys)).agg(mlat_aggregate(source, kind, position))


def enrich(df: DataFrame, registry: DataFrame, key: str = "icao") -> DataFrame:
    """Registry columns by address; an unknown address gets nulls.

    The planner broadcasts the registry if its size is under the session's threshold and
    shuffles otherwise; adaptive execution then splits a skewed address.
    """
    return df.join(registry, key, "left")


def registered(df: DataFrame, registry: DataFrame, key: str = "icao") -> DataFrame:
    return df.join(registry.select(key), key, "left_semi")


def unregistered(df: DataFrame, registry: DataFrame, key: str = "icao") -> DataFrame:
    return df.join(registry.select(key), key, "left_anti")
