"""Best representative of each duplicate group: field-by-field survivorship in one aggregation.

Each attribute takes the maximum of a composite (has a value, source priority, timestamp, smallest id), which is packed into
one number a row, so that numeric fields are aggregated by hash on buffers of a fixed width. Buffers are merged before the
shuffle: a group may hold any share of all rows. Only the list of a group's sources grows, with the number of sources.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.reconcile import with_club  # noqa: F401  (used with this module)
from ..plans.runtime import join_checked  # noqa: F401


@dataclass(frozen=True)
class Survivorship:
    """keys: the group's columns; row_id: unique bigint; updated: timestamp; priority: int expression or None.

    fields maps each attribute to the expression by which its cells are compared (null: missing); by default the
    column itself, NaN being missing.
    """

    keys: tuple[str, ...]
    row_id: str
    updated: str
    fields: tuple[str, ...]
    priority: str | None = None
    source: str | None = None
    compare: dict[str, Column] = field(default_factory=dict)


def _present(df: DataFrame, name: str, spec: Survivorship) -> Column:
    if name in spec.compare:
        return spec.compare[name]
    kind = dict(df.dtypes)[name]
    col = F.col(f"`{name}`")
    return F.when(~F.isnan(col), col) if kind in ("double", "float") else col


def _micros(time: Column) -> Column:
    """Microseconds of a timestamp with or without a zone, in order of its wall clock."""
    seconds = F.unix_date(time.cast("date")).cast("bigint") * 86_400 + F.hour(time) * 3600 + F.minute(time) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), time) * 1_000_000).cast("bigint")


@dataclass(frozen=True)
class _Order:
    """A row's place as one value, larger for a better row, and the row id that can be read off it again."""

    key: Column
    row_id: Callable[[Column], Column]


def _order(base: DataFrame, spec: Survivorship) -> _Order:
    """Priority, then time, then smallest id packed into one number, whose buffers have a fixed width.

    The three ranges and the grain of the times (seconds, milliseconds or microseconds) are read from the rows first. A long
    is used if the product of the ranges fits, else a decimal of 38 digits, else a text of fixed length.
    """
    ranges = base.agg(*[x for c in ("__p", "__t", spec.row_id) for x in (F.min(c).cast("bigint"), F.max(c).cast("bigint"))], *[F.max(F.pmod("__t", F.lit(g))) for g in (1_000_000, 1_000)]).first()
    p0, p1, t0, t1, i0, i1 = [v if v is not None else 0 for v in ranges[:6]]
    grain = 1_000_000 if not ranges[6] else 1_000 if not ranges[7] else 1
    t0, t1 = t0 // grain, t1 // grain
    times, ids = t1 - t0 + 2, i1 - i0 + 1
    room = (p1 - p0 + 2) * times * ids
    time = F.col("__t") if grain == 1 else F.expr(f"__t div {grain}")
    if room < 2**62:
        place = lambda c, least: F.coalesce(c - F.lit(least) + 1, F.lit(0)).cast("bigint")
        key = (place(F.col("__p"), p0) * times + place(time, t0)) * ids + (F.lit(i1) - F.col(spec.row_id))
        return _Order(key.cast("bigint"), lambda k: (F.lit(i1) - k % F.lit(ids)).cast("bigint"))
    if room < 10**38:
        wide = lambda c: c.cast("decimal(20,0)")
        big = lambda v: F.lit(str(v)).cast("decimal(20,0)")
        place = lambda c, least: F.coalesce(wide(c) - big(least) + F.lit(1).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
        whole = lambda c: c.cast("decimal(38,0)")
        key = whole(whole(whole(place(F.col("__p"), p0)) * big(times) + place(time, t0)) * big(ids)) + whole(big(i1) - wide(F.col(spec.row_id)))
        return _Order(whole(key), lambda k: (big(i1) - (k % big(ids))).cast("bigint"))
    text = lambda c: F.lpad((c.cast("decimal(20,0)") + F.lit(2**63).cast("decimal(20,0)")).cast("string"), 20, "0")
    missing = F.lit("0" * 20)
    key = F.concat(F.coalesce(text(F.col("__p")), missing), F.coalesce(text(F.col("__t")), missing), text(-F.col(spec.row_id).cast("decimal(20,0)")))
    return _Order(key, lambda k: (F.lit(2**63).cast("decimal(20,0)") - F.substring(k, 41, 20).cast("decimal(20,0)")).cast("bigint"))


def survive(df: DataFrame, spec: Survivorship, values: bool = True, ranges: DataFrame | None = None) -> DataFrame:
    """One row per group: keys, group_id (smallest row id), row_count, sources, and ``fields``, a struct a field.

    Each has value (as stored), chosen_id, chosen_source and conflict (cells differ, or one is missing beside
    a value; a group of one row, or one where all cells are missing, has no conflict). Ties in priority go to the latest
    timestamp (a missing one is oldest), then to the smallest row id; so repeated rows and order never change the result.
    A row with a null key belongs to no group and stays out, as does a row with no row id. Other columns are ignored. Without
    ``values``, only chosen_id and conflict are computed, on buffers of a fixed width. ``ranges`` may give rows that are
    cheaper to read than ``df`` and have the same row ids, times and priorities.
    """
    priority = F.col(spec.priority).cast("bigint") if spec.priority else F.lit(0).cast("bigint")
    source = F.col(spec.source) if spec.source else F.lit(None).cast("string")
    ranked = {"__p": priority, "__t": _micros(F.col(spec.updated))}
    order = _order((df if ranges is None else ranges).withColumns(ranked), spec)
    base = df.dropna(subset=[*spec.keys, spec.row_id]).withColumns(ranked | {"__s": source})
    cells = {f"__c{i}": _present(df, f, spec) for i, f in enumerate(spec.fields)}
    base = base.withColumns(cells | {"__k": order.key})
    gone = F.lit(0).cast("bigint")
    for i in range(len(spec.fields)):
        gone = gone.bitwiseOR(F.when(F.col(f"__c{i}").isNull(), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    base = base.withColumn("__gone", gone)
    aggs = [F.min(spec.row_id).alias("group_id"), F.count("*").alias("row_count"), F.bit_or("__gone").alias("__gone")]
    if values:
        aggs.append(F.array_join(F.sort_array(F.collect_set("__s")), "; ").alias("sources"))
    for i, f in enumerate(spec.fields):
        have = F.when(F.col(f"__c{i}").isNotNull(), F.col("__k"))
        aggs += [F.max(have).alias(f"__b{i}"), F.min(f"__c{i}").alias(f"__lo{i}"), F.max(f"__c{i}").alias(f"__hi{i}")]
        if values:
            aggs += [F.max_by(F.col(f"`{f}`"), have).alias(f"__v{i}"), F.max_by("__s", have).alias(f"__s{i}")]
    grouped = base.groupBy(*spec.keys).agg(*aggs)
    out = []
    for i, f in enumerate(spec.fields):
        best = F.col(f"__b{i}")
        differ = F.col("__gone").bitwiseAND(F.lit(1 << i).cast("bigint")) > 0
        taken = [F.col(f"__v{i}").alias("value"), F.col(f"__s{i}").alias("chosen_source")] if values else []
        out.append(F.struct(*taken, order.row_id(best).alias("chosen_id"), (best.isNotNull() & (differ | (F.col(f"__lo{i}") != F.col(f"__hi{i}")))).alias("conflict")).alias(f))
    return grouped.select(*spec.keys, "group_id", "row_count", *(["sources"] if values else []), F.struct(*out).alias("fields"))


def golden_records(survived: DataFrame, spec: Survivorship) -> DataFrame:
    """The surviving records: keys, each field's value, row_count, sources, conflict_fields and chosen_sources.

    A field that is itself called like one of these columns comes as value_<field>.
    """
    taken = {*spec.keys, "group_id", "row_count", "sources", "conflict_fields", "chosen_sources"}
    conflicts = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"fields.`{f}`.conflict"), F.lit(f)) for f in spec.fields])), "; ")
    chosen = F.array_join(F.array_compact(F.array(*[F.concat(F.lit(f"{f}:"), F.col(f"fields.`{f}`.chosen_source")) for f in spec.fields])), "; ")
    return survived.select(*spec.keys, "group_id", "row_count", *[F.col(f"fields.`{f}`.value").alias(f"value_{f}" if f in taken else f) for f in spec.fields], "sources", conflicts.alias("conflict_fields"), chosen.alias("chosen_sources"))


def conflict_cases(survived: DataFrame, spec: Survivorship, table_name: str) -> DataFrame:
    """(table_name, group_id, field_name, chosen_id) of every group of two or more rows and field that disagrees."""
    cases = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"fields.`{f}`.chosen_id").alias("chosen_id"), F.col(f"fields.`{f}`.conflict").alias("conflict")) for f in spec.fields])
    rows = survived.filter("row_count >= 2").select("group_id", F.explode(F.filter(cases, lambda c: c["conflict"])).alias("c"))
    return rows.select(F.lit(table_name).alias("table_name"), "group_id", "c.field_name", "c.chosen_id")
