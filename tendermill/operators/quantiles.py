"""Exact quantiles and running totals that never bring one group to one task.

Both rest on a *band*: a coarse, order-keeping number computed from the value
alone. Band totals are few (at most some thousands per group whatever the row
count), so positions and sums before a band come from a window over the band
table, and rows only meet others of their own group and band.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendermill.session import stored

BANDS_PER_E_FOLD = 64


def band_of(value: Column) -> Column:
    """Non-decreasing integer of a number: about 1.6 % of the value wide at any magnitude, 0 for zero."""
    value = value.cast("double")
    # the logarithm of the smallest double is above -745, so sizes are positive
    size = F.floor((F.ln(F.abs(value)) + 745) * BANDS_PER_E_FOLD)
    band = F.when(value == 0, F.lit(0)).when(value < 0, -size).when(F.isnan(value), F.lit((1 << 63) - 1)).otherwise(size)
    return band.cast("long")


def _same(left: str, right: str, keys: Iterable[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return condition


def exact_quantiles(df: DataFrame, keys: Iterable[str], value: str, wanted: Mapping[str, float], reread: bool = False) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per entry of ``wanted``.

    Values are first counted per (group, value), which also folds copies together. With ``reread``, for a table that is
    cheap to read, the bands are counted first and only values of the bands in question are shuffled.
    A group without any value gets no row; without keys there is always one row.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    values = df.where(v.isNotNull()).select(*keys, (v + F.lit(0.0)).alias("_v")).withColumn("_band", band_of(F.col("_v")))
    counted = values.groupBy(*keys, "_v", "_band").agg(F.count("*").alias("_n"))
    if reread:
        bands = values.groupBy(*keys, "_band").agg(F.count("*").alias("_in_band"))
    else:
        bands = counted.groupBy(*keys, "_band").agg(F.sum("_n").alias("_in_band"))
    by_key = Window.partitionBy(*keys)
    before = F.sum("_in_band").over(by_key.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1))
    bands = bands.withColumns(
        {"_before": F.coalesce(before, F.lit(0)), "_total": F.sum("_in_band").over(by_key)}
    )
    position = {name: (F.col("_total") - 1) * F.lit(float(q)) for name, q in wanted.items()}
    end = F.col("_before") + F.col("_in_band")
    hit = F.lit(False)
    for p in position.values():
        for edge in (F.floor(p), F.ceil(p)):
            hit = hit | ((edge >= F.col("_before")) & (edge < end))
    bands = bands.where(hit)
    on = _same("c", "b", [*keys, "_band"])
    if reread:
        # written, they are known to be few before the values are read, and are broadcast; else all values are shuffled to meet them
        bands = stored(bands)
        near = values.alias("c").join(bands.alias("b"), on, "left_semi")
        counted = near.groupBy(*keys, "_v", "_band").agg(F.count("*").alias("_n"))
    rows = counted.alias("c").join(bands.alias("b"), on).select("c.*", "b._before", "b._total")
    in_band = Window.partitionBy(*keys, "_band").orderBy("_v")
    upto = F.col("_before") + F.sum("_n").over(in_band.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_n"))
    out = []
    for name, p in position.items():
        lower = F.max(F.when((F.floor(p) >= F.col("_from")) & (F.floor(p) < F.col("_upto")), F.col("_v")))
        upper = F.max(F.when((F.ceil(p) >= F.col("_from")) & (F.ceil(p) < F.col("_upto")), F.col("_v")))
        share = F.max(p - F.floor(p))
        out.append((lower + (upper - lower) * share).alias(name))
    return rows.groupBy(*keys).agg(*out)


def running_totals(
    df: DataFrame,
    keys: Iterable[str],
    value: str,
    tie: Iterable[str],
    amount: str | None = None,
    descending: bool = True,
) -> DataFrame:
    """Add ``position`` (1-based), ``running`` and ``group_total`` of ``amount`` in the order of ``value``.

    Equivalent to a window over the whole group, but the window spans one band.
    """
    keys, tie = list(keys), list(tie)
    amount = amount or value
    ordered = -F.col(value) if descending else F.col(value)
    banded = df.withColumn("_band", band_of(ordered))
    bands = banded.groupBy(*keys, "_band").agg(F.count("*").alias("_n"), F.sum(amount).alias("_sum"))
    by_key = Window.partitionBy(*keys)
    earlier = by_key.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select(
        *keys,
        "_band",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n_before"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_sum_before"),
        F.sum("_sum").over(by_key).alias("group_total"),
        F.sum("_n").over(by_key).alias("group_rows"),
    )
    # of all rows together there are a few bands, and rows are shuffled once, for the window
    bands = bands if keys else F.broadcast(bands)
    joined = (
        banded.alias("d")
        .join(bands.alias("b"), _same("d", "b", [*keys, "_band"]))
        .select("d.*", "b._n_before", "b._sum_before", "b.group_total", "b.group_rows")
    )
    order = F.col(value).desc() if descending else F.col(value).asc()
    w = Window.partitionBy(*keys, "_band").orderBy(order, *tie)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumns(
        {
            "position": F.col("_n_before") + F.row_number().over(w),
            "running": F.col("_sum_before") + F.sum(amount).over(upto),
        }
    ).drop("_band", "_n_before", "_sum_before")


def percentile_rank(df: DataFrame, value: str, result: str) -> DataFrame:
    """Rank divided by the row count, ties sharing their average rank."""
    counted = df.groupBy(value).agg(F.count("*").alias("_ties"))
    ranked = running_totals(counted, [], value, [], amount="_ties", descending=False).select(
        F.col(value).alias("_value"),
        ((F.col("running") - (F.col("_ties") - 1) / 2) / F.col("group_total")).alias(result),
    )
    return df.join(ranked, F.col(value) == F.col("_value"), "left").drop("_value")


def counts_below(probes: DataFrame, values: DataFrame, keys: Iterable[str], at: str, value: str, strict: str) -> DataFrame:
    """``probes`` with ``below`` and ``sum_below``: how many values of their group lie at or below ``at``, and their sum.

    Where the boolean column ``strict`` is true, values equal to ``at`` do not count. Both tables meet band by band; a
    probe's group may have no value at all. Null probes and values are left out.
    """
    keys = list(keys)
    probes, values = probes.where(F.col(at).isNotNull()), values.where(F.col(value).isNotNull())
    put = probes.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(at).cast("double").alias("_at"),
                        F.when(F.col(strict), 0).otherwise(2).alias("_place"), F.lit(0).cast("long").alias("_n"), F.lit(0.0).alias("_sum"),
                        F.struct(*probes.columns).alias("_probe"))
    folded = values.groupBy(*keys, F.col(value).cast("double").alias("_at")).agg(F.count("*").alias("_n"))
    folded = folded.select(*(F.col(k).alias(f"_{k}") for k in keys), "_at", F.lit(1).alias("_place"), "_n", (F.col("_n") * F.col("_at")).alias("_sum"),
                           F.lit(None).cast(put.schema["_probe"].dataType).alias("_probe"))
    both = put.unionByName(folded).withColumn("_band", band_of(F.col("_at")))
    names = [f"_{k}" for k in keys]
    earlier = Window.partitionBy(*names).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    bands = both.groupBy(*names, "_band").agg(F.sum("_n").alias("_all"), F.sum("_sum").alias("_total"))
    bands = bands.select(*names, "_band", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_before"),
                         F.coalesce(F.sum("_total").over(earlier), F.lit(0.0)).alias("_sum_before"))
    met = both.alias("d").join(bands.alias("b"), _same("d", "b", [*names, "_band"])).select("d.*", "b._before", "b._sum_before")
    order = Window.partitionBy(*names, "_band").orderBy("_at", "_place").rowsBetween(Window.unboundedPreceding, 0)
    placed = met.withColumns({"below": F.col("_before") + F.sum("_n").over(order), "sum_below": F.col("_sum_before") + F.sum("_sum").over(order)})
    return placed.where("_probe IS NOT NULL").select("_probe.*", "below", "sum_below")
