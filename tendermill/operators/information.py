"""Mutual information of two numeric columns, estimated from nearest rows, for all groups in one job.

The estimator of Kraskov, Stoegbauer and Grassberger: r is the distance to a row's k-th nearest other row, the larger
of both differences, in units of standard deviations. With N rows, a row in whose strip of width r lie ``nx`` rows by x
and ``ny`` by y (itself included) adds psi(N) + psi(k) - psi(nx) - psi(ny). Where r is 0, k is
the number of rows at its place, as Gao and others do for mixtures of discrete and continuous values. The rows of
a strip are counted by ranks in the sorted column, not listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendermill.operators.grouping import null_safe_join, with_group_stats
from tendermill.operators.nearest import kth_distances
from tendermill.operators.quantiles import counts_below
from tendermill.session import checkpointed


def digamma(m: Column) -> Column:
    """The digamma function of a number from 1 on, to about nine digits: its series behind six steps of the recurrence."""
    z = m + 6.0
    steps = sum((1.0 / (m + float(i)) for i in range(6)), F.lit(0.0))
    return F.log(z) - 1.0 / (2.0 * z) - 1.0 / (12.0 * z * z) + 1.0 / (120.0 * F.pow(z, F.lit(4.0))) - 1.0 / (252.0 * F.pow(z, F.lit(6.0))) - steps


def mutual_information(df: DataFrame, group: str, x: str, y: str, neighbours: int = 3) -> DataFrame:
    """``group`` and ``mutual_information`` in nats, at least 0.

    Rows in which x or y is no finite number are left out; a group of at most ``neighbours`` rows has null. Rows without a
    group are a group. A difference within rounding of r counts as r, so it lies outside the strip.
    """
    number = {c: F.col(c).cast("double") for c in (x, y)}
    rows = df.select(F.col(group).cast("string").alias("g"), number[x].alias("x"), number[y].alias("y")).where(
        (F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    rows = with_group_stats(rows, ["g"], size=F.count("*"), **{
        f"{n}_{c}": f(c) for c in "xy" for n, f in (("min", F.min), ("max", F.max), ("sd", F.stddev_pop))})
    width = F.greatest(*(F.coalesce(F.try_divide(F.col(f"max_{c}") - F.col(f"min_{c}"), F.col(f"sd_{c}")), F.lit(0.0)) for c in "xy"))
    at = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"min_{c}"), F.col(f"sd_{c}") * width), F.lit(0.0)) for c in "xy"}
    # the deviation of equal values can come out a little above 0, so the place is held in 0-1
    placed = checkpointed(rows.select("g", "size", F.array(*(F.least(at[c], F.lit(1.0)) for c in "xy")).alias("z")))
    near = kth_distances(placed, "z", 2, neighbours + 1, "g", largest=True)
    places = checkpointed(near.groupBy("g", "z").agg(F.count("*").alias("here"), F.first("size").alias("size"), F.first("distance").alias("r")))
    inside = F.greatest(F.col("r") - F.greatest(F.col("r") * 1e-9, F.lit(4.5e-16)), F.lit(0.0))
    ends = [F.struct(F.lit(i).alias("axis"), F.lit(sign).alias("sign"), (F.col("z")[i] + sign * inside).alias("at"), F.lit(sign < 0).alias("strict"))
            for i in range(2) for sign in (-1, 1)]
    probes = places.where("r IS NOT NULL").select("g", "z", "here", "size", "r", F.inline(F.array(*ends)))
    values = placed.select("g", F.posexplode("z").alias("axis", "value"))
    # a missing group is a value of its own for the counts
    key = F.struct(F.col("g").isNull().alias("no"), F.coalesce("g", F.lit("")).alias("g"))
    counted = counts_below(probes.withColumn("key", key), values.withColumn("key", key), ["key", "axis"], "at", "value", "strict")
    strips = counted.groupBy("g", "z", "axis", "here", "size", "r").agg(F.sum(F.col("sign") * F.col("below")).alias("n"))
    k = F.when(F.col("r") > 0, F.lit(float(neighbours))).otherwise(F.col("here"))
    terms = strips.groupBy("g", "z", "here", "size", "r").agg(F.sum(digamma(F.col("n"))).alias("strips")).select(
        "g", "size", "here", (digamma(F.col("size")) + digamma(k) - F.col("strips")).alias("term"))
    found = terms.groupBy("g").agg(F.greatest(F.sum(F.col("here") * F.col("term")) / F.first("size"), F.lit(0.0)).alias("mutual_information"))
    return null_safe_join(placed.select("g").distinct(), found, ["g"], "left").withColumnRenamed("g", group)
