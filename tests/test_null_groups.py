"""Rows with null keys form a group like others, and result names are kept whole."""

from pyspark.sql import functions as F

from tendermill.operators import grouping
from tendermill.plans import comparables, series
from tendermill.sources import sinks


def test_shares_keep_null_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 2.0), (None, 6.0)], "g string, x double")
    got = sorted((str(r.g), r.x, r.share) for r in grouping.with_share(df, "x", ["g"]).collect())
    assert got == [("None", 2.0, 25.0), ("None", 6.0, 75.0), ("a", 1.0, 25.0), ("a", 3.0, 75.0)]


def test_group_stats_keep_null_groups(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 2), (None, None, 3)], "g string, h string, x int")
    got = grouping.with_group_stats(df, ["g", "h"], n=F.count("*")).collect()
    assert sorted((r.x, r.n) for r in got) == [(1, 2), (2, 2), (3, 1)]


def test_weekly_base_keeps_null_groups(spark):
    rows = spark.createDataFrame([(None, "2024-01-02", 5.0), (None, "2024-01-03", 7.0), ("p", "2024-01-03", 1.0)], "project_name string, day string, x double").select(
        "project_name", F.to_date("day").alias("contract_signing_date"), F.col("x").alias(series.AMOUNT), F.col("x").alias("unit_price_eur"),
        F.lit("c").alias("contract_number"), F.lit("s").alias("counterparty_name"))
    got = {r.project_name: r.median_contract for r in series.weekly_base(rows, "project_name").collect()}
    assert got == {None: 6.0, "p": 1.0}


def test_long_result_names_stay_apart(spark, tmp_path):
    one, two = "x" * 40 + "/1", "x" * 40 + "_1"
    paths = sinks.write_bundle({one: spark.range(1), two: spark.range(2)}, str(tmp_path / "bundle"))
    assert [spark.read.parquet(p).count() for p in paths] == [1, 2]
    df = spark.createDataFrame([(one, 1), (two, 2)], "k string, x int")
    sinks.write_split(df, "k", str(tmp_path / "split"), files_per_key=2)
    assert {(r["_split"], r.x) for r in spark.read.parquet(str(tmp_path / "split")).collect()} == {(one, 1), (two, 2)}


def test_three_sizes_of_a_sheet(spark):
    from tendermill.functions import attributes

    df = spark.createDataFrame([("Лист 5х1500х6000мм",), ("Лист 10мм",)], "name string")
    assert [r.thickness for r in df.select(*attributes.shape_attributes("name")).collect()] == ["5", "10"]


def test_candidates_follow_the_threshold(spark):
    names = spark.createDataFrame([("Краска бел",), ("Краска белая матовая",), ("Краска красная",)], "product_name string")
    found = comparables.similar_names(comparables.named_features(names, "product_name"), 0.83).collect()
    assert {tuple(sorted((r.name1, r.name2))) for r in found} >= {("Краска бел", "Краска белая матовая")}
