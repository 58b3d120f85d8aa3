"""Steps that read rows once."""

import datetime

from pyspark.sql import functions as F

from tendermill.catalog import load
from tendermill.plans import suppliers


def test_supplier_features_put_contracts_together_once(spark):
    day = datetime.date(2001, 1, 1)
    rows = [(f"s{i % 4}", float(i + 1), 2.0 + i, day + datetime.timedelta(days=20 * i), i, 1.0 + i, 3.0, 0.5, f"p{i % 3}", f"n{i % 5}", "kg", "d", "EUR")
            for i in range(40)]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    df = spark.createDataFrame(rows, "counterparty_name string, amount double, unit_price_eur double, contract_signing_date date, delivery_time_days int, "
                               "quantity double, product_amount double, additional_expenses double, project_name string, product_name string, unit string, "
                               "discipline string, contract_currency string")
    found = suppliers.supplier_features(df.withColumn("total_contract_amount_eur", counted("amount")).drop("amount")).toPandas()
    assert seen.value == len(rows)
    assert sorted(found["counterparty_name"]) == ["s0", "s1", "s2", "s3"]
    assert found.set_index("counterparty_name").loc["s1", "total_volume"] == sum(float(i + 1) for i in range(40) if i % 4 == 1)


def test_copies_of_an_export_are_made_from_one_text(spark, tiny):
    plan = load()["lot_export_cleaned"].run(spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("l_extendedprice#") and "explode" in plan
