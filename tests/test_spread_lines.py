"""Many lines are dealt over tasks by their number, with the results of few."""

from datetime import date

import pandas as pd
import pytest

from tendermill.catalog import load
from tendermill.sources import views


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    n = 120
    keys = range(n)
    line = pd.DataFrame({
        "l_orderkey": [i // 3 for i in keys], "l_partkey": [i % 7 for i in keys], "l_suppkey": [i // 3 % 5 for i in keys],
        "l_linenumber": [i % 3 for i in keys], "l_quantity": [1.0 + i % 4 for i in keys], "l_extendedprice": [10.0 + i for i in keys],
        "l_discount": 0.01, "l_tax": [0.01 * (i % 9) for i in keys], "l_returnflag": "A", "l_shipdate": date(1998, 2, 3)})
    tables = {
        "lineitem": line,
        "orders": pd.DataFrame({"o_orderkey": range(40), "o_custkey": [i % 6 for i in range(40)], "o_orderstatus": "F",
                                "o_orderdate": date(1998, 1, 1), "o_orderpriority": "1-URGENT"}),
        "part": pd.DataFrame({"p_partkey": range(7), "p_type": [f"T{i % 3}" for i in range(7)], "p_name": [f"N{i % 4}" for i in range(7)],
                              "p_brand": "B", "p_size": range(7)}),
        "supplier": pd.DataFrame({"s_suppkey": range(5), "s_name": [f"S{i % 4}" for i in range(5)], "s_nationkey": range(5)}),
        "customer": pd.DataFrame({"c_custkey": range(6), "c_mktsegment": "BUILDING"})}
    at = tmp_path_factory.mktemp("tables")
    for name, rows in tables.items():
        spark.createDataFrame(rows).write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.mark.parametrize("name, dealt", [("lots_by_actor_currency", True), ("lots_with_contracts", True), ("price_discrepancies", True),
                                         ("supplier_prices", False)])
def test_tasks_follow_the_lines(spark, folder, monkeypatch, capsys, name, dealt):
    q = load()[name]
    few = sorted(map(tuple, q.run(spark, folder).collect()))
    monkeypatch.setattr(views, "MANY", 0)
    monkeypatch.setattr(views, "OF_A_TASK", 3)
    many = q.run(spark, folder)
    assert few and sorted(map(tuple, many.collect())) == few
    assert not dealt or many.rdd.getNumPartitions() == 120 // 3 + 1
    views.lots(spark, folder, "lot_number", "lot_status").explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out


def test_contracts_are_put_together_once(spark, folder, capsys):
    found = load()["alternatives_for_major_suppliers"].run(spark, folder)
    assert not any("lineitem" in name for name in found.inputFiles())
    load()["contract_export_cleaned"].run(spark, folder).explain()
    assert capsys.readouterr().out.count("FileScan parquet [l_") == 1
