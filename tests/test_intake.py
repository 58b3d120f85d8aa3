from datetime import date

import pytest
from pyspark.sql import functions as F

from tendermill.sources import intake, schemas, sinks
from tendermill.streaming import intake_stream


def lot_line(number, person="Петров П. (ОМТС)", price="1 500,50"):
    values = {"lot_number": number, "lot_status": "Исполнен", "discipline": "Трубы", "project_name": "П1",
              "open_date": "01.02.2024", "close_date": "15.02.2024", "actor_name": person, "good_name": "Труба",
              "good_count": "2", "unit": "т", "supplier_qty": "", "supplier_unit": "т", "winner_name": "ООО А",
              "unit_price": price, "total_price": "3001", "currency": "EUR"}
    return ";".join([values[c] for c in schemas.LOT_HEADERS.values()]).replace(",", ".").replace(";", ",")


def write_lots(folder, name, numbers):
    lines = [",".join(schemas.LOT_HEADERS)] + [lot_line(n) for n in numbers]
    (folder / name).write_text("﻿" + "\n".join(lines) + "\n", encoding="utf-8")


def test_lot_export(spark, tmp_path):
    write_lots(tmp_path, "KP_1.csv", ["1", "1", "2", ""])
    raw = intake.read_export(spark, str(tmp_path / "KP_1.csv"), schemas.LOT_HEADERS)
    got = intake.lots_from_export(raw).orderBy("lot_number").collect()
    assert [r["lot_number"] for r in got] == [1, 2]
    assert (got[0]["actor_name"], got[0]["open_date"], got[0]["unit_price"], got[0]["supplier_qty"]) == (
        "Петров П.", date(2024, 2, 1), 1500.5, 0.0)
    assert intake.lots_from_export(raw).schema.fieldNames() == schemas.LOTS.fieldNames()


def test_stream_loads_each_file_once(spark, tmp_path):
    inbox, target, ledger = tmp_path / "in", tmp_path / "out", tmp_path / "ledger"
    inbox.mkdir()
    write_lots(inbox, "KP_a.csv", ["1", "2"])
    write_lots(inbox, "Other_b.csv", ["9"])

    def run():
        q = intake_stream.load_new_files(spark, str(inbox), "KP_", str(target), str(ledger))
        q.awaitTermination(120)

    run()
    run()
    assert spark.read.parquet(str(target)).count() == 2
    write_lots(inbox, "KP_c.csv", ["3"])
    run()
    assert {r[0] for r in spark.read.parquet(str(target)).select("lot_number").collect()} == {1, 2, 3}


def test_batch_ledger(spark, tmp_path):
    write_lots(tmp_path, "KP_a.csv", ["1"])
    write_lots(tmp_path, "KP_b.csv", ["2"])
    raw = intake.read_export(spark, str(tmp_path), schemas.LOT_HEADERS)
    ledger = spark.createDataFrame([("KP_a.csv",)], "nameoffiles string")
    fresh = intake_stream.rows_of_new_files(raw, ledger)
    assert [r["Номер лота"] for r in fresh.collect()] == ["2"]
    assert {r[0] for r in intake_stream.with_ledger(ledger, fresh).collect()} == {"KP_a.csv", "KP_b.csv"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("а/б", 1), ("в", 2), ("в", 3)], "project string, n int")
    sinks.write_split(df, "project", str(tmp_path / "split"), files_per_key=2)
    assert spark.read.parquet(str(tmp_path / "split")).count() == 3
    assert {p.name for p in (tmp_path / "split").glob("_split=*")} == {"_split=а%2Fб", "_split=в"}
    sinks.write_bundle({"one": df, "two": df.limit(1)}, str(tmp_path / "bundle"))
    assert spark.read.parquet(str(tmp_path / "bundle" / "two")).count() == 1
    sinks.write_csv(df, str(tmp_path / "csv"))
    back = intake.read_delimited(spark, str(tmp_path / "csv"), df.schema)
    assert back.count() == 3


def test_tables(spark):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    sinks.replace_table(df, "intake_test")
    sinks.append_to(df.select("v", "id"), "intake_test")
    assert spark.table("intake_test").agg(F.sum("id")).first()[0] == 2
    sinks.append_to(df, "intake_fresh")
    assert "intake_fresh" in {r["tableName"] for r in sinks.table_names(spark).collect()}
    spark.sql("DROP TABLE intake_fresh")
    spark.sql("DROP TABLE intake_test")


def test_sql_arguments_are_bound(spark):
    df = spark.createDataFrame([(1,), (5,)], "x int")
    assert intake.from_sql(spark, "SELECT * FROM t WHERE x > :least", {"t": df}, least=2).count() == 1


def test_unknown_prefix(spark):
    with pytest.raises(KeyError):
        intake_stream.export_stream(spark, "/tmp", "Nope_")
