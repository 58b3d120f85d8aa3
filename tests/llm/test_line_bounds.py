"""Removed line numbers are broadcast by their bytes, not by the number of documents."""

from tendermill.llm import lines


def test_many_lines_of_one_document_are_not_broadcast(spark, monkeypatch):
    text = "\n".join(f"aa{k} bb{k} cc{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + "\nend")], "doc_id long, text string")

    def hinted(df):
        return "strategy=broadcast" in df._jdf.queryExecution().optimizedPlan().toString()

    small = lines.line_dedup(docs)
    monkeypatch.setattr(lines, "BROADCAST_BYTES", lines.ROW_BYTES + 8 * 59)
    large = lines.line_dedup(docs)
    assert hinted(small) and not hinted(large)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect())) == [(1, text, 60, 0), (2, "end", 61, 60)]
