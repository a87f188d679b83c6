import json
import zipfile

import pytest

from seekgrain.contracts import ContractError
from seekgrain.operators import lexical
from seekgrain.sources import sinks, tables
from seekgrain.streaming import progress


def test_csv_strings(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('﻿id,note\n007,"a, b"\n8,\n9,NA\n', encoding="utf-8")
    rows = tables.read_csv_strings(spark, str(path))
    assert rows.columns == ["id", "note"]
    assert [tuple(r) for r in rows.collect()] == [("007", "a, b"), ("8", ""), ("9", "NA")]


def test_workbook(spark, tmp_path):
    sheet = (
        '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
        '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>note</t></is></c><c r="C1"><v>3</v></c></row>'
        '<row><c r="A2"/></row><row><c r="B3"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>'
    )
    shared = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><r><t>i</t></r><r><t>d</t></r></si></sst>'
    with zipfile.ZipFile(tmp_path / "r.xlsx", "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", sheet)
        book.writestr("xl/sharedStrings.xml", shared)
    rows = tables.read_workbooks(spark, str(tmp_path)).orderBy("row_number").collect()
    assert [r.cells for r in rows] == [["id", "note", "3"], ["", "2", ""]] and rows[0].n_formulas == 1
    named = tables.sheet_table(tables.read_workbooks(spark, str(tmp_path)), ["id", "note"])
    assert named.first().note == "2"


def test_pinned_parquet(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_table(spark.range(3).coalesce(1), path)
    hashes = {r.path.rsplit("/", 1)[1]: r.sha256 for r in tables.file_hashes(spark, path, "*.parquet").collect()}
    assert tables.read_pinned(spark, path, hashes).count() == 3
    with pytest.raises(ContractError):
        tables.read_pinned(spark, path, {name: "0" * 64 for name in hashes})


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta beta gamma")], "d long, t string")
    index = lexical.build_index(docs, "d", "t")
    sinks.write_index(index, str(tmp_path / "ix"))
    back = sinks.read_index(spark, str(tmp_path / "ix"), "d")
    terms = spark.createDataFrame([(1, "beta"), (1, "gamma")], "q int, term string")
    score = lambda i: sorted(map(tuple, lexical.score(i, terms, "q").collect()))
    assert score(back) == score(index)
    checks = tables.index_checks(back.postings, back.terms(), docs.select("d"), "d").first()
    assert tuple(checks) == (0, 0, 0, 0)


def test_manifest(spark, tmp_path):
    sinks.write_table(spark.range(5), str(tmp_path / "a"))
    made = sinks.write_manifest(spark, {"a": str(tmp_path / "a")}, str(tmp_path / "m"), "v2")
    stored = json.loads(spark.read.text(str(tmp_path / "m")).first().value)
    assert stored == made and stored["artifacts"]["a"]["rows"] == 5
    assert sinks.reconcile_manifest(spark, made, {"a": str(tmp_path / "a")}) == []
    assert sinks.reconcile_manifest(spark, made, {"b": "x"}) == ["a", "b"]


def test_settings():
    text = '{"search": {"k": 60}, "filters": {}}'
    assert tables.read_settings(text, ("search",), {"search.k": 60})["search"]["k"] == 60
    with pytest.raises(ContractError, match="missing"):
        tables.read_settings(text, ("dense",), {})
    with pytest.raises(ContractError, match="search.k"):
        tables.read_settings(text, ("search",), {"search.k": 10})


def test_upload_limits():
    assert tables.upload_problem("a.pdf", 10, 2) is None
    assert tables.upload_problem("a.docx", 10, 2) and tables.upload_problem("a.pdf", 6 << 20, 2) and tables.upload_problem("a.pdf", 1, 4)


def test_units_fail_alone_and_stream(spark, tmp_path):
    units = spark.createDataFrame([("u1", "3"), ("u2", "x"), ("u3", "4")], "unit string, payload string")
    work = lambda unit, text: str(int(text) * 2)
    events = progress.run_units(units, work, "unit", "payload")
    kinds = {(r.unit_id, r.kind): r.detail for r in events.collect()}
    assert kinds["u1", "unit_completed"] == "6" and kinds["u2", "unit_failed"].startswith("ValueError")
    assert progress.run_status(events).first().status == "partial"
    units.write.parquet(str(tmp_path / "in"))
    stream = progress.run_units(spark.readStream.schema(units.schema).parquet(str(tmp_path / "in")), work, "unit", "payload")
    query = progress.stream_event_lines(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert query.awaitTermination(60)
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 6 and {line["kind"] for line in lines} == {"unit_started", "unit_completed", "unit_failed"}


def test_vector_checks(spark):
    rows = spark.createDataFrame([([1.0, 0.0],), ([float("nan"), 1.0],), ([2.0],)], "v array<float>")
    got = tables.vector_checks(rows, "v").first()
    assert (got.n_vectors, got.smallest_width, got.largest_width, got.n_not_finite) == (3, 1, 2, 1)


def test_csv_sink_quotes_everything(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([("a", 1)], "x string, y int").coalesce(1), str(tmp_path / "c"), bom=True)
    text = next((tmp_path / "c").glob("part-*.csv")).read_text(encoding="utf-8")
    assert text == '"﻿x","y"\n"a","1"\n'


def test_csv_line_breaks(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('id,note\n1,"a\nb"\n', encoding="utf-8")
    assert [tuple(r) for r in tables.read_csv_strings(spark, str(path), multi_line=True).collect()] == [("1", "a\nb")]
