"""Files: scans, validation, archives, sinks and streams."""

import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from clausegrid.sources import scans as S, sinks as K
from clausegrid.streaming import jobs


def test_json_lines(spark, tmp_path):
    rows = [{"id": "a", "kind": "SMT", "text": "x"}, {"id": "b", "kind": "obj", "text": "y"}, {"id": " ", "kind": "smt", "text": "z"}, {"id": "c", "kind": "gdn", "text": " "}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    assert [r["id"] for r in S.clauses(spark, str(tmp_path)).collect()] == ["a"]
    assert {r["id"] for r in S.clauses(spark, str(tmp_path), None).collect()} == {"a", "b"}
    assert S.files(spark, str(tmp_path)).count() == 1


def test_strict_validation(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"a": 1}')
    (tmp_path / "bad.jsonl").write_bytes(b'\xef\xbb\xbf{"a": 1}\n\n{"a": 1, "a": 2}\n{"x": NaN}\n[1]')
    got = {r["path"].rpartition("/")[2]: r for r in S.validated(spark, str(tmp_path)).collect()}
    assert got["good.json"]["rows"] == 1 and got["good.json"]["errors"] == []
    assert got["bad.jsonl"]["rows"] == 1 and len(got["bad.jsonl"]["errors"]) == 4 and got["bad.jsonl"]["warnings"] == ["byte order mark", "no final newline"]
    assert S.validate_json(b"\xff", False)[1] == ["not UTF-8"]


def test_unique_and_gold(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("a",)], "id string")
    with pytest.raises(Exception, match="missing or repeated key"):
        S.unique(df).collect()
    (tmp_path / "g.csv").write_text('﻿ID,question,gold_control_path\n7,"a ""b""","x\ny"\n', encoding="utf-8")
    r = S.gold(spark, str(tmp_path / "g.csv")).first()
    assert (r["query_key"], r["question"], r["gold_control_path"]) == ("7", 'a "b"', "x\ny")


def test_profiles_and_registries(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("# none\nac-1_odp.01: 24 hours # c\nb: \"q: r\"\n")
    assert {r["param"]: r["value"] for r in S.profile(spark, str(tmp_path / "p.yaml")).collect()} == {"ac-1_odp.01": "24 hours", "b": "q: r"}
    data = b'{"param_id": "p", "ask_prompt": "?"}\n'
    (tmp_path / "r.json").write_bytes(data)
    assert S.registry(spark, str(tmp_path / "r.json"), hashlib.sha256(data).hexdigest()).first()["param_id"] == "p"
    with pytest.raises(ValueError):
        S.registry(spark, str(tmp_path / "r.json"), "0")
    assert S.registry(spark, str(tmp_path / "none.json"), None).count() == 0


def test_contexts_and_logs(spark, tmp_path):
    row = {"query_id": "1", "question": "é", "rewrites": ["a"]}
    text = json.dumps(row, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    good = row | {"context_sha256": hashlib.sha256(text.encode()).hexdigest()}
    (tmp_path / "c.jsonl").write_text(json.dumps(good) + "\n" + json.dumps(good | {"question": "x"}) + "\n")
    assert [r["valid"] for r in S.contexts(spark, str(tmp_path / "c.jsonl")).collect()] == [True, False]
    (tmp_path / "l.jsonl").write_text('{"schema_version": "v1", "response_id": "a"}\n{"schema_version": "v1", "response_id": "b"}\n')
    assert S.call_log(spark, str(tmp_path / "l.jsonl"), "v1").count() == 2
    with pytest.raises(Exception, match="schema version"):
        S.call_log(spark, str(tmp_path / "l.jsonl"), "v2").collect()


def test_archives_and_worksheets(spark, tmp_path):
    data = K.archive({"b.csv": b"x\ny", "a.txt": b"z"})
    assert data == K.archive({"a.txt": b"z", "b.csv": b"x\ny"})
    (tmp_path / "a.zip").write_bytes(data)
    assert [(r["member"], r["line"]) for r in S.zip_members(spark, str(tmp_path / "a.zip"), r"\.csv$").collect()] == [("b.csv", "x"), ("b.csv", "y")]
    sheet = '<worksheet xmlns="m"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>4.5</v></c></row><row><c r="B2" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>sh</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    (tmp_path / "w.xlsx").write_bytes(out.getvalue())
    assert [r["cells"] for r in S.worksheets(spark, str(tmp_path / "w.xlsx")).orderBy("row").collect()] == [["sh", "", "4.5"], ["", "in"]]
    bad = io.BytesIO()
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet.replace("<v>4.5</v>", "<f>1</f>").replace(' t="s"', ""))
    with pytest.raises(ValueError, match="formula"):
        S.worksheet(bad.getvalue())


def test_first_object():
    assert S.first_object('a {b {"x": "}", "y": {}} c') == '{"x": "}", "y": {}}' and S.first_object("none {") is None and S.first_object(None) is None


def test_resume_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"v{k}") for k in range(5)], "k long, v string")
    assert K.append_remaining(rows.where("k < 3"), str(tmp_path / "t"), "k") == 3
    assert K.append_remaining(rows, str(tmp_path / "t"), "k", ("v",)) == 2
    with pytest.raises(Exception, match="a finished row differs"):
        K.append_remaining(rows.withColumn("v", F.lit("other")), str(tmp_path / "t"), "k", ("v",))
    K.json_lines(rows, str(tmp_path / "j"))
    with pytest.raises(Exception):
        K.json_lines(rows, str(tmp_path / "j"))
    assert K.markdown(rows.where("k = 1")) == "| k | v |\n| --- | --- |\n| 1 | v1 |"
    assert S.csv_text([{"b": 1, "a": 2}], ["a", "b"]) == "a,b\n2,1\n"


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(k % 4, k, f"2024-01-01 00:0{k}:00") for k in range(8)], "k long, v long, t string").withColumn("t", F.to_timestamp("t"))
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = lambda: jobs.files(spark, str(tmp_path / "in"), rows.schema)
    for _ in range(2):
        jobs.each_batch(stream(), lambda df: df.select("v"), str(tmp_path / "out"), "v", str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8
    q = jobs.unique_log(stream(), "k", "t", "1 hour").writeStream.format("memory").queryName("uniq").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("uniq").count() == 4
    q = jobs.windowed_counts(stream(), "t", "k").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 8
