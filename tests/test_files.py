from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from pulsegauge.operators import reports, validate
from pulsegauge.sources import files


def _write(folder, **contents):
    for name, text in contents.items():
        data = text if isinstance(text, bytes) else text.encode()
        (folder / name.replace("__", ".")).write_bytes(data)


def _name(path):
    return os.path.basename(path)


def _by_file(df):
    out = {}
    for r in df.orderBy("source", "row_num").collect():
        out.setdefault(_name(r.source), []).append(r)
    return out


def test_csv_headers_in_any_order(spark, tmp_path):
    _write(
        tmp_path,
        a__csv="metric,value,timestamp\ncpu,1,2024-01-01T00:00:00Z\ncpu,x,2024-01-01T00:00:01Z\n\ncpu,3,1700478600\n",
        b__CSV='timestamp,extra,meta,metric,value\r\n2024-01-01T00:00:00Z,q,"{""a"": 1, ""b"": 2}",mem,5\r\n2024-01-01,q,{x,mem,5\r\n2024-01-01,q,[1],mem,6\r\n2024-01-01\r\n',
        c__csv="metric,val,timestamp\ncpu,1,2024-01-01\n",
        d__csv=b"metric,value,timestamp\ncaf\xe9,1,2024-01-01\n",
    )
    scan = files.read_csv(spark, [str(tmp_path)])
    assert {_name(r.source): r.error for r in scan.files.collect()} == {
        "a.csv": None, "b.CSV": None, "c.csv": files.BAD_HEADER, "d.csv": files.BAD_ENCODING,
    }
    rows = _by_file(scan.checked())
    assert [(r.row_num, r.reason) for r in rows["a.csv"]] == [(1, None), (2, "value_type"), (3, "timestamp_format")]
    assert [r.reason for r in rows["b.CSV"]] == [None, None, "meta_not_object", "missing_field"]
    assert [r.meta_json for r in rows["b.CSV"]][:2] == ['{"a":1,"b":2}', "{}"]
    epoch = _by_file(scan.checked(allow_epoch=True))
    assert epoch["a.csv"][2].reason is None and epoch["a.csv"][2].event_us == 1700478600 * 10**6
    shared = files.read_csv(spark, [str(tmp_path / "a.csv")], header=["metric", "value", "timestamp"])
    assert shared.checked().count() == 3


def test_txt_lines(spark, tmp_path):
    _write(
        tmp_path,
        a__txt='# head\n\ncpu,1,2024-01-01T00:00:00Z\n cpu\t2\t2024-01-01T00:00:01Z\ncpu,3,2024-01-01,{"a":1}\ncpu,4,2024-01-01,{"a":1,"b":2}\n',
        b__txt="cpu,1\ncpu,2,2024-01-01\n",
    )
    scan = files.read_txt(spark, [str(tmp_path)])
    assert {_name(r.source): r.error for r in scan.files.collect()} == {"a.txt": None, "b.txt": files.BAD_LINE}
    rows = _by_file(validate.valid(scan.checked()))
    assert set(rows) == {"a.txt"}
    assert [(r.row_num, r.value, r.meta_json) for r in rows["a.txt"]] == [(1, 1.0, "{}"), (2, 2.0, "{}"), (3, 3.0, '{"a":1}'), (4, 4.0, "{}")]
    rest = _by_file(files.read_txt(spark, [str(tmp_path / "a.txt")], meta_rest=True).checked())
    assert rest["a.txt"][3].meta_json == '{"a":1,"b":2}'


def test_json_documents(spark, tmp_path):
    hosts = [
        {"metric": m, "value": 40 + i, "timestamp": f"2025-01-21T12:0{i}:00Z", "meta": {"host": "h", "region": "r"}}
        for m in ("cpu", "memory")
        for i in range(5)
    ]
    _write(
        tmp_path,
        a__json=json.dumps(hosts, indent=2), b__json='{"metric": "one", "value": "2", "timestamp": "2024-01-01"}',
        c__json="5", d__json="[{bad", e__json='[{"metric": "a", "timestamp": "2024-01-01"}, 7]',
    )
    scan = files.read_json(spark, [str(tmp_path)])
    assert {_name(r.source): r.error for r in scan.files.collect()} == {
        "a.json": None, "b.json": None, "c.json": files.BAD_JSON, "d.json": files.BAD_JSON, "e.json": None,
    }
    rows = _by_file(scan.checked())
    assert [r.reason for r in rows["a.json"]] == [None] * 10
    assert rows["a.json"][0].meta_json == '{"host":"h","region":"r"}'
    assert [r.value for r in rows["b.json"]] == [2.0]
    assert [(r.row_num, r.reason) for r in rows["e.json"]] == [(1, "missing_field"), (2, "missing_field")]


def test_json_lines(spark, tmp_path):
    _write(tmp_path, m__jsonl='{"timestamp": "2023-11-20T10:30:00", "metric": "cpu", "value": 75.5, "meta": {"host": "a"}}\n\n{bad\n')
    rows = files.read_jsonl(spark, [str(tmp_path)]).orderBy("row_num").collect()
    assert [(r.row_num, r.reason) for r in rows] == [(1, None), (2, "invalid_json")]


def test_row_numbers_across_splits(spark, tmp_path):
    body = "".join(f"m,{i},2024-01-01T00:{i // 60 % 60:02d}:{i % 60:02d}Z\n" for i in range(2000))
    _write(tmp_path, a__txt="# head\n" + body, b__csv="metric,value,timestamp\n" + body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        scan = files.read_files(spark, [str(tmp_path)])
        rows = scan.rows.select(F.col("row_num"), F.col("value").cast("bigint").alias("i")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 4000
    assert all(r.row_num == r.i + 1 for r in rows)


def test_mixed_upload_report(spark, tmp_path):
    bad = "".join(f"m,bad,2024-01-01T00:00:{i:02d}Z\n" for i in range(11))
    _write(
        tmp_path,
        ok__csv="metric,value,timestamp\nm,1,2024-01-01\nm,x,2024-01-02\n", many__txt=bad,
        broken__txt="a,b\n", one__json='{"metric": "one", "value": 2, "timestamp": "2024-01-01"}',
    )
    paths = [str(tmp_path / n) for n in ("ok.csv", "many.txt", "broken.txt", "one.json", "notes.xml")]
    scan = files.read_files(spark, paths)
    summary = reports.upload_summary(scan.checked(), scan.files)
    got = {_name(r.source): r for r in summary.collect()}
    assert (got["ok.csv"].total_rows, got["ok.csv"].success_count, got["ok.csv"].error_count) == (2, 1, 1)
    assert [(e.row, e.error) for e in got["ok.csv"].errors] == [(2, "value_type")]
    assert got["many.txt"].errors is None and got["many.txt"].errors_note == "Too many errors to display (11 total)"
    assert not got["broken.txt"].success and got["broken.txt"].file_error == files.BAD_LINE
    assert got["notes.xml"].file_error == files.BAD_EXTENSION
    total = reports.bulk_summary(summary).filter("level = 'total'").first()
    assert (total.total_files, total.files_ok, total.total_success_count, total.total_error_count) == (5, 3, 2, 12)


def test_no_files(spark):
    with pytest.raises(ValueError):
        files.read_files(spark, [])


def test_few_points_give_no_anomaly(spark, tmp_path):
    """Seven points per metric stay below what the default threshold can reach."""
    from pulsegauge.operators.detectors import ZScoreDetector

    lines = [f"{m},{v},2031-06-03T04:05:{10 + i}Z" for m in ("tide", "salt") for i, v in enumerate((3, 4, 3, 5, 4, 900, 3))]
    _write(tmp_path, s__csv="metric,value,timestamp\n" + "\n".join(lines))
    events = validate.valid(files.read_files(spark, [str(tmp_path / "s.csv")]).checked())
    assert events.count() == 14
    assert ZScoreDetector().anomalies(events, 300 * 10**6).count() == 0


def test_every_path_has_an_outcome(spark, tmp_path):
    folder = tmp_path / "v1.2"
    folder.mkdir()
    _write(
        folder, comments__txt="# only\n\n", blank__csv="\n\n", empty__txt="", empty__csv="", ok__csv="metric,value,timestamp\ncpu,1,2024-01-01\n", readme__md="x"
    )
    (folder / "noext").write_text("cpu,1,2024-01-01\n")
    scan = files.read_files(spark, [str(folder), str(folder / "noext"), str(tmp_path / "absent.csv")])
    outcome = {}
    for r in scan.files.collect():
        outcome.setdefault(_name(r.source), set()).add(r.error)
    assert outcome == {
        "comments.txt": {None}, "empty.txt": {None}, "blank.csv": {files.BAD_HEADER}, "empty.csv": {files.BAD_HEADER}, "ok.csv": {None},
        "readme.md": {files.BAD_EXTENSION}, "noext": {files.BAD_EXTENSION}, "absent.csv": {files.NO_FILE},
    }
    assert scan.checked().count() == 1


def test_csv_quotes(spark, tmp_path):
    _write(
        tmp_path,
        a__csv='metric,meta,value,timestamp\n"a ""b"", c","{""k"":\n1}",1,2024-01-01\n\nplain,,2,2024-01-02\nsize 5",,3,2024-01-03\n',
        b__csv='value,metric,timestamp,metric\n1,x,2024-01-01,"y,z"\n',
    )
    rows = _by_file(files.read_csv(spark, [str(tmp_path)]).checked())
    assert [(r.row_num, r.metric, r.value, r.meta_json, r.reason) for r in rows["a.csv"]] == [
        (1, 'a "b", c', 1.0, '{"k":1}', None), (2, "plain", 2.0, "{}", None), (3, 'size 5"', 3.0, "{}", None),
    ]
    assert [(r.metric, r.value) for r in rows["b.csv"]] == [("y,z", 1.0)]
