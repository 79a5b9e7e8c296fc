"""Files read by Python's own reader are what was written."""

from __future__ import annotations

import csv
from pathlib import Path

from scriptoria.sources import csv_files


def read(path):
    out = []
    for f in sorted(Path(path).glob("part-*")):
        raw = f.read_bytes()
        assert raw.startswith(b"\xef\xbb\xbf") and raw.count(b"\n") >= raw.count(b"\r\n") > 0 and raw.endswith(b"\r\n")
        rows = list(csv.reader(raw.decode("utf-8-sig").splitlines(keepends=True)))
        out.append((rows[0], rows[1:]))
    return out


def test_write_and_read(spark, tmp_path):
    rows = [(1, 'a "b", c'), (2, "two\nlines"), (3, "=1+1"), (4, None), (5, "ü"), (6, "-5"), (7, "\tx"), (8, "@me")]
    csv_files.write_csv(spark.createDataFrame(rows, "id long, `name, of \"x\"` string").repartition(3), ["id", 'name, of "x"'], str(tmp_path / "f"))
    files = read(tmp_path / "f")
    assert len(files) == 3 and all(h == ["id", 'name, of "x"'] for h, _ in files)
    assert sorted((int(a), b) for _, rs in files for a, b in rs) == [(1, 'a "b", c'), (2, "two\nlines"), (3, "'=1+1"), (4, ""), (5, "ü"), (6, "-5"), (7, "'\tx"), (8, "'@me")]


def test_empty_table_and_custom_fields(spark, tmp_path):
    none = spark.createDataFrame([], "id long")
    csv_files.write_csv(none, ["id"], str(tmp_path / "e"))
    assert read(tmp_path / "e") == [(["id"], [])]
    papers = spark.createDataFrame([(1,), (2,)], "id long")
    fields = spark.createDataFrame([(5, "ID", 2), (4, "shelf", 1)], "field_id int, name string, position int")
    values = spark.createDataFrame([(1, 4, "x"), (1, 5, "y"), (9, 4, "z")], "paper_id long, field_id int, value string")
    got = csv_files.with_custom_fields(papers, fields, values)
    assert got.columns == ["id", "shelf", "ID 5"] and sorted(map(tuple, got.collect())) == [(1, "x", "y"), (2, "", "")]
    assert csv_files.with_custom_fields(papers, fields.limit(0), values).columns == ["id"]
