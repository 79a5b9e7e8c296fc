"""Files read in parts of any size give the records of the whole file."""

from __future__ import annotations

import io

import pytest

from scriptoria.sources import record_files as RF

BIB = "@Article{a1,\n title = {A {Great} Stüdy},\n author = \"{Doe, \"J\"} and Roe\", year=2001, note = {mail\n  me @ home}}\n  @misc{b2, title = bare value\n}\n@comment{x, y}\n@book{, title = {no key}}\n@string{s = {t}}\n@inproceedings{c3,title={x},pages = 1--2}\n" + "".join(f"@article{{k{i},\n title = {{Title {'ü' * (i % 7)} {i}}}\n}}\n\n" for i in range(40))
RIS = "stray\nTY  - JOUR\nAU  - Doe, J.\nAU  - Roe, R.\nTI  - A long\n title\nN1  - \nER  - \nstray\r\nTY  - BOOK\r\nTI  - B\r\nTY - MISC\nTI - no end before\nER  -\n" + "".join(f"TY  - JOUR\nTI  - T{'é' * (i % 5)}{i}\nER  - \n" for i in range(40))


@pytest.mark.parametrize(("text", "begins", "parse"), [(BIB, rb"\n[ \t]*@\w+\s*\{", RF.bibtex_entries), (RIS, rb"\nTY  ?-", RF.ris_records)])
def test_parts_of_any_size(text, begins, parse, monkeypatch):
    import re

    monkeypatch.setattr(RF, "STEP", 64)
    data = text.encode()
    whole = list(parse(text))
    assert len(whole) > 40
    for split in [*range(1, 90), 200, 1000, len(data), 10 * len(data)]:
        found = []
        for a in range(0, len(data), split):
            part = RF.Part("", a, min(a + split, len(data)), len(data))
            found += parse(RF.section(io.BytesIO(data), part, re.compile(begins))[1].decode())
        assert found == whole, split


def test_values():
    first, second, third = list(RF.bibtex_entries(BIB))[:3]
    assert first == {"entry_type": "article", "key": "a1", "fields": {"title": "A Great Stüdy", "author": 'Doe, "J" and Roe', "year": "2001", "note": "mail me @ home"}}
    assert second["fields"] == {"title": "bare value"} and third["key"] == "c3" and third["fields"] == {"title": "x", "pages": "1--2"}
    records = list(RF.ris_records(RIS))
    assert records[:3] == [{"TY": ["JOUR"], "AU": ["Doe, J.", "Roe, R."], "TI": ["A long title"]}, {"TY": ["BOOK"], "TI": ["B"]}, {"TY": ["MISC"], "TI": ["no end before"]}]
    assert list(RF.bibtex_entries("")) == list(RF.ris_records(None)) == [] and list(RF.bibtex_entries("@a{k, t = {open")) == [{"entry_type": "a", "key": "k", "fields": {"t": "open"}}]


def test_read_in_one_and_in_many_parts(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.bib").write_text(BIB)
    (tmp_path / "deep" / "b.bib").write_text(BIB * 3)
    (tmp_path / "empty.bib").write_text("")
    one = RF.read_records(spark, "bibtex", str(tmp_path))
    many = RF.read_records(spark, "bibtex", f"file://{tmp_path}", 300)
    assert one.rdd.getNumPartitions() == 2 and many.rdd.getNumPartitions() > 8
    rows = lambda d: sorted((r["file"].rsplit("/", 1)[-1], r["key"], sorted(r["fields"].items())) for r in d.collect())
    assert rows(one) == rows(many) and len(rows(one)) == 4 * 43
    (tmp_path / "deep" / "c.ris").write_text(RIS)
    assert RF.read_records(spark, "ris", str(tmp_path / "deep" / "c.ris"), 100).count() == 43


def test_small_parts_of_large_files_share_tasks(spark, tmp_path, monkeypatch):
    """Tasks follow the bytes, not the parts; the rows and the places of their parts stay."""
    (tmp_path / "a.bib").write_text("".join(f"@article{{k{i},\n title = {{Title {i}}}\n}}\n\n" for i in range(3000)))
    (tmp_path / "b.bib").write_text(BIB)
    many = RF.read_records(spark, "bibtex", str(tmp_path), 100)
    assert many.rdd.getNumPartitions() <= 65  # a task a part: some 1,200
    monkeypatch.setattr(RF, "LEAST_TASKS", 1 << 30)
    single = RF._Reader({"path": str(tmp_path), "split_bytes": "100"}, rb"\n[ \t]*@\w+\s*\{", lambda text: ((e["entry_type"], e["key"], e["fields"]) for e in RF.bibtex_entries(text)))
    tasks = single.partitions()
    assert len(tasks) > 1000 and all(len(t.parts) == 1 for t in tasks)
    key = lambda r: (r[0], r[1], r[2], r[3], r[4], sorted(r[5].items()))
    assert sorted(key(tuple(r)) for r in many.collect()) == sorted(key(r) for t in tasks for r in single.read(t))


def test_no_more_than_split_bytes_to_a_task(monkeypatch):
    parts = [RF.Part("f", a, a + 10, 10_000) for a in range(0, 10_000, 10)]
    monkeypatch.setattr(RF, "SPLIT_BYTES", 100)
    found = RF.dealt(parts)
    assert [len(t.parts) for t in found] == [10] * 100 and [p for t in found for p in t.parts] == parts and RF.dealt([]) == []
