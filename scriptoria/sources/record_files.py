"""BibTeX and RIS files as Spark data sources: large files are read in parts that begin where a record begins.

    spark.dataSource.register(BibtexFiles)
    spark.read.format("bibtex").option("path", folder).option("split_bytes", 8 << 20).load()

A part takes the records that begin in its range of bytes, wherever they end. Paths are those of any file system that Arrow
can open; a folder is searched recursively.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a part, and how much is read at a time behind its end.
SPLIT_BYTES, STEP = 8 << 20, 1 << 16
#: Tasks that many parts are dealt to at least; beyond that a task takes as many as make up ``SPLIT_BYTES``.
LEAST_TASKS = 64

ENTRY = re.compile(r"@(\w+)\s*\{\s*([^,\s{}]*)\s*,", re.S)
FIELD = re.compile(r"\s*([\w-]+)\s*=\s*")
BRACE, BARE, GAP = re.compile(r"[{}]"), re.compile(r"[^,}\n]*"), re.compile(r"[ \t\r\n,]*")
TAG = re.compile(r"([A-Z][A-Z0-9])  ?-(.*)", re.S)


def _value(text: str, at: int) -> tuple[str, int]:
    """The value that begins at ``at``, in braces, quotes or bare, and where the text goes on."""
    if text[at : at + 1] not in ("{", '"'):
        m = BARE.match(text, at)
        return m[0], m.end()
    if text[at] == '"':
        # a quote within braces does not end the value
        depth, k = 0, at + 1
        for m in re.compile(r'[{}"]').finditer(text, at + 1):
            depth += (m[0] == "{") - (m[0] == "}")
            k = m.start()
            if m[0] == '"' and depth == 0:
                return text[at + 1 : k], k + 1
        return text[at + 1 :], len(text)
    depth = 0
    for m in BRACE.finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return text[at + 1 : m.start()], m.end()
    return text[at + 1 :], len(text)


def bibtex_entries(text: str) -> Iterator[dict]:
    """Entries with a key: entry_type, key and fields; braces inside values are dropped, blanks run together."""
    at = 0
    while m := ENTRY.search(text or "", at):
        kind, key, at = m[1].lower(), m[2], m.end()
        if not key or kind in ("comment", "string", "preamble"):
            continue
        fields: dict[str, str] = {}
        while (f := FIELD.match(text, at)) and f.end() < len(text):
            value, at = _value(text, f.end())
            fields[f[1].lower()] = " ".join(value.replace("{", "").replace("}", "").split())
            at = GAP.match(text, at).end()
        yield {"entry_type": kind, "key": key, "fields": fields}


def ris_records(text: str) -> Iterator[dict[str, list[str]]]:
    """Tags with their values in order: TY opens a record, ER ends it, other lines continue the last tag. Empty values are none."""
    tags: list[tuple[str, list[str]]] | None = None
    for line in (text or "").split("\n"):
        m = TAG.match(line.rstrip("\r"))
        if m and m[1] == "TY":
            if tags is not None:
                yield _by_tag(tags)
            tags = [("TY", [m[2]])]
        elif tags is not None and m and m[1] == "ER":
            yield _by_tag(tags)
            tags = None
        elif tags is not None and m:
            tags.append((m[1], [m[2]]))
        elif tags is not None:
            tags[-1][1].append(line)
    if tags is not None:
        yield _by_tag(tags)


def _by_tag(tags: list[tuple[str, list[str]]]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for tag, lines in tags:
        if value := " ".join(x for x in (line.strip() for line in lines) if x):
            out.setdefault(tag, []).append(value)
    return out


@dataclass
class Part(InputPartition):
    path: str
    first: int
    last: int
    size: int


@dataclass
class Parts(InputPartition):
    """Parts that one task reads, one after the other."""

    parts: list[Part]


def dealt(parts: list[Part]) -> list[Parts]:
    """Successive parts together, so that tasks grow in number with the bytes of the files, however small the parts are."""
    least = min(SPLIT_BYTES, sum(p.last - p.first for p in parts) // LEAST_TASKS)
    out: list[Parts] = []
    size = least
    for p in parts:
        if size >= least:
            out.append(Parts([]))
            size = 0
        out[-1].parts.append(p)
        size += p.last - p.first
    return out


def section(file, part: Part, begins: re.Pattern) -> tuple[int, bytes]:
    """Place and bytes of the records that begin in the part. ``begins`` matches from the line feed before a record on; a
    record at the start of the file needs none."""
    base = max(part.first - 1, 0)  # a record that begins with the part has its line feed before it
    file.seek(base)
    data = file.read(part.last - base)
    start = 0

    def next_from(place: int) -> int | None:
        """Where the first record from ``place`` on begins, reading as far as needed."""
        nonlocal data
        look = max(place - base - 1, 0)
        while True:
            if m := begins.search(data, look):
                return base + m.start() + 1
            more = file.read(STEP)
            if not more:
                return None
            look = max(len(data) - 256, look)  # an opening may lie across the end of what was read
            data += more

    start = next_from(part.first) if part.first else 0
    if start is None or start >= part.last:
        return part.last, b""
    end = next_from(part.last)
    return start, data[start - base : None if end is None else end - base]


class _Reader(DataSourceReader):
    def __init__(self, options: dict, begins: bytes, parse):
        self.path, self.split = options["path"], int(options.get("split_bytes", SPLIT_BYTES))
        self.begins, self.parse = re.compile(begins), parse

    def partitions(self) -> list[Parts]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        info = system.get_file_info(path)
        files = system.get_file_info(fs.FileSelector(path, recursive=True)) if info.type == fs.FileType.Directory else [info]
        files = sorted((f for f in files if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        return dealt([Part(f.path, a, min(a + self.split, f.size), f.size) for f in files for a in range(0, f.size, self.split)])

    def read(self, task: Parts) -> Iterator[tuple]:
        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        for path, parts in groupby(task.parts, lambda p: p.path):
            with system.open_input_file(path) as f:
                for part in parts:
                    at, data = section(f, part, self.begins)
                    for n, row in enumerate(self.parse(data.decode("utf-8", "replace"))):
                        yield (path, at, n, *row)


class BibtexFiles(DataSource):
    """file, part (where its records begin), n (within the part), entry_type, key, fields. Options: path, split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "bibtex"

    def schema(self) -> str:
        return "file string, part long, n long, entry_type string, key string, fields map<string,string>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, rb"\n[ \t]*@\w+\s*\{", lambda text: ((e["entry_type"], e["key"], e["fields"]) for e in bibtex_entries(text)))


class RisFiles(DataSource):
    """file, part (where its records begin), n (within the part), type, tags. Options: path, split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "ris"

    def schema(self) -> str:
        return "file string, part long, n long, type string, tags map<string,array<string>>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, rb"\nTY  ?-", lambda text: (((r.get("TY") or [None])[0], r) for r in ris_records(text)))


def read_records(spark: SparkSession, kind: str, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the files of ``kind`` (bibtex or ris) under ``path``.

    Files are UTF-8; broken bytes become replacement characters. Empty files and folders give no rows. Where a part begins
    is read off a line that opens a record; a value that holds such a line at exactly that place would be cut there.
    """
    spark.dataSource.register({"bibtex": BibtexFiles, "ris": RisFiles}[kind])
    return spark.read.format(kind).option("path", path).option("split_bytes", split_bytes).load()
