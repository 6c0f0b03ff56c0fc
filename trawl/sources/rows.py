"""Row sources: CSV, TSV, JSON lines and SQL dumps as text columns, where absent is null."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "table string, row map<string,string>"


def read_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Quoted cells with doubled quotes and newlines; empty cells are null, ragged rows fail."""
    df = spark.read.options(header=header, multiLine=True, quote='"', escape='"', mode="FAILFAST", nullValue="", enforceSchema=False).csv(path)
    return df if header else df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def read_tsv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Cells between tabs, without quoting."""
    df = spark.read.options(header=header, sep="\t", quote="", mode="FAILFAST", nullValue="", enforceSchema=False).csv(path)
    return df if header else df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def flatten(line: str) -> dict[str, str]:
    """One JSON object as dotted paths: arrays stay JSON text, null is absent, the last of equal keys counts."""
    out: dict[str, str] = {}

    def walk(prefix: str, value: object) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                walk(f"{prefix}.{k}" if prefix else k, v)
        elif isinstance(value, list):
            out[prefix] = _raw(value)
        elif value is not None:
            out[prefix] = value if isinstance(value, str) else json.dumps(value)

    made = json.loads(line, parse_float=_Literal, parse_int=_Literal)
    if not isinstance(made, dict):
        raise ValueError("a line is not a JSON object")
    walk("", made)
    return {k: v if isinstance(v, str) else str(v) for k, v in out.items()}


class _Literal(str):
    """A number as it was written."""


def _raw(value: object) -> str:
    """JSON text of a parsed value, with its numbers as they were written."""
    if isinstance(value, _Literal):
        return str(value)
    if isinstance(value, list):
        return "[" + ",".join(map(_raw, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_raw(v)}" for k, v in value.items()) + "}"
    return json.dumps(value, ensure_ascii=False)


def flattened(lines: DataFrame, column: str = "value") -> DataFrame:
    """row map<string,string> of each non-blank line of a text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [list(flatten(x).items()) for x in batch.column(0).to_pylist() if x and x.strip()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.map_(pa.string(), pa.string()))], names=["row"])

    return lines.select(column).mapInArrow(run, "row map<string,string>")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return flattened(spark.read.text(path))


def mapped(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Columns name = path of a frame of maps; blank text is null."""
    return rows.select(*(F.nullif(F.element_at("row", path), F.lit("")).alias(name) for name, path in fields.items()))


def number(text: Column) -> Column:
    """The finite number that a text holds, else null."""
    v = F.trim(text).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def schema_of(spec: str) -> list[tuple[str, float, float]]:
    """(name, boost, b) of a spec like `sku:0:0.6,name:3:0.4`; 1 to 4 fields, and a missing part is 1 or 0.75."""
    out = []
    for part in spec.split(","):
        name, *rest = part.strip().split(":")
        if not name or len(rest) > 2:
            raise ValueError(f"not a field: {part!r}")
        out.append((name, float(rest[0]) if rest else 1.0, float(rest[1]) if len(rest) > 1 else 0.75))
    if not 1 <= len(out) <= 4:
        raise ValueError("a schema has 1 to 4 fields")
    return out


def lossy_lines(files: DataFrame) -> DataFrame:
    """Lines with bytes that aren't UTF-8 in binary files (column content), as one number."""
    text = F.decode("content", "UTF-8")
    return files.select(F.explode(F.split(text, "\n")).alias("line")).agg(F.count(F.when(F.col("line").contains("�"), 1)).alias("lossy_lines"))


def read_sql_dump(spark: SparkSession, path: str, tables: list[str] | None = None) -> DataFrame:
    """table and row of every row that INSERT ... VALUES and COPY ... FROM stdin add; other statements are passed over.

    tables: names to keep, bare or qualified, in any case. A dump is read file by file, as statements run over lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = list(dump_rows(text))
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found]), pa.array([[(k, v) for k, v in r.items() if v is not None] for _, r in found], pa.map_(pa.string(), pa.string()))], names=["table", "row"])

    rows = spark.read.text(path, wholetext=True).mapInArrow(run, ROWS)
    if tables:
        names = [t.lower() for t in tables]
        full = F.lower("table")
        rows = rows.filter(full.isin(names) | F.substring_index(full, ".", -1).isin(names))
    return rows


def dump_counts(spark: SparkSession, path: str, tables: list[str] | None = None) -> DataFrame:
    """One row: rows that read_sql_dump keeps, rows of other tables, and statements that it passes over."""
    names = {t.lower() for t in tables or ()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = excluded = skipped = 0
            for text in batch.column(0).to_pylist():
                for table, row in dump_events(text):
                    wanted = not names or table.lower() in names or table.lower().rpartition(".")[2] in names
                    kept, excluded, skipped = kept + (row is not None and wanted), excluded + (row is not None and not wanted), skipped + (row is None)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (kept, excluded, skipped)], names=["kept", "excluded", "skipped"])

    each = spark.read.text(path, wholetext=True).mapInArrow(run, "kept long, excluded long, skipped long")
    return each.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("kept", "excluded", "skipped")))


def read_sosd(spark: SparkSession, path: str) -> DataFrame:
    """position and key (decimal) of binary files of 64-bit unsigned keys after their number; a file that is too short fails."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                n = int.from_bytes(data[:8], "little")
                keys = np.frombuffer(data, "<u8", n, 8)
                for at in range(0, n, 1 << 16):
                    part = pa.array(keys[at : at + (1 << 16)]).cast(pa.decimal128(20, 0))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), part], names=["position", "key"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "position long, key decimal(20,0)")


class _Scanner:
    """Reads tokens of SQL text: words, quoted names, literals and signs."""

    def __init__(self, text: str, at: int = 0):
        self.text, self.at = text, at

    def find(self, what: str, at: int) -> int:
        if (found := self.text.find(what, at)) < 0:
            raise ValueError(f"{what} is missing")
        return found

    def skip(self) -> None:
        t = self.text
        while self.at < len(t):
            if t[self.at].isspace():
                self.at += 1
            elif t.startswith("--", self.at) or t[self.at] == "#":
                self.at = (t.find("\n", self.at) + 1) or len(t)
            elif t.startswith("/*", self.at):
                self.at = (t.find("*/", self.at) + 2) if "*/" in t[self.at :] else len(t)
            else:
                return

    def peek(self) -> str:
        self.skip()
        return self.text[self.at : self.at + 1]

    def take(self, sign: str) -> bool:
        if self.peek() == sign:
            self.at += 1
            return True
        return False

    def word(self) -> str:
        self.skip()
        start = self.at
        while self.at < len(self.text) and (self.text[self.at].isalnum() or self.text[self.at] in "_$"):
            self.at += 1
        return self.text[start : self.at]

    def name(self) -> str:
        """A name that may be qualified and quoted."""
        parts = []
        while True:
            quote = self.peek()
            if quote and quote in '"`[':
                end = {'"': '"', "`": "`", "[": "]"}[quote]
                self.at += 1
                out = ""
                while self.at < len(self.text):
                    c = self.text[self.at]
                    self.at += 1
                    if c == end:
                        if end != "]" and self.text[self.at : self.at + 1] == end:
                            out, self.at = out + end, self.at + 1
                            continue
                        break
                    out += c
                parts.append(out)
            else:
                parts.append(self.word())
            if self.text[self.at : self.at + 1] != ".":
                return ".".join(parts)
            self.at += 1

    def string(self, escapes: bool) -> str:
        """A quoted string; doubled quotes are one, and backslashes escape if asked."""
        self.at += 1
        out: list[str] = []
        while self.at < len(self.text):
            c = self.text[self.at]
            self.at += 1
            if c == "'":
                if self.text[self.at : self.at + 1] != "'":
                    return "".join(out)
                self.at += 1
            elif c == "\\" and escapes:
                c = self.text[self.at : self.at + 1]
                self.at += 1
                c = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "0": "\0"}.get(c, c)
            out.append(c)
        raise ValueError("a string is not closed")

    def value(self) -> str | None:
        """A literal as text; null is None, calls are kept as written, casts are dropped."""
        c = self.peek()
        if c == "'":
            out: str | None = self.string("\\'" in self.text[self.at : self.at + 4096] and "`" in self.text[: self.at])
        elif c in "eEnNxXbB" and self.text[self.at + 1 : self.at + 2] == "'":
            self.at += 1
            out = self.string(c in "eE")
        elif c == "$" and (end := self.text.find("$", self.at + 1)) > 0:
            tag = self.text[self.at : end + 1]
            stop = self.find(tag, end + 1)
            out, self.at = self.text[end + 1 : stop], stop + len(tag)
        else:
            start, depth = self.at, 0
            while self.at < len(self.text):
                c = self.text[self.at]
                if c == "'":
                    self.string(False)
                    continue
                if depth == 0 and (c in ",)" or self.text.startswith("::", self.at)):
                    break
                depth += (c == "(") - (c == ")")
                self.at += 1
            out = self.text[start : self.at].strip()
            out = None if out.lower() == "null" else out.lower() if out.lower() in ("true", "false") else out
        while self.text.startswith("::", self.at):
            self.at += 2
            self.name()
            if self.take("("):
                self.at = self.find(")", self.at) + 1
            while self.text.startswith("[]", self.at):
                self.at += 2
        return out

    def statement_end(self) -> None:
        while (c := self.peek()) and c != ";":
            if c == "'":
                self.string(False)
            elif c in '"`':
                self.name()
            else:
                self.at += 1
        self.at += 1


def dump_rows(text: str) -> Iterator[tuple[str, dict[str, str | None]]]:
    """(table, row) of each row of a dump. Without a column list, columns are c0, c1, ..."""
    return ((table, row) for table, row in dump_events(text) if row is not None)


def dump_events(text: str) -> Iterator[tuple[str, dict[str, str | None] | None]]:
    """The same, and (verb, None) for each statement that is passed over."""
    s = _Scanner(text)
    while s.peek():
        start = s.at
        verb = s.word().upper()
        if verb == "COPY":
            table = s.name()
            columns = _columns(s)
            rest = text[s.at : (text.find("\n", s.at) + 1) or len(text)]
            if rest.strip().lower().startswith("from stdin"):
                at = s.at + len(rest)
                for line in iter(text[at:].split("\n").__iter__().__next__, "\\."):
                    at += len(line) + 1
                    if line:
                        cells = [_copy_cell(x) for x in line.rstrip("\r").split("\t")]
                        if columns and len(cells) != len(columns):
                            raise ValueError(f"{table}: a row has {len(cells)} cells, not {len(columns)}")
                        yield table, dict(zip(columns or [f"c{i}" for i in range(len(cells))], cells, strict=True))
                s.at = at + 3
                continue
            yield verb, None
        elif verb == "INSERT":
            while (before := s.at) is not None and s.word().upper() in ("INTO", "IGNORE", "LOW_PRIORITY", "DELAYED"):
                pass
            s.at = before
            table = s.name()
            columns = _columns(s)
            before = s.at
            if s.word().upper() == "OVERRIDING":
                s.word()
                s.word()
            else:
                s.at = before
            if s.word().upper() == "VALUES":
                while s.take("("):
                    cells = [s.value()]
                    while s.take(","):
                        cells.append(s.value())
                    if not s.take(")"):
                        raise ValueError(f"{table}: a row is not closed")
                    yield table, dict(zip(columns or [f"c{i}" for i in range(len(cells))], cells, strict=True))
                    if not s.take(","):
                        break
            else:
                yield verb, None
        elif not verb and s.at == start:
            s.at += 1
            continue
        else:
            yield verb, None
        s.statement_end()


def _columns(s: _Scanner) -> list[str]:
    out = []
    if s.take("("):
        while not s.take(")"):
            out.append(s.name())
            s.take(",")
    return out


def _copy_cell(cell: str) -> str | None:
    if cell == "\\N":
        return None
    out, at = [], 0
    while at < len(cell):
        c = cell[at]
        if c == "\\" and at + 1 < len(cell):
            at += 1
            c = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v"}.get(cell[at], cell[at])
        out.append(c)
        at += 1
    return "".join(out)
