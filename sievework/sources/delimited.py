"""Delimited text. Every column is text; types are proposed by profiles and applied by recipes or conventions.

The first bytes of a file are looked at through Spark's own reader, so that any store works; the file itself is read in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import readable_headers
from ..functions.order import quoted
from ..functions.text import windows_1252

SAMPLE_BYTES, SAMPLE_RECORDS = 64 << 10, 24
SEPARATORS = [",", ";", "\t", "|"]
#: A private-use character that stands for a quoted empty text while reading; Spark reads both that and an empty cell as null otherwise.
EMPTY = "\ue000"


def head(spark: SparkSession, path: str, size: int = SAMPLE_BYTES) -> bytes:
    """The first bytes of a file, or of the first file in a folder, from whatever store the path names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    status = fs.getFileStatus(at)
    if status.isDirectory():
        files = sorted((f.getPath().toString() for f in fs.listStatus(at) if f.isFile() and not f.getPath().getName().startswith(("_", "."))))
        if not files:
            raise ValueError(f"no files in {path}")
        at = jvm.org.apache.hadoop.fs.Path(files[0])
    stream = fs.open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    finally:
        stream.close()


def records(text: str, separator: str, limit: int = SAMPLE_RECORDS) -> list[list[str]]:
    """The first records, with quotes."""
    out, row, cell, quoted_, i = [], [], [], False, 0
    while i < len(text) and len(out) < limit:
        c = text[i]
        if quoted_:
            if c == '"' and text[i + 1 : i + 2] == '"':
                cell.append('"')
                i += 1
            elif c == '"':
                quoted_ = False
            else:
                cell.append(c)
        elif c == '"' and not cell:
            quoted_ = True
        elif c == separator:
            row.append("".join(cell))
            cell = []
        elif c in "\r\n":
            if c == "\r" and text[i + 1 : i + 2] == "\n":
                i += 1
            if row or cell:
                out.append([*row, "".join(cell)])
            row, cell = [], []
        else:
            cell.append(c)
        i += 1
    if (row or cell) and len(out) < limit:
        out.append([*row, "".join(cell)])
    return out


def detect_separator(text: str, name: str = "") -> str:
    """Tab for .tsv; else the separator with which all records of the sample have the same number of fields, two or more, most of them; else with which 80 % have; else a comma."""
    if name.lower().endswith(".tsv"):
        return "\t"
    for share in (1.0, 0.8):
        best = (1, None)
        for s in SEPARATORS:
            sizes = [len(r) for r in records(text, s)]
            if not sizes:
                continue
            usual = max(set(sizes), key=lambda n: (sizes.count(n), n))
            if usual > best[0] and sizes.count(usual) >= share * len(sizes):
                best = (usual, s)
        if best[1]:
            return best[1]
    return ","


def line_separator(text: str) -> str | None:
    """'\\r' for files that end lines so, else None."""
    return "\r" if "\r" in text and "\n" not in text else None


def detect_encoding(data: bytes) -> str:
    """utf-8 or windows-1252; UTF-16 is refused."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        raise ValueError("UTF-16 isn't supported; save the file as UTF-8")
    try:
        data.decode("utf-8")
    except UnicodeDecodeError as e:
        if len(data) < SAMPLE_BYTES or e.start < len(data) - 4:  # a sample may end within a character
            return "windows-1252"
    return "utf-8"


def read_delimited(spark: SparkSession, path: str, separator: str | None = None, header: bool = True, encoding: str | None = None, multiline: bool | None = None) -> DataFrame:
    """All columns as text; a quoted empty cell is '', an empty one null. Files are split and read in parallel, unless a cell of the first bytes has a line end in quotes; multiline=True says that
    later cells may have one, and makes a file one task."""
    data = head(spark, path)
    if not data:
        raise ValueError("the file is empty")
    encoding = encoding or detect_encoding(data)
    text = data.decode("utf-8" if encoding == "utf-8" else "cp1252", errors="replace").removeprefix("\ufeff")
    separator = separator or detect_separator(text, path)
    first = records(text, separator, 1)
    if multiline is None:
        multiline = any("\n" in cell or "\r" in cell for r in records(text, separator, len(text)) for cell in r)
    names = readable_headers(first[0] if header else [None] * len(first[0]))
    reader = spark.read.option("sep", separator).option("header", header).option("quote", '"').option("escape", '"').option("emptyValue", EMPTY).option("encoding", "utf-8" if encoding == "utf-8" else "iso-8859-1").option("multiLine", multiline).option("mode", "PERMISSIVE")
    if line := line_separator(text):
        reader = reader.option("lineSep", line)
    schema = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    df = reader.schema(schema).option("enforceSchema", True).csv(path)
    value = quoted
    if encoding != "utf-8":  # Spark reads no Windows-1252: Latin-1, and then the 27 signs that differ
        signs, codes = windows_1252()
        value = lambda n: F.translate(quoted(n), codes, signs)
    return df.select(*[F.when(quoted(n) == EMPTY, "").otherwise(value(n)).alias(n) for n in names])


def preview_headers(spark: SparkSession, path: str, separator: str | None = None) -> dict[str, list[str]]:
    """Names with the first row as header, and without."""
    data = head(spark, path)
    text = data.decode("utf-8" if detect_encoding(data) == "utf-8" else "cp1252", errors="replace").removeprefix("\ufeff")
    first = records(text, separator or detect_separator(text, path), 1)[0]
    return {"header": readable_headers(first), "generated": readable_headers([None] * len(first))}
