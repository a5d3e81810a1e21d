"""Rows from the file formats of the engine's inputs: text lines in, typed rows out.

Each parser takes a DataFrame with a column `line` (spark.read.text gives one), so a
file, a directory or a stream of files goes through the same code.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MINUTE = 60_000_000


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """line and file of each text line under a path."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("file"))


def parsed(rows: DataFrame, n: int, sep: str = ",") -> DataFrame:
    """rows with _f, the first n fields of the line, and _n, how many it has; quoted fields may hold separators and doubled quotes."""
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    whole = F.from_csv("line", ", ".join(f"_{i} string" for i in range(n)), options)
    return rows.withColumns({"_f": whole, "_n": F.size(F.split(F.regexp_replace("line", '"[^"]*"', ""), re.escape(sep), -1))})


def field(i: int) -> Column:
    """A field of a parsed line: trimmed, empty where nothing stands, null where the line is too short."""
    return F.when(F.col("_n") > i, F.trim(F.coalesce(F.col(f"_f._{i}"), F.lit(""))))


def safe_float(x: Column) -> Column:
    """A double; null if it is none or is larger than 1e14."""
    value = x.try_cast("double")
    return F.when(F.abs(value) <= 1e14, value)


def safe_int(x: Column) -> Column:
    """A whole number written as one; 3.0 is none."""
    return F.when(F.trim(x).rlike("^[+-]?[0-9]+$"), F.trim(x).try_cast("bigint"))


def micros(t: Column) -> Column:
    """Epoch microseconds from milliseconds or microseconds, told apart by size; other sizes are an error."""
    return F.when(t.between(10**12, 10**13 - 1), t * 1000).when(t.between(10**15, 10**16 - 1), t).otherwise(F.raise_error(F.concat(F.lit("time is neither ms nor us: "), t)).cast("bigint"))


def klines(rows: DataFrame) -> DataFrame:
    """Minute bars from 12-column lines; header lines, whose first field is no number, are left out."""
    rows = parsed(rows, 12).withColumn("_t", field(0).try_cast("bigint")).where("_t is not null").withColumn("open_time", micros(F.col("_t")))
    names = {"open": 1, "high": 2, "low": 3, "close": 4, "volume": 5, "taker": 9}
    return rows.select("open_time", *[field(i).try_cast("double").alias(n) for n, i in names.items()], (F.col("open_time") + MINUTE).alias("t_close"), *[c for c in ("file",) if c in rows.columns])


def kline_range(rows: DataFrame) -> DataFrame:
    """Bars of several files, each open time once: from the first file by name."""
    first = F.row_number().over(Window.partitionBy("open_time").orderBy("file", "close"))
    return klines(rows).withColumn("_n", first).where("_n = 1").drop("_n")


def credit(rows: DataFrame, header: list[str], wanted: dict[str, tuple[str, int]], least: int = 4) -> DataFrame:
    """Typed credit rows: a wanted column is found by name in the header, else by position; short lines are left out."""
    at = {out: header.index(name) if name in header else place for out, (name, place) in wanted.items()}
    return parsed(rows, max(at.values()) + 1).where(F.col("_n") >= least).select(*[field(i).alias(out) for out, i in at.items()])


def products(rows: DataFrame, summary: int = 500) -> DataFrame:
    """Products: code, name, rate, joinable (Y) and a summary cut to its field's length."""
    return parsed(rows, 5).select(field(0).alias("code"), field(1).alias("name"), safe_float(field(2)).alias("rate"), (F.upper(field(3)) == "Y").alias("joinable"), F.substring(field(4), 1, summary).alias("summary"))


#: Header names that trade lists use for each column.
TRADE_ALIASES = {"kind": ("type", "trade type"), "time": ("date/time", "date"), "profit": ("profit %", "p&l %", "profit percent")}


def trades(rows: DataFrame, header: str) -> DataFrame:
    """Exit rows of a trade list: kind, time and profit as a share; the header may start with a byte order mark."""
    names = [h.strip().lower() for h in next(csv.reader([header.lstrip("\ufeff")]))]
    at = {k: next(names.index(a) for a in aliases if a in names) for k, aliases in TRADE_ALIASES.items()}
    profit = F.regexp_replace(field(at["profit"]), "[%\\s]", "").try_cast("double") / 100
    kind, at_time = field(at["kind"]), field(at["time"])
    return parsed(rows, len(names)).where(F.lower(kind).startswith("exit")).select(kind.alias("kind"), at_time.alias("time"), profit.alias("profit"))


def candle_arrays(rows: DataFrame) -> DataFrame:
    """Bars from parallel arrays, zipped by position; missing ends are null and bars without close are left out."""
    names = ("time", "open", "high", "low", "close", "volume")
    zipped = rows.select("symbol", F.explode(F.arrays_zip(*names)).alias("b"))
    return zipped.select("symbol", *[F.col(f"b.{n}").alias(n) for n in names]).where("close is not null")


def markdown_text(text: Column) -> Column:
    """Markdown without code, headings' marks, link targets and emphasis."""
    for pattern, new in ((r"(?s)```.*?```", " "), (r"`[^`]*`", " "), (r"(?m)^#+[ \t]*", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"[*_]{1,3}([^*_]+)[*_]{1,3}", "$1"), (r"[ \t]+", " ")):
        text = F.regexp_replace(text, pattern, new)
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def page_text(html: Column) -> Column:
    """Text of a page without scripts, styles, menus, headers and footers; white space single, references of marks decoded."""
    text = F.regexp_replace(html, r"(?is)<(script|style|nav|footer|header)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescaped(text), r"\s+", " "))


#: Character references of marks; the one of the ampersand comes last, so that nothing is decoded twice.
REFERENCES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "reg": "®", "hellip": "…", "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "middot": "·", "euro": "€"}


def unescaped(text: Column) -> Column:
    """Text with its character references decoded: numbers, and the names of REFERENCES."""
    parts = F.split(text, r"&#(?=[0-9]{1,7};|[xX][0-9a-fA-F]{1,6};)")
    digits = lambda p: F.regexp_extract(p, r"^([xX]?[0-9a-fA-F]+);", 1)
    value = lambda p: F.when(F.lower(digits(p)).startswith("x"), F.conv(F.substring(digits(p), 2, 6), 16, 10).cast("int")).otherwise(digits(p).try_cast("int"))
    symbol = lambda p: F.coalesce(F.decode(F.unhex(F.lpad(F.hex(value(p)), 8, "0")), "UTF-32"), F.lit(""))
    known = lambda p: value(p).between(1, 0x10FFFF) & ~value(p).between(0xD800, 0xDFFF)
    after = lambda p: F.regexp_replace(p, r"^[xX]?[0-9a-fA-F]+;", "")
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.when(known(p), symbol(p)).otherwise(F.lit("\ufffd")), after(p)))
    text = F.concat(parts[0], F.array_join(rest, ""))
    for name, mark in REFERENCES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(mark))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


#: Kinds of documents by extension.
PARSERS = {".pdf": "pdf", ".pptx": "slides", ".docx": "document", ".xlsx": "sheet", ".md": "text", ".txt": "text"}


def parser_of(path: Column, strict: bool = True) -> Column:
    """The parser for a path's extension; an unknown one is an error, or null if not strict."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in PARSERS.items() for x in kv]), suffix)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no parser for "), path)).cast("string")) if strict else found


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Text of files' bytes: UTF-8, or where they are none the Korean code page 949."""

    def one(body: bytes | None) -> str | None:
        if body is None:
            return None
        try:
            return bytes(body).decode("utf-8")
        except UnicodeDecodeError:
            return bytes(body).decode("cp949", errors="replace")

    return content.map(one)


_PARTS = {"docx": r"word/document\.xml", "pptx": r"ppt/slides/slide(\d+)\.xml", "xlsx": r"xl/worksheets/sheet(\d+)\.xml"}
#: Bytes of one part of an office file that are read; a larger part is an error of that file, not of the job.
MOST_PART = 256 << 20


def _office(kind: str, body: bytes) -> Iterator[tuple[int, str]]:
    """(number, text) of each slide or sheet, or of the one document, of a zipped office file."""

    def local(element) -> str:
        return element.tag.rsplit("}", 1)[-1]

    def text(element) -> str:
        return "".join(e.text or "" for e in element.iter() if local(e) == "t").strip()

    with zipfile.ZipFile(io.BytesIO(body)) as archive:
        sizes = {i.filename: i.file_size for i in archive.infolist()}

        def part(name: str):
            if sizes[name] > MOST_PART:
                raise ValueError(f"{name} is too large")
            return ElementTree.fromstring(archive.read(name))

        shared = [text(e) for e in part("xl/sharedStrings.xml")] if kind == "xlsx" and "xl/sharedStrings.xml" in sizes else []
        found = sorted((int((m.groups() or ("1",))[0]), n) for n in sizes if (m := re.fullmatch(_PARTS[kind], n)))
        for number, name in found:
            root, lines = part(name), []
            if kind == "pptx":
                lines = [text(e) for e in root.iter() if local(e) == "p"]
            elif kind == "docx":
                tables = [e for e in root.iter() if local(e) == "tbl"]
                inside = {id(p) for t in tables for p in t.iter()}
                lines = [text(e) for e in root.iter() if local(e) == "p" and id(e) not in inside]
                lines += [" | ".join(filter(None, (text(x) for x in row if local(x) == "tc"))) for t in tables for row in t.iter() if local(row) == "tr"]
            else:
                for row in (e for e in root.iter() if local(e) == "row"):
                    cells = []
                    for cell in row:
                        value = next((e.text or "" for e in cell if local(e) == "v"), "")
                        cells.append(shared[int(value)] if cell.get("t") == "s" and value else value.strip() or text(cell))
                    lines.append(" | ".join(filter(None, cells)))
            joined = "\n".join(filter(None, lines))
            if joined:
                yield number, joined


def office_texts(files: DataFrame) -> DataFrame:
    """path, part, text and error of the slides, sheets or document of each binaryFile row, by its extension.

    Paragraphs and rows are lines, cells are joined by bars. Files of other kinds give no rows;
    one that can't be read gives one row with its error, and the job goes on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, body in zip(rows["path"], rows["content"], strict=True):
                try:
                    out += [(path, n, t, None) for n, t in _office(path.rsplit(".", 1)[-1].lower(), bytes(body))]
                except (zipfile.BadZipFile, ElementTree.ParseError, ValueError, KeyError, IndexError, NotImplementedError) as e:
                    out.append((path, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(out, columns=["path", "part", "text", "error"]).astype({"part": "Int32"})

    office = files.where(F.col("path").rlike(r"(?i)\.(docx|pptx|xlsx)$") & F.col("content").isNotNull()).select("path", "content")
    return office.mapInPandas(run, "path string, part int, text string, error string")


def verified(files: DataFrame, sums: DataFrame) -> DataFrame:
    """binaryFile rows with ok: whether the content's SHA-256 is the one listed for its path."""
    return files.join(sums, "path", "left").withColumn("ok", F.coalesce(F.sha2("content", 256) == F.col("sha256"), F.lit(False)))
