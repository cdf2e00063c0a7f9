"""CSV source (S1-S4): header CSV → typed DataFrame, with the encoding
fallback, validation, and the load-time profile.

The file is read as text columns (no ``inferSchema`` pass of Spark's own);
pandas' default missing-value tokens become null; each column's type is then
decided from ONE aggregate that counts, per column, how many values cast to
integer / double / boolean, and the columns are cast in one projection.
"""

from __future__ import annotations

import csv as _csv
import io
import re
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.schema import col, free_name

# The text pandas' CSV reader treats as missing by default.
PANDAS_NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# The text pandas reads as booleans.
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")
# How a number is written in a CSV field (a type suffix as in
# 1D or 2F is text), and pandas' spellings of infinity.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITY = r"(?i)^\s*[+-]?inf(inity)?\s*$"
FALLBACK_ENCODING = "ISO-8859-1"


class LoaderError(ValueError):
    pass


def header_names(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> list[str]:
    """Column names exactly as written on the first line (Spark's reader
    renames repeated names, so duplicates must be checked here)."""
    first = spark.read.option("encoding", encoding).text(path).limit(1).collect()
    if not first:
        return []
    return next(_csv.reader(io.StringIO(first[0]["value"]), delimiter=sep))


def _open_field(line: Column, sep: str) -> Column:
    """The line opens a quoted field and does not close it.  A quote inside an
    unquoted field (5" pipe) opens nothing."""
    edge = re.escape(sep)
    rest = F.regexp_replace(line, f'(?:^|(?<={edge}))"(?:[^"]|"")*+"(?={edge}|\\r?$)', "")
    return rest.rlike(f'(?:^|{edge})"')


def scan_files(spark: SparkSession, path: str, sep: str = ",") -> list[tuple[str, bool, bool]]:
    """(file, every line is valid UTF-8, some quoted field spans lines) from
    one splittable pass over the raw lines (the quote byte is the same in
    UTF-8 and Latin-1)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    rows = lines.groupBy("file").agg(F.bool_and(F.is_valid_utf8("value")).alias("ok"),
                                     F.bool_or(_open_field(F.col("value"), sep)).alias("spans")).collect()
    return sorted((unquote(r["file"]), r["ok"] is not False, bool(r["spans"])) for r in rows)


def scan_text(spark: SparkSession, path: str, sep: str = ",") -> tuple[bool, bool]:
    """(every line is valid UTF-8, some quoted field spans lines), all files together."""
    files = scan_files(spark, path, sep)
    return all(ok for _, ok, _ in files), any(spans for *_, spans in files)


def is_utf8(spark: SparkSession, path: str) -> bool:
    """True when every line of the file is valid UTF-8 (one distributed check)."""
    return scan_text(spark, path)[0]


def _text_rows(spark: SparkSession, paths: str | list[str], names: list[str], bad: str, encoding: str, sep: str,
               multiline: bool) -> DataFrame:
    """All columns as text, and in ``bad`` the text of rows whose number of
    fields is not that of the header."""
    fields = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, bad])
    return (spark.read.schema(fields).option("header", True).option("sep", sep).option("encoding", encoding)
            .option("quote", '"').option("escape", '"').option("multiLine", multiline).option("enforceSchema", True)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad)
            .option("columnPruning", False).csv(paths))          # a pruned parser does not count the fields


def _surplus(text: Column, fields: int, sep: str) -> Column:
    """A row has more fields than the header (fewer are filled up with nulls)."""
    edge = re.escape(sep)
    bare = F.regexp_replace(text, f'(^|(?<={edge}))"(?:[^"]|"")*+"(?={edge}|\\r?$)', "")
    return F.coalesce(F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) >= fields * len(sep), F.lit(False))


#: Rejected rows that a load shows.
SHOWN = 20


@dataclass
class CsvRead:
    """Typed rows, the number of rejected ones (more fields than the header)
    and the text of the first few."""
    df: DataFrame
    rejected: int
    sample: list[str]


def read_csv_parts(spark: SparkSession, path: str, parts: list[tuple[str | list[str], str, bool]], sep: str = ",") -> CsvRead:
    """S1 over several (files, encoding, multi-line) reads of one table."""
    names = (spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
             .option("encoding", parts[0][1]).csv(parts[0][0]).columns)
    bad = free_name("_row", names)
    raw = None
    for paths, encoding, multiline in parts:
        part = _text_rows(spark, paths, names, bad, encoding, sep, multiline)
        raw = part if raw is None else raw.unionByName(part)
    # (Spark refuses to read the text of bad rows alone, so a column is named with it)
    over = _surplus(col(bad), len(names), sep) & (F.length(F.coalesce(col(names[0]), F.lit(""))) >= 0) if names else F.lit(False)
    text = raw.where(~over).select(*[F.when(~col(c).isin(*PANDAS_NA_TOKENS), col(c)).alias(c) for c in names])
    rejected = raw.agg(F.count(F.when(over, 1)).alias("n")).first()["n"]
    shown = [r[0] for r in raw.where(over).select(bad).limit(SHOWN).collect()] if rejected else []
    return CsvRead(infer_types(text), int(rejected), shown)


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", sep: str = ",",
             multiline: bool | None = None) -> DataFrame:
    """Header CSV with pandas-like type inference and quoting (a quote
    inside a quoted field is doubled, a backslash is plain text).  Rows with
    more fields than the header are left out (``read_csv_parts`` counts them).

    ``multiline``: whether quoted fields may hold line breaks.  A multi-line
    read cannot split a file (one task per file), so by default it is used
    only when a splittable scan finds such a field (``scan_text``)."""
    if multiline is None:
        multiline = scan_text(spark, path, sep)[1]
    return read_csv_parts(spark, path, [(path, encoding, multiline)], sep).df


def _whole(x: Column) -> Column:
    return F.when(x.rlike(NUMBER), F.trim(x).try_cast("bigint"))


def _real(x: Column) -> Column:
    number = F.when(x.rlike(NUMBER), F.trim(x).try_cast("double"))
    sign = F.when(F.trim(x).startswith("-"), -1.0).otherwise(1.0)
    return F.when(x.rlike(INFINITY), sign * F.lit(float("inf"))).otherwise(number)


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns → bigint / double / boolean / string, whichever every
    non-null value fits (all-null columns become double, as in pandas)."""
    aggs = []
    for i, c in enumerate(df.columns):
        x = col(c)
        aggs += [F.count(x).alias(f"n{i}"),
                 F.count(_whole(x)).alias(f"l{i}"), F.count(_real(x)).alias(f"d{i}"),
                 F.sum(x.isin(*(TRUE_TOKENS + FALSE_TOKENS)).cast("long")).alias(f"b{i}")]
    if not aggs:
        return df
    row = df.agg(*aggs).collect()[0]
    out = []
    for i, c in enumerate(df.columns):
        n = row[f"n{i}"]
        if n == 0:
            out.append(F.lit(None).cast("double").alias(c))
        elif row[f"l{i}"] == n:
            out.append(_whole(col(c)).alias(c))
        elif row[f"d{i}"] == n:
            out.append(_real(col(c)).alias(c))
        elif (row[f"b{i}"] or 0) == n:
            out.append(F.when(col(c).isin(*TRUE_TOKENS), True).when(col(c).isin(*FALSE_TOKENS), False).alias(c))
        else:
            out.append(col(c))
    return df.select(*out)


def validate_dataframe(spark: SparkSession, df: DataFrame, path: str, sep: str = ",",
                       encoding: str = "UTF-8") -> None:
    """At least one row and one column, no repeated header names."""
    names = header_names(spark, path, sep, encoding)
    if not df.columns or not names:
        raise LoaderError(f"no columns in {path}")
    seen, dup = set(), []
    for n in names:
        if n in seen and n not in dup:
            dup.append(n)
        seen.add(n)
    if dup:
        raise LoaderError(f"header of {path} repeats {', '.join(dup)}")
    if df.isEmpty():
        raise LoaderError(f"no rows below the header of {path}")


def _literal(path: str) -> str:
    """A file name in which no character is a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def fallback_parts(spark: SparkSession, path: str, sep: str = ",") -> list[tuple[str | list[str], str, bool]]:
    """How to read each file: as UTF-8 if its bytes are valid UTF-8, else
    as Latin-1, and multi-line only where a field spans lines.  Files that
    are alike are read together."""
    alike: dict[tuple[str, bool], list[str]] = {}
    for file, utf8, spans in scan_files(spark, path, sep):
        alike.setdefault(("UTF-8" if utf8 else FALLBACK_ENCODING, spans), []).append(_literal(file))
    if len(alike) <= 1:
        return [(path, *next(iter(alike), ("UTF-8", False)))]
    return [(files, *how) for how, files in alike.items()]


def load_csv_with_fallback_encoding(spark: SparkSession, path: str, sep: str = ",") -> tuple[DataFrame, str]:
    """The table and its encoding (``mixed`` if the files differ)."""
    parts = fallback_parts(spark, path, sep)
    return read_csv_parts(spark, path, parts, sep).df, _encoding(parts)


def _encoding(parts) -> str:
    found = {p[1] for p in parts}
    return found.pop() if len(found) == 1 else "mixed"


@dataclass
class LoadResult:
    df: DataFrame
    encoding: str
    summary: DataFrame
    dtype_report: DataFrame
    missing_report: DataFrame
    date_columns: list[str]
    rejected_rows: int = 0
    rejected_sample: list[str] = field(default_factory=list)


def load_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str | None = None, strict: bool = False) -> LoadResult:
    """S3: read (with encoding fallback) → validate → date detection →
    summary, dtype and missing reports.  Rows with more fields than the
    header are counted and shown in the result, or an error if ``strict``."""
    from tessera.operators.clean import detect_date_columns
    from tessera.operators.profile import dataset_summary, dtype_report, missing_report
    try:
        if not header_names(spark, path, sep, encoding or FALLBACK_ENCODING):
            raise LoaderError(f"no header line in {path}")
        parts = fallback_parts(spark, path, sep) if encoding is None else [(path, encoding, scan_text(spark, path, sep)[1])]
        read = read_csv_parts(spark, path, parts, sep)
    except AnalysisException as e:
        raise LoaderError(f"cannot read {path}: {e.getCondition()}") from e
    if strict and read.rejected:
        raise LoaderError(f"{read.rejected} rows of {path} have more fields than the header, first: {read.sample[0][:200]}")
    validate_dataframe(spark, read.df, path, sep, parts[0][1])
    return LoadResult(read.df, _encoding(parts), dataset_summary(read.df), dtype_report(read.df), missing_report(read.df),
                      detect_date_columns(read.df), read.rejected, read.sample)
