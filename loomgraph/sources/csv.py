"""CSV tables: typed load, coercion with row rejection, load summary."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.text import strip_column
from loomgraph.graph import union_all
from loomgraph.sources.text import decode_text
from loomgraph.spec import ColumnSpec, TableSpec

# Accepted words and number forms.
TRUE_WORDS = ("true", "1", "yes", "t")
FALSE_WORDS = ("false", "0", "no", "f")
INTEGER_FORM = r"^[+-]?\d+$"
FLOAT_FORM = r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$|^[+-]?(inf|infinity|nan)$"


class LoadError(ValueError):
    """Why a file cannot be loaded; ``load_all`` turns it into a row."""

    def __init__(self, path: str, reason: str) -> None:
        super().__init__(f"{path}: {reason}")
        self.path, self.reason = path, reason


def table_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".csv").lower()


def file_encodings(spark: SparkSession, path: str) -> list[str]:
    """The encodings of the files below ``path``, found on all their bytes, line by line.

    The text source hands over the bytes as they are; a line that is not UTF-8
    but fits a legacy encoding makes the file a legacy one.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    raw = F.col("value").cast("binary")
    odd = lines.where(F.try_validate_utf8(raw.cast("string")).isNull()).select(decode_text(raw)["encoding"].alias("e"))
    counted = odd.groupBy("e").count().collect()  # one row per known encoding
    return sorted((r["e"] or "unknown" for r in counted)) or ["utf-8"]


def _decoder(encoding: str):
    @F.pandas_udf(T.StringType())
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda raw: None if raw is None else bytes(raw).decode(encoding), na_action="ignore")

    return decode


def load_csv(
    spark: SparkSession, path: str, spec: TableSpec, multi_line: bool = True
) -> tuple[DataFrame, list[str]]:
    """Header CSV as text columns of the spec, and warnings.

    Quotes inside quoted fields are doubled; quoted fields may hold line breaks
    (``multi_line=False`` lets Spark split large files, but then they may not).
    Files that are not UTF-8 are read in the legacy encoding that fits.  Columns
    missing from the file are left out; coercion treats only the columns that
    are there.  Raises ``LoadError`` for files without rows, header or key.
    """
    if not path.rstrip("/").lower().endswith(".csv"):
        raise LoadError(path, "not a .csv file")
    encodings = file_encodings(spark, path)
    warnings = []
    if encodings != ["utf-8"]:
        if encodings == ["unknown"] or len(encodings) > 1:
            raise LoadError(path, f"no single known encoding: {', '.join(encodings)}")
        warnings.append(f"read as {encodings[0]}")
    legacy = None if encodings == ["utf-8"] else encodings[0]
    raw = (
        spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
        .option("encoding", "ISO-8859-1" if legacy else "UTF-8").csv(path)
    )
    if not raw.columns:
        raise LoadError(path, "empty file")
    if legacy:  # delimiters and quotes are ASCII in these encodings, so the cells can be decoded one by one
        decode = _decoder(legacy)
        raw = raw.select(
            *[decode(F.encode(F.col(f"`{c}`"), "ISO-8859-1")).alias(c.encode("latin-1").decode(legacy)) for c in raw.columns]
        )
    raw = raw.withColumnsRenamed({c: c.removeprefix("\ufeff") for c in raw.columns})
    if raw.isEmpty():
        raise LoadError(path, "header without rows")
    missing = [c.name for c in spec.columns if not c.nullable and c.name not in {n.strip() for n in raw.columns}]
    if missing:
        raise LoadError(path, f"missing required column(s): {', '.join(missing)}")
    known = [c for c in raw.columns if spec.column(c.strip()) is not None]
    unknown = [c for c in raw.columns if c not in known]
    if not known:
        raise LoadError(path, f"no column of table '{spec.name}'")
    warnings += [f"column '{c}' is not part of table '{spec.name}' and is ignored" for c in unknown]
    return raw.select(*[F.col(f"`{c}`").alias(spec.column(c.strip()).name) for c in known]), warnings


def _converted(text: Column, kind: str) -> Column:
    if kind == "integer":
        return F.when(text.rlike(INTEGER_FORM), text.try_cast("bigint"))
    if kind == "float":
        return F.when(text.rlike(FLOAT_FORM), text.try_cast("double"))
    if kind == "boolean":
        low = F.lower(text)
        return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)
    if kind == "date":
        return text.try_cast(T.DateType())
    if kind == "timestamp":
        return text.try_cast(T.TimestampType())
    return text


def _cell(column: ColumnSpec, text: Column) -> tuple[Column, Column, Column | None]:
    """(value, error message or null, whether there is an error) of one trimmed text cell; no flag if there cannot be one."""
    empty = (text == "") | (F.upper(text) == "NULL")
    converted = _converted(text, column.kind)
    value = F.when(~empty, converted)
    problem = F.when(
        empty, F.lit(None if column.nullable else "empty value for non-nullable column")
    ).when(value.isNull(), F.concat(F.lit("cannot convert '"), text, F.lit(f"' to {column.kind}")))
    flags = []
    if not column.nullable:
        flags.append(empty)
    if converted is not text:
        flags.append(~empty & converted.isNull())
    return value, problem, reduce(Column.__or__, flags) if flags else None


def coerce(df: DataFrame, spec: TableSpec) -> tuple[DataFrame, DataFrame]:
    """Typed good rows, and one row per bad cell of the rejected ones.

    One bad cell rejects its row.  Rows are told apart by flags alone; messages
    are worded for rejected rows only.  Both results come from the same
    projection; persist ``df`` if both are consumed and the scan is expensive.
    """
    present = [c for c in spec.columns if c.name in df.columns]
    values, problems, flags = [], [], []
    for i, column in enumerate(present):
        value, problem, flag = _cell(column, F.col(f"_text{i}"))
        values.append(value.alias(column.name))
        problems.append(
            F.when(problem.isNotNull(), F.struct(F.lit(column.name).alias("column"), problem.alias("message")))
        )
        if flag is not None:
            flags.append(flag)
    # generated columns: a filter on plain ones would be carried out on the expressions behind them, once for every use
    texts = [F.coalesce(strip_column(c.name), F.lit("")).alias(f"_text{i}") for i, c in enumerate(present)]
    trimmed = df.select(*[c.name for c in present], F.inline(F.array(F.struct(*texts)))) if present else df
    rejected = reduce(Column.__or__, flags) if flags else F.lit(False)
    raw = F.to_json(F.struct(*[F.col(c.name) for c in present])).alias("row")
    good = trimmed.where(~rejected).select(*values)
    bad = trimmed.where(rejected).select(
        F.lit(spec.name).alias("table"), raw, F.explode(F.array_compact(F.array(*problems))).alias("p")
    )
    return good, bad.select("table", "row", "p.column", "p.message")


def load_all(
    spark: SparkSession, paths: Sequence[str], specs: Sequence[TableSpec]
) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables that can be read, and one row (file, table, message) per warning or error."""
    by_name = {s.name.lower(): s for s in specs}
    loaded: dict[str, DataFrame] = {}
    notes: list[tuple[str, str, str, str]] = []
    for path in paths:
        name = table_name(path)
        try:
            if name not in by_name:
                raise LoadError(path, "no declared table has this name")
            if name in loaded:
                raise LoadError(path, "table given twice")
            loaded[name], warnings = load_csv(spark, path, by_name[name])
            notes += [(path, name, "warning", w) for w in warnings]
        except LoadError as problem:
            notes.append((path, name, "error", problem.reason))
    return loaded, spark.createDataFrame(notes, "file string, table string, level string, message string")


def load_summary(
    loaded: Mapping[str, DataFrame],
    specs: Sequence[TableSpec],
    warnings: Mapping[str, Sequence[str]] | None = None,
    uploads: Sequence[str] = (),
) -> DataFrame:
    """Per declared table: row count, columns, warnings; tables without data say so.

    ``uploads`` are the given file names: a table given twice is an error.
    """
    twice = [name for name, n in Counter(map(table_name, uploads)).items() if n > 1]
    if twice:
        raise ValueError(f"duplicate files for table(s): {', '.join(sorted(twice))}")
    spark = next(iter(loaded.values())).sparkSession
    rows = [
        (
            s.name,
            ",".join(loaded[s.name].columns) if s.name in loaded else "",
            "; ".join((warnings or {}).get(s.name, []))
            or ("" if s.name in loaded else f"No CSV for table '{s.name}'"),
        )
        for s in specs
    ]
    declared = spark.createDataFrame(rows, "table string, columns string, warnings string")
    counted = union_all([df.select(F.lit(name).alias("table")) for name, df in loaded.items()]).groupBy("table").agg(
        F.count(F.lit(1)).alias("row_count")
    )
    return declared.join(counted, "table", "left").select(
        "table", F.coalesce("row_count", F.lit(0)).alias("row_count"), "columns", "warnings"
    )
