"""Binary text decoding and file-type routing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Encodings tried after UTF-8, and the known extensions.
LEGACY_ENCODINGS = ("cp949", "euc-kr")
EXTENSIONS = {
    "pdf": "pdf",
    "docx": "docx",
    "md": "md",
    "markdown": "md",
    "html": "html",
    "htm": "html",
    "txt": "txt",
}


_DECODED = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())]
)


@F.pandas_udf(_DECODED)
def _legacy(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    def decode(raw):
        if raw is None:
            return (None, None)
        for name in LEGACY_ENCODINGS:
            try:
                return (bytes(raw).decode(name), name)
            except UnicodeDecodeError:
                continue
        return (None, None)

    for batch in batches:
        yield pd.DataFrame([decode(raw) for raw in batch], columns=["text", "encoding"])


def decode_text(content: Column) -> Column:
    """``struct(text, encoding)``; both null when no encoding fits.

    UTF-8 is decoded inside the JVM; only bytes that are not UTF-8 travel to
    Python, the others travel as nulls.
    """
    text = F.try_validate_utf8(content.cast("string"))
    stripped = F.regexp_replace(text, "^﻿", "")
    legacy = _legacy(F.when(text.isNull(), content))
    return F.struct(
        F.coalesce(stripped, legacy["text"]).alias("text"),
        F.when(text.isNotNull(), F.when(text.startswith("﻿"), "utf-8-sig").otherwise("utf-8"))
        .otherwise(legacy["encoding"])
        .alias("encoding"),
    )


def file_type(filename: Column) -> Column:
    """Type by extension, null when it is not known."""
    ext = F.lower(F.regexp_extract(filename, r"\.([^./\\]+)$", 1))
    out = F.when(F.lit(False), F.lit(""))
    for name, kind in EXTENSIONS.items():
        out = out.when(ext == name, kind)
    return out


def routing_error(filename: Column) -> Column:
    ext = F.regexp_extract(filename, r"(\.[^./\\]+)$", 1)
    return F.when(file_type(filename).isNull(), F.concat(F.lit("Unsupported file type: "), ext))
