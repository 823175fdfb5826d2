"""Keep spreadsheet programs from running cells and headers as formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableinsight.functions.columns import text_columns
from tableinsight.names import col, unique

# Leading characters a spreadsheet takes for a formula, and the text marker.
FORMULA_PREFIXES = ("=", "+", "-", "@", "\t", "\r")
TEXT_MARKER = "'"


def neutral_text(value: Column) -> Column:
    risky = F.substring(value, 1, 1).isin(*FORMULA_PREFIXES)
    return F.when(risky, F.concat(F.lit(TEXT_MARKER), value)).otherwise(value)


def neutral_header(name: str) -> str:
    return TEXT_MARKER + name if name.startswith(FORMULA_PREFIXES) else name


def neutralize_formulas(df: DataFrame) -> DataFrame:
    text = set(text_columns(df))
    headers = unique(neutral_header(c) for c in df.columns)
    cells = [
        (neutral_text(col(c)) if c in text else col(c)).alias(h)
        for c, h in zip(df.columns, headers)
    ]
    return df.select(*cells)
