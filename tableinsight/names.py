"""Names that come from untrusted headers and file paths."""

from __future__ import annotations

import re
from collections.abc import Iterable
from pathlib import PurePosixPath
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNSAFE = re.compile(r"[^A-Za-z0-9_]")
JOINED_NAME_LENGTH = 63


def quote(name: str) -> str:
    """Back-quote an identifier so dots, quotes and SQL text inside it stay plain text."""
    return "`" + str(name).replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quote(name))


def stem(path: str) -> str:
    return PurePosixPath(str(path).replace("\\", "/")).stem


def readable_path(uri: str) -> str:
    """A path as readers take it, from the percent-encoded one in file metadata."""
    return unquote(uri)


def table_name(path: str) -> str:
    return _UNSAFE.sub("_", stem(path))


def unique(names: Iterable[str]) -> list[str]:
    """Suffix ``_2``, ``_3`` … where a name repeats; Spark resolves names case-insensitively."""
    taken: set[str] = set()
    result = []
    for name in names:
        candidate, i = name, 2
        while candidate.lower() in taken:
            candidate, i = f"{name}_{i}", i + 1
        taken.add(candidate.lower())
        result.append(candidate)
    return result


def strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*unique(c.strip() for c in df.columns))
