"""Checks that run before any job starts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def require_columns(df: DataFrame, names: Iterable[str], what: str = "input") -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks column(s) {missing}; found {df.columns}")
