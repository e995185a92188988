"""Whole rows, whatever their columns are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def quoted(name: str) -> str:
    """A column's name as a reference to it, dots and backquotes in it notwithstanding."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(docs: DataFrame) -> Column:
    """A struct of all columns of ``docs``; ``select("_row.*")`` gives them back."""
    return F.struct(*map(quoted, docs.columns))


def all_columns(docs: DataFrame) -> list[Column]:
    """All columns of ``docs``, to be selected after others have been joined to it."""
    return [F.col(quoted(c)) for c in docs.columns]
