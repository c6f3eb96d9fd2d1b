"""Column names with any characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote_name(name: str) -> str:
    """A name as Spark reads it back: dots stay, inner backticks are doubled."""
    return "`" + name.replace("`", "``") + "`"


def named(name: str) -> Column:
    """The column of exactly this name."""
    return F.col(quote_name(name))
