"""Clean form of three-part table names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_name(name: Column | str) -> Column:
    """Lower case, without back-ticks and without blanks, tabs and line ends around it; NULL for a blank name."""
    c = F.col(name) if isinstance(name, str) else name
    return F.nullif(F.lower(F.btrim(F.translate(c, "`", ""), F.lit(" \t\r\n"))), F.lit(""))
