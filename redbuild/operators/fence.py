"""Keeps filters from being pushed into costly expressions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fence(rows: DataFrame, *computed: str) -> DataFrame:
    """Passes the computed columns through a one-row generator.

    A filter on a computed column is otherwise rewritten in terms of the
    column's expression and pushed below it: hundreds of regexes would run in
    the filter and once more for what it lets through.
    """
    kept = [c for c in rows.columns if c not in computed]
    return rows.select(*kept, F.inline(F.array(F.struct(*computed))))
