"""Typed identifiers resolved to a reference list by the reader of ``reference_map``, one answer for all problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quilate.operators.reference_map import map_to_reference
from quilate.session import spread

#: Accented letters and their plain forms. Fixed values.
ACCENTED, UNACCENTED = "áéíóúüñàèìòùâêîôûãõçäëïö", "aeiouunaeiouaeiouaocaeio"


def squeezed(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(c), ACCENTED, UNACCENTED), "[^a-z0-9]", "")


def with_entry(df: DataFrame, value_col: str, reference: DataFrame, entry_col: str, out: str, values: DataFrame | None = None) -> DataFrame:
    """``df`` with the entry each value means, NULL if none; exact values need no lookup.

    Each distinct value is read once. NULL and empty values mean nothing; of several entries the nearest
    counts, and a tie means nothing. ``values``: a smaller table that holds every value of ``df`` in a
    column of the same name, to take them from.
    """
    exact = reference.select(F.col(entry_col).alias("_entry")).where("_entry IS NOT NULL").distinct()
    typed = (df if values is None else values).select(value_col).where(F.col(value_col).isNotNull()).distinct().join(exact, F.col(value_col) == F.col("_entry"), "left_anti")
    meant = map_to_reference(spread(typed), value_col, reference, entry_col).where("entry IS NOT NULL").select(F.col("value").alias("_value"), F.col("entry").alias("_meant"))
    known = exact.select(F.col("_entry").alias("_value"), F.col("_entry").alias("_meant")).unionByName(meant)
    return df.join(known, F.col(value_col) == F.col("_value"), "left").withColumn(out, F.col("_meant")).drop("_value", "_meant")
