"""Missing values filled from similar records: a sequential hot deck in SQL.

Within each group the records are sorted; a missing cell takes the nearest observed value before or
after it (the earlier one on a tie) and records where it came from and how far. Cells still empty
go on to the next, wider grouping; only these do. Donors are reduced, before they are sorted, to one
row per group and place with the least and the largest value there, so a wide group holds no more
donors than it has places, and a place's open cells never meet in a window. Within a group the
places are cut into blocks: windows run within (group, block), and the last and first observed
values of whole blocks, one row each, carry over the borders. So a group of any size spreads over
its blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quilate.session import ensure_checkpoint_dir

def observed(c):
    """A positive finite number, else NULL."""
    c = c.cast("double")
    return F.when(c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < float("inf")), c)


def _places(donors: DataFrame, asked: DataFrame, block_span: int) -> DataFrame:
    """(``_g``, ``at``, ``donor``, ``donor_at``) of each place asked for, one row per group and place.

    Either side holds one row per group and place: the observed values, and the places of open cells.
    """
    at = donors.select("_g", "at", F.struct(F.col("most").alias("value"), "at").alias("_as_before"), F.struct(F.col("least").alias("value"), "at").alias("_as_after"), F.lit(False).alias("_asked"))
    here = asked.select("_g", "at", F.lit(None).cast(at.schema["_as_before"].dataType).alias("_as_before"), F.lit(None).cast(at.schema["_as_after"].dataType).alias("_as_after"), F.lit(True).alias("_asked"))
    rows = at.unionByName(here).withColumn("_block", F.floor(F.col("at") / block_span))
    # A place's own donors count as before it; after it come the later places only.
    inside = Window.partitionBy("_g", "_block").orderBy("at", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    # Backwards over the reverse order: a frame that runs to the end of its partition would be read anew for each row.
    back = Window.partitionBy("_g", "_block").orderBy(F.col("at").desc(), F.col("_asked").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_before", F.last("_as_before", True).over(inside)).withColumn("_after", F.last("_as_after", True).over(back))
    blocks = rows.groupBy("_g", "_block").agg(F.max_by("_as_before", F.when(~F.col("_asked"), F.col("at"))).alias("_last"), F.min_by("_as_after", F.when(~F.col("_asked"), F.col("at"))).alias("_first"))
    across = Window.partitionBy("_g").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    across_back = Window.partitionBy("_g").orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select(F.col("_g").alias("_cg"), F.col("_block").alias("_cb"), F.last("_last", True).over(across).alias("_carry_before"), F.last("_first", True).over(across_back).alias("_carry_after"))
    joined = rows.where("_asked").join(carry, F.col("_g").eqNullSafe(F.col("_cg")) & (F.col("_block") == F.col("_cb")), "left")
    before, after = F.coalesce("_before", "_carry_before"), F.coalesce("_after", "_carry_after")
    take = F.when(after.isNull() | (F.col("at") - before["at"] <= after["at"] - F.col("at")), before).otherwise(after)
    return joined.select(F.col("_g").alias("_dg"), F.col("at").alias("_dat"), take["value"].alias("donor"), take["at"].alias("donor_at")).where("donor IS NOT NULL")


def hot_deck(cells: DataFrame, groupings: list[list[str]], block_span: int = 16) -> DataFrame:
    """Cells with ``filled_value``, ``was_filled``, ``donor_distance`` and ``donor_level``.

    ``cells`` has one row per cell: key columns, ``at`` (whole number to sort by), ``obs`` (observed
    value or NULL) and ``wanted`` (whether a missing value existed and is to be filled), and the
    columns of ``groupings``, tried in order. Cells not wanted, or without any donor, stay NULL and
    unmarked. NULL group values form a group. Empty tables give empty results. ``donor_level`` is
    the place of the grouping that gave the value. Of several records at one place the largest value
    donates to its own and to later places, the least to earlier ones.
    """
    ensure_checkpoint_dir(cells.sparkSession)
    as_is = {"filled_value": F.col("obs"), "donor_distance": F.lit(None).cast("bigint"), "donor_level": F.lit(None).cast("int")}
    is_open = F.col("wanted") & F.col("obs").isNull()
    # The cells are read once for the donors and once as open cells of each level: the cut keeps their joins from running each time.
    cells = cells.checkpoint()
    done, left = [], cells.where(is_open)
    for level, cols in enumerate(groupings):
        group = F.struct(*(F.col(c) for c in cols)) if cols else F.struct(F.lit(0))
        donors = cells.where("obs IS NOT NULL").groupBy(group.alias("_g"), "at").agg(F.min("obs").alias("least"), F.max("obs").alias("most"))
        keyed = left.withColumn("_g", group)
        places = _places(donors, keyed.select("_g", "at").distinct(), block_span)
        tried = keyed.join(places, F.col("_g").eqNullSafe(F.col("_dg")) & (F.col("at") == F.col("_dat")), "left").drop("_g", "_dg", "_dat").checkpoint()
        filled = tried.where("donor IS NOT NULL").withColumns({"filled_value": F.col("donor"), "donor_distance": F.abs(F.col("at") - F.col("donor_at")).cast("bigint"), "donor_level": F.lit(level)})
        done.append(filled.select(*cells.columns, *as_is))
        left = tried.where("donor IS NULL").select(*cells.columns)
        if level + 1 < len(groupings) and left.isEmpty():
            break
    out = cells.where(~F.coalesce(is_open, F.lit(False))).withColumns(as_is)
    for part in (*done, left.withColumns(as_is)):
        out = out.unionByName(part)
    return out.withColumn("was_filled", F.col("donor_level").isNotNull())


def masked_error(cells: DataFrame, groupings: list[list[str]], one_in: int = 20, key: str = "row_id", block_span: int = 16) -> DataFrame:
    """What filling errs by: observed cells are hidden, filled, and compared with what they were.

    (``donor_level``, ``cells``, ``median_error``, ``mean_distance``): one in ``one_in`` observed
    cells, by hash of ``key``, is hidden; the error is relative to the hidden value; level -1 are
    cells without a donor. Each level is also tried alone: its groupings are those from it on.
    """
    hidden = F.col("obs").isNotNull() & (F.pmod(F.xxhash64(key), F.lit(one_in)) == 0)
    masked = cells.withColumns({"_true": F.when(hidden, F.col("obs")), "obs": F.when(~hidden, F.col("obs")), "wanted": hidden})
    parts = None
    for first in range(len(groupings)):
        got = hot_deck(masked, groupings[first : first + 1], block_span).where("_true IS NOT NULL")
        level = F.when(F.col("was_filled"), F.lit(first)).otherwise(-1)
        one = got.select(level.alias("donor_level"), F.abs(F.col("filled_value") / F.col("_true") - 1).alias("e"), "donor_distance")
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("donor_level").agg(F.count("*").alias("cells"), F.percentile_approx("e", 0.5, 10_000).alias("median_error"), F.avg("donor_distance").alias("mean_distance"))
