"""Sets of grid cells as bitmaps: one binary of 32,768 bits for each tile of 128 by 256 cells.

A cell has a dense number, tile after tile, so that neighbours share a bitmap. The world at a hundredth of a degree
has 142 x 141 tiles: whatever number of detections is behind it, the set of all cells ever seen is 81 MB at most, where
distinct cell keys can be 648 million rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.semantics import cell_index

HIGH, WIDE = 7, 8  # a tile's cells as powers of two
SIDE = 1 << 22  # tiles in either direction, far beyond the world: coordinates below a million degrees have a number
# Tiles of at least so many probed rows are dealt out over ``SPREAD`` keys. The list of them is bounded: tiles beyond it
# hold less than a ten-thousandth of the rows each.
HOT_ROWS, MAX_HOT, SPREAD = 500_000, 10_000, 64


def cell_number(lon: Column, lat: Column, per_degree: int = 100) -> Column:
    """Number of a cell (1 and up), consecutive within a tile; null where there is no finite coordinate."""
    x, y = cell_index(lon, per_degree), cell_index(lat, per_degree)
    tile = (F.shiftright(y, HIGH) + SIDE // 2) * SIDE + F.shiftright(x, WIDE) + SIDE // 2
    return F.shiftleft(tile, HIGH + WIDE) + F.shiftleft(y.bitwiseAND((1 << HIGH) - 1), WIDE) + x.bitwiseAND((1 << WIDE) - 1) + 1


def cell_sets(df: DataFrame, number: Column, by: list[str]) -> DataFrame:
    """``by``, ``_tile`` and ``_bits``: the cells that occur in ``df`` (null numbers left out), one row for each tile."""
    cells = df.select(*by, F.bitmap_bucket_number(number).alias("_tile"), F.bitmap_bit_position(number).alias("_bit"))
    return cells.where("_tile is not null").groupBy(*by, "_tile").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def has_bit(bits: Column, position: Column) -> Column:
    """Whether a bitmap holds a position."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.expr("shiftleft(1, cast(_bit % 8 as int))")) != 0


def outside(probe: DataFrame, number: Column, sets: DataFrame, by: list[str], hot_rows: int = HOT_ROWS, max_hot: int = MAX_HOT) -> DataFrame:
    """Rows of ``probe`` whose cell is not in ``sets`` (of :func:`cell_sets` with the same ``by``); null cells stay.

    Rows meet the bitmap of their tile. Those of a hot tile are dealt out, and its bitmap is repeated for each share.
    """
    keys = [*by, "_tile"]
    own = probe.withColumn("_tile", F.bitmap_bucket_number(number)).withColumn("_bit", F.bitmap_bit_position(number))
    hot = own.where("_tile is not null").groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") >= hot_rows)
    hot = hot.orderBy(F.desc("_rows"), *keys).limit(max_hot).select(*keys, F.lit(SPREAD).alias("_shares"))
    shared = F.coalesce("_shares", F.lit(1))
    dealt = own.join(F.broadcast(hot), keys, "left").withColumn("_share", F.monotonically_increasing_id() % shared).drop("_shares")
    repeated = sets.join(F.broadcast(hot), keys, "left").select(*keys, "_bits", F.explode(F.sequence(F.lit(0).cast("bigint"), (shared - 1).cast("bigint"))).alias("_share"))
    # rows without a tile match nothing; they are dealt out like the others
    left = dealt.withColumn("_share", F.when(F.col("_tile").isNull(), -1 - F.monotonically_increasing_id()).otherwise(F.col("_share")))
    met = left.join(repeated, [*keys, "_share"], "left")
    return met.where(~F.coalesce(has_bit(F.col("_bits"), F.col("_bit")), F.lit(False))).select(*probe.columns)
