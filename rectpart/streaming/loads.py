"""Tile loads of a stream of coordinates: the same cuts as in batch, kept up to date with each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rectpart.functions.parts import part_of
from rectpart.model import Cuts


def streaming_tile_loads(stream: DataFrame, p: Cuts, q: Cuts, time_col: str | None = None, window: str | None = None, late: str = "1 hour") -> DataFrame:
    """(u, v, load), and per time window if a time column is given; rows later than `late` are left out by the watermark. State: a row a tile (and window)."""
    keyed = stream.withColumns({"u": part_of("i", p), "v": part_of("j", q)})
    keys = ["u", "v"]
    if time_col and window:
        keyed = keyed.withWatermark(time_col, late)
        keys = [F.window(time_col, window).alias("window"), "u", "v"]
    return keyed.groupBy(*keys).agg(F.sum("v_load" if "v_load" in stream.columns else F.lit(1)).alias("load"))
