"""Connected components of a link table, by minimum labels and pointer jumping; nothing is collected."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rectpart.operators.scan import Scratch


def release(frame: DataFrame) -> None:
    """Lets Spark's cleaner drop the shuffle files of steps before a saved table, which nothing reads any more. Spark does so by itself when the driver collects its garbage."""
    gc.collect()
    frame.sparkSession.sparkContext._jvm.System.gc()


def components(links: DataFrame, scratch: Scratch, name: str, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node reachable, for every node of the links; a table of `scratch`. Repeated links and loops do no harm; no links give no rows.

    Each round is a join on edges and one on labels, both without an aggregate above them in their stage, so that Spark may split a hub's rows.
    """
    edges = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    edges = scratch.save(edges.unionAll(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), f"{name}_edges")
    label, turn = scratch.save(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("x")).alias("component")), f"{name}_0"), 0
    while True:
        of = label.select(F.col("node").alias("y"), F.col("component").alias("c"))
        near = edges.join(of, "y").groupBy(F.col("x").alias("node")).agg(F.min("c").alias("near"))
        step = label.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        jump = label.select(F.col("node").alias("low"), F.col("component").alias("lower"))
        turn += 1
        step = scratch.save(step.join(jump, "low").select("node", "component", F.least("low", "lower").alias("next")), f"{name}_{turn}")
        scratch.drop(f"{name}_{turn - 1}")
        label = step.select("node", F.col("next").alias("component"))
        if step.filter("next < component").isEmpty():
            scratch.drop(f"{name}_edges")
            return label
