"""Where chains of single successors end, by path doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.scratch import cut


def follow(steps: DataFrame) -> DataFrame:
    """``node, end, hops, least, looped`` for a table ``node, next`` with one row a node.

    ``end`` is the first node on the way that has no successor and ``hops`` how far it is. A way
    that never ends is ``looped``: its ``end`` is then a member of the cycle it runs into, and
    ``least`` the smallest member of that cycle (of other ways, of all nodes met). Each round joins
    a node to its successor's successor, so the rounds grow with the logarithm of the longest way,
    and at the latest end when that many hops are more than there are nodes. A node that very many
    lead to has one row on the join's other side, so adaptive execution can split it. Null
    successors end a way before them; rows that repeat a node are an error of the caller.
    """
    rows = cut(steps.where("next IS NOT NULL").select("node", F.col("next").alias("end"), F.lit(1).cast("bigint").alias("hops"), F.least("node", "next").alias("least")))
    nodes, reach = rows.count(), 1
    while True:
        more = rows.select(F.col("node").alias("end"), F.col("end").alias("further"), F.col("hops").alias("more"), F.col("least").alias("below"))
        goes_on = F.col("further").isNotNull()
        if reach > nodes:
            met = rows.join(more, "end", "left")
            return cut(met.select("node", "end", "hops", F.when(goes_on, F.col("below")).otherwise(F.col("least")).alias("least"), goes_on.alias("looped")))
        met = rows.join(more, "end", "left")
        stepped = cut(met.select("node", F.coalesce("further", "end").alias("end"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.when(goes_on, F.least("least", "below")).otherwise(F.col("least")).alias("least"), goes_on.alias("moved")))
        reach *= 2
        if stepped.where("moved").isEmpty():
            return stepped.select("node", "end", "hops", "least", F.lit(False).alias("looped"))
        rows = stepped.drop("moved")
