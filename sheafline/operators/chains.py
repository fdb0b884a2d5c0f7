"""Parent chains: roots, depths and inherited properties by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.operators.rounds import looked_up, stages


def parent_chains(nodes: DataFrame) -> DataFrame:
    """``id, root, depth, props, error_code`` of each node of ``id, parent, props``.

    Ids are unique.  ``props`` is a map; a node has its own entries and of each other
    key the entry of its nearest ancestor that has it.  A parent that is not a node
    ends the chain like a null one.  On a chain that comes to a cycle there is no
    root and no depth, the error code is ``malformed``, and the entries are those
    found before a node would be met again.

    Every round a node takes over the pointer and the entries of the node that it
    points to, which doubles how far it has looked: the rounds are the logarithm of
    the longest chain.  Nodes that many others point to are looked up by several
    tasks.
    """
    spark = nodes.sparkSession
    with stages(spark) as stage:
        known = nodes.select("id", F.col("parent").alias("to"), F.map_filter("props", lambda k, v: v.isNotNull()).alias("props"))
        ids = known.select(F.col("id").alias("to"), F.lit(True).alias("is_node"))
        start = looked_up(stage(known), ids, "to", "id")
        to = F.when(F.col("is_node"), F.col("to"))
        now = stage(start.select("id", to.alias("to"), F.when(to.isNull(), F.col("id")).alias("root"), F.when(to.isNull(), 0).otherwise(1).cast("long").alias("depth"), "props"))
        reach, before = 1, None
        while n := now.where("to is not null").count():
            if before is not None and reach > 2 * before:
                break  # what is open goes in circles: an open chain to a root has at most reach / 2 + before nodes
            ahead = now.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("root").alias("top"), F.col("depth").alias("more"), F.col("props").alias("theirs"))
            jumped = looked_up(now.where("to is not null"), ahead, "to", "id")
            nearest = F.coalesce(F.map_concat("props", F.map_filter("theirs", lambda k, v: ~F.coalesce(F.map_contains_key("props", k), F.lit(False)))), "props", "theirs")
            after = jumped.select("id", F.col("next").alias("to"), F.col("top").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), nearest.alias("props"))
            now = stage(now.where("to is null").unionByName(after))
            reach, before = 2 * reach, n
        cyclic = F.col("to").isNotNull()
        return stage(now.select("id", "root", F.when(~cyclic, F.col("depth")).alias("depth"), "props", F.when(cyclic, "malformed").alias("error_code")), keep=True)
