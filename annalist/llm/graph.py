"""Connected components over edge tables, with nothing on the driver but counters; joins on hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.session import discard, materialize

MOST_ROUNDS = 60


def spread(rows: DataFrame, values: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` with the one row that an aggregate ``values`` has for their key, where single keys may hold a large share.

    Spark would shuffle the aggregate and the rows together and end both in one
    stage, in which a hot key is one task that nothing can split. Here the
    aggregate's key is an expression, so both sides have an exchange of their
    own before the join, and adaptive execution splits the partition of a hot
    key over many tasks.
    """
    hidden = values.withColumn("_spread_key", F.element_at(F.array(F.col(key)), 1)).drop(key)
    return rows.join(hidden, F.col(key) == F.col("_spread_key"), how).drop("_spread_key")


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``u, v`` to ``node, component``: the least node that each node reaches.

    Rounds of large star and small star (Kiveris and others, 2014): every node
    links its larger neighbours, then its smaller ones, to the least. Minima
    are combined before they are shuffled, and the joins with them are split
    where a node has many edges (``spread``); a round's edges are written to
    the shared folder and number no more than the first's. The rounds end when
    the edges stay as they are, then each is a node with its component.

    Defined results: edges with a null end or of a node with itself count for
    nothing, and such a node is in no row; repeated edges count once; no edges
    give no rows; other columns are ignored.
    """
    now = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name
    )
    state = None
    for _ in range(MOST_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: each larger neighbour of u to the least of u and its neighbours
        large = spread(now.select(F.col("v").alias("u"), F.col("u").alias("v")), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each smaller neighbour of u, and u, to the least smaller neighbour
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = spread(large, small, "u")
        before, now = now, materialize(
            linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small.select("u", F.col("m").alias("v"))).distinct(), name
        )
        discard(before)
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
