"""Connected parts of a network, and Ward clusters of entities, as rounds of joins.

Ward linkage is reducible: a merged cluster is never nearer to a third one than
the nearer of its halves was. Two things follow. Clusters below a cut never leave
a connected part of the pairs at most that far apart, so only pairs within parts
count. And clusters that are each other's nearest can all be merged in one round,
which gives the clusters that merging one pair at a time gives. A round is a few
shuffles of the distances between the clusters that are left; there are about as
many rounds as clusters have levels. No task holds more than a few rows of a pair.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import KEY

Stage = Callable[[DataFrame], DataFrame]


def parts(links: DataFrame, stage: Stage) -> DataFrame:
    """Of undirected links (a, b): entity and part, the least entity that can be reached from it. Entities without links don't appear."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges, before = stage(edges), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        # every neighbour above an entity is led to the least one that the entity knows of
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        led = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # then each entity and all it leads to are tied to the least of them
        least = led.groupBy("a").agg(F.min("b").alias("m"))
        tied = led.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    return edges.select(F.col("a").alias(KEY), F.col("b").alias("part")).unionByName(edges.select(F.col("b").alias(KEY), F.col("b").alias("part")).distinct())


def _halved(d: DataFrame, side: str, merged: DataFrame) -> DataFrame:
    """The distances after the clusters on this side have been merged. d: u, v, nu, nv, d2; merged: member, into, gap2 (squared distance of the two), total (their size)."""
    n, m = f"n{side}", f"n{'v' if side == 'u' else 'u'}"
    other = "v" if side == "u" else "u"
    j = d.join(merged.withColumnRenamed("member", side), side, "left")
    alone = j.where("into is null").select("u", "v", "nu", "nv", "d2")
    pair = j.where("into is not null").groupBy("into", other).agg(
        F.sum((F.col(n) + F.col(m)) * F.col("d2")).alias("s"), F.first("gap2").alias("gap2"), F.first("total").alias("total"), F.first(m).alias(m)
    )
    new = (F.col("s") - F.col(m) * F.col("gap2")) / (F.col("total") + F.col(m))
    made = pair.select(F.col("into").alias(side), other, F.col("total").alias(n), m, new.alias("d2"))
    return alone.unionByName(made)


def ward(distances: DataFrame, cut: float, stage: Stage) -> DataFrame:
    """Ward clusters of more than one entity, cut at this height: entity and cluster, its least entity.

    distances: a, b, d of pairs a < b; a pair within a connected part that is missing is at a distance of 1.
    Ties between equally near pairs go to the one with the lesser entities.
    """
    near = distances.where(F.col("d") <= cut)
    part = stage(parts(near.select("a", "b"), stage))
    a, b = part.toDF("a", "part"), part.toDF("b", "part")
    pairs = a.join(b, "part").where("a < b").select("a", "b").join(distances.select("a", "b", "d"), ["a", "b"], "left")
    d2 = F.pow(F.coalesce("d", F.lit(1.0)), F.lit(2.0))
    one = F.lit(1).cast("long")
    d = stage(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), one.alias("nu"), one.alias("nv"), d2.alias("d2")))
    label = stage(part.select(KEY, F.col(KEY).alias("cluster")))
    while True:
        rank = F.struct("d2", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), "nu", "nv")
        both = d.select(F.col("u").alias("c"), rank.alias("r")).unionByName(d.select(F.col("v").alias("c"), rank.alias("r")))
        nearest = both.groupBy("c").agg(F.min("r").alias("r"))
        # a pair that is the nearest of both its clusters is found twice
        found = nearest.groupBy("r.lo", "r.hi").agg(F.count("*").alias("n"), F.first("r").alias("r")).where("n = 2").where(F.col("r.d2") <= cut**2)
        found = stage(found.select("lo", "hi", F.col("r.d2").alias("gap2"), (F.col("r.nu") + F.col("r.nv")).alias("total")))
        if found.isEmpty():
            break
        merged = found.select(F.explode(F.array("lo", "hi")).alias("member"), F.col("lo").alias("into"), "gap2", "total")
        rest = d.join(found.select(F.col("lo").alias("u"), F.col("hi").alias("v")), ["u", "v"], "left_anti")
        # both directions, so that a cluster's rows meet on either side; one of them is kept
        turned = rest.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("nv").alias("nu"), F.col("nu").alias("nv"), "d2")
        d = stage(_halved(_halved(rest.unionByName(turned), "u", merged), "v", merged).where("u < v"))
        moved = merged.select(F.col("member").alias("cluster"), "into")
        label = stage(label.join(moved, "cluster", "left").select(KEY, F.coalesce("into", "cluster").alias("cluster")))
    several = label.groupBy("cluster").count().where("count > 1").select("cluster")
    return label.join(several, "cluster", "left_semi").select(KEY, "cluster")
