"""Hierarchies of any depth as edge lists: child, parent, one row a node; a root has a null parent or no row of its own.

Ancestors come by pointer doubling: after k rounds every node knows its ancestors up to 2^k steps away and the one at
exactly that distance, so a forest of depth D takes log2(D) rounds of one join each, whatever its shape, and no node's
subtree is gathered. Depths and cycles need the pointers alone, one row a node.

Rows with a null child count for nothing, repeated edges once. A node with several parents is an error, listed by
`conflicts`. `cycles` lists the nodes on cycles, where `ancestors` is an error and `depths` gives null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scans import places
from ..sources.scratch import discard, stored


def edges_of(edges: DataFrame) -> DataFrame:
    """child, parent as strings: the distinct proper edges."""
    return edges.select(F.col("child").cast("string").alias("child"), F.col("parent").cast("string").alias("parent")).where("child is not null and parent is not null").distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    """node: every key of the edge list."""
    both = edges.select(F.explode(F.array(F.col("child").cast("string"), F.col("parent").cast("string"))).alias("node"))
    return both.where("node is not null").distinct()


def roots(edges: DataFrame) -> DataFrame:
    """node: the keys without a parent."""
    return meet(nodes_of(edges), edges_of(edges).select(F.col("child").alias("node")), "node", "left_anti")


def conflicts(edges: DataFrame) -> DataFrame:
    """child, n: the nodes with several parents."""
    return edges_of(edges).groupBy("child").agg(F.count("*").alias("n")).where("n > 1")


def meet(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """The join of two tables of a row or more a node. Pointers that end at few nodes take little room on disk, which
    Spark's size check would take for few rows to broadcast: so it is told to merge."""
    return left.join(right.hint("merge"), on, how)


def pointers(edges: DataFrame) -> DataFrame:
    """node, up, distance: one row a proper edge; an error if a node has several parents."""
    if not conflicts(edges).isEmpty():
        raise ValueError("some nodes have several parents: see conflicts()")
    return stored(edges_of(edges).select(F.col("child").alias("node"), F.col("parent").alias("up"), F.lit(1).cast("long").alias("distance")))


def ancestors(edges: DataFrame) -> DataFrame:
    """node, ancestor, distance: the closure of a forest, from parents (distance 1) up to roots."""
    jump = pointers(edges).withColumnRenamed("up", "ancestor")
    pairs, step = [jump], 1
    while not jump.isEmpty():
        near = reduce(DataFrame.unionByName, pairs)
        reach = meet(jump.select(F.col("node").alias("from"), F.col("ancestor").alias("node")), near, "node")
        reach = stored(reach.select(F.col("from").alias("node"), "ancestor", (F.col("distance") + step).alias("distance")))
        if not reach.where("node = ancestor").isEmpty():
            raise ValueError("the edges have a cycle: see cycles()")
        pairs.append(reach)
        step *= 2
        jump = reach.where(F.col("distance") == step)
    return reduce(DataFrame.unionByName, pairs)


def cycles(edges: DataFrame) -> DataFrame:
    """node: the keys on cycles; none in a forest.

    A node on a cycle is pointed at, by pointers of any length: each round drops the nodes that no pointer ends at and
    doubles the pointers of the others, until a pointer ends at every node that is left. Of n nodes that point at random
    about n / step are left at a time.
    """
    jump = pointers(edges)
    while True:
        hit = stored(meet(jump.select("node", "up"), jump.select(F.col("up").alias("node")).distinct(), "node", "left_semi"))
        if hit.count() == jump.count():
            return jump.select("node")
        far = hit.select(F.col("node").alias("up"), F.col("up").alias("to"))
        further = stored(meet(hit, far, "up").select("node", F.col("to").alias("up")))
        discard(jump, hit)
        jump = further


def depths(edges: DataFrame) -> DataFrame:
    """node, depth (roots 0), root; both null for nodes on a cycle or below one."""
    top = roots(edges)
    jump, most, step, done = pointers(edges), nodes_of(edges).count(), 1, [top.select("node", F.lit(0).cast("long").alias("depth"), F.col("node").alias("root"))]
    at_root = top.withColumnRenamed("node", "up")
    while step <= 2 * most:
        ended = meet(jump, at_root, "up")
        done.append(ended.select("node", F.col("distance").alias("depth"), F.col("up").alias("root")))
        jump = stored(meet(jump, at_root, "up", "left_anti"))
        if jump.isEmpty():
            break
        # What still goes on is carried over pointers that may end at a root: those have been told above.
        every = stored(reduce(DataFrame.unionByName, done))
        done = [every]
        told = every.where("depth > 0").select(F.col("node").alias("up"), F.col("root").alias("to"), F.col("depth").alias("more"))
        far = told.unionByName(jump.select(F.col("node").alias("up"), F.col("up").alias("to"), F.col("distance").alias("more")))
        jump = stored(meet(jump, far, "up").select("node", F.col("to").alias("up"), (F.col("distance") + F.col("more")).alias("distance")))
        step *= 2
    return meet(nodes_of(edges), reduce(DataFrame.unionByName, done), "node", "left")


def paths(edges: DataFrame) -> DataFrame:
    """node, path: the keys from the root down to the node; as long as the forest is deep."""
    above = ancestors(edges).groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "ancestor"))).alias("up"))
    rows = meet(nodes_of(edges), above, "node", "left")
    up = F.coalesce(F.transform("up", lambda p: p["ancestor"]), F.expr("cast(array() as array<string>)"))
    return rows.select("node", F.concat(up, F.array("node")).alias("path"))


def descendants(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """taxon, node, distance: what is below each taxon of wanted, the taxon itself included if it is a key."""
    below = ancestors(edges).select(F.col("ancestor").alias("taxon"), "node", "distance")
    own = nodes_of(edges).select(F.col("node").alias("taxon"), "node", F.lit(0).cast("long").alias("distance"))
    return own.unionByName(below).join(wanted.select(F.col("taxon").cast("string").alias("taxon")).distinct(), "taxon")


def heights(edges: DataFrame) -> DataFrame:
    """node, height: steps to its furthest leaf (leaves 0)."""
    longest = ancestors(edges).groupBy(F.col("ancestor").alias("node")).agg(F.max("distance").alias("height"))
    return meet(nodes_of(edges), longest, "node", "left").withColumn("height", F.coalesce("height", F.lit(0).cast("long")))


def flat_list(edges: DataFrame) -> DataFrame:
    """node, position: all keys in the order of a walk that names a node's children before it enters each of them."""
    rows = paths(edges).withColumn("under", F.slice("path", F.lit(1), F.size("path") - 1))
    return places(rows, [], ["under", "node"], "position").select("node", "position")


def documents(edges: DataFrame) -> DataFrame:
    """root, document: each tree as nested JSON objects, keys in order, leaves as empty objects. A document is one row."""
    text = F.to_json(F.create_map(F.col("node"), F.lit(0)))  # the key, quoted and escaped
    rows = paths(edges).select(F.get("path", F.lit(0)).alias("root"), "path", F.substring(text, F.lit(2), F.length(text) - 4).alias("key"), F.size("path").alias("depth"))
    after = F.coalesce(F.lead("depth").over(Window.partitionBy("root").orderBy("path")), F.lit(1))
    closed = F.col("depth") - after + 1
    token = F.concat("key", F.lit(":{"), F.repeat(F.lit("}"), closed), F.when((closed > 0) & (after > 1), F.lit(",")).otherwise(F.lit("")))
    tokens = rows.select("root", "path", token.alias("token"))
    whole = tokens.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "token"))), lambda p: p["token"]), "").alias("t"))
    return whole.select("root", F.concat(F.lit("{"), "t", F.lit("}")).alias("document"))
