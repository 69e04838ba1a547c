"""Trees as tables: node (id, parent, length, name), and what is asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reedbank.functions.taxon import is_canonical_list, is_full_path
from reedbank.session import cut, meet, stored


def children(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent is not null").select("parent", F.col("id").alias("child"))


def leaves(nodes: DataFrame) -> DataFrame:
    return meet(nodes, children(nodes).select(F.col("parent").alias("id")).distinct(), "id", "left_anti")


def internal(nodes: DataFrame) -> DataFrame:
    return meet(nodes, children(nodes).select(F.col("parent").alias("id")).distinct(), "id", "left_semi")


def tips(nodes: DataFrame) -> DataFrame:
    """Internal nodes whose children are all leaves."""
    inner = internal(nodes).select(F.col("id").alias("child"), F.lit(True).alias("inner"))
    kids = children(nodes).join(inner, "child", "left")
    return kids.groupBy(F.col("parent").alias("id")).agg(F.bool_and(F.col("inner").isNull()).alias("all_leaves")).where("all_leaves").select("id")


def first_last_child(nodes: DataFrame) -> DataFrame:
    return children(nodes).groupBy("parent").agg(F.min("child").alias("first_child"), F.max("child").alias("last_child"), F.count("*").alias("n_children"))


def sibling_pairs(nodes: DataFrame) -> DataFrame:
    """(parent, a, b): the first and the last child of each node with two or more."""
    return first_last_child(nodes).where("n_children >= 2").select("parent", F.col("first_child").alias("a"), F.col("last_child").alias("b"))


def fix_lengths(nodes: DataFrame, least: float = 1e-5) -> DataFrame:
    """Leaf branches that aren't positive get the least length."""
    leaf = leaves(nodes).select("id", F.lit(True).alias("leaf"))
    return nodes.join(leaf, "id", "left").withColumn("length", F.when(F.col("leaf") & (F.col("length") <= 0), F.lit(least)).otherwise(F.col("length"))).drop("leaf")


def annotate(nodes: DataFrame, annotations: DataFrame) -> DataFrame:
    """Adds anno: the annotation of the node's name (the last line's, if there are several), else the name."""
    last = annotations.groupBy("name").agg(F.max_by("anno", "line").alias("anno"))
    return nodes.join(last, "name", "left").withColumn("anno", F.coalesce("anno", "name"))


def _jumps(nodes: DataFrame) -> DataFrame:
    """(id, up, distance): one level up."""
    # trees without lengths are fine where no value needs them
    length = F.col("length").cast("double") if "length" in nodes.columns else F.lit(None).cast("double")
    return cut(nodes.where("parent is not null").select("id", F.col("parent").alias("up"), length.alias("distance")))


def _doubled(jumps: DataFrame) -> DataFrame:
    """Jumps over twice as many levels; empty once they are as many as the tree has."""
    next_ = jumps.select(F.col("id").alias("up"), F.col("up").alias("top"), F.col("distance").alias("more"))
    return cut(meet(jumps, next_, "up").select("id", F.col("top").alias("up"), (F.col("distance") + F.col("more")).alias("distance")))


def levels_up(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, depth) of the starts and all their ancestors: how many levels the nearest start is below.  Rounds are as many as the depth has binary digits."""
    have, jumps, step = cut(starts.select("id").distinct().withColumn("depth", F.lit(0))), _jumps(nodes), 1
    while jumps.take(1):
        moved = meet(have, jumps, "id").select(F.col("up").alias("id"), (F.col("depth") + step).alias("depth"))
        have = cut(have.unionByName(moved).groupBy("id").agg(F.min("depth").alias("depth")))
        jumps, step = _doubled(jumps), 2 * step
    return have


def ancestor_closure(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """Ids of the starts and all their ancestors."""
    return levels_up(nodes, starts).select("id")


def pruned(nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """Nodes of the tree cut to kept: a node whose children include a closed one keeps all its children."""
    closed = ancestor_closure(nodes, kept)
    expand = nodes.join(closed, "id", "left_semi").where("parent is not null").select("parent").distinct()
    below = nodes.join(expand, "parent", "left_semi").select(nodes["id"], nodes["parent"], nodes["length"])
    root = nodes.where("parent is null").select("id", "parent", "length")
    return below.unionByName(root)


def _below(nodes: DataFrame, start: DataFrame, raised: dict, merged: dict) -> DataFrame:
    """start (id, values) gathered over everything below each node, in as many rounds as the depth has binary digits.

    After round k a node has what lies less than 2^k levels below it, and jumps go 2^k levels up: each round sends every node's values along its jump, and doubles the
    jumps.  So the work is nodes times rounds, however deep the tree.  raised: a value as it arrives over distance; merged: how values of one node unite."""
    values = [c for c in start.columns if c != "id"]
    unite = lambda df: df.groupBy("id").agg(*[merged[c](c).alias(c) for c in values])
    have = cut(unite(start))
    jumps = _jumps(nodes)
    while jumps.take(1):
        moved = meet(have, jumps, "id").select(F.col("up").alias("id"), *[raised.get(c, F.col)(c).alias(c) for c in values])
        have = cut(unite(have.unionByName(moved)))
        jumps = _doubled(jumps)
    return have


def heights(nodes: DataFrame) -> DataFrame:
    """(id, height): shortest way down to a leaf."""
    return _below(nodes, leaves(nodes).select("id", F.lit(0.0).alias("height")), {"height": lambda c: F.col(c) + F.col("distance")}, {"height": F.min})


def _nearest_up(nodes: DataFrame, stop: Column, own: Column | None = None) -> DataFrame:
    """(id, to, distance, names) for nodes with a stop on their way to the root, itself included: the nearest one, how far it is, and the values of own (null: none)
    of the nodes before it, uppermost first.  Pointers double in each round."""
    none = F.expr("cast(array() as array<string>)")
    mine = none if own is None else F.when(own.isNull(), none).otherwise(F.array(own))
    first = nodes.select(
        "id", F.when(stop, F.col("id")).otherwise(F.col("parent")).alias("to"), F.when(stop, 0.0).otherwise(F.coalesce(F.col("length").cast("double"), F.lit(0.0))).alias("distance"), F.when(stop, none).otherwise(mine).alias("names"), F.coalesce(stop, F.lit(False)).alias("done")
    )
    here = cut(first.where("to is not null"))
    before = -1
    while True:
        ahead = here.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("distance").alias("more"), F.col("names").alias("above"), F.col("done").alias("there"))
        # pointers at roots that are no stops lead nowhere
        step = meet(here, ahead, "to").select(
            "id",
            F.when(F.col("done"), F.col("to")).otherwise(F.col("next")).alias("to"),
            F.when(F.col("done"), F.col("distance")).otherwise(F.col("distance") + F.col("more")).alias("distance"),
            F.when(F.col("done"), F.col("names")).otherwise(F.concat("above", "names")).alias("names"),
            # a stop is its own pointer, so who points at one has arrived
            (F.col("done") | F.col("there")).alias("done"),
        )
        here = cut(step)
        n = here.where("not done").count()
        if n == 0 or n == before:
            return here.where("done").drop("done")
        before = n


def annotation_paths(nodes: DataFrame, named: str = "^[dkpcofgs]__.+") -> DataFrame:
    """(id, anno_id, anno_dist): the nearest node on the way up whose anno is canonical, and how far it is; nodes without one are left out."""
    return _nearest_up(nodes, F.col("anno").rlike(named)).select("id", F.col("to").alias("anno_id"), F.col("distance").alias("anno_dist"))


def annotate_by_path(nodes: DataFrame, root_name: str = "") -> DataFrame:
    """(id, anno, anno_dist): the name of the nearest node on the way up whose name is a full path of ranks, with the names of canonical parts that stand
    before it behind; where there is none, those names up to the root, or root_name.  The distance goes to that node, or to the root."""
    full, part = is_full_path(F.col("name")), is_canonical_list(F.col("name"))
    root = F.col("parent").isNull()
    ways = _nearest_up(nodes, F.coalesce(full, F.lit(False)) | root, F.when(part, F.col("name")))
    top = nodes.select(F.col("id").alias("to"), F.when(full, F.array("name")).otherwise(F.expr("cast(array() as array<string>)")).alias("last"))
    path = F.concat("last", "names")
    return meet(ways, top, "to").select("id", F.when(F.size(path) > 0, F.array_join(path, ";")).otherwise(F.lit(root_name)).alias("anno"), F.col("distance").alias("anno_dist"))


def reroot(nodes: DataFrame, new_root: int) -> DataFrame:
    """The tree with new_root as root: pointers on its way to the old root turn round, with their lengths."""
    way = levels_up(nodes, nodes.where(F.col("id") == new_root))
    turned = way.join(nodes.select("id", F.col("parent").alias("old_parent"), F.col("length").alias("old_length")), "id")
    # a node on the way gets as parent the one before it, over that one's old branch
    before = turned.select(F.col("old_parent").alias("id"), F.col("id").alias("new_parent"), F.col("old_length").alias("new_length")).where("id is not null")
    changed = way.select("id").join(before, "id", "left")
    kept = nodes.join(changed.withColumn("turned", F.lit(True)), "id", "left")
    return kept.select("id", F.when(F.col("turned"), F.col("new_parent")).otherwise(F.col("parent")).alias("parent"), F.when(F.col("turned"), F.coalesce("new_length", F.lit(0.0))).otherwise(F.col("length")).alias("length"))


def summary(nodes: DataFrame) -> DataFrame:
    """One row: nodes, directed edges, leaves, roots."""
    n_leaves = leaves(nodes).agg(F.count("*").alias("n_leaves"))
    own = nodes.agg(F.count("*").alias("n_nodes"), (2 * F.count("parent")).alias("n_edges"), F.count_if(F.col("parent").isNull()).alias("n_roots"))
    return own.crossJoin(n_leaves)


def leaves_below(nodes: DataFrame) -> DataFrame:
    """(id, first_leaf, last_leaf, n_leaves) of the leaves under each node, itself included."""
    own = leaves(nodes).select("id", F.col("id").alias("first_leaf"), F.col("id").alias("last_leaf"), F.lit(1).cast("long").alias("n_leaves"))
    return _below(nodes, own, {}, {"first_leaf": F.min, "last_leaf": F.max, "n_leaves": F.sum})


def random_leaf(nodes: DataFrame, seed: int = 0) -> DataFrame:
    """(id, leaf): a leaf under each node, the one with the smallest hash of (seed, leaf), so it doesn't depend on partitions."""
    own = leaves(nodes).select("id", F.struct(F.xxhash64(F.lit(seed), "id").alias("h"), F.col("id").alias("leaf")).alias("leaf"))
    return _below(nodes, own, {}, {"leaf": F.min}).select("id", F.col("leaf.leaf").alias("leaf"))


def subtrees(nodes: DataFrame, most: int) -> DataFrame:
    """(id, parent, length, top): the uppermost node on the way to the root, itself included, below which are at most so many nodes, with itself; null where there are more.

    Sizes are counted and tops found by doubling pointers, in as many rounds as most or the depth has binary digits."""
    here, span = stored(nodes.select("id", F.col("parent").alias("up"), F.lit(1).cast("long").alias("n")), "subtree_sizes"), 1
    # below a node of a larger span are more than most, and so many have been counted
    while span <= most and here.where("up is not null").take(1):
        below = here.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("n").alias("more"))
        ahead = here.select(F.col("id").alias("up"), F.col("up").alias("next"))
        here = stored(meet(meet(here, below, "id", "left"), ahead, "up", "left").select("id", F.col("next").alias("up"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")), "subtree_sizes")
        span *= 2
    large = here.where(F.col("n") > most).select("id", F.lit(True).alias("large"))
    known = meet(meet(nodes.select("id", "parent", "length"), large, "id", "left"), nodes.select(F.col("id").alias("parent"), F.lit(True).alias("there")), "parent", "left")
    known = meet(known, large.select(F.col("id").alias("parent"), F.col("large").alias("above")), "parent", "left")
    first = F.col("above").isNotNull() | F.col("there").isNull()
    known = stored(known.select("id", "parent", "length", F.when(F.col("large").isNull(), F.when(first, F.col("id")).otherwise(F.col("parent"))).alias("to"), first.alias("done")), "subtrees")
    ways = known.where("to is not null").select("id", "to", "done")
    while ways.where("not done").take(1):
        ahead = ways.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("done").alias("there"))
        # a top is its own pointer, so who points at one has arrived
        ways = stored(meet(ways, ahead, "to").select("id", F.col("next").alias("to"), (F.col("done") | F.col("there")).alias("done")), "subtree_tops")
    return meet(known.select("id", "parent", "length"), ways.select("id", F.col("to").alias("top")), "id", "left")
