"""Graphs of objects: chains, qualified names and reachability over tables of nodes and edges.

Chains are followed by pointer doubling: every round joins what isn't finished with all pointers, so chains of n steps need log2(n)
rounds, each cut with a checkpoint. Rounds go on until nothing changes; nodes on or above cycles never finish and are left out.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import dealt, durable


def _climb(nodes: DataFrame, both: Callable[[Column, Column], Column]) -> DataFrame:
    """For nodes (id, parent, value): (id, root, value), the values from the root down to the node put together by both(upper, lower).

    A node whose parent is null or missing is a root. Nodes are counted, and each round deals them to tasks of bounded size.
    """
    nodes = durable(nodes)
    n = nodes.count()
    ids = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("_known"))
    below = dealt(nodes.where("parent IS NOT NULL"), ["parent"], n).join(dealt(ids, ["parent"], n), "parent", "left").select("id", F.when(F.col("_known"), F.col("parent")).alias("up"), "value")
    state = durable(below.unionByName(nodes.where("parent IS NULL").select("id", F.col("parent").alias("up"), "value")))
    done, open_ = state.where("up IS NULL").select("id", F.col("id").alias("root"), "value"), state.where("up IS NOT NULL")
    left = open_.count()
    while left:
        pointers = done.select(F.col("id").alias("up"), F.lit(None).cast(nodes.schema["id"].dataType).alias("_up"), F.col("root").alias("_root"), F.col("value").alias("_value"))
        pointers = pointers.unionByName(open_.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.lit(None).cast(nodes.schema["id"].dataType).alias("_root"), F.col("value").alias("_value")))
        moved = durable(dealt(open_, ["up"], n).join(dealt(pointers, ["up"], n), "up").select("id", F.col("_up").alias("up"), F.col("_root").alias("root"), both(F.col("_value"), F.col("value")).alias("value")))
        done, open_ = done.unionByName(moved.where("up IS NULL").select("id", "root", "value")), moved.where("up IS NOT NULL").select("id", "up", "value")
        before, left = left, open_.count()
        if left == before:  # a round of doubling finishes some node of any chain that has an end
            break
    return done


def chain_depths(nodes: DataFrame) -> DataFrame:
    """For nodes (id, parent) the root and the number of steps to it: (id, root, depth). Nodes on or above cycles, or above a missing node, have no row."""
    # a true root starts far below 0, so that no join is needed to tell it from one whose parent is missing
    low = -(1 << 62)
    ended = _climb(nodes.select("id", "parent", F.when(F.col("parent").isNull(), low).otherwise(1).cast("long").alias("value")), lambda upper, lower: upper + lower)
    return ended.where("value < 0").select("id", "root", (F.col("value") - low).alias("depth"))


def qualified_names(nodes: DataFrame, separator: str = ".") -> DataFrame:
    """For nodes (id, parent, name) the names from the root down, joined: (id, path). A node with a missing parent is a root; nodes on or above cycles have no row."""
    named = nodes.select("id", "parent", F.col("name").alias("value"))
    return _climb(named, lambda upper, lower: F.concat(upper, F.lit(separator), lower)).select("id", F.col("value").alias("path"))


def walk_chains(links: DataFrame) -> DataFrame:
    """For links (id, next) the chain that each node lies on and its place there, from 0: (id, head, place).

    A chain begins at a node that no link leads to; where several lead to one node, the smallest id counts as the one before. Nodes on cycles have no row.
    """
    before = links.where("next IS NOT NULL").groupBy(F.col("next").alias("id")).agg(F.min("id").alias("parent"))
    nodes = links.select("id").union(links.where("next IS NOT NULL").select("next")).distinct()
    return chain_depths(nodes.join(before, "id", "left").select("id", "parent")).select("id", F.col("root").alias("head"), F.col("depth").alias("place"))


def _met(edges: DataFrame, front: DataFrame, n: int) -> DataFrame:
    """The distinct ids that edges (src, dst; n at most) lead to from the distinct ids of front, dealt by id to tasks of bounded size.

    An inner join: the optimizer moves semi and anti joins below the dealing, and tasks would be put together by bytes again.
    """
    return dealt(edges.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")), ["id"], n).distinct()


def _new(met: DataFrame, seen: DataFrame) -> DataFrame:
    """The ids of met that aren't among the distinct ids of seen."""
    return met.join(seen.select("id", F.lit(True).alias("_seen")), "id", "left").where("_seen IS NULL").select("id")


def unreachable(objects: DataFrame, edges: DataFrame, roots: DataFrame, hops_first: int = 16) -> DataFrame:
    """The objects (id) that no path over edges (src, dst) leads to from the roots (id). Rounds go on until nothing new is met, so cycles end.

    A round follows what is new by one step. After hops_first rounds long paths are shortened: nodes with a single way on get pointers that are doubled, and a round
    follows these to their ends, in log2 of the longest such path steps; so rounds are as many as the branchings on the way, not its steps.
    """
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    n = edges.count()
    edges = dealt(edges, ["src"], n)
    seen = front = durable(roots.select("id").distinct())
    jumps: list[DataFrame] = []
    for hop in itertools.count():
        if not front.limit(1).count():
            break
        if hop == hops_first:
            jumps = _jumps(edges.join(seen.join(front, "id", "left_anti").select(F.col("id").alias("src")), "src", "left_anti"))
        for jump in jumps:
            new = durable(_new(_met(jump, front, n), seen))
            seen, front = durable(seen.unionAll(new)), durable(front.unionAll(new))
        front = durable(_new(_met(edges, front, n), seen))
        seen = durable(seen.unionAll(front)) if hop % 8 == 7 else seen.unionAll(front)
    return objects.join(seen, "id", "left_anti")


def _jumps(edges: DataFrame) -> list[DataFrame]:
    """(src, dst) of 1, 2, 4 and so on steps along nodes with a single way on, as far as there are paths so long."""
    jump = durable(edges.groupBy("src").agg(F.min("dst").alias("dst"), F.max("dst").alias("_most")).where("dst = _most").select("src", "dst"))
    out, most = [], max(1, jump.count()).bit_length()
    while len(out) < most and jump.limit(1).count():
        out.append(jump)
        jump = durable(jump.join(jump.select(F.col("src").alias("dst"), F.col("dst").alias("_on")), "dst").select("src", F.col("_on").alias("dst")))
    return out


def expression_values(nodes: DataFrame, levels: int = 17) -> DataFrame:
    """Truth values of And, Or and Not trees: nodes (id, parent, place, op, value); leaves have a value and no op. Returns (id, value) of all roots.

    Not takes its first operand, of several at one place a false one. Null, which leaves the decision to a policy: an unknown op, an inner node without operands, an invalid operand, more
    than so many nested operators. A round settles the operators whose operands are all known; only those that are still open go on.
    """
    known = durable(nodes.where("op IS NULL").select("id", "parent", "place", F.coalesce("value", F.lit(True)).alias("value")))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("_n"))
    open_ = durable(nodes.where("op IS NOT NULL").join(children, "id").select("id", "parent", "place", "op", "_n"))
    for _ in range(levels):
        operands = known.join(open_.select(F.col("id").alias("parent")), "parent", "left_semi").groupBy(F.col("parent").alias("id")).agg(
            F.count("*").alias("_m"), F.bool_and("value").alias("_all"), F.bool_or("value").alias("_any"), F.min_by("value", F.struct("place", "value")).alias("_first"), F.count_if(F.col("value").isNull()).alias("_bad")
        )
        value = F.when(F.col("_bad") == 0, F.when(F.col("op") == "And", F.col("_all")).when(F.col("op") == "Or", F.col("_any")).when(F.col("op") == "Not", ~F.col("_first")))
        ready = durable(open_.join(operands, "id").where("_m = _n").select("id", "parent", "place", value.alias("value")))
        if not ready.limit(1).count():
            break
        known = known.unionAll(ready)
        open_ = durable(open_.join(ready, "id", "left_anti"))
    return nodes.where("parent IS NULL").select("id").join(known.select("id", "value"), "id", "left")


def hops(edges: DataFrame, roots: DataFrame, max_hops: int) -> DataFrame:
    """Nodes within max_hops of the roots over edges (src, dst), with their distance; each round follows what is new.

    Edges are counted and dealt by src, and what a round meets by id, to tasks of bounded size.
    """
    n = edges.count()
    edges = dealt(edges, ["src"], n)
    seen = durable(roots.select("id").distinct().select("id", F.lit(0).alias("hop")))
    front = seen
    for hop in range(1, max_hops + 1):
        front = durable(_new(_met(edges, front, n), seen).select("id", F.lit(hop).alias("hop")))
        seen = seen.unionAll(front)
    return seen


def resolve_aliases(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """names (name) with target: aliases (name, target) followed to the last one; a name that is no alias is its own target.

    A chain that comes back to a name it has met ends there, so a name on a cycle is its own target, and one above a cycle has the first name of the cycle that it meets.
    """
    links = aliases.groupBy("name").agg(F.min("target").alias("target"))
    state = durable(links.select("name", F.col("target").alias("up"), F.array("name").alias("met")))
    done, open_ = None, state
    ends = links.select(F.col("name").alias("up"), "target")
    while open_.limit(1).count():
        moved = open_.join(ends, "up", "left")
        stops = F.col("target").isNull() | F.array_contains("met", F.col("up"))
        ended = moved.where(stops).select("name", F.col("up").alias("target"))
        done = durable(ended if done is None else done.unionByName(ended))
        open_ = durable(moved.where(~stops).select("name", F.col("target").alias("up"), F.concat("met", F.array("up")).alias("met")))
    found = names if done is None else names.join(done, "name", "left")
    return found.select(*names.columns, (F.col("name") if done is None else F.coalesce("target", "name")).alias("target"))
