"""Parent-child links to full hierarchies.

The pointer graph is solved in three steps. (1) Every node walks to the next *splitter* above it (nodes
chosen by a hash of the id, and parents with very many children); walking doubles its stride in each round,
so a walk of length L takes log2(L) rounds. (2) The splitters alone form a reduced pointer graph, about
``splitter_every`` times smaller, which is solved the same way. (3) Each node's path is the walk to its
splitter followed by the splitter's own path. Loops without any splitter show up as walks that never stop
and are settled in step 1; loops through splitters are settled in the reduced graph.

No step collects the graph: every round is one join, written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import HOT_LEAST, cut, hot_keys, lookup

#: One node in so many is a splitter.
SPLITTER_EVERY = 16


def _no_trail() -> Column:
    return F.expr("cast(array() as array<bigint>)")


def _walk(start: DataFrame, stops: Column | None) -> DataFrame:
    """Double the stride of all open walks until each has ended or is known to go round in a loop.

    ``start``: id, tgt, hops, low (smallest id passed), trail, done, cyc. A walk that never ends gets ``cyc``, the
    smallest id of the loop it falls into, and an empty trail. Loops are told walk by walk: the stretch a walk has
    passed and the one its target has passed lie behind each other, so if both have the same smallest id, that
    node comes twice; and as the two hold a whole turn of the loop, it is the loop's smallest. A walk on a loop of
    length n stops after log2(n) rounds, one below it when its target has. Rows that are done are written once.
    """
    stops = F.lit(False) if stops is None else stops
    state = cut(start)
    done, open_ = state.where("done"), state.where(~F.col("done"))
    while left := open_.count():
        step = done.unionByName(open_).select(
            F.col("id").alias("_k"), F.col("tgt").alias("_tgt"), F.col("hops").alias("_hops"), F.col("low").alias("_low"),
            F.col("trail").alias("_trail"), F.col("done").alias("_done"), F.col("cyc").alias("_cyc"),
        )
        # many walks may have one target
        met = lookup(open_, "tgt", step, "_k") if left > HOT_LEAST else open_.join(step, F.col("tgt") == F.col("_k"))
        cyc = F.coalesce("_cyc", F.when(F.col("low") == F.col("_low"), F.col("low")))
        moved = met.select(
            "id", F.col("_tgt").alias("tgt"), (F.col("hops") + F.col("_hops")).alias("hops"), F.least("low", "_low").alias("low"),
            F.when(cyc.isNull(), F.concat("trail", "_trail")).otherwise(_no_trail()).alias("trail"), F.col("_done").alias("done"), cyc.alias("cyc"),
        )
        moved = cut(moved.withColumn("done", F.col("done") | F.col("cyc").isNotNull() | stops))
        done, open_ = done.unionByName(moved.where("done")), moved.where(~F.col("done"))
    return done


def resolve_hierarchy(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id", *, paths: bool = True, splitter_every: int = SPLITTER_EVERY) -> DataFrame:
    """Root, depth, path and loop of every node of a parent-child table.

    Returns ``id, parent_id, root_id, depth, path, cycle_id``, one row for each distinct non-null id. ``path``
    runs from the root to the node, both included (null with ``paths=False``). A node whose chain never ends
    has a ``cycle_id`` (the smallest id on the loop) and null root, depth and path; for all others
    ``cycle_id`` is null. A parent that is null or not in the table makes a root. Repeated rows count once; if
    an id comes with several parents, the smallest non-null one holds. Rows with a null id are ignored; an
    empty table gives an empty result; further columns are not looked at.
    """
    nodes = (
        df.select(F.col(id_col).cast("long").alias("id"), F.col(parent_col).cast("long").alias("parent_id"))
        .where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.min("parent_id").alias("parent_id"))
    )
    nodes = cut(nodes)
    hot = hot_keys(nodes, "parent_id")

    def splitter(c: Column) -> Column:
        by_hash = F.pmod(F.xxhash64(c), F.lit(splitter_every)) == 0
        return (by_hash | c.isin(hot)) if hot else by_hash

    known = lookup(nodes, "parent_id", nodes.select(F.col("id").alias("_pid")), "_pid")
    root = F.col("_pid").isNull()
    trail = F.when(root, _no_trail()).otherwise(F.array("id")) if paths else _no_trail()
    start = known.select(
        "id",
        F.when(root, F.col("id")).otherwise(F.col("parent_id")).alias("tgt"),
        F.when(root, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("hops"),
        F.col("id").alias("low"),
        trail.alias("trail"),
        (root | splitter(F.col("parent_id"))).alias("done"),
        F.lit(None).cast("long").alias("cyc"),
    )
    walked = _walk(start, splitter(F.col("tgt")))

    at_root = F.col("hops") == 0
    reduced = walked.where(splitter(F.col("id"))).withColumn("done", at_root | F.col("cyc").isNotNull() | ~splitter(F.col("tgt")))
    # first without trails, as those of a long loop would grow for each of its nodes; what ends is walked again with them
    solved = _walk(reduced.withColumn("trail", _no_trail()), None)
    if paths:
        ends = solved.where("cyc is null").select(F.col("id").alias("_e"))
        again = _walk(reduced.join(ends, F.col("id") == F.col("_e"), "left_semi"), None)
        solved = again.unionByName(solved.where("cyc is not null"))
    solved = solved.select(
        F.col("id").alias("_s"), F.col("tgt").alias("_root"), F.col("hops").alias("_depth"), F.col("trail").alias("_up"), F.col("cyc").alias("_cyc")
    )
    via = F.when(splitter(F.col("tgt")) & F.col("cyc").isNull() & ~at_root, F.col("tgt"))
    full = lookup(walked.withColumn("_via", via), "_via", solved, "_s")
    cycle = F.coalesce("cyc", "_cyc")
    ends = cycle.isNull()
    full = full.select(
        "id",
        F.when(ends, F.coalesce("_root", "tgt")).alias("root_id"),
        F.when(ends, F.col("hops") + F.coalesce("_depth", F.lit(0))).cast("int").alias("depth"),
        F.concat("trail", F.coalesce("_up", _no_trail())).alias("up"),
        cycle.alias("cycle_id"),
    )
    path = F.when(F.col("cycle_id").isNull(), F.reverse(F.concat("up", F.array("root_id")))) if paths else F.lit(None).cast("array<bigint>")
    own = nodes.select(F.col("id").alias("_id"), "parent_id")
    return full.join(own, F.col("id") == F.col("_id")).select(
        "id", "parent_id", "root_id", "depth", path.alias("path"), "cycle_id"
    )


def descendants(resolved: DataFrame) -> DataFrame:
    """All (ancestor_id, id, distance) pairs with distance >= 1 from the paths of :func:`resolve_hierarchy`.

    Rows rather than one array per ancestor, so an ancestor of a third of all nodes is no single large value.
    Nodes on or below a loop have no path and give no pairs; an empty table gives none.
    """
    return (
        resolved.where(F.col("path").isNotNull())
        .select("id", "depth", F.posexplode("path").alias("pos", "ancestor_id"))
        .where(F.col("pos") < F.col("depth"))
        .select("ancestor_id", "id", (F.col("depth") - F.col("pos")).cast("int").alias("distance"))
    )


def descendant_counts(resolved: DataFrame) -> DataFrame:
    """Per node: id, root_id, depth and the number of its descendants; looped nodes have nulls and 0."""
    n = descendants(resolved).groupBy(F.col("ancestor_id").alias("_a")).agg(F.count("*").alias("n"))
    return resolved.join(n, F.col("id") == F.col("_a"), "left").select(
        "id", "root_id", "depth", F.array_join("path", "/").alias("path"), F.coalesce("n", F.lit(0)).cast("long").alias("n_descendants"), "cycle_id"
    )


def preorder(codes: DataFrame) -> DataFrame:
    """Codes in pre-order: id, root_id, depth, project_id (the root's) and place, counted from 1 in each project.

    Siblings stand by sort_order (null as 0) and id. Codes on or below a loop have no place; of an id given twice
    one row holds. ``codes``: id, parent_id, sort_order, project_id.
    """
    one = codes.groupBy("id").agg(F.min("parent_id").alias("parent_id"), F.min("sort_order").alias("sort_order"), F.min("project_id").alias("project_id"))
    tree = resolve_hierarchy(one).where(F.col("path").isNotNull())
    order = one.select(F.col("id").alias("_c"), F.coalesce("sort_order", F.lit(0)).alias("so"))
    steps = tree.select("id", "root_id", "depth", F.posexplode("path").alias("pos", "step")).join(order, F.col("step") == F.col("_c"))
    key = F.transform(F.sort_array(F.collect_list(F.struct("pos", "so", "step"))), lambda s: F.struct(s["so"], s["step"]))
    keyed = steps.groupBy("id", "root_id", "depth").agg(key.alias("key"))
    root = one.select(F.col("id").alias("_r"), "project_id")
    w = Window.partitionBy("project_id").orderBy("key")
    return keyed.join(root, F.col("root_id") == F.col("_r")).select("id", "root_id", "depth", "project_id", F.row_number().over(w).cast("long").alias("place"))
