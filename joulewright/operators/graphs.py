"""Devices that are one over several platforms, and what lies above a device at any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joulewright.sources.tables import saved

#: Written where a number is not known; they connect nothing.
BLANK = ("", "0", "-", "N/A", "NA", "NONE", "NULL", "UNKNOWN")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the nodes of an edge table (a, b), and the least node of each one's component.

    Each round a node takes the least label among its own and its neighbours', and then the
    label that this one has: labels reach twice as far each round, so rounds grow with the
    logarithm of the longest path in all but odd cases, and it ends when nothing changes. A
    node with many edges is aggregated before the shuffle.
    """
    both = saved(edges.where("a != b").select("a", "b").unionByName(edges.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = saved(nodes.withColumn("root", F.col("node")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        low = saved(labels.join(near, "node", "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("low")), "low")
        # the label of the label; a label is a node
        jump = low.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        step = saved(low.join(jump, "low").select("node", F.col("root").alias("before"), F.col("lower").alias("root")), "labels")
        labels = step.select("node", "root")
        if step.where("before != root").isEmpty():
            return labels


def known(number: Column) -> Column:
    """A serial or vendor number in one form, null where it says nothing."""
    n = F.upper(F.trim(number.cast("string")))
    return F.when(~n.isin(*BLANK), n)


def identify(devices: DataFrame, ids: tuple[str, ...] = ("serial_number", "vendor_device_id")) -> DataFrame:
    """source, entity_id, unit, n_sources, conflict of devices (source, entity_id, and columns of ids).

    Devices that share a number are one unit, and so are those that a chain of shared numbers
    joins; numbers of different columns do not meet. unit is the least "source/entity_id" of
    it. conflict says what speaks against it: a source that has several devices in the unit,
    or several serial numbers (the first of ids) in it; null if nothing does. Rows of one
    device (its history) are one device; unknown numbers (null, blank, BLANK) join nothing.
    """
    rows = saved(devices.where("source IS NOT NULL AND entity_id IS NOT NULL").select("source", F.col("entity_id").cast("string").alias("entity_id"), *[known(F.col(c)).alias(c) for c in ids]).distinct(), "devices")
    name = F.concat_ws("/", "source", "entity_id")
    # every device is a node; a node of a number begins with what no name does
    edges = rows.select(F.concat(F.lit(" "), name).alias("a"), F.explode(F.array(F.concat(F.lit(" "), name), *[F.concat(F.lit(f"#{i}:"), F.col(c)) for i, c in enumerate(ids)])).alias("b")).where("b IS NOT NULL")
    named = components(edges).where("node LIKE ' %'").select(F.expr("substr(node, 2)").alias("_name"), F.col("root").alias("_root"))
    of = saved(rows.withColumn("_name", name).join(named, "_name"), "units")
    each = of.groupBy("_root").agg(
        F.min("_name").alias("unit"),
        F.countDistinct("source").alias("n_sources"),
        F.countDistinct("source", "entity_id").alias("_devices"),
        F.countDistinct(ids[0]).alias("_serials"),
    )
    conflict = F.concat_ws(
        "; ",
        F.when(F.col("_devices") > F.col("n_sources"), F.concat(F.col("_devices").cast("string"), F.lit(" devices in "), F.col("n_sources").cast("string"), F.lit(" sources"))),
        F.when(F.col("_serials") > 1, F.concat(F.col("_serials").cast("string"), F.lit(f" values of {ids[0]}"))),
    )
    told = each.select("_root", "unit", "n_sources", F.when(conflict != "", conflict).alias("conflict"))
    return of.select("source", "entity_id", "_root").distinct().join(told, "_root").select("source", "entity_id", "unit", "n_sources", "conflict")


def by_unit(telemetry: DataFrame, identity: DataFrame, trust_conflicts: bool = False) -> DataFrame:
    """telemetry (source, entity_id, ...) with entity_id replaced by the device's unit; without one, or with a conflict, it stays."""
    units = identity if trust_conflicts else identity.where("conflict IS NULL")
    told = telemetry.join(units.select("source", "entity_id", "unit"), ["source", "entity_id"], "left")
    return told.withColumn("entity_id", F.coalesce("unit", "entity_id")).select(telemetry.columns)


def closure(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """child, parent, depth: all that lies above each child, by the least number of steps; depth of a cycle's own child too.

    Paths are doubled: a shortest path of more than n and at most 2n steps is one of exactly n
    and one of at most n, so the former are joined with what is known, and a hierarchy of
    depth d takes about log2(d) rounds. A round writes the pairs that are new and reads, of the
    known ones, those that begin or end where a new path may. Of several ways to one parent the shortest counts;
    a child that is above itself (depth > 0) lies in a cycle, see cycles(). Null ends are left out.
    """
    paths = saved(edges.where("child IS NOT NULL AND parent IS NOT NULL").select("child", "parent", F.lit(1).cast("long").alias("depth")).distinct(), "paths")
    last, reach = paths, 1
    for _ in range(most_rounds):
        tips = last.where(F.col("depth") == reach)
        # saved, so that the plan knows their sizes: what lies far above many children is little
        middles = saved(tips.select(F.col("parent").alias("child")).distinct(), "middles")
        above = saved(paths.join(middles, "child", "left_semi"), "above")
        ends = saved(above.select("parent").distinct(), "ends")
        if ends.isEmpty():
            return paths
        # the ways of one child meet in one task, with the known pairs that they may find again; these are joined with nothing
        ways = tips.select("child", F.col("parent").alias("via"), F.lit(None).cast(tips.schema["parent"].dataType).alias("known"), "depth")
        again = paths.join(ends, "parent", "left_semi").select("child", F.col("child").alias("via"), F.col("parent").alias("known"), "depth")
        a, b = ways.unionByName(again).repartition("child").alias("a"), above.alias("b")
        on = a.join(b, F.col("a.known").isNull() & (F.col("a.via") == F.col("b.child")), "left")
        met = on.select("a.child", F.coalesce("a.known", "b.parent").alias("parent"), (F.col("a.depth") + F.coalesce("b.depth", F.lit(0))).alias("depth")).where("parent IS NOT NULL")
        last = saved(met.groupBy("child", "parent").agg(F.min("depth").alias("depth")).where(F.col("depth") > reach), "paths")
        paths, reach = paths.unionByName(last), 2 * reach
    raise ValueError(f"no end after {most_rounds} doublings")


def cycles(closed: DataFrame) -> DataFrame:
    """node, length of the shortest way back to it, of nodes that lie above themselves."""
    return closed.where("child = parent").select(F.col("child").alias("node"), F.col("depth").alias("length"))


def several_parents(edges: DataFrame) -> DataFrame:
    """child, parents (sorted) of children with more than one."""
    return edges.groupBy("child").agg(F.sort_array(F.collect_set("parent")).alias("parents")).where(F.size("parents") > 1)


def roll_up_all(df: DataFrame, closed: DataFrame, entity: str, value: str) -> DataFrame:
    """node, total, n of all that lies below each node at any depth, itself included; a cycle counts its members once."""
    up = closed.where("child != parent").select(F.col("child").alias("_c"), F.col("parent").alias("node"))
    own = df.select(F.col(entity).alias("_c"), F.col(value).alias("_v"))
    every = own.join(up, "_c").select("node", "_v").unionByName(own.select(F.col("_c").alias("node"), "_v"))
    return every.groupBy("node").agg(F.sum("_v").alias("total"), F.count(F.lit(1)).alias("n"))
