"""Roots, depths, paths and descendants of parent-child links, by contraction.

The link graph is contracted in rounds and the rounds are then undone:

* *rake*: nodes without children are removed, their weight goes to their parents;
* *compress*: every chain of nodes with one parent and one child each becomes one longer link between its two
  ends, whatever its length; places in the chain are found by doubling, so a chain of n nodes takes log n joins.

A tree is gone after at most about log n such rounds. What neither step can reduce is a core of cycles: a ring of
single-parent, single-child nodes shows in the doubling and becomes one node; a cycle that shrinks to a link of a
node to itself marks that node; of what still remains, the strongly connected parts are found by colouring,
merged, and contracted in turn. Colouring, and distances inside of such a core, take as many steps as the
contracted core is wide.

Undoing the rounds in reverse order gives every node its facts from its neighbours of that round: distances to
roots come down from the parents, the set and number of nodes below come up from the child.

Nodes with a single parent add a number to it. Only the few with several parents travel upwards as
(node, element) rows, which keeps the count of distinct descendants exact without the full closure. A node has
such a row for every node with several parents below it, which is what an exact count of distinct ones costs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twintable.runtime import Growing, cut, cut_all, release, scratch

ROOT, BELOW, COUNT, CYCLE, SELF = 0, 1, 2, 3, 4
#: Nodes of chains for each leaf just raked from which on chains are compressed.
COMPRESS_SHARE = 0.25


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _shortest(edges: DataFrame, paths: bool) -> DataFrame:
    """One link per pair of nodes, the shortest; ties by the smaller list of nodes on the way."""
    if not paths:
        return edges.groupBy("src", "dst").agg(F.min("w").alias("w")).withColumn("via", _no_names(paths))
    best = edges.groupBy("src", "dst").agg(F.min(F.struct("w", "via")).alias("m"))
    return best.select("src", "dst", "m.w", "m.via")


def _no_names(paths: bool):
    """Nodes on a way of none; where no paths are asked for, a constant in their place."""
    return F.array().cast("array<string>") if paths else F.lit(False)


def _gain(nodes: DataFrame, gains: DataFrame) -> DataFrame:
    """``nodes`` with the weights and loops of ``gains`` (``n, gain, loop``) added."""
    total = gains.groupBy("n").agg(F.sum("gain").alias("gain"), F.max("loop").alias("loop"))
    return nodes.join(total, "n", "left").select(
        "n", (F.col("weight") + F.coalesce("gain", F.lit(0))).alias("weight"), "is_root", F.greatest("own_cycle", F.coalesce("loop", F.lit(0))).alias("own_cycle")
    )


def _rake(nodes: DataFrame, edges: DataFrame, sets: DataFrame, paths: bool) -> tuple | None:
    """Removes the nodes without children. Returns their number, the record of the step and what is left, None if there are none."""
    col = F.col
    parents = edges.groupBy("dst").agg(F.count("*").alias("i"), F.max("src").alias("par")).withColumnRenamed("dst", "n")
    childless = nodes.join(edges.select(col("src").alias("n")), "n", "left_anti")
    gone = cut(
        childless.join(parents, "n", "left").select(
            "n", "weight", "is_root", "own_cycle", F.coalesce("i", F.lit(0)).alias("i"), "par", F.lit(None).cast("string").alias("chd"), _no_names(paths).alias("vi"), F.lit(True).alias("leaf")
        )
    )
    leaves = gone.count()
    if not leaves:
        return None
    ids = gone.select("n")
    down, own = cut_all(
        edges.join(gone.select(col("n").alias("dst"), "i", "weight"), "dst"),
        sets.join(ids.withColumnRenamed("n", "owner"), "owner", "left_semi"),
    )
    step = {"gone": gone, "down": down.select("src", "dst", "w", "via"), "sets": own}
    lifted = own.join(down.select(col("dst").alias("owner"), col("src").alias("up")), "owner").select(col("up").alias("owner"), "elem", "size")
    shared = down.where("i > 1").select(col("src").alias("owner"), col("dst").alias("elem"), col("weight").alias("size"))
    gains = gone.where("i = 1").select(col("par").alias("n"), col("weight").alias("gain"), F.lit(0).alias("loop"))
    left = cut_all(
        _gain(nodes.join(ids, "n", "left_anti"), gains),
        edges.join(ids.withColumnRenamed("n", "dst"), "dst", "left_anti"),
        _union([sets.join(ids.withColumnRenamed("n", "owner"), "owner", "left_anti"), lifted, shared]).distinct(),
    )
    return leaves, step, *left


def _doubled(jumps: DataFrame, paths: bool) -> DataFrame:
    """Every place that is not at its top yet moves on to where the node it points to points."""
    col = F.col
    reach = jumps.select(
        col("n").alias("ptr"), col("ptr").alias("ptr2"), col("done").alias("done2"), col("d").alias("d2"), col("pw").alias("pw2"), col("between").alias("between2"), col("low").alias("low2")
    )
    moved = jumps.where("not done").join(reach, "ptr").select(
        "n", col("ptr2").alias("ptr"), col("done2").alias("done"), (col("d") + col("d2")).alias("d"), (col("pw") + col("pw2")).alias("pw"),
        (F.concat("between2", F.array("ptr"), "between") if paths else col("between")).alias("between"), F.least("low", "low2").alias("low"), (col("low2") < col("low")).alias("moved"),
    )
    return jumps.where("done").unionByName(moved)


def _places(unary: DataFrame, paths: bool) -> DataFrame:
    """Where every single-parent, single-child node stands in its chain, by doubling.

    ``n, ptr, done, d, pw, between, low``: ``ptr`` is the top of the chain, ``d`` and ``pw`` distance and weight from
    there, ``between`` the nodes on the way. On a ring there is no top: ``done`` stays false, ``low`` is its smallest name.
    """
    col = F.col
    top = col("up").isNull()
    inner = unary.select(col("n").alias("par"), F.lit(1).alias("up"))
    start = unary.join(inner, "par", "left").select("n", "par", "weight", "wi", "vi", "up")
    tops = start.where("up is null").select(col("n").alias("par"), F.lit(True).alias("stop"))
    jumps = cut(
        start.join(tops, "par", "left").select(
            "n", F.when(top, col("n")).otherwise(col("par")).alias("ptr"), (top | F.coalesce("stop", F.lit(False))).alias("done"),
            F.when(top, 0).otherwise(col("wi")).cast("bigint").alias("d"), F.when(top, 0).otherwise(col("weight")).cast("bigint").alias("pw"),
            (F.when(top, _no_names(paths)).otherwise(col("vi")) if paths else col("vi")).alias("between"), F.least("n", F.when(top, col("n")).otherwise(col("par"))).alias("low"), F.lit(True).alias("moved"),
        )
    )
    before = -1
    while True:
        # Each round of doublings ends some nodes of every chain that is still open; once none ends and no smallest name
        # moves, only rings are left and every node has seen the whole of its ring.
        open_ = jumps.where("not done").agg(F.count("*").alias("n"), F.max("moved").alias("moved")).first()
        if not open_["n"] or (open_["n"] == before and not open_["moved"]):
            return jumps
        before = open_["n"]
        jumps = cut(_doubled(_doubled(jumps, paths), paths))
        release(jumps.sparkSession)


def _compress(nodes: DataFrame, edges: DataFrame, sets: DataFrame, paths: bool, worth: float) -> tuple | None:
    """Replaces every chain by one link and every ring by one node. Returns the record of the step and what is left; None if no more than ``worth`` nodes would go."""
    col, zero = F.col, F.lit(0)
    none, nothing = F.lit(None).cast("string"), F.lit(None).cast("array<string>" if paths else "boolean")
    ends = edges.select(col("src").alias("n"), F.lit(1).alias("o"), zero.alias("i"), none.alias("par"), col("dst").alias("chd"), zero.alias("wi"), col("w").alias("wo"), nothing.alias("vi"), col("via").alias("vo"))
    ends = ends.unionByName(edges.select(col("dst").alias("n"), zero.alias("o"), F.lit(1).alias("i"), col("src").alias("par"), none.alias("chd"), col("w").alias("wi"), zero.alias("wo"), col("via").alias("vi"), nothing.alias("vo")))
    single = ends.groupBy("n").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), *[F.max(c).alias(c) for c in ("par", "chd", "wi", "wo", "vi", "vo")]).where("o = 1 and i = 1")
    unary = cut(single.join(nodes, "n").select("n", "weight", "own_cycle", "par", "chd", "wi", "wo", "vi", "vo"))
    if unary.count() <= worth:
        return None
    places = _places(unary, paths).join(unary.select("n", "weight", "own_cycle"), "n")
    tops = unary.join(unary.select(col("n").alias("par")), "par", "left_anti").select(col("n").alias("ptr"), col("par").alias("h"), col("wi").alias("w1"), col("vi").alias("v1"), col("weight").alias("tw"))
    bottoms = unary.join(unary.select(col("n").alias("chd")), "chd", "left_anti").select("n", col("chd").alias("t"), "wo", "vo")
    last = bottoms.join(places.where("done"), "n").join(tops, "ptr")
    inside = F.when(col("n") == col("ptr"), F.array("n")).otherwise(F.concat(F.array("ptr"), "between", F.array("n")))
    chains = cut(last.select("ptr", "h", "t", "w1", "v1", "tw", (col("w1") + col("d") + col("wo")).alias("w"), (col("tw") + col("pw")).alias("total"), (F.concat("v1", inside, "vo") if paths else col("v1")).alias("via")))
    before = F.when(col("n") == col("ptr"), col("v1")).otherwise(F.concat("v1", F.array("ptr"), "between"))
    on_chain = places.where("done").join(chains.drop("w", "via"), "ptr").select(
        "n", (col("total") - col("tw") - col("pw") + col("weight")).alias("weight"), "own_cycle", col("h").alias("par"), col("t").alias("chd"),
        (col("w1") + col("d")).cast("int").alias("wi"), (before if paths else col("v1")).alias("vi"), "ptr", F.lit(False).alias("ring"),
    )
    on_ring = places.where("not done and n <> low").select(
        "n", "weight", "own_cycle", col("low").alias("par"), col("low").alias("chd"), zero.alias("wi"), _no_names(paths).alias("vi"), col("low").alias("ptr"), F.lit(True).alias("ring")
    )
    members = cut(on_chain.unionByName(on_ring))
    release(nodes.sparkSession)
    gone = members.select("n", "weight", zero.alias("is_root"), "own_cycle", F.lit(1).alias("i"), "par", "chd", "vi", F.lit(False).alias("leaf"))
    down = members.where("not ring").select(col("par").alias("src"), col("n").alias("dst"), col("wi").alias("w"), col("vi").alias("via"))
    # What is below a node of a chain is below all nodes before it.
    held = sets.join(members.select(col("n").alias("owner"), "ptr", "par", "wi", "ring"), "owner")
    deepest = held.where("not ring").groupBy("ptr", "elem", "size").agg(F.max("wi").alias("at"))
    own = deepest.join(members.where("not ring").select("ptr", col("n").alias("owner"), "wi"), "ptr").where("wi <= at").select("owner", "elem", "size")
    rings = places.where("not done").groupBy("low").agg(F.sum("weight").alias("gain"), F.sum(F.when(col("n") == col("low"), col("weight"))).alias("mine"))
    gains = chains.select(col("h").alias("n"), col("total").alias("gain"), (col("h") == col("t")).cast("int").alias("loop"))
    gains = gains.unionByName(rings.select(col("low").alias("n"), (col("gain") - col("mine")).alias("gain"), F.lit(1).alias("loop")))
    bridges = chains.where("h <> t").select(col("h").alias("src"), col("t").alias("dst"), col("w").cast("int").alias("w"), "via")
    ids = unary.select("n")
    kept = edges.join(ids.withColumnRenamed("n", "dst"), "dst", "left_anti").join(ids.withColumnRenamed("n", "src"), "src", "left_anti")
    removed = members.select("n")
    own, *left = cut_all(
        own,
        _gain(nodes.join(removed, "n", "left_anti"), gains),
        _shortest(kept.unionByName(bridges), paths),
        sets.join(removed.withColumnRenamed("n", "owner"), "owner", "left_anti").unionByName(held.select(col("par").alias("owner"), "elem", "size")).distinct(),
    )
    return {"gone": gone, "down": down, "sets": own}, *left


def contract(nodes: DataFrame, edges: DataFrame, sets: DataFrame, paths: bool) -> tuple[list[dict], DataFrame, DataFrame, DataFrame]:
    """Rakes and compresses in turn until neither moves. Returns the records of all steps and what is left of nodes, links, sets.

    Chains wait while they hold few nodes beside the leaves just raked (COMPRESS_SHARE): a tree with l leaves has
    less than l branching nodes, so a rake then takes a fixed share of it and the number of steps stays logarithmic.
    """
    steps: list[dict] = []
    while True:
        raked = _rake(nodes, edges, sets, paths)
        leaves = 0
        if raked:
            leaves, step, nodes, edges, sets = raked
            steps.append(step)
            release(nodes.sparkSession)
        compressed = _compress(nodes, edges, sets, paths, COMPRESS_SHARE * leaves)
        if compressed:
            step, nodes, edges, sets = compressed
            steps.append(step)
        if not (raked or compressed) or (edges.isEmpty() and nodes.isEmpty()):
            return steps, nodes, edges, sets
        release(nodes.sparkSession)


def _facts(paths: bool, node, kind: int, key, val, path=None) -> list:
    return [
        node.alias("node"),
        F.lit(kind).alias("kind"),
        key.alias("key"),
        val.cast("bigint").alias("val"),
        (path if paths and path is not None else _no_names(paths)).alias("path"),
    ]


def _undo(rounds: list[dict], facts: DataFrame, paths: bool) -> DataFrame:
    """Facts of all nodes: those given, and of the nodes removed in each round, the last round first."""
    every = Growing(facts)
    col, blank = F.col, F.lit("")
    for step in reversed(rounds):
        gone, known = step["gone"], every.read()
        mid = gone.where("not leaf")
        asks = _union(
            [
                step["down"].select(col("dst").alias("n"), col("src").alias("node"), F.lit(ROOT).alias("kind"), col("w").cast("bigint").alias("add"), "via"),
                mid.select("n", col("chd").alias("node"), F.explode(F.array(F.lit(BELOW), F.lit(COUNT), F.lit(CYCLE))).alias("kind"), F.lit(0).cast("bigint").alias("add"), col("vi").alias("via")),
                mid.select("n", col("par").alias("node"), F.lit(CYCLE).alias("kind"), F.lit(0).cast("bigint").alias("add"), col("vi").alias("via")),
            ]
        )
        longer = F.when(col("kind") == ROOT, F.concat("path", "via", F.array("n"))).otherwise(col("path")) if paths else col("path")
        heard = known.join(asks, ["node", "kind"]).select(
            col("n").alias("node"), "kind", "key", (col("val") + col("add")).alias("val"), longer.alias("path")
        )
        own = _union(
            [
                step["sets"].select(*_facts(paths, col("owner"), BELOW, col("elem"), col("size"))),
                gone.where("is_root = 1").select(*_facts(paths, col("n"), ROOT, col("n"), F.lit(0), F.array("n"))),
                gone.select(*_facts(paths, col("n"), SELF, blank, col("weight"))),
                gone.where("own_cycle = 1").select(*_facts(paths, col("n"), CYCLE, col("n"), F.lit(-1))),
            ]
        )
        # A node lies on a cycle if its parent and its child of this round are in one strongly connected part
        # (two equal facts), else only if a cycle had shrunk to a loop on it (marked by -1).
        rows = heard.unionByName(own).repartition("node")
        if paths:
            rows = rows.groupBy("node", "kind", "key").agg(F.min(F.struct("val", "path")).alias("m"), F.count("*").alias("k")).select("node", "kind", "key", "m.val", "m.path", "k")
        else:
            rows = rows.groupBy("node", "kind", "key").agg(F.min("val").alias("val"), F.count("*").alias("k")).withColumn("path", _no_names(paths))
        w = Window.partitionBy("node")
        inner = F.max((col("kind") == CYCLE) & (col("k") >= 2) & (col("val") >= 0)).over(w)
        weight = F.max(F.when(col("kind") == SELF, col("val"))).over(w)
        has_child = F.max(F.when(col("kind") == COUNT, col("val"))).over(w)
        rows = (
            rows.withColumn("inner", inner).withColumn("weight", weight).withColumn("below", has_child)
            .where((col("kind") != CYCLE) | F.when(col("inner"), (col("k") >= 2) & (col("val") >= 0)).otherwise(col("val") == -1))
            .where("kind <> %d" % COUNT)
            .select(
                "node",
                F.when(col("kind") == SELF, F.lit(COUNT)).otherwise(col("kind")).alias("kind"),
                "key",
                F.when(col("kind") == SELF, F.when(col("inner"), col("below")).otherwise(col("weight") + F.coalesce("below", F.lit(0))))
                .when(col("kind") == CYCLE, F.lit(0)).otherwise(col("val")).cast("bigint").alias("val"),
                "path",
            )
        )
        every.add(rows)
        release(facts.sparkSession)
    return every.read()


def strong_parts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``n, part`` for the nodes that lie on cycles, ``part`` being one node of the strongly connected part.

    Nodes without parents or without children are trimmed; then the largest name that reaches a node colours
    it, and what reaches its colour's name within the colour is one part; the rest is done again.
    """
    found: list[DataFrame] = []
    e = cut(edges.select("src", "dst"))
    n = e.count()
    while True:
        while n:
            kept = cut(
                e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
                .join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            )
            before, n = n, kept.count()
            release(e.sparkSession)
            if n == before:
                break
            e = kept
        if not n:
            break
        colour = cut(e.select(F.col("src").alias("n")).distinct().withColumn("c", F.col("n")))
        while True:
            told = e.join(colour.withColumnRenamed("n", "src"), "src").select(F.col("dst").alias("n"), "c")
            new = cut(colour.withColumn("was", F.col("c")).unionByName(told.withColumn("was", F.lit(None).cast("string"))).groupBy("n").agg(F.max("c").alias("c"), F.max("was").alias("was")))
            moved = not new.where("c <> was").isEmpty()
            colour = new.select("n", "c")
            release(e.sparkSession)
            if not moved:
                break
        same = cut(
            e.join(colour.select(F.col("n").alias("src"), F.col("c").alias("cs")), "src")
            .join(colour.select(F.col("n").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("c"))
        )
        reach = cut(colour.where("n = c").select("n", "c"))
        size = reach.count()
        while True:
            more = same.join(reach.withColumnRenamed("n", "dst"), ["dst", "c"]).select(F.col("src").alias("n"), "c")
            reach = cut(reach.unionByName(more).distinct())
            before, size = size, reach.count()
            release(e.sparkSession)
            if size == before:
                break
        sizes = reach.groupBy("c").agg(F.count("*").alias("k"))
        found.append(cut(reach.join(sizes.where("k > 1").select("c"), "c").select("n", F.col("c").alias("part"))))
        done = reach.select("n")
        e = cut(e.join(done.withColumnRenamed("n", "src"), "src", "left_anti").join(done.withColumnRenamed("n", "dst"), "dst", "left_anti"))
        n = e.count()
    if not found:
        return nodes.select("n", F.col("n").alias("part")).limit(0)
    return cut(_union(found))


def _core_distances(nodes: DataFrame, edges: DataFrame, paths: bool) -> DataFrame:
    """Shortest ways from roots inside the core, only changed ones being carried on."""
    col = F.col
    start = nodes.where("is_root = 1").select(*_facts(paths, col("n"), ROOT, col("n"), F.lit(0), F.array("n")))
    known = front = cut(start)
    while not front.isEmpty():
        step = front.withColumnRenamed("node", "src").join(edges, "src").select(
            col("dst").alias("node"), "kind", "key", (col("val") + col("w")).alias("val"),
            (F.concat("path", "via", F.array("dst")) if paths else col("path")).alias("path"),
        )
        both = known.withColumn("old", F.lit(1)).unionByName(step.withColumn("old", F.lit(0)))
        best = both.groupBy("node", "kind", "key").agg(F.min(F.struct("val", "path")).alias("m"), F.min(F.when(col("old") == 1, F.struct("val", "path"))).alias("before"))
        new = cut(best.select("node", "kind", "key", "m.val", "m.path", (F.col("before").isNull() | (F.col("m") < F.col("before"))).alias("new")))
        known, front = new.drop("new"), new.where("new").drop("new")
        release(new.sparkSession)
    return known


def hierarchy(links: DataFrame, parent: str, child: str, paths: bool = False) -> DataFrame:
    """One row per linked node and root that reaches it: ``node, root, depth, path, on_cycle, n_descendants``.

    A root is a node that is never a child. ``depth`` is the fewest links from that root and ``path`` (with
    ``paths=True``) the nodes on the way, the alphabetically first of the shortest ones. A node that no
    root reaches gives one row with root '' and depth -1 (path empty). ``on_cycle`` is 1 if a node can be
    reached from itself over others; ``n_descendants`` counts the distinct other nodes that can be reached.

    Defined cases: rows with a null end and links of a node to itself are no links, repeated rows are one;
    an empty table gives no rows; further columns are ignored. Any depth, several parents per node and cycles
    are allowed. The tables of the rounds are deleted before it returns.
    """
    with scratch(links.sparkSession):
        return cut(_hierarchy(links, parent, child, paths), keep=True)


def _hierarchy(links: DataFrame, parent: str, child: str, paths: bool) -> DataFrame:
    col = F.col
    edges = links.select(col(parent).alias("src"), col(child).alias("dst")).where("src is not null and dst is not null and src <> dst").distinct()
    edges = cut(edges.select("src", "dst", F.lit(1).alias("w"), _no_names(paths).alias("via")))
    ends = edges.select(col("src").alias("n"), F.lit(1).alias("r")).unionByName(edges.select(col("dst").alias("n"), F.lit(0).alias("r")))
    nodes = cut(ends.groupBy("n").agg(F.min("r").alias("is_root")).select("n", F.lit(1).cast("bigint").alias("weight"), "is_root", F.lit(0).alias("own_cycle")))
    sets = nodes.select(col("n").alias("owner"), col("n").alias("elem"), col("weight").alias("size")).limit(0)
    rounds, core, core_edges, core_sets = contract(nodes, edges, sets, paths)
    none = nodes.select(*_facts(paths, col("n"), ROOT, col("n"), F.lit(0))).limit(0)
    if core.isEmpty():
        facts = none
    else:
        parts = strong_parts(core, core_edges)
        member = cut(core.join(parts, "n", "left").withColumn("g", F.coalesce("part", "n")))
        of = member.select("n", "g")
        merged, merged_edges, merged_sets = cut_all(
            member.groupBy(col("g").alias("n")).agg(F.sum("weight").alias("weight")).select("n", "weight", F.lit(0).alias("is_root"), F.lit(0).alias("own_cycle")),
            core_edges.join(of.select(col("n").alias("src"), col("g").alias("gs")), "src").join(of.select(col("n").alias("dst"), col("g").alias("gd")), "dst")
            .where("gs <> gd").select(col("gs").alias("src"), col("gd").alias("dst"), F.lit(1).alias("w"), _no_names(False).alias("via")).distinct(),
            core_sets.join(of.withColumnRenamed("n", "owner"), "owner").select(col("g").alias("owner"), "elem", "size").distinct(),
        )
        inner, *_ = contract(merged, merged_edges, merged_sets, False)
        below = _undo(inner, nodes.select(*_facts(False, col("n"), ROOT, col("n"), F.lit(0))).limit(0), False).where(f"kind in ({BELOW}, {COUNT})")
        shared = below.withColumnRenamed("node", "g").join(of, "g").select(col("n").alias("node"), "kind", "key", "val", _no_names(paths).alias("path"))
        cycles = member.where("part is not null or own_cycle = 1").select(*_facts(paths, col("n"), CYCLE, col("g"), F.lit(0)))
        facts = _union([shared, cycles, _core_distances(core, core_edges, paths)])
    every = _undo(rounds, facts, paths)
    info = every.where(f"kind <> {ROOT}").groupBy("node").agg(
        F.max((col("kind") == CYCLE).cast("bigint")).alias("on_cycle"),
        (F.sum(F.when(col("kind").isin(BELOW, COUNT), col("val"))) - 1).cast("bigint").alias("n_descendants"),
    )
    ways = every.where(f"kind = {ROOT}").select("node", col("key").alias("root"), col("val").alias("depth"), "path")
    return info.join(ways, "node", "left").select(
        "node",
        F.coalesce("root", F.lit("")).alias("root"),
        F.coalesce("depth", F.lit(-1)).cast("bigint").alias("depth"),
        (F.coalesce("path", _no_names(True)) if paths else _no_names(True)).alias("path"),
        "on_cycle",
        "n_descendants",
    )
