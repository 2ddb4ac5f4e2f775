"""Graph operators as short driver loops over DataFrames.

Every round is joins and partially combined aggregates; lineage is cut each round. Nodes may be
of any orderable type (numbers, strings, point structs).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionflow.scale import attach, cut_lineage, running, with_totals

c = F.col


def _both_ways(edges: DataFrame, *carry: str) -> DataFrame:
    return (edges.select(c("u").alias("a"), c("v").alias("b"), *carry)
            .unionByName(edges.select(c("v").alias("a"), c("u").alias("b"), *carry)))


def _follow(pointers: DataFrame) -> DataFrame:
    """Replace every pointer by its end: doubling, so logarithmic in the longest chain."""
    while True:
        targets = pointers.select(c("node").alias("parent"), c("parent").alias("_next"))
        # many nodes point at the same parent, so the lookup must tolerate a hot key
        pointers = cut_lineage(
            attach(pointers, targets, ["parent"])
            .select("node", F.coalesce("_next", "parent").alias("parent"),
                    (c("_next").isNotNull() & (c("_next") != c("parent"))).alias("moved")))
        moved = not pointers.filter("moved").isEmpty()
        pointers = pointers.select("node", "parent")
        if not moved:
            return pointers


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``node, component`` (the component's smallest node) from edges ``u, v``.

    Each round every component of the contracted graph points to its smallest neighbour if that
    is smaller; pointer chains are collapsed, edges relabelled and de-duplicated. Neighbour
    minima are partially combined, so the growing components do not create a hot task. Rounds
    are logarithmic on street-like graphs.
    """
    every = edges.select(c("u").alias("node")).unionByName(edges.select(c("v").alias("node")))
    if nodes is not None:
        every = every.unionByName(nodes.select("node"))
    labels = cut_lineage(every.distinct().withColumn("component", c("node")))
    left = cut_lineage(edges.filter(c("u") != c("v")).select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    while not left.isEmpty():
        hooks = (_both_ways(left).groupBy("a").agg(F.min("b").alias("low"))
                 .select(c("a").alias("node"), F.least("a", "low").alias("parent")))
        pointers = _follow(cut_lineage(hooks))

        def relabel(rows: DataFrame, column: str) -> DataFrame:
            lookup = pointers.select(c("node").alias(column), c("parent").alias("_to"))
            return (attach(rows, lookup, [column])
                    .withColumn(column, F.coalesce("_to", column)).drop("_to"))

        labels = cut_lineage(relabel(labels, "component"))
        left = relabel(relabel(left, "u"), "v").filter(c("u") != c("v"))
        left = cut_lineage(left.select(
            F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    return labels


def components_by(edges: DataFrame, key: str) -> DataFrame:
    """Components inside each value of ``key``: ``key, node, component``."""
    keyed = edges.filter(c(key).isNotNull()).select(
        F.struct(c(key).alias("k"), c("u").alias("n")).alias("u"),
        F.struct(c(key).alias("k"), c("v").alias("n")).alias("v"))
    return connected_components(keyed).select(
        c("node.k").alias(key), c("node.n").alias("node"), c("component.n").alias("component"))


def spanning_tree(connections: DataFrame) -> DataFrame:
    """Minimum spanning forest of ``a, b, length`` (a < b), ties broken by (length, a, b).

    Boruvka rounds: every component picks its cheapest outgoing edge. The total order makes the
    picks cycle-free apart from mutual ones, which are the same edge; so the picks themselves are the pointers that
    one doubling loop collapses.
    """
    edges = cut_lineage(connections.select("a", "b", "length").groupBy("a", "b").agg(
        F.min("length").alias("length")))
    empty = edges.limit(0)
    tree = empty
    live = edges.withColumns({"u": c("a"), "v": c("b")})
    while not live.isEmpty():
        ranked = live.withColumn("e", F.struct("length", "a", "b"))
        picks = cut_lineage(_both_ways(ranked, "e").groupBy("a").agg(F.min("e").alias("e"), F.min_by("b", "e").alias("to"))
                            .select(c("a").alias("node"), "e", "to"))
        tree = tree.unionByName(cut_lineage(picks.select("e.a", "e.b", "e.length").distinct()))
        # The picks are pointers already: of two components that picked each other the smaller is the root.
        back = picks.select(c("node").alias("to"), c("to").alias("_back"))
        pointers = _follow(cut_lineage(attach(picks.select("node", "to"), back, ["to"]).select(
            "node", F.when((c("_back") == c("node")) & (c("node") < c("to")), c("node")).otherwise(c("to")).alias("parent"))))

        def relabel(rows: DataFrame, column: str) -> DataFrame:
            lookup = pointers.select(c("node").alias(column), c("parent").alias("_to"))
            return (attach(rows, lookup, [column])
                    .withColumn(column, F.coalesce("_to", column)).drop("_to"))

        live = cut_lineage(relabel(relabel(live, "u"), "v").filter(c("u") != c("v")))
    return tree


def root_tree(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """``node, parent, depth, root`` of the trees ``a, b`` that hold a row of ``roots`` (column ``node``).

    An Euler tour: each link is walked both ways, and after the way into a node comes the way to the neighbour that
    follows in the node's sorted circle of neighbours. The tour of a rooted tree is cut where it would start again at
    the root; its ways are ranked by pointer doubling. The earlier way over a link leads down, and the depth is the
    running sum of ways down and up. Rounds are logarithmic in the size of a tree, also where it is one long path.
    Every tree needs one root at most; trees without one are left out.
    """
    ways = _both_ways(tree.select(c("a").alias("u"), c("b").alias("v"))).filter(c("a") != c("b")).distinct()
    around = with_totals(running(cut_lineage(ways), ["a"], ["b"], following={"_after": "b"}), ["a"], _first=F.min("b"))
    starts = roots.select("node").distinct()
    # The row of node a and neighbour b says what follows the way from b into a.
    ends_here = c("_after").isNull() & c("_root").isNotNull()
    tour = around.join(starts.select(c("node").alias("a"), F.lit(True).alias("_root")), "a", "left").select(
        c("b").alias("u"), c("a").alias("v"), F.when(~ends_here, c("a")).alias("pu"),
        F.when(~ends_here, F.coalesce("_after", "_first")).alias("pv"),
        F.when(ends_here, c("a")).alias("root"), F.when(ends_here, 0).otherwise(1).cast("long").alias("left"))
    tour, ranked = cut_lineage(tour), -1
    while True:
        done = tour.filter(c("pu").isNull()).count()
        if done == ranked:  # each round ranks more ways of every rooted tour, so only unrooted ones are left
            break
        ranked = done
        further = tour.select(c("u").alias("pu"), c("v").alias("pv"), c("pu").alias("_pu"), c("pv").alias("_pv"),
                              c("root").alias("_root"), c("left").alias("_left"))
        step = tour.filter(c("pu").isNotNull()).join(further, ["pu", "pv"]).select(
            "u", "v", c("_pu").alias("pu"), c("_pv").alias("pv"), c("_root").alias("root"),
            (c("left") + c("_left")).alias("left"))
        tour = cut_lineage(tour.filter(c("pu").isNull()).unionByName(step))
    ranks = tour.filter(c("root").isNotNull()).select("root", "u", "v", (-c("left")).alias("at"))
    back = ranks.select(c("u").alias("v"), c("v").alias("u"), c("at").alias("_back"))
    walked = ranks.join(back, ["u", "v"]).withColumn("_down", c("at") < c("_back"))
    walked = running(cut_lineage(walked.withColumn("_step", F.when(c("_down"), 1).otherwise(-1))), ["root"], ["at"],
                     sums={"_depth": "_step"})
    kind = roots.schema["node"].dataType
    return (starts.select("node", F.lit(None).cast(kind).alias("parent"), F.lit(0).alias("depth"), c("node").alias("root"))
            .unionByName(walked.filter("_down").select(c("v").alias("node"), c("u").alias("parent"),
                                                       c("_depth").cast("int").alias("depth"), "root")))


def propagate_capacity(rooted: DataFrame, capacity: DataFrame, grid_efficiency: float,
                       pipe_efficiency: float, factor: float = 1.0) -> DataFrame:
    """Capacities after the source feeds its tree: per node ``grid``, ``inflow`` (the pipe from its
    parent, or the central output at the root).

    A node carries its own capacity times ``factor`` plus its subtree, each hop divided by both
    efficiencies. Subtree sums are built by doubling: after round k a node holds its descendants
    nearer than 2^k hops, and its 2^k-th ancestor takes that sum over, attenuated. Work per round
    is linear and rounds are logarithmic in the depth.
    """
    hop = 1.0 / (grid_efficiency * pipe_efficiency)
    state = cut_lineage(
        rooted.join(capacity.select("node", "capacity"), "node", "left")
        .select("node", "parent", "root", "depth", c("parent").alias("jump"),
                (F.coalesce("capacity", F.lit(0.0)) * factor).alias("grid")))
    weight = hop
    while not state.filter(c("jump").isNotNull()).isEmpty():
        handed = (state.filter(c("jump").isNotNull()).groupBy("jump")
                  .agg((F.sum("grid") * weight).alias("_more"))
                  .withColumnRenamed("jump", "node"))
        further = state.select(c("node").alias("jump"), c("jump").alias("_next"))
        grown = state.join(handed, "node", "left").withColumn(
            "grid", c("grid") + F.coalesce("_more", F.lit(0.0))).drop("_more")
        state = cut_lineage(attach(grown, further, ["jump"]).select(
            "node", "parent", "root", "depth", c("_next").alias("jump"), "grid"))
        weight *= weight
    return state.select("node", "parent", "root", "depth", "grid",
                        (c("grid") / grid_efficiency).alias("inflow"))


def contract(edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace every chain of nodes with two neighbours by one link; the nodes of ``keep`` (``node``) stay.

    ``edges``: ``u, v, length, owner``; of parallel ones the shortest counts. Returns the links ``u, v, length, owner,
    chain`` (u < v; ``chain``, the smallest node inside, is NULL for an edge that stays) and the edges of the chains
    ``u, v, ku, kv, chain``, where ``ku`` and ``kv`` are NULL at the outer ends. Chains that lead back to their start
    are left out, so are closed rings without a node that stays. Lengths are summed exactly, in any order the same.
    """
    plain = cut_lineage(edges.filter(c("u") != c("v")).groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
                        .agg(F.min(F.struct("length", "owner")).alias("_e")).select("u", "v", "_e.length", "_e.owner"))
    inner = cut_lineage(_both_ways(plain).groupBy(c("a").alias("node")).count().filter("count = 2").select("node")
                        .join(keep.select("node").distinct(), "node", "left_anti"))
    between = (plain.select("u", "v").join(inner.withColumnRenamed("node", "u"), "u", "left_semi")
               .join(inner.withColumnRenamed("node", "v"), "v", "left_semi"))
    labels = connected_components(between, inner)
    filed = cut_lineage(
        plain.join(labels.select(c("node").alias("u"), c("component").alias("ku")), "u", "left")
        .join(labels.select(c("node").alias("v"), c("component").alias("kv")), "v", "left")
        .withColumn("chain", F.coalesce("ku", "kv")))
    end = F.when(c("ku").isNull(), c("u")).when(c("kv").isNull(), c("v"))
    chains = (filed.filter(c("chain").isNotNull()).groupBy("chain")
              .agg(F.min(end).alias("u"), F.max(end).alias("v"),
                   F.sum(c("length").cast("decimal(38,15)")).cast("double").alias("length"))
              .filter(c("u") < c("v")))
    links = (filed.filter(c("chain").isNull()).select("u", "v", "length", "owner", "chain")
             .unionByName(chains.withColumn("owner", F.lit(None).cast(plain.schema["owner"].dataType)))
             .groupBy("u", "v").agg(F.min(F.struct("length", "chain", "owner")).alias("_e"))
             .select("u", "v", "_e.length", "_e.owner", "_e.chain"))
    return cut_lineage(links), filed.filter(c("chain").isNotNull()).select("u", "v", "ku", "kv", "chain")


def chain_places(inside: DataFrame) -> DataFrame:
    """``chain, node, place`` (from 0 at the smaller outer end, ``size`` in all) of the nodes in chains of :func:`contract`.

    A chain is rooted as a tree at its first node, so rounds are logarithmic in its length.
    """
    outer = F.when(c("ku").isNull(), F.struct(c("u").alias("end"), c("v").alias("node"))).when(
        c("kv").isNull(), F.struct(c("v").alias("end"), c("u").alias("node")))
    first = cut_lineage(inside.groupBy("chain").agg(F.min(outer).alias("_o")).select("chain", c("_o.node").alias("node")))
    steps = inside.filter(c("ku").isNotNull() & c("kv").isNotNull()).select(c("u").alias("a"), c("v").alias("b"))
    rooted = root_tree(steps, first.select("node"))
    places = rooted.join(first.select("chain", c("node").alias("root")), "root").select(
        "chain", "node", c("depth").alias("place"))
    return cut_lineage(with_totals(cut_lineage(places), ["chain"], size=F.count(F.lit(1))))


#: Rounds after which the appended labels of a search are merged to one per source and node, and ended sources leave.
_MERGE_ROUNDS = 4


def shortest_from_groups(edges: DataFrame, sources: DataFrame, max_length: float | None = None,
                         own_ways: bool = False) -> DataFrame:
    """Shortest length from each source group to every reachable node, with predecessor.

    ``edges``: ``u, v, length``, and ``chain``, ``owner`` if known; ``sources``: ``source, node``. Returns ``source,
    node, dist, pred, chain, owner, third``: ``chain`` is that of the last step. ``third`` says that the way uses an edge
    owned by another than its source; edges without length count only once they belong to two others, and ``owner``
    is the first of these. ``pred`` is NULL at sources; of ways of one length the one with fewest steps counts, then
    the one with the smallest predecessor. All groups relax together; only nodes whose distance just improved are
    expanded, and improvements are appended. ``max_length`` bounds the search. With ``own_ways`` only the rows that are
    not ``third`` are complete, and a source ends when none of those can appear or change any more: no new one was
    found, and every new way is at least as long as all of them.
    """
    node_kind, source_kind = (sources.schema[name].dataType for name in ("node", "source"))
    for name, kind in (("chain", node_kind), ("owner", source_kind)):
        if name not in edges.columns:
            edges = edges.withColumn(name, F.lit(None).cast(kind))
    links = cut_lineage(_both_ways(edges, "length", "chain", "owner").groupBy("a", "b").agg(
        F.min(F.struct("length", "chain", "owner")).alias("_e")).select(
        "a", "b", c("_e.length").alias("_length"), c("_e.chain").alias("_chain"), c("_e.owner").alias("_owner")))
    label = ["dist", "pred", "chain", "owner", "third"]
    front = cut_lineage(sources.select("source", "node").distinct().select(
        "source", "node", F.lit(0.0).alias("dist"), F.lit(None).cast(node_kind).alias("pred"),
        F.lit(None).cast(node_kind).alias("chain"), F.lit(None).cast(edges.schema["owner"].dataType).alias("owner"),
        F.lit(False).alias("third")))
    found = [front]

    def every() -> DataFrame:
        rows = found[0]
        for more in found[1:]:
            rows = rows.unionByName(more)
        return rows

    def merged() -> DataFrame:  # a later label of a node is always a shorter one
        return every().groupBy("source", "node").agg(F.min(F.struct(*label)).alias("_l")).select("source", "node", "_l.*")

    foreign = c("_owner").isNotNull() & (c("_owner") != c("source"))
    passed = foreign & ((c("_length") > 0) | F.coalesce(c("owner") != c("_owner"), F.lit(False)))
    while True:
        steps = front.join(links, front["node"] == links["a"]).select(
            "source", c("b").alias("node"), (c("dist") + c("_length")).alias("dist"), c("a").alias("pred"),
            c("_chain").alias("chain"), F.when(foreign, F.coalesce("owner", "_owner")).otherwise(c("owner")).alias("owner"),
            (c("third") | passed).alias("third"))
        if max_length is not None:
            steps = steps.filter(c("dist") <= max_length)
        offers = steps.select("source", "node", F.struct(*label).alias("_offer"), F.lit(None).cast("double").alias("_known"))
        known = every().select("source", "node", F.lit(None).cast(offers.schema["_offer"].dataType).alias("_offer"),
                               c("dist").alias("_known"))
        improved = cut_lineage(
            offers.unionByName(known).groupBy("source", "node").agg(F.min("_offer").alias("_offer"), F.min("_known").alias("_known"))
            .filter(c("_offer").isNotNull() & (c("_known").isNull() | (c("_offer.dist") < c("_known"))))
            .select("source", "node", "_offer.*"))
        if improved.isEmpty():
            return merged()
        found.append(improved)
        front = improved
        if len(found) > _MERGE_ROUNDS:
            found = [cut_lineage(merged())]
            if own_ways:
                reach = found[0].groupBy("source").agg(F.max(F.when(~c("third"), c("dist"))).alias("_far"))
                going = improved.groupBy("source").agg(F.bool_or(~c("third")).alias("_going"))
                front = attach(improved, reach.join(going, "source"), ["source"]).filter(
                    c("_going") | (c("dist") < c("_far"))).select(improved.columns)


def walk_back(ends: DataFrame, best: DataFrame) -> DataFrame:
    """Nodes of the shortest paths that end at ``ends`` (``source, target, node``).

    Rows ``source, target, back, node``; ``back`` counts from the end of the path. Jump pointers lead 1, 2, 4, ...
    nodes back; a path is unrolled by its longest jumps first, each round from all nodes found so far, so every node
    is found once, by the binary digits of its ``back``. Rounds are logarithmic in the longest path.
    """
    sources = ends.select("source").distinct()
    jump = cut_lineage(best.filter(c("pred").isNotNull()).join(sources, "source", "left_semi")
                       .select("source", "node", c("pred").alias("to")))
    jumps = []
    while not jump.isEmpty():
        jumps.append(jump)
        further = jump.select("source", c("node").alias("to"), c("to").alias("_next"))
        jump = cut_lineage(jump.join(further, ["source", "to"]).select("source", "node", c("_next").alias("to")))
    rows = cut_lineage(ends.select("source", "target", F.lit(0).alias("back"), "node"))
    for power in reversed(range(len(jumps))):
        found = rows.join(jumps[power], ["source", "node"]).select(
            "source", "target", (c("back") + (1 << power)).alias("back"), c("to").alias("node"))
        rows = cut_lineage(rows.unionByName(found))
    return rows
