"""Graph loops against plain Python on random graphs."""
import heapq
import random

import pytest
from pyspark.sql import functions as F

from regionflow.operators import graph, network


def random_edges(seed, n, m):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    return [(a, b, round(rng.uniform(1, 9), 3)) for a, b in sorted(pairs)]


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def components(n, edges):
    parent = list(range(n))
    for a, b, _ in edges:
        a, b = sorted((find(parent, a), find(parent, b)))
        parent[b] = a
    return {x: find(parent, x) for x in range(n)}


@pytest.mark.parametrize("seed,n,m", [(1, 40, 25), (2, 60, 70)])
def test_components_and_tree(spark, seed, n, m):
    edges = random_edges(seed, n, m)
    frame = spark.createDataFrame(edges, "a int, b int, length double")
    links = frame.select(F.col("a").alias("u"), F.col("b").alias("v"))
    nodes = spark.range(n).select(F.col("id").cast("int").alias("node"))
    found = {r.node: r.component for r in graph.connected_components(links, nodes).collect()}
    assert found == components(n, edges)
    parent, tree = list(range(n)), set()
    for length, a, b in sorted((w, a, b) for a, b, w in edges):
        ra, rb = find(parent, a), find(parent, b)
        if ra != rb:
            parent[rb] = ra
            tree.add((a, b))
    assert {(r.a, r.b) for r in graph.spanning_tree(frame).collect()} == tree


def test_long_chain_is_one_component(spark):
    order = list(range(300))
    random.Random(4).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:])), "u int, v int")
    assert {r.component for r in graph.connected_components(links).collect()} == {0}


def test_shortest_paths(spark):
    edges = random_edges(5, 30, 60)
    frame = spark.createDataFrame([(a, b, w) for a, b, w in edges], "u int, v int, length double")
    sources = spark.createDataFrame([(100, 0), (100, 3), (200, 7)], "source int, node int")
    found = {(r.source, r.node): r.dist for r in graph.shortest_from_groups(frame, sources).collect()}
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    truth = {}
    for source, starts in ((100, (0, 3)), (200, (7,))):
        heap, seen = [(0.0, s) for s in starts], {}
        while heap:
            d, x = heapq.heappop(heap)
            if x not in seen:
                seen[x] = d
                for y, w in near.get(x, []):
                    heapq.heappush(heap, (d + w, y))
        truth.update({(source, x): d for x, d in seen.items()})
    assert found == pytest.approx(truth)


def test_capacity_equals_the_recursion(spark):
    rng = random.Random(6)
    n, parent = 40, {0: None}
    for x in range(1, n):
        parent[x] = rng.randint(max(0, x - 3), x - 1)
    capacity = {x: rng.uniform(0, 100) for x in range(n)}
    tree = spark.createDataFrame([(p, x) for x, p in parent.items() if p is not None], "a int, b int")
    rooted = graph.root_tree(tree, spark.createDataFrame([(0,)], "node int"))
    frame = spark.createDataFrame(list(capacity.items()), "node int, capacity double")
    found = {r.node: r.grid for r in graph.propagate_capacity(rooted, frame, 0.9, 0.8, 1.3).collect()}

    def grid(x):
        return capacity[x] * 1.3 + sum(grid(y) / 0.9 / 0.8 for y, p in parent.items() if p == x)
    assert found == pytest.approx({x: grid(x) for x in range(n)})


@pytest.fixture
def cuts(monkeypatch):
    """How often a loop has cut its lineage."""
    made, cut = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: made.append(1) or cut(df))
    return made


def test_rooted_trees(spark):
    rng = random.Random(6)
    links = [(f"n{rng.randrange(k):03d}", f"n{k:03d}") for k in range(1, 120)] + [("x1", "x2"), ("x2", "x3"), ("y1", "y2")]
    links = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in links]
    near = {}
    for a, b in links:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    want = {}
    for root in ("n017", "x2", "alone"):  # y has no root
        todo = [(root, None, 0)]
        for node, parent, depth in todo:
            want[node] = (parent, depth, root)
            todo += [(other, node, depth + 1) for other in near.get(node, []) if other != parent]
    tree = spark.createDataFrame(links, "a string, b string")
    got = graph.root_tree(tree, spark.createDataFrame([("n017",), ("x2",), ("alone",)], "node string")).collect()
    assert {r.node: (r.parent, r.depth, r.root) for r in got} == want and len(got) == len(want)
    assert graph.root_tree(tree.limit(0), spark.createDataFrame([("n017",)], "node string")).count() == 1


def test_long_path_is_rooted_in_few_rounds(spark, cuts):
    n = 10_000
    order = list(range(n))
    random.Random(2).shuffle(order)
    tree = spark.createDataFrame(list(zip(order, order[1:])), "a int, b int")
    got = {r.node: (r.parent, r.depth) for r in graph.root_tree(tree, spark.createDataFrame([(order[0],)], "node int")).collect()}
    assert got == {v: (order[k - 1] if k else None, k) for k, v in enumerate(order)}
    assert len(cuts) < 22


def test_long_path_is_unrolled_in_few_rounds(spark, cuts):
    n = 10_000
    best = spark.createDataFrame([(s, k, None if k == 0 else k - 1) for s in (1, 2) for k in range(n)],
                                 "source int, node int, pred int")
    ends = spark.createDataFrame([(1, 7, n - 1), (2, 8, 4097), (2, 9, 0)], "source int, target int, node int")
    rows = graph.walk_back(ends, best)
    for target, last in ((7, n - 1), (8, 4097), (9, 0)):
        got = rows.filter(F.col("target") == target).orderBy("back").select("back", "node").collect()
        assert [tuple(r) for r in got] == [(k, last - k) for k in range(last + 1)]
    assert len(cuts) < 34


def region_network(seed):
    """Edges ``u, v, length, region``: small owned stars, joined by unowned chains of several lengths."""
    rng = random.Random(seed)
    names = iter(rng.sample(range(10_000), 300))
    regions, edges = [], []
    for region in range(5):
        nodes = [next(names) for _ in range(rng.randint(2, 4))]
        regions.append(nodes)
        edges += [(a, b, rng.uniform(1, 9), region) for a, b in zip(nodes, nodes[1:])]
    free = [next(names) for _ in range(3)]
    places = [x for nodes in regions for x in nodes] + free
    for _ in range(14):
        a, b = rng.choice(places), rng.choice(places)  # also back to the start
        way = [a, *[next(names) for _ in range(rng.randint(0, 6) if a != b else 3)], b]
        edges += [(x, y, rng.uniform(1, 9), None) for x, y in zip(way, way[1:])]
    ring = [next(names) for _ in range(5)]  # closed, reached by nothing
    return edges + [(x, y, 1.0, None) for x, y in zip(ring, ring[1:] + ring[:1])]


def test_region_distances_over_chains(spark):
    edges = region_network(3)
    owned, near = {}, {}
    for a, b, w, region in edges:
        if region is not None:
            owned.setdefault(region, set()).update((a, b))
        for x, y in ((a, b), (b, a)):
            if (y not in near.setdefault(x, {})) or w < near[x][y][0]:
                near[x][y] = (w, region)
    want, kept = {}, {}
    for a in owned:
        heap, seen = [(0.0, s, (s,)) for s in owned[a]], {}
        while heap:
            d, x, way = heapq.heappop(heap)
            if x not in seen:
                seen[x] = d, way
                for y, (w, _) in near[x].items():
                    heapq.heappush(heap, (d + w, y, (*way, y)))
        for b in owned:
            reached = [(seen[x][0], x) for x in owned[b] if x in seen]
            if a < b and reached and not owned[a] & owned[b]:
                d, x = min(reached)
                way = seen[x][1]
                want[a, b] = d, list(way)
                if all(near[p][q][1] in (None, a, b) for p, q in zip(way, way[1:])):
                    kept[a, b] = want[a, b]
    frame = spark.createDataFrame(edges, "u int, v int, length double, region_id int")
    nodes = spark.createDataFrame([(r, x) for r, xs in owned.items() for x in xs], "region_id int, node int")
    assert kept and len(kept) < len(want)
    for over, truth in ((True, want), (False, kept)):
        pairs, search = network.region_distances(frame, nodes, over_third_regions=over)
        got = {(r.a, r.b): r.length for r in pairs.collect()}
        assert got == pytest.approx({pair: d for pair, (d, _) in truth.items()})
        ways = {}
        for r in network.connection_paths(pairs, search).orderBy("a", "b", "seq").collect():
            ways.setdefault((r.a, r.b), []).append((r.seq, r.node))
        assert ways == {pair: list(enumerate(way)) for pair, (_, way) in truth.items()}


def test_ways_without_length_and_ways_through_others(spark):
    # 1 -(0)- own edge of 2 without length - 3's edge in between; the direct way of 1 to 4 is longer than that through 2.
    edges = [(1, 2, 1.0, 1), (2, 3, 2.0, None), (3, 4, 0.0, 2), (4, 5, 2.0, None), (5, 6, 1.0, 3), (2, 7, 3.0, None),
             (7, 6, 9.0, None), (6, 8, 1.0, None), (8, 9, 1.0, 4)]
    frame = spark.createDataFrame(edges, "u int, v int, length double, region_id int")
    nodes = spark.createDataFrame([(r, x) for a, b, _, r in edges if r for x in (a, b)], "region_id int, node int")
    got = {(r.a, r.b): r.length for r in network.region_distances(frame, nodes, over_third_regions=False)[0].collect()}
    assert got == {(1, 2): 2.0, (2, 3): 2.0, (3, 4): 1.0}
    every = {(r.a, r.b): r.length for r in network.region_distances(frame, nodes)[0].collect()}
    assert every == {(1, 2): 2.0, (1, 3): 4.0, (1, 4): 6.0, (2, 3): 2.0, (2, 4): 4.0, (3, 4): 1.0}
    assert network.region_distances(frame.limit(0), nodes.limit(0))[0].count() == 0
