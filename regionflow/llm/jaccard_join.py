"""Exact self-join on the Jaccard similarity of word-shingle sets, by grouped prefixes.

1. Every text becomes a sorted set of hashed shingles; documents with equal sets are one node.
2. A sketch of shingle counts (one array of fixed size, whatever the corpus) gives one global order: shingles from
   rare to frequent, ties by hash. Any order gives the same result; a good one gives few candidates.
3. A set's prefix, its first ``n - ceil(t * n) + 1`` shingles in that order, must share a shingle with the prefix of
   every set at similarity ``t`` or more. Nodes with identical prefixes and sizes form one group, which posts its
   prefix once; group pairs that share a posting and whose sizes can reach ``t`` are candidates.
4. Before any text is fetched candidates must pass two bounds that no link fails: the places of a shared shingle in both
   prefixes leave room for the overlap, and parity bits of both sets (a bit or two per shingle) differ in no more places
   than the sets may. In a large corpus most lists hold unrelated texts that share a few words, and end here.
5. Candidates are expanded to their members and verified on full sets, in two steps that lose no link between
   components yet never emit all pairs of a list: first each posting list's first group against the others; what
   is linked then needs no further test. Lists that still hold several components are tested in full between
   components: short lists as pairs; long ones fall apart into what the bounds hold together, and what is still long
   is tested as blocks against blocks inside tasks, which emit only links.

Components need no more links than connect them. ``count_links`` asks for the links of each document as well: then
every candidate pair is tested, also inside components, and none is lost.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regionflow.llm.common import (attach_by_digest, column_of, finished, not_null_id, numbered, packed, stored, text_slices, unpacked,
                                   whole_text)
from regionflow.llm.shingles import Shingler, set_digest
from regionflow.llm.url_filter import superset_filter
from regionflow.operators.graph import connected_components

#: Cells of the count sketch; the broadcast order table has one byte each.
SKETCH_CELLS = 1 << 23
_SKETCH_PARTS = 64
#: Order classes for each doubling of a cell's count: in a large corpus a cell holds many shingles that occur once, and a
#: shingle must stand out from their sum.
_CLASSES = 12
#: A posting list with more nodes left is tested in blocks, a shorter one as pairs.
SHORT_LIST = 32
#: Nodes in a block.
BLOCK_NODES = 128
#: Rows of a longer list that a task compares by their bounds at once.
UNIT_ROWS = 2048
#: Words of 64 parity bits for a set at most.
_MOST_WORDS = 512

_SETS = "doc_id bigint, content bigint, n int, sig binary, prefix array<bigint>, bits binary"


def prefix_length(n: int, percent: int) -> int:
    return n - math.ceil(n * percent / 100) + 1


def _sketch(docs: DataFrame, width: int):
    """Order class of each sketch cell: the logarithm of the shingles counted in it, in steps, as bytes."""
    size = SKETCH_CELLS // _SKETCH_PARTS

    def count(batches):
        import numpy as np
        import pyarrow as pa
        # a task's counts end at 255, which is frequent enough for any order
        shingler, cells = Shingler(width), np.zeros(SKETCH_CELLS, np.uint8)
        for batch in batches:
            for _, texts in text_slices(batch.column(0)):
                hashes = np.concatenate(shingler.sets(texts))
                where, times = np.unique(hashes & np.uint64(SKETCH_CELLS - 1), return_counts=True)
                cells[where] = np.minimum(cells[where] + times, 255)
        if cells.any():
            parts = cells.reshape(_SKETCH_PARTS, size)
            yield pa.RecordBatch.from_arrays([pa.array(range(_SKETCH_PARTS), pa.int32()),
                                              pa.array([p.tobytes() for p in parts], pa.binary())],
                                             names=["part", "cells"])

    def add(batches):
        """Sums per part of what the task holds; a part's rows come together, one part at a time."""
        import numpy as np
        import pyarrow as pa
        sums = {}
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = np.frombuffer(cells.as_buffer(), np.uint8)
                if part not in sums:
                    sums[part] = np.zeros(size, np.int64)
                sums[part] += values
        kinds = [np.minimum(_CLASSES * np.log2(np.maximum(v, 1)), 255).round().astype(np.uint8).tobytes()
                 for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(kinds, pa.binary())],
                                         names=["part", "cells"])

    counted = docs.mapInArrow(count, "part int, cells binary").repartition(_SKETCH_PARTS, "part")
    classes = bytearray(SKETCH_CELLS)
    for part, cells in counted.mapInArrow(add, "part int, cells binary").collect():  # 64 rows, 8 MB in all
        classes[part * size:(part + 1) * size] = cells
    return docs.sparkSession.sparkContext.broadcast(bytes(classes))


def _sets(docs: DataFrame, order, width: int, percent: int) -> DataFrame:
    """Size, digest, prefix and parity bits of every document's set."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        shingler, classes = Shingler(width), np.frombuffer(order.value, np.uint8)
        for batch in batches:
            for start, texts in text_slices(batch.column(2)):
                sizes, sigs, prefixes, bits = [], [], [], []
                for hashes in shingler.sets(texts):
                    n = len(hashes)
                    sizes.append(n)
                    sigs.append(set_digest(hashes))
                    rank = classes[(hashes & np.uint64(SKETCH_CELLS - 1)).astype(np.int64)]
                    kept = np.argsort(rank, kind="stable")[:prefix_length(n, percent) if n else 0]
                    prefixes.append(hashes[kept].view(np.int64))
                    bits.append(parity_bits(hashes))
                bounds = np.cumsum([0, *map(len, prefixes)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), batch.column(1).slice(start, len(texts)),
                     pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(prefixes), pa.int64())),
                     pa.array(bits, pa.binary())],
                    names=["doc_id", "content", "n", "sig", "prefix", "bits"])
    return docs.mapInArrow(run, _SETS)


def parity_bits(hashes) -> bytes:
    """For each value of a hash's low bits whether an odd number of the set's hashes has it; at least a bit per hash, in
    words of 64, a power of two of them (``_MOST_WORDS`` at most)."""
    import numpy as np
    size = 64
    while size < min(len(hashes), 64 * _MOST_WORDS):
        size *= 2
    odd = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(first, second, sizes, sizes2, percent: int):
    """Whether sets may be as similar as asked, by Arrow columns of their parity bits and arrays of their sizes.

    Sets differ in at least as many hashes as their parity bits differ in places; longer bits are folded to the length
    of the others, which keeps them parities.
    """
    import numpy as np
    import pyarrow.compute as pc
    both = sizes.astype(np.int64) + sizes2
    words, words2 = (pc.binary_length(c).to_numpy(zero_copy_only=False) // 8 for c in (first, second))
    answer = np.zeros(len(both), bool)

    def taken(column, rows, length, shared):
        found = column.take(rows)
        begin = np.frombuffer(found.buffers()[1], np.int32)[found.offset]
        bits = np.frombuffer(found.buffers()[2], np.uint64, count=len(found) * length, offset=int(begin))
        return np.bitwise_xor.reduce(bits.reshape(len(found), length // shared, shared), axis=1)

    lengths = words * (_MOST_WORDS + 1) + words2
    for a, b in (divmod(int(x), _MOST_WORDS + 1) for x in np.unique(lengths)):
        alike, shared = np.flatnonzero((words == a) & (words2 == b)), min(a, b)
        step = max(1, (1 << 19) // max(a, b))
        for rows in (alike[k:k + step] for k in range(0, len(alike), step)):
            differ = np.bitwise_count(taken(first, rows, a, shared) ^ taken(second, rows, b, shared)).sum(axis=1, dtype=np.int64)
            answer[rows] = (100 + percent) * (both[rows] - differ) >= 2 * percent * both[rows]
    return answer


def verified(units: DataFrame, source: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``u, v`` among candidates.

    ``units`` has ``unit, side, node, label``: in each unit every node of side 0 (at most ``BLOCK_NODES``) is tested
    against every node of side 1 with another label. Side 1 streams past, so it may be of any length. Texts are
    fetched by the rows that ``nodes`` names; a filter of bounded size spares most others the way.
    """
    units = stored(units)
    wanted = nodes.select("node", "key", "content").join(units, "node")
    passing = superset_filter(wanted.select(F.xxhash64("key", "content").alias("k")).distinct(), "k")
    finished(units)
    rows = source.filter(passing.contains(F.xxhash64("key", "content"))).join(wanted, ["key", "content"])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        shingler = Shingler(width)
        now, left = None, []

        def tested(rows):
            """Pairs that link between the held side and ``rows`` (node, label, set)."""
            if not left or not rows or len({label for _, label, _ in left + rows}) == 1:
                return
            for a in range(0, len(rows), BLOCK_NODES):
                part = rows[a:a + BLOCK_NODES]
                sizes = np.array([len(s) for _, _, s in part])
                flat = np.concatenate([s for _, _, s in part])
                ends = np.concatenate([[0], np.cumsum(sizes)])
                if len(left) == 1:
                    shared = [np.add.reduceat(np.isin(flat, left[0][2], assume_unique=False, kind="sort").astype(
                        np.int64), ends[:-1])]
                else:
                    shared = _overlaps([s for _, _, s in left], flat, ends)
                for (node, label, own), row in zip(left, shared):
                    union = len(own) + sizes - row
                    for k in np.flatnonzero(100 * row >= percent * union).tolist():
                        if part[k][0] != node and part[k][1] != label:
                            yield min(node, part[k][0]), max(node, part[k][0])

        for batch in batches:
            for start, texts in text_slices(batch.column(4)):
                units_, sides, nodes, labels = (batch.column(k).slice(start, len(texts)).to_pylist() for k in range(4))
                links, rows = [], []
                for unit, side, node, label, hashes in zip(units_, sides, nodes, labels, shingler.sets(texts)):
                    if unit != now:
                        links += tested(rows)
                        now, left, rows = unit, [], []
                    (rows if side else left).append((node, label, hashes))
                links += tested(rows)
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in links], pa.int64()),
                                                      pa.array([v for _, v in links], pa.int64())], names=["u", "v"])

    return (rows.repartition("unit").sortWithinPartitions("unit", "side")
            .select("unit", "side", "node", "label", "text").mapInArrow(run, "u bigint, v bigint").distinct())


def _overlaps(left: list, flat, ends):
    """Shared hashes of each left set with each of the sets in ``flat``, by products of incidence matrices."""
    import numpy as np
    known = np.unique(np.concatenate(left))
    place = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    hit = known[place] == flat
    columns, place = np.unique(place[hit], return_inverse=True)  # only hashes on both sides matter
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[hit]
    total = np.zeros((len(left), len(ends) - 1), np.int64)
    where = np.searchsorted(known[columns], np.concatenate(left))
    flat_left, row_left = np.concatenate(left), np.repeat(np.arange(len(left)), [len(s) for s in left])
    inside = where < len(columns)
    inside[inside] = known[columns][where[inside]] == flat_left[inside]
    where, row_left = where[inside], row_left[inside]
    for a in range(0, len(columns), 4096):
        mine, other = (where >= a) & (where < a + 4096), (place >= a) & (place < a + 4096)
        one = np.zeros((len(left), 4096), np.float32)
        two = np.zeros((len(ends) - 1, 4096), np.float32)
        one[row_left[mine], where[mine] - a] = 1
        two[row[other], place[other] - a] = 1
        total += np.rint(one @ two.T).astype(np.int64)
    return total


def _fits(percent: int):
    """Whether two sizes can reach the similarity at all."""
    return F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent


def _has_room(percent: int):
    """Whether a shingle at these places of two prefixes can be the first of as many shared ones as a link needs."""
    return F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")) * (100 + percent) >= (F.col("n") + F.col("n2")) * percent


def likely_pairs(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (``node, node2, label, label2``) whose parity bits (``bits``: ``node, n, bits``) allow a link."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            n, n2, first, second = (batch.column(k) for k in range(4, 8))
            passing = may_link(first, second, n.to_numpy(), n2.to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(passing)) for k in range(4)],
                                             names=["node", "node2", "label", "label2"])

    other = bits.select(F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("bits").alias("bits2"))
    return (pairs.join(other, "node2").join(bits, "node")
            .select("node", "node2", "label", "label2", "n", "n2", "bits", "bits2")
            .mapInArrow(run, "node bigint, node2 bigint, label bigint, label2 bigint"))


def split_lists(lists: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Long lists (``token, node, n, pos, label, _m``) as lists of nodes that the bounds hold together.

    Each pair that may link stands in one list of the answer (``token, node, n, label``) at least. A list is compared by
    its rows in order of size, so that a row meets those of fitting size only; one of more than ``UNIT_ROWS`` rows is cut
    into blocks, and each two blocks are a unit of their own.
    """
    parts = F.ceil(F.col("_m") / UNIT_ROWS).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int")
    units = (lists.withColumn("_parts", parts).withColumn("_own", own)
             .withColumn("_to", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
             .select(F.xxhash64("token", F.least("_own", "_to"), F.greatest("_own", "_to")).alias("unit"),
                     F.signum(F.col("_own") - F.col("_to")).cast("int").alias("side"), "node", "n", "pos", "label"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def lists_of(rows):
            """The rows of some whole units, in order of unit and size, as new lists."""
            unit, side, node, n, pos, label = (rows.column(k).to_numpy() for k in range(6))
            size, bit_rows = n.astype(np.int64), rows.column(6)
            root, us, vs, held = np.arange(len(unit)), [], [], 0

            def settle():
                """Rows that the pairs so far connect get their smallest row as root."""
                nonlocal root, us, vs, held
                u, v = np.concatenate([*us, root]), np.concatenate([*vs, np.arange(len(root))])
                while True:
                    low = np.minimum(root[u], root[v])
                    before = root.copy()
                    np.minimum.at(root, u, low)
                    np.minimum.at(root, v, low)
                    root = root[root]
                    if (root == before).all():
                        break
                us, vs, held = [], [], 0

            left, apart = np.arange(len(unit)), 0
            while len(left):
                apart += 1
                left = left[left < len(unit) - apart]
                right = left + apart
                fits = (unit[left] == unit[right]) & (100 * size[left] >= percent * size[right])
                left = left[fits]  # later rows of the unit are larger still
                right = left + apart
                room = np.minimum(size[left] - pos[left], size[right] - pos[right])
                near = ((label[left] != label[right]) & (node[left] != node[right])
                        & ((side[left] != side[right]) | (side[left] == 0))
                        & (room * (100 + percent) >= percent * (size[left] + size[right])))
                u, v = left[near], right[near]
                if len(u):
                    passing = may_link(bit_rows.take(pa.array(u)), bit_rows.take(pa.array(v)), size[u], size[v], percent)
                    us.append(u[passing])
                    vs.append(v[passing])
                    held += len(us[-1])
                    if held > 1 << 19:
                        settle()
            settle()
            kept = np.bincount(root, minlength=len(root))[root] > 1
            token = unit[kept] ^ (node[root[kept]] * np.int64(0x1E3779B97F4A7C15))
            return pa.RecordBatch.from_arrays([pa.array(token), *(pa.array(c[kept]) for c in (node, n, label))],
                                              names=["token", "node", "n", "label"])

        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = batch.column(0).to_numpy()
            last = int(np.searchsorted(unit, unit[-1]))  # the last unit may go on in the next batch
            if last:
                yield lists_of(pa.concat_batches([*held, batch.slice(0, last)]))
                held = []
            elif held and held[-1].column(0)[0].as_py() != unit[0]:
                yield lists_of(pa.concat_batches(held))
                held = []
            held.append(batch.slice(last))
        if held:
            yield lists_of(pa.concat_batches(held))

    return (units.join(bits.select("node", "bits"), "node").select("unit", "side", "node", "n", "pos", "label", "bits")
            .repartition("unit").sortWithinPartitions("unit", "n")
            .mapInArrow(run, "token bigint, node bigint, n int, label bigint"))


def likely_units(lists: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Units that test every pair of nodes in one list (``token, node, n, pos, label``) that have different labels and may
    link; ``bits`` has ``node, n, bits``."""
    sizes = lists.groupBy("token").agg(F.count(F.lit(1)).alias("_m"), F.min("label").alias("_a"),
                                       F.max("label").alias("_b")).filter("_a <> _b")
    open_lists = finished(stored(lists.join(sizes.select("token", "_m"), "token")))
    short = open_lists.filter(F.col("_m") <= SHORT_LIST).drop("_m")
    other = short.select("token", *[F.col(name).alias(f"{name}2") for name in ("node", "n", "pos", "label")])
    pairs = (short.join(other, "token").filter((F.col("node") < F.col("node2")) & (F.col("label") != F.col("label2"))
                                               & _fits(percent) & _has_room(percent))
             .select("node", "node2", "label", "label2").distinct())
    alone = stars(stored(likely_pairs(pairs, bits, percent)))
    long = open_lists.filter(F.col("_m") > SHORT_LIST)
    if long.isEmpty():
        return alone
    return alone.unionByName(residual_units(finished(stored(split_lists(long, bits, percent))), percent))


def relabelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node, label``: the label of a node without links is itself."""
    found = connected_components(links).select("node", "component")
    return stored(nodes.join(found, "node", "left").select(
        "node", F.coalesce("component", "node").alias("label")))


def residual_units(lists: DataFrame, percent: int) -> DataFrame:
    """Units that test every pair of nodes with different labels in one list; ``lists`` has ``token, node, n, label``."""
    sizes = lists.groupBy("token").agg(F.count(F.lit(1)).alias("_m"), F.min("label").alias("_a"),
                                       F.max("label").alias("_b")).filter("_a <> _b")
    open_lists = stored(lists.join(sizes.select("token", "_m"), "token"))
    short = open_lists.filter(F.col("_m") <= SHORT_LIST).select("token", "node", "n", "label")
    other = short.select("token", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("label").alias("label2"))
    pairs = (short.join(other, "token").filter((F.col("node") < F.col("node2")) & (F.col("label") != F.col("label2"))
                                               & _fits(percent))
             .select("node", "node2", "label", "label2").distinct())
    alone = stars(pairs)
    # Long lists: nodes that share one are numbered inside their joint component and cut into blocks.
    long = open_lists.filter(F.col("_m") > SHORT_LIST).select("token", "node", "label")
    if long.isEmpty():
        return alone
    hub = long.groupBy("token").agg(F.min("node").alias("u"))
    joint = connected_components(long.join(hub, "token").select("u", F.col("node").alias("v")))
    members = joint.groupBy("component").agg(F.count(F.lit(1)).alias("_m"))
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("_m") / (BLOCK_NODES * 0.7)))  # seldom above the size meant
    placed = stored(joint.join(members, "component").withColumn("_raw", F.struct("component", block.alias("k"))))
    # A block that hashing overfilled is cut at exactly BLOCK_NODES.
    cut = F.floor((F.row_number().over(Window.partitionBy("_raw").orderBy("node")) - 1) / BLOCK_NODES)
    placed = stored(placed.select("node", F.xxhash64("_raw.component", "_raw.k", cut).alias("block")))
    touched = long.join(placed, "node").select("token", "block").distinct()
    met = (touched.join(touched.select("token", F.col("block").alias("block2")), "token")
           .filter(F.col("block") <= F.col("block2")).select("block", "block2").distinct()
           .withColumn("unit", F.xxhash64("block", "block2", F.lit("blocks"))))
    filled = placed.join(long.select("node", "label").distinct(), "node")
    left = met.join(filled, "block").select("unit", F.lit(0).alias("side"), "node", "label")
    right = met.join(filled.withColumnRenamed("block", "block2"), "block2").select(
        "unit", F.lit(1).alias("side"), "node", "label")
    return alone.unionByName(left).unionByName(right)


def stars(pairs: DataFrame) -> DataFrame:
    """Units of one node against its partners; a node with many partners stands in several units."""
    counts = pairs.groupBy("node").agg(F.count(F.lit(1)).alias("_m"), F.first("label").alias("label"))
    cut = F.ceil(F.col("_m") / 512).cast("int")
    center = (counts.withColumn("k", F.explode(F.sequence(F.lit(0), cut - 1)))
              .select(F.xxhash64("node", "k", F.lit("star")).alias("unit"), F.lit(0).alias("side"), "node", "label"))
    around = (pairs.select("node", "node2", "label2").join(counts.select("node", cut.alias("_cut")), "node")
              .withColumn("k", F.pmod(F.xxhash64("node2"), F.col("_cut")).cast("int"))
              .select(F.xxhash64("node", "k", F.lit("star")).alias("unit"), F.lit(1).alias("side"),
                      F.col("node2").alias("node"), F.col("label2").alias("label")))
    return center.unionByName(around)


def _links_of(pairs: DataFrame, rows: DataFrame, first: DataFrame) -> DataFrame:
    """``sig, n_links`` of each row of a set: copies of the sets that link with it, and its other copies."""
    copies = stored(first.select("sig", "node").join(rows.groupBy("sig").agg(F.count(F.lit(1)).alias("copies")), "sig"))
    both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    others = (both.join(copies.select(F.col("node").alias("v"), "copies"), "v")
              .groupBy(F.col("u").alias("node")).agg(F.sum("copies").alias("others")))
    return copies.join(others, "node", "left").select(
        "sig", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))


def text_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, content, text, key`` of every row: the key names the row beside a hash of its text."""
    whole, number = whole_text(column_of(docs, text)), column_of(docs, doc_id).cast("bigint")
    return numbered(docs).select(number.alias("doc_id"), F.xxhash64(whole).alias("content"), whole.alias("text"),
                                 not_null_id(number).alias("key"))


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 4, doc_id: str = "doc_id",
                    text: str = "text", count_links: bool = False) -> DataFrame:
    """One row ``doc_id, n_shingles, component_id, component, content`` per row of ``docs``.

    With ``count_links`` also ``n_links``: how many other rows link with the row, equal texts among them. All pairs of
    different sets that link are then made, as many as there are.

    Two documents link when 100 * intersection >= percent * union of their distinct shingles of ``width`` words;
    ``component_id`` is the smallest id reachable by links. ``component`` numbers components, ``content`` hashes
    texts. NULL, empty and blank texts have no shingles and link with nothing (``component`` is NULL). NULL ids take part; a
    component of only NULL ids has a NULL id. Repeated rows have equal sets. Other columns are left out, whatever
    their names; an empty table gives an empty one.
    """
    source = text_rows(docs, doc_id, text)
    order = _sketch(source.select("text"), width)
    every = stored(_sets(source.select("doc_id", "content", "text"), order, width, percent).select(
        F.monotonically_increasing_id().alias("row"), "*", F.xxhash64("prefix", F.lit(1)).alias("g1"),
        F.xxhash64("prefix", F.lit(2)).alias("g2")))
    rows = every.filter("n > 0")
    narrow = rows.select(F.col("row").alias("node"), not_null_id(F.col("doc_id")).alias("key"), "content", "n", "sig",
                         "g1", "g2")
    # One node per distinct set; a group of nodes with equal size and prefix posts once, under its first node.
    nodes = rows.groupBy("sig").agg(F.min("row").alias("node"), F.min("doc_id").alias("low"))
    first = stored(narrow.join(nodes.select("node", "low"), "node"))
    groups = stored(first.groupBy("n", "g1", "g2").agg(F.min("node").alias("gid"), F.count(F.lit(1)).alias("size")))
    member = stored(first.select("node", "n", "g1", "g2").join(groups.filter("size > 1"), ["n", "g1", "g2"])
                    .select("gid", "node", "n"))
    # Tokens of all rows are counted, so copies only let more tokens through; groups' first nodes alone are posted.
    tokens = rows.select(F.col("row").alias("node"), F.posexplode("prefix").alias("pos", "token"))
    shared = tokens.groupBy("token").count().filter("count > 1").select("token")
    posting = first.select("node", "n").join(groups.select(F.col("gid").alias("node")), "node", "left_semi")
    posted = tokens.join(shared, "token").join(posting, "node")
    own_list = member.select("node", "n", F.lit(0).alias("pos"), F.xxhash64("gid", F.lit("group")).alias("token"))
    lists = finished(stored(posted.select("node", "n", "pos", "token").unionByName(own_list)))
    bits = rows.select(F.col("row").alias("node"), "n", "bits")
    # Step 1: the first of each list against the others.
    hubs = lists.groupBy("token").agg(F.min(F.struct("node", "n", "pos")).alias("h"))
    tried = (lists.select(F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), "token")
             .join(hubs, "token").select("h.*", "node2", "n2", "pos2")
             .filter((F.col("node") != F.col("node2")) & _fits(percent) & _has_room(percent))
             .select("node", "node2").distinct())
    tried = likely_pairs(tried.withColumns({"label": F.col("node"), "label2": F.col("node2")}), bits, percent)
    tried = finished(stored(tried))
    links = finished(stored(verified(stars(tried), source, first, width, percent)))
    labels = relabelled(first.select("node"), links)
    # Step 2: whatever still differs inside a list, expanded to the members of its groups.
    shown = member.select(F.col("gid").alias("node"), F.col("node").alias("_member"))
    expanded = (lists.join(shown, "node", "left").select(F.coalesce("_member", "node").alias("node"), "n", "pos", "token")
                .unionByName(own_list).distinct())
    units = likely_units(expanded.join(labels, "node"), bits, percent)
    more = finished(stored(verified(units, source, first, width, percent)))
    labels = relabelled(first.select("node"), links.unionByName(more))
    lows = first.select("node", "low", "sig").join(labels, "node")
    found = lows.groupBy("label").agg(F.min("low").alias("component_id"))
    answer = lows.join(found, "label").select("sig", "component_id", F.col("label").alias("component"))
    counted = []
    if count_links:
        apart = expanded.withColumn("label", F.col("node"))  # no two nodes share a label, so every pair is tested
        pairs = stored(verified(likely_units(apart, bits, percent), source, first, width, percent))
        answer = answer.join(_links_of(pairs, rows, first), "sig")
        counted = ["n_links"]
    answer = stored(answer)
    linked = attach_by_digest(rows.select("doc_id", "content", "n", "sig"), answer, "sig").select(
        "doc_id", "content", "n", "component_id", "component", *counted)
    alone = every.filter("n = 0").select("doc_id", "content", "n", F.col("doc_id").alias("component_id"),
                                         F.lit(None).cast("bigint").alias("component"),
                                         *[F.lit(0).cast("bigint").alias(name) for name in counted])
    return linked.unionByName(alone).select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "component_id",
                                            "component", "content", *counted)


def drop_near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, doc_id: str = "doc_id",
                         text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the smallest id, NULL ids last.

    Texts without shingles stay. Rows that repeat both the id and the text that stays are one row afterwards.
    """
    found = near_duplicates(docs, percent, width, doc_id, text)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")
    best = found.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min(key).alias("k"))
    keep = (best.select("k.doc_id", "k.content")
            .unionByName(found.filter(F.col("component").isNull()).select("doc_id", "content"))
            .select(not_null_id(F.col("doc_id")).alias("key"), "content").distinct())
    rows = packed(docs, key=not_null_id(column_of(docs, doc_id).cast("bigint")),
                  content=F.xxhash64(whole_text(column_of(docs, text))))
    place = F.row_number().over(Window.partitionBy("key", "content").orderBy("key"))
    stay = rows.join(keep, ["key", "content"], "left_semi").withColumn("place", place).filter("place = 1")
    return unpacked(stay, docs)
