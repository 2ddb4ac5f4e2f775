"""Approximate nearest neighbours by a permutation index.

A vector is represented by the ordered list of its nearest pivots. Vectors are dealt into blocks; a block keeps an
inverted file: for each pivot, the vectors that have it in their list, with its place there. A query adds up, over the
files of its own nearest pivots, how well places agree; that orders a block's vectors by the footrule distance of the
lists (absent pivots count as standing behind the list's end). The best share of each block, with all ties, is
reranked by the exact distance. The share is a fraction, so it follows the data; nothing is capped.

Every query meets every block, both in bounded pieces: one task holds one piece of queries and one block.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionflow.llm.common import stored

#: Rows from which pivots are drawn; the pivots; the length of a vector's list.
SAMPLE_ROWS, PIVOTS, PREFIX = 2_048, 256, 64
#: Part of each block that is reranked, and the least number of vectors.
RERANKED, LEAST_RERANKED = 0.25, 256
#: Vectors of a block and queries of a piece, on average.
BLOCK_ROWS, PIECE_ROWS = 4_096, 2_048


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Distinct ``vec_id, v`` (doubles) of rows that take part; of several lengths only the most frequent one does."""
    v = F.col("v")
    rows = (vectors.select(vectors[vec_id].cast("bigint").alias("vec_id"), vectors[embedding].cast("array<double>").alias("v"))
            .filter(F.col("vec_id").isNotNull() & v.isNotNull()
                    & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                    & F.exists(v, lambda x: x != 0)).distinct())
    rows = stored(rows)
    # The number of lengths is small, but nothing needs that: one row comes to the driver.
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (common["d"] if common else 0))


def draw_pivots(rows: DataFrame, count: int = PIVOTS, sample: int = SAMPLE_ROWS):
    """At most ``count`` different vectors out of a sample of ``sample`` different ones, as a matrix."""
    import numpy as np
    draw, top = F.pmod(F.xxhash64("v"), F.lit(1 << 40)), 1 << 40
    n = rows.select(draw).distinct().count()  # copies share a draw and enter once
    # tasks drop most of what will not be drawn, and copies, so little more than the sample leaves them
    early = rows.filter(draw < int(min(1.0, 3 * sample / max(1, n)) * top)).select("v").distinct()
    drawn = early.orderBy(draw, "v").limit(sample).collect()
    return np.array(list(dict.fromkeys(tuple(r["v"]) for r in drawn))[:count])


def build_index(rows: DataFrame, pivots, prefix: int = PREFIX) -> DataFrame:
    """``vec_id, v, places``: each vector with its nearest pivots in order, ties to the lower pivot."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        wide = min(prefix, len(pivots))
        own = (pivots ** 2).sum(1)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            near = np.argsort(own[None, :] - 2 * x @ pivots.T, axis=1, kind="stable")[:, :wide].astype(np.int16)
            places = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, wide), pa.int32()),
                                              pa.array(near.ravel(), pa.int16()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), places],
                                             names=["vec_id", "v", "places"])
    return rows.mapInArrow(run, "vec_id bigint, v array<double>, places array<smallint>")


class _Block:
    """One block's inverted files."""

    def __init__(self, ids, x, places, pivots: int):
        import numpy as np
        self.ids, self.x, self.wide = ids, x, places.shape[1]
        flat = places.ravel()
        order = np.argsort(flat, kind="stable")
        self.rows, self.at = order // self.wide, (order % self.wide).astype(np.int32)
        self.ends = np.searchsorted(flat[order], np.arange(pivots + 1))

    def nearest(self, query: int, v, places, k: int):
        """The ``k`` nearest of the reranked part: (distance, id), nearest first."""
        import numpy as np
        agreed = np.zeros(len(self.ids), np.int32)  # footrule = constant - 2 * agreed
        for place, pivot in enumerate(places.tolist()):
            a, b = self.ends[pivot], self.ends[pivot + 1]
            agreed[self.rows[a:b]] += self.wide - np.maximum(place, self.at[a:b])
        count = max(LEAST_RERANKED, int(np.ceil(RERANKED * len(agreed)))) + 1
        if count < len(agreed):
            bound = np.partition(agreed, len(agreed) - count)[len(agreed) - count]
            picked = np.flatnonzero(agreed >= bound)
        else:
            picked = np.arange(len(agreed))
        picked = picked[self.ids[picked] != query]
        distance = np.sqrt(((self.x[picked] - v) ** 2).sum(axis=1))
        best = np.lexsort((self.ids[picked], distance))[:k]
        return zip(distance[best].tolist(), self.ids[picked[best]].tolist())


def search(queries: DataFrame, index: DataFrame, k: int, pivots: int) -> DataFrame:
    """``query_id, vec_id, score`` of the ``k`` best that each block has for each query; both tables as indexed."""
    n, m = index.count(), queries.count()
    blocks, pieces = max(1, -(-n // BLOCK_ROWS)), max(1, -(-m // PIECE_ROWS))
    dealt = lambda column, parts: F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(parts)).cast("int").alias(column)
    every = lambda column, parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias(column)
    left = queries.select("*", F.lit(0).alias("side"), dealt("piece", pieces)).select("*", every("block", blocks))
    right = index.select("*", F.lit(1).alias("side"), dealt("block", blocks)).select("*", every("piece", pieces))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        now, rows = None, []

        def finished():
            if not rows:
                return
            ids, x, places, sides = (np.concatenate(parts) for parts in zip(*rows))
            own = sides == 1
            if not own.any():
                return
            block = _Block(ids[own], x[own], places[own], pivots)
            found = [(query, vec, score) for query, v, near in zip(ids[~own].tolist(), x[~own], places[~own])
                     for score, vec in block.nearest(query, v, near, k)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[c] for f in found], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))],
                names=["query_id", "vec_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            places = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            sides, unit = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(unit)) + 1).tolist(), len(unit)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if unit[a] != now:
                    yield from finished()
                    now, rows = unit[a], []
                rows.append((ids[a:b], x[a:b], places[a:b], sides[a:b]))
        yield from finished()

    unit = (F.col("piece").cast("bigint") * blocks + F.col("block")).alias("unit")
    columns = ["vec_id", "v", "places", "side", unit]
    return (left.select(columns).unionByName(right.select(columns))
            .repartition(F.col("unit")).sortWithinPartitions("unit")
            .mapInArrow(run, "query_id bigint, vec_id bigint, score double"))


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id",
                       embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each row where ``is_query`` (over ``vec_id``) holds.

    ``score`` is the Euclidean distance of the original vectors in double precision; ties go to the smaller id. Rows
    with a NULL id, a NULL, empty or zero vector, NULL or non-finite components, or a length other than the most
    frequent one take no part. Exact repeats count once; rows that share an id are never each other's neighbours. With
    fewer candidates than ``k`` all are returned; an empty table gives an empty one. Other columns are left out.
    """
    rows = usable(vectors, vec_id, embedding)
    pivots = draw_pivots(rows)
    if not len(pivots):
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    index = stored(build_index(rows, pivots))
    found = search(index.filter(is_query), index, k, len(pivots))
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    # A query has at most k rows from each block.
    return (best.withColumn("rank", rank).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
