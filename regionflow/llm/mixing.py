"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies that each of its documents should get on average; the
whole part is given to all, the fractional part is rounded. Rounding pairs two documents of a source and moves
probability mass between them, weighted by their sizes so that the source's expected words stay as they are, in a
random direction that keeps each document's expectation, until one of the two is decided. The undecided one meets
the next. This is done inside chunks of bounded size; each chunk leaves at most one undecided document per
source, and chunks of those residuals are combined level by level until one per source is left, which is rounded
alone. A source's taken words differ from its target by one document at most.

All choices follow from hashes of ids, so reruns agree whatever the partitioning. A hot source is many chunks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionflow.llm.common import WORD, column_of, not_null_id, numbered, packed, stored, unpacked, whole_text
from regionflow.scale import dense_index

#: Rows that meet in one chunk of the reduction tree, on average.
CHUNK_ROWS = 4096
#: A source may be taken at most so many times over.
MOST_COPIES = 3
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)

_STATE = "doc_id bigint, source string, size bigint, content bigint, base int, p double, key bigint, copies int"


def word_count(text: Column) -> Column:
    """Number of words (runs of anything but ASCII white space); NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` (one row per source, NULL allowed).

    Weights repeat over the sources in code-point order, NULL last; targets are capped at ``most`` times the size and
    the excess is shared again by weight until no target is above. Only sums come to the driver.
    """
    sizes = stored(sizes)
    named = dense_index(sizes.filter(F.col("source").isNotNull()), "source", "_at")
    last = sizes.filter(F.col("source").isNull()).withColumn("_at", F.lit(max(0, sizes.count() - 1)).cast("bigint"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_at") % len(weights) + 1).cast("int"))
    table = named.unionByName(last).withColumn("_w", weight.cast("double")).drop("_at")
    table = stored(table)
    cap = F.col("source_size") * float(most)
    total = float(table.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:  # each round caps at least one more source, nearly always all that will be
        over = F.col("_w") * level >= cap if capped >= 0 else F.lit(False)
        n, held, open_weight = table.agg(
            F.count(F.when(over, 1)), F.sum(F.when(over, cap).otherwise(0.0)),
            F.sum(F.when(over, 0.0).otherwise(F.col("_w")))).first()
        if n == capped or not open_weight:
            break
        level, capped = (total - (held or 0.0)) / open_weight, n
    return table.select("source", "source_size", F.least(F.col("_w") * level, cap).alias("target"))


def _settle(rows, last: bool):
    """Pivotal rounding over rows (ordered) of one chunk and source; returns copies per row, -1 where undecided, and p.

    ``rows`` are tuples (size, p, key). A pair's sum of size times p stays as it is.
    """
    copies, left = [-1] * len(rows), [p for _, p, _ in rows]
    held = None
    for k, (size, p, key) in enumerate(rows):
        if size == 0 or p <= 0.0 or p >= 1.0:  # without words, or decided
            copies[k] = int(p >= 1.0)
            continue
        if held is None:
            held = k
            continue
        a, b = rows[held][0], size
        pa, pb = left[held], left[k]
        up, down = min((1.0 - pa) * a, pb * b), min(pa * a, (1.0 - pb) * b)
        draw = _uniform(rows[held][2], key)
        move = up if draw * (up + down) < down else -down
        # the one that meets its limit is decided; set exactly, so that no rest of rounding stays
        first = (1.0 - pa) * a <= pb * b if move == up else pa * a <= (1.0 - pb) * b
        if first:
            copies[held] = int(move == up)
            left[k] = min(1.0, max(0.0, pb - move / b))
            held = k
        else:
            copies[k] = int(move != up)
            left[held] = min(1.0, max(0.0, pa + move / a))
        if left[held] <= 1e-12 or left[held] >= 1.0 - 1e-12:
            copies[held] = int(left[held] > 0.5)
            held = None
    if held is not None and last:
        copies[held] = int(_uniform(rows[held][2], rows[held][2]) < left[held])
    return copies, left


def _uniform(a: int, b: int) -> float:
    """A number in [0, 1) from two 64-bit hashes (a multiply-xor finaliser)."""
    mask = (1 << 64) - 1
    x = (a * 0x9E3779B97F4A7C15 + b) & mask
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
    return ((x ^ (x >> 31)) >> 11) / float(1 << 53)


def _level(rows: DataFrame, chunks: int, level: int, last: bool) -> DataFrame:
    """One level of the tree: every (source, chunk) group is settled; ``copies`` is NULL where undecided."""
    def run(batches):
        import pandas as pd
        held: list = []  # rows of the group that is being gathered; groups are sorted runs
        for frame in batches:
            held.append(frame)
            joined = pd.concat(held, ignore_index=True) if len(held) > 1 else frame
            if joined.empty:
                continue
            tail = (joined["_source"] == joined["_source"].iloc[-1]) & (joined["_chunk"] == joined["_chunk"].iloc[-1])
            yield from groups(joined[~tail])
            held = [joined[tail]]
        if held:
            yield from groups(pd.concat(held, ignore_index=True))

    def groups(frame):
        for _, group in frame.groupby(["_source", "_chunk"], sort=False):
            copies, left = _settle(list(zip(group["size"].tolist(), group["p"].tolist(), group["key"].tolist())), last)
            out = group.drop(columns=["_source", "_chunk"])
            out["copies"], out["p"] = copies, left
            yield out

    chunk = F.pmod(F.xxhash64("key", F.lit(level)), F.lit(chunks))
    dealt = rows.withColumns({"_chunk": chunk, "_source": F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))})
    # Chunks have bounded size and are never split over tasks; order is total up to equal rows.
    return (dealt.repartition("_source", "_chunk").sortWithinPartitions("_source", "_chunk", "key", "doc_id", "size", "content")
            .select("doc_id", "source", "size", "content", "base", "p", "key", F.lit(-1).alias("copies"), "_source", "_chunk")
            .mapInPandas(run, _STATE))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 17,
                doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row ``doc_id, source, content, size, source_size, target, copies, taken`` per row of ``docs``.

    ``content`` is a hash of the text that tells rows with one id apart. ``copies`` is how often the mix takes the document, at most ``most``; ``taken`` is its words times that. NULL
    sources form one source, the last; NULL texts have no words. A document without words gets the whole copies
    of its source. Repeated rows and NULL ids are mixed like any row. Other columns are left out, whatever their
    names; an empty table gives an empty one.
    """
    number, name, whole = (column_of(docs, c) for c in (doc_id, source, text))
    rows = stored(numbered(docs).select(number.cast("bigint").alias("doc_id"), name.cast("string").alias("source"),
                                        word_count(whole).alias("size"), F.xxhash64(whole_text(whole)).alias("content")))
    counts = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    counts = stored(counts)
    targets = stored(source_targets(counts.select("source", "source_size"), weights, most))
    most_rows = counts.agg(F.max("_rows")).first()[0] or 0
    # The number of sources is not bounded: whether their table is broadcast is left to its size.
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    ratio = targets.select(F.col("source").alias("_s"), share.alias("share"))
    whole = F.least(F.floor("share"), F.lit(most)).cast("int")
    state = (rows.join(ratio, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
             .withColumns({"base": whole, "p": F.col("share") - whole,
                           "key": F.xxhash64("doc_id", "size", "content", F.lit(seed)), "copies": F.lit(-1)}))
    decided, level = [], 0
    while True:
        chunks = -(-most_rows // CHUNK_ROWS)
        last = chunks <= 1
        state = stored(_level(state, max(1, chunks), level, last))
        decided.append(state.filter("copies >= 0"))
        if last:
            break
        state, most_rows, level = state.filter("copies < 0"), chunks, level + 1
    done = decided[0]
    for more in decided[1:]:
        done = done.unionByName(more)
    totals = targets.withColumnRenamed("source", "_s")
    copies = F.least(F.col("base") + F.col("copies"), F.lit(most)).cast("bigint")
    return (done.join(totals, F.col("source").eqNullSafe(F.col("_s")))
            .select("doc_id", "source", "content", "size", "source_size", "target", copies.alias("copies"),
                    (F.col("size") * copies).alias("taken")))


def take_mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **mix) -> DataFrame:
    """The mix itself: every row of ``docs``, with all its columns, as often as it is taken.

    Rows that share id, source and text are alike here: one of them stands for their copies together.
    """
    keys = ["key", "source", "content"]
    taken = (mix_sources(docs, doc_id=doc_id, source=source, text=text, **mix)
             .groupBy(not_null_id(F.col("doc_id")).alias("key"), not_null_id(F.col("source")).alias("source"), "content")
             .agg(F.sum("copies").cast("int").alias("copies")).filter("copies > 0"))
    number, name, whole = (column_of(docs, c) for c in (doc_id, source, text))
    rows = packed(docs, key=not_null_id(number.cast("bigint")), source=not_null_id(name.cast("string")),
                  content=F.xxhash64(whole_text(whole)))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("key"))
    once = rows.join(taken, keys).withColumn("place", place).filter("place = 1")
    return unpacked(once.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs)
