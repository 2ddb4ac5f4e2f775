"""Near duplicates by fast similarity sketches, banding and exact verification.

A sketch has ``BINS`` coordinates. Round after round every shingle of a set is hashed to a bin and a value; a bin that
earlier rounds left empty keeps the smallest value of the round. The first ``BINS`` rounds place shingles anywhere, the
next ``BINS`` rounds serve one bin each, so every coordinate is filled in the end, yet a set of more than a few times
``BINS`` shingles hardly needs a second round. Coordinates of two sets agree as often as the sets overlap, and their
number is concentrated as that of independent hashes is.

Coordinates are cut into bands. Sets that agree in a whole band stand in one list; lists give candidates, which are
verified on full sets: the first set of each list against the others, then whatever still lies in different
components. With 32 bands of 4 a pair at similarity 0.8 shares no list with probability 5e-8, a closer one still less;
nothing else is left to chance.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionflow.llm.common import attach_by_digest, stored, text_slices
from regionflow.llm.jaccard_join import relabelled, residual_units, stars, text_rows, verified
from regionflow.llm.shingles import Shingler, set_digest

BINS, BANDS = 128, 32

_GOLDEN = 0x9E3779B97F4A7C15


def _hashed(values, salt: int):
    """A 64-bit hash of each value, another one for each salt."""
    import numpy as np
    x = values + np.uint64(salt * _GOLDEN & (1 << 64) - 1)
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    return x ^ (x >> np.uint64(33))


def sketches(sets: list, bins: int = BINS):
    """One row of ``bins`` 64-bit coordinates per set of distinct hashes; none of the sets is empty."""
    import numpy as np
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    hashes = np.concatenate(sets)
    cells = np.zeros(len(sets) * bins, np.uint64)
    empty = np.ones(len(sets) * bins, bool)
    for turn in range(2 * bins):
        drawn = _hashed(hashes, turn + 1)
        if turn < bins:
            place = owner * bins + ((drawn >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        else:
            place = owner * bins + (turn - bins)
        value = _hashed(drawn, 0)  # independent of the bits that chose the bin
        open_ = empty[place]
        place, value = place[open_], value[open_]
        order = np.lexsort((value, place))
        place, value = place[order], value[order]
        first = np.ones(len(place), bool)
        first[1:] = place[1:] != place[:-1]
        cells[place[first]] = value[first]
        empty[place[first]] = False
        waiting = empty.reshape(-1, bins).any(axis=1)
        if not waiting.any():
            break
        kept = waiting[owner]  # full sketches need no further round
        owner, hashes = owner[kept], hashes[kept]
    return cells.reshape(-1, bins)


def band_keys(rows, bands: int = BANDS):
    """A 64-bit key of each band of each sketch."""
    import numpy as np
    parts = rows.reshape(len(rows), bands, -1)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_GOLDEN), parts.shape[:2])
    for k in range(parts.shape[2]):
        keys = _hashed(keys ^ parts[:, :, k], k + 1)
    return keys


def _sketched(docs: DataFrame, width: int, bins: int, bands: int) -> DataFrame:
    """Size and digest of every document's set, and the keys of its bands."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        shingler = Shingler(width)
        for batch in batches:
            for start, texts in text_slices(batch.column(2), 1_000_000):
                sets = shingler.sets(texts)
                filled = [s for s in sets if len(s)]
                keys = band_keys(sketches(filled, bins), bands) if filled else np.zeros((0, bands), np.uint64)
                bounds = np.cumsum([0, *[bands * (len(s) > 0) for s in sets]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), batch.column(1).slice(start, len(texts)),
                     pa.array([len(s) for s in sets], pa.int32()), pa.array(map(set_digest, sets), pa.binary()),
                     pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys.ravel().view(np.int64)))],
                    names=["doc_id", "content", "n", "sig", "bands"])

    return docs.mapInArrow(run, "doc_id bigint, content bigint, n int, sig binary, bands array<bigint>")


def sketched_duplicates(docs: DataFrame, percent: int = 80, width: int = 4, bins: int = BINS, bands: int = BANDS,
                        doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row ``doc_id, n_shingles, component_id, kept`` per row of ``docs``.

    Documents link when 100 * intersection >= percent * union of their distinct shingles of ``width`` words (a text
    of fewer words is one shingle); ``component_id`` is the smallest id reachable by links, ``kept`` whether it is the
    row's own. NULL, empty and blank texts have no shingles and link with nothing. NULL ids take part; a component of
    only NULL ids has a NULL id and keeps its rows. Repeated rows have equal sets and each its answer: those that
    repeat the smallest id are all kept. Other columns are left out, whatever their names; an empty table gives an
    empty one; a text may be of any length.
    """
    source = text_rows(docs, doc_id, text)
    every = stored(_sketched(source.select("doc_id", "content", "text"), width, bins, bands)
                   .select(F.monotonically_increasing_id().alias("row"), "*"))
    rows = every.filter("n > 0")
    # One node per distinct set, so copies post once, however many there are.
    low = rows.groupBy("sig").agg(F.min("row").alias("node"), F.min("doc_id").alias("low"))
    key = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
    first = stored(rows.select(F.col("row").alias("node"), key.alias("key"), "content", "n", "sig", "bands")
                   .join(low.select("node", "low"), "node"))
    posted = first.select("node", "n", F.explode("bands").alias("token"))
    shared = posted.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("node", "n")).alias("h"))
    lists = stored(posted.join(shared.filter("m > 1"), "token"))
    nodes = first.select("node", "key", "content", "n")
    fits = F.least("n", "h.n") * 100 >= F.greatest("n", "h.n") * percent
    tried = (lists.filter((F.col("node") != F.col("h.node")) & fits)
             .select(F.col("h.node").alias("node"), F.col("node").alias("node2")).distinct())
    tried = stored(tried.withColumns({"label": F.col("node"), "label2": F.col("node2")}))
    links = stored(verified(stars(tried), source, nodes, width, percent))
    labels = relabelled(nodes.select("node"), links)
    left = lists.select("token", "node", "n").join(labels, "node")
    more = stored(verified(residual_units(left, percent), source, nodes, width, percent))
    labels = relabelled(nodes.select("node"), links.unionByName(more))
    lows = first.select("node", "low", "sig").join(labels, "node")
    found = lows.groupBy("label").agg(F.min("low").alias("component_id"))
    answer = stored(lows.join(found, "label").select("sig", "component_id"))
    linked = attach_by_digest(rows.select("doc_id", "n", "sig"), answer, "sig").select("doc_id", "n", "component_id")
    alone = every.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
