"""Alignment of two tokenizers: groups of tokens between common byte offsets, and how often token pairs are linked.

1. A task encodes whole texts by both tokenizers and takes the cumulative ends of the tokens in bytes. A dictionary from
   ends to indices, for the first side as an array addressed by the end, is met with the ends of the second; the
   common ends, sorted, slice both id lists into groups, and the links of each slice are expanded (a large slice by
   its distinct ids, so that work follows the distinct pairs).
2. Texts of a few megabytes form a block. A block lists its distinct id pairs once, with the number of its documents
   that hold each; a document keeps places in that list. So what is shuffled by pair is a row per block and pair, and
   a pair that every document holds is as rare there as any other.
3. Sums over blocks are the corpus-wide counts; their largest per id of the first tokenizer, a table no longer than
   its vocabulary, is broadcast. The counts return to the blocks, where each document adds up those of its links.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionflow.llm.common import column_of, numbered, stored, text_slices, tokenizer_file
from regionflow.llm.pieces import ChunkTable

#: Characters of text in a block (a longer text is a block of its own), and bytes aligned at once.
BLOCK_CHARS, SLICE_BYTES = 4_000_000, 500_000
#: A slice with more links is expanded by its distinct ids.
SMALL_SLICE = 4096
#: Multiplier of the first id in a pair's number; ids of the second tokenizer are smaller.
PAIR = 1 << 24

MARK = "▁"
#: How texts of byte-level vocabularies are cut into words before merging; a fixed value of the format.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters outside these are left to the vocabulary's own library.
_UNCOMMON = r"[^\t\n\r -~\u00a1-\u024f\u0391-\u03ce\u0410-\u044f]"


def byte_alphabet() -> dict[str, int]:
    """Byte of each character of byte-level vocabularies: printable Latin-1 stands for itself, the others follow 255."""
    plain = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(moved)}


class ByteLevel:
    """A byte-level vocabulary of the tokenizers library: texts, after a space, to ids; and the bytes of every id.

    Where merges are ranked by id, as in this format's first vocabularies, texts of common characters are encoded by
    ranks, which gives the same ids in a quarter of the time; the rest by the library itself.
    """

    def __init__(self, name: str):
        import re

        import tiktoken
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(tokenizer_file(name))
        self.model.no_truncation()
        self.model.no_padding()
        self.model.encode_special_tokens = True  # their strings in texts are plain text
        alphabet, size = byte_alphabet(), self.model.get_vocab_size(with_added_tokens=True)
        entries = [self.model.id_to_token(k) or "" for k in range(size)]
        self.bytes = [bytes(alphabet[c] for c in e) if all(c in alphabet for c in e) else e.encode() for e in entries]
        added = set(self.model.get_added_tokens_decoder())
        ranks = {raw: k for k, raw in enumerate(self.bytes) if k not in added}
        self.ranked = tiktoken.Encoding(name, pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.uncommon = re.compile(_UNCOMMON)

    def encode(self, texts: list[str]):
        """Ids of all texts end to end, and how many each has."""
        import numpy as np
        found = [None if self.uncommon.search(t) else self.ranked.encode_ordinary(" " + t) for t in texts]
        rest = [k for k, ids in enumerate(found) if ids is None]
        if rest:
            batch = self.model.encode_batch([" " + texts[k] for k in rest], add_special_tokens=False)
            for k, ids in zip(rest, batch):
                found[k] = ids.ids
        return np.array([k for ids in found for k in ids], np.int64), np.array(list(map(len, found)), np.int64)


class Pieces:
    """A sentencepiece vocabulary that puts a space before a text and whose pieces do not cross white space."""

    def __init__(self, name: str):
        self.table = ChunkTable(tokenizer_file(name), end=False)
        self.model = self.table.model
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(k) else p.replace(MARK, " ").encode()
                      for k, p in enumerate(pieces)]

    def encode(self, texts: list[str]):
        import numpy as np
        ids, bounds = self.table.encode(texts)
        return ids.astype(np.int64), np.diff(bounds)


def tokenizer(name: str):
    return Pieces(name) if name.endswith(".model") else ByteLevel(name)


def _ranges(starts, sizes):
    """The numbers ``start .. start + size - 1`` of each pair, end to end."""
    import numpy as np
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Side:
    """One tokenizer's tables: bytes and decimal digits of its ids, end to end."""

    def __init__(self, name: str):
        import numpy as np
        self.encoder = tokenizer(name)
        raw = self.encoder.bytes
        self.size = np.array(list(map(len, raw)), np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        wide = len(str(len(raw)))
        self.digits = np.frombuffer(b"".join(str(k).encode().ljust(wide + 1) for k in range(len(raw))),
                                    np.uint8).reshape(len(raw), wide + 1)
        self.written = np.array([len(str(k)) for k in range(len(raw))], np.int64)

    def spelled(self, ids):
        return self.raw[_ranges(self.start[ids], self.size[ids])]


class Tokens:
    """Ids of one side for several texts."""

    def __init__(self, side: Side, texts: list[str]):
        self.side = side
        self.ids, self.count = side.encoder.encode(texts)

    def owner(self):
        import numpy as np
        return np.repeat(np.arange(len(self.count)), self.count)

    def spells(self, raw, sizes):
        """Which texts, ``sizes`` bytes each in ``raw``, the tokens spell."""
        import numpy as np
        owner, long = self.owner(), self.side.size[self.ids]
        fits = np.bincount(owner, long, len(sizes)) == sizes
        mine, theirs = fits[owner], np.repeat(fits, sizes)
        same = self.side.spelled(self.ids[mine]) == raw[theirs]
        wrong = np.repeat(np.arange(len(sizes)), sizes)[theirs][~same]
        fits[wrong] = False
        return fits

    def keep(self, texts) -> None:
        import numpy as np
        self.ids = self.ids[texts[self.owner()]]
        self.count = np.where(texts, self.count, 0)


def groups_of(a: Tokens, b: Tokens):
    """Tokens of either side before each common end; texts that follow each other have a common end between them."""
    import numpy as np
    ends_a, ends_b = np.cumsum(a.side.size[a.ids]), np.cumsum(b.side.size[b.ids])
    index = np.zeros(int(ends_a[-1]) + 1 if len(ends_a) else 1, np.int64)  # of the token that ends there, from 1
    index[ends_a] = np.arange(1, len(ends_a) + 1)
    met = index[ends_b]
    return met[met > 0], np.flatnonzero(met > 0) + 1


def written(a: Tokens, b: Tokens, upto_a, upto_b):
    """All groups as ``a1,a2|b1;a3|b2,b3;`` in one buffer, and where each token's text ends, in the order written."""
    import numpy as np
    from_a, from_b = np.concatenate([[0], upto_a])[:-1], np.concatenate([[0], upto_b])[:-1]
    place_a = np.arange(len(a.ids)) + np.repeat(from_b, upto_a - from_a)
    place_b = np.arange(len(b.ids)) + np.repeat(upto_a, upto_b - from_b)
    wide = max(a.side.digits.shape[1], b.side.digits.shape[1])
    text, size = np.zeros((len(a.ids) + len(b.ids), wide), np.uint8), np.zeros(len(a.ids) + len(b.ids), np.int64)
    for tokens, place, last, close in ((a, place_a, upto_a, b"|"), (b, place_b, upto_b, b";")):
        text[place, :tokens.side.digits.shape[1]] = tokens.side.digits[tokens.ids]
        size[place] = tokens.side.written[tokens.ids]
        mark = np.full(len(tokens.ids), ord(","), np.uint8)
        mark[last - 1] = close[0]
        text[place, size[place]] = mark
    return text[np.arange(wide) <= size[:, None]], np.cumsum(size + 1)


def links_of(a: Tokens, b: Tokens, upto_a, upto_b, text):
    """``text, pair number, links`` of every group's links (a text may repeat a pair); and the links of each group."""
    import numpy as np
    from_a, from_b = np.concatenate([[0], upto_a])[:-1], np.concatenate([[0], upto_b])[:-1]
    wide = upto_b - from_b
    links = (upto_a - from_a) * wide
    small = links <= SMALL_SLICE
    every, across = links[small], np.repeat(wide[small], links[small])
    inside = _ranges(np.zeros(len(every), np.int64), every)
    texts, times = [np.repeat(text[small], every)], [np.ones(len(inside), np.int64)]
    numbers = [a.ids[np.repeat(from_a[small], every) + inside // across] * PAIR
               + b.ids[np.repeat(from_b[small], every) + inside % across]]
    for k in np.flatnonzero(~small).tolist():
        ids_a, n_a = np.unique(a.ids[from_a[k]:upto_a[k]], return_counts=True)
        ids_b, n_b = np.unique(b.ids[from_b[k]:upto_b[k]], return_counts=True)
        numbers.append((ids_a[:, None] * PAIR + ids_b[None, :]).ravel())
        times.append((n_a[:, None] * n_b[None, :]).ravel())
        texts.append(np.full(len(times[-1]), text[k]))
    return np.concatenate(texts), np.concatenate(numbers), np.concatenate(times), links


def align(texts: list[str], one: Side, two: Side):
    """Columns ``n_a, n_b, n_groups, n_links``, digests and links (``text, pair number, links``) of several texts."""
    import hashlib

    import numpy as np
    coded = [b" " + t.encode("utf-8", "surrogatepass") for t in texts]
    sizes, raw = np.array(list(map(len, coded)), np.int64), np.frombuffer(b"".join(coded), np.uint8)
    a, b = Tokens(one, texts), Tokens(two, texts)
    good = (sizes > 1) & a.spells(raw, sizes) & b.spells(raw, sizes)
    a.keep(good)
    b.keep(good)
    upto_a, upto_b = groups_of(a, b)
    text = a.owner()[upto_a - 1]
    texts_of, numbers, times, links = links_of(a, b, upto_a, upto_b, text)
    sums = np.stack([a.count, b.count, np.bincount(text, minlength=len(texts)),
                     np.bincount(text, links, len(texts)).astype(np.int64)], 1)
    buffer, ends = written(a, b, upto_a, upto_b)
    last = np.concatenate([[0], ends])[np.cumsum(a.count + b.count)].tolist()
    view = memoryview(np.ascontiguousarray(buffer))
    digests = [hashlib.sha256(view[begin:end - 1]).hexdigest() if end > begin else ""
               for begin, end in zip([0, *last], last)]
    return sums, digests, (texts_of, numbers, times)


_BLOCKS = ("block bigint, is_doc boolean, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
           "groups_sha256 string, pairs array<bigint>, at array<int>, times array<bigint>")


def _blocks(docs: DataFrame, first: str, second: str) -> DataFrame:
    """Rows of documents (places in the block's list and links of each) and one row per block (its pairs, and how
    many of its documents hold each)."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        one, two = Side(first), Side(second)
        block, rows, found, held = TaskContext.get().partitionId() << 32, [], [], 0

        def closed():
            """The block's rows: pairs are numbered, then the links of each document's pairs added up."""
            text, number, times = (np.concatenate(column) for column in zip(*(links for _, links in found)))
            pairs, place = np.unique(number, return_inverse=True)
            width, total = max(1, len(pairs)), len(rows)
            key, back = np.unique(text * width + place, return_inverse=True)
            times = np.bincount(back, times, len(key)).astype(np.int64)
            at, doc = key % width, key // width
            holding = np.bincount(at, minlength=len(pairs))
            bounds = np.concatenate([np.searchsorted(doc, np.arange(total)), [len(key)] * 2])
            sums = np.concatenate([s for s, _ in found])
            ids, digests = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([block] * (total + 1), pa.int64()), pa.array([True] * total + [False]),
                 pa.array([*ids, None], pa.int64()), *[pa.array([*c.tolist(), None], pa.int64()) for c in sums.T],
                 pa.array([*digests, None], pa.string()),
                 pa.ListArray.from_arrays(pa.array([0] * (total + 1) + [len(pairs)], pa.int32()), pa.array(pairs)),
                 pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(at, pa.int32())),
                 pa.ListArray.from_arrays(pa.array([*bounds[:-1], len(key) + len(pairs)], pa.int32()),
                                          pa.array(np.concatenate([times, holding])))],
                names=[f.split()[0] for f in _BLOCKS.split(", ")])

        for batch in batches:
            for start, texts in text_slices(batch.column(1), SLICE_BYTES):
                sums, digests, (text, number, times) = align(texts, one, two)
                found.append((sums, (text + len(rows), number, times)))
                rows += zip(batch.column(0).slice(start, len(texts)).to_pylist(), digests)
                held += sum(map(len, texts))
                if held >= BLOCK_CHARS:
                    yield closed()
                    block, rows, found, held = block + 1, [], [], 0
        if rows:
            yield closed()

    rows = numbered(docs).select(column_of(docs, "doc_id").cast("bigint"), column_of(docs, "text"))
    return rows.mapInArrow(run, _BLOCKS)


def aligned_tokens(docs: DataFrame, first: str = "byte_bpe_50k.json", second: str = "piece_bpe_32k.model") -> DataFrame:
    """One row ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per row of ``docs``.

    Space and text are encoded by ``first``, the text by ``second``, which adds the space; byte offsets where tokens of
    both end cut them into groups, and each pair of tokens in a group is a link. ``count_sum`` adds up over the links how
    many documents hold the link's id pair, ``n_best`` counts the links whose pair is held by as many as any pair of its
    first id. Texts that are NULL or empty, or that the tokens do not spell, have zeros and an empty digest. Rows with
    NULL or repeated ids are documents like any; other columns are left out, whatever their names; an empty table gives
    an empty one; a text may be of any length.
    """
    rows = stored(_blocks(docs, first, second))
    blocks = rows.filter("not is_doc").select("block", "pairs", "times")
    held = (blocks.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
            .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("docs")))
    held = stored(held)
    most = held.groupBy(F.expr(f"pair div {PAIR}").alias("a")).agg(F.max("docs").alias("most"))
    judged = (held.withColumn("a", F.expr(f"pair div {PAIR}")).join(F.broadcast(most), "a")  # a row per id of a vocabulary
              .select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")))
    spread = blocks.select("block", F.posexplode("pairs").alias("at", "pair")).join(judged, "pair")
    # As long as the block's list of pairs.
    counts = spread.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "docs", "best"))).alias("c"))
    known = counts.select("block", F.lit(False).alias("is_doc"), F.col("c.docs").alias("docs"), F.col("c.best").alias("best"))
    own = rows.filter("is_doc").drop("pairs")
    both = own.unionByName(known, allowMissingColumns=True)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        now, docs_, best = None, None, None
        flat = lambda column, kind: column.flatten().to_numpy(zero_copy_only=False).astype(kind)
        for batch in batches:
            blocks_, is_doc = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(blocks_, prepend=-1) != 0).tolist() + [len(blocks_)]
            for begin, end in zip(edges[:-1], edges[1:]):
                if not is_doc[begin]:
                    entry = batch.slice(begin, 1)
                    now, docs_, best = blocks_[begin], flat(entry.column(10), np.int64), flat(entry.column(11), np.int64)
                    begin += 1
                if begin == end:
                    continue
                part = batch.slice(begin, end - begin)
                if blocks_[begin] != now:  # a block without any pair
                    now, docs_, best = blocks_[begin], np.zeros(0, np.int64), np.zeros(0, np.int64)
                at, times = flat(part.column(8), np.int64), flat(part.column(9), np.int64)
                ends = np.cumsum([0, *part.column(8).value_lengths().to_pylist()])
                sums = [np.concatenate([[0], np.cumsum(times * of[at])]) for of in (best, docs_)]
                added = [pa.array(s[ends[1:]] - s[ends[:-1]], pa.int64()) for s in sums]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in (2, 3, 4, 5, 6)], *added, part.column(7)],
                                                 names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best",
                                                        "count_sum", "groups_sha256"])

    order = ["block", "is_doc", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "times", "docs", "best"]
    return (both.repartition("block").sortWithinPartitions("block", "is_doc").select(order)
            .mapInArrow(run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
                             "count_sum bigint, groups_sha256 string"))
