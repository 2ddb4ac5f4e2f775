"""SentencePiece encoding and decoding through a table of distinct chunks.

A chunk is a run of white space markers and what follows up to the next marker. In a vocabulary
whose pieces hold markers only at their front, no merge crosses a chunk's border, so each distinct
chunk is segmented once and its ids are put back at every position where it stands. The table
lives in the task that meets the chunks: every occurrence stays where its text is, and nothing is
shuffled. It is emptied when it holds ``TABLE_CHUNKS`` chunks; only speed depends on it.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from regionflow.llm.common import numbered, place_of, text_slices, tokenizer_file

#: Chunks that a task keeps at once.
TABLE_CHUNKS = 250_000
#: Bytes of text that a task splits at once (a longer text is taken alone).
BLOCK_BYTES = 1_000_000

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


class ChunkTable:
    """Ids of distinct chunks for one model; ``encode`` returns flat ids and the number of ids per text."""

    def __init__(self, path: str, end: bool, limit: int = TABLE_CHUNKS):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        inner = [p for p in map(self.model.id_to_piece, range(self.model.get_piece_size()))
                 if MARK in p.lstrip(MARK)]
        probe = self.model.encode("a  b ", out_type=str)
        if inner or "".join(probe).count(MARK) != 4:
            raise ValueError("pieces of this model cross white space markers, or its normaliser drops spaces")
        self.end, self.limit = end, limit
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.lists: list[list[int]] = []

    def _add(self, bodies: set[str]) -> None:
        """``bodies`` are chunks without their first marker, which the encoder puts back."""
        new = list(bodies)
        ids = self.model.encode(new, num_threads=1)
        if "" in bodies:  # a marker alone; the encoder gives nothing for an empty text
            ids[new.index("")] = [self.model.piece_to_id(MARK)]
        first = len(self.lists)
        self.lists += ids
        self.place.update(zip(new, range(first, first + len(new))))

    @staticmethod
    def bodies(text: str) -> list[str]:
        if not text:
            return []
        if MARK in text or "  " in text or text[0] == " ":
            return [chunk[1:] for chunk in _CHUNK.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def encode(self, texts: list[str]):
        import numpy as np
        split = [self.bodies(text) for text in texts]
        flat = [body for bodies in split for body in bodies]
        distinct = set(flat)
        fresh = distinct - self.place.keys()
        if len(self.place) + len(fresh) > self.limit and self.place:
            self.clear()
            fresh = distinct
        if fresh:
            self._add(fresh)
        at = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        used, at = np.unique(at, return_inverse=True)
        lists = [self.lists[k] for k in used.tolist()]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        table = np.fromiter((i for ids in lists for i in ids), np.int32, int(sizes.sum()))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
        size, start = sizes[at], starts[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = table[np.repeat(start - (ends - size), size) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[np.cumsum([0, *map(len, split)])]
        if self.end:
            ids = np.insert(ids, bounds[1:], self.model.eos_id())
            bounds = bounds + np.arange(len(bounds))
        return ids.astype(np.int32), bounds


def blocks(texts: list[str], most: int) -> Iterator[slice]:
    """Slices of ``texts`` with about ``most`` characters each."""
    begin = held = 0
    for k, text in enumerate(texts):
        if k > begin and held + len(text) > most:
            yield slice(begin, k)
            begin, held = k, 0
        held += len(text)
    if begin < len(texts):
        yield slice(begin, len(texts))


def encode_pieces(docs: DataFrame, text: str = "text", tokenizer: str = "piece_bpe_32k.model", end: bool = True,
                  decode: bool = True, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns of ``docs`` with the ids of each whole text and, if asked, the text that they decode to.

    NULL and empty texts have no pieces (only the end id, if asked for) and decode to the empty text. A column of
    ``docs`` named like an output column is replaced. Repeated rows stay repeated; an empty table gives an empty one.
    The ids are those of the library for the whole text, at any length; no sampling, no begin id.
    """
    rows, own = numbered(docs), place_of(docs, text)
    places = [k for k, name in enumerate(docs.columns) if name not in ((ids, decoded) if decode else (ids,))]
    added = [T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)]
    if decode:
        added.append(T.StructField("decoded", T.StringType(), False))
    schema = T.StructType([*[rows.schema[k] for k in places], *added])

    def run(batches):
        import pyarrow as pa
        table = ChunkTable(tokenizer_file(tokenizer), end)
        for batch in batches:
            for start, texts in text_slices(batch.column(own), BLOCK_BYTES):
                flat, bounds = table.encode(texts)
                cut = batch.slice(start, len(texts))
                columns = [cut.column(k) for k in places]
                columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32())))
                if decode:
                    every = flat.tolist()
                    lists = [every[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                    columns.append(pa.array(table.model.decode(lists, num_threads=1), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema).toDF(*[docs.columns[k] for k in places], *((ids, decoded) if decode else (ids,)))
