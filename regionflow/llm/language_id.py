"""Language identification by a byte convolutional network.

UTF-8 bytes are embedded, filters of several widths slide over them, each filter's maximum over a window of fixed
length goes through a rectifier, and a dense layer with softmax gives the window's languages. A document is the
average of all its windows, weighted by their bytes; windows lie end to end and filters look past a window's end, so
every byte sequence of every whole text is seen.

The network begins on the driver with at most ``TRAIN_ROWS`` snippets of bounded length, drawn evenly from the
languages; then every window of every labelled text trains it: each task goes on with a copy over its own rows, and
the copies are averaged. Inside tasks the embedding and the filters are folded into tables of byte pairs, so a filter
costs one or two look-ups per byte.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionflow.llm.common import numbered, place_of, stored, text_slices

#: Bytes of a window.
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDED = 8
#: Snippets that the network begins with and characters of each: the bound of what comes to the driver (about 3 MB).
TRAIN_ROWS, TRAIN_CHARS = 6_000, 256
EPOCHS, BATCH, RATE = 8, 64, 0.01
#: Windows of a step and rate of the round over all texts.
ROUND_BATCH, ROUND_RATE = 512, 0.001
#: Steps of the scores that are counted.
SCORES = 10_000
#: Windows computed at once: their filter outputs stay in the cache.
BLOCK_WINDOWS = 32

UNKNOWN = "und"
_PAD = 0  # the byte 0 pads; it hardly occurs in texts


@dataclass
class Network:
    languages: list[str]
    embedding: object  # 256 x EMBEDDED
    filters: list  # one (width, EMBEDDED, FILTERS) array per width
    bias: object
    dense: object
    dense_bias: object

    def tables(self) -> list:
        """Per width, per offset: what each byte adds to the filters."""
        return [[self.embedding @ own[k] for k in range(len(own))] for own in self.filters]


def _codes(texts: list[str]):
    """Bytes of texts end to end, each padded to whole windows and past its end; windows and bytes per text."""
    import numpy as np
    parts, windows, sizes = [], [], []
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass")
        n = max(1, -(-len(raw) // WINDOW))
        if n * WINDOW - len(raw) < max(WIDTHS) - 1 and len(raw):
            n += 1  # so that no filter reads the next text
        parts.append(raw.ljust(n * WINDOW, b"\0"))
        windows.append(n)
        sizes.append(len(raw))
    return np.frombuffer(b"".join(parts) + bytes(max(WIDTHS)), np.uint8), np.array(windows), np.array(sizes)


def _folded(network: Network):
    """Look-up tables: all filters by the first two bytes, then what later bytes of wider filters add, by pairs."""
    import numpy as np
    tables = network.tables()
    pair = lambda a, b: np.ascontiguousarray((a[:, None, :] + b[None, :, :]).reshape(65_536, -1))
    first = np.concatenate([pair(own[0], own[1]) for own in tables], axis=1)
    later = []  # columns, offset, table of a pair or of one byte
    for j, own in enumerate(tables):
        columns = slice(j * FILTERS, (j + 1) * FILTERS)
        for k in range(2, len(own), 2):
            later.append((columns, k, pair(own[k], own[k + 1]) if k + 1 < len(own) else own[k]))
    return first, later


def _strongest(folded, codes, begin: int, count: int):
    """Maximum of each filter over each of ``count`` windows from window ``begin``."""
    first, later = folded
    n = count * WINDOW
    one = codes[begin * WINDOW:begin * WINDOW + n + max(WIDTHS)].astype("int64")
    two = (one[:-1] << 8) | one[1:]
    out = first.take(two[:n], axis=0, mode="clip")
    for columns, k, table in later:
        out[:, columns] += table.take((two if len(table) > 256 else one)[k:k + n], axis=0, mode="clip")
    return out.reshape(count, WINDOW, -1).max(axis=1)


def _softmax(logits):
    import numpy as np
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _adam(params: dict, state: dict, grads: dict, rate: float) -> None:
    """One step of Adam; ``state`` holds the moments and the number of steps and begins empty."""
    import numpy as np
    if not state:
        state.update(step=0, first={k: np.zeros_like(v) for k, v in params.items()},
                     second={k: np.zeros_like(v) for k, v in params.items()})
    state["step"] += 1
    first, second, step = state["first"], state["second"], state["step"]
    for name, g in grads.items():
        first[name] = 0.9 * first[name] + 0.1 * g
        second[name] = 0.999 * second[name] + 0.001 * g * g
        params[name] = (params[name] - rate * (first[name] / (1 - 0.9 ** step)) / (
            np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)


def train_network(snippets: list[str], labels: list[str], seed: int = 5, languages: list[str] | None = None) -> Network:
    """Adam on the cross-entropy of windows; gradients of a filter flow only to the place of its maximum."""
    import numpy as np
    languages = sorted(languages or set(labels))
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    total = FILTERS * len(WIDTHS)
    params = {"e": draw(256, EMBEDDED), "b": np.zeros(total, np.float32), "d": draw(total, len(languages)),
              "c": np.zeros(len(languages), np.float32), **{f"w{w}": draw(w, EMBEDDED, FILTERS) for w in WIDTHS}}
    wrap = lambda: Network(languages, params["e"], [params[f"w{w}"] for w in WIDTHS], params["b"],
                           params["d"], params["c"])
    if len(languages) < 2:
        return wrap()
    # one window per snippet: the first; snippets are no longer than a window for ASCII
    raw = [s.encode("utf-8", "surrogatepass")[:WINDOW] for s in snippets]
    x = np.frombuffer(b"".join(r.ljust(WINDOW + max(WIDTHS), b"\0") for r in raw), np.uint8).reshape(len(raw), -1)
    y = np.array([languages.index(label) for label in labels])
    weight = (len(y) / (len(languages) * np.maximum(1, np.bincount(y, minlength=len(languages)))))[y].astype(np.float32)
    state: dict = {}
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(x), BATCH):
            rows = order[a:a + BATCH]
            xb, m = x[rows], len(rows)
            tables = wrap().tables()
            parts = []
            for w, own in zip(WIDTHS, tables):
                out = own[0][xb[:, :WINDOW]]
                for k in range(1, w):
                    out = out + own[k][xb[:, k:k + WINDOW]]
                parts.append(out)
            out = np.concatenate(parts, axis=2)
            place = out.argmax(axis=1)
            top = np.take_along_axis(out, place[:, None, :], axis=1)[:, 0] + params["b"]
            hidden = np.maximum(top, 0)
            p = _softmax(hidden @ params["d"] + params["c"])
            p[np.arange(m), y[rows]] -= 1
            p *= (weight[rows] / m)[:, None]
            grads = {"d": hidden.T @ p, "c": p.sum(0)}
            back = (p @ params["d"].T) * (top > 0)
            grads["b"] = back.sum(0)
            grads["e"] = np.zeros_like(params["e"])
            for j, w in enumerate(WIDTHS):
                g, at = back[:, j * FILTERS:(j + 1) * FILTERS], place[:, j * FILTERS:(j + 1) * FILTERS]
                grads[f"w{w}"] = np.zeros_like(params[f"w{w}"])
                for k in range(w):
                    seen = np.zeros((256, FILTERS), np.float32)
                    np.add.at(seen, (xb[np.arange(m)[:, None], at + k], np.arange(FILTERS)[None, :]), g)
                    grads[f"w{w}"][k] = params["e"].T @ seen
                    grads["e"] += seen @ params[f"w{w}"][k].T
            _adam(params, state, grads, RATE)
    return wrap()


class _Round:
    """Training of a copy of a network over windows as they come; the same gradients as :func:`train_network`."""

    def __init__(self, network: Network):
        self.languages, self.state, self.windows = network.languages, {}, 0
        self.params = {"e": network.embedding, "b": network.bias, "d": network.dense, "c": network.dense_bias,
                       **{f"w{w}": own for w, own in zip(WIDTHS, network.filters)}}

    def network(self) -> Network:
        p = self.params
        return Network(self.languages, p["e"], [p[f"w{w}"] for w in WIDTHS], p["b"], p["d"], p["c"])

    def flat(self):
        import numpy as np
        return np.concatenate([self.params[name].ravel() for name in sorted(self.params)]).astype(np.float64)

    def restored(self, values) -> Network:
        import numpy as np
        at = 0
        for name in sorted(self.params):
            shape, size = self.params[name].shape, self.params[name].size
            self.params[name] = np.asarray(values[at:at + size], np.float32).reshape(shape)
            at += size
        return self.network()

    def learn(self, texts: list[str], labels, weights) -> None:
        """Every window of the texts, shuffled; a window counts by its bytes times its text's weight."""
        import numpy as np
        codes, counts, sizes = _codes(texts)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        inside = np.arange(int(counts.sum())) - np.repeat(starts, counts)
        share = np.clip(np.repeat(sizes, counts) - inside * WINDOW, 0, WINDOW) / WINDOW
        weight, label = (share * np.repeat(weights, counts)).astype(np.float32), np.repeat(labels, counts)
        seen = np.flatnonzero(weight)
        order = np.random.default_rng(len(seen)).permutation(seen)
        # at most ROUND_BATCH windows a step, and all steps of about the same size
        for rows in np.array_split(order, -(-len(order) // ROUND_BATCH)) if len(order) else []:
            x = codes[rows[:, None] * WINDOW + np.arange(WINDOW + max(WIDTHS))[None, :]]
            self._step(x, label[rows], weight[rows])
            self.windows += len(rows)

    def _step(self, x, y, weight) -> None:
        import numpy as np
        p, m = self.params, len(x)
        first, later = _folded(self.network())
        place = np.empty((m, FILTERS * len(WIDTHS)), np.int64)
        top = np.empty(place.shape, np.float32)
        for a in range(0, m, BLOCK_WINDOWS):
            one = x[a:a + BLOCK_WINDOWS].astype(np.int64)
            two = (one[:, :-1] << 8) | one[:, 1:]
            out = first.take(two[:, :WINDOW], axis=0)
            for columns, k, table in later:
                out[:, :, columns] += table.take((two if len(table) > 256 else one)[:, k:k + WINDOW], axis=0)
            out = np.ascontiguousarray(out.transpose(0, 2, 1))
            place[a:a + BLOCK_WINDOWS] = out.argmax(axis=2)
            top[a:a + BLOCK_WINDOWS] = out.max(axis=2)
        top += p["b"]
        hidden = np.maximum(top, 0)
        error = _softmax(hidden @ p["d"] + p["c"])
        error[np.arange(m), y] -= 1
        error *= (weight / max(float(weight.sum()), 1e-9))[:, None]
        back = (error @ p["d"].T) * (top > 0)
        grads = {"d": hidden.T @ error, "c": error.sum(0), "b": back.sum(0), "e": np.zeros_like(p["e"])}
        for j, w in enumerate(WIDTHS):
            columns = slice(j * FILTERS, (j + 1) * FILTERS)
            g, at, own = back[:, columns], place[:, columns], p[f"w{w}"]
            grads[f"w{w}"] = np.zeros_like(own)
            for k in range(w):
                byte = x[np.arange(m)[:, None], at + k].astype(np.int64)
                seen = np.bincount((byte * FILTERS + np.arange(FILTERS)).ravel(), g.ravel(), 256 * FILTERS).reshape(
                    256, FILTERS).astype(np.float32)
                grads[f"w{w}"][k] = p["e"].T @ seen
                grads["e"] += seen @ own[k].T
        _adam(p, self.state, grads, ROUND_RATE)


def _labelled(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """``t, label`` of the rows that have a label and a letter."""
    return docs.select(docs[text].alias("t"), docs[lang].alias("label")).filter(
        F.col("label").isNotNull() & F.rlike(F.coalesce("t", F.lit("")), F.lit(r"\p{L}")))


def trained_on_all(docs: DataFrame, network: Network, sizes: dict[str, int], text: str = "text",
                   lang: str = "lang") -> Network:
    """``network`` after a round over every window of every labelled text of ``docs``.

    ``sizes``: bytes per language, which weigh alike whatever their size. Each task trains a copy over its own rows;
    the copies' mean, weighted by their windows and added up in decimals, which no order changes, is the result. What
    leaves a task and what comes to the driver is one row per number of the network.
    """
    total = sum(sizes.values())
    weigh = {label: total / (len(sizes) * max(1, n)) for label, n in sizes.items()}

    def run(batches):
        import numpy as np
        import pyarrow as pa
        own = _Round(network)
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for start, texts in text_slices(batch.column(0)):
                mine = labels[start:start + len(texts)]
                own.learn(texts, np.array([network.languages.index(v) for v in mine]), np.array([weigh[v] for v in mine]))
        if own.windows:
            flat = own.flat()
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat, pa.float64()),
                pa.array(np.full(len(flat), own.windows), pa.int64())], names=["k", "value", "windows"])

    rows = _labelled(docs, text, lang).mapInArrow(run, "k int, value double, windows bigint")
    summed = rows.groupBy("k").agg(F.sum((F.col("value") * F.col("windows")).cast("decimal(38,9)")).alias("v"),
                                   F.sum("windows").alias("n"))
    values = [float(r["v"]) / r["n"] for r in summed.orderBy("k").collect()]  # a few thousand numbers
    return _Round(network).restored(values) if values else network


def _snippet():
    """A part of the text ``t`` from anywhere: whole, half, or an eighth of ``TRAIN_CHARS`` long."""
    size = F.element_at(F.array(*map(F.lit, (TRAIN_CHARS, TRAIN_CHARS, TRAIN_CHARS // 2, TRAIN_CHARS // 8))),
                        (F.pmod(F.xxhash64("t", F.lit(2)), F.lit(4)) + 1).cast("int"))
    start = F.pmod(F.xxhash64("t", F.lit(3)), F.greatest(F.length("t") - size, F.lit(0)) + 1).cast("int") + 1
    return F.substring("t", start, size)


def training_sample(docs: DataFrame, text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` rows ``snippet, label``: texts of each language with equal chance, one snippet from anywhere.

    Every text with a label takes part in the draw, copies once. Snippets are whole, half, or an eighth of
    ``TRAIN_CHARS`` long. Tasks drop what is drawn too late, so little more than the sample leaves them.
    """
    labelled = _labelled(docs, text, lang)
    # copies share a hash, so this counts different texts; hashes alone are shuffled
    counts = stored(labelled.select("label", F.xxhash64("t", F.lit(1)).alias("h")).distinct()
                    .groupBy("label").agg(F.count(F.lit(1)).alias("n")))  # so that the join knows how small it is
    draw = F.pmod(F.xxhash64("t", F.lit(1)), F.lit(1 << 40)) / float(1 << 40)
    narrow = labelled.select("label", draw.alias("draw"), _snippet().alias("snippet"))
    latest = 1.5 * rows / max(1, counts.count())
    return (narrow.join(counts, "label").withColumn("draw", F.col("draw") * F.col("n")).filter(F.col("draw") < latest)
            .groupBy("draw", "label").agg(F.min("snippet").alias("snippet"))
            .orderBy("draw", "label", "snippet").limit(rows).select("snippet", "label"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> Network | None:
    """A network for the languages of ``docs``, trained on all labelled texts; None without any."""
    sizes = {r["label"]: r["n"] for r in _labelled(docs, text, lang).groupBy("label").agg(
        F.sum(F.octet_length("t").cast("long")).alias("n")).collect()}  # one row per language
    if not sizes:
        return None
    sample = training_sample(docs, text, lang, rows).collect()  # bounded: rows times TRAIN_CHARS
    begun = train_network([r["snippet"] for r in sample], [r["label"] for r in sample], languages=list(sizes))
    return trained_on_all(docs, begun, sizes, text, lang) if len(sizes) > 1 else begun


class Predictor:
    """Languages and scores of texts by a network; without one every text is unknown."""

    def __init__(self, network: Network | None):
        self.network, self.folded = network, network and _folded(network)

    def _windows(self, codes, total: int):
        import numpy as np
        network = self.network
        found = np.empty((total, len(network.languages)), np.float32)
        for a in range(0, total, BLOCK_WINDOWS):
            count = min(BLOCK_WINDOWS, total - a)
            top = _strongest(self.folded, codes, a, count) + network.bias
            found[a:a + count] = _softmax(np.maximum(top, 0) @ network.dense + network.dense_bias)
        return found

    def _means(self, texts: list[str]):
        import numpy as np
        codes, counts, sizes = _codes(texts)
        probable = self._windows(codes, int(counts.sum()))
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        inside = np.arange(len(probable)) - np.repeat(starts, counts)
        weight = np.clip(np.repeat(sizes, counts) - inside * WINDOW, 0, WINDOW).astype(np.float64)
        weight[starts] = np.maximum(weight[starts], 1)
        summed = np.add.reduceat(probable * weight[:, None], starts, axis=0)
        return summed / np.add.reduceat(weight, starts)[:, None]

    def __call__(self, texts: list[str]):
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        lettered = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.network else []
        block, held = [], 0
        for k in [*lettered, None]:
            if k is not None:
                block.append(k)
                held += len(texts[k])
            if block and (k is None or held > 500_000):
                for j, row in zip(block, self._means([texts[j] for j in block])):
                    best = int(row.argmax())
                    langs[j], scores[j] = self.network.languages[best], float(min(1.0, row[best]))
                block, held = [], 0
        return langs, scores


def identify(docs: DataFrame, network: Network | None, text: str = "text", lang_pred: str = "lang_pred",
             score: str = "score") -> DataFrame:
    """All columns of ``docs`` with the language of each whole text and its score (0 to 1).

    NULL texts and texts without letters are ``und`` with score 0; so is every text if nothing could be learnt. Of
    equal scores the first language in code-point order wins. A column of ``docs`` named like an output column is
    replaced; repeated rows stay; an empty table gives an empty one; a text may be of any length.
    """
    rows, own = numbered(docs), place_of(docs, text)
    places = [k for k, name in enumerate(docs.columns) if name not in (lang_pred, score)]
    schema = T.StructType([*[rows.schema[k] for k in places], T.StructField("lang_pred", T.StringType(), False),
                           T.StructField("score", T.DoubleType(), False)])

    def run(batches):
        import pyarrow as pa
        predict = Predictor(network)
        for batch in batches:
            for start, texts in text_slices(batch.column(own)):
                langs, scores = predict(texts)
                columns = [batch.column(k).slice(start, len(texts)) for k in places]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                                 names=schema.names)

    return rows.mapInArrow(run, schema).toDF(*[docs.columns[k] for k in places], lang_pred, score)


def held_out(doc_id):
    """Whether the CRC-32 of an id as text has remainder 2 by 4; a NULL id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_calibrated(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[Network | None, float]:
    """A network as :func:`fit` trains it, and the least score of a text in a language that it knows.

    That score lies half way between an even guess and what 99 of 100 labelled texts reach with a part of theirs as
    long as a snippet; all of them are counted, in steps of one in ``SCORES``. With fewer than 50 it is the even guess.
    """
    network = fit(docs, text, lang)
    if network is None:
        return None, 1.0
    even = 1.0 / len(network.languages)
    parts = identify(_labelled(docs, text, lang).select(_snippet().alias("text")), network)
    step = F.floor(F.col("score") * SCORES).cast("int")
    counts = sorted((r["step"], r["count"]) for r in parts.groupBy(step.alias("step")).count().collect())
    total = sum(n for _, n in counts)
    if total < 50:
        return network, even
    below = 0
    for reached, n in counts:
        below += n
        if below > 0.01 * total:
            break
    return network, even + max(0.0, reached / SCORES - even) / 2


def keep_identified(docs: DataFrame, network: Network | None, least_score: float | None = None,
                    text: str = "text") -> DataFrame:
    """Rows whose language is known with at least ``least_score`` (by default that of an even guess), with all their
    columns, whatever their names.

    Rows without letters (NULL and empty texts too) go, and all rows if there is no network. Rows are decided where
    they stand; repeated rows stay or go together; an empty table gives an empty one; a text may be of any length.
    """
    if least_score is None:
        least_score = 1.0 / len(network.languages) if network else 1.0
    rows = numbered(docs)
    place = place_of(docs, text)

    def run(batches):
        import pyarrow as pa
        predict = Predictor(network)
        for batch in batches:
            for start, texts in text_slices(batch.column(place)):
                known = [lang != UNKNOWN and score >= least_score for lang, score in zip(*predict(texts))]
                yield batch.slice(start, len(texts)).filter(pa.array(known))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
