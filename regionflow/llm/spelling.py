"""Spelling variants: near words by a variable-length gram index, and the frequent form that each stands for.

1. Words are counted over whole texts; tasks add up what they meet before anything is shuffled.
2. Grams of the words' two to ``LONGEST`` characters are counted; those above a share of the words are frequent. That
   bounded set is the dictionary (see :mod:`regionflow.llm.grams`).
3. Every word is decomposed once for pairs of its own length and once as the longer word of a pair. Of its grams the
   rarest ones, one more than a single edit can change, are posted. Words one edit apart share one of them, by text
   and, up to the edit's shift, by place. The edit lies right or left of the shared gram, so what stands on its other
   side is equal as well: a list is filed under the gram, its place and the text on one side, which keeps it short.
4. Lists are merged by a join whose condition verifies the pair: first the sets of their letters, as bits, which one
   edit changes by two at most, then the words themselves.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionflow.llm.common import column_of, numbered, stored, text_slices
from regionflow.llm.grams import MARK, SHORTEST, GramDictionary, longest_gram

#: Longest gram; a gram is frequent if more than this share of the words, and ``LEAST_FREQUENT`` words, hold it.
LONGEST, SHARE, LEAST_FREQUENT = 5, 0.0001, 50
#: Distinct words that a task counts before it hands them on.
TABLE_WORDS = 200_000
#: The index needs words of so many code points.
LEAST_LENGTH = 7
#: Runs of letters, as the contract of the words fixes them.
RUN = "[A-Za-zÀ-ÿ]+"


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, one_in: int = 31, doc_id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """``word, n``: words of at least ``least_length`` code points and their occurrences in all texts.

    A word is a run of letters with A-Z lower-cased. Where ``one_in`` divides the CRC-32 of ``<doc_id>:<run>``, the
    code point at that number modulo the run's length is deleted. NULL texts have none; a NULL id is an empty text.
    """
    def run(batches):
        import re
        import zlib
        from collections import Counter

        import pyarrow as pa
        runs, lower = re.compile(RUN), {k: k + 32 for k in range(65, 91)}

        def handed(counts):
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())],
                                              names=["word", "n"])

        counts = Counter()
        for batch in batches:
            for start, texts in text_slices(batch.column(1)):
                for number, whole in zip(batch.column(0).slice(start, len(texts)).to_pylist(), texts):
                    begun = zlib.crc32(f"{'' if number is None else number}:".encode())
                    for word, n in Counter(runs.findall(whole.translate(lower))).items():
                        if len(word) < least_length:
                            continue
                        code = zlib.crc32(word.encode(), begun)
                        if code % one_in == 0:
                            place = code % len(word)
                            word = word[:place] + word[place + 1:]
                            if len(word) < least_length:
                                continue
                        counts[word] += n
                    if len(counts) > TABLE_WORDS:
                        yield handed(counts)
                        counts = Counter()
        if counts:
            yield handed(counts)

    rows = numbered(docs).select(column_of(docs, doc_id).cast("string"), column_of(docs, text))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_grams(words: DataFrame, longest: int = LONGEST, share: float = SHARE,
                   least: int = LEAST_FREQUENT) -> dict[str, int]:
    """Grams that more words hold than ``share`` of them, with their counts.

    No length has more than (places of a word) / ``share`` of them, and prefixes of a frequent gram are frequent.
    """
    marked = words.select(F.concat(F.lit(MARK), "word", F.lit(MARK)).alias("m"))

    def cut(size: int):
        return F.transform(F.sequence(F.lit(1), F.length("m") - (size - 1)), lambda p: F.substring("m", p, F.lit(size)))

    grams = F.array_distinct(F.concat(*map(cut, range(SHORTEST, longest + 1))))
    counts = marked.select(F.explode(grams).alias("gram")).groupBy("gram").count()
    enough = max(least, share * words.count())
    return {r["gram"]: r["count"] for r in counts.filter(F.col("count") > enough).collect()}


def _postings(words: DataFrame, frequent, longest: int) -> DataFrame:
    """``list, longer, word, n, letters``: where a word stands as one of equal length and where as the longer one of a pair."""
    def run(batches):
        import pyarrow as pa
        dictionaries = {q: GramDictionary(frequent.value, q) for q in range(3, longest + 1)}
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                at, lists, longer, letters = [], [], [], []
                for k, word in enumerate(part.column(0).to_pylist()):
                    marked, length = f"{MARK}{word}{MARK}", len(word)
                    letters.append(sum(1 << k for k in {ord(c) % 63 for c in word}))
                    for more in (0, 1) if length > LEAST_LENGTH else (0,):
                        grams = dictionaries[longest_gram(length - more, longest)].rarest(marked)
                        for place, gram in grams:
                            end = place + len(gram)
                            # an edit on the right leaves what is left of the gram, and its place; and the reverse
                            lists.append(f"{length - more}<{place}<{marked[:end]}")
                            lists.append(f"{length - more}>{place - more}>{marked[place:]}")
                        at += [k] * (2 * len(grams))
                        longer += [more == 1] * (2 * len(grams))
                at = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists, pa.string()), pa.array(longer, pa.bool_()), part.column(0).take(at),
                     part.column(1).take(at), pa.array(letters, pa.int64()).take(at)],
                    names=["list", "longer", "word", "n", "letters"])

    schema = "list string, longer boolean, word string, n bigint, letters bigint"
    return words.select("word", "n").mapInArrow(run, schema).select(
        F.xxhash64("list").alias("list"), "longer", "word", "n", "letters")


def near_words(words: DataFrame, longest: int = LONGEST, share: float = SHARE, least: int = LEAST_FREQUENT) -> DataFrame:
    """Ordered pairs ``word, n, near, near_n`` of different ``words`` (``word, n``; each of 7 code points or more, none
    with the mark) that one inserted, deleted or replaced code point tells apart; each once."""
    frequent = words.sparkSession.sparkContext.broadcast(frequent_grams(words, longest, share, least))
    posted = stored(_postings(words, frequent, longest))
    other = posted.select("list", "longer", F.col("word").alias("near"), F.col("n").alias("near_n"),
                          F.col("letters").alias("near_letters"))
    verified = ((F.bit_count(F.col("letters").bitwiseXOR(F.col("near_letters"))) <= 2)
                & (F.levenshtein("word", "near", 1) == 1))
    pairs = (posted.filter("not longer").drop("longer").join(other, "list")
             .filter((F.col("longer") | (F.col("word") < F.col("near"))) & verified)
             .select("word", "n", "near", "near_n"))
    both = pairs.select(F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(
        F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"),
        F.col("n").alias("near_n")))).alias("p")).select("p.*")
    # a pair may share several lists; a word has boundedly many near ones, so it may gather them
    return both.repartition("word").dropDuplicates(["word", "near"])


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_n: int = 2, times: int = 10,
                      doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row ``word, form, root, n, n_near, form_n`` per word of ``least_length`` code points (7 or more) that occurs
    ``least_n`` times.

    ``form`` is the near word that occurs most (ties: the smallest in code-point order) if it does at least ``times``
    (2 or more) as often, else NULL; ``root`` is where following forms ends. Rows with NULL or repeated ids count like
    any; NULL and empty texts have no words; other columns are left out, whatever their names; an empty table gives an
    empty one; a text may be of any length.
    """
    if least_length < LEAST_LENGTH or times < 2:
        raise ValueError("the index needs words of seven characters, and forms must occur more often than their variants")
    words = stored(word_counts(docs, least_length, doc_id=doc_id, text=text).filter(F.col("n") >= least_n))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("b")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    judged = words.join(near, "word", "left")
    enough = -F.col("b.less") >= F.lit(times) * F.col("n")
    judged = stored(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                                  F.when(enough, F.col("b.near")).alias("form"),
                                  F.when(enough, -F.col("b.less")).alias("form_n")))
    # Each form occurs ``times`` as often as its variant, so chains are short, and doubling halves them each round.
    roots = stored(judged.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(roots.join(further, "root", "left").select("word", "root", "next"))
        if moved.filter("next is not null").isEmpty():
            break
        roots = moved.select("word", F.coalesce("next", "root").alias("root"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
