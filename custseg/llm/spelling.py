"""Spelling variants: words one edit apart, found by asymmetric q-chunks.

Two words are near if one is the other with exactly one code point inserted, deleted or replaced.

1. ``word_counts`` counts words inside each task, with a bounded table, and sums them.
2. Chunks: a word of length L is cut into two disjoint chunks, its halves. One edit lies in one of
   them and preserves the other. The word contributes its chunks; a word of the same length, or
   one code point longer, contributes its positional grams of those lengths, of which only those
   at the chunk's place, shifted by the difference of the lengths (0 or 1), can match. A half is a
   poor key: very many words begin or end alike. The chunk with the edit is therefore cut by the
   same rule again, up to ``DEPTH`` times or until it has ``SHORT`` code points: a key is all that
   is preserved, so a word has at most 2**DEPTH keys for its own length and as many as the
   longer partner. Words that share a key differ within a few code points, and what they can
   be there is bounded by the alphabet, not by the number of words.
3. Keys (64-bit hashes with length and place) are joined, and the join itself verifies each
   meeting by edit distance, so only near pairs leave it; a pair found by two keys is kept once.
   A word has at most (length x alphabet) near words, whatever the size of the table.
4. A word's form is its near word of largest count (ties: the smaller in code-point order) if
   that count is at least ``ratio`` times its own; the root follows forms to the last, by pointer
   jumping. Counts grow by ``ratio`` with each form, so the rounds are few and no cycle exists.

Defined results: a null or empty text has no words, and a null doc_id is spelt as the empty string
in the runs' checksum; equal rows count each time. Very long texts are read whole, and a very
long run is one word. Ties as above. Empty tables give empty results. ``near_words`` and
``variants`` read only ``word`` and ``n``, ``run_counts`` only ``doc_id`` and ``text``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custseg.llm.common import map_batches, materialize, materialize_observed, texts

MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
DEPTH = 3
SHORT = 3
HELD_WORDS = 200_000        # distinct words that a task counts before it passes them on

_RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % MIN_LENGTH)


def _counted(batches: Iterable[pa.RecordBatch], words_of,
             held_words: int) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()),
                                           pa.array(found.values(), pa.int64())],
                                          names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch, "text")):
            for word, n in words_of(doc_id, text):
                held[word] += n
            if len(held) > held_words:
                yield batch_of(held)
                held.clear()
    yield batch_of(held)


def planted_runs(doc_id: int | None, text: str, every: int = 31) -> Iterator[tuple[str, int]]:
    """(word, count) of a text's letter runs, A-Z lower-cased, some with a planted slip.

    A run whose checksum h with the doc_id is a multiple of ``every`` loses its code point
    h % length. Words shorter than ``MIN_LENGTH`` are left out.
    """
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    runs = Counter(_RUN.findall(text.encode().lower().decode()))    # bytes.lower: A-Z alone
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        if len(run) >= MIN_LENGTH:
            yield run, n


def run_counts(docs: DataFrame, min_count: int = MIN_COUNT, every: int = 31,
               held_words: int = HELD_WORDS) -> DataFrame:
    """(word, n): the words of ``planted_runs`` in all texts with at least ``min_count``."""
    def run(batches):
        return _counted(batches, lambda d, t: planted_runs(d, t, every), held_words)

    counted = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                          "word string, n long")
    return (counted.groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= min_count))


def edit_places(length: int) -> list[tuple[int, int]]:
    """The disjoint parts [i, j) of a word one of which holds the edit, by repeated halving."""
    def cut(i, j, depth):
        if depth == DEPTH or (depth and j - i <= SHORT):
            return [(i, j)]
        half = (i + j) // 2
        return cut(i, half, depth + 1) + cut(half, j, depth + 1)

    return cut(0, length, 0)


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places: dict[int, list[tuple[int, int]]] = {}

    def places_of(length):
        if length not in places:
            places[length] = edit_places(length)
        return places[length]

    for batch in batches:
        rows, keys, longer = [], [], []
        for row, word in enumerate(batch.column("word").to_pylist()):
            for shift in (0, 1):            # as itself, and as the longer partner
                length = len(word) - shift
                for i, j in places_of(length) if length > 0 else ():
                    kept = f"{length}:{i}:{word[:i]}:{word[j + shift:]}"
                    keys.append(xxhash.xxh3_64_intdigest(kept.encode()) - (1 << 63))
                    rows.append(row)
                    longer.append(shift == 1)
        at = pa.array(rows, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), batch.column("word").take(at),
             batch.column("n").take(at), pa.array(longer, pa.bool_())],
            names=["key", "word", "n", "longer"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of near words of a (word, n) table."""
    keys = materialize(map_batches(words.select("word", F.col("n").cast("long").alias("n")), _keys,
                                   "key long, word string, n long, longer boolean"),
                       "spelling-keys")
    a = keys.filter(~F.col("longer")).select("key", "word", "n")
    b = keys.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"), "longer")
    pairs = (a.join(b, "key").filter(F.col("longer") | (F.col("word") < F.col("near")))
             .filter(F.levenshtein("word", "near", 1) == 1)
             .select("word", "n", "near", "near_n").distinct())
    pairs = materialize(pairs, "spelling-pairs")
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"),
                                          F.col("word").alias("near"),
                                          F.col("n").alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last form that the forms lead to."""
    found = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found, seen = materialize_observed(
            found.join(up, "root", "left")
            .select("word", F.coalesce("next", "root").alias("root"),
                    F.col("next").isNotNull().alias("moved")),
            "spelling-roots", moved=F.count_if(F.col("moved")))
        found = found.select("word", "root")
        if not seen["moved"]:
            return found


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of a (word, n) table."""
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    # the largest count first, then the smaller word
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    formed = -F.col("best.less") >= ratio * F.col("n")
    joined = materialize(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("best.near")).alias("form"),
        F.when(formed, -F.col("best.less")).alias("form_n")), "spelling-forms")
    ends = roots(joined.filter(F.col("form").isNotNull()))
    return joined.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
