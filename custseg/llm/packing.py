"""Sum-of-squares packing of tokenized documents into sequences of bounded length.

1. Each text is tokenized where it is read; its ids (with the end id) are cut into pieces of at
   most ``max_tokens``, only longer documents into more than one. From here on only one narrow
   row per piece is kept. It is written once, so tokenizing is not repeated and lost executors
   re-read files.
2. The rows are dealt round-robin over tasks of about ``pieces_per_task`` pieces and sorted by
   falling length inside each (the sort spills). Equal keys therefore never meet in one task.
3. A task keeps N(g), the number of open sequences with g tokens left. A piece of length s goes
   into the open sequence with the gap g for which the sum of N(g)^2 becomes smallest, that is
   with the least N(g - s) - N(g); ties go to the smaller rest. A new sequence is begun only if
   the piece fits none: that costs nothing in falling order and saves sequences. Memory is the
   numbers of the open sequences.

Each task may leave one sequence or so partly filled, so the count exceeds the volume bound by
about one per task.

Defined results: a null or empty text is the end id alone; repeated rows (and a repeated or null
doc_id) are packed as documents of their own; a very long text is tokenized whole and cut into
pieces; an empty table gives an empty result. Only
``doc_id`` and ``text`` are read, so other columns of any name do no harm.
"""

from __future__ import annotations

import math
import os
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custseg.llm.bpe import byte_letters
from custseg.llm.common import map_batches, materialize_observed, texts

MAX_TOKENS = 2048
PIECES_PER_TASK = 250_000
CACHE_ENTRIES = 600_000
CACHE_CHARS = 48

# The splitting pattern of the word vocabulary, for Latin chunks without white space:
# the letters and numbers below U+0180 are written out, which plain ``re`` matches faster.
_LATIN = [chr(i) for i in range(0x180)]
_LETTERS = "".join(c for c in _LATIN if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(c for c in _LATIN if unicodedata.category(c)[0] == "N")
_WORDS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")


class WordTokenizer:
    """A word-level-split BPE tokenizer file, with a cache of white-space separated chunks.

    The tokenizer drops white space and none of its rules reaches across it, so chunks are
    independent and frequent ones are looked up. Chunks of plain Latin letters, for which
    normalization is lower-casing, go word by word to the BPE model; all others go through the
    whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")   # one core per Spark task
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.map = dict(enumerate(byte_letters()))
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        """Ids of a word without white space; its printable ASCII bytes stand for themselves."""
        ids = self.words.get(word)
        if ids is None:
            letters = (word if word.isascii()
                       else word.encode().decode("latin-1").translate(self.map))
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.tokenize(letters)])
            if len(word) <= CACHE_CHARS:
                if len(self.words) >= CACHE_ENTRIES:
                    self.words.clear()
                self.words[word] = ids
        return ids

    def _chunk(self, raw: bytes) -> bytes:
        text = raw.decode()
        if ((raw.isascii() or max(text) < "ƀ" and "İ" not in text) and text.isprintable()
                and "<|" not in text):
            text = text.lower()
            ids = (self._word(text) if text.isalpha()
                   else b"".join(map(self._word, _WORDS.findall(text))))
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids,
                           "<u4").tobytes()
        if len(raw) <= CACHE_CHARS:
            if len(self.chunks) >= CACHE_ENTRIES:
                self.chunks.clear()
            self.chunks[raw] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as packed little-endian unsigned 32-bit integers."""
        chunks = text.encode().split()
        out = list(map(self.chunks.get, chunks))
        if None in out:
            out = [self._chunk(c) if ids is None else ids for c, ids in zip(chunks, out)]
        return b"".join(out)


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a file, built once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def pieces(docs: DataFrame, path: str, end_id: int = 0,
           max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch, "text")):
                ids = tok.encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                    part = ids[at:at + 4 * max_tokens]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select("doc_id", "text"), run,
                       "doc_id long, piece int, start long, length long, ids_crc32 long")


class OpenSequences:
    """The open sequences of one task by their gap."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)     # N(g); N(0) stays 0
        self.by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.begun = 0

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) of a piece of ``size`` tokens."""
        gap = self.capacity
        if size < gap:
            n = self.count[size:gap]
            # change of the sum of squares, halved; a filled gap adds nothing
            change = np.where(n > 0, self.count[:gap - size] - n, self.begun + 1)
            best = int(change.argmin())
            if n[best] > 0:
                gap = size + best
        if gap == self.capacity:
            sequence = self.begun
            self.begun += 1
        else:
            sequence = self.by_gap[gap].pop()
            self.count[gap] -= 1
        rest = gap - size
        if rest:
            self.by_gap[rest].append(sequence)
            self.count[rest] += 1
        return sequence, self.capacity - gap


def pack(parts: DataFrame, n_pieces: int, max_tokens: int = MAX_TOKENS,
         pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """``parts`` with sequence_id and offset. ``n_pieces``: its number of rows."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_sequences = OpenSequences(max_tokens)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            places = [open_sequences.place(n) for n in batch.column("length").to_pylist()]
            seq, offset = zip(*places) if places else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + s for s in seq], pa.int64()),
                 pa.array(offset, pa.int64())],
                names=[*batch.schema.names, "sequence_id", "offset"])

    dealt = (parts.repartition(max(1, math.ceil(n_pieces / pieces_per_task)))
             .sortWithinPartitions(F.col("length").desc(), "doc_id", "piece", "ids_crc32"))
    return map_batches(dealt, run, "doc_id long, piece int, start long, length long, "
                       "ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, max_tokens: int = MAX_TOKENS,
                   pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """One row per piece of every document with its place in a sequence."""
    parts, seen = materialize_observed(pieces(docs, path, end_id, max_tokens), "pieces",
                                       n=F.count(F.lit(1)))
    return pack(parts, seen["n"], max_tokens, pieces_per_task)
