"""Line deduplication by range-partitioned line hashes and a streamed sort.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. A key of at
least ``min_chars`` code points that occurs in at least ``min_docs`` documents keeps its lines
only in the largest ``doc_id`` that holds it.

1. Every document is split into lines; each distinct key gives one row (128-bit hash, doc_id,
   positions). Lines repeated inside a document are folded there, before any shuffle.
2. The rows are range-partitioned by (hash, doc_id descending) and sorted the same way. The
   doc_id in the range key lets a line that a third of all documents hold spread over many
   tasks instead of one.
3. Each task streams its rows: the first document of a run is the one that keeps the line, and
   once ``min_docs`` documents were seen the rest of the run is dropped as it passes. At most
   ``min_docs - 1`` documents are buffered. Only the first and the last run of a task can reach
   into a neighbour; they leave one summary row each (at most two per task), and the few runs
   that were cut are decided from the sum of these.
4. Dropped positions are grouped by document into zlib-compressed keep bitmaps. No text takes
   part in steps 1-4; ``apply_bitmaps`` joins the bitmaps back to the texts.

Defined results: a null or empty text is one empty line. Rows that share a ``doc_id`` count as
one document; equal rows get the same bitmap. A null ``doc_id`` is one document that is smaller
than all others. Empty tables give empty results. Extra columns are not read by
``keep_bitmaps`` and pass through ``apply_bitmaps`` and ``drop_repeated_lines`` unchanged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custseg.llm.common import ASCII_SPACE, map_batches, materialize, ship, texts

MIN_CHARS = 40
MIN_DOCS = 5
SALTS = 64

_LINES = "h1 long, h2 long, doc_id long, text_key long, n_lines int, positions array<int>"
_DROPPED, _OPEN, _SUMMARY = 0, 1, 2


def _text_key():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _extract(min_chars: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            keys = batch.column("text_key").to_pylist()
            h, docs, tkeys, counts, pos = [], [], [], [], []
            for doc_id, tkey, text in zip(ids, keys, texts(batch, "text")):
                found: dict[bytes, list[int]] = {}
                lines = text.split("\n")
                for i, line in enumerate(lines):
                    if len(line) >= min_chars:
                        stripped = line.strip(ASCII_SPACE)
                        if len(stripped) >= min_chars:      # bytes.lower changes A-Z alone
                            found.setdefault(
                                xxhash.xxh3_128_digest(stripped.encode().lower()), []).append(i)
                for digest, where in found.items():
                    h.append(digest)
                    docs.append(doc_id)
                    tkeys.append(tkey)
                    counts.append(len(lines))
                    pos.append(where)
            pair = np.frombuffer(b"".join(h), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(docs, pa.int64()),
                 pa.array(tkeys, pa.int64()), pa.array(counts, pa.int32()),
                 pa.array(pos, pa.list_(pa.int32()))],
                names=["h1", "h2", "doc_id", "text_key", "n_lines", "positions"])

    return run


class _Run:
    """Rows of one hash as they pass, in falling order of document."""

    def __init__(self, key, first_in_task: bool, min_docs: int):
        self.key, self.first_in_task, self.min_docs = key, first_in_task, min_docs
        self.n_docs, self.keeper, self.last, self.held = 0, None, object(), []

    def take(self, doc_id, row, out) -> None:
        if doc_id != self.last:
            self.n_docs, self.last = self.n_docs + 1, doc_id
            if self.n_docs == 1:
                self.keeper = doc_id
        if self.first_in_task:           # an earlier task may hold larger documents
            out.append((_OPEN, *self.key, *row))
        elif self.n_docs < self.min_docs:
            self.held.append((doc_id, row))
        else:
            for old, kept in [*self.held, (doc_id, row)]:
                if old != self.keeper:
                    out.append((_DROPPED, *self.key, *kept))
            self.held = []

    def cut(self, out) -> None:
        """The task ends here: what is undecided stays open, and the run is summed up."""
        for _, row in self.held:
            out.append((_OPEN, *self.key, *row))
        out.append((_SUMMARY, *self.key, self.keeper, None, self.n_docs, None))


_STREAM = "kind int, " + _LINES
_STREAM_ARROW = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()),
                           ("doc_id", pa.int64()), ("text_key", pa.int64()),
                           ("n_lines", pa.int32()), ("positions", pa.list_(pa.int32()))])


def _stream(min_docs: int):
    def table(out):
        cols = list(zip(*out)) if out else [[]] * len(_STREAM_ARROW)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(cols, _STREAM_ARROW)], schema=_STREAM_ARROW)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ended_first = None, False
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            out: list[tuple] = []
            h1 = batch.column("h1").to_numpy(zero_copy_only=False)
            h2 = batch.column("h2").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
            starts = np.concatenate(([0], starts, [n]))
            length = np.diff(starts)
            # a single row inside the batch is a line of one document: nothing to decide
            busy = np.flatnonzero(length > 1).tolist()
            segments = sorted({0, len(length) - 1, *busy})
            rows = batch.select(["doc_id", "text_key", "n_lines", "positions"])
            for s in segments:
                a, b = int(starts[s]), int(starts[s + 1])
                key = (int(h1[a]), int(h2[a]))
                if current is None or current.key != key:
                    if current is not None and current.first_in_task:
                        current.cut(out)
                        ended_first = True
                    current = _Run(key, current is None and not ended_first, min_docs)
                part = rows.slice(a, b - a)
                for row in zip(*(part.column(i).to_pylist() for i in range(4))):
                    current.take(row[0], row, out)
            yield table(out)
        if current is not None:
            out = []
            current.cut(out)
            yield table(out)

    return run


def _bitmaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines = batch.column("n_lines").to_pylist()
        maps, dropped = [], []
        for n, parts in zip(n_lines, batch.column("parts").to_pylist()):
            keep = np.ones(n, dtype=bool)
            for p in parts:
                keep[p] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
            dropped.append(int(n - keep.sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), batch.column("n_lines"),
             pa.array(dropped, pa.int32()), pa.array(maps, pa.binary())],
            names=["doc_id", "text_key", "n_lines", "n_dropped", "keep_bitmap"])


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS,
                 min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per document that loses lines: (doc_id, text_key, n_lines, n_dropped, keep_bitmap).

    ``keep_bitmap`` is the zlib-compressed bit string (most significant bit first) of the kept
    lines; documents without a row keep all lines. ``text_key`` tells apart rows that share a
    doc_id.
    """
    if min_docs < 2:
        raise ValueError("min_docs must be at least 2")
    lines = map_batches(docs.select("doc_id", "text", _text_key().alias("text_key")),
                        _extract(min_chars), _LINES)
    lines = materialize(lines, "line-hashes")          # the range partition samples its input
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc_nulls_last()]
    streamed = map_batches(lines.repartitionByRange(*order).sortWithinPartitions(*order),
                           _stream(min_docs), _STREAM)
    streamed = materialize(streamed, "line-runs")      # read twice below
    # at most two summary rows per task of the streamed stage
    cut = (streamed.filter(F.col("kind") == _SUMMARY).groupBy("h1", "h2")
           .agg(F.sum("n_lines").alias("n_docs"), F.max("doc_id").alias("keeper"))
           .filter(F.col("n_docs") >= min_docs))
    fields = ["doc_id", "text_key", "n_lines", "positions"]
    # a line that fills several tasks has very many open rows: they are dealt over salts
    cut = cut.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    open_ = (streamed.filter(F.col("kind") == _OPEN)
             .withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)).cast("int")))
    late = (open_.join(cut, ["h1", "h2", "salt"])
            .filter(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select(*fields))
    dropped = streamed.filter(F.col("kind") == _DROPPED).select(*fields).unionByName(late)
    per_doc = (dropped.groupBy("doc_id", "text_key")
               .agg(F.max("n_lines").alias("n_lines"), F.collect_list("positions").alias("parts")))
    return map_batches(per_doc, _bitmaps,
                       "doc_id long, text_key long, n_lines int, n_dropped int, keep_bitmap binary")


def kept_lines(text: str, bitmap: bytes | None) -> str:
    """The text without its dropped lines."""
    if bitmap is None:
        return text
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines))
    return "\n".join([line for line, bit in zip(lines, bits.tolist()) if bit])


def n_dropped(bitmap: bytes | None, n_lines: int) -> int:
    """How many of ``n_lines`` lines the bitmap drops."""
    if bitmap is None:
        return 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines)
    return int(n_lines - bits.sum())


def _marked(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(row, keep_bitmap): the input row is one column, so that none of its names can clash."""
    b = bitmaps.select(F.col("doc_id").alias("b_doc"), F.col("text_key").alias("b_key"),
                       "keep_bitmap")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"),
                       _text_key().alias("key"))
    return (rows.join(b, F.col("id").eqNullSafe(F.col("b_doc")) & (F.col("key") == F.col("b_key")),
                      "left").select("row", "keep_bitmap"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with a column ``keep_bitmap`` (null where every line is kept)."""
    return _marked(docs, bitmaps).select("row.*", "keep_bitmap")


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS,
                        min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text`` (``n_chars`` follows the text)."""
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = dict(zip(names, batch.column("row").flatten()))
            new = [t if m is None else kept_lines(t or "", m)
                   for t, m in zip(cols["text"].to_pylist(),
                                   batch.column("keep_bitmap").to_pylist())]
            cols["text"] = pa.array(new, cols["text"].type)
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in new],
                                           cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=names)

    ship(docs.sparkSession)
    return _marked(docs, keep_bitmaps(docs, min_chars, min_docs)).mapInArrow(run, docs.schema)
