"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A text (A-Z lower-cased, UTF-8) is a sequence of bytes followed by one end symbol, the byte 0xFF,
which no text holds; before the text stand ``DEPTH`` end symbols as context. A byte is eight
binary decisions; each decision, named by the bits before it, has its own context tree over the
``DEPTH`` bytes before the symbol. A node (context, bits so far) holds how often 0 and 1 followed in
the training texts. Its Krichevsky-Trofimov estimate and the product of its children's weighted
probabilities are mixed half and half, from the deepest contexts up; that gives each node its
weight, and a decision's probability is the mixture of the estimates on its path.

The Krichevsky-Trofimov probability of a node depends on its counts alone, so the tree is built from
counts that Spark sums, and every distinct gram (context and symbol) has one probability:

1. Texts are packed into blocks of at most ``BLOCK_BYTES`` (more only for one longer text), written
   once, compressed. A block gives its distinct grams and words with their training counts; those
   of held-out texts count 0 but are asked for.
2. Grams are summed over blocks. Grams whose ``DEPTH - 2`` nearest context bytes agree go to one
   bucket (at most 2**24 such grams exist, whatever the corpus), which builds the two deepest levels
   in numpy; the levels above are aggregated one by one as tables of (context, bits).
3. From the root down, the mixtures over the upper levels are joined level by level, and the
   buckets turn them into the log probability of each gram.
4. Grams and words are joined with the blocks that asked for them, and every block scores its texts
   with its own grams. The model is never collected or broadcast; it grows with the corpus.

The base score is a word unigram model with add-one smoothing: tokens are the words (maximal runs
without ASCII white space) and one end per text.

Defined results: a null or empty text is its end symbol and end token alone. A null doc_id is not
held out by ``score``'s default rule. Equal rows count, and are scored, one by one. Very long texts
are whole; one longer than a block is a block of its own. Without training texts every decision
has probability 1/2 and no token is known. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custseg.llm.common import map_batches, materialize, materialize_observed, ship, texts

DEPTH = 4
UPPER = DEPTH - 2           # levels 0..UPPER are tables, the deeper ones are built in the buckets
BLOCK_BYTES = 32 << 20
PACK_BYTES = 4 << 20
GRAMS_PER_BUCKET = 250_000
END = b"\xff"

_PACKS = "block long, ids array<long>, train array<boolean>, sizes array<int>, payload binary"
_PACKS_ARROW = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())),
                          ("train", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())),
                          ("payload", pa.binary())])


# -- blocks ----------------------------------------------------------------------------------
def _packer(block_bytes: int, pack_bytes: int):
    """Texts, lower-cased and compressed, in packs; packs in blocks of their task."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids, train, parts, held, filled = [], [], [], 0, 0

        def pack():
            payload = zstandard.ZstdCompressor(level=3).compress(b"".join(parts))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in
                 zip(([block], [ids], [train], [[len(p) for p in parts]], [payload]),
                     _PACKS_ARROW)], schema=_PACKS_ARROW)

        for batch in batches:
            for doc_id, learn, text in zip(batch.column("doc_id").to_pylist(),
                                           batch.column("train").to_pylist(),
                                           texts(batch, "text")):
                raw = text.encode().lower()         # bytes.lower changes A-Z alone
                new_block = filled + held + len(raw) > block_bytes
                if parts and (new_block or held + len(raw) > pack_bytes):
                    yield pack()
                    filled += held
                    ids, train, parts, held = [], [], [], 0
                if filled and new_block:
                    block, filled = block + 1, 0
                ids.append(doc_id)
                train.append(learn)
                parts.append(raw)
                held += len(raw)
        if parts:
            yield pack()

    return run


def _unpacked(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, list, list, list[bytes]]]:
    """(block, ids, train, texts) of each pack."""
    for row in range(batch.num_rows):
        block, ids, train, sizes, payload = (batch.column(n)[row].as_py()
                                             for n in _PACKS_ARROW.names)
        raw, parts, at = zstandard.ZstdDecompressor().decompress(payload), [], 0
        for size in sizes:
            parts.append(raw[at:at + size])
            at += size
        yield block, ids, train, parts


def gram_keys(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, valid, first): the grams of non-empty texts, one after the other.

    A key holds the context, nearest byte first, and the symbol lowest. ``valid``: the gram is of a
    symbol and not of the padding; ``first``: where each text's grams begin.
    """
    pad = END * DEPTH
    raw = np.frombuffer(pad + b"".join([p + pad for p in parts]), np.uint8)
    n = len(raw) - DEPTH
    keys = raw[DEPTH:].astype(np.int64)
    for j in range(1, DEPTH + 1):
        keys |= raw[DEPTH - j:DEPTH - j + n].astype(np.int64) << (8 * (DEPTH - j + 1))
    # an end symbol after an end symbol is padding: empty texts are not among the parts
    valid = (raw[DEPTH:] != 255) | (raw[DEPTH - 1:-1] != 255)
    sizes = np.array([len(p) + DEPTH for p in parts], np.int64)
    return keys, valid, np.concatenate(([0], np.cumsum(sizes)[:-1]))


EMPTY_KEY = (1 << 8 * (DEPTH + 1)) - 1      # the end symbol of an empty text


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    return every, np.bincount(at, np.concatenate(counts), len(every)).astype(np.int64)


def _gram_counts(train: list[bool], parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of a pack and how many are of training texts."""
    full = [(t, p) for t, p in zip(train, parts) if p]
    found, counts = [], []
    if len(full) < len(parts):
        found.append(np.array([EMPTY_KEY]))
        counts.append(np.array([sum(t for t, p in zip(train, parts) if not p)]))
    if full:
        keys, valid, _ = gram_keys([p for _, p in full])
        learn = np.repeat([t for t, _ in full], [len(p) + DEPTH for _, p in full])
        both, n = np.unique((keys << 1 | learn)[valid], return_counts=True)
        n[both & 1 == 0] = 0
        start = np.flatnonzero(np.diff(both >> 1, prepend=-1))
        found.append(both[start] >> 1)
        counts.append(np.add.reduceat(n, start))
    return _merge(found, counts)


def _per_block(batches, add, batch_of) -> Iterator[pa.RecordBatch]:
    """Runs ``add`` on the packs of each block in turn and gives ``batch_of(block)`` at its end."""
    current = None
    for batch in batches:
        for block, _, train, parts in _unpacked(batch):
            if current is not None and block != current:
                yield batch_of(current)
            current = block
            add(train, parts)
    if current is not None:
        yield batch_of(current)


def _block_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def add(train, parts):
        held.append(_gram_counts(train, parts))
        if len(held) > 1:
            held[:] = [_merge(*map(list, zip(*held)))]

    def batch_of(block):
        keys, n = held.pop()
        return pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array(np.full(len(keys), block)), pa.array(n)],
            names=["key", "block", "n"])

    return _per_block(batches, add, batch_of)


def _block_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def add(train, parts):
        for learn, part in zip(train, parts):
            words = part.split()                    # bytes.split cuts at ASCII white space alone
            words.append(b"")                       # the end
            if learn:
                held.update(words)
            else:
                for word in words:
                    held.setdefault(word, 0)

    def batch_of(block):
        out = pa.RecordBatch.from_arrays(
            [pa.array(held.keys(), pa.binary()), pa.array(np.full(len(held), block)),
             pa.array(held.values(), pa.int64())], names=["word", "block", "n"])
        held.clear()
        return out

    return _per_block(batches, add, batch_of)


# -- the tree --------------------------------------------------------------------------------
def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series at x + 8, carried back by the recurrence."""
    z, back = x + 8.0, np.zeros_like(x)
    for k in range(8):
        back += np.log(x + k)
    inv = 1 / z
    series = inv / 12 - inv ** 3 / 360 + inv ** 5 / 1260 - inv ** 7 / 1680
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - back


def weigh(zeros, ones, below) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log weighted probability, weight of the node's own estimate, estimate of a 1).

    ``below``: the sum of the children's log weighted probabilities; None in the deepest level.
    """
    zeros, ones = zeros.astype(float), ones.astype(float)
    own = (log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1)
           - math.log(math.pi))
    estimate = (ones + 0.5) / (zeros + ones + 1)
    if below is None:
        return own, np.ones_like(own), estimate
    mixed = np.logaddexp(own, below) - math.log(2)
    return mixed, np.exp(own - math.log(2) - mixed), estimate


class _Level:
    """The nodes of one depth and bit place: ids (context and bits so far), sorted."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray, place: int):
        # symbols: context and symbol, sorted, so the nodes are runs
        self.place = place
        ids = symbols >> (8 - place)
        start = np.flatnonzero(np.diff(ids, prepend=-1))
        self.ids = ids[start]
        bit = symbols >> (7 - place) & 1
        self.ones = np.add.reduceat(counts * bit, start)
        self.zeros = np.add.reduceat(counts, start) - self.ones

    def parents(self) -> np.ndarray:
        """The ids of the nodes one byte of context shorter."""
        bits = self.ids & ((1 << self.place) - 1)
        return self.ids >> (self.place + 8) << self.place | bits

    def context(self) -> np.ndarray:
        return self.ids >> self.place

    def node(self) -> np.ndarray:
        return self.ids & ((1 << self.place) - 1) | 1 << self.place


def _levels(keys: np.ndarray, counts: np.ndarray) -> list[list[_Level]]:
    """The levels below ``UPPER`` of a bucket, deepest first, eight bit places each; weighed."""
    out: list[list[_Level]] = []
    symbols = keys
    for depth in range(DEPTH, UPPER, -1):
        if out:                                     # the oldest byte of the context goes
            symbols, counts = _merge([symbols >> 16 << 8 | symbols & 255], [counts])
        level = [_Level(symbols, counts, place) for place in range(8)]
        for here, deeper in zip(level, out[-1] if out else [None] * 8):
            below = None
            if deeper is not None:
                deeper.at = np.searchsorted(here.ids, deeper.parents())
                below = np.bincount(deeper.at, deeper.log_mixed, len(here.ids))
            here.log_mixed, here.weight, here.estimate = weigh(here.zeros, here.ones, below)
        out.append(level)
    return out


def _sorted_grams(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = table.column("key").to_numpy()
    order = np.argsort(keys)
    return keys[order], table.column("n").to_numpy()[order]


_NODES = "ctx long, node int, zeros long, ones long, below double"


def _up(table: pa.Table) -> pa.Table:
    """A bucket's part of the nodes at depth ``UPPER``."""
    top = _levels(*_sorted_grams(table))[-1]
    ctx = np.concatenate([x.context() >> 8 for x in top])
    node = np.concatenate([x.node() for x in top])
    ids, at = np.unique(ctx << 8 | node, return_inverse=True)
    sums = [np.bincount(at, np.concatenate([getattr(x, name) for x in top]), len(ids))
            for name in ("zeros", "ones", "log_mixed")]
    return pa.table([pa.array(ids >> 8), pa.array((ids & 255).astype(np.int32)),
                     pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)),
                     pa.array(sums[2])], names=["ctx", "node", "zeros", "ones", "below"])


def _down(grams: pa.Table, upper: pa.Table) -> pa.Table:
    """Log probabilities (base 10) of a bucket's grams, from the mixtures of the upper levels."""
    if grams.num_rows == 0:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.float64())],
                        names=["key", "logp"])
    keys, counts = _sorted_grams(grams)
    levels = _levels(keys, counts)
    ids = upper.column("ctx").to_numpy() << 8 | upper.column("node").to_numpy()
    order = np.argsort(ids)
    ids, ones, left = (ids[order], upper.column("ones").to_numpy()[order],
                       upper.column("left").to_numpy()[order])
    logp = np.zeros(len(keys))
    for place in range(8):
        top = levels[-1][place]
        at = np.searchsorted(ids, top.context() >> 8 << 8 | top.node())
        p_one, rest = ones[at], left[at]
        for depth in range(len(levels) - 1, -1, -1):
            level = levels[depth][place]
            p_one = p_one + rest * level.weight * level.estimate
            rest = rest * (1 - level.weight)
            if depth:
                deeper = levels[depth - 1][place]
                p_one, rest = p_one[deeper.at], rest[deeper.at]
        of_gram = np.searchsorted(levels[0][place].ids, keys >> (8 - place))
        one = p_one[of_gram]
        logp += np.log10(np.where(keys >> (7 - place) & 1, one, 1 - one))
    return pa.table([pa.array(keys), pa.array(logp)], names=["key", "logp"])


def _weigh_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        zeros, ones, below = (batch.column(c).to_numpy(zero_copy_only=False)
                              for c in ("zeros", "ones", "below"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("ctx"), batch.column("node"), batch.column("zeros"),
             batch.column("ones"), *map(pa.array, weigh(zeros, ones, below))],
            names=["ctx", "node", "zeros", "ones", "log_mixed", "weight", "estimate"])


def gram_probabilities(counts: DataFrame, n_grams: int,
                       per_bucket: int = GRAMS_PER_BUCKET) -> DataFrame:
    """(key, logp) for every row of (key, n): distinct grams and their training counts."""
    buckets = max(1, math.ceil(n_grams / per_bucket))

    def bucket(ctx: Column) -> Column:
        return F.pmod(F.xxhash64(ctx), F.lit(buckets)).alias("bucket")

    ship(counts.sparkSession)
    grams = counts.select("key", "n", bucket(F.shiftright("key", 8 * (DEPTH - UPPER + 1))))
    level = grams.groupBy("bucket").applyInArrow(_up, _NODES)
    levels = []
    for _ in range(UPPER + 1):
        summed = level.groupBy("ctx", "node").agg(
            *[F.sum(c).alias(c) for c in ("zeros", "ones", "below")])
        levels.append(materialize(map_batches(
            summed, _weigh_rows, "ctx long, node int, zeros long, ones long, log_mixed double, "
            "weight double, estimate double"), "ctw-level"))
        level = levels[-1].select(F.shiftright("ctx", 8).alias("ctx"), "node", "zeros", "ones",
                                  F.col("log_mixed").alias("below"))
    # ones: the mixture's share of a 1 so far; left: the weight not given away yet
    mixed = levels[-1].select("ctx", "node", (F.col("weight") * F.col("estimate")).alias("ones"),
                              (1 - F.col("weight")).alias("left"))
    for deeper in levels[-2::-1]:
        up = mixed.select(F.col("ctx").alias("up"), "node", "ones", "left")
        mixed = (deeper.select("ctx", "node", "weight", "estimate",
                               F.shiftright("ctx", 8).alias("up")).join(up, ["up", "node"])
                 .select("ctx", "node",
                         (F.col("ones") + F.col("left") * F.col("weight") * F.col("estimate"))
                         .alias("ones"),
                         (F.col("left") * (1 - F.col("weight"))).alias("left")))
    mixed = mixed.select(bucket(F.col("ctx")), "ctx", "node", "ones", "left")
    return (grams.groupBy("bucket").cogroup(mixed.groupBy("bucket"))
            .applyInArrow(_down, "key long, logp double"))


# -- scores ----------------------------------------------------------------------------------
_SCORED = ("doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, "
           "known_log double, score double")
_HASH = np.uint64(0x9E3779B97F4A7C15)       # odd multiplier of Fibonacci hashing


class _Table:
    """Grams to values by open addressing; every key asked for is held."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 2.5).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits)
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]
            placed = self.keys[at] == keys[left]
            self.values[at[placed]] = values[left[placed]]
            left = left[~placed]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _HASH >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slots(keys)
        left = np.flatnonzero(self.keys[slot] != keys)
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            if (self.keys[slot[left]] == -1).any():
                raise KeyError("a gram of the block has no probability")
            left = left[self.keys[slot[left]] != keys[left]]
        return self.values[slot]


def _score_block(packs: pa.Table, answers: pa.Table) -> pa.Table:
    cols: list[list] = [[] for _ in range(7)]
    is_gram = answers.column("word").is_null()
    grams, words = answers.filter(is_gram), answers.filter(pa.compute.invert(is_gram))
    keys, first = np.unique(grams.column("key").to_numpy(), return_index=True)
    table = _Table(keys, grams.column("value").to_numpy()[first])
    known = dict(zip(words.column("word").to_pylist(), words.column("value").to_pylist()))
    empty = np.array([EMPTY_KEY])
    for _, ids, train, parts in _unpacked(packs):
        full = [p for p in parts if p]
        scores = iter(())
        if full:
            grams_of, valid, first = gram_keys(full)
            value = np.zeros(len(grams_of))
            value[valid] = table.get(grams_of[valid])
            scores = iter(np.add.reduceat(value, first).tolist())
        for doc_id, learn, part in zip(ids, train, parts):
            tokens = part.split()
            tokens.append(b"")
            logs = [known.get(t, 0.0) for t in tokens]
            row = (doc_id, not learn, len(tokens), len(logs) - logs.count(0.0), len(part),
                   math.fsum(logs), next(scores) if part else float(table.get(empty)[0]))
            for col, x in zip(cols, row):
                col.append(x)
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(),
             pa.float64()]
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)],
                    names=[x.split()[0] for x in _SCORED.split(", ")])


def crc32_held_out(every: int = 7, remainder: int = 2) -> Column:
    """Documents whose crc32 of the doc_id as text leaves ``remainder``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == remainder


def score(docs: DataFrame, held_out: Column | None = None, block_bytes: int = BLOCK_BYTES,
          pack_bytes: int = PACK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes,
    bits_per_byte) for every row; the scores are log10 probabilities.

    The model learns from the rows for which ``held_out`` (a condition on columns of ``docs``) isn't
    true. ``bits_per_byte``: the code length by byte of the text, its end included.
    """
    rule = F.coalesce(crc32_held_out() if held_out is None else held_out, F.lit(False))
    packs = materialize(map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~rule).alias("train")),
        _packer(block_bytes, pack_bytes), _PACKS), "ctw-blocks")

    asked = materialize(map_batches(packs, _block_grams, "key long, block long, n long"),
                        "ctw-grams")
    counts, seen = materialize_observed(asked.groupBy("key").agg(F.sum("n").alias("n")),
                                        "ctw-counts", grams=F.count(F.lit(1)))
    logp = gram_probabilities(counts, seen["grams"])
    grams = asked.select("key", "block").join(logp, "key").select(
        "block", "key", F.col("logp").alias("value"), F.lit(None).cast("binary").alias("word"))

    # a word has one row per block at most; the window's rows are streamed
    of_word = Window.partitionBy("word")
    words, sums = materialize_observed(
        map_batches(packs, _block_words, "word binary, block long, n long")
        .withColumn("c", F.sum("n").over(of_word))
        .withColumn("place", F.row_number().over(of_word.orderBy("block"))).filter("c > 0"),
        "ctw-words", tokens=F.sum("n"), distinct=F.count_if(F.col("place") == 1))
    known = words.select("block", F.lit(None).cast("long").alias("key"),
                         F.log10(F.col("c") + 1).alias("value"), "word")
    n, v = sums["tokens"] or 0, sums["distinct"] or 0

    scored = (packs.groupBy("block").cogroup(grams.unionByName(known).groupBy("block"))
              .applyInArrow(_score_block, _SCORED))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("known_log") - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        "score", "n_bytes",
        (-F.col("score") * math.log2(10) / F.greatest(F.col("n_bytes"), F.lit(1)))
        .alias("bits_per_byte"))
