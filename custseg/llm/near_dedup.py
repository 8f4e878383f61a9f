"""Near-duplicates by SetSketch: banded registers, joint likelihood, exact verification.

1. One pass turns each text into its set of distinct shingles (``words`` words) and a SetSketch: every
   register is the largest of floor(1 - log_b x) over the shingles, with x exponential (rate a)
   per shingle and register; only the smallest x matters, so registers of parts merge by maximum.
   The rows (no text) are written once.
2. Equal sets form a class; everything below works on classes, so exact copies cost one row.
3. Bands of registers are hashed; classes that share a band hash share a bucket. A bucket names
   its smallest member as its hub (a minimum combines before the shuffle).
4. Every class is compared with its smallest hub: sizes, then the likelihood estimate of the
   Jaccard similarity from the counts of larger, smaller and equal registers, then the full sets
   of both texts. Verified links are united into components.
5. ``STAR_ROUNDS`` further rounds do the same with another hub per bucket, for members that are
   not yet in the hub's component. A dense group of near copies is connected after few rounds with
   one comparison per member instead of one per pair.
6. What is left: classes that share a bucket and are in different components. In a bucket the
   members of its largest component lie in blocks, and the others go to each of these blocks; the
   others are compared with each other in pairs of blocks of their own, and blocks of the largest
   component never meet. In a block, sizes and estimates tell which classes are likely near one of
   another component; those alone get their texts and meet in the block again, where full sets are
   compared until the block's components are united. So rows are members and blocks, never pairs,
   and a block writes fewer links than it has members. A pair is compared in one bucket, that of
   the first band it shares. No link between components is lost; members of one component need no
   comparison. Blocks are bounded by members and by shingles, so by bytes of text.

At the limit of 0.8 a pair misses all ``BANDS`` bands with probability (1 - 0.8^6)^42 = 3e-6. The
estimate drops pairs more than ``MARGIN`` (six standard errors) under the limit.

Only the texts of classes that share a bucket are fetched for verification. Hot buckets, hubs
and classes are split by adaptive execution (plain joins), or reduced by minima.

Defined results: a null or empty text, or one without words, has an empty set and is linked with
nothing; a single word is a set of one. Repeated rows are in one class. A null doc_id takes part;
its component carries the smallest other doc_id, or null. Very long texts are sketched and compared
whole; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custseg.llm.common import map_batches, materialize, texts
from custseg.llm.components import components

WORDS = 2
LIMIT_PCT = 80
BANDS, BAND_ROWS = 42, 6
BASE, RATE, TOP = 1.001, 20.0, 65534
MARGIN = 0.15
STAR_ROUNDS = 2
BLOCK = 1024                # members of a bucket's block
BLOCK_SHINGLES = 2_000_000  # shingles of a block's members, more only for one larger text

_M = BANDS * BAND_ROWS
_RNG = np.random.Generator(np.random.PCG64(20240601))
_MUL = _RNG.integers(0, 1 << 31, _M, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, _M, dtype=np.uint64).astype(np.uint32)
_CHUNK = 512


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()         # bytes: A-Z and ASCII white space only


def shingle_set(text: str, size: int = WORDS) -> set[tuple[bytes, ...]]:
    w = words_of(text)
    if len(w) < size:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(size))))


def shingle_hashes(text: str, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    w = words_of(text)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = max(len(w) - size + 1, min(len(w), 1))
    out = np.full(n, len(w) if len(w) < size else size, np.uint64)
    for i in range(min(size, len(w))):
        out = (out ^ h[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The SetSketch of a non-empty set."""
    low = np.full(_M, 0xFFFFFFFF, np.uint32)
    x = ((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), _CHUNK):
        h = x[at:at + _CHUNK, None] * _MUL
        h += _ADD
        np.minimum(low, h.min(axis=0), out=low)
    smallest = -np.log1p(-(low + 0.5) / 2.0 ** 32) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, TOP + 1).astype("<u2")


def _sketch(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, size, regs = [], [], []
            for text in texts(batch, "text"):
                h = shingle_hashes(text, words)
                size.append(len(h))
                sig.append(xxhash.xxh3_128_digest(h.tobytes()))
                regs.append(registers(h).tobytes() if len(h) else None)
            pair = np.frombuffer(b"".join(sig), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(pair[:, 0]),
                 pa.array(pair[:, 1]), pa.array(size, pa.int64()), pa.array(regs, pa.binary())],
                names=["doc_id", "text_key", "s1", "s2", "n", "regs"])

    return run


def _bands(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = 2 * BAND_ROWS
    for batch in batches:
        h = [xxhash.xxh3_64_intdigest(r[i * width:(i + 1) * width], seed=i)
             for r in batch.column("regs").to_pylist() for i in range(BANDS)]
        c = np.repeat(batch.column("c").to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(c)], names=["h", "c"])


def likely_similarity(regs_a: np.ndarray, regs_b: np.ndarray, n_a: np.ndarray,
                      n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs (rows) on a grid of 0.01."""
    more = (regs_a > regs_b).sum(axis=1)[:, None]
    less = (regs_a < regs_b).sum(axis=1)[:, None]
    same = regs_a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)
    step = (BASE - 1) / BASE

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * step) / np.log(BASE)

    up, down = p(u - v * grid), p(v - u * grid)
    tiny = 1e-12
    score = (more * np.log(np.maximum(up, tiny)) + less * np.log(np.maximum(down, tiny))
             + same * np.log(np.maximum(1 - up - down, tiny)))
    return grid[np.arange(len(grid)), score.argmax(axis=1)]


def _likely(na, nb, ra, rb, limit_pct: int) -> np.ndarray:
    """Which pairs (rows) may reach the limit by their sizes and the estimate."""
    near = 100 * np.minimum(na, nb) >= limit_pct * np.maximum(na, nb)
    at = np.flatnonzero(near)
    # equal registers alone settle most pairs; the rest are estimated jointly
    at = at[(ra[at] == rb[at]).mean(axis=1) >= limit_pct / 100 - MARGIN - 0.05]
    if len(at):
        found = likely_similarity(ra[at], rb[at], na[at], nb[at])
        at = at[found >= limit_pct / 100 - MARGIN]
    near[:] = False
    near[at] = True
    return near


def _groups(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...],
            names: tuple[str, ...]) -> Iterator[tuple[tuple | None, list]]:
    """(key, rows) of each group of a stream sorted by its keys; (None, []) after each batch."""
    key, rows = None, []
    for batch in batches:
        for *new, row in zip(*(batch.column(k).to_pylist() for k in keys),
                             zip(*(batch.column(n).to_pylist() for n in names))):
            if new != key:
                if rows:
                    yield key, rows
                key, rows = new, []
            rows.append(row)
        yield None, []
    if rows:
        yield key, rows


def _ints(rows: list, at: int) -> np.ndarray:
    return np.array([r[at] for r in rows], np.int64)


def _registers_of(rows: list, at: int) -> np.ndarray:
    return np.frombuffer(b"".join(r[at] for r in rows), "<u2").reshape(-1, _M)


def _band_hash(regs: bytes, band: int) -> int:
    width = 2 * BAND_ROWS
    digest = xxhash.xxh3_64_intdigest(regs[band * width:(band + 1) * width], seed=band)
    return digest - (1 << 64) if digest >> 63 else digest


class _BlockOfBucket:
    """The members of a group (h, i, j), with their likely pairs between components.

    Rows are (block, c, p, n, regs, ...). With i < 0 the group is a block of the bucket's largest
    component (block -1) and all others; else it is the blocks i and j of the others.
    """

    def __init__(self, key, rows: list, limit_pct: int):
        self.h, self.i, self.j = key
        self.limit_pct = limit_pct
        self.block, self.c, self.p, self.n = (_ints(rows, k) for k in range(4))
        self.regs = _registers_of(rows, 4)
        self.band = next(k for k in range(BANDS) if _band_hash(rows[0][4], k) == self.h)

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """(x, the others y that are likely near it): each pair once, in one bucket only."""
        outside = np.flatnonzero(self.block >= 0) if self.i < 0 else np.arange(len(self.c))
        for x in outside.tolist():
            other = self.p != self.p[x]
            if self.i < 0:
                other &= self.block < 0
            else:
                other[:x + 1] = False
                if self.i != self.j:
                    other &= self.block != self.block[x]
            y = np.flatnonzero(other)
            if len(y):
                y = y[_likely(np.full(len(y), self.n[x]), self.n[y],
                              np.broadcast_to(self.regs[x], (len(y), _M)), self.regs[y],
                              self.limit_pct)]
            if len(y):      # this bucket's band is the first that both share
                earlier = (self.regs[y, :self.band * BAND_ROWS]
                           == self.regs[x, :self.band * BAND_ROWS])
                y = y[~earlier.reshape(len(y), self.band, BAND_ROWS).all(axis=2).any(axis=1)]
            if len(y):
                yield x, y


_MEMBER = "h long, i int, j int, block int, c long, p long"


def _adjacent(limit_pct: int):
    """The members of each group (h, i, j) that have a likely partner there."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []

        def batch():
            flat = np.concatenate(out) if out else np.zeros((0, 6), np.int64)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(flat[:, k]).cast(kind) for k, kind in enumerate(kinds)],
                names=[x.split()[0] for x in _MEMBER.split(", ")])

        for key, rows in _groups(batches, ("h", "i", "j"), ("block", "c", "p", "n", "regs")):
            if key is None:
                yield batch()
                out = []
                continue
            group, likely = _BlockOfBucket(key, rows, limit_pct), np.zeros(len(rows), bool)
            for x, y in group.pairs():
                likely[x] = likely[y] = True
            at = np.flatnonzero(likely)
            if len(at):
                own = np.tile(np.array(key, np.int64), (len(at), 1))
                out.append(np.column_stack([own, group.block[at], group.c[at], group.p[at]]))
        if out:
            yield batch()

    return run


def _compare(limit_pct: int, size: int):
    """Verified links of each group, as many as unite the components that are linked in it."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for key, rows in _groups(batches, ("h", "i", "j"),
                                 ("block", "c", "p", "n", "regs", "text")):
            if key is None:
                yield link_batch(out)
                out = []
                continue
            group, parent = _BlockOfBucket(key, rows, limit_pct), {}

            def root(p):
                while p in parent:
                    p = parent[p]
                return p

            hashes = [shingle_hashes(r[5], size) for r in rows]
            for x, ys in group.pairs():
                mine, words = hashes[x], None
                for y in ys.tolist():
                    a, b = root(int(group.p[x])), root(int(group.p[y]))
                    if a == b:
                        continue
                    at = np.minimum(np.searchsorted(mine, hashes[y]), len(mine) - 1)
                    both = int((mine[at] == hashes[y]).sum())
                    if 100 * both < limit_pct * (len(mine) + len(hashes[y]) - both):
                        continue
                    words = words or shingle_set(rows[x][5], size)   # hashes agree: now the words
                    other = shingle_set(rows[y][5], size)
                    both = len(words & other)
                    if 100 * both >= limit_pct * (len(words) + len(other) - both):
                        parent[max(a, b)] = min(a, b)
                        out.append((int(group.c[x]), int(group.c[y])))
        yield link_batch(out)

    return run


def link_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    cols = list(zip(*pairs)) if pairs else ([], [])
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])


def _verify(limit_pct: int, words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None, None                   # neighbouring rows often share a side
        for batch in batches:
            if batch.num_rows == 0:
                continue
            na, nb = (batch.column(k).to_numpy() for k in ("na", "nb"))
            ra, rb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2")
                      .reshape(-1, _M) for k in ("ra", "rb"))
            at = np.flatnonzero(_likely(na, nb, ra, rb, limit_pct))
            part = batch.select(["a", "b", "ta", "tb"]).take(pa.array(at))
            out = []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in part.columns)):
                if last[0] != b:
                    last = b, shingle_set(tb, words)
                sa, sb = shingle_set(ta, words), last[1]
                both = len(sa & sb)
                if 100 * both >= limit_pct * (len(sa) + len(sb) - both):
                    out.append((a, b))
            yield link_batch(out)

    return run


def _links(pairs: DataFrame, data: DataFrame, limit_pct: int, words: int) -> DataFrame:
    """The verified ones of ``pairs`` (a, b), written."""
    def side(s):
        return data.select(F.col("c").alias(s), F.col("n").alias("n" + s),
                           F.col("regs").alias("r" + s), F.col("text").alias("t" + s))

    full = pairs.join(side("a"), "a").join(side("b"), "b")
    return materialize(map_batches(full.select("a", "b", "na", "nb", "ra", "rb", "ta", "tb"),
                                   _verify(limit_pct, words), "a long, b long"), "near-links")


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(h, c, p) of the buckets whose members are in different components, written."""
    placed = members.join(labels, "c", "left").select("h", "c", F.coalesce("p", "c").alias("p"))
    mixed = (placed.groupBy("h").agg(F.min("p").alias("p0"), F.max("p").alias("p1"))
             .filter("p0 <> p1").select("h"))
    return materialize(placed.join(mixed, "h"), "mixed")


def _links_across(open_: DataFrame, data: DataFrame, limit_pct: int, words: int) -> DataFrame:
    """Verified links between the components that meet in a bucket: enough to unite those that are
    linked by any pair."""
    def blocks(members, shingles):
        return F.ceil(F.greatest(members / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")

    members = open_.join(data.select("c", "n", "regs"), "c")
    sums = (members.groupBy("h", "p").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
            .groupBy("h").agg(F.max(F.struct("m", "p", "s")).alias("top"),
                              F.sum("m").alias("m"), F.sum("s").alias("s")))
    sizes = sums.select("h", F.col("top.p").alias("largest"),
                        blocks(F.col("top.m"), F.col("top.s")).alias("in_largest"),
                        blocks(F.col("m") - F.col("top.m"), F.col("s") - F.col("top.s"))
                        .alias("in_others"))

    def own(n):
        return F.pmod(F.xxhash64("c"), F.col(n)).cast("int")

    def groups(n, i, j):
        return F.transform(F.sequence(F.lit(0), F.col(n) - 1),
                           lambda k: F.struct(i(k).alias("i"), j(k).alias("j")))

    placed = members.join(sizes, "h").withColumn("block", F.when(
        F.col("p") == F.col("largest"), -1).otherwise(own("in_others")))
    meetings = F.when(
        F.col("block") < 0, F.array(F.struct(F.lit(-1).alias("i"), own("in_largest").alias("j")))
    ).otherwise(F.concat(
        groups("in_largest", lambda k: F.lit(-1), lambda k: k),
        groups("in_others", lambda k: F.least(k, F.col("block")),
               lambda k: F.greatest(k, F.col("block")))))
    placed = (placed.withColumn("at", F.explode(meetings))
              .select("h", "at.i", "at.j", "block", "c", "p", "n", "regs"))

    def grouped(df):
        return df.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")

    likely = materialize(map_batches(grouped(placed), _adjacent(limit_pct), _MEMBER), "near-blocks")
    full = likely.join(data.select("c", "n", "regs", "text"), "c")
    return materialize(map_batches(grouped(full), _compare(limit_pct, words), "a long, b long"),
                       "near-links")


def _text_key():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _grouped(docs: DataFrame, limit_pct: int, words: int) -> DataFrame:
    """One row per input row: doc_id, text_key, n, found (first document of the component)."""
    source = docs.select("doc_id", "text", _text_key().alias("text_key"))
    rows = materialize(
        map_batches(source, _sketch(words), "doc_id long, text_key long, s1 long, s2 long, n long, "
                                     "regs binary")
        .withColumn("row", F.monotonically_increasing_id()), "sketches")
    classes = materialize(
        rows.filter("n > 0").groupBy("s1", "s2")
        .agg(F.min(F.struct("row", "doc_id", "text_key")).alias("rep"),
             F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "text_key"))
             .alias("first_doc"), F.first("n").alias("n"),
             F.first("regs").alias("regs"))
        .select("s1", "s2", F.col("rep.row").alias("c"), F.col("rep.doc_id").alias("rep_doc"),
                F.col("rep.text_key").alias("rep_key"), "first_doc", "n", "regs"), "classes")
    bands = map_batches(classes.select("c", "regs"), _bands, "h long, c long")
    shared = (bands.groupBy("h").agg(F.min("c").alias("hub"), F.max("c").alias("other"))
              .filter("hub <> other").select("h", "hub"))
    members = materialize(bands.join(shared, "h"), "buckets")        # h, c, hub

    # texts of the classes that share a bucket; equal input rows once
    first_hub = members.groupBy("c").agg(F.min("hub").alias("hub"))
    wanted = first_hub.join(classes.select("c", "rep_doc", "rep_key", "n", "regs"), "c")
    data = materialize(
        source.withColumnsRenamed({"doc_id": "rep_doc", "text_key": "rep_key"})
        .dropDuplicates(["rep_doc", "rep_key"]).alias("d")
        .join(wanted.alias("w"), F.col("d.rep_doc").eqNullSafe(F.col("w.rep_doc"))
              & (F.col("d.rep_key") == F.col("w.rep_key")))
        .select("c", "hub", "n", "regs", "text"), "near-texts")

    tested = data.filter("hub <> c").select(F.col("c").alias("a"), F.col("hub").alias("b"))
    labels = components(_links(tested, data, limit_pct, words))
    turn, open_ = 0, _mixed(members, labels)
    while turn < STAR_ROUNDS and not open_.isEmpty():
        drawn = F.xxhash64("c", F.lit(turn))
        hub = open_.groupBy("h").agg(F.min(F.struct(drawn, "c", "p")).alias("x"))
        pairs = (open_.join(hub, "h").filter("p <> x.p")
                 .select(F.greatest("c", "x.c").alias("a"), F.least("c", "x.c").alias("b")))
        pairs = materialize(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.unionByName(pairs)
        labels = components(_links(pairs, data, limit_pct, words), labels)
        turn, open_ = turn + 1, _mixed(members, labels)
    if not open_.isEmpty():
        labels = components(_links_across(open_, data, limit_pct, words), labels)

    grouped = classes.select("s1", "s2", "c", "first_doc").join(labels, "c", "left")
    smallest = (grouped.filter("p IS NOT NULL").groupBy("p")
                .agg(F.min("first_doc").alias("smallest")))
    named = grouped.join(smallest, "p", "left").select(
        "s1", "s2", F.when(F.col("p").isNull(), F.col("first_doc"))
        .otherwise(F.col("smallest")).alias("found"))
    return (rows.select("doc_id", "text_key", "s1", "s2", "n").join(named, ["s1", "s2"], "left")
            .select("doc_id", "text_key", "n", "found"))


def near_duplicates(docs: DataFrame, limit_pct: int = LIMIT_PCT, words: int = WORDS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    return (_grouped(docs, limit_pct, words)
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("found.doc_id"))
                    .alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def first_of_each(docs: DataFrame, limit_pct: int = LIMIT_PCT, words: int = WORDS) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: its smallest doc_id (of rows that
    share it, one). Rows without words are in no group and stay."""
    first = (_grouped(docs, limit_pct, words).filter("n > 0")
             .select(F.col("found.doc_id").alias("first_doc"),
                     F.col("found.text_key").alias("first_key")).distinct())
    has_words = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    # the input row as one column, so that none of its names can clash
    worded = (docs.filter(has_words)
              .select(F.struct("*").alias("row"), F.col("doc_id").alias("id"),
                      _text_key().alias("key"))
              .dropDuplicates(["id", "key"])
              .join(first, F.col("id").eqNullSafe(F.col("first_doc"))
                    & (F.col("key") == F.col("first_key")), "left_semi"))
    return worded.select("row.*").unionByName(docs.filter(~has_words))
