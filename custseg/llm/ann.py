"""Nearest neighbours by randomly rotated one-bit codes with error-bounded reranking.

Every unit vector o is rotated by one random orthogonal matrix; the signs of the rotated
coordinates are its code x (d bits), and the scalar <x, o> corrects the estimate
<o, q> ~ <x, q> / <x, o>. The error is at most EPSILON * sqrt((1 - <x,o>^2) / <x,o>^2 / (d - 1))
with high probability, which gives a lower and an upper bound for each pair.

1. Equal vectors are found first and count as one: of each distinct vector only the k + 1
   smallest ids matter, so a vector that a third of all rows share is a handful of rows per task
   (a limit by rank that runs before the shuffle).
2. Distinct vectors are coded and dealt by hash into blocks of about ``BLOCK_ROWS``; query vectors
   into blocks of ``BLOCK_QUERIES``. Each pair of blocks is one bounded group: estimates for all of
   it come from the codes' signs, and a vector is reranked - exact cosine on the original vectors -
   only if its upper bound reaches the query's k-th best lower bound. The k + 1 best of each
   query leave the group. The original vectors travel with the codes, in their own type: a block
   of queries reranks nearly every vector for one query or another, so sending them for the pairs
   that need it would move more.
3. The best of all blocks are merged per query and expanded to ids.

The queries are a stated set, so every query meets every block: work is one product of signs with
rotated queries for each pair of blocks. Recall against brute force is measured in the tests (and in the README).

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and
rows without a vec_id, take no part. Vectors of different length are not compared. Rows that share
the query's vec_id are no candidates; a vec_id that is repeated with the same vector counts once,
with different vectors each is searched for. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from custseg.llm.common import map_batches, materialize_observed

K = 5
EPSILON = 1.9
BLOCK_ROWS = 8_192
BLOCK_QUERIES = 2_048
SEED = 7
_SUB = 128                     # queries of a block estimated at once

_ROTATIONS: dict[tuple[int, int], np.ndarray] = {}


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    if (d, seed) not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([seed, d])).normal(size=(d, d)))
        _ROTATIONS[d, seed] = q * np.sign(np.diag(r))
    return _ROTATIONS[d, seed]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 (first by the largest component, so squares stay finite)."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed sign bits, correction scalar <x, o>) of row vectors."""
    rotated = unit(vectors) @ rotation(vectors.shape[1]).T
    return (np.packbits(rotated > 0, axis=1),
            np.abs(rotated).sum(axis=1) / math.sqrt(vectors.shape[1]))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``, in double precision.

    Rows are scaled by their largest component if squares might overflow or vanish."""
    high = np.maximum(np.abs(a).max(axis=1), np.abs(b).max(axis=1))
    low = np.minimum(np.abs(a).max(axis=1), np.abs(b).max(axis=1))
    wild = (high > 1e100) | (low < 1e-100)
    if wild.any():
        a, b = a.copy(), b.copy()
        for x in (a, b):
            x[wild] /= np.abs(x[wild]).max(axis=1, keepdims=True)
    dot = (a * b).sum(axis=1)
    return dot / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def search_block(codes: np.ndarray, scalars: np.ndarray, vectors: np.ndarray,
                 first_ids: np.ndarray, queries: np.ndarray, keep: int,
                 epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query row, vector row, cosine) of the ``keep`` best per query; how many were reranked."""
    d = vectors.shape[1]
    signs = (np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1) / math.sqrt(d)
    error = epsilon * np.sqrt(np.maximum(1 - scalars ** 2, 0) / scalars ** 2 / max(d - 1, 1))
    rotated = (unit(queries) @ rotation(d).T).astype(np.float32)
    q_out, v_out, s_out, n_exact = [], [], [], 0
    for at in range(0, len(queries), _SUB):
        estimate = rotated[at:at + _SUB] @ signs.T / scalars.astype(np.float32)
        for i, row in enumerate(estimate):
            lower = row - error
            floor = np.partition(lower, -keep)[-keep] if len(lower) > keep else -np.inf
            found = np.flatnonzero(row + error >= floor)
            n_exact += len(found)
            exact = cosines(vectors[found], np.broadcast_to(queries[at + i], (len(found), d)))
            best = np.lexsort((first_ids[found], -exact))[:keep]
            q_out.append(np.full(len(best), at + i))
            v_out.append(found[best])
            s_out.append(exact[best])
    return np.concatenate(q_out), np.concatenate(v_out), np.concatenate(s_out), n_exact


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def _codes(batches):
    for batch in batches:
        vectors, n = batch.column("embedding"), batch.num_rows
        packed, scalars = [b""] * n, np.zeros(n)
        sizes = np.diff(vectors.offsets.to_numpy())
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if n else sizes
        for d in np.unique(sizes).tolist():             # vectors of one length together
            at = np.flatnonzero(sizes == d)
            codes, scalars[at] = encode(flat[starts[at][:, None] + np.arange(d)])
            for i, code in zip(at.tolist(), codes):
                packed[i] = code.tobytes()
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(packed, pa.binary()), pa.array(scalars, pa.float64())],
            names=[*batch.schema.names, "code", "scalar"])


def _usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0)


def neighbours(vectors: DataFrame, is_query: Column, k: int = K, epsilon: float = EPSILON,
               block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of every row of ``is_query``."""
    keep = k + 1                                    # the query's own vector may be among them
    rows = (vectors.select("vec_id", "embedding", is_query.alias("is_query"))
            .filter(F.col("vec_id").isNotNull() & _usable(F.col("embedding")))
            .withColumn("v", F.md5(F.col("embedding").cast("array<double>").cast("string")
                                   .cast("binary")))
            .withColumn("d", F.size("embedding")))
    by_id = Window.partitionBy("v").orderBy("vec_id")
    ids, n_ids = materialize_observed(
        rows.select("v", "vec_id", "embedding", "d").dropDuplicates(["v", "vec_id"])
        .withColumn("r", F.row_number().over(by_id)).filter(F.col("r") <= keep),
        "vectors", n=F.count(F.when(F.col("r") == 1, 1)))
    queries, n_queries = materialize_observed(
        rows.filter("is_query").select("v", "d", "embedding").dropDuplicates(["v"]),
        "query-vectors", n=F.count(F.lit(1)))
    n_blocks = max(1, math.ceil(n_ids["n"] / block_rows))
    n_parts = max(1, math.ceil(n_queries["n"] / block_queries))

    def grid(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    coded = map_batches(ids.filter("r = 1").select("v", "vec_id", "d", "embedding"), _codes,
                        f"v string, vec_id long, d int, embedding {dict(rows.dtypes)['embedding']}, "
                        "code binary, scalar double")
    left = (coded.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(n_blocks)).cast("int"))
            .withColumn("part", grid(n_parts)))
    right = (queries.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(n_parts)).cast("int"))
             .withColumn("block", grid(n_blocks)))

    def search(block: pa.Table, part: pa.Table) -> pa.Table:
        names = ["q", "v", "first_id", "score"]
        if block.num_rows == 0 or part.num_rows == 0:
            return pa.table([pa.array([], t) for t in (pa.string(), pa.string(), pa.int64(),
                                                       pa.float64())], names=names)
        codes = np.stack([np.frombuffer(x, np.uint8) for x in block["code"].to_pylist()])
        first = block["vec_id"].to_numpy()
        q, v, score, _ = search_block(codes, block["scalar"].to_numpy(),
                                      _matrix(block["embedding"]), first,
                                      _matrix(part["embedding"]), keep, epsilon)
        return pa.table([part["v"].take(pa.array(q)), block["v"].take(pa.array(v)),
                         pa.array(first[v]), pa.array(score)], names=names)

    keys = ["d", "block", "part"]
    found = (left.groupBy(*keys).cogroup(right.groupBy(*keys))
             .applyInArrow(search, "q string, v string, first_id long, score double"))
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "first_id")
    top = (found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= keep)
           .select("q", "v", "score"))
    expanded = top.join(ids.select("v", "vec_id"), "v")      # at most keep * keep per query vector
    asked = (rows.filter("is_query").select(F.col("vec_id").alias("query_id"),
                                            F.col("v").alias("q")).distinct())
    order = Window.partitionBy("query_id", "q").orderBy(F.col("score").desc(), "vec_id")
    return (asked.join(expanded, "q").filter("vec_id <> query_id")
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
