"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

from custseg import session

ASCII_SPACE = " \t\n\x0b\x0c\r"      # the characters \x20 and \x09-\x0D

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders that operators write inside the block. Once the results that read them are
    saved, ``session.delete_path`` removes them::

        with recorded() as folders:
            near_dedup.first_of_each(docs).write.parquet(out)
        for folder in folders:
            delete_path(spark, folder)
    """
    token = _WRITTEN.set([])
    try:
        yield _WRITTEN.get()
    finally:
        _WRITTEN.reset(token)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``session.materialize``, noted for ``recorded``."""
    return session.materialize(df, name, _WRITTEN.get())


def materialize_observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``session.materialize_observed``, noted for ``recorded``."""
    return session.materialize_observed(df, name, _WRITTEN.get(), **metrics)


def ship(spark: SparkSession) -> SparkSession:
    """Let the Python workers of a local session import this package from any directory.

    On a cluster the package is installed or sent with the job, as any Python package is.
    """
    env = spark.sparkContext.environment
    if spark.sparkContext.master.startswith("local[") and "PYTHONPATH" not in env:
        env["PYTHONPATH"] = _ROOT
    return spark


def map_batches(df: DataFrame, func: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str) -> DataFrame:
    """``mapInArrow`` with the package importable in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(func, schema)


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A string column as Python strings, null as the empty text."""
    return [x if x is not None else "" for x in batch.column(name).to_pylist()]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def replace_text(docs: DataFrame, func: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """``docs`` with ``text`` rewritten row by row; ``n_chars`` follows it where present.

    A row for which ``func`` gives None leaves the table.
    """
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column("text").to_pylist()
            new = func([x if x is not None else "" for x in old])
            mask = pa.array([x is not None for x in new], pa.bool_())
            # an unchanged null text stays null
            out = [None if o is None and n == "" else n for o, n in zip(old, new)]
            cols = []
            for name in names:
                kind = batch.schema.field(name).type
                if name == "text":
                    cols.append(pa.array(out, kind))
                elif name == "n_chars":
                    cols.append(pa.array([None if x is None else len(x) for x in out], kind))
                else:
                    cols.append(batch.column(name))
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(mask)

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
