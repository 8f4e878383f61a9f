import pytest
from pyspark.sql import functions as F

from custseg.session import local_session

DOCS = "doc_id long, text string"


@pytest.fixture(scope="session")
def spark():
    return local_session("*", shuffle_partitions=4, app="custseg-llm-tests")


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts (ids from 0) or (doc_id, text) pairs, with other columns whose
    names clash with those of the operators' own tables."""
    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        df = spark.createDataFrame(rows, DOCS)
        for name in ("h", "n", "row", "c", "p", "key", "words", "pos", "length", "kept", "spans",
                     "keep_bitmap", "text_key", "positions", "label", "template", "hub", "regs",
                     "_key", "_first_doc", "_first_key", "first_doc", "first_key", "id", "row",
                     "_t_key", "_b_doc", "_b_key", "_in_keep_bitmap", "b_doc", "b_key", "part",
                     "mask", "digest", "block", "train", "word", "salt"):
            df = df.withColumn(name, F.lit("clash"))
        return df.repartition(3)

    return make
