"""The pipeline's stages against brute-force versions, each on its predecessor's rows."""

import random

import pytest

import corpus_pipeline
from custseg.llm import quality, queries, secrets
from custseg.llm.queries import tokenizer_path
from tests.llm import test_line_dedup, test_near_dedup
from tests.llm.test_tokens import check_packing

tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = random.Random(11)
    shared = [f"This sentence number {i} is shared by a lot of documents in here." for i in range(3)]

    def sentence():
        return " ".join(f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(8, 20))) + "."

    rows = []
    for i in range(80):
        lines = [sentence() for _ in range(rnd.randint(2, 6))]
        if rnd.random() < 0.5:
            lines.insert(rnd.randrange(len(lines)), rnd.choice(shared))
        if rnd.random() < 0.2:
            lines.append("Home | About | Contact | News")
        if rnd.random() < 0.2:
            lines.append(f"The access key is {rnd.getrandbits(128):032x} and that is all of it.")
        rows.append((i, "\n".join(lines)))
    for i in range(20):                       # exact and near copies
        text = rows[rnd.randrange(80)][1]
        if i % 2:
            words = text.split(" ")
            words[3] = "changed"
            text = " ".join(words)
        rows.append((100 + i, text))
    rows += [(200, None), (201, ""), (202, "too short"), (203, "a|b|c " * 40), (204, "Menu\n" * 30)]
    return rows


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(
        [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA).repartition(3)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "secret_scan", "best_fit_packing"]

    def brute_near(rows):
        found = test_near_dedup.brute(rows, words=5)
        first = {int(c) for _, n, c in found if n}
        return [r for r in rows if r[0] in first]

    brute = {
        "quality_rules": lambda rs: [(i, x) for i, t in rs
                                     if (x := quality.cleaned(t or "")) is not None],
        "line_dedup": test_line_dedup.brute,
        "near_dedup": brute_near,
        "secret_scan": lambda rs: [(i, secrets.redacted(t)) for i, t in rs],
    }
    expected, columns = rows, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        expected = brute[name](expected)
        assert rows_of(docs) == sorted(expected, key=str), name
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    # one changed word keeps five-word shingles at 0.8 in texts of 46 words or more only
    assert 60 < len(expected) < 95 and any("[SECRET]" in t for _, t in expected)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    check_packing(pieces, dict(expected), tokenizers.Tokenizer.from_file(
        tokenizer_path("word_bpe_49k.json")), 2048)
    # run() gives the same pieces
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows],
                          SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    ran = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(tuple(r[k] for k in key) for r in ran) == sorted(
        tuple(r[k] for k in key) for r in pieces)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert numbers == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle_sql(spark, name):
    import duckdb

    from tools_compare import digest
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    df = queries.queries()[name](spark, folder)
    cur = con.execute(queries.oracle_sql()[name])
    cols, rows = [d[0].lower() for d in cur.description], cur.fetchall()
    got = [tuple(r) for r in df.collect()]
    assert len(rows) == len(got) and digest(cols, rows) == digest(
        [c.lower() for c in df.columns], got)
