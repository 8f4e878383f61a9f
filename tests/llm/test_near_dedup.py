"""Near-duplicates, components and the sketch against brute force."""

import random

import numpy as np
import pytest

from custseg.llm import near_dedup as nd
from custseg.llm.components import components


def linked(a, b):
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= 80 * (len(a) + len(b) - both)


def brute(rows, words=nd.WORDS):
    sets = [nd.shingle_set(t or "", words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                parent[root(i)] = root(j)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            smallest[root(i)] = min(d, smallest.get(root(i), d))
    return sorted((str(d), len(sets[i]), str(smallest.get(root(i)))) for i, (d, _) in enumerate(rows))


def result(df):
    rows = nd.near_duplicates(df).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in rows)


def words(rnd, n):
    return [f"w{rnd.randrange(5000)}" for _ in range(n)]


def edited(rnd, text, share):
    out = list(text)
    for i in rnd.sample(range(len(out)), int(share * len(out))):
        out[i] = f"e{rnd.randrange(10**6)}"
    return out


def corpus(seed):
    rnd = random.Random(seed)
    rows, i = [], 0
    for _ in range(12):
        base = words(rnd, rnd.randint(3, 120))
        for _ in range(rnd.randint(1, 6)):
            t = " ".join(edited(rnd, base, rnd.choice([0, 0.02, 0.05, 0.08, 0.2])))
            rows.append((i * 7 % 1009, t if rnd.random() < 0.8 else t.upper() + "  "))
            i += 1
    # a star: copies that are linked with their base only, which is not the smallest id
    base = words(rnd, 300)
    rows += [(2000 + k, " ".join(edited(rnd, base, 0.05))) for k in range(12)]
    rows.append((3000, " ".join(base)))
    return rows + [(4000, None), (4001, ""), (4002, " \n"), (4003, "one"), (4004, "ONE"),
                   (4005, "two"), (4006, "a b"), (4007, "a b"), (4008, "a b a b a b")]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(docs_of, seed):
    rows = corpus(seed)
    assert result(docs_of(rows)) == brute(rows)


def test_star_is_found_without_star_rounds(docs_of, monkeypatch):
    """The comparison by blocks alone also finds every link between components."""
    monkeypatch.setattr(nd, "STAR_ROUNDS", 0)
    monkeypatch.setattr(nd, "BLOCK", 3)
    rows = corpus(3)
    assert result(docs_of(rows)) == brute(rows)


def _one_bucket(spark, n, component_of, text_of):
    """Members of one bucket, all with the registers of one text, and their classes' table."""
    regs = nd.registers(nd.shingle_hashes(text_of(0))).tobytes()
    h = nd._band_hash(regs, 0)
    open_ = spark.createDataFrame([(h, c, component_of(c)) for c in range(n)],
                                  "h long, c long, p long")
    data = spark.createDataFrame(
        [(c, len(nd.shingle_hashes(text_of(c))), bytearray(regs), text_of(c)) for c in range(n)],
        "c long, n long, regs binary, text string")
    return open_, data


def _rows_in_blocks(monkeypatch):
    """How many rows went into the blocks of each of the two steps."""
    counts, real = [], nd.map_batches

    def counted(df, *args):
        counts.append(df.count())
        return real(df, *args)

    monkeypatch.setattr(nd, "map_batches", counted)
    return counts


def test_hot_bucket_with_one_stray_class(spark, monkeypatch):
    """Blocks of the bucket's one large component meet the stray alone, not each other."""
    monkeypatch.setattr(nd, "BLOCK", 64)
    counts = _rows_in_blocks(monkeypatch)
    n = 5000
    text = " ".join(f"w{i}" for i in range(50))
    open_, data = _one_bucket(spark, n, lambda c: 0 if c < n - 1 else n - 1, lambda c: text)
    links = nd._links_across(open_, data, 80, 2).collect()
    blocks = -(-n // 64)
    # the stray also has a block of its own, where it is alone
    assert counts == [n - 1 + blocks + 1, n - 1 + blocks] and 1 <= len(links) <= blocks
    assert all(n - 1 in (r["a"], r["b"]) for r in links)


def test_similar_classes_of_their_own_components_are_not_written_as_pairs(spark, monkeypatch):
    """Rows are members times blocks; links unite, they don't list pairs."""
    monkeypatch.setattr(nd, "BLOCK", 32)
    counts = _rows_in_blocks(monkeypatch)
    n = 400
    base = [f"w{i}" for i in range(60)]

    def linked_text(c):
        return " ".join(base + [f"own{c}"])

    open_, data = _one_bucket(spark, n, lambda c: c, linked_text)
    links = [tuple(r) for r in nd._links_across(open_, data, 80, 2).collect()]
    blocks = -(-n // 32)
    assert max(counts) <= n * (blocks + 1)
    assert len(links) < n * (blocks + 1) < n * (n - 1) / 8
    df = spark.createDataFrame(links, "a long, b long")
    assert {r["p"] for r in components(df).collect()} == {0}
    # alike by registers, but not by their words: nothing is linked
    counts.clear()
    open_, data = _one_bucket(spark, n, lambda c: c,
                              lambda c: " ".join(f"w{c}x{i}" for i in range(61)))
    assert nd._links_across(open_, data, 80, 2).collect() == []
    assert max(counts) <= n * (blocks + 1)


def test_blocks_are_bounded_by_shingles(docs_of, monkeypatch):
    monkeypatch.setattr(nd, "STAR_ROUNDS", 0)
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", 200)
    rows = corpus(5)
    assert result(docs_of(rows)) == brute(rows)


def test_repeated_rows_null_ids_and_empty_table(docs_of):
    rows = [(5, "x y z"), (5, "x y z"), (None, "x y z"), (None, "q r s"), (9, "X Y Z")]
    assert result(docs_of(rows)) == [("5", 2, "5"), ("5", 2, "5"), ("9", 2, "5"),
                                     ("None", 2, "5"), ("None", 2, "None")]
    assert nd.near_duplicates(docs_of([])).count() == 0


def test_first_of_each(docs_of):
    docs = docs_of([(5, "x y z"), (5, "x y z"), (3, "x y z"), (7, "p q"), (8, None), (8, None)])
    out = nd.first_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect() if r["text"]) == [
        (3, "x y z"), (7, "p q")]
    assert sum(r["text"] is None for r in out.collect()) == 2


def test_five_word_shingles_keep_edited_texts_that_two_word_shingles_join(docs_of):
    base = [f"w{i}" for i in range(400)]
    edited = [f"e{i}" if i % 40 == 20 else w for i, w in enumerate(base)]
    near = [f"e{i}" if i == 20 else w for i, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(edited)), (3, " ".join(near))]
    sets = {w: [nd.shingle_set(t, w) for _, t in rows] for w in (2, 5)}
    assert linked(sets[2][0], sets[2][1]) and not linked(sets[5][0], sets[5][1])
    assert linked(sets[5][0], sets[5][2])
    docs = docs_of(rows)
    assert [r["doc_id"] for r in nd.first_of_each(docs).collect()] == [1]
    assert sorted(r["doc_id"] for r in nd.first_of_each(docs, words=5).collect()) == [1, 2]


def test_very_long_text(docs_of):
    rnd = random.Random(5)
    long = words(rnd, 60_000)
    rows = [(1, " ".join(long)), (2, " ".join(edited(rnd, long, 0.03))), (3, "short one")]
    assert [c for _, _, c in result(docs_of(rows))] == ["1", "1", "3"]


def test_registers_merge_by_maximum():
    a, b = nd.shingle_hashes("a b c d e f"), nd.shingle_hashes("e f g h i")
    assert (np.maximum(nd.registers(a), nd.registers(b)) == nd.registers(np.union1d(a, b))).all()


def test_likelihood_estimate_is_close():
    rnd = random.Random(3)
    errors = []
    for _ in range(60):
        n, share = rnd.randint(50, 400), rnd.random()
        a = {rnd.getrandbits(64) for _ in range(n)}
        b = {x for x in a if rnd.random() < share} | {rnd.getrandbits(64)
                                                      for _ in range(rnd.randint(1, n))}
        true = len(a & b) / len(a | b)
        ra, rb = (nd.registers(np.array(sorted(s), np.uint64))[None, :] for s in (a, b))
        errors.append(nd.likely_similarity(ra, rb, np.array([len(a)]), np.array([len(b)]))[0] - true)
    assert max(map(abs, errors)) < 0.12 and abs(np.mean(errors)) < 0.02


def test_components(spark):
    rnd = random.Random(4)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)]
    links += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(200)]
    links += [(5, 5), links[0]]
    parent = {x: x for link in links for x in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(links, "a long, b long")
    expected = {x: root(x) for x in parent}
    assert {r["c"]: r["p"] for r in components(df).collect()} == expected
    # in two steps
    first, rest = df.filter("a % 2 = 0"), df.filter("a % 2 = 1")
    assert {r["c"]: r["p"] for r in components(rest, components(first)).collect()} == expected


def test_written_stages_can_be_deleted(spark, docs_of, tmp_path):
    import os

    from custseg.llm.common import recorded
    from custseg.session import delete_path
    with recorded() as folders:
        nd.first_of_each(docs_of([(1, "a b c"), (2, "a b c")])).write.parquet(str(tmp_path / "out"))
    assert len(folders) >= 4 and all(delete_path(spark, f) for f in folders)
    assert not any(os.path.exists(f.removeprefix("file:")) for f in folders)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
