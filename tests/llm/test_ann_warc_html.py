"""Nearest neighbours, web archive and page text against plain versions."""

import base64
import gzip
import hashlib
import html
import random
import re
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from custseg.llm import ann, html_text, warc
from custseg.llm.common import recorded


# -- nearest neighbours ----------------------------------------------------------------------
def brute(rows, k, step):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(
        x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in ok:
        if q % step == 0:
            near = sorted((-round(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 12), i)
                          for i, b in ok if i != q and len(a) == len(b))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def searched(spark, rows, k, step, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns(
        {c: F.lit("clash") for c in ("v", "d", "q", "r", "score", "block", "label")})
    out = {}
    for r in ann.neighbours(df, F.col("vec_id") % step == 0, k, **kw).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(x) for q, x in out.items()}


def vectors(seed, n, d=32):
    rng = np.random.default_rng(seed)
    return [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, d)).astype("f4"))]


@pytest.mark.parametrize("kw", [{}, {"block_rows": 40, "block_queries": 3}])
def test_recall_and_scores(spark, kw):
    rows = vectors(1, 400)
    rows += [(500, None), (501, []), (502, [0.0] * 32), (503, [float("nan")] * 32), (504, [None] * 32),
             (505, [float("inf")] * 32), (None, rows[0][1]), (506, [1.0, 2.0])]
    exp, got = brute(rows, 5, 10), searched(spark, rows, 5, 10, **kw)
    assert set(got) <= set(exp) and len(got) == 40
    hits = sum(len({i for i, _ in exp[q]} & {i for _, i, _ in got[q]}) for q in got)
    assert hits >= 0.95 * 5 * 40
    for q, found in got.items():
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        for _, i, s in found:
            a, b = (np.array(dict((x, y) for x, y in rows if x is not None)[j], float)
                    for j in (q, i))
            assert s == pytest.approx(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b), abs=1e-12)


def test_hot_vector_and_ties(spark):
    rows = vectors(2, 60)
    hot = rows[0][1]
    rows = [(i, hot if i % 3 == 0 else v) for i, v in rows] + [(59, rows[59][1])]
    exp, got = brute(rows[:-1], 5, 6), searched(spark, rows, 5, 6)
    assert {q: [i for _, i, _ in x] for q, x in got.items()} == {
        q: [i for i, _ in x] for q, x in exp.items()}


def test_few_rows(spark):
    rows = vectors(3, 3)
    assert [i for _, i, _ in searched(spark, rows, 5, 3)[0]] == [i for i, _ in brute(rows, 5, 3)[0]]
    assert searched(spark, rows[:1], 5, 1) == {} and searched(spark, [], 5, 1) == {}


def test_vectors_of_extreme_size(spark):
    """Cosines of double vectors whose squares overflow or vanish."""
    rows = [(0, [1.0, 0.0]), (1, [1e-320, 0.0]), (2, [1e308, 1e308]), (3, [0.0, 1e-300]),
            (4, [-1e200, 1e200]), (5, [3.0, 4.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in ann.neighbours(df, F.col("vec_id") == 0).orderBy(
        "rank").collect()]
    assert [i for i, _ in got] == [1, 2, 3, 4]
    half = 0.5 ** 0.5
    assert [s for _, s in got] == pytest.approx([1, half, 0, -half], abs=1e-12)


def test_error_bounds_hold():
    x = np.array([v for _, v in vectors(5, 600, 64)])
    codes, scalars = ann.encode(x)
    signs = np.unpackbits(codes, axis=1, count=64) * 2.0 - 1
    q = ann.unit(x[:50]) @ ann.rotation(64).T
    estimate = q @ signs.T / 8 / scalars
    true = ann.unit(x[:50]) @ ann.unit(x).T
    error = ann.EPSILON * np.sqrt((1 - scalars ** 2) / scalars ** 2 / 63)
    assert (np.abs(estimate - true) <= error).mean() > 0.93


# -- web archive -----------------------------------------------------------------------------
PAGES = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, "http://a/ü b\n", None),
         (4, None, ""), (5, "http://a/5", "WARC/1.1\r\n\r\nWARC-Type: response\r\n"),
         (None, "http://a/6", "<p>x</p>"), (7, "http://a/7", "é" * 200_000), (2, "http://a/2", "<p>x</p>"),
         (None, "u", "only null"), (8, "http://a/8", "<p>x</p>y")]


def pages_of(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumns({c: F.lit("clash") for c in ("sha256", "sha1", "gz", "head", "response",
                                                       "host", "cell", "text")}).repartition(3)


def test_archive_round_trip(spark, tmp_path):
    path = warc.write(pages_of(spark, PAGES), str(tmp_path / "a"))
    rows = warc.read(spark, path).collect()
    assert sorted((str(r["page_id"]), r["html"]) for r in rows) == sorted(
        (str(i), h or "") for i, _, h in PAGES)
    latest = {}
    for i, _, h in PAGES:
        if i is not None:
            latest[h or ""] = max(i, latest.get(h or "", i))
    for r in rows:
        payload = r["html"].encode()
        assert r["payload_bytes"] == len(payload)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        top = latest.get(r["html"])
        assert r["record_type"] == ("response" if r["page_id"] == top else "revisit")
        assert r["refers_to"] == (None if r["page_id"] == top else top)
    assert spark.read.parquet(path + "/payloads").count() == len({h or "" for _, _, h in PAGES})


def test_min_bytes(spark, tmp_path):
    path = warc.write(pages_of(spark, PAGES), str(tmp_path / "a"), min_bytes=9)
    assert {r["record_type"] for r in warc.read(spark, path).collect()} == {"response"}


def test_damage_is_noticed(spark, tmp_path):
    path = warc.write(pages_of(spark, PAGES), str(tmp_path / "a"))
    bad = spark.read.parquet(path + "/payloads").withColumn(
        "gz", F.lit(gzip.compress(b"other")))
    bad.write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(path + "/headers").write.parquet(str(tmp_path / "b/headers"))
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read(spark, str(tmp_path / "b")).collect()


def test_exported_files_hold_the_records(spark, tmp_path):
    path = warc.write(pages_of(spark, PAGES), str(tmp_path / "a"))
    records = warc.read(spark, path)
    warc.export(records, str(tmp_path / "files"))
    data = b"".join(gzip.open(f).read() for f in (tmp_path / "files").glob("*.gz"))
    found = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        n = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
        found.append(head + b"\r\n\r\n" + rest[:n])
        assert rest[n:n + 4] == b"\r\n\r\n"
        data = rest[n + 4:]
    assert sorted(found) == sorted(bytes(r["record"]) for r in records.collect())


def test_empty_archive(spark, tmp_path):
    path = warc.write(pages_of(spark, []), str(tmp_path / "a"))
    assert warc.read(spark, path).count() == 0


# -- page text -------------------------------------------------------------------------------
def page(body):
    return ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';"
            f"</script></head><body>{body}</body></html>")


ARTICLE = page(
    "<header>Site</header><nav><ul><li><a href=x>Home</a></li></ul></nav><!-- ad -->"
    "<div class='ad'>Buy</div><article><h1>Title &amp; more</h1><p><b>One  two<br>three\n four<p>"
    "Second &lt;b&gt;</p><div class=\"share-box\">Share</div><form>Mail<input></form>"
    "<ul><li>item</li></ul><section id=comments><p>Nice!</p></section><p>Last&nbsp;one</article>"
    "<aside>More</aside><div class='cookie notice'>We use cookies</div><footer>&copy; me")


@pytest.mark.parametrize("markup, text", [
    (ARTICLE, "Title & more\nOne two three four\nSecond <b>\nitem\nLast one"),
    (page("<main><p>In main</p></main><p>outside</p>"), "In main"),
    (page("<nav>menu<article><p>text</p></article>"), "text"),
    (page("<p>1 < 2 and 3 > 2</p><div role=navigation>x</div><div hidden>y</div>"),
     "1 < 2 and 3 > 2"),
    (page("<p title='a>b'>x</p><textarea><p>no</p></textarea><iframe><p>no</iframe>y"), "x\ny"),
    ("", ""), ("<", "<"), ("<p>open", "open"), ("plain", "plain"), ("&am &amp", "&am &")])
def test_regions(markup, text):
    assert html_text.main_texts([markup]) == [text]


@pytest.mark.parametrize("markup, text", [
    ("<div class='layout has-sidebar'><article><p>text</p></article></div>", "text"),
    ("<div class='layout has-sidebar'><p>text</p></div>", "text"),
    ("<div id='no-sidebar'><p>text</p></div>", "text"),
    ("<div class='elementor-widget elementor-widget-theme-post-content'><p>text</p></div>", "text"),
    ("<article class='post comments-open category-notice tag-ads'><p>text</p></article>", "text"),
    ("<article class='post notice'><p>text</p></article>", "text"),
    ("<div class='widget'><p>no</p><article><p>text</p></article><p>no</p></div>", "text"),
    ("<form id=aspnetForm><div class=sidebar><main><p>text</p></main></div></form>", "text"),
    ("<div class=sidebar><article>teaser</article></div><article>text</article>", "text"),
    ("<main><p>text</p><div id=comments><article>reply</article></div></main>", "text"),
    ("<p>text</p><div class='related-posts'><article>teaser</article></div>", "text"),
    ("<p>text</p><div class='site-footer'>no</div><div class='nav__list'>no</div>"
     "<div class='footer--dark'>no</div><div class='post-comments'>no</div>", "text"),
    ("<article>text<div class='widget'>no</div><div hidden><article>no</article></div></article>",
     "text")])
def test_names_mark_out_as_a_whole(markup, text):
    assert html_text.main_texts([page(markup)]) == [text]


def test_repeats_on_pages_without_marks():
    bar = "<p>Buy our great things at the shop today for less money</p>"
    pages = [page(f"<p>Story number {i} is told here only {'x' * i}</p>{bar}") for i in range(5)]
    own = [f"Story number {i} is told here only {'x' * i}".strip() for i in range(5)]
    assert html_text.main_texts(pages) == own
    # two pages are too few; equal pages count once; an article's own text is never cut
    assert all("Buy our" in t for t in html_text.main_texts(pages[:2]))
    assert all("Buy our" in t for t in html_text.main_texts([pages[0]] * 5))
    marked = [p.replace("<p>Story", "<article><p>Story") for p in pages]
    assert all("Buy our" in t for t in html_text.main_texts(marked))


def test_repeats_are_counted_over_the_whole_host(spark, monkeypatch):
    """The result does not depend on host size, buckets, cells or group borders."""
    monkeypatch.setattr(html_text, "CELLS", 1)
    rnd = random.Random(9)

    def story():
        return f"<p>{' '.join(f'w{rnd.randrange(10**6)}' for _ in range(20))}</p>"

    def passage(name):
        return f"<p>{' '.join(f'{name}{i}' for i in range(12))}</p>"

    hosts = {"hot": [page(story() + (passage("rare") if i % 40 == 0 else "") + passage("bar"))
                     for i in range(400)],
             "small": [page(story() + (passage("rare") if i < 3 else "")) for i in range(6)],
             "two": [page(story() + (passage("rare") if i < 2 else "")) for i in range(6)]}
    hosts["hot"] += [hosts["hot"][0]] * 5
    hosts["two"] += [hosts["two"][0]] * 5                  # equal pages count once
    rows = [(i, f"https://{h}.example/{i}", html_) for i, (h, html_) in enumerate(
        (h, x) for h, own in hosts.items() for x in own)]
    expected = [t for own in hosts.values() for t in html_text.main_texts(own)]
    assert sum("rare0" in t for t in expected) == 2 + 5 and not any("bar0" in t for t in expected)
    for chars in (html_text.GROUP_CHARS, 2000):
        monkeypatch.setattr(html_text, "GROUP_CHARS", chars)
        got = html_text.extract(pages_of(spark, rows), group_pages=8).collect()
        assert {r["page_id"]: r["text"] for r in got} == dict(enumerate(expected))
        assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)


def test_repeated_tokens_against_brute_force():
    rnd = random.Random(6)
    for _ in range(40):
        pages = [[rnd.randrange(4) for _ in range(rnd.randint(0, 30))] for _ in range(5)]
        run, least = rnd.randint(2, 6), rnd.randint(2, 3)
        cover = []
        for p in pages:
            own = [False] * len(p)
            for i in range(len(p) - run + 1):
                w = p[i:i + run]
                n = sum(any(q[j:j + run] == w for j in range(len(q) - run + 1)) for q in pages)
                if n >= least:
                    own[i:i + run] = [True] * run
            cover += own
        got = html_text.repeated_tokens(
            np.array([t for p in pages for t in p], np.int64),
            np.array([i for i, p in enumerate(pages) for _ in p], np.int64), run, least)
        assert got.tolist() == cover


def test_extract(spark):
    rows = [(i, f"https://Host.example/{i}", ARTICLE) for i in range(300)]
    rows += [(400, None, None), (None, "http://[bad", "<p>x"), (401, "u", "<p>y</p>" * 100_000),
             (1, "https://Host.example/1", ARTICLE)]
    got = html_text.extract(pages_of(spark, rows), group_pages=20).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts[7] == html_text.main_texts([ARTICLE])[0] and texts[400] == "" and texts[None] == "x"
    assert texts[401] == "\n".join(["y"] * 100_000)
    assert html.unescape("&amp;") in texts[0]
    assert html_text.extract(pages_of(spark, [])).count() == 0


@pytest.mark.parametrize("piece, times", [
    ("<div>x", 200_000), ("<span>x", 200_000), ("<p>x<table><tr><td>", 50_000),
    ("<head><body>x", 50_000), ("<nav>x</b>", 100_000), ("<!--x", 100_000), ("<div x='", 100_000),
    ("<", 300_000)])
def test_time_grows_with_the_page_however_many_elements_are_open(piece, times):
    def took(n):
        start = time.perf_counter()
        html_text.page_blocks(piece * n)
        return time.perf_counter() - start

    took(100)
    assert took(times) < 0.5 + 40 * took(times // 10)       # quadratic: a hundredfold


def test_marked_pages_are_counted_over_the_host_and_stay_whole(spark):
    def words(name, n=12):
        return " ".join(f"{name}{i}" for i in range(n))

    quote = f"<p>{words('quote')} end</p>"
    rows = [(i, "https://a.org/x", page(f"<article><p>{words(f'own{i}')}</p>{quote}<p>short</p>"
                                        f"</article><p>{words('beside')}</p>")) for i in range(5)]
    rows += [(9, "https://a.org/y", rows[0][2])]                         # an equal page
    rows += [(10 + i, "https://b.org/x", page(f"<main>{quote}</main><p>{i}</p>")) for i in range(2)]
    rows += [(20 + i, "https://c.org/x", page(f"<p>z{i} z z</p>{quote}")) for i in range(3)]
    rows += [(30, "https://c.org/y", page(f"<article>{quote}</article>")), (31, None, None)]
    expected = {i: (f"{words(f'own{i % 9}')}\n{words('quote')} end\nshort", 14) for i in
                (*range(5), 9)}                    # "short" follows: a run reaches into it
    expected |= {i: (f"{words('quote')} end", 0) for i in (10, 11, 30)} | {31: ("", 0)}
    expected |= {20 + i: (f"z{i} z z", 2) for i in range(3)}    # runs begin in "z z"
    for group_pages in (128, 2):
        got = html_text.extract(pages_of(spark, rows), group_pages).collect()
        assert {r["page_id"]: (r["text"], r["n_repeated"]) for r in got} == expected
        assert len(got) == len(rows)


def test_pages_take_little_disk(spark, tmp_path):
    """Shuffle files and written stages together stay below 1.5 times the input."""
    rnd = random.Random(21)
    vocabulary = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 9)))
                  for _ in range(20_000)]
    menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in vocabulary[:60])
    bar = " ".join(vocabulary[:12])

    def text():
        return "".join(f"<p>{' '.join(rnd.choices(vocabulary, k=70))}</p>" for _ in range(5))

    rows = [(i, f"https://h{i % 10 % 4}.org/{i}",
             page(f"<nav>{menu}</nav><article>{text()}<p>{bar}</p></article>")) for i in range(1500)]
    pages_of(spark, rows).repartition(4).write.parquet(str(tmp_path / "pages"))
    size = sum(f.stat().st_size for f in (tmp_path / "pages").glob("*.parquet"))
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager() \
        .diskBlockManager().localDirs()

    def shuffled():
        return {f: f.stat().st_size for d in folders for f in Path(str(d)).rglob("shuffle_*.data")}

    before = shuffled()
    with recorded() as written:
        df = html_text.extract(spark.read.parquet(str(tmp_path / "pages")), group_pages=400)
        df.write.parquet(str(tmp_path / "out"))
    after = shuffled()
    took = sum(n for f, n in after.items() if f not in before)
    took += sum(f.stat().st_size for d in written for f in Path(d.removeprefix("file:")).glob("*"))
    assert 0 < took < 1.5 * size
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 1500 and all(r["n_repeated"] >= 12 for r in got)


@pytest.mark.parametrize("chars", [1, 7, 300, 4_000_000])
def test_small_hashes_decide_nothing(monkeypatch, chars):
    """However many runs share a small hash, the texts are those of plain counting."""
    monkeypatch.setattr(html_text, "GROUP_CHARS", chars)
    monkeypatch.setattr(html_text, "PART", 4 * chars)
    rnd = random.Random(31)
    common = [" ".join(f"{c}{i}" for i in range(12)) for c in "pqrs"]
    rows = []
    for i in range(60):
        blocks = [" ".join(f"w{rnd.randrange(40)}" for _ in range(rnd.randint(1, 20)))
                  for _ in range(3)] + rnd.sample(common, rnd.randint(0, 2))
        rows.append((i, "h", list(rows[-1][2]) if i % 9 == 8 else blocks, i % 7 == 0))
    markup = ["".join(f"<p>{b}</p>" for b in blocks) for _, _, blocks, _ in rows]
    batch = pa.RecordBatch.from_pydict({
        "host": [5] * 60, "buckets": [6] * 60, "page_id": [r[0] for r in rows], "url": [None] * 60,
        "html": [page(f"<article>{m}</article>" if r[3] else m) for m, r in zip(markup, rows)]})
    groups = pa.Table.from_batches(html_text._parse([batch]))

    def grouped(table, *names):
        keys = {tuple(r.values()) for r in table.select(names).to_pylist()}
        for key in sorted(keys):
            mask = pc.and_(*(pc.equal(table[n], k) for n, k in zip(names, key)))
            yield tuple(map(pa.scalar, key)), table.filter(mask)

    def totals(shares):
        return pa.concat_tables(html_text._total(k, t) for k, t in grouped(shares, "host", "part"))

    def joined(func, found):
        for (host, bucket), table in grouped(groups, "host", "bucket"):
            mask = pc.and_(pc.equal(found["host"], host), pc.equal(found["bucket"], bucket))
            yield func((host, bucket), table, found.filter(mask))

    small = totals(pa.concat_tables(
        html_text._count(k, t) for k, t in grouped(groups, "host", "bucket")))
    found = totals(pa.concat_tables(joined(html_text._confirm, small)))
    got = pa.concat_tables(joined(html_text._cut, found)).to_pylist()
    assert {i: r["text"] for r in got for i in r["page_id"]} == brute_texts(rows)
    assert any(r["n_repeated"] for r in got) and sum(len(r["page_id"]) for r in got) == 60


def test_packed_keys():
    keys = np.array([0, 1, 255, 256, 2**40, 2**63, 2**64 - 1], np.uint64)
    rows = pa.table({"size": [7, 1, 0], "keys": [html_text._pack(k) for k in (
        keys, keys[-1:], keys[:0])]})
    assert [k.tolist() for k in html_text._unpack(rows)] == [keys.tolist(), [2**64 - 1], []]


def brute_texts(rows):
    """(page_id -> text) of pages given as (page_id, host, blocks, marked), by plain counting."""
    texts = {}
    for host in {h for _, h, _, _ in rows}:
        own = {tuple(b) for _, h, b, marked in rows if h == host and not marked}
        holders = {}
        for blocks in own:
            words = " ".join(blocks).split()
            for i in range(len(words) - 7):
                holders.setdefault(tuple(words[i:i + 8]), set()).add(blocks)
        for page_id, h, blocks, marked in rows:
            if h != host:
                continue
            words, kept, at = " ".join(blocks).split(), [], 0
            covered = [False] * len(words)
            for i in range(len(words) - 7):
                if len(holders.get(tuple(words[i:i + 8]), ())) >= 3:
                    covered[i:i + 8] = [True] * 8
            for b in blocks:
                n = len(b.split())
                if marked or sum(covered[at:at + n]) < 0.8 * n:
                    kept.append(b)
                at += n
            texts[page_id] = "\n".join(kept or blocks)
    return texts


def test_extract_against_plain_counting(spark):
    rnd = random.Random(12)

    def block(n):
        return " ".join(rnd.choice("abcdefgh") * 3 + str(rnd.randrange(60)) for _ in range(n))

    common = {h: [block(rnd.randint(9, 20)) for _ in range(4)] for h in ("one.org", "two.org", "")}
    rows, table = [], []
    for page_id in range(120):
        host = rnd.choice(["one.org", "one.org", "two.org", ""])
        blocks = [block(rnd.randint(1, 25)) for _ in range(rnd.randint(1, 5))]
        blocks += rnd.sample(common[host], rnd.randint(0, 2))
        if rnd.random() < 0.2:          # a common passage inside a longer block
            blocks.append(block(12) + " " + rnd.choice(common[host]) + " " + block(12))
        rnd.shuffle(blocks)
        if rows and rnd.random() < 0.1:
            blocks = list(rows[-1][2])
        marked = rnd.random() < 0.2
        rows.append((page_id, host, blocks, marked))
        body = "".join(f"<{t}>{b}</{t}>" for b in blocks for t in [rnd.choice(["p", "div", "li"])])
        body = f"<article>{body}</article><p>next</p>" if marked else body
        table.append((page_id, f"https://{host}/x" if host else None,
                      f"<html><head><title>t</title></head><body><nav>menu</nav>{body}"
                      "<script>var a = 1;</script></body></html>"))
    df = spark.createDataFrame(table, "page_id long, url string, html string").repartition(5)
    for group_pages in (128, 5):
        got = {r["page_id"]: r["text"] for r in html_text.extract(df, group_pages).collect()}
        assert got == brute_texts(rows)
