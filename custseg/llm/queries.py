"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custseg.llm import (ann, bpe, ctw, filter_audit, html_text, licenses, line_dedup, near_dedup,
                         packing, quality, secrets, spelling, warc)
from custseg.llm.common import map_batches, read_table, texts
from custseg.session import checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]


OP3_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                     lambda w: w <> '') AS w
  FROM documents
), grams AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS i,
         unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
           AS g
  FROM docs WHERE len(w) > 5
), repeated AS (
  SELECT doc_id, unnest(range(i, i + 5)) AS place
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM repeated GROUP BY doc_id
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM docs
), worded AS (
  SELECT doc_id, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s,
         len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n,
         row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS again
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), judged AS (
  SELECT doc_id, n, again,
         again
         OR length(regexp_replace(s, '[^#*$%&|<>]', '', 'g'))
            > 0.08 * length(regexp_replace(s, '[\x20\x09-\x0D]', '', 'g'))
         OR (n < 4 AND NOT regexp_matches(s, '[.!?…:;,"''”’»)\]}。！？：；」』）।؟]$'))
         OR (n <= 25 AND held > 0 AND (2 * held >= n OR (n <= 6 AND NOT regexp_matches(
               s, '[.!?…。！？।؟]["''”’»)\]]*$'))))
         OR (n >= 4 AND items >= 4 AND n <= 3.0 * items) AS fails
  FROM (SELECT *, len(list_filter(regexp_split_to_array(s,
                 '\s[|•·»›>/]\s|\s*[|•·»›]\s*'), lambda x: x <> '')) AS items,
               -- words of the phrases found between borders; a border may serve two phrases
               list_sum(list_transform(regexp_extract_all(
                 regexp_replace(s, '([^\p{L}\p{N}_])', '\1\1', 'g'), '{notice}', 0, 'i'),
                 lambda x: len(list_filter(regexp_split_to_array(x, '[^\p{L}\p{N}_]+'),
                                           lambda y: y <> '')))) AS held
        FROM worded)
), lost AS (
  SELECT doc_id, count(*) FILTER (again) AS n_dup_lines,
         CAST(coalesce(sum(n) FILTER (fails), 0) AS BIGINT) AS lost_words
  FROM judged GROUP BY doc_id
), counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(lost_words, 0) AS lost_words
  FROM docs LEFT JOIN lost USING (doc_id) LEFT JOIN covered USING (doc_id)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND lost_words <= 0.5 * n_words AS kept
FROM counted
""".replace("{notice}", (
    "(?:^|[^\\p{L}\\p{N}_])(?:"
    "(?:(?:we|this site|our site|this website|our website) uses? )?cookies?"
    "(?: (?:policy|settings|preferences|on this site|on our site|on this website|on our website))?"
    "|(?:please )?(?:enable|activate|require|requires) javascript|javascript"
    "|our privacy policy|privacy policy|our terms of use|our terms of service|terms of use"
    "|terms of service|all rights reserved|click here|read more|(?:please )?sign in"
    "|(?:please )?sign up|(?:please )?log in|(?:please )?login"
    "|(?:please )?subscribe to our newsletter|(?:please )?subscribe|our newsletter|newsletter"
    "|share this|share on|copyright|powered by|skip to main content|skip to content|lorem ipsum"
    ")(?:$|[^\\p{L}\\p{N}_])").replace(" ", "  "))     # borders stand doubled in the text


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"),
                                  tokenizer_path("word_bpe_49k.json"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def _op2_sql() -> str:
    """Votes by diagonal in SQL: the template table is written out as values."""
    rows = []
    every = ([(label, text, True) for text, label in licenses.BASE]
             + [(label, text, False) for label, text in licenses.TEMPLATES])
    for t, (label, text, is_base) in enumerate(every):
        words = text.split()
        rows += [f"({t}, '{label}', {is_base}, {i}, {len(words) - 1}, '{words[i]} {words[i + 1]}')"
                 for i in range(len(words) - 1)]
    return rf"""
WITH template(t, label, is_base, t_pos, grams, gram) AS (VALUES {", ".join(rows)}),
docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents
), pairs AS (
  SELECT doc_id, unnest(range(1, len(w))) - 1 AS pos,
         unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram
  FROM docs
), places AS (
  SELECT doc_id, t, any_value(label) AS label, any_value(is_base) AS is_base,
         any_value(grams) AS grams, pos - t_pos AS diagonal, list(DISTINCT t_pos) AS at
  FROM pairs JOIN template USING (gram) GROUP BY doc_id, t, pos - t_pos
), spans AS (       -- a diagonal with those up to the template's shift further: (template place, text place)
  SELECT p.*, list_sort(flatten(list(list_transform(q.at, lambda x: [x, q.diagonal + x]))
                                OVER (PARTITION BY p.doc_id, p.t, p.diagonal))) AS pairs_at,
         row_number() OVER (PARTITION BY p.doc_id, p.t, p.diagonal ORDER BY q.diagonal) AS nth
  FROM places p JOIN places q
    ON p.doc_id = q.doc_id AND p.t = q.t AND q.diagonal - p.diagonal BETWEEN 0 AND
       CASE WHEN p.is_base OR p.grams < {licenses.LONG_TEMPLATE} THEN 0
            ELSE (p.grams + 1) // {licenses.WORDS_PER_SHIFT} END
), chains AS (      -- the longest chain that ends at each pair, in the template's order
  SELECT *, list_reduce(pairs_at, lambda ends, x: list_append(ends, [x[1], x[2],
             1 + coalesce(list_max(list_transform(
                   list_filter(ends, lambda e: e[1] < x[1] AND e[2] < x[2]), lambda e: e[3])), 0)]),
             CAST([] AS BIGINT[][])) AS ends
  FROM spans WHERE nth = 1
), judged AS (
  SELECT *, cover >= CASE WHEN is_base OR grams < {licenses.LONG_TEMPLATE} THEN 1.0
                          ELSE {licenses.MIN_COVER} END AS found
  FROM (SELECT *, list_max(list_transform(ends, lambda e: e[3])) / CAST(grams AS DOUBLE) AS cover
        FROM chains)
), found AS (
  SELECT doc_id, count(*) FILTER (found AND is_base) AS n_base,
         min(diagonal) FILTER (found AND is_base) AS first_word,
         max(diagonal) FILTER (found AND is_base) AS last_word,
         list_sort(list_distinct(list(label) FILTER (found AND is_base))) AS base,
         list_sort(list_distinct(list(label) FILTER (found))) AS every, max(cover) AS score
  FROM judged GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word,
       last_word, coalesce(array_to_string(base, ','), '') AS base_labels,
       coalesce(array_to_string(every, ','), '') AS labels, coalesce(score, 0.0) AS score
FROM docs LEFT JOIN found USING (doc_id)
"""


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark).rstrip('/')}/custseg-warc-{uuid.uuid4().hex}"
    warc.write(read_table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest",
                                         "record_type", "refers_to")


OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), r AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS response_id FROM p
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INT), 5))::BIGINT
              // CAST(power(32, 3 - i % 4) AS BIGINT) % 32 + 1 AS INT), 1)), 'string_agg', '')
         AS payload_digest,
       CASE WHEN page_id = response_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response_id THEN response_id END AS refers_to
FROM r
"""


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
           lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
    END AS s
  FROM docs
), classes AS (
  SELECT min(doc_id) AS c, list_sort(s) AS k, len(k) AS n, list(doc_id) AS members
  FROM sets WHERE len(s) > 0 GROUP BY k
), shingles AS (
  SELECT c, n, unnest(k) AS x FROM classes
), links AS (
  SELECT a.c AS a, b.c AS b
  FROM shingles a JOIN shingles b
    ON a.x = b.x AND a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT c AS a, c AS b FROM classes
  UNION
  SELECT r.a, e.b FROM reached r JOIN both_ways e ON r.b = e.a
), smallest AS (
  SELECT a AS c, min(b) AS component_id FROM reached GROUP BY a
), named AS (
  SELECT unnest(members) AS doc_id, component_id FROM classes JOIN smallest USING (c)
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles,
       coalesce(n.component_id, s.doc_id) AS component_id,
       coalesce(n.component_id, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN named n USING (doc_id)
"""


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"),
                       tokenizer_path("byte_bpe_50k.json"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def _line_digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, dropped, digests = [], [], []
        for text, bitmap in zip(texts(batch, "text"), batch.column("keep_bitmap").to_pylist()):
            kept = line_dedup.kept_lines(text, bitmap)
            n.append(text.count("\n") + 1)
            dropped.append(line_dedup.n_dropped(bitmap, n[-1]))
            digests.append(hashlib.sha256(kept.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()),
             pa.array(digests, pa.string())],
            names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return map_batches(marked, _line_digests,
                       "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


OP9_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.pos, l.line, c.k IS NOT NULL AND l.doc_id <> c.keeper AS gone
  FROM keyed l LEFT JOIN common c USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), ''))
         AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"),
                              read_table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                     lambda x: x <> '') AS w
  FROM documents
), judged AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 50 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text)
                 THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM docs
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic
  FROM labels GROUP BY doc_id
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x)
       JOIN letters d ON d.x NOT IN (a.x, b.x, c.x)
       JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), groups AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good,
         count(*) FILTER (toxic) AS toxic
  FROM judged LEFT JOIN marks USING (doc_id) GROUP BY part, fails
), met AS (
  SELECT g.*, filter_order, step, substr(filter_order, step, 1) AS letter,
         contains(fails, substr(filter_order, step, 1)) AS fails_here,
         regexp_matches(fails, '[' || substr(filter_order, 1, step - 1) || '_]') AS gone_before
  FROM groups g, orders, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)
), totals AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (NOT fails_here AND NOT gone_before), 0) AS kept,
         coalesce(sum(n) FILTER (fails_here AND NOT gone_before), 0) AS removed,
         coalesce(sum(n) FILTER (fails_here AND gone_before), 0) AS redundant,
         coalesce(sum(n) FILTER (fails = letter), 0) AS unique_fails,
         coalesce(sum(good) FILTER (fails_here AND NOT gone_before), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (fails_here AND NOT gone_before), 0) AS toxic_lost
  FROM met GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept,
       CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM totals
"""


def op12_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(read_table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.run_counts(read_table(spark, sf_dir, "documents")))


# crc32 by its rule (reflected polynomial 0xEDB88320), near words by their deletions
OP13_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
           CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[a-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents
), counted AS (
  SELECT run, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS k
  FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, xor(list_reduce(
           list_transform(range(strlen(k)),
                          lambda i: CAST('0x' || substr(hex(k), 2 * i + 1, 2) AS BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM counted, crc_table
), slipped AS (
  SELECT n, CASE WHEN h % 31 = 0
                 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
                 ELSE run END AS word
  FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7
  GROUP BY word HAVING sum(n) >= 2
), cut AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d
  FROM (SELECT word, CAST(unnest(range(1, length(word) + 1)) AS INT) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.d = b.d AND a.i = b.i
  WHERE a.word <> b.word
  UNION SELECT w.word, c.word FROM words w JOIN cut c ON w.word = c.d
  UNION SELECT c.word, w.word FROM words w JOIN cut c ON w.word = c.d
), ranked AS (
  SELECT near.word, other, o.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
         row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) AS place
  FROM near JOIN words o ON o.word = other
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN other_n >= 10 * w.n THEN other END AS form,
         CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND place = 1
), led AS (
  SELECT word, word AS root, 0 AS far FROM formed
  UNION ALL
  SELECT l.word, f.form, far + 1 FROM led l JOIN formed f ON f.word = l.root
  WHERE f.form IS NOT NULL
), ends AS (
  SELECT word, arg_max(root, far) AS root FROM led GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""


def queries() -> dict[str, Query]:
    return {
        "op1_packing": op1_packing,
        "op2_license_scan": op2_license_scan,
        "op3_quality_rules": op3_quality_rules,
        "op4_warc": op4_warc,
        "op5_near_dedup": op5_near_dedup,
        "op6_bpe": op6_bpe,
        "op7_html_text": op7_html_text,
        "op8_ann": op8_ann,
        "op9_line_dedup": op9_line_dedup,
        "op10_secret_scan": op10_secret_scan,
        "op11_filter_audit": op11_filter_audit,
        "op12_lm_score": op12_lm_score,
        "op13_spelling": op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": _op2_sql(), "op3_quality_rules": OP3_SQL, "op4_warc": OP4_SQL,
            "op5_near_dedup": OP5_SQL, "op9_line_dedup": OP9_SQL,
            "op11_filter_audit": OP11_SQL, "op13_spelling": OP13_SQL}
