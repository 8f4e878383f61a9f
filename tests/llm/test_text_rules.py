"""Quality rules, secret scan and license scan against plain versions."""

import hashlib
import random
import re
import time

import pytest

from custseg.llm import licenses, quality, secrets


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# -- quality rules ---------------------------------------------------------------------------
GOOD = ("The quiet river runs past the old mill, and every morning it carries a few leaves "
        "down to the sea.")


def plain_counts(text):
    words = re.findall(r"[^ \t\n\x0b\x0c\r]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    cover = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            cover |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^ \t\n\x0b\x0c\r]", x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(cover))


def random_text(rnd):
    return "".join(rnd.choice(["a", "b", "c d e f g ", " ", "\n", "\t", " ", "é", "#", "| ",
                               "a b c d e ", " ", "😀"]) for _ in range(rnd.randint(0, 60)))


def test_base_counts(docs_of):
    rnd = random.Random(4)
    texts = [random_text(rnd) for _ in range(150)] + [None, "", " \n ", "a", GOOD * 50]
    got = by_id(quality.judge(docs_of(texts)))
    for i, t in enumerate(texts):
        r, exp = got[i], plain_counts(t or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"],
                r["n_repeat_words"]) == exp
        assert r["base_failed"] == (exp[0] < 10 or 100 * exp[4] > 20 * exp[0])
        assert not (r["base_failed"] and r["kept"])


@pytest.mark.parametrize("line, fails", [
    (GOOD, False), ("Home | About | Contact | News", True), ("We use cookies on this site.", True),
    ("Menu", True), ("A short sentence.", False), ("Or*** the### text$$$ here%%% was&&&", True),
    ("Über die Brücke, sagte sie.", False), ("他说这是一个很长的句子。", False),
    ("An unpunctuated line of nine words is not removed", False)])
def test_line_rules(line, fails):
    assert quality.line_fails(line) is fails


PROSE = [
    "And is erer. Ereaes oftheshare onstor.", "The catalog in the hall lists every book.",
    "A dialog in the third act was cut.", "Her design in blue won the prize last year.",
    "She baked one cookie for every child.", "JavaScript was written in ten days in May 1995.",
    "The privacy policy of the town dates from 1970.", "Its terms of use were debated all summer.",
    "He sold the book with all rights reserved in 1920.", "The manual told readers to click here first.",
    "Every child should read more poems at school.", "Guests sign in at the desk on the left.",
    "Many sign up for the choir each autumn.", "Pilots log in with a card and a long number.",
    "Few scholars subscribe to that theory today.", "The parish newsletter came out every Friday.",
    "Neighbours share this well in the dry months.", "They share on average two meals a day.",
    "The copyright on the song expired in 1998.", "The mill was powered by the river below.",
    "Hurried readers skip to content they know already.", "The words lorem ipsum come from Cicero."]


@pytest.mark.parametrize("line", PROSE)
def test_cleaning_keeps_prose_that_mentions_a_phrase(line):
    assert not quality.line_fails(line)


@pytest.mark.parametrize("line", [
    "We use cookies on this site.", "This website uses cookies.", "Click here", "Read more ...",
    "Copyright 2024 All rights reserved.", "Sign in or sign up", "Share this on Facebook today",
    "Privacy Policy, Terms of Service", "Please enable JavaScript.", "Skip to main content",
    "Powered by WordPress and friends", "Subscribe to our newsletter!", "Log in"])
def test_cleaning_fails_boilerplate(line):
    assert quality.line_fails(line)


def test_clean_keeps_documents_on_javascript_cookies_and_copyright(docs_of):
    text = "\n".join(PROSE)
    assert [r["text"] for r in quality.clean(docs_of([text, "\n".join(PROSE[4:8])])).collect()
            ] == [text, "\n".join(PROSE[4:8])]


def test_clean_keeps_good_documents_and_lines(docs_of):
    good = (GOOD + "\nNobody in the village remembers who built it or why.\n"
            "Some say a miller came from the north with nothing but two stones.")
    nav = "\n".join(["Home | About | Contact | News"] + [f"a{i} | b{i} | c{i} | d{i}"
                                                         for i in range(9)])
    docs = docs_of([good, nav, good + "\nHome | About | Contact | News", None])
    out = quality.clean(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {0: good, 2: good}
    assert quality.clean(docs_of([])).count() == 0


def test_long_text_and_repeated_rows(docs_of):
    long = " ".join(f"word{i}." for i in range(200_000))
    got = quality.judge(docs_of([(7, long), (7, long), (None, GOOD)])).collect()
    assert len(got) == 3 and sum(r["n_words"] == 200_000 and r["kept"] for r in got) == 2


# -- secrets ---------------------------------------------------------------------------------
def plain_base(text):
    out = []
    for m in re.finditer(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|"
                         r"[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
                         r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 16:
            out.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 32:
            out.append((m.start(), 2, m.end(), "hex"))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def secret_texts():
    rnd = random.Random(8)
    bits = ["password", "Token", "API_KEY", "apikey", "ſecret", "toKen", " = ", ":", "'", '"',
            "AKIA", "ABCDEFGH1234", "0123456789abcdef", "deadbeef", "x", " ", "é", "secret:", "=",
            "aB3xY9Qz7LmN2pR5tV8w", "\n", "😀"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(400)]


def test_base_spans(docs_of):
    texts = secret_texts() + [None, "", "token=secret:abcdefgh", "a" * 100_000 + "0" * 40]
    got = by_id(secrets.scan(docs_of(texts)))
    for i, t in enumerate(texts):
        base, r = plain_base(t or ""), got[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [
            sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex")]
        assert set(base) <= set((r["spans"] or "").split(","))


def test_entropy_spans_and_allow_list():
    key = "wJalrXUtnFEMI7K9MDENGbPxRfiCYzQ2h4"
    found = secrets.spans(f"the key {key} was here")
    assert [(k, a <= 10 and b >= 40) for a, b, k in found] == [("entropy", True)]
    for harmless in ("123e4567-e89b-12d3-a456-426614174000", "gggggggggggggggggggggggggggg1111",
                     "sha256-Q2h4wJalrXUtnFEMI7K9MDENGbPxRfiCYz", "2024-01-01-2024-12-31-000",
                     "docs/guide/chapter-12/section-3/index", "internationalizationandlocalization"):
        assert secrets.spans(f"see {harmless} there") == []


@pytest.mark.parametrize("letters", [
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + x for x in ("", "+/", "-_")]
    + ["abcdefghijklmnopqrstuvwxyz0123456789", "0123456789ABCDEF"])
@pytest.mark.parametrize("n, least", [(20, 0.95), (24, 0.98), (32, 0.995), (40, 0.998), (64, 0.999)])
def test_random_keys_are_found_whole(letters, n, least):
    rnd = random.Random(n)
    keys = ["".join(rnd.choices(letters, k=n)) for _ in range(1000)]
    found = [secrets.spans(f"my key {k} here") for k in keys]
    assert sum(map(bool, found)) >= least * len(keys)
    assert all(any(a <= 7 and b >= 7 + n for a, b, _ in f) for f in found if f)


def test_key_with_one_digit_and_plain_words():
    key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    assert secrets.redacted(f"use {key} now") == "use [SECRET] now"
    for harmless in ("getElementByIdAndSomethingElse", "parseXMLDocumentFromString", "word2vec-for-all-of-us",
                     "src/main/java/com/example/MyClass", "iPhoneUsersAreHereForEver", "THE_LONG_CONSTANT_NAME_2"):
        assert secrets.spans(f"see {harmless} there") == []
    assert secrets.spans("Ab" * 50_000 + "aB" * 50_000) == []


@pytest.mark.parametrize("text, spans", [
    ("https://www.amazon.com/dp/B07XJ8C8F5/ref=sr_1_3", []),
    ("https://example.org/a/5db8ae9e/View2Model9Base/item-12-of-40?page=3&sort=asc", []),
    ("import org/apache/spark/sql/catalyst/Expr2Proto3Util", []),
    ("isbn/9780262033848/introduction-to-algorithms-3rd-edition", []),
    ("see /usr/lib/python3/dist-packages/numpy2cuda/utils_v3.py", []),
    ("src='data:image/png;base64,iVBORw0KGgoAAAANSUhEUgAAAAUAAAAFCAYAAACNbyblAAAAHElEQVQI12P4'", []),
    # a part that is a key is one, and nothing else of the URL or path
    ("https://hooks.example.com/services/T00000000/aB3dE5gH7jK9mN1pQ3rS5tU7", [(45, 69)]),
    ("deploy/config/production-cluster/settings/aB3dE5gH7jK9mN1pQ3rS5tU7", [(42, 66)]),
])
def test_urls_paths_and_slugs(text, spans):
    assert [(a, b) for a, b, kind in secrets.spans(text) if kind == "entropy"] == spans


def test_long_runs_take_time_in_proportion():
    for piece in ("aB3/", "Abc12", "ab-", "a1B2-", "abc/", "Ab1", "https://a/ab3Cd/"):
        start = time.perf_counter()
        secrets.spans(piece * 100_000)
        assert time.perf_counter() - start < 5


def test_entropy_equals_a_direct_count():
    import math
    rnd = random.Random(2)
    for _ in range(60):
        run = "".join(rnd.choice("ab12cd34efXYZ90") for _ in range(rnd.randint(20, 60)))
        cover = set()
        for i in range(len(run) - 19):
            w = run[i:i + 20]
            h = -sum(w.count(c) / 20 * math.log2(w.count(c) / 20) for c in set(w))
            if h >= 3.3 - 1e-9 and 2 <= sum(c.isdigit() for c in w) <= 18:
                cover |= set(range(i, i + 20))
        spans = secrets._windows(run, 3.3)
        assert {i for a, b in spans for i in range(a, b)} == cover


def test_redact(docs_of):
    docs = docs_of([f"x {'0123456789abcdef' * 2} y", "clean text", None])
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {
        0: "x [SECRET] y", 1: "clean text", 2: None}
    assert all(not secrets.spans(secrets.redacted(t)) or "[SECRET]" in secrets.redacted(t)
               for t in secret_texts())


# -- licenses --------------------------------------------------------------------------------
def plain_license(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    at, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return (len(words), len(at), min(at, default=None), max(at, default=None),
            ",".join(sorted(labels)))


def test_licenses(docs_of):
    rnd = random.Random(6)
    bits = ["cc", "by", "CC-BY", "General Public", "license", "LICENSE", "all rights", "reserved",
            "All Rights Reserved.", "é", "x1", "\x00", "\n", "cc by cc by", "general", "😀", "ALL"]
    texts = [" ".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(200)]
    texts += [None, "", "one", "cc", "cc by", "word " * 50_000 + "cc by"]
    got = by_id(licenses.scan(docs_of(texts)))
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"],
                r["base_labels"]) == plain_license(t), t
        assert 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_long_templates_allow_edits(docs_of):
    words = dict((label, text) for label, text in licenses.TEMPLATES if len(text) > 100)["bsd"].split()
    edited = words[:7] + ["indeed"] + words[7:]
    unlike = " ".join(words[:5])
    got = by_id(licenses.scan(docs_of([" ".join(words), " ".join(edited), unlike])))
    assert [got[i]["labels"] for i in range(3)] == ["bsd", "bsd", ""]
    assert got[0]["score"] == 1.0 > got[1]["score"] > 0.8 > got[2]["score"] > 0


def test_repeated_fragments_are_no_license(docs_of):
    """A text that repeats a few words of a template covers those places alone."""
    mit = next(t for label, t in licenses.TEMPLATES if label == "mit" and len(t.split()) > 20)
    words = mit.split()
    texts = ["the software " * 30, "in the software to deal in the software " * 20,
             " ".join(words[:8] * 6), " ".join(reversed(words)),
             " ".join(w for i in range(0, len(words) - 1, 2) for w in (words[i + 1], words[i])),
             " ".join(words[len(words) // 2:] + words[:len(words) // 2])]
    got = by_id(licenses.scan(docs_of(texts)))
    assert all(r["labels"] == "" and r["score"] < 0.8 for r in got.values())
    assert got[0]["score"] < 0.1


def plain_cover(words, template):
    """The longest chain of 2-grams in order on diagonals from one to the shift further."""
    t = template.split()
    grams, best = len(t) - 1, 0
    shift = 0 if grams < licenses.LONG_TEMPLATE else (grams + 1) // licenses.WORDS_PER_SHIFT
    matches = [(j, i) for j in range(grams) for i in range(len(words) - 1)
               if words[i:i + 2] == t[j:j + 2]]
    for first in {i - j for j, i in matches}:
        own = [m for m in matches if first <= m[1] - m[0] <= first + shift]
        ends = []
        for j, i in own:
            ends.append((j, i, 1 + max((n for a, b, n in ends if a < j and b < i), default=0)))
        best = max(best, max(n for *_, n in ends))
    return best / grams


def test_spans_against_plain_chains(docs_of):
    rnd = random.Random(6)
    templates = [t for _, t in licenses.TEMPLATES]
    texts = []
    for _ in range(150):
        words = rnd.choice(templates).split()
        for _ in range(rnd.randint(0, 5)):
            i = rnd.randrange(len(words))
            words[i:i + rnd.randint(0, 2)] = rnd.choices(
                ["the", "software", "license", "of", "other"], k=rnd.randint(0, 2))
            words = words or ["the"]
        texts.append("some words " + " ".join(words * rnd.randint(1, 2)) + " and others")
    got = by_id(licenses.scan(docs_of(texts)))
    every = templates + [text for text, _ in licenses.BASE]
    for i, text in enumerate(texts):
        covers = [plain_cover(text.split(), t) for t in every]
        assert got[i]["score"] == pytest.approx(max(covers))
        found = {label for (label, t), c in zip(licenses.TEMPLATES, covers)
                 if c >= (0.8 if len(t.split()) - 1 >= licenses.LONG_TEMPLATE else 1)}
        assert set(filter(None, got[i]["labels"].split(","))) - {x for _, x in licenses.BASE} \
            <= found | {x for _, x in licenses.BASE}
        assert found <= set(got[i]["labels"].split(","))


def test_repeated_rows_come_out_as_often(docs_of):
    got = licenses.scan(docs_of([(1, "cc by"), (1, "cc by"), (1, "other"), (None, "cc by")])).collect()
    assert sorted((str(r["doc_id"]), r["n_base"]) for r in got) == [
        ("1", 0), ("1", 1), ("1", 1), ("None", 1)]
    assert licenses.scan(docs_of([])).count() == 0


def test_no_python_in_the_plan(docs_of):
    plan = licenses.scan(docs_of(["cc by"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "CartesianProduct" not in plan
