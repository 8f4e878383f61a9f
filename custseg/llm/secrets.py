"""Secret scan: fixed patterns plus sliding-window Shannon entropy with an allow-list.

Fixed patterns give the base spans (assignments, access key ids, long lower-case hex). The
method then takes every run of key-like characters, classifies it (hex, lower-case
alphanumeric, base64-like) and slides a window over it. The window's Shannon entropy comes from
character counts that change by one character in and one out per step, so a run costs time in
proportion to its length. A run with a window over the threshold of its class is one ``entropy``
span, whole. Windows of mixed-case and base64 runs need no digits; others mix letters and digits.
Runs that match the allow-list (UUIDs, checksums named as such, dates, paths, slugs and camel case
of plain words and numbers), the body of a data URI and spans inside a base span are suppressed.
In a URL, and in a path or slug of which plain words are half, the parts between separators are
judged on their own, so that only the part that is a key becomes a span.

Each text is scanned on its own in the task that reads it: nothing is shuffled. Defined
results: a null text counts as empty and has no spans; repeated rows give repeated result rows; very
long texts are scanned whole, in time proportional to them; an empty table gives no rows;
offsets are code points, end exclusive. Only ``doc_id`` and ``text`` are read by ``scan``, so
other columns of any name do no harm; ``redact`` passes them through.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from custseg.llm.common import map_batches, replace_text, texts

KINDS = ("assign", "access", "hex", "entropy")

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
                     r"([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

# Window length and entropy thresholds (bits per character) by character class.
WINDOW = 20
THRESHOLDS = {"hex": 3.0, "alnum": 3.5, "base64": 3.7}
# Least number of digits, and of other characters, of a window. Mixed case or a plus sign tells keys
# from words already; lower-case words with separators need more.
MIN_DIGITS = {"hex": 1, "alnum": 1, "base64": 0}
SLUG_DIGITS = 2
_SLUG = re.compile(r"[a-z0-9/_=-]+|[A-Z0-9/_=-]+")
_CLASSES = (("hex", re.compile(r"[0-9a-fA-F]+")), ("alnum", re.compile(r"[a-z0-9]+")),
            ("base64", re.compile(r"[A-Za-z0-9+/_=-]+")))

# Plain words in a row: lower case, capitalized, upper case or camel case. Single letters and pairs
# in between are few fixed ones, as a random mixed-case string nearly always has others. Groups are
# atomic, so the time stays in proportion to the run.
_WORDS = (r"(?>(?:[a-z](?=[A-Z])|[A-Za-z](?![A-Za-z]))?+"
          r"(?:(?:An|As|At|Be|By|Db|Do|Go|He|Id|If|In|Io|Is|It|Mc|Me|My|No|Of|On|Or|So|To|Ui|Up|Us|"
          r"We)(?![a-z])|[A-Z]?[a-z]{2,}+|[A-Z]{2,}+|[A-Z](?![A-Za-z]))*+)")
# A part of a path or slug that is no key: words with a few digits after them, names with a digit for
# a word (Expr2Proto3Util), ordinals and numbers.
_PART = (rf"(?>(?:{_WORDS}[0-9]{{0,4}}+|(?:[A-Z]?[a-z]{{3,}}+[2-4]?+){{2,3}}+"
         r"|[0-9]++(?:st|nd|rd|th|px|x[0-9]++)?)(?=[-_/=+]|\Z))")

# Runs that look random but are no secrets.
ALLOW = (
    # UUIDs; checksums named as such; numbers and dates; paths and slugs of plain parts
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"(?:sha1|sha256|sha384|sha512|md5)[-=/_][0-9A-Za-z+/=_-]+",
    r"[0-9_/+=-]+",
    rf"(?:{_WORDS}[0-9]{{0,4}}+[-_/=+])*+{_WORDS}[0-9]{{0,4}}+",
    rf"(?:{_PART}[-_/=+])*+{_PART}",
)
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s\"'<>]+")
_DATA = re.compile(r"data:[A-Za-z0-9.+-]+/[A-Za-z0-9.+-]+(?:;[A-Za-z0-9=-]+)*;base64,[A-Za-z0-9+/=]+")
_SEPARATED = re.compile(r"[^/_=-]+")
_PLAIN_WORD = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}")
WORD_SHARE = 0.5        # of a run's characters in plain words: it is a path or slug

_NLOGN = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 2))]   # one more comes in first


def _windows(run: str, threshold: float, min_digits: int = 2) -> list[tuple[int, int]]:
    """Merged windows of ``run`` with letters, digits and at least ``threshold`` bits.

    ``min_digits`` is the least number of digits, and of other characters, of a window.
    """
    counts: dict[str, int] = {}
    total, digits, found = 0.0, 0, []
    need = (math.log2(WINDOW) - threshold) * WINDOW      # entropy >= threshold: total <= need
    for i, ch in enumerate(run):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += _NLOGN[c + 1] - _NLOGN[c]
        digits += "0" <= ch <= "9"
        if i >= WINDOW:
            old = run[i - WINDOW]
            c = counts[old]
            counts[old] = c - 1
            total += _NLOGN[c - 1] - _NLOGN[c]
            digits -= "0" <= old <= "9"
        if i >= WINDOW - 1 and min_digits <= digits <= WINDOW - min_digits and total <= need + 1e-9:
            start = i - WINDOW + 1
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((start, i + 1))
    return found


_ALLOWED = re.compile("|".join(f"(?:{p})" for p in ALLOW))


def _is_key(run: str) -> bool:
    """Whether a window of the run passes the threshold of its character class."""
    if _ALLOWED.fullmatch(run):
        return False
    kind = next(k for k, p in _CLASSES if p.fullmatch(run))
    digits = SLUG_DIGITS if kind == "base64" and _SLUG.fullmatch(run) else MIN_DIGITS[kind]
    return bool(_windows(run, THRESHOLDS[kind], digits))


def _is_path(run: str) -> bool:
    """Whether plain words between separators make up ``WORD_SHARE`` of the run."""
    words = [x for x in _SEPARATED.findall(run) if _PLAIN_WORD.fullmatch(x)]
    return len(words) > 1 and sum(map(len, words)) >= WORD_SHARE * len(run)


def _inside(places: list[tuple[int, int]], at: int) -> bool:
    """Whether ``at`` lies in one of the places, which are sorted and apart."""
    i = bisect_right(places, (at, 1 << 62)) - 1
    return i >= 0 and at < places[i][1]


def spans(text: str) -> list[tuple[int, int, str]]:
    """All spans as (start, end, kind), sorted by start, then by kind as listed in ``KINDS``."""
    base: list[tuple[int, int, str]] = []
    if ":" in text or "=" in text:       # every assignment holds one of them
        base += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text)
                 if len(m.group(2)) >= 8]
    if "AKIA" in text:
        base += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)
                 if m.end() - m.start() >= 16]
    found = []
    urls = [m.span() for m in _URL.finditer(text)] if "://" in text else []
    data = [m.span() for m in _DATA.finditer(text)] if ";base64," in text else []
    for m in _RUN.finditer(text):        # a long hex run lies inside one run of the wider class
        at, run = m.start(), m.group()
        base += [(at + x.start(), at + x.end(), "hex") for x in _HEX.finditer(run)
                 if x.end() - x.start() >= 32]
        if _ALLOWED.fullmatch(run) or _inside(data, at):
            continue
        if _inside(urls, at) or _is_path(run):
            found += [(at + x.start(), at + x.end()) for x in _SEPARATED.finditer(run)
                      if x.end() - x.start() >= WINDOW and _is_key(x.group())]
        elif _is_key(run):
            found.append((at, m.end()))
    base.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    extra = [(a, b, "entropy") for a, b in found
             if not any(x <= a and b <= y for x, y, _ in base)]
    return sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2])))


def _joined(found: Iterable[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in texts(batch, "text"):
            found = spans(text)
            base = [s for s in found if s[2] != "entropy"]
            n = [sum(s[2] == k for s in base) for k in KINDS[:3]]
            rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)))
        cols = list(zip(*rows)) if rows else [[]] * 5
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, counts of base spans, their digest, all spans."""
    return map_batches(docs.select("doc_id", "text"), _scan,
                       "doc_id long, n_assign long, n_access long, n_hex long, "
                       "base_sha256 string, spans string")


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span (overlapping ones as one) replaced by ``mark``."""
    merged: list[list[int]] = []
    for a, b, _ in spans(text):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    out, at = [], 0
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with secrets replaced in ``text``; every document stays."""
    return replace_text(docs, lambda ts: [redacted(t, mark) for t in ts])
