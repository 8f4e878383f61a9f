"""Line-first cleaning: rules judge every line, then the document by what the rules remove.

A line fails if it is symbol-heavy, a navigation bar, boilerplate, or a short fragment without
closing punctuation; a line equal to an earlier line of its document fails as a repeat.
Boilerplate is a phrase between word borders that makes up half of a sentence, or a label of a few
words that holds one. A document is rejected if its failing lines hold more than ``max_lost`` of its words, or by the
base rules (too few words, too many repeated 5-word windows).

Every text is judged on its own in the task that reads it; nothing is shuffled, and the work is
linear in the text but for two sorts of the word windows of texts with repeats. Defined results:
a null or empty text has no words and is rejected; repeated rows give repeated result rows;
``doc_id`` is passed through, null included; texts are whole, however long; an empty table gives no
rows. Only ``doc_id`` and ``text`` are read by ``judge``; ``clean`` passes all other columns through.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from custseg.llm.common import ASCII_SPACE, map_batches, replace_text, texts

SYMBOLS = "#*$%&|<>"
GRAM = 5
LABEL_WORDS = 6


@dataclass(frozen=True)
class Rules:
    """Limits of the line and document rules."""

    min_words: int = 10             # base rule
    max_repeat_pct: int = 20        # base rule: words in repeated windows, per cent of words
    symbol_share: float = 0.08      # of a line's characters without white space
    fragment_words: int = 4         # shorter lines need closing punctuation
    boilerplate_words: int = 25     # longer lines may mention a boilerplate phrase
    nav_items: int = 4              # items of a navigation bar
    nav_item_words: float = 3.0     # mean words of its items, at most
    max_lost: float = 0.5           # share of a document's words that may be removed
    phrase_share: float = 0.5       # of a sentence's words that boilerplate phrases hold, at least


DEFAULT = Rules()

# Closing punctuation.
_CLOSING = tuple(".!?…:;,\"'”’»)]}。！？：；」』）।؟")
# Boilerplate phrases between word borders, with the words that make them a site's own
# notice.
_NOTICE = re.compile(
    r"(?<!\w)(?:(?:(?:we|(?:this|our) (?:web)?site) uses? )?cookies?"
    r"(?: (?:policy|settings|preferences|on (?:this|our) (?:web)?site))?"
    r"|(?:please )?(?:enable|activate|requires?) javascript|javascript"
    r"|(?:our )?privacy policy|(?:our )?terms of (?:use|service)|all rights reserved"
    r"|click here|read more|(?:please )?sign (?:in|up)|(?:please )?log ?in"
    r"|(?:please )?subscribe(?: to our newsletter)?|(?:our )?newsletter|share (?:this|on)"
    r"|copyright|powered by|skip to (?:main )?content|lorem ipsum)(?!\w)", re.IGNORECASE)
_SENTENCE_END = re.compile(r"[.!?…。！？।؟][\"'”’»)\]]*\Z")
_NAV = re.compile(r"\s[|•·»›>/]\s|\s*[|•·»›]\s*")


# Plain strings of which every match of the pattern above holds one: a cheap first look.
_HINTS = ("cookie", "javascript", "privacy", "terms of", "rights reserved", "click here",
          "read more", "sign", "log", "subscribe", "newsletter", "share", "copyright",
          "powered by", "skip to", "lorem")
_SEPARATORS = "|•·»›>/"


def _boilerplate(line: str, rules: Rules) -> bool:
    """Whether boilerplate phrases make up most of a sentence, or a line is the label of one.

    A line that does not end as one counts as no sentence if it is as short as a label; longer
    ones are prose whose punctuation was lost or runs on in the next line.
    """
    held = sum(len(m.group().split()) for m in _NOTICE.finditer(line))
    if not held:
        return False
    n_words = len(line.encode().split())
    label = n_words <= LABEL_WORDS and not _SENTENCE_END.search(line)
    return label or held >= rules.phrase_share * n_words


def line_fails(line: str, rules: Rules = DEFAULT, symbols: bool = True,
               hints: bool = True) -> bool:
    """Whether the punctuation, symbol, navigation or boilerplate rule fails a line with words.

    ``symbols`` and ``hints`` may be False if the whole text is known to hold none.
    """
    line = line.strip(ASCII_SPACE)
    if symbols:
        n_symbols = sum(map(line.count, SYMBOLS))
        if n_symbols and n_symbols > rules.symbol_share * sum(map(len, line.split())):
            return True
    n_words = len(line.encode().split(None, max(rules.boilerplate_words, rules.fragment_words)))
    if n_words < rules.fragment_words and not line.endswith(_CLOSING):
        return True
    if hints and n_words <= rules.boilerplate_words and _boilerplate(line, rules):
        return True
    if not any(c in line for c in _SEPARATORS):
        return False
    n_words = len(line.encode().split())
    items = [x for x in _NAV.split(line) if x] if n_words >= rules.nav_items else ()
    return len(items) >= rules.nav_items and n_words <= rules.nav_item_words * len(items)


def repeated_window_words(words: list[bytes], size: int = GRAM) -> int:
    """Words inside ``size``-word windows that occur twice or more, the first one included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    for w in words:
        if w not in number:
            number[w] = len(number)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = h * np.uint64(0xD6E8FEB86659FD93) + mixed[j:j + n]
    order = np.sort(h)
    if not (order[1:] == order[:-1]).any():      # no equal hash: no equal window
        return 0
    rank = ids[:n]                                # exact: number prefixes word by word
    for j in range(1, size):
        _, rank = np.unique(rank * len(number) + ids[j:j + n], return_inverse=True)
    repeated = np.bincount(rank)[rank] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(repeated)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + size, -1)
    return int((np.cumsum(cover) > 0).sum())


def measure(text: str, rules: Rules = DEFAULT) -> tuple[int, int, int, int, int, int, list[bool]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words lost, line kept)."""
    words = text.encode().split()                 # bytes split at ASCII white space only
    word_chars = len(text) - sum(map(text.count, ASCII_SPACE))
    n_symbols = sum(map(text.count, SYMBOLS))
    lower = text.lower()
    hints = any(h in lower for h in _HINTS)
    seen: set[str] = set()
    n_dup, lost, kept = 0, 0, []
    for line in text.split("\n"):
        if not line.strip(ASCII_SPACE):
            kept.append(True)
            continue
        repeat = line in seen
        seen.add(line)
        n_dup += repeat
        fails = repeat or line_fails(line, rules, n_symbols > 0, hints)
        lost += len(line.encode().split()) if fails else 0
        kept.append(not fails)
    return (len(words), word_chars, n_symbols, n_dup, repeated_window_words(words), lost, kept)


def verdict(n_words: int, n_repeat_words: int, lost: int, rules: Rules = DEFAULT):
    """(base_failed, kept)."""
    base_failed = (n_words < rules.min_words
                   or 100 * n_repeat_words > rules.max_repeat_pct * n_words)
    return base_failed, not base_failed and lost <= rules.max_lost * n_words


def judge(docs: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """One row per input row: the counts, base_failed, lost_words, kept."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in texts(batch, "text"):
                n, chars, symbols, dup, rep, lost, _ = measure(text, rules)
                rows.append((n, chars, symbols, dup, rep, lost, *verdict(n, rep, lost, rules)))
            cols = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.int64()] * 6 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       "n_repeat_words", "lost_words", "base_failed", "kept"])

    return map_batches(docs.select("doc_id", "text"), run,
                       "doc_id long, n_words long, word_chars long, n_symbols long, "
                       "n_dup_lines long, n_repeat_words long, lost_words long, "
                       "base_failed boolean, kept boolean")


def cleaned(text: str, rules: Rules = DEFAULT) -> str | None:
    """The text without its failing lines; None if the document is rejected."""
    n, _, _, _, rep, lost, kept = measure(text, rules)
    if not verdict(n, rep, lost, rules)[1]:
        return None
    if lost == 0:
        return text
    return "\n".join([x for x, k in zip(text.split("\n"), kept) if k])


def clean(docs: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """``docs`` without rejected documents and without the failing lines of the others."""
    return replace_text(docs, lambda ts: [cleaned(t, rules) for t in ts])
