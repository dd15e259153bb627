"""Rule-based cleaning, lines first.

Every line of a text is judged by itself: does it end like a sentence, is it navigation,
is it boilerplate. Lines that fail are removed; a document that loses too much of its text,
or fails one of the base rules on whole texts, is rejected. One narrow pass, no shuffle.

Defined results: a null or empty text has no words and fails; repeated rows are judged each
by itself; further columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mailmine.llm import bytesops as B
from mailmine.llm.tables import documents, prepare


@dataclass(frozen=True)
class RuleParams:
    """Limits of the rules; all of them hold for every text alike."""

    min_words: int = 10
    repeat_window: int = 5
    max_repeat_percent: int = 20      # words in repeated windows
    nav_words: int = 3                # a line of up to so many words ...
    fragment_words: int = 10          # a line of up to so many words without an end mark is no sentence
    nav_separators: int = 2           # ... or with so many separators among its words is navigation
    min_kept_percent: int = 50        # words on lines that stay; below, the document goes


SEPARATORS = frozenset("|»›·>/•")
TERMINAL = re.compile(r"[.!?…:;,\"'”’)\]»][\x20\x09-\x0D]*+\Z")
SHOUTING = re.compile(r"[!?]{2,}|[#*$%&|<>]{3,}")     # runs of marks and of symbols
BOILERPLATE = re.compile(
    r"cookie|javascript|all rights reserved|terms of (?:use|service)|privacy policy|sign in|log in|subscribe"
    r"|click here|read more|share this|lorem ipsum|home page", re.IGNORECASE | re.ASCII)
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))

SCHEMA = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
          "base_failed boolean, kept boolean, n_bad_punctuation bigint, n_navigation bigint, n_boilerplate bigint, "
          "n_kept_words bigint, clean_text string")


def line_verdict(line: str, p: RuleParams) -> str:
    """'' for a line that stays, else the rule that removes it; lines without a word stay."""

    words = _WORDS.findall(line)
    if not words:
        return ""
    separators = sum(w in SEPARATORS for w in words)
    if separators >= p.nav_separators and 3 * separators >= len(words):
        return "navigation"
    if len(words) <= p.nav_words and not TERMINAL.search(line):
        return "navigation"
    if len(words) <= 20 and BOILERPLATE.search(line):
        return "boilerplate"
    if len(words) <= p.fragment_words and not TERMINAL.search(line):
        return "punctuation"
    if 2 * len(SHOUTING.findall(line)) > len(words):
        return "punctuation"
    return ""


def _lines(text: str, p: RuleParams) -> tuple[int, dict[str, int], int, str]:
    """Lines equal to an earlier one, lines removed by rule, words kept, the text that stays."""

    seen: set[str] = set()
    removed = {"punctuation": 0, "navigation": 0, "boilerplate": 0}
    again, words, stay = 0, 0, []
    for line in text.split("\n"):
        n = len(_WORDS.findall(line))
        if n:
            again += line in seen
            seen.add(line)
        rule = line_verdict(line, p)
        if rule:
            removed[rule] += 1
        else:
            words += n
            stay.append(line)
    return again, removed, words, "\n".join(stay)


_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _repeats(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Per text: words, code points in words, symbols, words in repeated windows."""

    n = len(offsets) - 1
    starts, ends, rows = B.word_bounds(data, offsets)
    head = (data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(head & B.WORD[data])])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    hashes = B.window_hashes(B.word_hashes(data, starts, ends), window, words=True)
    whole = B.inside_rows(rows, window, len(starts))[:len(hashes)]
    owner = np.repeat(np.arange(n), np.diff(rows))[:len(hashes)]
    place = np.flatnonzero(whole)
    key = B.mix(hashes[place] + owner[place].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(place), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    flags = np.zeros(len(starts), bool)
    flags[place[twice]] = True
    hit = np.concatenate([[0], np.cumsum(B.covered(flags, window, len(starts)))]) if len(starts) else np.zeros(1, np.int64)
    return (np.diff(rows), chars[offsets[1:]] - chars[offsets[:-1]], symbols[offsets[1:]] - symbols[offsets[:-1]],
            hit[rows[1:]] - hit[rows[:-1]])


def _judge(p: RuleParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.texts(batch.column("text"))
            for low, high in B.slices(offsets):
                part = offsets[low:high + 1] - offsets[low]
                body = data[offsets[low]:offsets[high]]
                n_words, chars, symbols, repeats = _repeats(body, part, p.repeat_window)
                raw = body.tobytes()
                lines = [_lines(raw[a:b].decode(), p) for a, b in zip(part[:-1], part[1:], strict=True)]
                failed = (n_words < p.min_words) | (100 * repeats > p.max_repeat_percent * n_words)
                left = np.array([x[2] for x in lines], np.int64)
                kept = ~failed & (100 * left >= p.min_kept_percent * n_words)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(low, high - low), pa.array(n_words, pa.int64()), pa.array(chars, pa.int64()),
                    pa.array(symbols, pa.int64()), pa.array([x[0] for x in lines], pa.int64()), pa.array(repeats, pa.int64()),
                    pa.array(failed), pa.array(kept), *(pa.array([x[1][k] for x in lines], pa.int64())
                                                        for k in ("punctuation", "navigation", "boilerplate")),
                    pa.array(left), pa.array([x[3] for x in lines], pa.string())], names=NAMES)
    return run


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def clean_by_rules(docs: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """One row per document: counts, verdict and the text without the failing lines (``clean_text``)."""

    prepare(docs.sparkSession)
    return documents(docs).mapInArrow(_judge(params), SCHEMA)
