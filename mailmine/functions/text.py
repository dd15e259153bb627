"""Cleaning and feature extraction as native column expressions.

All functions take and return ``Column``. Patterns are stated with Unicode
classes, as the texts may hold any language; no Python worker is started.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailmine.functions import lexicon as lx


def java(pattern: str, ignore_case: bool = False, lines: bool = False) -> str:
    r"""``pattern`` with Unicode classes and ``\n`` as the only line end."""

    flags = "Ud" + ("i" if ignore_case else "") + ("m" if lines else "")
    return f"(?{flags}){pattern}"


def _within_line(pattern: str) -> str:
    r"""``pattern`` of one line, for use in a whole text: ``\s`` must not leave the line."""

    return pattern.removeprefix("^").replace(r"\s", r"[^\S\n]")


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return text.rlike(java(pattern, ignore_case))


def substitute(text: Column, pattern: str, replacement: str, ignore_case: bool = False) -> Column:
    return F.regexp_replace(text, F.lit(java(pattern, ignore_case)), F.lit(replacement))


def contains_any(lowered: Column, words: Iterable[str]) -> Column:
    hits = [lowered.contains(w) for w in words]
    out = hits[0]
    for hit in hits[1:]:
        out = out | hit
    return out


# Patterns that meet long runs of blanks are possessive and start only where a run starts, so a
# text of any length is read once.

# what \s stands for with Unicode classes
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Trim all Unicode whitespace, not only blanks; only the two ends are read."""

    return F.btrim(text, F.lit(WHITE_SPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE_SPACE))


def normalize_whitespace(text: Column) -> Column:
    """Unify line ends, squeeze blanks and empty lines, trim."""

    out = F.regexp_replace(text, r"\r\n?", "\n")
    # a single blank stays as it is and is no match
    out = F.regexp_replace(out, r"\t[ \t]*| [ \t]+", " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return strip(out)


_QUOTED_LINE = "|".join(
    _within_line(p).removesuffix("$").replace(".*?", r"[^\n]*?") + (r"[^\n]*" if not p.endswith("$") else "")
    for p in lx.QUOTE_LINES
)


def remove_quoted_replies(text: Column) -> Column:
    """Drop quoted lines together with the blank lines right after them."""

    pattern = java(rf"^(?:{_QUOTED_LINE})\n(?:[^\S\n]*+\n)*+", ignore_case=True, lines=True)
    kept = F.regexp_replace(F.concat(text, F.lit("\n")), pattern, "")
    return F.regexp_replace(kept, r"\n\z", "")


_SIGNATURE_LINE = "|".join(
    _within_line(p.replace(r"^\s*", "^")) for p in lx.SIGNATURE_LINES
)


def remove_signatures(text: Column) -> Column:
    """Cut the text at its first signature line."""

    pattern = java(rf"^[^\S\n]*(?:{_SIGNATURE_LINE})[\s\S]*", ignore_case=True, lines=True)
    return rstrip(F.regexp_replace(text, pattern, ""))


def remove_tracking_text(text: Column) -> Column:
    """Remove tracking links, image markers and the unsubscribe footer."""

    for pattern in lx.TRACKING_PATTERNS:
        text = substitute(text, pattern, "", ignore_case=True)
    return text


def clean_body(text: Column) -> Column:
    """The whole cleaning chain for a message body."""

    text = normalize_whitespace(text)
    text = remove_quoted_replies(text)
    text = remove_signatures(text)
    text = remove_tracking_text(text)
    return normalize_whitespace(text)


def combine(subject: Column, body: Column) -> Column:
    """Subject, blank line, body; or whichever of the two is set."""

    # trimming the joined text drops the blank line when one side is empty
    subject = strip(F.coalesce(subject, F.lit("")))
    body = strip(F.coalesce(body, F.lit("")))
    return strip(F.concat(subject, F.lit("\n\n"), body))


def extract_greeting(text: Column) -> Column:
    """First non-blank line if it greets, else ''."""

    first = F.regexp_extract(text, java(r"\A\s*([^\n]*\S)"), 1)
    return F.when(matches(first, lx.GREETING_LINE, True), first).otherwise("")


def extract_closing(text: Column) -> Column:
    """Last line with a closing word among the last six non-blank lines, else ''."""

    filled = F.split(strip(text), java(r"(?<!\s)[^\S\n]*+\n\s*+"))
    # last line first, so that lines and hits are each computed once
    tail = F.slice(F.reverse(filled), F.lit(1), F.lit(6))
    closing = "|".join(lx.CLOSING_LINES)
    hits = F.filter(tail, lambda line: matches(line, closing, True))
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(""))


def _replace_first(text: Column, found: Column, replacement: str) -> Column:
    swapped = F.overlay(text, F.lit(replacement), F.instr(text, found), F.length(found))
    return F.when(F.length(found) > 0, swapped).otherwise(text)


def canonical_greeting(text: Column) -> Column:
    """The greeting line, where there is one, in its canonical form."""

    return _replace_first(text, extract_greeting(text), lx.GREETING_TEXT)


def canonical_closing(text: Column) -> Column:
    """The closing line, where there is one, in its canonical form."""

    return _replace_first(text, extract_closing(text), lx.CLOSING_TEXT)


def action_words(text: Column, lowered: Column | None = None) -> Column:
    """Sorted action words contained in the text (substring test)."""

    lowered = F.lower(text) if lowered is None else lowered
    return F.array_compact(
        F.array(*[F.when(lowered.contains(w), F.lit(w)) for w in sorted(lx.ACTION_WORDS)])
    )


def placeholder_slots(text: Column) -> Column:
    """Names of the slots with at least one hit, in slot order."""

    slots = []
    for slot, patterns in lx.PLACEHOLDER_SLOTS.items():
        hit = matches(text, patterns[0], True)
        for pattern in patterns[1:]:
            hit = hit | matches(text, pattern, True)
        slots.append(F.when(hit, F.lit(slot)))
    return F.array_compact(F.array(*slots))


def intent(text: Column, lowered: Column | None = None) -> Column:
    lowered = F.lower(text) if lowered is None else lowered
    label = F.when(contains_any(lowered, lx.INTENT_RULES[0][1]), lx.INTENT_RULES[0][0])
    for name, words in lx.INTENT_RULES[1:]:
        label = label.when(contains_any(lowered, words), name)
    return label.otherwise(lx.DEFAULT_INTENT)


def formality(text: Column, lowered: Column | None = None) -> Column:
    lowered = F.lower(text) if lowered is None else lowered
    return (
        F.when(contains_any(lowered, lx.FORMAL_STYLE), "formal")
        .when(contains_any(lowered, lx.CASUAL_STYLE), "casual")
        .otherwise("neutral")
    )


def tokens(text: Column) -> Column:
    """Lower-cased word tokens."""

    return F.regexp_extract_all(F.lower(text), F.lit(f"({lx.TOKEN})"), F.lit(1))


def explode_ngrams(df: DataFrame, text: str, n: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per word n-gram: kept columns, ``position`` and ``phrase``.

    The n shifted token lists are zipped and exploded, so a text of any length is
    read once and texts shorter than ``n`` words give no row.
    """

    words = df.select(*keep, tokens(F.col(text)).alias("__words"))
    starts = F.greatest(F.size("__words") - (n - 1), F.lit(0))
    shifted = [F.slice("__words", F.lit(i + 1), starts).alias(f"w{i}") for i in range(n)]
    # the outer form keeps the optimizer from testing the list for emptiness first,
    # which would tokenize every text once more
    rows = words.select(*keep, F.posexplode_outer(F.arrays_zip(*shifted)).alias("position", "__gram"))
    rows = rows.where(F.col("position").isNotNull())
    phrase = F.concat_ws(" ", *[F.col(f"__gram.w{i}") for i in range(n)])
    return rows.select(*keep, "position", phrase.alias("phrase"))


def add_readability(df: DataFrame, text: str, out: str) -> DataFrame:
    """Flesch reading ease; syllables are vowel groups. Null without words."""

    counted = df.withColumns(
        {
            "__words": F.regexp_count(F.col(text), F.lit(lx.TOKEN)),
            "__ends": F.greatest(F.regexp_count(F.col(text), F.lit(r"[.!?]+")), F.lit(1)),
            "__syllables": F.regexp_count(F.lower(F.col(text)), F.lit(r"[aeiouy]+")),
        }
    )
    per_sentence = F.col("__words") / F.col("__ends")
    per_word = F.col("__syllables") / F.col("__words")
    score = F.when(F.col("__words") > 0, 206.835 - 1.015 * per_sentence - 84.6 * per_word)
    return counted.withColumn(out, score).drop("__words", "__ends", "__syllables")
