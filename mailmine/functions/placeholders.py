"""Turning the variable parts of a message into ``{placeholders}``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailmine.functions import lexicon as lx
from mailmine.functions.text import java, normalize_whitespace, substitute

RULES = {name: (pattern, ignore, text) for name, pattern, ignore, text in lx.PLACEHOLDER_RULES}


# the e-mail rule with the same matches, tried once per run of its characters
EMAIL_LINEAR = r"(?<![\w.-])([.-]*+)\b[\w\.-]++@[\w\.-]+\.\w+\b"


def apply_rule(text: Column, rule: str) -> Column:
    pattern, ignore_case, replacement = RULES[rule]
    if rule == "email":
        return substitute(text, EMAIL_LINEAR, "$1" + replacement)
    return substitute(text, pattern, replacement, ignore_case)


def placeholderize(text: Column) -> Column:
    """All rules in their order."""

    for rule in RULES:
        text = apply_rule(text, rule)
    return text


def greeting_template(text: Column) -> Column:
    """A greeting with a name at the start of the text becomes the recipient slot."""

    pattern = r"\A" + lx.TEMPLATE_GREETING.removeprefix("^")
    return substitute(text, pattern, lx.GREETING_TEXT, ignore_case=True)


def closing_template(text: Column) -> Column:
    """The first closing followed by a name becomes title-cased closing plus sender slot."""

    pattern = java(lx.TEMPLATE_CLOSING, ignore_case=True)

    def signed(parts: Column) -> Column:
        before, after = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        whole = F.substring(text, F.length(before) + 1, F.length(text) - F.length(before) - F.length(after))
        word = F.regexp_extract(whole, pattern, 1)
        return F.when(F.size(parts) < 2, text).otherwise(F.concat(before, F.initcap(word), F.lit(",\n" + lx.SENDER_TEXT), after))

    # the text is searched once: what stands before and after the first closing tells the rest
    around = F.array(F.split(text, pattern, 2))
    return F.when(text.isNotNull(), F.get(F.transform(around, signed), F.lit(0)))


def add_body_template(df: DataFrame, body: str, out: str) -> DataFrame:
    """Rules, greeting, closing, whitespace: one projection per step, each text used once."""

    df = df.withColumn(out, greeting_template(placeholderize(F.col(body))))
    return df.withColumn(out, normalize_whitespace(closing_template(F.col(out))))


def subject_template(subject: Column) -> Column:
    text = normalize_whitespace(placeholderize(subject))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(lx.SUBJECT_FALLBACK))


def placeholder_names(text: Column) -> Column:
    """Sorted distinct placeholder names in a template."""

    found = F.regexp_extract_all(text, F.lit(lx.PLACEHOLDER_NAME), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def placeholder_targets(text: Column) -> Column:
    """Placeholder names plus the two that are always listed."""

    always = F.array(*[F.lit(n) for n in lx.ALWAYS_LISTED])
    return F.array_sort(F.array_union(placeholder_names(text), always))


def template_id(body: Column) -> Column:
    return F.concat(F.lit("tmpl_"), F.substring(F.sha1(body), 1, 10))
