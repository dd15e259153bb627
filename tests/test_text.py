"""Text operators against plain re-statements of their rules, on many small texts."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from mailmine.functions import lexicon as lx
from mailmine.functions import placeholders as ph
from mailmine.functions import text as t
from mailmine.functions import tone as tn

PIECES = [
    "Hi Alex,", "dear Support", "  Hello", "Hey", "Best regards,", "thanks", "KIND REGARDS,", "Jamie", "Riley Doe",
    "> quoted", "From: a@b.com", "To: you", "Subject: x", "On Tue, Mar 5, 2024 at 10:00 AM, Bot wrote:", "--", "-- ",
    "--- Original Message ---", "Sent from my iPhone", "Get Outlook for iOS", "Disclaimer: none", "  ", "\t", "",
    "Pay $1,200.50 by Friday or 12/31/2024.", "See https://x.com/track?id=1 and http://plain.org/a", "[image: logo]",
    "please unsubscribe here now", "INV-00123 due by next week", "call +1 555-010-9999 today", "mail ops@acme.co.uk",
    "at Acme Widgets Inc on October 3, 2024", "é ünï code", "good morning team", "by EOD", " wide blank",
    "This email and any attachments is confidential", "yours truly", "talk soon", "word",
    "Could you review and ship out the invoice?", "we regret the issue with it", "thx btw, see the calendar",
    "any update? reschedule the call", "nice to meet you, thanks for joining", "payment received",
]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    seps = ["\n", "\n\n", " ", "\r\n", "\n\n\n\n", "\r"]
    out = [""]
    for _ in range(1500):
        text = ""
        for _ in range(rng.randint(1, 9)):
            text += rng.choice(PIECES) + rng.choice(seps)
        out.append(text)
    return out


def run(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    found = rows.select("i", column(F.col("t")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in found]


def agree(spark, texts, column, rule):
    have, want = run(spark, texts, column), [rule(x) for x in texts]
    wrong = [(x, h, w) for x, h, w in zip(texts, have, want) if h != w]
    assert not wrong, wrong[:2]
    assert len(set(map(str, want))) > 2  # not vacuous


def squeeze(text):
    text = re.sub("\r\n|\r", "\n", text)
    return re.sub("\n{3,}", "\n\n", re.sub("[ \t]+", " ", text)).strip()


def unquote(text):
    kept, after = [], False
    for line in text.split("\n"):
        if any(re.match(p, line.lower()) for p in lx.QUOTE_LINES):
            after = True
        elif not (after and not line.strip()):
            after = False
            kept.append(line)
    return "\n".join(kept)


def unsign(text):
    lines = text.split("\n")
    stop = [i for i, x in enumerate(lines) if any(re.search(p, x.strip().lower()) for p in lx.SIGNATURE_LINES)]
    return "\n".join(lines[: stop[0]] if stop else lines).rstrip()


def untrack(text):
    for pattern in lx.TRACKING_PATTERNS:
        text = re.sub(pattern, "", text, flags=re.I)
    return text


def greet(text):
    filled = [x.strip() for x in text.split("\n") if x.strip()]
    return filled[0] if filled and re.match(lx.GREETING_LINE, filled[0], re.I) else ""


def close(text):
    filled = [x.strip() for x in text.split("\n") if x.strip()][-6:]
    hits = [x for x in filled if any(re.search(p, x, re.I) for p in lx.CLOSING_LINES)]
    return hits[-1] if hits else ""


def generalise(text):
    for _, pattern, ignore, new in lx.PLACEHOLDER_RULES:
        text = re.sub(pattern, new, text, flags=re.I if ignore else 0)
    return text


def sign_off(text):
    found = re.search(lx.TEMPLATE_CLOSING, text, re.I)
    if not found:
        return text
    return text[: found.start()] + found.group(1).title() + ",\n{sender_name}" + text[found.end():]


def test_whitespace(spark, texts):
    agree(spark, texts, t.normalize_whitespace, squeeze)


def test_quotes(spark, texts):
    agree(spark, texts, t.remove_quoted_replies, unquote)


def test_signatures(spark, texts):
    agree(spark, texts, t.remove_signatures, unsign)


def test_tracking(spark, texts):
    agree(spark, texts, t.remove_tracking_text, untrack)


def test_cleaning_chain(spark, texts):
    agree(spark, texts, t.clean_body, lambda x: squeeze(untrack(unsign(unquote(squeeze(x))))))


def test_greeting_and_closing(spark, texts):
    agree(spark, texts, t.extract_greeting, greet)
    agree(spark, texts, t.extract_closing, close)
    agree(spark, texts, t.canonical_greeting, lambda x: x.replace(greet(x), lx.GREETING_TEXT, 1) if greet(x) else x)
    agree(spark, texts, t.canonical_closing, lambda x: x.replace(close(x), lx.CLOSING_TEXT, 1) if close(x) else x)


def test_features(spark, texts):
    agree(spark, texts, t.action_words, lambda x: sorted(w for w in lx.ACTION_WORDS if w in x.lower()))
    agree(spark, texts, t.placeholder_slots,
          lambda x: [s for s, ps in lx.PLACEHOLDER_SLOTS.items() if any(re.search(p, x, re.I) for p in ps)])
    agree(spark, texts, t.intent, lambda x: next(
        (n for n, ws in lx.INTENT_RULES if any(w in x.lower() for w in ws)), "general"))
    agree(spark, texts, t.formality, lambda x: "formal" if any(w in x.lower() for w in lx.FORMAL_STYLE) else
          "casual" if any(w in x.lower() for w in lx.CASUAL_STYLE) else "neutral")


def test_placeholders(spark, texts):
    agree(spark, texts, ph.placeholderize, generalise)
    agree(spark, texts, ph.greeting_template,
          lambda x: re.sub(lx.TEMPLATE_GREETING, lx.GREETING_TEXT, x, count=1, flags=re.I))
    agree(spark, texts, ph.closing_template, sign_off)


def test_combine(spark):
    cases = [(" a ", "b\n", "a\n\nb"), ("", " b", "b"), (None, None, ""), ("a", "  ", "a")]
    rows = spark.createDataFrame([(s, b) for s, b, _ in cases], "s string, b string").coalesce(1)
    assert [r[0] for r in rows.select(t.combine(F.col("s"), F.col("b"))).collect()] == [w for *_, w in cases]


def test_template_text(spark):
    text = "Hello Noor,\n\nThe fee of $75.20 is due by Sunday or by next Monday: https://fees.example.org/7\n\nRegards,\nToni"
    df = spark.createDataFrame([(text,)], "b string")
    out = ph.add_body_template(df, "b", "o").first()["o"]
    assert out == ("Hi {recipient_name},\n\nThe fee of {amount} is due by {date} or by next {date}: {link}\n\nRegards,\n{sender_name}")


def test_empty_subject(spark):
    df = spark.createDataFrame([("",), ("INV-1234 due",)], "s string").coalesce(1)
    assert [r[0] for r in df.select(ph.subject_template(F.col("s"))).collect()] == ["Regarding {topic}", "{invoice_no} due"]


def test_tone_ties_and_double_hits(spark):
    cases = {
        "plain words": ("neutral", "neutral"),
        "I am unhappy": ("neutral", "neutral"),  # contains "happy" as well
        "great, terrible and awful": ("negative", "neutral"),
        "urgent regret": ("neutral", "urgent"),  # equal scores: the earlier tone
        "please confirm, kindly": ("neutral", "request"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    out = {r["t"]: (r["s"], r["o"]) for r in tn.add_sentiment(df, "t", "s", "o").collect()}
    assert out == cases


def test_labels_are_filled_only_when_the_whole_column_is_missing(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (2, None, "formal", "x")], "i int, a string, b string, f string")
    rows = tn.fill_if_all_null(df, {"a": "f", "b": "f"}).orderBy("i").collect()
    assert [(r["a"], r["b"]) for r in rows] == [("x", None), ("x", "formal")]


def test_failing_scorer_falls_back(spark):
    def load():
        def score(texts):
            raise RuntimeError("no model")
        return score

    df = spark.createDataFrame([("this is great",)], "t string")
    row = tn.add_model_sentiment(df, "t", load).first()
    assert (row["sentiment"], row["confidence"]) == ("positive", None)
    assert tn.add_model_sentiment(df, "t", load, fault="fault").first()["fault"]


def test_ngrams_of_short_texts(spark):
    df = spark.createDataFrame([(1, "one two"), (2, ""), (3, "A b-c d")], "row_id long, t string")
    rows = t.explode_ngrams(df, "t", 3, keep=("row_id",)).orderBy("position").collect()
    assert [(r["row_id"], r["phrase"]) for r in rows] == [(3, "a b c"), (3, "b c d")]


def test_long_runs_are_read_once(spark):
    """Texts that once overflowed the matcher's stack or took quadratic time."""

    import time

    long = ["> q\n" + " \n" * 100_000 + "end", "a" + " " * 1_000_000 + "b" + " " * 1_000_000, "a." * 500_000, "x " * 300_000 + "\n" + " " * 300_000 + "y"]
    start = time.time()
    cleaned = run(spark, long, t.clean_body)
    assert cleaned[0] == "end" and cleaned[1] == "a b" and cleaned[2] == long[2]
    assert run(spark, long, ph.placeholderize)[2] == long[2]
    assert run(spark, long, t.extract_closing) == [""] * 4
    assert run(spark, long, lambda c: t.strip(t.combine(c, c)))[1].startswith("a")
    assert time.time() - start < 25


def test_email_rule_equals_the_fixed_pattern(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice("ab.-_@ é\n") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    pattern, ignore, replacement = ph.RULES["email"]
    assert run(spark, texts, lambda c: ph.apply_rule(c, "email")) == run(spark, texts, lambda c: t.substitute(c, pattern, replacement, ignore))


def test_a_text_is_lower_cased_once_for_all_marker_sets(spark):
    rows = spark.createDataFrame([("URGENT: thanks, we regret the delay",), (None,)], "text string")
    scored = tn.add_scores(rows, "text")
    assert str(scored._jdf.queryExecution().optimizedPlan()).count("lower(") == 1
    assert scored.columns[0] == "text" and "__lowered" not in scored.columns
    found = scored.collect()
    assert (found[0]["score_urgent"], found[0]["score_positive"], found[0]["score_apologetic"]) == (1, 1, 1)
    assert found[1]["score_urgent"] is None


def test_closing_template_after_characters_beyond_the_first_plane(spark):
    rows = [("Hi \U0001f600\U0001f600\n\nbest regards,\n\nBob Smith\nregards,\nAnn",), ("thanks\nBob",), ("no closing",), ("",), (None,)]
    texts = spark.createDataFrame(rows, "text string")
    found = [r[0] for r in texts.select(ph.closing_template(F.col("text"))).collect()]
    assert found == ["Hi \U0001f600\U0001f600\n\nBest Regards,\n{sender_name}\nregards,\nAnn", "Thanks,\n{sender_name}", "no closing", "", None]


def test_mails_of_a_large_table_are_dealt_over_many_tasks(spark, monkeypatch):
    from mailmine.catalog import tables as tb

    rows = spark.range(1000).withColumn("k", F.col("id") % 2)
    assert tb.dealt(rows, 1000, "id").rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    monkeypatch.setattr(tb, "MAIL_ROWS", 20)
    spread = tb.dealt(rows.join(rows.groupBy("k").count(), "k"), 1000, "id")
    sizes = [r["n"] for r in spread.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 60 and spread.rdd.getNumPartitions() == 50
