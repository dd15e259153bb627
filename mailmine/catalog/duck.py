"""SQL fragments for the DuckDB side of the checks.

DuckDB's patterns are ASCII and know no look-around; the mail table is ASCII.
"""

from __future__ import annotations

from mailmine.catalog.tables import MAILS_CTE
from mailmine.functions import lexicon as lx


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def ws(x: str) -> str:
    x = rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"
    x = rf"regexp_replace({x}, '[ \t]+', ' ', 'g')"
    x = rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(x)


_BLANK = r"[ \t\r\f\v]"


def _line(pattern: str) -> str:
    return pattern.removeprefix("^").replace(r"\s", _BLANK)


def no_quotes(x: str) -> str:
    lines = [_line(p) for p in lx.QUOTE_LINES]
    lines = [p.removesuffix("$") if p.endswith("$") else p + ".*" for p in lines]
    pattern = rf"(?im)^(?:{'|'.join(lines)})\n(?:{_BLANK}*\n)*"
    return rf"regexp_replace(regexp_replace({x} || chr(10), {lit(pattern)}, '', 'g'), '\n$', '')"


def no_signature(x: str) -> str:
    hints = "|".join(_line(p.replace(r"^\s*", "^")) for p in lx.SIGNATURE_LINES)
    pattern = rf"(?im)^{_BLANK}*(?:{hints})(?s:.*)"
    return rf"regexp_replace(regexp_replace({x}, {lit(pattern)}, ''), '\s+$', '')"


def no_tracking(x: str) -> str:
    link, image, footer = lx.TRACKING_PATTERNS
    x = f"regexp_replace({x}, {lit(link)}, '', 'gi')"
    x = f"regexp_replace({x}, {lit(image)}, '', 'gi')"
    footer = footer.replace(".*$", r"[^\n]*(\n?)$")
    return rf"regexp_replace({x}, {lit(footer)}, '\1', 'gi')"


def clean(x: str) -> str:
    return ws(no_tracking(no_signature(no_quotes(ws(x)))))


def has_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def hits(x: str, words) -> str:
    return "(" + " + ".join(f"contains({x}, {lit(w)})::INT" for w in words) + ")"


def rlike(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)}, 'i')"


def greeting(x: str) -> str:
    first = rf"regexp_extract({x}, '^\s*([^\n]*[^\s])', 1)"
    return f"CASE WHEN {rlike(first, lx.GREETING_LINE)} THEN {first} ELSE '' END"


def closing(x: str) -> str:
    stripped = f"list_transform(string_split({x}, chr(10)), lambda v: {strip('v')})"
    filled = f"list_filter({stripped}, lambda v: v <> '')"
    tests = " OR ".join(rlike("v", p) for p in lx.CLOSING_LINES)
    return f"coalesce(list_filter(({filled})[-6:], lambda v: {tests})[-1], '')"


def intent(lowered: str) -> str:
    arms = " ".join(f"WHEN {has_any(lowered, words)} THEN {lit(n)}" for n, words in lx.INTENT_RULES)
    return f"CASE {arms} ELSE 'general' END"


def formality(lowered: str) -> str:
    return (
        f"CASE WHEN {has_any(lowered, lx.FORMAL_STYLE)} THEN 'formal' "
        f"WHEN {has_any(lowered, lx.CASUAL_STYLE)} THEN 'casual' ELSE 'neutral' END"
    )


def actions(lowered: str) -> str:
    words = ", ".join(
        f"CASE WHEN contains({lowered}, {lit(w)}) THEN {lit(w)} END" for w in lx.ACTION_WORDS
    )
    return f"array_to_string(list_sort(list_filter([{words}], lambda w: w IS NOT NULL)), ',')"


def slots(x: str) -> str:
    tests = ", ".join(
        f"CASE WHEN {' OR '.join(rlike(x, p) for p in ps)} THEN {lit(slot)} END"
        for slot, ps in lx.PLACEHOLDER_SLOTS.items()
    )
    return f"array_to_string(list_filter([{tests}], lambda w: w IS NOT NULL), ',')"


def sentiment(lowered: str) -> str:
    pos, neg = hits(lowered, lx.POSITIVE_WORDS), hits(lowered, lx.NEGATIVE_WORDS)
    return f"CASE WHEN {pos} > {neg} THEN 'positive' WHEN {neg} > {pos} THEN 'negative' ELSE 'neutral' END"


def tone(lowered: str) -> str:
    scores = ", ".join(hits(lowered, words) for words in lx.TONE_MARKERS.values())
    names = ", ".join(lit(n) for n in lx.TONE_MARKERS)
    return (
        f"CASE WHEN list_max([{scores}]) = 0 THEN 'neutral' "
        f"ELSE ([{names}])[list_position([{scores}], list_max([{scores}]))] END"
    )


def rule(x: str, name: str) -> str:
    for rule_name, pattern, ignore, text in lx.PLACEHOLDER_RULES:
        if rule_name == name:
            return f"regexp_replace({x}, {lit(pattern)}, {lit(text)}, 'g{'i' if ignore else ''}')"
    raise KeyError(name)


def placeholderize(x: str) -> str:
    for name, *_ in lx.PLACEHOLDER_RULES:
        x = rule(x, name)
    return x


def greeting_template(x: str) -> str:
    return f"regexp_replace({x}, {lit(lx.TEMPLATE_GREETING)}, {lit(lx.GREETING_TEXT)}, 'i')"


_CLOSINGS = ["best regards", "kind regards", "warm regards", "sincerely", "regards", "thanks",
             "thank you", "cheers"]


def closing_template(x: str) -> str:
    marked = rf"regexp_replace({x}, {lit(lx.TEMPLATE_CLOSING)}, chr(1) || '\1' || chr(2), 'i')"
    word = f"split_part(split_part({marked}, chr(1), 2), chr(2), 1)"
    arms = " ".join(
        f"WHEN {lit(c)} THEN {lit(' '.join(p.capitalize() for p in c.split()))}" for c in _CLOSINGS
    )
    return (
        f"CASE WHEN contains({marked}, chr(1)) THEN split_part({marked}, chr(1), 1) || "
        f"(CASE lower({word}) {arms} END) || ',' || chr(10) || {lit(lx.SENDER_TEXT)} || "
        f"split_part({marked}, chr(2), 2) ELSE {x} END"
    )


def names(x: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all({x}, {lit(lx.PLACEHOLDER_NAME)}, 1)))"


def targets(x: str) -> str:
    return (
        f"list_sort(list_distinct(list_concat(regexp_extract_all({x}, {lit(lx.PLACEHOLDER_NAME)}, 1), "
        "['recipient_name', 'sender_name'])))"
    )


def template_id(x: str) -> str:
    return f"'tmpl_' || substr(sha1({x}), 1, 10)"


# each step in a CTE of its own, so that no long expression is written twice
CLEANED_CTE = MAILS_CTE + f""", cleaned AS (
  SELECT * FROM (SELECT row_id, email_id, {strip("coalesce(subject, '')")} AS subject,
    {strip('body')} AS body, category, sentiment, tone, sender, recipient, created_at
    FROM mails WHERE body IS NOT NULL) WHERE length(body) > 0)"""

TEXTS_CTE = CLEANED_CTE + f""", stepped AS (
  SELECT *, {ws('subject')} AS clean_subject, {no_quotes(ws('body'))} AS unquoted FROM cleaned
), bodied AS (SELECT * EXCLUDE (unquoted), {ws(no_tracking(no_signature('unquoted')))} AS clean_body FROM stepped
), texts AS (SELECT *, CASE WHEN clean_subject <> '' AND clean_body <> ''
    THEN clean_subject || chr(10) || chr(10) || clean_body ELSE clean_subject || clean_body END AS combined_text
  FROM bodied)"""

PREPARED_CTE = TEXTS_CTE + f""", lowered AS (SELECT *, lower(combined_text) AS low FROM texts
), prepared AS (SELECT *, {intent('low')} AS intent, {formality('low')} AS formality,
    {greeting('combined_text')} AS greeting, {closing('combined_text')} AS closing,
    {sentiment('low')} AS found_sentiment, {tone('low')} AS found_tone FROM lowered)"""

BODY_TEMPLATE_CTE = """, ph1 AS (SELECT *, {ph} AS ph_text FROM {src}
), ph2 AS (SELECT *, {greet} AS ph_greeted FROM ph1
), ph3 AS (SELECT *, {close} AS ph_closed FROM ph2
), {name} AS (SELECT * EXCLUDE (ph_text, ph_greeted, ph_closed), {done} AS body_template FROM ph3)"""


def body_template_cte(src: str, name: str, body: str = "clean_body") -> str:
    return BODY_TEMPLATE_CTE.format(
        ph=placeholderize(body),
        src=src,
        greet=greeting_template("ph_text"),
        close=closing_template("ph_greeted"),
        name=name,
        done=ws("ph_closed"),
    )
