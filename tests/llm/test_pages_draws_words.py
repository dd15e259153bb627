"""Page texts, importance draws and spelling variants against brute-force versions, on odd tables too."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from mailmine.llm.html_extract import extract_pages
from mailmine.llm.page_tree import Page
from mailmine.llm.resampling import ResampleParams, crc32_of, resample, weighted_median
from mailmine.llm.spelling import BitIndex, SpellingParams, group_spellings, near_words
from tests.llm.plain import ALNUM, key, lower
from tests.llm.test_operators import TABLES, check, frame

# --- pages


def article(words: str, before: str = "", after: str = "", name: str = "article") -> str:
    return f"<html><head><title>t</title></head><body>{before}<{name}>{words}</{name.split()[0]}>{after}</body></html>"


PROSE = "A sentence of the article that is long enough to matter. "
NAV = "<nav><ul><li><a href=/>Home</a><li><a href=/a>About</a></ul></nav>"

ONE_PAGE = [
    (article(f"<h1>Title</h1><p>{PROSE}</p><p>Tom &amp; Ann&nbsp;&lt;3</p>", NAV), f"Title\n{PROSE.strip()}\nTom & Ann <3"),
    (article(f"<p>{PROSE}<p>un<b>closed</b><br>tags"), f"{PROSE.strip()}\nunclosed tags"),
    (article(f"<p>{PROSE}</p>", '<div class="cookie-notice">We use cookies</div><header><h2>Site</h2></header>',
             f'<section id="comments"><article><p>{PROSE * 9}</p></article></section><footer>&copy;</footer>'), PROSE.strip()),
    (article(f"<p>{PROSE}</p><div class=ad>Buy</div><aside>Side</aside><script>x='<p>'</script><form><input><label>Mail</label></form><p>end</p>"),
     f"{PROSE.strip()}\nend"),
    (article(f"<header><h1>Head</h1></header><p>a <span class='ad'>buy</span> b</p><p>{PROSE}</p>"), f"Head\na b\n{PROSE.strip()}"),
    (f"<form id=aspnet><div id=page><main><p>{PROSE}</p></main></div></form>", PROSE.strip()),
    (f"<div><ul class=x><li><a>one</a><li><a>two</a><li><a>three</a></ul><p>{PROSE}</p><p>{PROSE}</p></div>", f"{PROSE.strip()}\n{PROSE.strip()}"),
    ("plain text", "plain text"), ("a < b &amp; c", "a < b & c"), ("<p title='a > b'>x</p>", "x"), ("", ""), (None, ""),
    ("<nav>menu</nav><script>alert(1)</script>", ""), ("<!-- <p>no</p> --><p>yes</p><!-- open", "yes"), ("<p>\t many\n  blanks   </p>", "many blanks"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<p>&notanentity; &#x1F600;&#0;</p>", "¬anentity; \U0001f600�"),
]


def test_single_pages(spark):
    rows = [(k, f"http://h{k}.example/", page, "x", 1) for k, (page, _) in enumerate(ONE_PAGE)]
    found = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string, host int")).collect()
    have = {r["page_id"]: (r["text"], r["n_chars"]) for r in found}
    for k, (_, want) in enumerate(ONE_PAGE):
        assert have[k] == (want, len(want)), ONE_PAGE[k]


def test_a_host_agrees_on_paths(spark):
    long_, short = "<p>" + PROSE * 5 + "</p>", "<p>Short one.</p>"
    boxed = lambda k, body, noise: f'<body><div class="p{k}"><div class="col-{k}">{body}</div><div class="box">{noise}</div></div></body>'
    rows = [(k, "https://Host.example:80/x", boxed(k, long_, short)) for k in range(20)]
    rows.append((50, "https://host.example/odd", boxed(50, short, long_)))       # its own best is the box
    rows.append((51, "https://other.example/odd", boxed(51, short, long_)))
    rows.append((52, None, boxed(52, short, long_)))
    rows.append((53, "https://host.example/else", f"<main>{short}</main>"))
    rows += [(60, "https://host.example/same", boxed(1, long_, short))] * 2
    found = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    text = {r["page_id"]: r["text"] for r in found}
    assert len(found) == len(rows)
    assert text[50] == "Short one." and text[3] == " ".join((PROSE * 5).split()) == text[51] == text[52] and text[53] == "Short one."
    assert {r["path"] for r in found if r["page_id"] in (3, 50)} == {"/body/div.p#/div.col-#"}


def test_pages_empty_table_and_join_by_host(spark):
    schema = "page_id long, url string, html string"
    assert extract_pages(spark.createDataFrame([], schema)).count() == 0
    rows = [(k, f"http://h{k % 3}.example/{k}", article(f"<p>{PROSE}{k}</p>", NAV)) for k in range(60)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(rows, schema)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == {k: f"{PROSE}{k}" for k in range(60)}


def test_hostile_pages_are_read_once():
    for piece in ('<a "', "<div>", '<p class="a', "<noscript>", "<script", "<b x='", "</div>", "<li><div>", "<span class=ad>", "<!--", "<a b=c d='", "&amp"):
        Page(piece * 20_000).text([])
    deep = Page("".join(f"<div class=c{chr(97 + k % 26)}><p>text {k}</p>" for k in range(5_000)))
    assert max(map(len, deep.key)) <= 300 and len(deep.text([])[0].split("\n")) >= 4_500


# --- draws


def drawn(docs: list[tuple], items: list[tuple], p: ResampleParams) -> list[tuple]:
    def features(text):
        w = ALNUM.findall(lower(text or ""))
        return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % p.buckets for n in range(1, p.ngram + 1) for i in range(len(w) - n + 1)]

    found = [(d, *features(t)) for d, t in docs]
    raw, target = Counter(b for _, _, f in found for b in f), Counter(b for _, t in items for b in features(t)[1])
    s_all, t_all = sum(raw.values()), sum(target.values())
    gain = {b: math.floor(1000 * math.log((target[b] + 1) * (s_all + p.buckets) / ((raw[b] + 1) * (t_all + p.buckets)))) for b in range(p.buckets)}
    rows = []
    for d, words, f in found:
        h = int(hashlib.sha256(f"{p.seed}:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    order = sorted((r for r in rows if r[4] >= p.min_words), key=lambda r: (-r[3], key(r[0]), r[1]))
    ranked = [(*r[:4], k + 1) for k, r in enumerate(order[:p.percent * len(order) // 100])]
    rest = Counter(r[:4] for r in rows) - Counter(r[:4] for r in ranked)
    return ranked + [(*r, None) for r in rest.elements()]


@pytest.mark.parametrize("docs", TABLES)
@pytest.mark.parametrize("params", [ResampleParams(finish_rows=1), ResampleParams(ngram=2, buckets=50, percent=60, min_words=3, finish_rows=4),
                                    ResampleParams(percent=100, min_words=0, finish_rows=1), ResampleParams(percent=0)])
def test_draws(spark, docs, params):
    items = [(1, docs[0][1] if docs else None), (2, "The quick Là word word"), (None, None)]
    have = resample(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), params)
    check(have, ["doc_id", "n_features", "weight", "score", "rank"], drawn(docs, items, params))


def test_draws_among_equal_rows(spark):
    docs = [(7, "one two three " * 9)] * 30 + [(k, "four five " * 12) for k in range(30)]
    params = ResampleParams(percent=50, finish_rows=1)
    have = resample(frame(spark, docs).repartition(5), spark.createDataFrame([], "item_id long, text string"), params)
    check(have, ["doc_id", "n_features", "weight", "score", "rank"], drawn(docs, [], params))


def test_checksums_of_ranges():
    r = np.random.default_rng(1)
    data = r.integers(0, 256, 5_000).astype(np.uint8)
    starts = r.integers(0, 4_000, 300)
    ends = starts + r.choice([0, 1, 2, 5, 9, 63, 64, 65, 900], 300)
    assert crc32_of(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
    assert len(crc32_of(data, starts[:0], ends[:0])) == 0


def test_weighted_median_leaves_a_quarter_on_either_side():
    r = random.Random(2)
    for _ in range(100):
        parts = [sorted((r.randrange(50), k, j, 0) for k in range(r.randint(1, 30))) for j in range(r.randint(1, 9))]
        rows = [x for p in parts for x in p]
        pivot = weighted_median([(p[(len(p) - 1) // 2], len(p)) for p in parts])
        assert 4 * sum(x <= pivot for x in rows) >= len(rows) and 4 * sum(x >= pivot for x in rows) >= len(rows)


# --- words


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def spellings(docs: list[tuple], p: SpellingParams) -> list[tuple]:
    words: Counter = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'null' if d is None else d}:{run}".encode())
            if p.drop_every and h % p.drop_every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            words[run] += 1
    n = {w: c for w, c in words.items() if len(w) >= p.min_chars and c >= p.min_count}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= p.form_factor * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


SPELLING = ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("docs", TABLES)
@pytest.mark.parametrize("params", [SpellingParams(), SpellingParams(2, 1, 5), SpellingParams(1, 1, 3, block_words=4)])
def test_spellings(spark, docs, params):
    check(group_spellings(frame(spark, docs), params), SPELLING, spellings(docs, params))


@pytest.mark.parametrize("block_words", [1 << 15, 7])
def test_spellings_of_dense_words(spark, block_words):
    r = random.Random(5)
    made = ["".join(r.choice("aabé") for _ in range(r.randint(4, 8))) for _ in range(400)]
    text = " ".join(w for k, w in enumerate(made) for _ in range(1 + 3 ** (k % 6)))
    docs = [(1, text), (None, text.upper()), (2, "x" * 3_000 + " " + "x" * 2_999), (3, "x" * 3_000), (1, text)]
    params = SpellingParams(min_count=1, block_words=block_words)
    check(group_spellings(frame(spark, docs), params), SPELLING, spellings(docs, params))


def test_chains_lead_to_one_root(spark):
    words = ["abcdef", "abcdeg", "abcdhg", "abcihg", "abjihg", "akjihg"]
    text = " ".join(w for k, w in enumerate(words) for _ in range(4 ** k))
    found = {r["word"]: r["root"] for r in group_spellings(frame(spark, [(1, text)]), SpellingParams(drop_every=0)).collect()}
    assert found == {w: "akjihg" for w in words[1:]}


def test_bit_index_finds_exactly_one_edit():
    r = random.Random(8)
    for _ in range(50):
        size = r.randint(1, 5)
        words = list({"".join(r.choice("ab") for _ in range(size + r.randint(0, 1))) for _ in range(20)})
        index = BitIndex(words, size)
        for query in words:
            want = [v for v in words if one_edit(query, v) and not (len(query) == len(v) == size + 1)]
            assert [w for k, w in enumerate(words) if index.near(query) >> k & 1] == want


def test_near_pairs_are_counted_once(spark):
    words = spark.createDataFrame([("aaaaaa", 1), ("aaaaa", 2), ("aaaab", 3), ("baaaa", 4), ("baaaaa", 5)], "word string, n long")
    found = {r["word"]: (r["n_near"], r["best"]) for r in near_words(words).collect()}
    assert found == {"aaaaaa": (2, "baaaaa"), "aaaaa": (4, "baaaaa"), "aaaab": (1, "aaaaa"), "baaaa": (2, "baaaaa"), "baaaaa": (3, "baaaa")}
