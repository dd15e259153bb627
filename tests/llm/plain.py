"""Brute-force versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def key(doc_id: int | None) -> int:
    return 2**63 - 1 if doc_id is None else doc_id


def substrings(docs: list[tuple], window: int) -> list[tuple]:
    words = [WORD.findall(text or "") for _, text in docs]
    first: dict[tuple, tuple] = {}
    for (doc, _), w in zip(docs, words, strict=True):
        for p in range(len(w) - window + 1):
            k = tuple(w[p:p + window])
            first[k] = min(first.get(k, (key(doc), p)), (key(doc), p))
    out = []
    for (doc, _), w in zip(docs, words, strict=True):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < (key(doc), p):
                gone[p:p + window] = [True] * window
        out.append((doc, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def byte_strings(docs: list[tuple], size: int) -> list[tuple]:
    first: dict[bytes, int] = {}
    for doc, text in docs:
        b = (text or "").encode()
        for p in range(len(b) - size + 1):
            k = b[p:p + size]
            first[k] = min(first.get(k, key(doc)), key(doc))
    out = []
    for doc, text in docs:
        b = (text or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - size + 1):
            if first[b[p:p + size]] < key(doc):
                gone[p:p + size] = [True] * size
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def shingles(text: str | None, size: int) -> set[tuple]:
    w = WORD.findall(lower(text or ""))
    return {tuple(w[p:p + size]) for p in range(max(1, len(w) - size + 1))} if w else set()


def near(docs: list[tuple], size: int, percent: int) -> list[tuple]:
    sets = [shingles(text, size) for _, text in docs]
    label = [key(d) for d, _ in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= label[i] != label[j]
            label[i] = label[j] = low
    top = 2**63 - 1
    return [(d, len(s), None if c == top else c, key(d) == c) for (d, _), s, c in zip(docs, sets, label, strict=True)]


def contaminated(docs: list[tuple], items: list[tuple], window: int) -> list[tuple]:
    found = defaultdict(set)
    sizes = set()
    for item, text in items:
        w = ALNUM.findall(lower(text or ""))
        n = min(window, len(w))
        if n:
            sizes.add(n)
            for p in range(len(w) - n + 1):
                found[tuple(w[p:p + n])] |= {str(item)} - {"None"}
    out = []
    for doc, text in docs:
        w = ALNUM.findall(lower(text or ""))
        hit, names = [False] * len(w), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p:p + n])) in found:
                    names |= found[k]
                    hit[p:p + n] = [True] * n
        out.append((doc, len(w), sum(hit), len(names), sha(",".join(sorted(names))), any(hit)))
    return out


def rule_counts(docs: list[tuple]) -> list[tuple]:
    out = []
    for doc, text in docs:
        text = text or ""
        w = WORD.findall(text)
        windows = [tuple(w[p:p + 5]) for p in range(len(w) - 4)]
        often = Counter(windows)
        hit = [False] * len(w)
        for p, k in enumerate(windows):
            if often[k] > 1:
                hit[p:p + 5] = [True] * 5
        lines = [x for x in text.split("\n") if WORD.search(x)]
        out.append((doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(hit),
                    len(w) < 10 or 100 * sum(hit) > 20 * len(w)))
    return out
