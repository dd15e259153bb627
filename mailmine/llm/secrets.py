"""Secret scan with structural confirmation.

Base patterns report assignments, access key names and long hex runs. Beyond them, every
base64 (either alphabet) or hex candidate, over wrapped and escaped line ends, is decoded and
reported only if its content has the structure of a key: nested DER lengths that add up, a PEM
body that decodes to DER, the length-prefixed strings of an SSH key, or a signed token whose
header is JSON with an algorithm. A candidate begins where a line of its run begins and ends
where a line ends, so text before or behind a wrapped key does not hide it.

Defined results: a null or empty text has no span; repeated rows are scanned each by itself;
further columns are ignored. Offsets are code points, ends are exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from mailmine.llm.tables import carried, carrying, documents, prepare

# fixed patterns of the base kinds, with the least length of what must be long enough
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16

# candidates of the method; each is decoded before it is reported. What is sought begins with fixed bytes
# (a DER sequence, an armour line, the length of a key kind, a private key's name), so only runs that begin
# with their base64 or hex form need decoding. Runs go on over line ends, real or escaped.
BREAK = r"(?:(?:\\r)?\\n|\r?\n)[\x20\t]*+"
ARMOUR = r"-----BEGIN ([A-Z0-9 ]{1,40})-----((?:[A-Za-z0-9+/=\s]|\\[rnt])*+)-----END \1-----"
PEM = re.compile(ARMOUR)
JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+")
HEAD64 = r"(?:M[A-P]|LS0tLS1CRUdJTi|AAAA[A-H]|b3BlbnNzaC1rZXkt)"
RUN64 = re.compile(rf"(?<![A-Za-z0-9+/]){HEAD64}[A-Za-z0-9+/_-]{{18,}}+(?:{BREAK}[A-Za-z0-9+/_-]++)*+={{0,2}}")
PIECE64 = re.compile(r"(?:(?<=\\n)|(?<!\\))[A-Za-z0-9+/_-]++")
HEAD16 = r"(?:30|2[dD]2[dD]2[dD]2[dD]2[dD]|000000|6[fF]70656[eE]737368)"
RUN16 = re.compile(rf"(?<![0-9A-Fa-f]){HEAD16}[0-9A-Fa-f]{{30,}}+(?:{BREAK}[0-9A-Fa-f]++)*+(?![0-9A-Fa-f])")
PIECE16 = re.compile(r"[0-9A-Fa-f]++")
BEGINS64, BEGINS16 = re.compile(HEAD64), re.compile(HEAD16)
LEAST = 30     # bytes of a key outside an armour
SSH_PARTS = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2}     # strings of a public key, by its kind
OPENSSH = b"openssh-key-v1\0"


ESCAPED = re.compile(r"\\[rnt]")


def unbase64(body: str) -> bytes | None:
    """The decoded bytes, or None; padding may be missing, line ends may be escaped, both alphabets will do."""

    body = "".join(ESCAPED.sub("", body).split()).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_nested(data: bytes, depth: int = 6) -> bool:
    """A DER sequence that fills ``data`` exactly and whose parts' lengths add up at every level."""

    part = _der_part(data, 0)
    if part is None or part[0] != 0x30 or part[2] != len(data):
        return False
    at, end, parts = part[1], part[2], 0
    while at < end:
        inner = _der_part(data, at)
        if inner is None or inner[2] > end:
            return False
        if inner[0] == 0x30 and depth and not der_nested(data[at:inner[2]], depth - 1):
            return False
        at, parts = inner[2], parts + 1
    return parts >= 1


def _der_part(data: bytes, at: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the content at ``at``."""

    if at + 2 > len(data):
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size == 0x80 or size > 0x84:
        return None
    if size > 0x80:
        n = size - 0x80
        size, at = int.from_bytes(data[at:at + n], "big"), at + n
    return (tag, at, at + size) if at + size <= len(data) else None


def ssh_strings(data: bytes) -> bool:
    """Length-prefixed strings that fill ``data``, the first of them a key kind."""

    at, parts = 0, []
    while at < len(data):
        size = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + size > len(data):
            return False
        parts.append(data[at + 4:at + 4 + size])
        at += 4 + size
    return len(parts) >= 2 and parts[0].startswith((b"ssh-", b"ecdsa-", b"sk-"))


def jwt_header(token: str) -> bool:
    """A signed token: the header is JSON with a text ``alg``, the payload is a JSON object."""

    head, payload, _ = token.split(".")
    try:
        parsed = [json.loads(unbase64(x.replace("-", "+").replace("_", "/")) or b"") for x in (head, payload)]
    except (ValueError, RecursionError):
        return False
    return all(isinstance(x, dict) for x in parsed) and isinstance(parsed[0].get("alg"), str)


def armoured(text: str, m: re.Match) -> bool:
    data = unbase64(m[2])
    return bool(data) and (der_nested(data) or openssh_private(data))


def openssh_private(data: bytes) -> bool:
    """The name, three strings, the number of keys, and a string for each public and the private part, to the end."""

    if not data.startswith(OPENSSH):
        return False
    at, left, known = len(OPENSSH), 3, False
    while left:
        size = int.from_bytes(data[at:at + 4], "big")
        at, left = at + 4 + size, left - 1
        if at > len(data):
            return False
        if not left and not known:
            left, at, known = int.from_bytes(data[at:at + 4], "big") + 1, at + 4, True
    return at <= len(data)


def claim(head: bytes, more: int) -> int | None:
    """How many of the ``more`` bytes that begin with ``head`` its kind of key would take; None if it is no key."""

    if head[0] == 0x30:
        size, at = head[1], 2
        if size > 0x80:
            size, at = int.from_bytes(head[2:2 + size - 0x80], "big"), 2 + size - 0x80
        return at + size if head[1] != 0x80 and head[1] <= 0x84 and LEAST <= at + size <= more else None
    known = head.startswith((b"-----BEGIN ", OPENSSH)) or (head[:3] == b"\0\0\0" and head[4:].startswith((b"ssh-", b"ecdsa-", b"sk-")))
    return more if known and more >= LEAST else None


def structure(data: bytes) -> tuple[str, int] | None:
    """Kind and size of the key that ``data`` begins with."""

    if data.startswith(b"-----BEGIN "):
        text = data.decode("latin-1")
        m = PEM.match(text)
        return ("pem", len(data) - len(text[m.end():].lstrip())) if m and armoured(text, m) else None
    if data.startswith(OPENSSH):
        return ("ssh", len(data)) if openssh_private(data) else None
    if data[0] == 0x30:
        return ("der", len(data)) if der_nested(data) else None
    kind = data[4:4 + data[3]]
    at, strings = 0, SSH_PARTS.get(kind, 3 if kind.startswith(b"ecdsa-") else 0)
    for _ in range(strings):
        at += 4 + int.from_bytes(data[at:at + 4], "big")
    at = at if LEAST <= at <= len(data) else len(data)
    return ("ssh", at) if ssh_strings(data[:at]) else None


def _in_run(run: re.Match, pieces: re.Pattern, begins: re.Pattern, chars: int, decode) -> list[tuple[str, int, int]]:
    """Keys that begin with a line of the run and end with a line; three bytes take ``chars`` characters."""

    text = run.string
    lines = [m.span() for m in pieces.finditer(text, *run.span())]
    body = "".join(text[a:b] for a, b in lines)
    starts = [0, *accumulate(b - a for a, b in lines)]
    line_of = {n: k for k, n in enumerate(starts)}
    out, k = [], 0
    while k < len(lines):
        at, first, k = starts[k], lines[k][0], k + 1
        head = decode(body[at:at + 64]) if begins.match(body, at) else None
        need = claim(head, (len(body) - at) * 3 // chars) if head else None
        whole = decode(body[at:at - (-need * chars // 3)]) if need else None
        found = structure(whole) if whole else None
        end = line_of.get(at - (-found[1] * chars // 3)) if found else None
        if end:
            k, tail = end, lines[end - 1][1]
            while tail < run.end() and text[tail] == "=":
                tail += 1
            out.append((found[0], first, tail))
    return out


def _unhex(body: str) -> bytes | None:
    return bytes.fromhex(body[:len(body) // 2 * 2])


def confirmed(text: str) -> list[tuple[str, int, int]]:
    """Spans of the candidates whose decoded content has the structure of a key or token.

    Kinds name what was found inside: an armoured key in base64 or hex is ``pem`` as well."""

    out = []
    if "-----BEGIN " in text:
        out += [("pem", *m.span()) for m in PEM.finditer(text) if armoured(text, m)]
    if "eyJ" in text:
        out += [("jwt", *m.span()) for m in JWT.finditer(text) if jwt_header(m[0])]
    for m in RUN64.finditer(text):
        out += _in_run(m, PIECE64, BEGINS64, 4, unbase64)
    for m in RUN16.finditer(text):
        out += _in_run(m, PIECE16, BEGINS16, 6, _unhex)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, leftmost and non-overlapping per kind, long enough."""

    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    # runs are maximal, so asking for the length in the pattern finds the same matches faster
    out += [("hex", *m.span()) for m in HEX_LONG.finditer(text)]
    return out


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every reported span, overlaps joined, replaced by a mark."""

    out, at = [], 0
    for kind, start, end in in_order(spans):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, redacted string"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for value in batch.column("text"):
            text = value.as_py() or ""
            base = in_order(base_spans(text))
            spans = in_order(base + confirmed(text))
            counts = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans),
                         redact(text, spans) if spans else None))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.int64()] * 3 + [pa.string()] * 3
        rest = [c for c in batch.schema.names if c == "carry"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)),
                                          *(batch.column(c) for c in rest)], names=[*NAMES, *rest])


def scan_secrets(docs: DataFrame, carry: bool = False) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, all spans, and the redacted
    text where there is a span (``redacted``, else null). One narrow pass. With ``carry`` the input row
    comes along as a struct of that name."""

    prepare(docs.sparkSession)
    rows = carrying(docs) if carry else documents(docs)
    return rows.mapInArrow(_scan, carried(rows, SCHEMA))
