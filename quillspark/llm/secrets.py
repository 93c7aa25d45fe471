"""Secret scan: a keyword automaton finds where to look, anchored expressions match there, embedded checksums decide."""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

#: In the order in which spans of one start are listed. The first three are the base kinds.
KINDS = ["assign", "access", "hex", "github", "npm", "jwt", "key_block"]

# Public formats of credentials.
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "api_key", "apikey"]
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
GITHUB_WORDS = ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"]
GITHUB = re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(rb"(eyJ[A-Za-z0-9_-]++)\.(eyJ[A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)")
KEY_BLOCK = re.compile(rb"-----BEGIN ((?:[A-Z0-9]++ )*)PRIVATE KEY-----\s([A-Za-z0-9+/=\s]++)-----END \1PRIVATE KEY-----")
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: Least lengths of the base kinds: of the value assigned, of the access key, of the run of hex digits.
LEAST = {"assign": 8, "access": 16, "hex": 32}

_HEX = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_AT_BLOCK = re.compile(rb"\x01{%d,}" % LEAST["hex"])


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in ASSIGN_WORDS:
        a.add_word(w, ("assign", len(w), w))
    a.add_word("akia", ("access", 4, "AKIA"))
    for w in GITHUB_WORDS:
        a.add_word(w, ("github", 4, w))
    a.add_word("npm_", ("npm", 4, "npm_"))
    a.add_word("eyj", ("jwt", 3, "eyJ"))
    a.add_word("-----begin", ("key_block", 10, "-----BEGIN"))
    a.make_automaton()
    return a


def checksum62(body: bytes) -> bytes:
    """The CRC-32 of a token's body as six base-62 digits."""
    n, out = zlib.crc32(body), b""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r : r + 1] + out
    return out


def _json(part: bytes) -> dict | None:
    try:
        x = json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4)))
    except (binascii.Error, ValueError):
        return None
    return x if isinstance(x, dict) else None


def _der(text: bytes) -> bool:
    """Whether a block decodes to a sequence whose embedded length fits its content."""
    try:
        raw = base64.b64decode(re.sub(rb"\s", b"", text), validate=True)
    except binascii.Error:
        return False
    if len(raw) < 4 or raw[0] != 0x30:
        return raw.startswith(b"openssh-key-v1\0")
    if raw[1] < 0x80:
        return len(raw) == 2 + raw[1]
    n = raw[1] & 0x7F
    return len(raw) == 2 + n + int.from_bytes(raw[2 : 2 + n])


def _holds(kind: str, m: re.Match) -> bool:
    """The checks after a match: lengths of base kinds, embedded checksums and structures of the others."""
    if kind == "assign":
        return len(m[2]) >= LEAST["assign"]
    if kind == "access":
        return len(m[0]) >= LEAST["access"]
    if kind in ("github", "npm"):
        return checksum62(m[1]) == m[2]
    if kind == "jwt":
        head = _json(m[1])
        return head is not None and "alg" in head and _json(m[2]) is not None
    return _der(m[2])


#: What a token that fails to match is a part of: none that begins later in the same run can match either.
RUNS = {"jwt": re.compile(rb"[A-Za-z0-9_-]++")}

EXPRESSIONS = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM, "jwt": JWT, "key_block": KEY_BLOCK}


def scan(text: bytes | None, automaton: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, sorted, of the secrets in a text.

    All expressions match ASCII alone, so bytes serve; case is folded for ASCII alone. A match
    takes up its stretch for its kind also where it then fails a check, as a scan from the left does.
    """
    if not text:
        return []
    found, past = [], dict.fromkeys(KINDS, 0)
    for last, (kind, n, word) in automaton.iter(text.lower().decode("latin-1")):
        at = last - n + 1
        if at < past[kind] or kind != "assign" and text[at : at + n] != word.encode():
            continue
        if m := EXPRESSIONS[kind].match(text, at):
            past[kind] = m.end()
            if _holds(kind, m):
                found.append((at, KINDS.index(kind), m.end()))
        elif kind in RUNS:
            past[kind] = RUNS[kind].match(text, at).end()
    if b"\x01" * LEAST["hex"] in (digits := text.translate(_HEX)):
        found += [(m.start(), KINDS.index("hex"), m.end()) for m in _AT_BLOCK.finditer(digits)]
    found.sort()
    if found and not text.isascii():
        point = {}
        at = n = 0
        for p in sorted({x for s, _, e in found for x in (s, e)}):
            n += sum((b & 0xC0) != 0x80 for b in text[at:p]) if p - at < 64 else len(text[at:p].decode("utf-8", "replace"))
            at = p
            point[p] = n
        found = [(point[s], k, point[e]) for s, k, e in found]
    return found


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row of ``docs(doc_id, text)``; spans is an array of (start, kind, end).

    Null and empty texts have no spans; texts are scanned whole, however long; repeated rows
    each get theirs; an empty table gives no rows. Other columns are not looked at.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for b in slices(batches):
            spans = [[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in scan(t, automaton)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(scanned, "doc_id long, spans array<struct<start: long, kind: string, end: long>>")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))
    counted = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(counted, KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
