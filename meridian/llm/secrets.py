"""Secret scans: an Aho-Corasick keyword pass finds the few places worth a
look, anchored regular expressions run only there, and kinds that carry a
checksum must pass it.

Everything works on the UTF-8 bytes (all patterns are ASCII, so a byte match
is a code-point match); byte offsets become code-point offsets at the end.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, id_text

#: Order of kinds in lists of spans: the base kinds, then those validated by checksum.
KINDS = ("assign", "access", "hex", "github", "npm", "xkey")

_ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
_GITHUB = re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_NPM = re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_XKEY = re.compile(rb"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")

#: Keyword (lower case) -> kind; case is settled by the anchored expression.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "xprv": "xkey",
}
_BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_HEX_RUN = 24
#: Hex digits become "h", all else a space: a run of 24 is then a plain substring.
_TO_HEX = bytes(0x68 if c in b"0123456789abcdef" else 0x20 for c in range(256))
_automaton = None


def _keywords():
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            _automaton.add_word(word, (len(word), kind))
        _automaton.make_automaton()
    return _automaton


def base62_crc(body: bytes) -> bytes:
    """CRC-32 of ``body`` as six base-62 digits, the tail of a GitHub or npm token."""
    n, out = zlib.crc32(body), bytearray()
    for _ in range(6):
        n, digit = divmod(n, 62)
        out.append(_BASE62[digit])
    return bytes(reversed(out))


def base58_valid(word: bytes) -> bool:
    """Whether the last four of a Base58Check word's bytes are its double SHA-256."""
    n = 0
    for c in word:
        n = n * 58 + _BASE58.index(c)
    raw = n.to_bytes(max(5, (n.bit_length() + 7) // 8), "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def _anchored(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m.group(1)) >= 6
    if kind == "access":
        return m.end() - m.start() >= 20
    if kind in ("github", "npm"):
        return base62_crc(m.group(1)) == m.group(2)
    return base58_valid(m.group())


_PATTERNS = {"assign": _ASSIGN, "access": _ACCESS, "github": _GITHUB, "npm": _NPM, "xkey": _XKEY}


def find(text: bytes) -> list[tuple[int, int, str]]:
    """All spans ``(start, end, kind)`` of one text in code points, by start, then kind.

    Per kind, matches are leftmost and do not overlap; a match that fails its
    length or checksum is dropped but still consumes its characters.
    """
    found: list[tuple[int, int, str]] = []
    taken = dict.fromkeys(_PATTERNS, 0)
    # One byte is one character here, so positions are byte offsets.
    hits = [(end - n + 1, kind) for end, (n, kind) in _keywords().iter(text.lower().decode("latin-1"))]
    for start, kind in sorted(hits):
        if start >= taken[kind] and (m := _PATTERNS[kind].match(text, start)):
            taken[kind] = m.end()
            if _anchored(kind, m):
                found.append((start, m.end(), kind))
    run, at = b"h" * _HEX_RUN, 0
    marks = text.translate(_TO_HEX)
    while (at := marks.find(run, at)) >= 0:
        m = _HEX.match(text, at)
        found.append((at, m.end(), "hex"))
        at = m.end()
    if not found:
        return found
    found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    if text.isascii():
        return found
    out, seen, points = [], 0, 0
    for start, end, kind in found:
        points += _points(text, seen, start)
        seen = start
        out.append((points, points + _points(text, start, end), kind))
    return out


def _points(text: bytes, start: int, end: int) -> int:
    """Code points that begin in a stretch of UTF-8 bytes."""
    part = text[start:end]
    return len(part) - len(part.translate(None, _LEADS))


#: Bytes that begin a code point.
_LEADS = bytes(c for c in range(256) if not 0x80 <= c < 0xC0)

SPAN = "struct<start:int,end:int,kind:string>"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans``: the secrets of every text as an array of ``(start, end, kind)``.

    Null and empty texts have no spans; every input row gives one row.
    """
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "text"):
            spans = [[{"start": s, "end": e, "kind": k} for s, e, k in find(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return id_text(docs, doc_id, text).mapInArrow(run, f"doc_id long, spans array<{SPAN}>")


def redact(docs: DataFrame, text: str = "text", length: str | None = None, mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every secret replaced by ``mask``.

    Overlapping spans are replaced as one.  ``length`` names a column that
    holds the text's number of characters and is kept in step.  Null texts
    stay null.
    """
    fill = mask.encode()

    def clean(texts):
        import pandas as pd

        return pd.Series([None if t is None else _masked(t.encode("utf-8", "surrogatepass"), fill).decode("utf-8", "surrogatepass") for t in texts])

    cleaned = F.pandas_udf(clean, "string")(F.col(text))
    out = docs.withColumn(text, cleaned)
    return out.withColumn(length, F.length(text).cast(docs.schema[length].dataType)) if length else out


def _masked(raw: bytes, fill: bytes) -> bytes:
    spans = find(raw)
    if not spans:
        return raw
    text, out, at, upto = raw.decode("utf-8", "replace"), [], 0, 0
    for start, end, _ in spans:
        if start >= upto:
            out += [text[at:start], fill.decode()]
        upto = max(upto, end)
        at = upto
    return "".join([*out, text[at:]]).encode("utf-8", "replace")
