"""Secret scan with structural confirmation.

Three base patterns (assigned values, access ids, long hex runs) are always reported.  Beyond them,
runs of base64 or hex are decoded, also joined over line breaks where lines have one width but for the
first and the last, and one is reported only when its bytes have the structure of a key or token: nested DER lengths that close exactly around integers or an algorithm id, an SSH key's
length-prefixed fields, a signed token whose header names an algorithm, an armoured private key
whose body is such a key, or a UTF-8 text of printable characters and white space that itself holds a
secret.

Positions are code points, the end exclusive.  Defined results: a null or empty text has no spans;
spans of different kinds may overlap and are all kept, in order of start and then of kind; rows that
repeat are scanned each by itself; other columns pass through, and an output column replaces an
input column of its name.  Work per text is linear in its length but for nested decoding, which is
bounded by depth.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The base patterns, their least lengths, and the order in which kinds are listed.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "token", "armour", "der", "ssh", "encoded")
NAMES = ("passw", "secret", "token", "api")

SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
ARMOUR = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----([A-Za-z0-9+/=\s]*)-----END \1-----")
#: Runs that may be encoded bytes: at least 24 characters, which is 12 bytes of hex or 18 of base64.
ENCODED = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
#: Such a run with what follows it line by line, and its lines.  It begins where a run begins and gives
#: no character back, so a run that no line follows is read once.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+(?:[\x20\t]*+\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)+={0,2}")
LINE = re.compile(r"[^\s=]+={0,2}")
HEX_ONLY = re.compile(r"(?:[0-9a-f]{2})+|(?:[0-9A-F]{2})+")
SSH_NAMES = (b"ssh-rsa", b"ssh-ed25519", b"ssh-dss", b"ecdsa-sha2-")
DEPTH = 2
SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
)


def _unpack64(run: str) -> bytes | None:
    """Bytes of base64 in either alphabet, padded or not; None if it isn't canonical."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der_items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, from, to) of the items that fill data[start:end] exactly; None if lengths don't close."""
    items = []
    while start < end:
        if start + 2 > end:
            return None
        tag, length = data[start], data[start + 1]
        start += 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or start + n > end:
                return None
            length = int.from_bytes(data[start : start + n], "big")
            start += n
        if start + length > end:
            return None
        items.append((tag, start, start + length))
        start += length
    return items


def is_der_key(data: bytes) -> bool:
    """One sequence that closes at the end of the data and holds what keys hold.

    Those are a version and further integers or an octet string, or an algorithm (a sequence that
    begins with an object id) together with a bit or octet string.
    """
    if len(data) < 16 or data[0] != 0x30:
        return False
    outer = _der_items(data, 0, len(data))
    if not outer or len(outer) != 1:
        return False
    inner = _der_items(data, *outer[0][1:])
    if not inner or len(inner) < 2:
        return False
    tags = [tag for tag, _, _ in inner]
    algorithm = any(
        tag == 0x30 and (deep := _der_items(data, a, b)) is not None and deep and deep[0][0] == 0x06 for tag, a, b in inner
    )
    if algorithm and (0x03 in tags or 0x04 in tags):
        return True
    return tags[0] == 0x02 and (tags.count(0x02) >= 3 or 0x04 in tags[1:3])


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH container, or length-prefixed fields that close exactly and begin with a key type."""
    if data.startswith(b"openssh-key-v1\0"):
        return True
    fields, at = [], 0
    while at < len(data):
        if at + 4 > len(data):
            return False
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if at + n > len(data):
            return False
        fields.append(data[at : at + n])
        at += n
    return len(fields) >= 2 and fields[0].startswith(SSH_NAMES)


def _is_token_header(part: str) -> bool:
    data = _unpack64(part)
    try:
        header = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def _confirm(data: bytes, depth: int) -> str | None:
    if is_der_key(data):
        return "der"
    if is_ssh_key(data):
        return "ssh"
    if depth:
        try:
            inside = data.decode("utf-8")
        except UnicodeDecodeError:
            return None
        if "".join(inside.split()).isprintable() and find_spans(inside, depth - 1):
            return "encoded"
    return None


def _encoded_kind(run: str, depth: int) -> str | None:
    """The kind of a run by what it decodes to; None if that is no secret."""
    readings = [bytes.fromhex(run)] if HEX_ONLY.fullmatch(run) else []
    if (data := _unpack64(run)) is not None:
        readings.append(data)
    return next((k for data in readings if (k := _confirm(data, depth))), None)


def _wrapped(text: str, depth: int) -> list[tuple[int, str, int]]:
    """Spans of runs over several lines; each line is decoded in at most five joins."""
    found = []
    for m in WRAPPED.finditer(text):
        lines = [(m.start() + x.start(), x[0]) for x in LINE.finditer(m[0])]
        first = 0
        while first + 1 < len(lines):
            width, last = len(lines[first + 1][1]), first + 2
            while last < len(lines) and len(lines[last][1]) == width:
                last += 1
            ends = [last + 1, last] if last < len(lines) and len(lines[last][1]) < width else [last]
            following = last
            tried = [(a, b, "".join(x for _, x in lines[a:b])) for a in (first, first + 1) for b in ends if b - a > 1]
            # A word on the line below makes no whole group of four; such joins come after all others.
            for a, b, run in sorted([*tried, (first, first + 1, lines[first][1])], key=lambda x: len(x[2]) % 4 != 0):
                if kind := _encoded_kind(run, depth):
                    found.append((lines[a][0], kind, lines[b - 1][0] + len(lines[b - 1][1])))
                    following = b
                    break
            first = following
    return found


def find_spans(text: str | None, depth: int = DEPTH) -> list[tuple[int, str, int]]:
    """All spans of a text, in order of start and then of kind."""
    if not text:
        return []
    found: list[tuple[int, str, int]] = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    if "eyJ" in text:
        found += [(m.start(), "token", m.end()) for m in SIGNED.finditer(text) if _is_token_header(m[1])]
    if "-----BEGIN " in text:
        for m in ARMOUR.finditer(text):
            data = _unpack64("".join(m[2].split()))
            if data and (is_der_key(data) or is_ssh_key(data)):
                found.append((m.start(), "armour", m.end()))
    for m in ENCODED.finditer(text):
        if kind := _encoded_kind(m[0], depth):
            found.append((m.start(), kind, m.end()))
    found += _wrapped(text, depth)
    return sorted(set(found), key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def mask(text: str | None, spans: list[tuple[int, str, int]]) -> str | None:
    """The text with each stretch that spans cover replaced by a fixed word."""
    if not spans:
        return text
    out, at = [], 0
    start, end = spans[0][0], spans[0][2]
    for a, _, b in [*spans[1:], (len(text) + 1, "", 0)]:
        if a < end:
            end = max(end, b)
            continue
        out += [text[at:start], "[secret]"]
        at, start, end = end, a, b
    return "".join([*out, text[at:]])


@F.pandas_udf(SPANS)
def _spans(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": a, "end": b} for a, k, b in find_spans(t)] for t in texts], dtype=object)


@F.pandas_udf(T.StringType())
def _masked(texts: pd.Series) -> pd.Series:
    return pd.Series([mask(t, find_spans(t)) for t in texts], dtype=object)


def scan(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Add an array of (kind, start, end) per row."""
    return df.withColumn(spans, _spans(F.col(text)))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace every reported stretch in the text column; a null text stays null."""
    return df.withColumn(text, _masked(F.col(text)))


def listed(spans: str | Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    spans = F.col(spans) if isinstance(spans, str) else spans
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(spans: str | Column, *kinds: str) -> Column:
    spans = F.col(spans) if isinstance(spans, str) else spans
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
