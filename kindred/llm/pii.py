"""Personal data by anchor expansion.

One pass of an Aho-Corasick automaton over a text finds anchors: at-signs, plus signs before a digit,
digit pairs that are joined as in dotted addresses or grouped numbers, ``://`` and cue words of accounts.
A deterministic local parser expands each anchor to the left and right and validates what it finds.
Stretches that an earlier anchor of the same kind has covered are not parsed again, so the work is linear.

Kinds of the base (email, ip, card, phone) follow their patterns, leftmost and non-overlapping; a
stretch that fails its check is consumed all the same.  Further kinds: ``login`` (scheme, user and host),
``iban`` (cue, country, check digits modulo 97), ``ssn`` (cue, three groups of an allowed range) and
``account`` (cue, 6 to 17 digits).  These report the identifier without its cue.

Positions are code points, the end exclusive.  Defined results: a null or empty text has no spans; spans of
different kinds may overlap and are all kept, in order of start and then of kind; repeated rows are
scanned each by itself; other columns pass through, and an output column replaces one of its name.
"""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "login", "iban", "ssn", "account")
SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
)

#: Characters of the base patterns, limits and cue words.
DIGITS = "0123456789"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LOCAL_PART = frozenset(LETTERS + DIGITS + "._%+-")
HOST = frozenset(LETTERS + DIGITS + "-")
CARD_DIGITS, PHONE_DIGITS, ACCOUNT_DIGITS, IBAN_CHARS = (12, 19), (9, 15), (6, 17), (15, 34)
CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account", "konto": "account", "compte": "account", "cuenta": "account"}

NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
CALL = re.compile(r"\+[0-9][ ().0-9-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
USER_HOST = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=-]+(?::[^\s/?#@<>\"]*)?@(?:[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*|\[[0-9A-Fa-f:.]+\])(?::[0-9]{1,5})?")
#: What may stand between a cue and its identifier.
LINK = r"(?: ?(?:number|no\.?|nr\.?|num\.?|n°|#))?[ \t]*[:=#]?[ \t]*"
IBAN = re.compile(LINK + r"([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])", re.IGNORECASE | re.ASCII)
SSN = re.compile(LINK + r"([0-9]{3})[- ]([0-9]{2})[- ]([0-9]{4})(?![0-9-])", re.IGNORECASE)
ACCOUNT = re.compile(LINK + r"([0-9](?:[ -]?[0-9]){5,16})(?![0-9])", re.IGNORECASE)


@cache
def automaton():
    """Anchors of all kinds; built once in each worker."""
    import ahocorasick

    found = ahocorasick.Automaton()
    anchors = {"@": "email", "://": "login"}
    for a in DIGITS:
        anchors[f"+{a}"] = "phone"
        for b in DIGITS:
            anchors |= {f"{a}.{b}": "ip", f"{a}{b}": "card", f"{a} {b}": "card", f"{a}-{b}": "card"}
    for anchor, kind in anchors.items():
        found.add_word(anchor, (kind, len(anchor)))
    for cue, kind in CUES.items():
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _between(n: int, limits: tuple[int, int]) -> bool:
    return limits[0] <= n <= limits[1]


def _digits(stretch: str) -> str:
    return "".join(c for c in stretch if c in DIGITS)


def _number_start(text: str, at: int, free: int, joins: str) -> int:
    """The first digit of the digits, joined by single marks, in which the digit at ``at`` stands."""
    while at > free:
        if text[at - 1] in DIGITS:
            at -= 1
        elif at - 1 > free and text[at - 1] in joins and text[at - 2] in DIGITS:
            at -= 2
        else:
            break
    return at


def _email(text: str, at: int, free: int):
    start = at
    while start > free and text[start - 1] in LOCAL_PART:
        start -= 1
    m = DOMAIN.match(text, at + 1) if start < at else None
    return (m.end(), [(start, m.end())]) if m else (at + 1, [])


def _ip(text: str, at: int, free: int):
    m = DOTTED.match(text, _number_start(text, at, free, "."))
    parts, found, start = m[0].split("."), [], m.start()
    for k in range(0, len(parts) - 3, 4):
        end = start + sum(map(len, parts[k : k + 4])) + 3
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[k : k + 4]):
            found.append((start, end))
        start = end + 1
    return m.end(), found


def _card(text: str, at: int, free: int):
    m = NUMBER.match(text, _number_start(text, at, free, " -"))
    digits = _digits(m[0])
    return m.end(), [m.span()] if _between(len(digits), CARD_DIGITS) and luhn(digits) else []


def _phone(text: str, at: int, free: int):
    m = CALL.match(text, at)
    if not m:
        return at + 1, []
    end = m.end()
    while text[end - 1] not in DIGITS:
        end -= 1
    if end < at + 4:  # a plus sign, a digit, one mark or digit, a digit
        return at + 1, []
    return end, [(at, end)] if _between(len(_digits(text[at:end])), PHONE_DIGITS) else []


def _login(text: str, at: int, free: int):
    start = at
    while start > free and (text[start - 1] in HOST or text[start - 1] in "+."):
        start -= 1
    while start < at and text[start] not in LETTERS:
        start += 1
    m = USER_HOST.match(text, at + 3) if start < at else None
    return (m.end(), [(start, m.end())]) if m else (at + 3, [])


def _iban(text: str, at: int, free: int):
    m = IBAN.match(text, at)
    if not m:
        return at, []
    start, whole = m.start(1), m[1]
    # Words may follow in the same alphabet: the longest stretch that checks is the number.
    cuts = [len(whole), *[k for k in range(len(whole) - 1, 0, -1) if whole[k] == " "]]
    for cut in cuts:
        code = whole[:cut].replace(" ", "").upper()
        if _between(len(code), IBAN_CHARS) and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            return start + cut, [(start, start + cut)]
    return m.end(), []


def _ssn(text: str, at: int, free: int):
    m = SSN.match(text, at)
    if not m:
        return at, []
    area, group, serial = m[1], m[2], m[3]
    ok = area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
    return m.end(), [(m.start(1), m.end(3))] if ok else []


def _account(text: str, at: int, free: int):
    m = ACCOUNT.match(text, at)
    return (m.end(), [m.span(1)]) if m and _between(len(_digits(m[1])), ACCOUNT_DIGITS) else (at, [])


PARSERS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "login": _login, "iban": _iban, "ssn": _ssn, "account": _account}
#: Kinds whose parser starts behind the anchor, since the anchor is a cue.
CUED = frozenset(CUES.values())


def find_spans(text: str | None) -> list[tuple[int, str, int]]:
    """All spans of a text, in order of start and then of kind."""
    if not text:
        return []
    free = dict.fromkeys(KINDS, 0)  # per kind: where text begins that has not been parsed
    found = []
    for last, (kind, length) in automaton().iter(text):
        at = last + 1 if kind in CUED else last - length + 1
        if at < free[kind]:
            continue
        free[kind], spans = PARSERS[kind](text, at, free[kind])
        found += [(a, kind, b) for a, b in spans]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


@F.pandas_udf(SPANS)
def _spans(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": a, "end": b} for a, k, b in find_spans(t)] for t in texts], dtype=object)


def scan(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Add an array of (kind, start, end) per row."""
    return df.withColumn(spans, _spans(F.col(text)))


def listed(spans: str | Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    spans = F.col(spans) if isinstance(spans, str) else spans
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(spans: str | Column, *kinds: str) -> Column:
    spans = F.col(spans) if isinstance(spans, str) else spans
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
