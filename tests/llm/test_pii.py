import hashlib
import random
import re
import time

import pytest

pytest.importorskip("kindred.llm")
from kindred.llm import pii, queries  # noqa: E402

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, found):
    digits = [int(c) for c in found if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return True


def plain_spans(text):
    found = [(m.start(), kind, m.end()) for kind, p in PLAIN.items() for m in re.finditer(p, text or "") if passes(kind, m[0])]
    return sorted(found, key=lambda s: (s[0], list(PLAIN).index(s[1])))


def base(text):
    return [s for s in pii.find_spans(text) if s[1] in pii.BASE_KINDS]


def test_base_spans_equal_the_plain_patterns_on_hostile_strings():
    rng = random.Random(7)
    alphabets = ["a1.@-", "0123456789. -", "+()0123456789 .-", "a@b.c%+_-1", "12.5 -", "4é1 .@+"]
    cards = ["4111 1111 1111 1111", "5500-0000-0000-0004", "340000000000009", "10.0.0.1", "999.1.1.1", "+49 (30) 1234-5678", "x.y@mail.example.org"]
    for trial in range(6000):
        letters = alphabets[trial % len(alphabets)]
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        if trial % 3 == 0:
            text = text[:20] + rng.choice(cards) + text[20:]
        assert base(text) == plain_spans(text), text


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("see https://jo:pw@host.example.org:8080/x", "login", "https://jo:pw@host.example.org:8080"),
        ("git+ssh://git@[::1]/r", "login", "git+ssh://git@[::1]"),
        ("IBAN: DE89 3704 0044 0532 0130 00 please", "iban", "DE89 3704 0044 0532 0130 00"),
        ("iban gb82WEST12345698765432.", "iban", "gb82WEST12345698765432"),
        ("SSN 078-05-1120", "ssn", "078-05-1120"),
        ("Social Security number: 219-09-9999!", "ssn", "219-09-9999"),
        ("account no. 12345678", "account", "12345678"),
        ("Konto: 0012 3456 78", "account", "0012 3456 78"),
    ],
)
def test_cues_and_schemes_are_expanded(text, kind, found):
    start = text.index(found)
    assert (start, kind, start + len(found)) in pii.find_spans(text)


@pytest.mark.parametrize(
    "text",
    ["https://host.example.org/a@b", "IBAN DE88 3704 0044 0532 0130 00", "SSN 000-12-3456", "SSN 078-05-11201", "account 12345", "accountant 12345678", "078-05-1120"],
)
def test_what_fails_its_check_is_not_reported(text):
    assert [s for s in pii.find_spans(text) if s[1] not in pii.BASE_KINDS] == []


@pytest.mark.parametrize("piece", ["a", "1", "1.", "+1", "a@", "://a", "1 ", "+1 (", "iban DE89", "account 1", "a@b.c", "://a:"])
def test_work_is_linear(piece):
    def seconds(n):
        text, best = piece * (n // len(piece)), []
        for _ in range(3):
            start = time.perf_counter()
            pii.find_spans(text)
            best.append(time.perf_counter() - start)
        return min(best)

    small, large = seconds(50_000), seconds(400_000)
    assert large < 20 * small + 0.05


def test_query_equals_the_plain_patterns(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op13_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_spans(texts[r.doc_id])
        count = [sum(k == kind for _, k, _ in want) for kind in PLAIN]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == count
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
    assert any(r.n_email for r in rows)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (1, "a@b.c", "z"), (1, "a@b.c", "z"), (None, "é" * 200_000 + "a@b.c", None)], "doc_id long, text string, spans string")
    rows = pii.scan(df).collect()
    assert [[(s.kind, s.start, s.end) for s in r.spans] for r in rows] == [[], [], [("email", 0, 5)], [("email", 0, 5)], [("email", 200_000, 200_005)]]
    assert pii.scan(df.where("false")).count() == 0
