"""Hand-worked cases for every text expression."""

import time

import pytest
from pyspark.sql import functions as F

from kindred.functions import text as tx
from kindred.functions import wordlists as wl


def run(spark, expr, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def test_stop_words_are_complete():
    assert len(wl.STOP_WORDS) == 318 == len(set(wl.STOP_WORDS))


def test_footer_only_on_last_line(spark):
    got = run(
        spark, lambda c: tx.strip_footer(F.lower(c)),
        "a embed b\nlast 12EmbedShare", "x 3embed\n", "embed x\nkeep", "no footer", "a\r7embedz", "embedded tail",
    )
    assert got == ["a embed b\nlast ", "x \n", "embed x\nkeep", "no footer", "a\r", ""]


def test_brackets(spark):
    assert run(spark, tx.strip_brackets, "[] x [a] y", "[a\nb] z") == [" x  y", "[a\nb] z"]
    both = run(spark, lambda c: tx.strip_brackets(c, across_lines=True), "[] x [a] y", "[a\nb] z")
    assert both == ["[] x  y", " z"]


def test_punctuation_and_underscore(spark):
    got = run(spark, tx.strip_punctuation, "don't_stop — é!", "a\x1cb ‿ ²x")
    assert got == ["dontstop  é", "a\x1cb  ²x"]


def test_tokens(spark):
    got = run(spark, tx.split_tokens, "", "  a\x1cb\xa0c \n d ")
    assert got == [[], ["a", "b", "c", "d"]]
    assert run(spark, tx.token_count, "", "a b  c", " ") == [0, 3, 0]


def test_clean_chain(spark):
    got = run(spark, lambda c: tx.join_tokens(tx.clean_tokens(F.lower(c))), "I don't know [x] ME\n4EmbedX", "", "THE of")
    assert got == ["dont know", "", ""]


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("Élan, “vital” [Verse\n] 1\t2", "élan vital verse 1 2"),
        ("٣embed tail\n", ""),
        ("٣embed", ""),
        ("naïve_word it's x", "naïveword x"),
        ("ÇA va? [ok][] no", "ça va"),
        ("12Embed\nlast", "12embed"),
        ("ǅ ǆ ß straße", "ǆ ǆ ß straße"),
        ("á b", "á b"),
        ("x\x85y", "x y"),
        ("１２embed ok", ""),
        ("tail embed\r", "tail"),
    ],
)
def test_clean_text(spark, raw, clean):
    assert run(spark, lambda c: tx.join_tokens(tx.clean_tokens(F.lower(c))), raw) == [clean]


def test_metadata_patterns(spark):
    texts = ["label:x", "label: x", "a Producer.", "producers", "REMASTERed", "album:", "xalbum:y", "élabel:x", "PRODUCER", "d\u0130scogs", "rema\u017fter"]
    assert run(spark, lambda c: tx.has_wide_metadata(c, F.lower(c)), *texts) == [True, False, True, False, True, False, False, False, True, True, True]
    assert run(spark, lambda c: tx.has_narrow_metadata(c, F.lower(c)), "Deluxe Edition", "label:x") == [True, False]


def test_prose_patterns(spark):
    texts = ["he said, go", "he saidx", "semi-final", "(172p)", "Chapter 4", "chapter x", "feat. a", "feat a", "class of 1999"]
    assert run(spark, lambda c: tx.has_prose_signal(c, F.lower(c)), *texts) == [True, False, True, True, True, False, True, False, True]


def test_type_token_gate(spark):
    word = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    rich = " ".join(word(i) for i in range(100))
    exact = " ".join(word(i % 85) for i in range(100))
    short = " ".join(word(i) for i in range(99))
    late = " ".join(["a"] * 200 + [word(i) for i in range(5000)])
    assert run(spark, lambda c: tx.is_likely_lyrics(c, F.lower(c)), rich, exact, short, late) == [False, True, True, True]


def test_ratio_splits_its_text_once(spark):
    df = spark.range(1).select(tx.type_token_ratio(F.col("id").cast("string")).alias("ratio"))
    assert df._jdf.queryExecution().analyzed().toString().count("[^a-z]+") == 1
    words = [f"{'' if i else '-'}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)]
    texts = " ".join(words), "9, ".join(words + words) + "!", " ".join(words[:99]), ".", ""
    assert run(spark, tx.type_token_ratio, *texts) == [1.0, 150 / 200, None, None, None]


def test_space_is_trimmed_at_both_ends_only(spark):
    every = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"
    assert run(spark, tx.strip_space, every, f"{every}a{every}é{every}", "\u200bx ", "") == ["", f"a{every}é", "\u200bx", ""]


def test_words_and_bigrams(spark):
    got = run(spark, lambda c: tx.with_bigrams(tx.vector_words(F.split(c, " "))), "sun x moon", "sun", "")
    assert got == [["sun", "moon", "sun moon"], ["sun"], []]


@pytest.mark.parametrize(
    "raw, chorus",
    [
        ("[Chorus] la la\none", "one"),
        ("[Chorus 1]\na\n[Verse]\nb\n[Chorus 2]\nc", "a\nc"),
        ("[Hook]\nh1\n[Chorus]\nc1\n[Hook]\nh2", "h1\nh2\nc1"),
        ("[Pre-Chorus: X]\np", "p"),
        ("intro\n[Verse]\nv", None),
        ("[Chorus]\n \n[Hook]\nh\n[Chorus]\nc", "h\nc"),
        (" \t[ Chorus 12 ]x\r\n l1 \x0b\n l2 [end]\nq", "l1 \n\n l2"),
        ("[Chorus\n]\nx", None),
        ("say [Chorus]\nx", None),
        ("", None),
        ("[Refrain]\n[]\nx", "[]\nx"),
    ],
)
def test_chorus(spark, raw, chorus):
    assert run(spark, tx.chorus_text, raw) == [chorus]


@pytest.mark.parametrize(
    "raw, blocks",
    [
        ("[A 1]\nx\n\ny\n[B]\n\n[a 2] z\nw", [("a", "x\n\ny"), ("a", "w")]),
        ("[[x]]\ny", [("[x", "y")]),
        ("[2]\nbody", [("", "body")]),
        ("\x1d[V]\x1ea\x1cb", [("v", "a\nb")]),
        ("　[É 3]　\nç\x85d", [("é", "ç\nd")]),
        ("[a]b]c\nq", [("a", "q")]),
        ("a[b]\nc", []),
        ("\n\n[x]\r\n1\r2\n", [("x", "1\n2")]),
    ],
)
def test_section_blocks(spark, raw, blocks):
    assert [[(b["label"], b["text"]) for b in row] for row in run(spark, tx.section_blocks, raw)] == [blocks]


def test_chorus_order_is_linear_in_labels(spark):
    """20,000 labels in one row, each with two blocks: first-seen order of labels, then of blocks."""
    n = 20_000
    blocks = [(i + 1, f"chorus {(i * 7919) % n}" if i < n else f"chorus {i - n}", f"t{i}") for i in range(2 * n)]
    df = spark.createDataFrame([(blocks,)], "b array<struct<block_ix:int,label:string,text:string>>").repartition(1)
    df.count()
    start = time.perf_counter()
    got = df.select(tx.chorus_of_blocks("b")).first()[0].split("\n")
    assert time.perf_counter() - start < 10
    place = {label: i for i, (_, label, _) in reversed(list(enumerate(blocks)))}
    assert got == [t for _, label, t in sorted(blocks, key=lambda b: (place[b[1]], b[0]))]
