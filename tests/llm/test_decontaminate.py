import re

import pytest

pytest.importorskip("kindred.llm")
from kindred.llm import decontaminate, queries  # noqa: E402

Q = "If Alice buys 12 apples and 30 pears for 5 dollars each, how many coins does Alice have left over in total?"
LONG = "one fine morning the old keeper of the harbour lamp walked slowly along the wet stone wall and counted every boat"
SCHEMA = "doc_id long, text string, source string"


def found(spark, texts, items=(Q, LONG), **kw):
    docs = spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    return {(r.doc_id, r.item_id): r.n_changed for r in decontaminate.matches(docs, bench, **kw).collect()}


def test_changed_parameters_are_caught_if_consistent(spark):
    texts = [
        "Well then. " + Q + " Please answer.",
        "x y. " + Q.replace("Alice", "Robert").replace("12", "7.5").replace("dollars", "euros"),
        "x y. " + Q.replace("Alice", "Robert", 1).replace("12", "7"),
        "Nothing of the kind is here, only words about apples and pears and many coins in total",
        "prefix words go here " + " ".join(LONG.upper().split()[3:17]) + " and on it goes",
        None,
        "",
    ]
    got = found(spark, texts)
    # The third text holds 18 verbatim words in a row behind the changed name.
    assert set(got) == {(0, 0), (1, 0), (2, 0), (4, 1)} and got[(0, 0)] == 0 and got[(1, 0)] >= 3 and got[(2, 0)] == 1
    assert found(spark, texts, broadcast_windows=0) == got == found(spark, texts, broadcast_items=0) == found(spark, texts, broadcast_windows=0, broadcast_items=0)


def test_names_that_conflict_cut_a_run_and_do_not_join_what_lies_beside(spark):
    a, b = LONG.split()[:16], "no boat was ever seen to leave the quiet bay".split()
    item = " ".join([*a, "Alice", *b, "and", "Alice"])
    one = item.replace("Alice", "Robert", 1)
    torn = " ".join([*a[:8], "Alice", *b[:6], "Alice", *a[8:12]])
    texts = [item, one, item.replace("Alice", "Robert"), torn.replace("Alice", "Robert", 1)]
    got = found(spark, texts, (item, torn))
    assert {k[0] for k in got if k[1] == 0} == {0, 1, 2} and got[(2, 0)] == 2 and got[(0, 0)] == 0
    assert (3, 1) in got and found(spark, [" ".join([*a[:8], "Robert", *b[:3], "Alice", *b[3:6]])], (" ".join([*a[:8], "Alice", *b[:3], "Alice", *b[3:6]]),)) == {}


def test_stretches_beside_a_changed_value_and_every_run_are_judged(spark):
    a, b = LONG.split()[:14], "no boat was ever seen to leave the quiet bay before seven bells had rung".split()
    twice = " ".join([*a, "5", *b, "5", *a[:4]])
    other = "a man of 7 coins and 7 pears or 7 plums or 7 figs or 7 nuts"
    runs = f"{other} x {' '.join(a)}"
    texts = [
        twice.replace("5", "6", 1), twice.replace(" 5 ", " 6 ").replace("6", "5", 1), twice,
        " ".join([*a[:6], "5", *b[:5], "6"]),
        f"{other.replace('7 figs', '8 figs')} y {' '.join(a)}",
    ]
    got = found(spark, texts, (twice, runs, " ".join([*a[:6], "5", *b[:5], "5"])))
    assert {k for k in got if k[1] == 0} == {(0, 0), (1, 0), (2, 0), (4, 0)} and got[(2, 0)] == 0
    assert (4, 1) in got and (3, 2) not in got
    n = {(r.doc_id, r.item_id): r.n_tokens for r in decontaminate.matches(spark.createDataFrame([(1, texts[1], None)], SCHEMA), spark.createDataFrame([(0, twice)], "item_id long, text string")).collect()}
    assert n == {(1, 0): 14 + 1 + 15}


def test_short_items_and_odd_tables(spark):
    items = ("the quick brown fox leaps over", "too short", "", None)
    assert found(spark, ["Too short!", "this is too short", "too  SHORT", "too shorter", "short"], items) == {(0, 1): 0, (2, 1): 0}
    assert found(spark, ["Ask Rome", "ask rome", "ask 5 km", "ask 6 km"], ("ask Rome", "Ask 5 km"), broadcast_windows=0) == {(0, 0): 0, (1, 0): 0, (2, 1): 0}
    assert found(spark, ["see, the quick brown fox leaps over it", "the quick brown fox"], items) == {(0, 0): 0}
    assert found(spark, ["some text of enough words to look at it twice"], ()) == {}
    assert found(spark, [], (Q,)) == {}


def test_remove_keeps_other_rows_and_columns(spark):
    rows = [(1, Q, "a"), (1, Q, "a"), (2, "clean text", None), (None, None, None), (None, "clean", "b"), (2, "clean text", None)]
    docs = spark.createDataFrame(rows, SCHEMA.replace("source", "item_id"))
    bench = spark.createDataFrame([(5, Q)], "item_id long, text string")
    kept = decontaminate.remove(docs, bench)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.filter("doc_id is null or doc_id = 2").collect()))


def test_query_against_brute_force(spark, sf_dir):
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = {r.item_id: norm(r.text).split() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = set()
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        text = f" {norm(d.text or '')} "
        for k, words in items.items():
            n = min(13, len(words))
            if any(f" {' '.join(words[a : a + n])} " in text for a in range(len(words) - n + 1)):
                want.add((d.doc_id, k))
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op2_decontaminate"](spark, sf_dir).collect()}
    assert want and got == want
