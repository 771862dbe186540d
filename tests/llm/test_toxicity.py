import dataclasses
import itertools
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("kindred.llm")
from kindred.llm import queries, toxicity  # noqa: E402
from kindred.llm.toxicity import INSULT, NEGATES, OTHER, REPORTS, TARGETS, THREATENS  # noqa: E402

G = toxicity.Grammar(words={"moron": 2.0}, stems={"stupi": 1.0}, slope=1.0, shift=-1.0)


def weight(text):
    return toxicity.evidence(text, G, {})[0]


def test_context_changes_the_weight_of_a_clause():
    plain = weight("what a moron indeed")
    assert plain == 2.0 and weight("moron. moron") == 4.0 and weight("stupidity reigns") == 1.0
    assert weight("you are a moron") == 2.5 and weight("such a moron, you") == 2.5
    assert weight("he is not a moron") == 0.5 * 2.5 and weight('they said "moron"') == 0.75 * 2.5
    assert weight("kill the lights") == 0.0 and weight("i will kill you") == 1.0
    assert weight("you sat. moron") == 2.0 and weight(None) == weight("") == weight("fine words") == 0.0


def slow(symbols):
    """The same weight from whole-clause views of each entry."""
    total = 0.0
    for k, (s, w) in enumerate(symbols):
        if s not in (INSULT, THREATENS):
            continue
        kinds = [x for x, _ in symbols]
        share = (0.5 if NEGATES in kinds[max(0, k - 3) : k] else 1.0) * (0.75 if REPORTS in kinds[:k] else 1.0)
        aimed = TARGETS in kinds[max(0, k - 4) : k] or TARGETS in kinds[k + 1 : k + 5]
        total += w * share * ((1.0 if aimed else 0.0) if s == THREATENS else 1.25 if aimed else 1.0)
    return total


def clause_weight(symbols):
    shares = G.shares()
    return sum(shares[c] * w for c, w in toxicity.found_contexts(symbols))


def test_composed_machine_says_what_its_parts_say():
    parts = [toxicity.within(NEGATES, 2), toxicity.ever(REPORTS), toxicity.within(TARGETS, 3)]
    whole = toxicity.compose(toxicity.compose(parts[0], parts[1]), parts[2])
    assert len(whole.arcs) <= 3 * 2 * 4
    for word in itertools.product(range(6), repeat=5):
        at, states = 0, [0, 0, 0]
        for symbol in word:
            assert whole.out[at] == tuple(p.out[s][0] for p, s in zip(parts, states, strict=True))
            at, states = whole.arcs[at][symbol], [p.arcs[s][symbol] for p, s in zip(parts, states, strict=True)]


def test_composition_equals_the_plain_definition():
    for kinds in itertools.product([OTHER, INSULT, THREATENS, TARGETS, NEGATES, REPORTS], repeat=5):
        symbols = [(k, 2.0) for k in kinds]
        assert clause_weight(symbols) == pytest.approx(slow(symbols)), kinds
    long = [(TARGETS, 1.0), *[(OTHER, 0.0)] * 4, (INSULT, 1.0), *[(OTHER, 0.0)] * 4, (TARGETS, 1.0)]
    assert clause_weight(long) == pytest.approx(slow(long)) == 1.0


def test_only_copies_are_folded_before_learning(spark):
    own = lambda k: " ".join(["everyone", *[f"w{k}x{j}" for j in range(60)]])
    copy = [f"copied{j}" for j in range(120)]
    rows = [(k, own(k % 200)) for k in range(400)] + [(1000 + k, " ".join([*copy[: k % 120], f"new{k}", *copy[k % 120 + 1 :]])) for k in range(200)]
    docs = spark.createDataFrame([*rows, (5000, None), (5001, "everyone")], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    learned = {r.doc_id: r.toxic for r in toxicity.train_rows(docs, labels).collect()}
    train = {r.doc_id for r in docs.filter(toxicity._in_train()).collect()}
    assert {k % 200 for k in learned if k < 1000} == {k % 200 for k in train if k < 1000} and len([k for k in learned if k < 1000]) == len({k % 200 for k in train if k < 1000})
    assert sorted(learned[k] for k in learned if 1000 <= k < 5000) == [0, 1] and {k for k in learned if k >= 5000} == {k for k in train if k >= 5000}


def test_contexts_are_learned_and_beat_the_sum_of_weights(spark):
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    kinds = {1: ["you are a zorgface", "what a zorgface"], 0: ["he is not a zorgface", "she said zorgface once", "you are a friend", "what a day"]}
    rows = []
    for k in range(3000):
        toxic = int(k % 3 == 0)
        text = kinds[1][k // 3 % 2] if toxic else kinds[0][k // 30 % 2 if k % 30 == 1 else 2 + k % 2]
        rows.append((k, f"{own(k)}. {text}.", toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    learned = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert learned.negated < 1 and learned.reported < 1 and len(learned.words) + len(learned.stems) == 1
    held = [(t, y) for k, t, y in rows if zlib.crc32(str(k).encode()) % 4 == 2 and "zorgface" in t]
    seen = lambda g: [(toxicity.squash(toxicity.evidence(t, g, {})[0]) * g.slope + g.shift > math.log(0.3 / 0.7)) == y for t, y in held]
    plain = dataclasses.replace(learned, target=1.0, negated=1.0, reported=1.0)
    assert sum(seen(learned)) == len(held) > sum(seen(plain)) and {y for _, y in held} == {0, 1}


def test_a_context_weight_follows_the_labels():
    sums = np.zeros((6, toxicity.CONTEXTS))
    sums[1:3, 0], sums[3:5, 1], sums[5, 4] = [2.0, 3.0], [2.0, 3.0], 2.0
    fitted = {}
    for share in (0.05, 0.5, 0.95):
        y = np.array([0.02, 0.9, 0.95, share, share, 0.9])
        g = toxicity.Grammar()
        toxicity.fit_contexts(g, np.vstack([sums, sums]), np.repeat([1.0, 0.0], 6), 200 * np.concatenate([y, 1 - y]))
        fitted[share] = g.negated
    assert fitted[0.05] < 0.25 <= fitted[0.5] < 1.0 == fitted[0.95]


def test_entries_that_a_stem_implies_are_left_out(spark):
    rows = spark.createDataFrame([("stupidity and stupider", 1)] * 200 + [("fine words here", 0)] * 400, "text string, toxic int")
    words, stems = toxicity.learn_lexicon(rows, 600, 200)
    assert "stupidity" not in words and "stu" in stems and set(stems) <= {"stu", "and"} and set(words) <= {"and"}


def test_without_labels_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (1, None, 5.0), (None, "moron", 1.0), (3, "", 1.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.apply(docs, toxicity.fit(docs, none)).collect()
    assert [r.score for r in got] == [0.5] * 4
    assert toxicity.apply(docs.limit(0), G).collect() == []
    assert {r.h for r in docs.select(toxicity.held_out().alias("h")).collect()} <= {True, False}


def test_held_out_accuracy(spark, sf_dir):
    got = queries.QUERIES["op3_toxicity"](spark, sf_dir.replace("sf0.001", "sf0.1"))
    labels = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.1") + "/labels.parquet").select("doc_id", "toxic")
    c = {(r.toxic, r.predicted): r.n for r in got.filter("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()}
    assert c[1, 1] >= 0.8 * (c[1, 1] + c.get((1, 0), 0)) and c.get((0, 1), 0) <= 0.03 * c[0, 0]
