import math
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("kindred.llm")
from kindred.llm import brown_lm, queries  # noqa: E402


def likelihood(joint):
    f = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return f(joint) - f(joint.sum(axis=0)) - f(joint.sum(axis=1))


def test_gain_of_a_move_is_the_change_in_likelihood():
    rnd = np.random.default_rng(3)
    n, k = 12, 4
    for _ in range(20):
        pairs = rnd.integers(0, 9, (n, n)).astype(float)
        cls = rnd.integers(0, k, n)

        def joint(labels):
            out = np.zeros((k, k))
            np.add.at(out, (labels[:, None].repeat(n, 1), labels[None, :].repeat(n, 0)), pairs)
            return out

        s = int(rnd.integers(n))
        others = np.arange(n) != s
        right = np.bincount(cls[others], pairs[s, others], k)
        left = np.bincount(cls[others], pairs[others, s], k)
        to, gain = brown_lm.best_class(joint(cls), right, left, pairs[s, s], int(cls[s]))
        tried = []
        for c in range(k):
            moved = cls.copy()
            moved[s] = c
            tried.append(likelihood(joint(moved)))
        assert tried[to] == pytest.approx(max(tried)) and gain == pytest.approx(tried[to] - tried[cls[s]])


def test_model_is_a_distribution_and_rows_are_scored(spark):
    texts = ["the cat sat on the mat"] * 6 + ["le chat est sur la table", "Le chat est sur un lit", "un chien est sur la table"] * 3 + ["the dog sat on the bed", None, ""]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(None, "the cat sat", 1), (3, texts[3], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    model, vocabulary = brown_lm.fit(df, classes=4, rounds=4)
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    words, n = model.words, len(model.words.count)
    by_class = Counter()
    for k in range(n):
        by_class[int(model.classes[words.symbol[k]])] += 10 ** model.emission[k]
    for e in range(brown_lm.ENDINGS):
        unseen = (model.ending_distinct[e] * brown_lm.DISCOUNT + 1) / (model.ending_total[e] + 1)
        by_class[int(model.classes[words.symbol[n + e]])] += 10 ** model.emission[n + e] * unseen
    assert all(v == pytest.approx(1) for v in by_class.values())
    got = brown_lm.score(df, model, vocabulary).collect()
    assert len(got) == len(rows) and {r.n_tokens for r in got if r.doc_id in (16, 17)} == {1}
    assert len({r.score for r in got if r.doc_id == 3}) == 1 and all(r.score < 0 for r in got)
    assert brown_lm.score_all(df.limit(0), classes=4, rounds=1).collect() == []


def test_query_against_plain_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    split = lambda t: [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low(t or "")).split(" ") if w] + [None]
    held = lambda k: zlib.crc32(str(k).encode()) % 7 == 2
    counts = Counter(w for d in docs if not held(d.doc_id) for w in split(d.text))
    total, distinct = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in queries.QUERIES["op1_brown_lm"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    gain = 0.0
    for d in docs:
        r, words = got[d.doc_id], split(d.text)
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(d.doc_id), len(words), sum(counts[w] > 0 for w in words), total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        gain += (r.score - r.base_score) * r.held_out
    assert gain > 0
