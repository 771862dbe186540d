import random
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("kindred.llm")
from kindred.llm import chosen_path, queries  # noqa: E402


def brute(texts):
    """Class (least id) and number of links of each text."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    at = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            at[g].append(k)
    links, seen = [0] * len(texts), set()
    for k, s in enumerate(sets):
        for j in {j for g in s for j in at[g] if j < k}:
            common = len(s & sets[j])
            if 9 * common >= 4 * (len(s) + len(sets[j])):
                links[k] += 1
                links[j] += 1
                a, b = find(k), find(j)
                parent[max(a, b)] = min(a, b)
                seen.add((j, k))
    return [(k, find(k), links[k]) for k in range(len(texts))], seen


def test_against_brute_force(spark):
    rnd = random.Random(4)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(60):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 150))]
        texts.append(" ".join(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 5])):
            copy = list(base)
            for _ in range(rnd.randrange(4)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            texts.append(" ".join(copy))
    big = [rnd.choice(vocabulary) for _ in range(120)]
    for k in range(500):  # more than a small bucket and a block hold
        copy = list(big)
        copy[rnd.randrange(120)] = f"x{k % 400}"
        texts.append(" ".join(copy))
    texts += [None, "", " \n", "one two", "one  TWO", "Solo"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, pairs = brute(texts)
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in chosen_path.join(df).collect())
    assert got == want and len(pairs) > 10_000


def test_rows_that_repeat_and_columns(spark):
    text = " ".join(f"a{k}" for k in range(30))
    rows = [(5, text, "x"), (5, text, "x"), (None, text + " z", "y"), (None, None, "y"), (7, "other words", None), (8, "", None), (9, text, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in chosen_path.join(df).collect()), key=str)
    assert got == sorted([(5, 5, 3), (5, 5, 3), (9, 5, 3), (None, 5, 3), (None, None, 0), (7, 7, 0), (8, 8, 0)], key=str)
    kept = chosen_path.keep_one(df)
    assert kept.columns == df.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == ["5", "7", "8", "None"]
    assert chosen_path.join(df.limit(0)).collect() == [] and chosen_path.keep_one(df.limit(0)).collect() == []


def test_intersections():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 9000, n).astype(np.uint64)) for n in (1, 5, 800, 6000, 6000)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets[1:]] for a in sets]
    assert chosen_path._common(sets, sets[1:]).tolist() == want


def test_query_against_brute_force(spark, sf_dir):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    want, _ = brute([d.text for d in docs])
    ids = [d.doc_id for d in docs]
    got = sorted(tuple(r) for r in queries.QUERIES["op8_jaccard_join"](spark, sf_dir).collect())
    assert got == [(ids[k], ids[c], n) for k, c, n in want]
