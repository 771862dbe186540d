"""Cleaning pipelines, deduplication, reports, seeds and statistics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import text as tx
from kindred.functions import wordlists as wl
from kindred.operators import dedupe, filters, lemmas, seeds, stats, terms
from kindred.plans import corpus, inputs

SONG = "song_id long, seq long, track_name string, artist string, lyrics string"


def letters(i):
    return "".join(chr(97 + int(d)) for d in str(i))


def words(n, start=0):
    return " ".join("zq" + letters(i % 37) for i in range(start, start + n))


def full_fixture(spark):
    rows = [
        (1, "My Conception", "RYO FUKUI", words(60)),
        (2, "my conception", None, words(60, 1)),
        (3, "a", "x", None),
        (4, "b", "x", words(60) + " Remaster"),
        (5, "c", "x", "the of and"),
        (6, "d", "x", words(29)),
        (7, "e", "x", words(40)),
        (8, "f", "x", words(40)),
        (9, "g", "x", words(50)),
        (10, "h", "x", words(50).upper() + "!"),
        (11, "i", "x", words(2001)),
        (12, "j", "x", words(2000)),
        (13, "k", "x", words(60, 2) + " he said"),
        (14, "l", "x", " ".join("u" + letters(i) for i in range(120))),
    ]
    return spark.createDataFrame([(i, i, t, a, x) for i, t, a, x in rows], SONG).repartition(3)


def kept(df):
    return sorted(r["song_id"] for r in df.select("song_id").collect())


def test_clean_corpus(spark):
    songs = full_fixture(spark)
    assert kept(corpus.clean_corpus(songs)) == [2, 9, 12, 13, 14]
    assert kept(corpus.clean_corpus(songs, prose_gate=True)) == [2, 9, 12]
    row = corpus.clean_corpus(songs).where("song_id = 9").first()
    assert row["token_count"] == 50 and row["processed_lyrics"] == words(50)


def test_clean_report_counts_each_row_once(spark):
    got = {r["outcome"]: r["rows"] for r in corpus.clean_report(full_fixture(spark), prose_gate=True).collect()}
    assert got == {
        "blocklisted": 1, "no text": 1, "metadata": 1, "empty": 1, "short": 2, "duplicate": 2, "long": 1,
        "prose": 2, "kept": 3,
    }


def chorus_fixture(spark):
    body = words(12)
    rows = [
        (1, "a", "x", None),
        (2, "a", "x", "[Verse]\nno chorus here"),
        (3, "a", "x", f"[Chorus]\n{body}"),  # a later copy of the key does not count
        (4, "b", "x", f"[Chorus]\n{body}"),
        (5, "c", "x", f"[Chorus]\n{body}\nlabel:x"),
        (6, "d", "x", f"[Chorus]\n{body}\napplause"),
        (7, "e", "x", "[Hook]\nthe of"),
        (8, "f", "x", f"[Hook]\n{words(9)}"),
        (9, None, "x", f"[Hook]\n{body}"),
        (10, None, "x", f"[Hook]\n{body}"),
    ]
    return spark.createDataFrame([(i, i, t, a, x) for i, t, a, x in rows], SONG).repartition(3)


def test_chorus_corpus(spark):
    songs = chorus_fixture(spark)
    assert kept(corpus.chorus_corpus(songs)) == [4, 9]
    row = corpus.chorus_corpus(songs).where("song_id = 4").first()
    assert row["chorus_text"] == words(12) == row["processed_chorus"] and row["token_count"] == 12
    got = {r["outcome"]: r["rows"] for r in corpus.chorus_report(songs).collect()}
    assert got == {"no chorus": 1, "duplicate": 2, "kept": 2, "metadata": 1, "prose": 1, "empty": 1, "short": 1}


def test_cleaning_expression_runs_once(spark):
    plan = corpus.clean_corpus(full_fixture(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("INSET") == 1  # the stop-word test, the last step of cleaning


@pytest.mark.parametrize("build", [corpus.clean_corpus, corpus.chorus_corpus])
def test_hot_keys_are_folded_before_the_shuffle(spark, build):
    plan = build(full_fixture(spark))._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    limits = [i for i, line in enumerate(lines) if "WindowGroupLimit" in line]
    exchange = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert len(exchange) == 1 and limits[0] < exchange[0] < limits[1]


def test_raw_text_stays_behind_when_not_selected(spark):
    plan = corpus.clean_corpus(full_fixture(spark)).select("song_id", "tokens")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    window = text.split("Generate")[0]
    assert "lyrics" not in window


def test_first_by_key_with_one_hot_key(spark):
    rows = [(i, "hot" if i % 3 else f"k{i}", None if i % 2 else "x") for i in range(300)]
    df = spark.createDataFrame(rows, "seq long, track_name string, artist string").repartition(7)
    got = {(r["track_name"], r["artist"]): r["seq"] for r in dedupe.first_by_key(df, ["track_name", "artist"]).collect()}
    want = {}
    for s, t, a in rows:
        want.setdefault((t, a), s)
    assert got == want


def test_blocklist_from_table_keeps_nulls(spark):
    df = spark.createDataFrame([("A", "T"), (None, "T"), ("a", None), ("b", "t")], "artist string, track_name string")
    listed = spark.createDataFrame([("a", "t")], "artist string, track_name string")
    got = {(r["artist"], r["track_name"]) for r in filters.drop_blocklisted(df, listed).collect()}
    assert got == {(None, "T"), ("a", None), ("b", "t")}


@pytest.mark.parametrize("small", [True, False])
def test_lemmatize_keeps_order(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(lemmas, "BROADCAST_LEMMAS", 0)
    rows = [(1, ["b", "cats", "a", "cats", "x"]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, "song_id long, tokens array<string>")
    table = spark.createDataFrame([("cats", "cat"), ("x", "y"), ("x", "z")], "surface string, lemma string")
    got = {r["song_id"]: r["tokens"] for r in lemmas.lemmatize(df, table).collect()}
    assert got == {1: ["b", "cat", "a", "cat", "y"], 2: [], 3: None}
    assert lemmas.lemmatize(df, None) is df


def test_find_and_match_seeds(spark):
    rows = [(5, 5, "One", "A"), (3, 3, "one", "B"), (4, 4, "ONE", None)]
    df = spark.createDataFrame(rows, "song_id long, seq long, track_name string, artist string")
    assert seeds.find_song(df, "oNe")["song_id"] == 3
    assert seeds.find_song(df, "one", "")["song_id"] == 3
    assert seeds.find_song(df, "one", "a")["song_id"] == 5
    with pytest.raises(ValueError):
        seeds.find_song(df, "one", "nobody")
    wanted = spark.createDataFrame(
        [("p", "ONE", ""), ("q", "one", "a"), ("r", "one", "zz"), ("s", "two", None)],
        "seed_id string, seed_title string, seed_artist string",
    )
    got = {r["seed_id"]: (r["found"], r["song_id"]) for r in seeds.match_seeds(df, wanted).collect()}
    assert got == {"p": (True, 3), "q": (True, 5), "r": (False, None), "s": (False, None)}


def test_describe_and_histogram(spark):
    rng = np.random.default_rng(5)
    values = [int(v) for v in rng.integers(1, 300, 200)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v int")
    row = stats.describe(df, "v").first()
    assert row["count"] == 200 and row["std"] == pytest.approx(np.std(values, ddof=1))
    assert [row["q25"], row["q50"], row["q75"]] == pytest.approx(list(np.percentile(values, [25, 50, 75])))
    counts, edges = np.histogram(values, bins=50)
    got = stats.histogram(df, "v", 50).orderBy("bin").collect()
    assert [r["count"] for r in got] == list(counts)
    assert [r["low"] for r in got] == pytest.approx(list(edges[:-1]))
    flat = stats.histogram(spark.createDataFrame([(4.0,)] * 3, "v double"), "v", 5).orderBy("bin").collect()
    assert [r["count"] for r in flat] == list(np.histogram([4.0] * 3, bins=5)[0])
    assert stats.histogram(df.where("v < 0"), "v", 5).count() == 0


def test_score_summary(spark):
    values = [0.0, 0.1, 0.100001, 0.5, 0.95]
    row = stats.score_summary(spark.createDataFrame([(v,) for v in values], "similarity double")).first()
    assert row["pairs"] == 5 and row["median"] == 0.100001 and row["max"] == 0.95
    assert [row["above_0_1"], row["above_0_3"], row["above_0_5"], row["above_0_9"]] == [0.6, 0.4, 0.2, 0.2]


def test_fixed_values():
    assert wl.MAX_FEATURES == 10_000 and wl.MIN_DF == 2


def test_song_sets_treat_null_artists_as_equal(spark):
    from kindred.operators import dedupe

    a = spark.createDataFrame([("x", None), ("x", None), ("y", "b")], "track_name string, artist string")
    b = spark.createDataFrame([("x", None), ("z", "c")], "track_name string, artist string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(dedupe.shared_songs(a, b)) == [("x", None)]
    assert rows(dedupe.only_in_first(a, b)) == [("y", "b")]
    assert rows(dedupe.all_songs(a, b)) == sorted([("x", None), ("y", "b"), ("z", "c")], key=str)


def test_tokens_come_back_from_their_text(spark):
    lists = [["a", "b"], [], None, [""], ["a b", "c"], [None, "a"], ["a", ""], ["x\ny"]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lists)], "i int, t array<string>")
    packed = df.select("i", tx.join_tokens("t").alias("x"), tx.odd_tokens("t").alias("odd"))
    assert [r.t for r in packed.select("i", tx.tokens_of("x", "odd").alias("t")).orderBy("i").collect()] == lists
    assert [r.i for r in packed.where("odd is not null").orderBy("i").collect()] == [1, 3, 4, 5, 6]


def test_copies_are_found_without_moving_tokens(spark):
    df = corpus.clean_corpus(full_fixture(spark)).select("song_id", "tokens", "processed_lyrics")
    assert all(r.tokens == r.processed_lyrics.split(" ") for r in df.collect())
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    moved = next(line for line in plan[plan.index("Window") :].splitlines() if "Project" in line)
    columns = [c.strip().rsplit(" AS ", 1)[-1].split("#")[0] for c in moved[moved.index("[") + 1 : -1].split(", ")]
    assert "tokens" not in columns and "_odd" in columns


def test_tasks_grow_with_the_table(spark, tmp_path, monkeypatch):
    spark.range(1000).withColumnRenamed("id", "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(inputs, "TASK_ROWS", 10)
    df = inputs.read_table(spark, str(tmp_path), "documents")
    assert df.rdd.getNumPartitions() == 100 and df.count() == df.distinct().count() == 1000


def test_tasks_of_term_vectors_grow_with_the_songs(spark, monkeypatch):
    rows = [(i, i, ["aa", "bb", f"w{i % 7}"]) for i in range(600)]
    songs = spark.createDataFrame(rows, "song_id long, seq long, tokens array<string>")
    vocabulary = terms.fit_vocabulary(songs).localCheckpoint()
    monkeypatch.setattr(terms, "TASK_SONGS", 20)
    vectors = terms.term_vectors(songs, vocabulary)
    assert vectors.rdd.getNumPartitions() == 30 and vectors.count() == 600


def test_only_the_chorus_text_moves_and_its_tokens_follow(spark):
    rows = [(i, i, f"t{i % 4}", "a", "[Chorus]\n" + "golden river running slowly over silver stones tonight " * 3) for i in range(8)]
    songs = spark.createDataFrame(rows, "song_id long, seq long, track_name string, artist string, lyrics string")
    df = corpus.chorus_corpus(songs).select("song_id", "tokens", "chorus_text", "processed_chorus")
    assert sorted(r.song_id for r in df.collect()) == [0, 1, 2, 3]
    assert all(r.tokens == r.processed_chorus.split(" ") for r in df.collect())
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "tokens" in plan[: plan.index("Window")] and "tokens" not in plan[plan.index("Window") :]


def test_spread_files_are_read_without_a_shuffle(spark, tmp_path, monkeypatch):
    spark.range(800).withColumnRenamed("id", "doc_id").repartition(16).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(inputs, "TASK_ROWS", 100)
    df = inputs.read_table(spark, str(tmp_path), "documents")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == df.distinct().count() == 800
    spark.range(800).withColumnRenamed("id", "doc_id").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    assert inputs.read_table(spark, str(tmp_path), "pages").rdd.getNumPartitions() == 8
