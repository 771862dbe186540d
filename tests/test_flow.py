"""The whole way from a landed CSV to a comparison of four models."""

import pandas as pd
from pyspark.sql import functions as F

from kindred import session
from kindred.operators import compare
from kindred.plans import corpus, inputs
from kindred.plans import recommenders as rec
from kindred.sources import tables
from kindred.sources.shared import save_stage, stage_path


def word_lengths():
    def embed(texts, max_length):
        return [[float(sum(len(w) == n for w in t.split()[:max_length])) for n in range(1, 9)] for t in texts]

    return embed


def test_four_models_from_csv(spark, sf_dir, tmp_path):
    songs = inputs.headed_songs(spark, sf_dir).orderBy("seq").toPandas()
    landed = songs.rename(columns={"song_id": "track_id"})[["track_id", "track_name", "artist", "lyrics"]]
    half = len(landed) // 2
    landed.iloc[:half].to_csv(tmp_path / "a.csv", index=False)
    landed.iloc[half:].to_csv(tmp_path / "b.csv", index=False)

    raw = tables.read_csv_table(spark, str(tmp_path), tables.LYRICS)
    numbered = tables.with_sequence(raw.withColumn("n", F.col("track_id").cast("long")), "n")
    raw = save_stage(numbered.withColumn("song_id", F.col("seq")), "flow-raw")
    assert raw.count() == len(landed)

    full = save_stage(corpus.clean_corpus(raw), "flow-clean")
    tfidf = rec.build_tfidf(full)
    lsa = rec.build_lsa(tfidf, n_components=10)
    chorus = rec.build_chorus(save_stage(corpus.chorus_corpus(raw), "flow-chorus"))
    dense = rec.build_embedding(full, word_lengths, stage_path(spark, "flow-cache"), model="lengths")
    models = [tfidf, lsa, chorus, dense]

    seeds = save_stage(inputs.artist_seeds(tfidf.songs), "flow-seeds")
    lists, attempts = (save_stage(t, "flow") for t in rec.compare_models(models, seeds, k=10))
    per_list = lists.groupBy("model", "seed_id").agg(
        F.count("*").alias("n"), F.collect_set("rank").alias("ranks"), F.max("similarity").alias("top")
    )
    for r in per_list.collect():
        assert r["n"] == 10 and sorted(r["ranks"]) == list(range(1, 11)) and r["top"] <= 1
    found = {(r["model"], r["seed_id"]) for r in attempts.where("found").collect()}
    assert found == {(r["model"], r["seed_id"]) for r in per_list.collect()}
    assert attempts.where("seed_id = 'nobody' and found").count() == 0

    names = [m.name for m in models]
    table = compare.rank_table(lists, attempts, names, 10)
    assert table.count() == 10 * seeds.count()
    assert table.where("seed_id = 'nobody'").select(*names).distinct().collect() == [("[not found]",) * 4]


def test_results_do_not_depend_on_partitions(spark, sf_dir):
    songs = save_stage(inputs.headed_songs(spark, sf_dir), "flow-songs")

    def lists(n):
        model = rec.build_tfidf(corpus.clean_corpus(songs.repartition(n)))
        seeds = inputs.artist_seeds(model.songs)
        return model.recommend_many(save_stage(seeds, "flow-seeds"), 5)[0].toPandas()

    order = ["seed_id", "rank"]
    one, many = (lists(n).sort_values(order).reset_index(drop=True) for n in (1, 13))
    pd.testing.assert_frame_equal(one, many)


def test_settings_follow_the_input():
    small, large = session.settings(1 << 30, 8), session.settings(100 << 40, 4_000)
    assert small["spark.sql.shuffle.partitions"] == "16"
    assert int(large["spark.sql.shuffle.partitions"]) == 100 << 13
