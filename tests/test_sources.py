"""CSV, nested pages, lookups and stage tables."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kindred.sources import library, lookup, shared, tables


def test_csv_written_elsewhere_reads_back_exactly(spark, tmp_path):
    texts = ['a "quoted"\nline', " outer blanks ", "None", "x,y", 'back\\slash "', "[Chorus]\r\nla"]
    frame = pd.DataFrame({"track_id": range(len(texts)), "track_name": "T", "artist": "a", "lyrics": texts})
    frame.to_csv(tmp_path / "songs.csv", index=False)
    got = tables.read_csv_table(spark, str(tmp_path / "songs.csv"), tables.LYRICS).collect()
    assert {r["track_id"]: r["lyrics"] for r in got} == {str(i): t for i, t in enumerate(texts)}


def test_csv_round_trip(spark):
    texts = ['two\nlines "q"', "  pad  ", "", None, "tail\n", '"']
    df = spark.createDataFrame([(str(i), "t", "a", t) for i, t in enumerate(texts)], tables.LYRICS)
    path = shared.stage_path(spark, "csv-test")
    tables.write_csv_table(df, path)
    got = {r["track_id"]: r["lyrics"] for r in tables.read_csv_table(spark, path, tables.LYRICS).collect()}
    want = {str(i): t or None for i, t in enumerate(texts)}  # an empty text reads back as NULL
    assert got == want


def test_flatten_tracks(spark, tmp_path):
    (tmp_path / "p1.json").write_text(
        '{"items": [{"added_at": "d1", "track": {"id": "1", "name": "One", "artists": [{"name": "A", "id": "a"},'
        ' {"name": "B", "id": "b"}], "album": {"name": "Al", "release_date": "2001"}}},'
        ' {"added_at": "d2", "track": null}]}\n{"items": []}\n'
        '{"items": [{"added_at": "d3", "track": {"id": "2", "name": "Two", "artists": [], "album": null}}]}\n'
    )
    pages = library.read_library_pages(spark, str(tmp_path))
    got = [tuple(r) for r in library.flatten_tracks(pages).orderBy("track_id").collect()]
    assert got == [("1", "One", "A", "a", "Al", "2001", "d1"), ("2", "Two", None, None, None, None, "d3")]
    assert library.flatten_tracks(pages).columns == tables.TRACK_METADATA.fieldNames()


def test_attach_lyrics_adds_no_rows(spark):
    tracks = spark.createDataFrame([("1", "t", "a"), ("2", "t", "a"), ("3", "u", None)], "track_id string, track_name string, artist string")
    landed = spark.createDataFrame([(2, "t", "a", "second"), (1, "t", "a", "first"), (3, "u", None, "x")],
                                   "seq int, track_name string, artist string, lyrics string")
    done = lookup.attach_lyrics(tracks, landed)
    got = {r["track_id"]: (r["lyrics"], r["status"]) for r in done.collect()}
    assert got == {"1": ("first", "FOUND"), "2": ("first", "FOUND"), "3": (None, "NOT FOUND")}
    assert tuple(lookup.coverage(done).first()) == (2, 3)


def test_sequence_follows_order(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id")).repartition(9)
    saved = shared.save_stage(tables.with_sequence(df, "k"), "seq-test")
    rows = saved.orderBy("seq").collect()
    assert [r["k"] for r in rows] == sorted(r["k"] for r in rows)
    assert len({r["seq"] for r in rows}) == 1000


def test_stage_folder_follows_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert shared.stage_path(spark, "x").startswith(folder + "/")


@pytest.mark.parametrize("bound, small", [(3, True), (2, False)])
def test_broadcast_only_within_bound(spark, bound, small):
    side, flag = shared.broadcast_if_bounded(spark.range(3), bound)
    assert flag is small
    plan = spark.range(10).join(side, "id")._jdf.queryExecution().logical().toString()
    assert ("ResolvedHint" in plan or "UnresolvedHint" in plan) is small
