"""Most similar pairs of a corpus, and pair scores of a sample."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators import neighbours
from kindred.operators.matrices import SPARSE, pair_filter, rounder, row_scorer, vector_columns
from kindred.sources.shared import save_stage

DIGITS = 6
SAMPLE_CHUNK = 128


def sample_songs(songs: DataFrame, n: int, seed: int = 42, *, key: str = "song_id") -> DataFrame:
    """n songs without replacement; the same seed gives the same sample anywhere."""
    mixed = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    return songs.orderBy(mixed, key).limit(n)


def sample_pair_scores(sample: DataFrame) -> DataFrame:
    """Every pair of a sample, zeros included: ``song_a, song_b, similarity``.

    ``sample`` is the output of ``sample_songs`` on a vector table, so its size
    is the caller's n.  n(n-1)/2 rows come back, cut over tasks by the first
    song; ``song_a`` has the lower ``seq``.
    """
    cols = vector_columns(sample)
    rows = save_stage(sample.select("song_id", "seq", *cols), "sample")
    chunks = max(1, math.ceil(rows.count() / SAMPLE_CHUNK))
    song = rows.schema["song_id"].dataType.simpleString()
    return (
        rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        .groupBy("_part")
        .applyInArrow(_pair_lister(cols == SPARSE, chunks), f"song_a {song}, song_b {song}, similarity double")
    )


def _pair_lister(sparse: bool, chunks: int):
    scores = row_scorer(sparse, DIGITS)

    def score(table):
        import numpy as np
        import pyarrow as pa

        part = table.column("_part")[0].as_py()
        table = table.sort_by("seq")
        everyone = np.arange(table.num_rows)
        firsts, seconds, values = [], [], []
        for chunk, sims in scores(table, everyone[part::chunks], everyone):
            a, b = np.nonzero(everyone[None, :] > chunk[:, None])
            firsts.append(chunk[a])
            seconds.append(b)
            values.append(sims[a, b])
        ids = table.column("song_id")
        return pa.table(
            {
                "song_a": ids.take(pa.array(np.concatenate(firsts))),
                "song_b": ids.take(pa.array(np.concatenate(seconds))),
                "similarity": pa.array(np.concatenate(values)),
            }
        )

    return score


def most_similar_pairs(vectors: DataFrame, k: int = 15, *, cell_rows: int = neighbours.CELL_ROWS) -> DataFrame:
    """The k most similar pairs: ``rank, song_a, song_b, similarity``, for either kind of vector.

    Pairs are ordered by score, then by the ``seq`` of both songs (``song_a``
    has the lower one).  Exact, without comparing everything:

    1. Songs with one and the same vector are interchangeable, so only the
       first k+1 of them can be in the answer.  This folds hot groups of copies
       inside the map tasks.
    2. The best pairs inside the cells of the neighbour search are scored
       first.  The k-th of them all is a floor under the answer.
    3. A song is sent only into cells whose bound reaches that floor, and of
       two cells only from the first to the second.  A task returns its k best
       pairs, however many reach the floor.
    """
    cols = vector_columns(vectors)
    n = vectors.count()
    rows = neighbours.keyed_vectors(vectors.withColumn("seq", F.col("seq").cast("bigint")))
    if cols == SPARSE:
        rows = rows.where(F.size("term_ids") > 0)
    alike = Window.partitionBy(*neighbours.KEY, *cols).orderBy("seq")
    rows = rows.withColumn("_rn", F.row_number().over(alike)).where(F.col("_rn") <= k + 1)
    rows = save_stage(rows.drop("_rn").withColumn("_query", F.lit(False)), "pair-songs")
    rows = neighbours.grown_cells(rows, cols, cell_rows)

    song = vectors.schema["song_id"].dataType.simpleString()
    schema = f"song_a {song}, song_b {song}, seq_a bigint, seq_b bigint, similarity double"
    order = [F.desc("similarity"), "seq_a", "seq_b"]
    lowest = 0.0 if cols == SPARSE else -2.0
    inside = rows.groupBy("_leaf").applyInArrow(_best_inside(cols, k, lowest), schema)
    best = save_stage(inside.orderBy(*order).limit(k), "pair-best")
    found = best.agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("floor")).first()
    floor = found["floor"] if found["n"] == k else lowest

    run, kind = neighbours.own_cells(cols, k + 1, song)
    own = save_stage(rows.groupBy("_leaf").applyInArrow(run, kind), "pair-bounds")
    if own.select("_leaf").distinct().limit(2).count() > 1:
        queries = rows.select("song_id", "seq", *cols, *neighbours.KEY, F.lit(floor).alias("_floor"), F.col("_leaf").alias("_own"))
        queries = neighbours.numbered(queries)
        bounds = neighbours.leaf_bounds(own, cols)
        blocks = neighbours.routed_blocks(queries, bounds, cols)
        sent = neighbours.routed(queries, bounds, cols, blocks)
        if neighbours.many_blocks(blocks, queries, bounds):
            across = neighbours.meetings(queries, bounds, rows, cols, _best_met(cols, k, floor), schema)
        else:
            sent = save_stage(sent.where("_own < _leaf"), "routed")
            across = neighbours.few_meetings(sent, queries, rows, cols, _best_across(cols, k, floor), schema)
        best = save_stage(best.unionByName(across).orderBy(*order).limit(k), "pair-best")
    if cols == SPARSE and best.count() < min(k, n * (n - 1) // 2):
        best = best.unionByName(_zero_pairs(vectors, best, k))
    # k rows, or those and as many pairs at zero
    rank = F.row_number().over(Window.orderBy(*order))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("rank", "song_a", "song_b", "similarity")


def _pair_finder(cols, k: int, floor: float):
    """The k best pairs of a row of one side and one of the other, for each yield of sides, as an Arrow table."""
    sparse, step = cols == SPARSE, 10.0**-DIGITS
    (prepare, near), rounded, cols = pair_filter(sparse), rounder(DIGITS), list(cols)

    def find(table, sides, within: bool = False):
        import numpy as np
        import pyarrow as pa

        def later(left, right):
            return right[None, :] > left[:, None]

        seqs, rows = table.column("seq").to_numpy(), prepare(table.select(cols))
        floors = np.full(len(seqs), floor - step)
        best = (np.zeros(0), np.zeros(0, "int64"), np.zeros(0, "int64"))
        for left, right in sides:
            for a, b, value in near(rows, left, right, floors, k, step, across=True, allowed=later if within else None):
                value = rounded(value)
                real = (value >= floor) & ((value > 0) if sparse else True)
                a, b = a[real], b[real]
                swap = seqs[a] > seqs[b]
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                value, a, b = (np.concatenate(p) for p in zip(best, (value[real], a, b)))
                take = np.lexsort((seqs[b], seqs[a], -value))[:k]
                best = value[take], a[take], b[take]
                if len(take) == k:
                    floors[:] = max(floor, best[0][-1]) - step
        value, a, b = best
        ids = table.column("song_id")
        return pa.table(
            [ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(seqs[a]), pa.array(seqs[b]), pa.array(value)],
            names=["song_a", "song_b", "seq_a", "seq_b", "similarity"],
        )

    return find


def _best_inside(cols, k: int, floor: float):
    find = _pair_finder(cols, k, floor)

    def run(table):
        import numpy as np

        every = np.arange(table.num_rows)
        return find(table, [(every, every)], True)

    return run


def _best_across(cols, k: int, floor: float):
    find = _pair_finder(cols, k, floor)
    names = ["song_id", "seq", *cols]

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        both = pa.concat_tables([left.select(names), right.select(names)])
        n, m = left.num_rows, right.num_rows
        return find(both, [(np.arange(n), n + np.arange(m))] if n and m else [])

    return run


def _best_met(cols, k: int, floor: float):
    """The best pairs of a meeting of blocks, of a song and another in a later leaf."""
    find, leaves, meeting = _pair_finder(cols, k, floor), neighbours.across_leaves(cols), neighbours.met_rows()

    def run(batches):
        for left, right, cells in meeting(batches):
            both, each = leaves(left, right, cells, True)
            yield from find(both, each).to_batches()

    return run


def _zero_pairs(vectors: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Fill with unrelated pairs when fewer than k pairs share any term.

    Ordered by seq, the first such pairs all start with the first song, and
    fewer than k of its partners are taken, so 2k+1 songs are enough.
    """
    head = vectors.select("song_id", "seq").orderBy("seq").limit(2 * k + 1)
    first = head.orderBy("seq").limit(1).select(F.struct("song_id", "seq")).scalar()
    pairs = head.select(
        first["song_id"].alias("song_a"),
        F.col("song_id").alias("song_b"),
        first["seq"].alias("seq_a"),
        F.col("seq").alias("seq_b"),
        F.lit(0.0).alias("similarity"),
    ).where("seq_a < seq_b")
    return pairs.join(found.select("song_a", "song_b"), ["song_a", "song_b"], "left_anti")
