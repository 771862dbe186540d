"""The k songs most similar to each seed.

Scores are rounded to six places before they are ranked and equal scores go to
the lower ``seq``, so neither the order of a floating-point sum nor the
partitioning decides a result.  A seed is never in its own list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.matrices import SPARSE, best_columns, rounder, unit_matrix, vector_columns
from kindred.operators.neighbours import search

DIGITS = 6
#: Seeds whose vectors travel to the songs; more of them are dealt into the songs' cells.
SCAN_SEEDS = 512
CHUNK_ROWS = 256


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("seed_id").orderBy(F.desc("similarity"), "seq")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("seed_id", "rank", "song_id", "seq", "similarity")


def top_by_scan(vectors: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """Up to SCAN_SEEDS seeds: one pass over the corpus.

    The seeds' vectors travel to the tasks, where a batch of songs is one
    matrix product.  Songs never move; the only shuffle carries k rows per
    seed and task.
    """
    cols = vector_columns(vectors)
    wanted = F.broadcast(seeds.select("seed_id", F.col("song_id").alias("seed_song")))
    # SCAN_SEEDS rows at most.
    rows = vectors.join(wanted, F.col("song_id") == F.col("seed_song")).select("seed_id", "song_id", *cols).toArrow()
    kind = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    seed = seeds.schema["seed_id"].dataType.simpleString()
    schema = f"seed_id {seed}, song_id {kind['song_id']}, seq {kind['seq']}, similarity double"
    if not rows.num_rows:
        return _best(vectors.sparkSession.createDataFrame([], schema), k).drop("seq")
    group = rows.combine_chunks()
    product = _sparse_product(group) if cols == SPARSE else _dense_product(group)
    scored = vectors.select("song_id", "seq", *cols).mapInArrow(_scanner(group, product, k), schema)
    return _best(scored, k).drop("seq")


def top_k_at_cuts(scores: DataFrame, seeds: DataFrame, k: int, cuts: list[int]) -> DataFrame:
    """Lists over the first ``c`` entries of dense score vectors, for every ``c`` of ``cuts``, in one scan.

    Products and squared lengths are carried on from one cut to the next, so all cuts together cost one
    product over the longest of them.  Returns ``cut, seed_id, rank, song_id, similarity``; up to
    SCAN_SEEDS seeds.
    """
    cuts = sorted(set(cuts))
    wanted = F.broadcast(seeds.select("seed_id", F.col("song_id").alias("seed_song")).limit(SCAN_SEEDS + 1))
    rows = scores.join(wanted, F.col("song_id") == F.col("seed_song")).select(F.struct(F.lit(0).alias("cut"), "seed_id").alias("seed_id"), "song_id", "vector")
    if rows.count() > SCAN_SEEDS:
        raise ValueError(f"more than {SCAN_SEEDS} seeds")
    rows = rows.select(F.explode(F.array(*[F.lit(c) for c in cuts])).alias("cut"), "*")
    rows = rows.select(F.struct("cut", "seed_id.seed_id").alias("seed_id"), "song_id", "vector").orderBy("seed_id.cut", "song_id", "seed_id.seed_id")
    kind = {f.name: f.dataType.simpleString() for f in scores.schema.fields}
    schema = f"seed_id {rows.schema['seed_id'].dataType.simpleString()}, song_id {kind['song_id']}, seq {kind['seq']}, similarity double"
    few = rows.toArrow().combine_chunks()  # SCAN_SEEDS rows a cut at most
    if not few.num_rows:
        return _best(scores.sparkSession.createDataFrame([], schema), k).select("seed_id.cut", "seed_id.seed_id", "rank", "song_id", "similarity")
    scored = scores.select("song_id", "seq", "vector").mapInArrow(_scanner(few, _cut_product(few, cuts), k), schema)
    return _best(scored, k).select("seed_id.cut", "seed_id.seed_id", "rank", "song_id", "similarity")


def _cut_product(seeds, cuts: list[int]):
    def prepare():
        import numpy as np

        def matrix(table):
            return table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(table.num_rows, -1)

        q = matrix(seeds)[: seeds.num_rows // len(cuts)]  # each cut has the same seeds in the same order

        def product(table):
            x = matrix(table)
            dot, own, other = np.zeros((len(x), len(q))), np.zeros(len(x)), np.zeros(len(q))
            at, out = 0, []
            for cut in cuts:
                dot = dot + x[:, at:cut] @ q[:, at:cut].T
                own, other = own + (x[:, at:cut] ** 2).sum(axis=1), other + (q[:, at:cut] ** 2).sum(axis=1)
                size = np.sqrt(own)[:, None] * np.sqrt(other)[None, :]
                out.append(np.divide(dot, size, out=np.zeros_like(dot), where=size > 0))
                at = cut
            return np.hstack(out)

        return product

    return prepare


def _dense_product(seeds):
    read = unit_matrix()

    def prepare():
        q = read(seeds).T
        return lambda table: read(table) @ q

    return prepare


def _sparse_product(seeds):
    chunk_rows = CHUNK_ROWS

    def prepare():
        import numpy as np

        def cells(table):
            lists = table.column("term_ids").combine_chunks()
            row = np.repeat(np.arange(table.num_rows), np.diff(lists.offsets.to_numpy()))
            weights = table.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return row, lists.flatten().to_numpy(zero_copy_only=False), weights

        row, term, weight = cells(seeds)
        # Only terms of a seed can add to a score.
        used, column = np.unique(term, return_inverse=True)
        q = np.zeros((max(len(used), 1), seeds.num_rows))
        q[column, row] = weight
        buffer = np.zeros((chunk_rows, len(q)))

        def product(table):
            out = np.zeros((table.num_rows, q.shape[1]))
            if not len(used):
                return out
            for at in range(0, table.num_rows, chunk_rows):
                part = table.slice(at, chunk_rows)
                row, term, weight = cells(part)
                column = np.minimum(np.searchsorted(used, term), len(used) - 1)
                hit = used[column] == term
                row, column = row[hit], column[hit]
                buffer[row, column] = weight[hit]
                out[at : at + part.num_rows] = buffer[: part.num_rows] @ q
                buffer[row, column] = 0
            return out

        return product

    return prepare


def _scanner(seeds, prepare, k: int):
    best = best_columns(k)
    rounded = rounder(DIGITS)

    def scan(batches):
        import numpy as np
        import pyarrow as pa

        product = prepare()
        songs = seeds.column("song_id").to_numpy()
        kept = [None] * len(songs)  # per seed: scores, seqs and ids of the k best so far
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by("seq")
            if not table.num_rows:
                continue
            ids = table.column("song_id").to_numpy()
            seqs = table.column("seq").to_numpy()
            every = rounded(product(table)).T
            for s, sims in enumerate(every):
                sims[ids == songs[s]] = -np.inf
                take = best(sims)
                found = (sims[take], seqs[take], ids[take])
                if kept[s] is not None:
                    found = tuple(np.concatenate(p) for p in zip(kept[s], found))
                    order = np.lexsort((found[1], -found[0]))[:k]
                    found = tuple(p[order] for p in found)
                kept[s] = found
        rows = [(s, *found) for s, found in enumerate(kept) if found is not None]
        if rows:
            sims, seqs, ids = (np.concatenate([r[c] for r in rows]) for c in (1, 2, 3))
            seed = np.repeat([r[0] for r in rows], [len(r[1]) for r in rows])
            real = np.isfinite(sims)
            yield pa.RecordBatch.from_arrays(
                [
                    seeds.column("seed_id").combine_chunks().take(pa.array(seed[real])),
                    pa.array(ids[real]),
                    pa.array(seqs[real]),
                    pa.array(sims[real]),
                ],
                ["seed_id", "song_id", "seq", "similarity"],
            )

    return scan


def top_by_cells(vectors: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """Any number of seeds: each distinct song is searched once, in the cells that can answer it."""
    found, _ = search(vectors, k, asking=seeds.select("song_id"))
    wanted = seeds.select("seed_id", F.col("song_id").alias("seed_song"))
    lists = wanted.join(found, F.col("seed_song") == F.col("song_id"))
    return lists.select("seed_id", "rank", F.col("neighbour").alias("song_id"), "similarity")


def top_k(vectors: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """``seed_id, rank, song_id, similarity`` for either kind of vector.

    ``seeds`` holds ``seed_id, song_id``.  Both tables are read more than
    once: pass saved ones.  A few seeds are answered by one scan that moves no
    song, any larger number through the songs' cells; scores and ranks are the
    same either way, and neither emits more than k rows per seed and task.
    """
    few = seeds.limit(SCAN_SEEDS + 1).count() <= SCAN_SEEDS
    return top_by_scan(vectors, seeds, k) if few else top_by_cells(vectors, seeds, k)
