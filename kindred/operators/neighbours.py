"""The k nearest songs of many songs, exactly, without meeting every song.

Songs are gathered into cells around sampled pivots, and large cells again, until a cell fits one task.
Inside its own cell a song finds k neighbours; the score of the last is a floor under its list.  Each
cell also has a bound on the score that any song can have with a member: for term vectors the product
with the largest weight of each term, for dense vectors the angle to the cell's centre less its radius.
A song meets only cells whose bound reaches its floor.  Cells that lie side by side form blocks: a song is
sent by its number alone, first to blocks and then to their cells, and its vector is copied once for each
block with a cell that can hold a better neighbour.  Where vectors have no structure at all no bound excludes
anything; the search then compares everything, as any exact one must.

Equal vectors are searched once: a class of copies is one query, and of its members only the first k+1
can be in anyone's list.  Cells and queries are dealt into chunks of bounded size, so neither a large
class nor a dense region makes a large task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.matrices import SPARSE, pair_filter, rounder, row_scorer, unit_matrix, vector_columns
from kindred.sources.shared import save_stage

DIGITS = 6
#: Scores are rounded, so a bound counts as reached within a rounding step of it.
SLACK = 2e-6
CELL_ROWS = 1_000
#: Cells that one cell is split into at most, and how often it is split.
FAN = 256
LEVELS = 4
#: Balls that bound a leaf of dense vectors together.
BALLS = 16
CHUNK_ROWS = 2_048
#: Cells of a block, and queries that meet a block in one task: its members are copied once for so many.
BLOCK_CELLS = 32
BLOCK_QUERIES = 16_384
#: If queries meet more than one in so many blocks, blocks meet in a cross join and nothing is sent.
FEW_BLOCKS = 8
#: Tasks that a small search is dealt into.
LEAST_TASKS = 12
MOST_TASKS = 4_096
#: Songs with one vector from which their lists are joined in salted shares.
HOT_CLASS = 10_000
ROOT = 0

KEY = ["_k1", "_k2"]


def keyed_vectors(vectors: DataFrame) -> DataFrame:
    """Add a 128-bit key of the vector."""
    cols = vector_columns(vectors)
    return vectors.select("song_id", "seq", *cols, F.xxhash64(*cols).alias("_k1"), F.xxhash64(F.lit(11), *cols).alias("_k2"))


def chunked(df: DataFrame, by: str, rows: int, key: str = "song_id") -> tuple[DataFrame, DataFrame]:
    """Deal the rows of each ``by`` into chunks of some ``rows``; also returns ``by, _chunks``."""
    sizes = df.groupBy(by).agg((F.floor((F.count(F.lit(1)) - 1) / rows) + 1).cast("int").alias("_chunks"))
    many = sizes.where("_chunks > 1").withColumnRenamed(by, "_by")
    dealt = df.join(many, F.col(by) == F.col("_by"), "left").withColumn("_chunk", F.coalesce(F.pmod(F.xxhash64(key), F.col("_chunks")), F.lit(0)).cast("int"))
    return dealt.drop("_by", "_chunks"), sizes


def copied(df: DataFrame, sizes: DataFrame, by: str) -> DataFrame:
    """One copy of the rows of ``by`` for each of its chunks."""
    sizes = sizes.withColumnRenamed(by, "_by")
    return df.join(sizes, F.col(by) == F.col("_by")).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_by", "_chunks")


def _schema(df: DataFrame, *cols: str) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in cols)


# ------------------------------------------------------------------- cells


def _pooled(rows: DataFrame, levels: list[str], least: int) -> DataFrame:
    """Put the members of the smallest cells of a parent together, since too few give no floor."""
    parent, cell = levels[-2:]
    few = rows.groupBy(cell).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") < least).select(F.col(cell).alias("_few"))
    found = rows.join(few, F.col(cell) == F.col("_few"), "left")
    return found.withColumn(cell, F.when(F.col("_few").isNotNull(), F.col(parent) * (FAN + 1)).otherwise(F.col(cell))).drop("_few")


def grown_cells(rows: DataFrame, cols: tuple[str, ...], cell_rows: int, least: int = 0) -> DataFrame:
    """Add the cells of each level and ``_leaf``, whose size is bounded.

    Cells of fewer than ``least`` rows are put together.
    """
    rows, levels = rows.withColumn("_c0", F.lit(ROOT).cast("bigint")), ["_c0"]
    for _ in range(LEVELS):
        cell = levels[-1]
        sizes = rows.groupBy(cell).agg(F.count(F.lit(1)).alias("_size"))
        large = sizes.where(F.col("_size") > 4 * cell_rows)
        if large.isEmpty():
            break
        wanted = F.least(F.lit(FAN), F.ceil(4 * F.col("_size") / cell_rows))
        order = Window.partitionBy(cell).orderBy(F.xxhash64(F.lit(5), "_k1", "_k2"), "seq")
        ranked = rows.select(cell, "seq", *cols, *KEY).withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= FAN)
        pivots = save_stage(ranked.join(large, cell).where(F.col("_rn") <= wanted).select(cell, "_rn", *cols), "pivots")
        dealt, chunks = chunked(rows, cell, CHUNK_ROWS)
        pivots = copied(pivots, chunks, cell)
        child = f"_c{len(levels)}"
        names = [*rows.columns]
        placed = dealt.groupBy(cell, "_chunk").cogroup(pivots.groupBy(cell, "_chunk")).applyInArrow(
            _assigner(cols, cell, child, names, FAN), f"{_schema(rows, *names)}, {child} bigint"
        )
        levels = [*levels, child]
        rows = save_stage(placed, "cells")
        rows = _pooled(rows, levels, least) if least else rows
    # What no pivot could split, such as a crowd of nearly equal vectors, is dealt evenly.
    dealt, _ = chunked(rows, levels[-1], 2 * cell_rows)
    leaf = F.col(levels[-1]) * F.lit(1 << 24) + F.col("_chunk")
    return save_stage(dealt.withColumn("_leaf", leaf).drop("_chunk"), "leaves")


def _assigner(cols, cell: str, child: str, names: list[str], fan: int):
    """The number of the most similar pivot of the cell; a cell without pivots stays whole."""
    scores = row_scorer(cols == SPARSE, DIGITS)
    cols = list(cols)

    def assign(left, right):
        import numpy as np
        import pyarrow as pa

        n = left.num_rows
        nearest = np.zeros(n, "int64")
        if n and right.num_rows:
            right = right.sort_by("_rn")
            both = pa.concat_tables([left.select(cols), right.select(cols)])
            for chunk, sims in scores(both, np.arange(n), n + np.arange(right.num_rows)):
                nearest[chunk] = sims.argmax(axis=1)
        own = left.column(cell).to_numpy()
        return left.select(names).append_column(child, pa.array(own * (fan + 1) + nearest + 1))

    return assign


def leaf_bounds(own: DataFrame, cols) -> DataFrame:
    """The bounds of every leaf and its block, of leaves that follow each other."""
    bounds = own.where("_floor is null").select("_leaf", "_members", *_bound_columns(cols))
    # The window numbers the leaves, not the songs.  A leaf with many members counts as several.
    size = F.greatest(F.lit(1.0), F.col("_members") / CELL_ROWS)
    place = F.sum(size).over(Window.orderBy("_l").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size
    blocks = bounds.select(F.col("_leaf").alias("_l"), "_members").distinct().select("_l", F.floor(place / BLOCK_CELLS).cast("bigint").alias("_block"))
    return save_stage(bounds.join(blocks, F.col("_leaf") == F.col("_l")).drop("_l", "_members"), "bounds")


def _bound_columns(cols) -> list[str]:
    return ["_ids", "_tops"] if cols == SPARSE else ["_centre", "_radius"]


def _bound_schema(cols) -> str:
    return "_ids array<int>, _tops array<double>" if cols == SPARSE else "_centre array<double>, _radius double"


def _bounder(cols):
    """Functions from member vectors, or the bounds of cells, to bounds as Arrow columns."""
    sparse, unit, balls = cols == SPARSE, unit_matrix(), BALLS

    def of_members(table):
        import numpy as np
        import pyarrow as pa

        if sparse:
            ids = table.column("term_ids").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            tops = table.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return merged(ids, tops)
        x = unit(table)
        # Each next ball begins at the vector that is farthest from those chosen.
        near, ball = x @ x[0], np.zeros(len(x), "int64")
        for k in range(1, min(balls, len(x))):
            other = x @ x[near.argmin()]
            ball[other > near], near = k, np.maximum(near, other)
        centres, radii = [], []
        for k in np.unique(ball):
            own = x[ball == k]
            centre = own.sum(axis=0)
            size = np.sqrt(centre @ centre)
            centres.append(centre / size if size > 0 else centre)
            # A vector of zeros has score 0 with everything, which no angle tells: then nothing is excluded.
            lonely = size == 0 or not own.any(axis=1).all()
            radii.append(np.pi if lonely else float(np.arccos(np.clip(own @ centres[-1], -1, 1)).max()))
        return [pa.array(centres, pa.list_(pa.float64())), pa.array(radii)]

    def merged(ids, tops):
        import numpy as np
        import pyarrow as pa

        order = np.lexsort((-tops, ids))
        ids, first = np.unique(ids[order], return_index=True)
        return [pa.array([ids], pa.list_(pa.int32())), pa.array([tops[order][first]], pa.list_(pa.float64()))]

    def of_cells(table):
        import numpy as np
        import pyarrow as pa

        if sparse:
            return merged(*(table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("_ids", "_tops")))
        centres = np.stack([np.asarray(c, "float64") for c in table.column("_centre").to_pylist()])
        radius = table.column("_radius").to_numpy()
        centre = centres.sum(axis=0)
        size = np.sqrt(centre @ centre)
        centre = centre / size if size > 0 else centre
        reach = np.pi if size == 0 else float((np.arccos(np.clip(centres @ centre, -1, 1)) + radius).max())
        return [pa.array([centre], pa.list_(pa.float64())), pa.array([min(reach, np.pi)])]

    return of_members, of_cells


# ----------------------------------------------------------------- own cell


def _best_of(cols, keep: int):
    """Best ``keep`` members for each query: row numbers of queries and members, and scores.

    The first function makes the rows that the second one searches of a table.
    """
    sparse, step = cols == SPARSE, 10.0**-DIGITS
    (prepare, near), rounded = pair_filter(sparse), rounder(DIGITS)

    def search(rows, left, right, seqs, floors):
        import numpy as np

        right = right[np.argsort(seqs[right], kind="stable")]  # ties: lower seq first
        told = [(np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))]
        # Only what may be kept is rounded; rounding moves a score by half a step.
        for row, hit, value in near(rows, left, right, floors - step, keep, step):
            value = rounded(value)
            real = (value >= floors[row]) & ((value > 0) if sparse else True)
            row, hit, value = row[real], hit[real], value[real]
            order = np.lexsort((seqs[hit], -value, row))
            row, hit, value = row[order], hit[order], value[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < keep
            told.append((row[first], hit[first], value[first]))
        return tuple(np.concatenate(x) for x in zip(*told))

    return prepare, search


def own_cells(cols, keep: int, song: str):
    """Per leaf: its bounds, and for each query in it the list it finds there and the floor that follows."""
    (prepare, search), (of_members, _) = _best_of(cols, keep), _bounder(cols)
    lowest = 0.0 if cols == SPARSE else -2.0
    names = ["_leaf", "_members", *KEY, "_floor", "_found", *_bound_columns(cols)]
    cols = list(cols)

    def run(table):
        import numpy as np
        import pyarrow as pa

        n = table.num_rows
        left = np.flatnonzero(table.column("_query").to_numpy(zero_copy_only=False))
        seqs = table.column("seq").to_numpy()
        rows, hits, values = search(prepare(table.select(cols)), left, np.arange(n), seqs, np.full(n, -np.inf))
        counts = np.bincount(rows, minlength=n)[left] if len(left) else np.zeros(0, "int64")
        ends = np.cumsum(counts)
        last = values[np.maximum(ends - 1, 0)] if len(values) else np.zeros(len(left))
        floors = np.where(counts >= keep, last, lowest)
        found = pa.StructArray.from_arrays(
            [table.column("song_id").take(pa.array(hits)).combine_chunks(), pa.array(seqs[hits]), pa.array(values)],
            names=["song_id", "seq", "similarity"],
        )
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype("int32")), found)
        m, bounds = len(left), of_members(table.select(cols))
        b = len(bounds[0])
        queries = pa.table(
            [
                pa.array(np.repeat(table.column("_leaf")[0].as_py(), m + b)),
                pa.array(np.full(m + b, n, "int32")),
                *[pa.concat_arrays([pa.nulls(b, pa.int64()), table.column(c).take(pa.array(left)).combine_chunks()]) for c in ("_k1", "_k2")],
                pa.concat_arrays([pa.nulls(b, pa.float64()), pa.array(floors)]),
                pa.concat_arrays([pa.nulls(b, lists.type), lists]),
                *[pa.concat_arrays([c, pa.nulls(m, c.type)]) for c in bounds],
            ],
            names=names,
        )
        return queries

    schema = (
        f"_leaf bigint, _members int, _k1 bigint, _k2 bigint, _floor double, _found array<struct<song_id:{song},seq:bigint,similarity:double>>, "
        + _bound_schema(tuple(cols))
    )
    return run, schema


# ------------------------------------------------------------------ routing


def _reach(cols, child: str):
    """Which cells may hold a song above the floor of each query: their numbers, and a row of flags per query."""
    sparse = cols == SPARSE
    scores, unit, slack = row_scorer(sparse, 9), unit_matrix(), SLACK
    cols = list(cols)

    def reached(left, right):
        import numpy as np
        import pyarrow as pa

        n, m = left.num_rows, right.num_rows
        floors = left.column("_floor").to_numpy()
        if sparse:
            tops = right.select(["_ids", "_tops"]).rename_columns(cols)
            both = pa.concat_tables([left.select(cols), tops.cast(left.select(cols).schema)])
            for chunk, bound in scores(both, np.arange(n), n + np.arange(m)):
                yield chunk, (bound >= floors[chunk][:, None] - slack) & (bound > 0)
            return
        x = unit(left)
        centres = np.stack([np.asarray(c, "float64") for c in right.column("_centre").to_pylist()])
        radius = right.column("_radius").to_numpy()
        for at in range(0, n, 128):
            chunk = np.arange(at, min(at + 128, n))
            angle = np.arccos(np.clip(x[chunk] @ centres.T, -1, 1)) - radius - slack
            bound = np.cos(np.clip(angle, 0, np.pi))
            bound[~x[chunk].any(axis=1)] = 1.0
            yield chunk, bound >= floors[chunk][:, None] - slack

    def run(left, right):
        import numpy as np

        right = right.sort_by(child)
        ids, first = np.unique(right.column(child).to_numpy(), return_index=True)
        flags = np.zeros((left.num_rows, len(ids)), bool)
        if left.num_rows and right.num_rows:
            for chunk, ok in reached(left, right):
                flags[chunk] = np.logical_or.reduceat(ok, first, axis=1)  # several bounds of one cell
        return ids, flags

    return run


def _router(cols, child: str, names: list[str]):
    """Each query once per child cell that may hold a song above its floor, without its vector."""
    reached = _reach(cols, child)

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        ids, flags = reached(left, right)
        rows, cells = np.nonzero(flags)
        return left.select(names).take(pa.array(rows)).append_column(child, pa.array(ids[cells].astype("int64")))

    return run


def numbered(queries: DataFrame) -> DataFrame:
    """Queries with ``_qid``, by which they are sent; keys and songs may repeat."""
    return save_stage(queries.withColumn("_qid", F.monotonically_increasing_id()), "queries")


def _share(queries: DataFrame) -> int:
    """Queries to a task: as many as a block may meet, or fewer if there would be too few tasks."""
    return max(1, min(BLOCK_QUERIES, queries.count() // LEAST_TASKS))


def _facing(left: DataFrame, right: DataFrame, chunks: DataFrame, by: str):
    """Both sides by ``by`` and chunk, in a task each: their work grows with the pairs, which no size in bytes tells."""
    tasks = min(MOST_TASKS, 2 * (chunks.agg(F.sum("_chunks")).first()[0] or 1))
    left, right = (df.repartition(int(tasks), by, "_chunk").groupBy(by, "_chunk") for df in (left, right))
    return left.cogroup(right)


def _asked(dealt: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries that were sent by number.  Never a broadcast: the files of the numbers tell nothing of their count."""
    return dealt.hint("merge").join(queries, "_qid")


def routed_blocks(queries: DataFrame, bounds: DataFrame, cols) -> DataFrame:
    """``_qid, _block`` of each block with a leaf that may hold a better neighbour."""
    _, of_cells = _bounder(cols)
    bound_cols = _bound_columns(cols)
    merge = _merger(of_cells, "_block", bound_cols)
    merged = bounds.select("_block", *bound_cols).groupBy("_block").applyInArrow(merge, f"_block bigint, {_bound_schema(cols)}")
    dealt, chunks = chunked(queries.withColumn("_root", F.lit(ROOT)), "_root", _share(queries), "_qid")
    blocks = copied(merged.withColumn("_root", F.lit(ROOT)), chunks, "_root")
    sent = _facing(dealt, blocks, chunks, "_root").applyInArrow(
        _router(cols, "_block", ["_qid"]), "_qid bigint, _block bigint"
    )
    return save_stage(sent, "routed")


def routed(queries: DataFrame, bounds: DataFrame, cols, blocks: DataFrame) -> DataFrame:
    """``_qid, _own, _block, _leaf`` of each leaf that may hold a better neighbour; a query's own leaf is left out.

    Not saved: where nothing can be excluded it has a row for each song and leaf.
    """
    dealt, chunks = chunked(blocks, "_block", _share(queries), "_qid")
    leaves = copied(bounds, chunks, "_block")
    asked = _asked(dealt, queries.select("_qid", "_own", "_floor", *cols))
    sent = _facing(asked, leaves, chunks, "_block").applyInArrow(
        _router(cols, "_leaf", ["_qid", "_own", "_block"]), "_qid bigint, _own bigint, _block bigint, _leaf bigint"
    )
    return sent.where("_leaf != _own")


def few_meetings(sent: DataFrame, queries: DataFrame, rows: DataFrame, cols, meet, schema: str) -> DataFrame:
    """``meet(queries, members)`` for every leaf and the queries that were sent to it, block by block.

    Vectors are copied for it, which suits queries that meet few blocks; ``meetings`` suits those that meet most.
    """
    wanted = save_stage(sent.groupBy("_qid", "_block").agg(F.collect_list("_leaf").alias("_leaves")), "wanted")
    dealt, chunks = chunked(wanted, "_block", _share(queries), "_qid")
    asked = _asked(dealt, queries)
    placed = sent.select(F.col("_leaf").alias("_l"), "_block").distinct()
    members = rows.select("song_id", "seq", *cols, "_leaf").join(placed, F.col("_leaf") == F.col("_l")).drop("_l")
    members = copied(members, chunks, "_block")
    return _facing(asked, members, chunks, "_block").applyInArrow(_by_leaf(meet), schema)


def packed(rows: DataFrame, by: str, name: str) -> DataFrame:
    """``by, name``: the rows of each ``by`` as one list, in a partition of its own."""
    return rows.groupBy(by).agg(F.collect_list(F.struct(*[c for c in rows.columns if c != by])).alias(name))


def many_blocks(blocks: DataFrame, queries: DataFrame, bounds: DataFrame) -> bool:
    """Whether queries meet more than one block in FEW_BLOCKS."""
    return blocks.count() * FEW_BLOCKS > queries.count() * bounds.select("_block").distinct().count()


def meetings(queries: DataFrame, bounds: DataFrame, rows: DataFrame, cols, run, schema: str) -> DataFrame:
    """``run`` over every block of queries with every block of members and the bounds of its leaves.

    They meet in a cross join, which reads both again for each meeting and writes neither: what is shuffled is each
    vector once on either side, and what ``run`` returns.
    """
    parts = -(-queries.count() // _share(queries))
    places = bounds.select(F.col("_leaf").alias("_l"), "_block").distinct()
    blocks = places.select("_block").distinct().count()
    number = F.pmod(F.xxhash64("_qid"), F.lit(parts)).cast("int")
    asking = queries.repartitionById(parts, number).withColumn("_part", number).drop("_qid")
    members = rows.select("song_id", "seq", "_leaf", *cols).join(F.broadcast(places) if blocks <= MOST_TASKS else places, F.col("_leaf") == F.col("_l")).drop("_l")
    members = members.repartitionById(blocks, F.col("_block").cast("int"))
    cells = packed(bounds.repartitionById(blocks, F.col("_block").cast("int")), "_block", "_cells")
    left, right = packed(asking, "_part", "_queries"), packed(members, "_block", "_members").join(cells, "_block")
    return left.crossJoin(right).select("_queries", "_members", "_cells").mapInArrow(run, schema)


def met_rows():
    """A reader of the queries, members and cells of each meeting as tables."""

    def read(batches):
        import pyarrow as pa

        def table(column, i):
            return pa.Table.from_batches([pa.RecordBatch.from_struct_array(column.slice(i, 1).flatten())])

        for batch in batches:
            for i in range(batch.num_rows):
                yield tuple(table(batch.column(c), i) for c in ("_queries", "_members", "_cells"))

    return read


def across_leaves(cols):
    """Per meeting: both sides as a table, where the members begin in it, and each leaf's queries and members in it.

    ``later`` leaves out leaves before a query's own.
    """
    reached = _reach(cols, "_leaf")
    cols = list(cols)

    def run(left, right, cells, later: bool = False):
        import numpy as np
        import pyarrow as pa

        n, own = left.num_rows, left.column("_own").to_numpy()
        leaves, ok = reached(left, cells)
        names = ["song_id", "seq", *cols]
        both = pa.concat_tables([left.select(names), right.select(names)])
        member = right.column("_leaf").to_numpy()

        def each():
            for leaf, asked in zip(leaves, ok.T):
                asked = np.flatnonzero(asked & ((own < leaf) if later else (own != leaf)))
                if len(asked):
                    yield asked, n + np.flatnonzero(member == leaf)

        return both, each()

    return run


def _across(cols, keep: int):
    """Per pair of blocks: the lists that queries find in its leaves; each leaf raises their floors for the next."""
    leaves, (prepare, search), meeting = across_leaves(cols), _best_of(cols, keep), met_rows()
    cols = list(cols)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def merged(found):
            row, hit, value, seq = found
            order = np.lexsort((seq, -value, row))
            row, hit, value, seq = (x[order] for x in found)
            first = np.arange(len(row)) - np.searchsorted(row, row) < keep
            return row[first], hit[first], value[first], seq[first]

        for left, right, cells in meeting(batches):
            n = left.num_rows
            both, each = leaves(left, right, cells)
            seqs, floors = both.column("seq").to_numpy(), np.concatenate([left.column("_floor").to_numpy(), np.zeros(right.num_rows)])
            known = prepare(both.select(cols))
            best = tuple(np.zeros(0, t) for t in ("int64", "int64", "float64", "int64"))
            for asked, members in each:
                rows, hits, values = search(known, asked, members, seqs, floors)
                best = merged([np.concatenate(x) for x in zip(best, (rows, hits, values, seqs[hits]))])
                count = np.bincount(best[0], minlength=n)
                full = np.flatnonzero(count >= keep)
                floors[full] = np.maximum(floors[full], best[2][np.cumsum(count)[full] - 1])
            rows, hits, values, seq = best
            found = left.take(pa.array(rows))
            told = [found.column("_k1"), found.column("_k2"), right.column("song_id").take(pa.array(hits - n)), pa.array(seq), pa.array(values)]
            yield from pa.table(told, names=["_k1", "_k2", "song_id", "seq", "similarity"]).to_batches()

    return run


def _by_leaf(meet):
    def run(left, right):
        import numpy as np
        import pyarrow as pa

        lists = left.column("_leaves").combine_chunks()
        query = np.repeat(np.arange(left.num_rows), np.diff(lists.offsets.to_numpy()))
        sent, own = lists.flatten().to_numpy(zero_copy_only=False), right.column("_leaf").to_numpy()
        order, members = np.argsort(sent, kind="stable"), np.argsort(own, kind="stable")
        sent, query, own = sent[order], query[order], own[members]
        left = left.drop_columns(["_leaves"])
        told = [meet(left.slice(0, 0), right.slice(0, 0))]
        for leaf in np.unique(sent):
            q, m = (slice(*np.searchsorted(x, [leaf, leaf + 1])) for x in (sent, own))
            told.append(meet(left.take(pa.array(query[q])), right.take(pa.array(members[m]))))
        return pa.concat_tables(told)

    return run


def _merger(of_cells, cell: str, bound_cols: list[str]):
    def run(table):
        import pyarrow as pa

        return pa.table([table.column(cell).slice(0, 1).combine_chunks(), *of_cells(table)], names=[cell, *bound_cols])

    return run


def _met(cols, keep: int):
    """The best members of a leaf for the queries that were sent to it."""
    prepare, search = _best_of(cols, keep)
    cols = list(cols)

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        n, m = left.num_rows, right.num_rows
        if not n or not m:
            left, right, n, m = left.slice(0, 0), right.slice(0, 0), 0, 0
        both = pa.concat_tables([left.select(cols), right.select(cols)])
        seqs = np.concatenate([np.zeros(n, "int64"), right.column("seq").to_numpy()])
        floors = np.concatenate([left.column("_floor").to_numpy(), np.zeros(m)])
        rows, hits, values = search(prepare(both), np.arange(n), n + np.arange(m), seqs, floors) if n else (np.zeros(0, "int64"),) * 2 + (np.zeros(0),)
        found = right.take(pa.array(hits - n))
        asked = left.take(pa.array(rows))
        return pa.table(
            [asked.column("_k1"), asked.column("_k2"), found.column("song_id"), found.column("seq"), pa.array(values)],
            names=["_k1", "_k2", "song_id", "seq", "similarity"],
        )

    return run


# ------------------------------------------------------------------- search


def search(vectors: DataFrame, k: int, *, asking: DataFrame | None = None, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, DataFrame]:
    """``song_id, rank, neighbour, similarity`` for every song, or for the ``song_id`` of ``asking``.

    Also returns the work that was done: ``step, queries, pairs`` for the songs' own cells and for those
    they were sent to.  ``vectors`` is read more than once: pass a saved table.
    """
    cols, keep = vector_columns(vectors), k + 1
    keyed = keyed_vectors(vectors.withColumn("seq", F.col("seq").cast("bigint")))
    song = vectors.schema["song_id"].dataType.simpleString()
    alike = Window.partitionBy(*KEY, *cols).orderBy("seq")
    rows = keyed.withColumn("_rn", F.row_number().over(alike)).where(F.col("_rn") <= keep)
    first = F.col("_rn") == 1
    if asking is None:
        rows = rows.withColumn("_query", first)
    else:
        classes = keyed.join(asking.select("song_id").distinct(), "song_id").select(*KEY).distinct().withColumn("_asked", F.lit(True))
        rows = rows.join(classes, KEY, "left").withColumn("_query", first & F.coalesce("_asked", F.lit(False))).drop("_asked")
    rows = save_stage(rows.drop("_rn"), "neighbour-rows")

    rows = grown_cells(rows, cols, cell_rows, 2 * keep)
    run, schema = own_cells(cols, keep, song)
    own = save_stage(rows.groupBy("_leaf").applyInArrow(run, schema), "own-cells")
    asked = own.where("_floor is not null")
    lists = asked.select(*KEY, F.inline("_found"))
    work = own.groupBy(F.lit("own cell").alias("step")).agg(
        F.count("_floor").alias("queries"), F.sum(F.when(F.col("_floor").isNotNull(), F.col("_members").cast("bigint")).otherwise(0)).alias("pairs")
    )
    if own.where("_floor is null").select("_leaf").distinct().limit(2).count() > 1:
        floors = asked.select(*[F.col(c).alias(f"{c}q") for c in KEY], "_floor", F.col("_leaf").alias("_own"))
        same = (F.col("_k1") == F.col("_k1q")) & (F.col("_k2") == F.col("_k2q"))
        queries = numbered(rows.where("_query").select("song_id", "seq", *cols, *KEY).join(floors, same).drop("_k1q", "_k2q"))
        bounds = leaf_bounds(own, cols)
        blocks = routed_blocks(queries, bounds, cols)
        sent = routed(queries, bounds, cols, blocks)
        kind = f"_k1 bigint, _k2 bigint, song_id {song}, seq bigint, similarity double"
        if many_blocks(blocks, queries, bounds):
            lists = lists.unionByName(save_stage(meetings(queries, bounds, rows, cols, _across(cols, keep), kind), "met"))
        else:
            sent = save_stage(sent, "routed")
            lists = lists.unionByName(few_meetings(sent, queries, rows, cols, _met(cols, keep), kind))
        sizes = own.where("_floor is null").select(F.col("_leaf").alias("_l"), "_members").distinct()
        work = work.unionByName(
            sent.groupBy("_leaf").agg(F.count(F.lit(1)).alias("n")).join(sizes, F.col("_leaf") == F.col("_l"))
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("queries"), F.coalesce(F.sum(F.col("n") * F.col("_members")), F.lit(0)).alias("pairs"))
            .select(F.lit("other cells").alias("step"), "queries", "pairs")
        )
    if cols == SPARSE:
        lists = lists.unionByName(_fillers(asked, vectors, keep)).groupBy(*KEY, "song_id", "seq").agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy(*KEY).orderBy(F.desc("similarity"), "seq")
    best = lists.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= keep)
    return _told(keyed, best, asking, k), work


def _fillers(asked: DataFrame, vectors: DataFrame, keep: int) -> DataFrame:
    """Songs at score zero for queries that found fewer than ``keep`` positive scores.

    Such a query is unrelated to all but fewer than ``keep`` songs, so enough of the first 2 * ``keep``
    are at zero; one that is related after all counts with its own score.
    """
    head = vectors.select("song_id", F.col("seq").cast("bigint").alias("seq")).orderBy("seq").limit(2 * keep)
    each = head.agg(F.collect_list(F.struct("song_id", "seq"))).scalar()
    return asked.where("_floor <= 0").select(*KEY, F.explode(each).alias("_f")).select(
        *KEY, "_f.song_id", F.col("_f.seq").alias("seq"), F.lit(0.0).alias("similarity")
    )


def _told(keyed: DataFrame, best: DataFrame, asking: DataFrame | None, k: int) -> DataFrame:
    """The list of each class for each of its songs, without the song itself.

    Songs of a large class meet copies of its list under salts.
    """
    songs = keyed.select("song_id", *KEY)
    if asking is not None:
        songs = songs.join(asking.select("song_id").distinct(), "song_id")
    shares = (F.floor(F.col("_songs") / HOT_CLASS) + 1).cast("int")
    # At most one row for each HOT_CLASS songs.
    hot = songs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_songs")).where(F.col("_songs") > HOT_CLASS).select(*KEY, shares.alias("_shares"))
    salted = songs.join(hot, KEY, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("song_id"), F.col("_shares")), F.lit(0)).cast("int")).drop("_shares")
    entry = F.struct("_place", F.col("song_id").alias("neighbour"), "similarity")
    lists = best.groupBy(*KEY).agg(F.sort_array(F.collect_list(entry)).alias("_list"))  # k+1 entries
    lists = lists.join(hot, KEY, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1))).drop("_shares")
    own = F.filter("_list", lambda e: e["neighbour"] != F.col("song_id"))
    ranked = F.transform(F.slice(own, 1, k), lambda e, i: F.struct((i + 1).alias("rank"), e["neighbour"].alias("neighbour"), e["similarity"].alias("similarity")))
    return salted.join(lists, [*KEY, "_salt"]).select("song_id", F.inline(ranked))


def all_neighbours(vectors: DataFrame, k: int, *, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The k nearest songs of every song: ``seed_id, rank, song_id, similarity``."""
    found, _ = search(vectors, k, cell_rows=cell_rows)
    return found.select(F.col("song_id").alias("seed_id"), "rank", F.col("neighbour").alias("song_id"), "similarity")
