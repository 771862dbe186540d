"""N-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles, and sets are embedded as min-hash vectors.  Equal sets
are folded first.  Then, in several runs at once, each bucket of sets picks ``FAN`` coordinates of
the vector by a hash of its own path, and every set goes to the sub-buckets of its tokens there.
Buckets of one set vanish, small ones are compared at once by their vectors, large ones are split
again; what is still together after ``LEVELS`` is taken as one.  A pair of similarity 0.8 stays
together in a run with probability 0.94, so ``RUNS`` = 3 find over 0.999 of them.

That gives candidate components as stars, not pairs.  Within each, exact similarities are taken from
the whole shingle sets, in blocks: a task compares two blocks and returns, for each set, the number
of its links and one edge towards its root.  No pair is ever a row, links are counted exactly, and
links that all runs missed inside a component are found as well.  The classes are the connected
components of the exact links.

Defined results: similarity is Jaccard of distinct shingles of lower-case words divided by white
space; a text of one to four words is one shingle; a null text or one without words is a class of its
own with no link; rows that repeat are copies of each other and count as links; a class is named by
its smallest id (null if it has none); other columns pass through ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.sources.shared import broadcast_if_bounded, save_stage

SHINGLE, WIDTH = 5, 64
RUNS, FAN, LEVELS, SMALL = 3, 2, 4, 64
#: Similarity is at least NUM / DEN; vectors are compared with a margin of three standard errors.
NUM, DEN, MARGIN = 4, 5, 0.15
BLOCK, PACKED, SALTS = 256, 400, 16
BROADCAST_ROWS = 1_000_000
CHUNK = 1 << 20

_SCALE = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_ODD = _mix(np.arange(1, WIDTH + 1, dtype=np.uint64) * _SCALE) | np.uint64(1)


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str | None, hashes: dict) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(len(w) - SHINGLE + 1, 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(w))):
        h = h * _SCALE + w[k : k + n]
    return np.unique(_mix(h + np.uint64(min(len(w), SHINGLE))))


def vectors(sets: list[np.ndarray]) -> np.ndarray:
    """Min-hash vectors, one row per set; none of the sets may be empty."""
    out = np.empty((len(sets), WIDTH), np.uint32)
    first = 0
    while first < len(sets):
        last, size = first, 0
        while last < len(sets) and (last == first or size + len(sets[last]) <= CHUNK):
            size += len(sets[last])
            last += 1
        h = np.concatenate(sets[first:last])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[first : last - 1]], dtype=np.int64)]).astype(np.int64)
        for k in range(WIDTH):
            out[first:last, k] = np.minimum.reduceat((h * _ODD[k]) >> np.uint64(32), starts)
        first = last
    return out


def _signed(x: np.ndarray | int) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        hashes = _WordHash()
        sets = [shingles(t, hashes) for t in frame["text"]]
        full = [k for k, s in enumerate(sets) if len(s)]
        key = frame["row"].to_numpy(np.int64).copy()
        vector: list[bytes | None] = [None] * len(sets)
        if full:
            key[full] = _signed([int(_mix(np.array([s.sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))[0]) for s in (sets[k] for k in full)])
            for k, v in zip(full, vectors([sets[k] for k in full]), strict=True):
                vector[k] = v.astype("<u4").tobytes()
        yield pd.DataFrame({"doc_id": frame["doc_id"], "row": frame["row"], "s": key, "vector": vector})


def _row():
    return F.xxhash64("doc_id", "text")


def fold(docs: DataFrame) -> DataFrame:
    """(doc_id, row, s, vector): s names the shingle set; vector is null without words."""
    rows = docs.select("doc_id", _row().alias("row"), "text")
    return rows.mapInPandas(_fold, "doc_id long, row long, s long, vector binary")


def _split(rows: DataFrame, level: int) -> DataFrame:
    """Every set of a bucket into the sub-buckets at the coordinates that the bucket's path picks."""
    picks = [F.pmod(F.xxhash64("path", F.lit(level), F.lit(k)), F.lit(WIDTH)).cast("int") for k in range(FAN)]
    token = lambda at: F.substr(F.col("vector"), at * 4 + 1, F.lit(4))
    inner = [F.xxhash64("path", at, token(at)) for at in picks]
    return rows.withColumn("path", F.explode(F.array_distinct(F.array(*inner))))


def candidate_edges(sets: DataFrame) -> DataFrame:
    """(a, b) edges that join the sets of each bucket which may be similar."""
    edges = None
    current = sets.withColumn("path", F.explode(F.array(*[F.xxhash64(F.lit("run"), F.lit(k)) for k in range(RUNS)])))
    for level in range(LEVELS):
        current = _split(current, level)
        narrow = current.select("path", "s")
        sizes = narrow.groupBy("path").agg(F.count("*").alias("n"), F.min("s").alias("least")).filter("n > 1")
        # A path that many sets share meets its size under a salt.
        sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = current.withColumn("salt", F.pmod("s", F.lit(SALTS)).cast("int"))
        current = save_stage(salted.join(sizes.hint("merge"), ["path", "salt"]).drop("salt"), f"paths-{level}")
        small = current.filter(F.col("n") <= SMALL).groupBy("path").applyInPandas(_stars, "a long, b long")
        edges = small if edges is None else edges.unionByName(small)
        current = current.filter(F.col("n") > SMALL)
        if level == LEVELS - 1:
            edges = edges.unionByName(current.filter("s > least").select(F.col("s").alias("a"), F.col("least").alias("b")))
        current = current.drop("n", "least")
    return save_stage(edges.distinct(), "candidates")


def _roots(similar: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id that each row reaches through a symmetric matrix of links."""
    label = ids.copy()
    while True:
        near = np.where(similar, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(label, near)
        if (new == label).all():
            return label
        label = new


def _stars(frame: pd.DataFrame) -> pd.DataFrame:
    """One edge from each set of a small bucket to the least one it reaches by similar vectors."""
    ids = frame["s"].to_numpy(np.int64)
    v = np.stack([np.frombuffer(x, "<u4") for x in frame["vector"]])
    same = (v[:, None, :] == v[None, :, :]).mean(axis=2)
    root = _roots(same >= NUM / DEN - MARGIN, ids)
    return pd.DataFrame({"a": ids[root != ids], "b": root[root != ids]})


def components(edges: DataFrame) -> DataFrame:
    """(s, c) of every set that has an edge: c is the same for all sets of a connected component.

    Each round maps every vertex to its least neighbour, twice, and contracts the edges; ids are
    hashes, so the number of vertices falls by a constant factor.
    """
    rounds = []
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = save_stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "least")
        far = least.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        parent = save_stage(least.join(far, "p").select("a", F.col("pp").alias("p")), "parent")
        rounds.append(parent)
        one = edges.join(parent, "a").select("b", F.col("p").alias("pa"))
        two = one.join(parent.withColumnRenamed("a", "b"), "b").select(F.col("pa").alias("a"), F.col("p").alias("b"))
        edges = save_stage(two.filter("a <> b").distinct(), "edges")
        if edges.isEmpty():
            break
    labels = rounds[0].withColumnRenamed("a", "s").withColumnRenamed("p", "c")
    for parent in rounds[1:]:
        nxt = parent.select(F.col("a").alias("c"), F.col("p").alias("n"))
        labels = labels.join(nxt, "c", "left").select("s", F.coalesce("n", "c").alias("c"))
    return save_stage(labels, "components")


def _sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        hashes = _WordHash()
        yield pd.DataFrame({"row": frame["row"], "set": [shingles(t, hashes).astype("<u8").tobytes() for t in frame["text"]]})


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, by products of 0/1 columns."""
    a, b = np.concatenate(left), np.concatenate(right)
    ra, rb = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    both = np.intersect1d(a, b)
    ka, kb = np.searchsorted(both, a), np.searchsorted(both, b)
    ina, inb = both[np.minimum(ka, len(both) - 1)] == a if len(both) else np.zeros(len(a), bool), both[np.minimum(kb, len(both) - 1)] == b if len(both) else np.zeros(len(b), bool)
    ka, ra, kb, rb = ka[ina], ra[ina], kb[inb], rb[inb]
    oa, ob = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
    ka, ra, kb, rb = ka[oa], ra[oa], kb[ob], rb[ob]
    total = np.zeros((len(left), len(right)), np.float64)
    step = 4096
    for at in range(0, len(both), step):
        sa, sb = slice(*np.searchsorted(ka, [at, at + step])), slice(*np.searchsorted(kb, [at, at + step]))
        width = min(step, len(both) - at)
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        x[ra[sa], ka[sa] - at] = 1
        y[rb[sb], kb[sb] - at] = 1
        total += x @ y.T
    return total.astype(np.int64)


def _compare(frame: pd.DataFrame) -> pd.DataFrame:
    """Exact links between the sets of a pair of blocks, or within packed small components."""
    out = []
    for _, part in frame.groupby("c", sort=False):
        s, copies = part["s"].to_numpy(np.int64), part["copies"].to_numpy(np.int64)
        sets = [np.frombuffer(x, "<u8") for x in part["set"]]
        size = np.array([len(x) for x in sets])
        mine, lo, hi = part["block"].to_numpy(), int(part["lo"].iloc[0]), int(part["hi"].iloc[0])
        i, j = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
        links = np.zeros(len(s), np.int64)
        near = np.zeros((len(s), len(s)), bool)
        if len(i) and len(j):
            inter = _common([sets[k] for k in i], [sets[k] for k in j])
            linked = (NUM + DEN) * inter >= NUM * (size[i][:, None] + size[j][None, :])
            linked &= s[i][:, None] != s[j][None, :]
            near[np.ix_(i, j)] |= linked
            near[np.ix_(j, i)] |= linked.T
            links[i] += linked @ copies[j]
            if lo != hi:
                links[j] += linked.T @ copies[i]
        out.append(pd.DataFrame({"s": s, "links": links, "root": _roots(near, s)}))
    return pd.concat(out)


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, row, class, class_id, n_links) per document; ``class`` is an internal name."""
    folded = save_stage(fold(docs), "folded")
    sets = folded.groupBy("s").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.first("vector").alias("vector"))
    sets = save_stage(sets, "sets")
    grouped = components(candidate_edges(sets.filter("vector is not null").select("s", "vector")))
    # The whole sets of the candidates, from one row of each.
    many = grouped.groupBy("c").agg(F.count("*").alias("m"))
    nodes = grouped.join(many, "c").join(sets.select("s", "copies", "row"), "s")
    nodes = save_stage(nodes, "nodes")
    wanted, small = broadcast_if_bounded(nodes.select("row"), BROADCAST_ROWS)
    rows = docs.select(_row().alias("row"), "text").join(wanted if small else nodes.select("row"), "row", "left_semi").dropDuplicates(["row"])
    whole = nodes.join(rows.mapInPandas(_sets, "row long, set binary"), "row")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    whole = whole.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int"))
    whole = whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    packs = max(1, nodes.count() // PACKED)
    whole = whole.select(
        "c", "s", "copies", "set", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("c"), F.lit(packs))).otherwise(F.col("c")).alias("pack"), (F.col("blocks") == 1).alias("packed"),
    )
    compared = save_stage(whole.groupBy("pack", "packed", "lo", "hi").applyInPandas(_compare, "s long, links long, root long"), "compared")
    links = compared.groupBy("s").agg(F.sum("links").alias("links"))
    exact = components(compared.filter("s <> root").select(F.col("s").alias("a"), F.col("root").alias("b")).distinct())
    classes = sets.select("s", "copies", "doc_id").join(links, "s", "left").join(exact, "s", "left")
    classes = classes.select("s", "doc_id", F.coalesce("c", "s").alias("class"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    named = classes.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    known = save_stage(classes.drop("doc_id").join(named, "class"), "classes")
    return folded.select("doc_id", "row", "s").join(known, "s").select("doc_id", "row", "class", "class_id", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest id."""
    found = join(docs)
    first = found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("r")).select("r.row")
    keyed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), _row().alias("row"))
    return keyed.join(first.distinct(), "row").groupBy("row").agg(F.first("doc").alias("doc")).select("doc.*")
