import hashlib

import pytest

pytest.importorskip("kindred.llm")
from pyspark.sql import functions as F  # noqa: E402

from kindred.llm import merkle  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, digest string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    doc_id, text, lang, source, n_chars = row[:5]
    out = ""
    for v in (doc_id, source, lang, n_chars, text):
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(out)


def plain_tree(nodes):
    """Root and, per node, the (before, after) texts of every level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = i // 16 * 16
            paths[k].append(("".join(level[run:i]), "".join(level[i + 1 : run + 16])))
        level = [h(*level[i : i + 16]) for i in range(0, len(level), 16)]
        at = [i // 16 for i in at]
    return level[0], paths


def plain_manifest(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, plain_leaf(row)))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(by_source[s])]) for s in order]
    root, upper = plain_tree([t[0] for t in trees])
    out = []
    for s, (subroot, paths), above in zip(order, trees, upper, strict=True):
        for (known, doc_id, leaf), path in zip(sorted(by_source[s]), paths, strict=True):
            out.append((doc_id if known else None, s, leaf, subroot, root, tuple(path + above)))
    return sorted(out, key=str)


def made(spark, rows, local):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    got = merkle.of_documents(df, local=local).collect()
    return sorted(((r.doc_id, r.source, r.leaf, r.subroot, r.root, tuple((p.before, p.after) for p in r.path)) for r in got), key=str)


@pytest.mark.parametrize("local", [1, 2])
def test_every_path_equals_a_plain_tree(spark, local):
    sizes = {"a": 1, "b": 2, "é": 16, "c": 17, None: 33, "hot": 700, "d": 257, "": 4}
    sizes |= {f"s{k}": 1 for k in range(30)}
    rows, n = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            rows.append((n, f"Text {n}" if n % 7 else None, "en" if n % 3 else None, source, n if n % 5 else None))
            n += 1
    assert made(spark, rows, local) == plain_manifest(rows)


def test_null_ids_and_repeated_rows_are_leaves_of_their_own(spark):
    rows = [(None, "x", "en", "s", 1)] * 20 + [(5, "", "en", "s", 1)] * 3 + [(5, "Z", "en", "s", 1), (None, None, None, None, None)]
    assert made(spark, rows, 1) == plain_manifest(rows)


def test_one_leaf_and_no_leaf(spark):
    assert made(spark, [(1, "x" * 300_000, "en", "s", 1)], 1) == plain_manifest([(1, "x" * 300_000, "en", "s", 1)])
    assert made(spark, [], 1) == []


def test_folding_finds_a_changed_leaf(spark):
    rows = [(k, "Ab" if k % 2 else "ab", "en", f"s{k % 3}", 2) for k in range(100)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    done = merkle.of_documents(df, F.lower("text"), local=1)
    same = done.withColumn("same", merkle.fold(F.col("presented"), "path") == F.col("root")).collect()
    assert {(r.doc_id % 2, r.same) for r in same} == {(0, True), (1, False)}


def test_a_round_sends_few_rows_a_partition(spark):
    """No partition of the last, smaller subtree answers for all seats: they are dealt evenly."""
    n = 16 * 16 + 3
    parts = spark.range(n).select(
        F.lit("s").alias("g"), F.lit(n).cast("long").alias("_parts"), F.col("id").alias("_part"), F.sha2(F.col("id").cast("string"), 256).alias("digest"),
        F.array().cast(merkle.PATH).alias("_path"),
    )
    for span in (1, 16, 256):
        parts = merkle._swap(parts, "g", span)
    done = parts.collect()
    root, paths = plain_tree([h(str(k)) for k in range(n)])
    assert len(done) == n and {r.digest for r in done} == {root}
    assert all([(p.before, p.after) for p in r._path] == paths[r._part] for r in done)
