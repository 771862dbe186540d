"""Merkle manifest of a dataset by a butterfly exchange.

Leaves are put in order by one distributed sort and dealt into partitions of FANOUT ** LOCAL
neighbours.  A partition hashes its own lower levels; above them, in round r, the partitions whose
numbers differ in one base-FANOUT digit only meet, swap the roots of their subtrees and each hash the
common ancestor.  After the last round every partition knows the root and all upper siblings of its
leaves, so nothing has to be sent down.  The roots of the groups are the leaves of a second tree that is
built the same way.

A path is an array of (before, after): the siblings to the left and to the right of a node, one entry a
level from the leaf to the root.  Hashes are lowercase hex SHA-256 of digests joined as text.

Defined results: leaves of one group ascend by key (null first) and then by leaf, so rows that repeat
are leaves of their own side by side; a null group is a group and comes first; a lone node is not hashed
again, but a lone node that ends a level of several is; an empty table gives an empty manifest.  Columns
other than those named are not read, so extra ones cannot clash.  Texts are hashed whole at any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.text import compute_once
from kindred.sources.shared import save_stage
from kindred.sources.tables import with_sequence

BITS = 4
FANOUT = 1 << BITS
#: Levels that a partition hashes by itself: 4,096 leaves, some 300 KB.
LOCAL = 3
#: Partitions of one group that read one copy of what lies above the group.
COPY_PARTS = 1024
PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    shown = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown))


def leaf(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def proof_text(path: Column | str) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def fold(start: Column, path: Column | str) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda node, s: digest(s["before"], node, s["after"]))


def _numbered(nodes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``_pos``, the place within the group, and ``_n``, its size.

    Rows are sorted by range, so a group of any size is spread over tasks; only one row per group and
    range is counted up within a group.
    """
    placed = save_stage(with_sequence(nodes, group, *order, name="_seq"), "merkle-order").withColumn("_range", F.shiftright("_seq", 33))
    runs = placed.groupBy(group, "_range").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    by = Window.partitionBy(group)
    before = F.sum("_rows").over(by.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(
        F.col(group).alias("_g"), F.col("_range").alias("_r"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(by).alias("_n")
    )
    found = placed.join(runs, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return found.withColumn("_pos", F.col("_seq") + F.col("_shift")).drop("_seq", "_range", "_g", "_r", "_shift")


def _cut(nodes: Column) -> Column:
    """Nodes in runs of FANOUT."""
    starts = F.sequence(F.lit(0), F.shiftright(F.size(nodes) - 1, BITS))
    return F.transform(starts, lambda i: F.slice(nodes, i * FANOUT + 1, FANOUT))


def _with_levels(parts: DataFrame, local: int) -> DataFrame:
    """Add ``_runs0`` (the leaves in runs) to ``_runs<local>`` (one node); a level of one node stays as it is."""
    parts = compute_once(parts, _runs0=_cut(F.col("_rows.digest")))
    for k in range(local):
        runs = F.col(f"_runs{k}")
        above = _cut(F.transform(runs, lambda r: F.sha2(F.array_join(r, ""), 256)))
        parts = compute_once(parts, **{f"_runs{k + 1}": F.when(F.col("_n") > FANOUT**k, above).otherwise(runs)})
    return parts


def _around(run: Column, at: Column) -> Column:
    """The siblings of node ``at`` (from 0) of a run, before and after it."""
    return F.struct(
        F.array_join(F.slice(run, F.lit(1), at), "").alias("before"),
        F.array_join(F.slice(run, at + 2, FANOUT), "").alias("after"),
    )


def _no_path() -> Column:
    return F.array().cast(PATH)


def _swap(parts: DataFrame, group: str, span: int) -> DataFrame:
    """One round: partitions that differ in the digit worth ``span`` swap digests and hash the ancestor.

    A seat is the lower digits of a partition's number.  Of the last subtree, which may have fewer
    partitions than seats, each one answers for several seats, dealt evenly.
    """
    numbered = parts.select(
        "*",
        F.expr(f"_part div {span * FANOUT}").alias("_run"),
        F.expr(f"(_part div {span}) % {FANOUT}").alias("_digit"),
        F.expr(f"_part % {span}").alias("_low"),
        F.expr(f"least({span}, _parts - (_part div {span}) * {span})").alias("_members"),
    )
    spare = F.col("_low") + F.col("_members")
    others = F.when((F.col("_digit") > 0) & (spare < span), F.sequence(spare, F.lit(span - 1).cast("bigint"), F.col("_members")))
    seats = F.concat(F.array("_low"), F.coalesce(others, F.array().cast("array<bigint>")))
    own = F.when(F.col("_seat") == F.col("_low"), F.struct("_part", "_path"))
    sent = numbered.withColumn("_seat", F.explode(seats)).select(
        group, "_parts", "_run", "_seat", F.struct("_digit", "digest", own.alias("own")).alias("_member")
    )
    # Of a run and a seat there are FANOUT members at most.
    met = sent.groupBy(group, "_parts", "_run", "_seat").agg(F.sort_array(F.collect_list("_member")).alias("_met"))
    met = met.withColumn("_digests", F.col("_met.digest"))
    met = compute_once(met, digest=F.when(F.col("_parts") > span, F.sha2(F.array_join("_digests", ""), 256)).otherwise(F.col("_digests")[0]))
    step = lambda i: F.when(F.col("_parts") > span, F.array(_around(F.col("_digests"), i))).otherwise(_no_path())
    grown = F.transform("_met", lambda m, i: F.struct(m["own"]["_part"].alias("_part"), F.concat(m["own"]["_path"], step(i)).alias("_path")))
    return met.select(group, "_parts", "digest", F.inline(F.filter(grown, lambda m: m["_part"].isNotNull())))


def climb(nodes: DataFrame, group: str, order: list[str], *, local: int = LOCAL) -> tuple[DataFrame, DataFrame]:
    """Trees over the nodes of each group; ``nodes`` holds the group, ``digest`` and what it is ordered by.

    Returns the partitions (group, ``_n``, ``_part``, ``_rows``) and, per partition, ``_parts``, the
    root of its group as ``digest`` and the ``_path`` from its own root up to that one.
    """
    placed = _numbered(nodes, group, [*order, "digest"])
    kept = F.struct("_pos", *[c for c in nodes.columns if c != group])
    size = FANOUT**local
    # A group and part hold FANOUT ** local rows at most.
    parts = placed.groupBy(group, "_n", F.expr(f"_pos div {size}").alias("_part")).agg(F.sort_array(F.collect_list(kept)).alias("_rows"))
    parts = save_stage(parts, "merkle-parts")
    roots = _with_levels(parts, local).select(
        group, "_part", F.expr(f"(_n - 1) div {size} + 1").alias("_parts"), F.col(f"_runs{local}")[0][0].alias("digest"), _no_path().alias("_path")
    )
    roots = save_stage(roots, "merkle-roots")
    many, span = roots.where("_parts > 1"), 1
    most = many.agg(F.max("_parts")).first()[0] or 0
    while span < most:
        many = save_stage(_swap(many, group, span), "merkle-round")
        span *= FANOUT
    return parts, roots.where("_parts = 1").unionByName(many)


def _paths(parts: DataFrame, local: int, above: Column) -> DataFrame:
    """Rows of all partitions with their whole path: their own levels, then ``above``."""

    def path(row, i):
        own = []
        for k in range(local):
            place = F.shiftright(i, k * BITS)
            run = F.get(F.col(f"_runs{k}"), F.shiftright(place, BITS))
            own.append(F.when(F.col("_n") > FANOUT**k, F.array(_around(run, place % FANOUT))).otherwise(_no_path()))
        return row.withField("path", F.concat(*own, above))

    return _with_levels(parts, local).withColumn("_rows", F.transform("_rows", path))


def manifest(nodes: DataFrame, group: str, key: str, *, local: int = LOCAL) -> DataFrame:
    """Every leaf with its group's ``subroot``, the ``root`` and its ``path`` to it.

    ``nodes`` holds the group, the key, ``digest`` (the leaf) and any other columns, which pass through.
    """
    parts, tops = climb(nodes, group, [key], local=local)
    subroots = tops.where("_part = 0").select(F.lit(0).alias("_all"), group, "digest", "_parts")
    groups, whole = climb(subroots, "_all", [group], local=local)
    whole = whole.select("_part", F.col("digest").alias("root"), F.col("_path").alias("_above"))
    named = _paths(groups.join(whole, "_part"), local, F.col("_above"))
    named = named.select("root", F.explode("_rows").alias("_row"))
    # A group of many partitions reads as many copies of what lies above it as keep a key small.
    copies = F.expr(f"_row._parts div {COPY_PARTS}")
    above = named.select(
        F.col(f"_row.{group}").alias("_g"), F.col("_row.digest").alias("subroot"), "root", F.col("_row.path").alias("_upper"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), copies)).alias("_copy"),
    )
    lower = tops.select(
        F.col(group).alias("_g2"), F.col("_part").alias("_p2"), F.col("_path").alias("_middle"), F.expr(f"_part % (_parts div {COPY_PARTS} + 1)").alias("_copy2")
    )
    upper = lower.join(above, F.col("_g2").eqNullSafe(F.col("_g")) & (F.col("_copy2") == F.col("_copy"))).select(
        "_g2", "_p2", "subroot", "root", F.concat("_middle", "_upper").alias("_above")
    )
    every = parts.join(upper, F.col(group).eqNullSafe(F.col("_g2")) & (F.col("_part") == F.col("_p2")))
    done = _paths(every, local, F.col("_above")).select(group, "subroot", "root", F.inline("_rows"))
    return done.drop("_pos")


def of_documents(docs: DataFrame, presented: Column | None = None, *, local: int = LOCAL) -> DataFrame:
    """The manifest of documents: ``doc_id, source, leaf, subroot, root, path``, and ``presented``.

    ``presented`` is a text to check in place of the document's own one; a null leaf means that none
    is.  It gives a leaf that can be folded along the path of the original.
    """
    names = ["doc_id", "source", "lang", "n_chars"]
    meta = [F.col(c) for c in names]
    shown = F.lit(None).cast("string") if presented is None else presented
    texts = compute_once(docs.select(*names, "text"), _shown=shown)
    other = F.when(F.col("_shown").isNotNull(), leaf(*meta, F.col("_shown")))
    leaves = texts.select("source", "doc_id", leaf(*meta, F.col("text")).alias("digest"), other.alias("presented"))
    done = manifest(save_stage(leaves, "merkle-leaves"), "source", "doc_id", local=local)
    return done.select("doc_id", "source", F.col("digest").alias("leaf"), "subroot", "root", "path", "presented")
