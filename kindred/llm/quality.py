"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules look at one text: its words, symbols, repeated lines and repeated word windows.  The
method looks across documents: normalised lines are hashed, distinct documents are counted per host
and line, lines above the limit are removed, and a document that loses most of its words is
rejected.  Documents with the same text count once, since copies are another stage's work and would
make every line of a copied article look like a footer.  ``clean``, which feeds that stage, counts near
copies once as well; ``judge`` is fixed by its SQL to equal texts.

Near copies of a host are found among the texts that hold a line above the limit.  Each text has a
sketch, its ``SKETCH`` least hashes of four-word shingles.  The least text among those that share one
of its ``KEYS`` least hashes is its leader if their sketches put the share of common shingles at
``LEAST_COMMON`` percent or more (three standard errors below 0.8, the limit of the Jaccard join), and
texts with the same leader count as one document.

A row is identified by a hash of its id, host and text, so rows without id or with the same id keep
their own verdicts.  Counting is partial before each shuffle; lines above the limit are matched with
their documents under a salt, so a line that a third of a host's documents share is spread out.

Defined results: a null text is an empty one and fails the base rules; a null host is a host of its
own; repeated rows get the same verdict and are all returned; other columns pass through ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.text import compute_once
from kindred.sources.shared import broadcast_if_bounded, save_stage

#: Fixed values of the base rules.
SPACE = r"[\x20\x09-\x0D]+"
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: A line is removed when more distinct documents of its host have it.
MOST_DOCUMENTS = 20
#: A document is rejected when less than this percentage of its words remains.
LEAST_LEFT = 30
SALTS = 32
#: Near copies: hashes in a sketch, those of them that texts meet by, and the least common percentage.
SKETCH, KEYS, LEAST_COMMON = 64, 16, 65
BROADCAST_TEXTS = 1_000_000
FIGURES = ("word_chars", "n_words", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def lines(text: Column) -> Column:
    """The lines that have a word, normalised: lower case, single spaces."""
    normal = F.transform(F.split(text, "\n"), lambda x: F.lower(F.trim(F.regexp_replace(x, SPACE, " "))))
    return F.array_remove(normal, "")


def _paired(df: DataFrame, step: int) -> DataFrame:
    """Windows of twice the width from windows of ``step`` words."""
    far = F.slice("h", step + 1, F.size("h"))
    return df.withColumn("h", F.zip_with("h", far, lambda a, b: F.xxhash64(a, b)))


def _repeated_words(h: Column) -> Column:
    """Words that windows which occur more than once cover; ``h`` holds the hash of each window."""
    pairs = F.array_sort(F.transform(h, lambda x, k: F.struct(x.alias("x"), k.alias("k"))))
    met = F.zip_with(
        pairs, F.slice(pairs, 2, F.size(h)), lambda a, b: F.when(a["x"] == b["x"], F.array(a["k"], b["k"])).otherwise(F.array().cast("array<int>"))
    )
    at = F.array_sort(F.array_distinct(F.flatten(met)))
    gaps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(0), lambda s, x: s + x)
    return F.when(F.size(F.array_distinct(h)) < F.size(h), covered).otherwise(0)


def base(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the figures of the base rules; they replace input columns of their names."""
    df = df.drop(*FIGURES, "h", "with_word")
    whole = F.coalesce(F.col(text), F.lit(""))
    with_word = F.filter(F.split(whole, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    chars = lambda removed: F.char_length(F.translate(whole, removed, ""))
    counted = df.select(
        "*",
        chars(SPACES).cast("long").alias("word_chars"),
        (F.char_length(whole) - chars(SYMBOLS)).cast("long").alias("n_symbols"),
        with_word.alias("with_word"),
        F.transform(words(whole), lambda w: F.xxhash64(w)).alias("h"),
    )
    counted = counted.select(
        *[c for c in counted.columns if c != "with_word"],
        (F.size("with_word") - F.size(F.array_distinct("with_word"))).cast("long").alias("n_dup_lines"),
        F.size("h").cast("long").alias("n_words"),
    )
    width = 1
    while width < WINDOW:
        counted, width = _paired(counted, width), 2 * width
    complete = F.slice("h", F.lit(1), F.greatest(F.size("h") - (WINDOW - 1), F.lit(0)))
    counted = counted.withColumn("h", complete).withColumn("n_repeat_words", _repeated_words(F.col("h")).cast("long")).drop("h")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _row() -> Column:
    return F.xxhash64("doc_id", "source", "text")


def _text_keys() -> list[Column]:
    return [F.coalesce("source", F.lit("")).alias("host"), F.col("source").isNull().alias("unknown"), F.xxhash64("text").alias("same")]


def _with_lines(found: DataFrame, above: DataFrame) -> DataFrame:
    """The rows of ``found`` whose line is in ``above``."""
    key = ["host", "unknown", "line"]
    salted = above.select(*key, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return found.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted.hint("merge"), [*key, "salt"]).drop("salt")


def sketched(df: DataFrame) -> DataFrame:
    """Replace ``text`` by its sketch, which is empty for a text of less than four words."""
    hashes = F.transform(words(F.lower(F.coalesce("text", F.lit("")))), lambda w: F.xxhash64(w))
    cut = _paired(_paired(df.withColumn("h", hashes).drop("text"), 1), 2)
    complete = F.slice("h", F.lit(1), F.greatest(F.size("h") - 3, F.lit(0)))
    return compute_once(cut, sketch=F.slice(F.sort_array(F.array_distinct(complete)), 1, SKETCH)).drop("h")


def _sketches(docs: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """(host, unknown, same, sketch) of the given texts, each once per host; no text is shuffled."""
    given, small = broadcast_if_bounded(texts, most)
    whole = docs.filter(F.col("text").isNotNull()).select(*_text_keys(), "text")
    if small:
        whole = whole.join(given, "same", "left_semi")
    cut = sketched(whole)
    if not small:
        cut = cut.join(given, "same", "left_semi")
    return cut.dropDuplicates(["host", "unknown", "same"])


def leaders(sketches: DataFrame, host: list[str]) -> DataFrame:
    """(*host, same, leader) of the texts that are near copies of a lesser one with equal ``host`` columns."""
    keys = sketches.select(*host, "same", F.explode(F.slice("sketch", 1, KEYS)).alias("key"))
    met = keys.groupBy(*host, "key").agg(F.min("same").alias("leader"), F.count("*").alias("n")).filter("n > 1").drop("n")
    met = met.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = lambda df: df.withColumn("salt", F.pmod("same", F.lit(SALTS)).cast("int"))
    pairs = salted(keys).join(met.hint("merge"), [*host, "key", "salt"]).filter("leader < same").select(*host, "same", "leader").distinct()
    first = sketches.select(*host, F.col("same").alias("leader"), F.col("sketch").alias("other")).join(pairs.select(*host, "leader").distinct(), [*host, "leader"], "left_semi")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sides = salted(pairs.join(sketches, [*host, "same"])).join(first.hint("merge"), [*host, "leader", "salt"])
    least = F.slice(F.sort_array(F.array_union("sketch", "other")), 1, SKETCH)
    common = F.size(F.array_intersect(least, F.array_intersect("sketch", "other")))
    return sides.filter(100 * common >= LEAST_COMMON * F.size(least)).groupBy(*host, "same").agg(F.min("leader").alias("leader"))


def line_hits(docs: DataFrame, most_documents: int = MOST_DOCUMENTS, fold: bool = False, broadcast_texts: int = BROADCAST_TEXTS) -> DataFrame:
    """(row, line, n_words) of the lines that are above the limit, once per place where they stand.

    With ``fold``, near copies count as one document.
    """
    found = docs.filter(F.col("text").isNotNull()).select(_row().alias("row"), *_text_keys(), F.explode(lines(F.col("text"))).alias("line"))
    found = found.select("row", "host", "unknown", "same", F.xxhash64("line").alias("line"), F.size(F.split("line", " ")).alias("n_words"))
    key = ["host", "unknown", "line"]
    above = found.groupBy(*key).agg(F.countDistinct("same").alias("n")).filter(F.col("n") > most_documents)
    hits = _with_lines(found, above)
    if fold:
        # Folding only lowers a count, so lines and texts that are not in these hits are settled.
        hits = save_stage(hits, "quality-lines")
        sketches = save_stage(_sketches(docs, hits.select("same").distinct(), broadcast_texts), "quality-sketches")
        each = hits.select(*key, "same").distinct().join(leaders(sketches, ["host", "unknown"]), ["host", "unknown", "same"], "left")
        groups = each.groupBy(*key).agg(F.countDistinct(F.coalesce("leader", "same")).alias("n"))
        hits = _with_lines(hits, groups.filter(F.col("n") > most_documents))
    return hits.select("row", "line", "n_words")


def judge(docs: DataFrame, most_documents: int = MOST_DOCUMENTS, least_left: int = LEAST_LEFT) -> DataFrame:
    """Base figures, the words that stood in removed lines, and whether the document is kept."""
    hits = line_hits(docs, most_documents).groupBy("row").agg(F.sum("n_words").alias("removed"))
    # A row that repeats has its hits counted once per copy: divide by the copies.
    figures = base(docs.select("doc_id", "source", "text").withColumn("row", _row())).drop("text", "source")
    copies = figures.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in figures.columns if c not in ("row", "doc_id")], F.count("*").alias("copies"))
    joined = copies.join(hits, "row", "left").withColumn("removed_words", F.coalesce(F.expr("removed div copies"), F.lit(0)))
    left = 100 * (F.col("n_words") - F.col("removed_words")) >= least_left * F.col("n_words")
    judged = joined.withColumn("kept", ~F.col("base_failed") & left)
    return judged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies", "removed")


def clean(docs: DataFrame, most_documents: int = MOST_DOCUMENTS, least_left: int = LEAST_LEFT) -> DataFrame:
    """The kept documents, without the lines above the limit; other columns pass through."""
    hits = line_hits(docs, most_documents, fold=True).groupBy("row").agg(F.collect_set("line").alias("drop"))
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("doc")
    # Verdicts are computed once: a filter on an ordinary column would run its expressions again.
    marked = base(docs.select(_row().alias("row"), "text", whole))
    marked = compute_once(marked, failed=F.col("base_failed"), total=F.col("n_words")).select("row", "text", "doc", "failed", "total")
    marked = marked.filter(~F.col("failed")).join(hits, "row", "left")
    normal = lambda x: F.lower(F.trim(F.regexp_replace(x, SPACE, " ")))
    stays = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("drop", F.xxhash64(normal(x))))
    cut = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n"))
    cleaned = compute_once(marked, cut=cut)
    left = F.when(F.col("drop").isNull(), F.col("total")).otherwise(F.size(words(F.col("cut"))))
    kept = cleaned.filter(100 * left >= least_left * F.col("total"))
    return kept.select(*[F.col("cut").alias("text") if c == "text" else F.col(f"doc.{c}").alias(c) for c in docs.columns])
