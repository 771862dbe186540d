"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders, so that a question whose parameters were changed
has the same template.  Every window of a benchmark item's template is hashed; a text is cut into
windows of that width end to end, so any shared run of ``2 * WIDTH - 1`` tokens holds a whole window
of the text, whatever the offset.  Windows meet in a hash join.  Each hit fixes an alignment of the
item with the text, along which every run of equal template tokens is judged, and the values in its
slots must be consistent: one value of the item always stands for one value in the text.  A run in
which numbers, units or names conflict is cut into its longest stretches without conflict, each judged
by itself, so a passage copied word for word beside a changed value is still found.

Windows of the benchmark are rows of fixed width (a hash and a place, no text) and are broadcast only
after counting that they are few; beyond that both sides are joined by a shuffle of narrow rows, with a
salt that splits a window which a third of all texts hold.  The items' own tokens meet the hits
afterwards, by broadcast only if their bytes are few.  Hits are grouped by text, item and offset, so
neither a passage in a third of all texts nor a hot source makes a large group.  Texts are read once
for windows of all widths.

Defined results: null or empty texts and items match nothing; an item of fewer than 6 tokens is too
short to tell within a text and matches a text that consists of just these tokens; one of up to 10
tokens is searched with narrower windows; very long texts are cut into windows whole, as linear work;
rows that repeat give one match; rows without id are told apart by their text; other columns pass
through ``remove``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.text import compute_once
from kindred.sources.shared import broadcast_if_bounded, save_stage

WIDTH, SHORTEST, RUN, LITERAL = 6, 6, 13, 5
#: The width that stands for a whole short item or text.
WHOLE = 0
#: Rows of some 50 bytes; bytes of all items' tokens; parts of a hot key in the shuffled joins.
BROADCAST_WINDOWS, BROADCAST_ITEMS, SALTS = 1_000_000, 32 << 20, 16
#: Units that are slots where they follow a number.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg pound pounds ounce ounces ton tons ml l liter liters litre litres "
    "second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents "
    "degree degrees meter meters metre metres gram grams kilogram kilograms kilometer kilometers"
).split()
#: Private characters that mark a name, a number, a unit, and a separator inside a number.
NAME, NUMBER, UNIT, POINT = "\ue001", "\ue002", "\ue003", "\ue004"


def marked(text: Column) -> Column:
    """Lower-case tokens with single spaces; names and units carry a mark, numbers stay as written."""
    plain = F.translate(F.coalesce(text, F.lit("")), NAME + NUMBER + UNIT + POINT, "    ")
    named = F.regexp_replace(plain, r"(?<=[^.!?\s][ ])(?=\p{Lu}\p{Ll}+\b)", NAME)
    joined = F.regexp_replace(F.lower(named), r"(?<=\p{Nd})[.,:/](?=\p{Nd})", POINT)
    spaced = F.trim(F.regexp_replace(joined, rf"[^\p{{L}}\p{{M}}\p{{N}}{NAME}{POINT}]+", " "))
    apart = F.regexp_replace(spaced, rf"(?<=\p{{Nd}})(?=(?:{'|'.join(UNITS)})(?: |$))", " ")
    return F.regexp_replace(apart, rf"(?<=\p{{Nd}} )(?=(?:{'|'.join(UNITS)})(?: |$))", UNIT)


def template(tokens: Column) -> Column:
    """Marked tokens with each slot's value left out."""
    kinds = F.regexp_replace(tokens, rf"([{NAME}{UNIT}])[^ ]+", "$1")
    return F.regexp_replace(kinds, r"(?<![^ ])\p{Nd}[^ ]*", NUMBER)


def _name(*columns: str) -> Column:
    """128 bits that stand for a row."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))


def _whole(text: Column) -> Column:
    """Hash of a whole marked text, whatever its names and units are written like."""
    return F.xxhash64(F.translate(text, NAME + UNIT, ""))


def _items(items: DataFrame) -> DataFrame:
    """(item, item_id, marked, n), once per id and text."""
    cut = items.select("item_id", marked(F.col("text")).alias("marked")).filter("marked <> ''")
    return cut.select(_name("item_id", "marked").alias("item"), "item_id", "marked", F.size(F.split("marked", " ")).alias("n")).dropDuplicates(["item"])


def _item_windows(items: DataFrame) -> DataFrame:
    """(hash, width, item, n, at) of every window of every item; a short item is one window."""
    width = F.least(F.lit(WIDTH), F.floor((F.col("n") + 1) / 2).cast("int"))
    cut = items.filter(F.col("n") >= SHORTEST).select("item", "n", F.split(template(F.col("marked")), " ").alias("kinds"), width.alias("width"))
    cut = cut.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("width"))))
    window = F.array_join(F.slice("kinds", F.col("at") + 1, F.col("width")), " ")
    short = items.filter(F.col("n") < SHORTEST).select(_whole(F.col("marked")).alias("hash"), F.lit(WHOLE).alias("width"), "item", "n", F.lit(0).alias("at"))
    return cut.select(F.xxhash64(window).alias("hash"), "width", "item", "n", "at").unionByName(short)


def _row() -> Column:
    return _name("doc_id", "text")


def _texts(docs: DataFrame) -> DataFrame:
    named = docs.filter(F.col("text") != "").select(_row().alias("row"), "doc_id", "text")
    return compute_once(named, marked=marked(F.col("text"))).drop("text")


def _text_windows(docs: DataFrame, widths: list[int]) -> DataFrame:
    """(row, doc_id, marked, hash, width, from) of windows that lie end to end, and of whole short texts."""
    cut = compute_once(_texts(docs), kinds=F.concat(template(F.col("marked")), F.lit(" ")))

    def of(width):
        if width == WHOLE:
            whole = F.struct(_whole(F.col("marked")).alias("hash"), F.lit(WHOLE).alias("width"), F.lit(0).alias("from"))
            short = (F.col("marked") != "") & ~F.col("marked").rlike(rf"^(?:[^ ]+ ){{{SHORTEST - 1}}}")
            return F.when(short, F.array(whole)).otherwise(F.array().cast("array<struct<hash:bigint,width:int,from:int>>"))
        pieces = F.regexp_extract_all("kinds", F.lit(rf"((?:[^ ]+ ){{{width}}})"), F.lit(1))
        return F.transform(pieces, lambda p, k: F.struct(F.xxhash64(F.rtrim(p)).alias("hash"), F.lit(width).alias("width"), (k * width).alias("from")))

    return cut.select("row", "doc_id", "marked", F.explode(F.concat(*map(of, widths))).alias("w")).select("row", "doc_id", "marked", "w.*")


def _aligned(found: DataFrame) -> DataFrame:
    """The text's tokens that lie beside the item, once per text, item and offset."""
    part = F.slice(F.split("marked", " "), F.greatest("shift", F.lit(0)) + 1, F.col("n") - F.greatest(-F.col("shift"), F.lit(0)))
    keys = ["row", "doc_id", "item", "n", "width", "shift"]
    return found.select(*keys, part.alias("part")).groupBy(*keys).agg(F.first("part").alias("part"))


def _salted(df: DataFrame) -> DataFrame:
    """A copy of each row for every salt."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt() -> Column:
    return F.pmod("row.a", F.lit(SALTS)).cast("int")


def _with_items(aligned: DataFrame, items: DataFrame, broadcast_bytes: int) -> DataFrame:
    """Adds item_id and the item's tokens to each alignment."""
    wanted = items.select("item", "item_id", "marked")
    if items.agg(F.coalesce(F.sum(F.octet_length("marked") + 64), F.lit(0)).alias("bytes")).first().bytes <= broadcast_bytes:
        met = aligned.join(F.broadcast(wanted), "item")
    else:
        met = aligned.withColumn("salt", _salt()).join(_salted(wanted), ["item", "salt"])
    return met.withColumn("item", F.slice(F.split("marked", " "), F.greatest(-F.col("shift"), F.lit(0)) + 1, F.col("n"))).drop("marked")


def _stretches(run: Column, slots: Column) -> Column:
    """[from, to) of the longest stretches of a run in which no value of the item stands for two values."""
    clash = lambda s: F.filter(slots, lambda t: (t["k"] < s["k"]) & (t["a"] == s["a"]) & (t["b"] != s["b"]))
    cuts = F.filter(F.transform(slots, lambda s: F.struct(s["k"].alias("k"), F.array_max(F.transform(clash(s), lambda t: t["k"])).alias("last"))), lambda c: c["last"].isNotNull())
    none = F.array().cast("array<struct<from:int,to:int>>")
    piece = lambda a, b: F.array(F.struct(a.alias("from"), b.alias("to")))

    def step(s, c):
        later = c["last"] >= s["from"]
        return F.struct(F.when(later, c["last"] + 1).otherwise(s["from"]).alias("from"), F.when(later, F.concat(s["out"], piece(s["from"], c["k"]))).otherwise(s["out"]).alias("out"))

    return F.aggregate(cuts, F.struct(F.lit(0).alias("from"), none.alias("out")), step, lambda s: F.concat(s["out"], piece(s["from"], F.size(run))))


def _judged(aligned: DataFrame, run: int) -> DataFrame:
    kind = lambda t: F.when(t.rlike(rf"^[{NAME}{UNIT}]"), F.substring(t, 1, 1)).when(t.rlike(r"^\p{Nd}"), NUMBER).otherwise(t)
    width = F.least(F.size("item"), F.size("part"))
    sides = F.zip_with(
        F.slice("item", F.lit(1), width), F.slice("part", F.lit(1), width), lambda a, b: F.struct(a.alias("a"), b.alias("b"), (kind(a) == kind(b)).alias("same"))
    )
    need = F.least(F.lit(run), F.col("n"))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("k"), F.array().cast("array<struct<from:int,size:int>>").alias("out"))
    ended = lambda s: F.when(s["now"] >= need, F.concat(s["out"], F.array(F.struct((s["k"] - s["now"]).alias("from"), s["now"].alias("size"))))).otherwise(s["out"])

    def step(s, x):
        return F.struct(F.when(x["same"], s["now"] + 1).otherwise(0).alias("now"), (s["k"] + 1).alias("k"), F.when(x["same"], s["out"]).otherwise(ended(s)).alias("out"))

    ran = aligned.withColumn("sides", sides).withColumn("r", F.explode(F.aggregate("sides", start, step, ended)))
    ran = ran.select("doc_id", "row", "item_id", "n", F.slice("sides", F.col("r.from") + 1, F.col("r.size")).alias("run"))
    values = F.transform("run", lambda x, k: F.struct(k.alias("k"), x["a"].alias("a"), x["b"].alias("b")))
    ran = ran.withColumn("slots", F.filter(values, lambda x: x["a"].rlike(rf"^[{NAME}{UNIT}\p{{Nd}}]")))
    ran = ran.withColumn("piece", F.explode(_stretches(F.col("run"), F.col("slots"))))
    ran = ran.withColumn("slots", F.filter("slots", lambda x: (x["k"] >= F.col("piece.from")) & (x["k"] < F.col("piece.to")))).withColumn("n_tokens", F.col("piece.to") - F.col("piece.from"))
    return ran.filter((F.col("n_tokens") >= need) & (F.col("n_tokens") - F.size("slots") >= LITERAL)).select(
        "row", "doc_id", "item_id", "n_tokens", F.size("slots").alias("n_slots"),
        F.size(F.filter("slots", lambda x: x["a"] != x["b"])).alias("n_changed"),
    )


def _equal(aligned: DataFrame) -> DataFrame:
    """Whole short items, word for word."""
    bare = lambda tokens: F.translate(F.array_join(tokens, " "), NAME + UNIT, "")
    slots = F.size(F.filter("item", lambda t: t.rlike(rf"^[{NAME}{UNIT}\p{{Nd}}]")))
    return aligned.filter(bare("item") == bare("part")).select("row", "doc_id", "item_id", F.col("n").alias("n_tokens"), slots.alias("n_slots"), F.lit(0).alias("n_changed"))


def matches(
    docs: DataFrame, items: DataFrame, run: int = RUN, broadcast_windows: int = BROADCAST_WINDOWS, broadcast_items: int = BROADCAST_ITEMS
) -> DataFrame:
    """(row, doc_id, item_id, n_tokens, n_slots, n_changed) of texts that hold a benchmark passage.

    A match is a run of ``run`` template tokens, or of the whole item if that is shorter; the longest
    is returned for each text and item.
    """
    items = save_stage(_items(items), "benchmark-items")
    windows = _item_windows(items)
    side, small = broadcast_if_bounded(windows, broadcast_windows)
    widths = sorted(r.width for r in windows.select("width").distinct().collect()) or [WIDTH]  # from 3 to 6, and whole
    pieces = _text_windows(docs, widths)
    placed = ["row", "doc_id", "item", "n", "width", (F.col("from") - F.col("at")).alias("shift")]
    if small:
        found = pieces.join(side, ["hash", "width"]).select(*placed, "marked")
    else:
        narrow = pieces.drop("marked").withColumn("salt", _salt()).join(_salted(windows), ["hash", "width", "salt"])
        found = narrow.select(*placed).distinct().join(_texts(docs).drop("doc_id").dropDuplicates(["row"]), "row")
    aligned = _with_items(_aligned(found), items, broadcast_items)
    judged = _judged(aligned.filter(F.col("width") != WHOLE), run)
    if WHOLE in widths:
        judged = judged.unionByName(_equal(aligned.filter(F.col("width") == WHOLE)))
    best = F.max(F.struct("n_tokens", "n_slots", "n_changed")).alias("best")
    return judged.groupBy("row", "doc_id", "item_id").agg(best).select("row", "doc_id", "item_id", "best.*")


def remove(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no benchmark passage."""
    found = matches(docs, items).select("row").distinct()
    keyed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), _row().alias("row"))
    return keyed.join(found, "row", "left_anti").select("doc.*")
