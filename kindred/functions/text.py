"""Column expressions for text: cleaning, gates, n-grams, sections.

Everything here is a Column -> Column function built from Spark SQL
functions, so a cleaning pass is a narrow projection on the JVM.

Java and Python disagree on what ``\\w``, ``\\s`` and ``\\b`` mean outside
ASCII.  The classes are therefore spelled out: a word character is a letter,
a number or an underscore in any script, and white space also covers the four
information separators U+001C..U+001F.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import wordlists as wl

_WORD = r"\p{L}\p{N}_"
_SPACE = r"\s\x1c-\x1f"  # together with the (?U) flag

# A text whose line ends are all "\n" can hold none of these any more, so two
# of them are free to serve as marks inside a value.
_LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\x{2028}\x{2029}]"
_OTHER_LINE_END = r"[\x0b\x0c\r\x1c\x1d\x1e\x85\x{2028}\x{2029}]"
_BLOCK_MARK = "\x1d"
_LABEL_MARK = "\x1e"
# Every character of _SPACE, for a trim that looks at the ends of a text alone.
_SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_LINE_SPACE = r"[\t \x1f\xa0\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def compute_once(df: DataFrame, **exprs: Column) -> DataFrame:
    """Add columns whose expressions run exactly once per row.

    A filter on an ordinary computed column is pushed below the projection and
    evaluates the expression a second time.  Predicates are not pushed through
    a generator's own output, so a one-element ``inline`` keeps a costly
    cleaning expression from running twice.
    """
    packed = F.struct(*[e.alias(n) for n, e in exprs.items()])
    return df.select("*", F.inline(F.array(packed)))


def strip_space(col: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.trim(_c(col), F.lit(_SPACES))


# ---------------------------------------------------------------- cleaning


def strip_footer(lowered: Column | str) -> Column:
    """Remove ``<digits>embed...`` from the last line of a lower-cased text."""
    c = _c(lowered)
    footer = r"(?iud)\p{Nd}*embed.*$"  # fixed value
    return F.when(c.contains("embed"), F.regexp_replace(c, footer, "")).otherwise(c)


def strip_brackets(col: Column | str, *, across_lines: bool = False) -> Column:
    """Remove bracketed headers.

    Within one line by default (an empty ``[]`` goes too); ``across_lines``
    lets a bracket close on a later line but needs at least one character.
    """
    bracket = r"\[[^\]]+\]" if across_lines else r"(?d)\[.*?\]"  # fixed values
    return F.regexp_replace(_c(col), bracket, "")


def strip_punctuation(col: Column | str) -> Column:
    """Remove all but letters, numbers and white space; underscores go as well."""
    return F.regexp_replace(_c(col), rf"(?U)[^\p{{L}}\p{{N}}{_SPACE}]", "")


def split_tokens(col: Column | str) -> Column:
    """Split at runs of white space; an empty text has no tokens."""
    return F.filter(F.split(_c(col), rf"(?U)[{_SPACE}]+"), lambda t: t != "")


def drop_stop_words(tokens: Column | str, words: list[str] = wl.STOP_WORDS) -> Column:
    """Remove stop words; a literal list this long becomes a hash-set test."""
    return F.filter(_c(tokens), lambda t: ~t.isin(words))


def clean_tokens(lowered: Column | str, *, across_lines: bool = False) -> Column:
    """Tokens of a lower-cased text: strip footer, brackets and punctuation, split, drop stop words."""
    c = strip_brackets(strip_footer(lowered), across_lines=across_lines)
    words = F.split(strip_punctuation(c), rf"(?U)[{_SPACE}]+")
    return F.filter(words, lambda t: ~t.isin(["", *wl.STOP_WORDS]))


def join_tokens(tokens: Column | str) -> Column:
    return F.array_join(_c(tokens), " ")


def odd_tokens(tokens: Column | str) -> Column:
    """The tokens if their joined text does not tell them apart again (empty, NULL or with a blank), else NULL."""
    t = _c(tokens)
    return F.when((F.size(t) == 0) | F.exists(t, lambda x: x.isNull() | (x == "") | x.contains(" ")), t)


def tokens_of(joined: Column | str, odd: Column | str) -> Column:
    """The tokens behind ``join_tokens`` and ``odd_tokens``, which take less than half their room in a row."""
    return F.coalesce(_c(odd), F.split(_c(joined), " "))


def token_count(processed: Column | str) -> Column:
    """Number of blank-separated tokens; 0 for an empty text."""
    return F.size(F.filter(F.split(_c(processed), " "), lambda t: t != ""))


def truncate_tokens(tokens: Column | str, max_length: int = 256) -> Column:
    return F.slice(_c(tokens), 1, max_length)


# ------------------------------------------------------------------- gates


# The only characters outside ASCII that match an ASCII letter when case is
# ignored and that lower-casing does not turn into that letter.
_CASE_ODD = ["\u0130", "\u0131", "\u017f"]


def _any_true(tests: list[Column]) -> Column:
    return reduce(operator.or_, tests)


def _gate(col: Column | str, lowered: Column | str, phrases: list[str], patterns: list[tuple[str, str]]) -> Column:
    """True where any phrase or pattern occurs, ignoring case.

    Plain substring tests on the lower-cased text are several times faster
    than one case-insensitive alternation, and a pattern is tried only where
    the plain text it needs occurs.  The rare texts whose case does not fold
    that way take the alternation.
    """
    text, low = _c(col), _c(lowered)
    tests = [low.contains(p) for p in phrases]
    tests += [low.contains(needs) & low.rlike(f"(?d){pattern}") for pattern, needs in patterns]
    alternation = "(?iud)" + "|".join(phrases + [pattern for pattern, _ in patterns])
    # They take more than one byte each, which few texts need to be searched for.
    odd = (F.octet_length(text) != F.char_length(text)) & _any_true([text.contains(c) for c in _CASE_ODD])
    return F.when(odd, text.rlike(alternation)).otherwise(_any_true(tests))


def has_narrow_metadata(col: Column | str, lowered: Column | str) -> Column:
    return _gate(col, lowered, wl.METADATA_NARROW, [])


def has_wide_metadata(col: Column | str, lowered: Column | str) -> Column:
    words = [(rf"(?<![{_WORD}]){w}(?![{_WORD}])", w) for w in wl.METADATA_WIDE_WORDS]
    labels = [(rf"(?<![{_WORD}]){w}(?=[{_WORD}])", w) for w in wl.METADATA_WIDE_LABELS]
    return _gate(col, lowered, wl.METADATA_WIDE, words + labels)


def has_prose_signal(col: Column | str, lowered: Column | str) -> Column:
    ends = [(rf"{w}(?![{_WORD}])", w) for w in wl.PROSE_WORD_ENDS]
    return _gate(col, lowered, wl.PROSE_PHRASES, wl.PROSE_PATTERNS + ends)


def type_token_ratio(lowered: Column | str) -> Column:
    """Distinct share of the first 200 ASCII words; NULL below 100 words."""
    # A text that starts with another character has an empty part first; the last part asked for is the rest.
    parts = F.split(_c(lowered), "[^a-z]+", wl.TTR_WORDS + 2)
    words = F.slice(F.array_remove(F.slice(parts, 1, wl.TTR_WORDS + 1), ""), 1, wl.TTR_WORDS)
    ratio = lambda w: F.when(F.size(w) >= wl.TTR_MIN_WORDS, F.size(F.array_distinct(w)) / F.size(w))
    return _bound(words, ratio)


def is_likely_lyrics(col: Column | str, lowered: Column | str) -> Column:
    """No prose phrase, and not too many different words for a sung text."""
    repeats = F.coalesce(type_token_ratio(lowered) <= wl.TTR_MAX, F.lit(True))
    return ~has_prose_signal(col, lowered) & repeats


# ----------------------------------------------------------------- n-grams


def vector_words(tokens: Column | str) -> Column:
    """Tokens of two or more characters; only these enter a term vector."""
    return F.filter(_c(tokens), lambda t: F.length(t) >= 2)


def bigrams(words: Column | str) -> Column:
    """Each adjacent pair of words, joined by a blank."""
    w = _c(words)
    pairs = F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))
    # The last zipped pair has no right-hand word: concat makes it NULL.
    return F.filter(pairs, lambda p: p.isNotNull())


def with_bigrams(words: Column | str) -> Column:
    """The words followed by their bigrams."""
    return F.concat(_c(words), bigrams(words))


# ---------------------------------------------------------------- sections


def split_lines(col: Column | str) -> Column:
    return F.split(_c(col), _LINE_END)


def section_label(header: Column | str) -> Column:
    """Trim, lower-case and drop a trailing number: ``Chorus 2`` -> ``chorus``."""
    lowered = F.lower(strip_space(header))
    return strip_space(F.regexp_replace(lowered, rf"(?U)[{_SPACE}]*\p{{Nd}}+[{_SPACE}]*\z", ""))


def section_blocks(col: Column | str) -> Column:
    """Headed blocks of a text as ``array<struct<block_ix, label, text>>``.

    A header is a line that starts with ``[...]``; the rest of that line is
    dropped, as are lines before the first header and blank blocks.  Headers
    are marked with one regular expression and the text is cut at the marks,
    so the work is linear in the text and stays inside its row.
    """
    c = _c(col)
    lines = F.when(c.rlike(_OTHER_LINE_END), F.regexp_replace(c, _LINE_END, "\n")).otherwise(c)
    header = rf"(?md)^{_LINE_SPACE}*\[([^\]\n]+)\].*$"  # fixed value
    marked = F.regexp_replace(lines, header, f"{_BLOCK_MARK}$1{_LABEL_MARK}")
    headed = F.filter(F.split(marked, _BLOCK_MARK), lambda p, i: i > 0)
    blocks = F.transform(
        headed,
        lambda p, i: F.struct(
            (i + 1).alias("block_ix"),
            section_label(F.substring_index(p, _LABEL_MARK, 1)).alias("label"),
            strip_space(F.substring_index(p, _LABEL_MARK, -1)).alias("text"),
        ),
    )
    return F.filter(blocks, lambda b: b["text"] != "")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def chorus_of_blocks(blocks: Column | str) -> Column:
    """Text of the chorus-like blocks: labels in first-seen order, then blocks.

    NULL when no block has such a label.  Blocks are sorted once by label and place, so the blocks of a
    label lie side by side and the work does not grow with labels times blocks.
    """
    wanted = "|".join(wl.CHORUS_LABELS)
    chosen = F.filter(_c(blocks), lambda x: x["label"].rlike(wanted))
    by_label = F.array_sort(F.transform(chosen, lambda x: F.struct(x["label"].alias("label"), x["block_ix"].alias("ix"), x["text"].alias("text"))))

    def joined(s):
        first = lambda x, i: (i == 0) | (F.get(s, i - 1)["label"] != x["label"])
        placed = F.transform(s, lambda x, i: F.struct(x["ix"].alias("ix"), i.alias("at"), first(x, i).alias("first")))

        def told(heads):
            def text(h, k):
                last = F.coalesce(F.get(heads, k + 1)["at"], F.size(s)) - 1
                lines = F.transform(F.sequence(h["at"], last), lambda i: F.get(s, i)["text"])
                return F.struct(h["ix"].alias("ix"), F.array_join(lines, "\n").alias("text"))

            return F.array_join(F.transform(F.array_sort(F.transform(heads, text)), lambda t: t["text"]), "\n")

        return _bound(F.filter(placed, lambda p: p["first"]), told)

    # No block text is empty, so an empty result means no such block.
    return F.nullif(_bound(by_label, joined), F.lit(""))


def chorus_text(col: Column | str) -> Column:
    return chorus_of_blocks(section_blocks(col))
