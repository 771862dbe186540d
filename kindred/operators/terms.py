"""Vocabulary and TF-IDF term vectors.

A song's vector is one row: ``song_id, seq, term_ids, weights`` with ids in
ascending order and unit length.  ``postings`` gives the long form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import text as tx
from kindred.functions import wordlists as wl
from kindred.functions.text import compute_once
from kindred.sources.shared import broadcast_if_bounded, save_stage

BROADCAST_TERMS = 1_000_000
TASK_SONGS = 4_096
#: Songs whose words a task counts at a time.
PIECE_ROWS = 2_048


def _song_words(songs: DataFrame, tokens: str) -> DataFrame:
    return compute_once(songs.select("song_id", "seq", tokens), _words=tx.vector_words(tokens)).drop(tokens)


def song_terms(songs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``song_id, seq, terms``: unigrams and bigrams of each song as an array."""
    return compute_once(_song_words(songs, tokens), terms=tx.with_bigrams("_words")).drop("_words")


def _pieces(batches):
    """Arrow batches cut to PIECE_ROWS rows, which bounds what a task holds as arrays."""
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE_ROWS):
            yield batch.slice(at, PIECE_ROWS)


def _words_in(lists):
    """The words of two or more characters in an Arrow list column, and the number of the list of each."""
    import pyarrow.compute as pc

    words, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    long = pc.fill_null(pc.greater_equal(pc.utf8_length(words), 2), False)
    return words.filter(long), rows.filter(long).to_numpy()


def _codes_of(words, known):
    """Where each word stands among the known ones, -1 for others."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.index_in(words, value_set=known.cast(words.type)), -1).to_numpy().astype("int64")


def _adjacent(rows, codes):
    """True for each word that its list continues and that is known, as the next one is."""
    return (rows[1:] == rows[:-1]) & (codes[1:] >= 0) & (codes[:-1] >= 0)


def _count_batch(terms, codes, rows):
    """One row per term: how often its code occurs, and in how many rows."""
    import numpy as np
    import pyarrow as pa

    n = max(len(terms), 1)
    cells = np.sort(rows * n + codes)  # np.unique would hash them, which takes many times as long
    first = cells[np.diff(cells, prepend=-1) != 0] % n
    counts = np.bincount(codes, minlength=n), np.bincount(first, minlength=n)
    return pa.RecordBatch.from_arrays([terms.cast(pa.string()), *(pa.array(c[: len(terms)]) for c in counts)], ["term", "_all", "_doc"])


def _count_words(batches):
    for piece in _pieces(batches):
        words, rows = _words_in(piece.column(0))
        coded = words.dictionary_encode()
        yield _count_batch(coded.dictionary, coded.indices.to_numpy().astype("int64"), rows)


def _count_bigrams(usable=None):
    """Counts the bigrams of usable words, or of all words."""

    def run(batches):
        import numpy as np
        import pyarrow.compute as pc

        for piece in _pieces(batches):
            words, rows = _words_in(piece.column(0))
            known = words.dictionary_encode().dictionary if usable is None else usable
            codes, n = _codes_of(words, known), max(len(known), 1)
            both = _adjacent(rows, codes)
            kinds, kind = np.unique(codes[:-1][both] * n + codes[1:][both], return_inverse=True)
            # Words with blanks may give two kinds one term.
            coded = pc.binary_join_element_wise(known.take(kinds // n), known.take(kinds % n), " ").dictionary_encode()
            yield _count_batch(coded.dictionary, coded.indices.to_numpy().astype("int64")[kind], rows[:-1][both])

    return run


def _counted(lists: DataFrame, count) -> DataFrame:
    rows = lists.mapInArrow(count, "term string, _all long, _doc long")
    return rows.groupBy("term").agg(F.sum("_all").alias("corpus_count"), F.sum("_doc").alias("doc_count"))


def frequent_terms(
    songs: DataFrame, tokens: str = "tokens", *, max_features: int = wl.MAX_FEATURES, min_df: int = wl.MIN_DF
) -> DataFrame:
    """``term, corpus_count, doc_count`` of the terms that make the vocabulary.

    Some PIECE_ROWS songs are counted at a time, as arrays of word numbers;
    the shuffle on the term carries their sums, however common the term is.

    Words come first.  Once max_features words qualify, the count of the last
    one is a floor that a bigram must reach too, and a bigram is never more
    frequent than either of its words.  Bigrams with a word below the floor
    are dropped before they are counted, which spares the shuffle nearly all
    of the one-off bigrams a large corpus consists of.
    """
    lists = songs.select(tokens)
    every = save_stage(_counted(lists, _count_words), "word-counts")
    singles = every.where(F.col("doc_count") >= min_df)
    by_count = [F.desc("corpus_count"), "term"]
    last = singles.orderBy(*by_count).limit(max_features).agg(F.count(F.lit(1)), F.min("corpus_count")).first()
    floor = last[1] if last[0] == max_features else 0

    usable = singles.where(F.col("corpus_count") >= floor).select(F.col("term").alias("_word"))
    # A few usable words travel to the songs; else bigrams meet them in a join by shuffle, in which a hot word's rows
    # can be split.  Words with blanks may share a bigram, so their own counts say nothing of it.
    usable, small = broadcast_if_bounded(usable, BROADCAST_TERMS)
    if small and every.where(F.col("term").contains(" ")).isEmpty():
        doubles = _counted(lists, _count_bigrams(usable.toArrow().column(0).combine_chunks()))
    else:
        rows = lists.mapInArrow(_count_bigrams(), "term string, _all long, _doc long")
        for part in (1, -1) if floor else ():
            rows = rows.join(usable, F.substring_index("term", " ", part) == F.col("_word"), "left_semi")
        doubles = rows.groupBy("term").agg(F.sum("_all").alias("corpus_count"), F.sum("_doc").alias("doc_count"))
    doubles = doubles.where((F.col("doc_count") >= min_df) & (F.col("corpus_count") >= floor))
    return singles.unionByName(doubles).orderBy(*by_count).limit(max_features)


def fit_vocabulary(
    songs: DataFrame,
    tokens: str = "tokens",
    *,
    max_features: int = wl.MAX_FEATURES,
    min_df: int = wl.MIN_DF,
) -> DataFrame:
    """The most frequent terms with their inverse document frequency.

    Terms in at least ``min_df`` songs, cut at ``max_features`` by corpus
    count, ties by term.  ``term_id`` follows the alphabet.
    ``idf = ln((1 + n) / (1 + df)) + 1`` where n counts every song.
    """
    top = frequent_terms(songs, tokens, max_features=max_features, min_df=min_df)
    n = songs.agg(F.count(F.lit(1))).scalar()
    # The window has no partition: it numbers max_features rows at most.
    return top.select(
        "term",
        (F.row_number().over(Window.orderBy("term")) - 1).alias("term_id"),
        "corpus_count",
        "doc_count",
        (F.log((1 + n) / (1 + F.col("doc_count"))) + 1).alias("idf"),
    )


def term_vectors(
    songs: DataFrame, vocabulary: DataFrame, tokens: str = "tokens", *, use_idf: bool = True
) -> DataFrame:
    """Unit-length term vectors under a fitted vocabulary.

    Songs are spread by id while they are still one compact row each, some
    TASK_SONGS to a task, whose terms fit its memory.  Their words stay where
    they are: once its size is checked the vocabulary travels to the tasks,
    which look words and pairs of words up by number, some PIECE_ROWS songs at
    a time.  Rows of one song make one vector.  A song that has no vocabulary
    term at all keeps an empty one.
    """
    parts = max(songs.sparkSession.sparkContext.defaultParallelism, -(-songs.count() // TASK_SONGS))
    joined = songs.select("song_id", "seq", tx.join_tokens(tokens).alias("_text"), tx.odd_tokens(tokens).alias("_odd"))
    spread = joined.repartition(parts, "song_id")
    vocab = vocabulary.select("term", "term_id", (F.col("idf") if use_idf else F.lit(1.0)).alias("idf"))
    _, small = broadcast_if_bounded(vocab, BROADCAST_TERMS)
    if not small:
        return _vectors_by_join(spread.select("song_id", "seq", tx.tokens_of("_text", "_odd").alias(tokens)), vocab, tokens)
    whole = spread.where("_text is not null").groupBy("song_id", "seq").agg(F.collect_list(F.struct("_text", "_odd")).alias("_rows"))
    lists = whole.select("song_id", "seq", F.transform("_rows", lambda r: tx.tokens_of(r["_text"], r["_odd"])).alias(tokens))
    kind = {f.name: f.dataType.simpleString() for f in [*lists.schema, *vocabulary.schema]}
    schema = f"song_id {kind['song_id']}, seq {kind['seq']}, term_ids array<{kind['term_id']}>, weights array<double>"
    return lists.mapInArrow(_weigher(vocab.where("term is not null").orderBy("term_id").toArrow()), schema)


def _weigher(vocabulary):
    """Turns lists of token lists into term vectors; the vocabulary is in the order of its ids."""
    number: dict[str, int] = {}
    keys = []  # word, next word (-1: none) and place of the term, for each way to read it
    for at, term in enumerate(vocabulary.column("term").to_pylist()):
        cuts = [i for i, c in enumerate(term) if c == " "]
        for word, following in [(term, None), *((term[:i], term[i + 1 :]) for i in cuts)]:
            a, b = (-1 if w is None else number.setdefault(w, len(number)) for w in (word, following))
            keys.append((a, b, at))
    ids, idf = (vocabulary.column(c).combine_chunks() for c in ("term_id", "idf"))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known, n = pa.array(number, pa.string()), len(number) + 1
        table = np.array(keys, "int64").reshape(-1, 3)
        key, place = table[:, 0] * n + table[:, 1] + 1, table[:, 2]
        order = np.argsort(key)
        key, place, idfs, m = key[order], place[order], idf.to_numpy(zero_copy_only=False), max(len(ids), 1)
        for piece in _pieces(batches):
            inner = pc.list_flatten(piece.column(2))
            song = pc.list_parent_indices(piece.column(2)).to_numpy()
            words, rows = _words_in(inner)
            codes = _codes_of(words, known)
            one, both = codes >= 0, _adjacent(rows, codes)
            asked = np.concatenate([codes[one] * n, codes[:-1][both] * n + codes[1:][both] + 1])
            owner = song[np.concatenate([rows[one], rows[:-1][both]])]
            first = np.searchsorted(key, asked)
            times = np.searchsorted(key, asked, "right") - first  # a term that stands twice counts for both
            at = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
            cells, counts = np.unique(np.repeat(owner, times) * m + place[at], return_counts=True)
            row, term = np.divmod(cells, m)
            weights = counts * idfs[term]
            norms = np.sqrt(np.bincount(row, weights * weights, minlength=piece.num_rows))
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=piece.num_rows))]).astype("int32"))
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0),
                    piece.column(1),
                    pa.ListArray.from_arrays(ends, ids.take(pa.array(term))),
                    pa.ListArray.from_arrays(ends, pa.array(weights / norms[row])),
                ],
                ["song_id", "seq", "term_ids", "weights"],
            )

    return run


def _vectors_by_join(spread: DataFrame, vocab: DataFrame, tokens: str) -> DataFrame:
    """Vectors under a vocabulary too large to travel: each term meets it in a join by shuffle.

    An empty marker term, with no weight, keeps songs that have no vocabulary term at all.
    """
    spread = song_terms(spread, tokens)
    marker = vocab.sparkSession.createDataFrame([("", -1, 0.0)], "term string, term_id int, idf double")
    counted = (
        spread.select("song_id", "seq", F.explode(F.concat(F.array(F.lit("")), "terms")).alias("term"))
        .join(vocab.union(marker), "term")
        .groupBy("song_id", "seq", "term_id")
        .agg((F.count(F.lit(1)) * F.first("idf")).alias("_w"))
    )
    entry = F.when(F.col("term_id") >= 0, F.struct("term_id", "_w"))
    rows = counted.groupBy("song_id", "seq").agg(
        F.sort_array(F.collect_list(entry)).alias("_v"),
        F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"),
    )
    return rows.select(
        "song_id",
        "seq",
        F.col("_v.term_id").alias("term_ids"),
        F.transform("_v", lambda x: x["_w"] / F.col("_norm")).alias("weights"),
    )


def postings(vectors: DataFrame, *keep: str) -> DataFrame:
    """Long form: one row per song and term."""
    cols = keep or ("song_id", "seq")
    return vectors.select(
        *cols, F.inline(F.arrays_zip(F.col("term_ids").alias("term_id"), F.col("weights").alias("weight")))
    )


def vocabulary_listing(vocabulary: DataFrame, n: int = 20) -> DataFrame:
    """Vocabulary size with the first unigrams and bigrams in the alphabet."""
    kind = F.when(F.col("term").contains(" "), "bigram").otherwise("unigram")
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("term"))
    size = vocabulary.agg(F.count(F.lit(1))).scalar()
    return (
        vocabulary.select(kind.alias("kind"), "term")
        .withColumn("position", rank)
        .where(F.col("position") <= n)
        .withColumn("vocabulary_size", size)
    )


def top_terms(vectors: DataFrame, vocabulary: DataFrame, n: int = 20) -> DataFrame:
    """Heaviest terms of each song: ``song_id, rank, term, weight``.

    The rank is taken inside the row, so no song leaves its partition; ties go
    to the term first in the alphabet, which is the lower id.
    """
    pairs = F.arrays_zip(F.col("term_ids").alias("term_id"), F.col("weights").alias("weight"))
    keyed = F.transform(
        pairs,
        lambda p: F.struct((-F.round(p["weight"], 6)).alias("o"), p["term_id"].alias("term_id"), p["weight"].alias("weight")),
    )
    best = vectors.select("song_id", F.posexplode(F.slice(F.sort_array(keyed), 1, n)).alias("_i", "_t"))
    names, _ = broadcast_if_bounded(vocabulary.select("term_id", "term"), BROADCAST_TERMS)
    flat = best.select("song_id", (F.col("_i") + 1).alias("rank"), "_t.term_id", "_t.weight")
    return flat.join(names, "term_id").select("song_id", "rank", "term", "weight")
