"""Scoring of texts with a Brown class-based bigram model.

A text is its lower-case words and one end token.  Words with at least ``CORE`` of all training
tokens are symbols of their own; every other word is a tail word and belongs to the symbol of its
ending, so that each word, seen or not, has a class.  Distributed exchange clustering assigns
symbols to classes: a table holds the neighbours of each symbol, every task moves its own symbols one
after another to the class that raises the likelihood most, updating its copy of the class counts,
and between rounds the counts are added up anew.  The probability of a word is

    P(class | class before) * P(symbol | class) * P(word | symbol)

with transitions smoothed by Witten and Bell's rule and tail words discounted in favour of unseen
ones, so that all sums are one.  A text begins as if an end stood before it.

All counts are taken over all training rows and grow with them.  Only what a share of the tokens
bounds is broadcast: at most 1 / ``CORE`` symbols and 1 / ``KNOWN`` frequent words.  Rarer words meet
their counts in a shuffle join of (text, word) rows, once per text.

Defined results: a null text is empty and has one token, the end; a null id counts as training; rows
that repeat are learned from and scored each by itself; with an empty table nothing is learned and
nothing returned; other columns are not kept.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.sources.shared import save_stage

#: Documented parameters: shares of the training tokens from which a word is a symbol, and from which
#: its count is broadcast; endings, classes, rounds of exchange, and the discount of tail words.
CORE, KNOWN = 2e-5, 2e-6
ENDINGS, ENDING_CHARS, CLASSES, ROUNDS, DISCOUNT = 256, 3, 64, 8, 0.5
END = "\n"
HELD_OUT_OF, HELD_OUT = 7, 2
CHUNK_TOKENS, HELD_WORDS, ROWS = 1 << 19, 150_000, 500


def held_out() -> Column:
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(HELD_OUT_OF))
    return F.coalesce(remainder == HELD_OUT, F.lit(False))


def tokens(text: str | None) -> list[bytes]:
    """Words in UTF-8; lower and split treat bytes as ASCII, which is what is asked for."""
    return (text or "").encode().lower().split()


def ending(word: bytes) -> int:
    return zlib.crc32(word.decode()[-ENDING_CHARS:].encode()) % ENDINGS


def ending_column(word: Column) -> Column:
    last = F.substr(word, F.greatest(F.char_length(word) - (ENDING_CHARS - 1), F.lit(1)))
    return F.pmod(F.crc32(F.encode(last, "UTF-8")), F.lit(ENDINGS)).cast("int")


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()
    for frame in frames:
        for text in frame["text"]:
            counts.update(tokens(text))
            counts[END.encode()] += 1
            if len(counts) >= HELD_WORDS:
                yield _word_frame(counts)
                counts = Counter()
    yield _word_frame(counts)


def _word_frame(counts: Counter) -> pd.DataFrame:
    words = pd.Series([w.decode() for w in counts], dtype=object)
    return pd.DataFrame({"word": words, "c": np.fromiter(counts.values(), np.int64, len(counts))})


def count_words(train: DataFrame) -> DataFrame:
    """(word, c) over all training rows, the end token among them."""
    return train.select("text").mapInPandas(_count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Words:
    """Frequent words: the index of each, its symbol and count.  Symbols: the end is 0, core words
    follow, endings come last.  Index ``len(count) + e`` stands for an unlisted word with ending e."""

    index: dict[bytes, int]
    symbol: np.ndarray
    count: np.ndarray
    n_core: int
    total: int
    distinct: int

    @property
    def n_symbols(self) -> int:
        return self.n_core + ENDINGS

    def indices(self, words: list[bytes], memory: dict[bytes, int]) -> np.ndarray:
        """Indices of words; ``memory`` keeps those of unlisted words for a while."""
        known, n = self.index, len(self.count)
        out = [known.get(w, -1) for w in words]
        for k, x in enumerate(out):
            if x < 0:
                w = words[k]
                e = memory.get(w)
                if e is None:
                    e = memory[w] = n + ending(w)
                out[k] = e
        return np.array(out, np.int64)


def frequent(vocabulary: DataFrame) -> Words:
    size = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    rows = vocabulary.filter((F.col("c") >= KNOWN * size.n) | (F.col("word") == END)).collect()  # at most 1 / KNOWN + 1
    rows.sort(key=lambda r: (r.word != END, -r.c, r.word))
    words = [r.word.encode() for r in rows]
    n_core = sum(r.c >= CORE * size.n or r.word == END for r in rows) or 1
    symbol = [k if k < n_core else n_core + ending(w) for k, w in enumerate(words)] + [n_core + e for e in range(ENDINGS)]
    return Words({w: k for k, w in enumerate(words)}, np.array(symbol, np.int64), np.array([r.c for r in rows], np.int64), n_core, int(size.n), int(size.v))


def count_bigrams(train: DataFrame, shared) -> DataFrame:
    """(a, b, n) of neighbouring symbols; an end stands before and after every text."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = shared.value
        held, size, memory = [np.zeros(1, np.int64)], 0, {}

        def flush():
            s = np.concatenate(held)
            keys, n = np.unique(s[:-1] * words.n_symbols + s[1:], return_counts=True)
            return pd.DataFrame({"key": keys, "n": n.astype(np.int64)})

        for frame in frames:
            for text in frame["text"]:
                held.append(words.symbol[words.indices([*tokens(text), END.encode()], memory)])
                size += len(held[-1])
                if size >= CHUNK_TOKENS:
                    yield flush()
                    held, size, memory = [np.zeros(1, np.int64)], 0, {}
        yield flush()

    counted = train.select("text").mapInPandas(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    width = shared.value.n_symbols
    return counted.select(F.expr(f"cast(key div {width} as int)").alias("a"), (F.col("key") % width).cast("int").alias("b"), "n")


def neighbours(bigrams: DataFrame) -> DataFrame:
    """One row per symbol with all its neighbours: (symbol, right, right_n, left, left_n)."""
    both = bigrams.select(F.col("a").alias("symbol"), F.lit(True).alias("to_right"), F.col("b").alias("o"), "n").unionByName(
        bigrams.select(F.col("b").alias("symbol"), F.lit(False).alias("to_right"), F.col("a").alias("o"), "n")
    )
    rows = both.groupBy("symbol").agg(F.collect_list(F.struct("to_right", "o", "n")).alias("x"))
    side = lambda right, name: F.transform(F.filter("x", lambda e: e["to_right"] == right), lambda e: e[name])
    return rows.select("symbol", side(True, "o").alias("right"), side(True, "n").alias("right_n"), side(False, "o").alias("left"), side(False, "n").alias("left_n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def best_class(joint: np.ndarray, right: np.ndarray, left: np.ndarray, self_n: float, here: int) -> tuple[int, float]:
    """The class that a symbol should move to, and the gain in likelihood over where it is.

    ``joint`` holds the counts of class pairs, ``right`` and ``left`` the symbol's neighbours by
    class, without itself; ``self_n`` how often it follows itself.  The likelihood is the sum of
    n log n over pairs less the same over the class totals of either side.
    """
    rest = joint.copy()
    rest[here, :] -= right
    rest[:, here] -= left
    rest[here, here] -= self_n
    rows, columns = rest.sum(axis=1) + left, rest.sum(axis=0) + right
    out, into = right.sum() + self_n, left.sum() + self_n
    k = np.arange(len(rest))
    gain = (_xlogx(rest + right) - _xlogx(rest)).sum(axis=1) + (_xlogx(rest.T + left) - _xlogx(rest.T)).sum(axis=1)
    # the diagonal cell takes both sides and the symbol after itself
    cell = rest[k, k]
    gain += _xlogx(cell + right[k] + left[k] + self_n) - _xlogx(cell + right[k]) - _xlogx(cell + left[k]) + _xlogx(cell)
    gain -= _xlogx(rows + out) - _xlogx(rows) + _xlogx(columns + into) - _xlogx(columns)
    to = int(np.argmax(gain))
    return to, float(gain[to] - gain[here])


def _symbol_rows(batches):
    """(symbol, right ids, right n, left ids, left n) from Arrow batches."""
    for batch in batches:
        columns = []
        for name in ("right", "right_n", "left", "left_n"):
            c = batch.column(name)
            columns.append((c.offsets.to_numpy(), c.values.to_numpy()))
        for k, s in enumerate(batch.column("symbol").to_pylist()):
            yield (s, *[v[o[k] : o[k + 1]] for o, v in columns])


def pair_counts(contexts: DataFrame, label: np.ndarray, classes: int) -> np.ndarray:
    """How often each class follows each class."""
    shared = contexts.sparkSession.sparkContext.broadcast(label)

    def cells(batches):
        import pyarrow as pa

        cls, n = shared.value, np.zeros(classes * classes)
        for s, right, right_n, _, _ in _symbol_rows(batches):
            n += np.bincount(cls[s] * classes + cls[right], right_n, classes * classes)
        yield pa.RecordBatch.from_pydict({"cell": np.arange(classes * classes), "n": n})

    out = np.zeros(classes * classes)
    for r in contexts.mapInArrow(cells, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out.reshape(classes, classes)


def cluster(contexts: DataFrame, n_symbols: int, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of every symbol by distributed exchange; symbols are numbered from frequent to rare."""
    spark = contexts.sparkSession
    label = np.arange(n_symbols) % classes

    for turn in range(rounds):
        state = spark.sparkContext.broadcast((label, pair_counts(contexts, label, classes)))

        def moves(batches, turn=turn, state=state):
            import pyarrow as pa

            cls, counts = state.value[0].copy(), state.value[1].copy()
            moved, to = [], []
            for s, right, right_n, left, left_n in _symbol_rows(batches):
                if (s * 2654435761 + turn) % 3 == 0:
                    continue  # a third rests in each round, so that symbols of other tasks don't chase each other
                same_r, same_l = right == s, left == s
                r = np.bincount(cls[right[~same_r]], right_n[~same_r], classes)
                lf = np.bincount(cls[left[~same_l]], left_n[~same_l], classes)
                self_n, here = float(right_n[same_r].sum()), int(cls[s])
                there, gain = best_class(counts, r, lf, self_n, here)
                if there != here and gain > 1e-6:
                    counts[here, :] -= r
                    counts[:, here] -= lf
                    counts[here, here] -= self_n
                    counts[there, :] += r
                    counts[:, there] += lf
                    counts[there, there] += self_n
                    cls[s] = there
                    moved.append(s)
                    to.append(there)
            yield pa.RecordBatch.from_pydict({"symbol": pa.array(moved, pa.int32()), "to": pa.array(to, pa.int32())})

        changes = contexts.mapInArrow(moves, "symbol int, to int").collect()  # at most one row per symbol
        label = label.copy()
        for r in changes:
            label[r.symbol] = r.to
        if not changes:
            break
    return label


@dataclass
class Model:
    words: Words
    classes: np.ndarray
    transition: np.ndarray  # log10 P(class | class before)
    emission: np.ndarray  # log10 P(word | class) by index; without P(word | ending) for unlisted words
    base: np.ndarray  # log10 of the base estimate by index, 0 for unlisted words
    ending_total: np.ndarray
    ending_distinct: np.ndarray


def build(spark: SparkSession, words: Words, vocabulary: DataFrame, contexts: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS) -> Model:
    """Cluster symbols and turn counts into probabilities."""
    n_known, n_core = len(words.count), words.n_core
    label = cluster(contexts, words.n_symbols, classes, rounds)
    core = list(words.index)[:n_core]
    tail = vocabulary.filter((F.col("c") < CORE * words.total) & (F.col("word") != END))
    ending_total, ending_distinct = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in tail.groupBy(ending_column(F.col("word")).alias("e")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        ending_total[r.e], ending_distinct[r.e] = r.c, r.v
    count = np.concatenate([words.count[:n_core] if core else np.zeros(n_core), ending_total]) + 0.5
    of_class = np.bincount(label, count, classes)
    joint = pair_counts(contexts, label, classes)
    followers, out = (joint > 0).sum(axis=1), joint.sum(axis=1)
    rest = np.where(out > 0, followers / np.maximum(out + followers, 1), 1.0)[:, None]
    prior = (of_class + 1e-3) / (of_class + 1e-3).sum()
    transition = (1 - rest) * joint / np.maximum(out, 1)[:, None] + rest * prior
    in_class = count / of_class[label]
    emission = np.log10(in_class[words.symbol])
    for k in range(n_core, n_known):
        e = words.symbol[k] - n_core
        emission[k] += math.log10((words.count[k] - DISCOUNT) / (ending_total[e] + 1))
    base = np.zeros(n_known + ENDINGS)
    base[:n_known] = np.log10((words.count + 1) / (words.total + words.distinct + 1))
    return Model(words, label, np.log10(transition), emission, base, ending_total, ending_distinct)


def _pass(shared):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Model = shared.value
        n_known, end = len(m.words.count), END.encode()
        cls = m.classes[m.words.symbol]
        for frame in frames:
            memory: dict[bytes, int] = {}
            for first in range(0, len(frame), ROWS):  # a few texts at a time, to hold few words
                part, out = frame.iloc[first : first + ROWS], []
                for text in part["text"]:
                    words = [*tokens(text), end]
                    at = m.words.indices(words, memory)
                    c = cls[at]
                    before = np.concatenate([[m.classes[0]], c[:-1]])
                    score = float(m.transition[before, c].sum() + m.emission[at].sum())
                    far = np.flatnonzero(at >= n_known)
                    rare = Counter(words[k] for k in far)
                    out.append((len(words), len(words) - len(far), float(m.base[at].sum()), score, [w.decode() for w in rare], list(rare.values())))
                    if len(memory) > HELD_WORDS:
                        memory.clear()
                done = pd.DataFrame(out, columns=["n_tokens", "n_known", "base_score", "score", "rare", "rare_n"])
                done.insert(0, "rid", part["rid"].to_numpy())
                done.insert(1, "doc_id", part["doc_id"].array)
                done.insert(2, "held_out", part["held_out"].to_numpy())
                yield done

    return run


def score(docs: DataFrame, model: Model, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) per row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", held_out().alias("held_out"), "text")
    fields = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<string>, rare_n array<int>"
    first = save_stage(rows.mapInPandas(_pass(shared), fields), "lm-pass")
    rare = first.select("rid", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("rid", F.col("x.rare").alias("word"), F.col("x.rare_n").alias("n"))
    m = model
    tail = vocabulary.filter((F.col("c") < KNOWN * m.words.total) & (F.col("word") != END))
    met = rare.join(tail, "word", "left").withColumn("e", ending_column(F.col("word")))
    ends = spark.createDataFrame(
        [(e, float(m.ending_total[e]), float(m.ending_distinct[e])) for e in range(ENDINGS)], "e int, total double, distinct double"
    )
    met = met.join(F.broadcast(ends), "e")  # a fixed number of rows
    seen = F.coalesce("c", F.lit(0))
    kept = F.when(seen > 0, seen - DISCOUNT).otherwise(F.col("distinct") * DISCOUNT + 1) / (F.col("total") + 1)
    parts = met.groupBy("rid").agg(
        F.sum(F.when(seen > 0, F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.col("n") * F.log10((seen + 1) / F.lit(float(m.words.total + m.words.distinct + 1)))).alias("base"),
        F.sum(F.col("n") * F.log10(kept)).alias("more"),
    )
    done = first.drop("rare", "rare_n").join(parts, "rid", "left")
    whole = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return done.select(
        "doc_id", "held_out", "n_tokens", whole("n_known", "known").alias("n_known"), F.lit(m.words.total).cast("long").alias("train_tokens"),
        whole("base_score", "base").alias("base_score"), whole("score", "more").alias("score"),
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def fit(docs: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """Learn from the rows that aren't held out; also returns the table of word counts."""
    spark = docs.sparkSession
    train = docs.filter(~held_out())
    vocabulary = save_stage(count_words(train), "lm-words")
    words = frequent(vocabulary)
    contexts = save_stage(neighbours(count_bigrams(train, spark.sparkContext.broadcast(words))), "lm-neighbours")
    return build(spark, words, vocabulary, contexts, classes, rounds), vocabulary


def score_all(docs: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    model, vocabulary = fit(docs, classes, rounds)
    return score(docs, model, vocabulary)
