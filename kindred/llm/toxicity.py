"""Toxicity by a weighted finite-state pattern grammar.

Words are mapped to symbols: insult (with a learned weight), threat, target, negation, reported
speech, or other.  One transducer per kind is a table of states and arcs; ``compose`` multiplies them
into one machine, which walks a clause from left to right and tells at each insult or threat whether
it stands under a negation, in reported speech and behind a target.  A target may also follow, so the
target's transducer walks the clause from right to left as well.  Each such context has a weight: an
insult next to a target counts more, one under negation or in reported speech less, a threat only with
a target.  A document's evidence is the weight of its matched clauses; a logistic curve fitted to
labelled documents turns it into a score.

What is learned comes from the training rows only: for whole words and word stems (first letters),
the documents of either label that hold them are counted over all training rows, each group of near
copies once, by a shuffle; those that labels tell apart beyond doubt become the lexicon.  An entry
with a chosen stem of no less weight says nothing more and is left out; all others are kept, however
many.  The weights of the contexts and the curve are fitted on a sample of at most ``FIT_ROWS``
labelled rows, taken by hash; a weight leaves its default only for a clear gain in likelihood.
Labels, language, source and id are never inputs of a score.

Defined results: null and empty texts have no clause and get the score of no evidence; without
labelled rows of both kinds the lexicon is empty and every score is the share of toxic labels (0.5 if
there are none); very long texts are read whole, clause by clause, in time linear in them; rows that
repeat are scored each by itself; other columns pass through, except that the outputs ``evidence``,
``matched_clauses`` and ``score`` replace columns of these names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm import quality
from kindred.sources.shared import broadcast_if_bounded, save_stage

#: Documented bound of the rows that the context weights and the curve are fitted on.
FIT_ROWS = 20_000
HELD_FEATURES, BROADCAST_LABELS = 500_000, 1_000_000
STEMS = (3, 4, 5, 6)
#: An entry's log-likelihood ratio against chance (30 is met by chance once in 20 million entries),
#: the share of toxic documents among those that hold it, and how many standard errors its weight is
#: below the estimate.
LEAST_RATIO, LEAST_SHARE, CAUTION = 30.0, 0.9, 1.64
THRESHOLD = 0.3

#: Function words of the grammar in English, French, German and Spanish.
TARGET = set("you your youre ur he him she her they them u tu te toi vous il elle ils elles du dich dir ihr euch sie usted ustedes vosotros".split())
NEGATION = set("not no never neither nor isnt arent wasnt dont doesnt didnt cannot cant wont pas jamais ni nicht kein keine nie niemals nunca jamás tampoco".split())
REPORT = set("said says say told claims claimed wrote called quoted quote according dit disent sagte sagt schrieb laut dijo dice dicen según".split())
THREAT = set("kill hurt destroy beat punch shoot stab burn tuer tuerai frapper töten schlagen matar golpear matarte".split())
CLAUSE = re.compile(r"[^.!?;:\n]+")
WORD = re.compile(r"[^\W\d_]+")
QUOTES = re.compile(r"[\"“”«»„]")

OTHER, INSULT, THREATENS, TARGETS, NEGATES, REPORTS = range(6)
#: Words that negation reaches, and words that a target reaches.
NEGATED, AIMED = 3, 4
#: Values tried for the weights of the contexts, and the least gain in log-likelihood for a change.
TRIED = {"target": (1.0, 1.25, 1.5, 2.0, 3.0), "negated": (0.0, 0.1, 0.25, 0.5, 0.75, 1.0), "reported": (0.0, 0.1, 0.25, 0.5, 0.75, 1.0), "threat": (0.0, 0.5, 1.0, 2.0, 4.0)}
LEAST_GAIN = 3.0
#: A context is negated + 2 * reported + 4 * aimed + 8 * threat.
CONTEXTS = 16


@dataclass(frozen=True)
class Transducer:
    """``arcs[state][symbol]`` is the next state; ``out[state]`` is said of a word that is met there."""

    arcs: tuple[tuple[int, ...], ...]
    out: tuple[tuple[int, ...], ...]


def within(symbol: int, reach: int) -> Transducer:
    """Says 1 of the ``reach`` words behind ``symbol``; a state is the number of words still reached."""
    arcs = tuple(tuple(reach if s == symbol else max(0, left - 1) for s in range(6)) for left in range(reach + 1))
    return Transducer(arcs, tuple((int(left > 0),) for left in range(reach + 1)))


def ever(symbol: int) -> Transducer:
    """Says 1 of all words behind ``symbol``."""
    return Transducer(tuple(tuple(int(seen or s == symbol) for s in range(6)) for seen in (0, 1)), ((0,), (1,)))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The machine that runs both over one input and says what both say; only states that can be met."""
    place, todo, arcs = {(0, 0): 0}, [(0, 0)], []
    for x, y in todo:
        row = []
        for pair in zip(a.arcs[x], b.arcs[y], strict=True):
            if pair not in place:
                place[pair] = len(todo)
                todo.append(pair)
            row.append(place[pair])
        arcs.append(tuple(row))
    return Transducer(tuple(arcs), tuple(a.out[x] + b.out[y] for x, y in todo))


BEFORE = compose(compose(within(NEGATES, NEGATED), ever(REPORTS)), within(TARGETS, AIMED))
BEHIND = within(TARGETS, AIMED)


@dataclass
class Grammar:
    """The learned lexicon and curve with the fixed function words."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    slope: float = 1.0
    shift: float = 0.0
    target: float = 1.25
    negated: float = 0.5
    reported: float = 0.75
    threat: float = 1.0

    def shares(self) -> list[float]:
        """Weight of each context."""
        out = []
        for c in range(CONTEXTS):
            share = (self.negated if c & 1 else 1.0) * (self.reported if c & 2 else 1.0)
            insult = self.target if c & 4 else 1.0
            out.append(share * ((self.threat if c & 4 else 0.0) if c & 8 else insult))
        return out

    def symbol(self, word: str) -> tuple[int, float]:
        """The symbol that a word emits, with its weight."""
        weight = self.words.get(word, 0.0)
        for n in STEMS:
            if len(word) > n:
                weight = max(weight, self.stems.get(word[:n], 0.0))
        if weight > 0:
            return INSULT, weight
        for known, symbol in ((THREAT, THREATENS), (TARGET, TARGETS), (NEGATION, NEGATES), (REPORT, REPORTS)):
            if word in known:
                return symbol, 1.0
        return OTHER, 0.0


def found_contexts(symbols: list[tuple[int, float]], quoted: bool = False) -> list[tuple[int, float]]:
    """(context, weight) of each insult and threat of a clause; a quoted clause is reported speech."""
    behind, state = [0] * len(symbols), 0
    for k in range(len(symbols) - 1, -1, -1):
        (behind[k],) = BEHIND.out[state]
        state = BEHIND.arcs[state][symbols[k][0]]
    out, state = [], BEFORE.arcs[0][REPORTS] if quoted else 0
    for k, (symbol, weight) in enumerate(symbols):
        if symbol in (INSULT, THREATENS):
            negated, reported, aimed = BEFORE.out[state]
            out.append((negated + 2 * reported + 4 * (aimed | behind[k]) + 8 * (symbol == THREATENS), weight))
        state = BEFORE.arcs[state][symbol]
    return out


def clauses(text: str | None, grammar: Grammar, symbols: dict[str, tuple[int, float]]) -> Iterator[list[tuple[int, float]]]:
    """Contexts of each clause that holds an insult or a threat; ``symbols`` remembers words."""
    low = (text or "").lower().replace("'", "").replace("’", "")
    for m in CLAUSE.finditer(low):
        clause = m[0]
        found = []
        for word in WORD.findall(clause):
            symbol = symbols.get(word)
            if symbol is None:
                symbol = symbols[word] = grammar.symbol(word)
            found.append(symbol)
        if any(s in (INSULT, THREATENS) for s, _ in found):
            yield found_contexts(found, QUOTES.search(clause) is not None)


def evidence(text: str | None, grammar: Grammar, symbols: dict[str, tuple[int, float]], shares: list[float] | None = None) -> tuple[float, int]:
    """Weight of the matched clauses of a text, and their number."""
    shares = shares or grammar.shares()
    weights = [sum(shares[c] * w for c, w in found) for found in clauses(text, grammar, symbols)]
    return sum(weights, 0.0), sum(w > 0 for w in weights)


def context_sums(text: str | None, grammar: Grammar, symbols: dict[str, tuple[int, float]]) -> list[float]:
    """Weight that a text holds in each context."""
    out = [0.0] * CONTEXTS
    for found in clauses(text, grammar, symbols):
        for c, w in found:
            out[c] += w
    return out


def _in_train() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of labelled training rows to learn from.

    A document that is labelled twice is toxic if one label says so.  Copies would make any word of a
    copied document look like evidence: of texts of one label that are equal or near copies, found by
    sketches of their shingles as the quality rules do, one is kept.  No text is shuffled.
    """
    toxic = labels.filter("doc_id is not null and toxic is not null").filter(_in_train()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = _labelled(docs, toxic).select("doc_id", "toxic", F.xxhash64("text").alias("same"), "text")
    rows = save_stage(quality.sketched(texts), "toxic-sketches")
    led = quality.leaders(rows.select("toxic", "same", "sketch").dropDuplicates(["toxic", "same"]), ["toxic"])
    folded = rows.join(led, ["toxic", "same"], "left").groupBy(F.coalesce("leader", "same").alias("same"), "toxic")
    return save_stage(folded.agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic").distinct(), "toxic-rows")


def _labelled(docs: DataFrame, toxic: DataFrame) -> DataFrame:
    """(doc_id, text, toxic): labels travel to the texts if they are few, else both are shuffled."""
    few, _ = broadcast_if_bounded(toxic, BROADCAST_LABELS)
    return docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text").join(few, "doc_id")


def _features(text: str | None) -> set[str]:
    words = set(WORD.findall((text or "").lower().replace("'", "").replace("’", "")))
    return {f"={w}" for w in words} | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}


def _count_features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of either label that hold a feature, added up within the task."""
    bad, every = Counter(), Counter()

    def flush():
        names = pd.Series(list(every), dtype=object)
        return pd.DataFrame({"feature": names, "bad": np.array([bad[f] for f in every], np.int64), "all": np.array(list(every.values()), np.int64)})

    for frame in frames:
        for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
            found = _features(text)
            every.update(found)
            if toxic:
                bad.update(found)
            if len(every) >= HELD_FEATURES:
                yield flush()
                bad, every = Counter(), Counter()
    yield flush()


def learn_lexicon(rows: DataFrame, n: int, toxic: int) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of words and stems from (text, toxic) rows, of which ``toxic`` of ``n`` are toxic."""
    counts = rows.select("text", "toxic").mapInPandas(_count_features, "feature string, bad long, all long")
    counts = counts.groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("all").alias("all"))
    bad, good = F.col("bad") + 0.5, F.col("all") - F.col("bad") + 0.5
    odds = F.log(bad / (toxic + 1)) - F.log(good / (n - toxic + 1))
    cautious = odds - CAUTION * F.sqrt(1 / bad + 1 / good)
    part = lambda seen, share: F.when(seen > 0, seen * F.log(seen / (F.col("all") * share))).otherwise(0.0)
    ratio = 2 * (part(F.col("bad"), toxic / n) + part(F.col("all") - F.col("bad"), 1 - toxic / n))
    clear = (F.col("bad") * n > F.col("all") * toxic) & (ratio >= LEAST_RATIO) & (bad >= LEAST_SHARE * (F.col("all") + 1))
    chosen = counts.filter(clear).withColumn("odds", cautious).filter("odds > 0")
    chosen = save_stage(chosen.select("feature", "odds"), "toxic-lexicon")
    bare = F.regexp_replace("feature", r"^=|\*$", "")
    longer = F.filter(F.array(*map(F.lit, STEMS)), lambda n: n < F.char_length(bare))
    stems = F.transform(longer, lambda n: F.concat(F.substring(bare, F.lit(1), n), F.lit("*")))
    under = chosen.select("feature", "odds", F.explode(stems).alias("stem"))
    implied = under.join(chosen.select(F.col("feature").alias("stem"), F.col("odds").alias("held")), "stem").filter("held >= odds")
    best = chosen.join(implied.select("feature").distinct(), "feature", "left_anti").collect()
    words = {r.feature[1:]: r.odds for r in best if r.feature[0] == "="}
    return words, {r.feature[:-1]: r.odds for r in best if r.feature[0] != "="}


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic slope and shift by Newton steps, with a weak prior that keeps them finite."""
    a, b = 0.1, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weight * (y - p) * x).sum() - 0.01 * a, (weight * (y - p)).sum() - 0.01 * b])
        w = weight * p * (1 - p)
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 0.0), b


def squash(weight: float) -> float:
    return math.log1p(weight)


def fit_contexts(grammar: Grammar, sums: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
    """Set the context weights and the curve to the best of the values tried, one weight at a time."""

    def likelihood():
        x = np.log1p(sums @ np.array(grammar.shares()))
        slope, shift = fit_curve(x, y, weight)
        z = np.clip(slope * x + shift, -30, 30)
        return float((weight * (y * z - np.log1p(np.exp(z)))).sum()), slope, shift

    best, grammar.slope, grammar.shift = likelihood()
    moved = True
    while moved:  # each change gains LEAST_GAIN, so this ends
        moved = False
        for name, tried in TRIED.items():
            for value in tried:
                before = getattr(grammar, name)
                setattr(grammar, name, value)
                gained, slope, shift = likelihood()
                if gained >= best + LEAST_GAIN:
                    best, grammar.slope, grammar.shift, moved = gained, slope, shift, True
                else:
                    setattr(grammar, name, before)


def fit(docs: DataFrame, labels: DataFrame) -> Grammar:
    """Learn a grammar from labelled training rows."""
    chosen = train_rows(docs, labels)
    totals = chosen.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    n, toxic = totals.n, int(totals.toxic)
    share = toxic / n if n else 0.5
    words, stems = learn_lexicon(_labelled(docs, chosen), n, toxic) if 0 < toxic < n else ({}, {})
    grammar = Grammar(words, stems)
    if not words and not stems:
        grammar.slope, grammar.shift = 0.0, math.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return grammar
    sample = chosen.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 0.8 * FIT_ROWS / n)))
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def summed(texts: pd.Series) -> pd.Series:
        symbols = {}
        return pd.Series([context_sums(t, shared.value, symbols) for t in texts], dtype=object)

    rows = _labelled(docs, sample).select(summed("text").alias("sums"), "toxic")
    seen = rows.groupBy("sums", "toxic").count().orderBy("sums", "toxic").limit(FIT_ROWS).collect()
    if seen:
        fit_contexts(grammar, np.array([r["sums"] for r in seen]), np.array([float(r["toxic"]) for r in seen]), np.array([float(r["count"]) for r in seen]))
    return grammar


def apply(df: DataFrame, grammar: Grammar, text: str = "text") -> DataFrame:
    """Add evidence, matched_clauses and score."""
    shared = df.sparkSession.sparkContext.broadcast(grammar)

    @F.pandas_udf(T.StructType([T.StructField("evidence", T.DoubleType()), T.StructField("clauses", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    def judged(texts: pd.Series) -> pd.DataFrame:
        g, symbols, shares = shared.value, {}, shared.value.shares()
        out = [evidence(t, g, symbols, shares) for t in texts]
        score = [1 / (1 + math.exp(-max(-500.0, min(500.0, g.slope * squash(w) + g.shift)))) for w, _ in out]
        return pd.DataFrame({"evidence": [w for w, _ in out], "clauses": [c for _, c in out], "score": score})

    scored = df.withColumn("_judged", judged(F.col(text)))
    return scored.withColumns({"evidence": F.col("_judged.evidence"), "matched_clauses": F.col("_judged.clauses"), "score": F.col("_judged.score")}).drop("_judged")
