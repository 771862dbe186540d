"""The same queries as DuckDB SQL over the same tables.

RE2's ``\\s`` and ``\\b`` are ASCII, so the character classes are written out
here too.  Sections are not parsed back from the headed text: the expected
blocks follow from where the headers were put.
"""

from __future__ import annotations

from kindred.functions import wordlists as wl
from kindred.plans import catalog as cat

_SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WORD = r"\p{L}\p{N}_"


def _quoted(items) -> str:
    return ", ".join("'" + str(i).replace("'", "''") + "'" for i in items)


#: Names and sizes are written out here, so that a cut in the code under test shows.
MODELS = ["tfidf", "tf", "chorus", "embedding"]
_STOP = f"[{_quoted(wl.STOP_WORDS)}]"
_NARROW = "(?i)" + "|".join(wl.METADATA_NARROW)
_WIDE = "(?i)" + "|".join(
    wl.METADATA_WIDE
    + [rf"(^|[^{_WORD}]){w}([^{_WORD}]|$)" for w in wl.METADATA_WIDE_WORDS]
    + [rf"(^|[^{_WORD}]){w}[{_WORD}]" for w in wl.METADATA_WIDE_LABELS]
)
_PROSE = "(?i)" + "|".join(
    wl.PROSE_PHRASES
    + [p for p, _ in wl.PROSE_PATTERNS]
    + [rf"{w}([^{_WORD}]|$)" for w in wl.PROSE_WORD_ENDS]
)


def _tokens(text: str, bracket: str = r"\[[^\n]*?\]") -> str:
    footer = rf"regexp_replace(lower({text}), '\p{{Nd}}*embed[^\n]*(\n?)$', '\1')"
    bare = rf"regexp_replace(regexp_replace({footer}, '{bracket}', '', 'g'), '[^\p{{L}}\p{{N}}{_SPACE}]', '', 'g')"
    return (
        f"list_filter(string_split_regex({bare}, '[{_SPACE}]+'), "
        f"lambda t: t <> '' AND NOT list_contains({_STOP}, t))"
    )


def _trim(text: str) -> str:
    return f"regexp_replace({text}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


_TTR = """CASE WHEN len(list_slice(regexp_extract_all(lower(lyrics), '[a-z]+'), 1, 200)) >= 100
    THEN len(list_distinct(list_slice(regexp_extract_all(lower(lyrics), '[a-z]+'), 1, 200)))
       / len(list_slice(regexp_extract_all(lower(lyrics), '[a-z]+'), 1, 200)) END"""
_LIKELY = f"(NOT regexp_matches(lyrics, '{_PROSE}') AND coalesce({_TTR} <= 0.85, true))"

_SONG = "doc_id AS song_id, doc_id AS seq, 'T' || (doc_id // 40) AS track_name, source AS artist"

_SONGS = f"songs AS (SELECT {_SONG}, text AS lyrics FROM documents)"

_MARKED = f"""songs AS (
  SELECT {_SONG},
    CASE WHEN doc_id % 19 = 0 THEN 'embed x' || chr(10) ELSE '' END || text
    || CASE WHEN doc_id % 11 = 0 THEN ' produced by x' ELSE '' END
    || CASE WHEN doc_id % 13 = 0 THEN ' remaster' ELSE '' END
    || CASE WHEN doc_id % 17 = 0 THEN ' label:x' ELSE '' END
    || CASE WHEN doc_id % 37 = 0 THEN ' label: x' ELSE '' END
    || CASE WHEN doc_id % 7 = 0 THEN chr(10) || '12EmbedShare' ELSE '' END AS lyrics
  FROM documents
  UNION ALL
  SELECT -1 - item_id, -1 - item_id, 'B' || item_id, NULL, text FROM benchmark
  UNION ALL
  SELECT -1000000000000 - doc_id, -1000000000000 - doc_id, 'L' || doc_id, 'nobody', NULL FROM labels)"""

_HEADED = f"""songs AS (
  SELECT {_SONG}, text,
    '[Verse 1]' || chr(10) || replace(replace(text, chr(10), chr(10) || '[Chorus]' || chr(10)),
      ', ', ',' || chr(10) || ' [Hook 2] skipped' || chr(10)) AS lyrics
  FROM documents)"""

# Full-text corpus: tokens, bounds, first of each text.
_CLEAN = f"""tokenized AS (
  SELECT song_id, seq, track_name, artist, {_tokens('lyrics')} AS tokens FROM songs
  WHERE lyrics IS NOT NULL AND NOT regexp_matches(lyrics, '{_NARROW}')
    AND NOT coalesce(lower(artist) = 'ryo fukui' AND lower(track_name) = 'my conception', false)),
clean AS (
  SELECT *, len(tokens) AS token_count, array_to_string(tokens, ' ') AS processed_lyrics FROM tokenized
  WHERE len(tokens) BETWEEN 50 AND 2000
  QUALIFY row_number() OVER (PARTITION BY array_to_string(tokens, ' ') ORDER BY seq) = 1)"""

_CORPUS = """corpus AS (
  SELECT * FROM clean QUALIFY row_number() OVER (PARTITION BY track_name, artist ORDER BY seq) = 1)"""


# Blocks of the headed text, from where the headers were put: the lines of the
# text, each cut at ", "; a cut leaves its comma on the block before it.
_BLOCKS = f"""lines AS (
  SELECT song_id, seq, track_name, artist, lyrics, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS i FROM songs),
parts AS (
  SELECT *, unnest(string_split(line, ', ')) AS part, generate_subscripts(string_split(line, ', '), 1) AS j,
    len(string_split(line, ', ')) AS parts FROM lines),
cut AS (
  SELECT *, {_trim("part || CASE WHEN j < parts THEN ',' ELSE '' END")} AS body,
    row_number() OVER (PARTITION BY song_id ORDER BY i, j) AS block_ix,
    CASE WHEN j > 1 THEN 'hook' WHEN i = 1 THEN 'verse' ELSE 'chorus' END AS label FROM parts),
blocks AS (SELECT * FROM cut WHERE body <> ''),
placed AS (SELECT *, min(block_ix) OVER (PARTITION BY song_id, label) AS first_ix FROM blocks WHERE label <> 'verse'),
choruses AS (
  SELECT song_id, string_agg(body, chr(10) ORDER BY first_ix, block_ix) AS chorus_text FROM placed GROUP BY song_id)"""

_CHORUS = rf"""firsts AS (
  SELECT * FROM songs QUALIFY row_number() OVER (PARTITION BY track_name, artist ORDER BY seq) = 1),
chorused AS (
  SELECT f.*, c.chorus_text, regexp_matches(lyrics, '{_WIDE}') AS wide, {_LIKELY} AS likely,
    {_tokens('c.chorus_text', '[[][^]]+[]]')} AS tokens
  FROM firsts f LEFT JOIN choruses c USING (song_id)),
chorus_kept AS (
  SELECT *, len(tokens) AS token_count, array_to_string(tokens, ' ') AS processed_chorus FROM chorused
  WHERE NOT wide AND likely AND chorus_text IS NOT NULL AND len(tokens) >= 10)"""


def _model(name: str, corpus: str, idf: bool = True) -> str:
    """CTEs <name>_vocab and <name>_weights over a corpus with tokens."""
    p = name
    weight = "count(*) * max(v.idf)" if idf else "count(*)"
    return f"""{p}_words AS (SELECT song_id, list_filter(tokens, lambda t: length(t) >= 2) AS w FROM {corpus}),
{p}_grams AS (
  SELECT song_id, unnest(w) AS term FROM {p}_words
  UNION ALL
  SELECT song_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM {p}_words),
{p}_counts AS (
  SELECT term, count(*) AS corpus_count, count(DISTINCT song_id) AS doc_count FROM {p}_grams GROUP BY term),
{p}_top AS (
  SELECT * FROM {p}_counts WHERE doc_count >= 2 ORDER BY corpus_count DESC, term LIMIT 10000),
{p}_vocab AS (
  SELECT *, row_number() OVER (ORDER BY term) - 1 AS term_id,
    ln((1 + (SELECT count(*) FROM {corpus})) / (1 + doc_count)) + 1 AS idf FROM {p}_top),
{p}_raw AS (
  SELECT song_id, term_id, {weight} AS w FROM {p}_grams g JOIN {p}_vocab v USING (term) GROUP BY song_id, term_id),
{p}_weights AS (
  SELECT song_id, term_id, w / sqrt(sum(w * w) OVER (PARTITION BY song_id)) AS weight FROM {p}_raw)"""


_TFIDF = ",\n".join([_HEADED, _CLEAN, _CORPUS, _model("tfidf", "corpus")])

_SEEDS = """seeds AS (
  SELECT artist AS seed_id, lower(arg_min(track_name, seq)) AS seed_title, upper(artist) AS seed_artist
  FROM corpus GROUP BY artist
  UNION ALL VALUES ('any artist', 't1', ''), ('nobody', 'No Such Title', NULL))"""


def _lists(name: str, corpus: str) -> str:
    """CTEs <name>_found and <name>_lists: k songs per seed, zeros included."""
    p = name
    return f"""{p}_found AS (
  SELECT s.seed_id, c.song_id FROM seeds s JOIN {corpus} c ON lower(c.track_name) = lower(s.seed_title)
    AND (coalesce(s.seed_artist, '') = '' OR lower(c.artist) = lower(s.seed_artist))
  QUALIFY row_number() OVER (PARTITION BY s.seed_id ORDER BY c.seq) = 1),
{p}_scored AS (
  SELECT f.seed_id, b.song_id, round(sum(a.weight * b.weight), 6) AS similarity
  FROM {p}_found f JOIN {p}_weights a ON a.song_id = f.song_id JOIN {p}_weights b USING (term_id) GROUP BY ALL),
{p}_lists AS (
  SELECT '{name}' AS model, f.seed_id, c.song_id, c.track_name, c.artist, coalesce(s.similarity, 0) AS similarity,
    row_number() OVER (PARTITION BY f.seed_id ORDER BY coalesce(s.similarity, 0) DESC, c.seq) AS rank
  FROM {p}_found f JOIN {corpus} c ON c.song_id <> f.song_id
  LEFT JOIN {p}_scored s ON s.seed_id = f.seed_id AND s.song_id = c.song_id
  QUALIFY rank <= 10)"""


_EMBEDDED = """embedding_raw AS (
  SELECT song_id, ('0x' || substring(md5(w), 1, 2))::INT % 32 AS term_id, count(*) AS w
  FROM (SELECT song_id, unnest(list_slice(tokens, 1, 256)) AS w FROM corpus) GROUP BY ALL),
embedding_weights AS (
  SELECT song_id, term_id, w / sqrt(sum(w * w) OVER (PARTITION BY song_id)) AS weight FROM embedding_raw)"""

_GIVEN = """loadings AS (
  SELECT term_id, term, t::INT AS topic, ((term_id * 37 + t * 101) % 1000) / 1000.0::DOUBLE - 0.5 AS loading
  FROM tfidf_vocab, range(1, 9) r(t)),
given_scores AS (
  SELECT c.song_id, t::INT AS term_id, coalesce(sum(w.weight * l.loading), 0) AS score
  FROM corpus c CROSS JOIN range(1, 9) r(t) LEFT JOIN tfidf_weights w ON w.song_id = c.song_id
  LEFT JOIN loadings l ON l.term_id = w.term_id AND l.topic = t GROUP BY ALL),
given_weights AS (
  SELECT song_id, term_id, CASE WHEN n > 0 THEN score / n ELSE score END AS weight
  FROM (SELECT *, sqrt(sum(score * score) OVER (PARTITION BY song_id)) AS n FROM given_scores))"""

def _given_at(cut: int) -> str:
    """CTEs <given_cut>_weights, _found and _lists over the first components."""
    p = f"given_{cut}"
    return f"""{p}_weights AS (
  SELECT song_id, term_id, CASE WHEN n > 0 THEN score / n ELSE score END AS weight
  FROM (SELECT *, sqrt(sum(score * score) OVER (PARTITION BY song_id)) AS n FROM given_scores WHERE term_id <= {cut})),
{_lists(p, "corpus")}"""


def _jaccards(models: list[str]) -> str:
    """CTEs lists, attempts, shared_counts and jaccards over <model>_lists and <model>_found."""
    lists = " UNION ALL ".join(f"SELECT * FROM {m}_lists" for m in models)
    attempts = " UNION ALL ".join(f"SELECT '{m}' AS model, seed_id, seed_id IN (SELECT seed_id FROM {m}_found) AS found FROM seeds" for m in models)
    return f"lists AS ({lists}),\nattempts AS ({attempts}),\n" + _SHARED


_SHARED = """shared_counts AS (
  SELECT a.seed_id, a.model AS model_a, b.model AS model_b,
    (SELECT count(*) FROM lists x JOIN lists y ON x.seed_id = y.seed_id AND x.track_name = y.track_name
       AND x.artist = y.artist WHERE x.seed_id = a.seed_id AND x.model = a.model AND y.model = b.model) AS shared,
    (SELECT count(*) FROM lists x WHERE x.seed_id = a.seed_id AND x.model = a.model) AS n_a,
    (SELECT count(*) FROM lists x WHERE x.seed_id = b.seed_id AND x.model = b.model) AS n_b,
    a.found AND b.found AS found
  FROM attempts a JOIN attempts b USING (seed_id)),
jaccards AS (
  SELECT seed_id, model_a, model_b, shared, n_a, n_b,
    round(CASE WHEN model_a = model_b THEN 1.0 WHEN found AND n_a + n_b > shared
      THEN shared::DOUBLE / (n_a + n_b - shared) END, 6) AS jaccard FROM shared_counts)"""


def _axis(name: str, matrix: str, squarings: int = 24) -> str:
    """CTEs <name> (i, v), the leading unit eigenvector by repeated squaring, and <name>_value."""
    parts = [f"{name}_0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {matrix} WHERE i = j) AS v FROM {matrix})"]
    for t in range(squarings):
        parts.append(f"""{name}_s{t} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {name}_{t} a JOIN {name}_{t} b ON a.j = b.i GROUP BY a.i, b.j),
{name}_{t + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {name}_s{t} WHERE i = j) AS v FROM {name}_s{t})""")
    last = f"{name}_{squarings}"
    parts.append(f"""{name} AS MATERIALIZED (
  SELECT i, v / sqrt(sum(v * v) OVER ()) * sign(first_value(v) OVER (ORDER BY abs(v) DESC, i)) AS v
  FROM {last} WHERE j = (SELECT arg_max(i, v) FROM {last} WHERE i = j)),
{name}_value AS MATERIALIZED (SELECT sum(c.v * a.v * b.v) AS value FROM {matrix} c JOIN {name} a ON a.i = c.i JOIN {name} b ON b.i = c.j)""")
    return ",\n".join(parts)


_PCA = f"""x AS MATERIALIZED (SELECT vec_id AS song_id, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) r(i)),
centre AS MATERIALIZED (SELECT i, avg(v) AS m FROM x GROUP BY i),
y AS MATERIALIZED (SELECT song_id, x.i, x.v - m AS v FROM x JOIN centre USING (i)),
c1 AS MATERIALIZED (
  SELECT a.i, b.i AS j, sum(a.v * b.v) / ((SELECT count(*) FROM embeddings) - 1) AS v FROM y a JOIN y b USING (song_id) GROUP BY a.i, b.i),
{_axis("axis1", "c1")},
c2 AS MATERIALIZED (
  SELECT c.i, c.j, c.v - (SELECT value FROM axis1_value) * a.v * b.v AS v FROM c1 c JOIN axis1 a ON a.i = c.i JOIN axis1 b ON b.i = c.j),
{_axis("axis2", "c2")}"""


def _powers(name: str, matrix: str, start: str, steps: int = 400) -> str:
    """CTE <name> (i, v, value): the leading eigenvector of a matrix over songs by power iteration."""
    return f"""{name}_steps(step, i, x) AS (
  SELECT 0, song_id, {start} FROM corpus
  UNION ALL
  SELECT step + 1, i, y / sqrt(sum(y * y) OVER ()) FROM (
    SELECT p.step, k.i, sum(k.v * p.x) AS y FROM {name}_steps p JOIN {matrix} k ON k.j = p.i WHERE p.step < {steps} GROUP BY p.step, k.i)),
{name}_unit AS MATERIALIZED (SELECT i, x AS v FROM {name}_steps WHERE step = {steps}),
{name}_value AS MATERIALIZED (SELECT sum(k.v * a.v * b.v) AS value FROM {matrix} k JOIN {name}_unit a ON a.i = k.i JOIN {name}_unit b ON b.i = k.j),
{name}_sign AS MATERIALIZED (
  SELECT sign(arg_max(l, abs(l))) AS s FROM (SELECT term_id, sum(w.weight * u.v) AS l FROM tfidf_weights w JOIN {name}_unit u ON u.i = w.song_id GROUP BY term_id)),
{name} AS MATERIALIZED (SELECT i, v * s AS v, value FROM {name}_unit, {name}_sign, {name}_value)"""


def _deflated(name: str, matrix: str, axis: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT k.i, k.j, k.v - a.value * a.v * b.v AS v FROM {matrix} k JOIN {axis} a ON a.i = k.i JOIN {axis} b ON b.i = k.j)"""


_LEADING = ",\n".join(
    [
        _TFIDF,
        """k1 AS MATERIALIZED (
  SELECT a.song_id AS i, b.song_id AS j, coalesce(sum(x.weight * y.weight), 0) AS v FROM corpus a CROSS JOIN corpus b
  LEFT JOIN tfidf_weights x ON x.song_id = a.song_id LEFT JOIN tfidf_weights y ON y.song_id = b.song_id AND y.term_id = x.term_id GROUP BY ALL)""",
        _powers("e1", "k1", "1.0::DOUBLE"),
        _deflated("k2", "k1", "e1"),
        _powers("e2", "k2", "((song_id * 37) % 101 - 50)::DOUBLE"),
        _deflated("k3", "k2", "e2"),
        _powers("e3", "k3", "((song_id * 61) % 103 - 51)::DOUBLE"),
        "strongest AS (SELECT 1 AS component, * FROM e1 UNION ALL SELECT 2, * FROM e2 UNION ALL SELECT 3, * FROM e3)",
    ]
)

_MODELS = ",\n".join(
    [
        _TFIDF,
        "tf_vocab AS (SELECT * FROM tfidf_vocab)",
        """tf_raw AS (
  SELECT song_id, term_id, count(*) AS w FROM tfidf_grams JOIN tf_vocab USING (term) GROUP BY song_id, term_id)""",
        """tf_weights AS (
  SELECT song_id, term_id, w / sqrt(sum(w * w) OVER (PARTITION BY song_id)) AS weight FROM tf_raw)""",
        _BLOCKS,
        _CHORUS,
        _model("chorus", "chorus_kept"),
        _SEEDS,
        _EMBEDDED,
        _lists("tfidf", "corpus"),
        _lists("tf", "corpus"),
        _lists("chorus", "chorus_kept"),
        _lists("embedding", "corpus"),
        _jaccards(["tfidf", "tf", "chorus", "embedding"]),
    ]
)


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def _sample(table: str, key: str = "song_id", n: int = 500) -> str:
    return f"SELECT * FROM {table} ORDER BY md5(concat_ws('|', {key}::VARCHAR, '42')), {key} LIMIT {n}"


def _text_pairs(name: str, sample: str) -> str:
    return f"""{name} AS (
  SELECT a.song_id AS song_a, b.song_id AS song_b, coalesce(round(s.similarity, 6), 0) AS similarity
  FROM {sample} a JOIN {sample} b ON a.seq < b.seq
  LEFT JOIN (
    SELECT x.song_id AS sa, y.song_id AS sb, sum(x.weight * y.weight) AS similarity
    FROM {name.split('__')[0]}_weights x JOIN {name.split('__')[0]}_weights y USING (term_id)
    WHERE x.song_id IN (SELECT song_id FROM {sample}) AND y.song_id IN (SELECT song_id FROM {sample})
    GROUP BY ALL) s
    ON s.sa = a.song_id AND s.sb = b.song_id)"""


def _summary(table: str, thresholds, extra: str = "") -> str:
    shares = ", ".join(
        f"round(avg((similarity > {t})::INT), 6) AS above_{str(t).replace('.', '_')}" for t in thresholds
    )
    return (
        f"SELECT {extra}count(*) AS pairs, round(avg(similarity), 6) AS mean, "
        f"round(quantile_cont(similarity, 0.5), 6) AS median, round(max(similarity), 6) AS max, {shares} FROM {table}"
    )


def _histogram(table: str, column: str, bins: int) -> str:
    return f"""span AS (SELECT CASE WHEN min({column}) = max({column}) THEN min({column}) - 0.5 ELSE min({column}) END::DOUBLE AS lo,
  CASE WHEN min({column}) = max({column}) THEN max({column}) + 0.5 ELSE max({column}) END::DOUBLE AS hi FROM {table}),
binned AS (SELECT least(floor({bins} * ({column} - lo) / (hi - lo))::INT + 1, {bins}) AS bin, count(*) AS n
  FROM {table}, span GROUP BY 1),
histogram AS (SELECT g.bin::INT AS bin, round(lo + (g.bin - 1) * ((hi - lo) / {bins}), 6) AS low,
  round(lo + g.bin * ((hi - lo) / {bins}), 6) AS high, coalesce(n, 0)::BIGINT AS count
  FROM range(1, {bins + 1}) g(bin) CROSS JOIN span LEFT JOIN binned USING (bin))"""


_UNIT = """dense AS (SELECT vec_id AS song_id, vec_id AS seq, label, embedding::DOUBLE[] AS vector FROM embeddings),
unit AS (SELECT *, sqrt(list_dot_product(vector, vector)) AS norm FROM dense)"""
_COSINE = """CASE WHEN a.norm > 0 AND b.norm > 0
  THEN round(list_dot_product(a.vector, b.vector) / (a.norm * b.norm), 6) ELSE 0 END"""

# Word counts of the first 256 tokens, hashed to 32 entries.

_ITEMS = """items AS (
  SELECT doc_id::VARCHAR AS track_id, 'T' || (doc_id // 40) AS track_name,
    CASE WHEN doc_id % 29 = 0 THEN NULL ELSE source END AS artist,
    CASE WHEN doc_id % 29 = 0 THEN NULL ELSE 'id-' || source END AS artist_id,
    'album ' || lang AS album, '2001-02' AS release_date, 'added ' || n_chars AS added_at
  FROM documents WHERE doc_id % 23 <> 0)"""
_LANDED = """landed AS (
  SELECT 'T' || (doc_id // 40) AS track_name, source AS artist, text AS lyrics FROM documents JOIN labels USING (doc_id)
  QUALIFY row_number() OVER (PARTITION BY doc_id // 40, source ORDER BY doc_id) = 1),
enriched AS (
  SELECT i.track_id, i.track_name, i.artist, md5(l.lyrics) AS text_md5,
    CASE WHEN l.lyrics IS NULL THEN 'NOT FOUND' ELSE 'FOUND' END AS status
  FROM items i LEFT JOIN landed l ON l.track_name = i.track_name AND l.artist = i.artist)"""


def oracle_sql() -> dict[str, str]:
    text_sample = f"text_sample AS ({_sample('corpus')})"
    text_pairs = _text_pairs("tfidf__pairs", "text_sample")
    sampled = ",\n".join([_TFIDF, text_sample, text_pairs])
    tok = _tokens("lyrics")
    sql = {
        "clean_tokens": _with(
            _MARKED,
            f"""SELECT song_id, array_to_string(tokens, ' ') AS processed_lyrics, len(tokens)::INT AS token_count
FROM (SELECT song_id, {tok} AS tokens FROM songs WHERE lyrics IS NOT NULL)""",
        ),
        "text_gates": _with(
            _MARKED,
            f"""SELECT song_id, regexp_matches(lyrics, '{_NARROW}') AS narrow, regexp_matches(lyrics, '{_WIDE}') AS wide,
  regexp_matches(lyrics, '{_PROSE}') AS prose, round({_TTR}, 6) AS ttr, {_LIKELY} AS likely
FROM songs WHERE lyrics IS NOT NULL""",
        ),
        "drop_report": _with(
            _MARKED,
            f"""SELECT outcome, count(*) AS rows FROM (
  SELECT CASE WHEN reason IS NOT NULL THEN reason
    WHEN row_number() OVER (PARTITION BY reason, processed ORDER BY seq) > 1 THEN 'duplicate'
    WHEN n < 50 THEN 'short' ELSE 'kept' END AS outcome FROM (
    SELECT seq, len(tokens) AS n, array_to_string(tokens, ' ') AS processed,
      CASE WHEN raw IS NOT NULL THEN raw WHEN len(tokens) = 0 THEN 'empty' WHEN len(tokens) < 30 THEN 'short'
        WHEN len(tokens) > 2000 THEN 'long' END AS reason FROM (
      SELECT seq, {tok} AS tokens, CASE
        WHEN lower(artist) = 'ryo fukui' AND lower(track_name) = 'my conception' THEN 'blocklisted'
        WHEN lyrics IS NULL THEN 'no text' WHEN regexp_matches(lyrics, '{_NARROW}') THEN 'metadata'
        WHEN NOT {_LIKELY} THEN 'prose' END AS raw FROM songs)))
GROUP BY outcome""",
        ),
        "clean_corpus": _with(
            f"{_MARKED},\n{_CLEAN}",
            "SELECT song_id, track_name, artist, token_count::INT AS token_count, md5(processed_lyrics) AS text_md5 FROM clean",
        ),
        "blocklist_nullsafe": _with(
            _MARKED,
            """SELECT song_id, track_name, artist FROM songs WHERE lyrics IS NOT NULL
  AND NOT coalesce((lower(artist), lower(track_name)) IN (('src3', 't0'), ('src5', 't1')), false)""",
        ),
        "lemma_tokens": _with(
            f"""{_SONGS}, tokenized AS (SELECT song_id, {tok} AS tokens FROM songs)""",
            """SELECT song_id, array_to_string(list_transform(tokens, lambda t:
  CASE WHEN length(t) > 3 AND t LIKE '%s' THEN substring(t, 1, length(t) - 1) ELSE t END), ' ') AS processed_lyrics
FROM tokenized""",
        ),
        "truncated_tokens": _with(
            f"{_HEADED},\n{_CLEAN}", "SELECT song_id, array_to_string(list_slice(tokens, 1, 256), ' ') AS text FROM clean"
        ),
        "dedup_text": _with(_SONGS, f"SELECT min(song_id) AS song_id FROM songs GROUP BY array_to_string({tok}, ' ')"),
        "dedup_keys": _with(
            _MARKED, "SELECT arg_min(song_id, seq) AS song_id, track_name, artist FROM songs GROUP BY track_name, artist"
        ),
        "token_stats": _with(
            f"{_HEADED},\n{_CLEAN}",
            """SELECT count(*) AS count, round(avg(token_count), 6) AS mean, round(stddev_samp(token_count), 6) AS std,
  round(min(token_count)::DOUBLE, 6) AS min, round(quantile_cont(token_count, 0.25), 6) AS q25,
  round(quantile_cont(token_count, 0.5), 6) AS q50, round(quantile_cont(token_count, 0.75), 6) AS q75,
  round(max(token_count)::DOUBLE, 6) AS max FROM clean""",
        ),
        "token_histogram": _with(
            f"{_HEADED},\n{_CLEAN},\n{_histogram('clean', 'token_count', 50)}", "SELECT bin, low, high, count FROM histogram"
        ),
        "corpus_shape": _with(
            f"{_HEADED},\n{_CLEAN}",
            """SELECT count(*) AS rows, count(DISTINCT track_name) AS distinct_track_name,
  count(DISTINCT artist) AS distinct_artist, count(DISTINCT processed_lyrics) AS distinct_processed_lyrics FROM clean""",
        ),
        "vocabulary": _with(
            _TFIDF,
            "SELECT term, term_id::INT AS term_id, corpus_count, doc_count, round(idf, 6) AS idf FROM tfidf_vocab",
        ),
        "vocabulary_listing": _with(
            _TFIDF,
            """SELECT kind, term, position::INT AS position, vocabulary_size FROM (
  SELECT CASE WHEN contains(term, ' ') THEN 'bigram' ELSE 'unigram' END AS kind, term,
    row_number() OVER (PARTITION BY contains(term, ' ') ORDER BY term) AS position,
    count(*) OVER () AS vocabulary_size FROM tfidf_vocab) WHERE position <= 20""",
        ),
        "tfidf_weights": _with(
            _TFIDF, "SELECT song_id, term_id::INT AS term_id, round(weight, 6) AS weight FROM tfidf_weights"
        ),
        "transform_fitted": _with(
            f"""{_TFIDF},
turns AS (SELECT conv_id || '-' || turn AS song_id, {_tokens('text')} AS tokens FROM conversations),
words AS (SELECT song_id, list_filter(tokens, lambda t: length(t) >= 2) AS w FROM turns),
grams AS (SELECT song_id, unnest(w) AS term FROM words UNION ALL
  SELECT song_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
raw AS (SELECT song_id, term_id, count(*) * max(idf) AS w FROM grams JOIN tfidf_vocab USING (term) GROUP BY ALL)""",
            """SELECT song_id, term_id::INT AS term_id, round(w / sqrt(sum(w * w) OVER (PARTITION BY song_id)), 6) AS weight
FROM raw""",
        ),
        "doc_top_terms": _with(
            _TFIDF,
            """SELECT song_id, rank::INT AS rank, term, weight FROM (
  SELECT song_id, term, round(weight, 6) AS weight,
    row_number() OVER (PARTITION BY song_id ORDER BY round(weight, 6) DESC, term) AS rank
  FROM tfidf_weights JOIN tfidf_vocab USING (term_id)) WHERE rank <= 20""",
        ),
        "seed_lookup": _with(
            ",\n".join([_TFIDF, _SEEDS, _lists("tfidf", "corpus")]),
            """SELECT seed_id, f.song_id IS NOT NULL AS found, f.song_id FROM seeds LEFT JOIN tfidf_found f USING (seed_id)""",
        ),
        "song_inspect": _with(
            ",\n".join([_HEADED, _BLOCKS, _CHORUS]),
            """SELECT track_name, artist, token_count::INT AS token_count, substring(chorus_text, 1, 600) AS chorus_text,
  substring(processed_chorus, 1, 300) AS processed_chorus
FROM chorus_kept WHERE lower(track_name) = 't2' AND lower(artist) = 'src4' ORDER BY seq LIMIT 1""",
        ),
        "seed_topk": _with(
            ",\n".join(
                [_TFIDF, "seeds AS (SELECT 'one' AS seed_id, 't1' AS seed_title, 'src2' AS seed_artist)", _lists("tfidf", "corpus")]
            ),
            "SELECT rank::INT AS rank, track_name, artist, similarity FROM tfidf_lists",
        ),
        "multi_seed_topk": _with(
            ",\n".join([_TFIDF, _SEEDS, _lists("tfidf", "corpus")]),
            "SELECT seed_id, rank::INT AS rank, song_id, track_name, artist, similarity FROM tfidf_lists",
        ),
        "similar_pairs": _with(
            _TFIDF,
            f"""SELECT (row_number() OVER (ORDER BY similarity DESC, song_a, song_b))::INT AS rank, song_a, song_b, similarity FROM (
  SELECT a.song_id AS song_a, b.song_id AS song_b, round(sum(a.weight * b.weight), 6) AS similarity
  FROM tfidf_weights a JOIN tfidf_weights b ON a.term_id = b.term_id AND a.song_id < b.song_id GROUP BY ALL
  ORDER BY similarity DESC, song_a, song_b LIMIT 15)""",
        ),
        "text_neighbours": _with(
            f"""{_TFIDF},
scored AS (SELECT a.song_id AS seed_id, b.song_id, round(sum(a.weight * b.weight), 6) AS similarity
  FROM tfidf_weights a JOIN tfidf_weights b USING (term_id) GROUP BY ALL)""",
            """SELECT seed_id, rank::INT AS rank, song_id, similarity FROM (
  SELECT a.song_id AS seed_id, b.song_id, coalesce(s.similarity, 0) AS similarity,
    row_number() OVER (PARTITION BY a.song_id ORDER BY coalesce(s.similarity, 0) DESC, b.seq) AS rank
  FROM corpus a JOIN corpus b ON a.song_id <> b.song_id
  LEFT JOIN scored s ON s.seed_id = a.song_id AND s.song_id = b.song_id) WHERE rank <= 5""",
        ),
        "sample_pair_scores": _with(sampled, "SELECT song_a, song_b, similarity FROM tfidf__pairs"),
        "sample_similarity_summary": _with(sampled, _summary("tfidf__pairs", (0.1, 0.3, 0.5, 0.9))),
        "sample_similarity_histogram": _with(
            f"{sampled},\n{_histogram('tfidf__pairs', 'similarity', 80)}", "SELECT bin, low, count FROM histogram"
        ),
        "sections": _with(
            f"{_HEADED},\n{_BLOCKS}", "SELECT song_id, block_ix::INT AS block_ix, label, body AS text FROM blocks"
        ),
        "chorus_text": _with(
            f"{_HEADED},\n{_BLOCKS}", "SELECT song_id, chorus_text FROM songs LEFT JOIN choruses USING (song_id)"
        ),
        "chorus_corpus": _with(
            ",\n".join([_HEADED, _BLOCKS, _CHORUS]),
            """SELECT song_id, track_name, artist, token_count::INT AS token_count, md5(processed_chorus) AS text_md5
FROM chorus_kept""",
        ),
        "chorus_report": _with(
            ",\n".join([_HEADED, _BLOCKS, _CHORUS]),
            """SELECT outcome, rows FROM (
  SELECT CASE WHEN wide THEN 'metadata' WHEN NOT likely THEN 'prose' WHEN chorus_text IS NULL THEN 'no chorus'
    WHEN len(tokens) = 0 THEN 'empty' WHEN len(tokens) < 10 THEN 'short' ELSE 'kept' END AS outcome, count(*) AS rows
  FROM chorused GROUP BY 1
  UNION ALL SELECT 'duplicate', (SELECT count(*) FROM songs) - (SELECT count(*) FROM firsts)) WHERE rows > 0""",
        ),
        "shared_corpus_songs": _with(
            ",\n".join([_HEADED, _CLEAN, _CORPUS, _BLOCKS, _CHORUS]),
            "SELECT track_name, artist FROM corpus INTERSECT SELECT track_name, artist FROM chorus_kept",
        ),
        "chorus_vs_full": _with(
            ",\n".join(
                [
                    _TFIDF,
                    _BLOCKS,
                    _CHORUS,
                    _model("chorus", "chorus_kept"),
                    """shared AS (SELECT track_name, artist, concat_ws('|', track_name, artist) AS song_key FROM (
  SELECT track_name, artist FROM corpus INTERSECT SELECT track_name, artist FROM chorus_kept))""",
                    f"picked AS ({_sample('shared', 'song_key', 400)})",
                    "full_sample AS (SELECT song_id, seq FROM corpus JOIN picked USING (track_name, artist))",
                    "chorus_sample AS (SELECT song_id, seq FROM chorus_kept JOIN picked USING (track_name, artist))",
                    _text_pairs("tfidf__pairs", "full_sample"),
                    _text_pairs("chorus__pairs", "chorus_sample"),
                ]
            ),
            _summary("tfidf__pairs", (0.1, 0.3), "'tfidf' AS model, ")
            + "\nUNION ALL\n"
            + _summary("chorus__pairs", (0.1, 0.3), "'chorus' AS model, "),
        ),
        "dense_topk": _with(
            f"""{_UNIT}, seeds AS (SELECT label AS seed_id, min(song_id) AS song_id FROM dense GROUP BY label)""",
            f"""SELECT seed_id, rank::INT AS rank, song_id, similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY similarity DESC, song_id) AS rank FROM (
    SELECT s.seed_id, b.song_id, {_COSINE} AS similarity
    FROM seeds s JOIN unit a USING (song_id) JOIN unit b ON b.song_id <> a.song_id)) WHERE rank <= 10""",
        ),
        "dense_neighbours": _with(
            _UNIT,
            f"""SELECT seed_id, rank::INT AS rank, song_id, similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY similarity DESC, song_id) AS rank FROM (
    SELECT a.song_id AS seed_id, b.song_id, {_COSINE} AS similarity FROM unit a JOIN unit b ON b.song_id <> a.song_id))
WHERE rank <= 5""",
        ),
        "dense_pairs_summary": _with(
            f"""{_UNIT}, picked AS ({_sample('unit')}),
pairs AS (SELECT {_COSINE} AS similarity FROM picked a JOIN picked b ON a.seq < b.seq)""",
            _summary("pairs", (0.3, 0.5, 0.9)),
        ),
        "mean_pool": """SELECT label AS pool, (dim - 1)::INT AS dim,
  round(sum(value * mask) / greatest(sum(mask), 1e-9), 6) AS value FROM (
  SELECT label, coalesce(quality, 0) AS mask, unnest(embedding::DOUBLE[]) AS value,
    generate_subscripts(embedding, 1) AS dim FROM embeddings LEFT JOIN labels ON doc_id = vec_id)
GROUP BY label, dim""",
        "embed_cache": _with(
            ",\n".join([_HEADED, _CLEAN, _CORPUS])
            + """,
half AS (SELECT * FROM clean WHERE song_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY track_name, artist ORDER BY seq) = 1)""",
            """SELECT run, count(*) AS songs, CASE run WHEN 1 THEN count(*) WHEN 3 THEN count(*) FILTER (song_id % 29 = 0 OR song_id % 31 = 0)
  ELSE 0 END AS embedded
FROM corpus, (VALUES (1), (2), (3), (5)) r(run) GROUP BY run
UNION ALL SELECT 4, count(*), count(*) FILTER (song_id NOT IN (SELECT song_id FROM corpus)) FROM half""",
        ),
        "given_topk": _with(
            ",\n".join([_TFIDF, _GIVEN, _SEEDS, _lists("given", "corpus")]),
            "SELECT seed_id, rank::INT AS rank, song_id, similarity FROM given_lists",
        ),
        "given_topics": _with(
            f"{_TFIDF},\n{_GIVEN}",
            """SELECT topic, rank::INT AS rank, term, loading FROM (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY loading DESC, term) AS rank FROM loadings) WHERE rank <= 8""",
        ),
        "given_song_topics": _with(
            f"{_TFIDF},\n{_GIVEN}",
            """SELECT song_id, rank::INT AS rank, term_id AS topic, round(weight, 4) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY -abs(weight), term_id) AS rank FROM given_weights) WHERE rank <= 5""",
        ),
        "given_variance": _with(
            f"{_TFIDF},\n{_GIVEN}",
            """SELECT component, round(v / total, 6) AS ratio, round(sum(v / total) OVER (ORDER BY component), 6) AS cumulative
FROM (SELECT term_id AS component, var_pop(score) AS v FROM given_scores GROUP BY term_id),
  (SELECT sum(ss / n - (s / n) * (s / n)) AS total FROM
    (SELECT sum(weight) AS s, sum(weight * weight) AS ss FROM tfidf_weights GROUP BY term_id), (SELECT count(*)::DOUBLE AS n FROM corpus))""",
        ),
        "given_components_needed": _with(
            f"{_TFIDF},\n{_GIVEN}",
            """SELECT threshold, min(component) FILTER (cumulative >= threshold)::INT AS components FROM (
  SELECT component, sum(v / total) OVER (ORDER BY component) AS cumulative
  FROM (SELECT term_id AS component, var_pop(score) AS v FROM given_scores GROUP BY term_id),
    (SELECT sum(ss / n - (s / n) * (s / n)) AS total FROM
      (SELECT sum(weight) AS s, sum(weight * weight) AS ss FROM tfidf_weights GROUP BY term_id), (SELECT count(*)::DOUBLE AS n FROM corpus))),
  (VALUES (0.000001::DOUBLE), (0.001::DOUBLE), (0.9::DOUBLE)) t(threshold) GROUP BY threshold""",
        ),
        "given_sweep": _with(
            ",\n".join([_TFIDF, _GIVEN, _SEEDS, *[_given_at(c) for c in (2, 4, 8)], _jaccards(["given_2", "given_4", "given_8"])]),
            "SELECT seed_id, model_a, model_b, shared, n_a, n_b, jaccard FROM jaccards",
        ),
        "four_recommenders": _with(
            ",\n".join([_MODELS, _GIVEN, _lists("given", "corpus")]),
            "SELECT s.seed_id, g.rank::INT AS rank, "
            + ", ".join(
                f"coalesce((SELECT max(l.track_name || ' / ' || l.artist) FROM {m}_lists l WHERE l.seed_id = s.seed_id AND l.rank = g.rank), '[not found]') AS {m}"
                for m in ("tfidf", "given", "chorus", "embedding")
            )
            + " FROM seeds s CROSS JOIN range(1, 11) g(rank)",
        ),
        "leading_scores": "WITH RECURSIVE "
        + _LEADING
        + "\nSELECT i AS song_id, component::INT AS component, round(v * sqrt(value), 5) AS score FROM strongest",
        "leading_quality": "WITH RECURSIVE "
        + _LEADING
        + "\nSELECT component::INT AS component, round(sqrt(any_value(value)), 5) AS sigma, true AS converged, true AS orthogonal FROM strongest GROUP BY component",
        "pca_2d": _with(
            _PCA,
            """SELECT y.song_id, round(sum(y.v * a.v), 6) AS pc1, round(sum(y.v * b.v), 6) AS pc2,
  round(((SELECT value FROM axis1_value) + (SELECT value FROM axis2_value)) / (SELECT sum(v) FROM c1 WHERE i = j), 6) AS variance_ratio
FROM y JOIN axis1 a ON a.i = y.i JOIN axis2 b ON b.i = y.i GROUP BY y.song_id""",
        ),
        "every_song_topk": _with(
            f"""{_TFIDF}, every_scored AS (
  SELECT a.song_id AS seed_id, b.song_id, round(sum(a.weight * b.weight), 6) AS similarity
  FROM tfidf_weights a JOIN tfidf_weights b USING (term_id) WHERE a.song_id <> b.song_id GROUP BY ALL),
every_ranked AS (
  SELECT x.song_id AS seed_id, y.song_id, coalesce(s.similarity, 0) AS similarity,
    row_number() OVER (PARTITION BY x.song_id ORDER BY coalesce(s.similarity, 0) DESC, y.seq) AS rank
  FROM corpus x JOIN corpus y ON x.song_id <> y.song_id
  LEFT JOIN every_scored s ON s.seed_id = x.song_id AND s.song_id = y.song_id QUALIFY rank <= 5)""",
            "SELECT seed_id, rank::INT AS rank, song_id, similarity FROM every_ranked",
        ),
        "embedding_topk": _with(
            ",\n".join([_HEADED, _CLEAN, _CORPUS, _EMBEDDED, _SEEDS, _lists("embedding", "corpus")]),
            "SELECT seed_id, rank::INT AS rank, song_id, similarity FROM embedding_lists",
        ),
        "four_model_table": _with(
            _MODELS,
            "SELECT s.seed_id, g.rank::INT AS rank, "
            + ", ".join(
                f"coalesce(max(l.track_name || ' / ' || l.artist) FILTER (l.model = '{m}'), '[not found]') AS {m}"
                for m in MODELS
            )
            + f""" FROM seeds s CROSS JOIN range(1, 11) g(rank)
LEFT JOIN lists l ON l.seed_id = s.seed_id AND l.rank = g.rank GROUP BY s.seed_id, g.rank""",
        ),
        "side_by_side": _with(
            _MODELS,
            """SELECT coalesce(a.seed_id, b.seed_id) AS seed_id, coalesce(a.rank, b.rank)::INT AS rank,
  a.track_name AS left_track_name, a.artist AS left_artist, a.similarity AS left_similarity,
  b.track_name AS right_track_name, b.artist AS right_artist, b.similarity AS right_similarity
FROM tfidf_lists a FULL JOIN chorus_lists b ON a.seed_id = b.seed_id AND a.rank = b.rank""",
        ),
        "model_overlap": _with(_MODELS, "SELECT seed_id, model_a, model_b, shared, n_a, n_b, jaccard FROM jaccards"),
        "overlap_matrix": _with(
            _MODELS,
            "SELECT seed_id, model_a, "
            + ", ".join(f"max(jaccard) FILTER (model_b = '{m}') AS {m}" for m in MODELS)
            + " FROM jaccards GROUP BY seed_id, model_a",
        ),
        "model_unique": _with(
            _MODELS,
            """SELECT c.seed_id, c.track_name, c.artist, (SELECT count(DISTINCT model) FROM lists o WHERE o.model <> 'chorus'
  AND o.seed_id = c.seed_id AND o.track_name = c.track_name AND o.artist = c.artist)::INT AS shared_with
FROM chorus_lists c""",
        ),
        "model_unique_counts": _with(
            _MODELS,
            """SELECT c.seed_id, count(*) FILTER (NOT hit) AS unique_songs, count(*) FILTER (hit) AS shared_songs FROM (
  SELECT seed_id, (seed_id, track_name, artist) IN (SELECT (seed_id, track_name, artist) FROM lists WHERE model <> 'chorus')
    AS hit FROM chorus_lists) c GROUP BY c.seed_id""",
        ),
        "listed_by_others": _with(
            _MODELS, "SELECT DISTINCT seed_id, track_name, artist FROM lists WHERE model <> 'chorus'"
        ),
        "list_set_operations": _with(
            f"""{_MODELS}, a AS (SELECT track_name, artist FROM tfidf_lists), b AS (SELECT track_name, artist FROM chorus_lists)""",
            """SELECT 'both' AS part, * FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'either', * FROM (SELECT * FROM a UNION SELECT * FROM b)
UNION ALL SELECT 'first only', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
        ),
        "flatten_pages": _with(_ITEMS, "SELECT * FROM items"),
        "enrich_lyrics": _with(f"{_ITEMS},\n{_LANDED}", "SELECT * FROM enriched"),
        "lyrics_coverage": _with(
            f"{_ITEMS},\n{_LANDED}", "SELECT count(text_md5) AS fetched, count(*) AS total FROM enriched"
        ),
        "csv_round_trip": _with(
            _MARKED, "SELECT song_id::VARCHAR AS track_id, track_name, artist, md5(lyrics) AS text_md5 FROM songs"
        ),
    }
    return sql
