import pytest

pytest.importorskip("kindred.llm")
from kindred.llm import chosen_path, quality  # noqa: E402

SCHEMA = "doc_id long, text string, source string, n_words string"


def words(tag, n):
    return " ".join(f"{tag}{k}" for k in range(n))


def test_base_figures(spark):
    run = words("r", 8)
    rows = [
        (1, None, "a", ""), (2, "", "a", ""), (3, words("w", 25), "a", ""), (4, f"{run} x {run}\n{words('y', 50)}", "a", ""),
        (5, "Same *#\n\n \nSame *#\nsame *#", None, ""), (6, "a " * 40, "a", ""),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.base(df).collect()}
    assert [(got[k].n_words, got[k].base_failed) for k in (1, 2, 3)] == [(0, True), (0, True), (25, False)]
    assert got[4].n_repeat_words == 16 and not got[4].base_failed
    assert (got[5].n_dup_lines, got[5].n_symbols, got[5].word_chars) == (1, 6, 18)
    assert got[6].n_repeat_words == 40 and got[6].base_failed


def test_lines_of_many_documents_go_and_depleted_documents_too(spark):
    footer = words("footer", 30)
    rows = [(k, f"{words(f'own{k}x', 25)}\n  {footer.upper()} ", "h", "x") for k in range(6)]
    rows += [(10, f"{footer}\n{words('z', 3)}", "h", "x"), (11, footer, "other", "x"), (12, footer, None, "x")]
    rows += [(20 + k, words("copied", 30), "h", "x") for k in range(9)] + [(None, words("n", 30), "h", "x")] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    judged = quality.judge(df.drop("n_words"), most_documents=5).collect()
    assert len(judged) == len(rows)
    assert sorted(str(r.doc_id) for r in judged if not r.kept) == ["10"]
    kept = quality.clean(df, most_documents=5).collect()
    assert kept[0].asDict().keys() == {"doc_id", "text", "source", "n_words"} and len(kept) == len(rows) - 1
    by = {r.doc_id: r.text for r in kept}
    assert by[0] == words("own0x", 25) and by[11] == footer and by[12] == footer and by[None] == words("n", 30)


def near_copies(group, n):
    for k in range(n):
        own = [f"g{group}w{j}" for j in range(120)]
        own[k * 7 % 120] = f"changed{k}"
        yield "\n".join(" ".join(own[a : a + 12]) for a in range(0, 120, 12))


@pytest.mark.parametrize("most", [quality.BROADCAST_TEXTS, 0])
def test_near_copies_count_once_and_footers_still_go(spark, most):
    footer = words("footer", 30)
    rows = [(k, t, "h", "x") for k, t in enumerate(near_copies(0, 60))] + [(100 + k, t, None, "x") for k, t in enumerate(near_copies(1, 300))]
    rows += [(500 + k, f"{words(f'own{k}x', 25)}\n{footer}", "h", "x") for k in range(30)] + [(600 + k, f"{footer}\n{words(f'stub{k}x', 12)}", "h", "x") for k in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    hit = {r.row for r in quality.line_hits(df, fold=True, broadcast_texts=most).select("row").distinct().collect()}
    assert hit == {r.row for r in df.filter("doc_id >= 500").select(quality._row().alias("row")).collect()}
    if most:
        kept = {r.doc_id: r.text for r in quality.clean(df).collect()}
        want = {r[0]: r[1] for r in rows if r[0] < 500} | {500 + k: words(f"own{k}x", 25) for k in range(30)}
        assert kept == want


def test_one_of_a_near_copy_group_is_left_after_the_join(spark):
    df = spark.createDataFrame([(k, t, "h", "x") for k, t in enumerate(near_copies(0, 60))], SCHEMA)
    left = chosen_path.keep_one(quality.clean(df)).collect()
    assert [(r.doc_id, r.text) for r in left] == [(0, next(near_copies(0, 1)))]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert quality.clean(df).collect() == [] and quality.judge(df.drop("n_words")).collect() == []
