import re
from collections import Counter, defaultdict

import pytest

pytest.importorskip("kindred.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from kindred.llm import secrets  # noqa: E402
from tests.llm.test_chosen_path import brute  # noqa: E402

SPACE = re.compile(r"[\x20\x09-\x0D]+")
words = lambda t: [w for w in SPACE.split(t) if w]
normal = lambda x: SPACE.sub(" ", x).strip(" ").lower()


def by_quality(docs):
    at = defaultdict(set)
    for d in docs:
        for line in d.text.split("\n"):
            if normal(line):
                at[d.source, normal(line)].add(d.text)
    for d in docs:
        w = words(d.text)
        if len(w) < 20:
            continue
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        cut = [x for x in d.text.split("\n") if len(at[d.source, normal(x)]) <= 20]
        if 100 * len(covered) <= 30 * len(w) and 100 * len(words("\n".join(cut))) >= 30 * len(w):
            yield d.doc_id, "\n".join(cut) if len(cut) < len(d.text.split("\n")) else d.text


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda d: d.doc_id)
    left = list(by_quality(docs))
    assert 0 < len(left) < len(docs)
    classes, _ = brute([t for _, t in left])
    left = [left[k] for k, c, _ in classes if k == c]
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [norm(r.text).split() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    runs = {" ".join(w[a : a + n]) for w in items for n in [min(13, len(w))] for a in range(len(w) - n + 1)}
    left = [(k, t) for k, t in left if not any(f" {r} " in f" {norm(t)} " for r in runs)]
    left = [(k, secrets.mask(t, secrets.find_spans(t))) for k, t in left]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {k: (t, len(t), library.encode(t, add_special_tokens=False).ids) for k, t in left}
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == [f.name for f in spark.read.parquet(f"{sf_dir}/documents.parquet").schema] + ["ids", "n_tokens"]
    unpack = lambda b: [int.from_bytes(b[k : k + 4], "little") for k in range(0, len(b), 4)]
    assert {r.doc_id: (r.text, r.n_chars, unpack(r.ids)) for r in got.collect()} == want


def test_empty_and_odd_rows_pass_every_stage(spark, sf_dir):
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(None, None, None, None, None), (None, text, "en", None, 1), (1, text, "en", "h", 1), (1, text, "en", "h", 1), (2, "", "en", "h", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table, kept in ((docs, 1), (docs.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, sf_dir)
        assert table.count() == kept
