"""What the Python workers hold while they score and sample, and that they give it back."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from churnscope.llm import pieces, quality, queries, text, toxicity

TEXTS = [None, "", " \t\n", "a", "ONE two three!", "é ü\x0bñ ß", "x " * 3000, "# $ one two\nthree"]


def prose(size):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefgé,#1") for _ in range(rng.randint(1, 10))) for _ in range(5000)]
    out = []
    while size > 0:
        out.append(" ".join(rng.choices(words, k=400)))
        size -= len(out[-1].encode())
    return out


def model():
    return toxicity.Model(np.arange(1024) * 911 % (1 << toxicity.BITS), np.linspace(-1, 1, 1024), -0.5)


def trees():
    rng = np.random.default_rng(22)
    x = quality.statistics(text.as_strings(pa.array(prose(200_000))))
    return quality.grow(x, (rng.random(len(x)) < 0.5).astype(float))


def peak(run):
    tracemalloc.start()
    run()
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return top / 1e6


@pytest.mark.parametrize("made", [model, trees])
def test_scores_take_little_beside_their_texts(made):
    column, scorer = pa.array(prose(4_000_000)), made()
    scorer.scores(column)
    assert peak(lambda: scorer.scores(column)) < 40


def test_a_slice_of_the_pipelines_samples_takes_little():
    texts = prose(corpus_pipeline.AT_ONCE)
    keys = text.mix(np.arange(len(texts), dtype=np.uint64))
    vocab = pieces.Vocabulary(queries.tokenizer("piece_bpe_32k.model"))
    assert peak(lambda: pieces.sample_texts(vocab, texts, keys, 2)) < 50


def test_samples_do_not_depend_on_the_slices(spark):
    df = spark.createDataFrame(list(enumerate([*TEXTS, *prose(20_000)])), "doc_id long, text string").coalesce(1)
    path = queries.tokenizer("piece_bpe_32k.model")
    some = [{(r["doc_id"], r["rank"], tuple(r["ids"])) for r in pieces.sampled(df, "doc_id", "text", path, keep=pieces.checked, **more).collect()}
            for more in ({}, {"at_once": 1}, {"at_once": 5_000})]
    assert some[0] == some[1] == some[2]


@pytest.mark.parametrize("stage,made", [(toxicity.scored, model), (quality.scored, trees)])
def test_scored_rows_are_those_of_the_scorer(spark, stage, made):
    scorer = made()
    got = stage(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), scorer).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"]) for r in got] == list(enumerate(TEXTS))
    assert [r["score"] for r in got] == scorer.scores(pa.array(TEXTS)).tolist()


def test_tidy_releases_also_when_no_more_is_asked_for(monkeypatch):
    done = []
    monkeypatch.setattr(text, "release", lambda: done.append(1))
    rows = text.tidy(lambda batches: (b for b in batches))(iter([1, 2, 3]))
    assert next(rows) == 1 and not done
    rows.close()
    assert done == [1]
