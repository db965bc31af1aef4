"""Stages of the corpus pipeline, and what they hand on."""

import math
import random
from collections import Counter

import pytest

import corpus_pipeline
from churnscope.llm import mixing, pieces, quality, queries, toxicity
from tests.llm.helpers import SF_SMALL, frame, shingles, words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def time_of(progress, weight):
    """The inversion by bisection of the schedule's integral."""
    start, end = mixing.SCHEDULES[weight]
    low, high = 0.0, 1.0
    for _ in range(80):
        t = (low + high) / 2
        low, high = (t, high) if (start * t + (end - start) * t * t / 2) / ((start + end) / 2) < progress else (low, t)
    return (low + high) / 2


def copies_of(r):
    """Whole copies up to the target; the document there counts if that comes nearer."""
    if not r["size"]:
        return 0
    passes, rest = divmod(math.floor(r["target"]), r["source_size"])
    left = rest - r["before"]
    return passes + (left > 0 and left >= r["size"] - left)


def test_positions_invert_the_schedules(spark):
    rng = random.Random(11)
    rows = [(i % 60, "w " * rng.randint(0, 30), "en", rng.choice(["a", "b", "c", None]), 0) for i in range(150)]
    docs = frame(spark, rows, DOCS)
    taken = mixing.taken(docs).collect()
    got = mixing.ordered(docs).collect()
    want = Counter()
    for r in taken:
        for copy in range(copies_of(r)):
            at = time_of((copy * r["source_size"] + r["before"]) / r["target"], int(r["weight"]))
            want[r["doc_id"], r["source"], copy, r["size"], round(at, 6)] += 1
    assert Counter((r["doc_id"], r["source"], r["copy"], r["copy_words"], round(r["position"], 6)) for r in got) == want
    assert [r["position"] for r in got] == sorted(r["position"] for r in got)


def test_documents_come_in_training_order(spark):
    rng = random.Random(12)
    rows = [(i, "w " * rng.randint(0, 30), "en", rng.choice(["a", "b", "c", None]), 0) for i in range(150)]
    docs = frame(spark, rows, DOCS)
    got, copies = mixing.mixed(docs).collect(), mixing.ordered(docs).collect()
    # as the curriculum first reaches them, and those without a copy last
    reached = list(dict.fromkeys(c["doc_id"] for c in copies))
    assert 0 < len(reached) < len(got) == len(rows)
    assert [r["doc_id"] for r in got] == reached + sorted(r["doc_id"] for r in got if not r["taken"])
    for r in got:
        own = [c for c in copies if c["doc_id"] == r["doc_id"]]
        assert r["taken"] == sum(c["copy_words"] for c in own)
        assert (r["first_position"], r["last_position"]) == ((own[0]["position"], own[-1]["position"]) if own else (None, None))


def test_order_survives_the_reread(spark, tmp_path):
    docs = frame(spark, [(i % 12, "one two three " * (i % 4 + 1), "en", "ab"[i % 2], 0) for i in range(30)], DOCS)
    corpus_pipeline.mix_sources(spark, docs, "").write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    got = corpus_pipeline.encode(spark, mixed, "").filter("rank = 1").collect()
    place = lambda r: (r["position"], r["doc_id"], r["twin"], r["copy"])
    want = mixing.mixed_documents(docs).collect()
    assert [place(r) for r in want] == sorted(place(r) for r in got)
    assert sum(len(words_of(r["text"])) for r in mixed.collect()) == sum(len(words_of(r["text"])) for r in want)


def test_samples_are_returned_whole(spark):
    got = queries.op3_sentencepiece(spark, SF_SMALL)
    assert dict(got.dtypes)["ids"] == "array<int>"
    texts = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()}
    vocab = pieces.vocabulary(queries.tokenizer("piece_bpe_32k.model"))
    rows = got.collect()
    assert {(r["doc_id"], 2) for r in rows} >= {(i, 2) for i, t in texts.items() if len(t) > 3}
    assert all(r["round_trip"] is True and r["n_pieces"] == len(r["ids"]) and vocab.decode(r["ids"]) == texts[r["doc_id"]] for r in rows)


def test_repeated_copies_draw_their_own_samples(spark):
    docs = frame(spark, [(1, "the quick brown fox jumps over a lazy dog " * 4, "en", "a", 0)], DOCS)
    copies = docs.selectExpr("*", "0.5D as position", "1 as twin", "explode(array(0, 1, 2)) as copy")
    got = corpus_pipeline.encode(spark, copies, "").collect()
    assert len(got) == 6 and len({tuple(r["ids"]) for r in got if r["rank"] == 1}) == 3


def plain_groups(rows):
    """Groups of row numbers whose texts are equal or similar, by comparing all pairs; rows without an id are alone."""
    sets, to = [shingles(r[1]) if r[0] is not None else set() for r in rows], list(range(len(rows)))

    def root(i):
        while to[i] != i:
            i = to[i]
        return i

    for i, a in enumerate(sets):
        for k, b in enumerate(sets[:i]):
            if a and b and (a == b or min(len(a), len(b)) > 2 and 100 * len(a & b) >= 75 * len(a | b)):
                to[root(i)] = root(k)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    return list(groups.values())


def near_copy_rows():
    rng = random.Random(3)
    new = lambda: " ".join(rng.choice("abcdefghijklmnop") + str(rng.randint(0, 99)) for _ in range(60))
    base = [new() for _ in range(6)]
    near = [t.rsplit(" ", 1)[0] + " other" for t in base]
    rows = [(7, None), (7, "real text of seven"), (7, ""), (8, base[0]), (8, new()), (8, base[1]), (3, near[0]), (9, near[1]), (9, near[1]),
            (4, base[2]), (5, near[2]), (6, base[2]), (None, base[2]), (None, base[2]), (None, None), (2**62, base[3]), (-5, near[3]),
            (-5, new()), (10, "  "), (10, " "), (11, base[4]), (11, base[4]), (11, near[4]), (12, base[5])]
    return rows + [(99, new()) for _ in range(12)]  # a hot id


@pytest.mark.parametrize("repeated", [True, False])
def test_near_copies(spark, repeated):
    rows = near_copy_rows()
    if not repeated:
        seen = set()
        rows = [r for r in rows if r[0] is None or not (r[0] in seen or seen.add(r[0]))]
    rows = [(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)]  # n_chars numbers the rows
    docs = frame(spark, rows, DOCS + ", node long, component_id long, hash long, part int")
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == list(corpus_pipeline.COLUMNS)
    left = Counter(r["n_chars"] for r in got.collect())
    assert set(left.values()) == {1}
    for group in plain_groups(rows):
        stays = [k for k in group if k in left]
        assert len(stays) == 1 and (len(group) == 1 or rows[stays[0]][0] == min(rows[k][0] for k in group))
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_near_copies_of_extreme_ids(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(-2**63, text), (-2**63, text), (-2**63, "alone"), (2**63 - 1, text), (0, "alone too"), (0, "alone three")]
    docs = frame(spark, [(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], DOCS)
    got = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(r["text"] for r in got) == sorted({t for _, t in rows})
    assert all(r["doc_id"] == -2**63 for r in got if r["text"] == text)


EXTRA = ", score double, position double, twin int, copy int, label int, key string, row int"


def corpus(spark, folder):
    """A small corpus with nulls, repeated ids, ties and columns of names that stages use; written as tables."""
    rng = random.Random(9)
    plain = lambda n=40: " ".join(rng.choice("river stone field bread cloud walks north paper seven light".split()) for _ in range(n))
    bad = lambda: plain() + " blarghoid $$$ ### !!! @@@ " * 3
    rows = [(i, bad() if i % 5 == 0 else plain(20 + i % 30), "en", rng.choice(["a", "b", None]), i) for i in range(300)]
    rows += [(7, None, None, "a", None), (7, "a b", "en", "b", 3), (7, "", "en", "b", 0), (None, None, None, None, None), (None, plain(), "en", "a", 1),
             (11, rows[11][1], "en", rows[11][3], 11), (301, rows[12][1], "en", "b", 9), (302, rows[12][1] + " more", "en", "a", 9)]
    frame(spark, rows, DOCS + EXTRA).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 5 == 0), int(i % 5 != 0)) for i in range(300)]
    frame(spark, labels, "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def counted(df, columns=corpus_pipeline.COLUMNS):
    return Counter(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("stage,model,keeps", [
    (corpus_pipeline.drop_toxic, toxicity, lambda score: score < toxicity.THRESHOLD), (corpus_pipeline.drop_poor, quality, lambda score: score >= 0.5)])
def test_classifier_stages_lose_no_other_row(spark, tmp_path, stage, model, keeps):
    folder = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    fitted = model.fit(docs, queries.table(spark, folder, "labels"))
    scores = {}
    for r in model.scored(docs.select(*corpus_pipeline.COLUMNS), fitted).collect():
        scores[tuple(r[c] for c in corpus_pipeline.COLUMNS)] = r["score"]
    every = counted(docs)
    assert set(scores) == set(every)
    got = stage(spark, docs, folder)
    assert got.columns == list(corpus_pipeline.COLUMNS)
    assert counted(got) == Counter({row: n for row, n in every.items() if keeps(scores[row])})
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_mixing_and_encoding_stages(spark, tmp_path):
    folder = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = Counter()  # words per document and copy
    for r in mixing.taken(docs).collect():
        for copy in range(copies_of(r)):
            want[r["doc_id"], r["source"], copy, r["size"]] += 1
    mixed = corpus_pipeline.mix_sources(spark, docs, folder)
    assert mixed.columns == [*corpus_pipeline.COLUMNS, *mixing.ORDER]
    rows = mixed.collect()
    assert Counter((r["doc_id"], r["source"], r["copy"], len(words_of(r["text"]))) for r in rows) == +want
    texts = {(r["doc_id"], r["source"]): set() for r in rows}
    for r in docs.filter("text is not null").collect():
        texts.setdefault((r["doc_id"], r["source"]), set()).add(r["text"])
    assert all(r["text"] in texts[r["doc_id"], r["source"]] for r in rows)
    vocab = pieces.vocabulary(queries.tokenizer("piece_bpe_32k.model"))
    place = lambda r: (r["doc_id"], r["position"], r["twin"], r["copy"])
    got = corpus_pipeline.encode(spark, mixed, folder).collect()
    for rank in (1, 2):
        assert Counter((*place(r), vocab.decode(r["ids"])) for r in got if r["rank"] == rank) == Counter((*place(r), r["text"]) for r in rows)
    for stage in (corpus_pipeline.mix_sources, corpus_pipeline.encode):
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_run_is_its_stages(spark, tmp_path):
    folder = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/out/{name}")
        docs = spark.read.parquet(f"{tmp_path}/out/{name}")
    want = Counter((r["doc_id"], r["position"], r["rank"], tuple(r["ids"])) for r in docs.collect())
    assert want and Counter((r["doc_id"], r["position"], r["rank"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, folder).collect()) == want
    ids = {r["doc_id"] for r in docs.collect()}
    assert not ids & set(range(0, 300, 5)) and ids <= {None, *range(303)}
