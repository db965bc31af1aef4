"""Defined cases of the operators, against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from churnscope.llm import chat, fingerprints, mixing, nearest, pages, pieces, quality, queries, text, token_counts, toxicity
from churnscope.llm.labelled_pages import PAGES
from tests.llm.helpers import SF_SMALL, frame, shingles, words_of

EXTRA = ", n_chars long, guest int, range int, slice string, twin int, text2 string"
TEXTS = [None, "", " \t\n", "a", "A b", "one two three four five", "ONE two three four five six", "é ü\x0bñ ß", "x " * 3000,
         "one two three four five"]


def docs(spark, texts=TEXTS, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return frame(spark, list(zip(ids, texts, strict=True)), "doc_id long, text string" + EXTRA)


def test_shingle_kernel_matches_plain_sets():
    many = [len(shingles(t)) for t in TEXTS]
    got = [len(np.unique(s)) for _, h, m in text.shingles_of(pa.array(TEXTS)) for s in np.split(h, np.cumsum(m)[:-1])]
    assert got == many


@pytest.mark.parametrize("ids", [range(10), [5, 5, None, None, 3, 9, 9, 9, -4, 2**40], [None] * 10, [1] + [None] * 9])
def test_edited_fingerprints(spark, ids):
    rows = sorted(zip(ids, TEXTS, strict=True), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    want = Counter()
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
    got = fingerprints.edited_fingerprints(docs(spark, ids=ids)).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    for common, a, b in ((0, 50, 60), (30, 40, 50), (3000, 4000, 5000), (900, 900, 9000)):
        h = rng.integers(0, 2**64, a + b, dtype=np.uint64)
        x, y = h[:a], np.concatenate([h[a - common:a], h[a:a + b - common]])
        s, t = fingerprints.bottom_k(x), fingerprints.bottom_k(y)
        assert abs(fingerprints.resemblance(s, t) - common / (a + b - common)) < 0.15
        assert abs(fingerprints.containment(s, t) - common / a) < 0.35
        assert abs(fingerprints.distinct(s) / a - 1) < 0.35
        assert (fingerprints.merged(s, t) == fingerprints.bottom_k(np.concatenate([x, y]))).all()


def test_merge_fingerprints(spark):
    parts = [f"w{i} x y z{i} q r s{i}" for i in range(40)]
    df = docs(spark, parts)
    df = df.withColumn("fp", fingerprints.fingerprint(df["text"])).withColumn("k", df["doc_id"] % 3)
    got = {r["k"]: r["fingerprint"] for r in fingerprints.merge_fingerprints(df, "k", "fp", held=2).collect()}
    for k in range(3):
        own = [s for i, s in enumerate(fingerprints.sketches_of(parts)) if i % 3 == k]
        assert got[k] == fingerprints.encode(np.unique(np.concatenate(own))[:fingerprints.K])


def test_token_counts_match_the_library(spark):
    from tokenizers import Tokenizer
    path = queries.tokenizer("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    odd = [*TEXTS, "it's <|endoftext|> 123 a.b!!", "İstanbul ΟΔΟΣ é   x y 中文 🙂🙂", "don't I'LL we've", "\x1c\x85 µ ª º"]
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"])
           for r in token_counts.token_counts(docs(spark, odd), path).collect()}
    for i, t in enumerate(odd):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 2048), t


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\s> [\\\\/INST] <<s>>", None, "", "a\n[INST] b\nc", "\\", "<s", "ü</s"]
    rows = [(c, t, random.Random(c * 9 + t).choice(["user", "assistant", "sy\nst\\nem", None]), nasty[(c + t) % len(nasty)])
            for c in range(6) for t in range(8)] + [(None, 0, "user", "x")]
    df = frame(spark, rows, "conv_id long, turn long, role string, text string, t int, formatted int")
    rendered = chat.render(df.select("conv_id", "turn", "role", "text"))
    got = {r["conv_id"]: r for r in rendered.withColumn("turns", chat.parse(rendered["formatted"])).collect()}
    digest = {r["conv_id"]: r for r in chat.digests(rendered).collect()}
    for c in (*range(6), None):
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == own
        loss = "".join(t for r, t in own if r == "assistant")
        assert digest[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and digest[c]["loss_chars"] == len(loss)
        whole = "".join(f"{r}\n{t}\n" for r, t in own)
        assert digest[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()


def test_roles_come_back(spark):
    roles = ["a\x00\x01b", "\\", "\\n", "\n", "\\\\n\n\\", "a\\\nb", "</s>\n[INST]", "\\\\", "", "n\\\\\\n"]
    df = frame(spark, [(r,) for r in roles], "role string")
    got = df.select("role", chat.unescape_role(chat.escape_role(df["role"])).alias("back"), chat.escape_role(df["role"]).alias("line")).collect()
    assert all(r["role"] == r["back"] and "\n" not in r["line"] for r in got)


def test_chat_fold(spark):
    log = [(1, 1, "message", 0, 0, "user", "hi"), (1, 2, "delta", 1, 0, "assistant", "Go"), (1, 3, "delta", 1, 0, "assistant", "od"),
           (1, 4, "regenerate", 1, 0, "assistant", None), (1, 6, "delta", 1, 0, "assistant", "e"), (1, 5, "delta", 1, 0, "assistant", "Fin"),
           (1, 7, "edit", 0, 0, "user", "hello"), (1, 8, "message", 2, 0, "user", "gone"), (1, 9, "delete", 2, 0, "user", None)]
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, turn long, part int, role string, text string")
    got = chat.messages(df).orderBy("turn").collect()
    assert [(r["turn"], r["role"], r["text"]) for r in got] == [(0, "user", "hello"), (1, "assistant", "Fine")]


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i % 70, rng.choice(["a", "b", "tiny", None]) if i else "tiny", rng.choice([None, "w " * rng.randint(0, 40)])) for i in range(200)]
    rows = [(i, "tiny" if s == "tiny" and k < 4 else "a" if s == "tiny" else s, t) for k, (i, s, t) in enumerate(rows)]
    df = spark.createDataFrame([(i, t, s, "x") for i, s, t in rows], "doc_id long, text string, source string, before string")
    got = mixing.taken(df).collect()
    assert len(got) == 200 and sorted(r["size"] for r in got) == sorted(len(words_of(t)) for _, _, t in rows)
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        # the document at the target is taken whole or not at all, whichever is nearer
        assert abs(sum(r["taken"] for r in own) - math.floor(own[0]["target"])) <= max(r["size"] for r in own) / 2
        assert all(r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in own)
    assert abs(sum({r["source"]: r["target"] for r in got}.values()) - sum(r["size"] for r in got)) < 1e-6
    made = mixing.mixed_documents(df).collect()
    assert sum(len(words_of(r["text"])) for r in made) == sum(r["taken"] for r in got)
    assert all(0 <= r["position"] <= 1 + 1e-9 for r in made)
    assert Counter((r["doc_id"], r["text"]) for r in made) <= Counter({(i, t): 3 * n for (i, t), n in Counter((i, t) for i, _, t in rows).items()})
    assert mixing.taken(df.limit(0)).count() == 0
    # the query's rows are those of the curriculum
    copies = mixing.curriculum(df).collect()
    want = Counter()
    for r in mixing.mixed(df).collect():
        assert (r["taken"] > 0) == (r["first_position"] is not None) and (r["first_position"] or 0) <= (r["last_position"] or 0)
        want[r["doc_id"]] += r["taken"]
    got = Counter()
    for c in copies:
        got[c["doc_id"]] += c["copy_words"]
    assert got == +want


def test_nearest_ties_and_invalid_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 4]) for i in range(300)]
    rows += [(0, [0.5, 0.5]), (301, None), (302, [None, 1.0]), (303, [float("nan")]), (None, [9.0] * 6), (304, []), (50, [0.25] * 6)]
    df = frame(spark, rows, "vec_id long, embedding array<float>, id int, v int")
    got = Counter(tuple(r) for r in nearest.top_k(df, "vec_id", "embedding", 50, 5).select("query_id", "rank", "vec_id", "score").collect())
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = Counter()
    for q, a in ok:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:5]
            want.update((q, k, i, -s) for k, (s, i) in enumerate(best, 1))
    assert got == want


def test_nearest_scores_beyond_doubles_and_longs(spark):
    rng = np.random.default_rng(4)
    for size in (300_000.0, 1e6, 1e12, 1e200):
        rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(120)]
        rows += [(200 + i, [float(x) * size for x in rng.integers(-3, 4, 4)]) for i in range(40)] + [(400, [size] * 4), (450, [-size] * 4)]
        df = frame(spark, rows, "vec_id long, embedding array<double>, beyond string")
        got = {tuple(r) for r in nearest.top_k(df, "vec_id", "embedding", 50, 5).select("query_id", "rank", "vec_id", "score").collect()}
        whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
        want = set()
        for q, a in whole:
            if q % 50 == 0:
                best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q)[:5]
                want |= {(q, k, i, min(max(-s, -2**63), 2**63 - 1)) for k, (s, i) in enumerate(best, 1)}
        assert got == want, size


def test_pages(spark):
    model = pages.trained()
    html = ("<html><body><nav><a href=x>Menu</a></nav><article><h1>A &amp; B</h1><p>Some long enough text of the page, with a "
            "sentence.<p>Two\n  lines</article><div class='comments'><p>I do not agree at all with this.</p></div><footer>c</footer>")
    assert model.extract(html) == "A & B Some long enough text of the page, with a sentence. Two lines"
    right = total = 0
    for page in PAGES:
        nodes = pages.parse(page)
        for i, (node, c) in enumerate(zip(nodes, model.marginals(nodes), strict=True)):
            label = node
            while label.mark is None and label.parent >= 0:
                label = nodes[label.parent]
            total += node.own > 0
            right += node.own > 0 and (c >= 0.5) == (label.mark == "1")
    assert right / total > 0.97
    df = frame(spark, [(1, "u", None), (2, None, ""), (3, "u", html), (3, "u", html), (4, "u", "<p <b")], "page_id long, url string, html string, text int")
    assert {r["page_id"]: r["n_chars"] for r in pages.main_text(df).collect()}[1] == 0


def test_sampled_segmentations_match_the_lattice():
    vocab = pieces.vocabulary(queries.tokenizer("piece_bpe_32k.model"))
    lib = vocab.library
    weight = {int(i): w for i, w in zip(vocab.ids, vocab.weights, strict=True)}
    ids = {lib.id_to_piece(i): i for i in weight}

    def paths(s):
        if not s:
            return {(): 0.0}
        out = {}
        if s[0] not in ids:
            own = tuple(int(vocab.bytes[b]) for b in s[0].encode())
            out |= {own + p: vocab.unknown + w for p, w in paths(s[1:]).items()}
        for j in range(1, len(s) + 1):
            if s[:j] in ids:
                out |= {(ids[s[:j]], *p): weight[ids[s[:j]]] + w for p, w in paths(s[j:]).items()}
        return out

    for t in ("the of", "a\nbé", "is", "\U0001f642 x"):
        every = paths("▁" + t.replace(" ", "▁"))
        z = np.logaddexp.reduce(list(every.values()))
        n, first, mass = 2000, Counter(), 0.0
        for found in pieces.sample_texts(vocab, [t] * n, text.mix(np.arange(n, dtype=np.uint64)), 3):
            assert len({tuple(f[0]) for f in found}) == len(found) <= 3
            assert all(abs(every[tuple(f[0].tolist())] - z - f[1]) < 1e-6 and vocab.decode(f[0].tolist()) == t for f in found)
            first[tuple(found[0][0].tolist())] += 1
            mass += sum(math.exp(f[1] - f[3]) for f in found)
        assert abs(mass / n - 1) < 0.02
        assert all(abs(first[p] / n - math.exp(w - z)) < 0.05 for p, w in every.items())


def test_held_lattices_change_no_sample(monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeé \t1") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(40)] + [None, "", "\U0001f642" * 5]
    keys = text.mix(np.arange(len(texts), dtype=np.uint64))
    path = queries.tokenizer("piece_bpe_32k.model")

    def samples(slices):
        vocab = pieces.Vocabulary(path)
        out = []
        for at in range(0, len(texts), slices):
            out += pieces.sample_texts(vocab, texts[at:at + slices], keys[at:at + slices], 3)
        return [[(f[0].tolist(), round(f[1], 9), round(f[2], 9), round(f[3], 7)) for f in found] for found in out]

    held = samples(7)
    monkeypatch.setattr(pieces, "HELD", 900)
    assert samples(5) == held
    monkeypatch.setattr(pieces, "HELD", 0)
    assert samples(11) == held


def test_another_kind_of_model_is_refused(monkeypatch):
    monkeypatch.setattr(pieces, "PROBE", "a\u200bb")  # stands for any text that the model's normalizer changes
    path = queries.tokenizer("piece_bpe_32k.model")
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    if library.normalize(pieces.PROBE) != "▁" + pieces.PROBE:
        with pytest.raises(ValueError):
            pieces.Vocabulary(path)


def test_samples_of_null_keys_repeated_rows_and_empty_tables(spark):
    path = queries.tokenizer("piece_bpe_32k.model")
    df = frame(spark, [(None, "one two"), (1, "one two"), (1, "one two"), (2, None), (3, "a")], "doc_id long, text string, ids string, rank int, draw long")
    got = pieces.sampled(df, "doc_id", "text", path, k=3, keep=pieces.checked).collect()
    by = Counter((r["doc_id"], r["rank"], tuple(r["ids"])) for r in got)
    assert all(n == (2 if k[0] == 1 else 1) for k, n in by.items())
    assert [(r["rank"], r["ids"], r["inclusion"]) for r in got if r["doc_id"] == 2] == [(1, [], 0.0)]
    assert {r["doc_id"] for r in got} == {None, 1, 2, 3} and all(r["round_trip"] for r in got if r["doc_id"] != 2)
    assert pieces.sampled(df.limit(0), "doc_id", "text", path).count() == 0


def test_sampled_frame(spark):
    got = pieces.sampled(docs(spark), "doc_id", "text", queries.tokenizer("piece_bpe_32k.model"), keep=pieces.digest).collect()
    assert {r["doc_id"] for r in got} == set(range(10)) and all(r["round_trip"] in (True, None) for r in got)


@pytest.mark.parametrize("operator,fold,label", [(toxicity.toxicity, (3, 1), "toxic"), (quality.quality, (4, 2), "quality")])
def test_classifiers(spark, operator, fold, label):
    rng = random.Random(7)
    plain = lambda: " ".join(rng.choice(["river", "stone", "field", "bread", "cloud", "walks"]) for _ in range(40))
    bad = lambda: plain() + " blarghoid $$$ ### !!! @@@ " * 3
    rows = [(i, bad() if i % 5 == 0 else plain()) for i in range(600)] + [(None, None), (700, ""), (701, "x" * 200_000)]
    labels = [(i, int((i % 5 == 0) == (label == "toxic"))) for i in range(600)] + [(None, 1), (3, None), (0, None)]
    df = frame(spark, rows, "doc_id long, text string, score string, lang string")
    got = operator(df, frame(spark, labels, f"doc_id long, {label} int, text string")).collect()
    assert len(got) == 603 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    want = dict(labels[:600])
    right = [r["predicted"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and r["held_out"]]
    assert np.mean(right) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % fold[0] == fold[1]) for r in got if r["doc_id"] is not None)
    none = operator(df, frame(spark, [], f"doc_id long, {label} int")).collect()
    assert len(none) == 603 and operator(df.limit(0), frame(spark, labels, f"doc_id long, {label} int")).count() == 0


def test_samples_of_repeated_ids_are_bounded(spark, monkeypatch):
    hot = spark.range(50_000).selectExpr("5L as doc_id", "concat('text ', id) as text").union(
        spark.range(3000).selectExpr("id as doc_id", "concat('other ', id) as text"))
    labels = spark.createDataFrame([(5, 1, 1), (5, 0, 0), (6, 1, 0)], "doc_id long, toxic int, quality int")
    sample, _ = toxicity.examples(hot, labels)
    assert sample.count() <= toxicity.MAX_POSITIVE + toxicity.MAX_UNLABELLED
    assert sample.filter("doc_id = 5").count() <= 2
    seen = []
    monkeypatch.setattr(quality, "grow", lambda x, y: seen.append(len(x)))
    quality.fit(hot, labels)
    assert seen == [len([i for i in (5, 6) if zlib.crc32(str(i).encode()) % 4 != 2])]


def test_sf_tables_are_read_whole(spark):
    n = spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    for name in ("op1_fingerprints", "op7_token_counts", "op9_source_mixing"):
        assert queries.QUERIES[name](spark, SF_SMALL).count() == n


def test_a_slice_is_summed_once_for_its_lattices(monkeypatch):
    vocab, summed, plain = pieces.Vocabulary(queries.tokenizer("piece_bpe_32k.model")), [], pieces._sums
    monkeypatch.setattr(pieces, "_sums", lambda flat: summed.append(len(flat)) or plain(flat))
    texts = ["one two two three", "two ก\U0001f9ff two", None, "once ☃กก"]
    found = pieces.sample_texts(vocab, texts, np.arange(4, dtype=np.uint64), 2)
    assert vocab.held is not None and len(summed) == 1  # a lattice to hold, and one of this slice alone
    # characters without a piece are spelled in bytes
    assert all(vocab.decode(ids.tolist()) == (t or "") for t, own in zip(texts, found, strict=True) for ids, *_ in own)


def test_units_of_earlier_slices_are_not_built_again(monkeypatch):
    vocab, built, plain = pieces.Vocabulary(queries.tokenizer("piece_bpe_32k.model")), [], pieces.Lattice.__init__
    monkeypatch.setattr(pieces.Lattice, "__init__", lambda self, v, flat, starts, ends, *more: built.append(len(starts)) or plain(
        self, v, flat, starts, ends, *more))
    texts, keys = ["each unit here comes once in its slice"], np.arange(1, dtype=np.uint64)
    found = [pieces.sample_texts(vocab, texts, keys, 2)[0] for _ in range(5)]
    assert sum(built) == 16  # eight units: for the first slice alone, and for the lattice that the task holds
    assert [[f[0].tolist() for f in own] for own in found] == [[f[0].tolist() for f in found[0]]] * 5


def test_lattices_built_in_parts_give_the_same_samples(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abé☃\U0001f9ff1") for _ in range(rng.randint(0, 9))) for _ in range(50)) for _ in range(12)]
    keys, path = text.mix(np.arange(len(texts), dtype=np.uint64)), queries.tokenizer("piece_bpe_32k.model")

    def samples():
        vocab = pieces.Vocabulary(path)
        out = [x for at in range(0, len(texts), 4) for x in pieces.sample_texts(vocab, texts[at:at + 4], keys[at:at + 4], 3)]
        assert all(vocab.decode(f[0].tolist()) == t for t, found in zip(texts, out, strict=True) for f in found)
        return [[(f[0].tolist(), round(f[1], 9), round(f[2], 9), round(f[3], 7)) for f in found] for found in out]

    whole = samples()
    monkeypatch.setattr(pieces, "BUILT", 40)
    assert samples() == whole
