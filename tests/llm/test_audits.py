"""op12 and op13 on small fixtures against plain Python, and their parts."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa

from churnscope.llm import divergence, frames, interactions
from tests.llm.helpers import frame

SCHEMA = "doc_id long, text string, lang string, source string"
#: extra columns named as the operators name their own
CLASH = ", part string, mask int, mark long, digest binary, low long, n long, term string, key long, hash long, size int"


def terms_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)


def divergence_brute(rows, threshold, top):
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        docs[lang].update(set(terms_of(text)))
        count[lang, source].update(terms_of(text))
    out = set()
    kept = {lang: [t for t, n in docs[lang].items() if n >= threshold] for lang, _ in groups}
    shares = lambda c, terms: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in terms) + 5 * len(terms)) for t in terms}
    p = {g: shares(count[g], kept[g[0]]) for g in groups}
    for lang, source in groups:
        all_of = sum((count[g] for g in groups if g[0] == lang), Counter())
        q, own = shares(all_of, kept[lang]), p[lang, source]
        parts = {"pair": [(sum(abs(own[t] - p[g][t]) for t in own), g[1]) for g in groups if g[0] == lang and g[1] != source],
                 "term": [(own[t] - q[t], t) for t in own if count[lang, source][t] and own[t] > q[t]]}
        for part, found in parts.items():
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, source, part, item, value, i) for i, (value, item) in enumerate(found, 1) if part == "pair" or i <= top}
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "AB", "abc", "abcd", "abcde", "abcdefgh", "abcdefghi", "abcdefgh" * 5, "é", "éa", "ÉA", "日本語", "x" * 300, "Zz"]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", "1", "_b", "'"]) for _ in range(rng.randrange(30))),
             rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "S1", None, "é"])) for i in range(n)]
    return rows + [(5, None, "en", "s1"), (None, "abc \x00abc", "en", "s2"), (None, "lone", "xx", "only"), (7, "", "yy", "e1"), (7, "", "yy", "e2")]


def test_divergence_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TERMS", 3)  # several blocks and tiles
    for seed, threshold, top in ((1, 3, 50), (2, 12, 2), (3, 1, 5)):
        rows = corpus(seed)
        got = divergence.audit(frame(spark, rows, SCHEMA + CLASH), threshold, top).collect()
        assert len(got) == len(set(got))
        assert {tuple(r) for r in got} == divergence_brute(rows, threshold, top)


def test_divergence_of_many_sources_uses_several_tiles(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["red", "green", "blue", "grey"]) for _ in range(6)), "en", f"s{i % 150:03d}") for i in range(300)]
    got = divergence.audit(frame(spark, rows, SCHEMA), 3, 2).collect()
    assert {tuple(r) for r in got} == divergence_brute(rows, 3, 2)


def test_divergence_of_an_empty_table(spark):
    assert divergence.audit(frame(spark, [], SCHEMA)).collect() == []


def test_divergence_reads_the_texts_twice_however_long_terms_are(spark, monkeypatch):
    passes, rows = [], corpus(5)
    docs = frame(spark, rows, SCHEMA)
    plain = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda *a, **k: passes.append(1) or plain(*a, **k))
    got = divergence.audit(docs, 2, 50).collect()
    assert {tuple(r) for r in got} == divergence_brute(rows, 2, 50)
    assert len(passes) == 2


def test_divergence_counts_survive_any_cut_into_slices_and_batches(monkeypatch):
    for name, size in (("SLICE", 40), ("PART", 90), ("HELD", 7), ("SENT", 3)):
        monkeypatch.setattr(divergence, name, size)
    rows = [(text or "", lang or "", source or "") for _, text, lang, source in corpus(6)]
    names = sorted({r[1] for r in rows})
    batches = [pa.RecordBatch.from_pydict({
        "hash": pa.array([names.index(r[1]) * 10**9 - 5 for r in part], pa.int64()), "text": [r[0] for r in part],
        "lang": [r[1] for r in part], "source": [r[2] for r in part]}) for part in (rows[:20], rows[20:21], rows[21:])]
    docs, n, in_lang = Counter(), Counter(), Counter()
    for text, lang, source in rows:
        n.update((lang, source, t) for t in terms_of(text))
        docs.update({(lang, source, t) for t in terms_of(text)})
        in_lang.update({(lang, t) for t in terms_of(text)})
    keys = Counter()
    for b in divergence._found(iter(batches)):
        keys.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
    assert sorted(keys.values()) == sorted(in_lang.values())
    every = divergence.BitTable(np.full(1 << 10, -1, dtype=np.int64).view(np.uint64))
    got_docs, got_n = Counter(), Counter()
    for b in divergence._counts(lambda: every)(iter(batches)):
        for r in b.to_pylist():
            assert len(r["own"]) <= 3
            for x in r["own"]:
                got_docs[r["lang"], x["source"], r["term"]] += x["docs"]
                got_n[r["lang"], x["source"], r["term"]] += x["n"]
    assert (got_docs, got_n) == (docs, n)


def prefixes_brute(rows, threshold):
    """Per level, the (lang, bytes, complete) that enough documents hold, among those whose prefix half as long was kept; and those discarded."""
    length, before, out = divergence.FIRST, None, []
    while before is None or before:
        docs = Counter()
        for _, text, lang, _ in rows:
            terms = {t.encode() for t in terms_of(text)}
            terms = {t for t in terms if before is None or len(t) >= length // 2 and (lang or "", t[:length // 2]) in before}
            docs.update({(lang or "", t[:length], len(t) < length) for t in terms})
        kept = {x for x, n in docs.items() if n >= threshold}
        out.append((kept, len(docs)))
        before, length = {(lang, t) for lang, t, whole in kept if not whole}, 2 * length
    return out


def test_divergence_refines_prefixes_level_by_level(spark, monkeypatch):
    rows = corpus(7) + [(i, f"shared{'q' * 40}{i} rareword{i} abcdefgh{'z' * i}", "en", "s1") for i in range(20)]
    hashes = {r[0]: r[1] for r in spark.sql("select l, xxhash64(l) from values ('en'), ('de'), (''), ('xx'), ('yy') t(l)").collect()}

    def key(lang, term):
        flat, one = np.frombuffer(term, dtype=np.uint8), np.array([0])
        return int(divergence.term_keys(flat, one, one + len(flat), np.array([hashes[lang]]).view(np.uint64))[0])

    for threshold, few in ((2, 10**6), (10, 1)):  # kept prefixes are broadcast, then shuffled
        monkeypatch.setattr(frames, "BROADCAST_IDS", few)
        sums = divergence.prefix_sums(frame(spark, rows, SCHEMA).repartition(3)).cache()
        want, before = prefixes_brute(rows, threshold), None
        got = list(divergence.kept_prefixes(sums, threshold))
        assert len(got) == len(want) > 2
        for level, (found, (keep, seen)) in enumerate(zip(got, want, strict=True)):
            assert {tuple(r) for r in found.select("key", "whole").collect()} == {(key(lang, t), whole) for lang, t, whole in keep}
            # what begins with a discarded prefix goes no further
            assert divergence.extended(sums, level, before).select("whole", "key").distinct().count() == seen
            before = found.filter("not whole").selectExpr("key as parent")
        table = divergence.kept_terms(frame(spark, rows, SCHEMA), threshold)
        assert table.has(np.array([key(lang, t) for keep, _ in want for lang, t, whole in keep if whole], dtype=np.int64)).all()
        sums.unpersist()


def test_divergence_prefixes_that_share_a_key_lose_no_documents(monkeypatch):
    for name, size in (("KEY", 6), ("SLICE", 60), ("HELD", 9), ("SENT", 4)):
        monkeypatch.setattr(divergence, name, size)
    rows = [(text or "", 5 if lang else 0) for _, text, lang, _ in corpus(8)]
    batch = pa.RecordBatch.from_pydict({"hash": pa.array([r[1] for r in rows], pa.int64()), "text": [r[0] for r in rows]})
    sums = Counter()
    for b in divergence._prefixes(iter([batch])):
        for r in b.to_pylist():
            assert len(r["key"]) == len(r["n"]) == len(r["parent"]) <= 4
            for k, n, parent in zip(r["key"], r["n"], r["parent"], strict=True):
                sums[r["level"], r["whole"], k, parent] += n

    def key(term, lang):
        flat, one = np.frombuffer(term, dtype=np.uint8), np.array([0])
        return int(divergence.term_keys(flat, one, one + len(flat), np.array([lang], dtype=np.uint64))[0])

    want = Counter()
    for text, lang in rows:
        found = set()
        for t in (t.encode() for t in terms_of(text)):
            level, parent = 0, 0
            while True:
                length = divergence.FIRST << level
                found.add((level, len(t) < length, key(t[:length], lang), parent, t[:length], lang))
                if len(t) < length:
                    break
                level, parent = level + 1, key(t[:length], lang)
        want.update({x[:4] for x in found})
    assert want.keys() == sums.keys() and all(sums[x] >= n for x, n in want.items())
    assert len({x[:3] for x in want}) < len(want)  # keys of several parents occur


def test_bit_table_loses_no_key(spark):
    keys = np.random.default_rng(1).integers(0, 2**divergence.KEY, 5000, dtype=np.int64)
    table = divergence.bit_table(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert table.has(keys).all()
    other = np.random.default_rng(2).integers(0, 2**divergence.KEY, 20000, dtype=np.int64)
    assert table.has(other).mean() < 0.2


def test_share_is_exact_beyond_long(spark):
    n, size, v = 10**13, 10**15, 10**7
    row = spark.sql(f"select {n}L as n, {size}L as size, {v}L as v").select(divergence.share(*map(__import__("pyspark").sql.functions.col, ("n", "size", "v")))).first()
    assert row[0] == 1 + 10**9 * (n + 5) // (size + 5 * v)


def failures_brute(text, low, doc_id):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return "".join(x for x, bad in zip("ABCDE", (
        len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        re.search("[#$%&*|]", text), doc_id is not None and low is not None and doc_id > low), strict=True) if bad)


def audit_brute(rows, labels):
    texts = [(i, t or "", lang or "") for i, t, lang, _ in rows]
    low = {}
    for i, t, _ in texts:
        if i is not None:
            low[t] = min(low.get(t, i), i)
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    failed = [(part, failures_brute(t, low.get(t), i), i in good, i in toxic) for i, t, part in texts]
    out = {}
    for part in {p for p, *_ in failed}:
        own = [f for f in failed if f[0] == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                shapley[x] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(x in f[1] and bool(set(order[:step - 1]) & set(f[1])) for f in own),
                    sum(f[1] == x for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def test_interactions_match_brute_force(spark):
    rng = random.Random(8)
    kinds = ["", "one two", " ".join(f"w{i}" for i in range(120)), " ".join(f"w{i % 50}" for i in range(120)), "SHOUT " * 101, "a$b " * 3,
             " ".join(f"W{i}é#" for i in range(99)), "ÄÖ\x0bÜ a\x85b"]
    rows = [(rng.randrange(40), rng.choice([*kinds, None]) , rng.choice(["en", "de", None, ""]), "s") for _ in range(80)]
    rows += [(None, "one two", "en", "s"), (None, "alone", "en", "s"), (None, "alone", "en", "s"), (3, "only one", "xx", None)]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 40, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (999, 1, 1), (6, None, 1)]
    got = interactions.audit(frame(spark, rows, SCHEMA + CLASH), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len({(r["part"], r["filter_order"], r["step"]) for r in got})
    assert {tuple(r) for r in got} == audit_brute(rows, labels)


def test_interactions_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.audit(frame(spark, [], SCHEMA), none).collect() == []
    assert {r["toxic_lost"] for r in interactions.audit(frame(spark, [(1, "a", "en", "s")], SCHEMA), none).collect()} == {0}


def test_sketch_clears_no_repeat_and_most_unique_texts(spark):
    texts = spark.range(30_000).selectExpr("concat('text ', if(id % 100 = 0, 'same', string(id)), if(id % 70 = 1, 'x', '')) as text").repartition(7)
    marks = texts.withColumn("mark", interactions._mark(texts["text"], 4))
    found = interactions.possible_repeats(marks)
    again = marks.groupBy("text", "mark").count().filter("count > 1").select("mark")
    assert again.join(found, "mark", "left_anti").count() == 0
    assert found.count() == found.distinct().count() < 30_000 * 0.05
