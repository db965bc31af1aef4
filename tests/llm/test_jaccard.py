import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from churnscope.llm import jaccard
from tests.llm.helpers import SF_CHECK, frame, shingles


def brute_force(rows):
    """component per doc_id by comparing all pairs that share a shingle."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    seen = set()
    for ks in where.values():
        for a in ks:
            for b in ks:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    s, t = sets[a][1], sets[b][1]
                    if 100 * len(s & t) >= 75 * len(s | t):
                        x, y = find(sets[a][0]), find(sets[b][0])
                        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def check(spark, rows):
    got = jaccard.jaccard_components(frame(spark, rows, "doc_id long, text string, extra int, n long")).collect()
    assert len(got) == len(rows)
    want = brute_force(rows)
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"]), r
    sizes = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"]) for r in got)
    assert sizes == sorted((i if i is not None else -1, len(shingles(t))) for i, t in rows)


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


def test_special_cases(spark):
    check(spark, [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  b"), (6, "a b c d e"), (7, "a b c d e f"),
                  (8, "a b"), (None, "a b"), (None, None), (9, "x " * 40), (9, "x " * 41), (10, "é È ü"), (11, "é è ü")])


def test_empty(spark):
    assert jaccard.jaccard_components(frame(spark, [], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_of_one_text(spark, seed, monkeypatch):
    """Copies with a word changed here and there, some similar to the first text only: a large group in blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(seed)
    base, rows = words(rng, 90), []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"w{rng.random()}"
        rows.append((1000 - i, " ".join(w)))
    for i in range(40):  # a shared passage inside different texts
        rows.append((2000 + i, " ".join(words(rng, rng.randint(5, 60)) + base[:60])))
    for i in range(30):  # small sets
        rows.append((3000 + i, " ".join(base[:rng.randint(1, 14)])))
    check(spark, rows)


def test_repeated_and_equal_rows(spark):
    rng = random.Random(3)
    text = " ".join(words(rng, 50))
    check(spark, [(5, text)] * 30 + [(4, text), (6, text + " z"), (6, "other " * 3)] + [(7, "other other other")])


def test_documents(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF_CHECK}/documents.parquet'").fetchall()
    check(spark, rows)


def test_parity_sketch_never_rejects():
    import numpy as np
    rng = np.random.default_rng(0)
    for n in (3, 10, 70, 900):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        for drop in range(0, n // 4 + 1, max(1, n // 20)):
            b = np.sort(np.concatenate([a[drop:], rng.integers(0, 2**63, drop // 3).astype(np.uint64)]))
            common = n - drop
            if jaccard.similar(common, n, len(b)):
                assert jaccard.may_be_similar(jaccard.parity(np.sort(a)), n, jaccard.parity(b), len(b))


def test_sets_and_subsets_without_a_hash_table_or_wide_sort(monkeypatch):
    rng = random.Random(12)
    texts = [None, "", " ", "one", "a b c d e " * 9, " ".join(rng.choice("abc") for _ in range(300)), " ".join(str(i) for i in range(400))]
    sizes = [len(shingles(t)) for t in texts]
    monkeypatch.setattr(np, "unique", None)  # several times slower for sets of this size
    sets = list(jaccard.sets_of(pa.array(texts)))
    assert [len(s) for s in sets] == sizes and all((s[1:] > s[:-1]).all() for s in sets)
    sorted_, plain = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, **how: sorted_.append(a.dtype.itemsize) or plain(a, **how))
    for m in (7, 70_000):
        values, first, size = jaccard._segments(sets[-1], m, 5)
        h = jaccard.T.mix(sets[-1] ^ np.uint64(5))
        seg = ((h >> np.uint64(40)) * np.uint64(m) >> np.uint64(24)).tolist()
        assert size.tolist() == [n for _, n in sorted(Counter(seg).items())]
        assert first.tolist() == [sum(size[:i]) for i in range(len(size))]
        by = sorted(range(len(seg)), key=lambda i: seg[i])
        assert values.tolist() == jaccard.T.mix(h + np.uint64(0x632BE59BD9B4E019))[by].tolist()
    assert sorted_ == [2, 8]
