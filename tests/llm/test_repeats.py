"""op11: the run-length index and the dedup over it against brute force."""

import hashlib
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from churnscope.llm import repeats
from tests.llm.helpers import SF_SMALL, frame

COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def brute(texts, width=400):
    """(n_bytes, n_removed, n_spans, sha256 of the rest) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(hashlib.md5(d[i:i + width]).digest() for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, dtype=bool)
        for i in range(len(d) - width + 1):
            if seen[hashlib.md5(d[i:i + width]).digest()] > 1:
                gone[i:i + width] = True
        rest = bytes(np.frombuffer(d, dtype=np.uint8)[~gone[:-1]])
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-1][:-1]])[:len(d)]).sum()) if d else 0
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return out


def check(spark, texts, extra=""):
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS[1:]) for r in repeats.digests(frame(spark, rows, f"doc_id long, text string{extra}")).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def prose(rng, n, words=900):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def test_index_statistics_match_brute_force():
    rng = np.random.default_rng(3)
    for symbols in (rng.integers(0, 3, 300), np.tile(rng.integers(1, 5, 37), 9), np.full(50, 7), np.array([5]),
                    np.concatenate([np.tile([1, 2, 0], 20), rng.integers(0, 257, 100)])):
        symbols = symbols.astype(np.int16)
        index = repeats.RunIndex(symbols)
        n, s = len(symbols), symbols.tolist()
        want = []
        for p in range(n):
            best = 0
            for q in range(n):
                k = 0
                while p != q and p + k < n and q + k < n and s[p + k] == s[q + k]:
                    k += 1
                best = max(best, k)
            want.append(best)
        assert index.statistics().tolist() == want
        order = sorted(range(n), key=lambda i: s[i:])
        bwt = [s[i - 1] if i else 257 for i in order]
        assert np.repeat(index.heads, index.lengths).tolist() == bwt
        assert len(index.begins) == len(index.heads) - 1


@pytest.mark.parametrize("gram", repeats.LEVELS)
def test_segments_hold_every_window_once_and_depend_on_its_bytes(gram):
    rng = random.Random(gram)
    texts = [prose(rng, 400).encode(), b"", b"ab" * 700, prose(rng, 90).encode(), b"x" * 399, b"y" * 400, prose(rng, 300).encode()]
    texts.append(texts[0][100:1500])
    flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    key, prints, start, many, own, each = repeats.segments(flat, offsets, gram)
    text = np.repeat(np.arange(len(texts)), each)
    windows = [(t, i) for t, s, n in zip(text.tolist(), start.tolist(), many.tolist(), strict=True) for i in range(s, s + n)]
    assert windows == [(t, i) for t, d in enumerate(texts) for i in range(len(d) - 399)]
    of, mark = {}, {}
    for t, s, n, k, p, o in zip(*(x.tolist() for x in (text, start, many, key, prints, own)), strict=True):
        body = texts[t][s:s + (400 if gram == 400 else n + 399)]
        assert mark.setdefault((k, p), body) == body
        inside = [texts[t][i:i + 400] for i in range(s, s + n)]
        assert o or len(set(inside)) == n  # a segment that repeats within itself says so
        for w in inside:
            assert of.setdefault(w, k) == k


def test_digests_match_brute_force(spark):
    rng = random.Random(1)
    passage, long = prose(rng, 120), prose(rng, 700)
    texts = [
        None, "", "short", "short", long, long, long[:1500] + " changed " + long[1500:], passage[:400], "é" + passage[:400] + "ü",
        passage[1:400], "a" * 399, "a" * 400, "b" * 401, "cd" * 900, prose(rng, 500), long[-399:], long[-400:] + "!",
        "ö" * 350 + prose(rng, 50), "ö" * 350, passage * 3, prose(rng, 60) + passage + prose(rng, 60), "\x00" * 450 + prose(rng, 40)]
    check(spark, texts)


def test_many_flanks_of_a_passage_are_cut_by_longer_grams(spark, monkeypatch):
    monkeypatch.setattr(repeats, "MOST", 6000)
    monkeypatch.setattr(repeats, "CHUNK", 3000)
    rng = random.Random(2)
    passage = prose(rng, 110)
    texts = [prose(rng, rng.randrange(0, 90)) + passage + prose(rng, rng.randrange(0, 90)) for _ in range(60)]
    texts += ["z" * 9000, "pq" * 4000, "z" * 405]
    check(spark, texts)


def test_random_edits(spark):
    rng = random.Random(5)
    base = [prose(rng, 260, 60) for _ in range(4)]
    texts = []
    for _ in range(40):
        t = rng.choice(base)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(t))
            t = t[:i] + rng.choice(["", "#", "lorem"]) + t[i + rng.randrange(3):]
        texts.append(t)
    check(spark, texts, ", a string, b string, key int, print int, spans string, body string, n int")


def test_repeated_and_null_ids_and_empty_table(spark):
    rng = random.Random(7)
    t, u = prose(rng, 200), prose(rng, 200)
    rows = [(1, t), (1, t), (1, u), (None, u + "x"), (None, None)]
    got = Counter(tuple(r[c] for c in COLUMNS) for r in repeats.digests(frame(spark, rows, "doc_id long, text string")).collect())
    assert got == Counter((i, *d) for (i, _), d in zip(rows, brute([t for _, t in rows]), strict=True))
    assert repeats.digests(frame(spark, [], "doc_id long, text string")).collect() == []
    assert repeats.repeated_spans(frame(spark, [(1, "a")], "doc_id long, text string")).collect() == []


def test_spans_name_the_removed_bytes(spark):
    rng = random.Random(9)
    passage = prose(rng, 100)
    docs = frame(spark, [(1, "start " + passage + " one"), (2, passage + " two")], "doc_id long, text string")
    spans = repeats.repeated_spans(docs)
    got = {(bytes(r["kept"]), tuple((x["from"], x["to"]) for x in r["spans"])) for r in repeats.cleaned(docs, spans).collect()}
    n = len(passage) + 1
    assert got == {(b"start one", ((6, 6 + n),)), (b"two", ((0, n),))}


def test_small_table_matches_brute_force(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS[1:]) for r in repeats.digests(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).collect()}
    assert [got[r[0]] for r in rows] == brute([r[1] for r in rows])


#: what a fresh worker does that has loaded neither pandas nor pyarrow.compute
FRESH = """
import pyarrow as pa
from churnscope.llm import divergence, repeats
lo, hi = (pa.Array.from_buffers(pa.int32(), 2, [None, pa.py_buffer(bytes(b))]) for b in ([1, 0, 0, 0, 3, 0, 0, 0], [3, 0, 0, 0, 6, 0, 0, 0]))
ends = pa.Array.from_buffers(pa.int32(), 2, [None, pa.py_buffer(bytes([0, 0, 0, 0, 2, 0, 0, 0]))])
ranges = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([lo, hi], ["lo", "hi"]))
print(repeats._union(ranges, ("lo", "hi"), 0).to_pylist(), hasattr(divergence, "pc"))
"""


def test_a_fresh_worker_has_the_compute_functions():
    run = subprocess.run([sys.executable, "-c", FRESH], capture_output=True, text=True, timeout=120, cwd=Path(repeats.__file__).parents[2])
    assert run.stdout == "[[{'lo': 1, 'hi': 6}]] True\n", run.stderr
