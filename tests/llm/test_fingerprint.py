"""Fingerprints against the shingle sets themselves."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from hashloom.llm.fingerprint import FRACTION, TOP, containment, from_bytes, from_string, likeness, merge, sketch, to_bytes, to_string  # noqa: E402

SF = "/root/testdata/sf0.01"


def shingles(t):
    return {t[i : i + 8] for i in range(len(t) - 7)} if len(t) >= 8 else {t} - {""}


def true_likeness(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def text(rng, n, letters="abcdefghijklmnopq "):
    return "".join(rng.choice(letters) for _ in range(n))


def test_texts_with_nothing_in_common_are_unlike():
    texts = [c * 9000 for c in "abxy-=01"] + ["ab" * 9000, "cd" * 9000, "a", "b", "abcdefg", "abcdefgh", "ijklmnop"]
    got = [sketch(t) for t in texts]
    assert all(len(s) for s in got)
    for i, s in enumerate(got):
        assert likeness(s, s) == containment(s, s) == 1.0
        assert all(likeness(s, t) == containment(s, t) == 0 for t in got[:i])
        assert likeness(s, sketch("")) == containment(sketch(""), s) == 0
        assert np.array_equal(from_string(to_string(s)), s)
    assert likeness(sketch(""), sketch("")) == 1


def test_one_fraction_for_every_length():
    rng = random.Random(12)
    for n in (100, 263, 264, 265, 1000, 20_000, 300_000):
        t = text(rng, n)
        kept, have = sketch(t), len(shingles(t))
        assert (kept < TOP).all() or len(kept) == 1
        kept = kept[kept < TOP]
        assert abs(len(kept) - have / FRACTION) < 5 * (have / FRACTION) ** 0.5 + 1


def test_error_of_likeness_and_containment():
    rng = random.Random(13)
    off, parts = [], []
    for k in range(300):
        n = rng.choice([4000, 6400, 16_000, 48_000])  # shingles kept: 60 and more
        a = text(rng, n)
        cut = rng.randrange(n)
        b = a[:cut] + text(rng, n - cut)
        s, both = true_likeness(a, b), len(shingles(a) | shingles(b))
        off.append((likeness(sketch(a), sketch(b)) - s) / max((s * (1 - s) * FRACTION / both) ** 0.5, 1e-3))
        long = text(rng, 150_000) + a if k % 10 == 0 else a + text(rng, 5000)  # very unequal lengths
        parts.append(containment(sketch(a), sketch(long)))
        assert np.array_equal(merge(sketch(a), sketch(b)), np.union1d(sketch(a), sketch(b)))
    assert abs(np.mean(off)) < 0.25 and np.mean(np.abs(off)) < 1.0 and max(map(abs, off)) < 4.5
    assert min(parts) == 1.0


def test_scores_of_the_query_against_brute_force(spark):
    from hashloom.llm.fingerprint import compare_with_next

    rng = random.Random(14)
    base = text(rng, 900)
    texts = [None, "", "ab", "x" * 500, base, base, base[:600] + text(rng, 300), "é日" * 300, *(text(rng, n) for n in (7, 8, 9, 50, 256, 300, 4000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in compare_with_next(df).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t, after = t or "", texts[i - 1] or ""
        k = len(t) // 3
        new = t[: len(t) - k] + after[:k]
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        for got, s in ((rows[i].near_edited, true_likeness(t, new)), (rows[i].near_next, true_likeness(t, after))):
            n = len(shingles(t) | shingles(after))
            assert got == s if s in (0, 1) else abs(got - s) < 5 * (s * (1 - s) * FRACTION / max(n, 1)) ** 0.5


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_size_and_error_over_a_table(spark):
    from hashloom.llm.fingerprint import compare_with_next

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = [r.text or "" for r in docs.orderBy(F.desc("doc_id")).collect()]
    rows = compare_with_next(docs).orderBy(F.desc("doc_id")).collect()
    off = []
    for i, (t, r) in enumerate(zip(texts, rows, strict=True)):
        k = len(t) // 3
        new = t[: len(t) - k] + texts[(i + 1) % len(texts)][:k]
        off.append(abs(r.near_edited - true_likeness(t, new)))
    size = sum(len(t.encode()) for t in texts)
    assert sum(len(r.fingerprint) for r in rows) < 0.11 * size
    assert sum(len(to_bytes(from_string(r.fingerprint))) for r in rows) < 0.08 * size
    assert np.mean(off) < 0.13 and np.median(off) < 0.11


def test_bytes_round_trip_with_marks():
    rng = random.Random(15)
    for n in range(0, 400, 3):
        s = sketch(text(rng, n))
        assert np.array_equal(from_bytes(to_bytes(s)), s) and np.array_equal(from_string(to_string(s)), s)
