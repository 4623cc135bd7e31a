"""Very long texts, repeated rows, null ids, empty tables and clashing names, by operator."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from test_operators import components_by_force, contamination_by_force, language_rows, lines_by_force  # noqa: E402

RNG = random.Random(21)
LONG = " ".join("".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(1, 9))) for _ in range(40_000))
ROWS = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "Hello there, world"), (1, "Hello there, world"), (1, "other text"), (2, LONG), (3, LONG), (4, ""), (5, None)]


def frame(spark, rows=ROWS, **clash):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(v) for c, v in clash.items()})


def test_token_counts(spark):
    import sentencepiece

    from hashloom.llm.tokens import count_tokens

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = count_tokens(frame(spark, n_tokens="x", over_limit=1, word="w"), path).collect()
    key = lambda r: (r[0] or -1, r[1])
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=key) == sorted(((i, len(sp.encode(t or ""))) for i, t in ROWS), key=key)


def test_bpe(spark):
    from tokenizers import Tokenizer

    from hashloom.llm.bpe import encode_decode

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = encode_decode(frame(spark, ids="x", word="w", ids_sha256=2), path).collect()
    key = lambda r: (r[0] or -1, r[1])
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=key) == sorted(((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in ROWS), key=key)


def test_language_of_long_texts(spark):
    from hashloom.llm.langid import fit, identify

    rows = language_rows()
    long = " ".join(t for _, t, lang in rows if lang == "aa") * 60
    df = spark.createDataFrame([*rows, (900, long, "aa")], "doc_id long, text string, lang string")
    crf = fit(df, stretch=500)  # none of the sample is longer
    again = fit(df, stretch=500)
    assert np.array_equal(crf.steps, again.steps)
    odd = spark.createDataFrame([(1, long), (1, long), (None, rows[1][1]), (2, None)], "doc_id long, text string")
    got = identify(odd.withColumns({"lang_pred": F.lit(1), "score": F.lit("s"), "lang": F.lit("q"), "n_switches": F.lit(None)}), crf).collect()
    assert sorted((r.doc_id or -1, r.lang_pred, r.lang) for r in got) == [(-1, "bb", "q"), (1, "aa", "q"), (1, "aa", "q"), (2, "und", "q")]


def test_jaccard_of_long_texts(spark):
    from hashloom.llm.jaccard import jaccard_components

    texts = {2: LONG, 3: LONG + " tail", 4: LONG.replace("a", "z", 50), 5: "", 6: None, 7: "Hello there"}
    df = frame(spark, list(texts.items()), n_shingles="x", component_id=1, h=1, band="b", size=3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, words=4, share=(85, 100)).collect()}
    assert got == components_by_force(texts, 4, (85, 100))


def test_fingerprints_of_long_texts(spark):
    from hashloom.llm.fingerprint import compare_with_next, sketch, to_string

    rows = [(1, "x"), (2, LONG * 4), (3, LONG * 4), (None, LONG), (4, "")]
    df = frame(spark, rows, fingerprint=1, near_next="n", next_text="t", n_chars="c")
    got = {r.doc_id: r for r in compare_with_next(df).collect()}
    assert all(got[i].n_chars == len(t) and got[i].fingerprint == to_string(sketch(t)) for i, t in rows)
    assert got[3].near_next == 1.0


def test_decontamination(spark):
    from hashloom.llm.decontam import contamination

    words = LONG.split()
    items = [(0, "hello"), (1, " ".join(words[30_000:30_020])), (2, "e f"), (None, "other text")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(frame(spark, n_hit="x", items=1, contaminated="c"), bench).collect()
    want = [(i or -1, *contamination_by_force(t, [x for x in items if x[0] is not None])) for i, t in ROWS]
    nulls = [(i or -1, *contamination_by_force(t, items)) for i, t in ROWS]  # windows of null items hit, too
    assert sorted((r.doc_id or -1, r.n_words, r.n_hit, r["items"]) for r in got) == sorted((w[0], w[1], n[2], w[3]) for w, n in zip(want, nulls, strict=True))


def test_licenses(spark):
    from hashloom.llm.licenses import scan_licenses

    mit = "Released under the MIT License."
    rows = [(None, mit), (1, mit), (1, mit), (2, f"{LONG} {mit} {LONG}"), (3, None), (4, ""), (5, "license")]
    df = frame(spark, rows, license="x", containment="y", window=1, band=2, words="w", held="h")
    got = scan_licenses(df).collect()
    assert sorted((r.doc_id or -1, r.license, r.containment) for r in got) == [(-1, "MIT", 1.0), (1, "MIT", 1.0), (2, "MIT", 1.0)]
    assert scan_licenses(df.limit(0)).count() == 0


def test_lines(spark):
    from hashloom.llm.linededup import dedup_lines

    many = "\n".join(f"line {k % 30_000}" for k in range(60_000))
    texts = [(1, "a\nb\nc"), (2, many), (3, "a\nb\nc\nd"), (4, None)]
    got = {r.doc_id: (r.text, r.n_removed) for r in dedup_lines(frame(spark, texts, n_lines="x", n_removed="y", pos=1, h1=2)).collect()}
    assert got == lines_by_force(texts)


def test_pii(spark):
    from hashloom.llm.pii import pseudonymize

    long = f"{LONG} mail ann@example.org or {LONG}"
    rows = [(None, "ann@example.org"), (1, "ann@example.org"), (1, "ann@example.org"), (2, long), (3, None), (4, "")]
    got = pseudonymize(frame(spark, rows, n_entities="x", kinds="y", raw="r", new="n", map="m"), key="k").collect()
    assert sorted((r.doc_id or -1, r.n_entities) for r in got) == [(-1, 1), (1, 1), (1, 1), (2, 1), (3, 0), (4, 0)]
    new = {r.text for r in got if r.doc_id == 1}
    assert len(new) == 1 and "ann@example.org" not in new
    assert [r.text for r in got if r.doc_id == 2] == [long.replace("ann@example.org", new.pop())] and {r.raw for r in got} == {"r"}
