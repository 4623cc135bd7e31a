"""The ten operators against plain versions on small fixtures, and their odd cases."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

ODD = [None, "", " ", "\n", "a", "Hello  world\n\n\tx", "日本語 🎉 é", "a" * 9000, "<|endoftext|> x <s>", "▁▁ ▁a"]


def docs_of(spark, texts, first=0):
    """Documents with extra columns whose names clash with those of the operators."""
    rows = [(i + first, t, "en" if i % 2 else None, i, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int, n_words string")


def empty(spark):
    return docs_of(spark, ["x"]).limit(0)


# -- 2 and 3 ----------------------------------------------------------------------------


def test_token_counts(spark):
    import sentencepiece

    from hashloom.llm.tokens import count_tokens

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*ODD, " " * 5000 + "b", "don't stop  believing " * 40]
    got = {r.doc_id: r for r in count_tokens(docs_of(spark, texts), path, limit=50).collect()}
    for i, t in enumerate(texts):
        n = len(sp.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 50)
    assert count_tokens(empty(spark), path).count() == 0


def test_bpe_round_trip(spark):
    from tokenizers import Tokenizer

    from hashloom.llm.bpe import decode_ids, encode_decode

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    df = encode_decode(docs_of(spark, ODD), path, with_ids=True)
    for r in decode_ids(df, path).collect():
        ids = t.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.text == t.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert encode_decode(empty(spark), path).count() == 0


def merges(rng, letters):
    """A valid vocabulary: each merge joins known tokens, and several may give one product."""
    tokens, rows = list("abcd"[:letters]), {}
    for _ in range(rng.randrange(3, 16)):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if len(a + b) <= 14 and (a, b) not in rows:
            rows[a, b] = len(rows)
            tokens += [a + b] * (a + b not in tokens)
    return tokens, rows


def test_merging_equals_the_heap_and_the_library():
    from tokenizers import Tokenizer, models

    from hashloom.llm.merging import Pairs, merge_one, merge_words

    rng = random.Random(3)
    for k in range(400):
        tokens, rows = merges(rng, 1 + k % 4)
        if k == 0:  # places of a run that were passed over begin a product later
            rows = {p: r for r, p in enumerate([("a", "a"), ("a", "aa"), ("aaa", "a"), ("aaaa", "aa"), ("aaaaaa", "aaa"), ("aaaa", "a"), ("a", "aaaaaaaaa"), ("aa", "aa"), ("a", "aaa")])}
            tokens = list(dict.fromkeys(["a", *(a + b for a, b in rows)]))
        ids = {t: i for i, t in enumerate(tokens)}
        table = {(ids[a], ids[b]): (r, ids[a + b]) for (a, b), r in rows.items()}
        pairs = Pairs(*zip(*[(a, b, r, n) for (a, b), (r, n) in table.items()], strict=True))
        words = [[rng.randrange(1 + k % 4) for _ in range(rng.randrange(0, 61))] for _ in range(60)] + [[0] * 31]
        flat, n = merge_words(np.array([x for w in words for x in w], np.int32), np.array(list(map(len, words))), pairs)
        want = [merge_one(w, table) for w in words]
        assert n.tolist() == list(map(len, want)) and flat.tolist() == [x for w in want for x in w]
        if k % 8 == 0:
            library = Tokenizer(models.BPE(vocab=ids, merges=list(rows)))
            assert [library.encode("".join("abcd"[x] for x in w)).ids for w in words if w] == [w for w in want if w]


def test_merging_of_products_of_any_rank():
    from hashloom.llm.merging import Pairs, merge_one, merge_words

    rng = random.Random(3)
    for _ in range(60):
        rows = {}
        for new in range(4, 14):
            rows[rng.randrange(new), rng.randrange(new)] = (rng.randrange(8), new)
        pairs = Pairs(*zip(*[(a, b, r, n) for (a, b), (r, n) in rows.items()], strict=True))
        words = [[rng.randrange(4) for _ in range(rng.randrange(0, 14))] for _ in range(40)]
        flat, n = merge_words(np.array([x for w in words for x in w], np.int32), np.array(list(map(len, words))), pairs)
        want = [merge_one(w, rows) for w in words]
        assert n.tolist() == list(map(len, want)) and flat.tolist() == [x for w in want for x in w]


# -- 4 ------------------------------------------------------------------------------------


def language_rows(n=60):
    rng = random.Random(4)
    parts = {"aa": ["ka", "ti", "mo", "ru"], "bb": ["schl", "ung", "eit", "ach"]}
    return [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60))), lang) for i, lang in enumerate(["aa", "bb"] * (n // 2))]


def test_language_id(spark):
    from hashloom.llm.langid import fit, held_out, identify, label_words

    rows = language_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    crf = fit(df.filter(~held_out()))
    got = {r.doc_id: r for r in identify(df.select("doc_id", "text"), crf).collect()}
    assert all(got[i].lang_pred == lang and 0.5 < got[i].score <= 1 for i, _, lang in rows)
    switched = label_words(f"{rows[0][1]} {rows[1][1]}", crf)
    half = len(rows[0][1].split())
    assert {w[1] for w in switched[: half - 1]} == {"aa"} and {w[1] for w in switched[half + 1 :]} == {"bb"}
    odd = {r.doc_id: r for r in identify(docs_of(spark, [None, "", "123 !?", "²", rows[0][1]]), crf).collect()}
    assert [odd[i].lang_pred for i in range(5)] == ["und"] * 4 + ["aa"] and odd[0].score == 0
    assert fit(df.limit(0)) is None
    assert {r.lang_pred for r in identify(df.select("doc_id", "text"), None).collect()} == {"und"}


def test_marginals_are_those_of_the_plain_recursion():
    from hashloom.llm.langid import Crf

    rng = np.random.default_rng(1)
    crf = Crf(["a", "b", "c"])
    crf.steps = rng.normal(size=(3, 3)).astype(np.float32)
    lengths = np.array([1, 31, 32, 33, 200, 64, 5])
    scores = rng.normal(size=(lengths.sum(), 3)).astype(np.float32)
    got, at = crf.marginals(scores, lengths), 0
    trans = np.exp(crf.steps - crf.steps.max()).astype(float)
    for n in lengths:
        e = np.exp(scores[at : at + n]).astype(float)
        a, b, f = [], np.ones(3), np.ones(3) / 3
        for k in range(n):
            f = (f @ trans) * e[k]
            f /= f.sum()
            a.append(f)
        for k in range(n - 1, -1, -1):
            g = a[k] * b
            assert np.allclose(g / g.sum(), got[at + k], atol=1e-6)
            b = trans @ (e[k] * b)
            b /= b.sum()
        at += n


# -- 5 ------------------------------------------------------------------------------------


def components_by_force(texts, words, share):
    sets = {}
    for i, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = frozenset() if not w else frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1)))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and share[1] * both >= share[0] * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_jaccard_join(spark):
    from hashloom.llm.jaccard import jaccard_components

    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base, common = text(120), text(30)
    texts = [None, "", " \n", "one two", "One TWO", "x", " ".join(base), " ".join(base)]
    for k in range(70):  # near copies, some of them linked by way of others only
        copy = list(base)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(len(copy))] = f"n{k}"
        texts.append(" ".join(copy))
    for _ in range(70):  # a common passage in texts of their own
        texts.append(" ".join(text(rng.randrange(5, 20)) + common + text(rng.randrange(5, 60))))
    df = docs_of(spark, texts)
    want = components_by_force(dict(enumerate(texts)), 4, (85, 100))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, words=4, share=(85, 100)).collect()}
    assert got == want
    assert jaccard_components(empty(spark)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in jaccard_components(odd).collect()) == [("1", "1"), ("1", "1"), ("2", "1"), ("None", "None")]


def test_bitmaps_bound_the_overlap():
    from hashloom.llm.jaccard import fold, signature, width_of

    rng = np.random.default_rng(2)
    for _ in range(50):
        x, y = (np.unique(rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64)) for _ in range(2))
        y = np.unique(np.r_[y, x[: rng.integers(0, len(x) + 1)]])
        width = min(width_of(len(x)), width_of(len(y)))
        differ = int(np.bitwise_count(fold(signature(x, width_of(len(x))), width) ^ fold(signature(y, width_of(len(y))), width)).sum())
        assert (len(x) + len(y) - differ) // 2 >= len(np.intersect1d(x, y))


def test_components_of_a_long_chain(spark):
    from hashloom.llm.components import components

    links = spark.createDataFrame([(i, i + 1) for i in range(10, 60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert set(got.values()) == {10, 100} and got[60] == 10


# -- 6 ------------------------------------------------------------------------------------


def test_fingerprints(spark):
    from hashloom.llm.fingerprint import FRACTION, compare_with_next, containment, from_string, likeness, merge, sketch, to_string

    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    long = " ".join(words)
    texts = [*ODD, long, long, " ".join(words[:900]), "tail"]
    got = {r.doc_id: r for r in compare_with_next(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t, after = t or "", texts[i - 1] or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + after[:k]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == to_string(sketch(t)) and got[i].edited_fingerprint == to_string(sketch(edited))
        assert got[i].near_next == pytest.approx(likeness(sketch(t), sketch(after)))
    assert got[10].fingerprint == got[11].fingerprint and got[11].near_next == 1.0
    whole, part = sketch(long), sketch(" ".join(words[:900]))
    # 18,000 and 5,400 shingles, of which 1 in FRACTION is kept
    assert containment(part, whole) > 0.97 and abs(containment(whole, part) - 0.3) < 4 * (0.3 * 0.7 * FRACTION / 18_000) ** 0.5
    one, two = (sketch(" ".join(words[a:b])) for a, b in ((0, 1500), (1500, 3000)))
    assert likeness(merge(one, two), whole) > 0.97
    assert np.array_equal(from_string(to_string(whole)), whole)
    assert compare_with_next(empty(spark)).count() == 0
    odd = spark.createDataFrame([(None, "n"), (5, "a"), (5, "a"), (5, "b"), (7, None)], "doc_id long, text string")
    assert compare_with_next(odd).count() == 5


# -- 7 ------------------------------------------------------------------------------------


def contamination_by_force(text, items, words=13):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, who = cut(text), set(), set()
    for item, t in items:
        b = cut(t)
        n = min(words, len(b))
        windows = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if b else set()
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                who.add(str(item))
    return len(w), len(hit), sorted(who)


@pytest.mark.parametrize("block_bytes", [8 << 20, 600])
def test_decontamination(spark, block_bytes):
    from hashloom.llm.decontam import contamination

    rng = random.Random(10)
    text = lambda n: " ".join(rng.choice(["the", "of", "and", "éa", "x1", "word", "longerword"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 5, 13, 20, 40]) if i % 3 == 0 else rng.randrange(13, 50))) for i in range(12)] + [(90, None), (91, ""), (92, "...")]
    items = [(i, t) for i, t in items if t is None or len(t.split()) != 1]
    texts = [*ODD]
    for _ in range(30):
        a = items[rng.randrange(9)][1].upper().replace(" ", rng.choice([" ", ", ", "\n"]))
        texts.append(f"{text(rng.randrange(60))} {a} {text(rng.randrange(60))}")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in contamination(docs_of(spark, texts), bench, block_bytes=block_bytes).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n, hit, who = contamination_by_force(t, items)
        assert (got[i]["n_words"] if not isinstance(got[i]["n_words"], str) else None, got[i].n_hit, got[i]["items"]) == (n, hit, who)
        assert got[i].contaminated == (hit > 0 and 20 * hit >= n)
    assert contamination(empty(spark), bench).count() == 0
    assert {r.n_hit for r in contamination(docs_of(spark, texts), bench.limit(0)).collect()} == {0}


# -- 9 ------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    from hashloom.llm.warc import page_of, read_warc, with_revisits, write_warc

    pages = [(1, "http://a", "<p>é\r\n\r\nWARC/1.1</p>"), (2, "http://b\r\nX: y", "same" * 50), (0, None, "same" * 50), (4, "u", None), (5, "u", ""), (6, "v", "tiny"), (7, "v", "tiny")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    write_warc(with_revisits(df, min_bytes=0), f"file://{tmp_path}/w")
    records = read_warc(spark, f"file://{tmp_path}/w").cache()
    got = {int(r.id): r for r in records.withColumn("id", page_of(F.col("record_id"))).collect()}
    first = {}
    for i, _, h in sorted(pages, key=lambda p: p[0]):
        body = (h or "").encode()
        first.setdefault(body, i)
        assert got[i].payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert got[i].http_length == len(body)
        if first[body] == i:
            assert got[i].record_type == "response" and bytes(got[i].payload) == body and got[i].refers_to is None
        else:
            assert got[i].record_type == "revisit" and got[i].payload is None and got[i].refers_to == f"<urn:page:{first[body]}>"
    assert got[0].target_uri is None and got[2].target_uri == "http://b X: y"
    only = read_warc(spark, f"file://{tmp_path}/w", payload="false").filter("record_type = 'revisit' and target_uri is not null")
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and not re.search(r"(?<![A-Za-z])Filter[ (]", plan), plan
    assert only.count() == 3
    write_warc(with_revisits(df, min_bytes=5), f"file://{tmp_path}/x", compression="none")
    assert read_warc(spark, f"file://{tmp_path}/x").filter("record_type = 'revisit'").count() == 1
    write_warc(with_revisits(df.limit(0)), f"file://{tmp_path}/e")
    assert read_warc(spark, f"file://{tmp_path}/e").count() == 0


# -- 10 -----------------------------------------------------------------------------------


def lines_by_force(texts):
    seen, out = set(), {}
    for i, t in texts:
        if t is None:
            out[i] = (None, 0)
            continue
        ls = t.split("\n")
        gone = set()
        for k in range(max(1, len(ls) - 2)):
            w = "\n".join(ls[k : k + 3])
            if w in seen:
                gone |= {k, k + 1, k + 2} & set(range(len(ls)))
            seen.add(w)
        out[i] = ("\n".join(x for k, x in enumerate(ls) if k not in gone) if gone else t, len(gone))
    return out


def test_line_dedup(spark):
    from hashloom.llm.linededup import dedup_lines

    rng = random.Random(11)
    texts = [*ODD, "a\na\na\na\na", "a\nb\nc\na\nb\nc\nd"] + ["\n".join(rng.choice("abcde") for _ in range(rng.randrange(1, 12))) for _ in range(40)]
    got = {r.doc_id: r for r in dedup_lines(docs_of(spark, texts)).collect()}
    want = lines_by_force(list(enumerate(texts)))
    assert {i: (r.text, r.n_removed) for i, r in got.items()} == want
    assert dedup_lines(empty(spark)).count() == 0
    odd = spark.createDataFrame([(None, "x\ny\nz"), (1, "x\ny\nz"), (1, "x\ny\nz")], "doc_id long, text string")
    assert sorted(str(r.text) for r in dedup_lines(odd).collect()) == ["", "", "x\ny\nz"]
