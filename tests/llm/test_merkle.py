"""The Merkle manifest against a plain tree in Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from hashloom.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, path int"
H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def tree(nodes, fanout):
    """The root, and for each node its siblings (left, right) level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for k, i in enumerate(at):
            run, p = runs[i // fanout], i % fanout
            paths[k].append(("".join(run[:p]), "".join(run[p + 1 :])))
        nodes, at = [H("".join(r)) for r in runs], [i // fanout for i in at]
    return nodes[0], paths


def wanted(rows, fanout):
    parts: dict = {}
    for r in rows:
        parts.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0), leaf(r)))
    names = sorted(parts, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: tree([x for _, x in sorted(parts[s])], fanout) for s in names}
    root, tops = tree([subs[s][0] for s in names], fanout)
    out = []
    for s, top in zip(names, tops, strict=True):
        for (i, x), path in zip(sorted(parts[s]), subs[s][1], strict=True):
            out.append((i[1] if i[0] else None, s, x, subs[s][0], root, path + top))
    return sorted(out, key=repr)


def found(df, fanout):
    rows = merkle.manifest(df, FIELDS, fanout=fanout).collect()
    return sorted(((r.doc_id, r.source, r.leaf, r.subroot, r.root, [tuple(e) for e in r.path]) for r in rows), key=repr)


@pytest.mark.parametrize("fanout", [2, 16])
def test_equals_a_plain_tree(spark, fanout):
    rng = random.Random(fanout)
    shape = {"a": 70 if fanout == 2 else 300, "b": 16, "c": 17, None: 5, "one": 1, "é": 2, "z" * 40: 1}
    rows = []
    for s, n in shape.items():
        for _ in range(n):
            rows.append((len(rows), s, rng.choice([None, "en", ""]), rng.choice([None, 3]), rng.choice([None, "", "Text", "ÄÖ", "x" * 5000]), "clash", 1))
    rows += [rows[0], rows[0], (None, "a", None, None, None, "", 0), (None, "a", None, None, "B", "", 0), (3, "a", "other", None, "", "", 0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df, fanout) == wanted(rows, fanout)


def test_one_source_one_row_and_none(spark):
    for n in (1, 2, 16, 17):
        rows = [(i, "s", None, None, "t", "", 0) for i in range(n)]
        assert found(spark.createDataFrame(rows, SCHEMA), 16) == wanted(rows, 16)
    empty = merkle.manifest(spark.createDataFrame([], SCHEMA), FIELDS)
    assert empty.count() == 0 and empty.columns == ["doc_id", "source", "leaf", "now", "subroot", "root", "path"]
    with pytest.raises(ValueError):
        merkle.manifest(spark.createDataFrame([], SCHEMA), FIELDS, fanout=1)


def test_changed_rows_fail(spark):
    rows = [(i, f"s{i % 3}", "en", i, "Some Text" if i % 2 else "plain", "", 0) for i in range(60)] + [(99, "s1", "en", 1, None, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = merkle.manifest(df, FIELDS, changed=[*map(F.col, FIELDS[:4]), F.lower("text")])
    got = got.withColumn("ok", merkle.folded(F.coalesce("now", "leaf"), F.col("path")) == F.col("root")).withColumn("proof", merkle.proof_sha256(F.col("path"))).collect()
    want = {w[0]: w for w in wanted(rows, 16)}
    for r in got:
        assert r.ok == (r.doc_id == 99 or r.doc_id % 2 == 0) and (r.now is None) == r.ok
        assert r.proof == H("".join(a + b for a, b in want[r.doc_id][5]))
