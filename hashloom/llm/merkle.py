"""A Merkle manifest of a dataset: one digest that any change of any row changes, and for
each row the short proof that it is under it.

A row's leaf is the SHA-256 of its fields, each with its length, so no two rows read alike.
The leaves of a source stand in order of id; every ``fanout`` in a row become their parent,
the digest of their digests, and so on until one node is left, the source's subroot; the
subroots, in order of source, become the root in the same way.

The tree is built level by level as DataFrames.  Indices within a source come from
:func:`positions.numbered` (a source with a third of all rows is many ranges); a parent is
its children's index divided by the fanout; grouped, the children come as a sorted array,
which is hashed and kept as that level's table of runs.  Then proofs go down: from the
root on, each level's runs are joined to their parents' proofs, and each child gets the
digests left and right of it before what its parent has.  A node's siblings travel once
for a run, not once for a row, and joins are by source and index, so no key is hot.

Defined cases: a null field counts as ``-``, unlike an empty one; null ids come first; the
null source is a source, the first one; rows of one id stand in order of their leaves and
rows alike in all fields are a leaf each; an empty table has no leaves and gives none;
texts are hashed whole, however long; columns that aren't fields don't count, and only
those named below are returned, so none can clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashloom.llm.shared import written
from hashloom.operators.positions import numbered

FANOUT = 16


def digest(whole: Column) -> Column:
    return F.sha2(whole.cast("binary"), 256)


def leaf_of(fields: Sequence[Column]) -> Column:
    """The leaf of a row: ``-`` for null, else the value's UTF-8 length, a colon, and it."""
    text = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in text]))


def joined(kids: Column) -> Column:
    return F.array_join(F.transform(kids, lambda k: k["digest"]), "")


def _built(nodes: DataFrame, payload: Sequence[str], fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The runs (key, up, kids) of each level, and the roots (key, digest, height) of all
    keys, from nodes (key, idx, n, digest, payload); n is the number of a key's nodes."""
    runs, roots, most, height = [], [], nodes.agg(F.max("n")).first()[0] or 0, 0
    while True:
        roots.append(nodes.filter("n = 1").select("key", "digest", F.lit(height).alias("height")))
        if most <= 1:
            return runs, reduce(DataFrame.unionByName, roots)
        kid = F.struct("idx", "digest", *payload)
        run = nodes.filter("n > 1").groupBy("key", "n", F.floor(F.col("idx") / fanout).alias("up")).agg(F.array_sort(F.collect_list(kid)).alias("kids"))
        runs.append(written(run, "runs"))
        up = runs[-1].select("key", F.col("up").alias("idx"), F.ceil(F.col("n") / fanout).alias("n"), digest(joined(F.col("kids"))).alias("digest"))
        nodes, payload, most, height = up, (), -(-most // fanout), height + 1


def _proofs(runs: list[DataFrame], roots: DataFrame, nodes: DataFrame, payload: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """(key, digest, payload, carried, path) of each of ``nodes``: its path goes from its own
    run to the root of roots (key, digest, height, path, carried)."""
    above = None
    for height in range(len(runs), -1, -1):
        # Those whose tree is of this height start here; others come from the level above.
        at = roots.filter(F.col("height") == height).select("key", F.lit(0).cast("long").alias("idx"), "path", *carried)
        if not height:
            alone = nodes.filter("n = 1").select("key", "digest", *payload)
            at = alone.join(at.drop("idx"), "key").select("key", "digest", *payload, *carried, "path")
        if above is not None:
            run = runs[height].join(above.withColumnRenamed("idx", "up"), ["key", "up"])
            kids = F.col("kids")
            side = lambda i, k=kids: F.struct(joined(F.slice(k, F.lit(1), i)).alias("left"), joined(F.slice(k, i + 2, F.size(k))).alias("right"))
            each = run.select("key", *carried, "path", F.inline(F.transform(kids, lambda k, i: F.struct(k.alias("kid"), side(i).alias("side")))))
            path = F.concat(F.array("side"), "path").alias("path")
            below = ("digest", *payload) if not height else ("idx",)
            each = each.select("key", *[F.col(f"kid.{c}").alias(c) for c in below], *carried, path)
            at = at.unionByName(each.select(*at.columns))
        above = at
    return above


def manifest(docs: DataFrame, fields: Sequence[str], id_col: str = "doc_id", source_col: str = "source", fanout: int = FANOUT, changed: Sequence[Column] | None = None) -> DataFrame:
    """(id, source, leaf, now, subroot, root, path) of every row.

    ``path``: for each level from the row's run up to the root, the digests of its siblings
    to the left and to the right, each side as one string.  ``changed``: the fields as they
    are found at a later time; ``now`` is the leaf of these, null where it equals ``leaf``."""
    if fanout < 2:
        raise ValueError("the fanout must be at least 2")
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit(""))  # null first
    leaf = leaf_of([F.col(c) for c in fields])
    now = leaf if changed is None else leaf_of(changed)
    leaves = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), key.alias("key"), leaf.alias("digest"), now.alias("now"))
    leaves = written(leaves.withColumn("now", F.nullif("now", "digest")), "leaves")  # narrow from here on
    nodes = written(numbered(leaves, ["id", "digest"], ["key"], "idx", "n"), "nodes")
    payload = ("id", "source", "now")
    runs, roots = _built(nodes, payload, fanout)
    subroots = written(roots, "subroots")
    tops = written(numbered(subroots, ["key"], pos="idx", total="n").select(F.lit("").alias("key"), "idx", "n", "digest", F.col("key").alias("source_key"), "height"), "tops")
    upper, top = _built(tops, ("source_key", "height"), fanout)
    no_path = F.array().cast("array<struct<left:string,right:string>>")
    under = _proofs(upper, written(top.select("key", "height", no_path.alias("path"), F.col("digest").alias("root")), "root"), tops, ("source_key", "height"), ("root",))
    under = written(under.select(F.col("source_key").alias("key"), F.col("digest").alias("subroot"), "root", F.col("height").cast("int").alias("height"), "path"), "under")
    rows = _proofs(runs, under, nodes, payload, ("subroot", "root"))
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("digest").alias("leaf"), "now", "subroot", "root", "path")


def proof_sha256(path: Column) -> Column:
    """One digest of all siblings of a path, level by level, from left to right."""
    return digest(F.array_join(F.transform(path, lambda e: F.concat(e["left"], e["right"])), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives under the siblings of a path."""
    return F.aggregate(path, leaf, lambda h, e: digest(F.concat(e["left"], h, e["right"])))


_CRC = "list_reduce(range(8), lambda c, b: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), {})"


def oracle(fanout: int = FANOUT, deep: int = 5, wide: int = 3) -> str:
    """The same over documents in SQL, for sources of up to fanout^deep rows and up to
    fanout^wide sources."""
    h = "sha256(concat({}))".format(", ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")))
    crc = f"list_reduce([ascii(x) FOR x IN string_split(doc_id::VARCHAR, '')], lambda s, y: {_CRC.format('xor(s, y::BIGINT)')}, 4294967295)"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"d AS (SELECT doc_id, coalesce('s' || source, '') AS k, {h.format(text='text')} AS leaf, CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {h.format(text=low)} END AS bad FROM documents)",
        "x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM d)",
        "a0 AS (SELECT k, i, n, leaf AS h FROM x)",
    ]

    def level(name: str, at: int) -> list[str]:
        return [
            f"r{name}{at} AS (SELECT k, i // {fanout} AS up, n, list(h ORDER BY i) AS hs FROM {name}{at} GROUP BY k, i // {fanout}, n)",
            f"{name}{at + 1} AS (SELECT k, up AS i, (n + {fanout - 1}) // {fanout} AS n, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM r{name}{at})",
        ]

    for at in range(deep):
        parts += level("a", at)
    parts.append(f"b0 AS (SELECT '' AS k, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n, h, k AS source_key FROM a{deep})")
    for at in range(wide):
        parts += level("b", at)
    start = f"SELECT x.*, coalesce(bad, leaf) AS f, '' AS p, a.h AS subroot, t.h AS root, s.i AS si FROM x JOIN a{deep} a ON x.k = a.k JOIN b0 s ON x.k = s.source_key, b{wide} t"
    parts.append(f"f0 AS ({start})")
    steps = [("a", k, "f.k", "i") for k in range(deep)] + [("b", k, "''", "si") for k in range(wide)]
    for at, (name, k, key, i) in enumerate(steps):
        pos = f"(f.{i} // {fanout**k} % {fanout})"
        left, right = f"array_to_string(hs[1:{pos}], '')", f"array_to_string(hs[{pos} + 2:], '')"
        parts.append(
            f"f{at + 1} AS (SELECT f.* REPLACE (CASE WHEN r.n > 1 THEN sha256({left} || f || {right}) ELSE f END AS f, CASE WHEN r.n > 1 THEN p || {left} || {right} ELSE p END AS p) "
            f"FROM f{at} f JOIN r{name}{k} r ON r.k = {key} AND r.up = f.{i} // {fanout ** (k + 1)})"
        )
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{len(steps)}"
