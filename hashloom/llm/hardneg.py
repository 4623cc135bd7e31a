"""Hard negatives by vantage-point trees over norm-augmented vectors.

Vectors are of whole numbers, a score is an inner product.  With M the greatest norm, a row
x gets one more component, sqrt(M^2 - |x|^2), and an anchor q gets 0; then

    distance(q, x)^2 = |q|^2 + M^2 - 2 score(q, x),

so higher scores are nearer, a window of scores is an annulus around the anchor, and the
triangle inequality holds.

Index.  Every row is indexed.  A coarse vantage-point tree, fitted on a bounded sample
(``SAMPLE`` rows of the least hashes), deals rows to at most 2^``DEPTH`` regions; a region
is cut by hash into blocks of at most about ``BLOCK_BYTES``, so one vector that a third of
all rows have is many blocks.  Each block gets a vantage-point tree of its own, with a
bucket of rows at each leaf, and is one row of a written table.

Search.  Anchors go in rounds of at most ``ANCHOR_BYTES``, sent to all tasks; a task passes
over its blocks.  In a block it has the distances of an anchor to all vantage points, from
them the least and greatest score in each bucket, and takes buckets from the nearest on
while one can still hold a row inside the annulus that is better than the k-th best so far.
A task returns k rows for each anchor and window; the best k of these are the result.
The first search is for an anchor's positives (any score, its label), the second for its
negatives inside each positive's window (another label).  Bounds only skip buckets, and
scores are exact, so results are those of a comparison with every row.

Defined cases: rows with a null id, label, vector or component, or with a component that
isn't finite, take no part, nor do vectors whose squared norm is 2^52 or more (scores of
these aren't exact in doubles); rows alike in id, label and vector count once; rows that
only share an id are rows of their own, but none is a positive or negative of an anchor of
its id; vectors of another length than the anchor's aren't compared with it; an empty table
or one without anchors gives no rows; an anchor with no positive, or a window with no row
in it, gives none; other columns are left out, so none can clash.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashloom.llm.shared import released, written
from hashloom.operators.positions import numbered

SAMPLE, DEPTH = 4096, 8
BUCKET = 64
BLOCK_BYTES, ANCHOR_BYTES = 1 << 20, 4 << 20
EXACT = float(1 << 52)
INDEX = "dim int, n int, depth int, ids binary, labels binary, vectors binary, offsets binary, vantage binary, bounds binary"


def quantized(vector: Column, scale: int = 256) -> Column:
    """Each component as floor(scale * x), x as double; null if any is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(vector, lambda x: _floor(x.cast("double") * float(scale))))


def _floor(x: Column) -> Column:
    # From 2^53 on a double is whole, and may be out of a BIGINT's range.
    return F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)


def _rows_of(dim: int, most_bytes: int) -> int:
    return max(BUCKET, most_bytes // (4 * dim + 16))


# -- vantage-point trees ------------------------------------------------------------------


def augmented(v: np.ndarray, top: float) -> np.ndarray:
    """Rows with the component that brings all norms to sqrt(top)."""
    rest = np.sqrt(np.maximum(top - np.einsum("ij,ij->i", v, v), 0.0))
    return np.concatenate((v, rest[:, None]), axis=1)


def planted(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A balanced vantage-point tree of the given depth over augmented points.

    Nodes are numbered from 1, the children of i are 2 i and 2 i + 1.  Returns the points'
    order, the places in it where the 2^depth buckets begin and end, each inner node's
    vantage point, and the least and greatest distance of each node's points to its
    parent's vantage point."""
    parts = {1: np.arange(len(points))}
    vantage = np.zeros(1 << depth, np.int32)
    bounds = np.zeros((2 << depth, 2))
    for node in range(1, 1 << depth):
        part = parts.pop(node)
        # The farthest point from the first one: at the rim, where distances differ most.
        far = np.linalg.norm(points[part] - points[part[0]], axis=1)
        vantage[node] = part[np.argmax(far)]
        d = np.linalg.norm(points[part] - points[vantage[node]], axis=1)
        half = np.argsort(d, kind="stable")
        cut = len(part) // 2
        for child, some in ((2 * node, half[:cut]), (2 * node + 1, half[cut:])):
            parts[child] = part[some]
            bounds[child] = d[some].min(), d[some].max()
    buckets = [parts[(1 << depth) + i] for i in range(1 << depth)]
    return np.concatenate(buckets), np.cumsum([0, *map(len, buckets)]), vantage, bounds


def depth_for(n: int, bucket: int) -> int:
    return max(0, int(math.log2(n / bucket))) if n >= 2 * bucket else 0


def reach(to_vantage: np.ndarray, bounds: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest distance that points of each bucket can have, by the triangle
    inequality at each node above, for anchors with distances ``to_vantage`` (anchor, node)."""
    near, far = np.zeros((len(to_vantage), 1)), np.full((len(to_vantage), 1), np.inf)
    for level in range(depth):
        nodes = np.arange(1 << level, 2 << level)
        kids = np.arange(2 << level, 4 << level)
        d = np.repeat(to_vantage[:, nodes], 2, axis=1)
        low, high = bounds[kids, 0], bounds[kids, 1]
        near = np.maximum.reduce([np.repeat(near, 2, axis=1), d - high, low - d])
        far = np.minimum(np.repeat(far, 2, axis=1), d + high)
    return near, far


# -- the index -------------------------------------------------------------------------


def _vectors(column, dim: int) -> np.ndarray:
    """Lists of one length as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def index(rows: DataFrame, top: float) -> DataFrame:
    """Blocks of ``rows`` (id, label, v, dim), a written table; ``top``: the greatest squared norm."""
    spark = rows.sparkSession
    total = rows.count()
    if not total:
        return spark.createDataFrame([], INDEX)
    dim, n = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    sample = rows.filter(F.col("dim") == dim).select("v", F.xxhash64("id", "v").alias("h")).orderBy("h").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    points = augmented(_vectors(sample, dim), top)
    # Regions of no more than a block need no finer ones.
    depth = min(DEPTH, depth_for(n, _rows_of(dim, BLOCK_BYTES)), depth_for(len(points), 8))
    order, begins, vantage, bounds = planted(points, depth)
    vectors = points[vantage]

    def dealt(batches):
        import pyarrow as pa

        for batch in batches:
            region = np.zeros(batch.num_rows, np.int32)
            mine = np.flatnonzero(batch.column("dim").to_numpy() == dim)
            if depth and len(mine):
                x = augmented(_vectors(batch.column("v").take(pa.array(mine)), dim), top)
                node = np.ones(len(mine), np.int64)
                for _ in range(depth):
                    d = np.linalg.norm(x - vectors[node], axis=1)
                    middle = (bounds[2 * node, 1] + bounds[2 * node + 1, 0]) / 2
                    node = 2 * node + (d > middle)
                region[mine] = node - (1 << depth)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region)], names=[*batch.schema.names, "region"])

    placed = written(rows.select("id", "label", "v", "dim").mapInArrow(dealt, "id long, label long, v array<int>, dim int, region int"), "placed")
    # At most 2^DEPTH rows: other lengths, which are rare, are cut as if all rows were of them.
    per = F.greatest(F.lit(BUCKET), F.floor(F.lit(BLOCK_BYTES) / (F.col("dim") * 4 + 16)))
    held = placed.filter(F.col("dim") == dim).groupBy("dim", "region").agg(F.count(F.lit(1)).alias("held"))
    cuts = F.ceil(F.coalesce("held", F.lit(total)) / per)
    part = F.pmod(F.xxhash64("id", "label", "v"), cuts).cast("long").alias("part")
    blocks = placed.join(F.broadcast(held), ["dim", "region"], "left").select("id", "label", "v", "dim", "region", part)

    def grown(table):
        import pyarrow as pa

        size = table.column("dim")[0].as_py()
        v = _vectors(table.column("v").combine_chunks(), size)
        ids, labels = (table.column(c).to_numpy().astype(np.int64) for c in ("id", "label"))
        first = np.lexsort((labels, ids))
        v, ids, labels = v[first], ids[first], labels[first]
        deep = depth_for(len(v), BUCKET)
        order, begins, vantage, bounds = planted(augmented(v, top), deep)
        place = np.argsort(order)  # rows are kept in the order of buckets
        kept = [ids[order], labels[order], v[order].astype(np.int32), begins.astype(np.int32), place[vantage].astype(np.int32), bounds]
        row = {"dim": size, "n": len(v), "depth": deep} | {c: x.tobytes() for c, x in zip(("ids", "labels", "vectors", "offsets", "vantage", "bounds"), kept, strict=True)}
        return pa.Table.from_pylist([row], schema=pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("depth", pa.int32()), *((c, pa.binary()) for c in ("ids", "labels", "vectors", "offsets", "vantage", "bounds"))]))

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = ["dim", "region", "part"]
    return written(blocks.repartition(tasks, *keys).groupBy(*keys).applyInArrow(grown, INDEX), "index")


# -- the search --------------------------------------------------------------------------


def _search(blocks: DataFrame, queries: dict, top: float, k: int, same: bool) -> DataFrame:
    """(q, score, id): the best k rows of each query in each task.  ``queries``: lists
    ``anchor`` (id, label, vector) and ``windows`` (anchor's place, least, greatest score)."""
    ids = np.array([a[0] for a in queries["anchor"]], np.int64)
    labels = np.array([a[1] for a in queries["anchor"]], np.int64)
    vectors = [np.array(a[2], np.int32) for a in queries["anchor"]]
    at, low, high = (np.array([w[i] for w in queries["windows"]], np.float64 if i else np.int64) for i in range(3))

    def run(batches):
        import pyarrow as pa

        by_dim = {}
        for i, v in enumerate(vectors):
            by_dim.setdefault(len(v), []).append(i)
        asked = {}
        for dim, anchors in by_dim.items():
            matrix = np.stack([vectors[i] for i in anchors]).astype(np.float64)
            mine: dict = {}
            for q, i in enumerate(at.tolist()):
                mine.setdefault(i, []).append(q)
            asked[dim] = matrix, np.einsum("ij,ij->i", matrix, matrix), [(i, mine.get(i, [])) for i in anchors]
        best: list = [(np.zeros(0), np.zeros(0, np.int64))] * len(at)
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c, kind: np.frombuffer(batch.column(c)[row].as_buffer(), kind)  # noqa: B023, E731
                dim, depth = batch.column("dim")[row].as_py(), batch.column("depth")[row].as_py()
                if dim not in asked:
                    continue
                matrix, norms, anchors = asked[dim]
                row_ids, row_labels = get("ids", np.int64), get("labels", np.int64)
                v = get("vectors", np.int32).reshape(len(row_ids), dim).astype(np.float64)
                begins, bounds = get("offsets", np.int32), get("bounds", np.float64).reshape(-1, 2)
                whole = (norms + top)[:, None]
                d = np.sqrt(np.maximum(whole - 2 * (matrix @ v[get("vantage", np.int32)].T), 0.0))
                near, far = reach(d, bounds, depth)
                slack = 1e-9 * whole + 1.0  # what rounding may take
                most, least = (whole - near**2) / 2 + slack, (whole - far**2) / 2 - slack
                turn = np.argsort(-most, axis=1, kind="stable")
                for a, (i, wanted) in enumerate(anchors):
                    for q in wanted:
                        scores, found = best[q]
                        for b in turn[a]:
                            floor = max(low[q], scores[-1]) if len(scores) == k else low[q]
                            if most[a, b] < floor:
                                break  # no bucket after it is nearer
                            if least[a, b] > high[q] or begins[b] == begins[b + 1]:
                                continue
                            part = slice(begins[b], begins[b + 1])
                            s = v[part] @ matrix[a]
                            fit = (s >= floor) & (s <= high[q]) & ((row_labels[part] == labels[i]) == same) & (row_ids[part] != ids[i])
                            if fit.any():
                                scores = np.concatenate((scores, s[fit]))
                                found = np.concatenate((found, row_ids[part][fit]))
                                first = np.lexsort((found, -scores))[:k]
                                scores, found = scores[first], found[first]
                        best[q] = scores, found
        counts = [len(s) for s, _ in best]
        if sum(counts):
            q = np.repeat(np.arange(len(best), dtype=np.int32), counts)
            cols = [pa.array(q), pa.array(np.concatenate([s for s, _ in best]).astype(np.int64)), pa.array(np.concatenate([f for _, f in best]))]
            yield pa.RecordBatch.from_arrays(cols, names=["q", "score", "id"])

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return blocks.mapInArrow(released(run), "q int, score long, id long").withColumn("rank", rank).filter(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), id_col: str = "vec_id", label_col: str = "label", vector_col: str = "vector") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` says which rows are; ``window`` is the least and greatest score of a
    negative in hundredths of the positive's.  ``vector_col`` is an array of whole numbers."""
    v = F.col(vector_col)
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    fine = rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (norm < EXACT))
    fine = fine.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(v, lambda x: x.cast("int")).alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"), norm.cast("long").alias("norm"))
    fine = written(fine.dropDuplicates(["id", "label", "v"]).withColumn("dim", F.size("v")), "vectors")
    top = float(fine.agg(F.max("norm")).first()[0] or 0)
    blocks = index(fine, top)
    asked = written(numbered(fine.filter("anchor").select("id", "label", "v", "dim"), ["dim", "id", "label"], pos="place"), "anchors")
    largest, n = asked.select(F.max("dim"), F.count(F.lit(1))).first()
    results, step = [], _rows_of(largest or 0, ANCHOR_BYTES)
    for begin in range(0, n, step):
        # A round of anchors, bounded in bytes, with at most ``positives`` windows each.
        some = [(r.id, r.label, r.v) for r in asked.filter(F.col("place").between(begin, begin + step - 1)).orderBy("place").collect()]
        every = [(i, -math.inf, math.inf) for i in range(len(some))]
        found = _search(blocks, {"anchor": some, "windows": every}, top, positives, True).orderBy("q", "rank").collect()
        windows = [(r.q, -(-window[0] * r.score // 100), window[1] * r.score // 100) for r in found]
        told = [(k, some[r.q][0], r.id, r.score) for k, r in enumerate(found)]
        names = rows.sparkSession.createDataFrame(told, "q int, anchor_id long, positive_id long, positive_score long")
        best = _search(blocks, {"anchor": some, "windows": windows}, top, negatives, False).join(F.broadcast(names), "q")
        results.append(written(best.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
    if not results:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, results)


ORACLE = r"""
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, a.label = v.label AS same, v.id, CAST(list_inner_product(a.v, v.v) AS BIGINT) AS score
      FROM v a, v WHERE a.id % 100 = 0 AND a.id <> v.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS r
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 10
"""
