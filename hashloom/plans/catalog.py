"""The query catalog: each query of the library over the provided tables, with its SQL.

Stand-ins for the data sets: A2 (32-bit keys) is lineitem's part keys, R1 (20-byte ids) is
the SHA-1 of its order keys, R2 (words) is the words of all documents, A1 is generated.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.functions import families as fam
from hashloom.functions import params
from hashloom.functions.u64 import fast_range32, splitmix64
from hashloom.operators import exact, metrics, sketches, states
from hashloom.plans import experiments, sql, timings
from hashloom.sources import binary, datasets, extract, zips
from hashloom.sources.shared import shared_path

QUERIES, ORACLE = {}, {}
SEED = 42
K, WIDTH, DEPTH, BINS = 500, 1024, 3, 200
ALL_U32, ALL_R1 = list(fam.U32.values()), list(fam.byte_families().values())


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- streams --------------------------------------------------------------------------

A2_SQL = "SELECT l_partkey AS key FROM lineitem"
A2_DISTINCT_SQL = "SELECT DISTINCT l_partkey AS key FROM lineitem"
R1_SQL = "SELECT DISTINCT sha1(CAST(l_orderkey AS VARCHAR)) AS key, sha1(CAST(l_orderkey AS VARCHAR)) AS hexed FROM lineitem"
R2_SQL = r"SELECT w AS key FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents) WHERE w <> ''"
#: Orders by key are a stream with a stable position: its customers are keys, its halves sides.
SIDED_SQL = "SELECT o_custkey AS key, CAST(xor_low AS INTEGER) AS side FROM (SELECT o_custkey, {mix} & 1 AS xor_low FROM orders)".format(mix=sql.splitmix64("(o_orderkey + 12648430)::UBIGINT"))


def a2(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"))


def r1(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.unhex(F.sha1(F.col("l_orderkey").cast("string").cast("binary"))).alias("key"))


def r2(spark, sf_dir):
    return datasets.words(table(spark, sf_dir, "documents")).select(F.encode("word", "UTF-8").alias("key"))


def sided(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("key"))
    return datasets.split(orders, 0xC0FFEE)


# -- flagship -------------------------------------------------------------------------


def _bottom_k_sql(hashes: str, k: int, true: str) -> str:
    return f"""
WITH d AS (SELECT DISTINCT h FROM ({hashes})), s AS (SELECT h FROM d ORDER BY h LIMIT {k}),
e AS (SELECT count(*) AS size, max(h) AS kth FROM s), t AS ({true})
SELECT size, kth, CASE WHEN size < {k} THEN CAST(size AS DOUBLE) WHEN kth = 0 THEN CAST('inf' AS DOUBLE) ELSE {k - 1} / (CAST(kth AS DOUBLE) / 4294967296.0) END AS estimate, n_distinct FROM e, t
"""


@query("bottomk_partkey", f"SELECT size, kth, round(estimate, 6) AS estimate, n_distinct, round((estimate - n_distinct) / n_distinct, 8) AS relerr FROM ({_bottom_k_sql(sql.u32('MultShift', A2_DISTINCT_SQL, SEED), K, 'SELECT count(DISTINCT l_partkey) AS n_distinct FROM lineitem')})")
def bottomk_partkey(spark, sf_dir):
    keys = a2(spark, sf_dir)
    h = fam.U32["MultShift"].apply(keys.distinct(), "key", "h", SEED)
    est = sketches.bottom_k_estimate(sketches.bottom_k(h, "h", K), "h", K).crossJoin(F.broadcast(exact.distinct_count(keys, "key")))
    relerr = metrics.relative_error(F.col("estimate"), F.col("n_distinct"))
    return est.select("size", "kth", F.round("estimate", 6).alias("estimate"), "n_distinct", F.round(relerr, 8).alias("relerr"))


# -- hash families, their checksums and collisions ---------------------------------------


def _hash_query(name: str, families=fam.U32):
    def run(spark, sf_dir):
        return families[name].apply(a2(spark, sf_dir).distinct(), "key", "h", SEED).select("key", "h")

    return run


def _checksum_query(name: str):
    def run(spark, sf_dir):
        h = fam.U32[name].apply(a2(spark, sf_dir), "key", "h", SEED)
        return metrics.checksum(h, "h").withColumn("n_bits", F.bit_count("checksum").cast("long"))

    return run


def _sketch_queries(name: str) -> None:
    hashes = sql.u32(name, A2_DISTINCT_SQL, SEED)
    low = name.lower()

    @query(f"bottomk_{low}", f"SELECT size, kth, round(estimate, 6) AS estimate, n_distinct FROM ({_bottom_k_sql(hashes, K, 'SELECT count(DISTINCT l_partkey) AS n_distinct FROM lineitem')})")
    def bottom(spark, sf_dir):
        keys = a2(spark, sf_dir)
        h = fam.U32[name].apply(keys.distinct(), "key", "h", SEED)
        est = sketches.bottom_k_estimate(sketches.bottom_k(h, "h", K), "h", K).crossJoin(F.broadcast(exact.distinct_count(keys, "key")))
        return est.withColumn("estimate", F.round("estimate", 6))

    @query(f"oph_{low}", f"""
WITH k AS ({SIDED_SQL}), h AS ({sql.u32(name, 'SELECT DISTINCT key, side FROM k', SEED, 'side, ')}),
b AS (SELECT side, {sql.fast_range32('h', BINS)} AS bin, min(h) AS m FROM h GROUP BY ALL),
j AS (SELECT x.m AS x, y.m AS y FROM (SELECT * FROM b WHERE side = 0) x FULL OUTER JOIN (SELECT * FROM b WHERE side = 1) y ON x.bin = y.bin)
SELECT round(CASE WHEN count(*) = 0 THEN 1.0 ELSE count(*) FILTER (WHERE x = y) / count(*) END, 8) AS jaccard FROM j""")
    def one_permutation(spark, sf_dir):
        keys = sided(spark, sf_dir).select("key", "side").distinct()
        h = fam.U32[name].apply(keys, "key", "h", SEED)
        return sketches.oph_jaccard_sides(h, "h", BINS).select(F.round("jaccard", 8).alias("jaccard"))

    direct = " UNION ALL ".join(f"SELECT key, freq, {r} AS r, {sql.fast_range32('h', WIDTH)} AS c FROM ({sql.u32(name, 'SELECT key, freq FROM f', params.draw(SEED, 'row', r), 'freq, ')})" for r in range(DEPTH))
    pre = " UNION ALL ".join(f"SELECT key, freq, {r} AS r, {sql.fast_range32(sql.row_hash('h', params.draw(SEED, 'row_a', r), params.draw(SEED, 'row_b', r)), WIDTH)} AS c FROM ({sql.u32(name, 'SELECT key, freq FROM f', SEED, 'freq, ')})" for r in range(DEPTH))
    for mode, cells in (("direct", direct), ("prehash", pre)):

        @query(f"countmin_{mode}_{low}", f"""
WITH f AS (SELECT l_partkey AS key, count(*) AS freq FROM lineitem GROUP BY 1), x AS ({cells}),
n AS (SELECT r, c, least(sum(freq), 4294967295) AS cnt FROM x GROUP BY r, c)
SELECT x.key, CAST(min(cnt) AS BIGINT) AS est, any_value(freq) AS freq FROM x JOIN n USING (r, c) GROUP BY x.key""")
        def count_min(spark, sf_dir, mode=mode):
            freq = exact.frequencies(a2(spark, sf_dir), "key")
            if mode == "direct":
                h = freq
                for r in range(DEPTH):
                    h = fam.U32[name].apply(h, "key", f"h{r}", params.draw(SEED, "row", r))
                rows = [(f"h{r}", None) for r in range(DEPTH)]
            else:
                h = fam.U32[name].apply(freq, "key", "h", SEED)
                rows = [("h", lambda c, r=r: fam.row_hash(c, params.draw(SEED, "row_a", r), params.draw(SEED, "row_b", r))) for r in range(DEPTH)]
            counters = sketches.count_min(h, rows, WIDTH, "freq")
            return sketches.count_min_estimate(h, "key", rows, WIDTH, counters).join(freq, "key").select("key", "est", "freq")


for _name in fam.U32:
    query(f"hash_{_name.lower()}", sql.u32(_name, A2_DISTINCT_SQL, SEED))(_hash_query(_name))
    query(f"checksum_{_name.lower()}", f"SELECT bit_xor(h) AS checksum, CAST(bit_count(bit_xor(h)) AS BIGINT) AS n_bits FROM ({sql.u32(_name, A2_SQL, SEED)})")(_checksum_query(_name))
    _sketch_queries(_name)
for _name in fam.POLY:
    query(f"hash_{_name.lower()}_poly", sql.u32(_name, A2_DISTINCT_SQL, SEED, fill="polynomial"))(_hash_query(_name, fam.POLY))


@query("hash_poly61", f"SELECT key, {sql.poly61('key', params.polynomial(SEED, 'keys'))}::BIGINT AS h FROM ({A2_DISTINCT_SQL})")
def hash_poly61(spark, sf_dir):
    keys = a2(spark, sf_dir).distinct()
    return keys.withColumn("h", fam.polynomial(F.col("key"), params.polynomial(SEED, "keys")))


def _r1_sql(name: str, seed: int = SEED, source: str = R1_SQL, keep: str = "") -> str:
    """Of (key, hexed); ``keep`` names more columns, each with a comma after it."""
    if name == "RapidHash32":
        return sql.rapid20(source, seed, keep)
    ms = f"SELECT {keep}hexed AS id, {sql.ms_vector20('hexed', seed)} AS key FROM ({source})"
    if name == "MSVec":
        return f"SELECT {keep}id AS key, key AS h FROM ({ms})"
    inner = "SimpleTab32" if name == "TabOnMSVec" else f"TornadoTab32D{name[-1]}"
    return f"SELECT {keep}id AS key, h FROM ({sql.u32(inner, ms, seed, 'id, ' + keep)})"


def _r1_query(name: str):
    def run(spark, sf_dir):
        keys = r1(spark, sf_dir).distinct()
        return fam.byte_families()[name].apply(keys, "key", "h", SEED).select(F.lower(F.hex("key")).alias("key"), "h")

    return run


def _r1_sketches(name: str):
    def run(spark, sf_dir):
        h = fam.byte_families()[name].apply(r1(spark, sf_dir).distinct(), "key", "h", SEED)
        n = exact.distinct_count(r1(spark, sf_dir), "key")
        est = sketches.bottom_k_estimate(sketches.bottom_k(h, "h", K), "h", K).crossJoin(F.broadcast(n))
        return est.withColumn("estimate", F.round("estimate", 6))

    return run


def _r2_query(name: str):
    def run(spark, sf_dir):
        h = fam.byte_families()[name].apply(r2(spark, sf_dir).distinct(), "key", "h", SEED)
        return h.select(F.decode("key", "UTF-8").alias("key"), "h")

    return run


_C = "([{}]::UHUGEINT[])".format(", ".join(map(str, params.coefficients(SEED))))
_BYTE = "CAST('0x' || substr(hx, {0}, 2) AS UBIGINT)"
#: Vector multiply-shift of strings of any length: whole words, then what is left of one.
MSVEC_R2_SQL = f"""
WITH w AS (SELECT DISTINCT key, hex(encode(key)) AS hx FROM ({R2_SQL})),
n AS (SELECT key, hx, length(hx) // 8 AS n, (length(hx) // 2) % 4 AS rest FROM w),
t AS (SELECT key, hx, n, rest,
        list_sum(list_concat([0::UHUGEINT], [CAST('0x' || substr(hx, 8*i+7, 2) || substr(hx, 8*i+5, 2) || substr(hx, 8*i+3, 2) || substr(hx, 8*i+1, 2) AS UBIGINT)::UHUGEINT * {_C}[(i % 8) + 1] % {sql.TWO64} FOR i IN range(0, n)]))::UHUGEINT AS whole,
        CASE rest WHEN 0 THEN 0::UBIGINT WHEN 1 THEN {_BYTE.format('8*n+1')}
          WHEN 2 THEN {_BYTE.format('8*n+3')} * 256 + {_BYTE.format('8*n+1')}
          ELSE ({_BYTE.format('8*n+3')} * 256 + {_BYTE.format('8*n+1')}) * 256 + {_BYTE.format('8*n+5')} END AS tail FROM n)
SELECT key, (((whole + tail::UHUGEINT * {_C}[(n % 8) + 1] % {sql.TWO64}) % {sql.TWO64}) // 4294967296::UHUGEINT)::BIGINT AS h FROM t
"""


def _r2_sql(name: str) -> str | None:
    if name == "RapidHash32":
        return None
    if name == "MSVec":
        return MSVEC_R2_SQL
    inner = "SimpleTab32" if name == "TabOnMSVec" else f"TornadoTab32D{name[-1]}"
    return f"SELECT id AS key, h FROM ({sql.u32(inner, f'SELECT key AS id, h AS key FROM ({MSVEC_R2_SQL})', SEED, 'id, ')})"


for _name in fam.byte_families():
    query(f"hash_r1_{_name.lower()}", _r1_sql(_name))(_r1_query(_name))
    query(f"bottomk_r1_{_name.lower()}", f"SELECT size, kth, round(estimate, 6) AS estimate, n_distinct FROM ({_bottom_k_sql(_r1_sql(_name), K, 'SELECT count(DISTINCT l_orderkey) AS n_distinct FROM lineitem')})")(_r1_sketches(_name))
    query(f"hash_r2_{_name.lower()}", _r2_sql(_name))(_r2_query(_name))


@query("hash_splitmix64", f"SELECT key, hex({sql.splitmix64('key::UBIGINT')}) AS h FROM ({A2_DISTINCT_SQL})")
def hash_splitmix64(spark, sf_dir):
    return a2(spark, sf_dir).distinct().select("key", F.hex(splitmix64(F.col("key"))).alias("h"))


@query("hash_row_and_range", f"SELECT key, {sql.row_hash('key', 2654435769, 12345)} AS h, {sql.fast_range32(sql.row_hash('key', 2654435769, 12345), 1000)} AS bucket FROM ({A2_DISTINCT_SQL})")
def hash_row_and_range(spark, sf_dir):
    h = fam.row_hash(F.col("key"), 2654435769, 12345)
    return a2(spark, sf_dir).distinct().select("key", h.alias("h"), fast_range32(h, 1000).alias("bucket"))


@query("hash_fnv1a32", f"SELECT key, CAST(list_reduce([CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT) FOR i IN range(0, length(hx) // 2)], lambda h, c: xor(h, c) * 16777619 % 4294967296, 2166136261) AS BIGINT) AS h FROM (SELECT DISTINCT key, hex(encode(key)) AS hx FROM ({R2_SQL}))")
def hash_fnv1a32(spark, sf_dir):
    # In one step, the lambda's "key" would be the decoded string beside it.
    return r2(spark, sf_dir).distinct().withColumn("h", fam.fnv1a32(F.col("key"))).select(F.decode("key", "UTF-8").alias("key"), "h")


@query("collisions", f"WITH h AS ({sql.u32('MultShift', A2_DISTINCT_SQL, SEED)}), p AS (SELECT h >> 16 AS g, count(*) AS n FROM h GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n_keys, count(*) AS n_hashes, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS n_colliding FROM p")
def collisions(spark, sf_dir):
    h = fam.U32["MultShift"].apply(a2(spark, sf_dir).distinct(), "key", "h", SEED)
    return exact.collisions(h.withColumn("h", F.shiftright("h", 16)), "key", "h")


# -- exact counterparts and set operations ------------------------------------------------


@query("exact_distinct", "SELECT count(DISTINCT l_partkey) AS n_distinct FROM lineitem")
def exact_distinct(spark, sf_dir):
    return exact.distinct_count(a2(spark, sf_dir), "key")


@query("exact_frequency", "SELECT l_partkey AS key, count(*) AS freq FROM lineitem GROUP BY 1")
def exact_frequency(spark, sf_dir):
    return exact.frequencies(a2(spark, sf_dir), "key")


@query("split_sides", f"SELECT side, count(*) AS n, count(DISTINCT key) AS n_distinct FROM ({SIDED_SQL}) GROUP BY side")
def split_sides(spark, sf_dir):
    return sided(spark, sf_dir).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("n_distinct"))


@query("split_seedless", f"SELECT o_orderkey AS pos, CAST({sql.splitmix64('o_orderkey::UBIGINT')} & 1 AS INTEGER) AS side FROM orders")
def split_seedless(spark, sf_dir):
    return datasets.split(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos")), 0)


@query("split_default_seed", f"SELECT o_orderkey AS pos, CAST({sql.splitmix64(f'((o_orderkey::UHUGEINT + {datasets.A2_SPLIT_SEED}::UHUGEINT) % {sql.TWO64})::UBIGINT')} & 1 AS INTEGER) AS side FROM orders")
def split_default_seed(spark, sf_dir):
    return datasets.split(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos")), datasets.A2_SPLIT_SEED)


@query("split_halves", "WITH n AS (SELECT count(*) AS n FROM orders) SELECT CAST(o_orderkey >= n // 2 AS INTEGER) AS side, count(*) AS n FROM orders, n GROUP BY 1")
def split_halves(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"))
    return datasets.halves(orders, orders.count()).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("exact_jaccard", f"WITH k AS ({SIDED_SQL}), p AS (SELECT key, max(side = 0)::INT AS a, max(side = 1)::INT AS b FROM k GROUP BY key) SELECT CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b, CAST(sum(a * b) AS BIGINT) AS n_both, CAST(sum(greatest(a, b)) AS BIGINT) AS n_any, round(sum(a * b) / sum(greatest(a, b)), 8) AS jaccard FROM p")
def exact_jaccard(spark, sf_dir):
    return exact.set_sizes(sided(spark, sf_dir), "key").withColumn("jaccard", F.round("jaccard", 8))


@query("set_intersection", f"WITH k AS ({SIDED_SQL}) SELECT key FROM k WHERE side = 0 INTERSECT SELECT key FROM k WHERE side = 1")
def set_intersection(spark, sf_dir):
    k = sided(spark, sf_dir)
    return exact.intersection(k.filter("side = 0"), k.filter("side = 1"), "key")


@query("set_union", f"WITH k AS ({SIDED_SQL}) SELECT DISTINCT key FROM k")
def set_union(spark, sf_dir):
    k = sided(spark, sf_dir)
    return exact.union(k.filter("side = 0"), k.filter("side = 1"), "key")


@query("oph_join", f"""
WITH k AS ({SIDED_SQL}), h AS ({sql.u32('MultShift', 'SELECT DISTINCT key, side FROM k', SEED, 'side, ')}),
b AS (SELECT side, {sql.fast_range32('h', BINS)} AS bin, min(h) AS minhash FROM h GROUP BY ALL)
SELECT bin, max(minhash) FILTER (WHERE side = 0) AS x, max(minhash) FILTER (WHERE side = 1) AS y FROM b GROUP BY bin""")
def oph_join(spark, sf_dir):
    h = fam.U32["MultShift"].apply(sided(spark, sf_dir).select("key", "side").distinct(), "key", "h", SEED)
    side = lambda s, n: sketches.oph(h.filter(F.col("side") == s), "h", BINS).withColumnRenamed("minhash", n)
    return side(0, "x").join(side(1, "y"), "bin", "full_outer")


# -- generators, pools, extraction ---------------------------------------------------------

#: As long as lineitem, so it grows with the tables.
A1_N = "(SELECT count(*) FROM lineitem)"
A1_SQL = f"""SELECT pos, key FROM (
  SELECT p AS pos, p // 2 + 1 AS key FROM (SELECT unnest(range({A1_N} // 2)) AS p)
  UNION ALL
  SELECT {A1_N} // 2 + row_number() OVER (ORDER BY k, i) - 1 AS pos, k AS key
  FROM (SELECT k, unnest(range((k + 99) // 100)) AS i FROM (SELECT unnest(range(1, 100 * (CAST(sqrt({A1_N} / 100.0) AS BIGINT) + 2))) AS k)) QUALIFY pos < {A1_N})"""
A1_SIDED_SQL = f"SELECT key, CAST({sql.splitmix64('(pos + 12648430)::UBIGINT')} & 1 AS INTEGER) AS side FROM ({A1_SQL})"


def a1(spark, sf_dir):
    return datasets.a1(spark, table(spark, sf_dir, "lineitem").count())


@query("a1_stream", A1_SQL)
def a1_stream(spark, sf_dir):
    return a1(spark, sf_dir)


@query("a1_truth", f"WITH s AS ({A1_SQL}), f AS (SELECT key, count(*) AS n FROM s GROUP BY key) SELECT count(*) AS n_distinct, max(n) AS max_freq, (SELECT max(key) FROM s WHERE pos >= {A1_N} // 2) AS max_tail, CAST(sum(n) AS BIGINT) AS n FROM f")
def a1_truth(spark, sf_dir):
    s, n = a1(spark, sf_dir), table(spark, sf_dir, "lineitem").count()
    tail = s.filter(F.col("pos") >= n // 2).agg(F.max("key").alias("max_tail"))
    f = exact.frequencies(s, "key").agg(F.count(F.lit(1)).alias("n_distinct"), F.max("freq").alias("max_freq"), F.sum("freq").alias("n"))
    return f.crossJoin(F.broadcast(tail))


@query("a1_split", f"SELECT side, count(*) AS n, count(DISTINCT key) AS n_distinct FROM ({A1_SIDED_SQL}) GROUP BY side")
def a1_split(spark, sf_dir):
    return datasets.split(a1(spark, sf_dir), 0xC0FFEE).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("n_distinct"))


@query("a1_repeats", "SELECT k AS key, (k + 99) // 100 AS repeats FROM (SELECT DISTINCT l_partkey AS k FROM lineitem)")
def a1_repeats(spark, sf_dir):
    return a2(spark, sf_dir).distinct().select("key", datasets.a1_repeats(F.col("key")).alias("repeats"))


POOL, STREAM = datasets.POOL_N, datasets.STREAM_N


_START = sql.splitmix64(f"xor(range::UBIGINT, {params.draw(SEED, 'draw')}::UBIGINT)")
POOL_SQL = f"""
WITH p AS (SELECT o_custkey AS key, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders QUALIFY idx < {POOL}),
d AS (SELECT range AS pos, {sql.fast_range32(f"({_START} >> 32)", f"(SELECT least(count(*), {POOL}) FROM orders)")} AS idx FROM range({STREAM}))
SELECT pos, key FROM d JOIN p USING (idx)"""


@query("pool_stream", POOL_SQL)
def pool_stream(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey")
    return datasets.sample_stream(datasets.pool(orders, ["o_orderkey"], POOL), STREAM, SEED).select("pos", "key")


@query("binary_pool", POOL_SQL)
def binary_pool(spark, sf_dir):
    """The same with the pool written as a binary file and read back in byte ranges."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey")
    path = shared_path(spark, "pool")
    binary.write_u32(orders, path, ["o_orderkey"])
    pool = binary.read_u32(spark, path, range_bytes=1 << 16).filter(F.col("idx") < POOL)
    return datasets.sample_stream(pool, STREAM, SEED).select("pos", "key")


@query("entropy", f"SELECT p AS pos, ({sql.splitmix64(f'xor(p::UBIGINT, {params.draw(SEED, "entropy")}::UBIGINT)')} >> 32)::BIGINT AS value FROM (SELECT unnest(range({A1_N})) AS p)")
def entropy(spark, sf_dir):
    return datasets.random_values(spark, table(spark, sf_dir, "lineitem").count(), SEED, 32)


_SHAS = "SELECT DISTINCT lower(s) AS sha FROM (SELECT unnest(regexp_extract_all({0}, '\\b[0-9a-fA-F]{{40}}\\b')) AS s FROM {1})"


@query("extract_sha1", f"{_SHAS.format('text', 'documents')} UNION {_SHAS.format('html', 'pages')}")
def extract_sha1(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("text").unionAll(table(spark, sf_dir, "pages").select("html"))
    return extract.sha1_ids(texts)


@query("extract_events", "SELECT count(*) AS n_events, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k FROM events")
def extract_events(spark, sf_dir):
    events = extract.json_events(table(spark, sf_dir, "events").select("props"), "props")
    return events.agg(F.count(F.lit(1)).alias("n_events"), F.sum(F.get_json_object("event", "$.k").cast("long")).alias("sum_k"))


#: Made-up events: a SHA-1 after an escaped line feed and one deep inside count; a key, one
#: that a word goes on after, what is no object, and broken lines don't.
_EVENT_SHA = "sha1('{}' || CAST(o_orderkey AS VARCHAR))"


@query("event_shas", f"SELECT {_EVENT_SHA.format('a')} AS sha FROM orders UNION SELECT {_EVENT_SHA.format('d')} FROM orders UNION SELECT {_EVENT_SHA.format('e')} FROM orders WHERE o_orderkey % 2 = 0")
def event_shas(spark, sf_dir):
    sha = {x: F.sha1(F.concat(F.lit(x), F.col("o_orderkey").cast("string")).cast("binary")) for x in "abcdefg"}
    one = F.concat(F.lit('{"m": "revert\\n'), sha["a"], F.lit('", "'), sha["b"], F.lit('": 1, "l": ["'), sha["c"], F.lit('x", {"q": "\\"'), F.upper(sha["d"]), F.lit('\\" é"}]}'))
    many = F.concat(F.lit('{"events": [{"payload": {"head_sha" : "'), sha["e"], F.lit('"}}, "'), sha["f"], F.lit('"]}'))
    orders = table(spark, sf_dir, "orders")
    broken = orders.select(F.concat(F.lit('{"m": "'), sha["g"]).alias("value"))
    return extract.event_shas(orders.select(one.alias("value")).unionAll(orders.filter("o_orderkey % 2 = 0").select(many)).unionAll(broken))


@query("hex_ids", "WITH t AS (SELECT '  ' || sha1(CAST(o_orderkey AS VARCHAR)) || CASE WHEN o_orderkey % 3 = 0 THEN 'zz' ELSE '' END AS line FROM orders UNION ALL SELECT substr(sha1(CAST(o_orderkey AS VARCHAR)), 1, 39) FROM orders) SELECT substr(ltrim(line), 1, 40) AS sha FROM t WHERE regexp_matches(line, '^[ \\t\\r\\n]*[0-9a-fA-F]{40}')")
def hex_ids(spark, sf_dir):
    sha = F.sha1(F.col("o_orderkey").cast("string").cast("binary"))
    orders = table(spark, sf_dir, "orders")
    whole = orders.select(F.concat(F.lit("  "), sha, F.when(F.col("o_orderkey") % 3 == 0, "zz").otherwise("")).alias("value"))
    lines = whole.unionAll(orders.select(F.substring(sha, 1, 39)))
    return datasets.hex_ids(lines).select(F.lower(F.hex("key")).alias("sha"))


#: The sizes of the published extraction.
FIRST, PER_ROW = 1_000_000, 10_000


@query("first_words", rf"SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS pos, w AS word FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\s+') AS ws FROM documents)) WHERE w <> '' QUALIFY pos < {FIRST}")
def first_words(spark, sf_dir):
    return datasets.first_words(table(spark, sf_dir, "documents"), FIRST)


@query("zip_words", ORACLE["first_words"])
def zip_words(spark, sf_dir):
    """The same with all texts written to zip archives and their members read in pieces."""
    path = shared_path(spark, "zips")
    zips.write_zips(table(spark, sf_dir, "documents"), path, ["doc_id"])
    return zips.first_words_of_zips(spark, path, FIRST)


@query("joined_words", rf"WITH f AS (SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS pos, w FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\s+') AS ws FROM documents)) WHERE w <> '' QUALIFY pos < {FIRST}) SELECT pos // {PER_ROW} AS row, string_agg(w, ' ' ORDER BY pos) AS text FROM f GROUP BY 1")
def joined_words(spark, sf_dir):
    return extract.joined_words(datasets.first_words(table(spark, sf_dir, "documents"), FIRST), per_row=PER_ROW)


# -- metrics -----------------------------------------------------------------------------

#: Rows like those of an experiment, from a table: function, rep, relerr.
ERRORS_SQL = "SELECT l_returnflag || l_linestatus AS function, l_linenumber AS rep, (l_discount - l_tax) AS relerr FROM lineitem"


def errors(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("function"), F.col("l_linenumber").alias("rep"), (F.col("l_discount") - F.col("l_tax")).alias("relerr"))


@query("summary_moments", f"WITH e AS ({ERRORS_SQL}), s AS (SELECT function, avg(relerr) AS mu, stddev_pop(relerr) AS sd FROM e GROUP BY 1) SELECT function, round(any_value(mu), 8) AS mean, round(any_value(sd), 8) AS sd, round(avg(power((relerr - mu) / CASE WHEN sd > 0 THEN sd ELSE 1.0 END, 6)), 6) AS m6 FROM e JOIN s USING (function) GROUP BY 1")
def summary_moments(spark, sf_dir):
    return metrics.summary(errors(spark, sf_dir)).select("function", F.round("mean", 8).alias("mean"), F.round("sd", 8).alias("sd"), F.round("m6", 6).alias("m6"))


@query("axis_limits", f"WITH e AS (SELECT min(relerr) AS lo, max(relerr) AS hi FROM ({ERRORS_SQL})) SELECT round(lo - 0.05 * greatest(1e-12, hi - lo), 10) AS lo, round(hi + 0.05 * greatest(1e-12, hi - lo), 10) AS hi FROM e")
def axis_limits(spark, sf_dir):
    return metrics.limits(errors(spark, sf_dir)).select(F.round("lo", 10).alias("lo"), F.round("hi", 10).alias("hi"))


@query("axis_limits_excluding", f"WITH e AS (SELECT min(relerr) AS lo, max(relerr) AS hi FROM ({ERRORS_SQL}) WHERE function <> 'NO') SELECT round(lo - 0.02 * greatest(1e-12, hi - lo), 10) AS lo, round(hi + 0.02 * greatest(1e-12, hi - lo), 10) AS hi FROM e")
def axis_limits_excluding(spark, sf_dir):
    return metrics.limits(errors(spark, sf_dir), pad=0.02, exclude=["NO"]).select(F.round("lo", 10).alias("lo"), F.round("hi", 10).alias("hi"))


@query("axis_percentiles", f"WITH e AS (SELECT quantile_cont(relerr, 0.01) AS lo, quantile_cont(relerr, 0.99) AS hi FROM ({ERRORS_SQL})) SELECT round(lo - 0.05 * greatest(1e-12, hi - lo), 10) AS lo, round(hi + 0.05 * greatest(1e-12, hi - lo), 10) AS hi FROM e")
def axis_percentiles(spark, sf_dir):
    return metrics.limits(errors(spark, sf_dir), percentiles=(0.01, 0.99)).select(F.round("lo", 10).alias("lo"), F.round("hi", 10).alias("hi"))


@query("throughput_summary", "SELECT l_returnflag AS function, round(median(l_extendedprice), 6) AS sec, bit_xor(l_partkey) AS checksum, round(500000 * 10.0 / median(l_extendedprice) / 1e6, 10) AS mhash_s, round(median(l_extendedprice) * 1e9 / (500000 * 10.0), 6) AS ns_per_hash FROM lineitem GROUP BY 1")
def throughput_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("function"), F.lit(500_000).alias("n"), F.lit(10).alias("loops"), F.col("l_extendedprice").alias("sec"), F.col("l_partkey").alias("checksum"))
    r = lambda c, d: F.round(c, d).alias(c)
    return metrics.throughput(rows).select("function", r("sec", 6), "checksum", r("mhash_s", 10), r("ns_per_hash", 6))


@query("accuracy_csv", f"SELECT function, rep, round(relerr, 8) AS relerr FROM ({ERRORS_SQL})")
def accuracy_csv(spark, sf_dir):
    path = shared_path(spark, "accuracy")
    extract.write_accuracy(errors(spark, sf_dir), path)
    return extract.read_accuracy(spark, path)


# -- the experiment catalog ---------------------------------------------------------------


#: Repetitions of each family, and the published sizes of the sketches.
REPS = 20
FULL_K, FULL_WIDTH = 24_500, 32_768


def _accuracy_sql(name: str, reps: int, one) -> str:
    return " UNION ALL ".join(one(name, rep) for rep in range(1, reps + 1))


def _bk_rep(name: str, rep: int, k: int = K, keys: str = A2_DISTINCT_SQL) -> str:
    h = sql.u32(name, keys, params.draw(1, "rep", rep))
    return f"SELECT '{name}' AS function, {rep} AS rep, round((estimate - n_distinct) / n_distinct, 8) AS relerr FROM ({_bottom_k_sql(h, k, f'SELECT count(*) AS n_distinct FROM ({keys})')})"


rounded = lambda df: df.select("function", "rep", F.round("relerr", 8).alias("relerr"))


@query("accuracy_bottomk_a2", " UNION ALL ".join(_accuracy_sql(n, REPS, lambda n, rep: _bk_rep(n, rep, FULL_K)) for n in fam.U32))
def accuracy_bottomk_a2(spark, sf_dir):
    return rounded(experiments.bottom_k_accuracy(a2(spark, sf_dir), "key", ALL_U32, FULL_K, REPS))


#: A small k, as tables with fewer keys than the published one only show the exact branch.
@query("accuracy_bottomk_a2_small", " UNION ALL ".join(_accuracy_sql(n, REPS, _bk_rep) for n in fam.U32))
def accuracy_bottomk_a2_small(spark, sf_dir):
    return rounded(experiments.bottom_k_accuracy(a2(spark, sf_dir), "key", ALL_U32, K, REPS))


def _oph_rep(name: str, rep: int, sides: str = SIDED_SQL) -> str:
    return f"""SELECT '{name}' AS function, {rep} AS rep, round((j - t) / CASE WHEN t > 0 THEN t ELSE 1.0 END, 8) AS relerr FROM (
SELECT count(*) FILTER (WHERE x = y) / count(*) AS j FROM (SELECT max(m) FILTER (WHERE side = 0) AS x, max(m) FILTER (WHERE side = 1) AS y FROM (
SELECT side, {sql.fast_range32('h', BINS)} AS bin, min(h) AS m FROM ({sql.u32(name, f'SELECT DISTINCT key, side FROM ({sides})', params.draw(1, 'rep', rep), 'side, ')}) GROUP BY ALL) GROUP BY bin)),
(SELECT sum(a * b) / sum(greatest(a, b)) AS t FROM (SELECT key, max(side = 0)::INT AS a, max(side = 1)::INT AS b FROM ({sides}) GROUP BY key))"""


@query("accuracy_oph_a2", " UNION ALL ".join(_accuracy_sql(n, REPS, _oph_rep) for n in fam.U32))
def accuracy_oph_a2(spark, sf_dir):
    return rounded(experiments.oph_accuracy(sided(spark, sf_dir), "key", ALL_U32, BINS, REPS))


A2_FREQ_SQL = "SELECT l_partkey AS key, count(*) AS freq FROM lineitem GROUP BY 1"


def _cm_rep(name: str, rep: int, freq: str = A2_FREQ_SQL) -> str:
    cells = " UNION ALL ".join(f"SELECT key, freq, {r} AS r, {sql.fast_range32('h', FULL_WIDTH)} AS c FROM ({sql.u32(name, freq, params.draw(params.draw(1, 'row', r), 'rep', rep), 'freq, ')})" for r in range(DEPTH))
    return f"SELECT '{name}' AS function, {rep} AS rep, round(avg((est - freq) / freq::DOUBLE), 8) AS relerr FROM (SELECT key, any_value(freq) AS freq, min(cnt) AS est FROM (SELECT key, freq, sum(freq) OVER (PARTITION BY r, c) AS cnt FROM ({cells})) GROUP BY key)"


@query("accuracy_countmin_a2", " UNION ALL ".join(_accuracy_sql(n, REPS, _cm_rep) for n in fam.U32))
def accuracy_countmin_a2(spark, sf_dir):
    return rounded(experiments.count_min_accuracy(a2(spark, sf_dir), "key", ALL_U32, FULL_WIDTH, DEPTH, REPS))


R1_FREQ_SQL = "SELECT sha1(CAST(l_orderkey AS VARCHAR)) AS key, sha1(CAST(l_orderkey AS VARCHAR)) AS hexed, count(*) AS freq FROM lineitem GROUP BY l_orderkey"


def _cm_r1_rep(name: str, rep: int) -> str:
    """One hash of the family, then a row hash for each row."""
    h = f"SELECT hexed, freq, h FROM ({_r1_sql(name, params.draw(1, 'rep', rep), R1_FREQ_SQL, 'freq, ')}) AS x(freq, hexed, h)"
    row = lambda r: sql.row_hash("h", *(params.draw(1, f"row_{x}", rep * DEPTH + r) for x in "ab"))
    cells = " UNION ALL ".join(f"SELECT hexed AS key, freq, {r} AS r, {sql.fast_range32(row(r), FULL_WIDTH)} AS c FROM h" for r in range(DEPTH))
    return f"SELECT '{name}' AS function, {rep} AS rep, round(avg((est - freq) / freq::DOUBLE), 8) AS relerr FROM (WITH h AS MATERIALIZED ({h}) SELECT key, any_value(freq) AS freq, min(cnt) AS est FROM (SELECT key, freq, sum(freq) OVER (PARTITION BY r, c) AS cnt FROM ({cells})) GROUP BY key)"


@query("accuracy_countmin_r1", " UNION ALL ".join(_accuracy_sql(n, REPS, _cm_r1_rep) for n in fam.byte_families()))
def accuracy_countmin_r1(spark, sf_dir):
    return rounded(experiments.count_min_accuracy(r1(spark, sf_dir), "key", ALL_R1, FULL_WIDTH, DEPTH, REPS, direct=False))


@query("accuracy_bottomk_r2")
def accuracy_bottomk_r2(spark, sf_dir):
    return rounded(experiments.bottom_k_accuracy(r2(spark, sf_dir), "key", ALL_R1, FULL_K, REPS))


#: Made once for all families and repetitions.
A1_WITH = f"WITH a1 AS MATERIALIZED (SELECT key, count(*) AS freq FROM ({A1_SQL}) GROUP BY key), a1_sided AS MATERIALIZED (SELECT DISTINCT key, side FROM ({A1_SIDED_SQL})) "


@query("accuracy_bottomk_a1", A1_WITH + " UNION ALL ".join(_accuracy_sql(n, REPS, lambda n, rep: _bk_rep(n, rep, FULL_K, "SELECT key FROM a1")) for n in fam.U32))
def accuracy_bottomk_a1(spark, sf_dir):
    return rounded(experiments.bottom_k_accuracy(a1(spark, sf_dir), "key", ALL_U32, FULL_K, REPS))


def r1_sided(spark, sf_dir):
    pos = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(pos.alias("pos"), F.unhex(F.sha1(F.col("o_custkey").cast("string").cast("binary"))).alias("key"))
    return datasets.split(orders, 0xC0FFEE)


def r2_sided(spark, sf_dir):
    """Words, and on which side of the middle position they are."""
    words = datasets.halved_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return words.select(F.encode("word", "UTF-8").alias("key"), "side")


@query("split_words", rf"WITH w AS (SELECT w, row_number() OVER (ORDER BY doc_id, i) - 1 AS pos FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\s+') AS ws FROM documents)) WHERE w <> '') SELECT CAST(pos >= (SELECT count(*) FROM w) // 2 AS INTEGER) AS side, count(*) AS n, count(DISTINCT w) AS n_distinct FROM w GROUP BY 1")
def split_words(spark, sf_dir):
    return r2_sided(spark, sf_dir).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("n_distinct"))


ALL_BYTES = list(fam.byte_families().values())


def _bk_r1_rep(name: str, rep: int) -> str:
    h = _r1_sql(name, params.draw(1, "rep", rep))
    return f"SELECT '{name}' AS function, {rep} AS rep, round((estimate - n_distinct) / n_distinct, 8) AS relerr FROM ({_bottom_k_sql(h, FULL_K, 'SELECT count(DISTINCT l_orderkey) AS n_distinct FROM lineitem')})"


@query("accuracy_bottomk_r1", " UNION ALL ".join(_accuracy_sql(n, REPS, _bk_r1_rep) for n in fam.byte_families()))
def accuracy_bottomk_r1(spark, sf_dir):
    return rounded(experiments.bottom_k_accuracy(r1(spark, sf_dir), "key", ALL_BYTES, FULL_K, REPS))


@query("accuracy_countmin_a1", A1_WITH + " UNION ALL ".join(_accuracy_sql(n, REPS, lambda n, rep: _cm_rep(n, rep, "SELECT key, freq FROM a1")) for n in fam.U32))
def accuracy_countmin_a1(spark, sf_dir):
    return rounded(experiments.count_min_accuracy(a1(spark, sf_dir), "key", ALL_U32, FULL_WIDTH, DEPTH, REPS))


@query("accuracy_countmin_r2")
def accuracy_countmin_r2(spark, sf_dir):
    return rounded(experiments.count_min_accuracy(r2(spark, sf_dir), "key", ALL_BYTES, FULL_WIDTH, DEPTH, REPS, direct=False))


@query("accuracy_oph_a1", A1_WITH + " UNION ALL ".join(_accuracy_sql(n, REPS, lambda n, rep: _oph_rep(n, rep, "SELECT key, side FROM a1_sided")) for n in fam.U32))
def accuracy_oph_a1(spark, sf_dir):
    return rounded(experiments.oph_accuracy(datasets.split(a1(spark, sf_dir), 0xC0FFEE), "key", ALL_U32, BINS, REPS))


@query("accuracy_oph_r1")
def accuracy_oph_r1(spark, sf_dir):
    return rounded(experiments.oph_accuracy(r1_sided(spark, sf_dir), "key", ALL_BYTES, BINS, REPS))


@query("accuracy_oph_r2")
def accuracy_oph_r2(spark, sf_dir):
    return rounded(experiments.oph_accuracy(r2_sided(spark, sf_dir), "key", ALL_BYTES, BINS, REPS))


# -- timing drivers ----------------------------------------------------------------------------


def _r1_all(seed: int) -> dict[str, str]:
    every = "SELECT sha1(CAST(l_orderkey AS VARCHAR)) AS key, sha1(CAST(l_orderkey AS VARCHAR)) AS hexed FROM lineitem"
    return {name: _r1_sql(name, seed, every) for name in fam.byte_families()}


#: Stream, its families, and the SQL of their hashes, where there is one.
STREAMS = {"a2": (a2, ALL_U32, {n: sql.u32(n, A2_SQL, SEED) for n in fam.U32}), "r1": (r1, ALL_R1, _r1_all(SEED)), "r2": (r2, ALL_R1, None)}
USES = {
    "raw": (timings.raw, lambda h: f"SELECT bit_xor(h) AS c FROM ({h})"),
    "bottomk": (timings.bottom_k(FULL_K), lambda h: f"SELECT bit_xor(h) AS c FROM (SELECT DISTINCT h FROM ({h}) ORDER BY h LIMIT {FULL_K})"),
    "countmin": (timings.count_min(FULL_WIDTH, DEPTH, SEED), lambda h: "SELECT bit_xor(n) AS c FROM (SELECT count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT {r} AS r, {sql.fast_range32(sql.row_hash('h', params.draw(SEED, 'row_a', r), params.draw(SEED, 'row_b', r)), FULL_WIDTH)} AS c FROM ({h})" for r in range(DEPTH)) + ") GROUP BY r, c)"),
    "oph": (timings.one_permutation(BINS), lambda h: f"SELECT bit_xor(m) AS c FROM (SELECT min(h) AS m FROM ({h}) GROUP BY {sql.fast_range32('h', BINS)})"),
}


def _speed_query(use, stream, families):
    def run(spark, sf_dir):
        keys = stream(spark, sf_dir)
        times = timings.timed(spark, keys, "key", families, use, SEED, rounds=2)
        return timings.speeds(times).select("function", "n", "loops", "checksum", "agree", ((F.col("ns_per_hash") > 0) & (F.col("mhash_s") > 0)).alias("timed"))

    return run


for _stream, (_keys, _families, _hashes) in STREAMS.items():
    for _use, (_f, _checksum) in USES.items():
        _one = None if _hashes is None else " UNION ALL ".join(f"SELECT '{n}' AS function, (SELECT count(*) FROM lineitem) AS n, 1 AS loops, c AS checksum, true AS agree, true AS timed FROM ({_checksum(h)})" for n, h in _hashes.items())
        query(f"speed_{_use}_{_stream}", _one)(_speed_query(_f, _keys, _families))


# -- sketches as values ----------------------------------------------------------------------


_FLAG_SQL = sql.u32("MultShift", "SELECT DISTINCT l_returnflag, l_partkey AS key FROM lineitem", SEED, "l_returnflag, ")


@query("state_bottomk", f"""
WITH h AS ({_FLAG_SQL}), s AS (SELECT DISTINCT l_returnflag, h FROM h QUALIFY dense_rank() OVER (PARTITION BY l_returnflag ORDER BY h) <= {K})
SELECT l_returnflag, round(CASE WHEN count(*) < {K} THEN count(*) WHEN max(h) = 0 THEN CAST('inf' AS DOUBLE) ELSE {K - 1} / (max(h)::DOUBLE / 4294967296.0) END, 6) AS estimate, bit_xor(h) AS state_xor FROM s GROUP BY 1""")
def state_bottomk(spark, sf_dir):
    """States by flag and day of the month, as a table of them would be kept, merged by flag."""
    sketch = states.BottomK(K)
    rows = fam.U32["MultShift"].apply(table(spark, sf_dir, "lineitem"), "l_partkey", "h", SEED)
    daily = states.build(rows.withColumn("day", F.dayofmonth("l_shipdate")), sketch, "h", ["l_returnflag", "day"])
    merged = states.merge(daily, sketch, ["l_returnflag"])
    xor = states.measure(F.col("state"), lambda s: float(np.bitwise_xor.reduce(s)), sketch)
    return merged.select("l_returnflag", F.round(states.estimate(F.col("state"), sketch), 6).alias("estimate"), xor.cast("long").alias("state_xor"))


@query("state_oph", f"""
WITH h AS ({_FLAG_SQL}), b AS (SELECT l_returnflag AS f, {sql.fast_range32('h', BINS)} AS bin, min(h) AS m FROM h GROUP BY ALL),
g AS (SELECT DISTINCT f FROM b), p AS (SELECT x.f AS a, y.f AS b FROM g x, g y WHERE x.f < y.f)
SELECT p.a, p.b, round(count(*) FILTER (WHERE x.m = y.m) / count(*), 8) AS jaccard
FROM p, range({BINS}) r LEFT JOIN b x ON x.f = p.a AND x.bin = r.range LEFT JOIN b y ON y.f = p.b AND y.bin = r.range
WHERE x.m IS NOT NULL OR y.m IS NOT NULL GROUP BY 1, 2""")
def state_oph(spark, sf_dir):
    """The similarity of the parts of each two flags, from one state for each flag."""
    sketch = states.OnePermutation(BINS)
    rows = fam.U32["MultShift"].apply(table(spark, sf_dir, "lineitem"), "l_partkey", "h", SEED)
    one = states.build(rows, sketch, "h", ["l_returnflag"]).withColumnRenamed("l_returnflag", "a")  # a row for each flag
    two = one.withColumnsRenamed({"a": "b", "state": "other"})
    return one.join(two, F.col("a") < F.col("b")).select("a", "b", F.round(states.compare(F.col("state"), F.col("other"), sketch.jaccard, sketch), 8).alias("jaccard"))


# -- streaming (an extension) ----------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_countmin", f"SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, 0 AS row, {sql.fast_range32(sql.multiply_shift('user_id', SEED), 64)} AS col, least(count(*), 4294967295) AS cnt FROM events GROUP BY ALL")
def stream_countmin(spark, sf_dir):
    from hashloom.streaming.sketch_streams import count_min_windows, settled

    stream = fam.U32["MultShift"].apply(_events(spark, sf_dir), "user_id", "h", SEED)
    return settled(count_min_windows(stream, "ts", [("h", None)], 64, "1 day", "1 hour"), shared_path(spark, "stream"), shared_path(spark, "state"))


@query("stream_oph", f"""
WITH w AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events),
e AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, {sql.multiply_shift('user_id', SEED)} AS h FROM events)
SELECT start, {sql.fast_range32('h', 64)} AS bin, min(h) AS minhash FROM e, w WHERE start + INTERVAL 1 DAY <= mark GROUP BY ALL""")
def stream_oph(spark, sf_dir):
    """Windows that the watermark has closed; those still open are state, not result."""
    from hashloom.streaming.sketch_streams import appended, oph_windows

    stream = fam.U32["MultShift"].apply(_events(spark, sf_dir), "user_id", "h", SEED)
    return appended(oph_windows(stream, "ts", "h", 64, "1 day", "1 hour"), shared_path(spark, "stream"), shared_path(spark, "state"))
