"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from hashloom.llm.shared import shared_path, table

QUERIES, ORACLE = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op2_token_counts(spark, sf_dir):
    import public_tokenizers

    from hashloom.llm.tokens import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


@query
def op3_bpe(spark, sf_dir):
    import public_tokenizers

    from hashloom.llm.bpe import encode_decode

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query
def op4_language_id(spark, sf_dir):
    from hashloom.llm.langid import fit, held_out, identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    crf = fit(docs.filter(~held_out()), per_lang=200)
    found = identify(docs.select("doc_id", "text"), crf).withColumn("held_out", held_out())
    return found.select("doc_id", "held_out", "lang_pred", "score", "n_switches")


@query
def op5_jaccard_join(spark, sf_dir):
    from hashloom.llm.jaccard import jaccard_components

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs, words=4, share=(85, 100)).select("doc_id", "n_shingles", "component_id")


@query
def op6_fingerprints(spark, sf_dir):
    from hashloom.llm.fingerprint import compare_with_next

    return compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op7_decontamination(spark, sf_dir):
    from hashloom.llm.decontam import contamination

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), words=13, share=(1, 20))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE["op7_decontamination"] = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bp AS (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS p FROM bw WHERE len(ws) > 0),
bwin AS (SELECT DISTINCT item_id, list_slice(ws, p, p + 12) AS ws FROM bp),
bkey AS (SELECT item_id, array_to_string(ws, ' ') AS w, len(ws) AS n FROM bwin),
lens AS (SELECT DISTINCT n FROM bkey),
dp AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM dw, lens WHERE len(ws) >= n),
hit AS (SELECT d.doc_id, d.p, d.n, b.item_id FROM (SELECT doc_id, p, n, array_to_string(list_slice(ws, p, p + n - 1), ' ') AS w FROM dp) d JOIN bkey b ON d.w = b.w AND d.n = b.n),
covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS i FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op9_warc(spark, sf_dir):
    from hashloom.llm.warc import base32_sha1, page_of, read_warc, with_revisits, write_warc

    path = shared_path(spark, "warc")
    write_warc(with_revisits(table(spark, sf_dir, "pages").select("page_id", "url", "html"), min_bytes=0), path)
    # Both filters are pushed to the source; of revisits it decodes heads only.
    responses = read_warc(spark, path).filter("record_type = 'response'")
    revisits = read_warc(spark, path, payload="false").filter("record_type = 'revisit'")
    page = lambda c: page_of(F.col(c)).cast("long").alias("refers_to" if c == "refers_to" else "page_id")
    whole = responses.select(page("record_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), "record_type", page("refers_to"))
    return whole.unionAll(revisits.select(page("record_id"), F.col("http_length").alias("payload_bytes"), "payload_digest", "record_type", page("refers_to")))


@query
def op10_line_dedup(spark, sf_dir):
    from hashloom.llm.linededup import dedup_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, window=3).select("doc_id", "text", "n_lines", "n_removed")


ORACLE["op10_line_dedup"] = r"""
WITH cut AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
places AS (SELECT doc_id, ls, unnest(range(1, greatest(len(ls) - 2, 1) + 1)) AS p FROM cut WHERE text IS NOT NULL),
windows AS (SELECT doc_id, p, array_to_string(list_slice(ls, p, p + 2), chr(10)) AS w FROM places),
ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS r FROM windows),
covered AS (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS i FROM ranked WHERE r > 1),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM cut WHERE text IS NOT NULL),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE c.i IS NULL) AS text,
         count(*) AS n_lines, count(c.i) AS n_removed
  FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.i = c.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed
FROM cut d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


@query
def op8_license_scan(spark, sf_dir):
    from hashloom.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _license_sql() -> str:
    from hashloom.llm.licenses import oracle

    return oracle()


ORACLE["op8_license_scan"] = _license_sql()


@query
def op1_pii_surrogates(spark, sf_dir):
    from hashloom.llm.pii import pseudonymize

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pseudonymize(docs, key="production-key-from-a-secret-store")
    return found.select("doc_id", "text", "n_entities", F.array_join("kinds", ",").alias("kinds"))


@query
def op11_mixing(spark, sf_dir):
    from hashloom.llm.mixing import cycled, mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, cycled((1, 2, 3)), share=1.0, repeats=3).select("doc_id", "size", "source_size", "target", "taken")


def _mixing_sql() -> str:
    from hashloom.llm.mixing import ORACLE as sql

    return sql


ORACLE["op11_mixing"] = _mixing_sql()


@query
def op13_merkle(spark, sf_dir):
    from hashloom.llm.merkle import folded, manifest, proof_sha256

    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = table(spark, sf_dir, "documents").select(*fields)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = manifest(docs, fields, changed=[*map(F.col, fields[:4]), F.when(hit, lower).otherwise(F.col("text"))])
    root = folded(F.coalesce("now", "leaf"), F.col("path"))
    rows = found.select("doc_id", "leaf", "subroot", "root", proof_sha256(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _merkle_sql() -> str:
    from hashloom.llm.merkle import oracle

    return oracle()


ORACLE["op13_merkle"] = _merkle_sql()


@query
def op12_hard_negatives(spark, sf_dir):
    from hashloom.llm.hardneg import mine, quantized

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), quantized(F.col("embedding"), 256).alias("vector"))
    return mine(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=10, window=(30, 90))


def _negatives_sql() -> str:
    from hashloom.llm.hardneg import ORACLE as sql

    return sql


ORACLE["op12_hard_negatives"] = _negatives_sql()
