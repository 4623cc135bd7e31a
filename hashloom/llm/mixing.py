"""Mixing sources to target weights by Pareto order sampling.

Sizes are words.  Each source's target is its share, by weight, of an amount of words; no
target is above ``repeats`` times its source, and what it would have more is shared by the
others (:func:`levels`).  A document of a source is then due ``e`` copies: its source's
target by its size for every document alike, or in proportion to an ``importance`` of its
own, up to ``repeats``.  The whole part of e are certain copies.  The rest, f, is the
probability of one more, and those are drawn as a Pareto sample: with u uniform from a hash
of the document, documents are ranked by

    (u / (1 - u)) / (f / (1 - f))

and each source takes the first ones.  The sample's size is fixed in words: it ends where
the next document would pass what is missing to the target; then one document more, that
whose size is nearest to what is missing, if that brings the source nearer to its target.
So a source misses its target by less than half of its last document, mostly by few words.

Where a source's sample ends is found by histograms of the rank, 4096 bins a source and
round, each round within the bin of the round before, until that has no more than 4096
rows.  No task has a source's documents: only sums by source and bin meet.  All of it is DataFrame operations.

Defined cases: null and empty texts have size 0 and none is taken; a source of size 0 has
target 0; the null source is a source, the last one; rows alike in id, source and text have
one draw and go together; null ids are ids like any other; ties of rank (2^48 ranks) go
together; an empty table gives none; texts are counted whole, however long; other columns
than id, text and source are left out, so none can clash.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashloom.llm.shared import forget, spread_join, written
from hashloom.operators.positions import numbered

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a rank, and of them those that one round of histograms settles.
RANK_BITS, ROUND_BITS = 48, 12
Weigh = Callable[[DataFrame], DataFrame]


def cycled(weights: Sequence[float], source: str = "source") -> Weigh:
    """Weights by the sources' order, null last, beginning again when they are used up."""

    def weigh(sources: DataFrame) -> DataFrame:
        ordered = numbered(sources.withColumn("__null", F.col(source).isNull()), ["__null", source], pos="__place").drop("__null")
        at = F.array(*[F.lit(float(w)) for w in weights])
        return ordered.withColumn("weight", F.element_at(at, (F.col("__place") % len(weights) + 1).cast("int"))).drop("__place")

    return weigh


def uniform(seed: str, *parts: Column) -> Column:
    """A number in (0, 1), of 52 bits, from an MD5 of the parts."""
    whole = F.concat_ws("\x1f", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return (F.conv(F.substring(F.md5(whole.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def pareto_rank(u: Column, f: Column) -> Column:
    """The odds of u by those of f, o, as the whole number below 2^48 o / (1 + o)."""
    odds = (u / (1.0 - u)) / (f / (1.0 - f))
    return F.floor(odds / (1.0 + odds) * float(1 << RANK_BITS)).cast("long")


def levels(rows: DataFrame, by: str, weight: str, cap: str, amounts: DataFrame) -> DataFrame:
    """(by, n, amount, level): the level at which the sum of min(cap, level * weight) over a
    group's rows is its amount; infinite if all caps are below that.

    Each round caps the rows that the level so far would lift above their cap and shares
    what is left among the others; the level only rises, and ends when no more rows are
    capped.  A group is never together: rounds sum up by group.  ``rows`` and ``amounts``
    (by, amount) are written tables; ``by`` has no nulls."""
    sums = rows.groupBy(by).agg(F.sum(weight).alias("rest"), F.count(F.lit(1)).alias("n"))
    level = F.when(F.col("rest") > 0, F.col("amount") / F.col("rest")).otherwise(0.0)
    state = written(sums.join(amounts.select(by, "amount"), by).select(by, "n", "amount", level.alias("level"), F.lit(0).cast("long").alias("n_capped")), "levels")
    while True:
        told = spread_join(rows.select(by, F.col(weight).alias("__w"), F.col(cap).alias("__c")), state, [by], "n", ["__w", "__c"])
        over = (F.col("__w") > 0) & (F.col("__c") <= F.col("level") * F.col("__w"))
        sums = told.groupBy(by).agg(
            F.count(F.lit(1)).alias("n"),
            F.first("amount").alias("amount"),
            F.first("level").alias("before"),
            F.first("n_capped").alias("n_before"),
            F.count_if(over).alias("n_capped"),
            F.sum(F.when(over, F.col("__c")).otherwise(0)).alias("capped"),
            F.sum(F.when(~over, F.col("__w")).otherwise(0)).alias("rest"),
        )
        more = F.col("n_capped") > F.col("n_before")
        raised = F.when(F.col("rest") > 0, (F.col("amount") - F.col("capped")) / F.col("rest")).otherwise(float("inf"))
        new = written(sums.select(by, "n", "amount", F.when(more, raised).otherwise(F.col("before")).alias("level"), "n_capped", more.alias("more")), "levels")
        forget(state)
        state = new.drop("more")
        if not new.filter("more").limit(1).count():
            return state.drop("n_capped")


def _cut(ranked: DataFrame, budgets: DataFrame) -> DataFrame:
    """(key, upto, gap): the rank before which a source's candidates (key, rank, size) fit
    into its budget, and what is then missing.  A source whose candidates all fit is not there."""
    rows, state, shift = ranked, budgets, RANK_BITS - ROUND_BITS
    while True:
        bins = rows.groupBy("key", F.shiftright("rank", shift).alias("bin")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("rows"))
        before = F.sum("s").over(Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        at = bins.withColumn("before", F.coalesce(before, F.lit(0))).join(state.select("key", "left"), "key")
        at = at.filter((F.col("before") <= F.col("left")) & (F.col("before") + F.col("s") > F.col("left")))
        state = written(at.select("key", "bin", "rows", (F.col("left") - F.col("before")).alias("left")), "cut")
        if not shift:
            break
        inside = state.select(F.col("key").alias("__key"), F.col("bin").alias("__bin"))
        # A bin of a source is a small part of it, so this join has no hot key.
        rows = written(rows.join(inside, (F.col("key") == F.col("__key")) & (F.shiftright("rank", shift) == F.col("__bin")), "left_semi"), "bin")
        # Bins of no more rows than a round has are settled at once.
        most = state.agg(F.max("rows")).first()[0] or 0
        shift = 0 if most <= 1 << ROUND_BITS else shift - ROUND_BITS
    return state.select("key", F.col("bin").alias("upto"), F.col("left").alias("gap"))


def mix(docs: DataFrame, weigh: Weigh, share: float = 1.0, repeats: int = 3, importance: Column | None = None, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, text_md5, size, source_size, target, copies, taken) of every document.

    ``share``: the words to take, as a share of all words; ``weigh`` adds ``weight`` to a
    frame of (source, source_size, n); ``importance``: how much more copies a document is
    due than others of its source, 0 or more."""
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit(""))
    size = F.coalesce(F.size(F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")
    md5 = F.md5(F.col(text_col).cast("binary"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), key.alias("key"), size.alias("size"), md5.alias("md5"), (F.lit(1.0) if importance is None else importance.cast("double")).alias("importance"))
    rows = written(rows.withColumn("u", uniform(seed, F.col("id"), F.col("md5"))), "sized")
    sources = written(weigh(rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    of_all = sources.select(F.lit("").alias("all"), "key", "weight", (F.col("source_size") * repeats).alias("cap"))
    amount = written(docs.sparkSession.createDataFrame([("", float(total) * share)], "all string, amount double"), "amount")
    level = levels(of_all, "all", "weight", "cap", amount).select("level")  # one row, or none
    target = F.least((F.col("source_size") * repeats).cast("double"), F.col("level") * F.col("weight"))
    sources = written(sources.crossJoin(F.broadcast(level)).select("key", "n", "source_size", target.alias("target")), "targets")

    lookup = sources.withColumn("per", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    if importance is not None:
        wanted = written(rows.select("key", (F.greatest(F.col("importance"), F.lit(0.0)) * F.col("size")).alias("w"), (F.col("size") * repeats).alias("c")), "wanted")
        per = levels(wanted, "key", "w", "c", sources.select("key", F.col("target").alias("amount")))
        lookup = lookup.drop("per").join(per.select("key", F.col("level").alias("per")), "key")
    lookup = written(lookup, "lookup")
    due = spread_join(rows, lookup, ["key"], "n", ["id", "md5"])
    # A level of infinity gives documents of no importance none.
    e = F.when(F.col("importance") > 0, F.least(F.lit(float(repeats)), F.col("per") * F.col("importance"))).otherwise(0.0)
    due = due.withColumn("e", e).withColumn("whole", F.floor("e").cast("long")).withColumn("f", F.col("e") - F.col("whole"))
    rank = F.when((F.col("f") > 0) & (F.col("size") > 0), pareto_rank(F.col("u"), F.col("f")))
    due = written(due.select("id", "source", "key", "md5", "size", "source_size", "target", "whole", rank.alias("rank")), "due")

    certain = due.groupBy("key").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"))
    budgets = written(lookup.join(certain, "key").select("key", "n", (F.col("target") - F.col("certain")).alias("left")), "budgets")
    cut = _cut(due.filter("rank is not null").select("key", "rank", "size"), budgets)
    cuts = written(budgets.join(cut, "key", "left").select("key", "n", "upto", "gap"), "cuts")
    rest = spread_join(due.filter("rank is not null").select("key", "rank", "size"), cuts, ["key"], "n", ["rank"])
    off = F.abs(F.col("size") - F.col("gap"))
    last = rest.filter((F.col("rank") >= F.col("upto")) & (off < F.col("gap"))).groupBy("key").agg(F.min(F.struct(off.alias("off"), "rank", "size")).alias("last"))
    cuts = written(cuts.join(last, "key", "left").select("key", "n", "upto", F.col("last.rank").alias("last_rank"), F.col("last.size").alias("last_size")), "cuts")
    told = spread_join(due, cuts, ["key"], "n", ["id", "md5"])
    drawn = F.coalesce(F.col("rank").isNotNull() & (F.col("upto").isNull() | (F.col("rank") < F.col("upto")) | ((F.col("rank") == F.col("last_rank")) & (F.col("size") == F.col("last_size")))), F.lit(False))
    copies = F.col("whole") + drawn.cast("long")
    return told.select(F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("md5").alias("text_md5"), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def copies_of(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs``, each row as many times as :func:`mix` says, with ``copy`` from 1."""
    rest = [c for c in docs.columns if c not in ("copy", "__copies")]
    told = mixed.filter("copies > 0").select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), F.col("text_md5").alias("__md5"), F.col("copies").alias("__copies")).distinct()
    md5 = F.md5(docs[text_col].cast("binary"))
    on = docs[id_col].eqNullSafe(told["__id"]) & docs[source_col].eqNullSafe(told["__source"]) & md5.eqNullSafe(told["__md5"])
    return docs.join(told, on).select(*rest, F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("copy"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix' || chr(31) || coalesce(CAST(doc_id AS VARCHAR), '-') || chr(31) || coalesce(md5(text), '-')) AS noise FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, 3.0::DOUBLE * source_size / w AS ratio FROM s),
l AS (SELECT ratio, ((SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE / ((SELECT sum(w) FROM s) - coalesce(sum(w) OVER before, 0))::DOUBLE AS level
      FROM o WINDOW before AS (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, (SELECT coalesce(arg_min(level, ratio) FILTER (WHERE ratio > level), 0) FROM l) * w) AS target FROM s),
e AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e,
             (('0x' || substr(noise, 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, floor(e)::BIGINT AS whole, e - floor(e) AS f FROM e),
q AS (SELECT *, CASE WHEN f > 0 AND size > 0 THEN (u / (1.0 - u)) / (f / (1.0 - f)) END AS odds FROM f),
r AS (SELECT *, floor(odds / (1.0 + odds) * 281474976710656.0::DOUBLE)::BIGINT AS rank FROM q),
b AS (SELECT source, max(target) - sum(whole * size) AS left_ FROM r GROUP BY source),
g AS (SELECT source, rank, sum(size) AS s FROM r WHERE rank IS NOT NULL GROUP BY source, rank),
c AS (SELECT source, rank, s, coalesce(sum(s) OVER (PARTITION BY source ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
k AS (SELECT c.source, c.rank AS upto, left_ - before AS gap FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source WHERE before <= left_ AND before + s > left_),
m AS (SELECT r.source, r.rank, r.size FROM r JOIN k ON r.source IS NOT DISTINCT FROM k.source WHERE r.rank >= upto AND abs(size - gap) < gap
      QUALIFY row_number() OVER (PARTITION BY r.source ORDER BY abs(size - gap), r.rank, size) = 1)
SELECT doc_id, r.size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(r.size * (whole + CASE WHEN r.rank IS NOT NULL AND (upto IS NULL OR r.rank < upto OR (r.rank = m.rank AND r.size = m.size)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r LEFT JOIN k ON r.source IS NOT DISTINCT FROM k.source LEFT JOIN m ON r.source IS NOT DISTINCT FROM m.source
"""
