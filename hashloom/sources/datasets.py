"""Key streams: frames with an explicit position.  No plan relies on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hashloom.functions.params import draw
from hashloom.functions.u64 import fast_range32, signed, splitmix64
from hashloom.operators.positions import running
from hashloom.sources.shared import written

#: Sizes of the pools and of the streams drawn from them.
POOL_N, STREAM_N = 250_000, 500_000
#: So many narrow rows at most are sent to all tasks.
SENT = 1 << 21
A2_SPLIT_SEED = 0xA5A5A5A5A5A5A5A5


def a1_repeats(key: Column) -> Column:
    return F.floor((key + 99) / 100).cast("long")


def a1(spark: SparkSession, n: int = STREAM_N) -> DataFrame:
    """(pos, key): the first half in pairs 1, 1, 2, 2, ...; in the rest key i comes
    ceil(i / 100) times.  The rest in closed form: keys up to 100 g fill 50 g (g + 1) places."""
    if n < 1:
        raise ValueError("n must be at least 1")
    half = n // 2
    pos, t = F.col("id"), F.col("id") - half
    filled = lambda g: 50 * g * (g + 1)
    guess = F.floor((F.sqrt(1 + 0.08 * F.greatest(t, F.lit(0))) - 1) / 2).cast("long")
    g = F.when(filled(guess + 1) <= t, guess + 1).when(filled(guess) > t, guess - 1).otherwise(guess)
    tail = F.col("g") * 100 + F.floor((t - filled(F.col("g"))) / (F.col("g") + 1)).cast("long") + 1
    head = F.floor(pos / 2).cast("long") + 1
    return spark.range(n).withColumn("g", g).select(pos.alias("pos"), F.when(pos < half, head).otherwise(tail).alias("key"))


def split(stream: DataFrame, seed: int = 0, pos: str = "pos") -> DataFrame:
    """Adds side (0 or 1): the lowest bit of splitmix64(seed + pos)."""
    start = F.col(pos).cast("long")
    if seed:
        # The sum wraps; adding in halves stays within BIGINT.
        low = start.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")) + F.lit(seed & 0xFFFFFFFF).cast("long")
        high = F.shiftrightunsigned(start, 32) + F.lit(seed >> 32 & 0xFFFFFFFF).cast("long") + F.shiftrightunsigned(low, 32)
        start = F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return stream.withColumn("side", splitmix64(start).bitwiseAND(F.lit(1).cast("long")).cast("int"))


def halves(stream: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """Adds side: 0 before the middle position, 1 from there."""
    return stream.withColumn("side", (F.col(pos) >= n // 2).cast("int"))


def pool(items: DataFrame, order: list[str], n: int = POOL_N) -> DataFrame:
    """The first ``n`` rows in a stable order with their place, idx.  Numbering sees no
    more than those n rows."""
    some = items.orderBy(*order).limit(n)
    return some.withColumn("idx", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


def draws(spark: SparkSession, pool_size: int, n: int = STREAM_N, seed: int = 0) -> DataFrame:
    """(pos, idx): n uniform draws with replacement, each a function of (seed, pos)."""
    if pool_size < 1:
        raise ValueError("the pool is empty")
    base = draw(seed, "draw")
    h = splitmix64(F.col("id").bitwiseXOR(F.lit(signed(base)).cast("long")))
    return spark.range(n).select(F.col("id").alias("pos"), fast_range32(F.shiftrightunsigned(h, 32), pool_size).alias("idx"))


def sample_stream(pool_rows: DataFrame, n: int = STREAM_N, seed: int = 0) -> DataFrame:
    """(pos, ...): a stream drawn from a pool with idx."""
    return draws(pool_rows.sparkSession, pool_rows.count(), n, seed).join(pool_rows, "idx").drop("idx")


def random_values(spark: SparkSession, n: int, seed: int = 0, width: int = 64) -> DataFrame:
    """(pos, value): the entropy pool as a counter generator; the upper ``width`` bits."""
    value = splitmix64(F.col("id").bitwiseXOR(F.lit(signed(draw(seed, "entropy"))).cast("long")))
    return spark.range(n).select(F.col("id").alias("pos"), (value if width == 64 else F.shiftrightunsigned(value, 64 - width)).alias("value"))


def hex_ids(lines: DataFrame, col: str = "value") -> DataFrame:
    """``lines`` whose first 40 characters after blanks are hex digits, plus key (20 bytes)."""
    return lines.filter(F.col(col).rlike(r"^[ \t\r\n]*[0-9a-fA-F]{40}")).withColumn("key", F.unhex(F.substring(F.ltrim(F.col(col), F.lit(" \t\r\n")), 1, 40)))


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, i, word): the white-space words of each text."""
    parts = F.filter(F.split(F.col(text_col), r"\s+"), lambda w: w != "")
    return docs.select(id_col, F.posexplode(parts).alias("i", "word"))


def _words_of(text_col: str) -> Column:
    return F.filter(F.split(F.col(text_col), r"\s+"), lambda w: w != "")


def first_words(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(pos, word): the first n words of all texts in order of id (equal ids: of their
    texts' hashes).  Only (id, hash, number of words) is put in order and added up, range by
    range; no more than the texts that hold the first n words travel."""
    wanted = {"__id": F.col(id_col), "__h": F.xxhash64(text_col), "__n": F.size(_words_of(text_col))}
    sizes = docs.select(*[c.alias(name) for name, c in wanted.items()]).filter("__n > 0")
    placed = written(running(sizes, ["__id", "__h"], "__n", before="__before").filter(F.col("__before") < n), "placed")
    # No more than n rows, as each has a word.
    sent = F.broadcast if n <= SENT else lambda df: df
    on = lambda a, b: a["__id"].eqNullSafe(b["__other"]) & (a["__h"] == b["__hash"])
    named = placed.select(F.col("__id").alias("__other"), F.col("__h").alias("__hash"), "__before")
    texts = docs.select(wanted["__id"].alias("__id"), wanted["__h"].alias("__h"), F.col(text_col).alias("__text"))
    texts = texts.join(sent(named.select("__other", "__hash").distinct()), on(texts, named), "left_semi").dropDuplicates(["__id", "__h"])
    each = texts.join(sent(named), on(texts, named)).select("__before", F.posexplode(_words_of("__text")).alias("__i", "word"))
    return each.select((F.col("__before") + F.col("__i")).cast("long").alias("pos"), "word").filter(F.col("pos") < n)


def halved_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, i, word, side): all words, side 0 before the middle position of all texts in
    order of id and 1 from there.  The middle lies in one text, found by running totals;
    texts before it and after it are on one side whole, and no word needs its position.
    Rows alike in id and text are parted where the first of them is."""
    rows = docs.withColumns({"__h": F.xxhash64(text_col), "__n": F.greatest(F.coalesce(F.size(_words_of(text_col)), F.lit(0)), F.lit(0))})
    sizes = written(rows.select(F.col(id_col).alias("__id"), "__h", "__n").filter("__n > 0"), "sizes")
    half = (sizes.agg(F.sum("__n")).first()[0] or 0) // 2
    at = running(sizes, ["__id", "__h"], "__n", before="__before").filter((F.col("__before") <= half) & (F.col("__before") + F.col("__n") > half)).first()
    words_of = rows.select(id_col, "__h", F.posexplode(_words_of(text_col)).alias("i", "word"))
    if at is None:
        return words_of.select(id_col, "i", "word", F.lit(0).alias("side"))
    own, middle = F.struct(F.col(id_col).alias("a"), F.col("__h").alias("b")), F.struct(F.lit(at["__id"]).cast(docs.schema[id_col].dataType).alias("a"), F.lit(at["__h"]).cast("long").alias("b"))
    side = F.when(own < middle, 0).when(own > middle, 1).otherwise((F.col("i") >= half - at["__before"]).cast("int"))
    return words_of.select(id_col, "i", "word", side.alias("side"))


def u32_from_binary(files: DataFrame, n: int = POOL_N) -> DataFrame:
    """(idx, key): little-endian 32-bit integers of a ``binaryFile`` row's content, the
    first n of them; an incomplete last one is left out."""
    count = F.least(F.floor(F.octet_length("content") / 4), F.lit(n)).cast("int")
    some = files.filter(count > 0).select("content", F.explode(F.sequence(F.lit(0), count - 1)).alias("idx"))
    pair = [F.hex(F.substring(F.col("content"), F.col("idx") * 4 + 1 + k, F.lit(1))) for k in (3, 2, 1, 0)]
    return some.select(F.col("idx").cast("long").alias("idx"), F.conv(F.concat(*pair), 16, 10).cast("long").alias("key"))
