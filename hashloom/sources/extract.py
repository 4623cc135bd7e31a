"""Extraction jobs and file sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word-bounded SHA-1 in hex, in either case.
SHA1 = r"\b[0-9a-fA-F]{40}\b"
ACCURACY = "function string, rep int, relerr double"
SPEED = "function string, Mhash_s double, ns_per_hash double, checksum_hex string, loops bigint, N bigint"
#: Parameters of a sketch that a speed file may have after those.
SPEED_EXTRA = ("K", "width", "depth")


def sha1_ids(texts: DataFrame, col: str = "text") -> DataFrame:
    """(sha): every SHA-1 in the texts, in lower case, distinct and sorted."""
    found = F.explode(F.regexp_extract_all(F.col(col), F.lit(SHA1), F.lit(0)))
    return texts.filter(F.col(col).rlike(SHA1)).select(found.alias("s")).select(F.lower("s").alias("sha")).distinct().orderBy("sha")


def json_events(rows: DataFrame, col: str = "value") -> DataFrame:
    """(event): JSON texts as events: the members of an array, those of an object's
    ``events``, or the object itself; text that isn't JSON is skipped."""
    v = F.try_parse_json(F.col(col))
    of = lambda path: F.try_variant_get(F.col("v"), path, "array<variant>")
    each = F.coalesce(of("$"), of("$.events"), F.array("v"))
    events = rows.select(v.alias("v")).filter("v is not null").select(F.explode(each).alias("event"))
    return events.select(F.to_json("event").alias("event")).filter(F.col("event").startswith("{"))


#: A string of a JSON text without spaces between its parts; a colon after it makes it a key.
STRING = r'"(?:[^"\\]++|\\.)*+":?'


def event_shas(rows: DataFrame, col: str = "value") -> DataFrame:
    """(sha): every SHA-1 in any string value, at any depth, of any event; object keys don't
    count.  An escape stands for a sign that is no part of a word, so it parts words."""
    strings = F.filter(F.regexp_extract_all("event", F.lit(STRING), F.lit(0)), lambda s: ~s.endswith('":'))
    plain = F.transform(strings, lambda s: F.regexp_replace(s, r"\\(?:u[0-9a-fA-F]{4}|.)", " "))
    some = json_events(rows, col).filter(F.col("event").rlike("[0-9a-fA-F]{40}"))
    return sha1_ids(some.select(F.explode(plain).alias("event")), "event")


def read_json_events(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """Events of files, plain or gzipped: one JSON text a line, or one a file."""
    return json_events(spark.read.text(path, wholetext=not lines))


def write_words(words: DataFrame, path: str, pos: str = "pos", word: str = "word") -> None:
    """One word a line, in order of position."""
    words.repartitionByRange(pos).sortWithinPartitions(pos).select(word).write.mode("overwrite").text(path)


def joined_words(words: DataFrame, pos: str = "pos", word: str = "word", per_row: int = 10_000) -> DataFrame:
    """(row, text): words joined by spaces, ``per_row`` at a time."""
    rows = words.groupBy(F.floor(F.col(pos) / per_row).alias("row")).agg(F.array_sort(F.collect_list(F.struct(pos, word))).alias("ws"))
    return rows.select("row", F.array_join(F.transform("ws", lambda x: x[word]), " ").alias("text"))


def write_accuracy(rows: DataFrame, path: str) -> None:
    """CSV with header; errors to eight places."""
    rows.select("function", "rep", F.format_string("%.8f", "relerr").alias("relerr")).write.mode("overwrite").option("header", True).csv(path)


def read_accuracy(spark: SparkSession, path: str) -> DataFrame:
    return required(spark.read.csv(path, header=True, schema=ACCURACY), ["function", "relerr"])


def write_speed(rows: DataFrame, path: str) -> None:
    """CSV with header; K, or width and depth, where the rows have them."""
    six = lambda c: F.format_string("%.6f", c)
    extra = [c for c in SPEED_EXTRA if c in rows.columns]
    out = rows.select("function", six("mhash_s").alias("Mhash_s"), six("ns_per_hash").alias("ns_per_hash"), F.concat(F.lit("0x"), F.lower(F.hex("checksum"))).alias("checksum_hex"), "loops", F.col("n").alias("N"), *extra)
    out.write.mode("overwrite").option("header", True).csv(path)


def read_speed(spark: SparkSession, path: str) -> DataFrame:
    names = spark.read.csv(path, header=True).columns
    schema = SPEED + "".join(f", {c} bigint" for c in SPEED_EXTRA if c in names)
    return required(spark.read.csv(path, header=True, schema=schema), ["function", "ns_per_hash"])


def required(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that have all of the columns; a frame without one of them has no rows."""
    if any(c not in rows.columns for c in columns):
        return rows.limit(0)
    return rows.dropna(subset=columns)


def le_words(key: Column, n: int) -> Column:
    """The first n little-endian 32-bit words of a BINARY column, as an array."""
    from hashloom.functions.families import word_le

    return F.array(*[word_le(key, i) for i in range(n)])
