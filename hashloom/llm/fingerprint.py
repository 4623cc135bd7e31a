"""Document fingerprints: threshold-scaled sketches of character shingles.

A text's shingles are all runs of ``WIDTH`` code points (a shorter text is one shingle).
Each has a hash of ``BITS`` bits; the fingerprint keeps every hash below a fixed fraction, 1 /
``FRACTION``, of the hash space, however many that are, so a long text keeps more than a
short one, two fingerprints can be compared or merged whatever the lengths of their texts,
and a part's containment in a whole is estimated without bias.  The fraction is the same
for every text.  A text that has no hash below it keeps its least hash alone, as a mark
above the threshold: two such texts are as alike as their marks are equal, and against any
other text a mark counts for nothing.

An estimate of similarity s from n distinct shingles of both texts has a standard error of
sqrt(s (1 - s) FRACTION / n): 0.05 at 6400 shingles and s = 0.5, 0.2 at 400.

A fingerprint is a string: the denominator of its fraction, a colon, and the sorted hashes
in base64, four bytes each (a mark has five), so some 0.1 letters for a byte of text.
:func:`packed` makes the bytes without base64, for tables of fingerprints.  Two different
shingles share a kept hash with probability 2^-32.  Equal texts have equal fingerprints.

Defined cases: the empty text and null have no shingles and an empty sketch, as no other
text has; two empty ones are alike (1.0), an empty one is unlike any other (0.0); an empty
table gives none; very long texts are taken whole; null ids come last and repeated rows
give a row each, ties being in order of text (all rows of one id are in one task); other
columns than id and text are left out.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashloom.llm.shared import mix64, plus, stretches

WIDTH, FRACTION = 8, 64
#: Hashes below the fraction are those of 32 bits.
BITS = 32 + FRACTION.bit_length() - 1
TOP = np.uint64(1 << 32)
_SHIFT = np.uint64(64 - BITS)
_P = (0x9E3779B97F4A7C15 | 1) % (1 << 64)
_POWERS = [np.uint64(pow(_P, k, 1 << 64)) for k in range(WIDTH + 1)]


def sketch(text: str) -> np.ndarray:
    """Sorted distinct hashes below the fraction, or the least one alone if none is."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(c):
        return np.zeros(0, np.uint64)
    if len(c) < WIDTH:
        h = np.uint64(len(c))
        with np.errstate(over="ignore"):
            for x in c:
                h = h * _POWERS[1] + x + np.uint64(1)
        return mix64(np.array([h], np.uint64)) >> _SHIFT
    two = c[:-1] * _POWERS[1] + c[1:]
    four = two[:-2] * _POWERS[2] + two[2:]
    h = mix64(four[:-4] * _POWERS[4] + four[4:]) >> _SHIFT
    some = h[h < TOP]
    return np.unique(some) if len(some) else h.min(keepdims=True)


def to_bytes(s: np.ndarray) -> bytes:
    """Four bytes a hash; a mark, which needs more than 32 bits, has five."""
    return int(s[0]).to_bytes(5, "big") if len(s) and s[0] >= TOP else s.astype(">u4").tobytes()


def from_bytes(raw: bytes) -> np.ndarray:
    if len(raw) == 5:
        return np.array([int.from_bytes(raw, "big")], np.uint64)
    return np.frombuffer(raw, ">u4").astype(np.uint64)


def to_string(s: np.ndarray) -> str:
    return f"{FRACTION}:{base64.b64encode(to_bytes(s)).decode()}"


def from_string(s: str) -> np.ndarray:
    scale, _, data = s.partition(":")
    if int(scale) != FRACTION:
        raise ValueError(f"a fingerprint of another fraction: 1/{scale}")
    return from_bytes(base64.b64decode(data))


def _below(s: np.ndarray) -> np.ndarray:
    """What of a sketch isn't a mark."""
    return s if len(s) and s[0] < TOP else s[:0]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the shingle sets."""
    if np.array_equal(a, b):
        return 1.0
    x, y = _below(a), _below(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    whole = len(x) + len(y) - both
    return both / whole if whole else 0.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has too."""
    x = _below(a)
    if not len(x):
        return float(len(a) > 0 and np.array_equal(a, b))
    return len(np.intersect1d(x, _below(b), assume_unique=True)) / len(x)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both shingle sets together."""
    x = np.union1d(_below(a), _below(b))
    return x if len(x) else np.concatenate((a, b)).min(keepdims=True) if len(a) + len(b) else a


@F.pandas_udf(T.StringType())
def fingerprint(text: pd.Series) -> pd.Series:
    return text.map(lambda t: to_string(sketch(t or "")))


@F.pandas_udf(T.BinaryType())
def packed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: to_bytes(sketch(t or "")))


@F.pandas_udf(T.DoubleType())
def likeness_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else likeness(from_string(x), from_string(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def containment_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else containment(from_string(x), from_string(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def merged(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([to_string(merge(from_string(x), from_string(y))) for x, y in zip(a, b, strict=True)])


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_partition: int = 4) -> DataFrame:
    """(id, text, next_text): each document with the text of the next one in descending
    order of id (nulls last, equal ids in order of text); after the last comes the first.

    No task sees more than its range of ids: ids are cut into ranges at quantiles, and the
    first document of each range is sent to the range before it as well."""
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * per_partition
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    ids = rows.select("__id")
    cuts = ids.agg(F.percentile_approx("__id", [k / n for k in range(1, n)] or [0.5], 20 * n)).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))

    def range_of(x: pd.Series, null: pd.Series) -> np.ndarray:  # nulls are in the lowest range
        return np.where(null, 0, np.searchsorted(cuts, x.to_numpy(np.int64), "right"))

    given = (F.coalesce("__id", F.lit(0)).cast("long"), F.col("__id").isNull())  # whole integers, so without nulls

    @F.pandas_udf(T.IntegerType())
    def ranged(x: pd.Series, null: pd.Series) -> pd.Series:
        return pd.Series(range_of(x, null), dtype="int32")

    # The greatest id of each range: as many rows as there are ranges.
    heads = sorted(((r[0], r[1]) for r in ids.groupBy(ranged(*given).alias("r")).agg(F.max("__id")).collect()), reverse=True)
    before = {r: heads[i - 1][0] for i, (r, _) in enumerate(heads)}  # of the highest: the lowest
    head_id = {r: h for r, h in heads}

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def places(x: pd.Series, null: pd.Series) -> pd.Series:
        out = []
        for r, v, no in zip(range_of(x, null).tolist(), x.tolist(), null.tolist(), strict=True):
            head = head_id[r] is None if no else head_id[r] == v
            out.append([r, before[r]] if head else [r])
        return pd.Series(out)

    dealt = rows.select("__id", "__text", F.posexplode(places(*given)).alias("__copy", "__range"))
    order = Window.partitionBy("__range").orderBy("__copy", F.col("__id").desc_nulls_last(), "__text")
    return dealt.withColumn("__next", F.lead("__text").over(order)).filter("__copy = 0").select(F.col("__id").alias(id_col), F.col("__text").alias(text_col), F.col("__next").alias("next_text"))


def _compare(batches):
    import pyarrow as pa

    last: tuple[str, np.ndarray] = ("", sketch(""))
    for batch in batches:
        for piece in stretches(batch, batch.schema.names[1], 1 << 20):
            ids, texts, nexts = (piece.column(k) for k in range(3))
            n, sha, own, edited, near_e, near_n, part = ([] for _ in range(7))
            for t, after in zip(texts, nexts, strict=True):
                t, after = t.as_py(), after.as_py()
                mine = last[1] if t == last[0] else sketch(t)
                k = len(t) // 3
                new = t[: len(t) - k] + after[:k]
                other, theirs = sketch(new), sketch(after)
                last = (after, theirs)  # rows come in order, so this is the next row's text
                n.append(len(t))
                sha.append(hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest())
                own.append(to_string(mine))
                edited.append(to_string(other))
                near_e.append(likeness(mine, other))
                near_n.append(likeness(mine, theirs))
                part.append(containment(mine, other))
            cols = [ids, pa.array(n, pa.int64()), *(pa.array(x, pa.string()) for x in (sha, own, edited)), *(pa.array(x, pa.float64()) for x in (near_e, near_n, part))]
            yield pa.RecordBatch.from_arrays(cols, names=[batch.schema.names[0], "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_edited"])


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint, that of its edited text (the last third replaced by
    the beginning of the next document), and how alike they and the next one's are."""
    rows = with_next(docs, id_col, text_col)
    schema = plus(rows.select(id_col), "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double")
    return rows.mapInArrow(_compare, schema)
