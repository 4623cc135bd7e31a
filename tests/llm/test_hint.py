"""The hint looks at first letters before anything else, and finds what it would find without."""

import re

from pyspark.sql import functions as F

from hashloom.llm import pii

STARTS = [w for ws in [*pii.GIVEN.values(), *pii.TITLES.values()] for w in ws] + ["AKIA", "gho_", "ghp_", "ghs_", "ghu_", "sk-"]


def test_the_hint_skips_no_title_name_or_token(spark):
    assert all(re.match(pii.FIRST, w) for w in STARTS) and pii.HINT.count(pii.FIRST) == 1
    plain = pii.HINT.replace(f"(?={pii.FIRST})", "")
    texts = [before + w + after for w in STARTS for before in ("", "и ", "x", "ж", "5", "(", "\n") for after in (" X", ". Ж", " x", "X", "")]
    texts += ["", "Ünal Öz", "a" * 31, "F" * 32, "@", "7", "good sky, где"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    found = rows.select(F.col("text").rlike(pii.HINT).alias("now"), F.col("text").rlike(plain).alias("plain")).collect()
    assert all(r.now == r.plain for r in found) and {r.now for r in found} == {True, False}
