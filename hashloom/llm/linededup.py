"""Line dedup by overlapping three-line windows.

A document is cut at line feeds.  Every run of ``window`` consecutive lines is hashed
(128 bits); a document of fewer lines is one window of all its lines.  Of all places
that hold the same window, the first in order of (id, text hash, position) keeps it; at
every later place its lines are covered, and covered lines are removed once, however
many windows cover them.

The corpus-wide step sees hashes only and is aggregated before it is shuffled, so a
window held by a third of all rows arrives as one row from each task; the join back sends
such windows by broadcast (:func:`spread_join`).

Defined cases: null text stays null, with no lines; the empty text is one empty line, so
only its first document keeps it (it is empty either way); an empty table gives none; a
very long text is cut in time in proportion to its lines; null ids sort first; rows that
repeat one another in id and text are one document and share its result; other columns
pass through unchanged, but columns named as results are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.llm.shared import spread_join, written

_LINES, _HASH, _POS, _AT, _GONE, _ID = (f"__ld_{x}" for x in ("lines", "text", "pos", "at", "gone", "id"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumns({_ID: F.col(id_col), _HASH: F.xxhash64(F.col(text_col))})


def line_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """(id, text hash, pos, h1, h2): one row for each window, ``pos`` its first line."""
    lines = F.split(F.col(text_col), "\n", -1)
    key = _keyed(docs.filter(F.col(text_col).isNotNull()), id_col, text_col).select(_ID, _HASH, lines.alias(_LINES))

    def hashes(i):
        # Lines past the end are null, which the hash skips: a short document is one window.
        parts = [F.get(F.col(_LINES), i + k) for k in range(window)]
        return F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2"))

    last = F.greatest(F.size(_LINES) - window, F.lit(0))
    return (
        key.select(_ID, _HASH, F.posexplode(F.transform(F.sequence(F.lit(0), last), hashes)).alias(_POS, "w"))
        .select(_ID, _HASH, _POS, "w.h1", "w.h2")
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """``docs`` with later occurrences of repeated windows cut from ``text_col``, and
    ``n_lines`` and ``n_removed`` (both before a line feed is put between what stays)."""
    at = F.struct(_ID, _HASH, _POS)
    windows = line_windows(docs, id_col, text_col, window)
    repeated = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias(_AT)).filter("n > 1")
    # A window may be in a third of all rows.
    told = spread_join(windows, written(repeated, "windows"), ["h1", "h2"], "n", [_ID, _HASH, _POS])
    later = (
        told.filter(F.col(_AT).isNotNull() & ~at.eqNullSafe(F.col(_AT)))
        .groupBy(_ID, _HASH)
        .agg(F.collect_set(_POS).alias(_GONE))
        .withColumnsRenamed({_ID: f"{_ID}2", _HASH: f"{_HASH}2"})
    )
    keyed = _keyed(docs, id_col, text_col)
    same = keyed[_ID].eqNullSafe(later[f"{_ID}2"]) & (keyed[_HASH] == later[f"{_HASH}2"])
    gone = F.coalesce(F.col(_GONE), F.array().cast("array<int>"))
    # Merge what the windows cover: every later window hides lines pos .. pos + window - 1,
    # and a short document's only window no more than there are.
    hidden = F.array_distinct(F.flatten(F.transform(gone, lambda p: F.sequence(p, p + window - 1))))
    kept = [F.col(c) for c in docs.columns if c not in (text_col, "n_lines", "n_removed")]
    out = keyed.join(later, same, "left").withColumn(_LINES, F.split(F.col(text_col), "\n", -1))
    out = out.withColumn(_GONE, F.slice(hidden, 1, F.size(_LINES)))
    # No array is searched or cut again for each line: a filter on the counts may be pushed
    # into these expressions, and long texts have many lines.
    stays = F.array_except(F.sequence(F.lit(0), F.size(_LINES) - 1), F.col(_GONE))
    held = F.col(_LINES)
    new = F.when(F.size(_GONE) == 0, F.col(text_col)).otherwise(F.array_join(F.transform(stays, lambda i: F.get(held, i)), "\n"))
    null = F.col(text_col).isNull()
    return out.select(
        *kept,
        F.when(null, 0).otherwise(F.size(_LINES)).cast("long").alias("n_lines"),
        F.when(null, 0).otherwise(F.size(_GONE)).cast("long").alias("n_removed"),
        new.alias(text_col),
    )
