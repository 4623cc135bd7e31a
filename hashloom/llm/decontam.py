"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are brought to a plain form first: A-Z in lower case, words (runs of ASCII digits,
letters and anything beyond ASCII) parted by single spaces, on UTF-8 bytes.  A pattern is
a window of ``words`` consecutive words of a benchmark item with a space on either side;
an item of fewer words is one pattern.

Search.  Patterns are grouped by length class, so that a short item doesn't spoil the
shifts of the long ones.  In a class with shortest length m and block size b, SHIFT[h(x)]
says how far the text may move on when the block x ends at the current position of the
m-byte frame; where it is 0, the bucket of the frame's suffix hash names the patterns to
try, and bytes are compared.  Many frames advance at once: each lane scans its own stretch
of the text, and stretches overlap by the frame, so numpy does the work of the loop.

Patterns are sent to executors in blocks of at most ``block_bytes``.  A benchmark beyond
that takes a pass over the documents for each block, one block being in memory at a time;
hits are written and joined to the rows of the documents, which keep all their columns.

Defined cases: null and empty texts have no words; an empty table gives none, and an empty
benchmark no hits; very long texts are searched whole; equal windows of several items
count for each of them; null ids and repeated rows give a row each; other columns pass
through, but columns named as results are replaced; null item ids are left out of the items
counted but their windows still hit.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.llm.shared import plus, released, stretches, utf8, written

#: Bytes that part words become spaces; A-Z become a-z.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Length classes: a class holds patterns of at least this many bytes and fewer than the next.
CLASSES = (2, 8, 24, 64)
LANES = 4096
HITS = ("starts", "ends", "items")


def plain(text: bytes) -> bytes:
    """Words parted by single spaces, with a space at both ends (b" " if there are none)."""
    words = text.translate(PLAIN).split()
    return b" " + b" ".join(words) + b" " if words else b" "


def windows_of(text: bytes, words: int) -> set[bytes]:
    w = text.translate(PLAIN).split()
    if not w:
        return set()
    return {b" " + b" ".join(w[i : i + words]) + b" " for i in range(max(1, len(w) - words + 1))}


class LengthClass:
    """The tables of one length class."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = m = min(map(len, patterns))
        self.b = b = min(8, m)
        self.bits = max(12, min(20, (len(patterns) * (m - b + 1)).bit_length() + 3))
        frames = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(len(patterns), m)
        self.shift = np.full(1 << self.bits, m - b + 1, np.uint8 if m - b + 1 < 256 else np.int32)
        for end in range(b, m + 1):  # ascending, so the smallest shift is written last
            block = self._hash(np.ascontiguousarray(frames[:, end - b : end]))
            self.shift[block] = m - end
        # Patterns in the order of their suffix hash, and where each bucket begins.
        self.suffix = self._hash(np.ascontiguousarray(frames[:, m - b :]))
        buckets = defaultdict(list)
        for i, h in enumerate(self.suffix.tolist()):
            buckets[h].append(i)
        self.buckets = dict(buckets)

    def _hash(self, blocks: np.ndarray) -> np.ndarray:
        out = np.zeros(len(blocks), np.uint64)
        for k in range(self.b):
            out = (out << np.uint64(8)) | blocks[:, k].astype(np.uint64)
        return self._mix(out)

    def _mix(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, buf: bytes, arr: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, pattern number) of every occurrence in ``buf``."""
        m, b, n = self.m, self.b, len(buf)
        if n < m:
            return
        # A big-endian 8-byte value at every place; of it the upper b bytes are the block.
        words = np.lib.stride_tricks.as_strided(arr[: n + 8], (n, 8), (1, 1))
        span = max(m, -(-(n - m + 1) // LANES))
        pos = np.arange(0, n - m + 1, span, dtype=np.int64)  # where each lane's frame begins
        stop = np.minimum(pos + span, n - m + 1)
        down = np.uint64(8 * (8 - b))
        while pos.size:
            at = pos + (m - b)
            block = np.ascontiguousarray(words[at]).view(">u8").ravel().astype(np.uint64) >> down
            h = self._mix(block)
            move = self.shift[h].astype(np.int64)
            zero = np.flatnonzero(move == 0)
            if zero.size:
                for p, x in zip(pos[zero].tolist(), h[zero].tolist(), strict=True):
                    for i in self.buckets.get(x, ()):
                        if buf.startswith(self.patterns[i], p):
                            yield p, i
                move[zero] = 1
            pos = pos + move
            live = pos < stop
            if not live.all():
                pos, stop = pos[live], stop[live]


class Matcher:
    """All patterns of a block of the benchmark."""

    def __init__(self, items: list[tuple[object, bytes]], words: int = 13):
        owners: dict[bytes, set] = defaultdict(set)
        for item, text in items:
            for w in windows_of(text, words):
                owners[w].add(item)
        by_class: dict[int, list[bytes]] = defaultdict(list)
        for p in sorted(owners):
            by_class[max(c for c in CLASSES if c <= len(p))].append(p)
        self.owners = dict(owners)
        self.classes = [LengthClass(ps) for _, ps in sorted(by_class.items())]

    def hits(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set]]:
        """For each plain text: the number of words, the word ranges [from, to) that
        occurrences cover, merged, and the items that occur."""
        buf = b"\n".join(texts) + b"\n"
        arr = np.frombuffer(buf + b"\0" * 8, np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        found: dict[int, list[tuple[int, int, set]]] = defaultdict(list)
        places: list[int] = []
        got: list[tuple[int, bytes]] = []
        for c in self.classes:
            for p, i in c.search(buf, arr):
                places.append(p)
                got.append((p, c.patterns[i]))
        for doc, (p, pattern) in zip(np.searchsorted(ends, places, "right").tolist(), got, strict=True):
            begin = p - (int(ends[doc - 1]) if doc else 0)
            found[doc].append((begin, begin + len(pattern), self.owners[pattern]))
        out = []
        for doc, text in enumerate(texts):
            n_words = max(0, text.count(b" ") - 1)
            ranges: list[list[int]] = []
            items: set = set()
            seen, word = 0, 0
            for begin, end, who in sorted(found.get(doc, ()), key=lambda x: x[:2]):
                word += text.count(b" ", seen, begin)
                seen = begin
                last = word + text.count(b" ", begin, end) - 1
                items |= who
                if ranges and ranges[-1][1] >= word:
                    ranges[-1][1] = max(ranges[-1][1], last)
                else:
                    ranges.append([word, last])
            out.append((n_words, [tuple(r) for r in ranges], items))
        return out


def _bytes(text) -> bytes:
    """UTF-8 of an Arrow string; null is empty."""
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def _scan(items: list[tuple[object, bytes]], words: int, text_col: str, keep_text: bool, hits_only: bool, batch_bytes: int):
    def run(batches):
        import pyarrow as pa

        matcher = Matcher(items, words)
        arrow = {"long": pa.int64(), "list": pa.list_(pa.int64()), "items": pa.list_(pa.string())}
        for batch in batches:
            for part in stretches(batch, text_col, batch_bytes):
                hits = matcher.hits([plain(_bytes(t)) for t in part.column(text_col)])
                names = [c for c in batch.schema.names if keep_text or c != text_col]
                cols = [part.column(c) for c in names]
                cols += [
                    pa.array([h[0] for h in hits], arrow["long"]),
                    pa.array([[r[0] for r in h[1]] for h in hits], arrow["list"]),
                    pa.array([[r[1] for r in h[1]] for h in hits], arrow["list"]),
                    pa.array([sorted(str(i) for i in h[2] if i is not None) for h in hits], arrow["items"]),
                ]
                out = pa.RecordBatch.from_arrays(cols, names=[*names, "n_words", "starts", "ends", "items"])
                yield out.filter(pa.array([bool(h[1]) for h in hits], pa.bool_())) if hits_only else out

    return run


def _merge_ranges(col: str):
    """Sorted, overlapping [start, end) ranges to the number of places they cover."""
    step = lambda acc, r: F.struct(
        F.greatest(acc["upto"], r["end"]).alias("upto"),
        (acc["n"] + F.greatest(F.lit(0).cast("long"), r["end"] - F.greatest(acc["upto"], r["start"]))).alias("n"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.array_sort(F.col(col)), zero, step, lambda acc: acc["n"])


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    words: int = 13,
    share: tuple[int, int] = (1, 20),
    block_bytes: int = 8 << 20,
    batch_bytes: int = 2 << 20,
    keep_text: bool = False,
) -> DataFrame:
    """``docs`` (without the text unless it is to be kept) plus n_words, n_hit, items (sorted
    strings), n_items and contaminated: at least ``share`` of the words lie inside windows
    of the benchmark."""
    docs = docs.drop("n_words", "n_hit", "items", "n_items", "contaminated", "starts", "ends")
    keep = [c for c in docs.columns if keep_text or c != text_col]
    bench = benchmark.select(F.col(item_col).alias("__item"), utf8(item_text_col).alias("__text")).filter("__text is not null")
    # A window repeats its words up to `words` times, so that a block is bounded by its windows.
    total = (bench.agg(F.sum(F.octet_length("__text"))).first()[0] or 0) * words
    n_blocks = max(1, -(-total // block_bytes))
    blocks = (bench.filter(F.pmod(F.xxhash64("__item", "__text"), F.lit(n_blocks)) == k) for k in range(n_blocks))
    loaded = ([(r["__item"], bytes(r["__text"])) for r in b.toLocalIterator()] for b in blocks)

    def scan(rows: DataFrame, items: list, keep_text: bool, hits_only: bool = False) -> DataFrame:
        schema = plus(rows if keep_text else rows.drop(text_col), "n_words long, starts array<long>, ends array<long>, items array<string>")
        return rows.mapInArrow(released(_scan(items, words, text_col, keep_text, hits_only, batch_bytes)), schema)

    if n_blocks == 1:
        found = scan(docs, next(loaded), keep_text)
    else:
        # One block at a time is in memory; only documents with hits are written, and joined
        # to the rows they belong to.
        row = {"__id": F.col(id_col), "__row": F.xxhash64(text_col)}
        texts = docs.select(*[c.alias(k) for k, c in row.items()], text_col)
        hits = reduce(DataFrame.unionAll, [written(scan(texts, items, False, True).drop("n_words"), "hits") for items in loaded])
        hits = hits.groupBy("__id", "__row").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in HITS]).withColumnsRenamed({"__id": "__id2", "__row": "__row2"})
        counted = scan(docs.withColumns(row), [], keep_text).drop(*HITS)
        same = counted["__id"].eqNullSafe(hits["__id2"]) & (counted["__row"] == hits["__row2"])
        none = {"starts": "array<bigint>", "ends": "array<bigint>", "items": "array<string>"}
        found = counted.join(hits, same, "left").withColumns({c: F.coalesce(c, F.array().cast(t)) for c, t in none.items()})
    ranges = F.zip_with("starts", "ends", lambda s, e: F.struct(s.alias("start"), e.alias("end")))
    found = found.withColumns({"__r": ranges, "items": F.array_sort(F.array_distinct("items"))}).withColumn("n_hit", _merge_ranges("__r"))
    return found.select(
        *keep,
        "n_words",
        "n_hit",
        "items",
        F.size("items").cast("long").alias("n_items"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share[1] >= F.col("n_words") * share[0])).alias("contaminated"),
    )
