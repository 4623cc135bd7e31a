"""N-gram Jaccard join in size-banded tiles with hashed bitmap signatures.

Sets.  A document's set holds the 64-bit hashes of its distinct word shingles.  Documents
with equal sets are one class, and one of them, of smallest id, stands for it.

Tiles.  Shingles are put in one order for all documents, those found to be frequent last.
Two sets whose similarity reaches the threshold share a shingle among the first few of
each in that order (the prefix principle), and their sizes lie in the same or in adjacent
bands of a geometric scale; a tile is a prefix shingle and a band.  Frequencies only shape
the order, never the result: they are gathered by lossy counting, with a size bound.

Small tiles.  All pairs of a tile of up to ``SMALL`` sets are candidates.

Stars.  In each larger tile every member is compared with ``LEADERS`` leaders, in a few
rounds with different ones; what links is one component.  In a group of near copies this settles
nearly all, at a cost in proportion to its members.  What is left are pairs of one tile
and different components; large tiles are cut into chunks, and each pair of chunks is a
task's work.  It is done twice: by folded signatures, which only tells the members that have
a pair left, and by whole ones for these.

Bitmaps.  Every candidate is first compared by signatures: a bit for each hash modulo the
width, flipped by each member.  A differing bit needs a shingle that one set has alone, so
the count of differing bits bounds the overlap from above.  A signature is folded to an
eighth first; only pairs that the bound lets pass have the whole one shipped, and only those
that it lets pass again their sorted arrays, for the exact intersection.

Words are told apart by 64-bit hashes, and shingles by chained mixes of those; a collision
of two among n distinct shingles has a chance of about n^2 / 2^65, in the sense that no
text is built for it.

Passes over the texts: one for frequencies, one for everything about a set that isn't the
set itself, and one for the sets of the documents in candidates, at each of up to four
times that candidates are settled.

Defined cases: null and empty texts, and texts without words, have empty sets, link with
nothing and are their own components; a text of fewer words than a shingle is one shingle;
an empty table gives none; very long texts are taken whole; rows that repeat an id are one
document if their texts have equal sets (each row gets its result); rows of null id have a
null component and link nothing; other columns than id and text are left out.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashloom.llm.components import components
from hashloom.llm.shared import chained, forget, released, spread_join, stretches, utf8, word_hashes, written

FREQUENT = 48  # documents from which a shingle goes to the end of the order
FREQUENT_MAX = 1 << 19  # at most so many of them, the most frequent ones
FILTER_BITS = range(16, 27)  # bits of the place of an id in a filter, by the number of ids
STRETCH = 1 << 20
CHUNK = 512
SMALL = 16
ROUNDS, LEADERS = 2, 6
MEMBER = ("h", "band", "i", "j", "own", "rep", "comp", "n", "chunk")  # of a pair of chunks of a tile


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    cut = [t.lower().split() for t in texts]  # ASCII only, on bytes
    counts = [len(w) for w in cut]
    buf = b" ".join([b" ".join(w) for w in cut if w]) + b" "
    del cut
    ends = np.flatnonzero(np.frombuffer(buf, np.uint8) == 32) if sum(counts) else np.zeros(0, np.int64)
    hashes = word_hashes(buf, np.r_[0, ends[:-1] + 1] if len(ends) else ends, ends)
    out, at = [], 0
    for n in counts:
        out.append(np.unique(chained(hashes[at : at + n], min(words, n))) if n else np.zeros(0, np.uint64))
        at += n
    return out


def _sets_of(batch, words: int):
    """(ids, sets) of a batch of (doc_id, text) in stretches of bounded size."""
    for part in stretches(batch, "text", STRETCH):
        texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column("text")]
        yield part.column("doc_id").to_pylist(), shingle_sets(texts, words)


def _repeated(words: int, at_once: int = 1 << 21):
    """Lossy counting: shingles that several documents of a stretch share, with counts."""

    def run(batches):
        held, n = [], 0

        def counted():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            keep = c > 1
            return pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(c[keep].astype(np.int64))], names=["h", "n"])

        for batch in batches:
            for _, sets in _sets_of(batch, words):
                held += sets
                n += sum(map(len, sets))
                if n >= at_once:
                    yield counted()
                    held, n = [], 0
        if held:
            yield counted()

    return run


def frequent_shingles(rows: DataFrame, words: int) -> np.ndarray:
    """Sorted hashes of the most frequent shingles, at most FREQUENT_MAX (4 MB): whole
    classes of frequency, from the top."""
    counts = written(rows.mapInArrow(released(_repeated(words)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT), "frequent")
    by_size = counts.groupBy(F.floor(F.log2("n")).alias("size")).count().orderBy(F.desc("size")).collect()
    total, least = 0, None
    for size, n in by_size:
        if total + n > FREQUENT_MAX:
            break
        total, least = total + n, size
    if least is None:
        return np.zeros(0, np.uint64)
    found = counts.filter(F.col("n") >= 2**least).select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64)
    forget(counts)
    return np.sort(found)


def _key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _described(words: int, share: tuple[int, int], frequent):
    """Every row's set size, and of sets that aren't empty key, prefix and signature."""

    def run(batches):
        often = frequent.value
        for batch in batches:
            for ids, sets in _sets_of(batch, words):
                sizes, keys, prefixes, sigs, thin = [], [], [], [], []
                for s in sets:
                    n = len(s)
                    sizes.append(n)
                    keys.append(_key(s) if n else None)
                    sig = signature(s, width_of(n)) if n else None
                    sigs.append(sig.tobytes() if n else None)
                    thin.append(fold(sig, width_of(n) // 8).tobytes() if n else None)
                    k = n - -(-share[0] * n // share[1]) + 1
                    if n and len(often):
                        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                        is_often = often[at] == s
                        first = s[~is_often][:k]
                        s = np.concatenate((first, s[is_often][: k - len(first)])) if len(first) < k else first
                    prefixes.append(s[:k].view(np.int64) if n else None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(sigs, pa.binary()), pa.array(thin, pa.binary())],
                    names=["doc_id", "n", "key", "prefix", "sig", "thin"],
                )

    return run


def _tiles(share: tuple[int, int]):
    """Of rows (h, rep, n) sorted by h: the pairs of small tiles as (a, b, null, null), and
    the rows of larger ones as (null, rep, h, n).  Tiles of one set have none."""

    def run(batches):
        held, large = None, None  # rows of the last tile while it is small; its h once it is not
        for batch in _with_end(batches):
            if batch is not None:
                h, rep, n = (batch.column(k).to_numpy() for k in range(3))
                if held is not None:
                    h, rep, n = (np.concatenate(x) for x in zip(held, (h, rep, n), strict=True))
            elif held is None:
                break
            else:
                h, rep, n = held
            if not len(h):
                continue
            cuts = np.flatnonzero(np.r_[True, h[1:] != h[:-1], True])
            size = np.diff(cuts)
            tile = np.repeat(np.arange(len(size)), size)
            big = size > SMALL
            if large is not None and h[0] == large:
                big[0] = True
            large = h[-1] if big[-1] else None
            done = len(h) if batch is None or big[-1] else int(cuts[-2])
            held = None if done == len(h) else (h[done:], rep[done:], n[done:])
            h, rep, n, tile = h[:done], rep[:done], n[:done], tile[:done]
            left, right = [], []
            small = ~big[tile]
            for d in range(1, SMALL):
                i = np.flatnonzero(small[:-d] & (tile[d:] == tile[:-d])) if done > d else []
                if not len(i):
                    break
                j = i + d
                fits = (np.minimum(n[i], n[j]) * share[1] >= np.maximum(n[i], n[j]) * share[0]) & (rep[i] != rep[j])
                left.append(np.minimum(rep[i], rep[j])[fits])
                right.append(np.maximum(rep[i], rep[j])[fits])
            if left:
                both = np.unique(np.stack((np.concatenate(left), np.concatenate(right)), axis=1), axis=0)
                none = pa.nulls(len(both), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), none, none], names=["a", "b", "h", "n"])
            at = np.flatnonzero(~small)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.array(rep[at]), pa.array(h[at]), pa.array(n[at])], names=["a", "b", "h", "n"])

    return run


def _with_end(batches):
    yield from batches
    yield None


def signature(s: np.ndarray, width: int) -> np.ndarray:
    """``width`` bits (a power of two, 64 at least), each flipped once for every hash that falls on it."""
    odd = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def width_of(n: int) -> int:
    """Eight bits or more for each hash: where few bits are hit twice the bound is near the
    true overlap, so of a cloud of near copies few pairs pass that don't link."""
    return 8 * max(64, 1 << (n - 1).bit_length())


def fold(sig: np.ndarray, width: int) -> np.ndarray:
    while len(sig) * 64 > width:
        sig = sig[: len(sig) // 2] ^ sig[len(sig) // 2 :]
    return sig


def _sets(words: int, wanted, bits: int):
    """(rep, set) of the documents whose id passes the filter."""

    def run(batches):
        for batch in batches:
            hit = _in_filter(batch.column("place"), wanted.value, bits)
            for ids, sets in _sets_of(batch.filter(pa.array(hit)), words):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "set"])

    return run


def _place(col: str):
    return F.shiftrightunsigned(F.xxhash64(col), 64 - FILTER_BITS[-1])


def _filter_of(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap that holds every id of the frame, some sixteen bits for each but 8 MB at
    most; what else it holds only costs time.  Combined on the executors."""
    bits = min(FILTER_BITS[-1], max(FILTER_BITS[0], ids.count().bit_length() + 4))
    at = ids.select(F.shiftright(_place("rep"), FILTER_BITS[-1] - bits).alias("p"))
    bit = F.expr("shiftleft(1L, cast(p % 64 as int))")
    words = at.select(F.shiftright("p", 6).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    return out, bits


def _wanted(pairs: DataFrame):
    """The filter of the ids of pairs (a, b), sent to all tasks, and its bits."""
    ids = written(pairs.select(F.col("a").alias("rep")).unionAll(pairs.select("b")).distinct(), "ids")
    wanted, bits = _filter_of(ids)
    forget(ids)
    return pairs.sparkSession.sparkContext.broadcast(wanted), bits


def _in_filter(places, wanted: np.ndarray, bits: int) -> np.ndarray:
    h = places.to_numpy().view(np.uint64) >> np.uint64(FILTER_BITS[-1] - bits)
    return ((wanted[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1)) == 1


def _passing(table: DataFrame, wanted, bits: int) -> DataFrame:
    """The rows whose rep passes the filter."""

    @F.arrow_udf(T.BooleanType())
    def passes(places: pa.Array) -> pa.Array:
        return pa.array(_in_filter(places, wanted.value, bits))

    return table.filter(passes(_place("rep")))


def linked(x: np.ndarray, y: np.ndarray, share: tuple[int, int]) -> bool:
    """Exact intersection of sorted arrays."""
    if len(x) > len(y):
        x, y = y, x
    if share[1] * len(x) < share[0] * len(y):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return share[1] * both >= share[0] * (len(x) + len(y) - both)


def _kept(batch, keep):
    return batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _slices(batches, rows: int = 512):
    """Batches in slices, so that no more of them is Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _bounded(share: tuple[int, int]):
    """Pairs whose bitmaps let them pass."""

    def run(batches):
        for batch in _slices(batches):
            c = {k: batch.column(k).to_pylist() for k in ("na", "nb", "siga", "sigb")}
            keep = []
            for na, nb, sa, sb in zip(*c.values(), strict=True):
                sa, sb = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                width = min(len(sa), len(sb)) * 64
                differ = int(np.bitwise_count(fold(sa, width) ^ fold(sb, width)).sum())
                most = (na + nb - differ) // 2
                keep.append(share[1] * most >= share[0] * (na + nb - most))
            yield _kept(batch, keep)

    return run


def _verify(share: tuple[int, int]):
    def run(batches):
        for batch in _slices(batches):
            sets = zip(batch.column("seta").to_pylist(), batch.column("setb").to_pylist(), strict=True)
            yield _kept(batch, [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), share) for x, y in sets])

    return run


def _runs(batches, key: int):
    """Column arrays of each run of equal values in the first ``key`` columns."""
    held = None
    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        new = np.zeros(len(cols[0]) - 1, bool)
        for k in range(key):
            new |= cols[k][1:] != cols[k][:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield [c[lo:hi] for c in cols]
        held = [c[cuts[-1] :] for c in cols]
    if held is not None:
        yield held


def _tile_pairs(share: tuple[int, int], members: bool = False):
    """Pairs of a tile, of different components, that the bitmap bound lets pass; or, of each
    pair of chunks, the ``members`` that are in such a pair."""

    def run(batches):
        found, n_found = [], 0

        def out():
            if members:
                return pa.RecordBatch.from_pydict(dict(zip(MEMBER, map(np.concatenate, zip(*found, strict=True)), strict=True)))
            both = np.unique(np.concatenate(found), axis=0)
            return pa.RecordBatch.from_pydict({"a": both[:, 0], "b": both[:, 1]})

        for h, band, i0, j0, own, rep, comp, n, sig, chunk in _runs(batches, 4):
            order = np.argsort(n, kind="stable")
            own, rep, comp, n, chunk = (x[order] for x in (own, rep, comp, n, chunk))
            sigs = [np.frombuffer(sig[i], np.uint64) for i in order.tolist()]
            width = min(map(len, sigs)) * 64
            bits = np.stack([fold(s, width) for s in sigs])
            across = i0[0] != j0[0]
            paired = np.zeros(len(n), bool)
            for i in range(len(n) - 1):
                hi = int(np.searchsorted(n, share[1] * n[i] // share[0], "right"))
                j = np.arange(i + 1, hi)
                ok = (comp[j] != comp[i]) & (own[j] | own[i])
                if across:
                    ok &= chunk[j] != chunk[i]
                j = j[ok]
                if not len(j):
                    continue
                differ = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1).astype(np.int64)
                most = (n[i] + n[j] - differ) // 2
                j = j[share[1] * most >= share[0] * (n[i] + n[j] - most)]
                if members:
                    paired[j] = True
                    paired[i] |= len(j) > 0
                elif len(j):
                    found.append(np.stack((np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])), axis=1))
                    n_found += len(j)
            if paired.any():
                k = int(paired.sum())
                found.append([*(x[:k] for x in (h, band, i0, j0)), *(x[paired] for x in (own, rep, comp, n, chunk))])
                n_found += k
            if n_found > 1 << 18:
                yield out()
                found, n_found = [], 0
        if found:
            yield out()

    return run


def _sides(pairs: DataFrame, table: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    side = lambda s: table.select(*(F.col(c).alias(f"{c}{s}") for c in columns), F.col("rep").alias(s))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", *(f"{c}{s}" for c in columns for s in "ab"))


def _settle(pairs: DataFrame, sigs: DataFrame, placed: DataFrame, words: int, share: tuple[int, int]) -> DataFrame | None:
    """The pairs (a, b) that link; None if there are none."""
    thin = sigs.select("rep", "n", F.col("thin").alias("sig"))
    near = written(_sides(pairs, thin, ("n", "sig")).mapInArrow(released(_bounded(share)), "a long, b long"), "near")
    # Of the whole signatures only those of pairs that are left travel.
    wanted, bits = _wanted(near)
    # They are written first: else a task that compares them holds workers that filter as well.
    passed = written(_passing(sigs, wanted, bits), "passed")
    may = written(_sides(near, passed, ("n", "sig")).mapInArrow(released(_bounded(share)), "a long, b long"), "may")
    forget(passed)
    forget(near)
    wanted.unpersist()
    links = None
    if may.limit(1).count():
        wanted, bits = _wanted(may)
        sets = written(placed.mapInArrow(released(_sets(words, wanted, bits)), "rep long, set binary"), "sets")
        links = written(_sides(may, sets, ("set",)).mapInArrow(released(_verify(share)), "a long, b long"), "links")
        forget(sets)
        wanted.unpersist()
    forget(may)
    return links if links is not None and links.limit(1).count() else None


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable by links) and
    class_id (the smallest id of equal set)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    placed = rows.filter("doc_id is not null").withColumn("place", _place("doc_id"))
    frequent = rows.sparkSession.sparkContext.broadcast(frequent_shingles(rows, words))
    told = written(rows.mapInArrow(released(_described(words, share, frequent)), "doc_id long, n long, key binary, prefix array<long>, sig binary, thin binary"), "described")
    some = told.filter("key is not null and doc_id is not null")
    # Equal sets have equal prefixes and signatures, so any will do.
    any_of = [F.first(c).alias(c) for c in ("n", "prefix", "sig", "thin")]
    stand = written(some.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"), *any_of), "sets")
    # Of each row, what its result needs; the rest of it is in the sets.
    described, told = told, written(told.select("doc_id", "n", "key"), "rows")
    forget(described)
    sigs = stand.select("rep", "n", "sig", "thin")
    by_shingle = stand.select(F.explode("prefix").alias("h"), "rep", "n").repartition("h").sortWithinPartitions("h")
    dealt = written(by_shingle.mapInArrow(released(_tiles(share)), "a long, b long, h long, n long"), "tiles")
    links = [_settle(dealt.filter("h is null").select("a", "b").distinct(), sigs, placed, words, share)]
    band = F.floor(F.log("n") / math.log(share[1] / share[0]) + 1e-9).cast("int")
    large = dealt.filter("h is not null").select("h", F.col("b").alias("rep"), "n", band.alias("band"))
    if large.limit(1).count():
        _large(large, links, sigs, placed, words, share)
    forget(dealt)
    comp = _linked_components(links)
    for t in links:
        if t is not None:
            forget(t)
    classes = stand.select("key", "rep", "rows")
    if comp is not None:
        classes = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    else:
        classes = classes.withColumn("component", F.lit(None).cast("long"))
    # A class of copies may hold a third of all rows.
    out = spread_join(told.select("doc_id", "n", "key"), written(classes, "classes"), ["key"], "rows", ["doc_id", "n"])
    own = F.when(F.col("doc_id").isNull(), None)
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        own.otherwise(F.coalesce("component", "rep", "doc_id")).alias("component_id"),
        own.otherwise(F.coalesce("rep", "doc_id")).alias("class_id"),
    )


def _linked_components(links: list[DataFrame | None]) -> DataFrame | None:
    found = [x for x in links if x is not None]
    return components(reduce(DataFrame.unionAll, found)) if found else None


def _large(tiles: DataFrame, links: list[DataFrame | None], sigs: DataFrame, placed: DataFrame, words: int, share: tuple[int, int]) -> None:
    """Appends the links that tiles of more than SMALL sets add."""

    def with_components() -> DataFrame:
        comp = _linked_components(links)
        if comp is None:
            return tiles.withColumn("comp", F.col("rep"))
        return tiles.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")

    now = written(with_components(), "large")
    for k in range(ROUNDS):
        order = [F.min(F.struct(F.xxhash64("rep", F.lit(k * LEADERS + i)).alias("o"), F.col("rep").alias("leader"), F.col("comp").alias("lcomp"))).alias(f"l{i}") for i in range(LEADERS)]
        lead = now.groupBy("h", "band").agg(*order)
        each = now.join(lead, ["h", "band"]).select("rep", "comp", F.posexplode(F.array(*[f"l{i}" for i in range(LEADERS)])).alias("i", "l"))
        told_of = each.filter("comp <> l.lcomp").groupBy("rep", "i", F.col("l.leader").alias("leader")).count()
        best = told_of.groupBy("rep", "i").agg(F.max(F.struct("count", "leader")).alias("m"))
        new = _settle(best.select(F.least("rep", "m.leader").alias("a"), F.greatest("rep", "m.leader").alias("b")).distinct(), sigs, placed, words, share)
        if new is not None:
            links.append(new)
            before, now = now, written(with_components(), "large")
            forget(before)
    twice = F.array(F.struct("band", F.lit(True).alias("own")), F.struct((F.col("band") + 1).alias("band"), F.lit(False).alias("own")))
    places = now.select("h", F.explode(twice).alias("p"), "rep", "comp", "n").select("h", "p.band", "p.own", "rep", "comp", "n")
    mixed = places.groupBy("h", "band").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.max("own").alias("home")).filter("c1 <> c2 and home")
    mixed = mixed.select("h", "band", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks"))
    spread = lambda df: df.select(*MEMBER[:-1], "sig", "chunk").repartition("h", "band", "i", "j").sortWithinPartitions("h", "band", "i", "j")
    chunk = lambda df: df.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    i, j = F.least("chunk", "other"), F.greatest("chunk", "other")
    left = chunk(places.join(mixed, ["h", "band"]).join(sigs.select("rep", F.col("thin").alias("sig")), "rep"))
    dealt = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns({"i": i, "j": j})
    paired = written(spread(dealt).mapInArrow(released(_tile_pairs(share, members=True)), "h long, band int, i int, j int, own boolean, rep long, comp long, n long, chunk int"), "paired")
    wanted, bits = _wanted(paired.select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    whole = paired.join(_passing(sigs.select("rep", "sig"), wanted, bits), "rep")
    pairs = written(spread(whole).mapInArrow(released(_tile_pairs(share)), "a long, b long").distinct(), "pairs")
    wanted.unpersist()
    forget(paired)
    links.append(_settle(pairs, sigs, placed, words, share))
    for t in (pairs, now):
        forget(t)
