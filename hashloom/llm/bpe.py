"""Byte-level BPE encoding and decoding by a pair occurrence index.

Texts are cut into pre-tokens by the usual byte-level pattern.  The distinct pre-tokens
of a stretch of a partition are merged together (see :mod:`hashloom.llm.merging`): each
pair is mapped to all its positions, active ranks are applied in ascending order, and
only the lists beside a merge are updated.  Added special tokens inside a text are taken
whole, as the tokenizers library does by default.

Memory: a batch is turned into Python strings a stretch of ``STRETCH`` bytes at a time, of
which only the numbers of the pre-tokens stay; a text longer than that is a stretch of its
own.  Pre-tokens seen before are kept, up to ``MEMO`` and those of one stretch.

Defined cases: null and empty texts have no tokens and decode to the empty text; an empty
table gives none; very long texts are encoded whole; null ids and repeated rows give a row
each, and equal texts equal ids; other columns pass through, but columns named as results
are replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hashloom.llm.merging import Pairs, merge_one, merge_words
from hashloom.llm.shared import released, stretches

LONG, AT_ONCE, MEMO, STRETCH = 4096, 1 << 21, 150_000, 4 << 20
#: The Unicode White_Space property.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _ranges(points: list[int]) -> str:
    """Sorted code points as the inside of a regex class."""
    cuts = [k for k in range(1, len(points)) if points[k] != points[k - 1] + 1]
    return "".join(f"\\U{points[i]:08x}-\\U{points[j - 1]:08x}" for i, j in zip([0, *cuts], [*cuts, len(points)], strict=True))


@cache
def classes() -> tuple[str, str]:
    """Letters and numbers as the tokenizers library sees them.  Python's and the regex
    library's tables are of other versions of Unicode; where those two differ, the
    library's own pre-tokenizer is asked."""
    import regex
    from tokenizers import pre_tokenizers

    cut = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    found = []
    for kind, one in (("L", "a"), ("N", "1")):
        theirs = regex.compile(rf"\p{{{kind}}}").match
        points = []
        for c in range(sys.maxunicode + 1):
            there = unicodedata.category(chr(c))[0] == kind
            if there != bool(theirs(chr(c))):
                there = len(cut(one + chr(c))) == 1
            if there:
                points.append(c)
        found.append(_ranges(points))
    return found[0], found[1]


@cache
def pattern(letters: str, numbers: str) -> re.Pattern:
    """Contractions, then letters, numbers, other signs (each with a space before it at
    most), then white space; in the standard library's engine, which is several times
    faster than a class looked up by property."""
    s = SPACES
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{s}{letters}{numbers}]+|[{s}]+(?![^{s}])|[{s}]+")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteModel:
    """Vocabulary and merges of a byte-level ``tokenizer.json``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        vocab, letters = j["model"]["vocab"], byte_letters()
        merges = [m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"]]
        self.parts = ([vocab[a] for a, _ in merges], [vocab[b] for _, b in merges], list(range(len(merges))), [vocab[a + b] for a, b in merges])
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.classes = classes()
        self.first = [0] * 256
        for i, b in self.bytes.items():
            if len(b) == 1 and i not in self.special.values():
                self.first[b[0]] = i


class Numbers(dict):
    """Words in the order in which they were first asked for, with their places."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Codec:
    """Encodes and decodes; one for each task."""

    def __init__(self, model: ByteModel):
        self.model, self.pairs, self.table = model, Pairs(*model.parts), None
        self.first = np.array(model.first, np.int32)
        self.find = pattern(*model.classes).findall
        self.bytes = [model.bytes.get(i, b"") for i in range(max(model.bytes) + 1)]
        self.split = re.compile("|".join(f"({re.escape(t)})" for t in sorted(model.special, key=len, reverse=True))) if model.special else None
        self.forget()

    def forget(self) -> None:
        self.memo = Numbers()
        self.flat = np.zeros(0, np.int32)
        self.lengths = np.zeros(0, np.int64)
        self.done = 0  # words that have their tokens
        self.special = {t: self.memo[f"\0special\0{t}"] for t in self.model.special}
        for i in self.model.special.values():
            self._add([(np.array([i], np.int32), np.array([1], np.int64))], 1)

    def _add(self, parts: list[tuple[np.ndarray, np.ndarray]], n: int) -> None:
        self.flat = np.concatenate((self.flat, *(p[0] for p in parts)))
        self.lengths = np.concatenate((self.lengths, *(p[1].astype(np.int64) for p in parts)))
        self.done += n

    def _merge(self, words: list[str]) -> None:
        """Tokens of new words, appended in their order."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        begin, parts = 0, []
        while begin < len(words):
            end, held = begin, 0
            while end < len(words) and (end == begin or held + len(data[end]) <= AT_ONCE):
                if len(data[end]) > LONG:
                    break
                held += len(data[end])
                end += 1
            if end > begin:
                lengths = np.fromiter(map(len, data[begin:end]), np.int64, end - begin)
                symbols = self.first[np.frombuffer(b"".join(data[begin:end]), np.uint8)]
                parts.append(merge_words(symbols, lengths, self.pairs))
                begin = end
            if begin < len(words) and len(data[begin]) > LONG:
                if self.table is None:
                    left, right, rank, new = self.model.parts
                    self.table = dict(zip(zip(left, right, strict=True), zip(rank, new, strict=True), strict=True))
                ids = merge_one(self.first[np.frombuffer(data[begin], np.uint8)].tolist(), self.table)
                parts.append((np.array(ids, np.int32), np.array([len(ids)])))
                begin += 1
        if parts:
            self._add(parts, len(words))

    def places(self, text: str) -> np.ndarray:
        """The numbers of the text's pre-tokens; a new one gets the next number."""
        find, number = self.find, self.memo.__getitem__
        if self.split is None or not any(t in text for t in self.model.special):
            return np.fromiter(map(number, find(text)), np.int32)
        out = []
        for part in self.split.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += map(number, find(part))
        return np.array(out, np.int32)

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text; all texts are cut before the first is given out."""
        if len(self.memo) > MEMO:
            self.forget()
        cut = [self.places(t) for t in texts]
        self._merge(list(islice(self.memo, self.done, None)))
        begins = np.cumsum(self.lengths) - self.lengths
        for at in cut:
            n = self.lengths[at]
            ends = np.cumsum(n)
            yield self.flat[np.repeat(begins[at] - (ends - n), n) + np.arange(ends[-1] if len(at) else 0)]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _run(model: ByteModel, text_col: str, with_ids: bool):
    def run(batches):
        import pyarrow as pa

        codec = Codec(model)
        for batch in batches:
            for part in stretches(batch, text_col, STRETCH):
                n, ids_sha, text_sha, all_ids = [], [], [], []
                for ids in codec.encode(t.as_py() or "" for t in part.column(text_col)):
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    text_sha.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
                    if with_ids:
                        all_ids.append(ids)
                names = [c for c in batch.schema.names if c != text_col]
                cols = [part.column(c) for c in names] + [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                names += ["n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def encode_decode(docs: DataFrame, model_path: str, text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``docs`` without the text, plus n_tokens, ids_sha256 (ids as little-endian unsigned
    32-bit integers), decoded_sha256 (the decoded text in UTF-8), and the ids if asked for."""
    model = ByteModel(model_path)
    docs = docs.drop("n_tokens", "ids_sha256", "decoded_sha256", "ids")
    schema = docs.drop(text_col).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    return docs.mapInArrow(released(_run(model, text_col, with_ids)), schema)


def decode_ids(ids: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``ids`` plus the decoded text; null ids decode to null."""
    model = ByteModel(model_path)
    schema = ids.drop(text_col).schema.add(text_col, "string")

    def run(batches):
        import pyarrow as pa

        codec = Codec(model)
        for batch in batches:
            texts = [None if x is None else codec.decode(np.array(x, np.int64)) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_col])

    return ids.drop(text_col).mapInArrow(run, schema)
