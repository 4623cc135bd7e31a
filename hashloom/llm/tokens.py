"""Token counts with a whole-token shortcut (unigram-free sentencepiece BPE models).

Offline, on the driver, every vocabulary string is encoded alone; those that end as one
token are proven whole.  Executors cut texts into pre-tokens (a run of spaces and what
follows it, which no piece of the vocabulary may span; that is checked as well), count a
proven pre-token as one token without merging it, and merge only the distinct rest, all
of a batch at once.

Defined cases: null and empty texts have no bytes and no tokens; an empty table gives
none; very long texts are counted whole; null ids and repeated rows give a row each; other
columns pass through, but columns named as results are replaced.  A text's count depends on
nothing else, so any order of rows and any repetition gives the same.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.llm.merging import NONE, Pairs, merge_one, merge_words
from hashloom.llm.shared import released, stretches

MARK = "▁"  # stands for a space
#: Words longer than this go through the heap; others through the index, so many symbols at once.
LONG, AT_ONCE, MEMO, STRETCH = 4096, 1 << 21, 200_000, 2 << 20
_PRETOKEN = re.compile(f"{MARK}+[^{MARK}]*")


class PieceModel:
    """What a BPE sentencepiece model with byte fallback and identity normalization says."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece spans the beginning of a word; words can't be counted alone")
        # Letters with several code points, wide forms, signs that fold, runs of spaces, tabs:
        # a model that changes any of them doesn't normalize by identity.
        probe = "ﬁ Å A\u030a ① Ａ  \t x\u200b…　½ "
        if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("the model normalizes texts; words can't be cut before that")
        score = {p: sp.get_score(i) for p, i in pieces.items()}
        ranks = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        left, right, rank, new = [], [], [], []
        for p, i in pieces.items():
            for k in range(1, len(p)):
                if p[:k] in pieces and p[k:] in pieces:
                    left.append(pieces[p[:k]])
                    right.append(pieces[p[k:]])
                    rank.append(ranks[score[p]])
                    new.append(i)
        self.parts = (left, right, rank, new)
        self.chars = {p: i for p, i in pieces.items() if len(p) == 1}
        self.whole = frozenset()
        words = [p for p in pieces if p[0] == MARK]
        counts = Merger(self).counts(words)
        self.whole = frozenset(w for w, c in zip(words, counts, strict=True) if c == 1)


class Merger:
    """Counts the tokens of words; one for each task."""

    def __init__(self, model: PieceModel):
        self.pairs = Pairs(*model.parts)
        self.table = None
        self.model = model
        # Code point -> symbol; -1-k for an unknown character of k UTF-8 bytes.
        codes = np.arange(0x110000, dtype=np.int64)
        self.symbol = np.select([codes < 0x80, codes < 0x800, codes < 0x10000], [-2, -3, -4], -5).astype(np.int32)
        for c, i in model.chars.items():
            self.symbol[ord(c)] = i

    def _long(self, word: str) -> int:
        if self.table is None:
            left, right, rank, new = self.model.parts
            self.table = dict(zip(zip(left, right, strict=True), zip(rank, new, strict=True), strict=True))
        first = self.symbol[np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)]
        extra = int((-1 - first[first < 0] - 1).sum())
        # merge_one marks what is gone by -1; unknown characters get a symbol beyond all.
        return len(merge_one(np.where(first < 0, 2**30, first).tolist(), self.table)) + extra

    def counts(self, words: list[str]) -> list[int]:
        out = np.zeros(len(words), np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(lengths > LONG).tolist():
            out[i] = self._long(words[i])
        short = np.flatnonzero(lengths <= LONG)
        begin = 0
        total = np.cumsum(lengths[short])
        while begin < len(short):
            base = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, base + AT_ONCE, "right")))
            some = short[begin:end]
            text = "".join([words[i] for i in some.tolist()])
            first = self.symbol[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
            unknown = first < 0
            word = np.repeat(np.arange(len(some)), lengths[some])
            extra = np.bincount(word[unknown], weights=-2 - first[unknown], minlength=len(some)).astype(np.int64)
            _, n = merge_words(np.where(unknown, 2**30, first), lengths[some], self.pairs)
            out[some] = n + extra
            begin = end
        return out.tolist()


def pretokens(text: str) -> list[str]:
    return _PRETOKEN.findall(MARK + text.replace(" ", MARK)) if text else []


class Counts(dict):
    """Tokens of the words counted so far.  A word that isn't there yet is put in ``fresh``
    and stands as 0; its occurrences in a text are told apart by the caller."""

    def __init__(self, whole: frozenset[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.fresh: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        return -1 - self.fresh.setdefault(word, len(self.fresh))


def _run(model: PieceModel, text_col: str):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        merger, known = Merger(model), Counts(model.whole)
        for batch in batches:
            for part in stretches(batch, text_col, STRETCH):
                if len(known) > MEMO + len(model.whole):
                    known = Counts(model.whole)
                get, cut, counts = known.__getitem__, [], []
                for t in part.column(text_col):
                    # Counts of the words proven whole or met before; of others -1 - their number.
                    n = np.fromiter(map(get, pretokens(t.as_py() or "")), np.int32)
                    new = n < 0
                    counts.append(int(n[~new].sum(dtype=np.int64)))
                    cut.append(-1 - n[new])
                fresh = list(known.fresh)
                got = merger.counts(fresh)
                known.update(zip(fresh, got, strict=True))
                known.fresh = {}
                of = np.array(got, np.int64)
                counts = [c + int(of[at].sum()) if len(at) else c for c, at in zip(counts, cut, strict=True)]
                sizes = pc.fill_null(pc.binary_length(part.column(text_col)), 0).cast(pa.int64())
                names = [c for c in batch.schema.names if c != text_col]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), sizes, pa.array(counts, pa.int64())], names=[*names, "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, model_path: str, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` without the text, plus n_bytes, n_tokens and over_limit."""
    model = PieceModel(model_path)
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    schema = docs.drop(text_col).schema.add("n_bytes", "long").add("n_tokens", "long")
    return docs.mapInArrow(released(_run(model, text_col)), schema).withColumn("over_limit", F.col("n_tokens") > limit)


__all__ = ["NONE", "PieceModel", "Merger", "count_tokens", "pretokens"]
