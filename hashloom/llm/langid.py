"""Language identification by a linear-chain conditional random field over words.

A word is a run of letters (anything but ASCII signs, digits and spaces), in lower case.
Its features are hashed byte n-grams of 2 to 5 with the word's edges, so that n-grams at
an edge are its affixes, and its entry in a lexicon learned from the training texts.
Scores of features and of transitions between languages are learned together by gradient
steps on the likelihood of label sequences.  Training sequences are spliced from
stretches of texts of different languages, which is what code-switched text is, so
transitions learn how long a language lasts.

A text's words get their marginals by exact forward-backward over the whole text; long
chains are cut into chunks whose transfer matrices are multiplied first, so that all
chunks of a batch advance together and the result is that of the plain recursion.  A text
has the language of the greatest mean marginal, and that mean is its score.

The model is fitted on a bounded sample: of each language the ``per_lang`` rows of
smallest hash of the id, and of each at most ``stretch`` code points from a place that
this hash gives.  So neither its rows nor its bytes depend on the input.  One scan counts the rows
of each language, one takes the sample.

Defined cases: null text, or text without a letter, is ``und`` with score 0; so is every
text if nothing is labelled; an empty table gives none; among equal marginals the first
language in order of name wins; null ids and repeated rows give a row each, equal texts
equal results; a very long text is labelled whole, in chunks; other columns pass through,
but columns named as results are replaced.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashloom.llm.shared import plus, released, stretches, word_hashes

BITS, GRAMS, CHUNK = 16, (2, 3, 4, 5), 32
UND = "und"
#: ASCII letters and all bytes beyond ASCII are word bytes.
_WORD = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_bytes(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_WORD).split()


def has_letter(col: Column) -> Column:
    return F.coalesce(col.rlike(r"\p{L}"), F.lit(False))


def features(words: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashed n-grams of every position (0 where it would run past the word), the position
    at which each word begins, and the hash of each word."""
    buf = b" " + b" ".join(words) + b" "
    raw = np.frombuffer(buf + b"\0" * 8, np.uint8)
    n = len(buf) - 1
    spaces = np.flatnonzero(raw[: n + 1] == 32)
    begins, ends = spaces[:-1], spaces[1:]
    room = np.repeat(ends, ends - begins) - np.arange(n)  # bytes up to the closing space
    byte = raw.astype(np.uint32)
    grams, code = [], byte[:n].copy()
    for k in range(2, max(GRAMS) + 1):
        code = code * np.uint32(0x01000193) + byte[k - 1 : n + k - 1]
        if k in GRAMS:
            h = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * k)
            h = (h >> np.uint32(32 - BITS)) | np.uint32(1)
            grams.append(np.where(room >= k - 1, h, np.uint32(0)))
    return grams, begins, word_hashes(buf, begins + 1, ends)


class Crf:
    def __init__(self, langs: list[str]):
        size = len(langs)
        self.langs = langs
        self.grams = np.zeros((1 << BITS, size), np.float32)
        self.lexicon = np.zeros(0, np.uint64)
        self.words = np.zeros((1, size), np.float32)  # the last row is for words outside
        self.steps = np.zeros((size, size), np.float32)

    def entries(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == hashes, at, len(self.lexicon))

    def scores(self, grams, begins, hashes) -> np.ndarray:
        each = self.grams[grams[0]]
        for g in grams[1:]:
            each += self.grams[g]
        return np.add.reduceat(each, begins, axis=0) + self.words[self.entries(hashes)]

    def marginals(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Forward-backward over chains of the given lengths (each at least 1)."""
        size = scores.shape[1]
        trans = np.exp(self.steps - self.steps.max()).astype(np.float64)
        emit = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64) + 1e-30
        pieces = -(-lengths // CHUNK)
        first = np.cumsum(pieces) - pieces  # each chain's first chunk
        chain = np.repeat(np.arange(len(lengths)), pieces)
        within = np.arange(len(chain)) - first[chain]
        start = (np.cumsum(lengths) - lengths)[chain] + within * CHUNK
        length = np.minimum(CHUNK, lengths[chain] - within * CHUNK)
        order = np.argsort(-length, kind="stable")  # full chunks first: a step takes a prefix
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        start, length = start[order], length[order]
        live = [int(np.searchsorted(-length, -j, "left")) for j in range(CHUNK)]  # longer than j
        # 1. The transfer matrix of every chunk.
        move = np.tile(np.eye(size), (len(start), 1, 1))
        for j in range(CHUNK):
            k = live[j]
            if not k:
                break
            step = (move[:k].reshape(-1, size) @ trans).reshape(k, size, size) * emit[start[:k] + j][:, None, :]
            move[:k] = step / step.sum(axis=(1, 2), keepdims=True)
        # 2. What enters each chunk from either side, chunk by chunk over all chains.
        ahead = np.full((len(start), size), 1.0 / size)
        behind = np.full((len(start), size), 1.0)
        for r in range(1, int(pieces.max(initial=1))):
            now = place[(first + r)[pieces > r]]
            before = place[(first + r - 1)[pieces > r]]
            v = np.einsum("ni,nij->nj", ahead[before], move[before])
            ahead[now] = v / v.sum(axis=1, keepdims=True)
        for r in range(int(pieces.max(initial=1)) - 1, 0, -1):
            now = place[(first + r)[pieces > r]]
            before = place[(first + r - 1)[pieces > r]]
            v = np.einsum("nij,nj->ni", move[now], behind[now])
            behind[before] = v / v.sum(axis=1, keepdims=True)
        # 3. Every word's marginal inside its chunk.
        out = np.empty(scores.shape, np.float64)
        state = ahead
        for j in range(CHUNK):
            k = live[j]
            if not k:
                break
            v = (state[:k] @ trans) * emit[start[:k] + j]
            state = v / v.sum(axis=1, keepdims=True)
            out[start[:k] + j] = state
        state = behind.copy()
        for j in range(CHUNK - 1, -1, -1):
            k = live[j]
            if not k:
                continue
            at = start[:k] + j
            g = out[at] * state[:k]
            out[at] = g / g.sum(axis=1, keepdims=True)
            v = (emit[at] * state[:k]) @ trans.T
            state[:k] = v / v.sum(axis=1, keepdims=True)
        return out

    def label(self, texts: list[list[bytes]]) -> list[tuple[str, float, int, np.ndarray]]:
        """(language, score, switches, marginals) of texts given as words, none of them empty."""
        lengths = np.array([len(w) for w in texts], np.int64)
        m = self.marginals(self.scores(*features([x for w in texts for x in w])), lengths)
        begins = np.cumsum(lengths) - lengths
        means = np.add.reduceat(m, begins, axis=0) / lengths[:, None]
        best = means.round(12).argmax(axis=1)
        top = m.argmax(axis=1)
        change = np.r_[0, (top[1:] != top[:-1]).astype(np.int64)]
        change[begins] = 0
        switches = np.add.reduceat(change, begins)
        return [(self.langs[b], float(min(1.0, means[i, b])), int(switches[i]), m[s : s + k]) for i, (b, s, k) in enumerate(zip(best.tolist(), begins.tolist(), lengths.tolist(), strict=True))]


def train(rows: list[tuple[str, str]], epochs: int = 3, length: int = 64, batch: int = 256, rate: float = 0.2, lexicon: int = 4000, seed: int = 7) -> Crf | None:
    """Fits the field on (text, language) rows; None if no row has a word."""
    texts = [(w, lang) for text, lang in rows if (w := word_bytes(text))]
    langs = sorted({lang for _, lang in texts})
    if not langs:
        return None
    crf = Crf(langs)
    rng = np.random.default_rng(seed)
    # Stretches of texts, spliced at random.
    cuts = []
    for words, lang in texts:
        at = 0
        while at < len(words):
            k = int(rng.integers(4, 33))
            cuts.append((words[at : at + k], langs.index(lang)))
            at += k
    rng.shuffle(cuts)
    words = [w for ws, _ in cuts for w in ws]
    truth = np.repeat([y for _, y in cuts], [len(ws) for ws, _ in cuts])
    seen = Counter(words)
    common = [w for w, n in seen.most_common(lexicon) if n >= 3]
    grams, begins, hashes = features(words)
    if common:
        crf.lexicon = np.unique(features(common)[2])
    crf.words = np.zeros((len(crf.lexicon) + 1, len(langs)), np.float32)
    entry = crf.entries(hashes)
    n_pos = len(grams[0])
    word_of = np.repeat(np.arange(len(words)), np.diff(np.r_[begins, n_pos]))
    size = len(langs)
    squares = [np.full_like(x, 1e-3) for x in (crf.grams, crf.words, crf.steps)]
    span = length * batch
    for _ in range(epochs):
        for lo in range(0, len(words), span):
            hi = min(lo + span, len(words))
            a, b = begins[lo], begins[hi] if hi < len(words) else n_pos
            some = [g[a:b] for g in grams]
            each = sum(crf.grams[g] for g in some)
            scores = np.add.reduceat(each, begins[lo:hi] - a, axis=0) + crf.words[entry[lo:hi]]
            lengths = np.array([min(length, hi - x) for x in range(lo, hi, length)])
            miss = crf.marginals(scores, lengths).astype(np.float32)
            # Expected steps under the model against those of the sequence.
            y = truth[lo:hi]
            inner = np.ones(hi - lo, bool)
            inner[::length] = False
            t = np.flatnonzero(inner)
            step = _pairs(crf, scores, miss, t)
            np.add.at(step, (y[t - 1], y[t]), -1.0)
            miss[np.arange(hi - lo), y] -= 1.0
            spread = miss[word_of[a:b] - lo]
            grad = np.zeros_like(crf.grams)
            for g in some:
                for c in range(size):
                    grad[:, c] += np.bincount(g, weights=spread[:, c], minlength=1 << BITS)
            grad[0] = 0
            by_word = np.zeros_like(crf.words)
            for c in range(size):
                by_word[:, c] = np.bincount(entry[lo:hi], weights=miss[:, c], minlength=len(by_word))
            for x, d, s in zip((crf.grams, crf.words, crf.steps), (grad, by_word, step.astype(np.float32)), squares, strict=True):
                s += d * d
                x -= rate * d / np.sqrt(s)
    return crf


def _pairs(crf: Crf, scores: np.ndarray, marginals: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Expected number of each step between words t - 1 and t.  A pair's distribution is
    the transition matrix scaled by a vector on either side, and its sums are the words'
    marginals; that scaling is unique, and proportional fitting converges to it."""
    trans = np.exp(crf.steps - crf.steps.max()).astype(np.float64)
    left, right = marginals[t - 1].astype(np.float64) + 1e-12, marginals[t].astype(np.float64) + 1e-12
    joint = trans[None] * left[:, :, None] * right[:, None, :]
    for _ in range(8):
        joint *= (left / joint.sum(axis=2))[:, :, None]
        joint *= (right / joint.sum(axis=1))[:, None, :]
    return joint.sum(axis=0)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 200, stretch: int = 1 << 15) -> Crf | None:
    """Fits on at most ``per_lang`` rows of each language, those of smallest id hash, and
    ``stretch`` code points of each."""
    place = F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 33).alias("__place")
    spare = F.greatest(F.char_length(text_col) - stretch, F.lit(0)) + 1
    sample = F.substring(F.col(text_col), F.pmod(F.xxhash64(F.col(id_col), F.lit(1)), spare).cast("int") + 1, F.lit(stretch))
    rows = labelled.filter(F.col(lang_col).isNotNull() & has_letter(F.col(text_col))).select(F.col(lang_col).alias("__lang"), sample.alias("__text"), place)
    counts = sorted(tuple(r) for r in rows.groupBy("__lang").count().collect())
    if not counts:
        return None
    # What is sorted stays small however many rows there are: three times what is needed.
    bounds = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, int(min(1.0, 3 * per_lang / n) * 2**31))])
    order = Window.partitionBy("__lang").orderBy("__place", "__text")
    some = rows.filter(F.col("__place") < bounds[F.col("__lang")]).withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= per_lang)
    return train(sorted(((r["__text"], r["__lang"]) for r in some.collect()), key=lambda r: (r[1], r[0])))


def _run(crf: Crf | None, text_col: str, keep_text: bool, batch_bytes: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in stretches(batch, text_col, batch_bytes):
                texts = zip(part.column(text_col), part.column("__letter"), strict=True)
                got, some = [(UND, 0.0, 0)] * part.num_rows, []
                if crf is not None:
                    some = [(i, w) for i, (t, able) in enumerate(texts) if able.as_py() and (w := word_bytes(t.as_py()))]
                if some:
                    for (i, _), r in zip(some, crf.label([w for _, w in some]), strict=True):
                        got[i] = r[:3]
                names = [c for c in batch.schema.names if c != "__letter" and (keep_text or c != text_col)]
                cols = [part.column(c) for c in names]
                for k, kind in enumerate((pa.string(), pa.float64(), pa.int64())):
                    cols.append(pa.array([g[k] for g in got], kind))
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "lang_pred", "score", "n_switches"])

    return run


def identify(docs: DataFrame, crf: Crf | None, text_col: str = "text", keep_text: bool = False, batch_bytes: int = 1 << 19) -> DataFrame:
    """``docs`` (without the text unless it is to be kept) plus lang_pred, score and
    n_switches, the number of words whose language is not that of the word before."""
    docs = docs.drop("lang_pred", "score", "n_switches")
    out = docs if keep_text else docs.drop(text_col)
    schema = plus(out, "lang_pred string, score double, n_switches long")
    return docs.withColumn("__letter", has_letter(F.col(text_col))).mapInArrow(released(_run(crf, text_col, keep_text, batch_bytes)), schema)


def label_words(text: str, crf: Crf) -> list[tuple[str, str, float]]:
    """(word, language, marginal) of each word of a text."""
    words = word_bytes(text)
    if not words:
        return []
    m = crf.label([words])[0][3]
    return [(w.decode("utf-8", "replace"), crf.langs[int(p.argmax())], float(p.max())) for w, p in zip(words, m, strict=True)]


def held_out(id_col: str = "doc_id") -> Column:
    """A quarter of the rows, by the CRC-32 of the id as text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


__all__ = ["Crf", "fit", "held_out", "identify", "label_words", "train"]
