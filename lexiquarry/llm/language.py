"""Language identification by error-correcting output codes.

Every language has a codeword; each bit is predicted by a binary classifier over character n-grams (1 to 3 letters
within words, word ends marked): weights are the log odds of the n-gram among the languages with the bit set against
those without, from counts over all training texts. A text's margin for a bit is the mean weight of its n-grams.
Decoding sums, over the bits, the logistic loss of each codeword at the margins, weighted by the bit's training
separation, and chooses the codeword of least loss. The score is that codeword's share in a soft minimum over all,
and a text whose two best codewords are close is flagged as ambiguous.

Cases: a null text, or one without a letter, is `und` with score 0; without any training text every text is `und`;
training rows with a null language or text teach nothing; repeated rows count as often as they stand. Texts are taken
whole, in training and in prediction. An input column named as a new one gives way.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiquarry.llm.common import append_by_text, quoted, slices

#: Hashed n-grams; pseudo-count of each; sharpness of the soft minimum; share of the runner-up that makes a text ambiguous.
FEATURES, PRIOR, SHARP, AMBIGUOUS = 1 << 16, 0.5, 8.0, 0.25


def signs() -> str:
    """What Python takes for a word character but no digit or line, and Unicode for no letter (category L), as ranges."""
    other, start = [], None
    for c in range(sys.maxunicode + 2):
        sign = c <= sys.maxunicode and chr(c).isalnum() and not chr(c).isdecimal() and unicodedata.category(chr(c))[0] != "L"
        if sign and start is None:
            start = c
        elif not sign and start is not None:
            other.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(other)


#: Runs of letters in any text, in one without numeric signs, and in ASCII; the simpler a pattern, the faster.
LETTERS, PLAIN, ASCII = re.compile(rf"[^\W\d_{signs()}]+"), re.compile(r"[^\W\d_]+"), re.compile("[a-z]+")
SIGN = re.compile(f"[{signs()}]")


#: Words whose n-grams are held at a time.
WORDS = 20_000


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features, index of the word) of words in lower case: their n-grams of 1 to 3 letters with the words' ends, word by word."""
    x = np.frombuffer("".join([f"\x01{w}\x02" for w in words]).encode("utf-32-le"), "<u4").astype(np.uint64)
    word = np.cumsum(x == 1) - 1
    one = np.flatnonzero(x > 2)
    two = np.flatnonzero(x != 2)
    three = two[x[two + 1] != 2]
    h = np.concatenate([x[one], x[two] * np.uint64(0x10001) + x[two + 1] + np.uint64(7), (x[three] * np.uint64(0x1000193) + x[three + 1]) * np.uint64(0x10001) + x[three + 2] + np.uint64(11)])
    at = np.concatenate([word[one], word[two], word[three]])
    order = np.argsort(at, kind="stable")
    return ((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(FEATURES)).astype(np.int64)[order], at[order]


def words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    return (ASCII if text.isascii() else LETTERS if SIGN.search(text) else PLAIN).findall(text)


def codewords(n: int) -> np.ndarray:
    """A codeword of +1 and -1 for each of n languages: all ways to part few languages in two, else rows of a fixed random code."""
    if n <= 2:
        return np.array([[1], [-1]][:n])
    if n <= 7:
        return np.array([[1] + [1 if c >> i & 1 else -1 for i in range(n - 1)] for c in range(2 ** (n - 1) - 1)]).T
    # of several random codes the one whose nearest codewords are farthest apart, without bits that are the same for all
    rng, best, apart = np.random.default_rng(n), None, -1
    for _ in range(64):
        code = rng.choice([-1, 1], (n, 15 * int(np.ceil(np.log2(n)))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        near = int(((code.shape[1] - code @ code.T) // 2 + np.eye(n, dtype=int) * code.shape[1]).min())
        if near > apart:
            best, apart = code, near
    return best


class Model:
    """languages, their codewords, the bits' weights (features x bits) and the bits' own weights in decoding."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.code = codewords(len(languages))
        share = (counts + PRIOR) / (counts.sum(axis=1, keepdims=True) + PRIOR * FEATURES)
        bits = []
        for b in self.code.T:
            up = share[b > 0].mean(axis=0) if (b > 0).any() else np.full(FEATURES, 1 / FEATURES)
            down = share[b < 0].mean(axis=0) if (b < 0).any() else np.full(FEATURES, 1 / FEATURES)
            bits.append(np.log(up) - np.log(down))
        self.weights = np.array(bits).T.astype(np.float32)
        # how far apart the bit's two sides lie in training, by their mean margins
        means = share @ self.weights
        apart = np.array([(means[b > 0, i].mean() if (b > 0).any() else 0) - (means[b < 0, i].mean() if (b < 0).any() else 0) for i, b in enumerate(self.code.T)])
        self.trust = apart / max(apart.sum(), 1e-9)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, its share, runner-up's share) of rows of margins."""
        loss = (np.logaddexp(0, -SHARP * margins[:, None, :] * self.code[None]) * self.trust).sum(axis=2)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        top = share[np.arange(len(best)), best]
        share[np.arange(len(best)), best] = 0
        return best, top, share.max(axis=1, initial=0)


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Counts n-grams of all rows, each task its own first; what reaches the driver is a row of counts per language."""
    src = df.select(quoted(lang_col).cast("string").alias("lang"), quoted(text_col).cast("string").alias("text")).where("lang is not null and text is not null")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lo, hi in slices(b.column(1)):
                by: dict[str, dict[str, int]] = {}
                for lang, text in zip(b.column(0).slice(lo, hi - lo).to_pylist(), b.column(1).slice(lo, hi - lo).to_pylist()):
                    seen = by.setdefault(lang, {})
                    for w in words_of(text):
                        seen[w] = seen.get(w, 0) + 1
                for lang, seen in by.items():
                    own = total.setdefault(lang, np.zeros(FEATURES))
                    words, times = list(seen), np.array(list(seen.values()), float)
                    for k in range(0, len(words), WORDS):
                        g, word = grams(words[k : k + WORDS])
                        own += np.bincount(g, times[k + word], FEATURES)
        for lang, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(own[at])], names=["lang", "gram", "n"])

    counts = src.mapInArrow(count, "lang string, gram long, n double").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = counts.groupBy("lang").agg(F.collect_list(F.struct("gram", "n")).alias("c")).orderBy("lang").collect()
    if not rows:
        return None
    table = np.zeros((len(rows), FEATURES))
    for i, r in enumerate(rows):
        table[i, [c["gram"] for c in r["c"]]] = [c["n"] for c in r["c"]]
    return Model([r["lang"] for r in rows], table)


def identify(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """df and lang_pred, score (0 to 1) and ambiguous."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value

        def work(texts):
            if not m:
                return ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
            number: dict[str, int] = {}
            found = [[number.setdefault(w, len(number)) for w in words_of(t)] for t in texts]
            words = list(number)
            sums, sizes = np.zeros((len(words), m.code.shape[1]), np.float32), np.zeros(len(words))
            for k in range(0, len(words), WORDS):
                g, word = grams(words[k : k + WORDS])
                size = np.bincount(word)
                sizes[k : k + len(size)] = size
                sums[k : k + len(size)] = np.add.reduceat(m.weights[g], np.cumsum(size) - size, axis=0)
            margins = np.zeros((len(texts), m.code.shape[1]))
            for i, ids in enumerate(found):
                if ids:
                    margins[i] = sums[ids].sum(axis=0, dtype=np.float64) / sizes[ids].sum()
            best, top, second = m.decode(margins)
            full = np.array([bool(w) for w in found], bool)
            return [m.languages[b] if f else "und" for b, f in zip(best, full)], np.where(full, top, 0.0), (second > AMBIGUOUS) & full

        return work

    return append_by_text(df, text_col, fields, make)
