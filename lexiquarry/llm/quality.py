"""Quality classifier: a convolutional network over the bytes of whole texts, in numpy.

FILTERS learned filters look at WIDTH bytes every STRIDE bytes. Their rectified outputs are max-pooled within chunks of
CHUNK places that overlap by OVERLAP and cover the whole text; the chunks' maxima are combined, by their mean and
their maximum over the text, into one probability by a logistic unit. Training (Adam on the driver, fixed seed and
order) uses at most SAMPLE labelled texts of at most SAMPLE_BYTES together, those whose hashed ids are least: both bounds
are parameters of `train`. Texts from where the bytes are used up on teach nothing.

Cases: a null text is an empty one, which is scored like any other; rows without a label or text teach nothing; an id
with several labels has the highest; without training rows every score is 0.5; an input column named as a new one
gives way.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiquarry.llm.common import append_by_text, quoted

FILTERS, WIDTH, STRIDE = 16, 8, 4
#: Places (of STRIDE bytes) in a chunk, and those it shares with the next.
CHUNK, OVERLAP = 256, 16
SAMPLE, SAMPLE_BYTES, EPOCHS, BATCH, RATE, THRESHOLD = 4000, 64 << 20, 8, 32, 0.02, 0.3


def laid(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one behind the other, each with zeros up to whole places, and the number of places of each."""
    data = [(t or "").encode() for t in texts]
    places = np.array([max(1, -(-len(d) // STRIDE)) for d in data], np.int64)
    return np.frombuffer(b"".join(d + bytes(int(p) * STRIDE + WIDTH - STRIDE - len(d)) for d, p in zip(data, places)), np.uint8), places


def chunks(places: int) -> list[tuple[int, int]]:
    """The ranges of places of a text's chunks."""
    step = CHUNK - OVERLAP
    return [(s, min(s + CHUNK, places)) for s in range(0, max(1, places - OVERLAP), step)]


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.filters = rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.head = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.base = np.zeros(1, np.float32)
        self.pairs = None

    def convolved(self, data: np.ndarray, places: int) -> np.ndarray:
        """The filters' outputs at each place of one text."""
        if self.pairs is None:
            out = np.broadcast_to(self.bias, (places, FILTERS)).copy()
            for j in range(WIDTH):
                out += self.filters[j][data[j : j + places * STRIDE : STRIDE]]
            return out
        two = data[: (len(data) // 2) * 2].view("<u2")
        out = self.pairs[0][two[: 2 * places : 2]]
        for j in range(1, WIDTH // 2):
            out += self.pairs[j][two[j : j + 2 * places : 2]]
        return out

    def ready(self) -> Network:
        """With tables of byte pairs, for scoring: half the lookups."""
        f = self.filters
        pairs = [(f[2 * j][None, :, :] + f[2 * j + 1][:, None, :]).reshape(65536, FILTERS) for j in range(WIDTH // 2)]
        pairs[0] = pairs[0] + self.bias
        self.pairs = pairs
        return self

    def pooled(self, data: np.ndarray, places: int) -> np.ndarray:
        """Mean and maximum over the chunks of the chunks' maxima."""
        top = []
        for a, b in chunks(places):
            top.append(self.convolved(data[a * STRIDE : b * STRIDE + WIDTH - STRIDE], b - a).max(axis=0))
        top = np.maximum(np.array(top), 0)
        return np.concatenate([top.mean(axis=0), top.max(axis=0)])

    def score(self, texts: list[str | None]) -> np.ndarray:
        data, places = laid(texts)
        out, at = np.empty((len(texts), 2 * FILTERS), np.float32), 0
        for i, p in enumerate(places.tolist()):
            n = p * STRIDE + WIDTH - STRIDE
            out[i] = self.pooled(data[at : at + n], p)
            at += n
        # row by row in double: a score doesn't depend on what else is in the batch
        return 1 / (1 + np.exp(-((out * self.head).sum(axis=1, dtype=np.float64) + float(self.base[0]))))

    def fit(self, texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        params = [self.filters, self.bias, self.head, self.base]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        laid_out = [laid([t]) for t in texts]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), BATCH):
                grads = [np.zeros_like(p) for p in params]
                batch = order[lo : lo + BATCH]
                for i in batch.tolist():
                    self._add(grads, laid_out[i][0], int(laid_out[i][1][0]), labels[i])
                step += 1
                for p, g, m, v in zip(params, grads, first, second):
                    g /= len(batch)
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        return self

    def _add(self, grads: list[np.ndarray], data: np.ndarray, places: int, label: int) -> None:
        """Adds a text's gradient of the logistic loss; it reaches each chunk's filters where they were highest."""
        out, parts = self.convolved(data, places), chunks(places)
        at = np.array([a + out[a:b].argmax(axis=0) for a, b in parts])
        raw = np.take_along_axis(out, at, axis=0)
        top = np.maximum(raw, 0)
        seen = np.concatenate([top.mean(axis=0), top.max(axis=0)])
        error = 1 / (1 + np.exp(-(float(seen @ self.head) + float(self.base[0])))) - label
        grads[2] += error * seen
        grads[3] += error
        back = np.tile(error * self.head[:FILTERS] / len(parts), (len(parts), 1))
        back[top.argmax(axis=0), np.arange(FILTERS)] += error * self.head[FILTERS:]
        back = (back * (raw > 0)).astype(np.float32)
        grads[1] += back.sum(axis=0)
        column = np.broadcast_to(np.arange(FILTERS), at.shape)
        for j in range(WIDTH):
            np.add.at(grads[0][j], (data[at * STRIDE + j], column), back)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network | None:
    """A network fitted on at most `sample` labelled texts of docs, of at most `sample_bytes` together."""
    known = labels.select(quoted(id_col).alias("id"), quoted(label_col).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)  # bounded: it may be broadcast
    texts = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("t")).where("t is not null")
    rows = texts.join(F.broadcast(known), "id").groupBy("id").agg(F.min("t").alias("t"), F.max("y").alias("y"))
    # at most `sample` rows; the driver gets those whose bytes, summed in the order of hashed ids, stay within the bound
    size = F.octet_length("t").cast("long")
    fits = rows.where(size <= sample_bytes).withColumn("upto", F.sum(size).over(Window.orderBy(F.xxhash64("id"), "id")))
    rows = fits.where(F.col("upto") <= sample_bytes).orderBy(F.xxhash64("id"), "id").select("t", "y").collect()
    if not rows:
        return None
    return Network().fit([r["t"] for r in rows], [int(r["y"] > 0) for r in rows])


def score(df: DataFrame, network: Network | None, text_col: str = "text") -> DataFrame:
    """df and score (0 to 1) and predicted (1 from THRESHOLD on)."""
    sent = df.sparkSession.sparkContext.broadcast(network)
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def make():
        net = sent.value.ready() if sent.value else None

        def work(texts):
            p = net.score(texts) if net else np.full(len(texts), 0.5)
            return p, (p >= THRESHOLD).astype(np.int32)

        return work

    return append_by_text(df, text_col, fields, make)
