"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by stochastic gradient descent in numpy.

A text is lowered, all but its letters become single spaces, and its byte n-grams (word bounds included) are hashed into BUCKETS
embeddings, whose mean goes through a linear softmax. As the layers are linear, prediction adds up one row of logits an n-gram.
The classifier is fitted on a sample of at most `sample_rows` labelled rows, as even over languages as the rows allow, whatever the
length of their texts: the n-grams of a whole text are counted where it lies, and only the counts go to the driver. A fifth of the sample is held back to set the softmax temperature and the least score at which a prediction is accepted.

Defined cases: a null text or one without a letter is `und` with score 0 and is not accepted; a row without doc_id is never learned
from and counts as held out; rows without lang are not learned from; without any labelled row all predictions are `und`; other
columns are ignored; repeated rows are predicted alike, and a tie goes to the first language by name; an empty table gives no row.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import slices

BUCKETS, DIMENSIONS, ORDERS = 1 << 17, 16, (2, 3, 4)
SAMPLE_ROWS, EPOCHS, RATE, SEED = 4000, 4, 0.5, 11
_NO_LETTERS = re.compile(r"[\W\d_]+")


def normal(text: str | None) -> bytes:
    """Lowered words of letters with a space around each; empty if there is no letter."""
    if not text or not any(map(str.isalpha, text)):
        return b""
    return f" {_NO_LETTERS.sub(' ', text.lower()).strip()} ".encode()


def ngram_buckets(data: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each byte (the last ones run over the end and are not to be used)."""
    h = np.full(len(data), order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        h[: len(h) - k] = (h[: len(h) - k] ^ data[k:]) * np.uint32(0x01000193)
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(15)


class Classifier:
    def __init__(self, languages: list[str], logits: np.ndarray, bias: np.ndarray, temperature: float, least: float):
        self.languages, self.logits, self.bias, self.temperature, self.least = languages, logits, bias, temperature, least

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Softmax of each non-empty text."""
        ends = np.cumsum([len(x) for x in texts])
        starts = ends - [len(x) for x in texts]
        data = np.frombuffer(b"".join(texts), np.uint8)
        total, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for order in ORDERS:
            stops = np.maximum(ends - order + 1, starts)
            some = np.flatnonzero(stops > starts)
            values = self.logits[ngram_buckets(data, order)]
            cuts = np.stack([starts[some], stops[some]], 1).ravel()
            if len(cuts) and cuts[-1] == len(values):
                cuts = cuts[:-1]
            if len(cuts):
                total[some] += np.add.reduceat(values, cuts, axis=0)[::2]
            count += stops - starts
        z = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams, sorted, and how many fall into each."""
    data = np.frombuffer(text, np.uint8)
    grams = np.concatenate([ngram_buckets(data, k)[: max(0, len(data) - k + 1)] for k in ORDERS])
    return np.unique(grams, return_counts=True)


def fit(found: list[tuple[np.ndarray, np.ndarray]], labels: list[str]) -> Classifier:
    """Trains on the shares of texts that are not empty."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    random = np.random.default_rng(SEED)
    embedding = random.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    weights, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    order = random.permutation(len(found))
    held, train = order[: len(order) // 5], order[len(order) // 5 :]
    steps = EPOCHS * len(train)
    for step in range(steps):
        i = train[random.integers(len(train))]
        rate = RATE * (1 - step / steps)
        bucket, share = found[i]
        rows = embedding[bucket]
        hidden = share @ rows
        z = hidden @ weights + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[y[i]] -= 1
        embedding[bucket] -= rate * share[:, None] * (weights @ p) * len(bucket) ** 0.5
        weights -= rate * np.outer(hidden, p)
        bias -= rate * p
    model = Classifier(languages, (embedding @ weights).astype(np.float32), bias, 1.0, 0.0)
    if len(held):
        z = np.stack([found[i][1] @ model.logits[found[i][0]] for i in held]) + bias
        softmax = lambda t: (e := np.exp((z - z.max(1, keepdims=True)) / t)) / e.sum(1, keepdims=True)
        own = np.arange(len(held)), y[held]
        model.temperature = min(np.geomspace(0.05, 5, 41), key=lambda t: -np.log(np.maximum(softmax(t)[own], 1e-12)).mean())
        s = softmax(model.temperature)
        right = s.max(1)[s.argmax(1) == y[held]]
        model.least = float(np.quantile(right, 0.01)) if len(right) else 1.0
    return model


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list:
    """lang and grams (packed counts of BUCKETS buckets at most) of at most `rows` labelled rows, chosen by a hash of their doc_id, at a
    rate that evens out the languages."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = known.groupBy("lang").count().collect()  # a row a language
    if not counts:
        return []
    rate = F.lit(0.0)
    for r in counts:
        rate = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, 1.1 * rows / len(counts) / r["count"]))).otherwise(rate)
    draw = F.xxhash64("doc_id", F.lit(SEED))
    drawn = known.where((F.shiftrightunsigned(draw, 11) / F.lit(float(1 << 53))) < rate)

    def run(batches):
        for batch in slices(batches, "text"):
            for text, lang, draw in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "draw")), strict=True):
                if x := normal(text):
                    bucket, n = counted(x)
                    packed = zlib.compress(np.concatenate([np.diff(bucket, prepend=0), n]).astype("<u4").tobytes(), 3)
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((lang, pa.string()), (draw, pa.int64()), (packed, pa.binary()))], ["lang", "draw", "grams"])

    found = drawn.select("text", "lang", draw.alias("draw")).mapInArrow(run, "lang string, draw long, grams binary")
    return found.orderBy(F.shiftrightunsigned("draw", 3) % 1_000_003, "draw", "lang", "grams").limit(rows).collect()


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Classifier | None:
    found, grams = sample(docs, rows), []
    for r in found:
        bucket, n = np.frombuffer(zlib.decompress(r["grams"]), "<u4").astype(np.int64).reshape(2, -1)
        grams.append((np.cumsum(bucket), n / max(1, n.sum())))
    return fit(grams, [r["lang"] for r in found]) if found else None


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted (score not under the calibrated least) of each row."""
    model = train(docs, sample_rows)
    if model:  # a few MB: one row of logits a bucket
        model = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        for batch in slices(batches, "text"):
            texts = [normal(x) for x in batch.column("text").to_pylist()]
            some = [i for i, x in enumerate(texts) if x]
            lang, score, accepted = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
            if some and model:
                own = model.value
                got = own.scores([texts[i] for i in some])
                for i, k, s in zip(some, got.argmax(1).tolist(), got.max(1).tolist(), strict=True):
                    lang[i], score[i], accepted[i] = own.languages[k], s, s >= own.least
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang), pa.array(score), pa.array(accepted)], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
