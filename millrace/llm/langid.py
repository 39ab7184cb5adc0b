"""Language identification with a byte convolutional network.

Bytes get a small vector each; filters of several widths slide over a window of 256 bytes, each keeps its highest
response, and a softmax layer turns the responses into languages. The network is trained in numpy on the driver, on a
sample of labelled windows with a fixed bound. The tasks apply it to all windows of every text, many at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import flat

WINDOW, WIDTHS, FILTERS, VECTOR = 256, (2, 3, 4), 16, 8
SAMPLED_DOCS = 2_400  # labelled documents in the sample, dealt evenly to the languages
SAMPLED_WINDOWS = 4  # windows of each, spread over its text
EPOCHS, BATCH, RATE, SEED = 5, 64, 0.01, 23

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts (the last one of a text filled up with zeros), their texts and their bytes in use."""
    data, at = flat(texts)
    size = np.diff(at)
    count = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    used = np.minimum(size[owner] - nth * WINDOW, WINDOW)
    out = np.zeros((len(owner), WINDOW), np.uint8)
    # Texts stand in a row in both, so bytes keep their order.
    out[np.arange(WINDOW) < used[:, None]] = _LOWER[data]
    return out, owner, used


@dataclass
class Network:
    languages: list[str]
    vector: np.ndarray  # (256, VECTOR); byte 0 is filling and stays zero
    filters: list[np.ndarray]  # for each width (width * VECTOR, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def fresh(languages: list[str]) -> Network:
        draw = np.random.default_rng(SEED)
        normal = lambda *shape, by: (draw.normal(size=shape) * by).astype(np.float32)
        vector = normal(256, VECTOR, by=0.5)
        vector[0] = 0
        filters = [normal(w * VECTOR, FILTERS, by=(w * VECTOR) ** -0.5) for w in WIDTHS]
        return Network(languages, vector, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], normal(len(WIDTHS) * FILTERS, len(languages), by=0.1), np.zeros(len(languages), np.float32))

    def _responses(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each width: the unrolled windows (n, places, width * VECTOR) and the filter responses at each place."""
        v = self.vector[x].reshape(len(x), -1)
        out = []
        for w, f in zip(WIDTHS, self.filters):
            rolled = np.lib.stride_tricks.sliding_window_view(v, w * VECTOR, axis=1)[:, ::VECTOR]
            rolled = np.ascontiguousarray(rolled)
            out.append((rolled, (rolled.reshape(-1, w * VECTOR) @ f).reshape(*rolled.shape[:2], FILTERS)))
        return out

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray, batch: int = 128) -> np.ndarray:
        out = np.zeros((len(x), len(self.languages)), np.float32)
        for i in range(0, len(x), batch):
            best = [z.max(axis=1) + b for (_, z), b in zip(self._responses(x[i : i + batch]), self.bias)]
            out[i : i + batch] = self._softmax(np.maximum(np.hstack(best), 0))
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy, in the order of weights()."""
        n, rows = len(x), np.arange(len(x))
        parts = self._responses(x)
        place = [z.argmax(axis=1) for _, z in parts]
        best = [np.take_along_axis(z, p[:, None], axis=1)[:, 0] + b for (_, z), p, b in zip(parts, place, self.bias)]
        pooled = np.maximum(np.hstack(best), 0)
        p = self._softmax(pooled)
        p[rows, y] -= 1
        p /= n
        back = (p @ self.out.T) * (pooled > 0)
        d_vector = np.zeros_like(self.vector)
        d_filters, d_bias = [], []
        for k, (w, (rolled, _), at) in enumerate(zip(WIDTHS, parts, place)):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            picked = rolled[rows[:, None], at]  # (n, FILTERS, width * VECTOR)
            d_filters.append(np.einsum("nf,nfd->df", g, picked))
            d_bias.append(g.sum(axis=0))
            d_rolled = (g[:, :, None] * self.filters[k].T[None]).reshape(n, FILTERS, w, VECTOR)
            np.add.at(d_vector, x[rows[:, None, None], at[:, :, None] + np.arange(w)], d_rolled)
        d_vector[0] = 0
        return [d_vector, *d_filters, *d_bias, pooled.T @ p, p.sum(axis=0)]

    def weights(self) -> list[np.ndarray]:
        return [self.vector, *self.filters, *self.bias, self.out, self.out_bias]

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        """Adam over shuffled batches; languages with fewer windows are drawn as often as the others."""
        draw = np.random.default_rng(SEED)
        share = 1 / np.bincount(y, minlength=len(self.languages))[y]
        share /= share.sum()
        mean, square = ([np.zeros_like(w) for w in self.weights()] for _ in range(2))
        for step in range(1, EPOCHS * max(40, -(-len(x) // BATCH)) + 1):
            some = draw.choice(len(x), BATCH, p=share)
            for w, g, m, s in zip(self.weights(), self.gradients(x[some], y[some]), mean, square):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sampled_docs: int = SAMPLED_DOCS) -> Network | None:
    """Train on a sample of the labelled rows that are not held out; None without any.

    The sample takes rows by a hash of id and text, about equally many of each language, `sampled_docs` in all.
    """
    rows = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(int(1e6 * min(1, sampled_docs / len(counts) / n)) + 1)).otherwise(share)
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text"), F.lit(1_000_000)) < share)
    size = F.length(F.encode("text", "UTF-8"))
    starts = F.array_distinct(F.array(*[F.floor(F.greatest(size - WINDOW, F.lit(0)) * k / max(1, SAMPLED_WINDOWS - 1)) for k in range(SAMPLED_WINDOWS)]))
    parts = F.transform(starts, lambda s: F.substring(F.encode("text", "UTF-8"), s.cast("int") + 1, F.lit(WINDOW)))
    sample = drawn.select("lang", F.explode(parts).alias("part")).toArrow()
    text = sample.column("part").to_pylist()
    order = np.argsort([f"{lang}".encode() + b"\0" + t for lang, t in zip(sample.column("lang").to_pylist(), text)], kind="stable")
    x = _LOWER[np.frombuffer(b"".join(text[i].ljust(WINDOW, b"\0") for i in order), np.uint8).reshape(-1, WINDOW)]
    number = {lang: k for k, lang in enumerate(languages)}
    y = np.array([number[lang] for lang in sample.column("lang").to_pylist()], int)[order]
    present = np.bincount(y, minlength=len(languages)) > 0
    network = Network.fresh([lang for lang, p in zip(languages, present) if p])
    network.train(x, (np.cumsum(present) - 1)[y])
    return network


def identify(docs: DataFrame, sampled_docs: int = SAMPLED_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of `docs` (doc_id, text, lang).

    A text's language is the one of the highest mean probability over its windows, weighted by their bytes; the score is
    that mean. A text without a letter, or missing, is `und` with score 0; so is every text if nothing is labelled.
    Held out are ids with crc32 mod 4 = 2; missing ids are neither held out nor learned from. Repeated rows repeat.
    """
    network = fit(docs.select("doc_id", "text", "lang"), sampled_docs)

    @F.arrow_udf("struct<lang: string, score: double>")
    def judged(text: pa.Array) -> pa.Array:
        n = len(text)
        letters = np.array([any(map(str.isalpha, t or "")) for t in text.to_pylist()], bool)
        if network is None:
            letters[:] = False
            best, score = np.zeros(n, int), np.zeros(n)
        else:
            x, owner, used = windows(text)
            total = np.zeros((n, len(network.languages)))
            np.add.at(total, owner, network.probabilities(x) * used[:, None])
            total /= np.maximum(np.bincount(owner, weights=used, minlength=n), 1)[:, None]
            best, score = total.argmax(axis=1), np.clip(total.max(axis=1), 0, 1)
        names = network.languages if network else []
        lang = [names[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist())]
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.where(letters, score, 0.0), pa.float64())], ["lang", "score"])

    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), judged("text").alias("j"))
    return out.select("doc_id", "held_out", F.col("j.lang").alias("lang_pred"), "j.score")
