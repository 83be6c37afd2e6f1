"""Topic models, clusters, latent features and encoders on Spark ML, with NumPy inside batches where there is no built-in."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dense_rows(df: DataFrame, doc: str, array: str) -> DataFrame:
    return df.select(doc, array_to_vector(F.col(array).cast("array<double>")).alias("features"))


def standardised_rows(features: DataFrame) -> DataFrame:
    """Vectors less their mean over their population deviation."""
    from pyspark.ml.feature import StandardScaler

    n = features.count()
    model = StandardScaler(inputCol="features", outputCol="z", withMean=True).fit(features)
    scale = math.sqrt(n / (n - 1)) if n > 1 else 1.0  # from the sample's to the population's deviation
    scaled = F.transform(vector_to_array("z"), lambda x: x * scale)
    return model.transform(features).withColumn("features", array_to_vector(scaled)).drop("z")


def pca_latent(features: DataFrame, doc: str, k: int = 16) -> DataFrame:
    """``(doc, latent_feature_0..)``: principal components of standardised features."""
    rows = standardised_rows(features)
    model = PCA(k=k, inputCol="features", outputCol="p").fit(rows)
    return model.transform(rows).select(doc, vector_to_array("p").alias("p")).select(doc, *(F.get("p", F.lit(i)).alias(f"latent_feature_{i}") for i in range(k)))


def _adam_steps(layers: list, moments: list, t: int, x: np.ndarray, rate: float, batch: int) -> int:
    """Steps of Adam over consecutive mini-batches of ``x``, in place; the number of steps so far."""
    params = [p for layer in layers for p in layer]
    for at in range(0, len(x), batch):
        rows = x[at : at + batch]
        acts = [rows]
        for i, (w, b) in enumerate(layers):
            z = acts[-1] @ w + b
            acts.append(z if i == len(layers) - 1 else np.tanh(z))
        delta, grads = (acts[-1] - rows) * 2 / rows.size, []
        for i in range(len(layers) - 1, -1, -1):
            if i < len(layers) - 1:
                delta = delta * (1 - acts[i + 1] ** 2)
            grads[:0] = [acts[i].T @ delta, delta.sum(0)]
            delta = delta @ layers[i][0].T
        t += 1
        for (m, v), g, p in zip(moments, grads, params):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return t


def _unflat(flat: np.ndarray, sizes: list[int]) -> tuple[list, list]:
    """Layers and moments from one vector: all parameters, then the first and the second moments."""
    shapes = [shape for a, b in zip(sizes, sizes[1:]) for shape in ((a, b), (b,))]
    cuts = np.cumsum([math.prod(s) for s in shapes] * 3)[:-1]
    parts = [p.reshape(s).copy() for p, s in zip(np.split(flat, cuts), shapes * 3)]
    n = len(shapes)
    return list(zip(parts[:n:2], parts[1:n:2])), list(zip(parts[n : 2 * n], parts[2 * n :]))


def fit_autoencoder(
    rows: DataFrame, array: str, mean: np.ndarray, std: np.ndarray, hidden: int = 32, code: int = 8, epochs: int = 30, rate: float = 1e-2, seed: int = 42, batch: int = 128
) -> list[tuple[np.ndarray, np.ndarray]]:
    """A tanh autoencoder (in - hidden - code - hidden - in) by Adam on all rows; its layers.

    An epoch is one pass: every partition takes its steps from the same weights over mini-batches of all its rows, and
    weights and moments are averaged in the cluster, each partition counting with its rows. Only they reach the driver.
    """
    rng = np.random.default_rng(seed)
    sizes = [len(mean), hidden, code, hidden, len(mean)]
    first = [p.reshape(-1) for a, b in zip(sizes, sizes[1:]) for p in (rng.normal(0, math.sqrt(1 / a), (a, b)), np.zeros(b))]
    n = sum(map(len, first))
    flat, t = np.concatenate([*first, np.zeros(2 * n)]), 0
    context = rows.sparkSession.sparkContext
    for epoch in range(epochs):
        sent = context.broadcast((flat, t))

        def step(batches: Iterator[pd.DataFrame], sent=sent, epoch=epoch) -> Iterator[pd.DataFrame]:
            flat, t = sent.value
            layers, moments = _unflat(flat, sizes)
            order, seen, start = np.random.default_rng((seed, epoch)), 0, t
            for pdf in batches:
                if len(pdf):
                    x = (np.array(pdf[array].to_list(), dtype=float).reshape(len(pdf), -1) - mean) / std
                    t = _adam_steps(layers, moments, t, x[order.permutation(len(x))], rate, batch)
                    seen += len(x)
            if seen:
                ms, vs = zip(*moments)
                out = np.concatenate([p.reshape(-1) for p in (*(p for layer in layers for p in layer), *ms, *vs)])
                # behind the weights: the rows, and the steps taken
                yield pd.DataFrame({"at": np.arange(3 * n + 2), "v": np.concatenate([out * seen, [seen, (t - start) * seen]])})

        summed = rows.select(array).mapInPandas(step, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
        sums = summed.sort_values("at")["v"].to_numpy()
        flat, t = sums[: 3 * n] / sums[-2], t + max(1, round(sums[-1] / sums[-2]))
        sent.destroy()
    return _unflat(flat, sizes)[0]


def autoencode(df: DataFrame, doc: str, array: str, block_rows: int = 2048, most_blocks: int = 1024, **options) -> DataFrame:
    """``(doc, latent array, error)``: codes by an autoencoder fitted on all rows, all rows encoded in batches.

    Mean and deviation are of all rows. For the fit rows are dealt by hash over partitions of about ``block_rows`` rows, or
    over ``most_blocks`` larger ones, read in batches; so the layout of the input does not matter.
    """
    places = df.select(F.posexplode(F.col(array).cast("array<double>")).alias("at", "v"))
    stats = places.groupBy("at").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count("*").alias("n")).toPandas().sort_values("at")
    mean, std = stats["mean"].to_numpy(), stats["std"].to_numpy()
    std = np.where(std > 0, std, 1.0)
    layers = []
    if len(stats):
        blocks = min(most_blocks, -(-int(stats["n"].max()) // block_rows))
        hashed = F.xxhash64(doc, array)
        # merged again where the session deals a key over more partitions: every block costs a task an epoch
        rows = df.select(doc, array).repartition(blocks, hashed).coalesce(blocks).sortWithinPartitions(hashed, doc).select(array).persist()
        layers = fit_autoencoder(rows, array, mean, std, **options)
        rows.unpersist()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = (np.array(pdf[array].to_list(), dtype=float).reshape(len(pdf), -1) - mean) / std
            a = rows
            for i, (w, b) in enumerate(layers):
                a = a @ w + b
                if i < len(layers) - 1:
                    a = np.tanh(a)
                if i == 1:
                    code = a
            yield pd.DataFrame({doc: pdf[doc], "latent": list(code), "error": ((a - rows) ** 2).mean(1)})

    return df.select(doc, array).mapInPandas(encode, f"{doc} {df.schema[doc].dataType.simpleString()}, latent array<double>, error double")


def embed(docs: DataFrame, doc: str, text: str, load: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """``(doc, embedding array<float>)`` by a pluggable encoder: ``load`` runs once a task, its result encodes batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for pdf in batches:
            vectors = encode(pdf[text].fillna("").to_list())
            yield pd.DataFrame({doc: pdf[doc], "embedding": [v.astype("float32").tolist() for v in vectors]})

    return docs.select(doc, text).mapInPandas(run, f"{doc} {docs.schema[doc].dataType.simpleString()}, embedding array<float>")


def hashing_encoder(size: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """An encoder without weights: words hashed to signed places, averaged over the text (mean pooling)."""

    def load():
        import zlib

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), size))
            for row, text in zip(out, texts):
                for word in text.lower().split():
                    h = zlib.crc32(word.encode())
                    row[h % size] += 1 if h & 0x10000 else -1
                row /= max(1, len(text.split()))
            return out

        return encode

    return load


def sentiment_classifier(docs: DataFrame, doc: str, tokens: str, label: str, size: int = 1 << 12):
    """A multinomial logistic regression on hashed terms: the trainable stand-in for a fine-tuned scorer."""
    features = HashingTF(inputCol=tokens, outputCol="features", numFeatures=size)
    return features, LogisticRegression(featuresCol="features", labelCol=label, maxIter=20, regParam=0.01).fit(features.transform(docs.where(F.col(label).isNotNull())))


def sentiment_scores(features, model, docs: DataFrame, doc: str, negative: int = 0, positive: int = 1) -> DataFrame:
    """``(doc, sent_neg, sent_pos, sentiment)``: probabilities by label, and positive less negative."""
    rows = model.transform(features.transform(docs)).select(doc, vector_to_array("probability").alias("p"))
    neg, pos = F.get("p", F.lit(negative)), F.get("p", F.lit(positive))
    return rows.select(doc, neg.alias("sent_neg"), pos.alias("sent_pos"), (pos - neg).alias("sentiment"))
