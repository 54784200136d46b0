"""Language identification by a byte convolutional network, trained and run in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segspark.llm.common import bounded_batches, documents

#: Bytes of a window; embedding width; filter widths and filters of each; most documents per language, windows of
#: each that training takes; passes over them; step size. Most documents of all languages together.
WINDOW, EMBED, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 12
PER_LANGUAGE, SPOTS, EPOCHS, STEP, SEED = 200, 3, 12, 4e-3, 7
MOST = 20_000
#: Windows that are classified at once.
BATCH = 256
UNKNOWN = "und"


class ByteNetwork:
    """Embedding -> filters of several widths over neighbouring bytes -> maximum over the window -> softmax."""

    def __init__(self, labels: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.labels = labels
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.weights = {"embed": normal(257, EMBED, scale=0.5)}
        self.weights["embed"][256] = 0
        for w in WIDTHS:
            self.weights[f"filter{w}"] = normal(w * EMBED, FILTERS, scale=(2 / (w * EMBED)) ** 0.5)
            self.weights[f"bias{w}"] = np.zeros(FILTERS, np.float32)
        self.weights["out"] = normal(len(WIDTHS) * FILTERS, len(labels), scale=(1 / (len(WIDTHS) * FILTERS)) ** 0.5)
        self.weights["out_bias"] = np.zeros(len(labels), np.float32)

    def forward(self, x: np.ndarray, keep: bool = False):
        """Class probabilities of windows, an int array of bytes with 256 for padding; ``keep``: what training needs, too."""
        p, n = self.weights, len(x)
        e = p["embed"][x]
        pooled, where = [], {}
        for w in WIDTHS:
            span = WINDOW - w + 1
            flat = np.lib.stride_tricks.as_strided(
                e, (n, span, w * EMBED), (e.strides[0], e.strides[1], e.strides[2]))
            y = flat.reshape(n * span, w * EMBED) @ p[f"filter{w}"]
            y = y.reshape(n, span, FILTERS)
            if keep:
                where[w] = y.argmax(1)
            pooled.append(y.max(1) + p[f"bias{w}"])
        h = np.maximum(np.concatenate(pooled, 1), 0)
        z = h @ p["out"] + p["out_bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        return (z, h, where, e) if keep else z

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.weights, len(x)
        z, h, where, e = self.forward(x, keep=True)
        z = z.copy()
        z[np.arange(n), y] -= 1
        z /= n
        g = {"out": h.T @ z, "out_bias": z.sum(0), "embed": np.zeros_like(p["embed"])}
        back = (z @ p["out"].T) * (h > 0)
        for k, w in enumerate(WIDTHS):
            d = back[:, k * FILTERS:(k + 1) * FILTERS]
            g[f"bias{w}"] = d.sum(0)
            # Only the place of each maximum has a gradient.
            at = where[w][:, :, None] + np.arange(w)
            rows = np.arange(n)[:, None, None]
            seen = e[rows, at].reshape(n, FILTERS, w * EMBED)
            g[f"filter{w}"] = np.einsum("nf,nfk->kf", d, seen)
            inner = (d[:, :, None] * p[f"filter{w}"].T[None]).reshape(n, FILTERS, w, EMBED)
            np.add.at(g["embed"], x[rows, at], inner)
        g["embed"][256] = 0
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, step: float = STEP, seed: int = SEED) -> ByteNetwork:
        """Adam on shuffled batches; the same windows in the same order give the same weights."""
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        var = {k: np.zeros_like(v) for k, v in self.weights.items()}
        t = 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
                t += 1
                for k, g in self.gradients(x[part], y[part]).items():
                    mean[k] += 0.1 * (g - mean[k])
                    var[k] += 0.001 * (g * g - var[k])
                    self.weights[k] -= (step * (mean[k] / (1 - 0.9**t)) / (np.sqrt(var[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def windows(data: bytes) -> np.ndarray:
    """The whole text as rows of ``WINDOW`` bytes, the last one padded."""
    n = -(-len(data) // WINDOW)
    out = np.full(n * WINDOW, 256, np.int16)
    out[:len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


def training_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang",
    per_language: int = PER_LANGUAGE, most: int = MOST,
) -> DataFrame:
    """A bounded sample of labelled documents: ``per_language`` of each label, fewer where labels are so many that this exceeds ``most``.

    Every label has one document at least, so the sample holds no more than ``most`` or one of each label. Chosen
    on key and label alone, by hash; texts are fetched only for the chosen keys and cut to the bytes that training
    looks at.
    """
    known = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, label)
    labels = known.agg(F.count_distinct(label)).first()[0]
    each = max(1, min(per_language, most // max(1, labels)))
    place = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(key), key))
    chosen = (
        known.withColumn("_place", place).filter(F.col("_place") <= each).select(key).distinct()
    )
    # Several spots of a long text, so that a foreign head or tail counts for little.
    raw = F.encode(text, "UTF-8")
    room = F.greatest(F.octet_length(text) - WINDOW, F.lit(0))
    spots = F.array(*[
        F.substring(raw, (F.floor(room * (i / max(1, SPOTS - 1))) + 1).cast("int"), F.lit(WINDOW)) for i in range(SPOTS)])
    few = F.broadcast(chosen) if labels <= most else chosen
    return docs.join(few, key, "left_semi").filter(F.col(label).isNotNull()).select(
        key, label, spots.alias("spots"))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> ByteNetwork | None:
    """A network for the labels of ``docs``; None if there are none. Trains on the driver, on the bounded sample only."""
    rows = sorted((r[1], str(r[0]), [bytes(s) for s in r[2]]) for r in training_documents(docs, key, text, label).collect())
    labels = sorted({r[0] for r in rows})
    taken = [(w, labels.index(lang)) for lang, _, spots in rows for s in sorted(set(spots)) if s for w in windows(s)]
    if not taken:
        return None
    return ByteNetwork(labels).train(np.array([w for w, _ in taken]), np.array([y for _, y in taken]))


def classify(df: DataFrame, network: ByteNetwork | None, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (the mean probability of that language over all windows of the text).

    Every byte of every text is read, in fixed windows that are classified in batches. Null or empty text and
    text without a letter get ``und`` and score 0, as does everything if nothing could be learned. A tie goes to
    the first label. Only the text is an input; no shuffle. Existing columns of these names are replaced.
    """
    bounded_batches(df.sparkSession)
    kind = "struct<lang_pred: string, score: double>"

    @F.arrow_udf(kind)
    def predict(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        pending, sizes = [], []

        def flush() -> None:
            if not sizes:
                return
            x = np.concatenate(pending) if pending else np.empty((0, WINDOW), np.int16)
            p = [network.forward(x[i:i + BATCH]) for i in range(0, len(x), BATCH)]
            p = np.concatenate(p) if p else np.empty((0, len(network.labels)))
            at = 0
            for n in sizes:
                if n == 0:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                mean = p[at:at + n].mean(0, dtype=np.float64)
                at += n
                names.append(network.labels[int(mean.argmax())])
                scores.append(min(1.0, float(mean.max())))
            pending.clear()
            sizes.clear()

        for value in texts:
            value = value.as_py()
            known = network is not None and value is not None and any(map(str.isalpha, value))
            if known:
                pending.append(windows(value.encode()))
            if network is None:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            sizes.append(len(pending[-1]) if known else 0)
            if sum(sizes) >= BATCH:
                flush()
        flush()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return df.withColumn("_found", predict(F.col(text))).withColumns(
        {"lang_pred": F.col("_found.lang_pred"), "score": F.col("_found.score")}).drop("_found")


def held_out(key: str = "doc_id"):
    """Documents that nothing is learned from."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def q_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    network = fit(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return classify(docs.select("doc_id", "text", held_out().alias("held_out")), network).select(
        "doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op9_byte_cnn_language": (q_language, None)}
