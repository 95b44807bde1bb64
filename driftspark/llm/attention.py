"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (lines, long ones in pieces of PASSAGE bytes).
A passage is encoded from its bytes: shares of byte classes and of hashed
words, and a few lengths, through one tanh layer h. Gated attention
a = u . (tanh(V h) * sigmoid(U h)) weighs the passages of a document, and its
score is sigmoid(w . sum(softmax(a) h) + b). All weights are learned from
document labels alone, in numpy, on a bounded sample of labelled rows; the
sample follows a hash of the id, so a fit repeats exactly.

Scoring needs two numbers per passage, a and w . h, so a text of any length
takes bounded memory. Nothing but the text enters a score.

Null and empty texts are one empty passage. Labels that are null count as
missing; a repeated id may bring several labelled rows. With no labelled row
every score is 0.5. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftspark.llm.common import add_columns, col, table

PASSAGE = 1000       # bytes
PIECE = 1 << 20      # bytes of text encoded at a time
WORDS = 256          # hashed word bins
HIDDEN, GATE = 48, 16
SAMPLE = 4000        # labelled rows the fit may use at most
SAMPLE_BYTES = 16384  # longer texts are not in the sample (they are scored like all others)
EPOCHS, BATCH, RATE, DECAY = 16, 64, 5e-3, 1e-4
SEED = 11
ACCEPT = 0.7
FOLDS, HELD_OUT = 4, 2
N_FEATURES = 128 + WORDS + 6


def encode(texts: list[bytes]):
    """(features of every passage, number of its text)."""
    import numpy as np

    data = b"\n".join(texts) + b"\n"
    x = np.frombuffer(data, np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    n, place = len(x), np.arange(len(x))
    first = np.concatenate([[True], x[:-1] == 10])
    first[ends[:-1]] = True
    start = np.maximum.accumulate(np.where(first, place, 0))
    opens = (place - start) % PASSAGE == 0
    passage = np.cumsum(opens) - 1
    m = int(passage[-1]) + 1
    kind = np.where(x < 128, x, (x - 128) >> 2).astype(np.int64)  # non-ASCII bytes use the unused control classes
    classes = np.bincount(passage * 128 + kind, minlength=m * 128).reshape(m, 128).astype(np.float32)
    size = classes.sum(axis=1)
    solid = (x != 32) & ((x < 9) | (x > 13))
    heads = np.flatnonzero(solid & np.concatenate([[True], ~solid[:-1] | opens[1:]]))
    words = np.zeros((m, WORDS), np.float32)
    if len(heads):
        head = np.zeros(n, bool)
        head[heads] = True
        inner = np.minimum(place - np.maximum.accumulate(np.where(head, place, 0)), 15)
        power = np.array([pow(31, k, 1 << 32) for k in range(16)], np.uint64)
        h = np.add.reduceat(np.where(solid, x.astype(np.uint64) * power[inner], np.uint64(0)), heads)
        bins = (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.int64) % WORDS
        words = np.bincount(passage[heads] * WORDS + bins, minlength=m * WORDS).reshape(m, WORDS).astype(np.float32)
    count = words.sum(axis=1)
    upper, lower = classes[:, 65:91].sum(axis=1), classes[:, 97:123].sum(axis=1)
    marks = classes[:, 33:48].sum(axis=1) + classes[:, 58:65].sum(axis=1) + classes[:, 91:97].sum(axis=1) + classes[:, 123:127].sum(axis=1)
    extra = np.stack([np.log1p(size) / 7, np.log1p(count) / 5, size / (count + 1) / 10, upper / (upper + lower + 1),
                      marks / (size + 1), (words > 0).sum(axis=1) / (count + 1)], axis=1)
    features = np.concatenate([np.sqrt(classes / np.maximum(size, 1)[:, None]), np.sqrt(words / np.maximum(count, 1)[:, None]), extra], axis=1)
    return features.astype(np.float32), np.searchsorted(ends, place[opens], side="right")


@dataclass
class Model:
    weights: dict  # numpy arrays by name

    def passages(self, features):
        """(attention, value) of every passage."""
        import numpy as np

        p = self.weights
        h = np.tanh(features @ p["W"] + p["c"])
        a = (np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["u"]
        return a.astype(np.float64), (h @ p["w"]).astype(np.float64)

    def scores(self, texts: list) -> list[float]:
        import numpy as np

        if not self.weights:
            return [0.5] * len(texts)
        top, mass, value = np.full(len(texts), -np.inf), np.zeros(len(texts)), np.zeros(len(texts))

        def flush(parts, numbers):
            features, owner = encode(parts)
            a, v = self.passages(features)
            doc = np.array(numbers)[owner]
            high = top.copy()
            np.maximum.at(high, doc, a)
            shrink = np.where(np.isinf(top), 0.0, np.exp(np.minimum(np.where(np.isinf(top), 0.0, top) - np.where(np.isinf(high), 0.0, high), 0.0)))
            mass[:] = mass * shrink
            value[:] = value * shrink
            w = np.exp(a - high[doc])
            np.add.at(mass, doc, w)
            np.add.at(value, doc, w * v)
            top[:] = high

        parts, numbers, size = [], [], 0
        for k, t in enumerate(texts):
            raw = (t or "").encode("utf-8")
            for i in range(0, max(1, len(raw)), PIECE):
                parts.append(raw[i:i + PIECE])
                numbers.append(k)
                size += len(parts[-1])
                if size >= PIECE:
                    flush(parts, numbers)
                    parts, numbers, size = [], [], 0
        if parts:
            flush(parts, numbers)
        return (1 / (1 + np.exp(-(value / mass + float(self.weights["b"]))))).tolist()


def fit(texts: list[str], labels: list[int]) -> Model:
    """Adam on mini-batches of bags; gradients of the loss written out."""
    import numpy as np

    if not texts:
        return Model({})
    rng = np.random.default_rng(SEED)
    parts = [encode([t.encode("utf-8")])[0] for t in texts]
    y = np.array(labels, np.float32)
    p = {"W": rng.normal(0, N_FEATURES**-0.5, (N_FEATURES, HIDDEN)), "c": np.zeros(HIDDEN),
         "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
         "u": rng.normal(0, GATE**-0.5, GATE), "w": rng.normal(0, HIDDEN**-0.5, HIDDEN), "b": np.zeros(())}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    t = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(parts))
        rate = RATE * (1 - epoch / EPOCHS)
        for i in range(0, len(order), BATCH):
            bag = order[i:i + BATCH]
            x = np.concatenate([parts[k] for k in bag])
            sizes = np.array([len(parts[k]) for k in bag])
            at, owner = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(bag)), sizes)
            h = np.tanh(x @ p["W"] + p["c"])
            tv, su = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
            a = (tv * su) @ p["u"]
            e = np.exp(a - np.maximum.reduceat(a, at)[owner])
            alpha = e / np.add.reduceat(e, at)[owner]
            z = np.add.reduceat(alpha[:, None] * h, at, axis=0)
            score = 1 / (1 + np.exp(-(z @ p["w"] + p["b"])))
            d = (score - y[bag]) / len(bag)
            dz = d[:, None] * p["w"]
            dalpha = (h * dz[owner]).sum(axis=1)
            da = alpha * (dalpha - np.add.reduceat(alpha * dalpha, at)[owner])
            dg = da[:, None] * p["u"]
            dv, du = dg * su * (1 - tv**2), dg * tv * su * (1 - su)
            dh = (alpha[:, None] * dz[owner] + dv @ p["V"].T + du @ p["U"].T) * (1 - h**2)
            g = {"W": x.T @ dh, "c": dh.sum(axis=0), "V": h.T @ dv, "U": h.T @ du, "u": (tv * su).T @ da, "w": z.T @ d, "b": d.sum()}
            t += 1
            for k in p:
                grad = g[k] + DECAY * p[k] * (k in ("W", "V", "U", "w"))
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return Model(p)


def held_out(ident: str):
    """Rows no fit may see: crc32 of the id as text, modulo FOLDS."""
    return F.coalesce(F.crc32(F.encode(col(ident).cast("string"), "UTF-8")) % FOLDS == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id", label: str = "quality",
          sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled rows, none of them held out."""
    known = labels.select(col(ident).alias("id"), col(label).cast("int").alias("y")).where(
        F.col("y").isin(0, 1) & ~held_out("id"))
    known = known.orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    texts = docs.select(col(ident).alias("id"), F.coalesce(col(text), F.lit("")).alias("text")).where(
        F.octet_length("text") <= SAMPLE_BYTES)
    rows = sorted((r["id"], r["y"], r["text"]) for r in
                  texts.join(F.broadcast(known), "id").orderBy(F.xxhash64("id", "text"), "id").limit(sample).collect())
    return fit([r[2] for r in rows], [r[1] for r in rows])


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row with ``score``."""
    return add_columns(df, [text], lambda texts: [model.scores(texts)], [T.StructField("score", T.DoubleType())])


def op6_attention(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score",
                                     (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
