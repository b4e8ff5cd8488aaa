"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_WORDS words. Each passage is measured (shares of
character classes, word lengths, repetition, and signed sums of hashed words and of hashed character
trigrams) and encoded by a learned layer; gated attention (tanh times sigmoid) weighs the passages;
the weighted sum of encodings is scored by a logistic layer. Only document labels are used. The model
is about two thousand numbers, fitted with Adam on a sample of at most SAMPLE labelled documents,
chosen by a hash of the id and balanced by class, and at most FIT_PASSAGES evenly spaced passages of
each; a tenth of the sample is not fitted but tells when to stop. Class weights restore the labels'
own ratio, so that scores are probabilities. Scoring runs over all passages of all documents inside
Spark's tasks, text by text, without a shuffle.

Defined results: null and empty texts are one empty passage and get that passage's score; labels
that are null are not learned; repeated rows are scored alike; with labels of a single class (or
none) every score is that share (or 0.5); other columns pass through ``scored``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, batches, mixed, table

PASSAGE_WORDS = 48
#: Most labelled documents that are learned from, half of each class where there are so many.
SAMPLE = 6000
#: Most passages of one document that are learned from (scoring uses all).
FIT_PASSAGES = 12
THRESHOLD = 0.3
#: Characters measured at once; about 100 bytes of arrays each.
BATCH_CHARS = 500_000
ENCODING, ATTENTION, STEPS, RATE, DECAY = 12, 8, 400, 0.02, 1e-4
#: Steps without a better loss on the held-back tenth after which fitting stops; the greatest scaled measure.
PATIENCE, LARGEST = 60, 5.0

_CLASS = np.full(256, 10, np.uint8)  # other ASCII
for _k, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\r\v\f", b"\n", b".,;:", b"!?", b"#*$%&<>", b"|", range(128, 256))):
    _CLASS[list(_bytes)] = _k
N_CLASSES = 11
#: Places of the hashed words and of the hashed trigrams.
WORD_DIMS, GRAM_DIMS = 64, 32
N_FEATURES = N_CLASSES + 9 + WORD_DIMS + GRAM_DIMS


def passages(texts) -> tuple[np.ndarray, np.ndarray]:
    """Measures of all passages, and the first passage of each text (with one more entry at the end)."""
    w = Words(texts, "blank", lower=False)
    low = Words(texts, "blank").hash
    counts = np.diff(w.first)
    n_pass = np.maximum(1, -(-counts // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(n_pass)])
    doc = np.repeat(np.arange(len(texts)), counts)
    order = np.arange(len(doc)) - w.first[:-1][doc]
    own = first[:-1][doc] + order // PASSAGE_WORDS  # each word's passage
    total = int(first[-1])
    size = (w.end - w.start).astype(float)
    n = np.bincount(own, minlength=total).astype(float)
    some = np.maximum(n, 1)
    # character classes: a passage's bytes are those from its first word to its last, per byte
    kinds = np.zeros((total, N_CLASSES))
    if len(own):
        head = np.flatnonzero(np.diff(own, prepend=-1))
        tail = np.append(head[1:], len(own)) - 1
        begin, end = w.start[head], w.end[tail]
        which = np.cumsum(np.bincount(begin, minlength=len(w.data) + 1)[: len(w.data)]) - 1
        inside = which >= 0
        inside[inside] &= np.flatnonzero(inside) < end[which[inside]]
        at = own[head][which[inside]]
        kinds = np.bincount(at * N_CLASSES + _CLASS[w.data[inside]], minlength=total * N_CLASSES).reshape(total, N_CLASSES).astype(float)
    chars = np.maximum(kinds.sum(1), 1)
    mean = np.bincount(own, size, total) / some
    spread = np.sqrt(np.maximum(np.bincount(own, size * size, total) / some - mean**2, 0))
    same = np.zeros(len(own))
    same[1:] = (low[1:] == low[:-1]) & (own[1:] == own[:-1])
    pair = np.unique(mixed(low + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    distinct = np.bincount(own[pair], minlength=total) / some
    ends = w.data[w.end - 1] if len(own) else np.empty(0, np.uint8)
    marked = np.bincount(own, _CLASS[ends] >= 6, total) / some if len(own) else np.zeros(total)
    lone = np.bincount(own, size == 1, total) / some
    length = np.log1p(counts)[np.repeat(np.arange(len(texts)), n_pass)]
    hashed = np.zeros((total, WORD_DIMS + GRAM_DIMS))
    if len(own):
        sign = lambda h: 1.0 - 2.0 * (h >> np.uint64(40) & np.uint64(1)).astype(float)
        where = own * WORD_DIMS + (low % np.uint64(WORD_DIMS)).astype(np.int64)
        hashed[:, :WORD_DIMS] = np.bincount(where, sign(low), total * WORD_DIMS).reshape(total, -1) / np.sqrt(some)[:, None]
        # trigrams of bytes inside words: each word's places but its last two
        data = w.data.astype(np.uint64)
        inner = np.maximum(w.end - w.start - 2, 0)
        at = np.repeat(w.start - np.cumsum(inner) + inner, inner) + np.arange(inner.sum())
        gram = mixed(data[at] << np.uint64(16) | data[at + 1] << np.uint64(8) | data[at + 2])
        where = np.repeat(own, inner) * GRAM_DIMS + (gram % np.uint64(GRAM_DIMS)).astype(np.int64)
        grams = np.bincount(own, inner, total)
        hashed[:, WORD_DIMS:] = np.bincount(where, sign(gram), total * GRAM_DIMS).reshape(total, -1) / np.sqrt(np.maximum(grams, 1))[:, None]
    x = np.column_stack([np.sqrt(kinds / chars[:, None]), mean / 8, spread / 5, np.bincount(own, same, total) / some, distinct, marked, lone, n / PASSAGE_WORDS, length / 6, n == 0, hashed])
    return x, first


class Model:
    """Encoder (W, b), gated attention (V, U, a) and output (o, c) with the measures' scale."""

    def __init__(self, share: float = 0.5):
        self.share, self.p = share, None

    def forward(self, x: np.ndarray, first: np.ndarray):
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["a"]
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        e = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
        att = e / np.add.reduceat(e, first[:-1])[bag]
        z = np.add.reduceat(att[:, None] * h, first[:-1])
        y = 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["c"], -30, 30)))
        return h, t, g, bag, att, z, y

    def fit(self, x: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray, seed: int = 5) -> Model:
        if len(set(label.tolist())) < 2:
            self.share = float(label.mean()) if len(label) else 0.5
            return self
        self.shift, self.scale = x.mean(0, dtype=np.float64).astype(np.float32), x.std(0, dtype=np.float64).astype(np.float32) + np.float32(1e-6)
        # hashed sums are noisier than the shares: they count for less, and nothing counts for more than LARGEST
        self.scale[-WORD_DIMS - GRAM_DIMS :] *= 2
        x = self.scaled(x)
        rng = np.random.default_rng(seed)
        label, weight = label.astype(np.float32), weight.astype(np.float32)
        held = rng.random(len(label)) < 0.1
        if len(set(label[held].tolist())) < 2 or len(set(label[~held].tolist())) < 2:
            held = np.zeros(len(label), bool)  # too few to hold any back
        own = np.repeat(held, np.diff(first))
        cut = lambda bags, rows: (x[rows], np.concatenate([[0], np.cumsum(np.diff(first)[bags])]), label[bags], weight[bags] / weight[bags].sum())
        check = cut(held, own) if held.any() else None
        xt, ft, yt, wt = cut(~held, ~own)
        del x
        n, k, m = xt.shape[1], ENCODING, ATTENTION
        shapes = {"W": (n, k), "b": (k,), "V": (k, m), "U": (k, m), "a": (m,), "o": (k,), "c": ()}
        self.p = {name: np.asarray(rng.normal(0, 1 / np.sqrt(s[0] if s else 1), s) if name not in "bc" else np.zeros(s), np.float32) for name, s in shapes.items()}
        m1, m2 = ({name: np.zeros(s, np.float32) for name, s in shapes.items()} for _ in range(2))
        best, kept, since = np.inf, self.p, 0
        for i in range(1, STEPS + 1):
            p = self.p
            h, t, g, bag, att, z, y = self.forward(xt, ft)
            dy = (y - yt) * wt
            dz = dy[:, None] * p["o"]
            dh = att[:, None] * dz[bag]
            de = att * (((h - z[bag]) * dz[bag]).sum(1))
            dt, dg = de[:, None] * p["a"] * g * (1 - t * t), de[:, None] * p["a"] * t * g * (1 - g)
            dh = (dh + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
            grad = {"W": xt.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ de, "o": z.T @ dy, "c": dy.sum()}
            made = {}
            for name, d in grad.items():
                d = d + DECAY * p[name]
                m1[name] = 0.9 * m1[name] + 0.1 * d
                m2[name] = 0.999 * m2[name] + 0.001 * d * d
                made[name] = np.asarray(p[name] - RATE * (m1[name] / (1 - 0.9**i)) / (np.sqrt(m2[name] / (1 - 0.999**i)) + 1e-8), np.float32)
            self.p = made
            if check and i % 5 == 0:
                y = np.clip(self.forward(*check[:2])[-1], 1e-9, 1 - 1e-9)
                loss = -(check[3] * np.where(check[2] == 1, np.log(y), np.log(1 - y))).sum()
                best, kept, since = (loss, self.p, 0) if loss < best - 1e-6 else (best, kept, since + 5)
                if since >= PATIENCE:
                    break
        self.p = kept if check else self.p
        return self

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.p is None:
            return np.full(len(first) - 1, self.share)
        return self.forward(self.scaled(x), first)[-1]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        x = x - self.shift
        x /= self.scale
        return np.clip(x, -LARGEST, LARGEST, out=x).astype(np.float32, copy=False)


def learn(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", limit: int = SAMPLE) -> Model:
    """Fit a model on at most ``limit`` labelled documents; ``labels`` holds only rows to learn from."""
    known = labels.select(id_col, F.col(label).cast("int").alias("_y")).filter("_y in (0, 1)").groupBy(id_col).agg(F.max("_y").alias("_y"))
    share = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    # the least hashes of each class: a bounded sort, no class gathered whole
    half = {0: min(share.get(0, 0), limit // 2)}
    half[1] = min(share.get(1, 0), limit - half[0])
    half[0] = min(share.get(0, 0), limit - half[1])
    picked = None
    for y, n in half.items():
        part = known.filter(F.col("_y") == y).orderBy(F.xxhash64(id_col), id_col).limit(n)
        picked = part if picked is None else picked.union(part)
    rows = documents.select(id_col, text).join(F.broadcast(picked), id_col).select(id_col, text, "_y")

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(parts, text, BATCH_CHARS):
            x, first = passages(pdf[text].tolist())
            some = [np.unique(np.linspace(a, b - 1, min(b - a, FIT_PASSAGES)).astype(int)) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            cut = [x[i].astype(np.float32).tobytes() for i in some]
            yield pd.DataFrame({"id": pdf[id_col], "y": pdf["_y"], "x": cut})

    kind = documents.schema[id_col].dataType.simpleString()
    got = rows.mapInPandas(measure, f"id {kind}, y int, x binary").toPandas().sort_values(["id", "x"], kind="stable").drop_duplicates("id")
    if not len(got):
        return Model()
    label_ = got["y"].to_numpy(float)
    weight = np.where(label_ == 1, share.get(1, 0) / max((label_ == 1).sum(), 1), share.get(0, 0) / max((label_ == 0).sum(), 1))
    first = np.concatenate([[0], np.cumsum(got["x"].map(len).to_numpy() // (4 * N_FEATURES))])
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, N_FEATURES)
    del got
    return Model().fit(x, first, label_, weight)


def scored(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with ``score``, the probability of label 1."""
    keep = [c for c in documents.columns if c != "score"]
    state = documents.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(parts, text, BATCH_CHARS):
            yield pdf.assign(score=state.value.score(*passages(pdf[text].tolist())))

    kind = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return documents.select(*keep).mapInPandas(run, f"{kind}, score double")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def op9_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~held_out())
    out = scored(docs, learn(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
