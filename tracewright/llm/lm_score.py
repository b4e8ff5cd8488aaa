"""LM scoring: cross-entropy difference of a target and a background n-gram model.

Both models are interpolated word bigrams over one shared vocabulary, counted over all documents:
the background over the whole corpus, the target over the labelled good part. N-grams are counted
exactly (by 64-bit hashes, nothing is put into places of a table). Documents are dealt out to
chunks of bounded size; each chunk sends its own distinct n-grams with their partial counts, in
slices of the hash range, to the slices' tasks; these sum over all chunks and send each chunk the
totals of just its n-grams, in the order in which they came. So a hot n-gram arrives at most once
from each chunk, and no task holds more than one chunk or one slice. A document's score is the
mean per-token loss under the target model minus that under the background model: lower means
closer to the target. A document's own counts are taken out of the models that it was counted in,
so that no document is scored by itself.

Defined results: null and texts without words have n_tokens 0 and score 0; repeated rows count
as often as they stand there; an empty target gives both models the same counts (score 0); other
columns pass through ``scored``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, batches, mixed, packed, table, unpacked

#: Characters of a chunk of documents and those that a slice of the hash range stands for, on
#: average; the numbers of both grow with the corpus. Small corpora are still dealt out.
CHUNK_CHARS, SLICE_CHARS = 8_000_000, 8_000_000
LEAST_CHUNKS, LEAST_SLICES = 64, 16
#: Share of the bigram estimate, and the prior of the unigram estimate.
LAMBDA, PRIOR = 0.6, 0.5
START = np.uint64(0x5851F42D4C957F2D)
BATCH_CHARS = 1_000_000
#: Kinds of counts (words, bigrams, words as contexts): the lowest two bits of a key.
KINDS = "ubc"


def keys(texts) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Of each token: its text, and its keys of each kind (START is the context at a text's head)."""
    w = Words(texts, "blank")
    doc = np.repeat(np.arange(len(texts)), np.diff(w.first))
    before = np.empty_like(w.hash)
    before[1:] = w.hash[:-1]
    before[w.first[:-1][np.diff(w.first) > 0]] = START
    raw = {"u": w.hash, "b": before * np.uint64(0x9E3779B97F4A7C15) + w.hash, "c": before}
    return doc, {k: mixed(raw[k]) & ~np.uint64(3) | np.uint64(i) for i, k in enumerate(KINDS)}


class _Chunk:
    """A chunk's tokens: their texts, and for each kind their places among its sorted distinct keys."""

    def __init__(self, pdf: pd.DataFrame, text: str):
        docs, found, at = [], {k: [] for k in KINDS}, 0
        for part in batches([pdf], text, BATCH_CHARS):
            doc, own = keys(part[text].tolist())
            docs.append(doc + at)
            at += len(part)
            for k in KINDS:
                found[k].append(own[k])
        self.doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        joined = np.concatenate([x for k in KINDS for x in found[k]]) if docs else np.zeros(0, np.uint64)
        self.keys, where = np.unique(joined, return_inverse=True)
        self.at = dict(zip(KINDS, where.reshape(3, -1), strict=True))

    def cuts(self, slices: int) -> np.ndarray:
        """Where the slices of the hash range begin among the keys."""
        own = (self.keys >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)
        return np.searchsorted(own, np.arange(slices + 1, dtype=np.uint64))

    def counted(self, tokens: np.ndarray | None = None) -> np.ndarray:
        """How often each key stands in the chunk, or in the given tokens."""
        return sum(np.bincount(a if tokens is None else a[tokens], minlength=len(self.keys)) for a in self.at.values()).astype(np.uint64)


def _marked(pdf: pd.DataFrame, target: str) -> pd.DataFrame:
    """The documents of a chunk, with the target column set where labels came as rows of their own."""
    label = pdf["_label"].to_numpy(bool)
    own = pdf[~label].reset_index(drop=True)
    if own["_key"].notna().any():
        own[target] = own["_key"].notna() & own["_key"].isin(set(pdf["_key"][label]))
    return own


class Models:
    """The exact counts of both models, held as what each chunk of the documents needs of them."""

    def __init__(self, dealt: DataFrame, target: str, text: str, slices: int):
        self.dealt, self.target, self.text, self.slices = dealt, target, text, slices
        self.answers = _answers(_partials(dealt, target, text, slices))

    @cached_property
    def totals(self) -> np.ndarray:
        """Of each slice: the tokens counted for the background by kind, for the target by kind, and the distinct words."""
        one = self.answers.groupBy("slice").agg(F.first("sums").alias("sums")).select("sums")
        return np.array([r["sums"] for r in one.collect()], np.int64).reshape(-1, 7)

    @property
    def t(self) -> dict[tuple[int, str], np.ndarray]:
        return {(m, k): self.totals[:, 3 * m + i] for m in (0, 1) for i, k in enumerate(KINDS)}

    @property
    def vocab(self) -> int:
        """Shared vocabulary: the distinct words of the corpus."""
        return max(1, int(self.totals[:, 6].sum()))


def _partials(dealt: DataFrame, target: str, text: str, slices: int) -> DataFrame:
    """(chunk, slice, keys, n, good): each chunk's distinct keys of each slice with their counts."""

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = _marked(pdf, target)
        c = _Chunk(own, text)
        n, good = c.counted(), c.counted(own[target].eq(True).to_numpy(bool)[c.doc])
        cut = c.cuts(slices)
        rows = [(key[0], s, packed(np.diff(c.keys[a:b], prepend=np.uint64(0))), packed(n[a:b]), packed(good[a:b])) for s, (a, b) in enumerate(zip(cut, cut[1:], strict=False))]
        return pd.DataFrame(rows, columns=["chunk", "slice", "keys", "n", "good"])

    return dealt.groupBy("_chunk").applyInPandas(count, "chunk long, slice long, keys binary, n binary, good binary")


def _answers(partials: DataFrame) -> DataFrame:
    """(chunk, slice, n, good, sums): the corpus's counts of each chunk's keys, in the chunk's order,
    and the slice's totals."""

    def add(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, own, n, good = [], [], [], []
        for pdf in frames:
            chunk += pdf["chunk"].tolist()
            own += [np.cumsum(unpacked(d, np.uint64), dtype=np.uint64) for d in pdf["keys"]]
            n += [unpacked(d, np.uint64).astype(np.uint32) for d in pdf["n"]]
            good += [unpacked(d, np.uint64).astype(np.uint32) for d in pdf["good"]]
        first = np.cumsum([0] + [len(x) for x in own])
        known, where = np.unique(np.concatenate(own), return_inverse=True)
        del own
        all_n, all_good = (np.bincount(where, np.concatenate(x), len(known)).astype(np.uint64) for x in (n, good))
        kind = (known & np.uint64(3)).astype(np.int64)
        sums = [int(x[kind == i].sum()) for x in (all_n, all_good) for i in range(3)] + [int((kind == 0).sum())]
        for i, c in enumerate(chunk):
            mine = where[first[i] : first[i + 1]]
            yield pd.DataFrame({"chunk": [c], "slice": [key[0]], "n": [packed(all_n[mine])], "good": [packed(all_good[mine])], "sums": [sums]})

    return partials.groupBy("slice").applyInPandas(add, "chunk long, slice long, n binary, good binary, sums array<long>")


def _dealt(documents: DataFrame, chunk: Column, target: Column, name: str, label: bool = False, key: Column | None = None) -> DataFrame:
    return documents.withColumns({name: target, "_chunk": chunk, "_label": F.lit(label), "_key": F.lit(None).cast("string") if key is None else key})


def _sizes(documents: DataFrame, text: str) -> tuple[int, int]:
    """Chunks and slices for a corpus, by its characters."""
    chars = documents.agg(F.sum(F.length(text))).first()[0] or 0
    return max(LEAST_CHUNKS, -(-chars // CHUNK_CHARS)), max(LEAST_SLICES, -(-chars // SLICE_CHARS))


def learn(documents: DataFrame, target: str, text: str = "text") -> Models:
    """Both models. ``target``: a boolean column; its documents count for the target model, all
    documents for the background model. Nothing but the corpus's size reaches the driver."""
    chunks, slices = _sizes(documents, text)
    chunk = F.pmod(F.xxhash64(*documents.columns), F.lit(chunks))
    return Models(_dealt(documents, chunk, F.col(target), target), target, text, slices)


def _own(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often each token's place stands in its own text."""
    _, where, n = np.unique(doc << 32 | at, return_inverse=True, return_counts=True)
    return n[where]


def scored(documents: DataFrame, models: Models, target: str, text: str = "text") -> DataFrame:
    """The documents with n_tokens, target_loss and background_loss (means per token) and score.

    ``documents`` and ``target``: those that ``learn`` counted.
    """
    keep = [c for c in documents.columns if c not in ("n_tokens", "target_loss", "background_loss", "score")]
    slices = models.slices

    def run(key: tuple, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        own = _marked(pdf, target)
        c = _Chunk(own, text)
        answers = answers.sort_values("slice")
        total = {m: np.concatenate([unpacked(d, np.uint64) for d in answers[k]] or [np.zeros(0)]).astype(np.float64) for m, k in ((0, "n"), (1, "good"))}
        if len(answers) != slices or len(total[0]) != len(c.keys):
            raise ValueError("these documents are not those that the models counted")
        sums = np.array(answers["sums"].tolist(), np.int64).sum(0)
        words, vocab, same = {0: sums[0], 1: sums[3]}, max(1, sums[6]), not sums[3]
        if same:  # without a target both models are the corpus
            total[1], words[1] = total[0], words[0]
        n = np.bincount(c.doc, minlength=len(own))
        good = (own[target].eq(True) | same).to_numpy(bool)[c.doc].astype(np.int64)
        stands = {k: _own(c.doc, c.at[k]) for k in KINDS}
        mean = []
        for m, counted in ((1, good), (0, 1)):
            u, b, before = (total[m][c.at[k]] - stands[k] * counted for k in KINDS)
            flat = (u + PRIOR) / (words[m] - n[c.doc] * counted + PRIOR * vocab)
            loss = -np.log(LAMBDA * np.where(before > 0, b / np.maximum(before, 1), flat) + (1 - LAMBDA) * flat)
            mean.append(np.bincount(c.doc, loss, len(own)) / np.maximum(n, 1))
        return own[keep].assign(n_tokens=n.astype(np.int64), target_loss=mean[0], background_loss=mean[1], score=mean[0] - mean[1])

    kind = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    both = models.dealt.groupBy("_chunk").cogroup(models.answers.groupBy("chunk"))
    return both.applyInPandas(run, f"{kind}, n_tokens long, target_loss double, background_loss double, score double")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the documents labelled good; the labels go to their documents' chunks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType), F.lit(None).cast("string").alias("text"))
    chunks, slices = _sizes(docs, "text")
    key = F.col("doc_id").cast("string")
    # rows without an id have no label and are dealt out by their texts
    chunk = F.pmod(F.xxhash64(F.coalesce(key, F.col("text"))), F.lit(chunks))
    dealt = _dealt(docs, chunk, F.lit(False), "good", key=key).union(_dealt(good.distinct(), chunk, F.lit(False), "good", label=True, key=key))
    models = Models(dealt, "good", "text", slices)
    return scored(docs, models, "good").select("doc_id", "n_tokens", "target_loss", "background_loss", "score")
