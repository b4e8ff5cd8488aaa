"""Out-of-fold scores of two small classifiers: distance-weighted neighbours and a two-layer network.

Every row is scored by models that saw no row of its fold; with an episode as the fold this is
leave-one-episode-out. Each fold's models (medians for missing features, means and deviations, the
network's weights) are made from all labelled rows of the other folds, and all rows are scored. Rows stay in
the tasks: medians are found by counting, means and the network's steps by sums over blocks of rows, for up to FOLDS
folds at once, so that the driver holds models and sums alone. Neighbours come from blocks of a fold's rows against blocks of
all labelled rows; a job copies a bounded number of rows, and its shuffle files go when its result is written.

Defined results: null, NaN and infinite features are filled with the fold's training median; a feature that no training
row has plays no part; training rows of one class give that class's score (0 or 1) to the fold; no training
rows give nulls. Rows with a null target are scored and not trained on. Rows at equal distances go by the hash of their key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metric
from .tables import kept

#: Features at most, folds trained at once, tasks of a sum and rows of its blocks: a sum of a network's steps sends at most SUMS * FOLDS models to the driver.
MOST_FEATURES, FOLDS, SUMS, SUM_ROWS = 256, 32, 64, 4096
#: Rows of a block to score and of a block they meet, copies of rows in a job (or one of each row).
BLOCK_ROWS, MET_ROWS, COPIES = 1 << 16, 1 << 17, 1 << 22
#: Bits of a median found in one pass.
DIGIT = 6
#: Layers, passes over the rows, step, weight of the squared weights.
HIDDEN, EPOCHS, STEP, ALPHA, SEED = (32, 16), 200, 0.01, 1e-2, 0


class Scaler:
    """Missing values become the training median; then zero mean and unit deviation."""

    def __init__(self, median: np.ndarray, mean: np.ndarray, dev: np.ndarray, there: np.ndarray):
        self.median, self.mean = median, mean
        self.per = np.where(there, 1 / np.where(dev > 0, dev, 1), 0.0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (filled(x, self.median) - self.mean) * self.per


def filled(x: np.ndarray, median: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(x), x, median)


def ordered(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; 0 and -0 are one."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def doubles(keys: np.ndarray) -> np.ndarray:
    return np.where(keys >> np.uint64(63), keys & np.uint64(2**63 - 1), ~keys).view(np.float64)


def summed(blocks: RDD, f: Callable):
    """The sum of f(fold, y, x) over all blocks of rows; 0 without any."""

    def part(rows: Iterator[tuple]) -> Iterator[np.ndarray]:
        total = None
        for fold, y, x in rows:
            y = np.frombuffer(y)
            got = f(np.frombuffer(fold, np.int32), y, np.frombuffer(x).reshape(len(y), -1))
            total = got if total is None else total + got
        if total is not None:
            yield total

    return sum(blocks.mapPartitions(part).collect())


def medians(blocks: RDD, wave: range, there: np.ndarray) -> np.ndarray:
    """The median of each feature's finite values over the rows of all folds but one, for each fold of ``wave``; ``there``:
    how many these are. The two middle values are found digit by digit, by counts of what lies below."""
    rank = np.stack([np.maximum(there - 1, 0) // 2, there // 2], -1)
    low = np.zeros(rank.shape, np.uint64)
    for shift in range(64 - DIGIT, -DIGIT, -DIGIT):
        step = np.uint64(1 << max(shift, 0))
        digits = np.arange(1, 1 << (DIGIT + min(shift, 0)), dtype=np.uint64)
        cuts = low[..., None] + digits * step

        def below(fold: np.ndarray, y: np.ndarray, x: np.ndarray, cuts=cuts) -> np.ndarray:
            keys, finite, out = ordered(x), np.isfinite(x), np.empty(cuts.shape, np.int64)
            own = [fold == w for w in wave]
            for i in range(x.shape[1]):
                out[:, i] = np.searchsorted(np.sort(keys[finite[:, i], i]), cuts[:, i])
                for n, rows in enumerate(own):
                    out[n, i] -= np.searchsorted(np.sort(keys[rows & finite[:, i], i]), cuts[n, i])
            return out

        low = low + (summed(blocks, below) <= rank[..., None]).sum(-1).astype(np.uint64) * step
    with np.errstate(invalid="ignore", over="ignore"):
        return np.where(there > 0, doubles(low).mean(-1), 0.0)


def scalers(blocks: RDD, wave: range, features: int) -> list[Scaler]:
    """For each fold of ``wave`` the scaler of the other folds' rows."""

    def per_fold(f: Callable) -> np.ndarray:
        def of(fold: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
            return np.stack([f(n, x[fold != w]) for n, w in enumerate(wave)])

        return summed(blocks, of) + np.zeros((len(wave), features))

    there = per_fold(lambda n, x: np.isfinite(x).sum(0)).astype(np.int64)
    count = np.maximum(per_fold(lambda n, x: np.full(features, len(x))), 1)
    median = medians(blocks, wave, there)
    mean = per_fold(lambda n, x: filled(x, median[n]).sum(0)) / count
    dev = np.sqrt(per_fold(lambda n, x: ((filled(x, median[n]) - mean[n]) ** 2).sum(0)) / count)
    return [Scaler(*a) for a in zip(median, mean, dev, there > 0, strict=True)]


def _shaped(flat: np.ndarray, features: int) -> list[np.ndarray]:
    sizes, out, at = [features, *HIDDEN, 1], [], 0
    for a, b in zip(sizes, sizes[1:], strict=False):
        out += [flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]]
        at += a * b + b
    return out


def _flat(params: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([p.ravel() for p in params])


def _start(features: int) -> tuple[np.ndarray, np.ndarray]:
    """Drawn weights and zero offsets, and which of them are weights."""
    draw, params, weights = np.random.default_rng(SEED), [], []
    sizes = [features, *HIDDEN, 1]
    for a, b in zip(sizes, sizes[1:], strict=False):
        edge = np.sqrt(6 / (a + b))
        params += [draw.uniform(-edge, edge, (a, b)), np.zeros(b)]
        weights += [np.ones((a, b)), np.zeros(b)]
    return _flat(params), _flat(weights)


def descent(start: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """EPOCHS steps of Adam."""
    params, first, second = start, np.zeros_like(start), np.zeros_like(start)
    for step in range(1, EPOCHS + 1):
        g = gradient(params)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        params = params - STEP * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return params


def slope(flat: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The slope of the log loss, summed over the rows."""
    params = _shaped(flat, x.shape[1])
    layers, grads = _forward(params, x), []
    back = _logistic(layers[-1]) - y[:, None]
    for i in range(len(params) - 2, -1, -2):
        grads = [layers[i // 2].T @ back, back.sum(0), *grads]
        if i:
            back = (back @ params[i].T) * (layers[i // 2] > 0)
    return _flat(grads)


def network(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Weights and offsets of each layer, by whole-sample Adam steps on the log loss."""
    start, weights = _start(x.shape[1])
    return _shaped(descent(start, lambda p: (slope(p, x, y) + ALPHA * weights * p) / len(x)), x.shape[1])


def networks(blocks: RDD, wave: range, scale: list[Scaler], count: np.ndarray, features: int) -> np.ndarray:
    """``network`` of all rows of the other folds, for each fold of ``wave``: a step's slopes are summed where the rows are."""
    start, weights = _start(features)

    def gradient(params: np.ndarray) -> np.ndarray:
        def of(fold: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
            return np.stack([slope(p, s(x[fold != w]), y[fold != w]) for w, s, p in zip(wave, scale, params, strict=True)])

        return (summed(blocks, of) + ALPHA * weights * params) / count[:, None]

    return descent(np.tile(start, (len(wave), 1)), gradient)


def _forward(params: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    layers = [x]
    for i in range(0, len(params), 2):
        z = layers[-1] @ params[i] + params[i + 1]
        layers.append(np.maximum(z, 0) if i + 2 < len(params) else z)
    return layers


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def shares(d: np.ndarray, known: np.ndarray, ks) -> list[np.ndarray]:
    """For each k the share of class 1 among the first k of each row, weighted by 1 / distance; those at distance 0, if any,
    decide alone. Distances are in order."""
    out = []
    for k in ks:
        near = d[:, :k]
        same = near == 0
        w = np.where(same.any(1)[:, None], same.astype(float), 1 / np.where(same, 1, near))
        with np.errstate(invalid="ignore"):
            out.append((w * known[:, :k]).sum(1) / w.sum(1))
    return out


def neighbours(train: np.ndarray, y: np.ndarray, x: np.ndarray, ks) -> list[np.ndarray]:
    """``shares`` among the k nearest of ``train``. Ties go to the earlier row."""
    most = min(max(ks), len(train))
    i, j, d = metric.compared(x, np.zeros(len(x)), train, np.ones(len(train)), np.arange(len(train)), most)
    order = np.lexsort((j, d, i))
    at = order.reshape(len(x), most)
    return shares(d[at], y[j[at]], ks)


def out_of_fold(rows: DataFrame, features, target: str, fold: str, key, ks=(5, 7, 11), block: int = BLOCK_ROWS) -> DataFrame:
    """(key, fold, target, knn<k> for each k, mlp): scores from 0 to 1 for a target of 0 or 1.

    ``key`` names the rows; ``block``: rows that are scored in one task.
    """
    features, key, ks = list(features), list(key), list(ks)
    if len(features) > MOST_FEATURES:
        raise ValueError(f"{len(features)} features, at most {MOST_FEATURES}")
    spark, most = rows.sparkSession, max(ks)
    base = rows.select(F.struct(*key).alias("_key"), F.col(fold).alias("_own"), F.col(fold).cast("string").alias("_fold"), F.col(target).cast("double").alias("_y"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features]).alias("_x"))
    base = base.withColumns({"_id": F.monotonically_increasing_id(), "_h": F.xxhash64("_key")})

    def packed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            if len(b):
                yield b.set_column(b.schema.get_field_index("_x"), "_x", metric._packed(metric._matrix(b.column("_x"))))

    kinds = ", ".join(f"{f.name} {'binary' if f.name == '_x' else f.dataType.simpleString()}" for f in base.schema.fields)
    base = kept(base.mapInArrow(packed, kinds), "folds-rows")
    counts = base.groupBy("_fold").agg(F.count("*").alias("rows"), F.count("_y").alias("known"), F.sum("_y").alias("ones")).collect()
    counts.sort(key=lambda r: (r["_fold"] is None, r["_fold"]))
    code = {r["_fold"]: n for n, r in enumerate(counts)}
    known, ones = np.array([r["known"] for r in counts], int), np.array([r["ones"] or 0 for r in counts])
    total, one = int(known.sum()), ones.sum()

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(_code=np.array([code[None if f is None else f] for f in pdf["_fold"]], np.int32))

    base = kept(base.mapInPandas(coded, f"{kinds}, _code int").drop("_fold"), "folds-coded")

    def blocked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for n in range(0, len(pdf), SUM_ROWS):
                d = pdf.iloc[n : n + SUM_ROWS]
                yield pd.DataFrame({"fold": [d["_code"].to_numpy(np.int32).tobytes()], "y": [d["_y"].to_numpy(float).tobytes()], "x": [b"".join(d["_x"])]})

    tasks = min(2 * spark.sparkContext.defaultParallelism, math.ceil(total / SUM_ROWS), SUMS) or 1
    blocks = base.filter("_y is not null").select("_code", "_y", "_x").mapInPandas(blocked, "fold binary, y binary, x binary").coalesce(tasks).rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
    out = None
    for first in range(0, len(counts), FOLDS):
        wave = range(first, min(first + FOLDS, len(counts)))
        others, positive = total - known[wave.start : wave.stop], one - ones[wave.start : wave.stop]
        scale = scalers(blocks, wave, len(features))
        two = (positive > 0) & (positive < others)
        nets = networks(blocks, wave, scale, np.maximum(others, 1), len(features)) if two.any() else None
        asked = base.filter(F.col("_code").between(wave.start, wave.stop - 1))
        near = _nearest(base.filter("_y is not null"), asked, wave, [r["rows"] for r in counts[wave.start : wave.stop]], scale, total, most, block)
        scored = _scored(asked.join(near, "_id", "left"), wave, scale, nets, others, positive, ks)
        out = scored if out is None else out.unionByName(scored)
    blocks.unpersist()
    names = [f"knn{k}" for k in ks] + ["mlp"]
    if out is None:
        out = base.select("*", *[F.lit(None).cast("double").alias(n) for n in names])
    nan = [F.when(~F.isnan(n), F.col(n)).alias(n) for n in names]
    return out.select(*[F.col(f"_key.{k}").alias(k) for k in key], *([] if fold in key else [F.col("_own").alias(fold)]), F.col("_y").alias(target), *nan)


def _nearest(train: DataFrame, asked: DataFrame, wave: range, sizes: list[int], scale: list[Scaler], total: int, most: int, block: int) -> DataFrame:
    """(_id, d, known): of each row asked the distances and targets of the ``most`` nearest rows of other folds, padded with
    infinite distances. A task compares a block of one fold with a block of rows."""
    across = max(math.ceil(total / MET_ROWS), 1)
    down = [math.ceil(n / block) for n in sizes]
    start = np.concatenate([[0], np.cumsum(down)]).tolist()
    of = [w for w, n in zip(wave, down, strict=True) for _ in range(n)]
    own = F.col("_code") - wave.start
    asked = asked.withColumn("_unit", F.lit(start)[own] + F.pmod(F.xxhash64("_id"), F.lit(down)[own]).cast("int"))
    train = train.withColumn("_met", F.pmod(F.xxhash64("_h"), F.lit(across)).cast("int"))
    units = max(COPIES // max(total, 1), 1)

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        i, j, d = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        if a.num_rows and b.num_rows:
            to = scale[of[a["_unit"][0].as_py()] - wave.start]
            rank = np.empty(b.num_rows, int)
            rank[np.argsort(b["_h"].to_numpy(), kind="stable")] = np.arange(b.num_rows)
            i, j, d = metric.compared(to(metric._unpacked(a["_x"])), np.zeros(a.num_rows), to(metric._unpacked(b["_x"])), np.ones(b.num_rows), rank, most)
        at = pa.array(j, pa.int64())
        return pa.table({"_id": a["_id"].take(pa.array(i, pa.int64())), "d": pa.array(d), "_h": b["_h"].take(at), "y": b["_y"].take(at)})

    found = None
    for first in range(0, len(of), units):
        some = range(first, min(first + units, len(of)))
        a = asked.filter(F.col("_unit").between(some.start, some.stop - 1)).select("_unit", F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("_met"), "_id", "_x")
        b = train.select(F.explode(F.sequence(F.lit(some.start), F.lit(some.stop - 1))).alias("_unit"), "_met", "_code", "_h", "_y", "_x").filter(F.lit(of)[F.col("_unit")] != F.col("_code")).drop("_code")
        pairs = a.groupBy("_unit", "_met").cogroup(b.groupBy("_unit", "_met")).applyInArrow(compare, "_id long, d double, _h long, y double")
        best = pairs.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("d", "_h", "y"))).alias("n"))
        padded = lambda c, rest: F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.coalesce(F.get("n", i)[c], F.lit(rest)))
        part = kept(best.select("_id", padded("d", math.inf).alias("d"), padded("y", 0.0).alias("known")), "folds-near")
        found = part if found is None else found.unionByName(part)
    return found


def _scored(rows: DataFrame, wave: range, scale: list[Scaler], nets: np.ndarray | None, others: np.ndarray, positive: np.ndarray, ks) -> DataFrame:
    """The rows with their scores by both models of their fold."""
    names = [f"knn{k}" for k in ks] + ["mlp"]

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for w, own in pdf.groupby("_code"):
                n, out = int(w) - wave.start, own[["_key", "_own", "_y"]].copy()
                if positive[n] in (0, others[n]):
                    yield out.assign(**dict.fromkeys(names, positive[n] / others[n] if others[n] else math.nan))
                    continue
                for k, share in zip(ks, shares(np.stack(own["d"]), np.stack(own["known"]), ks), strict=True):
                    out[f"knn{k}"] = share
                x = np.frombuffer(b"".join(own["_x"])).reshape(len(own), -1)
                out["mlp"] = _logistic(_forward(_shaped(nets[n], x.shape[1]), scale[n](x))[-1][:, 0])
                yield out

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("_key", "_own", "_y"))
    return rows.select("_key", "_own", "_y", "_code", "_x", "d", "known").mapInPandas(score, f"{kinds}, {', '.join(f'{n} double' for n in names)}")


def model_scores(scored: DataFrame, target: str, models) -> DataFrame:
    """(model, rows, balanced_accuracy, auc, recall_1, recall_0) of the rows that have a target and scores, a score of
    0.5 or more being class 1; measures of a class without rows are null."""
    long = scored.filter(F.col(target).isNotNull()).select((F.col(target) == 1).alias("g"), F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in models])).alias("m")).select("g", "m.model", "m.score").filter("score is not null")
    # ranks of equal scores are shared: counts by score, then a running sum over the scores of a model
    tied = kept(long.groupBy("model", "score").agg(F.count_if("g").alias("n1"), F.count_if(~F.col("g")).alias("n0")), "score-counts")
    from .stats import running

    r = running(tied, ["model"], "score", {"a": F.sum("n1"), "b": F.sum("n0")})
    per = r.groupBy("model").agg(
        F.sum(F.col("a") * (F.col("b_below") + F.col("b") / 2)).alias("u"), F.sum("a").alias("p"), F.sum("b").alias("n"),
        F.sum(F.when(F.col("score") >= 0.5, F.col("a")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("score") < 0.5, F.col("b")).otherwise(0)).alias("tn"),
    )
    one, zero = F.try_divide("tp", "p"), F.try_divide("tn", "n")
    return per.select("model", (F.col("p") + F.col("n")).alias("rows"), ((one + zero) / 2).alias("balanced_accuracy"), F.try_divide("u", F.col("p") * F.col("n")).alias("auc"), one.alias("recall_1"), zero.alias("recall_0"))
