"""Suffix-array dedup: exact repeats of LENGTH bytes, by a distributed merge sort of suffixes.

Every byte under a string of LENGTH bytes that also starts elsewhere is found (and removed).

1. Sparse suffixes. Of each LENGTH-byte window the byte position with the least hash of the next
   GRAM bytes, among the first SPAN positions, is an anchor. Equal windows have their anchor at the
   same offset, so two equal windows show as two suffixes (at the anchors) that agree for at least
   CORE = LENGTH - SPAN + 1 bytes. Nothing is sampled away: each window has its anchor.
2. Distinguishing prefixes. The hashes of the suffixes' first CORE bytes are counted by a shuffle,
   in slices of the hash range whose number grows with the input. Those that stand twice or more
   set a bit of a table that is sized by the input too (up to 2**MOST_BITS bits, which is what is
   broadcast); suffixes whose CORE is unique can't take part in a repeat and are not exchanged.
   (Where so many different COREs repeat that the table fills, unique ones pass as well: more is
   exchanged, with the same result.)
3. Merge sort. Each task sorts its suffixes, front-codes them (common prefix with the one before,
   and the rest) and sends the pieces of its run to the range buckets given by sampled splitters.
   A bucket merges its runs with a loser tree that keeps, for each loser, its common prefix with
   the winner, so that known prefixes are never compared again; the merge yields the order and all
   common-prefix lengths. Equal suffixes with equal left context travel once for each run.
4. Reading repeats off. Neighbours in the order with a common prefix of CORE or more form a class.
   For every pair in a class, left agreement plus right agreement of LENGTH or more is a repeat;
   classes too large for pairs compare their members' windows by hash instead (exact as well).
   Prefixes so frequent that a class could outgrow a task (HOT different contexts) never enter the
   sort: their windows are counted by a shuffled aggregation, by two hashes of 64 bits.

Defined results: null and empty texts have no bytes; texts shorter than LENGTH lose nothing;
repeated rows are copies of each other and lose all they share; matches never cross rows.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, mixed, packed, prefix_hash, range_hash, release, table, unpacked, window_hash

GRAM = 16
#: Bytes of text for each bit of the table of step 2 (an anchor comes about every 60 bytes), its greatest
#: size, and the anchors that a slice of the hash range stands for.
BIT_BYTES, LEAST_BITS, MOST_BITS, SLICE_ANCHORS = 30, 20, 29, 2_000_000
#: Bits of a CORE's hash that are counted.
HASH_BITS = 48
#: Bytes of text for each bucket of the sort, and sampled suffixes for each splitter.
BUCKET_BYTES, SAMPLE, SAMPLE_GROUPS = 32_000_000, 64, 32
#: Classes up to PAIRS distinct members are compared in pairs; prefixes from HOT on skip the sort.
PAIRS, HOT = 32, 60_000
CHUNK_BYTES, RUN_BYTES = 500_000, 4_000_000


class Shape:
    def __init__(self, length: int, pairs: int = PAIRS, hot: int = HOT):
        self.length, self.pairs, self.hot = length, pairs, hot
        self.core = max(GRAM, length * 6 // 25)
        self.span = length - self.core + 1
        self.left = self.span - 1  # bytes of left context that matter


def _sliding(h: np.ndarray, w: int, take=np.minimum, fill=np.uint64(2**64 - 1)) -> np.ndarray:
    """The least (or greatest) of each w neighbours, in two passes."""
    x = np.concatenate([h, np.full((-len(h)) % w, fill, np.uint64)]).reshape(-1, w)
    ahead = take.accumulate(x, axis=1).ravel()
    take.accumulate(x[:, ::-1], axis=1, out=x[:, ::-1])  # x is now the least from each place to its row's end
    return take(x.ravel()[: len(h) - w + 1], ahead[w - 1 : len(h)])


class Chunk:
    """Anchors of some texts, laid end to end."""

    def __init__(self, raw: list[bytes], shape: Shape):
        self.bytes = b"".join(raw)
        self.bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        data = np.frombuffer(self.bytes, np.uint8)
        self.sums = prefix_hash(data)
        n, span, length = len(data), shape.span, shape.length
        self.at = np.empty(0, np.int64)
        if n >= length:
            windows = n - length + 1
            h = mixed(window_hash(self.sums, GRAM)[: windows + span - 1])
            h |= np.uint64(1)
            least = _sliding(h, span)
            for end in self.bounds[1:-1].tolist():  # windows that would cross texts
                least[max(end - length + 1, 0) : end] = 0
            pad = np.zeros(span - 1, np.uint64)
            self.at = np.flatnonzero(h == _sliding(np.concatenate([pad, least, pad]), span, np.maximum, np.uint64(0)))
        self.doc = np.searchsorted(self.bounds, self.at, "right") - 1
        self.lo = np.maximum(self.at - shape.left, self.bounds[self.doc])
        self.hi = np.minimum(self.at + length, self.bounds[self.doc + 1])
        self.core = mixed(range_hash(self.sums, self.at, self.at + shape.core))

    def keep(self, mask: np.ndarray) -> None:
        for name in ("at", "doc", "lo", "hi", "core"):
            setattr(self, name, getattr(self, name)[mask])


def _chunks(parts: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[list, list[bytes]]]:
    """(keys, texts as bytes) of CHUNK_BYTES at most, or one longer text."""
    keys, raw, total = [], [], 0
    for pdf in parts:
        for row in pdf[[*columns, "_t"]].itertuples(index=False, name=None):
            b = (row[-1] or "").encode("utf-8", "surrogatepass")
            if raw and total + len(b) > CHUNK_BYTES:
                yield keys, raw
                keys, raw, total = [], [], 0
            keys.append(row[:-1])
            raw.append(b)
            total += len(b)
    if raw:
        yield keys, raw


# --- step 2: which cores are not unique -----------------------------------------------------


class Table:
    """What all tasks know of the COREs: the bits of those that repeat, the hot ones, and the splitters."""

    def __init__(self, bits: int, data: np.ndarray, hot: np.ndarray, splitters: list[bytes]):
        self.shift, self.data, self.hot, self.splitters = np.uint64(64 - bits), data, hot, splitters

    def split(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Masks of the anchors that are sorted, and of those with a hot CORE."""
        cell = (c.core >> self.shift).astype(np.int64)
        twice = (self.data[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
        near = np.minimum(np.searchsorted(self.hot, cell), max(len(self.hot) - 1, 0))
        is_hot = self.hot[near] == cell if len(self.hot) else np.zeros(len(cell), bool)
        return twice & ~is_hot, is_hot


def core_table(texts: DataFrame, shape: Shape) -> tuple[Table, int]:
    """The table of the texts' COREs, and the number of buckets of the sort."""
    size = texts.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (size // BIT_BYTES).bit_length()))
    slice_bits = min(bits - 3, max(4, (size // 60 // SLICE_ANCHORS).bit_length()))
    buckets = max(4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    cut, to_slice, own_bits = np.uint64(64 - HASH_BITS), np.uint64(HASH_BITS - slice_bits), bits - slice_bits
    sample_size = SAMPLE * buckets // SAMPLE_GROUPS

    def pieces(cores: list, counts: list, ranks: list, heads: list) -> Iterator[pd.DataFrame]:
        core, where = np.unique(np.concatenate(cores), return_inverse=True)
        n = np.bincount(where, np.concatenate(counts)).astype(np.uint32)
        slices, first = np.unique(core >> to_slice, return_index=True)
        ends = np.append(first[1:], len(core))
        body = [packed(np.diff(core[a:b], prepend=np.uint64(0))) for a, b in zip(first, ends, strict=True)]
        yield pd.DataFrame({"slice": slices.astype(np.int64), "rank": 0, "data": body, "n": [packed(n[a:b]) for a, b in zip(first, ends, strict=True)]})
        rank = np.concatenate(ranks)
        some = np.argsort(rank)[:256]
        yield pd.DataFrame({"slice": -1 - (rank[some] % np.uint64(SAMPLE_GROUPS)).astype(int), "rank": rank[some].astype(np.int64), "data": [heads[i] for i in some], "n": b""})

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cores, counts, ranks, heads = [], [], [], []
        for _, raw in _chunks(parts, []):
            c = Chunk(raw, shape)
            if not len(c.at):
                continue
            # what counts is different contexts, since equal ones are settled where they stand; twice the same is 2
            whole = mixed(range_hash(c.sums, c.lo, c.hi) + (c.at - c.lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            first = np.unique(whole, return_index=True)[1]
            core, where = np.unique(c.core >> cut, return_inverse=True)
            cores.append(core)
            counts.append(np.maximum(np.bincount(where[first], minlength=len(core)), np.minimum(np.bincount(where), 2)))
            rank = mixed(c.core + c.at.astype(np.uint64)) >> np.uint64(1)
            some = np.argsort(rank)[:64]
            ranks.append(rank[some])
            heads += [c.bytes[p : p + shape.core] for p in c.at[some].tolist()]
            if sum(map(len, cores)) > 2_000_000:
                yield from pieces(cores, counts, ranks, heads)
                cores, counts, ranks, heads = [], [], [], []
        if cores:
            yield from pieces(cores, counts, ranks, heads)

    def add(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if key[0] < 0:  # the sample: the least ranks
            best: list[tuple[int, bytes]] = []
            for pdf in frames:
                best = sorted([*best, *zip(pdf["rank"], pdf["data"], strict=True)])[:sample_size]
            yield pd.DataFrame({"slice": -1, "bits": [d for _, d in best], "hot": b""})
            return
        cores, counts = [], []
        for pdf in frames:
            cores += [np.cumsum(unpacked(d, np.uint64), dtype=np.uint64) for d in pdf["data"]]
            counts += [unpacked(d, np.uint32) for d in pdf["n"]]
        core, where = np.unique(np.concatenate(cores), return_inverse=True)
        total = np.bincount(where, np.concatenate(counts))
        cell = (core >> np.uint64(HASH_BITS - bits)).astype(np.int64)
        flags = np.zeros(1 << own_bits, bool)
        flags[cell[total > 1] - (key[0] << own_bits)] = True
        hot = np.unique(cell[total >= shape.hot])
        yield pd.DataFrame({"slice": [key[0]], "bits": [zlib.compress(np.packbits(flags).tobytes(), 1)], "hot": [hot.tobytes()]})

    out = np.zeros((1 << slice_bits, 1 << (own_bits - 3)), np.uint8)
    hot, sample = [np.empty(0, np.int64)], []
    counted = texts.select("_t").mapInPandas(count, "slice long, rank long, data binary, n binary")
    for r in counted.groupBy("slice").applyInPandas(add, "slice long, bits binary, hot binary").toLocalIterator():
        if r["slice"] < 0:
            sample.append(bytes(r["bits"]))
        else:
            out[r["slice"]] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
            hot.append(np.frombuffer(r["hot"], np.int64))
    sample.sort()
    splitters = sorted({sample[len(sample) * i // buckets] for i in range(1, buckets)}) if sample else []
    return Table(bits, out.ravel(), np.sort(np.concatenate(hot)), splitters), buckets


# --- step 3: sorted, front-coded runs and their merge ---------------------------------------


def front_coded(keys: list[bytes]) -> tuple[np.ndarray, bytes]:
    """Common prefix of each sorted key with the one before, and what follows it."""
    lcp = np.zeros(len(keys), np.uint16)
    rest = []
    before = b""
    for i, k in enumerate(keys):
        n = common_prefix(before, k, 0)
        lcp[i] = n
        rest.append(k[n:])
        before = k
    return lcp, b"".join(rest)


def common_prefix(x: bytes, y: bytes, known: int) -> int:
    """Length of the common prefix, given that the first ``known`` bytes agree."""
    n = min(len(x), len(y))
    if x[known:n] == y[known:n]:
        return n
    a = int.from_bytes(x[known:n], "big") ^ int.from_bytes(y[known:n], "big")
    return n - (a.bit_length() + 7) // 8


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge sorted runs of (keys, common prefixes): (run, index, common prefix with the one before).

    A loser tree: each inner place holds the run that lost there and its common prefix with the
    run that won. All contenders' prefixes refer to the last key put out, so the longer one wins
    without a look at the bytes; only equal ones are compared, from that byte on.
    """
    k = len(runs)
    total = sum(len(r[0]) for r in runs)
    out_run, out_at, out_lcp = np.empty(total, np.int32), np.empty(total, np.int32), np.zeros(total, np.int32)
    if k == 1:
        out_run[:], out_at[:] = 0, np.arange(total)
        out_lcp[:] = runs[0][1]
        return out_run, out_at, out_lcp
    size = 1 << (k - 1).bit_length()
    keys = [r[0] for r in runs] + [[]] * (size - k)
    lcps = [r[1] for r in runs] + [[]] * (size - k)
    head: list[bytes | None] = [r[0] if r else None for r in keys]
    shared = [0] * size  # each run's common prefix with the last key put out
    place = [0] * size
    loser = [-1] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)."""
        x, y = head[a], head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        h, g = shared[a], shared[b]
        if h > g:
            return a, b
        if g > h:
            return b, a
        n = common_prefix(x, y, h)
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    winners = list(range(size))
    for level in range(size.bit_length() - 2, -1, -1):
        up = []
        for i in range(0, len(winners), 2):
            w, lose = play(winners[i], winners[i + 1])
            loser[(1 << level) + i // 2] = lose
            up.append(w)
        winners = up
    w = winners[0]
    for i in range(total):
        out_run[i], out_at[i], out_lcp[i] = w, place[w], shared[w]
        j = place[w] + 1
        place[w] = j
        if j < len(keys[w]):
            head[w], shared[w] = keys[w][j], lcps[w][j]
        else:
            head[w] = None
        node = (size + w) >> 1
        while node:
            b = loser[node]
            y = head[b]
            if y is not None:
                x = head[w]
                if x is None:
                    loser[node], w = w, b
                else:
                    h, g = shared[w], shared[b]
                    if h < g:
                        loser[node], w = w, b
                    elif h == g:
                        n = common_prefix(x, y, h)
                        if n == len(x) or (n < len(y) and x[n] < y[n]):
                            shared[b] = n
                        else:
                            shared[w] = n
                            loser[node], w = w, b
            node >>= 1
    out_lcp[0] = 0
    return out_run, out_at, out_lcp


HEAD = struct.Struct("<III")


def _pack(keys: list[bytes], right: np.ndarray, owner: np.ndarray, pos: np.ndarray, docs: list[tuple[int, int]]) -> bytes:
    lcp, rest = front_coded(keys)
    used, mine = np.unique(owner, return_inverse=True)  # owner -1: settled inside its run
    names = np.array([docs[u] if u >= 0 else (0, 0) for u in used], np.int64).reshape(-1, 2)
    size = np.array([len(k) for k in keys], np.uint16)
    parts = [lcp.tobytes(), size.tobytes(), right.astype(np.uint16).tobytes(), mine.astype(np.uint32).tobytes(), pos.astype(np.int32).tobytes(), (used < 0).astype(np.uint8).tobytes(), names.tobytes(), rest]
    return HEAD.pack(len(keys), len(used), 0) + zlib.compress(b"".join(parts), 1)


def _unpack(blob: bytes):
    n, m, _ = HEAD.unpack_from(blob)
    body = zlib.decompress(memoryview(blob)[HEAD.size :])
    at = 0

    def take(kind, count):
        nonlocal at
        out = np.frombuffer(body, kind, count, at)
        at += out.nbytes
        return out

    lcp, size, right = take(np.uint16, n), take(np.uint16, n), take(np.uint16, n)
    mine, pos = take(np.uint32, n), take(np.int32, n)
    settled, names = take(np.uint8, m), take(np.int64, 2 * m).reshape(-1, 2)
    keys, before, p = [], b"", at
    lcps = lcp.tolist()
    for h, s in zip(lcps, size.tolist(), strict=True):
        before = before[:h] + body[p : p + s - h]
        p += s - h
        keys.append(before)
    return keys, lcps, right, names[mine], pos, settled[mine].astype(bool)


def _runs(parts: Iterator[pd.DataFrame], shape: Shape, known: Table) -> Iterator[Run]:
    """The task's suffixes, as runs of RUN_BYTES of text at most (or one longer text)."""
    run = Run()
    for keys, raw in _chunks(parts, ["_id", "_tag"]):
        size = sum(map(len, raw))
        if run.size and run.size + size > RUN_BYTES:
            yield run
            run = Run()
        c = Chunk(raw, shape)
        c.keep(known.split(c)[0])
        run.add(keys, c, size)
    yield run


class Run:
    """Distinct suffixes with left context; where the same stands several times, all owners are settled."""

    def __init__(self):
        self.size, self.first, self.docs = 0, {}, []
        self.owner, self.at, self.lo, self.hi = [], [], [], []
        self.settled: set[int] = set()

    def add(self, keys: list, c: Chunk, size: int) -> None:
        self.size += size
        data, back, n = c.bytes, c.bytes[::-1], len(c.bytes)
        base = c.bounds[c.doc]
        self.owner += (c.doc + len(self.docs)).tolist()
        self.docs += keys
        i = len(self.at)
        self.at += (c.at - base).tolist()
        self.lo += (c.lo - base).tolist()
        self.hi += (c.hi - base).tolist()
        for p, lo, hi in zip(c.at.tolist(), c.lo.tolist(), c.hi.tolist(), strict=True):
            # the suffix, then its left context read backwards
            j = self.first.setdefault((data[p:hi] + back[n - p : n - lo], hi - p), i)
            if j != i:
                self.settled |= {i, j}
            i += 1

    def spans(self) -> np.ndarray:
        """(id, tag, start, end) of the settled owners, which need no other run."""
        i = np.array(sorted(self.settled), np.int64)
        names = np.array(self.docs, np.int64).reshape(-1, 2)
        if not len(i):
            return np.empty((0, 4), np.int64)
        return np.column_stack([names[np.array(self.owner)[i]], np.array(self.lo)[i], np.array(self.hi)[i]])

    def pieces(self, splitters: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """(bucket, front-coded piece) of the sorted run."""
        own = sorted((k, r, i) for (k, r), i in self.first.items())
        texts = [k for k, _, _ in own]
        index = np.array([i for _, _, i in own], np.int64)
        right = np.array([r for _, r, _ in own], np.int64)
        pos = np.array(self.at, np.int64)[index] if len(index) else index
        owner = np.array([-1 if i in self.settled else self.owner[i] for i in index.tolist()], np.int64)
        cuts = [0, *(bisect_left(texts, s) for s in splitters), len(texts)]
        for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if y > x:
                yield b, _pack(texts[x:y], right[x:y], owner[x:y], pos[x:y], self.docs)


# --- step 4: repeats of a bucket ------------------------------------------------------------


def _matrix(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(-1, width)


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common head of each pair of rows."""
    differ = x != y
    return np.where(differ.any(1), differ.argmax(1), x.shape[1])


def repeats(keys: list[bytes], right: np.ndarray, lcp: np.ndarray, settled: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """For sorted suffixes with left contexts: how far left and right of the anchor a repeat
    reaches (0, 0 where none does)."""
    n = len(keys)
    size = np.array([len(k) for k in keys])
    left = size - right
    reach_l, reach_r = np.zeros(n, np.int64), np.zeros(n, np.int64)
    # equal suffixes with equal left context: one member stands for all
    same = np.zeros(n, bool)
    same[1:] = (lcp[1:] == size[1:]) & (size[1:] == size[:-1]) & (right[1:] == right[:-1])
    head = np.flatnonzero(~same)
    group = np.cumsum(~same) - 1
    many = (np.bincount(group) > 1) | (np.bincount(group, settled) > 0)
    between = np.minimum.reduceat(lcp, head)  # within a group the first one's prefix is the least
    d_lcp, d_right, d_left = between, right[head], left[head]
    d_l, d_r = np.where(many, d_left, 0), np.where(many, d_right, 0)
    klass = np.cumsum(d_lcp < shape.core) - 1
    members = np.bincount(klass)
    open_class = np.bincount(klass, ~many) > 0
    small = np.flatnonzero(((members > 1) & (members <= shape.pairs) & open_class)[klass])
    if len(small):
        c = klass[small]
        lefts = _matrix([keys[head[i]][d_right[i] :] for i in small], max(shape.left, 1))
        lc = d_lcp[small]
        run = np.full(len(small), 1 << 20)
        for j in range(1, min(shape.pairs, len(small))):
            # the prefix common to x and the j-th after it
            run = np.minimum(run[: len(small) - j], lc[j:])
            ok = np.flatnonzero(c[j:] == c[:-j])
            if not len(ok):
                break
            x, y = small[ok], small[ok + j]
            r = np.minimum(run[ok], np.minimum(np.minimum(d_right[x], d_right[y]), shape.length))
            agree = np.minimum(_agree(lefts[ok], lefts[ok + j]), np.minimum(d_left[x], d_left[y]))
            good = agree + r >= shape.length
            for z in (x[good], y[good]):
                np.maximum.at(d_l, z, agree[good])
                np.maximum.at(d_r, z, r[good])
    for k in np.flatnonzero((members > shape.pairs) & open_class):
        own = np.arange(*np.searchsorted(klass, [k, k + 1]))
        _windows(own, keys, head, d_right, d_left, d_l, d_r, shape)
    return d_l[group], d_r[group]


def _windows(own, keys, head, d_right, d_left, d_l, d_r, shape: Shape) -> None:
    """A large class: count the members' windows, by their offset and hash. Hashes are made for some
    members at a time, since running sums take many times the bytes of the texts."""
    found = np.zeros((shape.span, len(own)), np.uint64)
    ahead = np.arange(shape.span)
    for k in range(0, len(own), 2000):
        some = own[k : k + 2000]
        whole = [keys[head[i]][d_right[i] :][::-1] + keys[head[i]][: d_right[i]] for i in some]
        sums = prefix_hash(np.frombuffer(b"".join(whole), np.uint8))
        anchor = np.concatenate([[0], np.cumsum([len(x) for x in whole])])[:-1] + d_left[some]
        a, i = np.nonzero((d_left[some] >= ahead[:, None]) & (d_right[some] >= shape.length - ahead[:, None]))
        p = anchor[i] - a
        found[a, k + i] = mixed(range_hash(sums, p, p + shape.length) + a.astype(np.uint64)) | np.uint64(1)
    wide = max(1, 300_000 // len(own))  # offsets that are compared at once
    for first in range(0, shape.span, wide):
        a, i = np.nonzero(found[first : first + wide])
        if len(a) < 2:
            continue
        a += first
        _, where, n = np.unique(found[a, i], return_inverse=True, return_counts=True)
        twice = n[where] > 1
        z = own[i[twice]]
        np.maximum.at(d_l, z, a[twice])
        np.maximum.at(d_r, z, shape.length - a[twice])


def _bucket(blobs: list[bytes], shape: Shape) -> np.ndarray:
    """(doc, tag, start, end) rows of the repeats of one bucket."""
    runs = [_unpack(b) for b in blobs]
    run, at, lcp = merge([(r[0], r[1]) for r in runs])
    keys = [runs[a][0][b] for a, b in zip(run.tolist(), at.tolist(), strict=True)]
    base = np.concatenate([[0], np.cumsum([len(r[0]) for r in runs])])[run] + at
    right, name, pos, settled = (np.concatenate([r[i] for r in runs])[base] for i in (2, 3, 4, 5))
    d_l, d_r = repeats(keys, right.astype(np.int64), lcp.astype(np.int64), settled, shape)
    hit = np.flatnonzero((d_l + d_r >= shape.length) & ~settled)
    return np.column_stack([name[hit], pos[hit] - d_l[hit], pos[hit] + d_r[hit]])


def _keyed(documents: DataFrame, id_col: str, text: str) -> list:
    """(_id, _tag, _t): a hash of the text keeps rows apart that have one id and different texts. Ids that
    are no whole numbers are told apart by a hash of theirs."""
    t = F.coalesce(F.col(text), F.lit(""))
    whole = documents.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    number = F.col(id_col).cast("long") if whole else F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col)))
    return [F.coalesce(number, F.lit(-(2**63))).alias("_id"), F.xxhash64(t).alias("_tag"), t.alias("_t")]


def spans(documents: DataFrame, length: int = 200, id_col: str = "doc_id", text: str = "text", pairs: int = PAIRS, hot_from: int = HOT) -> DataFrame:
    """(_id, _tag, s): for each text with repeats the byte ranges under them, as start * 2**32 + end, not yet joined."""
    shape = Shape(length, pairs, hot_from)
    spark = documents.sparkSession
    texts = documents.select(*_keyed(documents, id_col, text)).filter(F.octet_length("_t") >= length)
    known, buckets = core_table(texts, shape)
    state = spark.sparkContext.broadcast(known)
    release(state)

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in _runs(parts, shape, state.value):
            rows = list(run.pieces(state.value.splitters))
            done = run.spans()
            for i in range(0, len(done), 50_000):  # to any bucket: they only pass through
                blob = zlib.compress(done[i : i + 50_000].tobytes(), 1)
                rows.append((-1 - zlib.crc32(blob) % buckets, blob))
            yield pd.DataFrame(rows, columns=["bucket", "blob"])

    def join(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["_id", "_tag", "a", "b"]
        if key[0] < 0:
            for pdf in frames:
                for b in pdf["blob"]:
                    yield pd.DataFrame(np.frombuffer(zlib.decompress(b), np.int64).reshape(-1, 4), columns=names)
            return
        yield pd.DataFrame(_bucket([b for pdf in frames for b in pdf["blob"]], shape), columns=names)

    found = texts.mapInPandas(cut, "bucket int, blob binary").groupBy("bucket").applyInPandas(join, "_id long, _tag long, a long, b long")
    if len(known.hot):
        found = found.union(_hot_spans(texts, shape, state))
    # a span is one long: the frames of Python tasks hold plain arrays
    return found.groupBy("_id", "_tag").agg(F.collect_list(F.shiftleft("a", 32) + F.col("b")).alias("s"))


def _joined(pairs: np.ndarray) -> np.ndarray:
    """Overlapping and touching (start, end) ranges joined, in order."""
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    end = np.maximum.accumulate(pairs[:, 1])
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:, 0] > end[:-1]
    start = np.flatnonzero(new)
    return np.column_stack([pairs[start, 0], end[np.append(start[1:], len(pairs)) - 1]])


def deduplicated(documents: DataFrame, length: int = 200, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(id, n_bytes, spans, kept): the removed byte ranges of each text and its remaining bytes."""
    own = documents.select(F.col(id_col), *_keyed(documents, id_col, text))
    rows = own.join(spans(documents, length, id_col, text, **options).hint("merge"), ["_id", "_tag"], "left").select(id_col, "_t", "s")

    def remove(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(parts, "_t", CHUNK_BYTES):
            out_n, out_spans, out_kept = [], [], []
            for t, s in zip(pdf["_t"], pdf["s"], strict=True):
                b = t.encode("utf-8", "surrogatepass")
                gone = [] if s is None or not len(s) else _joined(np.column_stack([s >> 32, s & 0xFFFFFFFF])).tolist()
                at, kept = 0, []
                for x, y in gone:
                    kept.append(b[at:x])
                    at = y
                out_n.append(len(b))
                out_spans.append([{"start": x, "end": y} for x, y in gone])
                out_kept.append(b"".join([*kept, b[at:]]))
            yield pd.DataFrame({id_col: pdf[id_col], "n_bytes": out_n, "spans": out_spans, "kept": out_kept})

    kind = documents.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(remove, f"`{id_col}` {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def _hot_spans(texts: DataFrame, shape: Shape, state) -> DataFrame:
    """Repeats among windows whose core is hot, by a shuffled count of window hashes."""

    def windows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, raw in _chunks(parts, ["_id", "_tag"]):
            c = Chunk(raw, shape)
            c.keep(state.value.split(c)[1])
            if not len(c.at):
                continue
            n = np.maximum(c.hi - shape.length - c.lo + 1, 0)
            s = np.unique(np.repeat(c.lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            doc = np.searchsorted(c.bounds, s, "right") - 1
            rows = np.array(keys, np.int64).reshape(-1, 2)[doc]
            sums = (c.sums, prefix_hash(np.frombuffer(c.bytes, np.uint8), other=True))
            h, g = (mixed(range_hash(x, s, s + shape.length)).view(np.int64) for x in sums)
            yield pd.DataFrame({"_id": rows[:, 0], "_tag": rows[:, 1], "a": s - c.bounds[doc], "h": h, "g": g})

    rows = texts.mapInPandas(windows, "_id long, _tag long, a long, h long, g long")
    twice = rows.groupBy("h", "g").agg(F.count("*").alias("n")).filter("n > 1").select("h", "g")
    return rows.join(twice, ["h", "g"], "left_semi").select("_id", "_tag", "a", (F.col("a") + shape.length).alias("b"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
