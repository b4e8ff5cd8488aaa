"""Benchmark decontamination with training suffix arrays.

Each shard of the training texts (a batch inside a task) is one array of word numbers, on which a
suffix array is built; every test suffix, cut to the window, is binary-searched in it. Only
suffixes whose window consists of benchmark words enter the array: no other can match. Ranges of
the array give all occurrences, which cover the hit words. A verbatim match begins where a window
occurs and the words before it differ; only such beginnings are paired with places in the items (a
passage that repeats one word has few of them, however many windows), and their lengths are found by
binary search on range hashes. Of each item in a document the longest match is kept.

The benchmark goes to the tasks in blocks of at most BLOCK_WORDS words (or one longer item), of which a
task holds one at a time besides its shard.

Words: A-Z lower-cased, maximal runs of 0-9, a-z and everything above U+007F. Defined results:
null and empty texts have no words; an item without words has no window; repeated items are
items of their own; repeated rows are judged alike; an empty benchmark hits nothing; columns
other than the id and the text are ignored (``decontaminated`` passes them through). Words are
compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, batches, mixed, powers, release, table

WINDOW = 10
#: Words of the benchmark that one pass holds in each task (about 40 bytes a word).
BLOCK_WORDS = 2_000_000
#: Characters of a shard, and pairs of places that are extended at once.
SHARD_CHARS, PAIRS = 500_000, 500_000

MATCH = "struct<item_id:string,item_word:int,doc_word:int,n_words:int>"
SPAN = "struct<start:int,end:int>"
#: What stands before an item's first word and after its last one; no text has it.
EDGE = 0xFFFFFFFF


class Tests:
    """The windows of a block of items: vocabulary, distinct windows by length, and where they occur.

    ``numbers``: all items' word numbers, each item between two EDGEs; places are indices in it.
    """

    def __init__(self, ids: list[str], texts: list[str], window: int = WINDOW):
        w = Words(texts, "alnum")
        counts = np.diff(w.first)
        self.items, self.window = ids, window
        self.vocab, inverse = np.unique(w.hash, return_inverse=True)
        item = np.repeat(np.arange(len(ids)), counts)
        spot = np.arange(len(w.hash)) + item + 1
        self.numbers = np.full(len(w.hash) + len(ids) + 1, EDGE, np.int64)
        self.numbers[spot] = inverse + 1
        self.sums = _sums(self.numbers)
        self.item = np.zeros(len(self.numbers), np.int32)
        self.item[spot] = item
        self.start = w.first[:-1] + np.arange(len(ids)) + 1  # of each item
        self.left = np.append(self.start + counts, 0)[self.item]  # one past the last word of each place's item
        self.by_length = {}
        lengths = np.minimum(counts, window)
        for m in np.unique(lengths[lengths > 0]):
            at = spot[(lengths[item] == m) & (spot + m <= self.left[spot])]
            found, where = np.unique(_keys(self.numbers.astype(">u4"), at, int(m)), return_inverse=True)
            # places by window, then by the word before: those with another word before are two ranges
            rank = where * np.int64(len(self.vocab) + 2) + self._before(self.numbers[at - 1])
            order = np.argsort(rank, kind="stable")
            first = np.searchsorted(where[order], np.arange(len(found) + 1))
            self.by_length[int(m)] = (found, first, rank[order], at[order])

    def _before(self, number: np.ndarray) -> np.ndarray:
        return np.minimum(number, len(self.vocab) + 1)


def _sums(numbers: np.ndarray) -> np.ndarray:
    """Running polynomial sums of word numbers."""
    up, _ = powers(len(numbers) + 1)
    out = np.zeros(len(numbers) + 1, np.uint64)
    np.cumsum(mixed(numbers.astype(np.uint64) + np.uint64(1)) * up[: len(numbers)], out=out[1:])
    return out


def _common(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, least: int, most: np.ndarray) -> np.ndarray:
    """Words that the sequences behind the sums x and y have in common from places a and b on."""
    _, down = powers(max(len(x), len(y)))
    lo, hi = np.full(len(a), least), most.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi + 1) // 2
        same = (x[a + mid] - x[a]) * down[a] == (y[b + mid] - y[b]) * down[b]
        lo, hi = np.where(open_ & same, mid, lo), np.where(open_ & ~same, mid - 1, hi)
    return lo


def _keys(numbers: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """The m words from each place as one big-endian byte string, whose order is that of the words."""
    if not len(at):
        return np.empty(0, f"S{4 * m}")
    return np.ascontiguousarray(numbers[at[:, None] + np.arange(m)]).view(f"S{4 * m}").ravel()


class Shard:
    """Some texts as one array of hashes, searched for one block of the benchmark after the other."""

    def __init__(self, texts):
        self.words = Words(texts, "alnum")
        self.counts = np.diff(self.words.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.spot = np.arange(len(self.doc)) + self.doc + 1  # a place without a word before each text
        self.size = len(self.doc) + len(texts) + 1
        self.text = np.zeros(self.size, np.int64)
        self.text[self.spot] = self.doc
        self.start = self.words.first[:-1] + np.arange(len(texts)) + 1
        self.edges = np.zeros(self.size + 1, np.int64)  # where hits begin and end
        self.best: list[np.ndarray] = []

    def search(self, tests: Tests, block: int) -> None:
        """Mark the words under the block's windows, and find each item's longest match."""
        if not len(tests.vocab) or not len(self.doc):
            return
        near = np.minimum(np.searchsorted(tests.vocab, self.words.hash), len(tests.vocab) - 1)
        ids = np.zeros(self.size, np.int64)  # 0: another word, or no word
        ids[self.spot] = np.where(tests.vocab[near] == self.words.hash, near + 1, 0)
        gaps = np.concatenate([[0], np.cumsum(ids == 0)])
        run_end = np.append(np.flatnonzero(ids == 0), self.size)
        sums, packed = _sums(ids), ids.astype(">u4")
        for m, (windows, first, ranks, places) in tests.by_length.items():
            at = np.flatnonzero(gaps[m:] == gaps[:-m])  # suffixes whose first m words are all benchmark words
            keys = _keys(packed, at, m)
            order = np.argsort(keys, kind="stable")  # the suffix array
            keys = keys[order]
            lo, hi = np.searchsorted(keys, windows, "left"), np.searchsorted(keys, windows, "right")
            seen = np.flatnonzero(hi > lo)
            which, back = _ranges(lo[seen], hi[seen])
            pos, which = at[order][which], seen[back]
            self.edges += np.bincount(pos, minlength=self.size + 1) - np.bincount(pos + m, minlength=self.size + 1)
            # beginnings: places of the window whose word before is another than here
            before = which * np.int64(len(tests.vocab) + 2) + ids[pos - 1]
            a, b = np.searchsorted(ranks, before, "left"), np.searchsorted(ranks, before, "right")
            ends = np.column_stack([first[which], a, b, first[which + 1]])
            n = ends[:, 1] - ends[:, 0] + ends[:, 3] - ends[:, 2]
            some = np.flatnonzero(n)
            for part in np.split(some, np.flatnonzero(np.diff(np.cumsum(n[some]) // PAIRS)) + 1):
                e = ends[part]
                src, back = _ranges(np.concatenate([e[:, 0], e[:, 2]]), np.concatenate([e[:, 1], e[:, 3]]))
                here, there = pos[np.concatenate([part, part])[back]], places[src]
                most = np.minimum(run_end[np.searchsorted(run_end, here)] - here, tests.left[there] - there)
                length = _common(sums, here, tests.sums, there, m, most)
                text, item = self.text[here], tests.item[there]
                self.best.append(_longest(np.column_stack([text, np.full(len(here), block), item, there - tests.start[item], here - self.start[text], length])))

    def found(self) -> tuple[list[np.ndarray], np.ndarray]:
        """For each text its hit ranges (start, end), and all (text, block, item, item word, doc word, length)."""
        hit = np.cumsum(self.edges)[:-1] > 0
        change = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]))).reshape(-1, 2)
        text = self.text[change[:, 0]]
        rows = change - self.start[text][:, None] if len(change) else change
        cut = np.searchsorted(text, np.arange(len(self.counts) + 1))
        return [rows[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)], _longest(np.concatenate([np.zeros((0, 6), np.int64), *self.best]))


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and which range each is of."""
    n = hi - lo
    back = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - (np.cumsum(n) - n)[back] + lo[back], back


def _longest(m: np.ndarray) -> np.ndarray:
    """For each text and item the longest match, the first one in the text (then in the item) on ties."""
    m = m[np.lexsort((m[:, 3], m[:, 4], -m[:, 5], m[:, 2], m[:, 1], m[:, 0]))]
    new = np.ones(len(m), bool)
    new[1:] = (m[1:, :3] != m[:-1, :3]).any(1)
    return m[new]


def blocks_of(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[tuple[list[str], list[str]]]:
    """The items in blocks of at most ``limit`` words (or one longer item), read one by one."""
    ids, texts, total = [], [], 0
    for r in benchmark.select(F.col(item_id).cast("string"), text).toLocalIterator():
        n = len((r[1] or "").split()) + (r[1] or "").count(".")
        if ids and total + n > limit:
            yield ids, texts
            ids, texts, total = [], [], 0
        ids.append(r[0])
        texts.append(r[1])
        total += n
    yield ids, texts


def matches(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Each document with n_words, n_hit, ``hits`` (its ranges of hit words) and ``matches``: of each item
    with a window in it the longest verbatim match (item_id, item_word, doc_word, n_words)."""
    own = [c for c in documents.columns if c not in ("n_words", "n_hit", "hits", "matches")]
    sc = documents.sparkSession.sparkContext
    blocks = []
    for ids, texts in blocks_of(benchmark, item_id, text, block_words):
        blocks.append(sc.broadcast(Tests(ids, texts, window)))
        release(blocks[-1])

    def find(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(rows, text, SHARD_CHARS):
            shard, names = Shard(pdf[text].tolist()), {}
            for k, b in enumerate(blocks):
                tests = b.value
                shard.search(tests, k)
                names[k] = tests.items
                if len(blocks) > 1:
                    release(b)
            ranges, m = shard.found()
            cut = np.searchsorted(m[:, 0], np.arange(len(pdf) + 1))
            rows_ = [[{"item_id": names[k][x], "item_word": a, "doc_word": b, "n_words": n} for _, k, x, a, b, n in m[i:j].tolist()] for i, j in zip(cut[:-1], cut[1:], strict=True)]
            n_hit = [int((r[:, 1] - r[:, 0]).sum()) for r in ranges]
            yield pdf.assign(n_words=shard.counts.astype(np.int64), n_hit=n_hit, hits=[[{"start": a, "end": b} for a, b in r.tolist()] for r in ranges], matches=rows_)

    documents = documents.select(*own)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    return documents.mapInPandas(find, f"{kind}, n_words long, n_hit long, hits array<{SPAN}>, matches array<{MATCH}>")


def decontaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without those that hold a window of the benchmark."""
    return matches(documents, benchmark, **options).filter("n_hit = 0").select(*documents.columns)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = matches(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    items = F.array_sort(F.array_distinct(F.col("matches.item_id")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), F.coalesce(F.array_max(F.col("matches.n_words")), F.lit(0)).cast("long").alias("longest_match"),
    )


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS MATERIALIZED (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark),
win AS MATERIALIZED (SELECT item_id, i, least(len(w), {WINDOW}) AS m, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
dwin AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS k FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
hit AS MATERIALIZED (SELECT doc_id, dwin.i, m, item_id, win.i AS j FROM dwin JOIN win USING (m, k)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id),
run AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, m + count(*) - 1 AS n FROM (SELECT doc_id, item_id, m, i, j, i - row_number() OVER (PARTITION BY doc_id, item_id, m, i - j ORDER BY i) AS g FROM hit) GROUP BY doc_id, item_id, m, i - j, g) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0)::BIGINT AS longest_match
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN run USING (doc_id)
"""
