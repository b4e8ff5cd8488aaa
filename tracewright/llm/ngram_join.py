"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is its set of distinct word shingles (64-bit hashes). Documents with the same set form
a class; classes are joined. Shingles are ordered rarest first by a count table of a fixed size
with logarithmic counts: where a corpus fills it, rare shingles look alike but frequent ones still
stand out (any common order is correct; a good one saves work). Two sets of similarity t share at least l
shingles of their prefixes of |x| - ceil(t |x|) + l; l is chosen for each class by the number of
candidates that its plain prefix would give, so expensive documents get longer prefixes and ask
for as many more shared shingles before verification, which intersects the whole sets.

Candidates come in steps that keep large groups of near copies from giving all pairs. First each
class is verified against one leader, the class with most shared prefix shingles among those that
lead its postings. Then members of one leader's group that it does not connect are compared by
the few shingles in which they differ from it, under the prefix rule again. At last pairs of
different leaders that are not yet connected are formed within a posting, by bands of set sizes. No
link between different components can be lost: every pair is verified, already connected, or ruled
out by a prefix rule.

Defined results: null texts and texts without words have the empty set and link with nothing;
with fewer words than a shingle the whole sequence is one shingle; repeated rows and equal sets
are one class; rows of one id with different texts are documents of their own (each links by its own
text), and so are rows without an id; ids may be of any type with an order; other columns are ignored
by ``linked`` and pass through ``deduplicated``, where a row repeated with id and text is one row.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, batches, mixed, release, table, written
from .components import components

#: Places of the count table (one saturating byte each) and the longest multi-match.
COUNT_BITS, SLICE_BITS = 26, 19
MOST_MATCHES = 4
#: A class asks for one more match each time its candidates double beyond this.
CHEAP = 32
#: Documents for which one file of an intermediate table is written.
DOCS_PER_FILE = 4096
BATCH_CHARS = 500_000


def shingles(texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, sorted by text and hash."""
    w = Words(texts, "blank")
    counts = np.diff(w.first)
    doc = np.repeat(np.arange(len(texts)), counts)
    left = w.first[1:][doc] - np.arange(len(doc))  # words from here to the text's end
    own = np.minimum(counts, width)[doc]
    at = np.flatnonzero((left >= own) & (own > 0))
    at = at[(own[at] == width) | (np.arange(len(doc)) == w.first[:-1][doc])[at]]
    h = own[at].astype(np.uint64)
    for i in range(width):
        there = i < own[at]
        h = np.where(there, mixed(h * np.uint64(0x9E3779B97F4A7C15) + w.hash[np.minimum(at + i, max(len(w.hash) - 1, 0))]), h)
    d = doc[at]
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[keep], h[keep]


class Counts:
    """The count table as compressed slices, which is how it is held in the driver and sent; a process that
    reads it unpacks it once."""

    def __init__(self, slices: dict[int, bytes], shape: tuple[int, int]):
        self.slices, self.shape, self.unpacked = slices, shape, None

    def table(self) -> np.ndarray:
        if self.unpacked is None:
            out = np.zeros(self.shape, np.uint8)
            for i, data in self.slices.items():
                out[i] = np.frombuffer(zlib.decompress(data), np.uint8)
            self.slices, self.unpacked = {}, out.ravel()
        return self.unpacked


def count_table(documents: DataFrame, width: int, text: str) -> Counts:
    """Eight times the logarithm of how many documents hold a shingle of each place: a table of
    2**COUNT_BITS bytes. (A task counts up to 255; sums over tasks have no limit.)"""
    shift = np.uint64(64 - COUNT_BITS)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << COUNT_BITS, np.uint8)
        for pdf in batches(parts, text, BATCH_CHARS):
            place, n = np.unique((shingles(pdf[text].tolist(), width)[1] >> shift).astype(np.int64), return_counts=True)
            total[place] = np.minimum(total[place] + n, 255)
        cut = total.reshape(-1, 1 << SLICE_BITS)
        for i in np.flatnonzero(cut.any(1)):
            yield pd.DataFrame({"slice": [int(i)], "data": [zlib.compress(cut[i].tobytes(), 1)]})

    def add(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << SLICE_BITS, np.int64)
        for pdf in frames:
            for d in pdf["data"]:
                total += np.frombuffer(zlib.decompress(d), np.uint8)
        yield pd.DataFrame({"slice": [key[0]], "data": [zlib.compress(np.minimum(8 * np.log2(total + 1), 255).astype(np.uint8).tobytes(), 1)]})

    kind = "slice int, data binary"
    # written first: the counts of the tasks, many times the table, are shuffled and gone before it is read
    made = written(documents.select(text).mapInPandas(count, kind).groupBy("slice").applyInPandas(add, kind), "counts")
    return Counts({r["slice"]: bytes(r["data"]) for r in made.toLocalIterator()}, (1 << (COUNT_BITS - SLICE_BITS), 1 << SLICE_BITS))


def _keyed(documents: DataFrame, id_col: str, text: str) -> DataFrame:
    """The documents with (_k1, _k2), 96 bits of id and text: what tells rows apart."""
    return documents.withColumns({"_k1": F.xxhash64(id_col, F.coalesce(F.col(text), F.lit(""))), "_k2": F.hash(F.col(id_col), F.octet_length(text))})


def signatures(documents: DataFrame, counts: Broadcast, width: int, num: int, den: int, id_col: str, text: str) -> DataFrame:
    """(doc_id, k1, k2, n, h1, h2, prefix): set size, set fingerprint, and the longest prefix, rarest first by ``counts``."""
    shift = np.uint64(64 - COUNT_BITS)

    def sign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(parts, text, BATCH_CHARS):
            d, h = shingles(pdf[text].tolist(), width)
            first = np.searchsorted(d, np.arange(len(pdf) + 1))
            n = np.diff(first)
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h ^ np.uint64(salt)), dtype=np.uint64)]) for salt in (0x1234567, 0x7654321)]
            h1, h2 = ((s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)
            order = np.lexsort((h, counts.value.table()[(h >> shift).astype(np.int64)], d))
            h = h[order].view(np.int64)
            most = n - -(-num * n // den) + np.minimum(MOST_MATCHES, -(-num * n // den))
            yield pd.DataFrame({"doc_id": pdf[id_col], "k1": pdf["_k1"], "k2": pdf["_k2"], "n": n.astype(np.int64), "h1": h1, "h2": h2, "prefix": [h[a : a + k] for a, k in zip(first[:-1], most, strict=True)]})

    kind = documents.schema[id_col].dataType.simpleString()
    return _keyed(documents.select(id_col, text), id_col, text).mapInPandas(sign, f"doc_id {kind}, k1 long, k2 int, n long, h1 long, h2 long, prefix array<long>")


def _sets(documents: DataFrame, reps: DataFrame, width: int, id_col: str, text: str) -> DataFrame:
    """(rep, s): the whole shingle sets of the documents named by (rep, k1, k2)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in batches(parts, text, BATCH_CHARS):
            # repeated rows stand side by side after the join; one of them is enough (more would do no harm)
            pdf = pdf[pdf["rep"].ne(pdf["rep"].shift(fill_value=last))].reset_index(drop=True) if last is not None else pdf[pdf["rep"].ne(pdf["rep"].shift())].reset_index(drop=True)
            if not len(pdf):
                continue
            last = pdf["rep"].iloc[-1]
            d, h = shingles(pdf[text].tolist(), width)
            first = np.searchsorted(d, np.arange(len(pdf) + 1))
            yield pd.DataFrame({"rep": pdf["rep"], "s": [h[a:b].view(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]})

    named = reps.select("rep", F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
    own = _keyed(documents.select(id_col, text), id_col, text).select("_k1", "_k2", text).join(named.hint("merge"), ["_k1", "_k2"]).select("rep", text)
    return own.mapInPandas(run, "rep long, s array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) pairs with den * |intersection| >= num * |union|."""
    both = pairs.join(sets.withColumnRenamed("rep", "a").withColumnRenamed("s", "sa"), "a").join(sets.withColumnRenamed("rep", "b").withColumnRenamed("s", "sb"), "b")
    common = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("sum"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    return common.filter(den * F.col("common") >= num * (F.col("sum") - F.col("common"))).select("a", "b")


def _against_leader(led: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(rep, lead, n, lead_n, more, less, linked): each class with a leader that shares half of both,
    and the shingles that it has more and less than the leader."""
    both = led.join(sets.select("rep", "s"), "rep").join(sets.select(F.col("rep").alias("lead"), F.col("s").alias("t")), "lead")
    out = both.select("rep", "lead", F.size("s").alias("n"), F.size("t").alias("lead_n"), F.sort_array(F.array_except("s", "t")).alias("more"), F.sort_array(F.array_except("t", "s")).alias("less"))
    common = F.col("n") - F.size("more")
    out = out.filter(3 * common >= F.col("n") + F.col("lead_n"))
    return out.withColumn("linked", den * common >= num * (F.col("lead_n") + F.size("more")))


def _within_groups(star: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between members of one leader's group of which at most one is linked to the leader.

    With D(x) the shingles in which x and the leader differ, x and y differ in D(x) + D(y) less
    twice the shared ones, and they are similar where that is at most share * (|x| + |y|). If x is
    not linked to the leader this asks for shared elements of D, so the prefix rule applies to the
    D's (additions, mostly of one text alone, come first): what a group has in common never meets.
    """
    share = (den - num) / (den + num)
    d = F.concat("more", "less")
    s = star.select("rep", "lead", "n", "lead_n", "linked", d.alias("d"), F.size(d).alias("k"))
    open_groups = s.filter("not linked").select("lead").distinct()
    s = s.join(open_groups, "lead", "left_semi")
    # an element of D that no other member of the group has can't be shared: only the others are compared, rarest first
    tokens = s.select("rep", "lead", F.explode("d").alias("token"))
    often = tokens.groupBy("lead", "token").agg(F.count("*").alias("c")).filter("c > 1")
    common = tokens.join(often, ["lead", "token"]).groupBy("rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "token"))), lambda x: x["token"]).alias("p"))
    s = s.join(common, "rep").withColumn("kp", F.size("p"))
    free = F.col("k") - share * F.col("n")
    # the least number of shared elements: with a linked partner, and with an unlinked one
    to_linked = F.greatest(F.lit(1), F.ceil((F.col("k") - share * (F.col("n") + F.col("lead_n"))) / (1 + share) - 1e-6))
    to_unlinked = F.greatest(F.lit(1), F.floor((free + share * F.col("lead_n")) / 2 - 1e-6))
    cut = lambda least: F.slice("p", 1, F.greatest(F.col("kp") - least + 1, F.lit(0)).cast("int"))
    roles = F.when(F.col("linked"), F.array(F.struct(F.lit("UL").alias("role"), F.lit(1).alias("side"), cut(to_unlinked).alias("p"))))
    roles = roles.otherwise(F.array(F.struct(F.lit("UL").alias("role"), F.lit(0).alias("side"), cut(to_linked).alias("p")), F.struct(F.lit("UU").alias("role"), F.lit(0).alias("side"), cut(to_unlinked).alias("p"))))
    keys = s.select("rep", "lead", "n", "k", "kp", F.explode(roles).alias("r")).select("rep", "lead", "n", "k", "kp", "r.role", "r.side", F.explode("r.p").alias("token"))
    x, y = (keys.select("lead", "role", "token", *[F.col(v).alias(f"{v}_{c}") for v in ("rep", "side", "n", "k", "kp")]) for c in "xy")
    # and no more than all of the shorter one's can be shared
    least_left = F.col("k_x") + F.col("k_y") - 2 * F.least("kp_x", "kp_y")
    ordered = ((F.col("role") == "UU") & (F.col("rep_x") < F.col("rep_y"))) | ((F.col("role") == "UL") & (F.col("side_x") < F.col("side_y")))
    pairs = x.join(y, ["lead", "role", "token"]).filter(ordered & ((den + num) * least_left <= (den - num) * (F.col("n_x") + F.col("n_y")))).select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b")).distinct()
    one = lambda c, m: star.select(F.col("rep").alias(c), F.col("n").alias(f"n_{m}"), d.alias(f"d_{m}"))
    both = pairs.join(one("a", "x"), "a").join(one("b", "y"), "b")
    differ = F.size("d_x") + F.size("d_y") - 2 * F.size(F.array_intersect("d_x", "d_y"))
    return both.filter((den + num) * differ <= (den - num) * (F.col("n_x") + F.col("n_y"))).select("a", "b")


def _linked(documents: DataFrame, width: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, k1, k2, n, head): each row with the least (none, doc_id, k1, k2) that its links reach."""
    counts = documents.sparkSession.sparkContext.broadcast(count_table(documents, width, text))
    release(counts)
    signed = written(signatures(documents, counts, width, num, den, id_col, text), "signed")
    counts.destroy()  # with its files on the driver and the executors
    files = -(-signed.count() // DOCS_PER_FILE) or 1  # tables of one row a document or a few more, whatever the shuffles are cut into
    head = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    classes = signed.filter("n > 0").groupBy("h1", "h2").agg(F.min(F.struct(head.alias("head"), "n", "prefix")).alias("m"), F.count("*").alias("docs"))
    # classes are numbered: compact keys for what follows, whatever the ids are
    classes = written(classes.select("h1", "h2", F.monotonically_increasing_id().alias("rep"), "m.head", "m.n", "m.prefix", "docs"), "classes", files)
    least = F.ceil(F.lit(num) * F.col("n") / F.lit(den)).cast("int")  # shingles of x that a partner must share
    posted = classes.select(F.col("rep"), F.col("n"), F.posexplode("prefix").alias("place", "token"))
    lists = posted.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1")
    posted = written(posted.join(lists, "token").select("token", "rep", "n", "place", "size"), "posted", files)

    # the number of candidates of the plain prefix decides how many matches a class asks for
    plain = F.col("n") - least
    cost = posted.groupBy("rep").agg(F.sum(F.when(F.col("place") <= plain, F.col("size") - 1).otherwise(0)).alias("cost"), F.count("*").alias("support"))
    posted = posted.join(cost, "rep")
    matches = F.least(F.lit(MOST_MATCHES), F.greatest(F.lit(1), 1 + F.floor(F.log2(F.greatest(F.col("cost") / CHEAP, F.lit(1.0)))).cast("int")), least)
    posted = posted.withColumn("matches", matches).filter(F.col("place") < plain + F.col("matches"))
    posted = written(posted.select("token", "rep", "n", "place", "matches", "support"), "postings", files)

    open_classes = classes.select("rep", "head.k1", "head.k2").join(posted.select("rep").distinct(), "rep", "left_semi")
    sets = written(_sets(documents, open_classes, width, id_col, text), "sets", files)

    # each class against one leader, the class with most shared prefix shingles
    leads = posted.groupBy("token").agg(F.max_by(F.struct(F.col("rep").alias("lead"), F.col("n").alias("lead_n")), F.struct("support", -F.col("rep"))).alias("l"))
    near = lambda a, b: den * F.least(a, b) >= num * F.greatest(a, b)
    led = posted.join(leads, "token").select("rep", "n", "l.*").filter((F.col("rep") != F.col("lead")) & near(F.col("n"), F.col("lead_n")))
    led = led.groupBy("rep", "lead").agg(F.count("*").alias("c")).groupBy("rep").agg(F.max_by("lead", F.struct("c", -F.col("lead"))).alias("lead"))
    star = written(_against_leader(led, sets, num, den), "star", files)
    links = star.filter("linked").select(F.col("rep").alias("a"), F.col("lead").alias("b"))
    joined = components(links, "a", "b")

    # members of one leader's group that are not connected through it: compared by what differs from the leader
    links = links.union(_within_groups(star, num, den))

    # what else shares prefix shingles, unless connected or of one leader's group
    at = posted.join(joined.withColumnRenamed("vertex", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    at = at.join(star.select("rep", "lead"), "rep", "left").withColumn("lead", F.coalesce("lead", "rep"))
    open_lists = at.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("lead").alias("lo_lead"), F.max("lead").alias("hi_lead")).filter("lo < hi and lo_lead < hi_lead").select("token")
    at = at.join(open_lists, "token", "left_semi")
    # partners' sizes differ by a factor of den / num at most: a frequent shingle's list is cut by bands of sizes
    band = F.log(F.col("n").cast("double")) / math.log(den / num)
    x, y = (at.select("token", band.alias(f"band_{k}"), *[F.col(c).alias(f"{c}_{k}") for c in ("rep", "n", "place", "matches", "component", "lead")]) for k in "xy")
    x = x.withColumn("band", F.explode(F.sequence(F.floor(F.col("band_x") - 1e-6), F.floor(F.col("band_x") + 1 + 1e-6))))
    y = y.withColumn("band", F.floor("band_y"))
    smaller = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("rep_x") < F.col("rep_y")))
    pairs = x.join(y, ["token", "band"]).filter(smaller & (F.col("component_x") != F.col("component_y")) & (F.col("lead_x") != F.col("lead_y")) & near(F.col("n_x"), F.col("n_y")))
    # from the first shared shingle on, no more than the shorter rest can be shared
    rest = F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y"))
    pairs = pairs.groupBy(F.col("rep_x").alias("a"), F.col("rep_y").alias("b")).agg(F.count("*").alias("c"), F.min(F.least("matches_x", "matches_y")).alias("k"), F.max(rest).alias("rest"), F.first(F.col("n_x") + F.col("n_y")).alias("sum"))
    pairs = pairs.filter((F.col("c") >= F.col("k")) & ((den + num) * F.col("rest") >= num * F.col("sum")))
    links = written(links.union(_verified(pairs.select("a", "b"), sets, num, den)), "links", files)
    joined = components(links, "a", "b")

    whole = classes.select("h1", "h2", "rep", "docs", "head").join(joined.withColumnRenamed("vertex", "rep"), "rep", "left")
    whole = whole.filter("docs > 1 or component is not null").withColumn("component", F.coalesce("component", "rep"))
    heads = whole.groupBy("component").agg(F.min("head").alias("head"))
    whole = whole.select("h1", "h2", "component").join(heads, "component").drop("component")
    out = signed.select("doc_id", "k1", "k2", "n", "h1", "h2").join(whole, ["h1", "h2"], "left")
    return out.select("doc_id", "k1", "k2", "n", F.when(F.col("n") > 0, F.coalesce("head", head)).otherwise(head).alias("head"))


def linked(documents: DataFrame, width: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): documents link at Jaccard similarity num / den or more;
    component_id is the least id that links reach (null where none of them has an id)."""
    return _linked(documents, width, num, den, id_col, text).select("doc_id", F.col("n").alias("n_shingles"), F.col("head.doc_id").alias("component_id"))


def deduplicated(documents: DataFrame, width: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component: the one with the least id (rows without an id last)."""
    kept = _linked(documents, width, num, den, id_col, text).filter("head.k1 = k1 and head.k2 = k2").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
    return _keyed(documents, id_col, text).join(kept.hint("merge"), ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select(documents.columns)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"), width=3, num=90, den=100)
