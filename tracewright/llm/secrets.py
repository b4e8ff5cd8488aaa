"""Secret scans: rules for keyed values, access keys and hex strings, and character Markov models.

Two first-order Markov models over the same alphabet, one of random strings and one of ordinary
identifiers, are trained from labelled samples; a candidate token is a secret where the
log-likelihood ratio of the two passes a threshold, in total and per character. Training and
scanning use only DataFrame functions; the table of ratios has a fixed size (alphabet squared).
Candidates are the runs of the alphabet that the base spans leave of a text.

Arrays of matches are folded in blocks of their square root, since a fold that appends copies what
it has: a text with many matches costs about their number to the power 1.5, not 2.

Defined results: null text is empty and has no span; ties and repeated rows are treated row by
row; ``scan`` adds the columns base and spans (or those named), all other columns pass through it and
``redacted``. Spans are code points, end exclusive. A text is scanned whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

KINDS = ("assign", "access", "hex", "markov")
# The base rules. Quantified forms find the same matches as one-or-more with a
# later length check where a shorter match cannot hide a longer one (access, hex).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE_LEAST = 16
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{CANDIDATE_LEAST},}}"
#: Bounds of the labelled sample: documents looked at, and tokens of each label.
SAMPLE_DOCS, SAMPLE_TOKENS = 400, 20_000
#: A token is taken where the ratio is at least LEAST_TOTAL and LEAST_MEAN for each step (nats).
LEAST_TOTAL, LEAST_MEAN = 12.0, 0.6


def _let(x: Column, f) -> Column:
    """``f(x)`` with x computed once: what a lambda takes from outside is computed for each element."""
    return F.get(F.transform(F.array(x), f), 0)


def _blocks(a: Column) -> Column:
    """The array in pieces of the square root of its size."""
    n = F.size(a)
    wide = F.greatest(F.ceil(F.sqrt(n)), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / wide), F.lit(1)).cast("int") - 1), lambda b: F.slice(a, b * wide + 1, wide))
    return F.filter(cut, lambda b: F.size(b) > 0)


def _starts(blocks: Column, add) -> Column:
    """What ``add(state, block)`` has come to, from 0, before each block."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, b: F.struct(add(acc["at"], b).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(blocks, zero, step, lambda acc: acc["out"])


def _matches(text: Column, regex: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as sorted (start, kind, end, m), by the pieces between them."""
    whole = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(regex), F.lit(group)) if group else whole
    none = F.array().cast("array<struct<start:int,kind:int,end:int,m:string>>")
    pieces = F.slice(F.split(text, regex, -1), F.lit(1), F.size(whole))
    whole = F.arrays_zip(pieces.alias("p"), whole.alias("m"), inner.alias("g"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("m")))
        return F.struct(end.alias("at"), F.when(F.length(x["g"]) >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def joined(blocks: Column) -> Column:
        at = _starts(blocks, lambda at, b: F.aggregate(b, at, lambda n, x: n + F.length(x["p"]) + F.length(x["m"])))
        return F.flatten(F.zip_with(blocks, at, lambda b, a: F.aggregate(b, F.struct(a.alias("at"), none.alias("out")), step, lambda acc: acc["out"])))

    return F.when(text.rlike(regex), _let(whole, lambda z: _let(_blocks(z), joined))).otherwise(none)


def _replaced(text: Column, spans: Column, by) -> Column:
    """The text with ``by(start, end)`` for each part of it under a sorted span that no earlier span covers."""
    ends = lambda at, b: F.greatest(at, F.array_max(F.transform(b, lambda s: s["end"])))

    def one(b: Column, a: Column) -> Column:
        # the part of the text that the block rewrites: inside it, offsets are small
        return _let(text.substr(a + 1, ends(a, b) - a), lambda own: F.aggregate(b, F.struct(a.alias("at"), F.lit("").alias("out")), step(own, a), lambda acc: acc["out"]))

    def step(own: Column, a: Column):
        def run(acc: Column, s: Column) -> Column:
            start = F.greatest(acc["at"], s["start"])
            new = F.concat(acc["out"], own.substr(acc["at"] - a + 1, start - acc["at"]), by(s["start"], start, s["end"]))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["end"] > acc["at"], new).otherwise(acc["out"]).alias("out"))

        return run

    rest = text.substr(F.greatest(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0)) + 1, F.length(text))
    made = _let(_blocks(spans), lambda blocks: F.array_join(F.zip_with(blocks, _starts(blocks, ends), one), ""))
    return F.when(F.size(spans) > 0, F.concat(made, rest)).otherwise(text)


def base_spans(text: Column) -> Column:
    """Spans of the three rules, sorted by start, then by the kind's place in KINDS."""
    found = F.concat(_matches(text, ASSIGN, 0, 1, ASSIGN_LEAST), _matches(text, ACCESS, 1), _matches(text, HEX, 2))
    return F.sort_array(F.transform(found, lambda s: F.struct(s["start"], s["kind"], s["end"])))


def labelled_samples(documents: DataFrame, text: str = "text", docs: int = SAMPLE_DOCS, tokens: int = SAMPLE_TOKENS) -> DataFrame:
    """(token, label) rows: 1 for random strings (values that the rules matched in the sampled
    documents, and Base64, Base62 and hex digits of hashes), 0 for the documents' ordinary words and
    for plain decimal numbers (card, phone and order numbers aren't secrets of this kind)."""
    ids = documents.select(F.xxhash64("doc_id").alias("h"), "doc_id").orderBy("h", "doc_id").limit(docs).select("doc_id").distinct()
    some = documents.join(F.broadcast(ids), "doc_id").select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    some = written(some.orderBy(F.xxhash64("t"), "t").limit(docs), "secret-sample")
    value = F.regexp_extract_all("t", F.lit(f"{ASSIGN}|({ACCESS})|({HEX})"), F.lit(0))
    keyed = some.select(F.explode(value).alias("token")).select(F.regexp_extract("token", r"([A-Za-z0-9+/_=-]+)$", 1).alias("token")).filter(F.col("token").rlike("[0-9]") & (F.length("token") >= 12))
    words = some.select(F.explode(F.regexp_extract_all("t", F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z][A-Za-z_-]{3,}(?![A-Za-z0-9+/_=-])"), F.lit(0))).alias("token"))
    made = documents.sparkSession.range(tokens // 4).select(F.explode(F.array(
        F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256))), F.translate(F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), "id"), 256))), "+/=", ""),
        F.md5(F.col("id").cast("string")), F.upper(F.md5(F.concat(F.lit("u"), "id"))),
    )).alias("token"))
    numbers = documents.sparkSession.range(tokens // 4).select(F.abs(F.xxhash64("id")).cast("string").alias("token"))
    common = words.distinct().orderBy(F.xxhash64("token"), "token").limit(tokens).union(numbers)
    return keyed.orderBy(F.xxhash64("token"), "token").limit(tokens).union(made).select("token", F.lit(1).alias("label")).union(common.select("token", F.lit(0).alias("label")))


def train(samples: DataFrame, add: float = 0.5) -> list[float]:
    """Log-likelihood ratios of all steps (from * (size + 1) + to, place 0 being a token's start)."""
    n = len(ALPHABET) + 1
    at = lambda i: F.expr(f"instr('{ALPHABET}', substr(token, {i}, 1))")
    steps = samples.filter("length(token) > 0").select("label", "token", F.explode(F.expr("sequence(1, length(token))")).alias("i"))
    counted = steps.groupBy("label", F.when(F.col("i") == 1, 0).otherwise(at("i - 1")).alias("a"), at("i").alias("b")).count()
    count = {(r["label"], r["a"], r["b"]): r["count"] for r in counted.collect()}  # at most 2 * n * n rows
    out = []
    for a in range(n):
        total = [sum(count.get((y, a, b), 0) for b in range(n)) + add * n for y in (0, 1)]
        out += [math.log((count.get((1, a, b), 0) + add) / total[1]) - math.log((count.get((0, a, b), 0) + add) / total[0]) for b in range(n)]
    return out


def ratio(token: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a token: random over ordinary."""
    n = len(ALPHABET) + 1
    values = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    zero = F.struct(F.lit(0).alias("a"), F.lit(0.0).alias("s"))

    def step(acc: Column, c: Column) -> Column:
        b = F.call_function("instr", F.lit(ALPHABET), c)
        return F.struct(b.alias("a"), (acc["s"] + F.get(values, acc["a"] * n + b)).alias("s"))

    return F.aggregate(F.split(token, ""), zero, step, lambda acc: acc["s"])


def scan(documents: DataFrame, model: list[float], text: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """The documents with two arrays of (start, kind, end): the base spans, and all; kind counts in KINDS."""
    d = documents.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    d = d.withColumn(base, base_spans(F.col("_t")))
    bare = _replaced(F.col("_t"), F.col(base), lambda _, a, b: F.repeat(F.lit(" "), b - a))
    d = d.withColumn("_t", F.when(F.size(base) > 0, bare).otherwise(F.col("_t"))).withColumn("_t", _matches(F.col("_t"), CANDIDATE, 3))
    d = d.withColumn("_t", F.transform("_t", lambda s: F.struct(s.alias("s"), ratio(s["m"], model).alias("r"))))
    random = lambda x: (x["r"] >= LEAST_TOTAL) & (x["r"] >= LEAST_MEAN * (x["s"]["end"] - x["s"]["start"]))
    added = F.transform(F.filter("_t", random), lambda x: F.struct(x["s"]["start"], x["s"]["kind"], x["s"]["end"]))
    return d.withColumn(spans, F.sort_array(F.concat(base, added))).drop("_t")


def redacted(documents: DataFrame, model: list[float], text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span (overlapping ones as one) replaced by the mark."""
    d = scan(documents, model, text, "_base", "_spans")
    new = _replaced(F.col(text), F.col("_spans"), lambda start, free, _: F.when(start == free, mark).otherwise(""))
    return d.withColumn(text, new).drop("_base", "_spans")


def _listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents; the models' samples come from the documents themselves."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(labelled_samples(docs))
    n = lambda k, of: F.size(F.filter(of, lambda s: s["kind"] == k)).cast("long")
    return scan(docs, model).select(
        "doc_id", n(0, "base").alias("n_assign"), n(1, "base").alias("n_access"), n(2, "base").alias("n_hex"), n(3, "spans").alias("n_markov"),
        F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"),
    )
