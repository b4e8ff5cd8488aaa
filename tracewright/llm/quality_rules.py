"""Quality rules: per-document rules, and the frequency of normalised lines across documents.

Lines are normalised (ASCII lower case, numbers to 0, white space to one space, trimmed) and hashed.
A line goes where more than FLOOR different documents of a host hold it, whatever the host's size,
or, on small hosts, at least LEAST_DOCS and more than LEAST_SHARE of the host's documents. A document
is rejected if what is left of it has fewer words than the base rules ask for, or less than half.

Texts are read once: each row's counts and the hashes of its lines go to a table, and all else runs on
that. Lines are first counted by rows, with partial sums before the shuffle (host and line as key);
different documents are counted only for those that rows alone could make frequent. So neither a
large host nor a frequent line meets in one task, and no text is shuffled for the verdicts. Only
DataFrame functions are used.

Defined results: null text has no words and fails the base rules; a null host is a host of its
own; lines without a word are never counted or removed; rows of one id are one document when
documents are counted, but each loses its own lines; rows without an id are one document for each
different text; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, table, written

#: A line may stand in FLOOR documents of a host; or in fewer than LEAST_DOCS, or in LEAST_SHARE of them.
FLOOR, LEAST_DOCS, LEAST_SHARE = 20, 5, 0.1
#: A document is depleted with fewer words left than MIN_WORDS, or with a smaller share of them.
LEAST_LEFT = 0.5
MIN_WORDS, REPEAT_NUM, REPEAT_DEN = 50, 50, 100
_INDEX_BITS = 22
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def _windows(w: Column) -> Column:
    """64-bit hashes of all 3-word windows of a text that has room for two (with fewer than four words none repeats)."""
    n = F.size(w)
    return F.when(n >= 4, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))


def base_rules(documents: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    Repeated windows are found inside the row, without a shuffle: the upper bits of a window's
    hash and its place share one long, which Spark sorts as a primitive array; equal neighbours
    are compared by their whole hashes, so that only a 64-bit collision could count.
    """
    # the caller's row travels as one column, so that no name of its own can meet one of ours
    rest = [c for c in documents.columns if c not in BASE]
    t = F.coalesce(F.col("_text"), F.lit(""))
    d = documents.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), F.col(text).alias("_text")).withColumn("_w", words(t))
    # hashes of all windows, only where a text can repeat one
    d = d.withColumn("_g", _windows(F.col("_w")))
    d = d.withColumn("_dup", F.col("_g").isNotNull() & (F.size(F.array_distinct("_g")) < F.size("_g")))
    low = (1 << _INDEX_BITS) - 1
    packed = F.sort_array(F.transform("_g", lambda g, i: F.shiftleft(F.shiftright(g, _INDEX_BITS), _INDEX_BITS).bitwiseOR(i.cast("long"))))
    small = F.size("_g") <= low
    d = d.withColumn("_p", F.when(F.col("_dup") & small, packed))
    place = lambda x: x.bitwiseAND(F.lit(low).cast("long")).cast("int")
    of = lambda x: F.get(F.col("_g"), place(x))
    near = F.zip_with(F.slice("_p", 1, F.greatest(F.size("_p") - 1, F.lit(1))), F.slice("_p", 2, F.greatest(F.size("_p"), F.lit(1))), lambda a, b: F.when(F.shiftright(a, _INDEX_BITS) == F.shiftright(b, _INDEX_BITS), F.struct(place(a).alias("a"), place(b).alias("b"), (of(a) == of(b)).alias("same"))))
    d = d.withColumn("_n", F.filter(near, lambda x: x.isNotNull()))
    # two different windows with equal upper bits (hardly ever), or a text of millions of words: sort by the whole hash
    slow = F.col("_dup") & (~small | F.exists("_n", lambda x: ~x["same"]))
    pairs = F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    d = d.withColumn("_q", F.when(slow, pairs))
    full = F.zip_with(F.slice("_q", 1, F.greatest(F.size("_q") - 1, F.lit(1))), F.slice("_q", 2, F.greatest(F.size("_q"), F.lit(1))), lambda a, b: F.when(a["g"] == b["g"], F.struct(a["i"].alias("a"), b["i"].alias("b"), F.lit(True).alias("same"))))
    d = d.withColumn("_n", F.when(slow, F.filter(full, lambda x: x.isNotNull())).otherwise(F.col("_n")))
    covered = F.array_distinct(F.flatten(F.transform("_n", lambda x: F.array(x["a"], x["a"] + 1, x["a"] + 2, x["b"], x["b"] + 1, x["b"] + 2))))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("_l", lines)
    d = d.withColumn("n_words", F.size("_w").cast("long"))
    d = d.withColumn("word_chars", F.length(F.regexp_replace(t, BLANKS, "")).cast("long"))
    d = d.withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"))
    d = d.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    d = d.withColumn("n_repeat_words", F.when(F.col("_dup"), F.size(covered)).otherwise(0).cast("long"))
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (REPEAT_DEN * F.col("n_repeat_words") > REPEAT_NUM * F.col("n_words")))
    return d.select("_row.*", *BASE)


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(ascii_lower(line), "[0-9]+", "0"), BLANKS, " "))


def line_hashes(text: Column) -> Column:
    """(h, n) of each line with a word: the hash of the normal line and its words."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), normal_line), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("n")))


def measured(documents: DataFrame, host: str, text: str, id_col: str, keep_text: bool) -> DataFrame:
    """The documents with the base columns, their lines and a number for each row, as a table."""
    rest = [c for c in documents.columns if c not in (*BASE, "n_words_left", "kept", "clean_text") and (keep_text or c != text)]
    d = documents.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_own"), F.col(text).alias("_body"), F.col(host).alias("_at"), F.col(id_col).alias("_name"))
    own = F.xxhash64(F.coalesce(F.col("_body"), F.lit("")))
    d = base_rules(d, "_body").withColumn("_lines", line_hashes(F.col("_body")))
    d = d.withColumn("_doc", F.struct(F.col("_name").alias("id"), F.when(F.col("_name").isNull(), own).alias("t"))).withColumn("_host", F.coalesce(F.col("_at"), F.lit("")))
    d = d.drop("_body", "_at", "_name").withColumn("_row", F.monotonically_increasing_id())
    return written(d, "lines")


def frequent_lines(lines: DataFrame, docs: DataFrame, floor: int = FLOOR, least: int = LEAST_DOCS, share: float = LEAST_SHARE) -> DataFrame:
    """(_host, h) of the lines that too many different documents of a host hold."""
    n = lines.groupBy("_host", "h").agg(F.count_distinct("_doc").alias("n"))
    hosts = docs.groupBy("_host").agg(F.count_distinct("_doc").alias("docs"))
    small = (F.col("n") >= least) & (F.col("n") > share * F.col("docs"))
    return n.join(hosts, "_host").filter((F.col("n") > floor) | small).select("_host", "h")


def line_losses(rows: DataFrame, **limits) -> DataFrame:
    """(_row, removed, n_lost): the hashes of the lines that a measured row loses, and their words;
    other rows have no entry."""
    lines = rows.select("_row", "_doc", "_host", F.explode("_lines").alias("x")).select("_row", "_doc", "_host", "x.h", "x.n")
    least = min(limits.get("floor", FLOOR) + 1, limits.get("least", LEAST_DOCS))
    # rows are at least as many as documents: only these lines can be frequent
    often = lines.groupBy("_host", "h").agg(F.count("*").alias("c")).filter(F.col("c") >= least).select("_host", "h")
    held = written(lines.join(often, ["_host", "h"], "left_semi"), "held")
    gone = held.join(frequent_lines(held, rows, **limits), ["_host", "h"], "left_semi")
    return gone.groupBy("_row").agg(F.collect_set("h").alias("removed"), F.sum("n").alias("n_lost"))


def judged(documents: DataFrame, host: str = "source", text: str = "text", id_col: str = "doc_id", keep_text: bool = False, **limits) -> DataFrame:
    """The documents without their text (unless ``keep_text``), with the base columns, n_words_left and kept."""
    rows = measured(documents, host, text, id_col, keep_text)
    lost = line_losses(rows, **limits)
    d = rows.drop("_lines", "_doc", "_host").join(lost if keep_text else lost.drop("removed"), "_row", "left")
    d = d.withColumn("n_words_left", F.col("n_words") - F.coalesce("n_lost", F.lit(0)))
    depleted = F.col("n_lost").isNotNull() & ((F.col("n_words_left") < MIN_WORDS) | (F.col("n_words_left") < LEAST_LEFT * F.col("n_words")))
    d = d.withColumn("kept", ~F.col("base_failed") & ~depleted)
    return d if keep_text else d.select("_own.*", *BASE, "n_words_left", "kept")


def cleaned(documents: DataFrame, host: str = "source", text: str = "text", id_col: str = "doc_id", **limits) -> DataFrame:
    """``judged`` with the text and ``clean_text``, the text without the host's frequent lines."""
    d = judged(documents, host, text, id_col, True, **limits)
    t = F.coalesce(F.col("_own").getField(text), F.lit(""))
    left = F.filter(F.split(t, "\n"), lambda x: ~F.array_contains("removed", F.xxhash64(normal_line(x))))
    d = d.withColumn("clean_text", F.when(F.col("removed").isNull(), t).otherwise(F.array_join(left, "\n")))
    return d.select("_own.*", *BASE, "n_words_left", "kept", "clean_text")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_words_left")


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NORMAL = "trim(regexp_replace(regexp_replace(" + _LOWER.format("x") + ", '[0-9]+', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ')"
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT r, i, w[i:i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win), range(3) z(k) WHERE c > 1 GROUP BY r),
ln AS MATERIALIZED (SELECT r, doc_id, host, x, {_NORMAL} AS l FROM (SELECT r, doc_id, host, unnest(string_split(t, chr(10))) AS x FROM d)),
dup AS (SELECT r, count(*) - count(DISTINCT x) AS n_dup_lines FROM ln WHERE l <> '' GROUP BY r),
often AS (SELECT host, l FROM ln JOIN (SELECT host, count(DISTINCT doc_id) AS docs FROM d GROUP BY host) USING (host) WHERE l <> '' GROUP BY host, l, docs HAVING count(DISTINCT doc_id) > {FLOOR} OR (count(DISTINCT doc_id) >= {LEAST_DOCS} AND count(DISTINCT doc_id) > {LEAST_SHARE}::DOUBLE * docs)),
lost AS (SELECT r, sum(len(string_split(l, ' ')))::BIGINT AS n FROM ln JOIN often USING (host, l) GROUP BY r),
b AS (SELECT r, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, lost.n AS lost
  FROM d LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR {REPEAT_DEN} * n_repeat_words > {REPEAT_NUM} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR {REPEAT_DEN} * n_repeat_words > {REPEAT_NUM} * n_words) AND NOT coalesce(n_words - lost < {MIN_WORDS} OR n_words - lost < {LEAST_LEFT} * n_words, FALSE) AS kept, n_words - coalesce(lost, 0) AS n_words_left
FROM b
"""
