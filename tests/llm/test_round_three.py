"""Fill-in-middle, nearest neighbours and whitening against plain versions, and on odd inputs."""

import hashlib
import pickle
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import rows
from tracewright.llm import common, fill_middle, kmeans_tree, ngram_join, whitening

LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
TEXTS = [None, "", "a", " ", "ab cd", "x" * 70_000, "<P> inside", "ends with <", "<S", "é ß 漢字 \U0001f600 end", LONG, "\n\n<<S<S", "one two three four " * 9]
BIG = 2**53 + 1


def plain_fill(doc_id, text):
    text = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, text
    return (len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.fixture(scope="module")
def texts(spark):
    data = [(i, t, "k", 1, "n") for i, t in enumerate(TEXTS * 9)] + [(3, "same id", "k", 1, "n"), (None, "no id", "k", 1, "n"), (BIG, LONG, "k", 1, "n"), (7, "twice", "k", 1, "n"), (7, "twice", "k", 1, "n")]
    return spark.createDataFrame(data, "doc_id long, text string, k1 string, pos int, n string")


@pytest.mark.parametrize(("units", "chars"), [(fill_middle.PIECE_UNITS, fill_middle.PIECE_CHARS), (2, 3)])
def test_fill_middle_plain_version(texts, units, chars):
    few = texts if units > 2 else texts.filter("length(text) < 1000 or text is null")
    got = sorted((tuple(r) for r in fill_middle.restored(fill_middle.pieces(few, units=units, chars=chars)).collect()), key=repr)
    want = []
    for r in few.collect():
        *meta, out = plain_fill(r.doc_id, r.text)
        want.append((r.doc_id, *meta, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_fill_middle_outputs(texts):
    got = sorted(((r.doc_id, r.form, r.output) for r in fill_middle.outputs(texts).collect()), key=repr)
    assert got == sorted(((r.doc_id, p[1], p[4]) for r in texts.collect() for p in [plain_fill(r.doc_id, r.text)]), key=repr)
    assert fill_middle.restored(fill_middle.pieces(texts.limit(0))).count() == 0


def test_fill_middle_sends_texts_once(texts):
    plan = fill_middle.restored(fill_middle.pieces(texts))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_parts_across_pieces():
    for cut in range(1, 6):
        text, p = "<S>a<S<b<P><<M>mid<S>", fill_middle.Parts("spm")
        got = [x for i in range(0, len(text), cut) for x in p.feed(text[i : i + cut])] + p.feed("", last=True)
        joined = {place: "".join(t for q, t in got if q == place) for place in (0, 1, 2)}
        assert joined == {2: "a<S<b", 0: "<", 1: "mid<S>"}


# --- vectors ---

NAN, INF = float("nan"), float("inf")


def odd_vectors(spark, n=400, dim=6):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, dim)).round(2) * 10.0 ** rng.integers(-2, 2, (n, 1))
    data = [(i, x[i].tolist()) for i in range(n)]
    data += [(1000 + i, x[0].tolist()) for i in range(40)]  # one class of copies, queries among them
    data += [(None, x[1].tolist()), (2000, x[2].tolist()), (2000, x[2].tolist()), (BIG - BIG % 100, x[3].tolist())]
    data += [(3000, None), (3100, []), (3200, [NAN] + [1.0] * (dim - 1)), (3300, [INF] * dim), (3400, [0.0] * dim), (3500, [1.0, 2.0])]
    with_null = [(3600, [None] + [1.0] * (dim - 1))]
    return spark.createDataFrame([(i, v, "a", "b", 1.0, 2) for i, v in data + with_null], "vec_id long, embedding array<double>, k1 string, id string, score double, leaf int"), data


def brute_neighbours(data, k):
    own = [(i, v) for i, v in data if v is not None and len(v) == 6 and np.isfinite(v).all() and any(v)]
    x = np.array([v for _, v in own])
    out = []
    for n, (i, v) in enumerate(own):
        if i is None or i % 100:
            continue
        d = np.sqrt(((x - np.array(v)) ** 2).sum(1))
        best = sorted((d[m], own[m][0] is None, own[m][0] or 0) for m in range(len(own)) if m != n)[:k]
        out += [(i, r + 1, None if none else b, dist) for r, (dist, none, b) in enumerate(best)]
    return out


def test_neighbours_all_leaves_are_exact(spark):
    df, data = odd_vectors(spark)
    for k in (10, 600):
        index = kmeans_tree.build(df, k=k, sample=200, target=1.0)
        index.visits = index.tree.leaves
        got = [tuple(r) for r in kmeans_tree.neighbours(index, df.filter("vec_id % 100 = 0")).collect()]
        assert sorted(got, key=repr) == sorted(brute_neighbours(data, k), key=repr)


def test_neighbours_recall(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    index = kmeans_tree.build(vectors)
    assert 1 < index.visits < index.tree.leaves and index.recall >= kmeans_tree.TARGET
    e = vectors.toPandas().sort_values("vec_id")
    x, ids = np.stack(e["embedding"]).astype(float), e["vec_id"].to_numpy()
    own = vectors.filter("vec_id % 7 = 0")
    got = kmeans_tree.neighbours(index, own).toPandas()
    assert len(got) == own.count() * 10
    hits = 0
    for q, g in got.groupby("query_id"):
        at = np.searchsorted(ids, q)
        d = np.sqrt(((x - x[at]) ** 2).sum(1))
        assert (g.sort_values("rank")["score"].to_numpy() == d[np.searchsorted(ids, g.sort_values("rank")["vec_id"])]).all()
        d[at] = np.inf
        hits += len(set(ids[np.lexsort((ids, d))[:10]]) & set(g["vec_id"]))
    assert hits >= 0.9 * len(got)


def test_neighbours_small(spark):
    df, _ = odd_vectors(spark)
    assert kmeans_tree.neighbours(kmeans_tree.build(df.limit(0)), df.limit(0)).count() == 0
    one = df.filter("vec_id = 100")
    assert kmeans_tree.neighbours(kmeans_tree.build(one), one).count() == 0
    two = df.filter("vec_id in (100, 101)")
    assert [(r.query_id, r["rank"], r.vec_id) for r in kmeans_tree.neighbours(kmeans_tree.build(two), two).orderBy("query_id").collect()] == [(100, 1, 101), (101, 1, 100)]


def test_neighbours_deal_out_large_leaves(spark, monkeypatch):
    monkeypatch.setattr(kmeans_tree, "BLOCK_ROWS", 16)
    df, data = odd_vectors(spark)
    index = kmeans_tree.build(df, sample=200)
    index.visits = index.tree.leaves
    held = kmeans_tree._blocks(index.rows, 16, ["id"]).selectExpr("max(size(id)) m", "count(*) c").first()
    assert held.m < 64 and held.c > index.tree.leaves
    got = [tuple(r) for r in kmeans_tree.neighbours(index, df.filter("vec_id % 100 = 0")).collect()]
    assert sorted(got, key=repr) == sorted(brute_neighbours(data, 10), key=repr)


def brute_whitening(pairs, dim, scale=256):
    own = [(i, [int(np.floor(scale * c)) for c in v]) for i, v in pairs if v is not None and len(v) == dim and np.isfinite(v).all()]
    u = np.array(sorted({tuple(x) for _, x in own}))
    n, sums = len(u), u.sum(0)
    e, vec = np.linalg.eigh(np.cov(u.T.astype(float), bias=True).reshape(dim, dim))
    e, vec = e[::-1], vec[:, ::-1]
    k = min(4, int((e > 1e-9 * e[0]).sum()))
    out = {}
    for i, x in own:
        dev = sum((n * a - int(b)) ** 2 for a, b in zip(x, sums, strict=True))
        w = ((np.array(x) - sums / n) @ vec[:, :k]) / np.sqrt(e[:k])
        out.setdefault(i, []).append((n, dev, w, e[:k] / e.sum()))
    return out, k


def test_whitening_plain_version(spark):
    df, data = odd_vectors(spark)
    got = whitening.whitened(df).toPandas()
    want, k = brute_whitening(data, 6)
    assert len(got) == k * sum(map(len, want.values())) and k == 4
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    signs = {}
    for r in got.itertuples():
        key = None if r.vec_id is None or r.vec_id != r.vec_id else int(r.vec_id)
        n, dev, w, share = want[key][0]
        assert (r.n, r.deviation) == (n, dev)
        assert abs(r.explained / share[r.component - 1] - 1) < 1e-9
        assert abs(abs(r.whitened) - abs(w[r.component - 1])) < 1e-9
        if abs(r.whitened) > 1e-6:
            signs.setdefault(r.component, set()).add(np.sign(r.whitened) == np.sign(w[r.component - 1]))
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_rank_and_small(spark):
    kind = "vec_id long, embedding array<double>"
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)
    assert whitening.whitened(one).count() == 0
    assert whitening.whitened(one.limit(0)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)], kind)
    got = whitening.whitened(line).toPandas()
    assert len(got) == 9 and got["component"].unique().tolist() == [1]
    assert abs(got["explained"] - 1).max() < 1e-12
    assert abs((got["whitened"] ** 2).mean() - 1) < 1e-9
    wide = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], kind)
    assert whitening.whitened(wide).filter("deviation is null").count() > 0  # beyond a long


def test_whitening_exact_sums_and_deviations(spark):
    data = [(i, [2.0**30 + i, -(2.0**31) - 3.0 * i * i]) for i in range(5)]
    got = whitening.whitened(spark.createDataFrame(data, "vec_id long, embedding array<double>"), scale=256).toPandas()
    want, _ = brute_whitening(data, 2)
    assert {(r.vec_id, r.deviation) for r in got.itertuples()} == {(i, v[0][1]) for i, v in want.items()}


@pytest.mark.parametrize("dim", [1, 2, 5, 24])
def test_jacobi_on_pivoted_factor(dim):
    rng = np.random.default_rng(dim)
    for rank in {1, dim // 2 + 1, dim}:
        a = rng.normal(size=(dim, rank)) * 10.0 ** rng.integers(-3, 4, rank)
        v = a @ a.T
        low = whitening.pivoted_cholesky(v)
        assert low.shape[1] <= rank and abs(low @ low.T - v).max() < 1e-10 * abs(v).max()
        e, c = whitening.one_sided_jacobi(low)
        assert abs(c @ c.T - np.eye(len(c))).max() < 1e-12
        assert abs(e - np.linalg.eigvalsh(v)[::-1][: len(e)]).max() < 1e-10 * e[0]


def test_pairs_of_rounds():
    for n in (0, 1, 2, 5, 8):
        seen = [(int(i), int(j)) for a, b in whitening.rounds_of(n) for i, j in zip(a, b, strict=True)]
        assert sorted(seen) == [(i, j) for i in range(n) for j in range(i + 1, n)]


def test_registered(spark, sf):
    from tests.oracle import same
    from tracewright.llm import registry

    same(registry.QUERIES["op11_fill_middle"](spark, sf), registry.ORACLES["op11_fill_middle"], sf)
    assert rows(registry.QUERIES["op13_whitening"](spark, sf).toPandas())[0] == sorted(["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


# --- names of the caller's columns, ids of other types, article text under furniture names ---


def test_callers_columns_come_back(spark):
    from tracewright.llm import mixing, quality_rules

    names = ["rate", "_s", "_k", "_name", "_row", "n_lost", "removed", "_w", "_lines", "_own", "_doc"]
    text = " ".join(f"w{i}" for i in range(80))
    data = [(i, text + f" {i}", "s", *[f"{n}-{i}" for n in names]) for i in range(3)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    weights = spark.createDataFrame([("s", 1.0)], "source string, weight double")
    out = mixing.mixed(df, mixing.rates(df, weights, scale=6.0), 5)
    assert out.columns == [*df.columns, "replica"] and out.count() > 6
    for got in (out, quality_rules.judged(df), quality_rules.base_rules(df), quality_rules.cleaned(df)):
        assert {(r.doc_id, *[r[n] for n in names]) for r in got.collect()} <= {(d[0], *d[3:]) for d in data}
    assert {r.clean_text for r in quality_rules.cleaned(df).collect()} == {d[1] for d in data}


def test_suffix_dedup_with_string_ids(spark):
    from tracewright.llm import suffix_dedup

    shared = "".join(chr(97 + (i * i + 3 * i) % 26) for i in range(260))
    data = [("a", "x" * 5 + shared), ("b", shared + "y" * 9), ("c", "only here " * 3), (None, shared)]
    texts = spark.createDataFrame(data, "doc_id string, text string")
    numbers = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(data)], "doc_id long, text string")
    a, b = (suffix_dedup.deduplicated(d) for d in (texts, numbers))
    assert sorted(r.kept for r in a.select("kept").collect()) == sorted(r.kept for r in b.select("kept").collect())
    assert {r.doc_id for r in a.collect()} == {"a", "b", "c", None}


@pytest.mark.parametrize(
    ("part", "stays"),
    [
        ('<p class="search">About search, engines.</p>', True), ('<section id="comments-on-law"><p>Law, text</p></section>', True), ('<h2 class="header">Head line</h2>', True), ('<div class="about-search">Keep me</div>', True),
        ('<div class="comments"><p>nice one</p></div>', False), ('<div class="related-posts"><a href=x>a b</a></div>', False), ('<p class="share"><a href=x>Share this now</a></p>', False),
        ('<section class="newsletter">Join us</section>', False), ('<div class="site-footer">xyz</div>', False), ('<div class="side-bar">xyz</div>', False),
    ],
)
def test_furniture_words_need_structure(part, stays):
    from tracewright.llm import html_extract

    page = f"<body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>{'Body text, with commas. ' * 20}</p>{part}</article><footer>f</footer>"
    assert (re.sub("<[^>]*>", "", part) in html_extract.main_text(page)) == stays


def shuffles(spark):
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    return set(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(tracker.shuffleStatuses().keySet()))


def test_written_leaves_no_shuffle(spark):
    before, setting = shuffles(spark), spark.conf.get(common.CLEANUP)
    got = common.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "made")
    assert not shuffles(spark) - before and spark.conf.get(common.CLEANUP) == setting
    assert sorted((r["k"], r["count"]) for r in got.collect()) == [(k, len(range(k, 1000, 7))) for k in range(7)]


def test_count_table_travels_compressed(spark):
    docs = spark.createDataFrame([(i, f"a b c d{i % 2} e") for i in range(6)], "doc_id long, text string")
    counts = ngram_join.count_table(docs, 3, "text")
    assert len(pickle.dumps(counts)) < 1 << 20
    n = np.bincount(pickle.loads(pickle.dumps(counts)).table())
    # a b c in six, two more shingles in each half
    assert n[int(8 * np.log2(7))] == 1 and n[int(8 * np.log2(4))] == 4 and n[1:].sum() == 5
