"""Operators on tiny frames with hand-computed expectations, and invariants."""

import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrix.functions import text as T, vectors as V
from kestrix.operators import analytics, calibration as C, design as X, discrimination as D, documents as M, encoders as E, etl, linalg as L, matching, models, splits, vectorstore as S, windows
from kestrix.sources import readers
from kestrix.streaming import events as ST

STUDENTS = [
    {"student_id": "a", "demographics": {"province": "ON"}, "gpa": 90.0, "applications": [{"university": "U", "program": "CS", "outcome": "admitted", "application_date": "2023-01-05"}, {"university": "V", "program": "CS", "outcome": "rejected", "application_date": "2024-01-05"}]},
    {"student_id": "b", "demographics": {"province": "BC"}, "gpa": None, "applications": [{"university": "U", "program": "CS", "outcome": "rejected", "application_date": "2023-02-01"}]},
    {"student_id": "c", "demographics": {"province": "ON"}, "gpa": 70.0, "applications": []},
]
KIND = "student_id string, demographics struct<province: string>, gpa double, applications array<struct<university: string, program: string, outcome: string, application_date: string>>"


@pytest.fixture(scope="module")
def students(spark):
    return spark.createDataFrame([json.loads(json.dumps(s)) for s in STUDENTS], KIND)


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


# Naive interpreter of stage lists, written for these tests alone.
def naive(docs, stages):
    def at(d, path):
        for p in path.split("."):
            d = d.get(p) if isinstance(d, dict) else None
        return d

    def ev(d, e):
        if isinstance(e, str) and e.startswith("$"):
            return at(d, e[1:])
        if isinstance(e, dict):
            ((op, x),) = e.items()
            if op == "$cond":
                return ev(d, x[1]) if ev(d, x[0]) else ev(d, x[2])
            if op == "$eq":
                return ev(d, x[0]) == ev(d, x[1])
            if op == "$divide":
                a, b = ev(d, x[0]), ev(d, x[1])
                return a / b if a is not None and b else 0
        return e

    for s in stages:
        ((op, x),) = s.items()
        if op == "$match":
            docs = [d for d in docs if all(at(d, k) == v for k, v in x.items())]
        elif op == "$unwind":
            docs = [d | {x[1:]: e} for d in docs for e in (d.get(x[1:]) or [])]
        elif op == "$group":
            groups = {}
            for d in docs:
                groups.setdefault(ev(d, x["_id"]), []).append(d)
            docs = []
            for k, rows in groups.items():
                out = {"_id": k}
                for n, acc in x.items():
                    if n != "_id":
                        ((f, e),) = acc.items()
                        vals = [v for v in (ev(r, e) for r in rows) if v is not None]
                        out[n] = sum(vals) if f == "$sum" else (sum(vals) / len(vals) if vals else 0) if f == "$avg" else len(rows)
                docs.append(out)
        elif op == "$project":
            docs = [{k: at(d, k) if v == 1 else ev(d, v) for k, v in x.items() if v != 0} for d in docs]
    return docs


@pytest.mark.parametrize("stages", [
    [{"$match": {"demographics.province": "ON"}}, {"$project": {"student_id": 1, "gpa": 1}}],
    [{"$unwind": "$applications"}, {"$group": {"_id": "$applications.university", "n": {"$sum": 1}, "mean": {"$avg": "$gpa"}, "hits": {"$sum": {"$cond": [{"$eq": ["$applications.outcome", "admitted"]}, 1, 0]}}}}, {"$project": {"_id": 1, "mean": 1, "rate": {"$divide": ["$hits", "$n"]}}}],
    [{"$match": {"no.such.path": 1}}, {"$project": {"student_id": 1}}],
])
def test_pipeline_equals_naive(students, stages):
    got = [r.asDict() for r in M.aggregate(students, stages).collect()]
    assert sorted(map(str, ({k: float(v) if isinstance(v, (int, float)) else v for k, v in sorted(d.items())} for d in got))) == sorted(map(str, ({k: float(v) if isinstance(v, (int, float)) else v for k, v in sorted(d.items())} for d in naive(STUDENTS, stages))))


def test_document_queries(students):
    ids = lambda d: sorted(r.student_id for r in d.collect())
    assert ids(M.find(students, M.application_query(university="U", outcome="admitted"))) == ["a"]
    assert ids(M.find(students, M.application_query(year=2024))) == ["a"]
    assert ids(M.find(students, {"gpa": {"$exists": False}})) == ["b"]
    assert ids(M.find(students, {"$or": [{"gpa": {"$lt": 80}}, {"student_id": {"$in": ["a"]}}]})) == ["a", "c"]
    assert ids(M.find(students, {"gpa": None})) == ["b"]
    assert [r.student_id for r in M.find(students, {}, sort=[("gpa", 1)], limit=2).collect()] == ["b", "c"]
    assert M.find(students, {}, {"demographics.province": 1}).schema.simpleString() == "struct<demographics:struct<province:string>>"
    assert M.count_documents(students).first().n == 3
    assert ids(M.delete_many(students, {"student_id": "a"})) == ["b", "c"]
    for bad in ({"gpa": {"$near": 1}}, {"$what": []}):
        with pytest.raises(ValueError):
            M.find(students, bad)
    with pytest.raises(ValueError):
        M.aggregate(students, [{"$frobnicate": 1}])
    assert M.aggregate(students, [{"$group": {"_id": None, "low": {"$min": "$gpa"}, "none": {"$avg": "$student_id"}}}]).first().asDict() == {"_id": None, "low": 70.0, "none": 0.0}


def test_mutations(spark, students):
    up = M.update_many(students, {"demographics.province": "ON"}, {"$set": {"demographics.province": "QC"}, "$inc": {"gpa": 1.0}})
    assert sorted((r.student_id, r.demographics.province, r.gpa) for r in up.collect()) == [("a", "QC", 91.0), ("b", "BC", None), ("c", "QC", 71.0)]
    old = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    new = spark.createDataFrame([(2, "z", 1), (2, "zz", 2), (3, "w", 1), (None, "q", 1)], "k int, v string, o int")
    assert sorted(tuple(r) for r in M.upsert(old, new, ["k"], "o").select("k", "v").collect()) == [(1, "x"), (2, "zz"), (3, "w")]
    assert tuple(M.upsert_counts(old, new, ["k"]).first()) == (1, 2, 1)
    assert sorted(tuple(r) for r in M.update_one(old, {}, {"$set": {"v": "n"}}, ["k"]).collect()) == [(1, "n"), (2, "y")]


@pytest.mark.parametrize("raw, want", [("92.5%", 92.5), ("86", 86.0), ("85-90", 87.5), ("85 – 90", 87.5), ("low 90s", 92.0), ("around mid 80s", 85.0), ("101", None), ("-5", None), ("", None), (None, None), ("90f", None)])
def test_parse_grade(spark, raw, want):
    assert one(spark, raw, T.parse_grade) == want


@pytest.mark.parametrize("raw, want", [("November 26", 11), ("Dec 1, 2023", 12), ("11/9/2024", 11), ("29 Nov 2023", 11), ("2024-02-15", 2), ("13/40/2024", None), ("junk", None), (None, None)])
def test_parse_month(spark, raw, want):
    assert one(spark, raw, T.parse_month) == want


def test_text(spark):
    assert one(spark, "U of X - Physics", lambda c: T.strip_prefix(c, F.lit("u of x"))) == "Physics"
    assert [one(spark, s, T.is_valid_name) for s in ("Physics", "ab", "/x y z", "n/a", "a b c d e f gh")] == [True, False, False, False, False]
    assert one(spark, "Fa23", lambda c: T.parse_term(c)[1]) == 2023 and one(spark, "2023-Fall", lambda c: T.parse_term(c)[0]) == 3
    assert one(spark, "b a", lambda c: T.token_sort_similarity(c, F.lit("A, B!"))) == 1.0
    assert one(spark, "York U", lambda c: c.rlike(T.glob_to_regex("york*"))) is True
    assert one(spark, "n/a", T.clean) is None and one(spark, " x ", T.clean) == "x"
    parts = spark.createDataFrame([("Honours BSc Applied Physics (Optics) Co-op",)], "v string").select(*[c.alias(n) for n, c in T.program_components(F.col("v")).items()]).first()
    assert parts.asDict() == {"degree": "BSc", "is_coop": True, "is_honours": True, "specialisation": "optics", "base_name": "Applied Physics", "name_key": "applied_physics"}


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, -3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    a, b, z = F.col("a"), F.col("b"), F.col("z")
    row = df.select(V.norm(a), V.norm(a, 1), V.norm(a, math.inf), V.dot(a, b), V.cosine(a, z), V.angle(a, b, True), V.distance(a, b), V.is_orthogonal(a, b), V.is_unit(V.normalize(a)), V.linear_combination([2, -1], [a, b]), V.norm(a, 3)).first()
    assert list(row[:5]) == [5.0, 7.0, 4.0, 0.0, 0.0] and math.isclose(row[5], 90) and math.isclose(row[6], math.sqrt(50)) and row[7] and row[8] and row[9] == [2.0, 11.0] and math.isclose(row[10], 91 ** (1 / 3))


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(5)
    rows = [(i, int(rng.random() < p), p, "ab"[i % 2]) for i, p in enumerate(round(rng.random(), 2) for _ in range(400))]
    return rows, spark.createDataFrame(rows, "id bigint, y int, p double, grp string").cache()


def test_discrimination(scores):
    rows, df = scores
    pos, neg = [p for _, y, p, _ in rows if y], [p for _, y, p, _ in rows if not y]
    pairs = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert math.isclose(D.roc_auc(df).first().auc, pairs)
    roc = D.roc_curve(df)
    assert math.isclose(D.trapezoid(roc.withColumn("o", F.coalesce("threshold", F.lit(2.0))), "fpr", "tpr", "o", -F.floor(F.col("o") * 16), falling=True).first().area, pairs)
    c = D.concordance(df).first()
    assert math.isclose(c.concordant + c.tied / 2, pairs) and math.isclose(c.somers_d, 2 * pairs - 1)
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    hits, ap = 0, 0.0
    for k, r in enumerate(order, 1):
        hits += r[1]
        ap += r[1] * hits / k
    assert math.isclose(D.average_precision(df).first().average_precision, ap / len(pos))
    top = sum(r[1] for r in order[:40])
    assert math.isclose(D.at_percentile(df, [10]).first().capture, top / len(pos))
    same = D.delong(df.withColumn("p2", F.col("p"))).first()
    assert math.isclose(same.auc1, pairs) and same.z == 0
    grid = {r.k: (r.tp, r.fp) for r in D.threshold_grid(df, 20).collect()}
    assert all(grid[k] == (sum(p >= k / 20 - 1e-9 for p in pos), sum(p >= k / 20 - 1e-9 for p in neg)) for k in range(21))
    b = D.bootstrap_auc(df, 20).first()
    assert b.low <= b.auc_mean <= b.high and abs(b.auc_mean - pairs) < 0.05
    assert D.roc_auc(df.where("y = 1")).first().auc is None


def test_calibration(scores, spark):
    rows, df = scores
    assert math.isclose(C.brier(df).first().brier, sum((p - y) ** 2 for _, y, p, _ in rows) / len(rows))
    d = C.brier_decomposition(df).first()
    assert math.isclose(d.brier, d.uncertainty - d.resolution + d.reliability)
    a, b = C.platt_fit(df)
    z = np.array([math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6))) for _, _, p, _ in rows])
    q = 1 / (1 + np.exp(-(a * z + b)))
    y = np.array([r[1] for r in rows])
    assert abs((q - y).sum()) < 1e-6 and abs(((q - y) * z).sum()) < 1e-5
    iso = sorted(C.isotonic(df).collect(), key=lambda r: r.low)
    assert all(u.value < v.value for u, v in zip(iso, iso[1:])) and sum(r.n for r in iso) == 400
    blocks = []
    for p in sorted({r[2] for r in rows}):
        ys = [r[1] for r in rows if r[2] == p]
        blocks.append([p, p, len(ys), sum(ys)])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            lo, hi, n, s = blocks.pop()
            blocks[-1] = [blocks[-1][0], hi, blocks[-1][2] + n, blocks[-1][3] + s]
    assert [(r.low, r.high, r.n) for r in iso] == [(lo, hi, n) for lo, hi, n, _ in blocks]
    assert math.isclose(C.chi2_survival(3.841458820694124, 1), 0.05, rel_tol=1e-9) and math.isclose(C.chi2_survival(2.0, 2), math.exp(-1))
    w = spark.createDataFrame([(0, 0), (10, 10)], "k int, n int")
    low, high = C.wilson(F.col("k"), F.col("n"))
    assert tuple(w.select(low, high).collect()[0]) == (0.0, 1.0)
    faults = C.probability_faults(spark.createDataFrame([(1, 1.5), (2, 0.5), (None, 0.1)], "y int, p double")).first()
    assert tuple(faults) == (3, 1, 1, 1)


def test_global_order(spark):
    rows = [(random.Random(k).random(), k) for k in range(500)]
    df = spark.createDataFrame(rows, "p double, id int")
    got = {r.id: r.rn for r in windows.row_numbers(df, windows.score_bucket(F.col("p"), 8), [F.col("p").desc(), F.col("id")]).collect()}
    assert all(got[i] == k + 1 for k, (_, i) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1]))))


def test_quantiles(spark):
    for values in ([3.0], [1.0, 2.0], [5.0] * 50 + [1e9], [math.exp(k / 20) for k in range(500)], [float(k % 7) for k in range(300)]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        assert np.allclose(windows.quantiles(df, "v", [0, 0.1, 0.25, 0.5, 0.9, 1]), np.percentile(values, [0, 10, 25, 50, 90, 100]))
    assert windows.quantiles(df.limit(0), "v", [0.5]) == []


def test_vector_store(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    x[5] = x[6]
    rows = [(i, [float(v) for v in x[i]], "abc"[i % 3], f"Text {i}") for i in range(60)] + [(99, None, None, None), (100, [0.0] * 8, "a", "zero")]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>, kind string, text string").cache()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u[0]
    assert [r.id for r in S.search(df, rows[0][1], 5).collect()] == np.lexsort((np.arange(60), -np.round(s, 12)))[:5].tolist()
    assert all(r.kind == "b" for r in S.search(df, rows[0][1], 5, S.equals({"kind": "b"})).collect())
    got = {(r.query_id, r["rank"]): r.id for r in S.search_batch(df, df.where("id < 7"), 3, block=3).collect()}
    for q in range(7):
        t = np.round(u @ u[q], 12)
        t[q] = -9
        assert [got[q, k] for k in (1, 2, 3)] == np.lexsort((np.arange(60), -t))[:3].tolist()
    assert [r.id for r in S.keyword(df, "text 5", ["text"], 3).collect()] == [5, 50, 51]
    assert {r.value: r.result for r in S.aggregate_by(df, "kind").collect()} == {"a": 21, "b": 20, "c": 20, "_null_": 1}
    assert S.hybrid(df, "zero", rows[0][1], ["text"], 0.0, 5).first().id == 100
    with pytest.raises(ValueError):
        S.filters({"operator": "Nope", "path": "x", "value": 1})
    v = spark.createDataFrame([("a b",), (None,), ("b a",)], "t string").select(S.text_vectors(16)("t").alias("v")).collect()
    assert v[0].v == v[2].v and not any(v[1].v)


def test_encoders(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("a", 1), ("b", 0)], "c string, y int")
    loo = sorted((r.c, round(r.encoded, 6)) for r in E.leave_one_out(df, "c", "y", 1.0).collect())
    assert loo == sorted([("a", 0.5), ("a", 0.833333), ("a", 0.5), ("b", 0.5)])
    fit = E.fit_target(df, "c", "y", 1.0)
    got = E.transform_lookup(spark.createDataFrame([("a",), ("z",)], "c string"), fit, "c", 0.5)
    assert sorted((r.c, r.encoded) for r in got.collect()) == [("a", 0.625), ("z", 0.5)]
    assert E.detect_scale(spark.createDataFrame([("A",), ("B",)], "v string"), "v").first().scale == "letter"
    back = spark.range(4).select(E.term_from_cycle(F.cos(F.col("id") * math.pi / 2), F.sin(F.col("id") * math.pi / 2)).alias("t")).collect()
    assert [r.t for r in back] == [0, 1, 2, 3]
    const = E.standardize(spark.createDataFrame([(2.0,), (2.0,)], "v double"), ["v"]).collect()
    assert [r.v_scaled for r in const] == [0.0, 0.0]


def test_design_matrix_is_fitted_once(spark):
    train = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, "a")], "x double, c string")
    d = X.DesignMatrix([X.Feature("x", missing="median"), X.Feature("c", "onehot")], [("x", "c_a")]).fit(train)
    assert d.names() == ["intercept", "x", "c_a", "c_b", "x_x_c_a"]
    row = d.transform(spark.createDataFrame([(None, "z")], "x double, c string")).first()
    assert tuple(row) == (1.0, 0.0, 0.0, 0.0, 0.0)


def test_splits(spark):
    df = spark.sql("select id, date_add(date'2024-01-01', cast(id % 17 as int)) as d, cast(id % 3 as int) as y, cast(id % 5 as int) as g from range(100)")
    pos = {r.id: r.pos for r in splits.positions(df, "d", "id").collect()}
    assert sorted(pos, key=pos.get) == [r.id for r in df.orderBy("d", "id").collect()]
    for cv in (splits.expanding_cv(df, "d", "id", 3, 2), splits.sliding_cv(df, "d", "id", 3), splits.purged_kfold(df, "d", "id", 4, 3, 2)):
        rows = cv.collect()
        for f in {r.fold for r in rows}:
            train, test = ({r.pos for r in rows if r.fold == f and (r.split == "train") == t} for t in (True, False))
            assert train and test and not train & test
    leak = splits.leakage(splits.train_test_cut(df, "d", "id"), "d").first()
    assert leak.train_after + leak.test_before > 0  # ties of the cut date
    assert splits.holdout_years(df, "d").where("split = 'train'").count() == 0
    tt = splits.stratified_first(df, "y", ["d", "id"], 0.2).groupBy("y").agg(F.count_if(F.col("split") == "test").alias("n")).collect()
    assert all(r.n == 6 for r in tt)


def test_linear_algebra(spark):
    rng = np.random.default_rng(3)
    x = np.c_[np.ones(80), rng.normal(size=(80, 2))]
    y = x @ [1.0, 2.0, -3.0] + rng.normal(size=80)
    df = spark.createDataFrame([(*map(float, r), float(t), i) for i, (r, t) in enumerate(zip(x, y))], "a double, b double, c double, y double, i int").cache()
    cols = ["a", "b", "c"]
    assert np.allclose(L.ridge(df, cols, "y"), np.linalg.lstsq(x, y, rcond=None)[0])
    assert np.allclose(L.ridge(df, cols, "y", 2.0), np.linalg.solve(x.T @ x + 2 * np.eye(3), x.T @ y))
    assert np.allclose(L.singular_values(df, cols), np.linalg.svd(x)[1])
    assert L.rank(df.withColumn("d", F.col("b") * 2), ["a", "b", "d"]) == 2
    h = x @ np.linalg.inv(x.T @ x) @ x.T
    assert np.allclose([r.leverage for r in L.leverage(df, cols).orderBy("i").collect()], np.diag(h))
    beta = np.linalg.solve(x.T @ x + np.eye(3), x.T @ y)
    hr = np.diag(x @ np.linalg.inv(x.T @ x + np.eye(3)) @ x.T)
    assert math.isclose(L.ridge_loocv(df, cols, "y", 1.0).first().loocv, (((y - x @ beta) / (1 - hr)) ** 2).mean())
    assert np.allclose(np.abs(L.qr_r(df, cols)), np.abs(np.linalg.qr(x)[1]))
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    low = u[:, :2] * s[:2] @ vt[:2]
    assert np.allclose([[r.a_k, r.b_k, r.c_k] for r in L.low_rank(df, cols, 2).orderBy("i").collect()], low)
    assert math.isclose(L.approximation_error(df, cols, 2), np.linalg.norm(x - low))
    cv = L.ridge_cv(df, cols, "y", [1.0], F.col("i") % 4, 4)[1.0]
    want = sum(((y[k::4] - x[k::4] @ np.linalg.solve(np.delete(x, np.s_[k::4], 0).T @ np.delete(x, np.s_[k::4], 0) + np.eye(3), np.delete(x, np.s_[k::4], 0).T @ np.delete(y, np.s_[k::4]))) ** 2).sum() for k in range(4)) / 80
    assert math.isclose(cv, want)


def test_models(spark):
    rng = np.random.default_rng(4)
    x = np.c_[np.ones(300), rng.normal(size=(300, 2))]
    y = (rng.random(300) < 1 / (1 + np.exp(-x @ [0.3, 1.0, -0.5]))).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], "a double, b double, c double, y int").cache()
    m = models.Logistic(["a", "b", "c"], 0.5).fit(df, "y")
    q = 1 / (1 + np.exp(-x @ m.beta))
    assert np.allclose(x.T @ (q - y) + 0.5 * m.beta, 0, atol=1e-6) and m.taken < 20
    table = models.life_table(models.person_period(spark.createDataFrame([(1,), (2,), (2,), (4,)], "t0 int"), "t0")).orderBy("t").collect()
    assert [(r.t, r.at_risk, r.events) for r in table] == [(1, 4, 1), (2, 3, 2), (3, 1, 0), (4, 1, 1)] and table[-1].survival == 0
    i = spark.createDataFrame([(2.0, 2.0)], "a double, b double").select(models.beta_interval(0.8)("a", "b").alias("i")).first().i
    assert abs(i.low - 0.196) < 0.002 and abs(i.high - 0.804) < 0.002
    assert models.embedding_dim(10) == 6


def test_matching(spark):
    names = spark.createDataFrame([("red gear",)] * 3 + [("gear red",)] * 2 + [("blue bolt",), ("blue bolts",)], "n string")
    rows = {r.variant: (r.cluster_id, r.canonical) for r in matching.leader_clusters(names, "n").collect()}
    assert rows["gear red"] == rows["red gear"] == (0, "red gear") and rows["blue bolt"][0] == rows["blue bolts"][0]
    review = spark.createDataFrame([(1, "A", "a1", "KEEP", None, None), (1, "A", "a2", "RENAME", "AA", None), (2, "B", "b1", "MERGE", None, 1), (2, "B", "b2", "DELETE", None, None), (2, "B", "b3", "SPLIT", None, None), (3, "C", "b1", "OOPS", None, None), (3, "C", "c2", "RENAME", "", None), (3, "C", "c3", "MERGE", None, 9)], "cluster_id int, canonical string, variant string, action string, notes string, merge_target int")
    faults = sorted(tuple(r) for r in matching.review_faults(review).collect())
    assert faults == [("b1", "in two clusters"), ("b1", "unknown action"), ("c2", "rename needs a name in notes"), ("c3", "merge target does not exist")]
    good = {r.canonical: r.variants for r in matching.apply_review(review.where("cluster_id < 3")).collect()}
    assert good == {"AA": ["a1", "a2", "b1"], "b3": ["b3"]}


def test_etl(spark, tmp_path):
    raw = spark.createDataFrame([("1", " UofT ", "CS", "92", "2024-01-01"), ("2", "ubc", "n/a", "101", "2023-01-01"), (None, "x", "y", "1", "2024-05-05")], "student_id string, university string, program string, gpa string, application_date string")
    sink = etl.ParquetUpsert(str(tmp_path / "t"), ["student_id"])
    p = etl.Pipeline().add_extractor(lambda: raw).add_transformer(etl.cleaning({"gpa": "float"})).add_transformer(etl.normalization({"university": {"UofT": "Toronto", "UBC": "British Columbia"}})).add_transformer(etl.validation()).add_transformer(etl.enrichment()).add_loader(sink)
    assert p.run() == {"extracted": 3, "loaded": 3, "invalid": 2}
    rows = {r.student_id: r for r in sink.read(spark).collect()}
    assert set(rows) == {"1", "2"} and rows["1"].university == "Toronto" and rows["2"].university == "British Columbia" and rows["1"].application_date_month == 1
    assert rows["2"]["_validation_errors"] == ["missing program", "gpa out of range"]
    assert p.run(since=("application_date", "2024-01-01"))["extracted"] == 2 and sink.versions(spark)[-1] == 2
    assert sink.exists(spark, {"student_id": "2"}) and p.run(dry=True)["loaded"] == 0
    with pytest.raises(ValueError):
        etl.Pipeline().run()


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbfSchool,Avg\n"X, Y",90\nZ\n')
    df = readers.read_csv(spark, str(tmp_path / "a.csv"), {"School": "university", "Avg": "grade"}, ["university", "grade", "province", "cycle_year"], {"cycle_year": "2023"})
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == ["('X, Y', '90', None, '2023')", "('Z', None, None, '2023')"]
    assert readers.count_lines(spark, str(tmp_path / "a.csv")) == 2
    assert sorted(map(str, (r.u for r in readers.read_csv_positions(spark, str(tmp_path / "a.csv"), {0: "u"}).collect()))) == ["X, Y", "Z"]
    (tmp_path / "b.json").write_text(json.dumps({"d": {"rows": [{"x": 1}, {"x": 2}]}}))
    assert sorted(r.x for r in readers.read_json(spark, str(tmp_path / "b.json"), "d.rows").collect()) == [1, 2]
    (tmp_path / "c.yaml").write_text("Toronto: [UofT, u of t]\nYork:\n")
    assert {(r.alias, r.canonical) for r in readers.read_aliases(spark, str(tmp_path / "c.yaml")).collect()} == {("uoft", "Toronto"), ("u of t", "Toronto"), ("toronto", "Toronto"), ("york", "York")}
    web = {"http://h/1": {"results": [{"a": 1}], "next": "/2"}, "http://h/2": {"data": [{"a": 2}]}}
    assert list(readers.pages("http://h/1", fetch=web.__getitem__)) == [{"a": 1}, {"a": 2}]
    readers.register(spark)


def test_analytics_parts(spark):
    rows = [("U", "P", g, d, 2023, m) for g, d, m in ((90.0, "Accepted", 3), (95.0, "Accepted", 1), (70.0, "Rejected", 2), (None, "Accepted", 5), (99.0, "Accepted", 4))]
    df = spark.createDataFrame(rows, "university string, program string, grade double, decision string, cycle_year int, decision_month int")
    t = analytics.timeline(df, ["university"]).first()
    assert (t.earliest, t.median, t.latest, t.n) == (1, 4, 5, 4)  # the upper median of 1 3 4 5
    assert analytics.select_program(df, "the u", "p").count() == 5 and analytics.select_program(df, "zz", "p").count() == 0
    bins = analytics.histogram(df)
    assert sum(r.accepted + r.rejected for r in bins.collect()) == 4
    assert analytics.percentile_in_histogram(bins, 120.0).first().percentile == 100 and analytics.percentile_in_histogram(bins.limit(0), 50.0).first().percentile == 50
    assert analytics.grade_stats(df.where("grade = 70")).first()["std"] == 0.0
    doc = analytics.program_document(df, "U", "P").first()
    assert len(doc.decisions) == 2 and doc.timeline[0].latest == 5


def test_streams_equal_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    src = str(tmp_path / "in")
    events.orderBy("ts").repartitionByRange(4, "ts").write.parquet(src)
    flush = events.limit(1).withColumn("ts", F.expr("timestamp'2030-01-01'"))
    flush.write.mode("append").parquet(src)
    for name, f in (("tumbling", ST.tumbling_counts), ("sliding", ST.sliding_average), ("sess", ST.sessions)):
        out = ST.run_available(f(ST.read_stream(spark, src, events.schema, 10)), name, str(tmp_path / name))
        want = f(events)
        key = lambda d: sorted(tuple(round(v, 4) if isinstance(v, float) else str(v) for v in r) for r in d.collect())
        assert key(out.where("start < '2029-01-01'")) == key(want)
    dedup = ST.run_available(ST.deduplicated(ST.read_stream(spark, src, events.schema, 10), ["user_id", "event_type"], "1000 days"), "dd", str(tmp_path / "dd"))
    assert dedup.select("user_id", "event_type").distinct().count() == dedup.count()


def test_serving(spark):
    from kestrix.operators import serving as SV

    rows = [(1, 95.0, "U", "P", None, 90.0, "on", "Canada", 2024, [("chess",)]), (2, 101.0, "U", "", None, None, "ZZ", None, 2024, None), (3, 0.0, "U", "P", 0.0, None, None, "France", 2024, [])]
    out = {r.request_id: r for r in SV.Scorer().score(spark.createDataFrame(rows, SV.REQUEST)).collect()}
    z = -9.0 + 0.08 * 95 + 0.015 * 95 + 0.02 * 90 + 0.1 + 0.1 + 0.15
    assert math.isclose(out[1].probability, 1 / (1 + math.exp(-z))) and out[1].low <= out[1].probability <= out[1].high
    assert out[1].reasons[0].feature == "top_6" and len(out[1].reasons) == 5 and out[1].label == "Likely"
    assert out[2].errors == ["top_6_average must be within 0 and 100", "program is required", "unknown province"] and out[2].probability is None
    assert out[3].label == "Unlikely" and out[3].probability == 0.001
    assert one(spark, " UofT ", lambda c: SV.canonical(c, {"uoft": "Toronto"})) == "Toronto"
    v = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "b"), (3, [0.0, 1.0], "c")], "id bigint, vector array<double>, name string")
    assert [r.similar for r in SV.similar_programs(v.where("id = 1"), v, "id", "name", 2).orderBy("rank").collect()] == ["b", "c"]


def test_normalizers(spark):
    from kestrix.operators import normalizers as N

    al = spark.createDataFrame([("uoft", "University of Toronto"), ("university of toronto", "University of Toronto"), ("york university", "York University")], "alias string, canonical string")
    u = N.UniversityNormalizer(al)
    df = spark.createDataFrame([(" UofT",), ("Universty of Toronto",), ("zzz",), (None,)], "name string")
    rows = {r.name: (r.canonical, r.match_kind) for r in u.normalize(df, "name").collect()}
    assert rows == {" UofT": ("University of Toronto", "exact"), "Universty of Toronto": ("University of Toronto", "fuzzy"), "zzz": ("INVALID", "invalid"), None: ("INVALID", "invalid")}
    assert tuple(N.report(u.normalize(df, "name")).first()) == (1, 1, 2, 4, 50.0)
    assert u.variations("York University") == ["york university"] and u.canonical_names() == ["University of Toronto", "York University"]
    bases = spark.createDataFrame([("comp sci", "Computer Science")], "alias string, canonical string")
    got = N.normalize_programs(spark.createDataFrame([("BSc Comp Sci Co-op",)], "p string"), "p", bases).first()
    assert (got.base_name, got.name_key, got.degree, got.is_coop) == ("Computer Science", "computer_science", "BSc", True)


def test_writers(spark, tmp_path):
    from kestrix.sources import writers as W

    members = spark.createDataFrame([(0, "A", "a1", 0.9, 3), (0, "A", "a2", 0.8, 1)], "cluster_id int, canonical string, variant string, score double, frequency bigint")
    W.write_clusters(members, str(tmp_path / "j"))
    assert len(spark.read.json(str(tmp_path / "j")).first().members) == 2
    W.write_csv(members.withColumn("action", F.lit("KEEP")).withColumn("notes", F.lit("")).withColumn("merge_target", F.lit(None).cast("int")), str(tmp_path / "c"))
    back = W.read_review(spark, str(tmp_path / "c"))
    assert sorted(r.variant for r in back.collect()) == ["a1", "a2"] and back.where("merge_target is null").count() == 2
    assert W.mapping_yaml(matching.apply_review(back)) == "A:\n- a1\n- a2\n"
    W.save_model(spark, {"beta": [1.5, 2]}, str(tmp_path / "m"))
    assert W.load_model(spark, str(tmp_path / "m")) == {"beta": [1.5, 2]}
    W.write_partitioned(members, str(tmp_path / "p"), ["cluster_id"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_small_linear_algebra():
    from kestrix.operators import small_linalg as Q

    rng = np.random.default_rng(9)
    a, b, w = rng.normal(size=(7, 3)), rng.normal(size=7), rng.random(7) + 0.1
    for reduced in (True, False):
        q, r = Q.qr(a, reduced)
        assert max(Q.factorization_report(a, q, r).values()) < 1e-12
    want = np.linalg.lstsq(a, b, rcond=None)[0]
    assert np.allclose(Q.solve_qr(a, b), want) and np.allclose(Q.solve_svd(a, b), want)
    ridge = np.linalg.solve(a.T @ a + 2 * np.eye(3), a.T @ b)
    assert np.allclose(Q.ridge_svd(a, b, 2.0), ridge) and np.allclose(Q.solve_weighted_qr(a, b, np.ones(7), 2.0), ridge)
    assert np.allclose(Q.solve_weighted_qr(a, b, w), np.linalg.solve(a.T @ (a * w[:, None]), a.T @ (b * w)))
    u, s, v = Q.truncated_svd(a, 2)
    assert np.allclose(s, np.linalg.svd(a)[1][:2]) and np.allclose(a @ v, u * s)
    with pytest.raises(np.linalg.LinAlgError):
        Q.back_substitution(np.zeros((2, 2)), np.ones(2))
    assert Q.is_positive_definite(a.T @ a) and not Q.is_symmetric(a[:3] + np.triu(np.ones((3, 3)), 1))
    g = np.array(Q.gram_schmidt([a[0], a[1], a[0] * 2]))
    assert g.shape == (2, 3) and np.allclose(g @ g.T, np.eye(2))


def test_sql_surface(spark, sf):
    from kestrix import sql

    assert "vector_cosine" in sql.register_functions(spark)
    sql.register_tables(spark, {"part": f"{sf}/part.parquet", "two": spark.range(2)})
    row = sql.query(spark, "SELECT vector_cosine(array(1D, 0D), array(1D, 1D)) AS c, vector_cosine(array(0D), array(1D)) AS z, token_similarity('b a!', 'A b') AS s, token_similarity('ab', '') AS e, logistic(0D) AS l, posterior_mean(1D, 2D, 0.5D, 2D) AS m, contains_either('Red gear', 'GEAR') AS h").first()
    assert math.isclose(row.c, math.sqrt(0.5)) and (row.z, row.s, row.e, row.l, row.m, row.h) == (0.0, 1.0, 0.0, 0.5, 0.5, True)
    n = sql.query(spark, "SELECT count(*) AS n FROM part CROSS JOIN two WHERE p_type = :kind", kind="SMALL").first().n
    assert n == 2 * spark.read.parquet(f"{sf}/part.parquet").where("p_type = 'SMALL'").count()


def test_hazard_fit_has_all_periods(spark):
    rng = np.random.default_rng(5)
    data = [(k, int(rng.integers(1, 10)), float(rng.normal())) for k in range(300)]
    df = spark.createDataFrame(data, "id bigint, time int, x double")
    m = models.fit_hazard(df, "time", ["x"])
    assert m.columns == [f"t{k}" for k in range(1, max(t for _, t, _ in data) + 1)] + ["x"]
    rows = [(t, x, int(t == last)) for _, last, x in data for t in range(1, last + 1)]
    q = np.array([1 / (1 + np.exp(-(m.beta[t - 1] + m.beta[-1] * x))) for t, x, _ in rows])
    r = np.array([y for *_, y in rows]) - q
    for k in range(1, 10):  # the gradient of the ridge fit is 0
        assert abs(sum(v for v, (t, *_) in zip(r, rows) if t == k) - 0.1 * m.beta[k - 1]) < 1e-4
    assert abs(sum(v * x for v, (_, x, _) in zip(r, rows)) - 0.1 * m.beta[-1]) < 1e-4
    assert models.fit_hazard(df, "time", ["x"], 3).columns == ["t1", "t2", "t3", "x"]


def test_bootstrap_interval_has_the_width_of_the_auc(spark):
    import inspect

    assert inspect.signature(D.bootstrap_auc).parameters["rounds"].default == 1000
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 300)
    p = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)
    got = D.bootstrap_auc(spark.createDataFrame([(k, int(a), float(b)) for k, (a, b) in enumerate(zip(y, p))], "id bigint, y int, p double")).first()
    pos, neg = p[y == 1], p[y == 0]

    def auc(u, v):
        return ((u[:, None] > v).mean() + (u[:, None] == v).mean() / 2).item()

    every = [auc(rng.choice(pos, len(pos)), rng.choice(neg, len(neg))) for _ in range(1000)]
    assert abs(got.auc_mean - auc(pos, neg)) < 0.005
    assert abs(got.low - np.percentile(every, 2.5)) < 0.012 and abs(got.high - np.percentile(every, 97.5)) < 0.012


def _score(a, b):
    """Of sorted words, by a plain edit distance."""
    a, b = (" ".join(sorted("".join(c for c in x.lower() if c.isalnum() and c.isascii() or c.isspace()).split())) for x in (a, b))
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return 1 - row[-1] / max(len(a), len(b))


def test_similar_pairs_lose_none(spark):
    rng = random.Random(5)
    base = ["University of Waterloo", "University of Toronto", "Queens University", "McGill", "Simon Fraser University", "UBC", "York", "x", "ab", "!!", "Western University", "Universite de Montreal"]
    names = list(base)
    for _ in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "t", "e", " ", "z"])
        names.append("".join(w))
    names = sorted(set(names))
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for least in (0.85, 0.7, 0.5):
        out = {(r.a, r.b): r.score for r in matching.similar_pairs(df, df, "n", "n", least).collect()}
        want = {(a, b): s for a in names for b in names if (s := _score(a, b)) >= least}
        assert out.keys() == want.keys() and all(abs(out[k] - s) < 1e-9 for k, s in want.items())
    hit = {r.n: r.canonical for r in matching.best_match(spark.createDataFrame([("Watterloo",), ("nothing like it",), (None,)], "n string"), "n", spark.createDataFrame([("Waterloo",), ("Toronto",)], "c string"), "c").collect()}
    assert hit["Watterloo"] == "Waterloo" and hit["nothing like it"] == "INVALID"
    # clusters: one name after the other
    rows = [(n,) for n in names for _ in range(1 + len(n) * 7 % 5)]
    freq = Counter(n for n, in rows)
    want, done = {}, set()
    for lead in sorted(freq, key=lambda n: (-freq[n], -len(n), n)):
        if lead not in done:
            mine = [n for n in names if n not in done and _score(n, lead) >= 0.7]
            done.update(mine)
            want |= {n: (len(set(v[0] for v in want.values())), lead) for n in mine}
    got = {r.variant: (r.cluster_id, r.canonical) for r in matching.leader_clusters(spark.createDataFrame(rows, "n string"), "n", 0.7).collect()}
    assert got == want


def test_numbers_of_a_group_of_all_rows(spark):
    df = spark.range(5000).select("id", F.lit("one").alias("g"), (F.col("id") * 7919 % 5000).alias("v")).unionByName(spark.range(3).selectExpr("id", "cast(null as string) AS g", "id AS v"))
    rows = windows.numbered(df.repartition(7), [F.col("v").desc(), F.col("id")], ("g",)).collect()
    assert {(r.g, r.v): r.rn for r in rows} == {("one", v): 5000 - v for v in range(5000)} | {(None, v): 3 - v for v in range(3)}
    assert [r.rn for r in windows.numbered(df.limit(0), [F.col("v")]).collect()] == []


def test_isotonic_of_many_shapes(spark):
    rng = random.Random(3)
    for shape in (lambda p: p, lambda p: 1 - p, lambda p: 0.5 + 0.4 * (p * 9 % 1)):
        rows = [(p, int(rng.random() < shape(p))) for p in (rng.random() for _ in range(3000))]
        blocks = []
        for p, y in sorted(rows):
            blocks.append([p, p, 1, y])
            while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
                _, high, n, s = blocks.pop()
                blocks[-1] = [blocks[-1][0], high, blocks[-1][2] + n, blocks[-1][3] + s]
        out = sorted((r.low, r.high, r.n, round(r.value, 9)) for r in C.isotonic(spark.createDataFrame(rows, "p double, y int")).collect())
        assert out == [(a, b, n, round(s / n, 9)) for a, b, n, s in blocks]


def test_upsert_goes_on_from_the_newest_version(spark, tmp_path):
    from kestrix.operators.etl import ParquetUpsert

    path = str(tmp_path / "sink")
    ParquetUpsert(path, ["id"]).load(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"))
    for k in range(3):
        ParquetUpsert(path, ["id"]).load(spark.createDataFrame([(3, f"c{k}")], "id int, v string"))
    sink = ParquetUpsert(path, ["id"])
    assert sorted(map(tuple, sink.read(spark).collect())) == [(1, "a"), (2, "b"), (3, "c2")] and len(sink.versions(spark)) == 2
    sink.delete(spark, {"id": 1})
    assert not sink.exists(spark, {"id": 1}) and sink.exists(spark, {"id": 2})


def test_gram_of_many_columns(spark):
    from kestrix.operators import linalg

    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 12))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"x{i} double" for i in range(12)))
    names = [f"x{i}" for i in range(11)]
    a, b = linalg.gram(df, names, "x11", most=5), linalg.gram(df, names, "x11")
    assert np.allclose(a[0], b[0]) and np.allclose(a[1], b[1]) and abs(a[2] - b[2]) < 1e-9 and a[3] == b[3] == 200


def test_all_pairs_beyond_a_broadcast(spark):
    from kestrix.functions import vectors

    a, b = spark.range(30).withColumnRenamed("id", "a"), spark.range(40).withColumnRenamed("id", "b")
    for few in (100, 5):
        rows = [(r.a, r.b) for r in vectors.all_pairs(a, b, few).collect()]
        assert len(rows) == len(set(rows)) == 1200


def test_object_store(spark, tmp_path):
    from kestrix.operators import objects as O

    store = O.ObjectStore(spark, str(tmp_path / "store"))
    assert not store.is_ready() and store.connect().is_ready()
    store.create_schema(O.program_schema(2))
    store.create_schema(O.student_schema(2))
    with pytest.raises(ValueError):
        store.create_schema(O.student_schema(2))
    assert store.class_exists("Program") and [s["class"] for s in store.get_schema()] == ["Program", "Student"]
    assert store.objects("Student").count() == 0
    store.add_object("Student", {"student_id": "s1", "gpa": 88.0, "interests": ["chess"]}, [1.0, 0.0], "a")
    rows = spark.createDataFrame([("b", "s2", 70.0, [0.0, 1.0]), ("c", "s3", 95.0, [0.9, 0.1]), ("a", "s1", 89.0, [1.0, 0.0])], "id string, student_id string, gpa double, vector array<double>")
    assert store.add_objects("Student", rows) == 2
    assert store.get_object("Student", "a")["gpa"] == 89.0 and store.get_object("Student", "z") is None
    assert store.update_object("Student", "b", {"gpa": 71.0}) and not store.update_object("Student", "z", {})
    assert [r.id for r in store.find_matching_students([1.0, 0.0], 5, 80, 94).collect()] == ["a"]
    assert store.delete_object("Student", "a") and not store.delete_object("Student", "a")
    assert sorted(r.id for r in O.ObjectStore(spark, store.path).objects("Student").collect()) == ["b", "c"]
    with pytest.raises(Exception, match="have 2 numbers"):
        store.add_object("Student", {"student_id": "x"}, [1.0], "x")
    store.add_object("Program", {"name": "CS", "province": "ON"}, [1.0, 0.0], "p")
    assert store.recommend_programs([1.0, 0.0], "BC").count() == 0 and store.recommend_programs([1.0, 0.0], "ON").count() == 1
    store.delete_schema("Program")
    assert not store.class_exists("Program")
    store.disconnect()
    assert not store.is_ready()


def test_attention_model(spark):
    from kestrix.operators import attention as A

    a = A.Attention(8, 2).build()
    x = np.random.default_rng(0).normal(size=(3, 8))
    out, w = a.apply(x, x, x)
    heads = []
    for h in range(2):
        cut = slice(4 * h, 4 * h + 4)
        q, k, v = (x @ a.weights[c][:, cut] for c in "qkv")
        e = np.exp(q @ k.T / 2)
        heads.append(e / e.sum(axis=1, keepdims=True) @ v)
        assert np.allclose(w[h], e / e.sum(axis=1, keepdims=True))
    assert np.allclose(out, np.concatenate(heads, axis=1) @ a.weights["o"])
    with pytest.raises(ValueError):
        A.Attention(8, 2).apply(x, x, x)
    df = spark.createDataFrame([(1, [[float(v) for v in r] for r in x]), (2, []), (3, None)], "id int, tokens array<array<double>>")
    rows = {r.id: r.a for r in df.select("id", a.self_attention(F.col("tokens")).alias("a")).collect()}
    assert np.allclose(rows[1].output, out) and rows[2].output is None and rows[3].weights is None
    top = A.top_attention(df.where("id = 1").select("id", a.self_attention(F.col("tokens")).alias("a")).select("id", "a.weights"), "id", "weights", ["p", "q", "r"], 2).collect()
    assert [r["rank"] for r in top] == [1, 2] and abs(top[0].weight - w.mean(axis=(0, 1)).max()) < 1e-12
    rng = random.Random(2)
    data = spark.createDataFrame([(k, rng.random(), f"u{k % 3}", f"p{k % 2}", int(k % 3 == 0)) for k in range(120)], "id int, g double, u string, p string, y int")
    model = A.AttentionModel(["g"], ["u", "p"], 8, 2)
    with pytest.raises(ValueError):
        model.predict_proba(data)
    scored = model.fit(data, "y").predict_proba(data).collect()
    assert sum((r.probability >= 0.5) == (r.y == 1) for r in scored) > 110
    assert sum(r.weight for r in model.patterns(data).collect()) == pytest.approx(3.0)
    assert {r.name for r in model.explain(data.limit(1), "id").collect()} == {"numbers", "u", "p"}
    assert data.limit(1).select(A.bars(F.lit(0.25), 8)).first()[0] == "##"


def test_encoders_by_name(spark):
    rows = spark.createDataFrame([(1, 80.0, "U", "CS", "Fall 2023", "2024-01-05", 1), (2, 90.0, "V", "CS", "Winter 2024", "2024-02-01", 0), (3, None, "U", "Art", "Fall 2024", "2024-03-01", 1)], "id int, grade double, university string, program string, term string, decision_date string, y int").withColumn("decision_date", F.to_date("decision_date")).withColumn("empty", F.lit(None).cast("string"))
    made = E.Composite([E.Encoder("gpa", "grade"), E.Encoder("one_hot", "university"), E.Encoder("term", "term"), E.Encoder("date", "decision_date"), E.Encoder("woe", "program"), E.Encoder("ordinal", "program")]).fit(rows, "y")
    out = made.transform(rows)
    assert set(made.names()) <= set(out.columns) and made.names()[:3] == ["grade_scaled", "university_U", "university_V"]
    assert {r.id: r.grade_scaled for r in out.collect()} == {1: -1.0, 2: 1.0, 3: None}
    coded, used = E.encode_admissions(rows, "y")
    assert set(used) == {"grade", "university", "program", "term", "decision_date"} and "empty" not in used
    again, _ = E.encode_admissions(rows.drop("y"), None, used)
    assert {"university_encoded", "program_frequency", "term_year"} <= set(again.columns) and coded.count() == again.count() == 3
    with pytest.raises(ValueError):
        E.Encoder("target", "university").fit(rows)


def test_service(spark):
    import threading
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    from kestrix.service import Service, server

    now = [0.0]
    s = Service(spark, per_minute=3, clock=lambda: now[0])
    assert s.health()["status"] == "unhealthy" and s.handle("POST", "/predict", {})[0] == 503
    s.startup()
    good = {"top_6_average": 92.0, "university": "U", "program": "CS"}
    both = s.predict_batch([good, {"university": "U"}])
    assert 0 < both[0]["probability"] < 1 and both[1]["errors"] and both[1]["probability"] is None and s.predict_batch([]) == []
    assert s.handle("GET", "/health")[0] == 200 and s.handle("GET", "/nowhere")[0] == 404 and s.handle("GET", "/health")[0] == 429
    now[0] = 61.0
    assert s.handle("GET", "/model/info")[1]["version"] == "1" and [x["status"] for x in s.log] == [503, 200, 404, 429, 200]
    web = server(Service(spark))
    threading.Thread(target=web.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{web.server_port}"
    assert json.load(urlopen(Request(f"{at}/predict", json.dumps(good).encode(), {"Content-Type": "application/json"})))["label"]
    with pytest.raises(HTTPError, match="422"):
        urlopen(Request(f"{at}/predict/batch", b"{}"))
    with pytest.raises(HTTPError, match="400"):
        urlopen(Request(f"{at}/predict", b"{"))
    web.shutdown()
    web.server_close()


def test_source_checks_runs_and_formats(spark, tmp_path):
    from kestrix.operators.normalizers import UniversityNormalizer
    from kestrix.sources import writers

    (tmp_path / "good.json").write_text('{"a": 1}')
    (tmp_path / "bad.json").write_text('{"a": ')
    assert readers.is_json(spark, str(tmp_path / "good.json")) and not readers.is_json(spark, str(tmp_path / "bad.json")) and not readers.is_json(spark, str(tmp_path / "none.json"))
    assert not readers.is_reachable("http://127.0.0.1:9/")
    for kind in ("parquet", "orc", "json"):
        writers.write_files(spark.range(5), kind, str(tmp_path / kind))
        assert readers.read_files(spark, kind, str(tmp_path / kind)).count() == 5
    writers.write_csv(spark.createDataFrame([("UofT",), ("zz",)], "university string"), str(tmp_path / "raw/2023"))
    aliases = spark.createDataFrame([("uoft", "University of Toronto")], "alias string, canonical string")
    run = lambda dry: etl.clean_years(spark, str(tmp_path / "raw"), str(tmp_path / "out"), ["2022", "2023"], lambda d: UniversityNormalizer(aliases).normalize(d, "university"), dry=dry).collect()
    assert [tuple(r) for r in run(True)] == [("2023", 2, 1)] and not (tmp_path / "out").exists()
    assert [tuple(r) for r in run(False)] == [("2023", 2, 1)] and (tmp_path / "out/2023").exists()
    members = spark.createDataFrame([(0, "a", "a", 1.0, 3), (0, "a", "b", 0.8, 1), (1, "c", "c", 1.0, 2)], "cluster_id int, canonical string, variant string, score double, frequency bigint")
    counts, top = writers.cluster_summary(members)
    assert counts == {"clusters": 2, "names": 3, "records": 6, "largest": 2} and top.first()["size"] == 2
    assert writers.review_items(members).first().variant == "b" and writers.review_items(members).first().action == "KEEP"
    sink = etl.ParquetUpsert(str(tmp_path / "apps"), ["student_id"])
    vectors = etl.VectorSink(str(tmp_path / "vectors"), ["program"], S.text_vectors(8))
    assert not vectors.exists(spark, {"student_id": "s"})
    etl.admission_pipeline(lambda: spark.createDataFrame([("s", " U ", "CS")], "student_id string, university string, program string"), sink, {"university": {"U": "University"}}, vectors=vectors).run()
    assert sink.read(spark).first().university == "University" and vectors.exists(spark, {"student_id": "s"})


def test_chart_tables(spark):
    from kestrix.operators import charts as H

    assert [s["converged"] for s in H.convergence([3.0, 1.0, 1.0])] == [False, False, True]
    steps = H.gram_schmidt_steps([[1.0, 1.0], [2.0, 2.0], [0.0, 1.0]])
    assert steps[1]["unit"] is None and np.allclose(np.dot(steps[0]["unit"], steps[2]["unit"]), 0)
    parts = H.rank_parts([[3.0, 0.0], [0.0, 1.0]])
    assert np.allclose(parts[0]["part"], [[3, 0], [0, 0]]) and parts[0]["explained"] == pytest.approx(0.9)
    p = H.projection_points([1.0, 2.0, 3.0], [[1.0], [1.0], [1.0]])
    assert np.allclose(p["projection"], 2) and np.allclose(np.array(p["hat"]), 1 / 3)
    assert H.seeded(1, 2) == H.seeded(1, 2) and all(0 <= x < 1 for x in H.seeded(7, 50))
    assert spark.range(1).select(H.normal_pdf(F.lit(0.0), 0.0, 1.0)).first()[0] == pytest.approx(0.3989423)
    flat = spark.createDataFrame([(float(i), 2.0 * i, 0.1 * (i % 2)) for i in range(20)], "a double, b double, c double")
    plane = H.principal_plane(flat, ["a", "b", "c"]).agg(F.var_pop("pc1"), F.var_pop("pc2"), F.covar_pop("pc1", "pc2")).first()
    assert plane[0] > plane[1] > 0 and abs(plane[2]) < 1e-9
    shade = {r.i: r.shade for r in H.heatmap(spark.createDataFrame([(0, 0, 1.0), (1, 0, 3.0)], "i int, j int, v double"), "i", "j", "v").collect()}
    assert shade == {0: 0.0, 1: 1.0}


def test_inverse_lookup_of_many_categories(spark, monkeypatch):
    fitted = spark.createDataFrame([(f"c{k}", k * 0.5) for k in range(30)], "c string, encoded double")
    values = spark.createDataFrame([(v,) for v in (0.1, 0.25, 3.9, 100.0, -4.0, 3.9)], "v double")
    rows = []
    for few in (100, 3):
        monkeypatch.setattr(E, "FEW", few)
        rows.append(sorted(map(tuple, E.inverse_lookup(values, fitted, "c", "v").collect())))
    assert rows[0] == rows[1] and len(rows[0]) == 6


def test_embeddings_of_many_pairs_equal_those_of_few(spark):
    rng = np.random.default_rng(3)
    rows = [(f"u{i % 7}", f"p{j % 5}", float(rng.integers(0, 2))) for i in range(12) for j in range(9) for _ in range(3)]
    df = spark.createDataFrame([*rows, (None, "p1", 1.0), ("u1", None, 0.0), ("u1", "p1", None)], "u string, p string, y double")
    few = [{r.name: (r.id, r.embedding) for r in t.collect()} for t in models.train_embeddings(df, "u", "p", "y", 2, 3)]
    many = [{r.name: (r.id, r.embedding) for r in t.collect()} for t in models.train_embeddings(df, "u", "p", "y", 2, 3, few=0)]
    for a, b in zip(few, many):
        assert {k: i for k, (i, _) in a.items()} == {k: i for k, (i, _) in b.items()} and len(a) in (5, 7)
        assert all(np.allclose(a[k][1], b[k][1], atol=1e-9) for k in a)
    assert [t.count() for t in models.train_embeddings(df.limit(0), "u", "p", "y", 2, 3)] == [0, 0]
