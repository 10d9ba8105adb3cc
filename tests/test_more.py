"""Kernel machine, pivot index, rank join, filter-and-verify, JSON entries, extraction, SIFT, frequencies by batch, uploads as a stream."""

import json
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_images import png

from matchloom.cluster import drop, materialize
from matchloom.functions import images as I
from matchloom.functions import sift as S
from matchloom.operators import evaluate as E
from matchloom.operators import kernel as K
from matchloom.operators import labels as L
from matchloom.operators import match as M
from matchloom.operators.blocks import best_k, dealt, similarities
from matchloom.operators.extraction import FeatureExtraction
from matchloom.operators.knn import KnnMatcher
from matchloom.operators.matching import Matcher
from matchloom.operators.pairs import PairClassifier, block_margins
from matchloom.operators.pivots import PivotIndex
from matchloom.operators.rankjoin import RankJoin
from matchloom.operators.tfidf import FrequencyTable, TfIdf
from matchloom.sources import items as R
from matchloom.sources import sinks
from matchloom.sources.entries import json_entries
from matchloom.streaming import uploads


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


# --- kernel machine ----------------------------------------------------------------------------------------------


def two_moons(n, seed=3):
    rng = np.random.RandomState(seed)
    t, y = rng.rand(n) * np.pi, np.where(rng.rand(n) < 0.5, 1.0, -1.0)
    x = np.stack([np.cos(t) * y + (y < 0), np.sin(t) * y + 0.4 * (y < 0)], 1) + rng.randn(n, 2) * 0.25
    return x, y


def brute_dual(k, y, c, rounds=20_000):
    """Projected gradient ascent on the dual: slow, and by another way."""
    a, q = np.zeros(len(y)), k * np.outer(y, y)
    step = 1.0 / np.linalg.eigvalsh(q)[-1]
    momentum, t = a.copy(), 1.0
    for _ in range(rounds):
        z, low, high = momentum + step * (1 - q @ momentum), -1e3, 1e3
        for _ in range(60):  # the shift that makes y times alpha sum to 0
            mid = (low + high) / 2
            low, high = (mid, high) if (np.clip(z - mid * y, 0, c) @ y) > 0 else (low, mid)
        new, s = np.clip(z - mid * y, 0, c), (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum, t = new + (t - 1) / s * (new - a), s
        a = new
    return a


@pytest.mark.parametrize("kind", ["rbf", "poly"])
def test_cascade_reaches_the_dual_optimum(spark, kind):
    x, y = two_moons(500)
    data = spark.createDataFrame([(i * 7919, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "h long, x array<double>, y double").repartition(4)
    machine = K.cascade(data, 500, 1.0, kind, 0.7, 3, part=70)
    k = K.block(x, x, kind, 0.7, 3).astype(float)
    at = {tuple(np.round(v, 9)): i for i, v in enumerate(x)}
    alpha = np.zeros(500)
    for v, c in zip(machine.vectors, machine.coef):
        i = at[tuple(np.round(v, 9))]
        alpha[i] = c * y[i]
    best = K.objective(brute_dual(k, y, 1.0, 4000), y, k)
    assert alpha.min() >= 0 and alpha.max() <= 1 and abs(alpha @ y) < 1e-6
    assert K.objective(alpha, y, k) >= best - 0.01 * abs(best)
    margin = k @ (alpha * y) + machine.bias
    got = sorted(r["margin"] for r in machine.margins.collect())
    assert got == pytest.approx(sorted(margin), abs=1e-3) and (np.sign(margin) == y).mean() > 0.9
    assert machine.joined[-1] == 0


def test_solver_in_blocks(monkeypatch):
    """Kernel rows made as asked for give what the whole matrix gives; one class alone has no boundary."""
    x, y = two_moons(300, 5)
    whole = K.solve(x, y, 2.0, "rbf", 1.0, 3, working=32)
    monkeypatch.setattr(K, "KEPT", 1)
    parts = K.solve(x, y, 2.0, "rbf", 1.0, 3, working=32)
    k = K.block(x, x, "rbf", 1.0, 3)
    assert K.objective(whole[0], y, k) == pytest.approx(K.objective(parts[0], y, k), rel=1e-4) and whole[1] == pytest.approx(parts[1], abs=5e-3)
    assert not K.solve(x, np.ones(300), 1.0, "rbf", 1.0, 3)[0].any() and len(K.solve(x[:0], y[:0], 1.0, "rbf", 1.0, 3)[0]) == 0


def test_platt():
    """Newton's values against a fine search of the same loss."""
    rng = np.random.RandomState(0)
    y = np.where(rng.rand(400) < 0.3, 1.0, -1.0)
    m = y * 0.8 + rng.randn(400)
    a, b = K.platt(m, y)
    pos = y > 0
    target = np.where(pos, (pos.sum() + 1) / (pos.sum() + 2), 1 / ((~pos).sum() + 2))
    loss = lambda a, b: -(target * np.log(p := 1 / (1 + np.exp(a * m + b))) + (1 - target) * np.log(1 - p)).sum()
    assert a < 0 and all(loss(a, b) <= loss(a + da, b + db) + 1e-6 for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))


def test_classifier_scores_in_blocks(spark):
    """Block margins are those of pair features laid out, for every kernel; the classifier learns what a pair is."""
    rng = np.random.RandomState(1)
    centre = rng.randn(6, 5)
    vecs = [(i, i % 6, "lost" if i % 2 else "found", (centre[i // 2 % 6] + 0.2 * rng.randn(5)).tolist()) for i in range(120)]
    pairs = [(a[0], b[0], a[3], b[3], float(a[0] // 2 % 6 == b[0] // 2 % 6)) for a in vecs for b in vecs if a[2] == "lost" and b[2] == "found" and rng.rand() < 0.25]
    df = spark.createDataFrame(pairs, "lost_id long, found_id long, lost_image array<double>, found_image array<double>, label double")
    for kernel, features in (("rbf", None), ("poly", None), ("linear", None), ("rbf", 200), ("poly", 200)):
        c = PairClassifier(kernel, c=5.0, features=features).fit(df, part=200)
        got = c.probability(df).select("lost_id", "found_id", "similarity", "label").collect()
        if kernel == "rbf":
            assert np.mean([(r["similarity"] > 0.5) == (r["label"] == 1) for r in got]) > 0.95
        a, b = (np.array([r[3] for r in vecs if r[2] == s]) for s in ("lost", "found"))
        margins = block_margins(c._shape(), c._mapped, a, b)
        at = [{r[0]: i for i, r in enumerate(v for v in vecs if v[2] == s)} for s in ("lost", "found")]
        p = c._probability(margins)
        assert max(abs(p[at[0][r["lost_id"]], at[1][r["found_id"]]] - r["similarity"]) for r in got) < 1e-3


# --- blocks, pivots, rank join -----------------------------------------------------------------------------------


def test_small_categories_are_not_copied(spark):
    """One large category beside many small ones: rows are copied as often as their own category needs."""
    lost = spark.createDataFrame([(i, 0 if i < 400 else i % 50 + 1) for i in range(600)], "id long, category int")
    found = spark.createDataFrame([(i, 0 if i < 300 else None if i < 310 else i % 50 + 1) for i in range(500)], "id long, category int")
    left, right = dealt(lost, found, "category", 100)
    assert left.where("category = 0").count() == 400 * 3 and left.where("category > 0").count() == 200
    assert right.where("category = 0").count() == 300 * 4 and right.where("category > 0").count() == 190 and right.where("category IS NULL").count() == 0
    nulls = spark.createDataFrame([(1000, None)], "id long, category int")
    assert dealt(nulls, found, "category", 100)[1].count() == 10


def clustered(spark, n=1200, seed=0, metric="cosine"):
    rng = np.random.RandomState(seed)
    centre = rng.randn(30, 8) * 4
    rows = [(i, (centre[rng.randint(30)] + 0.3 * rng.randn(8)).tolist()) for i in range(n)]
    rows += [(n + 1, [0.0] * 8), (n + 2, [0.0] * 8), (n + 3, None), (n + 4, rows[0][1]), (n + 5, rows[0][1])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    return df.where("id % 3 > 0"), df.where("id % 3 = 0 OR id > 1200")


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan"])
def test_pivot_index_is_exact(spark, metric):
    found, queries = clustered(spark)
    index = PivotIndex(found, metric)
    got = index.search(queries, 7)
    near = {"cosine": lambda x, y: _cosine(x, y) - 1, "euclidean": lambda x, y: -np.sqrt(((x[:, None] - y) ** 2).sum(-1)), "manhattan": lambda x, y: -np.abs(x[:, None] - y).sum(-1)}[metric]
    f, q = ([(r["id"], r["v"]) for r in df.collect() if r["v"] is not None] for df in (found, queries))
    s = near(np.array([v for _, v in q]), np.array([v for _, v in f]))
    want = {}
    for i, (name, _) in enumerate(q):
        order = sorted(range(len(f)), key=lambda j: (-round(s[i, j], 9), f[j][0]))[:7]
        want[name] = [(round(s[i, j], 6)) for j in order]
    found_by = {}
    for r in got.orderBy("lost_id", "rank").collect():
        found_by.setdefault(r["lost_id"], []).append(round(r["near"], 6))
    assert {k: pytest.approx(v, abs=2e-6) for k, v in want.items()} == found_by
    share = index.compared().first()
    assert 0 < share["compared"] < 0.3 * share["pairs"]


def _cosine(x, y):
    n = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    return n(x) @ n(y).T


def test_pivots_give_what_all_pairs_give(spark):
    found, queries = clustered(spark, 300)
    full = lambda df: df.where("v IS NOT NULL").select("id", (F.col("id") % 4).alias("category"), F.col("v").alias("image"))
    plain, through = (KnnMatcher(5, pivots=p).fit(full(found)) for p in (False, True))
    key = lambda m: sorted((r["lost_id"], r["found_id"], r["rank"], round(r["distance"], 9)) for r in m.predict(full(queries)).collect())
    assert key(plain) == key(through) and key(through)
    few = PivotIndex(found.limit(3), "euclidean").search(queries, 5)
    assert few.groupBy("lost_id").count().where("count <> 3").isEmpty()
    with pytest.raises(ValueError):
        KnnMatcher(5, prefilter=True, pivots=True)


def test_rank_join_equals_all_pairs(spark):
    rng = np.random.RandomState(4)
    rows = [(i, i % 3 if i % 17 else None, "lost" if i % 2 else "found", rng.randn(6).tolist() if i % 11 else None, np.abs(rng.randn(5)).tolist()) for i in range(400)]
    it = spark.createDataFrame(rows, "id long, category int, status string, image array<double>, text array<double>")
    lost, found = it.where("status = 'lost'"), it.where("status = 'found'")
    for first, minimum in ((2, 0.3), (30, 0.0), (4, 0.97)):
        join = RankJoin({"image": 0.6, "text": 0.4}, 4, minimum, first=first)
        got = {(r["lost_id"], r["rank"], r["found_id"], round(r["similarity"], 9)) for r in join.run(lost, found).collect()}
        want = {(r["lost_id"], r["rank"], r["found_id"], round(r["similarity"], 9)) for r in Matcher(top_k=4, min_similarity=minimum).match(lost, found).collect()}
        assert got == want
    assert len(join.rounds) >= 1 and join.rounds[0][1] < 200 * 67
    with pytest.raises(ValueError):
        RankJoin({"image": -1.0})


# --- labels, quantiles -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("version,least", [(1, 0.35), (2, 0.2)])
def test_filter_and_verify(spark, version, least):
    """The best pairs are those of all pairs, and the sequence ratio is taken for fewer than a tenth of them."""
    rng = random.Random(2)
    words = "red blue black nike leather backpack small strap bottle grey laptop apple casio".split() + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 10))) for _ in range(150)]
    rows = [(i, i % 2, "lost" if i % 4 < 2 else "found", None if i % 19 == 0 else " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))) for i in range(400)]
    rows += [(1000 + i, 0, s, d) for i, (s, d) in enumerate([("lost", "Red Nike bag"), ("found", "red nike bag"), ("found", "red nike bag"), ("lost", ""), ("found", "")])]
    it = L.with_phrases(spark.createDataFrame(rows, "id long, category int, status string, description string"), version)
    every = M.candidates(it).withColumn("similarity", L.score(version))
    want = M.rank(every.select("lost_id", "found_id", "similarity"), 1).where((F.col("similarity") > 0) & (F.col("similarity") >= least))
    best, verified = L.best_pairs(it, version, least)
    key = lambda df: sorted((r["lost_id"], r["found_id"], round(r["similarity"], 9)) for r in df.collect())
    assert key(best) == key(want) and key(best)
    assert verified.count() * 10 < every.count()


def test_bound_is_never_under_the_ratio(spark):
    rng = random.Random(7)
    text = lambda: "".join(rng.choice("abcé z9漢") for _ in range(rng.randrange(0, 300)))
    df = spark.createDataFrame([(text(), text()) for _ in range(200)] + [("", ""), ("a", "")], "a string, b string")
    got = df.select(L.sequence_ratio(F.col("a"), F.col("b")).alias("r"), L.ratio_bound(L.letter_counts(F.col("a")), L.letter_counts(F.col("b"))).alias("u")).collect()
    assert all(r["r"] <= r["u"] for r in got) and got[-2]["u"] == 1.0


def test_quantiles_of_one_value(spark):
    """A value that all rows share is counted before it is ordered: no task sees more rows of it than there were partitions."""
    rows = spark.range(2_000_000).select(F.lit(3.5).alias("x"), (F.col("id") % 2).alias("g")).unionByName(spark.range(10).select(F.col("id").cast("double").alias("x"), F.lit(0).cast("long").alias("g")))
    assert tuple(E.quantiles(rows, "x", {"a": 0.0, "m": 0.5, "z": 1.0}).first()) == (0.0, 3.5, 9.0)
    assert {r["g"]: r["m"] for r in E.quantiles(rows, "x", {"m": 0.25}, ["g"]).collect()} == {0: 3.5, 1: 3.5}
    rng = np.random.RandomState(3)
    x = rng.randint(0, 9, 500).astype(float)
    got = E.quantiles(spark.createDataFrame([(v,) for v in x.tolist()] + [(None,)], "x double"), "x", {f"q{i}": i / 20 for i in range(21)}).first()
    assert list(got) == pytest.approx(list(np.quantile(x, [i / 20 for i in range(21)])))


# --- JSON --------------------------------------------------------------------------------------------------------


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300b", "spark.sql.files.openCostInBytes": "1b", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def odd_json(n, seed):
    rng = random.Random(seed)
    some = lambda: rng.choice(["plain", 'quote " and \\\\ back', "braces }{][,", "}", "é漢 \n", "", 'a"}", "b'])
    return {f"k{i} {some()}": [{"rank": r, "found_id": some(), "similarity": r / 7} for r in range(rng.randrange(0, 4))] for i in range(n)}


@pytest.mark.parametrize("indent", [None, 2])
def test_json_is_read_in_ranges(spark, small_ranges, tmp_path, indent):
    for k, doc in enumerate((odd_json(60, 1), odd_json(1, 2), {}, [{"a": v} for v in odd_json(40, 3)], [[1, 2], "x, y", 3, {"b": {"c": [1]}}])):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(doc, indent=indent, ensure_ascii=k % 2 == 0) + "\n" * (k % 2))
        assert k > 0 or spark.read.text(f"file://{path}").rdd.getNumPartitions() > 5
        texts = [r["text"] for r in json_entries(spark, f"file://{path}").collect()]
        want = [json.dumps({a: b}, sort_keys=True) for a, b in doc.items()] if isinstance(doc, dict) else [json.dumps(x, sort_keys=True) for x in doc]
        assert sorted(json.dumps(json.loads("{" + t + "}" if isinstance(doc, dict) else t), sort_keys=True) for t in texts) == sorted(want)


def test_maps_and_items_in_ranges(spark, small_ranges, tmp_path):
    doc = odd_json(50, 5)
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=1))
    got = sorted((r["lost_id"], r["rank"], r["found_id"]) for r in R.read_matches(spark, f"file://{tmp_path}/m.json").collect())
    assert got == sorted((k, x["rank"], x["found_id"]) for k, v in doc.items() for x in v)
    items = [{"id": str(i), "filename": f"{i}.png", "category": "bag", "timestamp": "2024-01-15T10:00:00Z", "status": "lost", "description": 'a } "quoted" [bag], {', "labelled": i % 2 == 0} for i in range(40)]
    (tmp_path / "items.json").write_text(json.dumps(items))
    assert sorted(json.dumps(r.asDict(), sort_keys=True) for r in R.read_metadata(spark, f"file://{tmp_path}/items.json").collect()) == sorted(json.dumps(x, sort_keys=True) for x in items)
    (tmp_path / "bad.json").write_text('[{"id": 1, "labelled": oops}]')
    with pytest.raises(Exception):
        R.read_metadata(spark, f"file://{tmp_path}/bad.json").collect()


def test_maps_are_written_in_ordered_parts(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        truth = spark.createDataFrame([(f"k{i:04d}", f'f"}}{i}') for i in range(2000)], "lost_id string, found_id string").repartition(5)
        sinks.save_ground_truth(truth, f"file://{tmp_path}/truth")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    parts = sorted((tmp_path / "truth" / "map").glob("part-*"))
    assert len(parts) > 1
    assert json.loads("".join(p.read_text() for p in parts)) == {r["lost_id"]: r["found_id"] for r in truth.collect()}
    for lines in (False, True):
        assert rows_of(R.read_ground_truth(spark, f"file://{tmp_path}/truth/map", lines)) == rows_of(truth)


# --- images ------------------------------------------------------------------------------------------------------


def picture(seed=0, n=224):
    rng = np.random.RandomState(seed)
    g = np.zeros((n, n))
    y, x = np.mgrid[:n, :n]
    for _ in range(25):
        cy, cx, r, v = rng.randint(30, n - 30), rng.randint(30, n - 30), rng.uniform(4, 14), rng.uniform(80, 250)
        g = np.maximum(g, v * np.exp(-(((y - cy) / r) ** 2 + ((x - cx) / (r * rng.uniform(0.5, 2))) ** 2)))
    return g


def test_sift_turns_and_scales_with_the_picture():
    g = picture()
    points = S.keypoints(g)
    assert 5 < len(points) <= 100
    cosine = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)

    def matched(other, place):
        """The share of keypoints found again at ``place``, with a descriptor that is alike."""
        far = S.keypoints(other, 400)
        hit = 0
        for y, x, sigma, _, d in points:
            py, px = place(y, x)
            near = [f for f in far if np.hypot(f[0] - py, f[1] - px) < 4]
            hit += any(cosine(d, f[4]) > 0.9 for f in near)
        return hit / len(points)

    n = len(g)
    assert matched(np.rot90(g), lambda y, x: (n - 1 - x, y)) > 0.7
    assert matched(np.kron(g, np.ones((2, 2))), lambda y, x: (2 * y, 2 * x)) > 0.5
    assert matched(picture(9), lambda y, x: (y, x)) < 0.3
    turned = S.sift(np.rot90(g))
    assert cosine(S.sift(g), turned) > 0.95 and S.sift(g).shape == (128,)
    assert not S.sift(np.full((224, 224), 90.0)).any() and not S.sift(np.zeros((8, 8))).any()


def test_extraction_goes_on_where_it_stopped(spark, tmp_path):
    folder = tmp_path / "images" / "computer-mouse"
    folder.mkdir(parents=True)
    rgb = np.stack([picture(k).astype(np.uint8) for k in range(3)], axis=-1)
    (folder / "a b.png").write_bytes(png(rgb))
    (folder / "broken.png").write_bytes(b"not an image")
    names = {"1": "a b.png", "2": "broken.png", "3": "missing.png"}
    items = [{"id": k, "filename": f, "category": "computer-mouse", "timestamp": "2024-01-15T10:00:00", "status": "lost" if k == "1" else "found", "description": "Red leather bag" if k != "3" else None, "labelled": True} for k, f in names.items()]
    (tmp_path / "meta.json").write_text(json.dumps(items, indent=2))
    job = FeatureExtraction(f"file://{tmp_path}/meta.json", f"file://{tmp_path}/images", f"file://{tmp_path}/out", include_sift=True)
    report = job.run(spark)
    assert any("items: 3" in line for line in report)
    rows = {r["id"]: r for r in job.features(spark).collect()}
    assert len(rows["1"]["image"]) == 312 and sum(rows["1"]["image_feature_dims"].values()) == 312 and len(rows["1"]["text"]) == 126 and rows["1"]["error"] is None
    assert rows["3"]["image"] is None and rows["3"]["text"] == [0.0] * 126
    errors = {r["id"]: r["error"] for r in spark.read.json(f"file://{tmp_path}/out/errors").collect()}
    assert errors == {"2": "the file can't be decoded as an image", "3": "there is no image file"}
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out/summary").count() == 3
    # A second run leaves what is done, and tries the others again.
    (folder / "missing.png").write_bytes(png(rgb))
    job.run(spark)
    second = spark.read.parquet(f"file://{tmp_path}/out/features/attempt=000001")
    assert sorted(r["id"] for r in second.collect()) == ["2", "3"]
    rows = {r["id"]: r for r in job.features(spark).collect()}
    assert len(rows) == 3 and rows["3"]["image"] == rows["1"]["image"] and rows["2"]["error"]


def test_one_bad_image_costs_its_row(spark):
    schema = "height int, width int, nChannels int, data binary"
    good = bytes(range(48))
    df = spark.createDataFrame([((4, 4, 3, good),), ((4, 4, 3, good[:40]),), ((-1, -1, -1, b""),), (None,)], f"image struct<{schema}>")
    got = [r[0] for r in df.select(I.image_result("image")).collect()]
    assert len(got[0]["vector"]) == 184 and got[0]["error"] is None
    assert "ValueError" in got[1]["error"] and "decoded" in got[2]["error"] and "no image file" in got[3]["error"] and all(g["vector"] is None for g in got[1:])


# --- frequencies, uploads ----------------------------------------------------------------------------------------


def test_frequencies_by_batch(spark, tmp_path):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(40)]
    rows = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(6))) for i in range(90)], "id long, description string")
    model = TfIdf(max_features=20)
    table = FrequencyTable(spark, f"file://{tmp_path}/terms", model)
    for k in range(3):
        table.add(rows.where(f"id % 3 = {k}"), f"b{k}")
    table.add(rows.where("id % 3 = 1"), "b1")  # again
    grown, whole = rows_of(table.fit().vocabulary), rows_of(TfIdf(max_features=20).fit(rows).vocabulary)
    assert grown == whole and len(whole) == 20


def test_upload_stream_restarts(spark, tmp_path):
    rng = np.random.RandomState(5)
    schema = "id long, category int, image array<double>"
    stored = spark.createDataFrame([(i, i % 2, rng.randn(4).tolist()) for i in range(40)], schema)
    stored.write.parquet(f"file://{tmp_path}/stored")
    lost = [(100 + i, i % 2, rng.randn(4).tolist()) for i in range(9)]
    start = lambda: uploads.match_stream(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/stored", f"file://{tmp_path}/out", f"file://{tmp_path}/cp", Matcher(top_k=3, min_similarity=-1.0)).awaitTermination()
    put = lambda rows, name: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    put(lost[:4], "a")
    start()
    put(lost[4:], "b")
    # The first batch's results are there but its commit is lost: it runs again and replaces them.
    shutil.rmtree(tmp_path / "cp" / "commits")
    start()
    start()
    want = Matcher(top_k=3, min_similarity=-1.0).match(spark.createDataFrame(lost, schema), stored)
    key = lambda df: sorted((r["lost_id"], r["rank"], r["found_id"], round(r["similarity"], 9)) for r in df.collect())
    assert key(uploads.matches(spark, f"file://{tmp_path}/out")) == key(want)


def test_tables_are_deleted(spark):
    table = materialize(spark.range(5), "five")
    files = table.inputFiles()
    assert table.count() == 5 and files
    drop(table)
    with pytest.raises(Exception):
        spark.read.parquet(*files).count()


def test_best_k_scores_in_strips(spark, monkeypatch):
    from matchloom.operators import blocks

    rng = np.random.RandomState(6)
    df = spark.createDataFrame([(i, rng.randn(3).tolist()) for i in range(60)], "id long, image array<double>")
    score = lambda a, b: {"similarity": similarities(a["image"], b["image"])}
    run = lambda block: sorted((r["lost_id"], r["rank"], r["found_id"]) for r in best_k(df.where("id < 30"), df.where("id >= 30"), score, 4, None, block=block).collect())
    want = run(4096)
    monkeypatch.setattr(blocks, "STRIP", 7)
    assert run(4096) == want and run(11) == want


# --- models side by side -----------------------------------------------------------------------------------------


def test_three_models_in_one_table(spark, sf):
    """The first two rows are those that have SQL; the third follows from the classifier's own matches."""
    from matchloom.operators.pairs import training_pairs
    from matchloom.plans import catalog
    from matchloom.sources.items import items

    three = {r["model"]: r for r in catalog.QUERIES["ev16_three_models"](spark, sf).collect()}
    assert {r["model"]: r for r in catalog.QUERIES["ev16_comparison"](spark, sf).collect()} == {k: three[k] for k in ("similarity", "knn")}
    it, right = items(spark, sf), {r["lost_id"]: r["found_id"] for r in catalog.truth(spark, sf).collect()}
    svm = PairClassifier().fit(training_pairs(it)).predict(it).collect()
    place = {r["lost_id"]: r["rank"] for r in svm if right.get(r["lost_id"]) == r["found_id"]}
    at = [place.get(k) for k in right]
    row, scores = three["svm"], np.array([r["similarity"] for r in svm])
    assert row["total_items"] == len(at) and row["mrr"] == pytest.approx(np.mean([1 / p if p else 0 for p in at]), abs=1e-3)
    for k in (1, 3, 5):
        assert row[f"recall_at_{k}"] == pytest.approx(np.mean([bool(p and p <= k) for p in at]), abs=1e-3)
    assert row["mean_similarity"] == pytest.approx(scores.mean(), abs=1e-3) and row["median_similarity"] == pytest.approx(np.median(scores), abs=1e-3) and scores.min() >= 0 and scores.max() <= 1
    # The models' best three for the first three lost items are those of all matches.
    first = catalog.QUERIES["ml9_first_items"](spark, sf).collect()
    few = sorted({r["lost_id"] for r in first})
    assert len(few) == 3
    for name in few:
        want = [r["found_id"] for r in sorted((r for r in svm if r["lost_id"] == name), key=lambda r: r["rank"])[:3]]
        assert [r["found_id"] for r in sorted((r for r in first if r["lost_id"] == name and r["model"] == "svm"), key=lambda r: r["rank"])] == want
