"""Values worked out by hand, round trips through files, and the matching's settings."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.functions import text as T
from matchloom.functions import vectors as V
from matchloom.operators import evaluate as E
from matchloom.operators import match as M
from matchloom.operators.blocks import best_k, similarities
from matchloom.operators.knn import KnnMatcher
from matchloom.operators.labels import PHRASES, ground_truth, phrases, score, sequence_ratio, with_phrases
from matchloom.operators.matching import Matcher, browse, find_matches, with_text_vectors
from matchloom.operators.pairs import PairClassifier, training_pairs
from matchloom.operators.profile import histogram
from matchloom.operators.tfidf import TfIdf
from matchloom.sources import items as S
from matchloom.sources import sinks

A, B = "Blue leather wallet with ID card", "Blue wallet made of leather"


def one(spark, **cols):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in cols.items()))


def test_text_values(spark):
    rows = spark.createDataFrame(
        [(0, "Blue leather wallet with university ID card inside"), (1, "Black Nike backpack, medium size, slightly worn"), (2, "Brown leather-bound textbook on calculus"), (3, "a b　c"), (4, None)], "id int, t string"
    )
    got = rows.select("id", T.clean(F.col("t")), T.statistics(F.col("t")), T.keyword_vector(F.col("t")), T.keyword_sets(F.col("t")).alias("k")).orderBy("id").collect()
    assert got[0][1] == "blue leather wallet with university id card inside" and got[2][1] == "brown leather-bound textbook on calculus"
    assert got[0][2] == pytest.approx([50, 8, 5.375, 2, 0, 3, 0, 1]) and got[1][2] == pytest.approx([47, 7, 5.857143, 2, 0, 2, 0, 1]) and got[2][2] == pytest.approx([40, 5, 7.2, 3, 0, 1, 0, 1])
    assert got[0][3] == [1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0]
    assert got[2]["k"]["colors"] == ["brown"] and got[2]["k"]["materials"] == []
    assert got[3][2][1] == 3 and got[4][2] == [0] * 8  # white space of any script


def test_profiles_phrases_ratios(spark):
    df = one(spark, a=A, b=B, n="banana", none="", p="featured standard headphones")
    got = df.select(
        T.ngram_profile(F.col("n")), T.ngram_profile(F.col("none")), T.keyword_similarity(T.keyword_sets(F.col("a")), T.keyword_sets(F.col("b"))), phrases(F.col("p"), "colors"), phrases(F.col("p"), "brands"),
        sequence_ratio(T.clean_words(F.col("a")), T.clean_words(F.col("b"))), sequence_ratio(T.clean_words(F.col("b")), T.clean_words(F.col("a"))),
    ).first()
    assert got[0] == pytest.approx([0.4, 0.4, 0.2] + [0] * 47) and got[1] == [0.0] * 50
    assert got[2] == pytest.approx(0.4) and set(got[3]) == {"red", "tan"} and got[4] == ["head"]
    assert got[5] == pytest.approx(0.406780, abs=1e-6) and got[6] == pytest.approx(0.508475, abs=1e-6)


def test_pair_scores_and_ground_truth(spark):
    items = spark.createDataFrame([(1, 0, "lost", A, True), (2, 0, "found", B, True), (3, 1, "found", A, True), (4, 0, "found", None, True), (5, 0, "lost", A, False)], "id int, category int, status string, description string, labelled boolean")
    for version, want in ((1, 0.485028), (2, 0.472034)):
        pairs = M.candidates(with_phrases(items, version)).where("lost_id = 1")
        got = {r["found_id"]: r["s"] for r in pairs.select("found_id", score(version).alias("s")).collect()}
        assert got == {2: pytest.approx(want, abs=1e-6), 4: 0.0}
    v1 = ground_truth(items).collect()
    assert [(r["lost_id"], r["found_id"], r["confidence"], r["quality"], r["lost_desc"]) for r in v1] == [(1, 2, 0.485, "medium", A)]
    v2 = ground_truth(items, 2, 0.4).collect()
    assert sorted((r["lost_id"], r["lost_desc"]) for r in v2) == [(1, A + "..."), (5, A + "...")]
    assert not ground_truth(items, 2).collect()  # 0.75 is its least score
    assert set(PHRASES) == {"colors", "brands", "materials", "features", "sizes"}


def test_ranking_values(spark):
    rows = [("L001", f"F00{i + 1}", v) for i, v in enumerate((0.85, 0.72, 0.45, 0.30, 0.65))] + [("L002", f"F00{i + 1}", v) for i, v in enumerate((0.62, 0.88, 0.55, 0.40, 0.70))]
    df = spark.createDataFrame(rows, "lost_id string, found_id string, similarity double")
    for k in (5, 0, None):
        got = M.top_k(df, k, minimum=0.3).orderBy("lost_id", "rank").collect()
        assert [r["found_id"][-1] for r in got] == list("12534" "25134")
    labels = one(spark, a=0.85, b=0.72, c=0.45, d=0.6, e=0.8).select(*(f(F.col(c)) for c in "abcde" for f in (T.confidence, T.confidence_short))).first()
    assert list(labels) == ["Very High", "High", "High", "High", "Medium", "Low", "High", "Medium", "Very High", "High"]


def test_vector_values(spark):
    z, a = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))
    x, y = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(-1.0), F.lit(0.0))
    got = spark.range(1).select(V.cosine(z, a), V.euclidean(z, a), V.normalized_euclidean(x, y), V.normalized_euclidean(x, x), *(V.combined(F.lit(i), F.lit(t), fallback=f) for i, t, f in ((0.0, 0.8, True), (0.0, 0.8, False), (-0.1, 0.5, True), (-0.1, 0.5, False)))).first()
    assert list(got) == pytest.approx([0, 1 / 6, 0, 1, 0.8, 0.32, 0.14, 0.14])
    with pytest.raises(ValueError):
        V.similarity("unknown", x, y)


def test_times(spark):
    iso = [("2024-01-02T00:00:00", "2024-01-02T00:00:00"), ("2024-01-01T00:00:00", "2024-01-02T00:00:00"), ("bad", "2024-01-02T00:00:00"), (None, "2024-01-02T00:00:00"), ("2024-01-01T00:00:00Z", "2024-01-02T00:00:00")]
    df = spark.createDataFrame(iso, "f string, l string")
    assert [r[0] for r in df.select(T.temporal_valid(F.col("f"), F.col("l"))).collect()] == [True, False, True, True, True]
    meta = spark.createDataFrame([("l", "lost", iso[0][1]), *((f"f{i}", "found", f) for i, (f, _) in enumerate(iso))], "id string, status string, timestamp string").withColumns({"category": F.lit("bags"), "labelled": F.lit(True)})
    items = S.from_metadata(meta).withColumn("image", F.array(F.lit(1.0), F.lit(2.0)))
    assert {r["found_id"] for r in M.candidates(items, temporal=True).collect()} == {"f0", "f2", "f3", "f4"}
    assert {r["found_id"] for r in Matcher("slow").run(items).collect()} == {"f0", "f2", "f3", "f4"}


def test_metric_values(spark):
    pos = spark.createDataFrame([(1, 1), (2, 3), (3, None), (4, 2)], "lost_id int, pos int")
    m = E.metrics(pos).first()
    assert (m["recall_at_1"], m["recall_at_3"], m["precision_at_5"]) == (0.25, 0.75, 1.0)
    assert [m["f1_at_3"], m["mrr"], m["ndcg_at_5"]] == pytest.approx([0.857143, 0.458333, 0.532732], abs=1e-6)
    assert list(E.confusion(pos).first()) == [0, 0, 1, 3]
    d = E.distribution(spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,), (None,)], "similarity double")).first()
    assert [d["mean"], d["median"], d["std"], d["q25"]] == pytest.approx([3.75, 3, 2.680951, 1.75], abs=1e-6)
    h = histogram(spark.createDataFrame([(0.0,), (1.0,), (10.0,)], "x double"), "x", 5).orderBy("bin").collect()
    assert [r["n"] for r in h] == [2, 0, 0, 0, 1] and (h[0]["low"], h[4]["high"]) == (0, 10)


def test_quantiles_and_auc_over_many_ranges(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=3000), 2)
    y = rng.random(3000) < 0.3
    df = spark.createDataFrame([(float(a), bool(b), i % 3) for i, (a, b) in enumerate(zip(x, y))], "score double, label boolean, g int")
    got = E.quantiles(df, "score", {"q1": 0.25, "q2": 0.5, "q3": 0.9}).first()
    assert list(got) == pytest.approx(list(np.quantile(x, [0.25, 0.5, 0.9])))
    per = {r["g"]: r["m"] for r in E.quantiles(df, "score", {"m": 0.5}, ["g"]).collect()}
    assert per == {g: pytest.approx(np.median(x[g::3])) for g in range(3)}
    wins = (x[y][:, None] > x[~y][None, :]).mean() + 0.5 * (x[y][:, None] == x[~y][None, :]).mean()
    assert E.roc_auc(df).first()["roc_auc"] == pytest.approx(wins)


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(3)
    words = "red blue black new old large bag wallet phone case leather".split()
    rows = [(i, int(rng.integers(0, 3)) if i % 11 else None, "lost" if i % 2 else "found", " ".join(rng.choice(words, 4)) if i % 7 else None, rng.normal(size=6).tolist() if i % 13 else None) for i in range(160)]
    return spark.createDataFrame(rows, "id long, category int, status string, description string, image array<double>").withColumn("labelled", F.col("description").isNotNull())


def test_blocks_give_what_pairs_give(spark, items):
    lost, found = (items.where(F.col("status") == s) for s in ("lost", "found"))
    score_ = lambda a, b: {"similarity": similarities(a["image"], b["image"])}
    pairs = M.candidates(items.withColumn("ts", F.lit(None).cast("timestamp")))
    want = M.rank(pairs.select("lost_id", "found_id", V.cosine(F.col("lost_image"), F.col("found_image")).alias("similarity")), 4)
    key = lambda df: {(r["lost_id"], r["rank"]): (r["found_id"], round(r["similarity"], 9)) for r in df.collect()}
    for block in (4096, 7):
        assert key(best_k(lost, found, score_, 4, block=block)) == key(want)
    assert not best_k(lost.limit(0), found, score_, 4).count()


def test_matcher(spark, items):
    it = with_text_vectors(items, TfIdf().fit(items.where("description IS NOT NULL").select("id", "description")))
    assert {r["n"] for r in it.select(F.size("text").alias("n")).collect()} == {126}
    m = Matcher(top_k=3, min_similarity=0.2)
    every = m.run(it).cache()
    assert every.where("rank > 3 OR similarity < 0.2").count() == 0 and every.count()
    assert every.where("abs(similarity - 0.6 * image_similarity - 0.4 * text_similarity) > 1e-9").count() == 0
    item = it.where("id = 5")
    key = lambda df: {(r["lost_id"], r["found_id"], round(r["similarity"], 9)) for r in df.collect()}
    assert key(m.match_one(item, it)) == key(every.where("lost_id = 5"))
    assert key(find_matches(item, it, matcher=m)) == key(every.where("lost_id = 5"))
    knn = KnnMatcher(4, prefilter=True)
    knn.col = "text"
    assert 0 < find_matches(it.where("id = 5"), it, model="knn", fitted=knn).count() <= 4
    back = find_matches(it.where("id = 8"), it, "found", "knn", fitted=knn).collect()
    assert back and all(r["found_id"] == 8 and r["lost_id"] % 2 for r in back)
    assert browse(it, every, category=1, minimum=0.3).where("similarity < 0.3").count() == 0
    for bad in (lambda: Matcher("other"), lambda: Matcher(image_method="normalized_euclidean"), lambda: find_matches(item, it, model="other"), lambda: find_matches(item, it, model="svm")):
        with pytest.raises(ValueError):
            bad()


def test_models_persist(spark, items, tmp_path):
    full = items.where("image IS NOT NULL AND category IS NOT NULL")
    pairs = training_pairs(full, 0.3)
    rows = pairs.select("lost_id", "found_id", "label").collect()
    category = {r["id"]: r["category"] for r in full.collect()}
    pos = [r for r in rows if r["label"] == 1]
    assert len(rows) - len(pos) == int(len(pos) / 0.3) - len(pos) and len({(r["lost_id"], r["found_id"]) for r in pos}) == len(pos)
    assert all((category[r["lost_id"]] == category[r["found_id"]]) == (r["label"] == 1) for r in rows)
    for kernel in ("rbf", "linear", "poly"):
        made = PairClassifier(kernel, features=16).fit(pairs)
        made.save(f"file://{tmp_path}/{kernel}")
        again = PairClassifier.load(spark, f"file://{tmp_path}/{kernel}")
        key = lambda c: [(r["lost_id"], r["found_id"], round(r["similarity"], 9)) for r in c.predict(full, 2).orderBy("lost_id", "rank").collect()]
        assert key(made) == key(again) and key(made)
    with pytest.raises(ValueError):
        PairClassifier().fit(pairs.limit(0))
    knn = KnnMatcher(3, "manhattan").fit(full.where("status = 'found'"))
    knn.save(f"file://{tmp_path}/knn")
    lost = full.where("status = 'lost'")
    assert sorted(map(tuple, KnnMatcher.load(spark, f"file://{tmp_path}/knn").predict(lost).collect())) == sorted(map(tuple, knn.predict(lost).collect()))
    fitted = TfIdf(max_features=5).fit(items.where("description IS NOT NULL").select("id", "description"))
    fitted.save(f"file://{tmp_path}/tfidf")
    again = TfIdf.load(spark, f"file://{tmp_path}/tfidf")
    key = lambda t: {r["id"]: [round(x, 9) for x in r["tfidf"]] for r in t.transform(items).collect()}
    assert key(fitted) == key(again)


def test_files_round_trip(spark, items, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    matches = M.image_matches(items, 3)
    sinks.save_matches(matches, at("matches"))
    want = sorted((str(r["lost_id"]), r["rank"], str(r["found_id"])) for r in matches.collect())
    part = next((tmp_path / "matches").glob("part-*"))
    assert len(json.loads(part.read_text())) == matches.select("lost_id").distinct().count()  # one JSON object
    for lines in (False, True):
        back = S.read_matches(spark, f"file://{part}", lines)
        assert sorted((r["lost_id"], r["rank"], r["found_id"]) for r in back.collect()) == want
    truth = spark.createDataFrame([("a", 'f"1'), ("b", "f2"), ("c", "f2")], "lost_id string, found_id string")
    sinks.save_ground_truth(truth.withColumn("confidence", F.lit(0.5)), at("truth"))
    part = next((tmp_path / "truth" / "map").glob("part-*"))
    for lines in (False, True):
        assert sorted(map(tuple, S.read_ground_truth(spark, f"file://{part}", lines).collect())) == sorted(map(tuple, truth.collect()))
    (tmp_path / "meta.json").write_text(json.dumps([{"id": "x", "filename": "x.png", "category": "computer_mouse", "timestamp": "2024-01-15T10:00:00", "status": "lost", "description": "Red", "labelled": True}]))
    meta = S.from_metadata(S.read_metadata(spark, at("meta.json"))).withColumn("category", S.normalize_category(F.col("category"))).first()
    assert (meta["category"], meta["zoned"], str(meta["ts"])) == ("computer-mouse", False, "2024-01-15 10:00:00")
    sinks.save_results(matches, Matcher().settings(), at("results"))
    assert json.loads(spark.read.text(at("results/settings")).first()[0])["top_k"] == 5
    row = E.comparison("similarity", matches, matches.where("rank = 2").select("lost_id", "found_id"))
    sinks.save_metrics(row, at("metrics"))
    assert spark.read.option("header", True).csv(at("metrics/comparison")).columns == list(E.COMPARISON)
    sinks.save_features(items, at("features"))
    assert spark.read.parquet(at("features")).count() == items.count()
    errors = sinks.dead_letters(items.withColumn("error", F.when(F.col("id") == 13, "broken file"))).collect()
    assert {r["error"] for r in errors} == {"broken file", "no image features"}
    new = S.new_item(spark, "Red bag", "1", image=items.where("id = 1").select("image")).first()
    assert new["id"].startswith("NEW_") and len(new["image"]) == 6


def test_reports(spark, items):
    text = "\n".join(sinks.extraction_report(items.withColumn("text", F.array(F.lit(1.0)))))
    assert "items: 160" in text and "width of image vectors: 6" in text
    matches = M.image_matches(items, 3)
    report = sinks.run_report(items.where("status = 'lost'"), matches, Matcher().settings())
    assert any(x.startswith("lost items: 80") for x in report) and sum(x.startswith("   ") for x in report) == 15
    assert sinks.ranking_report(matches, 1)[0] == "matches of 1: 3"
