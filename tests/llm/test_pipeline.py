import random

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_each_decision_takes_effect(spark, tmp_path):
    base = [f"word{i}" for i in range(60)]
    near = base[:57] + ["other"] * 1 + base[58:]
    item = [f"bench{i}" for i in range(14)]
    clean = [f"clean{i}" for i in range(40)]
    texts = {
        1: " ".join(base), 2: " ".join(base), 3: " ".join(near), 4: " ".join(clean[:20] + item[:11] + clean[20:]),
        5: " ".join(clean), 6: "short", 7: None, 8: " ".join(f"lone{i}" for i in range(30)) + " vexoid",
    }
    r = random.Random(1)
    vocabulary = sorted({w for t in texts.values() for w in (t or "").split()} - {"vexoid"})
    tame = [(1000 + i, " ".join(r.choices(vocabulary, k=25))) for i in range(300)]
    toxic = [(2000 + i, " ".join(r.sample(["vexoid", *r.choices(vocabulary, k=25)], 26))) for i in range(200)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in [*texts.items(), *toxic, *tame]]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 2000)) for i, _ in toxic + tame], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {r.doc_id for r in docs.collect()}
    named = {k: v & set(range(1, 9)) for k, v in seen.items()}
    assert named["toxicity"] == {1, 2, 3, 4, 5, 6, 7}
    assert len(seen["toxicity"] & {i for i, _ in tame}) >= 295 and len(seen["toxicity"] & {i for i, _ in toxic}) <= 3
    assert named["exact_dedup"] == {2, 3, 4, 5, 6, 7}
    assert named["ngram_jaccard_join"] == {2, 4, 5, 6, 7}
    assert named["benchmark_decontamination"] == {2, 5, 6, 7} == named["best_fit_packing"]
    assert {r.doc_id for r in P.run(spark, str(tmp_path)).collect()} == seen["best_fit_packing"]


def test_stages_on_nulls_repeats_clashes_and_nothing(spark, tmp_path):
    kinds = "doc_id long, text string, d0 string, score double, component_id long, gone int, sha string, id long, row long"
    long = " ".join(f"t{i % 700}" for i in range(9000))
    rows = [(1, "a b c d e f g", "x", 0.5, 1, 1, "s", 1, 1), (1, "a b c d e f g", "x", 0.5, 1, 1, "s", 1, 1), (1, "other words of one", None, None, None, None, None, None, None),
            (None, "a b c d e f g", "y", None, 2, 2, "t", 2, 2), (None, None, None, None, None, None, None, None, None), (3, None, "z", 1.0, 3, 3, "u", 3, 3),
            (4, "", "", 0.0, 4, 4, "", 4, 4), (5, long, "w", 0.1, 5, 5, "v", 5, 5)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("q", "nothing like it at all here")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    full, empty = spark.createDataFrame(rows, kinds), spark.createDataFrame([], kinds)
    for name, stage in P.STAGES:
        out = stage(spark, full, str(tmp_path))
        assert stage(spark, empty, str(tmp_path)).count() == 0
        ids = [r.doc_id for r in out.collect()]
        assert {1, 4, 5} <= set(ids), name  # a null text is an empty one, so 3 goes with 4
        if name != "best_fit_packing":
            assert out.columns == full.columns
            full = spark.createDataFrame(out.collect(), kinds)
    assert ids.count(1) == 2 and ids.count(5) > 8  # two texts of document 1; a long text in pieces
