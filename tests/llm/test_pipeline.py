import random

import pytest
from pyspark.sql import functions as F

from test_operators import brute_components, brute_dedup, prose

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, out = random.Random(21), str(tmp_path_factory.mktemp("sf"))
    item = prose(rng, 30)
    docs, labels = [], []
    for i in range(300):
        w = prose(rng, rng.randint(40, 70)).split(" ")
        bad = i % 6 == 0
        if bad:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(("idiot", "clown")))
        docs.append((i, " ".join(w), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(bad)))
    clean = [d for d in docs if d[0] % 6]
    near = clean[0][1].split(" ")
    near[5] = "changed"
    docs += [(1000, clean[1][1], "en", "s", 0), (1001, " ".join(near), "en", "s", 0), (1002, clean[2][1] + " " + item, "en", "s", 0), (1003, None, "en", "s", 0), (1004, "", "en", "s", 0), (None, prose(rng, 50), "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", F.char_length("text").cast("long")).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages_against_brute_force(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(corpus_pipeline.materialize(stage(spark, steps[-1], folder), name))
    for s in steps[:-1]:
        assert s.columns == docs.columns
    rows = [{r.doc_id: r.text for r in s.select("doc_id", "text").collect()} for s in steps]
    assert {i for i in range(300) if i % 6 == 0} & set(rows[1]) == set()
    assert len(rows[1]) >= len(rows[0]) - 52
    kept = brute_dedup(list(rows[1].items()))
    want = {d: kept[(d, t)] if t else t for d, t in rows[1].items()}
    assert rows[2] == {d: t for d, t in want.items() if t or not rows[1][d]}
    assert 1000 not in rows[2]
    comp = brute_components(list(rows[2].items()))
    assert set(rows[3]) == {d for d in rows[2] if d is None or comp[d] == d}
    assert set(rows[3]) - set(rows[4]) == ({1002} & set(rows[3]))
    assert {1003, 1004, None} <= set(rows[4]) and rows[5] == rows[4]
    assert steps[5].where("not round_trip").count() == 0
    assert all(r.n_chars == len(r.text or "") for r in steps[2].where("text is not null").collect())


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "ids", "n_tokens", "round_trip"} <= set(out.columns) and out.count() > 200
    empty = folder + "-empty"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.mode("overwrite").parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
