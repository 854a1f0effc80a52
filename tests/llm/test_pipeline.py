"""The pipeline's stages on a small corpus with planted cases."""

import random

from pyspark.sql import functions as F

from ontolith.llm import queries


def test_pipeline_on_planted_cases(spark, tmp_path):
    import corpus_pipeline

    draw = random.Random(1)
    words = [f"w{i}" for i in range(600)]
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    rows = [(i, prose(80) + (" vileword nastyword" if i % 10 == 0 else ""), "en", f"s{i % 3}", 1) for i in range(300)]
    item = " ".join(f"b{i}" for i in range(30))
    near = rows[1][1].split()
    near[40] = "changed"
    rows += [(400, f"{prose(20)} {item} {prose(20)}", "en", "s0", 1), (401, " ".join(near), "en", "s0", 1), (402, rows[2][1], "en", "s1", 1)]
    lines = [prose(9) for _ in range(6)]
    rows += [(500, "\n".join(lines), "en", "s1", 1), (501, "\n".join([prose(30), *lines, prose(30)]), "en", "s1", 1), (502, None, None, None, None)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, columns = spark.read.parquet(f"{d}/documents.parquet"), None
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        columns = columns or docs.columns
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "line_dedup":
            text = {r.doc_id: r.text for r in docs.collect()}
            assert len(text[501].split("\n")) == 2
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    bad = set(range(0, 300, 10))
    assert len(kept["toxicity"] & bad) <= 2 and len(set(range(300)) - bad - kept["toxicity"]) <= 3
    assert {401, 402} & kept["minhash"] == set() and {1, 2} <= kept["minhash"]
    assert 400 in kept["minhash"] and 400 not in kept["decontamination"]
    assert kept["mixing"] == kept["decontamination"] == kept["minhash"] - {400}
    assert {r.doc_id for r in corpus_pipeline.run(spark, d).collect()} == kept["mixing"]


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    d = str(tmp_path)
    rows = [(1, "b " * 30, "en", "s", 1), (1, "a " * 30, "en", "s", 1), (1, "a " * 30, "en", "s", 1), (None, "c " * 30, None, None, None), (None, None, None, None, None), (2, None, "en", "s", 1), (3, "", "en", "s", 1), (4, "word " * 30_000, "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data, columns in (("documents", rows, schema), ("labels", [], "doc_id long, quality int, toxic int"), ("benchmark", [], "item_id long, text string")):
        spark.createDataFrame(data, columns).withColumns({"size": F.lit(1), "score": F.lit("x"), "kept": F.lit(True), "predicted": F.lit(9)}).write.parquet(f"{d}/{name}.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    near = corpus_pipeline.drop_near_duplicates(spark, docs, d)
    assert sorted((r.doc_id, (r.text or "")[:3]) for r in near.where("doc_id IS NOT NULL").collect()) == [(1, "a a"), (2, ""), (3, ""), (4, "wor")]
    assert near.count() == 6
    got = corpus_pipeline.run(spark, d).collect()
    assert sorted((g.doc_id or 0, g.size) for g in got) == [(0, 0), (0, 30), (1, 30), (2, 0), (3, 0), (4, 30_000)]
    spark.read.parquet(f"{d}/documents.parquet").limit(0).write.parquet(f"{d}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{d}/{name}.parquet").write.parquet(f"{d}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{d}/none").count() == 0


def test_every_query_is_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]
