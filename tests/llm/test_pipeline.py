"""The pipeline, stage by stage, on planted cases."""

import corpus_pipeline
from viewloom.llm.common import stored


def test_stages(spark, maker, tmp_path):
    leak = maker.text(40)
    passage = maker.text(60)
    base = maker.text(250, line=250)
    rows = [(i, maker.text(150, line=10_000)) for i in range(40)]
    rows += [(50, base), (51, base + " more"), (52, maker.text(50) + "\n" + leak), (53, passage), (54, maker.text(40) + "\n" + passage + "\n" + maker.text(30)), (55, rows[5][1]), (56, ""), (57, None)]
    toxic = [(100 + i, f"{maker.text(30)} idiot {maker.text(10)} scum") for i in range(40)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows + toxic], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(i, 0, 1) for i, _ in toxic], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found, at = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        at = stored(stage(spark, at, str(tmp_path)), name)
        found[name] = {r.doc_id: r for r in at.collect()}
        if name != "piece_encoding":
            assert at.columns == docs.columns
    assert not {i for i, _ in toxic} & found["toxicity"].keys() and found["toxicity"].keys() == {i for i, _ in rows}
    lines = found["line_dedup"]
    assert 55 not in lines and lines[53].text == passage and passage.split("\n")[0] not in lines[54].text and lines[54].n_chars == len(lines[54].text)
    assert 56 in lines and 57 in lines
    near = found["simhash_near_dedup"]
    assert 50 in near and 51 not in near and set(range(40)) <= near.keys() and len({56, 57} & near.keys()) == 1
    assert near.keys() - found["decontamination"].keys() == {52}
    assert all(r.lossless for r in found["piece_encoding"].values()) and found["piece_encoding"].keys() == found["decontamination"].keys()
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, ((r.doc_id, tuple(r.ids or ())) for r in whole.collect()))) == sorted((r.doc_id, tuple(r.ids or ())) for r in found["piece_encoding"].values())
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
