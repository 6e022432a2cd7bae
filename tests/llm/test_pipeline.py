"""The pipeline's stages, each on all that the one before kept, against brute force on a small corpus."""

import itertools

from millrace.llm import tokens as K
from millrace.session import attach

import corpus_pipeline
from test_operators import SCHEMA, changed, gram_set, labelled, prose


def test_stages(spark, tmp_path):
    attach(spark)
    texts, y = labelled(150, 21)
    item = prose(9001, 40)
    w = item.split()
    good = [t for t, v in zip(texts, y) if v == 1]
    rows = list(enumerate(texts))
    rows += [(1000 + k, changed(good[k], k, 0.02)) for k in range(10)] + [(1100, good[0]), (1101, good[1])]
    rows += [(1200, prose(31, 60) + " " + " ".join(w[20:] + ["and"] + w[:20])), (1300, prose(32, 80) + ' api_key = "9f8Zk2Lq7Xw1Tn5B" ' + prose(33, 40))]
    rows += [(1400, None), (1401, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(v), 0) for k, v in enumerate(y)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    before = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = before.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / name)
        stage(spark, before, str(tmp_path)).write.parquet(out)
        after = spark.read.parquet(out)
        assert k == 4 or after.columns == columns
        kept[name] = after.collect()
        before = after

    ids = {n: {r.doc_id for r in kept[n]} for n in list(kept)[:4]}
    bad = {k for k, v in enumerate(y) if v == 0}
    assert len(ids["quality"] & bad) <= 2 and len({k for k, v in enumerate(y) if v == 1} - ids["quality"]) <= 2
    assert {1200, 1300} <= ids["quality"] and not {1400, 1401} & ids["quality"]

    sets = {r.doc_id: gram_set(r.text, 2) for r in kept["quality"]}
    group = {i: i for i in sets}
    changed_any = True
    while changed_any:
        changed_any = False
        for a, b in itertools.combinations(sorted(sets), 2):
            if group[a] != group[b] and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b]):
                low = min(group[a], group[b])
                group[a] = group[b] = low
                changed_any = True
    assert ids["near_duplicates"] == {i for i in sets if group[i] == i}

    assert ids["near_duplicates"] - ids["decontamination"] == {1200}
    assert ids["secrets"] == ids["decontamination"]
    masked = next(r for r in kept["secrets"] if r.doc_id == 1300)
    assert "9f8Zk2Lq7Xw1Tn5B" not in masked.text and masked.n_chars == len(masked.text)

    words = {r.doc_id: len(K.words_of(r.text)) for r in kept["secrets"]}
    packed = {}
    for r in kept["packing"]:
        for i, a, b in zip(r.doc_ids, r.starts, r.ends):
            packed[i] = packed.get(i, 0) + b - a
    assert packed == words
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["packing"])


def test_stages_on_awkward_tables(spark, tmp_path):
    attach(spark)
    names = ["_bad", "_gone", "_b0", "_parts", "_of", "a", "b", "rule", "seed"]
    schema = SCHEMA + "".join(f", {c} string" for c in names)
    texts, y = labelled(60, 5)
    spark.createDataFrame([(k, int(v), 0) for k, v in enumerate(y)] + [(1, 0, 0), (1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (None, "x"), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[1]), (None, None), (2, texts[2]), (2, texts[4]), (70, ""), (71, "word " * 40_000), (72, None)]
    docs = spark.createDataFrame([(i, t, None, None, None, *["own"] * len(names)) for i, t in rows], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.collect() is not None
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sum(r.doc_id is None for r in kept) == 2 and {70, 71, 72} <= {r.doc_id for r in kept}
    packed = corpus_pipeline.packing_windows(spark, docs, str(tmp_path)).collect()
    assert None not in {i for r in packed for i in r.doc_ids} and not {70, 72} & {i for r in packed for i in r.doc_ids}
