"""The pipeline against a plain version of each stage, and the registered SQL."""

import duckdb

from macrolith.llm import bpe, decontaminate, langid, simhash, toxicity
from macrolith.llm.queries import op1_decontamination, oracle_sql, tokenizer_path

SF = "/root/testdata/sf0.001"


def test_pipeline_against_plain_version(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    m = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r in docs.collect() if 1 - m.probabilities(toxicity.features(r.text))[0] <= 0.5]
    model = langid.train(spark.createDataFrame(rows, docs.schema))
    rows = [r for r in rows if model.predict(r.text)[1] >= langid.MARGIN]
    fps = [simhash.fingerprint(r.text) for r in rows]
    kept, group = [], {}
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    for k, r in enumerate(rows):
        group.setdefault(find(k), []).append(r)
    kept = [min(g, key=lambda r: r.doc_id) for g in group.values()]
    items = [(str(r.item_id), decontaminate.words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[k : k + 13]) for _, w in items if w for k in range(max(1, len(w) - 12))}
    e = bpe.Encoder(tokenizer_path())
    want = []
    for r in kept:
        w = decontaminate.words_of(r.text)
        hit = {p for n in {len(g) for g in grams} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in grams for p in range(k, k + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            want.append((r.doc_id, len(e.encode(r.text))))
    assert [g[:2] for g in got] == sorted(want) and len(got) < docs.count()


def test_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_registered_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = sorted(map(tuple, c.execute(oracle_sql()["op1_decontamination"]).fetchall()))
    assert sorted(map(tuple, op1_decontamination(spark, SF).collect())) == want


def test_items_without_an_id_count(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x a b c d y"), (2, "e f g h a b c d"), (3, "one two")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "a b c d"), (None, "f g"), (7, "e f"), (None, None)], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(map(tuple, c.execute(oracle_sql()["op1_decontamination"]).fetchall()))
    got = sorted(map(tuple, op1_decontamination(spark, str(tmp_path)).collect()))
    assert got == want and [r[3] for r in got] == [1, 2, 0]
    cut = decontaminate.contamination(docs, items, block_words=4).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(map(tuple, cut.collect())) == want
    assert [r.doc_id for r in decontaminate.decontaminate(docs, items).collect()] == [3]
