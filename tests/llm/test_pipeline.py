"""The pipeline's stages against plain versions, each on its own input."""

from brute import contamination, jaccard, sha, statistics, suffix_dedup

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    tables = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], FOLDER).write.parquet(str(tmp_path / str(k)))
        tables.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert tables[-1].columns == docs.columns
    held = [{r["doc_id"]: r["text"] for r in t.collect()} for t in tables]

    for d, text in held[0].items():
        n, *_, repeated = statistics(text)
        if n < 50 or 100 * repeated > 50 * n:
            assert d not in held[1]
    assert all(held[0][d] == t for d, t in held[1].items()) and held[1]
    assert held[2] == {d: held[1][d] for d, _, c in jaccard([*held[1].items()], 5, 80) if d == c}
    assert held[3] == {d: kept.decode("utf-8", "ignore") for d, *_, kept in suffix_dedup([*held[2].items()])}
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {d for d, _, hit, _ in contamination([*held[3].items()], items) if not hit}
    assert {d: t for d, t in held[4].items() if d in clean} == {d: t for d, t in held[3].items() if d in clean}
    assert all(not hit for _, _, hit, _ in contamination([*held[4].items()], [(i, t) for i, t in items if len(t.split()) >= 10]))
    last = tables[5].collect()
    assert {r["doc_id"]: r["decoded_sha256"] for r in last} == {d: sha(t) for d, t in held[4].items()}
    assert corpus_pipeline.run(spark, FOLDER).count() == len(last)


def test_near_duplicates_by_row(spark):
    words = [f"w{i}" for i in range(60)]
    one, other, third = " ".join(words), " ".join(reversed(words)), " ".join(words[::2] + words[1::2])
    rows = [(1, one), (2, one + " x"), (2, other), (2, other), (None, one + " y"), (None, third), (None, third + " z"), (None, ""), (None, ""), (3, None), (3, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()]
    assert sum(d is None and t in (third, third + " z") for d, t in got) == 1
    rest = [(d, t) for d, t in got if t not in (third, third + " z")]
    assert sorted(rest, key=repr) == sorted([(1, one), (2, other), (None, ""), (None, ""), (3, None), (3, "")], key=repr)
