"""Toxicity, SentencePiece, quality rules, URL filter, decontamination, sharding, quotation linking."""

import math
import random
import zlib

import pytest
from brute import contamination, corpus, frame, prose, statistics
from pyspark.sql import functions as F

import corpus_pipeline
from cairnlake.llm import decontaminate, quality_rules, quote_linking, sentencepieces, sharding, toxicity, url_filter
from cairnlake.llm import registry

FOLDER = "/root/testdata/sf0.01"


def key(r):
    return repr(r)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, name):
    from duck import connect, same

    same(registry.QUERIES[name](spark, FOLDER), connect(FOLDER), registry.ORACLES[name])


def test_sentencepiece(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path(sentencepieces.MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = corpus() + [(900, "▁ a▁b"), (901, "  lead"), (902, "trail  "), (903, "nul\x00 x"), (904, "<s> </s>"), (905, "日本 語 ﬁ"), (906, " ")]
    got = sentencepieces.encode_decode(frame(spark, rows), path).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = sp.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert bytes(r["piece_ids"]) == b"".join(i.to_bytes(4, "little") for i in ids) and r["decoded"] == sp.decode(ids)


def test_statistics(spark):
    rows = corpus() + [(910, "#a |b> $"), (911, "l\nl\n l\n\nl"), (912, "a b c a b c a b")]
    got = quality_rules.statistics(frame(spark, rows)).collect()
    assert sorted([(r["doc_id"], *(r[c] for c in quality_rules.BASE)) for r in got], key=key) == sorted([(d, *statistics(t)) for d, t in rows], key=key)


def test_rules_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    learned = quality_rules.learn(quality_rules.sample(docs, labels.where(~held)))
    judged = quality_rules.judge(quality_rules.statistics(docs.join(labels.where(held), "doc_id")), learned)
    good = judged.where("quality = 1 and not base_failed").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    bad = judged.where("quality = 0").agg(F.avg((~F.col("kept")).cast("int"))).first()[0]
    assert good > 0.98 and bad > 0.95


def test_rules_without_labels(spark):
    docs = frame(spark, corpus())
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality_rules.quality(docs, none).where("kept = base_failed").count() == 0


def test_toxicity_on_held_out_rows(spark):
    found = toxicity.op1_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    toxic = [r for r in found if r["toxic"] == 1]
    assert sum(r["predicted"] for r in toxic) >= 0.7 * len(toxic)
    assert sum(r["predicted"] for r in found if r["toxic"] == 0) < 0.02 * len(found)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)


def test_toxicity_gaps(spark):
    rng = random.Random(1)
    bad = ["blurgo", "snarfel", "wretchik"]
    texts = [prose(rng, 40) + "." for _ in range(200)]
    toxic = [i % 2 for i in range(200)]
    texts = [t.replace("relo", rng.choice(bad)) + f" {rng.choice(bad)}" if y else t for t, y in zip(texts, toxic, strict=True)]
    machine = toxicity.train(texts, toxic)
    rows = [(8, "the blur\u200bgo of"), (9, "the sn\u2022ar\u2013fel of"), (1, "the blur.go of"), (2, "the s n a r f e l of"), (3, "the wretxchik and"), (4, "the of and"), (5, None), (6, ""), (7, "q" * 5000 + "blurgo" + "q" * 5000)]
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(frame(spark, rows), machine).collect()}
    assert min(scores[k] for k in (1, 2, 3, 8, 9)) > max(scores[k] for k in (4, 5, 6))
    assert all(0 <= s <= 1 for s in scores.values())
    assert toxicity.train(["a"], [0]).words([b"a"]).tolist() == [-1.0]


def test_url_rules(spark):
    cases = {None: ("", "", None), "x": ("", "", None), "HTTP://A.COM/en/": ("a.com", "/en/", "com/en/"), "a://b.example.com/en/7?x": ("b.example.com", "/en/7", "example.com/en/7"), "://org/es/#": ("org", "/es/", "org/es/"), "q://com?/en/": ("com", "", None), "q://xcom/en/": ("xcom", "/en/", None), "q://É.example.net/de/8": ("É.example.net", "/de/8", "example.net/de/8"), "z://a?b://c": ("a", "", None), "": ("", "", None)}
    model = url_filter.train(spark.createDataFrame([*url_filter.LABELLED], "url string, block int"))
    df = spark.createDataFrame([*enumerate(cases)], "page_id int, url string").withColumn("rule", F.lit("own")).withColumn("host", F.lit(1))
    for r in url_filter.judge(df, model).collect():
        assert (r["host"], r["path"], r["rule"]) == cases[r["url"]]
        assert r["verdict"] == ({"com/en/": "block", "example.com/en/7": "allow", "org/es/": "block", "example.net/de/8": "block"}.get(r["rule"]) or ("block" if r["score"] >= 0.5 else "allow"))


def test_url_regression_on_held_out_rows(spark):
    """Each fifth of the labelled URLs, judged by what the rest teaches."""
    right = 0
    for fold in range(5):
        rest = [r for i, r in enumerate(url_filter.LABELLED) if i % 5 != fold]
        held = [(i, *r) for i, r in enumerate(url_filter.LABELLED) if i % 5 == fold]
        model = url_filter.train(spark.createDataFrame(rest, "url string, block int"))
        judged = url_filter.judge(spark.createDataFrame(held, "page_id int, url string, block int"), model).collect()
        right += sum((r["score"] >= 0.5) == bool(r["block"]) for r in judged)
    assert right >= 0.6 * len(url_filter.LABELLED)


def test_url_regression(spark):
    model = url_filter.train(spark.createDataFrame([*url_filter.LABELLED], "url string, block int"))
    right = [r["score"] >= 0.5 for r in url_filter.judge(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(url_filter.LABELLED)], "page_id int, url string"), model).orderBy("page_id").collect()]
    assert sum(a == bool(b) for a, (_, b) in zip(right, url_filter.LABELLED, strict=True)) >= 0.95 * len(right)
    assert url_filter.judge(spark.createDataFrame([], "page_id int, url string"), model).count() == 0


def test_decontamination(spark, monkeypatch):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.choice([1, 5, 10, 14, 30]))) for i in range(12)] + [(50, None), (51, "..."), (52, "Mino")]
    rows = corpus() + [(200 + i, f"{prose(rng, 4)}, {t.upper() if t and i % 2 else t}! {prose(rng, 3)}") for i, (_, t) in enumerate(items)]
    want = sorted(contamination(rows, items), key=key)
    table = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (decontaminate.BLOCK_BYTES, 300):  # one pass and several
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        got = decontaminate.found(frame(spark, rows), table).collect()
        assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got], key=key) == want
    for r in decontaminate.found(frame(spark, rows), table, cleaned=True).where("n_hit = 0").collect():
        assert (r["doc_id"], r["text"]) in rows
    assert decontaminate.found(frame(spark, rows), table.where("item_id < 0")).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 20])  # one pass and several
def test_repeated_item_ids(spark, monkeypatch, tmp_path, block):
    from duck import connect, same

    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    spark.createDataFrame([(1, "red green blue and one two three"), (2, "six")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, "red green blue"), (7, "one two three"), (8, "six"), (8, "six")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    tables = connect(str(tmp_path))
    for name in ("documents", "benchmark"):
        tables.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = decontaminate.op6_decontamination(spark, str(tmp_path))
    assert [r["n_items"] for r in got.orderBy("doc_id").collect()] == [1, 1]
    same(got, tables, decontaminate.ORACLE)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 20])  # one pass and several
def test_null_item_ids(spark, monkeypatch, tmp_path, block):
    from duck import connect, same

    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    spark.createDataFrame([(1, "red green blue and one two three"), (2, "a six b"), (3, "none")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, "red green blue"), (7, "one two three"), (None, "six"), (None, "one two three"), (None, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    tables = connect(str(tmp_path))
    for name in ("documents", "benchmark"):
        tables.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = decontaminate.op6_decontamination(spark, str(tmp_path))
    assert [r["n_hit"] for r in got.orderBy("doc_id").collect()] == [6, 1, 0]
    same(got, tables, decontaminate.ORACLE)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    cleaned = corpus_pipeline.benchmark_passages(spark, docs.selectExpr("*", "'' AS lang", "'' AS source"), str(tmp_path))
    assert [r["text"] for r in cleaned.orderBy("doc_id").collect()] == [" and ", "a  b", "none"]


def test_sharding_fill(spark):
    """The table and the placement by MD5 digests in plain Python."""
    import hashlib

    digits = lambda x, a: int(hashlib.md5(x.encode()).hexdigest()[a : a + 8], 16)
    names, slots = sorted(f"s{k}" for k in range(5)), 101
    order = {n: [(digits(n, 0) % slots + j * (digits(n, 8) % (slots - 1) + 1)) % slots for j in range(slots)] for n in names}
    held = {}
    while len(held) < slots:
        for n in names:
            if len(held) < slots:
                held[next(x for x in order[n] if x not in held)] = n
    assert {r["slot"]: r["shard"] for r in sharding.table(spark, names, slots).collect()} == held
    rows = spark.createDataFrame([("a",), ("",), (None,), ("é x",)], "k string")
    for r in sharding.placed(rows, "k", names, slots).collect():
        assert r["slot"] == digits(r["k"] or "", 0) % slots and r["shard"] == held[r["slot"]]


def covering(rows, features):
    """Sequential covering in plain Python: (feature, op, threshold) conjunctions from rows of (values, bad, grow)."""
    cuts = {}
    for n in features:
        found = set()
        for y in (True, False):
            values = sorted(v[n] for v, bad, _ in rows if bad == y)
            found |= {values[max(0, math.ceil(k / quality_rules.QUANTILES * len(values)) - 1)] for k in range(1, quality_rules.QUANTILES)} if values else set()
        cuts[n] = sorted(found)
    fits = lambda v, rule: all(v[n] <= t if op == "<=" else v[n] > t for n, op, t in rule)
    rest, rules = list(rows), []
    while len(rules) < quality_rules.MAX_RULES:
        rule = []
        while len(rule) < quality_rules.MAX_CONDITIONS:
            now = [(v, bad) for v, bad, grow in rest if grow and fits(v, rule)]
            p0, n0 = sum(b for _, b in now), sum(not b for _, b in now)
            if not p0 or rule and not n0:
                break
            best = (0.0, None)
            for n in features:
                for t in cuts[n]:
                    for op in ("<=", ">"):
                        p, m = (sum(b == y for v, b in now if fits(v, [(n, op, t)])) for y in (True, False))
                        gain = p * (math.log2((p + 1) / (p + m + 2)) - math.log2((p0 + 1) / (p0 + n0 + 2))) if p else 0.0
                        best = max(best, (gain, (n, op, t)), key=lambda x: x[0])
            if best[1] is None or best[0] <= 1e-9:
                break
            rule.append(best[1])
        if not rule:
            break
        later = [(v, bad) for v, bad, grow in rest if not grow]
        met = [[bad for v, bad in later if fits(v, rule[:k])] for k in range(1, len(rule) + 1)]
        score = [round((sum(x) - sum(not b for b in x)) / max(1, len(x)), 3) for x in met]
        keep = max(range(len(rule)), key=lambda k: (score[k], -k))
        if len(met[keep]) < quality_rules.MIN_COVER or sum(met[keep]) / len(met[keep]) < quality_rules.MIN_PRECISION:
            break
        rules.append(rule[: keep + 1])
        rest = [r for r in rest if not fits(r[0], rules[-1])]
    return rules


def test_rules_by_covering(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    sampled = quality_rules.sample(docs, labels).cache()
    values = [F.expr(e).alias(n) for n, e in quality_rules.FEATURES.items()]
    grow = (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) > 0).alias("grow")
    rows = [({n: float(r[n]) for n in quality_rules.FEATURES}, r["bad"], r["grow"]) for r in sampled.select(*values, "bad", grow).collect()]
    want = covering(rows, [*quality_rules.FEATURES])
    assert want and quality_rules.learn(sampled).rules == want


def test_sharding(spark):
    names = [f"s{k}" for k in range(7)]
    held = {r["slot"]: r["shard"] for r in sharding.table(spark, names, 503).collect()}
    assert sorted(held) == [*range(503)]
    counts = [[*held.values()].count(n) for n in names]
    assert max(counts) - min(counts) <= 1
    less = {r["slot"]: r["shard"] for r in sharding.table(spark, names[:-1], 503).collect()}
    assert sum(less[k] == v for k, v in held.items()) > 0.7 * 503
    rows = frame(spark, corpus()).withColumn("slot", F.lit("own"))
    got = sharding.placed(rows, "doc_id", names, 503).collect()
    assert len(got) == rows.count() and all(held[r["slot"]] == r["shard"] for r in got)
    with pytest.raises(ValueError):
        sharding.table(spark, names, 500)


def test_quotes(spark):
    rows = [(1, 0, "Hello there friend\nHow are you?"), (1, 1, "> Hello there friend\nHi!\n\nFine thanks."), (1, 2, ">> hello   THERE friend\n> Hi!\nNice"), (1, 3, "> Nice\n> Hi!\nok"), (1, 4, None), (1, 4, ""), (2, 0, "> unknown\n>\nx"), (2, 1, "  > x\ny"), (2, 2, "> y\n>> x\nz"), (None, 0, "> a"), (2, None, "> x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string").withColumn("body", F.lit(7)).withColumn("root", F.lit("own"))
    got = {(r["conv_id"], r["turn"], r["text"]): (r["n_quoted"], r["parent"], r["root"], r["depth"], r["body"]) for r in quote_linking.linked(df).collect()}
    want = [(0, None, 0, 0), (1, 0, 0, 1), (2, 1, 0, 2), (2, 2, 0, 3), (0, None, 4, 0), (0, None, 4, 0), (2, None, 0, 0), (1, 0, 0, 1), (2, 1, 0, 2), (1, None, 0, 0), (1, None, None, 0)]
    assert [got[r][:4] for r in rows] == want
    threads = {(r["conv_id"], r["turn"], r["text"]): r["thread"] for r in quote_linking.linked(df).collect()}
    assert [threads[r] for r in rows] == [[0], [0, 1], [0, 1, 2], [0, 1, 2, 3], [4], [4], [0], [0, 1], [0, 1, 2], [0], [None]]
    branches = [(3, 0, "start of it"), (3, 1, "> start of it\nleft"), (3, 2, "> start of it\nright"), (3, 3, "> left\nleft again"), (3, 4, "other"), (3, 5, "> right\nright again")]
    ordered = quote_linking.conversations(spark.createDataFrame(branches, "conv_id bigint, turn bigint, text string").repartition(3))
    assert [(r["turn"], r["text"]) for r in ordered.collect()] == [(0, "start of it"), (1, "left"), (3, "left again"), (2, "right"), (5, "right again"), (4, "other")]
    assert got[rows[1]][4] == "Hi!\n\nFine thanks." and got[rows[2]][4] == "Nice"
    chain = [(9, 0, "m0")] + [(9, k, f"> m{k - 1}\nm{k}") for k in range(1, 40)]
    far = quote_linking.linked(spark.createDataFrame(chain, "conv_id bigint, turn bigint, text string")).collect()
    assert all((r["root"], r["depth"]) == (0, r["turn"]) for r in far)
