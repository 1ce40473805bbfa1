import numpy as np
import pytest
from pyspark.sql import functions as F

from mulberry.functions import text as T
from mulberry.operators import dense, evaluation, fusion, lexical, rerank

RANKED = "query_id bigint, id string, rank int"


def test_idf_and_scores(spark):
    corpus = spark.createDataFrame([("a", "x y"), ("b", "x"), ("c", "x")], "id string, t string")
    index = lexical.postings(corpus, F.split("t", " "))
    scores = {r.id: r.score for r in lexical.bm25(spark.createDataFrame([(1, ["y"])], "query_id bigint, tokens array<string>"), index).collect()}
    tf = 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / (4 / 3)))
    assert scores == {"a": round(np.log(1 + 2.5 / 1.5) * tf, 6)}


def test_reciprocal_rank(spark):
    one = spark.createDataFrame([(1, "a", 1)], RANKED)
    assert fusion.reciprocal_rank([(one, 1.0), (one, 1.0)], 20).first().score == pytest.approx(2 / 21, abs=1e-9)
    lists = spark.createDataFrame([(1, 0, "a", 1), (1, 1, "a", 1)], "query_id bigint, variant int, id string, rank int")
    assert fusion.merge_variants(lists, 20).first().score == pytest.approx(3 / 21, abs=1e-9)


def test_alpha_fusion(spark):
    df = spark.createDataFrame([(1, "a", 1, 0.2), (1, "b", 2, 0.9), (1, "c", 3, 0.1)], "query_id bigint, id string, rank int, rerank double")
    got = {r.id: (r.fused, r.new_rank) for r in fusion.alpha_fusion(df).collect()}
    assert got == {"b": (1.0, 1), "a": (0.8125, 2), "c": (0.25, 3)}


def test_cosine_in_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_ROWS", 40)
    monkeypatch.setattr(dense, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(0)
    m = rng.normal(size=(150, 8))
    m[7] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id bigint, vector array<double>")
    got = dense.cosine_top_k(df.where("id < 8").withColumnRenamed("id", "query_id"), df, 5).collect()
    unit = dense.unit(m)
    for q in range(8):
        scores = np.round(unit[q] @ unit.T, 6)
        want = np.lexsort((np.arange(150), -scores))[:5]
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == list(want)


@pytest.mark.parametrize("best,want", [(0.45, False), (0.4499, True), (None, False)])
def test_gate(spark, best, want):
    assert spark.createDataFrame([(best,)], "b double").select(dense.below_floor(F.col("b"), 0.45).alias("r")).first().r is want


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, False)], "query_id bigint, rank int, relevant boolean")
    truth = spark.createDataFrame([(1, 1), (2, 1)], "query_id bigint, n_relevant int")
    got = {r.query_id: r for r in evaluation.query_metrics(ranked, truth).collect()}
    assert got[1].ndcg10 == 0.63093 and got[1].rr == 0.5 and got[1].recall1 == 0 and got[1].recall3 == 1 and got[2].ndcg10 == 0.0


def slow_fold(rows):
    out, held = [], {}
    for rank, id_, domain, title, source, text in rows:
        key = (domain, title) if "4." in source and len(title) >= 4 else None
        if key in held:
            slot, first = held[key]
            if first == source:
                out.append(id_)
            elif len(dict_text[out[slot]]) < 80 and len(text) > len(dict_text[out[slot]]):
                out[slot] = id_
            continue
        if key:
            held[key] = (len(out), source)
        out.append(id_)
    return out


dict_text: dict = {}


def test_fold_versions(spark):
    rng = np.random.default_rng(3)
    rows = []
    for rank in range(1, 40):
        text = "文" * int(rng.integers(20, 160))
        rows.append((rank, f"i{rank:02d}", "d", ["标题一二", "标题三四", "短"][rng.integers(3)], ["课件_v4.1", "课件_V4.2", "讲义"][rng.integers(3)], text))
        dict_text[f"i{rank:02d}"] = text
    df = spark.createDataFrame([(1, *r) for r in rows], "query_id bigint, rank int, id string, domain string, title string, source string, text string")
    assert [r.id for r in rerank.fold_versions(df).orderBy("slot").collect()] == slow_fold(rows)


def test_features_and_coverage(spark):
    df = spark.createDataFrame([("入侵检测系统由哪些组成", "入侵检测", "事件产生器、事件分析器、事件响应单元组成", "课件_V4.2", 0.05)], "query string, title string, text string, source string, score double")
    df = df.withColumn("terms", T.tokens(F.col("query"))).withColumn("element", F.lit("text")).withColumn("dense_score", F.lit(None).cast("double")).withColumn("context", F.lit(True))
    row = df.select(rerank.coverage_bonus(F.col("query"), F.col("title"), F.col("text")).alias("c"), rerank.phrase_match(F.col("query"), F.col("title")).alias("p"), rerank.feature_score(F.col("query"), F.col("terms")).alias("s")).first()
    assert row.c == 0.024 and row.p == 1.0 and row.s > 0.05


def test_topup_fills_with_the_topic(spark):
    full = "query_id bigint, id string, domain string, topic string, score double, rank int"
    ranked = spark.createDataFrame([(1, "a", "x", "t", 0.5, 1), (1, "b", "t", "t", 0.4, 2)], full)
    sparse = spark.createDataFrame([(1, "b", "t", "t", 9.0, 1), (1, "c", "t", "t", 8.0, 2), (1, "e", "t", "t", 7.0, 3)], full)
    got = [(r.id, r.topped) for r in fusion.topic_filter(ranked, sparse, 2).orderBy("rank").collect()]
    assert got == [("b", 0), ("c", 1)]  # what fills up stands behind, whatever its score


def test_dense_sides_may_be_empty(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [0.0, 0.0])], "id string, vector array<float>")
    asked = vectors.withColumnRenamed("id", "query_id")
    assert [tuple(r) for r in dense.cosine_top_k(asked.where("query_id = 'a'"), vectors, 2).select("query_id", "id", "score", "rank").orderBy("rank").collect()] == [("a", "a", 1.0, 1), ("a", "b", 0.0, 2)]
    assert dense.cosine_top_k(asked.limit(0), vectors, 2).count() == 0
    assert dense.cosine_top_k(asked, vectors.limit(0), 2).count() == 0


def test_nearest_breaks_ties_by_the_earlier_column():
    scores = np.array([[0.5, 0.9, 0.5, 0.5], [0.1, 0.1, 0.1, 0.1]])
    assert dense.nearest(scores, 2).tolist() == [[1, 0], [0, 1]] and dense.nearest(scores, 9).shape == (2, 4)


def test_a_saved_index_scores_alike(spark, tmp_path):
    corpus = spark.createDataFrame([("a", "第三级 等级保护"), ("b", "3级 保护"), ("c", ""), ("d", None)], "id string, t string")
    asked = spark.createDataFrame([(1, ["3", "级保"]), (2, ["保护", "无此词"])], "query_id bigint, tokens array<string>")
    tokens = T.tokens(F.coalesce("t", F.lit("")))
    lexical.save_index(corpus, tokens, str(tmp_path / "index"), parts=7)
    told = lambda index: {(r.query_id, r.id): r.score for r in lexical.bm25(asked, index).collect()}
    want = told(lexical.postings(corpus.select("id", tokens.alias("x")), F.col("x"), asked=asked))
    assert want and told(lexical.saved_index(spark, str(tmp_path / "index"), asked)) == want
    assert told(lexical.saved_index(spark, str(tmp_path / "index"), asked.limit(0))) == {}


def test_levels_of_all_writings_are_one_token(spark):
    told = [("第三级", "3级"), ("三级", "3级"), ("3级", "3级"), ("第十一级", "11级"), ("十五级", "15级"), ("二十级", "20级"), ("三十二级和十级", "32级和10级"), ("一二级", "一二级"), ("第一二级", "一二级"), ("十", "十"), (None, None), ("", "")]
    df = spark.createDataFrame(told, "c string, want string")
    assert [(r.got, r.want) for r in df.select(T.level_numbers(F.col("c")).alias("got"), "want").collect()] == [(w, w) for _, w in told]
    assert df.limit(3).select(T.tokens(F.concat(F.lit("定为"), "c")).alias("t")).distinct().count() == 1


def test_bm25_in_blocks_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ROWS", 40)
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(lexical, "STEP", 2)
    rng = np.random.default_rng(3)
    words = lambda n: [f"w{x}" for x in rng.zipf(1.4, n) % 30]
    texts = [words(rng.integers(0, 12)) for _ in range(120)]
    rows = [(f"d{i:03d}", t) for i, t in enumerate(texts + texts[:30] * 3)] + [("d000", ["w1", "w2"]), (None, ["w1"]), ("z", None)]
    corpus = spark.createDataFrame(rows, "id string, tokens array<string>")
    asked = spark.createDataFrame([*[(i, words(i)) for i in range(8)], (1, ["w1"]), (9, None), (10, ["none"])], "query_id bigint, tokens array<string>")
    index = lexical.postings(corpus, F.col("tokens"), asked=asked)
    want = lexical.top_k(lexical.bm25(asked, index).where("score > 0"), 5)
    got = lexical.bm25_top_k(asked, index, 5, 213)
    told = lambda df: sorted((tuple(r) for r in df.select("query_id", "id", "score", "rank").collect()), key=str)
    assert told(got) == told(want) and len(told(got)) > 30
    assert lexical.bm25_top_k(asked.limit(0), index, 5, 213).count() == 0 and lexical.bm25_top_k(asked, index.limit(0), 5, 0).count() == 0
    # what is shuffled follows postings and queries, not their pairs
    assert "HashAggregate(keys=[query_id" not in got._jdf.queryExecution().sparkPlan().toString()
