import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mulberry.llm import near_duplicates as N
from mulberry.llm.graphs import chain_ends, connected_components

SCHEMA = "id string, stem string, options string"


def brute_groups(rows, threshold=0.6):
    from mulberry.llm.lookalikes import ScriptModel

    fold = ScriptModel([]).fold
    sets = {i: set(N.shingles(N.plain_pieces(fold, s, o)).tolist()) for i, s, o in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] | sets[b])
            if both and len(sets[a] & sets[b]) / both >= threshold:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(a, b) for a in ids for b in ids if a < b and find(a) == find(b)}


def made(seed=1):
    rng = random.Random(seed)
    words = [chr(0x4E00 + rng.randrange(3000)) for _ in range(400)]
    rows = []
    for g in range(40):
        stem = [rng.choice(words) for _ in range(60)]
        for v in range(rng.randrange(1, 5)):
            new = [w if rng.random() > 0.04 * v else rng.choice(words) for w in stem]
            rows.append((f"q{g:02d}_{v}", f"{v + 1}、" + "".join(new), '{"A":"' + "".join(stem[:9]) + '","B":"乙"}'))
    return rows


def test_groups_equal_brute_force(spark):
    rows = made()
    got = {(r.id_a, r.id_b) for r in N.version_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_groups(rows)


def test_edge_cases(spark):
    rows = [("a", None, None), ("b", "", "{}"), ("c", "同一个题目内容", "{}"), ("c", "同一个题目内容", "{}"), ("d", "9. 同一个题目内容", "不是JSON"), ("e", "短", None), ("f", "长文" * 50_000, "{}")]
    df = spark.createDataFrame(rows, SCHEMA)
    groups = {r.id: r.group_id for r in N.version_groups(df.selectExpr("*", "1 as content", "2 as bands", "3 as group_id")).collect()}
    assert groups == {"a": "a", "b": "b", "c": "c", "d": "d", "e": "e", "f": "f"} or groups["d"] in ("c", "d")
    assert N.version_pairs(df.limit(0)).count() == 0


def test_exact_copies_are_one_class(spark):
    df = spark.createDataFrame([(f"i{i:03d}", "完全相同的一个题目", "{}") for i in range(60)], SCHEMA)
    assert N.version_pairs(df).count() == 60 * 59 // 2
    assert N.version_groups(df).select("group_id").distinct().count() == 1


def test_densified_bins_keep_similarity():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**60, 90)
    agree = []
    for _ in range(30):
        other = np.unique(np.concatenate([base[:70], rng.integers(0, 2**60, 20)]))
        a, b = N.band_keys([np.sort(base), other], permutations=8, bins=64, rows=1)
        agree.append((a == b).mean())
    assert abs(np.mean(agree) - 70 / 110) < 0.05


@pytest.mark.parametrize("text,n", [([""], 0), (["ab"], 0), (["abc"], 1), (["abc", "abc"], 1), (["ab", "cd"], 0)])
def test_shingles(text, n):
    assert len(N.shingles(text)) == n


def test_graphs(spark):
    rng = random.Random(5)
    pointers = {f"n{i:03d}": f"n{rng.randrange(130):03d}" for i in range(110)} | {f"m{i:03d}": f"m{i + 1:03d}" for i in range(90)} | {"m090": "m050", "s": "s"}

    def end(x):
        path = {}
        while x in pointers and x not in path:
            path[x] = len(path)
            x = pointers[x]
        return x if x not in pointers else min(k for k, n in path.items() if n >= path[x])

    got = {r.node: r.root for r in chain_ends(spark.createDataFrame(list(pointers.items()), "node string, next string")).collect()}
    assert got == {x: end(x) for x in pointers}
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c"), *[(f"p{i:02d}", f"p{i + 1:02d}") for i in range(40)]], "a string, b string")
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    assert roots["b"] == "a" and roots["c"] == "c" and all(roots[f"p{i:02d}"] == "p00" for i in range(41))


def test_a_pair_at_the_threshold_shares_a_bucket():
    rng = np.random.default_rng(4)
    missed = 0
    for _ in range(1500):
        x = rng.integers(0, 2**60, 100)
        a, b = N.band_keys([np.sort(x[:80]), np.sort(np.r_[x[:60], x[80:]])])  # 60 of 100 shared
        missed += not (a == b).any()
    assert missed <= 1


@pytest.mark.parametrize("n", [5, 60])
def test_a_bucket_joins_all_that_belongs(spark, n):
    """One bucket of many strangers and a chain x, y, z where only neighbours are similar, in every order of hashes."""
    chain = [[1000 + i + 30 * k for i in range(100)] for k in range(3)]
    for tag in range(3):
        rows = [(f"{tag}{'xyz'[k]}", [7], c) for k, c in enumerate(chain)] + [(f"{tag}s{i}", [7], list(range(10_000 * i + 50_000, 10_000 * i + 50_100))) for i in range(n)]
        df = spark.createDataFrame(rows, "content string, bands array<bigint>, pieces array<bigint>")
        judge = (N.shared_of(F.col("left.pieces"), F.col("right.pieces")) >= 0.5).cast("int")
        got = {(r.a[1:], r.b[1:]) for r in N.banded_links(df, judge, 0.5).collect()}
        assert got == {("x", "y"), ("y", "z")}


def judged_pairs(spark, sets):
    """How many pairs are compared for sets that are all in one bucket, and the links found."""
    met = spark.sparkContext.accumulator(0)

    @F.pandas_udf("int")
    def judge(left: pd.DataFrame, right: pd.DataFrame) -> pd.Series:
        met.add(len(left))
        return pd.Series([int(len(set(a) & set(b)) >= 0.6 * len(set(a) | set(b))) for a, b in zip(left["pieces"], right["pieces"])], dtype="int32")

    df = spark.createDataFrame([(i, [7, 8], s) for i, s in enumerate(sets)], "content bigint, bands array<bigint>, pieces array<bigint>")
    links = N.banded_links(df, judge(F.col("left"), F.col("right")), 0.6).select("a", "b").distinct().collect()
    return met.value, {(r.a, r.b) for r in links}


@pytest.mark.parametrize("n", [200, 800])
def test_strangers_of_one_template_cost_few_pairs(spark, n):
    """All share 60 of their 150 pieces; two of them are versions."""
    sets = [[*range(60), *range(1000 + 100 * i, 1090 + 100 * i)] for i in range(n)]
    sets[n // 2] = [*range(60), *range(1010 + 100 * 5, 1090 + 100 * 5), *range(10)]
    met, links = judged_pairs(spark, [sorted(set(s)) for s in sets])
    assert links == {(5, n // 2)}
    assert met <= 4 * n * math.log2(n)


def test_versions_of_one_record_make_a_star(spark):
    """A bucket of versions that the centre joins is never compared again."""
    rng = random.Random(3)
    sets = [sorted(set(range(100)) - {rng.randrange(100)} | {1000 + i}) for i in range(300)]
    met, links = judged_pairs(spark, sets)
    assert met == 299 and len(links) == 299


def test_rare_keys_lose_no_link(spark):
    """Random sets over few pieces, all in one bucket: components are those of all pairs."""
    rng = random.Random(11)
    base = [rng.sample(range(300), 40) for _ in range(12)]
    sets = [sorted(set(b[: rng.randrange(25, 40)]) | set(rng.sample(range(300), rng.randrange(0, 14)))) for b in base for _ in range(8)]
    _, links = judged_pairs(spark, sets)

    def groups(pairs):
        root = list(range(len(sets)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        return [find(x) for x in range(len(sets))]

    every = [(i, j) for i in range(len(sets)) for j in range(i) if len(set(sets[i]) & set(sets[j])) >= 0.6 * len(set(sets[i]) | set(sets[j]))]
    assert len(every) > 20 and groups(links) == groups(every)


def test_marks_rule_out_no_pair(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(400):
        whole = rng.sample(range(10**9), rng.randrange(1, 220))
        a, b = ([x for x in whole if rng.random() < p] or whole for p in (rng.uniform(0.6, 1), rng.uniform(0.6, 1)))
        l, r = N.mark_words([np.array(sorted(a)), np.array(sorted(b))]).tolist()
        rows.append((len(a), len(b), len(set(a) & set(b)) / len(set(a) | set(b)), *l, *r))
    names = ["size_l", "size_r", "share", *[f"l{i}" for i in range(N.MARKS)], *[f"r{i}" for i in range(N.MARKS)]]
    df = spark.createDataFrame(rows, names)
    told = df.select("share", N.may_reach(0.6).alias("may")).collect()
    assert all(r.may for r in told if r.share >= 0.6) and sum(not r.may for r in told) > 20


def test_sets_and_bands_are_never_broadcast(spark, monkeypatch, tmp_path):
    plans, real = [], N.checkpointed
    monkeypatch.setattr(N, "checkpointed", lambda df: (plans.append(df._jdf.queryExecution().sparkPlan().toString()), real(df))[1])
    spark.createDataFrame(made(), SCHEMA).write.parquet(f"{tmp_path}/q")  # a file has a size, which the estimates start from
    N.version_pairs(spark.read.parquet(f"{tmp_path}/q"))
    shared_buckets, stars, verdicts = plans[2:5]
    for plan, joins in ((shared_buckets, 1), (stars, 3), (verdicts, 4)):
        assert plan.count("SortMergeJoin") == joins and "BroadcastHashJoin" not in plan
