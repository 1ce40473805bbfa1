import base64
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from mulberry.llm import packing, tokenization

tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def published():
    lines = open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_published_encoder(published):
    rng = random.Random(0)
    pieces = ["信息安全", "the ", "ing", "  ", "\n", "123", "é", "🙂", "<|endoftext|>", "'s", "，", "\x00", "ab", "\t", "混为一谈", "‍", "ﬁ", "한국어", "العربية"]
    own = tokenization.encoder()
    for _ in range(2000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))
        assert own.encode(text) == published.encode_ordinary(text)
    assert own.encode("x" * 50_000) == published.encode_ordinary("x" * 50_000)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(published, text):
    assert published.decode(tokenization.encoder().encode(text)) == text


def test_rows(spark):
    df = spark.createDataFrame([(1, "信息"), (2, None), (3, ""), (4, "<|endoftext|>"), (1, "信息")], "doc_id bigint, text string").selectExpr("*", "1 as ids")
    got = [(r.doc_id, r.ids) for r in tokenization.token_ids(df).collect()]
    assert got[1] == (2, []) and got[2] == (3, []) and got[0] == got[4] and 50256 not in got[3][1]
    assert [r.n_tokens for r in tokenization.token_counts(df).collect()] == [len(ids) for _, ids in got]
    assert tokenization.token_ids(df.limit(0)).count() == 0


def test_plans_use_up_all_lengths():
    rng = random.Random(1)
    for _ in range(40):
        counts = {rng.randrange(1, 60): rng.randrange(1, 50) for _ in range(rng.randrange(1, 12))}
        used: dict = {}
        for chosen, times in packing.pack_lengths(dict(counts), 60):
            assert sum(n * k for n, k in chosen.items()) <= 60 and times > 0
            for n, k in chosen.items():
                used[n] = used.get(n, 0) + k * times
        assert used == counts


def test_each_container_is_the_fullest():
    assert packing.fullest([7, 6, 4, 3], {7: 1, 6: 1, 4: 1, 3: 1}, 14) == {7: 1, 4: 1, 3: 1}
    assert packing.fullest([5], {5: 9}, 16) == {5: 3}


def test_packed(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 20)
    rng = random.Random(3)
    sizes = [(i, rng.choice([0, 7, 7, 7, 30, 45, 99, 260])) for i in range(300)] + [(900, None), (901, -1)]
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens int").selectExpr("*", "1 as n", "2 as container", "3 as rank")
    rows = packing.packed(df, capacity=100).collect()
    fill: dict = {}
    whole: dict = {}
    for r in rows:
        fill[r.container] = fill.get(r.container, 0) + r.n
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.n
    assert max(fill.values()) <= 100 and whole == {i: n for i, n in sizes if n and n > 0}
    assert sorted(fill) == list(range(len(fill))) and len(fill) <= -(-sum(fill.values()) // 100) * 1.2
    assert sum(r.doc_id == sizes[[s[1] for s in sizes].index(260)][0] for r in rows) == 3
    report = packing.fill_report(packing.packed(df, capacity=100), 100).first()
    assert report.containers == len(fill) and report.tokens == sum(fill.values())
    assert packing.packed(df.limit(0)).count() == 0
