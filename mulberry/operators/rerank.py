"""Feature reranking: additive terms as column expressions, rule tables as data, and logistic scoring."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mulberry.functions import text as T

OVERVIEW_PREFIXES = ("知识子域", "课程内容")
OVERVIEW_VERBS = ("了解", "理解", "掌握")
FEATURES = (
    "base_score", "dense_score", "title_overlap", "text_overlap", "phrase_match", "acronym_hit", "source_first", "source_v42", "overview", "short_detail",
    "composition_title", "composition_text", "process_title", "process_text", "table_numeric",
)


@dataclass(frozen=True)
class CoverageRule:
    """A bonus for a text that holds ``hits`` of the terms, where the query holds all of ``needs`` and one of ``one_of``.
    What is in ``titled`` may stand in the title, too."""

    needs: tuple[str, ...]
    one_of: tuple[str, ...]
    terms: tuple[str, ...]
    hits: int
    bonus: float
    titled: tuple[str, ...] = ()


# What a good answer page covers, by what the query asks.
RULES = (
    CoverageRule(("EAL",), ("划分", "评估保证级"), ("EAL1", "EAL7"), 2, 0.012),
    CoverageRule(("网络安全等级保护",), ("几级", "最高"), ("第一级", "第五级"), 2, 0.012),
    CoverageRule(("强制访问控制", "模型"), (), ("BELL", "BIBA", "CLARK-WILSON", "CHINESE WALL"), 3, 0.012),
    CoverageRule(("升级版",), (), ("升级版",), 1, 0.010),
    CoverageRule(("计算机犯罪", "狭义", "广义"), (), ("狭义", "广义"), 2, 0.012),
    CoverageRule(("入侵检测系统",), ("组成", "构成"), ("事件产生器", "事件分析", "事件响应", "数据库"), 3, 0.024),
    CoverageRule(("受攻击面", "方法"), (), ("分析产品的功能", "哪些路径", "访问的特权", "增强防护措施"), 3, 0.012),
    CoverageRule(("变更管理",), ("步骤", "过程"), ("变更批准", "变更记录"), 3, 0.012, ("变更管理的过程",)),
    CoverageRule(("风险评估",), ("四个阶段", "哪些阶段"), ("风险评估过程", "准备", "要素识别", "风险分析", "结果判定"), 4, 0.018),
    CoverageRule(("定级", "等级"), ("流程", "如何确定"), ("定级对象", "安全保护等级"), 2, 0.012),
    CoverageRule(("工业控制系统", "安全架构"), (), ("管理控制", "操作控制", "技术控制"), 3, 0.012),
    CoverageRule(("SSE-CMM", "能力级别"), ("2级", "2 级"), ("规划和跟踪级", "规划执行", "规范化执行", "跟踪执行", "验证执行"), 4, 0.024),
)


def _hits(text: Column, terms: Sequence[str]) -> Column:
    return sum((F.contains(text, F.lit(t)).cast("int") for t in terms), F.lit(0))


def coverage_bonus(query: Column, title: Column, text: Column, rules: Sequence[CoverageRule] = RULES) -> Column:
    q, body, whole = F.upper(query), F.upper(text), F.upper(F.concat_ws("\n", title, text))
    total = F.lit(0.0)
    for r in rules:
        asked = _hits(q, r.needs) == len(r.needs)
        if r.one_of:
            asked = asked & T.any_of(q, r.one_of)
        total = total + F.when(asked & (_hits(body, r.terms) + _hits(whole, r.titled) >= r.hits), r.bonus).otherwise(0.0)
    return total


def overlap(terms: Column, text: Column) -> Column:
    """The share of the terms (repeats count) that the text holds, blanks aside."""
    told = F.regexp_replace(F.lower(text), T.SPACES, "")
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.contains(told, t))) / F.size(terms)).otherwise(0.0)


def phrase_match(query: Column, title: Column) -> Column:
    q, t = T.compact(query), T.compact(title)
    return F.when((q == "") | (t == ""), 0.0).when(F.contains(q, t) | F.contains(t, q), 1.0).when((F.length(t) >= 5) & F.contains(q, F.left(t, F.lit(5))), 0.6).otherwise(0.0)


def overview_value(title: Column, text: Column) -> Column:
    verbs = F.size(F.regexp_extract_all(text, F.lit("|".join(OVERVIEW_VERBS)), F.lit(0)))
    return F.when(title.startswith(OVERVIEW_PREFIXES[0]) | title.startswith(OVERVIEW_PREFIXES[1]), 1.0).when(verbs >= 3, 0.5).otherwise(0.0)


def features(query: Column, terms: Column) -> dict[str, Column]:
    """Feature columns of a candidate with the columns score, dense_score, title, text, source, element."""
    title, text, source = F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")), F.coalesce("source", F.lit(""))
    numeric = query.rlike(r"\d|第[一二三四五六七八九十]+|等级|字段|取值|赋值|位|表")
    flag = lambda c: c.cast("double")
    composition, process = T.any_of(query, T.COMPOSITION_CUES), T.any_of(query, T.PROCESS_CUES)
    return {
        "base_score": F.col("score"),
        "dense_score": F.coalesce("dense_score", F.lit(0.0)),
        "title_overlap": overlap(terms, title),
        "text_overlap": overlap(terms, text),
        "phrase_match": phrase_match(query, title),
        "acronym_hit": flag(F.arrays_overlap(T.acronyms(query), T.acronyms(title))),
        "source_first": flag(F.contains(source, F.lit("CISP 4.2"))),
        "source_v42": flag(source.rlike("[Vv]4[.]2")),
        "overview": overview_value(title, text),
        "short_detail": flag(T.any_of(query, T.DETAIL_CUES) & (F.length(text) < 120)),
        "composition_title": flag(composition & T.any_of(title, T.COMPOSITION_TEXT_CUES)),
        "composition_text": flag(composition & T.any_of(text, T.COMPOSITION_TEXT_CUES)),
        "process_title": flag(process & T.any_of(title, T.PROCESS_TEXT_CUES)),
        "process_text": flag(process & T.any_of(text, T.PROCESS_TEXT_CUES)),
        "table_numeric": flag((F.coalesce("element", F.lit("text")) == "table") & numeric),
    }


def feature_score(query: Column, terms: Column) -> Column:
    """The additive score of a candidate (columns as for features, and ``context``: whether it neighbours a page shown before)."""
    f = features(query, terms)
    title, text, own = F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")), T.acronyms(query)
    named = F.size(F.filter(own, lambda a: F.contains(F.upper(text), F.upper(a))))
    entities = F.when((F.size(own) >= 2) & (named >= 2), F.least(0.004 * named, F.lit(0.012))).otherwise(0.0)
    # a title that writes an acronym of the query out is as good as one that holds it
    written = F.exists(T.written_out(query), lambda b: F.contains(title, b))
    named_title = F.when((f["acronym_hit"] > 0) | written, 0.004).otherwise(0.0)
    steps = F.size(F.regexp_extract_all(text, F.lit(r"P\d+-|D\d+-|C\d+-|第[一二三四五六七八九十]+阶段|（\d+）|[1-9][、.．]"), F.lit(0)))
    asks_steps = T.any_of(query, (*T.PROCESS_CUES, "哪些方法", "哪些工作", "哪些要点"))
    source = F.when(f["source_first"] > 0, 0.0015).when(f["source_v42"] > 0, 0.001).otherwise(0.0)
    thin = F.when(~T.any_of(query, T.DETAIL_CUES), 0.0).when(F.length(text) < 80, 0.004).when(F.length(text) < 120, 0.002).otherwise(0.0)
    return (
        f["base_score"] + 0.003 * f["title_overlap"] + 0.002 * f["text_overlap"] + 0.003 * f["phrase_match"]
        + 0.003 * (f["composition_title"] + f["composition_text"]) + 0.002 * (f["process_title"] + f["process_text"])
        + 0.002 * f["table_numeric"] + F.when(asks_steps & (steps >= 3), 0.004).otherwise(0.0) + coverage_bonus(query, title, text) + entities
        + F.when(F.coalesce("context", F.lit(False)), 0.0015).otherwise(0.0) + 0.001 * f["acronym_hit"] + named_title + source
        - F.when(f["overview"] == 1.0, 0.006).when(f["overview"] == 0.5, 0.003).otherwise(0.0) - thin
    )


def reranked(candidates: DataFrame) -> DataFrame:
    """Candidates (query_id, query, terms, id, rank and the feature columns) by feature score; ties keep their order."""
    w = Window.partitionBy("query_id").orderBy(F.col("feature_score").desc(), "rank")
    return candidates.withColumn("feature_score", F.round(feature_score(F.col("query"), F.col("terms")), 6)).withColumn("new_rank", F.row_number().over(w))


def renumbered(ranked: DataFrame, *order: Column) -> DataFrame:
    """The rows with ``rank`` anew, within each query by ``order``."""
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def logistic_score(values: Sequence[Column], model: dict) -> Column:
    """1/(1+e^-z) of standardised values; z within ±50, a scale of 0 counts as 1."""
    z = F.lit(float(model["intercept"]))
    for v, mean, scale, weight in zip(values, model["mean"], model["scale"], model["coef"], strict=True):
        z = z + (v - mean) / (scale or 1.0) * weight
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(50.0)), F.lit(-50.0))))


def fold_versions(ranked: DataFrame) -> DataFrame:
    """Fold pages of one topic and title that come in several versions of a source (name with v4.x, title of 4 or more).

    The first page holds the place; pages of the first page's source stay too. A page of another source is dropped, but
    if the page held has fewer than 80 characters and the other is longer, the other takes its place. Ordered fold
    per group over an array of that group of one query's candidates (as many as were recalled); other rows pass
    through. ranked: query_id, id, rank, domain, title, source, text.
    """
    title = T.compact(F.coalesce("title", F.lit("")))
    versioned = F.coalesce("source", F.lit("")).rlike(r"[vV]4\.\d+") & (F.length(title) >= 4)
    rows = ranked.withColumn("__key", F.when(versioned, F.concat_ws("\x1f", F.coalesce("domain", F.lit("")), title)))
    alone = rows.where("__key is null").select("query_id", "id", F.col("rank").alias("slot"))
    item = F.struct("rank", "id", "source", F.length(F.coalesce("text", F.lit(""))).alias("size"))
    groups = rows.where("__key is not null").groupBy("query_id", "__key").agg(F.array_sort(F.collect_list(item)).alias("all"))
    first = F.col("all")[0]
    others = F.filter("all", lambda x: x["source"] != first["source"])
    holder = F.aggregate(others, first, lambda held, x: F.when((held["size"] < 80) & (x["size"] > held["size"]), x).otherwise(held))
    same = F.filter(F.slice("all", 2, 2**31 - 2), lambda x: x["source"] == first["source"])
    kept = F.concat(F.array(F.struct(first["rank"].alias("slot"), holder["id"].alias("id"))), F.transform(same, lambda x: F.struct(x["rank"].alias("slot"), x["id"].alias("id"))))
    return alone.unionByName(groups.select("query_id", F.inline(kept)).select("query_id", "id", "slot"))


def near_page(page: Column, other_page: Column) -> Column:
    """Whether a page lies one to three pages from another."""
    return F.abs(page - other_page).between(1, 3)
