"""Question banks: duplicates by prefix and by likeness, self-check, labels, banks and answer parsing."""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mulberry.config import DEFAULTS
from mulberry.functions import text as T
from mulberry.operators.catalog import first_with_key
from mulberry.operators.records import let
from mulberry.session import checkpointed

# Subject areas by key words, in the order in which ties are decided.
TOPIC_WORDS = (
    ("业务连续性", ("业务连续性", "BCP", "BIA", "业务影响分析", "RTO", "RPO", "灾难恢复", "备份中心", "应急响应计划", "DRP")),
    ("信息安全监管", ("等级保护", "分级保护", "网络安全法", "《网络安全法》", "监管", "保密", "密码管理条例", "国家标准", "GB/T", "法律法规", "刑事责任", "行政处罚", "政策", "27 号文件", "27号文件")),
    ("信息安全评估", ("风险评估", "安全评估", "评估框架", "CC", " Common Criteria", "保证级", "EAL", "测评", "成熟度", "SSE-CMM", "检查单", "渗透测试")),
    ("软件安全开发", ("软件安全开发生命周期", "SDL", "代码", "软件测试", "需求分析", "软件工程", "软件开发", "编码", "漏洞扫描", "补丁管理", "软件配置管理", "CMM")),
    ("安全工程与运营", ("安全工程", "系统安全工程", "运营", "运维", "变更管理", "事件处置", "应急响应", "入侵检测", "入侵防御", "IDS", "IPS", "SOC", "安全审计")),
    ("物理与网络通信安全", ("物理安全", "机房", "门禁", "防火", "防水", "电磁", "防火墙", "路由", "交换机", "VPN", "无线", "WLAN", "TCP", "IP 协议", "IP协议", "OSI", "网络架构", "网段", "VLAN", "链路", "网关")),
    ("计算环境安全", ("操作系统", "数据库", "恶意代码", "病毒", "木马", "蠕虫", "身份鉴别", "访问控制", "安全审计策略", "终端", "主机", "虚拟化", "云", "移动应用", "APP", "BLP", "Biba", "ChineseWall", "Bell-LaPadula", "强制访问控制", "自主访问控制", "最小特权")),
    ("信息安全支撑技术", ("密码", "加密", "解密", "对称", "非对称", "密钥", "PKI", "数字证书", "数字签名", "散列", "哈希", "Hash", "MAC", "AES", "DES", "RSA", "SSL", "IPSec", "Kerberos", "消息摘要", "CA")),
    ("信息安全管理", ("安全管理", "信息安全管理体系", "ISMS", "27001", "风险管理", "风险处置", "资产", "威胁", "脆弱性", "人员安全", "第三方", "供应链", "安全意识", "制度建设", "PDCA")),
    ("信息安全保障", ("信息安全保障", "保障体系", "深度防御", "PDR", "P2DR", "IATF", "信息系统安全保障", "CMMI", "保障框架", "九项重点工作")),
)
# Topics by a part of a file name, in order.
FILE_TOPICS = (
    ("信息安全保障", "信息安全保障"), ("信息安全监管", "信息安全监管"), ("网络安全监管", "信息安全监管"), ("信息安全支撑技术", "信息安全支撑技术"), ("安全支撑技术", "信息安全支撑技术"),
    ("物理与网络通信安全", "物理与网络通信安全"), ("物理网络安全", "物理与网络通信安全"), ("计算环境安全", "计算环境安全"), ("软件安全开发", "软件安全开发"), ("信息安全评估", "信息安全评估"),
    ("安全工程与运营", "安全工程与运营"), ("安全工程运营", "安全工程与运营"), ("业务连续性", "业务连续性"), ("信息安全管理", "信息安全管理"),
)


def topic_of_file(name: Column) -> Column:
    """The topic of the first part that the name holds, else 未分类."""
    return F.coalesce(*[F.when(F.contains(name, F.lit(part)), topic) for part, topic in FILE_TOPICS], F.lit("未分类"))


def topic_by_words(text: Column, rules: Sequence[tuple[str, Sequence[str]]] = TOPIC_WORDS) -> Column:
    """The topic with the most of its words in the text; ties go to the earlier rule, null without any."""

    def best(low: Column) -> Column:
        hits = [F.struct(sum((F.contains(low, F.lit(w.lower())).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(t).alias("t")) for i, (t, words) in enumerate(rules)]
        return F.array_max(F.array(*hits))

    return let(let(F.lower(text), best), lambda b: F.when(b["n"] > 0, b["t"]))


def labelled(questions: DataFrame, topics: DataFrame, labeller: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``id``, ``topic`` of every question: by its words (stem, options and analysis), else what the labeller says, else null.

    labeller: (id, text) -> (id, topic) for questions without a topic by words only, e.g. a hosted model; a topic that isn't in
    ``topics`` (domain) doesn't count, of several for one id the smallest does. The options may be any text.
    """
    options = F.coalesce(F.array_join(F.map_values(F.from_json("options", "map<string,string>")), " "), F.lit(""))
    told = questions.select("id", F.concat_ws(" ", "stem", options, "analysis").alias("text")).withColumn("topic", topic_by_words(F.col("text")))
    if labeller is None:
        return told.select("id", "topic")
    known = topics.select(F.col("domain").alias("topic")).distinct()
    more = labeller(told.where("topic is null").select("id", "text")).join(known, "topic", "left_semi").groupBy("id").agg(F.min("topic").alias("__more"))
    return told.join(more, "id", "left").select("id", F.coalesce("topic", "__more").alias("topic"))


def prefix_duplicates(questions: DataFrame, length: int = 40, strip_number: bool = False) -> DataFrame:
    """``id``, ``first_id``: questions whose first characters (blanks and punctuation aside) equal those of an earlier one."""
    stem = F.regexp_replace("stem", r"^\s*\d{1,4}\s*[、.．]\s*", "") if strip_number else F.col("stem")
    return first_with_key(questions.select("id", F.left(T.match_form(F.coalesce(stem, F.lit(""))), F.lit(length)).alias("key"), F.col("id").alias("ord")), "key", "ord")


def _counted(stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of the stems, each with the number of its occurrence as one code, and the stem each is of."""
    codes = np.frombuffer("".join(stems).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(stems)), [len(s) for s in stems])
    order = np.lexsort((codes, owner))
    codes, owner = codes[order], owner[order]
    new = np.r_[True, (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])]
    at = np.arange(len(codes))
    return (codes << 32) | (at - np.maximum.accumulate(np.where(new, at, 0))), owner


def _alike(a: list[str], b: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of stems whose shared characters (a bound of the matching blocks) allow a ratio of the threshold."""
    (ca, oa), (cb, ob) = _counted(a), _counted(b)
    words = np.intersect1d(ca, cb)
    x, y = np.zeros((len(a), len(words)), np.float32), np.zeros((len(b), len(words)), np.float32)
    for m, c, o in ((x, ca, oa), (y, cb, ob)):
        held = np.isin(c, words)
        m[o[held], np.searchsorted(words, c[held])] = 1
    lengths = np.array([len(s) for s in a], np.float32)[:, None] + np.array([len(s) for s in b], np.float32)[None, :]
    return np.nonzero(2 * (x @ y.T) >= (threshold - 1e-5) * lengths)


def _shared_pairs(a: str, b: str) -> int:
    n = Counter(zip(a, a[1:]))
    return sum(min(k, n[t]) for t, k in Counter(zip(b, b[1:])).items() if t in n)


def _ratio(a: str, b: str, threshold: float) -> float:
    """The matching-block ratio, or 0 where the shared pairs of characters rule out the threshold: M matched characters lie in
    no more blocks than there are unmatched ones, and one, and a block of n has n - 1 pairs."""
    both = len(a) + len(b)
    if _shared_pairs(a, b) < (1.5 * (threshold - 1e-5) - 1) * both - 1:
        return 0.0
    return round(difflib.SequenceMatcher(None, a, b).ratio(), 6)


def similar_stems(questions: DataFrame, threshold: float = DEFAULTS.dup_similarity, block: int = 2048) -> DataFrame:
    """``id_a``, ``id_b``, ``ratio``: stems whose matching-block ratio reaches the threshold, within a topic.

    Every pair of different stems of a topic is bounded by the characters it shares, as products of blocks of stems, so
    none is missed; what passes is bounded by its pairs of characters and compared. Equal stems are one class, named by its
    smallest id: pairs are of classes, and each other id of a class has one row with the class and ratio 1.
    The ratio compares stems in the order of their ids, as matching blocks aren't symmetric.
    """
    stem = T.match_form(F.regexp_replace(F.coalesce("stem", F.lit("")), r"^\s*\d{1,4}\s*[、.．]\s*", ""))
    told = questions.select("id", F.coalesce("domain", F.lit("")).alias("domain"), stem.alias("s")).where("s <> ''")
    kinds = told.groupBy("domain", "s").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    copies = told.join(kinds.where("n > 1"), ["domain", "s"]).where("id <> first").select(F.col("first").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("ratio")).distinct()
    of = kinds.groupBy("domain").agg(F.ceil(F.count(F.lit(1)) / block).alias("of"))
    dealt = kinds.join(of, "domain").withColumn("at", F.pmod(F.xxhash64("first"), F.col("of")))
    blocks = dealt.groupBy("domain", "of", "at").agg(F.collect_list(F.struct("first", "s")).alias("held"))
    met = blocks.select("domain", "at", "held", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).alias("other"))
    met = met.select("domain", F.least("at", "other").alias("lo"), F.greatest("at", "other").alias("hi"), "at", F.col("held.first").alias("ids"), F.col("held.s").alias("stems"))
    kind = questions.schema["id"].dataType.simpleString()

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) == 1 and rows["lo"].iloc[0] != rows["hi"].iloc[0]:  # no stem was dealt to the other block
            return pd.DataFrame({"id_a": [], "id_b": [], "ratio": []})
        rows = rows.sort_values("at")
        ids, stems, ids2, stems2 = (list(rows[c].iloc[k]) for k in (0, -1) for c in ("ids", "stems"))
        found = []
        for i, j in zip(*_alike(stems, stems2, threshold)):
            if len(rows) > 1 or i < j:
                (p, a), (q, b) = sorted([(ids[i], stems[i]), (ids2[j], stems2[j])])
                found.append((p, q, _ratio(a, b, threshold)))
        out = pd.DataFrame(found, columns=["id_a", "id_b", "ratio"])
        return out[out["ratio"] >= threshold]

    met = met.repartition(8 * met.sparkSession.sparkContext.defaultParallelism, "domain", "lo", "hi")  # a block pair is work, however few its bytes
    return met.groupBy("domain", "lo", "hi").applyInPandas(compare, f"id_a {kind}, id_b {kind}, ratio double").unionByName(copies)


def self_check(questions: DataFrame) -> DataFrame:
    """Counts over the bank, by source and by topic (grouping sets): total, no_answer, no_domain, needs_review, duplicates.
    A question needs review too if its answer has letters that aren't options, or it has no topic."""
    answer, topic = F.coalesce("answer", F.lit("")), F.coalesce(F.nullif(F.trim("domain"), F.lit("")), F.lit("未分类"))
    keys = F.coalesce(F.json_object_keys("options"), F.array().cast("array<string>"))
    foreign = F.size(F.array_except(F.regexp_extract_all(answer, F.lit("[A-Z]"), F.lit(0)), keys)) > 0
    told = questions.select("source", topic.alias("topic"), (F.trim(answer) == "").alias("no_answer"), (topic == "未分类").alias("no_domain"), (F.coalesce("needs_review", F.lit(False)) | foreign | (topic == "未分类")).alias("review"), (F.coalesce(F.trim("dup_of"), F.lit("")) != "").alias("dup"))
    return told.groupingSets([[], ["source"], ["topic"]], "source", "topic").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("no_answer").alias("no_answer"), F.count_if("no_domain").alias("no_domain"), F.count_if("review").alias("needs_review"), F.count_if("dup").alias("duplicates")
    )


def parse_failures(questions: DataFrame) -> DataFrame:
    """``id``, ``reason``: no stem, fewer than two options, or no answer (one row for each that applies)."""
    keys = F.coalesce(F.size(F.json_object_keys("options")), F.lit(0))
    reasons = F.array(F.when(F.coalesce(F.trim("stem"), F.lit("")) == "", "empty_stem"), F.when(keys < 2, "few_options"), F.when(F.coalesce(F.trim("answer"), F.lit("")) == "", "no_answer"))
    return questions.select("id", F.explode(F.filter(reasons, lambda r: r.isNotNull())).alias("reason"))


def banks(rows: DataFrame, by: str, order: list[str], number: str) -> DataFrame:
    """``bank`` (from 1) within ``by``: a new bank starts where the number falls. The rows of one delivered file meet in a task."""
    w = Window.partitionBy(by).orderBy(*order)
    starts = rows.withColumn("__new", F.when(F.col(number) < F.lag(number).over(w), 1).otherwise(0))
    return starts.withColumn("bank", 1 + F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def continued_rows(rows: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """``by``, ``item``, ``text``: rows that start with a printed number begin an item, others continue the one before."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    told = rows.withColumn("item", F.sum(F.col(text).rlike(r"^\s*\d{1,4}\s*[、.．]").cast("int")).over(w))
    held = told.where("item > 0").groupBy(by, "item").agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("all"))
    return held.select(by, "item", F.array_join(F.transform("all", lambda x: x[text]), "").alias("text"))


def answer_at_end(stem: Column) -> Column:
    """The letters at the end of a stem, empty without."""
    return F.regexp_extract(F.regexp_replace(stem, r"[\s：:，,]+$", ""), "([A-D]{1,4})$", 1)


def graded(attempts: DataFrame, questions: DataFrame) -> DataFrame:
    """Attempts with ``right``: whether the normalised choice equals the normalised answer (null for unknown questions)."""
    known = questions.select(F.col("id").alias("question_id"), T.choice_letters(F.coalesce("answer", F.lit(""))).alias("told"), F.lit(True).alias("known"))
    same = T.choice_letters(F.coalesce("choice", F.lit(""))) == F.col("told")
    return attempts.join(known, "question_id", "left").withColumn("right", F.when(F.col("known"), same)).drop("told", "known")


def redacted(questions: DataFrame) -> DataFrame:
    """What may be shown before a question is answered: no answer, no analysis."""
    return questions.select("id", "source", "domain", "stem", "options")


def generated(rows: DataFrame, now_ms: int, order: str) -> DataFrame:
    """Generated questions as rows of the bank: ids ``ai_`` and a number from ``now_ms`` on, in the order given; their source is
    AI生成. Numbers are counted within partitions of the order and put together, so no task sees all rows."""
    told = rows.select("stem", "options", "answer", F.coalesce("analysis", F.lit("")).alias("analysis"), "domain").repartitionByRange(order).sortWithinPartitions(order)
    placed = checkpointed(told.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()))
    sizes = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__size"), F.min("__i").alias("__low"))
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__size").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = F.lit(now_ms) + F.col("__start") + F.col("__i") - F.col("__low")
    joined = placed.join(F.broadcast(starts), "__p")  # a row for each partition
    return joined.select(F.concat(F.lit("ai_"), number.cast("string")).alias("id"), F.lit("AI生成").alias("source"), F.lit(0).alias("num"), "stem", "options", "answer", "analysis", "domain", F.lit(False).alias("needs_review"))
