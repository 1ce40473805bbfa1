"""Text expressions: all are built-in column expressions and stay in whole-stage code or the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that don't count in a search, cue words of question kinds, rules of the query rewriting.
STOPWORDS = ("的", "了", "和", "是", "在", "与", "及", "或", "一个", "以下", "以下哪一项", "下列", "哪些", "哪一种", "哪项", "对于", "关于", "通过", "进行", "可以", "能够", "主要")
DETAIL_CUES = ("哪些", "什么", "如何", "怎么", "区别", "阶段", "步骤", "目的", "方法", "组成", "包括")
COMPOSITION_CUES = ("组成", "构成", "由哪些", "包括哪些")
PROCESS_CUES = ("流程", "过程", "步骤", "阶段")
FACT_CUES = ("几", "多少", "哪一年", "什么时间", "什么时候", "等级", "级别", "分类", "分为", "划分")
COMPARISON_CUES = ("区别", "对比", "比较")
DEFINITION_CUES = ("什么是", "定义", "概念", "含义")
COMPOSITION_TEXT_CUES = ("组成", "构成", "元素", "部件", "部分")
PROCESS_TEXT_CUES = ("流程", "过程", "步骤", "阶段", "P1-", "D1-", "C1-")
#: (needed words, one of, terms to add); matched on the upper-cased query
REWRITE_RULES = (
    (("网络安全法",), ("什么时候", "何时", "时间", "日期", "哪天", "开始", "实施", "施行", "生效"), ("实施", "施行", "生效", "实施时间", "实施日期", "网络运行安全")),
    ((), ("CRL", "撤销"), ("证书撤销列表", "证书库", "已撤销证书")),
    ((), ("BIA", "业务影响分析"), ("灾难恢复需求分析", "恢复目标", "关键业务功能")),
    (("EAL",), ("划分", "评估保证级"), ("EAL1", "EAL2", "EAL3", "EAL4", "EAL5", "EAL6", "EAL7", "保护轮廓", "安全目标")),
)
PARTICLES = "的了是在和与及对为把"
NUMERALS = ("十", "一", "二", "三", "四", "五", "六", "七", "八", "九")

ACRONYM = "[A-Za-z][A-Za-z0-9+-]+"
VERSION = r"[Vv]?\d+(?:\.\d+)+"
RUN = "[a-z0-9]+|[一-鿿]+"
# Sentences, and lines that are bullets, headings, closed sentences or page numbers.
SENTENCES = r"[^。！？!?；;\n]+[。！？!?；;\n]?"
BULLET_LINE = r"^(?:[•·●○◆◇■□▪▫—-]|\d+(?:\.\d+)*[、.．)]|[（(][一二三四五六七八九十0-9]+[）)]|[一二三四五六七八九十]+、)"
HEADING_LINE = r"^(?:第[一二三四五六七八九十0-9]+[章节部分]|\d+(?:\.\d+){1,3}\s*\S)"
CLOSED_LINE = "[。！？!?；;：:]$"
PAGE_LINE = r"^(?:[-—–]\s*)?(?:第\s*)?\d{1,4}(?:\s*页)?(?:\s*[-—–])?$"
SPACES = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def any_of(c: Column, cues: Sequence[str]) -> Column:
    """Whether the text holds one of the cues."""
    return c.rlike("|".join(cues))


def strip(c: Column) -> Column:
    """The text without blanks of any kind at both ends."""
    return F.regexp_replace(c, f"^{SPACES}+|{SPACES}+$", "")


def clean_text(c: Column) -> Column:
    """Runs of blanks become one space, three or more line ends two; no blanks at both ends."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t\x{3000}]+", " "), r"\n{3,}", "\n\n"))


def version_of(c: Column) -> Column:
    """The version in a source name, empty without one."""
    return F.regexp_extract(c, VERSION, 0)


def match_form(c: Column) -> Column:
    """The text without blanks and the punctuation that differs between printings."""
    return F.regexp_replace(c, SPACES + r"|[，。：:；;、（）().,．]", "")


def content_key(c: Column) -> Column:
    """Lower case, letters, digits and underscores only: equal keys are equal contents."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", "")


def compact(c: Column) -> Column:
    """Lower case, Chinese characters, ASCII letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^一-鿿A-Za-z0-9]", "")


def acronyms(c: Column) -> Column:
    """The distinct acronyms of a text, in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(ACRONYM), F.lit(0)))


def written_out(c: Column) -> Column:
    """The beginnings (five characters) of names of seven or more that stand beside an acronym of the text.

    A name is a Chinese run in the ten characters before and the ten behind an acronym, taken together; particles in front
    don't count. Names are looked for in titles, where only their beginning has to be found.
    """
    # what stands before an acronym stands behind it in the reversed text
    behind = F.regexp_extract_all(c, F.lit(ACRONYM + "(?=(.{0,10}))"), F.lit(1))
    before = F.reverse(F.regexp_extract_all(F.reverse(c), F.lit("[A-Za-z0-9+-]+[A-Za-z](?=(.{0,10}))"), F.lit(1)))
    beside = F.zip_with(before, behind, lambda a, b: F.concat(F.coalesce(F.reverse(a), F.lit("")), F.coalesce(b, F.lit(""))))
    names = F.transform(F.flatten(F.transform(beside, lambda w: F.regexp_extract_all(w, F.lit("[一-鿿]{4,}"), F.lit(0)))), lambda n: F.regexp_replace(n, f"^[{PARTICLES}]+", ""))
    return F.array_distinct(F.transform(F.filter(names, lambda n: F.length(n) >= 7), lambda n: F.left(n, F.lit(5))))


def level_numbers(c: Column) -> Column:
    """Chinese ordinal numbers before 级 as digits: 第三级 and 三级 become 3级, 十五级 15级, 二十级 20级, 三十二级 32级. Other runs of
    numerals lose their 第 only. Texts without 级 are left alone before any pattern runs."""
    ones, run = "".join(NUMERALS[1:]), f"(?<![{''.join(NUMERALS)}])"
    told = F.regexp_replace(c, f"第(?=[{''.join(NUMERALS)}]+级)", "")
    # tens first: a mark keeps the place of the ten between two digits
    told = F.regexp_replace(told, f"{run}十(?=[{ones}]级)", "1")
    told = F.regexp_replace(told, f"{run}([{ones}])十(?=级)", "$10")
    told = F.regexp_replace(told, f"{run}([{ones}])十(?=[{ones}]级)", "$1\u0001")
    told = F.regexp_replace(told, f"{run}十(?=级)", "10")
    for n, word in enumerate(NUMERALS[1:], 1):
        told = F.regexp_replace(told, f"{run}{word}(?=(?:\u0001[{ones}0-9])?0?级)", str(n))
    return F.when(F.contains(c, F.lit("级")), F.replace(told, F.lit("\u0001"), F.lit(""))).otherwise(c)


def runs(c: Column) -> Column:
    """Latin words and unbroken Chinese runs, lower case, levels as digits."""
    return F.regexp_extract_all(level_numbers(F.lower(c)), F.lit(RUN), F.lit(0))


def bigrams(run: Column) -> Column:
    """The overlapping pairs of characters of one run."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))


def tokens(c: Column) -> Column:
    """Search tokens: Latin words and numbers whole, Chinese runs as overlapping pairs, without stop words.

    There is no dictionary segmentation here; any expression giving an array of text can take its place.
    """
    cut = F.flatten(F.transform(runs(c), lambda r: F.when(r.rlike("^[a-z0-9]"), F.array(r)).otherwise(bigrams(r))))
    return F.filter(cut, lambda t: ~t.isin(*STOPWORDS))


def word_tokens(c: Column) -> Column:
    """Latin words and whole Chinese runs, without stop words."""
    return F.filter(runs(c), lambda t: ~t.isin(*STOPWORDS))


def with_bigrams(words: Column) -> Column:
    """Tokens of the mixed index: the words and the character pairs of the Chinese ones."""
    long = F.filter(words, lambda w: w.rlike("^[一-鿿]{2,}$"))
    return F.concat(words, F.flatten(F.transform(long, bigrams)))


def rewritten(c: Column) -> Column:
    """The query with the terms of every rule that applies, but those it already has."""
    query, upper = strip(c), F.upper(c)
    have = F.regexp_extract_all(F.lower(query), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    added = [F.when(F.lit(True) if not all_ else F.forall(F.array(*[F.lit(w) for w in all_]), lambda w: F.contains(upper, w)), F.when(any_of(upper, one), F.array(*[F.lit(t) for t in terms]))) for all_, one, terms in REWRITE_RULES]
    none = F.array().cast("array<string>")
    extra = F.filter(F.concat(*[F.coalesce(a, none) for a in added]), lambda t: ~F.array_contains(have, F.lower(t)))
    return F.concat_ws(" ", query, extra)


def query_intent(c: Column) -> Column:
    """The kind of a question; the first kind whose cues it holds."""
    return (
        F.when(any_of(c, PROCESS_CUES), "process")
        .when(c.rlike(ACRONYM), "acronym")
        .when(any_of(c, FACT_CUES) | c.rlike(r"\d|第[一二三四五六七八九十]+"), "fact")
        .when(any_of(c, COMPARISON_CUES), "comparison")
        .when(any_of(c, DEFINITION_CUES), "definition")
        .otherwise("other")
    )


def learned_ranking_applies(query: Column, kinds: str | None) -> Column:
    """Whether a comma-separated list of kinds, ``all`` or nothing (empty, none, false, 0) covers the query."""
    told = (kinds or "").strip().lower()
    if told in ("", "none", "false", "0"):
        return F.lit(False)
    return F.lit(True) if told == "all" else query_intent(query).isin(*[k.strip() for k in told.split(",") if k.strip()])


def choice_letters(c: Column) -> Column:
    """The letters A-D of an answer, sorted."""
    return F.array_join(F.array_sort(F.regexp_extract_all(F.upper(c), F.lit("[ABCD]"), F.lit(0))), "")


def line_kind(c: Column) -> Column:
    """page_number, bullet, sentence, title or text: a title has 24 characters at most, 45 where it is a heading."""
    line = strip(c)
    return (
        F.when(line.rlike(PAGE_LINE), "page_number")
        .when(line.rlike(BULLET_LINE), "bullet")
        .when(line.rlike(CLOSED_LINE), "sentence")
        .when((F.length(line) <= 24) | ((F.length(line) <= 45) & line.rlike(HEADING_LINE)), "title")
        .otherwise("text")
    )


def stable_id(prefix: str, *parts: Column) -> Column:
    """Equal content gives an equal id."""
    joined = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.left(F.sha2(joined, 256), F.lit(20)))


def embedding_text(domain: Column, title: Column, text: Column) -> Column:
    """Topic, title (where there is one) and text, a line each."""
    named = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("知识点："), title))
    return F.concat_ws("\n", F.concat(F.lit("知识域："), F.coalesce(domain, F.lit(""))), named, text)


def confidence_label(c: Column) -> Column:
    return F.when(c.isNull(), "—").when(c < 0.5, "low").when(c < 0.8, "medium").otherwise("high")


def clean_cell(c: Column) -> Column:
    """A table cell: private-use signs as bullets, no-break blanks as blanks; Chinese cells lose blanks, others fold them."""
    told = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x{E000}-\x{F8FF}]", "•"), " ", " ")
    return strip(F.when(told.rlike("[一-鿿]"), F.regexp_replace(told, SPACES + "+", "")).otherwise(F.regexp_replace(told, SPACES + "+", " ")))


def markdown_table(rows: Column) -> Column:
    """An array of rows of cells as a Markdown table; short rows are filled up."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    filled = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
    return F.array_join(F.concat(F.slice(filled, 1, 1), F.array(rule), F.slice(filled, F.lit(2), F.greatest(F.size(filled) - 1, F.lit(0)))), "\n")
