"""Queries of this subpackage, each over whole tables with production parameters, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mulberry.llm import lookalikes, near_duplicates, packing, splitting, subjects, survivorship, tokenization, truncation
from mulberry.plans.sql import SPACES, strip
from mulberry.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _on(name: str, operator: Callable[..., DataFrame]) -> Query:
    return lambda spark, d: operator(table(spark, d, name))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.version_groups(table(spark, d, "questions")).select("id", "group_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    questions = table(spark, d, "questions")
    return subjects.subject_areas(questions, subjects.fit_subjects(questions, table(spark, d, "kb_chunks"), table(spark, d, "topics")))


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_shares(table(spark, d, "questions"), p5_found(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return survivorship.field_sources(table(spark, d, "questions"), table(spark, d, "publishers"))


def p6_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivorship.survivors(table(spark, d, "questions"), table(spark, d, "publishers"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(tokenization.token_counts(table(spark, d, "documents")))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, d))


QUERIES: dict[str, Query] = {
    "p2_found": _on("questions", near_duplicates.version_pairs),
    "p2_groups": p2_groups,
    "p3_found": _on("questions", lookalikes.lookalike_pairs),
    "p3_forms": _on("questions", lookalikes.folded_questions),
    "p4_found": _on("kb_chunks", splitting.oversized),
    "p4_pieces": _on("kb_chunks", splitting.pieces),
    "p5_found": p5_found,
    "p5_shares": p5_shares,
    "p6_found": p6_found,
    "p6_survivors": p6_survivors,
    "p7_ids": _on("documents", tokenization.token_ids),
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p9_found": _on("documents", truncation.truncated),
    "p9_shares": _on("documents", truncation.truncation_shares),
    "p9_steps": _on("documents", truncation.deciding_steps),
}

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
_narrow = lambda c: f"translate({c}, '{_WIDE}', '{_NARROW}')"
_STAND_INS = ", ".join(f"'{w}'" for w in survivorship.STAND_INS)
_P6 = f"""
WITH RECURSIVE p AS (SELECT id, {strip('dup_of')} AS next FROM questions WHERE {strip('dup_of')} <> ''),
w(id, node, path) AS (SELECT id, next, [id] FROM p UNION ALL SELECT w.id, p.next, list_append(path, node) FROM w JOIN p ON p.id = w.node WHERE NOT list_contains(path, node)),
e AS (SELECT id, CASE WHEN list_contains(path, node) THEN list_min(list_slice(path, list_position(path, node), len(path))) ELSE node END AS root FROM w WHERE list_contains(path, node) OR node NOT IN (SELECT id FROM p)),
t AS (SELECT id, root FROM e UNION ALL SELECT DISTINCT root, root FROM e WHERE root NOT IN (SELECT id FROM p)),
m AS (SELECT t.root AS group_id, q.*, coalesce(b.trust, -1) AS trust, regexp_replace(upper({_narrow('answer')}), '(?:{SPACES}|{survivorship.ANSWER_SEPARATORS})+', '', 'g') AS a, {strip('analysis')} AS n,
        lower(regexp_replace({_narrow('analysis')}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS v, list_transform(json_keys(options), lambda k: upper(k)) AS k, count(*) OVER (PARTITION BY t.root) AS members
      FROM t JOIN questions q USING (id) LEFT JOIN publishers b ON b.publisher = string_split(q.source, '_')[1]),
r AS (SELECT group_id, 'answer' AS field, id, row_number() OVER (PARTITION BY group_id ORDER BY coalesce(needs_review, true), trust DESC, created_at DESC NULLS LAST, id) AS i FROM m
      WHERE members > 1 AND regexp_full_match(a, '[A-Z]+') AND len(list_distinct(string_split(a, ''))) = length(a) AND len(list_filter(string_split(a, ''), lambda x: NOT list_contains(k, x))) = 0
      UNION ALL SELECT group_id, 'analysis', id, row_number() OVER (PARTITION BY group_id ORDER BY coalesce(needs_review, true), length(n) DESC, trust DESC, created_at DESC NULLS LAST, id) FROM m
      WHERE members > 1 AND v <> '' AND v NOT IN ({_STAND_INS}))
SELECT group_id, field, id FROM r WHERE i = 1
"""

_RANKED, _PICKED = _P6.split("r AS (")
_SURVIVORS = (
    _RANKED + "r AS (" + _PICKED.replace("SELECT group_id, 'answer' AS field, id,", "SELECT group_id, 'answer' AS field, id, a AS told,").replace("SELECT group_id, 'analysis', id,", "SELECT group_id, 'analysis', id, n,").rsplit("SELECT", 1)[0]
    + "SELECT g.group_id, g.members, x.told AS answer, x.id AS answer_from, y.told AS analysis, y.id AS analysis_from FROM (SELECT DISTINCT group_id, members FROM m WHERE members > 1) g LEFT JOIN r x ON x.group_id = g.group_id AND x.i = 1 AND x.field = 'answer' LEFT JOIN r y ON y.group_id = g.group_id AND y.i = 1 AND y.field = 'analysis'"
)

SQL: dict[str, str] = {
    "p6_survivors": _SURVIVORS,
    "p4_found": "SELECT id FROM kb_chunks WHERE length(text) > 1200",
    "p6_found": _P6,
}
