"""Queries that prepare delivered records."""

from __future__ import annotations

from mulberry.operators import records
from mulberry.plans.sql import strip
from mulberry.sources.tables import table

QUERIES = {
    "p1_found": lambda spark, d: records.rejected_records(table(spark, d, "questions_raw", wide=True)).select("raw_id", "reason"),
    "p1_valid": lambda spark, d: records.valid_records(table(spark, d, "questions_raw", wide=True)),
    "p1_reasons": lambda spark, d: records.rejection_report(table(spark, d, "questions_raw", wide=True)),
}
_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_FOUND = f"""
WITH a AS (SELECT raw_id, coalesce(line, '') AS line FROM questions_raw),
b AS (SELECT raw_id, regexp_full_match(line, '{_FIELD}(?:,{_FIELD})*') AS ok,
             list_transform(regexp_extract_all(line || ',', '({_FIELD}),', 1), lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS f FROM a),
c AS (SELECT *, upper({strip('f[6]')}) AS told, CASE WHEN ok AND len(f) = 11 AND json_valid(f[5]) THEN CASE WHEN json_type(f[5]) = 'OBJECT' THEN json_keys(f[5]) END END AS k FROM b),
d AS (SELECT raw_id, CASE
        WHEN NOT ok THEN 'quoting'
        WHEN len(f) <> 11 THEN 'column_count'
        WHEN k IS NULL OR len(list_distinct(k)) < 2 OR len(list_distinct(k)) < len(k) OR len(list_filter(k, lambda x: NOT regexp_full_match(x, '[A-F]'))) > 0
             OR len(list_filter(k, lambda x: json_type(f[5], '$."' || x || '"') <> 'VARCHAR' OR {strip("json_extract_string(f[5], '$." + chr(34) + "' || x || '" + chr(34) + "')")} = '')) > 0 THEN 'bad_options'
        WHEN told <> '' AND NOT (regexp_full_match(told, '[A-F]{{1,4}}') AND len(list_distinct(string_split(told, ''))) = length(told) AND len(list_filter(string_split(told, ''), lambda x: NOT list_contains(k, x))) = 0) THEN 'bad_answer'
        WHEN lower(f[9]) NOT IN ('true', 'false', '1', '0') THEN 'bad_needs_review' END AS reason FROM c)
SELECT raw_id, reason FROM d WHERE reason IS NOT NULL
"""
_COLUMNS = f"""f[1] AS id, f[2] AS source, try_cast({strip('f[3]')} AS INT) AS num, f[4] AS stem, f[5] AS options, f[6] AS answer, f[7] AS analysis, f[8] AS domain, lower(f[9]) IN ('true', '1') AS needs_review, f[10] AS dup_of, try_cast({strip('f[11]')} AS TIMESTAMP) AS created_at"""
SQL: dict[str, str] = {
    "p1_found": _FOUND,
    "p1_valid": _FOUND.replace("SELECT raw_id, reason FROM d WHERE reason IS NOT NULL", f"SELECT {_COLUMNS} FROM b JOIN d USING (raw_id) WHERE reason IS NULL"),
    "p1_reasons": _FOUND.replace("SELECT raw_id, reason FROM d WHERE reason IS NOT NULL", "SELECT reason, count(*) AS records FROM d WHERE reason IS NOT NULL GROUP BY reason"),
}
