"""Pieces of SQL that several reference statements share."""

from __future__ import annotations

from collections.abc import Sequence

from mulberry.functions import text as T

SPACES = T.SPACES
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def any_of(c: str, cues: Sequence[str]) -> str:
    return f"regexp_matches({c}, '{'|'.join(cues)}')"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACES}+|{SPACES}+$', '', 'g')"


def words_hit(c: str, words: Sequence[str]) -> str:
    return "(" + " + ".join(f"contains({c}, '{w.lower()}')::INT" for w in words) + ")"


_NUM = "一二三四五六七八九"


def LEVEL(piece: str) -> str:
    """A run of Chinese numerals before 级 with digits for the numerals, by its places."""
    n = f"regexp_replace({piece}, '^第|级$', '', 'g')"
    digit = lambda x: f"instr('{_NUM}', {x})::VARCHAR"
    left, right = f"string_split({n}, '十')[1]", f"string_split({n}, '十')[2]"
    return (
        f"(CASE WHEN {n} = '十' THEN '10' WHEN length({n}) = 1 THEN {digit(n)} "
        f"WHEN regexp_full_match({n}, '[{_NUM}]?十[{_NUM}]?') THEN (CASE WHEN {left} = '' THEN '1' ELSE {digit(left)} END) || (CASE WHEN {right} = '' THEN '0' ELSE {digit(right)} END) ELSE {n} END || '级')"
    )


def LEVELS(c: str) -> str:
    """A text, cut into levels and single characters, with its levels as digits."""
    cut = f"regexp_extract_all({c}, '第?[{_NUM}十]+级|[^级第{_NUM}十]+|.')"
    return f"CASE WHEN contains({c}, '级') THEN array_to_string(list_transform({cut}, lambda p: CASE WHEN regexp_full_match(p, '第?[{_NUM}十]+级') THEN {LEVEL('p')} ELSE p END), '') ELSE {c} END"


def RUNS(c: str) -> str:
    return f"regexp_extract_all({LEVELS(f"lower(coalesce({c}, ''))")}, '{T.RUN}')"


def TOKENS(c: str) -> str:
    pairs = "list_transform(range(1, length(r)), lambda i: substr(r, i, 2))"
    return f"list_filter(flatten(list_transform({RUNS(c)}, lambda r: CASE WHEN regexp_matches(r, '^[a-z0-9]') OR length(r) = 1 THEN [r] ELSE {pairs} END)), lambda t: t NOT IN ({_STOP}))"


def WORDS(c: str) -> str:
    return f"list_filter({RUNS(c)}, lambda t: t NOT IN ({_STOP}))"


def CHOICE(c: str) -> str:
    return f"array_to_string(list_sort(regexp_extract_all(upper(coalesce({c}, '')), '[ABCD]')), '')"


INTENT = (
    f"CASE WHEN {any_of('question', T.PROCESS_CUES)} THEN 'process' WHEN regexp_matches(question, '{T.ACRONYM}') THEN 'acronym' "
    f"WHEN {any_of('question', T.FACT_CUES)} OR regexp_matches(question, '[0-9]|第[一二三四五六七八九十]+') THEN 'fact' WHEN {any_of('question', T.COMPARISON_CUES)} THEN 'comparison' "
    f"WHEN {any_of('question', T.DEFINITION_CUES)} THEN 'definition' ELSE 'other' END"
)
_WORD = "[\\p{L}\\p{N}_]+".replace("{", "{{").replace("}", "}}")
_ADDED = " || ".join(
    f"CASE WHEN {' AND '.join([*[f'contains(upper({{q}}), {chr(39)}{w}{chr(39)})' for w in need], any_of('upper({q})', one)])} THEN [{', '.join(chr(39) + t + chr(39) for t in terms)}] ELSE []::VARCHAR[] END" for need, one, terms in T.REWRITE_RULES
)
_SPACE = SPACES.replace("{", "{{").replace("}", "}}")
#: The rewritten form of the column ``q`` (to be filled in).
REWRITTEN = (
    f"array_to_string([regexp_replace({{q}}, '^{_SPACE}+|{_SPACE}+$', '', 'g')] || list_filter({_ADDED}, lambda t: NOT list_contains(regexp_extract_all(lower(regexp_replace({{q}}, '^{_SPACE}+|{_SPACE}+$', '', 'g')), '{_WORD}'), lower(t))), ' ')"
)
