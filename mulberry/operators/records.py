"""Delivered records: read every column as text, test it by rules, split valid rows from failures.

All of it is built-in column expressions, so it stays in the JVM, needs no shuffle and is linear in the
length of a record. The record text is cut at its double quotes: pieces at even positions lie outside a
quoted field, pieces at odd positions inside. Quoting is right exactly if the pieces outside touch each
quote with a comma, the start or the end of the record, or are empty between two quotes (a doubled quote).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns of a delivered record, in order, and the reasons in the order they are tested.
RECORD_COLUMNS = ("id", "source", "num", "stem", "options", "answer", "analysis", "domain", "needs_review", "dup_of", "created_at")
REASONS = ("quoting", "column_count", "bad_options", "bad_answer", "bad_needs_review")

BLANK = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_SEP, _ESC = "\x01", "\x02"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_blank(c: Column) -> Column:
    """The text without blanks of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(c, f"^{BLANK}++", ""), f"(?<!{BLANK}){BLANK}++$", "")


def quoting_ok(pieces: Column) -> Column:
    """Whether a record cut at its double quotes is well quoted (RFC 4180); pieces: array of text."""
    last = F.size(pieces) - 1
    wrong = F.transform(pieces, lambda p, i: (i % 2 == 0) & (p != "") & (((i > 0) & ~p.startswith(",")) | ((i < last) & ~p.endswith(","))))
    return (last % 2 == 0) & ~F.array_contains(wrong, True)


def fields_of(pieces: Column) -> Column:
    """The fields of a well quoted record as an array of unquoted text."""
    last = F.size(pieces) - 1
    shielded = F.transform(
        pieces,
        lambda p, i: F.when(i % 2 == 1, p).when((p == "") & (i > 0) & (i < last), F.lit('"')).otherwise(F.replace(p, F.lit(","), F.lit(_SEP))),
    )
    cut = F.split(F.array_join(shielded, ""), _SEP, -1)
    return F.transform(cut, lambda f: F.replace(F.replace(f, F.lit(_ESC + "1"), F.lit(_SEP)), F.lit(_ESC + "2"), F.lit(_ESC)))


def option_keys(options: Column) -> Column:
    """The keys of a strict JSON object with two or more entries, keys single letters A-F and values
    that are non-blank strings; null for anything else (null, other JSON, lenient JSON, repeated keys)."""
    ws = r"[ \t\r\n]*+"
    value = r'"[^"\\\x00-\x1f]*+"'
    entry = f'"([A-F])"{ws}:{ws}({value})'
    shape = r"^" + ws + r"\{(?:" + ws + entry + ws + r"(?:,(?=[ \t\r\n]*\")|(?=\})))++\}" + ws + "$"
    # escapes become plain characters first, so that a string is a quote, no quote or backslash, a quote
    plain = F.regexp_replace(options, r'\\(?:["\\/bf]|u(?!0009|000[aAdD]|0020|00[aA]0|3000)[0-9a-fA-F]{4})', "x")
    plain = F.regexp_replace(plain, r"\\(?:[nrt]|u[0-9a-fA-F]{4})", " ")

    def keys(p: Column) -> Column:
        blank = F.exists(F.regexp_extract_all(p, F.lit(entry), F.lit(2)), lambda v: v.rlike(f'^"{BLANK}*+"$'))
        return let(
            F.regexp_extract_all(p, F.lit(entry), F.lit(1)),
            lambda k: F.when(p.rlike(shape) & (F.size(k) >= 2) & (F.size(F.array_distinct(k)) == F.size(k)) & ~blank, k),
        )

    return let(plain, keys)


def answer_ok(answer: Column, keys: Column) -> Column:
    """Empty, or one to four different ASCII letters (any case, blanks at both ends) that are all keys."""

    def told_ok(told: Column) -> Column:
        letters = F.split(told, "")
        return (told == "") | (told.rlike("^[A-F]{1,4}$") & (F.size(F.array_distinct(letters)) == F.length(told)) & (F.size(F.array_except(letters, keys)) == 0))

    return let(F.upper(trim_blank(answer)), told_ok)


def record_errors(fields: Column, keys: Column) -> Column:
    """Every reason that applies to a record of the right shape; keys: see option_keys."""
    none = F.array().cast("array<string>")
    failed = {
        "bad_options": keys.isNull(),
        "bad_answer": ~answer_ok(fields["answer"], F.coalesce(keys, none)),
        "bad_needs_review": ~F.lower(fields["needs_review"]).isin("true", "false", "1", "0"),
    }
    return F.filter(F.array(*[F.when(failed[r], F.lit(r)) for r in REASONS if r in failed]), lambda r: r.isNotNull())


def read_record(line: Column, columns: Sequence[str] = RECORD_COLUMNS) -> Column:
    """A struct of ``fields`` (struct of nullable text; null if the record has no such shape) and ``errors``
    (array of every reason that applies, in the order of REASONS; empty for a valid record).

    A null or empty line has the wrong column count.
    """
    text = F.coalesce(line, F.lit(""))
    shielded = F.replace(F.replace(text, F.lit(_ESC), F.lit(_ESC + "2")), F.lit(_SEP), F.lit(_ESC + "1"))
    struct_of = lambda cut: F.struct(*[F.get(cut, F.lit(i)).alias(c) for i, c in enumerate(columns)])
    no_fields = F.lit(None).cast("struct<" + ",".join(f"{c}:string" for c in columns) + ">")
    whole = lambda fields, errors: F.struct(fields.alias("fields"), errors.alias("errors"))
    tested = lambda fields: let(option_keys(fields["options"]), lambda keys: whole(fields, record_errors(fields, keys)))
    counted = lambda cut: F.when(F.size(cut) == len(columns), let(struct_of(cut), tested)).otherwise(whole(no_fields, F.array(F.lit("column_count"))))
    return let(
        F.split(shielded, '"', -1),
        lambda pieces: F.when(quoting_ok(pieces), let(fields_of(pieces), counted)).otherwise(whole(no_fields, F.array(F.lit("quoting")))),
    )


def rejected_records(df: DataFrame, key: str = "raw_id", line: str = "line") -> DataFrame:
    """``key``, ``reason`` (the first that applies) and ``errors`` (all of them) of every failed record.

    Repeated records are all kept; a null key stays null; an empty table gives an empty result; further
    columns of ``df`` are not looked at. inline() evaluates the record once and then drops the valid ones.
    """
    failed = F.filter(F.array(read_record(F.col(line))), lambda r: F.size(r["errors"]) > 0)
    return df.select(F.col(key), F.inline(failed)).select(key, F.col("errors")[0].alias("reason"), "errors")


def valid_records(df: DataFrame, line: str = "line") -> DataFrame:
    """The valid records as typed rows of the question bank. ``num`` and ``created_at`` that don't cast are null;
    an empty analysis stays empty, an empty domain, dup_of or answer too (the bank tells '' from null)."""
    good = F.filter(F.array(read_record(F.col(line))), lambda r: F.size(r["errors"]) == 0)
    f = lambda c: F.col(f"fields.{c}")
    return df.select(F.inline(good)).select(
        f("id").alias("id"),
        f("source").alias("source"),
        trim_blank(f("num")).try_cast("int").alias("num"),
        *[f(c).alias(c) for c in ("stem", "options", "answer", "analysis", "domain")],
        F.lower(f("needs_review")).isin("true", "1").alias("needs_review"),
        f("dup_of").alias("dup_of"),
        F.try_to_timestamp(trim_blank(f("created_at"))).cast("timestamp_ntz").alias("created_at"),
    )


def rejection_report(df: DataFrame, key: str = "raw_id", line: str = "line") -> DataFrame:
    """Number of failed records for each first reason."""
    return rejected_records(df, key, line).groupBy("reason").agg(F.count(F.lit(1)).alias("records"))
