"""Numbers, units, periods and folded letters out of report texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and what they fold to, letter by letter.
ACCENTED = "àáâãäåạảấầẩẫậắằẳẵặăèéêëẹẻẽếềểễệìíîïịỉĩòóôõöọỏốồổỗộớờởỡợơùúûüụủũứừửữựưỳýÿỵỷỹçñđ"
PLAIN = "aaaaaaaaaaaaaaaaaaaeeeeeeeeeeeeiiiiiiioooooooooooooooooouuuuuuuuuuuuuyyyyyycnd"
#: Unit names and their scale, the first that a text holds.
UNITS = ((1e6, "trieu (vnd|dong)|million (vnd|dong)"), (1e9, r"\b(ty (vnd|dong)|billion (vnd|dong))"), (1e3, "(nghin|ngan|thousand) (vnd|dong)"))


def fold_letters(x: Column) -> Column:
    return F.translate(F.lower(F.trim(x)), ACCENTED, PLAIN)


def sql_fold(x: str) -> str:
    return f"translate(lower(trim({x})), '{ACCENTED}', '{PLAIN}')"


def parse_number(raw: Column) -> Column:
    """A number with dots between thousands and a decimal comma; in brackets it is negative; else null."""
    x = F.trim(raw)
    negative = x.rlike(r"^\(.*\)$") | x.startswith("-")
    x = F.trim(F.regexp_replace(x, r"^\((.*)\)$|^-", "$1"))
    commas, dots = F.length(x) - F.length(F.replace(x, F.lit(","), F.lit(""))), F.length(x) - F.length(F.replace(x, F.lit("."), F.lit("")))
    bare = lambda c, y: F.replace(y, F.lit(c), F.lit(""))
    comma_point = F.replace(x, F.lit(","), F.lit("."))
    cleaned = (
        F.when((commas > 0) & (dots > 0), F.replace(bare(".", x), F.lit(","), F.lit(".")))
        .when(commas == 1, comma_point)
        .when(commas > 1, F.when(x.rlike(r"^[^,]*(,[0-9]{3})+$"), bare(",", x)))
        .when((dots > 1) | x.rlike(r"\.[^.]{3}$"), bare(".", x))
        .otherwise(x)
    )
    value = F.when(cleaned.rlike(r"^[0-9]+(\.[0-9]+)?$"), cleaned).try_cast("double")
    return F.when(value <= 1e16, F.when(negative, -value).otherwise(value))


def sql_parse_number(raw: str) -> str:
    x = rf"trim(regexp_replace(trim({raw}), '^\((.*)\)$|^-', '\1'))"
    commas, dots = f"(length({x}) - length(replace({x}, ',', '')))", f"(length({x}) - length(replace({x}, '.', '')))"
    cleaned = rf"""CASE WHEN {commas} > 0 AND {dots} > 0 THEN replace(replace({x}, '.', ''), ',', '.') WHEN {commas} = 1 THEN replace({x}, ',', '.')
      WHEN {commas} > 1 THEN CASE WHEN regexp_matches({x}, '^[^,]*(,[0-9]{{3}})+$') THEN replace({x}, ',', '') END WHEN {dots} > 1 OR regexp_matches({x}, '\.[^.]{{3}}$') THEN replace({x}, '.', '') ELSE {x} END"""
    value = rf"(CASE WHEN regexp_matches({cleaned}, '^[0-9]+(\.[0-9]+)?$') THEN CAST({cleaned} AS DOUBLE) END)"
    return f"(CASE WHEN {value} <= 1e16 THEN {value} * CASE WHEN trim({raw}) LIKE '(%)' OR trim({raw}) LIKE '-%' THEN -1 ELSE 1 END END)"


def unit_scale(x: Column) -> Column:
    folded = fold_letters(x)
    out = F.when(folded.rlike(UNITS[0][1]), UNITS[0][0])
    for scale, pattern in UNITS[1:]:
        out = out.when(folded.rlike(pattern), scale)
    return out.otherwise(1.0)


def fiscal_quarter(x: Column) -> Column:
    """The number after q or quarter, else null."""
    return F.regexp_extract(F.lower(x), r"\bq(?:uarter)?[ ._-]*([1-4])\b", 1).try_cast("int")


def fiscal_year(x: Column) -> Column:
    return F.regexp_extract(x, r"\b(19[0-9]{2}|20[0-9]{2})\b", 1).try_cast("int")


def normalized(x: Column) -> Column:
    """Lower-case letters and digits alone."""
    return F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "")


def count_of(text: Column, term: str) -> Column:
    """How often ``term`` occurs without overlap."""
    return (F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)
