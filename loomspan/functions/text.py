"""Text functions of the reports, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that never count as forbidden, and type names that always do.
STOP_TERMS = (
    "the and for with from this that your you are can has have value values query user schema description required optional"
).split()
TYPE_WORDS = "string integer float number boolean dict array object list".split()
FORMAT_WORDS = r"(?i)\b(format|iso|yyyy|hh:mm|date|time|enum)\b"


def token_count(text: Column) -> Column:
    """Words and single marks, by Unicode's idea of a word."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0))).cast("long")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).cast("long")


def meaningful_terms(text: Column) -> Column:
    """Distinct lower-cased identifiers of three characters or more."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9_./:-]*"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(found, lambda w: F.length(w) >= 3), F.lower))


def identifier_terms(text: Column) -> Column:
    """Meaningful terms and their pieces of three characters or more."""
    terms = meaningful_terms(text)
    pieces = F.flatten(F.transform(terms, lambda w: F.split(w, r"[^A-Za-z0-9]+|_")))
    return F.array_distinct(F.concat(terms, F.filter(pieces, lambda w: F.length(w) >= 3)))


def forbidden_terms(*terms: Column) -> Column:
    return F.array_except(F.array_distinct(F.concat(*terms, F.array(*map(F.lit, TYPE_WORDS)))), F.array(*map(F.lit, STOP_TERMS)))


def leaks_term(text: Column, terms: Column) -> Column:
    """Whether a term stands in the text as a whole word."""
    whole = lambda w: F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), w, F.lit(r"\E(?![A-Za-z0-9_])"))
    return F.exists(terms, lambda w: F.rlike(F.lower(text), whole(F.lower(w))))


def needs_format(text: Column) -> Column:
    return text.rlike(FORMAT_WORDS)


def shown_values(values: Column) -> Column:
    """Accepted values without blanks, unless all are blank."""
    plain = F.filter(values, lambda v: v != "")
    return F.when(F.size(plain) == 0, values).otherwise(plain)


def first_concrete(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v != ""), F.lit(0))


def repr_text(text: Column) -> Column:
    """A quoted string: single quotes, or double ones if it holds single quotes only."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(single)


def fixed4(value: Column) -> Column:
    return F.when(value.isNull(), "NA").otherwise(F.format_string("%.4f", value))


def stable_name(path: Column, tag: str = "_seed20260703") -> Column:
    """A result's name: its file's name without the suffix and the seed's tag."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.replace(F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", ""), F.lit(tag), F.lit(""))


def safe_suffix(value: Column) -> Column:
    """A value as the end of a file's name: other characters than letters, digits, ``_.-`` become ``_``; unknown if none is left."""
    clean = F.btrim(F.regexp_replace(value.cast("string"), r"[^A-Za-z0-9_.-]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("unknown"))


def coarse_family(name: Column) -> Column:
    """A function's family: what stands before ``_<number>_``, before the first dot, or before the first underscore."""
    numbered = F.regexp_extract(name, r"^([^_]+)_\d+_", 1)
    return F.when(numbered != "", numbered).when(F.contains(name, F.lit(".")), F.substring_index(name, ".", 1)).otherwise(F.substring_index(name, "_", 1))


def category_of_id(name: Column, recorded: Column, prefixes: dict[str, str]) -> Column:
    """An episode's category: what is recorded, else that of the first prefix that its id has, else the id up to its first underscore."""
    rules = [F.when(F.startswith(name, F.lit(p)), F.lit(c)) for p, c in prefixes.items()]
    return F.coalesce(recorded, *rules, F.substring_index(name, "_", 1))
