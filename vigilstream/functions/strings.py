"""General text, list and XML helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_empty(c: Column) -> Column:
    return c.isNull() | (c == "")


def has_length(c: Column) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def has_text(c: Column) -> Column:
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))


def contains_whitespace(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\s"), F.lit(False))


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, r"\s", "")


def trim_leading(c: Column, char: str | None = None) -> Column:
    return F.ltrim(c, F.lit(char)) if char else F.regexp_replace(c, r"^\s+", "")


def trim_trailing(c: Column, char: str | None = None) -> Column:
    return F.rtrim(c, F.lit(char)) if char else F.regexp_replace(c, r"\s+$", "")


def starts_with_ignore_case(c: Column, prefix: str) -> Column:
    return F.lower(c).startswith(prefix.lower())


def ends_with_ignore_case(c: Column, suffix: str) -> Column:
    return F.lower(c).endswith(suffix.lower())


def substring_match(c: Column, index: int, part: str) -> Column:
    return F.substring(c, index + 1, len(part)) == part


def count_occurrences(c: Column, part: str) -> Column:
    """How often the part stands in the text, without overlaps; 0 for an empty part."""
    if not part:
        return F.lit(0)
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


def delete(c: Column, part: str) -> Column:
    return F.replace(c, F.lit(part), F.lit(""))


def delete_any(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def quote(c: Column) -> Column:
    return F.concat(F.lit("'"), c, F.lit("'"))


def unqualify(c: Column, separator: str = ".") -> Column:
    return F.substring_index(c, separator, -1)


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def uncapitalize(c: Column) -> Column:
    return F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def filename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def filename_extension(c: Column) -> Column:
    return F.nullif(F.regexp_extract(filename(c), r"\.([^.]*)$", 1), F.lit(""))


def strip_filename_extension(c: Column) -> Column:
    return F.regexp_replace(c, r"\.[^./]*$", "")


def relative_path(path: Column, relative: Column) -> Column:
    return F.concat(F.regexp_extract(path, "^(.*/)?", 0), relative)


def tokens(c: Column, delimiters: str) -> Column:
    """Parts between any of the delimiters, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, f"[{delimiters}]"), F.trim), lambda x: x != "")


def delimited(c: Column, delimiter: str = ",") -> Column:
    return F.split(c, r"\Q" + delimiter + r"\E")


def delimited_set(c: Column, delimiter: str = ",") -> Column:
    return F.array_sort(F.array_distinct(delimited(c, delimiter)))


def joined(c: Column, delimiter: str = ",") -> Column:
    return F.array_join(c, delimiter)


def properties(c: Column, delimiter: str = "=") -> Column:
    """A map of ``key=value`` elements."""
    return F.map_from_entries(F.transform(c, lambda x: F.struct(F.trim(F.substring_index(x, delimiter, 1)), F.trim(F.substring_index(x, delimiter, -1)))))


def merged(a: Column, b: Column) -> Column:
    return F.array_union(a, b)


def find_first_match(a: Column, b: Column) -> Column:
    return F.get(F.array_intersect(a, b), F.lit(0))


def has_unique(c: Column) -> Column:
    return F.size(F.array_distinct(c)) == 1


def null_safe_equals(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def display(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def xpath_string(c: Column, path: str) -> Column:
    return F.xpath_string(c, F.lit(path))


def xpath_number(c: Column, path: str) -> Column:
    return F.xpath_number(c, F.lit(path))
