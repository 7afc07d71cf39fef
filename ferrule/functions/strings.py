"""String, token and number functions of the record tools, as native columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def words(c: Column, sep: str | None = None) -> Column:
    """Tokens of ``c``: runs of non-blanks, or the fields between single ``sep``, empty ones too."""
    if sep is None:
        return F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return F.split(c, f"\\Q{sep}\\E", -1)


def nwords(c: Column, sep: str | None = None) -> Column:
    return F.size(words(c, sep))


def word(c: Column, i: int, sep: str | None = None) -> Column:
    """Token ``i`` from 0, or from the end if negative; null if there is none."""
    return F.try_element_at(words(c, sep), F.lit(i + 1 if i >= 0 else i))


def remove_word(c: Column, i: int, sep: str = " ") -> Column:
    w = words(c, sep)
    at = F.lit(i) if i >= 0 else F.size(w) + i
    return F.array_join(F.filter(w, lambda x, k: k != at), sep)


def ccount(c: Column, char: str) -> Column:
    """How often one character occurs."""
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def before(c: Column, char: str) -> Column:
    """What stands before the first ``char``; empty if it does not occur."""
    return F.when(F.instr(c, char) > 0, F.substring_index(c, char, 1)).otherwise(F.lit(""))


def after(c: Column, char: str) -> Column:
    """What follows the first ``char``; empty if it does not occur."""
    at = F.instr(c, char)
    return F.when(at > 0, F.substring(c, at + len(char), F.length(c))).otherwise(F.lit(""))


def from_to(c: Column, start: int, stop: int) -> Column:
    """Characters ``start`` to ``stop``, both included, from 0."""
    return F.substring(c, start + 1, stop - start + 1)


def truncate_at_first(c: Column, char: str) -> Column:
    return F.substring_index(c, char, 1)


def truncate_at_last(c: Column, char: str) -> Column:
    """Without the last ``char`` and what follows it; unchanged if it does not occur."""
    tail = F.length(F.substring_index(c, char, -1)) + len(char)
    return F.when(F.instr(c, char) > 0, F.substring(c, F.lit(1), F.length(c) - tail)).otherwise(c)


def chop(c: Column, n: int = 1) -> Column:
    return F.substring(c, F.lit(1), F.greatest(F.length(c) - n, F.lit(0)))


def remove_leading(c: Column, char: str) -> Column:
    return F.ltrim(c, F.lit(char))


def remove_up_to_first(c: Column, char: str) -> Column:
    return F.when(F.instr(c, char) > 0, after(c, char)).otherwise(c)


def remove_suffix(c: Column) -> Column:
    return F.regexp_replace(c, r"\.[^./]*$", "")


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def gsub(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def remove_chars(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def compress_blanks(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def matches_ignore_case(a: Column, b: Column | str) -> Column:
    return F.lower(a) == F.lower(F.lit(b) if isinstance(b, str) else b)


def numeric_value(c: Column, kind: str = "double") -> Column:
    """The number that a cell spells; null where it spells none."""
    return c.try_cast(kind)


def strip_leading_zeros(c: Column) -> Column:
    """Without leading zeros; a cell of zeros keeps one."""
    return F.regexp_replace(c, r"^0+(?=.)", "")


def unhtml(c: Column) -> Column:
    """Markup removed and the five basic character references decoded."""
    c = F.regexp_replace(c, r"<[^>]*>", "")
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = gsub(c, ref, char)
    return c


def valid_descriptor_name(c: Column) -> Column:
    """A name with every character but letters, digits and ``_.-`` turned into an underscore."""
    return F.regexp_replace(c, r"[^A-Za-z0-9_.\-]", "_")


def ndigits(c: Column) -> Column:
    """Decimal digits of an integer."""
    return F.length(F.abs(c).cast("string"))
