"""Filter expressions over descriptor columns and logical combinations of predicates, compiled to columns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F

_TERM = re.compile(r"\s*(!?)\s*([A-Za-z0-9_:.\-]+?)\s*(=~|==|!=|<=|>=|=|<|>|\.lt\.|\.le\.|\.gt\.|\.ge\.|\.eq\.|\.ne\.)\s*", re.I)
_WORDS = {".lt.": "<", ".le.": "<=", ".gt.": ">", ".ge.": ">=", ".eq.": "=", ".ne.": "!="}
_NEXT = re.compile(r"\s*(&&|\|\|)")


class ExpressionError(ValueError):
    """An expression that cannot be read, or a column it names that is absent."""


def _parse(text: str) -> list[list[tuple[bool, str, str, str]]]:
    """Alternatives of conjunctions of (negated, column, comparator, value)."""
    groups, at = [[]], 0
    while True:
        m = _TERM.match(text, at)
        if not m:
            raise ExpressionError(f"no condition at {text[at:]!r}")
        end = _NEXT.search(text, m.end())
        value = text[m.end() : end.start() if end else len(text)].strip()
        op = m[3].lower()
        groups[-1].append((bool(m[1]), m[2], _WORDS.get(op, "=" if op == "==" else op), value))
        if not end:
            return groups
        if end[1] == "||":
            groups.append([])
        at = end.end()


def compile_filter(text: str, columns: Iterable[str], missing_passes: bool = False, missing: str = ".", absent: str = "error") -> Column:
    """A boolean column for ``text``, such as ``a<4&&b.ge.2||c=~^x``.

    ``&&`` binds tighter than ``||``; a null, empty or ``missing`` cell gives
    ``missing_passes`` for its condition.  A cell that is no number raises when
    it is compared with one.  ``absent``: a column that does not exist is an
    error or ``fail``s its condition.
    """
    known = set(columns)

    def one(negated: bool, name: str, op: str, value: str) -> Column:
        if name not in known:
            if absent == "fail":
                return F.lit(False)
            raise ExpressionError(f"no column {name!r}")
        cell = F.col(f"`{name}`").cast("string")
        if op == "=~":
            test = cell.rlike(value)
        else:
            try:
                limit = F.lit(float(value))
            except ValueError:
                raise ExpressionError(f"{value!r} is no number") from None
            number = cell.cast("double")
            test = {"=": number == limit, "!=": number != limit, "<": number < limit, "<=": number <= limit, ">": number > limit, ">=": number >= limit}[op]
        test = ~test if negated else test
        blank = cell.isNull() | (F.trim(cell) == "") | (cell == missing)
        return F.when(blank, F.lit(missing_passes)).otherwise(test)

    result = None
    for group in _parse(text):
        both = None
        for term in group:
            c = one(*term)
            both = c if both is None else both & c
        result = both if result is None else result | both
    return result


def combine(terms: Sequence[Column], operators: str, negated: Sequence[bool] | None = None) -> Column:
    """Boolean ``terms`` joined by ``operators``, one character between each two.

    ``&`` binds tightest, then ``|`` and ``^``; ``;`` is an AND of lowest rank.
    ``^`` is exclusive in an expression of two terms and an OR in longer ones.
    Nulls count as false.
    """
    if len(operators) != len(terms) - 1 or set(operators) - set("&|^;"):
        raise ExpressionError("operators do not fit the terms")
    flags = negated or [False] * len(terms)
    cols = [F.coalesce(~t if n else t, F.lit(False)) for t, n in zip(terms, flags)]
    if operators == "^":
        return cols[0] != cols[1]
    chunks, chunk, group = [], [], [cols[0]]
    for op, c in [*zip(operators, cols[1:]), (";", None)]:
        if op == "&":
            group.append(c)
            continue
        both = group[0]
        for g in group[1:]:
            both = both & g
        chunk.append(both)
        group = [c]
        if op == ";":
            some = chunk[0]
            for g in chunk[1:]:
                some = some | g
            chunks.append(some)
            chunk = []
    result = chunks[0]
    for c in chunks[1:]:
        result = result & c
    return result
