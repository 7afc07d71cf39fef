"""Similarities of fingerprints and property vectors as native column expressions.

Sparse counted fingerprints are ``map<bigint,int>``, dense ones arrays of
64-bit words, property vectors arrays of numbers.  Two empty fingerprints are
alike (1), an empty and another are not (0), unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

Pair = Callable[[Column, Column], Column]


def _d(c: Column) -> Column:
    return c.cast("double")


def total(a: Column) -> Column:
    """Sum of counts of a sparse fingerprint."""
    return F.aggregate(F.map_values(a), F.lit(0).cast("long"), lambda s, x: s + x)


def _shared(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Sum of f over the bits of both; one pass over either map."""
    both = F.map_zip_with(a, b, lambda k, x, y: _d(F.when(x.isNotNull() & y.isNotNull(), f(x, y)).otherwise(F.lit(0))))
    return F.aggregate(F.map_values(both), F.lit(0.0), lambda s, x: s + x)


def common(a: Column, b: Column) -> Column:
    """Sum of the lesser counts."""
    return _shared(a, b, F.least)


def _guard(na: Column, nb: Column, value: Column, both: float = 1.0) -> Column:
    return F.when((na == 0) & (nb == 0), F.lit(both)).when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(value)


def tanimoto(a: Column, b: Column) -> Column:
    na, nb, c = total(a), total(b), common(a, b)
    return _guard(na, nb, c / (na + nb - c))


def tanimoto_binary(a: Column, b: Column) -> Column:
    na, nb = F.size(a), F.size(b)
    c = _d(F.size(F.array_intersect(F.map_keys(a), F.map_keys(b))))
    return _guard(na, nb, c / (na + nb - c))


def dice(a: Column, b: Column) -> Column:
    na, nb = total(a), total(b)
    return _guard(na, nb, 2 * common(a, b) / (na + nb))


def dot(a: Column, b: Column) -> Column:
    return _shared(a, b, lambda x, y: x * y)


def cosine(a: Column, b: Column) -> Column:
    """0 if either is empty, also if both are."""
    na, nb = dot(a, a), dot(b, b)
    return _guard(na, nb, dot(a, b) / F.sqrt(na * nb), both=0.0)


def continuous_tanimoto(a: Column, b: Column, exponent: float = 1.0) -> Column:
    na, nb, ab = dot(a, a), dot(b, b), dot(a, b)
    return _guard(na, nb, F.pow(ab / (na + nb - ab), F.lit(exponent)))


def _l1(a: Column, b: Column) -> Column:
    return total(a) + total(b) - 2 * common(a, b)


def manhattan(a: Column, b: Column) -> Column:
    return 1 / (1 + _l1(a, b))


def soergel(a: Column, b: Column) -> Column:
    """1 - sum |a-b| / sum max, over all bits of either."""
    most = total(a) + total(b) - common(a, b)
    return F.when(most == 0, F.lit(1.0)).otherwise(1 - _l1(a, b) / most)


def soergel_mean(a: Column, b: Column) -> Column:
    """1 - mean over bits of |a-b| / max; a bit of one only adds 1."""
    n = F.size(F.array_union(F.map_keys(a), F.map_keys(b)))
    return F.when(n == 0, F.lit(1.0)).otherwise(_shared(a, b, lambda x, y: F.least(x, y) / F.greatest(x, y)) / n)


def tversky(a: Column, b: Column, alpha: float, beta: float) -> Column:
    na, nb, c = total(a), total(b), common(a, b)
    return _guard(na, nb, c / (alpha * (na - c) + beta * (nb - c) + c))


def optimistic_distance(a: Column, b: Column, alpha: float, beta: float) -> Column:
    return F.least(1 - tanimoto(a, b), 1 - tversky(a, b, alpha, beta), 1 - tversky(b, a, alpha, beta))


def vector_difference(a: Column, b: Column) -> Column:
    """Counts of ``a`` less those of ``b``; bits that come to nothing go."""
    zero = F.lit(0)
    both = F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, zero) - F.coalesce(y, zero))
    return F.map_filter(both, lambda _, v: v != 0)


# Dense fingerprints.


def ones(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, w: s + F.bit_count(w))


def _zip(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, f)


def bits_and(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: x.bitwiseAND(y))


def bits_or(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: x.bitwiseOR(y))


def bits_xor(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: x.bitwiseXOR(y))


def flip(a: Column) -> Column:
    return F.transform(a, lambda w: F.bitwise_not(w))


def fold(a: Column) -> Column:
    """The two halves of the words, or-ed."""
    half = (F.size(a) / 2).cast("int")
    return bits_or(F.slice(a, F.lit(1), half), F.slice(a, half + 1, half))


def in_common(a: Column, b: Column) -> Column:
    return ones(bits_and(a, b))


def dense_tanimoto(a: Column, b: Column) -> Column:
    na, nb, c = ones(a), ones(b), _d(in_common(a, b))
    return _guard(na, nb, c / (na + nb - c))


def dense_tversky(a: Column, b: Column, alpha: float, beta: float) -> Column:
    na, nb, c = ones(a), ones(b), _d(in_common(a, b))
    return _guard(na, nb, c / (alpha * (na - c) + beta * (nb - c) + c))


def fraction_matched(a: Column, b: Column) -> Column:
    return _d(in_common(a, b)) / (64 * F.size(a))


def russel_rao(a: Column, b: Column) -> Column:
    """Bits in common over all bits; 0 if either is empty."""
    return F.when((ones(a) == 0) | (ones(b) == 0), F.lit(0.0)).otherwise(fraction_matched(a, b))


def forbes(a: Column, b: Column) -> Column:
    na, nb = ones(a), ones(b)
    return _guard(na, nb, _d(in_common(a, b)) / (na * nb))


def simple_matching(a: Column, b: Column) -> Column:
    return 1 - _d(ones(bits_xor(a, b))) / (64 * F.size(a))


def sorensen_dice(a: Column, b: Column) -> Column:
    na, nb = ones(a), ones(b)
    return _guard(na, nb, 2 * _d(in_common(a, b)) / (na + nb))


def overlap(a: Column, b: Column) -> Column:
    na, nb = ones(a), ones(b)
    return _guard(na, nb, _d(in_common(a, b)) / F.least(na, nb))


def fligner_verducci_blower(a: Column, b: Column) -> Column:
    """A weighted mean of the Tanimoto coefficients of ones and of zeros."""
    nb = 64 * F.size(a)
    n1, n2, n11 = ones(a), ones(b), _d(in_common(a, b))
    n00 = nb - n1 - n2 + n11
    p = (n1 + n2) / (2 * nb)
    t1 = F.when(nb == n00, F.lit(1.0)).otherwise(n11 / (nb - n00))
    t0 = F.when(nb == n11, F.lit(1.0)).otherwise(n00 / (nb - n11))
    return ((2 - p) * t1 + (1 + p) * t0) / 3


# Property vectors.


def _ratio(x: Column, y: Column) -> Column:
    return F.when(x == y, F.lit(1.0)).when((x == 0) | (y == 0), F.lit(0.5)).otherwise(_d(F.least(x, y)) / F.greatest(x, y))


def property_ratio(a: Column, b: Column) -> Column:
    """Mean of lesser over greater; equal counts 1, one zero counts a half."""
    return F.aggregate(_zip(a, b, _ratio), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def property_dice(a: Column, b: Column) -> Column:
    s = F.aggregate(_zip(a, b, lambda x, y: _d(x + y)), F.lit(0.0), lambda t, x: t + x)
    m = F.aggregate(_zip(a, b, lambda x, y: _d(F.least(x, y))), F.lit(0.0), lambda t, x: t + x)
    return F.when(s == 0, F.lit(1.0)).otherwise(2 * m / s)


def continuous_ratio(a: Column, b: Column) -> Column:
    one = lambda x, y: F.when(x == y, F.lit(1.0)).when(x * y <= 0, F.lit(0.0)).otherwise(F.least(F.abs(x), F.abs(y)) / F.greatest(F.abs(x), F.abs(y)))
    return F.aggregate(_zip(a, b, one), F.lit(0.0), lambda s, x: s + _d(x)) / F.size(a)


def continuous_dice(a: Column, b: Column) -> Column:
    s = F.aggregate(_zip(a, b, lambda x, y: _d(x + y)), F.lit(0.0), lambda t, x: t + x)
    m = F.aggregate(_zip(a, b, lambda x, y: _d(F.least(x, y))), F.lit(0.0), lambda t, x: t + x)
    return F.when(s == m, F.lit(1.0)).otherwise(m / (s - m))


def cartesian(a: Column, b: Column) -> Column:
    """1 less the Euclidean distance."""
    return 1 - F.sqrt(F.aggregate(_zip(a, b, lambda x, y: _d((x - y) * (x - y))), F.lit(0.0), lambda s, x: s + x))


def exponential(a: Column, b: Column, value: float = 1.0, power: int = 1) -> Column:
    """Mean of exp(-value |d|**power)."""
    return F.aggregate(_zip(a, b, lambda x, y: F.exp(-value * F.pow(F.abs(_d(x) - y), F.lit(power)))), F.lit(0.0), lambda s, x: s + x) / F.size(a)


SPARSE: dict[str, Pair] = {"tanimoto": tanimoto, "binary": tanimoto_binary, "dice": dice, "cosine": cosine, "ctan": continuous_tanimoto, "manhattan": manhattan, "soergel": soergel, "soergel_mean": soergel_mean, "dot": dot}
DENSE: dict[str, Pair] = {"tanimoto": dense_tanimoto, "russel_rao": russel_rao, "forbes": forbes, "simple_matching": simple_matching, "sorensen_dice": sorensen_dice, "overlap": overlap, "fvb": fligner_verducci_blower, "fraction": fraction_matched}
PROPERTY: dict[str, Pair] = {"ratio": property_ratio, "dice": property_dice, "cratio": continuous_ratio, "cdice": continuous_dice, "cartesian": cartesian, "exp1": exponential, "exp2": lambda a, b: exponential(a, b, power=2)}


def composite(parts: list[tuple[Pair, str, float | None]], left: str = "a", right: str = "b") -> Column:
    """Weighted sum of similarities of columns ``left.name`` and ``right.name``.

    Weights that are None share what the others leave of 1.  A sum just above 1 counts as 1."""
    given = sum(w for _, _, w in parts if w is not None)
    open_ = sum(w is None for _, _, w in parts)
    each = (1 - given) / open_ if open_ else 0.0
    out = F.lit(0.0)
    for f, name, w in parts:
        out = out + (each if w is None else w) * f(F.col(f"{left}.{name}"), F.col(f"{right}.{name}"))
    return F.when((out > 1) & (out < 1.01), F.lit(1.0)).otherwise(out)


def pooled_tanimoto(names: list[str], left: str = "a", right: str = "b") -> Column:
    """Tanimoto of all sparse components taken as one fingerprint."""
    na = nb = c = F.lit(0.0)
    for n in names:
        a, b = F.col(f"{left}.{n}"), F.col(f"{right}.{n}")
        na, nb, c = na + total(a), nb + total(b), c + common(a, b)
    return _guard(na, nb, c / (na + nb - c))


def scaled(d: Column, table: list[tuple[float, float]]) -> Column:
    """A distance through a lookup table of (upper bound, value); above the last its value."""
    out = F.lit(table[-1][1])
    for top, value in reversed(table[:-1]):
        out = F.when(d <= top, F.lit(value)).otherwise(out)
    return out
