"""Replacement of rings, fragments and cores from tables, enumeration and mutation.

A replacement table is made by one pass over a collection (fragments with
labelled attachment points, counted) and used by a join on the number of
attachments; joining pieces is chemistry on one row.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import transform
from .frames import _named, _parsed, _rows
from .molecule import Atom, Molecule, SmilesError, parse
from .smarts import Target, compile_smarts


def join_at_labels(core: Molecule, parts: Sequence[Molecule]) -> Molecule:
    """``core``'s labelled atoms bonded, in order, to the labelled atom of each part; labels go."""
    out = Molecule()
    shift, ends = [], []
    for m in (core, *parts):
        shift.append(len(out.atoms))
        for i, a in enumerate(m.atoms):
            h = m.hydrogens(i)
            labelled = a.isotope > 0
            out.add_atom(Atom(a.symbol, a.charge, 0, (max(0, h - 1) if labelled else h) if a.hydrogens is not None or a.aromatic else None, False))
        ends.append([i + shift[-1] for i, a in enumerate(m.atoms) if a.isotope])
    for m, s in zip((core, *parts), shift):
        for b in m.bonds:
            out.add_bond(b.a + s, b.b + s, b.order)
    if len(ends[0]) != len(parts) or any(len(e) != 1 for e in ends[1:]):
        raise SmilesError("labels do not fit")
    for a, (b,) in zip(ends[0], ends[1:]):
        out.add_bond(a, b)
    for i, a in enumerate(out.atoms):
        if a.hydrogens is not None and a.symbol in ("C",):
            a.hydrogens = None
    out.perceive_aromaticity()
    return parse(out.smiles())


def swap(m: Molecule, pieces: Sequence[str], kind: str) -> Iterator[str]:
    """Molecules in which one part is another piece with as many labelled atoms: ``ring`` systems or ``core``s between cuts."""
    seen = {m.smiles()}
    parts = [sorted(s) for s in m.ring_systems()] if kind == "ring" else []
    if kind == "core":
        bonds = transform.breakable_bonds(m)
        for cuts in permutations(bonds, 2):
            if cuts[0] < cuts[1]:
                for f in _without(m, cuts):
                    if sum(any(m.bonds[k].a == i or m.bonds[k].b == i for k in cuts) for i in f) == 2:
                        parts.append(f)
    for part in parts:
        inside = set(part)
        outer = [(i, n) for i in part for n in m.neighbours(i) if n not in inside]
        if not outer or len({n for _, n in outer}) != len(outer) or any(m.bond_between(*x).order > 1 for x in outer):
            continue
        rest = []
        for _, n in outer:
            keep, queue = {n}, [n]
            while queue:
                for y in m.neighbours(queue.pop()):
                    if y not in keep and y not in inside:
                        keep.add(y)
                        queue.append(y)
            order = sorted(keep)
            side = m.subset(order)
            side.atoms[order.index(n)].isotope = 1
            rest.append(side)
        for s in pieces:
            p = _parsed(s)
            if p is None or sum(a.isotope > 0 for a in p.atoms) != len(outer):
                continue
            for order in permutations(range(len(rest))):
                try:
                    new = join_at_labels(p, [rest[k] for k in order]).smiles()
                except SmilesError:
                    continue
                if new not in seen:
                    seen.add(new)
                    yield new


def _without(m: Molecule, cuts: Sequence[int]) -> list[list[int]]:
    copy = Molecule()
    for _ in m.atoms:
        copy.add_atom(Atom("C"))
    for k, b in enumerate(m.bonds):
        if k not in cuts:
            copy.add_bond(b.a, b.b)
    return copy.fragments()


def ring_table(df: DataFrame, id_column: str = "id", column: str = "smiles") -> DataFrame:
    """Rows (product, attachments, molecules, example): ring systems of a collection and how many molecules have each."""
    from .frames import rings

    found = rings(df, id_column, column).distinct()
    ends = F.size(F.regexp_extract_all("product", F.lit(r"\[1"), F.lit(0)))
    return found.groupBy("product").agg(F.count(F.lit(1)).alias("molecules"), F.min("id").alias("example")).withColumn("attachments", ends)


def core_table(df: DataFrame, id_column: str = "id", column: str = "smiles") -> DataFrame:
    from .frames import cores

    found = cores(df, id_column, column).distinct()
    return found.groupBy("product").agg(F.count(F.lit(1)).alias("molecules"), F.min("id").alias("example")).withColumn("attachments", F.lit(2))


def replace(df: DataFrame, table: DataFrame, kind: str = "ring", least: int = 1, id_column: str = "id", column: str = "smiles") -> DataFrame:
    """Rows (id, piece, product): each molecule with each table piece seen in ``least`` molecules or more.

    Pairs are made by the number of attachments that a molecule offers."""

    def offers(m: Molecule) -> list[tuple]:
        if kind == "core":
            return [(2,)]
        out = set()
        for s in m.ring_systems():
            out.add(sum(n not in s for i in s for n in m.neighbours(i)))
        return [(k,) for k in sorted(out) if k]

    places = _rows(df.select(F.col(id_column).alias("id"), F.col(column).alias("smiles")), "smiles", offers, "attachments int")
    pairs = places.join(table.where(F.col("molecules") >= least).select(F.col("product").alias("piece"), "attachments"), "attachments")

    @F.pandas_udf("array<string>")
    def make(s: pd.Series, piece: pd.Series) -> pd.Series:
        return pd.Series([list(swap(_parsed(x), [p], kind)) for x, p in zip(s, piece)], dtype=object)

    return pairs.select("id", "piece", F.explode(make("smiles", "piece")).alias("product")).distinct()


def mutate(m: Molecule, rng: random.Random, tries: int = 20) -> list[str]:
    """Valid molecules one change away: an element swapped, a bond order changed, an atom added or taken off."""
    out = set()
    for _ in range(tries):
        kek = parse(m.smiles(), aromaticity=False)
        for a in kek.atoms:
            a.aromatic = False
            a.chiral = 0
            if a.symbol in ("C", "N", "O") and not a.charge:
                a.hydrogens = None
        for b in kek.bonds:
            b.aromatic = False
        what, i = rng.randrange(4), rng.randrange(len(kek.atoms))
        if what == 0:
            kek.atoms[i].symbol, kek.atoms[i].hydrogens = rng.choice("CNO"), None
        elif what == 1 and kek.bonds:
            b = rng.choice(kek.bonds)
            b.order = 3 - b.order if b.order < 3 else 1
        elif what == 2:
            kek.add_bond(i, kek.add_atom(Atom(rng.choice(("C", "N", "O", "F")))))
        elif what == 3 and len(kek.adjacent[i]) == 1:
            kek = kek.subset([k for k in range(len(kek.atoms)) if k != i])
        most = {"C": 4, "N": 3, "O": 2, "F": 1}
        if not kek.atoms or any(kek.bond_order_sum(k) > most.get(a.symbol, 8) + max(0, a.charge) for k, a in enumerate(kek.atoms)):
            continue
        try:
            kek.perceive_aromaticity()
            out.add(parse(kek.smiles()).smiles())
        except SmilesError:
            continue
    out.discard(m.smiles())
    return sorted(out)


def mutations(df: DataFrame, tries: int = 20, seed: int = 0, id_column: str = "id", column: str = "smiles") -> DataFrame:
    """Rows (id, product); the same for the same seed."""
    return _named(lambda m: mutate(m, random.Random(f"{seed}:{m.smiles()}"), tries))(df, id_column, column)


def close_rings(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (id1, id2, product): pieces whose smiles leave ring numbers open, completed by each other.

    Both hold (id, smiles); only pairs with the same open numbers are made."""
    opened = F.array_join(F.array_sort(F.regexp_extract_all("smiles", F.lit(r"%\d\d"), F.lit(0))), "")
    a = left.select(F.col("id").alias("id1"), F.col("smiles").alias("s1"), opened.alias("open"))
    b = right.select(F.col("id").alias("id2"), F.col("smiles").alias("s2"), opened.alias("open"))

    @F.pandas_udf("string")
    def make(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([m.smiles() if (m := _parsed(f"{p}.{q}")) else None for p, q in zip(x, y)], dtype=object)

    return a.join(b, "open").where("open <> ''").select("id1", "id2", make("s1", "s2").alias("product")).where("product is not null")


def listed_products(wanted: DataFrame, reagents: DataFrame, reaction: str) -> DataFrame:
    """Rows (id1, id2, product) of only the listed pairs (id1, id2) of reagents (id, smiles)."""
    a = reagents.select(F.col("id").alias("id1"), F.col("smiles").alias("s1"))
    b = reagents.select(F.col("id").alias("id2"), F.col("smiles").alias("s2"))

    @F.pandas_udf("array<string>")
    def make(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([transform.products(reaction, [p, q]) for p, q in zip(x, y)], dtype=object)

    return wanted.join(a, "id1").join(b, "id2").select("id1", "id2", F.explode(make("s1", "s2")).alias("product"))


def atom_separations(m: Molecule, low: int = 1, high: int = 10) -> list[tuple[int, str]]:
    """(bonds between the two cut ends, linker) of each fragment between two cuts."""
    out = []
    for s in sorted(transform.cores(m)):
        c = parse(s)
        ends = [i for i, a in enumerate(c.atoms) if a.isotope]
        if len(ends) == 2 and low <= (d := c.distances()[ends[0]][ends[1]]) <= high:
            out.append((d, s))
    return out


def separations(df: DataFrame, id_column: str = "id", column: str = "smiles") -> DataFrame:
    """Rows (separation, linker, molecules, example)."""
    found = _rows(df.select(F.col(id_column).alias("id"), F.col(column).alias("smiles")), "smiles", atom_separations, "separation int, linker string").select("id", "separation", "linker").distinct()
    return found.groupBy("separation", "linker").agg(F.count(F.lit(1)).alias("molecules"), F.min("id").alias("example"))


def to_query(m: Molecule) -> str:
    """A query that the molecule matches: its elements, bonds and aromaticity."""
    return m.subset(list(range(len(m.atoms)))).smiles(chirality=False)


def pharmacophore(m: Molecule, features: dict[str, str], most: int = 12) -> list[tuple[str, str, int]]:
    """(feature, feature, bonds) between matches of named queries."""
    t, d, out = Target(m), m.distances(), []
    found = [(n, e[0]) for n, q in features.items() for e in compile_smarts(q).matches(t)]
    for k, (n1, i) in enumerate(found):
        for n2, j in found[:k]:
            if i != j and 0 < d[i][j] <= most:
                out.append((*sorted((n1, n2)), d[i][j]))
    return sorted(out)
