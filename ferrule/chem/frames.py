"""Molecule operations over DataFrames with a column of smiles.

Everything is one row to one or several rows, evaluated in Arrow batches
without a shuffle; grouping, joining and sorting are left to Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import descriptors, fingerprints, transform
from .molecule import Molecule, SmilesError, parse
from .smarts import Target, compile_smarts


@lru_cache(maxsize=4096)
def _parsed(smiles: str) -> Molecule | None:
    try:
        return parse(smiles)
    except (SmilesError, IndexError, RecursionError):
        return None


def on_molecule(f: Callable[[Molecule], object], kind: str) -> Callable[[Column], Column]:
    """A column function from a function of a molecule; null for what is no molecule."""

    @F.pandas_udf(kind)
    def run(smiles: pd.Series) -> pd.Series:
        def one(s):
            m = _parsed(s) if isinstance(s, str) else None
            return None if m is None else f(m)

        return pd.Series([one(s) for s in smiles], dtype=object)

    return run


def rejects(df: DataFrame, column: str = "smiles") -> DataFrame:
    """The rows that are no molecule, which every other function here leaves out or gives a null, with ``reason``."""

    @F.pandas_udf("string")
    def why(smiles: pd.Series) -> pd.Series:
        def one(s):
            if not isinstance(s, str):
                return "null"
            try:
                parse(s)
            except (SmilesError, IndexError, RecursionError) as e:
                return f"{type(e).__name__}: {e}"
            return None

        return pd.Series([one(s) for s in smiles], dtype=object)

    return df.withColumn("reason", why(column)).where("reason is not null")


def canonical(c: Column, largest: bool = False, chirality: bool = True) -> Column:
    return on_molecule(lambda m: (m.largest_fragment() if largest else m).smiles(chirality=chirality), "string")(c)


def structure_key(c: Column, graph: bool = False, largest: bool = True, chirality: bool = True) -> Column:
    """What makes two rows the same structure."""
    return on_molecule(lambda m: (lambda x: x.graph_key() if graph else x.smiles(chirality=chirality))(m.largest_fragment() if largest else m), "string")(c)


def formula(c: Column) -> Column:
    return on_molecule(lambda m: m.formula(), "string")(c)


def weight(c: Column) -> Column:
    return on_molecule(lambda m: round(m.weight(), 4), "double")(c)


def exact_mass(c: Column) -> Column:
    return on_molecule(lambda m: round(m.exact_mass(), 6), "double")(c)


def _rows(df: DataFrame, column: str, f: Callable[[Molecule], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows of ``df`` with the columns of ``schema``, once for each tuple that f gives."""
    names = [x.strip().split()[0].strip("`") for x in schema.split(",")]
    kinds = [x.strip().split()[1] for x in schema.split(",")]
    dtype = {"string": object, "long": "int64", "int": "int32", "double": "float64"}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at, out = [], []
            for i, s in enumerate(frame[column]):
                m = _parsed(s) if isinstance(s, str) else None
                for t in f(m) if m is not None else ():
                    at.append(i)
                    out.append(t)
            part = frame.iloc[at].reset_index(drop=True)
            for k, (n, kind) in enumerate(zip(names, kinds)):
                part[n] = pd.Series([t[k] for t in out], dtype=dtype[kind])
            yield part

    whole = ", ".join([*(f"`{c.name}` {c.dataType.simpleString()}" for c in df.schema), schema])
    return df.mapInPandas(run, whole)


def describe(df: DataFrame, column: str = "smiles") -> DataFrame:
    """One double column per descriptor; rows that are no molecule go."""
    return _rows(df, column, lambda m: [tuple(descriptors.describe(m).values())], ", ".join(f"{n} double" for n in descriptors.NAMES))


def topology(df: DataFrame, column: str = "smiles") -> DataFrame:
    """One double column per topological descriptor."""
    names = list(descriptors.topology(parse("C")))
    return _rows(df, column, lambda m: [tuple(descriptors.topology(m).values())], ", ".join(f"`{n}` double" for n in names))


def rule_of_five(df: DataFrame, column: str = "smiles") -> DataFrame:
    return _rows(df, column, lambda m: [tuple(map(float, descriptors.rule_of_five(m).values()))], "ro5_nhoh double, ro5_no double, natoms double, amw double, clogp double, violations double")


def match_counts(df: DataFrame, queries: dict[str, str], column: str = "smiles", unique: bool = True) -> DataFrame:
    """A column of hits per query."""
    names = list(queries)

    def count(m: Molecule) -> list[tuple]:
        t = Target(m)
        return [tuple(len(compile_smarts(queries[n]).matches(t, unique)) for n in names)]

    return _rows(df, column, count, ", ".join(f"{n} int" for n in names))


def substructure(c: Column, query: str) -> Column:
    """Whether a query matches; false for what is no molecule."""
    return F.coalesce(on_molecule(lambda m: compile_smarts(query).hits(Target(m)), "boolean")(c), F.lit(False))


def embeddings(c: Column, query: str, unique: bool = True) -> Column:
    return on_molecule(lambda m: [list(e) for e in compile_smarts(query).matches(Target(m), unique)], "array<array<int>>")(c)


def fingerprint(df: DataFrame, kind: str = "circular", id_column: str = "id", column: str = "smiles") -> DataFrame:
    """Long fingerprint rows (id, bit, cnt)."""
    f = fingerprints.KINDS[kind]
    out = _rows(df.select(F.col(id_column).alias("id"), F.col(column).alias("smiles")), "smiles", lambda m: sorted(f(m).items()), "bit long, cnt int")
    return out.select("id", "bit", "cnt")


def properties(c: Column) -> Column:
    return on_molecule(fingerprints.properties, "array<int>")(c)


def dicer(df: DataFrame, depth: int = 2, low: int = 1, high: int = 50, id_column: str = "id", column: str = "smiles", carbon_carbon: bool = False) -> DataFrame:
    """Rows (id, fragment, n)."""
    out = _rows(df.select(F.col(id_column).alias("id"), F.col(column).alias("smiles")), "smiles", lambda m: sorted(transform.dice(m, depth, low, high, carbon_carbon).items()), "fragment string, n long")
    return out.select("id", "fragment", "n")


def fragment_statistics(fragments: DataFrame) -> DataFrame:
    """Per fragment: molecules, total, and the first molecule."""
    return fragments.groupBy("fragment").agg(F.count(F.lit(1)).alias("molecules"), F.sum("n").alias("total"), F.min("id").alias("first"))


def _named(f: Callable[[Molecule], Iterable[str]]) -> Callable[[DataFrame, str, str], DataFrame]:
    def run(df: DataFrame, id_column: str = "id", column: str = "smiles") -> DataFrame:
        out = _rows(df.select(F.col(id_column).alias("id"), F.col(column).alias("smiles")), "smiles", lambda m: [(s,) for s in f(m)], "product string")
        return out.select("id", "product")

    return run


scaffolds = _named(lambda m: sorted(transform.scaffolds(m)))
murcko = _named(lambda m: [s.smiles()] if (s := transform.scaffold(m)) else [])
skeletons = _named(lambda m: [transform.skeleton(m).smiles()])
rings = _named(transform.extract_rings)
trimmed = _named(lambda m: sorted(transform.trim_rings(m)))
cores = _named(lambda m: sorted(transform.cores(m)))


def tautomers(df: DataFrame, id_column: str = "id", column: str = "smiles", most: int | None = None) -> DataFrame:
    """All forms of each molecule; at most ``most``, if given."""
    return _named(lambda m: sorted(transform.tautomers(m, most)))(df, id_column, column)


def substituents(df: DataFrame, query: str, atom: int = 0, id_column: str = "id", column: str = "smiles") -> DataFrame:
    return _named(lambda m: transform.substituents(m, query, atom))(df, id_column, column)


def matched_atoms(df: DataFrame, query: str, id_column: str = "id", column: str = "smiles") -> DataFrame:
    return _named(lambda m: transform.keep_matched(m, query))(df, id_column, column)


def without_matched(df: DataFrame, query: str, label: int = 0, id_column: str = "id", column: str = "smiles") -> DataFrame:
    return _named(lambda m: [s] if (s := transform.remove_matched(m, query, label)) else [])(df, id_column, column)


def random_smiles(df: DataFrame, n: int, seed: int = 0, id_column: str = "id", column: str = "smiles") -> DataFrame:
    import random

    return _named(lambda m: [m.random_smiles(random.Random(f"{seed}:{k}:{m.formula()}")) for k in range(n)])(df, id_column, column)


def standardise(c: Column) -> Column:
    return on_molecule(lambda m: transform.standardise(parse(m.smiles())).smiles(), "string")(c)


def react(df: DataFrame, reaction: str, id_column: str = "id", column: str = "smiles") -> DataFrame:
    """Products of a reaction of one reactant."""
    return _named(lambda m: list(dict.fromkeys(p.smiles() for p in transform.reaction(reaction).apply([m]))))(df, id_column, column)


def enumerate_library(scaffold: DataFrame, sidechains: DataFrame, reaction: str) -> DataFrame:
    """Rows (id, sidechain, product) of two-reactant products: every scaffold with every sidechain, which is what a
    library is.  Both sides hold (id, smiles) and are first cut to rows that match their part of the reaction."""
    left, right = (x for x in transform._components(reaction.partition(">>")[0]))
    a = scaffold.where(substructure(F.col("smiles"), left)).select("id", F.col("smiles").alias("s1"))
    b = sidechains.where(substructure(F.col("smiles"), right)).select(F.col("id").alias("sidechain"), F.col("smiles").alias("s2"))

    @F.pandas_udf("array<string>")
    def make(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([transform.products(reaction, [p, q]) for p, q in zip(x, y)], dtype=object)

    return a.join(b).select("id", "sidechain", F.explode(make("s1", "s2")).alias("product"))


def demerits(df: DataFrame, threshold: int = 100, column: str = "smiles") -> DataFrame:
    """Rows with demerits, reasons and rejected."""

    def one(m: Molecule) -> list[tuple]:
        total, why = descriptors.demerits(m, threshold=threshold)
        return [(total, ";".join(why))]

    return _rows(df, column, one, "demerits long, reasons string").withColumn("rejected", F.col("demerits") >= threshold)


def first_pass(c: Column, **limits: int) -> Column:
    """Why a molecule is rejected; ``smiles`` if it is none, null if it passes."""
    reason = on_molecule(lambda m: descriptors.first_pass(m, **limits) or "", "string")(c)
    return F.when(reason.isNull(), F.lit("smiles")).when(reason != "", reason)


def need_available(c: Column, pairs: Sequence[tuple[str, str, int]]) -> Column:
    return on_molecule(lambda m: descriptors.need_available(m, pairs), "boolean")(c)


def unique_molecules(df: DataFrame, order: str, column: str = "smiles", also: Sequence[str] = (), **key) -> tuple[DataFrame, DataFrame]:
    """(first rows of each structure, the others); ``also``: columns that count as part of it."""
    rows = df.withColumn("__key", structure_key(F.col(column), **key)).where("__key is not null")
    rows = rows.withColumn("__r", F.row_number().over(W.partitionBy("__key", *also).orderBy(order)))
    return rows.where("__r = 1").drop("__key", "__r"), rows.where("__r > 1").drop("__key", "__r")


def sort_molecules(df: DataFrame, keys: Sequence[str], tie: str, column: str = "smiles") -> DataFrame:
    """Rows in order of descriptors, ``-name`` descending."""
    names = [k.lstrip("-") for k in keys]
    out = _rows(df, column, lambda m: [tuple(descriptors.describe(m)[n] for n in names)], ", ".join(f"{n} double" for n in names))
    return out.orderBy(*[F.desc(k[1:]) if k.startswith("-") else F.asc(k) for k in keys], tie)


def reaction_signatures(df: DataFrame, column: str = "reaction", radius: int = 1) -> DataFrame:
    @F.pandas_udf("string")
    def sign(r: pd.Series) -> pd.Series:
        return pd.Series([transform.reaction_signature(x, radius) for x in r], dtype=object)

    return df.withColumn("signature", sign(column))
