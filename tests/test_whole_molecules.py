"""Molecule operators give all forms and try all cores."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from ferrule import queries
from ferrule.chem import enumeration, frames, transform
from ferrule.chem.molecule import parse

AMIDES = "NC(=O)C" + "C(C(N)=O)" * 5 + "C"


def test_tautomers_are_not_cut(spark):
    forms = transform.tautomers(parse(AMIDES))
    assert len(forms) > 50 and len(transform.tautomers(parse(AMIDES), 50)) == 50
    df = spark.createDataFrame([("a", AMIDES)], "id string, smiles string")
    assert {r.product for r in frames.tautomers(df).collect()} == forms
    assert frames.tautomers(df, most=10).count() == 10


def test_large_cores_are_tried(spark):
    m = queries.few_molecules(spark)
    want = {tuple(r) for r in enumeration.replace(m, enumeration.core_table(m), "core").collect()}
    cut = {tuple(r) for r in enumeration.replace(m, enumeration.core_table(m).where("length(product) < 15"), "core").collect()}
    got = {tuple(r) for r in queries.QUERIES["c_core_replacement"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want and len(got) > len(cut)
    print("core rows", len(cut), len(got))
