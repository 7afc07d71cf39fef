"""Replacement, enumeration, geometry and molecule files."""

import random

import numpy as np
from pyspark.sql import functions as F

from ferrule.chem import enumeration, frames, geometry
from ferrule.chem.molecule import canonical, parse
from ferrule.chem.smarts import Target, compile_smarts
from ferrule.sources import molfiles


def test_ring_replacement():
    got = set(enumeration.swap(parse("CCc1ccccc1"), ["[1cH]1ccncc1", "[1CH2]1CCCC1"], "ring"))
    assert got == {canonical("CCc1ccncc1"), canonical("CCC1CCCC1")}
    assert list(enumeration.swap(parse("CCO"), ["[1cH]1ccncc1"], "ring")) == []


def test_core_replacement():
    got = set(enumeration.swap(parse("c1ccccc1COc1ccncc1"), ["[1NH2][1CH3]", "[1OH2]"], "core"))
    assert canonical("c1ccccc1NCc1ccncc1") in got or canonical("c1ccccc1CNc1ccncc1") in got


def test_mutations_are_valid_and_repeatable():
    a = enumeration.mutate(parse("CC(=O)Oc1ccccc1"), random.Random(1))
    assert a and a == enumeration.mutate(parse("CC(=O)Oc1ccccc1"), random.Random(1))
    assert all(canonical(s) == s for s in a)


def test_queries_from_molecules():
    for s in ("CC(=O)Nc1ccccc1", "C1CC1N", "C#N"):
        m = parse(s)
        assert compile_smarts(enumeration.to_query(m)).hits(Target(m))
    assert enumeration.pharmacophore(parse("NCCO"), {"d": "N", "a": "O"}) == [("a", "d", 3)]


def test_tables_and_joins(spark):
    df = spark.createDataFrame([("a", "CCc1ccccc1"), ("b", "CCCc1ccncc1"), ("c", "Cc1ccccc1"), ("x", "no smiles"), ("n", None)], "id string, smiles string")
    table = enumeration.ring_table(df)
    assert {(r["product"], r.molecules, r.attachments) for r in table.collect()} == {(canonical("[1cH]1ccccc1"), 2, 1), (canonical("[1cH]1ccncc1"), 1, 1)}
    got = {(r.id, r["product"]) for r in enumeration.replace(df, table).collect()}
    assert got == {("a", canonical("CCc1ccncc1")), ("b", canonical("CCCc1ccccc1")), ("c", canonical("Cc1ccncc1"))}
    acids = spark.createDataFrame([("p", "CC(=O)O"), ("q", "NC"), ("r", "NCC")], "id string, smiles string")
    wanted = spark.createDataFrame([("p", "q")], "id1 string, id2 string")
    amide = "[C:1](=[O:2])[OH].[NH2:3]>>[C:1](=[O:2])[NH:3]"
    assert [r["product"] for r in enumeration.listed_products(wanted, acids, amide).collect()] == [canonical("CC(=O)NC")]
    assert {r["product"] for r in frames.enumerate_library(acids, acids, amide).collect()} == {canonical("CC(=O)NC"), canonical("CC(=O)NCC")}
    open_ = spark.createDataFrame([("1", "C%11CC%12")], "id string, smiles string")
    other = spark.createDataFrame([("2", "N%11.O%12"), ("3", "N%13")], "id string, smiles string")
    assert [r["product"] for r in enumeration.close_rings(open_, other).collect()] == [canonical("NCCCO")]


def test_geometry():
    assert abs(geometry.angle((1, 0, 0), (0, 0, 0), (0, 1, 0)) - 90) < 1e-9
    assert abs(abs(geometry.dihedral((1, 0, 0), (0, 0, 0), (0, 1, 0), (0, 1, 1))) - 90) < 1e-9
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    out, rms = geometry.superpose(x @ q + 3, x)
    assert rms < 1e-9 and np.allclose(out, x)
    assert geometry.bumps(np.array([[0, 0, 0], [0.5, 0, 0], [5, 0, 0]]), set(), 1.0) == [(0, 1)]
    assert geometry.bonds_from_geometry(["O", "H", "H"], np.array([[0, 0, 0], [0.96, 0, 0], [-0.24, 0.93, 0]])) == [(0, 1), (0, 2)]


def test_length_and_torsion_statistics(spark):
    b = spark.createDataFrame([(1, "CC", 1.54), (1, "CO", 1.43), (2, "CC", 1.50)], "id int, kind string, length double")
    assert {(r.kind, r.bucket, r.n) for r in geometry.length_distribution(b, 0.1).collect()} == {("CC", 15, 2), ("CO", 14, 1)}
    ref = b.groupBy("kind").agg(F.avg("length").alias("mean"), F.lit(0.02).alias("sd"))
    assert abs(geometry.length_scores(b, ref).where("id = 2").first().score - 1) < 1e-9
    t = spark.createDataFrame([("a", 10.0), ("a", 370.0), ("b", 0.0), ("b", 180.0)], "key string, angle double")
    got = {r.key: r.spread for r in geometry.torsion_spread(t).collect()}
    assert abs(got["a"]) < 1e-9 and abs(got["b"] - 1) < 1e-9


def test_molecule_files(spark):
    for s in ("CC(=O)Oc1ccccc1", "C[NH3+]", "[13CH4]", "OC(=O)c1ccncc1"):
        block = molfiles.write_mdl(molfiles.Structure("n", parse(s)))
        back = molfiles.read_mdl(block)
        assert back.name == "n" and molfiles.without_hydrogens(back.molecule).smiles() == canonical(s)
    assert molfiles.write_sdf(molfiles.Structure("n", parse("C")), {"A": "1"}).endswith(">  <A>\n1\n\n$$$$\n")
    water = molfiles.read_xyz("3\nwater\nO 0 0 0\nH 0.96 0 0\nH -0.24 0.93 0\n")
    assert water.name == "water" and molfiles.without_hydrogens(water.molecule).smiles() == "O"
    mol2 = "@<TRIPOS>MOLECULE\nbenz\n@<TRIPOS>ATOM\n" + "".join(f"{i + 1} C 0 0 0 C.ar\n" for i in range(6)) + "@<TRIPOS>BOND\n" + "".join(f"{i + 1} {i + 1} {(i + 1) % 6 + 1} ar\n" for i in range(6))
    assert molfiles.read_mol2(mol2).molecule.smiles() == "c1ccccc1"
    pdb = "HEADER    ETHANE\nHETATM    1  C1  LIG     1       0.000   0.000   0.000  1.00  0.00           C\nHETATM    2  C2  LIG     1       1.500   0.000   0.000  1.00  0.00           C\nCONECT    1    2\nCONECT    2    1\n"
    assert molfiles.read_pdb(pdb).molecule.smiles() == "CC"
    df = spark.createDataFrame([(1, molfiles.write_mdl(molfiles.Structure("x", parse("CCO")))), (2, "rubbish"), (3, None)], "i int, block string")
    assert [(r.i, r.mol_name, r.smiles) for r in molfiles.blocks_to_smiles(df, "block").collect()] == [(1, "x", "CCO"), (2, None, None), (3, None, None)]
