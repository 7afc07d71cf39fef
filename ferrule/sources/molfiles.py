"""Molecule file blocks as text: MDL, XYZ, Tripos MOL2 and PDB atoms; MDL and SDF written."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from ferrule.chem.molecule import NUMBER, Atom, Molecule, SmilesError

_CHARGES = {1: 3, 2: 2, 3: 1, 5: -1, 6: -2, 7: -3}


@dataclass
class Structure:
    name: str
    molecule: Molecule
    points: list[tuple[float, float, float]] = field(default_factory=list)


def _symbol(text: str) -> str:
    s = text.strip().capitalize()
    return {"D": "H", "T": "H"}.get(s, s)


def read_mdl(block: str) -> Structure:
    """A V2000 block; aromatic bonds (4) become Kekule forms and are found anew."""
    lines = block.split("\n")
    if len(lines) < 4:
        raise SmilesError("a short block")
    na, nb = int(lines[3][:3]), int(lines[3][3:6])
    m, points = Molecule(), []
    for line in lines[4 : 4 + na]:
        points.append((float(line[:10]), float(line[10:20]), float(line[20:30])))
        symbol = line[31:34].strip()
        charge = _CHARGES.get(int(line[36:39] or 0), 0) if len(line) >= 39 else 0
        m.add_atom(Atom(_symbol(symbol), charge, {"D": 2, "T": 3}.get(symbol, 0)))
    for line in lines[4 + na : 4 + na + nb]:
        a, b, kind = int(line[:3]) - 1, int(line[3:6]) - 1, int(line[6:9])
        m.add_bond(a, b, 1 if kind == 4 else kind, kind == 4)
        if kind == 4:
            m.atoms[a].aromatic = m.atoms[b].aromatic = True
    for line in lines[4 + na + nb :]:
        if line.startswith("M  CHG") or line.startswith("M  ISO"):
            t = list(map(int, line[6:].split()))[1:]
            for i, v in zip(t[::2], t[1::2]):
                setattr(m.atoms[i - 1], "charge" if line[3:6] == "CHG" else "isotope", v)
    return Structure(lines[0].strip(), _finish(m), points)


def _finish(m: Molecule) -> Molecule:
    """Explicit hydrogens on heavy atoms folded in, aromaticity found."""
    for a in m.atoms:
        if a.symbol not in NUMBER:
            raise SmilesError(f"no element {a.symbol}")
        if a.symbol == "H":
            a.hydrogens = 0
    m.kekulize()
    m.perceive_aromaticity()
    return m


def without_hydrogens(m: Molecule) -> Molecule:
    """Plain hydrogens with one neighbour left out; they stay counted."""
    keep = [i for i, a in enumerate(m.atoms) if a.symbol != "H" or a.isotope or len(m.adjacent[i]) != 1]
    extra = {i: sum(m.atoms[n].symbol == "H" and n not in set(keep) for n in m.neighbours(i)) for i in keep}
    total = {i: m.hydrogens(i) + extra[i] for i in keep}
    out = m.subset(keep)
    for new, old in enumerate(keep):
        if out.atoms[new].symbol != "H":
            out.atoms[new].hydrogens = total[old]
    return out


def write_mdl(s: Structure) -> str:
    m = s.molecule
    points = s.points or [(0.0, 0.0, 0.0)] * len(m.atoms)
    out = [s.name, "", "", f"{len(m.atoms):3d}{len(m.bonds):3d}  0  0  0  0            999 V2000"]
    out += [f"{x:10.4f}{y:10.4f}{z:10.4f} {a.symbol:<3} 0  0  0  0  0" for a, (x, y, z) in zip(m.atoms, points)]
    out += [f"{b.a + 1:3d}{b.b + 1:3d}{b.order:3d}  0" for b in m.bonds]
    for key, tag in (("charge", "CHG"), ("isotope", "ISO")):
        some = [(i + 1, getattr(a, key)) for i, a in enumerate(m.atoms) if getattr(a, key)]
        for k in range(0, len(some), 8):
            part = some[k : k + 8]
            out.append(f"M  {tag}{len(part):3d}" + "".join(f" {i:3d} {v:3d}" for i, v in part))
    return "\n".join([*out, "M  END"]) + "\n"


def write_sdf(s: Structure, tags: dict[str, str]) -> str:
    return write_mdl(s) + "".join(f">  <{k}>\n{v}\n\n" for k, v in tags.items()) + "$$$$\n"


def read_xyz(block: str, bonds: bool = True) -> Structure:
    """Symbols and coordinates; bonds from distances if asked."""
    from ferrule.chem.geometry import bonds_from_geometry

    import numpy as np

    lines = block.split("\n")
    n = int(lines[0])
    m, points = Molecule(), []
    for line in lines[2 : 2 + n]:
        t = line.split()
        m.add_atom(Atom(_symbol(t[0]), hydrogens=0))
        points.append(tuple(map(float, t[1:4])))
    if bonds and n:
        for i, j in bonds_from_geometry([a.symbol for a in m.atoms], np.array(points)):
            m.add_bond(i, j)
    return Structure(lines[1].strip(), m, points)


def read_mol2(block: str) -> Structure:
    m, points, part, name = Molecule(), [], "", ""
    count = 0
    for line in block.split("\n"):
        if line.startswith("@<TRIPOS>"):
            part, count = line[9:].strip(), 0
        elif line.strip():
            t = line.split()
            if part == "MOLECULE" and count == 0:
                name = line.strip()
            elif part == "ATOM":
                points.append(tuple(map(float, t[2:5])))
                m.add_atom(Atom(_symbol(t[5].split(".")[0])))
            elif part == "BOND":
                a, b, kind = int(t[1]) - 1, int(t[2]) - 1, t[3]
                m.add_bond(a, b, int(kind) if kind.isdigit() else 1, kind == "ar")
                if kind == "ar":
                    m.atoms[a].aromatic = m.atoms[b].aromatic = True
            count += 1
    return Structure(name, _finish(m), points)


def read_pdb(block: str) -> Structure:
    """ATOM and HETATM records with CONECT bonds."""
    m, points, number, name = Molecule(), [], {}, ""
    for line in block.split("\n"):
        if line.startswith(("ATOM", "HETATM")):
            number[int(line[6:11])] = len(m.atoms)
            points.append((float(line[30:38]), float(line[38:46]), float(line[46:54])))
            m.add_atom(Atom(_symbol(line[76:78].strip() or line[12:14].strip().strip("0123456789"))))
        elif line.startswith("HEADER"):
            name = line[10:].strip()
        elif line.startswith("CONECT"):
            ends = [int(line[k : k + 5]) for k in range(6, len(line.rstrip()), 5)]
            for e in ends[1:]:
                a, b = number[ends[0]], number[e]
                if m.bond_between(a, b) is None:
                    m.add_bond(a, b)
    return Structure(name, _finish(m), points)


READERS = {"mdl": read_mdl, "xyz": read_xyz, "mol2": read_mol2, "pdb": read_pdb}


def blocks_to_smiles(df: DataFrame, column: str, fmt: str = "mdl", hydrogens: bool = False) -> DataFrame:
    """``df`` with name and smiles of each block, null where it cannot be read."""
    read = READERS[fmt]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            names, smiles = [], []
            for b in f[column]:
                try:
                    s = read(b)
                    names.append(s.name)
                    smiles.append((s.molecule if hydrogens else without_hydrogens(s.molecule)).smiles())
                except (SmilesError, ValueError, IndexError, KeyError, TypeError, AttributeError):
                    names.append(None)
                    smiles.append(None)
            yield f.assign(mol_name=names, smiles=smiles)

    schema = ", ".join([*(f"`{c.name}` {c.dataType.simpleString()}" for c in df.schema), "mol_name string, smiles string"])
    return df.mapInPandas(run, schema)
