"""Coordinates: distances, angles, torsions, superposition, clashes and bond-length statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Covalent radii in angstrom.
RADII = {"H": 0.31, "B": 0.84, "C": 0.76, "N": 0.71, "O": 0.66, "F": 0.57, "Si": 1.11, "P": 1.07, "S": 1.05, "Cl": 1.02, "Br": 1.20, "I": 1.39}


def distance(a, b) -> float:
    return float(np.linalg.norm(np.subtract(a, b)))


def angle(a, b, c) -> float:
    """Degrees at b."""
    u, v = np.subtract(a, b), np.subtract(c, b)
    return float(np.degrees(np.arccos(np.clip(u @ v / np.linalg.norm(u) / np.linalg.norm(v), -1, 1))))


def dihedral(a, b, c, d) -> float:
    """Degrees about b-c, from -180 to 180."""
    x, y, z = np.subtract(b, a), np.subtract(c, b), np.subtract(d, c)
    n1, n2 = np.cross(x, y), np.cross(y, z)
    return float(np.degrees(np.arctan2(np.linalg.norm(y) * (x @ n2), n1 @ n2)))


def superpose(moving: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, float]:
    """``moving`` turned and shifted onto ``fixed``, and the root mean square distance left."""
    moving, fixed = np.asarray(moving, float), np.asarray(fixed, float)
    a, b = moving - moving.mean(0), fixed - fixed.mean(0)
    u, _, vt = np.linalg.svd(a.T @ b)
    flip = np.diag([1, 1, np.sign(np.linalg.det(u @ vt))])
    out = a @ (u @ flip @ vt) + fixed.mean(0)
    return out, float(np.sqrt(((out - fixed) ** 2).sum(1).mean()))


def bumps(points: np.ndarray, bonded: set[frozenset[int]], limit: float) -> list[tuple[int, int]]:
    """Pairs of atoms nearer than ``limit`` that share no bond."""
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    return [(i, j) for i, j in zip(*np.nonzero(np.triu(d < limit, 1))) if frozenset((int(i), int(j))) not in bonded]


def bonds_from_geometry(symbols: list[str], points: np.ndarray, slack: float = 0.3) -> list[tuple[int, int]]:
    """Atoms nearer than the sum of their radii and ``slack``."""
    r = np.array([RADII.get(s, 1.2) for s in symbols])
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    return [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(d < r[:, None] + r[None] + slack, 1)))]


def length(bond: str = "bond") -> Column:
    """Length of a struct with arrays ``p`` and ``q`` of three numbers."""
    return F.sqrt(F.aggregate(F.zip_with(f"{bond}.p", f"{bond}.q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def length_distribution(bonds: DataFrame, step: float = 0.01) -> DataFrame:
    """Rows (kind, bucket, n) of bonds (kind, length)."""
    return bonds.groupBy("kind", F.floor(F.col("length") / step + 1e-9).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def length_scores(bonds: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows (id, score): mean squared deviation of each molecule's bonds from the reference (kind, mean, sd), in units of sd."""
    z = (F.col("length") - F.col("mean")) / F.col("sd")
    return bonds.join(reference, "kind").groupBy("id").agg(F.avg(z * z).alias("score"))


def torsion_spread(torsions: DataFrame) -> DataFrame:
    """Rows (key, n, spread): circular spread of torsions in degrees over conformers: 0 all alike, 1 all about."""
    rad = F.radians("angle")
    r = F.sqrt(F.avg(F.cos(rad)) * F.avg(F.cos(rad)) + F.avg(F.sin(rad)) * F.avg(F.sin(rad)))
    return torsions.groupBy("key").agg(F.count(F.lit(1)).alias("n"), (1 - r).alias("spread"))
