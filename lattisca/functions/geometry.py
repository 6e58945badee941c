"""Geometry of points as column expressions: vectors are lists of three columns, lengths are smoothed by a small constant."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vector = list[Column]
EPS = 1e-3


def vector(prefix: str = "") -> Vector:
    return [F.col(f"{prefix}{c}") for c in "xyz"]


def minus(a: Vector, b: Vector) -> Vector:
    return [x - y for x, y in zip(a, b, strict=True)]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def unit(a: Vector, eps: float = EPS) -> Vector:
    size = F.sqrt(dot(a, a) + eps)
    return [x / size for x in a]


def length(a: Vector, b: Vector, eps: float = EPS) -> Column:
    d = minus(a, b)
    return F.sqrt(dot(d, d) + eps)


def _acos(value: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


def angle(i: Vector, j: Vector, k: Vector, eps: float = EPS, degrees: bool = False) -> Column:
    """At j, between i and k."""
    out = _acos(dot(unit(minus(i, j), eps), unit(minus(k, j), eps)))
    return F.degrees(out) if degrees else out


def dihedral(i: Vector, j: Vector, k: Vector, l: Vector, eps: float = EPS, degrees: bool = False) -> Column:  # noqa: E741
    """Between the planes of i, j, k and of j, k, l; the sign tells the turn."""
    ij, jk, kl = unit(minus(i, j), eps), unit(minus(j, k), eps), unit(minus(k, l), eps)
    first, second = unit(cross(ij, jk), eps), unit(cross(jk, kl), eps)
    out = F.signum(dot(ij, second)) * _acos(dot(first, second))
    return F.degrees(out) if degrees else out


def rbf(value: Column, low: float = 0.0, high: float = 30.0, n: int = 32) -> list[Column]:
    """Radial basis functions at even distances, as wide as they are apart."""
    width = (high - low) / (n - 1)
    return [F.exp(-F.pow((value - F.lit(low + i * width)) / F.lit(width), 2)) for i in range(n)]


def positional(value: Column, n: int = 32, periods: tuple[float, float] = (1.0, 1000.0)) -> list[Column]:
    """Cosines, then sines, of the value at periods that are even on a logarithmic scale."""
    half = n // 2
    logs = [math.log10(periods[0]) + (math.log10(periods[1]) - math.log10(periods[0])) * i / max(1, half - 1) for i in range(half)]
    turns = [F.lit(2 * math.pi / 10**p) * value for p in logs]
    return [F.cos(t) for t in turns] + [F.sin(t) for t in turns]


def internal_vectors(p: Vector, c: Vector, n: Vector) -> list[Vector]:
    """Unit vectors from a residue's middle atom to the phosphorus and to the base's nitrogen."""
    return [unit(minus(p, c)), unit(minus(n, c))]


def bead(code: Column, purine: str, pyrimidine: str, prefix: str = "xyz_") -> Column:
    """The coordinates of a backbone bead: an atom of its own for purines, another for all else; null where it is missing."""
    return F.when(F.upper(code).isin("A", "G"), F.col(f"{prefix}{purine}")).otherwise(F.col(f"{prefix}{pyrimidine}"))


def backbone_beads(code: Column, purine: list[str], pyrimidine: list[str], fill: float = 1e-5) -> tuple[Column, Column]:
    """An array of the beads' coordinates, missing ones filled, and whether all are there."""
    beads = [bead(code, a, b) for a, b in zip(purine, pyrimidine, strict=True)]
    whole = beads[0].isNotNull()
    for b in beads[1:]:
        whole = whole & b.isNotNull()
    return F.array(*[F.coalesce(b, F.array(*[F.lit(fill)] * 3)) for b in beads]), whole


def internal_coordinates(residues: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``dihedrals``, ``angles`` and ``lengths``, three each, and their masks, of residues with atoms P, C and N (columns
    ``px`` and so on) along the chain P-C-P-C and to N; 0 where the chain ends. Angles are complements, as a straight
    chain has none."""
    from pyspark.sql.window import Window

    by = Window.partitionBy(*keys).orderBy(order)
    at = lambda atom, k: [F.lag(f"{atom}{c}", -k).over(by) if k else F.col(f"{atom}{c}") for c in "xyz"]
    named = residues
    for k in (-1, 1, 2):
        named = named.withColumns({f"_{a}{k}{c}": v for a in "pc" for c, v in zip("xyz", at(a, k), strict=True)})
    get = lambda a, k: [F.col(f"_{a}{k}{c}" if k else f"{a}{c}") for c in "xyz"]
    p, c, n = get("p", 0), get("c", 0), get("n", 0)
    bent = lambda i, j, k: math.pi - angle(i, j, k)
    values = {
        "dihedrals": [dihedral(get("c", -1), p, c, get("p", 1)), dihedral(p, c, get("p", 1), get("c", 1)), dihedral(get("p", 1), n, c, p)],
        "angles": [bent(get("c", -1), p, c), bent(p, c, get("p", 1)), bent(p, c, n)],
        "lengths": [length(p, c), length(c, get("p", 1)), length(c, n)],
    }
    out = {}
    for name, some in values.items():
        out[name] = F.array(*[F.coalesce(v, F.lit(0.0)) for v in some])
        out[f"{name}_mask"] = F.array(*[v.isNotNull() for v in some])
    return named.withColumns(out).drop(*[f"_{a}{k}{c}" for a in "pc" for k in (-1, 1, 2) for c in "xyz"])
