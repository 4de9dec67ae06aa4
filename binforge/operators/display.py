"""Tables of an event display: legs, pions and their directions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binforge.functions.scalar import along, direction, vertex
from binforge.operators.lookups import first_existing, leg_kind, pion_list

#: Colours of neutral and charged pions, and how far along a leg its decay lies.
NEUTRAL, CHARGED = "magenta", "lime"
DECAY = 0.4


def _leg(columns: list[str], suffix: str, length: float) -> Column:
    pt, eta, phi = (first_existing(columns, k, suffix) for k in ("pt", "eta", "phi"))
    origin = F.struct(*[F.lit(0.0).alias(k) for k in "xyz"])
    way = direction(pt, eta, phi)
    pions = pion_list(columns, suffix)
    start = vertex(origin, way, DECAY)

    def track(p: Column) -> Column:
        own = direction(p["pt"], p["eta"], p["phi"])
        colour = F.when(p["type"] == "pi0", NEUTRAL).otherwise(CHARGED)
        return F.struct(p["type"].alias("type"), colour.alias("color"), p["energy"].alias("energy"), p["charge"].alias("charge"), along(start, own, length).alias("end"))

    return F.struct(F.lit(suffix).alias("leg"), leg_kind(pions).alias("kind"), along(origin, way, length).alias("end"), start.alias("vertex"), F.transform(pions, track).alias("pions"))


def legs(events: DataFrame, keep: list[str], length: float = 1.0, suffixes: tuple[str, ...] = ("1", "2")) -> DataFrame:
    """``keep`` columns and a row for each leg: kind (muon, or tau if it has pions), end, decay vertex, and its pions' tracks."""
    made = F.array(*[_leg(events.columns, s, length) for s in suffixes])
    return events.select(*keep, F.explode(made).alias("l")).select(*keep, "l.*")


#: Length, radius and colour of the cones of muons, taus and pions.
CONES = {"muon": (1.8, 0.05, "#00FFFF"), "tau": (0.4, 0.08, "white"), "pion": (1.2, 0.15, None)}
_AXIS = 1e-8  # nearness to the z axis at which a way counts as along it


def rotated(x: Column, y: Column, z: Column, way: Column) -> dict[str, Column]:
    """A point after the rotation that takes the z axis to ``way``, a unit vector (Rodrigues); opposite to it, the point's reflection."""
    dx, dy, dz = way["x"], way["y"], way["z"]
    # With v = axis x way and q = v x p the rotated point is p + q + (v x q) / (1 + dz); below, 1 + dz is |v|^2 / (1 - dz).
    turn = F.when(dz < 0, (1 - dz) / (dx * dx + dy * dy)).otherwise(F.lit(1.0) / (1 + dz))
    q = {"x": dx * z, "y": dy * z, "z": -(dx * x + dy * y)}
    back = {"x": dx * q["z"], "y": dy * q["z"], "z": -(dx * q["x"] + dy * q["y"])}
    straight = (F.abs(dx) <= _AXIS) & (F.abs(dy) <= _AXIS)
    return {k: F.when(straight, F.when(dz > 0, p).otherwise(-p)).otherwise(p + q[k] + back[k] * turn) for k, p in (("x", x), ("y", y), ("z", z))}


def cones(rows: DataFrame, n: int = 20) -> DataFrame:
    """``rows`` (origin and way as structs x, y, z; length, radius) with a row for each of n x n vertices: i along the cone, j around it, x, y, z.

    A cone has its tip at the origin and widens along the way, which is a unit vector; zero ways have no cone.
    """
    way = F.col("way")
    there = rows.where((way["x"] != 0) | (way["y"] != 0) | (way["z"] != 0))
    grid = there.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    part, angle = F.col("i") / (n - 1), F.col("j") * (2 * math.pi / (n - 1))
    wide = F.col("radius") * part
    p = rotated(wide * F.cos(angle), wide * F.sin(angle), F.col("length") * part, way)
    return grid.withColumns({k: F.col("origin")[k] + x for k, x in p.items()})


def meshes(events: DataFrame, keep: list[str], n: int = 20, suffixes: tuple[str, ...] = ("1", "2")) -> DataFrame:
    """``keep`` columns, leg, part (muon, tau or a pion's type), color, i, j, x, y, z: the vertices of an event display's cones.

    A muon's starts at the origin; a tau's as well, and its pions' where it decays.
    """
    columns = events.columns
    origin = F.struct(*[F.lit(0.0).alias(k) for k in "xyz"])

    def cone(leg: str, part: Column, at: Column, way: Column, kind: str, color: Column) -> Column:
        length, radius, _ = CONES[kind]
        return F.struct(F.lit(leg).alias("leg"), part.alias("part"), color.alias("color"), at.alias("origin"), way.alias("way"), F.lit(length).alias("length"), F.lit(radius).alias("radius"))

    def leg(s: str) -> Column:
        way = direction(*(first_existing(columns, k, s) for k in ("pt", "eta", "phi")))
        pions = pion_list(columns, s)
        end = along(origin, way, CONES["tau"][0])
        own = F.transform(pions, lambda p: cone(s, p["type"], end, direction(p["pt"], p["eta"], p["phi"]), "pion", F.when(p["type"] == "pi0", NEUTRAL).otherwise(CHARGED)))
        muon, tau = (F.array(cone(s, F.lit(k), origin, way, k, F.lit(CONES[k][2]))) for k in ("muon", "tau"))
        return F.when(leg_kind(pions) == "muon", muon).otherwise(F.concat(tau, own))

    parts = events.select(*keep, F.explode(F.flatten(F.array(*map(leg, suffixes)))).alias("_c")).select(*keep, "_c.*")
    return cones(parts, n).select(*keep, "leg", "part", "color", "i", "j", "x", "y", "z")


def cylinder(spark: SparkSession, radius: float = 2.0, length: float = 4.0, along_: int = 50, around: int = 100) -> DataFrame:
    """i, j, x, y, z: the vertices of the detector, a cylinder around the z axis."""
    grid = spark.range(along_ * around).select((F.col("id") / around).cast("int").alias("i"), (F.col("id") % around).cast("int").alias("j"))
    angle = F.col("j") * (2 * math.pi / (around - 1))
    return grid.select("i", "j", (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"), (F.col("i") * (length / (along_ - 1)) - length / 2).alias("z"))
