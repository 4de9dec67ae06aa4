"""Column expressions: finite checks, angles, weights, ratios and uncertainties."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    """A column by its full name; names may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def finite(c: Column) -> Column:
    """True for numbers other than NaN and the infinities; null counts as not finite."""
    c = c.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))


def wrapped(delta: Column) -> Column:
    """An angle difference in [-pi, pi), by floored modulo."""
    turn = 2 * math.pi
    shifted = delta + F.lit(math.pi)
    return shifted - F.lit(turn) * F.floor(shifted / F.lit(turn)) - F.lit(math.pi)


def relative(reco: Column, truth: Column) -> Column:
    """(reco - truth) / truth, null where truth is 0."""
    return F.when(truth != 0, (reco - truth) / truth)


def mc_weight(xs: Column, eff: Column, filter_eff: Column, lumi: Column | float) -> Column:
    """Cross section times luminosity times filter efficiency over generated events.

    0 where eff is 0; 1 where a field or the whole entry is missing.
    """
    lumi = lumi if isinstance(lumi, Column) else F.lit(float(lumi))
    return F.coalesce(F.when(eff == 0, F.lit(0.0)).otherwise(xs * lumi * filter_eff / eff), F.lit(1.0))


def params_key(sample: Column, explicit: Column | None = None) -> Column:
    """The explicit key, or the sample's name up to its first - and then its first _."""
    own = F.split_part(F.split_part(sample, F.lit("-"), F.lit(1)), F.lit("_"), F.lit(1))
    return own if explicit is None else F.coalesce(explicit, own)


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, and 0 where bottom is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def uncertainty(variance: Column) -> Column:
    return F.sqrt(F.greatest(variance, F.lit(0.0)))


def clean(c: Column) -> Column:
    """NaN and null as 0."""
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))


def direction(pt: Column, eta: Column, phi: Column, scale: float = 1.0) -> Column:
    """struct x, y, z: unit vector times scale; eta is held within 6; no length or a non-finite one gives zeros."""
    eta = F.greatest(F.lit(-6.0), F.least(F.lit(6.0), eta))
    xyz = {"x": pt * F.cos(phi), "y": pt * F.sin(phi), "z": pt * F.sinh(eta)}
    norm = F.sqrt(sum((v * v for v in list(xyz.values())[1:]), xyz["x"] * xyz["x"]))
    fine = F.coalesce(finite(norm) & (norm > 0), F.lit(False))
    return F.struct(*[F.when(fine, v / norm * F.lit(scale)).otherwise(F.lit(0.0)).alias(k) for k, v in xyz.items()])


def along(origin: Column, way: Column, length: Column | float) -> Column:
    """The end of a track: origin + way * length, of structs x, y, z."""
    length = length if isinstance(length, Column) else F.lit(float(length))
    return F.struct(*[(origin[k] + way[k] * length).alias(k) for k in "xyz"])


def vertex(start: Column, way: Column, distance: float = 0.4) -> Column:
    """The decay vertex: ``distance`` from the start along the normalised way."""
    norm = F.sqrt(way["x"] * way["x"] + way["y"] * way["y"] + way["z"] * way["z"])
    return F.struct(*[(start[k] + F.when(norm > 0, way[k] / norm * F.lit(distance)).otherwise(F.lit(0.0))).alias(k) for k in "xyz"])


#: Patterns of sample names and their groups, the first that matches.
GROUPS = [
    (r"^Muon\d+$", "data"),
    (r"^DYto", "DY"),
    (r"^(TT|TW|TbarW|TBbar|TbarB)", "tt"),
    (r"^Wto", "W+jets"),
]
OTHER_GROUP = "others"


def group_of(sample: Column) -> Column:
    found = F.lit(OTHER_GROUP)
    for pattern, group in reversed(GROUPS):
        found = F.when(sample.rlike(pattern), F.lit(group)).otherwise(found)
    return found


def file_name_of(name: Column) -> Column:
    """A name that is safe as a file's: anything but word characters, dots and hyphens becomes _."""
    return F.regexp_replace(name, r"[^\w.-]", "_")


def after_first(name: Column, mark: str = "_") -> Column:
    """What follows the first mark, or the whole name without one."""
    return F.regexp_replace(name, rf"^[^{mark}]*{mark}", "")
