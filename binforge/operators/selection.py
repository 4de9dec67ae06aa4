"""Selection cuts as one predicate; cuts on columns that a table lacks are left out."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binforge.functions.scalar import quoted

#: Each cut's key, its column, and how value and threshold are compared.
CUTS = {
    "pt_1_min": ("pt_1", "above"),
    "pt_2_min": ("pt_2", "above"),
    "eta_1_abs_max": ("eta_1", "within"),
    "eta_2_abs_max": ("eta_2", "within"),
    "decayModePNet_2_eq": ("decayModePNet_2", "equal"),
    "idDeepTau2018v2p5VSjet_2_min": ("idDeepTau2018v2p5VSjet_2", "least"),
    "idDeepTau2018v2p5VSe_2_min": ("idDeepTau2018v2p5VSe_2", "least"),
    "idDeepTau2018v2p5VSmu_2_min": ("idDeepTau2018v2p5VSmu_2", "least"),
    "iso_1_max": ("iso_1", "below"),
    "ip_LengthSig_1_abs_min": ("ip_LengthSig_1", "beyond"),
}


def _no_nan(c: Column, kind: str) -> Column:
    # Spark sorts NaN above every number; it must not pass a lower bound.
    return ~F.isnan(c) if kind in ("double", "float") else F.lit(True)


def cut(column: str, how: str, threshold: float, kind: str = "double") -> Column:
    """One cut. Comparisons with literals on the bare column, so they reach the scan."""
    c = quoted(column)
    real, whole = F.lit(float(threshold)), F.lit(int(threshold))
    if how == "above":
        return (c > real) & _no_nan(c, kind)
    if how == "below":
        return c < real
    if how == "within":
        return (c < real) & (c > F.lit(-float(threshold)))
    if how == "beyond":
        return ((c > real) & _no_nan(c, kind)) | (c < F.lit(-float(threshold)))
    if how == "equal":
        return c == whole
    if how == "least":
        return (c >= whole) & _no_nan(c, kind)
    raise ValueError(f"unknown comparison {how!r}")


def columns_used(cuts: dict[str, float]) -> list[str]:
    return [CUTS[k][0] for k in cuts if k in CUTS and cuts[k] is not None]


def predicate(cuts: dict[str, float] | None, types: dict[str, str]) -> Column | None:
    """All cuts whose column is in ``types`` (name: type), or None if there are none."""
    made = [cut(column, how, cuts[k], types[column]) for k, (column, how) in CUTS.items() if (cuts or {}).get(k) is not None and column in types]
    return reduce(lambda a, b: a & b, made) if made else None


def select(df: DataFrame, cuts: dict[str, float] | None) -> DataFrame:
    found = predicate(cuts, dict(df.dtypes))
    return df if found is None else df.where(found)


def selector(cuts: dict[str, float] | None) -> Callable[[DataFrame], DataFrame]:
    """For ``df.transform``."""
    return lambda df: select(df, cuts)


def trigger(columns: Iterable[str], triggers: tuple[str, ...] = ("trg_singlemuon", "trg_mt_cross")) -> Column:
    """True if any trigger fired among those that exist, or if none exists."""
    found = [F.coalesce(quoted(t) == 1, F.lit(False)) for t in triggers if t in columns]
    return reduce(lambda a, b: a | b, found) if found else F.lit(True)


def region(columns: Iterable[str], name: str = "os") -> Column:
    """OS for 1, SS for 0, null for anything else; OS throughout for tables without the column."""
    return F.when(quoted(name) == 1, "OS").when(quoted(name) == 0, "SS") if name in columns else F.lit("OS")
