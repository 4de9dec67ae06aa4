"""A virtual event table over the star schema, in Spark and in SQL, so every operator runs on the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binforge.functions.binning import Binning
from binforge.functions.scalar import finite

CUTS = {"pt_1_min": 25, "pt_2_min": 20, "eta_1_abs_max": 2.4, "eta_2_abs_max": 2.3, "iso_1_max": 0.15}
BINS = {
    "pt_1": Binning.of_width(20, 120, 2.5),
    "pt_2": Binning.of_width(20, 120, 2.5),
    "mt_tot": Binning.of_width(0, 200, 5),
    "eta_1": Binning.of_width(-2.5, 2.5, 0.1),
    "iso_1": Binning.of_width(0, 0.2, 0.01),
}
RES = Binning(-1.0, 1.0, 20)
ANGLE = Binning(-math.pi, math.pi, 20)
PHASE = Binning(0.0, 2 * math.pi, 20)
COLUMNS = ["pt_1", "pt_2", "eta_1", "eta_2", "iso_1", "mt_tot"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples' dimension: sample, process, kind, scale and w_mc of each nation."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    kind = F.when(F.col("r_name") == "ASIA", "data").otherwise("mc")
    return n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(
        "n_nationkey", F.col("n_name").alias("sample"), F.col("r_name").alias("process"), kind.alias("kind"), (F.lit(0.5) + F.lit(0.25) * F.pmod("n_nationkey", F.lit(4))).alias("scale"),
        F.when(kind == "data", 1.0).otherwise((F.col("n_nationkey") + 1) * F.lit(0.1)).alias("w_mc"),
    )


def events(spark: SparkSession, sf_dir: str, nations: DataFrame | None = None) -> DataFrame:
    """One row a line item. The nations (``regions`` unless given) are a fixed 25 rows and broadcast; the three large tables are joined by key."""
    line, order, customer = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    joined = line.join(order, line["l_orderkey"] == order["o_orderkey"]).join(customer, order["o_custkey"] == customer["c_custkey"])
    joined = joined.join(F.broadcast(regions(spark, sf_dir) if nations is None else nations), F.col("c_nationkey") == F.col("n_nationkey"))
    flag = F.col("l_returnflag")
    return joined.select(
        "l_orderkey", "l_linenumber", "sample", "process", "kind", "scale", "w_mc",
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("os"), F.when(flag == "R", 1).otherwise(0).alias("trg_singlemuon"), F.when(flag == "A", 1).otherwise(0).alias("trg_mt_cross"),
        (1 - F.col("l_discount")).alias("weight"), (F.col("l_extendedprice") / 1000).alias("pt_1"), F.col("l_quantity").alias("pt_2"), ((F.col("l_discount") - 0.05) * 50).alias("eta_1"),
        ((F.col("l_tax") - 0.04) * 60).alias("eta_2"), F.col("l_tax").alias("iso_1"), (F.col("o_totalprice") / 2500).alias("mt_tot"), ((F.col("l_tax") - 0.04) * 100).alias("ip_LengthSig_1"),
        F.col("l_linenumber").alias("decayModePNet_2"), F.col("l_linenumber").alias("idDeepTau2018v2p5VSjet_2"), F.col("l_linenumber").alias("idDeepTau2018v2p5VSe_2"), F.col("l_linenumber").alias("idDeepTau2018v2p5VSmu_2"),
    )


def number(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


EVENTS_SQL = f"""
ev AS (
  SELECT l_orderkey, l_linenumber, n_name AS sample, r_name AS process, CASE WHEN r_name = 'ASIA' THEN 'data' ELSE 'mc' END AS kind,
    {number(0.5)} + {number(0.25)} * (n_nationkey % 4) AS scale, CASE WHEN r_name = 'ASIA' THEN {number(1)} ELSE (n_nationkey + 1) * {number(0.1)} END AS w_mc,
    CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS os, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS trg_singlemuon, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS trg_mt_cross,
    1 - l_discount AS weight, l_extendedprice / 1000 AS pt_1, l_quantity AS pt_2, (l_discount - {number(0.05)}) * 50 AS eta_1, (l_tax - {number(0.04)}) * 60 AS eta_2, l_tax AS iso_1,
    o_totalprice / 2500 AS mt_tot, (l_tax - {number(0.04)}) * 100 AS ip
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

CUTS_SQL = f"pt_1 > 25 AND pt_2 > 20 AND eta_1 < {number(2.4)} AND eta_1 > {number(-2.4)} AND eta_2 < {number(2.3)} AND eta_2 > {number(-2.3)} AND iso_1 < {number(0.15)}"


def bins_sql(binnings: dict[str, Binning], name: str = "bins") -> str:
    rows = [f"('{v}', {i}, {number(b.edges[i])}, {number(b.edges[i + 1])}, {str(i == b.n - 1).lower()})" for v, b in binnings.items() for i in range(b.n)]
    return f"{name}(var, bin, lo, hi, fin) AS (VALUES {', '.join(rows)})"


def values_sql(columns: list[str], extra: str = "process", source: str = "ev") -> str:
    """One row a value: var, x, and the columns of ``extra``."""
    return " UNION ALL ".join(f"SELECT '{c}' AS var, CAST({c} AS DOUBLE) AS x, {extra} FROM {source}" for c in columns)


IN_BIN = "b.var = v.var AND v.x >= b.lo AND (v.x < b.hi OR (b.fin AND v.x = b.hi))"


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles and weights over the stream table: phase of the day, its shifted twin, and a finite value."""
    e = table(spark, sf_dir, "events")
    day = F.expr("hour(ts) * 3600 + minute(ts) * 60 + second(ts)").cast("double") / 86400
    e = e.select("event_id", "event_type", "value", (day * F.lit(2 * math.pi)).alias("phi_1"), (F.pmod(F.col("user_id"), F.lit(97)).cast("double") / 97 * F.lit(2 * math.pi) - F.lit(math.pi)).alias("phi_2"))
    return e.where(finite(F.col("value")))


PHASES_SQL = f"""
ph AS (
  SELECT event_id, event_type, value, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) / 86400 * {number(2 * math.pi)} AS phi_1,
    CAST(((user_id % 97) + 97) % 97 AS DOUBLE) / 97 * {number(2 * math.pi)} - {number(math.pi)} AS phi_2
  FROM events WHERE value IS NOT NULL AND isfinite(value)
)"""
