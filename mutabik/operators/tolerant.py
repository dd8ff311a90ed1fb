"""Tolerant pass: near amounts and dates, accepted only where neither row has a choice.

Set-based: an agreeing reference decides first, then equal amounts without a reference. Rows alike in
all that counts are collapsed to one point with a count before anything is paired, and rivals are
counted in range frames over the points of one counterparty, direction and amount, so equal rows
never multiply into pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mutabik.config import DAY_US, HORIZON_DAYS, MATCH_WINDOW_DAYS
from mutabik.functions.scalars import basis_points, tolerant_limit, whole_days
from mutabik.operators.features import KEY, cells, minus, within
from mutabik.shared import shared_table

CLOSE = (MATCH_WINDOW_DAYS + 1) * DAY_US - 1
FAR = (HORIZON_DAYS + 1) * DAY_US - 1


def _points(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Rows alike in ``by``: their number and smallest id."""
    return rows.groupBy(*by).agg(F.count("*").alias(f"n_{name}"), F.min("tx_id").alias(f"id_{name}"))


def _agreeing(pool: DataFrame) -> DataFrame:
    """Edges between points under one reference: kind, e point, other point, with their counts."""
    pt = [*KEY, "direction", "amount", "us"]
    e = _points(pool.where("side = 0 and ref <> ''"), pt, "e").withColumnsRenamed({"amount": "e_amount", "us": "e_us"})
    b = _points(pool.where("source = 'bank' and ref <> ''"), pt, "o").withColumnsRenamed({"amount": "o_amount", "us": "o_us"})
    money = e.join(b, [*KEY, "direction"]).where(within(F.col("e_us"), F.col("o_us"), MATCH_WINDOW_DAYS) & (F.abs(F.col("e_amount") - F.col("o_amount")) <= tolerant_limit(F.col("e_amount"))))
    c = e.where("direction = 'credit' and e_amount > 0").drop("direction")
    d = e.where("direction = 'debit' and e_amount > 0").select(*KEY, "e_amount", F.col("e_us").alias("o_us"), F.col("n_e").alias("n_o"), F.col("id_e").alias("id_o"))
    back = c.join(d, [*KEY, "e_amount"]).where(within(F.col("e_us"), F.col("o_us"), MATCH_WINDOW_DAYS)).withColumn("o_amount", F.col("e_amount"))
    cols = ["id_e", "n_e", "id_o", "n_o", "e_amount", "o_amount", "e_us", "o_us", "kind"]
    return money.withColumn("kind", F.lit("tolerant")).select(*cols).unionByName(back.withColumn("kind", F.lit("reversal")).select(*cols))


def _isolated(edges: DataFrame) -> DataFrame:
    """Edges whose two rows have no other edge."""
    deg = edges.select(F.col("id_e").alias("p"), F.col("n_o").alias("n")).unionByName(edges.select(F.col("id_o").alias("p"), F.col("n_e").alias("n"))).groupBy("p").agg(F.sum("n").alias("deg"))
    one = deg.where("deg = 1").select("p")
    alone = edges.where("n_e = 1 and n_o = 1")
    return alone.join(one.select(F.col("p").alias("id_e")), "id_e", "left_semi").join(one.select(F.col("p").alias("id_o")), "id_o", "left_semi")


def _scored(edges: DataFrame) -> DataFrame:
    days = whole_days(F.col("e_us"), F.col("o_us"))
    bp = F.when((F.col("kind") == "tolerant") & (F.col("e_amount") > 0), basis_points(F.abs(F.col("e_amount") - F.col("o_amount")), F.col("e_amount"))).otherwise(0)
    return edges.select("kind", F.col("id_e").alias("e_id"), F.col("id_o").alias("a_id"), (F.lit(10000) - bp - days * 100).cast("bigint").alias("score_bp"))


def _frame(w: Window, reach: int) -> Window:
    return w.rangeBetween(-reach, reach)


def _reversible(pool: DataFrame) -> DataFrame:
    """tx_id of expected rows with an open opposite row that could reverse them (same or no reference)."""
    e = pool.where("side = 0 and amount > 0")
    w = Window.partitionBy("cp", "ref", "amount").orderBy("us")
    pts = e.groupBy("cp", "ref", "amount", "us").agg(F.count_if(F.col("direction") == "credit").alias("n_c"), F.count_if(F.col("direction") == "debit").alias("n_d"))
    near = pts.withColumn("near_c", F.sum("n_c").over(_frame(w, CLOSE))).withColumn("near_d", F.sum("n_d").over(_frame(w, CLOSE))).where("near_c > 0 and near_d > 0").drop("n_c", "n_d")
    j = e.select("tx_id", "cp", "ref", "amount", "us", "direction").join(near, ["cp", "ref", "amount", "us"])
    return j.where(F.when(F.col("direction") == "credit", F.col("near_d") > 0).otherwise(F.col("near_c") > 0)).select("tx_id")


def _horizon(pool: DataFrame) -> DataFrame:
    """Points of open rows without a claim by reference: n_e, n_o, id_e, id_o, and what lies within the horizon: far_e, far_o, mate."""
    at = ["cp", "direction", "amount", "us"]
    free = pool.where("not flagged and (side = 0 or source = 'bank')")
    e_side, b_side = F.col("side") == 0, F.col("source") == "bank"
    pts = free.groupBy(*at).agg(F.count_if(e_side).alias("n_e"), F.count_if(b_side).alias("n_o"), F.min(F.when(e_side, F.col("tx_id"))).alias("id_e"), F.min(F.when(b_side, F.col("tx_id"))).alias("id_o"))
    w = _frame(Window.partitionBy("cp", "direction", "amount").orderBy("us"), FAR)
    return pts.withColumn("far_e", F.sum("n_e").over(w)).withColumn("far_o", F.sum("n_o").over(w)).withColumn("mate", F.max(F.when(F.col("n_o") > 0, F.struct("id_o", F.col("us").alias("o_us")))).over(w))


def rivals(pool: DataFrame) -> DataFrame:
    """tx_id, rivals: rows of the other side with the same seller, direction and amount within the horizon."""
    rows = pool.where("not flagged and (side = 0 or source = 'bank')").select("tx_id", "side", "cp", "direction", "amount", "us")
    seen = _horizon(pool).select("cp", "direction", "amount", "us", "far_e", "far_o")
    j = rows.join(seen, ["cp", "direction", "amount", "us"])
    return j.select("tx_id", F.when(F.col("side") == 0, F.col("far_o")).otherwise(F.col("far_e")).alias("rivals"))


def _sole(pool: DataFrame) -> DataFrame:
    """Edges of equal amount without a reference in which each row is the other's only fit in the horizon."""
    seen = _horizon(pool)
    e = seen.where("n_e = 1 and far_o = 1").select("cp", "direction", "amount", F.col("us").alias("e_us"), "id_e", F.col("mate.id_o").alias("id_o"), F.col("mate.o_us").alias("o_us"))
    b = seen.where("n_o = 1 and far_e = 1").select("id_o")
    pairs = e.where(within(F.col("e_us"), F.col("o_us"), MATCH_WINDOW_DAYS)).join(b, "id_o", "left_semi")
    pairs = pairs.join(_reversible(pool).withColumnRenamed("tx_id", "id_e"), "id_e", "left_anti")
    return pairs.select("id_e", F.lit(1).alias("n_e"), "id_o", F.lit(1).alias("n_o"), F.col("amount").alias("e_amount"), F.col("amount").alias("o_amount"), "e_us", "o_us", F.lit("tolerant").alias("kind"))


def tolerant_matches(pool: DataFrame) -> DataFrame:
    """kind (tolerant or reversal), e_id, a_id, score_bp; for a reversal a_id is the debit."""
    first = shared_table(_scored(_isolated(_agreeing(pool))), "tolerant")
    used = first.select(F.col("e_id").alias("tx_id")).unionByName(first.select(F.col("a_id").alias("tx_id")))
    return first.unionByName(_scored(_sole(minus(pool, used))))


def contested(pool: DataFrame) -> DataFrame:
    """tx_id of open rows that still have an open edge of any strength."""
    e_pt = ["cp", "direction", "amount", "us"]
    e = pool.where("side = 0 and not flagged").select(*e_pt).distinct()
    b = pool.where("source = 'bank' and not flagged").select("cp", "direction", F.col("amount").alias("o_amount"), F.col("us").alias("o_us")).distinct()
    width = CLOSE + 1
    a_cell = lambda c: F.floor(F.log(F.greatest(c, F.lit(1)).cast("double")) / 0.01).cast("int")
    lim = tolerant_limit(F.col("amount"))
    ek = e.withColumn("dc", F.explode(cells(F.col("us"), width, CLOSE))).withColumn("ac", F.explode(F.sequence(a_cell(F.col("amount") - lim), a_cell(F.col("amount") + lim))))
    bk = b.withColumn("dc", F.floor(F.col("o_us") / F.lit(width)).cast("bigint")).withColumn("ac", a_cell(F.col("o_amount")))
    near = within(ek["us"], bk["o_us"], MATCH_WINDOW_DAYS) & (F.abs(ek["amount"] - bk["o_amount"]) <= tolerant_limit(ek["amount"]))
    same = (ek["cp"] == bk["cp"]) & (ek["direction"] == bk["direction"]) & (ek["dc"] == bk["dc"]) & (ek["ac"] == bk["ac"])
    e_hit = ek.join(bk, same & near, "left_semi").select(*e_pt).distinct()
    b_hit = bk.join(ek, same & near, "left_semi").select("cp", "direction", F.col("o_amount").alias("amount"), F.col("o_us").alias("us")).distinct()
    loose = pool.where("side = 0 and not flagged").join(e_hit, e_pt, "left_semi").select("tx_id").unionByName(pool.where("source = 'bank' and not flagged").join(b_hit, e_pt, "left_semi").select("tx_id"))
    agree = _agreeing(pool).where("kind = 'tolerant'")
    pt = [*KEY, "direction", "amount", "us"]
    ids = agree.select(F.col("id_e").alias("p")).unionByName(agree.select(F.col("id_o").alias("p"))).distinct()
    alike = pool.where("ref <> '' and (side = 0 or source = 'bank')").groupBy("side", *pt).agg(F.min("tx_id").alias("p")).join(ids, "p", "left_semi")
    tied = pool.where("side = 0 or source = 'bank'").join(alike, ["side", *pt], "left_semi").select("tx_id")
    return loose.unionByName(tied).unionByName(_reversible(pool)).distinct()
