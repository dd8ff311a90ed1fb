"""A seeded synthetic book with its ground truth, made by ``spark.range`` and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mutabik.schema import conform

#: Amounts of one seller's injected rows lie at least two per cent apart, so injections don't meet.
STEPS = 300
CLEAN_SELLERS = 300


def _h(seed: int, salt: int, lo: int, hi: int) -> Column:
    """A number in lo..hi that the seed, the salt and the row's i decide."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "i"), F.lit(hi - lo + 1)) + lo).cast("bigint")


def generate(spark: SparkSession, seed: int, n: int) -> tuple[DataFrame, DataFrame]:
    """(book, truth) of about n rows. truth: tx_id, label, want_type.

    Slot i % 100 of each pair gives its shape: 0 short by a fee, 1 short by more, 2 late, 3 exported
    twice, 4 never paid, 5-6 refunded, 7 beside a stranger's line, 8 without a reference, 9 two equal
    orders with two equal unreferenced lines, 10 paid in two parts, 11 voided, 12 short beside a
    missing order of that amount, 13 two equal ones both late, the others clean. A third of the rows
    are payouts of 2 to 8 orders, every twentieth with a stray equal order.
    """
    pairs, groups = max(1, int(n * 1.1 * 0.35)), max(1, int(n * 0.3 / 6))
    slot, k = F.col("i") % 100, F.floor(F.col("i") / 100)
    p = spark.range(pairs).withColumnRenamed("id", "i").withColumn("slot", slot)
    injected = F.col("slot") <= 13
    cp = F.when(injected, F.concat_ws("-", F.lit("inj"), F.col("slot"), F.floor(k / STEPS))).otherwise(F.concat(F.lit("seller-"), _h(seed, 1, 1, CLEAN_SELLERS)))
    amount = F.when(injected, F.floor(F.lit(1000.0) * F.pow(F.lit(1.02), k % STEPS)) * 10).otherwise(_h(seed, 2, 1000, 500_999)).cast("bigint")
    p = p.withColumn("cp", cp).withColumn("amount", amount).withColumn("day", _h(seed, 3, 0, 29)).withColumn("ref", F.concat(F.lit("TX-"), F.col("i").cast("string")))
    p = p.withColumn("fee", F.floor(F.col("amount") * _h(seed, 4, 900, 2400) / 10_000).cast("bigint")).withColumn("cut", F.floor(F.col("amount") * _h(seed, 5, 30, 70) / 100).cast("bigint"))
    p = p.withColumn("lag", _h(seed, 6, 0, 3)).withColumn("late", _h(seed, 7, 4, 10))
    amt, day, ref, s = F.col("amount"), F.col("day"), F.col("ref"), F.col("slot")

    def row(when: Column, off: int, source: str, a: Column, d: Column, r: Column = ref, direction: str = "credit", want: Column | None = None, label: Column | None = None, who: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        return F.when(
            when,
            F.struct(
                (F.col("i") * 10 + off).alias("tx_id"), F.lit(source).alias("source"), r.alias("external_ref"), (F.col("cp") if who is None else who).alias("counterparty_ref"),
                a.cast("bigint").alias("amount"), d.cast("int").alias("d"), F.lit(direction).alias("direction"), (none if want is None else want).alias("want_type"), (none if label is None else label).alias("label"),
            ),
        )

    w = lambda *cases: _case(s, cases)
    own, empty = F.concat(F.lit("p"), F.col("i").cast("string")), F.lit("")
    clean = ~s.isin(0, 1, 2, 4, 9, 11, 12, 13)
    rows = [
        row(F.lit(True), 0, "psp", amt, day, want=w((0, "commission"), (1, "partial"), (2, "timing"), (4, "missing"), (9, "ambiguous"), (12, "partial"), (13, "timing")), label=F.when(clean | (s == 11), own)),
        row(s == 3, 1, "psp", amt, day, want=F.lit("duplicate")),
        row(s == 9, 1, "psp", amt, day, F.concat(ref, F.lit("B")), want=F.lit("ambiguous")),
        row(s == 11, 1, "psp", amt, day + 1, direction="debit", label=own),
        row(s == 12, 1, "psp", amt - F.col("cut"), day, F.concat(ref, F.lit("M")), want=F.lit("missing")),
        row(clean & (s != 8) & (s != 10), 5, "bank", amt, day + F.col("lag"), label=own),
        row(s == 8, 5, "bank", amt, day + F.col("lag"), empty, label=own),
        row(s == 10, 5, "bank", F.col("cut"), day + 1, label=own),
        row(s == 10, 6, "bank", amt - F.col("cut"), day + 2, label=own),
        row(s == 0, 5, "bank", amt - F.col("fee"), day + 1, want=F.lit("commission")),
        row(s.isin(1, 12), 5, "bank", amt - F.col("cut"), day + 1, want=F.lit("partial")),
        row(s.isin(2, 13), 5, "bank", amt, day + F.col("late"), want=F.lit("timing")),
        row(s.isin(5, 6), 6, "bank", amt, day + 4, direction="debit", want=F.lit("refund")),
        row(s == 7, 6, "bank", amt, day, F.concat(F.lit("X-"), ref), want=F.lit("unknown"), who=F.concat(F.lit("stranger-"), F.col("i").cast("string"))),
        row(s == 9, 5, "bank", amt, day + 1, empty, want=F.lit("ambiguous")),
        row(s == 9, 6, "bank", amt, day + 1, empty, want=F.lit("ambiguous")),
    ]
    flat = p.select(F.explode(F.array_compact(F.array(*rows))).alias("r")).select("r.*").withColumn("gross", F.lit(None).cast("bigint")).withColumn("commission", F.lit(None).cast("bigint"))
    base = pairs * 10
    g = spark.range(groups).withColumnRenamed("id", "i").withColumn("m", _h(seed, 8, 2, 8)).withColumn("second", F.col("i") % 2)
    g = g.withColumn("cp", F.concat(F.lit("shop-"), F.floor(F.col("i") / 2).cast("string"))).withColumn("day", F.col("second") * 35).withColumn("stray", F.col("i") % 20 == 19)
    each = g.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("m").cast("int")))).withColumn("a", F.pmod(F.xxhash64(F.lit(seed), F.lit(9), "i", "j"), F.lit(500_000)) + 1000)
    lab, want = F.when(~F.col("stray"), F.concat(F.lit("g"), F.col("i").cast("string"))), F.when(F.col("stray"), "ambiguous")

    def grow(off: Column, source: str, r: Column, a: Column, d: Column, gross: Column, fee: Column) -> list[Column]:
        return [
            (F.col("i") * 20 + off + base).alias("tx_id"), F.lit(source).alias("source"), r.alias("external_ref"), F.col("cp").alias("counterparty_ref"), a.cast("bigint").alias("amount"), d.cast("int").alias("d"),
            F.lit("credit").alias("direction"), want.alias("want_type"), lab.alias("label"), gross.cast("bigint").alias("gross"), fee.cast("bigint").alias("commission"),
        ]

    no = F.lit(None)
    orders = each.select(*grow(F.col("j"), "psp", F.concat(F.lit("G-"), F.col("i").cast("string"), F.lit("-"), F.col("j").cast("string")), F.col("a"), F.col("day") + F.col("j") % 5, no, no))
    strays = each.where("stray and j = 1").select(*grow(F.lit(15), "psp", F.concat(F.lit("GS-"), F.col("i").cast("string")), F.col("a"), F.col("day") + 1, no, no))
    sums = each.groupBy("i", "cp", "day", "stray").agg(F.sum("a").cast("bigint").alias("g")).withColumn("f", F.floor(F.col("g") * _h(seed, 10, 800, 2500) / 10_000))
    payouts = sums.select(*grow(F.lit(0), "marketplace", F.concat(F.lit("PAY-"), F.col("i").cast("string")), F.col("g") - F.col("f"), F.col("day") + 7, F.col("g"), F.col("f")))
    everything = flat.unionByName(orders).unionByName(strays).unionByName(payouts)
    at = F.timestamp_seconds(F.lit(1_780_272_000) + F.col("d").cast("bigint") * 86_400)  # from 2026-06-01
    book = conform(everything.withColumn("occurred_at", at).withColumn("currency", F.lit("TRY")))
    return book, everything.select("tx_id", "label", "want_type")


def _case(s: Column, cases: tuple) -> Column:
    out = F.lit(None).cast("string")
    for v, name in cases:
        out = F.when(s == v, name).otherwise(out)
    return out
