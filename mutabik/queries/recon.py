"""Queries of the reconciliation cascade over the derived book; names follow the operator inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutabik.config import KINDS, TYPES
from mutabik.functions import scalars as S
from mutabik.operators import report
from mutabik.operators.exact import exact_pairs
from mutabik.operators.features import featured, minus
from mutabik.operators.split import split_members
from mutabik.operators.tolerant import contested, rivals
from mutabik.plans import invariants
from mutabik.plans.engine import Output, outcomes, run
from mutabik.queries import quality
from mutabik.queries.recon_sql import CASCADE
from mutabik.schema import money_fault
from mutabik.shared import shared_table, state
from mutabik.sources.derived import EXPECTED, derived_book, table_book

_runs: dict[tuple, tuple[DataFrame, Output]] = {}
#: Tables that a book is made of.
TABLES = {"derived": ("orders", "lineitem"), "tables": ("psp", "bank", "marketplace")}


def result(spark: SparkSession, sf_dir: str, source: str = "derived") -> tuple[DataFrame, Output]:
    """The book and its result; kept for the session while the files stay as they are, as the results are tables in the shared folder."""
    key = (spark.sparkContext.applicationId, source, *[state(spark, f"{sf_dir}/{t}.parquet") for t in TABLES[source]])
    if key not in _runs:
        book = (derived_book if source == "derived" else table_book)(spark, sf_dir)
        book = shared_table(book, "input-book")
        _runs[key] = (book, run(book))
    return _runs[key]


def truth(spark: SparkSession, book: DataFrame) -> DataFrame:
    """tx_id, label, want_type that the shapes of the derived book are meant to have."""
    e = spark.createDataFrame(EXPECTED, "slot int, off int, out string")
    slot, off = F.floor(F.col("tx_id") / 1000) % 20, F.col("tx_id") % 1000
    label = F.concat(F.lit("k"), F.floor(F.col("tx_id") / 1000).cast("string"))
    matched = F.col("out").isin(*KINDS)
    a = book.withColumn("_s", slot).withColumn("_o", off).join(F.broadcast(e), (F.col("_s") == F.col("slot")) & (F.col("_o") == F.col("off")))
    a = a.select("tx_id", F.when(matched, label).alias("label"), F.when(~matched, F.col("out")).alias("want_type"))
    return a.unionByName(book.where(slot == 9).select("tx_id", label.alias("label"), F.lit(None).cast("string").alias("want_type")))


def src8_book(spark, d):
    b = derived_book(spark, d)
    return b.select("tx_id", "source", "external_ref", "counterparty_ref", "amount", "currency", F.unix_micros("occurred_at").alias("us"), "direction", "gross", "commission")


def prd1_money_faults(spark, d):
    """Money rules over a book whose amounts, currencies and fees are spoilt in part."""
    b = derived_book(spark, d)
    m = F.col("tx_id") % 7
    x = b.withColumn("amount", F.when(m == 1, -F.col("amount")).otherwise(F.col("amount"))).withColumn("currency", F.when(m == 2, " TRY").otherwise(F.col("currency"))).withColumn("commission", F.when(m == 3, F.col("commission") + 1).otherwise(F.col("commission")))
    payout = (F.col("source") == "marketplace") & F.col("gross").isNotNull()
    fault = money_fault(F.col("amount"), F.col("currency"), F.col("gross"), F.col("commission"), payout)
    return x.select("tx_id", fault.alias("fault")).where("fault is not null")


def prd3_pool(spark, d):
    return featured(derived_book(spark, d)).select("tx_id", "side", "flagged")


def prd11_book_total(spark, d):
    b = derived_book(spark, d)
    t = F.sum(F.col("amount").cast("decimal(38,0)") + F.coalesce("commission", F.lit(0))).cast("bigint")
    return b.agg(t.alias("total"), F.count("*").alias("n"), F.countDistinct("tx_id").alias("ids"))


def jn1_exact(spark, d):
    return exact_pairs(shared_table(featured(derived_book(spark, d)), "book"))


def jn2_split(spark, d):
    f = shared_table(featured(derived_book(spark, d)), "book")
    hit = shared_table(exact_pairs(f), "exact")
    used = hit.select(F.col("e_id").alias("tx_id")).unionByName(hit.select(F.col("a_id").alias("tx_id")))
    return split_members(minus(f, used))


def _members(spark, d, *kinds):
    _, out = result(spark, d)
    return out.members.join(out.matches.where(F.col("kind").isin(*kinds)), "match_id").select("match_id", "kind", "score_bp", "tx_id")


def jn3_tolerant(spark, d):
    return _members(spark, d, "tolerant")


def jn4_reversal(spark, d):
    return _members(spark, d, "reversal")


def jn7_group(spark, d):
    return _members(spark, d, "group")


def jn12_ambiguous(spark, d):
    return result(spark, d)[1].discrepancies.where("type = 'ambiguous'").select("tx_id", "delta")


def engine_outcomes(spark, d):
    """Every row of the derived book with the kind of its match or its type."""
    return outcomes(result(spark, d)[1])


def st1_matches(spark, d):
    return result(spark, d)[1].matches.select("match_id", "kind", "score_bp")


def cl_discrepancies(spark, d):
    return result(spark, d)[1].discrepancies.select("tx_id", "match_id", "type", "delta")


def _of_type(t):
    def q(spark, d):
        return result(spark, d)[1].discrepancies.where(F.col("type") == t).select("tx_id", "match_id", "delta")

    return q


def ag1_kinds(spark, d):
    return report.kinds(result(spark, d)[1].matches)


def ag2_types(spark, d):
    return report.types(result(spark, d)[1].discrepancies)


def ag3_match_rate(spark, d):
    b, out = result(spark, d)
    return report.match_rate(b, out.members)


def ag4_ageing(spark, d):
    b, out = result(spark, d)
    return report.ageing(b, out.discrepancies)


def ag5_summary(spark, d):
    b, out = result(spark, d)
    return report.summary(b, out.matches, out.members, out.discrepancies)


def ag12_emitted(spark, d):
    b, out = result(spark, d)
    return report.emitted_by_type(truth(spark, b), out.discrepancies)


def ag13_labels(spark, d):
    b, out = result(spark, d)
    return report.label_score(truth(spark, b), out.matches, out.members)


def ag15_confusion(spark, d):
    b, out = result(spark, d)
    return report.confusion(truth(spark, b), b, out.members, out.discrepancies)


def iv_violations(spark, d):
    """Rows that break an invariant, by invariant: all counts are 0."""
    b, out = result(spark, d)
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("invariant"), "n")
    return n(invariants.unplaced(b, out.members, out.discrepancies), "placed once").unionByName(n(invariants.matched_twice(out.members), "one match")).unionByName(n(invariants.wrong_delta(b, out.discrepancies), "delta"))


def sk6_match_rows(spark, d):
    b, out = result(spark, d)
    return report.match_rows(b, out.matches, out.members)


def sk7_discrepancy_rows(spark, d):
    b, out = result(spark, d)
    return report.discrepancy_rows(b, out.discrepancies)


def fn4_dedup_keys(spark, d):
    b = derived_book(spark, d)
    return b.select("tx_id", S.dedup_key(F.col("source"), F.col("external_ref"), F.col("amount"), F.col("occurred_at"), F.col("direction")).alias("dedup_key"))


def wn1_occurrences(spark, d):
    """Occurrence keys of equal records, numbered in id order."""
    from mutabik.sources.files import numbered

    keyed = derived_book(spark, d).withColumn("dedup_key", S.dedup_key(F.col("source"), F.col("external_ref"), F.col("amount"), F.col("occurred_at"), F.col("direction")))
    return numbered(keyed, "tx_id").select("tx_id", "occurrence", "dedup_key")


def fn_money(spark, d):
    """Basis points, limits and formats of the book's amounts."""
    b = derived_book(spark, d)
    part = S.div(F.col("amount") * 3, 7)
    return b.select("tx_id", S.basis_points(part, F.col("amount")).alias("bp"), S.tolerant_limit(F.col("amount")).alias("tolerance"), S.format_try(F.col("amount") - 5_000_000).alias("shown"), S.shortfall_type(part, F.col("amount")).alias("shortfall"))


def st4_new_rows(spark, d):
    """Rows of the later half that an ingest adds after the earlier half: those with a new content key."""
    from mutabik.sources.files import new_rows

    keyed = fn4_dedup_keys(spark, d)
    cut = F.col("tx_id") % 2 == 0
    return new_rows(keyed.where(~cut), keyed.where(cut)).select("dedup_key")


def ag11_rejects(spark, d):
    """Rejected raw records per source and reason class."""
    from mutabik.operators.strict_load import load_and_reject

    bad = load_and_reject(spark.read.parquet(f"{d}/raw_line.parquet"))[1]
    return bad.groupBy("source", S.reason_class(F.col("reason")).alias("reason")).agg(F.count("*").alias("n"))


def jn6_contested(spark, d):
    """Rows that the exact pass leaves and that still have a possible partner."""
    f = shared_table(featured(derived_book(spark, d)), "book")
    hit = shared_table(exact_pairs(f), "exact")
    used = hit.select(F.col("e_id").alias("tx_id")).unionByName(hit.select(F.col("a_id").alias("tx_id")))
    return contested(shared_table(minus(f, used), "pool"))


def jn5_rivals(spark, d):
    """Rows of the other side that could be the same money, for rows without a claim by reference."""
    return rivals(shared_table(featured(derived_book(spark, d)), "book"))


def src11_generated(spark, d):
    """Types emitted and expected for a generated book of 20,000 rows."""
    from mutabik.sources.generate import generate

    book, want = generate(spark, 1, 20_000)
    book = shared_table(book, "generated")
    return report.emitted_by_type(want, run(book).discrepancies)


def table_outcomes(spark, d):
    """Outcomes of psp, bank and marketplace taken as one book."""
    return outcomes(result(spark, d, "tables")[1])


def table_types(spark, d):
    return report.types(result(spark, d, "tables")[1].discrepancies)


QUERIES = {
    f.__name__: f
    for f in (
        src8_book, prd1_money_faults, prd3_pool, prd11_book_total, jn1_exact, jn2_split, jn3_tolerant, jn4_reversal, jn7_group, jn12_ambiguous, engine_outcomes, st1_matches,
        cl_discrepancies, ag1_kinds, ag2_types, ag3_match_rate, ag4_ageing, ag5_summary, ag11_rejects, ag12_emitted, ag13_labels, ag15_confusion, iv_violations, sk6_match_rows,
        sk7_discrepancy_rows, fn4_dedup_keys, wn1_occurrences, fn_money, st4_new_rows, jn5_rivals, jn6_contested, src11_generated, table_outcomes, table_types,
    )
}
QUERIES |= {f"cl_{t}": _of_type(t) for t in TYPES}

_B = CASCADE.split(",\nf0 AS")[0]
_SHOWN = "concat(CASE WHEN {0} < 0 THEN '-' ELSE '' END, CAST(abs({0}) // 100 AS VARCHAR), ',', lpad(CAST(abs({0}) % 100 AS VARCHAR), 2, '0'))"
_DEDUP = "sha256(concat_ws('|', source, external_ref, CAST(amount AS VARCHAR), strftime(occurred_at, '%Y-%m-%dT%H:%M:%SZ'), direction))"
_NAMES = lambda names, col: f"(VALUES {', '.join(f'({i}, {chr(39)}{n}{chr(39)})' for i, n in enumerate(names))}) v(pos, {col})"
_BY_KIND = "SELECT match_id, kind, score_bp, tx_id FROM mem WHERE kind = '{}'"
_NEAR = "abs(e.us - o.us) < 345600000000"
_OPEN = f""", q AS (
  SELECT e.tx_id e_id, o.tx_id a_id FROM p1 e JOIN p1 o ON e.cp = o.cp AND e.direction = o.direction AND e.side = 0 AND o.source = 'bank' AND {_NEAR} AND abs(e.amount - o.amount) <= e.amount // 200
    AND ((e.ref <> '' AND e.ref = o.ref) OR (NOT e.flagged AND NOT o.flagged))
  UNION ALL SELECT e.tx_id, o.tx_id FROM p1 e JOIN p1 o ON e.cp = o.cp AND e.ref = o.ref AND e.side = 0 AND o.side = 0 AND e.direction = 'credit' AND o.direction = 'debit' AND e.amount = o.amount AND e.amount > 0 AND {_NEAR})
SELECT e_id AS tx_id FROM q UNION SELECT a_id FROM q"""
_ROW = "source, external_ref, counterparty_ref, amount, direction, strftime(occurred_at, '%Y-%m-%d') AS occurred_on"
ORACLES = {
    "src8_book": _B + " SELECT tx_id, source, external_ref, counterparty_ref, amount, currency, epoch_us(occurred_at) AS us, direction, gross, commission FROM b",
    "prd1_money_faults": _B + """ SELECT * FROM (SELECT tx_id, CASE WHEN tx_id % 7 = 2 THEN 'unsupported currency' WHEN tx_id % 7 = 1 AND amount > 0 THEN 'negative amount'
      WHEN source = 'marketplace' AND tx_id % 7 IN (1, 3) AND gross - CASE WHEN tx_id % 7 = 3 THEN commission + 1 ELSE commission END <> CASE WHEN tx_id % 7 = 1 THEN -amount ELSE amount END THEN 'inconsistent breakdown' END AS fault FROM b) WHERE fault IS NOT NULL""",
    "prd3_pool": CASCADE + "SELECT tx_id, side, flagged FROM f",
    "prd11_book_total": _B + " SELECT CAST(sum(amount + coalesce(commission, 0)) AS BIGINT) AS total, count(*) AS n, count(DISTINCT tx_id) AS ids FROM b",
    "jn1_exact": CASCADE + "SELECT e_id, a_id FROM ex",
    "jn2_split": CASCADE + "SELECT e_id, a_id FROM sp",
    "jn3_tolerant": CASCADE + _BY_KIND.format("tolerant"),
    "jn4_reversal": CASCADE + _BY_KIND.format("reversal"),
    "jn7_group": CASCADE + _BY_KIND.format("group"),
    "jn12_ambiguous": CASCADE + "SELECT tx_id, delta FROM dis WHERE type = 'ambiguous'",
    "engine_outcomes": CASCADE + "SELECT tx_id, kind AS outcome FROM mem UNION ALL SELECT tx_id, type FROM dis WHERE tx_id IS NOT NULL",
    "st1_matches": CASCADE + "SELECT DISTINCT match_id, kind, score_bp FROM mem",
    "cl_discrepancies": CASCADE + "SELECT tx_id, match_id, type, delta FROM dis",
    "ag1_kinds": CASCADE + f"SELECT pos, v.kind, count(m.match_id) AS n FROM {_NAMES(KINDS, 'kind')} LEFT JOIN (SELECT DISTINCT match_id, kind FROM mem) m ON m.kind = v.kind GROUP BY ALL",
    "ag2_types": CASCADE + f"SELECT pos, v.type, count(d.type) AS n, CAST(coalesce(sum(delta), 0) AS BIGINT) AS delta, {_SHOWN.format('CAST(coalesce(sum(delta), 0) AS BIGINT)')} AS delta_try FROM {_NAMES(report.REPORT_TYPES, 'type')} LEFT JOIN dis d ON d.type = v.type GROUP BY pos, v.type",
    "ag3_match_rate": CASCADE + "SELECT (SELECT count(*) FROM b) AS total, (SELECT count(*) FROM mem) AS matched, CAST((SELECT count(*) FROM mem) * 100 // (SELECT count(*) FROM b) AS VARCHAR) AS rate_pct",
    "ag4_ageing": CASCADE + f"""SELECT pos, v.age, count(a.age) AS n FROM {_NAMES(report.AGES, 'age')} LEFT JOIN (SELECT CASE WHEN days <= 7 THEN '0-7d' WHEN days <= 30 THEN '8-30d' ELSE '30d+' END age
      FROM (SELECT ((SELECT max(us) FROM f) - us) // 86400000000 AS days FROM dis JOIN f USING (tx_id))) a ON a.age = v.age GROUP BY pos, v.age""",
    "ag5_summary": CASCADE + "SELECT (SELECT count(*) FROM b) AS transactions, (SELECT count(*) FROM mem) AS matched_transactions, (SELECT count(DISTINCT match_id) FROM mem) AS matches, "
    + ", ".join(f"(SELECT count(DISTINCT match_id) FROM mem WHERE kind = '{k}') AS kind_{k}" for k in KINDS) + ", (SELECT count(*) FROM dis) AS discrepancies, "
    + ", ".join(f"(SELECT count(*) FROM dis WHERE type = '{t}') AS type_{t}" for t in TYPES),
    "ag12_emitted": CASCADE + f""", s AS (SELECT v.type, (SELECT count(*) FROM dis d WHERE d.type = v.type AND tx_id IS NOT NULL) emitted, (SELECT count(*) FROM dis d JOIN truth t USING (tx_id) WHERE d.type = v.type AND t.want_type = v.type) detected,
      (SELECT count(*) FROM truth WHERE want_type = v.type) expected FROM {_NAMES(TYPES, 'type')}) SELECT *, greatest(expected - detected, 0) AS short, greatest(emitted - detected, 0) AS surplus FROM s""",
    "ag13_labels": CASCADE + """, per AS (SELECT match_id, count(*) n, count(label) known, count(DISTINCT label) labels, min(label) label FROM mem LEFT JOIN truth USING (tx_id) GROUP BY match_id),
      size AS (SELECT label, count(*) size FROM truth WHERE label IS NOT NULL GROUP BY label HAVING count(*) >= 2), s AS (SELECT count(*) matches, count(*) FILTER (known = n AND labels = 1) correct,
      count(*) FILTER (NOT (known = n AND labels = 1) AND known > 0) false_matches, count(*) FILTER (known = 0) unlabelled FROM per), w AS (SELECT (SELECT count(*) FROM size) intended,
      (SELECT count(*) FROM size WHERE EXISTS (SELECT 1 FROM per WHERE per.label = size.label AND known = n AND labels = 1 AND n = size.size)) whole) SELECT *, intended - whole AS missed FROM s, w""",
    "ag15_confusion": CASCADE + """SELECT coalesce(want_type, '(none)') AS want, coalesce(got, '(group-level only)') AS got, count(*) AS n FROM b LEFT JOIN truth USING (tx_id)
      LEFT JOIN (SELECT tx_id, '(matched)' got FROM mem UNION ALL SELECT tx_id, type FROM dis WHERE tx_id IS NOT NULL) USING (tx_id) GROUP BY ALL""",
    "iv_violations": CASCADE + """SELECT 'placed once' AS invariant, count(*) AS n FROM (SELECT tx_id FROM b LEFT JOIN (SELECT tx_id, count(*) c FROM (SELECT tx_id FROM mem UNION ALL SELECT tx_id FROM dis WHERE tx_id IS NOT NULL) GROUP BY tx_id) USING (tx_id) WHERE coalesce(c, 0) <> 1)
      UNION ALL SELECT 'one match', count(*) FROM (SELECT tx_id FROM mem GROUP BY tx_id HAVING count(*) > 1)
      UNION ALL SELECT 'delta', count(*) FROM dis JOIN b USING (tx_id) WHERE NOT CASE WHEN type = 'timing' THEN delta = 0 WHEN type IN ('partial', 'commission') THEN delta >= 0 AND delta < amount WHEN type = 'refund' THEN delta = -amount ELSE delta = amount END""",
    "jn5_rivals": CASCADE + """SELECT t.tx_id, (SELECT count(*) FROM f o WHERE NOT o.flagged AND o.cp = t.cp AND o.direction = t.direction AND o.amount = t.amount AND abs(o.us - t.us) < 2678400000000
      AND CASE WHEN t.side = 0 THEN o.source = 'bank' ELSE o.side = 0 END) AS rivals FROM f t WHERE NOT t.flagged AND (t.side = 0 OR t.source = 'bank')""",
    "jn6_contested": CASCADE + _OPEN,
    "ag11_rejects": quality.ORACLES["p1_rejects"].replace("SELECT line_id, source, batch_id, row_no, reason FROM j", "SELECT source, reason, count(*) AS n FROM j") + " GROUP BY ALL",
    "sk6_match_rows": CASCADE + f"SELECT match_id, kind, score_bp, tx_id, {_ROW} FROM mem JOIN b USING (tx_id)",
    "sk7_discrepancy_rows": CASCADE + f"SELECT type, coalesce(dis.tx_id, 0) AS tx_id, match_id, delta, {_ROW} FROM dis LEFT JOIN b ON b.tx_id = dis.tx_id",
    "fn4_dedup_keys": _B + f" SELECT tx_id, {_DEDUP} AS dedup_key FROM b",
    "wn1_occurrences": _B + f", k AS (SELECT tx_id, {_DEDUP} AS key FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tx_id) AS n FROM k) SELECT tx_id, n AS occurrence, CASE WHEN n = 1 THEN key ELSE sha256(concat(key, '#', CAST(n AS VARCHAR))) END AS dedup_key FROM r",
    "fn_money": _B + f" SELECT tx_id, (amount * 3 // 7) * 10000 // amount AS bp, amount // 200 AS tolerance, {_SHOWN.format('(amount - 5000000)')} AS shown, CASE WHEN (amount * 3 // 7) * 10000 // amount BETWEEN 800 AND 2500 THEN 'commission' ELSE 'partial' END AS shortfall FROM b",
    "st4_new_rows": _B + f", k AS (SELECT tx_id, {_DEDUP} AS dedup_key FROM b) SELECT DISTINCT dedup_key FROM k WHERE tx_id % 2 = 0 AND dedup_key NOT IN (SELECT dedup_key FROM k WHERE tx_id % 2 <> 0)",
}
ORACLES |= {f"cl_{t}": CASCADE + f"SELECT tx_id, match_id, delta FROM dis WHERE type = '{t}'" for t in TYPES}
