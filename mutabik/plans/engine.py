"""The fixed cascade: exact, split, tolerant, group, tolerant again, classification, invariants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutabik.operators.classify import classify_open
from mutabik.operators.exact import exact_pairs
from mutabik.operators.features import featured, minus
from mutabik.operators.group import group_outcomes
from mutabik.operators.split import split_members
from mutabik.operators.tolerant import contested, tolerant_matches
from mutabik.plans.invariants import check_result
from mutabik.schema import check_book
from mutabik.shared import shared_table


@dataclass(frozen=True)
class Output:
    """matches: match_id, pass_no, kind, score_bp. members: match_id, tx_id, pos.
    discrepancies: tx_id, match_id (one of them null), type, delta."""

    matches: DataFrame
    members: DataFrame
    discrepancies: DataFrame


def _pairs(found: DataFrame, pass_no: int) -> DataFrame:
    """match_id, pass_no, kind, score_bp, tx_id, pos of pairs kind, e_id, a_id, score_bp."""
    head = [F.concat_ws("-", F.lit(pass_no), F.col("e_id")).alias("match_id"), F.lit(pass_no).alias("pass_no"), "kind", "score_bp"]
    return found.select(*head, F.posexplode(F.array("e_id", "a_id")).alias("pos", "tx_id"))


def _parts(found: DataFrame, one: str, many: str, kind: str, pass_no: int, one_first: bool) -> DataFrame:
    """The same for sets: column ``one`` names the match."""
    head = lambda: [F.concat_ws("-", F.lit(pass_no), F.col(one)).alias("match_id"), F.lit(pass_no).alias("pass_no"), F.lit(kind).alias("kind"), F.lit(10000).cast("bigint").alias("score_bp")]
    top = found.select(*head(), F.lit(0 if one_first else 2).alias("pos"), F.col(one).alias("tx_id")).distinct()
    rest = found.select(*head(), F.lit(1).alias("pos"), F.col(many).alias("tx_id"))
    return top.unionByName(rest)


def run(book: DataFrame, checked: bool = True) -> Output:
    """Reconciles a book (columns of ``schema.TX``). Raises BookError or InvariantError and gives nothing then.

    Each pass reads the pool that the one before left, from a table in the shared folder. Null
    references and counterparties count as empty; an empty book gives empty tables.
    """
    if checked:
        check_book(book)
    all_rows = shared_table(featured(book), "book")
    got = []

    def taken(m: DataFrame, name: str) -> DataFrame:
        got.append(shared_table(m.select("match_id", "pass_no", "kind", "score_bp", F.col("pos").cast("int").alias("pos"), "tx_id"), name))
        return got[-1]

    hits = exact_pairs(all_rows).select(F.lit("exact").alias("kind"), "e_id", "a_id", F.lit(10000).cast("bigint").alias("score_bp"))
    pool = shared_table(minus(all_rows, taken(_pairs(hits, 1), "exact")), "pool")
    pool = minus(pool, taken(_parts(split_members(pool), "e_id", "a_id", "split", 2, True), "split"))
    pool = minus(pool, taken(_pairs(tolerant_matches(pool), 3), "tolerant"))
    pool = shared_table(pool, "pool")
    groups = shared_table(group_outcomes(pool), "group")
    members = groups.where("what = 'member'")
    overflow = groups.where("what = 'overflow'").select(F.col("payout_id").alias("tx_id"))
    pool = minus(minus(pool, taken(_parts(members, "payout_id", "order_id", "group", 4, False), "groups")), overflow)
    # A second round can change something only where the group pass took orders.
    touched = members.select(F.col("payout_id").alias("tx_id")).join(all_rows, "tx_id").select("cp").distinct()
    again = tolerant_matches(pool.join(touched, "cp", "left_semi"))
    pool = shared_table(minus(pool, taken(_pairs(again, 5), "tolerant-again")), "pool")
    unsure = groups.where("what in ('unsure payout', 'unsure order')").select(F.when(F.col("what") == "unsure payout", F.col("payout_id")).otherwise(F.col("order_id")).alias("tx_id"))
    ambiguous = unsure.unionByName(contested(pool)).distinct().join(pool.select("tx_id"), "tx_id", "left_semi")
    everything = got[0]
    for m in got[1:]:
        everything = everything.unionByName(m)
    matches = everything.select("match_id", "pass_no", "kind", "score_bp").distinct()
    member_rows = everything.select("match_id", "tx_id", "pos")
    payouts = all_rows.where("source = 'marketplace' and commission > 0").select("tx_id", "commission")
    none_id, none_match = F.lit(None).cast("bigint").alias("tx_id"), F.lit(None).cast("string").alias("match_id")
    fees = got[3].join(payouts, "tx_id").select(none_id, "match_id", F.lit("commission").alias("type"), F.col("commission").alias("delta"))
    big = overflow.join(all_rows.select("tx_id", "amount"), "tx_id").select("tx_id", none_match, F.lit("unknown").alias("type"), F.col("amount").alias("delta"))
    typed = classify_open(all_rows, pool, ambiguous).select("tx_id", none_match, "type", "delta")
    discrepancies = shared_table(fees.unionByName(big).unionByName(typed), "discrepancies")
    out = Output(matches, member_rows, discrepancies)
    if checked:
        check_result(all_rows, out.members, out.discrepancies)
    return out


def outcomes(out: Output) -> DataFrame:
    """tx_id, outcome: the kind of its match or its discrepancy type."""
    m = out.members.join(out.matches, "match_id").select("tx_id", F.col("kind").alias("outcome"))
    return m.unionByName(out.discrepancies.where("tx_id is not null").select("tx_id", F.col("type").alias("outcome")))
