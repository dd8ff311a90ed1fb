"""Verdict of a run against ground truth."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from mutabik.operators.report import emitted_by_type, kinds, label_score
from mutabik.plans.engine import Output


@dataclass(frozen=True)
class Score:
    """Small collected aggregates of one scored run."""

    transactions: int
    seconds: float
    kinds: dict[str, int]
    types: dict[str, dict[str, int]]
    matches: int
    false_matches: int
    intended: int
    missed: int

    @property
    def detected(self) -> str:
        want = [t for t, v in self.types.items() if v["expected"]]
        return f"{sum(self.types[t]['short'] == 0 for t in want)}/{len(want)}"

    @property
    def passed(self) -> bool:
        """Nothing false, nothing missed; a run into which nothing was put proves nothing."""
        return any(v["expected"] for v in self.types.values()) and self.false_matches == 0 and self.missed == 0 and all(v["short"] == 0 and v["surplus"] == 0 for v in self.types.values())

    def text(self) -> str:
        head = [f"{'PASS' if self.passed else 'FAIL'}: {self.detected} types detected, {self.false_matches} false matches, {self.missed} of {self.intended} intended groups missed", f"{self.transactions} transactions in {self.seconds:.3f} s"]
        body = [f"{t:<12}{v['emitted']:>9} emitted {v['expected']:>9} expected {v['short']:>6} short {v['surplus']:>6} surplus" for t, v in self.types.items()]
        return "\n".join([*head, *(f"{k:<12}{n:>9} matches" for k, n in self.kinds.items()), *body])


def score(out: Output, book: DataFrame, truth: DataFrame, seconds: float) -> Score:
    ls = label_score(truth, out.matches, out.members).first()
    ty = {r["type"]: {k: int(r[k]) for k in ("emitted", "detected", "expected", "short", "surplus")} for r in emitted_by_type(truth, out.discrepancies).collect()}
    return Score(book.count(), seconds, {r["kind"]: int(r["n"]) for r in kinds(out.matches).orderBy("pos").collect()}, ty, int(ls["matches"]), int(ls["false_matches"]), int(ls["intended"]), int(ls["missed"]))
