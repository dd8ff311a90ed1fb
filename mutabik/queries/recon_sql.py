"""DuckDB formulations of the cascade over the derived book, written as plain joins over all pairs."""

from __future__ import annotations

from mutabik.sources.derived import EXPECTED, book_sql, values

D = 86_400_000_000


def _near(a: str, b: str, days: int = 3) -> str:
    return f"abs({a} - {b}) < {(days + 1) * D}"


def _tolerant(pool: str, x: str) -> str:
    """CTEs: edges, isolated pairs and sole pairs of a pool; tol{x} has kind, e_id, a_id, score_bp."""
    late = f"CAST(abs(e_us - o_us) // {D} AS BIGINT)"
    return f"""
ag{x} AS MATERIALIZED (
  SELECT 'tolerant' kind, e.tx_id e_id, o.tx_id a_id, e.amount e_amount, o.amount o_amount, e.us e_us, o.us o_us FROM {pool} e JOIN {pool} o
    ON e.cp = o.cp AND e.ref = o.ref AND e.ref <> '' AND e.direction = o.direction AND e.side = 0 AND o.source = 'bank'
    AND {_near('e.us', 'o.us')} AND abs(e.amount - o.amount) <= e.amount // 200
  UNION ALL SELECT 'reversal', e.tx_id, o.tx_id, e.amount, o.amount, e.us, o.us FROM {pool} e JOIN {pool} o
    ON e.cp = o.cp AND e.ref = o.ref AND e.ref <> '' AND e.side = 0 AND o.side = 0 AND e.direction = 'credit' AND o.direction = 'debit'
    AND e.amount = o.amount AND e.amount > 0 AND {_near('e.us', 'o.us')}),
deg{x} AS MATERIALIZED (SELECT p, count(*) n FROM (SELECT e_id p FROM ag{x} UNION ALL SELECT a_id FROM ag{x}) GROUP BY p),
t0{x} AS MATERIALIZED (SELECT * FROM ag{x} WHERE (SELECT n FROM deg{x} WHERE p = e_id) = 1 AND (SELECT n FROM deg{x} WHERE p = a_id) = 1),
pb{x} AS MATERIALIZED (SELECT * FROM {pool} WHERE tx_id NOT IN (SELECT e_id FROM t0{x} UNION ALL SELECT a_id FROM t0{x})),
far{x} AS MATERIALIZED (
  SELECT e.tx_id e_id, o.tx_id a_id, e.amount e_amount, o.amount o_amount, e.us e_us, o.us o_us FROM pb{x} e JOIN pb{x} o
    ON e.cp = o.cp AND e.direction = o.direction AND e.amount = o.amount AND e.side = 0 AND o.source = 'bank' AND NOT e.flagged AND NOT o.flagged AND {_near('e.us', 'o.us', 30)}),
rev{x} AS MATERIALIZED (
  SELECT e.tx_id e_id, o.tx_id a_id FROM pb{x} e JOIN pb{x} o ON e.cp = o.cp AND e.ref = o.ref AND e.side = 0 AND o.side = 0 AND e.direction = 'credit' AND o.direction = 'debit'
    AND e.amount = o.amount AND e.amount > 0 AND {_near('e.us', 'o.us')}),
t1{x} AS MATERIALIZED (
  SELECT 'tolerant' kind, * FROM far{x} f WHERE {_near('e_us', 'o_us')}
    AND (SELECT count(*) FROM far{x} g WHERE g.e_id = f.e_id) = 1 AND (SELECT count(*) FROM far{x} g WHERE g.a_id = f.a_id) = 1
    AND f.e_id NOT IN (SELECT e_id FROM rev{x} UNION ALL SELECT a_id FROM rev{x})),
tol{x} AS MATERIALIZED (
  SELECT kind, e_id, a_id, CAST(10000 - CASE WHEN kind = 'tolerant' AND e_amount > 0 THEN abs(e_amount - o_amount) * 10000 // e_amount ELSE 0 END - {late} * 100 AS BIGINT) score_bp
  FROM (SELECT * FROM t0{x} UNION ALL BY NAME SELECT * FROM t1{x}))"""


CASCADE = f"""
WITH RECURSIVE b AS MATERIALIZED ({book_sql('duckdb')}),
f0 AS MATERIALIZED (SELECT tx_id, source, CASE WHEN source = 'psp' THEN 0 ELSE 1 END side, counterparty_ref cp, external_ref AS ref, amount, epoch_us(occurred_at) us, direction,
  coalesce(gross, 0) gross0, coalesce(commission, 0) commission FROM b),
f AS MATERIALIZED (SELECT f0.*, ref <> '' AND EXISTS (SELECT 1 FROM f0 o WHERE o.cp = f0.cp AND o.ref = f0.ref AND o.side <> f0.side) flagged FROM f0),
rn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY cp, ref, amount, direction, side ORDER BY us, source, gross0, tx_id) r FROM f WHERE ref <> ''),
ex AS MATERIALIZED (SELECT e.tx_id e_id, a.tx_id a_id FROM rn e JOIN rn a ON e.cp = a.cp AND e.ref = a.ref AND e.amount = a.amount AND e.direction = a.direction AND e.r = a.r
  AND e.side = 0 AND a.side = 1 AND {_near('e.us', 'a.us')}),
p1 AS MATERIALIZED (SELECT * FROM f WHERE tx_id NOT IN (SELECT e_id FROM ex UNION ALL SELECT a_id FROM ex)),
sp0 AS (SELECT e.tx_id e_id, a.tx_id a_id, a.amount, e.amount due FROM p1 e JOIN p1 a ON e.cp = a.cp AND e.ref = a.ref AND e.ref <> '' AND e.direction = a.direction
  AND e.side = 0 AND a.source = 'bank' AND {_near('e.us', 'a.us')} WHERE (SELECT count(*) FROM p1 o WHERE o.side = 0 AND o.cp = e.cp AND o.ref = e.ref) = 1),
sp AS MATERIALIZED (SELECT e_id, a_id FROM sp0 WHERE e_id IN (SELECT e_id FROM sp0 GROUP BY e_id HAVING count(*) >= 2 AND sum(amount) = max(due))),
p2 AS MATERIALIZED (SELECT * FROM p1 WHERE tx_id NOT IN (SELECT e_id FROM sp UNION ALL SELECT a_id FROM sp)),
{_tolerant('p2', 'x')},
p3 AS MATERIALIZED (SELECT * FROM p2 WHERE tx_id NOT IN (SELECT e_id FROM tolx UNION ALL SELECT a_id FROM tolx)),
cand AS MATERIALIZED (SELECT p.tx_id pid, p.gross0 g, o.tx_id oid, o.amount, row_number() OVER (PARTITION BY p.tx_id ORDER BY o.us, o.ref, o.cp, o.amount, o.direction, o.source, o.gross0, o.tx_id) i
  FROM p3 p JOIN p3 o ON p.source = 'marketplace' AND p.direction = 'credit' AND p.gross0 > 0 AND o.side = 0 AND o.direction = 'credit' AND o.amount > 0 AND o.cp = p.cp
    AND o.us BETWEEN p.us - 14 * {D} AND p.us),
few AS MATERIALIZED (SELECT pid, count(*) n FROM cand GROUP BY pid),
walk AS (
  SELECT pid, g, 0::BIGINT i, 0::BIGINT s, []::BIGINT[] m FROM (SELECT DISTINCT pid, g FROM cand) WHERE pid IN (SELECT pid FROM few WHERE n <= 20)
  UNION ALL
  SELECT w.pid, w.g, c.i, CASE WHEN t.take THEN w.s + c.amount ELSE w.s END, CASE WHEN t.take THEN list_append(w.m, c.oid) ELSE w.m END
  FROM walk w JOIN cand c ON c.pid = w.pid AND c.i = w.i + 1 CROSS JOIN (VALUES (true), (false)) t(take) WHERE NOT t.take OR w.s + c.amount <= w.g),
fit AS MATERIALIZED (SELECT w.pid, m FROM walk w JOIN few ON few.pid = w.pid AND w.i = few.n WHERE w.s = w.g),
grp AS MATERIALIZED (SELECT pid, unnest(m) oid FROM fit WHERE pid IN (SELECT pid FROM fit GROUP BY pid HAVING count(*) = 1)),
ovf AS MATERIALIZED (SELECT pid FROM few WHERE n > 20),
uns AS MATERIALIZED (SELECT pid tx_id FROM fit GROUP BY pid HAVING count(*) > 1 UNION SELECT unnest(m) FROM fit WHERE pid IN (SELECT pid FROM fit GROUP BY pid HAVING count(*) > 1)),
p4 AS MATERIALIZED (SELECT * FROM p3 WHERE tx_id NOT IN (SELECT pid FROM grp UNION ALL SELECT oid FROM grp UNION ALL SELECT pid FROM ovf)),
{_tolerant('p4', 'y')},
p5 AS MATERIALIZED (SELECT * FROM p4 WHERE tx_id NOT IN (SELECT e_id FROM toly UNION ALL SELECT a_id FROM toly)),
loose AS MATERIALIZED (SELECT e.tx_id e_id, o.tx_id a_id FROM p5 e JOIN p5 o ON e.cp = o.cp AND e.direction = o.direction AND e.side = 0 AND o.source = 'bank'
  AND NOT e.flagged AND NOT o.flagged AND {_near('e.us', 'o.us')} AND abs(e.amount - o.amount) <= e.amount // 200),
tied AS MATERIALIZED (SELECT e.tx_id e_id, o.tx_id a_id FROM p5 e JOIN p5 o ON e.cp = o.cp AND e.ref = o.ref AND e.ref <> '' AND e.direction = o.direction AND e.side = 0 AND o.source = 'bank'
  AND {_near('e.us', 'o.us')} AND abs(e.amount - o.amount) <= e.amount // 200),
back AS MATERIALIZED (SELECT e.tx_id e_id, o.tx_id a_id FROM p5 e JOIN p5 o ON e.cp = o.cp AND e.ref = o.ref AND e.side = 0 AND o.side = 0 AND e.direction = 'credit' AND o.direction = 'debit'
  AND e.amount = o.amount AND e.amount > 0 AND {_near('e.us', 'o.us')}),
con AS MATERIALIZED (SELECT e_id tx_id FROM loose UNION SELECT a_id FROM loose UNION SELECT e_id FROM tied UNION SELECT a_id FROM tied UNION SELECT e_id FROM back UNION SELECT a_id FROM back),
amb AS MATERIALIZED (SELECT tx_id FROM p5 WHERE tx_id IN (SELECT tx_id FROM uns UNION ALL SELECT tx_id FROM con)),
mem AS MATERIALIZED (
  SELECT concat('1-', e_id) match_id, 'exact' kind, 10000::BIGINT score_bp, unnest([e_id, a_id]) tx_id FROM ex
  UNION ALL SELECT DISTINCT concat('2-', e_id), 'split', 10000, e_id FROM sp UNION ALL SELECT concat('2-', e_id), 'split', 10000, a_id FROM sp
  UNION ALL SELECT concat('3-', e_id), kind, score_bp, unnest([e_id, a_id]) FROM tolx
  UNION ALL SELECT DISTINCT concat('4-', pid), 'group', 10000, pid FROM grp UNION ALL SELECT concat('4-', pid), 'group', 10000, oid FROM grp
  UNION ALL SELECT concat('5-', e_id), kind, score_bp, unnest([e_id, a_id]) FROM toly),
one AS MATERIALIZED (SELECT cp, ref, any_value(tx_id) e_id, any_value(amount) due, any_value(us) us, any_value(direction) direction FROM f WHERE side = 0 AND ref <> '' GROUP BY cp, ref HAVING count(*) = 1),
ls AS MATERIALIZED (SELECT o.cp, o.ref, o.e_id, o.direction FROM one o JOIN f a ON a.cp = o.cp AND a.ref = o.ref AND a.source = 'bank' AND a.direction = o.direction
  GROUP BY ALL HAVING count(*) >= 2 AND sum(a.amount) = max(o.due) AND bool_or(NOT {_near('a.us', 'o.us')})),
rules AS MATERIALIZED (SELECT t.tx_id, t.side, t.amount, t.direction,
  EXISTS (SELECT 1 FROM ls WHERE ls.cp = t.cp AND ls.ref = t.ref AND (t.tx_id = ls.e_id OR (t.source = 'bank' AND t.direction = ls.direction))) in_split,
  t.ref <> '' AND EXISTS (SELECT 1 FROM f o WHERE o.cp = t.cp AND o.ref = t.ref AND o.source = t.source AND o.direction = t.direction AND o.amount = t.amount
    AND (o.us < t.us OR (o.us = t.us AND (o.gross0 < t.gross0 OR (o.gross0 = t.gross0 AND o.tx_id < t.tx_id))))) copy,
  t.tx_id IN (SELECT tx_id FROM amb) unsure,
  t.side = 1 AND t.direction = 'debit' AND t.ref <> '' AND (SELECT count(*) FROM f o WHERE o.cp = t.cp AND o.ref = t.ref) > 1 refund,
  (SELECT arg_min(o.amount, (o.us, o.amount, o.tx_id)) FROM f o WHERE t.side = 1 AND t.direction = 'credit' AND t.ref <> '' AND o.cp = t.cp AND o.ref = t.ref AND o.side = 0
    AND o.direction = 'credit' AND t.amount > 0 AND o.amount > t.amount) short_of,
  (SELECT arg_min(o.amount, (o.us, o.amount, o.source, o.tx_id)) FROM f o WHERE t.side = 0 AND t.ref <> '' AND o.cp = t.cp AND o.ref = t.ref AND o.side = 1 AND o.direction = t.direction
    AND o.amount > 0 AND o.amount < t.amount) short_by,
  EXISTS (SELECT 1 FROM f o WHERE o.side <> t.side AND o.cp = t.cp AND o.amount = t.amount AND o.direction = t.direction AND NOT {_near('o.us', 't.us')}
    AND ((t.ref <> '' AND o.ref = t.ref) OR (NOT o.flagged AND NOT t.flagged AND {_near('o.us', 't.us', 30)}))) late,
  EXISTS (SELECT 1 FROM f o WHERE t.ref <> '' AND o.side = 1 AND o.cp = t.cp AND o.ref = t.ref AND o.direction = t.direction)
    OR EXISTS (SELECT 1 FROM f o WHERE o.side = 1 AND o.cp = t.cp AND o.amount = t.amount AND o.direction = t.direction AND NOT o.flagged AND NOT t.flagged AND {_near('o.us', 't.us', 30)}) answered
  FROM p5 t),
dis AS MATERIALIZED (
  SELECT NULL::BIGINT tx_id, concat('4-', pid) match_id, 'commission' AS type, commission delta FROM (SELECT DISTINCT pid FROM grp) JOIN f ON tx_id = pid WHERE commission > 0
  UNION ALL SELECT pid, NULL, 'unknown', amount FROM ovf JOIN f ON tx_id = pid
  UNION ALL SELECT tx_id, NULL,
    CASE WHEN in_split THEN 'timing' WHEN copy THEN 'duplicate' WHEN unsure THEN 'ambiguous' WHEN refund THEN 'refund'
      WHEN short_of IS NOT NULL THEN CASE WHEN (short_of - amount) * 10000 // short_of BETWEEN 800 AND 2500 THEN 'commission' ELSE 'partial' END
      WHEN side = 1 AND direction = 'credit' AND late THEN 'timing'
      WHEN short_by IS NOT NULL THEN CASE WHEN (amount - short_by) * 10000 // amount BETWEEN 800 AND 2500 THEN 'commission' ELSE 'partial' END
      WHEN side = 0 AND late THEN 'timing' WHEN side = 0 AND NOT answered THEN 'missing' ELSE 'unknown' END,
    CASE WHEN in_split THEN 0 WHEN copy OR unsure THEN amount WHEN refund THEN -amount WHEN short_of IS NOT NULL THEN 0 WHEN side = 1 AND direction = 'credit' AND late THEN 0
      WHEN short_by IS NOT NULL THEN amount - short_by WHEN side = 0 AND late THEN 0 ELSE amount END FROM rules),
truth AS MATERIALIZED (SELECT b.tx_id, CASE WHEN e.out IN ('exact', 'tolerant', 'split', 'reversal', 'group') THEN concat('k', b.tx_id // 1000) END label,
    CASE WHEN e.out NOT IN ('exact', 'tolerant', 'split', 'reversal', 'group') THEN e.out END want_type
  FROM b JOIN (VALUES {values(EXPECTED)}) e(slot, off, out) ON (b.tx_id // 1000) % 20 = e.slot AND b.tx_id % 1000 = e.off
  UNION ALL SELECT tx_id, concat('k', tx_id // 1000), NULL FROM b WHERE (tx_id // 1000) % 20 = 9)
"""
