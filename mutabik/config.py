"""Fixed values of the reconciliation semantics; all amounts are integers in minor units."""

# Fixed values.
MATCH_WINDOW_DAYS = 3
TOLERANCE_DIVISOR = 200  # 50 basis points of the expected amount
HORIZON_DAYS = 30
GROUP_WINDOW_DAYS = 14
GROUP_CAP = 20
FEE_BAND_BP = (800, 2500)
CURRENCY = "TRY"
KINDS = ("exact", "split", "tolerant", "reversal", "group")
TYPES = ("missing", "partial", "duplicate", "refund", "commission", "timing", "ambiguous", "unknown")

DAY_US = 86_400_000_000
MAX_LONG = 9_223_372_036_854_775_807
