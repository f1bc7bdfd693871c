"""SQL texts shared by the oracles."""

BARS = """bars AS (
  SELECT event_type AS symbol, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
    last(value ORDER BY ts, event_id) AS close, sum(value) AS volume, count(*) AS n
  FROM events GROUP BY ALL)"""
W = "PARTITION BY symbol ORDER BY ts"


def last(k: int) -> str:
    return f"OVER ({W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def after(k: int) -> str:
    return f"OVER ({W} ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING)"


def rolling(agg: str, x: str, k: int, least: int | None = None) -> str:
    return f"CASE WHEN count({x}) {last(k)} >= {least or k} THEN {agg}({x}) {last(k)} END"


def forward(agg: str, x: str, k: int) -> str:
    return f"CASE WHEN count({x}) {after(k)} >= {k} THEN {agg}({x}) {after(k)} END"


def ewm(x: str, alpha: float, least: int = 1) -> str:
    """The recursion from the first value that is there, over all rows so far."""
    frame = f"OVER ({W} ROWS UNBOUNDED PRECEDING)"
    values = f"list({x}) FILTER (WHERE ({x}) IS NOT NULL) {frame}"
    return f"CASE WHEN count({x}) {frame} >= {least} THEN list_reduce({values}, lambda s, v: s * (1 - {alpha!r}) + v * {alpha!r}) END"


def ewm_adjusted(x: str, alpha: float) -> str:
    """The mean weighted by the geometric series."""
    frame = f"OVER ({W} ROWS UNBOUNDED PRECEDING)"
    return f"list_reduce(list({x}) {frame}, lambda s, v: s * (1 - {alpha!r}) + v) / ((1 - pow(1 - {alpha!r}, count(*) {frame})) / {alpha!r})"


def cdf(x: str) -> str:
    """Normal distribution by the power series of the error function; beyond three it is 1 to four digits."""
    z = f"(({x}) / sqrt(2.0))"
    series = f"2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda term_: pow(-1.0, term_) * pow({z}, 2 * term_ + 1) / (CASE WHEN term_ < 2 THEN 1.0 ELSE exp(lgamma(term_ + 1.0)) END * (2 * term_ + 1))))"
    return f"0.5 * (1 + CASE WHEN abs({z}) >= 3 THEN sign({z}) ELSE {series} END)"
