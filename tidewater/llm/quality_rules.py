"""Quality rules whose cutoffs follow the corpus: quantile sketches per language and source.

Everything is DataFrame expressions. Each text gives five whole-number measures; a sketch
counts them in log-linear buckets (exact below 16, then 16 to a power of two, so within a
sixteenth, and at most 976 buckets). Sketches are plain counts: partial aggregation merges them
before the shuffle, and those of a language's sources add up to that of the language, those of
the languages to that of the corpus. The cutoff of a measure is the upper quartile plus
``FENCE`` times the quartile distance, which has a floor so that a group without spread doesn't
reject its first odd text. Small groups lean on larger ones: a group's cutoff is the mean of its
own, weighing its rows, and its language's, weighing ``prior`` rows; the language's leans on the
corpus in the same way. So verdicts change smoothly with a group's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, cut, shared_dir, unboxed

#: What separates words, and the characters that count as symbols.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Measures with the least quartile distance each.
MEASURES = {"m_symbols": 25, "m_word": 100, "m_dup": 150, "m_repeat": 100, "m_upper": 80}
FENCE = 3
#: Rows that the larger group's cutoff weighs in a smaller group's.
PRIOR = 100
#: More groups than this are joined by a shuffle instead of a broadcast.
BROADCAST_GROUPS = 50_000


def _dropped(text: Column, letters: str) -> Column:
    """How many characters of the text are among these letters."""
    return (F.length(text) - F.length(F.translate(text, letters, ""))).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with one more column ``_q``: a struct of base counts, measures and group keys.

    Null text counts as empty; a null language or source is that of the empty string.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select("*", F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("_w"), F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0).alias("_l"))
    windows = F.when(F.size("_w") < 3, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size("_w") - 2), lambda i: F.concat_ws(" ", F.element_at("_w", i), F.element_at("_w", i + 1), F.element_at("_w", i + 2)))
    )
    words = words.withColumn("_s", windows)
    placed = F.when(
        F.size(F.array_distinct("_s")) < F.size("_s"), F.sort_array(F.transform("_s", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    )
    words = words.withColumn("_s", placed)
    same = lambda e, k, d: F.coalesce(F.get("_s", k + d)["x"] == e["x"], F.lit(False))
    at = F.sort_array(F.filter(F.transform("_s", lambda e, k: F.when(same(e, k, -1) | same(e, k, 1), e["i"])), lambda p: p.isNotNull()))
    words = words.withColumn("_s", at)
    covered = F.aggregate(F.transform("_s", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_s", k + 1) - p, F.lit(3)))), F.lit(0), lambda x, y: x + y)
    n = F.size("_w").cast("long")
    chars = (F.length(text) - _dropped(text, BLANKS)).cast("long")
    counts = words.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.struct(
            n.alias("n_words"),
            chars.alias("word_chars"),
            _dropped(text, SYMBOLS).alias("n_symbols"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
            F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
            F.size("_l").cast("long").alias("n_lines"),
            _dropped(text, UPPER).alias("n_upper"),
        ).alias("_q"),
    )
    q = F.col("_q")
    per = lambda a, b, scale: F.when(q[b] > 0, F.floor((q[a] * scale - F.pmod(q[a] * scale, q[b])) / q[b])).otherwise(0).cast("long")
    failed = (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])
    measures = {
        "m_symbols": per("n_symbols", "word_chars", 1000),
        "m_word": per("word_chars", "n_words", 100),
        "m_dup": per("n_dup_lines", "n_lines", 1000),
        "m_repeat": per("n_repeat_words", "n_words", 1000),
        "m_upper": per("n_upper", "word_chars", 1000),
    }
    fields = [q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    keys = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    return counts.withColumn("_q", F.struct(*fields, failed.alias("base_failed"), *[m.alias(k) for k, m in measures.items()], *keys))


def bucket(x: Column) -> Column:
    """Log-linear bucket of a whole number from 0 on."""
    e = F.length(F.bin(x)) - 1
    return F.when(x < 16, x).otherwise(16 * (e - 3) + F.pmod(F.floor(x / F.pow(F.lit(2.0), e - 4)), F.lit(16))).cast("long")


def bottom(b: Column) -> Column:
    """The least number in a bucket."""
    return F.when(b < 16, b).otherwise((16 + F.pmod(b, F.lit(16))) * F.pow(F.lit(2.0), F.floor(b / 16) - 1)).cast("long")


def _edges(sketch: DataFrame, by: list[str]) -> DataFrame:
    """``by..., m, total, edge`` from ``by..., m, b, n``."""
    # at most 976 buckets a group, so each sketch is sorted whole
    arrays = sketch.groupBy(*by, "m").agg(F.sort_array(F.collect_list(F.struct("b", "n"))).alias("s"), F.sum("n").alias("total"))

    def quantile(percent: int) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("b"))
        step = lambda acc, x: F.struct((acc["seen"] + x["n"]).alias("seen"), F.coalesce(acc["b"], F.when(100 * (acc["seen"] + x["n"]) >= percent * F.col("total"), x["b"])).alias("b"))
        return bottom(F.aggregate("s", start, step)["b"])

    least = F.lit(0)
    for m, v in MEASURES.items():
        least = F.when(F.col("m") == m, v).otherwise(least)
    of = arrays.select(*by, "m", "total", quantile(75).alias("high"), quantile(25).alias("low"))
    return of.select(*by, "m", "total", (F.col("high") + FENCE * F.greatest(F.col("high") - F.col("low"), least)).cast("long").alias("edge"))


def cutoffs(stats: DataFrame, prior: int = PRIOR) -> DataFrame:
    """``lang, source, cut_<measure>...`` from rows that have ``lang``, ``source`` and the measures."""
    long = stats.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), bucket(F.col(m)).alias("b")) for m in MEASURES])).alias("x"))
    sketch = cut(long.groupBy("lang", "source", "x.m", "x.b").agg(F.count("*").alias("n")))
    of_lang = sketch.groupBy("lang", "m", "b").agg(F.sum("n").alias("n"))
    of_all = _edges(of_lang.groupBy("m", "b").agg(F.sum("n").alias("n")), [])
    lean = lambda total, own, other: (own + F.floor(prior * (other - own) / (total + prior))).cast("long")
    langs = _edges(of_lang, ["lang"]).join(F.broadcast(of_all.select("m", F.col("edge").alias("_all"))), "m")  # five rows
    langs = langs.select("lang", "m", lean(F.col("total"), F.col("edge"), F.col("_all")).alias("_lang"))
    of = _edges(sketch, ["lang", "source"]).join(langs, ["lang", "m"])
    of = of.withColumn("edge", lean(F.col("total"), F.col("edge"), F.col("_lang")))
    return of.groupBy("lang", "source").agg(*[F.max(F.when(F.col("m") == m, F.col("edge"))).alias(f"cut_{m}") for m in MEASURES])


def _judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` (with ``_q``) joined with the limits of their group, and a column ``_kept``."""
    limits = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[F.col(f"cut_{m}").alias(f"_cut_{m}") for m in MEASURES])
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    within = ~F.col("_q.base_failed")
    for m in MEASURES:
        within &= F.col(f"_q.{m}") <= F.col(f"_cut_{m}")
    joined = rows.join(limits, (F.col("_q.lang") == F.col("_lang")) & (F.col("_q.source") == F.col("_source")), "left")
    return joined.withColumn("_kept", F.coalesce(within, F.lit(False)))


def judge(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``.

    Defined results: null or empty texts have no words and fail; repeated rows give a row
    each; null ids stay null; null languages and sources are grouped with empty ones; ties at a
    cutoff are kept; an empty table gives an empty result; other columns are not read.
    """
    stats = cut(measured(docs.select("doc_id", "text", "lang", "source")).select("doc_id", "_q"))
    limits = cut(cutoffs(stats.select("_q.*"), prior))
    shown = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return _judged(stats, limits).select("doc_id", *[F.col(f"_q.{c}").alias(c) for c in shown], F.col("_kept").alias("kept"))


def keep(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns as they are.

    Rows and measures are written once to the shared folder and read twice: the measures alone
    for the cutoffs, then all.
    """
    path = shared_dir(docs.sparkSession)
    measured(boxed(docs, "text", "lang", "source")).select("_row", "_q").write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    limits = cut(cutoffs(rows.select("_q.*"), prior))
    kept = unboxed(_judged(rows, limits).where("_kept"), docs.columns)
    return kept


_WS = r"[^\x20\x09-\x0D]+"
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WS}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WS}')) AS ls FROM d),
win AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS x FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
q AS (
  SELECT w.r, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(t) - len(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper
  FROM w LEFT JOIN cov ON w.r = cov.r),
m AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    coalesce(1000 * n_symbols // nullif(word_chars, 0), 0) AS m_symbols, coalesce(100 * word_chars // nullif(n_words, 0), 0) AS m_word,
    coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0) AS m_dup, coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0) AS m_repeat,
    coalesce(1000 * n_upper // nullif(word_chars, 0), 0) AS m_upper
  FROM q),
long AS (SELECT lang, source, m, v FROM m UNPIVOT (v FOR m IN (m_symbols, m_word, m_dup, m_repeat, m_upper))),
e AS (SELECT lang, source, m, v, len(bin(v)) - 1 AS e FROM long),
b AS (SELECT lang, source, m, CASE WHEN v < 16 THEN v ELSE 16 * (e - 3) + ((v >> (e - 4)) % 16) END AS b, count(*) AS n FROM e GROUP BY ALL),
lv AS (SELECT lang, source, m, b, n, 2 AS lv FROM b UNION ALL SELECT lang, '', m, b, sum(n), 1 FROM b GROUP BY lang, m, b UNION ALL SELECT '', '', m, b, sum(n), 0 FROM b GROUP BY m, b),
c AS (SELECT *, sum(n) OVER (PARTITION BY lv, lang, source, m ORDER BY b) AS seen, sum(n) OVER (PARTITION BY lv, lang, source, m) AS total,
    CASE WHEN b < 16 THEN b ELSE (16 + b % 16) << CAST(b // 16 - 1 AS INTEGER) END AS v FROM lv),
f AS (SELECT lv, lang, source, m, total, min(v) FILTER (100 * seen >= 75 * total) AS high, min(v) FILTER (100 * seen >= 25 * total) AS low FROM c GROUP BY ALL),
own AS (SELECT lv, lang, source, m, total, high + {FENCE} * greatest(high - low, CASE m {" ".join(f"WHEN '{k}' THEN {v}" for k, v in MEASURES.items())} END) AS edge FROM f),
le AS (SELECT l.lang, l.m, l.edge + CAST(floor({PRIOR} * (a.edge - l.edge) / CAST(l.total + {PRIOR} AS DOUBLE)) AS BIGINT) AS edge FROM own l JOIN own a ON l.lv = 1 AND a.lv = 0 AND a.m = l.m),
edge AS (SELECT g.lang, g.source, g.m, g.edge + CAST(floor({PRIOR} * (le.edge - g.edge) / CAST(g.total + {PRIOR} AS DOUBLE)) AS BIGINT) AS edge FROM own g JOIN le ON g.lv = 2 AND le.lang = g.lang AND le.m = g.m),
p AS (PIVOT edge ON m IN ('m_symbols', 'm_word', 'm_dup', 'm_repeat', 'm_upper') USING max(edge) GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND m.m_symbols <= p.m_symbols AND m.m_word <= p.m_word AND m.m_dup <= p.m_dup AND m.m_repeat <= p.m_repeat AND m.m_upper <= p.m_upper AS kept
FROM m JOIN p USING (lang, source)
"""
