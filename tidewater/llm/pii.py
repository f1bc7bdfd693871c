"""Personal data by weak supervision, in DataFrame expressions only.

Base kinds are fixed patterns with a check each. Beyond them, a wider pattern proposes
candidates (long keys, account numbers, phone numbers without a plus, national numbers,
spelt-out addresses), on which five labellers vote: a strict pattern, a gazetteer of words
before the span, the context right before it, its mix of letters and digits, and its variety
of digits. Expectation-maximisation over the counts of vote patterns estimates the labellers'
reliabilities, and the posteriors train a naive Bayes classifier of spans, which decides.

The corpus is read once for the counts (at most some thousand rows, as each feature has a
fixed number of values) and once to mark spans. Patterns are linear: runs are taken
possessively, and a run is entered only at its start or where the last match ended.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed

#: The base kinds in their order, then what the method may add.
KINDS = ("email", "ip", "card", "phone")
ADDED = ("secret", "account", "local_phone", "national", "hidden_email")
PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE = (
    r"(?<![A-Za-z0-9_-])(?:[A-Za-z0-9_-]{20,}+|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,15}+(?![A-Za-z0-9_-])|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])|[A-Za-z0-9._]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{1,63}+){1,4})"
)
#: The first that fits names a candidate's shape.
SHAPES = (
    ("hidden_email", r"[\[(]at[\])]"),
    ("national", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
    ("local_phone", r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$"),
    ("account", r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"),
)
STRICT = r"^[0-9a-f]{24,}$|^[0-9A-F]{24,}$|^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$|^\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$|[\[(]at[\])]"
GAZETTEER = r"token|secret|passw|api.?key|\bkey|auth|bearer|phone|\btel|\bcall|\bfax|mobile|ssn|social|iban|account|mail"
CONTEXT = r"[=:][\s]*[\"']?$"
VOTES = ("strict", "gazetteer", "context", "mixed", "digits")
FEATURES = {"shape": 5, "size": 6, "share": 6, "gazetteer": 2, "context": 2, "strict": 2}
CERTAIN = 0.9
#: Matches of a text are placed in blocks of this many.
BLOCK = 256


def _spans(text: Column, pattern: str, make) -> Column:
    """Matches in order; ``make(match, start, end)`` gives an array of structs for each (empty: dropped)."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    parts = F.transform(parts, lambda x: F.struct(F.length(x["p"]).cast("long").alias("before"), F.coalesce(x["m"], F.lit("")).alias("m")))
    # zero-length "matches" are the text after the last match
    found = F.filter(parts, lambda x: x["m"] != "")
    # blocks of matches, and where each begins: an array grows by a copy, so none grows long
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), lambda k: F.slice(found, k * BLOCK + 1, F.lit(BLOCK)))
    length = lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda a, x: a + x["before"] + F.length(x["m"]))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.filter(F.array(F.struct(F.lit(0).cast("long").alias("at"), F.slice(found, 1, 1).alias("block"))), lambda x: F.lit(False)).alias("out"))
    begun = F.aggregate(blocks, first, lambda acc, x: F.struct((acc["at"] + length(x)).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), x.alias("block")))).alias("out")))["out"]
    at = lambda acc, x: acc["at"] + x["before"]
    none = F.filter(make(F.lit(""), F.lit(0).cast("long"), F.lit(0).cast("long")), lambda x: F.lit(False))
    step = lambda acc, x: F.struct((at(acc, x) + F.length(x["m"])).cast("long").alias("at"), F.concat(acc["out"], make(x["m"], at(acc, x), (at(acc, x) + F.length(x["m"])).cast("long"))).alias("out"))
    each = F.transform(begun, lambda z: F.aggregate(z["block"], F.struct(z["at"].alias("at"), none.alias("out")), step)["out"])
    return F.when(text.rlike(pattern), F.flatten(each)).otherwise(none)


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def base_spans(text: Column) -> Column:
    """Array of ``struct(start, rank, end)`` by start, then kind."""
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    valid = {
        "email": lambda m: F.lit(True),
        "ip": lambda m: m.rlike(rf"^{part}\.{part}\.{part}\.{part}$"),
        "card": lambda m: F.when(F.length(digits(m)).between(14, 19), _luhn(digits(m))).otherwise(False),
        "phone": lambda m: F.length(digits(m)).between(10, 15),
    }
    found = []
    for rank, kind in enumerate(KINDS):
        one = lambda m, s, e, rank=rank, kind=kind: F.filter(F.array(F.struct(s.alias("start"), F.lit(rank).alias("rank"), e.alias("end"))), lambda _: valid[kind](m))
        found.append(_spans(text, PATTERN[kind], one))
    return F.sort_array(F.concat(*found))


def candidates(text: Column) -> Column:
    """Array of candidate structs: place, shape, votes and features."""

    def one(m: Column, s: Column, e: Column) -> Column:
        before = F.substring(text, F.greatest(s - 31, F.lit(1)).cast("int"), F.least(s, F.lit(32)).cast("int"))
        shape = F.lit(0)
        for name, pattern in reversed(SHAPES):
            shape = F.when(m.rlike(pattern), ADDED.index(name)).otherwise(shape)
        n_digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
        flag = lambda x: x.cast("int")
        return F.array(
            F.struct(
                s.alias("start"),
                e.alias("end"),
                shape.alias("shape"),
                F.least(F.floor(F.log2(F.length(m) + 1)) - 3, F.lit(5)).cast("int").alias("size"),
                F.floor(5 * n_digits / F.greatest(F.length(m), F.lit(1))).cast("int").alias("share"),
                flag(m.rlike(STRICT)).alias("strict"),
                flag(F.lower(before).rlike(GAZETTEER)).alias("gazetteer"),
                flag(before.rlike(CONTEXT)).alias("context"),
                flag((n_digits >= 6) & (m.rlike("[A-Za-z(]") | (shape > 0))).alias("mixed"),
                flag(F.size(F.array_distinct(F.regexp_extract_all(m, F.lit("[0-9]"), F.lit(0)))) >= 5).alias("digits"),
            )
        )

    return _spans(text, CANDIDATE, one)


def reliabilities(counts: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, list[tuple[float, float]]]:
    """EM for two classes and independent labellers: prior, and P(vote | class) as (clean, private).

    Weak priors (as of ten spans) keep the classes apart: labellers mostly fire on private
    spans and rarely on others.
    """
    prior, rate = 0.2, [(0.1, 0.8)] * len(VOTES)
    for _ in range(rounds):
        total, hit = [8.0, 2.0], [[0.8, 1.6] for _ in VOTES]
        for votes, n in counts:
            p = posterior(votes, prior, rate)
            for y, w in ((0, n * (1 - p)), (1, n * p)):
                total[y] += w
                for j, v in enumerate(votes):
                    hit[j][y] += w * v
        prior = total[1] / (total[0] + total[1])
        rate = [(min(h[0] / total[0], 0.999), min(h[1] / total[1], 0.999)) for h in hit]
    return prior, rate


def posterior(votes: tuple[int, ...], prior: float, rate: list[tuple[float, float]]) -> float:
    log = [math.log(1 - prior), math.log(prior)]
    for v, r in zip(votes, rate, strict=True):
        for y in (0, 1):
            log[y] += math.log(r[y] if v else 1 - r[y])
    return 1 / (1 + math.exp(min(700.0, log[0] - log[1])))


def train(docs: DataFrame) -> tuple[float, dict[str, list[float]]]:
    """Span classifier: bias and weights by feature value, from all rows of ``docs``."""
    found = docs.select(F.explode(candidates(F.coalesce(F.col("text"), F.lit("")))).alias("c")).select("c.*")
    names = list(dict.fromkeys([*VOTES, *FEATURES]))
    rows = found.groupBy(*names).count().collect()  # at most 5 x 6 x 6 x 2^5 rows
    patterns: dict[tuple[int, ...], int] = {}
    for r in rows:
        k = tuple(r[v] for v in VOTES)
        patterns[k] = patterns.get(k, 0) + r["count"]
    prior, rate = reliabilities(sorted(patterns.items()))
    total = [1.0, 1.0]
    seen = {f: [[1.0 / n, 1.0 / n] for _ in range(n)] for f, n in FEATURES.items()}
    for r in rows:
        p = posterior(tuple(r[v] for v in VOTES), prior, rate)
        for y, w in ((0, r["count"] * (1 - p)), (1, r["count"] * p)):
            total[y] += w
            for f in FEATURES:
                seen[f][min(max(r[f], 0), FEATURES[f] - 1)][y] += w
    weights = {f: [math.log(b / total[1]) - math.log(a / total[0]) for a, b in v] for f, v in seen.items()}
    return math.log(total[1] / total[0]), weights


def added_spans(text: Column, model: tuple[float, dict[str, list[float]]]) -> Column:
    bias, weights = model

    def score(c: Column) -> Column:
        out = F.lit(bias)
        for f, w in weights.items():
            out = out + F.element_at(F.array(*map(F.lit, w)), F.least(F.greatest(c[f], F.lit(0)), F.lit(len(w) - 1)) + 1)
        return out

    sure = F.filter(candidates(text), lambda c: score(c) >= math.log(CERTAIN / (1 - CERTAIN)))
    return F.transform(sure, lambda c: F.struct(c["start"].alias("start"), (c["shape"] + len(KINDS)).alias("rank"), c["end"].alias("end")))


def _shown(spans: Column) -> Column:
    names = F.array(*map(F.lit, (*KINDS, *ADDED)))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def marked(docs: DataFrame) -> DataFrame:
    """``docs`` with two more columns: ``_base`` and ``_spans``, arrays of ``struct(start, rank, end)``."""
    model = train(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    # a candidate that a base span touches is known already
    new = F.filter(added_spans(text, model), lambda x: ~F.exists("_base", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    return docs.withColumn("_base", base_spans(text)).withColumn("_spans", F.sort_array(F.concat("_base", new)))


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``, then ``n_spans`` and a count of each added kind.

    The four counts and the hash are of the base kinds; ``spans`` has all spans as kind:start:end
    in code points, ``n_spans`` their number. Defined results: a null or empty text has no spans (hash of the empty string);
    repeated rows give a row each; null ids stay null; spans of different kinds may overlap and
    are all listed; an empty table gives an empty result; other columns are not read.
    """
    rows = marked(docs.select("doc_id", "text"))
    # a second parameter of the lambda would be the element's index, so the rank is bound outside
    of = lambda spans, rank: F.size(F.filter(spans, lambda x: x["rank"] == rank)).cast("long")
    counts = [of("_base", rank).alias(f"n_{kind}") for rank, kind in enumerate(KINDS)]
    added = [of("_spans", rank).alias(f"n_{kind}") for rank, kind in enumerate(ADDED, len(KINDS))]
    return rows.select("doc_id", *counts, F.sha2(_shown(F.col("_base")), 256).alias("base_sha256"), _shown(F.col("_spans")).alias("spans"), F.size("_spans").cast("long").alias("n_spans"), *added)


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; ``n_chars``, if there, follows.

    Of overlapping spans the first is named and all are covered. Null texts stay null; every
    row and column stays.
    """
    text = F.col("text")
    names = F.array(*[F.lit(f"<{k}>") for k in (*KINDS, *ADDED)])
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        more = F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, F.element_at(names, x["rank"] + 1)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), more.alias("out"))

    done = F.aggregate("_spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    rows = marked(boxed(docs, "text"))
    same = text.isNull() | (F.size("_spans") == 0)
    rows = rows.select("_row", same.alias("_same"), F.when(same, text).otherwise(done).alias("text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_same"), F.col("_row.n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])
