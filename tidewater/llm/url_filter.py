"""URL filter: rules first, then naive Bayes over segmented host names and path tokens.

Concatenated host labels are split into words by a unigram Viterbi search. The unigram counts
come from the words of all pages (and a small base list); a distinct host meets only the
counts of its own substrings, by a join, so no lexicon has to fit anywhere. Multinomial naive
Bayes has hashed tokens (a fixed number of slots, so the model's size doesn't depend on the
corpus). There are no labelled urls: a list of seed words is only the model's prior, and
expectation-maximisation over all pages' tokens does the rest. It learns words that stand
beside blocked ones and clears seed words that stand among harmless ones, so verdicts differ
from a search for seed words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: (verdict, rule); a rule is a host and a path prefix, and holds for all subdomains.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Words that make a host suspect at first, and common words of host names.
SEEDS = ("casino", "pills", "bets", "betting", "poker", "spam", "porn", "xxx", "adult", "viagra", "ads", "track", "tracker", "win", "cheap", "loan", "farm")
BASE_WORDS = ("www", "blog", "news", "shop", "mail", "example", "com", "net", "org", "free", "online", "the", "my", "web", "site", "home", "page", "info", "forum", "wiki", *SEEDS)
BASE_COUNT = 1000
#: A label of a valid host has at most 63 characters, so no longer word can be part of one.
LONGEST = 63
SLOTS = 1 << 16
SMOOTHING = 0.1
#: The prior: share of blocked pages and its weight in pages; how often each listed word was seen in them, and its log odds at first.
SHARE, PAGES, SEEN, START = 0.05, 20.0, 1.0, 5.0
#: Up to this many distinct hosts their tokens are broadcast; beyond it, joined with pages spread over ``SALTS`` parts a host.
BROADCAST_HOSTS, SALTS = 100_000, 16
#: Labels are cut into substrings in pieces of this length.
PIECE = 1024


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Rule string and its verdict; the longest rule that fits wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, prefix = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def lexicon(pages: DataFrame) -> DataFrame:
    """``word, n``: how often each lower-case word of 2 to 63 letters stands in the pages' html."""
    words = pages.select(F.explode(F.regexp_extract_all(F.lower("html"), F.lit(rf"(?<![a-z])[a-z]{{2,{LONGEST}}}+(?![a-z])"), F.lit(0))).alias("word"))
    base = pages.sparkSession.createDataFrame([(w, BASE_COUNT) for w in sorted({*BASE_WORDS})], "word string, n long")
    return words.groupBy("word").agg(F.count("*").alias("n")).unionByName(base).groupBy("word").agg(F.sum("n").alias("n"))


def viterbi(label: str, counts: dict[str, int], total: int) -> list[str]:
    """Most probable split of a label; an unknown string costs ten times more for each letter."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(label) + 1):
        options = []
        for start in range(max(0, end - LONGEST), end):
            n = counts.get(label[start:end])
            cost = math.log(total / n) if n else math.log(total / 10) + (end - start) * math.log(10)
            options.append((best[start][0] + cost, start))
        best.append(min(options))
    out, at = [], len(label)
    while at:
        out.append(label[best[at][1] : at])
        at = best[at][1]
    return out[::-1]


def segmented(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """``host, tokens`` for distinct ``host``; digits become 0."""
    total = counts.agg(F.sum("n")).first()[0]
    letters = F.regexp_replace("host", "[0-9]+", "0")
    # each label once, in the order of the host's labels; labels of any length
    labels = hosts.select("host", F.posexplode(F.filter(F.split(letters, r"[^a-z0-9]+"), lambda x: x != "")).alias("place", "label"))
    distinct = labels.select("label").distinct()
    pieces = distinct.select("label", F.explode(F.sequence(F.lit(1), F.length("label"), F.lit(PIECE))).alias("from"))
    pieces = pieces.select("label", F.substring("label", F.col("from"), F.lit(PIECE + LONGEST - 1)).alias("piece"))
    starts = pieces.select("label", "piece", F.explode(F.sequence(F.lit(1), F.least(F.length("piece"), F.lit(PIECE)))).alias("at"))
    parts = starts.select("label", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(F.lit(LONGEST), F.length("piece") - F.col("at") + 1))), lambda k: F.substring("piece", F.col("at"), k))).alias("word"))
    # at most 62 words a letter of the label
    known = parts.distinct().join(counts, "word").groupBy("label").agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("ns"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, words, ns = (c.to_pylist() for c in batch.columns)
            out = [viterbi(x, dict(zip(w or (), n or (), strict=True)), total) for x, w, n in zip(label, words, ns, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(out, type=pa.list_(pa.string()))], names=["label", "tokens"])

    tokens = distinct.join(known, "label", "left").mapInArrow(split, "label string, tokens array<string>")
    ordered = F.sort_array(F.collect_list(F.struct("place", "tokens")))
    return labels.join(tokens, "label").groupBy("host").agg(F.flatten(F.transform(ordered, lambda x: x["tokens"])).alias("tokens"))


def prior() -> np.ndarray:
    """Pseudo-counts of tokens, 2 x SLOTS (allow, block): listed words were seen in blocked pages."""
    from xxhash import xxh64_intdigest

    seen = np.full((2, SLOTS), SMOOTHING)
    for word in SEEDS:
        seen[1, xxh64_intdigest(b"h:" + word.encode(), 42) % SLOTS] += SEEN
    return seen


def weights_of(seen: np.ndarray, met: np.ndarray) -> np.ndarray:
    """Log odds of block by slot; slots that nothing met weigh nothing."""
    share = np.log(seen / np.maximum((seen * met).sum(axis=1, keepdims=True), SMOOTHING))
    return np.where(met, share[1] - share[0], 0.0)


def log_odds(slots: pa.ListArray, weights: np.ndarray, base: float) -> np.ndarray:
    of = np.repeat(np.arange(len(slots)), np.diff(slots.offsets.to_numpy()))
    return base + np.bincount(of, weights=weights[slots.flatten().to_numpy(zero_copy_only=False)], minlength=len(slots))


def train(rows: DataFrame, rounds: int = 5) -> tuple[np.ndarray, float]:
    """Log odds of block by slot, and the share's, by expectation-maximisation over ``slots`` of all rows."""
    start, base = prior(), math.log(SHARE / (1 - SHARE))
    weights = START * (start[1] > SMOOTHING)  # before anything is met, only listed words weigh
    rows = rows.select("slots")
    for _ in range(rounds):
        model = rows.sparkSession.sparkContext.broadcast((weights, base))  # SLOTS doubles

        def expect(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            w, b = model.value
            total, block, n, of_block = np.zeros(SLOTS), np.zeros(SLOTS), 0, 0.0
            for batch in batches:
                slots = batch.column(0)
                p = 1 / (1 + np.exp(-np.clip(log_odds(slots, w, b), -50, 50)))
                flat = slots.flatten().to_numpy(zero_copy_only=False)
                total += np.bincount(flat, minlength=SLOTS)
                block += np.bincount(flat, weights=np.repeat(p, np.diff(slots.offsets.to_numpy())), minlength=SLOTS)
                n, of_block = n + len(p), of_block + float(p.sum())
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1].astype(np.int32)), pa.array(np.r_[total[at], n]), pa.array(np.r_[block[at], of_block])], names=["slot", "n", "block"])

        found = rows.mapInArrow(expect, "slot int, n double, block double").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("block").alias("block")).toPandas()  # at most SLOTS + 1 rows
        model.unpersist()
        counts, pages = np.zeros((2, SLOTS)), found[found.slot < 0]
        found = found[found.slot >= 0]
        counts[0, found.slot], counts[1, found.slot] = found.n, found.block
        weights = weights_of(start + np.vstack([counts[0] - counts[1], counts[1]]), counts[0] > 0)
        n, block = float(pages.n.sum()), float(pages.block.sum())
        base = math.log((block + PAGES * SHARE) / (n - block + PAGES * (1 - SHARE)))
    return weights, base


def judge(pages: DataFrame, rules=RULES, rounds: int = 5) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row; ``score`` is the log odds of block.

    Defined results: a null url, or one without ``://``, has empty host and path, no rule, and
    the verdict of no tokens (the share's); null html adds no words; repeated rows give a row
    each; null ids stay null; a score of 0 allows; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"))
    hosts = named.select("host").distinct()
    tokens = cut(segmented(hosts, cut(lexicon(pages.select("html")))))
    if tokens.count() <= BROADCAST_HOSTS:
        met = named.join(F.broadcast(tokens), "host", "left")
    else:
        salted = tokens.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = named.withColumn("_s", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(salted, ["host", "_s"], "left")
    of_path = F.filter(F.split(F.regexp_replace(F.lower("path"), "[0-9]+", "0"), "[^a-z0-9]+"), lambda x: x != "")
    slot = lambda prefix: lambda x: F.pmod(F.xxhash64(F.concat(F.lit(prefix), x)), F.lit(SLOTS)).cast("int")
    none = F.array().cast("array<string>")
    rows = cut(met.select("page_id", "host", "path", F.concat(F.transform(F.coalesce("tokens", none), slot("h:")), F.transform(of_path, slot("p:"))).alias("slots")))
    weights, base = train(rows, rounds)
    model = pages.sparkSession.sparkContext.broadcast(weights)  # SLOTS doubles

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(log_odds(batch.column(3), w, base))], names=["page_id", "host", "path", "score"])

    kind = dict(named.dtypes)["page_id"]
    scored = rows.select("page_id", "host", "path", "slots").mapInArrow(score, f"page_id {kind}, host string, path string, score double")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("score") > 0, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.round("score", 6).alias("score"))
