"""Quality classifier from weak labels.

Eight heuristic labellers vote good, bad or abstain on every document. Their votes overlap and
depend on each other: table rows are also full of symbols and shout. So a bad document has a
kind, and labellers are independent only within good documents and within each kind of bad ones.
Expectation-maximisation over the counts of vote patterns (at most 3^8, from all rows) estimates
how many kinds there are, their shares and how often each labeller accuses in each, without true
labels; good documents are accused at one rate, estimated like all the rest. The posterior of a document's pattern is its soft label. A linear scorer over hashed word features is
learned from the soft labels of all documents: a feature's weight is the logarithm of how much more
often good documents have it than bad ones. It judges every whole document, also where all labellers
abstain. The cutoff needs no labels either: it has the least expected loss on all soft labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import portions, shared_dir
from .quality_rules import BLANKS, SYMBOLS, UPPER

#: Fixed value: frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that for it with as was on are this "
    "le la de et les des en un une que qui dans du pour "
    "der die und das von zu den mit ist ein eine auf "
    "el los las y del por con una su al se para"
).split()
LABELLERS = ("symbols", "shouting", "exclaims", "stop_words", "lines", "word_length", "table", "variety")
SLOTS = 1 << 16
#: Soft labels and shares of words are whole multiples of these parts of one, so that sums don't hang on the order of rows.
SOFT, SHARE = 1 << 12, 1 << 32
#: Cutoffs lie on a grid: so many to a unit of the score.
GRID = 1024


def votes(text: Column) -> Column:
    """A string of one letter a labeller: g (good), b (bad) or a (abstains)."""
    n = F.length(text)
    count = lambda letters: n - F.length(F.translate(text, letters, ""))
    letters = n - count(BLANKS)
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    stops = F.size(F.array_intersect(F.split(F.lower(text), r"[\x20\x09-\x0D,.;:!?|]+"), F.array(*map(F.lit, STOP_WORDS))))

    def vote(enough: Column, bad: Column, good: Column) -> Column:
        return F.when(enough & bad, "b").when(enough & good, "g").otherwise("a")

    some = letters >= 20
    return F.concat(
        vote(some, 25 * count(SYMBOLS) > letters, count(SYMBOLS) * 200 < letters),
        vote(some, 10 * count(UPPER) > 4 * letters, 10 * count(UPPER) < letters),
        vote(some, 30 * count("!") > letters, 200 * count("!") < letters),
        vote(F.size(words) >= 30, stops <= 2, stops >= 6),
        vote(F.size(lines) >= 4, 3 * (F.size(lines) - F.size(F.array_distinct(lines))) > F.size(lines), F.size(lines) == F.size(F.array_distinct(lines))),
        vote(F.size(words) >= 10, (letters > 11 * F.size(words)) | (letters < 2 * F.size(words)), (letters < 8 * F.size(words)) & (letters > 3 * F.size(words))),
        vote(F.size(words) >= 10, 6 * count("|") > F.size(words), count("|") == 0),
        vote(F.size(words) >= 20, 100 * F.size(F.array_distinct(words)) < 20 * F.size(words), 100 * F.size(F.array_distinct(words)) > 35 * F.size(words)),
    )


_STOPS = frozenset(w.encode() for w in STOP_WORDS)
_PARTED = bytes.maketrans(b",.;:!?|", b" " * 7)


def ballot(text: str) -> str:
    """The same as ``votes`` for one text, where it is at hand."""
    raw = text.encode()
    bare = raw.translate(None, BLANKS.encode())
    letters, count = len(text) - len(raw) + len(bare), lambda some: len(bare) - len(bare.translate(None, some.encode()))
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    symbols, upper, exclaims, bars = count(SYMBOLS), count(UPPER), raw.count(b"!"), raw.count(b"|")
    n, rows, distinct, kinds = len(words), len(lines), len({*lines}), len({*words})
    stops = len(_STOPS.intersection(raw.lower().translate(_PARTED).split()))
    some = letters >= 20
    cast = (
        (some, 25 * symbols > letters, symbols * 200 < letters),
        (some, 10 * upper > 4 * letters, 10 * upper < letters),
        (some, 30 * exclaims > letters, 200 * exclaims < letters),
        (n >= 30, stops <= 2, stops >= 6),
        (rows >= 4, 3 * (rows - distinct) > rows, rows == distinct),
        (n >= 10, letters > 11 * n or letters < 2 * n, 3 * n < letters < 8 * n),
        (n >= 10, 6 * bars > n, bars == 0),
        (n >= 20, 100 * kinds < 20 * n, 100 * kinds > 35 * n),
    )
    return "".join("a" if not enough else "b" if bad else "g" if good else "a" for enough, bad, good in cast)


Model = tuple[np.ndarray, np.ndarray]


def _outcomes(patterns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Where each labeller accuses, and where it votes at all; an abstention says nothing."""
    return tuple(np.array([[v in some for v in p] for p in patterns], dtype=float).reshape(-1, len(LABELLERS)) for some in ("b", "gb"))


def _expect(bad: np.ndarray, voted: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of all kinds by pattern, and the logarithm of each pattern's likelihood."""
    shares, rates = model
    logs = bad @ np.log(rates).T + (voted - bad) @ np.log(1 - rates).T + np.log(shares)
    top = logs.max(axis=1, keepdims=True)
    each = np.exp(logs - top)
    total = each.sum(axis=1, keepdims=True)
    return each / total, (top + np.log(total))[:, 0]


def expectation_maximisation(bad: np.ndarray, voted: np.ndarray, n: np.ndarray, model: Model, rounds: int = 200) -> tuple[Model, float]:
    """Rounds of EM from ``model``, until the likelihood rests, and the logarithm of that likelihood.

    Good documents (row 0) have one rate of false accusation for all labellers, kinds of bad ones
    a rate for each. One document more on either side keeps rates and shares from 0 and 1.
    """
    before = -math.inf
    for _ in range(rounds):
        p, each = _expect(bad, voted, model)
        like = float(n @ each)
        if like - before < 1e-7 * abs(like):
            break
        before = like
        w = p * n[:, None]
        shares = w.sum(axis=0) + 1
        accused, said = w.T @ bad, w.T @ voted
        rates = (accused + 1) / (said + 2)
        rates[0] = (accused[0].sum() + 1) / (said[0].sum() + 2)
        model = shares / shares.sum(), rates
    return model, like


def accuracies(patterns: list[tuple[str, int]], start: float = 0.01) -> Model:
    """Shares of good documents (first) and of each kind of bad ones, and how often each labeller accuses them.

    Votes alone can't tell a careless labeller from junk that it alone finds. What settles it is
    agreement: labellers share one rate of false accusation, so that a labeller that accuses alone
    far more often than the others do has found a kind of its own, and accusations scattered evenly
    over all are mistakes. EM begins with a kind for each labeller; then the kind whose loss costs
    the least likelihood goes, as long as the Bayesian information criterion falls. ``start`` is
    the rate that EM begins with; tests hold results alike from 0.002 to 0.1.
    """
    k = len(LABELLERS)
    (bad, voted), n = _outcomes([p for p, _ in patterns]), np.array([float(c) for _, c in patterns])
    model, like = expectation_maximisation(bad, voted, n, (np.array([0.8] + [0.2 / k] * k), np.vstack([np.full(k, start), np.where(np.eye(k), 0.95, 0.02)])))
    price = (k + 1) / 2 * math.log(n.sum())
    while len(model[0]) > 2:
        fewer = []
        for gone in range(1, len(model[0])):
            shares = np.delete(model[0], gone)
            fewer.append(expectation_maximisation(bad, voted, n, (shares / shares.sum(), np.delete(model[1], gone, axis=0))))
        best = max(fewer, key=lambda x: x[1])
        if best[1] + price < like:
            break
        model, like = best
    return model


def posteriors(patterns: list[str], model: Model) -> np.ndarray:
    """Probabilities that documents with these votes are good."""
    return _expect(*_outcomes(patterns), model)[0][:, 0]


def reliabilities(docs: DataFrame) -> DataFrame:
    """What EM found: ``kind`` (0: good documents), ``share``, ``labeller``, ``accuses`` (how often); no rows without documents."""
    counts = _patterns(docs)
    shares, rates = accuracies(counts) if counts else ([], [])
    rows = [(i, float(s), name, float(x)) for i, (s, r) in enumerate(zip(shares, rates, strict=True)) for name, x in zip(LABELLERS, r, strict=True)]
    return docs.sparkSession.createDataFrame(rows, "kind int, share double, labeller string, accuses double")


def _patterns(docs: DataFrame) -> list[tuple[str, int]]:
    """Vote patterns of all rows with their counts: at most 3^8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter(ballot(t or "") for (texts,) in portions(batches) for t in texts)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), type=pa.string()), pa.array(list(counts.values()), type=pa.int64())], names=["pattern", "n"])

    return sorted((r.pattern, r.n) for r in docs.select("text").mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect())


_RUNS = ((re.compile("[A-Z]+"), "A"), (re.compile("[a-z]+"), "a"), (re.compile("[0-9]+"), "0"), (re.compile(r"[^\x00-\x7f]+"), "u"))


_CLASSES = str.maketrans(UPPER + UPPER.lower() + "0123456789", "A" * 26 + "a" * 26 + "0" * 10)


@lru_cache(100_000)
def _hashed(s: str) -> int:
    return xxhash.xxh64_intdigest(s) & (SLOTS - 1)


@lru_cache(100_000)
def _shape(word: str) -> int:
    for pattern, to in _RUNS:
        word = pattern.sub(to, word)
    return _hashed("s" + word)


def features(word: str) -> tuple[int, int, int]:
    """Slots of a word: its shape, its end, and itself in lower case without its ends' punctuation."""
    return _shape(word[:64].translate(_CLASSES)), _hashed("e" + word[-2:]), xxhash.xxh64_intdigest("w" + word.lower().strip(".,;:!?|#*$%&<>\"'()")) & (SLOTS - 1)


def whole(words: list[str], distinct: int, text: str) -> tuple[int, int]:
    """Slots of the whole text: how varied its words are, and how many lines repeat."""
    lines = [x for x in text.split("\n") if x]
    again = 10 * (len(lines) - len(set(lines))) // max(1, len(lines))
    varied = 10 * distinct // len(words) if len(words) >= 20 else 10
    return xxhash.xxh64_intdigest(f"v{varied}") & (SLOTS - 1), xxhash.xxh64_intdigest(f"l{again}") & (SLOTS - 1)


def vector(text: str | None) -> Counter:
    """Hashed features of a text; the slots of words hold their shares."""
    words = (text or "").split()
    found: Counter = Counter()
    kinds = Counter(words)
    for w, k in kinds.items():
        for slot in features(w):
            found[slot] += k / len(words)
    for slot in whole(words, len(kinds), text) if words else ():
        found[slot] += 1.0
    return found


def fit(good: np.ndarray, bad: np.ndarray, n_good: float, n_bad: float) -> np.ndarray:
    """Weights of slots from the sums of their values in good and in bad documents, both weighed by soft labels.

    A slot's rate is its mean value in a document. Both rates gain the rate of an even spread, so
    that rare slots weigh little. A class without documents says nothing.
    """
    even = 1 / SLOTS
    rates = [x / n if n else np.zeros(SLOTS) for x, n in ((good, n_good), (bad, n_bad))]
    return np.log(rates[0] + even) - np.log(rates[1] + even) if n_good and n_bad else np.zeros(SLOTS)


def cutoff(scores: np.ndarray, y: np.ndarray, regret: float, bad: np.ndarray | None = None) -> float:
    """Least kept score at which soft labels expect the least loss: ``y`` good documents of each score, and ``bad`` ones (1 - y, if not given).

    A good document lost weighs as much as ``regret`` bad ones kept; of equal losses the lowest
    cutoff counts; it lies halfway between the scores on both sides.
    """
    if not len(scores):
        return 0.0
    order = np.argsort(scores, kind="stable")
    s, y, bad = scores[order], y[order], (1 - y if bad is None else bad)[order]
    loss = regret * np.r_[0.0, np.cumsum(y)] + np.r_[np.cumsum(bad[::-1])[::-1], 0.0]
    edges = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True])  # equal scores are not parted
    k = int(edges[np.argmin(loss[edges])])
    return float(s[0] - 1 if k == 0 else s[-1] + 1 if k == len(s) else (s[k - 1] + s[k]) / 2)


def _sums(docs: DataFrame, soft: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Values of each slot in good and in bad documents, summed over all documents by ``soft`` labels of patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, found, size, held = defaultdict(lambda: defaultdict(int)), np.zeros((2, SLOTS), dtype=np.int64), 0, 0

        def fold() -> None:
            for y, words in words_of.items():
                at, values = np.array([features(w) for w in words]), np.array(list(words.values()))
                for k, weight in enumerate((y, SOFT - y)):
                    if weight:
                        np.add.at(found[k], at, (values * weight)[:, None])
            words_of.clear()

        def told() -> pa.RecordBatch:
            fold()
            at = np.flatnonzero(found.any(axis=0))
            out = pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(x[at]) for x in found]], names=["slot", "good", "bad"])
            found[:] = 0
            return out

        for (texts,) in portions(batches):
            for t in texts:
                words = (t or "").split()
                if not words:
                    continue
                y, share = soft[ballot(t)], SHARE // len(words)
                mine = words_of[y]
                held -= len(mine)
                for w in words:
                    mine[w] += share
                held += len(mine)
                for slot in whole(words, len({*words}), t):
                    found[0, slot] += SHARE * y
                    found[1, slot] += SHARE * (SOFT - y)
                size += 1
                if size % 100_000 == 0:  # sums of so many documents fit 64 bits
                    yield told()
                    held = 0
                elif held > 100_000:  # words of all labels together
                    fold()
                    held = 0
        yield told()

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).cast("double").alias(c)
    rows = docs.select("text").mapInArrow(run, "slot int, good long, bad long").groupBy("slot").agg(exact("good"), exact("bad")).toPandas()  # SLOTS rows, whatever the corpus
    out = np.zeros((2, SLOTS))
    out[:, rows["slot"].to_numpy()] = rows[["good", "bad"]].to_numpy(dtype=float).T / (SHARE * SOFT)
    return out[0], out[1]


def learn(docs: DataFrame) -> tuple[dict[str, int], np.ndarray, float]:
    """Soft labels of vote patterns (in parts of ``SOFT``), weights and bias of the scorer, from all rows of ``docs``."""
    counts = _patterns(docs)
    if not counts:
        return {}, np.zeros(SLOTS), 1.0
    patterns = [p for p, _ in counts]
    soft = dict(zip(patterns, np.rint(posteriors(patterns, accuracies(counts)) * SOFT).astype(int).tolist(), strict=True))
    good = sum(n * soft[p] for p, n in counts) / SOFT
    return soft, fit(*_sums(docs, soft), good, sum(n for _, n in counts) - good), 0.0


def _scorer(weights: np.ndarray, bias: float) -> Callable[[str | None], float | None]:
    """The score of a text, null without words; words met before are kept, up to 100,000."""

    class Known(dict):
        def __missing__(self, word: str) -> float:
            x = float(sum(weights[i] for i in features(word)))
            if len(self) < 100_000:
                self[word] = x
            return x

    get = Known().__getitem__

    def score(t: str | None) -> float | None:
        words = (t or "").split()
        if not words:
            return None
        x, y = whole(words, len({*words}), t)
        return float(bias + weights[x] + weights[y] + sum(map(get, words)) / len(words))

    return score


def _labelled(docs: DataFrame, soft: dict[str, int], weights: np.ndarray, bias: float) -> DataFrame:
    """``docs`` with ``_score`` (null without words) and the soft label ``_soft`` instead of the text; all other columns pass through."""
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))  # SLOTS doubles, whatever the corpus
    place = docs.columns.index("text")
    fields = [f for f in docs.schema.fields if f.name != "text"] + [StructField("_score", DoubleType()), StructField("_soft", LongType())]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(*model.value)
        for batch in batches:
            scores, labels = [], []
            for (texts,) in portions(iter([batch.select([place])])):
                scores += map(score, texts)
                labels += [soft[ballot(t or "")] for t in texts]
            columns = [c for k, c in enumerate(batch.columns) if k != place]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, type=pa.float64()), pa.array(labels, type=pa.int64())], names=names)

    return docs.mapInArrow(run, StructType(fields))


def _score(docs: DataFrame, weights: np.ndarray, bias: float) -> Column:
    """The score of each text of ``docs``. Only the text goes to Python and only the score comes back; the rest of the row stays where it is."""
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))  # SLOTS doubles, whatever the corpus

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = _scorer(*model.value)
        for batch in batches:
            yield pa.array([score(t) for lo in range(0, len(batch), 512) for t in batch.slice(lo, 512).to_pylist()], type=pa.float64())

    return F.arrow_udf(run, DoubleType())(docs["text"])


def _least(judged: DataFrame, regret: float) -> float:
    """The cutoff on a grid of ``GRID`` steps a unit, from scores and soft labels of all documents."""
    cells = judged.where("_score is not null").groupBy(F.floor(F.col("_score") * GRID).alias("cell")).agg(F.sum("_soft").alias("good"), F.count("*").alias("n")).toPandas()
    good = cells["good"].to_numpy(dtype=float) / SOFT
    return cutoff((cells["cell"].to_numpy(dtype=float) + 0.5) / GRID, good, regret, cells["n"].to_numpy(dtype=float) - good)


def train(docs: DataFrame, regret: float = 5.0) -> tuple[np.ndarray, float, float]:
    """Weights, bias and cutoff of the scorer, from the texts of all rows of ``docs``."""
    soft, weights, bias = learn(docs)
    return weights, bias, _least(_labelled(docs.select("text"), soft, weights, bias), regret)


def classify(docs: DataFrame, regret: float = 5.0) -> DataFrame:
    """``doc_id, score, kept`` for every row; a good document lost weighs ``regret`` bad ones kept.

    Defined results: a null, empty or blank text has no score and is rejected; repeated rows give
    a row each, with equal scores; null ids stay null; a score that equals the cutoff is kept; an
    empty table gives an empty result; only id and text are read.
    """
    docs = docs.select("doc_id", "text")
    soft, weights, bias = learn(docs)
    judged, path = _labelled(docs, soft, weights, bias), shared_dir(docs.sparkSession)
    judged.write.parquet(path)  # 24 bytes a document, scored once
    rows = docs.sparkSession.read.schema(judged.schema).parquet(path)
    return rows.select("doc_id", F.round("_score", 6).alias("score"), F.coalesce(F.col("_score") >= _least(rows, regret), F.lit(False)).alias("kept"))


def keep(docs: DataFrame, regret: float = 5.0) -> DataFrame:
    """The rows that the scorer keeps, with their columns as they are."""
    weights, bias, least = train(docs, regret)
    return docs.where(_score(docs, weights, bias) >= least)
