"""Phrase collocations by passes with hashed bucket counts (PCY, DHP) and Apriori pruning.

A-Z are lower-cased, texts are cut at ``[.,;:!?`` and line ends``]`` into pieces and those at
blanks and tabs into words. Everything is counted per language (null: ``und``): words, and
phrases of two to four words within a piece that occur ``least`` times or more.

Pass k counts exactly those phrases of k words that no bitmap rules out, and beside that adds
up a table of hashed buckets for the phrases of k + 1 words. Before the next pass two bitmaps
are broadcast: the buckets that reached ``least`` (PCY), and the hashes of the phrases found
frequent (Apriori: both parts of a frequent phrase, without its first and without its last
word, are frequent). A phrase of k + 1 words enters the bucket table only where both its parts
passed the bitmaps (DHP's trimming). Bitmaps have no false negatives, so the exact counts that
follow are whole; a false positive only costs a count. Their size is fixed by ``bits``, which
follows the table's size up to 2^24 buckets (2 MB a bitmap).

Tasks work on slices of some megabytes as arrays of word numbers; a slice gives one row for
each distinct phrase, a task one row for each 4096 buckets. Both lie in one table of the shared
folder; Spark adds phrases up before and after a shuffle, and bucket rows meet by their part in
tasks that add them as they come. No language or word is gathered in one task: the last ranking
goes through 4096 and 64 parts of a language.

Defined results: null and empty texts have no words; repeated rows count each; a language
without candidates has no rows; an empty table gives none; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_folder, shared_dir

LONGEST = 4
SLICE = 2 << 20
#: Rows of a batch that become Python objects together.
ROWS = 2048
MOST_BITS = 24
#: Distinct words whose hashes a task remembers.
KNOWN = 150_000
#: Buckets of a row.
PART = 4096
_STOP = b"."
_LETTERS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz.........\x20")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_RAW = "lang string, phrase binary, h long, n long, part int, buckets binary"


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread a combined hash over all 64 bits."""
    h = (h ^ (h >> np.uint64(32))) * _ODD
    return h ^ (h >> np.uint64(29))


class _Numbers(dict):
    """Word -> number, in order of appearance within a slice."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Pass:
    """One task's share of pass ``k``: exact counts of k words, bucket counts of k + 1."""

    def __init__(self, k: int, bits: int, least: int, buckets: np.ndarray | None, parts: np.ndarray | None):
        self.k, self.bits, self.least, self.bitmap, self.parts = k, bits, least, buckets, parts
        self.known: dict[bytes, int] = {}
        self.table = np.zeros(1 << bits, dtype=np.int32) if k < LONGEST else None
        self.room = 1 << 30

    def _at(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _has(self, bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = self._at(h)
        return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def hashes(self, numbers: _Numbers, lang: str) -> np.ndarray:
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        seed = xxhash.xxh64_intdigest(lang.encode())
        out = np.empty(len(numbers), dtype=np.uint64)
        for i, w in enumerate(numbers):
            if (h := known.get(w)) is None:
                known[w] = h = xxhash.xxh64_intdigest(w)
            out[i] = h ^ seed
        return out

    def count(self, lang: str, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, int]:
        """Distinct phrases of k words, their hashes and counts in one slice, and its number of words."""
        numbers = _Numbers({_STOP: 0})
        words = b" . ".join(texts).translate(_LETTERS).replace(_STOP, b" . ").split()
        ids = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))
        del words
        of = self.hashes(numbers, lang)
        names, base, h = list(numbers), len(numbers), of[ids]
        total = int(np.count_nonzero(ids))
        # hashes of the phrases of every length up to k + 1 that start at each word; a shorter one ends at a stop
        single = [h]
        for j in range(1, self.k + 1):
            last = single[-1]
            single.append(_mixed(last[: len(last) - 1] * _ODD + h[j:]) if len(last) > 1 else last[:0])
        start = np.flatnonzero(self._whole(ids, self.k))
        if self.k > 1:
            start = start[self._has(self.bitmap, single[self.k - 1][start])]
            if len(start):
                part = single[self.k - 2]
                start = start[self._has(self.parts, part[start]) & self._has(self.parts, part[start + 1])]
        if self.table is not None and len(start) > 1:
            both = start[:-1][np.diff(start) == 1]
            if len(both) > self.room:
                # only "least or more" matters, so that much is enough to remember
                np.minimum(self.table, self.least, out=self.table)
                self.room = 1 << 30
            self.room -= len(both)
            np.add.at(self.table, self._at(single[self.k][both]), 1)
        if not len(start):
            return [], h[:0], start, total
        key = ids[start]
        for j in range(1, self.k):
            # the pair (number so far, next word) stays below 2^63: both are numbers within one slice
            _, key = np.unique(key * base + ids[start + j], return_inverse=True)
        _, first, times = np.unique(key, return_index=True, return_counts=True)
        at = start[first]
        columns = [ids[at + j].tolist() for j in range(self.k)]
        return [b" ".join([names[i] for i in row]) for row in zip(*columns, strict=True)], single[self.k - 1][at], times, total

    @staticmethod
    def _whole(ids: np.ndarray, k: int) -> np.ndarray:
        """True where k words follow each other without a stop."""
        n = len(ids) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=bool)
        ok = ids[:n] > 0
        for j in range(1, k):
            ok = ok & (ids[j : n + j] > 0)
        return ok


def _slices(langs: list, texts: list) -> Iterator[tuple[str, list[bytes]]]:
    """Texts by language, some megabytes together; a longer text stands alone."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for lang, text in zip(langs, texts, strict=True):
        if text:
            lang = "und" if lang is None else lang
            if lang in size and size[lang] + len(text) > SLICE:
                yield lang, held.pop(lang)
                size.pop(lang)
            held.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
    yield from held.items()


def _pass(texts: DataFrame, k: int, bits: int, least: int, bitmaps) -> DataFrame:
    """Rows of counted phrases, of words per language (no phrase) and of bucket counts (no language)."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("h", pa.int64()), ("n", pa.int64()), ("part", pa.int32()), ("buckets", pa.binary())])
    width = _width(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _Pass(k, bits, least, *(bitmaps.value if bitmaps is not None else (None, None)))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                for lang, part in _slices(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    phrases, h, n, total = work.count(lang, part)
                    m = len(phrases) + (k == 1)
                    if k == 1:
                        phrases, h, n = [*phrases, None], np.append(h, np.uint64(0)), np.append(n, total)
                    if m:
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * m), pa.array(phrases, pa.binary()), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], schema=schema)
        if work.table is not None:
            for part in range(0, 1 << bits, PART):
                counts = work.table[part : part + PART]
                if counts.any():
                    yield pa.RecordBatch.from_arrays([*[pa.nulls(1, f.type) for f in list(schema)[:4]], pa.array([part // PART], pa.int32()), pa.array([np.minimum(counts, least).astype(width).tobytes()], pa.binary())], schema=schema)

    return texts.mapInArrow(run, _RAW)


def _width(least: int) -> type:
    """Bucket counts stop at ``least``, so mostly a byte holds one."""
    return np.uint8 if least < 256 else np.uint32


def _full_buckets(stored: DataFrame, bits: int, least: int, tasks: int) -> np.ndarray:
    """Bitmap of the buckets that reach ``least`` over all tasks' rows; 2^bits / 8 bytes come to the driver."""
    width = _width(least)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = np.frombuffer(counts, dtype=width).astype(np.uint32)
                total[part] = np.minimum(total[part] + more, least) if part in total else more
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.packbits(v >= least, bitorder="little").tobytes() for v in total.values()], pa.binary())], names=["part", "bits"])

    out = np.zeros(max(1 << bits >> 3, 1), dtype=np.uint8)
    for part, data in stored.where("part is not null").select("part", "buckets").repartition(tasks, "part").mapInArrow(add, "part int, bits binary").collect():
        out[part * PART // 8 : part * PART // 8 + len(data)] = np.frombuffer(bytes(data), dtype=np.uint8)
    return out


def _bitmap(positions: DataFrame, column: str, bits: int) -> np.ndarray:
    """The bits at the given positions, packed on the executors: at most 2^bits / 8 bytes come to the driver."""
    out = np.zeros(max(1 << bits >> 3, 4096), dtype=np.uint8)
    p = F.col(column).cast("long")
    packed = positions.groupBy(F.shiftright(p, 15).alias("part")).agg(F.bitmap_construct_agg(p.bitwiseAND(32767)).alias("bits"))
    for part, data in packed.collect():
        out[part * 4096 : part * 4096 + len(data)] = np.frombuffer(bytes(data), dtype=np.uint8)
    return out


def frequent(docs: DataFrame, least: int = 30, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, n`` of all phrases of one to four words that occur ``least`` times, and ``lang, n`` of all words.

    Both lie in the shared folder. ``bits`` (buckets are 2^bits) follows the size of the table
    where it is not given; it changes the work, never the result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("lang"), F.col("text").cast("binary").alias("text")).where("text is not null")
    if bits is None:
        held = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        bits = min(MOST_BITS, max(16, (held // 4).bit_length()))
    root, bitmaps, found, words = shared_dir(spark), None, [], None
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for k in range(1, LONGEST + 1):
        _pass(texts, k, bits, least, bitmaps).write.option("parquet.block.size", 16 << 20).parquet(f"{root}/raw{k}")
        raw = spark.read.schema(_RAW).parquet(f"{root}/raw{k}")
        raw.where("phrase is not null").groupBy("lang", "phrase", "h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).write.parquet(f"{root}/{k}")
        counted = spark.read.schema("lang string, phrase binary, h long, n long").parquet(f"{root}/{k}")
        found.append(counted.select("lang", F.col("phrase").cast("string").alias("phrase"), F.lit(k).alias("words"), "n"))
        if k == 1:
            raw.where("phrase is null and lang is not null").groupBy("lang").agg(F.sum("n").alias("n")).write.parquet(f"{root}/words")
            words = spark.read.schema("lang string, n long").parquet(f"{root}/words")
        if k < LONGEST:
            both = _full_buckets(raw, bits, least, tasks), _bitmap(counted.select(F.shiftrightunsigned("h", 64 - bits).alias("at")), "at", bits)
            if bitmaps is not None:
                bitmaps.unpersist()
            bitmaps = spark.sparkContext.broadcast(both)
        drop_folder(spark, f"{root}/raw{k}")
    bitmaps.unpersist()
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    return every, words


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, bits: int | None = None) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``top`` phrases.

    A phrase's score is that of its weakest cut, floor(2000000 a / (l + r)); it is dropped if a
    longer candidate that holds its words has four fifths of its occurrences or more.
    """
    every, words = frequent(docs, least, bits)
    candidates = every.where("words > 1")
    parts = F.split("phrase", " ", -1)
    between = lambda i, j: F.array_join(F.slice(parts, i, j), " ")
    cuts = F.array(*[F.when(F.col("words") > k, F.struct(F.lit(k).alias("k"), between(F.lit(1), F.lit(k)).alias("left"), between(F.lit(k + 1), F.col("words") - k).alias("right"))) for k in range(1, LONGEST)])
    cut = candidates.select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.filter(cuts, lambda c: c.isNotNull())).alias("c")).select("lang", "phrase", "words", "a", "c.*")
    counts = every.where(F.col("words") < LONGEST)
    side = lambda name, value: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(value))
    scored = cut.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    long = lambda c: F.col(c).cast("decimal(20,0)")
    scored = scored.withColumn("score", F.expr("cast(cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0)) as decimal(38,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "words", "a", "b.score", "b.l", "b.r")

    inner = F.array(*[F.when(F.col("words") >= i + j, between(F.lit(i + 1), F.lit(j))) for j in range(2, LONGEST) for i in range(LONGEST - j + 1)])
    inside = candidates.where("words > 2").select("lang", "words", F.col("n").alias("longer"), F.explode(F.array_distinct(F.filter(inner, lambda x: x.isNotNull()))).alias("phrase"))
    # an inner phrase of as many words as the longer one is the longer one itself
    inside = inside.where(F.size(parts) < F.col("words")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (long("longer") * 100 < long("a") * 80)).drop("longer", "words")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    for salt in (4096, 64):
        kept = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salt)))
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "salt")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_WORDS = """words AS (
  SELECT d, lang, p, i, w FROM (
    SELECT d, lang, p, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
      SELECT d, lang, p, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM (
        SELECT d, lang, unnest(ps) AS piece, generate_subscripts(ps, 1) AS p FROM (
          SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
            string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS ps
          FROM documents WHERE text IS NOT NULL)))))"""


def _oracle(least: int = 30, top: int = 2000) -> str:
    then = ", ".join(f"lead(w, {j}) OVER o AS w{j}" for j in range(1, LONGEST))
    name = ["w", *[f"w || {' || '.join(repr(' ') + f' || w{j}' for j in range(1, k))}" for k in range(2, LONGEST + 1)]]
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS words, {name[k - 1]} AS phrase, count(*) AS f FROM follow{'' if k == 1 else f' WHERE w{k - 1} IS NOT NULL'} GROUP BY ALL HAVING count(*) >= {least}" for k in range(1, LONGEST + 1))
    joined = lambda a, b: f"array_to_string(x[{a}:{b}], ' ')"
    return f"""WITH {_WORDS}, follow AS (SELECT lang, w, {then} FROM words WINDOW o AS (PARTITION BY d, p ORDER BY i)),
grams AS MATERIALIZED ({grams}), total AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
candidates AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS x FROM grams WHERE words > 1),
scored AS (SELECT c.lang, c.words, c.phrase, c.a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, words)) AS k FROM candidates) c
  JOIN grams l ON l.lang = c.lang AND l.phrase = {joined(1, "k")} JOIN grams r ON r.lang = c.lang AND r.phrase = {joined("k + 1", "c.words")}),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, {joined("i", "i + j - 1")} AS phrase, max(a) AS longer FROM (
  SELECT *, unnest(range(1, words - j + 2)) AS i FROM (SELECT *, unnest(range(2, words)) AS j FROM candidates WHERE words > 2)) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN total USING (lang) WHERE rank <= {top}"""


ORACLE_SQL = _oracle()
