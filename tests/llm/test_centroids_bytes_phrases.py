"""Centroid clustering, byte-level BPE by tree reduction and phrases against plain versions; edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidewater.llm import bytebpe, centroids, phrases
from tidewater.llm.queries import vocabulary

MULTI = "byte_bpe_multi_50k.tiktoken"


# --- centroids -------------------------------------------------------------------


def plain_clusters(rows, k, rounds, size):
    """Python integers only. rows: (id, vector)."""
    kept = [(i, [math.floor(256 * v) for v in x]) for i, x in rows if x is not None and len(x) == size and all(v is not None and math.isfinite(v) and math.isfinite(256 * v) for v in x)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    c = [x for _, x in seeds]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        c = [[sum(v) // len(groups[j]) for v in zip(*groups[j], strict=True)] if j in groups else y for j, y in enumerate(c)]
    found = [(i, *nearest(x)[::-1]) for i, x in kept]
    per = Counter()
    for _, j, d in found:
        per[j] += d
    top = centroids.TOP
    capped = Counter()
    for _, j, d in found:
        capped[j] += min(d, top)
    every = min(sum(capped.values()), top)
    return sorted(((i, j, min(d, top), min(capped[j], top), every, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in found), key=str)


def test_clusters_equal_plain_integers(spark):
    rnd = random.Random(3)
    # coarse values: many exact ties, repeated rows and ids, nulls and odd lengths
    rows = [(i % 90, [rnd.choice((-0.25, 0.0, 0.25, 0.5)) for _ in range(4)], "clash", i) for i in range(300)]
    rows += [(1000, None, "x", 0), (1001, [1.0, 2.0], "x", 0), (1002, [1.0, None, 0.0, 0.0], "x", 0), (1003, [float("nan")] * 4, "x", 0), (1004, [float("inf")] * 4, "x", 0), (1005, [], "x", 0), (None, [0.5] * 4, "x", 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string, distance int").repartition(7)
    got = sorted(map(tuple, centroids.cluster(df, 12, 5, 4).collect()), key=str)
    assert got == plain_clusters([r[:2] for r in rows], 12, 5, 4)
    assert centroids.cluster(df.limit(0), 12, 5, 4).collect() == []
    assert {r.cluster for r in centroids.cluster(df.where("vec_id in (3, 4)"), 12, 2, 4).collect()} <= set(range(12))


@pytest.mark.parametrize("kind, large", [("float", 1e18), ("float", 1e36), ("double", 1e200), ("double", 1e305)])
def test_any_finite_component(spark, kind, large):
    rnd = random.Random(5)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(3)]) for i in range(40)] + [(100 + i, [rnd.choice((-1, 1)) * large * rnd.choice((1, 0.5)) for _ in range(3)]) for i in range(12)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    stored = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(map(tuple, centroids.cluster(df, 6, 3, 3).collect()), key=str) == plain_clusters(stored, 6, 3, 3)


def test_intervals_hold_and_spare_work():
    rnd = np.random.default_rng(1)
    for scale in (3, 300, 1 << 20, 1 << 40):
        c = [[int(v) for v in row] for row in rnd.integers(-scale, scale, (40, 64))]
        x = rnd.integers(-scale, scale, (500, 64)).astype(float)
        x[:40] = c
        x[40:60] = (np.array(c[:20]) + np.array(c[20:])) // 2
        s = centroids.Screen(c)
        number, d = s.nearest(x)
        want = [min((sum((int(a) - b) ** 2 for a, b in zip(row, y, strict=True)), j) for j, y in enumerate(c)) for row in x.tolist()]
        assert [(int(a), int(b)) for a, b in zip(d, number, strict=True)] == want
        assert s.recomputed < s.pairs // 20


# --- byte-level BPE ----------------------------------------------------------------


@pytest.fixture(scope="module")
def ranks():
    return bytebpe.load(vocabulary(MULTI))


@pytest.fixture(scope="module")
def library(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bytebpe.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})


def test_tree_reduction_equals_the_library(ranks, library):
    rnd = random.Random(2)
    letters = "aaabeé1.,'\n\t s t中文　\x1c\x85😀ΣΩнеה"
    texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 90))) for _ in range(4000)]
    texts += ["a" * 20_001, "ab" * 9000 + "a" * 77, " " * 9001 + "x", "".join(rnd.choices("abcdefgh", k=30_000)), "é" * 9000, "Ab" * 10, "don't we'll", " 's"]
    texts += [f"a{chr(c)}b {chr(c)}" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    for t in texts:
        assert ranks.encode(t) == library.encode_ordinary(t)
        assert ranks.decode(ranks.encode(t)) == t.encode()


def test_product_is_associative_and_independent_of_the_cut(ranks):
    rnd = random.Random(4)
    for _ in range(400):
        data = "".join(rnd.choices("theinracoé", k=rnd.randint(3, 60))).encode()
        i, j = sorted(rnd.sample(range(1, len(data)), 2))
        a, b, c = (ranks.merge(x) for x in (data[:i], data[i:j], data[j:]))
        assert ranks.join(ranks.join(a, b), c) == ranks.join(a, ranks.join(b, c)) == ranks.merge(data)
    assert ranks.grown


def test_byte_bpe_query(spark, library):
    texts = ["", None, " \t\n", "a", "Hello  WORLD\r\n\n x", "日本語 😀😀!! --", "lo" * 4000, "w " * 3000, "same", "same", "\x00nul"]
    rows = [(i if i != 4 else None, t, "clash", 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    want = []
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()))
    got = bytebpe.encode_decode(df, vocabulary(MULTI)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    kept = bytebpe.encode_decode(df, vocabulary(MULTI), keep=True).where("doc_id = 5").first()
    assert bytes(kept.decoded).decode() == texts[5] and kept.ids == library.encode_ordinary(texts[5])
    assert bytebpe.encode_decode(df.limit(0), vocabulary(MULTI)).count() == 0


# --- phrases -----------------------------------------------------------------------


def plain_phrases(rows, least, top):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in good.items():
            if any(100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in good.items() if len(q) > len(p)):
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((score, a, " ".join(p), counts[p[:k]], counts[p[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, left, right, n[lang], score) for i, (score, a, p, left, right) in enumerate(found[:top])]
    return sorted(out)


def phrase_rows(seed=6):
    rnd = random.Random(seed)
    words = ["New", "york", "CITY", "hall", "of", "the", "é", "ÀB", "x y", "a|b", "\x00", "café"]
    rows = [(rnd.choice(("en", "fr", None, "")), "".join(rnd.choice(words) + rnd.choice((" ", " ", " ", "  ", "\t", ". ", "\n", ",", "?!")) for _ in range(rnd.randint(0, 60)))) for _ in range(250)]
    rows += [("en", "one two three four five. " * 40), ("en", None), ("en", ""), ("de", "..., \n"), ("xx", "so so " * 900), (None, "New york city " * 50)]
    return [*rows, *rows[:40]]


@pytest.mark.parametrize("bits", [None, 6])
def test_phrases_equal_plain_counts(spark, bits):
    rows = phrase_rows()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, text string, phrase string, n int").repartition(5)
    for top in (2000, 7):
        got = sorted(map(tuple, phrases.collocations(df, 12, top, bits).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
        assert got == plain_phrases(rows, 12, top)
    assert phrases.collocations(df.limit(0)).count() == 0


def test_bitmaps_prune_and_small_slices_agree(spark, monkeypatch):
    rows = phrase_rows(8)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    want = sorted(map(tuple, phrases.frequent(df, 12)[0].collect()))
    for size in (1, 300):
        work = phrases._Pass(1, 8, 12, None, None)
        monkeypatch.setattr(phrases, "SLICE", size)
        parts = list(phrases._slices([r[0] for r in rows], [r[1].encode() if r[1] else None for r in rows]))
        total = Counter()
        for lang, texts in parts:
            found, _, n, _ = work.count(lang, texts)
            for p, c in zip(found, n.tolist(), strict=True):
                total[lang, p.decode()] += c
        assert sorted((lang, p, 1, c) for (lang, p), c in total.items() if c >= 12) == [w for w in want if w[2] == 1]
    # a bucket table of a task that is clipped midway keeps "least or more"
    work = phrases._Pass(1, 8, 12, None, None)
    work.room = 0
    work.count("en", [b"a b c " * 50])
    assert work.room < 1 << 30 and work.table.max() >= 12
