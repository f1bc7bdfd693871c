"""SimHash near-duplicates by Golay-code fuzzy hashing.

The perfect binary Golay code (23, 12) puts every 23-bit word within 3 bits of exactly one
codeword. A word at distance 3 also gets the five codewords at distance 4, so it has one or
six keys, and any two words that differ in at most 2 bits share one: the word between them
(or either of them) decodes to a codeword within 4 bits of both.

``exact`` (a 64-bit fingerprint, up to 3 differing bits): of four 16-bit blocks one is free
of errors. Of the two 24-bit halves of the rest either both have at most two errors, so that
their codeword indices meet, or one has none. Block plus both indices, or block plus one whole
half, make a 40-bit key: 12 families, at most 152 keys, no link lost, and two fingerprints
drawn at random meet about three times in a thousand million.

``wide`` (similar shingle sets): four 23-bit segments of a fingerprint over a text's distinct
words, taken in pairs; two codeword indices make a key. With at most 5 differing bits of 92 some
pair has at most 2, so a key is shared; beyond that many pairs still meet. Sixteen further keys
of four minima of the shingle set each catch what these lose: at a similarity of 0.8 all of them
differ for 2 pairs in 10,000. A second fingerprint over the shingle set only rules out far pairs;
the exact Jaccard similarity of the sets decides.

Rows that share a key are joined by one shuffle and verified bit by bit. A bucket gives only
the links of a spanning forest from its first row, never all its pairs; large buckets are split
into blocks of bounded size, and each pair of blocks is a group of its own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import cut, map_columns, unboxed
from .components import components

#: Fixed value: generator polynomial of the (23, 12) Golay code.
GENERATOR = 0b101011100011
#: Buckets over this size are dealt out as pairs of blocks.
BLOCK = 4096
#: Texts and shingles in a block of a large cluster, whose pairs of blocks are compared exactly.
CLUSTER_ROWS, CLUSTER_SHINGLES = 512, 1_000_000
#: Up to this many ids are broadcast to find the texts of clusters (8 MB); beyond, texts are shuffled.
BROADCAST_IDS = 1_000_000
#: Parts over which rows of one component are spread when they are joined with what is known of it.
SALTS = 16
#: Keys from minima of shingle sets, and minima in a key.
BANDS, MINIMA = 16, 4


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator."""
    r = words.astype(np.int64)
    for bit in range(22, 10, -1):
        r = np.where(r >> bit & 1, r ^ (GENERATOR << (bit - 11)), r)
    return r


@lru_cache(maxsize=1)
def near_table() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: one or six error patterns that lead to the nearby codewords, and how many."""
    patterns = np.array([sum(1 << b for b in bits) for k in range(5) for bits in itertools.combinations(range(23), k)])
    table, count = np.zeros((2048, 6), dtype=np.int64), np.zeros(2048, dtype=np.int64)
    for p, s in zip(patterns.tolist(), syndrome(patterns).tolist(), strict=True):
        table[s, count[s]] = p
        count[s] += 1
    return table, count


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """12-bit indices of each word's nearby codewords, n x 6, and how many of the six count."""
    table, count = near_table()
    s = syndrome(words)
    return (words.astype(np.int64)[:, None] ^ table[s]) >> 11, count[s]


def exact_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of 64-bit fingerprints, and the row each belongs to."""
    keys, rows, every = [], [], np.arange(len(fp))
    blocks = [(fp >> np.uint64(16 * i) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]
    for i in range(4):
        rest = np.zeros(len(fp), dtype=np.int64)
        for j in range(4):
            if j != i:
                rest = rest << 16 | blocks[j]
        low, high = rest & 0xFFFFFF, rest >> 24
        for family, half in ((1, low), (2, high)):
            keys.append((3 * i + family) << 40 | blocks[i] << 24 | half)
            rows.append(every)
        # the lowest bit of a half is left out: it can't part what the other 23 bring together
        (a, na), (b, nb) = codewords(low >> 1), codewords(high >> 1)
        at, x, y = np.nonzero((np.arange(6) < na[:, None])[:, :, None] & (np.arange(6) < nb[:, None])[:, None, :])
        keys.append((3 * i) << 40 | blocks[i][at] << 24 | a[at, x] << 12 | b[at, y])
        rows.append(at)
    return np.concatenate(keys), np.concatenate(rows)


def wide_keys(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of rows of four 23-bit segments, and the row each belongs to."""
    keys, rows = [], []
    for pair in range(2):
        a, na = codewords(segments[:, 2 * pair])
        b, nb = codewords(segments[:, 2 * pair + 1])
        at, i, j = np.nonzero((np.arange(6) < na[:, None])[:, :, None] & (np.arange(6) < nb[:, None])[:, None, :])
        keys.append(pair << 24 | a[at, i] << 12 | b[at, j])
        rows.append(at)
    return np.concatenate(keys), np.concatenate(rows)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], width: int) -> list[bytes]:
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(width)), strict=False)]


def majority(digests: list[bytes]) -> np.ndarray:
    """Bytes whose bits are set in over half of the digests."""
    width = len(digests[0])
    total = np.zeros(8 * width, dtype=np.int64)
    for lo in range(0, len(digests), 1 << 16):
        part = np.frombuffer(b"".join(digests[lo : lo + (1 << 16)]), dtype=np.uint8).reshape(-1, width)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(digests))


def fingerprint(text: str | None, width: int, seed: int = 42) -> int:
    """64 bits, as a signed long; zero without words."""
    found = shingles(words_of(text), width)
    if not found:
        return 0
    return int.from_bytes(majority([xxhash.xxh64_digest(s, seed) for s in found]).tobytes(), "big", signed=True)


def shingle_digests(words: list[bytes], width: int) -> list[bytes]:
    return [xxhash.xxh3_128_digest(s, 3) for s in {*shingles(words, width)}]


def as_set(digests: list[bytes]) -> np.ndarray:
    """Sorted 64-bit hashes, the first halves of the digests."""
    return np.unique(np.frombuffer(b"".join(digests), dtype=np.uint64)[::2])


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    return as_set(shingle_digests(words_of(text), width))


def set_digest(own: np.ndarray) -> tuple[int, int]:
    """128 bits that name a shingle set, as two signed longs."""
    raw = xxhash.xxh3_128_digest(own.tobytes())
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


@lru_cache(maxsize=1)
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(42)
    k = BANDS * MINIMA
    return rng.integers(0, 1 << 63, k, dtype=np.uint64) << np.uint64(1) | np.uint64(1), rng.integers(0, 1 << 63, k, dtype=np.uint64)


def band_keys(own: np.ndarray) -> list[int]:
    """Keys above all of ``wide_keys``; two sets share each with probability J to the power of MINIMA."""
    if not len(own):
        return [1 << 62] * BANDS
    mul, add = _multipliers()
    least = np.min([(own[lo : lo + 4096, None] * mul + add).min(axis=0) for lo in range(0, len(own), 4096)], axis=0)
    return [xxhash.xxh3_64_intdigest(row.tobytes(), i) >> 2 | 1 << 62 for i, row in enumerate(least.reshape(BANDS, MINIMA))]


def _wide(text: str | None, width: int) -> tuple[list[int], list[int], int, int, int, int, int]:
    """Segments, band keys, fingerprint, digest and size of the shingle set."""
    words = words_of(text)
    digests = shingle_digests(words, width)
    own = as_set(digests)
    h, g = set_digest(own)
    if not words:
        return [0] * 4, band_keys(own), 0, 0, h, g, 0
    bits = np.unpackbits(majority([xxhash.xxh3_128_digest(w, 1) for w in {*words}]))
    segments = bits[:92].reshape(4, 23).astype(np.int64) @ (1 << np.arange(23))
    raw = majority(digests).tobytes()
    return segments.tolist(), band_keys(own), int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True), h, g, len(own)


def _forest(a: np.ndarray, b: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """Spanning forest of the rows that differ in at most ``reach`` bits, breadth first."""
    rest, out, queue = np.arange(len(a)), [], []
    while len(rest):
        if queue:
            i = queue.pop()
        else:
            i, rest = int(rest[0]), rest[1:]
        near = np.bitwise_count(a[rest] ^ a[i]) + np.bitwise_count(b[rest] ^ b[i]) <= reach
        found = rest[near].tolist()
        out += [(i, j) for j in found]
        queue += found
        rest = rest[~near]
    return out


def _run_links(route: np.ndarray, a: np.ndarray, b: np.ndarray, reach: int, small: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs to link within runs of equal routes."""
    starts = np.flatnonzero(np.r_[True, route[1:] != route[:-1]])
    size = np.diff(np.r_[starts, len(route)])
    near = lambda i, j: np.bitwise_count(a[i] ^ a[j]) + np.bitwise_count(b[i] ^ b[j]) <= reach
    left, right = [], []
    of, first = np.repeat(size, size), np.repeat(starts, size)
    light = np.flatnonzero((of > 1) & (of <= small))
    # to the first of the run where that is near; others meet pair by pair
    linked = np.zeros(len(route), dtype=bool)
    linked[light] = near(light, first[light])
    spokes = light[linked[light] & (light != first[light])]
    left.append(first[spokes])
    right.append(spokes)
    for d in range(1, small):
        i = light[light + d < len(route)]
        i = i[(route[i] == route[i + d]) & ~(linked[i] & linked[i + d])]
        i = i[near(i, i + d)]
        left.append(i)
        right.append(i + d)
    for s, n in zip(starts[size > small].tolist(), size[size > small].tolist(), strict=True):
        if pairs := _forest(a[s : s + n], b[s : s + n], reach):
            p = np.array(pairs) + s
            left.append(p[:, 0])
            right.append(p[:, 1])
    return np.concatenate(left), np.concatenate(right)


def _routed_links(routed: DataFrame, reach: int, most: int | None) -> DataFrame:
    """Links ``ua, ub, va, vb`` of rows ``route, a, b`` that share a route; a route of over ``most`` rows only names itself as ``big``."""
    schema = pa.schema([(c, pa.int64()) for c in ("ua", "ub", "va", "vb", "big")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held, over = [], 0, None  # parts of the last run, their rows, and a run that is too long
        none = np.zeros(0, dtype=np.int64)

        def links(cols: list[np.ndarray]) -> pa.RecordBatch:
            # unsigned: NumPy counts the bits of a signed number's absolute value
            i, j = _run_links(cols[0], cols[1].view(np.uint64), cols[2].view(np.uint64), reach)
            return pa.RecordBatch.from_arrays([*(pa.array(x) for x in (cols[1][i], cols[2][i], cols[1][j], cols[2][j])), pa.nulls(len(i), pa.int64())], schema=schema)

        def name(route: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 4, pa.array([route])], schema=schema)

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if over is not None:
                go = int(np.searchsorted(cols[0], over, side="right"))
                cols = [c[go:] for c in cols]
            if not len(cols[0]):
                continue
            over = None
            if kept and cols[0][-1] == cols[0][0] == kept[0][0][0]:
                kept.append(cols)
                held += len(cols[0])
            else:
                cols = [np.concatenate([*(k[c] for k in kept), cols[c]]) for c in range(3)]
                # the last run may go on in the next batch
                at = int(np.searchsorted(cols[0], cols[0][-1]))
                if most is not None:
                    starts = np.flatnonzero(np.r_[True, cols[0][1:at] != cols[0][: max(at - 1, 0)]]) if at else none
                    long = np.diff(np.r_[starts, at]) > most
                    for s in starts[long].tolist():
                        yield name(int(cols[0][s]))
                    if long.any():
                        fine = np.repeat(~long, np.diff(np.r_[starts, at]))
                        if fine.any():
                            yield links([c[:at][fine] for c in cols])
                    elif at:
                        yield links([c[:at] for c in cols])
                elif at:
                    yield links([c[:at] for c in cols])
                kept, held = [[c[at:] for c in cols]], len(cols[0]) - at
            if most is not None and held > most:
                over = int(kept[0][0][0])
                yield name(over)
                kept, held = [], 0
        if held:
            yield links([np.concatenate([k[c] for k in kept]) for c in range(3)])

    return routed.repartition("route").sortWithinPartitions("route", "a", "b").mapInArrow(run, "ua long, ub long, va long, vb long, big long")


def link(keys: DataFrame, reach: int) -> DataFrame:
    """Links ``u, v`` (structs of a, b) between rows ``key, a, b`` that share a key and differ in few bits."""
    found = cut(_routed_links(keys.select(F.col("key").alias("route"), "a", "b"), reach, BLOCK))
    big = found.where("big is not null").select(F.col("big").alias("key"))
    if not big.isEmpty():
        rows = keys.join(big, "key", "left_semi")
        sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / (BLOCK // 2)).alias("blocks"))
        # each block of a large bucket meets every block, itself included, in a group of its own
        dealt = rows.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("a", "b"), F.col("blocks")))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        route = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        found = found.unionByName(_routed_links(dealt.select(route.alias("route"), "a", "b"), reach, None))
    links = found.where("big is null")
    return links.select(F.struct(F.col("ua").alias("a"), F.col("ub").alias("b")).alias("u"), F.struct(F.col("va").alias("a"), F.col("vb").alias("b")).alias("v")).distinct()


def _of_root(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Inner join of ``rows`` with one row a ``root``; rows of a large component are spread."""
    salted = known.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_s", F.pmod(F.xxhash64("a", "b"), F.lit(SALTS)).cast("int")).join(salted, ["root", "_s"]).drop("_s")


def _classes(prints: DataFrame, roots: DataFrame, id_col: str) -> DataFrame:
    """``a, b, component_id``: the smallest id of each distinct fingerprint's component, by its ``id, root``."""
    nodes = prints.groupBy("a", "b").agg(F.min(id_col).alias("least"))
    roots = roots.select(F.col("id.a").alias("a"), F.col("id.b").alias("b"), "root")
    of = cut(nodes.join(roots, ["a", "b"], "left").withColumn("root", F.coalesce("root", F.struct("a", "b"))))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return _of_root(of, least).select("a", "b", "component_id")


def fingerprint_components(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id``: fingerprints that differ in at most 3 bits are linked.

    Defined results: null, empty and blank texts have fingerprint zero and are linked like any
    other; repeated rows give a row each; a null id stays null and names a component only if
    all its ids are null; an empty table gives an empty result. Only the two named columns are
    read. Exact: no link within 3 bits is lost.
    """

    def prints(ids: list, texts: list) -> dict[str, list]:
        return {id_col: ids, "a": [fingerprint(t, width, seed) for t in texts]}

    found = cut(map_columns(docs, [id_col, text_col], f"{id_col} long, a long", prints).withColumn("b", F.lit(0).cast("long")))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(fp), 1024):
                part = fp[lo : lo + 1024]
                key, row = exact_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row]), pa.array(np.zeros(len(row), dtype=np.int64))], names=["key", "a", "b"])

    keys = found.select("a").distinct().mapInArrow(keyed, "key long, a long, b long")
    classes = _classes(found, components(link(keys, 3)), id_col)
    return found.join(classes, ["a", "b"]).select(id_col, F.lpad(F.lower(F.hex("a")), 16, "0").alias("fingerprint"), "component_id")


def exact_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links of the sets to the first of their component, where Jaccard similarity reaches the threshold."""
    size = np.array([len(x) for x in sets])
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holder = np.repeat(np.arange(len(sets)), size)[np.argsort(token, kind="stable")]
    first, at = np.cumsum(df) - df, np.cumsum(size) - size
    open_, out, queue, rest, root = np.ones(len(sets), dtype=bool), [], [], 0, 0
    while rest < len(sets):
        if queue:
            i = queue.pop()
        elif open_[rest]:
            i = root = rest
            open_[i] = False
        else:
            rest += 1
            continue
        own = token[at[i] : at[i] + size[i]]
        own = own[df[own] > 1]
        n = df[own]
        listed = np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(holder[listed], minlength=len(sets))
        found = np.flatnonzero(open_ & (shared / np.maximum(size + size[i] - shared, 1) >= similarity)).tolist()
        open_[found] = False
        out += [(root, j) for j in found]
        queue += found
    return out


def _sets(placed: DataFrame, docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``placed`` (with ``a, b, least``) and the shingle set of each, from texts read again by id, one of each set."""
    texts = docs.select(F.col(f"`{id_col}`").alias("least"), F.col(f"`{text_col}`").alias("text"))
    ids = placed.select("least").distinct()
    if ids.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(ids), "least", "left_semi")
    joined = placed.join(texts, "least")
    names = [c for c in joined.columns if c != "text"]
    a, b, text = names.index("a"), names.index("b"), joined.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(t, width) for t in batch.column(text).to_pylist()]
            # an id may stand for several texts
            fits = pa.array([set_digest(x) == (p, q) for x, p, q in zip(own, batch.column(a).to_pylist(), batch.column(b).to_pylist(), strict=True)])
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names] + [pa.array([x.view(np.int64) for x in own], type=pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "shingles"]).filter(fits)

    schema = StructType([*(joined.schema[c] for c in names), StructField("shingles", ArrayType(LongType()))])
    return joined.mapInArrow(run, schema)


def _exact_links(dealt: DataFrame, similarity: float) -> DataFrame:
    """``u, v``: links of sets ``route, turn, a, b, shingles`` to the first by ``turn`` of their component within their group."""
    schema = pa.schema([(c, pa.int64()) for c in ("ua", "ub", "va", "vb")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        route, sets = None, {}

        def links() -> pa.RecordBatch:
            names = list(sets)
            found = [names[i] + names[j] for i, j in exact_forest(list(sets.values()), similarity)]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], f.type) for k, f in enumerate(schema)], schema=schema)

        for batch in batches:
            r, a, b = (batch.column(i).to_pylist() for i in range(3))
            lists = batch.column(3)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
            for i in range(len(r)):
                if r[i] != route:
                    if len(sets) > 1:
                        yield links()
                    route, sets = r[i], {}
                if (a[i], b[i]) not in sets:
                    sets[a[i], b[i]] = flat[at[i] : at[i + 1]].copy()
        if len(sets) > 1:
            yield links()

    sorted_ = dealt.select("route", "turn", "a", "b", "shingles").repartition("route").sortWithinPartitions("route", "turn", "a", "b")
    found = sorted_.select("route", "a", "b", "shingles").mapInArrow(run, "ua long, ub long, va long, vb long")
    u, v = (F.struct(F.col(f"{x}a").alias("a"), F.col(f"{x}b").alias("b")).alias(x) for x in "uv")
    return found.select(u, v).where("u <> v").distinct()


def _exact_roots(clusters: DataFrame, docs: DataFrame, width: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """``id, root`` (structs of a, b) of the sets ``root, a, b, n, least`` of a cluster that are similar enough.

    A large cluster is dealt out as blocks, each with the cluster's first set. Sets that reach the
    first set within their block, over any number of links, are one component. The others meet the
    whole cluster, a pair of blocks a group, so only they cost more than one comparison with a
    block; no pair of different components is left out.
    """
    sizes = clusters.groupBy("root").agg(F.count("*").alias("rows"), F.sum("n").alias("all"), F.min(F.struct("a", "b")).alias("pivot")).where("rows > 1")
    blocks = F.greatest(F.ceil(F.greatest(F.col("rows") / CLUSTER_ROWS, F.col("all") / CLUSTER_SHINGLES)), F.lit(1)).cast("long")
    placed = _of_root(clusters, sizes.select("root", "pivot", blocks.alias("blocks")))
    placed = cut(placed.select("root", "a", "b", "n", "least", "blocks", F.pmod(F.xxhash64("a", "b"), F.col("blocks")).alias("own"), (F.struct("a", "b") == F.col("pivot")).alias("first")))
    sets = cut(_sets(placed, docs, width, id_col, text_col))
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    one = sets.withColumn("at", F.explode(F.when(F.col("first"), every(F.col("blocks"))).otherwise(F.array("own"))))
    # a block starts from the cluster's first set, so that its component is named by it
    known = cut(_exact_links(one.withColumn("route", F.xxhash64("root", "at")).withColumn("turn", F.when(F.col("first"), 0).otherwise(1)), similarity).select(F.col("v").alias("id"), F.col("u").alias("root")))
    large = sets.where("blocks > 1")
    of = known.select(F.col("id.a").alias("a"), F.col("id.b").alias("b"), F.col("root").alias("part"))
    main = sets.where("blocks > 1 and first").select("root", F.struct("a", "b").alias("main"))
    rest = large.join(of, ["a", "b"], "left").withColumn("part", F.coalesce("part", F.struct("a", "b")))
    rest = cut(_of_root(rest, main).where("part <> main").select("root", "a", "b", "n", "own", "blocks", "shingles"))
    if rest.isEmpty():
        return known
    # sets outside the main component meet all blocks of their cluster
    few = rest.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / CLUSTER_ROWS, F.sum("n") / CLUSTER_SHINGLES)).cast("long").alias("few"))
    route, turn = F.xxhash64("root", "x", "y").alias("route"), F.lit(0).alias("turn")
    outside = _of_root(rest, few).withColumn("x", F.pmod(F.xxhash64("b", "a"), F.col("few"))).withColumn("y", F.explode(every(F.col("blocks")))).select(route, turn, "a", "b", "shingles")
    inside = _of_root(large, few).withColumn("y", F.col("own")).withColumn("x", F.explode(every(F.col("few")))).select(route, turn, "a", "b", "shingles")
    more = _exact_links(outside.unionByName(inside), similarity)
    for end in "uv":
        names = known.select(F.col("id").alias(end), F.col("root").alias("_r"))
        more = more.join(names, end, "left").withColumn(end, F.coalesce("_r", end)).drop("_r")
    joined = components(more.where("u <> v")).select(F.col("id").alias("_id"), F.col("root").alias("_root"))
    moved = known.join(joined, F.col("root") == F.col("_id"), "left").select("id", F.coalesce("_root", "root").alias("root"))
    # parts that moved have no row of their own among those known
    return moved.unionByName(joined.join(known.select(F.col("id").alias("_id")), "_id", "left_anti").select(F.col("_id").alias("id"), F.col("_root").alias("root")))


def similar_components(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, t, component_id``: texts whose shingle sets have this Jaccard similarity or more are linked; ``t`` is a hash of the text.

    SimHash estimates the angle of two shingle sets, which fixes their similarity J by
    cos = 2 J / (1 + J). Rows that share a key (Golay keys of the word fingerprint, or minima of
    the shingle set) and whose 128-bit shingle fingerprints differ by at most the bits that the
    threshold predicts, plus five standard deviations, form clusters; within a cluster the
    exact similarity of all pairs decides. No pair below the threshold is linked.
    """
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    reach = int(128 * p + 5 * np.sqrt(128 * p * (1 - p)))

    def prints(ids: list, texts: list, hashes: list) -> dict[str, list]:
        columns = zip(*(_wide(t, width) for t in texts), strict=True)
        return {id_col: ids, "t": hashes, **{k: list(c) for k, c in zip(("segments", "bands", "a", "b", "h", "g", "n"), columns, strict=True)}}

    named = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("text"), F.xxhash64(f"`{text_col}`").alias("t"))
    found = cut(map_columns(named, [id_col, "text", "t"], f"{id_col} long, t long, segments array<int>, bands array<long>, a long, b long, h long, g long, n long", prints))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segments = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
            bands = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            for lo in range(0, len(a), 1024):
                key, row = wide_keys(segments[lo : lo + 1024])
                part = bands[lo : lo + 1024]
                key, row = np.concatenate([key, part.ravel()]), np.concatenate([row, np.repeat(np.arange(len(part)), BANDS)])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(a[lo + row]), pa.array(b[lo + row])], names=["key", "a", "b"])

    keys = found.select("segments", "bands", "a", "b").distinct().mapInArrow(keyed, "key long, a long, b long")
    roots = components(link(keys, reach)).select(F.col("id.a").alias("a"), F.col("id.b").alias("b"), "root")
    sets = found.groupBy("a", "b", "h", "g").agg(F.min("n").alias("n"), F.min(id_col).alias("least"))
    clusters = cut(sets.join(roots, ["a", "b"], "left").select(F.coalesce("root", F.struct("a", "b")).alias("root"), F.col("h").alias("a"), F.col("g").alias("b"), "n", "least"))
    named = found.select(F.col(id_col), F.col("h").alias("a"), F.col("g").alias("b"))
    classes = _classes(named, _exact_roots(clusters, docs, width, similarity, id_col, text_col), id_col)
    return found.join(classes.select(F.col("a").alias("h"), F.col("b").alias("g"), "component_id"), ["h", "g"]).select(id_col, "t", "component_id")


def keep_first(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, one of each group of near-duplicates: that with the smallest ``doc_id``.

    Defined results: of rows with the same smallest id and text the first by its values as JSON
    stays; a row whose id is also that of another text is judged by its own text; rows without
    an id stay, one of each text; all columns stay as they are, whatever their names.
    """
    groups = cut(similar_components(docs.where("doc_id is not null"), width, similarity))
    first = groups.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id", "t").agg(F.count("*").alias("rows"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    boxes = docs.select(row.alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_t"))
    keys = first.select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), "rows")
    kept = boxes.join(keys.where("rows = 1"), ["_id", "_t"], "left_semi").select("_row")
    again = keys.where("rows > 1")
    if not again.isEmpty():
        kept = kept.unionByName(_one_each(boxes.join(again, ["_id", "_t"], "left_semi"), ["_id", "_t"]))
    unnamed = boxes.where("_id is null")
    if not unnamed.isEmpty():
        kept = kept.unionByName(_one_each(unnamed, ["_t"]))
    return unboxed(kept, docs.columns)


def _one_each(boxes: DataFrame, by: list[str]) -> DataFrame:
    return boxes.groupBy(*by).agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row")
