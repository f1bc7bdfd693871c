"""Byte-level BPE by monoid tree reduction: encode halves, join them, decode up the tree.

``Ranks`` are a vocabulary's byte strings by priority: the pair whose joined bytes have the
lowest rank is merged first, leftmost on ties; a match of the pattern that is itself in the
vocabulary is that token.

The elements of the monoid are encodings of byte strings, and its product is the encoding of
the joined bytes. It is found without encoding both anew: a window of tokens around the seam
is encoded from its bytes, and grows, doubling, on each side where its border is not proven.

Proof that a border holds. Call a pair of tokens fast if encoding their joined bytes gives
back these two. Let every token encode to itself and every adjacent pair be fast; then the
sequence is the encoding. For up to the first merge across any border, each token's bytes see
exactly the merges they see alone; the first crossing merge would be the next one, too, in the
encoding of the two tokens beside it, which merges nothing across. The converse holds by the
same argument. Inside the window pairs are fast as it was encoded exactly, left and right of it
as both sides are encodings; only the two border pairs need a test, and none if the window's
outer token came out unchanged.

Halves are split at a power of two, so runs of one letter align. Pattern matches are cut from
units, an optional blank with what follows up to white space, which no match crosses; so the
reduction goes over the halves of a match, matches of a unit, units of a text, and the two
upper levels need no seam at all.

Defined results: a null or empty text has no tokens and the hashes of nothing; repeated rows
each give a row; a null id stays null; other columns aren't read; an empty table gives no
rows; invalid bytes that ids decode to are kept as bytes. Texts are worked on whole, some
megabytes at a time; caches are bounded and only save time.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern whose matches are encoded separately.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: Unicode's white space, which differs from Python's.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SLICE = 2 << 20
#: Units, halves and pairs that a worker remembers, and the bytes of a half worth it.
UNITS, HALVES, PAIRS = 300_000, 400_000, 400_000
SHORT = 4


class Ranks:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a vocabulary must hold every single byte")
        self.units = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]").findall
        self.matches = regex.compile(pattern).findall
        self.plain = re.compile(" ?[A-Za-z]+").fullmatch
        self.own: dict[bytes, bool] = {}
        self.pairs: dict[int, list[int]] = {}
        self.halves: dict[bytes, list[int]] = {}
        #: Seams joined, and those whose window had to grow beyond one token a side.
        self.seams = self.grown = 0

    def __reduce__(self):
        raise TypeError("load the vocabulary on the executor, by its path")

    # --- exact encoding of a window ---------------------------------------------
    def merge(self, data: bytes) -> list[int]:
        """From single bytes: lowest rank first, leftmost on ties."""
        if len(data) > 48:
            return self._merge_long(data)
        get, parts = self.ranks.get, [data[i : i + 1] for i in range(len(data))]
        none = len(self.ranks)
        rank = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while rank:
            best = min(rank)
            if best == none:
                break
            i = rank.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del rank[i]
            if i < len(rank):
                rank[i] = get(parts[i] + parts[i + 1], none)
            if i:
                rank[i - 1] = get(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap over ends of parts."""
        n, get = len(data), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, middle, stop = heappop(heap)
            if end[i] != middle or end[middle] != stop:
                continue
            end[i], end[middle] = stop, -1
            if stop < n:
                before[stop] = i
                if (r := get(data[i : end[stop]])) is not None:
                    heappush(heap, (r, i, stop, end[stop]))
            if (h := before[i]) >= 0 and (r := get(data[h:stop])) is not None:
                heappush(heap, (r, h, i, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : end[i]]])
            i = end[i]
        return out

    # --- the monoid ------------------------------------------------------------
    def is_own(self, data: bytes) -> bool:
        """Whether a vocabulary string's bytes merge to it alone; tested once each."""
        if (known := self.own.get(data)) is None:
            known = self.own[data] = self.merge(data) == [self.ranks[data]]
        return known

    def pair(self, a: int, b: int) -> list[int]:
        """The encoding of two tokens' joined bytes; the pair is fast if it is these two."""
        key = a << 32 | b
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(self.token[a] + self.token[b])
        return known

    def is_fast(self, a: int, b: int) -> bool:
        return self.pair(a, b) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The product: two encodings to that of their joined bytes."""
        if not left or not right:
            return left or right
        self.seams += 1
        token, i, j = self.token, 1, 1
        window = self.pair(left[-1], right[0])
        while True:
            firm_left = i == len(left) or window[0] == left[-i] or self.is_fast(left[-i - 1], window[0])
            firm_right = j == len(right) or window[-1] == right[j - 1] or self.is_fast(window[-1], right[j])
            if firm_left and firm_right:
                return left[: len(left) - i] + window + right[j:]
            self.grown += 1
            i = i if firm_left else min(2 * i, len(left))
            j = j if firm_right else min(2 * j, len(right))
            window = self.merge(b"".join([token[t] for t in left[-i:]]) + b"".join([token[t] for t in right[:j]]))

    def reduce(self, data: bytes) -> list[int]:
        """The tree over a match's bytes; memory of short halves saves what words have in common."""
        if (known := self.halves.get(data)) is not None:
            return known
        n = len(data)
        if (i := self.ranks.get(data)) is not None and (n == 1 or self.is_own(data)):
            out = [i]
        else:
            half = 1 << (n - 1).bit_length() - 1
            out = self.join(self.reduce(data[:half]), self.reduce(data[half:]))
        if n <= SHORT:
            if len(self.halves) >= HALVES:
                self.halves.clear()
            self.halves[data] = out
        return out

    def encode_match(self, data: bytes) -> list[int]:
        found = self.ranks.get(data)
        return [found] if found is not None else self.reduce(data)

    def encode_unit(self, unit: str) -> list[int]:
        if self.plain(unit):
            return self.encode_match(unit.encode())
        return [i for m in self.matches(unit) for i in self.encode_match(m.encode())]

    def encode(self, text: str) -> list[int]:
        return [i for u in self.units(text) for i in self.encode_unit(u)]

    def decode(self, ids: list[int]) -> bytes:
        """Concatenation up the tree."""
        if len(ids) <= 64:
            return b"".join([self.token[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=4)
def load(path: str) -> Ranks:
    """One vocabulary a Python worker."""
    with open(path, "rb") as f:
        return Ranks({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def _slices(texts: list[str | None]) -> Iterator[slice]:
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > SLICE:
            yield slice(first, i + 1)
            first, size = i + 1, 0
    yield slice(first, len(texts))


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row; with ``keep`` also ``ids`` and ``decoded`` (bytes)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    more = ", ids array<long>, decoded binary" if keep else ""
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = load(vocabulary)
        known: dict[str, tuple[bytes, int, bytes]] = {}
        for batch in batches:
            for part in _slices(batch.column(1).to_pylist()) if batch.num_rows else ():
                texts = batch.column(1).slice(part.start, part.stop - part.start).to_pylist()
                n_tokens, hashes, decoded_hashes, ids, decoded = [], [], [], [], []
                for text in texts:
                    units = work.units(text or "")
                    if len(known) + len(units) > UNITS:
                        known.clear()
                    for u in units:
                        if u not in known:
                            found = work.encode_unit(u)
                            known[u] = b"".join([b"%d," % i for i in found]), len(found), work.decode(found)
                    each = [known[u] for u in units]
                    listed, back = b"".join([e[0] for e in each])[:-1], b"".join([e[2] for e in each])
                    n_tokens.append(sum([e[1] for e in each]))
                    hashes.append(sha256(listed).hexdigest())
                    decoded_hashes.append(sha256(back).hexdigest())
                    if keep:
                        ids.append([int(i) for i in listed.split(b",") if i])
                        decoded.append(back)
                columns = [batch.column(0).slice(part.start, part.stop - part.start), pa.array(n_tokens, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded_hashes, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep:
                    columns += [pa.array(ids, pa.list_(pa.int64())), pa.array(decoded, pa.binary())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema)
