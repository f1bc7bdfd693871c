"""Vector bin packing of token sequences under several limits at once.

A bin has a capacity of tokens, of segments and of loss-bearing tokens. A bin is filled one
example at a time: of those that fit, the one whose demand has the largest dot product with
what is left in the bin (both as shares of the capacity). With ``cut`` an example may be cut
to fill the rest of a bin exactly; without it examples stay whole (instruction data).

Packing is local to a partition and reads it once: no shuffle, and a pool of bounded size.
Sequence ids carry the partition's number, so a task that runs again gives the same ids.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions


class Packer:
    """Streams examples ``(key, tokens, loss)`` into closed bins.

    ``take(bin number, [(key, start, length)...])`` is called for each closed bin. Loss-bearing
    tokens are spread evenly over an example when it is cut (rounded up).
    """

    def __init__(self, take, tokens: int, segments: int, loss: int, cut: bool, pool_tokens: int):
        self.take, self.cut, self.pool_tokens = take, cut, pool_tokens
        self.capacity = np.array([tokens, segments, loss], dtype=np.float64)
        self.keys: list = []
        self.starts: list[int] = []
        self.need = np.zeros((3, 0))
        self.free = np.zeros(0, dtype=bool)
        self.held = 0
        self.bins = 0

    def close(self, pieces: list[tuple]) -> None:
        self.take(self.bins, pieces)
        self.bins += 1

    def add(self, examples: list[tuple]) -> None:
        size, fresh = int(self.capacity[0]), []
        for key, tokens, loss in examples:
            start = 0
            share = loss / tokens if tokens else 0
            # a piece that fills a bin by itself; the loss limit may allow only less
            most = min(size, max(1, int(self.capacity[2] / share + 1e-6))) if share else size
            while tokens - start > most or (tokens - start == size and most == size):
                if not self.cut and tokens > most:
                    raise ValueError(f"an example of {tokens} tokens, {loss} with loss, exceeds a bin")
                self.close([(key, start, most)])
                start += most
                if start == tokens:
                    break
            if start < tokens:
                fresh.append((key, start, tokens - start, np.ceil(share * (tokens - start) - 1e-9)))
        if fresh:
            keep = np.flatnonzero(self.free)
            self.keys = [self.keys[i] for i in keep] + [x[0] for x in fresh]
            self.starts = [self.starts[i] for i in keep] + [x[1] for x in fresh]
            self.need = np.hstack([self.need[:, keep], np.array([[x[2], 1, x[3]] for x in fresh], dtype=np.float64).T])
            self.free = np.ones(len(self.keys), dtype=bool)
            self.held = int(self.need[0].sum())
        while self.held > self.pool_tokens:
            self._fill(final=False)

    def _fill(self, final: bool) -> None:
        rest = self.capacity.copy()
        pieces = []
        fits = np.flatnonzero(self.free)
        t, k = self.need[0, fits], self.need[2, fits]
        while len(fits):
            w = rest / self.capacity**2
            at = int((t * w[0] + k * w[2]).argmax())  # every example is one segment
            i = int(fits[at])
            self.free[i] = False
            rest -= self.need[:, i]
            pieces.append((self.keys[i], self.starts[i], int(t[at])))
            t[at] = np.inf
            maybe = (t <= rest[0]) & (k <= rest[2]) & (rest[1] >= 1)
            fits, t, k = fits[maybe], t[maybe], k[maybe]
        self.held -= int(self.capacity[0] - rest[0])
        if self.cut and rest[0] >= 1 and rest[1] >= 1 and self.free.any():
            # cut from the longest example what fills the bin, within its loss limit
            i = int(np.where(self.free, self.need[0], -1).argmax())
            size, share = self.need[0, i], self.need[2, i] / self.need[0, i]
            n = int(min(rest[0], rest[2] // share if share else rest[0], size - 1))
            if n >= 1:
                pieces.append((self.keys[i], self.starts[i], n))
                rest[0] -= n
                self.held -= n
                self.starts[i] += n
                self.need[:, i] = [size - n, 1, np.ceil(share * (size - n) - 1e-9)]
        if self.cut and rest[0] and (final or rest[1] < 1):
            self._powers(pieces)
        else:
            self.close(pieces)

    def _powers(self, pieces: list[tuple]) -> None:
        """Cut an unfilled bin into sequences whose lengths are powers of two: no padding."""
        left = sum(p[2] for p in pieces)
        now: list[tuple] = []
        room = 1 << (left.bit_length() - 1)
        for key, start, n in pieces:
            while n:
                k = min(n, room)
                now.append((key, start, k))
                start, n, room, left = start + k, n - k, room - k, left - k
                if not room:
                    self.close(now)
                    now, room = [], 1 << (left.bit_length() - 1) if left else 0

    def finish(self) -> None:
        while self.free.any():
            self._fill(final=True)


@lru_cache(maxsize=2)
def _chunk_ids(path: str):
    """Ids by chunk; the library's own model encodes each distinct pre-token."""
    from tokenizers import Tokenizer

    from .bpe import Memo, load

    tok = Tokenizer.from_file(path)

    bpe, tokenize = load(path), tok.model.tokenize

    def encode(words: list[str]) -> dict[str, bytes]:
        return {w: array("I", [t.id for t in tokenize(bpe.mapped(w))]).tobytes() for w in words}

    return Memo(bpe, encode, lambda parts: b"".join([p if type(p) is bytes else array("I", p).tobytes() for p in parts]))


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, tokens: int = 4096, segments: int = 1024, loss: int | None = None, pool_tokens: int = 1 << 19) -> DataFrame:
    """Pack every text, cut freely, into sequences of at most ``tokens`` ids.

    A document is its ids followed by ``end_id``; all of its ids bear loss (``loss``: limit a
    sequence, ``tokens`` unless given). Returns a row a piece: ``doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset``.

    Defined results: a null or empty text is the single id ``end_id``; repeated rows are
    packed each; a null ``doc_id`` stays null; an empty table gives no rows; a sequence that
    would need padding is only the last of a partition, or one whose segments ran out, and is cut
    into powers of two. Plain documents bear loss in every id, so unless ``loss`` is given its
    limit is that of the tokens; ``pack_examples`` packs instruction data under all three limits.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    limit = tokens if loss is None else loss

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memo = _chunk_ids(vocabulary)
        base = TaskContext.get().partitionId() << 36
        end = np.array([end_id], dtype="<u4").tobytes()
        rows: list[list] = [[] for _ in names]
        held: dict[int, list] = {}  # number of a document -> its id, ids, ids not yet placed

        def take(number: int, pieces: list[tuple]) -> None:
            at = 0
            for key, start, n in pieces:
                doc = held[key]
                for column, x in zip(rows, (doc[0], start, n, crc32(doc[1][4 * start : 4 * (start + n)]), len(doc[1]) // 4, base + number, at), strict=True):
                    column.append(x)
                at += n
                doc[2] -= n
                if not doc[2]:
                    del held[key]

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in rows], names=names)
            for c in rows:
                c.clear()
            return out

        packer = Packer(take, tokens, segments, limit, True, pool_tokens)
        count = 0
        for ids, texts in portions(batches):
            chunks = [memo.bpe.chunks(t) for t in texts]
            memo.learn(chunks)
            get = memo.known.__getitem__
            fresh = []
            for i, c in zip(ids, chunks, strict=True):
                raw = b"".join(map(get, c)) + end
                held[count] = [i, raw, len(raw) // 4]
                fresh.append((count, len(raw) // 4, len(raw) // 4))
                count += 1
            packer.add(fresh)
            if rows[0]:
                yield flush()
        packer.finish()
        if rows[0]:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack_examples(examples: DataFrame, tokens: int = 4096, segments: int = 64, loss: int = 2048, pool_tokens: int = 1 << 19) -> DataFrame:
    """Pack whole examples ``(example_id, n_tokens, n_loss)`` under all three limits, none cut.

    Returns ``example_id, sequence_id, offset``. Nulls count as 0; an example that exceeds a
    bin by itself gets a sequence of its own, marked by ``oversize``; none is dropped. Repeated
    rows are packed each, an empty table gives no rows.
    """
    schema = "example_id long, sequence_id long, offset long, oversize boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []

        def take(number: int, pieces: list[tuple], over: bool = False) -> None:
            at = 0
            for key, _, n in pieces:
                rows.append((key[0], base + number, at, over))
                at += n

        packer = Packer(take, tokens, segments, loss, False, pool_tokens)

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist([dict(zip(("example_id", "sequence_id", "offset", "oversize"), r, strict=True)) for r in rows], schema=pa.schema([("example_id", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("oversize", pa.bool_())]))
            rows.clear()
            return out

        seen = 0
        for batch in batches:
            fresh = []
            for i, n, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen += 1
                if n > tokens or k > loss or n == 0:
                    take(packer.bins, [((i, seen), 0, n)], n > 0)
                    packer.bins += 1
                else:
                    fresh.append(((i, seen), n, k))
            packer.add(fresh)
            if rows:
                yield flush()
        packer.finish()
        if rows:
            yield flush()

    wanted = examples.select(F.col("example_id").cast("long"), *[F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit(0)).alias(c) for c in ("n_tokens", "n_loss")])
    return wanted.mapInArrow(run, schema)


def conversation_examples(conversations: DataFrame, vocabulary: str) -> DataFrame:
    """Instruction data: an example a conversation, in ids of the tokenizer; ``example_id, n_tokens, n_loss``.

    Each turn is its text's ids and one that ends it; those of the assistant's turns bear loss.
    Nulls: a null text has no ids but its end, a null role bears no loss; rows without a
    ``conv_id`` are in no conversation; repeated rows count each; other columns are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bpe import count_memo

        memo = count_memo(vocabulary)
        for batch in batches:
            n: list[int] = []
            for lo in range(0, batch.num_rows, 512):  # pre-tokens of few turns at once
                chunks = [memo.bpe.chunks(t) for t in batch.column(2).slice(lo, 512).to_pylist()]
                memo.learn(chunks)
                get = memo.known.__getitem__
                n += [sum(map(get, c)) + 1 for c in chunks]
            loss = [k if role == "assistant" else 0 for k, role in zip(n, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, type=pa.int64()), pa.array(loss, type=pa.int64())], names=["example_id", "n", "loss"])

    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("example_id"), "role", "text")
    return turns.mapInArrow(count, "example_id long, n long, loss long").groupBy("example_id").agg(F.sum("n").alias("n_tokens"), F.sum("loss").alias("n_loss"))
