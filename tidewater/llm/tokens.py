"""Token counts (whole-token shortcut) and BPE encoding with decoding (speculate and verify).

Both give what the ``tokenizers`` library gives for the vocabulary file, without begin, end
or padding tokens; special strings inside a text become their ids, as is its default.

Defined results: a null or empty text has no tokens (0, and the hashes of nothing); repeated
rows each give a row; a null ``doc_id`` stays null; columns besides the two named ones are
not read, so their names cannot clash; an empty table gives an empty result. Texts are
worked on whole, one Arrow batch at a time; caches are bounded and only save time.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame

from .bpe import both_memo, count_memo
from .common import map_columns


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row.

    Pre-tokens that are proven to be one token (see ``WordBpe.whole``) count one; only the
    others are merged. ``limit`` is the length that ``over_limit`` compares with.
    """

    def count(ids: list, texts: list) -> dict[str, list]:
        memo = count_memo(vocabulary)
        chunks = [memo.bpe.chunks(t) for t in texts]
        memo.learn(chunks)
        get = memo.known.__getitem__
        n = [sum(map(get, c)) for c in chunks]
        return {"doc_id": ids, "n_bytes": [len((t or "").encode()) for t in texts], "n_tokens": n, "over_limit": [k > limit for k in n]}

    return map_columns(docs, [id_col, text_col], "doc_id long, n_bytes long, n_tokens long, over_limit boolean", count)


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row; with ``keep`` also ``ids`` and ``decoded``."""

    def code(ids: list, texts: list) -> dict[str, list]:
        memo = both_memo(vocabulary)
        chunks = [memo.bpe.chunks(t) for t in texts]
        memo.learn(chunks)
        get = memo.known.__getitem__
        out: dict[str, list] = {"doc_id": ids, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": [], "decoded": []} if keep else {})
        for c in chunks:
            both = [get(x) for x in c]
            raw, text = b"".join([x[0] for x in both]), b"".join([x[1] for x in both])[:-1]
            out["n_tokens"].append(len(raw) // 4)
            out["ids_sha256"].append(sha256(raw).hexdigest())
            out["decoded_sha256"].append(sha256(text).hexdigest())
            if keep:
                out["ids"].append(list(memoryview(raw).cast("I")))
                out["decoded"].append(text.decode())
        return out

    more = ", ids array<long>, decoded string" if keep else ""
    return map_columns(docs, [id_col, text_col], f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{more}", code)
