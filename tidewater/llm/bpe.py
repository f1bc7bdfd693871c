"""Exact byte-level BPE with word ends, kept as arrays so that checks can be vectorised.

A vocabulary is read from a ``tokenizers`` JSON file of this kind: NFC, white space
collapsed, lower case; pre-tokens by one regular expression; bytes mapped to printable
characters; BPE merges with the end-of-word suffix ``</w>``; special strings found in the
raw text. Other kinds of file are refused.

Three ways to encode one pre-token live here:

* ``merge``: the textbook procedure (lowest rank first, leftmost on ties);
* ``whole``: the set of pre-tokens that are proven to encode as a single token;
* ``speculate``: greedy longest match, then a vectorised test of every adjacent pair.
  A sequence of self-encoding tokens is the BPE encoding exactly if each adjacent pair
  encodes to itself, as a merge across a border would also happen in the pair alone.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import regex

END = "</w>"
#: Fixed value: the pre-token pattern of the supported vocabulary files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NEVER = np.iinfo(np.int64).max


def byte_alphabet() -> list[str]:
    """Printable stand-ins for the 256 bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str, cache: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or spec.get("decoder") is not None:
            raise ValueError(f"{path} is not a word-end BPE vocabulary")
        self.cache = cache
        self.vocab: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.words = regex.compile(PATTERN).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.alphabet = byte_alphabet()
        size = max(self.token) + 1
        self.size = size
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([self.vocab[b] for _, b in merges], dtype=np.int64)
        made = np.array([self.vocab[a + b] for a, b in merges], dtype=np.int64)
        self.rank = {(a, b): (k, c) for k, (a, b, c) in enumerate(zip(left.tolist(), right.tolist(), made.tolist(), strict=True))}
        self.none = (len(merges), -1)
        #: Rank of the merge that makes a token and its two parts; -1 for base symbols.
        self.born = np.full(size, -1, dtype=np.int64)
        self.first = np.arange(size)
        self.second = np.arange(size)
        self.born[made], self.first[made], self.second[made] = np.arange(len(made)), left, right
        keys = left * size + right
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order
        unique = len(np.unique(made)) == len(made)
        #: Undoing merges in reverse order needs parts that are older than the whole.
        self.ordered = bool(unique and np.all(self.born[left] < np.arange(len(left))) and np.all(self.born[right] < np.arange(len(right))))
        self.whole_token = self._whole_tokens(made, left, right)
        sound = [(t, i) for t, i in self.vocab.items() if self.whole_token[i]]
        self.last = {t[: -len(END)]: i for t, i in sound if t.endswith(END)}
        self.body = {t: i for t, i in sound if not t.endswith(END)}
        #: How long a token can be that begins with these three letters.
        self.reach: dict[str, int] = {}
        for t in self.body:
            self.reach[t[:3]] = max(len(t), self.reach.get(t[:3], 0))
        back = {c: b for b, c in enumerate(self.alphabet)}
        self.whole: dict[str, int] = {}
        for t, i in self.vocab.items():
            if t.endswith(END) and self.whole_token[i]:
                try:
                    self.whole[bytes(back[c] for c in t[: -len(END)]).decode()] = i
                except (KeyError, UnicodeDecodeError):
                    continue
        self.stats = {"words": 0, "merged": 0}

    def __reduce__(self):
        raise TypeError("load the vocabulary on the executor, by its path")

    # --- proofs -----------------------------------------------------------------
    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NEVER)

    def apart(self, a: np.ndarray, b: np.ndarray, joined: bool = False) -> np.ndarray:
        """True where BPE never merges across the border of a and b.

        Walks back in time: the younger of the two tokens at the border is taken apart, and
        any merge across the border that would have come earlier refutes the pair. With
        ``joined`` the direct merge of a and b itself is not counted.
        """
        a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        limit = np.full(len(a), _NEVER)
        ok = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        skip = joined
        while len(live):
            x, y = a[live], b[live]
            if not skip:
                crossed = self._pair_rank(x, y) < limit[live]
                ok[live[crossed]] = False
            skip = False
            bx, by = self.born[x], self.born[y]
            go = ok[live] & ((bx >= 0) | (by >= 0))
            take_left = bx > by
            limit[live] = np.where(take_left, bx, by + 1)
            a[live] = np.where(take_left, self.second[x], x)
            b[live] = np.where(take_left, y, self.first[y])
            live = live[go]
        return ok

    def _whole_tokens(self, made, left, right) -> np.ndarray:
        """Which tokens encode to themselves: proven from their parts, oldest first."""
        sound = np.zeros(self.size, dtype=bool)
        sound[[i for i in self.vocab.values() if self.born[i] < 0]] = True
        if not self.ordered:
            for i in self.vocab.values():
                t = next(k for k in (self.token[i],))
                sound[i] = self.merge_symbols(self.split(t)) == [i]
            return sound
        apart = self.apart(left, right, joined=True)
        for m, a, b, ok in zip(made.tolist(), left.tolist(), right.tolist(), apart.tolist(), strict=True):
            sound[m] = ok and sound[a] and sound[b]
        return sound

    # --- encoding of one pre-token ---------------------------------------------
    @staticmethod
    def split(mapped: str) -> list[str]:
        body = mapped.removesuffix(END)
        out = list(body)
        if mapped.endswith(END) and out:
            out[-1] += END
        return out

    def mapped(self, word: str) -> str:
        if word.isascii():
            return word if word.isprintable() else "".join(self.alphabet[b] for b in word.encode())
        return "".join([self.alphabet[b] for b in word.encode()])

    def merge_symbols(self, symbols: list[str]) -> list[int]:
        """Textbook merging: always the pair of lowest rank, leftmost first."""
        vocab = self.vocab
        ids: list[int] = [vocab[s] for s in symbols if s in vocab]
        if len(ids) > 40:
            return self._merge_long(ids)
        get, none = self.rank.get, self.none
        ranks = [get(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best is none:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [best[1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((best[1], ids[i + 1]), none)
            if i:
                ranks[i - 1] = get((ids[i - 1], best[1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over neighbours: n log n for long words."""
        from heapq import heapify, heappop, heappush

        n = len(ids)
        nxt, prv, rank = list(range(1, n + 1)), list(range(-1, n - 1)), self.rank
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heapify(heap)
        while heap:
            _, i, a, b, c = heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = c, -1
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                if r := rank.get((c, ids[k])):
                    heappush(heap, (r[0], i, c, ids[k], r[1]))
            if (h := prv[i]) >= 0 and (r := rank.get((ids[h], c))):
                heappush(heap, (r[0], h, ids[h], c, r[1]))
        return [i for i in ids if i >= 0]

    def merge(self, word: str) -> list[int]:
        return self.merge_symbols(self.split(self.mapped(word) + END))

    def greedy(self, word: str) -> list[int] | None:
        """Longest self-encoding vocabulary strings from the left; None if they don't cover the word."""
        text = self.mapped(word)
        n, at, out = len(text), 0, []
        body, last, reach = self.body.get, self.last.get, self.reach.get
        while True:
            if (i := last(text[at:])) is not None:
                out.append(i)
                return out
            for k in range(min(reach(text[at : at + 3], 2), n - at - 1), 0, -1):
                if (i := body(text[at : at + k])) is not None:
                    out.append(i)
                    at += k
                    break
            else:
                return None

    def speculate(self, words: list[str]) -> dict[str, list[int]]:
        """Encode distinct pre-tokens: propose, test all adjacent pairs at once, merge what fails."""
        out: dict[str, list[int]] = {}
        guessed = []
        for w in words:
            ids = self.greedy(w) if self.ordered else None
            if ids is None:
                out[w] = self.merge(w)
                self.stats["merged"] += 1
            elif len(ids) == 1:
                out[w] = ids
            else:
                guessed.append((w, ids))
        self.stats["words"] += len(words)
        if guessed:
            lens = np.array([len(i) for _, i in guessed])
            flat = np.array([i for _, ids in guessed for i in ids], dtype=np.int64)
            last = np.cumsum(lens) - 1
            inner = np.ones(len(flat), dtype=bool)
            inner[last] = False
            at = np.flatnonzero(inner)
            pairs, back = np.unique(flat[at] * self.size + flat[at + 1], return_inverse=True)
            good = self.apart(pairs // self.size, pairs % self.size)[back]
            bad = np.bincount(np.repeat(np.arange(len(lens)), lens)[at], weights=~good, minlength=len(lens)) > 0
            for (w, ids), wrong in zip(guessed, bad.tolist(), strict=True):
                out[w] = self.merge(w) if wrong else ids
            self.stats["merged"] += int(bad.sum())
        return out

    # --- texts ------------------------------------------------------------------
    def normal(self, text: str) -> str:
        """NFC, then lower case letter by letter (no special final sigma)."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens in order, of a text without special strings."""
        text = self.normal(text)
        if text.isalpha():
            return [text]
        core = text.rstrip(".,;:!?&*#$%")
        return [core, text[len(core) :]] if core.isalpha() else self.words(text)

    def chunks(self, text: str | None) -> list:
        """The text cut at white space, which no pre-token contains; special strings as 1-tuples.

        Chunks repeat far more often than texts, so results are cached by chunk.
        """
        if not text:
            return []
        if self.specials is not None and any(s in text for s in self.special):
            return [c for part in self.specials.split(text) for c in ([(part,)] if part in self.special else self.chunks(part))]
        # str.split() also cuts at four control characters that may stand within a pre-token
        return self.pieces(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.lower().split() if text.isascii() else text.split()


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    """One vocabulary a Python worker."""
    return WordBpe(path)


class Memo:
    """Results by chunk. Only a shortcut: at ``limit`` entries it starts afresh.

    ``encode`` maps distinct pre-tokens to their ids (or counts), all new ones of a batch
    at once; ``join`` puts the results of a chunk's pre-tokens together.
    """

    def __init__(self, bpe: WordBpe, encode, join, limit: int = 500_000):
        self.bpe, self.encode, self.join, self.limit = bpe, encode, join, limit
        self.known: dict = {}

    def learn(self, texts: list[list]) -> None:
        fresh = set().union(*texts).difference(self.known) if texts else set()
        if not fresh:
            return
        if len(self.known) + len(fresh) > self.limit:
            self.known = {}
            fresh = set().union(*texts)
        special = self.bpe.special
        parts = {c: None if type(c) is tuple else self.bpe.pieces(c) for c in fresh}
        word = self.encode(list(set().union(*filter(None, parts.values()))))
        for c, p in parts.items():
            self.known[c] = self.join([[special[c[0]]]] if p is None else [word[w] for w in p])


@lru_cache(maxsize=4)
def both_memo(path: str) -> Memo:
    """Ids as bytes, and the decoded words with a blank after each."""
    bpe = load(path)

    def join(parts: list[list[int]]) -> tuple[bytes, bytes]:
        flat = [i for p in parts for i in p]
        return array("I", flat).tobytes(), "".join([bpe.token[i] + " " for i in flat]).encode()

    return Memo(bpe, bpe.speculate, join)


@lru_cache(maxsize=4)
def count_memo(path: str) -> Memo:
    """Token counts: one for pre-tokens proven to be one token, exact merging for the rest."""
    bpe = load(path)
    whole = bpe.whole

    def count(words: list[str]) -> dict[str, int]:
        return {w: 1 if w in whole else len(bpe.merge(w)) for w in words}

    return Memo(bpe, count, lambda parts: sum(p if type(p) is int else len(p) for p in parts))
