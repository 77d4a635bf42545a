"""Operator 2: byte-level BPE by speculation and verification.

Greedy longest match proposes the tokens of each distinct word. A proposal is right exactly when every pair of
neighbours is compatible: along the right edge of the left token's merge tree and the left edge of the right one's,
no merge across the seam comes before the merges that hide its two sides. All pairs are tested in numpy at once;
only words with a failing pair undergo exact merging.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: The pattern that parts text into words before merging (a fixed value of the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts without "_", numbers other than digits, and separator controls.
SIMPLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?[^\s\w]+|\s+(?!\S)|\s+"
CACHED_WORDS = 700_000
WORDS_AT_ONCE = 200_000
STEPPED = 24
FAR = np.int64(1) << 40


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: visible Latin-1 stays, the rest moves to 256 and up."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Table:
    """Open addressing with linear probing: integer keys, each with a rank and a value, looked up many at once."""

    def __init__(self, keys: list[int], ranks: list[int], made: list[int]):
        self.bits = max(8, (4 * len(keys)).bit_length())
        n = 1 << self.bits
        self.key, self.rank, self.made = np.full(n, -1, np.int64), np.full(n, FAR), np.full(n, -1, np.int64)
        slots = self._slot(np.array(keys, np.int64)).tolist() if keys else []
        held = [-1] * n
        self.probes = 1
        for k, slot in enumerate(slots):
            step = 0
            while held[at := (slot + step) & (n - 1)] >= 0:
                step += 1
            held[at] = k
            self.probes = max(self.probes, step + 1)
        owner = np.array(held)
        on = owner >= 0
        self.key[on], self.rank[on], self.made[on] = np.array(keys, np.int64)[owner[on]], np.array(ranks, np.int64)[owner[on]], np.array(made, np.int64)[owner[on]]
        self.empty = int(np.flatnonzero(~on)[0])

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Slots of keys; an empty slot where there is no such key."""
        at = self._slot(key)
        got = self.key[at]
        left = np.flatnonzero((got != key) & (got >= 0))
        for _ in range(self.probes):
            if not len(left):
                break
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            got = self.key[at[left]]
            left = left[(got != key[left]) & (got >= 0)]
        return np.where(self.key[at] == key, at, self.empty)


class Bpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.slow = Tokenizer.from_file(path).pre_tokenizer
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max(max(vocab.values()), *self.special.values(), 0)
        self.tokens: list[bytes] = [b""] * self.size
        for text, i in vocab.items():
            if text not in self.special:
                self.tokens[i] = bytes(alphabet[c] for c in text)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        left = np.full(self.size, -1, np.int64)
        right = np.full(self.size, -1, np.int64)
        self.rank = np.full(self.size, -1, np.int64)  # of the merge that makes a token; -1: a byte
        keys, ranks = [], []
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merge[x, y] = (r, z)
            keys.append(x * self.size + y)
            ranks.append(r)
            if self.rank[z] < 0:
                left[z], right[z], self.rank[z] = x, y, r
        self.pairs = _Table(keys, ranks, [self.merge[k // self.size, k % self.size][1] for k in keys])
        self.byte = [0] * 256
        for i, t in enumerate(self.tokens):
            if len(t) == 1:
                self.byte[t[0]] = i
        self.right_edge, self.left_edge = self._edges(right), self._edges(left)
        made = np.flatnonzero(self.rank >= 0)
        sound = np.ones(self.size, bool)
        sound[made] = self._compatible(left[made], right[made], self.rank[made])
        for i in made[np.argsort(self.rank[made])]:
            sound[i] &= sound[left[i]] and sound[right[i]]
        self.vocab = {t: i for i, t in enumerate(self.tokens) if t and sound[i]}
        self._trie()
        self.words: dict[str, bytes] = {}
        self.plain: dict[str, int] = {}
        self.pattern, self.simple = regex.compile(PATTERN), re.compile(SIMPLE)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    @staticmethod
    def _edges(child: np.ndarray) -> list[np.ndarray]:
        """edges[k][t]: the token k steps down one edge of t's merge tree, -1 past its end."""
        out = [np.arange(len(child))]
        while (out[-1] >= 0).any():
            out.append(np.where(out[-1] >= 0, child[out[-1]], -1))
        return out[:-1]

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.pairs.find((a * self.size + b).ravel()).reshape(a.shape)

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.pairs.rank[self._find(a, b)]

    def _compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray) -> np.ndarray:
        """Whether no merge across the seam of a and b comes before the rank `until`."""
        good = np.ones(len(a), bool)
        for i, right in enumerate(self.right_edge):
            x = right[a]
            on = np.flatnonzero(x >= 0)
            if not len(on):
                break
            hides_x = self.rank[self.right_edge[i - 1][a[on]]] if i else until[on]
            for j, left in enumerate(self.left_edge):
                y = left[b[on]]
                live = y >= 0
                if not live.any():
                    break
                on, hides_x = on[live], hides_x[live]
                hides_y = self.rank[self.left_edge[j - 1][b[on]]] if j else until[on]
                r = self._pair_rank(x[on], y[live])
                good[on[(r < hides_x) & ((r <= hides_y) if j else (r < hides_y))]] = False
        return good

    def _trie(self) -> None:
        nodes: dict[int, int] = {}
        ends: dict[int, int] = {}
        for token, i in self.vocab.items():
            node = 0
            for b in token:
                node = nodes.setdefault(node * 256 + b, len(nodes) + 1)
            ends[node] = i
        keys = list(nodes)
        self.trie = _Table(keys, [0] * len(keys), list(nodes.values()))
        self.ends = np.full(len(nodes) + 1, -1, np.int64)
        self.ends[list(ends)] = list(ends.values())

    def greedy(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches of many words in step: the ids of all, and how many each word has."""
        stop = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        text = np.append(np.frombuffer(b"".join(raw), np.uint8).astype(np.int64), 0)
        pos = np.concatenate([[0], stop[:-1]])
        live = np.arange(len(raw))
        end, node = stop, np.zeros(len(raw), np.int64)
        token, after = np.full(len(raw), -1, np.int64), pos.copy()
        owners, ids = [], []
        while len(live):
            child = self.trie.made[self.trie.find(node * 256 + text[pos])]
            child[pos >= end] = -1
            on = child >= 0
            pos = pos + on
            node = np.where(on, child, 0)
            got = np.where(on, self.ends[node], -1)
            token, after = np.where(got >= 0, got, token), np.where(got >= 0, pos, after)
            out = np.flatnonzero(~on)
            if len(out):
                owners.append(live[out])
                ids.append(token[out])
                pos[out] = after[out]
                keep = on | (after < end)
                if not keep.all():
                    live, pos, end, node, token, after = live[keep], pos[keep], end[keep], node[keep], token[keep], after[keep]
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(ids)[order], np.bincount(owner, minlength=len(raw))

    def exact(self, word: bytes) -> list[int]:
        """Merges of lowest rank first, leftmost first, by a heap over a linked list."""
        ids = [self.byte[b] for b in word]
        n = len(ids)
        ahead, behind = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            k = ahead[i]
            if ids[i] != a or k < 0 or ids[k] != b:
                continue
            ids[i], ids[k] = made, -1
            ahead[i] = ahead[k]
            if ahead[k] >= 0:
                behind[ahead[k]] = i
            for p, q in ((behind[i], i), (i, ahead[i])):
                if p >= 0 and q >= 0 and (m := self.merge.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (m[0], p, m[1], ids[p], ids[q]))
        return [t for t in ids if t >= 0]

    def exact_many(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """exact() of many short words in step: each round merges the first pair of lowest rank of every word."""
        width = max(2, *map(len, raw))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        grid = np.full((len(raw), width), -1, np.int64)
        grid[np.arange(width) < sizes[:, None]] = np.array(self.byte, np.int64)[np.frombuffer(b"".join(raw), np.uint8)]
        empty, rank = self.pairs.empty, self.pairs.rank

        def slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.where((a >= 0) & (b >= 0), self._find(np.maximum(a, 0), np.maximum(b, 0)), empty)

        live, g, p = np.arange(len(raw)), grid, slots(grid[:, :-1], grid[:, 1:])
        while len(live):
            best = rank[p].argmin(1)
            hit = p[np.arange(len(live)), best]
            on = hit != empty
            grid[live[~on]] = g[~on]
            live, g, p, best, hit = live[on], g[on], p[on], best[on], hit[on]
            if not len(live):
                break
            rows = np.arange(len(live))
            after = np.arange(width)[None, :] > best[:, None]
            g = np.where(after, np.concatenate([g[:, 1:], np.full((len(g), 1), -1)], 1), g)
            g[rows, best] = self.pairs.made[hit]
            p = np.where(after[:, :-1], np.concatenate([p[:, 1:], np.full((len(p), 1), empty)], 1), p)
            some = np.flatnonzero(best < width - 1)
            p[some, best[some]] = slots(g[some, best[some]], g[some, best[some] + 1])
            some = np.flatnonzero(best > 0)
            p[some, best[some] - 1] = slots(g[some, best[some] - 1], g[some, best[some]])
        return grid[grid >= 0], (grid >= 0).sum(1)

    def encode_words(self, words: list[str]) -> int:
        """Puts the ids of new words in self.words; returns how many needed exact merging."""
        raw = [w.encode() for w in words]
        flat, sizes = self.greedy(raw)
        owner = np.repeat(np.arange(len(raw)), sizes)
        seam = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[seam] * self.size + flat[seam + 1], return_inverse=True)
        good = self._compatible(pairs // self.size, pairs % self.size, np.full(len(pairs), FAR - 1))
        wrong = np.unique(owner[seam[~good[back]]])
        data, cuts = flat.astype("<u4").tobytes(), [0, *(4 * np.cumsum(sizes)).tolist()]
        self.words.update(zip(words, [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
        short = [i for i in wrong.tolist() if len(raw[i]) <= STEPPED]
        for at in range(0, len(short), 20_000):
            some = short[at : at + 20_000]
            flat, sizes = self.exact_many([raw[i] for i in some])
            data, cuts = flat.astype("<u4").tobytes(), [0, *(4 * np.cumsum(sizes)).tolist()]
            for i, a, b in zip(some, cuts, cuts[1:], strict=False):
                self.words[words[i]] = data[a:b]
        for i in wrong.tolist():
            if len(raw[i]) > STEPPED:
                self.words[words[i]] = np.array(self.exact(raw[i]), "<u4").tobytes()
        return len(wrong)

    def _finder(self, text: str) -> re.Pattern | regex.Pattern | None:
        """A pattern that parts this text as the tokenizer does; None where Unicode tables may disagree on a character."""
        known, worst = self.plain, 0
        for c in set(text):
            kind = known.get(c)
            if kind is None:
                old, new = unicodedata.ucd_3_2_0.category(c), unicodedata.category(c)
                odd = new in ("No", "Nl") or c == "_" or "\x1c" <= c <= "\x1f"
                kind = known[c] = 2 if old == "Cn" or old != new else int(odd)
            if kind > worst:
                worst = kind
        return (self.simple, self.pattern, None)[worst]

    def _parts(self, text: str) -> Iterator[list[str]]:
        """Lists of the words of a text, each of bounded length."""
        for piece in self.split.split(text) if self.split else [text]:
            if piece in self.special:
                yield [piece]
            elif piece and (pattern := self._finder(piece)):
                if len(piece) < WORDS_AT_ONCE:
                    yield pattern.findall(piece)
                else:
                    words = (m.group() for m in pattern.finditer(piece))
                    while some := list(itertools.islice(words, WORDS_AT_ONCE)):
                        yield some
            elif piece:
                yield [piece[a:b] for _, (a, b) in self.slow.pre_tokenize_str(piece)]

    def encode_batch(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; new words of many texts are encoded together."""
        group: list[list[list[str]]] = []
        held = 0
        for text in texts:
            done: list[bytes] = []
            group.append([])
            for words in self._parts(text):
                group[-1].append(words)
                held += len(words)
                if held >= WORDS_AT_ONCE:
                    *whole, part = self._ids(group)
                    yield from whole
                    done.append(part)
                    group, held = [[]], 0
            if done:
                yield b"".join([*done, *self._ids(group)])
                group, held = [], 0
        yield from self._ids(group)

    def _ids(self, group: list[list[list[str]]]) -> list[bytes]:
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        known = self.words
        new = set().union(*(words for parts in group for words in parts)).difference(known)
        marks = new & self.special.keys()
        for w in marks:
            known[w] = np.array([self.special[w]], "<u4").tobytes()
        if rest := list(new - marks):
            self.encode_words(rest)
        out = [b"".join([b"".join(map(known.__getitem__, words)) for words in parts]) for parts in group]
        for w in new:
            if len(w) > 64:
                del known[w]  # long words are not kept
        return out

    def encode(self, text: str) -> bytes:
        return next(iter(self.encode_batch([text])))

    def decode(self, ids: bytes) -> str:
        names = {i: t.encode() for t, i in self.special.items()}
        tokens = self.tokens
        listed = np.frombuffer(ids, "<u4").tolist()
        if names.keys() & set(listed) if names else False:
            return b"".join(names.get(i, tokens[i]) for i in listed).decode("utf-8", "replace")
        return b"".join(map(tokens.__getitem__, listed)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    """One table for each Python worker."""
    return Bpe(path)


def map_ids(docs: DataFrame, path: str, finish: Callable[[Bpe, bytes], list[tuple]], schema: str) -> DataFrame:
    """Rows of `finish(bpe, ids)` for each whole text of docs(doc_id, text), each led by its doc_id. Null text: no ids."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path)
        for batch in batches:
            rows = [(d, *r) for d, ids in zip(batch["doc_id"], bpe.encode_batch(t or "" for t in batch["text"]), strict=True) for r in finish(bpe, ids)]
            yield pd.DataFrame(rows, columns=["doc_id", *names])

    # As text, ids stay exact beside nulls, which pandas would hold as floats.
    rows = bounded_batches(docs).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(run, f"doc_id string, {schema}").withColumn("doc_id", F.col("doc_id").cast("long"))


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<long>): the ids of every whole text; null and empty texts have none. Rows stay rows, repeated or not; other columns are not read."""
    return map_ids(docs, path, lambda bpe, ids: [(np.frombuffer(ids, "<u4").astype(np.int64),)], "ids array<long>")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [bpe.decode(np.asarray([] if x is None else x, "<u4").tobytes()) for x in batch["ids"]]})

    rows = bounded_batches(encoded).select(F.col("doc_id").cast("string").alias("doc_id"), "ids")
    return rows.mapInPandas(run, "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast("long"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes every whole text; the digests of its ids and of the decoded text."""

    def finish(bpe: Bpe, ids: bytes) -> list[tuple]:
        return [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest())]

    return map_ids(docs, path, finish, "n_tokens long, ids_sha256 string, decoded_sha256 string")
