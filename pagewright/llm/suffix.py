"""Operator 10: repeated passages by suffix arrays.

A byte goes when it lies in a 50-byte string that also starts in a document with a smaller doc_id. Texts are packed
into chunks. Content-defined anchors (the least hashed 24-gram of every 50-byte window) route: equal windows have
the same anchor at the same place, so an anchor answers for the windows of which it is the least gram, and only those
whose surroundings another document has, too, meet in the anchor's bucket. There, shard by shard, a suffix array is
built by Larsson-Sadakane refinement, Kasai's pass gives common prefixes, and the shards' sorted windows are merged by
binary search, which yields for each window the smallest document that has it. A bucket that a very common anchor
would fill is split: its windows are dealt one by one, each chunk's copies as one. Hashes only route; equality is
decided on the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stage_table

WINDOW = 50
GRAM = 24
SPAN = WINDOW - GRAM + 1  # grams in a window
REACH = WINDOW - GRAM
HALF = REACH // 2
CHUNK_BYTES = 8 << 20  # a chunk has a row in most buckets, so rows are chunks times buckets: few large chunks
CHUNK_DOCS = 4000
BLOCK = 1 << 20
BUCKET_BYTES = 8 << 20
HOT_ANCHORS = 1_000_000  # of a bucket; beyond, its windows are dealt one by one, with the same result
SHARD_BYTES = 2 << 20
MULT = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _hashes(b: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of `size` bytes, by doubling."""
    part = {1: b.astype(np.uint64) + np.uint64(1)}
    n = 1
    while 2 * n <= size:
        p = part[n]
        part[2 * n] = p[:-n] * MULT[(len(part) - 1) % 4] + p[n:]
        n *= 2
    h = part[n][: len(b) - size + 1]
    done = n
    for n in sorted(part, reverse=True)[1:]:
        if done + n <= size:
            h = h * MULT[4] + part[n][done : done + len(h)]
            done += n
    h = (h ^ (h >> np.uint64(31))) * MULT[0]
    return h ^ (h >> np.uint64(29))


def _sliding(a: np.ndarray, w: int, f: Callable) -> np.ndarray:
    n = 1
    while 2 * n <= w:
        a = f(a[:-n], a[n:])
        n *= 2
    return f(a[: len(a) - w + n], a[w - n :]) if n < w else a


PLACE = np.uint64((1 << 24) - 1)


def anchors(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the grams that are the least (the first of the least) of some window, their hashes, the first and
    last window that each answers for, and two hashes of wider strings.

    A window reaches at least HALF bytes beyond its anchor, on the left if it starts so far before, else on the right;
    so two occurrences only matter to each other if the anchors extended by HALF bytes on that side are equal. The
    wider hashes, one row for each side, are 0 where no window of the anchor is on that side. Long texts are searched
    block by block.
    """
    found = []
    for s in range(0, len(text) - WINDOW + 1, BLOCK):
        h = _hashes(text[s : s + BLOCK + WINDOW - 1], GRAM)
        low = _sliding(h & ~PLACE | np.arange(len(h), dtype=np.uint64), SPAN, np.minimum)
        at = (low & PLACE).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        last = np.append(first[1:], len(at)) - 1
        at = at[first]
        left = (h[np.maximum(at - HALF, 0)] * MULT[1] + h[at]) * MULT[2]
        right = (h[np.minimum(at + HALF, len(h) - 1)] * MULT[3] + h[at]) * MULT[4]
        wide = np.stack([left ^ (left >> np.uint64(29)), right ^ (right >> np.uint64(31))]) | np.uint64(1)
        wide[0, first > at - HALF] = 0
        wide[1, last <= at - HALF] = 0
        found.append((at + s, h[at], first + s, last + s, wide))
    if not found:
        none = np.empty(0, np.int64)
        return none, np.empty(0, np.uint64), none, none, np.empty((2, 0), np.uint64)
    return tuple(np.concatenate(x, -1) for x in zip(*found, strict=True))


def larsson_sadakane(text: np.ndarray) -> np.ndarray:
    """The suffix array: all positions in the order of the suffixes that start there (a suffix comes before its extensions).

    After a first sort by eight bytes, each pass doubles the compared length and sorts only groups still equal, by
    their group and the group of the position that far ahead.
    """
    n = len(text)
    padded = np.append(text.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64))
    low, high = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for k in range(4):
        high = high * np.uint64(257) + padded[k : k + n]
        low = low * np.uint64(257) + padded[k + 4 : k + 4 + n]
    # Bytes count from 1 and the end as 0; seven of eight 257-ary digits fill 57 bits.
    key = high * np.uint64(257**3) + low // np.uint64(257)
    order = np.argsort(key)
    ranked = key[order]
    start = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if n else np.empty(0, np.int64)
    size = np.diff(np.append(start, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(start, size)
    start, size = start[size > 1], size[size > 1]
    length = 7
    while len(start):
        slots = np.repeat(start - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        at = order[slots]
        ahead = at + length
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = (rank[at].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(head, len(at)))
        start = slots[head]
        rank[at] = np.repeat(start, size)
        start, size = start[size > 1], size[size > 1]
        length *= 2
    return order


def kasai(text: np.ndarray, order: np.ndarray, run: int, most: int) -> np.ndarray:
    """Common prefixes, up to `most`, of each suffix with the one before it in the suffix array.

    Kasai's pass, in step over stretches of `run` positions: along a stretch a prefix shrinks by one at most, so
    comparing goes on where the position before left off.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    lcp = np.zeros(n, np.int64)
    # Past the end, a suffix has a mark that no byte equals; the other side is never past it at the same time.
    padded = np.append(text.astype(np.int16), np.full(most + 1, -1, np.int16))
    starts = np.arange(0, n, run)
    held = np.zeros(len(starts), np.int64)
    for step in range(run):
        i = starts + step
        if i[-1] >= n:
            i, starts, held = i[:-1], starts[:-1], held[:-1]
            if not len(i):
                break
        j = before[i]
        held = np.where(j >= 0, np.maximum(held - 1, 0), 0)
        on = np.flatnonzero((j >= 0) & (held < most))
        while len(on):
            on = on[padded[i[on] + held[on]] == padded[j[on] + held[on]]]
            held[on] += 1
            on = on[held[on] < most]
        lcp[i] = held
    return lcp[order]


@lru_cache(maxsize=1)
def _coder() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


@lru_cache(maxsize=1)
def _packer() -> zstandard.ZstdCompressor:
    """For bodies, which are stored once and move twice."""
    return zstandard.ZstdCompressor(level=6)


def _zip(a: bytes) -> bytes:
    return _coder()[0].compress(a)


def _unzip(a: bytes) -> bytes:
    return _coder()[1].decompress(a)


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole texts, packed across the batches of a task."""
    serial = TaskContext.get().partitionId() << 32
    texts, ids, extra, held = [], [], [], 0

    def packed() -> pd.DataFrame:
        body = b"".join(texts)
        marks = [hashlib.sha256(t).digest() for t in texts]
        return pd.DataFrame({"chunk": [serial], "marks": [marks], "ids": [ids], "sizes": [[len(t) for t in texts]], "extra": [extra], "raw": [len(body)], "body": [_packer().compress(body)]})

    for batch in batches:
        for text, own, more in zip(batch["text"], batch["doc_id"].tolist(), batch["extra"].tolist(), strict=True):
            t = (text or "").encode()
            if texts and (len(texts) == CHUNK_DOCS or held + len(t) > CHUNK_BYTES):
                yield packed()
                serial += 1
                texts, ids, extra, held = [], [], [], 0
            texts.append(t)
            ids.append(own)
            extra.append(more)
            held += len(t)
    if texts:
        yield packed()


def _texts(body: bytes, sizes: np.ndarray) -> list[np.ndarray]:
    whole = np.frombuffer(_unzip(body), np.uint8)
    cuts = np.append(0, np.cumsum(sizes))
    return [whole[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _low(h: np.ndarray) -> bytes:
    """The low four bytes of hashes as a set: sorted differences, zipped byte place by byte place."""
    step = np.diff(np.unique(h.astype(np.uint32)), prepend=np.uint32(0))
    return _zip(np.ascontiguousarray(step.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _high(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(_unzip(b), np.uint8).reshape(4, -1).T).view("<u4").ravel(), dtype=np.uint64)


def _planes(a: np.ndarray) -> bytes:
    """Columns of integers, zipped byte place by byte place."""
    return _zip(np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _columns(b: bytes, count: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unzip(b), np.uint8).reshape(8, -1).T).view("<i8").reshape(count, -1)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


KEPT = np.uint64((1 << 32) - 1)
NONE = np.uint64((1 << 52) - 1)


def _announce(buckets: int) -> Callable:
    """The distinct wider hashes of each chunk, by bucket, four bytes each (the bucket holds more), and how many
    anchors of the chunk belong there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, sizes, body in zip(batch["chunk"], batch["sizes"], batch["body"], strict=True):
                found = [anchors(t) for t in _texts(body, sizes) if len(t) >= WINDOW]
                if not found:
                    continue
                n = np.bincount(_bucket(np.concatenate([x[1] for x in found]), buckets), minlength=buckets)
                h = np.unique(np.concatenate([x[4].ravel() for x in found]))
                h = h[h > 0]
                to = _bucket(h, buckets)
                by = np.argsort(to, kind="stable")
                cut = np.searchsorted(to[by], np.arange(buckets + 1))
                some = np.flatnonzero((n > 0) | (np.diff(cut) > 0))
                yield pd.DataFrame({"bucket": some, "chunk": chunk, "h": [_low(h[by[cut[k] : cut[k + 1]]]) for k in some], "n": n[some]})

    return run


def _shared(pdf: pd.DataFrame, hot_anchors: int) -> pd.DataFrame:
    """Of one bucket, the anchors of each chunk that another chunk has, too, and whether the bucket is to be split."""
    hot = bool(pdf["n"].sum() > hot_anchors)
    each = [_high(b) for b in pdf["h"]]
    value, n = np.unique(np.concatenate(each), return_counts=True)
    both = value[n > 1]
    kept = [h[np.isin(h, both, assume_unique=True)] for h in each]
    out = pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "h": [_low(h) for h in kept], "hot": hot})
    return out[[len(h) > 0 or hot for h in kept]]


def _grid(text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of stretches of a text, one after the other."""
    return text[np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())]


def _surroundings(buckets: int) -> Callable:
    """For each chunk and bucket, the windows around shared anchors and where they occur; copies have none."""

    def split(text: np.ndarray, start: np.ndarray, n: np.ndarray, ids: np.ndarray, chunk: int) -> Iterator[tuple]:
        """The windows of hot buckets, dealt out by their own hash, the chunk's equal ones as one."""
        at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
        rows = text[at[:, None] + np.arange(WINDOW)]
        first, own = _distinct(rows)
        ids = np.repeat(ids, n)
        low, top = np.full(len(first), np.iinfo(np.int64).max), np.full(len(first), np.iinfo(np.int64).min)
        np.minimum.at(low, own, ids)
        np.maximum.at(top, own, ids)
        rows = rows[first]
        to = buckets + _bucket(_hashes(rows.ravel(), WINDOW)[:: WINDOW], buckets)
        by = np.argsort(to, kind="stable")
        for some in np.split(by, np.flatnonzero(np.diff(to[by])) + 1):
            yield int(to[some[0]]), chunk, b"", _zip(rows[some].tobytes()), _planes(np.stack([low[some], top[some]]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, ids, sizes, body, copies, shared in zip(batch["chunk"], batch["ids"], batch["sizes"], batch["body"], batch["copies"], batch["shared"], strict=True):
                texts = _texts(body, sizes)
                skip = set() if copies is None else set(copies)
                own = [k for k, t in enumerate(texts) if len(t) >= WINDOW and k not in skip]
                if not own:
                    continue
                found = [anchors(texts[k]) for k in own]
                doc = np.repeat(own, [len(x[0]) for x in found])
                pos, h, first, last, wide = (np.concatenate(x, -1) for x in zip(*found, strict=True))
                code = np.where(wide > 0, _bucket(wide, buckets).astype(np.uint64) << np.uint64(32) | wide & KEPT, NONE)
                pair = np.unique(code.ravel() * np.uint64(1 << 12) + np.tile(doc, 2).astype(np.uint64))  # a chunk has under 4096 documents
                value, n = np.unique(pair >> np.uint64(12), return_counts=True)
                told = [] if shared is None else shared
                known = np.concatenate([value[n > 1], *((np.uint64(int(x["bucket"])) << np.uint64(32)) | _high(x["h"]) for x in told)])
                left, right = np.isin(code, known[known != NONE])
                first = np.where(left, first, np.maximum(first, pos - HALF + 1))
                last = np.where(right, last, np.minimum(last, pos - HALF))
                on = left | right
                pos, doc, first, last, to = pos[on], doc[on], first[on], last[on], _bucket(h[on], buckets)
                if not len(pos):
                    continue
                start = np.append(0, np.cumsum(sizes))[doc]
                whole = np.concatenate(texts)
                number = np.asarray(ids, np.int64)[doc]
                length = last - first + WINDOW
                hot = np.isin(to, [int(x["bucket"]) for x in told if x["hot"]])
                rows = list(split(whole, (start + first)[hot], (last - first + 1)[hot], number[hot], chunk)) if hot.any() else []
                by = np.flatnonzero(~hot)
                by = by[np.argsort(to[by], kind="stable")]
                for some in np.split(by, np.flatnonzero(np.diff(to[by])) + 1) if len(by) else []:
                    where = np.stack([number[some], doc[some], first[some]])
                    place = np.stack([length[some], pos[some] - first[some]]).astype(np.uint8)
                    rows.append((int(to[some[0]]), chunk, place.tobytes(), _zip(_grid(whole, (start + first)[some], length[some]).tobytes()), _planes(where)))
                yield pd.DataFrame(rows, columns=["bucket", "chunk", "place", "text", "at"])

    return run


def _windows(rows: np.ndarray, length: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one shard of texts (a row each, `length` valid bytes, smallest document `low`): its distinct windows in
    order, the smallest document of each, and for each (row, offset) the index of its window."""
    wide = rows.shape[1]
    text = rows.ravel()
    valid = (np.arange(wide) < np.maximum(length - WINDOW + 1, 0)[:, None]).ravel()
    order = larsson_sadakane(text)
    group = np.cumsum(kasai(text, order, wide, WINDOW) < WINDOW)
    inside = valid[order]
    order, group = order[inside], group[inside]
    new = np.append(True, group[1:] != group[:-1])[: len(order)]
    head = np.flatnonzero(new)
    least = np.minimum.reduceat(low[order // wide], head) if len(head) else np.empty(0, np.int64)
    index = np.full(len(text), -1, np.int64)
    index[order] = np.cumsum(new) - 1
    return order[head], least, index.reshape(rows.shape), text


def _strings(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(text[at[:, None] + np.arange(WINDOW)]).view(f"V{WINDOW}").ravel()


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First occurrence of each distinct row of bytes, and the number of each row's. Sorts by a hash, compares bytes."""
    words = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    words[:, : rows.shape[1]] = rows
    words = words.view(np.uint64)
    h = np.zeros(len(rows), np.uint64)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * MULT[k % 5]
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = (words[order[1:]] == words[order[:-1]]).all(1)
    if (~same & (h[order[1:]] == h[order[:-1]])).any():
        _, first, own = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
        return first, own
    new = np.append(True, ~same)[: len(rows)]
    own = np.empty(len(rows), np.int64)
    own[order] = np.cumsum(new) - 1
    return order[new], own


def _least(text: np.ndarray, length: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each (row, offset) of texts (a row each, `length` valid bytes, smallest document `low`) the smallest document
    that has its window, by suffix arrays of shards of bounded size, merged by binary search in each other's windows."""
    wide = text.shape[1]
    done = []
    shards = np.array_split(np.arange(len(text)), -(-text.size // SHARD_BYTES))
    for shard in shards:
        head, least, index, flat = _windows(text[shard], length[shard], low[shard])
        done.append([index, least, _strings(flat, head) if len(shards) > 1 else None])
    # The windows of all shards so far, sorted, with the smallest document of each.
    merged, best = done[0][2], done[0][1]
    for _, least, strings in done[1:]:
        at = np.searchsorted(merged, strings)
        same = merged[np.minimum(at, len(merged) - 1)] == strings if len(merged) else np.zeros(len(strings), bool)
        best[at[same]] = np.minimum(best[at[same]], least[same])
        merged, best = np.insert(merged, at[~same], strings[~same]), np.insert(best, at[~same], least[~same])
    keeper = np.full(text.shape, np.iinfo(np.int64).max)
    for shard, (index, least, strings) in zip(shards, done, strict=True):
        if strings is not None and len(strings):
            least = best[np.searchsorted(merged, strings)]
        if len(least):
            keeper[shard] = np.where(index >= 0, least[np.maximum(index, 0)], np.iinfo(np.int64).max)
    return keeper[:, : wide - WINDOW + 1]


def _judge(pdf: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Of one bucket, the covered stretch of each occurrence. Equal surroundings count once. Where all texts around a
    gram are the same bytes, the smallest document keeps them; the others go through suffix arrays."""
    if pdf["bucket"].iloc[0] >= buckets:
        return _judge_windows(pdf)
    wide = REACH + WINDOW
    length, offset = np.concatenate([np.frombuffer(x, np.uint8).reshape(2, -1) for x in pdf["place"]], 1).astype(np.int64)
    text = np.zeros((len(length), wide), np.uint8)
    text[np.arange(wide) < length[:, None]] = np.concatenate([np.frombuffer(_unzip(x), np.uint8) for x in pdf["text"]])
    parts = [_columns(x, 3) for x in pdf["at"]]
    part = np.repeat(np.arange(len(parts)), [x.shape[1] for x in parts])
    ids, doc, left = np.concatenate(parts, 1)
    first, own = _distinct(np.concatenate([text, length[:, None].astype(np.uint8), offset[:, None].astype(np.uint8)], 1))
    low = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(low, own, ids)
    text, length, offset = text[first], length[first], offset[first]
    _, gram = _distinct(text[np.arange(len(text))[:, None], offset[:, None] + np.arange(GRAM)])
    several = np.bincount(gram)[gram] > 1
    begin, end = np.zeros(len(ids), np.int64), np.where(ids > low[own], length[own], 0)  # of each occurrence
    hard = np.flatnonzero(several)
    if len(hard):
        keeper = np.full((len(text), REACH + 1), np.iinfo(np.int64).max)
        keeper[hard] = _least(text[hard], length[hard], low[hard])
        some = np.flatnonzero(several[own])
        gone = keeper[own[some]] < ids[some, None]
        begin[some] = gone.argmax(1)
        end[some] = np.where(gone.any(1), REACH + WINDOW - gone[:, ::-1].argmax(1), 0)
    out = []
    for k in np.unique(part[end > 0]):
        on = (part == k) & (end > 0)
        out.append((pdf["chunk"].iloc[k], _planes(np.stack([doc[on], left[on] + begin[on], left[on] + end[on]])), None, None))
    return pd.DataFrame(out, columns=["chunk", "spans", "windows", "keepers"])


def _judge_windows(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of single windows, those of each chunk that a smaller document has, and which."""
    rows = [np.frombuffer(_unzip(x), np.uint8).reshape(-1, WINDOW) for x in pdf["text"]]
    part = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    low, top = np.concatenate([_columns(x, 2) for x in pdf["at"]], 1)
    rows = np.concatenate(rows)
    first, own = _distinct(rows)
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, own, low)
    keeper = _least(rows[first], np.full(len(first), WINDOW), least)[own, 0]
    out = []
    for k in np.unique(part[keeper < top]):
        on = (part == k) & (keeper < top)
        out.append((pdf["chunk"].iloc[k], None, _zip(rows[on].tobytes()), _planes(keeper[None, on])))
    return pd.DataFrame(out, columns=["chunk", "spans", "windows", "keepers"])


def _repeats(text: np.ndarray, own: int, keepers: dict[bytes, int], hashes: np.ndarray) -> np.ndarray:
    """Where windows of a text start that a document smaller than `own` has."""
    if len(text) < WINDOW:
        return np.empty(0, np.int64)
    at = np.flatnonzero(np.isin(_hashes(text, WINDOW), hashes))
    return np.array([p for p in at.tolist() if keepers.get(text[p : p + WINDOW].tobytes(), own) < own], np.int64)


def _removed(want_text: bool) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, sizes, body, extra, copies, spans in zip(batch["ids"], batch["sizes"], batch["body"], batch["extra"], batch["copies"], batch["spans"], strict=True):
                skip = set() if copies is None else set(copies)
                texts = _texts(body, sizes)
                spans = [] if spans is None else spans
                found = [_columns(s["spans"], 3) for s in spans if s["spans"] is not None]
                keepers: dict[bytes, int] = {}
                for s in spans:
                    if s["windows"] is not None:
                        b = _unzip(s["windows"])
                        keepers.update(zip((b[i : i + WINDOW] for i in range(0, len(b), WINDOW)), _columns(s["keepers"], 1)[0].tolist(), strict=True))
                hashes = _hashes(np.frombuffer(b"".join(keepers), np.uint8), WINDOW)[::WINDOW] if keepers else None
                doc, a, b = np.concatenate(found, 1) if found else np.empty((3, 0), np.int64)
                by = np.argsort(doc, kind="stable")
                doc, a, b = doc[by], a[by], b[by]
                cut = np.searchsorted(doc, np.arange(len(texts) + 1))
                rows = []
                for k, t in enumerate(texts):
                    gone = np.zeros(len(t) + 1, np.int64)
                    np.add.at(gone, a[cut[k] : cut[k + 1]], 1)
                    np.add.at(gone, b[cut[k] : cut[k + 1]], -1)
                    if keepers and k not in skip:
                        at = _repeats(t, ids[k], keepers, hashes)
                        gone[at] += 1
                        gone[at + WINDOW] -= 1
                    hit = np.cumsum(gone)[:-1] > 0
                    if k in skip and len(t) >= WINDOW:
                        hit[:] = True
                    left = t[~hit].tobytes()
                    runs = int((np.diff(np.append(0, hit.astype(np.int8))) == 1).sum())
                    rows.append((ids[k], len(t), int(hit.sum()), runs, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if want_text else None, extra[k]))
                yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "extra"])

    return run


def repeated_passages(docs: DataFrame, want_text: bool = True, extra: str | None = None, hot_anchors: int = HOT_ANCHORS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text, extra) of every row of documents(doc_id, text).

    Null text is empty; texts under 50 bytes keep all. Rows that share a doc_id don't remove from each other; rows
    without one neither lose nor cause removals. text: what is left, less halves of split characters, when wanted.
    extra: a string column that is carried along. Very long texts are searched block by block.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", (F.col(extra) if extra else F.lit(None).cast("string")).alias("extra"))
    packed = "chunk long, marks array<binary>, ids array<long>, sizes array<int>, extra array<string>, raw long, body binary"
    chunks = stage_table(bounded_batches(docs.where("doc_id is not null")).mapInPandas(_chunks, packed), "chunks")
    raw = chunks.agg(F.sum("raw")).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-raw // BUCKET_BYTES))
    # A text that a smaller document has, too, loses all that it can; only the first is searched.
    each = chunks.select("chunk", F.posexplode(F.arrays_zip("marks", "ids")).alias("k", "x")).select("chunk", "k", F.col("x.marks").alias("mark"), F.col("x.ids").alias("id"))
    least = stage_table(each.groupBy("mark").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "marks")
    copies = each.join(least, "mark").where("id > least").groupBy("chunk").agg(F.collect_list("k").alias("copies"))
    copies = stage_table(copies, "copies")
    told = chunks.select("chunk", "sizes", "body").mapInPandas(_announce(buckets), "bucket long, chunk long, h binary, n long")
    both = told.groupBy("bucket").applyInPandas(lambda pdf: _shared(pdf, hot_anchors), "chunk long, bucket long, h binary, hot boolean")
    shared = both.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "h", "hot")).alias("shared"))
    near = chunks.select("chunk", "ids", "sizes", "body").join(shared.join(copies.hint("merge"), "chunk", "left"), "chunk", "left").mapInPandas(_surroundings(buckets), "bucket long, chunk long, place binary, text binary, at binary")
    spans = near.groupBy("bucket").applyInPandas(lambda pdf: _judge(pdf, buckets), "chunk long, spans binary, windows binary, keepers binary")
    spans = spans.groupBy("chunk").agg(F.collect_list(F.struct("spans", "windows", "keepers")).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, extra string"
    out = chunks.join(spans.join(copies.hint("merge"), "chunk", "full_outer"), "chunk", "left").select("ids", "sizes", "body", "extra", "copies", "spans").mapInPandas(_removed(want_text), schema)
    text = F.coalesce(F.col("text"), F.lit(""))
    zero = F.lit(0).cast("long")
    lone = docs.where("doc_id is null").select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"), text.alias("text"), "extra")
    return out.unionByName(lone)
