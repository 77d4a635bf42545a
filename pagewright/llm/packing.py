"""Operator 4: best-fit packing of pieces into fixed-capacity sequences, in bulk-synchronous supersteps.

Pieces are range-sorted by falling length over the cluster and ranked inside their length. Open sequences are kept
as runs of equal gap, sorted by gap. Each superstep takes the next length: its pieces sweep the gaps for the
successor, the smallest gap that holds one; where pieces contend, those of lower rank win and fill a gap as often
as it holds them; the gaps shrink and the rest sweeps again, until new sequences open. Lengths and gaps are at most
`capacity`, so the superstep state is bounded by the capacity and not by the corpus; the rows look their own place
up in the finished placements in one distributed pass. The result equals best-fit decreasing over the whole corpus.
"""

from __future__ import annotations

import bisect
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Bpe, map_ids
from .common import bounded_batches, stage_table

CAPACITY = 2048
SEPARATOR = 0


def place_classes(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Placements of `counts` pieces of each length, and the number of sequences.

    A placement is (length, first rank, first sequence, pieces a sequence, offset): the piece of rank q goes to
    sequence first + (q - first rank) // pieces, at offset + ((q - first rank) % pieces) * length.
    """
    gaps: list[int] = []
    runs: dict[int, deque] = {}
    out: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def free(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                bisect.insort(gaps, gap)
                runs[gap] = deque()
            runs[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, n = runs[gap].popleft()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            else:
                gap, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            fits = gap // length
            full = min(n, left // fits)
            if full:
                out.append((length, rank, first, fits, capacity - gap))
                free(gap - fits * length, first, full)
                rank, left, first, n = rank + full * fits, left - full * fits, first + full, n - full
            if n and left and left < fits:
                out.append((length, rank, first, left, capacity - gap))
                free(gap - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            free(gap, first, n)
    return np.array(out, np.int64).reshape(-1, 5), opened


def best_fit_pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces(length, ...) of 1 to `capacity` each; `order` ranks equal lengths.

    Equal rows take exchangeable places. An empty table gives an empty result. A length outside 1..capacity or null
    is an error, as the piece has no place. Columns named sequence_id or offset are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset", "_part", "_rank")
    ranged = pieces.repartitionByRange(F.desc("length"), *order).withColumn("_part", F.spark_partition_id())
    ranged = stage_table(ranged, "pieces")
    rows = ranged.groupBy("_part", "length").count().collect()  # a row for each length, and for each part at most one more
    if any(r["length"] is None or not 0 < r["length"] <= capacity for r in rows):
        raise ValueError("a piece has no length from 1 to the capacity")
    rows.sort(key=lambda r: (-r["length"], r["_part"]))
    counts: dict[int, int] = {}
    base: dict[tuple[int, int], int] = {}
    for r in rows:
        base[r["_part"], r["length"]] = counts.get(r["length"], 0)
        counts[r["length"]] = counts.get(r["length"], 0) + r["count"]
    placed, _ = place_classes(counts, capacity)
    lengths = placed[:, 0]
    bounds = {n: (np.searchsorted(-lengths, -n, "left"), np.searchsorted(-lengths, -n, "right")) for n in counts}
    local = ranged.withColumn("_rank", F.row_number().over(Window.partitionBy("_part", "length").orderBy(*order)) - 1)

    names = pieces.columns

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, rank, length = (batch.column(c).to_numpy() for c in ("_part", "_rank", "length"))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            pair = part.astype(np.int64) * (capacity + 1) + length
            for key in np.unique(pair).tolist():
                some = np.flatnonzero(pair == key)
                n = key % (capacity + 1)
                q = base[key // (capacity + 1), n] + rank[some]
                lo, hi = bounds[n]
                at = lo + np.searchsorted(placed[lo:hi, 1], q, "right") - 1
                d = q - placed[at, 1]
                seq[some] = placed[at, 2] + d // placed[at, 3]
                off[some] = placed[at, 4] + d % placed[at, 3] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return bounded_batches(local).mapInArrow(look_up, f"{fields}, sequence_id long, offset long")


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): ids of each whole text and the separator, cut only beyond the capacity; a shorter piece comes first."""

    def finish(_: Bpe, ids: bytes) -> list[tuple]:
        ids += SEPARATOR.to_bytes(4, "little")
        n = len(ids) // 4
        first = (n - 1) % capacity + 1
        cuts = [0, *range(first, n + 1, capacity)]
        return [(k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]

    return map_ids(docs, path, finish, "piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of documents(doc_id, text) with their sequence and offset. Null and empty texts are one separator; equal
    rows are packed each; other columns are not read."""
    return best_fit_pack(stage_table(token_pieces(docs, path, capacity), "tokens"), ["doc_id", "piece"], capacity)
