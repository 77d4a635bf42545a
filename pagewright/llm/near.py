"""Operator 9: near-duplicates by MinHash with tensored banding, confirmed on full shingle sets.

Two small collections of hash groups, LEFT x LEFT_ROWS and RIGHT x RIGHT_ROWS minhashes, are computed for a document;
each pair of a left and a right group forms a table key. So 62 minhashes give 140 tables of five rows, which would
otherwise take 700. A pair at similarity 0.8 shares no key with probability below 0.0001; that is the only place
where a link can be missed. All that follows is exact: bounds that refuse a pair hold for whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, stage_table

SHINGLE = 4
PERCENT = 80
LEFT, LEFT_ROWS = 10, 2
RIGHT, RIGHT_ROWS = 14, 3
MINHASHES = LEFT * LEFT_ROWS + RIGHT * RIGHT_ROWS
BITS = 8  # 64-bit words of marks that travel with a document
CROWDED = 32  # members beyond which a bucket meets in blocks instead of by a join; the result is the same
BLOCK = 2048  # members of a crowded bucket that meet in one task, against LEAD of its leading component
LEAD = 8192
MARKS = 32  # 64-bit words of marks in blocks
CACHED_WORDS = 1_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct word shingles; A-Z are lower-cased, only ASCII white space parts words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    cache = _words()
    if len(cache) > CACHED_WORDS:
        cache.clear()
    w = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - size + 1)
    h = np.full(n, min(size, len(w)), np.uint64)
    for k in range(min(size, len(w))):
        h = h * MIX + w[k : k + n]
    return np.unique(_mixed(h))


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    seeds = _mixed(np.arange(1, 2 * MINHASHES + 1, dtype=np.uint64) * MIX)
    return seeds[:MINHASHES], seeds[MINHASHES:] | np.uint64(1)


def _groups(mins: np.ndarray, count: int, rows: int, salt: int) -> np.ndarray:
    out = np.arange(salt, salt + count, dtype=np.uint64)[None, :] * MIX
    for k in range(rows):
        out = _mixed(out + mins[:, k::rows])
    return out.view(np.int64)


def _bits(shingle_set: np.ndarray, words: int) -> np.ndarray:
    """The bits that a set's hashes name: what one set has and another lacks stands for a shingle that they don't share."""
    bits = np.zeros(64 * words, np.uint8)
    bits[(shingle_set >> np.uint64(8)) % np.uint64(64 * words)] = 1
    return np.packbits(bits)


def _digest(shingle_set: np.ndarray) -> bytes:
    return hashlib.blake2b(shingle_set.tobytes(), digest_size=16).digest()


def _sketches(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    flip, times = _permutations()
    for batch in batches:
        sets = [shingles(t, size) for t in batch["text"]]
        count = np.array([len(s) for s in sets], np.int64)
        mins = np.zeros((len(sets), MINHASHES), np.uint64)
        some = np.flatnonzero(count)
        if len(some):
            flat = np.concatenate([sets[i] for i in some])
            at = np.concatenate([[0], np.cumsum(count[some])[:-1]])
            for k in range(MINHASHES):
                mins[some, k] = np.minimum.reduceat((flat ^ flip[k]) * times[k], at)
        left = _groups(mins[:, : LEFT * LEFT_ROWS], LEFT, LEFT_ROWS, 1)
        right = _groups(mins[:, LEFT * LEFT_ROWS :], RIGHT, RIGHT_ROWS, 1000)
        marks = np.stack([_bits(s, BITS).view(np.int64) for s in sets]) if sets else np.empty((0, BITS), np.int64)
        yield pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": count, "digest": [_digest(s) for s in sets], "marks": list(marks), "left": list(left), "right": list(right)})


def _sets(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Of rows (node, digest, text), the sets of those whose text is the node's."""
    for batch in batches:
        sets = [shingles(t, size) for t in batch["text"]]
        own = np.array([_digest(s) == d for s, d in zip(sets, batch["digest"], strict=True)], bool)
        yield pd.DataFrame({"node": batch["node"][own], "shingles": [s.view(np.int64) for s, o in zip(sets, own, strict=True) if o]})


def _marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"node": batch["node"], "bits": [_bits(np.asarray(t, np.int64).view(np.uint64), MARKS).tobytes() for t in batch["shingles"]]})


def _block_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of two blocks of a bucket, the pairs over them that may be similar enough by their sizes and bits. Members of the
    bucket's leading component (own -1) only meet those of others."""
    pdf = pdf.sort_values("own", kind="stable")
    ids, comp, n, own = (pdf[c].to_numpy() for c in ("node", "component", "n", "own"))
    bits = np.frombuffer(b"".join(pdf["bits"]), np.uint64).reshape(len(pdf), MARKS)
    full = np.bitwise_count(bits).sum(1).astype(np.int64)
    led, crossing = bool(pdf["g"].iloc[0]["led"]), own[0] != own[-1]
    first = np.searchsorted(own, own, "right") if crossing else np.arange(1, len(own) + 1)
    if led and own[0] != -1 or led and own[-1] == -1:
        return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
    out = []
    for k in range(len(pdf)):
        r = slice(first[k], None)
        if first[k] >= len(pdf):
            break
        both = np.bitwise_count(bits[r] & bits[k]).sum(1).astype(np.int64)
        common = np.minimum(n[k] - (full[k] - both), n[r] - (full[r] - both))
        on = ((100 + PERCENT) * common >= PERCENT * (n[k] + n[r])) & (comp[r] != comp[k])
        if on.any():
            out.append(np.stack([np.full(on.sum(), ids[k]), ids[r][on]]))
    a, b = np.concatenate(out, 1) if out else np.empty((2, 0), np.int64)
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _may(common: Column, total: Column) -> Column:
    """Whether sets of `total` members together can reach the threshold with `common` shared."""
    return (100 + PERCENT) * common >= PERCENT * total


def _possible(a: str, b: str) -> Column:
    """Whether two sides (n, marks) can reach the threshold: a set shares at most what it has less the bits that only it has."""
    alone = lambda x, y: sum((F.bit_count(F.col(f"{x}.marks")[k].bitwiseAND(F.bitwise_not(F.col(f"{y}.marks")[k]))) for k in range(BITS)), F.lit(0))
    n = lambda x: F.col(f"{x}.n")
    return _may(F.least(n(a), n(b)), n(a) + n(b)) & _may(F.least(n(a) - alone(a, b), n(b) - alone(b, a)), n(a) + n(b))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs(a, b) whose full shingle sets are similar enough."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(_may(common, F.size("sa") + F.size("sb"))).select("a", "b")


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of documents(doc_id, text), by shingles of `size` words.

    Equal sets become one node; links join nodes. Every bucket's members are confirmed against the bucket's
    best-supported member, in crowded buckets against further ones while that settles half of the rest; members still
    in other components are then confirmed against all others of the bucket, less those that bounds on the whole sets
    exclude. Null, empty and blank texts have no shingles and are linked with nothing; so are rows without doc_id.
    Rows that share a doc_id are judged each by their own text. Other columns are not read.
    """
    schema = "doc_id string, n_shingles long, digest binary, marks array<long>, left array<long>, right array<long>"
    # As text, ids stay exact beside nulls, which pandas would hold as floats.
    named = bounded_batches(docs).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    sketches = stage_table(named.mapInPandas(lambda b: _sketches(b, size), schema).withColumn("doc_id", F.col("doc_id").cast("long")), "sketches")
    full = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("low")).withColumn("node", F.monotonically_increasing_id())
    classes = stage_table(classes, "classes")
    reps = full.join(classes, "digest").where(F.col("doc_id") == F.col("low")).dropDuplicates(["digest"])
    reps = stage_table(reps.select("node", "low", "digest", F.col("n_shingles").alias("n"), "marks", "left", "right"), "nodes")
    marks = reps.select("node", "n", "marks")
    keys = reps.select("node", F.explode("left").alias("l"), "right").select("node", "l", F.explode("right").alias("r")).select(F.xxhash64("l", "r").alias("key"), "node")
    buckets = stage_table(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    hits = stage_table(keys.join(buckets, "key"), "hits")
    support = hits.groupBy("node").agg(F.sum("size").alias("support"))
    hubs, stars = _stars(hits.join(support, "node"))
    stars = stage_table(_plausible(stars, marks), "stars")
    # Texts move once: whoever may be confirmed later is a star's end or shares a bucket with two others.
    need = hits.where("size > 2").select("node").union(stars.select("a")).union(stars.select("b")).distinct()
    need = reps.select("node", "low", "digest").join(need, "node").withColumnRenamed("low", "doc_id")
    wanted = docs.select("doc_id", "text").join(need.hint("merge"), "doc_id").select("node", "digest", "text")
    sets = stage_table(bounded_batches(wanted).mapInPandas(lambda b: _sets(b, size), "node long, shingles array<long>").dropDuplicates(["node"]), "sets")
    links = stage_table(confirmed(stars, sets), "links")
    found = stage_table(connected_components(links), "found")
    members = stage_table(hits.where("size > 2").join(support, "node"), "members")
    left = None
    while True:
        open_ = _open(members, found)
        now = open_.where((F.col("size") > CROWDED) & (F.col("component") != F.col("lead"))).count()
        if not now or left is not None and 2 * now > left:
            break
        left = now
        more = _stars(open_.where((F.col("size") > CROWDED) & (F.col("component") != F.col("lead"))))[1]
        links, found = _linked(links, found, confirmed(stage_table(_plausible(more, marks), "stars"), sets))
    rest = _unresolved(open_, hubs, marks, sets)
    links, found = _linked(links, found, confirmed(rest, sets))
    groups = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lows = groups.groupBy("component").agg(F.min("low").alias("component_id"))
    groups = stage_table(groups.join(lows, "component").select("digest", "component_id"), "groups")
    out = full.select("doc_id", "n_shingles", "digest").join(groups, "digest").drop("digest")
    lone = sketches.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(lone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).select("doc_id", "n_shingles", "component_id", "kept")


def _stars(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, hub): the best supported of each bucket's members(key, node, support); and the pairs (a, b) of it and the others."""
    best = F.max(F.struct("support", (-F.col("node")).alias("id")))
    hubs = stage_table(members.groupBy("key").agg((-best["id"]).alias("hub")), "hubs")
    stars = members.join(hubs, "key").where("hub <> node").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    return hubs, stars


def _linked(links: DataFrame, found: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links with more of them, and their components."""
    more = stage_table(more, "links")
    if more.isEmpty():
        return links, found
    links = links.union(more)
    return links, stage_table(connected_components(links), "found")


def _plausible(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs that sizes and marks allow."""
    side = lambda x: marks.select(F.col("node").alias(x), F.struct("n", "marks").alias(f"m{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_possible("ma", "mb")).select("a", "b")


def _open(members: DataFrame, found: DataFrame) -> DataFrame:
    """(key, node, size, support, component, lead, most, rest) of buckets with several components: its largest, and how many
    members are in it and not."""
    of = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of = stage_table(of, "members")
    each = of.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k"))
    lead = each.groupBy("key").agg(F.max(F.struct("k", "component")).alias("top"), F.sum("k").alias("all"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    lead = lead.select("key", F.col("top.component").alias("lead"), F.col("top.k").alias("most"), (F.col("all") - F.col("top.k")).alias("rest"))
    return stage_table(of.join(lead, "key"), "members")


def _unresolved(open_: DataFrame, hubs: DataFrame, marks: DataFrame, sets: DataFrame) -> DataFrame:
    """Possible pairs that share a bucket, lie in different components and have not been confirmed or refused.

    Small buckets join with themselves. Of crowded ones, members of the leading component need only meet the others;
    both sides are cut into blocks by hash, and two blocks at a time meet in a task, where marks of the whole sets
    bound what two of them can share, without a false refusal.
    """
    members = stage_table(open_.join(hubs, "key").where("hub <> node").join(marks, "node"), "members")
    few = members.where(F.col("size") <= CROWDED)
    a, b = few.alias("x"), few.alias("y")
    near = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & _possible("x", "y")
    pairs = a.join(b, near).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    many = members.where(F.col("size") > CROWDED)
    crowd = sets.join(many.select("node").distinct(), "node", "left_semi")
    marked = bounded_batches(crowd).mapInPandas(_marks, "node long, bits binary")
    split = lambda n, block: F.greatest(F.lit(1), F.ceil(n / block)).cast("int")
    many = many.join(stage_table(marked, "bits"), "node")
    many = many.withColumn("ma", split(F.col("most"), LEAD)).withColumn("mb", split(F.col("rest"), BLOCK)).withColumn("h", F.xxhash64("node"))
    major = F.col("component") == F.col("lead")
    none = F.lit(-1)
    to_all = F.transform(F.sequence(F.lit(0), F.col("mb") - 1), lambda b: F.struct(b.alias("i"), F.pmod("h", "ma").cast("int").alias("j"), F.lit(True).alias("led")))
    own = F.pmod("h", "mb").cast("int")
    meet = F.transform(F.sequence(F.lit(0), F.col("ma") - 1), lambda a: F.struct(own.alias("i"), a.alias("j"), F.lit(True).alias("led")))
    rest = F.transform(F.sequence(F.lit(0), F.col("mb") - 1), lambda b: F.struct(F.least(own, b).alias("i"), F.greatest(own, b).alias("j"), F.lit(False).alias("led")))
    many = many.select("key", "node", "component", "n", "bits", F.when(major, none).otherwise(own).alias("own"), F.explode(F.when(major, to_all).otherwise(F.concat(meet, rest))).alias("g"))
    crossed = many.groupBy("key", "g").applyInPandas(_block_pairs, "a long, b long")
    return stage_table(pairs.union(crossed).distinct(), "rest")
