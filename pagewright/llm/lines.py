"""Operator 3: line dedup by a log-template tree, in DataFrame functions only.

A line's tokens with a digit are variable fields. The fixed-depth path of a line is its token count and its first
DEPTH tokens. In a leaf the commonest sequence leads, and sequences that differ from it in at most VARIABLE of their
tokens take its template, those tokens being variable fields; of the others the commonest leads next, until the leaf
is exhausted. Templates in MIN_DOCS or more documents recur: the first occurrence stays, the others are dropped.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, last_table, stage_table

DEPTH = 3  # a line of fewer tokens is a path as a whole and matches exactly after masking
VARIABLE = 0.3
MIN_DOCS = 10
GROWTH, WIDEST = 16, 4096  # of the open sequences of a stretch that are compared in a round: pairs grow with the square
TOKEN = r"[^\x20\x09-\x0D]"
FIELD = "<*>"


def template_lines(docs: DataFrame) -> DataFrame:
    """(_key, doc_id, line, n, leaf, seq, masked) of the lines of whole texts that have tokens: the token count, 64-bit
    hashes of the path and the sequence, and the masked line. Lines are masked inside the array of a text, before it
    is unfolded, so that no later filter computes them again."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spaced, mixed = r"[\x20\x09-\x0D]+", r"[\x09-\x0D]|\x20\x20|^\x20|\x20$"
    even = F.transform(F.split(text, "\n"), lambda x: F.when(x.rlike(mixed), F.btrim(F.regexp_replace(x, spaced, " "), F.lit(WS))).otherwise(x))
    masked = F.transform(even, lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(x, rf"(?<!{TOKEN}){TOKEN}*?[0-9]{TOKEN}*", F.lit(FIELD))).otherwise(x))
    lines = docs.select(F.xxhash64(F.col("doc_id"), text).alias("_key"), "doc_id", F.posexplode(masked).alias("line", "masked")).where("masked <> ''")
    n = F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    lines = lines.withColumn("n", n)
    return lines.select("_key", "doc_id", "line", "n", F.xxhash64("n", F.substring_index("masked", " ", DEPTH)).alias("leaf"), F.xxhash64("masked").alias("seq"), "masked")


def _follows(n: str, a: str, b: str) -> Column:
    """At most VARIABLE of a line's n tokens differ; those of the path are equal."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    return apart <= F.floor(F.col(n) * VARIABLE + 1e-9)


def _stretches() -> Column:
    """One hash more than tokens may differ, each of an even stretch of `rest`: sequences that follow one another have
    at least one stretch in common."""
    m, parts = F.size("rest"), F.floor(F.col("n") * VARIABLE + 1e-9).cast("int") + 1
    cut = lambda j: F.floor(m * j / parts).cast("int")
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.xxhash64("leaf", j, F.slice("rest", cut(j) + 1, cut(j + 1) - cut(j))))


def _agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of pairs(leaf, seq, lead) whose sequences agree; their texts are fetched here, not carried along."""
    met = pairs.distinct().join(nodes.select("leaf", "seq", "n", "rest").hint("merge"), ["leaf", "seq"])
    lead = nodes.where("best is null").select("leaf", F.struct("k", "seq").alias("lead"), F.col("rest").alias("_rest"))
    return met.join(lead.hint("merge"), ["leaf", "lead"]).where(_follows("n", "rest", "_rest"))


def sequence_templates(kinds: DataFrame, min_docs: int) -> DataFrame:
    """(leaf, seq, k, template) of kinds(leaf, seq, k, n, rest), for sequences whose template may have min_docs lines.

    As if a leaf's sequences came one by one, by falling (k, seq), and each followed the first leader it agrees with
    or became one. The first leader is that of the whole leaf. Further leaders are found side by side. Sequences without
    a leader are open; the first `width` open ones of a stretch are compared with one another, and a sequence that is
    among them in each of its stretches, which hold all it can agree with, leads if it agrees with no earlier one. The
    width grows from 1, where large groups find their leader without any pair, so that unlike sequences of one stretch
    take few rounds: each round costs the driver plans and stages. A follower waits while an earlier open sequence of
    its stretches may lead. Joins are merge joins, as the size of a file says little about its rows once they are unfolded.
    """
    first = stage_table(kinds.groupBy("leaf").agg(F.max(F.struct("k", "seq", "rest")).alias("lead")), "leaders")
    of = stage_table(kinds.join(first.hint("merge"), "leaf").withColumn("_hit", _follows("n", "rest", "lead.rest")), "sequences")
    done = [of.where("_hit").select("leaf", "seq", "k", F.col("lead.seq").alias("template"))]
    more = of.where("not _hit")
    enough = more.groupBy("leaf").agg(F.sum("k").alias("all")).where(F.col("all") >= min_docs).select("leaf")
    none = F.lit(None).cast("struct<k:bigint,seq:bigint>")
    nodes = stage_table(more.join(enough.hint("merge"), "leaf").select("leaf", "seq", "k", "n", "rest", _stretches().alias("parts"), none.alias("best")), "sequences")
    me, width = F.struct("k", "seq"), 1
    while not nodes.isEmpty():
        each = nodes.select("leaf", "seq", me.alias("me"), "best", F.explode("parts").alias("part"))
        ahead = _ahead(each, width).groupBy("part").agg(F.max("me").alias("top"), F.min("me").alias("low"))
        hope = each.select("leaf", "seq", "part").join(ahead.hint("merge"), "part").groupBy("leaf", "seq").agg(F.max("top").alias("hope"), F.max("low").alias("low"))
        nodes = nodes.join(hope.hint("merge"), ["leaf", "seq"], "left")
        nodes = stage_table(nodes.withColumn("leads", F.coalesce(F.col("best").isNull() & (me >= F.col("low")), F.lit(False))).drop("low"), "sequences")
        if width > 1:
            ahead = _ahead(nodes.select("leaf", "seq", me.alias("me"), "best", "leads", F.explode("parts").alias("part")), width)
            pairs = ahead.where("leads").select("leaf", "seq", "me", "part").join(ahead.select(F.col("me").alias("lead"), "part").hint("merge"), "part").where("lead > me")
            later = _agreeing(pairs.select("leaf", "seq", "lead"), nodes).select("leaf", "seq").distinct().withColumn("later", F.lit(True))
            nodes = nodes.join(later.hint("merge"), ["leaf", "seq"], "left").withColumn("leads", F.col("leads") & F.col("later").isNull())
            nodes = stage_table(nodes.drop("later"), "sequences")
        settled = F.col("best").isNotNull() & F.coalesce(F.col("best") >= F.col("hope"), F.lit(True))
        done.append(nodes.where(F.col("leads") | settled).select("leaf", "seq", "k", F.coalesce("best.seq", "seq").alias("template")))
        left = nodes.where(~(F.col("leads") | settled))
        by_part = nodes.where("leads").select("leaf", me.alias("lead"), F.explode("parts").alias("part"))
        pairs = left.select("leaf", "seq", F.explode("parts").alias("part")).join(by_part.hint("merge"), ["leaf", "part"])
        found = _agreeing(pairs.select("leaf", "seq", "lead"), nodes).groupBy("leaf", "seq").agg(F.max("lead").alias("found"))
        left = left.drop("hope", "leads").join(found.hint("merge"), ["leaf", "seq"], "left")
        nodes = stage_table(left.withColumn("best", F.greatest("best", "found")).drop("found"), "sequences")
        width = min(width * GROWTH, WIDEST)
    return functools.reduce(DataFrame.unionByName, done)


def _ahead(each: DataFrame, width: int) -> DataFrame:
    """The first `width` open sequences of each stretch."""
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("me")))
    return each.where("best is null").withColumn("place", place).where(F.col("place") <= width).drop("best", "place")


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(_key, doc_id, line, template) of the occurrences to drop."""
    lines = stage_table(template_lines(docs), "lines")
    often = stage_table(lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= min_docs).select("leaf"), "leaves")
    # Text is written once and only that of leaves with enough lines moves, once a sequence.
    kinds = lines.join(often, "leaf").groupBy("leaf", "seq").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n"), F.min("masked").alias("masked"))
    kinds = stage_table(kinds.select("leaf", "seq", "k", "n", F.slice(F.split("masked", " "), DEPTH + 1, F.col("n")).alias("rest")), "sequences")
    lines = stage_table(lines.drop("masked").join(often, "leaf"), "lines")
    of = stage_table(sequence_templates(kinds, min_docs), "templates")
    often = of.groupBy("leaf", "template").agg(F.sum("k").alias("k")).where(F.col("k") >= min_docs).drop("k")
    of = stage_table(of.drop("k").join(often, ["leaf", "template"]), "templates")
    marked = stage_table(lines.select("_key", "doc_id", "line", "leaf", "seq").join(of, ["leaf", "seq"]), "marked")
    once = marked.groupBy("leaf", "template", "_key").agg(F.min(F.struct("doc_id", "line", "_key")).alias("first"))
    found = once.groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("docs"), F.min("first").alias("first")).where(F.col("docs") >= min_docs)
    hit = marked.join(stage_table(found.select("leaf", "template", "first"), "recurring"), ["leaf", "template"])
    return hit.where((F.col("first._key") != F.col("_key")) | (F.col("first.line") != F.col("line"))).select("_key", "doc_id", "line", "template")


def _places() -> Column:
    """Whether each line up to the last dropped one is dropped, by its number: looked up at once, however many there are."""
    at = F.col("lines")
    before = F.concat(F.array(F.lit(-1)), F.slice(at, F.lit(1), F.size(at) - 1))
    return F.flatten(F.zip_with(at, before, lambda x, y: F.concat(F.array_repeat(F.lit(False), x - y - 1), F.array(F.lit(True)))))


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of documents(doc_id, text, ...) with the text less its dropped lines, n_lines and n_dropped.

    Null text stays null and has no lines; blank lines stay. The first occurrence is that of the smallest doc_id (null
    first) and line number; fully equal rows count as one document and get equal results. n_lines and n_dropped replace
    columns of the same names; other columns of any name pass through.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    lines = lambda: recurring_lines(docs, min_docs).groupBy("_key").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    drops = last_table(docs.sparkSession, lambda: lines().select("_key", F.size("lines").alias("n"), _places().alias("gone")), "drops")
    key = F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), key.alias("_key"))
    out = rows.join(drops.hint("merge"), "_key", "left")  # drops grow with the corpus: never broadcast
    text = F.col("doc")["text"]
    left = F.filter(F.split(text, "\n"), lambda x, i: ~F.coalesce(F.get("gone", i), F.lit(False)))
    count = F.when(text.isNull(), 0).otherwise(F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    kept = F.when(F.col("gone").isNotNull(), F.array_join(left, "\n")).otherwise(text)
    columns = [(kept if c == "text" else F.col("doc").getField(c)).alias(c) for c in names]
    return out.select(*columns, count.cast("long").alias("n_lines"), F.coalesce("n", F.lit(0)).cast("long").alias("n_dropped"))
