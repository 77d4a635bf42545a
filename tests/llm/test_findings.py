"""One small test for each finding on larger tables."""

import random
import string

import pandas as pd
from pyspark.sql import functions as F

from pagewright.llm import lines, suffix

DIGITS = str.maketrans(string.digits, "ABCDEFGHIJ")


def test_unfolded_lines_are_not_broadcast(spark, monkeypatch):
    """Long unlike lines of one leaf: their files are small, their texts once for each stretch are not."""
    rng, plans = random.Random(5), []
    rows = [(i, "a b c " + " ".join(rng.choice("pqrstuvw") for _ in range(40))) for i in range(24)]
    stage = lines.stage_table
    monkeypatch.setattr(lines, "stage_table", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stage(df, name))
    masked = lines.template_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    kinds = stage(masked.select("leaf", "seq", F.lit(1).cast("long").alias("k"), "n", F.slice(F.split("masked", " "), lines.DEPTH + 1, F.col("n")).alias("rest")), "kinds")
    assert lines.sequence_templates(kinds, 2).count() == 24
    assert len(plans) > 4 and not any("BroadcastHashJoin" in p for p in plans)


def test_chunks_are_packed_across_batches(monkeypatch):
    """A chunk has a row in most buckets; chunks of single batches made four times as many."""
    monkeypatch.setattr(suffix, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": lambda self: 3})())}))
    texts = [None if k % 50 == 0 else f"{k} " + "ab" * (k % 900) for k in range(9500)]
    rows = pd.DataFrame({"doc_id": range(9500), "text": texts, "extra": [str(k) for k in range(9500)]})
    got = pd.concat(list(suffix._chunks(rows[k : k + 1000] for k in range(0, 9500, 1000))))
    assert len(got) == 3 and got["chunk"].tolist() == [(3 << 32) + k for k in range(3)]
    assert [k for x in got["ids"] for k in x] == list(range(9500)) == [int(k) for x in got["extra"] for k in x]
    back = [t.tobytes().decode() for body, sizes in zip(got["body"], got["sizes"], strict=True) for t in suffix._texts(body, sizes)]
    assert back == [t or "" for t in texts]
    assert max(len(x) for x in got["ids"]) <= 4000 < 4096


def test_unlike_lines_of_one_stretch_take_few_rounds(spark, monkeypatch):
    """Forty leaders that share a stretch, with followers: a round for each leader costs the driver plans and stages."""
    rows = [(10 * k + j, f"on this day same {x} {x}a {f'{x}b' if j == 0 else f'{x}b{"pqrst"[j - 1]}'}".translate(DIGITS)) for k in range(40) for j in range(1 + k % 4) for x in [f"w{k}"]]
    tables, stage = [], lines.stage_table
    monkeypatch.setattr(lines, "stage_table", lambda df, name: tables.append(name) or stage(df, name))
    masked = stage(lines.template_lines(spark.createDataFrame(rows, "doc_id long, text string")), "lines")
    kinds = stage(masked.select("leaf", "seq", F.lit(1).cast("long").alias("k"), "n", F.slice(F.split("masked", " "), lines.DEPTH + 1, F.col("n")).alias("rest")), "kinds")
    got = {r.seq: r.template for r in lines.sequence_templates(kinds, 2).collect()}
    text = {r.seq: r.masked.split() for r in masked.collect()}
    leaders, want = [], {}
    for s in sorted(text, reverse=True):
        want[s] = next((x for x in leaders if sum(a != b for a, b in zip(text[s], text[x], strict=True)) <= 2), s)
        leaders += [s] * (want[s] == s)
    assert got == want and len(leaders) == 40 < len(want) == 100
    assert len(tables) <= 16, len(tables)
