"""Findings of round 3: results as the SQL has them, whole documents, fits on all rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from pagewright.operators import models, oracle, run


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    """Rows of a plan in Spark and in DuckDB over documents(doc_id, text)."""

    def rows(name, docs):
        path = str(tmp_path_factory.mktemp("d") / "documents")
        spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(path)
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
        df = run(name, spark.read.parquet(path))
        want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({oracle(name)})").fetchall()
        return sorted(tuple(r) for r in df.collect()), sorted(want)

    return rows


LONG = "\n".join(f"line number {k} of a document that goes on for more than fifty pages" for k in range(450))


def test_word_edges_and_white_space_are_ascii(both):
    got, want = both("clean_block_steps", [(1, "x\nA B Cé\na b c dñ\néA B C x\nÜa b c d z\nq\x0bw e r t")])
    assert got == want and got[1][2] == "ABCé"


def test_titles_begin_with_one_capital(both):
    got, want = both("title_best", [(1709, "ßheit enkeitteä nicht achöber")])
    assert got == want and got[0][1].startswith("ẞheit")


def test_shares_are_rounded_as_in_the_sql(both):
    for name in ("text_semantics", "linguistic_features"):
        got, want = both(name, [(1, "1" * 333 + "a" * 307)])
        assert got == want
    assert any("digit_ratio=520312" in str(x) for x in both("text_semantics", [(1, "1" * 333 + "a" * 307)])[0][0])


@pytest.mark.parametrize("name", ["clean_block_steps", "text_semantics", "comprehensive_features"])
def test_pages_after_the_fiftieth_are_read(both, name):
    got, want = both(name, [(1, LONG)])
    assert len(got) == 450 and [r[:2] for r in got] == [r[:2] for r in want]


def test_lines_of_contents_are_whole(both):
    got, want = both("clean_block_steps", [(1, LONG)])
    assert got == want and got[6][2].startswith("line number 6 of a document that goes on for more than fifty pages ..... 6")


def test_titles_come_from_whole_documents(both):
    text = "\n".join(["x"] * 423 + ["Title: the annual report of all"])
    got, want = both("title_best", [(2, text)])
    assert got == want and got[0][1] == "The annual report of all"


MIXED = "\n".join([" ".join(f"w{k}" for k in range(900)), " ".join(["donaudampfschifffahrt", "a", "straßenbahnhaltestelle é"] * 9), "one", " ".join(["xy"] * 700)])


@pytest.mark.parametrize("name", ["char_lines", "char_spacing"])
def test_lines_of_characters_without_a_row_a_character(both, spark, name):
    """Words that reach into the next, and long blocks that run into those below."""
    got, want = both(name, [(5, MIXED), (6, LONG)])
    assert got == want and max(r[1] for r in got) == (56 if name == "char_lines" else 49)
    plan = run(name, spark.createDataFrame([(5, MIXED)], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1


def test_clusters_of_whole_documents(spark):
    docs = spark.createDataFrame([(1, LONG), (2, "One\nTwo words\nthree")], "doc_id long, text string")
    found = models.font_clusters(docs).toPandas()
    assert found.groupby("doc_id").size().to_dict() == {1: 450, 2: 3}
    profiles = models.cluster_profiles(models.whole_scan(docs), models.font_clusters(docs))
    assert sum(r.size for r in profiles.collect()) == 453
    assert sum(r.total_clusters for r in models.cluster_statistics(profiles).collect()) == profiles.count()


def test_clusters_do_not_depend_on_batches(spark):
    """Documents are clustered together with others of their size, and a batch may end inside one."""
    docs = spark.createDataFrame([(i, "\n".join(LONG.split("\n")[i : i + 4 + i % 3])) for i in range(40)], "doc_id long, text string")
    x = models.font_clusters(docs).toPandas().sort_values(["doc_id", "seq"]).reset_index(drop=True)
    alone = models.font_clusters(docs.where("doc_id = 17")).toPandas().sort_values("seq").reset_index(drop=True)
    assert x[x.doc_id == 17].reset_index(drop=True).equals(alone) and x.groupby("doc_id").size().sum() == sum(4 + i % 3 for i in range(40))
    rows = models.whole_scan(docs).selectExpr("doc_id", "seq", "font_size", "cast(is_bold AS int) is_bold", "cast(is_italic AS int) is_italic", "y0", "y1 - y0 AS height", "length(text) AS chars", "size(split(text, ' ')) AS words").toPandas().sort_values(["doc_id", "seq"]).reset_index(drop=True)
    cut = lambda n: [p.reset_index(drop=True) for p in (rows.iloc[i : i + n] for i in range(0, len(rows), n))]
    whole, parts = (list(models._cluster_batches(iter(cut(n)))) for n in (1000, 3))
    assert sum(map(len, parts)) == len(rows) and sum((p[["cluster_id", "label"]].values.tolist() for p in parts), []) == sum((p[["cluster_id", "label"]].values.tolist() for p in whole), [])


def test_fits_are_on_all_rows(spark, monkeypatch):
    """The models of all folds together see four times the 30,000 rows, those of a grid, too."""
    n = 30_000
    noise = [f"rand({k}) AS {f}" for k, f in enumerate(models.FEATURES[1:])]
    rows = spark.range(n).selectExpr("id AS doc_id", "0 AS seq", "cast(id % 2 AS double) AS label", "id % 2 + 2 * rand(99) AS font_size_ratio", *noise).cache()
    seen = []
    real = models.sample
    monkeypatch.setattr(models, "sample", lambda x, *limit: (y := real(x, *limit), seen.append(y.count()))[0])
    models.cross_validate(rows).collect()
    models.grid_search(rows, "logistic", [{"regParam": 0.1}]).collect()
    models.train(rows, "logistic")
    assert sum(seen[:5]) == 4 * n and sum(seen[5:15]) == 8 * n and seen[15] == n


def test_repeated_substrings_are_found_without_trying_every_length(spark):
    import re
    import time

    from pagewright.operators.extras import clean_block, repeated

    texts = ["one two three " * 3, "abcdefgh" * 2, "abcdefgh" * 3, "x" + "abcdefghij" * 3 + "y", "ab" * 40, "a quick brown fox " * 2 + "a quick", "", "the cat and the cat and the cat and then"]
    assert [repeated(t) for t in texts] == [bool(re.search(r"(.{8,})\1\1", t)) for t in texts]
    long = " ".join(str(k * 7919 % 100_003) for k in range(20_000))
    at = time.perf_counter()
    assert not repeated(long) and time.perf_counter() - at < 5
    got = [r.c for r in spark.createDataFrame([("zone one two, one two, one two, y",), (None,)], "t string").select(clean_block(F.col("t")).alias("c")).collect()]
    assert got == ["zone one two, y", None]


def test_pages_are_cut_where_batches_end(spark):
    from pagewright.operators.extras import _longest, process_pages

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        docs = spark.createDataFrame([(i, "\n".join(f"line {k} {'x' * (k * 7 % 11)}" for k in range(30))) for i in range(6)], "doc_id long, text string")
        blocks = run("block_scan", docs)
        got = sorted(map(tuple, process_pages(blocks, _longest, "doc_id long, page int, seq int, text string").collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    best = {}
    for r in blocks.orderBy("doc_id", "seq").collect():
        if len(r.text) > len(best.get((r.doc_id, r.page), (0, ""))[1]):
            best[r.doc_id, r.page] = (r.seq, r.text)
    assert got == sorted((d, p, *x) for (d, p), x in best.items())
