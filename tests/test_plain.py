"""Plans against plain Python on all documents of the smallest table, and literal documents with answers worked out by hand."""

from collections import defaultdict

import plain
import pytest

from pagewright.functions.dialect import SPARK
from pagewright.operators import run, run_on_blocks
from pagewright.plans.analysis import char_groups, clean_title

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, seq int, page int, text string, font_size double, is_bold boolean, is_italic boolean, x0 double, y0 double, x1 double, y1 double"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def scanned(docs):
    out = defaultdict(list)
    for r in run("block_scan", docs).collect():
        out[r.doc_id].append(r.asDict())
    return out


def blocks(spark, rows, doc=7):
    """rows: (text, size, bold, page[, y]), one document."""
    made = [(doc, i, r[3], r[0], float(r[1]), r[2], False, 72.0, float(r[4] if len(r) > 4 else 80 * i), 300.0, float((r[4] if len(r) > 4 else 80 * i) + r[1])) for i, r in enumerate(rows)]
    return spark.createDataFrame(made, SCHEMA)


def test_outlines(docs, scanned):
    heads = defaultdict(list)
    for r in run("outline_headings", docs).collect():
        heads[r.doc_id].append((r.pos, r.level, r.text, r.page))
    result = {r.doc_id: r for r in run("result_document", docs).collect()}
    want = {i: x for i, b in scanned.items() if (x := plain.outline(b))}
    assert set(result) == set(want) and sum(len(x[0]) for x in want.values()) > 300
    for i, (outline, title, lang, n) in want.items():
        assert sorted(heads[i]) == outline, i
        assert (result[i].title, result[i].detected_language, result[i].total_blocks_analyzed) == (title, lang, n), i
        assert result[i].outline == "; ".join(f"{level}|{text}|{page}" for _, level, text, page in outline)


def test_rules(docs, scanned):
    got = defaultdict(dict)
    for r in run("rule_scores", docs).collect():
        got[r.doc_id][r.seq] = (r.font_score, r.style_score, r.position_score, r.pattern_score, r.context_score)
    for i, b in scanned.items():
        if any(x["text"].strip(" ") for x in b):
            want = plain.rules(b)
            assert got[i].keys() == want.keys()
            assert all(got[i][k] == pytest.approx(want[k], abs=2e-6) for k in want), i


def test_no_table_of_patterns_is_idle(docs):
    for name in ("domain_shares", "section_headings", "page_number_patterns", "repeated_elements", "header_footer_groups"):
        assert run(name, docs).count() > (1 if name == "repeated_elements" else 5), name
    assert run("domain_scores", docs).where("max_domain_score > 0").count() > 10
    assert run("language_confidence", docs).select("language", "confidence").distinct().count() > 3
    assert run("header_footer_filter", docs).count() < run("block_scan", docs).count()
    assert run("title_candidates", docs).where("source = 'pattern_match'").count() > 3
    assert run("input_validation", docs).select("valid").distinct().count() == run("result_validation", docs).select("valid").distinct().count() == 2


def test_ranked_titles_are_tidy(spark):
    texts = ["title:  the   small  report.PDF", "word " * 30, "x" * 120, "Title: ", "Plain", "ends.docx"]
    got = [r.c for r in spark.createDataFrame(list(enumerate(texts)), "i int, text string").selectExpr("i", f"{clean_title('text', SPARK)} AS c").orderBy("i").collect()]
    assert got == [plain.tidy_title(t) for t in texts] and got[0] == "The small report" and got[1].endswith("word...")


def test_levels_and_parents(spark):
    """Levels 1,3,3,1,2,3,3,2 become 1,2,2,1,2,3,3,2: each at most one below the heading before."""
    text = {1: lambda k: (f"Great Part Number {k}X", 30, True), 2: lambda k: (f"{k}. Gamma Delta {k}X Works", 10, True), 3: lambda k: (f"{k}.1 Alpha Beta {k}X", 10, True)}
    rows = [(*text[n](k + 1), 0) for k, n in enumerate((1, 3, 3, 1, 2, 3, 3, 2))] + [("plain body text that no rule takes for a heading at all, number " + w, 10, False, 0) for w in ("one", "two", "three", "four", "five", "six")]
    df = blocks(spark, rows)
    got = run_on_blocks("hierarchy_repair", df).orderBy("pos").collect()
    assert [r.original_level for r in got] == ["H1", "H3", "H3", "H1", "H2", "H3", "H3", "H2"]
    assert [r.level for r in got] == ["H1", "H2", "H3", "H1", "H2", "H3", "H3", "H2"]
    assert [r.parent for r in run_on_blocks("parent_headings", df).orderBy("pos").collect()] == [None, 1, 2, None, 4, 5, 5, 4]
    s = run_on_blocks("hierarchy_statistics", df).first()
    assert (s.total_headings, s.level_adjustments, s.gaps_fixed) == (8, 1, 1)
    assert [r.pos for r in run_on_blocks("hierarchy_context", df).orderBy("pos").collect()] == [4, 8]


def test_titles(spark):
    rfp = "RFP Request for Proposal to build the new city library system"
    assert run_on_blocks("document_title", blocks(spark, [(rfp, 12, False, 0), ("Big Banner Title Here", 30, True, 0)])).first().title == rfp
    assert run_on_blocks("document_title", blocks(spark, [("tiny", 8, False, 0), ("Other words on page two here", 20, True, 1)])).first().title == "doc7"
    same = blocks(spark, [("First overview of two", 20, True, 0, 10), ("Second overview of two", 20, True, 0, 10)])
    assert run_on_blocks("document_title", same).first().title == "First overview of two"
    assert [r.text for r in run_on_blocks("outline_headings", same).orderBy("pos").collect()] == ["First overview of two", "Second overview of two"]


def test_characters_chain_to_lines(spark):
    spark.createDataFrame([(1, 0, k, 0, 0, c, 10.0, float(k), float(k) + 0.5, top, "Arial") for k, (c, top) in enumerate(zip("abcd", (10.0, 11.5, 13.0, 20.0), strict=True))], "doc_id long, page int, seq int, pos int, k int, text string, size double, cx0 double, cx1 double, top double, fontname string").createOrReplaceTempView("chars")
    got = spark.sql(f"WITH {char_groups(SPARK)} SELECT text, line_id FROM grouped ORDER BY seq").collect()
    assert [r.line_id for r in got] == [0, 0, 0, 1]


def test_similar_headings_and_merged_ones(spark):
    df = blocks(spark, [("Data Sources Overview", 20, True, 0), ("Overview Data Sources", 20, True, 0), ("plain body words that are not a heading at all here", 10, False, 0), ("more body words, too, and no heading either, to be sure", 10, False, 0)])
    assert run_on_blocks("similarity_dedup", df).first().kept == "data sources overview"
    assert run_on_blocks("merge_consecutive", df).first().texts.startswith("Data Sources Overview Overview Data Sources")


def test_headers_and_footers(spark):
    rows = [x for p in range(5) for x in ((f"Confidential paper {p}", 9, False, p, 10), (f"Unique text of page {'abcde'[p] * 5} that goes on for quite a few words and is content", 10, False, p, 300), (f"Another {'vwxyz'[p] * 6} line of body, which is content: the words of it", 10, False, p, 500), ("Page 1", 9, False, p, 790))]
    got = {(r.kind, r.text_pattern, r.n_pages) for r in run_on_blocks("header_footer_groups", blocks(spark, rows)).collect()}
    assert ("footer", "page 1", 5) in got
    left = [r.text for r in run_on_blocks("header_footer_filter", blocks(spark, rows)).collect()]
    assert "Page 1" not in left and sum("content" in t for t in left) == 10


def test_blocks_that_nearly_coincide(spark):
    """The second block finds the first as itself, so its neighbour is that of the first."""
    df = blocks(spark, [("Head", 20, True, 0, 10), ("Twin one", 12, False, 0, 100), ("Twin two", 14, False, 0, 100.5), ("Last", 10, False, 0, 200)])
    at = {r.seq: (r.index_within_5, r.index_within_1, r.index_by_text) for r in run_on_blocks("block_lookup", df).collect()}
    assert at == {0: (0, 0, 0), 1: (1, 1, 1), 2: (1, 1, 2), 3: (3, 3, 3)}
    got = {r.seq: r for r in run_on_blocks("context_features", df).collect()}
    assert got[2].prev_diff == 14 - 20 and got[2].whitespace_before == 100.5 - 30 and got[2].next_diff == 14 - 14


@pytest.mark.parametrize("rows", [[("Only One Block Here", 14, True, 0)], [(f"Equal size line {w}", 12, False, 0) for w in "abc"], [(f"No size line {w}", 0, True, 0) for w in "abc"]])
def test_degenerate_documents(spark, rows):
    df = blocks(spark, rows)
    want = plain.outline([r.asDict() for r in df.collect()])
    assert [(r.pos, r.level, r.text, r.page) for r in run_on_blocks("outline_headings", df).orderBy("pos").collect()] == want[0]
    assert run_on_blocks("document_title", df).first().title == want[1]
    for name in ("comprehensive_features", "ml_features", "rule_combined", "title_best", "font_percentiles"):
        assert run_on_blocks(name, df).count() > 0, name
    if rows[0][1] == 0:
        assert run_on_blocks("font_statistics", df).first().avg_font_size == 12


def test_feature_rows_have_all_columns(docs):
    assert len(run("comprehensive_features", docs).columns) == 94 + 2 and len(run("ml_features", docs).columns) == 35 + 2


def test_term_weights(spark):
    df = blocks(spark, [("alpha beta gamma", 10, False, 0), ("alpha beta delta", 10, False, 0), ("epsilon words here", 10, False, 0)])
    got = {(r.seq, r.term): r.weight for r in run_on_blocks("tfidf_weights", df).collect()}
    assert {t for _, t in got} == {"alpha", "beta", "alpha beta"} and all(abs(w - 3**-0.5) < 1e-6 for w in got.values())
    assert abs(run_on_blocks("tfidf_terms", df).first().idf - plain.idf(3, 2)) < 1e-6
