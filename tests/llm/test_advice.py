"""One test for each place where an operator did less than the whole job."""

import random

import corpus_pipeline
import xxhash

from pagewright.llm.language import PIECE, Model, identify, identify_documents, pieces, runs
from pagewright.llm.lines import VARIABLE, drop_recurring_lines
from pagewright.llm.near import near_duplicates

RNG = random.Random(23)
LETTERS = "abcdefghijklmnoprstuvw"
NAMES = sorted({"".join(RNG.choice(LETTERS) for _ in range(6)) for _ in range(900)})


def prose(n):
    return " ".join(RNG.choice(NAMES) for _ in range(n))


def lines_of(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return {r.doc_id: r.n_dropped for r in drop_recurring_lines(df).collect()}


def test_lines_a_leaf_has_several_templates(spark):
    lines = ["Thanks for visiting our page today dear friend"] * 20 + [f"Thanks for visiting {n} , see you soon" for n in NAMES[:40]]
    lines += [f"We are {a} open on all the days of this very {b} week for {c} guests" for a, b, c in zip(NAMES[50:80], NAMES[100:130], NAMES[150:180], strict=True)]
    got = lines_of(spark, lines)
    assert sum(got[k] for k in range(20)) == 19 and sum(got[k] for k in range(20, 60)) == 39
    # The path holds the first variable word, so those lines lie in leaves of their own.
    assert not any(got[k] for k in range(60, 90))


def test_lines_compare_token_by_token(spark):
    # 13 of 16 tokens are equal; the 3 others lie in different eighths of the line.
    got = lines_of(spark, [f"one two three four {a} six seven eight {b} ten eleven twelve {c} x y z" for a, b, c in zip(NAMES[:30], NAMES[30:60], NAMES[60:90], strict=True)])
    assert sum(got.values()) == 29


def test_lines_equal_leaders_one_by_one(spark):
    """Against the rule carried out one sequence at a time, on a leaf of many overlapping templates."""
    rng = random.Random(4)
    lines = []
    for n in (10,):
        base = [["a", "b", "c", *(rng.choice("xyzuvw") for _ in range(n - 3))] for _ in range(3)]
        for _ in range(150):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(3, n)] = rng.choice("xyzuvwpqrst")
            lines.append(" ".join(w))
    gone = set()
    for n in (10,):
        where = [(k, tuple(x.split())) for k, x in enumerate(lines) if len(x.split()) == n]
        count = {}
        for _, s in where:
            count[s] = count.get(s, 0) + 1
        # Sequences of equal counts come in the order of their hashes.
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        hashes = {s: signed(xxhash.xxh64_intdigest(" ".join(s), seed=42)) for s in count}
        leaders, of = [], {}
        for s in sorted(count, key=lambda s: (-count[s], -hashes[s])):
            of[s] = next((x for x in leaders if sum(a != b for a, b in zip(s, x, strict=True)) <= int(n * VARIABLE + 1e-9)), s)
            if of[s] == s:
                leaders.append(s)
        places = {}
        for k, s in where:
            places.setdefault(of[s], []).append(k)
        gone |= {k for p in places.values() if len(p) >= 10 for k in p[1:]}
    got = lines_of(spark, lines)
    assert {k for k, n in got.items() if n} == gone and 15 < len(gone) < len(lines) - 10, (len(gone), len({k for k, n in got.items() if n} ^ gone))


def test_lines_two_families_in_a_leaf(spark):
    """All counts are ties: each family has a leader of its own and all but its first line go."""
    lines = [x for a, b in zip(NAMES[:12], NAMES[20:32], strict=True) for x in (f"Posted by user {a} in the forum today", f"Posted by user {b} from a phone yesterday")]
    got = lines_of(spark, lines)
    assert sum(got.values()) == 22 and got[0] == got[1] == 0


def test_lines_many_dropped_in_one_text(spark):
    """The places of dropped lines in a long text, against the rule."""
    own = [f"{NAMES[k]} {NAMES[k + 1]}" for k in range(300)]
    long = [x for k in range(2000) for x in ("Read more here", own[k % 300] if k < 300 else "")]
    texts = ["\n".join(long)] + [f"Read more here\n{NAMES[500 + k]}" for k in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in drop_recurring_lines(df).collect()}
    assert got[0].text == "\n".join(["Read more here", *[x for x in long[1:] if x != "Read more here"]]) and (got[0].n_lines, got[0].n_dropped) == (4000, 1999)
    assert all(got[k].text == NAMES[499 + k] for k in range(1, 13))


def test_lines_of_one_and_two_tokens(spark):
    got = lines_of(spark, [f"Advertisement\n\n{NAMES[k]}\nPage {k}\nRead {NAMES[k]}" for k in range(20)])
    assert sorted(got.values()) == [0] + [2] * 19 and got[0] == 0


def test_language_scores_every_letter_of_a_long_run(spark):
    a, b = ["thand", "there", "worth"], ["çãodor", "ñaque", "lleía"]
    model = Model.of_words([("xx", w, 5) for w in a] + [("yy", w, 5) for w in b])
    run = "".join(RNG.choice(a) for _ in range(26)) + "".join(RNG.choice(b) for _ in range(120))
    got = identify(spark.createDataFrame([(1, run)], "doc_id long, text string"), model).first()
    assert got.lang_pred == "yy" and [x.lang for x in got.spans] == ["xx", "yy"]


def test_language_learns_from_long_runs(spark):
    rows = [(k, "".join(RNG.choice(("thand", "there")) for _ in range(40)) if k % 2 else " ".join(RNG.choice(("dor", "que")) for _ in range(40)), "xx" if k % 2 else "yy") for k in range(60)]
    got = {r.doc_id: r.lang_pred for r in identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[k] == ("xx" if k % 2 else "yy") for k in range(60))


def test_language_pieces_hold_every_letter():
    for t in ["latinкириллица漢字かな" + "字" * 150 + "abc한글", "a" * 200, "plain words", "x1y" * 50, ""]:
        cut = [p for some in runs(t) for r in some for p in pieces(r)]
        assert "".join(cut) == "".join(c for c in t if c.isalpha()) and all(len(p) <= PIECE for p in cut)


def test_language_knows_as_many_languages_as_there_are(spark):
    """300 labels: none is dropped, and the label of a held-out text is one of them."""
    words = {k: [f"{a}{b}" for a in (NAMES[3 * k][:3], NAMES[3 * k + 1][:3]) for b in ("ab", "cd", "ef")] for k in range(300)}
    rows = [(300 * j + k, " ".join(RNG.choice(words[k]) for _ in range(30)), f"l{k}") for k in range(300) for j in range(6)]
    got = identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len({r.lang_pred for r in got}) > 290 and sum(r.lang_pred == f"l{r.doc_id % 300}" for r in got) > 0.9 * len(got)


def test_language_long_text_among_short_ones(spark):
    a, b = ["thand", "there", "worth"], ["çãodor", "ñaque", "lleía"]
    make = lambda words, n: " ".join(RNG.choice(words) for _ in range(n))
    model = Model.of_words([("xx", w, 5) for w in a] + [("yy", w, 5) for w in b])
    rows = [(0, make(a, 5)), (1, make(b, 400_000)), (2, None), (3, make(a, 100_000) + " " + make(b, 150_000)), (4, make(b, 3))]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), model).collect()}
    assert [got[k].lang_pred for k in range(5)] == ["xx", "yy", "und", "yy", "yy"]
    assert [(s.lang, s.n_words) for s in got[3].spans] == [("xx", 100_000), ("yy", 150_000)]


def test_near_stage_takes_five_words(spark):
    base = [NAMES[k] for k in range(200)]
    other = [f"new{k}" if k in (20, 60, 100, 140, 180) else w for k, w in enumerate(base)]  # 0.82 by four words, 0.77 by five
    rows = [(1, " ".join(base), "en", "s", 1), (2, " ".join(other), "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, df, "").collect()) == [1, 2]
    assert {r.component_id for r in near_duplicates(df).collect()} == {1}
