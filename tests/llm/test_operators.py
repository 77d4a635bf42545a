"""The ten operators against brute force, on small fixtures with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brute import line_templates, passages_by_brute_force, shingles

from pagewright.llm.bpe import Bpe, bpe_decode, bpe_encode, round_trip
from pagewright.llm.common import connected_components, numbered
from pagewright.llm.exact import exact_duplicates
from pagewright.llm.language import Model, identify, identify_documents, labels, viterbi
from pagewright.llm import licences
from pagewright.llm.licences import TEMPLATES, LicenceModel, licence_paragraphs, licence_scan
from pagewright.llm.lines import MIN_DOCS, drop_recurring_lines
from pagewright.llm.near import near_duplicates
from pagewright.llm.packing import best_fit_pack, pack_documents, place_classes
from pagewright.llm.quality import ALL, FLOORS, HALF, TAIL, chi2_quantile, consistency, mcd_estimates, robust_quality
from pagewright.llm.sharding import shard_records
from pagewright.llm.suffix import kasai, larsson_sadakane, repeated_passages

#: Extra columns named like results and like inner names of the operators.
EXTRA = ("n_words", "shard", "component_id", "_key", "grp", "x0", "own", "every", "c00", "m1", "_text", "own_text", "doc", "_gone", "_row", "h", "k", "node", "digest", "level", "name", "_chunk", "chunk", "leaf", "seq", "masked", "gram", "words", "length", "_part", "spans", "score")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
BPE = public_tokenizers.path("byte_bpe_50k.json")
RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(400)]
SPACE = b" \t\n\x0b\x0c\r"


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    base = [prose(RNG.randint(20, 120)) for _ in range(60)]
    texts = [None, "", "  \n\t ", "one", "two words", *base, *base[:7], base[0], base[0]]
    for t in base[:20]:  # near copies
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    passage = prose(60)
    texts += [prose(30) + " " + passage + "\n" + prose(20) for _ in range(12)]
    texts += [f"Page {k} of {k + 3} printed for reader {k}\n" + prose(25) for k in range(MIN_DOCS + 3)]
    texts += [prose(4000), "z" * 5000, "é" * 120 + "日本語" * 40, "a \x1c b\x85c d"]
    return list(enumerate(texts))


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", None, "de")[i % 3], ("a", "b")[i % 2], None, *(f"extra {c}" for c in EXTRA)) for i, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(4, "doc_id").cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_every_operator_takes_an_empty_table(empty):
    for out in (robust_quality(empty), round_trip(empty, BPE), drop_recurring_lines(empty), pack_documents(empty, BPE), shard_records(empty), licence_scan(empty), identify_documents(empty), exact_duplicates(empty), near_duplicates(empty), repeated_passages(empty)):
        assert out.count() == 0


def test_quality(docs):
    got = {r.doc_id: r for r in robust_quality(docs).collect()}
    assert len(got) == len(ROWS)
    for i, t in ROWS:
        w = (t or "").encode().translate(bytes.maketrans(SPACE, b" " * 6)).split(b" ")
        w = [x for x in w if x]
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        n = Counter(windows)
        cover = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        r = got[i]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (len(w), len(cover), len(lines) - len(set(lines)))
        assert r.word_chars == sum(len(x.decode()) for x in w)
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w))
        assert r.base_failed <= (not r.kept)
        assert r.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>")
        assert all(r[c] == f"extra {c}" for c in EXTRA if c != "n_words")


def brute_force_mcd(x, floors, half, starts=60):
    """Centre and covariance of the least determinant, from many random starts on the exact subset, reweighted once."""
    rng, best = np.random.default_rng(1), None
    n, d = x.shape
    away = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    for _ in range(starts):
        some = x[rng.choice(n, d + 1, replace=False)]
        m, c, before = some.mean(0), np.cov(some.T, bias=True) + np.diag(floors), np.inf
        while True:
            some = x[np.argsort(away(m, c))[: int(half * n)]]
            m, c = some.mean(0), consistency(half, d) * np.cov(some.T, bias=True) + np.diag(floors)
            if np.linalg.det(c) > before * (1 - 1e-6):
                break
            before = np.linalg.det(c)
        if best is None or before < best[0]:
            best = before, m, c
    some = x[away(*best[1:]) <= chi2_quantile(0.975, d)]
    m, c = some.mean(0), consistency(0.975, d) * np.cov(some.T, bias=True) + np.diag(floors)
    return m, c, away(m, c)


def test_quality_against_brute_force(spark):
    """Correlated features, a fifth of the rows in a tight cluster aside, for which medians alone are no good start."""
    rng = np.random.default_rng(8)
    n = 1500
    x = rng.normal(0, 1, (n, 4)) @ np.array([[0.3, 0.2, 0, 0], [0, 0.2, 0.5, 0], [0, 0, 0.6, 0.2], [0, 0, 0, 0.3]])
    x[: n // 5] = rng.normal(0, 0.05, (n // 5, 4)) + [1.2, -1, 3, 1]
    rows = spark.createDataFrame([("a", *map(float, r)) for r in x], "grp string, x0 double, x1 double, x2 double, x3 double")
    est = {r.grp: r for r in mcd_estimates(rows).collect()}
    m, c, far = brute_force_mcd(x, np.array(FLOORS) ** 2, HALF)
    for grp in ("a", ALL):
        got_m = np.array([est[grp][f"m{i}"] for i in range(4)])
        got_c = np.array([[est[grp][f"c{max(i, j)}{min(i, j)}"] for j in range(4)] for i in range(4)])
        assert est[grp].n == n and np.abs(got_m - m).max() < 0.03 and np.abs(got_c / np.sqrt(np.outer(np.diag(c), np.diag(c))) - c / np.sqrt(np.outer(np.diag(c), np.diag(c)))).max() < 0.06
        d = np.einsum("ij,jk,ik->i", x - got_m, np.linalg.inv(got_c), x - got_m)
        cut = chi2_quantile(1 - TAIL, 4)
        clear = (far < 0.8 * cut) | (far > 1.25 * cut)
        assert ((d <= cut) == (far <= cut))[clear].all() and (d[: n // 5] > cut).all() and (d[n // 5 :] <= cut).mean() > 0.99


def test_quality_moderate_outliers_of_each_feature(spark):
    rng = random.Random(77)
    clean = [prose(120, rng) for _ in range(500)]
    lines = lambda k: "\n".join(["alpha beta gamma"] * (k + 1) + [prose(110, rng)])
    window = " ".join(rng.choice(WORDS) for _ in range(8))
    odd = {"long words": " ".join(w + w for w in prose(120, rng).split()), "symbols": prose(96, rng) + " #%" * 24, "duplicate lines": lines(6), "repeats": " ".join([window, prose(30, rng), window, prose(30, rng), window, prose(10, rng), window])}
    rows = [(k, t, "en", "s") for k, t in enumerate([*clean, *odd.values()])]
    got = [r.kept for r in sorted(robust_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect(), key=lambda r: r.doc_id)]
    assert sum(got[:500]) >= 498 and not any(got[500:]), dict(zip(odd, got[500:], strict=True))


def test_quality_small_groups_lean_on_all_rows(spark):
    rows = [(k, prose(80), "en", "s") for k in range(400)] + [(1000 + k, prose(80), "en", f"small{k}") for k in range(5)] + [(2000 + k, " ".join(f"{w}%%%###" for w in prose(80).split()), "xx", f"odd{k}") for k in range(5)]
    got = {r.doc_id: r.kept for r in robust_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[1000 + k] for k in range(5)) and not any(got[2000 + k] for k in range(5))


def test_quality_rejects_outliers(spark):
    rows = [(k, prose(80), "en", "s") for k in range(400)] + [(1000 + k, " ".join(f"{w}%%%###" for w in prose(80).split()), "en", "s") for k in range(20)]
    got = {r.doc_id: r.kept for r in robust_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[k] for k in range(400)) and not any(got[1000 + k] for k in range(20))
    assert abs(chi2_quantile(0.95, 4) - 9.487729) < 1e-5


def test_bpe(spark, docs):
    t = Tokenizer.from_file(BPE)
    got = {r.doc_id: r for r in round_trip(docs, BPE).collect()}
    for i, x in ROWS:
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe_decode(bpe_encode(docs, BPE), BPE).collect()}
    assert all(back[i] == (x or "") for i, x in ROWS)


def test_bpe_odd_strings():
    b, t = Bpe(BPE), Tokenizer.from_file(BPE)
    rng = random.Random(5)
    odd = ["<|endoftext|>", "a<|endoftext|> b<|endoftext|>", " " * 700, "!" * 900, "ab" * 1500, "'s'll I'VE", "a_b __ x²y ½ 3²", "🙂🙂 👩‍👩‍👧"]
    odd += ["".join(rng.choice("aab et'sthe  \n\t.!0123éß日🙂\x1c\x85՘　²_½") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    odd += ["".join(rng.choice(list(b.vocab)).decode("utf-8", "ignore") for _ in range(6)) for _ in range(3000)]
    for x, ids in zip(odd, b.encode_batch(odd), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_bpe_patterns_agree_with_the_tokenizer():
    b, t = Bpe(BPE), Tokenizer.from_file(BPE).pre_tokenizer
    for cp in [*range(1, 0x3000), *range(0xA000, 0xAC00), *range(0xF900, 0x10800), *range(0x1D400, 0x1D800)]:
        if not 0xD800 <= cp < 0xE000:
            for form in ("a%sb", "1%s1", " %s ."):
                s = form.replace("%s", chr(cp))
                pattern = b._finder(s)
                assert pattern is None or pattern.findall(s) == [s[x:y] for _, (x, y) in t.pre_tokenize_str(s)], hex(cp)


def test_packing(docs):
    t = Tokenizer.from_file(BPE)
    rows = pack_documents(docs, BPE).collect()
    whole = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in ROWS}
    parts, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
        ids = whole[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
    for i, ids in whole.items():
        p = sorted(parts[i], key=lambda r: r.piece)
        assert [r.piece for r in p] == list(range(-(-len(ids) // 2048))) and sum(r.length for r in p) == len(ids)
        assert all(r.length == 2048 for r in p[1:])
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing_equals_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(40):
        lengths = [rng.randint(1, 60) for _ in range(rng.randint(0, 300))] + [60] * rng.randint(0, 5)
        bins = []
        for n in sorted(lengths, reverse=True):
            fit = [b for b in bins if b >= n]
            if fit:
                b = min(fit)
                bins.remove(b)
                bins.append(b - n)
            else:
                bins.append(60 - n)
        assert place_classes(Counter(lengths), 60)[1] == len(bins)


def test_packing_refuses_a_length_without_a_place(spark):
    with pytest.raises(ValueError):
        best_fit_pack(spark.createDataFrame([(1, 99)], "doc_id long, length long"), ["doc_id"], 50)


def test_sharding(docs):
    rows = shard_records(docs).collect()
    assert len(rows) == len(ROWS)
    slots = defaultdict(list)
    for r in rows:
        text = (dict(ROWS)[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(text) + 1, zlib.crc32(text), "key")
        draw = lambda k: -np.log(((xxhash.xxh64_intdigest(f"{r.doc_id}#{k}", seed=42) >> 11) + 0.5) / 2.0**53)  # noqa: B023, E731
        assert r.shard == min(range(8), key=draw) and r.grown_shard == min(range(9), key=draw)
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding_weights_nulls_and_repeats(spark):
    rows = spark.range(8000).selectExpr("id AS doc_id", "'t' AS text").union(spark.createDataFrame([(None, None), (None, "x"), (5, "a"), (5, "a")], "doc_id long, text string"))
    got = Counter(r.shard for r in shard_records(rows, [1.0, 3.0]).collect())
    assert sum(got.values()) == 8004 and 2.6 < got[1] / got[0] < 3.4


def test_language(spark):
    a, b = [f"{p}{q}" for p in ("tha", "the", "wor") for q in ("nd", "re", "ing")], [f"{p}{q}" for p in ("ção", "ña", "lle") for q in ("dor", "ía", "que")]
    make = lambda words, n: " ".join(RNG.choice(words) for _ in range(n))
    rows = [(k, make((a, b)[k % 2], 30), ("xx", "yy")[k % 2]) for k in range(300)] + [(900, None, "xx"), (901, "123 !!", "xx"), (902, make(a, 20) + " " + make(b, 60), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify_documents(df).collect()}
    assert all(got[k].lang_pred == ("xx", "yy")[k % 2] for k in range(300))
    assert (got[900].lang_pred, got[901].lang_pred, got[902].lang_pred) == ("und", "und", "yy")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got.values())
    model = Model.of_words([("xx", w, 5) for w in a] + [("yy", w, 5) for w in b])
    spans = {r.doc_id: r.spans for r in identify(df, model).collect()}[902]
    assert [s.lang for s in spans] == ["xx", "yy"] and abs(spans[0].n_words - 20) <= 2


def test_viterbi_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(30):
        sizes = rng.integers(0, 9, 5)
        emit = rng.normal(0, rng.choice([0.3, 3]), (sizes.sum(), 3)).astype(np.float32)
        label, short, at = viterbi(emit, sizes, 2.0), labels(emit, sizes, 2.0), 0
        for n in sizes:
            e, got = emit[at : at + n], label[at : at + n]
            worth = lambda p: sum(e[i, x] for i, x in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:]))  # noqa: B023, B905, E731
            best = max((worth(p) for p in np.ndindex(*[3] * n)), default=0)
            assert abs(worth(got) - best) < 1e-3 and abs(worth(short[at : at + n]) - best) < 1e-3
            at += n


def test_exact(docs):
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    for block, route in ((2048, F.xxhash64), (7, F.xxhash64), (60, lambda c: F.pmod(F.xxhash64(c), F.lit(40)))):  # the last hash clashes all over
        got = {r.doc_id: r for r in exact_duplicates(docs.orderBy(F.rand()), block, route).collect()}
        assert len(got) == len(ROWS)
        for t, ids in groups.items():
            for i in ids:
                assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(ids), len(ids), i == max(ids))
                assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_exact_repeated_rows_keep_one(spark):
    got = exact_duplicates(spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, None)], "doc_id long, text string")).collect()
    assert sorted(r.group_size for r in got) == [1, 3, 3, 3] and sum(r.kept for r in got) == 2


def test_near(docs):
    sets = {i: shingles(t) for i, t in ROWS}
    label = {i: i for i in sets}
    changed = True
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    got = near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], r.doc_id == label[r.doc_id])


def test_near_large_group_of_near_copies(spark):
    """Copies that mostly lie just under the threshold to each other: links only by way of a few of them."""
    base = [RNG.choice(WORDS) for _ in range(110)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(RNG.randint(0, 6)):
            w[RNG.randrange(110)] = f"n{RNG.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    for _ in range(20):
        for i in sets:
            for j in sets:
                if i < j and label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == label


def test_near_over_several_batches_and_repeated_ids(spark):
    base = [prose(40) for _ in range(2500)]
    rows = [(k, t) for k, t in enumerate(base)] + [(5000, base[7]), (5000, base[8]), (5000, base[8]), (3, prose(40))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r.component_id)
    assert len(got) == len(rows) and sorted(by[5000]) == [7, 8, 8] and by[3] == [3, 3] and all(by[k] == [k] for k in range(2500) if k != 3)


def test_near_recall_on_the_small_tables(spark):
    """Components equal those of all pairs that an inverted index finds."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    index = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            index[g].append(i)
    common = Counter((a, b) for ids in index.values() for x, a in enumerate(sorted(ids)) for b in sorted(ids)[x + 1 :])
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert got == {i: root(i) for i in sets} and len(set(got.values())) < len(got)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (200, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_numbered(spark):
    rows = numbered(spark.range(500).selectExpr("id", "id % 3 AS g"), ["g"], ["id"], "n", chunks=16).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.g].append(r.n)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


@pytest.mark.parametrize("hot", [10**6, 0, 300])
def test_suffixes(docs, hot):
    want = passages_by_brute_force(ROWS)
    got = repeated_passages(docs, hot_anchors=hot).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id


@pytest.mark.parametrize("hot", [10**6, 50])
def test_suffixes_one_anchor_in_most_documents(spark, hot):
    """Phrases of 30 to 70 bytes in most documents, with different surroundings each time."""
    rng = random.Random(31)
    phrases = [prose(30, rng)[:n] for n in (30, 40, 49, 50, 52, 60, 70)]
    rows = []
    for k in range(400):
        some = [prose(rng.randint(1, 12), rng)]
        for x in rng.sample(phrases, 4):
            some += [f"{rng.randrange(10**9)}", x, prose(rng.randint(1, 12), rng)]
        rows.append((k, rng.choice(["", "\n"]).join(some)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), hot_anchors=hot).collect()}
    want = passages_by_brute_force(rows)
    assert got == want and sum(x[2] > 0 for x in want.values()) > 300


def test_suffix_array_and_prefixes():
    rng = random.Random(4)
    for _ in range(80):
        t = bytes(rng.choice(b"ab\0\xff") for _ in range(rng.randint(1, 200))) if rng.random() < 0.5 else (bytes(rng.choice(b"abc") for _ in range(7)) * 40)[: rng.randint(1, 280)]
        a = np.frombuffer(t, np.uint8)
        order = larsson_sadakane(a)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        got = kasai(a, order, rng.choice([1, 7, 76]), 50)
        for k in range(1, len(t)):
            x, y = t[order[k - 1] :], t[order[k] :]
            n = next((i for i in range(min(len(x), len(y), 50)) if x[i] != y[i]), min(len(x), len(y), 50))
            assert got[k] == n


def test_lines(docs):
    places = defaultdict(list)
    for at, template in line_templates(ROWS).items():
        places[template].append(at)
    gone = {p for some in places.values() if len({i for i, _ in some}) >= MIN_DOCS for p in some if p != min(some)}
    assert len(gone) > MIN_DOCS
    for r in drop_recurring_lines(docs).collect():
        t = dict(ROWS)[r.doc_id]
        lines = [] if t is None else t.split("\n")
        keep = [x for k, x in enumerate(lines) if (r.doc_id, k) not in gone]
        assert (r.n_lines, r.n_dropped, r.text) == (len(lines), len(lines) - len(keep), None if t is None else "\n".join(keep))
        assert all(r[c] == f"extra {c}" for c in EXTRA)


#: Usual headers as they stand in files, wrapped and behind comment marks.
NOTICES = {
    "mit": """# Permission is hereby granted, free of charge, to any person obtaining a
# copy of this software and associated documentation files (the
# "Software"), to deal in the Software without restriction, including
# without limitation the rights to use, copy, modify, merge, publish,
# distribute, sublicense, and/or sell copies of the Software""",
    "gpl": """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.""",
    "bsd": """// Redistribution and use in source and binary forms, with or without
// modification, are permitted provided that the following conditions
// are met:""",
    "apache-2.0": """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.""",
    "lgpl": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla
Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}


def test_licences(spark):
    plain = [prose(12) for _ in range(300)]
    notices = [(f, t) for f, ts in TEMPLATES.items() for t in ts]
    rows = [(k, t + "\nUnder MIT license of and the terms " + prose(3)) for k, t in enumerate(plain)]
    rows += [(1000 + k, f"{prose(9)}.\n{t}") for k, (_, t) in enumerate(notices)]
    rows += [(2000 + k, f"{prose(20)}\n{prose(15)}\n\n{t}\n#\n{prose(30)}") for k, t in enumerate(NOTICES.values())]
    rows += [(3000 + k, f"{prose(5)} {t[: len(t) * 3 // 4]} {prose(6)}") for k, (_, t) in enumerate(notices) if len(t) > 100]
    rows += [(4000, "The licence of the software is granted. You may copy the terms and conditions of any work"), (4001, "He was free to modify the general public notice with permission"), (5000, None), (5001, "")]
    model = LicenceModel(plain)
    got = licence_paragraphs(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    named = {(r.doc_id, r.paragraph): r.family for r in got if r.family != "unknown"}
    assert sum(named.get((1000 + k, 1)) == f for k, (f, _) in enumerate(notices)) >= 0.95 * len(notices)
    assert [next((f for (d, _), f in named.items() if d == 2000 + k), None) for k in range(len(NOTICES))] == list(NOTICES)
    cut = [(k, f) for k, (f, t) in enumerate(notices) if len(t) > 100]
    assert sum(named.get((3000 + k, 0)) == f for k, f in cut) >= 0.9 * len(cut)
    assert not any(d < 1000 or d >= 4000 for d, _ in named)
    # Brute force: the same paragraphs, n-grams and weights by hand.
    want = {}
    for d, t in rows:
        for k, part in enumerate(re.split(r"(?:(?<=[.!?:;])|(?<=[.!?:;][\"')\]]))[ \t\r]*\n|\n[^a-zA-Z0-9\n]*(?=\n)", t or "")):
            grams = licences._grams(licences._words(part)) if licences._words(part) else []
            hits = [g for g in grams if g in model.vocabulary]
            if hits:
                z = (model.weights[[model.vocabulary[g] for g in hits]].sum(0) + model.bias) / model.temperature
                p, c = np.exp(z - z.max()), int(z.argmax())
                if model.classes[c] != licences.OTHER:
                    near = max(len(set(grams) & set(licences._grams(licences._words(x)))) / len(set(licences._grams(licences._words(x)))) for x in TEMPLATES[model.classes[c]])
                    sure = 1 / p.sum() >= model.floor and near >= licences.CONFIRM
                    want[d, k] = (model.classes[c] if sure else "unknown", model.classes[c], round(float(1 / p.sum()), 6), round(near, 6))
    assert {(r.doc_id, r.paragraph): (r.family, r.predicted, round(r.probability, 6), round(r.closeness, 6)) for r in got} == want


def test_large_ids_beside_nulls(spark):
    big = (1 << 62) + 1
    df = spark.createDataFrame([(big, "some text"), (None, "other text"), (None, None)], "doc_id long, text string")
    for out in (round_trip(df, BPE), bpe_decode(bpe_encode(df, BPE), BPE), pack_documents(df, BPE), near_duplicates(df), exact_duplicates(df), repeated_passages(df), shard_records(df)):
        assert sorted(str(r.doc_id) for r in out.collect()) == sorted([str(big), "None", "None"])
