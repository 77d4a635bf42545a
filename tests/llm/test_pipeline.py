"""Each stage of the pipeline against brute force on its own input: clean documents stay, decisions take effect."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from brute import components, passages_by_brute_force, recurring
from tokenizers import Tokenizer

from pagewright.llm.language import PENALTY, pieces, runs, train

RNG = random.Random(9)
WORDS = ["".join(RNG.choice("abcdefghilmnorst") for _ in range(RNG.randint(2, 8))) for _ in range(900)]
OTHER = ["".join(RNG.choice("äöüxyzwvßk") for _ in range(RNG.randint(2, 8))) for _ in range(300)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, words=WORDS):
    return " ".join(RNG.choice(words) for _ in range(n))


def corpus():
    clean = [prose(RNG.randint(60, 200)) for _ in range(80)]
    passage = prose(70)
    texts = clean + clean[:5] + [f"{prose(40)}\n{passage}\n{prose(40)}" for _ in range(4)]
    for t in clean[10:16]:  # near copies
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [f"Page {k} of {k + 3} printed for reader {k}\n{prose(60)}\n\nRead more" for k in range(14)]
    texts += [prose(80, OTHER) for _ in range(12)] + [prose(30) + " " + prose(50, OTHER), "Read more", None, "", "123 456 !!", " \n "]
    return [(k, t, "de" if t and set(t) & set("äöüß") else "en", None if k % 7 == 0 else "s", None) for k, t in enumerate(texts)]


def labelled(model, text):
    """(language, score) by a plain Viterbi over one text."""
    words = [p for some in runs((text or "").lower()) for r in some for p in pieces(r)]
    if not words:
        return "und", 0.0
    emit = model.score(words).astype(float)
    n, k = emit.shape
    best, back = emit[0], []
    for row in emit[1:]:
        come = best[:, None] - PENALTY * (1 - np.eye(k))
        back.append(come.argmax(0))
        best = come.max(0) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    letters = np.array([len(w) for w in words])
    mass = np.bincount(path[::-1], letters, k)
    p = np.exp(emit - emit.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return model.languages[int(mass.argmax())], float((p[:, mass.argmax()] * letters).sum() / letters.sum())


def test_pipeline(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = train(docs)
    inputs, now = {}, [(r[0], r[1]) for r in rows]
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = now
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            got = docs.collect()
            now = sorted((r.doc_id, r.text) for r in got)
            assert name == "language" or all(r.n_chars == len(r.text) for r in got)
            assert all((r.lang, r.source) == rows[r.doc_id][2:4] for r in got)
    # language: documents with a language stay as they are
    assert inputs["lines"] == [(i, t) for i, t in inputs["language"] if (x := labelled(model, t))[0] != "und" and x[1] >= 0.3]
    assert len(inputs["language"]) - len(inputs["lines"]) == 4
    # lines: all but the first line of a template that recurs go, and documents without text
    gone = recurring(inputs["lines"])
    left = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in inputs["lines"]]
    assert len(gone) > 25 and inputs["near_duplicates"] == [(i, t) for i, t in left if t.strip()] and len(left) > len(inputs["near_duplicates"])
    # near duplicates: the smallest of each component stays
    label = components(inputs["near_duplicates"], 5)
    assert inputs["passages"] == [(i, t) for i, t in inputs["near_duplicates"] if label[i] == i]
    assert len(inputs["near_duplicates"]) - len(inputs["passages"]) == 11
    # passages: what a smaller document has goes
    want = passages_by_brute_force(inputs["passages"])
    assert sum(x[1] > 0 for x in want.values()) >= 3
    assert {i: len(t.encode()) for i, t in inputs["packing"]} == {i: x[0] - x[1] for i, x in want.items() if x[0] > x[1]}
    # packing: whole documents, gapless sequences, as many as best-fit decreasing opens
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = docs.collect()
    sizes = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in inputs["packing"]}
    total = Counter()
    for r in packed:
        total[r.doc_id] += r.length
    assert total == sizes
    gaps = []
    for n in sorted((r.length for r in packed), reverse=True):
        fit = min((g for g in gaps if g >= n), default=2048)
        if fit in gaps:
            gaps.remove(fit)
        gaps.append(fit - n)
    assert len({r.sequence_id for r in packed}) == len(gaps)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)


def test_an_empty_table_passes_all_stages(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
