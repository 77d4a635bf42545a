"""Operator 7: language of texts. Script ranges narrow the candidates, then Viterbi over per-word scores with a
switching penalty labels the spans of mixed-language text; the language of most letters names the document."""

from __future__ import annotations

import bisect
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

TRAIN_DOCS = 4000  # expected labelled documents, drawn by hash over the whole table, that the counts are taken from
BUCKETS = 1 << 16  # hashed n-grams; every n-gram counts
LONGEST = 4
PENALTY = 6.0
WORD = re.compile(r"[^\W\d_]+")
BREAK = re.compile(r"[\W\d_]")
FOREIGN = re.compile("[^\x00-\u036f]")  # beyond the first script range
PIECE = 64  # letters of a run that are scored as one word at most
BLOCK = 1 << 20  # characters whose words are held as strings at once
SCORES = 32 << 20  # bytes of a matrix of words by languages; a longer text has one to itself
MULT = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xC2B2AE3D27D4EB4F)]
#: First code points of script ranges and their names (fixed values, in order).
SCRIPTS = [(0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "devanagari"), (0x980, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C00, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE70, "arabic"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"), (0x32000, "other")]
STARTS = [s for s, _ in SCRIPTS]
NAMES = sorted({name for _, name in SCRIPTS})


def script(c: str) -> str:
    return SCRIPTS[max(0, bisect.bisect_right(STARTS, ord(c)) - 1)][1]


def pieces(run: str) -> list[str]:
    """A run of letters, cut where the script changes and after each PIECE letters, so that every letter is scored."""
    if len(run) <= PIECE and not FOREIGN.search(run):
        return [run]
    out, start, now = [], 0, script(run[0])
    for i, c in enumerate(run):
        at = script(c)
        if at != now or i - start == PIECE:
            out.append(run[start:i])
            start, now = i, at
    return [*out, run[start:]]


def runs(text: str) -> Iterator[list[str]]:
    """The runs of letters of a lower-cased text, block by block; blocks end between runs."""
    at = 0
    while at < len(text):
        cut = BREAK.search(text, at + BLOCK)
        end = cut.start() if cut else len(text)
        yield WORD.findall(text, at, end)
        at = end


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all 1- to LONGEST-grams that start at each letter of the words between spaces (a row for each length,
    BUCKETS where there is none), and where each word begins."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    code = np.frombuffer("".join([f" {w} " for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.cumsum(sizes) - sizes
    place = np.arange(len(code)) - np.repeat(start, sizes)
    size = np.repeat(sizes, sizes)
    padded = np.append(code, np.zeros(LONGEST, np.uint32)).astype(np.uint64)
    out = np.full((LONGEST, len(code)), BUCKETS, np.int64)
    h = np.zeros(len(code), np.uint64)
    for n in range(1, LONGEST + 1):
        h = (h + padded[n - 1 : n - 1 + len(code)] + np.uint64(n)) * MULT[n % 4]
        h ^= h >> np.uint64(29)
        real = place + n <= size if n > 1 else (place > 0) & (place < size - 1)
        out[n - 1, real] = ((h * MULT[0]) >> np.uint64(48))[real].astype(np.int64) & (BUCKETS - 1)
    return out, start


class Model:
    """Log-likelihood ratios of hashed character n-grams, and each language's scripts; of (language, bucket, count),
    where buckets from BUCKETS on count the words of each script."""

    def __init__(self, counts: list[tuple[str, int, int]]):
        self.languages = sorted({lang for lang, _, _ in counts})
        at = {x: k for k, x in enumerate(self.languages)}
        table = np.zeros((BUCKETS + len(NAMES), len(self.languages)))
        for lang, bucket, n in counts:
            table[bucket, at[lang]] += n
        seen = table[:BUCKETS].any(1)
        m = table[:BUCKETS][seen] + 0.5
        m = np.log(m / m.sum(0))
        self.weights = np.zeros((BUCKETS + 1, len(self.languages)), np.float32)
        self.weights[:BUCKETS][seen] = m - m.mean(1, keepdims=True)
        letters = table[BUCKETS:]
        self.scripts = letters > 0.01 * letters.sum(0)

    @classmethod
    def of_words(cls, counts: list[tuple[str, str, int]]) -> Model:
        return cls([row for lang, word, n in counts for row in gram_counts(lang, Counter({word: n}))])

    def score(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word; languages without the word's script are out, unless all would be."""
        out = np.empty((len(words), len(self.languages)), np.float32)
        step = max(1, SCORES // (4 * 10 * len(self.languages)))
        for a in range(0, len(words), step):
            some = words[a : a + step]
            ids, start = grams(some)
            total = sum(np.add.reduceat(self.weights[row], start) for row in ids)
            sizes = 4 * np.fromiter(map(len, some), np.int64, len(some))
            # Overlapping n-grams are no independent evidence: their mean counts as often as the word has letters.
            scores = total / sizes[:, None] * np.minimum(sizes, 40)[:, None] ** 0.5 * 1.5
            allowed = self.scripts[[NAMES.index(script(w[0])) for w in some]]
            out[a : a + step] = np.where(allowed | ~allowed.any(1, keepdims=True), scores, -50.0)
        return out


def gram_counts(lang: str, words: Counter) -> list[tuple[str, int, int]]:
    names = list(words)
    n = np.fromiter(words.values(), np.int64, len(names))
    total = np.zeros(BUCKETS + 1)
    step = 100_000
    for a in range(0, len(names), step):
        ids, start = grams(names[a : a + step])
        each = np.repeat(n[a : a + step], np.diff(np.append(start, ids.shape[1])))
        for row in ids:
            total += np.bincount(row, each, BUCKETS + 1)
    scripts = Counter()
    for w, k in words.items():
        scripts[NAMES.index(script(w[0]))] += k
    some = np.flatnonzero(total[:BUCKETS])
    return [(lang, int(b), int(total[b])) for b in some] + [(lang, BUCKETS + s, k) for s, k in scripts.items()]


def steady(emit: np.ndarray, sizes: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """For each text the label that is best throughout, and whether no path with a switch can beat it.

    A path in which the one label comes up, too, has a switch for each stretch of other labels; none of these pays if
    no stretch gains the penalty. A path without it gains at most the sum of what each word gains by its best other
    label, which must be below 0. The best stretch of each label is a running sum less its running minimum.
    """
    start = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    label = np.add.reduceat(emit, start).argmax(1)
    gain = emit.astype(np.float64)
    gain -= gain[np.arange(len(gain)), label[owner]][:, None]
    run = np.cumsum(gain, 0)
    before = np.vstack([np.zeros((1, emit.shape[1])), run[:-1]])
    # Texts lie far apart, so the running minimum begins anew with each.
    far = 1e3 + run.max(initial=0) - run.min(initial=0)
    lowest = np.minimum.accumulate(before - far * owner[:, None], 0) + far * owner[:, None]
    within = np.maximum.reduceat(run - lowest, start).max(1) < penalty - 1e-3
    gain[np.arange(len(gain)), label[owner]] = -np.inf
    return label, within & (np.add.reduceat(gain.max(1), start) < -1e-3)


def viterbi(emit: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word; texts (consecutive runs of `sizes` words) are decoded in step, longest first. A place
    holds one bit a label, whether to stay, and the label to come from else."""
    by = np.argsort(-sizes, kind="stable")
    start = (np.cumsum(sizes) - sizes)[by]
    size = sizes[by]
    n, k = emit.shape
    stays = np.zeros((n, -(-k // 8)), np.uint8)
    source = np.zeros(n, np.int32)
    score = np.zeros((len(sizes), k), np.float32)
    alive = len(size) - np.searchsorted(size[::-1], np.arange(1, (size[0] if len(size) else 0) + 1), "left")
    for t, a in enumerate(alive.tolist()):
        at = start[:a] + t
        now = score[:a]
        best = now.argmax(1)
        top = now[np.arange(a), best][:, None] - penalty
        stay = now >= top
        stays[at] = np.packbits(stay, axis=1)
        source[at] = best
        score[:a] = np.where(stay, now, top) + emit[at]
    label = np.zeros(n, np.int32)
    held = score.argmax(1).astype(np.int32)
    for t in range(len(alive) - 1, -1, -1):
        a = alive[t]
        at = start[:a] + t
        label[at] = held[:a]
        stay = (stays[at, held[:a] >> 3] >> (7 - (held[:a] & 7))) & 1
        held[:a] = np.where(stay, held[:a], source[at])
    return label


def labels(emit: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """viterbi(), step by step only where a switch may pay."""
    some = sizes > 0
    if not some.all():
        return labels(emit, sizes[some], penalty)
    if not len(sizes):
        return np.zeros(0, np.int32)
    one, sure = steady(emit, sizes, penalty)
    out = np.repeat(one, sizes).astype(np.int32)
    mixed = np.repeat(~sure, sizes)
    if mixed.any():
        out[mixed] = viterbi(emit[mixed], sizes[~sure], penalty)
    return out


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for some in runs(text.lower()):
                words[lang].update(p for r in some for p in pieces(r))
        rows = [row for lang, n in words.items() for row in gram_counts(lang, n)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "bucket", "n"])


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model | None:
    """Fits on an expected `train_docs` labelled rows outside the held-out fold, drawn by hash. What is collected has a
    row for each language and bucket at most; no language, word or n-gram of those rows is left out."""
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = usable.count()
    share = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit("train")), 11) / float(1 << 53)
    rows = usable.where(share < train_docs / n) if n > train_docs else usable
    counts = bounded_batches(rows.select("lang", "text")).mapInArrow(_counted, "lang string, bucket int, n long")
    found = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    return Model([(r["lang"], r["bucket"], r["n"]) for r in found]) if found else None


class _Scored:
    """Scores, probabilities and lengths of the words met so far, within SCORES bytes."""

    def __init__(self, model: Model):
        self.model, self.k = model, len(model.languages)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, np.ndarray] = {}
        self.rows: dict[str, int] = {}
        self.score = np.empty((0, self.k), np.float32)
        self.chance = np.empty((0, self.k), np.float32)
        self.letters = np.empty(0, np.int64)

    def ids(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the pieces of runs of letters, in order, and how many pieces each run has."""
        coded = pa.array(found, pa.string()).dictionary_encode()
        names = coded.dictionary.to_pylist()
        cut = [(r,) if r in self.rows else pieces(r) for r in names]
        new = list(dict.fromkeys(p for x in cut for p in x if p not in self.rows))
        if new:
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            score = self.model.score(new)
            chance = np.exp(score - score.max(1, keepdims=True))
            self.score = np.concatenate([self.score, score])
            self.chance = np.concatenate([self.chance, chance / chance.sum(1, keepdims=True)])
            self.letters = np.concatenate([self.letters, np.fromiter(map(len, new), np.int64, len(new))])
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        flat = np.fromiter((self.rows[p] for x in cut for p in x), np.int32, int(n.sum()))
        of = coded.indices.to_numpy()
        size = n[of]
        if len(flat) == len(names):
            return flat[of], size
        first = np.cumsum(n) - n
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return flat[np.repeat(first[of], size) + inner], size

    def texts(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the words of texts, and how many words each has."""
        if len(some) == 1:
            found = [self.ids(r)[0] for r in runs(some[0].lower())]
            flat = np.concatenate(found) if found else np.empty(0, np.int32)
            return flat, np.array([len(flat)])
        each = [WORD.findall(t.lower()) for t in some]
        flat, size = self.ids([r for x in each for r in x])
        of = np.repeat(np.arange(len(some)), np.fromiter(map(len, each), np.int64, len(each)))
        return flat, np.bincount(of, size, len(some)).astype(np.int64)


def _label(model: Model | None, penalty: float):
    kind = pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())])

    def judged(known: _Scored, texts: list[str]) -> tuple[list[str], np.ndarray, pa.Array]:
        """Language, score and spans of texts."""
        flat, sizes = known.texts(texts)
        label = labels(known.score[flat], sizes, penalty)
        owner = np.repeat(np.arange(len(texts)), sizes)
        weight = known.letters[flat]
        mass = np.bincount(owner * known.k + label, weight, len(texts) * known.k).reshape(-1, known.k)
        winner = mass.argmax(1)
        sure = np.bincount(owner, known.chance[flat, winner[owner]] * weight, len(texts)) / np.maximum(mass.sum(1), 1)
        names = [known.model.languages[w] if s else "und" for w, s in zip(winner, sizes, strict=True)]
        cut = np.flatnonzero(np.append(True, (label[1:] != label[:-1]) | (owner[1:] != owner[:-1]))) if len(flat) else np.empty(0, np.int64)
        first = np.cumsum(sizes) - sizes
        spans = [pa.array(known.model.languages).take(pa.array(label[cut])) if len(cut) else pa.array([], pa.string()), pa.array((cut - first[owner[cut]]).astype(np.int32)), pa.array(np.diff(np.append(cut, len(flat))).astype(np.int32))]
        offsets = np.searchsorted(owner[cut], np.arange(len(texts) + 1)).astype(np.int32)
        return names, np.where(sizes > 0, np.clip(sure, 0, 1), 0.0), pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(spans, fields=list(kind)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Scored(model) if model else None
        for batch in batches:
            n = batch.num_rows

            def told(a: int, b: int, names: list[str], score: np.ndarray, spans: pa.Array, batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                own = [pa.array(names, pa.string()), pa.array(score, pa.float64()), spans]
                return pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[1:], *own], names=[*batch.schema.names[1:], "lang_pred", "score", "spans"])

            if known is None:
                yield told(0, n, ["und"] * n, np.zeros(n), pa.array([[]] * n, pa.list_(kind)))
                continue
            most = min(BLOCK, SCORES // known.k)  # of characters; a word and its break have two at least
            size = pc.fill_null(pc.utf8_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
            a = 0
            while a < n:
                b = max(a + 1, a + int(np.searchsorted(np.cumsum(size[a:]), most, "right")))
                yield told(a, b, *judged(known, [t or "" for t in batch.column(0).slice(a, b - a).to_pylist()]))
                a = b
                if 8 * len(known.rows) * known.k > 2 * SCORES:
                    known.clear()

    return run


def identify(docs: DataFrame, model: Model | None, penalty: float = PENALTY, carried: list[str] | None = None) -> DataFrame:
    """The `carried` (all) columns of documents(doc_id, text, ...) with lang_pred, score and spans of every whole text.

    `und` with score 0 where the text is null or has no letters, or nothing was there to learn from. Else the language
    of most letters after labelling; score is the mean probability that a letter's word gives it. spans: runs of
    words of one language, where a run of letters counts as one word for each of its pieces. Only the text is
    looked at; equal rows get equal results; columns of the new names are replaced.
    """
    names = [c for c in carried or docs.columns if c not in ("lang_pred", "score", "spans")]
    packed = bounded_batches(docs).select(F.col("text").alias("own_text"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"))
    spans = T.ArrayType(T.StructType().add("lang", "string").add("first_word", "integer").add("n_words", "integer"))
    schema = T.StructType().add("doc", packed.schema["doc"].dataType).add("lang_pred", "string").add("score", "double").add("spans", spans)
    out = packed.mapInArrow(_label(model, penalty), schema)
    return out.select(*[F.col("doc").getField(c).alias(c) for c in names], "lang_pred", "score", "spans")


def identify_documents(docs: DataFrame) -> DataFrame:
    """Learns from the rows of documents(doc_id, text, lang) outside the held-out fold and labels all of them."""
    out = identify(docs, train(docs), carried=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")


def is_accepted(lang: Column, score: Column, least: float = 0.3) -> Column:
    """What the pipeline keeps: a language is known and its score is at least `least`."""
    return (lang != "und") & (score >= least)
