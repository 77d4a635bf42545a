"""Trained parts over blocks: classifiers, cross-validation, clustering, synthetic samples. No SQL counterpart."""

from __future__ import annotations

import functools
import itertools
import json
import tempfile
import uuid
from collections.abc import Callable, Iterable
from multiprocessing.pool import ThreadPool
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dialect import SPARK
from ..plans.outline import Plan, whole
from . import PLANS, _run, run, run_on_blocks

#: The classifier's columns, less font_size and is_bold, of which the made-up label consists, and what follows from them.
FEATURES = ["font_size_ratio", "font_size_zscore", "is_italic", "char_count", "word_count", "avg_word_length", "x_position", "y_position", "width", "height", "page_number", "starts_with_number", "has_colon", "has_period", "all_caps", "title_case", "ends_with_period", "starts_with_capital", "has_section_number", "section_depth", "has_common_words", "digit_ratio", "punct_ratio", "space_ratio", "font_size_percentile", "is_largest_font", "is_above_avg_font", "prev_vertical_gap", "prev_font_size_diff", "next_vertical_gap", "next_font_size_diff", "relative_y_position"]
#: Columns that belong to a group are those whose name holds one of its parts (fixed values).
GROUPS = {
    "font": ["font_size", "is_bold", "is_italic", "font_flags", "is_serif", "is_sans", "monospace", "display_font", "title_font"],
    "position": ["x_position", "y_position", "width", "height", "distance", "aspect", "aligned", "centered", "indentation"],
    "text": ["char_count", "word_count", "sentence", "word_length", "ratio", "title_case", "all_caps", "capitalized", "language"],
    "pattern": ["has_decimal", "has_roman", "has_letter", "has_paren", "numbering", "section", "starts_with", "ends_with", "acronyms"],
    "semantic": ["probability", "confidence", "vocab", "keywords", "proper", "technical", "is_question", "is_instruction", "is_definition"],
    "context": ["block_index", "relative", "first_block", "last_block", "whitespace", "nearby", "diff", "gap"],
    "rule": ["rule_"],
    "model": ["ml_"],
}
FOLDS = 5
#: Rows up to which a grid's fits run side by side; larger tables keep all cores busy with one.
SIDE_BY_SIDE = 2_000_000


def training_blocks(docs: DataFrame) -> DataFrame:
    """The feature row of each block with a label: bold and of 13 points or more."""
    rows = run("ml_features", docs)
    return rows.withColumn("label", ((F.col("is_bold") == 1) & (F.col("font_size") >= 13)).cast("double"))


def sample(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """All rows; where a caller sets a limit, an expected number of them, drawn by hash. No query sets one."""
    if limit is None or (n := rows.count()) <= limit:
        return rows
    share = F.pmod(F.xxhash64("doc_id", "seq"), F.lit(1 << 20)) / float(1 << 20)
    return rows.where(share < limit / n)


def staged(rows: DataFrame) -> DataFrame:
    """Rows written to the shared folder and read back, as each step of a fit reads them again."""
    spark = rows.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/rows-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def configured(config: dict[str, object] | None = None) -> dict[str, object]:
    """Thresholds, weights and settings with their standing values, some of them replaced; unknown names are refused."""
    known: dict[str, object] = {"threshold": 0.5, "folds": FOLDS, "fit_rows": None, "trees": 100, "depth": 10, "rounds": 50, "step": 0.1, "iterations": 1000}
    if unknown := set(config or {}) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return known | (config or {})


def read_config(path: str) -> dict[str, object]:
    """Settings of a JSON file, checked."""
    return configured(json.loads(Path(path).read_text()))


def feature_groups(columns: list[str]) -> dict[str, list[str]]:
    """The columns of each group that has any."""
    found = {k: [c for c in columns if any(x in c for x in parts)] for k, parts in GROUPS.items()}
    return {k: x for k, x in found.items() if x}


def pipeline(kind: str = "forest", features: list[str] | None = None) -> Pipeline:
    model = {
        "forest": lambda: RandomForestClassifier(numTrees=100, maxDepth=10, minInstancesPerNode=2, seed=42, featuresCol="scaled"),
        "boosting": lambda: GBTClassifier(maxIter=50, stepSize=0.1, maxDepth=6, seed=42, featuresCol="scaled"),
        "logistic": lambda: LogisticRegression(maxIter=1000, featuresCol="scaled"),
    }[kind]()
    return Pipeline(stages=[VectorAssembler(inputCols=features or FEATURES, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), model])


def train(rows: DataFrame, kind: str = "forest", features: list[str] | None = None) -> PipelineModel:
    return pipeline(kind, features).fit(sample(rows))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predict(model: PipelineModel | None, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, seq, probability, is_heading); 0.1 everywhere while there is no model."""
    if model is None:
        return rows.select("doc_id", "seq", F.lit(0.1).alias("probability"), (F.lit(0.1) >= threshold).alias("is_heading"))
    p = vector_to_array("probability")[1]
    return model.transform(rows).select("doc_id", "seq", p.alias("probability"), (p >= threshold).alias("is_heading"))


def _metrics(rows: DataFrame) -> DataFrame:
    hit, truth = F.col("prediction") == 1, F.col("label") == 1
    tp, fp, fn, n = F.count_if(hit & truth), F.count_if(hit & ~truth), F.count_if(~hit & truth), F.count(F.lit(1))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return rows.groupBy("fold").agg(ratio(F.count_if(F.col("prediction") == F.col("label")), n).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def _dealt(rows: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Stratified folds over all rows: each label is dealt out by hash."""
    return rows.withColumn("fold", F.pmod(F.xxhash64("label", "doc_id", "seq"), F.lit(folds)).cast("int"))


def cross_validate(rows: DataFrame, kind: str = "logistic", folds: int = FOLDS, limit: int | None = None) -> DataFrame:
    """Accuracy, precision, recall and F1 of each fold, over all its rows; each fit is on all rows of the others."""
    data = _dealt(rows, folds)
    fit = lambda k: pipeline(kind).fit(sample(data.where(F.col("fold") != k), limit))
    models = _side_by_side(data, fit, range(folds))
    return functools.reduce(DataFrame.unionByName, [_metrics(m.transform(data.where(F.col("fold") == k))) for k, m in enumerate(models)])


def _side_by_side(data: DataFrame, function: Callable, over: Iterable) -> list:
    """The function's results in order, some at a time where the table is too small to keep all cores busy with one."""
    threads = 4 if data.count() <= SIDE_BY_SIDE else 1
    with ThreadPool(threads) as pool:
        return pool.map(inheritable_thread_target(data.sparkSession)(function), over, chunksize=1)


def cross_validation_summary(folds: DataFrame) -> DataFrame:
    """Mean and standard deviation over the folds of each metric."""
    out = None
    for m in ("accuracy", "precision", "recall", "f1"):
        row = folds.select(F.lit(m).alias("metric"), m).groupBy("metric").agg(F.avg(m).alias("mean"), F.stddev_pop(m).alias("deviation"))
        out = row if out is None else out.unionByName(row)
    return out


def grids(small: bool = False) -> dict[str, list[dict[str, float]]]:
    """Settings of each kind of model: every combination, or two of each where small."""
    full = {
        "forest": {"numTrees": [50, 100, 200], "maxDepth": [5, 10, 15], "minInstancesPerNode": [1, 2, 4]},
        "boosting": {"maxIter": [50, 100, 200], "stepSize": [0.05, 0.1, 0.2], "maxDepth": [3, 6, 9]},
        "logistic": {"regParam": [10.0, 1.0, 0.1, 0.01], "elasticNetParam": [0.0, 1.0]},
    }
    all_ = {k: [dict(zip(g, x, strict=True)) for x in itertools.product(*g.values())] for k, g in full.items()}
    return {k: x[:2] if small else x for k, x in all_.items()}


def grid_search(rows: DataFrame, kind: str = "logistic", settings: list[dict[str, float]] | None = None, limit: int | None = None) -> DataFrame:
    """Mean F1 over all folds of each setting of a kind of model, best first; fits are on all rows of the other folds, and
    every held-out row is scored. A fold's rows are scaled once for all settings."""
    data, parts = _dealt(rows), []
    settings = settings or grids()[kind]
    for k in range(FOLDS):
        *first, model = pipeline(kind).getStages()
        scaling = Pipeline(stages=first).fit(sample(data.where(F.col("fold") != k), limit))
        fit = scaling.transform(sample(data.where(F.col("fold") != k), limit)).select("scaled", "label").persist(StorageLevel.MEMORY_AND_DISK)
        held = scaling.transform(data.where(F.col("fold") == k))
        fitted = _side_by_side(fit, lambda x: model.copy({model.getParam(name): v for name, v in x.items()}).fit(fit), settings)  # noqa: B023
        parts += [_metrics(m.transform(held)).select(F.lit(n).alias("n"), F.lit(json.dumps(x)).alias("settings"), "f1") for n, (x, m) in enumerate(zip(settings, fitted, strict=True))]
        fit.unpersist()
    out = functools.reduce(DataFrame.unionByName, parts)
    return out.groupBy("n", "settings").agg(F.avg("f1").alias("f1")).orderBy(F.desc("f1"), "n").select(F.lit(kind).alias("model"), "settings", "f1")


def mutual_information(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(feature, information): of each feature, in tenths of its range, and the label, in nats; one aggregate over all rows."""
    ends = rows.agg(*[F.min(f).alias(f"lo_{f}") for f in FEATURES], *[F.max(f).alias(f"hi_{f}") for f in FEATURES]).first()
    tenth = lambda f: F.least(F.lit(bins - 1), F.floor((F.col(f) - ends[f"lo_{f}"]) / ((ends[f"hi_{f}"] - ends[f"lo_{f}"]) or 1) * bins))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), tenth(f).cast("int").alias("bin")) for f in FEATURES])).alias("x")
    cells = rows.where("label is not null").select("label", each).groupBy("x.feature", "x.bin", "label").agg(F.count(F.lit(1)).alias("n"))
    total = lambda *by: F.sum("n").over(Window.partitionBy("feature", *by))
    part = cells.select("feature", (F.col("n") / total() * F.log(F.col("n") * total() / (total("bin") * total("label")))).alias("p"))
    return part.groupBy("feature").agg(F.sum("p").alias("information"))


def feature_importance(rows: DataFrame, top: int = 10) -> DataFrame:
    model = train(rows)
    pairs = sorted(zip(FEATURES, map(float, model.stages[-1].featureImportances.toArray()), strict=True), key=lambda x: (-x[1], x[0]))[:top]
    return rows.sparkSession.createDataFrame(pairs, "feature string, importance double")


def select_features(rows: DataFrame, n: int = 30) -> list[str]:
    """Union of a third of n by the F-test, a third by mutual information and a third by forest importance; at least ten."""
    third = max(10, n // 3)
    data = VectorAssembler(inputCols=FEATURES, outputCol="raw").transform(sample(rows))
    test = UnivariateFeatureSelector(featuresCol="raw", outputCol="out", labelCol="label").setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(third)
    chosen = [FEATURES[i] for i in test.fit(data).selectedFeatures]
    told = [r["feature"] for r in mutual_information(rows).orderBy(F.desc("information"), "feature").limit(third).collect()]
    more = [r["feature"] for r in feature_importance(rows, third).collect()]
    return list(dict.fromkeys(chosen + told + more))


@functools.cache
def _starts(n: int, k: int, seed: int = 42) -> np.ndarray:
    """Rows that ten runs start from; they depend on the numbers only."""
    rng = np.random.default_rng(seed)
    return np.array([rng.choice(n, k, replace=False) for _ in range(10)])


#: Numbers held at once by a step of the k-means runs, in thousands.
STEP = 2_000


def _kmeans(xs: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """The best of ten runs for each of several documents with the same number of rows (documents x rows x columns). All
    runs take their steps together; each ends when its own centres stand still. A long document's runs, one by one."""
    d, n, m = xs.shape
    starts = _starts(n, k, seed)
    at_once = max(1, STEP * 1000 // (n * k * m))
    x = np.repeat(xs, 10, axis=0)
    c = np.concatenate([x_[starts] for x_ in xs])
    own, cost = np.zeros((d * 10, n), np.int64), np.zeros(d * 10)
    for a in range(0, d * 10, at_once):
        open_ = np.arange(a, min(a + at_once, d * 10))
        for step in range(50):
            y, old = x[open_], c[open_]
            mine = ((y[:, :, None] - old[:, None]) ** 2).sum(3).argmin(2)
            member = mine[:, :, None] == np.arange(k)
            size = member.sum(1)[:, :, None]
            sums = np.where(member[..., None], y[:, :, None], 0).sum(1)
            new = np.where(size > 0, sums / np.maximum(size, 1), old)
            still = (np.abs(new - old) <= 1e-8 + 1e-5 * np.abs(old)).all((1, 2))
            own[open_] = mine
            c[open_] = np.where(still[:, None, None], old, new)
            open_ = open_[~still]
            if not len(open_):
                break
    for a in range(0, d * 10, at_once):
        part = slice(a, a + at_once)
        far = x[part] - np.take_along_axis(c[part], own[part][:, :, None], 1)
        cost[part] = np.ascontiguousarray(far**2).reshape(len(far), -1).sum(1)
    best, score = np.zeros(d, np.int64), np.full(d, np.inf)
    for r, costs in enumerate(cost.reshape(d, 10).T):
        better = costs < score - 1e-12
        best, score = np.where(better, r, best), np.where(better, costs, score)
    return own.reshape(d, 10, n)[np.arange(d), best]


def _silhouette(x: np.ndarray, own: np.ndarray, step: int = 256) -> float:
    """Mean silhouette; distances are held for `step` rows at a time, fewer where there are many rows."""
    step = max(1, min(step, 20_000_000 // x.size))
    member = np.eye(own.max() + 1)[own]
    size, total = member.sum(0), 0.0
    for a in range(0, len(x), step):
        part = own[a : a + step]
        sums = np.sqrt(((x[a : a + step, None] - x) ** 2).sum(2)) @ member
        at = np.arange(len(part))
        inner = sums[at, part] / np.maximum(size[part] - 1, 1)
        sums = np.where(size > 0, sums / np.maximum(size, 1), np.inf)
        sums[at, part] = np.inf
        outer = sums.min(1)
        most = np.maximum(inner, outer)
        total += np.where((size[part] > 1) & (most > 0), (outer - inner) / np.where(most > 0, most, 1), 0).sum()
    return total / len(x)


MEASURES = ["font_size", "is_bold", "is_italic", "y0", "height", "chars", "words"]


def _clusters(docs: list[np.ndarray]) -> list[tuple[np.ndarray, list[str]]]:
    """Cluster and label of each row of several documents (MEASURES by row); documents of a size go together."""
    out: list = [None] * len(docs)
    sizes: dict[int, list[int]] = {}
    for i, x in enumerate(docs):
        sizes.setdefault(len(x), []).append(i)
    for n, at in sizes.items():
        scaled = []
        for i in at:
            sd = docs[i].std(0)
            scaled.append((docs[i] - docs[i].mean(0)) / np.where(sd > 0, sd, 1))
        tried: dict[int, list] = {j: [] for j in range(len(at))}
        if n < 4:
            for j, own in enumerate(_kmeans(np.array(scaled), min(n, 3))):
                tried[j].append(own)
        else:
            distinct = [len(set(map(bytes, np.ascontiguousarray(x + 0.0)))) for x in scaled]  # + 0.0: no negative zeros
            for k in range(2, min(7, n)):
                some = [j for j in tried if k <= distinct[j]]
                if some:
                    for j, own in zip(some, _kmeans(np.array([scaled[j] for j in some]), k), strict=True):
                        tried[j].append(own)
        for j, i in enumerate(at):
            found = tried[j]
            if n < 4:
                own = found[0]
            else:
                own = max(found, key=lambda o: _silhouette(scaled[j], o) if (o != o[0]).any() else -1) if found else np.zeros(n, np.int64)  # noqa: B023
            out[i] = own, _labels(docs[i], own)
    return out


def _labels(x: np.ndarray, own: np.ndarray) -> list[str]:
    """The rank of each row's cluster among those that look like headings."""
    scores = {}
    for j in np.unique(own).tolist():
        part = x[own == j]
        scores[j] = 0.5 * part[:, 0].mean() / 12 + 0.3 * part[:, 1].mean() + 0.2 / (1 + part[:, 6].mean() / 10)
    order = sorted(((s, j) for j, s in scores.items()), reverse=True)
    names = {j: f"H{i + 1}" if i < 6 and s > 1 else "TEXT" for i, (s, j) in enumerate(order)}
    return [names[j] for j in own.tolist()]


def _cluster_batches(batches):
    """Batches of rows in order of document and seq; a document that a batch cuts off waits for the next."""
    held = None

    def done(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[MEASURES].to_numpy(float)
        cuts = np.flatnonzero(np.diff(pdf["doc_id"].to_numpy())) + 1
        found = _clusters(np.split(x, cuts))
        return pdf[["doc_id", "seq"]].assign(cluster_id=np.concatenate([own for own, _ in found]), label=list(itertools.chain.from_iterable(names for _, names in found)))

    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        last = pdf["doc_id"].to_numpy() == pdf["doc_id"].iloc[-1] if len(pdf) else np.zeros(0, bool)
        held = pdf[last].reset_index(drop=True)
        if not last.all():
            yield done(pdf[~last])
    if held is not None and len(held):
        yield done(held)


SCAN = Plan([whole], lambda d: PLANS["block_scan"].select(d))


def whole_scan(docs: DataFrame) -> DataFrame:
    """Blocks of all pages."""
    return _run(SCAN(SPARK), docs, "documents")


def font_clusters(docs: DataFrame) -> DataFrame:
    b = whole_scan(docs)
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    x = b.select("doc_id", "seq", "font_size", F.col("is_bold").cast("int").alias("is_bold"), F.col("is_italic").cast("int").alias("is_italic"), "y0", (F.col("y1") - F.col("y0")).alias("height"), F.length("text").alias("chars"), words.alias("words"))
    return x.repartition("doc_id").sortWithinPartitions("doc_id", "seq").mapInPandas(_cluster_batches, "doc_id long, seq int, cluster_id long, label string")


def cluster_profiles(blocks: DataFrame, clusters: DataFrame) -> DataFrame:
    """Of each fitted cluster of a document: size, means, bold share, label and its first three texts."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    mean = lambda c, name: F.round(F.avg(c.cast("double")), 6).alias(name)
    nth = F.row_number().over(Window.partitionBy("doc_id", "cluster_id", "label").orderBy("seq"))
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= 3, F.struct("seq", "text")))), lambda x: x["text"]), " | ").alias("sample_texts")
    return blocks.join(clusters, ["doc_id", "seq"]).withColumn("nth", nth).groupBy("doc_id", "cluster_id", "label").agg(F.count(F.lit(1)).alias("size"), mean(F.col("font_size"), "avg_font_size"), mean(F.col("y0"), "avg_y_position"), mean(F.col("is_bold").cast("int"), "bold_ratio"), mean(words, "avg_word_count"), mean(F.length("text"), "avg_text_length"), first)


def cluster_statistics(profiles: DataFrame) -> DataFrame:
    """Clusters of each document: how many, how many of headings and of text, and the levels among them."""
    levels = F.array_join(F.array_sort(F.collect_set("label")), ",")
    return profiles.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_clusters"), F.count_if(F.col("label").startswith("H")).alias("heading_clusters"), F.count_if(F.col("label") == "TEXT").alias("text_clusters"), levels.alias("hierarchy_levels"))


#: Headings of the generator by level, and of other languages; placeholders in braces (fixed values).
HEADING_TEMPLATES = {1: ["{n}. {topic}", "Chapter {n}: {topic}", "{topic}"], 2: ["{n}.{m} {topic}", "{topic} and {other}", "Section {n}: {topic}"], 3: ["{n}.{m}.{k} {topic}", "({k}) {topic}", "{topic} of {other}"]}
TEXT_TEMPLATES = ["The section continues with sentence {n}.", "This paragraph discusses {topic} in relation to {other}.", "As shown in Table {n}, the {topic} of the system improves {other}.", "In this work we consider {topic}, which is important for {other}."]
TOPICS = ["Introduction", "Background", "Methodology", "Results", "Discussion", "Conclusion", "Overview", "Summary"]
LANGUAGE_TEMPLATES = {"japanese": ["第{n}章 概要", "第{n}節 結論"], "chinese": ["第{n}章 引言", "第{n}节 概述"], "french": ["Chapitre {n} Introduction", "Section {n} Résumé"], "german": ["Kapitel {n} Einführung", "Abschnitt {n} Zusammenfassung"], "spanish": ["Capítulo {n} Introducción", "Sección {n} Resumen"]}


def _filled(templates: list[str], at: Column) -> Column:
    """The template at a place, from a number between 0 and 1, with its placeholders filled."""
    pick = lambda xs, r: F.element_at(F.array(*[F.lit(x) for x in xs]), (r * len(xs)).cast("int") + 1)
    text = pick(templates, at)
    for k, (name, r) in enumerate((("n", "r5"), ("m", "r7"), ("k", "r8"))):
        text = F.replace(text, F.lit(f"{{{name}}}"), ((F.col(r) * 9).cast("int") + 1 + k).cast("string"))
    return F.replace(F.replace(text, F.lit("{topic}"), pick(TOPICS, F.col("r9"))), F.lit("{other}"), pick(TOPICS, F.col("r10")))


def synthetic_blocks(spark: SparkSession, n: int = 2000, seed: int = 42) -> DataFrame:
    """n labelled blocks: four in ten are headings of three levels, with texts, sizes, weights and places of their kind."""
    r = lambda k: F.rand(seed + k)
    kind = F.when(r(0) < 0.4, F.floor(r(1) * 3).cast("int") + 1).otherwise(0)
    df = spark.range(n).select("id", kind.alias("kind"), *[r(k).alias(f"r{k}") for k in range(2, 11)])
    pick = lambda a, b, c, d: F.when(F.col("kind") == 1, a).when(F.col("kind") == 2, b).when(F.col("kind") == 3, c).otherwise(d)
    low, span, bold = pick(16.0, 14.0, 12.0, 10.0), pick(8.0, 4.0, 4.0, 2.0), pick(0.9, 0.8, 0.6, 0.1)
    text = pick(*[_filled(HEADING_TEMPLATES[k], F.col("r6")) for k in (1, 2, 3)], _filled(TEXT_TEMPLATES, F.col("r6")))
    return df.select("id", text.alias("text"), ((F.col("r2") * 50).cast("int") + 1).alias("page"), F.round(low + F.col("r2") * span, 2).alias("font_size"), (F.col("r3") < bold).alias("is_bold"), F.round(F.when(F.col("kind") > 0, 50 + F.col("r4") * 100).otherwise(72 + F.col("r4") * 128), 2).alias("x0"), F.when(F.col("kind") > 0, F.concat(F.lit("H"), "kind")).alias("suggested_level"), F.when(F.col("kind") > 0, "heading").otherwise("text").alias("label"))


def multilingual_blocks(spark: SparkSession, n: int = 400, seed: int = 7) -> DataFrame:
    """n headings in five other languages, dealt out in turn."""
    names = list(LANGUAGE_TEMPLATES)
    df = spark.range(n).select("id", (F.col("id") % len(names)).cast("int").alias("at"), *[F.rand(seed + k).alias(f"r{k}") for k in range(2, 11)])
    text = F.coalesce(*[F.when(F.col("at") == k, _filled(LANGUAGE_TEMPLATES[x], F.col("r6"))) for k, x in enumerate(names)])
    return df.select("id", text.alias("text"), F.element_at(F.array(*[F.lit(x) for x in names]), F.col("at") + 1).alias("language"), F.round(14 + F.col("r2") * 6, 2).alias("font_size"), F.lit(True).alias("is_bold"), F.lit("heading").alias("label"))


def _as_rows(blocks: DataFrame) -> DataFrame:
    """Training rows of generated blocks, each a page of its own text's measures."""
    size = F.col("font_size")
    place = blocks.select((F.col("id") / 25).cast("long").alias("doc_id"), F.col("id").cast("int").alias("seq"), (F.coalesce("page", F.lit(1)) - 1).cast("int").alias("page") if "page" in blocks.columns else F.lit(0).alias("page"), "text", size.alias("font_size"), "is_bold", F.lit(False).alias("is_italic"), (F.col("x0") if "x0" in blocks.columns else F.lit(72.0)).alias("x0"), ((F.col("id") % 25) * 30.0).alias("y0"), F.lit(400.0).alias("x1"), ((F.col("id") % 25) * 30.0 + size).alias("y1"))
    return run_on_blocks("ml_features", place).join(blocks.select(F.col("id").cast("int").alias("seq"), (F.col("label") == "heading").cast("double").alias("label")), "seq")


def train_from_synthetic(spark: SparkSession, kind: str = "forest", n: int = 2000, other: int = 400) -> PipelineModel:
    """Fits on generated blocks and headings in other languages."""
    blocks = synthetic_blocks(spark, n).select("id", "text", "page", "font_size", "is_bold", "x0", "label")
    more = multilingual_blocks(spark, other).select((F.col("id") + n).alias("id"), "text", F.lit(1).alias("page"), "font_size", "is_bold", F.lit(72.0).alias("x0"), "label")
    return train(_as_rows(blocks.unionByName(more)), kind)


def train_from_real(rows: DataFrame, blocks: int = 1000, kind: str = "forest") -> PipelineModel:
    """Fits on labelled rows, variations of their headings (a size up, moved by 20) and generated blocks."""
    heads = rows.where("label = 1")
    moved = heads.withColumn("x_position", F.col("x_position") + 20)
    larger = heads.withColumn("font_size", F.col("font_size") + 1)
    made = _as_rows(synthetic_blocks(rows.sparkSession, blocks).select("id", "text", "page", "font_size", "is_bold", "x0", "label"))
    columns = ["doc_id", "seq", *FEATURES, "label"]
    return train(functools.reduce(DataFrame.unionByName, (x.select(*columns) for x in (rows, moved, larger, made))), kind)


def lightweight_model(rows: DataFrame) -> PipelineModel:
    """A few shallow trees on the features that matter most."""
    stages = pipeline("forest", select_features(rows, 10)).getStages()
    return Pipeline(stages=[*stages[:2], stages[2].copy({stages[2].numTrees: 20, stages[2].maxDepth: 5})]).fit(sample(rows))


def with_probability(features: DataFrame, predicted: DataFrame) -> DataFrame:
    """The comprehensive rows with a model's probability and confidence, the distance from one half, doubled."""
    p = F.coalesce("probability", F.lit(0.0))
    both = features.drop("ml_heading_probability", "ml_confidence").join(predicted.select("doc_id", "seq", "probability"), ["doc_id", "seq"], "left")
    return both.withColumn("ml_heading_probability", p).withColumn("ml_confidence", F.when(F.col("probability").isNull(), 0.0).otherwise(F.abs(p - 0.5) * 2)).drop("probability")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(training_blocks(_docs(spark, sf_dir)))


def _scored(fit: Callable[[DataFrame], PipelineModel]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _rows(spark, sf_dir)
        return predict(fit(rows), rows)

    return query


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return cluster_profiles(whole_scan(docs), font_clusters(docs))


QUERIES = {
    "predict_forest": _scored(lambda rows: train(rows, "forest")),
    "predict_boosting": _scored(lambda rows: train(rows, "boosting")),
    "predict_logistic": _scored(lambda rows: train(rows, "logistic")),
    "cross_validation": lambda spark, sf_dir: cross_validate(_rows(spark, sf_dir)),
    "cross_validation_summary": lambda spark, sf_dir: cross_validation_summary(cross_validate(_rows(spark, sf_dir))),
    "grid_search": lambda spark, sf_dir: grid_search(_rows(spark, sf_dir)),
    "grid_search_forest": lambda spark, sf_dir: grid_search(_rows(spark, sf_dir), "forest", grids(small=True)["forest"]),
    "grid_search_boosting": lambda spark, sf_dir: grid_search(_rows(spark, sf_dir), "boosting", [{"maxIter": 5, "maxDepth": 3}, {"maxIter": 10, "maxDepth": 3}]),
    "mutual_information": lambda spark, sf_dir: mutual_information(_rows(spark, sf_dir)),
    "feature_importance": lambda spark, sf_dir: feature_importance(_rows(spark, sf_dir)),
    "font_clusters": lambda spark, sf_dir: font_clusters(_docs(spark, sf_dir)),
    "cluster_profiles": _profiles,
    "cluster_statistics": lambda spark, sf_dir: cluster_statistics(_profiles(spark, sf_dir)),
    "synthetic_blocks": lambda spark, sf_dir: synthetic_blocks(spark),
    "multilingual_blocks": lambda spark, sf_dir: multilingual_blocks(spark),
    "predict_from_synthetic": lambda spark, sf_dir: predict(train_from_synthetic(spark), training_blocks(_docs(spark, sf_dir))),
    "predict_from_real": _scored(train_from_real),
    "predict_lightweight": _scored(lightweight_model),
}
