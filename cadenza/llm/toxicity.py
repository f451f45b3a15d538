"""Toxicity by a classifier chain.

The categories of the chain are predicted one after another by linear models. Each later model has the
words of a text and the probabilities of all earlier categories as inputs; in training these are
out-of-fold predictions (`FOLDS` folds), so a later model learns from probabilities as good as those it
will see. The features, too, are chosen for each fold from the other folds' rows only. The last link,
`toxic`, is trained on the label itself.

Where the label table has category columns, they are the earlier links. Where it has none, as `labels`, the
categories are learned: `CATEGORIES` groups of the toxic training texts that share informative words, by
spherical k-means from fixed starting points, the largest first. No word is given beforehand.

The chain is fitted on the driver on the `SAMPLE` labelled documents that are lowest by a hash of the id; of
several texts under one id the least by its hash counts. Features are whole words and word beginnings of
`PREFIXES` bytes in `SUPPORT` texts or more, the `FEATURES` that tell most by a likelihood-ratio test. Each
counts twice: whether it stands in the text at all, and how often in a hundred words (its logarithm). An
L1 penalty leaves few of them. Every document is scored, in full, in one pass without exchange.

Defined results: null or wordless texts are not toxic and have the probabilities of no words;
labels that are null or conflict count as their maximum; without any toxic label nothing is toxic; extra
columns of any names pass through untouched; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import prepare
from .linear import fit_logistic, predict
from .rows import named
from .store import Scratch
from .words import ALNUM, U64, Words, pack, slices

SAMPLE, FEATURES, FOLDS, THRESHOLD, SUPPORT = 6_000, 128, 5, 0.5, 3
PREFIXES, L1 = range(4, 10), 2e-4
CATEGORIES, ROUNDS = 3, 25
CHAIN = (*(f"group{k + 1}" for k in range(CATEGORIES)), "toxic")


def _features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and word beginnings, and the row of each."""
    row = w.row()
    h, at = [w.h], [row]
    for size in PREFIXES:
        long, part = w.prefix(size)
        h.append(part)
        at.append(row[long])
    return np.concatenate(h), np.concatenate(at)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each feature of each text."""
    for batch in batches:
        for part in slices(batch, "text"):
            h, row = _features(Words(part.column("text"), ALNUM, True, prefixes=True))
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            of = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), part.column("y").take(of), part.column("fold").take(of)], ["h", "y", "fold"])


def _counted(words):
    """How often the chosen words stand in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"), ALNUM, True, prefixes=True)
                counts = counts_of(words.value, *_features(w), w.rows).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column("y"), part.column("more"), part.column("fold"), pa.array(w.counts(), pa.int64()), pa.array([pack(c) for c in counts], pa.binary())], ["y", "more", "fold", "n", "counts"])

    return run


class Chain:
    """The fitted chain: sorted word hashes, and each link's name and weights."""

    def __init__(self, words: np.ndarray, links: list[np.ndarray], names: tuple[str, ...] = CHAIN) -> None:
        self.words, self.links, self.names = words, links, names

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.links)))
        for k, w in enumerate(self.links):
            out[:, k] = predict(w, np.hstack([x, out[:, :k]]))
        return out


def counts_of(words: np.ndarray, h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """How often each of the sorted `words` stands in each row."""
    if not len(words) or not len(h):
        return np.zeros((rows, len(words)))
    near = np.minimum(np.searchsorted(words, h), len(words) - 1)
    hit = words[near] == h
    return np.bincount(row[hit] * len(words) + near[hit], minlength=rows * len(words)).reshape(rows, len(words)).astype(np.float64)


def inputs_of(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Presence and rate of each word."""
    return np.hstack([counts > 0, np.log1p(100 * counts / np.maximum(n, 1)[:, None])])


def _statistics(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(h, a, b, a0, b0, a1, ...): in how many toxic texts (a) and texts (b) a feature stands, in all and in each fold."""
    found = texts.select("y", "fold", "text").mapInArrow(_distinct, "h long, y int, fold int").groupBy("h")
    folds = [F.sum(F.when(F.col("fold") == k, v).otherwise(F.lit(0))).alias(f"{c}{k}") for k in range(FOLDS) for c, v in (("a", F.col("y")), ("b", F.lit(1)))]
    return scratch.table(found.agg(F.sum("y").alias("a"), F.count("*").alias("b"), *folds).where(F.col("b") >= SUPPORT))


def _informative(counts: DataFrame, n1: int, n0: int, most: int, without: int | None = None) -> np.ndarray:
    """The features with the greatest likelihood-ratio statistic among those more common in toxic texts.

    n1 toxic and n0 other texts count; `without` leaves the texts of a fold out."""
    if not n1 or not n0 + n1:
        return np.zeros(0, U64)
    a, b = (F.col(c) - (F.lit(0) if without is None else F.col(f"{c}{without}")) for c in ("a", "b"))
    found = counts.select("h", a.alias("a"), b.alias("b")).where((F.col("b") >= SUPPORT) & (F.col("a") * n0 > (F.col("b") - F.col("a")) * n1))
    part = lambda a, n, b: F.when(a > 0, a * F.log(a * (n1 + n0) / (b * n))).otherwise(F.lit(0.0))
    a, b = F.col("a"), F.col("b")
    rest = n1 + n0 - b
    g = part(a, n1, b) + part(b - a, n0, b) + part(n1 - a, n1, rest) + part(n0 - (b - a), n0, rest)
    rows = found.select("h", F.round(g, 9).alias("g")).orderBy(F.desc("g"), "h").limit(most).collect()
    return np.sort(np.array([r.h for r in rows], np.int64).view(U64))


def latent_groups(counts: np.ndarray, groups: int = CATEGORIES, rounds: int = ROUNDS) -> np.ndarray:
    """A group (0 the largest) for each row of feature counts; -1 for rows without any feature.

    Spherical k-means on the features' presence. The first centre is the row nearest to the mean, each
    further one the row farthest from all centres; ties go to the first row."""
    x = (counts > 0).astype(np.float64)
    size = np.sqrt(x.sum(1))
    x = x / np.maximum(size, 1)[:, None]
    some = np.flatnonzero(size)
    out = np.full(len(x), -1)
    if not len(some):
        return out
    points = x[some]
    centres = points[[int((points @ points.mean(0)).argmax())]]
    while len(centres) < min(groups, len(points)):
        near = (points @ centres.T).max(1)
        if near.min() > 1 - 1e-9:
            break
        centres = np.vstack([centres, points[int(near.argmin())]])
    of = None
    for _ in range(rounds):
        now = (points @ centres.T).argmax(1)
        if of is not None and (now == of).all():
            break
        of = now
        for k in range(len(centres)):
            if (of == k).any():
                mean = points[of == k].mean(0)
                centres[k] = mean / np.linalg.norm(mean)
    sizes = np.bincount(of, minlength=len(centres))
    out[some] = np.argsort(np.argsort(-sizes, kind="stable"), kind="stable")[of]
    return out


def fit_chain(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", category_cols: tuple[str, ...] = ()) -> Chain:
    """The chain fitted on labelled documents; the driver holds `sample` rows of about 2 * FEATURES numbers."""
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "toxicity")
    names = (*category_cols, "toxic") if category_cols else CHAIN
    more = F.array(*[F.max(named(c)).cast("int") for c in category_cols]).cast("array<int>")
    picked = labels.where(named(id_col).isNotNull() & named(label_col).isNotNull()).groupBy(named(id_col).alias("_id")).agg(F.max(named(label_col)).cast("int").alias("y"), more.alias("more"))
    picked = picked.withColumn("h", F.md5(F.col("_id").cast("string").cast("binary"))).orderBy("h", "_id").limit(sample)
    picked = picked.select("_id", "y", "more", F.pmod(F.crc32(F.col("_id").cast("string").cast("binary")), F.lit(FOLDS)).cast("int").alias("fold"))
    picked = scratch.table(picked, files=1)
    texts = docs.select(named(id_col).alias("_id"), named(text_col).cast("string").alias("text")).join(F.broadcast(picked), "_id")  # `sample` rows at most
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    texts = scratch.table(texts.groupBy("_id").agg(one, F.first("y").alias("y"), F.first("more").alias("more"), F.first("fold").alias("fold")))  # a row an id
    sizes = {(r.y, r.fold): r["count"] for r in texts.groupBy("y", "fold").count().collect()}
    total = lambda y, without=None: sum(n for (label, fold), n in sizes.items() if label == y and fold != without)
    if not total(1):
        return Chain(np.zeros(0, U64), [np.array([*np.zeros(k), -30.0]) for k in range(len(names))], names)
    counted = _statistics(texts, scratch)
    chosen = {k: _informative(counted, total(1, k), total(0, k), FEATURES, k) for k in (None, *range(FOLDS))}
    words = np.unique(np.concatenate(list(chosen.values())))
    rows = texts.mapInArrow(_counted(spark.sparkContext.broadcast(words)), "y int, more array<int>, fold int, n long, counts binary").collect()  # `sample` rows at most
    rows.sort(key=lambda r: (r.y, r.fold, r.n, r.more, bytes(r.counts)))  # no order of arrival in the fit
    counts = np.stack([np.frombuffer(r.counts, np.float32) for r in rows]).astype(np.float64)
    y, fold, n = np.array([r.y for r in rows], np.float64), np.array([r.fold for r in rows]), np.array([r.n for r in rows])
    if category_cols:
        targets = [np.array([r.more[k] or 0 for r in rows], np.float64) for k in range(len(category_cols))]
    else:
        group = np.full(len(rows), -1)
        group[y > 0] = latent_groups(counts[y > 0][:, np.isin(words, chosen[None])])
        targets = [(group == k).astype(np.float64) for k in range(CATEGORIES)]
    inputs = {k: inputs_of(counts[:, np.isin(words, chosen[k])], n) for k in chosen}
    links, earlier = [], np.zeros((len(rows), 0))
    for target in [*targets, y]:
        links.append(fit_logistic(np.hstack([inputs[None], earlier]), target, l1=L1))
        out = np.zeros(len(rows))
        for k in range(FOLDS):
            x, left_out = np.hstack([inputs[k], earlier]), fold == k
            out[left_out] = predict(fit_logistic(x[~left_out], target[~left_out], l1=L1), x[left_out])
        earlier = np.hstack([earlier, out[:, None]])
    return Chain(chosen[None], links, names)


def _score(chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = chain.value
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"), ALNUM, True, prefixes=True)
                p = model.probabilities(inputs_of(counts_of(model.words, *_features(w), w.rows), w.counts()))
                yield pa.RecordBatch.from_arrays([part.column("row"), *(pa.array(p[:, k]) for k in range(len(model.names)))], ["row", *(f"p_{c}" for c in model.names)])

    return run


def score_toxicity(docs: DataFrame, chain: Chain, carry: list[str], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(row, p_<category> ..., is_toxic), where `row` is a struct of the columns in `carry`."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.struct(*[named(c).alias(c) for c in carry]).alias("row"), named(text_col).cast("string").alias("text"))
    kinds = StructType([rows.schema["row"], *(StructField(f"p_{c}", DoubleType()) for c in chain.names)])
    scored = rows.mapInArrow(_score(spark.sparkContext.broadcast(chain)), kinds)
    return scored.withColumn("is_toxic", F.col("p_toxic") >= threshold)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chain = fit_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, chain, ["doc_id"]).select("row.doc_id", *(f"p_{c}" for c in CHAIN), F.col("is_toxic").alias("toxic"))
