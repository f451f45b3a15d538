"""Language ID by error-correcting output codes.

Every language has a codeword; one binary linear classifier per bit, on hashed byte trigrams of the
letters, predicts whether a text's language has that bit set. A text gets the language whose codeword is
nearest by loss-weighted decoding: each bit's logistic loss counts as much as that bit's classifier was
right on that language in training. A small lead over the second codeword flags the text as ambiguous.

Up to `EXHAUSTIVE` languages get the exhaustive code (2 ** (k - 1) - 1 bits), more get a seeded dense code of
10 log2 k bits. The classifiers are fitted on the driver, on at most `SAMPLE` documents, evenly from each
language, the lowest by a hash of id and text; documents equal in both count once. Of more than `SAMPLE`
languages the most common ones are learned. Every document is scored in full, in one pass.

Defined results: null texts and texts without a letter are `und` with score 0; documents with null
language, or held out, are never learned from; with no language learned everything is `und`, with one
everything else is that one; rows without id are not held out (crc32 of the empty string is 0), repeated
rows are scored each; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import prepare
from .linear import fit_logistic
from .rows import named
from .store import Scratch
from .words import pack, slices, utf8

DIMS, SAMPLE, STEPS, EXHAUSTIVE, MARGIN = 4096, 4000, 200, 7, 0.2
_BITS = DIMS.bit_length() - 1
_RANGE = 1 << 62
_b = np.arange(256)
_lower = np.where((_b >= 0x41) & (_b <= 0x5A), _b + 32, _b)
#: Letters in lower case, every other ASCII character as a space.
_LETTERS = np.where(((_lower >= 0x61) & (_lower <= 0x7A)) | (_b >= 0x80), _lower, 0x20).astype(np.uint8)


def features(column: pa.Array) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams, a row for each text; a space stands at either end."""
    data, off = utf8(column)
    rows = len(off) - 1
    x = np.zeros((rows, DIMS), np.float32)
    low = np.full(len(data) + 2 * rows, 0x20, np.uint32)
    low[np.arange(len(data)) + 2 * np.repeat(np.arange(rows), np.diff(off)) + 1] = _LETTERS[data]
    code = low[:-2] | low[1:-1] << 8 | low[2:] << 16  # from each byte on, over the whole slice
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - _BITS)
    blank = code == 0x202020
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        inside = slice(a + 2 * i, b + 2 * i)
        n = np.bincount(bucket[inside][~blank[inside]], minlength=DIMS)
        total = int(n.sum())
        if total:
            x[i] = np.sqrt(n / total)
    return x


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def codewords(k: int) -> np.ndarray:
    """k x bits of +1 and -1; every column splits the languages."""
    if k < 2:
        return np.zeros((k, 0), np.int8)
    if k <= EXHAUSTIVE:
        bits = 2 ** (k - 1) - 1
        columns = np.arange(bits, dtype=np.int64)  # the first language has every bit set
        code = [np.ones(bits, np.int8)] + [np.where(columns >> (i - 1) & 1, 1, -1).astype(np.int8) for i in range(1, k)]
        return np.stack(code)
    bits = int(np.ceil(10 * np.log2(k)))
    best, apart = None, -1
    for seed in range(max(1, min(50, 5000 // k))):  # the search for a code takes a like time for any k
        code = np.where(np.random.default_rng(seed).random((k, bits)) < 0.5, 1, -1).astype(np.int8)
        least = min(int((code[i] != code[i + 1 :]).sum(1).min()) for i in range(k - 1))
        if least > apart and (np.abs(code.sum(0)) < k).all():
            best, apart = code, least
    return best if best is not None else code


class Model:
    """Languages, their codewords, each bit's weights and how much a bit says of a language."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, trust: np.ndarray) -> None:
        self.languages, self.code, self.weights, self.trust = languages, code, weights, trust

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its score (0 to 1), and the lead over the second in weighted loss."""
        if len(self.languages) < 2:
            return np.zeros(len(x), int), np.ones(len(x)), np.ones(len(x))
        f = x @ self.weights[:-1] + self.weights[-1]
        loss = np.stack([(np.logaddexp(0, -f * self.code[i]) * self.trust[i]).sum(1) for i in range(len(self.languages))], 1)
        order = np.sort(loss, 1)
        p = np.exp(order[:, :1] - loss)
        return loss.argmin(1), 1 / p.sum(1), order[:, 1] - order[:, 0]


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(named(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            x = features(part.column("text")).astype(np.float16)
            ok = [has_letter(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([pack(v) if k else None for v, k in zip(x, ok, strict=True)], pa.binary())], ["lang", "x"])


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from documents that have a language and are not held out."""
    scratch = Scratch(prepare(docs.sparkSession), "language")
    usable = docs.where(~held_out(id_col) & named(lang_col).isNotNull() & named(text_col).isNotNull())
    text = named(text_col).cast("string")
    usable = usable.select(named(lang_col).cast("string").alias("lang"), text.alias("text"), F.pmod(F.xxhash64(F.lit("lang"), named(id_col), text), F.lit(_RANGE)).alias("h"))
    counts = usable.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(sample)
    quota = F.greatest(F.lit(1), F.floor(F.lit(sample) / F.count("*").over(Window.partitionBy(F.lit(0)))))
    bounds = counts.select("lang", quota.alias("quota"), (F.lit(float(_RANGE)) * (1.5 * quota + 32) / F.col("n")).alias("below"))  # `sample` rows at most
    near = usable.select("lang", "h").join(F.broadcast(bounds), "lang").where("h < below").distinct()  # half as much again as will be taken
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where("r <= quota")
    chosen = scratch.table(ranked.select("lang", "h"), files=1)  # `sample` rows at most
    texts = usable.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    rows = texts.select("lang", "text").mapInArrow(_sampled, "lang string, x binary").where("x is not null").collect()
    rows.sort(key=lambda r: (r.lang, bytes(r.x)))  # no order of arrival in the fit
    languages = sorted({r.lang for r in rows})
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((DIMS + 1, 0)), np.zeros((len(languages), 0)))
    label = np.array([languages.index(r.lang) for r in rows])
    x = np.empty((len(rows), DIMS), np.float32)  # DIMS numbers a row
    for i, r in enumerate(rows):
        x[i] = np.frombuffer(r.x, np.float16)
    del rows
    weights = fit_logistic(x, (code[label] > 0).astype(np.float64), l2=1e-5, steps=STEPS)
    right = np.sign(x @ weights[:-1] + weights[-1]) == code[label]
    trust = np.stack([right[label == i].mean(0) for i in range(len(languages))])
    trust = trust / np.maximum(trust.sum(1, keepdims=True), 1e-9) * code.shape[1]
    return Model(languages, code, weights.astype(np.float32), trust)


def _predict(model, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                best, score, lead = m.decode(features(part.column("text")))
                ok = [bool(m.languages) and has_letter(t.as_py()) for t in part.column("text")]
                names = [m.languages[b] if k else "und" for b, k in zip(best.tolist(), ok, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(np.where(ok, score, 0.0), pa.float64()), pa.array(~np.array(ok, bool) | (lead < margin), pa.bool_())],
                    ["id", "held_out", "lang_pred", "score", "ambiguous"],
                )

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """One row per document: (id_col, held_out, lang_pred, score, ambiguous)."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(named(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), named(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_predict(spark.sparkContext.broadcast(model), margin), "id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
    return out.withColumnRenamed("id", id_col)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
