"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio of target and raw corpus.

Words and word pairs are hashed into `BUCKETS`. One multinomial over the buckets is counted over *every*
document (raw corpus), another over trusted documents (target). A document's score is the sum over its
n-grams of log p_target - log p_raw, in whole millionths so that it doesn't depend on the order of
addition, divided by its n-grams. The threshold is `FENCE` interquartile ranges below the lower quartile of the
trusted documents' scores, so it follows the model and the corpus; it decides on every document.

DataFrame functions only. The target is every document with a trusted id; a shuffled join, which grows with
both tables, marks them before the bucket counts, and neither count has a bound. The model is one array
of BUCKETS numbers, read as a scalar subquery. Scoring and all base counts are one projection over
the texts with no exchange. The scores are written as a narrow table, and the quartiles come from the
counts of scores in steps of `STEP`, of which there are some 10 ** 5 at most, whatever the input.

Defined results: null or wordless texts have zero counts, fail the base rule and have a null score; a
text with words always has a score; the base rule's failures don't count for the quartiles; labels without id or label are no targets, and a document counts
once however often it is labelled; repeated documents are scored each; without target rows nothing is
trusted, every score is 0 and so is the threshold; an empty table gives an empty table. Only named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixing import SPACES
from .rows import named
from .store import Scratch

BUCKETS = 1 << 14
FENCE, STEP = 6, 100


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \t-\r]+"))


def _grams(words: str) -> Column:
    """Bucket numbers of all words and of all pairs of neighbours."""
    one = F.transform(words, lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int"))
    two = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda x, y: F.pmod(F.xxhash64(x, y), F.lit(BUCKETS)).cast("int"))
    return F.concat(one, two)


def _repeat_words(triples: str) -> Column:
    """Words covered by triples that occur twice or more, given the sorted (hash, position) of all triples."""
    found = F.filter(triples, lambda x, k: ((k > 0) & (F.get(triples, k - 1)["h"] == x["h"])) | F.coalesce(F.get(triples, k + 1)["h"] == x["h"], F.lit(False)))
    return F.sort_array(F.transform(found, lambda x: x["i"]))


def base_counts(rows: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to rows of (text, words)."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    n = F.size("words")
    last = F.greatest(n - 3, F.lit(0))
    triples = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i")))
    rows = rows.withColumns({"_lines": lines, "_triples": F.when(n >= 3, F.sort_array(triples)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))})
    rows = rows.withColumn("_at", _repeat_words("_triples"))
    covered = F.aggregate(F.transform("_at", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    chars = F.char_length(F.translate("text", SPACES, ""))
    return rows.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": chars.cast("long"),
            "n_symbols": (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": covered.cast("long"),
        }
    ).drop("_lines", "_triples", "_at")


def fit(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: `model`, an array of BUCKETS log ratios in millionths (no row's n-grams ever meet)."""
    texts = docs.select(named(id_col).alias("_id"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"))
    picked = trusted.select(named(id_col).alias("_id")).where("_id is not null").distinct()
    marked = texts.join(picked.withColumn("_t", F.lit(1)).hint("shuffle_hash"), "_id", "left")  # never broadcast: the ids grow with the corpus
    marked = marked.select("_t", _words(F.col("text")).alias("words"))  # split only here: texts take less than half the shuffle of their words
    counts = marked.select("_t", F.explode(_grams("words")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.count("_t").alias("target"))
    buckets = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    full = buckets.join(counts, "bucket", "left").select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    model = full.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("c"), F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"))
    ratio = lambda x: F.round(1e6 * (F.log((x["target"] + 1) / (F.col("n_target") + BUCKETS)) - F.log((x["raw"] + 1) / (F.col("n_raw") + BUCKETS)))).cast("int")
    return model.select(F.when(F.col("n_target") > 0, F.transform("c", ratio)).otherwise(F.array_repeat(F.lit(0), BUCKETS)).alias("model"))


def score(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, the base counts, base_failed and score (millionths of a nat per n-gram)."""
    rows = docs.select(named(id_col).alias("_id"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text")).withColumn("words", _words(F.col("text")))
    rows = base_counts(rows).withColumns({"_grams": _grams("words"), "_model": model.scalar()})
    total = F.aggregate("_grams", F.lit(0).cast("long"), lambda a, g: a + F.get("_model", g))
    rows = rows.withColumn("score", F.when(F.size("_grams") > 0, F.floor(total / F.size("_grams"))).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "score")


def fence(scores: DataFrame, trusted: DataFrame, id_col: str = "doc_id", ranges: int = FENCE) -> DataFrame:
    """One row: `threshold`, from the quartiles of the trusted documents' scores (whole steps of STEP)."""
    picked = trusted.select(named(id_col).alias("_id")).where("_id is not null").distinct()
    steps = scores.where("not base_failed and score is not null").select(F.col(id_col).alias("_id"), F.floor(F.col("score") / STEP).alias("s"))
    steps = steps.join(picked.hint("shuffle_hash"), "_id", "left_semi").groupBy("s").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(F.lit(0)).orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    ranked = steps.select("s", F.sum("n").over(upto).alias("upto"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("all"))
    quartile = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("all"), F.col("s") * STEP))
    return ranked.agg(F.coalesce(quartile(1) - ranges * (quartile(3) - quartile(1)), F.lit(0)).alias("threshold"))


def judge(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`score` of every document by the model of these documents, with the verdict `kept`."""
    scratch = Scratch(docs.sparkSession, "quality")
    model = scratch.table(fit(docs, trusted, id_col, text_col))
    scores = scratch.table(score(docs, model, id_col, text_col), model)
    threshold = scratch.table(fence(scores, trusted, id_col))
    return scores.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold.scalar(), F.lit(False)))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1"))
