"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

The leaves (domain, language, source) form a tree. A token budget is handed down from the root: at each
node the children get shares in proportion to their weights; a child that holds less than its share (its
tokens times the epochs allowed) takes all it has, and what it leaves goes to its siblings, so an
ancestor redistributes only what a whole subtree can't hold. All shares are whole tokens and add up to
the parent's budget exactly. A leaf's budget buys whole epochs and then the longest prefix, in the seeded
order of the next epoch, that fits the rest.

The tables of the tree have a row for each leaf or node. Prefix sums in a leaf are bucketed (see
`prefix`), so the largest leaf spreads over thousands of windows.

Defined results: null domains, languages and sources are leaves named by the empty string; null texts
have no tokens; rows without tokens follow the same rule (they go with any prefix that reaches them);
repeated rows are drawn one by one; an empty table gives an empty table. Result columns that clash with
input columns replace nothing: the result has its own columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import running, seeded
from .rows import keyed, named, take
from .store import Scratch

SPACES = "\t\n\x0b\f\r "
LEVELS = ("domain", "lang", "source")
#: Production parameters: share of all tokens to draw, epochs allowed, weights by level (others weigh 1).
PERCENT, EPOCHS, SEED = 80, 2, "mix-1"
SALTS = 64
WEIGHTS: dict[str, dict[str, int]] = {"domain": {"d0": 3, "d1": 3, "d2": 2, "d3": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {}}


def word_count(text: Column) -> Column:
    """How many words `[^\\x20\\x09-\\x0D]+` a text has; none if null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, "[ \t-\r]+"))).cast("long")


def domain_of(source: Column) -> Column:
    """documents has no domain column: its number modulo 4 puts a source into one of four domains."""
    number = F.regexp_extract(source, "([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (number.cast("long") % 4).cast("string"))).otherwise(F.lit("none"))


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out


def _fill(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Adds `share` to nodes with (budget of the parent, w, cap): capped proportional shares, in whole tokens."""
    exact = "decimal(38,0)"
    by_fill = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), child)
    earlier = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rows = nodes.withColumns(
        {
            "_w_all": F.sum("w").over(Window.partitionBy(*parent)),
            "_w_before": F.coalesce(F.sum("w").over(earlier), F.lit(0)),
            "_c_before": F.coalesce(F.sum("cap").over(earlier), F.lit(0)),
        }
    )
    short = F.col("cap").cast(exact) * (F.col("_w_all") - F.col("_w_before")).cast("decimal(18,0)") <= (F.col("budget") - F.col("_c_before")).cast(exact) * F.col("w").cast("decimal(18,0)")
    rows = rows.withColumn("_full", F.min(F.when(short, F.lit(1)).otherwise(F.lit(0))).over(by_fill.rowsBetween(Window.unboundedPreceding, 0)))
    of = Window.partitionBy(*parent)
    rows = rows.withColumns({"_left": F.col("budget") - F.coalesce(F.sum(F.when(F.col("_full") == 1, F.col("cap"))).over(of), F.lit(0)), "_w_left": F.sum(F.when(F.col("_full") == 0, F.col("w")).otherwise(F.lit(0))).over(of)})
    rows = rows.withColumn("_w_to", F.sum(F.when(F.col("_full") == 0, F.col("w")).otherwise(F.lit(0))).over(by_fill.rowsBetween(Window.unboundedPreceding, 0)))
    cut = lambda upto: F.expr(f"cast((cast(_left as decimal(20,0)) * cast({upto} as decimal(18,0))) div cast(_w_left as decimal(18,0)) as bigint)")
    share = F.when(F.col("_full") == 1, F.col("cap")).otherwise(cut("_w_to") - cut("(_w_to - w)"))
    return rows.withColumn("share", share).drop("_w_all", "_w_before", "_c_before", "_full", "_left", "_w_left", "_w_to")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], percent: int, epochs: int) -> DataFrame:
    """`leaves` (LEVELS, tokens) with `leaf_budget` and `weight` (the product of shares asked for)."""
    cap = (F.col("tokens") * epochs).alias("cap")
    leaves = leaves.select(*LEVELS, "tokens", cap)
    root = leaves.agg(F.least(F.expr(f"sum(tokens) * {percent} div 100"), F.sum("cap")).alias("budget")).withColumn("_root", F.lit(0))
    parent: list[str] = []
    budgets = root
    for level in LEVELS:
        keys = [*parent, level]
        nodes = leaves.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("_root", F.lit(0)).join(budgets, ["_root", *parent])
        filled = _fill(nodes.withColumn("w", _weight(level, weights)), ["_root", *parent], level)
        budgets = filled.select("_root", *keys, F.col("share").alias("budget"))
        parent = keys
    return leaves.join(budgets.drop("_root"), list(LEVELS)).select(*LEVELS, F.col("tokens").alias("leaf_tokens"), F.col("budget").alias("leaf_budget"))


def draw(rows: DataFrame, scratch: Scratch, weights: dict[str, dict[str, int]] = WEIGHTS, percent: int = PERCENT, epochs: int = EPOCHS, seed: str = SEED, tie: str = "tie") -> DataFrame:
    """Adds leaf_tokens, leaf_budget and copies to rows of (id, LEVELS, n_tokens, tie); `tie` tells rows apart."""
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, weights, percent, epochs)
    # A leaf without tokens has no budget to divide.
    budgets = budgets.withColumn("_epochs", F.when(F.col("leaf_tokens") > 0, F.expr("leaf_budget div leaf_tokens")).otherwise(F.lit(0)))
    # Salted, or the rows of a large leaf would all be dealt to one task here and stay there.
    budgets = budgets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("id", tie), F.lit(SALTS)).cast("int")).join(budgets, [*LEVELS, "_salt"]).drop("_salt")
    rows = rows.withColumn("_order", seeded(seed, "_epochs", "id", tie))
    ranked = running(rows, list(LEVELS), "_order", F.col("n_tokens"), scratch)
    rest = F.col("leaf_budget") - F.col("_epochs") * F.col("leaf_tokens")
    part = F.when((rest > 0) & (F.col("before") + F.col("n_tokens") <= rest), F.lit(1)).otherwise(F.lit(0))
    return ranked.withColumn("copies", (F.col("_epochs") + part).cast("long")).drop("_epochs", "_order", "before", "total")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domain: Column | None = None, tie_col: str | None = None, **settings) -> DataFrame:
    """One row per document: (id_col, domain, lang, source, n_tokens, leaf_tokens, leaf_budget, copies, tie).

    `copies` is how many of the drawn epochs hold the document, 0 if none; `tie` tells rows of one id apart:
    `tie_col`, else md5(text). Only these rows are drawn from; no text goes through the exchanges.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    text, source = named(text_col).cast("string"), F.coalesce(named(source_col).cast("string"), F.lit(""))
    rows = docs.select(
        named(id_col).alias("id"),
        (domain_of(source) if domain is None else F.coalesce(domain.cast("string"), F.lit(""))).alias("domain"),
        F.coalesce(named(lang_col).cast("string"), F.lit("")).alias("lang"),
        source.alias("source"),
        word_count(text).alias("n_tokens"),
        (F.md5(F.coalesce(text, F.lit("")).cast("binary")) if tie_col is None else named(tie_col)).alias("tie"),
    )
    return draw(scratch.table(rows), scratch, **settings).withColumnRenamed("id", id_col)


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domain: Column | None = None, **settings) -> DataFrame:
    """The drawn documents with their own columns, each as often as it is drawn."""
    given = {} if domain is None else {"domain": domain}
    rows = keyed(docs, id_col, text=named(text_col), lang=named(lang_col), source=named(source_col), **given)
    drawn = mix_sources(rows, id_col="id", domain=F.col("domain") if given else None, tie_col="key", **settings)
    counts = drawn.groupBy("id", "tie").agg(F.count("*").alias("n"), F.sum("copies").alias("copies")).withColumnRenamed("tie", "key")
    return take(rows, counts, Scratch(docs.sparkSession, "mixed"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "domain", "lang", "source", "n_tokens", "leaf_tokens", "leaf_budget", "copies")
