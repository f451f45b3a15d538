"""WARC, mixing, components, scratch tables, the pipeline and the SQL of the registered queries."""

import base64
import collections
import gzip
import hashlib
import random

import pytest

import corpus_pipeline
from cadenza.llm import components, entry, mixing, stages, store, warc
from pyspark.sql import functions as F
from tests.oracle import compare, duck


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_sql(spark, small, con, name):
    compare(entry.QUERIES[name](spark, small), con, entry.ORACLES[name])


PAGES = [(1, "http://a/ b", "x"), (5, None, "same"), (3, "u\r\nEvil: 1", "same"), (9, "u", "same"), (4, "u", None), (2, "v", ""), (None, "w", "same"), (None, "w", "lonely"), (7, "z", "é" * 100_000), (7, "z", "é" * 100_000)]


def brute_warc(pages):
    least = {}
    for i, _, html in pages:
        if i is not None:
            least[html or ""] = min(i, least.get(html or "", i))
    out = []
    for i, _, html in pages:
        raw, first = (html or "").encode(), least.get(html or "")
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    return out


def test_warc(spark):
    scratch = store.Scratch(spark, "test")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    manifest = warc.write_warc(pages, scratch, f"{scratch.root}/w", roll=2000)
    rows = warc.read_warc(manifest, keep_payload=True).collect()
    number = lambda x: None if x in (None, "urn:page:") else int(x.removeprefix("urn:page:"))
    got = [(number(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in rows]
    assert sorted(got, key=str) == sorted(brute_warc(PAGES), key=str) and all(r.valid for r in rows)
    html = collections.Counter((number(r.record_id), bytes(r.payload).decode()) for r in rows if r.record_type == "response")
    assert html == collections.Counter((i, h or "") for (i, _, h), b in zip(PAGES, brute_warc(PAGES), strict=True) if b[3] == "response")
    assert {r.target_uri for r in rows} >= {None, "u Evil: 1"}
    assert manifest.count() > 1 and manifest.agg(F.sum("records")).first()[0] == len(PAGES)
    one = manifest.first().archive
    fs, path = warc.open_folder(one if one.startswith("file:") else f"file:{one}")
    assert gzip.decompress(fs.open_input_file(path).read()).startswith(b"WARC/1.1\r\n")


def test_warc_damage(tmp_path):
    member = warc._member("response", 1, "u", hashlib.sha1(b"body").hexdigest(), b"body", None)
    wrong = warc._member("response", 2, "u", hashlib.sha1(b"other").hexdigest(), b"body", None)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(member + wrong + member[:-20])
    rows = list(warc.read_archive(str(path), chunk=7))
    assert [r["error"] for r in rows] == [None, "the payload's digest differs", "the gzip member is cut off"]
    assert [r["offset"] for r in rows] == [0, len(member), len(member) + len(wrong)]
    path.write_bytes(member + b"rubbish")
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(str(path)))


def test_warc_empty(spark):
    scratch = store.Scratch(spark, "test")
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(warc.write_warc(none, scratch, f"{scratch.root}/w")).collect() == []


def brute_budget(tree, weights, budget, depth=0):
    """Hands a budget down a dict of dicts of capacities: {leaf path: share}."""
    cap = lambda t: t if isinstance(t, int) else sum(map(cap, t.values()))
    if isinstance(tree, int):
        return {(): budget}
    kids = sorted(tree, key=lambda k: (cap(tree[k]) / weights[depth].get(k, 1), k))
    share, left, w = {}, budget, sum(weights[depth].get(k, 1) for k in kids)
    open_ = []
    for k in kids:
        mine = weights[depth].get(k, 1)
        if not open_ and cap(tree[k]) * w <= left * mine:
            share[k] = cap(tree[k])
            left, w = left - share[k], w - mine
        else:
            open_.append(k)
    upto = 0
    for k in open_:
        mine = weights[depth].get(k, 1)
        share[k] = left * (upto + mine) // w - left * upto // w
        upto += mine
    return {(k, *rest): v for k in kids for rest, v in brute_budget(tree[k], weights, share[k], depth + 1).items()}


def test_budgets(spark):
    r = random.Random(3)
    for trial in range(6):
        leaves = {(f"d{r.randrange(3)}", r.choice("ab"), f"s{r.randrange(4)}"): r.choice([0, 1, 7, 100, 5000]) for _ in range(14)}
        weights = {"domain": {"d0": 5, "d1": 2}, "lang": {"a": 3}, "source": {"s0": 2}}
        df = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, lang string, source string, tokens long")
        percent, epochs = r.choice([(50, 1), (130, 2), (400, 2)])
        got = {(x.domain, x.lang, x.source): x.leaf_budget for x in mixing.leaf_budgets(df, weights, percent, epochs).collect()}
        tree = {}
        for (a, b, c), v in leaves.items():
            tree.setdefault(a, {}).setdefault(b, {})[c] = v * epochs
        total = min(sum(leaves.values()) * percent // 100, sum(leaves.values()) * epochs)
        assert got == brute_budget(tree, [weights["domain"], weights["lang"], weights["source"]], total)
        assert sum(got.values()) == total


def test_mixing_draws_prefixes(spark, odd, docs, empty):
    for table in (odd, docs):
        rows = mixing.mix_sources(table, percent=70, epochs=2).collect()
        assert len(rows) == table.count()
        by = collections.defaultdict(list)
        for x in rows:
            by[x.domain, x.lang, x.source].append(x)
        for group in by.values():
            drawn = sum(x.n_tokens * x.copies for x in group)
            assert drawn <= group[0].leaf_budget
            full = group[0].leaf_budget // group[0].leaf_tokens if group[0].leaf_tokens else 0
            assert {x.copies for x in group} <= {full, full + 1}
            rest = [x.n_tokens for x in group if x.copies == full]
            if rest and group[0].leaf_tokens:
                assert drawn + max(rest) > group[0].leaf_budget or min(rest) <= max(rest)
    assert mixing.mix_sources(empty).collect() == []
    kept = mixing.mix_rows(odd, percent=100, epochs=1)
    assert kept.columns == odd.columns


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(80)] + [(5, 5), (7, 3), (7, 3)]
    scratch = store.Scratch(spark, "test")
    got = {x.u: x.v for x in components.components(spark.createDataFrame(edges + [(None, 3)], "u long, v long"), scratch).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components.components(spark.createDataFrame([], "u long, v long"), scratch).collect() == []


def rows_of(df):
    return collections.Counter(map(str, df.select(sorted(df.columns)).collect()))


def test_stages(spark, docs, small):
    scratch, now = store.Scratch(spark, "test"), docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = scratch.table(stage(spark, now, small))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == now.columns
            assert not rows_of(out) - rows_of(now) and 0 < out.count() <= now.count(), name
        else:
            assert rows_of(out.drop("shard", "slot")) == rows_of(now)
        now = out
    assert rows_of(corpus_pipeline.run(spark, small)) == rows_of(now)


def test_stages_follow_their_operators(spark, docs, small):
    from cadenza.llm.decontamination import op6_benchmark_decontamination
    from cadenza.llm.minhash import near_duplicates

    ids = lambda df: sorted(x.doc_id for x in df.select("doc_id").collect())
    assert ids(stages.drop_contaminated(spark, docs, small)) == ids(op6_benchmark_decontamination(spark, small).where("not contaminated"))
    assert ids(stages.drop_near_duplicates(spark, docs, small)) == ids(near_duplicates(docs, percent=80).where("kept"))


def test_stages_on_odd_rows(spark, odd, empty, small):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, small)
        assert out.columns[: len(odd.columns)] == odd.columns and not rows_of(out.select(odd.columns)) - rows_of(odd), name
        assert stage(spark, empty, small).collect() == []
    kept = stages.drop_near_duplicates(spark, odd, small).collect()
    assert len([x for x in kept if x.doc_id == 1]) == 1 and not [x for x in kept if x.doc_id in (2, 9, 11)]


CLASH = ["total", "before", "slot", "_b", "_v", "_o", "my col", "row", "key", "id", "th", "n", "root", "shard", "copies", "a`b", "x.y", "fam", "node"]


@pytest.fixture(scope="module")
def clashing(odd):
    out = odd
    for i, c in enumerate(CLASH):
        out = out.withColumn(c, F.lit(i))
    return out.withColumn("bag", F.create_map(F.lit("k"), F.col("lang")))


def test_stages_with_clashing_names(spark, clashing, small):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clashing, small)
        mine = [c for c in clashing.columns if c not in ("shard", "slot")] if name == "sharding" else clashing.columns
        assert set(out.columns) == {*clashing.columns}
        quoted = ["`" + c.replace("`", "``") + "`" for c in mine]
        assert not rows_of(out.select(*quoted).toDF(*map(str, range(len(mine))))) - rows_of(clashing.select(*quoted).toDF(*map(str, range(len(mine))))), name


def test_operators_with_clashing_names(spark, clashing, odd, small):
    from cadenza.llm import decontamination, language_id, license_scan, minhash, quality_rules, substring_dedup, toxicity

    labels = spark.read.parquet(f"{small}/labels.parquet")
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    for run in (
        substring_dedup.remove_repeats,
        lambda d: quality_rules.score(d, quality_rules.fit(d, labels.where("quality = 1"))),
        lambda d: toxicity.score_toxicity(d, toxicity.fit_chain(d, labels), ["doc_id"]),
        lambda d: decontamination.find_matches(d, items),
        mixing.mix_sources,
        minhash.near_duplicates,
        lambda d: language_id.identify(d, language_id.fit(d)),
        lambda d: license_scan.scan(d, license_scan.build_index(d)),
    ):
        assert rows_of(run(clashing)) == rows_of(run(odd))


def kept_by_stage(spark, rows, small, stage=stages.drop_near_duplicates, parts=1):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return sorted((tuple(r) for r in stage(spark, df, small).collect()), key=str)


def test_near_duplicates_of_rows_without_id(spark, small):
    p, q = "a passage of quite some words that stands here", "another text with words of its own and no copy"
    assert kept_by_stage(spark, [(1, p), (None, p), (None, None)], small) == sorted([(1, p), (None, None)], key=str)
    assert kept_by_stage(spark, [(None, p), (None, p), (None, p + " tail"), (None, q), (None, None), (None, "")], small, parts=3).count((None, None)) == 1
    kept = kept_by_stage(spark, [(None, " ".join(f"w{i}" for i in range(60))), (None, " ".join(f"w{i}" for i in range(61))), (None, q)], small)
    assert len(kept) == 2 and (None, q) in kept
    low = -(1 << 63)
    assert kept_by_stage(spark, [(low, q), (None, p), (low, q)], small) == sorted([(low, q), (None, p)], key=str)


def test_two_texts_of_one_id_do_not_depend_on_partitions(spark, small):
    rows = [(13, "zzz text of one kind with some words"), (13, "aaa text of another kind and more words"), (13, "zzz text of one kind with some words"), (14, None), (14, None)]
    outs = {tuple(kept_by_stage(spark, order, small, parts=k)) for order in (rows, rows[::-1]) for k in (1, 3)}
    assert len(outs) == 1 and len([r for r in outs.pop() if r[0] == 13]) == 1


def test_contamination_tells_a_least_id_from_none(spark, small):
    item = spark.read.parquet(f"{small}/benchmark.parquet").where("length(text) > 100").first().text
    low = -(1 << 63)
    assert kept_by_stage(spark, [(low, "clean"), (None, item), (low, None)], small, stages.drop_contaminated) == sorted([(low, "clean"), (low, None)], key=str)


def test_mixing_draws_some_of_equal_rows(spark):
    rows = spark.createDataFrame([(1, "a b", "en", "s1")] * 50 + [(2, None, "en", "s1")], "doc_id long, text string, lang string, source string")
    out = mixing.mix_rows(rows, percent=50, epochs=1).collect()
    assert sum(r.doc_id == 1 for r in out) == 25
    assert len(mixing.mix_rows(rows, percent=300, epochs=3).collect()) in (150, 153)


def test_a_hot_leaf(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("w w w").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 10 == 0, F.lit("s2")).otherwise(F.lit("s1")).alias("source"))
    got = mixing.mix_sources(rows, percent=40, epochs=1).collect()
    for source, n in (("s1", 5400), ("s2", 600)):
        mine = [r for r in got if r.source == source]
        assert len(mine) == n and sum(r.copies for r in mine) == mine[0].leaf_budget // 3
