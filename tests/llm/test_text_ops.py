"""Operators over documents against brute force, on the small table and on odd rows."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from cadenza.llm import decontamination, language_id, license_scan, minhash, quality_rules, sharding, substring_dedup, toxicity
from pyspark.sql import functions as F

SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
fold = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture(params=["small", "odd"])
def table(request, docs, odd):
    return docs if request.param == "small" else odd


def brute_substring(rows, window):
    texts = [SPACED.findall(r.text or "") for r in rows]
    seen = collections.Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for r, w in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((r.doc_id, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


@pytest.mark.parametrize("window", [35, 6])
def test_substring(table, window):
    got = substring_dedup.remove_repeats(table, window=window).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_substring(table.collect(), window), key=str)


def test_substring_parts_of_a_hot_group(spark, odd, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", 64)
    got = substring_dedup.remove_repeats(odd.repartition(5)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_substring(odd.collect(), 35), key=str)


def brute_near(rows, percent, size=5):
    sets = []
    for r in rows:
        w = SPACED.findall(fold(r.text))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same_id = rows[a].doc_id is not None and rows[a].doc_id == rows[b].doc_id
            both = len(sets[a] & sets[b])
            if (sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b])) or (same_id and sets[a] and sets[b]):
                root[find(a)] = find(b)
    least = collections.defaultdict(lambda: None)
    for i, r in enumerate(rows):
        if r.doc_id is not None and sets[i]:
            least[find(i)] = r.doc_id if least[find(i)] is None else min(least[find(i)], r.doc_id)
    out = []
    for i, r in enumerate(rows):
        c = least[find(i)] if sets[i] else r.doc_id
        out.append((r.doc_id, len(sets[i]), c, True if c is None else r.doc_id == c))
    return out


@pytest.mark.parametrize("percent", [85, 50])
def test_near(table, percent):
    got = minhash.near_duplicates(table, percent=percent).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_near(table.collect(), percent), key=str)


def test_near_family_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 8)
    base = [f"b{i}" for i in range(120)]
    data = [(100 - k, " ".join(base[:k] + [f"n{k}"] + base[k + 1 :])) for k in range(60)] + [(500 + k, " ".join(base[: 90 + k % 3] + [f"z{k}"])) for k in range(20)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = minhash.near_duplicates(df, percent=85).collect()
    assert sorted(map(tuple, got)) == sorted(brute_near(df.collect(), 85))


def brute_leaks(rows, items, window=10):
    grams = collections.defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(fold(text))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            grams[tuple(w[i : i + window])].add(item)
    sizes = {len(g) for g in grams}
    out = []
    for r in rows:
        w = ALNUM.findall(fold(r.text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    found |= grams[tuple(w[i : i + n])]
        found = sorted(str(x) for x in found if x is not None)
        out.append((r.doc_id, len(w), len(hit), len(found), sha(",".join(found)), bool(hit)))
    return out


def leaks(found):
    n = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0), lambda a, x: a + x)
    rows = found.select("doc_id", "n_words", n.alias("n"), F.size("items"), F.sha2(F.array_join("items", ",").cast("binary"), 256)).collect()
    return sorted([(*r, r.n > 0) for r in map(lambda r: r, rows)], key=str)


def test_leaks_of_the_query(spark, small, rows):
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    got = decontamination.op6_benchmark_decontamination(spark, small).collect()
    assert sorted(map(tuple, got)) == sorted(brute_leaks(rows, items))
    assert sum(r.contaminated for r in got) > 0


def test_substring_groups_at_scale(spark, odd, monkeypatch):
    """As many groups as a table of 2 ** 17 partitions has, more than 2 ** 16."""
    monkeypatch.setattr(substring_dedup, "group_bits", lambda docs: 17)
    monkeypatch.setattr(substring_dedup, "_HASHES", 5000)
    got = substring_dedup.remove_repeats(odd).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_substring(odd.collect(), 35), key=str)


def test_substring_tells_a_least_id_from_none(spark):
    low, p = -(1 << 63), " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(low, p), (None, p + " x"), (0, "y " + p), (None, "z")], "doc_id long, text string")
    got = substring_dedup.remove_repeats(rows).collect()
    assert {(r.doc_id, r.kept_text, tuple(r.starts or ()), tuple(r.ends or ())) for r in got} == {(low, "", (0,), (40,)), (None, "x", (0,), (40,)), (0, "y", (1,), (41,)), (None, "z", (), ())}


@pytest.mark.parametrize("item_bytes", [1 << 20, 150])
def test_leaks_odd(spark, odd, item_bytes):
    texts = [r.text for r in odd.collect() if r.doc_id in (2, 10)]
    items = [(1, texts[0]), (2, texts[1]), (3, None), (4, ""), (5, "w1 w2"), (6, "one"), (6, "w3 w4 w5"), (None, "w7 É"), (7, "w1 w2"), (8, "License e"), (9, "É")]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_matches(odd, table, item_bytes=item_bytes)
    assert leaks(found) == sorted(brute_leaks(odd.collect(), items), key=str)
    assert leaks(decontamination.find_matches(odd, table.where("false"))) == sorted(brute_leaks(odd.collect(), []), key=str)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha filler beta filler gamma"), (2, "alpha " + "x " * 50 + "beta gamma"), (3, "gamma beta alpha")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "alpha beta gamma")], "item_id string, text string")
    got = {r.doc_id: (r.items, r.near_items) for r in decontamination.find_matches(docs, items).collect()}
    assert got == {1: ([], ["i"]), 2: ([], []), 3: ([], ["i"])}


def brute_base(t):
    w = SPACED.findall(t or "")
    lines, seen, dup = (t or "").split("\n"), set(), 0
    for x in lines:
        if SPACED.search(x):
            dup += x in seen
            seen.add(x)
    n = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = set()
    for i in range(len(w) - 2):
        if n[tuple(w[i : i + 3])] > 1:
            covered.update(range(i, i + 3))
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality_base(spark, table, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    got = quality_rules.score(table, quality_rules.fit(table, labels.where("quality = 1"))).drop("score").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(r.doc_id, *brute_base(r.text)) for r in table.collect()], key=str)


def test_quality_score(spark, docs, rows, small):
    import math

    labels = spark.read.parquet(f"{small}/labels.parquet")
    trusted = {r.doc_id for r in labels.where("quality = 1").collect()}
    got = {r.doc_id: r for r in quality_rules.op2_quality_rules(spark, small).collect()}
    grams = {r.doc_id: [(x,) for x in w] + list(zip(w, w[1:], strict=False)) for r in rows for w in [SPACED.findall(r.text)]}
    names = sorted({g for x in grams.values() for g in x}, key=str)
    frame = spark.createDataFrame([(list(g),) for g in names], "g array<string>")
    bucket = F.when(F.size("g") == 1, F.xxhash64(F.get("g", F.lit(0)))).otherwise(F.xxhash64(F.get("g", F.lit(0)), F.get("g", F.lit(1))))
    of = {tuple(r.g): r.b for r in frame.select("g", F.pmod(bucket, F.lit(quality_rules.BUCKETS)).alias("b")).collect()}
    raw, target = collections.Counter(), collections.Counter()
    for i, x in grams.items():
        raw.update(of[g] for g in x)
        if i in trusted:
            target.update(of[g] for g in x)
    a, b = sum(target.values()) + quality_rules.BUCKETS, sum(raw.values()) + quality_rules.BUCKETS
    steps = sorted(got[i].score // quality_rules.STEP for i in trusted if i in got and not got[i].base_failed)
    low, high = (quality_rules.STEP * steps[-(-q * len(steps) // 4) - 1] for q in (1, 3))
    threshold = low - quality_rules.FENCE * (high - low)
    for i, x in grams.items():
        s = sum(1e6 * (math.log((target[of[g]] + 1) / a) - math.log((raw[of[g]] + 1) / b)) for g in x) / len(x)
        assert abs(s - got[i].score) <= 2
        assert got[i].kept == (not got[i].base_failed and got[i].score >= threshold)


def test_quality_keeps_the_good_and_drops_the_bad(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = [r for r in quality_rules.op2_quality_rules(spark, "/root/testdata/sf0.1").collect() if not r.base_failed and labels.get(r.doc_id) is not None]
    good, bad = [r.kept for r in got if labels[r.doc_id]], [r.kept for r in got if not labels[r.doc_id]]
    assert sum(good) >= 0.995 * len(good) > 1000 and sum(bad) <= 0.02 * len(bad) and len(bad) > 100


def test_quality_without_trusted(spark, odd):
    none = quality_rules.judge(odd, odd.select("doc_id").where("false")).collect()
    assert {r.score for r in none} == {0, None} and all(r.kept == (not r.base_failed and r.score is not None) for r in none)


def test_quality_target_is_whole(spark):
    docs = spark.range(20_500).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"))
    model = quality_rules.fit(docs, docs.select("doc_id").union(docs.select("doc_id"))).first().model
    assert set(model) == {0}  # every document is trusted, so target and raw counts are the same


def test_sharding(table):
    out = sharding.interleave(table).collect()
    assert len(out) == table.count()
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    sizes = [len(by[k]) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    for source, n in collections.Counter(r.source for r in out).items():
        mine = collections.Counter(r.shard for r in out if r.source == source)
        assert all(abs(mine[k] - n / 16) <= 2 for k in range(16))


def test_sharding_query(spark, small, rows):
    got = {r.doc_id: r for r in sharding.op5_sharding(spark, small).collect()}
    for r in rows:
        raw = (r.text or "").encode()
        assert (got[r.doc_id].size, got[r.doc_id].text_crc32, got[r.doc_id].law) == (len(raw) + 1, zlib.crc32(raw), "rows")


def test_language(spark, docs, rows, small):
    got = {r.doc_id: r for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    told = [r for r in held if any(map(str.isalpha, r.text or ""))]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in told) >= 0.95 * len(told)
    assert all(0 <= x.score <= 1 for x in got.values())


def test_language_odd(spark, odd, empty):
    model = language_id.fit(odd)
    got = language_id.identify(odd, model).collect()
    letters = collections.Counter((r.doc_id, any(map(str.isalpha, r.text or ""))) for r in odd.collect())
    assert collections.Counter((r.doc_id, r.lang_pred != "und") for r in got) == letters
    assert {r.lang_pred for r in language_id.identify(odd, language_id.fit(empty)).collect()} == {"und"}
    assert language_id.identify(empty, model).collect() == []


def test_a_language_without_ids_is_learned(spark):
    r = random.Random(2)
    text = lambda letters: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(40))
    one = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 4 != 2)  # an id that many rows share
    data = [(None, text("abcd"), "xx") for _ in range(600)] + [(i, text("efgh"), "yy") for i in range(300)] + [(one, text("ijkl"), "zz") for _ in range(300)] + [(None, "mn mn mn", "vv")] * 500
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    models = [language_id.fit(df.repartition(k), sample=120) for k in (1, 5)]
    assert models[0].languages == ["vv", "xx", "yy", "zz"]
    assert (models[0].weights == models[1].weights).all()  # no order of arrival in the sample
    got = language_id.identify(df, models[0]).collect()
    want = {x: lang for _, x, lang in data}
    assert len(got) == len(data) and collections.Counter(g.lang_pred for g in got) == collections.Counter(lang for _, _, lang in data) and len(want) > 1000


def test_nine_languages(spark):
    r = random.Random(4)
    names = [f"l{k}" for k in range(9)]
    text = lambda k: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz"[2 * k : 2 * k + 8]) for _ in range(6)) for _ in range(60))
    df = spark.createDataFrame([(i, text(i % 9), names[i % 9]) for i in range(900)], "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in language_id.identify(df, language_id.fit(df, sample=450)).collect()}
    told = [i for i in got if got[i].held_out]
    assert sum(got[i].lang_pred == names[i % 9] for i in told) >= 0.97 * len(told) > 100


def test_decoding_against_brute_force(spark, docs):
    import math

    import pyarrow as pa

    model, some = language_id.fit(docs), [r.text for r in docs.limit(60).collect()] + ["w", "ok", "é"]
    x = language_id.features(pa.array(some))
    best, score, lead = model.decode(x)
    for i, t in enumerate(some):
        low = " " + re.sub(r"[\x00-\x60\x7b-\x7f]", " ", fold(t)) + " "
        raw = low.encode()
        grams = collections.Counter(raw[k : k + 3] for k in range(len(raw) - 2) if raw[k : k + 3] != b"   ")
        row = [0.0] * language_id.DIMS
        for g, n in grams.items():
            row[(int.from_bytes(g, "little") * 0x9E3779B1 % (1 << 32)) >> (32 - language_id._BITS)] += n
        row = [math.sqrt(v / sum(grams.values())) for v in row]
        assert max(abs(a - b) for a, b in zip(row, x[i].tolist(), strict=True)) < 1e-6
        f = [sum(a * float(w) for a, w in zip(row, model.weights[:-1, k], strict=True)) + float(model.weights[-1, k]) for k in range(model.code.shape[1])]
        loss = [sum(math.log1p(math.exp(-a * int(c))) * w for a, c, w in zip(f, model.code[m], model.trust[m], strict=True)) for m in range(len(model.languages))]
        order = sorted(range(len(loss)), key=lambda m: loss[m])
        assert best[i] == order[0] or abs(loss[best[i]] - loss[order[0]]) < 1e-3
        assert abs(score[i] - 1 / sum(math.exp(min(loss) - v) for v in loss)) < 1e-3 and abs(lead[i] - (loss[order[1]] - loss[order[0]])) < 1e-2


def test_many_languages_code():
    code = language_id.codewords(12)
    assert min((code[i] != code[j]).sum() for i in range(12) for j in range(i)) >= 9
    assert language_id.codewords(4).shape == (4, 7)


def brute_license(t):
    w = ALNUM.findall(fold(t))
    at, labels = [], set()
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), sorted(labels)


def brute_findings(texts):
    """{place in texts: (labels, best score)}: every clause at every place, word by word."""
    import math

    scan = license_scan
    words = [ALNUM.findall(fold(t)) for t in texts]
    known = {x for _, t, _ in scan.TEMPLATES for x in ALNUM.findall(fold(t))}
    files = collections.Counter(x for w in words for x in set(w) & known)
    idf = lambda x: math.log((len(texts) + 1) / (files[x] + 1)) + 1e-6
    licences = []
    for label, text, keys in scan.TEMPLATES:
        parts = [ALNUM.findall(fold(c)) for c in text.split("\n\n")]
        must = [set() for _ in parts]
        for key in keys:
            k = key.split()
            c, i = next((c, i) for c, p in enumerate(parts) for i in range(len(p)) if p[i : i + len(k)] == k)
            must[c] |= set(range(i, i + len(k)))
        licences.append((label, parts, must, sum(idf(x) for p in parts for x in p), sum(map(len, parts))))
    out = {}
    for n, w in enumerate(words):
        labels, best = set(), 0.0
        for label, parts, must, weight, length in licences:
            found = []
            for c, p in enumerate(parts):
                top = scan.RARE * max(map(idf, p))
                rare = [k for k, x in enumerate(p) if idf(x) >= top]
                for i in range(len(w) - len(p) + 1):
                    same = [w[i + k] == x for k, x in enumerate(p)]
                    share = sum(idf(x) for x, ok in zip(p, same, strict=True) if ok) / sum(map(idf, p))
                    if sum(same[k] for k in rare) >= scan.AGREE * len(rare) and all(same[k] for k in must[c]) and share >= scan.COVERED:
                        found.append((i, c, i + len(p), min(1, share)))
            runs, last = [], None
            at = {i: min((-s, c, end) for j, c, end, s in found if j == i) for i, *_ in found}
            for x in sorted((i, c, end, -s) for i, (s, c, end) in at.items()):
                if last is None or x[1] <= last[1] or x[0] - last[2] > length:
                    runs.append([])
                runs[-1].append(x)
                last = x
            for run in runs:
                score = sum(s * sum(map(idf, parts[c])) / weight for _, c, _, s in run)
                if {c for c, m in enumerate(must) if m} <= {c for _, c, _, _ in run} and score >= scan.COVERED:
                    labels.add(label)
                    best = max(best, min(1, score))
        out[n] = (labels, best)
    return out


def test_license(table):
    got = license_scan.scan(table, license_scan.build_index(table)).collect()
    base = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got]
    assert sorted(base, key=str) == sorted([(r.doc_id, *brute_license(r.text)) for r in table.collect()], key=str)


def licence_texts():
    """Whole licences, with a heading, an inserted line, changed words, a missing clause, two at once, and near misses."""
    texts = {label: t for label, t, _ in license_scan.TEMPLATES}
    mit, apache, bsd = texts["mit"], texts["apache-2.0"], texts["bsd-3-clause"]
    out = [t for _, t, _ in license_scan.TEMPLATES]
    out += ["Copyright 2020 Someone\n\n" + mit, "x " * 300 + apache.replace("\n\n", "\nSee also the notice file.\n"), mit.replace("AUTHORS", "WRITERS").replace("TORT", "LAW"), mit + "\n" + bsd, mit + " " + mit]
    out += [mit.split("\n\n")[2], mit.replace("without restriction", "with some restriction"), "Released under the MIT Licence.", "permission is hereby granted", "", None, "MIT License and Apache License", " ".join(reversed(apache.split()))]
    return out


@pytest.mark.parametrize("which", ["small", "licences"])
def test_license_labels_and_scores(spark, docs, which):
    rows = [r.text for r in docs.where("length(text) < 3000").limit(60).collect()] if which == "small" else licence_texts()
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(table, license_scan.build_index(table)).collect()}
    want = brute_findings(rows)
    for i, text in enumerate(rows):
        base = set(brute_license(text)[4])
        labels, best = want[i]
        assert set(got[i].labels) == labels | base, (i, text)
        assert abs(got[i].score - max(best, 0 if labels else license_scan.MENTION if base else 0)) < 1e-9
        assert {x.label for x in got[i].notices} == labels
    if which == "licences":
        assert all(label in got[i].labels for i, (label, _, _) in enumerate(license_scan.TEMPLATES))


def test_toxicity(spark, small, rows):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    half = spark.createDataFrame([(i, t) for i, t in labels.items() if i % 2], "doc_id long, toxic int")
    chain = toxicity.fit_chain(docs, half)
    got = {r.doc_id: r.is_toxic for r in toxicity.score_toxicity(docs, chain, ["doc_id"]).select("row.doc_id", "is_toxic").collect()}
    rest = [i for i in labels if i % 2 == 0 and i in got]
    assert sum(got[i] == bool(labels[i]) for i in rest) >= 0.97 * len(rest)
    toxic = [i for i in rest if labels[i]]
    assert sum(got[i] for i in toxic) >= 0.85 * len(toxic)


def test_toxicity_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    chain = toxicity.fit_chain(odd, labels)
    got = toxicity.score_toxicity(odd, chain, odd.columns).select("row.*", "is_toxic").drop("is_toxic")
    assert sorted(map(str, got.collect())) == sorted(map(str, odd.collect()))
    none = toxicity.fit_chain(odd, labels.where("false"))
    assert not any(r.is_toxic for r in toxicity.score_toxicity(odd, none, ["doc_id"]).collect())


def test_chain_against_brute_force(spark, docs, small):
    """Scores recomputed word by word from the chain's weights."""
    import math

    import numpy as np
    import pyarrow as pa

    from cadenza.llm.words import Words

    labels = spark.read.parquet(f"{small}/labels.parquet")
    chain = toxicity.fit_chain(docs, labels)
    again = toxicity.fit_chain(docs.repartition(7), labels.repartition(3))
    assert all((a == b).all() for a, b in zip(chain.links, again.links, strict=True)) and (chain.words == again.words).all()
    hash_of = lambda t, size: int(Words(pa.array([t]), np.ones(256, bool), False, prefixes=True).prefix(size)[1][0])
    whole = lambda t: int(Words(pa.array([t]), np.ones(256, bool), False).h[0])
    known, seen = set(chain.words.tolist()), {}

    def features(word):
        if word not in seen:
            raw = word.encode()
            hs = [whole(word)] + [hash_of(word, k) for k in toxicity.PREFIXES if len(raw) > k]
            seen[word] = [h for h in hs if h in known]
        return seen[word]

    place = {int(h): i for i, h in enumerate(chain.words)}
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, chain, ["doc_id"]).select("row.doc_id", *(f"p_{c}" for c in toxicity.CHAIN), "is_toxic").collect()}
    for r in docs.where("length(text) < 1500").limit(40).collect():
        w = ALNUM.findall(fold(r.text))
        n = collections.Counter(place[h] for x in w for h in features(x))
        x = [float(n[i] > 0) for i in range(len(place))] + [math.log1p(100 * n[i] / max(len(w), 1)) for i in range(len(place))]
        p = []
        for link in chain.links:
            z = sum(a * b for a, b in zip(x + p, link[:-1], strict=True)) + link[-1]
            p.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        assert max(abs(a - got[r.doc_id][f"p_{c}"]) for a, c in zip(p, toxicity.CHAIN, strict=True)) < 1e-9
        assert got[r.doc_id].is_toxic == (p[-1] >= toxicity.THRESHOLD)


def test_groups_of_toxic_texts():
    import numpy as np

    kinds = np.array([[1, 1, 0, 0, 0, 0], [0, 0, 2, 1, 0, 0], [0, 0, 0, 0, 1, 3]])
    counts = np.vstack([kinds[[0] * 5 + [1] * 3 + [2] * 2], np.zeros((1, 6))])
    assert toxicity.latent_groups(counts).tolist() == [0] * 5 + [1] * 3 + [2] * 2 + [-1]


def test_given_categories(spark, docs, small):
    labels = spark.read.parquet(f"{small}/labels.parquet").withColumn("rude", F.when(F.col("doc_id") % 2 == 0, F.col("toxic")).otherwise(F.lit(0)))
    chain = toxicity.fit_chain(docs, labels, category_cols=("rude",))
    out = toxicity.score_toxicity(docs, chain, ["doc_id"])
    assert out.columns == ["row", "p_rude", "p_toxic", "is_toxic"] and out.where("p_rude between 0 and 1").count() == docs.count()


def test_empty(spark, empty, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    assert substring_dedup.remove_repeats(empty).collect() == []
    assert minhash.near_duplicates(empty).collect() == []
    assert decontamination.find_matches(empty, spark.read.parquet(f"{small}/benchmark.parquet")).collect() == []
    assert quality_rules.score(empty, quality_rules.fit(empty, labels)).collect() == []
    assert sharding.interleave(empty).collect() == []
    assert license_scan.scan(empty, license_scan.build_index(empty)).collect() == []
    assert toxicity.score_toxicity(empty, toxicity.fit_chain(empty, labels), ["doc_id"]).collect() == []
