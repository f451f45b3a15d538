"""Near-duplicate documents: minima of many universal hashes, bands, signature check, full check, stars.

1. Each text becomes the set of its distinct shingles. Texts with equal sets are one node from here on,
   named by 64 bits of a hash of the set, so a group of exact copies costs one row.
2. `HASHES` universal hashes give a signature; bands of it give bucket keys. Two nodes are compared where
   they share a bucket. Bands are as long as they may be while two sets at the threshold share no
   bucket with a chance of less than `MISS`: for 0.85 there are 32 bands of 6 and the chance is
   (1 - 0.85 ** 6) ** 32 < 3e-7.
3. *Hub rounds.* Every node is compared with one hub, the least node of its buckets; confirmed links are
   contracted by alternating large-star and small-star; then every component is compared with the least
   component it shares a bucket with, once. That is one comparison a node, however large a group of
   copies is, and the nodes of a hub are dealt in chunks.
4. *The rest, exactly.* Buckets that still hold nodes of several components are linked as stars into
   families. A family of more than `BLOCK` shingles or `BLOCK_ROWS` nodes is cut into blocks, and each
   pair of blocks goes to a task: bounded memory whatever its size. There, nodes of one component, and
   nodes without a common bucket, are not compared.
5. The stars run once more over all confirmed links.

A comparison drops by signature what is far below the threshold (6 standard deviations); full sets decide.
So a task returns fewer links than it has nodes, and pairs are never rows.

Defined results: null or wordless texts have an empty set and link with nothing; fewer words than a
shingle make the whole sequence the one shingle; rows without id are linked like others but never name a
component, and are kept only where their component has no id at all; rows that share an id (and have words)
are in one component; an empty table gives an empty table. Only the id and text columns are read. Of two
different sets one may be taken for the other with a chance of 2 ** -64 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare
from .components import components
from .rows import named, one_of_each, same
from .store import Scratch
from .words import SPACED, U64, Words, mix, pack, ragged, rolling, slices

SHINGLE = 5
HASHES, MISS = 192, 1e-6
BLOCK, BLOCK_ROWS = 4 << 20, 4096
HUB_ROWS, HUB_ROUNDS = 512, 2
#: a * x + b modulo 2 ** 32, a odd
_A = (mix(np.arange(1, HASHES + 1, dtype=U64)) >> U64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1001, HASHES + 1001, dtype=U64)) >> U64(32)).astype(np.uint32)


def _shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and how many each row has (repeats included)."""
    whole = w.left() >= size
    h = rolling(w.h, size)
    n = w.counts()
    short = np.flatnonzero((n > 0) & (n < size))
    for i in short.tolist():
        at = w.first[i]
        h[at] = rolling(w.h[at : at + n[i]], int(n[i]))[0]
        whole[at] = True
    return h[whole], np.where(n >= size, n - size + 1, np.minimum(n, 1))


def _sets(w: Words, size: int) -> list[np.ndarray]:
    h, n = _shingles(w, size)
    edge = np.concatenate([[0], np.cumsum(n)])
    return [np.unique(h[x:y]) for x, y in zip(edge[:-1], edge[1:], strict=True)]


def signatures(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """HASHES x rows minima; `h` has the shingles of all rows, `n` how many of them each has (over 0)."""
    x = (h >> U64(32)).astype(np.uint32)
    at = np.cumsum(n) - n
    out = np.empty((HASHES, len(n)), np.uint32)
    for k in range(HASHES):
        out[k] = np.minimum.reduceat(x * _A[k] + _B[k], at)
    return out


def bands_of(percent: int) -> int:
    """How many hashes a band has."""
    p = percent / 100
    return max([r for r in range(1, 13) if (1 - p**r) ** (HASHES // r) < MISS], default=1)


def band_keys(sig: np.ndarray, wide: int) -> np.ndarray:
    """rows x bands bucket keys of HASHES x rows minima."""
    bands = HASHES // wide
    keys = np.empty((sig.shape[1], bands), U64)
    for b in range(bands):
        key = np.full(sig.shape[1], U64(b + 1))
        for k in range(b * wide, (b + 1) * wide):
            key = mix(key * U64(0x9E3779B97F4A7C15) + sig[k])
        keys[:, b] = key
    return keys


def _sketch(size: int, wide: int):
    bands = HASHES // wide

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                w = Words(part.column("text"), SPACED, True)
                h, n = _shingles(w, size)
                edge = np.concatenate([[0], np.cumsum(n)])
                distinct, node = [], []
                for x, y in zip(edge[:-1], edge[1:], strict=True):
                    u = np.unique(h[x:y])
                    distinct.append(len(u))
                    node.append(int.from_bytes(hashlib.blake2b(u.tobytes(), digest_size=8).digest(), "big", signed=True) if len(u) else None)
                full = np.flatnonzero(n)
                keys = band_keys(signatures(h, n[full]).astype(U64), wide) if len(full) else np.zeros((0, bands), U64)
                lists = ragged(keys.reshape(-1).view(np.int64), np.where(n > 0, bands, 0), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), pa.array(distinct, pa.int64()), pa.array(node, pa.int64()), lists], ["id", "key", "n", "node", "bands"])

    return run


def _exact(a: int, marks: np.ndarray, ids: list[np.ndarray], b: int, percent: int) -> bool:
    both = int(marks[ids[b]].sum())
    return 100 * both >= percent * (len(ids[a]) + len(ids[b]) - both)


class _Rows:
    """Nodes to be compared: their sets, signatures and bucket keys."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.sets, self.size = sets, np.array([len(x) for x in sets])
        sig = signatures(np.concatenate(sets), self.size)
        self.keys, self.sig = band_keys(sig.astype(U64), bands_of(percent)), np.ascontiguousarray(sig.T)


def _confirm(names: np.ndarray, side: np.ndarray, joined: np.ndarray, rows: list[tuple[_Rows, int, int]], percent: int) -> list[tuple[int, int]]:
    """Links that connect what similar sets connect; sides 0 and 1 are compared with each other only.

    Rows with equal `joined` are connected already."""
    sets = [x for r, a, b in rows for x in r.sets[a:b]]
    size, keys, sig = (np.concatenate([getattr(r, c)[a:b] for r, a, b in rows]) for c in ("size", "keys", "sig"))
    n = len(sets)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    edge = np.concatenate([[0], np.cumsum(size)])
    ids = [flat[x:y] for x, y in zip(edge[:-1], edge[1:], strict=True)]
    marks = np.zeros(int(flat.max()) + 1, bool)
    p = percent / 100
    least = int(HASHES * p - 6 * (HASHES * p * (1 - p)) ** 0.5)
    _, part = np.unique(joined, return_inverse=True)
    across = len(np.unique(side)) > 1
    out = []
    for i in range(np.count_nonzero(side == 0) if across else n - 1):  # side 0 comes first
        ok = (part[i + 1 :] != part[i]) & (100 * np.minimum(size[i + 1 :], size[i]) >= percent * np.maximum(size[i + 1 :], size[i]))
        if across:
            ok &= side[i + 1 :] != side[i]
        rest = i + 1 + np.flatnonzero(ok)
        rest = rest[(keys[rest] == keys[i]).any(1)]
        rest = rest[(sig[rest] == sig[i]).sum(1) >= least]
        if not len(rest):
            continue
        marks[ids[i]] = True
        for j in rest.tolist():
            if part[i] != part[j] and _exact(i, marks, ids, j, percent):
                out.append((int(names[i]), int(names[j])))
                part[part == part[j]] = part[i]
        marks[ids[i]] = False
    return out


def _families(size: int, percent: int):
    """Rows come sorted by group, blocks and block; one group, or one pair of its blocks, is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, _Rows, int, int]] = []
        now, found = None, []

        def flush() -> None:
            if sum(b - a for *_, a, b in held) < 2:
                return
            head = np.concatenate([x[:, a:b] for x, _, a, b in held], axis=1)
            side = (head[3] != head[3, 0]).astype(int)  # of two blocks, the first one comes first
            found.extend(_confirm(head[4], side, head[5], [x[1:] for x in held], percent))

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["u", "v"])

        for batch in batches:
            for part in slices(batch, "text"):  # sets and signatures of many groups at once
                rows = _Rows(_sets(Words(part.column("text"), SPACED, True), size), percent)
                head = np.stack([np.asarray(part.column(c), np.int64) for c in ("fam", "i", "j", "block", "node", "comp")])
                cut = np.concatenate([[0], np.flatnonzero((head[:3, 1:] != head[:3, :-1]).any(0)) + 1, [part.num_rows]])
                for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    if now is not None and tuple(head[:3, x]) != now:
                        flush()
                        held = []
                    now = tuple(head[:3, x])
                    held.append((head, rows, x, y))
            yield out()
            found = []
        flush()
        yield out()

    return run


def _compared(placed: DataFrame, texts: DataFrame, scratch: Scratch, shingle: int, percent: int) -> DataFrame:
    """Confirmed links (u, v) within the groups of `placed` (node, comp, fam, i, j, block)."""
    members = texts.join(scratch.table(placed).hint("merge"), "node").select("fam", "i", "j", "block", "node", "comp", "text")
    parts = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = members.repartition(parts, "fam", "i", "j").sortWithinPartitions("fam", "i", "j", "block")
    return scratch.table(dealt.mapInArrow(_families(shingle, percent), "u long, v long"))


def _roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) of every node that has a link."""
    found = components(links, scratch)
    both = found.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(found.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
    return scratch.table(both, found)


def _in_buckets(members: DataFrame, roots: DataFrame | None, scratch: Scratch) -> DataFrame:
    """(key, comp, node): the members of buckets that hold two components or more."""
    if roots is not None:
        members = members.join(roots, "node", "left").select("key", F.coalesce("comp", "node").alias("comp"), "node")
    members = scratch.table(members)
    open_ = scratch.table(members.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a != b").select("key"))
    return scratch.table(members.join(open_, "key", "left_semi"), members, open_)


def _to_hubs(members: DataFrame) -> DataFrame:
    """(node, comp, hub): for each component, one pair of nodes that ties it to the least component it shares a bucket with."""
    in_bucket = members.groupBy("key", "comp").agg(F.min("node").alias("node"))
    hubs = members.groupBy("key").agg(F.min(F.struct("comp", "node")).alias("hub"))
    pairs = in_bucket.join(hubs, "key").where(F.col("comp") != F.col("hub.comp"))
    best = pairs.groupBy("comp").agg(F.min(F.struct(F.col("hub.comp").alias("c"), F.col("hub.node").alias("hub"), "node")).alias("p"))
    return best.select("p.node", "comp", "p.hub")


def _hub_groups(pairs: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Each hub with its nodes in chunks of about HUB_ROWS rows and BLOCK shingles."""
    pairs = scratch.table(pairs.join(nodes.select("node", "n"), "node"))
    chunks = scratch.table(pairs.groupBy("hub").agg(F.greatest(F.ceil(F.sum("n") / F.lit(BLOCK)), F.ceil(F.count("*") / F.lit(HUB_ROWS))).cast("int").alias("chunks")))
    # The hub is block 0 and the chunks are 1, 2, ..., so that only the hub and the others are compared.
    chunk = (F.pmod(F.xxhash64("node"), F.col("chunks")) + 1).cast("int")
    spokes = pairs.join(chunks, "hub").select("node", "comp", F.col("hub").alias("fam"), F.lit(0).alias("i"), chunk.alias("j"), chunk.alias("block"))
    centres = chunks.select(F.col("hub").alias("node"), F.col("hub").alias("comp"), F.col("hub").alias("fam"), F.lit(0).alias("i"), F.explode(F.sequence(F.lit(1), F.col("chunks"))).alias("j"), F.lit(0).alias("block"))
    return spokes.unionByName(centres)


def _family_groups(members: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """The families of the buckets that are left, in blocks."""
    hubs = scratch.table(members.groupBy("key").agg(F.min("node").alias("hub")))
    stars = members.join(hubs, "key").where("node != hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    family = _roots(stars, scratch).withColumnRenamed("comp", "fam")
    family = scratch.table(family.join(nodes.select("node", "n"), "node").join(members.select("node", "comp").distinct(), "node"), hubs)
    blocks = scratch.table(family.groupBy("fam").agg(F.greatest(F.ceil(F.sum("n") / F.lit(BLOCK)), F.ceil(F.count("*") / F.lit(BLOCK_ROWS))).cast("int").alias("blocks")))
    placed = family.join(blocks, "fam").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.select("node", "comp", "fam", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return placed.select("node", "comp", "fam", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")


def linked_rows(rows: DataFrame, percent: int = 80, shingle: int = SHINGLE) -> DataFrame:
    """(id, key, n, root, component_id) of each row of (id, key, text), where id and key tell rows apart.

    `n` is the size of the set, `root` names the component (null: an empty set), `component_id` is its least id."""
    spark = prepare(rows.sparkSession)
    scratch = Scratch(spark, "minhash")
    sketch = scratch.table(rows.mapInArrow(_sketch(shingle, bands_of(percent)), "id long, key long, n long, node long, bands array<long>"))
    worded = sketch.where("node is not null")
    repeated = scratch.table(worded.groupBy("id", "key").agg(F.count("*").alias("c")).where("c > 1").select("id", "key"))
    rep = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "key")).alias("rep")
    nodes = scratch.table(worded.groupBy("node").agg(rep, F.min("id").alias("min_id"), F.first("bands").alias("bands"), F.first("n").alias("n")))
    # Rows of one id are one document.
    ids = scratch.table(worded.where("id is not null").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a != b").select("id", "a"))
    links = scratch.table(worded.select("id", "node").join(ids, "id").where("node != a").select(F.col("node").alias("u"), F.col("a").alias("v")).distinct(), ids)
    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = scratch.table(keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a != b").select("key"))
    members = scratch.table(keys.join(shared, "key", "left_semi").select("key", F.col("node").alias("comp"), "node"), shared)
    # The texts of nodes that share a bucket, once; the rounds read only these.
    wanted = scratch.table(members.select("node").distinct().join(nodes.select("node", "rep"), "node").select("node", "rep.id", "rep.key"))
    texts = one_of_each(rows.where("text is not null"), repeated)
    texts = scratch.table(texts.join(wanted.hint("merge"), same(texts, wanted)).select("node", "text"), wanted)
    left = members
    for _ in range(HUB_ROUNDS):
        if left.isEmpty():
            break
        found = _compared(_hub_groups(_to_hubs(left), nodes, scratch), texts, scratch, shingle, percent)
        links = scratch.table(links.unionByName(found), links, found)
        left = _in_buckets(members.select("key", "node"), _roots(links, scratch), scratch)
    if not left.isEmpty():
        found = _compared(_family_groups(left, nodes, scratch), texts, scratch, shingle, percent)
        links = scratch.table(links.unionByName(found), links, found)
    roots = _roots(links, scratch)
    least = scratch.table(roots.join(nodes.select("node", "min_id"), "node").groupBy("comp").agg(F.min("min_id").alias("component_id")))
    labels = scratch.table(roots.join(least, "comp"), roots, least)
    known = nodes.select("node", "min_id").join(labels, "node", "left")
    known = scratch.table(known.select("node", F.coalesce("comp", "node").alias("root"), F.when(F.col("comp").isNull(), F.col("min_id")).otherwise(F.col("component_id")).alias("component_id")), labels)
    out = sketch.select("id", "key", "n", "node").join(known, "node", "left")
    return out.select("id", "key", "n", "root", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: (id_col, n_shingles, component_id, kept).

    Documents are linked where 100 * intersection >= percent * union of their shingle sets.
    """
    text = named(text_col).cast("string")
    linked = linked_rows(docs.select(named(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text")), percent, shingle)
    kept = F.when(F.col("component_id").isNull(), F.lit(True)).otherwise(F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
    return linked.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def op8_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)
