"""Benchmark decontamination with a distributed positional inverted index.

*Index.* The training texts are cut into segments of whole documents. A segment is one stored row with
the postings (ascending word positions) of each term in it that some test item uses; other terms can
match nothing. Segments are independent, so a very common term costs each segment its own list and
nothing is shuffled. The term counts of all segments, summed, order the test terms by rarity.

*Search.* Every test window takes the postings of its rarest term, moved back by the term's offset, as
its possible starts, and intersects them with the next rarer terms' postings, adjusted likewise, until
all its terms have agreed: an exact phrase match. A proximity match of an item is a place where its
rarest terms all stand within `near` words of the rarest one's occurrence, in one document.

The test items are sized first. Up to `ITEM_BYTES` they go out as one broadcast, which holds some 40 bytes a
word (places, terms, vocabulary); beyond it they are searched block by block, each block below the bound, and
the blocks' matches are merged. A block reads the documents once more.

Defined results: null or wordless texts match nothing; an item with fewer words than a window is one
window; equal items (and repeated item ids) count once by id; items without id still mark words, but
have no name to list; documents without id or repeated are separate rows; empty tables on either side
are fine. Only id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare
from .rows import named
from .store import Scratch
from .words import ALNUM, U64, Words, pack, ragged, rolling, slices

WINDOW, NEAR, NEAR_TERMS = 10, 20, 3
ITEM_BYTES = 32 << 20
_CHUNK = 1 << 20


class Queries:
    """The windows of a block of test items, as numbers of its sorted vocabulary.

    A window is a place in the items' words, so a word costs 12 bytes however many windows hold it."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int) -> None:
        w = Words(pa.array(texts, pa.large_string()), ALNUM, True)
        self.vocabulary, term = np.unique(w.h, return_inverse=True)
        self.term = term.astype(np.int32)
        self.ids = ids
        row, left, n = w.row(), w.left(), w.counts()
        self.by_length: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []  # size, places of the windows, the items of each, where they begin
        for size in [window, *sorted(set(n[(n > 0) & (n < window)].tolist()))]:
            start = np.flatnonzero(left >= window) if size == window else w.first[:-1][n == size]
            if not len(start):
                continue
            h = rolling(w.h, size)[start]
            _, first, which = np.unique(h, return_index=True, return_inverse=True)
            pair = np.unique(np.stack([which, row[start]]), axis=1)
            self.by_length.append((size, start[first].astype(np.int32), pair[1].astype(np.int32), np.searchsorted(pair[0], np.arange(len(first) + 1)).astype(np.int32)))
        self.first = w.first

    def rarest(self, rank: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, items) of the items with so many terms: each one's rarest, the rarest first."""
        by: dict[int, tuple[list, list]] = {}
        for item, (x, y) in enumerate(zip(self.first[:-1], self.first[1:], strict=True)):
            terms = np.unique(self.term[x:y])
            if len(terms):
                top = terms[np.argsort(rank[terms], kind="stable")[:most]]
                for held, new in zip(by.setdefault(len(top), ([], [])), (top, item), strict=True):
                    held.append(new)
        return [(np.array(t), np.array(i)) for t, i in by.values()]


def _index(vocabulary: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"), ALNUM, True)
                near = np.minimum(np.searchsorted(known, w.h), max(0, len(known) - 1))
                at = np.flatnonzero(known[near] == w.h) if len(known) else np.zeros(0, np.int64)
                term = near[at]
                order = np.argsort(term, kind="stable")
                terms, n = np.unique(term, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.column("id0").to_pylist()], pa.list_(pa.int64())),
                        pa.array([part.column("th").to_pylist()], pa.list_(pa.int64())),
                        pa.array([pack(w.first.astype(np.int64))], pa.binary()),
                        ragged(terms.astype(np.int32), np.array([len(terms)]), pa.int32()),
                        ragged(n.astype(np.int32), np.array([len(n)]), pa.int32()),
                        pa.array([pack(at[order].astype(np.uint32))], pa.binary()),
                    ],
                    ["ids", "ths", "first", "terms", "counts", "postings"],
                )

    return run


_SEGMENT = "ids array<long>, ths array<long>, first binary, terms array<int>, counts array<int>, postings binary"


class _Segment:
    def __init__(self, row: dict, terms: int) -> None:
        self.first = np.frombuffer(row["first"], np.int64)
        self.count = np.zeros(terms, np.int64)
        self.count[row["terms"]] = row["counts"]
        self.begin = np.cumsum(self.count) - self.count
        self.place = np.frombuffer(row["postings"], np.uint32).astype(U64)
        self.sorted = (np.repeat(np.arange(terms, dtype=U64), self.count) << U64(32)) | self.place

    def doc(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, "right") - 1

    def starts(self, term: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Postings of each term less its offset, and which of the terms each belongs to."""
        n = self.count[term]
        owner = np.repeat(np.arange(len(term)), n)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[term], n)
        start = self.place[at].astype(np.int64) - offset[owner]
        return owner[start >= 0], start[start >= 0]

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = (term.astype(U64) << U64(32)) | place.astype(U64)
        near = np.minimum(np.searchsorted(self.sorted, key), max(0, len(self.sorted) - 1))
        return self.sorted[near] == key if len(self.sorted) else np.zeros(len(key), bool)

    def within(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the term has a place from low to high."""
        key = (term.astype(U64) << U64(32)) | low.astype(U64)
        near = np.minimum(np.searchsorted(self.sorted, key), max(0, len(self.sorted) - 1))
        found = self.sorted[near]
        return (found >= key) & (found <= ((term.astype(U64) << U64(32)) | high.astype(U64))) if len(self.sorted) else np.zeros(len(key), bool)


def _phrases(seg: _Segment, term: np.ndarray, size: int, places: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, start) of every place where all terms of a window stand in their order."""
    there = np.concatenate([[0], np.cumsum(seg.count[term] > 0)])
    alive = np.flatnonzero(there[places + size] - there[places] == size)  # all of its terms occur in the segment
    if not len(alive):
        return
    for part in np.array_split(alive, max(1, len(alive) * size // _CHUNK)):
        terms = term[places[part][:, None] + np.arange(size)]
        order = np.argsort(rank[terms], axis=1, kind="stable")
        sizes = np.cumsum(seg.count[terms[np.arange(len(part)), order[:, 0]]])
        cut = [0, *(np.flatnonzero(np.diff(sizes // _CHUNK)) + 1).tolist(), len(part)]
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            win, by = terms[x:y], order[x:y]
            owner, start = seg.starts(win[np.arange(len(win)), by[:, 0]], by[:, 0])
            for k in range(1, size):
                if not len(owner):
                    break
                offset = by[owner, k]
                ok = seg.has(win[owner, offset], start + offset)
                owner, start = owner[ok], start[ok]
            if len(owner):
                inside = seg.doc(start) == seg.doc(start + size - 1)
                yield part[x:y][owner[inside]], start[inside]


def _near(seg: _Segment, rare: np.ndarray, owners: np.ndarray, near: int) -> np.ndarray:
    """(item, doc) pairs in which an item's rarest terms (columns, the rarest first) stand near each other."""
    alive = np.flatnonzero(seg.count[rare].min(1) > 0)
    owner, start = seg.starts(rare[alive, 0], np.zeros(len(alive), np.int64))
    for k in range(1, rare.shape[1]):
        if not len(owner):
            break
        doc = seg.doc(start)
        ok = seg.within(rare[alive[owner], k], np.maximum(start - near, seg.first[doc]), np.minimum(start + near, seg.first[doc + 1] - 1))
        owner, start = owner[ok], start[ok]
    return np.unique(np.stack([owners[alive[owner]], seg.doc(start)]), axis=1)


def _search(queries: Broadcast, ranks: Broadcast, near: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, rank = queries.value, ranks.value
        rare_by = q.rarest(rank, NEAR_TERMS)
        for batch in batches:
            for row in batch.to_pylist():
                seg = _Segment(row, len(q.vocabulary))
                docs = len(seg.first) - 1
                edge = np.zeros(int(seg.first[-1]) + 1, np.int64)
                pairs = [np.zeros((2, 0), np.int64)]
                for size, places, items, begin in q.by_length:
                    for win, start in _phrases(seg, q.term, size, places, rank):
                        np.add.at(edge, start, 1)
                        np.add.at(edge, start + size, -1)
                        n = begin[win + 1] - begin[win]
                        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[win], n)
                        pairs.append(np.unique(np.stack([items[at], np.repeat(seg.doc(start), n)]), axis=1))
                close = [np.zeros((2, 0), np.int64), *(_near(seg, t, i, near) for t, i in rare_by)]
                covered = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
                stop = np.zeros(len(covered) - 1, bool)
                stop[seg.first] = True
                inner = covered[1:-1]
                begin_run = np.flatnonzero(inner & (~covered[:-2] | stop[:-1]))
                end_run = np.flatnonzero(inner & (~covered[2:] | stop[1:])) + 1
                of = seg.doc(begin_run)
                n_runs = np.bincount(of, minlength=docs)
                lists = []
                for found in (pairs, close):
                    item, doc = np.unique(np.concatenate(found, axis=1), axis=1)
                    by = np.argsort(doc, kind="stable")
                    lists.append(ragged([q.ids[i] for i in item[by].tolist()], np.bincount(doc, minlength=docs), pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], pa.int64()),
                        pa.array(row["ths"], pa.int64()),
                        pa.array(np.diff(seg.first), pa.int64()),
                        ragged((begin_run - seg.first[of]).astype(np.int32), n_runs, pa.int32()),
                        ragged((end_run - seg.first[of]).astype(np.int32), n_runs, pa.int32()),
                        *lists,
                    ],
                    ["id0", "th", "n_words", "starts", "ends", "items", "near_items"],
                )

    return run


_FOUND = "id0 long, th long, n_words long, starts array<int>, ends array<int>, items array<string>, near_items array<string>"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the runs that several blocks of items have found in one document."""
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            runs: list[list[int]] = []
            for x, y in sorted(zip(row["starts"], row["ends"], strict=True)):
                if runs and x <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], y)
                else:
                    runs.append([x, y])
            row["starts"], row["ends"] = [x for x, _ in runs], [y for _, y in runs]
        yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)


def find_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, near: int = NEAR, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """One row per document: (id_col, th, n_words, starts, ends, items, near_items).

    `starts` and `ends` are the maximal runs of words inside exact phrase matches, `items` the distinct
    ids of the items they belong to, `near_items` those with a proximity match; `th` is xxhash64(text).
    """
    spark = prepare(docs.sparkSession)
    sc, scratch = spark.sparkContext, Scratch(spark, "decontaminate")
    rows = docs.select(named(id_col).cast("long").alias("id0"), F.xxhash64(named(text_col).cast("string")).alias("th"), named(text_col).cast("string").alias("text"))
    tests = items.select(named(item_col).cast("string").alias("item"), named(item_text_col).cast("string").alias("text"))
    size = tests.agg(F.sum(F.octet_length("text") + 24)).first()[0] or 0
    blocks = max(1, -(-size // item_bytes))
    found = []
    for k in range(blocks):
        block = tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()  # below item_bytes, as measured above
        queries = Queries([x.item for x in block], [x.text for x in block], window)
        held = sc.broadcast(queries)
        segments = scratch.table(rows.mapInArrow(_index(sc.broadcast(queries.vocabulary)), _SEGMENT))
        term = segments.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("n")).toArrow()  # the block's vocabulary at most
        counts = np.zeros(len(queries.vocabulary), np.int64)
        counts[np.asarray(term.column(0))] = np.asarray(term.column(1))
        rank = np.empty(len(counts), np.int64)
        rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
        found.append(segments.mapInArrow(_search(held, sc.broadcast(rank), near), _FOUND))
    out = found[0]
    if blocks > 1:
        for x in found[1:]:
            out = out.unionByName(x)
        lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends")] + [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("items", "near_items")]
        out = out.groupBy("id0", "th", "n_words").agg(*lists, F.count("*").alias("rows"))
        out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("rows") / blocks).cast("int"))))  # equal documents
        out = out.select("id0", "th", "n_words", "starts", "ends", "items", "near_items").mapInArrow(_merge, _FOUND)
    listed = lambda c: F.array_sort(F.array_distinct(F.filter(c, lambda x: x.isNotNull()))).alias(c)
    return out.select(F.col("id0").alias(id_col), "th", "n_words", "starts", "ends", listed("items"), listed("near_items"))


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
