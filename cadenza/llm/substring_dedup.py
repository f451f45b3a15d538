"""Substring dedup by fixed-block anchors.

A run of `window` words that occurs twice holds, at either place, one whole block of
``(window + 1) // 2`` words that starts at a multiple of the block length. So:

1. *index* the non-overlapping blocks of every document and *probe* them with every rolling window of
   the block length: a block is an anchor if its words start at two places of the corpus or more;
2. *extend* each anchor to the `window`-long windows around it and keep those that occur twice or more,
   which is exact; chained windows give the maximal exact repeats.

Partitioning. Hashes are dealt by their leading bits into groups whose number follows the input's
partitions, so that a group stays near one size at any input. Texts are hashed in slices, and a slice grows with
the number of groups, so that it sends some hashes to each. It sends a hash once, or twice if it has it twice or
more, so a passage in a third of all rows costs one entry a slice. Places of windows go out by slice, and a
group that has more than `GROUP_BYTES` of them is split by slice: each part meets the group's set of
repeated hashes. Anchors go back to documents in a join that AQE can split. No pair of places is ever formed.
Hash widths: 40 bits plus the group's for probes, where a false match only costs a candidate, and 64
independent bits plus the group's for the windows that decide.

Defined results: a null text has no words; a null id is a value like others (told apart from all numbers); repeated rows are separate
documents, so all their long windows repeat; documents shorter than `window` lose nothing; an empty
table gives an empty table. Only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare
from .rows import named
from .store import Scratch
from .words import SPACED, U64, Words, mix, pack, ragged, rolling, slices

WINDOW = 35
GROUP_BYTES = 64 << 20
_PROBE_BITS = 40
_HASHES = 16 << 20


def group_bits(docs: DataFrame, per_partition: int = 2) -> int:
    """log2 of the number of hash groups: some for each input partition."""
    return min(64 - _PROBE_BITS, max(5, (per_partition * docs.rdd.getNumPartitions() - 1).bit_length()))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, id0, th, text): id0 and a hash of the text tell rows apart unless they are equal; a null id has id0 0 and another hash."""
    key, text = named(id_col).cast("long"), named(text_col).cast("string")
    th = F.when(key.isNull(), F.xxhash64(F.lit("no id"), text)).otherwise(F.xxhash64(text))
    return docs.select(key.alias("id"), F.coalesce(key, F.lit(0)).alias("id0"), th.alias("th"), text.alias("text"))


def _groups(sorted_keys: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The groups that sorted keys fall into, and where each one's part begins and ends."""
    r, first = np.unique(sorted_keys >> U64(low), return_index=True)
    return r, first, np.append(first[1:], len(sorted_keys))


def _five(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _probe(block: int, bits: int):
    low = _PROBE_BITS
    enough = min(_HASHES, 4 << bits)  # a few hashes for each group, in bounded memory

    def packed(keys: list[np.ndarray], blocks: list[np.ndarray]) -> pa.RecordBatch:
        seen, times = np.unique(np.concatenate(keys), return_counts=True)
        every = np.repeat(seen, np.minimum(times, 2))
        anchors = np.unique(np.concatenate(blocks))
        r, a, b = _groups(every, low)
        r2, c, d = _groups(anchors, low)
        of = np.searchsorted(r2, r)
        of[of == len(r2)] = 0
        has = r2[of] == r if len(r2) else np.zeros(len(r), bool)  # each anchor is a probe too
        mine = [_five(anchors[c[k] : d[k]]) if ok else b"" for k, ok in zip(of.tolist(), has.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array([_five(every[x:y]) for x, y in zip(a, b, strict=True)], pa.binary()), pa.array(mine, pa.binary())], ["r", "h", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, blocks, held = [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"), SPACED, False)
                key = rolling(w.h, block) >> U64(64 - low - bits)
                whole = w.left() >= block
                place = np.arange(len(w.h)) - np.repeat(w.first[:-1], w.counts())
                keys.append(key[whole])
                blocks.append(key[whole & (place % block == 0)])
                held += len(keys[-1])
                if held >= enough:
                    yield packed(keys, blocks)
                    keys, blocks, held = [], [], 0
        if held:
            yield packed(keys, blocks)

    return run


def _repeated_blocks(table: pa.Table) -> pa.Table:
    def values(column: str) -> np.ndarray:
        raw = np.frombuffer(b"".join(x for x in table.column(column).to_pylist()), np.uint8).reshape(-1, 5)
        out = np.zeros((len(raw), 8), np.uint8)
        out[:, :5] = raw
        return out.reshape(-1).view(U64)

    every = np.sort(values("h"))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    hit = np.intersect1d(twice, values("a"))
    r = table.column("r")[0].as_py()
    return pa.table({"k": pa.array((hit | U64(r << _PROBE_BITS)).view(np.int64))})


def _blocks(block: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"), SPACED, False)
                place = np.arange(len(w.h)) - np.repeat(w.first[:-1], w.counts())
                at = np.flatnonzero((place % block == 0) & (w.left() >= block))
                key = (rolling(w.h, block)[at] >> U64(64 - _PROBE_BITS - bits)).view(np.int64)
                row = pa.array(w.row()[at])
                yield pa.RecordBatch.from_arrays([pa.array(key), part.column("id0").take(row), part.column("th").take(row), pa.array((place[at] // block).astype(np.int32))], ["k", "id0", "th", "b"])

    return run


def _windows(window: int, block: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"), SPACED, False)
                lists = part.column("blocks")
                n = np.asarray(lists.value_lengths(), np.int64)
                begin = np.repeat(w.first[:-1], n)
                at = begin + np.asarray(lists.flatten(), np.int64) * block
                edge = np.zeros(len(w.h) + 1, np.int64)
                np.add.at(edge, np.maximum(begin, at - (window - block)), 1)
                np.add.at(edge, at + 1, -1)
                cand = np.flatnonzero((np.cumsum(edge)[:-1] > 0) & (w.left() >= window))
                group = (rolling(w.h, window) >> U64(64 - bits)).astype(np.int64)[cand]
                h = rolling(mix(w.h ^ U64(0xA24BAED4963EE407)), window)[cand]
                order = np.lexsort((h, group))
                group, h, cand = group[order], h[order], cand[order].astype(np.uint32)
                rs, first = np.unique(group, return_index=True)
                last = np.append(first[1:], len(group))
                spread = list(zip(rs.tolist(), first, last, strict=True))
                none = [None] * len(spread)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number] * (len(spread) + 1), pa.int64()),
                        pa.array([-1, *rs.tolist()], pa.int32()),
                        pa.array([None, *(pack(cand[x:y]) for _, x, y in spread)], pa.binary()),
                        pa.array([None, *(pack(h[x:y]) for _, x, y in spread)], pa.binary()),
                        pa.array([pack(np.asarray(part.column("id0"), np.int64)), *none], pa.binary()),
                        pa.array([pack(np.asarray(part.column("th"), np.int64)), *none], pa.binary()),
                        pa.array([pack(w.first.astype(np.int64)), *none], pa.binary()),
                    ],
                    ["slice", "r", "at", "h", "ids", "ths", "first"],
                )
                number += 1

    return run


_WINDOWS = "slice long, r int, at binary, h binary, ids binary, ths binary, first binary"


def _once_or_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x in batch.column("h").to_pylist():
            seen, times = np.unique(np.frombuffer(x, U64), return_counts=True)
            out.append(pack(np.repeat(seen, np.minimum(times, 2))))
        yield pa.RecordBatch.from_arrays([batch.column("r"), pa.array(out, pa.binary())], ["r", "h"])


def _repeated(table: pa.Table) -> pa.Table:
    every = np.sort(np.frombuffer(b"".join(table.column("h").to_pylist()), U64))
    return pa.table({"r": table.column("r").slice(0, 1), "twice": pa.array([pack(np.unique(every[1:][every[1:] == every[:-1]]))], pa.binary())})


def _back(window_rows: pa.Table, repeated: pa.Table) -> pa.Table:
    out_slice, out_at = [], []
    if len(repeated) and len(window_rows):
        twice = np.frombuffer(repeated.column("twice")[0].as_py(), U64)
        for s, at, h in zip(*(window_rows.column(c).to_pylist() for c in ("slice", "at", "h")), strict=True):
            at, h = np.frombuffer(at, np.uint32), np.frombuffer(h, U64)
            near = np.minimum(np.searchsorted(twice, h), max(0, len(twice) - 1))
            hit = at[twice[near] == h] if len(twice) else at[:0]
            if len(hit):
                out_slice.append(s)
                out_at.append(pack(hit))
    return pa.table({"slice": pa.array(out_slice, pa.int64()), "at": pa.array(out_at, pa.binary())})


def _spans(window: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(x for x in rows if x["ids"] is not None)
        ids, ths, first = (np.frombuffer(head[c], np.int64) for c in ("ids", "ths", "first"))
        edge = np.zeros(int(first[-1]) + 1, np.int64)
        at = np.frombuffer(b"".join(x["at"] for x in rows if x["at"] is not None), np.uint32).astype(np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        covered = np.cumsum(edge)[:-1] > 0
        stop = np.zeros(len(covered) + 1, bool)
        stop[first] = True
        before = np.concatenate([[False], covered[:-1]])[: len(covered)]
        start = np.flatnonzero(covered & (~before | stop[:-1]))
        after = np.concatenate([covered[1:], [False]])[: len(covered)]
        end = np.flatnonzero(covered & (~after | stop[1:])) + 1
        row = np.searchsorted(first, start, "right") - 1
        hit, n = np.unique(row, return_counts=True)
        begin = np.repeat(first[hit], n)
        return pa.table({"id0": pa.array(ids[hit]), "th": pa.array(ths[hit]), "starts": ragged((start - begin).astype(np.int32), n, pa.int32()), "ends": ragged((end - begin).astype(np.int32), n, pa.int32())})

    return run


def repeated_spans(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id0, th, starts, ends): the maximal runs of words covered by repeated windows, end exclusive.

    Runs of one document that touch are one. Rows equal in id and text give one row here.
    """
    block = (window + 1) // 2
    prepare(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    bits = group_bits(docs)
    texts = keyed.where(F.col("text").isNotNull()).drop("id")
    anchors = scratch.table(
        texts.select("text").mapInArrow(_probe(block, bits), "r int, h binary, a binary").groupBy("r").applyInArrow(_repeated_blocks, "k long")
    )
    held = texts.mapInArrow(_blocks(block, bits), "k long, id0 long, th long, b int").join(anchors, "k", "left_semi")
    found = held.groupBy("id0", "th").agg(F.collect_set("b").alias("blocks"))
    windows = scratch.table(texts.join(found, ["id0", "th"]).mapInArrow(_windows(window, block, bits), _WINDOWS), anchors)
    placed = windows.where("r >= 0").select("slice", "r", "at", "h")
    twice = scratch.table(placed.select("r", "h").mapInArrow(_once_or_twice, "r int, h binary").groupBy("r").applyInArrow(_repeated, "r int, twice binary"))
    parts = placed.groupBy("r").agg(F.ceil(F.sum(F.length("h")) / F.lit(GROUP_BYTES)).cast("int").alias("parts"))
    parts = scratch.table(parts.where("parts > 1"))  # the groups that are split
    many = F.coalesce("parts", F.lit(1))
    left = placed.join(parts, "r", "left").withColumn("s", F.pmod(F.xxhash64("slice"), many).cast("int"))
    right = twice.join(parts, "r", "left").withColumn("s", F.explode(F.sequence(F.lit(0), many - 1)))
    hits = left.select("r", "s", "slice", "at", "h").groupBy("r", "s").cogroup(right.select("r", "s", "twice").groupBy("r", "s")).applyInArrow(_back, "slice long, at binary")
    none = [F.lit(None).cast("binary").alias(c) for c in ("ids", "ths", "first")]
    heads = windows.where("r = -1").select("slice", "at", "ids", "ths", "first")
    hits = hits.select("slice", "at", *none)
    spans = heads.unionByName(hits).groupBy("slice").applyInArrow(_spans(window), "id0 long, th long, starts array<int>, ends array<int>")
    return scratch.table(spans.dropDuplicates(["id0", "th"]), windows, twice)


def join_words(w: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words with a space after each, and where each row's begin."""
    at = np.flatnonzero(keep)
    length = w.end[at] - w.start[at] + 1
    begin = np.concatenate([[0], np.cumsum(length)])
    source = np.repeat(w.start[at] - begin[:-1], length) + np.arange(begin[-1])
    out = w.data[np.minimum(source, max(0, len(w.data) - 1))]
    out[begin[1:] - 1] = 0x20
    return out, begin[np.searchsorted(at, w.first)]


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            w = Words(part.column("text"), SPACED, False)
            edge = np.zeros(len(w.h) + 1, np.int64)
            for name, by in (("starts", 1), ("ends", -1)):
                lists = part.column(name)
                n = np.nan_to_num(np.asarray(lists.value_lengths().fill_null(0)), nan=0).astype(np.int64)
                np.add.at(edge, np.repeat(w.first[:-1], n) + np.asarray(lists.flatten(), np.int64), by)
            keep = np.cumsum(edge)[:-1] == 0
            out, begin = join_words(w, keep)
            kept = [out[x : max(x, y - 1)].tobytes() for x, y in zip(begin[:-1], begin[1:], strict=True)]
            n_kept = np.add.reduceat(np.append(keep, False).astype(np.int64), np.minimum(w.first[:-1], len(keep))) if part.num_rows else np.zeros(0, np.int64)
            n_kept = np.where(w.counts() > 0, n_kept, 0)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(w.counts(), pa.int64()), pa.array(w.counts() - n_kept, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), part.column("starts"), part.column("ends")],
                ["id", "n_words", "n_removed", "kept_text", "starts", "ends"],
            )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: (id_col, n_words, n_removed, kept_text, starts, ends).

    Every word that a repeated `window` covers is removed; `kept_text` joins the others by one space. The
    spans (null: none) are in words, ends exclusive.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    spans = repeated_spans(docs, scratch, id_col, text_col, window)
    with_spans = _keyed(docs, id_col, text_col).join(spans, ["id0", "th"], "left").select("id", "text", "starts", "ends")
    out = with_spans.mapInArrow(_remove, "id long, n_words long, n_removed long, kept_text string, starts array<int>, ends array<int>")
    return out.withColumnRenamed("id", id_col)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
