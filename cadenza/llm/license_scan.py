"""License scans with a positional rare-token index of licence texts.

The texts of `licenses` are cut into clauses. The index holds, for each clause, the postings (word positions)
of its highest-IDF words; IDF counts licence words over *every* file. A file's licence words are looked
up in it, and each (word place, clause position) pair votes for the place where the clause would begin. Where
enough of a clause's rare words agree on one beginning, the clause is laid over the file there: its key
phrases must stand in full at their positions, and the words that match make up its share of the IDF.

Of a licence's clauses that are verified at one place the one that fits best counts. Clauses that follow each other in their order, none farther on than the licence is long,
make a finding; what stands between may differ. The finding counts if every clause with a
mandatory phrase is there, and with `COVERED` of the licence's IDF; that share is its score.

Base phrases are found everywhere as plain consecutive words; the method only adds labels.

The index and the phrases are fixed and small, so they go out as a broadcast. Two passes read whole
texts, without exchange of texts. Votes are counted per slice of files, so a frequent notice costs what
its places cost.

Defined results: null or wordless texts have no words, no labels and score 0; equal and repeated files
are scanned each; a null id is returned as it is; an empty table gives an empty table. The score is the
best finding's, else `MENTION` where a base phrase stands, else 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare
from .licenses import PHRASES, TEMPLATES
from .rows import named
from .words import ALNUM, Words, ragged, slices

AGREE, COVERED, MENTION, RARE = 0.6, 0.6, 0.5, 0.5


def _hashes(text: str) -> np.ndarray:
    return Words(pa.array([text]), ALNUM, True).h


def clauses(text: str) -> list[str]:
    return [x for x in text.split("\n\n") if x.strip()]


class Notices:
    """Clauses and phrases as numbers of their sorted vocabulary; with counts of files, the rare-word index."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES) -> None:
        parts = [[_hashes(c) for c in clauses(t)] for _, t, _ in templates]
        bases = [_hashes(p) for p, _ in phrases]
        self.vocabulary = np.unique(np.concatenate([*(c for p in parts for c in p), *bases]))
        number = lambda h: np.searchsorted(self.vocabulary, h)
        self.labels = [x for x, _, _ in templates]
        self.clauses = [number(h) for p in parts for h in p]
        self.of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])  # the licence of each clause
        self.length = np.array([sum(len(h) for h in p) for p in parts])
        self.phrases = [(number(h), label) for h, (_, label) in zip(bases, phrases, strict=True)]
        self.mandatory = [np.zeros(len(h), bool) for p in parts for h in p]
        flat = [h for p in parts for h in p]
        for licence, (label, _, keys) in enumerate(templates):
            for key in keys:
                k = _hashes(key)
                at = [(c, i) for c in np.flatnonzero(self.of == licence).tolist() for i in range(len(flat[c]) - len(k) + 1) if (flat[c][i : i + len(k)] == k).all()]
                if not at:
                    raise ValueError(f"the key phrase {key!r} is not in a clause of its licence ({label})")
                c, i = at[0]
                self.mandatory[c][i : i + len(k)] = True
        self.needed = np.bincount(self.of, [m.any() for m in self.mandatory], minlength=len(parts)).astype(int)

    def index(self, files: int, with_word: np.ndarray) -> None:
        self.idf = np.log((files + 1) / (with_word + 1)) + 1e-6
        self.weight = np.array([self.idf[t].sum() for t in self.clauses])
        self.share = self.weight / np.bincount(self.of, self.weight)[self.of]  # of its licence
        word, clause, place = [], [], []
        self.anchors = np.zeros(len(self.clauses), np.int64)
        for k, t in enumerate(self.clauses):
            rare = np.flatnonzero(self.idf[t] >= RARE * self.idf[t].max())
            self.anchors[k] = len(rare)
            word += t[rare].tolist()
            clause += [k] * len(rare)
            place += rare.tolist()
        order = np.argsort(word, kind="stable")
        self.post_clause, self.post_place = np.array(clause)[order], np.array(place)[order]
        self.post_n = np.bincount(np.array(word), minlength=len(self.vocabulary))
        self.post_begin = np.cumsum(self.post_n) - self.post_n

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the licence words among `h`."""
        near = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        at = np.flatnonzero(self.vocabulary[near] == h)
        return at, near[at]


def _document_counts(notices):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = notices.value
        files, counts = 0, np.zeros(len(n.vocabulary), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"), ALNUM, True)
                at, word = n.find(w.h)
                files += w.rows
                counts += np.bincount(np.unique(w.row()[at] * len(counts) + word) % len(counts), minlength=len(counts))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(counts))], pa.int32()), pa.array([files, *counts.tolist()], pa.int64())], ["word", "n"])

    return run


def build_index(files: DataFrame, text_col: str = "text", templates=TEMPLATES, phrases=PHRASES) -> Notices:
    """The index of the licence texts, with licence words weighed by their IDF over all files."""
    spark = prepare(files.sparkSession)
    notices = Notices(templates, phrases)
    held = spark.sparkContext.broadcast(notices)
    counts = files.select(named(text_col).cast("string").alias("text")).mapInArrow(_document_counts(held), "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r.word: r.n for r in counts.collect()}  # a row for each word of the licences
    notices.index(found.get(-1, 0), np.array([found.get(k, 0) for k in range(len(notices.vocabulary))]))
    return notices


def _verified(n: Notices, w: Words, at: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, clause, first word place, score) of every clause that stands in a file."""
    hits = n.post_n[word]
    owner = np.repeat(np.arange(len(at)), hits)
    post = np.arange(int(hits.sum())) - np.repeat(np.cumsum(hits) - hits, hits) + np.repeat(n.post_begin[word], hits)
    clause, start = n.post_clause[post], at[owner] - n.post_place[post]
    row = w.row()
    of = row[at[owner]]
    inside = (start >= w.first[of]) & (start + np.array([len(t) for t in n.clauses])[clause] <= w.first[of + 1])
    places, votes = np.unique(np.stack([clause, start])[:, inside], axis=1, return_counts=True)
    dense = np.full(len(w.h) + 1, -1, np.int64)
    dense[at] = word
    out = []
    for k in np.unique(places[0]).tolist():
        t = n.clauses[k]
        s = places[1][(places[0] == k) & (votes >= AGREE * n.anchors[k])]
        if len(s):
            same = dense[s[:, None] + np.arange(len(t))] == t
            score = (same * n.idf[t]).sum(1) / n.weight[k]
            ok = same[:, n.mandatory[k]].all(1) & (score >= COVERED)
            out.append(np.stack([row[s[ok]], np.full(int(ok.sum()), k), s[ok], np.minimum(1, score[ok])]))
    found = np.concatenate(out, axis=1) if out else np.zeros((4, 0))
    return found[0].astype(np.int64), found[1].astype(np.int64), found[2].astype(np.int64), found[3]


def _findings(n: Notices, row: np.ndarray, clause: np.ndarray, start: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, licence, begin, end, score) of the licences that verified clauses make up."""
    licence = n.of[clause]
    if not len(row):
        return row, licence, start, start, score
    order = np.lexsort((clause, -score, start, licence, row))
    key = np.stack([row, licence, start])[:, order]
    best = order[np.append(True, (key[:, 1:] != key[:, :-1]).any(0))]  # of like clauses at one place the one that fits best
    row, clause, start, score, licence = row[best], clause[best], start[best], score[best], licence[best]
    end = start + np.array([len(t) for t in n.clauses])[clause]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (licence[1:] != licence[:-1]) | (clause[1:] <= clause[:-1]) | (start[1:] - end[:-1] > n.length[licence[1:]])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(row)) - 1
    must = np.array([m.any() for m in n.mandatory])[clause]
    whole = np.add.reduceat(must.astype(int), first) == n.needed[licence[first]]
    total = np.add.reduceat(score * n.share[clause], first)
    ok = whole & (total >= COVERED)
    return row[first][ok], licence[first][ok], start[first][ok], end[last][ok], np.minimum(1, total[ok])


def _scan(notices):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = notices.value
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"), ALNUM, True)
                at, word = n.find(w.h)
                dense = np.full(len(w.h), -1, np.int64)
                dense[at] = word
                left, row = w.left(), w.row()
                base, names = [np.zeros(0, np.int64)], [set() for _ in range(w.rows)]
                for phrase, label in n.phrases:
                    ok = (dense == phrase[0]) & (left >= len(phrase))
                    for k in range(1, len(phrase)):
                        ok[: len(ok) - k] &= dense[k:] == phrase[k]
                    found = np.flatnonzero(ok)
                    base.append(found)
                    for r in np.unique(row[found]).tolist():
                        names[r].add(label)
                places = np.sort(np.concatenate(base))
                of = row[places]
                n_base = np.bincount(of, minlength=w.rows)
                first, last = np.full(w.rows, -1), np.full(w.rows, -1)
                last[of] = places - w.first[of]
                first[of[::-1]] = (places - w.first[of])[::-1]
                t_row, t, t_at, t_end, t_score = _findings(n, *_verified(n, w, at, word))
                by = np.lexsort((t, t_at, t_row))
                t_row, t, t_at, t_end, t_score = (x[by] for x in (t_row, t, t_at, t_end, t_score))
                best = np.where(n_base > 0, MENTION, 0.0)
                best[t_row] = 0
                np.maximum.at(best, t_row, t_score)
                labels = [set(x) for x in names]
                for r, k in zip(t_row.tolist(), t.tolist(), strict=True):
                    labels[r].add(n.labels[k])
                per = np.bincount(t_row, minlength=w.rows)
                t_at, t_end = t_at - w.first[t_row], t_end - w.first[t_row]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), pa.array(w.counts(), pa.int64()), pa.array(n_base, pa.int64()),
                        pa.array(first, pa.int64(), mask=first < 0), pa.array(last, pa.int64(), mask=last < 0),
                        pa.array([sorted(x) for x in names], pa.list_(pa.string())), pa.array([sorted(x) for x in labels], pa.list_(pa.string())), pa.array(best, pa.float64()),
                        ragged([n.labels[k] for k in t.tolist()], per, pa.string()), ragged(t_at, per, pa.int64()), ragged(t_end, per, pa.int64()), ragged(t_score, per, pa.float64()),
                    ],
                    ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notice", "begin", "end", "covered"],
                )

    return run


_FOUND = "id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, notice array<string>, begin array<long>, end array<long>, covered array<double>"


def scan(files: DataFrame, notices: Notices, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per file: id, n_words, n_base, first_word, last_word, base_labels, labels, score, notices.

    `notices` lists the findings as (label, begin, end, covered), places in words, end exclusive.
    """
    spark = prepare(files.sparkSession)
    rows = files.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_scan(spark.sparkContext.broadcast(notices)), _FOUND)
    spans = F.arrays_zip(F.col("notice").alias("label"), "begin", "end", "covered").alias("notices")
    return out.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", spans)


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, build_index(docs))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
