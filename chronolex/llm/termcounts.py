"""Occurrences and records of every term and n-gram of a collection (problem 3).

Method: suffix array with common-prefix intervals.  The tokens of a block of records
are one sequence; its suffixes are sorted whole (prefix doubling until all differ) and
the lengths of the common prefixes of neighbours cut the sorted array into one interval
per distinct n-gram, for every n asked for.  The length of an interval is the number of
occurrences; the number of records is that length less the suffixes whose predecessor
from the same record lies in the same interval.

Records are not cut by blocks, so the counts of blocks add up.  They are summed inside
each task, then by Spark with partial aggregation: what is shuffled is one line per
distinct n-gram and task, however often the n-gram occurs, and no term is hot.  Texts
are shuffled only for records that stand in several rows; the ids of those are found by
a scan of the ids alone and broadcast up to ``BROADCAST_IDS``, beyond which all texts are
grouped by id, with the same result.

Defined results: a record is a distinct record id with a text that is not null; copies
of a record count once; a null record id is no record; an empty text is a record
without terms.  An empty collection gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.runtime import spread, written

#: Ids of repeated records that are broadcast, at most (some 16 bytes each).
BROADCAST_IDS = 1_000_000
#: Code points whose suffixes are sorted together.
BLOCK_CHARS = 4_000_000
_KEEP = bytes(b if 97 <= b <= 122 else 10 if b == 10 else 32 for b in range(256))


def suffix_array(tokens: np.ndarray, records: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and common-prefix lengths (counted up to ``depth``) of a token sequence.

    ``tokens`` are numbers from 0, ``records`` the non-decreasing record of each token;
    a suffix ends with its record, equal suffixes stay in the order of their positions.
    ``lcp[i]`` belongs to the neighbours i-1 and i.
    """
    n = len(tokens)
    order = np.argsort(tokens, kind="stable")
    left = np.searchsorted(records, records, side="right") - np.arange(n)  # tokens to the end of the record
    new = np.ones(n, bool)
    new[1:] = tokens[order][1:] != tokens[order][:-1]
    rank = np.empty(n, np.int64)  # where its group of equals begins in ``order``, from 1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    open_ = order[_tied(new)]  # suffixes that equal others so far and go on
    k = 1
    while len(open_):
        ahead = np.zeros(len(open_), np.int64)  # 0 sorts a suffix that ends here before those that go on
        further = left[open_] > k
        ahead[further] = rank[open_[further] + k]
        pair = rank[open_] * (n + 1) + ahead
        by = np.argsort(pair, kind="stable")
        open_, pair, ahead = open_[by], pair[by], ahead[by]
        group, place = rank[open_], np.arange(len(open_))
        head = np.ones(len(open_), bool)
        head[1:] = group[1:] != group[:-1]
        new = np.ones(len(open_), bool)
        new[1:] = pair[1:] != pair[:-1]
        begin = np.maximum.accumulate(np.where(head, place, 0))
        order[group - 1 + place - begin] = open_  # a group is open as a whole
        rank[open_] = group + np.maximum.accumulate(np.where(new, place, 0)) - begin
        open_ = open_[_tied(new) & (ahead > 0)]
        k *= 2
    lcp = np.zeros(n, np.int32)
    a, b = order[:-1], order[1:]
    alive = np.ones(max(0, n - 1), bool)
    for d in range(depth):
        x, y = a + d, b + d
        alive = alive & (x < n) & (y < n)
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        alive &= (tokens[x] == tokens[y]) & (records[x] == records[a]) & (records[y] == records[b])
        lcp[1:] += alive
    return order, lcp


def _tied(new: np.ndarray) -> np.ndarray:
    """Which sorted items equal a neighbour, given where a new value begins."""
    return ~(new & np.append(new[1:], True))


def count_block(tokens: np.ndarray, records: np.ndarray, max_n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each n up to ``max_n``: n, a first position, occurrences and records of every n-gram."""
    if not len(tokens):
        return
    order, lcp = suffix_array(tokens, records, max_n)
    rec = records[order]
    by_rec = np.argsort(rec, kind="stable")
    before = np.full(len(order), -1, np.int64)  # the suffix of the same record that was sorted last before
    same = rec[by_rec][1:] == rec[by_rec][:-1]
    before[by_rec[1:][same]] = by_rec[:-1][same]
    # tokens that are left in its record from each suffix on
    last = np.searchsorted(records, records, side="right")
    left = (last - np.arange(len(tokens)))[order]
    for n in range(1, max_n + 1):
        interval = np.cumsum(lcp < n) - 1
        twice = (before >= 0) & (interval[before] == interval)
        occurrences = np.bincount(interval)
        doubles = np.bincount(interval[twice], minlength=len(occurrences))
        first = np.flatnonzero(lcp < n)
        whole = left[first] >= n  # shorter suffixes are no n-grams
        yield n, order[first[whole]], occurrences[whole], (occurrences - doubles)[whole]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    part, n = [], 0
    for batch in batches:
        for t in batch.column(0).to_pylist():
            part.append(t)
            n += len(t)
            if n > BLOCK_CHARS:
                yield part
                part, n = [], 0
    if part:
        yield part


def tokenise(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers, their records, and the vocabulary; a token is a run of a-z in lower case."""
    flat = "\n".join(t.replace("\n", " ") for t in texts).lower().encode("utf-8", "replace").translate(_KEEP).decode("ascii")
    words: list[str] = []
    counts = []
    for line in flat.split("\n"):
        w = line.split()
        words += w
        counts.append(len(w))
    codes, vocabulary = pd.factorize(np.array(words, dtype=object)) if words else (np.zeros(0, np.int64), np.zeros(0, object))
    return codes, np.repeat(np.arange(len(counts)), counts), vocabulary


def _one_text_a_record(df: DataFrame, record: str, text: str) -> DataFrame:
    """``(t)``: the least text of every record; only repeated records are shuffled with their texts."""
    rows = spread(df.select(F.col(record).alias("r"), F.col(text).alias("t")).where("r is not null and t is not null"))
    repeated = written(df.select(F.col(record).alias("r")).where("r is not null").groupBy("r").count().where("count > 1").select("r"))
    if repeated.count() > BROADCAST_IDS:
        return rows.groupBy("r").agg(F.min("t").alias("t")).select("t")
    ids = F.broadcast(repeated)
    return rows.join(ids, "r", "left_anti").select("t").unionByName(rows.join(ids, "r", "left_semi").groupBy("r").agg(F.min("t").alias("t")).select("t"))


def ngram_counts(df: DataFrame, record: str, text: str, *, max_n: int = 1) -> DataFrame:
    """``(n, term, occurrences, records)`` of every n-gram of up to ``max_n`` words."""
    texts = _one_text_a_record(df, record, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            codes, records, vocabulary = tokenise(part)
            for n, at, occurrences, found in count_block(codes, records, max_n):
                term = vocabulary[codes[at]]
                for d in range(1, n):
                    term = term + " " + vocabulary[codes[at + d]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, np.int32)), pa.array(term, pa.string()), pa.array(occurrences.astype(np.int64)), pa.array(found.astype(np.int64))], names=["n", "term", "occurrences", "records"])

    parts = texts.mapInArrow(run, "n int, term string, occurrences long, records long")
    return parts.groupBy("n", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark_terms(df: DataFrame, record: str = "speech_id", text: str = "speech", *, rare_below: int = 3, common_share: tuple[int, int] = (1, 5), max_n: int = 1) -> DataFrame:
    """``ngram_counts`` with ``mark``: 'rare' in fewer than ``rare_below`` records, 'common' in more than the share of all records, else null."""
    everything = df.where(F.col(record).isNotNull() & F.col(text).isNotNull()).agg(F.countDistinct(record).alias("all_records"))
    a, b = common_share
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") * b > F.col("all_records") * a, "common")
    return ngram_counts(df, record, text, max_n=max_n).crossJoin(F.broadcast(everything)).select("n", "term", "occurrences", "records", mark.alias("mark"))  # broadcasts one row
