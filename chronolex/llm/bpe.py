"""Byte-level BPE encoding of a corpus with a public vocabulary (problem 7).

Method: pair occurrence index.  All distinct pre-tokens of a batch are laid out as
one sequence of symbols; a dictionary maps every mergeable adjacent pair to all the
positions where it occurs.  Active merge ranks are then applied in ascending order,
each at all its positions at once, and only the occurrence lists of the neighbouring
pairs are updated.  A merged symbol exists only after its own rank was applied, so
every pair it forms has a later rank, and one ascending pass is exact.

Defined results: a null and an empty text give an empty list; strings that look like
special tokens are ordinary text; keys may be null or repeated, each row is encoded.
Only the key and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from functools import cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chronolex.runtime import spread

DEFAULT_TOKENIZER = os.path.join(os.environ.get("CHRONOLEX_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.json")

# Fixed value: the pre-token pattern that belongs to this family of vocabularies.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Distinct pre-tokens that a Python worker remembers before it starts afresh.  A bound
#: on memory only: forgotten pre-tokens are encoded again.
REMEMBERED = 500_000
#: Code points that are handled at a time.
CHARS_AT_ONCE = 4_000_000


def read_tokenizer(path: str = DEFAULT_TOKENIZER) -> bytes:
    """The vocabulary file, read on the driver; about 1.5 MB, whatever the data."""
    with open(path, "rb") as f:
        return f.read()


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves, the others take the code points from 256 on.
    """
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def pattern_of(tokenizer: dict) -> str:
    """The pre-token pattern that a tokenizer file asks for; other ways of cutting texts are refused."""
    pre = tokenizer.get("pre_tokenizer") or {}
    if tokenizer.get("normalizer") is not None or tokenizer["model"].get("type", "BPE") != "BPE":
        raise ValueError("only byte-level BPE without a normalizer is encoded")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
        return PRETOKEN
    parts = pre.get("pretokenizers", []) if pre.get("type") == "Sequence" else []
    if len(parts) == 2 and parts[0]["type"] == "Split" and parts[0]["behavior"] == "Isolated" and "Regex" in parts[0]["pattern"] and parts[1]["type"] == "ByteLevel" and not parts[1].get("use_regex", True) and not parts[1].get("add_prefix_space"):
        return parts[0]["pattern"]["Regex"]
    raise ValueError(f"pre-tokens of this kind are not known: {pre}")


class PairIndexEncoder:
    """Encodes batches of distinct pre-tokens by a pair occurrence index."""

    def __init__(self, blob: bytes):
        tokenizer = json.loads(blob)
        model = tokenizer["model"]
        vocab = model["vocab"]
        self.byte_id = [vocab[c] for c in _byte_letters()]
        self.merges: list[tuple[int, int, int]] = []
        self.rank: dict[tuple[int, int], int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges.append((vocab[a], vocab[b], vocab[a + b]))
            self.rank[vocab[a], vocab[b]] = r
        self.known: dict[str, list[int]] = {}
        self.split = regex.compile(pattern_of(tokenizer)).findall

    def encode_distinct(self, words: list[str]) -> list[list[int]]:
        """Ids of each of ``words``, all merged together rank by rank."""
        byte_id, rank = self.byte_id, self.rank
        sym: list[int] = []
        starts = []
        for w in words:
            starts.append(len(sym))
            sym.extend([byte_id[b] for b in w.encode("utf-8")])
            sym.append(-1)  # no pair has -1, so nothing merges across pre-tokens
        n = len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        at: dict[int, list[int]] = {}
        for i in range(n - 1):
            r = rank.get((sym[i], sym[i + 1]))
            if r is not None:
                at.setdefault(r, []).append(i)
        active = list(at)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            a, b, merged = self.merges[r]
            for i in sorted(at.pop(r)):
                if sym[i] != a:
                    continue
                j = right[i]
                if j >= n or sym[j] != b:
                    continue
                sym[i], sym[j] = merged, -2
                k = right[i] = right[j]
                left[k] = i
                for p, q in ((left[i], i), (i, k)):
                    if p >= 0 and q < n and (s := rank.get((sym[p], sym[q]))) is not None:
                        if s in at:
                            at[s].append(p)
                        else:
                            at[s] = [p]
                            heapq.heappush(active, s)
        out = []
        for i in starts:
            ids = []
            while sym[i] != -1:
                ids.append(sym[i])
                i = right[i]
            out.append(ids)
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        pieces = [self.split(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set(chain.from_iterable(pieces)).difference(self.known))
        self.known.update(zip(new, self.encode_distinct(new)))
        known = self.known
        return [list(chain.from_iterable([known[w] for w in p])) for p in pieces]


@cache
def encoder(blob: bytes) -> PairIndexEncoder:
    """One encoder for each vocabulary in a Python worker."""
    return PairIndexEncoder(blob)


def in_slices(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in order, in lists of about CHARS_AT_ONCE; null as empty."""
    part, n = [], 0
    for t in texts:
        part.append(t or "")
        n += len(part[-1])
        if n > CHARS_AT_ONCE:
            yield part
            part, n = [], 0
    if part:
        yield part


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", *, ids: str = "ids", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``(key, ids ARRAY<INT>)`` for every row of ``df``; no special tokens are added."""
    return _per_text(df, key, text, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), tokenizer)


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", *, tokens: str = "tokens", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``(key, tokens INT)`` for every row of ``df``: the length of its encoding."""
    return _per_text(df, key, text, T.StructField(tokens, T.IntegerType(), False), tokenizer)


def _per_text(df: DataFrame, key: str, text: str, field: T.StructField, tokenizer: str) -> DataFrame:
    if field.name == key:
        raise ValueError(f"the result column {field.name!r} has the name of the key")
    blob = df.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))
    whole = isinstance(field.dataType, T.ArrayType)
    kind = pa.list_(pa.field("element", pa.int32(), nullable=False)) if whole else pa.int32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(blob.value)
        for batch in batches:
            done = 0
            for part in in_slices(batch.column(1).to_pylist()):
                found = e.encode(part)
                sizes = [len(x) for x in found]
                if whole:
                    ends = pa.array([0, *sizes], pa.int64()).to_numpy().cumsum()
                    col = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(list(chain.from_iterable(found)), pa.int32()), type=kind)
                else:
                    col = pa.array(sizes, pa.int32())
                keys = batch.column(0).slice(done, len(part))
                done += len(part)
                yield pa.RecordBatch.from_arrays([keys, col], names=[key, field.name])

    part = spread(df.select(key, text))
    return part.mapInArrow(run, T.StructType([part.schema[key], field]))
