"""Texts that look the same but are stored in different characters (problem 9).

Method: confusables skeleton.  A text is decomposed, each character is replaced by the
prototype of its look-alikes, and the result is decomposed again; characters without
any appearance are dropped.  Texts of equal skeleton look the same.

The look-alikes of letters are the public confusables table of Unicode Technical
Standard 39 (Unicode licence), as the ICU library that Spark 4 brings along holds it; it
is read on the driver, once a process, and has some thousand entries whatever the data.
That table also folds letter case, digits and marks that are real differences here
(I, l, 1 and |; O and 0; m and rn), so its classes are taken for letters only, a capital
in the class of l stands for I, and prototypes of several letters are left aside.
Letter case, visible accents, digits, punctuation and line breaks thus stay in the
skeleton; an ellipsis and a long s keep their own shape.  Forms that differ in width,
font or breaking, ligatures and Roman numerals follow from their Unicode decomposition.

Defined results: null texts and texts of nothing but white space and invisible
characters belong to no class; rows with one and the same string are never a pair.
"""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.runtime import spread, written

# Characters that leave no mark: soft hyphen, joiners, marks of direction, variation selectors.
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), 0xFEFF, *range(0xFE00, 0xFE10)]
#: Compatibility forms that look like their decomposition.
SAME_SHAPE = ("<wide>", "<narrow>", "<noBreak>", "<font>")
#: Ligatures f-f to s-t, Roman numerals, and blanks of any width.
SAME_SHAPE_RANGES = ((0xFB00, 0xFB07), (0x2160, 0x2180), (0x2000, 0x200B), (0x205F, 0x2060), (0x3000, 0x3001), (0xA0, 0xA1))
# Look-alikes besides those of the public table.
FURTHER = {"‐": "-", "‑": "-", "ӏ": "l", "Ԛ": "Q"}
#: Letters that keep their own shape.
OWN_SHAPE = "ſ"


@cache
def _public_skeletons() -> dict[str, str]:
    """Each undecomposable letter whose public skeleton is another one, with that skeleton."""
    try:
        checker = SparkSession.active()._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    except TypeError as e:  # a package that is not there cannot be called
        raise RuntimeError("the ICU library is not on Spark's class path") from e
    letters = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c)[0] == "L" and unicodedata.normalize("NFD", c) == c]
    # one call: a line end keeps its place in a skeleton
    found = checker.getSkeleton("\n".join(letters)).split("\n")
    return {c: s for c, s in zip(letters, found) if s != c}


@cache
def public_prototypes() -> dict[int, str]:
    """Code points with their prototypes: the letters of the public table, what is invisible, and FURTHER."""
    out = {c: "" for c in INVISIBLE}
    for c, s in _public_skeletons().items():
        s = {"l": "I" if c.isupper() else "l", "rn": "m"}.get(s, s)
        base = [x for x in unicodedata.normalize("NFD", s) if not unicodedata.combining(x)]
        if c not in OWN_SHAPE and len(base) == 1 and base[0].isalpha():
            out[ord(c)] = s
    return out | {ord(c): s for c, s in FURTHER.items()}


def _unfold(ch: str) -> str:
    code = ord(ch)
    out = "".join(_unfold(c) for c in unicodedata.normalize("NFKC", ch)) if _same_shape(ch, code) else unicodedata.normalize("NFD", ch)
    return out if _same_shape(ch, code) or len(out) == 1 else "".join(_unfold(c) for c in out)


def _same_shape(ch: str, code: int) -> bool:
    kind = unicodedata.decomposition(ch).partition(" ")[0]
    return unicodedata.normalize("NFKC", ch) != ch and (kind in SAME_SHAPE or any(a <= code < b for a, b in SAME_SHAPE_RANGES))


class Prototypes(dict):
    """A table for str.translate that fills itself; made from code points with their prototypes."""

    def __init__(self, prototypes: dict[int, str]):
        self.prototypes = prototypes

    def __missing__(self, code: int) -> str:
        """The prototype of one character, decomposed, looked up and decomposed again."""
        self[code] = "".join(self.prototypes.get(ord(c), c) for c in _unfold(chr(code)))
        return self[code]


def skeleton(text: str, table: Prototypes) -> str:
    """The skeleton of a text; two texts look the same when theirs are equal."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(table))


def _digest(s: str) -> bytes:
    return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def skeleton_keys(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, look BINARY, stored BINARY)``: 128-bit digests of skeleton and text, without blank texts.

    The texts are read once: the digests are written, and every use reads those.
    """
    prototypes = df.sparkSession.sparkContext.broadcast(public_prototypes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Prototypes(prototypes.value)
        for batch in batches:
            keep, look, stored = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if t is not None and (s := skeleton(t, table)).strip():
                    keep.append(i)
                    look.append(_digest(s))
                    stored.append(_digest(t))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(look, pa.binary()), pa.array(stored, pa.binary())], names=["key", "look", "stored"])

    part = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text")))
    return written(part.mapInArrow(run, f"key {part.schema['key'].dataType.simpleString()}, look binary, stored binary"))


def look_alike_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, look, stored)`` of the rows whose skeleton is that of several different texts.

    Copies are counted per (skeleton, text) before anything is gathered by skeleton.
    """
    keys = skeleton_keys(df, key, text)
    several = keys.groupBy("look", "stored").agg(F.count("*").alias("n")).groupBy("look").agg(F.count("*").alias("texts")).where("texts > 1").select("look")
    return keys.join(several, "look", "left_semi").select("key", "look", "stored")


def look_alike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(a, b)``, a < b: all pairs of rows that look the same without being the same string."""
    rows = look_alike_classes(df, key, text)
    a, b = rows.alias("a"), rows.alias("b")
    return a.join(b, (F.col("a.look") == F.col("b.look")) & (F.col("a.stored") != F.col("b.stored")) & (F.col("a.key") < F.col("b.key"))).select(F.col("a.key").alias("a"), F.col("b.key").alias("b"))


def look_alike_membership(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, class_key, texts)``: one row per row in a class, with the class's smallest key."""
    rows = look_alike_classes(df, key, text)
    sizes = rows.groupBy("look", "stored").agg(F.min("key").alias("k")).groupBy("look").agg(F.min("k").alias("class_key"), F.count("*").alias("texts"))
    return rows.join(sizes, "look").select("key", "class_key", "texts")
