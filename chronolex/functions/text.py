"""Column functions on text.  All stay in the JVM; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE = r"[^.!?;]+[.!?;]?"
WORD = r"[a-z]+"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def has_word(c: Column, word: str) -> Column:
    """Substring test on the lower-cased text; false for null."""
    return F.coalesce(F.lower(c).contains(word), F.lit(False))


def sentences(c: Column) -> Column:
    """All runs up to a closing mark, in order, not stripped."""
    return F.regexp_extract_all(c, F.lit(SENTENCE), F.lit(0))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def blank_tokens(c: Column) -> Column:
    """Tokens between white space, none empty."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def year_of(date: Column) -> Column:
    """The year of an ISO date, from its first four digits; null for other forms."""
    return F.when(date.rlike(r"^[0-9]{4}"), F.substring(date, 1, 4).cast("int"))


def decade_of(year: Column) -> Column:
    return (year - F.pmod(year, F.lit(10))).cast("int")


def stable_id(date: Column, speaker: Column, index: Column) -> Column:
    """date - six digits of a digest - index of at least three digits."""
    digest = F.substring(F.md5(F.concat_ws("-", date, speaker, index.cast("string"))), 1, 6)
    return F.concat_ws("-", date, digest, F.when(index < 1000, F.lpad(index.cast("string"), 3, "0")).otherwise(index.cast("string")))


def clean_speaker(c: Column) -> Column:
    """Trailing brackets and punctuation removed; empty names as Unknown."""
    s = strip(F.regexp_replace(F.regexp_replace(c, r"\s*\([^)]*\)\s*$", ""), r"[,;.]+\s*$", ""))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("Unknown"))


def strip_markup(c: Column) -> Column:
    """Wiki links keep their label, then tags and templates go."""
    s = F.regexp_replace(c, r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", "$1")
    return F.regexp_replace(F.regexp_replace(s, r"<[^>]+>", " "), r"\{\{[^}]*\}\}", " ")


# Respellings of early modern words, by their plain forms.
RESPELLINGS = {
    "libertie": "liberty", "freedome": "freedom", "subiect": "subject", "iustice": "justice", "vnto": "unto", "vpon": "upon", "haue": "have",
    "loue": "love", "onely": "only", "publike": "public", "musick": "music", "goodnesse": "goodness", "iudge": "judge", "vse": "use", "euery": "every",
}


def normalise_spelling(c: Column, respellings: dict[str, str] = RESPELLINGS) -> Column:
    """Early spelling made modern: long s, vv, a list of words, initial v for u, -ie for -y.

    Keeps the case of a word (all capitals, initial capital, small) and line breaks; runs
    of blanks within a line become one.
    """
    s = F.translate(c, "ſ", "s")
    s = F.replace(F.replace(F.replace(s, F.lit("vv"), F.lit("w")), F.lit("VV"), F.lit("W")), F.lit("Vv"), F.lit("W"))
    table = F.create_map(*[F.lit(x) for kv in respellings.items() for x in kv])
    parts = F.regexp_extract_all(s, F.lit(r"[^\W\d_]+|[\W\d_]+"), F.lit(0))

    def one(w: Column) -> Column:
        new = F.element_at(table, F.lower(w))
        cased = F.when((w == F.upper(w)) & (F.length(w) > 1), F.upper(new)).when(F.substring(w, 1, 1) == F.upper(F.substring(w, 1, 1)), F.initcap(new)).otherwise(new)
        return F.coalesce(cased, w)

    s = F.array_join(F.transform(parts, one), "")
    s = F.regexp_replace(s, r"(?<!\S)v(?=[^aeiouAEIOU\s])", "u")
    s = F.regexp_replace(s, r"(?<!\S)V(?=[^aeiouAEIOU\s])", "U")
    s = F.regexp_replace(s, r"[ \t]+", " ")
    return F.regexp_replace(s, r"(?U)\b(\w{4,})(?:ie|ye)\b", "$1y")


def highlight(c: Column, word: str) -> Column:
    return F.regexp_replace(c, rf"(?i)\b({word})\b", "<mark>$1</mark>")


def prompt_header(year: Column, *parts: Column) -> Column:
    """(year, speaker, party) without what is empty."""
    inner = F.concat_ws(", ", year.cast("string"), *[F.nullif(strip(p), F.lit("")) for p in parts])
    return F.when(inner == "", F.lit("")).otherwise(F.concat(F.lit("("), inner, F.lit(")")))
