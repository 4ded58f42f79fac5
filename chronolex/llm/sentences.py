"""Sentence boundaries across languages and scripts (problem 4).

Method: candidate boundaries are generated and each is classified by a maximum-entropy
model over its neighbouring tokens, their case, length, digits and script.

Candidates are runs of closing punctuation outside quotations and brackets, closing
marks of quotations and brackets that hold a finished sentence, and, in Thai, which
writes no full stop, the spaces between words.  A line break ends a sentence by itself,
but for a wrapped line: one that ends in a letter, a figure, a comma, a semicolon or a
hyphen and goes on with a small letter on the very next line.

Two statistics of every token, counted over all texts, say how often it stands last
before a line break or the end of a text, and how often first.  The model is trained on
reliable boundaries: ends of paragraphs, read as if the next paragraph followed on the
same line, and places that cannot be one (before a small letter or a comma, after a
token that never ends a paragraph, before one that never begins one).  Training uses at
most ``TRAINING_TEXTS`` texts, chosen by hash; the statistics and the classification
cover every text whole.  Statistics and weights are hashed into tables of ``BUCKETS``
entries, so what is broadcast has a fixed size.

Tokens are told apart by at most ``TOKEN_CHARS`` characters: the last of the token before
a candidate (looked for among the ``TOKEN_REACH`` characters before it) and the first of
the token after it.  A longer token counts as the one it is cut to; it is never skipped.
The classifier is fitted on at most ``TRAINING_EXAMPLES`` different examples, drawn by
hash, an example that occurs often weighing as ``MOST_WEIGHT`` at most.

A line is scanned once, whatever its length and however many of its brackets or
quotations stay open; these then enclose nothing.

Defined results: null and blank texts have no sentence; the last sentence ends with the
last character that is not white space; lengths count code points; copies of a row are
answered alike.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.runtime import spread

BUCKETS = 1 << 18
#: Texts on which the classifier is fitted, at most.
TRAINING_TEXTS = 30_000
#: Different examples on which the classifier is fitted, at most, and the most one may weigh.
TRAINING_EXAMPLES = 1_000_000
MOST_WEIGHT = 20
#: Characters by which tokens are told apart, and how far back a token is looked for.
TOKEN_CHARS, TOKEN_REACH = 16, 24
#: Occurrences from which a token's statistics are trusted.
SEEN = 15

# Marks that end sentences, and pairs of marks that enclose text.
ENDERS = ".!?…‥。！？｡．।॥؟۔։።;\u037e"
PAIRS = {"“": "”", "«": "»", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "［": "］", "【": "】", "‘": "’", "„": "“", "‹": "›", "{": "}"}
CLOSERS = "”»」』)]）］】’›}\""
_OPENERS = "".join(PAIRS) + '"¿¡'
_SPECIAL = re.compile("[" + re.escape(ENDERS) + "]+|[" + re.escape("".join({*PAIRS, *PAIRS.values(), '"'})) + "]|(?<=[ก-๛]) +(?=\\S)")
_LEFT = re.compile(r"\S+$")
_RIGHT = re.compile(r"\s*([^\W\d_]+|\d+|\S)?")
_DIGITS = str.maketrans("0123456789", "9999999999")
_LINE = re.compile(r"[^\n\r  ]+")
_GOES_ON = ",;-‐\xad"
_GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
_SEMICOLONS = {";", "\u037e"}
_ENCLOSING = re.compile("[" + re.escape("".join({*PAIRS, *PAIRS.values(), '"'})) + "]")
_OPENED_BY = {c: tuple(o for o in (*PAIRS, '"') if PAIRS.get(o, '"') == c) for c in (*PAIRS.values(), '"')} | {"”": ("“", "„")}
_ENDS_QUOTE = ENDERS + ",”"


def _wide(ch: str) -> bool:
    """Characters of scripts without spaces between words, other than Thai."""
    return "⺀" <= ch <= "鿿" or "豈" <= ch <= "﫿" or "ｦ" <= ch <= "ﾟ"


def _left_token(text: str, end: int) -> str:
    if end and _wide(text[end - 1]):
        return text[max(0, end - 2) : end]
    m = _LEFT.search(text, max(0, end - TOKEN_REACH), end)
    token = m.group().lstrip(_OPENERS).translate(_DIGITS)[-TOKEN_CHARS:] if m else ""
    head, dot, tail = token.rpartition(".")
    # a sentence that begins without a space after the last: "pension.Mr"
    return tail if dot and len(tail) > 1 and tail[0].isupper() and head[-2:].isalpha() and head[-2:].islower() else token


def _right_token(text: str, start: int, stop: int) -> tuple[str, int]:
    """The next token and where it begins."""
    m = _RIGHT.match(text, start, stop)
    token = m.group(1) or ""
    at = m.start(1) if token else stop
    if token and _wide(token[0]):
        return token[:2], at
    return "9" if token.isdecimal() else token[:TOKEN_CHARS], at


class Candidate:
    __slots__ = ("end", "first", "gap", "kind", "last", "left", "right")

    def __init__(self, end, kind, left, right, gap, first, last):
        self.end, self.kind, self.left, self.right, self.gap, self.first, self.last = end, kind, left, right, gap, first, last


def _brackets(text: str, a: int, b: int) -> dict[int, int]:
    """Which opener each closer of a line closes; openers that are never closed are in no pair.

    One pass: what an opener encloses does not depend on openers that stay open.
    """
    pairs: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    waiting: dict[str, int] = {}  # how many openers of each kind are on the stack
    last_apostrophe = text.rfind("’", a, b)

    def close(kinds: tuple[str, ...], at: int) -> bool:
        if not any(waiting.get(k) for k in kinds):
            return False
        while True:  # every opener is taken off once
            ch, begin = stack.pop()
            waiting[ch] -= 1
            if ch in kinds:
                pairs[at] = begin
                return True

    for m in _ENCLOSING.finditer(text, a, b):
        s, ch = m.start(), m.group()
        if ch == "’":
            done = s > a and text[s - 1] in _ENDS_QUOTE
            inner = s + 1 < b and text[s + 1].isalpha()
            if not inner and (done or last_apostrophe <= s):
                close(("‘",), s)
            continue
        if ch == "‘" and s > a and text[s - 1].isalnum():
            continue
        if close(_OPENED_BY.get(ch, ()), s):
            continue
        if ch in PAIRS or ch == '"':
            stack.append((ch, s))
            waiting[ch] = waiting.get(ch, 0) + 1
    return pairs


def _marks(text: str, a: int, b: int) -> list:
    """(start, end, kind) of the candidates of a line, in one pass over it."""
    out: list = []
    closes = _brackets(text, a, b)
    opens = set(closes.values())
    open_: list[tuple[int, bool]] = []
    content_from = a
    letters_to, letter = a, -1  # the last letter of what was looked through so far

    def alone(at: int) -> bool:
        """Nothing but finished sentences so far."""
        k = at - 1
        while k >= a and text[k].isspace():
            k -= 1
        return k < a or k < content_from or text[k] in ENDERS

    for m in _SPECIAL.finditer(text, a, b):
        s, e = m.span()
        ch = text[s]
        if ch in ENDERS:
            if open_:
                continue
            if ch in _SEMICOLONS and set(m.group()) <= _SEMICOLONS:
                for k in range(letters_to, s):
                    if text[k].isalpha():
                        letter = k
                letters_to = s
                if ch == ";" and not (letter >= a and _GREEK.match(text[letter])):
                    continue
            while e < b and text[e] in CLOSERS and text[e] not in '"’':
                e += 1
            out.append((s, e, m.group()[-1] if len(m.group()) < 2 or m.group()[-1] != "." else ".."))
            content_from = e
        elif ch == " ":
            if not open_:
                out.append((s, s, "thai"))
        elif s in closes:
            begin = closes[s]
            while open_[-1][0] > begin:
                open_.pop()
            own = open_.pop()[1]
            k = s - 1
            while k > a and text[k].isspace():
                k -= 1
            if not open_ and text[k] in ENDERS:
                out.append((s, e, "alone" if own else "within"))
                if own:
                    content_from = e
            elif not open_ and own and ch in ")]）］】":
                out.append((s, e, "aside"))
        elif s in opens:
            open_.append((s, alone(s)))
    return out


def _logical_lines(text: str) -> list[tuple[int, int]]:
    """Begin and end of each line; a line that goes on with a small letter is one with the next."""
    lines: list[tuple[int, int]] = []
    for m in _LINE.finditer(text):
        a, b = m.span()
        while a < b and text[a].isspace():
            a += 1
        if a == b:
            continue
        if lines and text[a].islower():
            begin, end = lines[-1]
            while text[end - 1].isspace():
                end -= 1
            if (text[end - 1].isalnum() or text[end - 1] in _GOES_ON) and text.count("\n", end, a) < 2:
                lines[-1] = (begin, b)
                continue
        lines.append((m.start(), b))
    return lines


def candidates(text: str) -> Iterator[Candidate]:
    """All candidate boundaries of a text in order; ``last`` marks ends of paragraphs."""
    lines = _logical_lines(text)
    for i, (a, b) in enumerate(lines):
        while b > a and text[b - 1].isspace():
            b -= 1
        marks = _marks(text, a, b)
        begin = a
        while begin < b and text[begin].isspace():
            begin += 1
        for s, e, kind in marks:
            left = _thai_tail(text, s) if kind == "thai" else _left_token(text, s) if kind not in ("alone", "within", "aside") else ""
            if e >= b:
                nxt = _right_token(text, *lines[i + 1])[0] if i + 1 < len(lines) else None
                yield Candidate(b, kind, left, nxt, True, _is(text, begin, s, left), True)
            else:
                right, at = _right_token(text, e, b)
                first = _is(text, begin, s, left)
                yield Candidate(e, kind, left, right, at > e, first, False)
                if kind != "thai" and at > e and first:
                    begin = at
        if not marks or marks[-1][1] < b:
            thai = "ก" <= text[b - 1] <= "๛"
            nxt = _right_token(text, *lines[i + 1])[0] if i + 1 < len(lines) else None
            yield Candidate(b, "thai" if thai else "line", _thai_tail(text, b) if thai else "", nxt, True, False, True)


def _is(text: str, a: int, b: int, token: str) -> bool:
    return b - a == len(token) and text.startswith(token, a)


def _thai_tail(text: str, end: int) -> str:
    return text[max(0, end - 4) : end]


def _shape(token: str | None) -> str:
    """Case, length, digits and script of a token."""
    if token is None:
        return "end"
    if not token:
        return "none"
    c = token[0]
    if c.isdigit():
        return "number" if token.isdigit() else "mixed"
    if not c.isalpha():
        return "mark" + c if c in ".,;:!?-–—)]”»…·/%、，" else "open" if c in _OPENERS else "other"
    name = unicodedata.name(c, "?").split(" ")[0]
    case = "upper" if c.isupper() else "lower" if c.islower() else "plain"
    if case == "plain":
        return "plain-" + name
    inner = "." in token
    size = "1" if len(token) == 1 else "2" if len(token) == 2 else "3" if len(token) == 3 else "n"
    return f"{case}{size}{'d' if inner else ''}{'A' if len(token) > 1 and token.isupper() else ''}-{name}"


def _bucket(s: str) -> int:
    return crc32(s.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def _left_key(c: Candidate) -> str:
    return f"L{c.kind}\t{c.left}" if c.kind in (".", "thai") else f"L{c.kind}"


def _right_key(token: str) -> str:
    return f"R\t{token}"


#: What follows and so rules a boundary out.
_NEVER_NEXT = ("lower", "mark")


class Statistics:
    """How often tokens stood before or after a candidate, and at the edge of a paragraph."""

    def __init__(self, seen: np.ndarray, edge: np.ndarray):
        self.seen, self.edge = seen, edge
        self.cache: dict[str, tuple[float, int]] = {}

    def rate(self, key: str) -> tuple[float, float]:
        i = _bucket(key)
        return float(self.seen[i]), float(self.edge[i])

    def bin(self, key: str) -> tuple[int, bool, bool]:
        """A level for the model, and whether the token is reliably never or often at an edge."""
        got = self.cache.get(key)
        if got is None:
            n, e = self.rate(key)
            share = (e + 0.5) / (n + 1)
            level = 0 if n < 4 else 1 + int(np.searchsorted([0.004, 0.012, 0.03, 0.08, 0.2], share))
            got = self.cache[key] = (level, n >= SEEN and e <= 0.008 * n, n >= SEEN and e >= 0.05 * n)
            if len(self.cache) > 500_000:
                self.cache.clear()
        return got


def features(c: Candidate, stats: Statistics) -> list[str]:
    """Names of the active features."""
    lk = _left_key(c)
    lb, rb = stats.bin(lk)[0], stats.bin(_right_key(c.right))[0] if c.right else 9
    ls, rs = _shape(c.left), _shape(c.right)
    gap = "s" if c.gap else "t"
    r2 = rs[:5] if rs.startswith(("upper", "lower", "plain")) else rs
    return [
        "b", f"k{c.kind}", f"l{lk}", f"ls{ls}", f"lb{c.kind}{lb}", f"r{c.right}", f"rs{rs}", f"rb{rb}", f"g{gap}{r2}", f"k{c.kind}|{r2}|{gap}",
        f"lr{ls}|{rs}", f"lb{lb}|{r2}|{gap}", f"rb{rb}|{ls}", f"bb{lb}|{rb}|{r2}", f"f{c.first}|{ls}|{r2}",
    ]


def reliable(c: Candidate, stats: Statistics) -> int | None:
    """1 or 0 where the answer is certain enough to learn from, else None."""
    if c.right is None:
        return None
    if c.last:
        return 1
    if not c.right:
        return None
    shape = _shape(c.right)
    if c.kind != "thai" and shape.startswith(_NEVER_NEXT):
        return 0
    if not c.gap and c.kind in (".", "..") and not shape.startswith(("upper", "plain", "open")):
        return 0
    never, often = stats.bin(_left_key(c))[1:]
    if never:
        return 0
    not_first, first = stats.bin(_right_key(c.right))[1:]
    if not_first and c.kind in (".", "thai"):
        return 0
    return 1 if often and first else None


def count_tokens_at_edges(texts: Iterator[str]) -> tuple[np.ndarray, np.ndarray]:
    seen, edge = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    at: dict[str, int] = {}

    def bucket(key: str) -> int:
        i = at.get(key)
        if i is None:
            if len(at) > 500_000:
                at.clear()
            i = at[key] = _bucket(key)
        return i

    for text in texts:
        first, _ = _right_token(text, 0, len(text))
        if first:
            i = bucket(_right_key(first))
            seen[i] += 1
            edge[i] += 1
        for c in candidates(text):
            if c.kind != "line":
                i = bucket(_left_key(c))
                seen[i] += 1
                edge[i] += c.last
            if c.right:
                i = bucket(_right_key(c.right))
                seen[i] += 1
                edge[i] += c.last
    return seen, edge


def fit(rows: list[list[int]], labels: list[int], counts: list[int] | None = None, *, rounds: int = 150, penalty: float = 1e-5) -> np.ndarray:
    """Maximum-entropy weights of hashed binary features, by AdaGrad; ``counts`` says how often each row stands."""
    weights = np.zeros(BUCKETS)
    if not len(rows):
        return weights
    table = np.column_stack([np.asarray(labels, np.int64), np.array(rows, np.int64)])
    table, at = np.unique(table, axis=0, return_inverse=True)
    y, x, n = table[:, 0], table[:, 1:], np.bincount(at.ravel(), np.ones(len(at)) if counts is None else np.asarray(counts, float))
    # both answers weigh the same in all
    n *= np.where(y == 1, 0.5 / max(1e-9, n[y == 1].sum()), 0.5 / max(1e-9, n[y == 0].sum()))
    squares = np.full(BUCKETS, 1e-12)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(weights[x].sum(axis=1), -30, 30)))
        g = np.bincount(x.ravel(), np.repeat(n * (p - y), x.shape[1]), BUCKETS) + penalty * weights / BUCKETS
        squares += g * g
        weights -= 0.5 * g / np.sqrt(squares)
    return weights


class Splitter:
    """Classifies candidates; scores of repeated feature sets are remembered."""

    def __init__(self, stats: Statistics, weights: np.ndarray):
        self.stats, self.weights = stats, weights
        self.known: dict[tuple, bool] = {}

    def accepts(self, c: Candidate) -> bool:
        if c.last:
            return True
        key = (c.kind, c.left, c.right, c.gap, c.first)
        got = self.known.get(key)
        if got is None:
            if len(self.known) > 500_000:
                self.known.clear()
            got = self.known[key] = float(sum(self.weights[_bucket(f)] for f in features(c, self.stats))) > 0
        return got

    def ends(self, text: str) -> list[int]:
        out: list[int] = []
        for c in candidates(text):
            if self.accepts(c) and (not out or c.end > out[-1]):
                out.append(c.end)
        return out


def train(df: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seen, edge, weights): statistics over all of ``df`` and the model fitted on a sample of it."""
    texts = spread(df.where(F.col(text).isNotNull()).select(F.col(text).alias("t")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0

        def whole() -> Iterator[str]:
            nonlocal n
            for batch in batches:
                n += batch.num_rows
                yield from batch.column(0).to_pylist()

        seen, edge = count_tokens_at_edges(whole())
        at = np.flatnonzero(seen)
        # the last line, of bucket -1, counts the texts
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int64()), pa.array([*seen[at], n], pa.int64()), pa.array([*edge[at], 0], pa.int64())], names=["i", "seen", "edge"])

    table = texts.mapInArrow(count, "i long, seen long, edge long").groupBy("i").agg(F.sum("seen").alias("seen"), F.sum("edge").alias("edge")).toPandas()  # at most BUCKETS + 1 rows
    n = int(table.loc[table["i"] < 0, "seen"].sum())
    table = table[table["i"] >= 0]
    seen, edge = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
    seen[table["i"]], edge[table["i"]] = table["seen"], table["edge"]
    both = df.sparkSession.sparkContext.broadcast((seen, edge))

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats = Statistics(*both.value)
        for batch in batches:
            rows, labels = [], []
            for t in batch.column(0).to_pylist():
                for c in candidates(t):
                    if c.kind != "line" and (y := reliable(c, stats)) is not None:
                        rows.append([_bucket(f) for f in features(c, stats)])
                        labels.append(y)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), pa.array(labels, pa.int32())], names=["x", "y"])

    share = min(1.0, TRAINING_TEXTS / max(1, n))
    sample = df.where(F.col(text).isNotNull() & (F.shiftrightunsigned(F.xxhash64(text), 33) < int(share * 2**31))).select(F.col(text).alias("t"))
    drawn = spread(sample).mapInArrow(examples, "x array<int>, y int").groupBy("x", "y").count()
    got = drawn.orderBy(F.xxhash64("x", "y"), "x", "y").limit(TRAINING_EXAMPLES).toPandas()
    weights = fit(got["x"].tolist(), got["y"].tolist(), got["count"].clip(upper=MOST_WEIGHT).tolist())
    return seen, edge, weights.astype(np.float32)


def split_sentences(df: DataFrame, key: str = "row_id", text: str = "speech") -> DataFrame:
    """``(key, sent_end INT)``: one row per sentence of every text that is neither null nor blank."""
    model = df.sparkSession.sparkContext.broadcast(train(df, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, edge, weights = model.value
        splitter = Splitter(Statistics(seen, edge), weights)
        for batch in batches:
            ends = [splitter.ends(t) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(x) for x in ends], np.int64)
            at = np.repeat(np.arange(len(ends)), sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([y for x in ends for y in x], pa.int32())], names=["key", "sent_end"])

    texts = spread(df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("t")))
    return texts.mapInArrow(run, f"key {texts.schema['key'].dataType.simpleString()}, sent_end int")
