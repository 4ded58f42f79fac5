"""Repair of text that was read from scanned pages (problem 6).

Method: a text is de-lined and decoded.  Lines of page furniture (running heads and
feet, folios, sheet marks) are told from lines of text by a score of their layout and
of how often their wording recurs over the collection.  What is left is one stream of
characters, in which blanks and line ends are soft.  Words of the lexicon that stand
whole are anchors; a dynamic programme decodes each stretch between them, with the
anchors that adjoin it.  Its steps read up to three parts as one, at the price of each
blank or line end that is dropped and each hyphen that is dropped or kept, and cover
what they read with words, at the price of each word (its rarity), of each blank that
is put in and of each misreading that is undone.  A part may also stay as it is, at a
price that grows with its length.  The cheapest way through the stretch wins, so splits,
merges, hyphens and misreadings are decided together.  Paragraph boundaries are chosen
by a second dynamic programme over the lines of text.

Prices are natural logarithms.  That of a misreading is learnt from aligned misreadings:
unknown words of the scans that one step turns into a word of the lexicon are counted by
that step over the whole collection.  A merge without a hyphen undoes one misreading at
most; nothing else is bounded but by price, so a stretch may have any length.

The lexicon is the words of the reliable texts of the collection whose share of all
words is at least ``LEAST_SHARE``; there are never more than 1 / LEAST_SHARE of those,
which bounds what is broadcast.  It is counted over all reliable texts.  All prices
depend on shares, none on counts.  A head is a line of ``HEAD_CHARS`` characters whose
wording stands in ``LEAST_LINES`` of all lines, and in four at least.

Defined results: null and empty texts give no finding and stay as they are; a record
lists each finding once; a word that no reading explains is left alone; single
characters, numbers and Roman numerals are never read as words of their own.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.runtime import spread, written

#: Words of a smaller share are not in the lexicon: it has at most a million words.
LEAST_SHARE = 1e-6
#: Line wordings of a smaller share are not held to recur: there are at most 100,000.
LEAST_LINES = 1e-5

#: Characters of a line that may be a running head.
HEAD_CHARS = range(8, 60)

# What is read, and what may be printed there.
CONFUSIONS = {
    "0": "o", "1": "l i", "!": "i l", "5": "s", "6": "b", "9": "g", "8": "b", "|": "l i", "ſ": "s",
    "f": "s t", "c": "e", "e": "c", "u": "n", "n": "u ri", "l": "i", "i": "l", "t": "f", "h": "b li", "b": "h", "m": "rn", "w": "vv", "d": "cl",
    "cl": "d", "rn": "m", "li": "h", "vv": "w", "ii": "n", "ri": "n", "tl": "d", "ni": "m", "in": "m", "iu": "m", "ft": "ct",
}
STEPS = [(read, right) for read, rights in CONFUSIONS.items() for right in rights.split()]
#: Prices: a misreading before any is learnt, the cheapest and the dearest that is learnt, and what each further one in a word adds.
MISREADING, CHEAPEST, DEAREST, FURTHER = 4.0, 3.5, 6.5, 2.5
#: Prices: a blank or a line end within a word, a hyphen there that is dropped or kept, a word that ends at such a hyphen.
DROP = {" ": 6.0, "\n": 6.0, "-": 0.3}
KEEP_HYPHEN, COMPOUND, END_AT_HYPHEN = 0.6, 2.0, 8.0
#: Prices: a blank that is put in, and a part of one or two letters beside it.
MISSING_BLANK, SHORT_PART = 7.0, 6.0


def leave_price(letters: int, capital: bool) -> float:
    """The price of a part that is no word; a capital makes a name likely."""
    return 12.5 + 0.4 * letters if capital else 9.0 + 2.2 * letters


HYPHENS = "-¬\xad‐"
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
#: A word as it may have been read: letters, with digits and marks that stand for letters.
_READ = re.compile(r"[^\W_][^\W_!|]*(?:[-'’!|][^\W_]+)*|(?<![\w.?!])!(?=[a-z])[^\W_]+")
_HYPHEN_END = re.compile(rf"[{HYPHENS}] *\n")
_CODES = "OlIi~'’"
_NUM = rf"[0-9{_CODES}]{{1,5}}"
# Shapes of a folio or sheet mark that fills a line by itself.
_FOLIO = re.compile(rf"^(?:[\[({{il~O'’]?\s*{_NUM}\s*[\])}}il~O'’]?|[—–\-~'’Oil]\s?{_NUM}\s?[—–\-~'’Oil]|{_NUM} ?[*Oil~'’]|(?:[Pp]|[Cc]ol|[Ff]ol|[^\W\d_~'’]{{0,2}}[~'’Oil][^\W\d_]{{0,1}})[.Oil~'’]? {_NUM}|[^\W\d_~'’][ Oil~'’]?[0-9Oil~'’])$")
_FOLIO_DOT = re.compile(rf"^{_NUM}\.$")
_SMALL = re.compile(r"(?:^|\s)[a-z]\S")
_ROMAN = re.compile(r"^[ivxlcdm]+$")
_TERMINAL = re.compile(r"[.!?…。！？।][\"”’»)\]]*$")


# ---------------------------------------------------------------- words


class Arc:
    """A way to read one or more parts: its price, the words, and whether each was misread."""

    __slots__ = ("joined", "misread", "price", "words")

    def __init__(self, price: float, words: tuple[str, ...] | None = None, misread: tuple[str, ...] = (), joined: tuple[str, ...] = ()):
        self.price, self.words, self.misread, self.joined = price, words, misread, joined  # words None: as it is


class Lexicon:
    """Words with their prices, and the dynamic programme that covers characters by them."""

    def __init__(self, words: dict[str, int], total: int, prices: dict[tuple[str, str], float] | None = None):
        self.words, self.total = words, max(1, total)
        self.spelling = sorted(words)
        self.least = math.log(self.total / max(words.values())) if words else math.inf
        self.steps: dict[str, list[tuple[str, float]]] = {}
        for read, right in STEPS:
            self.steps.setdefault(read, []).append((right, (prices or {}).get((read, right), MISREADING)))
        self.memo: dict[tuple, Arc | None] = {}
        self.alone: dict[str, Arc] = {}
        self.known: dict[str, bool] = {}
        self.heads: dict[str, bool] = {}

    def price(self, word: str) -> float | None:
        n = self.words.get(word)
        return None if n is None else math.log(self.total / n)

    def _begins(self, head: str) -> bool:
        """Some word begins so."""
        got = self.heads.get(head)
        if got is None:
            if len(self.heads) > 300_000:
                self.heads.clear()
            i = bisect_left(self.spelling, head)
            got = self.heads[head] = i < len(self.spelling) and self.spelling[i].startswith(head)
        return got

    def _spelled(self, s: str, i: int, bound: float, most: int) -> dict[int, tuple[float, str, int]]:
        """By its end: the cheapest word below ``bound`` that may be printed at ``i``, and its misreadings."""
        found: dict[int, tuple[float, str, int]] = {}
        todo = [(i, "", 0.0, 0)]
        room = bound - self.least
        n = len(s)
        while todo:
            j, word, paid, k = todo.pop()
            if word in self.words:
                c = paid + math.log(self.total / self.words[word])
                if c < bound and (j not in found or (c, word) < found[j][:2]):
                    found[j] = (c, word, k)
            if j == n:
                continue
            if self._begins(v := word + s[j]):
                todo.append((j + 1, v, paid, k))
            if k < most:
                for size in (1, 2):
                    for right, c in self.steps.get(s[j : j + size], ()) if j + size <= n else ():
                        c += paid + FURTHER * k
                        if c < room and self._begins(v := word + right):
                            todo.append((j + size, v, c, k + 1))
        return found

    def cover(self, s: str, bound: float, most: int = 99) -> tuple[float, list[tuple[int, int, str, int]]] | None:
        """The cheapest cover of ``s`` by words below ``bound``: (price, [(begin, end, word, misreadings)]).

        Covers below a small bound are looked for first: if there is one, it is the cheapest.
        """
        for b in (14.0, 20.0, bound):
            if got := self._cover(s, min(b, bound), most):
                return got
            if b >= bound:
                return None
        return None

    def _cover(self, s: str, bound: float, most: int) -> tuple[float, list[tuple[int, int, str, int]]] | None:
        n = len(s)
        best: dict[int, tuple[float, int, str, int]] = {0: (0.0, 0, "", 0)}
        furthest = 0
        for i in range(n):
            if i > furthest:
                return None
            if i not in best or best[i][0] + self.least >= bound:
                continue
            before = best[i][0]
            for j, (c, word, k) in self._spelled(s, i, bound - before, most).items():
                c += before
                if (i or j < n) and j - i < 3:
                    c += SHORT_PART
                if j < n:
                    c += MISSING_BLANK
                if c + (self.least if j < n else 0.0) < bound and (j not in best or c < best[j][0]):
                    best[j] = (c, i, word, k)
                    furthest = max(furthest, j)
                    if j == n:
                        bound = c
        if n not in best:
            return None
        out = []
        j = n
        while j:
            _, i, word, k = best[j]
            out.append((i, j, word, k))
            j = i
        return best[n][0], out[::-1]

    def doubtful(self, read: str) -> bool:
        """A part that is neither a word of the lexicon nor something that is never read as one."""
        got = self.known.get(read)
        if got is None:
            if len(self.known) > 500_000:
                self.known.clear()
            got = self.known[read] = read.lower() not in self.words and not self._passed_over(read.lower())
        return got

    @staticmethod
    def _passed_over(low: str) -> bool:
        return len(low) < 2 or low.isdecimal() or bool(_ROMAN.match(low)) or not any(c.isalpha() or c == "!" for c in low)

    def single(self, read: str) -> Arc:
        """The cheapest reading of one part by itself."""
        got = self.alone.get(read)
        if got is None:
            if len(self.alone) > 300_000:
                self.alone.clear()
            got = self.alone[read] = self._single(read)
        return got

    def _single(self, read: str) -> Arc:
        low, capital = read.lower(), read[:1].isupper()
        if (c := self.price(low)) is not None:
            return Arc(c)
        leave = leave_price(len(low), capital)
        if self._passed_over(low):
            return Arc(leave)
        if got := self.cover(low, leave):
            return _arc(*got)
        parts = re.split(r"([-'’])", low)
        if len(parts) > 1:
            paid, words, misread = 0.0, [], False
            for p in parts:
                if len(p) < 3 or p in self.words:
                    words.append(p)
                elif (got := self.cover(p, leave_price(len(p), capital))) and len(got[1]) == 1:
                    words.append(got[1][0][2])
                    paid += got[0]
                    misread = True
                else:
                    words.append(p)
            if misread:
                return Arc(paid + COMPOUND, ("".join(words),), ("".join(words),))
        return Arc(leave)

    def merged(self, reads: list[str], marks: str, bound: float) -> Arc | None:
        """The cheapest reading of several parts as one stream; ``marks`` stand between them."""
        key = (*reads, marks, round(bound, 3))
        if key not in self.memo:
            if len(self.memo) > 300_000:
                self.memo.clear()
            self.memo[key] = self._merged(reads, marks, bound)
        return self.memo[key]

    def _merged(self, reads: list[str], marks: str, bound: float) -> Arc | None:
        low = [r.lower() for r in reads]
        capital = reads[0][:1].isupper()
        paid = sum(DROP[m] for m in marks)
        hyphen = "-" in marks
        at, n = [], 0
        for r, m in zip(low, marks):
            n += len(r)
            at.append((n, m))
        plain = "".join(low)
        kept = "".join(r + ("-" if m == "-" else "") for r, m in zip(low, marks + " ")) if hyphen else ""
        ways: list[Arc] = []
        for s, extra in ((plain, 0.0), (kept, KEEP_HYPHEN - DROP["-"])):
            if s and (c := self.price(s)) is not None:
                ways.append(Arc(paid + extra + c, (s,), (), (s,) if marks.strip(" ") else ()))
        if not ways and bound - paid > (0.0 if hyphen else 10.0):
            if got := self.cover(plain, min(bound - paid, leave_price(len(plain), capital)), 99 if hyphen else 1):
                arc = _arc(paid + got[0], got[1])
                arc.joined = tuple(w for i, j, w, _ in got[1] if any(i < x < j and m != " " for x, m in at))
                if all(any(i < x < j for i, j, _, _ in got[1]) for x, _ in at):
                    ways.append(arc)
            elif hyphen and (got := self.cover(kept, min(bound - paid, leave_price(len(plain), capital)))) and len(got[1]) == 1:
                w = got[1][0][2]
                ways.append(Arc(paid + got[0] + KEEP_HYPHEN, (w,), (w,), (w,)))
        if hyphen and not ways and len(reads) == 2:  # no word of the lexicon: a compound of two, or a name
            a, b = low
            pa_, pb = self.price(a), self.price(b)
            if pa_ is not None and pb is not None and len(a) > 2 and len(b) > 2 and not capital:
                ways.append(Arc(paid + COMPOUND + min(pa_ + pb, leave_price(len(plain), False)), (kept,), (), (kept,)))
            else:
                s = kept if capital and reads[1][:1].isupper() else plain
                ways.append(Arc(paid + leave_price(len(plain), capital), (s,), (), (s,)))
        return min(ways, key=lambda x: (x.price, x.words)) if ways else None

    def decode(self, reads: list[str], marks: str) -> list[tuple[int, int, Arc]]:
        """The cheapest way through a stretch of parts: (first, end, arc) of each step that changes something."""
        n = len(reads)
        best: list[tuple[float, int, Arc | None]] = [(0.0, 0, None)] + [(math.inf, 0, None)] * n
        own = [self.single(r) for r in reads]
        for i in range(n):
            paid = best[i][0]
            alone = 0.0
            for j in range(i + 1, min(n, i + 3) + 1):
                alone += own[j - 1].price + (END_AT_HYPHEN if j < n and marks[j - 1] == "-" else 0.0)
                if j == i + 1:
                    arc = own[i]
                elif "-" in marks[i : j - 1] or any(self.doubtful(r) for r in reads[i:j]):
                    arc = self.merged(reads[i:j], marks[i : j - 1], alone)
                else:
                    arc = None
                if arc is not None:
                    c = paid + arc.price + (END_AT_HYPHEN if j < n and marks[j - 1] == "-" else 0.0)
                    if c < best[j][0]:
                        best[j] = (c, i, arc)
        out = []
        j = n
        while j:
            _, i, arc = best[j]
            if arc.words is not None:
                out.append((i, j, arc))
            j = i
        return out[::-1]

    def repair(self, read: str) -> tuple[str, bool]:
        """One part by itself: the words meant, in lower case, and whether that undoes a misreading."""
        arc = self.single(read)
        return " ".join(arc.words or (read.lower(),)), bool(arc.misread)


def _arc(price: float, words: list[tuple[int, int, str, int]]) -> Arc:
    return Arc(price, tuple(w for _, _, w, _ in words), tuple(w for _, _, w, k in words if k))


def step_of(read: str, word: str) -> tuple[str, str] | None:
    """The one step by which ``word`` was read as ``read``."""
    n = min(len(read), len(word))
    head = next((i for i in range(n) if read[i] != word[i]), n)
    for i in range(max(0, head - 1), head + 1):
        for size in (1, 2):
            for right in CONFUSIONS.get(read[i : i + size], "").split():
                if read[:i] + right + read[i + size :] == word:
                    return read[i : i + size], right
    return None


def learnt_prices(counts: dict[tuple[str, str], int]) -> dict[tuple[str, str], float]:
    """The most frequent step is the cheapest; one seen e times less often costs 1 more."""
    most = max(counts.values(), default=0)
    return {step: min(DEAREST, CHEAPEST + math.log((most + 1) / (counts.get(step, 0) + 1))) for step in STEPS} if most else {}


# ---------------------------------------------------------------- lines


def line_key(line: str) -> str:
    """The wording of a line: small letters only, digits and spaces dropped."""
    return "".join(c for c in line.lower() if c.isalpha())


def _nearly(a: str, b: str) -> bool:
    """Equal but for two changed letters, or for a stretch of two letters at most."""
    if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) <= 2:
        return True
    n = min(len(a), len(b))
    head = next((i for i in range(n) if a[i] != b[i]), n)
    tail = next((i for i in range(n) if a[-1 - i] != b[-1 - i]), n)
    return head + tail >= max(len(a), len(b)) - 2


class Furniture:
    """Tells lines of page furniture from lines of text."""

    def __init__(self, recurring: list[str]):
        self.recurring = set(recurring)
        self.by_size: dict[int, list[str]] = {}
        for k in recurring:
            self.by_size.setdefault(len(k), []).append(k)
        self.memo: dict[str, bool] = {}

    def recurs(self, line: str) -> bool:
        """The wording, but for a misread character or two, recurs as a line over the collection."""
        key = line_key(line)
        if len(key) < 8:
            return False
        got = self.memo.get(key)
        if got is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            got = key in self.recurring
            for size in range(len(key) - 1, len(key) + 2) if not got else ():
                for k in self.by_size.get(size, ()):
                    if k[:3] == key[:3] or k[-3:] == key[-3:]:
                        got = got or _nearly(k, key)
            self.memo[key] = got
        return got

    def score(self, line: str, before: str, after: str, width: int) -> float:
        """Above 0 for furniture.  ``before`` and ``after`` are the nearest other lines."""
        s = line.strip()
        small = len(_SMALL.findall(s))
        indented = line[:1].isspace()
        if not indented and small > (2 if s[0].islower() else 4):
            return -9.0  # nothing below could outweigh so many small words
        words = s.split()
        ended = not before or bool(_TERMINAL.search(before.rstrip()))
        x = -3.0
        if _FOLIO.match(s):
            x += 3.5 if not indented and not any(c.isdigit() for c in s) else 5.5
        elif _FOLIO_DOT.match(s):
            b = before.rstrip()
            away = b[-1:] in HYPHENS or re.search(r"[a-z]{4}$", b) or (ended and not re.search(r"(?:\b[a-z]{1,3}|[Nn]os?)\.$", b))
            x += 5 if indented else 4 if away and after else 0
        if indented:
            x += 3.5
        room = width - len(line.rstrip())
        first = after.split()[0] if after.split() else ""
        loose = bool(first) and room > len(first) + 1  # the next word would have had room
        terminal = bool(_TERMINAL.search(s))
        if loose and not terminal and s[-1:] not in HYPHENS and not s[0].islower():
            x += 2.5
        if re.search(r"\S {3,}\S", s):
            x += 3
        if before.rstrip()[-1:] in HYPHENS and before.strip() and not s[0].islower():
            x += 3 if re.search(r"(?:^|[^\w-])[^\W\dA-Z_][^\W_]*.$", before.rstrip()) else 2
        if re.search(r"[{}]", s):
            x += 2.5
        elif re.search(r"\].*\[|^[^\[]*\] \S|\[[^\]]*$", s) and (indented or not s[0].islower()) and not re.search(r"[a-z]{3}[.?!] \[[A-Z][a-z]", s) and not re.match(r"^\[?[A-Z][^\[\]]*\]( |$)", s):
            x += 2
        if re.search(rf"(?:^|[\s\[]){_NUM}[\]\s]*$|^{_NUM}\s", s) and not terminal and any(c.isdigit() for c in s):
            x += 1.5
        caps = sum(w.isupper() and len(w) > 2 for w in words)
        if caps >= 2 and caps * 2 >= len(words):
            x += 2.5
        if s[0].islower() and not indented:
            x -= 2.5
        if re.search(r"\w—\w", s):
            x += 1.5
        if small == 0 and len(words) > 1:
            x += 0.5
        if small > 2:
            x -= 1.5 * (small - 2)
        if -3 < x <= 2.5 and s[0] not in "“\"‘" and (not terminal or "—" in s or indented) and self.recurs(s):
            x += 3
        return x


def _lines(text: str) -> list[str]:
    return re.split(r"\r\n|[\n\r\f]", text)


class Repaired:
    """What was found in a text, and the text made continuous."""

    __slots__ = ("found", "text")

    def __init__(self, text: str, found: list[tuple[str, str]]):
        self.text, self.found = text, found


class Repairer:
    def __init__(self, lexicon: Lexicon, furniture: Furniture):
        self.lexicon, self.furniture = lexicon, furniture

    def repair(self, text: str) -> Repaired:
        lines = _lines(text)
        shown = [i for i, x in enumerate(lines) if x.strip()]
        found: dict[tuple[str, str], None] = {}
        body = shown
        breaks: set[int] = set()
        if len(shown) > 1:
            width = self._width([lines[i] for i in shown])
            body = []
            for k, i in enumerate(shown):
                before = lines[body[-1]] if body else ""
                after = lines[shown[k + 1]] if k + 1 < len(shown) else ""
                if self.furniture.score(lines[i], before, after, width) > 0:
                    found["furniture", lines[i].strip()] = None
                else:
                    body.append(i)
            breaks = paragraph_breaks([lines[i] for i in body], [i > 0 and not lines[i - 1].strip() for i in body], width)
        stream = "\n".join(lines[i].strip() for i in body)
        edits = list(self._edits(stream, breaks, found))
        if not edits and len(shown) < 2:
            return Repaired(text, list(found))
        return Repaired(_flow(stream, edits, breaks).strip(), list(found))

    def _edits(self, stream: str, breaks: set[int], found: dict) -> Iterator[tuple[int, int, str]]:
        """(begin, end, words) of every place of the stream that is read otherwise."""
        doubtful, known = self.lexicon.doubtful, self.lexicon.known
        parts = list(_READ.finditer(stream))
        odd = [k for k, m in enumerate(parts) if known.get(m.group(), True) and doubtful(m.group())]
        if hyphens := [m.start() for m in _HYPHEN_END.finditer(stream)]:
            ends = [m.end() for m in parts]
            halves = {bisect_left(ends, at) for at in hyphens}
            odd = sorted({*odd, *(k for k in halves if k + 1 < len(parts) and ends[k] in hyphens)})

        @cache
        def mark(k: int) -> str:
            """What stands between a part and the next, if they may belong together."""
            if not 0 <= k < len(parts) - 1:
                return ""
            end = parts[k].end()
            gap = stream[end : parts[k + 1].start()]
            if gap.isspace():
                return " " if "\n" not in gap else "\n" if stream.count("\n", 0, end) + 1 not in breaks else ""
            return "-" if gap[:1] in HYPHENS and "\n" in gap and gap[1:].isspace() else ""

        done = 0
        for k in odd:
            if k < done:
                continue
            a = k - 1 if k > done and mark(k - 1) else k
            b = k
            while mark(b) and (b == k or mark(b) == "-" or mark(b - 1) == "-" or doubtful(parts[b].group()) or doubtful(parts[b + 1].group())):
                b += 1
            done = b + 1
            reads = [m.group() for m in parts[a : b + 1]]
            for i, j, arc in self.lexicon.decode(reads, "".join(mark(x) for x in range(a, b))):
                for w in arc.joined:
                    found["joined", w] = None
                for w in arc.misread:
                    found["misread", w] = None
                yield parts[a + i].start(), parts[a + j - 1].end(), _as_read(reads[i], arc.words)

    @staticmethod
    def _width(lines: list[str]) -> int:
        """The measure of the column: nearly the longest line of text."""
        sizes = sorted(len(x.rstrip()) for x in lines if len(_SMALL.findall(x)) > 2)
        return sizes[-1] if sizes else max(map(len, lines))


def _as_read(read: str, words: tuple[str, ...]) -> str:
    word = " ".join(words)
    if read[:1].isupper():
        return word.upper() if len(read) > 1 and read.isupper() else word[:1].upper() + word[1:]
    return word


def _flow(stream: str, edits: list[tuple[int, int, str]], breaks: set[int]) -> str:
    """The stream with its edits made, line ends as blanks and paragraphs apart."""
    out: list[str] = []
    line = at = 0
    for begin, end, new in [*edits, (len(stream), len(stream), "")]:
        for k, piece in enumerate(stream[at:begin].split("\n")):
            if k:
                line += 1
                out.append("\n\n" if line in breaks else " ")
            out.append(piece)
        out.append(new)
        line += stream.count("\n", begin, end)
        at = end
    return "".join(out)


def paragraph_breaks(lines: list[str], blank: list[bool], width: int) -> set[int]:
    """Line numbers before which a paragraph begins: the cheapest division of the lines.

    A break is cheap after a short line that ends a sentence and before a capital; a
    paragraph that goes on costs more after such a line; a paragraph of one line costs
    extra unless a blank line follows it.  The states are the first line of a paragraph
    and a later one, so the work is in proportion to the lines.
    """
    n = len(lines)
    first, later = 0.0, math.inf  # price so far, the last line being the first of its paragraph or not
    back: list[tuple[bool, bool]] = []  # for each line from the second: does a break come before it, from which state
    for k in range(1, n):
        loose = width - len(lines[k - 1].rstrip()) > len((lines[k].split() or [""])[0]) + 1
        ended = bool(_TERMINAL.search(lines[k - 1].rstrip()))
        begins = not lines[k].strip()[:1].islower()
        stay = 3.0 * (loose and ended) + 2.0 * (blank[k] and ended and begins) - 4.0 * (not ended) - 2.0 * (not begins)
        short = first + (0.0 if blank[k] else 0.5)
        back.append((short < later, first < later))
        first, later = min(short, later) + 2.0, min(first, later) + stay
    out: set[int] = set()
    is_first = first < later
    for k in range(n - 1, 0, -1):
        if is_first:
            out.add(k)
        is_first = back[k - 1][0 if is_first else 1]
    return out


# ---------------------------------------------------------------- Spark


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """``(word, n)``: occurrences of every word, in small letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for t in batch.column(0).to_pylist():
                n.update(_WORD.findall(t))
            yield pa.RecordBatch.from_arrays([pa.array([w.lower() for w in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    texts = spread(df.where(F.col(text).isNotNull()).select(text))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def scan_counts(df: DataFrame, text: str, lexicon: Broadcast) -> DataFrame:
    """``(kind, item, n)`` of scanned texts: wordings of lines that may be heads, steps of misreadings, all lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(*lexicon.value)
        step: dict[str, str | None] = {}
        for batch in batches:
            n: Counter = Counter()
            for t in batch.column(0).to_pylist():
                if "\n" in t:
                    lines = _lines(t)
                    n["all", ""] += len(lines)
                    for x in lines:
                        s = x.strip()
                        if len(s) in HEAD_CHARS and not s[0].islower() and sum(w[0].islower() for w in s.split()) < 5:
                            n["line", line_key(s)] += 1
                for read in _READ.findall(t):
                    if lex.doubtful(read):
                        if read not in step:
                            if len(step) > 300_000:
                                step.clear()
                            got = lex.single(read)
                            took = step_of(read.lower(), got.words[0]) if got.words and len(got.words) == 1 else None
                            step[read] = "\t".join(took) if took else None
                        if step[read]:
                            n["step", step[read]] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in n], pa.string()), pa.array([x for _, x in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["kind", "item", "n"])

    texts = spread(df.where(F.col(text).isNotNull()).select(text))
    return texts.mapInArrow(run, "kind string, item string, n long").groupBy("kind", "item").agg(F.sum("n").alias("n"))


def learn(reliable: DataFrame, scanned: DataFrame, text: str) -> tuple[tuple[dict, int, dict], list[str]]:
    """(words, their total, prices of steps), recurring wordings of lines; all bounded by their least shares.

    The counts of a pass are written once and read for their total and for what is kept.
    """
    sc = reliable.sparkSession.sparkContext
    counts = written(word_counts(reliable, text))
    total = counts.agg(F.sum("n")).first()[0] or 0
    words = {r.word: r.n for r in counts.where(F.col("n") >= LEAST_SHARE * total).toLocalIterator()}
    scans = written(scan_counts(scanned, text, sc.broadcast((words, total))))
    n_lines = scans.where("kind = 'all'").agg(F.sum("n")).first()[0] or 0
    kept = scans.where((F.col("kind") == "step") | ((F.col("kind") == "line") & (F.col("item") != "") & (F.col("n") >= max(4, LEAST_LINES * n_lines)))).collect()
    prices = learnt_prices({tuple(r.item.split("\t")): r.n for r in kept if r.kind == "step"})
    return (words, total, prices), sorted(r.item for r in kept if r.kind == "line")


def repair_scans(scanned: DataFrame, reliable: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, text, found ARRAY<STRUCT<kind, item>>)``: every text of ``scanned`` repaired, with what was found.

    ``key`` may be a struct; ``reliable`` holds texts in a column of the same name from
    which the lexicon is counted.
    """
    model = scanned.sparkSession.sparkContext.broadcast(learn(reliable, scanned, text))
    finding = pa.struct([pa.field("kind", pa.string()), pa.field("item", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, recurring = model.value
        r = Repairer(Lexicon(*lexicon), Furniture(recurring))
        for batch in batches:
            got = [r.repair(t) if t else None for t in batch.column(1).to_pylist()]
            texts = pa.array([g.text if g else t for g, t in zip(got, batch.column(1).to_pylist())], pa.string())
            found = pa.array([[{"kind": k, "item": x} for k, x in g.found] if g else [] for g in got], pa.list_(finding))
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, found], names=["key", "text", "found"])

    part = spread(scanned.select(F.col(key).alias("key"), F.col(text).alias("t")))
    return part.mapInArrow(run, f"key {part.schema['key'].dataType.simpleString()}, text string, found array<struct<kind:string,item:string>>")


def findings(repaired: DataFrame) -> DataFrame:
    """``(key, kind, item)``: one row for each finding of a record."""
    return repaired.select("key", F.explode("found").alias("f")).select("key", "f.kind", "f.item")
