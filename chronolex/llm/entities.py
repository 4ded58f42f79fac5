"""Variant spellings of the names of persons, organisations and parties (problem 2).

Method: merge-and-rematch resolution.  Every entry becomes a profile: sets of surnames,
given names and initials, titles, places and parties.  Profiles meet in blocks and are
matched there; matched profiles are merged by uniting their sets, and the richer
profiles enter blocking and matching again, until a round merges nothing.

Round one merges only what fixes a person by itself (name and place agree).  Later
rounds also attach entries that name no place: each goes to its best match, and to none
where two matches that exclude each other are equally good, so that an entry never
joins two persons.

After the first wide round only pairs with a profile that was merged since are matched
again; what is known of other pairs stays.  Every merging round leaves fewer profiles,
so the work ends by itself.

Entries with equal profiles are one profile from the start, so copies cost nothing.
A block of more than ``BLOCK_ROWS`` profiles (a common surname) is split by a second
key: members with a place meet only where their places may be one, and those without a
place meet all others.  What is still larger is compared in pairs of chunks, each chunk
pair by itself: no task holds an unbounded block and no comparison is left out.

What is customary in names (short forms, titles, kinds of bodies) is a parameter,
``Customs``; its defaults are English.

Defined results: entries of different kinds are never linked; an entry without any name
is linked to nothing; pairs of one entity are all listed, the smaller key first.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.runtime import spread, written

#: Profiles of a block that are compared in one piece.
BLOCK_ROWS = 400

# Customary short forms of given names.
SHORT_FORMS = {
    "agnes": "nessie aggie", "alexander": "alec alex sandy alick", "andre": "andrew andy", "anthony": "tony", "archibald": "archie", "barbara": "babs barbie",
    "benjamin": "ben benny", "catherine": "kate kitty katharine cathy kathleen", "charles": "charlie chas chuck", "christopher": "chris kit", "daniel": "dan danny",
    "dorothy": "dolly dot dora", "edward": "ned ted eddie", "eleanor": "nell nelly nora ellen", "elizabeth": "liz betty bess eliza lizzie", "frances": "fran fanny frankie",
    "francis": "frank", "frederick": "fred freddie", "george": "georgie", "harriet": "hattie", "helene": "helen nell", "henry": "harry hy hal hank", "hugh": "hughie",
    "james": "jim jas jimmy jamie", "john": "jack jno johnny", "judith": "judy", "lawrence": "larry laurence laurie", "margaret": "peggy maggie meg madge", "mary": "molly polly",
    "nathaniel": "nat", "patrick": "pat paddy", "rebecca": "becky", "richard": "dick rick", "robert": "bob rob bobby", "samuel": "sam", "sarah": "sally", "susannah": "sue susan susie",
    "theodore": "theo ted", "thomas": "tom tommy", "victoria": "vicky", "walter": "walt wat", "william": "bill will wm willie",
}
# Titles, letters after a name, and words for kinds of organisation.
TITLES = {"mr", "mrs", "miss", "ms", "dr", "sir", "lord", "lady", "dame", "col", "capt", "prof", "rev", "hon", "gen", "maj", "lt", "mme", "mgr", "master"}
AFTER_NAME = {"qc", "kc", "mp", "esq", "jun", "jr", "sen", "sr", "bart", "obe", "mbe", "cbe"}
BODY_KINDS = ("association", "guild", "federation", "institute", "council", "company", "union", "society", "league", "board", "chamber", "club", "committee", "college", "trust")
BODY_SHORT = {"gld": "guild", "ccl": "council", "co": "company", "soc": "society", "un": "union", "inst": "institute", "fed": "federation", "assoc": "association"}


class Customs:
    """What is customary in names: tables that a caller may give for another country."""

    def __init__(self, short_forms=SHORT_FORMS, titles=TITLES, after_name=AFTER_NAME, body_kinds=BODY_KINDS, body_short=BODY_SHORT):
        self.short_forms, self.titles, self.after_name, self.body_kinds, self.body_short = short_forms, titles, after_name, body_kinds, body_short
        self.full = {s: full for full, short in short_forms.items() for s in short.split()} | {f: f for f in short_forms}
        #: A short form may stand for several names.
        self.many: dict[str, set[str]] = {}
        for full, short in short_forms.items():
            for x in short.split():
                self.many.setdefault(x, set()).add(full)


@lru_cache(200_000)
def plain(s: str) -> str:
    """Lower case without accents and apostrophes; runs of blanks as one."""
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()
    return re.sub(r"\s+", " ", s.replace("’", "").replace("'", "").replace("‘", "").replace("&", " and ")).strip()


@lru_cache(400_000)
def sound(word: str) -> str:
    """A spelling under which respellings of a word fall together."""
    s = re.sub(r"[^a-z]", "", word)
    for a, b in (("our", "or"), ("ph", "f"), ("ck", "k"), ("aw", "au"), ("ea", "ee"), ("oo", "u"), ("w", "v"), ("y", "i")):
        s = s.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", s)


@lru_cache(500_000)
def distance(a: str, b: str) -> int:
    """Edits between two words (insert, drop, change, swap neighbours), 9 when certainly above 2."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 2:
        return 9
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > 2:
            return 9
        before, last = last, row
    return last[-1]


def near(a: str, b: str) -> bool:
    """Equal but for a slip of the pen: one, or two in a long word."""
    n = min(len(a), len(b))
    return a == b or (n >= 4 and distance(a, b) <= (2 if n >= 9 else 1))


def near_place(a: str, b: str) -> bool:
    """As ``near`` with one slip: names of places often differ by two letters, as -mouth and -worth."""
    return a == b or (min(len(a), len(b)) >= 6 and distance(a, b) <= 1)


def shortened(short: str, full: str) -> bool:
    """``short`` (written with a full stop) abbreviates ``full``."""
    if not short or short[0] != full[:1] or len(short) >= len(full):
        return False
    rest = iter(full)
    return all(c in rest for c in short)


# ---------------------------------------------------------------- profiles


def _tokens(s: str) -> list[str]:
    return [t for t in (x.strip(",;:") for x in s.split()) if t.strip(".-")]


def _clean(t: str) -> str:
    return re.sub(r"[^a-z-]", "", plain(t)).strip("-")


@lru_cache(100_000)
def given_name(c: Customs, token: str) -> str:
    """The full form of a given name where it is known, an initial as one letter."""
    dotted, w = token.endswith("."), _clean(token)
    if len(w) <= 1:
        return w
    if w in c.full and len(c.many.get(w, ())) < 2:
        return c.full[w]
    if dotted and len(hits := [f for f in c.short_forms if shortened(w, f)]) == 1:
        return hits[0]
    if len(hits := [f for f in c.short_forms if sound(f) == sound(w)]) == 1:
        return hits[0]
    if len(w) >= 4 and len(hits := [f for f in c.short_forms if f[0] == w[0] and near(w, f)]) == 1:
        return hits[0]
    return w + "." if dotted else w


def _person(c: Customs, tokens: list[str], out: dict) -> None:
    """Given names, title and surname of tokens in any of the customary orders."""
    while tokens and _clean(tokens[0]) in {*c.titles, "the"} and len(tokens) > 1:
        if (t := _clean(tokens.pop(0))) != "the":
            out["title"].add(t)
    while len(tokens) > 2 and re.sub(r"\W", "", plain(tokens[-1])) in c.after_name:
        tokens.pop()
    if len(tokens) == 2 and re.sub(r"\W", "", plain(tokens[-1])) in c.after_name and not tokens[-1].isupper():
        tokens.pop()
    tokens = [t.lstrip(".") for t in tokens]
    if len(tokens) == 1 and not re.match(r"(?:Mac|Mc|O[’'])[A-Z]\w*$", tokens[0]):  # a blank was left out
        tokens = re.sub(r"(?<=[^\W\d_A-Z])(?=[A-Z])|(?<=\.)(?=\w)|(?<=[A-Z]{3})(?=[A-Z][^\W\d_A-Z])", " ", tokens[0], count=1).split()
    if not tokens:
        return
    if len(tokens) == 2 and tokens[1].isalpha() and tokens[1].isupper() and len(tokens[1]) <= 3 and len(tokens[0]) > 3:
        surname, given = tokens[0], list(tokens[1])  # Surname AB
    elif len(tokens) > 1 and len(tokens[0]) > 3 and tokens[0].isupper() and not all(t.isupper() for t in tokens):
        surname, given = tokens[0], tokens[1:]  # SURNAME Given
    else:
        surname, given = tokens[-1], tokens[:-1]
    if _clean(surname):
        out["surname"].add(_clean(surname).replace("-", ""))
    names = [given_name(c, t) for t in given if _clean(t)]
    if names:
        out["given"].add(" ".join(names))


def parse_member(c: Customs, display: str | None, speaker: str | None, party: str | None) -> dict:
    out: dict = {k: set() for k in ("surname", "given", "title", "place", "party", "whole")}
    if display and display.strip():
        s = display.strip()
        if m := re.search(r"\(([^)]*)\)", s):
            out["place"].add(_clean(m.group(1)))
            s = s[: m.start()] + s[m.end() :]
        s = s.rstrip(" .,;") if not re.search(r"\b[^\W\d_]\.$|[A-Za-z]{2,4}\.$", s.rstrip(" ,;")) or s.endswith((",", ";")) else s
        a, comma, b = s.partition(",")
        if comma and b.strip() and re.sub(r"\W", "", plain(b)) not in c.after_name and _clean(b) not in c.titles:
            s = f"{b.strip()} {a.strip()}"
            t = _tokens(s)
            _person(c, [*(x if not x.isupper() or len(x) < 3 else x.title() for x in t)], out)
        else:
            s = a if comma else s
            if comma and _clean(b) in c.titles:
                out["title"].add(_clean(b))
            _person(c, _tokens(s), out)
        out["whole"].add(re.sub(r"[^a-z]", "", plain(s)))
    if speaker and speaker.strip():
        s = speaker.strip()
        if m := re.search(r"[Mm]ember for (.+)$", s):
            out["place"].add(_clean(m.group(1)))
        else:
            if m := re.search(r"\(([^)]*)\)", s):
                out["place"].add(_clean(m.group(1)))
                s = s[: m.start()].strip()
            a, comma, b = s.partition(",")
            if comma and b.strip():
                if _clean(b) in c.titles:
                    out["title"].add(_clean(b))
                else:
                    out["place"].add(_clean(b))
                s = a
            t = _tokens(s)
            own = [x for x in t if _clean(x) in c.titles]
            if len(t) - len(own) >= 1:
                out["title"].update(_clean(x) for x in own)
                _person(c, [x for x in t if x not in own], out)
    if party and party.strip():
        out["party"].add(plain(party))
    out["place"].discard("")
    return out


def parse_body(c: Customs, display: str | None) -> dict:
    out: dict = {k: set() for k in ("kind", "trade", "place", "short_place")}
    s = re.sub(r"[(),]", " ", display or "")
    tokens = [t for t in s.split() if (w := _clean(t)) and w not in ("the", "of", "o", "f", "fo")]
    best = None
    for i, t in enumerate(tokens):
        w = _clean(t)
        for k in c.body_kinds:
            d = 0 if w == k or c.body_short.get(w) == k or (t.endswith(".") and len(w) > 1 and w != "co" and shortened(w, k)) else distance(w, k) if len(w) > 4 else 9
            if d <= 2 and (best is None or d < best[0]):
                best = (d, i, k)
    if best and len(tokens) >= 3:
        _, i, k = best
        out["kind"].add(k)
        place, trade = (tokens[2], tokens[1]) if i == 0 else (tokens[0], tokens[-2]) if i == len(tokens) - 1 else (tokens[0], tokens[i + 1])
        out["trade"].add(_clean(trade).replace("-", ""))
        (out["short_place"] if place.endswith(".") else out["place"]).add(_clean(place).replace("-", ""))
    elif tokens:
        out["kind"].add("?")
        out["place"].add("".join(_clean(t) for t in tokens))
    return out


@lru_cache(100_000)
def party_words(name: str) -> tuple[str, ...]:
    """The words of a party's name in order; a word that ends with a full stop is abbreviated."""
    s = plain(name)
    a, comma, b = s.partition(",")
    s = f"{b.strip()} {a}" if comma else s
    if re.fullmatch(r"(?:[a-z]\.){2,}", s):
        return ("=" + s.replace(".", ""),)
    words = [w for t in s.split() if (w := re.sub(r"[^a-z.-]", "", t).strip("-")) and w != "."]
    return tuple(words[1:] if words[:1] == ["the"] else words)


@lru_cache(200_000)
def same_party(x: str, y: str) -> bool:
    a, b = party_words(x), party_words(y)
    if not a or not b:
        return False
    if a == b:
        return True
    for p, q in ((a, b), (b, a)):
        if p[0].startswith("="):
            return not q[0].startswith("=") and p[0][1:] == "".join(w[0] for w in q)
    fa, fb = "".join(a).replace(".", ""), "".join(b).replace(".", "")
    if near(fa, fb):
        return True

    def alike(p: str, q: str) -> bool:
        u, v = p.rstrip(".-"), q.rstrip(".-")
        return u == v or sound(u) == sound(v) or near(u, v) or (p.endswith(".") and shortened(u, v)) or (q.endswith(".") and shortened(v, u))

    n = min(len(a), len(b))
    if len(a) != len(b):  # the last words may be left off
        return n >= 2 and abs(len(a) - len(b)) <= 2 and all(alike(p, q) for p, q in zip(a[:n], b[:n]))
    return all(alike(p, q) for p, q in zip(a, b)) or (n == 2 and all(alike(p, q) for p, q in zip(a, b[::-1])))


def parse(c: Customs, kind: str, display: str | None, speaker: str | None, party: str | None) -> dict:
    if kind == "party":
        return {"name": {plain(party)} if party and party.strip() else set()}
    if kind == "body":
        return parse_body(c, display)
    return parse_member(c, display, speaker, party)


def dump(p: dict) -> str:
    return json.dumps({k: sorted(v) for k, v in sorted(p.items()) if v}, ensure_ascii=False)


# ---------------------------------------------------------------- blocking


def _slips(word: str) -> set[str]:
    """The word and the word without each of its letters: two words one slip apart share one of these."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def block_keys(kind: str, p: dict, wide: bool) -> set[str]:
    """The blocks of a profile; ``wide`` adds those for spellings that no other entry has."""
    out: set[str] = set()
    if kind == "party":
        for n in p.get("name", ()):
            words = party_words(n)
            if words and words[0].startswith("="):
                out.add("y" + words[0])
            elif words:
                out.add("y=" + "".join(w[0] for w in words))
                out |= {"y" + w[:3] for w in words if w != "and"}
    elif kind == "body":
        for k in p.get("kind", ()):
            for t in p.get("trade", {""}) or {""}:
                for w in {*p.get("place", ()), *p.get("short_place", ())}:
                    out.add(f"b{k}|{sound(t)[:5]}|{w[:4]}")
                    out.add(f"b{k}|{sound(t)}|{w[:4]}")
                for w in p.get("place", ()):
                    out.add(f"c{k}|{sound(t)}|{sound(w)[-5:]}")
            for w in p.get("place", ()):
                out.add(f"d{k}|{sound(w)}")
    else:
        initials = {g[0] for g in p.get("given", ()) if g} or {"?"}
        for s in p.get("surname", ()):
            f = sound(s)
            for i in initials:
                out.add(f"s{f}|{i}")
                if wide and len(f) > 3:
                    out |= {f"d{v}|{i}" for v in _slips(f)}
        for w in p.get("place", ()):
            out |= {f"p{w}|{i}" for i in initials}
            out |= {f"q{w}|{sound(s)[:4]}" for s in p.get("surname", ())}
    return {f"{kind}:{k}" for k in out}


# ---------------------------------------------------------------- matching


def _surnames(a: list, b: list) -> int:
    if any(sound(x) == sound(y) for x in a for y in b):
        return 3
    return 2 if any(near(x, y) or near(sound(x), sound(y)) for x in a for y in b) else 0


def _names_alike(c: Customs, x: str, y: str) -> int:
    """2 for one given name, 1 where one is an initial or abbreviation of the other, 0 else."""
    u, v = x.rstrip("."), y.rstrip(".")
    if u == v:
        return 2 if len(u) > 1 else 1
    if len(u) == 1 or len(v) == 1:
        return 1 if u[0] == v[0] else 0
    if (x.endswith(".") and shortened(u, v)) or (y.endswith(".") and shortened(v, u)):
        return 1
    if v in c.many.get(u, ()) or u in c.many.get(v, ()) or c.many.get(u, set()) & c.many.get(v, set()):
        return 2
    if u in c.short_forms and v in c.short_forms:
        return 0  # two known names are not a slip apart
    return 2 if near(u, v) or sound(u) == sound(v) else 0


def _given(c: Customs, a: list, b: list) -> int:
    """Agreement of given names: 3 first and middle, 2 first, 1 by an initial, 0 unknown, -1 conflict."""
    if not a or not b:
        return 0
    best = -1
    for x in a:
        for y in b:
            p, q = x.split(" "), y.split(" ")
            first = _names_alike(c, p[0], q[0])
            if not first:
                continue
            if len(p) > 1 and len(q) > 1:
                middle = _names_alike(c, p[1], q[1])
                best = max(best, -1 if not middle else 3 if first == 2 else 1.5)
            else:
                best = max(best, first)
    return best


def match_members(c: Customs, a: dict, b: dict) -> tuple[str, float] | None:
    """('sure', score) or ('attach', score) when two profiles may be one person."""
    get = lambda p, k: p.get(k, ())
    titles = bool(set(get(a, "title")) & set(get(b, "title")))
    if get(a, "title") and get(b, "title") and not titles:
        return None
    placed = bool(get(a, "place")) and bool(get(b, "place"))
    if placed and not any(near_place(x, y) for x in get(a, "place") for y in get(b, "place")):
        return None
    surname = _surnames(get(a, "surname"), get(b, "surname"))
    given = _given(c, get(a, "given"), get(b, "given"))
    if given < 0 or not surname:
        if not any(distance(x, y) <= 2 for x in get(a, "whole") for y in get(b, "whole") if min(len(x), len(y)) >= 9):
            return None
        surname, given = max(surname, 2), max(given, 1)
    party = any(same_party(x, y) for x in get(a, "party") for y in get(b, "party"))
    if placed:
        return ("sure", 10.0) if given >= 1 or (surname == 3 and titles) else None
    score = 2.0 * (surname == 3) + given + 2.0 * party + 1.0 * titles
    if given >= 2 and (surname == 3 or party or titles):
        return ("attach", score)
    if given >= 1 and party and (surname == 3 or titles):
        return ("attach", score)
    return ("attach", score) if given >= 1 and surname == 3 and titles else None


def match_bodies(_: Customs, a: dict, b: dict) -> tuple[str, float] | None:
    if not set(a.get("kind", ())) & set(b.get("kind", ())):
        return None
    trade = any(near(x, y) or sound(x) == sound(y) for x in a.get("trade", ()) for y in b.get("trade", ()))
    if not trade and (a.get("trade") or b.get("trade")):
        return None
    if any(near_place(x, y) or sound(x) == sound(y) for x in a.get("place", ()) for y in b.get("place", ())):
        return ("sure", 10.0)
    if a.get("place") and b.get("place"):
        return None
    short = any(x == y or y.startswith(x) for p, q in ((a, b), (b, a)) for x in p.get("short_place", ()) for y in (*q.get("place", ()), *q.get("short_place", ())))
    return ("attach", 5.0) if short else None


def match_parties(_: Customs, a: dict, b: dict) -> tuple[str, float] | None:
    return ("sure", 10.0) if any(same_party(x, y) for x in a.get("name", ()) for y in b.get("name", ())) else None


MATCH = {"party": match_parties, "body": match_bodies}


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """Rows of equal block from batches that are sorted by block."""
    held: list[tuple] = []
    for pdf in batches:
        for row in pdf.itertuples(index=False, name=None):
            if held and held[-1][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _matcher(c: Customs):
    """Matches within blocks: rows (part, kind, side, across, id, fresh, profile), sorted by part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        loaded: dict[int, dict] = {}
        for rows in _runs(batches):
            if len(rows) < 2:
                continue
            match = MATCH.get(rows[0][1], match_members)
            if len(loaded) > 50_000:
                loaded.clear()
            profiles = [loaded[r[4]] if r[4] in loaded else loaded.setdefault(r[4], json.loads(r[6])) for r in rows]
            for i in range(len(rows)):
                _, kind, side, across, me, fresh, _ = rows[i]
                for j in range(i):
                    if rows[j][4] == me or rows[j][1] != kind or not (fresh or rows[j][5]) or (across and side == rows[j][2]):
                        continue  # equal sides meet in a part of their own
                    got = match(c, profiles[i], profiles[j])
                    if got:
                        out += _links(got, me, rows[j][4], profiles[i], profiles[j])
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=["a", "b", "sure", "score", "place"])
                out = []
        yield pd.DataFrame(out, columns=["a", "b", "sure", "score", "place"]).astype({"a": "int64", "b": "int64", "sure": bool, "score": float, "place": str})

    return run


def _links(got: tuple[str, float], x: int, y: int, a: dict, b: dict) -> Iterator[tuple]:
    """(a, b, sure, score, place): the pair if sure, else who may be attached to whom."""
    kind, score = got
    if kind == "sure":
        yield (min(x, y), max(x, y), True, 0.0, "")
        return
    for p, q, pi, qi in ((a, b, x, y), (b, a, y, x)):
        if not p.get("place") and (q.get("place") or qi < pi):
            yield (pi, qi, False, score + (0.5 if q.get("place") else 0.0), (q.get("place") or [""])[0])


def _candidates(profiles: DataFrame, wide: bool, c: Customs) -> DataFrame:
    """Matches among ``profiles(id, kind, profile, fresh)`` over all blocks, of pairs with a fresh profile.

    Blocks are handled as (hash, id); only what shares a block with something fresh gets its profile.
    """

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, kind, p, fresh in pdf.itertuples(index=False, name=None):
                p = json.loads(p)
                second = sorted({x for w in p.get("place", ()) for x in _slips(w)}) if kind not in MATCH else []
                rows += [(k, i, fresh, second) for k in block_keys(kind, p, wide)]
            yield pd.DataFrame(rows, columns=["block", "id", "fresh", "second"])

    entries = profiles.select("id", "kind", "profile", "fresh").mapInPandas(keys, "block string, id long, fresh boolean, second array<string>")
    entries = written(entries.select(F.xxhash64("block").alias("block"), "id", "fresh", "second"))
    sizes = entries.groupBy("block").agg(F.count("*").alias("n"), F.max("fresh").alias("any")).where("n > 1 and any").select("block", "n")
    shared = entries.join(sizes, "block")
    parts = shared.where(F.col("n") <= BLOCK_ROWS).select(F.col("block").alias("part"), F.lit(0).alias("side"), F.lit(False).alias("across"), "id")
    if (sizes.agg(F.max("n")).first()[0] or 0) > BLOCK_ROWS:
        parts = parts.unionByName(_split_blocks(written(shared.where(F.col("n") > BLOCK_ROWS).select("block", "id", "second"))))
    rows = parts.join(profiles.select("id", "kind", "fresh", "profile"), "id").select("part", "kind", "side", "across", "id", "fresh", "profile")
    return rows.repartition("part").sortWithinPartitions("part", "id").mapInPandas(_matcher(c), "a long, b long, sure boolean, score double, place string")


def _split_blocks(hot: DataFrame) -> DataFrame:
    """``(part, side, across, id)``: the blocks of ``hot(block, id, second)`` in parts of bounded size.

    With a second key: by it, in pairs of chunks where that is still too much.  Without
    one: against the whole block, in pairs of a chunk of these and a chunk of all.
    """
    keyed = hot.select("block", "id", F.explode("second").alias("second")).select(F.xxhash64("block", "second").alias("block"), "id")
    count = lambda df: df.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    pairs = keyed.join(count(keyed), "block").select("block", "id", chunk.alias("side"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    within = pairs.select(F.xxhash64("block", F.least("side", "other"), F.greatest("side", "other")).alias("part"), "side", (F.col("side") != F.col("other")).alias("across"), "id")
    bare = hot.where("size(second) = 0").select("block", "id")
    many = count(bare).withColumnRenamed("chunks", "bare").join(count(hot), "block")
    a = bare.join(many, "block").select("block", "id", F.lit(0).alias("side"), F.pmod(F.xxhash64("id"), F.col("bare")).alias("x"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("y"))
    b = hot.join(many, "block").select("block", "id", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("bare") - 1)).alias("x"), chunk.alias("y"))
    between = a.select("block", "id", "side", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).unionByName(b.select("block", "id", "side", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")))
    return within.unionByName(between.select(F.xxhash64("block", "x", "y", F.lit("bare")).alias("part"), "side", F.lit(True).alias("across"), "id"))


def components(edges: DataFrame) -> DataFrame:
    """``(id, root)`` of every id in ``edges(a, b)``: the smallest id of its component.

    Each id takes the least root of its neighbours and then that root's own root, until
    nothing changes; two such steps are made between writes.  Hubs cost one partial
    aggregate a task.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a != b").distinct()
    roots = both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("root"))

    def step(roots: DataFrame) -> DataFrame:
        seen = both.join(roots, both.b == roots.id).groupBy("a").agg(F.min("root").alias("near"))
        near = roots.join(seen, roots.id == seen.a).select("id", "root", F.least("root", "near").alias("next"))
        return near.alias("s").join(roots.alias("r"), F.col("s.next") == F.col("r.id"), "left").select(F.col("s.id").alias("id"), F.least("s.next", F.coalesce("r.root", "s.next")).alias("root"), F.col("s.root").alias("was"))

    while True:
        done = written(step(step(roots).select("id", "root")))
        roots = done.select("id", "root")
        if done.where("root != was").isEmpty():
            return roots


def _merge(profiles: DataFrame, roots: DataFrame) -> DataFrame:
    """Profiles of one component united; ``roots(id, root)`` names those that move."""

    def unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        for rows in _runs(batches):
            out: dict[str, set] = {}
            for _, p, _ in rows:
                for k, v in json.loads(p).items():
                    out.setdefault(k, set()).update(v)
            done.append((rows[0][0], rows[0][2], dump(out)))
            if len(done) > 20_000:
                yield pd.DataFrame(done, columns=["id", "kind", "profile"])
                done = []
        yield pd.DataFrame(done, columns=["id", "kind", "profile"])

    moved = profiles.join(roots, "id").select("root", "profile", "kind").repartition("root").sortWithinPartitions("root").mapInPandas(unite, "id long, kind string, profile string")
    stay = profiles.join(roots, "id", "left_anti").select("id", "kind", "profile", F.lit(False).alias("fresh"))
    return written(stay.unionByName(moved.withColumn("fresh", F.lit(True))))


def resolve(df: DataFrame, key: str = "form_id", kind: str = "kind", display: str = "display_as", speaker: str = "speaker", party: str = "party", *, customs: Customs | None = None) -> DataFrame:
    """``(key, entity)``: the entity of every entry, named by its smallest key."""
    c = customs or Customs()

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, dump(parse(c, k, *(x if isinstance(x, str) else None for x in names)))) for i, k, *names in pdf.itertuples(index=False, name=None)]
            yield pd.DataFrame(rows, columns=["key", "kind", "profile"])

    entries = spread(df.where(F.col(key).isNotNull() & F.col(kind).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(kind).alias("kind"), F.col(display), F.col(speaker), F.col(party)))
    parsed = written(entries.mapInPandas(profile, "key long, kind string, profile string"))
    named = parsed.where("profile != '{}'")
    profiles = written(named.groupBy("kind", "profile").agg(F.min("key").alias("id")).select("id", "kind", "profile", F.lit(True).alias("fresh")))
    first = profiles.select("id", F.col("kind").alias("k"), F.col("profile").alias("p"))
    own = named.join(first, (named.kind == first.k) & (named.profile == first.p)).select("key", "id")
    owners = own.unionByName(parsed.where("profile = '{}'").select("key", F.col("key").alias("id")))

    def merge(edges: DataFrame) -> bool:
        nonlocal profiles, owners
        edges = written(edges)
        if edges.isEmpty():
            return False
        roots = components(edges)
        profiles = _merge(profiles, roots)
        owners = owners.join(roots, "id", "left").select("key", F.coalesce("root", "id").alias("id"))  # of written tables; computed once, at the end
        return True

    merge(_candidates(profiles, False, c).where("sure").select("a", "b").distinct())
    profiles = profiles.withColumn("fresh", F.lit(True))
    known: DataFrame | None = None  # who may be attached to whom
    while True:
        found = _candidates(profiles, True, c)
        if known is not None:
            same = profiles.where("not fresh").select("id")
            found = found.unionByName(known.join(same.withColumnRenamed("id", "a"), "a", "left_semi").join(same.withColumnRenamed("id", "b"), "b", "left_semi").select(*found.columns))
        known = written(found)
        sure = known.where("sure").select("a", "b").distinct()
        best = known.where("not sure").groupBy("a").agg(F.max("score").alias("top"))
        at_top = known.where("not sure").join(best, "a").where("score >= top - 0.25").groupBy("a").agg(F.min("b").alias("b"), F.countDistinct("place").alias("places"))
        if not merge(sure.unionByName(at_top.where("places = 1").select("a", "b"))):
            break
    owners = written(owners)
    smallest = owners.groupBy("id").agg(F.min("key").alias("entity"))
    return owners.join(smallest, "id").select("key", "entity")


def linked_pairs(entities: DataFrame) -> DataFrame:
    """``(a, b)``, a < b: all pairs of entries of one entity."""
    x, y = entities.alias("x"), entities.alias("y")
    return x.join(y, (F.col("x.entity") == F.col("y.entity")) & (F.col("x.key") < F.col("y.key"))).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
