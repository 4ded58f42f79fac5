import pytest

from chronolex.llm import entities as E

MEMBERS = [
    (1, "Barbara Gwaffwater", "Lady Gwaffwater (Lissenbridge)", "Northern Assembly Party"), (2, "Babs Gwaffwater", "Lady B. Gwaffwater", "NORTHERN ASSEMBLY PARTY"),
    (3, "GWAFFWATER Barbara", "Lady Gwaffwater (Lissenbridge)", "N.A.P."), (4, "Gwaffwater, Barbara", "The hon. Member for Lissenbridge", None), (5, "  Barbara  Gvaffwater", "Lady GWAFFWATER (Lissenbridge)", None),
    (6, "Barbara Gwaffwater", "Mrs. Gwaffwater (Tarnport)", "Old Whiggery"), (7, "John Gwaffwater", "Mr. Gwaffwater (Lissenbridge)", "Old Whiggery"), (8, "Jack Gwafwater", None, "Old Whiggery"), (9, None, None, None), (10, " ", "", ""),
]
BODIES = [(20, "Company of Tanners of Gweasklinness"), (21, "Gwea. Tanners Company"), (22, "Co. of Tanners (Gweasklinness)"), (23, "Gweasklinness Tanners' Co."), (24, "Company of Tannrrs of Gweasklinness"), (25, "Guild of Tanners of Gweasklinness"), (26, "Gweasklinness, Company of Tanners")]
PARTIES = [(30, "Civic Union Party"), (31, "Party, Civic Union"), (32, "C.U.P."), (33, "Civic Un. Party"), (34, "Civic Unipn Party"), (35, "Temperance Union"), (36, "Pilots of the Centre"), (37, "P.o.t.C."), (38, "Crown Covenant Party"), (39, "C.C.P.")]


def rows():
    yield from ((i, "member", d, s, p) for i, d, s, p in MEMBERS)
    yield from ((i, "body", d, None, None) for i, d in BODIES)
    yield from ((i, "party", None, None, p) for i, p in PARTIES)
    yield (40, "member", "Barbara Gwaffwater", "Lady Gwaffwater (Lissenbridge)", "Northern Assembly Party")  # a copy


def groups(df):
    out = {}
    for r in E.resolve(df).collect():
        out.setdefault(r.entity, set()).add(r.key)
    return {frozenset(v) for v in out.values() if len(v) > 1}


SCHEMA = "form_id long, kind string, display_as string, speaker string, party string"
WANT = {frozenset({1, 2, 3, 4, 5, 40}), frozenset({7, 8}), frozenset({20, 21, 22, 23, 24, 26}), frozenset({30, 31, 32, 33, 34}), frozenset({36, 37}), frozenset({38, 39})}


def test_resolution(spark):
    df = spark.createDataFrame(list(rows()), SCHEMA).selectExpr("*", "'x' as profile", "1 as entity")
    assert groups(df) == WANT
    pairs = E.linked_pairs(E.resolve(df.where("kind = 'party'"))).collect()
    assert len(pairs) == 10 + 1 + 1 and all(p.a < p.b for p in pairs)


def test_blocks_in_chunks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK_ROWS", 2)
    assert groups(spark.createDataFrame(list(rows()), SCHEMA)) == WANT


def test_empty(spark):
    assert E.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(("a", "b", "near"), [("gwaffwater", "gwafwater", True), ("rooscote", "roosctoe", True), ("tarn", "barn", True), ("ann", "and", False), ("glendbeck", "gleallby", False)])
def test_near(a, b, near):
    assert E.near(a, b) is near


def held_out(seed, persons=150):
    """Entries of invented persons and bodies, of syllables that occur in no given table, each with its truth."""
    import random

    r = random.Random(seed)
    word = lambda n: "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(n)).capitalize() + r.choice(["n", "s", "k", "x"])
    places, given = [word(3) + r.choice(["ham", "ton", "wick"]) for _ in range(40)], [g for g in E.SHORT_FORMS if len(E.SHORT_FORMS[g].split()[0]) > 2]
    rows, truth = [], {}

    def slip(w):
        i = r.randrange(2, len(w) - 1)
        return r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("aeioumnr") + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :]])

    def add(kind, entity, *names):
        rows.append((len(rows), kind, *names))
        truth[len(rows) - 1] = entity

    for n in range(persons):
        g, s, place, party = r.choice(given).capitalize(), word(3), r.choice(places), f"{word(2)} {word(2)} Party"
        short = r.choice(E.SHORT_FORMS[g.lower()].split()).capitalize()
        title = r.choice(["Mr.", "Sir", "Dr."])
        forms = [f"{g} {s}", f"{s}, {g}", f"{s.upper()} {g}", f"{g} {slip(s)}", f"{short} {s}", f"{g[0]}. {s}"]
        for f in r.sample(forms, 4):
            add("member", f"m{n}", f, f"{title} {s} ({place})", party)
        k, trade = r.choice(["Guild", "Society", "League"]), word(3) + "ers"
        for f in (f"{k} of {trade} of {place}", f"{place} {trade} {k}", f"{k} of {slip(trade)} of {place}"):
            add("body", f"b{n}", f, None, None)
    return rows, truth


def test_held_out_names(spark):
    rows, truth = held_out(99)
    found = {(p.a, p.b) for p in E.linked_pairs(E.resolve(spark.createDataFrame(rows, SCHEMA))).collect()}
    true = {(i, j) for i in truth for j in range(i + 1, len(rows)) if truth[i] == truth[j]}
    print("recall", len(found & true) / len(true), "precision", len(found & true) / len(found))
    assert len(found & true) > 0.9 * len(true) and len(found & true) > 0.98 * len(found)
