import pytest

from chronolex.llm import scanrepair as S

TEXT = "the committee explained that the public charter will be printed and circulated upon the proposed drain self-government modern bridge liberty secure the object this house under cl. no"
WORDS = {w: 100 for w in S._WORD.findall(TEXT)}


@pytest.fixture
def repairer():
    return S.Repairer(S.Lexicon(WORDS, 10_000), S.Furniture(["reportofproceedings"]))


@pytest.mark.parametrize(("read", "word"), [("explainecl", "explained"), ("pub1ic", "public"), ("ſecure", "secure"), ("obj!ect", "obj!ect"), ("clrain", "drain"), ("rnodem", "modern"), ("Brldge", "bridge"), ("zzyx", "zzyx"), ("1864", "1864")])
def test_misread(repairer, read, word):
    assert repairer.lexicon.repair(read)[0] == word


@pytest.mark.parametrize(("a", "b", "word"), [("pro", "posed", "proposed"), ("self", "government", "self-government"), ("Zee", "Land", "zee-land"), ("zee", "land", "zeeland"), ("pr0", "posed", "proposed"), ("govem", "rnent", None)])
def test_joined(repairer, a, b, word):
    found = dict(repairer.repair(f"upon the {a}-\n{b} charter").found)
    assert found["joined"] == (word or "govemrnent")


@pytest.mark.parametrize(
    ("read", "meant"),
    [
        ("thepublic charter", "the public charter"), ("thepublic", "the public"), ("upon th e drain", "upon the drain"), ("the pub lic charter", "the public charter"), ("the chart\ner upon", "the charter upon"),
        ("tbe public charter", "the public charter"), ("the publ ic, charter", "the public, charter"), ("the pr0 posed drain", "the proposed drain"), ("upontlie drain", "upon the drain"), ("thepub-\nlic drain", "the public drain"),
        ("the qqq zzz drain", "the qqq zzz drain"), ("a b c d", "a b c d"), ("the MMCCX drain 1864", "the MMCCX drain 1864"), ("the exp1ained", "the explained"), ("Modem bridge", "Modern bridge"),
    ],
)
def test_joint_decoding(repairer, read, meant):
    assert repairer.repair(read).text == meant


def test_line_end_without_hyphen(repairer):
    assert repairer.repair("upon the proposed char\nter upon").found == [("joined", "charter")]
    assert repairer.repair("the public.\ncharter upon").found == []


def test_prices_are_learnt():
    p = S.learnt_prices({("l", "i"): 1000, ("cl", "d"): 200})
    assert p["l", "i"] == S.CHEAPEST < p["cl", "d"] < p["f", "s"] == S.DEAREST
    assert S.step_of("clrain", "drain") == ("cl", "d") and S.step_of("tbe", "the") == ("b", "h") and S.step_of("abc", "xyz") is None
    assert S.learnt_prices({}) == {}


@pytest.mark.parametrize("scale", [1, 1000])
def test_prices_do_not_depend_on_size(scale):
    words = {w: n * scale for w, n in {"government": 19, "the": 1000, "house": 300}.items()}
    assert S.Lexicon(words, 20_000 * scale).repair("Govemment") == ("government", True)


def test_paragraphs_of_any_length():
    lines = (["This line of the text is as wide as the column of it"] * 700 + ["and ends here."]) * 3
    assert S.paragraph_breaks(lines, [False] * len(lines), 52) == {701, 1402}


def test_page(repairer):
    text = "The committee explainecl that the pub-\n    1535   Supply—Vote Estimates   1536\nlic charter will be printed and\n\n REPORT OF PROCEEDINGS\n\ncirculated upon the proposed bridge\n(298)\nunder cl. 12. This house printed the\ndrain."
    got = repairer.repair(text)
    assert set(got.found) == {
        ("misread", "explained"), ("joined", "public"),
        ("furniture", "1535   Supply—Vote Estimates   1536"), ("furniture", "REPORT OF PROCEEDINGS"), ("furniture", "(298)"),
    }
    assert got.text == "The committee explained that the public charter will be printed and circulated upon the proposed bridge under cl. 12. This house printed the drain."


@pytest.mark.parametrize("text", ["", " ", "\n\n", "-\n-", "a-\n", "x" * 100_000, "-\n".join(["ab"] * 500), "1\n2\n3"])
def test_odd_texts(repairer, text):
    assert isinstance(repairer.repair(text).text, str)


def test_spark(spark):
    rows = [(1, "the pub1ic charter", "x"), (1, "the pub1ic charter", "y"), (2, None, None), (3, "", "z"), (None, "clrain", "n")]
    df = spark.createDataFrame(rows, "k long, t string, found string")
    good = spark.createDataFrame([(TEXT,)] * 5 + [(None,)], "t string")
    got = S.repair_scans(df, good, "k", "t")
    assert sorted((r.key or 0, r.kind, r.item) for r in S.findings(got).collect()) == [(0, "misread", "drain"), (1, "misread", "public"), (1, "misread", "public")]
    assert {r.key: r.text for r in got.collect()} == {1: "the public charter", 2: None, 3: "", None: "drain"}
    assert S.repair_scans(df.where("k = 9"), good, "k", "t").count() == 0


def held_out(seed, texts=400):
    """Reliable texts, and scanned ones with what was done to them, of words and heads that occur in no given table."""
    import random

    r = random.Random(seed)
    syllables = [a + b for a in "b br c ch d f fl g h j l m n p pl qu r s st t tr v w".split() for b in "a e i o u ai ea ou er an en ol is".split()]
    words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 3))) + r.choice(["", "n", "ts", "ly", "ed", "ing"]) for _ in range(1500)] + "the of and to in that for with by".split() * 40
    heads = [f"{a} OF {b}." for a in ("ANNALS", "TREATISE", "JOURNAL", "REGISTER") for b in ("HUSBANDRY", "NAVIGATION", "MEDICINE", "OPTICKS")]

    def sentence():
        w = [r.choice(words) for _ in range(r.randint(6, 16))]
        return " ".join([w[0].capitalize(), *w[1:]]) + "."

    reliable = [" ".join(sentence() for _ in range(5)) for _ in range(texts)]
    steps = [(right, read) for read, right in S.STEPS if len(read) + len(right) <= 3 and read.isalpha()]
    scans = []
    for _ in range(texts):
        truth, lines, line = set(), [], ""
        for w in " ".join(sentence() for _ in range(6)).split():
            core = w.strip(".")
            if len(core) > 5 and core.islower() and r.random() < 0.03:
                right, read = r.choice(steps)
                at = core.find(right)
                if at > 0 and core[:at] + read + core[at + len(right) :] not in words:
                    truth.add(("misread", core))
                    w = w.replace(core, core[:at] + read + core[at + len(right) :], 1)
            if len(line) + len(w) > 52:
                cut = 52 - len(line) - 1
                if len(core) > 6 and 2 < cut < len(core) - 2 and core.islower() and core in w:
                    truth.add(("joined", core))
                    lines.append(line + w[:cut] + "-")
                    line = w[cut:] + " "
                    continue
                lines.append(line.rstrip())
                line = ""
            line += w + " "
        lines.append(line.rstrip())
        for k in range(r.randint(5, 9), len(lines), 12):
            head = r.choice([f"   {r.choice(heads)}   {r.randint(2, 900)}", f"    {r.randint(2, 900)}  {r.choice(heads)}", f" [{r.randint(2, 900)}]"])
            truth.add(("furniture", head.strip()))
            lines.insert(k, head)
        scans.append(("\n".join(lines), truth))
    return reliable, scans


def test_held_out_pages():
    from collections import Counter

    reliable, scans = held_out(5)
    words = Counter(w.lower() for t in reliable for w in S._WORD.findall(t))
    lines = Counter(S.line_key(x) for t, _ in scans for x in t.split("\n") if len(x.strip()) in S.HEAD_CHARS)
    r = S.Repairer(S.Lexicon(dict(words), words.total()), S.Furniture([k for k, n in lines.items() if n >= 4]))
    for kind in ("joined", "misread", "furniture"):
        hit = found = true = 0
        for text, truth in scans:
            got = {x for x in r.repair(text).found if x[0] == kind}
            want = {x for x in truth if x[0] == kind}
            hit, found, true = hit + len(got & want), found + len(got), true + len(want)
        print(kind, "of", true, "recall", round(hit / true, 3), "precision", round(hit / found, 3))
        assert hit > 0.9 * true and hit > 0.9 * found
