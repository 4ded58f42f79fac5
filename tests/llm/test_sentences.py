import random
import time

import pytest

from chronolex.llm import sentences as S

SUBJECTS = ["The board", "Dr. Lorne", "My right hon. Friend", "Every witness", "We", "Mr. J. B. Hale", "I"]
ENDS = ["would pay the toll", "cannot agree (see No. 4, p. 12)", "met at 8.30 p.m. on Monday", "paid 3.5 per cent", "asked for roads, bridges, &c", "sold the mill, etc"]


def make(seed, n=3000):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        text, ends = "", []
        for _ in range(r.randint(1, 5)):
            s = f"{r.choice(SUBJECTS)} said that the {r.choice(['old', 'new', 'far'])} town {r.choice(ENDS)}{r.choice('...?!')}"
            if r.random() < 0.2:
                s = f"{r.choice(SUBJECTS)} said, “Come here. Sit down{r.choice('.!')}” to the House."
            if r.random() < 0.1:
                s = "[Interruption.]"
            if r.random() < 0.1:
                s = "“We shall not go there!”"
            if text:
                text += r.choice([" ", " ", " ", "\n\n"])
            text += s
            ends.append(len(text))
        out.append((text, ends))
    return out


@pytest.fixture(scope="module")
def model():
    texts = [t for t, _ in make(1)]
    stats = S.Statistics(*S.count_tokens_at_edges(iter(texts)))
    rows, labels = [], []
    for t in texts:
        for c in S.candidates(t):
            if c.kind != "line" and (y := S.reliable(c, stats)) is not None:
                rows.append([S._bucket(f) for f in S.features(c, stats)])
                labels.append(y)
    return S.Splitter(stats, S.fit(rows, labels))


def test_held_out(model):
    hit = found = wanted = 0
    for text, ends in make(2, 1000):
        got = set(model.ends(text))
        hit += len(got & set(ends))
        found += len(got)
        wanted += len(ends)
    assert hit / found > 0.98 and hit / wanted > 0.98


@pytest.mark.parametrize(
    ("text", "ends"),
    [
        ("", []), (" \n\t ", []), ("no closing mark  ", [15]), ("A HEADING\n\nThen text.", [9, 21]), ("\t x.\n", [4]),
        ("大臣は「もう十分！なぜ？」と言った。次。", [18, 20]),
        ("Κάθε δήμος είπε; Ναι.", None), ("a" * 200_000 + ".", [200_001]),
    ],
)
def test_forms(model, text, ends):
    got = model.ends(text)
    assert got == sorted(set(got)) and (not text.strip() or got[-1] == len(text.rstrip()))
    if ends is not None:
        assert got == ends


@pytest.mark.parametrize("line", ["(" * 100_000, "‘ " * 50_000, "a ‘b’s " * 15_000, "; " * 50_000, "([“" * 30_000 + "]" * 10_000, "a. " * 33_000, '"' * 100_001, " ‘x" * 33_000 + "’"])
def test_long_lines_take_one_pass(line):
    began = time.process_time()
    marks = list(S.candidates(line))
    assert time.process_time() - began < 2 and marks[-1].end == len(line.rstrip())


def test_open_brackets_enclose_nothing():
    assert [c.end for c in S.candidates("He (said. “Yes. We go.")] == [9, 15, 22]
    assert [c.end for c in S.candidates("He (said. “Yes.” We go.) No.")] == [24, 28]
    assert [c.kind for c in S.candidates("Γιατί\u037e Ναι.")] == ["\u037e", "."]


def test_wrapped_lines_go_on():
    ends = lambda t: [c.end for c in S.candidates(t)]
    assert ends("The toll was\npaid in full. We met\r\nat noon,\nand left.") == [26, 53]
    assert ends("A HEADING\nThe toll.") == [9, 19] and ends("a list\n\nof words") == [6, 16] and ends("He said:\nwell.") == [8, 14]


def test_spark(spark):
    rows = [(1, "One ends here. Two ends here.", "x"), (1, "One ends here. Two ends here.", "y"), (2, None, "z"), (None, " ", "z"), (3, "Three.", None)]
    df = spark.createDataFrame(rows, "row_id long, speech string, sent_end string")
    got = S.split_sentences(df).collect()
    assert sorted((r.key, r.sent_end) for r in got if r.key == 3) == [(3, 6)]
    assert {r.key for r in got} == {1, 3} and max(r.sent_end for r in got if r.key == 1) == 29
    assert S.split_sentences(df.where("row_id = 7")).count() == 0
