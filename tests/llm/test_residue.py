import random

import numpy as np
import pytest
from sparkloom.llm import residue

DOC = "doc_id bigint, text string"
TALK = ["I moved the {a} {n} in the yard on Sunday.", "The {n} from my porch was {a} and I sold it.", "Has anyone fixed a {a} {n} like this?", "Price was {d}.50 at the {n} sale.", "We painted it so that the {n}s match.", "Put the {n} next to the {n}.", "Same here.", "It stays {a} for {d} days.", "Choose the best {n}."]
MENTIONS = ["Do I really have to enable JavaScript just to see the {n} drawings? My old tablet hates it.", "I keep getting a 404 when I open the {n} catalogue, does it work for you?", "In the template I typed `{{{{name}}}}` as the manual says, but the {n} still prints blank."]
RESIDUE = [
    "Hello {{{{ first_name }}}}, your listing of the {n} ends on %DATE%.", "You need to enable JavaScript to use this board.", "This page requires JavaScript and cookies.", "503 Service Unavailable\nTry later.",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Seite nicht gefunden.", "xxxx xxxx xxxx xxxx xxxx xxxx xxxx xxxx xxxx", "Your session has expired. Log in again to continue.",
    "Checking your browser. Enable JavaScript and cookies.", "You need to allow scripts to use this page.", "Turn on JavaScript and cookies.", "Error {c}. No such file at {n} on this server.",
]
UNSEEN = ["This board cannot run without JavaScript and cookies.", "This site needs JavaScript and cookies.", "You need JavaScript to use this board.", "No such file at {n} on this server.", "Log in again to continue."]


def say(rng, patterns, n):
    words = {"a": rng.choice(["red", "noisy", "heavy", "late", "odd"]), "n": rng.choice(["stove", "axle", "ledger", "hose", "crate", "bench"]), "d": rng.randint(10, 99), "c": rng.choice([404, 410, 500])}
    return " ".join(p.format(**words) for p in rng.sample(patterns, n))


@pytest.fixture(scope="module")
def corpus():
    """(text, is residue): a part of the cases in wordings that are no seeds."""
    rng = random.Random(11)
    rows = [(say(rng, TALK, rng.randint(1, 6)), False) for _ in range(3000)]
    rows += [(say(rng, MENTIONS, 1) + " " + say(rng, TALK, 1), False) for _ in range(150)]
    rows += [(say(rng, RESIDUE, 1), True) for _ in range(250)]
    rows += [(say(rng, TALK, 2) + "\n" + say(rng, RESIDUE, 1), True) for _ in range(50)]
    rows += [(say(rng, UNSEEN, 1), True) for _ in range(40)]
    rows += [("[quote=a]" + say(rng, RESIDUE, 1) + "[/quote]\n" + say(rng, TALK, 1), False) for _ in range(60)]
    rows += [("ann wrote:\n> " + say(rng, RESIDUE, 1).replace("\n", "\n> ") + "\n\n" + say(rng, TALK, 2), False) for _ in range(60)]
    rows += [(say(rng, TALK, 2) + "\n-- \n" + say(rng, RESIDUE, 1), False) for _ in range(30)]
    return rows


def trusted(text):
    return residue.Passages.of(*residue.encoded([text])).trusted.tolist()


def test_accuracy_with_unseen_wordings(spark, corpus):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(corpus)], DOC)
    found = {r.doc_id for r in residue.residue_records(df).collect()}
    want = {i for i, (_, y) in enumerate(corpus) if y}
    assert len(found & want) >= 0.98 * len(want), {corpus[i][0] for i in want - found}
    assert len(found - want) <= 0.02 * len(want), {corpus[i][0] for i in found - want}


def test_unseen_wordings_are_not_trusted():
    assert not any(any(trusted(t.format(n="axle"))) for t in UNSEEN)


def test_model_judges_what_it_was_not_fitted_on(spark, corpus):
    """Fitted on one half of the records with a third of the wordings unlabelled, judged on the other half."""
    rows = [(i, t) for i, (t, _) in enumerate(corpus)]
    model = residue.fit(residue.token_table(spark.createDataFrame(rows[::2], DOC)), hide=1 / 3)
    scored = residue.score(residue.token_table(spark.createDataFrame(rows[1::2], DOC)), model)
    found = {r["_key"] for r in scored.where("residue_passages > 0").collect()}
    want = {i for i, (_, y) in enumerate(corpus) if y and i % 2}
    assert len(found & want) >= 0.9 * len(want)
    assert len(found - want) <= 0.05 * len(want)


def test_held_out_wordings(spark):
    """Notices that share words, each wording rare: the hidden third is found without its labels."""
    rng = random.Random(5)
    ask, what, why = ["enable", "activate", "allow", "turn on", "switch on"], ["JavaScript", "scripts", "JS", "scripting"], ["use this board", "see this thread", "display the replies", "continue", "view this page", "read the full topic"]
    rows = [say(rng, TALK, rng.randint(1, 5)) for _ in range(3000)] + [f"You need to {rng.choice(ask)} {rng.choice(what)} to {rng.choice(why)}." for _ in range(200)]
    got = residue.held_out(residue.token_table(spark.createDataFrame(list(enumerate(rows)), DOC)))
    assert got["hidden"] > 30
    assert got["found"] >= 0.9 * got["hidden"]


@pytest.mark.parametrize(
    ("text", "own"),
    [
        ("[quote=a]x [quote=b]y[/quote] z[/quote]\nmine", "mine"),
        ("<blockquote>a wrote:<br/>> x<blockquote>y</blockquote></blockquote>\nmine", "mine"),
        ("a wrote:\n> x\n>> y\n\nmine", "mine"),
        ("first\na wrote:\n> x\n\nsecond", "first second"),
        ("[quote=a][quote=b]x[/quote]\nmine", "mine"),
        ("> [quote=b]x\n> y\n\nmine", "mine"),
        ("[quote=a]b wrote:\n> x[/quote]\nmine", "mine"),
        ("[quote]x\ny\n\nmine", "mine"),
        ("mine\n--\nsig", "mine"),
        ("mine\n-- \nsig", "mine"),
        ("mine\n~~~\nsig\nmore", "mine"),
        ("mine\n____\nsig", "mine"),
        ("mine `{{x}}` <code>404</code>", "mine \x00 \x00"),
        ("> only\n> quoted", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_own_text(text, own):
    assert residue.own_text(text).split() == own.split()


@pytest.mark.parametrize("slot", ["{{ a }}", "${a_b}", "#{a}", "<%= a.b %>", "%(a)s", "%NAME%", "@@a@@", "*|NAME|*", "__NAME__", "##a-b##", "[[a]]", "<insert name here>", "[YOUR NAME]", "[first_name]", "{first_name}"])
def test_placeholders(slot):
    assert any(trusted(f"Dear {slot} thank you"))
    assert any(trusted(f"Dear {slot[:-2]}{'x' * 200 if slot[-3].isalpha() else ''}{slot[-2:]} thank you"))


@pytest.mark.parametrize("text", ["The set {2, 4, 8} of sizes is enough", "see [12] and [SOLVED]", "100% happy with 50% off", "a [b]bold[/b] word", "I use snake_case_names here", "my price is $5 {ok}"])
def test_no_placeholders(text):
    assert not any(trusted(text))


def test_passages():
    ends = residue.EDGE, residue.CUT
    got = residue.Passages.of(*residue.encoded(["One two. Three?\nfour", None, "a b c {{x}} d e f g", "..."]))
    assert got.record.tolist() == [0, 0, 0, 2, 2, 2]
    assert [int(t) in ends for t in got.tokens[np.r_[got.starts[1:], len(got.tokens)] - 1]] == [True] * 6
    assert got.slot.tolist() == [False] * 4 + [True, False]
    assert len(residue.Passages.of(*residue.encoded([None, ""]))) == 0
    assert trusted("Forbidden") == [False]  # a word alone is judged by the model like any other passage
    assert trusted("no no. no no. no no. no no.") == [True] * 4
    assert trusted("I get a 404 not found. 404 Not Found") == [False, True]


def test_defined_results(spark):
    rows = [(1, None), (2, ""), (None, "You need to enable JavaScript to use this board."), (3, "404 Not Found"), (3, "404 Not Found"), (4, "I like the stove and " * 20_000), (5, "[quote]404 Not Found[/quote]"), (6, "???"), (7, "word")]
    got = residue.residue_records(spark.createDataFrame(rows, DOC))
    assert {r.doc_id for r in got.collect()} == {3, None}
    assert residue.residue_records(spark.createDataFrame([], DOC)).count() == 0
    assert residue.residue_records(spark.createDataFrame([(1, "plain talk about stoves")], DOC)).count() == 0
    clash = spark.createDataFrame([(1, "404 Not Found", 2.0, True, [1])], DOC + ", probability double, _key boolean, tokens array<int>")
    assert residue.residue_records(clash).count() == 1


def test_long_signatures():
    behind = "\n".join(f"line {i}" for i in range(20))
    for line in ("--", "-- ", "***", "____"):
        assert residue.own_text(f"I sold it.\n{line}\n{behind}\n404 Not Found") == "I sold it."
    assert residue.own_text(f"I sold it.\n--\n{behind}\n--\nend") == f"I sold it.\n--\n{behind}"
    assert residue.own_text(f"Part one.\n***\n{behind}\n\nmore") == f"Part one.\n***\n{behind}\n\nmore"  # a rule between parts
    assert residue.own_text(f"I sold it.\n--\n{behind}\n\nmore") == "I sold it."
    assert residue.own_text("> --\n" + behind) == behind
    assert residue.own_text("x" * 500 + " wrote:\n> 404\nmine") == "mine"
