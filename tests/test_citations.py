"""Citation parser: lines made from the grammar's own parts (names, separators, titles, tails), the scan rule, and style selection."""

import random
import re

import pytest

from citegraph.operators.citations import extract_citations

SURNAMES = "Aalto Brodsky Chaudhuri Dvorak Espinoza Fujita Grabowski Halvorsen Ibarra Juhasz".split()
WORDS = "tidal harbour cranes under winter load with slow ropes, measured: twice - and compared again".split()
TAILS = ["", " Quay Papers 9, 40-61.", " In Dock Days (Gdynia, 2009).", "\n   Pier Review, (7), 2.", " 2011."]


def author(r):
    """(surname, initials)"""
    return r.choice(SURNAMES), [f"{r.choice('ABCDEGHKLMNOPRSTVW')}." for _ in range(r.randint(1, 3))]


def front(a):
    return f"{' '.join(a[1])} {a[0]}"


def capitals(a):
    return f"{a[0].upper()}, {' '.join(a[1])}"


def title(r):
    return " ".join([r.choice(["The", "On", "Seven", "How"]), *r.sample(WORDS, r.randint(2, 6))]).rstrip(" ,:-")


def broken(r, line):
    """The line with some of its blanks as line breaks and deeper blanks, as a page would have it (not within `, and`)."""
    parts = re.split("(, and )", line, flags=re.I)
    return "".join(p if i % 2 else "".join(r.choice(["\n", "  ", "\n\t "]) if c == " " and r.random() < 0.15 else c for c in p) for i, p in enumerate(parts))


def parse(spark, texts, style):
    """[(title, authors, style), ...] of each text."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [[] for _ in texts]
    for x in sorted(extract_citations(df, "text", style).collect(), key=lambda x: x.pos):
        out[x.doc_id].append((x.cited_title, [list(a) for a in x.authors], x.style))
    return out


def acm_lines(n, seed):
    """(line, title, authors) of each form: one author, two with `and`, a list with commas whose last author is kept first."""
    r = random.Random(seed)
    for i in range(n):
        form, show, t = ("one", "two", "list")[i % 3], r.choice([front, capitals]), title(r)
        people = [author(r) for _ in range({"one": 1, "two": 2, "list": r.randint(3, 7)}[form])]
        if form == "one":
            head = f"{show(people[0])}."
        elif form == "two":
            head = f"{show(people[0])} and {show(people[1])}."
        else:
            head = f"{', '.join(map(show, people[:-1]))}, {r.choice(['and', 'AND', 'And'])} {show(people[-1])}{r.choice(['', '.'])}"
            people = [people[-1], *people[:-1]]
        head, end = r.choice([head, f"{head} {r.randint(3, 2020)}."]) , r.choice([".", "?", " (", "."])
        names = [[s.upper() if show is capitals else s, *initials] for s, initials in people]
        yield broken(r, f"{r.choice(['', f'[{i}] ', f'{i} '])}{head} {t}") + end + r.choice(TAILS), t, names


def test_acm_forms(spark):
    cases = list(acm_lines(90, 1))
    for got, (line, t, names) in zip(parse(spark, [c[0] for c in cases], "acm"), cases):
        assert got[:1] == [(t, names, "acm")], line


def test_acm_lists_in_one_text(spark):
    cases = list(acm_lines(30, 2))
    text = "".join(f"{line}\n\n" for line, _, _ in cases if line.rstrip().endswith("."))
    want = [(t, names, "acm") for line, t, names in cases if line.rstrip().endswith(".")]
    assert parse(spark, [text], "acm") == [want]


def test_ieee_forms(spark):
    r, cases = random.Random(3), []
    for _ in range(40):
        people, t = [author(r) for _ in range(r.randint(1, 5))], title(r)
        joined = front(people[0]) if len(people) == 1 else f"{', '.join(map(front, people[:-1]))} and {front(people[-1])}"
        cases.append((f"{broken(r, joined)}, {r.choice('“‘«')}{t}, Vol. 3{r.choice('”’»')} Dock J., 2008.", f"{t}, Vol. 3", [[*i, s] for s, i in people]))
    for got, (line, t, names) in zip(parse(spark, [c[0] for c in cases], "ieee"), cases):
        assert got == [(t, names, "ieee")], line


def test_springer_forms(spark):
    r, cases = random.Random(4), []
    for _ in range(40):
        people, t, more = [author(r) for _ in range(r.randint(1, 5))], title(r), r.random() < 0.4
        line = ", ".join([*(f"{s}, {''.join(i)}" for s, i in people), *(["et al."] if more else [])])
        cases.append((f"{line}: {t}. Dock Days 4 (2010)", t, [*([s, *i] for s, i in people), *([["et al"]] if more else [])]))
    for got, (line, t, names) in zip(parse(spark, [c[0] for c in cases], "springer"), cases):
        assert got == [(t, names, "springer")], line


def test_best_takes_the_style_that_fits(spark):
    acm = "M. Ibarra and T. Juhasz. Cranes in a gale. Quay Papers, 2008."
    ieee = "M. Ibarra and T. Juhasz, “Cranes in a gale” Quay Papers, 2008."
    springer = "Ibarra, M., Juhasz, T.: Cranes in a gale. Quay Papers (2008)"
    assert [[c[2] for c in found] for found in parse(spark, [acm, ieee, springer], "best")] == [["acm"], ["ieee"], ["springer"]]
    assert parse(spark, [ieee, springer], "acm") == [[], []]


@pytest.mark.parametrize("text, titles", [
    ("QUAY. Harbour. Not a reference. V. Dvorak. A reference.", ["A reference"]),  # a run of capitals is skipped whole
    ("XV. Dvorak. Roman numeral before a name.", []),
    ("V. Dvorak. ", []),  # no title
    ("v. dvorak. Lower case names. are no authors.", []),
    ("", []),
    ("V. Dvorak. Ends here? E. Aalto. And the next (2001).", ["Ends here", "And the next"]),
    ("V. Dvorak. 2001 Title behind a number without a sign.", ["2001 Title behind a number without a sign"]),
    ("V. Dvorak. 2001: title behind a number and a sign.", ["title behind a number and a sign"]),
    ("Ø. Ångström. Žluté lodě a řeka. Přístav.", ["Žluté lodě a řeka"]),
])
def test_scan(spark, text, titles):
    assert [t for t, _, _ in parse(spark, [text], "acm")[0]] == titles


def test_long_title_does_not_overflow(spark):
    text = "word " * 200_000
    (got,) = parse(spark, [f"V. Dvorak. {text}. Quay."], "acm")
    assert [len(t) for t, _, _ in got] == [len(text) - 1]


def test_sections_are_numbered_as_one_list(spark):
    df = spark.createDataFrame([(1, ["V. Dvorak. Outer mole. Quay.", "no reference", "E. Aalto. Inner mole. Quay."])], "doc_id long, secs array<string>")
    rows = extract_citations(df, "secs", "acm", sections=True).orderBy("pos").collect()
    assert [(r.pos, r.cited_title) for r in rows] == [(0, "Outer mole"), (1, "Inner mole")]
