"""Street names by likeness: ratios, candidates without all pairs, matches as of all pairs."""
import random
from functools import cache

from vicinity.operators import geocode


def plain_ratio(a, b):
    @cache
    def common(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + common(i + 1, j + 1) if a[i] == b[j] else max(common(i + 1, j), common(i, j + 1))

    return 200.0 * common(0, 0) / (len(a) + len(b)) if a and b else 0.0


def test_likeness():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc ", k=rng.randrange(15))) for _ in "ab")
        assert abs(geocode.ratio(a, b) - plain_ratio(a, b)) < 1e-9
    assert geocode.likeness("rua andradas", "rua dos andradas") == 95.0
    assert geocode.likeness("andradas rua dos", "rua dos andradas") == 95.0
    assert geocode.likeness("rua dos andrada", "rua dos andradas") > 96
    assert geocode.likeness("rua ipiranga", "rua dos andradas") < 85
    assert geocode.likeness("rua a", "rua marechal floriano") < 85


def names(rng, n):
    part = lambda: "".join(rng.choices("bcdfglmnprst", k=1) + rng.choices("aeiou", k=1))
    word = lambda: "".join(part() for _ in range(rng.randrange(2, 6)))
    return sorted({" ".join([rng.choice(["rua", "rua", "rua", "avenida"]), *([rng.choice(["dos", "da"])] * rng.randrange(2)), *(word() for _ in range(rng.randrange(1, 4)))]) for _ in range(n)})


def worn(rng, name):
    """A name with letters or words changed, left out or moved."""
    w = name.split()
    kind = rng.randrange(5)
    if kind == 0:
        rng.shuffle(w)
    elif kind == 1 and len(w) > 2:
        del w[rng.randrange(len(w))]
    elif kind == 2:
        w.insert(rng.randrange(len(w)), rng.choice(["dos", "velha", "x"]))
    text = list(" ".join(w))
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(text))
        text[at : at + rng.randrange(2)] = rng.choices("aeiotr", k=rng.randrange(2))
    return " ".join("".join(text).split()) or "rua"


def test_matches_as_of_all_pairs(spark):
    rng = random.Random(4)
    streets = names(rng, 250)
    asked = sorted({worn(rng, rng.choice(streets)) for _ in range(250)} - set(streets))
    df = spark.createDataFrame([(i, s) for i, s in enumerate(streets)], "cdlog long, name string")
    got = {r.street: (r.matched, r.cdlog, r.score) for r in geocode.match_streets(spark.createDataFrame([(a,) for a in asked], "street string"), df).collect()}
    alike = lambda a, s: geocode.likeness(a, s) if max(len(a), len(s)) < 1.5 * min(len(a), len(s)) else 0.0
    for a in asked:
        score, cdlog = max((alike(a, s), i) for i, s in enumerate(streets))
        assert got[a] == ((streets[cdlog], cdlog, score) if score >= 85 else (None, None, None))
    assert sum(v[0] is not None for v in got.values()) > 150


def test_few_pairs_meet(spark):
    """Streets that all begin alike don't meet all queries."""
    rng = random.Random(5)
    letters = lambda: "rua " + " ".join("".join(rng.choices("abcdefghijlmnopqrstuvxz", k=rng.randrange(4, 11))) for _ in range(2))
    frame = lambda x: spark.createDataFrame([(n,) for n in x], "name string")
    syllables = [s for s in names(rng, 1200) if s.startswith("rua") and len(s) > 12][:400]
    for streets, share in (([letters() for _ in range(400)], 0.02), (syllables, 0.16)):  # words of few syllables share more
        asked = [s[:-1] + ("x" if s[-1] != "x" else "y") for s in streets]
        pairs = {(r.q, r.s) for r in geocode.candidate_pairs(frame(asked), frame(streets)).collect()}
        assert len(streets) == 400 and set(zip(asked, streets)) <= pairs
        assert len(pairs) < share * 400 * 400, len(pairs)
