"""Fuzzy names against plain loops."""

import random
from functools import lru_cache

from pyspark.sql import functions as F

from veriframe.operators import fuzzy


@lru_cache(maxsize=None)
def osa(a, b):
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[len(b)]


def close(a, b):
    return 1 - osa(a, b) / max(len(a), len(b)) if a and b else 0.0


def edited(rng, word, letters="abcd"):
    """The word after some edits, swaps among them."""
    w = list(word)
    for _ in range(rng.randint(0, max(1, len(w) // 3))):
        at = rng.randrange(len(w) + 1)
        kind = rng.randrange(4)
        if kind == 0:
            w.insert(at, rng.choice(letters))
        elif at < len(w) and kind == 1:
            w[at] = rng.choice(letters)
        elif at < len(w) and kind == 2 and len(w) > 1:
            del w[at]
        elif at + 1 < len(w):
            w[at], w[at + 1] = w[at + 1], w[at]
    return "".join(w)


def test_distance_equals_the_recurrence(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdж") for _ in range(n))
    pairs = [(word(rng.randint(0, 14)), word(rng.randint(0, 14))) for _ in range(6000)]
    pairs += [(a, edited(rng, a)) for a, _ in pairs[:4000] if a]
    pairs += [(word(n), word(m)) for n, m in [(61, 62), (62, 62), (62, 80), (63, 63), (63, 70), (90, 75)] for _ in range(4)]
    pairs += [("harvrad", "harvard"), ("ca", "abc"), ("", "ab"), ("", ""), ("kitten", "sitting")]
    frame = spark.createDataFrame([*pairs, (None, "a"), ("a", None)], "a string, b string")
    rows = frame.select("a", "b", fuzzy.osa_distance(F.col("a"), F.col("b")).alias("d"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [r.d for r in rows.collect()] == [osa(a, b) for a, b in pairs] + [None, None]


def test_near_texts_are_complete(spark):
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 24))) for _ in range(300)})
    typed = sorted({edited(rng, w) for w in words for _ in range(2)} - {""})
    found = fuzzy.near_texts(spark.createDataFrame([(t,) for t in [*typed, "", None]], "a string"),
                             spark.createDataFrame([(w,) for w in [*words, words[0], ""]], "b string"))
    got = {(r.a, r.b): r.distance for r in found.collect()}
    assert got == {(a, b): d for a in typed for b in words if (d := osa(a, b)) <= max(len(a), len(b)) // 4}


def similarity(query, name):
    def words(text):
        ws = text.split()
        kept = [w for w in ws if not (len(w) >= 5 and any(osa(w, f) <= 2 for f in fuzzy.FILLER_LIKE))]
        return kept or ws

    q, n = words(query), words(name)
    long = [w for w in q if len(w) >= 3]
    mean = sum(max((close(w, x) for x in n), default=0) for w in long) / len(long) if long else 0
    return max(close(" ".join(q), " ".join(n)), mean)


def test_matches_equal_all_pairs(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 11))) for _ in range(120)] + ["university", "state"]
    names = sorted({" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 4))) for _ in range(2000)})
    asked = sorted({" ".join(edited(rng, w, "abcde") for w in rng.choice(names).split()) for _ in range(30)}
                   | {"newyork state", "new york state", "harvrad univrsity", "zzzzz"})
    asked = [" ".join(a.split()) for a in asked if a.split()]
    names += ["new york state", "newyork", "harvard", "kazakh british technical"]
    found = fuzzy.fuzzy_matches(spark.createDataFrame([(a,) for a in asked], "variant string"),
                                spark.createDataFrame([(n,) for n in names], "name string"))
    got = {(r.variant, r.name): r.similarity for r in found.collect()}
    every = {(a, n): round(similarity(a, n), 9) for a in asked for n in names}
    assert got == {pair: s for pair, s in every.items() if s >= 0.75} and got[("harvrad univrsity", "harvard")] > 0.85
    assert ("new york state", "newyork") not in got and ("newyork state", "new york state") in got


def test_filler_words(spark):
    words = spark.createDataFrame([("harvard univrsity",), ("univrsity",), ("unievrsiyt x",), ("",)], "t string")
    assert [r[0] for r in words.select(fuzzy.significant_words(F.col("t"))).collect()] == [["harvard"], ["univrsity"], ["x"], []]


def test_probes_stay_few_and_are_not_gathered(spark):
    rng = random.Random(8)
    texts = [("".join(rng.choice("abcdefgh") for _ in range(40)),) for _ in range(20)]
    frame = spark.createDataFrame(texts, "b string")
    probes = fuzzy._probes(frame, "b", 1)
    assert "Aggregate" not in probes._jdf.queryExecution().executedPlan().toString()
    assert probes.count() <= 20 * 1040
    plan = fuzzy.near_candidates(frame.toDF("a"), frame)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2 and "RoundRobinPartitioning" in plan


def test_long_near_texts_with_swaps_are_complete(spark):
    rng = random.Random(9)
    base = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(12, 44))) for _ in range(60)})

    def swapped(text, n):
        w = list(text)
        for at in rng.sample(range(0, len(w) - 1, 2), n):
            w[at], w[at + 1] = w[at + 1], w[at]
        return "".join(w)

    typed = sorted({swapped(t, len(t) // 4) for t in base for _ in range(4)} | {swapped(t, len(t) // 4)[1:] for t in base}
                   | {edited(rng, t, "abc") for t in base for _ in range(3)} | {"c" + swapped(t, len(t) // 4 - 1) for t in base})
    found = fuzzy.near_texts(spark.createDataFrame([(t,) for t in typed], "a string"), spark.createDataFrame([(t,) for t in base], "b string"))
    got = {(r.a, r.b): r.distance for r in found.collect()}
    every = {(a, b): osa(a, b) for a in typed for b in base if abs(len(a) - len(b)) <= max(len(a), len(b)) // 4}
    assert got == {p: d for p, d in every.items() if d <= max(map(len, p)) // 4} and len(got) > 300
