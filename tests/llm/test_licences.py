import random

from strandframe.llm import licences as L

PHRASES = dict((b, a) for a, b in L.BASE)


def brute(text):
    import re

    w = re.findall(L.WORD, (text or "").lower())
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = sorted(i for i, _ in places)
    return len(w), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted({label for _, label in places}))


TEXTS = ["the MIT License, the MIT-license", "mit", "Apache License (v2) and GNU General Public License", "general public  LICENSE mit license general public", None, "", "---", "Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software and associated documentation files", "licensed under the apache licence version 2 0 " * 3, "x mit license " * 500]


def test_base_places_and_notices(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS + TEXTS[:1])], "doc_id long, text string, key int")
    got = {}
    for r in L.scan(df).collect():
        got[r["doc_id"]] = r
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute((TEXTS + TEXTS[:1])[r["doc_id"]])
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert len(got) == len(TEXTS) + 1
    assert got[7]["labels"] == "mit" and got[7]["base_labels"] == "" and got[7]["score"] < 1
    assert got[0]["score"] == 1 and got[1]["score"] == 0


def test_repeated_rows_and_empty_table(spark, odd, empty):
    assert L.scan(odd).count() == odd.count()
    assert L.scan(empty).count() == 0


def test_whole_licences_with_edits_in_prose(spark):
    rnd = random.Random(3)
    prose = "of the people and in the house with the other things that are not to be found in any of them".split()
    rows, want = [], {}
    for n, (label, body) in enumerate(L.BODIES):
        for m in range(4):
            w = body.split()
            for _ in range(m * len(w) // 50):
                k = rnd.randrange(len(w))
                w[k : k + 1] = rnd.choice([[], [w[k], "inserted"], ["changed"]])
            rows.append((len(rows), " ".join([*rnd.choices(prose, k=200), *(x.title() + rnd.choice(["", ",", ".\n"]) for x in w), *rnd.choices(prose, k=200)])))
            want[len(rows) - 1] = label
    rows += [(1000 + i, " ".join(rnd.choices(prose, k=3000))) for i in range(5)]
    found = {r["doc_id"]: r for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, label in want.items():
        assert label in found[i]["labels"].split(",") and found[i]["score"] >= L.SHARE, (i, label, found[i])
    assert all(found[1000 + i]["labels"] == "" for i in range(5))


def test_only_ascii_letters_are_lower_cased(spark):
    rows = [(0, "Kind mit license"), (1, "mit lİcense"), (2, "MIT LICENSE"), (3, "x" * 200_000 + " mit license " + "word " * 100_000)]
    got = {r["doc_id"]: r for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["n_base"] for i in range(4)] == [1, 0, 1, 1] and got[0]["n_words"] == 3 and got[3]["n_words"] == 100_003
