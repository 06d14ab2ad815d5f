import hashlib
import random
import time
from collections import Counter

from strandframe.llm import pii as P
from strandframe.llm.words import words


def by_definition(t):
    y = [(m.start(), m.end(), 0) for m in P.EMAIL.finditer(t)]
    y += [(m.start(), m.end(), 1) for m in P.IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    y += [(m.start(), m.end(), 2) for m in P.CARD.finditer(t) if 14 <= sum(c.isdigit() for c in m.group()) <= 19 and P.luhn("".join(c for c in m.group() if c.isdigit()))]
    y += [(m.start(), m.end(), 3) for m in P.PHONE.finditer(t) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(y, key=lambda s: (s[0], s[2]))


def test_patterns_equal_their_definition():
    rnd = random.Random(1)
    parts = [*"ab1.@-+ 9()", "a@b.c", "4111 1111 1111 1111", "1.2.3.4", "+49 30 1234567890", "é", "000.1.1.1"]
    for _ in range(5000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        assert P.pattern_spans(t) == by_definition(t), t


def test_terms_that_reveal_an_entity(spark):
    near = [(i, f"write to zanzibart about it: zan@x.org, said the owner {i}") for i in range(5)]
    far = [(10 + i, f"the owner said nothing about it number {i}") for i in range(20)]
    docs = spark.createDataFrame([*near, *far, (99, "zanzibart came alone"), (100, None)], "doc_id long, text string").repartition(3)
    for block in (200_000, 1):
        terms = P.revealing(docs)
        assert {bytes(r["term"]) for r in terms.collect()} >= {b"zanzibart", b"write"} and b"about" not in {bytes(r["term"]) for r in terms.collect()}
        rows = {r["doc_id"]: r for r in P.find(docs, terms, broadcast_terms=block).collect()}
        assert rows[99]["clean"] == " came alone" and [s["kind"] for s in rows[99]["spans"]] == ["term"]
        assert "zan@x.org" not in rows[0]["clean"] and "<email>" in rows[0]["clean"]
        assert rows[10]["clean"] == far[0][1] and rows[100]["clean"] is None


def test_odd_rows_and_empty_table(odd, empty):
    out = P.find(odd, P.revealing(odd), carry=("score", "spans"))
    assert out.count() == odd.count()
    assert P.find(empty, P.revealing(empty)).count() == 0


def test_a_long_run_of_digits_costs_one_look():
    t = "9" * 1_000_000 + " 1.2.3.4 " + "1" * 300_000 + ".2.3" + " 7.8.9." + "5" * 300_000
    began = time.time()
    assert [s for s in P.pattern_spans(t) if s[2] == 1] == [(1_000_001, 1_000_008, 1)]
    assert time.time() - began < 5


def test_words_around_a_mention_are_taken_whole():
    for _ in range(300):
        rnd = random.Random(_)
        ws = ["".join(rnd.choice("abcdé") for _ in range(rnd.choice([1, 5, 60, 400]))) for _ in range(14)]
        left, right = " ,".join(ws[:7]) + rnd.choice(["", " "]), rnd.choice(["", "! "]) + ". ".join(ws[7:])
        text, span = f"{left} a@b.cc {right}", (len(left) + 1, len(left) + 7, 0)
        want = {w.encode() for w in ws[2:12] if len(w.encode()) >= 4}
        assert P._near(text, span, 5) == want


def test_spans_and_digest_of_the_query_by_definition(spark, tmp_path):
    rnd = random.Random(4)
    parts = ["mail bob@x.org now", "card 4111 1111 1111 1111", "host 10.0.0.1 up", "call +49 30 1234567890 soon", "nothing here", "zebrafish", "é"]
    rows = [(i, " ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 6)))) for i in range(60)] + [(60, None), (61, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in P.op7_pii_spans(spark, str(tmp_path)).collect()}
    terms = by_brute_force([t for _, t in rows])
    for i, text in rows:
        base = by_definition(text or "")
        names = [f"{P.KINDS[k]}:{a}:{b}" for a, b, k in base]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in P.KINDS] == [sum(s[2] == n for s in base) for n in range(4)]
        more = [(m.start(), m.end(), 4) for m in P.TOKEN.finditer(text or "") if m.group().lower().encode() in terms and not any(a < m.end() and m.start() < b for a, b, _ in base)]
        assert got[i]["spans"] == ",".join(f"{(*P.KINDS, 'term')[k]}:{a}:{b}" for a, b, k in sorted([*base, *more], key=lambda s: (s[0], s[2])))


def by_brute_force(texts):
    """The terms in three documents or more beside one entity, and in at most twice as many at all."""
    both, seen = Counter(), Counter()
    for t in texts:
        t = t or ""
        seen.update(set(words(t)))
        both.update({(w, P.entity(t, s)) for s in by_definition(t) for w in words(t[: s[0]])[-5:] + words(t[s[1] :])[:5]})
    return {w for (w, _), n in both.items() if n >= 3 and n / seen[w] >= 0.5 and len(w) >= 4 and not any(48 <= c <= 57 for c in w)}
