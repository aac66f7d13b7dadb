import random
from collections import Counter

import pytest

from inkwell.llm import decontam


def shingles(words, k):
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def slow(docs, items):
    """Best window by comparing every start of every document with every item."""
    found = {}
    for d, text in docs:
        w = (text or "").lower().split()
        for i, item in items:
            v = (item or "").lower().split()
            if not v:
                continue
            k = min(5, len(v))
            want = shingles(v, k)
            for s in range(max(1, len(w) - len(v) + 1)):
                got = shingles(w[s : s + len(v)], k)
                if not got:
                    continue
                common = sum((got & want).values())
                similarity = common / (sum(got.values()) + sum(want.values()) - common)
                if similarity >= 0.8 and similarity > found.get((d, i), (0, 0))[0]:
                    found[d, i] = (similarity, s)
    return found


@pytest.mark.parametrize("most_wanted", [decontam.MOST_WANTED, 0])
def test_matches_brute_force(spark, most_wanted):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(15, 70)))) for i in range(12)]
    items += [(50, "one two three"), (51, "a b " * 20), (52, None), (53, "  "), (54, "single"), (55, items[0][1])]
    docs = []
    for d in range(120):
        w = rng.choices(vocabulary, k=rng.randint(0, 150))
        if d % 2:
            part = rng.choice(items[:12])[1].split()
            for _ in range(d % 3):
                part[rng.choice([0, 1, -1, len(part) // 2])] = "x"
            w += part[d % 4 :] + rng.choices(vocabulary, k=rng.randint(0, 30))
        docs.append((d, " ".join(w).upper() if d % 5 == 0 else "\n".join(w)))
    docs += [(1100, None), (1101, ""), (1102, "one  two\tTHREE"), (1103, "b a " * 300), (1104, "z " * 1500 + items[3][1]),
             (1105, " ".join(items[2][1].split()[1:])), (1106, "x single y"),
             (1107, "u " + "p q " * 5 + "p r"), (1108, "n1 n2 n3 n4 n5 n6 n7 n8")]
    items += [(56, "p q " * 6), (57, "n1 n2 n3 n4 n5 n6 n7 n8 n9")]
    got = decontam.contamination(
        spark.createDataFrame([(*r, 1, "h") for r in docs], "doc_id long, text string, n int, h string"),
        spark.createDataFrame([(*r, 2.0) for r in items], "item_id long, text string, similarity double"),
        most_wanted=most_wanted)
    result = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in got.collect()}
    want = slow(docs, items)
    assert set(result) == set(want) and len(want) > 30
    texts, wanted = dict(docs), dict(items)
    for (d, i), (similarity, _) in want.items():
        assert abs(result[d, i][0] - similarity) < 1e-12
        start, v = result[d, i][1], wanted[i].lower().split()
        got = shingles(texts[d].lower().split()[start : start + len(v)], min(5, len(v)))
        common = sum((got & shingles(v, min(5, len(v)))).values())
        assert abs(common / (sum(got.values()) + len(v) - min(5, len(v)) + 1 - common) - similarity) < 1e-12


def test_drop_and_empty_tables(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame(
        [(1, f"before {passage} after", "k"), (2, "clean", "k"), (2, "clean", "k"), (None, passage, "k"), (3, None, "k")],
        "doc_id long, text string, __x string")
    items = spark.createDataFrame([(1, passage), (1, passage)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.drop_contaminated(docs, items).collect()) == [2, 2, 3]
    assert decontam.contamination(docs, items).count() == 2
    assert decontam.contamination(docs, items.limit(0)).count() == 0
    assert decontam.contamination(docs.limit(0), items).count() == 0


def test_clashing_columns_and_long_items(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f", 1, 2), (2, "g", 3, 4)], "doc_id long, text string, __bad int, __BAD_TH int")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert [tuple(r) for r in decontam.drop_contaminated(docs, items).collect()] == [(2, "g", 3, 4)]
    monkeypatch.setattr(decontam, "LANE", 2)
    with pytest.raises(ValueError, match="has 6 words"):
        decontam.items_table(items)


def test_drop_spares_other_texts_of_the_same_id(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(None, passage), (None, "clean one"), (None, "clean two"), (None, None), (4, f"x {passage}"), (4, "clean four"), (4, "clean four")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in decontam.drop_contaminated(docs, items).collect()), key=str)
    assert got == sorted([(None, "clean one"), (None, "clean two"), (None, None), (4, "clean four"), (4, "clean four")], key=str)
