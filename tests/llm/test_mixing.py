import random

import duckdb
import pytest

from inkwell.llm import mixing

TEXTS = "doc_id long, text string, source string, e string, size int, target string"


def documents(n=400, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a"] * 6 + ["b", "c", "Ä", None, ""])
        text = " ".join("w" for _ in range(rng.choice([0, 1, 5, 40, 300, 2000 if i % 90 == 0 else 20])))
        rows.append((i, text if i % 37 else None, source, "x", 1, "y"))
    return rows


def counted(spark, rows):
    return [r.asDict() for r in mixing.mixed_counts(spark.createDataFrame(rows, TEXTS)).collect()]


def slow_targets(sizes):
    """The stated loop: cap whatever is above, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        free = [s for s in order if s not in capped]
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return capped | share
        capped |= {s: 3 * sizes[s] for s in over}


def test_targets_and_words_taken(spark):
    rows = documents()
    got = counted(spark, rows)
    source = {r[0]: r[2] for r in rows}
    sizes, taken, target = {}, {}, {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == len((rows[r["doc_id"]][1] or "").split())
        assert 0 <= r["taken"] <= 3 * r["size"]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
    want = slow_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= max(40, 0.05 * want[s])
    assert sorted(map(str, got)) == sorted(map(str, counted(spark, rows[::-1])))


def test_matches_sql(spark):
    import pandas as pd

    rows = documents(300, 9)
    got = sorted(tuple(r.values()) for r in counted(spark, rows))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source", "e", "size", "target"]).astype({"source": object}))
    want = sorted(con.sql(mixing.MIX_SQL).fetchall())
    assert [(a[0], a[1], a[4], a[5]) for a in got] == [(b[0], b[1], b[4], b[5]) for b in want]


def test_repeated_rows_have_draws_of_their_own(spark):
    rows = [(None, "a b c", "s", "", 0, "")] * 200 + [(2, "a b " * 300, "t", "", 0, ""), (None, "q", None, "", 0, "")]
    got = counted(spark, rows)
    taken = sum(r["taken"] for r in got if r["source_size"] == 600)
    target = next(r["target"] for r in got if r["source_size"] == 600)
    assert len(got) == 202 and abs(taken - target) < 3  # not a multiple of 600


def test_sources_of_empty_texts_alone(spark):
    rows = [(1, "a b c", "s", "", 0, ""), (2, "", "t", "", 0, ""), (3, None, "t", "", 0, ""), (4, None, "u", "", 0, "")]
    got = {r["doc_id"]: (r["size"], r["taken"], r["target"]) for r in counted(spark, rows)}
    assert got == {1: (3, 3, 3.0), 2: (0, 0, 0.0), 3: (0, 0, 0.0), 4: (0, 0, 0.0)}
    assert sorted(r.doc_id for r in mixing.mix(spark.createDataFrame(rows, TEXTS)).collect()) == [1, 2, 3, 4]


def test_clashing_columns_are_kept(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 7, 8, "x", "y")], "doc_id long, text string, source string, __size int, __row int, `a.b` string, doc string")
    assert [tuple(r) for r in mixing.mix(docs).collect()] == [(1, "a b", "s", 7, 8, "x", "y")]


def test_mix_repeats_rows_and_keeps_columns(spark):
    rows = documents(60)
    docs = spark.createDataFrame(rows, TEXTS)
    copies = {r["doc_id"]: r["copies"] if r["size"] else 1 for r in counted(spark, rows)}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    seen = {}
    for r in mixed.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == {d: c for d, c in copies.items() if c}


def test_empty_table_and_texts(spark):
    assert counted(spark, []) == []
    assert [r["taken"] for r in counted(spark, [(1, None, "s", "", 0, ""), (2, "", None, "", 0, "")])] == [0, 0]
