import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from inkwell import session
from inkwell.operators import graph, similar
from inkwell.plans import join_queries


def near_copies(seed):
    """(id, tokens): sets of very different sizes, copies, near copies, repeated and null ids, empty and null lists."""
    rng, rows = random.Random(seed), []
    for i in range(30):
        base = [f"w{rng.choice([0, 1, rng.randrange(3000)])}" for _ in range(rng.choice([1, 3, 12, 60, 300]))]
        for _ in range(rng.randint(1, 5)):
            copy = [w if rng.random() > rng.choice([0.0, 0.05, 0.1]) else f"n{rng.randrange(9999)}" for w in base]
            rows.append((rng.choice([None, 7, *range(100, 400)]), rng.sample(copy, len(copy))))
    return [*rows, (900, []), (901, None), (902, rows[0][1])]


@pytest.mark.parametrize(("seed", "threshold", "limits"), [(1, 0.8, {}), (2, 0.5, {"most": 0, "block": 3000}), (3, 0.8, {"most": 0, "block": 1})])
def test_similar_sets_lose_no_link(spark, seed, threshold, limits):
    rows = near_copies(seed)
    members, pairs = similar.similar_sets(spark.createDataFrame(rows, "id long, tokens array<string>"), threshold, **limits)
    reps = {}
    for i, t in rows:
        if t:
            ids = [x for x in (reps.get(frozenset(t)), i) if x is not None]
            reps[frozenset(t)] = min(ids, default=None)
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r.id, r.rep) for r in members.collect()), key=key) == sorted(((i, reps[frozenset(t)]) for i, t in rows if t), key=key)
    named = [(r, t) for t, r in reps.items() if r is not None]
    want = [(a, b, len(x & y) / len(x | y)) for a, x in named for b, y in named if a < b and len(x & y) / len(x | y) >= threshold]
    assert want and sorted((r.a, r.b, r.similarity) for r in pairs.collect()) == sorted(want)


def test_similar_sets_store_less_than_the_sets(spark, monkeypatch):
    """Whole sets, larger than the texts, are neither stored nor repeated for each pair."""
    stored, store = [], similar.materialize

    def watched(df, name):
        out = store(df, name)
        stored.append((name, sum(Path(f.removeprefix("file://")).stat().st_size for f in out.inputFiles())))
        return out

    monkeypatch.setattr(similar, "materialize", watched)
    tokens = F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.sha2(F.concat_ws(" ", (F.col("id") / 20).cast("int"), F.when(i == 1, F.col("id")), i), 256))
    members, pairs = similar.similar_sets(spark.range(2000).select("id", tokens.alias("tokens")), 0.8)
    assert members.count() == 2000 and pairs.count() == 100 * 190
    assert sum(n for _, n in stored) < 0.5 * 2000 * 300 * 8


def test_components_keep_one_table(spark):
    before = len(session._OWNED)
    found = graph.components(spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert {r.component for r in found.collect()} == {0} and len(session._OWNED) == before + 1


def test_steps_leave_no_shuffle_files(spark):
    """Shuffle files that stay until garbage is collected add up over the steps of a query."""
    kept = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = kept()
    docs = spark.range(300).select("id", F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat_ws(" ", (F.col("id") / 5).cast("int"), F.when(i == 1, F.col("id")), i)).alias("tokens"))
    members, pairs = similar.similar_sets(docs, 0.8)
    deadline = time.time() + 10
    while kept() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not kept() - before
    assert members.count() == 300 and pairs.count() == 60 * 10


def test_near_copies_meet_few_times(spark):
    """Sets that agree in most first tokens come as a candidate where their order differs, not once for each token."""
    head = [*range(1, 31)]
    rows = [(g, 150, [x if x != g else 1000 + g for x in head]) for g in range(1, 21)]
    met = similar._met(spark.createDataFrame(rows, "h long, n int, head array<int>"), 0.8)
    assert met.distinct().count() == 190 and met.count() <= 190 * 4


def test_leakage_groups_make_normal_forms_once(spark, tmp_path, monkeypatch):
    """The pass over whole texts is stored before it is joined to itself."""
    plans, store = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or store(df, name))
    texts = [(1, "One two, 30k"), (2, "TWO one 45k ok"), (3, "other"), (4, ""), (5, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = join_queries.leakage_groups(spark, str(tmp_path))
    assert {r.doc_id: r.group for r in found.collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert plans and not any("regexp_replace" in p for p in plans)


def test_first_tokens_in_parts_lose_no_link(spark, monkeypatch):
    """First tokens go to disk a part at a time, and the links are those of one pass, each once."""
    docs = spark.createDataFrame(near_copies(4), "id long, tokens array<string>")
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    whole = [key(df) for df in similar.similar_sets(docs, 0.6)]
    parts, met = [], similar._met
    monkeypatch.setattr(similar, "PART_TOKENS", 100)
    monkeypatch.setattr(similar, "_met", lambda *args: parts.append((args[0].selectExpr("sum(size(head))").first()[0], args[2:])) or met(*args))
    assert [key(df) for df in similar.similar_sets(docs, 0.6)] == whole and whole[1]
    assert [p for _, p in parts] == [(i, similar.PARTS) for i in range(similar.PARTS)]


def test_leakage_groups_read_the_texts_no_more(spark, tmp_path):
    """The groups are stored once: what is made of them reads no texts again, and the steps' tables are gone."""
    texts = [(1, "One two, 30k"), (2, "TWO one 45k ok"), (3, "other"), (4, ""), (5, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = join_queries.leakage_groups(spark, str(tmp_path))
    names = {f.rstrip("/").rsplit("/", 2)[1].rpartition("-")[0] for f in found.inputFiles()}
    assert names == {"groups"} and {r.doc_id: r.group for r in found.collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_whole_sets_are_made_of_chosen_rows_only(spark, monkeypatch):
    """In the exact check, rows that stand in no pair go before their tokens are hashed and sorted."""
    plans, store = {}, similar.materialize
    monkeypatch.setattr(similar, "materialize", lambda df, name: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or store(df, name))
    _, pairs = similar.similar_sets(spark.createDataFrame(near_copies(5), "id long, tokens array<string>"), 0.8)
    told = plans["pairs"]
    assert pairs.count() and told.index("sort_array") < told.rindex("Join Inner")


def test_normal_forms_keep_their_replacements(spark):
    """Commas and full stops become spaces and strokes of d go, without a dictionary for each code point."""
    from inkwell.functions import text as T

    rows = spark.createDataFrame([("Đa, Đ.x,,y.  1.200,5k ĐÀ...",), ("",), (None,)], "x string")
    told = rows.select(T.normalize(F.col("x")).alias("n"))
    assert [r.n for r in told.collect()] == ["da d x y N da", "", None]
    assert told._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
