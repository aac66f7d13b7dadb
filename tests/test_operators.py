import random

import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import graph, sampling, similar
from inkwell.sources import ingest
from inkwell.streaming.gate import admit


def test_normal_forms(spark):
    rows = [("Cho Long mượn 1tr, nhé.", "cho long muon N nhe"), ("Đi  ĂN\tphở 60k", "di an pho N"), ("", ""), (None, None), ("abc 12x", "abc 12x")]
    got = spark.createDataFrame(rows, "x string, want string").select("want", T.normalize(F.col("x")).alias("got")).collect()
    assert [(r.want, r.got) for r in got if r.want != r.got] == []


def test_components_match_flooding(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        if a is None or a == b:
            continue
        ra, rb = root.get(a, a), root.get(b, b)
        for x in {a, b, *root}:
            if root.get(x, x) in (ra, rb):
                root[x] = min(ra, rb)
        root[a] = root[b] = min(ra, rb)
    assert got == {n: r for n, r in root.items() if n != r}


def test_similarity_join_loses_nothing(spark):
    rng = random.Random(4)
    rows = [(i, [f"t{rng.choice([0, 0, 0, rng.randrange(30)])}" for _ in range(rng.randint(0, 12))]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    got = {(r.a, r.b) for r in similar.set_similarity_join(df, df, 0.6).collect()}
    want = {(i, j) for i, a in rows for j, b in rows if a and b and len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.6}
    assert got == want


def test_keep_first_equals_the_sequential_pass(spark):
    rng = random.Random(7)
    pairs = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(40)})
    kept = []
    for i in range(32):
        if not any((k, i) in pairs for k in kept):
            kept.append(i)
    ids = spark.range(32).select(F.col("id"))
    assert sorted(r.id for r in similar.keep_first(ids, spark.createDataFrame(pairs, "a long, b long")).collect()) == kept


def test_pick_diverse_does_not_depend_on_order():
    items = [(str(i), [f"f{i % 3}", f"g{i % 5}"]) for i in range(30)]
    assert sampling.pick_diverse(items, 8, "s") == sampling.pick_diverse(items[::-1], 8, "s")


def test_error_gate():
    got, state = admit([(0, "a"), (0, "a"), (0, "b"), (1, "c"), (2, "d"), (5_002, "e"), (5_003, "f")])
    assert got == [True, False, True, True, False, True, False]
    assert admit([(20_000, "a"), (20_000, "z")], state)[0] == [False, True]


@pytest.mark.parametrize("form", ["auto", "jsonl"])
def test_strict_ingestion(spark, form):
    lines = ['{"text": "one", "id": 5}', '{"text": "one"}', "{bad", "[1]", '{"x": 1}', '{"text": 3}', '{"text": ""}', '{"text": " edge"}', "", '{"text": "café"}']
    df = spark.createDataFrame(list(enumerate(lines, 1)), "line_no int, line string")
    records, issues = ingest.ingest(df, "s", "p", form)
    got = {r.line_no: r for r in records.collect()}
    assert sorted(got) == [1, 2, 10] and got[2].id == got[1].id + "-d2" and got[10].text == "café"
    found = {(r.line_no, r.severity): r.message for r in issues.collect()}
    assert sorted(n for n, s in found if s == "error") == [3, 4, 5, 6, 7, 8]
    assert found[1, "warning"] == "dropped input key id" and found[10, "warning"].startswith("text normalized")


def test_number_words(spark):
    from inkwell.functions import numerals

    english = {"twenty five": 25, "a hundred": 100, "two hundred and five thousand": 205_000, "fiver": 5, "one million two": 1_000_002, "cat": None, "": None, None: None}
    vietnamese = {"hai tram nam muoi": 250, "muoi lam": 15, "mot tram linh nam": 105, "hai tram nam": 250, "bay": 7, "muoi": 10, "tram": 100, "ba muoi": 30, "xe": None, "": None, "nam nam": None, None: None}
    for cases, read in ((english, numerals.english_number), (vietnamese, numerals.vietnamese_number)):
        got = {r.x: r.v for r in spark.createDataFrame([(k,) for k in cases], "x string").select("x", read(F.col("x")).alias("v")).collect()}
        assert got == cases


def test_viterbi_equals_all_paths(spark):
    import itertools

    from inkwell.functions import decode as D

    rng = random.Random(3)
    moves = [[rng.choice([-1.0, 0.0, 0.5]) for _ in range(3)] for _ in range(3)]
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(3 * (i % 6))]) for i in range(40)]
    got = {r.i: r.path for r in spark.createDataFrame(rows, "i int, z array<double>").select("i", D.viterbi(D.rows_of(F.col("z")), moves).alias("path")).collect()}
    for i, z in rows:
        steps = [z[k : k + 3] for k in range(0, len(z), 3)]
        total = lambda path: sum(s[t] for s, t in zip(steps, path, strict=True)) + sum(moves[a][b] for a, b in zip(path[:-1], path[1:], strict=True))  # noqa: E731, B023
        assert len(got[i]) == len(steps)
        if steps:
            assert total(got[i]) == max(map(total, itertools.product(range(3), repeat=len(steps))))


def test_manifest(spark, tmp_path):
    import hashlib

    from inkwell.sources import manifest

    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"one")
    (tmp_path / "sub" / "b.txt").write_bytes(b"two")
    before = spark.createDataFrame(manifest.snapshot(spark, str(tmp_path)).collect(), "file string, sha256 string, bytes long")
    assert {r.file: (r.sha256, r.bytes) for r in before.collect()} == {"a.txt": (hashlib.sha256(b"one").hexdigest(), 3), "sub/b.txt": (hashlib.sha256(b"two").hexdigest(), 3)}
    (tmp_path / "a.txt").write_bytes(b"1ne")
    (tmp_path / "c.txt").write_bytes(b"x")
    (tmp_path / "sub" / "b.txt").unlink()
    assert sorted(map(tuple, manifest.verify(manifest.snapshot(spark, str(tmp_path)), before).collect())) == [("a.txt", "content differs"), ("c.txt", "unexpected"), ("sub/b.txt", "missing")]


@pytest.mark.parametrize("most", [similar.MOST_TOKENS, 0])
def test_documents_that_nearly_copy_an_item_are_found(spark, tmp_path, most, monkeypatch):
    import duckdb
    import pandas as pd

    from inkwell.plans import catalogue

    catalogue.load()
    rng = random.Random(9)
    monkeypatch.setattr(similar.set_similarity_to_items, "__defaults__", (most,))
    items = [" ".join(rng.choices([f"w{i}" for i in range(50)], k=rng.randint(1, 30))) for _ in range(15)] + ["", None, "one two"]
    texts = [" ".join(rng.choices([f"w{i}" for i in range(50)], k=rng.randint(0, 40))) for _ in range(40)] + ["", None, "One\tTWO"]
    for t in items[:15]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts += [t.upper(), " ".join(w), t + " and a few more words", f"{t} " * 2]
    rows = [(None if i % 3 == 0 else i // 2, t) for i, t in enumerate(texts)]
    rows += rows[-5:]
    pd.DataFrame({"doc_id": pd.array([d for d, _ in rows], "Int64"), "text": [t for _, t in rows]}).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame(list(enumerate(items)), columns=["item_id", "text"]).to_parquet(tmp_path / "benchmark.parquet")

    def grams(t):
        w = (t or "").lower().split()
        return {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    want = []
    for d, t in set(rows):
        for i, item in enumerate(items):
            a, b = grams(t), grams(item)
            if a and b and len(a & b) / len(a | b) >= 0.5:
                want.append((d, i, round(len(a & b) / len(a | b), 9)))
    got = [tuple(r) for r in catalogue.QUERIES["leakage_jaccard_documents"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 30
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    assert sorted(con.sql(catalogue.ORACLE["leakage_jaccard_documents"]).fetchall(), key=str) == sorted(want, key=str)


def test_diverse_sample_chooses_among_all_rows(spark):
    rng = random.Random(11)
    rows = [("hot", i, [rng.choice(["en", "fr"]), f"len{rng.randrange(3)}"]) for i in range(1500)]
    by_hash = sorted(rows, key=lambda r: hash_of("s", r[1]))
    for _, i, features in by_hash[-2:]:  # what is rare stands last in hash order, far beyond 500 rows
        features[:] = ["vi", f"len{i % 2 + 7}"]
    rows += [("cold", i, ["en", "len1"]) for i in range(3000, 3003)] + [("cold", None, [None, "len1"])]
    df = spark.createDataFrame(rows, "source string, doc_id long, features array<string>")
    got = {}
    for r in sorted(sampling.diverse_sample(df, "source", "doc_id", "features", 5, "s").collect(), key=lambda r: r.position):
        got.setdefault(r.source, []).append(str(r.doc_id))
    assert got == {s: sampling.pick_diverse([(str(i), f) for t, i, f in rows if t == s], 5, "s") for s in ("hot", "cold")}
    assert {str(i) for _, i, _ in by_hash[-2:]} & set(got["hot"])


def hash_of(seed, key):
    import hashlib

    return hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()


def test_top_matches_in_blocks(spark):
    rng = random.Random(8)
    queries = [(q, rng.randrange(100)) for q in range(23)]
    refs = [(r, rng.randrange(100)) for r in range(60)]
    a, b = spark.createDataFrame(queries, "q long, x long"), spark.createDataFrame(refs, "r long, y long")
    score = -F.abs(F.col("x") - F.col("y"))
    want = {(q, k + 1): r for q, x in queries for k, (r, _) in enumerate(sorted(refs, key=lambda z: (abs(x - z[1]), z[0]))[:3])}  # noqa: B023
    for most in (5, 100):
        assert {(m.q, m["rank"]): m.r for m in similar.top_matches(a, b, 3, "q", "r", score, most).collect()} == want
