import random

import pytest
import xxhash
from pyspark.sql import functions as F

from inkwell.llm import simhash


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ")
             .replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    """doc -> least doc reachable, by flooding over all pairs."""
    docs, root = sorted(fps), {}
    for d in docs:
        if d in root:
            continue
        todo, root[d] = [d], d
        while todo:
            x = todo.pop()
            for y in docs:
                if y not in root and bin(fps[x] ^ fps[y]).count("1") <= 3:
                    root[y] = d
                    todo.append(y)
    return root


def test_patterns_cover_every_difference():
    ways = simhash.patterns()
    assert len(ways) == 24 and all(bin(m).count("1") == 32 for _, m in ways)
    rng = random.Random(5)
    for _ in range(20000):
        x = 0
        for b in rng.sample(range(64), rng.randint(0, 3)):
            x |= 1 << b
        assert any(x & m == 0 for _, m in ways)


def test_links_match_brute_force(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:80]:
        for _ in range(3):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 4)):
                g ^= 1 << b
            fps.add(g)
    signed = [(f - (1 << 64) if f >= 1 << 63 else f,) for f in fps]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame(signed, "fp long")).collect()}
    want = {
        (a, b) for (a,) in signed for (b,) in signed
        if a < b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3
    }
    assert got == want and len(want) > 200


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(40)]
    for t in list(texts):
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts += [t, " ".join(w), t.upper()]
    texts += [None, "", " \n\t", "Ä", "a b", "x " * 5000, "é z", "lone"]
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    want = {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    assert {d: f for d, (f, _) in got.items()} == want
    assert {d: c for d, (_, c) in got.items()} == slow_components(want)


def test_drop_keeps_one_of_each(spark):
    rows = [(3, "one two three four"), (1, "One two three four"), (2, "other words stand here"), (2, "other words stand here"), (9, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__row", F.lit(7)).withColumn("__TH", F.lit("x")).withColumn("__keep", F.lit(1))
    got = simhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r["__row"]) for r in got.collect()) == [(1, 7), (2, 7), (8, 7)]


@pytest.mark.parametrize("rows", [[], [(None, "a b c d"), (None, "a b c d")]])
def test_empty_table_and_null_ids(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows) and all(r.component_id is None for r in got)


def test_drop_tells_rows_apart_without_ids(spark):
    lone = [f"text {i} " + " ".join(f"w{i}x{k}" for k in range(20)) for i in range(6)]
    rows = [(None, t) for t in lone] + [(None, lone[0])]  # null ids: every distinct text stays
    shared = [" ".join(f"{name}{k}" for k in range(20)) for name in "abc"]
    rows += [(5, shared[0]), (5, shared[1]), (7, shared[1]), (5, shared[2]), (4, lone[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in simhash.drop_near_duplicates(docs).collect()), key=str)
    want = [(None, t) for i, t in enumerate(lone) if i != 1] + [(4, lone[1])] + [(5, t) for t in shared]
    assert got == sorted(want, key=str)


def test_only_the_named_rows_stay(spark):
    rows = spark.range(5000).repartition(7).withColumn("n", F.monotonically_increasing_id())
    stored = simhash.materialize(rows, "test")
    kept = stored.where("id % 3 = 0 or id > 4990").select("n")
    assert sorted(r.id for r in simhash.only_rows(stored, "n", kept).collect()) == [i for i in range(5000) if i % 3 == 0 or i > 4990]
    assert simhash.only_rows(stored, "n", kept.limit(0)).count() == 0
