import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from inkwell.operators import selection, sequences
from inkwell.sources import files


def test_strata_selection_equals_the_sequential_one(spark):
    rng = random.Random(2)
    rows = [(i, rng.sample(["a", "b", "c", "d"], rng.randint(0, 3)), rng.randrange(5), f"{rng.getrandbits(30):08x}") for i in range(80)]
    targets = {"a": 6, "b": 9, "c": 3, "none": 2}
    ranked = sorted(rows, key=lambda r: (-r[2], r[3]))
    members = {s: [r for r in ranked if s in r[1]] for s in targets}
    want = {}
    for s in sorted(targets, key=lambda s: (len(members[s]), s)):
        for r in members[s]:
            if sum(s in w[1] for w in want.values()) >= targets[s]:
                break
            want.setdefault(r[0], r)
    for r in ranked:
        if len(want) < 25:
            want.setdefault(r[0], r)
    df = spark.createDataFrame(rows, "id long, strata array<string>, score int, h string")
    got = selection.by_strata(df, "strata", targets, 25, [F.col("score").desc(), "h"], "id")
    assert {r.id for r in got.collect()} == set(want)


def test_rules_report_what_falls_short(spark):
    df = spark.createDataFrame([(1, "x", "t"), (2, "x", "t"), (3, "y", "u")], "id long, k string, template string")
    chosen, short = selection.by_rules(df, [("x", F.col("k") == "x", 2), ("any", F.lit(True), 2)], ["id"], "id", "template")
    assert sorted((r.id, r.rule) for r in chosen.collect()) == [(1, "x"), (3, "any")] and short == [{"rule": "x", "quota": 2, "have": 1}]


def test_coverage_equals_the_sequential_repair(spark):
    for seed in range(4):
        rng = random.Random(seed)
        groups = {g: (rng.randint(1, 5), rng.choices(["train", "validation", "test"], [8, 1, 1])[0], set(rng.sample(["a", "b", "c", "d", "e"], rng.randint(1, 2)))) for g in range(14)}
        split = {g: s for g, (_, s, _) in groups.items()}
        count = Counter(k for _, _, kinds in groups.values() for k in kinds)
        for kind in sorted(k for k, n in count.items() if n >= 3):
            holders = [g for g, (_, _, kinds) in groups.items() if kind in kinds]
            for target, other in (("validation", "test"), ("test", "validation")):
                if any(split[g] == target for g in holders):
                    continue
                for donor in ("train", other):
                    found = [g for g in holders if split[g] == donor]
                    if len(found) >= 2:
                        split[min(found, key=lambda g: (groups[g][0], g))] = target
                        break
        df = spark.createDataFrame([(g, n, s) for g, (n, s, _) in groups.items()], "group long, n long, split string")
        kinds = spark.createDataFrame([(g, k) for g, (_, _, ks) in groups.items() for k in ks], "group long, kind string")
        assert {r.group: r.split for r in selection.ensure_coverage(df, kinds).collect()} == split


def test_first_rules_equal_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "eps", "zeta 7"], k=rng.randint(3, 9))) for _ in range(12)]
    refs = base + [t.upper() for t in base[:3]] + [t.replace("7", "8") for t in base] + [t[:-2] + "xx" for t in base] + [" ".join(reversed(t.split())) for t in base] + ["", None, "é beta gamma"]
    queries = base[:8] + ["e beta gamma", "nothing like it"]

    def fold(t):
        import re
        import unicodedata

        return re.sub(r"\d", "#", "".join(c for c in unicodedata.normalize("NFD", t.lower()) if unicodedata.category(c) != "Mn"))

    def tokens(t):
        import re

        return set(re.findall(r"[^\W\d_]{2,}", t))

    def char3(t):
        t = f" {t} "
        return {t[i : i + 3] for i in range(max(1, len(t) - 2))}

    jaccard = lambda x, y: len(x & y) / len(x | y) if x | y else 0.0
    want = {}
    for q, a in enumerate(queries):
        for r, b in enumerate(refs):
            if b is None:
                continue
            fa, fb = fold(a), fold(b)
            if a.strip().lower() == b.strip().lower():
                want[q, r] = "exact"
            elif fa == fb:
                want[q, r] = "folded"
            elif SequenceMatcher(None, fa, fb).ratio() >= 0.9:
                want[q, r] = "sequence"
            elif min(len(tokens(fa)), len(tokens(fb))) >= 3 and jaccard(tokens(fa), tokens(fb)) >= 0.8:
                want[q, r] = "token"
            elif jaccard(char3(fa), char3(fb)) >= 0.8:
                want[q, r] = "char3"
    got = sequences.first_rules(spark.createDataFrame(list(enumerate(queries)), "q long, text string"), spark.createDataFrame(list(enumerate(refs)), "r long, text string"))
    assert {(x.q, x.r): x.rule for x in got.collect()} == want and set(want.values()) >= {"exact", "folded", "sequence", "token"}


def test_files(spark, tmp_path):
    for name, rows in {"a/x.jsonl": ['{"id": "1", "text": "é"}', '{"id": "2", "text": "b"}'], "b/y.jsonl": ['{"id": "3", "text": "b"}', '{"id": "4", "text": "held"}'], "probe/z.jsonl": ['{"id": "5", "text": "no"}']}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("\n".join(rows))
    held = spark.createDataFrame([("4",)], "id string")
    got = files.reference_texts(spark, str(tmp_path), ["probe"], held).collect()
    assert sorted((r.text, r.path.rsplit("/", 2)[1]) for r in got) == [("b", "a"), ("é", "a")]
    assert files.archive({"b": b"2", "a": b"1"}, "r") == files.archive({"a": b"1", "b": b"2"}, "r")
    path = str(tmp_path / "out")
    assert files.write_atomic(path, b"x") == files.write_atomic(path, b"x", overwrite=True)
    with pytest.raises(FileExistsError):
        files.write_atomic(path, b"y")
    cache = str(tmp_path / "cache")
    manifest = files.write_cache(spark.createDataFrame([(1, [0.5])], "id long, z array<double>"), cache, "id")
    assert files.load_cache(spark, cache, manifest, "id").count() == 1
    with pytest.raises(ValueError, match="manifest"):
        files.load_cache(spark, cache, manifest | {"rows": 2}, "id")
    (tmp_path / "rules.json").write_text('{"types": ["x"], "statuses": ["complete"], "spans": {"target": {"null_for_types": ["x"]}}}')
    assert files.load_rules(str(tmp_path / "rules.json")).null_target_types == ("x",) and files.has_spans(str(tmp_path / "rules.json"))
    issues = spark.createDataFrame([(3, "error", "bad"), (1, "warning", "odd")], "line long, severity string, message string")
    assert files.report(issues, 1) == "1 errors, 1 warnings\n  line 1: warning: odd\n  and 1 more"
    assert files.markdown(issues.orderBy("line")).splitlines()[2] == "| 1 | warning | odd |"
    lines = spark.createDataFrame([('{"a": 1},',), ("{",), ("x",), ("",), (None,)], "line string")
    assert [r.a for r in files.permissive_jsonl(lines, "a long").collect()] == [1]


def test_split_equals_the_sequential_deal(spark):
    from inkwell.operators import splits

    rng = random.Random(9)
    rows = []
    for g in range(300):
        kind = rng.choice(["a", "a", "a", "b", None])
        rows += [(g, kind)] * rng.choice([1, 1, 1, 2, 2, 3, 5, 40])
    got = splits.leakage_safe_split(spark.createDataFrame(rows, "g long, kind string"), "g", "kind", "s").collect()
    sizes = Counter(g for g, _ in rows)
    kinds = {g: k or "" for g, k in rows}
    want = {}
    for kind in ("a", "b", ""):
        want |= splits.deal([(g, n) for g, n in sizes.items() if kinds[g] == kind], "s")
    assert {r.g: r.split for r in got} == want and {r.g: r.n for r in got} == sizes
    assert splits.leakage_safe_split(spark.createDataFrame([], "g long, kind string"), "g", "kind", "s").count() == 0
