import pandas as pd

import corpus_pipeline
from inkwell.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_effect(spark, tmp_path):
    item = " ".join(f"bench{i}" for i in range(20))
    texts = {i: " ".join(f"w{i}x{k}" for k in range(30)) for i in range(60)}
    for i in range(0, 60, 6):
        texts[i] += " idiot"
    texts[1] = texts[2]
    texts[3] += " " + item
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in texts.items()], DOCS)
    tables = {"labels": pd.DataFrame([(i, 1, int("idiot" in t)) for i, t in texts.items()], columns=["doc_id", "quality", "toxic"]),
              "benchmark": pd.DataFrame([(1, item)], columns=["item_id", "text"])}
    for name, rows in tables.items():
        rows.to_parquet(tmp_path / f"{name}.parquet")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        seen.append(sorted(r.doc_id for r in now.select("doc_id").collect()))
    toxic, single, clean, mixed = seen
    assert toxic == [i for i in range(60) if i % 6]
    assert single == [i for i in toxic if i != 2] and clean == [i for i in single if i != 3]
    counts = mixing.mixed_counts(docs.where(docs.doc_id.isin(clean))).collect()
    assert mixed == sorted(r.doc_id for r in counts for _ in range(r.copies))
    last = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in last) == mixed and sum(r.start == 0 for r in last) == 1


def written(spark, tmp_path, rows, labels=(), items=()):
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_run_matches_a_slow_pipeline(spark, tmp_path):
    """Rules by brute force on a corpus whose cases are planted: near copies by all pairs, benchmark items by whole windows."""
    from tokenizers import Tokenizer

    from inkwell.llm.encoder import vocabulary_path
    from tests.llm.test_simhash import slow_components, slow_fingerprint

    item = " ".join(f"bench{i}" for i in range(20))
    texts = {i: " ".join(f"w{i}x{k}" for k in range(40)) for i in range(80)}
    for i in range(0, 80, 8):
        texts[i] += " moron"
    texts |= {81: texts[3], 82: texts[3].upper(), 83: f"x {item} y", 84: "", 85: None, 86: " \n", 87: "é ü 漢字 " * 30}
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 2}", 0) for i, t in texts.items()] + [(5, texts[5], "en", "s1", 0)] * 2
    rows += [(90, "", "en", "empty texts alone", 0)]
    sf = written(spark, tmp_path, rows, [(i, 1, int("moron" in (t or ""))) for i, t in texts.items()], [(1, item), (2, None)])
    got = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        got.setdefault(r.doc_id, []).append(r)
    kept = {i: t for i, t in texts.items() if "moron" not in (t or "")}
    roots = slow_components({i: slow_fingerprint(t) for i, t in kept.items()})
    kept = {i: t for i, t in kept.items() if roots[i] == i and item not in (t or "")}
    docs = spark.createDataFrame([(i, t, "en", None if i % 7 == 0 else f"s{i % 2}", 0) for i, t in kept.items()], DOCS)
    copies = {r.doc_id: r.copies if r["size"] else 1 for r in mixing.mixed_counts(docs).collect()}
    assert {i: len(x) for i, x in got.items()} == {i: n for i, n in copies.items() if n}
    assert 84 in got and not {81, 82, 83, 85, 86, 90} & got.keys()  # of the texts without words that with the least id
    tokenizer = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    for i, x in got.items():
        assert {r.n_tokens for r in x} == {len(tokenizer.encode(texts[i] or "", add_special_tokens=False).ids) + 1}
    places = sorted((r.start, r.n_tokens) for x in got.values() for r in x)
    assert [a for a, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]


def test_run_over_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, [])).count() == 0


def test_run_over_empty_texts_alone(spark, tmp_path):
    sf = written(spark, tmp_path, [(1, None, None, None, None), (2, "", "en", "s", 0), (None, None, None, "s", 0)])
    assert [(r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, sf).collect()] == [(1, 1)]
