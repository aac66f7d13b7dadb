import json

from pyspark.sql import functions as F

from inkwell.operators import vocabulary as V


def written(path):
    alphabet = V.byte_alphabet()
    vocab = {c: i for i, c in enumerate(alphabet)}
    merges = [("t", "h"), ("th", "e"), ("Ġ", "the"), ("a", "n"), ("an", "d"), ("Ã", "©")]
    for a, b in merges:
        vocab[a + b] = len(vocab)
    vocab["<end>"] = len(vocab)
    path.write_text(json.dumps({"added_tokens": [{"content": "<end>"}], "model": {"vocab": vocab, "merges": [f"{a} {b}" for a, b in merges]}}))
    return vocab, merges


def test_tables_closure_and_pruning(spark, tmp_path):
    vocab, merges = written(tmp_path / "v.json")
    tokens, pairs = V.load(spark, str(tmp_path / "v.json"))
    assert tokens.count() == len(vocab) and [(r.rank, r.made) for r in pairs.orderBy("rank").collect()] == [(i, vocab[a + b]) for i, (a, b) in enumerate(merges)]
    kept = V.closure(spark.createDataFrame([(vocab["Ġthe"],), (vocab["x"],)], "id long"), pairs)
    assert {r.id for r in kept.collect()} == {vocab[t] for t in ("Ġthe", "Ġ", "the", "th", "e", "t", "h", "x")}
    named, whole = V.prune(tokens, pairs, kept)
    got = sorted((r.new_id, r.id) for r in named.collect())
    assert [n for n, _ in got] == list(range(8)) and [i for _, i in got] == sorted(r.id for r in kept.collect())
    assert sorted((r.new_rank, r["rank"]) for r in whole.collect()) == [(0, 0), (1, 1), (2, 2)]


def test_token_texts_and_categories(spark, tmp_path):
    vocab, _ = written(tmp_path / "v.json")
    tokens, _ = V.load(spark, str(tmp_path / "v.json"))
    base = F.length("token") == 1
    rows = tokens.select("token", V.token_text(F.col("token")).alias("text"), V.token_hex(F.col("token")).alias("hex"), V.category(V.token_text(F.col("token")), F.col("special"), base).alias("kind"))
    got = {r.token: (r.text, r.hex, r.kind) for r in rows.collect()}
    assert got["Ġthe"] == (" the", "20746865", "ascii_letters") and got["Ã©"] == ("é", "C3A9", "marked_latin")
    assert got["Ã"][2] == "base_byte" and got["<end>"][2] == "special" and got["Ã"][:2] == (None, "C3")


def test_greedy_pieces(spark):
    pieces = frozenset(["un", "##aff", "##able", "##a", "##ble", "play", "##ing"])
    df = spark.createDataFrame([("unaffable",), ("playing",), ("xyz",), ("un" * 60,), ("",), (None,)], "w string")
    got = [r.p for r in df.select(V.greedy_pieces(F.col("w"), pieces).alias("p")).collect()]
    assert got == [["un", "##aff", "##able"], ["play", "##ing"], ["[UNK]"], ["[UNK]"], [], None]
