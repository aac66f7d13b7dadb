import random

from tokenizers import Tokenizer

from inkwell.llm import token_counts as token_counts_module
from inkwell.llm.encoder import vocabulary_path
from inkwell.llm.token_counts import Transducer, token_counts

PATH = vocabulary_path("byte_bpe_50k.json")
TEXTS = ["", " ", "Hello world", "it's 'll they've", "a" * 700, "x<|endoftext|>y<|endoftext|>", "naïve 漢字 😀\r\n\t x", "thethethere aininging " * 50, "=====----====" * 30]


def library(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_equals_the_library():
    rng = random.Random(2)
    parts = ["th", "er", "ing", "e", "s", "tion", "an", " ", "  ", "'s", "1", "23", "!", "é", "漢", "\n", "X", "ou", "zz"]
    texts = TEXTS + ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(1500)]
    machine = Transducer(PATH)
    for part in (texts[:800], texts[800:], texts[:800]):
        assert machine.count_texts([t.encode() for t in part]).tolist() == library(part)


def test_long_pretokens_are_counted_in_chunks():
    rng = random.Random(6)
    parts = ["th", "er", "ing", "e", "s", "tion", "an", "q", "zz", "é", "tttt", "aaaaaaaa"]
    texts = ["a" * 4097, "ab" * 5000, "=" * 9999, "".join(rng.choices(parts, k=9000)), "x" + "".join(rng.choices("acgt", k=1 << 20)), "-" * 3000 + "word " + "é" * 2500]
    machine = Transducer(PATH)
    assert machine.count_texts([t.encode() for t in texts]).tolist() == library(texts)


def test_states_are_dropped_beyond_the_bound(monkeypatch):
    machine = Transducer(PATH)
    texts = ["".join(random.Random(i).choices("abcdefgh ", k=400)) for i in range(60)]
    monkeypatch.setattr(token_counts_module, "MOST_BYTES", 1 << 20)
    got = []
    for t in texts:
        got += machine.count_texts([t.encode()]).tolist()
    assert got == library(texts) and machine.held < 4 << 20


def test_rows(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(90, None, 1), (2, TEXTS[2], 1), (None, "w " * 3000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, PATH).collect())
    assert got == sorted((str(d), len((t or "").encode()), n, n > 1024) for (d, t, _), n in zip(rows, library([t or "" for _, t, _ in rows]), strict=True))
    assert token_counts(docs.limit(0), PATH).count() == 0
