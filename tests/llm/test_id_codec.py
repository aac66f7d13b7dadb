import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from inkwell.llm import id_codec
from inkwell.llm.encoder import Encoder, vocabulary_path

PATH = vocabulary_path(id_codec.VOCABULARY)
TEXTS = [
    "", " ", "Hello world", "it's we'll they've I'm 'tis ''ll", "tabs\t\tand\n\n  lines  ", "naïve café — 漢字 😀", "a" * 3000,
    "x<|endoftext|>y", "<|endoftext|>", "12345 67,89.0 % $$$ ### !!", " nbsp　wide sep", "é" * 50, "\r\n\r\n x",
]


def library(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoder_equals_the_library():
    rng = random.Random(1)
    alphabet = "abcdef 'strvml.,!\n\t é漢1٣—"
    texts = TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(0, 80))) for _ in range(1500)]
    mine = Encoder(PATH)
    for part in (texts[:700], texts[700:], texts):
        ids, counts = mine.encode([t.encode() for t in part])
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == library(part)


@pytest.mark.parametrize("values", [[], [0], [255, 256, 65535, 65536, 2**24, 2**32 - 1, 1], list(range(70000))])
def test_pack_and_unpack(values):
    given = np.array(values, np.uint32)
    assert (unpacked := id_codec.unpack(*id_codec.pack(given), len(given))).tolist() == values and unpacked.dtype == np.uint32


def test_round_trip_matches_brute_force(spark):
    rows = [(i * 7 % 101, TEXTS[i % len(TEXTS)] + str(i), "s") for i in range(60)] + [(500, None, "s"), (3, TEXTS[2], "s"), (3, TEXTS[2], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    got = sorted(id_codec.round_trip(docs, PATH).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(r[0] for r in rows)
    want, start = {}, 0
    for (d, t, _), ids in zip(rows, library([r[1] for r in rows]), strict=True):
        data = np.array([*ids, 0], "<u4")
        want.setdefault(d, []).append((len(data), zlib.crc32(data.tobytes())))
    for r in got:
        assert r.start == start
        start += r.n_tokens
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
    assert not any(want.values())


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "b"), (4, "a")], "doc_id long, text string")
    got = sorted(id_codec.round_trip(docs, PATH).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 4]
    assert id_codec.round_trip(docs.limit(0), PATH).count() == 0
