import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from inkwell.llm import kneser_ney as kn


def split(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w.decode() for w in lower.encode().split()] + ["</s>"]


def slow_model(texts):
    unigrams, bigrams = Counter(), Counter()
    for t in texts:
        before = "<s>"
        for w in split(t):
            unigrams[w] += 1
            bigrams[before, w] += 1
            before = w
    return unigrams, bigrams


def slow_score(text, unigrams, bigrams):
    def discount(values):
        n = Counter(values)
        if not (n[1] and n[2] and n[3]):
            return [0, 0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        found = [k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3)]
        return [0, *[d if 0 < d <= k else k / 2 for k, d in enumerate(found, 1)]]

    contexts, after = Counter(), defaultdict(list)
    for (c, w), n in bigrams.items():
        contexts[w] += 1
        after[c].append(n)
    d2, d1 = discount(bigrams.values()), discount(contexts.values())
    total, v = len(bigrams), len(unigrams)
    rest = sum(d1[min(n, 3)] for n in contexts.values()) / total
    score, base, before = 0.0, 0.0, "<s>"
    for w in split(text):
        lower = max(contexts[w] - d1[min(contexts[w], 3)], 0) / total + rest / (v + 1)
        seen = sum(after[before]) if before in after else 0
        n = bigrams[before, w]
        p = (max(n - d2[min(n, 3)], 0) + sum(d2[min(x, 3)] for x in after[before]) * lower) / seen if seen else lower
        score += math.log10(p)
        base += math.log10((unigrams[w] + 1) / (sum(unigrams.values()) + v + 1))
        before = w
    return base, score


def test_matches_slow_model(spark):
    rng = random.Random(8)
    vocabulary = ["a", "B", "the", "longer-than-eight-bytes", "ÄÖ", "ä", "漢字", "x" * 40] + [f"w{i}" for i in range(60)]
    texts = [rng.choice([" ", "\n\t"]).join(rng.choices(vocabulary, k=rng.randint(0, 40))) for _ in range(120)] + [None, "", " ", "unseen words here"]
    docs = spark.createDataFrame([(i, t, 1.0, "z") for i, t in enumerate(texts)], "doc_id long, text string, score double, h string")
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    unigrams, bigrams = slow_model([t for i, t in enumerate(texts) if not held[i]])
    model = kn.train(docs)
    assert (model.n, model.v, model.distinct) == (sum(unigrams.values()), len(unigrams), len(bigrams))
    for r in kn.score(docs, model).collect():
        base, score = slow_score(texts[r.doc_id], unigrams, bigrams)
        assert r.held_out == held[r.doc_id] and r.n_tokens == len(split(texts[r.doc_id]))
        assert r.n_known == sum(w in unigrams for w in split(texts[r.doc_id]))
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a b c", "b c a d", "a a b e f g h"])], "doc_id long, text string")
    model = kn.train(docs)
    import numpy as np

    from inkwell.llm import bytewords

    words = ["a", "b", "c", "d", "e", "f", "g", "h"]
    buffer = np.frombuffer("".join(words).encode() + bytes(16), np.uint8)
    h = np.concatenate((bytewords.hash_slices(buffer, np.arange(8), np.ones(8, np.int64)), [kn.END]))
    told = h[model.words(np.sort(h))[0][np.argsort(np.argsort(h))] > 0]
    for context in (h[0], h[1], kn.START):
        p = 10 ** model.logs(told, np.full(len(told), context))[0]
        unknown = 10 ** model.logs(np.array([np.uint64(12345)]), np.array([context]))[0]
        assert p.sum() + unknown[0] == pytest.approx(1)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert kn.score(docs, kn.train(docs)).count() == 0


def slow_order(texts, order):
    """Adjusted counts of the n-grams of 2 to ``order`` words: in how many contexts they occur; at the full order and at a document's
    start how often."""
    raw = [Counter() for _ in range(order + 1)]
    for t in texts:
        marked = ["<s>", *split(t)]
        for k in range(2, order + 1):
            raw[k].update(tuple(marked[i : i + k]) for i in range(len(marked) - k + 1))
    found = {order: raw[order]}
    for k in range(order - 1, 1, -1):
        left = Counter(g[1:] for g in raw[k + 1])
        found[k] = {g: n if g[0] == "<s>" else left[g] for g, n in raw[k].items()}
    return found


def slow_probability(history, word, counts, v):
    """Of ``word`` after the tuple ``history``, by the textbook's recursion."""
    def discount(values):
        n = Counter(values)
        if not (n[1] and n[2] and n[3]):
            return [0, 0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        found = [k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3)]
        return [0, *[d if 0 < d <= k else k / 2 for k, d in enumerate(found, 1)]]

    if not history:
        contexts = Counter(w for _, w in counts[2])
        d = discount(contexts.values())
        n = contexts[word]
        return max(n - d[min(n, 3)], 0) / len(counts[2]) + sum(d[min(x, 3)] for x in contexts.values()) / len(counts[2]) / (v + 1)
    table = counts[len(history) + 1]
    d = discount(table.values())
    after = [n for g, n in table.items() if g[:-1] == history]
    lower = slow_probability(history[1:], word, counts, v)
    if not after:
        return lower
    n = table.get((*history, word), 0)
    return (max(n - d[min(n, 3)], 0) + sum(d[min(x, 3)] for x in after) * lower) / sum(after)


@pytest.mark.parametrize("order", [2, 3, 4, 12])
def test_any_order_matches_the_textbook(spark, order):
    rng = random.Random(order)
    vocabulary = ["a", "B", "longer-than-eight-bytes", "ä"] + [f"w{i}" for i in range(8)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 12))) for _ in range(50)] + [None, "", "a", "a b", "w1 never-seen w2 w3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    learned = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    counts, v = slow_order(learned, order), len({w for t in learned for w in split(t)})
    for r in kn.score(docs, kn.train(docs, order)).collect():
        marked = ["<s>", *split(texts[r.doc_id])]
        want = sum(math.log10(slow_probability(tuple(marked[max(0, i - order + 1) : i]), marked[i], counts, v)) for i in range(1, len(marked)))
        assert r.score == pytest.approx(want)


def test_the_registered_model_looks_beyond_the_previous_word():
    assert kn.ORDER >= 3


def test_tables_find_what_was_packed():
    import numpy as np

    rng = np.random.default_rng(3)
    keys = np.unique(np.concatenate((rng.integers(0, 1 << 48, 500), np.arange(40) + (7 << 16), [0, (1 << 48) - 1])).astype(np.uint64))
    columns = [rng.integers(0, 300, len(keys)), rng.integers(0, 1 << 40, len(keys))]
    tables = [kn.Table(np.frombuffer(kn.Table.pack(keys, 16, columns, bits), np.uint8)) for bits in (4, 8)]
    asked = np.unique(np.concatenate((keys, rng.integers(0, 1 << 48, 500).astype(np.uint64), keys[:-1] + np.uint64(1))))
    known = {k: v for k, *v in zip(keys.tolist(), *[c.tolist() for c in columns], strict=True)}
    assert all(table.find(asked).T.tolist() == [known.get(k, [0, 0]) for k in asked.tolist()] for table in tables)
    empty = kn.Table(np.frombuffer(kn.Table.pack(keys[:0], 16, [keys[:0]]), np.uint8))
    assert empty.find(asked).tolist() == [[0] * len(asked)]


def test_grams_survive_packing():
    import numpy as np

    rng = np.random.default_rng(4)
    words = np.unique(rng.integers(0, 1 << 48, 60).astype(np.uint64))
    parts, want = [], []
    for _ in range(2):
        grams = np.unique(rng.integers(0, 50, (3, 900)), axis=1)
        n = rng.integers(1, 1 << 31, grams.shape[1])
        parts.append(kn._pack_grams(list(grams), words, n))
        want += zip(*words[grams].tolist(), n.tolist(), strict=True)
    every, columns, counts = kn._unpack_grams(parts)
    assert sorted(zip(*[every[c].tolist() for c in columns], counts.tolist(), strict=True)) == sorted(want)


def test_repeated_rows_null_ids_and_long_texts(spark):
    long = "a b " * 300_000
    x, y, z = [i for i in range(1, 20) if zlib.crc32(str(i).encode()) % 7 != 2][:3]
    rows = [(x, "a b c"), (x, "a b c"), (None, "a b c"), (y, long), (z, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.held_out, r.n_tokens, r.train_tokens, round(r.score, 6)) for r in kn.score(docs, kn.train(docs, 3)).collect()))
    assert [x[:4] for x in got] == [
        (0, True, 4, 600_010), (x, False, 4, 600_010), (x, False, 4, 600_010), (y, False, 600_001, 600_010), (z, False, 1, 600_010)]
    assert got[0][4] == got[1][4] == got[2][4]


def test_files_of_a_store_without_paths_are_mapped_from_a_copy(spark, tmp_path, monkeypatch):
    from inkwell.llm import bytewords

    (tmp_path / "f").write_bytes(b"some bytes")
    monkeypatch.setattr(bytewords, "local_path", lambda url: None)
    for _ in range(2):
        assert bytes(bytewords.mapped(f"file://{tmp_path}/f")) == b"some bytes"
