import math
import random
import unicodedata
import zlib
from collections import Counter

import pytest

from inkwell.llm import langid


def rows(n=160):
    rng = random.Random(3)
    parts = {"en": "the and ing tion er", "de": "der sch ung ein keit", "el": "και του στη αν"}
    out = []
    for i in range(n):
        lang = rng.choice(list(parts))
        words = ["".join(rng.choices(parts[lang].split(), k=2)) for _ in range(rng.randint(1, 30))]
        out.append((i, " ".join(words), lang if i % 11 else None, "n"))
    return out


def test_held_out_accuracy_and_defined_cases(spark):
    given = rows() + [(1000, None, "en", ""), (1001, "", "en", ""), (1002, "123 -- !", "de", ""), (None, "the tion", "en", ""), (1004, "schung " * 200_000, None, "")]
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string, lang_pred string")
    model = langid.train(docs)
    assert model[0] == ["de", "el", "en"]
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    right = [got[i].lang_pred == lang for i, _, lang, _ in rows() if lang and got[i].held_out]
    assert len(right) > 30 and sum(right) / len(right) > 0.95
    for i, _, _, _ in rows():
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i].score <= 1
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1004].lang_pred == "de"
    assert got[None].held_out


def slow_grams(text):
    joined = "".join(w + " " for w in "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower()).split(" ") if w)
    return Counter(joined[i : i + n] for n in langid.ORDERS for i in range(len(joined) - n + 1))


def slow_bucket(gram):
    h = 0
    for c in gram:
        h = (h * 0x100000001B3 & (1 << 64) - 1) ^ ord(c)
    x = (h + len(gram)) & (1 << 64) - 1
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ x >> shift) * factor & (1 << 64) - 1
    return x % langid.BUCKETS


def slow_buckets(text):
    found = Counter()
    for gram, n in slow_grams(text).items():
        found[slow_bucket(gram)] += n
    return found


@pytest.mark.parametrize("size", [langid._SLICE, 16, 5])
def test_matches_slow_counts(size, monkeypatch):
    monkeypatch.setattr(langid, "_SLICE", size)
    texts = ["Ab, c", "", "x", "ÄÖ ü1ü", "a long text of more words, than 16 characters -- hold... yes", "123", "nospaceswithinthisverylongwordatall" * 3]
    got = [Counter() for _ in texts]
    for bucket, owner, _ in langid.grams(texts):
        for b, i in zip(bucket.tolist(), owner.tolist(), strict=True):
            got[i][b] += 1
    assert got == [slow_buckets(t) for t in texts]


def test_predictions_match_the_slow_posterior(spark):
    given = rows(90) + [(500, "der the και", None, ""), (500, "der the και", None, ""), (501, "x", "en", "")]
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string, lang_pred string")
    counts, docs_of = {}, Counter()
    for i, text, lang, _ in given:
        if lang and zlib.crc32(str(i).encode()) % 3 != 1:
            counts.setdefault(lang, Counter()).update(slow_buckets(text))
            docs_of[lang] += 1
    total = sum(docs_of.values())
    want = []
    for i, text, _, _ in given:
        found = slow_buckets(text)
        logs = {}
        for lang, c in counts.items():
            size = sum(c.values()) + langid.SMOOTHING * langid.BUCKETS
            logs[lang] = sum(n * math.log((c[b] + langid.SMOOTHING) / size) for b, n in found.items())
        prior = {lang: math.log(n / total) for lang, n in docs_of.items()}
        best = max(sorted(logs), key=lambda x: logs[x] + prior[x])
        spread = {lang: math.exp((logs[lang] - logs[best]) / math.sqrt(sum(found.values())) + prior[lang] - prior[best]) for lang in logs}
        want.append((i, best, round(spread[best] / sum(spread.values()), 4)))
    got = [(r.doc_id, r.lang_pred, round(r.score, 4)) for r in langid.predict(docs, langid.train(docs)).collect()]
    assert sorted(got) == sorted(want)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.predict(docs, langid.train(docs)).count() == 0


def test_too_many_languages_are_an_error(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "some words", f"l{i % 3}") for i in range(30)], "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    assert langid.train(docs)[0] == ["l0", "l1", "l2"]
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2 languages"):
        langid.train(docs)
