import random
import re
from collections import Counter

from inkwell.llm import line_quality


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_base_measures_match_brute_force(spark):
    rng = random.Random(6)
    texts = [None, "", " \n ", "one", "a b c d e a b c d e", "a " * 3000, "x\ny\nx\n \n \nx", "# * a|b <c> é漢\x0b\x0cz"]
    for _ in range(150):
        texts.append(rng.choice([" ", "\n", "\t "]).join(rng.choices("abcdefgh", k=rng.randint(0, 200))))
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, kept string, n_words int")
    for r in line_quality.measure(docs).collect():
        want = slow(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_lines(spark):
    good = "This plain sentence has quite enough different words to stay here."
    other = "Another line says something else with its own choice of terms."
    bad = ["Home | About | News | Contact.", "no end of sentence", "All rights reserved.", "Of%%% athe*** the&&& thing."]
    docs = spark.createDataFrame(
        [(1, "\n".join([good, *bad[:1], "", other])), (2, "\n".join([*bad, *bad])), (3, good), (3, good)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_quality.measure(docs).collect()}
    assert got[1].kept and got[1].cleaned == f"{good}\n\n{other}" and got[1].lost_words == 7
    assert not got[2].kept and got[2].cleaned == ""
    cleaned = line_quality.clean(docs)
    assert cleaned.columns == docs.columns and sorted(r.doc_id for r in cleaned.collect()) == [1, 3, 3]
    assert line_quality.measure(docs.limit(0)).count() == 0


def test_clean_keeps_columns_of_any_name(spark):
    text = "This is a whole sentence of many plain words, and it ends like one.\nfoot | nav | bar | x"
    rows = [(1, text, "c", 5, True), (2, None, "c", 5, True), (3, "short.", "c", 5, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cleaned string, n_words int, kept boolean")
    got = line_quality.clean(docs)
    assert got.columns == docs.columns
    assert [tuple(r) for r in got.collect()] == [(1, text.split("\n")[0], "c", 5, True)]
    assert line_quality.clean(docs.limit(0)).count() == 0
