"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, runs of characters other than letters become one space, and every 1- to 4-gram of characters
falls into one of ``BUCKETS`` hash buckets. Training counts buckets by language on the executors, over a
sample of documented size for each language; the smoothed log-probability matrix (buckets x languages, 32-bit floats,
256 KB for each language) is broadcast. A batch is scored sparsely: the rows of the matrix that its n-grams name
are gathered and summed by text, so memory depends on the slice of text at hand and not on the buckets. Long texts are cut
into slices that hand on their last characters, so no n-gram is lost.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from inkwell.llm.bytewords import lean, mix
from inkwell.llm.native_text import broadcast_if_small

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
SMOOTHING = 0.5
UNKNOWN = "und"
#: About so many training documents of each language are counted; a hash of doc_id chooses them.
SAMPLE_PER_LANGUAGE = 20_000
#: Languages that one model may hold (more raise an error): the bound of the broadcast matrix, 64 MB.
MOST_LANGUAGES = 256
_SLICE = 1 << 19
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def _normal(text: str, after_letter: bool) -> np.ndarray:
    """Code points of the lower-cased text with one space for each run of other characters that follows a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[np.minimum(codes, 0x10FFFF)]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:1] |= after_letter
    return np.where(letter, codes, 32)[keep]


def _buckets(codes: np.ndarray, owner: np.ndarray, old: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams that end beyond the first ``old`` characters and lie in one text, the text of each, and the first place of each order."""
    found, of, firsts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [0]
    h = np.zeros(len(codes), np.uint64)
    codes = codes.astype(np.uint64)
    for n in ORDERS:
        if n > len(codes):
            break
        h = (h[: len(codes) - n + 1] * np.uint64(0x100000001B3)) ^ codes[n - 1 :]
        one = owner[: len(h)] == owner[n - 1 :]
        one[: max(0, old - n + 1)] = False
        found.append((mix(h + np.uint64(n))[one] % np.uint64(BUCKETS)).astype(np.int64))
        of.append(owner[: len(h)][one])
        firsts.append(firsts[-1] + len(found[-1]))
    return np.concatenate(found), np.concatenate(of), np.array(firsts)


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of the texts: the buckets of their n-grams, the number of the text that each belongs to, and the first place of each
    order, in which those numbers ascend. No n-gram spans two texts; a text longer than a slice comes in several."""
    held, of, size = [], [], 0

    def flush():
        lowered = [t.lower() + "\n" for t in held]  # the line end closes a text's last run of letters
        codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _letters()[codes]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        owner = np.repeat(np.array(of, np.int64), [len(t) for t in lowered])
        return _buckets(np.where(letter, codes, 32)[keep], owner[keep], 0)

    for i, t in enumerate(texts):
        if len(t) > _SLICE:
            tail, letter = np.zeros(0, np.uint32), False
            for at in range(0, len(t), _SLICE):
                piece = t[at : at + _SLICE] + ("\n" if at + _SLICE >= len(t) else "")
                codes = _normal(piece, letter)
                letter = bool(_letters()[min(ord(piece.lower()[-1]), 0x10FFFF)])
                joined = np.concatenate((tail, codes))
                yield _buckets(joined, np.full(len(joined), i), len(tail))
                tail = joined[-(max(ORDERS) - 1) :]
            continue
        held.append(t)
        of.append(i)
        size += len(t)
        if size >= _SLICE:
            yield flush()
            held, of, size = [], [], 0
    if held:
        yield flush()


def training_row(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text leaves a remainder other than 1 by 3; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1, F.lit(False))


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log priors, log-probability matrix) from the training rows of ``docs`` with a language and a text."""
    rows = docs.where(training_row() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = dict(rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MOST_LANGUAGES + 1).collect())
    if len(counts) > MOST_LANGUAGES:  # the matrix would not fit; leaving some out would give their documents a wrong language
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    languages = sorted(counts)
    if not languages:
        return [], np.zeros(0), np.zeros((BUCKETS, 0), np.float32)
    rates = docs.sparkSession.createDataFrame(
        [(k, i, min(1.0, per_language / counts[k])) for i, k in enumerate(languages)], "lang string, l int, rate double")
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(broadcast_if_small(rates, MOST_LANGUAGES), "lang").where(draw < F.col("rate")).select("l", "text")
    width = len(languages)

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            return keys[first], np.add.reduceat(n, first)

        def rows(keys, n):
            return pa.RecordBatch.from_pydict({"l": pa.array(keys // BUCKETS, pa.int32()), "b": pa.array(keys % BUCKETS, pa.int32()), "n": pa.array(n)})

        for batch in batches:
            of_language = batch.column("l").to_numpy().astype(np.int64)
            for bucket, owner, _ in grams(batch.column("text").to_pylist()):
                if len(bucket):
                    held.append(np.unique(of_language[owner] * BUCKETS + bucket, return_counts=True))
                if sum(len(k) for k, _ in held) > 1 << 22:
                    held = [merged()]
                    if len(held[0][0]) > 1 << 21:
                        yield rows(*held.pop())
        if held:
            yield rows(*merged())

    flat = chosen.mapInArrow(lean(count), "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros((width, BUCKETS), np.int64)
    matrix[flat["l"].to_numpy(), flat["b"].to_numpy()] = flat["n"].to_numpy()
    log = np.log(matrix + SMOOTHING) - np.log(matrix.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    prior = np.array([counts[k] for k in languages], float)
    return languages, np.log(prior / prior.sum()), np.ascontiguousarray(log.T, np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``.

    Only the text is read. ``und`` with score 0 if it is null or has no letter, or if nothing was learned.
    score is the posterior probability with the evidence spread over the square root of the number of n-grams, so that
    it stays below 1 for short or mixed texts. Ties go to the first language by name. Repeated rows
    repeat; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        languages, prior, matrix = shared.value
        names = np.array([*languages, UNKNOWN], dtype=object)
        block = max(1 << 12, (1 << 22) // max(1, len(languages)))
        for batch in batches:
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            sums = np.zeros((len(texts), len(languages)))
            seen = np.zeros(len(texts), np.int64)
            for bucket, owner, firsts in grams(texts):
                for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
                    for at in range(a, b, block):
                        rows, of = matrix[bucket[at : min(b, at + block)]], owner[at : min(b, at + block)]
                        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
                        sums[of[first]] += np.add.reduceat(rows, first, axis=0, dtype=np.float64)
                        seen[of[first]] += np.diff(np.append(first, len(of)))
            lettered = np.fromiter((any(map(str.isalpha, t)) for t in texts), bool, len(texts))
            known = (seen > 0) & lettered & (len(languages) > 0)
            best, score = np.full(len(texts), len(languages)), np.zeros(len(texts))
            if len(languages):
                best = np.where(known, (sums + prior).argmax(axis=1), best)
                tempered = sums / np.sqrt(np.maximum(seen, 1))[:, None] + prior
                odds = np.exp(tempered - tempered.max(axis=1, keepdims=True))
                share = odds / odds.sum(axis=1, keepdims=True)
                score = np.where(known, share[np.arange(len(texts)), np.minimum(best, len(languages) - 1)], 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names[best], pa.string()), pa.array(score)],
                names=["doc_id", "held_out", "lang_pred", "score"])

    schema = StructType([
        docs.schema["doc_id"], StructField("held_out", BooleanType()), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))
    return docs.select("doc_id", held.alias("held_out"), F.col("text").alias("__text")).mapInArrow(lean(run), schema)
