"""A toxicity classifier regularised by counterfactual pairs.

A logistic model over hashed binary features of a text: its words, and the first four, five and six letters
of each word, which carry over to inflected forms. It is fitted on a sample of labelled documents of
documented size. For every training text that names an identity group, a copy is made in which each such
term is swapped for another of its kind; the loss adds ``pairing`` times the mean squared difference of the two logits
(counterfactual logit pairing), and identity terms form no prefix features, so naming a group costs nothing by
itself. The groups of terms are a parameter. The model is a vector of ``BUCKETS`` floats, 4 MB, whatever the corpus; scoring is one Arrow
pass, in which words are cut out and hashed by numpy over slices of text.

Fitting takes three steps: features of the sample where its texts are; counts of each feature by label, from which those
that chance explains are left out; the gradient steps, in one task, over the few features that remain.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from inkwell.llm.bytewords import lean, mix
from inkwell.llm.native_text import broadcast_if_small
from inkwell.session import materialize, small_batches

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
#: At most about so many labelled documents of each label are fitted; a hash of doc_id chooses them.
SAMPLE_PER_LABEL = 6000
ROUNDS = 150
PAIRING = 1.0
DECAY = 1e-6

# Groups of identity terms that may stand for one another, in English, German, French and Spanish.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("black", "white", "asian", "latino", "arab"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "natives", "foreigners", "refugees"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young", "elderly"),
    ("mexican", "american", "chinese", "african", "european", "german", "french", "spanish"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("frau", "mann"),
    ("schwarze", "weiße", "asiaten", "araber"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwul", "lesbisch", "bisexuell", "transgeschlechtlich"),
    ("einwanderer", "einheimische", "ausländer", "flüchtlinge"),
    ("behinderte", "blinde", "gehörlose", "autisten"),
    ("alte", "junge"),
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme", "fille", "garçon"),
    ("noirs", "blancs", "asiatiques", "arabes"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("gays", "lesbiennes", "bisexuels", "hétérosexuels"),
    ("immigrés", "natifs", "étrangers", "réfugiés"),
    ("handicapés", "aveugles", "sourds", "autistes"),
    ("vieux", "jeunes"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("mujer", "hombre", "niña", "niño"),
    ("negros", "blancos", "asiáticos", "árabes"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("homosexuales", "lesbianas", "bisexuales", "heterosexuales"),
    ("inmigrantes", "nativos", "extranjeros", "refugiados"),
    ("discapacitados", "ciegos", "sordos"),
    ("viejos", "jóvenes"),
)
_WORD = re.compile(r"\w+")
_SLICE = 1 << 19  # characters that are hashed at a time
_FACTOR = 0x9E3779B97F4A7C15  # odd, so it has an inverse
_SOLID: list[np.ndarray] = []
_POWERS: list[np.ndarray] = []


class Model(NamedTuple):
    """Weights by bucket, the intercept, the groups of terms, and how many training texts have a counterfactual."""

    weights: np.ndarray
    intercept: float
    terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS
    pairs: int = 0


def swaps(terms: tuple[tuple[str, ...], ...]) -> dict[str, list[str]]:
    """The terms that may replace each term."""
    return {t: [x for x in group if x != t] for group in terms for t in group}


def counterfactual(text: str, others: Mapping[str, list[str]], turn: int) -> str | None:
    """The lower-cased text with every identity term swapped for another of its group, the same one each time; None if
    there is no such term."""
    text = text.lower()
    found = sorted(set(_WORD.findall(text)) & others.keys())
    chosen = {w: others[w][(turn + i) % len(others[w])] for i, w in enumerate(found)}
    return _WORD.sub(lambda m: chosen.get(m[0], m[0]), text) if chosen else None


def _solid() -> np.ndarray:
    """By code point: whether it belongs to a word, as \\w has it."""
    if not _SOLID:
        _SOLID.append(np.fromiter((chr(c).isalnum() or c == 95 for c in range(0x110000)), bool, 0x110000))
    return _SOLID[0]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_FACTOR ** i and its inverse, modulo 2 ** 64, for i up to n at least."""
    if not _POWERS or len(_POWERS[0]) <= n:
        inverse = pow(_FACTOR, -1, 1 << 64)
        size = max(n, _SLICE) + 1
        _POWERS[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, f, np.uint64)))) for f in (_FACTOR, inverse)]
    return _POWERS[0], _POWERS[1]


def _slices(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """(numbers of the texts, lower-case pieces): whole texts, up to about _SLICE characters at a time. Long texts are cut between
    words; only a single longer word makes a longer piece."""
    numbers, held, size = [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            end = min(len(t), at + _SLICE)
            if end < len(t):
                cut = end
                while cut > at and (t[cut].isalnum() or t[cut] == "_"):
                    cut -= 1
                if cut == at:
                    while end < len(t) and (t[end].isalnum() or t[end] == "_"):
                        end += 1
                    cut = end
                end = cut
            numbers.append(i)
            held.append(t[at:end].lower())
            size += end - at
            at = end
            if size >= _SLICE:
                yield numbers, held
                numbers, held, size = [], [], 0
    if held:
        yield numbers, held


def _hashed(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray | slice, np.ndarray]]]]:
    """For slices of texts: each word's text, its hash, and for the whole word and each length of prefix which words have it and
    its bucket."""
    for numbers, held in _slices(texts):
        codes = np.frombuffer("\n".join([*held, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        solid = _solid()[codes]
        edges = np.flatnonzero(np.diff(solid.view(np.int8), prepend=np.int8(0)))
        starts, ends = edges[::2], edges[1::2]  # a line end follows each piece
        sizes = ends - starts
        power, inverse = _powers(len(codes))
        upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * power[: len(codes)])))
        begin, back = upto[starts], inverse[starts]
        words = mix((upto[ends] - begin) * back)
        shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
        parts: list[tuple[np.ndarray | slice, np.ndarray]] = [(slice(None), (words >> shift).astype(np.int64))]
        for n in PREFIXES:
            of = np.flatnonzero(sizes >= n)
            parts.append((of, (mix((upto[starts[of] + n] - begin[of]) * back[of] + np.uint64(n)) >> shift).astype(np.int64)))
        last = np.cumsum(np.fromiter((len(t) + 1 for t in held), np.int64, len(held)))
        yield np.array(numbers)[np.searchsorted(last, starts, "right")], words, parts


def _hash_words(words: list[str]) -> np.ndarray:
    return np.sort(np.concatenate([w for _, w, _ in _hashed([" ".join(words)])])) if words else np.zeros(0, np.uint64)


def _keys(texts: list[str], terms: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct text number * BUCKETS + bucket of the features of all texts, or of those buckets that ``wanted`` flags. terms:
    the hashes of the identity terms, which have no prefix features."""
    found = [np.zeros(0, np.int64)]
    for of_word, words, parts in _hashed(texts):
        for n, (of, bucket) in enumerate(parts):
            owner, word = of_word[of], words[of]
            if wanted is not None:
                hit = wanted[bucket]
                owner, word, bucket = owner[hit], word[hit], bucket[hit]
            if n:
                plain = ~np.isin(word, terms)
                owner, bucket = owner[plain], bucket[plain]
            found.append(np.unique(owner * BUCKETS + bucket))
    return np.unique(np.concatenate(found))


def features(texts: list[str], terms: np.ndarray) -> list[np.ndarray]:
    """The sorted buckets of each text."""
    keys = _keys(texts, terms)
    cuts = np.searchsorted(keys, np.arange(len(texts) + 1) * BUCKETS)
    return [(keys[a:b] % BUCKETS).astype(np.int32) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _pack(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter((len(r) for r in rows), np.int64, len(rows))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    return (np.concatenate(rows) if rows else np.zeros(0, np.int32)), starts


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[starts[1:]] - total[starts[:-1]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def useful(seen: np.ndarray, positive: np.ndarray, n1: int, n0: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the features are free to move, and the log-odds that each starts from. Left out are those seen in
    fewer than three training texts, and those whose log-likelihood ratio chance explains given the number of features, so that
    words of a few documents carry nothing."""
    use = seen >= 3
    odds = np.log((positive + 0.5) / (n1 + 1)) - np.log((seen - positive + 0.5) / (n0 + 1))
    rate, negative = n1 / max(1, n1 + n0), seen - positive
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 2 * (np.where(positive > 0, positive * np.log(positive / (seen * rate)), 0)
                    + np.where(negative > 0, negative * np.log(negative / (seen * (1 - rate))), 0))
    return use & (gain > 2 * np.log(max(2, use.sum())) + 2) & (odds != 0), odds


class Loss:
    """The training loss over rows of feature numbers: logistic loss with classes weighed evenly, plus ``pairing`` times the
    mean squared difference of the logits of a row and its counterfactual, plus DECAY / 2 times the squared weights."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[int, np.ndarray]], width: int, pairing: float = PAIRING):
        self.labels, self.width, self.pairing = labels, width, pairing
        self.flat, self.starts = _pack(rows)
        self.other, self.other_starts = _pack([g for _, g in pairs])
        self.of = np.fromiter((i for i, _ in pairs), np.int64, len(pairs))
        self.row_of = np.repeat(np.arange(len(labels)), np.diff(self.starts))
        self.weight_of = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum()))

    def gradient(self, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        score = _sums(w[self.flat], self.starts) + b
        error = (_sigmoid(score) - self.labels) * self.weight_of
        slope = float(error.sum())
        back = np.zeros(self.width)
        if len(self.of):
            twin = _sums(w[self.other], self.other_starts) + b
            pull = 2 * self.pairing * (score[self.of] - twin) / len(self.of)
            np.add.at(error, self.of, pull)
            back = np.bincount(self.other, weights=np.repeat(-pull, np.diff(self.other_starts)), minlength=self.width)
        return np.bincount(self.flat, weights=error[self.row_of], minlength=self.width) + back + DECAY * w, slope


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[int, np.ndarray]], start: np.ndarray,
             pairing: float = PAIRING, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights of the features numbered from 0 and the intercept, by full-gradient Adam steps from ``start``. pairs: (row number, features
    of its counterfactual)."""
    loss = Loss(rows, labels, pairs, len(start), pairing)
    w, b, m, v, mb, vb = start.astype(np.float64), -2.0, np.zeros(len(start)), np.zeros(len(start)), 0.0, 0.0
    for t in range(1, rounds + 1):
        g, gb = loss.gradient(w, b)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.05 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= 0.05 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, float(b)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of doc_id as text leaves remainder 1 by 3; a null id is kept out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS,
          pairing: float = PAIRING) -> Model:
    """Fit on labelled training rows of ``docs``: joined by doc_id, a bounded sample of each label. A document with both labels counts as
    toxic; a null text has no features. Without rows of both labels every score is the same."""
    told = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).select("doc_id", "toxic").distinct()
    told = told.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = dict(told.groupBy("toxic").count().collect())
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rate = lambda label: F.lit(min(1.0, per_label / max(1, counts.get(label, 0))))
    chosen = materialize(told.where(draw < F.when(F.col("toxic") == 1, rate(1)).otherwise(rate(0))), "sample")
    chosen = broadcast_if_small(chosen, 4 * per_label)  # about 2 * per_label rows
    others = swaps(terms)

    def told_features(batches):
        hashes = _hash_words(list(others))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            twins = [counterfactual(t, others, i) for i, t in enumerate(texts)]
            paired = [t for t in twins if t is not None]
            swapped = iter(features(paired, hashes))
            yield pa.RecordBatch.from_pydict({
                "toxic": batch.column("toxic"), "f": [f.tobytes() for f in features(texts, hashes)],
                "g": pa.array([None if t is None else next(swapped).tobytes() for t in twins], pa.binary())})

    def counted(batches):
        seen, positive = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for toxic, f in zip(batch.column("toxic").to_pylist(), batch.column("f").to_pylist(), strict=True):
                at = np.frombuffer(f, np.int32)
                seen[at] += 1
                positive[at] += toxic
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "seen": pa.array(seen[at]), "positive": pa.array(positive[at])})

    made = docs.select("doc_id", "text").join(chosen, "doc_id").select("toxic", "text").mapInArrow(lean(told_features), "toxic int, f binary, g binary")
    with small_batches(docs.sparkSession):
        made = materialize(made, "features")
    told = made.groupBy("toxic").agg(F.count(F.lit(1)), F.count("g")).collect()
    n1, n0 = (sum(r[1] for r in told if r[0] == label) for label in (1, 0))
    weights = np.zeros(BUCKETS, np.float32)
    if not n1 or not n0:
        share = (n1 + 0.5) / (n1 + n0 + 1)
        return Model(weights, float(np.log(share / (1 - share))), terms)
    # At most BUCKETS rows, whatever the corpus.
    told_counts = made.mapInArrow(lean(counted), "bucket int, seen long, positive long").groupBy("bucket").agg(
        F.sum("seen").alias("seen"), F.sum("positive").alias("positive")).where("seen >= 3").toArrow()
    bucket, seen, positive = (told_counts[c].to_numpy() for c in ("bucket", "seen", "positive"))
    order = np.argsort(bucket)
    free, odds = useful(seen[order], positive[order], n1, n0)
    bucket, start = bucket[order][free], odds[free] / (1 + len(PREFIXES))

    def few(data):
        f = np.frombuffer(data, np.int32)
        at = np.searchsorted(bucket, f)
        at[at == len(bucket)] = 0
        return at[bucket[at] == f] if len(bucket) else at[:0]

    def fit(batches):
        rows = sorted(
            ((t, few(f).tolist(), None if g is None else few(g).tolist()) for batch in batches
             for t, f, g in zip(*(batch.column(c).to_pylist() for c in ("toxic", "f", "g")), strict=True)), key=str)
        pairs = [(i, np.array(g, np.int64)) for i, (_, _, g) in enumerate(rows) if g is not None]
        w, b = fit_rows([np.array(f, np.int64) for _, f, _ in rows], np.array([t for t, _, _ in rows], float), pairs, start, pairing)
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(-1, len(w)), pa.int32()), "w": pa.array([b, *w.tolist()])})

    def reduced(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({
                "toxic": batch.column("toxic"), "f": [bucket[few(f)].tobytes() for f in batch.column("f").to_pylist()],
                "g": pa.array([None if g is None else bucket[few(g)].tobytes() for g in batch.column("g").to_pylist()], pa.binary())})

    # A bounded sample of short rows, so one task fits it.
    fitted = made.mapInArrow(reduced, made.schema).repartition(1).mapInArrow(fit, "at int, w double").toArrow()
    at, values = fitted["at"].to_numpy(), fitted["w"].to_numpy()
    weights[bucket[at[at >= 0]]] = values[at >= 0]
    return Model(weights, float(values[at < 0][0]), terms, sum(r[2] for r in told))


class _Scorer:
    """Scores of texts by a model, for one worker."""

    def __init__(self, model: Model):
        self.model, self.wanted = model, model.weights != 0
        self.terms = _hash_words(list(swaps(model.terms)))

    def __call__(self, column: pa.Array) -> np.ndarray:
        texts = [t or "" for t in column.to_pylist()]
        keys = _keys(texts, self.terms, self.wanted)
        sums = np.bincount(keys // BUCKETS, weights=self.model.weights[keys % BUCKETS], minlength=len(texts))
        return _sigmoid(sums + self.model.intercept)


def _portions(batches):
    """Batches in portions whose texts are small together, or one long text."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
        first = 0
        while first < batch.num_rows:
            before = sizes[first - 1] if first else 0
            end = max(first + 1, int(np.searchsorted(sizes, before + (8 << 20), "right")))
            yield batch.slice(first, end - first)
            first = end


def scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 if score >= threshold) of every row of ``docs``.

    Whole texts are scored. A null or empty text gets the score of a text without features. Repeated
    rows repeat; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([
        docs.schema["doc_id"], StructField("held_out", BooleanType()), StructField("score", DoubleType()),
        StructField("predicted", IntegerType())])

    def run(batches):
        score = _Scorer(shared.value)
        for batch in _portions(batches):
            s = score(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(lean(run), schema)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns kept, in one pass over them. Null and empty texts are scored as
    texts without features; rows that repeat each other go or stay together; an empty table gives no rows; columns may have any name."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches):
        score = _Scorer(shared.value)
        for batch in _portions(batches):
            yield batch.filter(pa.array(score(batch.column("text")) < THRESHOLD))

    return docs.mapInArrow(lean(run), docs.schema)
