"""Toxicity: a logistic classifier over words and word beginnings with a counterfactual penalty.

Training sentences are copied with their identity terms swapped for others of the same kind (a sentence without one
gets a neutral mention first). The loss adds the squared change of the score between such copies, so that the
mention of a group by itself moves no score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.llm.storage import bound_batches, hashed_sample, stored, trim

# Identity terms by language and kind. Terms of one kind and language can stand for each other.
IDENTITY_TERMS = {
    "en gender": ["women", "men", "girls", "boys"],
    "en orientation": ["gay", "lesbian", "straight", "bisexual"],
    "en origin": ["african", "arab", "asian", "european", "american", "latino", "mexican", "chinese", "turkish"],
    "en religion": ["muslim", "jewish", "christian", "hindu", "buddhist", "atheist"],
    "en colour": ["black", "white", "brown"],
    "en age": ["old", "young", "elderly", "teenage"],
    "en ability": ["deaf", "blind", "disabled", "autistic"],
    "en status": ["immigrant", "refugee", "homeless", "citizen"],
    "de gender": ["frauen", "männer", "mädchen", "jungen"],
    "de orientation": ["schwule", "lesben", "heterosexuelle", "bisexuelle"],
    "de origin": ["afrikaner", "araber", "asiaten", "europäer", "türken", "polen"],
    "de religion": ["muslime", "juden", "christen", "hindus", "buddhisten", "atheisten"],
    "de status": ["einwanderer", "flüchtlinge", "obdachlose", "bürger"],
    "es gender": ["mujeres", "hombres", "niñas", "niños"],
    "es orientation": ["gays", "lesbianas", "heterosexuales", "bisexuales"],
    "es origin": ["africanos", "árabes", "asiáticos", "europeos", "mexicanos", "chinos"],
    "es religion": ["musulmanes", "judíos", "cristianos", "hindúes", "budistas", "ateos"],
    "es status": ["inmigrantes", "refugiados", "indigentes", "ciudadanos"],
    "fr gender": ["femmes", "hommes", "filles", "garçons"],
    "fr orientation": ["homosexuels", "lesbiennes", "hétérosexuels", "bisexuels"],
    "fr origin": ["africains", "arabes", "asiatiques", "européens", "algériens", "chinois"],
    "fr religion": ["musulmans", "juifs", "chrétiens", "hindous", "bouddhistes", "athées"],
    "fr status": ["immigrés", "réfugiés", "clochards", "citoyens"],
}

_WORD = re.compile(r"\w+")
_PREFIXES = (4, 5, 6)
_CACHED_WORDS = 1 << 16  # of a task
_KIND = {term: kind for kind, terms in IDENTITY_TERMS.items() for term in terms}


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features_of(word: str) -> list[str]:
    """The word itself, and its first 4, 5 and 6 characters (marked by a star)."""
    return [word, *(word[:n] + "*" for n in _PREFIXES if len(word) >= n)]


@dataclass
class Model:
    features: dict[str, int]
    weights: np.ndarray
    bias: float

    def word_features(self, word: str) -> tuple[int, ...]:
        return tuple(i for f in features_of(word) if (i := self.features.get(f)) is not None)

    def vector(self, words: set[str], cache: dict[str, tuple[int, ...]] | None = None) -> set[int]:
        cache = {} if cache is None else cache
        found: set[int] = set()
        for word in words:
            if (hit := cache.get(word)) is None:
                hit = cache[word] = self.word_features(word)
            if hit:
                found.update(hit)
        return found

    def score(self, words: set[str], cache: dict | None = None) -> float:
        z = self.bias + float(sum(self.weights[i] for i in sorted(self.vector(words, cache))))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class _Rows:
    """Binary feature rows."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.concatenate([np.zeros(0, np.int64), *rows])
        self.n, self.width = len(rows), width

    def times(self, w):
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, g):
        return np.bincount(self.col, g[self.row], self.width)


def swapped(terms: list[str], draw: np.random.Generator) -> tuple[list[str], list[str]]:
    """A sentence's identity terms and their counterfactual: each becomes another of its kind. Without any, a mention is made up."""
    if not terms:
        kind = draw.choice(sorted(IDENTITY_TERMS))
        terms = [str(draw.choice(IDENTITY_TERMS[kind]))]
    return terms, [str(draw.choice([x for x in IDENTITY_TERMS[_KIND[t]] if x != t])) for t in terms]


def _numbered(features: list[str]) -> dict[str, int]:
    return {f: i for i, f in enumerate(dict.fromkeys([*features, *(f for t in _KIND for f in features_of(t))]))}


def row_of(words: set[str], model: Model, cache: dict) -> tuple[bytes, list[str]]:
    """The features of the words that are no identity terms, as int32, and the identity terms."""
    terms = sorted(words & _KIND.keys())
    return np.array(sorted(model.vector(words.difference(terms), cache)), np.int32).tobytes(), terms


def fit(sample: list[tuple[set[str], int]], features: list[str], **options) -> Model:
    """Fit on sets of words and their labels. ``features`` come from selected_features()."""
    model, cache = Model(_numbered(features), np.zeros(0), 0.0), {}
    return fit_rows([(*row_of(words, model, cache), toxic) for words, toxic in sample], features, **options)


def fit_rows(sample: list[tuple[bytes, list[str], int]], features: list[str], swap_penalty: float = 1.0, ridge: float = 1e-4, rounds: int = 400, seed: int = 7) -> Model:
    """Fit by Adam on the whole of a bounded sample of rows as row_of() makes them, with labels."""
    named = _numbered(features)
    toxic = np.array([y for _, _, y in sample], float)
    if not len(sample) or toxic.min() == toxic.max():  # nothing to tell apart
        share = (toxic.sum() + 0.1) / (len(sample) + 1)
        return Model(named, np.zeros(len(named)), float(np.log(share / (1 - share))))
    model, draw = Model(named, np.zeros(len(named)), 0.0), np.random.default_rng(seed)
    plain = [np.frombuffer(base, np.int32) for base, _, _ in sample]
    of_term = {t: np.array(model.word_features(t), np.int32) for t in _KIND}
    none = np.zeros(0, np.int32)
    mentioned = lambda mentions: _Rows([np.setdiff1d(np.concatenate([none, *(of_term[t] for t in terms)]), p) if terms else none for p, terms in zip(plain, mentions, strict=True)], len(named))
    pairs = [swapped(terms, draw) for _, terms, _ in sample]
    # what the rows and both counterfactuals share, and what the mentions add
    base, x, a, b = _Rows(plain, len(named)), mentioned([terms for _, terms, _ in sample]), mentioned([p[0] for p in pairs]), mentioned([p[1] for p in pairs])
    weight = np.where(toxic == 1, 0.5 / toxic.sum(), 0.5 / (len(toxic) - toxic.sum()))
    w, bias = np.zeros(len(named)), 0.0
    m, v = np.zeros(len(named) + 1), np.zeros(len(named) + 1)
    for t in range(1, rounds + 1):
        z = base.times(w) + bias
        error = weight * (_sigmoid(z + x.times(w)) - toxic)
        sa, sb = _sigmoid(z + a.times(w)), _sigmoid(z + b.times(w))
        change = 2 * swap_penalty * (sa - sb) / len(sample)
        ga, gb = change * sa * (1 - sa), -change * sb * (1 - sb)
        grad = np.append(base.back(error + ga + gb) + x.back(error) + a.back(ga) + b.back(gb) + ridge * w, error.sum() + ga.sum() + gb.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    model.weights, model.bias = w, float(bias)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` labelled rows that are not held out, those with the smallest hash of their id: doc_id, text, toxic.

    A label above 0 is toxic, others are not. Where a document has several labels, toxic wins; a null label or id counts as none.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    known = stored(known.where(~held_out(F.col("doc_id"))), "labels")
    known = hashed_sample(known, F.col("doc_id"), rows, known.count())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(known), "doc_id")  # bounded by ``rows`` ids and labels


def held_out(doc_id):
    """By the crc32 of the id as text; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def selected_features(sample: DataFrame, count: int, min_rows: int = 5) -> list[str]:
    """The ``count`` features that best tell the labels apart, by the z value of their shares in either class."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        rows = [0, 0]
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                rows[toxic] += 1
                seen[toxic].update({f for w in words_of(text.as_py()) for f in features_of(w)})
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_pydict({"feature": pa.array(["", *names], pa.string()), "clean": pa.array([rows[0], *(seen[0][f] for f in names)], pa.int64()), "toxic": pa.array([rows[1], *(seen[1][f] for f in names)], pa.int64())})
        del names, seen
        trim()

    found = sample.select("text", "toxic").mapInArrow(counts, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = found.where(F.col("feature") == "").collect()
    if not total or not total[0].clean or not total[0].toxic:
        return []
    p, q = F.col("toxic") / F.lit(total[0].toxic), F.col("clean") / F.lit(total[0].clean)
    share = (F.col("toxic") + F.col("clean")) / F.lit(total[0].toxic + total[0].clean)
    z = F.abs(p - q) / F.sqrt(share * (1 - share) * F.lit(1 / total[0].toxic + 1 / total[0].clean) + F.lit(1e-12))
    best = found.where((F.col("feature") != "") & (F.col("toxic") + F.col("clean") >= min_rows)).withColumn("z", z).where("z >= 4")
    return [r.feature for r in best.orderBy(F.desc("z"), "feature").limit(count).select("feature").collect()]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, features: int = 4096, **options) -> Model:
    """Fit on a sample of at most ``sample_rows`` labelled rows; the driver holds only their selected features.

    Null texts count as empty ones. Documents that repeat an id are each a row of the sample; rows and labels without an id, and
    labels without a document, are left out. Where the sample is empty or has one label only, every score is the share of toxic rows.
    """
    bound_batches(docs.sparkSession)
    sample = stored(labelled_sample(docs, labels, sample_rows), "sample")
    chosen = selected_features(sample, features)
    shape = Model(_numbered(chosen), np.zeros(0), 0.0)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            if len(cache) > _CACHED_WORDS:
                cache.clear()
            rows = [row_of(words_of(t.as_py()), shape, cache) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.string())), batch.column(2)], names=["doc_id", "base", "terms", "toxic"])
        cache.clear()
        trim()

    rows = sample.mapInArrow(vectors, "doc_id long, base binary, terms array<string>, toxic int").collect()
    rows = sorted((r.doc_id, bytes(r.base), r.terms, r.toxic) for r in rows)
    model = fit_rows([r[1:] for r in rows], chosen, **options)
    del rows
    trim()
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` with held_out, score and predicted, which replace columns of those names. Null text scores as empty."""
    bound_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    at = names.index("text")
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of features
    cache: dict[str, tuple[int, ...]] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            if len(cache) > _CACHED_WORDS:
                cache.clear()
            scores = [model.score(words_of(t.as_py()), cache) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])
        cache.clear()
        trim()

    out = docs.mapInArrow(run, _with_score(docs.schema))
    return out.select(*[F.col(f"`{c}`") for c in names], held_out(F.col("doc_id").cast("long")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _with_score(schema):
    from pyspark.sql import types as T

    return T.StructType([*schema.fields, T.StructField("score", T.DoubleType())])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).drop("text")
