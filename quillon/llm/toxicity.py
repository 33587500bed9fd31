"""Toxicity scores by a counterfactual-regularised linear classifier.

A text's features are the presence of words and of word beginnings. Logistic regression is fitted on a bounded sample of
labelled texts. Counterfactuals are made of labelled sentences: each one that names an identity group, with the term
swapped for every other of its kind and with the term left out; and one sentence of each text labelled 0, with a term
put in, for the neutral mentions that the sample lacks. The squared change of the score between a sentence and its
counterfactuals is penalised, each term's changes counting alike however often it occurs. So a term that only happens to
be frequent in toxic texts earns no weight of its own, and a neutral mention of a group scores as the sentence does
without it. Feature counts are made in Spark; the driver gets the selected features and, for each sampled text, their
numbers and changes.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import checkpointed, sliced
from quillon.llm.langid import held_out

SAMPLE_ROWS = 20_000
FEATURES = 4096
LEAST_LOG_RATIO = 1.0
PREFIXES = (4, 5, 6, 7, 8)
_SPACES = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Fixed word lists: terms of one kind may be swapped for each other.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("black", "white", "asian", "latino"),
    ("american", "mexican", "chinese", "indian", "african", "european"),
    ("immigrants", "natives", "refugees"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
    ("homosexuels", "hétérosexuels", "lesbiennes", "bisexuels"),
    ("noirs", "blancs", "asiatiques", "arabes"),
    ("immigrés", "autochtones", "réfugiés"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwule", "lesben", "bisexuelle", "heterosexuelle"),
    ("schwarze", "weiße", "asiaten", "araber"),
    ("einwanderer", "einheimische", "flüchtlinge"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("homosexuales", "heterosexuales", "lesbianas", "bisexuales"),
    ("negros", "blancos", "asiáticos", "árabes"),
    ("inmigrantes", "nativos", "refugiados"),
)
TERMS = sorted({t.encode() for kind in IDENTITY_TERMS for t in kind})
_OTHERS = {t: sorted({o.encode() for kind in IDENTITY_TERMS if t.decode() in kind for o in kind} - {t}) for t in TERMS}
_PLACE = {t: i for i, t in enumerate(TERMS)}
_SENTENCE = re.compile(r"[.!?\n]+")


def features(text: str | None) -> set[bytes]:
    """Words of the lower-cased text, and word beginnings marked by ^."""
    return _of_words(set((text or "").lower().encode("utf-8", "replace").translate(_SPACES).split()))


def _of_words(words: set[bytes]) -> set[bytes]:
    return words.union(*({b"^" + w[:n] for w in words if len(w) >= n} for n in PREFIXES))


def counterfactuals(words: set[bytes], term: bytes) -> list[tuple[set[bytes], set[bytes]]]:
    """(features that go, features that come) when a sentence's term is swapped for each other of its kind, or left out."""
    own, rest, found = _of_words(words), words - {term}, []
    for new in (*({o} for o in _OTHERS[term]), set()):
        other = _of_words(rest | new)
        if own != other:
            found.append((own - other, other - own))
    return found


def changes(text: str | None, neutral: bool) -> list[tuple[int, set[bytes], set[bytes]]]:
    """(term, features that go, features that come), each once, for the sentences of a labelled text that name a group.

    A neutral text's first sentence with a word is taken with a term, chosen by its hash, put in as well.
    """
    found, first = {}, neutral
    for sentence in _SENTENCE.split(text or ""):
        words = set(sentence.lower().encode("utf-8", "replace").translate(_SPACES).split())
        if words and first:
            first, put = False, TERMS[zlib.crc32(sentence.encode("utf-8", "replace")) % len(TERMS)]
            found |= {(_PLACE[put], frozenset(a), frozenset(b)): None for a, b in counterfactuals(words | {put}, put)}
        for term in words & _PLACE.keys():
            found |= {(_PLACE[term], frozenset(a), frozenset(b)): None for a, b in counterfactuals(words, term)}
    return list(found)


class Classifier:
    """Weights by feature, and a bias."""

    def __init__(self, weights: dict[bytes, float], bias: float) -> None:
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weights[f] for f in self.weights.keys() & features(text))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -50, 50))))


def fit(rows: list[tuple[list[int], int]], names: list[bytes], swaps: list[tuple[int, list[int], list[int]]] = (), swap_penalty: float = 1.0, decay: float = 1e-5, steps: int = 600) -> Classifier:
    """Fits rows (feature numbers, label) by full-batch gradient steps, with swaps (term, numbers that go, numbers that come).

    The loss is the mean of the rows' plus, for each term, swap_penalty times the mean squared change of its swaps.
    """
    n, m = len(rows), len(names)
    if not n:
        return Classifier({}, 0.0)
    doc = np.repeat(np.arange(n), [len(r[0]) for r in rows])
    feature = np.array([f for r in rows for f in r[0]], dtype=np.int64)
    y = np.array([r[1] for r in rows], dtype=np.float64)
    times = Counter((term, tuple(go), tuple(come)) for term, go, come in swaps)
    per_term: Counter = Counter()
    for (term, _, _), k in times.items():
        per_term[term] += k
    share = np.array([k / per_term[term] for (term, _, _), k in times.items()])
    pair = np.repeat(np.arange(len(times)), [len(go) + len(come) for _, go, come in times])
    changed = np.array([f for _, go, come in times for f in (*go, *come)], dtype=np.int64)
    sign = np.array([x for _, go, come in times for x in [1.0] * len(go) + [-1.0] * len(come)])
    w, first, second = (np.zeros(m + 1) for _ in range(3))
    w[m] = np.log((y.sum() + 1) / (n - y.sum() + 1))
    for t in range(1, steps + 1):
        z = np.bincount(doc, weights=w[feature], minlength=n) + w[m]
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / n
        g = np.r_[np.bincount(feature, weights=error[doc], minlength=m), error.sum()]
        if len(times):
            moved = share * np.bincount(pair, weights=sign * w[changed], minlength=len(times))
            g[:m] += 2 * swap_penalty * np.bincount(changed, weights=sign * moved[pair], minlength=m)
        g[:m] += decay * w[:m]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Classifier({f: float(x) for f, x in zip(names, w[:m], strict=True) if abs(x) > 1e-4}, float(w[m]))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, n_features: int = FEATURES, swap_penalty: float = 1.0) -> Classifier:
    """A classifier from about sample_rows of the labelled documents, chosen by a hash of doc_id.

    A document with several labels counts as toxic if one says so; null labels and ids, and labels without a document,
    teach nothing. Without labelled rows every text scores one half.
    """
    spark = docs.sparkSession
    labels = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.max("toxic") > 0).cast("int").alias("y"))
    n = labels.count()
    share = int(1_000_000 * min(1.0, sample_rows / max(1, n))) + 1
    chosen = labels.where(F.pmod(F.xxhash64("id", F.lit(6)), F.lit(1_000_000)) < share)  # about sample_rows narrow rows
    sample = checkpointed(docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("doc_id", "text", "y"))

    def count(batches):
        counts: dict[bytes, list[int]] = {}
        for batch in batches:
            for text, y in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                for f in features(text.as_py()):
                    counts.setdefault(f, [0, 0])[y] += 1
            if len(counts) > 400_000:
                yield _counted(counts)
                counts = {}
        yield _counted(counts)

    counted = sample.mapInArrow(count, "feature binary, neg long, pos long").groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, other = max(1, size.get(1, 0)), max(1, size.get(0, 0))
    a, b = (F.col("pos") + 0.5) / (toxic + 1.0), (F.col("neg") + 0.5) / (other + 1.0)
    gain = F.abs(F.log(a / b)) * F.sqrt(F.greatest(F.col("pos") / float(toxic), F.col("neg") / float(other)))
    # Common words, about as frequent in both kinds, would only lend long texts weight.
    telling = (F.col("pos") + F.col("neg") >= 3) & (F.abs(F.log(a / b)) >= LEAST_LOG_RATIO)
    best = counted.where(telling).orderBy(gain.desc(), "feature").limit(n_features)
    names = sorted({bytes(r["feature"]) for r in best.select("feature").collect()} | _of_words(set(TERMS)))
    place = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def numbered(batches):
        known = place.value

        def numbers(found):
            return sorted(known[f] for f in found if f in known)

        for batch in sliced(batches):
            own, swaps = [], []
            for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own.append(numbers(features(text)))
                kept = [(term, numbers(go), numbers(come)) for term, go, come in changes(text, y == 0)]
                swaps.append([{"term": t, "go": a, "come": b} for t, a, b in kept if a != b])
            kind = pa.list_(pa.struct([("term", pa.int32()), ("go", pa.list_(pa.int32())), ("come", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), batch.column(2), pa.array(swaps, kind)], names=["own", "y", "swaps"])

    kind = "own array<int>, y int, swaps array<struct<term: int, go: array<int>, come: array<int>>>"
    rows = sample.orderBy("doc_id").mapInArrow(numbered, kind).collect()  # about sample_rows rows
    swaps = [(s["term"], s["go"], s["come"]) for r in rows for s in r["swaps"]]
    return fit([(list(r["own"]), r["y"]) for r in rows], names, swaps, swap_penalty)


def _counted(counts: dict) -> pa.RecordBatch:
    columns = [pa.array(list(counts), pa.binary()), *[pa.array([c[i] for c in counts.values()], pa.int64()) for i in (0, 1)]]
    return pa.RecordBatch.from_arrays(columns, names=["feature", "neg", "pos"])


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """Rows (doc_id, score) for every row of docs; a null or empty text scores as one without features."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in sliced(batches):
            found = [shared.value.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def score_held_out(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) for every row of docs (doc_id, text); labels has doc_id and toxic.

    Learns from labels whose doc_id is not held out. predicted is 1 from the threshold on. Repeated rows are scored alike,
    null ids are held out, an empty table gives no rows, other columns are ignored.
    """
    out = held_out(F.col("doc_id"), 4, 2)
    model = train(docs, labels.where(~out))
    return score(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
