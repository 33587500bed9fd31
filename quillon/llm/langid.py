"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary. Each language has a probability for each piece; a word's probability is
the sum over all its segmentations into pieces of the product of their probabilities, which the forward algorithm adds up
from left to right. Training is expectation maximisation: forward-backward gives the expected uses of each piece in the
word counts of a bounded sample of labelled documents; the counts are made and summed in Spark, and only the table of
pieces by languages comes to the driver. Words are whole runs of letters of the lower-cased text, however long; sums are
scaled along the word so that they stay in range. A text's log-probability is the sum over its words.
"""

from __future__ import annotations

import base64
import math
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from quillon.llm.common import checkpointed, sliced

TRAIN_DOCS = 1000  # about so many labelled documents of each language are read for training
CACHE_WORDS = 300_000
LONG_BYTES = 64  # longer words are summed one by one; the sums are the same
EVERY = 16  # letters between two scalings
_SPACES = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read_pieces(path: str) -> list[bytes]:
    """The vocabulary's pieces that lower-cased words can hold: letters, with a space at most in front."""
    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f]
    return [p for p in pieces if p == b" " or (w := p.removeprefix(b" ")) and w.translate(_SPACES) == w and b" " not in w]


def words_of(text: str) -> list[bytes]:
    """The runs of letters of the lower-cased text, marks that combine with letters included."""
    text = text.lower()
    if not text.isascii():
        for c in set(text):
            if c > "\x7f" and not c.isalpha() and unicodedata.category(c)[0] != "M":
                text = text.replace(c, " ")
    return text.encode("utf-8", "replace").translate(_SPACES).split()


class Pieces:
    """A trie of the pieces in a hash table, walked for many words at once."""

    def __init__(self, pieces: list[bytes]) -> None:
        edges: dict[int, int] = {}
        piece = [-1]
        for number, p in enumerate(pieces):
            node = 0
            for byte in p:
                key = node << 8 | byte
                if key not in edges:
                    edges[key] = len(piece)
                    piece.append(-1)
                node = edges[key]
            piece[node] = number
        self.longest = max(map(len, pieces), default=1)
        self.piece = np.array(piece, dtype=np.int64)
        bits = max(4, (4 * len(edges)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.nodes = np.full(1 << bits, -1, dtype=np.int64)
        slots = self._slots(np.fromiter(edges, dtype=np.int64, count=len(edges)))
        for (key, node), slot in zip(edges.items(), slots.tolist(), strict=True):
            while self.keys[slot] != -1:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.nodes[slot] = key, node

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The children; -1 where there is none."""
        keys = nodes << 8 | letters
        slots = self._slots(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.nodes[slots], -1)
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & self.mask
            found = self.keys[slots[todo]]
            out[todo] = np.where(found == keys[todo], self.nodes[slots[todo]], -1)
            todo = todo[(found != keys[todo]) & (found != -1)]
        return out

    def matches(self, letters: np.ndarray):
        """(start, end, words, pieces) of all pieces in a matrix of words of equal length."""
        n, length = letters.shape
        for s in range(length):
            rows, nodes = np.arange(n), np.zeros(n, dtype=np.int64)
            for e in range(s, min(length, s + self.longest)):
                nodes = self.step(nodes, letters[rows, e].astype(np.int64))
                alive = nodes >= 0
                rows, nodes = rows[alive], nodes[alive]
                if not len(rows):
                    break
                pieces = self.piece[nodes]
                whole = pieces >= 0
                yield s, e + 1, rows[whole], pieces[whole]


    def edges(self, letters: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each place of one long word, (end, piece) of the pieces that start there; walked from all places at once."""
        found: list[list[tuple[int, int]]] = [[] for _ in letters]
        places, nodes = np.arange(len(letters)), np.zeros(len(letters), dtype=np.int64)
        for step in range(self.longest):
            inside = places + step < len(letters)
            places, nodes = places[inside], nodes[inside]
            nodes = self.step(nodes, letters[places + step].astype(np.int64))
            places, nodes = places[nodes >= 0], nodes[nodes >= 0]
            if not len(places):
                break
            pieces = self.piece[nodes]
            for s, p in zip(places[pieces >= 0].tolist(), pieces[pieces >= 0].tolist(), strict=True):
                found[s].append((s + step + 1, p))
        return found


def _matrices(words: list[bytes], rows: int = 20_000):
    """(places, matrix of bytes) of words of equal length, each with a space in front; longer ones fewer at once."""
    lengths: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        lengths.setdefault(len(w) + 1, []).append(i)
    for length, places in lengths.items():
        step = max(1, rows * EVERY // max(EVERY, length))
        for at in range(0, len(places), step):
            part = places[at : at + step]
            matrix = np.frombuffer(b"".join(b" " + words[i] for i in part), dtype=np.uint8).reshape(len(part), length)
            yield np.array(part), matrix


def _padded(words: list[bytes], languages: int, values: int = 1 << 22):
    """(places, matrix of bytes, lengths) of long words with a space in front, words of about equal length together.

    Shorter ones end in zeros, which no piece holds, so their sums stay those of their own letters. A matrix is held to
    about `values` sums, or one word.
    """
    order, at = sorted(range(len(words)), key=lambda i: len(words[i])), 0
    while at < len(order):
        end, least = at + 1, len(words[order[at]])
        while end < len(order) and len(words[order[end]]) <= 1.25 * least and (end + 1 - at) * (len(words[order[end]]) + 2) * languages <= values:
            end += 1
        part = order[at:end]
        size = len(words[part[-1]]) + 1
        letters = np.frombuffer(b"".join((b" " + words[i]).ljust(size, b"\0") for i in part), dtype=np.uint8).reshape(len(part), size)
        yield np.array(part), letters, np.array([len(words[i]) + 1 for i in part])
        at = end


def _swept(pieces: Pieces, p: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward sums (places x words x languages), and the log of what each stretch of EVERY places was divided by.

    Sums that are still open, over the longest piece, are divided together, which changes no ratio between them.
    """
    n, length = letters.shape
    alpha = np.zeros((length + 1, n, p.shape[1]))
    alpha[0] = 1.0
    logs = np.zeros((length // EVERY + 1, n, p.shape[1]))
    done = 0
    for s, e, rows, found in pieces.matches(letters):
        while s >= (done + 1) * EVERY:
            done += 1
            at = slice(done * EVERY, done * EVERY + pieces.longest)
            top = alpha[at].max(axis=0)
            top = np.where(top > 0, top, 1.0)
            alpha[at] /= top
            logs[done] = logs[done - 1] + np.log(top)
        alpha[e, rows] += alpha[s, rows] * p[found]
    for i in range(done + 1, len(logs)):
        logs[i] = logs[done]
    return alpha, logs


def _chain(edges: list[list[tuple[int, int]]], p: np.ndarray, k: int) -> tuple[list[float], list[float]]:
    """One word's forward sums under language k, each divided by exp of the log beside it."""
    n, column = len(edges), p[:, k].tolist()
    sums, logs, base = [0.0] * (n + 1), [0.0] * (n + 1), 0.0
    sums[0] = 1.0
    top = max((e for out in edges[:1] for e, _ in out), default=0)
    for s in range(n):
        if s % EVERY == 0 and s:
            # The sums at and after s that are not yet zero lie before `top`.
            if (most := max(sums[s : top + 1], default=0.0)) > 0:
                for i in range(s, top + 1):
                    sums[i] /= most
                base += math.log(most)
        logs[s] = base
        here = sums[s]
        for e, piece in edges[s]:
            sums[e] += here * column[piece]
            top = max(top, e)
    logs[n] = base
    return sums, logs


def _back(edges: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """The same word read from its end."""
    n = len(edges)
    found: list[list[tuple[int, int]]] = [[] for _ in edges]
    for s, out in enumerate(edges):
        for e, piece in out:
            found[n - e].append((n - s, piece))
    return found


def _letters(word: bytes) -> np.ndarray:
    return np.frombuffer(b" " + word, dtype=np.uint8)


def _parted(words: list[bytes]) -> tuple[list[int], list[int]]:
    """Places of the words of at most LONG_BYTES, and of the longer ones."""
    return [i for i, w in enumerate(words) if len(w) <= LONG_BYTES], [i for i, w in enumerate(words) if len(w) > LONG_BYTES]


def forward(pieces: Pieces, p: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Log-probabilities (words x languages), summed over all segmentations; p is pieces x languages."""
    out = np.empty((len(words), p.shape[1]))
    short, long = _parted(words)
    short = np.array(short, dtype=np.int64)
    with np.errstate(divide="ignore"):
        for places, letters in _matrices([words[i] for i in short]):
            alpha, logs = _swept(pieces, p, letters)
            out[short[places]] = np.log(alpha[-1]) + logs[-1]
        for places, letters, ends in _padded([words[i] for i in long], p.shape[1]):
            alpha, logs = _swept(pieces, p, letters)
            at = np.arange(len(places))
            out[np.array(long)[places]] = np.log(alpha[ends, at]) + logs[ends // EVERY, at]
    return out


def expected_counts(pieces: Pieces, p: np.ndarray, words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece (pieces x languages) in words that occur counts (words x languages) times."""
    out = np.zeros_like(p)
    short, long = _parted(words)
    short = np.array(short, dtype=np.int64)
    for places, letters in _matrices([words[i] for i in short], 5_000):
        own = counts[short[places]]
        found = list(pieces.matches(letters))
        alpha, logs = _swept(pieces, p, letters)
        # A backward sum is divided by what the stretches after its own were divided by, so that products share one divisor.
        beta = np.zeros_like(alpha)
        beta[-1] = 1.0

        def steps(s, e, rows, which, logs=logs):
            apart = s // EVERY, e // EVERY
            return p[which] if apart[0] == apart[1] else p[which] * np.exp(logs[apart[0]][rows] - logs[apart[1]][rows])

        for match in sorted(found, key=lambda x: -x[0]):
            s, e, rows, _ = match
            beta[s, rows] += beta[e, rows] * steps(*match)
        weight = own / alpha[-1]
        for match in found:
            s, e, rows, which = match
            np.add.at(out, which, alpha[s, rows] * steps(*match) * beta[e, rows] * weight[rows])
    for i in long:
        edges = pieces.edges(_letters(words[i]))
        back = _back(edges)
        for k in np.flatnonzero(counts[i]):
            sums, logs = _chain(edges, p, k)
            tail, more = _chain(back, p, k)
            total, n = math.log(sums[-1]) + logs[-1], len(edges)
            for s, ends in enumerate(edges):
                for e, piece in ends:
                    if sums[s] and tail[n - e]:
                        out[piece, k] += counts[i, k] * p[piece, k] * math.exp(math.log(sums[s]) + math.log(tail[n - e]) + logs[s] + more[n - e] - total)
    return out


def train(labelled: DataFrame, vocabulary: str | None = None, docs_per_language: int = TRAIN_DOCS, rounds: int = 3, smoothing: float = 0.1) -> tuple[list[str], list[bytes], np.ndarray]:
    """(languages, pieces, probabilities: pieces x languages) from labelled (doc_id, text, lang).

    Reads about docs_per_language documents of each language, chosen by a hash of doc_id. Rows with a null doc_id, text or
    lang teach nothing. Without labelled rows there is no language.
    """
    labelled = labelled.where("doc_id is not null and text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    languages = sorted(sizes)
    pieces = read_pieces(vocabulary or vocabulary_path())
    p = np.full((len(pieces), max(1, len(languages))), 1.0 / len(pieces))
    if not languages:
        return [], pieces, p
    place = {x: i for i, x in enumerate(languages)}
    share = F.create_map(*[F.lit(v) for x, n in sizes.items() for v in (x, int(1_000_000 * min(1.0, docs_per_language / n)) + 1)])
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < share[F.col("lang")])

    def count(batches):
        counts: dict[tuple[bytes, int], int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                k = place[lang]
                for w in words_of(text.as_py()):
                    counts[w, k] = counts.get((w, k), 0) + 1
            if len(counts) > CACHE_WORDS:
                yield _rows(counts)
                counts = {}
        yield _rows(counts)

    def _rows(counts):
        return pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in counts], pa.binary()), pa.array([k for _, k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["word", "k", "n"]
        )

    counted = sample.select("lang", "text").mapInArrow(count, "word binary, k int, n long").groupBy("word", "k").agg(F.sum("n").alias("n"))
    counted = checkpointed(counted.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("by")))
    trie = labelled.sparkSession.sparkContext.broadcast(Pieces(pieces))
    for _ in range(rounds):
        shared = labelled.sparkSession.sparkContext.broadcast(p)

        def expect(batches, shared=shared):
            total = np.zeros_like(shared.value)
            for batch in batches:
                words = batch.column(0).to_pylist()
                counts = np.zeros((len(words), total.shape[1]))
                for i, by in enumerate(batch.column(1).to_pylist()):
                    for k, n in by:
                        counts[i, k] = n
                total += expected_counts(trie.value, shared.value, words, counts)
            which, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(k), pa.array(total[which, k])], names=["piece", "k", "c"])

        found = counted.coalesce(labelled.sparkSession.sparkContext.defaultParallelism).mapInArrow(expect, "piece long, k long, c double").groupBy("piece", "k").agg(F.sum("c").alias("c"))
        c = np.full_like(p, smoothing)
        got = found.toPandas()  # at most pieces x languages rows
        c[got["piece"].to_numpy(), got["k"].to_numpy()] += got["c"].to_numpy()
        p = c / c.sum(axis=0)
        shared.unpersist()
    return languages, pieces, p


class Scorer:
    """Texts to (language, score), with the words' log-probabilities kept in a bounded cache."""

    def __init__(self, model: tuple) -> None:
        self.languages, pieces, self.p = model
        self.pieces = Pieces(pieces)
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.logs = np.empty((0, self.p.shape[1]))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        words = [words_of(t) if t else [] for t in texts]
        new = list(set().union(*words).difference(self.place))
        if len(self.place) + len(new) > CACHE_WORDS:
            self._clear()
            new = list(set().union(*words))
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.logs = np.concatenate([self.logs, forward(self.pieces, self.p, new)])
        out = []
        for text, own in zip(texts, words, strict=True):
            if not self.languages or not own or not any(map(str.isalpha, text)):
                out.append(("und", 0.0))
                continue
            logs = self.logs[np.fromiter(map(self.place.__getitem__, own), dtype=np.int64, count=len(own))].sum(axis=0)
            best = int(logs.argmax())
            out.append((self.languages[best], float(1.0 / np.exp(logs - logs[best]).sum())))
        if sum(len(w) for w in new if len(w) > LONG_BYTES) > 1_000_000:  # the cache is to stay small
            self._clear()
        return out


def identify(docs: DataFrame, model: tuple, keep_rows: bool = False) -> DataFrame:
    """Rows (doc_id, lang_pred, score) for every row of docs, and with keep_rows the whole input row as the struct row.

    lang_pred is the language under which the whole text is likeliest, score its probability if all languages are equally
    likely beforehand. A text that is null or has no letter gives `und` with score 0, and so does any text if no language
    was learned. Null ids and repeated rows are kept as they are; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct("*").alias("row") if keep_rows else F.col("text"))
    schema = StructType([StructField("doc_id", LongType()), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    if keep_rows:
        schema = schema.add("row", chosen.schema["row"].dataType)

    def run(batches):
        score = Scorer(shared.value)
        for batch in sliced(batches):
            found, part, size = [], [], 0
            for text in batch.column(1).field("text") if keep_rows else batch.column(1):
                part.append(text.as_py())
                size += len(part[-1] or "")
                if size > 1_000_000:
                    found += score(part)
                    part, size = [], 0
            found += score(part)
            columns = [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64()), *([batch.column(1)] if keep_rows else [])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", *["row"] * keep_rows])

    return chosen.mapInArrow(run, schema)


def held_out(doc_id, folds: int = 5, fold: int = 0):
    """Whether crc32 of doc_id as text leaves the remainder `fold`; rows with a null doc_id are held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(True))


def identify_held_out(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score): learns from the rows that are not held out and predicts every row."""
    model = train(docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"))), vocabulary)
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
