"""Language of documents and of their passages, by hyperdimensional profiles of letters."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditframe.llm.markup import paragraphs
from auditframe.runtime import spread

LANGUAGES = ("en", "de", "fr", "es", "pt", "ru")

# Names by which a delivered label may call a language, in lower case.
LABELS = {
    "en": ("en", "eng", "english", "anglais", "englisch", "inglés", "inglês", "английский"),
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "alemão", "немецкий"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "französisch", "francés", "francês", "французский"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano", "spanisch", "espagnol", "espanhol", "испанский"),
    "pt": ("pt", "por", "portuguese", "português", "portugues", "portugiesisch", "portugais", "portugués", "португальский"),
    "ru": ("ru", "rus", "russian", "русский", "russisch", "russe", "ruso", "russo"),
}

#: Dimensions of a hypervector, and the seed of the random letters.
DIMENSIONS, SEED = 4096, 7

#: Labelled documents for each language, at most, on which the prototypes are fitted.
SAMPLE = 400

#: Words that a passage of one language has at least.
PASSAGE = 30

#: A change of language inside a paragraph has to outweigh the evidence of so many average words.
SWITCH_WORDS = 4.0

# The letters told apart, by code point; any other letter is one more.
_RANGES = ((0x61, 0x7A), (0xDF, 0xF6), (0xF8, 0xFF), (0x153, 0x153), (0x430, 0x44F), (0x451, 0x451))
ALPHABET = {chr(c): 1 + i for i, c in enumerate(c for a, b in _RANGES for c in range(a, b + 1))}
SIZE = len(ALPHABET) + 2

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def trigrams(word: str) -> list[int]:
    """Codes of the letter trigrams of a word between blanks; digits are no letters."""
    letters = [ALPHABET.get(c, SIZE - 1) for c in word if not c.isdigit()]
    if not letters:
        return []
    padded = [0, *letters, 0]
    return [(a * SIZE + b) * SIZE + c for a, b, c in zip(padded, padded[1:], padded[2:])]


@cache
def _letters() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SIZE, DIMENSIONS))


@cache
def _places() -> tuple[np.ndarray, ...]:
    """The letters' vectors for each place in a trigram."""
    return tuple(np.roll(_letters(), k, 1) for k in (2, 1, 0))


def bind(codes: np.ndarray) -> np.ndarray:
    """The hypervectors of trigrams: the letters' vectors, permuted by their place, multiplied."""
    first, second, third = _places()
    return first[codes // SIZE // SIZE] * second[codes // SIZE % SIZE] * third[codes % SIZE]


def bundle(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weighted sum of the trigrams' hypervectors."""
    total = np.zeros(DIMENSIONS, np.float64)
    for i in range(0, len(codes), 2000):
        total += weights[i : i + 2000].astype(np.float32) @ bind(codes[i : i + 2000]).astype(np.float32)
    return total


@dataclass(frozen=True)
class Prototypes:
    """For each language its unit prototype, less what all have in common, and known trigrams' products with each.

    A text's hypervector is the sum of its trigrams', so its products with the prototypes
    are the sums of the trigrams' products, exactly, without forming the text's vector.
    Trigrams that the sample didn't have are multiplied when they first occur.
    """

    languages: tuple[str, ...]
    vectors: np.ndarray
    codes: np.ndarray
    products: np.ndarray
    margin: float

    @staticmethod
    def fit(counts: Mapping[str, Mapping[int, int]]) -> Prototypes:
        """From each language's trigram counts; a language without any gets no prototype."""
        known = tuple(lang for lang in LANGUAGES if counts.get(lang))
        if not known:
            return Prototypes((), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, np.int64), np.zeros((0, 0), np.float32), 0.0)
        own = [(np.array(list(counts[lang]), np.int64), np.array(list(counts[lang].values()), np.float64)) for lang in known]
        p = np.array([bundle(codes, n / n.sum()) for codes, n in own])
        p /= np.linalg.norm(p, axis=1, keepdims=True)
        if len(known) > 1:
            p = p - p.mean(0)
        p = (p / np.linalg.norm(p, axis=1, keepdims=True)).astype(np.float32)
        codes = np.unique(np.concatenate([c for c, _ in own]))
        products = multiplied(codes, p)
        # the average lead, a trigram, of a language over the next in its own text
        means = [n @ products[np.searchsorted(codes, c)] / n.sum() for c, n in own]
        leads = [m[k] - max([x for j, x in enumerate(m) if j != k], default=0.0) for k, m in enumerate(means)]
        return Prototypes(known, p, codes, products, float(np.mean(leads)) * 6)


def multiplied(codes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Each trigram's products with the vectors."""
    parts = [bind(codes[i : i + 2000]).astype(np.float32) @ vectors.T for i in range(0, len(codes), 2000)]
    return np.concatenate(parts) if parts else np.zeros((0, len(vectors)), np.float32)


class _Rows(dict):
    """Keys to rows of a growing table."""

    def __init__(self, width: int):
        super().__init__()
        self.rows = np.zeros((1 << 15, width), np.float32)

    def add(self, key, row: np.ndarray) -> int:
        k = len(self)
        if k == len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        self.rows[k] = row
        self[key] = k
        return k


class TrigramScores(_Rows):
    """Trigram to the row of its products with the prototypes."""

    def __init__(self, prototypes: Prototypes):
        super().__init__(len(prototypes.languages))
        self.vectors = prototypes.vectors
        self.rows = prototypes.products.copy()
        self.update(zip(prototypes.codes.tolist(), range(len(prototypes.codes))))

    def __missing__(self, code: int) -> int:
        return self.add(code, multiplied(np.array([code]), self.vectors)[0])


class WordScores(_Rows):
    """Word to the row of its products with the prototypes; forgotten now and then to stay small."""

    def __init__(self, prototypes: Prototypes):
        super().__init__(len(prototypes.languages))
        self.trigrams = TrigramScores(prototypes)
        self.parts: list[list[int]] = []

    def __missing__(self, word: str) -> int:
        parts = [self.trigrams[c] for c in trigrams(word)]
        self.parts.append(parts)
        return self.add(word, self.trigrams.rows[parts].sum(0))

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > 400_000:
            self.clear()
            self.parts.clear()
        at = [self[w] for w in words]
        return self.rows[at]

    def cosine(self, words: list[str], language: int) -> float:
        """Cosine of a passage with a prototype; its own length is that of a sum of nearly orthogonal trigrams."""
        product = float(self.of(words)[:, language].sum())
        places, times = [], []
        for word, n in Counter(words).items():
            own = self.parts[self[word]]
            places += own
            times += [n] * len(own)
        if not places:
            return 0.0
        counts = np.bincount(places, times)
        return product / float(np.sqrt(DIMENSIONS * (counts @ counts)))


def _path(scores: np.ndarray, penalty: float) -> list[int]:
    """The best sequence of languages for sentences with these scores, each change costing ``penalty``."""
    best, back = scores[0].copy(), []
    for row in scores[1:]:
        k = int(best.argmax())
        stay = best >= best[k] - penalty
        back.append(np.where(stay, np.arange(len(best)), k))
        best = np.where(stay, best, best[k] - penalty) + row
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


def passages(text: str, scores: WordScores, penalty: float) -> list[tuple[int, int, int, int, list[str]]]:
    """(paragraph, first word, number of words, language, words) of the runs of one language in a text's prose."""
    words, ends, spans = [], [], []
    for number, paragraph in enumerate(paragraphs(text)):
        first, begin = len(ends), len(words)
        for sentence in _SENTENCE.split(paragraph.lower()):
            words += _WORD.findall(sentence)
            if len(words) > (ends[-1] if ends else 0):
                ends.append(len(words))
        if len(words) > begin:
            spans.append((number, begin, first, len(ends)))
    if not words:
        return []
    starts = [0, *ends[:-1]]
    summed = np.add.reduceat(scores.of(words), starts, 0)
    best, found = summed.argmax(1).tolist(), []
    for number, begin, first, last in spans:
        path = best[first:last]
        if len(set(path)) > 1:
            path = _path(summed[first:last], penalty)
        since = first
        for i in range(first + 1, last + 1):
            if i == last or path[i - first] != path[since - first]:
                found.append((number, starts[since] - begin, ends[i - 1] - starts[since], path[since - first], words[starts[since] : ends[i - 1]]))
                since = i
    return found


def label_languages(label: Column) -> Column:
    """The languages that a delivered label names, as an array: codes of LANGUAGES, ``other`` for any other word."""
    known = {name: code for code, names in LABELS.items() for name in names}
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    parts = F.filter(F.split(F.lower(label), r"[^\p{L}_-]+"), lambda p: F.regexp_replace(p, "[_-]", "") != "")
    return F.coalesce(F.array_distinct(F.transform(parts, lambda p: F.coalesce(names[p], names[F.regexp_extract(p, r"^\p{L}+", 0)], F.lit("other")))), F.array().cast("array<string>"))


def fit_prototypes(documents: DataFrame, sample: int = SAMPLE) -> Prototypes:
    """Prototypes from at most ``sample`` labelled documents of each language, chosen by the hash of their ids.

    The sample is only for fitting; every document is judged. Trigrams are counted where the texts lie
    and summed per language; what reaches the driver is bounded by the alphabet.
    """
    named = documents.select("doc_id", label_languages(F.col("lang")).alias("named")).filter("size(named) = 1 and named[0] <> 'other'")
    by_hash = Window.partitionBy("code").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = named.select("doc_id", F.col("named")[0].alias("code")).withColumn("n", F.row_number().over(by_hash)).filter(F.col("n") <= sample)
    chosen = chosen.groupBy("doc_id").agg(F.min("code").alias("code"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            total: dict[tuple[str, int], int] = {}
            for code, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                for paragraph in paragraphs(text or ""):
                    for word in _WORD.findall(paragraph.lower()):
                        for t in trigrams(word):
                            total[code, t] = total.get((code, t), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int32()), pa.array(list(total.values()), pa.int64())], ["code", "trigram", "n"])

    texts = spread(documents.select("doc_id", "text")).join(F.broadcast(chosen), "doc_id").select("code", "text")
    counts: dict[str, dict[int, int]] = {}
    for code, t, n in texts.mapInArrow(count, "code string, trigram int, n bigint").groupBy("code", "trigram").agg(F.sum("n")).collect():
        counts.setdefault(code, {})[t] = n
    return Prototypes.fit(counts)


def find_passages(documents: DataFrame, prototypes: Prototypes, every: bool = True) -> DataFrame:
    """``(doc_id, paragraph_no, first_word, n_words, lang, confidence)`` of every run of one language within a paragraph.

    Only connected prose is read, whole texts of it, and nothing is shuffled. ``confidence`` is
    the cosine of the run with its language's prototype. Without ``every``, runs shorter
    than ``PASSAGE`` words are left out. Null and empty texts, and texts without prose, have no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(prototypes)
    names = ["doc_id", "paragraph_no", "first_word", "n_words", "lang", "confidence"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64()]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Prototypes = shared.value
        scores = WordScores(p)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not p.languages:
                    continue
                for number, first, n, k, words in passages(text.as_py() or "", scores, SWITCH_WORDS * p.margin):
                    if every or n >= PASSAGE:
                        rows.append((key, number, first, n, p.languages[k], scores.cosine(words, k)))
            columns = list(zip(*rows)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names)

    return spread(documents.select(F.col("doc_id").cast("bigint"), "text")).mapInArrow(find, "doc_id bigint, paragraph_no int, first_word int, n_words int, lang string, confidence double")


def document_languages(documents: DataFrame, prototypes: Prototypes | None = None) -> DataFrame:
    """``(doc_id, named, held, words, confidence)``: the languages a label names, those held, and their words and confidence.

    A document holds a language if it has a run of ``PASSAGE`` or more words of it within
    one paragraph. ``held``, ``words`` and ``confidence`` go together, most words first (ties:
    by name); they are empty for a document without such a run. Every document has a row, repeated
    rows repeated ones. Columns other than doc_id, text and lang aren't read.
    """
    prototypes = prototypes or fit_prototypes(documents)
    shared = documents.sparkSession.sparkContext.broadcast(prototypes)
    kinds = [pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.float64())]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Prototypes = shared.value
        scores = WordScores(p)
        for batch in batches:
            held, counts, sure = [], [], []
            for text in batch.column(2):
                found: dict[int, list[str]] = {}
                if p.languages:
                    for _, _, n, k, words in passages(text.as_py() or "", scores, SWITCH_WORDS * p.margin):
                        if n >= PASSAGE:
                            found.setdefault(k, []).extend(words)
                order = sorted(found, key=lambda k: (-len(found[k]), p.languages[k]))
                held.append([p.languages[k] for k in order])
                counts.append([len(found[k]) for k in order])
                sure.append([scores.cosine(found[k], k) for k in order])
            columns = [pa.array(c, kind) for c, kind in zip((held, counts, sure), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "named", "held", "words", "confidence"])

    rows = spread(documents.select("doc_id", "lang", "text")).select(F.col("doc_id").cast("bigint"), label_languages(F.col("lang")).alias("named"), "text")
    return rows.mapInArrow(judge, "doc_id bigint, named array<string>, held array<string>, words array<bigint>, confidence array<double>")


def mislabelled(judged: DataFrame) -> DataFrame:
    """``(doc_id, lang)``: a row for each language held by a document whose label isn't just that language."""
    wrong = judged.filter("size(held) > 0 and not (size(held) = 1 and named = held)")
    return wrong.select("doc_id", F.explode("held").alias("lang"))
