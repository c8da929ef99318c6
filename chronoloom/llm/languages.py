"""Languages of texts, word by word, with spans of each language in mixed texts.

Words are runs of letters and marks of one script. The ranges of the script leave those languages as candidates that
were learned with it; each candidate scores a word by its grams of 1 to 4 characters, hashed to slots. Viterbi's algorithm
then labels the words of a text: changing the language between two words costs a penalty, so a few odd words do not
break a span. The text's language is the one with the most letters.

Texts pass through numpy in slices of about ``SLICE`` characters; a step of Viterbi takes one word of every text of a slice,
in arrays, and texts of like length share a slice.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import fresh_name

ORDERS = 4
SLOT_BITS = 15
#: Characters that pass through the arrays together; a longer text is a slice of its own.
SLICE = 1 << 20
#: A run without spaces is scored in pieces of so many characters.
PIECE = 24
#: A language is a candidate for a script with this share of its letters, or more.
SCRIPT_SHARE = 0.01
UNKNOWN = "und"
#: Ranges of the scripts of Unicode that are told apart; all other letters count as one script.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F), ("arabic", 0x8A0, 0x8FF),
    ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF), ("oriya", 0xB00, 0xB7F),
    ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF), ("malayalam", 0xD00, 0xD7F), ("sinhala", 0xD80, 0xDFF),
    ("thai", 0xE00, 0xE7F), ("lao", 0xE80, 0xEFF), ("tibetan", 0xF00, 0xFFF), ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF), ("ethiopic", 0x1200, 0x139F), ("khmer", 0x1780, 0x17FF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0x20000, 0x323AF),
)
NAMES = ("other", *dict.fromkeys(name for name, _, _ in SCRIPTS))
_SLOTS = 1 << SLOT_BITS


@cache
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every code point: kind (2 letter, 1 mark, 0 else), lower case where that is one character, script."""
    every = [chr(c) for c in range(0x110000)]
    kind = np.array([{"L": 2, "M": 1}.get(unicodedata.category(c)[0], 0) for c in every], np.uint8)
    lower = np.array([ord(low) if len(low := c.lower()) == 1 else ord(c) for c in every], np.uint32)
    script = np.zeros(0x110000, np.uint8)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = NAMES.index(name)
    return kind, lower, script


@dataclass
class Words:
    """Words of several texts in order: where each begins and ends in its text, its text, script, and its grams."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    gram_word: list[np.ndarray]
    gram_slot: list[np.ndarray]


def cut_words(texts: list[str]) -> Words:
    kind, lower, script = _characters()
    # Texts are joined by a character that is no letter, so no word crosses two of them.
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.cumsum([0, *[len(t) + 1 for t in texts]])
    inside, letter = kind[points] > 0, kind[points] == 2
    scripts = script[points]
    before = lambda x: np.concatenate([[0], x[:-1]]).astype(x.dtype)
    starts = inside & (~before(inside) | (letter & before(letter) & (scripts != before(scripts))))
    at = np.arange(len(points))
    run = np.maximum.accumulate(np.where(starts, at, 0))
    starts |= inside & ((at - run) % PIECE == 0)
    number = np.cumsum(starts) - 1
    n = int(number[-1]) + 1 if len(number) else 0
    places, of = np.flatnonzero(inside), number[inside]
    size = np.bincount(of, minlength=n)
    letters = np.bincount(of, weights=letter[inside], minlength=n) > 0
    # Runs of marks alone are no words.
    keep = letters[of]
    places, of = places[keep], (np.cumsum(letters) - 1)[of[keep]]
    size, start = size[letters], np.flatnonzero(starts)[letters]
    text = np.searchsorted(bounds, start, "right") - 1
    word_script = np.zeros(len(size), np.uint8)
    word_script[of[letter[places]]] = scripts[places[letter[places]]]
    # Every word stands between two blanks (0) of its own.
    padded, word = np.zeros(len(places) + 2 * len(size), np.uint32), np.repeat(np.arange(len(size)), size + 2)
    padded[np.arange(len(places)) + 2 * of + 1] = lower[points[places]]
    grams, slots, mixed = [], [], np.zeros(len(padded), np.uint32)
    for order in range(1, ORDERS + 1):
        size_here = max(len(padded) - order + 1, 0)
        mixed = (mixed[:size_here] * np.uint32(0x01000193)) ^ (padded[order - 1 :] * np.uint32(0x9E3779B1))
        whole = word[:size_here] == word[order - 1 :]
        spread = mixed[whole] * np.uint32(0x85EBCA6B)
        grams.append(word[:size_here][whole])
        slots.append(((spread ^ spread >> np.uint32(15)) >> np.uint32(32 - SLOT_BITS)).astype(np.int64) + (order - 1) * _SLOTS)
    return Words(text, start - bounds[text], start - bounds[text] + size, word_script, grams, slots)


def slices(texts: list[str]) -> Iterator[list[int]]:
    """Places of texts, shortest first, in slices of about :data:`SLICE` characters."""
    held, chars = [], 0
    for i in sorted(range(len(texts)), key=lambda i: len(texts[i])):
        if held and chars + len(texts[i]) > SLICE:
            yield held
            held, chars = [], 0
        held.append(i)
        chars += len(texts[i])
    if held:
        yield held


@dataclass
class Model:
    """Languages in order of name, log chances of slots by language, candidates by script, log share of each language."""

    languages: list[str]
    table: np.ndarray
    candidates: np.ndarray
    prior: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        """(word, language): mean over the orders of the log chance of the word's grams; far down for no candidate."""
        out = np.zeros((len(words.text), len(self.languages)), np.float32)
        for of, slot in zip(words.gram_word, words.gram_slot, strict=True):
            if len(of):
                first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                out[of[first]] += np.add.reduceat(self.table[slot], first, axis=0)
        out /= ORDERS
        able = self.candidates[words.script]
        # A script that no language was learned with tells nothing.
        able |= ~able.any(axis=1, keepdims=True)
        unseen = ~self.candidates.any(axis=1)[words.script]
        out[unseen] = 0
        return np.where(able, out, out.min(axis=1, keepdims=True, initial=0) - 50)


def viterbi(scores: np.ndarray, begin: np.ndarray, count: np.ndarray, prior: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of the rows of ``scores``: text i has the ``count[i]`` rows from ``begin[i]`` (one at least); a change of label costs ``penalty``."""
    order = np.argsort(-count, kind="stable")
    begin, count = begin[order], count[order]
    active = np.searchsorted(-count, -np.arange(1, count[0] + 1), "right")
    own = np.arange(scores.shape[1])
    came = np.zeros(scores.shape, np.int16)
    value = prior + scores[begin]
    for step in range(1, count[0]):
        n = active[step]
        here, rows = value[:n], begin[:n] + step
        best = here.argmax(axis=1)
        moved = here[np.arange(n), best][:, None] - penalty
        stays = here >= moved
        came[rows] = np.where(stays, own, best[:, None])
        value[:n] = np.where(stays, here, moved) + scores[rows]
    label, now = np.zeros(len(scores), np.int64), value.argmax(axis=1)
    for step in range(count[0] - 1, -1, -1):
        n = active[step]
        rows = begin[:n] + step
        label[rows] = now[:n]
        now[:n] = came[rows, now[:n]]
    return label


def _labelled(texts: list[str], model: Model, penalty: float) -> tuple[list[str], np.ndarray, list[list[dict]]]:
    """Language, score and spans of each text."""
    n, k = len(texts), len(model.languages)
    names, score, spans = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
    words = cut_words(texts)
    if not len(words.text) or not k:
        return names, score, spans
    scores = model.scores(words)
    some, begin, count = np.unique(words.text, return_index=True, return_counts=True)
    label = viterbi(scores, begin, count, model.prior, penalty)
    size = (words.end - words.start).astype(np.float64)
    place = np.repeat(np.arange(len(some)), count)
    letters = np.bincount(place * k + label, weights=size, minlength=len(some) * k).reshape(-1, k)
    best = letters.argmax(axis=1)
    its_own = label == best[place]
    total = np.stack([np.bincount(place, weights=np.where(its_own, scores[:, j], 0), minlength=len(some)) for j in range(k)], axis=1) + model.prior
    rivals = np.exp(np.clip(total - total[np.arange(len(some)), best][:, None], -60, 60)).sum(axis=1)
    found = letters[np.arange(len(some)), best] / letters.sum(axis=1) / rivals
    for i, b, s in zip(some.tolist(), best.tolist(), found.tolist(), strict=True):
        names[i], score[i] = model.languages[b], min(s, 1.0)
    edge = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (words.text[1:] != words.text[:-1])]))
    last = np.concatenate([edge[1:], [len(label)]]) - 1
    for i, a, b, which in zip(words.text[edge].tolist(), words.start[edge].tolist(), words.end[last].tolist(), label[edge].tolist(), strict=True):
        spans[i].append({"start": a, "end": b, "lang": model.languages[which]})
    return names, score, spans


def held_out(id_col: str, parts: int = 4, part: int = 2):
    """Whether crc32(id as text) modulo ``parts`` is ``part``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def fit(docs: DataFrame, *, per_language: int = 2000, max_languages: int = 256, smoothing: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Gram counts of each language, from whole texts of a sample of the rows that are not held out.

    :param per_language: rows expected in the sample of each language, chosen by the hash of their ids; languages with fewer
        rows give all of theirs.
    :param max_languages: languages learned, those with the most rows; the model's size is this times the slots.

    Rows with a null text, language or id teach nothing. Tasks count their own rows; the driver gets one number a language and slot.
    """
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("h"))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((ORDERS * _SLOTS, 0), np.float32), np.zeros((len(NAMES), 0), bool), np.zeros(0))
    # One short row for each language, bounded by ``max_languages``.
    shares = docs.sparkSession.createDataFrame([(n, i, min(per_language / sizes[n], 1.0)) for i, n in enumerate(languages)], "lang string, number int, share double")
    sample = known.join(F.broadcast(shares), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("number", "text")
    width = ORDERS * _SLOTS + len(NAMES)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            numbers, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for part in slices(texts):
                for number in np.unique(numbers[part]).tolist():
                    words = cut_words([texts[i] for i in part if numbers[i] == number])
                    total = seen.setdefault(number, np.zeros(width, np.int64))
                    total += np.bincount(np.concatenate(words.gram_slot), minlength=width)
                    total[ORDERS * _SLOTS :] += np.bincount(words.script, weights=words.end - words.start, minlength=len(NAMES)).astype(np.int64)
        for number, total in seen.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), number, np.int32)), pa.array(used), pa.array(total[used])], names=["number", "slot", "n"])

    counts = sample.mapInArrow(count, "number int, slot bigint, n bigint").groupBy("number", "slot").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros((width, len(languages)))
    seen[counts["slot"].to_numpy(), counts["number"].to_numpy()] = counts["n"].to_numpy()
    grams = seen[: ORDERS * _SLOTS].reshape(ORDERS, _SLOTS, -1)
    table = np.log((grams + smoothing) / (grams.sum(axis=1, keepdims=True) + smoothing * _SLOTS)).reshape(ORDERS * _SLOTS, -1)
    letters = seen[ORDERS * _SLOTS :]
    share = letters / np.maximum(letters.sum(axis=0), 1)
    prior = np.log(np.array([sizes[n] for n in languages]) / sum(sizes.values()))
    return Model(languages, table.astype(np.float32), share >= SCRIPT_SHARE, prior)


def label(docs: DataFrame, model: Model, *, penalty: float = 6.0, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``spans``.

    :param penalty: what a change of language costs between two words, in natural log units of chance.

    ``spans`` are the maximal runs of words of one language, as places in code points (end not included). ``score`` is the share
    of letters in spans of ``lang_pred``, times that language's chance against the others in them. A null text, and one without a
    letter, is ``und`` with score 0 and no spans; so is every text if nothing was learned. A script that no language
    was learned with decides nothing: such words take the language beside them, or the most frequent one. Columns
    of ``docs`` with the names of the added ones are replaced; repeated rows are each labelled.
    """
    base = docs.drop("lang_pred", "score", "spans")
    names = [*base.columns, "lang_pred", "score", "spans"]
    work = fresh_name(base, "text_to_label")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            found, score, spans = [UNKNOWN] * len(texts), np.zeros(len(texts)), [None] * len(texts)
            for part in slices(texts):
                for i, *made in zip(part, *_labelled([texts[i] for i in part], model, penalty), strict=True):
                    found[i], score[i], spans[i] = made
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string()), pa.array(score), pa.array(spans, span)], names=names)

    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", spans)])
    return base.withColumn(work, F.col(text_col)).mapInArrow(run, schema)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", penalty: float = 6.0, **options) -> DataFrame:
    """(id, held_out, lang_pred, score, spans) of every row, learned from the rows that are not held out."""
    model = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    made = label(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model, penalty=penalty)
    return made.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score", "spans")
