"""Language identification by unigram models that sum over all segmentations.

A fixed public vocabulary of pieces gives, for each language, a unigram model: a probability for each piece. The
probability of a word is the sum over all its segmentations into pieces of the product of their probabilities, by the
forward algorithm; words are independent, so a text's log-probability is a sum over its words. Expectation maximisation
(forward and backward over a bounded sample of labelled texts) learns the probabilities.

A word is a run of letters, lower-cased, behind the mark of a word's start. The sums of words over MAX_WORD letters are
rescaled as they go, so they don't underflow. Every letter is a piece, a rare one with the least probability, so each word has
a segmentation.

A text's score is its language's share of the probability per word (the geometric mean over its words), which does not
saturate with the length of the text as the probability of all of it does.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .shared import give_back, runs

MARK = "▁"
MAX_WORD = 24
#: Labelled documents learned from: so many of each language, so many in all, of at most so many characters.
SAMPLE_PER_LANGUAGE, SAMPLE_IN_ALL, SAMPLE_CHARS = 400, 4_000, 20_000
#: Words whose scores a task keeps; past it the cache starts anew.
CACHE_WORDS = 200_000

#: Share of a piece that a language's sample doesn't hold.
RARE = 2e-8

_WORDS = re.compile(r"[^\W\d_]+")
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_STEP = np.uint64(0x100000001B3)


def public_pieces(path: str | None = None) -> list[str]:
    """The pieces of a public vocabulary that can lie in a lower-case word: letters, perhaps behind the mark."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = dict.fromkeys(model.id_to_piece(i) for i in range(model.get_piece_size()))
    return [x for x in found if (x == MARK or (body := x.removeprefix(MARK)).isalpha() and body == body.lower())]


class PieceTable:
    """Finds the piece, if any, at each place of many words at once: two hash tables of one slot a key."""

    BITS = 18

    def __init__(self, pieces: list[str]):
        self.pieces, self.longest = pieces, max(map(len, pieces))
        keys = np.array([self._key(x) for x in pieces], np.uint64)
        left, self.slots = np.arange(len(pieces)), []
        for m in _MULTIPLIERS:
            slot = (keys[left] * m) >> np.uint64(64 - self.BITS)
            _, first = np.unique(slot, return_index=True)
            at, ids = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, len(pieces), np.int32)
            at[slot[first]], ids[slot[first]] = keys[left[first]], left[first]
            self.slots.append((m, at, ids))
            left = np.delete(left, first)
            if not len(left):
                break
        if len(left):
            raise ValueError("too many pieces share their slots")

    @staticmethod
    def _key(piece: str) -> int:
        key = 0xCBF29CE484222325
        for c in piece:
            key = ((key ^ ord(c)) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        return key

    def find(self, codes: np.ndarray) -> list[list[np.ndarray]]:
        """codes: words of one length, a row each. Gives at [start][length - 1] the piece ids; len(pieces) is none."""
        n, width = codes.shape
        none, found = len(self.pieces), []
        for start in range(width):
            key, row = np.full(n, 0xCBF29CE484222325, np.uint64), []
            for end in range(start, min(width, start + self.longest)):
                key = (key ^ codes[:, end]) * _STEP
                ids = np.full(n, none, np.int32)
                for m, at, own in self.slots:
                    slot = (key * m) >> np.uint64(64 - self.BITS)
                    hit = at[slot] == key
                    ids[hit] = own[slot[hit]]
                row.append(ids)
            found.append(row)
        return found


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, code points with the mark in front), one pair for each length of word, some thousands of words at once."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(order) else ():
        for k in range(0, len(part), 20_000):
            at = part[k : k + 20_000]
            text = "".join(MARK + words[i] for i in at)
            yield at, np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(at), -1).astype(np.uint64)


@dataclass
class LanguageModel:
    """probabilities: a row for each piece and a last one for a letter that isn't a piece; a column for each language."""

    languages: list[str]
    pieces: list[str]
    probabilities: np.ndarray

    def __post_init__(self):
        self.table = PieceTable(self.pieces)

    def __reduce__(self):
        return LanguageModel, (self.languages, self.pieces, self.probabilities)

    def _forward(self, codes: np.ndarray, p: np.ndarray) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
        """Sums over the segmentations of each word's first j letters, for all j; p: a row for each piece, the last for a
        letter that is none and one more of zeros. For words of at most MAX_WORD letters, so that nothing underflows."""
        n, width = codes.shape
        found, none = self.table.find(codes), len(self.pieces)
        for row in found:
            row[0][row[0] == none] = none  # a letter that isn't a piece takes the row of rare ones
            for ids in row[1:]:
                ids[ids == none] = none + 1
        sums = [np.ones((n, p.shape[1]))]
        for end in range(1, width + 1):
            total = np.zeros((n, p.shape[1]))
            for start in range(max(0, end - self.table.longest), end):
                ids = found[start][end - start - 1]
                if end - start == 1:
                    total += sums[start] * p[ids]
                elif len(hit := np.flatnonzero(ids <= none)):
                    total[hit] += sums[start][hit] * p[ids[hit]]
            sums.append(total)
        return sums, found

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word (lower-case letters) in each language."""
        p = np.vstack([self.probabilities, np.zeros(len(self.languages))])
        out = np.zeros((len(words), len(self.languages)))
        short = [i for i, x in enumerate(words) if len(x) <= MAX_WORD]
        for at, codes in by_length([words[i] for i in short]):
            out[np.array(short)[at]] = np.log(self._forward(codes, p)[0][-1])
        for i, word in enumerate(words):
            if len(word) > MAX_WORD:
                out[i] = self._long(word, p)
        return out

    def _long(self, word: str, p: np.ndarray) -> np.ndarray:
        """The same for one long word: sums over its first letters as shares of the last, whose logarithm is kept beside."""
        codes, longest, none = np.frombuffer((MARK + word).encode("utf-32-le"), np.uint32).astype(np.uint64), self.table.longest, len(self.pieces)
        pad = np.concatenate([codes, np.zeros(longest, np.uint64)])
        windows = np.lib.stride_tricks.sliding_window_view(pad, longest)[: len(codes)]
        log, ring = np.zeros(p.shape[1]), np.zeros((longest, p.shape[1]))
        ring[0] = 1.0  # [k]: the sum k + 1 letters back, over the newest one
        recent = np.full((longest, longest), none + 1, np.int64)  # [k]: ids by length - 1 of the pieces that start k letters back
        for first in range(0, len(codes), 4_096):
            part = windows[first : first + 4_096]
            ids = np.stack(self.table.find(part)[0], 1)
            ids[:, 1:][ids[:, 1:] == none] = none + 1
            for row in ids:
                recent = np.concatenate([row[None].astype(np.int64), recent[:-1]])
                total = (ring * p[recent.diagonal()]).sum(0)
                log += np.log(total)
                ring = np.concatenate([np.ones((1, len(total))), ring[:-1] / total])
        return log

    def expected(self, counts: Counter, language: int) -> np.ndarray:
        """How often each piece is expected in the counted words, over all their segmentations."""
        p = np.vstack([self.probabilities[:, [language]], [[0.0]]])
        words, out = list(counts), np.zeros(len(self.pieces) + 2)
        times = np.fromiter(counts.values(), float, len(counts))
        for at, codes in by_length(words):
            sums, found = self._forward(codes, p)
            n, width = codes.shape
            rest: list[np.ndarray] = [np.zeros(n) for _ in range(width)] + [np.ones(n)]
            share = times[at] / sums[-1][:, 0]
            for start in range(width - 1, -1, -1):
                for k, ids in enumerate(found[start]):
                    mass = p[ids, 0] * rest[start + k + 1]
                    rest[start] += mass
                    out += np.bincount(ids, mass * sums[start][:, 0] * share, len(out))
        return out[:-1]


def text_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters; a run with other numerals loses them."""
    words = _WORDS.findall((text or "").lower())
    return [w for x in words if (w := x if x.isalpha() else "".join(filter(str.isalpha, x)))]


def fit(labelled: list[tuple[str, str]], pieces: list[str], rounds: int = 2) -> LanguageModel:
    """labelled: (language, text). Starts from even probabilities; each round replaces them by expected shares. Words over
    MAX_WORD letters teach nothing."""
    counts: dict[str, Counter] = {}
    for language, text in labelled:
        counts.setdefault(language, Counter()).update(x for x in text_words(text) if len(x) <= MAX_WORD)
    languages = sorted(counts)
    model = LanguageModel(languages, pieces, np.full((len(pieces) + 1, len(languages)), 1 / len(pieces)))
    for _ in range(rounds):
        made = np.stack([model.expected(counts[x], k) for k, x in enumerate(languages)], 1) if languages else model.probabilities
        shares = made / np.maximum(made.sum(0), 1e-300) + RARE  # alike in all languages, so what none has seen speaks for none
        model.probabilities = shares / shares.sum(0)
    return model


def learned(docs: DataFrame, pieces: list[str]) -> LanguageModel:
    """Learns from about SAMPLE_PER_LANGUAGE texts of each label, drawn by a hash among docs (doc_id, text, lang).

    One pass counts the labels, a second takes the texts whose hash is below the share wanted, each text once; the draw, not
    the input, bounds what comes to the driver. Texts over SAMPLE_CHARS are not drawn.
    """
    labels = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(f"lang is not null and length(text) <= {SAMPLE_CHARS}")
    sizes = {r["lang"]: r["n"] for r in labels.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE_IN_ALL).collect()}
    if not sizes:
        return fit([], pieces)
    most = max(1, min(SAMPLE_PER_LANGUAGE, SAMPLE_IN_ALL // len(sizes)))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 1.3 * (most + 5) / n))])
    order = F.xxhash64("doc_id", "text", F.lit(7))
    picked = labels.where(F.pmod(order, F.lit(1 << 32)) < share[F.col("lang")] * (1 << 32)).select("lang", "text", order.alias("o")).distinct()
    kept: Counter = Counter()
    chosen = []
    for r in sorted(picked.collect(), key=lambda r: (r["lang"], r["o"], r["text"])):
        kept[r["lang"]] += 1
        if kept[r["lang"]] <= most:
            chosen.append((r["lang"], r["text"]))
    return fit(chosen, pieces)


class Scorer(dict):
    """Maps a word to its row in ``rows``; misses are numbered at once and scored together."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model, self.rows, self.waiting = model, np.zeros((0, len(model.languages))), []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.waiting.append(word)
        return at

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text, and its share of the probability per word over all languages."""
        if len(self) > CACHE_WORDS:
            self.clear()
            self.rows = self.rows[:0]
        words = [text_words(x) for x in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter((i for x in words for i in map(self.__getitem__, x)), np.int64, int(sizes.sum()))
        if self.waiting:
            self.rows = np.vstack([self.rows, self.model.word_scores(self.waiting)])
            self.waiting = []
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        some = np.flatnonzero(sizes)
        if len(some) and self.model.languages:
            total = np.add.reduceat(self.rows[at], (np.cumsum(sizes) - sizes)[some])
            best = total.argmax(1)
            each = (total - total[np.arange(len(some)), best][:, None]) / sizes[some][:, None]
            share = 1 / np.exp(each).sum(1)
            for k, i in enumerate(some):
                names[i], scores[i] = self.model.languages[best[k]], float(share[k])
        return names, scores


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Adds lang_pred and score to every row of docs, reading its column text alone.

    Null text, text without a letter, or a model of no language: ``und`` with score 0. No shuffle. Columns of docs
    that are already called lang_pred or score are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most pieces x languages numbers
    docs = docs.drop("lang_pred", "score")

    def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)  # one a task: a worker that goes on to other work keeps nothing of it
        for batch in batches:
            for run in runs(batch, "text"):
                names, scores = scorer.score(run.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*run.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*run.schema.names, "lang_pred", "score"])
        del scorer
        give_back()

    out = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    return docs.mapInArrow(score_batches, out)


def held_out() -> F.Column:
    """Whether a document is kept from learning: crc32 of doc_id as text leaves 1 by 3. False for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learns from those that aren't held out and have a doc_id."""
    model = learned(docs.where(~held_out() & F.col("doc_id").isNotNull()), public_pieces(path))
    return identify(docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text")), model).drop("text")
