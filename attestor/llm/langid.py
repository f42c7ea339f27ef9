"""Language identification by unigram piece models, each text scored by the sum over all segmentations of its words."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MARKER = "▁"
#: Letters up to which words of one length are scored together, as plain probabilities; longer ones alone, by logarithms: the same sums.
TOGETHER = 24
#: The bounded sample that models are fitted on: training documents of a language, at most, and groups that they are first chosen in.
SAMPLE_DOCS, SALTS = 600, 64
#: Steps of expectation maximisation, and the count that every piece has before any is seen.
STEPS, PRIOR = 3, 0.05
#: Words that are scored at once, and words whose scores a task remembers at most.
BLOCK, MAX_WORDS = 4_000, 150_000
_WORD = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x100000001B3)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters of a whole text; a text without any letter has none."""
    words = _WORD.findall((text or "").lower())
    return words if any(any(map(str.isalpha, w)) for w in words) else []


def vocabulary(model_path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model, in its order: a fixed public vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class Pieces:
    """Finds the pieces inside many parts of one length at once, by hashes of their code points."""

    def __init__(self, pieces: list[str]):
        keys = np.array([self._hash(p) for p in pieces], dtype=np.uint64)
        self.order = np.argsort(keys)
        self.keys, self.count, self.longest = keys[self.order], len(pieces), max(map(len, pieces), default=1)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h * int(_SPREAD) & 0xFFFFFFFFFFFFFFFF

    def spans(self, parts: list[str]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(start, end, rows, piece)`` of all pieces in parts of equal length, by end; a letter without a piece has number ``count``."""
        n = len(parts[0])
        codes = np.array(parts, dtype=f"U{n}").view(np.uint32).reshape(len(parts), n).astype(np.uint64)
        out = []
        for start in range(n):
            h = np.zeros(len(parts), dtype=np.uint64)
            for end in range(start + 1, min(n, start + self.longest) + 1):
                h = h * _BASE + codes[:, end - 1] + np.uint64(1)
                key = h * _SPREAD
                at = np.minimum(np.searchsorted(self.keys, key), self.count - 1)
                known = self.keys[at] == key
                if end == start + 1:
                    out.append((start, end, np.arange(len(parts)), np.where(known, self.order[at], self.count)))
                elif known.any():
                    rows = np.flatnonzero(known)
                    out.append((start, end, rows, self.order[at[rows]]))
        return sorted(out, key=lambda x: (x[1], x[0]))

    def grid(self, word: str) -> np.ndarray:
        """``[longest, letters + 1]`` for one word of any length: at (size - 1, end) the piece of that size that ends there.

        ``count`` stands for a letter without a piece, ``count + 1`` for no piece.
        """
        n = len(word)
        codes = np.array([word], dtype=f"U{n}").view(np.uint32).astype(np.uint64)
        out = np.full((self.longest, n + 1), self.count + 1, dtype=np.int64)
        h = np.zeros(n, dtype=np.uint64)
        for size in range(1, min(n, self.longest) + 1):
            h = h[: n - size + 1] * _BASE + codes[size - 1 :] + np.uint64(1)
            key = h * _SPREAD
            at = np.minimum(np.searchsorted(self.keys, key), self.count - 1)
            out[size - 1, size:] = np.where(self.keys[at] == key, self.order[at], self.count + (size > 1))
        return out


def forward(spans, rows: int, n: int, prob: np.ndarray) -> np.ndarray:
    """Probability of every prefix of every word by language, summed over segmentations: ``[n + 1, rows, languages]``."""
    alpha = np.zeros((n + 1, rows, prob.shape[1]))
    alpha[0] = 1
    for start, end, at, piece in spans:
        alpha[end, at] += alpha[start, at] * prob[piece]
    return alpha


def log_forward(grid: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """The same for one word of any length, as logarithms ``[n + 1, languages]``: a step looks back as far as the longest piece."""
    with np.errstate(divide="ignore"):
        worth = np.log(np.vstack([prob, np.zeros(prob.shape[1])]))
    longest, n = len(grid), grid.shape[1] - 1
    alpha = np.full((longest + n, prob.shape[1]), -np.inf)  # the first rows stand before the word
    alpha[longest - 1] = 0
    for end in range(1, n + 1):
        ways = alpha[end - 1 : end - 1 + longest][::-1] + worth[grid[:, end]]
        top = ways.max(axis=0)
        alpha[longest - 1 + end] = top + np.log(np.exp(ways - top).sum(axis=0))
    return alpha[longest - 1 :]


def by_length(words: list[str]) -> tuple[dict[int, list[int]], list[int]]:
    """Places of the words of each length up to TOGETHER, and of the longer ones."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    return {n: g for n, g in groups.items() if n <= TOGETHER}, [i for n, g in groups.items() if n > TOGETHER for i in g]


def part_scores(finder: Pieces, prob: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of every marked word by language, summed over all its segmentations."""
    out = np.zeros((len(words), prob.shape[1]))
    groups, long = by_length(words)
    for n, places in groups.items():
        for i in range(0, len(places), BLOCK):
            block = places[i : i + BLOCK]
            spans = finder.spans([words[j] for j in block])
            out[block] = np.log(np.maximum(forward(spans, len(block), n, prob)[n], 1e-300))
    for i in long:
        out[i] = log_forward(finder.grid(words[i]), prob)[-1]
    return out


def fit(pieces: list[str], counts: dict[str, dict[str, int]]) -> tuple[list[str], np.ndarray]:
    """Languages in order and piece probabilities ``[pieces + 1, languages]`` by expectation maximisation over word counts.

    The row after the last piece is for letters that have none; it keeps the least probability of all.
    """
    languages, finder = sorted(counts), Pieces(pieces)
    prob = np.full((len(pieces) + 1, max(1, len(languages))), 1 / (len(pieces) + 1))
    for column, language in enumerate(languages):
        words = [MARKER + w for w in counts[language]]
        weight = np.array(list(counts[language].values()), dtype=float)
        groups, long = by_length(words)
        held = [(n, np.array(places), finder.spans([words[j] for j in places])) for n, places in groups.items()]
        grids = [(weight[i], finder.grid(words[i])) for i in long]
        p = prob[:, column : column + 1].copy()
        for _ in range(STEPS):
            seen = np.full(len(pieces) + 1, PRIOR)
            for n, places, spans in held:
                alpha = forward(spans, len(places), n, p)[:, :, 0]
                beta = np.zeros_like(alpha)
                beta[n] = 1
                for start, end, at, piece in reversed(spans):
                    beta[start, at] += p[piece, 0] * beta[end, at]
                whole = np.maximum(alpha[n], 1e-300)
                for start, end, at, piece in spans:
                    seen += np.bincount(piece, weight[places[at]] * alpha[start, at] * p[piece, 0] * beta[end, at] / whole[at], len(seen))
            for times, grid in grids:
                seen += times * long_counts(grid, p)
            seen[-1] = seen[:-1].min()
            p = (seen / seen.sum())[:, None]
        prob[:, column : column + 1] = p
    return languages, prob


def long_counts(grid: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected count of every piece in one word of any length."""
    n, none = grid.shape[1] - 1, len(p)
    back = np.full_like(grid, none)  # the grid of the word read from its end
    for size in range(1, min(n, len(grid)) + 1):
        back[size - 1, size:] = grid[size - 1, size:][::-1]
    alpha, beta = log_forward(grid, p)[:, 0], log_forward(back, p)[:, 0][::-1]
    seen = np.zeros(len(p))
    for size in range(1, min(n, len(grid)) + 1):
        piece = grid[size - 1, size:]
        known = np.flatnonzero(piece < none)
        share = np.exp(alpha[known] + np.log(p[piece[known], 0]) + beta[known + size] - alpha[n])
        seen += np.bincount(piece[known], share, len(p))
    return seen


def held_out_column(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def training_counts(docs: DataFrame) -> dict[str, dict[str, int]]:
    """Word counts by language of the bounded sample: the SAMPLE_DOCS training documents of a language with the least hashes.

    Documents are chosen by id alone, in SALTS groups of a language first, so no task reads more than SALTS times SAMPLE_DOCS ids
    of a language. All words of the chosen documents come to the driver with their counts.
    """
    train = docs.where(~held_out_column() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = train.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"))
    for group in (["lang", F.pmod("h", F.lit(SALTS))], ["lang"]):
        chosen = chosen.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy("h", "doc_id"))).where(F.col("r") <= SAMPLE_DOCS).drop("r")
    chosen = F.broadcast(chosen.select("doc_id").distinct())  # SAMPLE_DOCS for each language

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tally: Counter = Counter()
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                for word, n in Counter(words_of(text)).items():
                    tally[lang, word] += n
            yield pd.DataFrame([(lang, word, n) for (lang, word), n in tally.items()], columns=["lang", "word", "n"])

    picked = train.join(chosen, "doc_id", "left_semi")
    counts = picked.select("lang", "text").mapInPandas(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    out: dict[str, dict[str, int]] = {}
    for row in counts.collect():
        out.setdefault(row["lang"], {})[row["word"]] = row["n"]
    return {lang: dict(sorted(words.items())) for lang, words in out.items()}  # in one order, so sums are the same in each run


def predict(docs: DataFrame, pieces: list[str], languages: list[str], prob: np.ndarray, doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, lang_pred, score)``: the most probable language of every whole text, and its share of all languages' probability.

    Words are scored once per task while they are remembered. Null texts, and texts without a letter, are ``und`` with score 0,
    as are all if no language was learned. Ties go to the first language in order. Only the text is looked at.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Pieces(pieces)
        known: dict[str, int] = {}
        scores = np.zeros((0, len(languages)))
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                texts = [words_of(t) if languages else [] for t in part["text"]]
                if len(known) > MAX_WORDS:
                    known, scores = {}, np.zeros((0, len(languages)))
                new = list({w for words in texts for w in words if w not in known})
                if new:
                    if len(known) + len(new) > len(scores):  # twice as many rows at least, so that few copies are made
                        scores = np.concatenate([scores, np.zeros((max(len(scores), len(new)), len(languages)))])
                    scores[len(known) : len(known) + len(new)] = part_scores(finder, prob, [MARKER + w for w in new])
                    known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                langs, shares = [], []
                for words in texts:
                    if not words:
                        langs.append("und")
                        shares.append(0.0)
                        continue
                    total = scores[np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0)
                    best = int(total.argmax())
                    langs.append(languages[best])
                    shares.append(float(1 / np.exp(total - total[best]).sum()))
                yield pd.DataFrame({"doc_id": part["doc_id"], "lang_pred": langs, "score": shares})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` per row of ``docs`` (doc_id, text, lang), with models learned from the rows that are not
    held out. Null ids are held out of learning; repeated rows are predicted alike; extra columns are ignored."""
    pieces = vocabulary(model_path)
    languages, prob = fit(pieces, training_counts(docs))
    found = predict(docs, pieces, languages, prob)
    return found.select("doc_id", F.coalesce(held_out_column(), F.lit(True)).alias("held_out"), "lang_pred", "score")
