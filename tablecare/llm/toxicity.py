"""Toxicity by weak supervision.

Voters. A lexicon voter says "toxic" where a text has its word, or a word that begins with its
stem of four to six letters. The lexicon is the words and stems that toxic rows have far more
often than others, and more often than chance would bring about: of all candidates, no more than
``CHANCE`` may be expected to be as uneven by accident. They must also follow ``SUPPORT`` different
words, for those of a text that was merely copied always follow the same word; of few toxic rows,
half as many as there are rows. What a rare entry is worth the label model finds out. Pattern voters look at capitals, exclamation marks and odd signs, or say
"clean" where no word of the lexicon occurs. All may abstain.

Label model. A generative model of the votes, fitted by expectation maximisation without using
labels: each voter has a chance of every vote given the hidden label. Correlations of voters,
given the label, are estimated along with it, and a voter's say is divided by how many votes it
repeats. Its posterior labels train a linear classifier (logistic regression) on the voters'
outputs, which scores every whole text.

Learned from: rows of ``labels`` with a label whose crc32(doc_id) mod ``FOLDS`` is not
``HELD_OUT``; at most ``ROWS_PER_LABEL`` of either label, those with the smallest hash of doc_id.

Of rows with the same doc_id one is learned from, that whose text has the smallest hash.

Defined cases: null text is the empty text, where no lexicon voter speaks; if no entry stands out,
as where there are no toxic rows, no clean ones, or too few of either for chance to be ruled out,
every score is 0; rows whose labels contradict each other are not learned
from; repeated rows are each scored; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablecare.llm.common import crc_remainder, documents, staged, text_of
from tablecare.llm.quality import learnable, sample

FOLDS, HELD_OUT = 5, 0
ROWS_PER_LABEL = 2000
#: Stems' lengths; entries of the lexicon, different words before one in toxic rows, how much likelier it
#: is there, and how many entries may be expected to be so by chance.
STEMS = (4, 5, 6)
LEXICON, SUPPORT, LIKELIER, CHANCE = 400, 5, 30.0, 0.2
STEM = "*"
#: Voters whose votes correlate more than this, given the label, are held to depend on each other.
DEPENDENT = 0.3

ODD_SIGNS = [ord(c) for c in "#$%&*@^~|<>{}"]
ASCII_WORDS = re.compile(r"[a-z]+").findall
WORDS = regex.compile(r"\p{L}+").findall


def word_set(text: str) -> set[str]:
    low = text.lower()
    return set(ASCII_WORDS(low) if low.isascii() else WORDS(low))


def entries(text: str) -> dict[str, str]:
    """The words of a text, and their stems marked as such, each with the word before its last use."""
    low = text.lower()
    words = ASCII_WORDS(low) if low.isascii() else WORDS(low)
    before = dict(zip(words, ["", *words]))
    out = dict(before)
    for n in STEMS:
        out.update((w[:n] + STEM, b) for w, b in before.items() if len(w) >= n)
    return out


def _shares(text: str) -> tuple[float, float, float, float]:
    """Capitals among letters; exclamation marks, odd signs and digits among characters."""
    n = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    capitals, others = n[65:91].sum(), n[97:123].sum() + n[0xC0:].sum()
    characters = max(1, n.sum() - n[0x80:0xC0].sum())
    return (
        capitals / max(1, capitals + others),
        n[ord("!")] / characters,
        n[ODD_SIGNS].sum() / characters,
        n[48:58].sum() / characters,
    )


#: Pattern voters: the share looked at, the least of it, and what they vote.
PATTERNS = (
    (0, 0.5, 1), (1, 0.02, 1), (2, 0.05, 1), (1, 0.0005, 1), (3, 0.1, -1),
)


@dataclass
class Voters:
    lexicon: list[str]
    place: dict[str, int] = field(default_factory=dict)
    stems: dict[int, set[str]] = field(default_factory=dict)
    words: set[str] = field(default_factory=set)

    def __post_init__(self):
        self.place = {e: i for i, e in enumerate(self.lexicon)}
        self.words = {e for e in self.lexicon if not e.endswith(STEM)}
        self.stems = {n: {e[:-1] for e in self.lexicon if e.endswith(STEM) and len(e) == n + 1} for n in STEMS}

    def __len__(self) -> int:
        return len(self.lexicon) + len(PATTERNS) + 1

    def votes(self, text: str) -> np.ndarray:
        """1 for toxic, -1 for clean, 0 for none, of every voter."""
        out = np.zeros(len(self), np.int8)
        words = word_set(text)
        found = [self.place[w] for w in words & self.words]
        for n, stems in self.stems.items():
            if stems:
                found += [self.place[s + STEM] for s in {w[:n] for w in words} & stems]
        out[found] = 1
        shares = _shares(text)
        for i, (which, least, vote) in enumerate(PATTERNS):
            if shares[which] >= least:
                out[len(self.lexicon) + i] = vote
        if not found:
            out[-1] = -1
        return out


def label_model(
    votes: np.ndarray, prior: float, seeds: int, rounds: int = 12, trust: float = 10.0
) -> tuple[np.ndarray, np.ndarray]:
    """Posterior chance of "toxic" for each row of votes, and each voter's say, from the votes alone.

    A voter's chances of voting begin as ``trust`` imagined votes that are right nine times in
    ten, so that the hidden label stays what the voters are meant to tell. Not voting says nothing.
    ``prior`` is the share of toxic rows among those voted on. The first guess follows the first
    ``seeds`` voters, the lexicon; what the others are worth is found out from there.
    """
    yes, no = (votes == 1).astype(np.float64), (votes == -1).astype(np.float64)
    # Only votes for the same on the same row can repeat each other.
    repeats = (yes.T @ yes + no.T @ no > 0) | np.eye(votes.shape[1], dtype=bool)
    posterior = np.where(yes[:, :seeds].any(1), 0.98, 0.02)
    prior, say = min(max(prior, 0.05), 0.95), np.ones(votes.shape[1])
    for _ in range(rounds):
        n1, n0 = posterior.sum() + 1, (1 - posterior).sum() + 1
        odds_yes = np.log((posterior @ yes + 0.9 * trust) / n1) - np.log(((1 - posterior) @ yes + 0.1 * trust) / n0)
        odds_no = np.log((posterior @ no + 0.1 * trust) / n1) - np.log(((1 - posterior) @ no + 0.9 * trust) / n0)
        # What is left of the votes when the label is known: voters that repeat each other.
        means = np.stack([(1 - posterior) @ (yes - no) / n0, posterior @ (yes - no) / n1])
        rest = votes - np.outer(1 - posterior, means[0]) - np.outer(posterior, means[1])
        spread = np.sqrt((rest * rest).mean(0)) + 1e-6
        correlation = (rest.T @ rest) / len(votes) / np.outer(spread, spread)
        np.fill_diagonal(correlation, 1)
        say = 1 / np.where(repeats & (correlation > DEPENDENT), correlation, 0).sum(1)
        total = np.log(prior / (1 - prior)) + yes @ (odds_yes * say) + no @ (odds_no * say)
        posterior = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
    return posterior, say


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 25, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and intercept for soft labels, by Newton's steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-4
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


@dataclass
class Model:
    voters: Voters
    weights: np.ndarray
    intercept: float

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.voters.lexicon:
            return np.zeros(len(texts))
        x = np.array([self.voters.votes(t) for t in texts], np.float64) @ self.weights + self.intercept
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def by_chance(toxic: int, n: int, all_toxic: int, all_rows: int) -> float:
    """The chance that of ``n`` rows drawn from all at least ``toxic`` are toxic ones."""

    def ways(a: int, b: int) -> float:
        return math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)

    clean = all_rows - all_toxic
    return sum(
        math.exp(ways(all_toxic, k) + ways(clean, n - k) - ways(all_rows, n))
        for k in range(max(toxic, n - clean), min(n, all_toxic) + 1)
    )


def find_lexicon(rows: DataFrame) -> tuple[list[str], int, int]:
    """The lexicon of (label, text), and the numbers of toxic and clean rows."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text")):
                own = entries(text.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label] * len(own), pa.int32()), pa.array(own.keys(), pa.string()), pa.array(own.values(), pa.string())],
                    ["label", "entry", "before"],
                )

    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    candidates = staged(
        rows.mapInArrow(found, "label int, entry string, before string")
        .groupBy("entry")
        .agg(
            F.sum("label").alias("toxic"),
            F.count("*").alias("n"),
            F.size(F.collect_set(F.when(F.col("label") == 1, F.xxhash64("before")))).alias("contexts"),
        )
        .where(F.col("contexts") >= min(SUPPORT, -(-toxic // 2))),
        "candidates",
    )
    tried = candidates.count()
    # As many as the lexicon takes, and some that chance may rule out; those in most toxic rows first.
    likely = (
        candidates.where(F.col("toxic") * clean >= LIKELIER * toxic * (F.col("n") - F.col("toxic")))
        .orderBy(F.desc("toxic"), "n", "entry")
        .limit(4 * LEXICON)
        .collect()
    )
    kept = [r["entry"] for r in likely if by_chance(r["toxic"], r["n"], toxic, toxic + clean) * tried <= CHANCE]
    return kept[:LEXICON], toxic, clean


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = sample(texts, learnable(labels, "toxic", FOLDS, HELD_OUT), ROWS_PER_LABEL)
    lexicon, toxic, clean = find_lexicon(rows)
    voters = Voters(lexicon)
    if not lexicon:
        return Model(voters, np.zeros(len(voters)), 0.0)

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [voters.votes(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.binary())], ["votes"])

    cast = sorted(bytes(r.votes) for r in rows.mapInArrow(voted, "votes binary").collect())
    votes = np.frombuffer(b"".join(cast), np.int8).reshape(-1, len(voters))
    posterior, _ = label_model(votes, toxic / (toxic + clean), len(lexicon))
    weights, intercept = logistic(votes.astype(np.float64), posterior)
    return Model(voters, weights, intercept)


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted."""
    model = fit(docs, labels)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                score = model.scores(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return texts.mapInArrow(scored, "doc_id long, score double").select(
        "doc_id",
        (crc_remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
