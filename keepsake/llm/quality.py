"""Quality by weak supervision: rules vote or abstain, and an EM fit weighs them.

Each rule says good (+1), bad (-1) or nothing (0) about a text. How often a rule is right is not known,
so it is estimated without labels: the true quality is a hidden variable, rules err independently given
it, and expectation-maximisation alternates between each vote pattern's posterior and the rules'
accuracies. A text is kept if the posterior probability of "good" reaches ``threshold``.

Only vote patterns and their counts reach the driver: at most 3 ** len(RULES) rows, whatever the input.
The statistics are over all texts. A null text has no words, gets its features like an empty one, and
fails the base rule. An empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import Workspace, session, windows, word_hashes, word_spans

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
MARKS = b"!?"
DIGITS = b"0123456789"
WINDOW = 8

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_marks long, n_digits long"


def repeated_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words which the text has twice or more."""
    seen = windows(word_hashes(data, starts, ends), width) if len(starts) >= width else np.zeros(0, np.uint64)
    if not len(seen):
        return 0
    order = np.argsort(seen, kind="stable")
    same = seen[order][1:] == seen[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(seen), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(starts) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def features_of(text: str | None) -> tuple[int, ...]:
    raw = (text or "").encode("utf-8", "replace")
    data = np.frombuffer(raw, np.uint8)
    starts, ends = word_spans(data)
    continuation = int(((data & 0xC0) == 0x80).sum())
    in_words = int((ends - starts).sum()) - continuation
    lines = [line for line in raw.split(b"\n") if line.strip(b"\x20\t\n\x0b\x0c\r")]
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    letters = count(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC2, 0xF5)))
    return (len(starts), in_words, count(SYMBOLS), len(lines) - len(set(lines)), repeated_words(data, starts, ends),
            len(lines), count(UPPER), letters, count(MARKS), count(DIGITS))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    names = [x.split()[0] for x in FEATURES.split(", ")]

    @F.pandas_udf(FEATURES)
    def measured(texts: pd.Series) -> pd.DataFrame:
        rows = np.array([features_of(t) for t in texts], np.int64).reshape(len(texts), len(names))
        return pd.DataFrame(rows, columns=names)

    return own.select("doc_id", measured("text").alias("f")).select("doc_id", "f.*")


def rules() -> dict[str, Column]:
    """The rules, over the features. Most only object, and say nothing about a text they have no
    objection to; two approve, of texts that look like prose and of texts that repeat nothing."""
    words, chars = F.col("n_words"), F.col("word_chars")
    symbols, lines, again = F.col("n_symbols"), F.col("n_dup_lines"), F.col("n_repeat_words")
    upper, letters, marks, digits = F.col("n_upper"), F.col("n_letters"), F.col("n_marks"), F.col("n_digits")
    plain = (words >= 40) & (50 * symbols <= words)
    objections = {
        "length": words < 8,
        "word_length": (chars < 2 * words) | (chars > 14 * words),
        "symbols": 4 * symbols > words,
        "lines": 10 * lines > 3 * F.col("n_lines"),
        "repeats": 5 * again > words,
        "capitals": 2 * upper > letters,
        "marks": 5 * marks > words,
        "letters": 2 * letters < chars,
        "digits": 4 * digits > chars,
    }
    approvals = {
        "prose": plain & (10 * letters >= 7 * chars) & (8 * upper <= letters) & (50 * marks <= words),
        "varied": plain & (again == 0) & (lines == 0),
    }
    return ({k: F.when(v, -1).otherwise(0) for k, v in objections.items()}
            | {k: F.when(v, 1).otherwise(0) for k, v in approvals.items()})


def fit(votes: np.ndarray, counts: np.ndarray, prior: float = 0.5, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Accuracies of the rules and the posterior of each vote pattern.

    ``votes`` has a row of -1, 0, 1 for each pattern. The first guess is that a text is bad if any rule
    objects to it. Accuracies are held between 0.55 and 0.99: a rule is better than a coin, which also
    fixes which of the two hidden classes is "good". The prior is given, not fitted: with a fitted one the
    many good texts would outvote any rule that objects alone.
    """
    if not len(votes):
        return np.zeros(votes.shape[1]), np.zeros(0)
    weight = counts / counts.sum()
    good = np.where((votes < 0).any(axis=1), 0.05, 0.95)
    accuracy = np.zeros(votes.shape[1])
    for _ in range(rounds):
        right = (weight[:, None] * np.where(votes > 0, good[:, None], np.where(votes < 0, 1 - good[:, None], 0))).sum(0)
        voted = (weight[:, None] * (votes != 0)).sum(0)
        before, accuracy = accuracy, np.clip((right + 0.8e-6) / (voted + 1e-6), 0.55, 0.99)
        odds = np.log(prior / (1 - prior)) + votes @ np.log(accuracy / (1 - accuracy))
        good = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if np.abs(accuracy - before).max() < 1e-9:
            break
    return accuracy, good


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: features, ``base_failed``, ``posterior`` and ``kept``."""
    spark = session(docs.sparkSession)
    measured = Workspace(spark, "quality").save(features(docs, id_col, text_col), "features")
    own = rules()
    pattern = F.concat(*[(v + 1).cast("string") for v in own.values()])
    # at most 3 ** len(own) rows; in one order, so that sums of floats are the same in every run
    found = sorted(measured.groupBy(pattern.alias("pattern")).count().collect())
    votes = np.array([[int(c) - 1 for c in r["pattern"]] for r in found], float).reshape(len(found), len(own))
    _, good = fit(votes, np.array([r["count"] for r in found], float))
    known = spark.createDataFrame([(r["pattern"], float(p)) for r, p in zip(found, good)], "pattern string, posterior double")
    words, again = F.col("n_words"), F.col("n_repeat_words")
    failed = (words < 20) | (100 * again > 30 * words)
    return (measured.withColumn("pattern", pattern).join(F.broadcast(known), "pattern", "left")
            .withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)).drop("pattern"))
