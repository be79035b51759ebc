"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a generator seeded with its code point. The
vector of an n-gram binds (multiplies) its letters' vectors, each permuted (rolled) by its place. A
text's vector bundles (adds) the vectors of all its n-grams, a language's prototype those of all its
training texts, and a text gets the language with the greatest cosine. Ties go to the first language by
code point. ``n`` is 2 or 3.

Letters are Unicode letters, lower-cased; everything between two words is one boundary symbol. A text
that is null or has no letter gets ``und`` with score 0, as does every text if nothing was learned. The
whole of every text is used, in training and prediction. Rows with a null language are not learned
from; repeated rows teach as often as they occur and get equal predictions. The prototypes are the only thing sent to the driver and back: ``dimensions`` numbers a language;
more than ``MOST_LANGUAGES`` distinct languages are an error, never a cut.
"""
from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import remainder, session

UNKNOWN = "und"
MOST_LANGUAGES = 4_096
SLICE = 8_192  # n-grams bundled at a time: bounds a task's memory


@lru_cache(1)
def letter_table() -> np.ndarray:
    """For each code point: itself if it is a letter, else 0."""
    points = np.arange(0x110000, dtype=np.uint32)
    return np.where(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000), points, 0).astype(np.uint32)


@lru_cache(8_192)
def letter_vector(point: int, dimensions: int, seed: int) -> np.ndarray:
    bits = np.random.Generator(np.random.Philox(key=[seed, point])).integers(0, 2, dimensions, dtype=np.int8)
    return bits * 2 - 1


def ngrams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: text number, n-gram number and count of each distinct pair; the n-grams' letters as
    rows of code points, 0 for a boundary."""
    lowered = [" " + t.lower() + " " if t else "  " for t in texts]
    points = letter_table()[np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)]
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    keep = points != 0
    keep[1:] |= (points[:-1] != 0) | (owner[1:] != owner[:-1])
    keep[:1] = True
    points, owner = points[keep], owner[keep]
    letters = np.flatnonzero(np.bincount(points, minlength=1))
    code = np.zeros(int(letters.max(initial=0)) + 1, np.int64)
    code[letters] = np.arange(len(letters))
    base, codes = max(1, len(letters)), code[points]
    if len(codes) < n:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros((0, n), np.int64)
    size = len(codes) - n + 1
    key = np.zeros(size, np.int64)
    for i in range(n):
        key = key * base + codes[i:i + size]
    whole = owner[:size] == owner[n - 1:]
    pairs, counts = np.unique(owner[:size][whole] * base ** n + key[whole], return_counts=True)
    texts_of, keys = pairs // base ** n, pairs % base ** n
    distinct, number = np.unique(keys, return_inverse=True)
    rows = np.stack([letters[distinct // base ** (n - 1 - i) % base] for i in range(n)], axis=1) if len(distinct) else np.zeros((0, n), np.int64)
    return texts_of, number.reshape(-1), counts, rows


def bundle(owners: np.ndarray, number: np.ndarray, counts: np.ndarray, rows: np.ndarray, size: int,
           dimensions: int, seed: int) -> np.ndarray:
    """``size`` vectors: for each owner the sum of its n-grams' vectors."""
    out = np.zeros((size, dimensions), np.float32)
    n = rows.shape[1]
    for at in range(0, len(rows), SLICE):
        part = rows[at:at + SLICE]
        vectors = np.ones((len(part), dimensions), np.int8)
        for i in range(n):
            points, code = np.unique(part[:, i], return_inverse=True)
            letters = np.stack([letter_vector(int(p), dimensions, seed) for p in points])
            vectors *= np.roll(letters, n - 1 - i, axis=1)[code.reshape(-1)]
        mine = (number >= at) & (number < at + SLICE)
        weights = np.zeros((size, len(part)), np.float32)
        np.add.at(weights, (owners[mine], number[mine] - at), counts[mine].astype(np.float32))
        out += weights @ vectors.astype(np.float32)
    return out


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", n: int = 3, dimensions: int = 1024,
          seed: int = 7) -> dict[str, np.ndarray]:
    """Prototypes of all rows with a language, as unit vectors."""
    spark = session(docs.sparkSession)
    own = docs.select(docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang")).filter(
        "text IS NOT NULL AND lang IS NOT NULL")

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, owner = np.unique(batch["lang"].to_numpy(dtype=object).astype(str), return_inverse=True)
            texts_of, number, counts, rows = ngrams(batch["text"].tolist(), n)
            added = bundle(owner.reshape(-1)[texts_of], number, counts, rows, len(langs), dimensions, seed)
            for lang, vector in zip(langs, added):
                sums[lang] = sums.get(lang, 0) + vector.astype(np.float64)
        for lang, vector in sums.items():
            yield pd.DataFrame({"lang": lang, "place": np.arange(dimensions), "value": vector})

    parts = own.mapInPandas(run, "lang string, place int, value double")
    summed = parts.groupBy("lang", "place").agg(F.sum("value").alias("value"))
    most = MOST_LANGUAGES * dimensions
    found = summed.limit(most + 1).toPandas()
    if len(found) > most:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    out = {}
    for lang, group in found.groupby("lang"):
        vector = np.zeros(dimensions)
        vector[group["place"].to_numpy()] = group["value"].to_numpy()
        norm = np.linalg.norm(vector)
        if norm > 0:
            out[str(lang)] = vector / norm
    return dict(sorted(out.items()))


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", n: int = 3,
            dimensions: int = 1024, seed: int = 7) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced."""
    session(docs.sparkSession)
    names = np.array(list(prototypes) or [UNKNOWN], dtype=object)
    matrix = np.stack(list(prototypes.values())).astype(np.float32) if prototypes else np.zeros((1, dimensions), np.float32)

    @F.pandas_udf("lang_pred string, score double")
    def compared(column: pd.Series) -> pd.DataFrame:
        texts = [t if isinstance(t, str) else "" for t in column]
        texts_of, number, counts, rows = ngrams(texts, n)
        vectors = bundle(texts_of, number, counts, rows, len(texts), dimensions, seed)
        norms = np.linalg.norm(vectors, axis=1)
        cosines = vectors @ matrix.T / np.where(norms > 0, norms, 1)[:, None]
        # a text without letters has no n-gram at all
        known = np.bincount(texts_of, minlength=len(texts)) > 0 if prototypes else np.zeros(len(texts), bool)
        best = cosines.argmax(axis=1)
        return pd.DataFrame({"lang_pred": np.where(known, names[best], UNKNOWN),
                             "score": np.where(known, np.clip(cosines[np.arange(len(texts)), best], 0, 1), 0.0).astype(float)})

    kept = [docs[c] for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*kept, compared(docs[text_col]).alias("_language")).select("*", "_language.*").drop("_language")


def identify(docs: DataFrame, modulus: int = 4, held: int = 2, **options) -> DataFrame:
    """Learn from the rows that are not held out, predict all: ``doc_id, held_out, lang_pred, score``."""
    out = remainder(docs["doc_id"], modulus) == held
    prototypes = learn(docs.filter(~out), **options)
    own = docs.select("doc_id", out.alias("held_out"), "text")
    return predict(own, prototypes, **options).drop("text")


def keep_known(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in a language that their own labels teach. Rejected are texts without a
    letter, and texts whose best cosine is below two standard deviations of that of random vectors."""
    dimensions = options.get("dimensions", 1024)
    rows = docs.select(F.struct("*").alias("row"), docs["text"].alias("text"))  # so that no column of theirs can clash
    told = predict(rows, learn(docs, **options), **options)
    return told.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= 2 / dimensions ** 0.5)).select("row.*")
