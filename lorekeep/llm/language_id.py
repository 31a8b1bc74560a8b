"""Language identification as multilingual mixture inference.

Every labelled language has a distribution over hashed letter 3-grams (with word edges), counted over the training rows
and smoothed. A document is a mixture of languages: expectation-maximisation estimates the proportions from the
likelihoods of its n-grams. The set of languages is chosen by penalised likelihood: from the single best one, a language
joins while the gain in log-likelihood exceeds the penalty per n-gram count (as in the Bayesian criterion, raised by
a factor for the dependence of neighbouring n-grams). The language with the largest proportion is the prediction and its
proportion the score.

Training counts are bounded by languages times BUCKETS, whatever the corpus: each task sums its own rows, partial sums
are added by Spark, and the table that goes to the tasks has that size. A corpus with more than MOST_LANGUAGES labels is
an error.

Texts without letters, empty and null texts are "und" with score 0; rows with a null lang are not learned from. With
nothing to learn from, everything is "und". Very long texts are read whole. Repeated rows are predicted alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, lean, read_table

BUCKETS = 1 << 15
MOST_LANGUAGES = 512
#: Rounds of expectation-maximisation for a set of languages.
ROUNDS = 12
#: Penalty for a language, in units of half the logarithm of the number of n-grams.
PENALTY = 8.0
UNKNOWN = "und"

# Letters by code unit for the basic plane; what else a text holds parts its words.
_LOWER = np.array([ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(1 << 16)], dtype=np.int64)
_LETTER = np.array([chr(i).isalpha() for i in range(1 << 16)])


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text's 3-grams and how often each occurs; none without letters."""
    raw = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(raw) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = raw < 1 << 16
    units = np.where(low, raw, 0)
    code = np.where(_LETTER[units], _LOWER[units], 32)
    if not low.all():  # rare: letters of the other planes
        far = np.flatnonzero(~low)
        code[far] = [int(x) if chr(int(x)).isalpha() else 32 for x in raw[far]]
    if not (code != 32).any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.concatenate([[32], code, [32]])
    a, b, c = code[:-2], code[1:-1], code[2:]
    key = (a * 1_000_003 + b * 8_191 + c) * 2_654_435_761 % (1 << 32) >> 12
    counts = np.bincount(key[(b != 32)] % BUCKETS, minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


@lean
def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            at, n = grams(text)
            own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
            own[at] += n
    for lang, own in sums.items():
        at = np.flatnonzero(own)
        yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": own[at]})


def train(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities [language, bucket]) from rows with text and lang; rows without lang do not count."""
    counts = rows.where("lang IS NOT NULL").select("text", "lang").mapInPandas(_count, "lang string, bucket int, n long")
    counts = kept(counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "gram-counts")
    langs = [r[0] for r in counts.select("lang").distinct().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = np.full((len(langs), BUCKETS), 0.5)
    number = F.create_map(*(F.lit(x) for k, lang in enumerate(langs) for x in (lang, k)))[F.col("lang")] if langs else F.lit(0)
    found = counts.select(number.alias("lang"), "bucket", "n").toPandas()  # numbers only, at most MOST_LANGUAGES x BUCKETS rows, each pair once
    table[found["lang"].to_numpy(np.int64), found["bucket"].to_numpy(np.int64)] += found["n"].to_numpy(np.float64)
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def _mixture(like: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood (up to a constant) for likelihoods [gram, language] of grams seen n times."""
    share = np.full(like.shape[1], 1 / like.shape[1])
    for _ in range(rounds):
        joint = like * share
        share = n @ (joint / joint.sum(axis=1, keepdims=True)) / n.sum()
    return share, float(n @ np.log(like @ share))


def infer(at: np.ndarray, n: np.ndarray, logs: np.ndarray) -> tuple[int, float]:
    """Index of the language with the largest proportion, and the proportion."""
    own = logs[:, at].T.astype(np.float64)
    like = np.exp(own - own.max(axis=1, keepdims=True))
    single = n @ (own - own.max(axis=1, keepdims=True))
    best = int(np.argmax(single))
    if like.shape[1] == 1:
        return best, 1.0
    share, _ = _mixture(like, n)
    penalty = PENALTY * 0.5 * np.log(n.sum() + 1)
    chosen, value, shares = [best], float(single[best]), np.ones(1)
    for k in np.argsort(-share, kind="stable"):
        if k in chosen:
            continue
        if share[k] < 0.01:
            break
        more, ll = _mixture(like[:, [*chosen, int(k)]], n)
        if ll - value <= penalty:
            break
        chosen, value, shares = [*chosen, int(k)], ll, more
    top = int(np.argmax(shares))
    return chosen[top], float(min(1.0, shares[top]))


def _predict(langs: list[str], shared, names: list[str]) -> Callable:
    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        logs = shared.value
        for batch in batches:
            found = []
            for text in batch["text"]:
                at, n = grams(text)
                best, score = infer(at, n, logs) if len(at) and langs else (-1, 0.0)
                found.append((langs[best] if best >= 0 else UNKNOWN, score))
            yield batch[names].assign(lang_pred=[x[0] for x in found], score=[x[1] for x in found])

    return run


def identify(docs: DataFrame, langs: list[str], logs: np.ndarray, carry: list[str]) -> DataFrame:
    """The columns named in carry, with lang_pred and score; only the text is looked at."""
    from pyspark.sql import types as T

    schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(logs)  # at most MOST_LANGUAGES x BUCKETS numbers of four bytes, 64 MB
    return docs.select(*dict.fromkeys([*carry, "text"])).mapInPandas(_predict(langs, shared, carry), schema)


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    langs, logs = train(docs.where(~held_out()))
    return identify(docs, langs, logs, ["doc_id"]).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
