"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts come from a bounded, seeded share of each language's labelled rows, so that rare
languages are learned whole however many rows the others have. The log-probability matrix (buckets x languages) is held sparse, as what an
entry lies above its language's smoothing alone, so that it takes space for the n-grams that were seen and not for
languages times buckets; it is broadcast. Whole texts are scored in numpy, many at once: the n-grams of a batch are counted by text and bucket, and the
counts multiplied with the matrix.

Edge cases: a null text, or one without a letter, is ``und`` with score 0. A null label or a null
doc_id is never learned from. With no labelled row at all every text is ``und``. Repeated rows are
scored one by one and come back as often as they came in. There may be any number of labels: the driver holds one rate for each, and at least one row of each is
learned from. ``identify`` writes lang_pred and lang_score, in place of columns of these names; other columns are left untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siloflow.llm.common import small

BUCKET_BITS = 15
ORDERS = (1, 2, 3)
#: Expected number of labelled rows that the model is fitted on; each language's rate follows from the counts of all.
MAX_TRAIN_ROWS = 20_000
#: Rows are drawn by so many bits of their hash.
DRAW_BITS = 40
SMOOTHING = 0.5
#: Characters handled at once; longer texts go through in overlapping pieces.
CHUNK = 1 << 18
#: Cells of texts times languages that are added up at once.
CELLS = 1 << 22
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)

@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x10000)), dtype=bool, count=0x10000)


#: A code that no text has after _codes: it stands between the texts of a batch.
BETWEEN = np.uint32(0)


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points with every run's non-letters as blanks."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    alpha = _letters()[np.minimum(codes, 0xFFFF)]
    high = codes > 0xFFFF
    if high.any():
        alpha = alpha.copy()
        alpha[high] = [chr(c).isalpha() for c in codes[high]]
    return np.where(alpha, codes, np.uint32(0x20))


def _buckets(codes: np.ndarray, skip: int) -> list[np.ndarray]:
    """Hash buckets of the n-grams that hold a letter at their start or end, an array for each order.

    Only n-grams that end after the first ``skip`` characters count. The hash of an n-gram extends
    that of the shorter one at the same place.
    """
    return [b for b, _ in _placed_buckets(codes, skip)]


def _placed_buckets(codes: np.ndarray, skip: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same, with the place each n-gram starts at. No n-gram goes over a code BETWEEN."""
    out, solid, ends = [], (codes != 0x20) & (codes != BETWEEN), np.concatenate([[0], np.cumsum(codes == BETWEEN)])
    h = np.zeros(len(codes) + 1, dtype=np.uint32)
    for order in ORDERS:
        n = len(codes) - order + 1
        if n < 1:
            break
        h = (h[:n] ^ codes[order - 1 :]) * _MULT[order - 1]
        h ^= h >> np.uint32(15)
        first = max(0, skip - order + 1)
        used = np.flatnonzero((solid[first:n] | solid[first + order - 1 :]) & (ends[first + order : n + order] == ends[first:n]))
        out.append((((h[first:] * _MULT[0]) >> np.uint32(32 - BUCKET_BITS))[used], used + first))
    return out


def _pieces(text: str) -> Iterator[tuple[str, bool]]:
    """The text in pieces that overlap by the longest n-gram less one."""
    back = max(ORDERS) - 1
    for at in range(0, max(len(text), 1), CHUNK):
        yield text[max(0, at - back) : at + CHUNK], at > 0


def features(text: str) -> Iterator[np.ndarray]:
    """Arrays of buckets that together hold each n-gram of the whole text once."""
    back = max(ORDERS) - 1
    for piece, later in _pieces(text):
        yield np.concatenate([np.empty(0, dtype=np.uint32), *_buckets(_codes(piece), back if later else 0)])


def has_letter(text: str | None) -> bool:
    return bool(text) and any(bool((_codes(piece) != 0x20).any()) for piece, _ in _pieces(text))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def shares(sizes: dict[str, int], max_rows: int) -> dict[str, int]:
    """Rows to expect of each label: all of the rare ones, and of the others an equal number, max_rows together."""
    out, left = {}, max_rows
    for i, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = max(1, min(n, left // (len(sizes) - i)))
        left -= out[lang]
    return out


def fit(docs: DataFrame, text: str = "text", label: str = "lang", row_id: str = "doc_id", max_rows: int = MAX_TRAIN_ROWS, seed: int = 1) -> dict:
    """Learn from rows with a text, a label and an id; returns the labels and the sparse matrix of ``sparse``."""
    usable = docs.where(F.col(text).isNotNull() & F.col(label).isNotNull() & F.col(row_id).isNotNull()).select(
        F.col(text).alias("text"), F.col(label).cast("string").alias("lang"), F.col(row_id).cast("string").alias("id")
    )
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator()}
    if not sizes:
        return {"langs": [], **sparse(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), 0)}
    rates = [(lang, -(-(n << DRAW_BITS) // sizes[lang])) for lang, n in shares(sizes, max_rows).items()]
    upto = small(usable.sparkSession.createDataFrame(rates, "lang string, upto long"), len(rates), 128)
    sample = usable.join(upto, "lang").where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << DRAW_BITS)) < F.col("upto")).select("text", "lang")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, of in pdf.groupby("lang"):
                into = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
                for body in of["text"]:
                    for b in features(body):
                        into += np.bincount(b, minlength=1 << BUCKET_BITS)
                at = np.flatnonzero(into)
                yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": into[at]})

    rows = sample.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())  # a label without a counted n-gram would be a column of smoothing only
    where = {lang: i for i, lang in enumerate(langs)}
    return {"langs": langs, **sparse(rows["bucket"].to_numpy(dtype=np.int64), rows["lang"].map(where).to_numpy(dtype=np.int64), rows["n"].to_numpy(dtype=np.int64), len(langs))}


def sparse(bucket: np.ndarray, lang: np.ndarray, n: np.ndarray, n_langs: int) -> dict:
    """The matrix of log probabilities from counts: floor by language, and per bucket (starts, column, above) what the seen ones have above it."""
    buckets = 1 << BUCKET_BITS
    total = np.bincount(lang, weights=n, minlength=n_langs) + SMOOTHING * buckets
    order = np.lexsort((lang, bucket))
    starts = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
    return {"floor": np.log(SMOOTHING) - np.log(total), "starts": starts, "column": lang[order].astype(np.int32), "above": np.log1p(n[order] / SMOOTHING).astype(np.float32)}


def _batches(texts, most: int) -> Iterator[list[tuple[int, str, bool]]]:
    """(number of text, piece, whether it is a later one), of at most ``most`` texts and about CHUNK characters together."""
    held, size = [], 0
    for i, body in enumerate(texts):
        for piece, later in _pieces(body or ""):
            if held and (size + len(piece) > CHUNK or i - held[0][0] >= most):
                yield held
                held, size = [], 0
            held.append((i, piece, later))
            size += len(piece)
    if held:
        yield held


def score_texts(texts, model: dict) -> tuple[list[str], list[float]]:
    """Label and posterior of each text under equal priors, so that the mix of the sample does not decide."""
    langs, texts = model["langs"], list(texts)
    n_langs, back = len(langs), max(ORDERS) - 1
    pred, prob = ["und"] * len(texts), [0.0] * len(texts)
    if not langs:
        return pred, prob
    score, lettered = {}, set()
    for held in _batches(texts, max(1, CELLS // n_langs)):
        low = held[0][0]
        codes, own = [], []
        for i, piece, later in held:
            c = _codes(piece)
            if (c != 0x20).any():
                lettered.add(i)
            skip = min(back, len(c)) if later else 0  # n-grams that end here were counted with the piece before
            codes += [c, np.full(1, BETWEEN)]
            own.append((len(c) + 1, i - low, skip))
        joined, lengths = np.concatenate(codes), np.array([x[0] for x in own])
        text_of, skips = np.repeat([x[1] for x in own], lengths), np.repeat([x[2] for x in own], lengths)
        place = np.arange(len(joined)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        keys = []
        for order, (b, at) in zip(ORDERS, _placed_buckets(joined, 0), strict=False):
            new = place[at] + order > skips[at] if skips.any() else slice(None)
            keys.append(text_of[at][new].astype(np.int64) << BUCKET_BITS | b[new].astype(np.int64))
        cell, n = np.unique(np.concatenate(keys), return_counts=True)
        row, b = cell >> BUCKET_BITS, cell & ((1 << BUCKET_BITS) - 1)
        size = model["starts"][b + 1] - model["starts"][b]
        at = np.repeat(model["starts"][b] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        n_rows = held[-1][0] - low + 1
        ll = np.bincount(np.repeat(row, size) * n_langs + model["column"][at], weights=model["above"][at] * np.repeat(n, size), minlength=n_rows * n_langs).astype(np.float64).reshape(n_rows, n_langs)
        ll += np.bincount(row, weights=n, minlength=n_rows)[:, None] * model["floor"]
        for k, i in enumerate(range(low, low + n_rows)):
            score[i] = score[i] + ll[k] if i in score else ll[k]
        for i in [i for i in score if i < held[-1][0]]:  # the last text of a batch may go on in the next
            _decide(i, score.pop(i), lettered, langs, pred, prob)
    for i, ll in score.items():
        _decide(i, ll, lettered, langs, pred, prob)
    return pred, prob


def _decide(i: int, ll: np.ndarray, lettered: set[int], langs: list[str], pred: list[str], prob: list[float]) -> None:
    if i in lettered:
        best = int(ll.argmax())
        pred[i], prob[i] = langs[best], float(1.0 / np.exp(ll - ll[best]).sum())


def identify(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Append lang_pred and lang_score to every row; all other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, lang_score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            pred, prob = score_texts(s, shared.value)
            yield pd.DataFrame({"lang_pred": pred, "lang_score": prob})

    got = docs.withColumn("_lang", scored(F.col(text)))
    return got.withColumns({"lang_pred": F.col("_lang.lang_pred"), "lang_score": F.col("_lang.lang_score")}).drop("_lang")


def op1(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; held-out labels are never learned from."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
