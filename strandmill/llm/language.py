"""Language ID by hyperdimensional profiles: permuted random letter vectors bound into trigrams, bundled per text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from strandmill.llm.common import slices

UNKNOWN = "und"
#: More values than this in the language column are no languages; profiles of so many fit a driver and a task.
MOST_LANGUAGES = 10_000


class Encoder:
    """Turns texts into bundles: the sum, over a text's letter trigrams, of shift2(a) * shift1(b) * c.

    Every letter, of any script, has a random vector of its own, drawn from its code point as the seed when it is first
    met, so that all tasks agree; what stands between words has one too.
    """

    def __init__(self, dimensions: int = 1024, seed: int = 17):
        self.dimensions, self.seed = dimensions, seed
        self.place = np.full(0x110000, -1, np.int32)  # of code points met so far among the vectors; 0 between words
        self.vectors = np.empty((256, dimensions), np.int8)
        self.vectors[0], self.met = self.draw(0), 1

    def draw(self, point: int) -> np.ndarray:
        return np.random.default_rng((self.seed, point)).integers(0, 2, self.dimensions, np.int8) * 2 - 1

    def places(self, points: np.ndarray) -> np.ndarray:
        found = self.place[points]
        if (found < 0).any():
            for point in np.unique(points[found < 0]).tolist():
                if not chr(point).isalpha():
                    self.place[point] = 0
                    continue
                if self.met == len(self.vectors):
                    self.vectors = np.concatenate((self.vectors, np.empty_like(self.vectors)))
                self.vectors[self.met] = self.draw(point)
                self.place[point] = self.met
                self.met += 1
            found = self.place[points]
        return found

    def trigrams(self, text: str | None) -> np.ndarray:
        """Rows of places of three letters."""
        ids = self.places(np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32))
        if not ids.any():
            return np.zeros(0, np.int64)
        ids = np.concatenate(([0], ids, [0])).astype(np.int64)
        ids = ids[np.concatenate(([True], (ids[1:] != 0) | (ids[:-1] != 0)))]
        ids = np.concatenate((ids, [0])) if len(ids) < 3 else ids
        return (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]

    def encode(self, texts: list) -> np.ndarray:
        """A row of unit length for each text; zeros for a text without a letter."""
        codes = [self.trigrams(x) for x in texts]
        flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        bundles = np.zeros((len(texts), self.dimensions), np.float32)
        if not len(flat):
            return bundles
        at, known = pd.factorize(flat)
        rows = np.repeat(np.arange(len(codes)), [len(x) for x in codes])
        for start in range(0, len(known), 16_384):  # counts of so many trigrams at a time, bound vectors of a thousand
            some = known[start:start + 16_384]
            inside = (at >= start) & (at < start + len(some)) if len(known) > len(some) else slice(None)
            counts = np.bincount(rows[inside] * len(some) + at[inside] - start, minlength=len(codes) * len(some)).reshape(len(codes), -1)
            for low in range(0, len(some), 1024):
                few = some[low:low + 1024]
                bound = np.roll(self.vectors[few >> 42], 2, 1)
                bound *= np.roll(self.vectors[few >> 21 & 0x1FFFFF], 1, 1)
                bound *= self.vectors[few & 0x1FFFFF]
                bundles += counts[:, low:low + 1024].astype(np.float32) @ bound.astype(np.float32)
        length = np.linalg.norm(bundles, axis=1, keepdims=True)
        return np.divide(bundles, length, out=np.zeros_like(bundles), where=length > 0)


def portions(texts: list, rows: int = 64, characters: int = 400_000) -> Iterator[tuple[int, int]]:
    """Runs of texts small enough to be encoded together; one long text stands alone."""
    start = size = 0
    for i, x in enumerate(texts):
        n = len(x or "")
        if i > start and (i - start >= rows or size + n > characters):
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def equal_shares(sizes: dict[str, int], most: int) -> dict[str, int]:
    """``most`` rows dealt evenly over languages; what small ones leave goes to the others, and each gets one."""
    out, left = {}, most
    for i, (name, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        out[name] = max(1, min(n, left // (len(sizes) - i)))
        left -= out[name]
    return out


def fit_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
                 max_docs: int = 20_000, dimensions: int = 1024, seed: int = 17) -> tuple[list[str], np.ndarray]:
    """Language names and their prototypes, unit rows: the bundles of labelled texts, summed by language.

    Learns from at most about ``max_docs`` labelled rows, picked by hash of ``key`` and text within each language, which
    get equal shares as far as they have rows; every labelled language is learned, with one row at least. The parameter
    bounds the sample (in expectation), not the prediction. Partial sums leave the tasks, and Spark adds them by language and dimension,
    so the driver receives languages x dimensions numbers, of ``MOST_LANGUAGES`` at most: more are an error. Rows with a
    null language or text are not learnt from.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    digest = F.shiftrightunsigned(F.xxhash64(key, F.col(text).cast("string")), 11)  # 53 bits
    sizes = {r["l"]: (r["n"], r["least"]) for r in labelled.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n"), F.min(digest).alias("least")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} values in {lang}: these are no languages")
    picked = labelled
    if sum(n for n, _ in sizes.values()) > max_docs:
        seats = equal_shares({name: n for name, (n, _) in sizes.items()}, max_docs)
        bounds = [(name, max(least + 1, (seats[name] << 53) // n)) for name, (n, least) in sizes.items()]
        known = docs.sparkSession.createDataFrame(bounds, f"_learned {docs.schema[lang].dataType.simpleString()}, _bound long")
        picked = labelled.join(F.broadcast(known), F.col(lang) == F.col("_learned")).where(digest < F.col("_bound"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(dimensions, seed), {}
        for batch in slices(batches):
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in portions(texts):
                for name, row in zip(langs[a:b], encoder.encode(texts[a:b])):
                    sums.setdefault(name, np.zeros(dimensions))
                    sums[name] += row
        for name, row in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(row)], names=["lang", "i", "v"])

    rows = (picked.select(F.col(text).alias("t"), F.col(lang).alias("l")).mapInArrow(partial, "lang string, i int, v double")
            .groupBy("lang", "i").agg(F.sum("v").alias("v")).toPandas())
    names = sorted(rows["lang"].unique())
    found = np.array([rows[rows["lang"] == n].sort_values("i")["v"].to_numpy() for n in names]).reshape(len(names), dimensions)
    length = np.linalg.norm(found, axis=1, keepdims=True)
    return names, np.divide(found, length, out=np.zeros_like(found), where=length > 0)


def identify(docs: DataFrame, names: list[str], profiles: np.ndarray, text: str = "text", into: str = "language",
             seed: int = 17) -> DataFrame:
    """``docs`` with a struct ``into``: ``lang`` (a learned name, ``und`` without letters) and ``score``, the cosine.

    A null text, or one without a letter, is ``und`` with score 0, as is every text if nothing was learned. Ties go
    to the first name by code point. Rows are independent: equal texts get equal answers, and only the profiles
    (languages x dimensions numbers) are shipped to the tasks.
    """
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])
    dimensions, learned = profiles.shape[1] if len(names) else 1, profiles.astype(np.float32)

    @arrow_udf("struct<lang:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(dimensions, seed)
        for batch in slices(batches):
            texts, out = batch.to_pylist(), []
            for a, b in portions(texts):
                rows = encoder.encode(texts[a:b])
                if not names:
                    out += [(UNKNOWN, 0.0)] * len(rows)
                    continue
                cosines = rows @ learned.T
                best = cosines.argmax(1)
                out += [(names[j], float(min(1.0, max(0.0, c[j])))) if r.any() else (UNKNOWN, 0.0) for r, c, j in zip(rows, cosines, best)]
            yield pa.array([{"lang": x, "score": y} for x, y in out], kind)

    return docs.withColumn(into, predict(F.col(text).cast("string")))


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % 4 == 2


def op3_language_id(spark, sf_dir):
    from strandmill.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    names, profiles = fit_profiles(docs.where(~F.coalesce(held_out(), F.lit(False))))
    return identify(docs.drop("lang"), names, profiles).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score")
