"""Language identification: TF-IDF vectors of byte n-grams against several centroids per language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, slices, table

#: Hashed dimensions of the n-gram vectors.
DIMS = 1 << 12
#: Centroids per language.
CENTROIDS = 4
#: About so many labelled rows a language are learned from, drawn by hash; all if there are fewer. The bound of the fit.
FIT_ROWS = 600
#: A text is rejected if its cosine to the nearest centroid is below this share of the low quantile in the fit.
REJECT_SHARE, REJECT_QUANTILE = 0.5, 0.01
#: Whole texts of so many n-grams set the least cosine from there on; below, excerpts of these lengths do, and lengths between go by the logarithm.
REJECT_GRAMS = 200
EXCERPTS = (1, 2, 4, 8, 16, 32, 64, 128)
UNKNOWN = "und"

#: ASCII letters in lower case and bytes of other characters stay; the rest is a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: What may be a letter: signs such as ½ and ² count as word characters, but are none.
_WORD = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return text is not None and any(m[0].isalpha() for m in _WORD.finditer(text))


def folded_bytes(text: str | None) -> bytes:
    """Letters alone, runs of others as one space; what trigrams are taken from."""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_FOLD).split()) + b" " if text else b""


def counts(texts: list[str | None]) -> np.ndarray:
    """Hashed counts of the byte trigrams of each whole text."""
    return trigrams([folded_bytes(t) for t in texts])


def trigrams(texts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(texts), DIMS), np.float32)
    for k, folded in enumerate(texts):
        for at in range(0, len(folded), 1 << 20):  # an n-gram that begins in a piece is counted there
            b = np.frombuffer(folded[at : at + (1 << 20) + 2], np.uint8).astype(np.uint32)
            if len(b) > 2:
                h = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 12)
                out[k] += np.bincount(h, minlength=DIMS)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


@dataclass
class Model:
    """Centroids (unit rows), the language of each, the IDF of each dimension and the least cosine that isn't rejected, by n-grams in ascending order."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    grams: np.ndarray
    least: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[bool]]:
        """Language, cosine in [0, 1] and whether it is rejected. Without a letter, or without a model: und, 0, rejected."""
        if not len(self.centroids):
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), [True] * len(texts)
        x = counts(texts)
        least = np.interp(np.log(np.maximum(x.sum(axis=1, dtype=np.float64), 1)), np.log(self.grams), self.least)
        centroids, cosine = self.centroids.astype(np.float64), np.zeros((len(texts), len(self.centroids)))
        for k, v in enumerate(x):  # one by one, in double: a score doesn't depend on the rows beside it
            at = np.flatnonzero(v)
            own = v[at] * self.idf[at].astype(np.float64)
            cosine[k] = centroids[:, at] @ own / np.sqrt(own @ own) if len(at) else 0
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best], 0, 1)
        known = np.array([has_letter(t) for t in texts], bool)
        score[~known] = 0
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], score, ((score < least) | ~known).tolist()


def clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of unit rows: the first centre is nearest to the mean, each next is the row farthest from all so far."""
    centres = x[[int((x @ x.mean(axis=0)).argmax())]]
    while len(centres) < min(k, len(x)):
        far = (x @ centres.T).max(axis=1)
        if far.min() > 0.9999:
            break
        centres = np.vstack([centres, x[[int(far.argmin())]]])
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        centres = unit(np.vstack([x[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))]))
    return centres


def learnable(doc_id: Column) -> Column:
    """Rows that may be learned from: the CRC-32 of the id as text isn't 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def fit(docs: DataFrame, rows: int = FIT_ROWS, centroids: int = CENTROIDS) -> Model:
    """A model of the labelled, learnable rows of ``docs(doc_id, text, lang)``.

    About ``rows`` rows a language, drawn by a hash of the id, go to one vector each where they
    lie; only these bounded vectors, as sparse counts, and two excerpts of each reach the driver. Languages are the
    values of ``lang``; no labelled rows give an empty model.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learnable(F.col("doc_id"))).select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), F.col("text").alias("body"))
    totals = {r["language"]: r["n"] for r in known.groupBy("language").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return Model(np.ones(DIMS, np.float32), np.empty((0, DIMS), np.float32), [], np.ones(1), np.zeros(1))
    shares = F.create_map(*[F.lit(x) for lang, n in sorted(totals.items()) for x in (lang, min(1.0, rows / n))])
    drawn = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.element_at(shares, F.col("language")) * float(1 << 30))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column("body").to_pylist()
            keep = [k for k, t in enumerate(texts) if has_letter(t)]
            folded = [folded_bytes(texts[k]) for k in keep]
            x = trigrams(folded)
            most = EXCERPTS[-1] + 2
            at = [np.flatnonzero(v) for v in x]
            yield pa.RecordBatch.from_arrays(
                [b.column("language").take(pa.array(keep, pa.int32())), b.column("id").take(pa.array(keep, pa.int32())).cast(pa.int64()), pa.array([a.astype(np.int16).tobytes() for a in at], pa.binary()), pa.array([v[a].tobytes() for v, a in zip(x, at, strict=True)], pa.binary()), pa.array([f[:most] for f in folded], pa.binary()), pa.array([f[len(f) // 2 :][:most] for f in folded], pa.binary())],
                ["language", "id", "at", "n", "head", "middle"],
            )

    got = sorted(map(tuple, drawn.mapInArrow(vectors, "language string, id long, at binary, n binary, head binary, middle binary").collect()), key=lambda r: (r[0], r[1], bytes(r[2]), bytes(r[3])))
    x = np.zeros((len(got), DIMS), np.float32)
    for k, (_, _, at, n, _, _) in enumerate(got):
        x[k, np.frombuffer(at, np.int16)] = np.frombuffer(n, np.float32)
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    telling = x.sum(axis=1) >= REJECT_GRAMS
    x, own = unit(x * idf), np.array([r[0] for r in got])
    parts = [(lang, clusters(x[own == lang], centroids)) for lang in sorted(set(own.tolist()))]
    if not parts:
        return Model(idf, np.empty((0, DIMS), np.float32), [], np.ones(1), np.zeros(1))
    c = np.vstack([p for _, p in parts])
    low = lambda v: float(np.quantile((v @ c.T).max(axis=1), REJECT_QUANTILE)) * REJECT_SHARE
    excerpts = [bytes(t) for r in got for t in (r[4], r[5])]
    known = [(k, low(unit(trigrams(cut) * idf))) for k in EXCERPTS if (cut := [t[: k + 2] for t in excerpts if len(t) >= k + 2])]
    if telling.any():
        least = low(x[telling])
        known = [*((k, min(v, least)) for k, v in known), (REJECT_GRAMS, least)]
    grams, least = map(np.array, zip(*known, strict=True))
    return Model(idf, c, [lang for lang, p in parts for _ in p], grams, least)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, row_key, lang_pred, score, rejected) of every row; the text alone decides.

    Null texts and texts without a letter are ``und`` with score 0 and rejected; short texts are judged
    by a looser bound, as excerpts of their length in the fit set it; long texts count
    whole; ties go to the first language by name; an empty table gives no rows. The model is
    bounded (centroids by dimensions), so it may go with the tasks.
    """

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lang, score, rejected = model.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "row_key", "lang_pred", "score", "rejected"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), "text")
    return slim.mapInArrow(predicted, "doc_id long, row_key long, lang_pred string, score double, rejected boolean")


def accepted(model: Model):
    """A column function that tells of a text whether the model accepts it, by the rules of ``identify``."""

    @F.arrow_udf("boolean")
    def fits(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in texts:
            out = []
            for at in range(0, len(whole), SLICE):
                out += [not x for x in model.predict(whole.slice(at, SLICE).to_pylist())[2]]
            yield pa.array(out, pa.bool_())

    return fits


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
