"""Language identification by the nearest of several clustered centroids a language.

A text is a vector of its letter n-grams (two and three code points of lower-cased text, word ends marked by a
blank), hashed to DIM places: (1 + ln tf) * idf, of length one. fit() counts document frequencies over all
training rows, and clusters a bounded sample of each language (FIT_PER_LANGUAGE rows with the lowest digests) into
CENTROIDS directions by cosine. identify() gives each text the language of the centroid with the highest cosine,
and rejects it if that cosine lies below what that centroid's own sample shows (mean - SPREAD deviations).

Scale: fit reads the texts twice (frequencies, sample) and identify once, each a map without a shuffle of texts; what
moves are DIM counts a task and the sample's sparse vectors. The model, CENTROIDS * DIM numbers for each language, is
sent to tasks; its size is checked against MAX_LANGUAGES.

Defined results: null texts and texts without a letter are `und` with score 0 and rejected; with no language learned
(no labelled training row with letters, an empty table) all are. Equal cosines go to the alphabetically first
language. Rows that repeat are predicted alike, and count each in training. A null doc_id is not held out, and
never trains. Other columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trowel.llm.arrays import squeeze, tidy, unsqueeze
from trowel.session import ship_package, stage_table

#: Places of the hashed vectors, a power of two.
DIM = 1 << 13
#: Clusters of each language, and rows of it that they are fitted on at most.
CENTROIDS, FIT_PER_LANGUAGE = 4, 500
#: Rounds of clustering; deviations below a cluster's mean cosine that are still accepted.
ROUNDS, SPREAD = 12, 4.0
#: Languages that a model may have: CENTROIDS * DIM * 4 bytes each go to every task.
MAX_LANGUAGES = 1000
#: Characters and texts that are counted at a time; a longer text is counted alone.
CHARS, TEXTS = 1 << 20, 256

UNKNOWN = "und"
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """For each code point, whether Unicode calls it a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def text_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """For each n-gram of the texts: the number of its text, and its place."""
    low = [" " + (t or "").lower() for t in texts]
    codes = np.frombuffer("".join([*low, "  "]).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(low) + 1), [*map(len, low), 2])
    letter = _is_letter()[codes]
    first = np.ones(len(codes), bool)  # of a run of other characters, the one that ends a word, or a text's first
    first[1:] = letter[1:] | letter[:-1] | (owner[1:] != owner[:-1])
    codes, owner, letter = np.where(letter, codes, 32)[first].astype(np.uint32), owner[first], letter[first]
    pair, out = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA77), []
    starts = letter[:-1] | letter[1:]
    starts &= (owner[:-1] == owner[1:]) | ~letter[1:]
    out.append((owner[:-1][starts], pair[starts]))
    three = letter[1:-1] & (owner[:-2] == owner[1:-1])
    triple = pair[:-1] * np.uint32(0xC2B2AE3D) + codes[2:] * np.uint32(0x27D4EB2F)
    out.append((owner[:-2][three], triple[three]))
    h = np.concatenate([x[1] for x in out])
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return np.concatenate([x[0] for x in out]), (h >> np.uint32(32 - DIM.bit_length() + 1)).astype(np.int64)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, room = i, CHARS
        while j < len(texts) and j - i < TEXTS and (j == i or room > 0):
            room -= len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def counted(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, end, counts by text and place) for runs of texts."""
    for i, j in _slices(texts):
        owner, place = text_grams(texts[i:j])
        yield i, j, np.bincount(owner * DIM + place, minlength=(j - i) * DIM)[: (j - i) * DIM].reshape(j - i, DIM)


def weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of (1 + ln tf) * idf of length one; a row of zeros stays."""
    tf = np.log(np.maximum(counts, 1).astype(np.float32)) + (counts > 0).astype(np.float32)
    x = tf * idf.astype(np.float32)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
    return x / np.where(norm > 0, norm, 1)[:, None].astype(np.float32)


def cluster(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """At most k centroids of length one of the rows of x by cosine, and the number of each row's; begun far apart."""
    mean = x.mean(0)
    picked, closest = [int(np.argmax(x @ mean))], None
    while len(picked) < min(k, len(x)):
        cos = x @ x[picked[-1]]
        closest = cos if closest is None else np.maximum(closest, cos)
        picked.append(int(np.argmin(closest)))
    centre = x[picked]
    for _ in range(ROUNDS):
        own = np.argmax(x @ centre.T, 1)
        sums = np.stack([x[own == c].sum(0) if (own == c).any() else centre[c] for c in range(len(centre))])
        new = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)[:, None]
        if np.allclose(new, centre, atol=1e-6):
            break
        centre = new.astype(np.float32)
    return centre, np.argmax(x @ centre.T, 1)


@dataclass
class Model:
    """idf by place; a row of centres, a language and a lowest accepted cosine for each centroid, by language."""

    idf: np.ndarray
    centres: np.ndarray
    langs: list[str]
    least: np.ndarray


def in_fold(doc_id: Column, fold: int = 2, folds: int = 4) -> Column:
    """Is crc32 of the decimal doc_id in this fold? Null for null."""
    return F.crc32(doc_id.cast("string")) % folds == fold


def _frequencies(train: DataFrame) -> tuple[int, np.ndarray]:
    """Texts with letters, and for each place the number of texts that have it: over all rows."""

    def rows(batches):
        total, docs = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for _, _, counts in counted(batch.column(0).to_pylist()):
                total += (counts > 0).sum(0)
                docs += int(counts.any(1).sum())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([docs, *total[at].tolist()], pa.int64())], ["place", "n"])

    found = train.select("text").mapInArrow(tidy(rows), "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()  # DIM + 1 rows at most
    df = np.zeros(DIM, np.int64)
    for place, n in found:
        if place >= 0:
            df[place] = n
    return next((n for place, n in found if place < 0), 0), df


def _sample(train: DataFrame) -> DataFrame:
    """(lang, digest, text): FIT_PER_LANGUAGE rows of each language at most, those with the lowest digests."""
    sizes = train.groupBy("lang").count().select("lang", (F.lit(float(3 * FIT_PER_LANGUAGE)) / F.col("count") * 2.0**63).alias("most"))
    sizes = stage_table(train.sparkSession, sizes, "languages")
    if sizes.count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    dealt = train.select("lang", "text", F.xxhash64("doc_id", "text").alias("digest"))
    near = dealt.join(F.broadcast(sizes), "lang").where(F.shiftright("digest", 1) + F.lit(2**62) <= F.col("most"))
    best = F.row_number().over(Window.partitionBy("lang").orderBy("digest", "text"))
    return near.withColumn("nth", best).where(F.col("nth") <= FIT_PER_LANGUAGE).select("lang", "digest", "text")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """A model of the languages of docs, all of whose rows with a lang are learned from."""
    spark = docs.sparkSession
    ship_package(spark)
    train = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null and text is not null and doc_id is not null")
    n, df = _frequencies(train)
    idf = np.log((1 + n) / (1 + df)) + 1

    def vectors(batches):
        for batch in batches:
            blobs: list[bytes] = []
            for _, _, counts in counted(batch.column(2).to_pylist()):
                for row in weighed(counts, idf):
                    at = np.flatnonzero(row)
                    blobs.append(squeeze(at.astype("<u4").tobytes() + row[at].astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], ["lang", "digest", "vector"])

    def centroids(group: pa.Table) -> pa.Table:
        found = sorted(zip(group.column("digest").to_pylist(), group.column("vector").to_pylist(), strict=True))
        x = np.zeros((len(found), DIM), np.float32)
        for row, (_, blob) in zip(x, found, strict=True):
            raw = unsqueeze(blob)
            row[np.frombuffer(raw[: len(raw) // 2], "<u4")] = np.frombuffer(raw[len(raw) // 2 :], "<f4")
        x = x[x.any(1)]
        if not len(x):
            return pa.table({"lang": pa.array([], pa.string()), "nth": pa.array([], pa.int32()), "centre": pa.array([], pa.binary()), "least": pa.array([], pa.float64())})
        centre, own = cluster(x, CENTROIDS)
        cos = np.einsum("ij,ij->i", x, centre[own])
        every = float(cos.mean() - SPREAD * cos.std())
        least = [float(max(0.0, c.mean() - SPREAD * c.std())) if len(c := cos[own == k]) >= 10 else max(0.0, every) for k in range(len(centre))]
        name = group.column("lang")[0].as_py()
        return pa.table({"lang": [name] * len(centre), "nth": pa.array(range(len(centre)), pa.int32()), "centre": [c.astype("<f4").tobytes() for c in centre], "least": least})

    packed = _sample(train).mapInArrow(tidy(vectors), "lang string, digest long, vector binary")
    model = stage_table(spark, packed.groupBy("lang").applyInArrow(centroids, "lang string, nth int, centre binary, least double"), "centroids")
    rows = sorted(model.collect())
    centres = np.array([np.frombuffer(r.centre, "<f4") for r in rows], np.float32).reshape(len(rows), DIM)
    return Model(idf, centres, [r.lang for r in rows], np.array([r.least for r in rows]))


def predict(texts: list[str | None], model: Model) -> Iterator[tuple[str, float, bool]]:
    """(language, cosine, accepted) of each text."""
    for i, j, counts in counted(texts):
        some = counts.any(1)
        if not model.langs:
            yield from ((UNKNOWN, 0.0, False) for _ in range(i, j))
            continue
        cos = weighed(counts, model.idf) @ model.centres.T
        best = np.argmax(cos, 1)
        for row, k in enumerate(best.tolist()):
            c = min(1.0, max(0.0, float(cos[row, k])))
            yield (model.langs[k], c, bool(c >= model.least[k])) if some[row] else (UNKNOWN, 0.0, False)


def identify(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, lang_pred, score (cosine), accepted."""
    ship_package(docs.sparkSession)
    rest = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for batch in batches:
            found = list(predict(batch.column(1).to_pylist(), shared.value))
            columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "lang_pred", "score", "accepted"])

    kind = rest.schema["doc_id"].dataType.simpleString()
    return rest.mapInArrow(tidy(rows), f"doc_id {kind}, lang_pred string, score double, accepted boolean")


def language_report(docs: DataFrame) -> DataFrame:
    """Per row of documents: doc_id, held_out, lang_pred, score, accepted; learned from the rows that are not held out."""
    held = in_fold(F.col("doc_id"))
    found = identify(docs, fit(docs.where(~held)))
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
