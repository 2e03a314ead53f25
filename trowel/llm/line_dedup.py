"""Line dedup by content-defined chunks of lines; DataFrame functions only.

A polynomial hash rolls over the hashes of the last WINDOW lines and ends a chunk where, of 16 residues,
it has one below CUT: boundaries depend on nearby lines alone and survive insertions elsewhere. Chunks of
two lines or more that occur earlier in the corpus, by (doc_id, chunk number), are removed once their
text equals the first occurrence's byte for byte; all other lines stay, in order.

Plan: only (digest, doc_id, number) of chunks is shuffled to find repeated ones: a grouped minimum,
combined before the shuffle, and a join back in which frequent chunks meet a broadcast table of
bounded size. The first occurrences' texts are fetched by doc_id; of a frequent chunk, the text is
spread over as many salts as it has shares of rows, so no task compares all its occurrences. Each
document then holds the first texts by chunk number, and compares each chunk once. Bitmaps of the
documents that hold first or later occurrences keep all other texts out of these joins: they are not
shuffled, and not changed.

Defined results: null text stays null and has no lines; empty text has one empty line. Rows that
repeat a doc_id count as one document: a chunk that is first in it stays in all of them. A null doc_id
sorts first. Further columns are kept, also such as are named like ours (except in the report).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trowel.operators.relations import hot_limit, join_hot, possible
from trowel.session import shuffle_parts, stage_table

#: Of 16 residues of the rolling hash, how many end a chunk: chunks have 16 / CUT lines on average.
CUT = 5
#: Lines that the hash rolls over, its base, and its modulus, a prime.
WINDOW, BASE, MODULUS = 2, 1_000_003, (1 << 31) - 1


def _chunked(docs: DataFrame) -> DataFrame:
    """docs with lines and chunks, an array of (no, first, n): chunk number, first line from 1, number of lines."""
    lines = docs.withColumn("lines", F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1))
    # a line's hash: the first 32 bits of its md5
    hashed = lines.withColumn("h", F.transform("lines", lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")))

    def rolling(x: Column, i: Column) -> Column:
        value = F.lit(0).cast("long")
        for back in range(WINDOW - 1, 0, -1):
            value = (value * BASE + F.get(F.col("h"), i - back)) % MODULUS
        return (value * BASE + x) % MODULUS

    # a chunk ends where the hash of a whole window is low, and at the last line
    rolled = hashed.withColumn("low", F.transform("h", lambda x, i: (i >= WINDOW - 1) & (rolling(x, i) % 16 < CUT)))
    ended = rolled.withColumn("ends", F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: (i == F.size("lines")) | F.get(F.col("low"), i - 1)))
    start = lambda k: F.when(k == 0, F.lit(1)).otherwise(F.get(F.col("ends"), k - 1) + 1)
    chunk = lambda e, k: F.struct(k.alias("no"), start(k).alias("first"), (e - start(k) + 1).alias("n"))
    return ended.withColumn("chunks", F.transform("ends", chunk)).drop("h", "low", "ends")


def _text(chunk: Column) -> Column:
    return F.array_join(F.slice(F.col("lines"), chunk["first"], chunk["n"]), "\n")


def _same_doc(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(id, gone): for each doc_id with later occurrences of chunks, the text of the first occurrence at the chunk's number, else null."""
    own = _chunked(docs.select("doc_id", "text")).withColumn("chunks", F.filter("chunks", lambda c: c["n"] > 1))
    digests = own.select("doc_id", F.explode(F.transform("chunks", lambda c: F.struct(c["no"].alias("no"), F.unhex(F.md5(_text(c))).alias("digest")))).alias("c"))
    chunks = stage_table(docs.sparkSession, digests.select("doc_id", "c.no", "c.digest"), "chunks")
    spark = docs.sparkSession
    limit = hot_limit(chunks.count(), shuffle_parts(spark))
    place = F.struct("doc_id", "no")
    first = chunks.groupBy("digest").agg(F.min(place).alias("f"), F.max(place).alias("l"), F.count("*").alias("n")).where("f <> l")
    first = stage_table(spark, first.select("digest", F.col("f.doc_id").alias("f_doc"), F.col("f.no").alias("f_no"), "n"), "first")
    salts = F.ceil(F.col("n") / limit)
    later = join_hot(chunks, "digest", first, limit).where(~(_same_doc("doc_id", "f_doc") & (F.col("no") == F.col("f_no"))))
    later = later.select("digest", "doc_id", "no", F.pmod(F.xxhash64("doc_id", "no"), salts).alias("salt")).distinct()
    wanted = first.groupBy("f_doc").agg(F.collect_list(F.struct(F.col("f_no").alias("no"), "digest")).alias("want"))
    holding = possible(docs.select("doc_id", "text"), "doc_id", first.select(F.col("f_doc").alias("doc_id")), first.count()).where("may").drop("may")
    held = _chunked(holding.join(wanted, _same_doc("doc_id", "f_doc")))
    found = held.select(F.explode(F.transform("want", lambda w: F.struct(w["digest"].alias("digest"), _text(F.get(F.col("chunks"), w["no"])).alias("text")))).alias("t")).select("t.digest", "t.text")
    texts = found.where(F.unhex(F.md5("text")) == F.col("digest")).groupBy("digest").agg(F.min("text").alias("first_text"))
    spread = texts.join(first.select("digest", salts.alias("salts")), "digest").select("digest", "first_text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    gone = later.join(spread, ["digest", "salt"]).groupBy(F.col("doc_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("no", "first_text"))).alias("gone"))
    return gone.select("id", _by_number(F.col("gone")).alias("gone"))


def _by_number(gone: Column) -> Column:
    """From (no, text) in order of no, the array that has each text at its number: chunks find theirs by index."""
    before = lambda j: F.coalesce(F.get(gone, j - 1)["no"], F.lit(-1))
    return F.flatten(F.transform(gone, lambda g, j: F.concat(F.array_repeat(F.lit(None).cast("string"), g["no"] - before(j) - 1), F.array(g["first_text"]))))


def _with_gone(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs without repeated chunks, and those that may have some, with gone; no row is in both."""
    gone = stage_table(docs.sparkSession, repeated_chunks(docs), "gone")
    marked = possible(docs, "doc_id", gone.select(F.col("id").alias("doc_id")), gone.count())
    return marked.where("not may").drop("may"), marked.where("may").drop("may").join(gone, _same_doc("doc_id", "id"), "left").drop("id")


def _judged(docs: DataFrame) -> DataFrame:
    """docs with lines, chunks and kept, the chunks that stay."""
    gone = lambda c: F.coalesce(F.get(F.col("gone"), c["no"]) == _text(c), F.lit(False))
    return _chunked(docs).withColumn("kept", F.when(F.col("gone").isNull(), F.col("chunks")).otherwise(F.filter("chunks", lambda c: ~gone(c))))


def _kept_text() -> Column:
    lines = F.flatten(F.transform("kept", lambda c: F.slice(F.col("lines"), c["first"], c["n"])))
    return F.when(F.col("gone").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))


def drop_repeated_chunks(docs: DataFrame) -> DataFrame:
    """docs, all columns, with text replaced by what stays."""
    alone, some = _with_gone(docs.select("doc_id", "text", F.struct("*").alias("row")))
    fixed = alone.select("row", "text").union(_judged(some).select("row", _kept_text().alias("text")))
    return fixed.select(*(F.col("text").alias("text") if c == "text" else F.col(f"row.{c}").alias(c) for c in docs.columns))


def dedup_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_chunks, n_removed_chunks, n_removed_lines, kept_text."""
    n = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["n"])
    null = F.col("text").isNull()
    alone, some = _with_gone(docs.select("doc_id", "text"))
    return _judged(alone.withColumn("gone", F.lit(None).cast("array<string>")).unionByName(some)).select(
        "doc_id",
        F.when(null, 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(null, 0).otherwise(F.size("chunks")).cast("long").alias("n_chunks"),
        (F.size("chunks") - F.size("kept")).cast("long").alias("n_removed_chunks"),
        (n(F.col("chunks")) - n(F.col("kept"))).cast("long").alias("n_removed_lines"),
        _kept_text().alias("kept_text"),
    )


#: DuckDB SQL for op5's rows over the table documents.
SQL = rf"""
WITH base AS (
  SELECT doc_id, text, lines, list_transform(lines, lambda l: CAST('0x' || substr(md5(l), 1, 8) AS BIGINT)) AS h
  FROM (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
), ended AS (
  SELECT doc_id, text, lines,
         list_filter(generate_series(1, len(lines)), lambda i: i = len(lines) OR (i > 1 AND ((h[i - 1] % {MODULUS} * {BASE} + h[i]) % {MODULUS}) % 16 < {CUT})) AS ends
  FROM base
), chunks AS (
  SELECT doc_id, k - 1 AS no, ends[k] - (CASE WHEN k = 1 THEN 0 ELSE ends[k - 1] END) AS n,
         array_to_string(list_slice(lines, (CASE WHEN k = 1 THEN 0 ELSE ends[k - 1] END) + 1, ends[k]), chr(10)) AS t
  FROM (SELECT doc_id, lines, ends, unnest(generate_series(1, len(ends))) AS k FROM ended)
), judged AS (
  SELECT *, n > 1 AND row_number() OVER (PARTITION BY n > 1, t ORDER BY doc_id NULLS FIRST, no) > 1 AS gone FROM chunks
)
SELECT e.doc_id,
       CAST(CASE WHEN any_value(e.text) IS NULL THEN 0 ELSE any_value(len(e.lines)) END AS BIGINT) AS n_lines,
       CAST(CASE WHEN any_value(e.text) IS NULL THEN 0 ELSE any_value(len(e.ends)) END AS BIGINT) AS n_chunks,
       CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed_chunks,
       CAST(sum(CASE WHEN gone THEN n ELSE 0 END) AS BIGINT) AS n_removed_lines,
       CASE WHEN any_value(e.text) IS NOT NULL THEN coalesce(string_agg(j.t, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '') END AS kept_text
FROM ended e JOIN judged j ON e.doc_id = j.doc_id GROUP BY e.doc_id
"""
