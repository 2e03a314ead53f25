"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted across the corpus.

Plan. Documents are dealt to chunks, each a contiguous range of doc_id with about the same bytes. A chunk hashes all its
windows and sends each *distinct* hash once, as sorted, delta-coded lists per hash bucket. A bucket
tells, for every hash, which chunks hold it; every chunk but the lowest gets the hash back. A window
is then known to start earlier iff its chunk got the hash back (an earlier chunk has it) or the hash
occurred before in the chunk itself. Repeated windows merge into maximal removal intervals.

Skew: a passage shared by any number of documents is at most one entry per chunk, and an entry
per bucket and chunk; no task sees a row per occurrence. Memory: a chunk of text, or a bucket of
hashes, both sized by parameters. Hash: 96 bits, of two hashes of each word by other codes and bases: 64 by
which windows are sorted and dealt, and 32 that are compared with them. Of a corpus of n windows, about
n * n / 2 ** 97 pairs of different windows are taken for equal: 0.005 at 100 TB (some 2.7 * 10 ** 13 windows).

Defined results: null or empty text has no words (n_words 0, kept_sha256 of the empty string);
rows that repeat a doc_id are ordered by text and count as separate documents, each later one a
repetition of the earlier; null doc_ids sort before all others, in an order of their own by a digest of
the text, and stay null in the result.
Columns other than doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trowel.llm.arrays import (
    U64,
    cut_by_top_bits,
    pack_docs,
    pack_sorted,
    pair_order,
    pairs_found,
    second_hashes,
    slices,
    text_buffers,
    tidy,
    unpack_docs,
    unpack_sorted,
    window_owner,
    windows,
    words_of,
)
from trowel.session import input_bytes, ship_package, shuffle_parts, stage_table

#: Stands for a null doc_id inside chunks.
NO_ID = -(1 << 63)


#: Ranges of ids whose bytes the driver sees at a time.
BINS = 20_000


def chunk_bounds(docs: DataFrame, chunk_bytes: int) -> tuple[list[int], int]:
    """Last ids of chunks of about chunk_bytes of text, and the number of chunks for rows without an id.

    The bytes of equal ranges of ids are added up in Spark; ranges above a chunk are cut finer, all together,
    until none is: once or twice, unless ids lie far apart. The driver sees BINS sums a pass, and holds 8
    bytes a chunk.
    """
    spark = docs.sparkSession
    sizes = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("bytes"))
    sizes = stage_table(spark, sizes, "sizes")
    ends = sizes.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.sum(F.when(F.col("id").isNull(), F.col("bytes"))).alias("lost"), F.count_if(F.col("id").isNull()).alias("n_lost")).first()
    lost = -(-(ends["lost"] or 0) // chunk_bytes) or int(ends["n_lost"] > 0)
    if ends["low"] is None:
        return [], lost
    low, width = ends["low"], ends["high"] - ends["low"] + 1
    # ids may be further apart than a long
    place = lambda step: F.expr(f"cast((cast(id as decimal(20, 0)) - cast({low} as decimal(20, 0))) div cast({step} as decimal(20, 0)) as long)")
    done: list[tuple[int, int]] = []  # last id and bytes of ranges
    held, power = sizes.where("id is not null"), max(0, (-(-width // BINS) - 1).bit_length())  # ranges of 2 ** power ids, so finer ones nest
    while True:
        step = 1 << power
        sums = held.groupBy(place(step).alias("bin")).agg(F.sum("bytes").alias("bytes")).collect()  # some BINS rows
        heavy = [r["bin"] for r in sums if r["bytes"] > chunk_bytes and power]
        done += [(min(low + (r["bin"] + 1) * step - 1, ends["high"]), r["bytes"]) for r in sums if r["bytes"] <= chunk_bytes or not power]
        if not heavy:
            break
        held = sizes.where("id is not null").withColumn("bin", place(step)).join(F.broadcast(spark.createDataFrame([(b,) for b in heavy], "bin long")), "bin", "left_semi")  # BINS rows at most
        power = max(0, power - max(1, (BINS // len(heavy)).bit_length() - 1))
    cuts, held_bytes = [], 0
    for last, n in sorted(done):
        held_bytes += n
        if held_bytes >= chunk_bytes:
            cuts.append(last)
            held_bytes = 0
    return cuts, lost


def _chunked(docs: DataFrame, bounds: list[int], lost: int) -> DataFrame:
    """(chunk, docs): documents of each input batch, packed by chunk. Rows without an id are in chunks below 0, by a digest of their text."""
    cuts = np.array(bounds, np.int64)

    def deal(batches):
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            data, offsets = text_buffers(batch.column(1))
            chunk = np.searchsorted(cuts, ids, "left")
            for i in np.flatnonzero(ids == NO_ID).tolist():
                chunk[i] = -1 - int.from_bytes(hashlib.blake2b(data[offsets[i] : offsets[i + 1]].tobytes(), digest_size=8).digest(), "little") % max(1, lost)
            order = np.argsort(chunk, kind="stable")
            edges = np.flatnonzero(np.diff(chunk[order], prepend=-1 - max(1, lost) - 1))
            for take in np.split(order, edges[1:]):
                if len(take):
                    yield pa.RecordBatch.from_arrays([pa.array([int(chunk[take[0]])], pa.int32()), pa.array([pack_docs(ids, data, offsets, take)], pa.binary())], ["chunk", "docs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(deal), "chunk int, docs binary")


def _hashes(data: np.ndarray, offsets: np.ndarray, width: int):
    """For each slice of documents: first and last document, words, hash and check of each window, which windows count."""
    for i, j in slices(offsets):
        words = words_of(data, offsets[i : j + 1])
        check = (windows(second_hashes(words), width, 0xD1342543DE82EF95) >> U64(32)).astype(np.uint32)
        yield i, j, words, windows(words.hashes, width), check, window_owner(words.bounds, width, len(words.hashes))


def _again(h: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Of pairs in order, which equal the one before?"""
    out = np.zeros(len(h), bool)
    out[1:] = (h[1:] == h[:-1]) & (check[1:] == check[:-1])
    return out


def _checks(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u4") for x in column.to_pylist()]


def _send(width: int, bits: int):
    def send(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        _, data, offsets = unpack_docs(table.column("docs").to_pylist())
        parts = [(h[ok], check[ok]) for *_, h, check, ok in _hashes(data, offsets, width)]
        own, check = np.concatenate([p[0] for p in parts] or [np.zeros(0, U64)]), np.concatenate([p[1] for p in parts] or [np.zeros(0, np.uint32)])
        rank = pair_order(own, check)
        own, check = own[rank], check[rank]
        first = ~_again(own, check)
        own, check = own[first], check[first]
        cuts = cut_by_top_bits(own, bits)
        full = np.flatnonzero(np.diff(cuts))
        lists = [slice(cuts[b], cuts[b + 1]) for b in full]
        return pa.table(
            {"bucket": pa.array(full, pa.int32()), "chunk": pa.array([chunk] * len(full), pa.int32()), "hashes": pa.array([pack_sorted(own[x]) for x in lists], pa.binary()), "checks": pa.array([check[x].astype("<u4").tobytes() for x in lists], pa.binary())}
        )

    return send


def _reply(table: pa.Table) -> pa.Table:
    order = np.argsort(table.column("chunk").to_numpy(), kind="stable")
    chunks = table.column("chunk").to_numpy()[order]
    table = table.take(pa.array(order))
    parts = [unpack_sorted(x) for x in table.column("hashes").to_pylist()]
    every, check, owner = np.concatenate(parts), np.concatenate(_checks(table.column("checks"))), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    rank = pair_order(every, check)
    every, check, owner = every[rank], check[rank], owner[rank]
    later = _again(every, check)
    every, check, owner = every[later], check[later], owner[later]
    rank = np.argsort(owner, kind="stable")
    every, check, owner = every[rank], check[rank], owner[rank]
    cuts = np.searchsorted(owner, np.arange(len(parts) + 1))
    full = np.flatnonzero(np.diff(cuts))
    bucket = table.column("bucket")[0].as_py()
    lists = [slice(cuts[i], cuts[i + 1]) for i in full]
    return pa.table(
        {"chunk": pa.array(chunks[full], pa.int32()), "bucket": pa.array([bucket] * len(full), pa.int32()), "earlier": pa.array([pack_sorted(every[x]) for x in lists], pa.binary()), "checks": pa.array([check[x].astype("<u4").tobytes() for x in lists], pa.binary())}
    )


def _cover(n_words: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a window that begins at one of starts."""
    steps = np.zeros(n_words + 1, np.int64)
    steps[starts] += 1  # starts are distinct
    np.subtract.at(steps, starts + width, 1)
    return np.cumsum(steps)[:n_words] > 0


def _finish(width: int, spans: bool):
    def finish(docs: pa.Table, replies: pa.Table) -> pa.Table:
        ids, data, offsets = unpack_docs(docs.column("docs").to_pylist())
        order = np.argsort(replies.column("bucket").to_numpy()) if len(replies) else []
        lists, checks = replies.column("earlier").to_pylist(), _checks(replies.column("checks"))
        earlier = np.concatenate([unpack_sorted(lists[i]) for i in order]) if len(lists) else np.zeros(0, U64)
        earlier_check = np.concatenate([checks[i] for i in order]) if len(lists) else np.zeros(0, np.uint32)
        every = [(h, check, ok) for *_, h, check, ok in _hashes(data, offsets, width)]
        counted = np.concatenate([h[ok] for h, _, ok in every] or [np.zeros(0, U64)])
        check = np.concatenate([c[ok] for _, c, ok in every] or [np.zeros(0, np.uint32)])
        again = pairs_found(counted, check, earlier, earlier_check)
        rank = pair_order(counted, check)
        again[rank[_again(counted[rank], check[rank])]] = True
        flags = [ok for *_, ok in every]
        del counted, check, rank, every
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept": [], "spans": []}
        used = 0
        for (i, j), ok in zip(slices(offsets), flags, strict=True):
            words = words_of(data, offsets[i : j + 1])
            flag = np.zeros(len(ok), bool)
            flag[ok] = again[used : used + int(ok.sum())]
            used += int(ok.sum())
            gone = _cover(len(words.size), np.flatnonzero(flag), width)
            sums = np.concatenate(([0], np.cumsum(gone)))[words.bounds]
            out["n_words"] += np.diff(words.bounds).tolist()
            out["n_removed"] += np.diff(sums).tolist()
            kept_bytes = words.letters[np.repeat(~gone, words.size)]
            sizes = words.size[~gone]
            line = np.full(len(kept_bytes) + len(sizes), 0x20, np.uint8)
            line[np.arange(len(kept_bytes)) + np.repeat(np.arange(len(sizes)), sizes)] = kept_bytes
            ends = np.concatenate(([0], np.cumsum(sizes + 1)))[words.bounds - sums]
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                text = line[a : max(a, b - 1)].tobytes()
                out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
                if spans:
                    out["kept"].append(text.decode("utf-8"))
            if spans:
                for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone[a:b], [False])).astype(np.int8)))
                    out["spans"].append([{"first": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)])
        columns = {"doc_id": pa.array(ids, pa.int64(), mask=ids == NO_ID), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string())}
        if spans:
            columns |= {"kept": pa.array(out["kept"], pa.string()), "spans": pa.array(out["spans"], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))}
        return pa.table(columns)

    return finish


#: Chunks, and buckets, of an input, about, from which on they get larger with it; and how large at most.
MOST_CHUNKS, CHUNK_MOST, BUCKET_MOST = 50_000, 64 << 20, 96 << 20


def remove_repeated_windows(docs: DataFrame, width: int = 20, chunk_bytes: int = 4 << 20, bucket_bytes: int = 6 << 20, with_text: bool = False) -> DataFrame:
    """Per document: n_words, n_removed, kept_sha256 and, with_text, the kept text and the removed word intervals.

    chunk_bytes and bucket_bytes are sizes of (compressed) input per chunk and per bucket of hashes. Chunks
    times buckets are the lists that are sent; both sizes grow with a large input so that lists stay long:
    some 60 hashes each at 1 TB, 10 at 100 TB.
    """
    spark = docs.sparkSession
    ship_package(spark)
    size = input_bytes(docs)
    chunk_bytes = max(chunk_bytes, min(CHUNK_MOST, size // MOST_CHUNKS))
    bucket_bytes = max(bucket_bytes, min(BUCKET_MOST, size // MOST_CHUNKS))
    bits = int(max(2 * shuffle_parts(spark), size // bucket_bytes, 1) - 1).bit_length()
    # at least 64 chunks, of text that is some two times its compressed size
    packed = _chunked(docs, *chunk_bounds(docs, max(1, min(2 * chunk_bytes, 2 * size // 64))))
    sent = packed.groupBy("chunk").applyInArrow(_send(width, bits), "bucket int, chunk int, hashes binary, checks binary")
    replies = sent.groupBy("bucket").applyInArrow(_reply, "chunk int, bucket int, earlier binary, checks binary")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string, spans array<struct<first: bigint, end: bigint>>" if with_text else "")
    return packed.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_finish(width, with_text), schema)
