"""Ranked lexical search over a clustered index, with exact results.

Recursive graph bisection: documents and terms are a graph; a bounded sample of documents (SAMPLE rows with the lowest
digests) is cut in two so that terms lie on one side where they can, by swapping the documents that gain most, and each
part again, LEVELS times. What each cut has learned, the gain of either side for each term, then sends every document
of the corpus down the same tree: documents that share terms come to lie together, in one leaf, whatever their
doc_id. A leaf is stored as one shard or, by its bytes, several. A shard holds the postings of all its terms and, for
each term, the number of its documents, the greatest tf and the least length, from which follows a bound of any
document's score.

Search: an item's shards are ordered by their bounds. They are visited in rounds of growing numbers; an item is done
when no shard is left whose bound reaches the score of its last kept document (at an equal score, only one with a
lower doc_id matters). So nothing that belongs to the result is missed, and doc_ids, not places in the index,
break ties.

Scale: texts are read once for the index, where each task packs its documents by leaf, so what is shuffled are packed
postings. A leaf with a third of all rows is several shards, of SHARD_BYTES of postings each. Items are taken in
blocks of ITEMS rows; a block's terms go to tasks, which answer with numbers for a shard or TOP documents for an item.
Terms are told apart by 64-bit digests: with 10,000 terms asked and 10 billion in the corpus, the chance that any two
of them are alike is below one in 100,000.

Defined results: null or empty texts, and those without a term, are not counted in N and never found; items without a
term, null ones too, have no rows. Rows that repeat a doc_id are documents of their own, and rows that repeat an item
are each answered. A null doc_id comes last among equal scores. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trowel.llm.arrays import PUNCTUATION, U64, pack_sorted, slices, squeeze, text_buffers, tidy, unpack_sorted, unsqueeze, words_of
from trowel.session import ship_package, stage_table

#: Documents that the tree is fitted on, terms of it (those in most of them), and its cuts from root to leaf.
SAMPLE, TREE_TERMS, LEVELS = 4096, 1 << 15, 6
#: Rounds of swaps of a cut, at most.
SWAPS = 12
#: Bytes of packed postings of a shard, and of raw postings that a task holds before it packs them.
SHARD_BYTES, HELD = 4 << 20, 96 << 20
#: Items asked at a time; shards that an item visits in the first round, and how that grows.
ITEMS, FIRST, GROWTH = 2048, 1, 4
TOP = 50

BLOCK = "leaf int, nth long, size long, n_docs long, block binary"
SHARD = "leaf int, part int, n_docs long, n_live long, n_terms long, least_id long, terms binary, posts binary"
NO_ID = np.iinfo(np.int64).max


def doc_postings(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: first, end, terms with repeats of each text, and by text and term: number of the text, term, tf."""
    data, offsets = text_buffers(column)
    for i, j in slices(offsets):
        words = words_of(data, offsets[i : j + 1], lower=True, separators=PUNCTUATION)
        terms, which = np.unique(words.hashes, return_inverse=True)
        key = np.sort((words.doc_of().astype(np.int64) << 32) | which)
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        tf = np.diff(np.append(first, len(key)))
        yield i, j, np.diff(words.bounds), key[first] >> 32, terms[key[first] & 0xFFFFFFFF] if len(key) else terms, tf


def text_terms(texts: list[str | None]) -> list[np.ndarray]:
    """The different terms of each text, sorted."""
    out = []
    for i, j, _, doc, term, _ in doc_postings(pa.array(texts, pa.string())):
        cut = np.searchsorted(doc, np.arange(j - i + 1))
        out += [np.sort(term[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    return out


def _cost(degree: np.ndarray, size: int) -> np.ndarray:
    """Bits that a term's postings take on a side, about."""
    return degree * np.log2(max(size, 1) / (degree + 1))


def bisect(doc: np.ndarray, term: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """For each document, whether it is on the second side, halves of equal size; by swaps that save bits."""
    side = np.arange(n_docs) >= (n_docs + 1) // 2
    sizes = [(n_docs + 1) // 2, n_docs // 2]
    for _ in range(SWAPS):
        left, right = (np.bincount(term[side[doc] == s], minlength=n_terms) for s in (False, True))
        now = _cost(left, sizes[0]) + _cost(right, sizes[1])
        to_right = now - _cost(np.maximum(left - 1, 0), sizes[0]) - _cost(right + 1, sizes[1])
        to_left = now - _cost(left + 1, sizes[0]) - _cost(np.maximum(right - 1, 0), sizes[1])
        gain = np.bincount(doc, np.where(side[doc], to_left[term], to_right[term]), minlength=n_docs)
        a, b = (np.flatnonzero(side == s) for s in (False, True))
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        n = min(len(a), len(b))
        pays = int(np.argmin(np.append(gain[a[:n]] + gain[b[:n]] > 1e-9, False)))
        if not pays:
            break
        side[a[:pays]], side[b[:pays]] = True, False
    return side


class Tree:
    """Cuts from the root down: for each node of a level and each term, the bits that its left side saves."""

    def __init__(self, terms: np.ndarray, levels: list[np.ndarray]):
        self.terms, self.levels = terms, levels

    @classmethod
    def fit(cls, docs: list[np.ndarray]) -> Tree:
        """docs: the terms of each document of the sample."""
        found, times = np.unique(np.concatenate(docs or [np.zeros(0, U64)]), return_counts=True)
        usual = (times > 1) & (times < max(2, len(docs)))
        order = np.flatnonzero(usual)[np.argsort(-times[usual], kind="stable")][:TREE_TERMS]
        terms = np.sort(found[order])
        doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        every = np.concatenate(docs or [np.zeros(0, U64)])
        at = np.searchsorted(terms, every)
        at[at == len(terms)] = 0
        known = terms[at] == every if len(terms) else np.zeros(len(every), bool)
        doc, term, node, levels = doc[known], at[known], np.zeros(len(docs), np.int64), []
        for level in range(LEVELS):
            gains = np.zeros((1 << level, len(terms)), np.float32)
            new = 2 * node
            for k in range(1 << level):
                members = np.flatnonzero(node == k)
                if len(members) < 2:
                    continue
                number = np.full(len(docs), -1)
                number[members] = np.arange(len(members))
                own = number[doc] >= 0
                side = bisect(number[doc[own]], term[own], len(members), len(terms))
                new[members] += side
                left, right = (np.bincount(term[own][side[number[doc[own]]] == s], minlength=len(terms)) for s in (False, True))
                a, b = int((~side).sum()), int(side.sum())
                gains[k] = _cost(right + 1, b) - _cost(right, b) - _cost(left + 1, a) + _cost(left, a)
            levels.append(gains)
            node = new
        return cls(terms, levels)

    def leaves(self, n_docs: int, doc: np.ndarray, term: np.ndarray) -> np.ndarray:
        """The leaf of each document."""
        node = np.zeros(n_docs, np.int64)
        if not len(self.terms):
            return node
        at = np.searchsorted(self.terms, term)
        at[at == len(self.terms)] = 0
        known = self.terms[at] == term
        doc, at = doc[known], at[known]
        for gains in self.levels:
            saved = np.bincount(doc, gains[node[doc], at], minlength=n_docs)
            node = 2 * node + (saved < 0)
        return node


def _pack(ids: np.ndarray, sizes: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> tuple[bytes, bytes]:
    """(terms, posts) of documents; ids: NO_ID for null; doc, term, tf: their postings, in any order.

    terms: the sorted digests, and for each the number of documents, greatest tf and least length.
    posts: ids and lengths of documents, and by term the documents' numbers and tfs.
    """
    found, which = np.unique(term, return_inverse=True)
    by = np.argsort(which, kind="stable") if len(which) else which
    doc, tf = doc[by], tf[by]
    df = np.bincount(which, minlength=len(found)).astype("<i8")
    first = np.concatenate(([0], np.cumsum(df)))[:-1].astype(np.int64)
    most = np.maximum.reduceat(tf, first).astype("<i8") if len(found) else df
    least = np.minimum.reduceat(sizes[doc], first).astype("<i8") if len(found) else df
    head = pack_sorted(found)
    terms = len(head).to_bytes(8, "little") + head + squeeze(df.tobytes() + most.tobytes() + least.tobytes())
    n = np.array([len(ids), len(doc)], "<i8").tobytes()
    return terms, squeeze(n + ids.astype("<i8").tobytes() + sizes.astype("<i8").tobytes() + doc.astype("<i4").tobytes() + tf.astype("<i4").tobytes())


def _terms(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Digests, and rows of df, greatest tf and least length."""
    n = int.from_bytes(blob[:8], "little")
    return unpack_sorted(blob[8 : 8 + n]), np.frombuffer(unsqueeze(blob[8 + n :]), "<i8").reshape(3, -1)


def _posts(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, lengths, and by term the documents' numbers and tfs."""
    raw = unsqueeze(blob)
    n, m = np.frombuffer(raw, "<i8", 2).tolist()
    ids, sizes = np.frombuffer(raw, "<i8", n, 16), np.frombuffer(raw, "<i8", n, 16 + 8 * n)
    return ids, sizes, np.frombuffer(raw, "<i4", m, 16 + 16 * n), np.frombuffer(raw, "<i4", m, 16 + 16 * n + 4 * m)


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)


class _Held:
    """Postings of a task's documents, packed by leaf when they are many."""

    def __init__(self):
        self.parts, self.bytes, self.nth = [], 0, 0

    def add(self, leaf: np.ndarray, ids: np.ndarray, sizes: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        self.parts.append((leaf, ids, sizes, doc, term, tf.astype(np.int32)))
        self.bytes += 20 * len(doc) + 24 * len(ids)

    def packed(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        before = np.concatenate(([0], np.cumsum([len(p[1]) for p in self.parts])))
        leaf, ids, sizes = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        doc = np.concatenate([p[3] + b for p, b in zip(self.parts, before.tolist(), strict=False)])
        term, tf = (np.concatenate([p[k] for p in self.parts]) for k in (4, 5))
        self.parts, self.bytes = [], 0
        by = np.argsort(leaf, kind="stable")
        number = np.empty(len(by), np.int64)
        number[by] = np.arange(len(by))
        rank = np.argsort(leaf[doc], kind="stable")
        doc, term, tf = number[doc[rank]], term[rank], tf[rank]
        leaf, ids, sizes = leaf[by], ids[by], sizes[by]
        for k in np.unique(leaf).tolist():
            a, b = np.searchsorted(leaf, [k, k + 1]).tolist()
            c, d = np.searchsorted(leaf[doc], [k, k + 1]).tolist()
            raw = b"".join(_with_size(x) for x in _pack(ids[a:b], sizes[a:b], doc[c:d] - a, term[c:d], tf[c:d]))
            self.nth += 1
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x], pa.int64()) for x in (self.nth, len(raw), b - a)), pa.array([raw], pa.binary())], [c.split()[0] for c in BLOCK.split(", ")])


def _with_size(blob: bytes) -> bytes:
    return len(blob).to_bytes(8, "little") + blob


def _shard(group: pa.Table) -> pa.Table:
    """One shard of the blocks of a leaf's part."""
    ids, sizes, docs, terms, tfs, n = [], [], [], [], [], 0
    for raw in group.column("block").to_pylist():
        size = int.from_bytes(raw[:8], "little")
        found, numbers = _terms(raw[8 : 8 + size])
        i, s, d, t = _posts(raw[16 + size :])
        ids.append(i)
        sizes.append(s)
        docs.append(d.astype(np.int64) + n)
        terms.append(np.repeat(found, numbers[0]))
        tfs.append(t)
        n += len(i)
    every, lengths = np.concatenate(ids), np.concatenate(sizes)
    packed = _pack(every, lengths, np.concatenate(docs), np.concatenate(terms), np.concatenate(tfs))
    numbers = [len(every), int((lengths > 0).sum()), int(lengths.sum()), int(every.min(initial=NO_ID))]
    key = [pa.array([group.column(c)[0].as_py()], pa.int32()) for c in ("leaf", "part")]
    return pa.Table.from_arrays([*key, *(pa.array([x], pa.int64()) for x in numbers), *(pa.array([x], pa.binary()) for x in packed)], [c.split()[0] for c in SHARD.split(", ")])


def build_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The clustered index of docs as a staged table: a row for each shard."""
    spark = docs.sparkSession
    ship_package(spark)
    rest = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n = rest.count()
    digest = F.xxhash64("doc_id", "text")
    near = rest.withColumn("digest", digest).where(F.shiftright("digest", 1) + F.lit(2**62) <= F.lit(min(1.0, 3 * SAMPLE / max(n, 1)) * 2.0**63))

    def terms_of(batches):
        for batch in batches:
            for i, j, _, doc, term, _ in doc_postings(batch.column(0)):
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                blobs = [pack_sorted(np.sort(term[a:b])) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary())], ["terms"])

    sample = near.orderBy("digest", "doc_id").limit(SAMPLE).select("text").mapInArrow(tidy(terms_of), "terms binary").collect()  # SAMPLE rows
    tree = spark.sparkContext.broadcast(Tree.fit([unpack_sorted(r.terms) for r in sample]))

    def blocks(batches):
        held = _Held()
        for batch in batches:
            ids = _ids(batch.column(0))
            for i, j, sizes, doc, term, tf in doc_postings(batch.column(1)):
                held.add(tree.value.leaves(j - i, doc, term), ids[i:j], sizes, doc, term, tf)
                if held.bytes > HELD:
                    yield from held.packed()
        yield from held.packed()

    packed = stage_table(spark, rest.mapInArrow(tidy(blocks), BLOCK), "blocks")
    parts = packed.groupBy("leaf").agg(F.ceil(F.sum("size") / SHARD_BYTES).cast("int").alias("parts"))  # a row a leaf
    dealt = packed.join(F.broadcast(parts), "leaf").withColumn("part", F.pmod(F.xxhash64("block"), F.col("parts")).cast("int"))
    return stage_table(spark, dealt.groupBy("leaf", "part").applyInArrow(_shard, SHARD), "shards")


def _share(tf: np.ndarray, size: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a term adds to a score, before its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * (50 + (50 * size * n) // total))


def _weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class _Asked:
    """A block of items: their different terms, sorted, and each one's as numbers of these."""

    def __init__(self, texts: list[str | None]):
        each = text_terms(texts)
        self.terms = np.unique(np.concatenate(each or [np.zeros(0, U64)]))
        self.of = [np.searchsorted(self.terms, t) for t in each]
        self.weights = np.zeros(len(self.terms), np.int64)


def _search_block(index: DataFrame, asked: _Asked, n: int, total: int) -> DataFrame:
    """(item, doc_id, score, shard): the TOP best documents of each item of a block, doc_id NO_ID for null."""
    spark = index.sparkSession
    terms = spark.sparkContext.broadcast(asked.terms)
    columns = ["leaf", "part", "least_id", "at", "df", "most", "least"]

    def looked_up(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for blob in batch.column(3).to_pylist():
                found, numbers = _terms(blob)
                at = np.flatnonzero(np.isin(terms.value, found, assume_unique=True))
                for k, x in enumerate((at, *numbers[:, np.searchsorted(found, terms.value[at])])):
                    out[k].append(x.tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(x, pa.list_(pa.int64())) for x in out)], columns)

    hits = index.select("leaf", "part", "least_id", "terms").mapInArrow(tidy(looked_up), "leaf int, part int, least_id long, at array<long>, df array<long>, most array<long>, least array<long>")
    hits = stage_table(spark, hits, "hits")
    df = np.zeros(len(asked.terms), np.int64)
    for at, count in hits.select(F.explode(F.arrays_zip("at", "df")).alias("x")).groupBy("x.at").agg(F.sum("x.df")).collect():  # a row a term of the block
        df[at] = count
    asked.weights = _weights(df, n)
    shared = spark.sparkContext.broadcast(asked)

    def bounds(batches):
        for batch in batches:
            rows: list[tuple] = []
            for leaf, part, least_id, at, _, most, least in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                value = np.zeros(len(shared.value.terms), np.int64)
                value[at] = shared.value.weights[at] * _share(np.array(most, np.int64), np.array(least, np.int64), n, total)
                rows += [(item, leaf, part, least_id, bound) for item, own in enumerate(shared.value.of) if (bound := int(value[own].sum())) > 0]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["item", "leaf", "part", "least_id", "bound"])

    order = Window.partitionBy("item").orderBy(F.desc("bound"), "least_id", "leaf", "part")
    plan = hits.mapInArrow(tidy(bounds), "item int, leaf int, part int, least_id long, bound long").withColumn("place", F.row_number().over(order) - 1)
    plan = stage_table(spark, plan, "visits")

    def scores(batches):
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for items, head, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, numbers = _terms(head)
                ids, sizes, doc, tf = _posts(blob)
                ends = np.cumsum(numbers[0])
                at = np.searchsorted(found, shared.value.terms)
                at[at == len(found)] = 0
                known = found[at] == shared.value.terms
                share = {}
                for item in items:
                    score = np.zeros(len(ids), np.int64)
                    for t in shared.value.of[item][known[shared.value.of[item]]].tolist():
                        if t not in share:
                            a, b = int(ends[at[t]] - numbers[0][at[t]]), int(ends[at[t]])
                            share[t] = doc[a:b], shared.value.weights[t] * _share(tf[a:b].astype(np.int64), sizes[doc[a:b]], n, total)
                        score[share[t][0]] += share[t][1]
                    some = np.flatnonzero(score > 0)
                    if len(some) > TOP:  # all that reach the score of the last of TOP
                        some = some[score[some] >= np.partition(score[some], len(some) - TOP)[len(some) - TOP]]
                    some = some[np.lexsort((ids[some], -score[some]))][:TOP]
                    out.append((np.full(len(some), item), ids[some], score[some]))
            made = [np.concatenate([x[k] for x in out] or [np.zeros(0, np.int64)]) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(made[0], pa.int32()), pa.array(made[1], pa.int64()), pa.array(made[2], pa.int64())], ["item", "doc_id", "score"])

    best = spark.createDataFrame([], "item int, doc_id long, score long")
    ranked = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    low, high = 0, FIRST
    while True:
        last = best.groupBy("item").agg(F.count("*").alias("n"), F.min(F.struct("score", -F.col("doc_id"))).alias("last")).where(F.col("n") >= TOP)
        reach = (F.col("bound") > F.col("last.score")) | (F.col("bound") == F.col("last.score")) & (F.col("least_id") < -F.col("last.col2"))
        left = plan.where(F.col("place") >= low).join(last, "item", "left").where(F.col("last").isNull() | reach)
        visits = stage_table(spark, left.where(F.col("place") < high).groupBy("leaf", "part").agg(F.collect_set("item").alias("items")), "round")
        if visits.isEmpty():
            return best  # a later shard's bound is no higher than those that no longer reach
        found = visits.join(index.select("leaf", "part", "terms", "posts"), ["leaf", "part"]).select("items", "terms", "posts").mapInArrow(tidy(scores), "item int, doc_id long, score long")
        best = stage_table(spark, best.unionByName(found).withColumn("rank", ranked).where(F.col("rank") <= TOP).drop("rank"), "best")
        low, high = high, high + (high - low) * GROWTH


def search(index: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Per item and document, the TOP best: item_id, rank, doc_id, score."""
    spark = index.sparkSession
    n, total = index.agg(F.coalesce(F.sum("n_live"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    kind = items.select(item_id).schema[0].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    block: list = []
    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text")).toLocalIterator()  # blocks of ITEMS rows
    for row in [*rows, None] if n else []:
        if row is not None:
            block.append(row)
        if block and (row is None or len(block) == ITEMS):
            asked = _Asked([r.text for r in block])
            names = spark.createDataFrame([(k, r.item_id) for k, r in enumerate(block)], f"item int, item_id {kind}")
            best = _search_block(index, asked, n, total)
            ranked = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")).cast("int")
            found = best.withColumn("rank", ranked).join(F.broadcast(names), "item")  # ITEMS rows at most
            out = out.unionByName(found.select("item_id", "rank", F.when(F.col("doc_id") != int(NO_ID), F.col("doc_id")).alias("doc_id"), "score"))
            block = []
    return out


def search_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score of the TOP best documents of each item."""
    return search(build_index(docs), items)


#: DuckDB SQL for op13's rows over documents and benchmark.
SQL = r"""
WITH term AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), posting AS (
  SELECT doc_id, t, count(*) AS tf FROM term GROUP BY doc_id, t
), doc AS (
  SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM posting GROUP BY doc_id
), whole AS (
  SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS l FROM doc
), freq AS (
  SELECT t, count(*) AS df FROM posting GROUP BY t
), asked AS (
  SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM benchmark
), weighed AS (
  SELECT item_id, t, CAST(floor(1000 * ln((2 * w.n + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM asked JOIN freq USING (t), whole w
), scored AS (
  SELECT item_id, p.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * d.n * a.n) // a.l)))) AS BIGINT) AS score
  FROM weighed JOIN posting p USING (t) JOIN doc d ON d.doc_id = p.doc_id, whole a
  GROUP BY item_id, p.doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 50
"""
