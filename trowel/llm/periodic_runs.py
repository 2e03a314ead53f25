"""Maximal periodic runs of words, by the runs theorem.

Every maximal repetition (length at least twice its smallest period) has a root that is the longest Lyndon word at
some place under the order of the words or under its inverse. For each text, under both orders: suffixes are sorted
by prefix doubling; the longest Lyndon word at i ends before the next smaller value of the inverse suffix array; and
such a root (i, period) is extended to both sides by longest common extensions, range minima, from a sparse table,
of the longest common prefixes of neighbouring suffixes, of the text and of the reversed text. Texts are sorted
together, a slice of many short texts or one long text at a time, and words are compared as bytes, not by digest.

A run of length 4 * period or more is longer than its root by 3 * period at least, so its root extends to one side by
half of what the run needs beyond the root: roots whose first words on neither side match are passed over without a
table, which loses nothing.

Scale: one map over the texts, no shuffle; memory is that of the longest text, or of a slice.

Defined results: null, empty and blank texts have no words and no runs, and collapse to an empty text. A null doc_id
is kept, and its text as it is. Rows that repeat are each reported. Words are numbered from 0, in order; overlapping
runs are each reported. Other columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trowel.llm.arrays import tidy
from trowel.session import ship_package

#: Words of a run at least; periods that it has at least (the theorem needs 2).
MIN_LENGTH, MIN_PERIODS = 6, 4
#: Words that are sorted together; a longer text is sorted alone.
SLICE_WORDS = 1 << 17
#: Steps that all places take together, before those left are found one by one.
JUMPS = 2048

RUNS = "array<struct<start:long,length:long,period:long>>"


def suffix_ranks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, inverse) of values by prefix doubling; only suffixes whose order is open are sorted again.

    The last value must be the least, so that no suffix is a prefix of another.
    """
    n = len(values)
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = 1
    alone = np.concatenate((new[1:], [True])) & new if n else new
    open_at = np.flatnonzero(~alone)  # places in order whose group has more than one suffix
    while len(open_at):
        at = order[open_at]
        key = rank[at] * np.int64(n + 1) + np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[open_at] = at
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[at] = open_at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        alone = new & np.concatenate((new[1:], [True]))
        open_at = open_at[~alone]
        step *= 2
    return order, rank


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place, the next one with a smaller value, or the end; values differ.

    All places step at once: what lies between a place and where it stands now is greater than its value, so it may
    go on to where that place stands. What is open after JUMPS steps, as below a long fall, is found with a stack.
    """
    n = len(values)
    ended = np.append(values, values.min(initial=0) - 1)
    at = np.arange(1, n + 2)
    at[n] = n
    left = np.flatnonzero(ended[at[:n]] > values)
    for _ in range(JUMPS):
        if not len(left):
            return at[:n]
        to = at[at[left]]
        at[left] = to
        left = left[ended[to] > values[left]]
    found, stack = [n] * n, []
    for i, v in enumerate(values.tolist()):
        while stack and stack[-1][0] > v:
            found[stack.pop()[1]] = i
        stack.append((v, i))
    return np.array(found, np.int64)


def common_prefixes(values: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each place in order, the common prefix of its suffix with the one before."""
    lcp, h, text, before, place = [0] * len(values), 0, values.tolist(), order.tolist(), rank.tolist()
    n = len(text)
    for i in range(n):
        if place[i]:
            j = before[place[i] - 1]
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            lcp[place[i]] = h
            h = max(0, h - 1)
        else:
            h = 0
    return np.array(lcp, np.int64)


class Extensions:
    """Longest common extensions to the right of two places, by range minima over a sparse table."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        order, self.rank = suffix_ranks(values)
        self.table = [common_prefixes(values, order, self.rank)]
        width = 1
        while 2 * width <= self.n:
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For different places i and j."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << k)])
        return out


def _roots(words: np.ndarray, ends: np.ndarray, inverse: bool) -> tuple[np.ndarray, np.ndarray]:
    """(place, length) of the longest Lyndon words that are not at the ends of texts.

    words: values of all texts, from 1, each followed by a 0; ends: where the zeros are.
    """
    key = np.where(words > 0, words.max(initial=0) + 1 - words, 0) if inverse else words
    later = np.zeros(len(words), np.int64)
    later[ends] = 1
    later = np.cumsum(later[::-1])[::-1]  # texts from here on: a later text's suffixes are all smaller
    key = later * (int(words.max(initial=0)) + 2) + key
    _, rank = suffix_ranks(np.append(key, -1))
    place = np.delete(np.arange(len(words)), ends)
    return place, next_smaller(rank[:-1])[place] - place


def _matches(words: np.ndarray, place: np.ndarray, period: np.ndarray, most: int) -> np.ndarray:
    """May a root extend to a run? Half of what that needs, of at most most words, lies on one side."""
    need = np.minimum((np.maximum(MIN_LENGTH, MIN_PERIODS * period) - period + 1) // 2, most)
    right, left = np.ones(len(place), bool), np.ones(len(place), bool)
    last = len(words) - 1
    for k in range(most):
        asked = need > k
        far = place + period + k
        right &= ~asked | ((far <= last) & (words[np.minimum(far, last)] == words[np.minimum(place + k, last)]) & (words[np.minimum(far, last)] > 0))
        near = place - 1 - k
        left &= ~asked | ((near >= 0) & (words[np.maximum(near, 0)] == words[np.maximum(near + period, 0)]) & (words[np.maximum(near, 0)] > 0))
    return right | left


def slice_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text, by start and period; texts: the numbers, from 1, of each one's words."""
    sizes = np.array([len(t) for t in texts])
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))
    ends = begins[1:] - 1
    words = np.zeros(begins[-1], np.int64)
    for t, b in zip(texts, begins.tolist(), strict=False):
        words[b : b + len(t)] = t
    found = [_roots(words, ends, inverse) for inverse in (False, True)]
    place, period = (np.concatenate(x) for x in zip(*found, strict=True))
    likely = _matches(words, place, period, 3)
    place, period = place[likely], period[likely]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    owner = np.searchsorted(ends, place)
    by = np.argsort(owner, kind="stable")
    owner, place, period = owner[by], place[by] - begins[owner[by]], period[by]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    for t in np.unique(owner).tolist():
        i, p, n = place[cuts[t] : cuts[t + 1]], period[cuts[t] : cuts[t + 1]], len(texts[t])
        ahead = Extensions(np.append(texts[t], 0)).of(i, i + p)
        back = Extensions(np.append(texts[t][::-1], 0)).of(n - i, n - i - p)
        start, length = i - back, back + p + ahead
        good = length >= np.maximum(MIN_LENGTH, MIN_PERIODS * p)
        out[t] = sorted(set(zip(start[good].tolist(), length[good].tolist(), p[good].tolist(), strict=True)), key=lambda r: (r[0], r[2]))
    return out


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside all runs, and each run's first period where no other run covers it."""
    if not runs:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    gone = np.cumsum(edges)[:-1] > 0
    return b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)


def text_runs(texts: list[bytes | None]) -> tuple[list[int], list[list[tuple[int, int, int]]], list[bytes]]:
    """Numbers of words, runs, and collapsed texts."""
    sizes, runs, kept = [], [], []
    i = 0
    while i < len(texts):
        split, room, numbers, waiting = [], SLICE_WORDS, {}, []
        while i < len(texts) and (not split or room > 0):
            split.append((texts[i] or b"").split())  # at the six white-space bytes, as the words are defined
            room -= len(split[-1])
            i += 1
        for words in split:
            waiting.append(np.array([numbers.setdefault(w, len(numbers) + 1) for w in words], np.int64))
        found = slice_runs(waiting)
        sizes += [len(w) for w in split]
        runs += found
        kept += [_kept(w, r) for w, r in zip(split, found, strict=True)]
    return sizes, runs, kept


def periodic_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_words, runs (start, length, period of each, by start, then period), collapsed (the text without what runs repeat)."""
    ship_package(docs.sparkSession)
    rest = docs.select(F.col(doc_id).alias("doc_id"), F.encode(F.col(text).cast("string"), "UTF-8").alias("text"))
    kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))

    def rows(batches):
        for batch in batches:
            sizes, runs, kept = text_runs(batch.column(1).to_pylist())
            flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
            items = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(r) for r in runs]))), pa.int32()), items).cast(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), lists, pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    id_kind = rest.schema["doc_id"].dataType.simpleString()
    return rest.mapInArrow(tidy(rows), f"doc_id {id_kind}, n_words long, runs {RUNS}, collapsed string")


def with_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): where h = crc32 of the decimal doc_id divides by 10, the words from a on repeat the first p of them.

    a = floor(h / 10) mod n and p = 1 + floor((n - a) / (3 + floor(h / 10) mod 8)), n the number of words.
    """
    words = F.filter(F.split(F.col("text").cast("string"), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    cut = chosen.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10).cast("long"))
    placed = cut.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("long"))
    tail = F.expr("array_join(transform(sequence(0L, n - 1L), i -> element_at(w, cast(if(i < a, i, a + (i - a) % p) as int) + 1)), ' ')")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), tail).otherwise(F.col("text")).alias("text"))


def runs_report(docs: DataFrame) -> DataFrame:
    """Per row of documents, tails repeated: doc_id, n_words, n_runs, the longest run's start, length, period, exponent_milli, and digests."""
    found = periodic_runs(with_tails(docs))
    longest = F.expr("array_min(transform(runs, r -> named_struct('length', -r.length, 'start', r.start, 'period', r.period)))")
    told = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    best = found.withColumn("best", longest)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.length")).alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * -best.length) div best.period").alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


#: DuckDB SQL for op12's rows over documents: equal words q apart, in unbroken stretches.
SQL = r"""
WITH base AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
             lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END)) AS h
  FROM documents
), placed AS (
  SELECT doc_id, w, h, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM base
), tails AS (
  SELECT doc_id, w, n, a, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM placed
), word AS (
  SELECT doc_id, i, CASE WHEN a IS NULL OR i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS w
  FROM (SELECT *, unnest(range(n)) AS i FROM tails WHERE n > 0)
), pair AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q
  FROM word x JOIN word y ON x.doc_id = y.doc_id AND x.w = y.w AND x.i < y.i
), stretch AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM pair)
  GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)
), run AS (
  SELECT * FROM stretch s WHERE NOT EXISTS (
    SELECT 1 FROM stretch t WHERE t.doc_id = s.doc_id AND t.q < s.q AND t.start <= s.start AND t.start + t.length >= s.start + s.length)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM run
), kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS words FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
), told AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines,
         min((-length, start, q)) AS best
  FROM run GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best[2] AS BIGINT) AS start, CAST(-best[1] AS BIGINT) AS length,
       CAST(best[3] AS BIGINT) AS period, CAST((1000 * -best[1]) // best[3] AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256, CAST(n AS BIGINT) AS n_words
FROM placed d LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
