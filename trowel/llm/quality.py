"""Quality rules on documents and on their hosts.

Document rules give counts for each text and base_failed, and say which of RULES it fails. Host rules:
failures of each rule are summed by domain, each domain's rate is shrunk with a beta prior whose mean
and strength are fitted, by moments, to the rates of all domains, and the verdicts are joined back to
the documents. A document is rejected if it fails the base rule; if its domain's shrunk rate of base
failures is above that rule's limit; or if it fails another rule of which its domain's shrunk rate is
above that rule's limit: what one text may have by chance is believed of a host that does it often.

Skew: a domain with any share of the rows is summed before the shuffle; the join back is an equi-join
with one row per domain on one side, which Spark may broadcast by its own size check or split.

Defined results: null or empty text counts as no words and fails; a null domain has no host verdict;
rows that repeat, also a doc_id, count each; a null doc_id is kept; with one domain, or domains of equal
rates, the prior is as strong as the largest strength below. Other columns are kept by keep_good and
ignored by host_rules.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trowel.llm.arrays import U64, mix, slices, text_buffers, tidy, window_owner, windows, words_of
from trowel.session import ship_package, stage_table

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Words of a text at least; percent of its words that may lie in repeated windows of WINDOW words.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Rules by name: the condition on the counts, and the shrunk rate above which a domain's failures of it count.
RULES = {
    "base": ("base_failed", 0.75),
    "symbols": ("10 * n_symbols > n_words", 0.5),
    "duplicates": ("n_dup_lines >= 3", 0.5),
    "words": ("word_chars > 12 * n_words OR word_chars < 2 * n_words", 0.5),
}
#: Pseudo-documents of the prior, at least and at most.
STRENGTH = (2.0, 1000.0)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _by_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])


def _repeated_words(words, width: int) -> np.ndarray:
    """Words in windows that occur twice or more in their document, by document."""
    h, ok = windows(words.hashes, width), window_owner(words.bounds, width, len(words.hashes))
    doc = words.doc_of()
    at = np.flatnonzero(ok)
    key = mix(h[at] ^ (doc[at].astype(U64) * U64(0x9E3779B97F4A7C15)))
    rank = np.argsort(key)
    equal = key[rank][1:] == key[rank][:-1]
    twice = np.concatenate((equal, [False])) | np.concatenate(([False], equal)) if len(key) else equal
    starts = at[rank[twice]] if len(key) else at
    steps = np.zeros(len(doc) + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.subtract.at(steps, starts + width, 1)
    return _by_doc(np.cumsum(steps)[: len(doc)] > 0, words.bounds)


def _dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines)) if len(lines) > 1 else 0


def text_counts(column: pa.Array) -> list[np.ndarray]:
    """The columns of COUNTS for each text."""
    data, offsets = text_buffers(column)
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    for i, j in slices(offsets):
        own = offsets[i : j + 1]
        words = words_of(data, own)
        part, at = data[own[0] : own[-1]], own - own[0]
        ends = np.concatenate(([0], np.cumsum(words.size)))[words.bounds]
        out[0].append(np.diff(words.bounds))
        out[1].append(_by_doc((words.letters & 0xC0) != 0x80, ends))
        out[2].append(_by_doc(_SYMBOL[part], at))
        raw = part.tobytes()
        out[3].append(np.array([_dup_lines(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.int64))
        out[4].append(_repeated_words(words, WINDOW))
    return [np.concatenate(x or [np.zeros(0, np.int64)]) for x in out]


def document_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of COUNTS and base_failed (replacing columns of these names)."""
    ship_package(docs.sparkSession)
    names = [c.split()[0] for c in COUNTS.split(", ")]
    rest = docs.drop(*names, "base_failed")

    def rows(batches):
        for batch in batches:
            counts = text_counts(batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in counts)], [*batch.schema.names, *names])

    schema = rest.limit(0).selectExpr("*", *(f"cast(0 as bigint) as {n}" for n in names)).schema
    counted = rest.mapInArrow(tidy(rows), schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _fails(rule: str) -> Column:
    return F.expr(RULES[rule][0])


def host_verdicts(judged: DataFrame, domain: str, limits: dict[str, float] | None = None) -> DataFrame:
    """(domain, n_docs, and of each rule f_ (failures), rate_ and bad_) from rows with counts and base_failed.

    Prior of a rule: mean m of all documents' failures; strength s = m(1-m)/v - 1 within STRENGTH, v the
    variance of the domains' rates beyond what sampling explains. rate = (f + s*m) / (n_docs + s).
    """
    limit = {rule: (limits or {}).get(rule, most) for rule, (_, most) in RULES.items()}
    failed = [F.sum(_fails(rule).cast("long")).alias(f"f_{rule}") for rule in RULES]
    hosts = judged.where(F.col(domain).isNotNull()).groupBy(F.col(domain).alias("domain")).agg(F.count("*").alias("n_docs"), *failed)
    fits = []
    for rule in RULES:
        n = F.col(f"f_{rule}")
        mean, spread, unlike = F.sum(n) / F.sum("n_docs"), F.var_pop(n / F.col("n_docs")), F.avg(1 / F.col("n_docs"))
        excess = F.greatest(spread - mean * (1 - mean) * unlike, F.lit(1e-9))
        fits += [mean.alias(f"m_{rule}"), F.least(F.greatest(mean * (1 - mean) / excess - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1])).alias(f"s_{rule}")]
    fit = hosts.agg(*fits)
    rate = lambda r: (F.col(f"f_{r}") + F.col(f"s_{r}") * F.col(f"m_{r}")) / (F.col("n_docs") + F.col(f"s_{r}"))
    shrunk = hosts.join(F.broadcast(fit)).select(*hosts.columns, *(rate(r).alias(f"rate_{r}") for r in RULES))  # fit is one row
    return shrunk.select("*", *((F.col(f"rate_{r}") > limit[r]).alias(f"bad_{r}") for r in RULES))


def _rejected() -> Column:
    """Is a document rejected, with its domain's bad_ columns joined?"""
    out = F.col("base_failed") | F.coalesce("bad_base", F.lit(False))
    for rule in list(RULES)[1:]:
        out = out | (F.coalesce(f"bad_{rule}", F.lit(False)) & _fails(rule))
    return out


def host_rules(docs: DataFrame, domain: str = "source", limits: dict[str, float] | None = None) -> DataFrame:
    """Per document: doc_id, counts, base_failed, kept, domain, failed (the other rules that it fails), shrunk_rate (of base), host_failed, host_rules (the other rules that its domain fails)."""
    judged = stage_table(docs.sparkSession, document_rules(docs.select("doc_id", F.col(domain).alias("domain"), F.col("text").cast("string").alias("text"))).drop("text"), "judged")
    joined = judged.join(host_verdicts(judged, "domain", limits), "domain", "left")
    others = list(RULES)[1:]
    named = lambda condition: F.concat_ws(",", *(F.when(condition(r), F.lit(r)) for r in others))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~_rejected()).alias("kept"), "domain",
        named(_fails).alias("failed"), F.col("rate_base").alias("shrunk_rate"), F.coalesce("bad_base", F.lit(False)).alias("host_failed"), named(lambda r: F.col(f"bad_{r}")).alias("host_rules"),
    )


def keep_good(docs: DataFrame, domain: str = "source", limits: dict[str, float] | None = None) -> DataFrame:
    """The rows of docs, all columns, that pass their own rules and their domain's."""
    inner = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # no clash with the counts
    text, host = (f"c{docs.columns.index(c)}" for c in ("text", domain))
    judged = document_rules(inner, text)
    bad = host_verdicts(judged.drop(text), host, limits).where(" or ".join(f"bad_{r}" for r in RULES)).select(F.col("domain").alias(host), *(f"bad_{r}" for r in RULES))
    bad = stage_table(docs.sparkSession, bad, "hosts")  # its size is then known: texts are only shuffled if it is large
    return judged.where("not base_failed").join(bad, host, "left").where(~_rejected()).select(*inner.columns).toDF(*docs.columns)


def _sql_of_rules() -> dict[str, str]:
    others = list(RULES)[1:]
    bad = lambda r: f"coalesce(bad_{r}, false)"
    return {
        "sums": ", ".join(f"sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS f_{r}" for r, (c, _) in RULES.items()),
        "fits": ", ".join(f"sum(f_{r}) / sum(n_docs) AS m_{r}, var_pop(f_{r} / n_docs) AS v_{r}" for r in RULES),
        "priors": ", ".join(f"m_{r}, least(greatest(m_{r} * (1 - m_{r}) / greatest(v_{r} - m_{r} * (1 - m_{r}) * i, 1e-9) - 1, {STRENGTH[0]}), {STRENGTH[1]}) AS s_{r}" for r in RULES),
        "verdicts": ", ".join(f"(f_{r} + s_{r} * m_{r}) / (n_docs + s_{r}) > {most} AS bad_{r}" for r, (_, most) in RULES.items()),
        "rejected": " OR ".join(["base_failed", bad("base"), *(f"({bad(r)} AND ({RULES[r][0]}))" for r in others)]),
        "failed": "concat_ws(',', " + ", ".join(f"CASE WHEN {RULES[r][0]} THEN '{r}' END" for r in others) + ")",
        "host_rules": "concat_ws(',', " + ", ".join(f"CASE WHEN {bad(r)} THEN '{r}' END" for r in others) + ")",
    }


#: DuckDB SQL for op2's rows over the table documents.
SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), wins AS (
  SELECT doc_id, i, list_slice(w, i, i + 4) AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM base WHERE len(w) >= 5)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wins) WHERE c > 1
), repw AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY doc_id
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM base)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), judged AS (
  SELECT b.doc_id, b.source AS domain, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repw.n, 0) AS BIGINT) AS n_repeat_words,
         (len(w) < 10 OR 100 * coalesce(repw.n, 0) > 20 * len(w)) AS base_failed
  FROM base b LEFT JOIN dup USING (doc_id) LEFT JOIN repw USING (doc_id)
), hosts AS (
  SELECT domain, count(*) AS n_docs, {sums} FROM judged WHERE domain IS NOT NULL GROUP BY domain
), fit AS (
  SELECT {fits}, avg(1 / n_docs) AS i FROM hosts
), prior AS (
  SELECT {priors} FROM fit
), verdict AS (
  SELECT domain, {verdicts} FROM hosts, prior
)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT ({rejected}) AS kept,
       j.domain, {failed} AS failed, coalesce(bad_base, false) AS host_failed, {host_rules} AS host_rules
FROM judged j LEFT JOIN verdict v ON j.domain = v.domain
"""
for _name, _text in _sql_of_rules().items():
    SQL = SQL.replace("{" + _name + "}", _text)
