"""Secret scans with multipart credential linking; DataFrame functions only.

Base kinds are what one pattern shows alone: assign, access and hex. Weak kinds are parts of a
credential that mean nothing alone: ident (user names and client ids), weak (assigned values of 4 to
7 characters), endpoint (connection addresses). A weak part is reported only if a complementary part,
weak or base, lies within SCOPE characters in the same text: an interval join on the row and on
buckets of SCOPE characters, so that it stays an equi-join. Base spans stay in any case.

Positions: a pattern's pieces between matches and its matches alternate, so a running sum of their
lengths, in code points, gives each start and end. It runs over the parts of one text; texts without
any match, nearly all, are not shuffled. A text is searched for a pattern only if it has one of the
pattern's words, and taken apart only if the pattern is found; matches are staged.

Defined results: null and empty text have no spans; rows that repeat a doc_id are scanned each;
doc_id may be null. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trowel.session import stage_table

#: Kinds in their order, and the pattern and the group that is measured.
#: A run of 32 or more hexadecimal digits is the run that [0-9a-f]+ finds, if that is long enough.
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2),
    "access": (r"AKIA[A-Z0-9]+", 0),
    "hex": (r"[0-9a-f]{32,}", 0),
    "ident": (r"""(?i)(username|user|login|client_?id|account_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]{3,})""", 2),
    "endpoint": (r"""(?i)((?:https?|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp|ftp|ssh)://[A-Za-z0-9@:._~/?=-]+|(?:host|hostname|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+)""", 1),
}
KINDS = ["assign", "access", "hex", "ident", "weak", "endpoint"]
#: Words of which each match of a kind has one, in lower case: texts without them are not searched.
WORDS = {
    "assign": ["password", "passwd", "secret", "token", "apikey", "api_key"],
    "access": ["akia"],
    "ident": ["user", "login", "clientid", "client_id", "accountid", "account_id", "accesskey", "access_key"],
    "endpoint": ["://", "host", "endpoint", "server"],
}
#: Characters between two parts that belong to one credential, at most.
SCOPE = 200
#: Roles that complete each other.
ROLES = {"assign": "secret", "hex": "secret", "weak": "secret", "access": "name", "ident": "name", "endpoint": "place"}


def _hits(text: Column, lowered: Column, kind: str) -> Column:
    """Matches of a kind: (kind, i, gap, size, value): code points since the last match, of the match, of the measured group."""
    pattern, group = PATTERNS[kind]
    lengths = lambda g: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)), F.length)
    zipped = F.arrays_zip(lengths(0).alias("size"), lengths(group).alias("value"), F.transform(F.split(text, pattern, -1), F.length).alias("gap"))
    hits = F.transform(F.filter(zipped, lambda z: z["size"].isNotNull()), lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), z["gap"].alias("gap"), z["size"].alias("size"), z["value"].alias("value")))
    may = F.exists(F.array(*map(F.lit, WORDS[kind])), lambda w: F.contains(lowered, w)) if kind in WORDS else F.lit(True)
    return F.when(may & text.rlike(pattern), hits)


def _ranked(kind: str | Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def _parts(scanned: DataFrame) -> DataFrame:
    """(rid, kind, start, end, base) of all parts that are long enough for their kind."""
    hits = scanned.where("hits is not null").select("rid", F.explode("hits").alias("h")).select("rid", "h.*")
    ordered = Window.partitionBy("rid", "kind").orderBy("i")
    placed = hits.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(ordered)).withColumn("start", F.col("end") - F.col("size"))
    kind = (
        F.when((F.col("kind") == "assign") & (F.col("value") < 8), F.when(F.col("value") >= 4, F.lit("weak")))
        .when((F.col("kind") == "access") & (F.col("size") < 16), F.lit(None))
        .otherwise(F.col("kind"))
    )
    return placed.withColumn("kind", kind).where("kind is not null").select("rid", "kind", "start", "end", F.col("kind").isin("assign", "access", "hex").alias("base"))


def linked_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts with a complementary part within scope."""
    role = F.coalesce(*(F.when(F.col("kind") == k, F.lit(r)) for k, r in ROLES.items()))
    near = lambda lo, hi: F.explode(F.sequence(F.floor(lo / scope), F.floor(hi / scope)))
    weak = parts.where("not base").select("*", role.alias("role"), near(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope).alias("cell"))
    other = parts.select(F.col("rid").alias("o_rid"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), role.alias("o_role"), near(F.col("start"), F.col("end")).alias("o_cell"))
    meets = (F.col("rid") == F.col("o_rid")) & (F.col("cell") == F.col("o_cell")) & (F.col("o_start") <= F.col("end") + scope) & (F.col("o_end") >= F.col("start") - scope)
    # a name or a place needs a secret; a weak secret needs a name or a place
    fits = F.when(F.col("role") == "secret", F.col("o_role") != "secret").otherwise(F.col("o_role") == "secret")
    return weak.join(other, meets & fits, "left_semi").select("rid", "kind", "start", "end", "base").distinct()


def _listed(spans: Column) -> Column:
    """Comma-joined kind:start:end, by start and then by kind as listed."""
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_linked, base_sha256, spans."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = F.array_compact(F.flatten(F.array_compact(F.array(*(_hits(F.col("t"), F.col("l"), k) for k in PATTERNS)))))
    # lower case once a text: a column of its own that all kinds read
    texts = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), text.alias("t"), F.lower(text).alias("l"))
    scanned = texts.select("doc_id", "rid", F.when(F.size(found) > 0, found).alias("hits"))
    scanned = stage_table(docs.sparkSession, scanned, "secrets")
    parts = stage_table(docs.sparkSession, _parts(scanned), "parts")
    spans = parts.where("base").union(linked_parts(parts, scope))
    item = F.struct("start", _ranked(F.col("kind")).alias("rank"), "kind", "end")
    count = lambda k: F.count(F.when(F.col("kind") == k, 1))
    listed = spans.groupBy("rid").agg(count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.count(F.when(~F.col("base"), 1)).alias("n_linked"), F.collect_list(F.when(F.col("base"), item)).alias("b"), F.collect_list(item).alias("s"))
    listed = listed.select("rid", "n_assign", "n_access", "n_hex", "n_linked", _listed(F.col("b")).alias("base_spans"), _listed(F.col("s")).alias("spans"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    joined = scanned.where("hits is not null").select("doc_id", "rid").join(listed, "rid", "left").drop("rid")
    empty = scanned.where("hits is null").select("doc_id", *(F.lit(None).cast("long").alias(c) for c in ("n_assign", "n_access", "n_hex", "n_linked")), *(F.lit(None).cast("string").alias(c) for c in ("base_spans", "spans")))
    return joined.union(empty).select("doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"), zero("n_linked"), F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
