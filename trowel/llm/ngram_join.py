"""N-gram Jaccard join by PartEnum signatures (Arasu, Ganti and Kaushik, VLDB 2006), and its components.

Sets are the distinct word shingles of a text. Sizes fall in bands such that the partner of a linked
pair is in the same band or the next; within a band a Jaccard bound is a bound k on the size of the
symmetric difference. The feature domain (shingle hashes) is partitioned into n1 ranges, each into
n2 smaller ones; n1 > k / (k2 + 1), so some first-level range holds at most k2 differences, and some
n2 - k2 of its second-level ranges hold none: each subset of that size gives one signature, and every
linked pair shares one. Sharing a passage doesn't suffice for that: a range draws from the whole text.

Plan. (1) Texts with equal sets are one class (128-bit digest and size; a grouped minimum). (2) Each
batch sends its classes' signatures as sorted lists per hash bucket; buckets return, of the classes with
a common signature, the lowest with each other one, so candidates are connected families. (3) Within a
family, sketches of parities bound the difference of sets from below; tasks compare blocks of sketches
and return enough of the pairs that the bound leaves to connect them: far smaller families. Of a family of
many blocks only those are compared that have a common lowest class, as two that share a signature have. (4) Each
member is verified against its family's lowest; links join components. Where a family still has
several, members of different components are compared by text, in the same way, and tasks return only
links that connect. Pairs are never listed; no link is lost, as a linked pair shares a signature, is
left by the bound, and is compared or already connected. (5) Classes get components, documents theirs.

Verification is on exact shingle sets (64-bit hashes of shingles) with integer arithmetic.

Defined results: null, empty or blank text has no shingles and its own component; a null doc_id is
not linked and has a null component; rows that repeat a doc_id are one node. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trowel.llm.arrays import U64, cut_by_top_bits, mix, pack_sorted, slices, squeeze, text_buffers, tidy, unpack_sorted, unsqueeze, window_owner, windows, words_of
from trowel.operators.graph import stars
from trowel.operators.relations import possible
from trowel.session import input_bytes, ship_package, shuffle_parts, stage_table


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int, lower: bool = True):
    """For each slice of documents: its first document, all sorted distinct shingle hashes, and their bounds by document."""
    for i, j in slices(offsets):
        words = words_of(data, offsets[i : j + 1], lower=lower)
        counts = np.diff(words.bounds)
        h = windows(words.hashes, width)
        ok = window_owner(words.bounds, width, len(words.hashes))
        flat, owner = h[ok], words.doc_of()[: len(ok)][ok]
        short = np.flatnonzero((counts > 0) & (counts < width))
        if len(short):
            whole = mix(np.array([_fold(words.hashes[words.bounds[d] : words.bounds[d + 1]]) for d in short], U64))
            flat, owner = np.concatenate((flat, whole)), np.concatenate((owner, short))
            rank = np.argsort(owner, kind="stable")
            flat, owner = flat[rank], owner[rank]
        bounds = np.searchsorted(owner, np.arange(j - i + 1))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            flat[a:b].sort()
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        starts = bounds[:-1][np.diff(bounds) > 0]
        new[starts] = True
        bounds = np.concatenate(([0], np.cumsum(new)))[bounds]
        yield i, flat[new], bounds


def _fold(h: np.ndarray) -> int:
    out = 0x9E3779B97F4A7C15
    for x in h.tolist():
        out = (out * 0xD1342543DE82EF95 + x) % (1 << 64)
    return out


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([U64(0)], np.cumsum(values, dtype=U64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _digests(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit digests of each set."""
    return mix(_sums(mix(flat ^ U64(0x5851F42D4C957F2D)), bounds)), mix(_sums(mix(flat ^ U64(0x14057B7EF767814F)), bounds))


def sketches(flat: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For each set, the parities of its elements in 4 times as many cells (a power of two).

    Two sets' parities differ in no more cells than the sets have differences, so many differing cells
    rule a link out, exactly; a longer sketch folds to a shorter one's cells.
    """
    cells, place = np.diff(bounds), mix(flat ^ U64(0xA24BAED4963EE407))
    out = []
    for a, b, n in zip(bounds[:-1].tolist(), bounds[1:].tolist(), cells.tolist(), strict=True):
        width = 1 << max(6, (4 * n - 1).bit_length())
        odd = np.bincount((place[a:b] & U64(width - 1)).astype(np.int64), minlength=width) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
    return out


def differing_cells(a: bytes, b: bytes) -> int:
    """A lower bound on the size of the symmetric difference of two sketched sets."""
    if len(a) < len(b):
        a, b = b, a
    x, width = int.from_bytes(a, "little"), 8 * len(a)
    while width > 8 * len(b):
        width //= 2
        x = (x >> width) ^ (x & ((1 << width) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


def _folded(sketch: np.ndarray) -> np.ndarray:
    """Sketches, one a row, of half as many cells."""
    half = sketch.shape[1] // 2
    return sketch[:, :half] ^ sketch[:, half:]


def _plausible_blocks(num: int, den: int):
    """(a, b): of the pairs of two blocks that sketches and sizes don't rule out, as many as connect what they all connect."""

    def pairs(table: pa.Table) -> pa.Table:
        pair, side = table.column("pair").to_numpy(), table.column("side").to_numpy()
        doc, size = table.column("doc").to_numpy(), table.column("n_shingles").to_numpy()
        sketch = table.column("sketch").to_pylist()
        out: list[tuple[int, int]] = []
        top: dict[int, int] = {}

        def find(x: int) -> int:
            while top.setdefault(x, x) != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        order = np.lexsort((size, side, pair))
        for rows in np.split(order, np.flatnonzero(np.diff(pair[order])) + 1):
            left, right = rows[side[rows] == 0], rows[side[rows] == 1]
            if not len(right):
                right = left
            by = lambda part: {w: [r for r in part if len(sketch[r]) == w] for w in {len(sketch[r]) for r in part}}
            matrix = lambda part: np.stack([np.frombuffer(sketch[r], np.uint8) for r in part])
            ours, theirs = by(left), by(right)
            for w, mine in ours.items():
                for v in (w // 2, w, 2 * w):
                    if v not in theirs:
                        continue
                    x, y = matrix(mine), matrix(theirs[v])
                    x, y = (_folded(x), y) if v < w else (x, _folded(y)) if v > w else (x, y)
                    x, y = (m.view(np.uint64) if m.shape[1] % 8 == 0 else m for m in (np.ascontiguousarray(x), np.ascontiguousarray(y)))
                    n, m = size[mine], size[theirs[v]]
                    for i in range(len(mine)):
                        # sizes are in order: those that may link are a run
                        lo, hi = np.searchsorted(m, [-(-n[i] * num // den), n[i] * den // num + 1])
                        differ = np.bitwise_count(y[lo:hi] ^ x[i]).sum(axis=1, dtype=np.int64)
                        for j in np.flatnonzero(differ * (den + num) <= (n[i] + m[lo:hi]) * (den - num)).tolist():
                            a, b = int(doc[mine[i]]), int(doc[theirs[v][lo + j]])
                            r, t = find(a), find(b)
                            if r != t:
                                top[max(r, t)] = min(r, t)
                                out.append((a, b))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return pairs


class Bands:
    """Size bands for 'num / den of the union is shared', and k for each."""

    def __init__(self, num: int, den: int, largest: int) -> None:
        self.first = -(-num // (den - num))  # the smallest set that can link with a larger one
        low, lows, k = self.first, [], []
        while low <= max(largest, self.first):
            high = low * den // num
            lows.append(low)
            k.append(2 * high * (den - num) // (den + num))
            low = high + 1
        high = low * den // num
        lows.append(low)
        k.append(2 * high * (den - num) // (den + num))
        self.lows, self.k = np.array(lows), np.array(k)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, sizes, "right") - 1


def signatures(flat: np.ndarray, bounds: np.ndarray, num: int, den: int, sig_bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """All PartEnum signatures of the sets, sig_bits high bits each, and the set that each belongs to.

    k up to FEW: one first-level range, FINE second-level ranges, all subsets of FINE - k of them.
    Above: k2 = 1 and n2 = 3, and a few first-level ranges more than k needs (the slack): a linked pair
    then shares signatures in slack + 1 of them, so a set with empty subsets in no more ranges than
    that sends none for them; sharing emptiness says nothing, and would make candidates of all sets.
    """
    sizes = np.diff(bounds)
    bands = Bands(num, den, int(sizes.max()) if len(sizes) else 0)
    sets = np.flatnonzero(sizes >= bands.first)
    sigs, owners = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    own_band = bands.of(sizes)
    for tags in (own_band, own_band + 1) if len(sets) else ():
        k = bands.k[np.where(sizes >= bands.first, tags, 0)]
        for few in [*range(1, FEW + 1), 0]:
            chosen = (sizes >= bands.first) & ((k == few) if few else (k > FEW))
            if not chosen.any():
                continue
            h, n, own = flat[np.repeat(chosen, sizes)], sizes[chosen], np.flatnonzero(chosen)
            n1 = np.ones(len(own), np.int64) if few else k[own] // 2 + 1
            slack = np.zeros(len(own), np.int64) if few else 2 + n1 // 8
            sig, owner = _enumerated(h, n, tags[own], n1 + slack, slack, FINE if few else 3, few or 1)
            sigs.append(sig)
            owners.append(own[owner])
    return np.concatenate(sigs) & ~U64((1 << (64 - sig_bits)) - 1), np.concatenate(owners)


#: Of k, up to where all second-level subsets of FINE ranges are enumerated.
FEW, FINE = 6, 8


def bits_for(size: int) -> tuple[int, int]:
    """Bits of a signature, and of the class digest that goes with it, for so many bytes of input.

    2 ** 22 times the signatures to be expected, and 2 ** 12 times the documents: chance equality adds
    a few candidates, which are verified, and loses none; the digest's bits are whole bytes.
    """
    sig = min(64, (size // 4).bit_length() + 22)
    return sig, min(64, 8 * -(-((size // 1024).bit_length() + 12) // 8))


def _enumerated(h: np.ndarray, n: np.ndarray, tag: np.ndarray, n1: np.ndarray, slack: np.ndarray, n2: int, k2: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets of n hashes each, h in order, with n1 first-level ranges, and the set of each."""
    cells = n1 * n2
    base = np.concatenate(([0], np.cumsum(cells)))
    at = np.repeat(base[:-1], n) + ((h >> U64(32)) * np.repeat(cells, n).astype(U64) >> U64(32)).astype(np.int64)
    edge = np.flatnonzero(np.diff(at, prepend=-1))
    table = np.zeros(base[-1], U64)
    table[at[edge]] = np.add.reduceat(mix(h ^ U64(0xC2B2AE3D27D4EB4F)), edge)
    table = table.reshape(-1, n2)
    owner = np.repeat(np.arange(len(n)), n1)
    row = np.arange(len(owner)) - np.repeat(base[:-1] // n2, n1)
    where = mix(row.astype(U64) * U64(0x2545F4914F6CDD1D) + tag[owner].astype(U64) * U64(0x9E3779B97F4A7C15))
    mixed = [mix(table[:, j] + U64((j + 1) * 0xE7037ED1A0B428DB % (1 << 64))) for j in range(n2)]
    subsets = list(combinations(range(n2), n2 - k2))
    empty = [~table[:, s].any(axis=1) for s in subsets]
    hollow = np.bincount(owner, weights=np.logical_or.reduce(empty), minlength=len(n))
    sparse = (hollow > slack)[owner]
    sigs, owners = [], []
    for number, (subset, none) in enumerate(zip(subsets, empty, strict=True)):
        part = where + U64((number + 1) * 0x632BE59BD9B4E019 % (1 << 64))
        for j in subset:
            part = part + mixed[j]
        sent = ~none | sparse
        sigs.append(mix(part[sent]))
        owners.append(owner[sent])
    return np.concatenate(sigs), np.concatenate(owners)


def _digest_rows(width: int):
    def rows(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            n, d1, d2, sketch = [], [], [], []
            for _, flat, bounds in shingle_sets(data, offsets, width):
                a, b = _digests(flat, bounds)
                sketch += sketches(flat, bounds)
                n.append(np.diff(bounds))
                d1.append(a)
                d2.append(b)
            cat = lambda parts, kind: np.concatenate(parts or [np.zeros(0)]).astype(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cat(n, np.int64)), pa.array(cat(d1, U64).view(np.int64)), pa.array(cat(d2, U64).view(np.int64)), pa.array(sketch, pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "sketch"])

    return rows


def _signature_rows(width: int, num: int, den: int, bits: int, sig_bits: int, id_bits: int):
    def packed(sigs: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        sig, ids_ = np.concatenate(sigs), np.concatenate(ids)
        rank = np.argsort(sig)
        sig, ids_ = sig[rank], ids_[rank]
        cuts = cut_by_top_bits(sig, bits)
        full = np.flatnonzero(np.diff(cuts))
        lists = pa.array([pack_sorted(sig[cuts[b] : cuts[b + 1]]) for b in full], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), lists, pa.array([_pack_ids(ids_[cuts[b] : cuts[b + 1]], id_bits) for b in full], pa.binary())], ["bucket", "sigs", "ids"])

    def rows(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            seen, sigs, ids = np.zeros(0, U64), [], []
            for _, flat, bounds in shingle_sets(data, offsets, width):
                d1, _ = _digests(flat, bounds)
                _, first = np.unique(d1, return_index=True)
                new = np.zeros(len(d1), bool)
                new[first] = True
                new &= ~np.isin(d1, seen)
                seen = np.union1d(seen, d1)
                sizes = np.diff(bounds) * new
                flat = flat[np.repeat(new, np.diff(bounds))]
                sig, owner = signatures(flat, np.concatenate(([0], np.cumsum(sizes))), num, den, sig_bits)
                sigs.append(sig)
                ids.append(d1[owner] >> U64(64 - id_bits))
                if sum(map(len, sigs)) >= SENT:
                    yield packed(sigs, ids)
                    sigs, ids = [], []
            if sum(map(len, sigs)):
                yield packed(sigs, ids)

    return rows


#: Signatures that a task holds before it sends them.
SENT = 1_500_000


def _pack_ids(ids: np.ndarray, bits: int) -> bytes:
    return bytes([bits // 8]) + squeeze(np.ascontiguousarray(ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : bits // 8]).tobytes())


def _unpack_ids(blob: bytes) -> np.ndarray:
    width = blob[0]
    short = np.frombuffer(unsqueeze(blob[1:]), np.uint8).reshape(-1, width)
    return np.hstack((short, np.zeros((len(short), 8 - width), np.uint8))).view("<u8").reshape(-1).astype(U64)


def _candidates(table: pa.Table) -> pa.Table:
    """(x, y): of class ids that share a signature, the lowest with each other one: enough to connect them."""
    sig = np.concatenate([unpack_sorted(x) for x in table.column("sigs").to_pylist()])
    ids = np.concatenate([_unpack_ids(x) for x in table.column("ids").to_pylist()])
    rank = np.lexsort((ids, sig))
    sig, ids = sig[rank], ids[rank]
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    low = ids[np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))]
    other = low != ids
    rows = np.unique(np.rec.fromarrays((low[other], ids[other]), names="x,y"))
    return pa.table({"x": pa.array(rows["x"].view(np.int64)), "y": pa.array(rows["y"].view(np.int64))})


def _squeezed(batches):
    for batch in batches:
        texts = [squeeze((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], ["doc", "d1", "text"])


def _plain(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of compressed texts."""
    return text_buffers(pa.array([unsqueeze(x) for x in column.to_pylist()], pa.large_binary()))


def _linked(width: int, num: int, den: int):
    def rows(batches):
        for batch in batches:
            sets: dict[tuple[int, int], np.ndarray] = {}
            for id_at, d1_at, text_at in ((0, 2, 4), (1, 3, 5)):
                ids, d1 = batch.column(id_at).to_pylist(), batch.column(d1_at).to_pylist()
                new = list({x: i for i, x in reversed(list(enumerate(zip(ids, d1, strict=True)))) if x not in sets}.values())
                data, offsets = _plain(batch.column(text_at).take(pa.array(new, pa.int64())))
                for i, flat, bounds in shingle_sets(data, offsets, width):
                    own, _ = _digests(flat, bounds)
                    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                        at = new[i + k]
                        # a row that repeats the doc_id may have another text: it is no member of this class
                        sets[ids[at], d1[at]] = flat[a:b] if int(own[k].view(np.int64)) == d1[at] else np.zeros(0, U64)
            left, right = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True), zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ok = []
            for x, y in zip(left, right, strict=True):
                a, b = sets[x], sets[y]
                both = 0
                if min(len(a), len(b)) * den >= max(len(a), len(b)) * num and len(a):
                    at = np.searchsorted(b, a)
                    at[at == len(b)] = 0
                    both = int((b[at] == a).sum())
                ok.append(both > 0 and both * den >= (len(a) + len(b) - both) * num)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok, pa.bool_())), batch.column(1).filter(pa.array(ok, pa.bool_()))], ["a", "b"])

    return rows


def link_components(docs: DataFrame, width: int = 3, percent: int = 90, bucket_bytes: int = 6 << 20) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id. Documents link when 100 * shared >= percent * union."""
    spark: SparkSession = docs.sparkSession
    ship_package(spark)
    num, den = percent, 100
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    digests = stage_table(spark, docs.mapInArrow(tidy(_digest_rows(width)), "doc_id long, n_shingles long, d1 long, d2 long, sketch binary"), "digests")
    classes = stage_table(spark, digests.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("doc")), "classes")

    bits = int(max(2 * shuffle_parts(spark), input_bytes(docs) // bucket_bytes, 1) - 1).bit_length()
    sig_bits, id_bits = bits_for(input_bytes(docs))
    sent = docs.where("doc_id is not null").select("text").mapInArrow(tidy(_signature_rows(width, num, den, bits, sig_bits, id_bits)), "bucket int, sigs binary, ids binary")
    found = sent.groupBy("bucket").applyInArrow(_candidates, "x long, y long").distinct()
    named = classes.select((F.shiftrightunsigned("d1", 64 - id_bits) if id_bits < 64 else F.col("d1")).alias("id"), "doc")
    as_ = lambda i, d: named.select(F.col("id").alias(i), F.col("doc").alias(d))
    # classes of equal ids were one in the lists: they are candidates of each other
    twins = named.groupBy("id").agg(F.count("*").alias("n"), F.min("doc").alias("b")).where("n > 1").join(named, "id").where("doc <> b").select(F.col("b").alias("a"), F.col("doc").alias("b"))
    pairs = found.join(as_("x", "a"), "x").join(as_("y", "b"), "y").where("a <> b").select("a", "b").union(twins)
    pairs = stage_table(spark, pairs.distinct(), "pairs")  # a: of those with a common signature the lowest

    labels = None
    if pairs.take(1):
        # families that sketches leave connected
        known = digests.select(F.col("doc_id").alias("doc"), "d1", "n_shingles", "sketch").join(classes.select("doc", "d1"), ["doc", "d1"]).dropDuplicates(["doc", "d1"])
        loose = stars(pairs)
        loose = loose.select("node", "component").union(loose.select("component", "component").distinct()).toDF("doc", "family").withColumn("comp", F.col("doc"))
        loose = _around_lowest(spark, stage_table(spark, loose, "loose"), pairs, SKETCHED)
        dealt = _dealt_blocks(spark, loose, SKETCHED).join(known.select("doc", "n_shingles", "sketch"), "doc")
        tight = stage_table(spark, dealt.groupBy("deal").applyInArrow(_plausible_blocks(num, den), "a long, b long"), "tight")
        family = stars(tight)
        family = family.union(family.select("component", "component").distinct()).toDF("doc", "family")
        members = stage_table(spark, family.join(classes.select("doc", "d1"), "doc"), "members")

        some = possible(docs.withColumnRenamed("doc_id", "doc"), "doc", members.select("doc"), members.count()).where("may").drop("may")
        fetched = some.join(members.hint("merge"), "doc").select("doc", "d1", "text")
        texts = stage_table(spark, fetched.mapInArrow(tidy(_squeezed), "doc long, d1 long, text binary"), "texts")
        left = texts.select(F.col("doc").alias("a"), F.col("d1").alias("d1_a"), F.col("text").alias("text_a"))
        right = texts.select(F.col("doc").alias("b"), F.col("d1").alias("d1_b"), F.col("text").alias("text_b"))
        star = members.where("doc <> family").select(F.col("doc").alias("a"), F.col("family").alias("b"))
        full = star.join(left, "a").join(right, "b").select("a", "b", "d1_a", "d1_b", "text_a", "text_b")
        links = stage_table(spark, full.mapInArrow(tidy(_linked(width, num, den)), "a long, b long").distinct(), "links")
        labels = stars(links)
        families = _open_families(spark, members.select("doc", "family"), labels)
        if families is not None:
            dealt = _dealt_blocks(spark, _around_lowest(spark, families, pairs, BLOCK), BLOCK).join(texts, "doc").select("deal", "pair", "side", "doc", "comp", "d1", "text")
            more = dealt.groupBy("deal").applyInArrow(_linked_blocks(width, num, den), "a long, b long")
            labels = stars(links.union(more))
    own = digests.drop("sketch").join(classes, ["d1", "d2", "n_shingles"], "left")
    if labels is not None:
        own = own.join(labels.withColumnRenamed("node", "doc"), "doc", "left")
        component = F.coalesce("component", "doc", "doc_id")
    else:
        component = F.coalesce("doc", "doc_id")
    return own.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))


def _open_families(spark: SparkSession, members: DataFrame, labels: DataFrame) -> DataFrame | None:
    """(family, doc, comp) of the families that have more than one component."""
    labelled = members.join(labels.withColumnRenamed("node", "doc"), "doc", "left").select("family", "doc", F.coalesce("component", "doc").alias("comp"))
    mixed = labelled.groupBy("family").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("family")
    families = stage_table(spark, labelled.join(mixed, "family"), "open")
    return families if families.take(1) else None


#: Members of a block of texts, and of sketches; two blocks are compared in one task.
BLOCK, SKETCHED = 128, 4096


def _around_lowest(spark: SparkSession, members: DataFrame, pairs: DataFrame, block: int) -> DataFrame:
    """members(family, doc, comp), where families of several blocks are taken apart: into those that have a common class as the lowest of a signature.

    A linked pair shares a signature, so its lowest class is paired with both, or is one of them: the two are in
    one group at least. Groups overlap, but have no more rows than signatures were sent, while pairs of blocks grow
    with the square of a family, which a few chance signatures make of most texts. A family whose pairs of
    blocks are fewer rows stays as it is, as does one within a block.
    """
    cost = F.sum(F.col("n") * F.ceil(F.col("n") / block))
    large = stage_table(spark, members.groupBy("family").agg(F.count("*").alias("n")).where(F.col("n") > block), "large")
    if not large.take(1):
        return members
    near = pairs.select(F.col("a").alias("low"), F.col("b").alias("doc")).union(pairs.select("a", "a").distinct())
    near = stage_table(spark, members.join(large.select("family"), "family").join(near, "doc").select("family", "low", "doc", "comp"), "near")
    groups = near.groupBy("family", "low").agg(F.count("*").alias("n"), F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most")
    fewer = groups.groupBy("family").agg(cost.alias("apart")).join(large.groupBy("family").agg(cost.alias("whole")), "family").where("apart < whole").select("family")
    apart = stage_table(spark, groups.join(fewer, "family").select("family", "low"), "apart")
    taken = near.join(apart, ["family", "low"]).select(F.xxhash64("family", "low").alias("family"), "doc", "comp")
    return members.join(apart.select("family").distinct(), "family", "left_anti").select("family", "doc", "comp").union(taken)


def _dealt_blocks(spark: SparkSession, members: DataFrame, block: int) -> DataFrame:
    """Members, once for each pair of blocks of their family that theirs is compared with.

    A component with half a block's members or more in the family has blocks of its own, which are not
    compared with each other; all others of the family share blocks.
    """
    large = members.groupBy("family", "comp").agg(F.count("*").alias("n")).where(F.col("n") >= block // 2).select("family", "comp", F.col("comp").alias("pool"))
    pooled = members.join(large, ["family", "comp"], "left").withColumn("own", F.col("pool").isNotNull()).withColumn("pool", F.coalesce("pool", F.lit(0)))
    sizes = pooled.groupBy("family", "own", "pool").agg(F.ceil(F.count("*") / block).alias("blocks"))
    pooled = stage_table(spark, pooled.join(sizes, ["family", "own", "pool"]).withColumn("block", F.pmod(F.xxhash64("doc"), "blocks")).drop("blocks"), "blocks")
    blocks = pooled.select("family", F.struct("own", "pool", "block").alias("block")).distinct()
    pairs = blocks.join(blocks.withColumnRenamed("block", "other"), "family").where("block <= other and not (block.own and other.own and block.pool = other.pool)")
    pairs = pairs.withColumn("pair", F.xxhash64("family", "block", "other"))
    sides = pairs.select("family", "pair", F.lit(0).alias("side"), "block").union(pairs.where("block <> other").select("family", "pair", F.lit(1), "other"))
    sides = sides.select("family", "pair", "side", "block.own", "block.pool", "block.block")
    deals = max(2 * shuffle_parts(spark), pooled.count() // block)
    return pooled.join(sides, ["family", "own", "pool", "block"]).select(F.pmod("pair", F.lit(deals)).alias("deal"), "pair", "side", "doc", "comp")


def _linked_blocks(width: int, num: int, den: int):
    """Links between members of different components of each pair of blocks: enough to connect what is connected."""

    def links(table: pa.Table) -> pa.Table:
        doc, d1, comp = (table.column(c).to_numpy() for c in ("doc", "d1", "comp"))
        names, first, which = np.unique(np.stack((doc, d1)), axis=1, return_index=True, return_inverse=True)
        which = which.reshape(-1)
        data, offsets = _plain(table.column("text").take(pa.array(first)))
        sets: list[np.ndarray] = []
        for i, flat, bounds in shingle_sets(data, offsets, width):
            own, _ = _digests(flat, bounds)
            fits = own.view(np.int64) == names[1, i : i + len(own)]  # a row that repeats the doc_id may have another text
            sets += [flat[x:y] if ok else flat[:0] for x, y, ok in zip(bounds[:-1], bounds[1:], fits, strict=True)]
        label = {int(x): int(x) for x in comp}

        def top(x: int) -> int:
            while label[x] != x:
                label[x] = label[label[x]]
                x = label[x]
            return x

        pair, side = table.column("pair").to_numpy(), table.column("side").to_numpy()
        out: list[tuple[int, int]] = []
        order = np.lexsort((side, pair))
        for rows in np.split(order, np.flatnonzero(np.diff(pair[order])) + 1):
            left, right = rows[side[rows] == 0], rows[side[rows] == 1]
            alone = not len(right)
            right = left if alone else right
            size = np.array([len(sets[which[r]]) for r in left])
            flat = np.concatenate([sets[which[r]] for r in left])
            rank = np.argsort(flat, kind="stable")
            flat, owner = flat[rank], np.repeat(np.arange(len(left)), size)[rank]
            for k, r in enumerate(right):
                own = sets[which[r]]
                lo, hi = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
                n = hi - lo
                hits = owner[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())] if n.sum() else owner[:0]
                both = np.bincount(hits, minlength=len(left))
                near = np.flatnonzero((both > 0) & (both * den >= (size + len(own) - both) * num))
                for x in near[near < k] if alone else near:
                    a, b = top(int(comp[left[x]])), top(int(comp[r]))
                    if a != b:
                        label[max(a, b)] = min(a, b)
                        out.append((int(doc[left[x]]), int(doc[r])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return links
