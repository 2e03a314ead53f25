"""Languages, periodic runs and ranked search against plain Python on small tables, with nulls, ties, copies, long texts and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from trowel.llm import lang_id, lexical_search, periodic_runs

# --- languages


def tongue(r, letters):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(r.randint(5, 60)))


@pytest.fixture(scope="module")
def spoken(spark):
    r = random.Random(2)
    rows = [(i, tongue(r, ["abcdeé", "uvwxyz", "ßüöklm"][i % 3]), ["aa", "uu", "ss"][i % 3], 0.5, "x") for i in range(240)]
    rows += [(500, None, "aa", 0.0, "x"), (501, "12 34 -- !", "uu", 0.0, "x"), (502, "", None, 0.0, "x"), (None, tongue(r, "abcdeé"), "aa", 0.0, "x"), (503, tongue(r, "uvwxyz") * 400, None, 0.0, "x"), (0, rows[0][1], "aa", 0.0, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string").repartition(3)


def grams(text):
    """Two- and three-letter n-grams of words between blanks, with the place that the module gives each."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = []
    for w in words:
        s = f" {w} "
        out += [s[i : i + 2] for i in range(len(s) - 1)] + [s[i : i + 3] for i in range(len(s) - 2) if s[i + 1] != " "]
    return Counter(out)


def test_grams_are_those_of_words():
    r = random.Random(4)
    texts = ["", None, "a", "Ab-cd  e", " é1x ", "  ..", "x y"] + [tongue(r, "aBÉ .1") for _ in range(40)]
    owner, place = lang_id.text_grams(texts)
    for k, t in enumerate(texts):
        assert int((owner == k).sum()) == sum(grams(t or "").values()), t
    # equal n-grams have equal places: texts of the same n-grams in another order
    a, b = lang_id.text_grams(["ab cd"])[1], lang_id.text_grams(["cd ab"])[1]
    assert sorted(a.tolist()) == sorted(b.tolist())


def test_nearest_centroid_equals_plain_cosines(spark, spoken):
    model = lang_id.fit(spoken.where("crc32(cast(doc_id as string)) % 4 <> 2"))
    assert sorted(set(model.langs)) == ["aa", "ss", "uu"] and len(model.langs) <= 3 * lang_id.CENTROIDS
    assert np.allclose(np.linalg.norm(model.centres, axis=1), 1, atol=1e-5)
    got = lang_id.identify(spoken, model).collect()
    texts = {r.doc_id: r.text for r in spoken.collect()}
    for row in got:
        text = texts[row.doc_id]
        if not any(c.isalpha() for c in text or ""):
            assert (row.lang_pred, row.score, row.accepted) == ("und", 0.0, False)
            continue
        places = Counter(lang_id.text_grams([text])[1].tolist())
        x = {p: (1 + math.log(n)) * model.idf[p] for p, n in places.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        cos = [sum(v * c[p] for p, v in x.items()) / norm for c in model.centres]
        assert abs(row.score - max(cos)) < 1e-4 and cos[model.langs.index(row.lang_pred)] <= row.score + 1e-4
        assert row.accepted == (row.score >= model.least[int(np.argmax(cos))]) or abs(row.score - model.least[int(np.argmax(cos))]) < 1e-4


def test_language_report(spark, spoken):
    got = lang_id.language_report(spoken).collect()
    assert len(got) == 246
    truth = {r.doc_id: r.lang for r in spoken.collect()}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        if r.doc_id is not None and r.doc_id < 240:
            assert r.lang_pred == truth[r.doc_id]
    by_id = {r.doc_id: r for r in got}
    assert by_id[500].lang_pred == by_id[501].lang_pred == by_id[502].lang_pred == "und" and by_id[503].lang_pred == "uu"
    assert lang_id.language_report(spoken.limit(0)).count() == 0
    none = lang_id.language_report(spoken.withColumn("lang", spoken["lang"].substr(99, 0)).selectExpr("doc_id", "text", "nullif(lang, lang) as lang"))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_strange_languages_are_rejected(spark, spoken):
    model = lang_id.fit(spoken)
    odd = spark.createDataFrame([(1, "qjq qjqj jqjq qqjj " * 20)], "doc_id long, text string")
    assert not lang_id.identify(odd, model).first().accepted
    assert lang_id.identify(spoken.where("doc_id < 240"), model).where("accepted").count() > 220


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(lang_id, "MAX_LANGUAGES", 2)
    df = spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(3)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        lang_id.fit(df)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lang_id.language_report(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


# --- periodic runs


def runs_of(w):
    """All stretches of words that stay equal at a distance, long enough, and within none of a smaller distance."""
    out = []
    for p in range(1, len(w) // periodic_runs.MIN_PERIODS + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(periodic_runs.MIN_LENGTH, periodic_runs.MIN_PERIODS * p) and j > i:
                out.append((i, j - i + p, p))
            i = j + 1
    return sorted((r for r in out if not any(q[2] < r[2] and q[0] <= r[0] and q[0] + q[1] >= r[0] + r[1] for q in out)), key=lambda r: (r[0], r[2]))


def tailed(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is None or h % 10 or not n:
        return w
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def told(doc_id, text):
    w = tailed(doc_id, text)
    runs = runs_of(w)
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return len(w), len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_runs_equal_brute_force(spark):
    r = random.Random(1)
    texts = []
    for _ in range(150):
        w = [r.choice("abcd"[: r.randint(1, 4)]) for _ in range(r.randint(0, 50))]
        if r.random() < 0.6 and w:
            a, p = r.randrange(len(w)), r.randint(1, 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        texts.append(r.choice([" ", "\n", " \t"]).join(w))
    texts += [None, "", " \n", "é é é é é é", "a b " * 3000, " ".join(f"w{i % 700}" for i in range(6000)), "x " * 5 + "y " * 6, "  b", "one"]
    rows = [(i, t, 9) for i, t in enumerate(texts)] + [(0, texts[0], 1), (None, "a a a a a a a", 2), (-7, "b c b c b c b c", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int").repartition(4)
    got = sorted(map(tuple, periodic_runs.runs_report(df).select("doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()), key=str)
    assert got == sorted(((i, *told(i, t)) for i, t, _ in rows), key=str)
    plain = {x.doc_id: x for x in periodic_runs.periodic_runs(df.where("doc_id = 153")).collect()}
    assert [tuple(x) for x in plain[153].runs] == [(0, 6, 1)] and plain[153].collapsed == "é"
    assert periodic_runs.runs_report(df.limit(0)).count() == 0


def test_next_smaller_with_long_falls(monkeypatch):
    r = random.Random(6)
    for jumps in (0, 3, 2048):
        monkeypatch.setattr(periodic_runs, "JUMPS", jumps)
        for v in ([0, *range(200, 1, -1)], r.sample(range(60), 60), [3], []):
            got = periodic_runs.next_smaller(np.array(v, np.int64)).tolist()
            assert got == [next((j for j in range(i + 1, len(v)) if v[j] < v[i]), len(v)) for i in range(len(v))]


# --- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranking(docs, items, top=50):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            size = sum(c.values())
            m = 50 + 50 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_bytes", [4 << 20, 400])
def test_search_equals_a_scan_of_all_documents(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(lexical_search, "SHARD_BYTES", shard_bytes)
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 4)))
    topics = [[word() for _ in range(25)] for _ in range(6)]
    texts = [" ".join(r.choice(topics[i % 6] + ["the", "of", "É1"]) for _ in range(r.randint(1, 60))) for i in range(260)]
    docs = list(enumerate(texts)) + [(300 + i, texts[3]) for i in range(90)] + [(400, None), (401, ""), (402, "-- !!"), (None, texts[5]), (7, texts[9]), (403, "the " * 9000), (404, "THE, of?")]
    r.shuffle(docs)
    items = [(i, " ".join(r.choice(topics[i % 6] + ["the"]) for _ in range(12))) for i in range(9)] + [(20, None), (21, "!!"), (22, "the the of"), (23, "absent zzzzz"), (24, texts[3]), (24, texts[3]), (None, "É1 the")]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, score int, terms int").repartition(5)
    asked = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int")
    index = lexical_search.build_index(df)
    assert index.agg({"n_docs": "sum"}).first()[0] == len(docs)
    assert index.count() > (6 if shard_bytes == 400 else 0)
    got = sorted(map(tuple, lexical_search.search(index, asked).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == ranking(docs, items)


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search_report(docs, items).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lexical_search.search_report(some, items.limit(0)).count() == 0
    assert [tuple(x) for x in lexical_search.search_report(some, items).select("item_id", "rank", "doc_id").collect()] == [(1, 1, 1)]


def test_items_are_asked_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "ITEMS", 2)
    docs = [(i, f"a{i % 3} b c{i}") for i in range(20)]
    items = [(i, f"a{i} b") for i in range(5)]
    got = lexical_search.search_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == ranking(docs, items)


def test_bisection_puts_like_documents_together():
    r = random.Random(3)
    kind = [k % 2 for k in range(200)]
    r.shuffle(kind)
    docs = [np.sort(np.array(r.sample(range(30), 12), np.uint64)) + np.uint64(25 * k) for k in kind]  # 5 of 55 terms are of both kinds
    doc = np.repeat(np.arange(200), 12)
    side = lexical_search.bisect(doc, np.concatenate(docs).astype(np.int64), 200, 55)
    alike = sum(int(s) == k for s, k in zip(side, kind, strict=True))
    assert side.sum() == 100 and max(alike, 200 - alike) >= 190
    tree = lexical_search.Tree.fit(docs)
    half = tree.leaves(200, doc, np.concatenate(docs)) >> (lexical_search.LEVELS - 1)
    alike = sum(int(s) == k for s, k in zip(half, kind, strict=True))
    assert max(alike, 200 - alike) >= 190
