"""The pipeline against a brute-force version on a small corpus, and its contract on the driver's smallest tables."""

import hashlib
import math
from collections import defaultdict
from pathlib import Path

import pytest
from test_operators import components, corpus, repeat_words, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
from trowel.llm import line_dedup, mixing, quality  # noqa: E402

DATA = "/root/testdata/sf0.001"


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def fails(text):
    """Which rules a text fails, from its words, symbols and lines."""
    w = words(text)
    chars, symbols = sum(map(len, w)), sum(text.count(c) for c in quality.SYMBOLS)
    lines = [x for x in text.split("\n") if words(x)]
    return {"base": len(w) < 10 or 100 * repeat_words(w) > 20 * len(w), "symbols": 10 * symbols > len(w), "duplicates": len(lines) - len(set(lines)) >= 3, "words": chars > 12 * len(w) or chars < 2 * len(w)}


def bad_hosts(docs, limits):
    """rule -> domains whose shrunk rate is above the rule's limit."""
    failed, hosts, bad = {i: fails(d["text"]) for i, d in docs.items()}, defaultdict(list), {}
    for i, d in docs.items():
        if d["source"] is not None:
            hosts[d["source"]].append(failed[i])
    for rule, limit in limits.items():
        own = {h: [x[rule] for x in rows] for h, rows in hosts.items()}
        m = sum(map(sum, own.values())) / sum(map(len, own.values()))
        rates = [sum(x) / len(x) for x in own.values()]
        v = sum((r - sum(rates) / len(rates)) ** 2 for r in rates) / len(rates)
        excess = max(v - m * (1 - m) * sum(1 / len(x) for x in own.values()) / len(own), 1e-9)
        s = min(max(m * (1 - m) / excess - 1, quality.STRENGTH[0]), quality.STRENGTH[1])
        bad[rule] = {h for h, x in own.items() if (sum(x) + s * m) / (len(x) + s) > limit}
    return failed, bad


def brute_quality(docs, limits=None):
    limits = {r: x for r, (_, x) in quality.RULES.items()} | (limits or {})
    failed, bad = bad_hosts(docs, limits)
    return {i: d for i, d in docs.items() if not failed[i]["base"] and d["source"] not in bad["base"] and not any(failed[i][r] and d["source"] in bad[r] for r in limits if r != "base")}


def brute_lines(docs):
    seen, out = set(), {}
    for i in sorted(docs):
        lines = docs[i]["text"].split("\n")
        h = [int(md5(x)[:8], 16) for x in lines]
        kept, start = [], 0
        for k in range(len(lines)):
            if k == len(lines) - 1 or (k and (h[k - 1] * line_dedup.BASE + h[k]) % line_dedup.MODULUS % 16 < line_dedup.CUT):
                chunk = tuple(lines[start : k + 1])
                start = k + 1
                if len(chunk) < 2 or chunk not in seen:
                    kept += chunk
                seen |= {chunk}
        out[i] = docs[i] | {"text": "\n".join(kept)}
    return out


def brute_near(docs):
    sets = {}
    for i, d in docs.items():
        w = words(d["text"].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    top = components(sets, links)
    return {i: d for i, d in docs.items() if top[i] == i}


def shares(budget, nodes):
    """nodes: name -> (capacity, weight). Full nodes are taken out until none is."""
    out, left = {}, dict(nodes)
    while left:
        weight = sum(w for _, w in left.values())
        full = [n for n, (c, w) in left.items() if c <= budget * w / weight + 1e-9]
        if not full:
            return out | {n: budget * w / weight for n, (_, w) in left.items()}
        for n in full:
            out[n] = left.pop(n)[0]
        budget -= sum(out[n] for n in full)
    return out


def brute_mix(docs, ratio, epochs, seed, weights):
    leaves = defaultdict(list)
    for i, d in docs.items():
        source = d["source"] or "?"
        leaves[f"domain{int(md5(source)[:2], 16) % 4}", d["lang"] or "?", source].append((md5(f"{seed}:{i}:{md5(d['text'])}"), len(words(d["text"])), i))
    tokens = {leaf: sum(t for _, t, _ in rows) for leaf, rows in leaves.items()}
    budget = {(): float(math.floor(sum(tokens.values()) * ratio))}
    for depth in range(3):
        for prefix, want in [(p, b) for p, b in budget.items() if len(p) == depth]:
            caps = defaultdict(int)
            for leaf, t in tokens.items():
                if leaf[:depth] == prefix and t:
                    caps[leaf[depth]] += epochs * t
            got = shares(want, {n: (c, weights.get(mixing.LEVELS[depth], {}).get(n, 1.0)) for n, c in caps.items()})
            budget |= {(*prefix, n): b for n, b in got.items()}
    out = []
    for leaf, rows in leaves.items():
        want = math.floor(round(budget.get(leaf, 0.0), 3))
        whole = want // tokens[leaf] if tokens[leaf] else 1
        rest, run = want - whole * tokens[leaf], 0
        for _, t, i in sorted((md5(f"{whole}:{o}"), t, i) for o, t, i in rows):
            run += t
            out += [i] * (whole + (0 < rest and run <= rest))
    return out


def test_equals_brute_force(spark, tmp_path):
    rows = [(i, t, ["en", "fr", None][i % 3], f"src{i % 4}" if i % 11 else None, len(t or "")) for i, t in corpus(4, 90)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = {i: {"text": t or "", "lang": lang, "source": source} for i, t, lang, source, _ in rows}
    good = brute_quality(docs)
    kept = brute_near(brute_lines(good))
    assert len(kept) < len(good) < len(docs)
    taken = brute_mix(kept, 1.0, 2, mixing.SEED, corpus_pipeline.WEIGHTS)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for i in taken:
        ids = library.encode(kept[i]["text"])
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(want)


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")
def test_stages(spark, tmp_path):
    docs = source = spark.read.parquet(f"{DATA}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == source.columns, name
            assert docs.select("doc_id").distinct().join(before, "doc_id", "left_anti").count() == 0
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect()))


def test_host_rules_that_bite_equal_brute_force(spark):
    """Hosts that fail a rule often: of these, and only these, the documents go that fail it."""
    good = " ".join(f"word{k}" for k in range(30))
    noisy, odd = good + " # # # # #", " ".join("abcdefghijklmnop" + str(k) for k in range(20))
    doubled = "\n".join(" ".join(f"l{k}x{j}" for j in range(6)) for k in [*range(40), 1, 2, 3])
    rows = [(i, f"s{i % 6}", (noisy if i % 6 == 0 and i % 5 else doubled if i % 6 == 1 and i % 4 else odd if i % 6 == 2 and i % 3 else "few words only" if i % 6 == 3 and i % 27 else noisy if i % 20 == 4 else good)) for i in range(300)] + [(900, None, noisy)]
    docs = {i: {"text": text, "source": source} for i, source, text in rows}
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    kept = brute_quality(docs)
    _, bad = bad_hosts(docs, {r: x for r, (_, x) in quality.RULES.items()})
    assert bad == {"base": {"s3"}, "symbols": {"s0"}, "duplicates": {"s1"}, "words": {"s2"}}
    got = {r.doc_id: r for r in quality.host_rules(df).collect()}
    assert {i for i, r in got.items() if r.kept} == set(kept) == {r.doc_id for r in quality.keep_good(df).collect()} and 900 in kept
    assert got[6].host_rules == "symbols" and got[6].failed == "symbols" and not got[6].kept and got[0].kept


ODD = "doc_id long, text string, lang string, source string, n_chars long, component_id long, digest string, t_tokens long, kept boolean, n_words string"


def test_stages_on_odd_rows(spark):
    """Nulls in all columns, blank and very long texts, repeated rows and ids, columns that clash with ours, and empty tables."""
    long = " ".join(f"w{k}" for k in range(30000))
    text = "\n".join(" ".join(f"line{k}x{j}" for j in range(7)) for k in range(8))
    rows = [(7, text, "en", "s1", 5), (7, text, "en", "s1", 5), (7, text + " x", None, None, None), (None, text, None, None, None), (8, None, None, "s1", 1), (9, "", "en", None, 0), (10, " \n ", "fr", "s1", 3), (11, long, "en", "s2", 9), (None, None, None, None, None)]
    df = spark.createDataFrame([(*r, 1, "d", 2, None, "n") for r in rows], ODD)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, df, None)
        assert got.columns == df.columns, name
        found = got.collect()
        assert all((r.digest, r.n_words) == ("d", "n") for r in found), name
        if name == "quality rules":
            assert sorted((r.doc_id or 0) for r in found) == [0, 7, 7, 7, 11]
        elif name == "line dedup":
            # equal ids are one document, whose own chunks stay; a null id sorts first and keeps its text
            assert len(found) == len(rows) and [r.text for r in found if r.doc_id is None and r.text] == [text]
        elif name == "n-gram Jaccard join":
            # equal ids are one document; rows with a null id are never near-duplicates
            assert len(found) == len(rows)
        assert stage(spark, df.limit(0), None).count() == 0, name
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, df, None).count() == len(rows) and stage(spark, df.limit(0), None).count() == 0


def test_empty_pipeline(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
