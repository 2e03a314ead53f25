"""Kernels on small tables, with the edge cases that the driver's tables do not have."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from trowel.functions import text as T
from trowel.plans import driver
from trowel.operators import geometry, graph, relations, summaries


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def test_layers_on_a_cycle_and_an_island(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"))
    assert rows(graph.layers(e, spark.createDataFrame([("a",)], "k string"))) == [("a", 0), ("b", 1), ("c", 2)]


def test_trace_goes_both_ways(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("b", "d"), ("i", "j"))
    got = rows(graph.trace(e, spark.createDataFrame([("b",)], "k string")))
    assert got == [("used_by", "a", 1), ("used_by", "b", 0), ("uses", "b", 0), ("uses", "c", 1), ("uses", "d", 1)]


@pytest.mark.parametrize("one_task", [graph.ONE_TASK, 0])
def test_components_of_a_long_chain_and_a_star(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = dict(rows(graph.components(spark.createDataFrame(pairs, "a long, b long"))))
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_components_of_nothing(spark):
    assert rows(graph.components(spark.createDataFrame([], "a long, b long"))) == []


LONG_WAY = pytest.mark.parametrize("one_task", [graph.ONE_TASK, 0], ids=["one task", "rounds"])


@LONG_WAY
def test_pointer_chase_follows_chains_to_where_they_meet_a_cycle(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("p", "q"), ("q", "p"), ("t", "q"), ("u", "t"), ("z", "z"), (None, "x"), ("y", None)], "old string, new string")
    assert dict(rows(graph.pointer_chase(links))) == {"a": "d", "b": "d", "c": "d", "p": "p", "q": "q", "t": "q", "u": "q", "z": "z"}


def renamed(events):
    """What names are called in the end, as a log read from its beginning says."""
    to = {}
    for old, new in events:
        to = {k: new if v == old else v for k, v in to.items()}
        to[old] = new
    out = {}
    for name in to:
        at, seen = name, set()
        while at in to and at not in seen:
            seen.add(at)
            at = to[at]
        out[name] = at
    return out


@LONG_WAY
def test_renames_in_the_order_of_the_log(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    r = random.Random(3)
    cases = [[("z", "b"), ("b", "z")], [("a", "z"), ("a", "b")], [("a", "b"), ("b", "c"), ("c", "d")], [("b", "c"), ("a", "b")], []]
    cases += [[(r.choice("abcdef"), r.choice("abcdef")) for _ in range(r.randint(1, 14))] for _ in range(1 if one_task == 0 else 12)]
    for events in cases:
        df = spark.createDataFrame([(n, *e) for n, e in enumerate(events)], "ord long, old string, new string")
        assert dict(rows(graph.rename_chain(df))) == renamed(events), events


def walk_cycles(pairs):
    """A plain recursive walk."""
    ahead, colour, stack, out = {}, {}, [], []
    for a, b in pairs:
        ahead.setdefault(a, set()).add(b)

    def walk(node):
        colour[node] = 1
        stack.append(node)
        for b in sorted(ahead.get(node, ())):
            if colour.get(b) == 1:
                cycle = [*stack[stack.index(b) :], b]
                if cycle not in out:
                    out.append(cycle)
            elif not colour.get(b):
                walk(b)
        stack.pop()
        colour[node] = 2

    for node in sorted({x for p in pairs for x in p}):
        if not colour.get(node):
            walk(node)
    return sorted(out)


@LONG_WAY
def test_cycles_as_a_walk_over_the_whole_graph_meets_them(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    r = random.Random(5)
    cases = [[("a", "z"), ("z", "b"), ("b", "z"), ("b", "c"), ("c", "z"), ("c", "b")], [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("d", "d"), ("x", "y")], []]
    for _ in range(1 if one_task == 0 else 20):
        n = r.randint(3, 14)
        cases.append([("n%02d" % r.randrange(n), "n%02d" % r.randrange(n)) for _ in range(r.randint(n, 2 * n))])
    for pairs in cases:
        found = graph.cycles(spark.createDataFrame(pairs, "src string, dst string"))
        assert sorted(x.nodes for x in found.collect()) == walk_cycles(pairs), pairs


@LONG_WAY
def test_count_of_cycles(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    pairs = ["ab", "ba", "bb", "cd", "dc", "dd", "cc", "de", "ef", "fe", "fg", "gh", "hg", "hf", "xx", "bx", "xy", "yz", "ac"]
    found = edges(spark, *map(tuple, pairs))
    assert graph.count_cycles(found) == len(walk_cycles(pairs))
    if one_task == 0:
        assert rows(graph.strong_components(found)) == [("a", "b"), ("b", "b"), ("c", "d"), ("d", "d"), ("e", "h"), ("f", "h"), ("g", "h"), ("h", "h"), ("x", "x")]


@LONG_WAY
def test_strong_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    e = edges(spark, ("r", "a"), ("a", "b"), ("b", "a"), ("b", "t"), ("t", "u"), ("u", "t"), ("s", "s"), ("t", "v"))
    assert rows(graph.strong_components(e)) == [("a", "b"), ("b", "b"), ("s", "s"), ("t", "u"), ("u", "u")]


def test_cyclic_core(spark):
    e = edges(spark, ("r", "a"), ("a", "b"), ("b", "a"), ("b", "t"))
    assert rows(graph.cyclic_core(e)) == [("a", "b"), ("b", "a")]


def test_overlap_pairs_with_a_feature_that_all_share(spark):
    data = [(k, f) for k in range(30) for f in ("common", f"own{k}", f"mine{k}")] + [(90, "x"), (91, "x"), (90, "y"), (91, "y"), (90, "common"), (91, "common")]
    df = spark.createDataFrame(data, "k long, f string")
    assert rows(relations.overlap_pairs(df, "k", "f", 3)) == [(90, 91, 3)]
    assert len(rows(relations.overlap_pairs(df, "k", "f", 1))) == 32 * 31 // 2


def test_co_occurrence_drops_large_groups_and_repeated_items(spark):
    data = [("g", 1), ("g", 1), ("g", 2), ("h", 2), ("h", 1)] + [("big", i) for i in range(26)]
    assert rows(relations.co_occurrence(spark.createDataFrame(data, "g string, i long"), "g", "i")) == [(1, 2, 2)]


def test_division_needs_every_value(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("a", 3)], "k string, v long")
    assert rows(relations.divides(df, "k", "v", spark.createDataFrame([(1,), (2,)], "v long"))) == [("a", 2)]


def test_resolution_takes_the_first_candidate(spark):
    refs = spark.createDataFrame([("r", ["no", "b", "a"]), ("s", ["zz"])], "id string, c array<string>")
    index = spark.createDataFrame([("a", 1), ("b", 5), ("b", 4)], "n string, t long")
    assert rows(relations.resolve_by_priority(refs, ["id"], F.col("c"), index, "n", "t")) == [("r", 4, 1)]


def test_hub_trim(spark):
    e = edges(spark, *((f"s{i}", "hub") for i in range(5)), ("s1", "x"))
    assert rows(relations.hub_trim(e, "src", "dst").select("src", "dst")) == [("s1", "x")]


def test_islands_merge_touching_ranges(spark):
    df = spark.createDataFrame([("k", 1, 4), ("k", 5, 9), ("k", 20, 22), ("k", 21, 21)], "k string, lo int, hi int")
    assert rows(summaries.islands(df, ["k"], F.col("lo"), F.col("hi"), F.lit(1))) == [("k", 1, 9, 2), ("k", 20, 22, 2)]


def test_lineage_counts(spark):
    members = spark.createDataFrame([("g", "a"), ("g", "b"), ("g", "c")], "g string, k string")
    features = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("c", "2"), ("c", "3"), ("c", "4")], "k string, f string")
    got = rows(summaries.lineage(members, features, "g", "k", "f"))
    assert got == [("g", "a", 1, 1, 0, 0), ("g", "b", 2, 1, 1, 0), ("g", "c", 3, 2, 1, 1)]


def test_mode_breaks_ties_by_severity(spark):
    df = spark.createDataFrame([("k", "mild"), ("k", "grave")], "k string, s string")
    assert rows(summaries.mode_by_severity(df, "k", "s", F.when(F.col("s") == "grave", 1).otherwise(2))) == [("k", "grave", 1)]


def test_latest_and_top_n(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 3, "c"), ("k", 2, "b")], "k string, t long, v string")
    assert rows(summaries.latest(df, ["k"], ["t"])) == [("k", 3, "c")]
    assert rows(summaries.top_n_more(df, ["k"], [F.desc("t")], 2).select("v", "rank", "more")) == [("b", 2, 1), ("c", 1, 1)]


def test_equal_sets(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "a"), (3, "a")], "k long, f string")
    assert rows(relations.equal_sets(df, "k", "f")) == [(1, 1, 2), (2, 1, 2)]


def test_text_functions(spark):
    def one(c, value):
        return spark.createDataFrame([(value,)], "x string").select(c(F.col("x")).alias("y")).first().y

    assert one(T.module_name, "a/b/__init__.py") == "a.b" and one(T.module_name, "__init__.py") == "" and one(T.module_name, "m.py") == "m"
    assert one(T.stamped_date, "notes_2026-06-19.py") == "2026-06-19" and one(T.stamped_date, "v20261301.py") is None
    assert one(T.vocabulary, "parseClaimForm") == ["parse", "claim", "form"]
    assert one(lambda c: T.clip_middle(c, 7), "abcdefghij") == "abc…hij"


@pytest.mark.parametrize("least", [500, 20_000])
def test_components_with_hubs(spark, monkeypatch, least):
    monkeypatch.setattr(graph, "HUB_EDGES", least)
    r = random.Random(1)
    edges = [(0, i) for i in range(1, 3000)] + [(r.randrange(5000, 6000), r.randrange(5000, 6000)) for _ in range(700)] + [(i, i + 1) for i in range(10000, 10050)] + [(20000 + i, 999999) for i in range(1500)] + [(7, 7)]
    top = {n: n for e in edges for n in e}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in top}


def test_overlap_links_connect_what_pairs_connect(spark):
    r = random.Random(2)
    rows_ = [(k, f) for k in range(60) for f in r.sample(range(30), r.randint(1, 6))] + [(k, f) for k in range(60, 90) for f in (1, 2, 3, 40)]
    df = spark.createDataFrame(rows_, "k long, f long")
    same = lambda edges: {x.node: x.component for x in graph.components(edges).collect()}
    links = relations.overlap_links(df, "k", "f", 3)
    assert same(links) == same(relations.overlap_pairs(df, "k", "f", 3)) and links.where("a >= 60 and b >= 60").count() <= 29


def test_quiet_rank_counts_over_days(spark):
    r = random.Random(5)
    times = {k: r.randrange(10) * 40_000 for k in range(80)}
    got = {x.k: x.later for x in summaries.quiet_rank(spark.createDataFrame(list(times.items()), "k long, t long"), "k", "t").collect()}
    assert got == {k: sum(o > t for o in times.values()) for k, t in times.items()}


@LONG_WAY
def test_layered_chart(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)

    def chart(layers, unreached, pairs):
        nodes = spark.createDataFrame([(n, d) for d, names in layers.items() for n in names], "node string, depth int")
        spots, elbows = geometry.layered(nodes, spark.createDataFrame([(n,) for n in unreached], "key string"), edges(spark, *pairs))
        return {r.key: r for r in spots.collect()}, {(r.src, r.dst): r for r in elbows.collect()}

    spots, elbows = chart({0: ["a"], 1: ["c", "b"]}, ["z"], [("a", "b"), ("a", "c"), ("c", "a")])
    assert {n: p.depth for n, p in spots.items()} == {"a": 0, "b": 1, "c": 1, "z": 2} and spots["z"].apart
    assert {k: e.back for k, e in elbows.items()} == {("a", "b"): False, ("a", "c"): False, ("c", "a"): True}
    assert spots["b"].x < spots["c"].x and [p.y for p in sorted(spots.values())] == [28.0, 124.0, 124.0, 316.0]
    wide, _ = chart({0: [f"n{i:02d}" for i in range(11)]}, [], [])
    assert len({p.y for p in wide.values()}) == 2 and not any(p.apart for p in wide.values())
    swept, _ = chart({0: ["a", "b"], 1: ["x", "y", "lone"]}, [], [("a", "y"), ("b", "x")])
    assert sorted(("y", "x", "lone"), key=lambda n: swept[n].x) == ["y", "x", "lone"]
    r = random.Random(2)
    layers = {d: [f"m{d}{i}" for i in range(r.randint(1, 5))] for d in range(4)}
    names = [n for x in layers.values() for n in x]
    pairs = [(r.choice(names), r.choice(names)) for _ in range(20)]
    got, _ = chart(layers, ["u1", "u2"], pairs)
    want = geometry._sweeps_here([(n, d, None) for d, x in (layers | {4: ["u1", "u2"]}).items() for n in x] + [(a, None, b) for a, b in set(pairs)])
    assert [n for n, _, _ in sorted(want, key=lambda x: x[1:])] == sorted(got, key=lambda n: (got[n].y, got[n].x))


def test_sweeps_by_blocks_of_layers_are_as_in_one_task_and_stage_less_than_a_round_a_layer(spark, monkeypatch):
    r = random.Random(4)
    layers = {d: [f"m{r.randrange(10**6)}_{d}{i}" for i in range(40 if d == 1 else 3)] for d in range(7)}
    names = [n for x in layers.values() for n in x]
    pairs = {(r.choice(names), r.choice(names)) for _ in range(150)}
    want = sorted(geometry._sweeps_here([(n, d, None) for d, x in layers.items() for n in x] + [(a, None, b) for a, b in pairs]))
    staged = []
    stage = geometry.stage_table
    monkeypatch.setattr(geometry, "stage_table", lambda s, df, name: staged.append(name) or stage(s, df, name))
    monkeypatch.setattr(graph, "ONE_TASK", 3)
    got = geometry.sweep_layers(spark.createDataFrame([(n, d) for d, x in layers.items() for n in x], "node string, depth int"), edges(spark, *pairs))
    assert sorted(map(tuple, got.collect())) == want
    assert staged.count("sweep") < geometry.SWEEPS * (len(layers) - 1) and "ranked" in staged


def test_boxes_stand_on_shelves():
    assert geometry.shelve([("a", 1000, 50), ("b", 300, 80), ("c", 40, 10), ("d", 1350, 5)]) == [("a", 0, 0), ("b", 1014, 0), ("c", 0, 94), ("d", 0, 118)]


def fold(pairs):
    """Groups as a fold over the pairs in order makes them, each by the pair that began it."""
    groups, first = {}, {}
    for pair in sorted(set(pairs)):
        homes = [first[k] for k in pair if k in first]
        home = min(homes, default=pair)
        groups.setdefault(home, set()).update(pair)
        for k in pair:
            first[k] = home
    return sorted((*home, k) for home, members in groups.items() for k in members)


@LONG_WAY
def test_greedy_groups_are_those_of_the_fold(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    r = random.Random(9)
    cases = [[], [("A", "D"), ("B", "D"), ("A", "C")], [("a", "b"), ("c", "d"), ("b", "c"), ("b", "d")], [("hub", f"n{i:02d}") for i in range(30)] + [("a", "n05"), ("n05", "z")]]
    for _ in range(2 if one_task == 0 else 10):
        n = r.randint(4, 16)
        cases.append([tuple(sorted(r.sample([f"k{i:02d}" for i in range(n)], 2))) for _ in range(r.randint(2, 2 * n))])
    for pairs in cases:
        assert sorted(map(tuple, graph.greedy_groups(spark.createDataFrame(pairs, "a string, b string")).collect())) == fold(pairs), pairs


def test_mentions_across_slices_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(relations, "SLICE", 7)
    monkeypatch.setattr(relations, "NAMES", 2)
    names = spark.createDataFrame([("App",), ("app",), ("tool",), ("absent",), ("",), ("ö",), ("longname",)], "root string")
    texts = spark.createDataFrame([("see the wrapped tool",), ("",), (None,), ("x longname",), ("schön",)], "text string")
    assert rows(relations.mentioned(names, texts)) == [("App",), ("app",), ("longname",), ("tool",), ("ö",)]
    assert rows(relations.mentioned(names.limit(0), texts)) == [] == rows(relations.mentioned(names, texts.limit(0)))


def test_weighted_overlap_is_that_of_all_pairs(spark):
    r = random.Random(11)
    bags = lambda k, n: {f"{k}{i}": {w: r.randint(1, 3) for w in r.sample(["common", "usual", *"abcdefgh"], r.randint(1, 5))} for i in range(n)}
    ours, theirs = bags("a", 14), bags("b", 17)
    frame = lambda bag, key: spark.createDataFrame([(k, w, n, len(k)) for k, words in bag.items() for w, n in words.items()], f"{key} string, f string, n long, {key}_size int")
    alike = lambda x, y: sum(min(x[w], y.get(w, 0)) for w in x)
    for least in (1, 2, 4):
        want = sorted((a, b) for a, x in ours.items() for b, y in theirs.items() if alike(x, y) >= least)
        assert rows(relations.weighted_overlap(frame(ours, "a"), frame(theirs, "b"), least)) == want
    some = rows(relations.weighted_overlap(frame(ours, "a"), frame(theirs, "b"), 2, F.expr("a_size < b_size")))
    assert some == sorted((a, b) for a, x in ours.items() for b, y in theirs.items() if alike(x, y) >= 2 and len(a) < len(b))


def test_rows_that_few_surpass_stay_and_most_others_go(spark):
    import random

    draw = random.Random(5)
    rows = [(i, i % 3 or None, draw.randrange(40), (draw.randrange(30), f"k{i:04d}")) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, g int, at int, rank struct<c: int, k: string>")
    kept = {r.id for r in relations.surpassed_by_few(df, ["g"], "at", "rank", 3).collect()}
    few = {i for i, g, at, rank in rows if sum(g == h and t >= at and s < rank for _, h, t, s in rows) < 3}
    assert few <= kept and len(kept) <= 200


def test_lines_are_digests_before_they_are_shuffled(spark, tmp_path):
    rows = [(1, "  same line \nsame line\nabc\nother"), (1, "other"), (2, "same line"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = driver._digests(spark, str(tmp_path))
    want = sorted((d, hashlib.md5(x.encode()).digest()) for d, x in ((1, "same line"), (1, "other"), (2, "same line")))
    assert sorted((r.doc_id, bytes(r.line)) for r in found.collect()) == want


def test_overlap_pairs_keeps_only_features_that_several_keys_have(spark, monkeypatch):
    staged = {}
    monkeypatch.setattr(relations, "stage_table", lambda s, df, name: staged.setdefault(name, df))
    rows = [(k, f) for k in range(3) for f in (1, 2, 3, 100 + k, 200 + k)]
    found = relations.overlap_pairs(spark.createDataFrame(rows, "k int, f int"), "k", "f", 3)
    assert sorted(map(tuple, found.collect())) == [(0, 1, 3), (0, 2, 3), (1, 2, 3)]
    assert sorted(r.f for r in staged["often"].collect()) == [1, 2, 3] and staged["ranked"].count() == 9


def test_renames_of_one_name_are_not_each_compared_with_all_later_ones(spark, monkeypatch):
    seen = []
    chase = graph.pointer_chase
    monkeypatch.setattr(graph, "pointer_chase", lambda links, *names: seen.append(links._jdf.queryExecution().optimizedPlan().toString().lower()) or chase(links, *names))
    events = [("a", "hub"), ("hub", "b"), ("c", "hub"), ("d", "hub"), ("hub", "e"), ("b", "hub")]
    log = spark.createDataFrame([(i, *e) for i, e in enumerate(events)], "ord long, old string, new string")
    assert dict(rows(graph.rename_chain(log))) == renamed(events)
    assert "window" in seen[0] and "unboundedfollowing" not in seen[0]


def test_pairs_are_counted_by_more_tasks_where_rows_are_more(spark, monkeypatch):
    given = [(g, i) for g in range(300) for i in (g % 7, g % 5 + 10, g % 3 + 20, None)] + [(None, 1), (0, 0), (0, 0)] + [(999, i) for i in range(26)]
    df = spark.createDataFrame(given, "g long, i long")
    want = rows(relations.co_occurrence(df, "g", "i"))
    assert sum(n for *_, n in want) == 900 and not any(b > 25 for _, b, _ in want)
    monkeypatch.setattr(relations, "PAIRED_EACH", 50)
    monkeypatch.setattr(relations, "COUNTED_EACH", 100)
    many = relations.co_occurrence(df, "g", "i")
    assert rows(many) == want and many.rdd.getNumPartitions() == -(-len(given) // 100)


def test_staged_features_are_not_staged_again(spark, monkeypatch):
    df = spark.createDataFrame([(k, f) for k in range(4) for f in range(k, k + 4)] + [(None, 1), (1, None)], "k long, f long")
    want = rows(relations.overlap_pairs(df, "k", "f", 3))
    names, stage = [], relations.stage_table
    monkeypatch.setattr(relations, "stage_table", lambda s, d, name: names.append(name) or stage(s, d, name))
    assert rows(relations.overlap_pairs(df, "k", "f", 3, staged=True)) == want == [(0, 1, 3), (1, 2, 3), (2, 3, 3)] and "features" not in names


@pytest.mark.parametrize(("paired", "least"), [(0, 3), (2, 1), (16, 3)])
def test_overlap_links_grow_with_rows_where_many_share_many(spark, monkeypatch, paired, least):
    monkeypatch.setattr(relations, "PAIRED_KEYS", paired)
    r = random.Random(3)
    near = [(k, f) for k in range(60) for f in (1, 2, 3, 4, 5, 100 + k // 2, 200 + k % 20)]  # near copies: each has features of its own besides
    apart = [(k, f) for k in range(100, 160) for f in (10, *r.sample(range(300, 340), r.randint(2, 6)))]  # one feature in common, by which most are not linked
    scattered = [(k, f) for k in range(200, 230) for f in (20, 21, 22, *r.sample(range(400, 404), 2))] + [(None, 1), (1, None)]
    df = spark.createDataFrame(near + apart + scattered, "k long, f long")
    same = lambda edges: {x.node: x.component for x in graph.components(edges).collect()}
    links, pairs = relations.overlap_links(df, "k", "f", least), relations.overlap_pairs(df, "k", "f", least).select("a", "b")
    assert same(links) == same(pairs) and links.join(pairs, ["a", "b"], "left_anti").count() == 0
    assert links.where("a < 60").count() <= 60 * 7  # of near copies, which are 1,770 pairs


def test_links_by_the_next_features_need_no_pairs(spark, monkeypatch):
    staged, stage = [], relations.stage_table
    monkeypatch.setattr(relations, "stage_table", lambda s, d, name: staged.append((name, out := stage(s, d, name))) or out)
    # 40 keys share three features; between them in the order of rarity stand others, so that no three that any two share stand together
    rows_ = [(k, f) for k in range(40) for f in (1, 2, 3)]
    rows_ += [(500 + i, 1) for i in range(10)] + [(600 + i, 2) for i in range(30)] + [(700 + i, 3) for i in range(60)]
    rows_ += [(k, 1000 + k) for k in range(40)] + [(800 + 100 * k + i, 1000 + k) for k in range(40) for i in range(55)]
    rows_ += [(k, 2000 + k) for k in range(40)] + [(5000 + 100 * k + i, 2000 + k) for k in range(40) for i in range(80)]
    links = relations.overlap_links(spark.createDataFrame(rows_, "k long, f long"), "k", "f", 3, staged=True)
    assert {name: t.count() for name, t in staged}["sure"] == 0
    assert rows(links) == sorted(((0, k) for k in range(1, 40)), key=str)


def test_lineage_and_shared_features_of_staged_rows(spark):
    members = spark.createDataFrame([("g", 1), ("g", 2), ("g", 3)], "g string, k long")
    features = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (3, "c"), (3, "d"), (4, "a")], "k long, f string")
    for operator in (summaries.lineage, summaries.shared_features):
        given = (members, features, "g", "k", "f")
        assert rows(operator(*given, staged=True)) == rows(operator(*given)) != []


def test_lines_of_documents_are_shuffled_once_for_lineage(spark, tmp_path, monkeypatch):
    docs = [(d, "\n".join(f"line {x}" for x in (d // 4, 1000 + d // 4, 2000 + d // 4, 3000 + d))) for d in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    names, stage = [], relations.stage_table
    monkeypatch.setattr(relations, "stage_table", lambda s, d, name: names.append(name) or stage(s, d, name))
    got = driver.lineage(spark, str(tmp_path))
    assert "features" not in names and sorted(r.component for r in got.collect()) == [d // 4 * 4 for d in range(40)]
