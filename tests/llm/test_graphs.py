from __future__ import annotations

import random
import re
from dataclasses import replace

import numpy as np
import pytest
from plan_text import exchanges, executed_plan
from pyspark.sql import functions as F

from scorecraft.llm import ann, chat, jaccard_join, mixing, revisits, url_trust
from scorecraft.llm.components import components
from scorecraft.llm.store import table

from .conftest import SF

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_components(rows, rule):
    sets = []
    for _, text in rows:
        words = WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))
        k = rule.words
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            same = rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]
            linked = common and 100 * common >= rule.percent * len(sets[i] | sets[j])
            if (linked and None not in (rows[i][0], rows[j][0])) or same:
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((str(d), len(sets[i]), str(least[find(i)] if d is not None else None)) for i, (d, _) in enumerate(rows))


def shown(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


@pytest.mark.parametrize("rule", [jaccard_join.Rule(), jaccard_join.Rule(4, 85), jaccard_join.Rule(2, 50)])
def test_join_equals_brute_force(spark, rule):
    rng = np.random.default_rng(6)
    rows, base = [], rng.integers(0, 400, (8, 60))
    for i in range(160):  # families of edited copies, and a passage that many share
        words = base[i % 8].copy()
        words[rng.random(60) < rng.choice([0, 0.01, 0.03, 0.08, 0.3])] = 999 + i
        passage = list(range(2000, 2020)) if i % 3 == 0 else []
        rows.append((int(rng.integers(0, 10_000)) * 200 + i, " ".join(f"w{w}" for w in [*words, *passage])))
    rows += [(5, None), (6, ""), (7, "a b"), (8, "A  b"), (9, "c")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    assert shown(jaccard_join.join(documents, rule)) == brute_components(rows, rule)


def test_join_of_odd_documents(spark, odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    rule = jaccard_join.Rule()
    assert shown(jaccard_join.join(odd_documents, rule)) == brute_components(rows, rule)
    assert jaccard_join.join(no_documents).count() == 0
    kept = jaccard_join.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == [
        "1", "1", "20", "21", "22", "23", "3", "4", "5", "6", "7", "8", "None"
    ]


def test_jaccard_group_with_members_just_below_the_threshold(spark):
    draw = random.Random(3)
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(150):
        words = list(base)
        for _ in range(draw.randint(0, 9)):
            words[draw.randrange(150)] = f"x{draw.randrange(10**6)}"
        rows.append((3 * i, " ".join(words)))
    for i in range(40):  # a passage of the group in texts of their own
        own = [f"y{draw.randrange(400)}" for _ in range(draw.randint(0, 30))]
        rows.append((1000 + i, " ".join(own + base[:60])))
    rule = jaccard_join.Rule(4, 85)
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert shown(jaccard_join.join(documents, rule)) == brute_components(rows, rule)


def test_jaccard_blocks_cut_a_group_without_losing_links(spark, monkeypatch):
    draw = random.Random(5)
    rows = []
    for i in range(40):
        words = [f"w{j}" for j in range(60)]
        for _ in range(draw.randint(0, 3)):
            words[draw.randrange(60)] = f"x{draw.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rule = jaccard_join.Rule(4, 80)
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    placed = spark.createDataFrame([(i, i, 0) for i in range(40)], "class long, component long, grp long")
    asks = placed.select("class", "grp")
    monkeypatch.setattr(jaccard_join, "BLOCK", 300)
    links = {(r["a"], r["b"]) for r in jaccard_join.opened(asks, placed, documents, rule).collect()}
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(57)} for i, t in rows}
    assert links == {
        (a, b)
        for a in sets
        for b in sets
        if a != b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    }


def test_jaccard_links_all_texts_of_an_id(spark):
    one, two = "a b c d e f g h", "p q r s t u v w"
    rows = [(5, one), (5, two), (1, one), (7, two), (7, "z " + two), (8, "z " + two + " y")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard_join.join(documents, jaccard_join.Rule(4, 80)).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(1, 1), (5, 1), (7, 1), (8, 1)}


def test_jaccard_entries_are_shuffled_once(spark):
    rows = [(i, i % 3, 0, 7) for i in range(6)]  # a token of three groups
    rows += [(i, 1, 1, 8) for i in range(6)]  # of one group, on many rows
    rows += [(i, i, 2, 100 + i) for i in range(6)]  # each of its own
    rows += [(1, 4, 3, -9), (2, 5, 3, -9)]
    entries = spark.createDataFrame(rows, "row long, grp long, pos int, token long").repartition(3)
    found = jaccard_join.shared_tokens(entries)
    assert sorted(tuple(r) for r in found.collect()) == sorted(r for r in rows if r[3] in (7, -9))
    assert exchanges(executed_plan(found), "hashpartitioning(token") == 1


def test_jaccard_pairs_shuffle_texts_once(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"{text} {i % 4}") for i in range(8)] * 2 + [(0, "another text"), (9, "far")]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    pairs = spark.createDataFrame([(i, j) for i in range(8) for j in range(i)] + [(9, 0)], "a long, b long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = jaccard_join.near(pairs, documents, jaccard_join.Rule(4, 80))
        plan = executed_plan(found)
        # the texts by their ids once for both ends, the pairs by either end
        assert exchanges(plan, "hashpartitioning(doc_id") == 1
        assert exchanges(plan, "hashpartitioning(a") == exchanges(plan, "hashpartitioning(b") == 1
        links = {(r["a"], r["b"]) for r in found.collect() if r["linked"]}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert links == {(i, j) for i in range(8) for j in range(i)}


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(500 + i, 501 + i) for i in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert got == least


def test_neighbours_against_brute_force(spark):
    for folder, least in ((SF, 0.9), ("/root/testdata/sf0.1", 0.9)):
        rows = [(r.vec_id, r.embedding) for r in table(spark, folder, "embeddings").collect()]
        ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
        found = {}
        for r in ann.op1_neighbours(spark, folder).collect():
            found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        hits = 0
        for q in np.flatnonzero(ids % 100 == 0):
            distance = np.sqrt(((x - x[q]) ** 2).sum(1))
            order = [i for i in np.lexsort((ids, distance)) if i != q][:10]
            mine = sorted(found[ids[q]])
            assert [m[0] for m in mine] == list(range(1, 11))
            where = {int(v): i for i, v in enumerate(ids)}
            assert all(abs(distance[where[m[1]]] - m[2]) < 1e-12 for m in mine)
            hits += len({int(ids[i]) for i in order} & {m[1] for m in mine})
        assert hits >= least * 10 * len(found)


@pytest.mark.parametrize("rows", [4096, 51_282, 200_000, 1 << 19, 1 << 23])
def test_probes_find_the_neighbours_at_every_size(rows):
    plan = ann.Plan.for_rows(rows, 64)
    x = ann.unit(np.random.default_rng(8).normal(size=(6000, 64)), plan.width)
    found = np.zeros((40, len(x)), bool)
    for number in range(plan.tables):
        keys = ann.bucket_keys(x, plan, number)
        for i, probes in enumerate(ann.probe_keys(x[:40], plan, number)):
            found[i] |= np.isin(keys, probes)
    nearest = np.argsort(-(x[:40] @ x.T), 1)[:, 1:11]
    assert np.take_along_axis(found, nearest, 1).mean() >= 0.95


def test_a_fitted_lookup_meets_a_smaller_share_of_a_larger_table():
    met, rng = [], np.random.default_rng(11)
    for rows in (2000, 16_000):
        x = ann.unit(rng.normal(size=(rows, 64)), 64)
        nearest = np.argsort(-(x[:40] @ x.T), 1)[:, 1:11]
        far = np.take_along_axis(x[:40] @ x.T, nearest[:, -1:], 1)[:, 0]
        plan = replace(ann.Plan.of_keys(rows, 64), hits=12.0)
        assert ann.KEYS * rows <= plan.keys <= 2 * ann.KEYS * rows
        keys, before = ann.likely_keys(x[:40], np.full(40, np.median(far)), plan)
        buckets = ann.table_keys(x, plan)
        found = np.stack([np.isin(buckets, k[b < plan.hits]).any(1) for k, b in zip(keys, before, strict=True)])
        assert np.take_along_axis(found, nearest, 1).mean() >= 0.93
        met.append(found.mean())
    assert met[1] < 0.6 * met[0]
    # near neighbours need few keys, so that a dense group is not met in every table
    near = ann.likely_keys(x[:40], np.full(40, 0.98), plan)[1] < plan.hits
    assert near.sum() < 0.1 * (before < plan.hits).sum()


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, [0.0, 0.0])]
    rows += [(6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (100, [0.0, 2.0]), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "vec_id long, embedding array<float>, score double, query long")
    got = ann.search(vectors, F.col("vec_id") % 100 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [
        (0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 100), (100, 1, 3), (100, 2, 0), (100, 3, 1), (100, 4, 2)
    ]
    assert ann.search(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_neighbours_of_an_id_on_many_rows(spark):
    rng = np.random.default_rng(9)
    same, others = [1.0, 0.0, 0.0, 0.0], rng.normal(size=(30, 4)).tolist()
    rows = [(100, same)] * 12 + [(i, same) for i in (201, 202, 203)] + [(202, same)] * 14
    rows += [(300 + i, x) for i, x in enumerate(others)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(vectors, F.col("vec_id").isin(100, 202)).collect()
    found = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (100, 202)}
    assert found == {100: [201, *[202] * 9], 202: [100] * 10}
    few = ann.search(vectors.where("vec_id < 203"), F.col("vec_id") == 202).collect()
    assert [r.vec_id for r in sorted(few, key=lambda r: r["rank"])] == [100] * 10
    lone = spark.createDataFrame([(100, same)] * 12 + [(i, same) for i in (201, 202, 203)], vectors.schema)
    three = ann.search(lone.union(vectors.where("vec_id > 299")), F.col("vec_id") == 100).collect()
    assert [r.vec_id for r in sorted(three, key=lambda r: r["rank"])][:3] == [201, 202, 203] and len(three) == 10


def test_neighbours_by_scan_when_buckets_are_empty(spark):
    vectors = table(spark, SF, "embeddings")
    thin = ann.Plan(64, 1, 2, 1)
    got = ann.search(vectors, F.col("vec_id") % 100 == 0, plan=thin)
    full = ann.op1_neighbours(spark, SF)
    assert got.groupBy("query_id").count().where("count <> 10").count() == 0
    assert got.join(full, ["query_id", "vec_id"], "left_semi").count() >= 45


def test_chat_reads_back(spark):
    texts = ["</s>[INST] ok [/INST]", "\\[INST]\\", "[ROLE]x[/ROLE] [ANS] <s>", None, "", "a\nb " * 30_000]
    roles = ["user", "assistant", "tool", None, "[ROLE]", "system"]
    rows = [(c, t, r, x, "z") for c in (1, None) for t in (None, 0, 0) for r in roles for x in texts]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_conversations(given)
    order = sorted(rows[: len(rows) // 2], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    for r in out.select(chat.read_turns(F.col("formatted")).alias("turns"), "valid_order").collect():
        assert [tuple(t) for t in r.turns] == [(x[2] or "", x[3] or "") for x in order]
        assert not r.valid_order
    assert chat.digest(chat.format_conversations(given.limit(0))).count() == 0
    turns = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "assistant", "a")]
    state = chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert {r.conv_id: (r.valid_order, r.complete) for r in state.collect()} == {1: (True, True), 2: (False, False)}


def test_mix_holds_targets_and_limits(spark, odd_documents, no_documents):
    rows = mixing.mix(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert all(r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size for r in rows)
    assert mixing.mix(no_documents).count() == 0
    documents = table(spark, SF, "documents")
    mixed = mixing.mix(documents).cache()
    biggest = mixed.agg(F.max("size")).first()[0]
    for r in mixed.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) <= biggest
    assert sorted(map(tuple, mixing.mix(documents.repartition(7)).collect())) == sorted(map(tuple, mixed.collect()))
    repeated = mixing.repeat_taken(documents)
    assert repeated.columns == documents.columns
    assert repeated.count() == mixed.where("taken > 0").agg(F.sum(F.expr("taken div size"))).first()[0]
    assert mixing.repeat_taken(no_documents).count() == 0


def test_rows_of_one_id_are_repeated_by_their_own_count(spark):
    kind = "doc_id long, source string, text string, row long, copies long"
    rows = [(1, "a", "x y"), (1, "a", "x z"), (1, "b", "one two three"), (2, "c", "z " * 40), (2, "c", "y")]
    rows += [(None, "abc"[i % 3], f"w{i} " * (1 + i % 4)) for i in range(12)] + [(None, "a", "same")] * 3
    documents = spark.createDataFrame([(*r, 7, 7) for r in rows], kind)
    want = {}
    for r in mixing.mix(documents).collect():
        want[r.doc_id, r.size] = want.get((r.doc_id, r.size), 0) + r.taken
    got, often = {}, {}
    for r in mixing.repeat_taken(documents).collect():
        size = len(r.text.split())
        got[r.doc_id, size] = got.get((r.doc_id, size), 0) + size
        often[r] = often.get(r, 0) + 1
        assert (r.row, r.copies) == (7, 7)
    assert got == {k: v for k, v in want.items() if v}
    assert all(n <= 3 * rows.count((r.doc_id, r.source, r.text)) for r, n in often.items())


def test_a_border_parts_equal_rows(spark):
    """Rows of one id and text that the mix takes unequally often: the copies add up all the same."""
    rows = [(5, "a", "same text")] * 40 + [(i, "b", f"w{i} x y") for i in range(100, 130)]
    rows += [(i, None, f"v{i}") for i in range(200, 220)] + [(6, "b", None), (7, "a", "")]
    documents = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed = mixing.mix(documents)
    want = {(r.doc_id, r.size): r.n for r in mixed.where("taken > 0").groupBy("doc_id", "size").agg(F.sum(F.expr("taken div size")).alias("n")).collect()}
    got = {}
    for r in mixing.repeat_taken(documents).collect():
        key = r.doc_id, len(r.text.split())
        got[key] = got.get(key, 0) + 1
    assert got == want
    borders = {r.source: r for r in mixing._borders(mixing._taken(documents, mixing.WEIGHTS, 3)).collect()}
    assert borders["a"].tied == 40 and 0 < borders["a"].extra < 40


def test_rows_of_one_id_spread_over_buckets(spark):
    """A third of the rows without an id: no bucket of the queue holds many of them."""
    documents = spark.range(6000).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"),
        F.lit("a").alias("source"),
        F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"),
    )
    h = mixing._own()[1]
    largest = documents.select(F.shiftright(h, mixing.HASH_BITS - 5).alias("b")).groupBy("b").count()
    assert largest.agg(F.max("count")).first()[0] < 2 * 6000 / 32


def test_buckets_do_not_change_the_mix(spark, monkeypatch):
    documents = table(spark, SF, "documents")
    whole = sorted(map(tuple, mixing.mix(documents).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    assert sorted(map(tuple, mixing.mix(documents).collect())) == whole


def test_targets_stop_at_three_times_the_size(spark):
    sources = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 10), (None, 80)], "source string, source_size long")
    rows = {r.source: r.target for r in mixing.with_targets(sources).collect()}
    assert rows["a"] == 30 and rows["c"] == 30 and rows[None] == 240
    assert abs(sum(rows.values()) - 1100) < 1e-6


def test_trust_and_distrust_walk_the_links(spark):
    link = '<a href="{}">x</a>'
    rows = [
        (1, "http://good.com/a", link.format("https://friend.org/x")),
        (2, "http://bad.net/es/a", ""),
        (3, "https://FAN.org/a", link.format("http://bad.net/y") * 3),
        (4, "http://friend.org", None),
        (5, None, link.format("http://bad.net/")),
        (6, "no scheme", ""),
        (6, "no scheme", ""),
        (7, "a://x.example.com/en/b?c", ""),
        (8, "a://www.example.com/en/", ""),
        (9, "http://evilcom/", ""),
    ]
    pages = spark.createDataFrame([(*r, "z", "z") for r in rows], "page_id long, url string, html string, host string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_trust.judge(pages).collect()}
    assert got == {
        1: ("good.com", "/a", "com/", "allow"),
        2: ("bad.net", "/es/a", "net/es/", "block"),
        3: ("fan.org", "/a", None, "block"),
        4: ("friend.org", "", None, "allow"),
        5: ("", "", None, "allow"),
        6: ("", "", None, "allow"),
        7: ("x.example.com", "/en/b", "example.com/en/", "block"),
        8: ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        9: ("evilcom", "/", None, "allow"),
    }
    assert url_trust.judge(pages.limit(0)).count() == 0


def test_links_to_other_hosts_begin_with_their_host(spark):
    links = ["//Other.org/x", "http://plain.org/x", "/go?u=http://query.org/x", "go//x", "#a://b.org", "view+x://v.org"]
    html = "".join(f'<a href="{x}">x</a>' for x in links)
    pages = spark.createDataFrame([("a.org", html)], "host string, html string")
    assert {r.target for r in url_trust.host_edges(pages).collect()} == {"other.org", "plain.org", "v.org"}


def test_trust_settles_at_the_fixed_point(spark):
    chain = [f"h{i}" for i in range(14)]
    edges = [(a, b, 1.0) for a, b in zip(chain, chain[1:])]
    edges += [("x", "y", 2.0), ("y", "x", 1.0), ("h0", "gone", 1.0)]
    seeds = [(h, 1, 0, 0) for h in chain[:-1]] + [(chain[-1], 100, 0, 100), ("x", 100, 4, 9), ("y", 100, 0, 9)]
    hosts = {s[0]: i for i, s in enumerate(seeds)}
    forward, backward = np.zeros((2, len(hosts), len(hosts)))
    for a, b, w in edges:
        if b in hosts:
            forward[hosts[b], hosts[a]] = w / sum(e[2] for e in edges if e[0] == a)
            backward[hosts[a], hosts[b]] = w / sum(e[2] for e in edges if e[1] == b)
    eye = np.eye(len(hosts))
    trust = np.linalg.solve(eye - 0.85 * forward, 0.15 * np.array([s[2] for s in seeds]))
    distrust = np.linalg.solve(eye - 0.85 * backward, 0.15 * np.array([s[3] for s in seeds]))
    got = url_trust.propagate(
        spark.createDataFrame(seeds, "host string, pages long, allowed long, blocked long"),
        spark.createDataFrame(edges, "source string, target string, weight double"),
        tolerance=0.01,
    ).collect()
    assert {r.host for r in got} == set(hosts)
    for r in got:
        assert abs(r.trust - trust[hosts[r.host]]) <= 0.01 * 0.15
        assert abs(r.distrust - distrust[hosts[r.host]]) <= 0.01 * 0.15
        assert r.host not in "xy" or r.distrust > 0.5 * 0.15 * r.pages


def test_revisits_by_time_and_validator(spark, monkeypatch):
    h = lambda **x: [(k.replace("_", "-"), v) for k, v in x.items()]
    rows = [
        (1, "response", "http://a.com/x/", 10, 200, '"1"', None, h(ETag='"1"', Server="s", Date="d1"), "p1"),
        (2, "revisit", "https://www.A.com/x#f", 20, 304, 'W/"1"', None, h(date="d2", Content_Length="0"), None),
        (3, "revisit", "http://a.com/x", 10, 304, '"1"', None, [], None),
        (4, "response", "http://a.com/x?utm_source=q", 30, 200, '"2"', "m", None, "p2"),
        (5, "revisit", "http://a.com/x", 40, 304, '"1"', None, None, None),
        (6, "revisit", "http://a.com/x", 41, 304, None, "m", None, None),
        (7, "revisit", "http://a.com/x", 42, 304, None, None, None, None),
        (8, "revisit", None, 42, 304, '"1"', None, None, None),
        (9, "revisit", "http://a.com/x", None, 304, '"1"', None, None, None),
    ]
    kind = "record_id long, kind string, url string, captured_at long, status int, etag string, last_modified string, headers array<struct<name:string,value:string>>, payload_digest string, slot string"
    records = spark.createDataFrame([(*r, "z") for r in rows], kind)
    want = {
        2: (1, "resolved", "p1"),
        3: (None, "no_response", None),
        5: (4, "mismatch", None),
        6: (4, "resolved", "p2"),
        7: (4, "no_validator", None),
        8: (None, "no_response", None),
        9: (None, "no_response", None),
    }
    for slot_rows in (20_000, 1):
        monkeypatch.setattr(revisits, "SLOT_ROWS", slot_rows)
        out = revisits.resolve(records).collect()
        assert {r.record_id: (r.refers_to, r.outcome, r.payload_digest) for r in out} == want
    merged = {r.record_id: r.headers for r in out}[2]
    assert [tuple(x) for x in merged] == [("date", "d2"), ("etag", '"1"'), ("server", "s")]
    assert revisits.resolve(records.limit(0)).count() == 0
