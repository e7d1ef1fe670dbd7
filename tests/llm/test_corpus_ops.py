"""Operators across documents: substring dedup, near duplicates, mixing, and the pipeline."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from llm_rows import awkward_rows, pairs
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import mixing, neardup, queries, substring
from tidelog.llm import text as tx

SF = "/root/testdata/sf0.001"


# Substring dedup


def naive_removal(docs, window):
    seen = collections.Counter()
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (x or "").encode()) for _, x in docs]
    for w in split:
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for (k, _), w in zip(docs, split):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((k, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found_removal(df, **options):
    return sorted(map(tuple, substring.digests(df, **options).collect()), key=repr)


@pytest.mark.parametrize("window,anchor,letters", [(6, 2, 3), (5, 2, 4), (35, 8, 2), (7, 3, 30), (4, 1, 1)])
def test_substring_random(spark, window, anchor, letters):
    rng = random.Random(letters)
    docs = [(i, " ".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCD"[:letters]) for _ in range(rng.randrange(80)))) for i in range(40)]
    for i in range(40, 60):
        a, b = rng.choice(docs)[1].split(), rng.choice(docs)[1].split()
        docs.append((i, "\n ".join(a[: rng.randrange(len(a) + 1)] + b[rng.randrange(len(b) + 1) :])))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert found_removal(df, window=window, anchor=anchor) == naive_removal(docs, window)


def rebuilt(df, window=35, **options):
    """Documents put together again from their factors and the words that no factor covers."""
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode()) for r in df.select("text").collect()]
    got = substring.factors(df, ["doc_id", "text"], window=window, **options).collect()
    words = {(r.place.k1, r.place.k2): re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode()) for r in got}
    whole = []
    for r in got:
        own, out, at = words[r.place.k1, r.place.k2], [], 0
        for f in r.factors:
            assert f.words >= window and f.first + f.words <= r.n_words and at - f.first < window
            out += own[at : f.first]  # literals
            there = words[f.ref1, f.ref2][f.ref_first : f.ref_first + f.words]
            out += there[max(0, at - f.first) :]
            at = f.first + f.words
        out += own[at:]
        whole.append(out)
        assert len(own) == r.n_words
        # Greedy: where one factor follows another within a window's words, its reference doesn't go on.
        for f, g in zip(r.factors, r.factors[1:]):
            assert (g.ref1, g.ref2, g.ref_first - f.ref_first) != (f.ref1, f.ref2, g.first - f.first) or g.first > f.first + f.words - window + 1
        for f in r.factors:  # a reference is another place, but for rows that are copies of each other
            if (f.ref1, f.ref2, f.ref_first) == (r.place.k1, r.place.k2, f.first):
                assert sum(x.place == r.place for x in got) > 1
    assert sorted(whole) == sorted(split)
    return got


def test_factors_rebuild_documents(spark, awkward, documents):
    for df in (awkward, documents):
        got = rebuilt(df)
        assert any(f.words > 35 for r in got for f in r.factors)
    rng = random.Random(12)
    docs = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(60)))) for i in range(30)] + [(7, "a " * 50)] * 2
    rebuilt(spark.createDataFrame(docs, "doc_id bigint, text string"), window=5, anchor=2)


def test_a_copied_text_is_one_factor(spark):
    text = " ".join(f"w{i}" for i in range(500))
    df = spark.createDataFrame([(1, text), (2, "before it " + text + " after it"), (3, "x " * 3)], "doc_id bigint, text string")
    got = {r.doc_id: [(f.first, f.words, f.ref_first) for f in r.factors] for r in substring.factors(df).collect()}
    assert got == {1: [(0, 500, 2)], 2: [(2, 500, 0)], 3: []}


def test_substring_edges(spark, awkward, empty, documents):
    for df in (awkward, documents):
        assert found_removal(df) == naive_removal(pairs(df), 35)
    assert substring.digests(empty).count() == 0 and substring.strip(empty).columns == empty.columns
    stripped = substring.strip(awkward)
    assert stripped.schema.names == awkward.schema.names
    got = sorted(((r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in stripped.collect()), key=repr)
    assert got == sorted(((k, h) for k, _, _, h in naive_removal(pairs(awkward), 35)), key=repr)
    same = {r.doc_id: r for r in awkward.where("doc_id in (1, 2, 9, 15)").collect()}
    assert all(same[r.doc_id] == r for r in stripped.where("doc_id in (1, 2, 9, 15)").collect())
    for r in substring.spans(awkward).collect():
        ends = [(s.first, s.first + s.words) for s in r.spans]
        assert all(b - a >= 35 for a, b in ends) and all(x[1] < y[0] for x, y in zip(ends, ends[1:])) and all(b <= r.n_words for _, b in ends)


def test_substring_dedup_equals_its_sql(spark):
    from oracle import assert_same, connection

    for sf in (SF, "/root/testdata/sf0.01"):
        assert_same(connection(sf), queries.QUERIES["op7_substring_dedup"](spark, sf), queries.ORACLES["op7_substring_dedup"])


def test_a_hot_passage(spark):
    """One passage in all of many documents, with different surroundings."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(60))
    docs = [(i, " ".join(word() for _ in range(rng.randrange(20))) + " " + passage + " " + " ".join(word() for _ in range(rng.randrange(20)))) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(8)
    assert found_removal(df) == naive_removal(docs, 35)


# Near duplicates


def probability_jaccard(x, y):
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())


def test_probminhash_estimates_probability_jaccard():
    rng, off = random.Random(1), []
    for _ in range(30):
        x = {rng.getrandbits(60): rng.choice([1, 1, 2, 5]) for _ in range(60)}
        y = dict(x)
        for k in rng.sample(list(y), rng.randrange(50)):
            del y[k]
        y.update({rng.getrandbits(60): rng.choice([1, 2, 3]) for _ in range(rng.randrange(30))})
        h, w = np.array([*x, *y], np.uint64), np.array([*x.values(), *y.values()], float)
        held = neardup.signatures(np.repeat([0, 1], [len(x), len(y)]), h, w, 2, 1024)
        off.append((held[0] == held[1]).mean() - probability_jaccard(x, y))
        scaled = neardup.signatures(np.repeat([0, 1], [len(x), len(x)]), np.array([*x, *x], np.uint64), np.array([*x.values(), *[3 * v for v in x.values()]], float), 2, 64)
        assert (scaled[0] == scaled[1]).mean() == 1
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.04


def shingle_counts(x):
    words = re.findall(r"[^\s!-/:-@\[-`{-~]+", "".join(c.lower() if c.isascii() else c for c in x or ""))
    if len(words) < 3:
        return collections.Counter([tuple(words)] if words else [])
    return collections.Counter(zip(words, words[1:], words[2:]))


def test_shingles(documents):
    for _, x in pairs(documents)[:40] + awkward_rows()[:9]:
        data = np.frombuffer((x or "").encode(), np.uint8)
        _, h, w = neardup.shingles(data, np.array([0, len(data)]))
        assert sorted(w.tolist()) == sorted(map(float, shingle_counts(x).values())) and len(set(h.tolist())) == len(h)


def naive_classes(docs, threshold):
    """Links between different texts, by exact similarity, and their components."""
    texts = sorted({x or "" for _, x in docs})
    own = [shingle_counts(x) for x in texts]
    found = {}
    for i in range(len(texts)):
        for j in range(i):
            if own[i] and own[j] and len(own[i].keys() & own[j].keys()) > 0:
                found[i, j] = probability_jaccard(own[i], own[j])
    return texts, found


def test_classes_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(4))
    docs = []
    for g in range(25):
        base = [word() for _ in range(rng.choice([30, 120, 300]))]
        docs.append((len(docs), " ".join(base)))
        for _ in range(rng.randrange(6)):
            other = list(base)
            for at in rng.sample(range(len(other)), int(len(other) * rng.choice([0, 0.02, 0.05, 0.4]))):
                other[at] = word()
            docs.append((len(docs), " ".join(other)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: r for r in neardup.classify(df).collect()}
    texts, similar = naive_classes(docs, neardup.THRESHOLD)
    ids = {x: min(k for k, t in docs if t == x) for x in texts}
    for (i, j), s in similar.items():
        if s > neardup.THRESHOLD + 0.15:
            assert got[ids[texts[i]]].class_id == got[ids[texts[j]]].class_id
    grouped = collections.defaultdict(set)
    for k, x in docs:
        grouped[got[k].class_id].add(x)
        assert got[k].text_id == ids[x] and got[k].n_copies == sum(t == x for _, t in docs)
    sure = {x: sum(s > neardup.THRESHOLD + 0.15 for p, s in similar.items() if texts.index(x) in p) for x in texts}
    most = {x: sum(s > neardup.THRESHOLD - 0.15 for p, s in similar.items() if texts.index(x) in p) for x in texts}
    for k, x in docs:
        assert sure[x] <= got[k].n_links <= most[x]
    for c, members in grouped.items():  # nothing else is joined
        for x in members:
            assert len(members) == 1 or most[x]
    kept = neardup.keep_one(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted(grouped)


def signed(docs):
    """Each text's 8-bit signature and its bands."""
    marks, bands = [], []
    for _, x in docs:
        data = np.frombuffer(x.encode(), np.uint8)
        held = neardup.signatures(*neardup.shingles(data, np.array([0, len(data)])), 1)
        marks.append(neardup.small(held)[0])
        bands.append(neardup.band_hashes(held)[0])
    return np.stack(marks), np.stack(bands)


@pytest.mark.parametrize("block,rounds,changes", [(7, 3, [1]), (7, 1, [1, 8, 20, 40]), (256, 3, [1, 8, 20, 40]), (5, 3, [25, 50])])
def test_links_of_a_group_against_all_signatures(spark, monkeypatch, block, rounds, changes):
    """One group of different near copies, near each other or not: a link that the signatures have is counted if it shares
    a band, and may be if it follows from others."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "ROUNDS", rounds)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    docs = []
    for i in range(90):
        other = list(base)
        for at in rng.sample(range(400), rng.choice(changes)):
            other[at] = f"x{i}y{at}"
        docs.append((i, " ".join(other)))
    docs += [(100 + i, docs[0][1]) for i in range(50)]
    marks, bands = signed(docs[:90])
    linked = (marks[:, None] != marks[None]).sum(2) <= neardup.reach(neardup.THRESHOLD)
    met = linked & (bands[:, None] == bands[None]).any(2)
    got = {r.doc_id: r for r in neardup.classify(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert all(met[i].sum() - 1 <= got[i].n_links <= linked[i].sum() - 1 for i in range(90)) and sum(r.n_links for k, r in got.items() if k < 90) % 2 == 0
    assert {r.n_copies for k, r in got.items() if k >= 100} == {51}
    assert all(got[i].class_id == got[j].class_id for i in range(90) for j in range(90) if met[i, j])
    if changes == [1]:
        assert {(r.class_id, r.n_links) for r in got.values()} == {(0, 89)}


def test_reach():
    assert neardup.reach(0.5) == 127 and neardup.reach(1.0) == 0 and neardup.reach(1.1) == -1 and neardup.reach(0.0) == 256


def test_a_group_of_20_000_near_copies_costs_work_in_proportion(spark, monkeypatch):
    """A node for each of n different near copies: what is compared and written grows with n, not with its pairs."""
    rng = np.random.default_rng(3)
    base = rng.integers(1, 1 << 62, 256, np.uint64)
    sizes = {}
    for n in (5_000, 20_000):
        held = np.tile(base, (n, 1))
        for k in range(12):
            held[np.arange(n), rng.integers(0, 256, n)] = rng.integers(1, 1 << 62, n, np.uint64)
        bands = tx.signed(neardup.band_hashes(held))
        rows = [(i, m.tobytes(), b.tolist(), 1) for i, (m, b) in enumerate(zip(neardup.small(held), bands))]
        nodes = spark.createDataFrame(rows, "node bigint, marks binary, bands array<bigint>, texts bigint").repartition(8).cache()
        tables = collections.Counter()

        def counted(df, what):
            out = neardup_written(df, what)
            tables[what] += out.count()
            return out

        neardup_written = neardup.written
        monkeypatch.setattr(neardup, "written", counted)
        got = neardup._connected(nodes, neardup.THRESHOLD).agg(F.min("linked"), F.max("linked"), F.countDistinct("root"), F.count(F.lit(1))).first()
        monkeypatch.setattr(neardup, "written", neardup_written)
        assert tuple(got) == (n - 1, n - 1, 1, n)
        sizes[n] = sum(v for k, v in tables.items())
        nodes.unpersist()
    assert sizes[20_000] < 4.4 * sizes[5_000]


def test_near_duplicate_edges(spark, awkward, empty):
    got = neardup.classify(awkward).collect()
    assert len(got) == len(awkward_rows())
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert {r.class_id for k in (4, 5, 6) for r in by[k]} == {4} and by[4][0].n_copies == 3 and by[4][0].n_links == 1
    assert by[1][0].class_id == by[2][0].class_id == 1 and by[1][0].n_copies == 3  # null and empty, with a null key too
    assert {r.class_id for r in by[None]} == {1, None}
    kept = neardup.keep_one(awkward)
    assert kept.columns == awkward.columns
    # One row of each class; the two texts under key 12 are classes of their own, both called 12.
    found = collections.Counter(r.doc_id for r in kept.collect())
    assert found == collections.Counter({r.class_id: 1 for r in got}) + collections.Counter([12])
    assert neardup.classify(empty).count() == 0 and neardup.keep_one(empty).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 300 + i) for i in range(1, 50)] + [(-7, 9**9)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


# Mixing


def naive_mix(docs, weights, block, slots):
    by = collections.defaultdict(list)
    for k, s in sorted(docs):
        by[s].append(k)
    given = {s: float(len(v)) ** mixing.FLATTEN for s, v in by.items()} if weights is None else {s: weights.get(s, 0) for s in by}
    quota = mixing.quotas(given, slots)
    total, blocks, placed, out, t = sum(quota.values()), {s: -(-len(by[s]) // block) for s in quota}, collections.Counter(), [], 0
    order = list(quota)
    while any(placed[s] < blocks[s] for s in quota):
        released = [s for s in quota if placed[s] * total // quota[s] <= t]
        s = min(released, key=lambda s: (-(-(placed[s] + 1) * total // quota[s]), order.index(s)))
        b, e = placed[s] % blocks[s], placed[s] // blocks[s]
        out += [(k, s, b, e, t, i) for i, k in enumerate(by[s][b * block : (b + 1) * block])]
        placed[s] += 1
        t += 1
        assert all(abs(placed[x] - t * quota[x] / total) < 1 for x in quota)
    return sorted(out, key=repr)


@pytest.mark.parametrize("weights,block,slots", [(None, 16, 10_000), (None, 3, 100), ({"src0": 5, "src1": 1, "src2": 0.02}, 4, 50), ({"src3": 1}, 8, 10), ({}, 8, 10)])
def test_mix(spark, documents, weights, block, slots):
    docs = [(r.doc_id, r.source) for r in documents.select("doc_id", "source").collect()]
    want = naive_mix(docs, weights, block, slots)
    assert sorted(map(tuple, mixing.mix(documents, weights, block=block, slots=slots).collect()), key=repr) == want
    times = collections.Counter(r.doc_id for r in mixing.repeat(documents, weights, block=block, slots=slots).collect())
    assert times == collections.Counter(k for k, *_ in want)


def test_mix_of_a_hot_source(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 30)).alias("source"))
    rows = [(r.doc_id, r.source) for r in docs.collect()]
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=repr) == naive_mix(rows, None, mixing.BLOCK, mixing.ROUND)


def test_mix_edges(spark, awkward, empty):
    got = mixing.mix(awkward, block=2).collect()
    assert collections.Counter(r.doc_id for r in got if r.epoch == 0) == collections.Counter(k for k, _ in awkward_rows())
    assert {r.source for r in got} == {r.source for r in awkward.collect()}
    again = mixing.repeat(awkward, block=2)
    assert again.columns == awkward.columns and again.distinct().count() == awkward.distinct().count()
    assert mixing.mix(empty).count() == 0 and mixing.repeat(empty).count() == 0
    # One key, null, on most rows of a source that is null itself.
    hot = spark.range(400).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").alias("source"))
    got = mixing.mix(hot, {None: 3, "a": 1}, block=8).where("epoch = 0").collect()
    assert len(got) == 400 and collections.Counter((r.doc_id, r.source) for r in got) == collections.Counter(tuple(r) for r in hot.collect())
    assert len({(r.source, r.block, r.place) for r in got}) == 400


def test_mix_of_more_than_10_000_sources(spark, monkeypatch):
    """Every source keeps its name, and a weight counts however small its source is."""
    docs = spark.range(10_200).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 100, "big").otherwise(F.concat(F.lit("s"), F.col("id"))).alias("source"), F.lit("x").alias("text"))
    truth = {r.doc_id: r.source for r in docs.collect()}
    got = mixing.mix(docs).where("epoch = 0").collect()
    assert {r.doc_id: r.source for r in got} == truth and len(got) == len(truth)
    rare = max(s for s in truth.values() if s != "big")
    weights = {"big": 3, rare: 1}
    want = naive_mix([x for x in truth.items() if x[1] in weights], weights, 16, 40)
    assert sorted(map(tuple, mixing.mix(docs, weights, slots=40).collect()), key=repr) == want
    for most in (mixing.MAX_BROADCAST, 1):
        monkeypatch.setattr(mixing, "MAX_BROADCAST", most)
        times = collections.Counter(r.doc_id for r in mixing.repeat(docs, weights, slots=40).collect())
        assert times == collections.Counter(k for k, *_ in want)


def test_mix_holds_the_target_weights_over_many_rounds(spark):
    """Nothing is rounded: at every slot each source is less than a block from the weight that was asked for."""
    weights = {"big": 1 / 3} | {f"s{i}": 2 / 3 / 49 for i in range(49)}
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 20_000, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 49)).alias("source"))
    order = [r.source for r in mixing.mix(docs, weights, block=1).orderBy("slot").select("source").collect()]
    placed, total = collections.Counter(), sum(weights.values())
    assert len(order) > 50_000
    for t, s in enumerate(order, 1):
        placed[s] += 1
        assert abs(placed[s] - t * weights[s] / total) < 1 and abs(placed["big"] - t * weights["big"] / total) < 1
    exact = mixing.quotas(weights)
    assert all(abs(q / sum(exact.values()) - weights[s] / total) < 1e-15 for s, q in exact.items())
    assert abs(mixing.quotas(weights, 10_000)["big"] - 10_000 / 3) < 1


def test_schedule_meets_every_deadline():
    rng = random.Random(4)
    for _ in range(30):
        quota = mixing.quotas({i: rng.random() ** 3 + 1e-4 for i in range(rng.randrange(1, 30))}, 300)
        slots, seen = mixing.schedule(quota), collections.Counter()
        for t, s in enumerate(slots):
            i = seen[s]
            assert i * len(slots) // quota[s] <= t < -(-(i + 1) * len(slots) // quota[s])
            seen[s] += 1
        assert seen == quota


# Pipeline


def test_pipeline(spark, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "mix", "encode"]
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == documents.columns
        ids, kept = {r.doc_id for r in before.collect()}, [r.doc_id for r in docs.collect()]
        if name in ("toxicity", "near_dedup"):
            assert set(kept) < ids and len(kept) == len(set(kept))
        else:
            assert set(kept) == ids
        if name == "near_dedup":
            assert sorted(kept) == sorted({r.class_id for r in neardup.classify(before).collect()})
        if name == "substring_dedup":
            want = {k: h for k, _, _, h in naive_removal(pairs(before), 35)}
            assert all(hashlib.sha256(b" ".join(r.text.encode().split())).hexdigest() == want[r.doc_id] and r.n_chars == len(r.text) for r in docs.collect())
    done = corpus_pipeline.run(spark, SF)
    assert done.columns == ["doc_id", "source", "n_tokens", "ids"]
    assert collections.Counter(r.doc_id for r in done.collect()) == collections.Counter(r.doc_id for r in docs.collect())


def test_pipeline_stages_take_awkward_and_empty_tables(spark, awkward, empty):
    for df in (awkward, empty):
        docs = df
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            docs.count()


def test_queries_are_registered():
    assert [q.split("_")[0] for q in sorted(queries.QUERIES, key=lambda q: int(q[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 11)]


def test_hash_helpers():
    a = np.frombuffer("äa bb  a bb\ncc".encode(), np.uint8)
    start, end, doc = tx.word_bounds(a, np.array([0, 3, 3, len(a)]))
    words = [a[s:e].tobytes().decode() for s, e in zip(start, end)]
    assert words == ["äa", "bb", "a", "bb", "cc"] and doc.tolist() == [0, 2, 2, 2, 2]
    h = tx.word_hashes(a, start, end)
    assert h[1] == h[3] and len(set(h.tolist())) == 4
    assert tx.cover(np.array([1, 2, 6]), np.array([2, 2, 1]), 8).tolist() == [False, True, True, True, False, False, True, False]
    assert tx.sliding_min(np.array([5, 3, 4, 1, 2]), 3).tolist() == [3, 1, 1]
