"""Near-duplicates and incremental deduplication against brute force."""

import random
from collections import Counter

import pytest

from arbora.llm import neardup
from arbora.llm.bags import distinct_bags, jaccard, keyed, tokens
from arbora.llm.incremental import History, absorb, best_links, cluster_of_records, cluster_updates, learn_weights, link_batch
from arbora.llm.neardup import near_duplicate_classes, near_duplicates

SUBS = "array<struct<weight:bigint,digest:string>>"


def similarity(a, b):
    x, y = (Counter(d.strip().lower() for _, d in s if d is not None) for s in (a or [], b or []))
    union = sum((x | y).values())
    return sum((x & y).values()) / union if union and x and y else 0.0


def family(rng, n, base=None):
    """Bags with shared light sub-trees, edits of each other at random."""
    out = []
    while len(out) < n:
        if out and rng.random() < 0.6:
            b = list(rng.choice(out))
            for _ in range(rng.randint(0, 5)):
                if rng.random() < 0.5 and len(b) > 3:
                    b.pop(rng.randrange(len(b)))
                else:
                    b.append((rng.randint(2, 40), f"{rng.getrandbits(64):032x}"))
            rng.shuffle(b)
        else:
            b = [(2, f"{rng.randint(0, 3):032x}") for _ in range(rng.randint(0, 5))] + [(rng.randint(3, 60), f"{rng.getrandbits(64):032x}") for _ in range(rng.randint(2, 25))]
        out.append(b)
    return out


def dirty(rng, bag):
    return [(w, rng.choice([d, d.upper(), f" {d}\n"])) for w, d in bag]


def pairs_by_brute_force(rows, t):
    rows = sorted({i: b for i, b in rows if i is not None}.items())
    return {(i, j) for n, (i, a) in enumerate(rows) for j, b in rows[n + 1 :] if similarity(a, b) >= t}


@pytest.mark.parametrize("run_cap", [64, 1])
def test_near_duplicates(spark, run_cap):
    # a cap of one sends every bucket through the exact way for hot ones
    rng = random.Random(5)
    rows = [(i, dirty(rng, b)) for i, b in enumerate(family(rng, 220))]
    rows += rows[:5] + [(900, None), (901, []), (902, [(3, None)]), (None, rows[0][1])]
    got = [(r.id_a, r.id_b) for r in near_duplicates(spark.createDataFrame(rows, f"id bigint, subs {SUBS}"), "id", "subs", 0.7, run_cap=run_cap).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs_by_brute_force(rows, 0.7)


def test_hot_copies_and_empty_tables(spark):
    bag = [(9, f"{i:032x}") for i in range(12)]
    rows = [(i, bag) for i in range(30)] + [(100, bag[:11]), (101, [(1, "f" * 32)])]
    df = spark.createDataFrame(rows, f"id bigint, subs {SUBS}")
    assert {(r.id_a, r.id_b) for r in near_duplicates(df, "id", "subs").collect()} == pairs_by_brute_force(rows, 0.7)
    assert near_duplicates(df.limit(0), "id", "subs").count() == 0
    clash = df.withColumnRenamed("id", "fp").selectExpr("fp", "subs", "fp as id", "fp as bag", "'x' as tokens", "1 as k1")
    assert near_duplicates(clash, "fp", "subs").count() == near_duplicates(df, "id", "subs").count()


def test_multiset_elements(spark):
    rows = [(1, [(2, "a"), (2, "a"), (5, "b")]), (2, [(2, "a"), (5, "b"), (5, "b")])]
    df = distinct_bags(keyed(spark.createDataFrame(rows, f"id bigint, subs {SUBS}"), "id", "subs"))
    a, b = (r.elements for r in df.orderBy("bag").collect())
    assert len(set(a)) == 3 and len(set(a) & set(b)) == 2
    assert df.alias("x").crossJoin(df.alias("y")).where("x.bag < y.bag").select(jaccard("x.elements", "y.elements").alias("s")).first().s == 0.5
    long = spark.createDataFrame([(1, [(2, "a")] * 20_000)], f"id bigint, subs {SUBS}")
    assert distinct_bags(keyed(long, "id", "subs")).selectExpr("size(array_distinct(elements)) as n").first().n == 20_000
    assert long.select(tokens("subs").alias("t")).first().t[0] > 0


def test_depth_shortens_until_recall(spark, monkeypatch):
    used = []
    real = neardup._runs
    monkeypatch.setattr(neardup, "_runs", lambda depth, cap: used.append(depth) or real(depth, cap))
    rng = random.Random(2)
    base = [[(9, f"{rng.getrandbits(64):032x}") for _ in range(40)] for _ in range(60)]
    run = lambda rows, **f: {(r.id_a, r.id_b) for r in near_duplicates(spark.createDataFrame(rows, f"id bigint, subs {SUBS}"), "id", "subs", **f).collect()}
    alike = [(2 * i, b) for i, b in enumerate(base)] + [(2 * i + 1, b[:-1]) for i, b in enumerate(base)]
    assert run(alike, recall=0.9) == {(2 * i, 2 * i + 1) for i in range(60)} and used == [7]
    used.clear()
    edited = [(2 * i, b) for i, b in enumerate(base)] + [(2 * i + 1, b[:33] + [(9, f"{5 * i + j:032x}") for j in range(5)]) for i, b in enumerate(base)]
    assert run(edited) == {(2 * i, 2 * i + 1) for i in range(60)}
    assert len(used) > 1 and used == list(range(7, 7 - len(used), -1))


def test_classes_count_links_without_pairs(spark):
    rng = random.Random(6)
    rows = [(i, dirty(rng, b)) for i, b in enumerate(family(rng, 120))]
    rows += [(500 + i, rows[7][1]) for i in range(40)] + [(900, None), (901, [])]
    df = spark.createDataFrame(rows, f"id bigint, subs {SUBS}")
    pairs = pairs_by_brute_force(rows, 0.7)
    links, root = Counter(x for p in pairs for x in p), {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert {(r.id, r["class"], r.links) for r in near_duplicate_classes(df, "id", "subs").collect()} == {(x, find(x), n) for x, n in links.items()}
    assert near_duplicate_classes(df.limit(0), "id", "subs").count() == 0


def test_runs_across_borders_and_batches():
    import pyarrow as pa

    rng = random.Random(1)
    keys = sorted(rng.choice([0, 1, 2, 255, 256, 70_000]) + (rng.randint(0, 2) << 56) for _ in range(120))
    parts = [0] * 50 + [1] * 30 + [2] * 40
    for depth, cap in ((7, 64), (6, 64), (5, 4), (4, 1)):
        shift = 8 * (7 - depth)
        for width in (7, 33, 200):
            batches = [pa.RecordBatch.from_pydict({"key": pa.array(keys[i : i + width], pa.int64()), "bag": pa.array(list(range(i, min(120, i + width))), pa.int64()), "part": pa.array(parts[i : i + width], pa.int32())}) for i in range(0, 120, width)]
            met, alone = set(), {}
            for b in neardup._runs(depth, cap)(iter(batches)):
                for k, x, y in zip(*(b.column(c).to_pylist() for c in ("key", "a", "b"))):
                    if y is None:
                        alone.setdefault(k, []).append(x)
                    else:
                        met.add((x, y))
            assert all(len(v) == len(set(v)) for v in alone.values())
            within = {(x, y) for v in alone.values() for x in v for y in v if x < y}
            want = {(x, y) for x in range(120) for y in range(x + 1, 120) if keys[x] >> shift == keys[y] >> shift and (depth == 7 or keys[x] >> (shift - 8) != keys[y] >> (shift - 8))}
            assert want <= met | within and met <= want


def decide(history, batch, t=0.7):
    """The rule as stated: in order, a case repeats history or an earlier accepted record."""
    clean = lambda d: None if d is None else d.strip().lower()
    accepted, cases = [(w, clean(d), b) for _, w, d, b in history], set()
    for i, w, d, b in batch:
        if any((d is not None and w is not None and (w, clean(d)) == (aw, ad)) or similarity(b, ab) >= t for aw, ad, ab in accepted):
            cases.add(i)
        else:
            accepted.append((w, clean(d), b))
    return cases


def records(rng, bags, start):
    out = []
    for i, b in enumerate(bags):
        d = None if rng.random() < 0.05 else f"{rng.randint(0, 60):032x}"
        out.append((start + i, rng.randint(1, 3), d if rng.random() < 0.7 or d is None else f" {d.upper()}\n", rng.choice([None, [], dirty(rng, b), dirty(rng, b), dirty(rng, b)])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_link_batch(spark, seed):
    rng = random.Random(seed)
    bags = family(rng, 160)
    rng.shuffle(bags)
    history, batch = records(rng, bags[:70], 0), records(rng, bags[70:], 1000)
    schema = f"id bigint, weight bigint, digest string, subs {SUBS}"
    h = History.build(spark.createDataFrame(history + history[:4], schema), "id")
    df = spark.createDataFrame([(*r, i // 30) for i, r in enumerate(batch)] + [(*batch[0], 0)], schema + ", batch_no int").repartition(3)
    linked = link_batch(h, df, "id", ["batch_no", "id"])
    got = {r.id: r.found_in for r in linked.decided.collect()}
    assert len(got) == len(batch) and {i for i, f in got.items() if f} == decide(history, batch)


class Clusters:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def link(self, x, y):
        a, b = sorted((self.find(x), self.find(y)))
        self.up[b] = a


def linked_records(a, b):
    clean = lambda d: None if d is None else d.strip().lower()
    return (a[2] is not None and (a[1], clean(a[2])) == (b[1], clean(b[2]))) or similarity(a[3], b[3]) >= 0.7


def test_batches_one_by_one_give_the_same(spark, tmp_path):
    rng = random.Random(8)
    bags = family(rng, 120)
    rng.shuffle(bags)
    # ids of batches and history are the same numbers and mean different records
    history, batch = records(rng, bags[:40], 0), records(rng, bags[40:], 0)
    schema = f"id bigint, weight bigint, digest string, subs {SUBS}"
    path = str(tmp_path / "history")
    History.build(spark.createDataFrame(history, schema), "id", source="old", path=path, buckets=3, clusters=True)
    cases, want, accepted = set(), Clusters(), [(("old", r[0]), r) for r in history]
    for i, (x, r) in enumerate(accepted):
        for y, q in accepted[:i]:
            if linked_records(r, q):
                want.link(x, y)
    for k in range(0, len(batch), 27):
        part = batch[k : k + 27]
        h = History.load(spark, path)  # as if every batch came to another session
        linked = link_batch(h, spark.createDataFrame(part, schema), "id", ["id"], "new")
        bag_of = {f"old:{r[0]}": r[3] for r in history} | {f"new:{r[0]}": r[3] for r in batch}
        for r in best_links(linked).collect():
            assert abs(similarity(bag_of[f"new:{r.id}"], bag_of[r.linked_to]) - r.sim) < 1e-9 and r.sim >= 0.7
        found = {r.id for r in linked.decided.where("found_in is not null").collect()}
        cases |= found
        for i, r in enumerate(part):
            for y, q in accepted + [(("new", q[0]), q) for q in part[:i]]:
                if linked_records(r, q):
                    want.link(("new", r[0]), y)
        accepted += [(("new", r[0]), r) for r in part if r[0] not in found]
        clusters = cluster_updates(linked)
        number = k // 27 + 1
        if number == 2:  # an attempt that broke off leaves rows without a state; the batch is stored again
            h._keys.append(h.keys.limit(5), number)
            h = History.load(spark, path)
            assert h.batch == 1
            linked = link_batch(h, spark.createDataFrame(part, schema), "id", ["id"], "new")
            clusters = cluster_updates(linked)
        absorb(linked, number, clusters)
        before = History.load(spark, path).keys.count()
        absorb(linked, number, clusters)
        assert History.load(spark, path).keys.count() == before
    assert cases == decide(history, batch)
    h = History.load(spark, path)
    nodes = h.forest.select("node")
    names = {("old", i): i for i in range(len(history))} | {("new", r[0]): (1 << 55) + r[0] for r in batch}
    roots = {r.node: r.root for r in h.find(nodes).collect()}
    smallest = {}
    for x, code in names.items():
        root = want.find(x)
        smallest[root] = min(smallest.get(root, code), code)
    for x, code in names.items():
        if code in roots:
            assert roots[code] == smallest[want.find(x)]
    # every cluster of several nodes is in the union-find
    assert {smallest[want.find(x)] for x in names} >= set(roots.values())


def test_history_that_starts_empty_gets_an_order(spark, tmp_path):
    schema = f"id bigint, weight bigint, digest string, subs {SUBS}"
    path = str(tmp_path / "history")
    History.build(spark.createDataFrame([], schema), "id", path=path, buckets=2)
    shared = [(30, "f" * 32)]
    for number in (1, 2, 3):
        rows = [(100 * number + i, 1, f"{number * 50 + i:032x}", shared + [(9, f"{number:02}{i:02}{j:028x}") for j in range(9)]) for i in range(30)]
        h = History.load(spark, path)
        linked = link_batch(h, spark.createDataFrame(rows + [(9000, 1, f"{50 * (number - 1):032x}", None)], schema), "id", ["id"])
        assert {r.id for r in linked.decided.where("found_in is not null").collect()} == ({9000} if number > 1 else set())
        absorb(linked, number)
    h = History.load(spark, path)
    assert h.state["order"] >= 2 and len(h.common) == 1 and h.bags.count() == 90 and h.rare.count() + h.hot.count() == h.bags.count() * 4
    h.close()
    h = History.load(spark, path)
    assert h.bags.count() == 90
    with pytest.raises(Exception, match="ids must be"):
        link_batch(h, spark.createDataFrame([(-1, 1, "a", shared)], schema), "id", ["id"])


def test_one_key_with_most_rows_and_empty_sides(spark):
    schema = f"id bigint, weight bigint, digest string, subs {SUBS}"
    hot = [(i, 7, "k", [(3, f"{i:032x}")]) for i in range(200)]
    none = spark.createDataFrame([], schema)
    linked = link_batch(History.build(none, "id"), spark.createDataFrame(hot, schema), "id", ["id"])
    assert {r.id for r in linked.decided.where("found_in is null").collect()} == {0}
    assert link_batch(History.build(spark.createDataFrame(hot, schema), "id"), none, "id", ["id"]).decided.count() == 0
    nulls = spark.createDataFrame([(1, None, "k", None), (2, 7, None, None), (3, None, "k", []), (None, 7, "k", None)], schema)
    assert link_batch(History.build(spark.createDataFrame(hot, schema), "id"), nulls, "id", ["id"]).decided.where("found_in is not null").count() == 0


def test_weights_separate_agreement_from_disagreement():
    patterns = [({"hits": 3, "size": 2, "top": 1}, 900), ({"hits": 0, "size": 0, "top": 0}, 3000), ({"hits": 2, "size": 2, "top": 0}, 200), ({"hits": 0, "size": 2, "top": 0}, 500)]
    w = learn_weights(patterns)
    assert w["hits"][3] > 0 > w["hits"][0] and w["top"][1] > w["top"][0] and learn_weights([])["top"] == [0.0, 0.0]


def test_clusters_follow_all_links(spark):
    # brute force over history and batch: similar bags or equal keys, whatever was decided
    rng = random.Random(4)
    bags = family(rng, 110)
    rng.shuffle(bags)
    history, batch = records(rng, bags[:50], 0), records(rng, bags[50:], 0)
    schema = f"id bigint, weight bigint, digest string, subs {SUBS}"
    linked = link_batch(History.build(spark.createDataFrame(history, schema), "id", source="old", clusters=True), spark.createDataFrame(batch, schema), "id", ["id"], "new")
    got = {r.id: r.cluster for r in cluster_of_records(linked, cluster_updates(linked)).collect()}
    want, rows = Clusters(), [((0, r[0]), r) for r in history] + [((1, r[0]), r) for r in batch]
    for i, (x, r) in enumerate(rows):
        for y, q in rows[:i]:
            if linked_records(r, q):
                want.link(x, y)
    name = lambda x: f"{('old', 'new')[x[0]]}:{x[1]}"
    assert got == {r[0]: name(want.find((1, r[0]))) for r in batch}
