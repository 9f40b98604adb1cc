"""Distances, linkage, dendrograms, classes, partition, statistics, parsing, sources, streaming."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from arbora.functions.scalars import package_prefix, strip_version
from arbora.model import LOOSE, STRICT, hard, percent
from arbora.operators import classes, dendrogram, distance, graph, linkage, parsing, partition, stats
from arbora.operators.fingerprint import case_digest, fingerprint_trees, kept_subs, normalised_text, optional_digest
from arbora.plans.pipelines import corpus_report
from arbora.sources.files import dump_labels, read_units
from arbora.sources.nested import trees_from_nodes, with_tree
from arbora.streaming.upsert import stream_trees, upsert_stream
from tests.test_trees import GOLDEN

NAMES = {GOLDEN[k][4]: k for k in GOLDEN}


def hashed(spark, config=STRICT, threshold=hard(0)):
    rows = spark.createDataFrame([(k, v[0]) for k, v in GOLDEN.items()], "label string, ir string")
    return fingerprint_trees(rows, "ir", config, threshold)


def test_kernel_as_columns(spark):
    df = spark.createDataFrame([("a", "(Lconst)"), ("b", None), ("c", "(")], "label string, ir string")
    got = {r.label: (r.weight, r.error is None) for r in fingerprint_trees(df, "ir").collect()}
    assert got == {"a": (1, True), "b": (None, False), "c": (None, False)}
    assert fingerprint_trees(df, "ir", with_subs=False).where("subs is not null").count() == 0
    assert fingerprint_trees(df.limit(0), "ir").count() == 0
    assert [r.n for r in normalised_text(df, "ir", "n").orderBy("label").collect()] == ["(Lconst)", None, None]


def test_golden_distances(spark):
    want = {("id", "add"): 10, ("id", "sub"): 10, ("id", "addswap"): 10, ("id", "opt"): 16, ("id", "sw"): 33, ("id", "optseq"): 40, ("add", "sub"): 12, ("add", "addswap"): 16, ("add", "opt"): 26, ("add", "sw"): 43, ("add", "optseq"): 30,
            ("sub", "addswap"): 18, ("opt", "sw"): 41, ("opt", "optseq"): 24, ("sub", "opt"): 26, ("sub", "sw"): 43, ("sub", "optseq"): 42, ("addswap", "opt"): 26, ("addswap", "sw"): 43, ("addswap", "optseq"): 46, ("sw", "optseq"): 65}
    got = {frozenset((r.x, r.y)): r.dist for r in distance.symmetric_differences(hashed(spark), "label").collect()}
    assert got == {frozenset(k): v for k, v in want.items()}


def _forest(c):
    label = {}
    for r in c.leaves.collect():
        label.setdefault(r.leaf, set()).add(r.label)
    inner = {r.node_id: r for r in c.merges.collect()}

    def show(n):
        return (inner[n].height, frozenset((show(inner[n].left_id), show(inner[n].right_id)))) if n in inner else frozenset(label[n])

    below = {x for r in inner.values() for x in (r.left_id, r.right_id)}
    alone = {r.leaf for r in c.alone.collect()}
    return {show(n) for n in [*inner, *label] if n not in below and n not in alone}, {x for a in alone for x in label[a]}


def test_golden_dendrograms(spark):
    trees, alone = _forest(partition.cluster(hashed(spark, STRICT, hard(4))))
    one = lambda *x: frozenset(x)
    assert trees == {(18, one(one("opt"), one("optseq"))), one("add")} and alone == {"sw", "addswap", "sub", "id", "const"}
    trees, alone = _forest(partition.cluster(hashed(spark, LOOSE, percent(30))))
    assert trees == {(10, one(one("sub"), one("add", "addswap"))), (22, one(one("opt"), one("optseq")))} and alone == {"sw", "id", "const"}
    c = partition.cluster(hashed(spark, LOOSE, percent(50)))
    assert c.merges.count() == 0
    n = c.leaves.groupBy("leaf").agg(F.count("label").alias("n_labels"))
    order = [r.root for r in dendrogram.ordered_forest(dendrogram.forest_sizes(c.merges, n).where("false"), n).orderBy("place").collect()]
    names = {}
    for r in c.leaves.collect():
        names.setdefault(r.leaf, []).append(r.label)
    assert [sorted(names[x]) for x in order] == [["optseq"], ["sw"], ["opt"], ["add", "addswap"], ["sub"], ["id"], ["const"]]


def test_distance_zero_does_not_mean_same_class(spark):  # Q8
    df = spark.createDataFrame([("a", '(Lprim "p" (Lconst))'), ("b", '(Lstaticraise (Lconst))')], "label string, ir string")
    rows = spark.createDataFrame([("x", [(3, "d1")]), ("y", [(3, "d1")])], "label string, subs array<struct<weight:bigint,digest:string>>")
    assert [r.dist for r in distance.symmetric_differences(rows, "label").collect()] == [0]
    assert fingerprint_trees(df, "ir").select("digest").distinct().count() == 2


def test_distance_by_brute_force(spark):
    rng = random.Random(4)
    bags = {f"t{i}": [(w, f"d{w}") for w in (rng.randint(1, 12) for _ in range(rng.randint(0, 9)))] for i in range(25)}
    rows = spark.createDataFrame(list(bags.items()), "label string, subs array<struct<weight:bigint,digest:string>>")
    got = {(r.x, r.y): r.dist for r in distance.symmetric_differences(rows, "label").collect()}
    want = {}
    for x, y in itertools.combinations(sorted(bags), 2):
        if {d for _, d in bags[x]} & {d for _, d in bags[y]}:
            want[x, y] = sum(w * abs(bags[x].count((w, d)) - bags[y].count((w, d))) for w, d in {*bags[x], *bags[y]})
    assert got == want


def test_infinity_algebra(spark):
    df = spark.createDataFrame([(1, None), (1, 2), (None, None)], "a int, b int")
    got = df.select(distance.distance_max(F.col("a"), F.col("b")), distance.distance_min(F.col("a"), F.col("b")), distance.distance_less(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(None, 1, True), (2, 1, True), (None, None, False)]


def random_edges(rng, n, p, distinct):
    pairs = [(f"n{i:02}", f"n{j:02}") for i in range(n) for j in range(i + 1, n) if rng.random() < p]
    d = rng.sample(range(1, 10 * len(pairs) + 1), len(pairs)) if distinct else [rng.randint(1, 4) for _ in pairs]
    return [(x, y, int(k)) for (x, y), k in zip(pairs, d)]


def sequential(edges):
    """Plain complete linkage by definition, ties by (distance, smaller name, larger name)."""
    dist = {frozenset(e[:2]): e[2] for e in edges}
    groups = {x: {x} for e in edges for x in e[:2]}
    out = []
    while True:
        best = None
        for a, b in itertools.combinations(sorted(groups), 2):
            ds = [dist.get(frozenset((x, y))) for x in groups[a] for y in groups[b]]
            if None not in ds and (best is None or (max(ds), a, b) < best):
                best = (max(ds), a, b)
        if best is None:
            return out
        d, a, b = best
        out.append((linkage.node_id(a, len(groups[a]) + len(groups[b])), d))
        groups[a] |= groups.pop(b)


@pytest.mark.parametrize("distinct", [True, False])
def test_kernel_is_sequential_linkage(distinct):
    rng = random.Random(7)
    for _ in range(60):
        edges = random_edges(rng, rng.randint(2, 11), rng.random(), distinct)
        got = linkage.link_component(edges)
        assert [(r[0], r[3]) for r in got] == sequential(edges)
        assert [r[3] for r in got] == sorted(r[3] for r in got)


def test_rounds_agree_with_the_kernel(spark):
    rng = random.Random(9)
    edges = [(f"g{g}{x}", f"g{g}{y}", d * 10 + g) for g in range(12) for x, y, d in random_edges(rng, 8, 0.7, g % 2 == 0)]  # every other with ties
    df = spark.createDataFrame(edges, "x string, y string, dist bigint")
    cols = ["node_id", "left_id", "right_id", "height", "n_leaves"]
    kernel = sorted(map(tuple, linkage.complete_linkage(df).select(cols).collect()))
    rounds = sorted(map(tuple, linkage.complete_linkage(df, kernel_edges=0).select(cols).collect()))
    assert kernel == rounds and kernel
    assert linkage.complete_linkage(df.limit(0)).count() == 0


def test_rounds_keep_the_invariants_with_ties(spark):
    edges = random_edges(random.Random(3), 12, 0.6, False)
    df = spark.createDataFrame(edges, "x string, y string, dist bigint")
    dist = {frozenset(e[:2]): e[2] for e in edges}
    merges = {r.node_id: r for r in linkage.complete_linkage(df, kernel_edges=0).collect()}

    def leaves(n):
        return leaves(merges[n].left_id) | leaves(merges[n].right_id) if n in merges else {n}

    for n, r in merges.items():
        inside = [dist[frozenset(p)] for p in itertools.combinations(leaves(n), 2)]
        assert max(inside) == r.height and len(leaves(n)) == r.n_leaves
    below = {x for r in merges.values() for x in (r.left_id, r.right_id)}
    tops = [n for n in {*merges, *(x for e in edges for x in e[:2])} if n not in below]
    for a, b in itertools.combinations(tops, 2):
        assert any(frozenset((x, y)) not in dist for x in leaves(a) for y in leaves(b))


def test_components(spark):
    rng = random.Random(1)
    edges = [("a", "b"), ("b", "c"), ("z", "z"), (None, "q"), ("b", "a")] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(120)] + [("hub", f"s{i}") for i in range(60)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "x string, y string")).collect()}
    want = {x: "a" for x in "abc"} | {f"p{i:03}": "p000" for i in range(121)} | {f"s{i}": "hub" for i in range(60)} | {"hub": "hub"}
    assert got == want
    assert graph.components(spark.createDataFrame([], "x string, y string")).count() == 0


def _small_forest(spark):
    merges = spark.createDataFrame([("a", "a+2", "a", "b", 3, 2), ("a", "a+3", "a+2", "c", 5, 3)], "component string, node_id string, left_id string, right_id string, height bigint, n_leaves bigint")
    leaves = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("c", "w"), ("d", "v")], "leaf string, label string")
    return merges, leaves


def test_dendrogram_algebra(spark, tmp_path):
    merges, leaves = _small_forest(spark)
    n = leaves.groupBy("leaf").agg(F.count("label").alias("n_labels"))
    assert {(r.root, r.label_count, r.tree_size) for r in dendrogram.forest_sizes(merges, n).collect()} == {("a+3", 4, 6), ("d", 1, 1)}  # Q15
    assert {(r.leaf, r.cluster) for r in dendrogram.cut(merges, n, 3).collect()} == {("a", "a+2"), ("b", "a+2"), ("c", "c"), ("d", "d")}
    assert {r.root: r.holds for r in dendrogram.any_leaf(merges, leaves, F.col("label") == "w").collect()} == {"a+3": True, "d": False}
    values = n.select(F.col("leaf").alias("node"), F.col("n_labels").alias("value"))
    folded = {r.node: r.value for r in dendrogram.fold_forest(merges, values, lambda h, a, b: a + b + h).collect()}
    assert folded["a+3"] == 2 + 1 + 3 + 1 + 5
    assert dendrogram.print_forest(merges, leaves, ["a+3", "d"]) == ["Class 0:", " Node 5:", "  Node 3:", "   x y ", "   z ", "  w ", "Class 1:", " v "]
    dendrogram.write_forest(merges, leaves, str(tmp_path / "f"))
    assert dendrogram.read_forest(spark, str(tmp_path / "f"))[0].count() == 2
    assert {r.label for r in dendrogram.map_leaves(leaves, F.upper("label")).collect()} == set("XYZWV")


def test_database_and_reports(spark, tmp_path):
    own = spark.createDataFrame([("f", 3, "d", 1, 9), ("g", 3, "d", 10, 20), ("f", 3, "d", 30, 40)], "label string, weight bigint, digest string, s int, e int")
    db = spark.createDataFrame([(3, "d", f"n{i:02}") for i in range(12)] + [(4, "x", "f")], "weight bigint, digest string, label string")
    path = str(tmp_path / "db")
    classes.write_database(db, path, partitions=2)
    assert classes.read_database(spark, path).count() == 13 and classes.read_database(spark, None).count() == 0
    with pytest.raises(ValueError):
        dendrogram.read_forest(spark, str(tmp_path / "g")) if db.withColumn("kind", F.lit("forest")).write.parquet(str(tmp_path / "g" / "merges")) else classes.read_database(spark, str(tmp_path / "g" / "merges"))
    known = classes.upsert(db, own)
    got = {(r.label, r.s): (r.n_matches, list(r.names)) for r in classes.clone_report(own, known, ["label", "s"], limit=2).collect()}
    pairs = classes.clone_matches(own, known).groupBy("label", "s").count().collect()
    assert {(r["label"], r["s"]): r["count"] for r in pairs} == {k: v[0] for k, v in got.items()}
    assert got[("f", 1)] == (13, ["g", "n00"]) and got[("g", 10)] == (14, ["f", "f"])  # same-name redefinitions are hidden (Q16)
    assert all(list(r.names) == [] for r in classes.clone_report(own, known, ["label", "s"], limit=0).collect())
    members = classes.exact_classes(db)
    assert members.count() == 12 and [len(r.labels) for r in classes.class_chunks(members).collect()] == [12]
    lists = classes.name_lists(own, known, 5).orderBy("chunk").collect()
    assert [len(r.names) for r in lists] == [5, 5, 5] and [x for r in lists for x in r.names] == sorted(["f", "f", "g", *(f"n{i:02}" for i in range(12))])
    rec = spark.range(1).select(classes.machine_record(F.lit(1), F.lit(9), F.array(F.lit("a"), F.lit("b"))).alias("r")).first().r
    assert rec == "1;9;* a\n* b#"
    assert "has" not in rec and spark.range(1).select(classes.human_record(F.lit("f"), F.lit("l"), F.lit(2), F.array(F.lit("a"))).alias("r")).first().r == "f in l matches 2 definition(s):\n* a"


def test_large_classes_come_in_chunks(spark):
    rows = spark.createDataFrame([(2, "d", f"n{i:02}") for i in range(12)] + [(3, "e", "x")] * 2, "weight bigint, digest string, label string")
    got = {(r.digest, r.chunk): list(r.labels) for r in classes.class_chunks(classes.exact_classes(rows), 5).collect()}
    assert got == {("d", 0): [f"n{i:02}" for i in range(5)], ("d", 1): [f"n{i:02}" for i in range(5, 10)], ("d", 2): ["n10", "n11"], ("e", 0): ["x", "x"]}


def test_first_bag_wins(spark):
    rows = spark.createDataFrame([(2, "d", [(1, "b"), (1, "a")], 5), (2, "d", [(1, "z")], 9)], "weight bigint, digest string, subs array<struct<weight:bigint,digest:string>>, o int")
    assert [[s.digest for s in r.subs] for r in classes.first_bag(rows, "o").collect()] == [["a", "b"]]


def test_columns(spark):
    df = spark.createDataFrame([([(1, "b"), (3, "a"), (2, "c")],)], "subs array<struct<weight:bigint,digest:string>>")
    assert [s.weight for s in df.select(kept_subs(F.col("subs"), F.lit(6), percent(30), True).alias("k")).first().k] == [2, 3]
    import hashlib

    want = hashlib.md5(b"7" + bytes.fromhex(hashlib.md5(b"x").hexdigest())).hexdigest()
    assert spark.range(1).select(case_digest(F.lit(7), F.md5(F.lit("x"))).alias("d")).first().d == want
    assert spark.range(1).select(optional_digest(F.lit(None).cast("string")).alias("d")).first().d == hashlib.md5(b"None").hexdigest()


def test_partition(spark):
    ir = GOLDEN["add"][0]
    units = spark.createDataFrame([("a", None, 1, "A"), ("b", None, 2, "B"), ("c", "parse error", 3, "C"), ("d", "type error", 4, "D"), ("e", None, 5, "E"), ("f", None, 6, "F"), ("g", None, 7, "G")], "key string, error string, ord int, text string")
    bindings = spark.createDataFrame(
        [("a", 0, "f", "old", ir, True), ("a", 1, "f", "t", GOLDEN["sub"][0], True), ("b", 0, "f", "t", ir, True), ("e", 0, "g", "t", ir, True), ("f", 0, "f", "u", ir, True), ("g", 0, "f", "t", ir, False)],
        "unit string, ord int, name string, sig string, ir string, plain boolean")
    p = partition.partition(units, bindings, "f", "t")
    assert {(r.key, r.reason) for r in p.rejected.collect()} == {("d", "type error"), ("e", "not found"), ("f", "wrong type"), ("g", "no plain binding")}
    assert {r.key for r in p.quarantine.collect()} == {"c"}  # Q13
    # Q11: a's tree is its first one, so a and b are one class
    assert p.clusters.leaves.select("leaf").distinct().count() == 1
    assert {(r.key, r.text) for r in p.implementations.collect()} == {("a", "A"), ("b", "B")}


def test_labels(spark):
    df = spark.createDataFrame([("pkg.1.2:M.f",), ("pkg:M.f",), ("plain",), ("a-b.1:M",), (None,)], "l string")
    got = [tuple(r) for r in df.select(strip_version(F.col("l")), package_prefix(F.col("l"))).collect()]
    assert got == [("pkg:M.f", "pkg"), ("pkg:M:M.f", "pkg:M"), ("plain", None), ("a-b:M", "a"), (None, None)]  # Q20


def test_statistics(spark):
    rows = [("c1", "l", f"p{i}.1:M.x") for i in range(5)] + [("c2", "l", "a.1:M"), ("c2", "l", "a.2:M")] + [("c3", "l", "b.1:M")] + [("c4", "l", f"menhir{i}.1:M") for i in range(6)]
    df = spark.createDataFrame(rows, "cls string, leaf string, label string")
    got = stats.class_report(df, "all").first()
    assert tuple(got) == ("all", 14, 4, 3, 6, 5)
    assert tuple(stats.class_report(stats.without_versions(df), "only").first()) == ("only", 13, 4, 2, 6, 5)
    assert {r.cls for r in stats.class_sizes(stats.refined(df)).collect()} == {"c1"}
    assert tuple(stats.class_report(df.limit(0), "none").first()) == ("none", 0, 0, 0, None, None)  # Q21
    sizes = stats.class_sizes(df)
    assert [(r.size, r.n) for r in stats.size_histogram(sizes).collect()] == [(1, 1), (2, 1), (5, 1), (6, 1)]
    assert stats.middle_size(sizes).first().middle == 2
    assert [r.cls for r in stats.top_classes(sizes, 2).collect()] == ["c4", "c1"] and stats.top_classes(sizes, -1).count() == 0
    a, b = ({(r.cls, r.place, r.label) for r in stats.representatives(df, 2).collect()} for _ in range(2))
    assert a == b and len(a) == 7
    assert stats.export_histogram(stats.size_histogram(sizes), None, "x") is None
    tree = spark.createDataFrame([("c3", True)], "cls string, is_tree boolean")
    assert stats.class_report(df, "all", tree).first().real_classes == 4


def test_histogram_file(spark, tmp_path):
    hist = spark.createDataFrame([(2, 1), (1, 7)], "size bigint, n bigint")
    path = stats.export_histogram(hist, str(tmp_path) + "/x", "all.csv")
    parts = [f for f in os.listdir(path) if f.endswith(".csv")]
    assert len(parts) == 1 and open(f"{path}/{parts[0]}").read() == "1,7\n2,1\n"


def test_directive_stripping(spark):
    df = spark.createDataFrame([("let a = 1;; #use \"x\"\nlet lost = 2;;  ;;let b = \";;\"",), ("",)], "t string")
    assert [r[0] for r in df.select(parsing.strip_directives(F.col("t"))).collect()] == ['let a = 1;;let b = ";;"', ""]


def test_paths(spark, tmp_path):
    df = spark.createDataFrame([("/a/b.ml",), ("b.ml",), ("/x",)], "p string")
    got = [tuple(r) for r in df.select(parsing.path_directory(F.col("p")), parsing.path_base(F.col("p")), parsing.has_extension(F.col("p"))).collect()]
    assert got == [("/a", "b.ml", True), (".", "b.ml", True), ("", "x", False)]
    b = spark.createDataFrame([(1, "B one\nA no\nB /abs\nB")], "id int, t string")
    assert [r.p for r in parsing.build_path_lines(b, "t").select(parsing.with_base(F.col("path"), "/base").alias("p")).collect()] == ["/base/one", "/abs", None]
    files = spark.createDataFrame([("foo.ml",), ("bar.ml",)], "file string")
    arts = spark.createDataFrame([(0, 0, "/d0/foo.cmt"), (1, 0, "/d1/xfoo.cmt"), (1, 1, "/d1/Foo.cmt")], "dir_ord int, ord int, path string")
    found, missing = parsing.find_artifacts(files, arts)
    assert [(r.file, r.path) for r in found.collect()] == [("foo.ml", "/d1/xfoo.cmt")] and [r.file for r in missing.collect()] == ["bar.ml"]
    names = spark.createDataFrame([(x,) for x in [".", "..", "b", "a", "c"]], "n string")
    assert [r.n for r in parsing.catalog_range(names, "n").collect()] == ["a", "b", "c"]
    assert [r.n for r in parsing.catalog_range(names, "n", "b").collect()] == ["b", "c"]
    (tmp_path / "sub").mkdir()
    for f in ("a.ml", "b.txt", "sub/c.ml"):
        (tmp_path / f).write_text("let x = é")
    got = {(r.key, r.text) for r in read_units(spark, [str(tmp_path), str(tmp_path / "b.txt")]).collect()}
    assert got == {("a.ml", "let x = é"), ("b.txt", "let x = é")}
    assert dump_labels(spark.createDataFrame([("d/x", "f")], "source string, def_name string")).first().label == "x:f"


def test_bindings_of_nested_modules(spark):
    leaf = "array<struct<kind:string,name:string,loc_start:int,loc_end:int,ir:string>>"
    schema = f"unit string, prefix string, items array<struct<kind:string,name:string,loc_start:int,loc_end:int,ir:string,items:{leaf}>>"
    rows = [("u", None, [("value", "x", 1, 2, "i", None), ("module", "M", None, None, None, [("value", "y", 3, 4, "j"), ("value", None, 0, 0, "k"), ("eval", "z", 0, 0, "k")]), ("module", None, None, None, None, [("value", "w", 5, 6, "l")])])]
    got = [r.name for r in parsing.explode_bindings(spark.createDataFrame(rows, schema), "items", "prefix", 2).orderBy("ord").collect()]
    assert got == [".x", ".M.y", "..w"]


def test_node_tables(spark):
    rows = [("t", 0, None, 0, "", "Lprim", "p", None), ("t", 1, 0, 0, "arg", "Lvar", "a", None), ("t", 2, 0, 1, "arg", "Lconst", "", None)]
    df = spark.createDataFrame(rows, "tree_id string, node_id int, parent_id int, ord int, role string, kind string, payload string, case_key string")
    assert trees_from_nodes(df).first().ir == '(Lprim "p" (Lvar "a") (Lconst))'
    j = spark.createDataFrame([('{"a": 1}',), ("{",), (None,)], "j string")
    assert [r.ir for r in with_tree(j, "j", "json").collect()] == ['(Lprim "object" (Lprim "a" (Lvar "1")))', None, None]


def test_corpus_report(spark):
    rows = hashed(spark, STRICT, hard(4)).select("label", "weight", "digest", "subs")
    got = {r.view: (r.definitions, r.classes, r.real_classes, r.largest) for r in corpus_report(rows, more_than=0).collect()}
    assert got["all"] == (8, 7, 1, 2) and got["only"] == got["all"] and got["refinement"] == (0, 0, 0, None)


def test_streaming_upsert(spark, tmp_path):
    trees = spark.createDataFrame([(k, v[0]) for k, v in GOLDEN.items()] + [("add2", GOLDEN["add"][0]), ("bad", "(")], "tree_id string, ir string")
    for name, part in (("1", trees.where("tree_id <> 'add2'")), ("2", trees.where("tree_id = 'add2'"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = upsert_stream(stream_trees(spark, str(tmp_path / "in"), trees.schema, 1), str(tmp_path / "db"), str(tmp_path / "rep"), str(tmp_path / "ck"))
        q.awaitTermination()
    assert classes.read_database(spark, str(tmp_path / "db")).count() == 9
    assert {(r.label, tuple(r.names)) for r in spark.read.parquet(str(tmp_path / "rep")).collect()} == {("add2", ("add",))}
