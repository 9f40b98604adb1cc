"""Queries on complete linkage and dendrograms, with the sequential rule as recursive SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.operators import classes, dendrogram, graph, linkage, stats
from arbora.operators.partition import cluster
from arbora.plans.catalogue import _BAGS, _CLS, _ENTRIES, _HASHES, _REACH, HEAVY, _class_rows, _heavy_bags, _pairs, entries, hashes, query
from arbora.session import Scratch

#: CTEs after ed(x, y, dist) and co(node, component): st and lk, the live edges of every component, one merge a step;
#: mg, the merges. The next merge is the smallest (distance, smaller name, larger name); a tree keeps the name of its
#: smaller half, and an edge to a third tree lives on only if both halves had one.
_LINKAGE = """st AS (SELECT component, list({'d': CAST(dist AS BIGINT), 'x': x, 'y': y, 'nx': CAST(1 AS BIGINT), 'ny': CAST(1 AS BIGINT)}) AS es FROM ed JOIN co ON node = x GROUP BY 1),
    lk(component, es) AS (SELECT component, es FROM st UNION ALL
        SELECT component, list_concat(keep, list_transform(list_filter(list_transform(la, lambda l: {'o': l.o, 'n': l.n, 'd': l.d, 'e': list_filter(lb, lambda r: r.o = l.o)[1].d}), lambda z: z.e IS NOT NULL),
            lambda z: {'d': greatest(z.d, z.e), 'x': least(b.x, z.o), 'y': greatest(b.x, z.o), 'nx': CASE WHEN b.x < z.o THEN b.nx + b.ny ELSE z.n END, 'ny': CASE WHEN b.x < z.o THEN z.n ELSE b.nx + b.ny END})) AS es
        FROM (SELECT component, b, list_filter(es, lambda e: e.x <> b.x AND e.x <> b.y AND e.y <> b.x AND e.y <> b.y) AS keep,
                list_transform(list_filter(es, lambda e: (e.x = b.x AND e.y <> b.y) OR e.y = b.x), lambda e: {'o': CASE WHEN e.x = b.x THEN e.y ELSE e.x END, 'd': e.d, 'n': CASE WHEN e.x = b.x THEN e.ny ELSE e.nx END}) AS la,
                list_transform(list_filter(es, lambda e: (e.y = b.y AND e.x <> b.x) OR e.x = b.y), lambda e: {'o': CASE WHEN e.x = b.y THEN e.y ELSE e.x END, 'd': e.d, 'n': CASE WHEN e.x = b.y THEN e.ny ELSE e.nx END}) AS lb
            FROM (SELECT component, es, list_min(es) AS b FROM lk WHERE len(es) > 0))),
    mg AS (SELECT component, b.x || '+' || (b.nx + b.ny) AS node_id, CASE WHEN b.nx = 1 THEN b.x ELSE b.x || '+' || b.nx END AS left_id, CASE WHEN b.ny = 1 THEN b.y ELSE b.y || '+' || b.ny END AS right_id, b.d AS height, b.nx + b.ny AS n_leaves
        FROM (SELECT component, list_min(es) AS b FROM lk WHERE len(es) > 0))"""


def _roots(merges: str, leaves: str) -> str:
    """CTEs pr(child, parent) and ro(leaf, root) of the leaves named by a query."""
    return f"""pr AS (SELECT left_id AS child, node_id AS parent FROM {merges} UNION ALL SELECT right_id, node_id FROM {merges}),
    up(leaf, cur) AS (SELECT leaf, leaf FROM ({leaves}) UNION ALL SELECT leaf, parent FROM up JOIN pr ON child = cur), ro AS (SELECT leaf, cur AS root FROM up WHERE cur NOT IN (SELECT child FROM pr))"""


_MERGES = f"WITH RECURSIVE {_REACH}, {_LINKAGE}"
_LEAVES = "SELECT node AS leaf FROM co"


def _merges(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The merges of the finite edges and the leaves, one label each."""
    e = Scratch(spark, "pairs").write(_pairs(spark, sf), "pairs")
    merges = Scratch(spark, "merges").write(linkage.complete_linkage(e), "merges")
    return merges, graph.adjacency(e).select(F.col("node").alias("leaf"), F.lit(1).alias("n_labels")).distinct()


@query(f"{_MERGES} SELECT * FROM mg")
def dendrogram_merges(spark: SparkSession, sf: str) -> DataFrame:
    """Complete linkage of the finite edges."""
    return linkage.complete_linkage(_pairs(spark, sf))


@query(f"{_MERGES} SELECT * FROM mg")
def dendrogram_merges_by_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """C5 without a kernel: rounds of reciprocal nearest neighbours."""
    e = Scratch(spark, "pairs").write(_pairs(spark, sf), "pairs")
    comp = graph.components(e).withColumnRenamed("node", "x")
    return linkage.linkage_rounds(e.join(comp, "x").select("component", "x", "y", "dist"))


@query(f"{_MERGES}, low AS (SELECT * FROM mg WHERE height <= 30), {_roots('low', _LEAVES)} SELECT leaf, root AS cluster FROM ro")
def dendrogram_clusters_at_height(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of merges up to height 30."""
    merges, leaves = _merges(spark, sf)
    return dendrogram.cut(merges, leaves.select("leaf"), 30)


_SIZES = f"{_roots('mg', _LEAVES)}, sz AS (SELECT root, CAST(count(*) AS BIGINT) AS label_count, CAST(2 * count(*) - 1 AS BIGINT) AS tree_size, CAST(count(*) AS BIGINT) AS n_leaves FROM ro GROUP BY 1)"


@query(f"{_MERGES}, {_SIZES} SELECT * FROM sz")
def dendrogram_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of all trees of the forest."""
    return dendrogram.forest_sizes(*_merges(spark, sf))


@query(f"{_MERGES}, {_SIZES} SELECT CAST(row_number() OVER (ORDER BY tree_size DESC, root) - 1 AS BIGINT) AS place, root, tree_size FROM sz")
def dendrogram_order(spark: SparkSession, sf: str) -> DataFrame:
    """Trees with neighbours, by size."""
    merges, leaves = _merges(spark, sf)
    return dendrogram.ordered_forest(dendrogram.forest_sizes(merges, leaves), leaves.where("false"))


@query(f"{_MERGES}, {_roots('mg', _LEAVES)}, nd AS (SELECT node_id, height FROM mg), ab(node, above) AS (SELECT child, parent FROM pr UNION ALL SELECT node, parent FROM ab JOIN pr ON child = above) "
       "SELECT node_id AS node, CAST(height + coalesce((SELECT sum(b.height) FROM ab JOIN nd b ON b.node_id = ab.node WHERE ab.above = nd.node_id), 0) + (SELECT count(*) FROM ab WHERE above = nd.node_id AND node NOT IN (SELECT node_id FROM mg)) AS BIGINT) AS value FROM nd")
def dendrogram_fold(spark: SparkSession, sf: str) -> DataFrame:
    """A fold from the leaves up: leaves plus the heights of all inner nodes below and at every inner node."""
    merges, leaves = _merges(spark, sf)
    ones = leaves.select(F.col("leaf").alias("node"), F.lit(1).cast("bigint").alias("value"))
    folded = dendrogram.fold_forest(merges, ones, lambda height, left, right: (left + right + height).cast("bigint"))
    return folded.join(merges.select(F.col("node_id").alias("node")), "node", "left_semi")


@query(f"{_MERGES}, {_roots('mg', _LEAVES)} SELECT root, bool_or(starts_with(leaf, '1')) AS holds FROM ro GROUP BY 1")
def dendrogram_any_leaf(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a tree has a leaf that begins with a 1, over rewritten leaves."""
    merges, leaves = _merges(spark, sf)
    labelled = dendrogram.map_leaves(leaves.select("leaf", F.col("leaf").alias("label")), F.substring("label", 1, 1))
    return dendrogram.any_leaf(merges, labelled, F.col("label") == "1")


@query(f"{_MERGES}, {_SIZES}, tops AS (SELECT root, row_number() OVER (ORDER BY tree_size DESC, root) - 1 AS k FROM sz QUALIFY k < 5), "
       "pt(k, node, path, depth) AS (SELECT k, root, '', 1 FROM tops UNION ALL SELECT k, unnest([left_id, right_id]), path || unnest(['0', '1']), depth + 1 FROM pt JOIN mg ON node_id = node), "
       "li AS (SELECT k, '' AS path, 0 AS first, 'Class ' || k || ':' AS line FROM tops UNION ALL SELECT k, path, 1, repeat(' ', depth) || CASE WHEN node_id IS NULL THEN node || ' ' ELSE 'Node ' || height || ':' END FROM pt LEFT JOIN mg ON node_id = node) "
       "SELECT CAST(row_number() OVER (ORDER BY k, first, path) - 1 AS BIGINT) AS number, line FROM li")
def dendrogram_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The five largest trees, written, read again and printed."""
    merges, leaves = _merges(spark, sf)
    path = f"{Scratch(spark, 'forest').root}/forest"
    dendrogram.write_forest(merges, leaves.select("leaf", F.col("leaf").alias("label")), path)
    merges, labelled = dendrogram.read_forest(spark, path)
    tops = dendrogram.forest_sizes(merges, leaves).orderBy(F.desc("tree_size"), "root").limit(5).select("root").collect()
    lines = dendrogram.print_forest(merges, labelled, [r[0] for r in tops])
    return spark.createDataFrame(list(enumerate(lines)), "number bigint, line string")


# ---- from fingerprints to dendrograms ----------------------------------------------------------------------------

_CLUSTER = f"""WITH RECURSIVE {_BAGS}, rw AS (SELECT fp_id, label, weight, digest, lpad(CAST(weight AS VARCHAR), 19, '0') || '-' || digest AS leaf FROM fp WHERE digest IS NOT NULL AND label IS NOT NULL AND subs IS NOT NULL),
    fi AS (SELECT leaf, min(fp_id) AS fp_id FROM rw GROUP BY 1), o AS (SELECT leaf, s.digest, s.weight, count(*) AS n FROM s JOIN fi USING (fp_id) WHERE s.weight > {HEAVY} GROUP BY 1, 2, 3),
    w AS (SELECT leaf, sum(weight * n) AS total FROM o GROUP BY 1), c AS (SELECT a.leaf AS x, b.leaf AS y, sum(a.weight * least(a.n, b.n)) AS common FROM o a JOIN o b ON a.digest = b.digest AND a.weight = b.weight AND a.leaf < b.leaf GROUP BY 1, 2),
    ed AS (SELECT x, y, CAST(p.total + q.total - 2 * common AS BIGINT) AS dist FROM c JOIN w p ON p.leaf = x JOIN w q ON q.leaf = y),
    bw AS (SELECT x, y FROM ed UNION SELECT y, x FROM ed), reach(node, other) AS (SELECT x, x FROM bw UNION SELECT r.node, b.y FROM reach r JOIN bw b ON r.other = b.x), co AS (SELECT node, min(other) AS component FROM reach GROUP BY node), {_LINKAGE}, {_roots('mg', 'SELECT DISTINCT leaf FROM rw')}"""


def _clusters(spark: SparkSession, sf: str):
    return cluster(_heavy_bags(spark, sf).where("digest is not null and label is not null"), order="fp_id")


@query(f"{_CLUSTER} SELECT root, CAST(count(*) AS BIGINT) AS label_count, CAST(count(*) + count(DISTINCT leaf) - 1 AS BIGINT) AS tree_size, CAST(count(DISTINCT leaf) AS BIGINT) AS n_leaves FROM ro JOIN rw USING (leaf) GROUP BY 1")
def cluster_end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints to dendrograms; the roots with their sizes."""
    c = _clusters(spark, sf)
    return dendrogram.forest_sizes(c.merges, c.leaves.groupBy("leaf").agg(F.count("label").alias("n_labels")))


@query(f"""{_CLUSTER}, sz AS (SELECT root, count(*) + count(DISTINCT leaf) - 1 AS tree_size FROM ro JOIN rw USING (leaf) GROUP BY 1), tr AS (SELECT *, root IN (SELECT node FROM co) OR root IN (SELECT node_id FROM mg) AS near FROM sz)
    SELECT CAST(row_number() OVER (ORDER BY near DESC, CASE WHEN near THEN -tree_size END, CASE WHEN near THEN root END, root DESC) - 1 AS BIGINT) AS place, root, CAST(tree_size AS BIGINT) AS tree_size FROM tr""")
def cluster_order(spark: SparkSession, sf: str) -> DataFrame:
    """Trees with neighbours by size, then those without any by name downwards."""
    c = _clusters(spark, sf)
    n = c.leaves.groupBy("leaf").agg(F.count("label").alias("n_labels"))
    alone = c.alone.join(n, "leaf")
    return dendrogram.ordered_forest(dendrogram.forest_sizes(c.merges, n.join(c.alone, "leaf", "left_anti")), alone)


# ---- the database and its classes ---------------------------------------------------------------------------------

@query(f"""WITH {_ENTRIES}, {_HASHES}, d AS (SELECT weight, digest, label FROM e UNION ALL SELECT weight, digest, label FROM h), m AS (SELECT * FROM d WHERE label IS NOT NULL AND (weight, digest) IN (SELECT (weight, digest) FROM h WHERE digest IS NOT NULL AND weight IS NOT NULL)),
    r AS (SELECT *, (row_number() OVER (PARTITION BY weight, digest ORDER BY label) - 1) // 1000 AS chunk FROM m) SELECT weight, digest, chunk, string_agg(label, chr(10) || '* ' ORDER BY label) AS names FROM r GROUP BY 1, 2, 3""")
def clone_name_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The names of every analysed fingerprint in the database with the definitions added, once per fingerprint, in chunks."""
    own = hashes(spark, sf)
    found = classes.name_lists(own, classes.upsert(entries(spark, sf), own))
    return found.select("weight", "digest", "chunk", F.array_join("names", "\n* ").alias("names"))


@query(f"""WITH {_CLS}, tp AS (SELECT cls, count(*) AS size FROM c GROUP BY 1 ORDER BY size DESC, cls LIMIT 10), r AS (SELECT cls, size, label, row_number() OVER (PARTITION BY cls ORDER BY md5(label || '42'), label) AS place FROM c JOIN tp USING (cls))
    SELECT cls, CAST(size AS BIGINT) AS size, CAST(place AS BIGINT) AS place, label FROM r WHERE place <= 5""")
def first_classes(spark: SparkSession, sf: str) -> DataFrame:
    """F8: the ten largest classes with up to five labels each, in seeded order."""
    rows = Scratch(spark, "first").write(_class_rows(spark, sf), "rows")
    top = stats.top_classes(stats.class_sizes(rows), 10)
    return stats.representatives(rows.join(F.broadcast(top.select("cls")), "cls"), 5).join(top, "cls").select("cls", "size", "place", "label")
