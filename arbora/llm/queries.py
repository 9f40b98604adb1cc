"""The queries of this subpackage and their SQL, where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.components import connected_components
from arbora.llm.handwritten import not_handwritten
from arbora.llm.incremental import History, absorb, best_links, cluster_of_records, cluster_updates, link_batch
from arbora.llm.leaks import find_leaks
from arbora.llm.neardup import near_duplicate_classes, near_duplicates
from arbora.llm.packing import fill_report, pack, token_sizes
from arbora.llm.spam import find_spam
from arbora.sources.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every linked node of `edges` with the smallest node of its component; a null dist is no link."""
    return connected_components(table(spark, sf, "edges").where(F.col("dist").isNotNull()))


def _history(spark: SparkSession, sf: str, clusters: bool = False) -> History:
    return History.build(table(spark, sf, "clone_db").select("entry_id", "weight", "digest", "subs"), "entry_id", 0.7, "clone_db", clusters=clusters)


def _batches(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "main_hash_list").select("hash_id", "batch_no", "weight", "digest", "subs")


def _linked(spark: SparkSession, sf: str, clusters: bool = False):
    return link_batch(_history(spark, sf, clusters), _batches(spark, sf), "hash_id", ["batch_no", "hash_id"], "main_hash_list")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Records of `main_hash_list` that repeat a record of `clone_db` or an earlier accepted record."""
    return _linked(spark, sf).decided.where("found_in is not null").select(F.col("id").alias("hash_id"))


def p2_by_batches(spark: SparkSession, sf: str, together: int = 4) -> DataFrame:
    """The same by deliveries of `together` batches: each opens the stored history, is decided, and is absorbed."""
    path, found = _history(spark, sf).path, None
    batches = _batches(spark, sf)
    numbers = sorted(r[0] for r in batches.select("batch_no").where("batch_no is not null").distinct().collect())
    for delivery, first in enumerate(range(0, len(numbers), together), 1):
        part = batches.where(F.col("batch_no").isin(numbers[first : first + together]))
        linked = link_batch(History.load(spark, path), part, "hash_id", ["batch_no", "hash_id"], "main_hash_list")
        cases = linked.history.scratch.write(linked.decided.where("found_in is not null").select(F.col("id").alias("hash_id")), "cases")
        absorb(linked, delivery)
        found = cases if found is None else found.union(cases)
    return found if found is not None else batches.select("hash_id").where("false")


def p2_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """The cluster of every record of `main_hash_list`, over its own links and those of `clone_db`."""
    linked = _linked(spark, sf, clusters=True)
    return cluster_of_records(linked, cluster_updates(linked)).withColumnRenamed("id", "hash_id")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Files of `units` that were not written by hand for their package."""
    return not_handwritten(table(spark, sf, "units")).select(F.col("id").alias("unit_id"))


def p2_links(spark: SparkSession, sf: str) -> DataFrame:
    """Records of `main_hash_list` with the best record of `clone_db` they nearly repeat."""
    return best_links(_linked(spark, sf)).select(F.col("id").alias("hash_id"), F.substring_index("linked_to", ":", -1).cast("bigint").alias("entry_id"), F.round("sim", 6).alias("sim"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of different records of `fingerprints` with bag similarity of 0.7 or more."""
    pairs = near_duplicates(table(spark, sf, "fingerprints"), "fp_id", "subs", 0.7)
    return pairs.select(F.col("id_a").alias("fp_id_a"), F.col("id_b").alias("fp_id_b"))


def p5_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Records of `fingerprints` with near-duplicates: their class and their number of links, one row per record."""
    found = near_duplicate_classes(table(spark, sf, "fingerprints"), "fp_id", "subs", 0.7)
    return found.select(F.col("id").alias("fp_id"), "class", F.col("links").cast("bigint").alias("links"))


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's place in containers of 2,048 tokens."""
    return pack(token_sizes(table(spark, sf, "documents"), "doc_id", "text"), 2048).withColumnRenamed("id", "doc_id")


def p6_bucket_containers(spark: SparkSession, sf: str) -> DataFrame:
    """The same with batches inside one bucket only, by the method as it is named."""
    return pack(token_sizes(table(spark, sf, "documents"), "doc_id", "text"), 2048, 128, mix=False).withColumnRenamed("id", "doc_id")


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers are, by way of batching."""
    mixed, single = fill_report(p6_containers(spark, sf)), fill_report(p6_bucket_containers(spark, sf))
    return mixed.select(F.lit("mixed").alias("batches"), "*").union(single.select(F.lit("one bucket").alias("batches"), "*"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose spoken text repeats at least 15 words in a row of an evaluation item."""
    found = find_leaks(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "text")
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents where most cues are keyword lists, links or tags."""
    return find_spam(table(spark, sf, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"))


QUERIES = {"p6_containers": p6_containers, "p6_bucket_containers": p6_bucket_containers, "p6_fill": p6_fill, "p4_found": p4_found, "p7_found": p7_found, "p8_found": p8_found, "p1_found": p1_found, "p2_found": p2_found, "p2_links": p2_links, "p2_clusters": p2_clusters, "p2_by_batches": p2_by_batches, "p5_found": p5_found, "p5_classes": p5_classes}

_ACCEPTED = """
        WITH RECURSIVE
        h AS (SELECT hash_id, any_value(batch_no) AS batch_no, any_value(weight) AS weight, any_value(lower(trim(digest, e' \\t\\n\\r'))) AS digest, any_value(subs) AS subs FROM main_hash_list GROUP BY hash_id),
        e AS (SELECT entry_id, any_value(weight) AS weight, any_value(lower(trim(digest, e' \\t\\n\\r'))) AS digest, any_value(subs) AS subs FROM clone_db GROUP BY entry_id),
        hb AS (SELECT hash_id, d, count(*) AS n FROM (SELECT hash_id, lower(trim(s.digest, e' \\t\\n\\r')) AS d FROM (SELECT hash_id, unnest(subs) AS s FROM h)) WHERE d IS NOT NULL GROUP BY 1, 2),
        bags AS (SELECT min(entry_id) AS bag, list_sort(list_transform(subs, lambda s: lower(trim(s.digest, e' \\t\\n\\r')))) AS ds FROM e WHERE len(subs) > 0 GROUP BY 2),
        eb AS (SELECT bag, d, count(*) AS n FROM (SELECT bag, unnest(ds) AS d FROM bags) WHERE d IS NOT NULL GROUP BY 1, 2),
        hw AS (SELECT hash_id, sum(n) AS total FROM hb GROUP BY 1), ew AS (SELECT bag, sum(n) AS total FROM eb GROUP BY 1),
        old AS (SELECT hash_id FROM h WHERE EXISTS (SELECT 1 FROM e WHERE e.weight = h.weight AND e.digest = h.digest)
            UNION SELECT a.hash_id FROM (SELECT hash_id, bag, sum(least(hb.n, eb.n)) AS shared FROM hb JOIN eb USING (d) GROUP BY 1, 2) a JOIN hw USING (hash_id) JOIN ew USING (bag) WHERE shared / (hw.total + ew.total - shared) >= 0.7),
        o AS (SELECT hash_id, row_number() OVER (ORDER BY batch_no, hash_id) AS seq, hash_id IN (SELECT hash_id FROM old) AS is_old FROM h),
        near AS (SELECT x.hash_id AS a, y.hash_id AS b FROM h x JOIN h y ON x.weight = y.weight AND x.digest = y.digest AND x.hash_id <> y.hash_id
            UNION SELECT a, b FROM (SELECT p.hash_id AS a, q.hash_id AS b, sum(least(p.n, q.n)) AS shared FROM hb p JOIN hb q USING (d) WHERE p.hash_id <> q.hash_id GROUP BY 1, 2) JOIN hw u ON u.hash_id = a JOIN hw v ON v.hash_id = b WHERE shared / (u.total + v.total - shared) >= 0.7),
        f AS (SELECT y.hash_id, y.seq, y.is_old, coalesce(list(x.hash_id) FILTER (x.seq < y.seq), []) AS before FROM o y LEFT JOIN near ON near.b = y.hash_id LEFT JOIN o x ON x.hash_id = near.a GROUP BY 1, 2, 3),
        r(seq, accepted) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
            SELECT f.seq, CASE WHEN f.is_old OR list_has_any(r.accepted, f.before) THEN r.accepted ELSE list_append(r.accepted, f.hash_id) END FROM r JOIN f ON f.seq = r.seq + 1)
        SELECT hash_id FROM h WHERE NOT list_contains((SELECT accepted FROM r ORDER BY seq DESC LIMIT 1), hash_id)"""

_SIMILAR = """r AS (SELECT fp_id, any_value(subs) AS subs FROM fingerprints GROUP BY fp_id),
        t AS (SELECT fp_id, lower(trim(s.digest, e' \t\n\r')) AS d, count(*) AS n FROM (SELECT fp_id, unnest(subs) AS s FROM r) WHERE s.digest IS NOT NULL GROUP BY 1, 2),
        w AS (SELECT fp_id, sum(n) AS total FROM t GROUP BY fp_id),
        c AS (SELECT a.fp_id AS fp_id_a, b.fp_id AS fp_id_b, sum(least(a.n, b.n)) AS shared FROM t a JOIN t b ON a.d = b.d AND a.fp_id < b.fp_id GROUP BY 1, 2),
        pairs AS (SELECT fp_id_a, fp_id_b FROM c JOIN w x ON x.fp_id = fp_id_a JOIN w y ON y.fp_id = fp_id_b WHERE shared / (x.total + y.total - shared) >= 0.7)"""

SQL = {
    "p1_found": """
        WITH RECURSIVE e AS (SELECT DISTINCT x, y FROM edges WHERE x IS NOT NULL AND y IS NOT NULL AND dist IS NOT NULL AND x <> y),
        both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
        reach(node, other) AS (SELECT x, x FROM both_ways UNION SELECT r.node, b.y FROM reach r JOIN both_ways b ON r.other = b.x)
        SELECT node, min(other) AS component FROM reach GROUP BY node""",
    # the greedy rule by recursion over the batch's order, with the accepted ids as state
    "p2_found": _ACCEPTED,
    "p2_by_batches": _ACCEPTED,
    "p2_clusters": """
        WITH RECURSIVE
        r AS (SELECT 1000000000000 + hash_id AS c, any_value(weight) AS weight, any_value(lower(trim(digest, e' \\t\\n\\r'))) AS digest, any_value(subs) AS subs FROM main_hash_list GROUP BY hash_id
            UNION ALL SELECT entry_id, any_value(weight), any_value(lower(trim(digest, e' \\t\\n\\r'))), any_value(subs) FROM clone_db GROUP BY entry_id),
        g AS (SELECT c, list_sort(list_filter(list_transform(subs, lambda s: lower(trim(s.digest, e' \\t\\n\\r'))), lambda d: d IS NOT NULL)) AS ds FROM r WHERE len(subs) > 0),
        b AS (SELECT min(c) AS bag, ds, len(ds) AS total FROM g WHERE len(ds) > 0 GROUP BY ds),
        t AS (SELECT bag, total, d, count(*) AS n FROM (SELECT bag, total, unnest(ds) AS d FROM b) GROUP BY 1, 2, 3),
        p AS (SELECT x.bag AS x, y.bag AS y FROM t x JOIN t y ON x.d = y.d AND x.bag < y.bag AND x.total >= 0.7 * y.total AND y.total >= 0.7 * x.total
            GROUP BY x.bag, y.bag, x.total, y.total HAVING sum(least(x.n, y.n)) / (x.total + y.total - sum(least(x.n, y.n))) >= 0.7),
        k AS (SELECT weight, digest, min(c) AS y FROM r WHERE weight IS NOT NULL AND digest IS NOT NULL GROUP BY 1, 2),
        e AS (SELECT x, y FROM p UNION SELECT c, bag FROM g JOIN b USING (ds) WHERE c <> bag UNION SELECT c, y FROM r JOIN k USING (weight, digest) WHERE c <> y),
        w AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
        reach(node, other) AS (SELECT c, c FROM r WHERE c >= 1000000000000 UNION SELECT a.node, w.y FROM reach a JOIN w ON a.other = w.x)
        SELECT node - 1000000000000 AS hash_id, CASE WHEN min(other) < 1000000000000 THEN 'clone_db:' || min(other) ELSE 'main_hash_list:' || (min(other) - 1000000000000) END AS cluster FROM reach GROUP BY node""",
    "p5_found": f"WITH {_SIMILAR} SELECT * FROM pairs",
    "p5_classes": f"""WITH RECURSIVE {_SIMILAR}, both_ways AS (SELECT fp_id_a AS x, fp_id_b AS y FROM pairs UNION SELECT fp_id_b, fp_id_a FROM pairs),
        reach(node, other) AS (SELECT x, x FROM both_ways UNION SELECT r.node, b.y FROM reach r JOIN both_ways b ON r.other = b.x)
        SELECT node AS fp_id, min(other) AS class, CAST((SELECT count(*) FROM both_ways WHERE x = node) AS BIGINT) AS links FROM reach GROUP BY node""",
}
