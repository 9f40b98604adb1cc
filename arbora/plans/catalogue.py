"""The catalogue of queries over the driver's tables, each with its SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.functions.scalars import clean_digest, once, package_prefix, strip_version
from arbora.model import LOOSE, STRICT, Config, hard, percent
from arbora.operators import classes, dendrogram, distance, fingerprint, graph, linkage, parsing, skew, stats
from arbora.operators.partition import accept_reject, cluster, with_representative
from arbora.plans.pipelines import clone_lookup, corpus_report
from arbora.session import Scratch
from arbora.sources.files import dump_labels
from arbora.sources.nested import lines_of
from arbora.sources.tables import table
from arbora.streaming.upsert import upsert_stream

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- the tables, cleaned -------------------------------------------------------------------------------------

_CLEAN = "lower(trim({}, e' \\t\\n\\r'))"
_ENTRIES = f"e AS (SELECT entry_id, any_value(label) AS label, any_value(weight) AS weight, any_value({_CLEAN.format('digest')}) AS digest, any_value(built_at) AS built_at FROM clone_db GROUP BY entry_id)"
_FP = f"fp AS (SELECT fp_id, any_value(label) AS label, any_value(weight) AS weight, any_value({_CLEAN.format('digest')}) AS digest, any_value(subs) AS subs FROM fingerprints GROUP BY fp_id)"
_BAGS = f"{_FP}, s AS (SELECT fp_id, weight AS main, u.weight AS weight, {_CLEAN.format('u.digest')} AS digest FROM (SELECT fp_id, weight, unnest(subs) AS u FROM fp))"
_HASHES = f"h AS (SELECT hash_id, any_value(label) AS label, any_value(loc_start) AS loc_start, any_value(loc_end) AS loc_end, any_value(weight) AS weight, any_value({_CLEAN.format('digest')}) AS digest FROM main_hash_list GROUP BY hash_id)"
_TREES = "t AS (SELECT tree_id, any_value(def_name) AS def_name, any_value(source) AS source, any_value(loc_start) AS loc_start, any_value(loc_end) AS loc_end, any_value(ir) AS ir FROM trees GROUP BY tree_id)"
_UNITS = "un AS (SELECT unit_id, any_value(unit_key) AS unit_key, any_value(source) AS source, any_value(text) AS text, any_value(ord) AS ord FROM units GROUP BY unit_id)"
#: Distances are taken over sub-trees heavier than this: light ones are shared by most trees.
HEAVY = 12


def entries(spark: SparkSession, sf: str) -> DataFrame:
    return once(table(spark, sf, "clone_db").select("entry_id", "label", "weight", clean_digest("digest").alias("digest"), "built_at"), "entry_id")


def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = F.transform("subs", lambda s: F.struct(s["weight"].alias("weight"), clean_digest(s["digest"]).alias("digest")))
    return once(table(spark, sf, "fingerprints").select("fp_id", "label", "weight", clean_digest("digest").alias("digest"), cleaned.alias("subs")), "fp_id")


def hashes(spark: SparkSession, sf: str) -> DataFrame:
    return once(table(spark, sf, "main_hash_list").select("hash_id", "label", "loc_start", "loc_end", "weight", clean_digest("digest").alias("digest")), "hash_id")


def trees(spark: SparkSession, sf: str) -> DataFrame:
    return once(table(spark, sf, "trees"), "tree_id")


def units(spark: SparkSession, sf: str) -> DataFrame:
    return once(table(spark, sf, "units").select("unit_id", "unit_key", "source", "text", "ord"), "unit_id")


def _heavy_bags(spark: SparkSession, sf: str) -> DataFrame:
    fp = fingerprints(spark, sf).where("subs is not null")
    return fp.withColumn("subs", fingerprint.kept_subs(F.col("subs"), F.col("weight"), hard(HEAVY)))


# ---- skew (the general operator) -----------------------------------------------------------------------------

@query(f"WITH {_ENTRIES} SELECT weight, digest FROM e WHERE digest IS NOT NULL GROUP BY weight, digest HAVING count(*) * 50 >= (SELECT count(*) FROM e)")
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Keys (weight, digest) that hold at least 2 % of the distinct records of clone_db."""
    return skew.heavy_keys(entries(spark, sf).select("entry_id", "weight", "digest"), ["weight", "digest"], ["entry_id"], chunk_rows=10_000).select("weight", "digest")


@query(f"""WITH {_ENTRIES}, g AS (SELECT *, built_at - lag(built_at) OVER (PARTITION BY weight, digest ORDER BY built_at, entry_id) > INTERVAL 1 HOUR AS broke FROM e WHERE digest IS NOT NULL AND built_at IS NOT NULL)
    SELECT weight, digest, CAST(count(*) AS BIGINT) AS n, min(built_at) AS first_at, max(built_at) AS last_at, CAST(count(*) FILTER (broke) + 1 AS BIGINT) AS bursts FROM g GROUP BY weight, digest""")
def p3_key_bursts(spark: SparkSession, sf: str) -> DataFrame:
    """Per key of clone_db: records, first and last build, bursts of builds no more than an hour apart."""
    return skew.key_bursts(entries(spark, sf).where("digest is not null").select("entry_id", "weight", "digest", "built_at"), ["weight", "digest"], "built_at", "entry_id", chunk_rows=20_000)


# ---- fingerprints (H, N) -------------------------------------------------------------------------------------

_LINES = "l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), 1) - 1 AS ord FROM documents WHERE text IS NOT NULL)"


@query(f"WITH {_LINES} SELECT md5(line) AS digest, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY 1")
def leaf_fingerprint_lines(spark: SparkSession, sf: str) -> DataFrame:
    """H1, A4: digests of lines with counts."""
    lines = lines_of(table(spark, sf, "documents").where("text is not null"), "doc_id", "text")
    return lines.groupBy(fingerprint.leaf_digest(F.col("line")).alias("digest")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.lit(1).cast("bigint").alias("weight"), fingerprint.leaf_digest(F.col("l_partkey")).alias("digest"))


@query("""SELECT l_orderkey AS orderkey, CAST(1 + count(*) AS BIGINT) AS weight, md5(unhex(string_agg(d, '' ORDER BY d))) AS digest FROM
    (SELECT l_orderkey, md5(CAST(l_partkey AS VARCHAR)) AS d FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, md5('order') FROM lineitem) GROUP BY 1""".replace("1 + count(*)", "count(*)"))
def order_tree_fp_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """H2, Q1: commutative fingerprints of orders over their items, the label sorted among them."""
    return fingerprint.roll_up(_items(spark, sf), ["l_orderkey"], label="order").withColumnRenamed("l_orderkey", "orderkey")


@query(f"""WITH {_LINES} SELECT doc_id, CAST(count(*) + 1 AS BIGINT) AS weight, md5(unhex(md5('doc') || string_agg(md5(line), '' ORDER BY ord))) AS digest FROM l GROUP BY doc_id""")
def document_tree_fp_ordered(spark: SparkSession, sf: str) -> DataFrame:
    """H2: documents as ordered lists of lines, labelled."""
    lines = lines_of(table(spark, sf, "documents").where("text is not null"), "doc_id", "text").select("doc_id", "ord", F.lit(1).cast("bigint").alias("weight"), fingerprint.leaf_digest(F.col("line")).alias("digest"))
    return fingerprint.roll_up(lines, ["doc_id"], label="doc", order=["ord"])


@query(f"""WITH {_LINES} SELECT doc_id, CAST(count(*) + 1 AS BIGINT) AS weight, md5(unhex(string_agg(md5(line), '' ORDER BY ord DESC))) AS digest FROM l GROUP BY doc_id""")
def document_tree_fp_reversed(spark: SparkSession, sf: str) -> DataFrame:
    """H3, H4: the anonymous list, hashed from the last to the first."""
    lines = lines_of(table(spark, sf, "documents").where("text is not null"), "doc_id", "text").select("doc_id", "ord", F.lit(1).cast("bigint").alias("weight"), fingerprint.leaf_digest(F.col("line")).alias("digest"))
    return fingerprint.roll_up(lines, ["doc_id"], order=["ord"], reverse=True)


@query("""WITH o AS (SELECT l_orderkey, 1 + count(*) AS w, md5(unhex(string_agg(md5(CAST(l_partkey AS VARCHAR)), '' ORDER BY md5(CAST(l_partkey AS VARCHAR))))) AS d FROM lineitem GROUP BY 1)
    SELECT o_custkey AS custkey, CAST(1 + sum(w) AS BIGINT) AS weight, md5(unhex(string_agg(d, '' ORDER BY d))) AS digest FROM o JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def customer_tree_fp_3level(spark: SparkSession, sf: str) -> DataFrame:
    """Customer over orders over items, one aggregation per level."""
    per_order = fingerprint.roll_up(_items(spark, sf), ["l_orderkey"])
    owned = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("custkey")).join(per_order, "l_orderkey")
    return fingerprint.roll_up(owned, ["custkey"])


@query("""WITH s AS (SELECT s_nationkey, count(*) + 1 AS w, md5(unhex(string_agg(md5(s_name), '' ORDER BY md5(s_name)))) AS d FROM supplier GROUP BY 1),
    n AS (SELECT n_regionkey, w, d FROM nation JOIN s ON s_nationkey = n_nationkey)
    SELECT r_name AS region, CAST(sum(w) + 1 AS BIGINT) AS weight, md5(unhex(string_agg(d, '' ORDER BY d))) AS digest FROM n JOIN region ON r_regionkey = n_regionkey GROUP BY 1""")
def region_tree_fp(spark: SparkSession, sf: str) -> DataFrame:
    """H2: region over nations over suppliers."""
    s = table(spark, sf, "supplier").select("s_nationkey", F.lit(1).cast("bigint").alias("weight"), F.md5("s_name").alias("digest"))
    n = fingerprint.roll_up(s, ["s_nationkey"]).join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_regionkey", "weight", "digest")
    return fingerprint.roll_up(n, ["n_regionkey"]).join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("region"), "weight", "digest")


@query("SELECT l_linenumber AS line, l_partkey AS part, md5(encode(CAST(l_linenumber AS VARCHAR)) || unhex(md5(CAST(l_partkey AS VARCHAR)))) AS digest FROM lineitem")
def case_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """H5: a switch case is its key followed by the raw digest of its body."""
    i = table(spark, sf, "lineitem")
    return i.select(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), fingerprint.case_digest(F.col("l_linenumber"), fingerprint.leaf_digest(F.col("l_partkey"))).alias("digest"))


@query(f"WITH {_BAGS} SELECT fp_id, weight, digest, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1, 2, 3")
def subtree_bag(spark: SparkSession, sf: str) -> DataFrame:
    """Bags with multiplicity."""
    return distance.occurrences(fingerprints(spark, sf), "fp_id").select(F.col("parent").alias("fp_id"), "weight", "digest", "n")


@query(f"WITH {_BAGS} SELECT fp_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(weight) AS BIGINT) AS total FROM s WHERE weight > 10 GROUP BY 1")
def threshold_hard(spark: SparkSession, sf: str) -> DataFrame:
    """Sub-trees strictly heavier than 10."""
    fp = fingerprints(spark, sf).where("subs is not null").withColumn("k", fingerprint.kept_subs(F.col("subs"), F.col("weight"), hard(10)))
    return fp.where(F.size("k") > 0).select("fp_id", F.size("k").cast("bigint").alias("n"), F.aggregate("k", F.lit(0).cast("bigint"), lambda a, s: a + s["weight"]).alias("total"))


@query(f"WITH {_BAGS} SELECT fp_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(weight) AS BIGINT) AS total FROM s WHERE weight > (30 / 100.0) * main GROUP BY 1")
def threshold_percent(spark: SparkSession, sf: str) -> DataFrame:
    """Sub-trees strictly heavier than 30 % of the whole."""
    fp = fingerprints(spark, sf).where("subs is not null").withColumn("k", fingerprint.kept_subs(F.col("subs"), F.col("weight"), percent(30)))
    return fp.where(F.size("k") > 0).select("fp_id", F.size("k").cast("bigint").alias("n"), F.aggregate("k", F.lit(0).cast("bigint"), lambda a, s: a + s["weight"]).alias("total"))


def _main_fingerprints(spark: SparkSession, sf: str, config: Config) -> DataFrame:
    """Hashed before deduplication, so that the shuffle moves fingerprints and no trees."""
    hashed = fingerprint.fingerprint_trees(table(spark, sf, "trees").select("tree_id", "ir"), "ir", config, with_subs=False)
    return once(hashed.where("error is null").select("tree_id", "weight", "digest"), "tree_id")


@query(f"WITH {_TREES}, {_FP.replace('fp_id, any_value(label)', 'fp_id, any_value(tree_id) AS tree_id, any_value(label)')} SELECT t.tree_id, fp.weight, fp.digest FROM t JOIN fp USING (tree_id) WHERE t.ir IS NOT NULL AND fp.digest IS NOT NULL")
def tree_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """The kernel over trees; it must give what the table of fingerprints holds."""
    hashed = _main_fingerprints(spark, sf, STRICT)
    known = once(table(spark, sf, "fingerprints").where("digest is not null").select("fp_id", "tree_id"), "fp_id").select("tree_id")
    return hashed.join(known, "tree_id", "left_semi").select("tree_id", "weight", "digest")


@query(f"""WITH {_TREES}, f AS (SELECT tree_id, any_value(subs) AS subs FROM fingerprints WHERE subs IS NOT NULL AND digest IS NOT NULL GROUP BY 1), u AS (SELECT tree_id, unnest(subs) AS s FROM f)
    SELECT tree_id, s.weight AS weight, {_CLEAN.format('s.digest')} AS digest, CAST(count(*) AS BIGINT) AS n FROM u JOIN t USING (tree_id) WHERE t.ir IS NOT NULL GROUP BY 1, 2, 3""")
def tree_bags(spark: SparkSession, sf: str) -> DataFrame:
    """The kernel's bags above weight 1."""
    hashed = fingerprint.fingerprint_trees(trees(spark, sf).select("tree_id", "ir"), "ir", STRICT, hard(1)).where("error is null")
    known = once(table(spark, sf, "fingerprints").where("digest is not null and subs is not null").select("fp_id", "tree_id"), "fp_id").select("tree_id")
    return distance.occurrences(hashed.join(known, "tree_id", "left_semi"), "tree_id").select(F.col("parent").alias("tree_id"), "weight", "digest", "n")


@query()
def loose_tree_classes(spark: SparkSession, sf: str) -> DataFrame:
    """H9, Q1, A1: classes of trees by commutative fingerprints without identifiers."""
    hashed = _main_fingerprints(spark, sf, LOOSE)
    return hashed.groupBy("weight", "digest").agg(F.count(F.lit(1)).cast("bigint").alias("n")).where("n > 1")


@query("SELECT n_items AS items, CAST(count(*) AS BIGINT) AS n FROM (SELECT l_orderkey, count(*) AS n_items FROM lineitem GROUP BY 1) GROUP BY 1")
def id_insensitive_classes(spark: SparkSession, sf: str) -> DataFrame:
    """H9: with identifiers masked, orders fall into classes by the number of their items."""
    masked = table(spark, sf, "lineitem").select("l_orderkey", F.lit(1).cast("bigint").alias("weight"), fingerprint.variable_digest(F.col("l_partkey"), hash_var=False).alias("digest"))
    shapes = fingerprint.roll_up(masked, ["l_orderkey"])
    return shapes.groupBy("digest").agg((F.first("weight") - 1).alias("items"), F.count(F.lit(1)).cast("bigint").alias("n")).select("items", "n")


@query(f"WITH {_TREES} SELECT tree_id, ir AS normal FROM t WHERE ir IS NOT NULL")
def inline_lets(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised trees as text; the table's trees are in normal form already, so each must come out as it is."""
    return fingerprint.normalised_text(trees(spark, sf).where("ir is not null").select("tree_id", "ir"), "ir", "normal").select("tree_id", "normal")


@query()
def html_dom_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with markup, parsed as HTML and hashed."""
    rows = table(spark, sf, "documents").where("text is not null").select("doc_id", "text")
    return fingerprint.fingerprint_trees(rows, "text", STRICT, kind="html", with_subs=False).where("error is null").select("doc_id", "weight", "digest")


@query("""WITH v AS (SELECT event_id, coalesce(props->'k', 'null') AS j FROM events WHERE props IS NOT NULL), x AS (SELECT event_id, md5(CAST(j AS VARCHAR)) AS leaf FROM v),
    k AS (SELECT event_id, md5(unhex(md5('Lprim') || md5('k') || md5(unhex(leaf)))) AS d FROM x)
    SELECT event_id, CAST(7 AS BIGINT) AS weight, md5(unhex(md5('Lprim') || md5('object') || md5(unhex(d)))) AS digest FROM k""")
def json_tree_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """JSON objects as trees."""
    rows = table(spark, sf, "events").where("props is not null").select("event_id", "props")
    return fingerprint.fingerprint_trees(rows, "props", STRICT, kind="json", with_subs=False).where("error is null").select("event_id", "weight", "digest")


_SPACE = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents WHERE text IS NOT NULL),
    w AS (SELECT doc_id, ord, list_filter(regexp_split_to_array(line, '{_SPACE}'), lambda x: x <> '') AS words FROM l),
    n AS (SELECT doc_id, ord, len(words) + 3 AS weight, md5(unhex(md5('Lprim') || md5('line') || md5(unhex(array_to_string(list_transform(list_reverse(words), lambda x: md5(x)), ''))))) AS d FROM w WHERE len(words) > 0),
    t AS (SELECT doc_id, sum(weight) AS weight, string_agg(d, '' ORDER BY ord DESC) AS ds FROM n GROUP BY 1)
    SELECT doc_id, CAST(3 + coalesce(t.weight, 0) AS BIGINT) AS weight, md5(unhex(md5('Lprim') || md5('text') || md5(unhex(coalesce(ds, ''))))) AS digest FROM documents LEFT JOIN t USING (doc_id) WHERE text IS NOT NULL""")
def text_tree_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as lines of tokens, hashed by the kernel."""
    rows = table(spark, sf, "documents").where("text is not null").select("doc_id", "text")
    return fingerprint.fingerprint_trees(rows, "text", STRICT, kind="text", with_subs=False).where("error is null").select("doc_id", "weight", "digest")


# ---- classes and look-ups (A, J5, K) ---------------------------------------------------------------------------

@query(f"WITH {_FP} SELECT weight, digest, label, CAST(count(*) OVER (PARTITION BY weight, digest) AS BIGINT) AS n FROM fp WHERE digest IS NOT NULL AND label IS NOT NULL QUALIFY n > 1")
def exact_classes(spark: SparkSession, sf: str) -> DataFrame:
    """A1: members of the classes of several labels."""
    return classes.exact_classes(fingerprints(spark, sf).where("digest is not null and label is not null"))


@query(f"""WITH {_FP}, r AS (SELECT weight, digest, label, count(*) OVER (PARTITION BY weight, digest) AS n, (row_number() OVER (PARTITION BY weight, digest ORDER BY label) - 1) // 10000 AS chunk FROM fp WHERE digest IS NOT NULL AND label IS NOT NULL)
    SELECT weight, digest, chunk, string_agg(label, '|' ORDER BY label) AS labels FROM r WHERE n > 1 GROUP BY 1, 2, 3""")
def class_label_lists(spark: SparkSession, sf: str) -> DataFrame:
    """A1, A2: classes as lists, of more than 10,000 members in chunks of label order."""
    rows = classes.exact_classes(fingerprints(spark, sf).where("digest is not null and label is not null"))
    return classes.class_chunks(rows).select("weight", "digest", "chunk", F.array_join("labels", "|").alias("labels"))


@query(f"""WITH {_FP}, f AS (SELECT weight, digest, min(fp_id) AS fp_id FROM fp WHERE digest IS NOT NULL AND subs IS NOT NULL GROUP BY 1, 2)
    SELECT weight, digest, CAST(len(subs) AS BIGINT) AS n FROM f JOIN fp USING (fp_id, weight, digest)""")
def first_bags(spark: SparkSession, sf: str) -> DataFrame:
    """A3: one bag per main fingerprint, the first row's."""
    rows = fingerprints(spark, sf).where("digest is not null and subs is not null")
    return classes.first_bag(rows, "fp_id").select("weight", "digest", F.size("subs").cast("bigint").alias("n"))


@query(f"WITH {_ENTRIES}, {_HASHES} SELECT hash_id, weight, digest FROM h WHERE EXISTS (SELECT 1 FROM e WHERE e.weight = h.weight AND e.digest = h.digest AND e.label <> h.label)")
def clone_db_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Definitions whose fingerprint the database has under another label; the class stands for its labels."""
    return classes.clone_report(hashes(spark, sf), entries(spark, sf), ["hash_id", "weight", "digest"], limit=0).select("hash_id", "weight", "digest")


@query(f"""WITH {_ENTRIES}, {_HASHES}, m AS (SELECT hash_id, h.label AS label, e.label AS other FROM h JOIN e USING (weight, digest) WHERE h.label <> e.label),
    r AS (SELECT *, row_number() OVER (PARTITION BY hash_id, label ORDER BY other) AS k, count(*) OVER (PARTITION BY hash_id, label) AS n FROM m)
    SELECT hash_id, label, CAST(n AS BIGINT) AS n_matches, string_agg(other, '|' ORDER BY other) AS names FROM r WHERE k <= 10 GROUP BY 1, 2, 3""")
def clone_report_limited(spark: SparkSession, sf: str) -> DataFrame:
    """The number of all matches and the first ten names."""
    own = hashes(spark, sf).select("hash_id", "label", "weight", "digest")
    return classes.clone_report(own, entries(spark, sf), ["hash_id", "label"]).withColumn("names", F.array_join("names", "|"))


@query(f"""WITH {_HASHES}, m AS (SELECT a.hash_id, a.loc_start, a.loc_end, b.label AS other FROM h a JOIN h b ON a.weight = b.weight AND a.digest = b.digest WHERE a.label <> b.label AND a.loc_end IS NOT NULL)
    SELECT hash_id, CAST(loc_start AS VARCHAR) || ';' || CAST(loc_end AS VARCHAR) || ';* ' || string_agg(other, chr(10) || '* ' ORDER BY other) || '#' AS record FROM m GROUP BY hash_id, loc_start, loc_end""")
def clone_machine_records(spark: SparkSession, sf: str) -> DataFrame:
    """K5, Q16: machine records of the duplicates inside the analysed definitions; a record holds all names, by its contract."""
    own = hashes(spark, sf)
    m = classes.clone_matches(own.where("loc_end is not null"), own.where("digest is not null"))
    named = m.groupBy("hash_id", "loc_start", "loc_end").agg(F.sort_array(F.collect_list("other")).alias("names"))
    return named.select("hash_id", classes.machine_record(F.col("loc_start"), F.col("loc_end"), F.col("names")).alias("record"))


@query(f"""WITH {_ENTRIES}, {_HASHES}, d AS (SELECT weight, digest, label FROM e UNION ALL SELECT weight, digest, label FROM h), m AS (SELECT hash_id, h.label AS label, d.label AS other FROM h JOIN d USING (weight, digest) WHERE h.label <> d.label),
    r AS (SELECT *, row_number() OVER (PARTITION BY hash_id, label ORDER BY other) AS k, count(*) OVER (PARTITION BY hash_id, label) AS n FROM m)
    SELECT hash_id, label, CAST(n AS BIGINT) AS n_matches, string_agg(other, '|' ORDER BY other) AS names FROM r WHERE k <= 3 GROUP BY 1, 2, 3""")
def entry_b_clone_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Entry B: new definitions, looked up in the database with themselves added."""
    found = clone_lookup(hashes(spark, sf).select("hash_id", "label", "weight", "digest"), entries(spark, sf), ["hash_id", "label"], 3)
    return found.withColumn("names", F.array_join("names", "|"))


@query(f"WITH {_ENTRIES} SELECT weight, digest, CAST(count(*) AS BIGINT) AS n FROM e WHERE digest IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2")
def database_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The database written and read again."""
    path = f"{Scratch(spark, 'database').root}/classes"
    classes.write_database(entries(spark, sf).where("digest is not null and label is not null"), path)
    return classes.read_database(spark, path).groupBy("weight", "digest").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@query(f"WITH {_TREES}, {_FP.replace('fp_id, any_value(label)', 'fp_id, any_value(tree_id) AS tree_id, any_value(label)')} SELECT t.tree_id AS label, fp.weight, fp.digest FROM t JOIN fp USING (tree_id) WHERE t.ir IS NOT NULL AND fp.digest IS NOT NULL")
def streaming_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A7 as a stream: trees appended to a database batch by batch, each batch with its clone report; the database."""
    root = Scratch(spark, "stream").root
    trees(spark, sf).select("tree_id", "ir").repartition(3).write.parquet(f"{root}/in")
    incoming = spark.readStream.schema("tree_id string, ir string").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    upsert_stream(incoming, f"{root}/db", f"{root}/reports", f"{root}/ck").awaitTermination()
    known = once(table(spark, sf, "fingerprints").where("digest is not null").select("fp_id", F.col("tree_id").alias("label")), "fp_id").select("label")
    return classes.read_database(spark, f"{root}/db").join(known, "label", "left_semi")


# ---- distances and graph (A5, A6, J1-J4, C) --------------------------------------------------------------------

_OCC = f"{_BAGS}, o AS (SELECT digest, weight, fp_id, count(*) AS n FROM s WHERE weight > {HEAVY} GROUP BY 1, 2, 3)"
_COMMON = f"{_OCC}, c AS (SELECT a.fp_id AS x, b.fp_id AS y, CAST(sum(a.weight * least(a.n, b.n)) AS BIGINT) AS common FROM o a JOIN o b ON a.digest = b.digest AND a.weight = b.weight AND a.fp_id < b.fp_id GROUP BY 1, 2)"
_DIST = f"{_COMMON}, w AS (SELECT fp_id, CAST(sum(weight * n) AS BIGINT) AS total FROM o GROUP BY 1), d AS (SELECT x, y, p.total + q.total - 2 * common AS dist FROM c JOIN w p ON p.fp_id = x JOIN w q ON q.fp_id = y)"


@query(f"WITH {_OCC} SELECT digest, weight, CAST(count(*) AS BIGINT) AS parents, CAST(sum(n) AS BIGINT) AS n FROM o GROUP BY 1, 2")
def subtree_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    """A5: the inverted index, summed up per sub-tree."""
    occ = distance.occurrences(_heavy_bags(spark, sf), "fp_id")
    return occ.groupBy("digest", "weight").agg(F.count(F.lit(1)).cast("bigint").alias("parents"), F.sum("n").cast("bigint").alias("n"))


@query(f"WITH {_OCC} SELECT fp_id, CAST(sum(weight * n) AS BIGINT) AS total FROM o GROUP BY 1")
def total_weights(spark: SparkSession, sf: str) -> DataFrame:
    """A6."""
    return distance.total_weights(distance.occurrences(_heavy_bags(spark, sf), "fp_id")).withColumnRenamed("parent", "fp_id")


@query(f"WITH {_COMMON} SELECT * FROM c")
def common_weight(spark: SparkSession, sf: str) -> DataFrame:
    """J1."""
    return distance.common_weights(distance.occurrences(_heavy_bags(spark, sf), "fp_id"))


@query(f"WITH {_DIST} SELECT * FROM d")
def symmetric_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Finite distances."""
    return distance.symmetric_differences(_heavy_bags(spark, sf), "fp_id")


@query("""WITH o AS (SELECT l_orderkey AS k, l_partkey AS p, count(*) AS n FROM lineitem GROUP BY 1, 2), w AS (SELECT k, sum(n) AS total FROM o GROUP BY 1),
    c AS (SELECT a.k AS x, b.k AS y, sum(least(a.n, b.n)) AS common FROM o a JOIN o b ON a.p = b.p AND a.k < b.k GROUP BY 1, 2)
    SELECT CAST(u.total + v.total - 2 * common AS BIGINT) AS dist, CAST(count(*) AS BIGINT) AS n FROM c JOIN w u ON u.k = x JOIN w v ON v.k = y GROUP BY 1""")
def order_distance_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Distances of all orders that share a part, by distance."""
    items = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("digest"), F.col("l_orderkey").alias("parent")).agg(F.count(F.lit(1)).alias("n")).select("digest", F.lit(1).cast("bigint").alias("weight"), "parent", "n")
    total = distance.total_weights(items)
    tx, ty = total.select(F.col("parent").alias("x"), F.col("total").alias("wx")), total.select(F.col("parent").alias("y"), F.col("total").alias("wy"))
    d = distance.common_weights(items).join(tx, "x").join(ty, "y")
    return d.groupBy((F.col("wx") + F.col("wy") - 2 * F.col("common")).cast("bigint").alias("dist")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@query(f"WITH {_DIST} SELECT fp_id FROM fp WHERE fp_id NOT IN (SELECT x FROM d UNION SELECT y FROM d)")
def alone_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Trees without a neighbour."""
    return graph.alone_nodes(fingerprints(spark, sf).select("fp_id"), symmetric_difference(spark, sf), "fp_id")


@query(f"WITH {_DIST} SELECT fp_id FROM fp WHERE fp_id IN (SELECT x FROM d UNION SELECT y FROM d)")
def seen_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Trees with a neighbour."""
    return graph.seen_nodes(fingerprints(spark, sf).select("fp_id"), symmetric_difference(spark, sf), "fp_id")


_PAIRS = "ed AS (SELECT least(x, y) AS x, greatest(x, y) AS y, min(dist) AS dist FROM edges WHERE x IS NOT NULL AND y IS NOT NULL AND dist IS NOT NULL AND x <> y GROUP BY 1, 2)"
_REACH = f"{_PAIRS}, bw AS (SELECT x, y FROM ed UNION SELECT y, x FROM ed), reach(node, other) AS (SELECT x, x FROM bw UNION SELECT r.node, b.y FROM reach r JOIN bw b ON r.other = b.x), co AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "edges").where("x is not null and y is not null and dist is not null and x <> y")
    return e.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min("dist").cast("bigint").alias("dist"))


@query(f"WITH {_PAIRS} SELECT node, CAST(count(*) AS BIGINT) AS degree FROM (SELECT x AS node FROM ed UNION ALL SELECT y FROM ed) GROUP BY 1")
def adjacency_degrees(spark: SparkSession, sf: str) -> DataFrame:
    """The symmetric adjacency, as degrees."""
    return graph.adjacency(_pairs(spark, sf)).groupBy("node").agg(F.count(F.lit(1)).cast("bigint").alias("degree"))


@query(f"WITH RECURSIVE {_REACH} SELECT node, component FROM co")
def components(spark: SparkSession, sf: str) -> DataFrame:
    """Connected components of the finite edges."""
    return graph.components(_pairs(spark, sf))


@query(f"WITH RECURSIVE {_REACH} SELECT component, CAST(count(*) AS BIGINT) AS n FROM co GROUP BY 1")
def component_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """C3, A4."""
    return graph.components(_pairs(spark, sf)).groupBy("component").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@query(f"WITH {_FP} SELECT fp_id, weight FROM fp WHERE weight >= 90")
def small_tree_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Main weight of at least 90."""
    return distance.small_tree_filter(fingerprints(spark, sf), 90).select("fp_id", "weight")


# ---- partition and parsing (P, S, F1, F2, J6) ------------------------------------------------------------------

@query("""WITH b AS (SELECT l_orderkey, arg_max(l_linestatus, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS sig, arg_min(CASE WHEN l_quantity > 45 THEN 'none' ELSE 'tree' END, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS ir, bool_or(l_discount > 0.01) AS plain FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderpriority LIKE '5%' THEN 'type error' WHEN o_orderpriority LIKE '4%' THEN 'unparsable' WHEN b.l_orderkey IS NULL THEN 'not found' WHEN sig <> 'F' THEN 'wrong type' WHEN ir = 'none' THEN 'no tree' WHEN NOT plain THEN 'no plain binding' ELSE 'accepted' END AS status
    FROM orders LEFT JOIN b ON o_orderkey = l_orderkey""")
def partition_accept_reject(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as units, items as bindings; last signature, first tree."""
    error = F.when(F.startswith("o_orderpriority", F.lit("5")), "type error").when(F.startswith("o_orderpriority", F.lit("4")), "parse error")
    u = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("key"), error.alias("error"))
    b = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("unit"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("ord"), F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("sig"),
        F.when(F.col("l_quantity") > 45, F.lit(None)).otherwise(F.lit("tree")).alias("ir"), (F.col("l_discount") > 0.01).alias("plain"))
    return accept_reject(u, b, "R", "F").select("key", "status")


@query(f"""WITH {_UNITS}, p AS (SELECT *, split_part(unit_key, '.', 1) AS package FROM un), r AS (SELECT package, arg_min(unit_id, (ord, unit_id)) AS first_unit FROM p GROUP BY 1)
    SELECT unit_id, package, first_unit FROM p JOIN r USING (package)""")
def partition_with_representative(spark: SparkSession, sf: str) -> DataFrame:
    """Every unit with the first unit of its package."""
    u = units(spark, sf).select("unit_id", F.substring_index("unit_key", ".", 1).alias("key"), "ord")
    texts = u.select("key", F.struct("ord", "unit_id").alias("ord"), F.col("unit_id").alias("text"))
    return with_representative(u.select("unit_id", "key"), texts).select("unit_id", F.col("key").alias("package"), F.col("text").alias("first_unit"))


@query(f"""WITH {_UNITS} SELECT unit_id, md5(array_to_string(list_filter(string_split(text, ';;'), lambda p: trim(p, e' \\t\\r\\n\\f') <> '' AND NOT starts_with(trim(p, e' \\t\\r\\n\\f'), '#')), ';;')) AS digest FROM un WHERE text IS NOT NULL""")
def directive_strip_split(spark: SparkSession, sf: str) -> DataFrame:
    """Texts without blank and directive pieces, as digests."""
    # digests first: deduplicating them moves no texts
    digests = table(spark, sf, "units").where("text is not null").select("unit_id", F.md5(parsing.strip_directives(F.col("text"))).alias("digest"))
    return once(digests, "unit_id")


@query(f"""WITH {_TREES} SELECT source, 'Top.' || def_name AS name, loc_start FROM t WHERE source IS NOT NULL AND def_name IS NOT NULL""")
def qualified_names(spark: SparkSession, sf: str) -> DataFrame:
    """Bindings of nested modules with their qualified names."""
    t = trees(spark, sf).where("source is not null and def_name is not null")
    parts = F.split("def_name", r"\.")
    t = t.select("source", F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), ".")).alias("module"), F.element_at(parts, -1).alias("short"), "loc_start", "loc_end")
    value = F.struct(F.lit("value").alias("kind"), F.col("short").alias("name"), "loc_start", "loc_end", F.lit("").alias("ir"))
    per = t.groupBy("source", "module").agg(F.collect_list(value).alias("items"))
    empty = F.array().cast("array<struct<kind:string,name:string,loc_start:int,loc_end:int,ir:string>>")
    lift = F.transform("items", lambda v: F.struct(v["kind"].alias("kind"), v["name"].alias("name"), v["loc_start"].alias("loc_start"), v["loc_end"].alias("loc_end"), v["ir"].alias("ir"), empty.alias("items")))
    node = F.array(F.struct(F.lit("module").alias("kind"), F.col("module").alias("name"), F.lit(None).cast("int").alias("loc_start"), F.lit(None).cast("int").alias("loc_end"), F.lit("").alias("ir"), F.col("items").alias("items")))
    nested = per.select("source", F.lit("Top").alias("prefix"), F.when(F.col("module").isNull(), lift).otherwise(node).alias("items"))
    return parsing.explode_bindings(nested, "items", "prefix", 2).select("source", "name", "loc_start")


@query(f"WITH {_ENTRIES} SELECT label, arg_min(weight, entry_id) AS first_weight, arg_max(weight, entry_id) AS last_weight FROM e WHERE label IS NOT NULL GROUP BY 1")
def first_vs_last_binding(spark: SparkSession, sf: str) -> DataFrame:
    """The first and the last row of a name."""
    e = entries(spark, sf).where("label is not null")
    first = parsing.first_of_name(e, ["label"], "entry_id").select("label", F.col("weight").alias("first_weight"))
    return first.join(parsing.last_value(e, ["label"], "weight", "entry_id").withColumnRenamed("weight", "last_weight"), "label")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), p AS (SELECT doc_id, substring(line, 3) AS path FROM l WHERE starts_with(line, 'B'))
    SELECT doc_id, CASE WHEN path = '' THEN NULL WHEN starts_with(path, '/') THEN path ELSE '/base/' || path END AS path FROM p""")
def build_path_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that start with B as paths below a base."""
    p = parsing.build_path_lines(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return p.select("doc_id", parsing.with_base(F.col("path"), "/base").alias("path"))


@query(f"""WITH {_UNITS}, f AS (SELECT DISTINCT regexp_extract(source, '([^/]*)$', 1) AS file FROM un WHERE ends_with(source, '.ml')), {_TREES},
    a AS (SELECT replace(source, '.ml', '.cmt') AS path, min(loc_start) AS ord, substring(source, 1, 1) AS dir_ord FROM t WHERE source IS NOT NULL GROUP BY 1, 3),
    c AS (SELECT file, replace(file, '.ml', '.cmt') AS cand FROM f UNION SELECT file, upper(substring(file, 1, 1)) || substring(replace(file, '.ml', '.cmt'), 2) FROM f)
    SELECT file, arg_max(path, (dir_ord, -ord, path)) AS path FROM c JOIN a ON ends_with(regexp_extract(path, '([^/]*)$', 1), cand) GROUP BY 1""")
def artifact_suffix_match(spark: SparkSession, sf: str) -> DataFrame:
    """Artifacts by name suffix; the last directory with a hit wins."""
    u = units(spark, sf).where(parsing.has_extension(F.col("source")))
    files = u.select(parsing.path_base(F.col("source")).alias("file")).distinct()
    t = trees(spark, sf).where("source is not null").groupBy(F.replace("source", F.lit(".ml"), F.lit(".cmt")).alias("path"), F.substring("source", 1, 1).alias("d")).agg(F.min("loc_start").alias("ord"))
    # ties within a directory and position go to the last path
    artifacts = t.select(F.struct("d", -F.col("ord"), "path").alias("dir_ord"), F.lit(0).alias("ord"), "path")
    return parsing.find_artifacts(files, artifacts)[0]


@query(f"WITH {_UNITS} SELECT DISTINCT split_part(unit_key, '.', 1) AS package FROM un WHERE split_part(unit_key, '.', 1) BETWEEN 'd' AND 'p'")
def catalog_range(spark: SparkSession, sf: str) -> DataFrame:
    """Package names within bounds, sorted."""
    names = units(spark, sf).select(F.substring_index("unit_key", ".", 1).alias("package")).distinct()
    return parsing.catalog_range(names, "package", "d", "p")


@query(f"WITH {_TREES} SELECT tree_id, regexp_extract(source, '([^/]*)$', 1) || ':' || def_name AS label FROM t")
def dump_file_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of dumped trees."""
    return dump_labels(trees(spark, sf)).select("tree_id", "label")


# ---- statistics (A8-A15, F3-F10, X8, X9, K7, K8) ---------------------------------------------------------------

def _class_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf).where("digest is not null and label is not null")
    cls = F.concat(F.col("weight").cast("string"), F.lit("-"), "digest")
    return e.select(cls.alias("cls"), cls.alias("leaf"), "label")


_CLS = f"{_ENTRIES}, c AS (SELECT CAST(weight AS VARCHAR) || '-' || digest AS cls, label FROM e WHERE digest IS NOT NULL AND label IS NOT NULL)"
_STRIP = "CASE WHEN instr(label, '.') > 0 AND instr(label, ':') > 0 THEN substring(label, 1, instr(label, '.') - 1) || substring(label, instr(label, ':')) ELSE label END"
_PREFIX = "CASE WHEN instr(label, '-') > 0 THEN substring(label, 1, instr(label, '-') - 1) WHEN instr(label, '.') > 0 THEN substring(label, 1, instr(label, '.') - 1) END"
_REFINED = f"""{_CLS}, p AS (SELECT cls FROM c GROUP BY cls HAVING count(DISTINCT {_PREFIX}) > 3
    AND bool_or(NOT contains(lower(label), 'menhir')) AND bool_or(NOT contains(lower(label), 'oasis')) AND bool_or(NOT contains(lower(label), 'baseenvlight')) AND bool_or(NOT contains(lower(label), 'parse'))), rf AS (SELECT * FROM c WHERE cls IN (SELECT cls FROM p))"""


def _report_sql(rows: str, view: str) -> str:
    return f"""SELECT '{view}' AS view, CAST(coalesce(sum(size), 0) AS BIGINT) AS definitions, CAST(count(*) AS BIGINT) AS classes, CAST(count(*) FILTER (size > 1) AS BIGINT) AS real_classes, max(size) FILTER (size > 1) AS largest,
        (SELECT size FROM (SELECT size, row_number() OVER (ORDER BY size DESC) AS k, count(*) OVER () AS n FROM (SELECT cls, CAST(count(*) AS BIGINT) AS size FROM {rows} GROUP BY 1 HAVING count(*) > 1)) WHERE k = n // 2 + 1) AS middle
        FROM (SELECT cls, CAST(count(*) AS BIGINT) AS size FROM {rows} GROUP BY 1)"""


@query(f"WITH {_CLS} SELECT size, CAST(count(*) AS BIGINT) AS n FROM (SELECT cls, CAST(count(*) AS BIGINT) AS size FROM c GROUP BY 1) GROUP BY 1")
def class_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Classes by size."""
    return stats.size_histogram(stats.class_sizes(_class_rows(spark, sf)))


@query(f"WITH {_CLS} SELECT size, CAST(count(*) AS BIGINT) AS n FROM (SELECT cls, CAST(count(*) AS BIGINT) AS size FROM c GROUP BY 1) GROUP BY 1")
def histogram_csv(spark: SparkSession, sf: str) -> DataFrame:
    """K8: the histogram written as CSV and read again."""
    hist = stats.size_histogram(stats.class_sizes(_class_rows(spark, sf)))
    path = stats.export_histogram(hist, f"{Scratch(spark, 'csv').root}/", "all.csv")
    return spark.read.schema("size bigint, n bigint").csv(path)


@query(f"WITH {_REFINED}, st AS (SELECT DISTINCT cls, {_STRIP} AS label FROM c) {_report_sql('c', 'all')} UNION ALL {_report_sql('st', 'only')} UNION ALL {_report_sql('rf', 'refinement')}")
def class_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics of the three views."""
    rows = Scratch(spark, "stats").write(_class_rows(spark, sf), "rows")
    return stats.class_report(rows, "all").union(stats.class_report(stats.without_versions(rows), "only")).union(stats.class_report(stats.refined(rows), "refinement"))


@query(f"WITH {_CLS} SELECT cls, CAST(count(*) AS BIGINT) AS size FROM c GROUP BY 1 ORDER BY size DESC, cls LIMIT 20")
def top_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 largest classes."""
    return stats.top_classes(stats.class_sizes(_class_rows(spark, sf)), 20)


@query(f"WITH {_CLS}, r AS (SELECT cls, label, CAST(row_number() OVER (PARTITION BY cls ORDER BY md5(label || '42'), label) AS BIGINT) AS place FROM c) SELECT cls, place, label FROM r WHERE place <= 3")
def seeded_representatives(spark: SparkSession, sf: str) -> DataFrame:
    """Up to three labels per class in seeded order."""
    return stats.representatives(_class_rows(spark, sf), 3)


@query(f"WITH {_ENTRIES} SELECT entry_id, {_STRIP} AS label FROM e")
def version_strip(spark: SparkSession, sf: str) -> DataFrame:
    """X8, Q20."""
    return entries(spark, sf).select("entry_id", strip_version(F.col("label")).alias("label"))


@query(f"WITH {_ENTRIES} SELECT entry_id, {_PREFIX} AS prefix FROM e")
def package_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """X9, Q20."""
    return entries(spark, sf).select("entry_id", package_prefix(F.col("label")).alias("prefix"))


@query(f"WITH {_CLS} SELECT cls, CAST(count(DISTINCT {_PREFIX}) AS BIGINT) AS prefixes FROM c GROUP BY 1 HAVING count(DISTINCT {_PREFIX}) > 3")
def refine_by_prefix_count(spark: SparkSession, sf: str) -> DataFrame:
    """Classes over more than three packages."""
    p = _class_rows(spark, sf).select("cls", package_prefix(F.col("label")).alias("prefix")).where("prefix is not null").distinct()
    return p.groupBy("cls").agg(F.count(F.lit(1)).cast("bigint").alias("prefixes")).where("prefixes > 3")


@query(f"WITH {_REFINED} SELECT cls, CAST(count(*) AS BIGINT) AS size FROM rf GROUP BY 1")
def exclude_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """The refined classes."""
    return stats.class_sizes(stats.refined(_class_rows(spark, sf)))


@query()
def entry_c_corpus_report(spark: SparkSession, sf: str) -> DataFrame:
    """Entry C: trees hashed, clustered and reported."""
    labelled = dump_labels(trees(spark, sf).where("ir is not null"))
    hashed = fingerprint.fingerprint_trees(labelled.select("label", "ir"), "ir", STRICT, hard(HEAVY), passes=1).where("error is null")
    return corpus_report(hashed, more_than=1)


@query()
def entry_a_partition(spark: SparkSession, sf: str) -> DataFrame:
    """Entry A: definitions of trees as submissions; sizes of the resulting trees."""
    from arbora.operators.partition import partition

    t = trees(spark, sf)
    u = t.select(F.col("tree_id").alias("key"), F.when(F.col("ir").isNull(), "parse error").alias("error"), F.lit(0).alias("ord"), F.col("def_name").alias("text"))
    b = t.select(F.col("tree_id").alias("unit"), F.lit(0).alias("ord"), F.lit("f").alias("name"), F.lit("t").alias("sig"), "ir", F.lit(True).alias("plain"))
    p = partition(u, b, "f", "t", keep_percent=30)
    return dendrogram.forest_sizes(p.clusters.merges, p.clusters.leaves.groupBy("leaf").agg(F.count("label").alias("n_labels")))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return exact_classes(spark, sf)


# queries kept in modules of their own register themselves
from arbora.plans import linkage_queries, scalar_queries, tree_queries  # noqa: E402, F401
