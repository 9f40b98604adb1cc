"""Queries on scalar functions, files and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions.scalars import append_suffix, capitalise, contains_literal, escape_digest, safe_item
from arbora.operators import classes, distance, parsing
from arbora.plans.catalogue import _ENTRIES, _HASHES, _UNITS, entries, hashes, query, units
from arbora.session import Scratch
from arbora.sources.files import read_units
from arbora.sources.tables import table


@query(f"""WITH {_UNITS} SELECT unit_id, source || '.all.csv' AS suffixed, upper(substring(unit_key, 1, 1)) || substring(unit_key, 2) AS capital, contains(unit_key, '.1.') AS has_one, lower(hex(encode(unit_key))) AS escaped,
    CASE WHEN contains(source, '/') THEN regexp_extract(source, '^(.*)/', 1) WHEN source IS NOT NULL THEN '.' END AS directory, regexp_replace(regexp_extract(source, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem FROM un""")
def label_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Functions of keys and paths; null stays null."""
    key, source = F.col("unit_key"), F.col("source")
    return units(spark, sf).select(
        "unit_id", append_suffix(source, ".all.csv").alias("suffixed"), capitalise(key).alias("capital"), contains_literal(key, ".1.").alias("has_one"), escape_digest(F.encode(key, "UTF-8")).alias("escaped"),
        F.when(source.isNotNull(), parsing.path_directory(source)).alias("directory"), parsing.stem(source).alias("stem"))


@query(f"WITH {_ENTRIES} SELECT entry_id, string_split(label, '-')[1] AS first, string_split(label, '-')[2] AS second, string_split(label, '-')[9] AS ninth FROM e")
def safe_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items of an array by place; null outside."""
    parts = F.split("label", "-", -1)
    return entries(spark, sf).select("entry_id", safe_item(parts, 0).alias("first"), safe_item(parts, 1).alias("second"), safe_item(parts, 8).alias("ninth"))


@query("""WITH v AS (SELECT edge_id, any_value(dist) AS a, any_value(CASE WHEN edge_id % 5 > 0 THEN edge_id % 40 END) AS b FROM edges GROUP BY edge_id)
    SELECT edge_id, CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE greatest(a, b) END AS far, coalesce(least(a, b), a, b) AS near, a IS NOT NULL AND (b IS NULL OR a < b) AS less FROM v""")
def distance_algebra(spark: SparkSession, sf: str) -> DataFrame:
    """Maximum, minimum and order of distances, null being infinite."""
    e = table(spark, sf, "edges").select("edge_id", F.col("dist").alias("a"), F.when(F.col("edge_id") % 5 > 0, F.col("edge_id") % 40).alias("b")).dropDuplicates(["edge_id"])
    a, b = F.col("a"), F.col("b")
    return e.select("edge_id", distance.distance_max(a, b).alias("far"), distance.distance_min(a, b).alias("near"), distance.distance_less(a, b).alias("less"))


@query(f"""WITH {_HASHES}, m AS (SELECT a.hash_id, a.loc_start + 1 AS "start", a.loc_end + 1 AS "end", b.label AS name, row_number() OVER (PARTITION BY a.hash_id ORDER BY b.label) AS place FROM h a JOIN h b ON a.weight = b.weight AND a.digest = b.digest WHERE a.label <> b.label AND a.loc_end IS NOT NULL)
    SELECT hash_id, "start", "end", CAST(place AS BIGINT) AS place, name FROM m""")
def machine_records_read(spark: SparkSession, sf: str) -> DataFrame:
    """K5, K6: machine records of the duplicates inside the analysed definitions, written as text and read again."""
    own = hashes(spark, sf)
    named = classes.clone_matches(own.where("loc_end is not null"), own.where("digest is not null")).groupBy("hash_id", "loc_start", "loc_end").agg(F.sort_array(F.collect_list("other")).alias("names"))
    text = named.select("hash_id", classes.machine_record(F.col("loc_start"), F.col("loc_end"), F.col("names")).alias("text"))
    records = text.select("hash_id", F.explode(classes.read_machine_records(F.col("text"))).alias("r"))
    return records.select("hash_id", "r.start", "r.end", F.posexplode("r.names").alias("p", "name")).select("hash_id", "start", "end", (F.col("p") + 1).cast("bigint").alias("place"), "name")


@query("""WITH l AS (SELECT unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line FROM documents WHERE text IS NOT NULL) SELECT md5(line) AS digest, CAST(count(*) AS BIGINT) AS n FROM l WHERE line <> '' GROUP BY 1""")
def files_read(spark: SparkSession, sf: str) -> DataFrame:
    """All texts written to files of a folder and the whole files read again; their lines."""
    root = f"{Scratch(spark, 'files').root}/texts"
    table(spark, sf, "documents").where("text is not null").select(F.replace("text", F.lit("\r"), F.lit("")).alias("value")).write.text(root)
    lines = read_units(spark, [root], ".txt").select(F.explode(F.split("text", "\n", -1)).alias("line")).where("line <> ''")
    return lines.groupBy(F.md5("line").alias("digest")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@query(f"WITH {_UNITS}, p AS (SELECT split_part(unit_key, '.', 1) AS package, min(unit_id) AS first_unit FROM un GROUP BY 1) SELECT unit_id, first_unit FROM un JOIN p ON package = split_part(unit_key, '.', 1)")
def value_of_every_unit(spark: SparkSession, sf: str) -> DataFrame:
    """Every unit with its package's value, which must be there."""
    u = units(spark, sf).select("unit_id", F.substring_index("unit_key", ".", 1).alias("package"))
    values = u.groupBy("package").agg(F.min("unit_id").alias("first_unit"))
    return parsing.value_or_fail(u, values, "package", "first_unit").select("unit_id", "first_unit")
