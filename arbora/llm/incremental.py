"""Deduplicating new batches against all history: incremental record linkage over persisted blocking keys.

`History` is a set of tables in a folder, bucketed by their join keys: exact keys, different bags, their blocking keys
(rarest elements), and the union-find of clusters. A batch reads its own rows once and probes the tables, which are
scanned but never shuffled or rewritten; the pairs it meets are scored with weights learned by expectation
maximisation over their comparison patterns (Fellegi-Sunter). The score picks the record a row is linked to; an exact
check of every pair decides whether it is a duplicate. An accepted batch is appended under its number.

Records are known by a code, the number of their source above 55 bits of their id, so that ids of different tables never
meet, and a bag or a cluster by the smallest code in it. Codes don't change when a batch becomes history.

Rows of a batch may repeat each other, and only accepted rows count, in the batch's order. That greedy rule is
resolved in rounds: a row that is first among the undecided rows it conflicts with is accepted, and its conflicts
are cases. Conflicts are kept per class (key or bag), never per pair of rows, so a key holding a third of all rows
costs one row per record.

Scale: blocking keys in more than a thousandth of all bags are last in the order, so no blocking key of a bag but the
ones made of common elements only is common. Those few are kept apart, in a table whose join adaptive execution can
split. The order is made anew, and the blocking keys with it, whenever the history has doubled since: a constant
cost per record over time. History holds one row per key and batch, so a hot key is one row.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions.scalars import clean_digest
from arbora.llm.bags import blocks, common_elements, distinct_bags, keyed, members, tokens, verified
from arbora.llm.components import connected_components
from arbora.llm.stored import BucketedTable
from arbora.session import Scratch

#: Comparison fields of a pair of bags, each with its number of levels.
FIELDS = {"hits": 4, "size": 3, "top": 2}


def learn_weights(patterns: list[tuple[dict[str, int], int]], rounds: int = 40) -> dict[str, list[float]]:
    """Log-odds weights per field and level by expectation maximisation over pattern counts (at most 24 patterns).

    Without any pattern all weights are 0."""
    if not patterns:
        return {f: [0.0] * k for f, k in FIELDS.items()}
    share = 0.5
    m = {f: [(i + 1) / sum(range(1, k + 1)) for i in range(k)] for f, k in FIELDS.items()}
    u = {f: [(k - i) / sum(range(1, k + 1)) for i in range(k)] for f, k in FIELDS.items()}
    for _ in range(rounds):
        mass = {f: ([1e-3] * k, [1e-3] * k) for f, k in FIELDS.items()}
        match = total = 0.0
        for levels, n in patterns:
            a, b = share, 1 - share
            for f, v in levels.items():
                a, b = a * m[f][v], b * u[f][v]
            p = a / (a + b) if a + b else 0.5
            match, total = match + p * n, total + n
            for f, v in levels.items():
                mass[f][0][v] += p * n
                mass[f][1][v] += (1 - p) * n
        share = min(max(match / total, 1e-6), 1 - 1e-6)
        m = {f: [x / sum(a) for x in a] for f, (a, _) in mass.items()}
        u = {f: [x / sum(b) for x in b] for f, (_, b) in mass.items()}
    return {f: [math.log2(m[f][i] / u[f][i]) for i in range(k)] for f, k in FIELDS.items()}


#: Bits of a code below its source.
_ID_BITS = 55


def coded(df: DataFrame, id_col: str, number: int) -> DataFrame:
    """df plus `code`; an id that doesn't fit fails the query."""
    i = F.col(id_col).cast("bigint")
    fits = (i >= 0) & (i < F.lit(1 << _ID_BITS))
    return df.withColumn("code", F.when(i.isNull(), F.lit(None)).when(fits, i + F.lit(number << _ID_BITS)).otherwise(F.raise_error(F.lit(f"ids must be from 0 to 2^{_ID_BITS}"))))


def id_of(code: str) -> F.Column:
    return F.col(code).bitwiseAND(F.lit((1 << _ID_BITS) - 1))


def _nodes(records: DataFrame) -> DataFrame:
    """(weight, digest, node) of records with a key; a record without bag is a node by its own code."""
    return records.where("weight is not null and digest is not null").select("weight", "digest", F.coalesce("bag", "id").alias("node")).distinct()


def _heads(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("weight", "digest").agg(F.min("node").alias("node"))


def _key_stars(nodes: DataFrame) -> DataFrame:
    """(x, y): every node of a key with the key's smallest node."""
    return nodes.join(_heads(nodes).withColumnRenamed("node", "y"), ["weight", "digest"]).where("node <> y").select(F.col("node").alias("x"), "y")


class History:
    """The persisted side, opened from a folder; batch is the number of the last batch it holds (0: as built)."""

    def __init__(self, spark: SparkSession, path: str, state: dict):
        self.spark, self.path, self.state = spark, path, state
        self.threshold, self.batch, self.sources = state["threshold"], state["batch"], list(state["sources"])
        self.scratch = Scratch(spark, "history")
        n = state["buckets"]
        self._keys = BucketedTable(spark, f"{path}/keys", "weight BIGINT, digest STRING, node BIGINT", ["weight", "digest"], n)
        self._bags = BucketedTable(spark, f"{path}/bags", "bag BIGINT, elements ARRAY<BIGINT>", ["bag"], n)
        self._forest = BucketedTable(spark, f"{path}/forest", "node BIGINT, parent BIGINT", ["node"], n)
        self._open_blocks()

    def _open_blocks(self) -> None:
        v, n = self.state["order"], self.state["buckets"]
        columns = "element BIGINT, bag BIGINT, size INT, top BIGINT"
        self._rare = BucketedTable(self.spark, f"{self.path}/rare-{v}", columns, ["element"], n)
        self._hot = BucketedTable(self.spark, f"{self.path}/hot-{v}", columns, ["bag"], n)
        order = f"{self.path}/order-{v}"
        self.common = {r[0]: r[1] for r in self.spark.read.schema("element bigint, n bigint").parquet(order).collect()} if self.state["order_bags"] else {}

    @property
    def keys(self) -> DataFrame:
        """(weight, digest, node): one row per key and batch, with its smallest node there."""
        return self._keys.upto(self.batch)

    @property
    def bags(self) -> DataFrame:
        return self._bags.upto(self.batch)

    @property
    def rare(self) -> DataFrame:
        return self._rare.upto(self.batch)

    @property
    def hot(self) -> DataFrame:
        return self._hot.upto(self.batch)

    @property
    def forest(self) -> DataFrame:
        """(node, parent): the union-find; a node without a row is its own root, and no row is ever changed."""
        return self._forest.upto(self.batch)

    def close(self) -> None:
        """Forget the tables in the session's catalogue once nothing reads them any more (a lasting catalogue would keep them); what is stored stays."""
        for t in (self._keys, self._bags, self._forest, self._rare, self._hot):
            t.close()

    def number(self, source: str) -> int:
        """The number of a source of records; a new one is added (and stored with the next batch)."""
        if source not in self.sources:
            self.sources.append(source)
        return self.sources.index(source)

    def named(self, code: str) -> F.Column:
        """'source:id' of a code."""
        names = F.array(*map(F.lit, self.sources))
        return F.concat(F.get(names, F.shiftright(code, _ID_BITS).cast("int")), F.lit(":"), id_of(code).cast("string"))

    def find(self, nodes: DataFrame) -> DataFrame:
        """(node, root) of the given nodes: rounds follow the parents of those that still have one."""
        at = self.scratch.write(nodes.select("node", F.col("node").alias("root")).distinct(), "find")
        while True:
            up = at.join(self.forest.select(F.col("node").alias("root"), "parent"), "root", "left")
            up = self.scratch.write(up.groupBy("node", "root").agg(F.min("parent").alias("parent")), "found")
            at = up.select("node", F.coalesce("parent", "root").alias("root"))
            if up.where("parent is not null").isEmpty():
                return at

    def _store(self, batch: int, keys: DataFrame, bags: DataFrame, parents: DataFrame | None) -> None:
        """Append the tables of a batch; only the state written at the end makes them part of the history."""
        self._keys.append(keys, batch)
        self._bags.append(bags, batch)
        if parents is not None:
            self._forest.append(parents, batch)
        state = {**self.state, "batch": batch, "sources": self.sources, "bags": self.state["bags"] + bags.count()}
        if state["bags"] > 2 * state["order_bags"]:
            all_bags = self._bags.upto(batch)
            state |= {"order": state["order"] + 1, "order_bags": state["bags"]}
            order = [(k, v) for k, v in common_elements(all_bags).items()]
            self.spark.createDataFrame(order, "element bigint, n bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/order-{state['order']}")
            self.state = state
            self._open_blocks()
            self._block(all_bags, batch)
        else:
            self.state = state
            self._block(bags, batch)
        self.spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").text(f"{self.path}/state/{batch:08}")
        self.batch = batch

    def _block(self, bags: DataFrame, batch: int) -> None:
        made = self.scratch.write(blocks(bags, self.common, self.threshold), "blocks")
        is_common = self._common_table()
        self._rare.append(made.join(is_common, "element", "left_anti"), batch)
        self._hot.append(made.join(is_common, "element", "left_semi"), batch)

    def _common_table(self) -> DataFrame:
        return self.spark.createDataFrame([(k,) for k in self.common], "element bigint")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> History:
        """A stored history with all batches whose storing was completed."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/state")
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        done = [x.getPath() for x in fs.listStatus(folder) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
        last = max(p.getName() for p in done)
        return cls(spark, path, json.loads(spark.read.text(f"{path}/state/{last}").first()[0]))

    @classmethod
    def build(cls, df: DataFrame, id_col: str, threshold: float = 0.7, source: str = "history", path: str | None = None, buckets: int = 16, clusters: bool = False) -> History:
        """From a table with the id, weight, digest and subs, stored at path or in the shared folder; a repeated id is one record.

        buckets is fixed for the history's life: a few per core of the cluster it will run on. With clusters the records'
        own links are found too, so that cluster_updates knows which of them belong together."""
        spark = df.sparkSession
        path = path or f"{Scratch(spark, 'stored').root}/history"
        empty = {"batch": -1, "threshold": threshold, "sources": [source], "order": 0, "order_bags": 0, "bags": 0, "buckets": buckets}
        self = cls(spark, path, empty)
        rows = coded(df, id_col, 0).where("code is not null").select(F.col("code").alias("id"), "weight", clean_digest("digest").alias("digest"), tokens("subs").alias("tokens"))
        full = F.size("tokens") > 0
        rows = rows.withColumn("k1", F.when(full, F.xxhash64("tokens"))).withColumn("k2", F.when(full, F.xxhash64(F.lit(7), F.col("tokens"))))
        rows = self.scratch.write(rows, "rows")  # the bags are hashed once and read twice
        kept = rows.where("k1 is not null")
        bags = self.scratch.write(distinct_bags(kept), "bags")
        nodes = _nodes(rows.join(bags.select("bag", "k1", "k2"), ["k1", "k2"], "left"))
        nodes = self.scratch.write(nodes, "nodes") if clusters else nodes
        parents = None
        if clusters:
            made = self.scratch.write(blocks(bags, common_elements(bags), threshold), "own-blocks")
            close = verified(_met(made, made, threshold, among=True).select("a", "b"), bags, bags, threshold)
            named = connected_components(close.select(F.col("a").alias("x"), F.col("b").alias("y")).union(_key_stars(nodes)))
            parents = self.scratch.write(named.where("node <> component").select("node", F.col("component").alias("parent")), "parents")
        self._store(0, _heads(nodes), bags, parents)
        return self


def _hits(left: DataFrame, right: DataFrame, threshold: float, among: bool) -> DataFrame:
    """A row for every blocking key that two bags share whose sizes allow the threshold."""
    x = left.select("element", F.col("bag").alias("a"), F.col("size").alias("sa"), F.col("top").alias("ta"))
    y = right.select("element", F.col("bag").alias("b"), F.col("size").alias("sb"), F.col("top").alias("tb"))
    close = (F.col("sa") >= threshold * F.col("sb") - 1e-9) & (F.col("sb") >= threshold * F.col("sa") - 1e-9)
    on = close & (F.col("a") < F.col("b")) if among else close
    return x.join(y, "element").where(on).select("a", "b", "sa", "sb", (F.col("ta") == F.col("tb")).alias("same"))


def _compared(hits: DataFrame) -> DataFrame:
    """(a, b, hits, size, top): the pairs with their levels of agreement."""
    return (
        hits.groupBy("a", "b", "sa", "sb", "same").agg(F.count(F.lit(1)).alias("n"))
        .select(
            "a", "b",
            F.when(F.col("n") >= 8, 3).when(F.col("n") >= 4, 2).when(F.col("n") >= 2, 1).otherwise(0).alias("hits"),
            F.when(F.least("sa", "sb") >= 0.95 * F.greatest("sa", "sb"), 2).when(F.least("sa", "sb") >= 0.85 * F.greatest("sa", "sb"), 1).otherwise(0).alias("size"),
            F.col("same").cast("int").alias("top"),
        )
    )


def _met(left: DataFrame, right: DataFrame, threshold: float, among: bool) -> DataFrame:
    return _compared(_hits(left, right, threshold, among))


def _scored(met: DataFrame) -> tuple[DataFrame, dict[str, list[float]]]:
    patterns = [({f: r[f] for f in FIELDS}, r["count"]) for r in met.groupBy(*FIELDS).count().collect()]
    weights = learn_weights(patterns)
    score = F.lit(0.0)
    for f, w in weights.items():
        score = score + F.element_at(F.array(*[F.lit(x) for x in w]), F.col(f) + 1)
    return met.withColumn("score", score), weights


class Linked:
    """What a batch came to: decided (id, found_in), matches (bag, other, score, sim), and the batch's bags."""

    def __init__(self, **tables):
        self.__dict__.update(tables)


def link_batch(history: History, batch: DataFrame, id_col: str, order: list[str], source: str = "batch") -> Linked:
    """Decide every record of a batch in its order against history and the records accepted before it.

    decided has (id, found_in): 'history' or 'batch' for a case, null for an accepted record.

    Defined results: a row without id is left out, an id below 0 or beyond 2^55 fails; a null weight or digest equals nothing; a null or
    empty bag is similar to nothing; a repeated id is one record; ties in the order are broken by nothing, so the order columns should end
    with the id; null order columns come first; labels and all other columns are ignored; an empty batch or history is fine."""
    t, scratch = history.threshold, history.scratch
    batch = coded(batch, id_col, history.number(source))
    rows = scratch.write(keyed(batch, "code", "subs"), "rows")
    bags = scratch.write(distinct_bags(rows), "batch-bags")
    who = members(rows, bags)
    at = [f"_o{i}" for i in range(len(order))]
    records = (
        batch.select(F.col("code").alias("id"), *[F.col(c).alias(a) for c, a in zip(order, at)], "weight", clean_digest("digest").alias("digest"))
        .where("id is not null").dropDuplicates(["id"]).repartitionByRange(*at).sortWithinPartitions(*at)
        .select(F.monotonically_increasing_id().alias("at"), "id", "weight", "digest")
    )
    # at grows with the order over the whole batch
    records = scratch.write(scratch.write(records, "ordered").join(who, "id", "left"), "records")

    own = scratch.write(blocks(bags, history.common, t), "probe")
    is_common = history._common_table()
    hits = _hits(own.join(is_common, "element", "left_anti"), history.rare, t, among=False).union(_hits(own.join(is_common, "element", "left_semi"), history.hot, t, among=False))
    met = scratch.write(_compared(hits), "met")
    scored, weights = _scored(met)
    matches = scratch.write(verified(scored.select("a", "b", "score"), bags, history.bags, t), "matches")

    old_bags = matches.select(F.col("a").alias("bag")).distinct().withColumn("by_bag", F.lit(True))
    old_keys = history.keys.groupBy("weight", "digest").agg(F.min("node").alias("head"))
    marked = records.join(old_bags, "bag", "left").join(old_keys, ["weight", "digest"], "left")
    marked = scratch.write(marked.select("at", "id", "weight", "digest", "bag", "head", (F.col("by_bag").isNotNull() | F.col("head").isNotNull()).alias("old")), "marked")

    # bags of the batch that are similar to each other, by an order of the batch's own common elements
    among = scratch.write(blocks(bags.join(marked.where("not old").select("bag").distinct(), "bag", "left_semi"), common_elements(bags), t), "among")
    close = scratch.write(verified(_met(among, among, t, among=True).select("a", "b"), bags, bags, t).select("a", "b", "sim"), "close")
    cases = _resolve(marked.where("not old"), close, scratch)
    decided = marked.join(cases.withColumn("later", F.lit(True)), "at", "left").select(
        id_of("id").alias("id"), F.when(F.col("old"), "history").when(F.col("later"), "batch").alias("found_in"), F.col("id").alias("code"))
    return Linked(decided=decided, matches=matches, close=close, weights=weights, bags=bags, records=marked, members=who, history=history)


def _resolve(records: DataFrame, close: DataFrame, scratch: Scratch) -> DataFrame:
    """(at) of the records that repeat an earlier accepted record of the same batch."""
    by_key = records.where("weight is not null and digest is not null").groupBy("weight", "digest").agg(F.min("at").alias("cls"), F.count(F.lit(1)).alias("n")).where("n > 1")
    by_bag = records.where("bag is not null").groupBy("bag").agg(F.min("at").alias("cls"), F.count(F.lit(1)).alias("n"))
    near = close.select(F.explode(F.array("a", "b")).alias("bag")).distinct()
    by_bag = scratch.write(by_bag.join(near.withColumn("near", F.lit(True)), "bag", "left").where("n > 1 or near").select("bag", (F.col("cls") * 2 + 1).alias("cls")), "bag-classes")
    held = records.join(by_key.select("weight", "digest", (F.col("cls") * 2).alias("cls")), ["weight", "digest"]).select("at", "cls")
    held = held.union(records.join(by_bag, "bag").select("at", "cls"))
    undecided = scratch.write(held, "classes-0")
    links = close.join(by_bag.withColumnRenamed("bag", "a").withColumnRenamed("cls", "ca"), "a").join(by_bag.withColumnRenamed("bag", "b").withColumnRenamed("cls", "cb"), "b")
    links = scratch.write(links.select(F.explode(F.array(F.struct(F.col("ca").alias("cls"), F.col("cb").alias("other")), F.struct(F.col("cb").alias("cls"), F.col("ca").alias("other")))).alias("l")).select("l.cls", "l.other"), "links")
    decided, k = None, 0
    while not undecided.isEmpty():
        k += 1
        first = scratch.write(undecided.groupBy("cls").agg(F.min("at").alias("first")), f"first-{k}")
        # the first undecided record of a class and of the classes next to it
        around = first.union(links.join(first.withColumnRenamed("cls", "other"), "other").select("cls", "first")).groupBy("cls").agg(F.min("first").alias("first"))
        ahead = undecided.join(around, "cls").groupBy("at").agg(F.min("first").alias("first"))
        accepted = scratch.write(ahead.where("at = first").select("at"), f"accepted-{k}")
        taken = undecided.join(accepted, "at", "left_semi").select("cls").distinct()
        taken = taken.union(links.join(taken, "cls", "left_semi").select(F.col("other").alias("cls"))).distinct()
        fell = scratch.write(undecided.join(taken, "cls", "left_semi").select("at").distinct().join(accepted, "at", "left_anti"), f"cases-{k}")
        decided = fell if decided is None else decided.union(fell)
        undecided = scratch.write(undecided.join(accepted, "at", "left_anti").join(fell, "at", "left_anti"), f"classes-{k}")
    return decided if decided is not None else records.select("at").where("false")


def absorb(linked: Linked, batch: int, clusters: DataFrame | None = None) -> None:
    """Append the accepted records of a batch under its number, so that the next batch is checked against them too.

    Nothing stored before is rewritten. A batch that was stored already is left as it is, and one whose storing was
    interrupted is stored again. clusters are the batch's cluster_updates, if clusters are kept."""
    history = linked.history
    if batch <= history.batch:
        return
    accepted = linked.records.join(linked.decided.where("found_in is null").select(F.col("code").alias("id")), "id", "left_semi")
    kept = history.scratch.write(linked.bags.join(accepted.select("bag").distinct(), "bag", "left_semi").select("bag", "elements"), "bags")
    parents = None if clusters is None else clusters.where("node <> component").select("node", F.col("component").alias("parent"))
    history._store(batch, _heads(_nodes(accepted)), kept, parents)


def best_links(linked: Linked) -> DataFrame:
    """(id, linked_to, score, sim): for records whose bag is in history, the history bag of the best score.

    Ties go to the higher similarity, then to the smaller code. linked_to is the bag's first record, as 'source:id'."""
    rank = F.struct("score", "sim", (-F.col("b")).alias("minus"))
    best = linked.matches.groupBy(F.col("a").alias("bag")).agg(F.max(rank).alias("best"))
    named = linked.members.join(best, "bag").select(id_of("id").alias("id"), (-F.col("best.minus")).alias("code"), "best.score", "best.sim")
    return named.select("id", linked.history.named("code").alias("linked_to"), "score", "sim")


def cluster_updates(linked: Linked) -> DataFrame:
    """(node, component): the new entries of the union-find - every node of the batch, and every root of history that the batch
    joins to another - with the smallest node of their cluster.

    Links are similar bags and equal keys, between batch and history and among all records of the batch, cases included. The
    union-find's find step follows the parents of the history nodes that were met, its union step contracts their roots; the
    members of an old cluster are reached through its root and not touched."""
    history, scratch, t = linked.history, linked.history.scratch, linked.history.threshold
    own = scratch.write(blocks(linked.bags, common_elements(linked.bags), t), "own-blocks")
    close = verified(_met(own, own, t, among=True).select("a", "b"), linked.bags, linked.bags, t)
    across = linked.matches.select(F.col("a").alias("x"), F.col("b").alias("node"))
    across = across.union(linked.records.where("head is not null").select(F.coalesce("bag", "id").alias("x"), F.col("head").alias("node"))).distinct()
    across = scratch.write(across, "across")
    edges = across.join(history.find(across.select("node")), "node").select("x", F.col("root").alias("y"))
    edges = edges.union(close.select(F.col("a").alias("x"), F.col("b").alias("y"))).union(_key_stars(_nodes(linked.records)))
    named = connected_components(edges)
    alone = linked.records.select(F.coalesce("bag", "id").alias("node")).distinct().join(named, "node", "left_anti")
    return scratch.write(named.union(alone.select("node", F.col("node").alias("component"))), "clusters")


def cluster_of_records(linked: Linked, clusters: DataFrame) -> DataFrame:
    """(id, cluster) of every record of the batch: its cluster's smallest record, as 'source:id'."""
    placed = linked.records.select("id", F.coalesce("bag", "id").alias("node")).join(clusters, "node")
    return placed.select(id_of("id").alias("id"), linked.history.named("component").alias("cluster"))
