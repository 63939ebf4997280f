"""Lot genealogy: walks, depth, adjacency, cycles and yield correlation over node and edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.functions.lineage import cut, drop, scratch
from lotwise.operators.yields import DIES, panel_yield
from lotwise.plans import fab_view as fab
from lotwise.plans.fab_view import PREFIX


def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary tree over part keys: k div 2 is the parent of k."""
    k = fab.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("child"))
    return k.filter("child > 1").select(F.floor(F.col("child") / 2).cast("long").alias("parent"), "child")


def walk(edges: DataFrame, starts: DataFrame, forward: bool = True, max_depth: int | None = None) -> DataFrame:
    """node, depth: every node reachable from ``starts`` (column node) at its first depth, starts excluded.

    Breadth-first rounds of joins; a node met before is dropped, so cycles end. One count per round
    reaches the driver.
    """
    near, far = ("parent", "child") if forward else ("child", "parent")
    step = edges.select(F.col(near).alias("node"), F.col(far).alias("next"))
    seen = cut(starts.select("node", F.lit(0).alias("depth")).distinct())
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = frontier.join(step, "node").select(F.col("next").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        last, frontier = frontier, cut(reached.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        before, seen = seen, cut(seen.unionByName(frontier))
        drop(last, before)
    return seen.filter("depth > 0")


def dag_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree with a second parent, the key before, for every fifth key."""
    k = fab.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("child")).filter("child > 1 and child % 5 = 0")
    return tree_edges(spark, sf_dir).unionByName(k.select((F.col("child") - 1).alias("parent"), "child")).distinct()


def related(edges: DataFrame, nodes: DataFrame, starts: DataFrame, forward: bool = True, max_depth: int | None = None) -> DataFrame:
    """:func:`walk`, which goes through nodes that the node table lacks, without returning those."""
    return walk(edges, starts, forward, max_depth).join(nodes.select("node"), "node", "left_semi")


def tops(edges: DataFrame) -> DataFrame:
    """node, top, steps, ended of every node with exactly one parent: the first ancestor that has none or several.

    Pointers to the parent jump to what their ends point to, so a chain takes rounds by the logarithm of its length.
    ``ended`` is false on and below cycles of such nodes, where pointers never end. A round reads and writes the pointers once.
    """
    near = edges.groupBy(F.col("child").alias("node")).agg(F.count("*").alias("n"), F.min("parent").alias("top")).filter("n = 1")
    at = cut(near.select("node", "top", F.lit(1).cast("long").alias("steps"), F.lit(False).alias("ended")))
    rounds = at.count().bit_length() + 1  # a pointer that has not ended by then has gone round
    for _ in range(rounds):
        up = at.select(F.col("node").alias("top"), F.col("top").alias("up"), F.col("steps").alias("more"))
        jumped = cut(at.join(up, "top", "left").select("node", F.coalesce("up", "top").alias("top"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.isnull("up").alias("ended")))
        drop(at)
        at = jumped
        if at.filter("not ended").isEmpty():
            break
    return at


def longest_depth(edges: DataFrame) -> DataFrame:
    """node, depth: length of the longest path from a root (0 there) for every end of an edge; null on and below cycles.

    Nodes with one parent lie a fixed number of steps below their top (:func:`tops`), so only the tops are peeled, over
    edges that count those steps: a forest of any depth takes one round, another graph as many as it has levels of
    nodes with several parents. A round replaces the tables of the one before and appends to one result, so neither the
    plan nor the disk grows with the rounds; whether nodes are left reaches the driver.
    """
    edges = cut(edges.select("parent", "child").distinct())
    spark, done = edges.sparkSession, scratch(edges.sparkSession, "depths")
    ends = edges.select(F.col("parent").alias("node")).unionByName(edges.select(F.col("child").alias("node"))).distinct()
    single = tops(edges)
    several = edges.join(single.select(F.col("node").alias("child")), "child", "left_anti")
    above = single.select(F.col("node").alias("parent"), "top", "steps", "ended")
    # A parent whose pointer never ends holds its child for ever, as an edge of the child to itself does.
    start = F.when(F.col("ended"), F.col("top")).when(F.col("ended").isNull(), F.col("parent")).otherwise(F.col("child"))
    weighted = several.join(above, "parent", "left").select(start.alias("parent"), "child", (F.coalesce("steps", F.lit(0)) + 1).alias("steps"))
    remaining = cut(weighted.groupBy("parent", "child").agg(F.max("steps").alias("steps")))
    left = cut(ends.join(single, "node", "left_anti").select("node", F.lit(0).cast("long").alias("depth")))
    keep = lambda nodes: nodes.write.mode("append").parquet(done)
    keep(left.limit(0))
    while not left.isEmpty():
        free = cut(left.join(remaining.select(F.col("child").alias("node")).distinct(), "node", "left_anti"))
        if free.isEmpty():
            keep(left.select("node", F.lit(None).cast("long").alias("depth")))
            drop(free)
            break
        keep(free)
        gained = remaining.join(free.withColumnRenamed("node", "parent"), "parent").groupBy(F.col("child").alias("node")).agg(F.max(F.col("depth") + F.col("steps")).alias("gained"))
        held = left.join(free, "node", "left_anti").join(gained, "node", "left")
        next_left = cut(held.select("node", F.greatest("depth", F.coalesce("gained", F.lit(0))).alias("depth")))
        next_remaining = cut(remaining.join(free.select(F.col("node").alias("parent")), "parent", "left_anti"))
        drop(left, remaining, free)
        left, remaining = next_left, next_remaining
    drop(left, remaining, edges)
    known = spark.read.schema(left.schema).parquet(done)
    below = single.join(known.withColumnRenamed("node", "top"), "top", "left").select("node", (F.col("depth") + F.col("steps")).alias("depth"))
    return known.unionByName(below).select("node", F.col("depth").cast("int").alias("depth"))


def lineage(edges: DataFrame, nodes: DataFrame, start: DataFrame) -> DataFrame:
    """kind (self, ancestor, descendant, edge), node, other, depth of the nodes around ``start``.

    An edge counts when both its ends are among them; depth of self is its longest ancestral path.
    An unknown start raises.
    """
    if start.join(nodes.select("node"), "node", "left_semi").isEmpty():
        raise ValueError("unknown lot")
    none = F.lit(None).cast("long")
    up, down = cut(related(edges, nodes, start, forward=False)), cut(related(edges, nodes, start))
    ids = cut(start.select("node").unionByName(up.select("node")).unionByName(down.select("node")).distinct())
    inner = edges.join(ids.select(F.col("node").alias("parent")), "parent", "left_semi").join(ids.select(F.col("node").alias("child")), "child", "left_semi")
    # Only edges above the start matter for its depth, those through unknown nodes included.
    above = walk(edges, start, forward=False).select(F.col("node").alias("parent"))
    own = start.join(longest_depth(edges.join(above, "parent", "left_semi")), "node", "left")
    rows = [
        own.select(F.lit("self").alias("kind"), "node", none.alias("other"), F.coalesce("depth", F.lit(0)).alias("depth")), up.select(F.lit("ancestor").alias("kind"), "node", none.alias("other"), "depth"),
        down.select(F.lit("descendant").alias("kind"), "node", none.alias("other"), "depth"), inner.select(F.lit("edge").alias("kind"), F.col("parent").alias("node"), F.col("child").alias("other"), F.lit(None).cast("int").alias("depth")),
    ]
    return reduce(DataFrame.unionByName, rows)


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node table: all part keys but the multiples of 31, whose edges stay."""
    return fab.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")).filter("node % 31 <> 0")


def _start(spark: SparkSession, node: int) -> DataFrame:
    return spark.range(node, node + 1).select(F.col("id").alias("node"))


def ancestors(spark: SparkSession, sf_dir: str, node: int = 777) -> DataFrame:
    return related(dag_edges(spark, sf_dir), _known(spark, sf_dir), _start(spark, node), forward=False)


def descendants(spark: SparkSession, sf_dir: str, node: int = 3) -> DataFrame:
    return related(dag_edges(spark, sf_dir), _known(spark, sf_dir), _start(spark, node))


def lot_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest path from a root to every node."""
    return longest_depth(dag_edges(spark, sf_dir))


def lot_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything around node 45."""
    return lineage(dag_edges(spark, sf_dir), _known(spark, sf_dir), _start(spark, 45))


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of every node as a joined list; an empty one for leaves."""
    nodes = fab.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    lists = tree_edges(spark, sf_dir).groupBy(F.col("parent").alias("node")).agg(F.sort_array(F.collect_list("child")).alias("c"))
    return nodes.join(lists, "node", "left").select("node", F.coalesce(F.array_join("c", ","), F.lit("")).alias("children"))


def cyclic_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes on a cycle or downstream of one: those without a longest depth."""
    ends = [nodes.select(F.col("node").alias(end)) for end in ("parent", "child")]
    inner = edges.join(ends[0], "parent", "left_semi").join(ends[1], "child", "left_semi")
    return longest_depth(inner).filter("depth is null").select("node")


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree with two edges back up (40 to 5, 97 to 12)."""
    nodes = fab.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    back = spark.range(2).select(F.when(F.col("id") == 0, 40).otherwise(97).cast("long").alias("parent"), F.when(F.col("id") == 0, 5).otherwise(12).cast("long").alias("child"))
    return cyclic_nodes(nodes, tree_edges(spark, sf_dir).unionByName(back))


MODELS = ("poisson", "murphy", "negbinom")


def correlate_lots(yields: DataFrame, pairs: DataFrame, model: str = "negbinom", pair_by: str = "panel_id") -> DataFrame:
    """Pearson correlation (population form, 0 when either side is flat) of an ancestor's and a descendant's panel yields.

    ``yields`` has lot_id, panel_id and the models' yields, ``pairs`` ancestor and descendant lots. Panels pair
    by id, so two lots without a common panel give no row; ``ordinal`` pairs them by their place within the lot.
    """
    if model not in MODELS:
        raise ValueError(f"unknown yield model {model!r}")
    rows = yields.select("lot_id", "panel_id", F.col(f"yield_{model}").alias("y"))
    if pair_by == "ordinal":
        rows = rows.withColumn("panel_id", F.row_number().over(Window.partitionBy("lot_id").orderBy("panel_id")))
    side = lambda lot, y: rows.select(F.col("lot_id").alias(lot), "panel_id", F.col("y").alias(y))
    joined = pairs.join(side("ancestor", "a"), "ancestor").join(side("descendant", "b"), ["descendant", "panel_id"])
    agg = joined.groupBy("ancestor", "descendant").agg(
        F.count("*").alias("n_panels"), F.covar_pop("a", "b").alias("cov"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"), F.avg("a").alias("ma"), F.avg("b").alias("mb")
    )
    flat = (F.col("n_panels") < 2) | (F.col("sa") < 1e-12) | (F.col("sb") < 1e-12)
    r = F.when(flat, 0.0).otherwise(F.try_divide("cov", F.col("sa") * F.col("sb")))
    return agg.select("ancestor", "descendant", "n_panels", F.round(r, 6).alias("r"), F.round("ma", 6).alias("mean_ancestor"), F.round("mb", 6).alias("mean_descendant"))


def yield_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lot with itself and the two after it by common panels, and with the next by ordinal."""
    yields = panel_yield(spark, sf_dir).join(fab.panels(spark, sf_dir).select("panel_id", "lot_id"), "panel_id")
    lots = fab.lots(spark, sf_dir).select(F.col("lot_id").alias("ancestor"), "lot_no")
    after = lambda *steps: lots.select("ancestor", F.explode(F.array(*(F.concat(F.lit("LOT"), F.col("lot_no") + k) for k in steps))).alias("descendant"))
    by_panel = correlate_lots(yields, after(0, 1, 2)).withColumn("pairing", F.lit("panel_id"))
    return by_panel.unionByName(correlate_lots(yields, after(1), "poisson", "ordinal").withColumn("pairing", F.lit("ordinal")))


QUERIES = {f.__name__: f for f in (ancestors, descendants, lot_depth, lot_lineage, adjacency, cycles, yield_correlation)}

_E = "WITH RECURSIVE e AS (SELECT p_partkey // 2 AS parent, p_partkey AS child FROM part WHERE p_partkey > 1)"
_G = "WITH RECURSIVE e AS (SELECT p_partkey // 2 AS parent, p_partkey AS child FROM part WHERE p_partkey > 1 UNION SELECT p_partkey - 1, p_partkey FROM part WHERE p_partkey > 1 AND p_partkey % 5 = 0)"
_WALK = ", {2}(node, depth) AS (SELECT {0}::BIGINT, 0 UNION SELECT {1}, depth + 1 FROM {2} JOIN e ON {3} = node)"
_SEEN = "SELECT node, min(depth) AS depth FROM {0} WHERE depth > 0 AND node % 31 <> 0 GROUP BY 1"
_UP, _DOWN = (lambda n: _WALK.format(n, "parent", "u", "child")), (lambda n: _WALK.format(n, "child", "d", "parent"))
ORACLE_SQL = {
    "ancestors": _G + _UP(777) + _SEEN.format("u"),
    "descendants": _G + _DOWN(3) + _SEEN.format("d"),
    "lot_depth": _G + ", d(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT child, depth + 1 FROM d JOIN e ON parent = node) SELECT node, max(depth) AS depth FROM d GROUP BY 1",
    "lot_lineage": _G + _UP(45) + _DOWN(45) + f""", a AS ({_SEEN.format("u")}), b AS ({_SEEN.format("d")}), ids AS (SELECT 45::BIGINT AS node UNION SELECT node FROM a UNION SELECT node FROM b)
SELECT 'self' AS kind, 45::BIGINT AS node, NULL::BIGINT AS other, max(depth) AS depth FROM u UNION ALL SELECT 'ancestor', node, NULL, depth FROM a UNION ALL SELECT 'descendant', node, NULL, depth FROM b
UNION ALL SELECT 'edge', parent, child, NULL FROM e WHERE parent IN (SELECT node FROM ids) AND child IN (SELECT node FROM ids)""",
    "adjacency": _E + " SELECT p_partkey AS node, coalesce((SELECT string_agg(child::VARCHAR, ',' ORDER BY child) FROM e WHERE parent = p_partkey), '') AS children FROM part",
    "cycles": _E + """, f AS (SELECT * FROM e UNION ALL VALUES (40, 5), (97, 12)), r(a, b) AS (SELECT parent, child FROM f WHERE parent >= 5 UNION SELECT a, child FROM r JOIN f ON parent = b WHERE a < 100),
on_cycle AS (SELECT DISTINCT a AS node FROM r WHERE a = b), down(node) AS (SELECT node FROM on_cycle UNION SELECT child FROM down JOIN f ON parent = node) SELECT node FROM down""",
    "yield_correlation": PREFIX + DIES.replace("py1.substrate_type,", "py1.substrate_type AS substrate_type,") + """, y AS (SELECT lot_id, panel_id, yield_poisson, yield_negbinom, row_number() OVER (PARTITION BY lot_id ORDER BY panel_id) AS k FROM py JOIN panels USING (panel_id)),
j AS (SELECT 'panel_id' AS pairing, a.lot_id AS ancestor, b.lot_id AS descendant, a.yield_negbinom AS a, b.yield_negbinom AS b FROM y a JOIN y b USING (panel_id)
  UNION ALL SELECT 'ordinal', a.lot_id, b.lot_id, a.yield_poisson, b.yield_poisson FROM y a JOIN y b ON a.k = b.k JOIN lots l ON l.lot_id = a.lot_id JOIN lots m ON m.lot_id = b.lot_id AND m.lot_no = l.lot_no + 1)
SELECT ancestor, descendant, pairing, count(*) AS n_panels, round(CASE WHEN count(*) < 2 OR stddev_pop(a) < 1e-12 OR stddev_pop(b) < 1e-12 THEN 0.0 ELSE covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END, 6) AS r,
  round(avg(a), 6) AS mean_ancestor, round(avg(b), 6) AS mean_descendant FROM j GROUP BY ALL""",
}
