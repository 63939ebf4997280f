"""Writes that keep keys unique, append-only histories, the file ledger, table copies and product specs.

Tables are Parquet folders. A write appends rows computed against what the folder holds; a rewrite
goes to a new folder, so a lost executor or a failed job never leaves half a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lotwise.functions.lineage import cut, scratch
from lotwise.operators.lots import latest_per_key
from lotwise.plans import fab_view as fab
from lotwise.plans.fab_view import PREFIX
from lotwise.sources.commits import Store
from lotwise.sources.csv_records import read_defect_csv, read_mapped_csv, write_defect_csv

#: Fixed names.
DEFECT_KEY = ["panel_id", "component_row", "component_col", "source_system", "defect_type", "x", "y"]
RELATIONS = ("split", "merge", "rework", "convert", "inspect")
#: Records of a vendor's file, which one task reads: some 20 MB.
VENDOR_ROWS = 250_000
LEDGER = "file_path string, status string, processed_at timestamp"


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether a table was written at ``folder``."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def read_or_empty(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(folder) if exists(spark, folder) else like.limit(0)


def first_writer_wins(existing: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The rows of ``new`` to append: one per key (the first by ``order``), none whose key exists."""
    rest = [c for c in new.columns if c not in key]
    one = new.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, *(F.col(f"r.{c}").alias(c) for c in rest))
    return one.select(*new.columns).join(existing.select(*key), key, "left_anti")


def last_writer_wins(existing: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``existing`` with its rows replaced by those of ``new`` with the same key; of several new ones the last by ``order``."""
    return existing.join(new.select(*key), key, "left_anti").unionByName(latest_per_key(new, key, order))


def checked_edges(edges: DataFrame) -> DataFrame:
    """Genealogy edges; an unknown relation or an edge from a lot to itself fails when read."""
    wrong = F.when(~F.coalesce(F.col("relation_type").isin(*RELATIONS), F.lit(False)), F.concat(F.lit("unknown relation "), F.coalesce("relation_type", F.lit("null"))))
    wrong = wrong.when(F.col("parent_lot_id") == F.col("child_lot_id"), F.concat(F.lit("edge from a lot to itself: "), "parent_lot_id"))
    return edges.withColumn("relation_type", F.when(wrong.isNull(), F.col("relation_type")).otherwise(F.raise_error(wrong)))


def merge_columns(existing: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Inserts new keys; for known ones updates only ``columns``, and those only where the new value is not null."""
    renamed = new.select(*key, *(F.col(c).alias(f"_new_{c}") for c in new.columns if c not in key))
    rows = existing.withColumn("_old", F.lit(True)).join(renamed, key, "full")

    def pick(c: str) -> Column:
        if c not in new.columns:
            return F.col(c)
        return F.when(F.col("_old").isNull(), F.col(f"_new_{c}")).otherwise(F.coalesce(f"_new_{c}", c) if c in columns else F.col(c))

    return rows.select(*key, *(pick(c).alias(c) for c in existing.columns if c not in key))


def append_history(rows: DataFrame, folder: str, at: Column) -> None:
    """Appends a run's rows under its time ``calculated_at``; earlier runs stay."""
    rows.withColumn("calculated_at", at).write.mode("append").parquet(folder)


def unprocessed(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose latest entry in the ledger isn't processed."""
    done = latest_per_key(ledger, ["file_path"], ["processed_at", "status"]).filter("status = 'processed'")
    return files.join(done.select("file_path"), "file_path", "left_anti")


def ingest_csv(spark: SparkSession, path: str, store: Store, skip_if_processed: bool = True) -> int:
    """Appends the files under ``path`` to the store's ``defects``, once each; returns the rows read.

    Rows and ledger entries are one commit, computed against the version that it follows, so a crash at
    any point and a second writer leave each row and each file once. If the read fails the ledger says
    failed for the files, and the error is raised again.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_path"))
    taken: dict[str, object] = {"rows": 0, "files": []}

    def entries(status: str) -> DataFrame:
        rows = spark.createDataFrame([(f, status) for f in taken["files"]], "file_path string, status string")
        return rows.withColumn("processed_at", F.current_timestamp()).coalesce(1)

    def build(version: int) -> dict[str, DataFrame]:
        known = store.read("files", version, LEDGER)
        new = taken["files"] = [r.file_path for r in (unprocessed(files, known) if skip_if_processed else files).collect()]  # names of files
        if not new:
            taken["rows"] = 0
            return {}
        records = cut(read_defect_csv(spark, new))
        taken["rows"] = records.count()
        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields)
        added = first_writer_wins(store.read("defects", version, kind), records, DEFECT_KEY, ["size", "confidence_score"])
        return {"defects": added, "files": entries("processed")}

    try:
        store.transact(build)
    except Exception:
        if taken["files"]:
            store.transact(lambda _: {"files": entries("failed")})
        raise
    return taken["rows"]


def append_events(store: Store, events: DataFrame) -> int:
    """Appends process events as they are, without any key; returns the store's version."""
    return store.transact(lambda _: {"events": events})


def upsert_runs(store: Store, runs: DataFrame) -> int:
    """Appends process runs that are not there: one per panel and time, the first writer wins."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema.fields)
    key = ["panel_id", "run_time"]
    rest = [c for c in runs.columns if c not in key]
    return store.transact(lambda version: {"process_runs": first_writer_wins(store.read("process_runs", version, kind), runs, key, rest)})


def copy_tables(spark: SparkSession, source: dict[str, DataFrame], folder: str, keys: dict[str, list[str]]) -> dict[str, int]:
    """Copies tables in order to Parquet under ``folder``; keys that are there stay. Returns rows added."""
    added = {}
    for name, rows in source.items():
        at, seen = f"{folder}/{name}", Observation()
        new = rows.repartition(*keys[name])  # before the aggregate, which sorts: there's little to combine ahead of a shuffle
        if exists(spark, at):  # rows that are there needn't meet to choose one of each key
            new = rows.join(spark.read.schema(rows.schema).parquet(at).select(*keys[name]), keys[name], "left_anti")
        rest = [c for c in rows.columns if c not in keys[name]]
        one = first_writer_wins(rows.limit(0), new, keys[name], rest or keys[name])
        one.observe(seen, F.count("*").alias("n")).write.mode("append").parquet(at)
        added[name] = seen.get["n"]
    return added


def insert_spec(specs: DataFrame, new: DataFrame) -> DataFrame:
    """``specs`` with new ones; a spec_id that exists fails when read."""
    taken = new.join(specs.select("spec_id", F.lit(True).alias("_taken")), "spec_id", "left")
    fresh = taken.withColumn("spec_id", F.when(F.col("_taken").isNull(), F.col("spec_id")).otherwise(F.raise_error(F.concat(F.lit("spec exists: "), "spec_id")))).drop("_taken")
    return specs.unionByName(fresh)


def update_spec(specs: DataFrame, changes: DataFrame) -> DataFrame:
    """Known specs with the non-null fields of ``changes``; unknown ids change nothing."""
    known = changes.join(specs.select("spec_id"), "spec_id", "left_semi")
    return merge_columns(specs, known, ["spec_id"], [c for c in changes.columns if c != "spec_id"]).select(*specs.columns)


def delete_spec(specs: DataFrame, ids: DataFrame) -> DataFrame:
    return specs.join(ids.select("spec_id"), "spec_id", "left_anti")


def list_specs(specs: DataFrame) -> DataFrame:
    """Newest first, with the die's area."""
    return specs.withColumn("die_area_mm2", F.col("die_width_mm") * F.col("die_height_mm")).orderBy(F.desc("created_at"), "spec_id")


def upsert_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appending all defects to those of the first ten panels: rows to add per panel, natural key unique."""
    every = fab.defects(spark, sf_dir)
    added = first_writer_wins(every.filter("panel_no <= 10"), every, DEFECT_KEY, ["created_at", "defect_key"])
    return added.groupBy("panel_id").agg(F.count("*").alias("added"), F.min("created_at").alias("first"))


def replaced_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lot nodes replaced by the panels that name them, the last panel of each lot winning."""
    nodes = fab.lots(spark, sf_dir).select("lot_id", F.lit("created").alias("process_step"), F.lit(0).cast("long").alias("version"))
    new = fab.panels(spark, sf_dir).filter("panel_no % 3 = 0").select("lot_id", F.col("panel_id").alias("process_step"), F.col("panel_no").cast("long").alias("version"))
    return last_writer_wins(nodes, new, ["lot_id"], ["version"])


def estimate_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of panel defect counts appended to a history, the second of even panels; the newest row of each panel."""
    counts = fab.defects(spark, sf_dir).groupBy("panel_id", "panel_no").agg(F.count("*").alias("n"))
    folder = scratch(spark, "history")
    append_history(counts, folder, F.lit("2024-01-01").cast("timestamp"))
    append_history(counts.filter("panel_no % 2 = 0").withColumn("n", F.col("n") + 1000), folder, F.lit("2024-02-01").cast("timestamp"))
    return latest_per_key(spark.read.parquet(folder), ["panel_id"], ["calculated_at"])


def ingest_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects written as CSV and ingested twice: rows read each time, and rows and files afterwards."""
    folder = scratch(spark, "ingest")
    write_defect_csv(fab.defects(spark, sf_dir), f"{folder}/csv")
    store = Store(spark, f"{folder}/store")
    read = [ingest_csv(spark, f"{folder}/csv/part-*", store) for _ in range(2)]
    rows, files = store.read("defects").count(), store.read("files").filter("status <> 'processed'").count()
    return spark.createDataFrame([(*read, rows, files)], "first_read long, second_read long, rows long, not_processed long")


def mapped_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects written as a vendor's semicolon file with its own names, units and codes, and read by a mapping."""
    folder = scratch(spark, "vendor")
    rows = fab.defects(spark, sf_dir)
    code = F.when(F.col("source_system") == "system_a", "A").otherwise("")
    vendor = rows.select(
        F.col("lot_id").alias("LOT"), F.col("panel_id").alias("WAF"), "component_row", "component_col", code.alias("TOOL"), F.col("defect_type").alias("KIND"), "x", "y",
        F.round(F.col("size") * 1000).cast("int").alias("UM"), F.round(F.col("confidence_score") * 100).cast("int").alias("PCT"),
    )
    vendor.write.option("header", True).option("sep", ";").option("maxRecordsPerFile", VENDOR_ROWS).csv(folder)
    config = {
        "delimiter": ";",
        "columns": {
            "panel_id": {"template": "{LOT}_{WAF}"}, "component_row": "component_row", "component_col": {"column": "component_col", "type": "int"}, "defect_type": "KIND", "x": {"column": "x", "type": "float"},
            "source_system": {"column": "TOOL", "default": "B", "map": {"A": "system_a", "B": "system_b"}}, "y": {"column": "y", "type": "float", "scale": 2}, "size": {"column": "UM", "type": "float", "scale": 0.001},
            "confidence_score": {"column": "PCT", "type": "int", "scale": 0.01},
        },
    }
    return read_mapped_csv(spark, f"{folder}/part-*", config).select("panel_id", "component_row", "component_col", "source_system", "defect_type", "x", "y", "size", "confidence_score")


def process_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the log appended twice (each row twice), process runs upserted twice (each once): rows and values by kind."""
    store, log = Store(spark, scratch(spark, "process")), fab.table(spark, sf_dir, "events")
    events = log.select(F.concat(F.lit("P"), "user_id").alias("panel_id"), F.col("ts").cast("timestamp").alias("event_time"), "event_type", F.col("props").alias("details"))
    runs = log.select(F.concat(F.lit("P"), "user_id").alias("panel_id"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("run_time"), F.col("value").alias("temperature_c"), "event_id")
    for _ in range(2):
        append_events(store, events)
        upsert_runs(store, runs)
    stored = store.read("events").groupBy("panel_id").agg(F.count("*").alias("events"))
    kept = store.read("process_runs").groupBy("panel_id").agg(F.count("*").alias("runs"), F.round(F.sum("temperature_c"), 4).alias("temperature"))
    return stored.join(kept, "panel_id")


def table_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that two copies of the tables add."""
    source = {"panels": fab.panels(spark, sf_dir), "components": fab.components(spark, sf_dir), "defects": fab.defects(spark, sf_dir)}
    keys, folder = {"panels": ["panel_id"], "components": ["panel_id", "component_row", "component_col"], "defects": DEFECT_KEY}, scratch(spark, "copy")
    first, second = (copy_tables(spark, source, folder, keys) for _ in range(2))
    return spark.createDataFrame([(k, n, second[k]) for k, n in first.items()], "table_name string, first_copy long, second_copy long")


def product_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs made of parts: inserted, every third updated, every seventh deleted, listed."""
    part = fab.table(spark, sf_dir, "part")
    every = part.select(
        F.concat(F.lit("S"), "p_partkey").alias("spec_id"), F.col("p_name").alias("product_name"), F.col("p_size").cast("double").alias("die_width_mm"), (F.col("p_size") * 2).cast("double").alias("die_height_mm"),
        F.lit(None).cast("string").alias("notes"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("p_partkey")).alias("created_at"), "p_partkey",
    )
    specs = insert_spec(every.filter("p_partkey % 2 = 0"), every.filter("p_partkey % 2 = 1"))
    changes = every.filter("p_partkey % 3 = 0").select("spec_id", F.lit(None).cast("string").alias("product_name"), (F.col("die_width_mm") + 1).alias("die_width_mm"), F.lit("changed").alias("notes"))
    left = delete_spec(update_spec(specs, changes), every.filter("p_partkey % 7 = 0"))
    return list_specs(left.drop("p_partkey"))


QUERIES = {f.__name__: f for f in (upsert_defects, replaced_lots, estimate_history, ingest_ledger, process_history, mapped_csv, table_copy, product_specs)}
_KEYS = "SELECT DISTINCT " + ", ".join(DEFECT_KEY) + " FROM defects"
ORACLE_SQL = {
    "upsert_defects": PREFIX + """, k AS (SELECT panel_id, component_row, component_col, source_system, defect_type, x, y, min(created_at) AS t FROM defects WHERE panel_no > 10 GROUP BY ALL)
SELECT panel_id, count(*) AS added, min(t) AS first FROM k GROUP BY 1""",
    "replaced_lots": PREFIX + """, n AS (SELECT lot_id, arg_max(panel_id, panel_no) AS process_step, max(panel_no)::BIGINT AS version FROM panels WHERE panel_no % 3 = 0 GROUP BY 1)
SELECT lot_id, coalesce(process_step, 'created') AS process_step, coalesce(version, 0) AS version FROM lots LEFT JOIN n USING (lot_id)""",
    "estimate_history": PREFIX + """SELECT panel_id, panel_no, CASE WHEN panel_no % 2 = 0 THEN count(*) + 1000 ELSE count(*) END AS n,
  CASE WHEN panel_no % 2 = 0 THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS calculated_at FROM defects GROUP BY panel_id, panel_no""",
    "ingest_ledger": PREFIX + f"SELECT count(*) AS first_read, 0::BIGINT AS second_read, (SELECT count(*) FROM ({_KEYS})) AS rows, 0::BIGINT AS not_processed FROM defects",
    "process_history": """WITH r AS (SELECT user_id, date_trunc('hour', ts) AS h, arg_min(value, (value, event_id)) AS v FROM events GROUP BY ALL),
k AS (SELECT user_id, count(*) AS runs, round(sum(v), 4) AS temperature FROM r GROUP BY 1) SELECT 'P' || user_id AS panel_id, 2 * count(*) AS events, any_value(runs) AS runs, any_value(temperature) AS temperature FROM events JOIN k USING (user_id) GROUP BY user_id""",
    "mapped_csv": PREFIX + """SELECT lot_id || '_' || panel_id AS panel_id, component_row, component_col, source_system, defect_type, x, y * 2 AS y, round(size * 1000) * 0.001::DOUBLE AS size,
  round(confidence_score * 100)::INT * 0.01::DOUBLE AS confidence_score FROM defects""",
    "table_copy": PREFIX + f"SELECT 'panels' AS table_name, count(*) AS first_copy, 0::BIGINT AS second_copy FROM panels UNION ALL SELECT 'components', count(*), 0 FROM components UNION ALL SELECT 'defects', count(*), 0 FROM ({_KEYS})",
    "product_specs": """SELECT 'S' || p_partkey AS spec_id, p_name AS product_name, (p_size + (p_partkey % 3 = 0)::INT)::DOUBLE AS die_width_mm, (p_size * 2)::DOUBLE AS die_height_mm,
  CASE WHEN p_partkey % 3 = 0 THEN 'changed' END AS notes, make_timestamp((1700000000 + p_partkey) * 1000000) AS created_at, (p_size + (p_partkey % 3 = 0)::INT)::DOUBLE * (p_size * 2) AS die_area_mm2 FROM part WHERE p_partkey % 7 <> 0""",
}
