"""Domain views over the test tables, and readers of the formats that feed them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowspark.functions.arrays import digest_number
from flowspark.functions.timing import micros

EVENT_TYPES = ("VehicleEnter", "VehicleExit", "PersonEnter", "PersonExit")
_KINDS = {"view": "VehicleEnter", "click": "VehicleExit", "signup": "PersonEnter", "purchase": "PersonExit"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _kind() -> Column:
    out = None
    for raw, kind in _KINDS.items():
        out = F.when(F.col("event_type") == raw, kind) if out is None else out.when(F.col("event_type") == raw, kind)
    return out.otherwise("Invalid")


def ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, device_id, event_type, occurred_at, us): enter and exit events, some of an invalid type."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.concat(F.lit("cam-"), (F.col("user_id") % 32).cast("string")).alias("device_id"), _kind().alias("event_type"), F.col("ts").alias("occurred_at"), micros("ts").alias("us"))


def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowspark.operators.events import known_types

    return known_types(ingest(spark, sf_dir))


def duplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ingest`` with every tenth event sent again (arrival 1), every fiftieth of them with another type."""
    base = ingest(spark, sf_dir).withColumn("arrival", F.lit(0))
    again = base.where("event_id % 10 = 0").withColumn("arrival", F.lit(1)).withColumn("event_type", F.when(F.col("event_id") % 50 == 0, "PersonExit").otherwise(F.col("event_type")))
    return base.union(again)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Congestion reports: (report_id, device_id, roi_vehicles, roi_persons, v_flow, p_flow, reported_at, us)."""
    e = table(spark, sf_dir, "events")
    k = F.from_json("props", "k int")["k"]
    return e.select(F.col("event_id").alias("report_id"), F.concat(F.lit("cam-"), (F.col("user_id") % 32).cast("string")).alias("device_id"), (k % 25).alias("roi_vehicles"), (k % 60).alias("roi_persons"), F.col("value").alias("v_flow"), (F.col("value") / 2).alias("p_flow"), F.col("ts").alias("reported_at"), micros("ts").alias("us"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track observations: (device_id, track_id, class_name, n, t, x, y) at 5 a second for each track."""
    e = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    classes = F.array(*[F.lit(c) for c in ("person", "bicycle", "motorcycle", "car", "truck", "bus")])
    return e.select(
        F.concat(F.lit("cam-"), (F.col("user_id") % 32).cast("string")).alias("device_id"),
        F.col("user_id").alias("track_id"),
        F.get(classes, (F.col("user_id") % 6).cast("int")).alias("class_name"),
        n.alias("n"),
        (n * 0.2).alias("t"),
        (F.from_json("props", "k int")["k"] / 100.0).alias("x"),
        ((F.col("value") % 100) / 100.0).alias("y"),
    )


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices from suppliers: name, category, place, nation and region; some names carry spaces."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    kinds = F.array(*[F.lit(c) for c in ("both-way lane", "entry gate", "exit gate", "walkway", "checkpoint")])
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        F.col("s_suppkey").alias("device_key"),
        F.when(F.col("s_suppkey") % 7 == 0, F.concat(F.col("n_name"), F.lit(" gate "), F.col("s_suppkey").cast("string"))).otherwise(F.concat(F.col("n_name"), F.lit("gate"), F.col("s_suppkey").cast("string"))).alias("name"),
        F.get(kinds, (F.col("s_suppkey") % 5).cast("int")).alias("category"),
        ((F.col("s_suppkey") * 37 % 360 - 180) / 10.0).alias("longitude"),
        ((F.col("s_suppkey") * 53 % 180 - 90) / 10.0).alias("latitude"),
        F.col("n_name").alias("nation"),
        F.col("r_name").alias("region"),
        F.col("s_acctbal").alias("load"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five regions with a centre and officers, in a fixed order."""
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("ordinal"), F.col("r_name").alias("region"), (F.col("r_regionkey") * 7.0 - 14.0).alias("center_x"), (F.col("r_regionkey") * 3.5 - 7.0).alias("center_y"), (F.col("r_regionkey") * 2 + 3).cast("int").alias("officers"))


# readers ------------------------------------------------------------------------------------------

INGEST_SCHEMA = "event_id string, device_id string, event_type string, occurred_at string, evidence string"


def read_events_json(spark: SparkSession, path: str) -> DataFrame:
    """Events as JSON lines; lines that don't parse stay as rows with ``corrupt``."""
    return spark.read.schema(f"{INGEST_SCHEMA}, corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(path)


def read_points_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("name string, category string, longitude double, latitude double, status string").csv(path)


def read_seed_json(spark: SparkSession, path: str, excluded_prefix: str = "_") -> DataFrame:
    """A JSON object of name -> record as rows; names with the prefix are comments."""
    raw = spark.read.text(path, wholetext=True)
    pairs = raw.select(F.explode(F.from_json("value", "map<string, struct<category:string, point_id:string, longitude:double, latitude:double>>")).alias("name", "r"))
    return pairs.where(~F.startswith("name", F.lit(excluded_prefix))).select("name", "r.*")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of text logs, without empty lines: numbers follow each file, and count empty lines.

    A file is read in splits. Each counts its lines, sums of the counts before it give the number of its first line, and
    no task holds more than a split. Lines end in LF, CR or both.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    numbered = lines.join(begins, ["file", "block"])
    return numbered.where("value != ''").select((F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "value")


def read_jdbc(spark: SparkSession, url: str, query: str, partition: tuple[str, str, str, int] | None = None, **options: str) -> DataFrame:
    """Rows of a query; ``partition``: a column, its least and greatest value, and how many parts are read at once."""
    if partition is None:
        return spark.read.format("jdbc").options(url=url, query=query, **options).load()
    column, least, most, parts = partition
    return spark.read.format("jdbc").options(url=url, dbtable=f"({query}) q", partitionColumn=column, lowerBound=least, upperBound=most, numPartitions=parts, **options).load()


def by_prefix(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    """Rows whose key begins with ``prefix``; the scan gets the filter."""
    return rows.where(F.startswith(key, F.lit(prefix)))


def read_rules(path: str) -> dict:
    """Rules of a YAML or JSON file, read anew at each call: once a micro-batch."""
    import json

    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text) or {}


def paged(fetch, size: int = 100) -> list[dict]:
    """All items of a paged source with proof of completeness: no duplicate id, a steady total, no short page."""
    items: dict[str, dict] = {}
    total, page = None, 1
    while total is None or len(items) < total:
        got = fetch(page, size)
        if total is not None and got["total"] != total:
            raise ValueError("the total changed between pages")
        total = got["total"]
        if len(got["list"]) < min(size, total - len(items)):
            raise ValueError("a page came short")
        for item in got["list"]:
            if item["id"] in items:
                raise ValueError(f"duplicate id {item['id']}")
            items[item["id"]] = item
        page += 1
    return list(items.values())


def synthetic_events(spark: SparkSession, devices: int, hours: int, weights: list[float], rate: float, seed: int = 7) -> DataFrame:
    """Events by a Poisson number for each device and hour (24 hourly weights), by inversion of a seeded uniform."""
    table_ = F.array(*[F.lit(float(w)) for w in weights])
    slots = spark.range(devices * hours).select((F.col("id") % devices).alias("d"), F.floor(F.col("id") / devices).alias("h"))
    mean = slots.withColumn("mean", F.get(table_, (F.col("h") % 24).cast("int")) * rate)
    u = digest_number("d", "h", F.lit(seed)) / float(1 << 52)
    # beyond ten deviations and forty nothing is left of 52 bits; the terms are summed by their logarithms
    steps = F.sequence(F.lit(0), F.ceil(F.col("mean") + 10 * F.sqrt("mean") + 40))
    term = lambda a: a["l"] + F.log(F.col("mean")) - F.log(a["n"] + 1)
    start = F.struct(F.lit(0).cast("long").alias("n"), (-F.col("mean")).alias("l"), F.exp(-F.col("mean")).alias("c"))
    more = lambda a: F.struct((a["n"] + 1).alias("n"), term(a).alias("l"), (a["c"] + F.exp(term(a))).alias("c"))
    counted = mean.withColumn("u", u).withColumn("n", F.when(F.col("mean") > 0, F.aggregate(steps, start, lambda a, i: F.when(F.col("u") > a["c"], more(a)).otherwise(a))["n"]).otherwise(0))
    each = counted.where("n > 0").select("d", "h", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    return each.select(F.concat_ws("-", "d", "h", "i").alias("event_id"), F.concat(F.lit("cam-"), F.col("d").cast("string")).alias("device_id"), F.get(F.array(*[F.lit(t) for t in EVENT_TYPES]), (digest_number("d", "h", "i") % 4).cast("int")).alias("event_type"), "h")


def synthetic_episodes(spark: SparkSession, devices: int, periods: int, weights: list[float], chance: float = 0.02, seed: int = 11) -> DataFrame:
    """Congestion episodes of 2 to 5 periods; their chance rises with the hour's weight. (device_id, period, congested)"""
    table_ = F.array(*[F.lit(float(w)) for w in weights])
    slots = spark.range(devices * periods).select((F.col("id") % devices).alias("d"), F.floor(F.col("id") / devices).alias("p"))
    u = digest_number("d", "p", F.lit(seed)) / float(1 << 52)
    starts = slots.where(u < F.get(table_, (F.col("p") % len(weights)).cast("int")) * chance)
    spans = starts.select("d", F.explode(F.sequence(F.col("p"), F.col("p") + 1 + digest_number("p", "d") % 4)).alias("p")).distinct().withColumn("congested", F.lit(True))
    return slots.join(spans, ["d", "p"], "left").select(F.concat(F.lit("cam-"), F.col("d").cast("string")).alias("device_id"), F.col("p").alias("period"), F.coalesce("congested", F.lit(False)).alias("congested"))
