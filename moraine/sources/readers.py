"""Readers of ledgers, catalogues and series, and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LEDGER = "entry_id string, source string, product_id string, aoi_id string, event_id string, status string, path string, sha256 string, size_bytes long, time_start timestamp, time_end timestamp, recorded_at timestamp"
GEOJSON = "features array<struct<id string, properties struct<mag double, place string, time long, type string>, geometry struct<coordinates array<double>>>>"
OVERPASS = "elements array<struct<type string, id long, lat double, lon double, nodes array<long>, tags map<string,string>>>"


def ledger(spark: SparkSession, path: str, schema: str | StructType = LEDGER) -> DataFrame:
    """One JSON row a line, blank lines skipped, a bad line fails; ``ordinal`` grows with the place in a file."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path).withColumn("ordinal", F.monotonically_increasing_id())


def append_ledger(rows: DataFrame, path: str) -> None:
    """Rows are added as new files; nothing is rewritten."""
    rows.write.mode("append").json(path)


def records(spark: SparkSession, folder: str, schema: str | StructType) -> DataFrame:
    """One JSON document a file; the first invalid one fails."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(folder).withColumn("file", F.col("_metadata.file_name"))


def geojson_events(documents: DataFrame, column: str = "value") -> DataFrame:
    """Rows of a feature collection, or of a single feature, given as text."""
    many = F.from_json(column, GEOJSON)["features"]
    one = F.from_json(F.concat(F.lit('{"features":['), F.col(column), F.lit("]}")), GEOJSON)["features"]
    rows = documents.select(F.explode(F.coalesce(many, one)).alias("f"))
    c = F.col("f.geometry.coordinates")
    return rows.select(
        F.col("f.id").alias("event_id"), F.timestamp_millis(F.col("f.properties.time")).alias("time_utc"), F.get(c, 1).alias("latitude"), F.get(c, 0).alias("longitude"), F.get(c, 2).alias("depth_km"),
        F.col("f.properties.mag").alias("magnitude"), F.lower("f.properties.type").alias("type"), F.col("f.properties.place").alias("place"),
    )


def matching(events: DataFrame, start, end, kind: str | None = None, least: float | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Half-open time, type without case, least magnitude (null fails), closed box (west, south, east, north)."""
    out = events.where((F.col("time_utc") >= start) & (F.col("time_utc") < end))
    if kind is not None:
        out = out.where(F.lower("type") == kind.lower())
    if least is not None:
        out = out.where(F.col("magnitude") >= least)
    if box is not None:
        out = out.where(F.col("longitude").between(box[0], box[2]) & F.col("latitude").between(box[1], box[3]))
    return out


def overpass_elements(documents: DataFrame, column: str = "value") -> DataFrame:
    return documents.select(F.explode(F.from_json(column, OVERPASS)["elements"]).alias("e")).select("e.*")


def catalogue_xml(spark: SparkSession, path: str, row_tag: str, schema: str | StructType, root: str | None = None) -> DataFrame:
    """Records of XML documents. With ``root``, the name of the documents' outer element, a ``count`` that any declares must be that of its records, so a document that was cut off fails."""
    rows = spark.read.format("xml").option("rowTag", row_tag).option("mode", "FAILFAST").schema(schema).load(path)
    if root is None:
        return rows
    heads = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("x"))
    opened, ended = rf"(?s)<{root}[\s>/]", rf"(?s)(</{root}\s*>|<{root}[^>]*/>)\s*$"
    checked = heads.select(
        "file", F.regexp_extract("x", rf"(?s)<{root}[^>]*\scount\s*=\s*[\"']([0-9]+)", 1).alias("declared"), F.regexp_count("x", F.lit(rf"<{row_tag}[\s>/]")).alias("n"), (~F.col("x").rlike(opened)).alias("other"), (~F.col("x").rlike(ended)).alias("open")
    )
    problem = F.when(F.col("other"), F.concat(F.lit(f"no <{root}> in "), "file")).when(F.col("open"), F.concat(F.lit("truncated: "), "file")).when((F.col("declared") != "") & (F.col("declared").cast("long") != F.col("n")), F.concat(F.lit("declares "), "declared", F.lit(" records and holds "), F.col("n").cast("string"), F.lit(": "), "file"))
    bad = checked.select(problem.alias("p")).where("p is not null").limit(1).collect()
    if bad:
        raise ValueError(bad[0].p)
    return rows


def measurement(value: str, low: str, high: str, unit: str):
    """A triple as one interval; null when all three are absent."""
    return F.when(F.coalesce(value, low, high).isNotNull(), F.struct(F.col(low).alias("low"), F.col(high).alias("high"), F.col(value).alias("best"), F.lit(unit).alias("unit")))


def parallel_series(rows: DataFrame, keys: list[str], times: str, values: str) -> DataFrame:
    """Two arrays as (t, value) rows; unequal lengths fail."""
    same = F.when(F.size(times) == F.size(values), F.arrays_zip(F.col(times).alias("t"), F.col(values).alias("value"))).otherwise(F.raise_error(F.lit("time and value arrays differ in length")))
    return rows.select(*keys, F.inline(same))


def chunked(rows: DataFrame, keys: list[str], samples: str, size: int) -> DataFrame:
    """A sample array as chunks of ``size`` with their sequence; the last may be shorter."""
    at = F.when(F.size(samples) > 0, F.sequence(F.lit(0), F.floor((F.size(samples) - 1) / size).cast("int")))
    return rows.select(*keys, samples, F.explode(at).alias("sequence")).select(*keys, "sequence", F.slice(samples, F.col("sequence") * size + 1, size).alias("data"))


def synthetic_chunks(spark: SparkSession, channels: int, chunks: int, size: int, seed: int, burst: tuple[int, float] | None = None) -> DataFrame:
    """Gaussian noise by channel and sequence, the same on every run; burst: from which chunk, and by what factor."""
    rows = spark.range(channels * chunks).select((F.col("id") % channels).alias("channel"), F.floor(F.col("id") / channels).alias("sequence"))
    u = lambda k: (F.pmod(F.xxhash64("channel", "sequence", F.lit(seed), F.lit(k), "i"), F.lit(1 << 53)) + 1) / float((1 << 53) + 1)
    normal = F.sqrt(-2 * F.log(u(0))) * F.cos(2 * 3.141592653589793 * u(1))
    scale = F.when(F.col("sequence") >= burst[0], burst[1]).otherwise(1.0) if burst else F.lit(1.0)
    points = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("x", normal * scale)
    return points.groupBy("channel", "sequence").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("data"))


def file_index(spark: SparkSession, folder: str) -> DataFrame:
    """path, sha256 and size of every file; contents are hashed where they are read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return rows.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def index_hash(index: DataFrame) -> DataFrame:
    """One hash of a whole index, from the sorted rows; an index is a row a file."""
    line = F.concat_ws("\t", "path", "sha256", "size")
    return index.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("sha256"), F.count("*").alias("n"))


def write_file_index(spark: SparkSession, folder: str, path: str) -> tuple[str, int]:
    """Writes the index of a folder as one text file, a line ``path, hash, size`` a file in order of the path below the folder; its own hash and the number of lines come back.

    Files are hashed where they are read; only lines, one a file, go to the task that writes. The same files give the same
    index, in whatever order they are listed.
    """
    jvm = spark._jvm.org.apache.hadoop.fs
    top = jvm.Path(folder)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    base = files.makeQualified(top).toUri().getPath().rstrip("/") + "/"
    below = F.substring_index("path", base, -1)
    held = file_index(spark, folder)
    empty = []
    if files.getContentSummary(top).getFileCount() > held.select("path").count():  # Spark's scans leave empty files out
        listed = files.listFiles(top, True)
        while listed.hasNext():
            status = listed.next()
            if not status.getLen():
                empty.append((status.getPath().toString(),))
    none = spark.createDataFrame(empty, "path string").select("path", F.sha2(F.lit(""), 256).alias("sha256"), F.lit(0).cast("long").alias("size"))
    lines = held.unionByName(none).select(below.alias("path"), "sha256", "size").orderBy("path").select(F.concat_ws("\t", "path", "sha256", "size").alias("value"))
    target, parts = jvm.Path(path), f"{path}.parts"
    lines.coalesce(1).write.mode("overwrite").text(parts)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration())
    written = next(s.getPath() for s in out.listStatus(jvm.Path(parts)) if s.getPath().getName().startswith("part-"))
    out.delete(target, False)
    out.rename(written, target)
    out.delete(jvm.Path(parts), True)
    digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h"), F.regexp_count(F.col("content").cast("string"), F.lit("\n")).alias("n")).first()
    return digest.h, digest.n


def verify_file_index(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """(path, kind) of what differs between an index that ``write_file_index`` wrote and the folder, whose files are hashed again: missing, changed, or stale (not in the index)."""
    noted = spark.read.text(path).where("value <> ''").select(F.split("value", "\t").alias("x")).select(F.get("x", F.lit(0)).alias("path"), F.concat_ws("\t", F.get("x", F.lit(1)), F.get("x", F.lit(2))).alias("noted"))
    again = f"{path}.again"
    write_file_index(spark, folder, again)
    found = spark.read.text(again).where("value <> ''").select(F.split("value", "\t").alias("x")).select(F.get("x", F.lit(0)).alias("path"), F.concat_ws("\t", F.get("x", F.lit(1)), F.get("x", F.lit(2))).alias("found"))
    kind = F.when(F.col("found").isNull(), "missing").when(F.col("noted").isNull(), "stale").when(F.col("noted") != F.col("found"), "changed")
    return noted.join(found, "path", "full").select("path", kind.alias("kind")).where("kind is not null")


def write_cube(samples: DataFrame, path: str) -> None:
    """Long cube partitioned by layer and day, so that a read of one layer and time prunes to its files."""
    samples.repartition("layer", "day").write.partitionBy("layer", "day").option("compression", "zstd").mode("overwrite").parquet(path)


def catalogue_items(layers: DataFrame) -> DataFrame:
    """A JSON item for each time, listing the layers valid then. layers: time, layer, valid."""
    held = layers.groupBy("time").agg(F.sort_array(F.collect_set(F.when(F.col("valid"), F.col("layer")))).alias("layers"))
    return held.select("time", F.to_json(F.struct(F.lit("Feature").alias("type"), F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"), "layers")).alias("item"))


def station_rows(inventory: DataFrame, centre: str, origin: tuple[float, float] | None = None) -> DataFrame:
    """One row a channel of nested networks (code, restricted, stations[code, channels[code, location, latitude, longitude, elevation, rate]]), with key and distance from an origin, nearest first and those without a distance last."""
    from moraine.functions import geo

    rows = inventory.select(F.col("code").alias("network"), "restricted", F.explode("stations").alias("s")).select("network", "restricted", F.col("s.code").alias("station"), F.explode("s.channels").alias("c"))
    km = geo.haversine_km(F.lit(float(origin[0])), F.lit(float(origin[1])), F.col("c.latitude"), F.col("c.longitude")) if origin else F.lit(None).cast("double")
    location = F.coalesce("c.location", F.lit(""))
    out = rows.select(
        F.concat_ws(".", "network", "station", location, "c.code").alias("key"), "network", "station", location.alias("location"), F.col("c.code").alias("channel"), "c.latitude", "c.longitude", F.col("c.elevation").alias("elevation_m"),
        F.when(F.col("c.rate") != 0, F.col("c.rate")).alias("rate_hz"), km.alias("distance_km"), F.lit(centre).alias("data_centre"), (F.col("restricted") != "open").alias("is_restricted"),
    )
    return out.orderBy(F.asc_nulls_last("distance_km"), "key")


def cited_observations(observations: DataFrame, station: str, start, end, day_start, day_end) -> DataFrame:
    """Readings of a station in a closed window; one without a time belongs to the event's day and matches any window that meets it. None is an error."""
    inside = F.when(F.col("time_utc").isNotNull(), F.col("time_utc").between(start, end)).otherwise((F.lit(start) <= F.lit(day_end)) & (F.lit(end) >= F.lit(day_start)))
    out = observations.where((F.col("station_id") == station) & inside)
    if not out.limit(1).count():
        raise LookupError(f"no reported observations for {station!r} in the window")
    return out


def first_matching(events: DataFrame, limit: int, **query) -> DataFrame:
    """What ``matching`` keeps, the first so many rows in the order of ``ordinal``."""
    return matching(events, **query).orderBy("ordinal").limit(limit)


def index_rows(records: DataFrame, key: str, plain: list[str], ranges: str, prefixes: dict[str, str], sources: str, document: str) -> DataFrame:
    """One wide row a nested record: plain columns, low, high and best of each range by prefix, number of sources and the document's hash, in order of the key."""
    parts = [F.try_element_at(ranges, F.lit(field))[part].alias(f"{prefix}_{part}") for prefix, field in prefixes.items() for part in ("low", "high", "best")]
    return records.select(key, *plain, *parts, F.size(sources).alias("n_sources"), F.sha2(document, 256).alias("json_sha256")).orderBy(key)


def write_index(rows: DataFrame, path: str) -> None:
    """The whole index, written anew."""
    rows.write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """An index, only the columns asked for."""
    found = spark.read.parquet(path)
    return found.select(*columns) if columns else found


def write_window_store(windows: DataFrame, path: str) -> None:
    """windows: window, slot, component, samples, valid; a folder a range of windows, so that a read of some prunes to theirs."""
    windows.withColumn("part", F.floor(F.col("window") / 1024)).repartition("part").sortWithinPartitions("window", "slot", "component").write.partitionBy("part").mode("overwrite").parquet(path)


def read_windows(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The rows of windows first to last; other folders aren't opened."""
    return spark.read.parquet(path).where(F.col("part").between(first // 1024, last // 1024) & F.col("window").between(first, last)).drop("part")


def write_unit_cube(cube: DataFrame, path: str, provenance: dict[str, str]) -> None:
    """A cube of units by time with what it was made from, which each column's metadata carries."""
    noted = cube.select(*[F.col(c).alias(c, metadata={"provenance": provenance}) for c in cube.columns])
    noted.write.partitionBy("day").mode("overwrite").parquet(path)


def force_csv(histories: DataFrame, path: str) -> None:
    """Samples of force histories (key, i, up, north, east) as CSV with a header, sorted within each file."""
    histories.repartitionByRange("key", "i").sortWithinPartitions("key", "i").write.option("header", True).mode("overwrite").csv(path)


def markdown_lines(cells: DataFrame, rows: list[str], column: str, names: list[str], value: str) -> DataFrame:
    """(place, line): a table of cells (row keys, column, value) as Markdown, header and rule first, then the rows by their keys. A dash where there is no cell. names: the columns, in order."""
    wide = cells.groupBy(*rows).pivot(column, names).agg(F.first(value))
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[text(c) for c in [*rows, *names]]), F.lit(" |"))
    head = [f"| {' | '.join([*rows, *names])} |", "|" + "---|" * (len(rows) + len(names))]
    top = F.explode(F.array(*[F.struct(F.array(F.lit(k)).cast("array<string>").alias("place"), F.lit(x).alias("line")) for k, x in enumerate(head)]))
    header = cells.sparkSession.range(1).select(top.alias("t")).select("t.*")
    body = wide.select(F.concat(F.array(F.lit("2")), F.array(*[F.col(c).cast("string") for c in rows])).alias("place"), line.alias("line"))
    return header.unionByName(body).orderBy("place")


def merged_tables(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """The union of tables with the name of each; a key in more than one row is an error that names it, raised when the result is read."""
    rows = None
    for name, df in tables.items():
        part = df.withColumn("table", F.lit(name))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    twice = rows.groupBy(key).agg(F.count("*").alias("_n"))
    return rows.join(twice, key).withColumn(key, F.when(F.col("_n") == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("duplicate key "), F.col(key).cast("string"))))).drop("_n")
