"""Event lines: reading, parsing, rejects and ingest statistics.

Works alike on batch and streaming DataFrames with a ``raw`` string column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from runtime_insights import schema as S
from runtime_insights.functions import fields as X, timestamps as TS
from runtime_insights.functions.classify import profile_category

_STRICT = {"allowSingleQuotes": "false"}


# Files have no arrival time of their own; when one was last written stands for it.
_FILE_COLUMNS = (
    "value AS raw", "_metadata.file_path AS file", "_metadata.file_modification_time AS ingest_ts",
)


# --------------------------------------------------------------------- sources

def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of the files at ``path``; an empty table if nothing is there."""
    try:
        lines = spark.read.option("ignoreMissingFiles", "true").text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], "value string").withColumn(
            "_metadata", F.struct(
                F.lit("").alias("file_path"),
                F.lit(None).cast("timestamp").alias("file_modification_time"))
        )
    return lines.selectExpr(*_FILE_COLUMNS)


def stream_lines(
    spark: SparkSession, path: str, files_per_trigger: int | None = None
) -> DataFrame:
    """Follow a folder of log files; the rate limit is the bounded buffer."""
    reader = spark.readStream.format("text")
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).select(
        F.col("value").alias("raw"), F.current_timestamp().alias("ingest_ts")
    )


def stream_topic(
    spark: SparkSession,
    servers: str,
    topic: str,
    offsets_per_trigger: int | None = None,
    starting: str = "latest",
) -> DataFrame:
    """Follow a Kafka topic, by default only what arrives after the start, all of it.

    ``offsets_per_trigger`` bounds a batch; what arrives faster waits in the topic.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("startingOffsets", starting)
    )
    if offsets_per_trigger is not None:
        reader = reader.option("maxOffsetsPerTrigger", offsets_per_trigger)
    return reader.load().select(
        F.col("value").cast("string").alias("raw"), F.col("timestamp").alias("ingest_ts")
    )


def since(events: DataFrame, start: Column) -> DataFrame:
    """Only events from ``start`` on, for sources that cannot start from now."""
    return events.filter(F.col("ts") >= start)


# --------------------------------------------------------------------- parsing

def json_object(raw: Column) -> Column:
    """Top-level keys of one JSON object as text, null if ``raw`` is anything else.

    Parsing it inside brackets makes a second value or trailing text on the line an
    error instead of silently reading the first value only.
    """
    return _single_object(raw)[0]


def _single_object(raw: Column) -> Column:
    """``json_object`` in an array of one."""
    values = F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<map<string,string>>", _STRICT)
    return F.transform(F.array(values), lambda v: F.when(F.size(v) == 1, v[0]))


def _once(df: DataFrame, name: str, single: Column) -> DataFrame:
    """Add the one element of ``single`` by a generator.

    The optimizer copies a projected expression into each of its uses, so a line would
    be parsed many times over; it does not copy generators.
    """
    return df.select("*", F.explode(single).alias(name))


def is_json(raw: Column) -> Column:
    values = F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>", _STRICT)
    return F.coalesce(F.size(values) == 1, F.lit(False))


def parse_event_data(data: Column) -> Column:
    """Object of a JSON text, the empty object if it is not one."""
    return F.coalesce(json_object(data), F.create_map().cast(S.FIELDS))


def inner_fields(whole: Column) -> Column:
    """The inner map where the key exists (even null), else the record itself."""
    inner = F.from_json(X.field(whole, "output_fields"), S.FIELDS, _STRICT)
    return F.when(X.has_field(whole, "output_fields"), inner).otherwise(whole)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Add ``whole``, ``fields``, ``category``, ``event_ts`` and ``reason`` to the lines.

    ``reason`` is null for a usable event, else it says why the line goes to rejects.
    Empty objects are dropped, as are blank lines. Events without a time of their own
    get that of the optional column ``ingest_ts``.
    """
    whole, fields = F.col("whole"), F.col("fields")
    objects = _once(lines.filter(~X.is_blank(F.col("raw"))), "whole", _single_object(F.col("raw")))
    parsed = _once(
        objects.filter(whole.isNull() | (F.size(whole) > 0)),
        "fields", F.array(inner_fields(whole)),
    ).withColumn(
        "category", profile_category(X.field(whole, "rule"), X.field(whole, "evt.type"))
    )
    ingest = F.col("ingest_ts") if "ingest_ts" in lines.columns else F.lit(None)
    parsed = _once(parsed, "event_ts", F.array(
        TS.event_time(X.field(whole, "time"), fields, ingest.cast("timestamp"))))
    category = F.col("category")

    def null_value(key: str) -> Column:
        return X.field(fields, key).isNull() & X.has_field(fields, key)

    fd_name = F.coalesce(X.field(fields, "fd.name"), F.lit(""))
    reason = (
        F.when(whole.isNull(), F.when(is_json(F.col("raw")), "not an object").otherwise("not JSON"))
        .when(X.field(whole, "rule").isNull() & X.has_field(whole, "rule"), "null rule")
        .when(fields.isNull(), "null output_fields")
        .when(F.col("event_ts").isNull(), "no event time")
        .when(category == "unknown", None)
        .when(null_value("evt.type") | null_value("proc.name"), "null operation or process")
        .when((category == "process") & null_value("proc.cmdline"), "null command line")
        .when((category == "network") & (fd_name != "") & null_value("fd.type"),
              "null descriptor type")
        .when((category == "network") & (F.size(F.split(fd_name, "->")) > 2), "two arrows")
    )
    return parsed.withColumn("reason", reason)


def _sequence(fields: Column) -> Column:
    return F.coalesce(X.field(fields, "evt.num").try_cast("bigint"), F.lit(0))


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull()).select("raw", "reason")


def typed_events(parsed: DataFrame) -> DataFrame:
    """Usable events in the flat schema; ``evt.num`` breaks ties of time."""
    whole, fields = F.col("whole"), F.col("fields")

    def text(key: str, default: str = "") -> Column:
        return X.field_if_present(fields, key, default)

    return parsed.filter(F.col("reason").isNull()).select(
        _sequence(fields).alias("seq"),
        F.col("event_ts").alias("ts"),
        F.coalesce(text("container.name"), F.lit("")).alias("container_name"),
        X.field_if_present(whole, "rule", "").alias("rule"),
        X.field(whole, "priority").alias("priority"),
        X.field(whole, "source").alias("source"),
        "category",
        text("evt.type").alias("evt_type"),
        text("proc.name", "unknown").alias("proc_name"),
        text("proc.cmdline").alias("cmdline"),
        F.coalesce(text("fd.type"), F.lit("")).alias("fd_type"),
        F.coalesce(text("fd.name"), F.lit("")).alias("fd_name"),
        F.coalesce(text("fd.directory"), F.lit("")).alias("fd_directory"),
        X.field(whole, "hostname").alias("hostname"),
        F.from_json(X.field(whole, "tags"), "array<string>", _STRICT).alias("tags"),
        "fields",
    )


def ingest_stats(lines: DataFrame) -> DataFrame:
    """Lines seen (blank ones are not counted) and lines that are not JSON."""
    raw = F.col("raw")
    full = ~X.is_blank(raw)
    return lines.agg(
        F.count_if(full).alias("lines_processed"),
        F.count_if(full & ~is_json(raw)).alias("json_errors"),
    )


# ----------------------------------------------------------------- event files

def read_events_file(
    spark: SparkSession, path: str | list[str], whole_files: bool = True
) -> DataFrame:
    """Events of JSON-lines files, bad lines kept aside with their reason.

    A file without a single good line is read again as one JSON document, an array or
    an object. Files that hold several objects over many lines are neither, and end in
    the rejects. ``whole_files=False`` skips that second read.
    """
    lines = read_lines(spark, path)
    parsed = parse_lines(lines)
    if not whole_files:
        return parsed
    valid = F.count_if(~X.is_blank(F.col("raw")) & is_json(F.col("raw")))
    # Names of files, not data: only those without one good line are read again.
    hopeless = [
        row.file for row in lines.groupBy("file").agg(valid.alias("n")).filter("n = 0").collect()
    ]
    if not hopeless:
        return parsed
    documents = spark.read.text(hopeless, wholetext=True).selectExpr(*_FILE_COLUMNS)
    values = F.coalesce(
        F.from_json("raw", "array<string>", _STRICT), F.array(F.col("raw"))
    )
    strict = F.when(is_json(F.col("raw")), values)
    whole = documents.select(F.explode(strict).alias("raw"), "file", "ingest_ts")
    read_whole = whole.select("file").distinct()
    return parsed.join(read_whole, "file", "left_anti").unionByName(parse_lines(whole))
