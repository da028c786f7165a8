"""CSV extracts → stage frames.

* declared schema per source, never inferred (S1, S9);
* header row, comma, optional double-quote enclosure (S2);
* every field is read as text; the markers that stand for a missing value
  (``NULL_MARKERS``, or a source's own set) become null in every column, then
  each text is cast to its declared type (S3);
* rows with a value that can't be cast, or with extra or missing fields, go to
  a quarantine frame instead of failing the load, with the column, the value
  and the reason of each rejected cell (S4);
* provenance columns: source system, file name, load time (S5);
* every file's header is checked against the declared layout before reading (Q4):
  unknown or missing required columns fail the load; the optional extension
  columns may be absent and read as null.
"""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructField, StructType

from ..functions.schemas import SOURCE_DDL, conform, struct
from ..session import materialize

CORRUPT = "_corrupt_record"

# Source columns that an extract may omit (they read as null).
OPTIONAL = {
    "products": {"restaurant_id", "category"},
    "orders": {"restaurant_id", "promotion_id", "order_total", "delivery_rating"},
    "delivery": {"Order_ID", "Distance"},
    "restaurants": {"rating"},
}

# What the usual data-frame readers take for a missing value, beside blank text.
NULL_MARKERS = ("#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
                "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# A source's own set, where it differs.
SOURCE_NULLS: dict[str, tuple[str, ...]] = {}

CSV_OPTIONS = {
    "header": "true",
    "sep": ",",
    "quote": '"',
    "escape": '"',
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": CORRUPT,
}


@dataclass
class SourceRead:
    good: DataFrame         # stage layout: source columns + provenance
    quarantine: DataFrame   # columns as far as they are valid, raw_record, rejected cells, source_file, provenance
    seen: Observation | None = None  # with copy=False: ``bad``, the number of rejected rows, known once ``good`` is written


def headers_of(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The headers that occur among the extract's files, with the files of
    each.  A file is opened, its first line read, and closed again; nothing
    else of it is read, whatever its size."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def first_line(file: str) -> str | None:
        p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        stream = p.getFileSystem(conf).open(p)
        try:
            codec = codecs.getCodec(p)
            text = stream if codec is None else codec.createInputStream(stream)
            return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(text, "UTF-8"), 4096).readLine()
        finally:
            stream.close()

    files = sorted(spark.read.text(path).inputFiles())  # listed, not read
    with ThreadPoolExecutor(16) as pool:
        lines = list(pool.map(first_line, files))
    found: dict[tuple[str, ...], list[str]] = {}
    for file, line in zip(files, lines):
        if line is not None:  # an empty file has no rows
            names = next(csv.reader([line.removeprefix("\ufeff")]), [])
            found.setdefault(tuple(n.strip() for n in names), []).append(unquote(file))
    return found


def check_header(name: str, header: list[str]) -> list[str]:
    """Q4: validate the header against the declared source layout and return
    the columns to read, in file order."""
    declared = [f.name for f in struct(SOURCE_DDL[name]).fields]
    unknown = [h for h in header if h not in declared]
    required = [c for c in declared if c not in OPTIONAL.get(name, set())]
    missing = [c for c in required if c not in header]
    if unknown or missing:
        raise ValueError(f"{name}: unexpected file format; unknown columns {unknown}, "
                         f"missing columns {missing}")
    return header


def typed(texts: DataFrame, fields: list[StructField], nulls: tuple[str, ...]) -> DataFrame:
    """Text columns as their declared types: null markers are null, and so are
    values that can't be cast, which are listed in ``rejected``."""
    cells, out = [], []
    for f in fields:
        text = F.when(~F.trim(f.name).isin("", *nulls), F.col(f.name))
        value = text if isinstance(f.dataType, StringType) else text.try_cast(f.dataType)
        if isinstance(f.dataType, (DoubleType, FloatType)):
            value = F.when(~F.isnan(value), value)
        out.append(value.alias(f.name))
        if not isinstance(f.dataType, StringType):
            kind = f.dataType.simpleString()
            cells.append(F.when(text.isNotNull() & value.isNull(), F.struct(
                F.lit(f.name).alias("column"), text.alias("value"), F.lit(f"not a {kind}").alias("reason"))))
    fields_of = F.when(F.col(CORRUPT).isNotNull(), F.struct(
        F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("value"),
        F.lit("wrong number of fields").alias("reason")))
    names = [f.name for f in fields]
    rest = [c for c in texts.columns if c not in {*names, CORRUPT}]
    rejected = F.array_compact(F.array(fields_of, *cells))
    line = F.to_csv(F.struct(*names), {"quote": '"', "escape": '"'})  # the record, as its fields were read
    return texts.select(*out, *rest, rejected.alias("rejected"),
                        F.coalesce(CORRUPT, F.when(F.size(rejected) > 0, line)).alias(CORRUPT))


def read_source(spark: SparkSession, name: str, path: str, source_system: str,
                batch_ts: str, multiline: bool = False, copy: bool = True) -> SourceRead:
    """Read one extract with its declared schema; split good and bad rows.

    Columns are bound by each file's own header, whatever their order.
    ``copy=False``: both are plans over the files, for a caller that writes
    ``good`` whole (every column is parsed) and reads the files a second time
    only if that has seen a bad row.
    """
    full = {f.name: f for f in struct(SOURCE_DDL[name]).fields}
    raw = None
    headers = headers_of(spark, path)
    for header, files in headers.items():
        cols = check_header(name, list(header))
        schema = StructType([StructField(c, StringType()) for c in cols] + [StructField(CORRUPT, StringType())])
        part = (spark.read.schema(schema).options(**CSV_OPTIONS)
                .option("multiLine", str(multiline).lower()).csv(path if len(headers) == 1 else files)
                .withColumn("source_file", F.col("_metadata.file_name")))
        part = typed(part, [full[c] for c in cols], SOURCE_NULLS.get(name, NULL_MARKERS))
        raw = part if raw is None else raw.unionByName(part, allowMissingColumns=True)
    if raw is None:
        raise ValueError(f"{name}: no file with a header under {path}")
    # Spark parses only the columns a query reads, so a bad value in an
    # unread column would pass as good.  Parse every column once and keep
    # the result as a Parquet table (the stage copy of the extract).
    seen = None
    if copy:
        raw = materialize(raw, f"stage-{name}")
    else:
        seen = Observation()
    stamp = {"source_system": F.lit(source_system),
             "load_timestamp": F.lit(batch_ts).cast("timestamp_ntz")}
    checked = raw if copy else raw.observe(seen, F.count_if(F.size("rejected") > 0).alias("bad"))
    good = conform(checked.where(F.size("rejected") == 0).withColumns(stamp),
                   SOURCE_DDL[name] + ", source_system string, source_file string, "
                   "load_timestamp timestamp_ntz")
    bad = (raw.where(F.size("rejected") > 0)
           .withColumnRenamed(CORRUPT, "raw_record").withColumns(stamp))
    return SourceRead(good, bad, seen)


def with_provenance(df: DataFrame, source_system: str, source_file: str,
                    batch_ts: str) -> DataFrame:
    """S5 for frames that did not come from a file read."""
    return df.withColumns({
        "source_system": F.lit(source_system),
        "source_file": F.lit(source_file),
        "load_timestamp": F.lit(batch_ts).cast("timestamp_ntz")})


def second_restaurant_feed(df: DataFrame) -> DataFrame:
    """Map the second restaurant feed onto the main layout."""
    return df.select(
        F.col("res_id").alias("loc_number"), F.col("res_name").alias("loc_name"),
        "cuisines", "address", F.col("city").alias("searched_city"),
        F.col("state").alias("searched_state"), F.col("zipcode").alias("searched_zipcode"),
        "latitude", "longitude", "phone", F.col("aggregate_rating").alias("rating"),
        *[c for c in ("source_system", "source_file", "load_timestamp") if c in df.columns])


def union_restaurant_feeds(main: DataFrame, second: DataFrame) -> DataFrame:
    """Both feeds in the main layout, each row keeping its source tag."""
    return main.unionByName(second_restaurant_feed(second), allowMissingColumns=True)


def write_extract(df: DataFrame, path: str, quoting: str = "minimal") -> None:
    """Write a frame as a CSV extract (header, ``NULL`` markers).
    ``quoting``: "minimal" (only where needed), "all", or "none" (fields are
    written raw, so a comma inside a value becomes an extra field)."""
    w = df.write.mode("overwrite").option("header", "true").option("nullValue", "NULL")
    if quoting == "none":
        w = w.option("quote", "")
    else:
        w = (w.option("quote", '"').option("escape", '"')
              .option("quoteAll", str(quoting == "all").lower()))
    w.csv(path)
