"""The five registries, intermediate tables, feedback, and the unified records.

Missing files of intermediate results give empty tables; missing registries raise. Empty strings and any spelling of
``nan`` count as missing. Repeated rows stay; the order column keeps the reading order explicit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions import normalize as N

_S, _I = T.StringType(), T.LongType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: The fixed input contract, in registry order.
SCHEMAS = {
    "vehicles": _schema(record_id=_S, owner_name=_S, owner_cnic=_S, father_name=_S, dob=_S, engine_cc=_I, reg_value=_I, phone=_S, city=_S),
    "real_estate": _schema(record_id=_S, owner_name=_S, owner_cnic=_S, father_name=_S, dob=_S, property_value=_I, household=_S, area=_S, city=_S),
    "utilities": _schema(account_id=_S, consumer_name=_S, consumer_cnic=_S, father_name=_S, dob=_S, address=_S, avg_monthly_bill=_I, phone=_S, city=_S),
    "travel": _schema(record_id=_S, passenger_name=_S, passport_cnic=_S, father_name=_S, dob=_S, trips_last_year=_I, destinations=_S, city=_S),
    "tax_returns": _schema(return_id=_S, filer_name=_S, filer_cnic=_S, father_name=_S, dob=_S, declared_income=_I, tax_paid=_I, city=_S),
}
#: Unified column -> registry column.
UNIFIED = {
    "vehicles": {"record_id": "record_id", "name": "owner_name", "cnic": "owner_cnic", "phone": "phone"},
    "real_estate": {"record_id": "record_id", "name": "owner_name", "cnic": "owner_cnic", "address": "household"},
    "utilities": {"record_id": "account_id", "name": "consumer_name", "cnic": "consumer_cnic", "address": "address", "phone": "phone"},
    "travel": {"record_id": "record_id", "name": "passenger_name", "cnic": "passport_cnic"},
    "tax_returns": {"record_id": "return_id", "name": "filer_name", "cnic": "filer_cnic"},
}
FEEDBACK = _schema(record_a=_S, record_b=_S, label=_S, note=_S)
LABELS = ("same", "different")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_registry(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One registry with its declared schema, from parquet if there is one, else from CSV."""
    path = f"{folder}/{name}"
    if exists(spark, f"{path}.parquet"):
        return spark.read.schema(SCHEMAS[name]).parquet(f"{path}.parquet")
    return spark.read.schema(SCHEMAS[name]).csv(f"{path}.csv", header=True, encoding="UTF-8")


def read_all(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: read_registry(spark, folder, name) for name in SCHEMAS}


def tolerant_read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S3: an intermediate table, or an empty one where it is absent, has no bytes, or no rows. Files that end in ``.csv``
    are read by their header, with or without a byte order mark, every field as text; columns they lack are null."""
    if not exists(spark, path) or not _bytes(spark, path):
        return spark.createDataFrame([], schema)
    if not path.endswith(".csv"):
        return spark.read.schema(schema).parquet(path)
    found = spark.read.csv(path, header=True, encoding="UTF-8")
    names = {c.removeprefix("\ufeff").strip(): c for c in found.columns}
    return found.select(*[(F.col(f"`{names[f.name]}`") if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def _bytes(spark: SparkSession, path: str) -> int:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def unified(registries: dict[str, DataFrame]) -> DataFrame:
    """One row a record, every field normalised. ``ord``: registry number, then record id."""
    parts = []
    for k, (name, columns) in enumerate(UNIFIED.items()):

        def raw(field: str, columns: dict[str, str] = columns) -> Column:
            return N.clean(F.col(columns[field])) if field in columns else F.lit("")

        parts.append(registries[name].select(F.struct(F.lit(k).alias("registry"), raw("record_id").alias("id")).alias("ord"), raw("record_id").alias("record_id"), F.lit(name).alias("registry"), raw("name").alias("raw_name"), N.clean(F.col("father_name")).alias("father"), raw("address").alias("address"), raw("cnic").alias("cnic_text"), raw("phone").alias("phone_text"), N.clean(F.col("dob")).alias("dob"), N.clean(F.col("city")).alias("city_text")))
    records = parts[0]
    for part in parts[1:]:
        records = records.unionByName(part)
    addressed = N.normalize_address(F.col("address"))
    records = records.withColumns({
        "name_tokens": F.when(N.is_urdu(F.col("raw_name")), F.array().cast("array<string>")).otherwise(N.name_tokens(F.col("raw_name"))),
        "name_skeletons": N.name_skeletons(F.col("raw_name")),
        "norm_name": F.array_join(N.name_tokens(F.col("raw_name")), " "),
        "father_skeletons": N.name_skeletons(F.col("father")),
        "addr": F.when(F.col("address") != "", addressed),
        "cnic": N.normalize_cnic(F.col("cnic_text")),
        "phone": N.normalize_phone(F.col("phone_text")),
    })
    return records.withColumn("city", F.lower("city_text"))


def field_index(registries: dict[str, DataFrame]) -> DataFrame:
    """``record_id, fields``: the non-empty fields of every record as a map of texts."""
    parts = []
    for name, df in registries.items():
        pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in SCHEMAS[name].names]), F.array(*[N.clean(F.col(c)) for c in SCHEMAS[name].names]))
        parts.append(df.select(F.col(UNIFIED[name]["record_id"]).alias("record_id"), F.map_filter(pairs, lambda k, v: v != "").alias("fields")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def load_feedback(spark: SparkSession, path: str) -> DataFrame:
    """``record_a, record_b, label`` with valid labels and ids; an absent log is empty."""
    found = tolerant_read(spark, path, FEEDBACK).select(N.clean(F.col("record_a")).alias("record_a"), N.clean(F.col("record_b")).alias("record_b"), F.lower(F.trim("label")).alias("label"))
    return found.where(F.col("label").isin(*LABELS) & (F.col("record_a") != "") & (F.col("record_b") != ""))


def append_decision(spark: SparkSession, path: str, record_a: str, record_b: str, label: str, note: str = "") -> None:
    """K6: one reviewed pair; any other label raises."""
    if label not in LABELS:
        raise ValueError(f"label must be one of {LABELS}, not {label!r}")
    spark.createDataFrame([(record_a, record_b, label, note)], FEEDBACK).write.mode("append").parquet(path)


def write_table(df: DataFrame, path: str, csv: bool = False) -> None:
    """K1-K3: a stage's output under its own path; no stage overwrites what it reads. CSV files carry a byte order mark."""
    marked = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]) if csv else df
    writer = marked.write.mode("overwrite")
    writer.csv(path, header=True) if csv else writer.parquet(path)
