"""Landed replies, feeds, notifications and interfaces as DataFrames.

A landed line of JSON that can't be read never becomes a row. It is one reject, with its
file and text: `unreadable_lines` finds those of a folder, and a stream of notifications
carries them along. Files of other formats have no such lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources import schemas

CORRUPT = "_corrupt_line"
LANDED = {
    "transactions": schemas.TRANSACTIONS,
    "signatures": schemas.SIGNATURES,
    "account_infos": schemas.ACCOUNT_INFOS,
}


def _read(spark: SparkSession, path: str, schema: str, fmt: str) -> DataFrame:
    if fmt != "json":
        return spark.read.schema(schema).format(fmt).load(path)
    lines = _lines(spark, path, schema)
    return lines.where(F.col(CORRUPT).isNull() & _reads(lines.columns[0])).drop(CORRUPT)


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    reader = spark.read.schema(f"{schema}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT)
    return reader.json(path)


def _reads(column: str) -> Column:
    """Always true, but reads a column: Spark refuses plans that read nothing but corrupt lines."""
    return F.length(F.coalesce(F.col(column).cast("string"), F.lit(""))) >= 0


def corrupt_detail() -> Column:
    """Where a line that can't be read stands, and what it says."""
    return F.to_json(F.struct(F.col("_metadata.file_path").alias("file"), F.col(CORRUPT).alias("text")))


def unreadable_lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rejects (slot, tx_signature, reason, detail) of the lines of landed JSON that can't be read.

    `kind` is transactions, signatures or account_infos. Slot and signature are what the
    line still tells, else null.
    """
    if kind not in LANDED:
        raise ValueError(f"kind must be one of {', '.join(LANDED)}")
    lines = _lines(spark, path, LANDED[kind])
    told = {f.name for f in lines.schema}
    signature = "signature" if "signature" in told else "tx_signature"
    slot = F.col("slot") if "slot" in told else F.lit(None).cast("bigint")
    return lines.where(F.col(CORRUPT).isNotNull() & _reads(signature)).select(
        slot.alias("slot"), F.col(signature).alias("tx_signature"),
        F.lit(f"unreadable_{kind}").alias("reason"), corrupt_detail().alias("detail"),
    )


def read_transactions(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Transaction replies by signature. A reply of null has no slot and is left out."""
    return _read(spark, path, schemas.TRANSACTIONS, fmt).where("transaction IS NOT NULL")


def read_signatures(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """The signature feed of a program; feed_pos counts from the newest entry."""
    return _read(spark, path, schemas.SIGNATURES, fmt)


def read_account_infos(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Account replies, one row per transaction; `account_states` lines them up."""
    return _read(spark, path, schemas.ACCOUNT_INFOS, fmt)


def stream_notifications(
    spark: SparkSession, path: str, fmt: str = "json", max_files_per_trigger: int | None = None
) -> DataFrame:
    """Live log notifications as they land in a directory.

    Of a line of JSON that can't be read nothing but `corrupt` is there: its file and text.
    """
    schema = f"{schemas.NOTIFICATIONS}, {CORRUPT} string" if fmt == "json" else schemas.NOTIFICATIONS
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt != "json":
        return reader.load(path)
    bad = F.col(CORRUPT).isNotNull()
    told = [F.when(~bad, F.col(c)).alias(c) for c in ("context", "value", "received_at")]
    rows = reader.option("columnNameOfCorruptRecord", CORRUPT).load(path)
    return rows.select(*told, F.when(bad, corrupt_detail()).alias("corrupt"))


def read_idl(spark: SparkSession, path: str) -> DataFrame:
    """Interface documents of a file or directory, one row each: (idl, idl_error).

    A missing path fails while the plan is built; a document that is no JSON, or
    that names no program address, is kept with the reason.
    """
    text = spark.read.text(path, wholetext=True).withColumnRenamed("value", "idl")
    return text.withColumn("idl_error", idl_error(F.col("idl")))


def idl_error(text):
    parsed = F.try_parse_json(text)
    address = F.try_variant_get(parsed, "$.address", "string")
    return (
        F.when(parsed.isNull(), F.lit("Failed to parse IDL JSON"))
        .when(address.isNull(), F.lit("IDL has no program address"))
    )
