"""Documents and translation requests as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import fixed
from docloom.operators.routing import file_type_of_name, file_type_of_url


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows to as many tasks as ``spark.docloom.spread`` says; unset, nothing happens.

    A local session sets it: a test file of one row group would else be one task. On a
    cluster inputs have splits enough, and no exchange is added.
    """
    n = df.sparkSession.conf.get("spark.docloom.spread", "")
    return df.repartition(int(n)) if n else df


def accept_uploads(df: DataFrame, extension: str | None = None, filename: str = "filename") -> DataFrame:
    """Add ``file_type``, ``status`` and ``detail``; one extension, or both when None."""
    kind = file_type_of_name(filename)
    ok = kind.isNotNull() if extension is None else F.coalesce(kind == extension, F.lit(False))
    detail = fixed.BAD_FILENAME if extension is None else f"Only .{extension} files are supported"
    return df.select(
        "*", F.when(ok, kind).alias("file_type"), F.when(ok, 200).otherwise(400).alias("status"),
        F.when(~ok, detail).alias("detail"))


def _base64_body(data):
    """Letters to decode and whether they are complete, as a lenient decoder reads them.

    Characters outside the alphabet are skipped. ``=`` counts only after two or three
    letters of a group of four; when it completes the group the rest is ignored.
    """
    clean = F.regexp_replace(data, r"[^A-Za-z0-9+/=]", "")
    pieces = F.regexp_extract_all(clean, F.lit("[^=]++=?|="), F.lit(0))

    zero = F.lit(0)

    def state(group, pads, used, done):
        return F.struct(group.alias("group"), pads.alias("pads"), used.alias("used"), done.alias("done"))

    def step(acc, p):
        padded = F.endswith(p, F.lit("="))
        group = (acc["group"] + F.length(F.replace(p, F.lit("="), F.lit("")))) % 4
        counts = padded & (group >= 2)
        pads = F.when(p == "=", acc["pads"]).otherwise(0) + F.when(counts, 1).otherwise(0)
        return F.when(acc["done"], acc).otherwise(
            state(group, pads, acc["used"] + 1, counts & (group + pads >= 4)))

    # the fold keeps numbers only; the letters are joined once, up to where it stopped
    def body(ps):
        end = F.aggregate(ps, state(zero, zero, zero, F.lit(False)), step)
        return F.transform(F.array(end), lambda e: F.struct(
            F.replace(F.array_join(F.slice(ps, F.lit(1), e["used"]), ""), F.lit("="), F.lit("")).alias("text"),
            (e["done"] | (e["group"] == 0)).alias("whole")))

    return F.get(F.flatten(F.transform(F.array(pieces), body)), F.lit(0))


def decode_base64_requests(df: DataFrame, data: str = "file_data", filename: str = "filename") -> DataFrame:
    """Add ``content`` (BINARY), ``file_type``, ``status`` and ``detail``.

    Bad data is reported before a bad file name. Rows stay in one table, so accepted and
    rejected requests come from a single pass.
    """
    body = df.withColumn("__b", _base64_body(F.col(data)))
    whole = F.col("__b.whole")
    kind = file_type_of_name(filename)
    status = F.when(~whole | kind.isNull(), 400).otherwise(200)
    detail = F.when(~whole, fixed.BAD_BASE64).when(kind.isNull(), fixed.BAD_FILENAME)
    return body.select(
        *df.columns,
        F.when(whole & kind.isNotNull(), F.unbase64("__b.text")).alias("content"),
        kind.alias("file_type"), status.alias("status"), detail.alias("detail"))


def detect_file_type(df: DataFrame, url: str = "url", content_type: str = "content_type") -> DataFrame:
    kind = file_type_of_url(url, content_type)
    return df.select(
        "*", kind.alias("file_type"), F.when(kind.isNull(), 400).otherwise(200).alias("status"),
        F.when(kind.isNull(), fixed.BAD_URL_TYPE).alias("detail"))


def with_defaults(df: DataFrame, language: str = "target_language") -> DataFrame:
    """A request without a language asks for Hindi."""
    return df.withColumn(language, F.coalesce(language, F.lit(fixed.DEFAULT_LANGUAGE)))
