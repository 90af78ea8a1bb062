"""Which pictures are clean, which may be indexed, and why others may not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sample_flags
from ..functions.values import truthy

WIDTH, HEIGHT = 200, 280


def _flag(c: str) -> Column:
    return F.coalesce(F.col(c).cast("boolean"), F.lit(False))


def _large(width: int, height: int) -> Column:
    return F.coalesce((F.col("width") >= width) & (F.col("height") >= height), F.lit(False))


def clean(width: int = WIDTH, height: int = HEIGHT, watermarked: bool = False, sample: bool = False, valid_given: bool = True) -> Column:
    """Valid, unmarked, stored, hashed and large enough. A null validity is no pass where the column is given."""
    valid = _flag("is_valid_image") if valid_given else F.lit(True)
    return valid & (F.lit(sample) | ~_flag("is_sample")) & (F.lit(watermarked) | ~_flag("is_watermarked")) & truthy("local_image_path") & truthy("image_sha256") & _large(width, height)


def index_eligible(width: int = WIDTH, height: int = HEIGHT) -> Column:
    """As clean, but only an explicit false of the validity rejects."""
    invalid = F.col("is_valid_image").cast("boolean").eqNullSafe(F.lit(False))
    return truthy("local_image_path") & truthy("image_sha256") & ~_flag("is_sample") & ~_flag("is_watermarked") & ~invalid & _large(width, height)


def exclusion_reason(watermarked: bool = False, sample: bool = False) -> Column:
    """First reason that keeps a row out of an index, null if none."""
    return F.when(~truthy("local_image_path"), "missing_local_image_path").when(F.lit(not sample) & _flag("is_sample"), "sample").when(F.lit(not watermarked) & _flag("is_watermarked"), "watermarked")


def split_eligible(df: DataFrame, watermarked: bool = False, sample: bool = False) -> tuple[DataFrame, DataFrame]:
    """(eligible rows, counts by reason)."""
    reasoned = df.withColumn("reason", exclusion_reason(watermarked, sample))
    return reasoned.where("reason is null").drop("reason"), reasoned.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def too_small(width: int = WIDTH, height: int = HEIGHT) -> Column:
    return ~_flag("is_valid_image") | ~_large(width, height)


def duplicate_files(df: DataFrame, digest: str = "image_sha256", path: str = "path") -> DataFrame:
    """(digest, paths) of pictures that are stored more than once."""
    return df.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.sort_array(F.collect_list(path)).alias("paths")).where(F.size("paths") > 1)


def flag_urls(df: DataFrame, url: str = "image_url") -> DataFrame:
    return df.withColumn("_f", sample_flags(url)).select(*[c for c in df.columns if c not in ("is_sample", "is_watermarked", "reasons")], "_f.*")


def flagged_urls(df: DataFrame, url: str = "image_url") -> DataFrame:
    return flag_urls(df, url).where("is_sample or is_watermarked")
