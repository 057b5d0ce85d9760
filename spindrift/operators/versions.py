"""Version strings in order, and the latest entries of a registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPOSITORY = r"github\.com/([^/]+/[^/#?]+?)(?:\.git)?(?:[/#?]|$)"


def version_order(version: Column) -> Column:
    """A value that sorts as versions do: by their numbers from the left, then releases after their pre-releases.

    ``v1.2.0-rc.10+build``: the numbers 1, 2 (zeros at the end do not count), then the parts of the pre-release, numbers among them
    as numbers and before words; what follows a plus does not count. Parts of the version that are no number count as 0.
    Null comes first.
    """
    plain = F.regexp_replace(F.regexp_replace(F.trim(version), r"^[vV]", ""), r"\+.*$", "")
    core, pre = F.regexp_extract(plain, r"^([^-]*)", 1), F.regexp_extract(plain, r"^[^-]*-(.*)$", 1)
    number = lambda x: F.coalesce(x.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    numbers = F.transform(F.split(F.regexp_replace(core, r"(?:\.0+)+$", ""), r"\."), number)
    part = lambda x: F.struct(x.try_cast("decimal(38,0)").isNull().alias("word"), number(x).alias("number"), F.when(x.try_cast("decimal(38,0)").isNull(), x).otherwise("").alias("text"))
    parts = F.transform(F.split(pre, r"\."), part)
    return F.when(version.isNotNull(), F.struct(numbers.alias("numbers"), (pre == "").alias("release"), F.when(pre != "", parts).alias("parts")))


def latest_versions(entries: DataFrame, key: str, version: str) -> DataFrame:
    """Of every key the entry of the greatest version; of equal versions the greatest entry. A grouped maximum: no key is sorted."""
    whole = F.struct(*entries.columns)
    order = F.struct(version_order(F.col(version)).alias("v"), whole.alias("e"))
    return entries.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, order).alias("e")).select("e.*")


def repository(url: Column) -> Column:
    """``owner/name`` of a hosted repository's address, null for any other."""
    found = F.regexp_extract(url, REPOSITORY, 1)
    return F.when(found != "", found)


def registry_servers(entries: DataFrame) -> DataFrame:
    """(server_id, source_repo, name, description, url): one entry for each hosted repository, the first that is latest and active.

    ``entries`` holds position, name, description, source, url, is_latest and status. Entries whose source is not ``github`` or
    whose address is no repository are left out, as are those not marked as latest (null: not) or not ``active``.
    """
    good = entries.where((F.col("source") == "github") & F.coalesce("is_latest", F.lit(False)) & (F.col("status") == "active")).withColumn("source_repo", repository(F.col("url")))
    first = good.where("source_repo is not null").groupBy("source_repo").agg(F.min_by(F.struct("name", "description"), "position").alias("e"))
    text = lambda c: F.coalesce(F.col(f"e.{c}"), F.lit("")).alias(c)
    return first.select(F.replace("source_repo", F.lit("/"), F.lit("-")).alias("server_id"), "source_repo", text("name"), text("description"), F.concat(F.lit("https://github.com/"), "source_repo").alias("url"))
