"""Sinks: manifests, documents, clip lists, shards and their merging, names of outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_manifest(df: DataFrame, folder: str) -> None:
    """JSON lines; null optional keys are left out, other scripts are written as they are."""
    df.write.option("ignoreNullFields", True).json(folder)


#: every text comes back as it was: quotes doubled, outer blanks and line ends of any kind kept; null is nothing, empty text is ""
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "lineSep": "\n"}


def write_clips(df: DataFrame, folder: str) -> None:
    df.write.options(**CSV).csv(folder)


def write_piped(df: DataFrame, folder: str, file_name: str, text: str) -> None:
    """``audio_file|text`` for a second trainer."""
    df.select(F.col(file_name).alias("audio_file"), F.col(text).alias("text")).write.options(**CSV).option("sep", "|").csv(folder)


def latent_name(written: Column, idx: Column, rank: Column | None = None, world: int = 1) -> Column:
    name = F.format_string("%08d_%08d.pt", written, idx)
    return F.concat(F.lit("rank"), F.lpad(rank.cast("string"), max(2, len(str(world - 1))), "0"), F.lit("_"), name) if rank is not None and world > 1 else name


def write_shards(df: DataFrame, rank: str, folder: str) -> None:
    df.write.partitionBy(rank).parquet(folder)


def merged_shards(df: DataFrame, rank: str, line_no: str) -> DataFrame:
    """Shards in order of rank, lines in order within; shards that are missing add nothing."""
    return df.orderBy(rank, line_no)


def copy_plan(df: DataFrame, path: str, cluster: str, folder: str) -> DataFrame:
    """src, dest of the files to copy; copying is left to the caller."""
    dest = F.concat_ws("/", F.lit(folder), F.concat(F.lit("cluster_"), F.lpad(F.col(cluster).cast("string"), 2, "0")), F.element_at(F.split(path, "/"), -1))
    return df.select(F.col(path).alias("src"), dest.alias("dest"))


def candidate_names(stem: str, suffix: str, count: int) -> list[str]:
    return [f"{stem}{suffix}"] if count == 1 else [f"{stem}_{i:03d}{suffix}" for i in range(1, count + 1)]
