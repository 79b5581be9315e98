"""Sources: data sets by format, manifests, diarization documents, WAV folders, checkpoint listings, cached indexes."""

from __future__ import annotations

import io
import json
import wave
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kikitori.operators.metrics import parse_checkpoint

MANIFEST = "text STRING, latent_path STRING, num_frames INT, caption VARIANT, speaker_id STRING"
DIARIZATION = "audio_file STRING, duration DOUBLE, num_speakers INT, model STRING, segments ARRAY<STRUCT<speaker: STRING, start: DOUBLE, end: DOUBLE, duration: DOUBLE>>"


def parse_data_files(items: Sequence[str] | None) -> Any:
    """Paths as given on a command line: JSON, ``split=path`` pairs (all or none, repeats extend), a comma list, or a list."""
    flat = [x.strip() for x in items or [] if x.strip()]
    if not flat:
        return None
    if len(flat) == 1 and flat[0][0] in "{[":
        return json.loads(flat[0])
    if not any("=" in x for x in flat):
        if len(flat) > 1:
            return flat
        return [p.strip() for p in flat[0].split(",") if p.strip()] if "," in flat[0] else flat[0]
    splits: dict[str, list[str]] = {}
    for item in flat:
        name, _, spec = item.partition("=")
        paths = [p.strip() for p in spec.split(",") if p.strip()]
        if not name.strip() or not paths:
            raise ValueError(f"not split=path: {item}")
        splits.setdefault(name.strip(), []).extend(paths)
    return {k: v[0] if len(v) == 1 else v for k, v in splits.items()}


def parse_speaker_columns(items: Sequence[str] | None) -> list[str]:
    return [c.strip() for item in items or [] for c in str(item).split(",") if c.strip()]


def require_columns(df: DataFrame, *names: str | None) -> DataFrame:
    missing = sorted({n for n in names if n} - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are {', '.join(df.columns)}")
    return df


def scan_dataset(spark: SparkSession, kind: str, files: Any, columns: Sequence[str] = (), schema: str | None = None, **options: str) -> DataFrame:
    """A data set of any format Spark reads; with splits, a column ``split`` names each row's."""
    reader = spark.read.options(**options)
    reader = reader.schema(schema) if schema else reader
    load = lambda paths: reader.format(kind).load(paths)
    if isinstance(files, dict):
        parts = [load(p).withColumn("split", F.lit(name)) for name, p in sorted(files.items())]
        df = parts[0]
        for part in parts[1:]:
            df = df.unionByName(part)
    else:
        df = load(files)
    return require_columns(df, *columns)


def caption_array(caption: Column) -> Column:
    """A caption stored as a string, a list or nothing, as an array."""
    one = F.try_variant_get(caption, "$", "string")
    many = F.try_variant_get(caption, "$", "array<string>")
    return F.when(F.schema_of_variant(caption).startswith("ARRAY"), many).when(one.isNotNull(), F.array(one))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest of JSON lines; blank lines are skipped, malformed lines and lines without text or latent_path fail."""
    lines = spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(path)
    need = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a manifest line lacks {c}"))).otherwise(F.col(c))
    return lines.select(need("text").alias("text"), need("latent_path").alias("latent_path"), "num_frames", caption_array(F.col("caption")).alias("caption"), "speaker_id")


def read_diarization(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """audio_file, pos, speaker, start, end, duration of the segments of JSON documents: one a file, or with ``lines`` one a line."""
    docs = spark.read.schema(DIARIZATION).option("multiLine", not lines).json(path)
    return docs.select("audio_file", F.posexplode("segments").alias("pos", "s")).select("audio_file", "pos", "s.*")


#: as the writers quote; "" is an empty text and nothing at all is null, so the value for null must be no text: a noncharacter
CSV = {"header": True, "multiLine": True, "escape": '"', "lineSep": "\n", "nullValue": "\ufdd0"}


def read_clips(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("file_name STRING, transcription STRING").options(**CSV).csv(path)


def read_piped(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("audio_file STRING, text STRING").options(**CSV, sep="|").csv(path)


def wav_seconds(content: Column) -> Column:
    """Frames by rate of a WAV file; 0.0 for anything that cannot be read."""
    from pyspark.sql.types import DoubleType

    @F.pandas_udf(DoubleType())
    def seconds(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(data: bytes | None) -> float:
            try:
                with wave.open(io.BytesIO(data)) as w:
                    return w.getnframes() / w.getframerate()
            except Exception:
                return 0.0

        for part in parts:
            yield part.map(one, na_action=None)

    return seconds(content)


def scan_wav_folders(spark: SparkSession, folder: str, least_seconds: float = 0.0) -> DataFrame:
    """path, label (name of the folder), seconds of the WAV files in the folders of ``folder``, short ones left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -2).alias("label"), wav_seconds(F.col("content")).alias("seconds")).where(F.col("seconds") >= least_seconds)


def scan_checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """path, kind, step, score of a folder's checkpoints, files or folders; a listing, as empty files count too."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    files = spark.createDataFrame([(f.getPath().toString(),) for f in listed], "path string")
    return files.select("path", *parse_checkpoint(F.element_at(F.split("path", "/"), -1))).where("kind IS NOT NULL")


def chunks(seconds: Column, chunk: float) -> Column:
    """Starts of fixed chunks over a length."""
    return F.when(seconds > 0, F.transform(F.sequence(F.lit(0), (F.ceil(seconds / chunk) - 1).cast("int")), lambda i: i * chunk)).otherwise(F.array().cast("array<double>"))


def cached_index(df: DataFrame, folder: str, stamp: dict[str, Any]) -> DataFrame:
    """``df`` as written before under the same stamp (version, size, time, key), else written anew: to a folder of another
    name first, which is then renamed."""
    import uuid

    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    want = json.dumps(stamp, sort_keys=True)
    if fs.exists(fs_path):
        have = spark.read.text(f"{folder}/_stamp").first() if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_stamp")) else None
        if have and have[0] == want:
            return spark.read.parquet(f"{folder}/rows")
    tmp = f"{folder}.{uuid.uuid4().hex}"
    df.write.parquet(f"{tmp}/rows")
    spark.createDataFrame([(want,)], "value string").coalesce(1).write.text(f"{tmp}/_stamp")
    fs.delete(fs_path, True)
    fs.rename(spark._jvm.org.apache.hadoop.fs.Path(tmp), fs_path)
    return spark.read.parquet(f"{folder}/rows")
