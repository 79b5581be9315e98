"""Oversized items into pieces under a size limit, cut at natural boundaries, with an overlap.

Each boundary between two units (frames, tokens, ...) has a strength: the length of the pause it lies in, 0 inside talk. A
sparse table over the strengths answers range-maximum queries in constant time; each cut is the strongest boundary of the
permissible lengths, the rightmost of equals, and the next piece starts ``overlap`` units before it.

Defined results: items up to the limit give no pieces; without any boundary the cuts fall at the limit; pauses of any
number, order and overlap are taken; repeated rows give repeated pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kikitori.operators.runs import periods_and_gaps, to_ms


class RangeMax:
    """Sparse table: row k holds the maxima of all stretches of 2**k. Keys carry the position, so the rightmost wins ties."""

    def __init__(self, strengths: np.ndarray):
        keys = (strengths.astype(np.int64) << 32) | np.arange(len(strengths), dtype=np.int64)
        self.rows = [keys]
        width = 1
        while 2 * width <= len(strengths):
            last = self.rows[-1]
            self.rows.append(np.maximum(last[:-width], last[width:]))
            width *= 2

    def strongest(self, lo: int, hi: int) -> tuple[int, int]:
        """(strength, position) of the strongest boundary in lo..hi, both included."""
        k = (hi - lo + 1).bit_length() - 1
        row = self.rows[k]
        best = max(int(row[lo]), int(row[hi - (1 << k) + 1]))
        return best >> 32, best & 0xFFFFFFFF


def boundary_strengths(n: int, units_per_second: float, talk: list[tuple[int, int]]) -> np.ndarray:
    """Strength (ms of pause) of the boundaries 0..n. ``talk``: disjoint sorted stretches of talk in ms."""
    strengths = np.zeros(n + 1, dtype=np.int64)
    end_ms = int(np.ceil(n * 1000 / units_per_second))
    edges = [0, *[x for a, b in talk for x in (a, b)], max(end_ms, talk[-1][1] if talk else 0)]
    for a, b in zip(edges[::2], edges[1::2]):
        if b > a:
            first, last = int(np.ceil(a * units_per_second / 1000 - 1e-9)), int(np.floor(b * units_per_second / 1000 + 1e-9))
            strengths[max(first, 0) : min(last, n) + 1] = min(b - a, 0x7FFFFFFE)
    return strengths


def cut_pieces(n: int, limit: int, overlap: int, strengths: np.ndarray, fill: float = 0.5) -> list[tuple[int, int, bool]]:
    """(start, end, natural) covering 0..n. Lengths from ``fill`` of the limit are searched first, shorter ones if those
    hold no boundary; where no permissible length ends at one, the piece takes the limit."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    table, pieces, start = RangeMax(strengths), [], 0
    while n - start > limit:
        shortest = overlap + 1
        half = max(shortest, int(limit * fill))
        power, at = table.strongest(start + half, start + limit)
        if not power and half > shortest:
            power, at = table.strongest(start + shortest, start + half - 1)
        if not power:
            at = start + limit
        pieces.append((start, at, power > 0))
        start = at - overlap
    pieces.append((start, n, True))
    return pieces


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)


def recording_talk(diarization: DataFrame) -> DataFrame:
    """stem, duration_ms (the longest stated), talk: disjoint stretches of talk of any speaker or none, in any document."""
    segments = diarization.select(file_stem(F.col("audio_file")).alias("stem"), F.explode("segments").alias("s")).select(
        "stem", to_ms(F.col("s.start_s")).alias("a"), to_ms(F.col("s.end_s")).alias("b")
    )
    talk = (
        periods_and_gaps(segments, ["stem"], "a", "b")
        .where("kind = 'period'")
        .groupBy("stem")  # disjoint stretches of one recording: bounded by its length
        .agg(F.array_sort(F.collect_list(F.struct(F.col("start_ms").alias("a"), F.col("end_ms").alias("b")))).alias("talk"))
    )
    length = diarization.groupBy(file_stem(F.col("audio_file")).alias("stem")).agg(F.max(to_ms(F.col("duration"))).alias("duration_ms"))
    return length.join(talk, "stem", "left")


def _piece_batches(limit: int, overlap: int, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, n, talk in zip(*(batch.column(i).to_pylist() for i in range(3))):
                stretches = [(t["a"], t["b"]) for t in talk or []]
                longest = max((b - a for a, b in stretches), default=0)
                for no, (a, b, natural) in enumerate(cut_pieces(n, limit, overlap, boundary_strengths(n, rate, stretches))):
                    rows.append((key, no, a, b, natural, longest))
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["row_id", "piece_no", "start_frame", "end_frame", "natural_cut", "longest_talk_ms"])

    return run


def recording_pieces(manifest: DataFrame, diarization: DataFrame, limit: int, overlap: int, rate: float) -> DataFrame:
    """row_id, piece_no (from 0), start_frame, end_frame, natural_cut, longest_talk_ms for every manifest row that holds a
    whole recording (file stem of a diarized one) of more than ``limit`` frames; a null num_frames is taken from the
    recording's duration. Only the narrow key columns of manifest are shuffled."""
    rows = manifest.select("row_id", "num_frames", file_stem(F.col("latent_path")).alias("stem"))
    frames = F.coalesce(F.col("num_frames").cast("bigint"), F.floor(F.col("duration_ms") * F.lit(rate) / F.lit(1000.0)))
    long_rows = rows.join(recording_talk(diarization), "stem").withColumn("n", frames).where(F.col("n") > limit)
    schema = "row_id bigint, piece_no int, start_frame bigint, end_frame bigint, natural_cut boolean, longest_talk_ms bigint"
    return long_rows.select("row_id", "n", "talk").mapInArrow(_piece_batches(limit, overlap, rate), schema)


def oversized_rows(pieces: DataFrame, limit: int, rate: float) -> DataFrame:
    """row_id, kind: ``oversized``; ``forced`` too where talk goes on longer than the limit without a pause."""
    kinds = F.when(F.col("longest_talk_ms") > F.lit(limit * 1000 / rate), F.array(F.lit("oversized"), F.lit("forced"))).otherwise(F.array(F.lit("oversized")))
    return pieces.where("piece_no = 0").select("row_id", F.explode(kinds).alias("kind"))
