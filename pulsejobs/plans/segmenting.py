"""Collections of recordings to windows: one call for each kind of collection, from its files or records to the columns that cleaning takes.

Windows come out as (patient, trial, ..., signal, abp_signal), trial being the
recording's name and the number of the window. Equal windows go, the first
by recording and number stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import dedupe, joins, segment
from ..sources import files

CHANNELS = ["signal", "abp_signal"]


def at_rate(df: DataFrame, channels: list[str], old: float, new: float | None) -> DataFrame:
    """Recordings of any length at another rate; None keeps the rate."""
    return df if new is None or new == old else df.withColumns({c: segment.at_rate(c, old, new) for c in channels})


def ordered_columns(df: DataFrame, first: list[str], last: list[str]) -> DataFrame:
    """The named columns first and last, all others between them in their order."""
    return df.select(*first, *[c for c in df.columns if c not in (*first, *last)], *last)


def parts_of_records(records: DataFrame, fs: int, spec: segment.WindowSpec, lag_mode: str = "literal") -> DataFrame:
    """Records in parts (part, i, signal, abp_signal): aligned and cut one window after the other; the patient is the record."""
    name = F.concat_ws("_", "part", F.col("i").cast("string"))
    cut = segment.windows(segment.aligned(records.withColumn("patient", name), fs, lag_mode), spec, CHANNELS, "patient")
    kept = dedupe.drop_duplicate_windows(cut, ["part", "i", "j"])
    return ordered_columns(kept.drop("part", "i", "j", "shift"), ["patient", "trial"], CHANNELS)


def centres_of_records(records: DataFrame, subjects: DataFrame, fs: int, spec: segment.WindowSpec, lag_mode: str = "literal") -> DataFrame:
    """Records (file_name, segment, signal, abp_signal) of known files: aligned, the middle window of each.

    ``subjects`` (file_name, patient, ...) gives patients and what is known of
    them; files that it does not name go, and of several rows for a file the
    first by patient counts.
    """
    known = joins.with_subjects(records, joins.first_match(subjects, "file_name", ["patient"]), "file_name")
    trial = F.concat_ws("_", F.regexp_replace("file_name", r"\.[^.]*$", ""), F.col("segment").cast("string"))
    cut = segment.centre_window(segment.aligned(known.withColumn("trial", trial), fs, lag_mode), spec.size, CHANNELS)
    kept = dedupe.drop_duplicate_windows(cut, ["patient", "trial"])
    return ordered_columns(kept.drop("file_name", "segment", "shift"), ["patient", "trial"], CHANNELS)


def trimmed_records(records: DataFrame, old: int, new: int | None, dropped: int, edge_sec: float, factor: float, lag_mode: str = "literal") -> tuple[DataFrame, int]:
    """Long records made fit for cutting, and their rate: the last ``dropped`` samples go, the rate changes, ``edge_sec`` seconds go at both ends, pressure is scaled by ``factor``, the channels are aligned."""
    fs = new or old
    edge = int(edge_sec * fs)
    rows = records.withColumns({c: segment.trimmed(c, dropped, 0) for c in CHANNELS})
    rows = at_rate(rows, CHANNELS, old, new).withColumns({c: segment.trimmed(c, 0, edge) for c in CHANNELS})
    return segment.aligned(rows.withColumn("abp_signal", segment.scaled("abp_signal", factor)), fs, lag_mode), fs


def long_records(records: DataFrame, old: int, win_sec: float | None = None, win_sam: int | None = None, wait_sec: float = 0.0, new: int | None = None, dropped: int = 1000, edge_sec: float = 3.0, factor: float = 100.0, order: str = "patient", lag_mode: str = "literal") -> DataFrame:
    """Long recordings (patient, subject columns, signal, abp_signal) to windows with a gap: see trimmed_records().

    ``order`` is the column by which recordings come first where windows are equal.
    """
    rows, fs = trimmed_records(records, old, new, dropped, edge_sec, factor, lag_mode)
    cut = segment.windows(rows, segment.WindowSpec.of(fs, win_sec, win_sam, wait_sec), CHANNELS, "patient")
    return ordered_columns(dedupe.drop_duplicate_windows(cut, [order, "j"]).drop("j", "shift"), ["patient", "trial"], CHANNELS)


def read_long_records(spark, folder: str, info: DataFrame, columns: dict[str, str], row: str = "row") -> DataFrame:
    """Recordings in CSV files with their subjects: file number i goes with the row numbered i of ``info``, which names the patient."""
    return files.paired_by_row(files.read_column_csv(spark, folder, columns), info, row).drop("name")


def short_records(recordings: DataFrame, subjects: DataFrame, old: int, new: int | None = None, listed: DataFrame | None = None, file_name: Column | None = None) -> DataFrame:
    """Recordings of a beat or two (patient, trial, signal) with the labels of their subjects (patient, SP, DP, ...), each as one window.

    With ``listed`` (pos, name) only listed recordings stay, with their place
    ``pos``; ``file_name`` says how a listed name is made of a row, by default
    the trial.
    """
    rows = recordings
    if listed is not None:
        named = rows.withColumn("_file", file_name if file_name is not None else F.col("trial"))
        rows = segment.in_listed_order(named, listed, "_file").drop("_file")
    rows = at_rate(joins.with_subjects(rows, subjects), ["signal"], old, new)
    return ordered_columns(rows, ["patient", "trial", "SP", "DP"], ["signal"])
