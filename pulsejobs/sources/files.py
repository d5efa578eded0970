"""Waveform files to tables, and tables to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators.metrics import summary_with_folds


def _stem(name: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", "")


def _whole(spark: SparkSession, glob: str) -> DataFrame:
    """One row a file, so that the order of its lines is kept: name (without folder and ending) and value."""
    return spark.read.text(glob, wholetext=True).select(_stem(F.col("_metadata.file_path")).alias("name"), "value")


def read_column_csv(spark: SparkSession, glob: str, columns: dict[str, str]) -> DataFrame:
    """CSV files with a header, one column a channel, one line a sample: (name, id, one array for each of ``columns``).

    ``columns`` maps header names to channel names. id is the number in the file
    name. A cell that is no number is null, the word nan stays NaN.
    """
    rows = _whole(spark, glob).withColumn("_lines", F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != ""))
    rows = rows.withColumns({"_head": F.transform(F.split(F.get("_lines", F.lit(0)), ","), lambda x: F.trim(x)), "_cells": F.transform(F.slice("_lines", F.lit(2), F.greatest(F.size("_lines") - 1, F.lit(0))), lambda x: F.split(x, ","))})

    def channel(name: str) -> Column:
        at = (F.array_position("_head", F.lit(name)) - 1).cast("int")
        return A.let(at, lambda i: F.transform("_cells", lambda c: F.get(c, i).try_cast("double")))

    out = {new: channel(old) for old, new in columns.items()}
    return rows.select("name", F.regexp_extract("name", r"(\d+)", 1).try_cast("int").alias("id"), *[v.alias(k) for k, v in out.items()])


def read_tab_lines(spark: SparkSession, glob: str) -> DataFrame:
    """Files of one line of tab-separated samples that ends in a tab: (patient, trial, signal); trial is the file name, patient its first token."""
    cells = F.split(F.regexp_replace("value", r"[\r\n]+$", ""), "\t")
    signal = F.transform(F.slice(cells, F.lit(1), F.greatest(F.size(cells) - 1, F.lit(0))), lambda x: x.try_cast("double"))
    return _whole(spark, glob).select(F.split_part("name", F.lit("_"), F.lit(1)).try_cast("int").alias("patient"), F.col("name").alias("trial"), signal.alias("signal"))


def placed_pieces(spark: SparkSession, glob: str, separator: str | None = None, blank: bool = True) -> DataFrame:
    """The lines of files of any length, or what a separator parts: (file, size, piece, pieces, bytes, value), piece counted in its file from 0.

    A long file is read in splits, as Spark cuts it. Pieces are ranked inside
    their split, after the counted pieces of the file's earlier splits, so no
    task has more than a split. ``bytes`` is what all pieces of the file take,
    each with a separator. Without ``blank``, blank lines do not count.
    """
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    rows = reader.text(glob).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id"), "value"
    )
    if not blank:
        rows = rows.where(F.trim("value") != "")
    counts = rows.groupBy("file", "_split").agg(F.count("*").alias("_n"), F.sum(F.octet_length("value") + 1).alias("_bytes"))
    in_file = Window.partitionBy("file")
    counts = counts.select(
        F.col("file").alias("_file"), F.col("_split").alias("_at"), (F.sum("_n").over(in_file.orderBy("_split")) - F.col("_n")).alias("_before"), F.sum("_n").over(in_file).alias("pieces"), F.sum("_bytes").over(in_file).alias("bytes")
    )
    rank = F.row_number().over(Window.partitionBy("file", "_split").orderBy("_id")) - 1
    ranked = rows.withColumn("_rank", rank).join(counts, (F.col("file") == F.col("_file")) & (F.col("_split") == F.col("_at")))
    return ranked.select("file", "size", (F.col("_before") + F.col("_rank")).alias("piece"), "pieces", "bytes", "value")


def column_csv_samples(spark: SparkSession, glob: str, columns: dict[str, str]) -> DataFrame:
    """read_column_csv() for files of any length: rows (name, id, channel, idx, x, len), one for a sample of a channel.

    ``segment.windows_of_samples(..., record="name")`` makes windows of them.
    """
    lines = placed_pieces(spark, glob, blank=False)
    first = spark.read.text(glob).select(F.col("_metadata.file_path").alias("_of"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id"), "value")
    heads = first.where(F.trim("value") != "").groupBy("_of").agg(F.min_by("value", F.struct("_split", "_id")).alias("_head"))
    heads = heads.withColumn("_head", F.transform(F.split("_head", ","), lambda x: F.trim(x)))
    rows = lines.where("piece > 0").join(heads, F.col("file") == F.col("_of")).withColumn("_cells", F.split(F.regexp_replace("value", r"\r$", ""), ","))
    cell = lambda name: F.get("_cells", (F.array_position("_head", F.lit(name)) - 1).cast("int")).try_cast("double")
    channels = F.explode(F.array(*[F.struct(F.lit(new).alias("channel"), cell(old).alias("x")) for old, new in columns.items()])).alias("c")
    name = _stem(F.col("file"))
    out = rows.select(name.alias("name"), (F.col("piece") - 1).alias("idx"), (F.col("pieces") - 1).alias("len"), channels)
    return out.select("name", F.regexp_extract("name", r"(\d+)", 1).try_cast("int").alias("id"), "c.channel", "idx", "c.x", "len")


def tab_line_samples(spark: SparkSession, glob: str) -> DataFrame:
    """read_tab_lines() for lines of any length: rows (patient, trial, channel, idx, x, len); the channel is signal.

    The one line of a file is read in splits at its tabs. What follows the last tab is no sample.
    """
    cells = placed_pieces(spark, glob, separator="\t")
    n = F.when(F.col("bytes") == F.col("size"), F.col("pieces")).otherwise(F.col("pieces") - 1)
    rows = cells.select(_stem(F.col("file")).alias("trial"), F.lit("signal").alias("channel"), F.col("piece").alias("idx"), F.col("value").try_cast("double").alias("x"), n.alias("len")).where("idx < len")
    return rows.select(F.split_part("trial", F.lit("_"), F.lit(1)).try_cast("int").alias("patient"), "trial", "channel", "idx", "x", "len")


def read_listed_names(spark: SparkSession, path: str) -> DataFrame:
    """(pos, name) of a file of one line of names with commas between them, read in splits at the commas."""
    return placed_pieces(spark, path, separator=",").select(F.col("piece").alias("pos"), F.trim(F.regexp_replace("value", r"[\r\n]+$", "")).alias("name"))


def read_demographics(spark: SparkSession, path: str, names: dict[str, str], title_rows: int = 0, dropped: tuple[str, ...] = ()) -> DataFrame:
    """A small CSV of subjects; title rows above the header are skipped, columns dropped and renamed."""
    if not title_rows:
        df = spark.read.csv(path, header=True, inferSchema=True)
    else:
        lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("i", "value")).where(f"i >= {title_rows} AND trim(value) <> ''").orderBy("i")
        df = spark.read.csv(lines.rdd.map(lambda r: r.value), header=True, inferSchema=True)
    return df.drop(*dropped).withColumnsRenamed(names)


def paired_by_row(files: DataFrame, info: DataFrame, row: str = "row") -> DataFrame:
    """Row i of the subject table with file i."""
    return files.join(info, files["id"] == info[row]).drop(row)


def read_folds(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """CSV files name_{fold}.csv under one schema; numbers are read back exactly."""
    rows = spark.read.schema(schema).csv(glob, header=True)
    return rows.withColumn("fold", F.regexp_extract(F.col("_metadata.file_name"), r"_(\d+)\.csv", 1).cast("int"))


def read_waveforms(spark: SparkSession, path: str) -> DataFrame:
    """The canonical Parquet table of records: record, patient, part, fs, signal, abp_signal."""
    return spark.read.schema("record string, patient string, part string, fs int, signal array<double>, abp_signal array<double>").parquet(path)


def write_windows(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_folds(df: DataFrame, path: str, salts: int = 8) -> None:
    """One folder a fold; each fold is dealt over ``salts`` tasks, so a large fold is not one task's file."""
    dealt = df.repartition("fold", F.pmod(F.xxhash64(*[c for c in df.columns if c != "fold"]), F.lit(salts)))
    dealt.write.mode("overwrite").partitionBy("fold").parquet(path)


def export_folds_csv(df: DataFrame, path: str, digits: int = 20) -> None:
    """Features as CSV by fold with ``digits`` decimals and a header."""
    text = {f.name: F.format_string(f"%.{digits}f", f.name) for f in df.schema if f.dataType.typeName() == "double"}
    df.withColumns(text).write.mode("overwrite").partitionBy("fold").csv(path, header=True)


def write_predictions(predictions: DataFrame, path: str) -> DataFrame:
    """Stores a long prediction table by mode under ``path``/rows and its errors, by fold and pooled, under ``path``/errors; returns the errors."""
    predictions.write.mode("overwrite").partitionBy("mode").parquet(f"{path}/rows")
    stored = predictions.sparkSession.read.parquet(f"{path}/rows")
    errors = summary_with_folds(stored).unionByName(summary_with_folds(stored.withColumns({"mode": F.concat(F.lit("naive "), "mode"), "pred": F.col("naive")})))
    errors.write.mode("overwrite").parquet(f"{path}/errors")
    return predictions.sparkSession.read.parquet(f"{path}/errors")


def round_trip_differences(df: DataFrame, path: str) -> DataFrame:
    """Rows of the table or of its stored form that the other lacks: none, if the export is right."""
    back = df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
    return df.exceptAll(back).withColumn("side", F.lit("table")).union(back.exceptAll(df).withColumn("side", F.lit("stored")))


def append_audit(audit: DataFrame, path: str) -> None:
    audit.write.mode("append").parquet(path)


def trailing_free(c: str | Column) -> Column:
    """Text without white space at its end."""
    return F.regexp_replace(A.col(c), r"\s+$", "")


def nan_text(c: str | Column) -> Column:
    """Numbers of a text column; the word nan is a missing value."""
    return F.when(F.lower(F.trim(A.col(c))) != "nan", A.col(c).try_cast("double"))
