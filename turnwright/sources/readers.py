"""Readers with fixed schemas, and the registry that picks one by kind of folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwright.operators.cleaning import VOCABULARY, apply_vocabulary
from turnwright.operators.metrics import union_results
from turnwright.sources.paths import files_below

WORD = "struct<word: string, start: double, end: double, speaker: string>"
MIXED = f"segments array<struct<start: double, end: double, text: string, words: array<{WORD}>>>"
UTTERANCES = "CallID string, Speaker string, StartTime double, EndTime double, Transcript string"
TURNS = UTTERANCES + ", AgentPrompt string, IQMedian int"


def read_log(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """An interaction log: semicolons, latin-1, header; values of the vocabulary are null. Without a schema all columns are text."""
    r = spark.read.option("sep", ";").option("encoding", "ISO-8859-1").option("header", True)
    return apply_vocabulary((r.schema(schema) if schema else r).csv(path), VOCABULARY)


def read_table(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)


# The numbers among the columns of results; all others are text.
RESULT_NUMBERS = ("hidden_size", "num_layers", "learning_rate", "epochs", "batch_size", "n_comp_systemf", "n_comp_speechf_text", "n_comp_speechf_wav", "macro_recall", "macro_f1")


def read_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV results, files or folders of any depth, one under the other by name; a column that a file lacks is null in its rows.

    Files are read by their own headers, those with equal headers together. Columns of RESULT_NUMBERS are doubles, null where a text is no number.
    """
    files = sorted({f for p in paths for f in files_below(spark, p, ".csv")})
    by_header: dict[tuple[str, ...], list[str]] = {}
    for f in files:
        by_header.setdefault(tuple(spark.read.option("header", True).csv(f).columns), []).append(f)
    if not by_header:
        raise ValueError(f"no results in {paths}")
    number = lambda f: f.withColumns({c: F.col(c).try_cast("double") for c in RESULT_NUMBERS if c in f.columns})
    return union_results([number(spark.read.option("header", True).option("enforceSchema", False).schema(T.StructType([T.StructField(c, T.StringType()) for c in h])).csv(fs)) for h, fs in by_header.items()])


def read_mixed(spark: SparkSession, path: str) -> DataFrame:
    """Segments of mixed transcripts (CallID from the file name, place, start, end, text, words); unreadable files have none."""
    d = spark.read.option("multiLine", True).option("recursiveFileLookup", True).schema(MIXED).json(path).select(file_code(F.input_file_name()).alias("CallID"), F.posexplode("segments").alias("place", "s"))
    return d.select("CallID", "place", "s.*")


def file_code(path: Column) -> Column:
    """The last eleven digits of the file name."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), "[^0-9]", "")
    return F.when(F.length(name) > 0, F.right(name, F.lit(11)))


def parse_rttm(lines: DataFrame, line: str = "value") -> DataFrame:
    """(filecode, start, end) of the SPEAKER lines with at least five fields."""
    f = F.split(F.trim(line), r"\s+")
    d = lines.select(f.alias("f")).where((F.size("f") >= 5) & (F.get("f", F.lit(0)) == "SPEAKER"))
    start = F.get("f", F.lit(3)).try_cast("double")
    return d.select(F.get("f", F.lit(1)).alias("filecode"), start.alias("start"), (start + F.get("f", F.lit(4)).try_cast("double")).alias("end"))


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    return parse_rttm(spark.read.option("recursiveFileLookup", True).text(path))


def audio_pairs(paths: DataFrame, path: str) -> DataFrame:
    """(filecode, dyad, user): the recordings of each call; a name with 'output' is of both sides. The greatest path wins."""
    name = F.element_at(F.split(path, "/"), -1)
    d = paths.where(F.col(path).isNotNull()).select(file_code(F.col(path)).alias("filecode"), F.when(name.contains("output"), "dyad").otherwise("user").alias("role"), F.col(path).alias("p"))
    return d.where("filecode is not null").groupBy("filecode").pivot("role", ["dyad", "user"]).agg(F.max("p"))


def dyad_audio(paths: DataFrame, path: str) -> DataFrame:
    """(filecode, path) of the recordings of both sides: names that begin with LetsGoPublic and end with output.wav. The greatest path wins."""
    name = F.element_at(F.split(path, "/"), -1)
    d = paths.where(name.startswith("LetsGoPublic") & name.endswith("output.wav")).select(file_code(F.col(path)).alias("filecode"), F.col(path).alias("path"))
    return d.where("filecode is not null").groupBy("filecode").agg(F.max("path").alias("path"))


def audio_validity(listed: DataFrame, path: str, found: DataFrame) -> DataFrame:
    """listed plus reason: why the file at path can't be used, null if it can. found: read_audio() of the folders. As Spark lists no files without
    a byte, those count as not found."""
    f = found.select(F.col("path").alias("_path"), "size", "frames").dropDuplicates(["_path"])
    d = listed.join(f, F.col(path) == F.col("_path"), "left")
    return d.withColumn("reason", audio_reason(F.col("_path").isNotNull(), F.col("size"), F.col("frames"))).drop("_path", "size", "frames")


def audio_reason(exists: Column, size: Column, frames: Column) -> Column:
    """Why a recording can't be used, else null."""
    return F.when(~F.coalesce(exists, F.lit(False)), "file not found").when(F.coalesce(size, F.lit(0)) == 0, "empty file").when(frames.isNull(), "unreadable").when(frames == 0, "no frames")


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """(path, filecode, size, frames, reason) of the WAV files below a folder; the header gives the frames, the samples are not decoded.

    Spark doesn't list files without a byte: join the inventory to the result, a call without a row has no usable recording.
    """
    d = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(path)
    number = lambda at, n: sum((F.conv(F.hex(F.substring("content", at + i, 1)), 16, 10).cast("bigint") * (1 << (8 * i)) for i in range(n)), F.lit(0).cast("bigint"))
    is_wav = (F.col("length") >= 44) & (F.hex(F.substring("content", 1, 4)) == "52494646")
    frames = F.when(is_wav, F.try_divide(number(41, 4), number(33, 2)).cast("bigint"))
    d = d.select("path", file_code(F.col("path")).alias("filecode"), F.col("length").alias("size"), frames.alias("frames"))
    return d.withColumn("reason", audio_reason(F.lit(True), F.col("size"), F.col("frames")))


def read_config(spark: SparkSession, path: str, n: int) -> list[str]:
    """The fields of the nth line (from 1) of a space-separated file."""
    lines = spark.read.text(path, wholetext=True).first()
    rows = lines[0].split("\n") if lines else []
    if not 1 <= n <= len(rows):
        raise IndexError(f"{path} has no line {n}")
    return rows[n - 1].split()


READERS = {"vad": read_rttm, "audio": read_audio, "transcripts": read_mixed, "cv_results": lambda spark, path: read_results(spark, [path])}


def read_kind(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """The reader registered for a kind of folder."""
    if kind not in READERS:
        raise ValueError(f"unknown kind {kind}: one of {sorted(READERS)}")
    return READERS[kind](spark, path)
