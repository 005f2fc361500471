"""Caption files (WebVTT) to timed rows, and hooks for a text encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessiongrid.functions.clock import clock_seconds
from sessiongrid.functions.text import after_last_colon, file_stem
from sessiongrid.operators.ordered import column
from sessiongrid.session import settle

# Fixed value: a cue's time line.
CUE_TIMES = r"([\d:.]+)\s+-->\s+([\d:.]+)"
#: a caption file is read as one value up to this length
MOST_BYTES = 256 << 20


def parse_captions(documents: DataFrame, content: str = "content", keep: Sequence[str] = ("participant",)) -> DataFrame:
    """Whole caption texts to rows ``keep…, seq, start_time, end_time, text``.

    A cue runs from its time line to the next blank line or time line, whichever comes first, so cues without a blank line between
    them and any line ends are read. The speaker before the last colon is cut off.
    """
    plain = F.regexp_replace(column(content), r"\r\n?", "\n")
    cues = documents.select(*map(column, keep), F.posexplode(F.split(plain, r"(?m)(?=^[ \t]*" + CUE_TIMES + ")")).alias("_place", "_cue"))
    said = F.regexp_extract(F.split(F.col("_cue"), r"\n[ \t]*(?:\n|$)")[0], CUE_TIMES + r"[^\n]*\n?([\s\S]*)$", 3)
    return (
        cues.where(F.col("_cue").rlike(CUE_TIMES))
        .select(
            *map(column, keep),
            F.col("_place").alias("seq"),
            clock_seconds(F.regexp_extract("_cue", CUE_TIMES, 1)).alias("start_time"),
            clock_seconds(F.regexp_extract("_cue", CUE_TIMES, 2)).alias("end_time"),
            after_last_colon(F.regexp_replace(said, r"\s+$", "")).alias("text"),
        )
    )


def read_captions(spark: SparkSession, paths: str | Sequence[str], most_bytes: int = MOST_BYTES) -> DataFrame:
    """Cues of caption files, one a participant: the name of its folder ``participant=…``, or else of the file.

    A file is one value, so files above ``most_bytes`` are refused before any is read; only their lengths are looked at.
    """
    lengths = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "length")
    large = lengths.where(F.col("length") > most_bytes).first()
    if large is not None:
        raise ValueError(f"{large['path']} has {large['length']} bytes; cut caption files above {most_bytes} bytes")
    read = spark.read.text(paths, wholetext=True)
    named = column("participant") if "participant" in read.columns else file_stem(F.col("_metadata.file_name"))
    return parse_captions(read.select(named.alias("participant"), F.col("value").alias("content")))


def encode(df: DataFrame, text: str, encoder: Callable[[list[str]], list[list[float]]], name: str = "embedding") -> DataFrame:
    """Add vectors from a user's ``encoder(texts) -> vectors``, called once per Arrow batch."""

    @F.pandas_udf("array<float>")
    def vectors(batch: pd.Series) -> pd.Series:
        return pd.Series(list(encoder(batch.fillna("").tolist())))

    return df.withColumn(name, vectors(column(text)))


def encode_distinct(
    df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[list[float]]]], name: str = "embedding",
    batch: int = 256, tasks: int | None = None,
) -> DataFrame:
    """Add vectors from an encoder that ``load()`` makes once a task and that sees each distinct text once.

    Rows and vectors meet by the text's md5. A null text is encoded as the empty one. ``tasks`` spreads the distinct texts;
    the vectors are written once, so a lost executor costs a lookup and no second encoding. A column called ``name`` is replaced.
    """
    said = F.coalesce(column(text), F.lit(""))
    keyed = df.withColumn("_text_key", F.md5(said))
    texts = keyed.groupBy("_text_key").agg(F.first(said).alias("_text"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load()
        for part in parts:
            for at in range(0, len(part), batch):
                some = part.iloc[at : at + batch]
                yield pd.DataFrame({"_text_key": some["_text_key"].tolist(), "_vector": [list(v) for v in encoder(some["_text"].tolist())]})

    spread = texts if tasks is None else texts.repartition(tasks, "_text_key")
    vectors = settle(spread.mapInPandas(run, "_text_key string, _vector array<float>"))
    kept = [column(c) for c in df.columns if c != name]
    return keyed.join(vectors, "_text_key", "left").select(*kept, F.col("_vector").alias(name))


def rttm_fields(line: Column) -> list[Column]:
    """Speaker, start, end and duration of a diarisation text line."""
    part = F.split(F.trim(line), r"\s+")
    start, duration = F.get(part, 3).try_cast("double"), F.get(part, 4).try_cast("double")
    return [
        F.get(part, 1).alias("file"),
        F.get(part, 7).alias("speaker"),
        start.alias("start"),
        (start + duration).alias("end"),
        duration.alias("duration"),
    ]


def parse_turns(lines: DataFrame, line: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Diarisation lines (``SPEAKER file channel start duration … speaker …``) to turns."""
    return lines.where(column(line).startswith("SPEAKER")).select(*map(column, keep), *rttm_fields(column(line)))


def read_turns(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return parse_turns(spark.read.text(paths))
