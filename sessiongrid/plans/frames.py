"""Raw modality tables to the merged, labelled frame table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessiongrid.catalog import NON_FEATURES, feature_names, matching_names, select_modalities
from sessiongrid.functions.clock import AUDIO_FPS, clock_seconds, clock_to_frame
from sessiongrid.operators.align import frame_means, inner_align, left_align
from sessiongrid.operators.clean import coerce_numeric, fill_nonfinite, reorder
from sessiongrid.operators.intervals import binary_label, boundaries_to_intervals, keep_contained, multiclass_label
from sessiongrid.operators.scaling import prepared
from sessiongrid.operators.windows import frame_deltas

KEY = ("participant", "frame")


def pose_frames(keypoints: DataFrame) -> DataFrame:
    """Deltas of the kept joints, without confidences and raw positions."""
    positions = keypoints.drop(*matching_names(keypoints, "_c$"))
    features = [c for c in positions.columns if c not in KEY]
    deltas = frame_deltas(positions, ["participant"], ["frame"], features)
    return deltas.select(*KEY, *[f"{f}_delta" for f in features])


def audio_frames(rows: DataFrame, turns: DataFrame, fps: float = AUDIO_FPS, fill: str = "zero") -> DataFrame:
    """Descriptor rows blanked outside the participant's turns, then averaged per frame.

    ``rows`` has ``participant, start, end`` (clock texts) and descriptors; ``turns`` has
    ``participant, speaker, start, end`` in seconds.
    """
    values = [c for c in rows.columns if c not in ("participant", "file", "start", "end")]
    timed = coerce_numeric(rows, values).select(
        "participant", clock_seconds(F.col("start")).alias("_start"), clock_seconds(F.col("end")).alias("_end"),
        clock_to_frame(F.col("start"), fps).alias("frame"), *[F.col(f"`{v}`") for v in values],
    )
    spoken = turns.where(F.lower("speaker") == "participant")
    kept = keep_contained(timed, spoken, ["participant"], "_start", "_end", values)
    return frame_means(kept.drop("_start", "_end"), KEY, fill)


def label_frames(frames: DataFrame, error_frames: DataFrame) -> DataFrame:
    """Both labels from an array of error boundaries per participant."""
    intervals = boundaries_to_intervals(error_frames, ["participant"])
    labelled = binary_label(frames, intervals, ["participant"], "frame")
    return multiclass_label(labelled, intervals, ["participant"], "frame")


def merge_modalities(pose: DataFrame, face: DataFrame, audio: DataFrame, gaze: DataFrame | None, error_frames: DataFrame) -> DataFrame:
    """Frames present in pose, face and audio, with gaze where known, labelled, keys first."""
    merged = inner_align([pose, face, audio], KEY)
    if gaze is not None:
        merged = left_align(merged, gaze, KEY)
    return reorder(label_frames(merged, error_frames), NON_FEATURES)


def modality_tables(
    frames: DataFrame, combinations: Sequence[str], flavours: Sequence[str] = ("clean", "norm", "pca")
) -> dict[tuple[str, str], DataFrame]:
    """Each modality combination in each flavour, keys and labels once."""
    tables = {}
    for combination in combinations:
        chosen = fill_nonfinite(select_modalities(frames, combination))
        for flavour in flavours:
            tables[combination, flavour] = prepared(chosen, feature_names(chosen), flavour)
    return tables
