"""Keys, labels and named feature groups of a frame table.

Groups go by name, never by position, so an added column cannot shift them.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sessiongrid.operators.ordered import column

KEYS = ("frame", "participant")
LABELS = ("binary_label", "multiclass_label")
NON_FEATURES = (*KEYS, *LABELS)

# Keypoint names by index in the 25-joint body model, and the joints above the hip.
BODY_JOINTS = (
    "nose", "neck", "rightshoulder", "rightelbow", "rightwrist", "leftshoulder", "leftelbow",
    "leftwrist", "midhip", "righthip", "rightknee", "rightankle", "lefthip", "leftknee",
    "leftankle", "righteye", "lefteye", "rightear", "leftear", "leftbigtoe", "leftsmalltoe",
    "leftheel", "rightbigtoe", "rightsmalltoe", "rightheel",
)
UPPER_JOINTS = (
    "nose", "neck", "rightshoulder", "rightelbow", "rightwrist", "leftshoulder", "leftelbow",
    "leftwrist", "righteye", "lefteye", "rightear", "leftear",
)
# Facial action units with an intensity; presence adds one more.
ACTION_UNITS = ("01", "02", "04", "05", "06", "07", "09", "10", "12", "14", "15", "17", "20", "23", "25", "26", "45")
ACTION_UNITS_PRESENT = (*ACTION_UNITS[:-1], "28", "45")
# Speech descriptors and gaze columns.
AUDIO = (
    "Loudness_sma3", "alphaRatio_sma3", "hammarbergIndex_sma3", "slope0-500_sma3",
    "slope500-1500_sma3", "spectralFlux_sma3", "mfcc1_sma3", "mfcc2_sma3", "mfcc3_sma3",
    "mfcc4_sma3", "F0semitoneFrom27.5Hz_sma3nz", "jitterLocal_sma3nz", "shimmerLocaldB_sma3nz",
    "HNRdBACF_sma3nz", "logRelF0-H1-H2_sma3nz", "logRelF0-H1-A3_sma3nz", "F1frequency_sma3nz",
    "F1bandwidth_sma3nz", "F1amplitudeLogRelF0_sma3nz", "F2frequency_sma3nz",
    "F2bandwidth_sma3nz", "F2amplitudeLogRelF0_sma3nz", "F3frequency_sma3nz",
    "F3bandwidth_sma3nz", "F3amplitudeLogRelF0_sma3nz",
)
GAZE = ("gaze_0_x", "gaze_0_y", "gaze_0_z", "gaze_1_x", "gaze_1_y", "gaze_1_z", "gaze_angle_x", "gaze_angle_y")

POSE = tuple(f"{joint}_{axis}_delta" for joint in UPPER_JOINTS for axis in ("x", "y"))
FACIAL = (
    *[f"AU{unit}_r" for unit in ACTION_UNITS],
    *[f"AU{unit}_c" for unit in ACTION_UNITS_PRESENT],
)
GROUPS: dict[str, tuple[str, ...]] = {"pose": POSE, "facial": FACIAL, "audio": AUDIO, "gaze": GAZE}


def frame_schema(groups: Mapping[str, Sequence[str]] = GROUPS) -> T.StructType:
    """Declared schema of a frame table with the given feature groups."""
    fields = [
        T.StructField("frame", T.IntegerType()),
        T.StructField("participant", T.StringType()),
        T.StructField("binary_label", T.IntegerType()),
        T.StructField("multiclass_label", T.IntegerType()),
    ]
    names = itertools.chain.from_iterable(groups.values())
    return T.StructType(fields + [T.StructField(name, T.DoubleType()) for name in names])


def feature_names(df: DataFrame, non_features: Sequence[str] = NON_FEATURES) -> list[str]:
    return [c for c in df.columns if c not in non_features]


def numeric_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def matching_names(df: DataFrame, pattern: str, exclude: str | None = None) -> list[str]:
    """Columns whose name has the pattern and not the excluded one."""
    found = [c for c in df.columns if re.search(pattern, c)]
    return [c for c in found if exclude is None or not re.search(exclude, c)]


def select_names(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.select(*[column(name) for name in names])


def keep_features(
    df: DataFrame, features: Iterable[str], non_features: Sequence[str] = NON_FEATURES
) -> DataFrame:
    """Keys and labels, then the wanted features in the table's own order."""
    wanted = {f.strip() for f in features}
    return select_names(df, [*non_features, *[c for c in feature_names(df, non_features) if c in wanted]])


def group_columns(df: DataFrame, group: str, groups: Mapping[str, Sequence[str]] = GROUPS) -> list[str]:
    present = set(df.columns)
    return [name for name in groups[group] if name in present]


def parse_modality(text: str, groups: Mapping[str, Sequence[str]] = GROUPS) -> list[str]:
    """``"pose_facial_audio"`` to group names; an unknown name is an error."""
    names = text.split("_")
    unknown = [n for n in names if n not in groups]
    if unknown:
        raise ValueError(f"unknown modality {unknown} in {text!r}; known are {sorted(groups)}")
    return names


def select_modalities(
    df: DataFrame,
    modalities: str | Sequence[str],
    only: Iterable[str] | None = None,
    groups: Mapping[str, Sequence[str]] = GROUPS,
    non_features: Sequence[str] = NON_FEATURES,
) -> DataFrame:
    """Keys, labels and the features of some groups, cut to a feature list if one is given."""
    chosen = parse_modality(modalities, groups) if isinstance(modalities, str) else list(modalities)
    names = [name for group in chosen for name in group_columns(df, group, groups)]
    if only is not None:
        wanted = {f.strip() for f in only}
        names = [name for name in names if name in wanted]
    return select_names(df, [*non_features, *names])


def select_by_flags(
    df: DataFrame, audio: bool, face: bool, pose: bool, only: Iterable[str] | None = None,
    groups: Mapping[str, Sequence[str]] = GROUPS, non_features: Sequence[str] = NON_FEATURES,
) -> DataFrame:
    """The three-flag form: the face flag brings the face and the gaze group."""
    chosen = [("audio",) if audio else (), ("facial", "gaze") if face else (), ("pose",) if pose else ()]
    return select_modalities(df, list(itertools.chain.from_iterable(chosen)), only, groups, non_features)


def modality_of_feature(name: str, groups: Mapping[str, Sequence[str]] = GROUPS) -> str | None:
    bare = name.strip()
    return next((group for group, names in groups.items() if bare in names), None)
