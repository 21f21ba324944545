"""Declared schemas (DDL) of the tables the library reads and writes."""

from __future__ import annotations

FRAMES = (
    "rec_id STRING, modality STRING, name STRING, stem STRING, idx BIGINT, t_us BIGINT, "
    "height INT, width INT, channels INT, dtype STRING, px ARRAY<FLOAT>"
)
TEMPERATURES = "filename STRING, celsius STRING"
POINTS = (
    "rgb ARRAY<ARRAY<DOUBLE>>, thermal ARRAY<ARRAY<DOUBLE>>, "
    "_frame STRING, _rgb_size ARRAY<INT>, _thermal_size ARRAY<INT>"
)
MANIFEST = (
    "frame STRING, split STRING, width INT, height INT, thermal_dtype STRING, thermal_mean DOUBLE, "
    "thermal_std DOUBLE, thermal_min INT, thermal_max INT, rgb_mean DOUBLE, rgb_sha256 STRING, thermal_sha256 STRING"
)
SPLIT_REPORT = (
    "root STRING, sessions MAP<STRING, STRUCT<split: STRING, pairs: BIGINT>>, val_sessions ARRAY<STRING>, "
    "skipped ARRAY<STRING>, counts STRUCT<train: BIGINT, val: BIGINT>, n_skipped BIGINT, skipped_path STRING"
)
_VIDEO = (
    "STRUCT<codec: STRING, profile: STRING, pix_fmt: STRING, width: INT, height: INT, nominal_fps: STRING, "
    "measured_frames: BIGINT, measured_fps: DOUBLE, pts_start_s: DOUBLE, pts_end_s: DOUBLE, pts_span_s: DOUBLE, "
    "pts_delta_ms: STRUCT<min: DOUBLE, max: DOUBLE, mean: DOUBLE, note: STRING>, bit_rate_bps: BIGINT>"
)
_POSITION = "STRUCT<lat: DOUBLE, lon: DOUBLE, alt_m: DOUBLE>"
_KLV = (
    "STRUCT<standard: STRING, packets: BIGINT, rate_hz: DOUBLE, precision_timestamp_us_first: BIGINT, "
    f"precision_timestamp_us_last: BIGINT, timestamp_span_s: DOUBLE, timestamp_epoch: STRING, sensor_first: {_POSITION}, sensor_last: {_POSITION}>"
)
SYNC = (
    "STRUCT<evidence_shared_clock: STRING, extract_frames_offset_ms: STRUCT<value: DOUBLE, at_end_of_recording: DOUBLE, "
    "drift_ms_over_recording: DOUBLE, definition: STRING, meaning: STRING, status: STRING>>"
)
STREAM = f"STRUCT<file: STRING, role: STRING, container: STRING, bytes: BIGINT, sha256: STRING, video: {_VIDEO}, klv: {_KLV}>"
PACKETS = "stream STRING, seq BIGINT, pts_s DOUBLE, klv_us BIGINT"
REGISTRATION = (
    "mode STRING, H ARRAY<ARRAY<DOUBLE>>, ecc_cc DOUBLE, crop ARRAY<INT>, thermal_size ARRAY<INT>, rgb_size ARRAY<INT>"
)
