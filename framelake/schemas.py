"""Fixed table schemas; readers never infer."""

from __future__ import annotations

CLIPS = ("clip_id BIGINT, width INT, height INT, rotation INT, duration_s DOUBLE, fps DOUBLE, min_fps DOUBLE, "
         "max_fps DOUBLE, variable_frame_rate BOOLEAN, codec STRING, has_audio BOOLEAN, audio_decodable BOOLEAN, "
         "audio_codec STRING, hdr BOOLEAN, color_space STRING, size_bytes BIGINT")
FRAMES = ("clip_id BIGINT, frame_no BIGINT, pts_us BIGINT, dur_us BIGINT, value DOUBLE, pw INT, ph INT, "
          "luma ARRAY<INT>")
AUDIO_BLOCKS = "clip_id BIGINT, block_no BIGINT, ts_us BIGINT, rate INT, channels INT, samples ARRAY<DOUBLE>"
BOXES = ("clip_id BIGINT, frame_no BIGINT, box_no BIGINT, x DOUBLE, y DOUBLE, width DOUBLE, height DOUBLE, "
         "score DOUBLE, landmarks ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>")
METRICS = ("clip_id BIGINT, sample_no INT, exposure DOUBLE, contrast DOUBLE, noise DOUBLE, detail DOUBLE, "
           "blocking DOUBLE, banding DOUBLE, clipped_shadows DOUBLE, clipped_highlights DOUBLE, saturation DOUBLE")
SAMPLES_RGB = "sample_id BIGINT, r INT, g INT, b INT"
SESSIONS = ("session_id BIGINT, owner BIGINT, status STRING, frames_written BIGINT, bytes_written BIGINT, "
            "file_bytes BIGINT, updated_at_us BIGINT")
STAGE_CACHE = ("name STRING, owner BIGINT, bytes BIGINT, created_at_us BIGINT, last_access_us BIGINT, "
               "pinned BOOLEAN")
STAGE_EVENTS = "session_id BIGINT, seq BIGINT, action STRING, stage_id STRING"
STAGE_NODES = "node_key STRING, parent_key STRING, stage_id STRING, bytes BIGINT"
ARTIFACTS = "artifact_id BIGINT, registered_size BIGINT, pinned_size BIGINT, expected_sha256 STRING"
TELEMETRY = ("device_id BIGINT, ts TIMESTAMP, frame_no BIGINT, status INT, heap_ratio DOUBLE, codec_queue INT, "
             "write_backlog INT")
TEST_RESULTS = "run_id BIGINT, test STRING, status STRING, ok BOOLEAN"

TABLES = {
    "clips": CLIPS, "frames": FRAMES, "audio_blocks": AUDIO_BLOCKS, "boxes": BOXES, "metrics": METRICS,
    "samples_rgb": SAMPLES_RGB, "sessions": SESSIONS, "stage_cache": STAGE_CACHE, "stage_events": STAGE_EVENTS,
    "stage_nodes": STAGE_NODES, "artifacts": ARTIFACTS, "telemetry": TELEMETRY, "test_results": TEST_RESULTS,
}
