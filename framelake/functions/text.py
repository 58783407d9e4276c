"""Keys, names and readable numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.functions.mathx import dbl, js_round

MIB = 1024 * 1024
#: Version of the lists that keys are hashes of.
FORM = 1


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_text(c) -> Column:
    """A string as a JSON string; null as JSON null."""
    quoted = F.to_json(F.array(_col(c)))
    return F.when(_col(c).isNull(), "null").otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def stable_json(settings) -> Column:
    """A MAP<STRING, STRING> as JSON text with sorted keys, so equal maps give equal text.

    Values are kept as strings: numbers must come in one fixed format.
    """
    m = _col(settings)
    pairs = F.transform(F.array_sort(F.map_keys(m)),
                        lambda k: F.concat(json_text(k), F.lit(":"), json_text(F.element_at(m, k))))
    return F.when(m.isNull(), "null").otherwise(F.concat(F.lit("{"), F.concat_ws(",", pairs), F.lit("}")))


def _fingerprint(kind: str, *parts: Column) -> Column:
    """SHA-256 over a JSON list: what is named, the version of its form, and the parts in order."""
    return F.sha2(F.concat(F.lit(f'["{kind}",{FORM}'), *[F.concat(F.lit(","), p) for p in parts], F.lit("]")), 256)


def node_key(parent_key, stage_id, settings, model_sha256=None, metadata=None) -> Column:
    """Name of a result: parent, stage, model, settings and metadata decide it."""
    return _fingerprint("node", json_text(parent_key), json_text(stage_id),
                        json_text(model_sha256) if model_sha256 is not None else F.lit("null"), stable_json(settings),
                        stable_json(metadata) if metadata is not None else F.lit("null"))


def source_key(content, name, modified, media_type) -> Column:
    """Name of a source: the hash of its whole content, with size, name, type and time."""
    data = _col(content)
    return _fingerprint("source", json_text(F.sha2(data, 256)), F.octet_length(data).cast("string"), json_text(name),
                        json_text(media_type), F.coalesce(_col(modified).cast("string"), F.lit("null")))


def sanitize_name(c) -> Column:
    """File-safe text: each run of anything but letters, digits, dot, dash and underscore becomes one underscore."""
    return F.regexp_replace(_col(c), r"[^\p{L}\p{N}._-]+", "_")


def stage_file_name(stage_id, source_name) -> Column:
    """``stem_stage.mp4`` from a source name without its last extension; without a name the stem is ``video``."""
    stem = sanitize_name(F.regexp_replace(F.coalesce(_col(source_name), F.lit("")), r"\.[^.]+$", ""))
    return F.concat(F.when(stem == "", "video").otherwise(stem), F.lit("_"), _col(stage_id), F.lit(".mp4"))


def format_bytes(c) -> Column:
    v = dbl(c)
    return F.when(v < MIB, F.concat(F.format_string("%.1f", v / 1024), F.lit(" KB"))).otherwise(
        F.concat(F.format_string("%.1f", v / MIB), F.lit(" MB")))


def format_duration(c) -> Column:
    """Hours and minutes, minutes and seconds, or seconds; a dash when unknown."""
    v = F.greatest(F.lit(0), js_round(c).cast("bigint"))
    h, m, s = F.floor(v / 3600), F.floor(v % 3600 / 60), v % 60
    text = (F.when(h > 0, F.concat(h, F.lit(" h "), m, F.lit(" min"))).when(m > 0, F.concat(m, F.lit(" min "), s, F.lit(" s")))
            .otherwise(F.concat(s, F.lit(" s"))))
    return F.when(dbl(c).isNull() | F.isnan(dbl(c)), "-").otherwise(text)
