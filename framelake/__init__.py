"""Media-timeline analytics on PySpark: clips, frames, audio blocks, boxes and stage events."""

from framelake.session import build_session, work_dir

__all__ = ["build_session", "work_dir"]
