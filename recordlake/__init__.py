"""Records from pages, search results and replies, as Spark jobs."""

from .spec import FieldSpec, RecordSpec

__all__ = ["FieldSpec", "RecordSpec"]
