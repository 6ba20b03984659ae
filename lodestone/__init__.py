"""Document retrieval and answer grounding as Spark DataFrame jobs."""

from lodestone.session import get_session

__all__ = ["get_session"]
