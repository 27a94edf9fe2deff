from .scoring import APPLICATION_SCHEMA, start_scoring_stream

__all__ = ["APPLICATION_SCHEMA", "start_scoring_stream"]
