"""Spark-native analytics for archived discussion threads.

Raw JSON posts and nested comment trees come in; normalized tables, thread
structure, ingest state and integrity reports come out.  Every operator is a
``DataFrame -> DataFrame`` function.
"""

from threadloom.session import build_session, configure

__all__ = ["build_session", "configure"]
