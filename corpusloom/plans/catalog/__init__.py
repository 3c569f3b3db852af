"""Registered queries, one per operator, each with its SQL twin where SQL can say it."""

from importlib import import_module

GROUPS = ["ingest", "graph", "evidence", "sessions", "quality", "context", "replies", "profile", "streams"]


def load() -> None:
    for group in GROUPS:
        import_module(f"{__name__}.{group}")
