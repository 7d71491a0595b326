"""The engine's log of events: statements, changes of tables, and what went wrong."""

from __future__ import annotations

import logging

log = logging.getLogger("millrace")


def to_file(path: str) -> logging.Handler:
    """Also write events to a file of the driver's machine, a line each; the handler can be removed again with ``log.removeHandler``."""
    handler = logging.FileHandler(path, encoding="utf-8", delay=True)
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log.addHandler(handler)
    log.setLevel(logging.INFO)
    return handler
