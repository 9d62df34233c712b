"""Log records as JSON lines, and operations that log how long they took."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

#: What a record may carry besides its message.
EXTRA = ("stage", "operation", "duration_ms", "error")


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        known = {k: v for k in EXTRA if (v := getattr(record, k, None)) is not None}
        when = datetime.fromtimestamp(record.created, UTC).isoformat()
        return json.dumps({"timestamp": when, "level": record.levelname, "message": record.getMessage()} | known)


def configure(name: str = "driftline", level: int = logging.INFO) -> logging.Logger:
    """The package's logger with one handler of JSON lines; calling it again adds none."""
    logger = logging.getLogger(name)
    handler = logging.StreamHandler()
    handler.setFormatter(JsonLines())
    logger.handlers[:] = [handler]
    logger.setLevel(level)
    logger.propagate = False
    return logger


@contextmanager
def timed(logger: logging.Logger, operation: str) -> Iterator[None]:
    """Log the end of an operation, or its failure, with the milliseconds it took."""
    began = time.perf_counter()
    took = lambda: int(1000 * (time.perf_counter() - began))
    logger.info("start: %s", operation, extra={"operation": operation})
    try:
        yield
    except Exception as e:
        logger.error("failed: %s", operation, extra={"operation": operation, "duration_ms": took(), "error": str(e)})
        raise
    logger.info("done: %s", operation, extra={"operation": operation, "duration_ms": took()})
