"""What a Python worker builds once and keeps between batches."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

_kept: dict[str, Any] = {}


def token() -> str:
    """Names one thing to keep; made on the driver, captured by the function that runs in the workers."""
    return uuid.uuid4().hex


def once(name: str, build: Callable[[], Any], most: int = 4) -> Any:
    """What ``build`` gives, kept under ``name`` as one of ``most`` things at a time."""
    if name not in _kept:
        if len(_kept) >= most:
            _kept.clear()
        _kept[name] = build()
    return _kept[name]


def small_batches(spark, rows: int = 512) -> None:
    """Fewer rows of long texts at a time in a Python worker, unless the session asks for something else than Spark's default."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":
        spark.conf.set(setting, str(rows))


@contextmanager
def batches_of(spark, rows: int) -> Iterator[None]:
    """So many rows at a time in Python workers, for what runs inside: where a row is megabytes."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(rows))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


@contextmanager
def no_cycles() -> Iterator[None]:
    """Pauses the search for reference cycles, which walks through all that is kept; for work that makes none."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()
