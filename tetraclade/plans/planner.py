"""Which physical plan a query takes, and session-wide overrides."""

from __future__ import annotations

import contextlib
import logging
import warnings
from collections.abc import Iterator

STRATEGIES = ("auto", "broadcast", "blocks", "relational")
_forced: list[str] = []


def available_strategies() -> list[str]:
    """Names that the ``strategy`` argument takes."""
    return list(STRATEGIES)


def forced() -> str | None:
    """The innermost override, if any."""
    return _forced[-1] if _forced else None


@contextlib.contextmanager
def use_strategy(name: str) -> Iterator[None]:
    """Make ``auto`` mean ``name`` inside the block."""
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; choose from {', '.join(STRATEGIES)}")
    _forced.append(name)
    try:
        yield
    finally:
        _forced.pop()


@contextlib.contextmanager
def silent_benchmark(name: str) -> Iterator[None]:
    """:func:`use_strategy` and :func:`quiet` together."""
    with use_strategy(name), quiet(logging.CRITICAL):
        yield


@contextlib.contextmanager
def quiet(level: int = logging.ERROR, name: str = "tetraclade") -> Iterator[None]:
    """Keep messages below ``level`` of a logger back inside the block."""
    logger = logging.getLogger(name)
    before = logger.level
    logger.setLevel(level)
    try:
        yield
    finally:
        logger.setLevel(before)


def current_strategy() -> str:
    """What ``auto`` means now."""
    return forced() or "auto"


@contextlib.contextmanager
def suppress_logger(name: str = "tetraclade", level: int = logging.ERROR) -> Iterator[logging.Logger]:
    """:func:`quiet` that hands out the logger."""
    with quiet(level, name):
        yield logging.getLogger(name)


@contextlib.contextmanager
def suppress_warnings(*categories: type[Warning]) -> Iterator[None]:
    """Ignore Python warnings of the categories (all, if none is given) inside the block."""
    with warnings.catch_warnings():
        for c in categories or (Warning,):
            warnings.simplefilter("ignore", c)
        yield
