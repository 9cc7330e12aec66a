"""What a driver has registered: languages, replacements and an emoji provider.

Executors never see this object. A column takes a snapshot when it is built, so a later registration
changes later columns only. ``seal`` freezes it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import SparkSession

from .tables import load
from .translit import Context, Romanizer

_state: dict = {"context": Context(), "provider": None}


def snapshot() -> Context:
    return _state["context"]


def emoji_provider() -> Callable | None:
    return _state["provider"]


def register_lang(code: str, mapping: dict[str, str]) -> None:
    _state["context"] = snapshot().register_lang(code, mapping)


def register_replacements(mapping: dict[str, str]) -> None:
    _state["context"] = snapshot().register_replacements(mapping)


def remove_replacement(key: str) -> None:
    _state["context"] = snapshot().remove_replacement(key)


def clear_replacements() -> None:
    _state["context"] = snapshot().clear_replacements()


def set_emoji_provider(provider: Callable[[list[int]], str | None] | None) -> None:
    """A function from code points to a name or null; it travels to executors by pickle."""
    if snapshot().sealed:
        raise RuntimeError("registrations are sealed")
    _state["provider"] = provider


def seal_registrations() -> None:
    _state["context"] = snapshot().seal()


def registrations_sealed() -> bool:
    return snapshot().sealed


class CachedTransliterator:
    """``transliterate`` for single strings on the driver, with the last results remembered; new registrations count from the next call."""

    def __init__(self, spark: SparkSession, maxsize: int = 4096, **options):
        self._build = lambda context: lru_cache(maxsize)(Romanizer(load(spark), context=context, **options))
        self._made: tuple[Context, Callable] | None = None

    def __call__(self, s: str) -> str:
        if self._made is None or self._made[0] is not snapshot():
            self._made = snapshot(), self._build(snapshot())
        return self._made[1](s)


def make_cached_transliterator(spark: SparkSession, maxsize: int = 4096, **options) -> CachedTransliterator:
    return CachedTransliterator(spark, maxsize, **options)


def dedup_batch(spark: SparkSession, values: list[str], **options) -> list[str]:
    """A list romanised once per distinct value; for columns see ``operators.datasets.dedup_transliterate``."""
    romanize = Romanizer(load(spark), context=snapshot(), **options)
    done = {v: romanize(v) for v in dict.fromkeys(values)}
    return [done[v] for v in values]
