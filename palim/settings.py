"""Typed settings from text values, as an environment or a Spark configuration holds them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

_TRUE, _FALSE = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}


def boolean(value: str | None, default: bool) -> bool:
    text = (value or "").strip().lower()
    return True if text in _TRUE else False if text in _FALSE else default


def whole(value: str | None, default: int | None) -> int | None:
    try:
        return int((value or "").strip())
    except ValueError:
        return default


@dataclass(frozen=True)
class Settings:
    model_url: str | None = None
    chat_model: str | None = None
    embedding_model: str | None = None
    seed: int | None = None
    timeout_seconds: int = 60
    reviews: bool = True
    consolidation_tasks: int = 4

    @classmethod
    def of(cls, values: Mapping[str, str], prefix: str = "palim.") -> Settings:
        """Values that don't parse count as missing."""
        get = lambda name: values.get(prefix + name)
        url = get("model.url")
        natural = lambda name, default: n if (n := whole(get(name), default)) is not None and n >= 0 else default
        return cls(
            url.rstrip("/") if url else None, get("model.chat"), get("model.embedding"), whole(get("model.seed"), None), natural("model.timeoutSeconds", 60), boolean(get("reviews"), True), natural("consolidation.tasks", 4)
        )

    @classmethod
    def of_session(cls, spark) -> Settings:
        return cls.of(dict(spark.sparkContext.getConf().getAll()))
