"""Session and settings."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import SparkSession

from .functions.constants import BOOLEAN_WORDS


def session(name: str = "lodestone", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings as spark_sql_shuffle_partitions="200" and the like."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def as_bool(text: str) -> bool:
    if text.strip().lower() not in BOOLEAN_WORDS:
        raise ValueError(f"must be one of {', '.join(BOOLEAN_WORDS)}, not {text!r}")
    return BOOLEAN_WORDS[text.strip().lower()]


def as_positive(text: str) -> int:
    number = int(text)
    if number < 1:
        raise ValueError(f"must be at least 1, not {number}")
    return number


#: How the text of a variable becomes the value of a field, by the field's type.
READERS: dict[str, Callable[[str], Any]] = {"str": str.strip, "bool": as_bool, "int": as_positive}


@dataclass(frozen=True)
class Settings:
    """root: where tables lie. source_directory: files to sync. model_cache_directory: where neural models lie."""

    root: str
    source_directory: str = ""
    model_cache_directory: str = ""
    encoder: str = "hashing"
    device: str = "cpu"
    batch_size: int = 32
    local_files_only: bool = False
    vector_cache: bool = True
    parser_version: str = "lines-v1"
    retrieval_version: str = "hybrid-neural-embedding-v5"

    def __post_init__(self):
        if self.batch_size < 1:
            raise ValueError("batch_size must be at least 1")

    @classmethod
    def from_env(cls, root: str | None = None, environment: Mapping[str, str] | None = None) -> Settings:
        """Each field from LODESTONE_<FIELD>, else its default; `root`, if given, wins over the environment."""
        environment, values = os.environ if environment is None else environment, {}
        for f in fields(cls):
            name = f"LODESTONE_{f.name.upper()}"
            if name in environment:
                try:
                    values[f.name] = READERS[str(f.type)](environment[name])
                except ValueError as e:
                    raise ValueError(f"{name}: {e}") from e
        if root is not None:
            values["root"] = root
        if not values.get("root"):
            raise ValueError("set LODESTONE_ROOT, or give a root")
        return cls(**values)
