"""Settings by name: what the caller passes, else the session's configuration, else the environment."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

PREFIX = "meshlens."


def option(spark: SparkSession, name: str, overrides: dict[str, str] | None = None, default: str | None = None) -> str | None:
    """A setting: ``name`` in ``overrides``, ``meshlens.<name>`` of the session, ``MESHLENS_<NAME>`` of the environment, else ``default``. Empty is unset."""
    found = (overrides or {}).get(name) or spark.conf.get(PREFIX + name, None)
    return found or os.environ.get((PREFIX + name).upper().replace(".", "_")) or default
