"""Session settings the library is tuned for."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(
    app_name: str = "panelwright", master: str | None = None, **overrides: str
) -> SparkSession:
    """Return a session with the defaults above; ``overrides`` use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | {key.replace("__", "."): value for key, value in overrides.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once for an application.

    Operators that run Python in tasks need it there; a job that was submitted with the package in
    ``--py-files`` does not need the call, and it does no harm.
    """
    context = spark.sparkContext
    if getattr(context, "_panelwright_code", None) == context.applicationId:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="panelwright-code-")
    archive = shutil.make_archive(f"{folder}/panelwright", "zip", package.parent, package.name)
    context.addPyFile(archive)
    context._panelwright_code = context.applicationId
