"""Where the files of the public tokenizers are: a parameter of the session, never files of this repository."""

from __future__ import annotations

import importlib.util
from pathlib import Path

from pyspark.sql import SparkSession

FOLDER = "/opt/tokenizers"
SETTING = "spark.pagesieve.tokenizers"


def path(name: str, spark: SparkSession | None = None) -> str:
    """The place of a vocabulary file, as the package of public tokenizers in the folder names it."""
    folder = spark.conf.get(SETTING, FOLDER) if spark is not None else FOLDER
    found = importlib.util.spec_from_file_location("public_tokenizers", str(Path(folder, "__init__.py")))
    module = importlib.util.module_from_spec(found)
    found.loader.exec_module(module)
    return module.path(name)
