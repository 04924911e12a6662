"""Results that appear as a whole: folders are written first, then a version names them.

A version is one file with one line of JSON, in a folder of its own whose name grows from version
to version. Spark moves a finished file to its place at the end, so a reader finds a version
complete or not at all; a run that fails before leaves the one before in force, and only folders
that no version names. There is one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession, functions as F


@dataclass(frozen=True)
class Version:
    number: int = 0
    folders: dict[str, str] = field(default_factory=dict)  # by name, below the table's own path
    notes: dict = field(default_factory=dict)


class Published:
    """The versions of what lies below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def current(self) -> Version:
        """The last version; number 0 if there is none."""
        try:
            files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{self.path}/versions")
            last = files.agg(F.max(F.regexp_extract("path", r"/v(\d+)/[^/]+$", 1))).first()[0]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return Version()
        if not last:
            return Version()
        line = json.loads(self.spark.read.text(f"{self.path}/versions/v{last}").first()["value"])
        return Version(int(last), line["folders"], line["notes"])

    def new_folder(self, label: str) -> str:
        """A folder, below ``path``, that nothing has been written to yet."""
        return f"data/{label}-{uuid.uuid4().hex}"

    def publish(self, folders: dict[str, str], notes: dict | None = None) -> Version:
        version = Version(self.current().number + 1, dict(folders), notes or {})
        line = json.dumps({"folders": version.folders, "notes": version.notes}, default=str)
        self.spark.createDataFrame([(line,)], "value STRING").coalesce(1).write.mode("overwrite").text(
            f"{self.path}/versions/v{version.number:012}"
        )
        return version
