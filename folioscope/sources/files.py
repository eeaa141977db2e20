"""Reading page and source trees, inboxes, metadata and configuration."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from folioscope.functions.constants import SCOPES

METADATA = "original_name string, inbox_path string, ingested_at string, distilled boolean, distilled_at string, target_page string"


def _path() -> F.Column:  # type: ignore[name-defined]
    return F.col("_metadata.file_path")


def _texts(spark: SparkSession, pattern: str) -> DataFrame | None:
    try:
        return spark.read.text(pattern, wholetext=True).withColumn("path", F.url_decode(_path()))
    except AnalysisException:
        return None  # no file matches


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """(scope, kind, ref, body) of ``wiki/<scope>/<slug>.md`` and ``sources/<scope>/<id>/document.md``.

    Front matter is taken off pages only. A tree without files gives no rows.
    """
    out = spark.createDataFrame([], "scope string, kind string, ref string, body string")
    for kind, pattern, name in (("wiki", f"{root}/wiki/*/*.md", r"/wiki/([^/]+)/([^/]+)\.md$"), ("source", f"{root}/sources/*/*/document.md", r"/sources/([^/]+)/([^/]+)/document\.md$")):
        rows = _texts(spark, pattern)
        if rows is None:
            continue
        body = F.regexp_replace("value", r"(?s)\A---\n(.*?)\n---\n?", "") if kind == "wiki" else F.col("value")
        made = rows.select(F.regexp_extract("path", name, 1).alias("scope"), F.lit(kind).alias("kind"), F.regexp_extract("path", name, 2).alias("ref"), body.alias("body"))
        out = out.unionByName(made.where(F.col("scope").isin(*SCOPES)))
    return out


def scan_inbox(spark: SparkSession, root: str) -> DataFrame:
    """(path, source_id, n_bytes) of the files under an inbox; hidden files and folders are skipped.

    The id is 12 digits of the hash of the bytes and up to 40 characters of the name.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    named = files.withColumn("path", F.url_decode("path")).where(~F.col("path").rlike(r"/\.[^/]"))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "")
    return named.select("path", F.concat(F.substring(F.sha2("content", 256), 1, 12), F.lit("-"), F.substring(stem, 1, 40)).alias("source_id"), F.col("length").alias("n_bytes"))


def scan_metadata(spark: SparkSession, root: str) -> DataFrame:
    """Metadata of sources, one JSON object per file; files that can't be parsed are left out."""
    rows = _texts(spark, f"{root}/sources/*/*/metadata.json")
    if rows is None:
        return spark.createDataFrame([], "scope string, source_id string, " + METADATA)
    name = r"/sources/([^/]+)/([^/]+)/metadata\.json$"
    parsed = rows.select(F.regexp_extract("path", name, 1).alias("scope"), F.regexp_extract("path", name, 2).alias("source_id"), F.from_json("value", METADATA + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("m"))
    return parsed.where("m._bad IS NULL").select("scope", "source_id", "m.*").drop("_bad")


def scope_and_folder(path: str) -> tuple[str, str]:
    """Scope and folder of a file under an inbox: the first part must be a scope."""
    parts = [p for p in path.strip("/").split("/") if p]
    if not parts or parts[0] not in SCOPES:
        raise ValueError(f"{path}: the first folder must be one of {', '.join(SCOPES)}")
    return parts[0], "/".join(parts[1:-1])


def checked_scopes(text: str | None) -> list[str]:
    """Scopes of a comma list; unknown ones are an error, none means all."""
    named = [s.strip() for s in (text or "").split(",") if s.strip()]
    unknown = sorted(set(named) - set(SCOPES))
    if unknown:
        raise ValueError(f"unknown scopes: {', '.join(unknown)}")
    return named or list(SCOPES)


@dataclass(frozen=True)
class Config:
    """Nested settings with dotted lookup; values of a wrong kind fall back to the default."""

    values: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Config:
        try:
            value = json.loads(text)
        except ValueError:
            value = {}
        return cls(value if isinstance(value, dict) else {})

    def get(self, dotted: str, default: Any = None) -> Any:
        here: Any = self.values
        for key in dotted.split("."):
            if not isinstance(here, dict) or key not in here:
                return default
            here = here[key]
        return here

    def integer(self, dotted: str, default: int, least: int | None = None, most: int | None = None) -> int:
        value = self.get(dotted)
        try:
            n = int(value) if not isinstance(value, bool) and value is not None else default
        except (TypeError, ValueError):
            n = default
        n = n if most is None else min(most, n)
        return n if least is None else max(least, n)

    def flag(self, dotted: str, default: bool) -> bool:
        value = self.get(dotted)
        if isinstance(value, bool):
            return value
        if isinstance(value, str) and re.fullmatch(r"(?i)\s*(true|yes|on|1|false|no|off|0)\s*", value):
            return value.strip().lower() in ("true", "yes", "on", "1")
        return default

    def role_model(self, role: str, default: str) -> str:
        """The model of a role, else the general one, else the default."""
        for key in (f"models.{role}", "models.default", "model"):
            value = self.get(key)
            if isinstance(value, str) and value.strip():
                return value.strip()
        return default
