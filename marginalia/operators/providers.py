"""Model provider configuration: a small table, and the choice of the provider to use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from marginalia import schemas
from marginalia.config import DEFAULTS, Settings

FALLBACK = {"chat": ("extractive", "evidence_synthesis_v1"), "embedding": ("keyword", "local_text_match")}
LOCAL_TYPES = ("ollama", "extractive", "keyword")


def default_configs(spark: SparkSession, settings: Settings = DEFAULTS) -> DataFrame:
    """The configurations of a fresh library."""
    rows = [
        ("cfg_chat_ollama", "chat", "ollama", settings.chat_model, settings.model_base_url, None, True),
        ("cfg_embed_ollama", "embedding", "ollama", settings.embed_model, settings.model_base_url, None, True),
        ("cfg_chat_extractive", "chat", *FALLBACK["chat"], None, None, False),
        ("cfg_embed_keyword", "embedding", *FALLBACK["embedding"], None, None, False),
    ]
    return spark.createDataFrame(rows, schemas.CONFIG_DDL)


def load_configs(spark: SparkSession, path: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Configurations from a JSON array file; malformed rows are skipped, an empty result means defaults."""
    rows = (
        spark.read.schema(schemas.CONFIG_DDL).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    )
    valid = rows.filter(F.col("id").isNotNull() & F.col("role").isNotNull() & F.col("provider_type").isNotNull())
    valid = valid.withColumns(
        {
            "model_name": F.coalesce("model_name", F.lit("")),
            "is_default": F.coalesce("is_default", F.lit(False)),
        }
    )
    return default_configs(spark, settings) if valid.isEmpty() else valid


def upsert_configs(configs: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert or replace configurations; a new default demotes the other defaults of its role.

    Of several new defaults of one role the one with the smallest id stays the default.
    """
    promoted = incoming.filter("is_default").groupBy("role").agg(F.min("id").alias("_default"))
    kept = configs.join(incoming.select("id"), "id", "left_anti").join(promoted, "role", "left")
    demoted = kept.withColumn("is_default", F.col("is_default") & F.col("_default").isNull())
    added = incoming.join(promoted, "role", "left").withColumn(
        "is_default", F.col("is_default") & F.col("id").eqNullSafe(F.col("_default"))
    )
    return demoted.select(*configs.columns).unionByName(added.select(*configs.columns))


def delete_config(configs: DataFrame, config_id: str) -> DataFrame:
    return configs.filter(F.col("id") != config_id)


def model_installed(wanted: Column, installed: Column) -> Column:
    """Whether a model is among the installed names: exact, by base name, or any tag of the base."""
    base = F.get(F.split(wanted, ":"), F.lit(0))
    return F.exists(
        installed, lambda name: (name == wanted) | (name == base) | F.startswith(name, F.concat(base, F.lit(":")))
    )


def resolve(configs: list[Row], role: str, reachable: Callable[[Row], bool]) -> tuple[str, str]:
    """(provider type, model) serving a role: the default if it works, else the local fallback.

    Hosted provider types are kept as configuration but never called, so they fall back too.
    ``configs`` is the collected configuration table, a handful of rows.
    """
    preferred = next((c for c in configs if c["role"] == role and c["is_default"]), None)
    if preferred is not None and preferred["provider_type"] == "ollama" and reachable(preferred):
        return preferred["provider_type"], preferred["model_name"]
    return FALLBACK[role]


def provider_list(configs: DataFrame) -> DataFrame:
    """Configurations as listed in settings, with the local flag."""
    return configs.withColumn("local", F.col("provider_type").isin(*LOCAL_TYPES))
