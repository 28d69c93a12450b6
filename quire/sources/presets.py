"""Style presets: a small dimension table with overrides."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, name string, description string, system_prompt string, language_register string, default_glossary_policy string, typography map<string,string>, builtin boolean"
#: The built-in presets, their registers and default policies.
BUILTIN = [
    ("academic-paper", "Academic paper", "formal", "footnote"),
    ("business-nonfiction", "Business nonfiction", "neutral", "translate_paren"),
    ("childrens", "Children's book", "colloquial", "translate"),
    ("general", "General", "neutral", "translate"),
    ("literary-fiction", "Literary fiction", "literary", "translate_paren"),
    ("religious-classical", "Religious and classical texts", "formal", "footnote"),
    ("technical-manual", "Technical manual", "technical", "keep"),
]
TYPOGRAPHY = {"page_size": "a5", "body_size_pt": "11.0", "leading": "1.75", "digit_style": "persian"}


def builtin_presets(spark: SparkSession) -> DataFrame:
    rows = [(i, name, f"{name}: {register} register.", f"Keep a {register} register and the sense of the text.", register, policy, TYPOGRAPHY, True) for i, name, register, policy in BUILTIN]
    return spark.createDataFrame(rows, SCHEMA)


def user_presets(spark: SparkSession, folder: str) -> DataFrame:
    """Presets of *.yaml files in a local folder of the driver."""
    import yaml

    rows = []
    for path in sorted(Path(folder).glob("*.yaml")):
        p = yaml.safe_load(path.read_text(encoding="utf-8"))
        rows.append((p["id"], p.get("name"), p.get("description"), p.get("system_prompt"), p.get("language_register", "neutral"), p.get("default_glossary_policy", "translate"), {k: str(v) for k, v in (p.get("typography") or {}).items()}, False))
    return spark.createDataFrame(rows, SCHEMA)


def resolve(builtin: DataFrame, user: DataFrame) -> DataFrame:
    """A user's preset takes the place of the built-in one with its id."""
    return user.unionByName(builtin.join(user.select("id"), "id", "left_anti").select(*user.columns))


def last_wins(base: Column, over: Column) -> Column:
    """Map union in which the second map's values count."""
    over = F.coalesce(over, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


def apply_delta(presets: DataFrame, deltas: DataFrame) -> DataFrame:
    """Presets with overrides: ``deltas``: id, register, policy, prompt_extra,
    typography. A delta's prompt is added behind a blank line."""
    both = presets.join(deltas.select("id", F.col("register").alias("_r"), F.col("policy").alias("_p"), F.col("prompt_extra").alias("_x"), F.col("typography").alias("_t"), F.lit(True).alias("_d")), "id", "left")
    return both.withColumns(
        {
            "language_register": F.coalesce("_r", "language_register"),
            "default_glossary_policy": F.coalesce("_p", "default_glossary_policy"),
            "system_prompt": F.when(F.col("_x").isNotNull(), F.concat_ws("\n\n", "system_prompt", "_x")).otherwise(F.col("system_prompt")),
            "typography": last_wins(F.col("typography"), F.col("_t")),
            "builtin": F.when(F.col("_d"), False).otherwise(F.col("builtin")),
        }
    ).drop("_r", "_p", "_x", "_t", "_d")
