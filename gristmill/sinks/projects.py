"""Projects: a table as Parquet beside its steps and stored questions, and the table rebuilt from them."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..plans.recipe import NOT_PORTABLE, Step, replay_longest

FORMAT = 1


def save_project(original: DataFrame, steps: Sequence[Step], path: str, questions: Sequence[dict[str, Any]] = ()) -> int:
    """Writes the table as it was loaded and what was done since; returns the number of steps that hold another table
    and so are left out."""
    kept = [s for s in steps if s["op"] not in NOT_PORTABLE]
    kinds = {f.name: f.metadata for f in original.schema.fields if f.metadata}
    about = json.dumps({"kind": "project", "version": FORMAT, "steps": kept, "questions": list(questions), "columns": kinds}, ensure_ascii=False)
    original.write.mode("overwrite").parquet(f"{path}/data")
    original.sparkSession.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    return len(steps) - len(kept)


def load_project(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, list[Step], list[dict[str, Any]]]:
    """The table as loaded, the table after all steps that still apply, the steps that do not, and the questions."""
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    if about.get("kind") != "project":
        raise ValueError("This folder holds no project.")
    data = spark.read.parquet(f"{path}/data")
    original = data.select(*[data[f"`{c}`"].alias(c, metadata=about["columns"].get(c, {})) for c in data.columns])
    made, failed = replay_longest(original, about["steps"])
    return original, made, failed, about["questions"]
