"""Versioned model tables (S11, S12) and the per-batch outputs beside them.

Layout under ``root``: ``predictions/version=N`` holds what batch N gave, ``weights/version=N``
the coordinates that it changed, ``model/version=N`` the labels with the settings and the batch's
metrics. A coordinate's state is that of the last version that has it, from the version ``base`` on, which holds all;
after ``COMPACT`` versions the next one is a base again. So what a batch writes follows the batch, not the state. A version is written whole by overwrite, ``model`` last: a batch that is run again
after a failure writes the same version again from the version before it.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrill.config import FtrlConfig, JoinPolicy
from textrill.functions.linear import number, text
from textrill.session import is_missing, path_exists

MODEL_SCHEMA = (
    "label STRING, ord INT, first_batch BIGINT, state_rows BIGINT, rows BIGINT, correct BIGINT, "
    "accuracy DOUBLE, drift BOOLEAN, settings STRING, base BIGINT, "
    "index_type STRING"
)

# versions of changed coordinates that are read together before a whole state is written
COMPACT = 16


@dataclass(frozen=True)
class Score:
    """E3, E7. How the model before a batch did on it."""

    rows: int | None = None
    correct: int | None = None
    accuracy: float | None = None
    drift: bool = False


@dataclass(frozen=True)
class Model:
    """A committed version: the state table and the small facts about it."""

    version: int
    state: DataFrame
    state_rows: int
    labels: list[str]
    first_batch: list[int]
    score: Score
    settings: FtrlConfig
    base: int = 0


def _bigint(value: int | None) -> str:
    return "CAST(NULL AS BIGINT)" if value is None else f"{value}L"


def last_states(states: DataFrame) -> DataFrame:
    """``(idx, z, n)``: of each coordinate what its last ``version`` says, combined before the shuffle."""
    last = states.groupBy("idx").agg(F.max_by(F.struct("z", "n"), "version").alias("_last"))
    return last.select("idx", "_last.z", "_last.n")


class ModelStore:
    """Tables of one online model under a shared path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str, version: int | None = None) -> str:
        base = f"{self.root}/{table}"
        return base if version is None else f"{base}/version={version}"

    def write(self, table: str, version: int, df: DataFrame) -> DataFrame:
        """Write one version of a table and read it back."""
        df.write.mode("overwrite").parquet(self.path(table, version))
        return self.spark.read.schema(df.schema).parquet(self.path(table, version))

    def read(self, table: str) -> DataFrame:
        """All versions of a table; the version is the ``batch`` column."""
        df = self.spark.read.parquet(self.path(table))
        return df.withColumnRenamed("version", "batch")

    def metrics(self) -> DataFrame:
        """S13, E3, E7. ``(batch, rows, correct, accuracy, drift)`` of the scored batches."""
        scored = self.read("model").where((F.col("ord") == 0) & F.col("accuracy").isNotNull())
        return scored.select("batch", "rows", "correct", "accuracy", "drift")

    def commit(
        self,
        version: int,
        state: DataFrame,
        labels: Sequence[str],
        first_batch: Sequence[int],
        cfg: FtrlConfig,
        score: Score = Score(),
        prior: Model | None = None,
        rows: int | None = None,
    ) -> Model:
        """S11. Write a version: the coordinates, then the labels that make it visible.

        With ``prior``, ``state`` holds only what has changed since that version; ``rows`` is the number of all
        coordinates, where it is known.
        """
        base = version
        if prior is not None:
            if version - prior.base < COMPACT:
                base = prior.base
            else:
                state = last_states(
                    prior.state.withColumn("version", F.lit(0)).unionByName(state.withColumn("version", F.lit(1)))
                )
        written = self.write("weights", version, state)
        rows = written.count() if rows is None else rows
        index_type = written.schema["idx"].dataType.simpleString()
        if base < version:
            written = self.states(base, version, index_type)
        facts = {
            "state_rows": f"{rows}L",
            "rows": _bigint(score.rows),
            "correct": _bigint(score.correct),
            "accuracy": "CAST(NULL AS DOUBLE)" if score.accuracy is None else number(score.accuracy),
            "drift": str(score.drift).lower(),
            "settings": text(json.dumps(asdict(cfg))),
            "base": f"{base}L",
            "index_type": text(index_type),
        }
        constant = ", ".join(f"'{name}', {value}" for name, value in facts.items())
        entries = ", ".join(
            f"named_struct('label', {text(label)}, 'ord', {position}, 'first_batch', {first}L, "
            f"{constant})"
            for position, (label, first) in enumerate(zip(labels, first_batch))
        )
        one = self.spark.range(0, 1, 1, 1)
        self.write("model", version, one.selectExpr(f"inline(array({entries}))"))
        return Model(version, written, rows, list(labels), list(first_batch), score, cfg, base)

    def states(self, base: int, version: int, index_type: str) -> DataFrame:
        """The whole state at a version: of each coordinate the last of the versions from ``base`` on."""
        schema = f"idx {index_type}, z ARRAY<DOUBLE>, n ARRAY<DOUBLE>"
        if base == version:
            return self.spark.read.schema(schema).parquet(self.path("weights", version))
        found = self.spark.read.schema(f"{schema}, version BIGINT").parquet(self.path("weights"))
        return last_states(found.where((F.col("version") >= base) & (F.col("version") <= version)))

    def read_version(self, table: str, version: int) -> DataFrame | None:
        """One version of a table by its path, or None."""
        path = self.path(table, version)
        return self.spark.read.parquet(path) if self._written(path) else None

    def _written(self, path: str) -> bool:
        """Whether a write to ``path`` has been finished."""
        return path_exists(self.spark, f"{path}/_SUCCESS")

    def versions(self, table: str = "model") -> list[int]:
        """Written versions of a table in order; those of ``model`` are the committed ones."""
        if not path_exists(self.spark, self.path(table)):
            return []
        try:
            found = self.spark.read.parquet(self.path(table)).select("version").distinct()
        except AnalysisException as error:
            if not is_missing(error):
                raise
            return []
        return sorted(row["version"] for row in found.collect())

    def load(self, version: int) -> Model | None:
        """S12. One committed version, or None."""
        path = self.path("model", version)
        if not self._written(path):
            return None
        rows = self.spark.read.schema(MODEL_SCHEMA).parquet(path).collect()
        rows.sort(key=lambda row: row["ord"])
        settings = json.loads(rows[0]["settings"])
        settings["join"] = JoinPolicy(**settings["join"])
        return Model(
            version,
            self.states(rows[0]["base"], version, rows[0]["index_type"]),
            rows[0]["state_rows"],
            [row["label"] for row in rows],
            [row["first_batch"] for row in rows],
            Score(*(rows[0][name] for name in ("rows", "correct", "accuracy", "drift"))),
            FtrlConfig(**settings),
            rows[0]["base"],
        )

    def latest(self, before: int | None = None) -> Model | None:
        """L21, S12. The last version, or the last one before a batch.

        The version right before is tried by its path; only a gap makes the store list.
        """
        if before is not None:
            if before > 0 and (model := self.load(before - 1)) is not None:
                return model
            if before == 0:
                return None
        earlier = [v for v in self.versions() if before is None or v < before]
        return self.load(earlier[-1]) if earlier else None

    def submodel(self, label: str, version: int | None = None) -> DataFrame:
        """S12. State of a single label, ``(idx, z, n)``."""
        model = self.latest() if version is None else self.load(version)
        if model is None or label not in model.labels:
            raise KeyError(label)
        position = model.labels.index(label)
        return model.state.select(
            "idx",
            *(F.coalesce(F.get(c, F.lit(position)), F.lit(0.0)).alias(c) for c in ("z", "n")),
        )

    def is_empty(self) -> bool:
        """L12."""
        return not self.versions()
