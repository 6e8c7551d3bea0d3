"""Header normalisation, coercion and source contracts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import nan_to_null


def merged(config: dict, sections: list[str]) -> dict:
    """Sections of a configuration as one mapping; of equal keys the later section's wins, absent sections are empty."""
    return {k: v for name in sections for k, v in (config.get(name) or {}).items()}


def normalise_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[re.sub(r"\s+", "_", c.strip().lower()) for c in df.columns])


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Read columns as double; text that is no number becomes NULL."""
    return nan_to_null(
        df.select(*[F.expr(f"try_cast(`{c}` AS double)").alias(c) if c in columns else F.col(c) for c in df.columns])
    )


def utc_timestamp(raw: Column, run_time: str) -> Column:
    """Parse a naive timestamp as UTC (the session zone); unreadable text gives the run time."""
    return F.coalesce(F.try_to_timestamp(raw), F.lit(run_time).cast("timestamp"))


@dataclass(frozen=True)
class Contract:
    """Required columns and types of a source.

    ``mode`` is what a violation does: ``report`` returns the findings,
    ``raise`` stops, ``log`` leaves it to the caller's log.
    """

    required: tuple[str, ...]
    numeric: tuple[str, ...] = ()
    dates: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    mode: str = "report"
    warn_null: tuple[str, ...] = field(default=())

    def missing(self, df: DataFrame) -> list[str]:
        return [c for c in self.required if c not in df.columns]

    def mistyped(self, df: DataFrame) -> list[str]:
        kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
        number = {"double", "float", "integer", "long", "short", "byte"}
        moment = {"date", "timestamp", "timestamp_ntz"}
        return [c for c in self.numeric if c in kinds and kinds[c] not in number] + [
            c for c in self.dates if c in kinds and kinds[c] not in moment
        ]

    def findings(self, df: DataFrame) -> DataFrame:
        """One row per check with its count of offending rows and whether it passed."""
        present = [c for c in self.keys + self.warn_null if c in df.columns]
        totals = df.agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in present],
        )
        schema_checks = [("missing_columns", len(self.missing(df))), ("mistyped_columns", len(self.mistyped(df)))]
        checks = [
            F.struct(F.lit("empty").alias("check"), (F.col("rows") == 0).cast("long").alias("offending"), F.lit(True).alias("fatal"))
        ]
        checks += [
            F.struct(F.lit(name).alias("check"), F.lit(n).cast("long").alias("offending"), F.lit(True).alias("fatal"))
            for name, n in schema_checks
        ]
        checks += [
            F.struct(
                F.lit(f"null_{c}").alias("check"),
                F.col(f"null_{c}").alias("offending"),
                F.lit(c in self.keys).alias("fatal"),
            )
            for c in present
        ]
        return (
            totals.select(F.explode(F.array(*checks)).alias("f"))
            .select("f.check", "f.offending", "f.fatal")
            .withColumn("passed", (F.col("offending") == 0) | ~F.col("fatal"))
        )

    def check(self, df: DataFrame) -> bool:
        """True when the contract holds; raises for ``mode='raise'``."""
        if self.missing(df):
            ok, why = False, f"missing columns {self.missing(df)}"
        else:
            failed = [r["check"] for r in self.findings(df).where(~F.col("passed")).collect()]
            ok, why = not failed, f"failed checks {failed}"
        if not ok and self.mode == "raise":
            raise ValueError(why)
        return ok
