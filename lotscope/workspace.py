"""What every operator works on: the tables, the parameters and, when they have been
stored, the marts."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotscope.functions import text
from lotscope.functions.sizing import broadcast_if_small
from lotscope.model import Params, Tables


class Workspace:
    """``marts`` and ``rollup`` are stored results of ``plans.refresh``; what is
    missing there is computed from the tables when it is asked for."""

    def __init__(
        self,
        tables: Tables,
        params: Params | None = None,
        marts: dict[str, DataFrame] | None = None,
        rollup: DataFrame | None = None,
    ):
        self.tables = tables
        self.params = params or Params()
        self.marts = marts or {}
        self.rollup = rollup

    def with_reports(self, report: DataFrame) -> Workspace:
        """The same base with another list of reports."""
        return Workspace(self.tables.replacing(report=report), self.params, self.marts, self.rollup)

    @cached_property
    def observation(self) -> DataFrame:
        """The fact table with its ``lot_id``; a stored column is used as it is, so
        that a filter on it reaches the scan."""
        facts = self.tables.observation
        if "lot_id" in facts.columns:
            return facts
        return facts.withColumn(
            "lot_id", text.lot_id(F.col("id_source"), F.col("id_import"))
        )

    @cached_property
    def report_lots(self) -> DataFrame:
        """One row per (report, lot)."""
        return (
            self.tables.report.select(
                "report_id", F.explode(text.parse_lots(F.col("list_import"))).alias("lot_id")
            )
            .distinct()
        )

    @cached_property
    def bridge(self) -> DataFrame:
        return self.small(self.report_lots)

    @cached_property
    def reported_lots(self) -> DataFrame:
        """For semi-joins, which need no distinct lots.  Left as it is, a lot too many to
        broadcast is shuffled next to the facts, where hot lots are split at run time."""
        return self.small(self.report_lots.select("lot_id"))

    def small(self, df: DataFrame) -> DataFrame:
        return broadcast_if_small(df, self.params.broadcast_rows)

    def reported(self, facts: DataFrame) -> DataFrame:
        """Rows of the lots that some report covers, each once."""
        return facts.join(self.reported_lots, "lot_id", "left_semi")

    def per_report(self, df: DataFrame) -> DataFrame:
        """One row per report covering the row's lot: reports may overlap, so this
        comes after aggregation by lot wherever the measure allows."""
        return self.bridge.join(df, "lot_id")

    def every_report(self, df: DataFrame, **zero: object) -> DataFrame:
        """Left join to the list of reports, with defaults for absent ones."""
        return (
            self.tables.report.select("report_id")
            .distinct()
            .join(df, "report_id", "left")
            .fillna(zero)
        )

    def counts(self, *keys: str | Column) -> DataFrame:
        """Number of observations (``nb_data``) by some of: id_source, id_import,
        id_dataset, cd_nom, annee, mois.

        Facts are counted by keys before any dimension is joined, so a join never
        sees more rows than there are distinct keys and a hot source is combined
        before the shuffle.  The stored rollup, when there is one, replaces the scan.
        """
        if self.rollup is not None:
            return self.rollup.groupBy(*keys).agg(F.sum("nb_data").alias("nb_data"))
        return with_months(self.observation).groupBy(*keys).agg(F.count(F.lit(1)).alias("nb_data"))

    def mart(self, name: str) -> DataFrame:
        from lotscope.operators import marts

        return self.marts[name] if name in self.marts else marts.MARTS[name](self)


def with_months(facts: DataFrame) -> DataFrame:
    return facts.withColumns(
        {"annee": F.year("date_min"), "mois": F.month("date_min")}
    )
