"""Readiness: are the objects that the analyses need there?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Required objects with their kind, where they come from and how badly each is needed.
REQUIRED = (
    ("report", "vue", "Spécifique projet", "Bloquant"),
    ("mart_dataset", "mv", "Spécifique projet", "Bloquant"),
    ("mart_detail", "mv", "Spécifique projet", "Bloquant"),
    ("mart_framework", "mv", "Spécifique projet", "Majeur"),
    ("mart_rank", "mv", "Spécifique projet", "Majeur"),
    ("mart_temporal", "mv", "Spécifique projet", "Majeur"),
    ("mart_mesh", "mv", "Spécifique projet", "Majeur"),
    ("observation", "table", "Core", "Bloquant"),
    ("source", "table", "Core", "Mineur"),
    ("taxref", "table", "Core", "Bloquant"),
    ("rank", "table", "Core", "Mineur"),
    ("area", "table", "Core", "Majeur"),
    ("nomenclature", "table", "Core", "Majeur"),
    ("import", "table", "Module Import", "Majeur"),
    ("latest_validation", "vue", "Module Validation", "Mineur"),
    ("invasive", "table", "Spécifique projet", "Mineur"),
)
REQUIRED_FUNCTIONS = (("get_id_nomenclature", "fonction", "Core", "Majeur"),)


def _status(spark: SparkSession, schema: str, required, present: DataFrame) -> DataFrame:
    wanted = spark.createDataFrame(
        list(required), "nom_objet string, type_objet string, origine string, criticite string"
    ).withColumn("schema_objet", F.lit(schema))
    urgency = (
        F.when(F.col("criticite") == "Bloquant", 0).when(F.col("criticite") == "Majeur", 1).otherwise(2)
    )
    return (
        wanted.join(present.withColumn("found", F.lit(True)), "nom_objet", "left")
        .select(
            "schema_objet", "nom_objet", "type_objet", "origine", "criticite",
            F.when(F.col("found"), "OK").otherwise("MANQUANT").alias("statut"),
        )
        .orderBy(urgency, "schema_objet", "nom_objet")
    )


def readiness(spark: SparkSession, database: str | None = None, required=REQUIRED) -> DataFrame:
    """Status of the required tables, views and marts of a database, the most urgent
    first."""
    where = f" IN {database}" if database else ""
    present = spark.sql(f"SHOW TABLES{where}").select(F.col("tableName").alias("nom_objet")).distinct()
    return _status(spark, database or spark.catalog.currentDatabase(), required, present)


def function_readiness(spark: SparkSession, database: str | None = None, required=REQUIRED_FUNCTIONS) -> DataFrame:
    schema = database or spark.catalog.currentDatabase()
    present = spark.sql(f"SHOW USER FUNCTIONS IN {schema}").select(
        F.substring_index("function", ".", -1).alias("nom_objet")
    ).distinct()
    return _status(spark, schema, required, present)
