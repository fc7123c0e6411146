"""Headings, formats and column choices of the displayed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotscope.functions.text import grouped_number, percent

# Displayed columns, in order, with their headings.
HEADINGS = {
    "rank_shares": {
        "rang": "Rang",
        "nb_data": "Nb. de données importées",
        "part_data": "Part du lot de données",
        "repartition_total": "Répartition totale dans la base",
    },
    "framework_table": {
        "unique_acquisition_framework_id": "UUID",
        "acquisition_framework_name": "Cadre d'acquisition",
        "nb_data": "Nb. de données",
    },
    "dataset_table": {
        "acquisition_framework_name": "Cadre d'acquisition",
        "dataset_name": "Jeu de données",
        "unique_dataset_id": "UUID JDD",
        "nb_data": "Nb. de données",
    },
    "to_review": {
        "uuid": "uuid",
        "cd_ref": "cd_ref",
        "rang": "rang",
        "nom_vern": "nom_vern",
        "lb_nom": "lb_nom",
        "label_valid_status": "label_valid_status",
        "commentaire": "Commentaire",
        "date_commentaire": "Date_commentaire",
    },
    "dup_across": {
        "nom_source": "Nom_source",
        "nombre_donnees_dupliquees": "Nombre_donnees_dupliquees",
    },
    "dup_within": {
        "cd_nom": "cd_nom",
        "nom_vern": "Nom vernaculaire",
        "lb_nom": "Nom scientifique",
        "date": "Date",
        "observers": "Observateur",
        "nb_data_similaire": "Nb données similaires",
    },
    "invasive_summary": {
        "nom_vern": "Nom vernaculaire",
        "lb_nom": "Nom scientifique",
        "cd_ref": "Cd_ref",
        "presence_connue": "Présence connue",
        "secteur_obs": "Secteur(s) d'observation",
        "nouvelle_presence": "Nouvelle présence",
        "nb_donnees": "Nombre d'observations",
        "premiere_observation": "Première obs.",
        "derniere_observation": "Dernière obs.",
    },
}
AS_NUMBER = {"rank_shares": ("nb_data",), "framework_table": ("nb_data",), "dataset_table": ("nb_data",)}
AS_PERCENT = {"rank_shares": ("part_data", "repartition_total")}


def displayed(section: str, df: DataFrame) -> DataFrame:
    """A section as its table shows it; ``report_id`` stays in front."""

    def shown(column: str):
        if column in AS_NUMBER.get(section, ()):
            return grouped_number(F.col(column))
        if column in AS_PERCENT.get(section, ()):
            return percent(F.col(column))
        return F.col(column)

    lead = ["report_id"] if "report_id" in df.columns else []
    return df.select(
        *lead, *[shown(c).alias(heading) for c, heading in HEADINGS[section].items()]
    )
