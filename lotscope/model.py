"""Data model: table schemas, the geometry struct and the tunable parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# A geometry is a struct with its bounding box stored beside its parts.  The box
# lets Parquet prune and lets points skip the arrays altogether: a POINT keeps its
# coordinates in (xmin, ymin) and has no parts.  A missing geometry is a NULL struct or
# one whose kind, box and parts are NULL.
PARTS_DDL = "array<struct<kind:string,rings:array<array<struct<x:double,y:double>>>>>"
GEOMETRY_DDL = (
    "struct<kind:string,xmin:double,ymin:double,xmax:double,ymax:double,"
    f"parts:{PARTS_DDL}>"
)

SCHEMAS: dict[str, str] = {
    "observation": (
        "id_synthese bigint, unique_id_sinp string, id_source int, id_import int, "
        "id_dataset int, cd_nom int, nom_cite string, observers string, "
        "date_min timestamp_ntz, date_max timestamp_ntz, count_min int, count_max int, "
        "altitude_min int, altitude_max int, id_nomenclature_sex int, "
        "id_nomenclature_obs_technique int, id_nomenclature_life_stage int, "
        f"id_nomenclature_valid_status int, geom {GEOMETRY_DDL}"
    ),
    "source": (
        "id_source int, name_source string, desc_source string, "
        "meta_update_date timestamp_ntz, additional_data string"
    ),
    "import": "id_import int, date_create_import timestamp_ntz, additional_data string",
    "dataset": (
        "id_dataset int, unique_dataset_id string, dataset_name string, "
        "dataset_desc string, id_acquisition_framework int, additional_data string"
    ),
    "framework": (
        "id_acquisition_framework int, unique_acquisition_framework_id string, "
        "acquisition_framework_name string, acquisition_framework_desc string"
    ),
    "taxref": (
        "cd_nom int, cd_ref int, id_rang string, lb_nom string, nom_vern string, "
        "group2_inpn string"
    ),
    "rank": "id_rang string, nom_rang string",
    "nomenclature": (
        "id_nomenclature int, type_code string, cd_nomenclature string, label_default string"
    ),
    "validation": (
        "id_validation bigint, uuid_attached_row string, id_nomenclature_valid_status int, "
        "validation_auto boolean, id_validator int, validation_comment string, "
        "validation_date timestamp_ntz"
    ),
    "area": (
        f"id_area int, id_type int, area_name string, geom {GEOMETRY_DDL}, "
        f"geom_4326 {GEOMETRY_DDL}"
    ),
    "area_type": "id_type int, type_code string",
    "cor_area": "id_synthese bigint, id_area int",
    "invasive": "cd_nom int, presence string",
    "report": "report_id string, desc_source string, nom_fichier string, list_import string",
}


def struct_type(table: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[table])


class Tables:
    """The base tables by name, each made when it is first asked for.  ``import`` and
    ``rank`` are attributes with a suffix: ``import_``, ``rank_``."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        missing = set(SCHEMAS) - set(makers)
        if missing:
            raise ValueError(f"missing tables: {sorted(missing)}")
        self._makers = makers
        self._made: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, frames: dict[str, DataFrame]) -> Tables:
        return cls({name: (lambda df=df: df) for name, df in frames.items()})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name.rstrip("_") not in SCHEMAS:
            raise AttributeError(name)
        return self[name.rstrip("_")]

    def replacing(self, **frames: DataFrame) -> Tables:
        """The same tables but for some."""
        return Tables(self._makers | {name: (lambda df=df: df) for name, df in frames.items()})

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(name, self[name]) for name in SCHEMAS]


# They decide the results and are kept as they are.
SPECIES_RANK = "ES"
ADVISED_STATUS_CODES = ("0", "1", "2")
STATUS_TYPE = "STATUT_VALID"
SECTOR_DEPARTMENTS = {
    "RA": (
        "Ain", "Ardeche", "Drome", "Haute-Savoie", "Isere", "Loire", "Rhone", "Savoie",
    ),
    "Au": ("Allier", "Haute-Loire", "Puy-de-Dome", "Cantal"),
}
WHOLE_REGION_SECTOR = "AuRA"


@dataclass(frozen=True)
class Params:
    """Every threshold and instance-specific value, with its default."""

    # Defaults of the deployed configuration.
    import_source_id: int = 7087
    invasive_lots: tuple[str, ...] = ("7087_390", "7087_391", "7087_392", "7087_394")
    region_pattern: str = "%Auvergne-Rh%ne-Alpes%"
    min_year: int = 1677
    line_limit_km: float = 20.0
    area_limit_ha: float = 2500.0
    ancient_year: int = 1600
    region_margin_m: float = 5000.0
    duplicate_distance_m: float = 1.0
    snap_m: float = 0.000001
    mesh_type: str = "M5"
    department_type: int = 26
    fold_share: float = 0.02
    fold_keep: int = 10
    fold_label: str = "Autres"

    # First and last month whose first day a nanosecond timestamp can hold.
    first_month: str = "1677-10"
    last_month: str = "2262-04"

    # Addresses are deployment data; left empty here.
    dataset_url: str = ""
    report_url: str = ""

    # Side of the grid cells used to look polygons up, and the largest relation
    # (rows) that may be hinted for broadcast once its size has been checked.
    index_cell_m: float = 5000.0
    broadcast_rows: int = 200_000
