"""Class vocabularies: crosswalks from source classes, names, tie-break order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (dataset, source class, unified-8, fine-4, fine-8).
CROSSWALK_ROWS = [
    ("g2017", 0, 0, 0, 0),
    ("g2017", 10, 1, 1, 1),
    ("g2017", 20, 6, 2, 2),
    ("g2017", 30, 4, 2, 4),
    ("g2017", 40, 4, 2, 5),
    ("g2017", 50, 2, 2, 5),
    ("g2017", 60, 5, 2, 6),
    ("g2017", 70, 5, 2, 6),
    ("g2017", 80, 2, 2, 5),
    ("g2017", 90, 2, 2, 5),
    ("g2017", 100, 2, 2, 5),
    ("glwd_v2", 0, 0, 0, 0),
    ("glwd_v2", 1, 1, 1, 1),
    ("glwd_v2", 2, 1, 1, 1),
    ("glwd_v2", 3, 1, 1, 1),
    ("glwd_v2", 4, 1, 1, 1),
    ("glwd_v2", 5, 1, 1, 1),
    ("glwd_v2", 6, 1, 1, 1),
    ("glwd_v2", 7, 1, 1, 1),
    ("glwd_v2", 8, 3, 2, 4),
    ("glwd_v2", 9, 2, 2, 5),
    ("glwd_v2", 10, 5, 2, 4),
    ("glwd_v2", 11, 5, 2, 5),
    ("glwd_v2", 12, 5, 2, 4),
    ("glwd_v2", 13, 5, 2, 5),
    ("glwd_v2", 14, 3, 2, 4),
    ("glwd_v2", 15, 2, 2, 5),
    ("glwd_v2", 16, 3, 2, 4),
    ("glwd_v2", 17, 2, 2, 5),
    ("glwd_v2", 18, 3, 2, 4),
    ("glwd_v2", 19, 2, 2, 5),
    ("glwd_v2", 20, 3, 2, 4),
    ("glwd_v2", 21, 2, 2, 5),
    ("glwd_v2", 22, 4, 2, 3),
    ("glwd_v2", 23, 4, 2, 3),
    ("glwd_v2", 24, 4, 2, 3),
    ("glwd_v2", 25, 4, 2, 3),
    ("glwd_v2", 26, 4, 2, 3),
    ("glwd_v2", 27, 4, 2, 3),
    ("glwd_v2", 28, 6, 2, 2),
    ("glwd_v2", 29, 6, 2, 7),
    ("glwd_v2", 30, 6, 2, 1),
    ("glwd_v2", 31, 6, 2, 7),
    ("glwd_v2", 32, 6, 2, 7),
    ("glwd_v2", 33, 7, 3, 5),
    ("gwd30", 0, 0, 0, 0),
    ("gwd30", 1, 1, 1, 1),
    ("gwd30", 2, 1, 1, 1),
    ("gwd30", 3, 1, 1, 1),
    ("gwd30", 4, 1, 1, 1),
    ("gwd30", 5, 1, 1, 1),
    ("gwd30", 6, 1, 1, 1),
    ("gwd30", 7, 7, 3, 1),
    ("gwd30", 8, 2, 2, 5),
    ("gwd30", 9, 3, 2, 4),
    ("gwd30", 10, 5, 2, 6),
    ("gwd30", 11, 6, 2, 7),
    ("gwd30", 12, 6, 2, 2),
    ("gwd30", 13, 6, 2, 7),
    ("gwd30", 14, 1, 1, 1),
]
# Unified classes by name, and their order where they tie.
UNIFIED_NAMES = ["Non-wetland", "Water", "Inland Herbaceous", "Forested", "Peatland", "Floodplain", "Coastal", "Artificial"]
PRIORITY = [1, 7, 4, 6, 5, 3, 2, 0]
SCHEMES = ("yaml8", "fine4", "fine8")


def crosswalk(spark: SparkSession) -> DataFrame:
    """scheme, dataset_id, source_class, target_class."""
    rows = [(s, r[0], r[1], r[2 + i]) for i, s in enumerate(SCHEMES) for r in CROSSWALK_ROWS]
    return spark.createDataFrame(rows, "scheme string, dataset_id string, source_class int, target_class int")


def mapped(df: DataFrame, scheme: str, source: str = "class_id", target: str = "target_class") -> DataFrame:
    """``df`` with the class that the crosswalk gives; null for a class that it does not have."""
    i = 2 + SCHEMES.index(scheme)
    pairs = [x for r in CROSSWALK_ROWS for x in (F.lit(f"{r[0]}:{r[1]}"), F.lit(r[i]))]
    return df.withColumn(target, F.try_element_at(F.create_map(*pairs), F.concat_ws(":", "dataset_id", F.col(source).cast("string"))))


def wetland_classes(dataset_id: str, include_water: bool = False) -> list[int]:
    """Source classes that count as wetland."""
    return [r[1] for r in CROSSWALK_ROWS if r[0] == dataset_id and r[2] != 0 and (include_water or r[2] != 1)]


def priority(class_id: Column) -> Column:
    """A unified class's place in the tie-break order, from 0."""
    pairs = [x for i, c in enumerate(PRIORITY) for x in (F.lit(c), F.lit(i))]
    return F.try_element_at(F.create_map(*pairs), class_id.cast("int"))
