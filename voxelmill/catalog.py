"""All queries of the library's own operators, with their SQL."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import contour_queries, curved_queries, deck_queries, face_queries, field_queries, json_queries, mechanics_queries, solid_queries, state_queries, structure_queries, surface_queries

MODULES = (contour_queries, field_queries, structure_queries, mechanics_queries, solid_queries, surface_queries, curved_queries, deck_queries, state_queries, face_queries, json_queries)
FLAGSHIP = "density_cells"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}

_shipped: set[str] = set()


def ship(spark: SparkSession, root: str = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))) -> None:
    """Send the package's files to the executors, once for each application.
    Call it before using operators with Python tasks where the executors can't
    import the package; the registered queries do so themselves."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="voxelmill-"), "voxelmill.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "voxelmill")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
