"""Property-graph analytics on Spark: openCypher compiled to DataFrame plans."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

_ROOT = Path(__file__).resolve().parent


def ship(spark) -> None:
    """Lets the session's Python workers import this package, where their path lacks it."""
    context = spark.sparkContext
    if str(_ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_quiltgraph", False):
        return
    path = Path(tempfile.mkdtemp(prefix="quiltgraph-")) / "quiltgraph.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, p.relative_to(_ROOT.parent))
    context.addPyFile(str(path))  # Spark's own file server brings it to the executors
    context._quiltgraph = True
