"""Analytics over agent trajectories and code-localization answers, as PySpark DataFrame operators."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from pathlib import Path


def ship(spark) -> None:
    """Let executors import this package where the environment does not already give it to them (tests, notebooks)."""
    root = str(Path(__file__).resolve().parent.parent)
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if root in paths or getattr(context, "_waymark_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="waymark-")) / "waymark_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted((Path(root) / "waymark").rglob("*.py")):
            out.write(source, source.relative_to(root))
    context.addPyFile(str(archive))
    sys.path[:] = [p for p in sys.path if not p.endswith("waymark_package.zip")]
    context._waymark_shipped = True
