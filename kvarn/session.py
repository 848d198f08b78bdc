"""Sessions, and the package's way to the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_own: list[str] = []


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once an application, so that their Python workers can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="kvarn-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = Path(folder) / f"kvarn_{os.getpid()}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(app)
    return spark


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a local one if the driver is the only machine, else an error."""
    if shared := spark.sparkContext.getConf().get("spark.checkpoint.dir", ""):
        return shared.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="kvarn-shared-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the queries expect (UTC, adaptive execution)."""
    defaults = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    return ship(SparkSession.builder.master(f"local[{cpus}]").appName("kvarn").config(map=defaults | conf).getOrCreate())
