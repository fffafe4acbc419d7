"""Where jobs keep what must outlive an executor: tables and files in the cluster's shared folder."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``.

    The setting is read from the session. Only a local session without it (tests) gets a
    temporary folder; a cluster without it is refused, as a folder of one machine would not do.
    """
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if app not in _OWN:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="cairn-")
        root = _OWN[app]
    return f"{root.rstrip('/')}/cairn-{app}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read back: cuts its lineage, survives executors."""
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(path: str):
    """The Arrow file system of a URI or path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for an application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(at, n), os.path.relpath(os.path.join(at, n), os.path.dirname(here)))
    files, root = filesystem(shared_dir(spark))
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/cairn_package.zip") as out:
        out.write(buffer.getvalue())
    sc.addPyFile(f"{shared_dir(spark)}/cairn_package.zip")
    _SHIPPED.add(sc.applicationId)
