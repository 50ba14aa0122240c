"""Exports of one wiki."""

from __future__ import annotations

import io
import tarfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_parquet(pages: DataFrame, wiki_id: str, path: str) -> None:
    pages.filter(F.col("wiki_id") == wiki_id).write.mode("overwrite").parquet(path)


def export_archive(pages: DataFrame, wiki_id: str, form: str = "zip", out_dir: str = ".") -> Path:
    """<wiki_id>_wiki.zip or .tar.gz with wiki/<path> for each page. Rows are streamed to the driver, a partition at a time."""
    if form not in ("zip", "tar", "tar.gz", "tgz"):
        raise ValueError(f"Unsupported export format: '{form}'. Use 'zip' or 'tar'.")
    rows = pages.filter(F.col("wiki_id") == wiki_id).select("path", F.coalesce("content", F.lit("")).alias("content")).orderBy("path").toLocalIterator()
    target = Path(out_dir).resolve() / f"{wiki_id}_wiki{'.zip' if form == 'zip' else '.tar.gz'}"
    target.parent.mkdir(parents=True, exist_ok=True)
    if form == "zip":
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for r in rows:
                z.writestr(f"wiki/{r.path}", r.content)
    else:
        with tarfile.open(target, "w:gz") as t:
            for r in rows:
                data = r.content.encode()
                entry = tarfile.TarInfo(f"wiki/{r.path}")
                entry.size = len(data)
                t.addfile(entry, io.BytesIO(data))
    return target
