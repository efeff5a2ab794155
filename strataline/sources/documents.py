"""A data source that writes rows (path, value) as files, all of them or none.

Tasks write into a staging folder beside the target, which is there before they start; when all have ended the folder is renamed
to the target, and when one fails for good it is removed. A task that is repeated writes the same names again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import datasource as D
from pyspark.sql.types import Row

from ..session import ship_package
from . import files

NAME = "whole_documents"


@dataclass
class Written(D.WriterCommitMessage):
    files: int


class DocumentWriter(D.DataSourceWriter):
    def __init__(self, target: str):
        self.target, self.staging = target.rstrip("/"), f"{target.rstrip('/')}.staging"

    def write(self, iterator: Iterator[Row]) -> Written:
        at, top = files.store(self.staging)
        n = 0
        for row in iterator:
            if at.get_file_info(top).type.name != "Directory":
                raise RuntimeError(f"{self.staging} is gone: the write was given up")  # else a late task would make it anew
            files.write_text(at, f"{top}/{row['path']}", row["value"] or "")
            n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        at, top = files.store(self.staging)
        at.move(top, files.store(self.target)[1])

    def abort(self, messages: list[Written | None]) -> None:
        at, top = files.store(self.staging)
        at.delete_dir_contents(top, missing_dir_ok=True)
        at.delete_dir(top) if at.get_file_info(top).type.name == "Directory" else None


class DocumentSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, value string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"])


def write_documents(rows: DataFrame, target: str) -> None:
    """Rows (path, value) as the files of a new folder `target`, which is there with all of them or not at all."""
    spark = rows.sparkSession
    ship_package(spark)
    spark.dataSource.register(DocumentSource)
    at, top = files.store(f"{target.rstrip('/')}.staging")
    at.create_dir(top, recursive=True)
    with files.small_batches(spark):
        rows.select("path", "value").write.format(NAME).mode("append").save(target)
