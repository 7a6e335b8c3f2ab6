"""A project folder as a stream: what came, changed or went since the last look, as rows.

An offset is the number of a listing of the folder. Listings are kept, one small
file each, until the stream has committed the next one, so a batch that is
repeated after a failure gives the same rows, and a restarted stream goes on
from where it was. Only the listing passes the driver, never a file's content.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from loomdex.sources.project import keep_wanted, project_rules, read_contents, text_files

CHANGES = "path string, rel_path string, mtime timestamp, length bigint, deleted boolean"
ROWS_PER_PARTITION = 2000
LISTING = re.compile(r"listing-(\d+)\.json")


class Changed(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/") or "/"
        self.state = options["state"]
        os.makedirs(self.state, exist_ok=True)

    # -- listings: {path: [seconds, size]}

    def file(self, n: int) -> str:
        return os.path.join(self.state, f"listing-{n}.json")

    def numbers(self) -> list[int]:
        return sorted(int(m[1]) for m in map(LISTING.fullmatch, os.listdir(self.state)) if m)

    def load(self, n: int) -> dict:
        if n == 0:
            return {}
        with open(self.file(n), encoding="utf-8") as stored:
            return json.load(stored)

    def look(self, known: dict) -> dict:
        """The folder as it is; what lies below a folder that cannot be listed counts as unchanged."""
        found, broken = {}, []
        for folder, _, names in os.walk(self.root, onerror=broken.append):
            for name in names:
                path = os.path.join(folder, name)
                try:
                    if os.path.isfile(path):
                        stat = os.stat(path)
                        found[path] = [stat.st_mtime, stat.st_size]
                except OSError as error:
                    broken.append(error)
        for error in broken:
            hidden = (error.filename or self.root).rstrip("/")
            found |= {p: v for p, v in known.items() if p == hidden or p.startswith(hidden + "/")}
        return found

    # -- the stream

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        last = max(self.numbers(), default=0)
        known = self.load(last)
        found = self.look(known)
        if found != known:
            last += 1
            with open(self.file(last) + ".new", "w", encoding="utf-8") as made:
                json.dump(found, made)
            os.replace(self.file(last) + ".new", self.file(last))
        return {"listing": last}

    def partitions(self, start: dict, end: dict) -> list[Changed]:
        before, after = self.load(start["listing"]), self.load(end["listing"])
        rows = [(path, *value, False) for path, value in sorted(after.items()) if before.get(path) != value]
        rows += [(path, *value, True) for path, value in sorted(before.items()) if path not in after]
        return [Changed(rows[i : i + ROWS_PER_PARTITION]) for i in range(0, len(rows), ROWS_PER_PARTITION)]

    def read(self, partition: Changed):
        for path, seconds, size, deleted in partition.rows:
            yield path, os.path.relpath(path, self.root), dt.datetime.fromtimestamp(seconds, dt.timezone.utc), size, deleted

    def commit(self, end: dict) -> None:
        for n in self.numbers():
            if n < end["listing"]:
                os.remove(self.file(n))


class ProjectChanges(DataSource):
    """``spark.readStream.format('project_changes').option('state', folder).load(project)``."""

    @classmethod
    def name(cls):
        return "project_changes"

    def schema(self):
        return CHANGES

    def streamReader(self, schema):
        return ChangeReader(self.options)


def project_changes(spark: SparkSession, root: str, state: str) -> DataFrame:
    """Streaming ``path, rel_path, mtime, length, deleted`` of all files below ``root``, first all that are there.

    ``state`` is a folder of this stream's own that the driver can write, kept as
    long as its checkpoint; both folders are paths that can be opened.
    """
    spark.dataSource.register(ProjectChanges)
    return spark.readStream.format("project_changes").option("state", state).load(root)


def file_versions(changes: DataFrame, root: str, suffixes=None) -> DataFrame:
    """``path, content, mtime`` of the wanted files among a batch of changes; null content means that the file is gone.

    A file that turned binary is gone, too; one that cannot be read is left as it was.
    """
    wanted = keep_wanted(changes, F.col("rel_path"), suffixes, project_rules(root))
    read = read_contents(wanted.where("not deleted"))
    kept = text_files(read)
    binary = read.where("content is null and error is null").select("path", F.lit(None).cast("string").alias("content"), "mtime")
    after = F.col("mtime") + F.expr("interval 1 microsecond")  # newer than the version that went
    gone = wanted.where("deleted").select("path", F.lit(None).cast("string").alias("content"), after.alias("mtime"))
    return kept.unionByName(binary).unionByName(gone)
