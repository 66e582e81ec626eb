"""Tables of day folders whose closed days are folded into few files of even size.

A stream appends small files for ever. Folding a day writes its rows once more, in order and in as many files
as its bytes ask for, into a version of its own, and then the list of the files that went in: the day's pointer.
A version counts once its list is complete (Spark's success mark), so readers switch from the many files to the
few at one instant, and a fold that dies changes nothing. Files that arrive later are not in the list; they are
read beside the version until the next fold takes them in. Folded files can be removed once no reader of the
time before is left.

A reader names the folders of the days it asks for, so other days are not even listed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattscope.session import hadoop_files

TARGET_BYTES = 256 << 20


@dataclass(frozen=True)
class DayTable:
    """``root/<day>=.../<inner>=.../files`` with ``columns`` (all, the day and inner ones included)."""

    root: str
    day: str
    columns: T.StructType
    #: Partition columns below the day.
    inner: tuple[str, ...] = ()
    #: Rows of a folded day lie in this order, so files and row groups can be skipped by its first columns.
    order: tuple[str, ...] = ()
    #: What takes out copies of a row; a folded day without later files needs it no more.
    unique: Callable[[DataFrame], DataFrame] | None = None

    def _folder(self, day: date) -> str:
        return f"{self.root}/{self.day}={day.isoformat()}"

    def _versions(self, day: date) -> str:
        return f"{self.root}/_folded/data/{self.day}={day.isoformat()}"

    def _lists(self, day: date) -> str:
        return f"{self.root}/_folded/lists/{self.day}={day.isoformat()}"

    def _version(self, spark: SparkSession, day: date) -> int:
        """The newest complete version, 0 without one."""
        path, files = hadoop_files(spark, self._lists(day))
        if not files.exists(path):
            return 0
        found = [s.getPath() for s in files.listStatus(path)]
        kept = [int(p.getName().split("=")[1]) for p in found if p.getName().startswith("version=")
                and files.exists(hadoop_files(spark, f"{p.toString()}/_SUCCESS")[0])]
        return max(kept, default=0)

    def _files(self, spark: SparkSession, day: date) -> dict[str, int]:
        """The files of a day by the path below its folder, with their sizes. Names and sizes, as Spark's own
        listing has them on the driver."""
        path, files = hadoop_files(spark, self._folder(day))
        if not files.exists(path):
            return {}
        base, found, it = files.makeQualified(path).toString(), {}, files.listFiles(path, True)
        while it.hasNext():
            status = it.next()
            name = status.getPath().toString()[len(base) + 1:]
            if not any(part.startswith(("_", ".")) for part in name.split("/")):
                found[name] = status.getLen()
        return found

    def _taken(self, spark: SparkSession, day: date, version: int) -> set[str]:
        """What the pointer of a day lists: one name for each small file of that day."""
        if not version:
            return set()
        return {r["name"] for r in spark.read.schema("name string").parquet(f"{self._lists(day)}/version={version}").collect()}

    def _raw(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        return spark.read.schema(self.columns).option("basePath", self.root).parquet(*paths).select(*self.columns.names)

    def _parts(self, spark: SparkSession, days: list[date]) -> tuple[DataFrame | None, DataFrame | None]:
        """What lies folded of some days, and the files beside it."""
        folded, loose = [], []
        for day in days:
            version = self._version(spark, day)
            if version:
                folded.append(f"{self._versions(day)}/version={version}")
                # Only a day with a version has names to compare; the others are taken as folders.
                loose += [f"{self._folder(day)}/{name}" for name in sorted(self._files(spark, day).keys() - self._taken(spark, day, version))]
            else:
                path, files = hadoop_files(spark, self._folder(day))
                loose += [self._folder(day)] if files.exists(path) else []
        whole = (spark.read.schema(self.columns).option("basePath", f"{self.root}/_folded/data").parquet(*folded).select(*self.columns.names)
                 if folded else None)
        return whole, self._raw(spark, loose) if loose else None

    def days(self, spark: SparkSession) -> list[date]:
        """The days there are, by the names of their folders."""
        found = set()
        for root in (self.root, f"{self.root}/_folded/data"):
            path, files = hadoop_files(spark, root)
            names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
            found |= {date.fromisoformat(n.split("=", 1)[1]) for n in names if n.startswith(f"{self.day}=") and not n.endswith("__HIVE_DEFAULT_PARTITION__")}
        return sorted(found)

    def read(self, spark: SparkSession, first: date, last: date | None = None) -> DataFrame:
        """The rows of a day or an inclusive range of days; each once if the table says what is unique."""
        days = [first + timedelta(n) for n in range(((last or first) - first).days + 1)]
        return self._read(spark, days)

    def read_all(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, self.days(spark))

    def _read(self, spark: SparkSession, days: list[date]) -> DataFrame:
        whole, loose = self._parts(spark, days)
        if whole is None and loose is None:
            return spark.createDataFrame([], self.columns)
        rows = whole if loose is None else loose if whole is None else whole.unionByName(loose)
        rows = rows.where(F.col(self.day).between(F.lit(days[0]), F.lit(days[-1])))
        return self.unique(rows) if self.unique and loose is not None else rows

    def fold(self, spark: SparkSession, day: date, target_bytes: int = TARGET_BYTES, take: Callable[[str], bool] | None = None) -> int:
        """Fold a closed day; how many files went in (0: there was nothing new).

        ``take`` tells by its name whether a file may go in yet.
        """
        version = self._version(spark, day)
        known, there = self._taken(spark, day, version), self._files(spark, day)
        new = sorted(n for n in there.keys() - known if take is None or take(n))
        if not new:
            return 0
        parts = [self._raw(spark, [f"{self._folder(day)}/{n}" for n in new])]
        size = sum(there[n] for n in new)
        if version:
            before = f"{self._versions(day)}/version={version}"
            path, files = hadoop_files(spark, before)
            size += files.getContentSummary(path).getLength()
            parts.append(spark.read.schema(self.columns).option("basePath", f"{self.root}/_folded/data").parquet(before).select(*self.columns.names))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        if self.unique:
            rows = self.unique(rows)
        order = self.order or tuple(c for c in self.columns.names if c != self.day)
        (rows.drop(self.day).repartitionByRange(max(1, -(-size // target_bytes)), *order).sortWithinPartitions(*order)
         .write.mode("overwrite").parquet(f"{self._versions(day)}/version={version + 1}"))
        names = spark.createDataFrame([(n,) for n in sorted(known & there.keys() | set(new))], "name string")
        names.coalesce(1).write.mode("overwrite").parquet(f"{self._lists(day)}/version={version + 1}")
        return len(new)

    def expire(self, spark: SparkSession, day: date) -> int:
        """Remove the files and versions that the newest version of a day replaces; how many files went."""
        version = self._version(spark, day)
        taken = self._taken(spark, day, version) & self._files(spark, day).keys()
        for name in sorted(taken):
            path, files = hadoop_files(spark, f"{self._folder(day)}/{name}")
            files.delete(path, False)
        for n in range(1, version):
            for old in (f"{self._lists(day)}/version={n}", f"{self._versions(day)}/version={n}"):
                path, files = hadoop_files(spark, old)
                files.delete(path, True)
        return len(taken)
