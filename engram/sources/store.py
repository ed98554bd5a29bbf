"""Stores: snapshots of JSON per subject, and versioned Parquet tables.

A versioned store is a folder of immutable Parquet parts and a numbered series of
small manifests, each of which lists the parts of all tables. A commit writes its
parts first and then creates the next manifest, which never replaces another one;
the newest complete manifest counts. So readers see a whole commit or none of it,
whatever fails in between, and one commit can change several tables at once. All
paths go through Spark's file systems, so any that Spark reads will do.
"""

from __future__ import annotations

import json
import uuid
import zlib

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions.text import snapshot_filename
from ..operators.archetype import SCHEMA as ARCHETYPES
from ..operators.archetype import Archetype
from ..operators.facts import SCHEMA as FACTS
from ..operators.facts import THETA_DEDUP
from .shared import remove_folder, shared_folder

SNAPSHOT_VERSION = 1
FACTS_FILE = "facts.json"
MAX_PARTS = 64

# Names in the snapshot format.
_TRACE = "trace struct<salience:double,lambda:double,reinforcement:double,last_touch:double>"


class _Files:
    """The few file operations that tables don't cover, by Hadoop's file system of a path."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def write(self, path: str, text: str) -> None:
        """Write beside the target, then rename over it; for exports, which have no readers meanwhile."""
        fs, p = self._at(path)
        _, temp = self._at(f"{path}.{uuid.uuid4().hex}.tmp")
        self.create(str(temp), text)
        if fs.exists(p):
            fs.delete(p, False)
        fs.rename(temp, p)

    def create(self, path: str, text: str) -> bool:
        """Write a new file; false if there is one of that name."""
        fs, p = self._at(path)
        try:
            out = fs.create(p, False)
        except Py4JJavaError as e:
            if fs.exists(p):
                return False
            raise e
        out.write(text.encode())
        out.close()
        return True

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _Files(spark)._at(path)
    return fs.getFileStatus(p).isDirectory()


def _kind(schema: str) -> StructType:
    return _parse_datatype_string(schema)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], _kind(schema))


# snapshots ---------------------------------------------------------------


def _snapshot(row: dict) -> dict:
    trace = lambda r: {k: r[k] for k in ("salience", "lambda", "reinforcement", "last_touch")}
    pairs = lambda h: [[x["label"], x["n"]] for x in h]
    return {
        "version": SNAPSHOT_VERSION, "subject": row["subject"], "core": row["core"], "anomalies": row["anomalies"], "anomaly_labels": row["anomaly_labels"], "core_label": row["core_label"], "represented": row["represented"],
        "arc": [{"at": m["tick"], "direction": m["direction"], "absorbed": m["absorbed"], "label": m["label"], "label_histogram": pairs(m["label_histogram"])} for m in row["arc"]],
        "trace": trace(row), "modes": [{"centroid": m["centroid"], "origin": m["origin"], "label": m["label"], "label_histogram": pairs(m["label_histogram"]), "absorbed": m["absorbed"], "trace": trace(m)} for m in row["modes"]],
    }


def _restored(found: dict) -> dict:
    counts = lambda h: [{"label": a, "n": n} for a, n in h or []]
    row = {k: found.get(k) for k in ("subject", "core", "anomalies", "anomaly_labels", "core_label", "represented")} | found["trace"]
    row["arc"] = [{"tick": m["at"], "direction": m["direction"], "absorbed": m["absorbed"], "label": m.get("label"), "label_histogram": counts(m.get("label_histogram"))} for m in found["arc"]]
    row["modes"] = [{"centroid": m["centroid"], "origin": m.get("origin"), "label": m.get("label"), "label_histogram": counts(m.get("label_histogram")), "absorbed": m["absorbed"]} | m["trace"] for m in found.get("modes") or []]
    return Archetype.of(row).row()


def save_snapshots(archetypes: DataFrame, folder: str) -> int:
    """One pretty JSON file per subject, named after it. For export of moderate numbers; tables are the store at scale."""
    files, n = _Files(archetypes.sparkSession), 0
    for row in archetypes.toLocalIterator():
        found = row.asDict(recursive=True)
        files.write(f"{folder}/{snapshot_filename(found['subject'])}", json.dumps(_snapshot(found), indent=2, ensure_ascii=False))
        n += 1
    return n


def load_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Archetypes of a folder in file-name order; an absent folder is an empty store.

    Raises ValueError on a file that isn't a snapshot, and on a subject that comes twice.
    """
    files, rows = _Files(spark), []
    for name in files.names(folder):
        if name.endswith(".json") and name != FACTS_FILE:
            rows.append(load_snapshot(spark, f"{folder}/{name}"))
    if len({r["subject"] for r in rows}) < len(rows):
        raise ValueError("a subject has two snapshots")
    kind = _kind(ARCHETYPES)
    return spark.createDataFrame([tuple(r[f] for f in kind.names) for r in rows], kind)


def load_snapshot(spark: SparkSession, path: str) -> dict:
    try:
        return _restored(json.loads(_Files(spark).read(path)))
    except (json.JSONDecodeError, KeyError, TypeError) as e:
        raise ValueError(f"{path} is no snapshot: {e!r}") from e


def read_snapshot_table(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshots of a folder as a distributed JSON source, with defaults for what older ones lack."""
    pair = "array<array<string>>"
    mode = f"struct<centroid:array<double>,origin:array<double>,label:string,label_histogram:{pair},absorbed:bigint,trace:struct<salience:double,lambda:double,reinforcement:double,last_touch:double>>"
    schema = f"version int, subject string, core array<double>, core_label string, represented bigint, modes array<{mode}>, {_TRACE}"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*-*.json").json(folder)
    filled = F.transform(F.coalesce("modes", F.array()), lambda m: m.withField("origin", F.when(F.size(m["origin"]) > 0, m["origin"]).otherwise(m["centroid"])))
    return rows.select("subject", "core", F.coalesce("core_label", F.lit("")).alias("core_label"), "represented", filled.alias("modes"), "trace.*")


def save_facts(facts: DataFrame, folder: str, theta: float = THETA_DEDUP) -> None:
    rows = [r.asDict(recursive=True) for r in facts.orderBy("seq").toLocalIterator()]
    _Files(facts.sparkSession).write(f"{folder}/{FACTS_FILE}", json.dumps({"theta_dedup": theta, "facts": rows}, indent=2, ensure_ascii=False))


def load_facts(spark: SparkSession, folder: str) -> tuple[DataFrame, float]:
    files = _Files(spark)
    if not files.exists(f"{folder}/{FACTS_FILE}"):
        return empty(spark, FACTS), THETA_DEDUP
    found = json.loads(files.read(f"{folder}/{FACTS_FILE}"))
    kind = _kind(FACTS)
    return spark.createDataFrame([tuple(r[f] for f in kind.names) for r in found["facts"]], kind), found["theta_dedup"]


# versioned tables ------------------------------------------------------------


class TableStore:
    """Named tables under a folder; ``marks`` are small values that are committed with them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), _Files(spark)

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names(f"{self.folder}/_versions") if n.endswith(".json"))

    def _newest(self) -> tuple[int, dict]:
        """The last number used, and the newest complete manifest."""
        numbers = self._numbers()
        for n in reversed(numbers):
            try:
                found = json.loads(self.files.read(f"{self.folder}/_versions/{n:020}.json"))
            except json.JSONDecodeError:  # its writer failed or is still at it
                continue
            if found.get("complete"):
                return numbers[-1], found
        return (numbers[-1] if numbers else 0), {"tables": {}, "marks": {}}

    def marks(self) -> dict:
        return self._newest()[1]["marks"]

    def version(self, name: str) -> str | None:
        """What changes with each change of the table; none if there is no such table."""
        found = self._newest()[1]["tables"].get(name)
        return None if found is None else found["version"]

    def _put(self, name: str, rows: DataFrame, buckets: int | None) -> list[dict]:
        """Write parts; with buckets, one for each bucket of subjects that has rows."""
        path = f"{name}/{uuid.uuid4().hex}"
        if not buckets:
            rows.write.parquet(f"{self.folder}/{path}")
            return [{"path": path, "bucket": None}]
        rows.withColumn("bucket", bucket_of(F.col("subject"), buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{path}")
        found = [n for n in self.files.names(f"{self.folder}/{path}") if n.startswith("bucket=")]
        return [{"path": f"{path}/{n}", "bucket": int(n.removeprefix("bucket="))} for n in found]

    def commit(self, replaced: dict[str, DataFrame] | None = None, *, appended: dict[str, DataFrame] | None = None, marks: dict | None = None, buckets: dict[str, int] | None = None, only: dict[str, list[int]] | None = None) -> str:
        """Replace tables and add rows to others, all at once; ``only`` replaces just these buckets of a table.

        Raises RuntimeError if another commit has changed a table to be replaced since this one began.
        """
        buckets, only = buckets or {}, only or {}
        seen = self._newest()[1]["tables"]
        new = {name: self._put(name, rows, buckets.get(name)) for name, rows in (replaced or {}).items()}
        more = {name: self._put(name, rows, buckets.get(name)) for name, rows in (appended or {}).items()}
        schemas = {name: rows.schema.json() for name, rows in ((replaced or {}) | (appended or {})).items()}
        while True:
            number, now = self._newest()
            if any(now["tables"].get(name) != seen.get(name) for name in new):
                raise RuntimeError("another commit has changed a table")
            version, tables = uuid.uuid4().hex, dict(now["tables"])
            for name, parts in new.items():
                kept = [p for p in tables[name]["parts"] if p["bucket"] not in only[name]] if name in only and name in tables else []
                tables[name] = {"version": version, "parts": kept + parts, "schema": schemas[name]}
            for name, parts in more.items():
                tables[name] = {"version": version, "parts": (tables[name]["parts"] if name in tables else []) + parts, "schema": schemas[name]}
            text = json.dumps({"tables": tables, "marks": now["marks"] | (marks or {}), "complete": True})
            if self.files.create(f"{self.folder}/_versions/{number + 1:020}.json", text):
                return version

    def write(self, name: str, rows: DataFrame, buckets: int | None = None, marks: dict | None = None) -> str:
        """Replace a table; ``buckets`` parts it by a hash of the subject, so lookups read one part."""
        return self.commit({name: rows}, buckets={name: buckets} if buckets else None, marks=marks)

    def append(self, name: str, rows: DataFrame, marks: dict | None = None) -> str:
        """Add rows; earlier parts stay as they are. Many small parts are put together now and then."""
        found = self._newest()[1]["tables"].get(name)
        if found is not None and len(found["parts"]) >= MAX_PARTS:
            return self.write(name, self.read(name, "").unionByName(rows), marks=marks)
        return self.commit(appended={name: rows}, marks=marks)

    def read(self, name: str, schema: str, only: list[int] | None = None) -> DataFrame:
        """The current rows, or those of some buckets; an absent table is empty."""
        found = self._newest()[1]["tables"].get(name)
        if found is None:
            return empty(self.spark, schema)
        kind = StructType.fromJson(json.loads(found["schema"]))
        paths = [f"{self.folder}/{p['path']}" for p in found["parts"] if only is None or p["bucket"] is None or p["bucket"] in only]
        if not paths:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).option("recursiveFileLookup", True).parquet(*paths)

    def upsert(self, name: str, schema: str, rows: DataFrame, key: str = "subject") -> str:
        """Replace the rows whose keys come in ``rows`` and add the others."""
        old = self.read(name, schema)
        return self.write(name, old.join(rows.select(key), key, "left_anti").unionByName(rows))


def bucket_of(subject: Column, buckets: int) -> Column:
    return (F.crc32(subject.cast("binary")) % buckets).cast("int")


def buckets_of(subjects: list[str], buckets: int) -> list[int]:
    """The same on the driver."""
    return sorted({zlib.crc32(s.encode()) % buckets for s in subjects})


__all__ = ["TableStore", "bucket_of", "buckets_of", "load_facts", "load_snapshot", "load_snapshots", "read_snapshot_table", "remove_folder", "save_facts", "save_snapshots", "shared_folder"]
