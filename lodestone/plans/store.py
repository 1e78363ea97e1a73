"""Tables of an index as immutable segments, listed by versioned manifests."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "chunks": "id string, file_path string, chunk_content string, line_start int, line_end int, chunk_hash string, indexed_at timestamp, tokens int",
    "vectors": "chunk_id string, embedding array<float>",
    "postings": "chunk_id string, term string, places array<int>, dl int",
    "files": "path string, hash string, chunks int, indexed timestamp, size bigint, embedded boolean",
}
#: Columns that the store keeps beside them: tokens of a chunk, for the corpus' figures.
HIDDEN = {"chunks": ", _dl int"}
#: Column that says which file a stored row belongs to, and version that wrote it.
OWNER, SEQ = "_owner", "_seq"
#: Segments of one level that are merged into one of the next.
FANOUT = 8
#: Layout of stored tables; since 2 postings have a row for each term of a chunk.
LAYOUT = 2
#: Files younger than this are never removed: a writer may not have committed them yet.
MIN_AGE_SECONDS = 24 * 3600


class Conflict(RuntimeError):
    """Another writer committed first; nothing of this commit took effect."""


@dataclass
class Snapshot:
    version: int = 0
    #: For each table its segments: folder, version that wrote it, level.
    segments: dict[str, list[list]] = field(default_factory=dict)
    #: Folders of removed files, each with its version and its tables: their rows of older versions are gone.
    removed: list[list] = field(default_factory=list)
    metadata: dict[str, str] = field(default_factory=dict)
    #: As manifests that don't tell it have it.
    layout: int = 1

    def current(self) -> Snapshot:
        """Itself, unless its postings lie in an older layout."""
        if self.layout < LAYOUT and self.segments.get("postings"):
            raise ValueError("this index was written by an older version; rebuild it with force")
        return self

    def folders(self) -> set[str]:
        return {s[0] for many in self.segments.values() for s in many} | {r[0] for r in self.removed}


class Files:
    """Small files of a folder on any of Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def read_text(self, name: str) -> str | None:
        """A file's text, or None without the file."""
        at = self._path(f"{self.root}/{name}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8", "replace")
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        """Write a file, in place of an older one."""
        out = self._fs.create(self._path(f"{self.root}/{name}"), True)
        out.write(bytearray(text.encode()))
        out.close()

    def publish(self, draft: str, name: str) -> bool:
        """Give a draft its name, unless that is taken; the draft goes.

        Local files are linked, which is exclusive; others renamed, which on HDFS doesn't replace."""
        source, target = self._path(f"{self.root}/{draft}"), self._path(f"{self.root}/{name}")
        if self._fs.getScheme() != "file":
            won = not self._fs.exists(target) and self._fs.rename(source, target)
        else:
            local = [self._jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, source)]
            try:
                self._jvm.java.nio.file.Files.createLink(*local)
                won = True
            except Py4JJavaError as e:
                if "FileAlreadyExists" not in str(e.java_exception):
                    raise
                won = False
        self._fs.delete(source, False)
        return won


class Store(Files):
    """A folder of immutable segments. A commit writes the rows that are new and the
    names of the files whose older rows are gone, then one manifest under the
    next number; readers see the old state or the new one, and what didn't
    change isn't written again. Of FANOUT segments of one level a commit makes one.

    Of two writers that start from one version the second gets :class:`Conflict`;
    object stores whose rename can replace take one writer at a time. Names of
    segments are unique, and nothing is deleted but by :meth:`vacuum`."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root)
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    # Reading

    def _versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, version: int | None = None) -> Snapshot:
        versions = self._versions()
        if not versions:
            return Snapshot()
        return Snapshot(**json.loads(self.read_text(f"manifests/{version or versions[-1]}.json")))

    def _stored(self, name: str, segments: list[list], removed: list[list]) -> DataFrame:
        """Rows of segments that no later removal names."""
        schema = f"{SCHEMAS[name]}{HIDDEN.get(name, '')}, {OWNER} string, {SEQ} int"
        if not segments:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*(f"{self.root}/{s[0]}" for s in segments))
        late = [r for r in removed if r[1] > min(s[1] for s in segments) and name in r[2]]
        if not late:
            return rows
        gone = self.spark.read.schema("path string, seq int").parquet(*(f"{self.root}/{r[0]}" for r in late))
        gone = gone.groupBy("path").agg(F.max("seq").alias("seq"))
        return rows.join(gone, (F.col(OWNER) == gone["path"]) & (F.col(SEQ) < gone["seq"]), "left_anti")

    def stored(self, name: str, snapshot: Snapshot | None = None) -> DataFrame:
        """A table with the columns that only the store knows."""
        at = snapshot or self.snapshot()
        if name == "postings":
            at.current()
        return self._stored(name, at.segments.get(name, []), at.removed)

    def table(self, name: str, snapshot: Snapshot | None = None) -> DataFrame:
        return self.stored(name, snapshot).select(*(c.split()[0] for c in SCHEMAS[name].split(", ")))

    # Writing

    def change(self, base: Snapshot | None = None, clear: bool = False) -> Change:
        """A commit to be: of the snapshot ``base``, or of nothing if ``clear``."""
        return Change(self, base or self.snapshot(), clear)

    def _write(self, rows: DataFrame, name: str) -> str:
        """A segment. Postings come in runs that lie by term, so statistics of pages skip most of them."""
        folder = f"data/{name}-{uuid.uuid4().hex}"
        columns = [c.split()[0] for c in f"{SCHEMAS[name]}{HIDDEN.get(name, '')}".split(", ")]
        rows = rows.select(*columns, OWNER, F.col(SEQ).cast("int").alias(SEQ))
        rows.write.parquet(f"{self.root}/{folder}")
        return folder

    def _compacted(self, name: str, segments: list[list], removed: list[list]) -> list[list]:
        """Segments, the last FANOUT of one level merged into one of the next as often as there are so many.

        The merged segment counts as of the newest version in it: removals up to that have been applied."""
        while len(tail := [s for s in segments if s[2] == segments[-1][2]]) >= FANOUT:
            last = tail[-1][1]
            rows = self._stored(name, tail, [r for r in removed if r[1] <= last]).withColumn(SEQ, F.lit(last))
            if name == "postings":  # reading segments together mixes their runs
                rows = rows.sortWithinPartitions("term", "chunk_id")
            segments = [s for s in segments if s not in tail] + [[self._write(rows, name), last, tail[0][2] + 1]]
        return segments

    def vacuum(self, min_age_seconds: float = MIN_AGE_SECONDS) -> None:
        """Remove manifests but the last, and data that the rest don't name, if older than ``min_age_seconds``.

        On request only. The age must exceed the longest commit and the longest read."""
        cutoff = (time.time() - min_age_seconds) * 1000
        old = lambda folder: [s.getPath() for s in self._fs.listStatus(self._path(f"{self.root}/{folder}")) if s.getModificationTime() < cutoff]
        last = self._versions()[-1:]
        for p in old("manifests"):
            if p.getName() not in {f"{v}.json" for v in last}:
                self._fs.delete(p, False)
        used = {name for v in self._versions() for name in self.snapshot(v).folders()}
        if self._fs.exists(self._path(f"{self.root}/data")):
            for p in old("data"):
                if f"data/{p.getName()}" not in used:
                    self._fs.delete(p, True)


class Change:
    """Rows to add and files to remove, published by :meth:`commit` in one step or not at all."""

    def __init__(self, store: Store, base: Snapshot, clear: bool):
        self.store, self.base = store, base
        keep = not clear
        if keep:
            base.current()
        self.new = Snapshot(base.version + 1, {t: list(s) for t, s in base.segments.items() if keep}, list(base.removed) if keep else [], dict(base.metadata), LAYOUT)

    def write(self, name: str, rows: DataFrame, owner: str) -> DataFrame:
        """Add rows, each of the file that its column ``owner`` names; returns them as they are stored."""
        version = self.new.version
        segment = [self.store._write(rows.withColumn(OWNER, F.col(owner)).withColumn(SEQ, F.lit(version)), name), version, 0]
        self.new.segments.setdefault(name, []).append(segment)
        return self.store._stored(name, [segment], [])

    def remove(self, paths: DataFrame, tables: tuple[str, ...] = tuple(SCHEMAS)) -> None:
        """Remove all older rows of files (``path``) from some tables."""
        if any(self.new.segments.get(t) for t in tables):
            folder = f"data/removed-{uuid.uuid4().hex}"
            paths.select("path", F.lit(self.new.version).alias("seq")).write.parquet(f"{self.store.root}/{folder}")
            self.new.removed.append([folder, self.new.version, list(tables)])

    def commit(self, metadata: dict[str, str] | None = None) -> Snapshot:
        new, store = self.new, self.store
        new.metadata |= metadata or {}
        for name in list(new.segments):
            new.segments[name] = store._compacted(name, new.segments[name], new.removed)
        oldest = min((s[1] for many in new.segments.values() for s in many), default=new.version)
        new.removed = [r for r in new.removed if r[1] > oldest]
        draft = f"manifests/{uuid.uuid4().hex}.tmp"
        store.write_text(draft, json.dumps(asdict(new)))
        if not store.publish(draft, f"manifests/{new.version}.json"):
            raise Conflict(f"version {new.version} was committed by another writer")
        return new
