"""Which files are indexed: listing, and rules as column predicates."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions.text import extension
from .globs import ignored

# Extensions that are indexed as text by default, documents in
# binary formats, size limits in bytes (exclusive), directories never entered.
TEXT_EXTENSIONS = (
    ".md .mdx .txt .rst .ts .tsx .js .jsx .mjs .cjs .py .rs .go .java .kt .kts .scala .c .cc .cpp .cxx .h .hpp .hxx "
    ".cs .fs .vb .swift .m .mm .rb .php .pl .lua .dart .ex .exs .erl .clj .cljs .edn .vue .svelte .astro "
    ".css .scss .sass .less .html .htm .json .jsonc .yaml .yml .toml .ini .xml .csv .tsv .sh .bash .zsh .fish .ps1 "
    ".sql .graphql .gql .proto .env .gitignore .dockerfile .tf .hcl"
).split()
BINARY_EXTENSIONS = (".pdf", ".docx")
TEXT_MAX_BYTES = 500_000
BINARY_MAX_BYTES = 10_000_000
SKIPPED_DIRS = "node_modules .git .next dist build __pycache__ .venv venv .cache".split()

LISTING = "path string, rel string, size long"


def indexable(rel: Column, size: Column, extensions: Iterable[str] = TEXT_EXTENSIONS, excludes: Sequence[str] = ()) -> Column:
    """Whether a file is indexed, by its path below the walk's root and its size.

    The text limit holds for whatever is in ``extensions``, else the binary one
    for binary documents."""
    ext = F.lower(extension(rel))
    fits = F.when(ext.isin(*extensions), size < TEXT_MAX_BYTES).when(ext.isin(*BINARY_EXTENSIONS), size < BINARY_MAX_BYTES).otherwise(False)
    parts = F.split(rel, "/", -1)
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    skipped = F.exists(dirs, lambda d: d.isin(*SKIPPED_DIRS) | F.startswith(d, F.lit(".")))
    return fits & ~skipped & ~ignored(rel, excludes)


def _entered(name: str) -> bool:
    return name not in SKIPPED_DIRS and not name.startswith(".")


def walk(root: str, top: str | None = None, deep: bool = True) -> Iterator[tuple[str, str, int]]:
    """Path, path below ``root`` and size of each file below ``top`` (default: the root), or only of those in it unless
    ``deep``. A file is its own root. Unreadable ones are passed over.

    Directories that the rules skip aren't entered, nor are links to directories."""
    if os.path.isfile(root):
        yield root, os.path.basename(root), os.path.getsize(root)
        return
    for at, dirs, names in os.walk(top or root):
        dirs[:] = sorted(filter(_entered, dirs)) if deep else []
        for name in sorted(names):
            path = os.path.join(at, name)
            try:
                yield path, os.path.relpath(path, root), os.stat(path).st_size
            except OSError:
                continue


def collect_files(spark: SparkSession, root: str, extensions: Iterable[str] = TEXT_EXTENSIONS, excludes: Sequence[str] = ()) -> DataFrame:
    """``path, size`` of the files below a root, or of the root itself, that are indexed.

    The file reader of Spark hides names that start with ``_`` or ``.``, so
    executors walk the folders: the driver names only those directly below the
    root, and each is a task's (on a file system that all of them mount)."""
    root = os.path.abspath(root)
    try:
        below = sorted(e.path for e in os.scandir(root) if e.is_dir(follow_symlinks=False) and _entered(e.name))
    except OSError:  # a file, or nothing
        below = []
    tops = [(root, False), *((path, True) for path in below)]

    def listed(batches):
        for b in batches:
            for top, deep in zip(b.column("top").to_pylist(), b.column("deep").to_pylist(), strict=True):
                found = walk(root, top, deep)
                while rows := list(islice(found, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["path", "rel", "size"])

    parts = min(len(tops), 4 * spark.sparkContext.defaultParallelism)
    listing = spark.createDataFrame(tops, "top string, deep boolean").repartition(parts).mapInArrow(listed, LISTING)
    return listing.where(indexable(F.col("rel"), F.col("size"), list(extensions), excludes)).select("path", "size")


def collect_tracked(spark: SparkSession, roots: Sequence[str], extensions: Iterable[str] = TEXT_EXTENSIONS, excludes: Sequence[str] = ()) -> DataFrame:
    """Files of all roots that exist, each once."""
    parts = [collect_files(spark, r, extensions, excludes) for r in roots if os.path.exists(r)]
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], "path string, size long")).dropDuplicates(["path"])
