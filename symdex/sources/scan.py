"""Source files as rows: which files count, their hash, their lines, and which of them changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File name endings, whole names and folders that a scan knows (fixed values).
EXTENSIONS = (".rb", ".erb", ".haml", ".slim", ".rbs", ".rbi", ".rake", ".gemspec", ".ru", ".jbuilder", ".builder", ".yml", ".yaml")
NAMES = ("Rakefile", "Gemfile")
SKIPPED = ("node_modules", "tmp", "log", "coverage", "public", "vendor/bundle")
#: Larger files aren't indexed, and leave the index if they were in it.
MAX_BYTES = 8 << 20


def wanted(path="path", excludes: tuple[str, ...] = (), keep: tuple[str, ...] = ()):
    """A condition on relative paths. Folders that begin with a dot are skipped; `excludes` and `keep` are globs of
    names or paths, of which `keep` wins."""
    c = F.col(path) if isinstance(path, str) else path
    name = F.element_at(F.split(c, "/"), -1)
    known = name.isin(*NAMES)
    for e in EXTENSIONS:
        known = known | name.endswith(e)
    skipped = c.rlike(r"(^|/)\.[^/]+/")
    for d in SKIPPED:
        skipped = skipped | F.contains(F.concat(F.lit("/"), c), F.lit(f"/{d}/"))
    for g in excludes:
        skipped = skipped | c.rlike(glob_pattern(g))
    kept = F.lit(False)
    for g in keep:
        kept = kept | c.rlike(glob_pattern(g))
    return known & (~skipped | kept)


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob: ** any folders, * within one; a name alone matches at any depth, and a folder what is in it."""
    rooted = glob.startswith("/")
    g = glob.strip("/")
    body = "".join(".*" if part == "**" else "[^/]*" if part == "*" else "".join("\\" + c if not c.isalnum() and c not in "_/" else c for c in part) for part in _parts(g))
    return ("^" if rooted or ("/" in g and not g.startswith("**")) else "(^|/)") + body + "(/|$)"


def _parts(g: str) -> list[str]:
    out, i = [], 0
    while i < len(g):
        star = "**" if g.startswith("**", i) else "*" if g[i] == "*" else ""
        out.append(star or g[i])
        i += len(star) or 1
    return out


#: The same names as one glob, by which files are told apart before any is opened.
NAME_GLOB = "{" + ",".join(["*" + e for e in EXTENSIONS] + list(NAMES)) + "}"


def _relative(root: str):
    """The path below the root, of a file's whole path."""
    base = root.rstrip("/").split("://")[-1]
    return F.regexp_replace("path", F.lit("^.*?" + "".join("\\" + c if not c.isalnum() and c not in "_/" else c for c in base) + "/"), F.lit(""))


def listed(spark: SparkSession, root: str, excludes: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, mtime_ms, length) of all wanted files under a folder, oversize ones too; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", NAME_GLOB).load(root)
    rows = files.select(_relative(root).alias("path"), F.unix_millis("modificationTime").alias("mtime_ms"), "length")
    return rows.where(wanted("path", excludes, keep))


def oversize(spark: SparkSession, root: str, excludes: tuple[str, ...] = (), keep: tuple[str, ...] = (), max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, length) of wanted files that a scan leaves out for their size."""
    return listed(spark, root, excludes, keep).where(F.col("length") > max_bytes).select("path", "length")


def scan(spark: SparkSession, root: str, excludes: tuple[str, ...] = (), keep: tuple[str, ...] = (), max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, mtime_ms, content_hash, text) of all wanted files under a folder. Oversize files are left out; `oversize` names them.

    Names are matched while files are listed, sizes and times by the source; folders are cut by the file's path before
    its content is made, in the scan itself.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", NAME_GLOB).load(root)
    place = F.regexp_replace(F.col("_metadata.file_path"), F.lit("^.*?" + "".join("\\" + c if not c.isalnum() and c not in "_/" else c for c in root.rstrip("/").split("://")[-1]) + "/"), F.lit(""))
    rows = files.where(F.col("length") <= max_bytes).where(wanted(place, excludes, keep)).withColumn("path", _relative(root))
    return rows.select("path", F.unix_millis("modificationTime").alias("mtime_ms"), F.xxhash64("content").alias("content_hash"), F.decode("content", "UTF-8").alias("text"))


def ignore_rules(text: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(excludes, keep) of an ignore file: globs of names and paths, those after ! are kept."""
    lines = [x.rstrip() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    return tuple(x.removeprefix("\\") for x in lines if not x.startswith("!")), tuple(x[1:] for x in lines if x.startswith("!"))


def file_rows(scanned: DataFrame, is_gem: bool = False) -> DataFrame:
    """Rows of the files table."""
    return scanned.select(F.xxhash64("path").alias("id"), "path", "mtime_ms", "content_hash", F.lit(is_gem).alias("is_gem"))


def line_rows(scanned: DataFrame) -> DataFrame:
    """Rows of the lines table."""
    return scanned.select(F.xxhash64("path").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("n", "text")).select("file_id", (F.col("n") + 1).alias("n"), "text")
