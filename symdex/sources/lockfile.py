"""Installed packages: what a lock file names, and the files of those packages in install folders.

No package manager is run; the caller says where packages are installed.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symdex.sources.scan import scan

_SPEC = re.compile(r"^    (\S+) \(([^)]+)\)$")
_NEEDS = re.compile(r"^      (\S+?)!?(?: \(([^)]+)\))?$")


def parse_lockfile(text: str) -> list[dict]:
    """(name, version, platform, source, remote, needs) of each locked package, in the file's order.

    `source` is the section's title in lower case (gem, git, path); versions and platforms are told apart at the first
    hyphen. Sections without packages, comments and lines of other shapes give nothing.
    """
    rows: list[dict] = []
    source, remote = "", None
    for line in text.splitlines():
        line = line.rstrip()
        if line and not line.startswith(" "):
            source, remote = line.lower(), None
        elif line.startswith("  remote: "):
            remote = line.removeprefix("  remote: ")
        elif m := _SPEC.match(line):
            if source in ("gem", "git", "path"):
                version, _, platform = m[2].partition("-")
                rows.append({"name": m[1], "version": version, "platform": platform or None, "source": source, "remote": remote, "needs": []})
        elif (m := _NEEDS.match(line)) and rows and source in ("gem", "git", "path"):
            rows[-1]["needs"].append(m[1])
    return rows


def parse_signature_lock(text: str) -> list[tuple[str, str | None]]:
    """(name, path) of the packages in a lock file of a signature collection; path is given for local sources alone."""
    out: list[tuple[str, str | None]] = []
    listed = False
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if line[0] not in " -":
            listed = line.startswith("gems:")
        elif listed and (m := re.match(r"^\s*-\s+name:\s*[\"']?([\w.-]+)", line)):
            out.append((m[1], None))
        elif listed and out and (m := re.match(r"^\s+path:\s*[\"']?([^\"']+)", line)):
            out[-1] = (out[-1][0], m[1].strip())
    return out


def scan_packages(spark: SparkSession, lock: str, folder: str, **options) -> DataFrame:
    """A scan of the locked packages' files below an install folder, in which each has a folder of its name and version.

    One listing serves all packages; a package that isn't there gives no rows.
    """
    names = {f"{r['name']}-{r['version']}" + (f"-{r['platform']}" if r["platform"] else "") for r in parse_lockfile(lock)}
    rows = scan(spark, folder, **options)
    return rows.where(F.element_at(F.split("path", "/"), 1).isin(*sorted(names)) if names else F.lit(False))
