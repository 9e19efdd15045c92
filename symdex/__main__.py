"""python -m symdex COMMAND FACTS [ROOT or OUT]: build and inspect a folder of fact tables.

index: scan ROOT and write its facts, with the class hierarchy and the trigram index; with --core also the signatures of
the language's own classes, so that types and checks know them from the first question on. stats, kinds, summary, health: counts; dump-symbols: JSON lines; lint: findings;
check: rows that refer to nothing; reset: delete the folder. With OUT a command's rows are written there as JSON by the
executors; without it they are printed one by one.
"""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    flags, args = {a for a in args if a.startswith("--")}, [a for a in args if not a.startswith("--")]
    if flags - {"--core"} or len(args) < 2 or (args[0] == "index" and len(args) < 3):
        print(__doc__)
        return 2
    from pyspark.sql import SparkSession

    from symdex.facts import Facts
    from symdex.operators import health, hierarchy, lint, trigrams
    from symdex.sources import core_types, extract, scan

    command, path = args[:2]
    spark = SparkSession.builder.appName("symdex").getOrCreate()
    if command == "index":
        f = extract.extract(scan.scan(spark, args[2]))
        f = core_types.with_core_types(f) if "--core" in flags else f
        hierarchy.reach(f)
        trigrams.index(f)
        lint.with_diagnostics(f).save(path)
        return 0
    if command == "reset":
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        return 0
    show = {"stats": health.stats, "kinds": health.kind_histogram, "summary": health.workspace_summary, "health": health.workspace_health, "dump-symbols": health.dump_symbols, "lint": lambda f: f.diagnostics, "check": health.check}
    if command not in show:
        print(__doc__)
        return 2
    out = show[command](Facts.load(spark, path))
    if len(args) > 2:  # written by the executors, one file a partition
        (out.write.mode("overwrite").text(args[2]) if command == "dump-symbols" else out.write.mode("overwrite").json(args[2]))
        return 0
    rows = 0
    for line in (out.toLocalIterator() if command == "dump-symbols" else out.toJSON().toLocalIterator()):
        print(line[0] if command == "dump-symbols" else line)
        rows += 1
    return int(command == "check" and rows > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
