"""python -m keyloom info|compact|repair|vacuum|pack|dump|restore|unlock ROOT [PATH] [--tablespace NAME | --all]"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from keyloom.sources import dump
from keyloom.sources.files import Files
from keyloom.sources.store import Store, tablespaces


def run(spark: SparkSession, argv: list[str]) -> list[dict]:
    """One record for each tablespace worked on."""
    p = argparse.ArgumentParser(prog="keyloom", description=__doc__)
    p.add_argument("command", choices=("info", "compact", "repair", "vacuum", "pack", "dump", "restore", "unlock"))
    p.add_argument("root")
    p.add_argument("path", nargs="?")
    p.add_argument("--tablespace", default="default")
    p.add_argument("--all", action="store_true", help="every tablespace under the root")
    p.add_argument("--full", action="store_true", help="compact to one file")
    a = p.parse_args(argv)
    if a.command in ("pack", "dump", "restore") and not a.path:
        p.error(f"{a.command} needs a path")
    out = []
    for name in tablespaces(spark, a.root) if a.all else [a.tablespace]:
        path = f"{a.path}.{name}" if a.all and a.path else a.path
        mode = {"info": "readonly", "pack": "readonly", "dump": "readonly", "repair": "repair", "restore": "readwrite"}.get(a.command, "existing")
        if a.command == "unlock":  # for a writer that is known to be gone
            files = Files(spark, f"{a.root.rstrip('/')}/{name}")
            out.append({"tablespace": name, "unlocked": files.exists("LOCK")})
            files.delete("LOCK")
            continue
        with Store(spark, a.root, mode, name) as s:
            done: dict = {"tablespace": name, "generation": s.generation}
            if a.command == "info":
                done |= s.statistics().first().asDict() | {"parts": [r.asDict() for r in s.levels().collect()]}
            elif a.command == "compact":
                s.compact(full=a.full)
            elif a.command == "vacuum":
                done["removed"] = s.vacuum()
            elif a.command == "pack":
                s.pack(path)
            elif a.command == "dump":
                dump.dump(s.snapshot(), path)
            elif a.command == "restore":
                s.clear()
                done["added"], done["ignored"] = s.try_add(dump.restore(spark, path))
            out.append(done)
    return out


def main() -> None:
    import sys

    for record in run(SparkSession.builder.appName("keyloom").getOrCreate(), sys.argv[1:]):
        print(json.dumps(record))


if __name__ == "__main__":
    main()
