"""python -m loghelm version | check-config PATH | stats PATH"""

from __future__ import annotations

import json
import sys

from loghelm.config import load
from loghelm.schema import RefusedError

VERSION = "0.1.0"


def main(args: list[str]) -> int:
    try:
        if args == ["version"]:
            print(json.dumps({"version": VERSION}))
        elif len(args) == 2 and args[0] == "check-config":
            load(args[1])
            print(json.dumps({"configuration": "valid"}))
        elif len(args) == 2 and args[0] == "stats":
            from pyspark.sql import SparkSession

            from loghelm.store.snapshots import Snapshots

            spark = SparkSession.builder.getOrCreate()
            print(json.dumps(Snapshots(spark, load(args[1]).storage["path"]).metadata(), sort_keys=True))
        else:
            print(__doc__, file=sys.stderr)
            return 2
    except RefusedError as x:
        print(f"loghelm: {x}", file=sys.stderr)
        return 2
    except OSError:
        print("loghelm: cannot read configuration", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
