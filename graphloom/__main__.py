"""python -m graphloom types.json: the Spark DDL of the data of each type document in a JSON list."""

from __future__ import annotations

import json
import sys

from .sources.types import TypeRegistry


def main(paths: list[str]) -> None:
    for path in paths:
        with open(path) as f:
            registry = TypeRegistry(json.load(f))
        for kind in registry.schemas:
            print(f"{kind}: {registry.data_type(kind).simpleString()}")


if __name__ == "__main__":
    main(sys.argv[1:])
