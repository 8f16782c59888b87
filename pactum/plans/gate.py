"""The gate of a build: key checks over linked tables, with an exit code.

    python -m pactum.plans.gate dataset.json directory

reads every table of the data set from ``directory/<table>.parquet``, prints the checks, and exits with 0, or with 3 if a
primary or foreign key check failed.  A cardinality that is off only shows.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from pactum.contract import Contract, Dataset, Relationship
from pactum.operators import relational
from pactum.sources import tables as io

FAILED = 3


def dataset_from_dict(spec: dict) -> Dataset:
    """A data set from ``tables`` (contracts by name), ``relationships`` and ``root``."""
    tables = {name: Contract.from_dict(c) for name, c in spec["tables"].items()}
    return Dataset(tables, spec.get("root") or next(iter(tables)), tuple(Relationship(**r) for r in spec.get("relationships", ())))


def run(spark: SparkSession, dataset: Dataset, directory: str) -> int:
    """Print a line for each check; the exit code."""
    tables = {name: io.read_table(spark, f"{directory.rstrip('/')}/{name}.parquet") for name in dataset.tables}
    _, report = relational.validate_relationships(tables, dataset, repair=False)
    rows = report.collect()
    for r in rows:
        print(f"{'ok  ' if r['passed'] else 'FAIL' if r['check'] != 'cardinality' else 'warn'} {r['check']} {r['subject']}: {r['detail']}")
    return FAILED if any(not r["passed"] and r["check"] != "cardinality" for r in rows) else 0


def main(arguments: list[str]) -> int:
    if len(arguments) != 2:
        print(__doc__)
        return 2
    with open(arguments[0], encoding="utf-8") as f:
        dataset = dataset_from_dict(json.load(f))
    return run(SparkSession.builder.getOrCreate(), dataset, arguments[1])


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
