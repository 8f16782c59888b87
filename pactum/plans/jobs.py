"""The composed jobs: validate tables, build and publish linked tables, make a labelled benchmark."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactum.contract import Column, Contract, Dataset
from pactum.operators import clean, enrich, generate, prepare, privacy, relational
from pactum.sources import tables as io
from pactum.sources.work import materialised


def contract_like(df: DataFrame, primary_key: str | None = None, max_categories: int = 20, rows: int | None = None, seed: int = 42) -> Contract:
    """A contract with the columns, bounds, means and categories that a table has, in one pass over it.

    Text columns with more than ``max_categories`` values are plain text; nested columns are left out.
    """
    fields = [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    aggs = [F.count("*").alias("n")]
    for k, f in enumerate(fields):
        col = F.col(f"`{f.name}`")
        aggs.append(F.count_if(col.isNull()).alias(f"null{k}"))
        if isinstance(f.dataType, T.NumericType):
            aggs += [g(col.cast("double")).alias(f"{w}{k}") for g, w in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"), (F.stddev_samp, "std"))]
        elif isinstance(f.dataType, T.BooleanType):
            aggs.append(F.avg(col.cast("int")).alias(f"share{k}"))
        elif isinstance(f.dataType, T.StringType):
            aggs.append(F.approx_count_distinct(col).alias(f"many{k}"))
        else:
            aggs += [F.min(col).cast("string").alias(f"min{k}"), F.max(col).cast("string").alias(f"max{k}")]
    got = df.agg(*aggs).first()
    few = [f.name for k, f in enumerate(fields) if isinstance(f.dataType, T.StringType) and got[f"many{k}"] <= max_categories]
    sets = df.agg(*[F.sort_array(F.collect_set(f"`{c}`")).alias(c) for c in few]).first() if few else {}
    columns = []
    for k, f in enumerate(fields):
        nullable = bool(got[f"null{k}"])
        if isinstance(f.dataType, T.NumericType):
            kind = "int" if isinstance(f.dataType, T.IntegralType) else "float"
            columns.append(Column(f.name, kind, got[f"min{k}"], got[f"max{k}"], "uniform", got[f"mean{k}"], got[f"std{k}"], nullable=nullable))
        elif isinstance(f.dataType, T.BooleanType):
            columns.append(Column(f.name, "bool", target_ratio=got[f"share{k}"], nullable=nullable))
        elif f.name in few and sets[f.name]:
            columns.append(Column(f.name, "category", categories=tuple(sets[f.name]), nullable=nullable))
        elif isinstance(f.dataType, T.StringType):
            columns.append(Column(f.name, "str", nullable=nullable))
        else:
            columns.append(Column(f.name, "datetime", nullable=nullable, description=f"from {str(got[f'min{k}'])[:10]} to {str(got[f'max{k}'])[:10]}"))
    return Contract(tuple(columns), got["n"] if rows is None else rows, seed, primary_key=primary_key)


@dataclass
class Published:
    """The outcome of :func:`build_dataset`."""

    tables: dict[str, DataFrame]
    stages: dict[str, DataFrame]
    integrity: DataFrame
    manifest: DataFrame
    paths: dict[str, dict[str, str]] = field(default_factory=dict)


def validate_dataset(tables: dict[str, DataFrame], dataset: Dataset, must_pass: bool = False) -> Published:
    """Every table is validated, parents first, and only then are keys repaired and checked.

    The other order would leave child rows of parents that validation removes.
    """
    before = {name: df.count() for name, df in tables.items()}
    runs = {name: clean.validate(tables[name], dataset.tables[name]) for name in dataset.order()}
    done, report = relational.validate_relationships({n: v.rows for n, v in runs.items()}, dataset, repair=True, must_pass=must_pass)
    return Published(done, {n: v.stages for n, v in runs.items()}, report, io.manifest(done, dataset, before))


def build_dataset(spark: SparkSession, dataset: Dataset, rows: int, directory: str | None = None, formats: tuple[str, ...] = ("parquet",)) -> Published:
    """Generate linked tables, clean them, repair and check keys, and write them with their manifest."""
    made = {name: materialised(df, name) for name, df in generate.generate_dataset(spark, dataset, rows).items()}
    out = validate_dataset(made, dataset)
    if directory is not None:
        out.paths = {name: io.write_table(df, directory, name, formats) for name, df in out.tables.items()}
        io.write_table(out.manifest, directory, "manifest", ("json",))
    return out


@dataclass(frozen=True)
class Step:
    """A step of a pipeline: what it does, and to which tables (all, if none are named)."""

    name: str
    apply: Callable[[DataFrame], DataFrame]
    tables: tuple[str, ...] = ()


def run_steps(tables: dict[str, DataFrame], enrich_steps: list[Step], dataset: Dataset, noise_steps: list[Step]) -> Published:
    """Enrichment before validation, noise after it, each step on its own tables."""

    def applied(current: dict[str, DataFrame], steps: list[Step]) -> dict[str, DataFrame]:
        out = dict(current)
        for step in steps:
            for name in step.tables or tuple(out):
                out[name] = step.apply(out[name])
        return out

    done = validate_dataset(applied(tables, enrich_steps), dataset)
    done.tables = applied(done.tables, noise_steps)
    return done


def fraud_benchmark(df: DataFrame, contract: Contract, key: str, entity: str, time_column: str, fraud_rate: float = 0.02, noise_rate: float = 0.05, seed: int = 42, reference: DataFrame | None = None) -> dict[str, DataFrame]:
    """Labelled fraud, bursts, velocity and features, validation that keeps labelled rows, audit, noise and a split."""
    labelled = enrich.inject_fraud(df, key, fraud_rate, "is_fraud", seed)
    timed = enrich.with_velocity(enrich.with_bursts(labelled, entity, time_column, key, seed=seed), entity, time_column, key)
    featured = enrich.with_time_parts(timed, time_column)
    run = clean.validate(featured, contract)
    noisy = enrich.with_noise(run.rows, key, noise_rate, seed, keep=(entity, time_column, "is_fraud", "is_burst"))
    out = {"rows": prepare.random_split(noisy, key, 0.2, seed), "stages": run.stages, "rules": run.rules}
    if reference is not None:
        out["privacy"] = privacy.privacy_risk(run.rows, reference)
    return out
