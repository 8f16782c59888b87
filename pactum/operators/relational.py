"""Keys across tables: checks, cascading repair and cardinality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from pactum.contract import Dataset, Relationship
from pactum.sources.work import materialised

_PK = "table string, column string, rows long, duplicates long, nulls long, passed boolean, reason string"
_FK = "relationship string, rows long, orphans long, orphan_pct double, passed boolean, reason string"
_CARD = "relationship string, parents long, children long, mean_children double, max_children long, min_children long, passed boolean, reason string"


class IntegrityError(RuntimeError):
    """A primary or foreign key check failed."""


def check_primary_keys(tables: dict[str, DataFrame], dataset: Dataset) -> DataFrame:
    """Duplicates (rows beyond the first of each value, nulls being equal) and nulls of every primary key."""
    rows = []
    for name, contract in dataset.tables.items():
        key = contract.primary_key
        if key is None:
            continue
        if name not in tables or key not in tables[name].columns:
            rows.append((name, key, None, None, None, False, "missing table or column"))
            continue
        counts = tables[name].groupBy(F.col(f"`{key}`").alias("k")).agg(F.count("*").alias("c"))
        got = counts.agg(F.sum("c").alias("n"), F.sum(F.col("c") - 1).alias("d"), F.sum(F.when(F.col("k").isNull(), F.col("c")).otherwise(0)).alias("z")).first()
        n, d, z = (got[x] or 0 for x in "ndz")
        rows.append((name, key, n, d, z, d == 0 and z == 0, ""))
    return _frame(tables, rows, _PK)


def _frame(tables: dict[str, DataFrame], rows: list[tuple], schema: str) -> DataFrame:
    return next(iter(tables.values())).sparkSession.createDataFrame(rows, schema)


def _keys(table: DataFrame, key: str) -> DataFrame:
    return table.select(F.col(f"`{key}`").alias("__key")).where("__key IS NOT NULL").distinct()


def _missing(r: Relationship, tables: dict[str, DataFrame]) -> bool:
    return r.parent not in tables or r.child not in tables or r.parent_key not in tables[r.parent].columns or r.child_key not in tables[r.child].columns


def orphans(child: DataFrame, parent: DataFrame, r: Relationship) -> DataFrame:
    """The child rows whose key is in no parent row; null keys are among them unless the key is nullable.

    Null keys are set apart before the join: they match nothing and would meet in one task.
    """
    key = F.col(f"`{r.child_key}`")
    lost = child.where(key.isNotNull()).join(_keys(parent, r.parent_key), key == F.col("__key"), "left_anti")
    return lost if r.nullable else lost.unionByName(child.where(key.isNull()))


def with_parent(child: DataFrame, parent: DataFrame, r: Relationship) -> DataFrame:
    """The child rows whose key is in a parent row, and those with a null key if the key is nullable."""
    key = F.col(f"`{r.child_key}`")
    kept = child.where(key.isNotNull()).join(_keys(parent, r.parent_key), key == F.col("__key"), "left_semi")
    return kept.unionByName(child.where(key.isNull())) if r.nullable else kept


def relationship_counts(tables: dict[str, DataFrame], dataset: Dataset) -> dict[str, Row]:
    """For each relationship (rows, orphans, parents, children, max, min): one join of counted keys.

    Rows are counted by key before they meet, so that a hot key is one row; null keys stay out of the join.
    """
    out = {}
    for r in dataset.relationships:
        if _missing(r, tables):
            continue
        key = F.col(f"`{r.child_key}`")
        parents = _keys(tables[r.parent], r.parent_key).withColumn("__here", F.lit(True))
        counts = tables[r.child].groupBy(key.alias("__key")).agg(F.count("*").alias("c"))
        joined = counts.where("__key IS NOT NULL").join(parents, "__key", "full_outer")
        lost = F.sum(F.when(F.col("__here").isNull(), F.col("c")))
        known = joined.agg(F.sum("c").alias("children"), lost.alias("lost"), F.count("__here").alias("parents"), F.max("c").alias("max"), F.min("c").alias("min"))
        null = counts.agg(F.sum(F.when(F.col("__key").isNull(), F.col("c"))).alias("null"))
        zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("children", "lost", "parents", "max", "min", "null")}
        got = known.join(F.broadcast(null)).select(*zero.values())
        orphans = F.col("lost") if r.nullable else F.col("lost") + F.col("null")
        out[r.name] = got.select((F.col("children") + F.col("null")).alias("rows"), orphans.alias("orphans"), "parents", "children", "max", "min").first()
    return out


def check_foreign_keys(tables: dict[str, DataFrame], dataset: Dataset, counts: dict[str, Row] | None = None) -> DataFrame:
    """Orphan rows and their percentage for every relationship."""
    counts = relationship_counts(tables, dataset) if counts is None else counts
    rows = []
    for r in dataset.relationships:
        if r.name not in counts:
            rows.append((r.name, None, None, None, False, "missing table or column"))
            continue
        n, lost = counts[r.name]["rows"], counts[r.name]["orphans"]
        rows.append((r.name, n, lost, round(100.0 * lost / n, 4) if n else 0.0, lost == 0, ""))
    return _frame(tables, rows, _FK)


def check_cardinality(tables: dict[str, DataFrame], dataset: Dataset, counts: dict[str, Row] | None = None) -> DataFrame:
    """Child rows for each distinct parent key, within half of the declared mean, and at most ``max_per_parent``.

    ``min_children`` (over keys with children) is reported, not checked.
    """
    counts = relationship_counts(tables, dataset) if counts is None else counts
    rows = []
    for r in dataset.relationships:
        if r.name not in counts:
            rows.append((r.name, None, None, None, None, None, False, "missing table or column"))
            continue
        got = counts[r.name]
        mean = got["children"] / got["parents"] if got["parents"] else 0.0
        ok = abs(mean - r.mean) <= 0.5 * r.mean and (r.max_per_parent is None or got["max"] <= r.max_per_parent)
        rows.append((r.name, got["parents"], got["children"], round(mean, 6), got["max"], got["min"], ok, "" if ok else "outside the declared cardinality"))
    return _frame(tables, rows, _CARD)


def repair_orphans(tables: dict[str, DataFrame], dataset: Dataset) -> dict[str, DataFrame]:
    """Tables, parents first, without child rows whose parent is not in the already repaired parent table."""
    out = dict(tables)
    for name in dataset.order():
        for r in (x for x in dataset.relationships if x.child == name and not _missing(x, out)):
            out[name] = with_parent(out[name], out[r.parent], r)
    return out


def repair_report(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(table, rows_before, rows_after, removed)."""
    rows = []
    for name in before:
        a, b = before[name].count(), after[name].count()
        rows.append((name, a, b, a - b))
    return _frame(before, rows, "table string, rows_before long, rows_after long, removed long")


def validate_relationships(tables: dict[str, DataFrame], dataset: Dataset, repair: bool = True, must_pass: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, report): repair if asked, then the key and cardinality checks.

    The report has a row per check: (check, subject, passed, detail).  With ``must_pass`` a failed key
    check raises :class:`IntegrityError`; a cardinality that is off never does.
    """
    done = {k: materialised(v, k) for k, v in repair_orphans(tables, dataset).items()} if repair else tables
    pk = check_primary_keys(done, dataset).select(F.lit("primary key").alias("check"), F.concat_ws(".", "table", "column").alias("subject"), "passed", F.format_string("%d duplicates, %d nulls", F.coalesce("duplicates", F.lit(0)), F.coalesce("nulls", F.lit(0))).alias("detail"))
    counts = relationship_counts(done, dataset)
    fk = check_foreign_keys(done, dataset, counts).select(F.lit("foreign key").alias("check"), F.col("relationship").alias("subject"), "passed", F.format_string("%d orphans", F.coalesce("orphans", F.lit(0))).alias("detail"))
    card = check_cardinality(done, dataset, counts).select(F.lit("cardinality").alias("check"), F.col("relationship").alias("subject"), "passed", F.format_string("%.4f children", F.coalesce("mean_children", F.lit(0.0))).alias("detail"))
    report = pk.unionByName(fk).unionByName(card)
    if must_pass:
        bad = [r["subject"] for r in pk.unionByName(fk).where("NOT passed").collect()]
        if bad:
            raise IntegrityError(", ".join(bad))
    return done, report
