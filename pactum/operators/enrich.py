"""Enrichment: event times and velocity, derived features, labelled fraud scenarios, controlled noise."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactum.functions.quantiles import exact_quantiles
from pactum.functions.ranks import drawn, exactly, uniform, with_previous
from pactum.operators.stats import numeric_columns
from pactum.sources.work import materialised

#: Our share of events by hour of the day: quiet nights, a busy noon and evening.
HOUR_WEIGHTS = (2, 1, 1, 1, 1, 2, 4, 7, 9, 10, 11, 12, 13, 12, 11, 10, 10, 11, 13, 14, 12, 9, 6, 4)
HIGH_VELOCITY_S, FIRST_GAP_S = 3600, 86400.0


def _by_weight(u: Column, weights: tuple[float, ...]) -> Column:
    """The index that a uniform draw falls on, by cumulative weight."""
    total, run, out = float(sum(weights)), 0.0, F.lit(len(weights) - 1)
    edges = []
    for w in weights[:-1]:
        run += w
        edges.append(run / total)
    for k in range(len(edges) - 1, -1, -1):
        out = F.when(u < edges[k], F.lit(k)).otherwise(out)
    return out.cast("int")


def with_event_times(df: DataFrame, key: str, start: str, end: str, time_column: str = "event_time", entity_column: str | None = None, seed: int = 42) -> DataFrame:
    """A random time for every row: a uniform date in [start, end], an hour by circadian weight, uniform minute and second.

    Without an entity column, ids are drawn from max(10, rows / 8) entities.  ``key`` must identify rows.
    """
    days = f"datediff(date'{end}', date'{start}') + 1"
    at = F.floor(drawn(seed, "day", key) * F.expr(days)).cast("int")
    day = F.date_add(F.lit(start).cast("date"), at)
    hour = _by_weight(drawn(seed, "hour", key), HOUR_WEIGHTS)
    second = F.floor(drawn(seed, "second", key) * 3600).cast("int")
    out = df.withColumn(time_column, day.cast("timestamp_ntz") + F.make_dt_interval(hours=hour, secs=second.cast("decimal(18,6)")))
    if entity_column is None:
        many = max(10, df.count() // 8)
        out = out.withColumn("entity_id", (F.floor(uniform(seed, "entity", key) * many) + 1).cast("long"))
    return out


def _seconds(col: Column) -> Column:
    """Microsecond-exact seconds since the epoch of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col) / F.lit(1e6)


def with_velocity(df: DataFrame, entity: str, time_column: str, key: str) -> DataFrame:
    """Seconds since the entity's previous event (86 400 for its first, one decimal), and whether that is under an hour.

    An entity's events are dealt over as many tasks as they fill (``ranks.with_previous``).
    """
    placed = with_previous(df, entity, [time_column, key], time_column, "__previous")
    gap = _seconds(F.col(time_column)) - _seconds(F.col("__previous"))
    out = placed.withColumn("seconds_since_last", F.round(F.greatest(F.coalesce(gap, F.lit(FIRST_GAP_S)), F.lit(0.0)), 1)).drop("__previous")
    return out.withColumn("is_high_velocity", F.col("seconds_since_last") < HIGH_VELOCITY_S)


def with_bursts(df: DataFrame, entity: str, time_column: str, key: str, share: float = 0.02, label: str | None = "is_fraud", seed: int = 42) -> DataFrame:
    """Exactly round(rows * share) events moved to 4 to 25 seconds after the entity's previous event, and flagged.

    Only events that have a previous one are moved (fewer, if there are not enough); the label, where the
    table has it, is set.  Gaps should be computed afterwards.  No entity is held by one task.
    """
    placed = materialised(with_previous(df, entity, [time_column, key], time_column, "__previous"), "placed")
    n = round(placed.count() * share)
    chosen = exactly(placed, n, seed, "burst", key, F.col("__previous").isNotNull())
    moved = F.col("__previous") + F.make_dt_interval(secs=(4 + F.floor(drawn(seed, "burst gap", key) * 22)).cast("decimal(18,6)"))
    out = placed.withColumn("is_burst", chosen).withColumn(time_column, F.when(F.col("is_burst"), moved).otherwise(F.col(time_column)))
    if label and label in df.columns:
        kind = df.schema[label].dataType
        out = out.withColumn(label, F.when(F.col("is_burst"), F.lit(1).cast(kind)).otherwise(F.col(label)))
    return out.drop("__previous")


def time_summary(df: DataFrame, entity: str, time_column: str) -> DataFrame:
    """(rows, entities, first, last, bursts, median_gap)."""
    bursts = F.count_if(F.col("is_burst")) if "is_burst" in df.columns else F.lit(0)
    middle = exact_quantiles(df, {"gap": F.col("seconds_since_last")}, [0.5]) if "seconds_since_last" in df.columns else {}
    gap = F.lit(middle.get("gap", [None])[0]).cast("double")
    return df.agg(F.count("*").alias("rows"), F.count_distinct(entity).alias("entities"), F.min(time_column).alias("first"), F.max(time_column).alias("last"), bursts.alias("bursts"), gap.alias("median_gap"))


def chronological(df: DataFrame, time_column: str, *ties: str) -> DataFrame:
    """The table in time order, by a range-partitioned sort."""
    return df.orderBy(time_column, *ties)


def out_of_order(df: DataFrame, time_column: str, *ties: str) -> int:
    """How many rows come before the row that stands ahead of them, in the order in which the table's rows are read.

    Each task looks at its own rows; the first and last row of each, one row a task, are compared on the driver.
    """
    at = [*(time_column, *ties)]
    placed = materialised(df.select(F.struct(*[F.col(f"`{c}`") for c in at]).alias("o")).select("o", F.monotonically_increasing_id().alias("__at")), "order")
    part = F.shiftright("__at", 33)
    ahead = placed.select((F.col("__at") + 1).alias("__at"), F.col("o").alias("before"))
    inside = placed.join(ahead, "__at").where("o < before").count()
    ends = placed.groupBy(part.alias("p")).agg(F.min_by("o", "__at").alias("first"), F.max_by("o", "__at").alias("last"))
    ends = ends.withColumn("before", F.lag("last").over(Window.orderBy("p")))
    return inside + ends.where("first < before").count()


#: Column names that features are derived from, the first that the table has.
AMOUNT_NAMES = ("transaction_amount", "amount", "order_amount", "total_amount", "purchase_amount", "claim_amount")
INCOME_NAMES = ("customer_income", "annual_income", "income", "salary")
LIMIT_NAMES = ("credit_limit", "credit_limit_usd", "card_limit", "limit")
AGE_NAMES = ("customer_age", "age", "age_years")
SCORE_NAMES = ("credit_score", "fico_score", "score")
TIME_NAMES = ("transaction_timestamp", "event_time", "timestamp", "transaction_time", "created_at")
ATTEMPT_NAMES = ("failed_attempts", "login_attempts", "attempts")


def _named(df: DataFrame, names: tuple[str, ...], given: str | None = None) -> str | None:
    return given if given in df.columns else next((n for n in names if n in df.columns), None)


def with_ratios(df: DataFrame, amount: str | None = None, income: str | None = None, limit: str | None = None) -> DataFrame:
    """E5: amount over monthly income and over the limit, 4 decimals; 0 for a zero or missing denominator."""
    amount = _named(df, AMOUNT_NAMES, amount)
    for what, divisor, name in ((_named(df, INCOME_NAMES, income), 12, "amount_to_income_ratio"), (_named(df, LIMIT_NAMES, limit), 1, "amount_to_limit_ratio")):
        if amount and what:
            ratio = F.try_divide(F.col(amount).cast("double"), F.col(what).cast("double") / divisor)
            df = df.withColumn(name, F.round(F.coalesce(ratio, F.lit(0.0)), 4))
    return df


def with_bands(df: DataFrame, age: str | None = None, score: str | None = None) -> DataFrame:
    """Age groups and credit ratings; UNKNOWN for null."""
    for what, cuts, labels, name in (
        (_named(df, AGE_NAMES, age), (30, 50, 65), ("YOUNG", "ADULT", "MIDDLE_AGE", "SENIOR"), "age_group"),
        (_named(df, SCORE_NAMES, score), (580, 670, 740, 800), ("POOR", "FAIR", "GOOD", "VERY_GOOD", "EXCELLENT"), "credit_rating"),
    ):
        if what:
            band = F.when(F.col(what).isNull(), "UNKNOWN")
            for cut, label in zip(cuts, labels, strict=False):
                band = band.when(F.col(what) < cut, label)
            df = df.withColumn(name, band.otherwise(labels[-1]))
    return df


def with_time_parts(df: DataFrame, time_column: str | None = None) -> DataFrame:
    """Hour (-1 if unknown), day name ("Unknown"), weekend and night (0-5) flags."""
    name = _named(df, TIME_NAMES, time_column)
    if name is None:
        return df
    t = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        t = F.try_to_timestamp(t)
    hour = F.coalesce(F.hour(t), F.lit(-1))
    return df.withColumns({
        "hour_of_day": hour,
        "day_name": F.coalesce(F.date_format(t, "EEEE"), F.lit("Unknown")),
        "is_weekend": F.coalesce(F.weekday(t) >= 5, F.lit(False)),
        "is_night": hour.between(0, 5),
    })


def with_risk_flag(df: DataFrame, attempts: str | None = None, amount: str | None = None) -> DataFrame:
    """Two or more failed attempts and an amount above twice the median."""
    attempts, amount = _named(df, ATTEMPT_NAMES, attempts), _named(df, AMOUNT_NAMES, amount)
    if not attempts or not amount:
        return df
    middle = exact_quantiles(df, {"amount": F.col(amount)}, [0.5]).get("amount", [None])[0]
    flag = (F.col(attempts) >= 2) & (F.col(amount) > 2 * F.lit(middle).cast("double"))
    return df.withColumn("high_risk_combo", F.coalesce(flag, F.lit(False)))


def with_features(df: DataFrame) -> DataFrame:
    """E5-E8, on the columns that the table has."""
    return with_risk_flag(with_time_parts(with_bands(with_ratios(df))))


def inject_fraud(df: DataFrame, key: str, rate: float, target: str = "is_fraud", seed: int = 42, amount: str | None = None) -> DataFrame:
    """Exactly round(rows * rate) rows labelled and given the marks of fraud, on the columns that the table has.

    The amount becomes mean + U(4.5, 9) * std, or mean * U(5, 20) if all amounts are equal; distance columns
    U(2500, 9500), attempts 4 to 14, hour 2 to 5, and risk flags true.  The target column is added if absent.
    """
    n = round(df.count() * rate)
    out = df if target in df.columns else df.withColumn(target, F.lit(0))
    chosen = exactly(out, n, seed, "fraud", key)
    out = out.withColumn("__hit", chosen)
    hit = F.col("__hit")
    changes: dict[str, Column] = {target: F.when(hit, F.lit(1).cast(out.schema[target].dataType)).otherwise(F.col(target))}

    def put(name: str, value: Column) -> None:
        changes[name] = F.when(hit, value.cast(df.schema[name].dataType)).otherwise(F.col(name))

    amount = amount or next((c for c in numeric_columns(df) if c != target and ("amount" in c.lower() or "price" in c.lower())), None)
    if amount:
        mean, std = df.agg(F.avg(amount), F.stddev_samp(amount)).first()
        u = drawn(seed, "fraud amount", key)
        if mean is not None:
            put(amount, F.round(F.lit(mean) + (4.5 + 4.5 * u) * F.lit(std), 2) if std else F.round(F.lit(mean) * (5 + 15 * u), 2))
    for f in df.schema.fields:
        low = f.name.lower()
        if f.name in (amount, target, key):
            continue
        u = uniform(seed, f"fraud {f.name}", key)
        if isinstance(f.dataType, T.NumericType):
            if "distance" in low:
                put(f.name, F.round(2500 + 7000 * u, 2))
            elif "attempt" in low:
                put(f.name, 4 + F.floor(u * 11))
            elif low in ("hour", "hour_of_day", "transaction_hour"):
                put(f.name, 2 + F.floor(u * 4))
        elif isinstance(f.dataType, T.BooleanType) and any(w in low for w in ("international", "foreign", "vpn", "proxy", "new_device", "risk")):
            put(f.name, F.lit(True))
    return out.withColumns(changes).drop("__hit")


#: The rows of a QWERTY keyboard and how far each is shifted; keys less than 1.3 key widths apart are neighbours.
_ROWS = (("qwertyuiop", 0.0), ("asdfghjkl", 0.25), ("zxcvbnm", 0.75))
_PLACES = {c: (k + shift, float(y)) for y, (row, shift) in enumerate(_ROWS) for k, c in enumerate(row)}
NEIGHBOURS = {c: "".join(o for o, q in _PLACES.items() if o != c and math.dist(p, q) < 1.3) for c, p in _PLACES.items()}
#: Impossible values of columns whose names have one of the words; other columns take factors.
SPIKES = ((("age", "yas"), (999.0, -1.0, 150.0, 0.0)), (("price", "amount", "tutar"), (-99.0, 999999.0, 0.0001)), (("score", "oran", "ratio"), (-1.0, 99.9, 1000.0)))
SPIKE_FACTORS = (100.0, -10.0, 0.0)


def _pick(options: list[Column], u: Column) -> Column:
    """The option that a uniform draw falls on."""
    return F.element_at(F.array(*options), (F.floor(u * len(options)) + 1).cast("int"))


def _typo(text: Column, u: Column, v: Column, w: Column) -> Column:
    """Swap, delete, repeat or replace (by a neighbouring key, in its case) the character at a random place."""
    n = F.length(text)
    at = (F.floor(u * (n - 1)) + 1).cast("int")
    head, one, two, tail = F.substring(text, F.lit(1), at - 1), F.substring(text, at, F.lit(1)), F.substring(text, at + 1, F.lit(1)), F.substring(text, at + 2, n)
    near = F.try_element_at(F.create_map(*[F.lit(x) for pair in NEIGHBOURS.items() for x in pair]), F.lower(one))
    key = F.substring(near, (F.floor(w * F.length(near)) + 1).cast("int"), F.lit(1))
    key = F.coalesce(F.when(one != F.lower(one), F.upper(key)).otherwise(key), one)
    edited = F.when(v < 0.25, F.concat(head, two, one, tail)).when(v < 0.5, F.concat(head, two, tail)).when(v < 0.75, F.concat(head, one, one, two, tail)).otherwise(F.concat(head, key, two, tail))
    return F.when(n >= 3, edited).otherwise(text)


def spike(name: str, value: Column, u: Column) -> Column:
    """An impossible value for a column of that name: one of the fixed ones, or the value times a factor."""
    fixed = next((values for words, values in SPIKES if any(w in name.lower() for w in words)), None)
    options = [F.lit(x) for x in fixed] if fixed else [F.round(value.cast("double") * x, 2) for x in SPIKE_FACTORS]
    return _pick(options, u)


def with_noise(df: DataFrame, key: str, rate: float = 0.05, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """Exactly round(rows * rate) rows corrupted, with ``is_corrupted`` and ``corruption_details``.

    A corrupted row has one or more of: a missing value, a typo, an outlier (by the column's name, else times
    100, -10 or 0), or changed case or white space; one that would get none gets a null.  ``key`` and ``keep`` are left alone.
    """
    n = round(df.count() * rate)
    usable = [f for f in df.schema.fields if f.name not in (key, *keep)]
    strings = [f.name for f in usable if isinstance(f.dataType, T.StringType)]
    numbers = [f.name for f in usable if isinstance(f.dataType, T.NumericType)]
    out = df.withColumn("is_corrupted", exactly(df, n, seed, "noise", key))
    hit = F.col("is_corrupted")
    names = [f.name for f in usable]
    plans: list[tuple[str, Column, Column, Column]] = []

    def spot(columns: list[str], what: str) -> Column:
        return F.floor(uniform(seed, f"{what} column", key) * len(columns))

    for k, c in enumerate(strings):
        old = F.col(f"`{c}`")
        u, v, w = (uniform(seed, f"{what} {c}", key) for what in ("typo", "typo kind", "typo key"))
        new = _typo(old, u, v, w)
        plans.append((c, (uniform(seed, "typo", key) < 0.4) & (spot(strings, "typo") == k) & old.isNotNull() & (new != old), new, F.lit(f"typo:{c}")))
        cased = F.when(v < 0.34, F.upper(old)).when(v < 0.67, F.lower(old)).otherwise(F.concat(F.lit("  "), old, F.lit(" ")))
        plans.append((c, (uniform(seed, "case", key) < 0.3) & (spot(strings, "case") == k) & old.isNotNull() & (cased != old), cased, F.lit(f"format:{c}")))
    for k, c in enumerate(numbers):
        old = F.col(f"`{c}`")
        kind = df.schema[c].dataType
        odd = spike(c, old, uniform(seed, f"spike {c}", key))
        # What the column's type cannot hold becomes null there, and is left out.
        odd = F.lit(None).cast(kind) if kind == T.BooleanType() else odd.try_cast(kind)
        plans.append((c, (uniform(seed, "spike", key) < 0.4) & (spot(numbers, "spike") == k) & old.isNotNull() & (odd != old), odd, F.lit(f"outlier:{c}")))
    for k, c in enumerate(names):
        # A value that is changed in another way is not missing as well.
        changed = F.lit(False)
        for other, test, _, _ in plans:
            changed = changed | F.coalesce(test, F.lit(False)) if other == c else changed
        plans.append((c, (uniform(seed, "missing", key) < 0.35) & (spot(names, "missing") == k) & F.col(f"`{c}`").isNotNull() & ~changed, F.lit(None).cast(df.schema[c].dataType), F.lit(f"missing:{c}")))
    tests = [F.coalesce(t, F.lit(False)) for _, t, _, _ in plans]
    out = out.withColumn("__done", F.array_compact(F.array(*[F.when(hit & t, label) for t, (_, _, _, label) in zip(tests, plans, strict=True)])))
    fallback = hit & (F.size("__done") == 0)
    changes: dict[str, Column] = {}
    for c in names:
        value = F.col(f"`{c}`")
        for name, _, new, label in plans:
            if name == c:
                value = F.when(F.array_contains("__done", label), new).otherwise(value)
        if c == names[0]:
            value = F.when(fallback, F.lit(None).cast(df.schema[c].dataType)).otherwise(value)
        changes[c] = value
    detail = F.when(fallback, F.lit(f"missing:{names[0]}")).otherwise(F.array_join("__done", ";"))
    changes["corruption_details"] = F.when(hit, detail).otherwise(F.lit(""))
    return out.withColumns(changes).drop("__done")


def noise_breakdown(df: DataFrame) -> DataFrame:
    """(kind, count) over the details of corrupted rows."""
    each = df.where("is_corrupted").select(F.explode(F.split("corruption_details", ";")).alias("d"))
    return each.groupBy(F.split("d", ":")[0].alias("kind")).agg(F.count("*").alias("count"))
