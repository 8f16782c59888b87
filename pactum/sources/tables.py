"""Sources and sinks: tables in files, reference samples, text of pages, manifests and fingerprints."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactum.contract import Contract, Dataset
from pactum.functions import markup

FORMATS = ("parquet", "csv", "json")
#: Elements whose content is not text.
SILENT = ("script", "style", "noscript", "svg", "nav", "footer", "header")
#: Elements whose tags break lines.
BLOCKS = ("p", "div", "br", "li", "ul", "ol", r"h[1-6]", "tr", "table", "section", "article", "title", "body", "html", "head")
LEAST_LINE = 20


#: What stands for a missing value while CSV is read; a field without quotes and content is missing, a quoted one is empty text.
_MISSING = "\u0000missing\u0000"


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", contract: Contract | None = None, records: bool = False, line_breaks: bool = True) -> DataFrame:
    """A Parquet, CSV (lines that begin with # are skipped) or JSON table.

    Quoted CSV text may hold line breaks, so a file is read by one task; ``line_breaks=False`` is for large files
    without such text, which tasks then share.  An empty field is null, a quoted empty one is empty text.
    A contract gives the types of CSV and JSON columns.  ``records``: each JSON file is one array or one
    object; otherwise it has an object per line.  Objects that have nothing but a list under ``data`` are
    batches of rows.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "csv":
        reader = spark.read.option("header", True).option("comment", "#").option("escape", '"').option("multiLine", line_breaks).option("nullValue", _MISSING).option("emptyValue", "")
        if contract is None:
            return reader.option("inferSchema", True).csv(path)
        # Columns are found by name: the file may have others, or another order.
        text = reader.csv(path)
        kinds = {f.name: f.dataType for f in contract.to_struct().fields}
        return text.select(*[F.col(f"`{c}`").try_cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in text.columns])
    if fmt != "json":
        raise ValueError(f"unknown format {fmt!r}")
    reader = spark.read.option("multiLine", records)
    if contract is not None and not records:
        return reader.schema(contract.to_struct()).json(path)
    df = reader.json(path)
    if df.columns == ["data"] and isinstance(df.schema["data"].dataType, T.ArrayType):
        return df.select(F.explode("data").alias("row")).select("row.*")
    return df


def write_table(df: DataFrame, directory: str, name: str, formats: tuple[str, ...] = ("parquet",), mode: str = "errorifexists") -> dict[str, str]:
    """The table under ``directory/name.<format>`` in every format; the paths.

    CSV text keeps its line breaks, quotes and blanks; empty text is quoted, null is not.
    """
    out = {}
    for fmt in formats:
        if fmt not in FORMATS:
            raise ValueError(f"unknown format {fmt!r}")
        out[fmt] = f"{directory.rstrip('/')}/{name}.{fmt}"
        writer = df.write.mode(mode)
        if fmt == "csv":
            kept = {"header": True, "escape": '"', "comment": "#", "emptyValue": '""', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
            writer.options(**kept).csv(out[fmt])
        elif fmt == "json":
            writer.option("ignoreNullFields", False).json(out[fmt])
        else:
            writer.parquet(out[fmt])
    return out


def reference_sample(df: DataFrame, max_rows: int = 2000, order: list[str] | None = None) -> DataFrame:
    """S3: at most ``max_rows`` rows without nested columns; the first by ``order`` if given."""
    flat = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    out = df.select(*[F.col(f"`{c}`") for c in flat])
    return (out.orderBy(*order) if order else out).limit(max_rows)


def numeric_where_all_parse(df: DataFrame) -> DataFrame:
    """Text columns become numbers where every non-null value parses; a column of nulls stays text."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df

    def number(c: str) -> Column:
        return F.col(f"`{c}`").try_cast("double")

    aggs = [x for k, c in enumerate(texts) for x in (F.count_if(F.col(f"`{c}`").isNotNull() & number(c).isNull()).alias(f"bad{k}"), F.count(f"`{c}`").alias(f"n{k}"))]
    got = df.agg(*aggs).first()
    good = [c for k, c in enumerate(texts) if not got[f"bad{k}"] and got[f"n{k}"]]
    return df.withColumns({c: number(c) for c in good}) if good else df


def html_text(df: DataFrame, html_column: str = "html", name: str = "text") -> DataFrame:
    """The visible text of pages, a line per piece: lines of more than 20 characters.

    Silent elements and comments go, tags become a line break or a blank, references are decoded and blanks
    squeezed.  Null stays null.  All of it is built-in expressions, in time that grows with the length of the page, whatever it holds.
    """
    col = F.col(html_column)
    for tag in SILENT:
        col = markup.without_elements(col, tag)
    col = markup.without_comments(col)
    col = markup.replace_tags(col, rf"/?(?:{'|'.join(BLOCKS)})\b", "\n")
    col = markup.replace_tags(col, "[^>]", " ")
    lines = F.split(markup.unescaped(col), "\n")
    lines = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f\x0B]+", " ")))
    return df.withColumn(name, F.array_join(F.filter(lines, lambda x: F.length(x) > LEAST_LINE), "\n"))


def manifest(tables: dict[str, DataFrame], dataset: Dataset, rows_before: dict[str, int] | None = None) -> DataFrame:
    """(table, rows, columns, primary_key, parents, retention_pct), a row per table."""
    rows = []
    for name, df in tables.items():
        n = df.count()
        before = (rows_before or {}).get(name, n)
        parents = sorted(r.name for r in dataset.relationships if r.child == name)
        rows.append((name, n, df.columns, dataset.tables[name].primary_key, parents, round(100.0 * n / before, 4) if before else 100.0))
    first = next(iter(tables.values()))
    return first.sparkSession.createDataFrame(rows, "table string, rows long, columns array<string>, primary_key string, parents array<string>, retention_pct double")


#: Sums of row hashes are taken modulo this.
_MODULUS = 1 << 64


def schema_text(df: DataFrame) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)


def fingerprint(df: DataFrame) -> dict:
    """Rows, columns and a digest of the content that does not depend on row order but on every row's count.

    A row's text has each value, as text, behind its length.  Two MD5 values of it (of "1:" and "2:" and the text) are
    four numbers of 64 bits, which are added up modulo 2^64 over all rows.  The digest is the MD5 of the schema and the four sums,
    so digests of parts add up to that of the whole (:func:`merged`), and SQL elsewhere can repeat it.
    """
    values = [F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (F.col(f"`{c}`").cast("string") for c in df.columns)]
    text = F.concat(F.lit(""), *values)
    hashes = df.select(*[F.md5(F.concat(F.lit(f"{k}:"), text)).alias(f"h{k}") for k in (1, 2)])
    parts = [F.conv(F.substring(f"h{k}", at, 16), 16, 10).cast("decimal(38,0)") for k in (1, 2) for at in (1, 17)]
    got = hashes.agg(F.count("*").alias("n"), *[(F.coalesce(F.sum(p), F.lit(0)) % F.lit(str(_MODULUS)).cast("decimal(38,0)")).alias(f"s{k}") for k, p in enumerate(parts)]).first()
    return {"rows": got["n"], "columns": len(df.columns), "digest": "-".join([hashlib.md5(schema_text(df).encode()).hexdigest(), *(str(int(got[f"s{k}"])) for k in range(4))])}


def merged(one: dict, two: dict) -> dict:
    """The fingerprint of two tables of one schema put together, from theirs."""
    (schema, *a), (other, *b) = one["digest"].split("-"), two["digest"].split("-")
    if schema != other:
        raise ValueError("the tables have different columns")
    sums = [str((int(x) + int(y)) % _MODULUS) for x, y in zip(a, b, strict=True)]
    return {"rows": one["rows"] + two["rows"], "columns": one["columns"], "digest": "-".join([schema, *sums])}


def declaration(df: DataFrame, seed: int | None = None, audited: str = "not measured") -> dict:
    """What is declared of a published table."""
    return {**fingerprint(df), "seed": seed, "privacy_audit": audited}


def verify(df: DataFrame, declared: dict) -> bool:
    """Whether the table still is what was declared."""
    return fingerprint(df) == {k: declared[k] for k in ("rows", "columns", "digest")}
