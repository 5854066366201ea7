"""Draw tables: reading, validation, derivation from order lines, upserts, payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER_COLUMNS = ("n1", "n2", "n3", "n4", "n5", "n6")
_FIELD = T.StructType([T.StructField("ltEpsd", T.IntegerType()), *[T.StructField(f"tm{i}WnNo", T.IntegerType()) for i in range(1, 7)], T.StructField("bnsWnNo", T.IntegerType()), T.StructField("ltRflYmd", T.StringType())])
#: The form of a fetched payload.
PAYLOAD = T.StructType([T.StructField("data", T.StructType([T.StructField("list", T.ArrayType(_FIELD))]))])


class DrawError(ValueError):
    """A draw table that fails validation."""


def read_csv(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """A CSV of draws with normalised headers; further columns are kept.  All columns come as text: ``validated`` casts them."""
    return normalised_headers(spark.read.csv(path, header=True, encoding=encoding))


def normalised_headers(df: DataFrame) -> DataFrame:
    names = [c.strip().lower() for c in df.columns]
    return df.toDF(*["round" if n == "round_id" else n for n in names])


#: Rounds that an error quotes of each rule and column.
QUOTED = 20
#: Rules in the order in which they are told.
RULES = ("not_numeric", "out_of_range", "not_unique")


def violations(df: DataFrame) -> DataFrame:
    """``rule``, ``column`` (null for rules on the row) and ``round``, a row for each rule that a row breaks in a column."""
    missing = [c for c in ("round", *NUMBER_COLUMNS) if c not in df.columns]
    if missing:
        raise DrawError(f"missing columns: {', '.join(missing)}")
    number = {c: F.expr(f"try_cast(`{c}` AS INT)") for c in ("round", *NUMBER_COLUMNS)}
    same = F.size(F.array_distinct(F.array(*[number[c] for c in NUMBER_COLUMNS]))) != 6
    tests = [("not_numeric", c, x.isNull()) for c, x in number.items()]
    tests += [("out_of_range", c, ~number[c].between(1, 45)) for c in NUMBER_COLUMNS] + [("not_unique", None, same)]
    each = F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.lit(c).cast("string").alias("column"))) for rule, c, broken in tests])
    told = df.select(number["round"].alias("round"), F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x"))
    return told.select("x.rule", "x.column", "round")


def problems(df: DataFrame) -> dict[tuple[str, str | None], tuple[int, list[int]]]:
    """How many rows break each rule in each column, and the first of their rounds (``QUOTED`` at most).

    All of them are in ``violations``; here a rule and column is one row of counts.
    """
    broken = violations(df)
    counts = broken.groupBy("rule", "column").agg(F.count("*").alias("n")).collect()  # 14 rows at most
    out = {}
    for r in sorted(counts, key=lambda r: (RULES.index(r.rule), r.column or "")):
        rows = broken.filter((F.col("rule") == r.rule) & F.col("column").eqNullSafe(F.lit(r.column))).filter("round IS NOT NULL")
        out[r.rule, r.column] = r.n, [x["round"] for x in rows.select("round").distinct().orderBy("round").limit(QUOTED).collect()]
    return out


def validated(df: DataFrame) -> DataFrame:
    """Cast and checked draws, other columns kept; DrawError names the first broken rule, its columns and some of their rounds."""
    found = problems(df)
    if found:
        rule = next(iter(found))[0]
        said = [f"{c or 'row'}: {n} rows, rounds {rounds}" for (r, c), (n, rounds) in found.items() if r == rule]
        raise DrawError(f"{rule}: {'; '.join(said)}")
    return df.withColumns({c: F.col(c).cast("int") for c in ("round", *NUMBER_COLUMNS)})


def load(spark: SparkSession, path: str, recent_n: int | None = None) -> DataFrame:
    df = validated(read_csv(spark, path))
    return recent(df, recent_n) if recent_n is not None else df.orderBy("round")


def recent(df: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows by round, in order."""
    if n <= 0:
        raise ValueError("recent_n must be positive")
    return df.orderBy(F.desc("round")).limit(n).orderBy("round")


def max_round(df: DataFrame) -> int:
    """The largest round, 0 for an empty table; values that are no numbers are passed over, but not all may be."""
    got = df.agg(F.count("*").alias("n"), F.max(F.expr("try_cast(round AS INT)")).alias("m")).first()
    if got.n and got.m is None:
        raise DrawError("no numeric round")
    return got.m or 0


def from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Draws derived from order lines: twelve orders are a round, its numbers the first seven distinct parts modulo 45.

    ``round``, ``c`` (the six numbers, sorted), ``bonus``.
    """
    number = (F.col("l_partkey") % 45 + 1).cast("int")
    lines = lineitem.select((F.floor(F.col("l_orderkey") / 12).cast("long") + 1).alias("round"), number.alias("number"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("k"))
    first = lines.groupBy("round", "number").agg(F.min("k").alias("k"))
    order = F.array_sort(F.collect_list(F.struct("k", "number")))  # at most 45 of a round
    picked = first.groupBy("round").agg(order.alias("o"))
    return picked.select("round", F.array_sort(F.transform(F.slice("o", 1, 6), lambda x: x.number)).alias("c"), F.get("o", F.lit(6)).number.alias("bonus"))


def wide(draws: DataFrame) -> DataFrame:
    """``round``, ``n1`` .. ``n6``, ``bonus`` from combinations."""
    return draws.select("round", *[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(NUMBER_COLUMNS)], "bonus")


def combined(df: DataFrame) -> DataFrame:
    """``round``, ``c`` and ``bonus`` (null where there is none) from number columns."""
    bonus = F.col("bonus").cast("int") if "bonus" in df.columns else F.lit(None).cast("int")
    return df.select(F.col("round").cast("long").alias("round"), F.array_sort(F.array(*NUMBER_COLUMNS)).alias("c"), bonus.alias("bonus"))


def latest_rows(df: DataFrame, key: str, *recency: str) -> DataFrame:
    """Of the rows of each key the last by ``recency``: a sortable maximum, aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in (key, *recency)]
    top = df.groupBy(key).agg(F.max(F.struct(*recency, *rest)).alias("t"))
    return top.select(key, "t.*").select(*df.columns)


def upserted(old: DataFrame, new: DataFrame, arrival: str | None = None) -> DataFrame:
    """Old rows and new ones by column name; of a round the new row stays, and of several the one that came last.

    ``arrival`` names a column of both that rises in the order of arrival;
    without one it is the order in which the rows are read.  Columns that one
    side lacks are null.
    """
    came = F.monotonically_increasing_id() if arrival is None else F.col(arrival)
    old, new = (df.withColumns({"_side": F.lit(k), "_came": came}) for k, df in enumerate((old, new)))
    both = old.unionByName(new, allowMissingColumns=True)
    return latest_rows(both.withColumn("round", F.col("round").cast("long")), "round", "_side", "_came").drop("_side", "_came")


def new_rounds(spark: SparkSession, last: int, latest: int) -> DataFrame:
    return spark.range(last + 1, latest + 1).withColumnRenamed("id", "round")


def latest_round(exists, start: int = 1) -> int:  # noqa: ANN001
    """The last round for which ``exists(round)``: doubling steps, then bisection; ``start - 1`` if there is none."""
    if not exists(start):
        return start - 1
    low, step = start, 1
    while exists(low + step):
        low, step = low + step, step * 2
    high = low + step
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if exists(mid) else (low, mid)
    return low


def parsed_payload(df: DataFrame, column: str = "payload", asked: str | None = "asked") -> DataFrame:
    """Draw rows from JSON payloads: the first of the list; other rounds than asked for, and what is no JSON, are left out."""
    p = F.get(F.from_json(F.col(column), PAYLOAD)["data"]["list"], F.lit(0))
    out = df.select(*([F.col(asked).cast("int").alias("_asked")] if asked else []), p.alias("p")).filter("p.ltEpsd IS NOT NULL")
    if asked:
        out = out.filter("p.ltEpsd = _asked")
    return out.select(F.col("p.ltEpsd").alias("round"), *[F.col(f"p.tm{i}WnNo").alias(f"n{i}") for i in range(1, 7)], F.col("p.bnsWnNo").alias("bonus"), F.col("p.ltRflYmd").alias("draw_date"))
