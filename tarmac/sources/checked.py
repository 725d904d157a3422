"""Reading traffic with an account of every row.

Text columns are parsed by rule; a row whose value does not parse, or that has too few or too many fields, is no silent
NULL but goes to a table of rejects with its reasons.  One pass writes both tables (partitions of one folder) and
counts rows, rejects and reasons in an ``Observation``.  Above ``max_reject_rate`` the read is an error that names
the counts and leaves the rejects to look at.  Empty values are missing, not wrong.

Dates try the formats in order, ISO text with or without time and offset first; the first that fits wins, so
``01/02/2016`` is the second of January or the first of February as the list says, never a guess.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .schema import DROPPED_COLUMNS, RAW_SCHEMA, TRAFFIC_COLUMNS
from .traffic import exact_number, whole_of

MAX_REJECT_RATE = 0.01
BROKEN = "row: wrong number of fields"
READ_COLUMNS = [f for f in RAW_SCHEMA.fields if f.name not in DROPPED_COLUMNS]


@dataclass
class CheckedTraffic:
    """``traffic``: accepted rows as ``scan_traffic`` gives them; ``rejects``: the text columns and ``reasons``."""
    traffic: DataFrame
    rejects: DataFrame
    rows: int
    rejected: int
    reasons: dict[str, int]
    path: str

    def reason_table(self) -> DataFrame:
        """``reason, rows`` from the written rejects; a row with several reasons counts for each."""
        return self.rejects.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def parse_date(text: Column, formats: Sequence[str] = ()) -> Column:
    """UTC date of ``text``: ISO, else the first of ``formats`` that fits; NULL if none does."""
    return F.coalesce(F.to_date(F.try_to_timestamp(text)), *[F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in formats])


def check_columns(text: DataFrame, formats: Sequence[str] = (), broken: Column | None = None) -> DataFrame:
    """``text`` plus parsed columns ``_<name>`` and ``reasons``, the columns whose text does not parse.

    One step a select: a value is trimmed and parsed once, and the code of a row stays small enough to be compiled."""
    numbers = [f for f in READ_COLUMNS if isinstance(f.dataType, T.IntegralType)]
    what = {"FLT_DATE": "no date"} | {f.name: "no whole number" for f in numbers}
    trimmed = {f.name: F.nullif(F.trim(F.col(f"`{f.name}`").cast("string")), F.lit("")) for f in READ_COLUMNS}
    values = {f"_{c}": v for c, v in trimmed.items() if c not in what}
    rows = text.withColumns(values | {f"_text_{c}": F.when(~F.lower(trimmed[c]).isin("nan", "null", "na"), trimmed[c]) for c in what})
    rows = rows.withColumns({"_FLT_DATE": parse_date(F.col("_text_FLT_DATE"), formats)}
                            | {f"_exact_{f.name}": exact_number(F.col(f"_text_{f.name}")) for f in numbers})
    rows = rows.withColumns({f"_{f.name}": whole_of(F.col(f"_text_{f.name}"), F.col(f"_exact_{f.name}"), f.dataType) for f in numbers})
    names = [f.name for f in READ_COLUMNS if f.name in what]
    reasons = F.array_compact(F.array(*[F.when(F.col(f"_text_{c}").isNotNull() & F.col(f"_{c}").isNull(), F.lit(f"{c}: {what[c]}"))
                                        for c in names]))
    if broken is not None:
        reasons = F.when(broken, F.array(F.lit(BROKEN))).otherwise(reasons)
    return rows.withColumn("reasons", reasons).drop(*[f"_text_{c}" for c in what], *[f"_exact_{f.name}" for f in numbers])


def possible_reasons() -> list[str]:
    return [BROKEN, *[f"{f.name}: " + ("no date" if f.name == "FLT_DATE" else "no whole number") for f in READ_COLUMNS
                      if f.name == "FLT_DATE" or isinstance(f.dataType, T.IntegralType)]]


def check_traffic(text: DataFrame, formats: Sequence[str] = (), max_reject_rate: float = MAX_REJECT_RATE,
                  broken: Column | None = None) -> CheckedTraffic:
    """Accept or reject every row of ``text``, whose columns are those of the raw file as text."""
    missing = [f.name for f in READ_COLUMNS if f.name not in text.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    checked = check_columns(text, formats, broken).withColumn("accepted", F.size("reasons") == 0)
    names = possible_reasons()
    counts = Observation(f"checked-{uuid.uuid4().hex}")
    checked = checked.observe(counts, F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("accepted")).alias("rejected"),
                              *[F.count_if(F.array_contains("reasons", n)).alias(f"r{i}") for i, n in enumerate(names)])
    path = f"{ensure_checkpoint_dir(text.sparkSession).rstrip('/')}/tarmac-checked-{uuid.uuid4().hex}"
    raw = [f"`{f.name}`" for f in READ_COLUMNS]
    out = checked.select(*raw, *[f"_{f.name}" for f in READ_COLUMNS], "reasons", "accepted")
    out.write.partitionBy("accepted").parquet(path)
    got = counts.get
    reasons = {n: got[f"r{i}"] for i, n in enumerate(names) if got.get(f"r{i}")}
    rows, rejected = int(got.get("rows") or 0), int(got.get("rejected") or 0)
    if rows and rejected / rows > max_reject_rate:
        raise ValueError(f"{rejected} of {rows} rows do not parse (allowed: {max_reject_rate:.2%}): {reasons}; they are under {path}")
    # the partition column keeps the schema also when all rows went one way
    written = text.sparkSession.read.schema(out.schema).parquet(path)
    good = written.where("accepted").select(*[F.col(f"_{f.name}").alias(f.name) for f in READ_COLUMNS])
    traffic = good.withColumns({"YEAR": F.coalesce("YEAR", F.year("FLT_DATE")), "MONTH_NUM": F.coalesce("MONTH_NUM", F.month("FLT_DATE"))})
    return CheckedTraffic(traffic.select(*TRAFFIC_COLUMNS), written.where("NOT accepted").select(*raw, "reasons"), rows, rejected,
                          reasons, path)


def read_traffic_checked(spark: SparkSession, path: str, formats: Sequence[str] = (),
                         max_reject_rate: float = MAX_REJECT_RATE) -> CheckedTraffic:
    """A CSV file (or folder) with a header, columns by name in any order."""
    names = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    fields = [T.StructField(n, T.StringType()) for n in names]
    corrupt = "_broken"
    # without column pruning the parser sees every field, hence a wrong number of them
    text = (spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnPruning", False).option("columnNameOfCorruptRecord", corrupt)
            .schema(T.StructType([*fields, T.StructField(corrupt, T.StringType())])).csv(path))
    return check_traffic(text, formats, max_reject_rate, F.col(corrupt).isNotNull())
