"""The three sheets and their CSV files."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadgauge.config import ScorecardConfig
from leadgauge.functions.measure import repeat_copies
from leadgauge.functions.window import AsOf
from leadgauge.plans.scorecard import counted_scorecard
from leadgauge.sources import Sources

# Sheet -> value of bus_email_flag it keeps.
KINDS = {"Business": 1, "Personal": 0, "All": None}


def sheet_of(counted: DataFrame, config: ScorecardConfig, kind: str) -> DataFrame:
    """One sheet of a counted scorecard, best total first; equal totals by account and channel.

    Sorted before equal rows are written out, so the sort moves one row where a hot account has a thousand.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown sheet {kind!r}, expected one of {', '.join(KINDS)}")
    rows = counted
    if KINDS[kind] is not None:
        rows = rows.filter(F.col("bus_email_flag") == KINDS[kind])
    rows = rows.orderBy(F.col("total").desc_nulls_last(), "account_id", "FTC", "piece")
    features = [f.name for f in config.features]
    return repeat_copies(rows, "account_id", "email", *features, "total")


def sheet(sources: Sources, as_of: AsOf, config: ScorecardConfig, kind: str) -> DataFrame:
    """One sheet from the event tables.

    A sort reads its input twice, once to find the ranges. The exchange before it makes that the finished rows instead
    of the joins behind them.
    """
    return sheet_of(counted_scorecard(sources, as_of, config).hint("rebalance"), config, kind)


PREFIX = "scorecard"


def csv_path(directory: str, kind: str, day: date, prefix: str = PREFIX) -> str:
    return f"{directory}/{prefix}_{kind}_{day.isoformat()}.csv"


def write_sheet_csv(
    rows: DataFrame, directory: str, kind: str, day: date, mode: str = "errorifexists", prefix: str = PREFIX
) -> str:
    """Write a sheet as CSV with header, NA for NULL and doubled quotes; the part files are in row order."""
    path = csv_path(directory, kind, day, prefix)
    (
        rows.write.mode(mode)
        .option("header", True)
        .option("nullValue", "NA")
        .option("escape", '"')
        .csv(path)
    )
    return path


def write_sheets(
    sources: Sources,
    as_of: AsOf,
    config: ScorecardConfig,
    directory: str,
    day: date,
    scratch: str,
    kinds: Iterable[str] = tuple(KINDS),
    mode: str = "errorifexists",
    prefix: str = PREFIX,
) -> list[str]:
    """Several sheets from one pass over the event tables.

    The scorecard, some ten numbers per account, is written once as Parquet to `scratch`, a folder that all executors share
    and that must not exist yet, and read back for each sheet: neither the second sheet nor a lost executor sends Spark
    back to the events, and a sheet's filter reaches the files. The caller removes the folder.
    """
    counted = counted_scorecard(sources, as_of, config)
    counted.write.parquet(scratch)
    counted = counted.sparkSession.read.schema(counted.schema).parquet(scratch)
    return [write_sheet_csv(sheet_of(counted, config, kind), directory, kind, day, mode, prefix) for kind in kinds]
