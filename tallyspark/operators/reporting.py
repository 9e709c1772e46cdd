"""Run ledger and reports: declarative views over run and break tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_BREAKS, MOST_RUNS = 2000, 100


def scoped(df: DataFrame, tenant_id: str, portfolio_ids: list[str]) -> DataFrame:
    return df.where((F.col("tenant_id") == tenant_id) & F.col("portfolio_id").isin(portfolio_ids))


def filtered(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Equality filters; an empty value does not filter."""
    for column, value in wanted.items():
        if value:
            df = df.where(F.col(column) == value)
    return df


def run_ledger(trades: DataFrame, break_rows: DataFrame, run_id: str, completed_at: Column | None = None) -> DataFrame:
    """One row per portfolio of a run. trades: one row a trade with n_observations; break_rows: one row a break."""
    per_trade = break_rows.groupBy("tenant_id", "portfolio_id", "lineage_id").agg(F.count(F.lit(1)).alias("n_breaks"))
    joined = trades.select("tenant_id", "portfolio_id", "lineage_id", "n_observations").join(per_trade, ["tenant_id", "portfolio_id", "lineage_id"], "left")
    return _by_portfolio(joined, run_id, completed_at)


def ledger_of_breaks(rows: DataFrame, run_id: str, completed_at: Column | None = None) -> DataFrame:
    """``run_ledger`` of break rows in which trades without breaks have a row without a family, with n_observations of each trade: the trades are evaluated once, and met by nothing."""
    n = F.count("family")
    per_trade = rows.groupBy("tenant_id", "portfolio_id", "lineage_id").agg(F.when(n > 0, n).alias("n_breaks"), F.first("n_observations").alias("n_observations"))
    return _by_portfolio(per_trade, run_id, completed_at)


def _by_portfolio(per_trade: DataFrame, run_id: str, completed_at: Column | None) -> DataFrame:
    broken = F.col("n_breaks").isNotNull()
    ledger = per_trade.groupBy("tenant_id", "portfolio_id").agg(
        F.count(F.lit(1)).alias("trades_evaluated"),
        F.sum("n_observations").alias("observations_ingested"),
        F.count_if(~broken).alias("clean_trades"),
        F.count_if(broken).alias("broken_trades"),
        F.coalesce(F.sum("n_breaks"), F.lit(0)).alias("break_count"),
    )
    return ledger.select(F.lit(run_id).alias("run_id"), "*", F.lit("COMPLETED").alias("status"), (F.current_timestamp() if completed_at is None else completed_at).alias("completed_at"))


def recent_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    """The newest run rows; of rows completed at one time the last run id first, which is the one row id there is without a sequence."""
    if not 1 <= limit <= MOST_RUNS:
        raise ValueError("limit")
    return runs.orderBy(F.desc("completed_at"), F.desc("run_id"), "portfolio_id").limit(limit)


def runs_by_id(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.where(F.col("run_id") == run_id).orderBy("portfolio_id")


def latest_run_id(runs: DataFrame) -> DataFrame:
    """One row: the last completed run (null without any)."""
    return runs.where("status = 'COMPLETED'").agg(F.max_by("run_id", F.struct("completed_at", "run_id")).alias("run_id"))


def of_latest_run(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """rows of the latest run: a join with one row."""
    return rows.join(F.broadcast(latest_run_id(runs)), "run_id")


def break_list(rows: DataFrame, limit: int = 500, **wanted: str | None) -> DataFrame:
    """Filtered, newest first; filters come before the limit."""
    if not 1 <= limit <= MOST_BREAKS:
        raise ValueError("limit")
    return filtered(rows, **wanted).orderBy(F.desc("detected_at"), "break_id").limit(limit)


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of highest version of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.col(version).cast("decimal(19,0)")))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def by_family(rows: DataFrame, run_id: str | None = None) -> DataFrame:
    return filtered(rows, run_id=run_id).groupBy("family").agg(F.count(F.lit(1)).alias("n_breaks")).orderBy(F.desc("n_breaks"), "family")


def trades_by_product(states: DataFrame) -> DataFrame:
    return states.where("product_type is not null").groupBy("product_type").agg(F.countDistinct("trade_id").alias("n_trades"))


def totals(ledger: DataFrame) -> DataFrame:
    """One run over all portfolios."""
    sums = ["trades_evaluated", "observations_ingested", "clean_trades", "broken_trades", "break_count"]
    return ledger.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in sums], F.max("completed_at").alias("completed_at"))


def priority_queue(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy("priority_key", "break_id").limit(limit)


def coverage(truth: DataFrame) -> DataFrame:
    """Counts by product and population, family, portfolio, in one pass over grouping sets."""
    return truth.groupingSets(
        [["product_type", "population"], ["product_type", "family"], ["product_type", "portfolio_id"], ["product_type"], []], "product_type", "population", "family", "portfolio_id"
    ).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("set_id"))


def search(text: Column, query: str) -> Column:
    return F.lower(text).contains(query.lower())


def trade_detail(states: DataFrame, rows: DataFrame, trade_id: str) -> DataFrame:
    """The latest state of a trade with its breaks as a list (empty if none)."""
    mine = rows.where(F.col("trade_id") == trade_id).groupBy("trade_id").agg(F.sort_array(F.collect_list(F.struct("family", "break_id", "severity", "state"))).alias("breaks"))
    state = latest(states.where(F.col("trade_id") == trade_id), ["tenant_id", "portfolio_id", "trade_id"], "canonical_state_version")
    none = F.array().cast("array<struct<family:string,break_id:string,severity:string,state:string>>")
    return state.join(mine, "trade_id", "left").withColumn("breaks", F.coalesce("breaks", none))
