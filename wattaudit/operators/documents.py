"""Document register, token map, accounts and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattaudit.functions.privacy import tokenize
from wattaudit.functions.text import ACCOUNT, DATE


def new_documents(incoming: DataFrame, registered: DataFrame | None = None, order: str = "id") -> DataFrame:
    """Documents to register: the first of each file name, unless the name is empty or registered already."""
    rest = [c for c in incoming.columns if c != "file_name"]
    named = incoming.where(F.coalesce("file_name", F.lit("")) != "")
    # Copies of a name are combined before the shuffle; no task sees all of them.
    first = named.groupBy("file_name").agg(F.min_by(F.struct(*rest), order).alias("d")).select("file_name", "d.*")
    if registered is not None:
        first = first.join(registered.select("file_name").distinct(), "file_name", "left_anti")
    return first.select(*incoming.columns)


def orphan_files(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Stored files without a document record."""
    return files.join(documents.select("file_name").distinct(), "file_name", "left_anti")


def token_map(bills: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Map of account tokens to account numbers with the new accounts added; a known token is left as it is."""
    fresh = bills.select(F.trim("bill_account").alias("account_number")).where(F.col("account_number") != "").distinct()
    # Two of very many accounts may share a token; like a known account, the first one keeps it.
    fresh = fresh.select(tokenize("account_number", "ACCT", key).alias("token"), "account_number")
    fresh = fresh.groupBy("token").agg(F.min("account_number").alias("account_number"))
    return existing.select("token", "account_number").unionByName(fresh.join(existing, "token", "left_anti"))


def token_collisions(bills: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Accounts (token, account_number) whose token stands for another account in the map."""
    found = bills.select(F.trim("bill_account").alias("account_number")).where(F.col("account_number") != "").distinct()
    named = found.select(tokenize("account_number", "ACCT", key).alias("token"), "account_number")
    mapped = token_map(bills, existing, key).select("token", F.col("account_number").alias("_mapped"))
    return named.join(mapped, "token").where(F.col("account_number") != F.col("_mapped")).drop("_mapped")


def accounts(bills: DataFrame, sort: bool = True) -> DataFrame:
    """Distinct account numbers; null and '' are left out."""
    found = bills.select("bill_account").where(F.coalesce("bill_account", F.lit("")) != "").distinct()
    return found.orderBy("bill_account") if sort else found


def run_ledger(events: DataFrame) -> DataFrame:
    """Start and finish events (run_id, dag_id, kind, status, ts, error_msg) → one row per run.

    Runtime is in whole seconds; a run without finish event is ``running``.
    """
    started, finished = F.col("kind") == "start", F.col("kind") == "finish"
    return (
        events.groupBy("run_id")
        .agg(
            F.min(F.when(started, F.col("dag_id"))).alias("dag_id"),
            F.min(F.when(started, F.col("ts"))).alias("start_time"),
            F.max(F.when(finished, F.col("ts"))).alias("end_time"),
            F.max_by(F.when(finished, F.col("status")), F.when(finished, F.col("ts"))).alias("status"),
            F.max_by(F.when(finished, F.col("error_msg")), F.when(finished, F.col("ts"))).alias("error_msg"),
        )
        .withColumns(
            {
                "status": F.coalesce("status", F.lit("running")),
                "total_runtime": F.floor(
                    (F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp")))
                    / F.lit(1_000_000)
                ).cast("int"),
            }
        )
    )


def recent_runs(runs: DataFrame, n: int = 20, by: str = "start_time") -> DataFrame:
    """The latest runs, newest first."""
    return runs.orderBy(F.desc(by), F.desc("run_id")).limit(n)


def doc_diagnostics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document: account tokens, distinct accounts, and date pairs found."""
    t = F.col(text)
    found = F.regexp_extract_all(t, F.lit(f"({ACCOUNT})"), 1)
    return docs.select(
        "doc_id",
        F.size(found).alias("accounts_found"),
        F.size(F.array_distinct(found)).alias("distinct_accounts"),
        F.regexp_count(t, F.lit(rf"{DATE}\s+{DATE}")).alias("date_pairs"),
    )
