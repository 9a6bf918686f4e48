"""Time headline queries and print one JSON line.

Folder and cores come from ``BENCH_SF_DIR`` and ``BENCH_CPUS``. A query is built and
run to the end without collecting its rows; the better of two runs counts, so that
the figure is about the plan and not about starting a JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from guardedlake.plans.all_queries import NAMED
from guardedlake.session import get_spark

HEADLINE = [
    "q01_revenue_by_unit", "q02_over_budget", "q03_overdue_invoices", "q05_top_expense_accounts", "q06_quarterly_growth", "q07_expenses_by_unit",
    "q08_pending_entries", "q09_vendor_spend", "q11_budget_variance", "q13_top_films", "q16_frequent_customers", "q20_revenue_by_store",
    "q24_customers_with_large_orders", "q26_top_customers", "a07_chunk_split_documents", "a10_hash_embedding", "a12_upsert", "a14_ingest_job",
    "b03_cosine_topk", "b03_cosine_topk_blocks", "b04_approximate_topk", "b05_context_assembly", "c01_sql_screen", "c02_guarded_sql",
    "c08_result_markdown", "c09_keyword_frequency", "d03_routes", "d07_answer_bank", "d11_redaction", "e01_refinement", "e02_run_log_replay",
    "e05_consolidation", "f03_trimmed_history", "f05_idle_sessions", "f09_event_lines", "f10_message_reduction", "g01_latency",
    "h01_constraint_audit", "s02_windowed_metrics", "l01_question_to_answer", "s01_screen_stream", "s03_live_sessions", "s03_live_history", "s04_ingest_stream",
    "f09_log_files", "g01_latency_sketches", "h05_overlapping_ranges", "s02_sliding_metrics", "l01_context_and_history",
]


def timed(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    NAMED[name].run(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {name: round(min(timed(spark, name, folder) for _ in range(2)), 3) for name in HEADLINE}
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
