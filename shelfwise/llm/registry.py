"""The named queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm.common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from shelfwise.llm import bpe, infill, kneser_ney, leaks, line_runs, mixing, phrases, quality, repeats, secret_scan, simhash, templates, warc

    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_secret_scan": lambda spark, folder: secret_scan.op1_secret_scan(table(spark, folder, "documents")),
        "op2_kneser_ney": lambda spark, folder: kneser_ney.op2_kneser_ney(table(spark, folder, "documents")),
        "op3_main_text": lambda spark, folder: templates.op3_main_text(table(spark, folder, "pages")),
        "op4_quality": lambda spark, folder: quality.op4_quality(table(spark, folder, "documents"), table(spark, folder, "labels")),
        "op5_mixing": lambda spark, folder: mixing.op5_mixing(table(spark, folder, "documents")),
        "op6_phrase_fingerprints": lambda spark, folder: phrases.op6_phrase_fingerprints(table(spark, folder, "documents")),
        "op7_warc": lambda spark, folder: warc.op7_warc(table(spark, folder, "pages")),
        "op8_token_counts": lambda spark, folder: bpe.op8_token_counts(table(spark, folder, "documents")),
        "op9_simhash": lambda spark, folder: simhash.op9_simhash(table(spark, folder, "documents")),
        "op10_decontamination": lambda spark, folder: leaks.op10_decontamination(
            table(spark, folder, "documents"), table(spark, folder, "benchmark")
        ),
        "op11_line_dedup": lambda spark, folder: line_runs.op11_line_dedup(table(spark, folder, "documents")),
        "op12_periodic_runs": lambda spark, folder: repeats.op12_periodic_runs(table(spark, folder, "documents")),
        "op13_fill_in_middle": lambda spark, folder: infill.op13_fill_in_middle(table(spark, folder, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    from shelfwise.llm import infill, line_runs, mixing, warc

    return {
        "op5_mixing": mixing.OP5_SQL, "op7_warc": warc.OP7_SQL, "op11_line_dedup": line_runs.OP11_SQL,
        "op13_fill_in_middle": infill.OP13_SQL,
    }
