"""The driver's contract: entry, names, SQL for known queries only."""

import subprocess
import sys

import __spark_entry__ as entry


def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["language", "label", "source", "entities", "validated"] and df.count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_doesn_t_need_the_training_data_package():
    code = "import sys, cartula.catalog, cartula.sources.jsonl, cartula.streaming.anonymize; assert not any(m.startswith('cartula.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True)
