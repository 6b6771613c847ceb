import pytest

import __spark_entry__ as entry
import oracle

# The others take longer; the driver compares all of them.
QUICK = [
    "clean_line", "json_message", "normalize_error_line", "normalize_for_embedding", "embedding_text", "stage_names",
    "noise_lines", "signal_type_counts", "signals_distinct", "knn_best", "cache_hits", "near_dup_keep",
    "knowledge_upsert", "stage_assembly", "stage_lines", "failed_stages", "platform_of", "intake_dedup", "latest_run",
    "status_gate", "payload_paths", "payload_matches", "find_duplicate", "record_by_id", "contract_gaps", "remediation_decode", "remediation_valid", "report_summary", "report_rows", "recipients",
]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, small, name):
    frame = entry.queries()[name](spark, small)
    assert oracle.differences(frame, oracle.connect(small), entry.oracle_sql()[name]) is None


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
