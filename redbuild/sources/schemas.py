"""Schemas of the tables and documents the pipeline reads and writes."""

from ..operators.rca import REMEDIATION

LINES = "failure_id string, stage string, line_no long, raw string"
SIGNAL = (
    "failure_id string, stage string, line_no long, signal_type string, block_type string, "
    "fingerprint string, error_line string, pre_content string, post_content string"
)
PAYLOAD = (
    "commit string, branch string, job_name string, build_number long, owner string, repo string, "
    "run_id long, mailRecipient struct<dev_email:string,test_email:string,ci_email:string>"
)
FAILURES = (
    f"failure_id string, platform string, commit string, branch string, status string, "
    f"payload struct<{PAYLOAD.replace(' string', ':string').replace(' long', ':bigint').replace(' struct', ':struct')}>, "
    "created_at timestamp_ntz, document variant"
)
CLASSIFIED = f"{SIGNAL}, category string, confidence double, owner_team string"
ROOT_CAUSES = (
    "failure_id string, fingerprint string, validated_category string, root_cause string, error_line string, "
    f"owner string, remediation {REMEDIATION}, secondary_remediations array<{REMEDIATION}>, "
    "rca_confidence double, severity string, recurrence_count int, analyzed_at string, evidence_url string, "
    "similarity_score double"
)
PATTERNS = (
    "fingerprint string, validated_category string, root_cause string, error_line string, owner string, "
    f"remediation {REMEDIATION}, secondary_remediations array<{REMEDIATION}>, rca_confidence double, "
    "severity string, recurrence_count int, analyzed_at string, evidence_url string, embedding array<float>"
)
EMBEDDINGS = "failure_id string, fingerprint string, embedding array<float>"
INTAKE_KEYS = "platform string, commit string, branch string, job_name string, build_number long, failure_id string"
STATUS_EVENTS = "failure_id string, status string, ts timestamp"
# Documents of the CI services, as landed.
HUB_RUN = (
    "run_id long, jobs array<struct<id:bigint,name:string,conclusion:string,status:string,"
    "steps:array<struct<number:bigint,name:string,conclusion:string,status:string,log:string>>>>"
)
PIPELINE_RUN = (
    "run_id long, nodes array<struct<id:string,displayName:string,result:string,state:string,"
    "steps:array<struct<id:string,displayName:string,result:string,state:string,log:string>>>>"
)
