"""Which source files and dashboards use the database tables that tickets mention?"""

from ripplemap.operators.bi import bi_clean, bi_quarantine, datasource_clean
from ripplemap.operators.code import (
    ingest_stats, insert_statements, split_statements, table_refs, table_to_files,
    yml_quarantine, yml_steps,
)
from ripplemap.operators.files import (
    classify_files, collect_vars, env_vars, file_urls, substitute_vars,
)
from ripplemap.operators.index import index_keys, merge_index, reference_index, to_records
from ripplemap.operators.issues import (
    answer_requests, get_references, impact_report, issue_refs, issue_status, lookup,
    mentioned_entries, unreferenced,
)
from ripplemap.plans.jobs import bi_index, bi_index_of_nodes, code_index, code_index_of_repo
from ripplemap.sources.bi_export import read_nodes
from ripplemap.sources.index_store import expire_versions, read_index, stored_references, upsert_index
from ripplemap.sources.repo import from_table, read_repo
from ripplemap.sources.scratch import clear_scratch
from ripplemap.sources.tickets import read_issues
from ripplemap.streaming.impact import stream_report, write_report

__all__ = [
    "answer_requests", "bi_clean", "bi_index", "bi_index_of_nodes", "bi_quarantine",
    "classify_files", "clear_scratch", "code_index", "code_index_of_repo", "collect_vars",
    "datasource_clean", "env_vars", "expire_versions", "file_urls", "from_table", "get_references",
    "impact_report", "index_keys", "ingest_stats", "insert_statements", "issue_refs",
    "issue_status", "lookup", "mentioned_entries", "merge_index", "read_index",
    "read_issues", "read_nodes", "read_repo", "reference_index", "split_statements",
    "stored_references", "stream_report", "substitute_vars", "table_refs", "table_to_files", "to_records",
    "unreferenced", "upsert_index", "write_report", "yml_quarantine", "yml_steps",
]
