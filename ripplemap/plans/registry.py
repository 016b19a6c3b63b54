"""Every query by name: (spark, folder of the test tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemap.functions import names, sqltext, text
from ripplemap.operators import bi, code, files, index, issues, lineage
from ripplemap.plans import corpora as c
from ripplemap.plans import jobs
from ripplemap.sources import bi_export, folder, repo
from ripplemap.sources import index_store as index_store_sink
from ripplemap.sources import tickets as ticket_source
from ripplemap.sources.scratch import cut, shared_path
from ripplemap.streaming.impact import hot_fields, stream_report, write_report

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(run: Query) -> Query:
    _REGISTRY["q_" + run.__name__] = run
    return run


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def _files(spark: SparkSession, sf: str, *texts: str) -> DataFrame:
    """Repository files of one or more derived snapshots."""
    snapshots = [repo.from_table(c.derive(spark, sf, t)) for t in texts]
    out = snapshots[0]
    for more in snapshots[1:]:
        out = out.unionByName(more)
    return out


def _repo(spark: SparkSession, sf: str) -> DataFrame:
    """Files of every kind: scripts, plain definitions, definitions of several steps."""
    return _files(spark, sf, c.REPO_FILES, c.YML_FILES, c.STEP_FILES)


def _latest(spark: SparkSession, sf: str, mode: str = "parity") -> DataFrame:
    """The files that count for an index: only these are parsed."""
    return files.latest_scripts(_repo(spark, sf), mode)


def _sql_text(spark: SparkSession, sf: str) -> DataFrame:
    """SQL files with their variables replaced."""
    classified = files.classify_files(_files(spark, sf, c.REPO_FILES))
    return classified.filter(F.col("kind") == "sql").transform(
        files.substitute_vars, c.VARIABLES
    )


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    return files.classify_files(_files(spark, sf, c.STEP_FILES))


def _bi(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return c.derive(spark, sf, c.BI_TABLES), c.bi_dashboards(spark, sf)


def _nodes(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return bi_export.nodes_from_text(c.bi_pages(spark, sf, kind), "response", "page", kind)


def _issues(spark: SparkSession, sf: str) -> DataFrame:
    return c.derive(spark, sf, c.ISSUES)


def _index(spark: SparkSession, sf: str, mode: str = "parity") -> DataFrame:
    return index.reference_index(
        jobs.code_index(_latest(spark, sf, mode), c.VARIABLES, mode),
        jobs.bi_index(*_bi(spark, sf), c.SERVER_URL, mode),
    )


def _stored_index(spark: SparkSession, sf: str, mode: str = "parity") -> DataFrame:
    """The index written to the shared folder and read back, as lookups find it.

    A lookup reads the index more than once; the corpus is parsed once.
    """
    return cut(_index(spark, sf, mode), "reference-index")


# Files -------------------------------------------------------------------------------


@query
def repo_scan(spark, sf):
    return _repo(spark, sf).select(
        "ordinal", "path", "name", "url", F.length("content").cast("long").alias("n_chars")
    )


@query
def repo_folder(spark, sf):
    """Definitions written as a folder tree and read back, hidden names included."""
    root = shared_path(spark, "repo-folder")
    content = c.derive(spark, sf, c.YML_FILES).select("ordinal", "content")
    folder.write_tree(c.derive(spark, sf, c.HIDDEN_FILES).join(content, "ordinal"), root)
    return repo.read_repo(spark, root, c.MAIN).select(
        "path", "name", "url", F.length("content").cast("long").alias("n_chars"))


@query
def classify_files(spark, sf):
    return files.classify_files(_repo(spark, sf)).select("ordinal", "path", "kind", "file_key")


@query
def classify_files_intended(spark, sf):
    return files.classify_files(_repo(spark, sf), "intended").select(
        "ordinal", "path", "kind", "file_key"
    )


@query
def file_urls(spark, sf):
    return files.file_urls(files.classify_files(_repo(spark, sf)))


@query
def sql_file_dedup(spark, sf):
    classified = files.classify_files(_repo(spark, sf)).filter(F.col("kind") == "sql")
    return files.last_per_key(classified, "ordinal", "path").select("file_key", "ordinal", "path")


@query
def env_vars(spark, sf):
    return files.env_vars(
        _files(spark, sf, c.REPO_FILES, c.VARIABLE_FILES), c.VARIABLE_PATH
    ).select("key", "value")


@query
def env_vars_missing(spark, sf):
    return files.env_vars(_repo(spark, sf)).select("key", "value")


@query
def flatten_vars(spark, sf):
    return files.flatten_variables(_files(spark, sf, c.VARIABLE_FILES)).select(
        "path", "key", "value"
    )


@query
def env_substitute(spark, sf):
    return _files(spark, sf, c.TEMPLATE_FILES).transform(
        files.substitute_vars, c.TEMPLATE_VARIABLES
    ).select("ordinal", "content")


@query
def env_substitute_intended(spark, sf):
    return _files(spark, sf, c.TEMPLATE_FILES).transform(
        files.substitute_vars, c.TEMPLATE_VARIABLES, "intended"
    ).select("ordinal", "content")


# SQL text ----------------------------------------------------------------------------


@query
def split_statements(spark, sf):
    return code.split_statements(_sql_text(spark, sf)).select("ordinal", "pos", "statement")


@query
def insert_statements(spark, sf):
    return code.insert_statements(code.split_statements(_sql_text(spark, sf))).select(
        "ordinal", "pos", "statement"
    )


@query
def table_refs(spark, sf):
    inserts = code.insert_statements(code.split_statements(_sql_text(spark, sf)))
    return code.table_refs(inserts).select(
        "ordinal", "pos", F.posexplode("tables").alias("ref_pos", "table")
    ).withColumn("ref_pos", F.col("ref_pos").cast("long"))


@query
def table_refs_dialects(spark, sf):
    """Tables under unusual spellings: brackets, blanks around dots, STRAIGHT_JOIN."""
    stmts = code.split_statements(_files(spark, sf, c.DIALECT_FILES))
    return code.table_refs(code.insert_statements(stmts)).select(
        "ordinal", "pos", F.posexplode("tables").alias("ref_pos", "table")
    ).withColumn("ref_pos", F.col("ref_pos").cast("long"))


@query
def last_insert(spark, sf):
    last = sqltext.last_insert(sqltext.statements(F.col("content")))
    return _sql_text(spark, sf).select("ordinal", last.alias("statement")).filter(
        F.col("statement").isNotNull()
    )


@query
def normalise_tables(spark, sf):
    raw = c.derive(spark, sf, c.RAW_NAMES)
    return raw.filter(F.col("raw").contains(".")).select(
        "id", names.normalise_table(F.col("raw")).alias("table")
    )


@query
def normalise_tables_intended(spark, sf):
    raw = c.derive(spark, sf, c.RAW_NAMES)
    return raw.filter(F.col("raw").contains(".")).select(
        "id", names.normalise_table(F.col("raw"), "intended").alias("table")
    )


# Pipeline definitions ----------------------------------------------------------------


@query
def yml_gate(spark, sf):
    return files.gate_yml(files.classify_files(_repo(spark, sf))).select("path", "has_steps")


@query
def yml_lint(spark, sf):
    return _files(spark, sf, c.YML_FILES).select(
        "ordinal", text.lint_yml(F.col("content")).alias("content")
    )


@query
def yml_steps(spark, sf):
    return code.yml_steps(_steps(spark, sf), c.VARIABLES).select("path", "name", "pos", "command")


@query
def yml_quarantine(spark, sf):
    return code.yml_quarantine(_steps(spark, sf), c.VARIABLES).select("path", "reason")


@query
def ingest_stats(spark, sf):
    return code.ingest_stats(_repo(spark, sf), c.VARIABLES)


# Code index --------------------------------------------------------------------------


@query
def tables_per_file(spark, sf):
    return code.tables_per_file(jobs.file_tables(_repo(spark, sf), c.VARIABLES)).select(
        "file_key", "pos", "table"
    )


@query
def table_to_files(spark, sf):
    classified = files.classify_files(_repo(spark, sf))
    return code.table_to_files(code.file_tables(classified, c.VARIABLES))


@query
def code_index(spark, sf):
    return jobs.code_index(_latest(spark, sf), c.VARIABLES)


@query
def code_index_intended(spark, sf):
    return jobs.code_index(_repo(spark, sf), c.VARIABLES, "intended")


# BI metadata -------------------------------------------------------------------------


@query
def bi_table_scan(spark, sf):
    return _nodes(spark, sf, "tables_to_dashboards").select(
        F.col("ordinal.page").alias("page"), "name", F.col("fullName").alias("full_name"),
        "schema", F.col("connectionType").alias("connection_type"),
        F.array_join("columns.name", ",").alias("column_names"),
        F.size("downstreamDashboards").cast("long").alias("n_dashboards"),
    )


@query
def custom_sql_dashboards(spark, sf):
    """All nodes, with the page of 50 each is on."""
    return lineage.custom_sql_pages(_nodes(spark, sf, "custom_sql")).withColumn(
        "ordinal", F.col("ordinal.page")
    )


@query
def custom_sql_lists(spark, sf):
    return lineage.custom_sql_lists(_nodes(spark, sf, "custom_sql")).withColumn(
        "ordinal", F.col("ordinal.page")
    )


@query
def bi_table_catalogue(spark, sf):
    return lineage.table_catalogue(_nodes(spark, sf, "database_tables"))


@query
def bi_database_catalogue(spark, sf):
    return lineage.database_catalogue(_nodes(spark, sf, "databases"))


@query
def workbook_fields(spark, sf):
    return lineage.workbook_fields(_nodes(spark, sf, "workbook_fields"), c.PROJECTS)


@query
def published_datasources(spark, sf):
    return lineage.published_datasources(_nodes(spark, sf, "published_datasources")).withColumn(
        "ordinal", F.col("ordinal.page")
    )


@query
def embedded_datasources(spark, sf):
    return lineage.embedded_datasources(_nodes(spark, sf, "embedded_datasources"))


@query
def workbook_lineage(spark, sf):
    return lineage.workbook_lineage(_nodes(spark, sf, "workbooks"))


@query
def datasource_clean(spark, sf):
    cleaned = bi.datasource_clean(_nodes(spark, sf, "published_datasources"))
    return cleaned.select(
        F.array_join("fields", ",").alias("fields"), F.array_join("tables", ",").alias("tables")
    )


@query
def bi_connection_filter(spark, sf):
    return bi.connection_filter(c.derive(spark, sf, c.BI_TABLES)).select(
        "table_id", F.col("connectionType").alias("connection_type")
    )


@query
def bi_clean(spark, sf):
    cleaned = bi.bi_clean(_nodes(spark, sf, "tables_to_dashboards"))
    return cleaned.select(
        F.col("ordinal.page").alias("page"), "table_name", "schema_name",
        F.col("fullName").alias("full_name"), F.array_join("columns", ",").alias("column_names"),
    )


@query
def bi_quarantine(spark, sf):
    return bi.bi_quarantine(_nodes(spark, sf, "tables_to_dashboards")).select(
        F.col("ordinal.page").alias("page"), "reason"
    )


@query
def dashboards_by_table(spark, sf):
    return bi.dashboards_by_table(c.bi_dashboards(spark, sf))


@query
def dashboards_by_table_intended(spark, sf):
    return bi.dashboards_by_table(c.bi_dashboards(spark, sf), "intended")


@query
def bi_index(spark, sf):
    return jobs.bi_index(*_bi(spark, sf), c.SERVER_URL)


@query
def bi_index_intended(spark, sf):
    return jobs.bi_index(*_bi(spark, sf), c.SERVER_URL, "intended")


@query
def bi_index_of_nodes(spark, sf):
    return jobs.bi_index_of_nodes(_nodes(spark, sf, "tables_to_dashboards"), c.SERVER_URL)


# Index -------------------------------------------------------------------------------


@query
def reference_index(spark, sf):
    return _index(spark, sf)


@query
def code_index_of_repo(spark, sf):
    """The whole ingest: the repository's own variable file, then the index of its files."""
    corpus = _files(spark, sf, c.REPO_FILES, c.YML_FILES, c.STEP_FILES, c.VARIABLE_FILES)
    return jobs.code_index_of_repo(corpus, c.VARIABLE_PATH)


@query
def reference_index_intended(spark, sf):
    return _index(spark, sf, "intended")


def _old_index(spark, sf):
    return index.reference_index(
        c.derive(spark, sf, c.OLD_CODE), jobs.bi_index(*_bi(spark, sf), c.SERVER_URL)
    )


@query
def index_merge(spark, sf):
    new = jobs.code_index(_latest(spark, sf), c.VARIABLES)
    return index.merge_index(_old_index(spark, sf), new, "github")


@query
def index_replace(spark, sf):
    new = jobs.code_index(_latest(spark, sf), c.VARIABLES)
    return index.merge_index(_old_index(spark, sf), new, "github", "replace")


@query
def index_store(spark, sf):
    """Two runs of the code source and one of the other, written to a store and read back."""
    base = shared_path(spark, "index-store")
    index_store_sink.upsert_index(spark, base, c.derive(spark, sf, c.OLD_CODE), "github")
    new = jobs.code_index(_latest(spark, sf), c.VARIABLES)
    index_store_sink.upsert_index(spark, base, new, "github")
    index_store_sink.upsert_index(spark, base, jobs.bi_index(*_bi(spark, sf), c.SERVER_URL), "tableau")
    return index_store_sink.read_index(spark, base)


@query
def index_rejects(spark, sf):
    """Entries without a key, as a run leaves them beside the store."""
    base = shared_path(spark, "index-rejects")
    raw = c.derive(spark, sf, c.RAW_NAMES)
    key = F.when(F.col("raw").contains("."), names.normalise_table(F.col("raw")))
    entries = raw.select(key.alias("pk"), F.col("raw").alias("label"), F.col("id").cast("string").alias("url"))
    index_store_sink.upsert_index(spark, base, entries, "github")
    return index_store_sink.read_rejected(spark, base, "github")


@query
def index_keys(spark, sf):
    return index.index_keys(_index(spark, sf))


@query
def index_records(spark, sf):
    def listed(attribute):
        entries = F.transform(
            F.array_sort(F.map_entries(attribute)),
            lambda e: F.concat(e["key"], F.lit("="), e["value"]),
        )
        return F.array_join(entries, "|")

    return index.to_records(_stored_index(spark, sf)).select(
        "pk", "part", listed("github.files").alias("files"),
        listed("tableau.dashboards").alias("dashboards"),
    )


@query
def index_records_split(spark, sf):
    """Records whose keys are split into parts, read back as entries: no part is lost."""
    records = index.to_records(_stored_index(spark, sf), c.ENTRIES_PER_PART)

    def entries_of(source, attribute):
        entry = lambda e: F.struct(
            F.lit(source).alias("source"), e["key"].alias("label"), e["value"].alias("url"))
        return F.transform(F.map_entries(F.coalesce(F.col(attribute), F.create_map().cast("map<string,string>"))), entry)

    entries = F.concat(entries_of("github", "github.files"), entries_of("tableau", "tableau.dashboards"))
    parts = records.groupBy("pk").agg((F.max("part") + 1).alias("parts"))
    return records.select("pk", F.explode(entries).alias("e")).join(parts, "pk").select(
        "e.source", "pk", "e.label", "e.url", "parts")


# Tickets -----------------------------------------------------------------------------


@query
def issue_scan(spark, sf):
    return ticket_source.from_text(c.tickets(spark, sf), "ticket")


@query
def issue_refs(spark, sf):
    return issues.issue_refs(_issues(spark, sf))


@query
def issue_refs_intended(spark, sf):
    return issues.issue_refs(_issues(spark, sf), "intended")


def _free_text(spark: SparkSession, sf: str) -> DataFrame:
    """Page addresses and bodies, documents and conversation turns as (issue_key, summary)."""
    pages, documents, turns = (
        c.spread(c.table(spark, sf, name), key)
        for name, key in (("pages", "page_id"), ("documents", "doc_id"), ("conversations", "conv_id"))
    )

    def said(rows: DataFrame, kind: str, text: str, *key) -> DataFrame:
        return rows.select(F.concat(F.lit(f"{kind} "), *key).alias("issue_key"), F.col(text).alias("summary"))

    page, document = F.col("page_id").cast("string"), F.col("doc_id").cast("string")
    turn = (F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"))
    return said(pages, "page", "url", page).unionByName(said(pages, "html", "html", page)).unionByName(
        said(documents, "document", "text", document)).unionByName(said(turns, "turn", "text", *turn))


@query
def text_refs(spark, sf):
    """Names in free text: page addresses and whole bodies, documents, conversation turns."""
    return issues.issue_refs(_free_text(spark, sf))


# The name under which the whole text was asked for first; both are the same query.
_REGISTRY["q_text_refs_whole"] = text_refs


@query
def issue_lookup(spark, sf):
    return issues.lookup(issues.issue_refs(_issues(spark, sf)), _stored_index(spark, sf))


@query
def mentioned_entries(spark, sf):
    return issues.mentioned_entries(issues.issue_refs(_issues(spark, sf)), _stored_index(spark, sf))


@query
def impact_report(spark, sf):
    return issues.impact_report(_issues(spark, sf), _stored_index(spark, sf))


@query
def impact_report_intended(spark, sf):
    return issues.impact_report(
        _issues(spark, sf), _stored_index(spark, sf, "intended"), "intended"
    )


@query
def report_in_order(spark, sf):
    """The report as panels show it: references as mentioned, dashboards before files."""
    return issues.order_report(issues.impact_report(_issues(spark, sf), _stored_index(spark, sf)))


@query
def point_lookup(spark, sf):
    """A request answered from a store: only the buckets of its fields are read."""
    base = shared_path(spark, "point-lookup")
    index_store_sink.upsert_index(spark, base, jobs.code_index(_latest(spark, sf), c.VARIABLES), "github")
    index_store_sink.upsert_index(spark, base, jobs.bi_index(*_bi(spark, sf), c.SERVER_URL), "tableau")
    return index_store_sink.stored_references(spark, base, c.POINT_PARAM)


@query
def index_store_partial(spark, sf):
    """A store after a run of two keys only and the expiry of what it replaced."""
    base = shared_path(spark, "index-store-partial")
    index_store_sink.upsert_index(spark, base, c.derive(spark, sf, c.OLD_CODE), "github")
    new = jobs.code_index(_latest(spark, sf), c.VARIABLES).filter(F.col("pk").isin(*c.PARTIAL_KEYS))
    index_store_sink.upsert_index(spark, base, new, "github")
    index_store_sink.expire_versions(spark, base, "github")
    return index_store_sink.read_index(spark, base)


@query
def issue_status(spark, sf):
    return issues.issue_status(_issues(spark, sf), _stored_index(spark, sf))


@query
def unreferenced(spark, sf):
    return issues.unreferenced(issues.issue_refs(_issues(spark, sf)), _stored_index(spark, sf))


@query
def lookup_param(spark, sf):
    return issues.lookup_params(c.derive(spark, sf, c.REQUESTS))


@query
def lookup_rejects(spark, sf):
    return issues.rejected_params(c.derive(spark, sf, c.REQUESTS))


@query
def answer_requests(spark, sf):
    return issues.answer_requests(c.derive(spark, sf, c.REQUESTS), _stored_index(spark, sf))


def _issue_stream(spark, sf):
    """The customer table read as a stream, seen as tickets."""
    schema = c.table(spark, sf, "customer").schema
    customers = (
        spark.readStream.schema(schema).option("pathGlobFilter", "customer.parquet").parquet(sf)
    )
    return spark.sql(c.ISSUES, customer=customers)


@query
def impact_stream(spark, sf):
    """Stateless stream-static join, split by the hot fields of the tickets, over what is there."""
    base = shared_path(spark, "impact-stream")
    hot = hot_fields(issues.issue_refs(_issues(spark, sf)))
    report = stream_report(_issue_stream(spark, sf), _stored_index(spark, sf), hot)
    report.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(
        availableNow=True
    ).start(f"{base}/report").awaitTermination()
    return spark.read.schema(report.schema).parquet(f"{base}/report")


@query
def impact_stream_batches(spark, sf):
    """The same tickets through the salted batch plan, one folder per micro-batch."""
    base = shared_path(spark, "impact-stream-batches")
    stored = _stored_index(spark, sf)
    write_report(
        _issue_stream(spark, sf), lambda: stored, f"{base}/report", f"{base}/state"
    ).awaitTermination()
    return spark.read.parquet(f"{base}/report").drop("batch")

