"""The registered queries: each operator over whole tables, or texts derived from them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkblot.functions.entropy import high_entropy_spans, is_candidate, shannon_entropy, token_spans
from inkblot.functions.routing import format_of, kind_of
from inkblot.functions.spans import regex_spans
from inkblot.operators.context import assign_sites
from inkblot.operators.detect import looks_like_person
from inkblot.operators.findings import drop_allowed, findings_json, findings_table
from inkblot.operators.islands import island_rows, resolve_islands, scrub_islands
from inkblot.operators.models import EntityModel
from inkblot.operators.names import name_spans
from inkblot.operators.restore import has_placeholder_text, restore, restore_text
from inkblot.operators.risk import report, risk, risk_of_table
from inkblot.operators.structured import scan_leaves, scrub_any, scrub_columns, scrub_structured, scrub_table
from inkblot.operators.sites import native_assign_sites
from inkblot.plans import texts
from inkblot.plans.oracles import FIRST_LOG_ID
from inkblot.plans.scrub import placed_table, scan, scrub, vault_table
from inkblot.rules import CustomRule, ScanConfig
from inkblot.session import scratch_dir, spread, without_call_sites
from inkblot.sources.files import assemble_pages, read_documents
from inkblot.sources.largecsv import read_large_csv
from inkblot.sources.sinks import publish_scrubbed, published_texts, published_vault, write_scrubbed
from inkblot.streaming.streams import read_restored, read_risk, restore_stream, risk_by_window, scrub_stream, write_risk

Query = Callable[[SparkSession, str], DataFrame]
DEFAULT = ScanConfig()


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    without_call_sites(spark)
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*columns) if columns else df


def documents(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return spread(table(spark, sf, "documents", "doc_id", "text", *more), "doc_id")


def _from_customers(spark: SparkSession, sf: str, text: str) -> DataFrame:
    customers = spread(table(spark, sf, "customer", "c_custkey", "c_name", "c_mktsegment"), "c_custkey")
    return customers.select(F.col("c_custkey").alias("doc_id"), F.expr(text).alias("text"))


def logs(spark: SparkSession, sf: str) -> DataFrame:
    return _from_customers(spark, sf, texts.LOG_LINE)


def sources(spark: SparkSession, sf: str) -> DataFrame:
    return _from_customers(spark, sf, texts.SOURCE)


def _after(df: DataFrame) -> DataFrame:
    return df.select((F.col("doc_id") + FIRST_LOG_ID).alias("doc_id"), "text")


def mixed(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).unionByName(_after(logs(spark, sf)))


def code(spark: SparkSession, sf: str) -> DataFrame:
    return sources(spark, sf).unionByName(_after(logs(spark, sf)))


def records(spark: SparkSession, sf: str, text: str, fmt: str) -> DataFrame:
    events = spread(table(spark, sf, "events", "event_id", "user_id", "props"), "event_id")
    return events.select(F.col("event_id").alias("doc_id"), F.lit(fmt).alias("fmt"), F.expr(text).alias("text"))


def _spans(docs: DataFrame, spans) -> DataFrame:
    # the outer form keeps the optimizer from adding size(s) > 0, which would match twice
    rows = docs.select("doc_id", F.explode_outer(spans).alias("s")).where("s is not null")
    return rows.select("doc_id", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"), "s.snippet")


def find(source, label: str, kind: str = "DOC") -> Query:
    """One rule over one source."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        (rule,) = [r for r in DEFAULT.rules(kind) if r.label == label]
        return _spans(source(spark, sf), regex_spans(F.col("text"), rule.java, rule.guard))

    return query


def _listed(df: DataFrame, *columns: str) -> DataFrame:
    renamed = df.withColumnsRenamed({"start": "start_at", "end": "end_at"})
    return renamed.select("doc_id", *columns)


def query_assemble_pages(spark, sf):
    return assemble_pages(table(spark, sf, "conversations", "conv_id", "turn", "text"), "conv_id", "turn")


def query_route_kind(spark, sf):
    paths = table(spark, sf, "pages", "page_id", "url").withColumn("path", F.expr(texts.PAGE_PATH))
    ext = format_of(F.col("path"))
    return paths.select("page_id", kind_of(F.col("path")).alias("kind"), ext.alias("fmt"))


def query_custom_rule(spark, sf):
    config = ScanConfig(custom_rules=(CustomRule("HEX_SECRET", r"\b[0-9a-f]{40}\b", 45),))
    found = findings_table(scan(documents(spark, sf), config, "DOC"))
    return _listed(found, "label", "start_at", "end_at", "snippet", "weight")


def query_entropy_tokens(spark, sf):
    return _spans(documents(spark, sf), token_spans(F.col("text")))


def query_token_entropy(spark, sf):
    tokens = _spans(documents(spark, sf), token_spans(F.col("text"), 8)).select(F.col("snippet").alias("token"))
    distinct = tokens.where(is_candidate(F.col("token"))).distinct()
    return distinct.select("token", F.round(shannon_entropy(F.col("token")), 6).alias("entropy"))


def query_find_entropy(spark, sf):
    return _spans(documents(spark, sf), high_entropy_spans(F.col("text")))


def query_assign_sites(spark, sf):
    return assign_sites(sources(spark, sf), DEFAULT.suspicious).select("doc_id", "form", "name", "literal")


def query_find_assign(spark, sf):
    found = findings_table(scan(sources(spark, sf), DEFAULT, "CODE")).where(F.col("label") == "SECRET_VAR_ASSIGNMENT")
    return _listed(found, "start_at", "end_at", "snippet", "copies")


def _people(spark, sf):
    customers = table(spark, sf, "customer", "c_name").distinct()
    return customers.select(F.col("c_name").alias("value"), F.lit("PERSON").alias("label"))


def query_find_person(spark, sf):
    return _listed(name_spans(logs(spark, sf), _people(spark, sf)), "start_at", "end_at", "snippet")


def query_find_person_join(spark, sf):
    """The form for name lists that do not travel in the plan, within a scan."""
    config = ScanConfig(names_table=_people(spark, sf))
    found = findings_table(scan(logs(spark, sf), config, "DOC"))
    return _listed(found.where(F.col("label") == "PERSON"), "start_at", "end_at", "snippet")


def query_find_location(spark, sf):
    nations = table(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey")
    regions = table(spark, sf, "region", "r_regionkey", "r_name")
    # 25 nations of 5 regions at any scale
    places = nations.join(F.broadcast(regions), nations.n_regionkey == regions.r_regionkey)
    values = F.array("n_name", "r_name", F.concat_ws(" ", "n_name", "r_name"))
    names = places.select(F.explode(values).alias("value")).distinct().withColumn("label", F.lit("LOCATION"))
    customers = spread(table(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey"), "c_custkey")
    lives = customers.join(F.broadcast(places), customers.c_nationkey == places.n_nationkey)
    docs = lives.select(F.col("c_custkey").alias("doc_id"), F.expr(texts.PLACE_TEXT).alias("text"))
    config = ScanConfig.from_tables(names=names)
    found = findings_table(scan(docs, config, "DOC")).where(F.col("label") == "LOCATION")
    return _listed(found, "start_at", "end_at", "snippet")


def query_person_filter(spark, sf):
    customers = table(spark, sf, "customer", "c_name", "c_mktsegment")
    values = customers.select(F.explode(F.array("c_name", "c_mktsegment")).alias("value")).distinct()
    docs = _from_customers(spark, sf, texts.PEOPLE_TEXT)
    found = name_spans(docs, values.withColumn("label", F.lit("PERSON")))
    return found.select("doc_id", F.col("start").alias("start_at"), "snippet", looks_like_person(F.col("snippet")).alias("kept"))


def query_scan_code(spark, sf):
    found = findings_table(scan(code(spark, sf), DEFAULT, "CODE"))
    return _listed(found, "label", "start_at", "end_at", "snippet", "priority", "copies")


def query_scan_doc(spark, sf):
    return _listed(findings_table(scan(mixed(spark, sf), DEFAULT, "DOC")), "label", "start_at", "end_at", "snippet")


def _allowed(spark, sf):
    keys = table(spark, sf, "supplier", "s_suppkey").select(F.col("s_suppkey").cast("string").alias("k"))
    return keys.select(F.explode(F.array(F.concat(F.lit("u"), "k"), F.concat(F.lit("a"), "k"))).alias("value"))


def query_allow_list(spark, sf):
    found = findings_table(scan(mixed(spark, sf), DEFAULT, "DOC"))
    return _listed(drop_allowed(found, _allowed(spark, sf)), "label", "start_at", "snippet")


def query_allow_list_join(spark, sf):
    """The form for allow-lists that do not travel in the plan, within a scan."""
    kept = scan(mixed(spark, sf), ScanConfig(ignore_table=_allowed(spark, sf)), "DOC")
    return _listed(findings_table(kept), "label", "start_at", "snippet")


def query_order_code(spark, sf):
    found = findings_table(scan(code(spark, sf), DEFAULT, "CODE"))
    return _listed(found, "ord", "label", "start_at", "end_at", "snippet")


def query_order_doc(spark, sf):
    found = findings_table(scan(mixed(spark, sf), DEFAULT, "DOC"))
    return _listed(found, "ord", "label", "start_at", "end_at", "snippet")


def query_findings_json(spark, sf):
    listed = findings_json(scan(mixed(spark, sf), DEFAULT, "DOC"))
    item = "array<struct<label:string,start:int,end:int,snippet:string>>"
    rows = listed.select("doc_id", F.posexplode_outer(F.from_json("findings", item)).alias("ord", "f")).where("f is not null")
    return _listed(rows.select("doc_id", "ord", "f.*"), "ord", "label", "start_at", "end_at", "snippet")


def query_resolve_code(spark, sf):
    return _listed(placed_table(scrub(code(spark, sf), DEFAULT, "CODE")), "start_at", "end_at", "label")


def query_resolve_doc(spark, sf):
    return _listed(placed_table(scrub(mixed(spark, sf), DEFAULT, "DOC")), "start_at", "end_at", "label")


def query_placeholders(spark, sf):
    return _listed(placed_table(scrub(mixed(spark, sf), DEFAULT, "DOC")), "start_at", "placeholder")


def query_vault(spark, sf):
    return vault_table(scrub(mixed(spark, sf), DEFAULT, "DOC"))


def query_scrub_text(spark, sf):
    return scrub(mixed(spark, sf), DEFAULT, "DOC").select("doc_id", "text", "engine")


def query_scrub_code(spark, sf):
    return scrub(code(spark, sf), DEFAULT, "CODE").select("doc_id", "text", "engine")


def query_scrub_one_way(spark, sf):
    return scrub(mixed(spark, sf), DEFAULT, "DOC", keep_vault=False).select("doc_id", "text")


def query_restore(spark, sf):
    # texts and vault are stored when they are made, and read when they are needed
    texts_at, vault_at = scratch_dir(spark, "restore-texts"), scratch_dir(spark, "restore-vault")
    write_scrubbed(scrub(mixed(spark, sf), DEFAULT, "DOC"), texts_at, vault_at)
    return restore(spark.read.parquet(texts_at).select("doc_id", "text"), spark.read.parquet(vault_at))


def query_restore_dup(spark, sf):
    """From a vault that holds every row twice, as one written by a job that was run again may."""
    # detected once: texts and both halves of the vault are read from what was stored
    texts_at, vault_at = scratch_dir(spark, "restore-dup-texts"), scratch_dir(spark, "restore-dup-vault")
    write_scrubbed(scrub(logs(spark, sf), DEFAULT, "DOC"), texts_at, vault_at)
    vault = spark.read.parquet(vault_at)
    return restore(spark.read.parquet(texts_at).select("doc_id", "text"), vault.unionByName(vault))


def query_restore_map(spark, sf):
    done = scrub(mixed(spark, sf), DEFAULT, "DOC")
    entries = F.map_from_entries(F.transform("placed", lambda p: F.struct(p["placeholder"], p["original"])))
    return done.select("doc_id", restore_text(F.col("text"), entries).alias("text"))


def query_roundtrip_violations(spark, sf):
    docs = mixed(spark, sf)
    done = scrub(docs.withColumn("before", F.col("text")), DEFAULT, "DOC")
    entries = F.map_from_entries(F.transform("placed", lambda p: F.struct(p["placeholder"], p["original"])))
    flagged = has_placeholder_text(F.col("before"))
    same = restore_text(F.col("text"), entries) == F.col("before")
    return done.agg(
        F.count("*").alias("n_docs"),
        F.count_if(flagged).alias("n_flagged"),
        F.count_if(~flagged & ~same).alias("n_violations"),
    )


def query_leaf_scan(spark, sf):
    rows = scan_leaves(records(spark, sf, texts.JSON_RECORD, "json"), formats=("json",))
    rows = rows.select("doc_id", F.explode_outer("placed").alias("p")).where("p is not null")
    return rows.select("doc_id", "p.leaf", F.col("p.start").alias("start_at"), "p.label", F.col("p.original").alias("snippet"), "p.placeholder")


def query_scrub_json(spark, sf):
    done = scrub_structured(records(spark, sf, texts.JSON_RECORD, "json"), formats=("json",))
    value = F.from_json("text", "struct<src:string,note:string,tags:array<string>>")
    rows = done.select("doc_id", "text", value.alias("v"), F.get_json_object("text", "$.tags[1].at").alias("seen_at"))
    return rows.select("doc_id", "text", "v.src", "v.note", F.get("v.tags", F.lit(0)).alias("who"), "seen_at")


def query_scrub_csv(spark, sf):
    return scrub_structured(records(spark, sf, texts.CSV_RECORD, "csv")).select("doc_id", "text")


def query_scrub_xml(spark, sf):
    return scrub_structured(records(spark, sf, texts.XML_RECORD, "xml")).select("doc_id", "text")


def query_json_fallback(spark, sf):
    broken = records(spark, sf, texts.JSON_RECORD, "json").withColumn("text", F.expr("left(text, length(text) - 1)"))
    return scrub_structured(broken, formats=("json",)).select("doc_id", "fallback", "text")


def query_scrub_columns(spark, sf):
    events = spread(table(spark, sf, "events", "event_id", "user_id", "event_type"), "event_id")
    src, note, who, seen = (F.expr(leaf) for leaf in texts.LEAVES)
    rows = events.select(
        F.col("event_id").alias("doc_id"), "event_type",
        F.struct(src.alias("src"), F.array(F.struct(note.alias("note"), F.col("user_id"))).alias("notes")).alias("head"),
        F.create_map(F.lit("10.9.9.9"), F.array(who, seen)).alias("tail"),
    )
    done = scrub_columns(rows, ["head", "tail"])
    tail = F.element_at("tail", F.lit("10.9.9.9"))
    return done.select(
        "doc_id", "head.src", F.get("head.notes", F.lit(0))["note"].alias("note"),
        F.get(tail, F.lit(0)).alias("who"), F.get(tail, F.lit(1)).alias("seen_at"), F.col("event_type").alias("kept"),
    )


def query_scrub_table(spark, sf):
    customers = spread(table(spark, sf, "customer", "c_custkey"), "c_custkey")
    rows = customers.select("c_custkey", F.expr(texts.TABLE_NOTE).alias("note"), F.expr(texts.TABLE_ADDR).alias("addr"))
    done = scrub_table(rows, ["note", "addr"], "c_custkey", F.floor(F.col("c_custkey") / 64))
    return done.select("c_custkey", "note", "addr")


def query_risk_score(spark, sf):
    docs = mixed(spark, sf)
    return risk_of_table(findings_table(scan(docs, DEFAULT, "DOC")), docs).select("doc_id", "n_findings", "score")


def query_risk_band(spark, sf):
    return risk(scan(mixed(spark, sf), DEFAULT, "DOC")).select("doc_id", "score", "band", "alert")


def query_risk_code(spark, sf):
    return risk(scan(code(spark, sf), DEFAULT, "CODE"))


def query_top_findings(spark, sf):
    return report(scan(mixed(spark, sf), DEFAULT, "DOC"))


def query_risk_by_source(spark, sf):
    scanned = scan(documents(spark, sf, "source"), DEFAULT, "DOC").withColumnRenamed("source", "src")
    rated = risk(scanned.withColumn("doc_id", F.struct("doc_id", "src")))
    return rated.groupBy(F.col("doc_id.src").alias("source")).agg(
        F.count("*").alias("n_docs"), F.sum("score").alias("score"), F.max("score").alias("worst")
    )


def query_label_rollup(spark, sf):
    docs = findings_table(scan(mixed(spark, sf), DEFAULT, "DOC")).select(F.lit("DOC").alias("kind"), "label", "copies")
    srcs = findings_table(scan(sources(spark, sf), DEFAULT, "CODE")).select(F.lit("CODE").alias("kind"), "label", "copies")
    return docs.unionByName(srcs).rollup("kind", "label").agg(F.sum("copies").alias("n"))


def _stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    # a pattern, since a stream takes a path without one for a folder: tables are files or folders of them
    return spark.readStream.schema(schema).parquet(f"{sf}/{{{name}.parquet}}")


def query_stream_scrub(spark, sf):
    out = scratch_dir(spark, "stream-scrub")
    scrub_stream(_stream(spark, sf, "documents").select("doc_id", "text"), out, kind="DOC").awaitTermination()
    return spark.read.parquet(out).select("doc_id", "text")


def query_stream_risk(spark, sf):
    out = scratch_dir(spark, "stream-risk")
    records = _stream(spark, sf, "events").select("ts", F.expr(texts.RECORD_TEXT).alias("text"))
    write_risk(risk_by_window(records, "ts"), out).awaitTermination()
    return read_risk(spark, out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def query_find_email_long(spark, sf):
    """Local parts of any length, behind letters and marks that are no part of them."""
    (rule,) = [r for r in DEFAULT.rules("DOC") if r.label == "EMAIL_ADDRESS"]
    return _spans(_from_customers(spark, sf, texts.LONG_MAIL), regex_spans(F.col("text"), rule.java, rule.guard))


def query_find_location_long(spark, sf):
    """Names of up to five words from a table: sizes are those of the list."""
    nations, regions = table(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey"), table(spark, sf, "region", "r_regionkey", "r_name")
    places = nations.join(regions, nations.n_regionkey == regions.r_regionkey)
    names = places.select(F.explode(F.array(F.concat_ws(" ", "n_name", "r_name", "n_name"), F.concat_ws(" ", F.lit("lives in"), "n_name", "r_name"))).alias("value"))
    customers = spread(table(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey"), "c_custkey")
    docs = customers.join(places, customers.c_nationkey == places.n_nationkey).select(F.col("c_custkey").alias("doc_id"), F.expr(texts.PLACE_TEXT).alias("text"))
    return _listed(name_spans(docs, names.withColumn("label", F.lit("LOCATION"))), "start_at", "end_at", "snippet")


def query_allow_list_scan(spark, sf):
    """An allow-list of more entries than travel in the plan, given to the scan itself."""
    ids = spark.range(20_000).select(F.concat(F.lit("u"), F.col("id")).alias("value"))
    config = ScanConfig.from_tables(ignore=ids.union(_allowed(spark, sf)))
    return _listed(findings_table(scan(logs(spark, sf), config, "DOC")), "label", "start_at", "snippet")


def query_find_edges(spark, sf):
    """Literals that are not spelled as they read, in sources that parse only when dedented: found by their two ends."""
    docs = _from_customers(spark, sf, texts.EDGED)
    found = findings_table(scan(docs, DEFAULT, "CODE")).where(F.col("label") == "SECRET_VAR_ASSIGNMENT")
    return _listed(found, "start_at", "end_at", "snippet")


def query_csv_ragged(spark, sf):
    """Rows of different length and empty lines keep all they have."""
    docs = _from_customers(spark, sf, texts.RAGGED).select("doc_id", F.lit("csv").alias("fmt"), "text")
    return scrub_structured(docs).select("doc_id", "text")


def _mixed_formats(spark, sf):
    """One table of sources, logs, JSON, CSV and XML, told apart by path."""
    parts = [sources(spark, sf).withColumn("path", F.lit("/src/a.py")), _after(logs(spark, sf)).withColumn("path", F.lit("/log/a.log"))]
    for i, (text, fmt) in enumerate(((texts.JSON_RECORD, "json"), (texts.CSV_RECORD, "csv"), (texts.XML_RECORD, "xml")), 2):
        rows = records(spark, sf, text, fmt).select((F.col("doc_id") + i * FIRST_LOG_ID).alias("doc_id"), "text")
        parts.append(rows.withColumn("path", F.lit(f"/data/a.{fmt}")))
    return reduce(DataFrame.unionByName, parts)


def query_scrub_any(spark, sf):
    return scrub_any(_mixed_formats(spark, sf)).select("doc_id", "text", "engine")


def query_scan_any(spark, sf):
    found = findings_table(scrub_any(_mixed_formats(spark, sf)))
    return _listed(found, "leaf", "label", "start_at", "end_at", "snippet")


def query_scrub_wide(spark, sf):
    """A row of forty strings, half of them in a struct, and an array in between."""
    events = spread(table(spark, sf, "events", "event_id", "user_id", "props"), "event_id")
    leaves = [F.expr(leaf) for leaf in texts.LEAVES]
    flat = [leaves[i % 4].alias(f"c{i}") for i in range(18)]
    inner = F.struct(*(leaves[i % 4].alias(f"f{i}") for i in range(20)))
    rows = events.select(F.col("event_id").alias("doc_id"), *flat, F.array(leaves[2], leaves[0]).alias("list"), inner.alias("inner"))
    done = scrub_columns(rows, [f"c{i}" for i in range(18)] + ["list", "inner"])
    last = [F.col("inner")[f"f{i}"] for i in range(20)]
    return done.select("doc_id", F.concat_ws("|", *(f"c{i}" for i in range(18)), "list", *last).alias("text"))


def query_resolve_islands(spark, sf):
    """Overlaps resolved with a row for each finding, island by island."""
    found = island_rows(scan(mixed(spark, sf), DEFAULT, "DOC"), ["doc_id"])
    return _listed(resolve_islands(found, ["doc_id"]), "start_at", "end_at", "label")


def query_scrub_islands(spark, sf):
    """Texts rewritten block by block, from findings as rows."""
    done, _ = scrub_islands(mixed(spark, sf), DEFAULT, "DOC")
    return done.select("doc_id", "text", "engine")


def query_assign_sites_native(spark, sf):
    return native_assign_sites(sources(spark, sf), DEFAULT.suspicious).select("doc_id", "form", "name", "literal")


def query_scan_code_native(spark, sf):
    """The engine for sources without Python: assignments are found by the native lexer."""
    found = findings_table(scan(code(spark, sf), replace(DEFAULT, native_sites=True), "CODE"))
    return _listed(found, "label", "start_at", "end_at", "snippet", "priority", "copies")


def _stub_model():
    """Stands for a model that a user would load: finds the names of customers."""
    import re

    name = re.compile(r"Customer#[0-9]+")
    return lambda texts: [[(m.start(), m.end(), "PERSON") for m in name.finditer(t)] for t in texts]


def query_find_model_entity(spark, sf):
    """A user's model within a scan."""
    config = ScanConfig(model=EntityModel(_stub_model, ("PERSON",)))
    found = findings_table(scan(logs(spark, sf), config, "DOC")).where(F.col("detector") == "model")
    return _listed(found, "start_at", "end_at", "snippet")


def query_publish_vault(spark, sf):
    """Texts and vault of two runs, published together, put back from what readers see."""
    texts_at, vault_at = scratch_dir(spark, "published-texts"), scratch_dir(spark, "published-vault")
    publish_scrubbed(scrub(documents(spark, sf), DEFAULT, "DOC"), texts_at, vault_at)
    publish_scrubbed(scrub(_after(logs(spark, sf)), DEFAULT, "DOC"), texts_at, vault_at)
    return restore(published_texts(spark, texts_at).select("doc_id", "text"), published_vault(spark, texts_at, vault_at))


def query_stream_restore(spark, sf):
    """A stream of scrubbed texts joined with the vault batch by batch."""
    texts_at, vault_at, out, waiting = (scratch_dir(spark, f"stream-restore-{x}") for x in ("texts", "vault", "out", "waiting"))
    write_scrubbed(scrub(documents(spark, sf), DEFAULT, "DOC"), texts_at, vault_at)
    stream = spark.readStream.schema("doc_id bigint, text string").parquet(texts_at)
    vault = lambda: spark.read.parquet(vault_at)
    restore_stream(stream, vault, out, waiting).awaitTermination()
    return read_restored(spark, vault, stream.schema, out, waiting)


def query_custom_rules_many(spark, sf):
    """Twenty thousand rules from a table, most of which no text meets."""
    made = spark.range(20_000).select(F.concat(F.lit("R"), "id").alias("name"), F.concat(F.lit("bkt-"), "id", F.lit(r"\b")).alias("regex"), (F.col("id") % 60).cast("int").alias("score"))
    config = ScanConfig.from_tables(rules=made)
    found = findings_table(scan(logs(spark, sf), config, "DOC"))
    return _listed(found.where(F.col("label").rlike("^R[0-9]+$")), "label", "start_at", "end_at", "snippet", "weight")


def query_csv_file(spark, sf):
    """CSV files with line feeds in quoted cells, read in splits."""
    at = scratch_dir(spark, "csv-file")
    table(spark, sf, "customer", "c_custkey", "c_name", "c_mktsegment").select(F.expr(texts.CSV_LINE).alias("value")).write.text(at)
    rows = read_large_csv(spark, at)
    return rows.select(F.get("cells", F.lit(0)).cast("bigint").alias("doc_id"), F.get("cells", F.lit(1)).alias("note"), F.get("cells", F.lit(2)).alias("addr"), F.size("cells").alias("n"))


def query_read_files(spark, sf):
    """A file for each supplier, read as documents and scrubbed; line ends of any kind are line feeds."""
    at = scratch_dir(spark, "read-files")
    suppliers = table(spark, sf, "supplier", "s_suppkey", "s_name").withColumn("_line", F.monotonically_increasing_id())
    # every core writes files; those of one key stay together, in the order of the table
    dealt = suppliers.repartition(spark.sparkContext.defaultParallelism, "s_suppkey").sortWithinPartitions("s_suppkey", "_line")
    dealt.select("s_suppkey", F.expr(texts.FILE_TEXT).alias("value")).write.partitionBy("s_suppkey").text(at)
    docs = read_documents(spark, at, strict=True, recursiveFileLookup="true", pathGlobFilter="*.txt")
    key = F.regexp_extract("path", "s_suppkey=([0-9]+)", 1).cast("bigint").alias("s_suppkey")
    return scrub(docs.withColumn("s_suppkey", key), DEFAULT, "DOC").select("s_suppkey", "kind", "fmt", "text", "error")


FIND: dict[str, tuple] = {
    "find_ipv4": (documents, "IPV4"), "find_ipv6": (logs, "IPV6", "CODE"), "find_bearer": (logs, "AUTH_BEARER"),
    "find_aws_key": (mixed, "AWS_KEY"), "find_s3": (logs, "S3_BUCKET"), "find_stripe": (logs, "STRIPE_KEY"),
    "find_card": (documents, "CREDIT_CARD_REGEX"), "find_zip": (mixed, "US_ZIP"), "find_street": (logs, "STREET_ADDRESS"),
    "find_token": (logs, "GENERIC_TOKEN"), "find_user": (logs, "USERNAME"), "find_email": (mixed, "EMAIL_ADDRESS"),
    "find_phone": (mixed, "PHONE_NUMBER"), "find_ssn": (logs, "US_SSN"), "find_ip_entity": (mixed, "IP_ADDRESS"),
}


def queries() -> dict[str, Query]:
    found = {key: find(*spec) for key, spec in FIND.items()}
    named = {name.removeprefix("query_"): fn for name, fn in globals().items() if name.startswith("query_")}
    return {**named, **found}
