"""The registered queries: every operator over the supplied test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from correctionlab.functions import fixed_values as V
from correctionlab.operators import access, catalogue, decisions, documents, patterns, reports
from correctionlab.operators import responses, rules, training
from correctionlab.plans.export import corrected_documents, edited_and_whole, located_edits
from correctionlab.plans.sizing import broadcast_within, cut_lineage, dealt, scratch_path, shuffles_cleared, tasks_for
from correctionlab.sources import fixtures as fx
from correctionlab.sources import containers, readers, sqlite, writers
from correctionlab.streaming import access as access_streams
from correctionlab.streaming import decisions as decision_streams
from correctionlab.streaming import learning as learning_streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- learning loop ----------------------------------------------------------------


@query
def correction_patterns(spark, sf_dir):
    return patterns.correction_patterns(fx.diffs(spark, sf_dir))


_PATTERN_COLUMNS = (
    "id", "instrument", "difference_type", "pattern_type", "era", "pattern_description", "occurrence_count",
    "accept_count", "reject_count", "edit_count", "accept_count_exact", "confidence_threshold",
    "created_at", "updated_at",
)


@query
def knowledge_merge(spark, sf_dir):
    return fx.current_patterns(spark, sf_dir).select(*_PATTERN_COLUMNS, "change")


@query
def patterns_listing(spark, sf_dir):
    return patterns.patterns_listing(fx.current_patterns(spark, sf_dir)).select(*_PATTERN_COLUMNS)


@query
def promote_rules(spark, sf_dir):
    return fx.current_rules(spark, sf_dir)


@query
def active_rules(spark, sf_dir):
    return rules.active_rules(fx.current_rules(spark, sf_dir))


@query
def rule_details(spark, sf_dir):
    return rules.rule_details(fx.current_rules(spark, sf_dir))


def _candidates(spark, sf_dir):
    known = cut_lineage(fx.current_patterns(spark, sf_dir), "patterns")
    current = rules.promote_rules(known, fx.earlier_rules(spark, sf_dir), fx.as_of())
    return broadcast_within(cut_lineage(rules.rule_candidates(current, known), "candidates"))


@query
def auto_accept_assign(spark, sf_dir):
    with_era = reports.diff_context(fx.diffs(spark, sf_dir), fx.scores(spark, sf_dir))
    return rules.auto_accept(with_era, _candidates(spark, sf_dir)).select(
        "id", "score_id", "auto_accepted", "auto_accept_rule_id"
    )


@query
def auto_accept_semi(spark, sf_dir):
    waiting = fx.diffs(spark, sf_dir).where("human_decision is null")
    matched = rules.auto_accept(waiting, _candidates(spark, sf_dir)).where("auto_accepted")
    return matched.select("id", "instrument", "difference_type")


@query
def top_patterns(spark, sf_dir):
    return patterns.top_patterns(fx.current_patterns(spark, sf_dir))


@query
def suggestions(spark, sf_dir):
    return patterns.suggestions(fx.current_patterns(spark, sf_dir))


@query
def chart_rows(spark, sf_dir):
    return patterns.chart_rows(patterns.top_patterns(fx.current_patterns(spark, sf_dir)))


# --- report and listings --------------------------------------------------------------


@query
def report_totals(spark, sf_dir):
    return reports.report_totals(
        fx.diffs(spark, sf_dir), fx.scores(spark, sf_dir), fx.current_rules(spark, sf_dir)
    )


@query
def weekly_oldest(spark, sf_dir):
    return reports.weekly_trends(fx.diffs(spark, sf_dir), "oldest")


@query
def weekly_latest(spark, sf_dir):
    return reports.weekly_trends(fx.diffs(spark, sf_dir), "latest")


@query
def review_progress(spark, sf_dir):
    return reports.review_progress(fx.diffs(spark, sf_dir))


@query
def confidence_bands(spark, sf_dir):
    return reports.confidence_bands(fx.diffs(spark, sf_dir))


@query
def export_status(spark, sf_dir):
    return reports.export_status(fx.scores(spark, sf_dir))


@query
def scores_listing(spark, sf_dir):
    return reports.scores_listing(fx.scores(spark, sf_dir)).select(
        "id", "title", "composer", "era", "status", "created_at"
    )


@query
def score_status(spark, sf_dir):
    wanted = fx.table(spark, sf_dir, "events").select(
        F.expr("cast(2 * event_id as string)").alias("score_id")
    )
    return reports.score_status(fx.scores(spark, sf_dir), wanted)


@query
def diffs_of_score(spark, sf_dir):
    in_review = fx.scores(spark, sf_dir).where("status = 'review'").select(F.col("id").alias("score_id"))
    return reports.diffs_of_scores(fx.diffs(spark, sf_dir), in_review).select(
        "score_id", "measure_number", "id", "difference_type"
    )


@query
def prompt_performance(spark, sf_dir):
    return reports.prompt_performance(fx.prompt_versions(spark, sf_dir))


@query
def diff_context(spark, sf_dir):
    return reports.diff_context(fx.diffs(spark, sf_dir), fx.scores(spark, sf_dir)).select(
        "id", "score_id", "title", "composer", "era"
    )


@query
def score_era(spark, sf_dir):
    return fx.scores(spark, sf_dir).select("id", "composer", "year", "era")


# --- decisions -----------------------------------------------------------------------


@query
def decided_diffs(spark, sf_dir):
    return decisions.decided_diffs(fx.diffs(spark, sf_dir)).select(
        "id", "score_id", "human_decision", "human_edit_value", "human_reviewed_at"
    )


@query
def review_buckets(spark, sf_dir):
    return decisions.review_buckets(fx.diffs(spark, sf_dir)).select("bucket", "id", "score_id")


@query
def valid_decisions(spark, sf_dir):
    good, bad = decisions.validate_decisions(fx.decision_log(spark, sf_dir))
    columns = ("diff_id", "event_id", "kind", "decision")
    return good.select(*columns, F.lit(True).alias("valid")).unionByName(
        bad.select(*columns, F.lit(False).alias("valid"))
    )


@query
def apply_decisions(spark, sf_dir):
    return decisions.apply_decisions(fx.diffs(spark, sf_dir), fx.decision_log(spark, sf_dir)).select(
        "id", "human_decision", "human_edit_value", "human_reviewed_at"
    )


@query
def bulk_decide(spark, sf_dir):
    return decisions.bulk_decide(
        fx.diffs(spark, sf_dir), fx.bulk_requests(spark, sf_dir), fx.as_of()
    ).select("id", "human_decision", "human_edit_value", "human_reviewed_at")


@query
def bulk_updated_counts(spark, sf_dir):
    return decisions.bulk_updated_counts(fx.diffs(spark, sf_dir), fx.bulk_requests(spark, sf_dir))


@query
def cascade_delete(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "lineitem")
    tasks = tasks_for(spark, lines.count())
    scores, diffs = fx.scores(spark, sf_dir), fx.diffs(spark, sf_dir, dealt(lines, tasks, "l_partkey"))
    dataset = training.eligible(diffs).select(F.col("id").alias("flagged_diff_id"))
    gone = scores.where("status = 'processing'").select(F.col("id").alias("score_id"))
    kept = decisions.delete_scores(scores, diffs, dataset, gone, tasks)
    keys = ("id", "id", "flagged_diff_id")
    named = [
        df.select(F.lit(name).alias("table_name"), F.col(key).alias("id"))
        for name, df, key in zip(("scores", "diffs", "finetuning_dataset"), kept, keys)
    ]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query
def scores_without_diffs(spark, sf_dir):
    return decisions.scores_without_diffs(fx.scores(spark, sf_dir), fx.diffs(spark, sf_dir)).select(
        "id", "title"
    )


# --- training export -------------------------------------------------------------------


@query
def finetuning_rows(spark, sf_dir):
    return training.finetuning_rows(fx.diffs(spark, sf_dir), fx.as_of())


@query
def finetuning_hash_split(spark, sf_dir):
    """How many rows the split by key alone gives to each side, and that it depends on the key alone."""
    rows = training.finetuning_rows(fx.diffs(spark, sf_dir), fx.as_of(), mode="hash").select("flagged_diff_id", "split")
    fewer = training.finetuning_rows(fx.diffs(spark, sf_dir).where("measure_number > 2"), fx.as_of(), mode="hash").select("flagged_diff_id", F.col("split").alias("again"))
    joined = rows.join(fewer, "flagged_diff_id", "left")
    total = F.count(F.lit(1))
    share = lambda s, low, high: (F.avg((F.col("split") == s).cast("int")).between(low, high)).alias(f"{s}_fits")
    return joined.agg(total.alias("rows"), F.count("again").alias("compared"), F.count_if(F.col("split") != F.col("again")).alias("moved"),
                      share("train", 0.77, 0.83), share("val", 0.08, 0.12), share("test", 0.08, 0.12))


@query
def append_finetuning(spark, sf_dir):
    before = F.lit(fx.EARLIER).cast("timestamp_ntz")
    early = fx.diffs(spark, sf_dir).where(F.col("created_at") < before)
    existing = training.finetuning_rows(early, before)
    new = training.finetuning_rows(fx.diffs(spark, sf_dir), fx.as_of())
    return training.append_finetuning(existing, new)


@query
def training_records(spark, sf_dir):
    return training.training_records(fx.diffs(spark, sf_dir)).select(
        "id",
        F.to_json(
            F.struct("image_path", "label", "metadata"), {"ignoreNullFields": "false"}
        ).alias("record"),
    )


# --- answers and logs --------------------------------------------------------------------


@query
def pair_pages(spark, sf_dir):
    return responses.pair_pages(*fx.page_images(spark, sf_dir))


@query
def comparison_prompts(spark, sf_dir):
    pairs = responses.pair_pages(*fx.page_images(spark, sf_dir)).select("score_id", "page_no")
    prompts = responses.comparison_prompts(pairs, fx.scores(spark, sf_dir))
    return prompts.select(
        "score_id", "page_no", F.md5("prompt").alias("prompt_md5"),
        F.length("prompt").cast("bigint").alias("prompt_length"),
    )


@query
def parse_responses(spark, sf_dir):
    return responses.parse_responses(fx.model_responses(spark, sf_dir))


@query
def log_confidence(spark, sf_dir):
    return responses.log_confidence(fx.recogniser_logs(spark, sf_dir))


@query
def new_diffs(spark, sf_dir):
    parsed = responses.parse_responses(fx.model_responses(spark, sf_dir))
    confidences = responses.log_confidence(fx.recogniser_logs(spark, sf_dir))
    return responses.new_diffs(parsed, confidences, fx.as_of()).drop(
        "human_decision", "human_edit_value", "human_reviewed_at", "auto_accept_rule_id"
    )


# --- catalogue -----------------------------------------------------------------------------

# the test pages have no score links or wiki layout, so rules and layout name what they do have
PAGE_RULES = catalogue.LinkRules(
    row_tag="nav", row_class=None, gateway="an", suffix="e", image_pattern="(?i)th.*n"
)
PAGE_LAYOUT = catalogue.PageLayout(body_tag="article", body_class=None)


@query
def page_links(spark, sf_dir):
    return catalogue.page_links(fx.pages(spark, sf_dir), PAGE_RULES)


@query
def page_metadata(spark, sf_dir):
    return catalogue.page_metadata(fx.pages(spark, sf_dir), PAGE_LAYOUT)


@query
def page_composers(spark, sf_dir):
    """Composers from infobox, heading and categories, in that order."""
    return catalogue.page_metadata(fx.work_pages(spark, sf_dir), PAGE_LAYOUT).select("page_id", "composer", "era")


@query
def url_file_names(spark, sf_dir):
    return catalogue.url_file_names(fx.pages(spark, sf_dir))


# --- access and payments ---------------------------------------------------------------------


@query
def access_check(spark, sf_dir):
    return access.has_access(
        fx.access_requests(spark, sf_dir), fx.users(spark, sf_dir), fx.score_access(spark, sf_dir),
        fx.ADMIN_EMAILS,
    )


@query
def entitlements(spark, sf_dir):
    return access.entitlements(
        fx.access_requests(spark, sf_dir), fx.users(spark, sf_dir), fx.score_access(spark, sf_dir),
        fx.ADMIN_EMAILS,
    )


@query
def reconcile_payments(spark, sf_dir):
    completed = access.completions(fx.payment_bodies(spark, sf_dir))
    return access.reconcile_payments(fx.payments(spark, sf_dir), completed)


@query
def grant_access(spark, sf_dir):
    completed = access.completions(fx.payment_bodies(spark, sf_dir))
    return access.grant_access(fx.score_access(spark, sf_dir), completed)


@query
def rate_limit_windows(spark, sf_dir):
    return access.over_limit(fx.request_log(spark, sf_dir), 2, "1 hour")


@query
def request_limits(spark, sf_dir):
    """The limits of the service; a few busy clients, each event a request for one action."""
    return access.over_request_limits(fx.action_requests(fx.table(spark, sf_dir, "events")))


# --- documents -------------------------------------------------------------------------------


@query
def file_types(spark, sf_dir):
    return readers.describe_files(fx.uploads(spark, sf_dir)).drop("content")


@query
def measure_counts(spark, sf_dir):
    return documents.measure_counts(fx.measures(spark, sf_dir))


@query
def measures_per_part(spark, sf_dir):
    return documents.measures_per_part(fx.measures(spark, sf_dir))


def _measure_tasks(spark, sf_dir):
    return tasks_for(spark, 18 * fx.table(spark, sf_dir, "orders").count())


@query
def locate_edits(spark, sf_dir):
    return located_edits(
        fx.diffs(spark, sf_dir), fx.parts(spark, sf_dir), fx.measures(spark, sf_dir), _measure_tasks(spark, sf_dir)
    ).select("id", "score_id", "part_id", "matched_by_name", "measure_seq")


def _corrected(spark, sf_dir):
    measures = fx.measures(spark, sf_dir)
    tasks = _measure_tasks(spark, sf_dir)
    located = located_edits(fx.diffs(spark, sf_dir), fx.parts(spark, sf_dir), measures, tasks)
    return documents.apply_edits(measures, located, tasks=tasks)


@query
def apply_edits(spark, sf_dir):
    return _corrected(spark, sf_dir).select("score_id", "part_id", "measure_seq", "measure_number", "xml", "edited")


def _shredded(spark, sf_dir, *kinds):
    return readers.shred(fx.documents(spark, sf_dir), kinds or None)


@query
def documents_of_files(spark, sf_dir):
    """Plain files, files in two-byte characters and archives, through unpacking and decoding."""
    return readers.documents_from_files(readers.unpack_archives(fx.document_files(spark, sf_dir)))


@query
def shred_parts(spark, sf_dir):
    return readers.parts_of(_shredded(spark, sf_dir, "part")).drop("groups_before", "groups_after")


@query
def shred_measures(spark, sf_dir):
    return readers.measures_of(_shredded(spark, sf_dir, "measure"))


@query
def malformed_documents(spark, sf_dir):
    return readers.errors_of(_shredded(spark, sf_dir, "error")).select("score_id")


@query
def corrected_lines(spark, sf_dir):
    """The whole export: every document, edited or as it is, as lines."""
    return corrected_documents(fx.documents(spark, sf_dir), fx.diffs(spark, sf_dir))[0]


@query
def document_containers(spark, sf_dir):
    """The whole export in container files, each document read back by its stretches of text.

    Only the lines of edited documents are sorted. They are written first: the range sort draws its sample from them, and would make them
    all once more for it. A document in one piece, as nearly all are, is read and digested by the task that has its index row.
    Shuffles of a step go when the step is written.
    """
    folder, key = scratch_path(spark, "containers"), ["score_id"]
    with shuffles_cleared(spark):
        lines, whole, _, _ = edited_and_whole(fx.documents(spark, sf_dir), fx.diffs(spark, sf_dir))
        lines = cut_lineage(lines, "lines")
        index = containers.write_containers(
            lines, folder, key, ["section", "seq"], whole, compressed=True, tasks=tasks_for(spark, lines.count()))
    alone = containers.read_pieces(index.where("not joined"), folder).select(
        *key, F.col("length").alias("bytes"), F.md5("content").alias("content_md5"))
    pieces = containers.read_pieces(index.where("joined"), folder).groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct(*containers.PLACE, "content"))).alias("pieces"), F.sum("length").alias("bytes"))
    return alone.unionByName(pieces.select(*key, "bytes", F.md5(F.array_join("pieces.content", "")).alias("content_md5")))


@query
def part_document_lines(spark, sf_dir):
    pieces = cut_lineage(_shredded(spark, sf_dir), "pieces", "kind")
    return documents.extract_parts(
        readers.heads_of(pieces), readers.parts_of(pieces), readers.measures_of(pieces)
    )


@query
def document_metadata(spark, sf_dir):
    return documents.document_metadata(readers.inspect(fx.documents(spark, sf_dir)))


@query
def document_validity(spark, sf_dir):
    return documents.validate_documents(readers.inspect(fx.documents(spark, sf_dir)))


@query
def pdf_validity(spark, sf_dir):
    return documents.validate_pdfs(fx.uploads(spark, sf_dir))


@query
def webhook_files(spark, sf_dir):
    """Webhook bodies written as JSON lines and read back."""
    folder = scratch_path(spark, "webhooks")
    fx.webhook_payloads(fx.table(spark, sf_dir, "events")).write.json(folder)
    return readers.read_webhooks(spark, folder).select("event_id", F.md5("body").alias("body_md5"))


@query
def inject_headers(spark, sf_dir):
    injected = documents.inject_headers(
        fx.engraving_sources(spark, sf_dir), fx.engraving_metadata(spark, sf_dir), "doc_id"
    )
    return injected.select("doc_id", "injected", F.md5("content").alias("content_md5"))


SQLITE_ROWS = 500_000  # at most in a file, about: a task writes one, so more rows make more files


@query
def sqlite_tables(spark, sf_dir):
    """Diffs written to SQLite files and read back in ranges of row ids; conditions run in SQLite."""
    folder = scratch_path(spark, "sqlite")
    kept = ("id", "score_id", "measure_number", "difference_type", "omr_confidence", "auto_accepted", "human_decision", "human_reviewed_at")
    files = max(8, -(-fx.table(spark, sf_dir, "lineitem").count() // SQLITE_ROWS))
    sqlite.write_sqlite(fx.diffs(spark, sf_dir).select(*kept).repartition(files), folder, "diffs")
    where = [("measure_number", ">=", 2), ("difference_type", "in", ["note", "rhythm", "slur"]), ("human_decision", "not null")]
    return sqlite.load_sqlite(spark, folder, "diffs", where=where, rowsPerPartition="20000")


# --- streams: each runs over the whole table until nothing is left ------------------------------


@query
def stream_latest_decisions(spark, sf_dir):
    """The log arrives three times, out of order, and the query starts anew for each.

    All files of an arrival are one micro-batch: a batch joins its events with all diffs, so the number of batches must not grow with the files.
    """
    root = scratch_path(spark, "stream-decisions")
    events = fx.table(spark, sf_dir, "events")

    def decide():
        arriving = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        log = fx.decision_log(spark, sf_dir, arriving)
        decision_streams.start_latest_decisions(log, f"{root}/out", f"{root}/checkpoint").awaitTermination()

    for k in (2, 0, 1):
        events.where(F.col("event_id") % 3 == k).write.parquet(f"{root}/in/{k}")
        decide()
        if k == 2:
            decision_streams.compact_decisions(spark, f"{root}/out")
    latest = decision_streams.read_latest_decisions(spark, f"{root}/out")
    return decisions.with_latest(fx.diffs(spark, sf_dir), latest).select(
        "id", "human_decision", "human_edit_value", "human_reviewed_at"
    )


@query
def stream_learning(spark, sf_dir):
    """Reviewed diffs arrive three times, by measure number; each arrival is one micro-batch, in however many files it comes.

    A rule stays once it is made, so which batches there are matters: the SQL learns from the same three.
    """
    root = scratch_path(spark, "stream-learning")
    lines = fx.table(spark, sf_dir, "lineitem")
    for k in range(3):
        lines.where(F.col("l_linenumber") % 3 == k).write.parquet(f"{root}/in/{k}")
        arriving = spark.readStream.schema(lines.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        reviewed = fx.diffs(spark, sf_dir, arriving).select("instrument", "difference_type", "human_decision")
        learning_streams.start_learning(
            reviewed, f"{root}/state", f"{root}/checkpoint", lambda batch_id: fx.as_of()
        ).awaitTermination()
    return writers.read_snapshot(spark, f"{root}/state/rules")


@query
def stream_auto_accept(spark, sf_dir):
    """Rules are promoted while diffs arrive: none at first, then those of every other type, then all. An arrival is one micro-batch."""
    root = scratch_path(spark, "stream-accept")
    all_rules = _candidates(spark, sf_dir)
    lines = fx.table(spark, sf_dir, "lineitem")

    def match():
        arriving = spark.readStream.schema(lines.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        waiting = fx.diffs(spark, sf_dir, arriving).where("human_decision is null").select(
            "id", "instrument", "difference_type", "omr_confidence", "vision_confidence"
        )
        learning_streams.start_live_accept(waiting, f"{root}/state", f"{root}/checkpoint").awaitTermination()

    for k in range(3):
        if k:
            some = all_rules if k == 2 else all_rules.where(F.crc32("difference_type") % 2 == 0)
            learning_streams.publish_rules(some, f"{root}/state", k)
        lines.where(F.col("l_orderkey") % 3 == k).write.parquet(f"{root}/in/{k}")
        match()
    return learning_streams.matches_now(spark, f"{root}/state").where("auto_accepted").select(
        "id", "instrument", "difference_type"
    )


@query
def stream_settlement(spark, sf_dir):
    root = scratch_path(spark, "stream-settlement")
    state = f"{root}/state"
    access_streams.start_books(fx.payments(spark, sf_dir), fx.score_access(spark, sf_dir), state)
    # three arrivals in an order of their own, each a micro-batch, so that completions come weeks after later ones, and repeats in other
    # batches; the books are folded before the last
    events = fx.table(spark, sf_dir, "events")

    def settle():
        arrived = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        access_streams.start_settlement(fx.webhook_payloads(arrived), state, f"{root}/checkpoint").awaitTermination()

    for k, part in enumerate((events.where("event_id % 3 <> 0"), events.where("event_id % 3 = 0"), events.where("event_id % 5 = 0"))):
        if k == 2:
            access_streams.compact_books(spark, state)
        part.write.parquet(f"{root}/in/{k}")
        settle()
    paid, granted = access_streams.payments_now(spark, state), access_streams.score_access_now(spark, state)
    return paid.select(
        F.lit("payment").alias("kind"), "user_id", "score_id", "status", "payment_intent"
    ).unionByName(granted.select(
        F.lit("grant").alias("kind"), "user_id", "score_id", F.lit("granted").alias("status"),
        F.lit(None).cast("string").alias("payment_intent"),
    ))


@query
def stream_request_limits(spark, sf_dir):
    """All three limits in one operator; events arrive by time in three runs of the query."""
    root = scratch_path(spark, "stream-request-limits")
    events = fx.table(spark, sf_dir, "events")

    def count():
        arriving = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        access_streams.start_over_request_limits(fx.action_requests(arriving), "0 seconds", f"{root}/out", f"{root}/checkpoint").awaitTermination()

    for k in range(3):
        events.where(F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2)) == k).write.parquet(f"{root}/in/{k}")
        count()
    return spark.read.parquet(f"{root}/out").select(
        "action", "client", F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "requests")


@query
def stream_rate_limits(spark, sf_dir):
    root = scratch_path(spark, "stream-limits")
    requests = fx.table_stream(spark, sf_dir, "events").select(F.col("user_id").alias("client"), "ts")
    access_streams.start_over_limit(
        requests, 1, "1 hour", "10 minutes", f"{root}/out", f"{root}/checkpoint"
    ).awaitTermination()
    return spark.read.parquet(f"{root}/out").select(
        "client",
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        F.col("window_end").cast("timestamp_ntz").alias("window_end"),
        "requests",
    )
