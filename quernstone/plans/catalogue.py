"""The query catalogue: each operator on the driver's tables, with the same query in SQL.

The tables stand in for the engine's own: ``embeddings`` for index points and queries
(queries are the rows whose vec_id is divisible by 50, so they grow with the table), ``conversations`` for threads,
``documents`` for parsed records, ``pages`` for HTML bodies, ``events`` for model calls,
JSON answers and upserts, the star schema for the relational export.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import cost, encoders, text
from quernstone.functions.ids import uuid5
from quernstone.operators import completion, evaluate, export, index, quality, sampling, search, validate
from quernstone.sources import documents, tickets
from quernstone.streaming.incremental import activity, file_stream, keep_activity
from quernstone.tables import new_path

K, EVERY, MIN_SCORE = 5, 50, 0.30
#: Escape phrases for the four languages of ``documents``.
PHRASES = ("the", "les", "und", "que")
VOCABULARY = ("view", "click", "purchase")
#: Prices of the events' invented models.
PRICES = (("added", "north", 0.90, 4.20), ("inside", "south", 2.20, 11.00), ("inside", "east", 0.60, 3.10), ("own", "west", 0.00, 0.00))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- retrieval -------------------------------------------------------------------------


def vectors(spark: SparkSession, sf_dir: str, part: Column | None = None) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    return search.space(df, "vec_id", F.col("embedding") if part is None else part, "label")


def asked(corpus: DataFrame) -> DataFrame:
    return corpus.where(F.col("id") % EVERY == 0)


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = vectors(spark, sf_dir)
    return search.nearest(asked(corpus), corpus, K)


def expected(spark: SparkSession, sf_dir: str, part: Column) -> DataFrame:
    """query_id, label, expected_id: the record that a query should find is the nearest one
    by ``part`` of the vector, so that a search by another part finds it now and then."""
    corpus = vectors(spark, sf_dir, part)
    found = search.nearest(asked(corpus), corpus, 1)
    return asked(corpus).select(F.col("id").alias("query_id"), "label").join(found.select("query_id", F.col("id").alias("expected_id")), "query_id", "left")


def half(begin: int) -> Column:
    return F.slice("embedding", begin, 32)


def search_topk(spark, sf_dir):
    return hits(spark, sf_dir).select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def search_threshold(spark, sf_dir):
    return search.split_at(asked(vectors(spark, sf_dir)), hits(spark, sf_dir), MIN_SCORE)


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = vectors(spark, sf_dir)
    return search.rank_of(expected(spark, sf_dir, half(1)), asked(corpus), corpus)


def found_in_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank_in(expected(spark, sf_dir, half(1)), hits(spark, sf_dir))


def rank_full(spark, sf_dir):
    return ranked(spark, sf_dir).select("query_id", "expected_id", "rank")


def rank_topk_miss(spark, sf_dir):
    return found_in_top(spark, sf_dir).select("query_id", "expected_id", "rank")


def recall_curve(spark, sf_dir):
    ranks = ranked(spark, sf_dir).withColumn("parity", F.col("query_id") % 2)
    curve = evaluate.recall_curve(ranks, 10, ["label", "parity"])
    return curve.select("grouping", *[F.coalesce(F.col(c).cast("string"), F.lit("all")).alias(c) for c in ("label", "parity")], "k", "n", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


def by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of the nearest record by the whole vector in two spaces: the vector's halves."""

    def one(mode: str, begin: int) -> DataFrame:
        corpus = vectors(spark, sf_dir, half(begin))
        return search.rank_of(wanted, asked(corpus), corpus).withColumn("mode", F.lit(mode))

    wanted = expected(spark, sf_dir, F.col("embedding"))
    return one("problem", 1).unionByName(one("sts", 33))


FIGURES = ("recall_1", "recall_3", "recall_k", "mrr")


def modes_compare(spark, sf_dir):
    return evaluate.mode_row(by_mode(spark, sf_dir), K).select("mode", *[F.round(c, 6).alias(c) for c in FIGURES])


def mode_table(spark, sf_dir):
    ranks = by_mode(spark, sf_dir).withColumn("input", F.when(F.col("query_id") % 100 == 0, "even").otherwise("odd"))
    return evaluate.mode_table(ranks, "input", K).select("input", "mode", *[F.round(c, 6).alias(c) for c in FIGURES])


def mode_deltas(spark, sf_dir):
    rows = evaluate.mode_deltas(evaluate.mode_row(by_mode(spark, sf_dir), K), "problem", "sts")
    return rows.select(*[F.round(c, 6).alias(c) for c in rows.columns])


def missed_queries(spark, sf_dir):
    return evaluate.missed(found_in_top(spark, sf_dir))


def search_responses(spark, sf_dir):
    """Hits with the fields of the document of the same id."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ticket_id"), F.lit("").alias("date"), F.col("lang").alias("component"), *[F.lit(None).cast("string").alias(f) for f in search.HIT_FIELDS[2:]])
    queries = asked(vectors(spark, sf_dir)).select(F.col("id").alias("query_id"), F.concat(F.lit("label "), "label").alias("problem"), F.lit("brak").alias("cause"))
    rows = search.responses(queries, hits(spark, sf_dir), docs, MIN_SCORE)
    hit = lambda h: F.concat_ws(":", h["ticket_id"], F.round(h["score"], 4).cast("decimal(10,4)").cast("string"), h["component"])
    return rows.select("query_id", F.to_json("query").alias("query"), F.array_join(F.transform("hits", hit), " ").alias("hits"), "dropped_below_threshold")


def families(spark, sf_dir):
    """Correct scores of the golden queries, best scores of the distractors."""
    corpus = vectors(spark, sf_dir)
    golden = asked(corpus).where("label <> 9")
    found = search.rank_in(expected(spark, sf_dir, half(1)).where("label <> 9"), search.nearest(golden, corpus, K))
    apart = search.nearest(asked(corpus).where("label = 9"), corpus.where("label <> 9"), K)
    silent = asked(corpus).where("label = 9").select(F.col("id").alias("query_id")).join(apart.groupBy("query_id").agg(F.max("score").alias("best")), "query_id", "left")
    return found.select("query_id", "score"), silent, apart


def threshold_sweep(spark, sf_dir):
    correct, silent, _ = families(spark, sf_dir)
    rows = evaluate.threshold_sweep(correct, silent)
    return rows.select("threshold", "kept", F.round("kept_percent", 6).alias("kept_percent"), "cut", "silenced", F.round("silenced_percent", 6).alias("silenced_percent"))


def lost_hits(spark, sf_dir):
    return evaluate.lost_at(families(spark, sf_dir)[0], search.SCORE_MIN)[0].select("query_id", F.round("score", 6).alias("score"))


def distractor_detail(spark, sf_dir):
    rows = evaluate.distractor_detail(families(spark, sf_dir)[2], MIN_SCORE)
    return rows.select("query_id", F.array_join(F.transform("scores", lambda s: F.format_string("%.4f", s)), " ").alias("scores"), "passing", "verdict")


def both_series(spark, sf_dir):
    correct, _, apart = families(spark, sf_dir)
    tagged = correct.where("score is not null").select(F.lit("golden").alias("series"), "score")
    return tagged.unionByName(apart.select(F.lit("distractor").alias("series"), "score")).withColumn("score", F.round("score", 6))


def score_distribution(spark, sf_dir):
    rows = evaluate.distribution(both_series(spark, sf_dir))
    return rows.withColumn("median", F.round("median", 6))


def score_histogram(spark, sf_dir):
    rows = evaluate.histogram(both_series(spark, sf_dir))
    return rows.withColumn("share", F.round("share", 6))


# --- text ------------------------------------------------------------------------------


def strip_html_canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("body"))


def strip_html_sampling(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html_to_measure(F.col("html")).alias("body"))


def html_entities(spark, sf_dir):
    """The references of each page in order, and what they stand for. (All HTML5 names are
    decoded in the unit tests.)"""
    found = F.regexp_extract_all("html", F.lit("&#?[A-Za-z0-9]+;"), F.lit(0))
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("place", "reference"))
    return rows.select("page_id", "place", "reference", text.unescape(F.col("reference")).alias("text"))


def html_numbers(spark, sf_dir):
    n = F.col("event_id") % 50000 + 160
    return table(spark, sf_dir, "events").select("event_id", text.unescape(F.concat(F.lit("&#"), n.cast("string"), F.lit(";.&#x"), F.hex(n), F.lit("; &;"))).alias("text"))


def clipped_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clipped(F.col("text"), 60).alias("text"))


def strip_answer(spark, sf_dir):
    """Answers in a code fence, bare again."""
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return table(spark, sf_dir, "events").select("event_id", text.strip_fence(fenced).alias("answer"))


def median_length(spark, sf_dir):
    return evaluate.median_length(table(spark, sf_dir, "documents"), "text")


def too_long(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return sampling.too_long(docs, F.length("text"), 2048).select("doc_id")


def threads(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    body = F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("body")
    comment = F.when(F.col("turn") > 0, F.struct("turn", F.lit("zwyczajny").alias("kind"), F.col("role"), F.col("turn").cast("string").alias("created_at"), F.col("text").alias("body")))
    return turns.groupBy("conv_id").agg(body, F.sort_array(F.collect_list(comment)).alias("comments"))


def render_thread(spark, sf_dir):
    thread = text.render_thread(F.col("conv_id").cast("string"), F.lit("2024-01-01").cast("date"), F.lit("rozmowa"), F.col("body"), F.col("comments"))
    return threads(spark, sf_dir).select("conv_id", thread.alias("thread"))


def thread_budget(spark, sf_dir):
    rows = threads(spark, sf_dir).withColumn("chars", text.thread_chars(F.col("body"), F.col("comments")))
    return rows.select("conv_id", "chars", sampling.fits(F.col("chars"), F.lit(500), 1024, 256).alias("fits"))


def embedding_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.embedding_text(F.col("lang"), F.col("text")).alias("embedded"))


def format_duration(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.format_duration(F.col("value") * 37).alias("took"))


# --- quality, sampling -----------------------------------------------------------------


def judged(spark, sf_dir):
    return quality.verdicts(table(spark, sf_dir, "documents"), "text", {"no_resolution": quality.no_resolution(PHRASES)})


def quality_verdicts(spark, sf_dir):
    return judged(spark, sf_dir).select("doc_id", "keep", F.get("hits", F.lit(0))["rule"].alias("rule"), F.get("hits", F.lit(0))["evidence"].alias("evidence"))


def quality_report(spark, sf_dir):
    return quality.by_reason(judged(spark, sf_dir))


def ids_for_rule(spark, sf_dir):
    return quality.ids_for(judged(spark, sf_dir), "no_resolution", "doc_id")


def rule_drops(spark, sf_dir):
    """Drops by two rules that may both hit, with the first ids of each."""
    rules = {"no_resolution": quality.no_resolution(PHRASES, 60), "listing": lambda t: F.when(t.contains("\n"), text.evidence(t, 20))}
    rows = quality.dropped_ids(quality.verdicts(table(spark, sf_dir, "documents"), "text", rules), "doc_id")
    return rows.select("rule", "dropped", F.array_join(F.transform("shown", lambda i: i.cast("string")), " ").alias("shown"), "more")


def index_report(spark, sf_dir):
    return quality.report(judged(spark, sf_dir)).withColumn("drop_rate", F.round("drop_rate", 6)).withColumn("warning", F.col("warning").isNotNull())


def filter_vs_labels(spark, sf_dir):
    return quality.agreement(judged(spark, sf_dir), table(spark, sf_dir, "labels").where("quality = 0"), "doc_id")


def not_yet_processed(spark, sf_dir):
    return sampling.not_done(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


def kept_semi(spark, sf_dir):
    return quality.kept(table(spark, sf_dir, "documents"), judged(spark, sf_dir), "doc_id").select("doc_id", "lang")


def stratified_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("length(text) > 50")
    return sampling.stratified(rows, "lang", "doc_id", 200)


def sample_report(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("length(text) > 50")
    report = sampling.sample_report(rows, sampling.stratified(rows, "lang", "doc_id", 200), "lang", "doc_id")
    return report.select("lang", "size", "picked", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


# --- export, validation, cost, index ---------------------------------------------------


def exported(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    orders = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    lines = t("lineitem").withColumn("o_orderkey", F.col("l_orderkey"))
    return export.nested(orders, lines, "o_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], ["l_quantity"], "lines")


def export_nested(spark, sf_dir):
    line = lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"], x["l_suppkey"])
    role = export.author_role(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey")), F.when(F.col("o_orderstatus") == "O", F.col("o_custkey")))
    flat = F.array_join(F.transform("lines", line), ",")
    return exported(spark, sf_dir).select("o_orderkey", "c_name", "n_name", "r_name", role.alias("role"), F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).alias("line_count"), flat.alias("lines"))


def export_verify(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return export.reconciled(exported(spark, sf_dir), "lines", table(spark, sf_dir, "orders"), rows, "o_orderkey")


def validate_json(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    errors = validate.listed(
        (~validate.is_object(F.col("props")), F.lit("rekord: not a JSON object")),
        (F.size(validate.unknown_keys(F.col("props"), ["k"])) > 0, F.lit("rekord: unknown field")),
        (F.coalesce(k < 10, F.lit(True)), F.lit("k: below 10")),
        (~F.col("event_type").isin(*VOCABULARY), F.lit("event_type: not in the vocabulary")),
    )
    return rows.select("event_id", F.array_join(errors, "; ").alias("errors"))


def record_texts(spark, sf_dir):
    """doc_id, json: documents as parsed records. What is wrong with a record comes from its
    document: a missing language, an impossible date, a blank cause, a class that is not in the
    vocabulary, fields of the wrong type, one too many, no object at all."""
    d = F.col("doc_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    fields = {
        "ticket_id": d.cast("string"),
        "date": F.concat(F.lit("2024-"), two(d % 14), F.lit("-"), two(d % 33)),
        "component": F.col("lang"),
        "problem": F.substring("text", 1, 40),
        "symptoms": F.col("source"),
        "error_codes": F.array("lang"),
        "cause": F.when(F.col("n_chars") % 4 == 0, "  ").otherwise("c"),
        "solution": F.col("source"),
        "resolution": F.concat(F.lit("class "), F.col("n_chars") % 3),
        "resolution_vocabulary_version": F.when(F.col("n_chars") % 5 == 0, 2).otherwise(1),
    }
    made = lambda **other: F.to_json(F.struct(*[c.alias(f) for f, c in (fields | other).items()]))
    json = (
        F.when(d % 6 == 1, made(extra=F.col("n_chars")))
        .when(d % 6 == 2, made(problem=F.col("n_chars")))
        .when(d % 6 == 3, made(error_codes=F.col("lang")))
        .when(d % 6 == 4, F.to_json(F.array("lang")))
        .otherwise(made())
    )
    return table(spark, sf_dir, "documents").select("doc_id", json.alias("json"))


def vocabulary(spark, sf_dir):
    """version, position, name, hint: two versions of a vocabulary, by the regions' keys."""
    rows = table(spark, sf_dir, "region").select((F.col("r_regionkey") % 2 + 1).alias("version"), F.col("r_regionkey").alias("position"), F.concat(F.lit("class "), F.floor(F.col("r_regionkey") / 2)).alias("name"), F.col("r_name").alias("hint"))
    return rows


def checked_records(spark, sf_dir):
    return validate.validated_by(record_texts(spark, sf_dir), "json", 1, vocabulary(spark, sf_dir))


def validate_records(spark, sf_dir):
    """Records through the whole validation, the vocabulary's names being a table."""
    return checked_records(spark, sf_dir).select("doc_id", F.array_join("errors", "; ").alias("errors"))


def validation_summary(spark, sf_dir):
    return validate.summary(checked_records(spark, sf_dir))


def valid_records(spark, sf_dir):
    """The valid records with their required texts trimmed."""
    rows = checked_records(spark, sf_dir).where("record is not null")
    return rows.select("doc_id", "record.ticket_id", "record.component", "record.problem", "record.symptoms", "record.resolution")


def answers_as_records(spark, sf_dir):
    """Model answers in a fence whose identity is the source's, whatever they say."""
    rows = record_texts(spark, sf_dir).withColumns({"answer": F.concat(F.lit("```json\n"), "json", F.lit("\n```")), "day": F.lit("2024-05-06")})
    got = validate.parsed_answers(rows, "answer", "doc_id", "day", 1, ["class 0", "class 1"])
    return got.select("doc_id", F.array_join("errors", "; ").alias("errors"), "record.ticket_id", "record.date", "record.resolution_vocabulary_version")


def vocabulary_text(spark, sf_dir):
    """Each version's vocabulary as it stands in a prompt."""
    classes = F.sort_array(F.collect_list(F.struct("position", "name", "hint")))
    return vocabulary(spark, sf_dir).groupBy("version").agg(text.render_vocabulary(classes).alias("classes"))


def prompts(spark, sf_dir):
    """The prompt of each thread: vocabulary first, then the thread, in a template."""
    classes = vocabulary_text(spark, sf_dir).where("version = 1").select(F.col("classes"))
    thread = text.render_thread(F.col("conv_id").cast("string"), F.lit("2024-01-01").cast("date"), F.lit("rozmowa"), F.col("body"), F.col("comments"))
    return threads(spark, sf_dir).crossJoin(F.broadcast(classes)).select("conv_id", text.parse_prompt("{{vocabulary}}\n--\n{{thread}}", thread, F.col("classes")).alias("prompt"))  # one row of classes


def tokens_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.tokens_estimate(F.col("text")).alias("tokens"))


def has_content(spark, sf_dir):
    """Which threads are long enough to be parsed."""
    status = F.when(F.col("conv_id") % 3 == 0, "nowy").when(F.col("conv_id") % 3 == 1, "zamkniety").otherwise("rozwiazany")
    return threads(spark, sf_dir).select("conv_id", F.coalesce(sampling.has_content(status, F.col("body"), F.col("comments"), 400), F.lit(False)).alias("has_content"))


def answer_problems(spark, sf_dir):
    """Calls whose answer can't be trusted: the window was full, or the prompt was cut."""
    rows = calls(spark, sf_dir)
    return rows.select("event_id", sampling.answer_problem(F.col("completion_tokens") * 10, F.col("prompt_tokens"), F.lit(5000)).alias("problem"))


def calls(spark, sf_dir):
    """Events as model calls: tokens from the value, the model from the user."""
    n = F.floor(F.col("value") * 100).cast("long")
    names = F.array(*[F.lit(m) for m in ("north-20240101", "south-2024-01-01", "east", "west")])
    model = F.element_at(names, (F.col("user_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "props", model.alias("model"), n.alias("prompt_tokens"), F.floor(n / 3).alias("completion_tokens"), F.floor(n / 10).alias("cache_write_tokens"), F.floor(n / 2).alias("cache_read_tokens"))


def llm_cost(spark, sf_dir):
    paid = cost.priced(calls(spark, sf_dir), cost.price_table(spark, PRICES))
    return paid.select("event_id", "alias", F.round("cost_usd", 9).alias("cost_usd"))


def run_totals(spark, sf_dir):
    paid = cost.priced(calls(spark, sf_dir), cost.price_table(spark, PRICES))
    return paid.groupBy("alias").agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("tokens_in"), F.sum("completion_tokens").alias("tokens_out"), F.round(F.sum("value"), 2).alias("latency"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


def run_summary(spark, sf_dir):
    paid = cost.priced(calls(spark, sf_dir), cost.price_table(spark, PRICES))
    rows = evaluate.run_summary(paid.withColumns({"record": F.when(F.col("event_id") % 7 != 0, F.col("event_id")), "latency_ms": F.col("value")}))
    return rows.select("calls", "parsed", "failed", "tokens_in", "tokens_out", F.round("latency_ms", 2).alias("latency_ms"), F.round("cost_usd", 6).alias("cost_usd"), F.round("cost_per_ticket", 9).alias("cost_per_ticket"))


def running_elapsed(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return index.running(rows, "user_id", "event_id", "cents", "elapsed").select("event_id", "elapsed")


def upsert_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return index.latest(rows, "user_id", F.col("ts"), F.col("event_id")).select("user_id", "event_id", "event_type", "value")


def event_index(spark, sf_dir) -> str:
    """The last event of each user, kept in the keyed index by two batches; the second
    one is merged twice under one number, which changes nothing."""
    path = new_path(spark, "event-index")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    for number, part in enumerate((rows.where("event_id % 3 <> 0"), rows.where("event_id % 3 = 0"), rows.where("event_id % 3 = 1"))):
        index.upsert(spark, path, part, "user_id", order="event_id", batch=("events", min(number, 1)))
    return path


def index_upsert(spark, sf_dir):
    return index.load(spark, event_index(spark, sf_dir)).select("user_id", "event_id", "event_type", "value")


def index_count(spark, sf_dir):
    """The exact number of points of an index."""
    path = event_index(spark, sf_dir)
    index.size(spark, path)  # refuses a missing or empty one
    return index.load(spark, path).agg(F.count(F.lit(1)).alias("points"))


def point_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", uuid5(F.col("doc_id").cast("string")).alias("point_id"))


def index_points(spark, sf_dir):
    """Points with named vectors and a payload, of the records that have an embedding."""
    rows = table(spark, sf_dir, "embeddings").join(checked_records(spark, sf_dir).where("record is not null"), F.col("vec_id") == F.col("doc_id"))
    names = [f for f in index.PAYLOAD if f not in ("date",)]
    flat = rows.select(*[F.col(f"record.{f}").alias(f) for f in names], F.to_date("record.date").alias("date"), "embedding")
    made = index.points(flat, half(1), half(33))
    wire = made.select("point_id", index.wire(made).alias("point"))
    share = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 9)
    return wire.select("point_id", "point.payload.ticket_id", "point.payload.date", "point.payload.problem", share(F.col("point.vector.problem")).alias("problem_sum"), share(F.col("point.vector.sts")).alias("sts_sum"))


def decoded_hits(spark, sf_dir):
    """Hits as JSON texts, read back; odd ranks come without a payload."""
    found = hits(spark, sf_dir)
    payload = F.when(F.col("rank") % 2 == 0, F.create_map(F.lit("ticket_id"), F.col("id").cast("string")))
    rows = found.select("query_id", "rank", F.to_json(F.struct(uuid5(F.col("id").cast("string")).alias("id"), F.round("score", 4).alias("score"), payload.alias("payload"))).alias("entry"))
    return search.decoded_hits(rows).select("query_id", "rank", "point_id", "score", "ticket_id")


def search_requests(spark, sf_dir):
    """Conversations as search requests, in the shape of tickets."""
    comments = F.transform("comments", lambda c: F.struct(F.when(c["role"] != "user", c["role"]).alias("role"), F.lit(None).cast("string").alias("created_at"), c["body"].alias("body")))
    rows = threads(spark, sf_dir).select(F.col("conv_id").cast("string").alias("ticket_id"), F.lit("2024-02-03").cast("date").alias("date"), F.lit("").alias("category"), F.lit("rozmowa").alias("subject"), "body", comments.alias("comments"))
    told = lambda c: F.concat_ws(",", c["kind"], c["role"], c["created_at"], F.length(c["body"]).cast("string"))
    return search.requests_as_tickets(rows).select("ticket_id", F.col("date").cast("string").alias("date"), F.length("body").alias("body_chars"), F.array_join(F.transform("comments", told), ";").alias("comments"))


def failed_ids(spark, sf_dir):
    """Calls without a record."""
    rows = calls(spark, sf_dir).withColumn("record", F.when(F.get_json_object("props", "$.k").cast("int") >= 5, F.col("event_id")))
    return evaluate.failed_ids(rows, "record", "event_id")


def completions(spark, sf_dir):
    """A model's answers about each document's language and source: each different prompt is
    asked once, rows share its answer."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", F.lit("language"), "lang", F.lit("from"), "source").alias("prompt"))
    done = completion.completed_once(rows, "prompt", encoders.completer_named("fake", answer="brak danych"), new_path(spark, "answers"))
    return done.select("doc_id", "completion.text", "completion.prompt_tokens", "completion.completion_tokens", "error_kind")


def document_files(spark, sf_dir):
    """One file for each supplier, written and read back."""
    folder = new_path(spark, "suppliers")
    rows = table(spark, sf_dir, "supplier")
    tickets.write_files(rows.select(F.concat(F.lit("supplier-"), "s_suppkey").alias("name"), F.to_json(F.struct("s_suppkey", "s_name")).alias("text")), folder, "name", "text")
    back = documents.read_documents(spark, folder).withColumn("file_name", F.concat("name", F.lit(".json")))
    return tickets.numbered(back).select("file_name", "number", F.get_json_object("text", "$.s_name").alias("s_name"))


def raw_tickets(spark, sf_dir):
    """Conversations as raw export files, one each, read back as tickets in the order of
    their numbers."""
    folder = new_path(spark, "raw")
    comment = lambda c: F.struct(c["turn"].alias("id"), F.lit("zwyczajny").alias("typ"), c["role"].alias("autor_rola"), c["created_at"].alias("created_at"), c["body"].alias("tresc"))
    ticket = F.struct(F.col("conv_id").cast("int").alias("id"), F.lit("2024-03-04 05:06:07").alias("created_at"), F.lit("rozmowa").alias("czego_dotyczy"), F.col("body").alias("szczegolowy_opis"))
    raw = F.to_json(F.struct(F.lit("x").alias("zrodlo"), F.lit("t").alias("tabela"), ticket.alias("zgloszenie"), F.when(F.size("comments") > 0, F.transform("comments", comment)).alias("komentarze")))
    tickets.write_files(threads(spark, sf_dir).select(F.concat(F.lit("zgloszenie-"), "conv_id").alias("name"), raw.alias("raw")), folder, "name", "raw")
    rows = tickets.numbered(tickets.chosen(tickets.read_raw(spark, folder)))
    roles = F.array_join(F.transform("comments", lambda c: c["role"]), " ")
    return rows.select("ticket_id", F.col("date").cast("string").alias("date"), "category", "subject", "body", F.size("comments").alias("comments"), roles.alias("roles"), "number")


def artifacts(spark, sf_dir):
    """The valid records as artifact files, one each, by the strict read."""
    folder = new_path(spark, "artifacts")
    good = checked_records(spark, sf_dir).where("record is not null")
    tickets.write_files(good.select(F.concat(F.lit("record-"), "doc_id").alias("name"), "json"), folder, "name", "json")
    names = [r[0] for r in vocabulary(spark, sf_dir).where("version = 1").select("name").distinct().collect()]
    return tickets.read_artifacts(spark, folder, 1, names).select("file_name", "ticket_id", "component", "resolution")


def ids_file(spark, sf_dir):
    """The sampled ids as a text of one id a line, read back."""
    folder = new_path(spark, "ids")
    tickets.write_ids(stratified_sample(spark, sf_dir).select("doc_id"), folder)
    return spark.read.text(folder).select(F.col("value").cast("long").alias("doc_id"))


def fake_embed_norms(spark, sf_dir):
    """The components' sum and two of them, and the length, of each text's pseudo-vector."""
    v = encoders.embed_passage(F.col("text"), encoders.encoder_named("fake", 64), 64)
    rows = table(spark, sf_dir, "documents").select("doc_id", v.alias("v"))
    total = lambda f: F.aggregate("v", F.lit(0.0), f)
    return rows.select("doc_id", F.round(F.sqrt(total(lambda s, x: s + x * x)), 9).alias("norm"), F.round(total(lambda s, x: s + x), 9).alias("total"), F.round(F.get("v", F.lit(0)), 9).alias("first"), F.round(F.get("v", F.lit(63)), 9).alias("last"))


def stream_activity(spark, sf_dir):
    """The hourly counts of the events as a stream of files: a state store behind a
    watermark, each batch upserted into an index."""
    path, checkpoint = new_path(spark, "activity"), new_path(spark, "activity-checkpoint")
    events = file_stream(spark, f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    keep_activity(spark, events, path, checkpoint).awaitTermination()
    return index.load(spark, path).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def hourly_activity(spark, sf_dir):
    rows = activity(table(spark, sf_dir, "events"))
    return rows.select("start", "event_type", "n", F.round("total", 2).alias("total"))


NAMES: tuple[Callable, ...] = (
    search_topk, search_threshold, rank_full, rank_topk_miss, recall_curve, modes_compare, threshold_sweep, score_distribution, score_histogram,
    strip_html_canonical, strip_html_sampling, render_thread, thread_budget, embedding_text, format_duration, quality_verdicts, quality_report, index_report,
    filter_vs_labels, not_yet_processed, kept_semi, stratified_sample, export_nested, export_verify, validate_json, llm_cost, run_totals, running_elapsed,
    upsert_latest, point_ids, fake_embed_norms, hourly_activity, validate_records, validation_summary, html_entities, html_numbers, mode_table, mode_deltas,
    missed_queries, lost_hits, distractor_detail, search_responses, median_length, sample_report, clipped_text, strip_answer, too_long, ids_for_rule, run_summary,
    valid_records, answers_as_records, vocabulary_text, prompts, tokens_estimate, has_content, answer_problems, index_upsert, index_count, index_points,
    decoded_hits, search_requests, failed_ids, completions, document_files, stream_activity, rule_drops, raw_tickets, artifacts, ids_file,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in NAMES}


def oracle_sql() -> dict[str, str]:
    from quernstone.plans.oracle import ORACLE

    return dict(ORACLE)
