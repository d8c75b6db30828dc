"""Retrieval evaluation: recall, reciprocal rank, thresholds, score distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.tables import scope, scratch, written

#: The grid of thresholds in hundredths, and the histogram's bins.
THRESHOLDS = tuple(t / 100 for t in range(30, 61, 2))
BINS = 100


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(100.0 * part, whole), F.lit(0.0))


def recall_curve(ranks: DataFrame, k: int, slices: Sequence[str] = ()) -> DataFrame:
    """n, recall@1..k (percent) and MRR of ``rank``, overall and by each slice column,
    one GROUPING SETS pass; ``grouping`` names the slice."""
    sets = [(), *[(s,) for s in slices]]
    grid = ranks.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(k))))
    full = [["k", *s] for s in sets]
    name = F.lit("overall")
    for s in slices:
        name = F.when(F.grouping(s) == 0, F.lit(s)).otherwise(name)
    return grid.groupingSets(full, "k", *slices).agg(
        name.alias("grouping"),
        F.count(F.lit(1)).alias("n"),
        percent(F.count_if(F.col("rank") <= F.col("k")), F.count(F.lit(1))).alias("recall"),
        (F.coalesce(F.sum(1.0 / F.col("rank")), F.lit(0.0)) / F.count(F.lit(1))).alias("mrr"),
    )


def mode_row(ranks: DataFrame, k: int = 5) -> DataFrame:
    """mode, recall@1, @min(3, k), @k, MRR."""
    at = lambda n: percent(F.count_if(F.col("rank") <= n), F.count(F.lit(1)))
    return ranks.groupBy("mode").agg(at(1).alias("recall_1"), at(min(3, k)).alias("recall_3"), at(k).alias("recall_k"), F.avg(1.0 / F.col("rank")).alias("mrr"))


def threshold_sweep(correct: DataFrame, silent: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """``correct`` (query_id, score; null score: not in the top k), ``silent``
    (query_id, best; the best score of a query that should find nothing, null without
    hits). One retrieval serves all thresholds. Percentages are of all queries."""
    grid = lambda df: df.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    kept = grid(correct).groupBy("threshold").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= F.col("threshold")).alias("kept"), F.count_if(F.col("score") < F.col("threshold")).alias("cut")
    )
    quiet = grid(silent).groupBy("threshold").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.coalesce(F.col("best") < F.col("threshold"), F.lit(True))).alias("silenced"))
    both = kept.join(quiet, "threshold", "full")
    return both.select(
        "threshold", F.coalesce("kept", F.lit(0)).alias("kept"), percent(F.col("kept"), F.col("n")).alias("kept_percent"), F.coalesce("cut", F.lit(0)).alias("cut"),
        F.coalesce("silenced", F.lit(0)).alias("silenced"), percent(F.col("silenced"), F.col("m")).alias("silenced_percent"),
    )


#: Bins of a pass of ``selected``; rows of its state that are broadcast.
NARROWING, BROADCAST_CELLS = 1024, 100_000
#: Shares whose places are selected; the median has two places.
PLACES = (("p05", 0.05), ("p25", 0.25), ("p75", 0.75), ("p95", 0.95))


def selected(rows: DataFrame, places: DataFrame, into: str | None = None, bins: int = NARROWING) -> DataFrame:
    """The values at given places of sorted series, exactly, without a sort. ``rows``: series,
    score (finite doubles); ``places``: series, name, place (from 0), low, high (the series' extremes).
    Gives series, name, value.

    Each pass counts a histogram between the bounds that are left for a place and keeps the
    bin that holds it, with that bin's own extremes as the next bounds, until both are one
    value. Counts combine before the shuffle; a place has at most ``bins`` rows."""
    state = places.select("series", "name", "place", "low", "high", F.lit(0).cast("long").alias("below"))
    while True:
        state = written(state, "places", 1, into)
        open_, n = state.agg(F.count_if(F.col("low") < F.col("high")), F.count(F.lit(1))).first()
        if not open_:
            return state.select("series", "name", F.col("low").alias("value"))
        cells = state.where("low < high").select("series", "low", "high").distinct()
        cells = F.broadcast(cells) if n <= BROADCAST_CELLS else cells
        width = F.col("high") - F.col("low")
        met = rows.join(cells, "series").where(F.col("score").between(F.col("low"), F.col("high")))
        bin_ = F.least(F.lit(bins - 1), F.floor((F.col("score") - F.col("low")) / width * bins)).alias("bin")
        counts = met.groupBy("series", "low", bin_).agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("least"), F.max("score").alias("most"))
        upto = Window.partitionBy("series", "low").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most ``bins`` rows
        counts = counts.withColumn("before", F.coalesce(F.sum("c").over(upto), F.lit(0)))
        going = state.where("low < high").join(counts, ["series", "low"])
        left = F.col("place") - F.col("below")
        going = going.where((F.col("before") <= left) & (left < F.col("before") + F.col("c")))
        going = going.select("series", "name", "place", F.col("least").alias("low"), F.col("most").alias("high"), (F.col("below") + F.col("before")).alias("below"))
        state = state.where("low >= high").unionByName(going)


def distribution(scores: DataFrame, series: str = "series", score: str = "score") -> DataFrame:
    """n, min, p05, p25, median, p75, p95, max of each series. Percentiles are the sorted
    score at floor(share * n), the median is interpolated. Exact: places are ``selected`` by
    narrowing histograms, so no series is sorted or gathered."""
    spark = scores.sparkSession
    outer, kind = scope(spark), scores.schema[score].dataType
    with scratch(spark):
        key = F.struct(F.col(series).alias("k"))  # so that a null series is one, too
        rows = scores.where(F.col(score).isNotNull()).select(key.alias("series"), F.col(score).cast("double").alias("score"))
        rows = written(rows, "scores")
        ends = written(rows.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high")), "ends", into=outer)
        at = [(name, F.least(F.col("n") - 1, F.floor(F.lit(share) * F.col("n")))) for name, share in PLACES]
        at += [("lower", F.floor((F.col("n") - 1) / 2)), ("upper", F.floor(F.col("n") / 2))]
        places = ends.select("series", "low", "high", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place.alias("place")) for name, place in at])).alias("p"))
        values = written(selected(rows, places.select("series", "low", "high", "p.name", "p.place")), "values", 1, into=outer)
    value = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    found = values.groupBy("series").agg(*[value(name).cast(kind).alias(name) for name, _ in PLACES], ((value("lower") + value("upper")) / 2).alias("median"))
    end = lambda c, name: F.col(c).cast(kind).alias(name)
    return ends.join(found, "series").select(F.col("series.k").alias(series), "n", end("low", "min"), "p05", "p25", "median", "p75", "p95", end("high", "max"))


def histogram(scores: DataFrame, series: str = "series", score: str = "score", bins: int = BINS) -> DataFrame:
    """series, bin, share: percent of the series' scores in each of ``bins`` equal bins of
    [0, 1]. Edges are i / bins; the last bin is closed; scores outside are in no bin but
    count in the share's denominator."""
    guess = F.floor(F.col(score) * bins).cast("int")
    # rounding may put a score beside an edge on the wrong side: compare with the edges
    at = F.when(F.col(score) < guess / bins, guess - 1).when(F.col(score) >= (guess + 1) / bins, guess + 1).otherwise(guess)
    at = F.when(F.col(score) == 1.0, bins - 1).otherwise(at)
    rows = scores.where(F.col(score).isNotNull()).groupBy(series, at.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min(score).alias("low"), F.max(score).alias("high"))
    whole = rows.groupBy(series).agg(F.sum("c").alias("n"))
    return rows.where((F.col("low") >= 0) & (F.col("high") <= 1)).join(whole, series).select(series, "bin", (100.0 * F.col("c") / F.col("n")).alias("share"))


def lost_at(correct: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Correct hits below the threshold, by score, and the number missing from the top k."""
    return correct.where(F.col("score") < threshold).orderBy("score", "query_id"), correct.agg(F.count_if(F.col("score").isNull()).alias("missing"))


def distractor_detail(hits: DataFrame, threshold: float) -> DataFrame:
    """Each distractor's scores, best first, the number that pass, and a verdict."""
    passing = F.count_if(F.col("score") >= threshold)
    return hits.groupBy("query_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"),
        passing.alias("passing"),
        F.when(passing == 0, "silenced").otherwise("answers").alias("verdict"),
    )


def missed(ranks: DataFrame, not_found: int = 10**6) -> DataFrame:
    return ranks.where(F.col("rank") >= not_found).select("query_id")


def mode_table(ranks: DataFrame, inputs: str = "input", k: int = 5) -> DataFrame:
    """recall@1, @min(3, k), @k and MRR for each input and mode."""
    at = lambda n: percent(F.count_if(F.col("rank") <= n), F.count(F.lit(1)))
    return ranks.groupBy(inputs, "mode").agg(at(1).alias("recall_1"), at(min(3, k)).alias("recall_3"), at(k).alias("recall_k"), F.avg(1.0 / F.col("rank")).alias("mrr"))


def mode_deltas(table: DataFrame, right: str, wrong: str, by: Sequence[str] = ()) -> DataFrame:
    """What the right mode gains over the wrong one, in percentage points and MRR."""
    figures = ("recall_1", "recall_3", "recall_k", "mrr")
    value = lambda mode, f: F.max(F.when(F.col("mode") == mode, F.col(f)))
    return table.groupBy(*by).agg(*[(value(right, f) - value(wrong, f)).alias(f"{f}_delta") for f in figures])


def median_length(df: DataFrame, text: str) -> DataFrame:
    """The median number of characters, one row; exact, by counts of distinct lengths."""
    rows = distribution(df.select(F.lit("all").alias("series"), F.length(text).alias("score")))
    return rows.select(F.col("median").alias("median_length"))


def run_summary(calls: DataFrame, record: str = "record", id_col: str = "ticket_id") -> DataFrame:
    """One row: calls, parsed, failed, tokens, latency, cost, and the averages per ticket."""
    n = F.count(F.lit(1))
    out = calls.agg(
        n.alias("calls"), F.count(record).alias("parsed"), (n - F.count(record)).alias("failed"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("tokens_out"), F.coalesce(F.sum("latency_ms"), F.lit(0.0)).alias("latency_ms"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
    )
    each = lambda c: F.coalesce(F.try_divide(c, "calls"), F.lit(0.0))
    return out.withColumns({"cost_per_ticket": each("cost_usd"), "latency_per_ticket": each("latency_ms")})


def failed_ids(calls: DataFrame, record: str = "record", id_col: str = "ticket_id") -> DataFrame:
    return calls.where(F.col(record).isNull()).select(id_col)
