"""Token sentences of entities in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlog.functions.tokens import event_tokens
from weftlog.schema import API, BEHAVIOUR, DNS, L4, RPC


def views(placed: DataFrame, columns: list[str] | tuple[str, ...] = BEHAVIOUR) -> DataFrame:
    """Each event as its endpoints see it: entity_id, direction, seq, and the given columns, by default the behaviour, but no other name.

    The source sees it go out; the destination sees it come in, and so does the service in front of it.
    """
    c = F.col
    side = lambda who, direction, seq: F.struct(who.alias("entity_id"), F.lit(direction).alias("direction"), F.lit(seq).alias("seq"))
    service = F.when((c("dst_svc_id") != "") & ~c("dst_svc_id").eqNullSafe(c("dst_id")), c("dst_svc_id"))
    sides = F.filter(F.array(side(c("src_id"), "out", 0), side(c("dst_id"), "in", 1), side(service, "in", 2)), lambda s: s["entity_id"].isNotNull())
    return placed.withColumn("side", F.explode(sides)).select("run_id", "w_idx", "pos", "ts_us", "ord", "side.*", *columns)


def tokenised(events: DataFrame, strip_verdict: bool = False) -> DataFrame:
    """Events with their tokens as both ends see them; done before events are dealt to windows, it is done once for each event."""
    return events.withColumns({"tokens_out": event_tokens(F.lit("out"), strip_verdict), "tokens_in": event_tokens(F.lit("in"), strip_verdict)})


def token_views(placed: DataFrame, strip_verdict: bool = False) -> DataFrame:
    """(run_id, w_idx, pos, ts_us, ord, seq, entity_id, direction, tokens) of every view that has tokens; ``placed`` may be tokenised."""
    full = placed if "tokens_out" in placed.columns else tokenised(placed, strip_verdict)
    out = views(full.where(F.col("event_type").isin(RPC, L4, DNS, API)), ["event_type", "tokens_out", "tokens_in"])
    tokens = F.when(F.col("direction") == "out", F.col("tokens_out")).otherwise(F.col("tokens_in"))
    return out.select("run_id", "w_idx", "pos", "ts_us", "ord", "seq", "entity_id", "direction", tokens.alias("tokens"))


def capped_views(tokens: DataFrame, most_repeats: int) -> DataFrame:
    """The first ``most_repeats`` occurrences of each token tuple of an entity in a window, with nth and the tuple's first occurrence.

    Views are dealt by entity and window, as their sentences will be, and so shuffled once.  A hash goes before the other keys, since
    these begin alike and are long to compare.
    """
    same = Window.partitionBy("_key", "run_id", "w_idx", "entity_id", "tokens")
    order = same.orderBy("ts_us", "ord", "seq")
    out = tokens.repartition("run_id", "w_idx", "entity_id").withColumn("_key", F.xxhash64("run_id", "w_idx", "entity_id", "tokens"))
    first = F.first(F.struct("ts_us", "ord", "seq")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return out.withColumns({"nth": F.row_number().over(order), "first": first}).where(F.col("nth") <= most_repeats).drop("_key")


def sample_evenly(array, most: int):
    """``most`` entries at even steps of a longer array, the array itself otherwise."""
    n = F.size(array)
    chosen = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(array, F.floor(i * (n / F.lit(float(most)))).cast("int")))
    return F.when(n > most, chosen).otherwise(array)


def sentences(placed: DataFrame, most_repeats: int = 3, most_tokens: int = 256, strip_verdict: bool = False) -> DataFrame:
    """(run_id, w_idx, pos, entity_id, sentence): tokens in order of time, repeats capped, at most ``most_tokens`` of them.

    What is collected for an entity is bounded by its distinct tuples in one window, whatever the number of its events.
    Ties in time follow the first occurrence of the tuple, then the occurrence.
    """
    kept = capped_views(token_views(placed, strip_verdict), most_repeats)
    rows = F.array_sort(F.collect_list(F.struct("ts_us", "first", "nth", "tokens")))
    out = kept.groupBy("run_id", "w_idx", "pos", "entity_id").agg(rows.alias("rows"))
    return out.select("run_id", "w_idx", "pos", "entity_id", sample_evenly(F.flatten(F.transform("rows", lambda r: r["tokens"])), most_tokens).alias("sentence"))
