"""Progress of a run, as expressions over a table of steps, and checks of a run's arguments."""

from __future__ import annotations

from typing import TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .completer import eta_seconds

TOKENS = ("prompt_tokens", "cached_tokens", "completion_tokens")


def totals(steps: DataFrame) -> DataFrame:
    """One row from steps (label, ord, started, ended, failed, tokens): wall and average seconds, counts, usage."""
    tokens = [F.sum(c).cast("long").alias(c) for c in TOKENS]
    seconds = F.col("ended").cast("double") - F.col("started").cast("double")
    last = F.max_by(seconds, F.col("ended"))
    return steps.agg(
        F.count("ended").alias("done"), F.count_if("failed").alias("failures"), (F.max("ended").cast("double") - F.min("started").cast("double")).alias("wall_seconds"),
        F.avg(seconds).alias("average_seconds"), (last > F.avg(seconds)).alias("last_is_slower"), *tokens,
    )


def in_flight(steps: DataFrame) -> DataFrame:
    """One row, labels: steps begun and not ended, in plan order."""
    open_steps = F.array_sort(F.collect_list(F.when(F.col("ended").isNull(), F.struct("ord", "label"))))
    return steps.agg(F.array_join(F.transform(open_steps, lambda s: s["label"]), ", ").alias("labels"))


def eta(steps: DataFrame, planned: int, width: int) -> DataFrame:
    """One row, eta_seconds: what is left, by the average step and the rounds still to run; below zero for a run that is past its plan."""
    t = totals(steps)
    return t.select(eta_seconds(F.col("average_seconds"), F.lit(planned) - F.col("done"), F.lit(width)).alias("eta_seconds"))


def usage_lines(steps: DataFrame) -> DataFrame:
    """label, elapsed, prompt_tokens, cached_tokens, completion_tokens, steps, failures as texts: the last step that ended, and all (by the clock, not summed)."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—")).alias(c)
    seconds = F.col("ended").cast("double") - F.col("started").cast("double")
    fields = F.struct("label", seconds.alias("s"), "prompt_tokens", "cached_tokens", "completion_tokens", F.coalesce("failed", F.lit(False)).cast("int").alias("f"))
    last = steps.agg(F.max_by(fields, F.struct("ended", "ord")).alias("x")).select("x.*").where("s is not null")
    last = last.select(F.concat(F.lit("last "), F.col("label")).alias("label"), duration_text(F.col("s")).alias("elapsed"), *(shown(c) for c in TOKENS), F.lit("1").alias("steps"), F.col("f").cast("string").alias("failures"))
    every = totals(steps).select(F.lit("total").alias("label"), duration_text(F.col("wall_seconds")).alias("elapsed"), *(shown(c) for c in TOKENS), F.col("done").cast("string").alias("steps"), F.col("failures").cast("string").alias("failures"))
    return last.unionByName(every)


def report(steps: DataFrame, planned: int, concurrency: int, out: TextIO, width: int = 80) -> None:
    """Write a run's progress to ``out``: the line of the bar, then a line for the last step and one for all."""
    state = totals(steps).crossJoin(eta(steps, planned, concurrency)).crossJoin(in_flight(steps))  # one row each
    line = state.select(progress_line(F.col("done"), F.lit(planned), F.col("labels"), F.col("eta_seconds"), width)).first()[0]
    table = ["  ".join(r) for r in usage_lines(steps).collect()]
    out.write("\n".join([line, *table]) + "\n")
    out.flush()


#: Columns of the bar, and its signs.
BAR_WIDTH, FULL, EMPTY = 20, "█", "░"


def duration_text(seconds: Column) -> Column:
    """``h:mm:ss`` from an hour on, else ``m:ss``; seconds are rounded down, a null is a dash."""
    whole = F.greatest(F.floor(seconds), F.lit(0)).cast("long")
    h, m, s = F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60
    return F.when(seconds.isNull(), "—").when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def bar_text(done: Column, total: Column, width: int = BAR_WIDTH) -> Column:
    """A bar of ``width`` signs, filled by the share that is done."""
    full = F.when(total > 0, F.least(F.lit(width), F.greatest(F.lit(0), F.floor(done * width / total)))).otherwise(F.lit(0)).cast("int")
    return F.concat(F.repeat(F.lit(FULL), full), F.repeat(F.lit(EMPTY), F.lit(width) - full))


def fit_label(label: Column, taken: Column | int, width: int = 80) -> Column:
    """A label cut, with an ellipsis, to what ``taken`` columns leave of a line, whose last column stays empty; lines under 40 count as 80."""
    room = F.lit((80 if width < 40 else width) - 1) - taken
    cut = F.concat(F.left(label, F.greatest(room - 1, F.lit(0))), F.lit("…"))
    return F.when(room <= 0, "").when(F.length(label) <= room, label).when(room <= 1, "").otherwise(cut)


def progress_line(done: Column, total: Column, label: Column, eta_s: Column, width: int = 80) -> Column:
    """The line of a run: bar, counter, label, time to go (a dash if nothing is known or left)."""
    count = F.concat_ws("/", done.cast("string"), total.cast("string"))
    left = F.concat(F.lit("ETA "), F.when(eta_s > 0, duration_text(eta_s)).otherwise("—"))
    name = fit_label(label, F.lit(BAR_WIDTH + 1 + 2 + 1) + F.length(count) + F.length(left), width)
    return F.concat(bar_text(done, total), F.lit(" "), count, F.when(F.coalesce(F.length(name), F.lit(0)) > 0, F.concat(F.lit(" "), name)).otherwise(""), F.lit("  "), left)


def check_extract_arguments(list_pairs: bool, out: str | None = None, merge_into: str | None = None, pairs: str | None = None, max_pairs: int | None = None, resume: bool = False, model: str | None = None, work_dir: str | None = None, concurrency: int | None = None) -> None:
    """Refuse combinations of arguments that contradict each other; blank ones count as absent."""
    out, merge_into, pairs, model, work_dir = ((x or "").strip() for x in (out, merge_into, pairs, model, work_dir))
    if list_pairs and (out or merge_into or model or work_dir or resume or concurrency is not None):
        raise ValueError("listing pairs takes no output, merge, model, work directory, resume or concurrency")
    if list_pairs and pairs:
        raise ValueError("listing pairs takes no pair map")
    if max_pairs is not None and not pairs:
        raise ValueError("max_pairs needs a pair map")
    if max_pairs is not None and max_pairs <= 0:
        raise ValueError("max_pairs must be positive")
    if not list_pairs and not out:
        raise ValueError("an output is needed")


def warm_up(remaining: DataFrame, order_col: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """The first remaining step (by order, then id; a step without an order comes last), to be run alone so that a provider's prefix cache is warm, and the others.

    Steps are told apart by ``id_col``, which must be unique; any number may have one order.
    """
    first = remaining.orderBy(F.asc_nulls_last(order_col), id_col).limit(1)
    one = first.select(F.col(id_col).alias("_first"))
    return first, remaining.join(F.broadcast(one), remaining[id_col].eqNullSafe(one["_first"]), "left_anti")  # one row
