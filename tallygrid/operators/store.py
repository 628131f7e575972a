"""The relational store: loads, queues, resume, ledgers, paging, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finished_load(responses: DataFrame, people: DataFrame, person: str, item: str, finished: Column) -> DataFrame:
    """Answers of finished people by item."""
    done = people.filter(finished).select(person)
    return responses.join(done, person, "left_semi").groupBy(item).agg(F.count("*").alias("n"))


def pending_load(assignments: DataFrame, responses: DataFrame, key: list[str], item: str) -> DataFrame:
    """Assignments without a response, by item."""
    return assignments.join(responses.select(*key), key, "left_anti").groupBy(item).agg(F.count("*").alias("n"))


def request_queue(items: DataFrame, prompts: DataFrame, conditions: list[str], samples: int, on: list[str], key: list[str]) -> DataFrame:
    """Every item x matching prompt x condition x sample, with a 20-digit hash of its key as request_id.

    Prompts and conditions are short lists, so they are joined on the input kind and exploded, never crossed.
    """
    rows = items.join(prompts, on)
    rows = rows.withColumn("condition", F.explode(F.array(*map(F.lit, conditions)))).withColumn("sample_index", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
    return rows.withColumn("request_id", F.substring(F.sha2(text, 256), 1, 20))


def colliding(queue: DataFrame, key: str = "request_id") -> DataFrame:
    """Keys that several queue rows have; empty for a sound queue."""
    return queue.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def remaining(queue: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    """Queue rows without a completed one."""
    return queue.join(completed.select(key).distinct(), key, "left_anti")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; ``order`` has to be a total order."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def orphan_summaries(raw: DataFrame, summaries: DataFrame, key: str, attempt: str, status: str) -> DataFrame:
    """For keys with attempts but no summary: number of attempts, first and last status."""
    orphans = raw.join(summaries.select(key).distinct(), key, "left_anti")
    return orphans.groupBy(key).agg(
        F.count("*").alias("attempts"),
        F.min_by(status, attempt).alias("first_status"),
        F.max_by(status, attempt).alias("last_status"),
    )


def ledger(responses: DataFrame, person: str, correct: Column, base: float, rate: float) -> DataFrame:
    """Correct answers and what is owed: base + rate for each, rounded half to even."""
    n = F.coalesce(F.sum(F.when(correct, 1).otherwise(0)), F.lit(0))
    return responses.groupBy(person).agg(n.cast("long").alias("n_correct")).withColumn("amount", F.bround(F.lit(base) + F.lit(rate) * F.col("n_correct"), 2))


def activity_span(tables: list[DataFrame], person: str, start: str, end: str) -> DataFrame:
    """Per person the time from the first start to the last end over all tables, in microseconds."""
    rows = tables[0].select(person, start, end)
    for t in tables[1:]:
        rows = rows.unionByName(t.select(person, start, end))
    return rows.groupBy(person).agg((F.unix_micros(F.max(end).cast("timestamp")) - F.unix_micros(F.min(start).cast("timestamp"))).alias("span_us"))


def page(rows: DataFrame, order: list[str], limit: int, offset: int, most: int = 5000) -> DataFrame:
    """One page in a total order; a page has ``most`` rows at most."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(limit, most))


def export_page(rows: DataFrame, people: DataFrame, person: str, order: list[str], limit: int, offset: int, since: Column | None = None) -> DataFrame:
    """A page of the rows of some people since some time, with ``total``: how many such rows there are on all pages."""
    chosen = rows.join(people.select(person).distinct(), person, "left_semi")
    chosen = chosen if since is None else chosen.filter(since)
    return page(chosen, order, limit, offset).join(chosen.agg(F.count("*").alias("total")), F.lit(True))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table, in one job."""
    out = None
    for name, rows in tables.items():
        own = rows.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = own if out is None else out.unionAll(own)
    return out


def lookup(rows: DataFrame, key: dict[str, object], alias: str | None = None, place: str = "trial_order") -> DataFrame:
    """Rows of a key; an alias ``T###`` picks the one at that place of the order."""
    for column, value in key.items():
        rows = rows.filter(F.col(column) == value)
    return rows if alias is None else rows.filter(F.col(place) == int(alias.removeprefix("T")))


def history(rows: DataFrame, person: str, order: list[str]) -> DataFrame:
    """Adds place: a person's rows numbered from 1 in their order."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(person).orderBy(*order)))


def in_scope(rows: DataFrame, module: str, scope: str) -> DataFrame:
    """The rows of the main part, of the modules, or all."""
    main = F.coalesce(F.nullif(F.col(module), F.lit("")), F.lit("main")) == "main"
    return {"all": lambda: rows, "main": lambda: rows.filter(main), "modules": lambda: rows.filter(~main)}[scope]()


def run_summary(queue: DataFrame, completed: DataFrame, errors: DataFrame, key: str, valid: Column) -> DataFrame:
    """One row on a collection run: queue, completed, remaining, errors, those without a completed request, and the share of valid ones.

    ``completed`` has one row for each request.
    """
    total = queue.agg(F.count("*").alias("queue_rows"))
    done = completed.agg(F.count("*").alias("completed"), F.avg(valid.cast("double")).alias("valid_rate"))
    failed = errors.agg(F.count("*").alias("errors"), F.count_distinct(key).alias("error_requests"))
    open_ = errors.select(key).distinct().join(completed, key, "left_anti").agg(F.count("*").alias("unresolved"))
    row = total.join(done, F.lit(True)).join(failed, F.lit(True)).join(open_, F.lit(True))
    return row.select(
        F.when(F.col("completed") < F.col("queue_rows"), "collection_started").otherwise("collection_complete").alias("status"),
        "queue_rows", "completed", F.greatest(F.lit(0), F.col("queue_rows") - F.col("completed")).alias("remaining"), "errors", "error_requests", "unresolved",
        (F.col("unresolved") / F.greatest(F.lit(1), F.col("queue_rows"))).alias("error_rate"), "valid_rate",
    )


def quality_flags(rows: DataFrame, person: str, time_taken: Column, fast: float, error: Column) -> DataFrame:
    """Per person: rows, those answered in 1 to ``fast``, errors, and those without a time."""
    return rows.groupBy(person).agg(
        F.count("*").alias("rows_seen"),
        F.count_if(time_taken.between(1, fast)).alias("fast"),
        F.count_if(error).alias("errors"),
        F.count_if(time_taken.isNull() | (time_taken < 1)).alias("untimed"),
    )


def last_of_union(tables: list[DataFrame], key: list[str]) -> DataFrame:
    """Union in which a later table's row replaces an earlier one of the same key."""
    rows = None
    for k, t in enumerate(tables):
        t = t.withColumn("_priority", F.lit(k))
        rows = t if rows is None else rows.unionByName(t)
    return latest(rows, key, ["_priority"]).drop("_priority")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table and not of the other, with the side they are on; empty if the tables are equal as multisets."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionAll(b.exceptAll(a).withColumn("side", F.lit("right")))


def consistent(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """One value for each key; ``conflict`` where rows of a key disagree."""
    return rows.groupBy(*key).agg(F.min(value).alias(value), (F.min(value) != F.max(value)).alias("conflict"))


def quotas(rows: DataFrame, item: str, correct: Column, bad: Column, retained: Column) -> DataFrame:
    one = lambda c: F.count_if(c)
    return rows.groupBy(item).agg(F.count("*").alias("raw"), one(retained).alias("retained"), one(correct & retained).alias("correct"), one(bad).alias("bad"))


def bad_record(bad: Column, timeout: Column, gave_up: Column) -> Column:
    """A recorded verdict wins; without one a time-out or giving up counts."""
    return F.coalesce(bad.cast("boolean"), F.coalesce(timeout.cast("boolean"), F.lit(False)) | F.coalesce(gave_up.cast("boolean"), F.lit(False)))


def retention(
    people: DataFrame,
    rows: DataFrame,
    person: str,
    item: str,
    *,
    main: Column,
    tester: Column,
    assigned: str,
    bad: Column,
    block: Column,
    correct: Column,
    module: Column | None = None,
    max_bad: int = 30,
    max_bad_in_block: int = 14,
    least_correct: int = 40,
    least_in_module: int = 2,
    modules: tuple[str, ...] = (),
) -> DataFrame:
    """Adds retained and reasons to people.

    Two aggregations by person (one of them by block first) are joined to the
    people; all rules are columns.  Rules of bad records are for the main
    cohort, those of correct answers for finished people of the other.
    """
    blocks = rows.groupBy(person, block.alias("_block")).agg(F.count_if(bad).alias("_bad"))
    worst = blocks.groupBy(person).agg(F.sum("_bad").alias("bad_total"), F.max("_bad").alias("bad_in_block"))
    by_module = [F.count_if(correct & (module == m)).alias(f"_m{k}") for k, m in enumerate(modules)] if module is not None else []
    done = rows.groupBy(person).agg(F.count_distinct(item).alias("done"), F.count_if(correct).alias("n_correct"), *by_module)
    out = people.join(worst, person, "left").join(done, person, "left").fillna(0, ["bad_total", "bad_in_block", "done", "n_correct", *[f"_m{k}" for k in range(len(by_module))]])
    finished = F.col("done") >= F.col(assigned)
    few = F.least(*[F.col(f"_m{k}") for k in range(len(by_module))]) if len(by_module) > 1 else (F.col("_m0") if by_module else F.lit(least_in_module))
    rules = [
        (tester, "tester"),
        (~finished, "not_finished"),
        (main & (F.col("bad_total") > max_bad), "bad_records_total"),
        (main & (F.col("bad_in_block") > max_bad_in_block), "bad_records_block"),
        (~main & finished & (F.col("n_correct") < least_correct), "too_few_correct"),
        (~main & finished & (few < least_in_module), "too_few_in_module"),
    ]
    reasons = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules]))
    return out.withColumn("reasons", reasons).withColumn("retained", F.size("reasons") == 0).drop(*[f"_m{k}" for k in range(len(by_module))])
