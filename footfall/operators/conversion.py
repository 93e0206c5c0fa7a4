"""Funnels, goals and A/B tests. Definitions are rows of a table; one job answers all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from footfall import schemas
from footfall.functions.classify import filled
from footfall.functions.numbers import desc_then, percent, top_per
from footfall.functions.stats import two_proportion_test
from footfall.operators.acquisition import json_text
from footfall.operators.traffic import by_day, is_view, n_pageviews, period_rows

# The funnel used when none is given (label, event type, path).
DEFAULT_FUNNEL = [
    ("Visit Homepage", "pageview", "/"),
    ("View Product", "pageview", "/products"),
    ("Add to Cart", "add_to_cart", None),
    ("Checkout", "checkout", None),
    ("Purchase", "purchase", None),
]
# Event types that count for a click goal.
CLICK_TYPES = ["click", "button_click", "heatmap_click"]


def funnel_event_types(events, period, site_id=None) -> DataFrame:
    rows = period_rows(events, period, site_id).filter(F.col("type") != "")
    return rows.groupBy("site_id", "type").agg(F.count("*").alias("count"))


def funnel_paths(events, period, site_id=None, limit=30) -> DataFrame:
    rows = period_rows(events, period, site_id).filter(is_view() & (F.col("path") != ""))
    counted = rows.groupBy("site_id", "path").agg(F.count("*").alias("count"))
    return top_per(counted, ["site_id"], desc_then("count", "path"), limit)


def step_test(kind: str, path: str | None) -> Column:
    test = F.col("type") == kind
    return test if not path else test & (F.col("path") == path)


def _steps_long(per_site: DataFrame, steps, visitors) -> DataFrame:
    """One row per (site, step): share of all visitors and loss against the step before."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(i).alias("step_no"), F.lit(label).alias("step"), visitors(i).alias("visitors"))
        for i, (label, _, _) in enumerate(steps)
    ]))
    long = per_site.select("site_id", "_all", rows.alias("s")).select("site_id", "_all", "s.*")
    before = F.lag("visitors").over(Window.partitionBy("site_id").orderBy("step_no"))
    lost = percent(before - F.col("visitors"), before, 1)
    return long.withColumn("_lost", F.when(before > 0, lost).otherwise(F.lit(0.0))).select(
        "site_id", "step_no", "step", "visitors",
        percent(F.col("visitors"), F.col("_all"), 1).alias("percentage"),
        F.greatest(F.col("_lost"), F.lit(0.0)).alias("drop_off"),
    )


def funnel(events, period, site_id=None, steps=DEFAULT_FUNNEL) -> DataFrame:
    """Visitors per step, in any order of time. One row per visitor with a flag per step, then
    sums: a single shuffle by visitor, however many steps."""
    rows = period_rows(events, period, site_id)
    per_user = rows.groupBy("site_id", "user_id").agg(
        *[F.max(step_test(kind, path).cast("int")).alias(f"_{i}")
          for i, (_, kind, path) in enumerate(steps)])
    per_site = per_user.groupBy("site_id").agg(
        F.count("*").alias("_all"), *[F.sum(f"_{i}").alias(f"_{i}") for i in range(len(steps))])
    return _steps_long(per_site, steps, lambda i: F.coalesce(F.col(f"_{i}"), F.lit(0)))


def saved_funnels(events, funnels: DataFrame, period, site_id=None) -> DataFrame:
    """`funnel` for every row of the funnels table (steps as JSON) at once. An event is matched by
    equality with its type alone and with type and path; Spark broadcasts the steps while small."""
    steps = funnels.select(
        "site_id", F.col("id").alias("funnel_id"), F.col("name").alias("funnel"),
        F.posexplode(F.from_json("steps", schemas.FUNNEL_STEPS)).alias("step_no", "s"),
    ).select("site_id", "funnel_id", "funnel", "step_no", F.col("s.label").alias("step"),
             F.col("s.type").alias("type"), filled("s.path", "").alias("_path"))
    rows = period_rows(events, period, site_id)
    keyed = rows.select("site_id", "user_id", "type", F.explode(
        F.array_distinct(F.array(F.lit(""), filled("path", "")))).alias("_path"))
    hits = keyed.join(steps, ["site_id", "type", "_path"]).groupBy("funnel_id", "step_no").agg(
        F.countDistinct("user_id").alias("visitors"))
    everyone = rows.groupBy("site_id").agg(F.countDistinct("user_id").alias("_all"))
    full = steps.join(hits, ["funnel_id", "step_no"], "left").join(everyone, "site_id", "left").na.fill(0)
    before = F.lag("visitors").over(Window.partitionBy("funnel_id").orderBy("step_no"))
    lost = F.when(before > 0, percent(before - F.col("visitors"), before, 1)).otherwise(F.lit(0.0))
    return full.select(
        "site_id", "funnel_id", "funnel", "step_no", "step", "visitors",
        percent(F.col("visitors"), F.col("_all"), 1).alias("percentage"),
        F.greatest(lost, F.lit(0.0)).alias("drop_off"))


def funnel_ordered(events, period, site_id=None, steps=DEFAULT_FUNNEL) -> DataFrame:
    """As `funnel`, but a step counts only strictly after the step before it. The steps of a moment are
    bits; an hour of a visitor becomes the list of steps reached after it for each number reached before,
    and these lists are followed hour by hour. One scan, and no task orders more than an hour of moments."""
    rows = period_rows(events, period, site_id).filter("user_id IS NOT NULL")
    keys, n = ["site_id", "user_id"], len(steps)
    mask = reduce(lambda a, b: a + b, [
        F.when(step_test(kind, path), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
        for i, (_, kind, path) in enumerate(steps)])
    moments = rows.groupBy(*keys, F.when(mask > 0, F.col("timestamp")).alias("at")).agg(F.bit_or(mask).alias("mask"))
    hours = moments.groupBy(*keys, F.date_trunc("hour", "at").alias("hour")).agg(
        F.sort_array(F.collect_list(F.struct("at", "mask"))).alias("moments"))

    def after(reached: int) -> Column:
        return F.aggregate("moments", F.lit(reached), lambda r, m: r + F.getbit(m["mask"], r).cast("int"))

    moves = hours.select(*keys, F.struct("hour", F.array(*[after(i) for i in range(n + 1)]).alias("to")).alias("move"))
    reached = F.aggregate(
        F.sort_array(F.collect_list("move")), F.lit(0), lambda r, m: F.element_at(m["to"], r + 1))
    per_user = moves.groupBy(*keys).agg(reached.alias("_reached"))
    per_site = per_user.groupBy("site_id").agg(
        F.count("*").alias("_all"), *[F.count_if(F.col("_reached") > i).alias(f"_{i}") for i in range(n)])
    return _steps_long(per_site, steps, lambda i: F.col(f"_{i}"))


def _goal_keys(goals: DataFrame, unknown_is_click: bool) -> DataFrame:
    """Each goal as an equality rule (kind, key); unreadable settings fall back to defaults."""
    c = F.from_json("config", schemas.GOAL_CONFIG, {"mode": "PERMISSIVE"})
    kind = F.col("type")
    rule = (
        F.when(kind == "page_visit", F.struct(F.lit("path").alias("kind"), filled(c.path, "/").alias("key")))
        .when(kind == "event", F.struct(F.lit("type").alias("kind"), filled(c.eventType, "custom").alias("key")))
    )
    click = F.struct(F.lit("selector").alias("kind"), F.coalesce(c.selector, F.lit("")).alias("key"))
    rule = rule.otherwise(click) if unknown_is_click else rule.when(kind == "click", click)
    return goals.select(
        "site_id", F.col("id").alias("goal_id"), F.col("name").alias("goal_name"),
        kind.alias("goal_type"), rule.alias("r"),
    ).select("site_id", "goal_id", "goal_name", "goal_type", "r.*")


def _goal_hits(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Events that satisfy a goal. An event carries at most three keys; the match is an equality
    join, which Spark broadcasts only while the rule table is small."""
    def cell(name: str, key: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("kind"), key.alias("key")))

    cells = F.array_compact(F.array(
        cell("path", F.col("path"), is_view()),
        cell("type", F.col("type"), F.lit(True)),
        cell("selector", json_text("selector"), F.col("type").isin(CLICK_TYPES)),
    ))
    keyed = rows.select("site_id", "user_id", "timestamp", F.explode(cells).alias("c")).select(
        "site_id", "user_id", "timestamp", "c.*")
    return keyed.join(rules.filter("kind IS NOT NULL"), ["site_id", "kind", "key"])


def goal_hits(events, goals, period, site_id=None) -> DataFrame:
    """Converting visitors and events of every goal; goals without a hit stay, with 0."""
    rows = period_rows(events, period, site_id)
    rules = _goal_keys(goals, unknown_is_click=False)
    if site_id is not None:
        rules = rules.filter(F.col("site_id") == site_id)
    hits = _goal_hits(rows, rules).groupBy("goal_id").agg(
        F.countDistinct("user_id").alias("conversions"), F.count("*").alias("total_events"))
    return rules.join(hits, "goal_id", "left").na.fill(0).select(
        "site_id", "goal_id", "goal_name", F.col("goal_type").alias("type"), "conversions", "total_events")


def goal_conversions(events, goals, period, site_id=None) -> DataFrame:
    """`goal_hits` with the rate among all visitors of the period."""
    everyone = period_rows(events, period, site_id).groupBy("site_id").agg(F.countDistinct("user_id").alias("_all"))
    full = goal_hits(events, goals, period, site_id).join(everyone, "site_id", "left").na.fill(0)
    return full.withColumn("conversion_rate", percent(F.col("conversions"), F.col("_all"), 1)).drop("_all")


def goal_conversions_daily(events, goals, period, site_id=None) -> DataFrame:
    hits = _goal_hits(period_rows(events, period, site_id), _goal_keys(goals, unknown_is_click=True))
    return hits.groupBy("site_id", "goal_id", by_day()).agg(F.countDistinct("user_id").alias("conversions"))


def ab_test_results(events, tests, goals, period, site_id=None) -> DataFrame:
    """Visitors, page views and conversions per variant, with significance against the first
    variant and a mark on the variant with the best rate."""
    live = tests.filter(F.col("status") != "deleted")
    variants = live.select(
        "site_id", F.col("id").alias("test_id"), F.col("name").alias("test_name"), "status", "goal_id",
        F.posexplode(F.from_json("variants", schemas.AB_VARIANTS)).alias("variant_no", "v"),
    ).select(
        "site_id", "test_id", "test_name", "status", "goal_id", "variant_no",
        F.coalesce(F.nullif("v.path", F.lit("")), F.nullif("v.url", F.lit("")), "v.name").alias("path"),
        F.coalesce(F.nullif("v.name", F.lit("")), F.nullif("v.path", F.lit("")), "v.url").alias("variant"),
    )
    goal_type = goals.filter(F.col("type") == "event").select(
        F.col("id").alias("goal_id"),
        filled(F.from_json("config", schemas.GOAL_CONFIG).eventType, "custom").alias("goal_event"))
    variants = variants.join(goal_type, "goal_id", "left")
    rows = period_rows(events, period, site_id)
    key = ["test_id", "variant_no"]
    seen = rows.join(variants.select("site_id", "path", "goal_event", *key), ["site_id", "path"])
    exposure = seen.groupBy(*key, "site_id", "goal_event", "user_id").agg(n_pageviews())
    wanted = variants.select("site_id", "goal_event").distinct()
    did = rows.withColumnRenamed("type", "goal_event").join(
        wanted, ["site_id", "goal_event"], "left_semi").select("site_id", "goal_event", "user_id")
    counts = exposure.groupBy(*key).agg(
        F.count("*").alias("visitors"), F.sum("pageviews").alias("pageviews"))
    won = exposure.join(did, ["site_id", "goal_event", "user_id"], "left_semi").groupBy(*key).agg(
        F.count("*").alias("conversions"))
    measured = variants.join(counts, key, "left").join(won, key, "left").na.fill(
        0, ["visitors", "pageviews", "conversions"])
    return add_significance(measured.drop("goal_event"), "test_id", "variant_no")


def add_significance(variants: DataFrame, test: str, order: str) -> DataFrame:
    """Adds rate, test statistics against the first variant, and `is_leader`."""
    whole_test = Window.partitionBy(test)
    first = whole_test.orderBy(order)
    hits, n = F.col("conversions"), F.col("visitors")
    stats = two_proportion_test(F.col("_hits0"), F.col("_n0"), hits, n)
    control = F.col(order) == F.col("_order0")
    rated = (
        variants.withColumn("conversion_rate", percent(hits, n, 1))
        .withColumn("_order0", F.first(order).over(first))
        .withColumn("_hits0", F.first(hits).over(first))
        .withColumn("_n0", F.first(n).over(first))
        .withColumn("_best", F.max("conversion_rate").over(whole_test))
    )
    flags = {"significant", "reliable"}
    return rated.select(
        *variants.columns, "conversion_rate", control.alias("is_control"),
        *[(F.when(~control, c).otherwise(F.lit(False)) if name in flags else F.when(~control, c))
          .alias(name) for name, c in stats.items()],
        ((F.col("conversion_rate") == F.col("_best")) & (F.col("_best") > 0)).alias("is_leader"),
    )


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the text's characters."""
    return F.aggregate(
        F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2166136261).cast("bigint"),
        lambda h, c: ((h.bitwiseXOR(F.ascii(c).cast("bigint"))) * F.lit(16777619))
        .bitwiseAND(F.lit(4294967295)),
    )


def assigned_variant(user: Column, test: Column, variants: list[str]) -> Column:
    slot = fnv1a(F.concat_ws(":", user, test)) % len(variants)
    return F.element_at(F.array(*[F.lit(v) for v in variants]), (slot + 1).cast("int"))


def ab_assignment_audit(events, test_id: str, variants: list[str], period, site_id=None) -> DataFrame:
    """Visitors per assigned variant of a test, and how many logged exposures disagree with it."""
    rows = period_rows(events, period, site_id)
    logged = F.when(
        (F.col("type") == "experiment_view") & (json_text("test") == test_id), json_text("variant"))
    users = rows.groupBy("site_id", "user_id").agg(F.max(logged).alias("_logged"))
    placed = users.withColumn("variant", assigned_variant(F.col("user_id"), F.lit(test_id), variants))
    counted = placed.groupBy("site_id", "variant").agg(
        F.count("*").alias("visitors"), F.count("_logged").alias("logged"),
        F.count_if(F.col("_logged") != F.col("variant")).alias("mismatches"))
    total = F.sum("visitors").over(Window.partitionBy("site_id"))
    return counted.withColumn("share", percent(F.col("visitors"), total, 1))
