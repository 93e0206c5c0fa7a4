"""Many reports in one pass. Every event becomes one cell per report it counts for; cells are counted per
visitor, then per label, so a visitor is counted once per (report, label) and the events are read once,
however many reports are wanted. Sessions are read once more, goals and web vitals on their own.

The result is one typed table (site_id, report, item, metric, value). Only labels are ordered and shared
out, after lists of any length (pages, campaigns) were cut to the wanted rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from footfall.functions.classify import duration_bucket, duration_bucket_order, filled, is_blank, source_class
from footfall.functions.geo import country_code, with_country_name
from footfall.functions.numbers import exact, percent, round_half_up, union_all
from footfall.functions.ranges import DateRange, for_site, instant, within
from footfall.operators.acquisition import is_purchase, json_number
from footfall.operators.conversion import DEFAULT_FUNNEL, goal_hits, step_test
from footfall.operators.traffic import headline, is_view

LABELS = ["l1", "l2", "l3"]
#: Lists that may be as long as the data has labels; each is cut to its own number of rows.
LISTS = ["top_pages", "utm", "entry_pages", "exit_pages", "realtime"]
REALTIME_ROWS = 10


def _cell(report: str, *labels: Column, when: Column, who: Column, by_session: bool = False) -> Column:
    texts = [*labels, *[F.lit(None)] * (len(LABELS) - len(labels))]
    return F.when(when, F.struct(
        F.lit(report).alias("report"), *[t.cast("string").alias(n) for t, n in zip(texts, LABELS)],
        F.lit(by_session).alias("by_session"), who.cast("string").alias("who")))


def _counted(rows: DataFrame, cells: list[Column], measures: dict[str, Callable[[], Column]]) -> DataFrame:
    """Per (site, report, labels): `visitors` and `sessions` with a name, `people` (all without one are one), and
    the measures over the rows."""
    used = [c for c in rows.columns if c.startswith("_m_")]
    long = rows.select("site_id", *used, F.explode(F.array_compact(F.array(*cells))).alias("c")).select("site_id", *used, "c.*")
    each = long.groupBy("site_id", "report", *LABELS, "by_session", "who").agg(*[m().alias(n) for n, m in measures.items()])
    person, named = ~F.col("by_session"), F.col("who").isNotNull()
    return each.groupBy("site_id", "report", *LABELS).agg(
        F.count_if(person & named).alias("visitors"), F.count_if(person).alias("people"),
        F.count_if(~person & named).alias("sessions"),
        *[F.sum(F.when(person, F.col(n))).alias(n) for n in measures])


def _event_facts(events, period, before, wanted, as_of, minutes, steps, site_id) -> DataFrame:
    recent = None if as_of is None else DateRange(as_of - timedelta(minutes=minutes), as_of)
    spans = [before, period, *([recent] if recent else [])]
    rows = for_site(within(events, DateRange(min(s.start for s in spans), max(s.end for s in spans))), site_id)
    at = F.col("timestamp")

    def during(p: DateRange, end_inclusive: bool = True) -> Column:
        last = instant(events, "timestamp", p.end)
        return (at >= instant(events, "timestamp", p.start)) & (at <= last if end_inclusive else at < last)

    now, user = during(period), F.col("user_id")
    cells = [
        _cell("days", F.to_date(at), when=now, who=user),
        _cell("days", F.to_date(at), when=now, who=F.col("session_id"), by_session=True),
        _cell("kpi", F.lit("now"), when=now, who=user),
        _cell("kpi", F.lit("then"), when=during(before, False), who=user),
        _cell("top_pages", F.col("path"), when=now & is_view(), who=user),
    ]
    if "countries" in wanted:
        rows = with_country_name(rows.withColumn("_country", F.col("country")), "_country")
        cells.append(_cell("countries", F.col("_country"), when=now, who=user))
    if wanted.keys() & {"sources", "referrers"}:
        cells.append(_cell("sources", source_class(F.col("referrer")), when=now, who=user))
    for report, column, blank in (("devices", "device", "Desktop"), ("browsers", "browser", "Unknown"), ("os", "os", "Unknown")):
        if report in wanted:
            cells.append(_cell(report, filled(column, blank), when=now, who=user))
    if "utm" in wanted:
        tags = [F.col(c) for c in ("utm_source", "utm_medium", "utm_campaign")]
        tagged = ~reduce(lambda a, b: a & b, [is_blank(t) for t in tags])
        cells.append(_cell("utm", *[filled(t, "(none)") for t in tags], when=now & tagged, who=user))
    if "realtime" in wanted:
        for dimension, label, when in (
            ("total", F.lit("active"), F.lit(True)), ("page", F.col("path"), is_view() & F.col("path").isNotNull()),
            ("device", filled("device", "Desktop"), F.lit(True)), ("country", filled("country", "Unknown"), F.lit(True)),
        ):
            cells.append(_cell("realtime", F.lit(dimension), label, when=during(recent) & when, who=user))
    held = {"views": is_view().cast("int")}
    if "revenue" in wanted:
        held |= {"purchases": is_purchase().cast("int"), "amount": F.when(is_purchase(), exact(json_number("value")))}
    if "funnel" in wanted:
        held |= {f"step{i}": step_test(kind, path).cast("int") for i, (_, kind, path) in enumerate(steps)}
    rows = rows.withColumns({f"_m_{n}": c for n, c in held.items()})
    measures = {n: (lambda n=n: (F.max if n.startswith("step") else F.sum)(f"_m_{n}")) for n in held}
    return _counted(rows, cells, {"n": lambda: F.count("*"), **measures})


def _session_facts(sessions, period, before, wanted, site_id) -> DataFrame:
    rows = for_site(within(sessions, DateRange(before.start, period.end), "started_at"), site_id)
    now = F.col("started_at") >= instant(sessions, "started_at", period.start)
    day, nobody = F.to_date("started_at"), F.lit(None)
    cells = [_cell("visits", F.when(now, "now").otherwise("then"), when=F.lit(True), who=nobody)]
    if wanted.keys() & {"bounce_rate", "avg_session", "new_vs_returning"}:
        cells.append(_cell("session_days", day, when=now, who=nobody))
    if "sessions" in wanted:
        seconds = F.col("duration")
        cells.append(_cell("buckets", duration_bucket(seconds), duration_bucket_order(seconds), when=now, who=nobody))
    for report, page in (("entry_pages", "entry_page"), ("exit_pages", "exit_page")):
        if report in wanted:
            cells.append(_cell(report, F.col(page), when=now & (F.col(page) != ""), who=F.col("user_id")))
    held = {"bounces": F.col("is_bounce").cast("int"), "seconds": F.col("duration"), "timed": F.col("duration").isNotNull().cast("int")}
    if "new_vs_returning" in wanted:
        known, back = F.col("user_id").isNotNull(), F.coalesce("is_returning", F.lit(False))
        held |= {"fresh": (known & ~back).cast("int"), "back": (known & back).cast("int")}
    rows = rows.withColumns({f"_m_{n}": c for n, c in held.items()})
    return _counted(rows, cells, {"n": lambda: F.count("*"), **{n: (lambda n=n: F.sum(f"_m_{n}")) for n in held}})


def _cut(facts: DataFrame, wanted: dict[str, int | None]) -> DataFrame:
    """Long lists cut to their rows. Any other label is a group of its own, so that one literal limit holds for all
    and Spark cuts before the shuffle."""
    listed = F.col("report").isin(LISTS) & ~F.coalesce(F.col("l1").isin("total", "device") & (F.col("report") == "realtime"), F.lit(False))
    by = F.when(F.col("report").isin("top_pages", "entry_pages", "exit_pages"), F.col("n")).otherwise(F.col("visitors"))
    section = [F.when(F.col("report") == "realtime", F.col("l1")), *[F.when(~listed, F.col(c)) for c in LABELS]]
    w = Window.partitionBy("site_id", "report", *section).orderBy(by.desc(), *[F.col(c).asc_nulls_last() for c in LABELS])
    limits = {name: wanted[name] or REALTIME_ROWS for name in LISTS if name in wanted}
    own = reduce(lambda a, b: a.when(F.col("report") == b[0], b[1]), limits.items(), F.when(F.lit(False), 0)).otherwise(1)
    ranked = facts.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max(limits.values(), default=1))
    return ranked.filter((F.col("_rn") <= own) | ~listed).drop("_rn")


def _value(name: str, report: str, label: str, w) -> Column:
    return F.max(F.when((F.col("report") == report) & (F.col("l1") == label), F.col(name))).over(w)


def _rows(report: str, item: Column, metrics: dict[str, Column], when: Column | None = None) -> Column:
    made = F.array(*[F.struct(
        F.lit(report).alias("report"), F.coalesce(item, F.lit("")).alias("item"), F.lit(m).alias("metric"),
        v.cast("double").alias("value")) for m, v in metrics.items()])
    return made if when is None else F.when(when, made).otherwise(F.array().cast(
        "array<struct<report:string,item:string,metric:string,value:double>>"))


def _joined(*texts: Column) -> Column:
    return F.concat_ws(" | ", *[F.coalesce(t, F.lit("")) for t in texts])


def _funnel_rows(steps) -> list[Column]:
    found = []
    for i, (label, _, _) in enumerate(steps):
        mine, before = F.coalesce(F.col(f"step{i}"), F.lit(0)), F.coalesce(F.col(f"step{i - 1}"), F.lit(0)) if i else F.lit(0)
        lost = F.when(before > 0, percent(before - mine, before, 1)).otherwise(F.lit(0.0))
        found.append(_rows("funnel", F.lit(label), {
            "step_no": F.lit(i), "visitors": mine, "percentage": percent(mine, F.col("people"), 1),
            "drop_off": F.greatest(lost, F.lit(0.0))}, F.col("l1") == "now"))
    return found


def _shown(wanted: dict[str, int | None], steps) -> dict[str, list[Column]]:
    """For each kind of fact the rows of the reports it feeds."""
    n, visitors, l1 = F.col("n"), F.col("visitors"), F.col("l1")
    seconds = F.coalesce(round_half_up(F.col("seconds") / F.nullif(F.col("timed"), F.lit(0))), F.lit(0))
    of_list = {"visitors": visitors, "percentage": percent(visitors, F.col("_visitors_shown"))}
    pages = {"unique_users": visitors, "avg_session_duration": seconds, "percentage": percent(n, F.col("_n_shown"), 1)}
    bounce = percent(F.col("bounces"), n, 1)
    shown = {
        "days": [_rows("traffic", l1, {"visitors": visitors, "sessions": F.col("sessions"), "pageviews": F.col("views")}),
                 _rows("pageviews", l1, {"pageviews": F.col("views")}, F.col("views") > 0)],
        "kpi": [_rows("kpi", _joined(F.col("_head.avg_session_duration"), F.col("_head.pages_per_session")), {
            m: F.col(f"_head.{m}") for m in ("total_visitors", "total_pageviews", "total_sessions", "bounce_rate", "visitors_trend",
                                             "pageviews_trend", "bounce_rate_trend", "session_trend")}, l1 == F.col("_first_side"))],
        "top_pages": [_rows("top_pages", l1, {"views": n, "unique_visitors": visitors, "share": percent(n, F.col("total_pageviews"), 1)})],
        "countries": [_rows("countries", _joined(country_code(l1), l1), of_list, F.col("_place") <= F.lit(wanted.get("countries") or 10))],
        "sources": [_rows(name, l1, of_list) for name in ("sources", "referrers")],
        **{name: [_rows(name, l1, of_list)] for name in ("devices", "browsers", "os")},
        "utm": [_rows("utm", _joined(F.col("l3"), F.col("l2"), l1), {
            "visitors": visitors, "pageviews": F.col("views"), "percentage": of_list["percentage"]})],
        "realtime": [_rows("realtime", _joined(l1, F.col("l2")), {"visitors": visitors})],
        "buckets": [_rows("sessions", l1, {
            "bucket_order": F.col("l2"), "sessions": n, "percentage": percent(n, F.col("_n_shown"))})],
        "session_days": [_rows("bounce_rate", l1, {"bounce_rate": bounce}), _rows("avg_session", l1, {"avg_duration": seconds})],
        "entry_pages": [_rows("entry_pages", l1, {"entries": n, "bounce_rate": bounce, **pages})],
        "exit_pages": [_rows("exit_pages", l1, {"exits": n, **pages})],
        "goals": [_rows("conversions", _joined(l1, F.col("l2"), F.col("l3")), {
            "conversions": visitors, "total_events": n, "conversion_rate": percent(visitors, F.col("_everyone"), 1)})],
    }
    if "funnel" in wanted:
        shown["kpi"] += _funnel_rows(steps)
    if "revenue" in wanted:
        shown["days"].append(_rows("revenue", l1, {
            "purchases": F.col("purchases"), "revenue": round_half_up(F.coalesce(F.col("amount").cast("double"), F.lit(0.0)), 2)},
            F.col("purchases") > 0))
    if "new_vs_returning" in wanted:
        both = F.col("fresh") + F.col("back")
        shown["session_days"].append(_rows("new_vs_returning", l1, {
            "new_visitors": F.col("fresh"), "returning_visitors": F.col("back"), "total_sessions": both}, both > 0))
    return shown


def shared_reports(
    events: DataFrame, sessions: DataFrame, period: DateRange, wanted: dict[str, int | None], as_of: datetime | None = None,
    goals: DataFrame | None = None, site_id: str | None = None, minutes: int = 5, steps=DEFAULT_FUNNEL,
) -> DataFrame:
    """The wanted reports (name -> number of rows where it is a list) as one table. `realtime` needs `as_of`,
    `conversions` needs the goals, `new_vs_returning` needs sessions with `is_returning`."""
    before = period.previous()
    live = as_of if "realtime" in wanted else None
    facts = union_all([_event_facts(events, period, before, wanted, live, minutes, steps, site_id),
                       _session_facts(sessions, period, before, wanted, site_id)])
    facts = _cut(facts, wanted)
    if "conversions" in wanted:
        hits = goal_hits(events, goals, period, site_id).select(
            "site_id", F.lit("goals").alias("report"), F.col("goal_id").cast("string").alias("l1"), F.col("goal_name").alias("l2"),
            F.col("type").alias("l3"), F.col("conversions").alias("visitors"), F.col("total_events").alias("n"))
        facts = union_all([facts, hits])
    # what is compared with a number of the whole site stands with it
    family = F.when(F.col("report").isin("kpi", "visits", "top_pages", "goals"), F.lit("site")).otherwise(F.col("report"))
    w = Window.partitionBy("site_id", family)
    sides = [("", "now"), ("_", "then")]
    totals = {}
    for mark, side in sides:
        totals |= {
            f"{mark or 'total_'}visitors": _value("people", "kpi", side, w), f"{mark or 'total_'}pageviews": _value("views", "kpi", side, w),
            f"{mark or 'total_'}sessions": _value("n", "visits", side, w), "_bounces" + ("_before" if mark else ""): _value("bounces", "visits", side, w),
            "_duration" + ("_before" if mark else ""): _value("seconds", "visits", side, w) / F.nullif(_value("timed", "visits", side, w), F.lit(0))}
    placed = facts.withColumns({
        **{name: F.coalesce(c, F.lit(0)) for name, c in totals.items()},
        "_everyone": F.coalesce(_value("visitors", "kpi", "now", w), F.lit(0)),
        "_first_side": F.min(F.when(F.col("report") == "kpi", F.col("l1"))).over(w),
        "_n_shown": F.sum("n").over(w), "_visitors_shown": F.sum("visitors").over(w),
        "_place": F.row_number().over(w.orderBy(F.col("visitors").desc(), F.col("l1").asc_nulls_last())),
    }).withColumn("_head", F.struct(*headline()))
    shown = _shown(wanted, steps)
    cells = F.coalesce(*[F.when(F.col("report") == name, F.concat(*parts)) for name, parts in shown.items()])
    long = placed.select("site_id", F.explode(cells).alias("_c")).select("site_id", "_c.*")
    return long.filter(F.col("report").isin(list(wanted)))
