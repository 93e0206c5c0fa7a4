"""Explicit schemas of the stored tables and of the JSON documents read by the jobs."""

from pyspark.sql import types as T


def _struct(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in columns.items()])


_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
_TS, _DATE = T.TimestampType(), T.DateType()

EVENTS = _struct(
    id=_S, site_id=_S, user_id=_S, session_id=_S, type=_S, url=_S, path=_S, referrer=_S,
    device=_S, browser=_S, os=_S, country=_S, city=_S, timestamp=_TS, properties=_S,
    utm_source=_S, utm_medium=_S, utm_campaign=_S, utm_term=_S, utm_content=_S,
)

SESSIONS = _struct(
    id=_S, site_id=_S, user_id=_S, started_at=_TS, ended_at=_TS, duration=_L, pageviews=_L,
    entry_page=_S, exit_page=_S, referrer=_S, device=_S, browser=_S, os=_S, country=_S, city=_S,
    is_bounce=_B, is_returning=_B, utm_source=_S, utm_medium=_S, utm_campaign=_S,
)

DAILY_STATS = _struct(
    site_id=_S, date=_DATE, visitors=_L, sessions=_L, pageviews=_L, bounces=_L, avg_duration=_D,
)

SITES = _struct(id=_S, user_id=_S, name=_S, domain=_S, created_at=_TS)
FUNNELS = _struct(id=_S, site_id=_S, name=_S, steps=_S, created_at=_TS)
GOALS = _struct(id=_S, site_id=_S, name=_S, type=_S, config=_S, created_at=_TS)
AB_TESTS = _struct(id=_S, site_id=_S, name=_S, variants=_S, goal_id=_S, status=_S, created_at=_TS)
ANNOTATIONS = _struct(
    id=_S, site_id=_S, date=_DATE, title=_S, description=_S, category=_S, created_at=_TS,
)
RETENTION_POLICIES = _struct(
    id=_S, site_id=_S, retention_days=_I, enabled=_B, last_cleanup_at=_TS,
)
UTM_LINKS = _struct(id=_S, site_id=_S, utm_source=_S, utm_medium=_S, utm_campaign=_S)
PAGE_KEYWORDS = _struct(site_id=_S, path=_S, keyword=_S, location=_S, is_primary=_B)
IP_RANGES = _struct(
    first_ip=_L, last_ip=_L, country=_S, region=_S, city=_S, latitude=_D, longitude=_D,
)

GOAL_CONFIG = _struct(path=_S, eventType=_S, selector=_S)
FUNNEL_STEPS = T.ArrayType(_struct(label=_S, type=_S, path=_S))
AB_VARIANTS = T.ArrayType(_struct(name=_S, path=_S, url=_S))

ORGANIC = T.ArrayType(_struct(position=_L, domain=_S, url=_S, title=_S))
CITATIONS = T.ArrayType(_struct(position=_L, domain=_S, url=_S, title=_S))

RAW_SERP = _struct(
    organic_results=T.ArrayType(_struct(position=_L, link=_S, title=_S)),
    ai_overview=_struct(
        references=T.ArrayType(_struct(index=_L, link=_S, title=_S, snippet=_S)),
        sources=T.ArrayType(_struct(index=_L, link=_S, title=_S, snippet=_S)),
    ),
    related_questions=T.ArrayType(_struct(question=_S, snippet=_S, link=_S)),
    related_searches=T.ArrayType(_struct(query=_S, link=_S)),
    answer_box=T.MapType(_S, _S),
    knowledge_graph=T.MapType(_S, _S),
    inline_videos=T.ArrayType(T.MapType(_S, _S)),
    shopping_results=T.ArrayType(T.MapType(_S, _S)),
    search_information=_struct(total_results=_L),
    _source=_S,
)

RAW_ISSUE = _struct(
    id=_S, shortId=_S, title=_S, culprit=_S, level=_S, status=_S, isUnhandled=_B, count=_S,
    userCount=_S, permalink=_S, substatus=_S, isRegression=_B, lastRelease=_S,
    firstSeen=_S, lastSeen=_S,
    metadata=_struct(value=_S, type=_S, isUnhandled=_B),
)

_FRAME = _struct(filename=_S, absPath=_S, function=_S, lineNo=_L, inApp=_B)
_VALUE = _struct(
    type=_S, value=_S, stacktrace=_struct(frames=T.ArrayType(_FRAME)),
    timestamp=_S, category=_S, level=_S, message=_S,
)
RAW_ISSUE_EVENT = _struct(
    eventID=_S, id=_S, message=_S, title=_S, dateCreated=_S, platform=_S,
    tags=T.ArrayType(_struct(key=_S, value=_S)),
    entries=T.ArrayType(_struct(type=_S, data=_struct(values=T.ArrayType(_VALUE)))),
)
