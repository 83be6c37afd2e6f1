"""Where plans register themselves with the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def plan(sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a function (spark, folder) -> DataFrame under its name, with its oracle if SQL can state it."""

    def add(f: Plan) -> Plan:
        PLANS[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def words(items) -> str:
    """A SQL list of strings."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in items)


#: The news view in SQL, see ``sources.bindings.news``.
def news_sql(days: int = 1035) -> str:
    return f"""(select doc_id, md5(cast(doc_id as varchar)) as article_id, split_part(text, chr(10), 1) as title, text as content, lang as language, source as symbol_query,
        timestamp '2023-01-01' + to_days(cast((doc_id * 7919) % {days} as integer)) + to_minutes((doc_id * 37) % 1440) as published_at from documents)"""


NEWS = news_sql()
PRICES = "(select o_orderpriority as symbol, cast(o_orderdate as date) as date, round(avg(o_totalprice), 4) as adjusted_close, count(*) as volume from orders group by all)"
RETURNS = f"""(select *, adjusted_close / lag(adjusted_close) over w - 1 as simple_return, ln(adjusted_close / lag(adjusted_close) over w) as log_return
    from {PRICES} window w as (partition by symbol order by date))"""
MONTHLY = "(select last_day(cast(o_orderdate as date)) as month_end, round(avg(o_totalprice), 4) as price from orders group by 1)"


def clean_sql(column: str) -> str:
    t = f"lower(coalesce({column}, ''))"
    for pattern in (r"<[^>]+>", r"https?://[a-zA-Z0-9$-_@.&+!*(),]+", r"www\.[a-zA-Z0-9$-_@.&+!*(),]+", r"\S+@\S+", r"[^a-z\s]", r"\s+"):
        t = f"regexp_replace({t}, '{pattern}', ' ', 'g')"
    return f"trim({t})"


def theta_sql(k: int, first: int = 0) -> str:
    names = ", ".join(f"exp(e{i} - m) / s as topic_{i:03d}" for i in range(k))
    dims = ", ".join(f"cast(embedding[{first + i + 1}] as double) as e{i}" for i in range(k))
    total = " + ".join(f"exp(e{i} - m)" for i in range(k))
    top = ", ".join(f"e{i}" for i in range(k))
    return f"(select doc_id, {names} from (select *, {total} as s from (select *, greatest({top}) as m from (select vec_id as doc_id, {dims} from embeddings))))"
