"""Helpers of the query modules: rounding, and the shared parts of the oracle texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.sources.points import POINTS_SQL

DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, integers as long: the form in which results are compared."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            out.append(F.round(F.col(name).cast("double"), digits).alias(name))
        elif kind in ("int", "smallint", "tinyint"):
            out.append(F.col(name).cast("long").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def r6(expression: str) -> str:
    return f"round(cast({expression} as double), {DIGITS})"


def big(expression: str) -> str:
    return f"cast({expression} as bigint)"


def runs_sql(name: str, condition: str, min_length: int = 1, merge_gap: int = 0, source: str = "pts") -> str:
    """Expressions for DuckDB that make the windows of a condition: series_id, dataset, event_id, s, e."""
    return f"""{name}_hot as (select series_id, dataset, t, lag(t) over (partition by series_id order by t) as b from {source} where {condition}),
{name}_isl as (select series_id, dataset, t, sum(case when b is null or t - b - 1 > {merge_gap} then 1 else 0 end) over (partition by series_id order by t) as island from {name}_hot),
{name}_all as (select series_id, dataset, island, min(t) as s, max(t) + 1 as e from {name}_isl group by 1, 2, 3),
{name} as (select series_id, dataset, cast(row_number() over (partition by series_id order by s) - 1 as bigint) as event_id, s, e from {name}_all where e - s >= {min_length})"""


TRUTH_SQL = runs_sql("truth", "y = 1")
PRED_SQL = runs_sql("pred", "v >= 30", 3, 2)

MATCH_SQL = """near as (
  select p.series_id, p.event_id as j, t.event_id as i,
         cast(greatest(least(p.e, t.e) - greatest(p.s, t.s), 0) as double) / (greatest(p.e, t.e) - least(p.s, t.s)) as iou
  from pred p join truth t on p.series_id = t.series_id),
walk as (
  select distinct series_id, cast(-1 as bigint) as j, []::bigint[] as used, cast(null as bigint) as hit, cast(null as double) as iou from pred
  union all
  select w.series_id, w.j + 1, case when max(n.i) is null then w.used else list_append(w.used, arg_max(n.i, (n.iou, -n.i))) end,
         arg_max(n.i, (n.iou, -n.i)), max(n.iou)
  from walk w join pred p on p.series_id = w.series_id and p.event_id = w.j + 1
  left join near n on n.series_id = p.series_id and n.j = p.event_id and n.iou >= 0.1 and not list_contains(w.used, n.i)
  group by w.series_id, w.j, w.used)"""


def sql(*parts: str, select: str, recursive: bool = False, points: bool = True) -> str:
    ctes = ([POINTS_SQL] if points else []) + list(parts)
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(ctes) + "\n" + select


class Registry:
    """Queries of a module, with their oracle texts."""

    def __init__(self):
        self.QUERIES: dict = {}
        self.ORACLES: dict[str, str] = {}

    def __call__(self, oracle: str | None = None):
        def add(f):
            self.QUERIES[f.__name__] = f
            if oracle is not None:
                self.ORACLES[f.__name__] = oracle
            return f

        return add
