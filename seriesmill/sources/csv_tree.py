"""Trees of point files (CSV, TSV, TXT, OUT or no suffix): headers found per file, schema by names then by content, filters.

``load`` reads a whole tree in one plan. A row a file holds its layout (which column
is the series, the time, the label, the values), found from its first line and one
aggregation over all files' columns; the lines are joined with it. ``read_headerless``
and ``read_named`` read trees whose layout is known.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesmill.functions.labels import NEGATIVE, POSITIVE, normalized
from seriesmill.operators.events import labelled
from seriesmill.operators.splits import cap_round_robin, hash_order

#: File suffixes, folders that are passed over, and column names by role, in order of preference.
SUFFIXES = (".csv", ".tsv", ".txt", ".out", "")
SKIPPED = (".git", ".pytest_cache", "__pycache__", "docs", "result", "results", "outputs", "node_modules")
LABEL_NAMES = ("label", "labels", "anomaly", "is_anomaly", "ground_truth", "target", "gt", "class", "y")
VALUE_NAMES = ("value", "values", "data", "feature", "signal", "x", "reading")
TIME_NAMES = ("timestamp", "time", "date", "datetime", "t", "index", "time_index")
SERIES_NAMES = ("series_id", "series", "id", "sequence_id", "ts_id", "name")


@dataclass(frozen=True)
class LoadOptions:
    """Which series are kept; patterns are case-sensitive globs on the series id, no pattern includes all, exclusion wins."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    min_length: int = 1
    max_length: int | None = None
    min_event_windows: int = 0
    min_event_length: int = 1
    merge_gap: int = 0
    max_event_ratio: float | None = None
    max_series: int | None = None
    group_by_parent_folder: bool = True
    dataset_name: str | None = None
    seed: int = 42


def options_from(config: Mapping | None = None, given: Mapping | None = None) -> LoadOptions:
    """Options by precedence: ``given`` (a command line's), the configuration's dataset block, its data.load_options, the defaults; nulls don't count."""
    config = config or {}
    known = {f.name for f in fields(LoadOptions)}
    merged: dict = {}
    for layer in ((config.get("data") or {}).get("load_options"), config.get("dataset"), given):
        merged |= {k: tuple(v) if isinstance(v, list) else v for k, v in (layer or {}).items() if k in known and v is not None}
    return LoadOptions(**merged)


def glob_expression(pattern: str) -> str:
    """A glob as a regular expression; * also crosses slashes."""
    return fnmatch.translate(pattern).replace("\\Z", "$").replace("\\z", "$").replace("(?s:", "(?s)(?:")


def matches(series_id: Column, options: LoadOptions) -> Column:
    any_of = lambda patterns: F.rlike(series_id, F.lit("|".join(f"(?:^{glob_expression(p)})" for p in patterns))) if patterns else F.lit(False)
    return (any_of(options.include) if options.include else F.lit(True)) & ~any_of(options.exclude)


def pick(columns: list[str], names: tuple[str, ...]) -> str | None:
    """The first name, in order of preference, that is a column; case doesn't matter."""
    by = {c.strip().lower(): c for c in columns}
    return next((by[n] for n in names if n in by), None)


def looks_like_label(df: DataFrame, column: str) -> bool:
    """All values are 0 or 1, or four fifths of them are known label words; one pass."""
    word = F.lower(F.trim(F.col(column)))
    number = F.col(column).try_cast("double")
    row = df.agg(F.count(column).alias("n"), F.count_if(number.isin(0.0, 1.0)).alias("binary"), F.count_if(word.isin(*POSITIVE, *NEGATIVE)).alias("words")).first()
    return bool(row["n"]) and (row["binary"] == row["n"] or row["words"] >= 0.8 * row["n"])


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of the tree with its file, series id (path without suffix) and number."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{csv,tsv,txt,out}").text(path, wholetext=True)
    name = F.regexp_replace("file", r"\.(csv|tsv|txt|out)$", "")
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))
    root = path.rstrip("/").split("/")[-1]
    series = F.regexp_extract(name, rf"(?:^|/){root}/(.*)$", 1)
    cut = F.split(F.regexp_replace("content", r"\r?\n$", ""), r"\r?\n")
    return rows.select("file", series.alias("series_id"), F.posexplode(cut).alias("line", "text"))


def read_headerless(spark: SparkSession, path: str) -> DataFrame:
    """POINTS of files without header lines: value first, label last, comma, tab, semicolon or spaces between.

    Every line is kept. A label is first only if the first column is binary and the last one isn't.
    """
    fields = F.split(F.trim("text"), r"[,;\t ]+")
    rows = lines(spark, path).where(F.trim("text") != "").select("series_id", "line", fields.alias("f"))
    ends = rows.select("series_id", "line", F.get("f", F.lit(0)).alias("a"), F.element_at("f", -1).alias("b"))
    binary = lambda c: F.min(F.coalesce(F.col(c).try_cast("double").isin(0.0, 1.0), F.lit(False)).cast("int")).over(W.partitionBy("series_id")) == 1
    first = binary("a") & ~binary("b")
    typed = ends.select("series_id", "line", F.when(first, F.col("b")).otherwise(F.col("a")).try_cast("double").alias("v"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("raw"))
    return _points(typed.where("v is not null"), "line")


def read_named(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """POINTS of files with a header; columns by name, else the label by content and the first other numeric column as value."""
    df = spark.read.option("recursiveFileLookup", True).option("header", True).option("sep", sep).csv(path)
    columns = df.columns
    series, time = pick(columns, SERIES_NAMES), pick(columns, TIME_NAMES)
    left = [c for c in columns if c not in (series, time)]
    label = pick(left, LABEL_NAMES) or next((c for c in reversed(left) if looks_like_label(df, c)), None)
    if label is None:
        raise ValueError(f"no label column among {columns}")
    value = pick([c for c in left if c != label], VALUE_NAMES) or next(c for c in left if c != label)
    root = path.rstrip("/").split("/")[-1]
    from_path = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), rf"(?:^|/){root}/(.*)$", 1), r"\.[a-z]+$", "")
    order = F.struct(F.col(time).try_cast("double"), F.col(time)) if time else F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = df.select((F.col(series) if series else from_path).alias("series_id"), order.alias("line"), F.col(value).try_cast("double").alias("v"), F.col(label).alias("raw"))
    return _points(rows.where("v is not null"), "line")


def files(spark: SparkSession, path: str) -> DataFrame:
    """file, relative path without suffix, suffix and content of the files that can hold points; hidden and listed folders are passed over."""
    text = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    file = F.col("_metadata.file_path")
    root = path.rstrip("/").split("/")[-1]
    inner = F.regexp_extract(file, rf"(?:^|/){root}/(.*)$", 1)
    inner = F.when(inner == "", F.element_at(F.split(file, "/"), -1)).otherwise(inner)  # the path is a file
    parts = F.split(inner, "/")
    name = F.element_at(parts, -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    fit = suffix.isin(*SUFFIXES) & ~name.startswith(".") & ~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED)))
    return text.select(file.alias("file"), F.regexp_replace(inner, r"\.[^./]*$", "").alias("path"), suffix.alias("suffix"), F.col("value").alias("content")).where(fit)


def _cells(file_rows: DataFrame) -> DataFrame:
    """file, path, suffix, line, fields of every line that isn't blank; the separator is the first of tab, comma, semicolon and spaces in a file's first line."""
    cut = F.filter(F.split("content", r"\r?\n"), lambda x: F.trim(x) != "")
    rows = file_rows.select("file", "path", "suffix", cut.alias("lines"))
    head = F.get("lines", F.lit(0))
    sep = F.when(head.contains("\t") | (F.col("suffix") == ".tsv"), "\t").when(head.contains(","), ",").when(head.contains(";"), ";").otherwise(" +")
    each = rows.select("file", "path", "suffix", sep.alias("sep"), F.posexplode("lines").alias("line", "text"))
    return each.select("file", "path", "suffix", "line", F.transform(F.split(F.trim("text"), F.col("sep")), lambda x: F.trim(x)).alias("fields"))


def layouts(cells: DataFrame) -> DataFrame:
    """A row a file: whether it has a header, the places of its series, time, label and value columns, or the error that keeps it out.

    A first line without a number is a header, but never in ``.out`` files. Content is judged by one aggregation over
    (file, place): a label column has only 0 and 1, or four fifths label words; a value column only numbers, and is no label.
    """
    number = lambda c: c.try_cast("double")
    head = cells.where("line = 0").select("file", "path", "suffix", F.col("fields").alias("names"))
    named = (F.col("suffix") != ".out") & F.exists("names", lambda x: (x != "") & number(x).isNull() & ~F.lower(x).isin("nan", "null", "none"))
    head = head.withColumn("header", named)
    body = cells.join(head.select("file", "header"), "file").where(~F.col("header") | (F.col("line") > 0))
    each = body.select("file", F.posexplode("fields").alias("place", "x"))
    x, word = F.col("x"), F.lower(F.col("x"))
    some = F.nullif(F.col("x"), F.lit(""))
    stats = each.groupBy("file", "place").agg(
        F.count(some).alias("n"), F.count_if(number(x).isin(0.0, 1.0)).alias("binary"), F.count_if(number(x).isNotNull()).alias("numeric"), F.count_if(word.isin(*POSITIVE, *NEGATIVE)).alias("words"), F.count("*").alias("rows"),
    )
    is_label = ((F.col("binary") == F.col("n")) | ((F.col("numeric") < F.col("n")) & (F.col("words") >= 0.8 * F.col("rows")))) & (F.col("n") > 0)
    judged = stats.select("file", "place", is_label.alias("label"), ((F.col("numeric") == F.col("n")) & (F.col("n") > 0)).alias("numeric"))
    lists = judged.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("place", "label", "numeric"))).alias("c"))
    rows = head.join(lists, "file", "left").withColumn("c", F.coalesce("c", F.array().cast("array<struct<place:int,label:boolean,numeric:boolean>>")))
    lower = F.transform("names", lambda n: F.lower(F.trim(n)))

    def by_name(names: tuple[str, ...], among: Column) -> Column:
        """The place of the first candidate, in the candidates' order, among places."""
        at = F.array(*[F.array_position(lower, n).cast("int") - 1 for n in names])
        return F.get(F.filter(at, lambda p: (p >= 0) & F.array_contains(among, p)), F.lit(0))

    every = F.transform("c", lambda s: s["place"])
    labels, last = F.transform(F.filter("c", lambda s: s["label"]), lambda s: s["place"]), F.size("c") - 1
    inner_values = F.forall(F.filter("c", lambda s: (s["place"] > 0) & (s["place"] < last)), lambda s: s["numeric"] & ~s["label"])
    first_is_label = (last > 1) & F.array_contains(labels, F.lit(0)) & inner_values & ~F.array_contains(labels, last)
    rows = rows.withColumns({
        "series_at": F.when(F.col("header"), by_name(SERIES_NAMES, every)), "time_at": F.when(F.col("header"), by_name(TIME_NAMES, every)),
    })
    free = lambda places: F.filter(places, lambda p: ~p.eqNullSafe(F.col("series_at")) & ~p.eqNullSafe(F.col("time_at")))
    label_at = F.when(F.col("header"), F.coalesce(by_name(LABEL_NAMES, free(every)), F.element_at(F.concat(F.array(last), free(labels)), -1))).otherwise(F.when(first_is_label, 0).otherwise(last))
    rows = rows.withColumn("label_at", F.when(F.size("c") >= 2, label_at))
    values = free(F.transform(F.filter("c", lambda s: ~s["place"].eqNullSafe(F.col("label_at")) & s["numeric"] & (~F.col("header") | ~s["label"])), lambda s: s["place"]))
    preferred = by_name(VALUE_NAMES, values)
    rows = rows.withColumn("value_at", F.when(F.col("header") & preferred.isNotNull(), F.array(preferred)).otherwise(values))
    error = F.when(F.size("c") < 2, "fewer than two columns").when(F.size("value_at") == 0, "no numeric value column")
    return rows.select("file", "path", "header", "names", "series_at", "time_at", "label_at", "value_at", error.alias("error"))


@dataclass(frozen=True)
class Loaded:
    """``points`` has values (all dimensions) beside v, the first; ``series`` a row a series with the reason why it was dropped; ``errors`` a row a file that could not be read."""

    points: DataFrame
    series: DataFrame
    errors: DataFrame

    def summary(self) -> DataFrame:
        """One row: files with errors, series loaded and kept, dropped ones by reason."""
        reasons = ("pattern", "too_short", "few_events", "event_ratio", "over_cap")
        rows = self.series.agg(F.count("*").alias("num_series_loaded"), F.count_if(F.col("drop_reason").isNull()).alias("num_series_kept"), *[F.count_if(F.col("drop_reason") == r).alias(f"dropped_{r}") for r in reasons])
        return rows.crossJoin(self.errors.agg(F.count("*").alias("num_files_failed")))  # one row each


def load(spark: SparkSession, path: str, options: LoadOptions | None = None) -> Loaded:
    """POINTS of every file of a tree, filtered by the options.

    Without any loaded series, or with all of them dropped, ValueError names the first five errors. Points are in order
    of their time, then of their line; a row with a value that is no number is left out.
    """
    options = options or LoadOptions()
    cells = _cells(files(spark, path))
    layout = layouts(cells).cache()  # a row a file
    good = F.broadcast(layout.where("error is null")) if layout.count() <= 100_000 else layout.where("error is null")
    rows = cells.join(good.drop("path"), "file").where(~F.col("header") | (F.col("line") > 0))
    pick = lambda at: F.get("fields", F.col(at))
    values = F.transform("value_at", lambda i: F.get("fields", i).try_cast("double"))
    series = F.coalesce(pick("series_at"), F.col("path"))
    time = F.struct(F.coalesce(pick("time_at").try_cast("double"), F.lit(0.0)), F.coalesce(pick("time_at"), F.lit("")), "file", "line")
    folder = F.split_part("path", F.lit("/"), F.lit(1))
    dataset = F.lit(options.dataset_name) if options.dataset_name else F.when(F.contains(series, F.lit("/")), F.split_part(series, F.lit("/"), F.lit(1))).otherwise(folder)
    typed = rows.select(series.alias("series_id"), dataset.alias("dataset"), time.alias("order"), values.alias("values"), normalized(pick("label_at")).alias("y")).where(~F.exists("values", lambda v: v.isNull()))
    number = F.row_number().over(W.partitionBy("series_id").orderBy("order")) - 1
    points = typed.select("series_id", "dataset", number.cast("long").alias("t"), F.get("values", F.lit(0)).alias("v"), "values", "y")
    judged = filtered(points, options)
    kept = judged.where("drop_reason is null").select("series_id")
    out = Loaded(points.join(kept, "series_id", "left_semi"), judged, layout.where("error is not null").select("file", "error"))
    if kept.isEmpty():
        first = "; ".join(f"{r.file}: {r.error}" for r in out.errors.orderBy("file").limit(5).collect())
        raise ValueError(f"no series under {path}" + (f" ({first})" if first else "") if judged.isEmpty() else f"all series under {path} were filtered out")
    return out


def filtered(points: DataFrame, options: LoadOptions) -> DataFrame:
    """series_id, dataset, n, n_events, drop_reason (null for kept ones): pattern, length, events, share of events, then the cap, in this order."""
    rows = points.groupBy("series_id").agg(F.min("dataset").alias("dataset"), F.count("*").alias("n"), F.sum("y").alias("positive"))
    counts = labelled(points, options.min_event_length, options.merge_gap).groupBy("series_id").agg(F.count("*").alias("n_events"))
    rows = rows.join(counts, "series_id", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))
    long = F.col("n") > options.max_length if options.max_length is not None else F.lit(False)
    rich = F.col("positive") / F.col("n") > options.max_event_ratio if options.max_event_ratio is not None else F.lit(False)
    reason = (
        F.when(~matches(F.col("series_id"), options), "pattern").when((F.col("n") < options.min_length) | long, "too_short").when(F.col("n_events") < options.min_event_windows, "few_events").when(rich, "event_ratio")
    )
    rows = rows.withColumn("drop_reason", reason).drop("positive")
    if options.max_series is None:
        return rows
    left = rows.where("drop_reason is null")
    if options.group_by_parent_folder:
        chosen = cap_round_robin(left, options.max_series, options.seed).select("series_id")
    else:
        chosen = left.orderBy(hash_order(options.seed, "series_id"), "series_id").limit(options.max_series).select("series_id")
    marked = rows.join(chosen.withColumn("in", F.lit(True)), "series_id", "left")
    return marked.withColumn("drop_reason", F.when(F.col("drop_reason").isNull() & F.col("in").isNull(), "over_cap").otherwise(F.col("drop_reason"))).drop("in")


def timelines(points: DataFrame) -> DataFrame:
    """A row a series: its values and labels in order."""
    rows = points.groupBy("series_id").agg(F.min("dataset").alias("dataset"), F.sort_array(F.collect_list(F.struct("t", "v", "y"))).alias("p"))
    return rows.select("series_id", "dataset", F.transform("p", lambda p: p["v"]).alias("values"), F.transform("p", lambda p: p["y"]).alias("labels"))


def _points(rows: DataFrame, order: str) -> DataFrame:
    number = F.row_number().over(W.partitionBy("series_id").orderBy(order)) - 1
    return rows.select("series_id", F.split_part(F.col("series_id"), F.lit("/"), F.lit(1)).alias("dataset"), number.cast("long").alias("t"), "v", normalized(F.col("raw")).alias("y"))
