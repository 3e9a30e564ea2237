"""Queries of the smaller identifiers of the inventory (scalars, sorts, sets, alignment) with their DuckDB twins."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import series
from .functions import scalars as X
from .operators import alignment, features, measures, rolling, statistics, windows
from .oracles import _DD, _LONG, _RET, EVENT_TYPE, MEASURES, OHLC, USER, sigmoid
from .plans import selecting
from .streaming import online


def _r(column, name: str, places: int = 6):
    return F.round(column, places).alias(name)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def _long(spark: SparkSession, d: str) -> DataFrame:
    return rolling.long_features(rolling.rolling_features(series.nav_user(spark, d).select("series_id", "seq", "nav"), (5, 8)), 25)


def _measures(spark: SparkSession, d: str) -> DataFrame:
    from .catalogue import _measures as made

    return made(spark, d)


def _explained(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from .catalogue import _explained as made

    return made(spark, d)


def _gk_stats(spark: SparkSession, d: str) -> DataFrame:
    bars = series.ohlc_daily(spark, d).withColumn("raw", X.garman_klass_raw(*(F.col(c) for c in ("open", "high", "low", "close"))))
    own = bars.groupBy("series_id").agg(F.avg("raw").alias("mean"), F.stddev_pop("raw").alias("std"))
    return bars.join(own, "series_id").select("series_id", "seq", _r(X.garman_klass_with_stats(F.col("raw"), F.col("mean"), F.col("std")), "gk"))


def _hurst(spark: SparkSession, d: str) -> DataFrame:
    share = F.col("nav") / 500
    own = series.nav_user(spark, d).groupBy("series_id").agg(F.avg(share).alias("raw"), F.collect_list(share).alias("history"))
    return own.select("series_id", _r(X.hurst_adaptive(F.col("raw")), "plain"), _r(X.hurst_adaptive(F.col("raw"), F.col("history")), "adaptive"))


def _windows(spark: SparkSession, d: str) -> DataFrame:
    own = series.nav_user(spark, d).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    return own.select("series_id", F.concat_ws(",", X.adaptive_windows(F.col("n"), 5).cast("array<string>")).alias("sizes"), X.embedding_dimension(F.col("n")).cast("int").alias("dimension"))


def _uids(spark: SparkSession, d: str) -> DataFrame:
    first = series.nav_user(spark, d).filter("seq < 2").withColumn("digits", X.first_digits(F.col("nav")))
    at = lambda k: F.max(F.when(F.col("seq") == k, F.col("digits")))
    return first.groupBy("series_id").agg(F.concat(at(0), F.coalesce(at(1), F.lit(""))).alias("uid"))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.lit('{"a": "'), (F.col("user_id") % 12).cast("string"), F.lit("."), (F.col("event_id") % 3).cast("string"), F.lit('"}'))
    return _events(spark, d).select("event_id", X.has_feature(made, "a", "9.1").alias("has"), X.has_feature(made, "b", "0.1").alias("has_other"))


def _sharpe(spark: SparkSession, d: str) -> DataFrame:
    rets = windows.with_returns(series.nav_user(spark, d))
    return rets.groupBy("series_id").agg(_r(measures.sharpe(F.col("ret"), measures.periods_per_year("1d", "equity")), "daily"), _r(measures.sharpe(F.col("ret"), measures.periods_per_year("5m")), "five_minutes", 4))


def _batch(spark: SparkSession, d: str) -> DataFrame:
    nav = series.nav_user(spark, d)
    fall = 1 - X.divided(F.col("nav"), F.max("nav").over(series.so_far()))
    both = windows.with_returns(nav).withColumn("fall", fall)
    return both.groupBy("series_id").agg(_r(measures.sharpe(F.col("ret"), 365), "sharpe_ratio"), _r(F.max("fall"), "max_drawdown"))


def _tail(spark: SparkSession, d: str) -> DataFrame:
    nav = series.nav_user(spark, d)
    labels = nav.filter("seq >= 7").select("series_id", (F.col("seq") - 7).alias("seq"), F.when(F.col("nav") > 50, "high").otherwise("low").alias("label"))
    return alignment.joined_from_tail(labels, nav.select("series_id", "seq", "nav")).select("series_id", "seq", _r(F.col("nav"), "nav"), "label")


def _stacked(spark: SparkSession, d: str) -> DataFrame:
    m = _measures(spark, d)
    return alignment.stacked({c: m.filter(F.col("feature") == c).select("series_id", "seq", "value") for c in ("quantity", "tax")})


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    """Every event type with every threshold and year: the lists are a configuration's, so they are exploded, not joined."""
    names = _events(spark, d).select("event_type").distinct()
    both = names.withColumn("threshold", F.explode(F.array(F.lit(25), F.lit(50), F.lit(100))))
    return both.withColumn("year", F.explode(F.sequence(F.lit(2022), F.lit(2024))))


def _argmax(spark: SparkSession, d: str) -> DataFrame:
    nav = series.nav_event_type(spark, d)
    return nav.groupBy("series_id").agg(F.max_by("seq", F.struct("nav", -F.col("seq"))).alias("at_max"), F.min_by("seq", F.struct("nav", "seq")).alias("at_min"), F.max("seq").alias("last"))


def _redundant_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of one lookback or one feature, as a union of two sets, and what neither holds."""
    names = _long(spark, d).select("lookback", "feature").distinct()
    met = names.filter("lookback = 5").unionByName(names.filter("feature = 'bull_ed'")).distinct()
    rest = names.join(met, ["lookback", "feature"], "left_anti")
    return met.withColumn("part", F.lit("redundant")).unionByName(rest.withColumn("part", F.lit("kept")))


def _analysis_wide(spark: SparkSession, d: str) -> DataFrame:
    long = _long(spark, d).filter((F.col("threshold_dbps") > 0) & F.col("feature").rlike("^(bull|bear|max)_"))
    first = long.agg(F.min("series_id").alias("series_id"))
    names = [f"lb{n}_{c}" for n in (5, 8) for c in ("bull_ed", "max_dd")]
    own = long.join(F.broadcast(first), "series_id").withColumn("name", F.format_string("lb%d_%s", "lookback", "feature"))
    wide = own.filter(F.col("name").isin(names)).groupBy("bar_index").pivot("name", names).agg(F.first("value"))
    return wide.select("bar_index", *(_r(F.col(n), n) for n in names))


def _columns(spark: SparkSession, d: str) -> DataFrame:
    names = [r.name for r in _long(spark, d).select(X.feature_name(F.col("threshold_dbps"), F.col("lookback"), F.col("feature")).alias("name")).distinct().collect()]
    return spark.createDataFrame([(k, n) for k, n in enumerate(features.feature_columns([*names, "bar_index"], lookback=5))], "place long, name string")


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    from .sources import sinks

    bars = series.ohlc_daily(spark, d).withColumn("lookback_gap", F.lag("close").over(series.point_window()))
    return sinks.prepared_for_warehouse(bars, ["series_id", "seq", "close", "lookback_gap", "funding"])


def _quantiles(spark: SparkSession, d: str) -> DataFrame:
    return online.robust_normalized(series.nav_event_type(spark, d))


def queries() -> dict:
    et, events = series.nav_event_type, _events
    return {
        "x1_epsilon": lambda s, d: et(s, d).select("series_id", "seq", _r(X.relative_epsilon(F.col("nav")) * 1e12, "eps")),
        "x5_drawdown": lambda s, d: et(s, d).select("series_id", "seq", _r(X.normalize_drawdown(F.col("nav") / 200 - 0.5), "bounded")),
        "x6_sigmoid": lambda s, d: et(s, d).select("series_id", "seq", _r(X.logistic_sigmoid(F.col("nav"), 100.0, 0.05), "sigmoid")),
        "x9_gk_stats": _gk_stats,
        "x11_hurst_adaptive": _hurst,
        "x12_adaptive_windows": _windows,
        "x15_tolerance": lambda s, d: et(s, d).select("series_id", "seq", _r(X.adaptive_tolerance(F.col("nav"), F.col("seq")) * 1e12, "tolerance")),
        "x17_all_bounded": lambda s, d: _long(s, d).groupBy("series_id", "lookback").agg(F.sum(X.all_bounded(F.col("value")).cast("long")).alias("n_bounded"), F.count(F.lit(1)).alias("n_rows")),
        "x18_uids": _uids,
        "x21_epoch_millis": lambda s, d: events(s, d).select("event_id", X.millis(F.unix_micros(F.col("ts").cast("timestamp"))).alias("ms")),
        "x22_has_feature": _versions,
        "a2_sharpe_granular": _sharpe,
        "a3_batch": _batch,
        "f3_columns": _columns,
        "f11_prefilter": lambda s, d: _batch(s, d).filter("sharpe_ratio between 4.0 and 6.5").select("series_id", "sharpe_ratio"),
        "f13_analysis_wide": _analysis_wide,
        "f14_renamed": lambda s, d: events(s, d).withColumnRenamed("value", "price").select("event_id", F.col("price").cast("float").cast("double").alias("price"), F.coalesce(F.lit(None).cast("long"), F.lit(0)).cast("long").alias("n_trades")),
        "j1_temporal": lambda s, d: statistics.temporal_structure(et(s, d).select("series_id", "seq", F.col("series_id").alias("feature"), F.col("nav").alias("value"))),
        "j2_stacked": _stacked,
        "j3_from_tail": _tail,
        "j8_jobs": _jobs,
        "k4_prepared": _prepared,
        "m15_redundant": lambda s, d: selecting.redundant_features(_measures(s, d), 0.5),
        "m23_select_subset": lambda s, d: selecting.select_subset(*_explained(s, d), 2, 0.0005),
        "t1_sorted_scores": lambda s, d: events(s, d).groupBy("user_id").agg(_r(F.max("value"), "score")).orderBy(F.desc("score"), "user_id"),
        "t2_head": lambda s, d: events(s, d).orderBy(F.desc("value"), "event_id").select("event_id", _r(F.col("value"), "value")).limit(10),
        "t5_arg_extremes": _argmax,
        "t6_subsample": lambda s, d: alignment.subsample(events(s, d).select("event_id", "user_id"), "event_id", 100),
        "u3_redundant_names": _redundant_names,
        "u4_distinct": lambda s, d: events(s, d).select("event_type", "user_id").distinct(),
        "v7_prefixed": lambda s, d: et(s, d).select("series_id", "seq", *(_r(F.col(c), f"nav_{c}") for c in ("nav",))),
        "z3_running_quantiles": _quantiles,
    }


def oracle_sql() -> dict[str, str]:
    et, user = f"with s as ({EVENT_TYPE})", f"with s as ({USER})"
    raw = "case when open > 0 and high > 0 and low > 0 and close > 0 and high >= low then sqrt(greatest(0, 0.5 * ln(high / low) ** 2 - (2 * ln(2) - 1) * ln(close / open) ** 2)) end"
    rets = f"{user}, r as (select *, {_RET} as ret, {_DD} as dd from s window w as (partition by series_id order by seq))"
    names = "select distinct lookback, feature from long"
    cells = ", ".join(f"round(max(case when lookback = {n} and feature = '{c}' then value end), 6) as lb{n}_{c}" for n in (5, 8) for c in ("bull_ed", "max_dd"))
    batch = f"{rets} select series_id, round(sqrt(365) * avg(ret) / stddev_samp(ret), 6) as sharpe_ratio, round(max(dd), 6) as max_drawdown from r group by 1"
    return {
        "x1_epsilon": f"{et} select series_id, seq, round(greatest(abs(nav), 1) * 2.220446049250313e-14 * 1e12, 6) as eps from s",
        "x5_drawdown": f"{et} select series_id, seq, round(least(greatest(nav / 200 - 0.5, 0), 1), 6) as bounded from s",
        "x6_sigmoid": f"{et} select series_id, seq, round({sigmoid('nav', 100.0, 0.05)}, 6) as sigmoid from s",
        "x9_gk_stats": f"with b as ({OHLC}), r as (select *, {raw} as raw from b), o as (select series_id, avg(raw) as m, stddev_pop(raw) as sd from r group by 1) select series_id, seq, round(1 / (1 + exp(-(raw - m) / greatest(sd, 2.220446049250313e-16))), 6) as gk from r join o using (series_id)",
        "x11_hurst_adaptive": f"""{user}, o as (select series_id, avg(nav / 500) as raw, list_sort(list(nav / 500)) as h, count(*) as n from s group by 1)
select series_id, round({sigmoid('(raw - 0.5) / 0.5', 0.0, 1.0)}, 6) as plain, round(1 / (1 + exp(-(raw - 0.5) / (2 * case when n >= 4 then greatest(h[(3 * n // 4) + 1] - h[(n // 4) + 1], 0.1) else 0.25 end))), 6) as adaptive from o""",
        "x12_adaptive_windows": f"""{user}, o as (select series_id, count(*) as n from s group by 1), l as (select *, greatest(10, n // 100) as lo from o), m as (select *, least(greatest(n // 4, lo + 1), n)::double as hi from l)
select series_id, case when hi <= lo then lo::varchar else array_to_string(list_transform(range(0, 5), lambda i: floor(lo * exp(ln(hi / lo) * i / 4) + 0.5)::int), ',') end as sizes, least(greatest(ceil(log2(n)), 3), 7)::int as dimension from m""",
        "x15_tolerance": f"{et} select series_id, seq, round(nav * sqrt(seq) * 2.220446049250313e-15 * 1e12, 6) as tolerance from s",
        "x17_all_bounded": f"{_LONG} select series_id, lookback, sum(coalesce(value between 0 and 1 and not isnan(value), false)::int)::bigint as n_bounded, count(*) as n_rows from long group by 1, 2",
        "x18_uids": f"""{user}, g as (select series_id, seq, rpad(substr(regexp_replace(nav::varchar, '[0.\\-]', '', 'g'), 1, 12), 12, '0') as g from s where seq < 2)
select series_id, max(case when seq = 0 then g end) || coalesce(max(case when seq = 1 then g end), '') as uid from g group by 1""",
        "x21_epoch_millis": "select event_id, epoch_us(ts) // 1000 as ms from events",
        "x22_has_feature": "select event_id, user_id % 12 > 9 or user_id % 12 = 9 and event_id % 3 >= 1 as has, false as has_other from events",
        "a2_sharpe_granular": f"{rets} select series_id, round(sqrt(252) * avg(ret) / stddev_samp(ret), 6) as daily, round(sqrt(365 * 24 * 12) * avg(ret) / stddev_samp(ret), 4) as five_minutes from r group by 1",
        "a3_batch": batch,
        "f3_columns": f"{_LONG}, n as (select distinct format('ith_rb{{}}_lb{{}}_{{}}', threshold_dbps, lookback, feature) as name from long where lookback = 5) select row_number() over (order by name) - 1 as place, name from n",
        "f11_prefilter": f"select series_id, sharpe_ratio from ({batch}) where sharpe_ratio between 4.0 and 6.5",
        "f13_analysis_wide": f"{_LONG} select bar_index, {cells} from long where series_id = (select min(series_id) from long) group by 1",
        "f14_renamed": "select event_id, value::float::double as price, 0::bigint as n_trades from events",
        "j2_stacked": f"with m as ({MEASURES}) select series_id, seq, max(case when feature = 'quantity' then value end) as quantity, max(case when feature = 'tax' then value end) as tax from m group by 1, 2",
        "j3_from_tail": f"{user} select series_id, seq, round(nav, 6) as nav, case when nav > 50 then 'high' else 'low' end as label from s where seq >= 7",
        "j8_jobs": "select event_type, threshold::int as threshold, year::int as year from (select distinct event_type from events), unnest([25, 50, 100]) a(threshold), unnest([2022, 2023, 2024]) b(year)",
        "k4_prepared": f"with b as ({OHLC}) select series_id, seq, close, coalesce(lag(close) over (partition by series_id order by seq), 0) as lookback_gap, null::double as funding from b",
        "t1_sorted_scores": "select user_id, round(max(value), 6) as score from events group by 1 order by 2 desc, 1",
        "t2_head": "select event_id, round(value, 6) as value from events order by events.value desc, event_id limit 10",
        "t5_arg_extremes": f"{et} select series_id, first(seq order by nav desc, seq) as at_max, first(seq order by nav, seq) as at_min, max(seq) as last from s group by 1",
        "u3_redundant_names": f"{_LONG}, n as ({names}) select lookback, feature, case when lookback = 5 or feature = 'bull_ed' then 'redundant' else 'kept' end as part from n",
        "u4_distinct": "select distinct event_type, user_id from events",
        "v7_prefixed": f"{et} select series_id, seq, round(nav, 6) as nav_nav from s",
    }
