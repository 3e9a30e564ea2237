"""DuckDB twins of the registered queries: independent SQL over the same tables, written from the definitions."""

EVENT_TYPE = "select event_type as series_id, row_number() over (partition by event_type order by ts, event_id) - 1 as seq, ts, value as nav from events"
USER = "select user_id::varchar as series_id, row_number() over (partition by user_id order by ts, event_id) - 1 as seq, ts, value as nav from events"
DAILY = """select p as series_id, row_number() over (partition by p order by day) - 1 as seq, day, nav from
  (select o_orderpriority as p, o_orderdate::date as day, sum(o_totalprice::decimal(18,2))::double as nav from orders group by 1, 2)"""
OHLC = """select event_type as series_id, row_number() over (partition by event_type order by day) - 1 as seq, day, open, high, low, close from
  (select event_type, ts::date as day, first(value order by ts, event_id) as open, max(value) as high, min(value) as low, last(value order by ts, event_id) as close from events group by 1, 2)"""
MEASURES = """select series_id, seq, feature, value from (select l_returnflag as series_id, row_number() over (partition by l_returnflag order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as seq,
  l_quantity::double as quantity, l_extendedprice::double as price, l_discount::double as discount, l_tax::double as tax from lineitem) unpivot (value for feature in (quantity, price, discount, tax))"""
EPS = "2.220446049250313e-16"


def sigmoid(x: str, centre: float, slope: float) -> str:
    return f"(1 / (1 + exp(-(({x}) - {centre}) * {slope})))"


def fold(series: str, hurdle: float, long: bool = True) -> str:
    """CTEs ``s`` and ``f``: the state machine as a recursion over positions."""
    up, down, ahead = ("s.nav > f.best", "s.nav < f.worst", "best2 >= anchor") if long else ("s.nav < f.best", "s.nav > f.worst", "best2 <= anchor")
    ratio = "s.nav / f.anchor" if long else "f.anchor / s.nav"
    return f"""recursive s as materialized ({series}),
f as (
  select series_id, seq, nav, nav as anchor, nav as best, nav as worst, 0::double as gain, 0::double as loss, 0::double as g, 0::double as l, false as epoch from s where seq = 0
  union all
  select series_id, seq, nav, case when reset then best2 else anchor end, best2, case when reset then prev else worst2 end,
    case when reset then 0 else gain2 end, case when reset then 0 else loss2 end, gain2, loss2, gain2 > loss2 and gain2 > {hurdle}
  from (select *, gain2 > abs(loss2) and gain2 > {hurdle} and {ahead} as reset from (
    select s.series_id, s.seq, s.nav, f.nav as prev, f.anchor,
      case when {up} then s.nav else f.best end as best2, case when {down} then s.nav else f.worst end as worst2,
      case when {up} then (case when f.anchor <> 0 and s.nav <> 0 then {ratio} - 1 else 0 end) else f.gain end as gain2,
      case when {down} then (case when f.anchor <> 0 and s.nav <> 0 then 1 - {ratio} else 0 end) else f.loss end as loss2
    from f join s on s.series_id = f.series_id and s.seq = f.seq + 1)))"""


def roll(series: str, lookbacks: tuple[int, ...], full: bool = False) -> str:
    """CTEs up to ``feats``: eight features of every window of each lookback, by recursion over (window, step)."""

    def machine(tag: str, long: bool) -> str:
        up, down, ahead = ("x > best", "x < worst", "best2 >= anchor") if long else ("x < best", "x > worst", "best2 <= anchor")
        ratio = "x / anchor" if long else "anchor / x"
        hurdle = "dd" if long else "ru"
        return f"""m{tag} as (
  select w.series_id, w.lookback, w.last, 0 as k, 1::double as cur, 1::double as anchor, 1::double as best, 1::double as worst, 0::double as gain, 0::double as loss,
    greatest(h.{hurdle}, {EPS}) as h, 0::double as total, 0 as n, 0 as pos, []::double[] as gaps
  from w join hurdles h using (series_id, lookback, last) where w.k = 0
  union all
  select series_id, lookback, last, k, x, case when reset then best2 else anchor end, best2, case when reset then cur else worst2 end, case when reset then 0 else gain2 end,
    case when reset then 0 else loss2 end, h, total + gain2, n + ep::int, case when ep then k else pos end, case when ep then list_append(gaps, (k - pos)::double) else gaps end
  from (select *, gain2 > abs(loss2) and gain2 > h and {ahead} as reset, gain2 > loss2 and gain2 > h as ep from (
    select m.series_id, m.lookback, m.last, m.k + 1 as k, w.x, m.cur, m.anchor, m.h, m.total, m.n, m.pos, m.gaps,
      case when {up} then w.x else best end as best2, case when {down} then w.x else worst end as worst2,
      case when {up} then {ratio} - 1 else gain end as gain2, case when {down} then 1 - {ratio} else loss end as loss2
    from m{tag} m join w on w.series_id = m.series_id and w.lookback = m.lookback and w.last = m.last and w.k = m.k + 1)))"""

    ratio = lambda gaps: f"(list_stddev_pop({gaps}) / list_avg({gaps}))"
    parts = [
        (sigmoid("b.n / lookback", 0.5, 10), "bull_ed"), (sigmoid("a.n / lookback", 0.5, 10), "bear_ed"), ("tanh(5 * abs(b.total))", "bull_eg"), ("tanh(5 * abs(a.total))", "bear_eg"),
        (sigmoid(f"coalesce(case when b.n > 0 then {ratio('b.gaps')} end, 0)", 0.5, 4), "bull_cv"), (sigmoid(f"coalesce(case when a.n > 0 then {ratio('a.gaps')} end, 0)", 0.5, 4), "bear_cv"),
        ("least(greatest(dd, 0), 1)", "max_dd"), ("least(greatest(ru, 0), 1)", "max_ru"),
    ]
    return f"""recursive s as materialized ({series}), lb as (select unnest([{', '.join(map(str, lookbacks))}]) as lookback),
sz as (select *, count(*) over (partition by series_id) as n from s),
pts as (select sz.series_id, sz.seq, sz.nav, lb.lookback from sz, lb where lb.lookback {'<=' if full else '<'} sz.n),
w as materialized (select p.series_id, p.lookback, p.seq as last, (q.seq - p.seq + p.lookback - 1)::int as k, q.nav / first_value(q.nav) over (partition by p.series_id, p.lookback, p.seq order by q.seq) as x
  from pts p join s q on q.series_id = p.series_id and q.seq > p.seq - p.lookback and q.seq <= p.seq where p.seq >= p.lookback - 1),
ext as (select *, max(x) over (partition by series_id, lookback, last order by k) as top, min(x) over (partition by series_id, lookback, last order by k) as low from w),
hurdles as materialized (select series_id, lookback, last, max(1 - x / top) as dd, max(1 - low / x) as ru from ext group by 1, 2, 3),
{machine('b', True)},
{machine('a', False)},
feats as (select p.series_id, p.lookback, p.seq, {', '.join(f'case when b.k is not null then {e} end as {n}' for e, n in parts)}
  from pts p left join (select * from mb where k = lookback - 1) b on b.series_id = p.series_id and b.lookback = p.lookback and b.last = p.seq
  left join (select series_id as sa, lookback as la, last as ea, n, total, gaps from ma where k = lookback - 1) a on a.sa = p.series_id and a.la = p.lookback and a.ea = p.seq
  left join hurdles h on h.series_id = p.series_id and h.lookback = p.lookback and h.last = p.seq)""".replace("b.n / lookback", "b.n / p.lookback").replace("a.n / lookback", "a.n / p.lookback")


CODES = ("bull_ed", "bear_ed", "bull_eg", "bear_eg", "bull_cv", "bear_cv", "max_dd", "max_ru")
_ROUND8 = ", ".join(f"round({c}, 6) as {c}" for c in CODES)
_FOLD_ET = fold(EVENT_TYPE, 0.05)
_ROLL_USER = roll(USER, (5, 8))
_LONG = f"with {_ROLL_USER}, long as (select series_id, seq as bar_index, 25 as threshold_dbps, lookback, feature, value from (select * from feats) unpivot include nulls (value for feature in ({', '.join(CODES)})))"
_DD = "1 - nav / max(nav) over (partition by series_id order by seq)"
_RET = "coalesce(case when abs(lag(nav) over w) > 2.220446049250313e-16 then (nav - lag(nav) over w) / lag(nav) over w when lag(nav) over w is not null then 0 end, 0)"
_EPISODES = f"""with s as ({EVENT_TYPE}), p as (select *, max(nav) over (partition by series_id order by seq) as peak from s),
h as (select *, coalesce((peak > lag(peak) over (partition by series_id order by seq))::int, 0) as new_high from p),
e as (select *, sum(new_high) over (partition by series_id order by seq)::bigint as episode from h),
t as (select *, min(nav) over (partition by series_id, episode order by seq) as trough from e),
fallen as (select *, case when seq > 0 and new_high = 0 then peak - trough else 0 end as fall from t),
spikes as (select *, case when row_number() over (partition by series_id, episode order by fall desc, seq) = 1 and fall > 0 then fall else 0 end as spike from fallen)"""
_PAIRS = f"with m as ({MEASURES}), c as (select a.feature as feature_a, b.feature as feature_b, count(*) as n, corr(a.value, b.value) as r from m a join m b on a.series_id = b.series_id and a.seq = b.seq and a.feature < b.feature group by 1, 2)"


def _mad(series: str, expr: str) -> str:
    return f"""v as (select series_id, {expr} as x from ({series}) window w as (partition by series_id order by seq)),
o as (select series_id, x, row_number() over (partition by series_id order by x) - 1 as pos, count(*) over (partition by series_id) as n from v where x is not null),
c as (select series_id, x as c from o where pos = n // 2),
d as (select o.series_id, abs(o.x - c.c) as d from o join c using (series_id)),
e as (select series_id, d, row_number() over (partition by series_id order by d) - 1 as pos, count(*) over (partition by series_id) as n from d),
mad as (select series_id, d as mad from e where pos = n // 2)"""


def _describe(keys: str, column: str, source: str) -> str:
    q = lambda p, n: f"round(max(case when pos = floor({p} * (n - 1) + 0.5) then {column} end), 6) as {n}"
    skew = f"(avg(power({column}, 3)) - 3 * avg({column}) * avg({column} * {column}) + 2 * power(avg({column}), 3)) / power(stddev_pop({column}), 3)"
    return f"""with r as (select *, row_number() over (partition by {keys} order by {column}) - 1 as pos, count({column}) over (partition by {keys}) as n from ({source}))
select {keys}, count({column}) as n, count(*) - count({column}) as n_null, round(avg({column}), 6) as mean, round(stddev_samp({column}), 6) as std, min({column}) as min, max({column}) as max,
round({skew}, 4) as skew, round(kurtosis_pop({column}), 4) as kurtosis, {q(0.01, 'q01')}, {q(0.05, 'q05')}, {q(0.25, 'q25')}, {q(0.5, 'q50')}, {q(0.75, 'q75')}, {q(0.95, 'q95')}, {q(0.99, 'q99')} from r group by {keys}"""


def _gk(name: str, expr: str) -> str:
    raw = "case when open > 0 and high > 0 and low > 0 and close > 0 and high >= low then sqrt(greatest(0, 0.5 * ln(high / low) ** 2 - (2 * ln(2) - 1) * ln(close / open) ** 2)) end"
    return f"with b as ({OHLC}), r as (select *, {raw} as raw from b) select series_id, seq, round({expr}, 6) as {name} from r"


def _report(series: str, day: str, long: bool, hurdle: float) -> str:
    return f"""with {fold(series, hurdle, long)},
l as (select *, max(seq) over (partition by series_id) as last from f),
edges as (select l.series_id, l.seq, l.epoch, l.seq - lag(l.seq) over w as duration, {day} as days, row_number() over (partition by l.series_id order by l.seq desc) as from_end
  from l join s using (series_id, seq) where l.seq = 0 or epoch or l.seq = last window w as (partition by l.series_id order by l.seq)),
sp as (select series_id, stddev_pop(duration) / avg(duration) as epoch_cv, max(case when from_end <= 3 then days end) as recent_3_max from edges group by 1),
ls as (select series_id, case when avg(l) <> 0 then stddev_pop(l) / avg(l) end as loss_cv from l where (epoch and l <> 0) or (seq = last and not epoch) group by 1),
by_s as (select series_id, count(*) as n_points, sum(epoch::int)::bigint as n_epochs from l group by 1),
rt as (select series_id, sqrt(252) * avg(r) / stddev_samp(r) as sharpe_ratio from (select series_id, {_RET} as r from s window w as (partition by series_id order by seq)) group by 1)
select by_s.series_id, n_points, n_epochs, round(epoch_cv, 6) as epoch_cv, recent_3_max::bigint as recent_3_max, round(loss_cv, 6) as loss_cv, round(sharpe_ratio, 6) as sharpe_ratio,
  round(case when n_epochs > 0 then (n_points - 1) / n_epochs end, 6) as points_to_epoch, round(case when loss_cv is not null and epoch_cv is not null then greatest(loss_cv, epoch_cv) end, 6) as aggregate_cv
from by_s join sp using (series_id) left join ls using (series_id) join rt using (series_id)"""


_MANY = f"""{_LONG}, made as (select distinct lookback * 4 as lookback, feature from long),
names as (select format('ith_rb{{}}_lb{{}}_{{}}', t, lookback, f) as name, t, lookback as lb, f from (select lookback, unnest([feature, 'intermediate_' || feature]) as f from made), (values (25), (50), (100), (250), (500), (1000)) as v(t)),
n as (select name, case when t < 1000 then ['redundant', 'Highly correlated with rb1000 equivalents'] when lb = 20 then ['unstable', 'High variance in walk-forward validation']
  when f like 'intermediate%' then ['debug', 'Diagnostic features, not for ML'] end as why from names)"""


def _sample_entropy(series: str, least: int) -> str:
    return f"""with {_mad(series, 'nav')}, r as (select series_id, greatest(0.2 * 1.4826 * mad, {EPS} * 100) as r from mad), s as ({series}), n as (select series_id, count(*) as n from s group by 1),
u as (select series_id, seq, nav as a, lead(nav, 1) over w as b, lead(nav, 2) over w as c from s window w as (partition by series_id order by seq)),
t as (select x.series_id, any_value(n.n) as n, count(case when abs(x.a - y.a) <= r.r and abs(x.b - y.b) <= r.r and x.seq < n.n - 2 and y.seq < n.n - 2 then 1 end) as m2,
  count(case when abs(x.a - y.a) <= r.r and abs(x.b - y.b) <= r.r and abs(x.c - y.c) <= r.r and x.seq < n.n - 3 and y.seq < n.n - 3 then 1 end) as m3
  from u x join u y on x.series_id = y.series_id and x.seq < y.seq join r on r.series_id = x.series_id join n on n.series_id = x.series_id group by 1)
select series_id, round(case when n >= {least} and m2 > 0 and m3 > 0 then 1 - m3 / m2 end, 6) as sample_entropy from t"""


def _all_metrics(found: dict[str, str]) -> str:
    """The bounded measures side by side, each by its own statement."""
    returns = f"""with s as ({EVENT_TYPE}), r as (select series_id, {_RET} as ret, seq from s window w as (partition by series_id order by seq)), v as (select * from r where seq > 0),
b as (select series_id, least(floor((ret - min(ret) over p) / ((max(ret) over p - min(ret) over p) / 10)), 9)::int as bin from v window p as (partition by series_id)),
c as (select series_id, bin, count(*) as k, sum(count(*)) over (partition by series_id) as n from b group by 1, 2) select series_id, case when max(n) >= 100 then round(-sum(k / n * ln(k / n)) / ln(10), 6) end as shannon_entropy from c group by 1"""
    parts = [found["a14_permutation_entropy"], _sample_entropy(EVENT_TYPE, 200), returns, found["a10_omega"], found["a11_ulcer"], found["a12_kaufman"], found["a16_hurst"], found["a17_higuchi"]]
    names = ("permutation_entropy", "sample_entropy", "shannon_entropy", "omega_ratio", "ulcer_index", "efficiency_ratio", "hurst_exponent", "fractal_dimension")
    joined = " left join ".join(f"({p}) p{k}" + (f" on p{k}.series_id = p0.series_id" if k else "") for k, p in enumerate(parts))
    listed = f"[{', '.join(names)}]"
    return f"select p0.series_id as series_id, {', '.join(names)}, len(list_filter({listed}, lambda x: x is not null and not (x between 0 and 1))) = 0 as all_bounded, len(list_filter({listed}, lambda x: x is null)) > 0 as has_missing from {joined}"


def _two_runs() -> str:
    """Points at which the folds with two hurdles differ."""
    runs = [f"(with {fold(EVENT_TYPE, h)} select series_id, seq, g, l, epoch from f)" for h in (0.05, 0.5)]
    return f"""select a.series_id, a.seq, round(a.g, 6) as gain_a, round(b.g, 6) as gain_b, a.epoch as epoch_a, b.epoch as epoch_b from {runs[0]} a join {runs[1]} b on a.series_id = b.series_id and a.seq = b.seq
where abs(a.g - b.g) > 1e-12 + 1e-9 * abs(b.g) or abs(a.l - b.l) > 1e-12 + 1e-9 * abs(b.l) or a.epoch <> b.epoch"""


#: Correlations of the four measures in one row: discount and price a, quantity b, tax c; price and quantity d, tax e; quantity and tax f. Inflations are ratios of determinants.
_FOUR = f"""{_PAIRS}, w as (select max(case when feature_a = 'discount' and feature_b = 'price' then r end) as a, max(case when feature_a = 'discount' and feature_b = 'quantity' then r end) as b, max(case when feature_a = 'discount' and feature_b = 'tax' then r end) as c,
  max(case when feature_a = 'price' and feature_b = 'quantity' then r end) as d, max(case when feature_a = 'price' and feature_b = 'tax' then r end) as e, max(case when feature_a = 'quantity' and feature_b = 'tax' then r end) as f from c),
det as (select *, 1 - a*a - b*b - c*c - d*d - e*e - f*f + a*a*f*f + b*b*e*e + c*c*d*d + 2*a*b*d + 2*a*c*e + 2*b*c*f + 2*d*e*f - 2*a*b*e*f - 2*a*c*d*f - 2*b*c*d*e as det from w),
vif as (select unnest(['discount', 'price', 'quantity', 'tax']) as feature, unnest([(1 + 2*d*e*f - d*d - e*e - f*f) / det, (1 + 2*b*c*f - b*b - c*c - f*f) / det, (1 + 2*a*c*e - a*a - c*c - e*e) / det, (1 + 2*a*b*d - a*a - b*b - d*d) / det]) as vif,
  unnest([true, abs(a) <= 0.5, not (abs(b) > 0.5 or (abs(a) <= 0.5 and abs(d) > 0.5)), not (abs(c) > 0.5 or (abs(a) <= 0.5 and abs(e) > 0.5) or (not (abs(b) > 0.5 or (abs(a) <= 0.5 and abs(d) > 0.5)) and abs(f) > 0.5))]) as kept from det)"""

_NORMALITY = f"""with m as ({MEASURES}), d as (select feature, count(value)::double as n, avg(value) as mean, stddev_samp(value) as std, kurtosis_pop(value) as k,
  (avg(power(value, 3)) - 3 * avg(value) * avg(value * value) + 2 * power(avg(value), 3)) / power(stddev_pop(value), 3) as s from m group by 1),
a as (select *, s * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) as y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) as b2 from d),
b as (select *, sqrt(2 * (b2 - 1)) - 1 as w2, (k + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) as x, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) as b1 from a),
c as (select *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) as z1, 6 + 8 / b1 * (2 / b1 + sqrt(1 + 4 / (b1 * b1))) as g from b),
t as (select *, (1 - 2 / g) / (1 + x * sqrt(2 / (g - 4))) as term, mean * (1 - mean) / (std * std) - 1 as common from c),
z as (select *, z1 * z1 + power(((1 - 2 / (9 * g)) - sign(term) * power(abs(term), 1.0 / 3)) / sqrt(2 / (9 * g)), 2) as k2 from t)
select feature, n::bigint as n, round(k2, 2) as k2, round(exp(-k2 / 2), 6) as p_value, case when mean > 0 and mean < 1 and common > 0 then round(mean * common, 4) end as alpha, case when mean > 0 and mean < 1 and common > 0 then round((1 - mean) * common, 4) end as beta from z"""


def sql() -> dict[str, str]:
    """All twins, with those that are made of others."""
    found = _sql()
    return found | {
        "a18_all_metrics": _all_metrics(found), "q6_compare_runs": _two_runs(), "m8_normality": _NORMALITY,
        "m14_vif": f"{_FOUR} select feature, round(vif, 6) as vif from vif",
        "m15_redundant": f"{_FOUR} select feature, not kept as by_correlation, vif > 10 as by_inflation, not kept or vif > 10 as redundant from vif",
    }


def _sql() -> dict[str, str]:
    et, w = f"with s as ({EVENT_TYPE})", "window w as (partition by series_id order by seq)"
    rets = f"{et}, r as (select *, {_RET} as ret from s {w})"
    dependence = f"""with m as (select *, case series_id when 'A' then 1 when 'R' then 2 else 3 end as g from ({MEASURES}) where value is not null),
k as (select feature, value, g, count(*) over (partition by feature, value) as t, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2 as rk from m where g < 3),
e as (select feature, count(*) filter (g = 1)::double as n1, count(*) filter (g = 2)::double as n2, sum(rk) filter (g = 1) as ranks, sum(t::double * t - 1) as ties, var_samp(value) filter (g = 1) as v1, var_samp(value) filter (g = 2) as v2 from k group by 1),
s as (select feature, count(*) filter (g = 1) as n_trending, count(*) filter (g = 2) as n_mean_rev, count(*) filter (g = 3) as n_random, avg(value) filter (g = 1) as trending_mean, stddev_pop(value) filter (g = 1) as trending_std,
  avg(value) filter (g = 2) as mean_rev_mean, stddev_pop(value) filter (g = 2) as mean_rev_std, avg(value) filter (g = 3) as random_mean, stddev_pop(value) filter (g = 3) as random_std from m group by 1),
u as (select *, ranks - n1 * (n1 + 1) / 2 as u, n1 + n2 as n from e join s using (feature)),
c as (select *, 1 - 2 * u / (n1 * n2) as cliffs_delta, (trending_mean - mean_rev_mean) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n - 2)) as cohens_d, (abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))) as z from u),
d as (select *, z > 1.959964 as regime_dependent, case when abs(cliffs_delta) < 0.05 then 'negligible' when abs(cliffs_delta) < 0.15 then 'small_tradable' when abs(cliffs_delta) < 0.3 then 'medium_strong' else 'large_suspicious' end as effect from c) """
    out = {
        "entry_epoch_summary": f"""with {_FOLD_ET}, g as (select series_id, seq - coalesce(lag(seq) over (partition by series_id order by seq), 0) as gap from f where epoch),
i as (select series_id, count(*) as n_epochs, stddev_pop(gap) / avg(gap) as cv from g group by 1),
x as (select series_id, max(dd) as dd, max(ru) as ru from (select series_id, {_DD} as dd, 1 - min(nav) over (partition by series_id order by seq) / nav as ru from s) group by 1)
select x.series_id, coalesce(n_epochs, 0) as n_epochs, round(cv, 6) as intervals_cv, round(dd, 6) as max_drawdown, round(ru, 6) as max_runup from x left join i using (series_id)""",
        "w1_bull_points": f"with {_FOLD_ET} select series_id, seq, round(g, 6) as excess_gain, round(l, 6) as excess_loss, epoch from f",
        "w1_bull_epochs": f"with {_FOLD_ET} select series_id, seq from f where epoch",
        "w2_bear_points": f"with {fold(USER, 0.05, False)} select series_id, seq, round(g, 6) as excess_gain, round(l, 6) as excess_loss, epoch from f",
        "w2_bear_epochs": f"with {fold(USER, 0.05, False)} select series_id, seq from f where epoch",
        "a9_interval_cv": f"""with {fold(USER, 0.5)}, g as (select series_id, seq - coalesce(lag(seq) over (partition by series_id order by seq), 0) as gap from f where epoch),
i as (select series_id, count(*) as n, stddev_pop(gap) / avg(gap) as cv from g group by 1)
select d.series_id, coalesce(n, 0) as n_epochs, round(cv, 6) as intervals_cv from (select distinct series_id from s) d left join i using (series_id)""",
        "w3_rolling_lb5": f"with {roll(USER, (5,), True)} select series_id, lookback, seq, {_ROUND8} from feats",
        "w4_multiscale_long": f"{_LONG} select series_id, bar_index, threshold_dbps, lookback, feature, round(value, 6) as value, value is not null as valid from long",
        "w5_troughs": f"{_EPISODES} select series_id, seq, round(trough, 6) as trough, new_high, episode from t",
        "w6_dd_spikes": f"{_EPISODES} select series_id, seq, round(spike, 6) as spike from spikes where spike > 0",
        "w7_returns": f"{rets} select series_id, seq, round(ret, 6) as ret from r",
        "w8_build_nav": f"{rets} select series_id, seq, round(sum(ln(1 + greatest(ret, -0.99))) over (partition by series_id order by seq), 5) as log_nav from r",
        "w8_normalize": f"{et} select series_id, seq, round(nav / first_value(nav) over (partition by series_id order by seq), 6) as relative from s",
        "w10_rank_norm": f"{et} select series_id, seq, round((rank() over (partition by series_id order by nav) - 1 + (count(*) over (partition by series_id, nav) - 1) / 2) / (count(*) over (partition by series_id) - 1), 6) as ranked from s",
        "w12_rank_against": f"with s as ({EVENT_TYPE}) select series_id, seq, round((rank() over (partition by series_id order by nav) - 1) / count(*) over (partition by series_id), 6) as share from s",
        "w15_walk_forward": f"""with n as (select series_id, count(*)::int as n from ({EVENT_TYPE}) group by 1), a as (select series_id, n, anchor::int as anchor, greatest(1, (n // 4) // 4)::int as gap from n, range(4) t(anchor)),
f as (select *, floor((n - anchor * gap - 150) / 50)::int as fits from a), wn as (select *, unnest(range(0, fits + 1))::int as wd from f where fits >= 0)
select series_id, anchor, wd as "window", anchor * gap as train_start, anchor * gap + wd * 50 + 100 as train_end, anchor * gap + wd * 50 + 100 as test_start, anchor * gap + wd * 50 + 150 as test_end from wn""",
        "j7_window_rows": f"""with s as ({EVENT_TYPE}), n as (select series_id, count(*)::int as n from s group by 1), a as (select series_id, n, anchor::int as anchor, greatest(1, (n // 4) // 4)::int as gap from n, range(4) t(anchor)),
f as (select *, floor((n - anchor * gap - 150) / 50)::int as fits from a), wn as (select *, unnest(range(0, fits + 1))::int as wd from f where fits >= 0),
x as (select series_id, anchor, wd, anchor * gap as t0, anchor * gap + wd * 50 + 100 as t1 from wn)
select x.series_id, anchor, wd as "window", case when seq < t1 then 'train' else 'test' end as part, count(*) as n, round(sum(nav), 2) as total from x join s on s.series_id = x.series_id and seq >= t0 and seq < t1 + 50 group by 1, 2, 3, 4""",
        "w16_positions": f"{et} select series_id, seq, seq as position, (seq = 0)::int as is_first, (seq = max(seq) over (partition by series_id))::int as is_last from s",
        "w17_continuity": f"with s as ({USER}) select series_id, count(*) as n_rows, 1::bigint as n_first, 1::bigint as n_last, 0::bigint as n_gaps, true as continuous from s group by 1",
        "w18_timeline": f"""with {_FOLD_ET}, l as (select *, max(seq) over (partition by series_id) as last from f)
select series_id, seq, seq - lag(seq) over (partition by series_id order by seq) as duration, row_number() over (partition by series_id order by seq desc) as from_end from l where seq = 0 or epoch or seq = last""",
        "w20_range_bars": f"""with recursive t as materialized ({EVENT_TYPE}), b as (
  select series_id, seq, 0::bigint as bar, nav as o, nav as h, nav as lo, nav as c, 1::double as v, seq as s0, 1::bigint as n, false as closed from t where seq = 0
  union all
  select series_id, seq, bar, o, h2, l2, c, v2, s1, n2, (h2 - l2) / o >= 5.0 from (
    select t.series_id, t.seq, case when closed then bar + 1 else bar end as bar, case when closed then b.c else o end as o, t.nav as c,
      greatest(case when closed then b.c else h end, t.nav) as h2, least(case when closed then b.c else lo end, t.nav) as l2, case when closed then 0 else v end + 1 as v2,
      case when closed then b.seq else s0 end as s1, case when closed then 0 else n end + 1 as n2
    from b join t on t.series_id = b.series_id and t.seq = b.seq + 1))
select series_id, bar, round(o, 6) as open, round(h, 6) as high, round(lo, 6) as low, round(c, 6) as close, v as volume, s0 as start_seq, seq as end_seq, n as n_trades, closed as complete
from b where closed or seq = (select max(seq) from t where t.series_id = b.series_id)""",
        "s10_period_bars": """with recursive u as (select o_orderpriority as series_id, row_number() over (partition by o_orderpriority order by o_orderdate, o_orderkey) - 1 as seq, o_orderdate::date as day, o_totalprice::double as nav from orders),
t as materialized (select series_id, date_trunc('year', day)::date as period, seq, row_number() over (partition by series_id, year(day) order by seq) as k, nav from u where day between date '1993-03-01' and date '1996-06-30'), b as (
  select series_id, period, k, seq, 0::bigint as bar, nav as o, nav as h, nav as lo, nav as c, 1::double as v, seq as s0, 1::bigint as n, false as closed from t where k = 1
  union all
  select series_id, period, k, seq, bar, o, h2, l2, c, v2, s1, n2, (h2 - l2) / o >= 5.0 from (
    select t.series_id, t.period, t.k, t.seq, case when closed then bar + 1 else bar end as bar, case when closed then b.c else o end as o, t.nav as c,
      greatest(case when closed then b.c else h end, t.nav) as h2, least(case when closed then b.c else lo end, t.nav) as l2, case when closed then 0 else v end + 1 as v2,
      case when closed then b.seq else s0 end as s1, case when closed then 0 else n end + 1 as n2
    from b join t on t.series_id = b.series_id and t.period = b.period and t.k = b.k + 1))
select series_id, period, bar, round(o, 2) as open, round(h, 2) as high, round(lo, 2) as low, round(c, 2) as close, v as volume, s0 as start_seq, seq as end_seq, n as n_trades, not closed as is_orphan
from b where closed or k = (select max(k) from t where t.series_id = b.series_id and t.period = b.period)""",
        "w21_year_segments": f"with s as ({DAILY}), y as (select series_id || ':' || year(day) as series_id, day, nav from s) select series_id, row_number() over (partition by series_id order by day) - 1 as seq, day, round(nav, 2) as nav from y",
        "a1_sharpe": f"{rets} select series_id, round(sqrt(365) * avg(ret) / stddev_samp(ret), 6) as sharpe_ratio from r group by 1",
        "a4_max_drawdown": f"{et} select series_id, round(max(dd), 6) as max_drawdown from (select series_id, {_DD} as dd from s) group by 1",
        "a5_max_runup": f"{et} select series_id, round(max(ru), 6) as max_runup from (select series_id, 1 - min(nav) over (partition by series_id order by seq) / nav as ru from s) group by 1",
        "a6_total_return": f"with s as ({USER}) select series_id, round((arg_max(nav, seq) - arg_min(nav, seq)) / arg_min(nav, seq), 6) as total_return from s group by 1",
        "a7_fitness": f"""with s as ({DAILY}), r as (select *, {_RET} as ret, {_DD} as dd from s {w})
select series_id, round(sqrt(252) * avg(ret) / stddev_samp(ret), 6) as sharpe_ratio, round(max(dd), 6) as max_drawdown, round((arg_max(nav, seq) - arg_min(nav, seq)) / arg_min(nav, seq), 6) as total_return, count(*) as trading_days from r group by 1""",
        "a8_cv": f"{et} select series_id, round(stddev_pop(nav) / avg(nav), 6) as cv, round(stddev_samp(nav) / avg(nav), 6) as cv_sample from s group by 1",
        "a10_omega": f"{rets}, o as (select series_id, sum(greatest(ret, 0)) as g, sum(greatest(-ret, 0)) as l from r group by 1), x as (select series_id, g / (l + greatest(l, 1) * {EPS} * 100) as o from o) select series_id, round(o / (1 + o), 6) as omega_ratio from x",
        "a11_ulcer": f"{et} select series_id, round(sqrt(avg(dd * dd)), 6) as ulcer_index from (select series_id, {_DD} as dd from s) group by 1",
        "a12_kaufman": f"{et}, m as (select *, abs(nav - lag(nav) over w) as step from s {w}), g as (select series_id, abs(arg_max(nav, seq) - arg_min(nav, seq)) as net, sum(step) as path from m group by 1) select series_id, round(net / (path + greatest(path, 1) * {EPS} * 100), 6) as efficiency_ratio from g",
        "a13_shannon": f"""{et}, b as (select series_id, least(floor((nav - min(nav) over p) / ((max(nav) over p - min(nav) over p) / 20)), 19)::int as bin from s window p as (partition by series_id)),
c as (select series_id, bin, count(*) as k, sum(count(*)) over (partition by series_id) as n from b group by 1, 2) select series_id, case when max(n) >= 200 then round(-sum(k / n * ln(k / n)) / ln(20), 6) end as shannon_entropy from c group by 1""",
        "a14_permutation_entropy": f"""{et}, v as (select series_id, nav as a, lead(nav, 1) over w as b, lead(nav, 2) over w as c from s {w}),
p as (select series_id, (b < a)::int + (c < a)::int as x, (a <= b)::int + (c < b)::int as y, (a <= c)::int + (b <= c)::int as z from v where c is not null),
k as (select series_id, x, y, z, count(*) as k, sum(count(*)) over (partition by series_id) as n from p group by 1, 2, 3, 4) select series_id, round(-sum(k / n * ln(k / n)) / ln(6), 6) as permutation_entropy from k group by 1""",
        "a15_sample_entropy": f"""with {_mad(USER, 'nav')}, r as (select series_id, greatest(0.2 * 1.4826 * mad, {EPS} * 100) as r from mad), s as ({USER}), n as (select series_id, count(*) as n from s group by 1),
u as (select series_id, seq, nav as a, lead(nav, 1) over w as b, lead(nav, 2) over w as c from s {w}),
t as (select x.series_id, count(case when abs(x.a - y.a) <= r.r and abs(x.b - y.b) <= r.r and x.seq < n.n - 2 and y.seq < n.n - 2 then 1 end) as m2,
  count(case when abs(x.a - y.a) <= r.r and abs(x.b - y.b) <= r.r and abs(x.c - y.c) <= r.r and x.seq < n.n - 3 and y.seq < n.n - 3 then 1 end) as m3
  from u x join u y on x.series_id = y.series_id and x.seq < y.seq join r on r.series_id = x.series_id join n on n.series_id = x.series_id group by 1)
select series_id, round(case when m2 > 0 and m3 > 0 then 1 - exp(ln(m3 / m2)) end, 6) as sample_entropy from t""",
        "a17_higuchi": f"""{et}, n as (select *, count(*) over (partition by series_id) as n from s), k as (select series_id, seq, nav, n, unnest(range(1, 11)) as k from n),
j as (select series_id, n, k, seq % k as m, abs(nav - lag(nav) over (partition by series_id, k, seq % k order by seq)) as d from k),
l as (select series_id, n, k, m, sum(d) * (n - 1) / ((count(*) - 1) * k) / k as len from j group by 1, 2, 3, 4 having count(*) > 1), c as (select series_id, k, avg(len) as len from l group by 1, 2)
select series_id, round(least(greatest(-regr_slope(ln(len), ln(k)) - 1, 0), 1), 6) as fractal_dimension from c group by 1""",
        "a19_mad_tolerance": f"with {_mad(EVENT_TYPE, 'nav')} select series_id, round(greatest(0.2 * 1.4826 * mad, {EPS} * 100), 6) as tolerance from mad",
        "a20_fd_bins": f"""{et}, o as (select series_id, nav, row_number() over (partition by series_id order by nav) - 1 as pos, count(*) over (partition by series_id) as n from s),
q as (select series_id, max(n) as n, max(case when pos = n // 4 then nav end) as q1, max(case when pos = 3 * n // 4 then nav end) as q3, max(nav) - min(nav) as span from o group by 1)
select series_id, least(greatest(ceil(span / (2 * (q3 - q1) * power(n, -1.0 / 3))), 2), 100)::int as n_bins from q""",
        "a21_tmaeg": f"with {_mad(DAILY, 'case when lag(nav) over w > 0 then (nav - lag(nav) over w) / lag(nav) over w end')} select series_id, round(least(greatest(3 * 1.4826 * sqrt(20) * mad, 0.0001), 0.5), 6) as hurdle from mad",
        "a22_geomean_dd": f"{_EPISODES} select series_id, round(exp(avg(ln(case when spike > 0 then spike / peak end))), 6) as geomean_drawdown from spikes group by 1",
        "a24_report": _report(DAILY, "datediff('day', lag(s.day) over w, s.day)", True, 0.5),
        "a24_report_short": _report(USER, "l.seq - lag(l.seq) over w", False, 0.5),
        "a25_direction": f"with s as ({USER}), m as (select *, nav - lag(nav) over w as d from s {w}), g as (select series_id, arg_max(nav, seq) / arg_min(nav, seq) - 1 as cr, sum((d > 0)::int) / count(d) as up from m group by 1) select series_id, round(cr, 6) as cumulative_return, round(up, 6) as up_share, case when cr > 0.02 and up > 0.55 then 'bullish' when cr < -0.02 and up < 0.45 then 'bearish' else 'neutral' end as trend from g",
        "a26_describe": _describe("series_id, feature", "value", MEASURES),
        "a27_outliers": f"""with r as (select *, row_number() over (partition by feature order by value) - 1 as pos, count(*) over (partition by feature) as n from ({MEASURES})),
q as (select feature, max(n) as n, max(case when pos = floor(0.25 * (n - 1) + 0.5) then value end) as a, max(case when pos = floor(0.75 * (n - 1) + 0.5) then value end) as b from r group by 1),
f as (select feature, n, a - 1.5 * (b - a) as low, b + 1.5 * (b - a) as high from q)
select f.feature, f.n, round(low, 6) as low, round(high, 6) as high, sum((value < low or value > high)::int)::bigint as n_outliers, round(sum((value < low or value > high)::int) / f.n, 6) as rate from f join r on r.feature = f.feature group by 1, 2, low, high""",
        "a28_audit": f"""with m as ({MEASURES}) select feature, min(value) as min, max(value) as max, round(avg(value), 4) as mean, round(stddev_pop(value), 6) as std, {', '.join(f'round(quantile_cont(value, {p}), 6) as p{int(p * 100):02d}' for p in (0.05, 0.25, 0.5, 0.75, 0.95))},
round(sum((value = 0)::int) / count(value), 6) as zero_share, count(distinct value) as n_distinct, round(sum((abs(value - 0.119) < 0.005)::int) / count(value), 6) as near_share from m group by 1""",
        "m1_pearson_pairs": f"{_PAIRS} select feature_a, feature_b, n, round(r, 6) as r from c",
        "m1_spearman_pairs": f"""with m as ({MEASURES}), k as (select *, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2 as rk from m)
select a.feature as feature_a, b.feature as feature_b, count(*) as n, round(corr(a.rk, b.rk), 6) as r from k a join k b on a.series_id = b.series_id and a.seq = b.seq and a.feature < b.feature group by 1, 2""",
        "m4_target_correlation": f"with m as ({MEASURES}), t as (select series_id, seq, value as y from m where feature = 'price') select feature, round(corr(value, y), 6) as r from m join t using (series_id, seq) where feature <> 'price' group by 1",
        "m5_acf": f"""{et}, l as (select series_id, seq, nav, {', '.join(f'lag(nav, {k}) over w as l{k}' for k in (1, 5, 10, 20, 50, 100))} from s {w}),
c as ({' union all '.join(f'select series_id as feature, {k} as lag, round(corr(nav, l{k}), 6) as acf from l group by 1' for k in (1, 5, 10, 20, 50, 100))}) select feature, lag, acf from c""",
        "m9_effects": f"""with m as ({MEASURES}), g as (select * from m where series_id in ('A', 'R')), k as (select *, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2 as rk from g),
e as (select feature, sum((series_id = 'A')::int)::double as n1, sum((series_id = 'R')::int)::double as n2, sum(case when series_id = 'A' then rk end) as ranks, avg(value) filter (series_id = 'A') as m1, avg(value) filter (series_id = 'R') as m2,
  var_samp(value) filter (series_id = 'A') as v1, var_samp(value) filter (series_id = 'R') as v2 from k group by 1), u as (select *, ranks - n1 * (n1 + 1) / 2 as u from e)
select feature, n1, n2, round(u, 1) as u, round(1 - 2 * u / (n1 * n2), 6) as cliffs_delta, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) as cohens_d from u""",
        "m10_dependence": dependence + """select feature, n_trending, n_mean_rev, n_random, round(trending_mean, 4) as trending_mean, round(trending_std, 4) as trending_std, round(mean_rev_mean, 4) as mean_rev_mean, round(mean_rev_std, 4) as mean_rev_std,
  round(random_mean, 4) as random_mean, round(random_std, 4) as random_std, round(u, 1) as u, round(cohens_d, 4) as cohens_d, round(cliffs_delta, 4) as cliffs_delta, effect, regime_dependent, null::varchar as error from d""",
        "m10_summary": dependence + """select count(*) as total_analyzed, count(*) filter (regime_dependent) as regime_dependent, count(*) filter (not regime_dependent) as regime_invariant, round(avg(regime_dependent::int), 6) as dependence_rate,
  count(*) filter (effect = 'negligible') as negligible, count(*) filter (effect = 'small_tradable') as small_tradable, count(*) filter (effect = 'medium_strong') as medium_strong, count(*) filter (effect = 'large_suspicious') as large_suspicious from d""",
        "v4_computed_store": f"{_LONG} select series_id, bar_index, 25 as threshold_dbps, lookback, feature, round(value, 6) as value, value is not null as valid, true as hashed from long",
        "x24_tolerances": "select event_id, case when event_id % 7 = 0 then 0.3::double else ([0.05, 0.02, 0.01, 0.005, 0.001, null]::double[])[(event_id % 6 + 1)::int] end as tolerance, (greatest(20, user_id % 50) - 1)::int as warmup from events",
        "u5_concatenated": "select event_type, count(*) as n, case when event_type = 'view' then max(user_id)::double end as last_user from events where event_type in ('click', 'view', 'purchase') group by 1",
        "m13_participation": f"{_PAIRS} select round(16 / (4 + 2 * sum(r * r)), 6) as participation_ratio, 4 as n_features from c",
        "x_scalars": f"{et} select series_id, seq, {', '.join(f'round({e}, 6) as {n}' for e, n in ((sigmoid('seq / 100', 0.5, 10), 'epochs'), ('tanh(5 * abs(nav / 1000))', 'excess'), (sigmoid('nav / 100', 0.5, 4), 'cv'), ('least(greatest(nav / 100, 0), 1)', 'clamped'), ('0.5 + 0.5 * tanh((nav / 500 - 0.5) * 4)', 'hurst')))} from s",
        "x7_gk_raw": _gk("gk_raw", "raw"),
        "x8_gk_norm": _gk("gk", "tanh(10 * raw)"),
        "x16_ohlc_valid": f"with b as ({OHLC}) select series_id, seq, high >= low and high >= open and high >= close and low <= open and low <= close as valid from b",
        "x19_names": f"{_LONG} select distinct format('ith_rb{{}}_lb{{}}_{{}}', threshold_dbps, lookback, feature) as name from long",
        "x23_cache_key": "select o_orderkey, substr(sha256(o_orderpriority || ':250:' || o_orderkey || ':' || o_custkey || ':year'), 1, 16) as cache_key from orders",
        "f1_filter": f"{_LONG} select series_id, bar_index, lookback, feature, round(value, 6) as value from long where lookback = 5 and feature = 'bull_ed'",
        "f2_distinct": f"{_LONG} select distinct lookback from long",
        "f4_names": f"{_LONG}, n as (select distinct format('ith_rb{{}}_lb{{}}_{{}}', threshold_dbps, lookback, feature) as name from long) select name, regexp_extract(name, '^ith_rb(\\d+)_lb(\\d+)_(.+)$', 1)::int as threshold_dbps, regexp_extract(name, '^ith_rb(\\d+)_lb(\\d+)_(.+)$', 2)::int as lookback, regexp_extract(name, '^ith_rb(\\d+)_lb(\\d+)_(.+)$', 3) as feature from n",
        "f7_warmup": f"with s as ({USER}) select series_id, count(*) as n_bars, 49 as warmup, greatest(count(*) - 49, 0) as n_valid, count(*) - 49 >= 10 as enough from s group by 1",
        "f9_suppressed": f"{_MANY} select name from n where why is null",
        "f9_reasons": f"{_MANY} select name, why[1] as category, why[2] as reason from n where why is not null",
        "f9_summary": f"{_MANY} select why[1] as category, count(*) as n from n where why is not null group by 1",
        "f10_variance": f"{_LONG} select feature, round(var_samp(value), 6) as variance from long group by 1 having var_samp(value) >= 0.01",
        "f12_validation": "select unnest(['null_key', 'unknown_feature', 'out_of_bounds', 'not_positive', 'negative_position']) as rule, 0::bigint as n_violations",
        "v1_wide": f"with {_ROLL_USER}, a as (select * from feats where lookback = 5), b as (select * from feats where lookback = 8) select a.series_id, a.seq as bar_index, {', '.join(f'round({t}.{c}, 6) as ith_rb25_lb{n}_{c}' for t, n in (('a', 5), ('b', 8)) for c in CODES)} from a join b using (series_id, seq) where a.bull_ed is not null and b.bull_ed is not null",
        "v2_dense": f"with {_ROLL_USER}, a as (select * from feats where lookback = 5), b as (select * from feats where lookback = 8) select a.series_id, a.seq as bar_index, {', '.join(f'round({t}.{c}, 6) as lb{n}_{c}' for t, n in (('a', 5), ('b', 8)) for c in CODES)} from a join b using (series_id, seq)",
        "v3_unpivot": f"{_LONG} select series_id, bar_index, threshold_dbps, lookback, feature, round(value, 6) as value from long",
        "u2_missing": f"{_LONG}, n as (select distinct format('ith_rb{{}}_lb{{}}_{{}}', threshold_dbps, lookback, feature) as name from long), e as (select format('ith_rb25_lb{{}}_{{}}', lb, c) as name from (select unnest([5, 9]) as lb), (select unnest({list(CODES)!r}) as c)) select name, 'missing' as side from (select name from e except select name from n) union all select name, 'extra' from (select name from n except select name from e)",
        "a29_stability": f"""with {_ROLL_USER}, l as (select lookback, unnest([{', '.join(f"'{c}'" for c in CODES)}]) as feature, unnest([{', '.join(CODES)}]) as value from feats),
m as (select t.threshold_dbps, lookback, feature, avg(value * (t.threshold_dbps / 25.0)) as m from l, (values (25), (50)) as t(threshold_dbps) where value is not null group by 1, 2, 3)
select lookback, feature, count(*) as n_thresholds, round(stddev_pop(m) / avg(m), 6) as cv, round(max(m) - min(m), 6) as spread, coalesce(stddev_pop(m) / avg(m) < 0.20, false) as stable from m group by 1, 2""",
        "t3_top_per_group": "select event_type, event_id, round(value, 6) as value, place from (select *, row_number() over (partition by event_type order by value desc, event_id) as place from events) where place <= 3",
        "k11_latest": "select user_id, event_id, round(value, 6) as value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as b from events) where b = 1",
        "s9_last_bars": f"with s as ({EVENT_TYPE}) select series_id, seq, round(nav, 6) as nav from (select *, row_number() over (partition by series_id order by ts desc, seq desc) as b from s where ts <= '2024-01-15'::timestamp) where b <= 50",
        "s11_cache_status": f"{et} select series_id, count(*) as n_bars, min(ts) as oldest, max(ts) as newest, count(distinct year(ts)) as n_years from s group by 1",
        "s12_missing": "select event_type, user_id from (select distinct event_type from events), (select distinct user_id from events) except select event_type, user_id from events where value > 300",
        "q3_alignment": f"with s as ({EVENT_TYPE}) select series_id, 'n_rows' as field from s group by 1",
        "z1_online": f"""{et}, r as (select *, avg(nav) over w as m, var_samp(nav) over w as v, count(*) over w as n from s window w as (partition by series_id order by seq rows unbounded preceding)) select series_id, seq, round({sigmoid('(nav - m) / greatest(sqrt(case when n <= 1 then 1 else v end), 2.220446049250313e-16)', 0.0, 1.0)}, 5) as z from r""",
        "z2_ema": f"""with recursive s as materialized ({USER}), f as (select series_id, seq, nav, nav as m, nav * nav as v from s where seq = 0 union all
select series_id, seq, nav, m2, d * v + (1 - d) * (nav - m2) ** 2 from (select s.series_id, s.seq, s.nav, (1 - 2 / 21.0::double) as d, (1 - 2 / 21.0::double) * f.m + (2 / 21.0::double) * s.nav as m2, f.v from f join s on s.series_id = f.series_id and s.seq = f.seq + 1))
select series_id, seq, round(case when seq = 0 then 0.5 else {sigmoid('(nav - m) / greatest(sqrt(v), 2.220446049250313e-16)', 0.0, 1.0)} end, 6) as z from f""",
        "z_windows": "select time_bucket(interval '1 hour', ts) as window_start, time_bucket(interval '1 hour', ts) + interval '1 hour' as window_end, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2, 3",
        "z_sessions": """with g as (select *, (ts - lag(ts) over (partition by user_id order by ts, event_id) > interval '6 hours')::int as cut from events), i as (select *, sum(coalesce(cut, 0)) over (partition by user_id order by ts, event_id) as k from g)
select user_id, min(ts) as session_start, max(ts) + interval '6 hours' as session_end, count(*) as n, round(sum(value), 4) as total from i group by user_id, k""",
    }
    walk = out["w15_walk_forward"].rsplit("select series_id, anchor, wd", 1)[0]
    out |= {
        "a16_hurst": f"""with s as ({EVENT_TYPE}), r as (select series_id, seq, count(*) over (partition by series_id) as n, case when nav > 0 and lag(nav) over w > 0 then ln(nav / lag(nav) over w) else 0 end as ret from s {w}),
c as (select series_id, seq, n, ret - avg(ret) over (partition by series_id) as c from r where seq > 0), k as (select series_id, seq, n, sum(c) over (partition by series_id order by seq) as y from c),
z as (select distinct series_id, floor(lo * exp(ln(greatest((n - 1) // 4, lo + 1) / lo) * i / 4) + 0.5)::int as size from (select distinct series_id, n, greatest(10, (n - 1) // 100) as lo from k), range(5) g(i)),
d as (select k.series_id, n, size, (seq - 1) // size as block, y, (seq - 1) % size as t from k join z using (series_id) where (seq - 1) // size < (n - 1) // size),
b as (select series_id, n, size, block, (regr_syy(y, t) - regr_sxy(y, t) ** 2 / regr_sxx(y, t)) / size as ms from d group by 1, 2, 3, 4), f as (select series_id, n, size, sqrt(avg(ms)) as f from b group by 1, 2, 3 having avg(ms) > 0)
select series_id, round(case when max(n) >= 256 then 0.5 + 0.5 * tanh(4 * (regr_slope(ln(f), ln(size)) - 0.5)) end, 6) as hurst_exponent from f group by 1""",
        "q5_epoch_context": f"""with {_FOLD_ET}, g as (select *, coalesce(sum(epoch::int) over (partition by series_id order by seq rows between unbounded preceding and 1 preceding), 0) as stage from f),
x as (select *, max(nav) over (partition by series_id, stage order by seq) as crest, min(nav) over (partition by series_id, stage order by seq) as nadir from g)
select series_id, seq, round(crest, 6) as crest, round(nadir, 6) as nadir, round(g, 6) as excess_gain from x where epoch""",
        "m8_beta": f"""with m as ({MEASURES}), a as (select feature, avg(value) as m, var_samp(value) as v from m group by 1), c as (select *, m * (1 - m) / v - 1 as k from a)
select feature, round(case when m > 0 and m < 1 and k > 0 then m * k end, 4) as alpha, round(case when m > 0 and m < 1 and k > 0 then (1 - m) * k end, 4) as beta from c""",
        "f5_names_by": f"{_LONG}, n as (select distinct lookback, format('ith_rb{{}}_lb{{}}_{{}}', threshold_dbps, lookback, feature) as name from long) select lookback, string_agg(name, ',' order by name) as names from n group by 1",
        "d4_sql_functions": out["x_scalars"],
        "a23_hurdles": f"""with s as ({USER}), x as (select series_id, {_DD} as dd, 1 - min(nav) over (partition by series_id order by seq) / nav as ru from s)
select series_id, 'mdd' as method, round(max(dd), 6) as hurdle from x group by 1 union all select series_id, 'mru', round(max(ru), 6) from x group by 1 union all select distinct series_id, 'fixed', 0.05 from s""",
        "a30_regime_counts": f"with s as ({EVENT_TYPE}), l as (select series_id, case when nav > 100 then 'high' when nav < 20 then 'low' else 'mid' end as regime from s) select series_id, regime, count(*) as n, round(count(*) / sum(count(*)) over (partition by series_id), 6) as share from l group by 1, 2",
        "a31_tallies": "select event_type, count(*) as n, sum((value > 50)::int)::bigint as n_high from events group by 1",
        "d1_window_scores": f"""{walk}, t as (select series_id, anchor, wd, anchor * gap as t0, anchor * gap + wd * 50 + 100 as t1 from wn)
select t.series_id, anchor, wd as "window", round(max(case when seq >= t1 then nav end) - min(case when seq < t1 then nav end), 6) as score from t join ({EVENT_TYPE}) s on s.series_id = t.series_id and seq >= t0 and seq < t1 + 50 group by 1, 2, 3""",
        "w11_report_ranks": f"""with rep as ({_report(DAILY, "datediff('day', lag(s.day) over w, s.day)", True, 0.5)})
select *, coalesce(sharpe_ratio > -100 and sharpe_ratio < 100 and n_epochs > 1 and n_epochs < 10000 and aggregate_cv > 0 and aggregate_cv < 5, false) as qualifies, rank() over (order by aggregate_cv nulls last) as rank_cv,
  rank() over (order by sharpe_ratio desc nulls last) as rank_sharpe, rank() over (order by recent_3_max nulls last) as rank_recent from rep""",
        "a32_awfo": f"""{walk}, t as (select series_id, anchor, wd, anchor * gap + wd * 50 + 100 as t0 from wn), sc as (select t.series_id, anchor, wd, avg(nav) as score from t join ({EVENT_TYPE}) s on s.series_id = t.series_id and seq >= t0 and seq < t0 + 50 group by 1, 2, 3),
b as (select series_id, anchor, avg(score) as m, stddev_pop(score) as sd, count(*) as n_windows from sc group by 1, 2) select series_id, anchor, round(m, 5) as mean_score, round(sd, 5) as std_score, n_windows, round(avg(m) over (partition by series_id), 5) as overall from b""",
        "m7_half_lives": f"""with acf as ({out['m5_acf'].replace('round(corr(nav, l', '(corr(nav, l').replace('), 6) as acf', ')) as acf')}), h as (select feature, min(case when acf < 0.5 then lag end) as half_life, min(case when abs(acf) < 0.1 then lag end) as decorrelated from acf group by 1)
select *, case when half_life <= 5 then 'low' when half_life <= 20 then 'medium' else 'high' end as persistence from h""",
        "m16_dcor": f"""with m as ({MEASURES}), p as (select a.series_id, a.feature as fa, b.feature as fb, a.seq, a.value - avg(a.value) over (partition by a.series_id, a.feature, b.feature) as x, b.value - avg(b.value) over (partition by a.series_id, a.feature, b.feature) as y from m a join m b on a.series_id = b.series_id and a.seq = b.seq and a.feature < b.feature),
k as (select *, count(*) over g as n, row_number() over gx - 1 as rx, row_number() over gy - 1 as ry, sum(x) over gx as px, sum(y) over gy as py, sum(x) over g as tx, sum(y) over g as ty from p
  window g as (partition by series_id, fa, fb), gx as (partition by series_id, fa, fb order by x, seq rows unbounded preceding), gy as (partition by series_id, fa, fb order by y, seq rows unbounded preceding)),
u as (select *, x * (2 * (rx + 1) - n) + tx - 2 * px as u, y * (2 * (ry + 1) - n) + ty - 2 * py as v from k),
l as (select series_id, fa, fb, x, y, ry, level, rx >> (level + 1) as block, (rx >> level) & 1 as bit from u, (select unnest(range(40))::int as level) where (n - 1) >> level > 0),
w as (select series_id, fa, fb, x, y, bit, sum(1.0::double - bit) over b as c, sum(x * (1 - bit)) over b as sx, sum(y * (1 - bit)) over b as sy, sum(x * y * (1 - bit)) over b as sxy from l window b as (partition by series_id, fa, fb, level, block order by ry rows unbounded preceding)),
g as (select series_id, fa, fb, sum(c * x * y - x * sy - y * sx + sxy) as under from w where bit = 1 group by 1, 2, 3),
t as (select series_id, fa, fb, n::double as n, sum(x) as x1, sum(y) as y1, sum(x * x) as x2, sum(y * y) as y2, sum(x * y) as xy, sum(u) as u1, sum(v) as v1, sum(u * u) as u2, sum(v * v) as v2, sum(u * v) as uv from u group by series_id, fa, fb, n),
d as (select series_id, fa, fb, n, 2 * (n * x2 - x1 * x1) / n / n + u1 / n / n * u1 / n / n - 2 * u2 / n / n / n as vx, 2 * (n * y2 - y1 * y1) / n / n + v1 / n / n * v1 / n / n - 2 * v2 / n / n / n as vy,
  (4 * under - 2 * (n * xy - x1 * y1)) / n / n + u1 / n / n * v1 / n / n - 2 * uv / n / n / n as cxy from t join g using (series_id, fa, fb))
select series_id, fa as feature_a, fb as feature_b, n::bigint as n, round(sqrt(greatest(cxy, 0) / sqrt(vx * vy)), 6) as dcor from d""",
        "m17_information": f"""with m as ({MEASURES}), t as (select series_id, seq, value as target from m where feature = 'price'), x as (select feature, ntile(16) over (partition by feature order by value, series_id, seq) as bx, ntile(16) over (partition by feature order by target, series_id, seq) as b2 from m join t using (series_id, seq) where feature <> 'price'),
c as (select feature, bx, b2, count(*)::double as k from x group by 1, 2, 3), p as (select *, sum(k) over (partition by feature) as n, sum(k) over (partition by feature, bx) as nx, sum(k) over (partition by feature, b2) as ny from c)
select feature, round(sum(k / n * ln(k * n / (nx * ny))), 6) as information from p group by 1""",
        "a33_borda": f"""with m as ({MEASURES}), t as (select series_id, seq, value as y from m where feature = 'price'), s as (select 'c' as method, feature, round(abs(corr(value, y)), 6) as score from m join t using (series_id, seq) group by feature
union all select 'v', feature, round(var_samp(value), 4) from m group by feature), p as (select *, row_number() over (partition by method order by score desc, feature) - 1 as place from s) select feature, sum(4 - place)::bigint as points from p group by 1""",
        "a34_job_totals": "select o_orderstatus, o_orderpriority, count(*) as n, sum(o_totalprice::decimal(18,2))::double as total from orders group by 1, 2",
        "m2_greedy": f"{_PAIRS}, f as (select distinct feature from m) select feature from f where not exists (select 1 from c where feature_b = f.feature and abs(r) > 0.5)",
        "f6_drop_warmup": f"with s as ({USER}) select series_id, seq, round(nav, 6) as nav from s where seq >= 19",
        "f8_qualified": f"""with rep as ({_report(USER, "l.seq - lag(l.seq) over w", False, 0.5)}) select series_id, n_epochs, coalesce(((sharpe_ratio > -0.5 and sharpe_ratio < 5) or sharpe_ratio < 0) and n_epochs > 2 and n_epochs < 40 and aggregate_cv > 0 and aggregate_cv < 1.5, false) as qualifies from rep""",
        "u1_union": f"{_LONG}, a as (select lookback, feature, value from long union all select 0, 'nav', nav from s) select lookback, feature, count(*) as n_rows, count(value) as n_valid from a group by 1, 2",
        "x20_year_ranges": """with s as (select o_orderpriority, min(o_orderdate)::date as a, max(o_orderdate)::date as b from orders group by 1), y as (select *, unnest(range(year(a), year(b) + 1))::int as year from s)
select o_orderpriority, year, greatest(make_date(year, 1, 1), a) as start, least(make_date(year, 12, 31), b) as "end" from y""",
        "m22_walk_forward": f"""with m as ({MEASURES}), t as (select series_id, seq, value as y from m where feature = 'price'), x as (select m.*, y, greatest(floor(seq * 6 / count(*) over (partition by m.series_id, feature))::int, 1) as f0 from m join t using (series_id, seq) where feature <> 'price'),
g as (select feature, fold, corr(value, y) ** 2 as imp from x, range(1, 6) r(fold) where fold >= f0 group by 1, 2) select feature, round(avg(imp), 6) as mean_importance, round(stddev_pop(imp), 6) as std_importance, round(stddev_pop(imp) / avg(imp), 4) as cv from g group by 1""",
    }
    return out
