"""DuckDB SQL giving the same answer as each registered query, written independently of the operators."""

from __future__ import annotations

from barloom.operators import features as FT
from barloom.plans.views import spans

# Named subqueries; each may use the ones before it.
CTE: dict[str, str] = {}


def _bars(name: str, unit: str) -> None:
    day = f"cast(date_trunc('{unit}', l_shipdate) as date)"
    keys = "l_shipdate {0}, l_orderkey {0}, l_linenumber {0}, l_partkey {0}, l_extendedprice {0}, l_quantity {0}"
    part = f"partition by l_suppkey, {day} order by "
    CTE[name] = f"""
      select symbol, date, max(case when rn = 1 then price end) as open, max(price) as high, min(price) as low,
             max(case when rd = 1 then price end) as close, sum(q) as volume
      from (select l_suppkey as symbol, {day} as date, l_extendedprice / l_quantity as price, l_quantity as q,
                   row_number() over ({part}{keys.format('asc')}) as rn,
                   row_number() over ({part}{keys.format('desc')}) as rd from lineitem)
      group by symbol, date"""


for _name, _unit in (("bars_w", "week"), ("bars_m", "month"), ("bars_d", "day")):
    _bars(_name, _unit)

CTE["ev_d"] = """
  select user_id as symbol, cast(ts as date) as date, arg_min(value, struct_pack(ts, event_id)) as open,
         max(value) as high, min(value) as low, arg_max(value, struct_pack(ts, event_id)) as close, sum(value) as volume
  from events group by user_id, cast(ts as date)"""


def _aligned(name: str, src: str) -> None:
    CTE[name] = f"""
      select s.symbol, c.date, b.open, b.high, b.low, b.close, b.volume
      from (select distinct symbol from {src}) s
      cross join (select date from {src} where symbol =
                  (select symbol from {src} group by symbol order by count(*) desc, symbol limit 1)) c
      left join {src} b on b.symbol = s.symbol and b.date = c.date"""


_aligned("aligned_w", "bars_w")
_aligned("aligned_m", "bars_m")

FIELDS = ("open", "high", "low", "close", "volume")
WSYM = "partition by symbol order by date"
UPTO = f"{WSYM} rows between unbounded preceding and current row"
ON = f"{WSYM} rows between current row and unbounded following"


def ffill_limit(src: str, n: int) -> str:
    return f"select symbol, date, " + ", ".join(
        f"last_value({c} ignore nulls) over ({WSYM} rows between {n} preceding and current row) as {c}" for c in FIELDS
    ) + f" from {src}"


def sparse(src: str) -> str:
    bad = " or ".join(f"{c} is null" for c in FIELDS)
    return f"""select * from {src} where symbol in (select symbol from {src} group by symbol
               having avg(case when {bad} then 1 else 0 end) <= 0.05)"""


def ffill_bfill(src: str, cols=FIELDS, keep: str = "symbol, date") -> str:
    return f"select {keep}, " + ", ".join(
        f"coalesce(last_value({c} ignore nulls) over ({UPTO}), first_value({c} ignore nulls) over ({ON})) as {c}"
        for c in cols) + f" from {src}"


CTE["filled"] = ffill_limit("aligned_w", 5)
CTE["filled_1"] = ffill_limit("aligned_w", 1)
CTE["dense"] = sparse("filled")
CTE["panel"] = ffill_bfill("dense")
CTE["panel_m"] = ffill_bfill("aligned_m")
CTE["numbered_w"] = f"select *, row_number() over ({WSYM}) as rn from panel"
CTE["known"] = f"""
  select symbol, date, (lag(close, 1) over ({WSYM}) / lag(close, 6) over ({WSYM}) - 1) * 100 as score from panel"""
CTE["scores"] = """
  select date, symbol, (score - avg(score) over (partition by date)) /
         case when stddev_samp(score) over (partition by date) >= 1e-8
              then stddev_samp(score) over (partition by date) else 1.0 end as score
  from known where score is not null"""
CTE["labels"] = f"""
  select symbol, date, fwd_ret from (
    select symbol, date, coalesce(lead(close) over ({WSYM}) / close - 1, 0) as fwd_ret,
           date = max(date) over () as final from panel) where not final"""
CTE["judged"] = """
  select s.date, s.symbol, s.score / 100 as pred, l.fwd_ret as label, cast(s.score > 0 as integer) as pred_class,
         cast(l.fwd_ret > 0 as integer) as label_class from scores s join labels l using (date, symbol)"""
CTE["cells"] = """
  select date, symbol, '[ ' || cast(cast(-score as decimal(12,4)) as varchar) || ' ' ||
         cast(cast(score as decimal(12,4)) as varchar) || ']' as cell from scores"""
CTE["logits"] = """
  select date, symbol, cast(cast(-score as decimal(12,4)) as double) as down,
         cast(cast(score as decimal(12,4)) as double) as up from scores"""
CTE["index_close"] = "select date, avg(close) as close from panel group by date"
CTE["industries"] = """
  select s_suppkey as symbol, n_regionkey as industry from supplier join nation on s_nationkey = n_nationkey"""
CTE["fundamentals"] = f"""
  select *, sum(volume) over ({WSYM} rows between 11 preceding and current row) as shares,
         close * sum(volume) over ({WSYM} rows between 11 preceding and current row) as cap from panel"""
CTE["factors"] = f"""
  select f.date, f.symbol, f.factor, f.momentum, f.close, f.cap, ln(f.cap) as log_cap, i.industry from (
    select *, close / lag(close, 5) over ({WSYM}) - 1 as factor, close - lag(close, 10) over ({WSYM}) as momentum
    from fundamentals) f left join industries i using (symbol) where f.factor is not null"""
CTE["status_bars"] = """
  select b.symbol, b.date, b.close,
         case when s_nationkey in (0, 24) then '*ST' when s_nationkey = 23 then 'ST' else 'Norm' end as status,
         s_acctbal as book_value from bars_d b join supplier on s_suppkey = b.symbol"""
CTE["listings"] = """
  select symbol, min(date) as listing_date from bars_d join supplier on s_suppkey = symbol
  where s_nationkey < 20 group by symbol"""
CTE["listed"] = """
  select b.* from status_bars b left join listings l using (symbol)
  where case when l.listing_date is not null then b.date > l.listing_date else b.status in ('Norm', '*ST') end"""
CTE["weights"] = """
  select date, symbol, 0.1 as weight, score from (
    select *, row_number() over (partition by date order by score desc, symbol) as pick from scores) where pick <= 10"""
CTE["days"] = "select date, row_number() over (order by date) - 1 as pos from (select distinct date from scores)"
CTE["dense_weights"] = """
  select s.date, s.symbol, s.score, d.pos, case when w.weight is null then 0.0::double else 0.1::double end as weight
  from scores s join days d using (date) left join weights w on w.date = s.date and w.symbol = s.symbol"""
CTE["turnover"] = f"""
  select date, sum(abs(weight - before)) as turnover from (
    select date, symbol, weight, coalesce(lag(weight) over ({WSYM}), 0) as before from dense_weights) group by date"""
CTE["net"] = f"""
  select t.date, g.gross, t.turnover, g.gross - 0.001 * t.turnover as portfolio_return
  from turnover t join (
    select w.date, sum(w.weight * r.ret) as gross from dense_weights w join (
      select symbol, date, coalesce(close / lag(close) over ({WSYM}) - 1, 0) as ret from panel) r using (symbol, date)
    group by w.date) g using (date)"""
# The backtest sees prices on score dates only: its first return is 0.
CTE["daily"] = f"""
  select t.date, g.gross - 0.001 * t.turnover as portfolio_return, i.ret as benchmark_return
  from turnover t join (
    select w.date, sum(w.weight * r.ret) as gross from dense_weights w join (
      select symbol, date, coalesce(close / lag(close) over ({WSYM}) - 1, 0) as ret
      from panel where date in (select date from days)) r using (symbol, date) group by w.date) g using (date)
  join (select date, coalesce(close / lag(close) over (order by date) - 1, 0) as ret from index_close
        where date in (select date from days)) i using (date)"""
CTE["curve"] = """
  select *, exp(sum(ln(1 + portfolio_return)) over (order by date)) as pc,
         exp(sum(ln(1 + benchmark_return)) over (order by date)) as bc from daily"""
CTE["perf"] = """
  select power(exp(sum(ln(1 + portfolio_return))), 252.0 / count(*)) - 1 as annualized_return,
         avg(portfolio_return) / stddev_samp(portfolio_return) * sqrt(252) as sharpe_ratio,
         (select min(f) from (select pc / max(pc) over (order by date) - 1 as f from curve)) as max_drawdown,
         regr_intercept(portfolio_return, benchmark_return) * 252 as alpha_annualized,
         regr_slope(portfolio_return, benchmark_return) as beta,
         exp(sum(ln(1 + portfolio_return))) - 1 as total_return, count(*) as n_days from daily"""
CTE["months"] = """
  select date, eve from (select date, lag(date) over (order by date) as eve from (select distinct date from panel))
  where eve is not null and date_trunc('month', date) <> date_trunc('month', eve)"""


def period_backtest(prefix: str, weights: str, key: str, fee: float) -> None:
    """Dense day-by-day form: every symbol of the universe has a weight at each rebalance."""
    CTE[f"{prefix}_reb"] = f"""
      select {key}, date as r, lead(date) over (partition by {key} order by date) as nxt,
             row_number() over (partition by {key} order by date) as k from (select distinct {key}, date from {weights})"""
    CTE[f"{prefix}_move"] = f"""
      select b.{key}, b.k, b.r, p.date, w.symbol, w.weight, w.weight * p.close / q.close as grown,
             (b.nxt is not null and p.date = b.nxt) as last_day
      from {prefix}_reb b join {weights} w on w.{key} = b.{key} and w.date = b.r
      join panel q on q.symbol = w.symbol and q.date = b.r
      join panel p on p.symbol = w.symbol and p.date > b.r and (b.nxt is null or p.date <= b.nxt)"""
    CTE[f"{prefix}_ret"] = f"""
      select {key}, k, date, sum(grown - weight) as ret, bool_or(last_day) as last_day from {prefix}_move
      group by {key}, k, date"""
    CTE[f"{prefix}_cost"] = f"""
      select coalesce(a.{key}, d.{key}) as {key}, coalesce(a.k, d.k) as k,
             sum(abs(coalesce(a.weight, 0) - coalesce(d.grown, 0))) as turnover
      from (select b.{key}, b.k, w.symbol, w.weight from {prefix}_reb b join {weights} w
            on w.{key} = b.{key} and w.date = b.r) a
      full join (select {key}, k + 1 as k, symbol, grown from {prefix}_move where last_day) d
        on a.{key} = d.{key} and a.k = d.k and a.symbol = d.symbol
      group by 1, 2"""
    CTE[f"{prefix}_base"] = f"""
      select c.{key}, c.k, c.turnover, coalesce(exp(sum(ln((1 - {fee} * c.turnover) * (1 + coalesce(r.ret, 0)))) over (
               partition by c.{key} order by c.k rows between unbounded preceding and 1 preceding)), 1) as base
      from {prefix}_cost c left join {prefix}_ret r on r.{key} = c.{key} and r.k = c.k and r.last_day"""
    CTE[f"{prefix}_nav"] = f"""
      select r.{key}, r.date, b.base * (1 - {fee} * b.turnover) * (1 + r.ret) as nav, r.ret as period_return
      from {prefix}_ret r join {prefix}_base b on b.{key} = r.{key} and b.k = r.k
      union all select f.{key}, p.date, 1.0, 0.0 from (select {key}, min(r) as r from {prefix}_reb group by {key}) f
      join (select distinct date from panel) p on p.date <= f.r"""
    CTE[f"{prefix}_turn"] = f"""
      select b.{key}, b.r as date, c.turnover from {prefix}_reb b join {prefix}_cost c on c.{key} = b.{key} and c.k = b.k"""


CTE["layer_weights"] = """
  select date, symbol, cast(floor((rn - 1) / n) as integer) as layer, 1.0 / n as weight from (
    select m.date, s.symbol, row_number() over (partition by s.date order by s.score desc, s.symbol) as rn,
           floor(count(*) over (partition by s.date) / 5) as n from scores s join months m on m.eve = s.date)
  where rn <= 5 * n"""
period_backtest("lay", "layer_weights", "layer", 0.002)
CTE["model_weights"] = """
  select strategy, date, symbol, 0.1::double as weight from (
    select *, row_number() over (partition by strategy, date order by score desc, symbol) as pick from (
      select 'follow' as strategy, date, symbol, score from scores
      union all select 'reverse', date, symbol, -score from scores)) where pick <= 10"""
period_backtest("mod", "model_weights", "strategy", 0.0)
CTE["model_metrics"] = """
  select strategy, max(v_end) / max(v_start) - 1 as total_return,
         power(max(v_end) / max(v_start), 252.0 / count(*)) - 1 as annualized_return,
         avg(ret) / stddev_samp(ret) * sqrt(252) as sharpe_ratio, min(fall) as max_drawdown, count(*) as n_days from (
    select strategy, date, nav / lag(nav) over w - 1 as ret,
           nav / max(nav) over (partition by strategy order by date rows between unbounded preceding and current row) - 1 as fall,
           first_value(nav) over w as v_start, last_value(nav) over (partition by strategy order by date
             rows between unbounded preceding and unbounded following) as v_end
    from mod_nav window w as (partition by strategy order by date)) group by strategy"""
CTE["split"] = """
  select l.*, d.pos, d.n from labels l join (
    select date, row_number() over (order by date) - 1 as pos, count(*) over () as n
    from (select distinct date from labels)) d using (date)"""
CTE["tagged"] = """
  select *, case when pos < round_even(0.75 * n, 0) then 'train'
                 when pos < n - round_even(0.125 * n, 0) then 'val' else 'test' end as split from split"""
CTE["slots"] = """
  select split, symbol, date, fwd_ret, row_number() over (partition by split, symbol order by date) - 1 as i,
         count(*) over (partition by split, symbol) as n from tagged"""
CTE["samples"] = """
  select a.split, a.symbol, a.i as sample, b.i - a.i as i, b.fwd_ret as v from slots a join slots b
    on a.split = b.split and a.symbol = b.symbol and b.i between a.i and a.i + 21
  where a.i + 22 <= a.n"""
CTE["links"] = """
  select a.symbol as src, b.symbol as dst,
         case when stddev_pop(a.fwd_ret) < 1e-10 or stddev_pop(b.fwd_ret) < 1e-10 then null
              else corr(a.fwd_ret, b.fwd_ret) end as weight
  from labels a join labels b on a.date = b.date and a.symbol < b.symbol group by 1, 2"""
CTE["both_links"] = """
  select src, dst, abs(weight) as weight from links where abs(weight) > 0.1
  union all select dst, src, abs(weight) from links where abs(weight) > 0.1"""
CTE["horizon"] = f"""
  select pred, pred_class, step, label, cast(label > 0 as integer) as label_class from (
    select pred, pred_class, 0 as step, label from judged union all
    select pred, pred_class, 1, lead(label) over ({WSYM}) from judged) where label is not null"""


def ranks(src: str, x: str, by: str = "date") -> str:
    return f"""(rank() over (partition by {by} order by {x}) + (count(*) over (partition by {by}, {x}) - 1) / 2.0)"""


CTE["ranked"] = f"select *, {ranks('judged', 'pred')} as rp, {ranks('judged', 'label')} as rl from judged"


def safe_corr(x: str, y: str) -> str:
    return f"case when stddev_pop({x}) = 0 or stddev_pop({y}) = 0 or count(*) < 2 then null else corr({x}, {y}) end"


CTE["ic_days"] = f"""
  select date, {safe_corr('rp', 'rl')} as IC, {safe_corr('pred', 'label')} as IC_pearson from ranked group by date"""
CTE["f1"] = """
  select avg(case when p + t = 0 then 0 else 2.0 * h / (p + t) end) as F1_macro from (
    select c, sum(case when pred_class = c then 1 else 0 end) as p, sum(case when label_class = c then 1 else 0 end) as t,
           sum(case when pred_class = c and label_class = c then 1 else 0 end) as h
    from judged cross join (select pred_class as c from judged union select label_class from judged) group by c)"""

# Exponential means, one recursive pass over row numbers.
CTE["numbered"] = f"select *, row_number() over ({WSYM}) as rn from panel"


def _recursive() -> None:
    alphas = {f"EMA_{s}": 2.0 / (s + 1) for s in FT.EMA_SPANS} | {"fast": 2.0 / 13, "slow": 2.0 / 27}
    first = ", ".join(f"close as {n}" for n in alphas)
    nxt = ", ".join(f"(1 - {a!r}) * e.{n} + {a!r} * p.close" for n, a in alphas.items())
    fast, slow = (f"((1 - {alphas[n]!r}) * e.{n} + {alphas[n]!r} * p.close)" for n in ("fast", "slow"))
    CTE["ema"] = f"""
      select symbol, rn, date, close, {first}, 0.0::double as signal from numbered where rn = 1
      union all select p.symbol, p.rn, p.date, p.close, {nxt}, 0.8 * e.signal + 0.2 * ({fast} - {slow})
      from ema e join numbered p on p.symbol = e.symbol and p.rn = e.rn + 1"""
    CTE["moves"] = f"""
      select symbol, date, rn, greatest(d, 0) as gain, greatest(-d, 0) as loss from (
        select *, close - lag(close) over ({WSYM}) as d from numbered) where d is not null"""
    ws = FT.RSI_WINDOWS
    first = ", ".join(f"gain as g{w}, loss as l{w}" for w in ws)
    nxt = ", ".join(f"(1 - 1.0/{w}) * e.{s}{w} + 1.0/{w} * p.{c}" for w in ws for s, c in (("g", "gain"), ("l", "loss")))
    CTE["rs"] = f"""
      select symbol, rn, date, {first} from moves where rn = 2
      union all select p.symbol, p.rn, p.date, {nxt} from rs e join moves p on p.symbol = e.symbol and p.rn = e.rn + 1"""
    CTE["observed"] = f"""
      select symbol, date, close, row_number() over ({WSYM}) as ord, pos - lag(pos) over ({WSYM}) as gap from (
        select *, row_number() over ({WSYM}) as pos from aligned_w) where close is not null"""
    first = ", ".join(f"close as EMA_{s}" for s in FT.EMA_SPANS)
    nxt = ", ".join(f"(power(1 - {a!r}, p.gap) * e.EMA_{s} + {a!r} * p.close) / (power(1 - {a!r}, p.gap) + {a!r})"
                    for s in FT.EMA_SPANS for a in [2.0 / (s + 1)])
    CTE["ema_gaps"] = f"""
      select symbol, ord, date, {first} from observed where ord = 1
      union all select p.symbol, p.ord, p.date, {nxt} from ema_gaps e
      join observed p on p.symbol = e.symbol and p.ord = e.ord + 1"""


_recursive()
RECURSIVE = {"ema", "rs", "ema_gaps"}


def roll(agg: str, x: str, k: int) -> str:
    w = f"({WSYM} rows between {k - 1} preceding and current row)"
    return f"case when count({x}) over {w} = {k} then {agg}({x}) over {w} end"


def feature_sql() -> dict[str, str]:
    """Column expressions over ``panel`` (and ``f1``, which adds true range, typical price and STOCH_K)."""
    out: dict[str, str] = {}
    for w in FT.ROC_WINDOWS:
        out[f"ROC_{w}"] = f"(close / lag(close, {w}) over ({WSYM}) - 1) * 100"
    for w in FT.BB_WINDOWS:
        m, s = roll("avg", "close", w), roll("stddev_samp", "close", w)
        out |= {f"BB_upper_{w}": f"({m}) + 2 * ({s})", f"BB_lower_{w}": f"({m}) - 2 * ({s})", f"BB_width_{w}": f"4 * ({s})"}
    for w in FT.VOL_WINDOWS:
        out[f"VOL_ratio_{w}"] = f"volume / nullif({roll('avg', 'volume', w)}, 0)"
    for w in FT.ATR_WINDOWS:
        out[f"ATR_{w}"] = roll("avg", "tr", w)
    out["OBV"] = f"sum(coalesce(sign(close - before), 0) * volume) over ({UPTO})"
    for w in FT.STOCH_WINDOWS:
        out[f"STOCH_K_{w}"] = f"k{w}"
        out[f"STOCH_D_{w}"] = roll("avg", f"k{w}", 3)
    for w in FT.WILLR_WINDOWS:
        h, l = roll("max", "high", w), roll("min", "low", w)
        out[f"WILLR_{w}"] = f"-100 * (({h}) - close) / nullif(({h}) - ({l}), 0)"
    for w in FT.CCI_WINDOWS:
        out[f"CCI_{w}"] = f"""(tp - m{w}) / (0.015 * greatest(list_sum(list_transform(
            list(tp) over ({WSYM} rows between {w - 1} preceding and current row), lambda x: abs(x - m{w}))) / {w}, 1e-8))"""
    for w in FT.DC_WINDOWS:
        h, l = roll("max", "high", w), roll("min", "low", w)
        out |= {f"DC_upper_{w}": h, f"DC_lower_{w}": l, f"DC_width_{w}": f"({h}) - ({l})"}
    for w in FT.MOM_WINDOWS:
        out[f"MOM_{w}"] = f"close - lag(close, {w}) over ({WSYM})"
    for w in FT.SMA_WINDOWS:
        out[f"SMA_{w}"] = roll("avg", "close", w)
    for w in FT.DIST_WINDOWS:
        m = roll("avg", "close", w)
        out[f"DIST_SMA{w}"] = f"(close - ({m})) / nullif({m}, 0)"
    out["DAILY_RET"] = "close / before - 1"
    out["VOL_norm_252"] = f"volume / nullif({roll('avg', 'volume', 252)}, 0)"
    out["HL_SPREAD"] = "(high - low) / nullif(close, 0)"
    out["CO_RET"] = "(close - open) / nullif(open, 0)"
    for s in FT.EMA_SPANS:
        out[f"EMA_{s}"] = f"EMA_{s}"
    out |= {"MACD": "fast - slow", "MACD_signal": "signal", "MACD_hist": "fast - slow - signal"}
    for w in FT.RSI_WINDOWS:
        out[f"RSI_{w}"] = f"case when rn > {w} then 100 - 100 / (1 + g{w} / case when l{w} >= 1e-8 then l{w} else 1e-8 end) end"
    return out


CTE["f1"], CTE["f1_macro"] = "", CTE["f1"]
_k = ", ".join(f"100 * (close - ({roll('min', 'low', w)})) / nullif(({roll('max', 'high', w)}) - ({roll('min', 'low', w)}), 0) as k{w}"
               for w in FT.STOCH_WINDOWS)
_m = ", ".join(f"{roll('avg', 'tp', w)} as m{w}" for w in FT.CCI_WINDOWS)
CTE["f1"] = f"""
  select *, {_k}, {_m} from (
    select *, (high + low + close) / 3 as tp, before,
           case when before is null then high - low
                else greatest(high - low, abs(high - before), abs(low - before)) end as tr
    from (select *, lag(close) over ({WSYM}) as before from numbered))"""
CTE["f2"] = "select f.*, e.* exclude (symbol, date, rn, close), r.* exclude (symbol, date, rn) from f1 f "\
    "join ema e on e.symbol = f.symbol and e.date = f.date left join rs r on r.symbol = f.symbol and r.date = f.date"
CTE["features"] = "select symbol, date, " + ", ".join(f"{e} as {n}" for n, e in feature_sql().items()) + " from f2"


def with_ctes(sql: str) -> str:
    """Prefix a query with the named subqueries it needs."""
    import re

    need: list[str] = []

    def visit(text: str, self_name: str = "") -> None:
        for name in CTE:
            if name != self_name and name not in need and re.search(rf"\b(from|join)\s+{name}\b", text):
                visit(CTE[name], name)
                if name not in need:
                    need.append(name)

    visit(sql)
    word = "with recursive" if RECURSIVE & set(need) else "with"
    return (f"{word} " + ",\n".join(f"{n} as ({CTE[n]})" for n in need) + "\n" + sql) if need else sql


CHECKS: dict[str, str] = {}


def r(expr: str, name: str, digits: int = 6) -> str:
    """Rounded column, by the same rule as the queries; adding zero turns -0.0 into 0.0."""
    x = f"cast({expr} as double)"
    return (f"case when abs({x}) >= 1e6 then cast(printf('%.9e', {x}) as double) "
            f"else round({x} + 1e-9, {digits}) + 0.0 end as {name}")


def cols(names, digits: int = 6) -> str:
    return ", ".join(r(n, n, digits) for n in names)


def check(name: str, sql: str) -> None:
    CHECKS[name] = with_ctes(sql)


OHLCV = cols(FIELDS)
check("A1_read_bars", f"select symbol, date, {OHLCV} from bars_m")
check("A5_read_sectioned_ohlc", f"""
  select c.date, s.symbol, {', '.join(r('b.' + x, x) for x in FIELDS[:4])} from (select distinct date from bars_m) c
  cross join (select distinct symbol from bars_m) s left join bars_m b on b.date = c.date and b.symbol = s.symbol""")
check("A2_read_csv_folder", f"select symbol, date, {cols(['close', 'volume'])} from bars_w")
check("A2_read_csv_line_breaks", """select doc_id, lang, md5(nullif(text, '')) as text_md5, cast(length(nullif(text, '')) as bigint) as n_chars
  from documents""")
_wide = f"""select c.date, s.symbol, {{}} from (select distinct date from bars_m) c
  cross join (select distinct symbol from bars_m) s left join bars_m b on b.date = c.date and b.symbol = s.symbol"""
check("A3_read_wide_panel", _wide.format(r("coalesce(b.close, 0)", "close")))
check("A4_read_positional_matrix", _wide.format(r("b.close", "close")))
check("I4_attach_calendar", _wide.format(r("b.close", "close")))
check("A6_read_ticker_list", """select s_name as symbol, cast(row_number() over (order by s_suppkey) - 1 as integer) as pos
  from supplier""")
check("A7_split_table_json", """select cast(floor(n * 0.75) as integer) as train_end, cast(floor(n * 0.875) as integer) as val_end
  from (select count(distinct date) as n from panel)""")
check("A8_write_panel", f"select symbol, date, {OHLCV} from bars_w")
_positions = f"select date, symbol as ticker, {r('weight', 'weight')}, {r('score', 'predicted_score')} from weights"
check("A9_write_results", _positions)
check("B1_slice_dates", f"""
  select 'closed' as ends, symbol, date, {r('close', 'close')} from bars_w where date between '1996-01-01' and '1998-12-28'
  union all select 'half_open', symbol, date, {r('close', 'close')} from bars_w
  where date >= '1996-01-01' and date < '1998-12-28'""")
check("B2_rename_select", f"select symbol as code, date as day, {r('close', 'price')} from bars_w")
check("B3_format_symbol", """
  select p_partkey, z || case when z[1] in ('0', '3') then '.SZ' when z[1] in ('4', '8') then '.BJ' when z[1] = '6' then '.SH'
         else '' end as code
  from (select p_partkey, case when length(c) < 6 then lpad(c, 6, '0') else c end as z
        from (select p_partkey, cast(p_partkey * 4001 as varchar) as c from part))""")
check("B4_normalise_ticker", "select doc_id, md5(replace(text, '.', '-')) as ticker_md5 from documents")
check("B5_post_listing_filter", f"select symbol, date, {r('close', 'close')} from listed")
check("B6_stock_pool_filter", f"""
  select symbol, date, {cols(['close', 'book_value'])} from listed where symbol in (
    select symbol from listed group by symbol having count(*) >= 365
      and sum(case when status like '%ST%' then 1 else 0 end) = 0 and sum(case when book_value < 0 then 1 else 0 end) = 0)
  and symbol in (select symbol from industries where industry <> 0)""")
check("B7_drop_null_and_constant_columns", f"select symbol, date, {cols(['open', 'close'])} from bars_w")
check("B8_label_mask_fill", f"""
  select date, symbol, {r('case when label = 0 then -1e9 else pred end', 'pred')}, {r('label', 'label')},
         {r('case when label = 0 then 0 else 0.5 + pred end', 'prob')} from judged""")
check("B9_nan_to_zero", f"""select symbol, date, {r('coalesce(close, 0)', 'close')}, {r('coalesce(volume, 0)', 'volume')}
  from aligned_w""")
check("B10_inf_to_null", f"select symbol, date, {r('case when volume between 3 and 20 then close end', 'close')} from bars_w")
check("B11_panel_guards", """select count(distinct date) as n_dates, count(distinct symbol) as n_symbols, count(*) as n_rows,
  cast(0 as bigint) as n_missing from labels""")
_pct = "annualized_return", "total_return", "max_drawdown", "alpha_annualized"
check("B12_expand_pct", "select " + ", ".join(r(f"{c} * 100", c) for c in _pct)
      + f", {cols(['sharpe_ratio', 'beta'])}, cast(null as double) as top_k, n_days from perf")
check("C1_merge_bars_fundamentals", f"""select b.symbol, b.date, {r('b.close', 'close')}, {r('m.volume', 'month_volume')}
  from bars_w b left join bars_m m on m.symbol = b.symbol and m.date = b.date""")
check("C2_align_to_master_calendar", f"select symbol, date, {OHLCV} from aligned_w")
_ev = """from (select distinct symbol from ev_d) s cross join (select distinct date from ev_d) c"""
check("C3_align_outer", f"""select s.symbol, c.date, {', '.join(r('b.' + x, x) for x in FIELDS)} {_ev}
  left join ev_d b on b.symbol = s.symbol and b.date = c.date""")
check("C4_align_intersection", f"""select symbol, date, {r('close', 'close')} from bars_m where date in (
  select date from bars_m group by date having count(*) = (select count(distinct symbol) from bars_m))""")
check("C5_asof_prices", f"""
  select t.symbol, t.date, {r('coalesce(b.close, 0)', 'close')} from (select s.symbol, c.date {_ev}) t
  asof left join ev_d b on b.symbol = t.symbol and t.date >= b.date""")
check("C6_constituent_semi_join", f"""select symbol, date, {r('close', 'close')} from bars_w
  where symbol in (select symbol from industries where industry <> 0)""")
check("C7_attach_cap_and_industry", f"select symbol, date, {cols(['factor', 'log_cap'])}, industry from factors")
_spans = ", ".join(f"({s['span']}, '{k}', date '{s[k][0]}', date '{s[k][1]}')" for s in spans() for k in ("train", "val", "test"))
check("C8_walk_forward_subsets", f"""
  select symbol, date, {r('fwd_ret', 'fwd_ret')}, span, split from labels
  join (values {_spans}) v(span, split, low, high) on date between low and high""")
check("C9_returns_onto_universe", f"""
  select a.symbol, a.date, {r('coalesce(b.ret, 0)', 'ret')} from aligned_w a left join (
    select symbol, date, (close - lag(close) over ({WSYM})) / lag(close) over ({WSYM}) as ret from bars_w) b
  using (symbol, date)""")
_bench = "select date, ret, exp(sum(ln(1 + ret)) over (order by date)) as nav from (select date, coalesce(close / lag(close) "\
    "over (order by date) - 1, 0) as ret from index_close)"
check("C11_combine_nav", f"""
  select b.date, {r('b.nav', 'benchmark')}, {r('f.nav', 'follow')}, {r('v.nav', 'reverse')} from ({_bench}) b
  left join mod_nav f on f.date = b.date and f.strategy = 'follow'
  left join mod_nav v on v.date = b.date and v.strategy = 'reverse'""")
check("D1_ffill_limit", f"select symbol, date, {OHLCV} from ({ffill_limit('aligned_m', 1)})")
check("D2_drop_sparse_symbols", f"select symbol, date, {r('close', 'close')} from ({sparse('filled_1')})")
check("D3_ffill_bfill", f"select symbol, date, {OHLCV} from ({ffill_bfill('aligned_w')})")
check("D3_ffill", "select symbol, date, " + ", ".join(
    r(f"last_value({c} ignore nulls) over ({UPTO})", c) for c in FIELDS) + " from aligned_w")


def mad(src: str) -> str:
    parts = []
    for c in ("close", "volume"):
        parts.append(f"case when {c} is not null then greatest(least({c}, m_{c} + 3 * d_{c}), m_{c} - 3 * d_{c}) end as {c}")
    return f"""select symbol, date, {', '.join(parts)} from (
      select *, quantile_cont(abs(close - m_close), 0.5) over (partition by symbol) as d_close,
             quantile_cont(abs(volume - m_volume), 0.5) over (partition by symbol) as d_volume from (
        select *, quantile_cont(close, 0.5) over (partition by symbol) as m_close,
               quantile_cont(volume, 0.5) over (partition by symbol) as m_volume from {src}))"""


def zsym(src: str) -> str:
    return "select symbol, date, " + ", ".join(
        r(f"({c} - avg({c}) over (partition by symbol)) / case when stddev_pop({c}) over (partition by symbol) = 0 "
          f"then 1 else stddev_pop({c}) over (partition by symbol) end", c) for c in ("close", "volume")) + f" from {src}"


check("D4_mad_clip", f"select symbol, date, {cols(['close', 'volume'])} from ({mad('bars_w')})")
check("D5_zscore_symbol", zsym("bars_w"))


def capped(src: str, x: str) -> str:
    return f"""select * exclude ({x}), case when {x} > med + 3 * 1.4826 * dev then med + 3 * 1.4826 * dev else {x} end as {x}
      from (select *, avg(abs({x} - med)) over (partition by date) as dev from (
        select *, quantile_cont({x}, 0.5) over (partition by date) as med from {src}))"""


check("D6_cap_outliers_xs", f"select symbol, date, {r('volume', 'factor')} from ({capped('bars_w', 'volume')})")
check("D7_drop_warmup", f"""select symbol, date, {r('close', 'close')} from (
  select *, dense_rank() over (order by date) as pos from bars_w) where pos > 60""")
_clipped = f"select symbol, date, " + ", ".join(
    f"last_value({c} ignore nulls) over ({UPTO}) as {c}" for c in ("close", "volume")) + f" from ({mad('aligned_w')})"
check("D8_standard_process", zsym(f"({_clipped})"))
check("D9_mask_missing_price", f"""select symbol, date, {r('close', 'close')}, {r('volume', 'cap')},
  {r('case when close is not null and volume is not null then 1.0 end', 'factor')} from aligned_w""")

_F = feature_sql()


def _feature(name: str, prefix_or_list, digits: int, src: str = "features") -> None:
    names = prefix_or_list if isinstance(prefix_or_list, list) else [c for c in FT.FEATURES if c.startswith(prefix_or_list)]
    check(name, f"select symbol, date, {cols(names, digits)} from {src}")


for _n, _p, _d in (("E1_roc", "ROC_", 5), ("E2_rsi", "RSI_", 5), ("E3_ema", "EMA_", 4),
                   ("E4_macd", ["MACD", "MACD_signal", "MACD_hist"], 4), ("E5_bollinger", "BB_", 4),
                   ("E6_volume_ratio", "VOL_ratio_", 5), ("E7_atr", "ATR_", 4), ("E8_obv", "OBV", 3),
                   ("E9_stochastic", "STOCH_", 4), ("E10_williams", "WILLR_", 4), ("E11_cci", "CCI_", 4),
                   ("E12_donchian", "DC_", 4), ("E13_momentum", "MOM_", 4), ("E14_sma", "SMA_", 4),
                   ("E15_sma_distance", "DIST_", 6), ("E16_daily_return", "DAILY_RET", 6),
                   ("E17_volume_norm", "VOL_norm", 6), ("E18_high_low_spread", "HL_SPREAD", 6),
                   ("E19_close_open_return", "CO_RET", 6), ("E20_compute_features", list(FT.FEATURES), 4)):
    _feature(_n, _p, _d)
check("E3_ema_gaps", "select symbol, date, " + ", ".join(
    r(f"last_value(e.EMA_{s} ignore nulls) over ({UPTO})", f"EMA_{s}", 4) for s in FT.EMA_SPANS)
    + " from aligned_w a left join ema_gaps e using (symbol, date)")
CTE["feature_filled"] = ffill_bfill("features", FT.FEATURES)
check("E21_build_feature_matrix", f"""select symbol, date, {cols(FT.FEATURES, 4)} from feature_filled where date in (
  select date from (select date, row_number() over (order by date) as pos from (select distinct date from feature_filled))
  where pos > 60)""")
check("E22_feature_matrix_long", f"""select date, symbol, name as feature, {r('v', 'value', 4)} from (
  select date, symbol, unnest([{', '.join(f"'{n}'" for n in FT.FEATURES)}]) as name,
         unnest([{', '.join(f'cast({n} as double)' for n in FT.FEATURES)}]) as v from features)""")
check("E22_feature_matrix_wide", f"""
  select date, cast(floor(pos / 64) as integer) as block, cast(pos % 64 as integer) as at, {r('RSI_14', 'value', 4)} from features
  join (select symbol, row_number() over (order by symbol) - 1 as pos from (select distinct symbol from features)) using (symbol)""")
_lags = {"close": "close", "open": "close", "high": "close", "low": "close", "vwap": "close", "volume": "volume"}
check("A8_write_panel_by_feature", f"""select date, symbol, name as feature, {r('v', 'value', 4)} from (
  select date, symbol, unnest([{', '.join(f"'{n}'" for n in FT.FEATURES)}]) as name,
         unnest([{', '.join(f'cast({n} as double)' for n in FT.FEATURES)}]) as v from features)""")
check("E23_lag_ratio_factors", f"""
  select a.symbol, a.date, cast(g.lag as integer) as lag, {', '.join(r(f'b.{f} / nullif(a.{d}, 0)', f, 5) for f, d in _lags.items())}
  from (select *, (high + low + close) / 3 as vwap from numbered_w) a cross join (select unnest(range(60)) as lag) g
  left join (select *, (high + low + close) / 3 as vwap from numbered_w) b on b.symbol = a.symbol and b.rn = a.rn - g.lag""")

_D = "over (partition by date)"
check("F1_cs_zscore", f"select symbol, date, " + ", ".join(
    r(f"({c} - avg({c}) {_D}) / case when stddev_samp({c}) {_D} >= 1e-8 then stddev_samp({c}) {_D} else 1 end", c)
    for c in ("close", "volume")) + ", 0.0::double as flat from bars_w")
check("F2_cs_standardise", f"select symbol, date, " + ", ".join(
    r(f"({c} - avg({c}) {_D}) / nullif(stddev_samp({c}) {_D}, 0)", c) for c in ("close", "volume"))
    + ", cast(null as double) as flat from bars_w")
check("F3_log_float_cap", f"select symbol, date, {r('ln(close * shares)', 'log_cap')} from fundamentals")


def neutral(f: str) -> str:
    return f"""select date, symbol, (res - avg(res) {_D}) / nullif(stddev_samp(res) {_D}, 0) as {f} from (
      select date, symbol, y - x * coalesce(sum(x * y) {_D} / nullif(sum(x * x) {_D}, 0), 0) as res from (
        select date, symbol, {f} - avg({f}) over (partition by date, industry) as y,
               log_cap - avg(log_cap) over (partition by date, industry) as x from factors where {f} is not null))"""


check("F4_neutralise_cap_industry", f"""
  select f.date, f.symbol, {r('a.factor', 'factor', 5)}, {r('b.momentum', 'momentum', 5)} from factors f
  left join ({neutral('factor')}) a using (date, symbol) left join ({neutral('momentum')}) b using (date, symbol)""")
check("F4_neutralised_on_codes", f"""
  select d.date, c.symbol, {r('a.factor', 'factor', 5)}, {r('b.momentum', 'momentum', 5)} from (select distinct date from factors) d
  cross join (select s_suppkey as symbol from supplier where s_suppkey % 3 > 0) c
  left join ({neutral('factor')}) a on a.date = d.date and a.symbol = c.symbol
  left join ({neutral('momentum')}) b on b.date = d.date and b.symbol = c.symbol""")
_slope = f"sum(factor * log_cap) {_D} / nullif(sum(log_cap * log_cap) {_D}, 0)"
check("F5_neutralise_cap", f"select date, symbol, {r(f'factor - log_cap * ({_slope})', 'factor')} from factors")
_eves = "(select * from factors where date in (select eve from months))"
check("F6_factor_preprocess", f"""
  select date, symbol, {r(f'(res - avg(res) {_D}) / nullif(stddev_samp(res) {_D}, 0)', 'factor', 5)} from (
    select date, symbol, factor - log_cap * ({_slope}) as res from ({capped(_eves, 'factor')}))""")
check("F7_average_rank", f"select symbol, date, {r('volume', 'volume')}, {r(ranks('bars_w', 'volume'), 'volume_rank')} from bars_w")
check("F8_factor_layers", f"""
  select date, symbol, cast(floor((rn - 1) / n) as integer) as layer, {r('1.0 / n', 'weight')} from (
    select date, symbol, row_number() over (partition by date order by volume desc, symbol) as rn,
           floor(count(*) over (partition by date) / 5) as n from bars_w) where rn <= 5 * n""")
check("F9_top_k", f"""select symbol, date, {r('volume', 'score')}, cast(pick as integer) as pick from (
  select *, row_number() over (partition by date order by volume desc, symbol) as pick from bars_w) where pick <= 7""")

check("G1_forward_return", f"""
  select symbol, date, {r('coalesce(ahead / close - 1, 0)', 'fwd_ret')} from (
    select s.symbol, c.date, b.close, lead(b.close) over (partition by s.symbol order by c.date) as ahead,
           c.date = max(c.date) over () as final
    from (select distinct symbol from bars_w) s cross join (select distinct date from bars_w) c
    left join bars_w b on b.symbol = s.symbol and b.date = c.date) where not final""")
check("G2_trend_indicator", "select symbol, date, cast(fwd_ret > 0 as integer) as trend from labels")
check("G3_model_targets", f"""select symbol, date, {r('cast(fwd_ret as float)', 'target', 4)},
  cast(fwd_ret > 0 as integer) as trend from labels""")
check("G4_simple_return", f"""select symbol, date, {r(f'(close - lag(close) over ({WSYM})) / lag(close) over ({WSYM})', 'ret')}
  from bars_w""")
check("G5_split_by_position", """select symbol, date, case when pos < floor(n * 0.75) then 'train'
  when pos < floor(n * 0.875) then 'val' else 'test' end as split from split""")
check("G6_split_by_round", "select symbol, date, split from tagged")
check("G7_sliding_windows", f"""select split, symbol, cast(sample as integer) as sample, case when i < 20 then 'x' else 'y' end as part,
  cast(case when i < 20 then i else i - 20 end as integer) as i, {r('v', 'v')} from samples""")
check("G8_temporal_codes", """
  select date, cast(pos as integer) as pos, cast(m as integer) as month_code, cast(pos % 21 as integer) as day_code,
         cast(m % 5 as bigint) as month_slot, cast(pos % 21 % 50 as bigint) as day_slot from (
    select date, pos, ((42 + pos) % 252) // 21 as m from (
      select date, row_number() over (order by date) - 1 as pos from (select distinct date from bars_w)))""")
_taps = "(0, -0.1294095226), (1, 0.2241438680), (2, 0.8365163037), (3, 0.4829629131)"
_bank = f"""(select 'low' as part, j, w from (values {_taps}) t(j, w) union all
    select 'high', 3 - j, case when j % 2 = 0 then w else -w end from (values {_taps}) t(j, w))"""
_coef = f"(select part, k, 2 * k + 1 - j as i, w from {_bank} cross join (select unnest(range(11)) as k))"
_sides = " union all ".join(f"""
  select s.split, s.symbol, s.sample, '{side}' as part, m.i, sum(s.v * m.low) as low, sum(s.v * m.high) as high
  from (select split, symbol, sample, i - {start} as i, v from samples where i >= {start} and i < {start + n}) s join (
    select a.i, b.i as j, sum(case when a.part = 'low' then a.w * b.w else 0 end) as low,
           sum(case when a.part = 'high' then a.w * b.w else 0 end) as high from {_coef} a join {_coef} b
    on a.part = b.part and a.k = b.k and a.k < {(n + 3) // 2} and a.i between 0 and {n - 1} and b.i between 0 and {n - 1} group by 1, 2) m
  on m.j = s.i group by 1, 2, 3, 4, 5""" for side, start, n in (("x", 0, 20), ("y", 20, 2)))
check("G9_wavelet_split", f"""
  select split, symbol, cast(sample as integer) as sample, part, cast(i as integer) as i, {r('low', 'low')}, {r('high', 'high')} from ({_sides})""")
check("G10_stack_features", f"""
  select symbol, date, 'f' as part, i, {r('v', 'v', 4)} from (
    select f.symbol, f.date, unnest(range({len(FT.FEATURES) + 2})::integer[]) as i,
           unnest([{', '.join(f'coalesce(cast(f.{n} as double), 0)' for n in sorted(FT.FEATURES))}, coalesce(l.fwd_ret, 0),
                   case when l.fwd_ret > 0 then 1.0 else 0.0 end]) as v
    from features f join labels l using (symbol, date))""")

# Model samples: a row and the 22 places of every window it stands in.
CTE["placed"] = """
  select split, symbol, date, fwd_ret, i, n, unnest(range(greatest(0, i - n + 22)::int, least(i, 21)::int + 1)) as place from slots"""
CTE["coded"] = """
  select date, ((42 + pos) % 252) // 21 as month_code, pos % 21 as day_code from (
    select date, row_number() over (order by date) - 1 as pos from (select distinct date from labels))"""
CTE["stacked"] = f"""
  select f.symbol, f.date, unnest(range({len(FT.FEATURES) + 2})::integer[]) as feature,
         unnest([{', '.join(f'coalesce(cast(f.{n} as double), 0)' for n in sorted(FT.FEATURES))}, coalesce(l.fwd_ret, 0),
                 case when l.fwd_ret > 0 then 1.0 else 0.0 end]) as v
  from features f join labels l using (symbol, date)"""
_AS_OF = "max(p.date) filter (where place = 19) as as_of"
CTE["vector_sums"] = "select symbol, date, sum(v * (feature + 1)) as v from stacked group by symbol, date"
check("G7_model_windows", f"""
  select p.split, p.symbol, cast(p.i - place as integer) as sample, {_AS_OF},
         {r('sum(case when place < 20 then v * (place + 1) else 0 end)', 'x', 3)}, {r('sum(case when place >= 20 then v * (place - 19) else 0 end)', 'y', 3)}
  from placed p join vector_sums s on s.symbol = p.symbol and s.date = p.date group by p.split, p.symbol, p.i - place""")
_code_sums = ", ".join(r(f"sum(case when {side} then {x} * {weight} else 0 end)", f"{name}_{c}") for name, side, weight in (
    ("x", "place < 20", "(place + 1)"), ("y", "place >= 20", "(place - 19)"))
    for c, x in (("trend", "cast(fwd_ret > 0 as integer)"), ("month_code", "month_code"), ("day_code", "day_code")))
check("G7_indicator_code_windows", f"""
  select split, symbol, cast(i - place as integer) as sample, {_code_sums} from placed join coded using (date) group by split, symbol, i - place""")
_totals = ", ".join(r(f"sum(case when part = '{side}' then {part} * (s.i + 1) else 0 end)", f"{side}_{part}") for side in ("x", "y") for part in ("low", "high"))
check("G9_model_split", f"""
  select s.split, s.symbol, cast(s.sample as integer) as sample, t.date as as_of, {_totals} from ({_sides}) s
  join slots t on t.split = s.split and t.symbol = s.symbol and t.i = s.sample + 19 group by s.split, s.symbol, s.sample, t.date""")
CTE["tagged_labels"] = """
  select *, case when pos < floor(0.75 * n) then 'train' when pos < floor(0.875 * n) then 'val' else 'test' end as split from split"""
_z = ", ".join(f"(f.{n} - avg(f.{n}) over w) / case when stddev_samp(f.{n}) over w >= 1e-8 then stddev_samp(f.{n}) over w else 1 end as {n}" for n in FT.FEATURES)
CTE["scaled_features"] = f"select f.symbol, f.date, {_z} from feature_filled f window w as (partition by f.date)"
_cells71 = ", ".join([*(f"coalesce(cast(f.{n} as double), 0)" for n in sorted(FT.FEATURES)), "l.fwd_ret", "case when l.fwd_ret > 0 then 1.0 else 0.0 end"])
check("G10_model_table", f"""
  select f.symbol, f.date, l.split, {r('l.fwd_ret', 'fwd_ret', 4)}, cast(l.fwd_ret > 0 as integer) as trend,
         {r(f'list_sum(list_transform([{_cells71}], lambda x, i: x * i))', 'features', 4)}
  from scaled_features f join tagged_labels l using (symbol, date)
  where f.date in (select date from (select date, row_number() over (order by date) as pos from (select distinct date from feature_filled)) where pos > 60)""")

check("H1_correlation_matrix", f"select src, dst, {r('weight', 'weight')} from links")
check("H2_correlation_edges", f"select src, dst, {r('weight', 'weight')} from links where abs(weight) > 0.1")
check("H3_correlation_edges_all", f"select src, dst, {r('weight', 'weight')} from links where weight is not null")
check("H4_normalised_laplacian", f"""
  select src, dst, {r('value', 'value')} from (
    select e.src, e.dst, -e.weight / sqrt(a.d * b.d) as value from both_links e
    join (select src, sum(weight) as d from both_links group by src) a on a.src = e.src
    join (select src, sum(weight) as d from both_links group by src) b on b.src = e.dst
    union all select distinct symbol, symbol, 1.0 from labels)""")

_ranks4 = "(select unnest(range(4))::integer as rank)"
check("H5_spectral_residual", f"select symbol, rank, 0.0::double as residual from (select distinct symbol from labels) cross join {_ranks4}")
check("H5_spectral_gram", f"""select a.rank as i, b.rank as j, case when a.rank = b.rank then 1.0::double else 0.0::double end as product, true as ordered
  from {_ranks4} a join {_ranks4} b on a.rank <= b.rank""")
check("H6_structural_twins", """
  select symbol, 128 as dims, symbol in (select src from both_links) as linked, symbol in (select src from both_links) as twin_near
  from (select distinct symbol from labels)""")
check("I1_parse_logits", f"""
  select date, symbol, pattern, 2 as n, {r('down', 'first')}, {r('up', 'second')} from logits
  cross join (values ('evaluate'), ('results')) v(pattern)""")
check("I2_argmax_class", "select date, symbol, case when up > down then 1 else 0 end as pred_class from logits")
check("I3_softmax_prob", f"select date, symbol, {r('1 / (1 + exp(down - up))', 'prob')} from logits")
check("J1_ic_spearman_by_day", f"select date, {r('IC', 'IC')} from ic_days")
check("J2_ic_pearson_by_day", f"select date, {r('IC_pearson', 'IC_pearson')} from ic_days")
check("J3_ic_summary", f"""select {r('avg(IC_pearson)', 'IC_mean')}, {r('avg(IC_pearson) / stddev_samp(IC_pearson)', 'ICIR')},
  count(IC_pearson) as n_days, count(*) - count(IC_pearson) as n_undefined from ic_days""")
_err = f"{r('avg(abs(pred - label))', 'MAE')}, {r('sqrt(avg(power(pred - label, 2)))', 'RMSE')}"
_acc = r("avg(cast(pred_class = label_class as integer))", "Accuracy")
check("J4_mae_rmse", f"select {_err} from judged")
check("J5_accuracy", f"select {_acc} from judged")
check("J6_f1_macro", f"select {r('F1_macro', 'F1_macro')} from f1_macro")
_steps = f"""select step, avg(cast(pred_class = label_class as integer)) as acc,
  coalesce(avg(abs(pred - label)) filter (label <> 0), 0) as mae,
  coalesce(sqrt(avg(power(pred - label, 2)) filter (label <> 0)), 0) as rmse,
  coalesce(avg(abs(pred - label) / nullif(label, 0)) filter (label <> 0), 0) as mape from horizon group by step"""
check("J7_masked_step_metrics", f"select step, {cols(['acc', 'mae', 'rmse', 'mape'])} from ({_steps})")
check("J7_mean_step_metrics", "select " + ", ".join(r(f"avg({c})", c) for c in ("acc", "mae", "rmse", "mape")) + f" from ({_steps})")
check("J8_cross_entropy", f"""select {r('avg(ln(exp(up) + exp(down)) - case when label_class = 1 then up else down end)', 'cross_entropy')}
  from logits join judged using (date, symbol)""")
check("J9_evaluation_summary", f"""
  select * from (select {r('avg(IC)', 'IC_mean')}, {r('avg(IC) / stddev_samp(IC)', 'ICIR')}, {r('avg(IC_pearson)', 'IC_pearson')} from ic_days),
    (select {_err}, {_acc} from judged), (select {r('F1_macro', 'F1_macro')} from f1_macro)""")
check("J9_ic_by_day", f"select date, {cols(['IC', 'IC_pearson'])} from ic_days")

check("K1_equal_weights", f"select date, symbol, {r('weight', 'weight')} from dense_weights")
check("K2_price_returns", f"""select symbol, date, {r('coalesce(case when before <> 0 then (close - before) / before else 0 end, 0)', 'ret')}
  from (select symbol, date, coalesce(close, 0) as close, lag(coalesce(close, 0)) over ({WSYM}) as before from aligned_w)""")
check("K3_turnover", f"select date, {r('turnover', 'turnover')} from turnover")
check("K4_daily_net_return", f"select date, {cols(['gross', 'turnover', 'portfolio_return'])} from net")
check("K5_positions", _positions)
check("K6_backtest_daily", f"select date, {cols(['portfolio_return', 'benchmark_return'])} from daily")
_perf = ["annualized_return", "sharpe_ratio", "max_drawdown", "alpha_annualized", "beta", "total_return"]
check("K7_performance_metrics", f"select {cols(_perf)}, n_days from perf")
check("entry_top_k_performance", f"select {cols(_perf)}, n_days from perf")
check("K8_alpha_beta", f"select {cols(['beta', 'alpha_annualized'])} from perf")
check("K9_equity_curve", f"select date, {r('pc', 'portfolio_return_curve')}, {r('bc', 'benchmark_return_curve')} from curve")
check("K9_equity_curve_shifted", f"""select date, {r('coalesce(lag(pc) over (order by date), 1)', 'portfolio_return_curve')},
  {r('coalesce(lag(bc) over (order by date), 1)', 'benchmark_return_curve')} from curve""")
check("K10_rebalance_calendar", "select date, eve from months")
check("K11_period_backtest", f"select layer, date, {cols(['nav', 'period_return'])} from lay_nav")
check("K11_period_turnover", f"select layer, date, {r('turnover', 'turnover')} from lay_turn")
check("K12_topk_drift_backtest", f"""select n.strategy, n.date, {cols(['nav', 'turnover', 'period_return'])} from mod_nav n
  left join mod_turn t on t.strategy = n.strategy and t.date = n.date""")
_mm = ["total_return", "annualized_return", "sharpe_ratio", "max_drawdown"]
check("K13_nav_metrics", f"select strategy, {cols(_mm)}, n_days from model_metrics")
check("K14_best_model_by_sharpe", f"""select strategy, {cols(_mm)}, n_days from model_metrics
  order by sharpe_ratio desc, strategy desc limit 1""")
check("K15_benchmark_nav", f"select date, {cols(['ret', 'nav'])} from ({_bench})")
check("K15_equal_weight_benchmark", f"""select date, {r('coalesce(avg(ret), 0)', 'benchmark_return')} from (
  select date, close / lag(close) over ({WSYM}) - 1 as ret from panel) group by date""")
check("K16_scoring_calendar", """select date from (select date, row_number() over (order by date) - 1 as pos
  from (select distinct date from labels)) where pos >= 200 order by date desc limit 30""")
check("K17_layer_backtest_panel", "select n.date, " + ", ".join(
    r(f"max(case when n.layer = {i} then n.nav end)", f"nav_{i + 1}") for i in range(5)) + ", " + ", ".join(
    r(f"max(case when t.layer = {i} then t.turnover end)", f"turnover_{i + 1}") for i in range(5))
    + " from lay_nav n left join lay_turn t on t.layer = n.layer and t.date = n.date group by n.date")
check("L1_latest_holdings", f"""select symbol as ticker, {r('weight * 100', 'weight')}, {r('score', 'predicted_score')} from weights
  where date = (select max(date) from weights)""")
_held = """select symbol, row_number() over (order by date, neg, symbol) as seat from (
  select *, row_number() over (partition by symbol order by date, -score) as appearance, -score as neg from weights) where appearance = 1"""
check("L2_held_tickers", f"select symbol as ticker, cast(seat as integer) as seat from ({_held})")
check("L3_heatmap_scores", f"""
  select symbol as ticker, date, {r('score', 'score')}, {r('max(abs(score)) over ()', 'scale')} from scores
  where symbol in (select symbol from ({_held}) where seat <= 10)""")
check("L4_kpi_row", f"""select {r('annualized_return * 100', 'annualized_return')}, {r('sharpe_ratio', 'sharpe_ratio')},
  {r('max_drawdown * 100', 'max_drawdown')}, {r('alpha_annualized * 100', 'alpha_annualized')} from perf""")
_win = "(order by date rows between unbounded preceding and 1 preceding)"
check("L5_equity_window", "select date, " + ", ".join(
    r(f"coalesce(exp(sum(ln(1 + {c})) over {_win}), 1)", f"{c}_curve") for c in ("portfolio_return", "benchmark_return"))
    + " from daily where date between '1997-01-01' and '1999-12-31'")
check("M1_score_windows", f"""
  select t.symbol, t.date as as_of, 1 as step, s.pred > 0 as up, {r('s.pred', 'pred')} from (
    select split, symbol, sample, avg(v) as pred from samples where i < 20 group by 1, 2, 3) s
  join slots t on t.split = s.split and t.symbol = s.symbol and t.i = s.sample + 19""")
CTE["panel_split"] = """
  select p.symbol, p.date, case when pos < floor(n * 0.75) then 'train' when pos < floor(n * 0.875) then 'val' else 'test' end as split
  from panel p join (select date, row_number() over (order by date) - 1 as pos, count(*) over () as n
                     from (select distinct date from panel)) using (date)"""
check("M2_boosted_tree_expression", """select p.symbol, p.date, true as same from panel_split p join labels l using (symbol, date)
  where split = 'test'""")
check("M2_boosted_tree_error", """select count(*) as n, true as better from panel_split p join labels l using (symbol, date)
  where split = 'test'""")
check("M3_pivot_scores", f"select symbol, cast(date as varchar) as day, {r('score', 'score')} from scores")
check("M4_pivot_prices", _wide.replace("bars_m", "bars_w").format(r("b.close", "close")).replace(
    "s.symbol,", "cast(s.symbol as varchar) as symbol,"))
