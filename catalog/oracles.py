"""For every query with an SQL form: the same result as one DuckDB statement,
written from the definitions and not from the Spark code."""

from __future__ import annotations

from catalog.fixture import CATEGORICAL, FEATURES, KEY, NUMERIC, SCORED_LINES_SQL, WIDE
from catalog.queries import DRAWN, GRID_BINS, MIXED_BINS, MIXED_SHARE, PREBINS

K = ", ".join(KEY)
QUANTILE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "c_acctbal"]


def on_lines(body: str, *ctes: str) -> str:
    """A statement over scored_lines and lab, its rows with a label."""
    parts = [f"scored_lines as ({SCORED_LINES_SQL})", "lab as (select * from scored_lines where flag is not null)", *ctes]
    return f"with recursive {', '.join(parts)} {body}"


def stacked(columns: list[str], source: str, cast: str, also: str = "") -> str:
    """Columns of a table as rows (feature, x)."""
    return " union all ".join(f"select '{c}' as feature, cast({c} as {cast}) as x{also} from {source}" for c in columns)


def rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) as {n}" for n in names)


# Pearson correlation by hand: null unless both sides vary.
CORR = """case when stddev_pop(x) > 1e-9 and stddev_pop(y) > 1e-9 then covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) end"""


def correlations() -> str:
    long = stacked(NUMERIC, "lab", "double", ", cast(flag as double) as y")
    return f"corrs as (select feature, count(x) as n, {CORR} as corr from ({long}) where x is not null group by feature)"


RANKED = """ranked as (select feature, abs(corr) as abs_corr, row_number() over (order by round(abs(corr), 12) desc, feature) as rank,
count(*) over () as defined from corrs where corr is not null)"""


def pairs() -> str:
    rows = " union all ".join(
        f"select '{a}' as feature_a, '{b}' as feature_b, {i} as ia, {j} as ib, cast({a} as double) as x, cast({b} as double) as y from lab"
        for i, a in enumerate(NUMERIC) for j, b in enumerate(NUMERIC) if i < j
    )
    return (
        f"pair_corr as (select feature_a, feature_b, ia, ib, count(*) as n, {CORR} as corr from ({rows}) "
        "where x is not null and y is not null group by all)"
    )


def f_values() -> str:
    long = stacked(NUMERIC, "lab", "double", ", flag as y")
    return f"""class_stats as (select feature, y, count(x) as n, avg(x) as mean, var_pop(x) as var from ({long}) where x is not null group by all),
grand as (select feature, sum(n) as n, sum(n * mean) / sum(n) as mean, count(*) as k from class_stats group by feature),
f_values as (select g.feature, any_value(g.n) as n,
  case when sum(c.n * c.var) > 1e-9 then (sum(c.n * (c.mean - g.mean) ** 2) / (any_value(g.k) - 1)) / (sum(c.n * c.var) / (any_value(g.n) - any_value(g.k))) end as f
  from class_stats c join grand g using (feature) group by g.feature)"""


def edges(columns: list[str], bins: int, source: str = "lab") -> str:
    """Distinct values at ranks ceil(i n / bins) below the maximum."""
    return f"""num_long as ({stacked(columns, source, "double", ", flag as y")}),
num_ranked as (select feature, x, row_number() over (partition by feature order by x) as rn, count(*) over (partition by feature) as n,
  max(x) over (partition by feature) as top from num_long where x is not null),
edges as (select distinct feature, x as edge from num_ranked, (select unnest(range(1, {bins})) as i)
  where rn = (i * n + {bins} - 1) // {bins} and x < top),
edge_lists as (select f.feature, coalesce(list(e.edge order by e.edge) filter (e.edge is not null), []) as es
  from (select distinct feature from num_long) f left join edges e using (feature) group by f.feature)"""


def numeric_bins(columns: list[str], bins: int, source: str = "lab") -> str:
    return edges(columns, bins, source) + """,
num_counts as (select feature, case when x is not null then len([e for e in es if e < x]) end as bin, cast(null as varchar) as category,
  count(*) as n, cast(sum(y) as bigint) as events from num_long join edge_lists using (feature) group by all)"""


def category_bins(columns: list[str], source: str = "lab") -> str:
    return f"""cat_counts as (select feature, cast(null as bigint) as bin, x as category, count(*) as n, cast(sum(y) as bigint) as events
  from ({stacked(columns, source, "varchar", ", flag as y")}) group by all)"""


def measured(counts: str, source: str = "lab") -> str:
    """woe and iv, half a row added to both counts of a one-class bin."""
    return f"""class_totals as (select cast(sum(flag) as double) as e_all, cast(count(*) - sum(flag) as double) as g_all from {source}),
padded as (select c.*, n - events as non_events, case when events = 0 or events = n then 0.5 else 0 end as pad from ({counts}) c),
shares as (select *, (non_events + pad) / g_all as good, (events + pad) / e_all as bad from padded, class_totals),
bins as (select feature, bin, category, bin is null and category is null as is_missing, n, events, non_events,
  cast(events as double) / n as event_rate, ln(good / bad) as woe, (good - bad) * ln(good / bad) as iv from shares)"""


def all_bins() -> list[str]:
    return [
        numeric_bins(NUMERIC, 20), category_bins(CATEGORICAL),
        measured("select * from num_counts union all select * from cat_counts"),
    ]


def woe_lookup(features: list[str], missing: str) -> tuple[str, list[str]]:
    """Joins and select list that give each row of scored_lines its WoE."""
    joins, columns = [], []
    for i, c in enumerate(features):
        if c not in CATEGORICAL:
            joins.append(
                f"left join edge_lists l{i} on l{i}.feature = '{c}' left join bins b{i} on b{i}.feature = '{c}' "
                f"and b{i}.bin is not distinct from (case when s.{c} is not null then len([e for e in l{i}.es if e < s.{c}]) end)"
            )
        else:
            joins.append(f"left join bins b{i} on b{i}.feature = '{c}' and b{i}.category is not distinct from s.{c}")
        value = f"coalesce(b{i}.woe, 0.0)" if missing == "woe" else f"case when s.{c} is null then 0.0 else coalesce(b{i}.woe, 0.0) end"
        columns.append(value)
    return " ".join(joins), columns


def rank_table(rows: str) -> str:
    """AUC and KS from running counts over distinct scores; rows = (feature, x, y)."""
    return f"""score_counts as (select feature, x, sum(y) as p, count(*) - sum(y) as q from ({rows}) where x is not null group by all),
running as (select *, sum(p) over w as cp, sum(q) over w as cq, sum(p) over (partition by feature) as np, sum(q) over (partition by feature) as nq
  from score_counts window w as (partition by feature order by x)),
rank_values as (select feature, cast(any_value(np + nq) as bigint) as n, cast(any_value(np) as bigint) as events,
  sum(cast(p as double) * (cast(cq as double) - q / 2.0)) / (cast(any_value(np) as double) * cast(any_value(nq) as double)) as auc,
  max(abs(cast(cq as double) / nq - cast(cp as double) / np)) as ks from running group by feature)"""


def unit(salt: object) -> str:
    key = ", ".join(f"cast({c} as varchar)" for c in KEY)
    return f"cast('0x' || substr(md5(concat_ws('|', '{salt}', {key})), 1, 8) as bigint)"


RULE = "(select flag, l_quantity / 50.0 as p, case when l_quantity > 40 then 1 else 0 end as prediction from lab)"
COUNTS = f"""counts as (select count(*) filter (prediction = 1 and flag = 1) as tp, count(*) filter (prediction = 1 and flag = 0) as fp,
count(*) filter (prediction = 0 and flag = 0) as tn, count(*) filter (prediction = 0 and flag = 1) as fn from {RULE})"""


def monotone(columns: list[str], bins: int) -> str:
    return on_lines(f"""select feature, bin, n, events, {rounded("woe", "iv")} from final_bins""", *monotone_bins(columns, bins))


def monotone_bins(columns: list[str], bins: int) -> list[str]:
    """Every division of the pre-bins into runs (one bit per border), the best
    rising or falling one per feature."""
    return [
        numeric_bins(columns, bins),
        f"""spans as (select *, count(*) over (partition by feature) as k from num_counts where bin is not null),
masks as (select feature, m from (select distinct feature, k from spans), (select unnest(range(0, {2 ** (bins - 1)})) as m) where m < 1 << (k - 1)),
runs as (select s.feature, m, bit_count(m & ((1 << bin) - 1)) as run, sum(n) as n, sum(events) as events, min(bin) as lo
  from masks join spans s using (feature) group by all)""",
        """class_totals as (select cast(sum(flag) as double) as e_all, cast(count(*) - sum(flag) as double) as g_all from lab),
run_shares as (select *, case when events = 0 or events = n then 0.5 else 0 end as pad,
  (n - events + pad) / g_all as good, (events + pad) / e_all as bad, cast(events as double) / n as rate from runs, class_totals),
run_steps as (select *, (good - bad) * ln(good / bad) as iv, rate - lag(rate) over (partition by feature, m order by run) as step from run_shares),
divisions as (select feature, m, sum(iv) as iv, coalesce(min(step) >= 0, true) as rising, coalesce(max(step) <= 0, true) as falling
  from run_steps group by all),
best as (select feature, arg_max(m, iv) as m from divisions where rising or falling group by feature)""",
        """missing_bins as (select feature, cast(null as bigint) as bin, n, events from num_counts where bin is null),
final_counts as (select feature, cast(run as bigint) as bin, cast(n as bigint) as n, cast(events as bigint) as events
  from runs join best using (feature, m) union all select * from missing_bins),
final_bins as (select *, case when events = 0 or events = n then 0.5 else 0 end as pad, (n - events + pad) / g_all as good,
  (events + pad) / e_all as bad, ln(good / bad) as woe, (good - bad) * ln(good / bad) as iv from final_counts, class_totals)""",
    ]


def binned_folds(train: str, scored: str, bins: list[int]) -> list[str]:
    """AUC of the WoE of x, by number of bins: bins from the rows (i, x, y) of
    `train` give the WoE of the rows (x, y, fold = i) of `scored`."""
    values = ", ".join(f"({b})" for b in sorted(set(bins)))
    return [
        f"""tr as ({train}),
rk as (select i, x, row_number() over (partition by i order by x) as rn, count(*) over (partition by i) as n, max(x) over (partition by i) as top from tr),
ed as (select distinct i, b, x as edge from rk, (values {values}) bs(b), (select unnest(range(1, {max(bins)})) as k) where k < b and rn = (k * n + b - 1) // b and x < top),
el as (select i, b, list(edge order by edge) as es from ed group by i, b),
fold_counts as (select t.i, b, len([e for e in es if e < x]) as bin, count(*) as n, sum(y) as e from tr t join el using (i) group by all),
fold_sums as (select i, cast(sum(y) as double) as ea, cast(count(*) - sum(y) as double) as ga from tr group by i),
fold_woe as (select i, b, bin, case when e = 0 or e = n then 0.5 else 0 end as pad, ln(((n - e + pad) / ga) / ((e + pad) / ea)) as woe
  from fold_counts join fold_sums using (i)),
candidates as (select cast(w.b as varchar) as feature, w.woe as x, s.y as y from (select * from {scored}) s join el on el.i = s.fold
  join fold_woe w on w.i = el.i and w.b = el.b and w.bin = len([e for e in el.es if e < s.x]))""",
        rank_table("select feature, x, y from candidates"),
    ]


def passive_aggressive(cost: float, epochs: int) -> str:
    """PA-II on the standardised quantity, the groups of complete copies run through
    one by one; m updates on one row are a geometric series."""
    return on_lines(
        f"""select {K}, round(1 / (1 + exp(-d)), 6) as score, cast(1 / (1 + exp(-d)) >= 0.5 as int) as prediction
from (select l.*, a1 + (l_quantity - mean) / spread * a0 as d from lab l, moments, (select t0 / rows as a0, t1 / rows as a1 from run, moments
  where k = {epochs} * (select count(*) from deal)))""",
        """moments as (select avg(l_quantity) as mean, stddev_pop(l_quantity) as spread, cast(count(*) as double) as rows, cast(sum(flag) as double) as events from lab),
deal as (select row_number() over (order by h, x, y) as k, x, y, m from (
  select cast('0x' || substr(md5('0|' || cast(l_quantity as varchar)), 1, 8) as bigint) as h, (l_quantity - any_value(mean)) / any_value(spread) as x,
    case when flag = 1 then 1.0 else -1.0 end as y, cast(count(*) as double) as m from lab, moments group by l_quantity, flag))""",
        f"""run as (select cast(0 as bigint) as k, 0.0::double as w0, 0.0::double as w1, 0.0::double as t0, 0.0::double as t1 union all
  select k, w0 + y * step * series * x, w1 + y * step * series,
    t0 + m * w0 + y * step * (m - q * series) / (1 - q) * x, t1 + m * w1 + y * step * (m - q * series) / (1 - q)
  from (select *, (1 - power(q, m)) / (1 - q) as series, greatest(0.0, 1 - y * (w0 * x + w1)) / (x * x + 1 + slack) as step
    from (select *, slack / (x * x + 1 + slack) as q
      from (select r.k + 1 as k, d.x, d.y, d.m,
          case when fresh then r.t0 / rows else r.w0 end as w0, case when fresh then r.t1 / rows else r.w1 end as w1,
          case when fresh then 0.0 else r.t0 end as t0, case when fresh then 0.0 else r.t1 end as t1,
          1 / (2 * {cost}::double * case when d.y > 0 then rows / (2 * events) else rows / (2 * (rows - events)) end) as slack
        from (select *, k > 0 and k % (select count(*) from deal) = 0 as fresh from run where k < {epochs} * (select count(*) from deal)) r
        join deal d on d.k = r.k % (select count(*) from deal) + 1, moments))))""",
    )


def scorecard() -> str:
    """Two numeric features by correlation and all categories, binned on the
    training part, three of them by mRMR; in a fitted regression without penalty
    the means of score x WoE and label x WoE are equal."""
    chosen = ["l_quantity", "l_discount"]
    looked = " union all ".join(
        [f"select n.rid, n.y, n.feature, coalesce(b.woe, 0.0) as w from placed n left join final_bins b on b.feature = n.feature and b.bin = n.run"]
        + [f"select rid, flag as y, '{c}' as feature, coalesce(b.woe, 0.0) as w from numbered s left join cat_bins b on b.feature = '{c}' and b.category = s.{c}" for c in CATEGORICAL]
    )
    numbered = " union all ".join(f"select rid, flag as y, '{c}' as feature, {c} as x from numbered" for c in chosen)
    body = """select rank, feature, bins, round(iv, 6) as iv, round(moment, 3) as moment from (
  select 1 as rank, feature from first_pick union all select 2, feature from second_pick union all select 3, feature from third_pick)
  join measures using (feature) join (select feature, avg(y * w) as moment from woe_rows group by feature) using (feature)"""
    ctes = [
        *monotone_bins(chosen, 10), category_bins(CATEGORICAL).replace("cat_counts as", "raw_cats as"),
        measured("select * from raw_cats").replace("class_totals as", "totals_again as").replace(", class_totals)", ", totals_again)").replace("bins as (", "cat_bins as ("),
        "measures as (select feature, count(*) as bins, sum(iv) as iv from (select feature, iv from final_bins union all select feature, iv from cat_bins) group by feature)",
        "numbered as (select row_number() over () as rid, * from lab)",
        f"""placed as (select n.rid, n.y, n.feature, bit_count(b.m & ((1 << len([e for e in es if e < n.x])) - 1)) as run
  from ({numbered}) n join edge_lists using (feature) join best b using (feature))""",
        f"woe_rows as ({looked})",
        """woe_stats as (select feature, y, count(*) as n, avg(w) as mean, var_pop(w) as var from woe_rows group by all),
woe_grand as (select feature, sum(n) as n, sum(n * mean) / sum(n) as mean, count(*) as k from woe_stats group by feature),
f_values as (select g.feature, (sum(c.n * (c.mean - g.mean) ** 2) / (any_value(g.k) - 1)) / (sum(c.n * c.var) / (any_value(g.n) - any_value(g.k))) as f
  from woe_stats c join woe_grand g using (feature) group by g.feature),
both_ways as (select a.feature as a, b.feature as b, abs(corr(a.w, b.w)) as c from woe_rows a join woe_rows b using (rid) where a.feature <> b.feature group by all)""",
        "first_pick as (select feature, f as score from f_values order by f desc, feature limit 1)",
        "second_pick as (select v.feature, v.f / greatest(c, 0.001) as score from f_values v, first_pick p, both_ways w "
        "where w.a = v.feature and w.b = p.feature order by 2 desc, 1 limit 1)",
        "third_pick as (select v.feature, v.f / greatest((w1.c + w2.c) / 2, 0.001) as score from f_values v, first_pick p, second_pick s, both_ways w1, both_ways w2 "
        "where w1.a = v.feature and w1.b = p.feature and w2.a = v.feature and w2.b = s.feature order by 2 desc, 1 limit 1)",
    ]
    return on_lines(body, *ctes).replace(
        "lab as (select * from scored_lines where flag is not null)",
        f"lab as (select * from scored_lines where flag is not null and {unit(34)} < 0.8 * 4294967296.0)",
    )


def kept(order: str) -> str:
    """Walk the features in an order, keep one unless |corr| > 0.8 with a kept one."""
    return f"""ordered as ({order}),
walk as (select cast(0 as bigint) as i, cast([] as varchar[]) as kept union all
  select w.i + 1, case when exists (select 1 from pair_corr p where abs(p.corr) > 0.8 and
    ((p.feature_a = o.feature and list_contains(w.kept, p.feature_b)) or (p.feature_b = o.feature and list_contains(w.kept, p.feature_a))))
    then w.kept else list_append(w.kept, o.feature) end
  from walk w join ordered o on o.i = w.i + 1),
result as (select arg_max(kept, i) as kept from walk)"""


def oracles() -> dict[str, str]:
    sql: dict[str, str] = {}
    all_pairs = pairs()

    sql["parquet_scan"] = "select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1"
    sql["parquet_sink"] = "select o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) as o_totalprice from orders"
    sql["chunked_export"] = (
        "select count(*) as n_rows, cast(sum(l_orderkey) as bigint) as keys, round(sum(l_quantity), 2) as quantity, "
        "true as within_limit, true as enough_files from lineitem"
    )
    sql["run_report"] = on_lines(
        "select 'labels' as run_id, 'metric' as kind, 'events' as name, cast(cast(sum(flag) as double) as varchar) as value from lab union all "
        "select 'labels', 'metric', 'non_events', cast(cast(count(*) - sum(flag) as double) as varchar) from lab union all "
        "select 'labels', 'param', 'target', 'flag' union all select 'labels', 'param', 'folds', '3' union all "
        "select 'labels', 'log.info', 'catalog:report_rows:7', cast(count(*) as varchar) || ' rows' from lab union all "
    ) + " union all ".join(
        f"select '{t}' as run_id, 'metric' as kind, 'n_rows' as name, cast(count(*) as varchar) as value from {t} union all "
        f"select '{t}', 'metric', 'n_columns', '{n}'" for t, n in (("orders", 6), ("lineitem", 11))
    )
    kinds = "case max(typeof({c})) when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'DOUBLE' then 'double' when 'VARCHAR' then 'string' end"
    sql["column_types"] = on_lines(" union all ".join(
        f"select '{c}' as name, {kinds.format(c=c)} as data_type, true as nullable, "
        + (f"max(length({c}))" if c in CATEGORICAL else "max(cast(null as bigint))") + " as max_len from scored_lines"
        for c in [*KEY, "l_quantity", "l_extendedprice", "l_discount", "l_tax", *CATEGORICAL, "c_acctbal", "price2", "const_f", "yr", "hs", "hf", "flag"]
    ))
    sql["not_null_check"] = on_lines("select * from (" + " union all ".join(
        f"select '{c}' as name, count(*) filter ({c} is null) as nulls from scored_lines" for c in ("l_orderkey", "l_tax", "c_acctbal", "flag")
    ) + ") where nulls > 0")
    sql["unique_key_check"] = "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1"
    sql["class_distribution"] = on_lines("select yr, flag, count(*) as n from scored_lines group by 1, 2")
    sql["row_shape"] = on_lines(
        f"select case when {unit(34)} < 0.9 * 4294967296.0 then 'train' else 'test' end as split, count(*) as n_rows, 7 as n_columns from lab group by 1"
    )
    sql["constant_filter"] = on_lines("select feature from (" + stacked(NUMERIC, "scored_lines", "double") + ") group by 1 "
                                      "having count(distinct x) + max(case when x is null then 1 else 0 end) <= 1")
    sql["feature_columns"] = on_lines(f"select {rounded(*NUMERIC)}, {', '.join(CATEGORICAL)} from scored_lines")
    sql["drop_null_target"] = on_lines(f"select {K}, flag from scored_lines where flag is not null")
    sql["select_label"] = on_lines("select l_quantity, l_linestatus, flag from scored_lines")
    sql["strata_key"] = on_lines("select yr, flag, count(*) as n from scored_lines group by yr, flag")
    sql["strata_distinct"] = on_lines("select distinct yr, flag from scored_lines")
    sql["label_correlation"] = on_lines("select feature, n, round(corr, 6) as corr, round(abs(corr), 6) as abs_corr from corrs", correlations())
    sql["pairwise_correlation"] = on_lines("select feature_a, feature_b, n, round(corr, 6) as corr from pair_corr", all_pairs)
    sql["f_statistic"] = on_lines("select feature, cast(n as bigint) as n, round(f, 6) as f from f_values", f_values())
    sql["low_corr_filter"] = on_lines("select cast(rank as int) as rank, feature, round(abs_corr, 6) as abs_corr from ranked where rank <= defined // 3",
                                      correlations(), RANKED)
    tail = " union all ".join(
        f"select cast({i} + (select count(*) from top) as int) as rank, '{c}' as feature, 'categorical' as kind, cast(null as double) as abs_corr"
        for i, c in enumerate(CATEGORICAL, 1)
    )
    sql["top_corr_select"] = on_lines(
        f"select cast(rank as int) as rank, feature, 'numeric' as kind, round(abs_corr, 6) as abs_corr from top union all {tail}",
        correlations(), RANKED, "top as (select * from ranked where rank <= greatest(1, cast(floor(defined * 0.5) as bigint)))",
    )
    both = "(select feature_a as a, feature_b as b, abs(corr) as c from pair_corr union all select feature_b, feature_a, abs(corr) from pair_corr)"
    sql["mrmr_select"] = on_lines(
        "select 1 as rank, feature, round(score, 3) as score from first_pick union all select 2, feature, round(score, 3) from second_pick "
        "union all select 3, feature, round(score, 3) from third_pick",
        f_values(), all_pairs, f"both_ways as {both}",
        "first_pick as (select feature, f as score from f_values where f is not null order by f desc, feature limit 1)",
        "second_pick as (select v.feature, v.f / greatest(coalesce(c, 0), 0.001) as score from f_values v, first_pick p, both_ways w "
        "where f is not null and w.a = v.feature and w.b = p.feature order by 2 desc, 1 limit 1)",
        "third_pick as (select v.feature, v.f / greatest((coalesce(w1.c, 0) + coalesce(w2.c, 0)) / 2, 0.001) as score "
        "from f_values v, first_pick p, second_pick s, both_ways w1, both_ways w2 where f is not null and w1.a = v.feature "
        "and w1.b = p.feature and w2.a = v.feature and w2.b = s.feature order by 2 desc, 1 limit 1)",
    )
    listed = " union all ".join(f"select {i} as i, '{c}' as feature" for i, c in enumerate(NUMERIC, 1))
    sql["drop_correlated"] = on_lines("select o.feature, list_contains(r.kept, o.feature) as kept from ordered o, result r", all_pairs, kept(listed))
    spread = ("select row_number() over (order by v desc, feature) as i, feature from (select feature, var_pop(x) as v from ("
              + stacked(NUMERIC, "lab", "double") + ") group by feature)")
    sql["smart_correlated"] = on_lines("select o.feature, list_contains(r.kept, o.feature) as kept from ordered o, result r", all_pairs, kept(spread))
    sql["single_feature_gini"] = on_lines(
        "select feature, n, round(auc, 6) as auc, round(2 * auc - 1, 6) as gini, round(ks, 6) as ks from rank_values",
        rank_table(stacked(NUMERIC, "lab", "double", ", flag as y")),
    )

    sql["split_hash"] = on_lines(f"select {K}, case when hs < 0.9 * 4294967296.0 then 'train' else 'test' end as split from scored_lines")
    sql["split_exact"] = on_lines(
        f"select {K}, case when rn <= round(0.9 * n) then 'train' else 'test' end as split from (select {K}, "
        f"row_number() over (partition by yr, flag order by hs, {K}) as rn, count(*) over (partition by yr, flag) as n from lab)"
    )
    columns = "l_returnflag, l_linestatus, l_quantity, l_discount"
    sql["split_except_all"] = (f"select {columns} from lineitem except all select {columns} from lineitem where l_shipdate < timestamp '1996-01-01'")
    sql["train_val_split"] = on_lines(f"select {K}, {unit(34)} >= 0.95 * 4294967296.0 as is_val from scored_lines")
    sql["kfold_assign"] = on_lines(f"select {K}, flag, cast(ntile(3) over (partition by flag order by hf, {K}) - 1 as int) as fold from lab")
    sql["fold_hash"] = on_lines(f"select {K}, cast(hf % 3 as int) as fold from lab")

    sql["label_index"] = on_lines(
        "select o_orderpriority, cast(row_number() over (order by n desc, o_orderpriority) - 1 as double) as index, "
        "cast(case when o_orderpriority = '1-URGENT' then 1 else 0 end as double) as label, n "
        "from (select o_orderpriority, count(*) as n from scored_lines group by 1)"
    )
    sql["woe_prebin"] = on_lines(
        "select feature, cast(row_number() over (partition by feature order by edge) - 1 as int) as edge_no, round(edge, 6) as edge from edges",
        edges(QUANTILE_FEATURES, 20),
    )
    sql["woe_bins"] = on_lines(
        f"select feature, cast(bin as int) as bin, category, is_missing, n, events, non_events, {rounded('event_rate', 'woe', 'iv')} from bins", *all_bins()
    )
    sql["iv_table"] = on_lines("select feature, count(*) as bins, round(sum(iv), 6) as iv from bins group by feature", *all_bins())
    sql["woe_monotone"] = monotone(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 10).replace(
        "select feature, bin, n, events, round", "select feature, cast(bin as int) as bin, n, events, round"
    )
    joins, values = woe_lookup(FEATURES, "woe")
    sql["woe_transform"] = on_lines(
        f"select {K}, " + ", ".join(f"round({v}, 6) as {c}_WOE" for v, c in zip(values, FEATURES)) + f" from scored_lines s {joins}", *all_bins()
    )
    joins, values = woe_lookup(["l_tax", "l_linestatus"], "zero")
    sql["woe_replace"] = on_lines(
        f"select {K}, round({values[0]}, 6) as l_tax, round({values[1]}, 6) as l_linestatus from scored_lines s {joins}", *all_bins()
    )

    sql["auc_gini"] = on_lines("select n, events, round(auc, 6) as auc, round(2 * auc - 1, 6) as gini from rank_values",
                               rank_table("select 'x' as feature, l_extendedprice as x, flag as y from lab"))
    sql["ks_statistic"] = on_lines("select n, round(ks, 6) as ks from rank_values",
                                   rank_table("select 'x' as feature, l_quantity as x, flag as y from lab"))
    sql["gini_hard"] = on_lines("select round(cast(tp as double) / (tp + fn) - cast(fp as double) / (fp + tn), 6) as gini from counts", COUNTS)
    sql["calibration_curve"] = on_lines(
        f"select cast(least(floor(p * 5), 4) as int) as bin, count(*) as n, round(avg(p), 6) as mean_prob, round(avg(flag), 6) as event_rate from {RULE} group by 1"
    )
    sql["confusion_metrics"] = on_lines(
        "select tp, fp, tn, fn, round(cast(tp + tn as double) / (tp + fp + tn + fn), 6) as accuracy, round(cast(tp as double) / (tp + fp), 6) as precision, "
        "round(cast(tp as double) / (tp + fn), 6) as recall, round(2.0 * tp / (2.0 * tp + fp + fn), 6) as f1, "
        "round((cast(tp as double) / (tp + fn) + cast(tn as double) / (tn + fp)) / 2, 6) as roc_auc from counts", COUNTS,
    )

    sql["assemble"] = on_lines(f"select {K}, round(l_quantity, 6) as f0, round(l_discount, 6) as f1, round(l_extendedprice, 6) as f2 from lab")
    linear = (f"select {K}, round(1 / (1 + exp(-d)), 6) as score, case when 1 / (1 + exp(-d)) >= 0.5 then 1 else 0 end as prediction "
              f"from (select *, -5.0::double + l_quantity * 0.08::double + l_discount * 10.0::double as d from lab)")
    sql["pa_proba"] = on_lines(linear)
    sql["logistic_fit"] = on_lines(" union all ".join(
        f"select '{n}' as term, round(avg(flag * cast({v} as double)), 2) as moment from lab"
        for n, v in [("intercept", "1"), *[(c, c) for c in ("l_quantity", "l_discount", "l_extendedprice")]]
    ))
    rates = on_lines(f"select {K}, round(avg(flag) over (partition by l_linestatus), 4) as score from lab")
    sql["logistic_score"] = rates
    sql["model_save_load"] = rates
    sql["score_frame"] = on_lines(
        f"select {K}, round(p, 4) as score, cast(p >= 0.5 as int) as prediction, 0.8::double as calibrated, 0.7::double as probability "
        f"from (select {K}, avg(flag) over (partition by l_linestatus) as p from lab)"
    )
    points = ", ".join(f"({i}, {b})" for i, b in enumerate(GRID_BINS))
    sql["param_grid_search"] = on_lines(
        "select cast(v.i as int) as point, 'bins=' || v.b as params, round(2 * auc - 1, 6) as score, "
        f"row_number() over (order by auc desc, v.i) = 1 as best from rank_values r join (values {points}) v(i, b) on r.feature = cast(v.b as varchar)",
        f"part as (select {K}, l_quantity as x, flag as y, 0 as fold, {unit(34)} >= 0.8 * 4294967296.0 as is_dev from lab)",
        *binned_folds("select 0 as i, x, y from part where not is_dev", "part where is_dev", GRID_BINS),
    )
    sql["random_search"] = on_lines(
        "select cast(r.feature as int) as bins, round(2 * auc - 1, 6) as gini, row_number() over (order by auc desc) = 1 as best from rank_values r",
        f"folded as (select l_quantity as x, flag as y, cast({unit(42)} % 3 as int) as fold from lab)",
        *binned_folds("select f.i, x, y from folded, (select unnest(range(0, 3)) as i) f where fold <> f.i", "folded", [int(b) for b in DRAWN]),
    )
    sql["pa_fit"] = passive_aggressive(15.0, 2)
    sql["final_scorecard"] = scorecard()
    joins, values = woe_lookup(list(WIDE), "zero")
    wide = ", ".join(f"round({formula}, 6) as {name}" for name, formula in WIDE.items())
    sql["woe_many_features"] = on_lines(
        f"select {K}, " + ", ".join(f"round({v}, 6) as {c}_WOE" for v, c in zip(values, WIDE)) + f" from wide s {joins}",
        f"wide as (select *, {wide} from scored_lines)", "lab_wide as (select * from wide where flag is not null)",
        numeric_bins(list(WIDE), 5, "lab_wide"), measured("select * from num_counts", "lab_wide"),
    )
    sql["woe_large_domain"] = on_lines(
        f"select {K}, round(coalesce(b.woe, 0.0), 6) as order_name_WOE from lab s left join bins b on b.category = cast(s.l_orderkey as varchar)",
        "train as (select *, cast(l_orderkey as varchar) as order_name from lab where l_linenumber <= 3)",
        "cat_counts as (select 'order_name' as feature, cast(null as bigint) as bin, order_name as category, count(*) as n, "
        "cast(sum(flag) as bigint) as events from train group by all)", measured("select * from cat_counts", "train"),
    )
    # Every way to cut the categories, in the order of their event rates, into three runs of which two may be empty.
    assert MIXED_BINS == 3
    sql["woe_category_groups"] = on_lines(
        """select c.category, cast(f.bin as int) as bin, c.n, c.events, round(f.woe, 6) as woe, round(f.iv * c.n / f.n, 6) as iv
from cats c join ranks r on r.name = c.name join chosen f on r.k > f.low and r.k <= f.high""",
        f"""cats as (select *, case when n >= {MIXED_SHARE} * (select count(*) from lab) then category else '' end as name
  from (select concat_ws('/', o_orderpriority, c_mktsegment) as category, count(*) as n, cast(sum(flag) as bigint) as events from lab group by 1)),
entries as (select name, cast(sum(n) as bigint) as n, cast(sum(events) as bigint) as events from cats group by name),
ranks as (select *, row_number() over (order by events * 1.0::double / n, name) as k, count(*) over () as size from entries),
edges3 as (select a, b, size from (select unnest(range(0, 100)) as a), (select unnest(range(0, 100)) as b), (select max(size) as size from ranks) where a <= b and b <= size),
runs3 as (select a, b, 0 as run, 0 as low, a as high from edges3 union all select a, b, 1, a, b from edges3 union all select a, b, 2, b, size from edges3),
class_totals as (select cast(sum(flag) as double) as e_all, cast(count(*) - sum(flag) as double) as g_all from lab),
sums3 as (select a, b, run, low, high, sum(n) as n, sum(events) as events from runs3 join ranks on k > low and k <= high group by all),
padded3 as (select *, case when events = 0 or events = n then 0.5 else 0 end as pad from sums3),
shares3 as (select *, (n - events + pad) / g_all as good, (events + pad) / e_all as bad from padded3, class_totals),
value3 as (select a, b, sum((good - bad) * ln(good / bad)) as iv, count(*) as bins from shares3 group by a, b),
best3 as (select a, b from value3 order by round(iv, 12) desc, bins, a, b limit 1),
chosen as (select low, high, n, ln(good / bad) as woe, (good - bad) * ln(good / bad) as iv, row_number() over (order by low) - 1 as bin
  from shares3 join best3 using (a, b))""",
    )
    sql["woe_incremental"] = on_lines(
        f"select feature, cast(bin as int) as bin, category, n, events, {rounded('woe', 'iv')} from bins",
        numeric_bins(["l_quantity", "l_discount", "l_tax"], PREBINS), category_bins(["o_orderpriority"]),
        measured("select * from num_counts union all select * from cat_counts"),
    )
    terms = [("l_linestatus", "a"), ("o_orderpriority", "b")]
    folds = ["folded as (select *, cast(hf % 3 as int) as fold from lab)",
             "fold_totals as (select f.i, sum(flag) as e_all, count(*) - sum(flag) as g_all from folded, (select unnest(range(0, 3)) as i) f where fold <> f.i group by f.i)"]
    for c, short in terms:
        folds.append(
            f"woe_{short} as (select i, {c}, ln((cast(g as double) / g_all) / (cast(e as double) / e_all)) as woe from (select f.i, {c}, sum(flag) as e, "
            f"count(*) - sum(flag) as g from folded, (select unnest(range(0, 3)) as i) f where fold <> f.i group by 1, 2) join fold_totals using (i))"
        )
    sql["oof_predict"] = on_lines(
        f"select {K}, fold, round(a.woe + b.woe, 6) as score from folded s join woe_a a on a.i = s.fold and a.l_linestatus = s.l_linestatus "
        "join woe_b b on b.i = s.fold and b.o_orderpriority = s.o_orderpriority", *folds,
    )
    # Isotonic regression by its max-min formula over runs of distinct scores.
    sql["isotonic_calibrate"] = on_lines(
        "select l_quantity, any_value(n) as n, round(max(low), 6) as calibrated from (select s.l_quantity, s.n, a.l_quantity as start, "
        "min(cast(z.ce - a.ce + a.e as double) / (z.cn - a.cn + a.n)) as low from sums s join sums a on a.l_quantity <= s.l_quantity "
        "join sums z on z.l_quantity >= s.l_quantity group by all) group by l_quantity",
        "sums as (select l_quantity, n, e, sum(n) over (order by l_quantity) as cn, sum(e) over (order by l_quantity) as ce "
        "from (select l_quantity, count(*) as n, sum(flag) as e from lab group by 1))",
    )
    return sql
