"""DuckDB SQL for every value-checked query in ``catalog.QUERIES``.

Written as an independent formulation of the reference's rules: the
cancellation join is the literal many-to-many join, the reordered flag an
EXISTS over earlier orders, first/second buys an n-th purchase window,
splits and permutations full row_number rankings. Tables are the
pre-registered views (lineitem, orders, part, customer, nation, events).
"""

from __future__ import annotations

from basketlab import constants as K
from basketlab.functions.columns import mix_hash_sql
from basketlab.operators.distribution import DENSITY_CUT, DENSITY_POINTS
from basketlab.plans import catalog as Q, eda
from basketlab.plans.pipeline import TEST_TABLE_CODES


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


_codes = ", ".join("'" + c.replace("'", "''") + "'" for c in TEST_TABLE_CODES)

CTES: list[tuple[str, str]] = [
    ("raw", """
SELECT l_orderkey AS order_id, p_name AS stock, concat(p_type, ' ', p_name) AS description,
       CAST(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN -l_quantity ELSE l_quantity END AS BIGINT) AS quantity,
       o_orderdate AS order_date, CAST(p_retailprice AS DECIMAL(12,2)) AS unit_price,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_custkey END AS user_id,
       n_name AS country,
       CAST(row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS line_no
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""),
    ("x_lines", "SELECT * FROM raw WHERE user_id IS NOT NULL"),
    ("x_canc", "SELECT user_id, stock, quantity AS qc FROM x_lines WHERE quantity < 0"),
    ("x_netted", """
SELECT l.*, l.quantity + coalesce(c.qc, 0) AS nq
FROM x_lines l LEFT JOIN x_canc c ON l.user_id = c.user_id AND l.stock = c.stock"""),
    ("x_kept", f"SELECT * FROM x_netted WHERE nq > 0 AND stock NOT IN ({_codes})"),
    ("x_codes", """
SELECT stock, CAST(row_number() OVER (ORDER BY stock) - 1 AS BIGINT) AS product_id
FROM (SELECT DISTINCT stock FROM x_kept)"""),
    ("x_coded", "SELECT k.*, c.product_id FROM x_kept k JOIN x_codes c USING (stock)"),
    ("x_active", """
SELECT user_id, count(DISTINCT order_id) AS n_invoices FROM x_coded GROUP BY user_id
HAVING count(DISTINCT order_id) > 3"""),
    ("x_act", "SELECT * FROM x_coded WHERE user_id IN (SELECT user_id FROM x_active)"),
    ("x_first", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY order_id, product_id ORDER BY line_no) AS rn FROM x_act)
WHERE rn = 1"""),
    ("x_qty", "SELECT order_id, product_id, CAST(sum(nq) AS BIGINT) AS quantity FROM x_act GROUP BY order_id, product_id"),
    ("x_clean", """
SELECT f.order_id, f.product_id, f.stock AS product_id_original, f.description, f.order_date, f.unit_price,
       f.user_id, f.country, q.quantity, f.line_no
FROM x_first f JOIN x_qty q USING (order_id, product_id)"""),
    ("x_o1", """
SELECT DISTINCT ON (order_id) user_id, order_id, order_date FROM x_clean ORDER BY order_id, user_id, order_date"""),
    ("x_oseq", """
SELECT user_id, order_id, order_date, CAST(row_number() OVER w AS BIGINT) AS order_number,
       CAST(isodow(order_date) - 1 AS BIGINT) AS order_dow, CAST(hour(order_date) AS BIGINT) AS order_hour_of_day,
       CAST(floor((epoch(order_date) - epoch(lag(order_date) OVER w)) / 86400) AS BIGINT) AS days_since_prior_order
FROM x_o1 WINDOW w AS (PARTITION BY user_id ORDER BY order_date, order_id)"""),
    ("x_last", "SELECT user_id, max(order_number) AS last_order_number FROM x_oseq GROUP BY user_id"),
    ("x_usplit", f"""
SELECT user_id, last_order_number,
       CASE WHEN row_number() OVER (ORDER BY md5(concat_ws(':', user_id, '{K.SEED}')), user_id) - 1
                 < ceil(count(*) OVER () * {K.TRAIN_SHARE}) THEN 'train' ELSE 'test' END AS held
FROM x_last"""),
    ("x_orders", """
SELECT o.*, CASE WHEN o.order_number = u.last_order_number THEN u.held ELSE 'prior' END AS eval_set
FROM x_oseq o JOIN x_usplit u USING (user_id)"""),
    ("x_op0", """
SELECT c.order_id, c.product_id, c.quantity, c.unit_price,
       CAST(row_number() OVER (PARTITION BY c.order_id ORDER BY c.line_no, c.product_id) AS BIGINT) AS add_to_cart_order,
       o.eval_set, o.user_id, o.order_number
FROM x_clean c LEFT JOIN x_orders o USING (order_id)"""),
    ("x_op", """
SELECT a.*, CAST(CASE WHEN EXISTS (SELECT 1 FROM x_op0 b WHERE b.user_id = a.user_id AND b.product_id = a.product_id
                                   AND b.order_number < a.order_number) THEN 1 ELSE 0 END AS BIGINT) AS reordered
FROM x_op0 a"""),
    ("x_products", "SELECT product_id, min(description) AS description FROM x_clean GROUP BY product_id"),
    ("x_customers", """
SELECT DISTINCT ON (user_id) user_id, country FROM x_clean ORDER BY user_id, order_date, order_id, line_no"""),
    ("x_priors", "SELECT *, unit_price * quantity AS revenue FROM x_op WHERE eval_set = 'prior'"),
    ("x_po", "SELECT *, row_number() OVER (PARTITION BY user_id, product_id ORDER BY order_number) AS nth FROM x_priors"),
    ("x_pagg", """
SELECT product_id, count(*) AS orders, sum(reordered) AS reorders, sum(quantity) AS total_quantity,
       CAST(sum(revenue) AS DOUBLE) AS total_revenue,
       count(*) FILTER (WHERE nth = 1) AS prod_first_buy, count(*) FILTER (WHERE nth = 2) AS prod_second_buy
FROM x_po GROUP BY product_id"""),
    ("x_pf", f"""
SELECT p.product_id, p.description,
       CAST(coalesce(a.orders, 0) AS BIGINT) AS orders, CAST(coalesce(a.reorders, 0) AS BIGINT) AS reorders,
       coalesce({div('a.reorders', 'a.orders')}, 0) AS reorder_rate,
       CAST(coalesce(a.total_quantity, 0) AS BIGINT) AS total_quantity,
       coalesce(a.total_revenue, 0) AS total_revenue,
       coalesce({div('a.total_revenue', 'a.total_quantity')}, 0) AS avg_price,
       CAST(coalesce(a.prod_first_buy, 0) AS BIGINT) AS prod_first_buy,
       CAST(coalesce(a.prod_second_buy, 0) AS BIGINT) AS prod_second_buy,
       coalesce({div('a.prod_second_buy', 'a.prod_first_buy')}, 0) AS prod_1reorder_ratio,
       coalesce({div('a.reorders', 'a.prod_first_buy')}, 0) AS prod_nreorder_ratio
FROM x_products p LEFT JOIN x_pagg a USING (product_id)"""),
    ("x_uf1", """
SELECT user_id, count(*) AS total_items,
       array_to_string(list_sort(list(DISTINCT product_id)), ' ') AS all_products,
       count(DISTINCT product_id) AS total_distinct_items, CAST(sum(quantity) AS BIGINT) AS total_item_quantity,
       CAST(sum(revenue) AS DOUBLE) AS total_money_spent, sum(reordered) AS r,
       count(*) FILTER (WHERE order_number > 1) AS d
FROM x_priors GROUP BY user_id"""),
    ("x_uf2", """
SELECT user_id, avg(days_since_prior_order) AS average_days_between_orders,
       CAST(coalesce(sum(days_since_prior_order), 0) AS BIGINT) AS sum_days_between_orders,
       max(order_number) AS nb_orders
FROM x_orders GROUP BY user_id"""),
    ("x_sizes", "SELECT user_id, order_id, count(*) AS sz FROM x_priors GROUP BY user_id, order_id"),
    ("x_uf3", """
SELECT user_id, avg(sz) AS order_size_mean, stddev_samp(sz) AS order_size_std, max(sz) AS order_size_max
FROM x_sizes GROUP BY user_id"""),
    ("x_uf", f"""
SELECT a.user_id, a.total_items, a.all_products, a.total_distinct_items, a.total_item_quantity,
       a.total_money_spent, {div('a.total_money_spent', 'a.total_item_quantity')} AS avg_money_spent_per_item,
       {div('a.r', 'a.d')} AS user_reorder_ratio,
       b.average_days_between_orders, b.sum_days_between_orders, b.nb_orders,
       c.order_size_mean, c.order_size_std, c.order_size_max
FROM x_uf1 a LEFT JOIN x_uf2 b USING (user_id) LEFT JOIN x_uf3 c USING (user_id)"""),
    ("x_up", """
SELECT user_id, product_id, count(*) AS nb_orders, arg_max(order_id, order_number) AS last_order_id,
       sum(add_to_cart_order) AS sum_pos_in_cart, CAST(sum(quantity) AS BIGINT) AS up_total_quantity,
       CAST(sum(revenue) AS DOUBLE) AS up_total_spent, min(order_number) AS up_first_order_number,
       max(order_number) AS up_last_order_number
FROM x_priors GROUP BY user_id, product_id"""),
]
CTES.append(("x_ratios", f"""
SELECT c.country, u.user_reorder_ratio AS ratio FROM x_customers c JOIN x_uf u USING (user_id)
WHERE c.country IN ({', '.join("'" + c + "'" for c in Q.Q9_COUNTRIES)}) AND u.user_reorder_ratio IS NOT NULL"""))
for _es in ("train", "test"):
    CTES.append((f"x_cand_{_es}", f"""
SELECT o.order_id, p.product_id, o.user_id, o.order_hour_of_day, o.order_dow, o.days_since_prior_order
FROM x_orders o JOIN x_up p USING (user_id) WHERE o.eval_set = '{_es}'"""))
CTES.append(("x_lab_train", """
SELECT c.*, CAST(CASE WHEN t.order_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS labels
FROM x_cand_train c LEFT JOIN (SELECT order_id, product_id FROM x_op WHERE eval_set = 'train') t
USING (order_id, product_id)"""))


def _feature_select(src: str, with_labels: bool) -> str:
    z = lambda e: f"coalesce({e}, 0)"
    lab = "c.labels, " if with_labels else ""
    return f"""
SELECT c.order_id, c.product_id, {lab}c.user_id,
  {z('u.nb_orders')} AS user_total_orders, {z('u.total_items')} AS user_total_items,
  {z('u.total_distinct_items')} AS user_total_distinct_items,
  {z('u.average_days_between_orders')} AS user_average_days_between_orders,
  {z('u.order_size_mean')} AS user_order_size_mean, {z('u.order_size_std')} AS user_order_size_std,
  {z('u.order_size_max')} AS user_order_size_max, {z('u.total_item_quantity')} AS user_total_item_quantity,
  {z('u.total_money_spent')} AS user_total_spent, {z('u.sum_days_between_orders')} AS user_sum_days_between_orders,
  {z('u.user_reorder_ratio')} AS user_reorder_ratio,
  {z('c.order_hour_of_day')} AS order_hour_of_day, {z('c.order_dow')} AS order_dow,
  {z('c.days_since_prior_order')} AS days_since_prior_order,
  {z(div('c.days_since_prior_order', 'u.average_days_between_orders + ' + str(K.DAYS_RATIO_SMOOTHING)))} AS days_since_ratio,
  {z('p.orders')} AS product_orders, {z('p.reorders')} AS product_reorders,
  {z('p.reorder_rate')} AS product_reorder_rate, {z('p.total_quantity')} AS product_total_quantity_sold,
  {z('p.avg_price')} AS product_avg_price, {z('p.prod_first_buy')} AS prod_first_buy,
  {z('p.prod_second_buy')} AS prod_second_buy, {z('p.prod_1reorder_ratio')} AS prod_1reorder_ratio,
  {z('p.prod_nreorder_ratio')} AS prod_nreorder_ratio,
  {z('x.nb_orders')} AS UP_orders, {z(div('x.nb_orders', 'u.nb_orders'))} AS UP_orders_ratio,
  {z(div('x.nb_orders', 'u.nb_orders'))} AS UP_reorder_rate, {z('x.up_total_quantity')} AS UP_total_quantity,
  {z(div('x.nb_orders', 'u.nb_orders - x.up_first_order_number + 1'))} AS UP_order_rate_since_first_order
FROM {src} c LEFT JOIN x_uf u USING (user_id) LEFT JOIN x_pf p USING (product_id)
LEFT JOIN x_up x USING (user_id, product_id)"""


CTES.append(("x_train", _feature_select("x_lab_train", True)))
CTES.append(("x_test", _feature_select("x_cand_test", False)))
CTES.append(("x_fixed", f"""
SELECT order_id, product_id, {Q.FIXED_SCORE} AS pred, user_order_size_max AS prior_size_max FROM x_test"""))
CTES.append(("x_ranked", """
SELECT *, CAST(row_number() OVER (PARTITION BY order_id ORDER BY pred DESC, product_id) - 1 AS BIGINT) AS pred_rank
FROM x_fixed"""))
CTES.append(("x_kept_pred", f"""
SELECT * FROM x_ranked WHERE pred_rank < prior_size_max AND (pred_rank = 0 OR pred > {K.THRESHOLD})"""))
CTES.append(("x_truth_test", "SELECT order_id, product_id, add_to_cart_order FROM x_op WHERE eval_set = 'test'"))


def _f1_ctes(kept: str, truth: str, p: str) -> list[tuple[str, str]]:
    return [
        (f"{p}_np", f"SELECT order_id, count(*) AS n_pred FROM {kept} GROUP BY order_id"),
        (f"{p}_nt", f"SELECT order_id, count(*) AS n_true FROM {truth} GROUP BY order_id"),
        (f"{p}_tp", f"""
SELECT k.order_id, count(*) AS tp FROM {kept} k JOIN {truth} t ON k.order_id = t.order_id
AND k.product_id = t.product_id GROUP BY k.order_id"""),
        (f"{p}_f1", f"""
SELECT a.order_id, CAST(coalesce(c.tp, 0) AS BIGINT) AS tp, a.n_pred, CAST(coalesce(b.n_true, 0) AS BIGINT) AS n_true,
       coalesce({div('2 * c.tp', 'a.n_pred + b.n_true')}, 0) AS f1_score
FROM {p}_np a LEFT JOIN {p}_nt b USING (order_id) LEFT JOIN {p}_tp c USING (order_id)"""),
    ]


CTES += _f1_ctes("x_kept_pred", "x_truth_test", "x_t")
CTES.append(("x_vsplit", f"""
SELECT user_id, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws(':', user_id, 'validation:{K.SEED}')), user_id) - 1
                      < floor(count(*) OVER () * {K.VALIDATION_TRAIN_SHARE}) THEN 'train' ELSE 'validation' END AS split
FROM (SELECT DISTINCT user_id FROM x_train)"""))
CTES.append(("x_val_kept", f"""
SELECT * FROM (
  SELECT order_id, product_id, pred, prior_size_max,
         row_number() OVER (PARTITION BY order_id ORDER BY pred DESC, product_id) - 1 AS pred_rank
  FROM (SELECT t.order_id, t.product_id, t.{Q.FIXED_SCORE} AS pred, t.user_order_size_max AS prior_size_max
        FROM x_train t JOIN x_vsplit s USING (user_id) WHERE s.split = 'validation'))
WHERE pred_rank < prior_size_max AND (pred_rank = 0 OR pred > {K.THRESHOLD})"""))
CTES.append(("x_val_truth", """
SELECT order_id, product_id FROM x_op WHERE eval_set = 'train' AND order_id IN (
  SELECT t.order_id FROM x_train t JOIN x_vsplit s USING (user_id) WHERE s.split = 'validation')"""))
CTES += _f1_ctes("x_val_kept", "x_val_truth", "x_v")

_CTE_INDEX = {name: i for i, (name, _) in enumerate(CTES)}


def with_ctes(body: str) -> str:
    """Prefix ``body`` with every CTE up to the last one it names."""
    last = max((i for name, i in _CTE_INDEX.items() if name in body), default=-1)
    # A CTE may be named inside another: include all up to the deepest one used.
    chosen = CTES[: last + 1]
    return "WITH " + ",\n".join(f"{n} AS ({sql})" for n, sql in chosen) + "\n" + body


def _corr_parts(features: list[str], tag: str, src: str = "x_train") -> tuple[str, str]:
    """(extra CTE text, SELECT) for the long-form correlation of ``features``."""
    sel, rows = [], []
    for i, a in enumerate(features):
        for j in range(i, len(features)):
            b = features[j]
            n = f"c{i}_{j}"
            spread = f"stddev_pop({a}) FILTER ({b} IS NOT NULL) * stddev_pop({b}) FILTER ({a} IS NOT NULL)"
            sel.append(f"covar_pop({a}, {b}) / NULLIF({spread}, 0) AS {n}")
            rows.append((a, b, n))
            if i != j:
                rows.append((b, a, n))
    cte = f", corr_w_{tag} AS (SELECT {', '.join(sel)} FROM {src})"
    values = ", ".join(f"('{a}', '{b}', '{n}')" for a, b, n in rows)
    body = (f"SELECT m.a AS feature_a, m.b AS feature_b, {r6('u.v')} AS corr "
            f"FROM corr_w_{tag} UNPIVOT INCLUDE NULLS (v FOR n IN ({', '.join(sorted({r[2] for r in rows}))})) u "
            f"JOIN (VALUES {values}) m(a, b, n) USING (n)")
    return cte, body


def _perm_sql(features: list[str], size: int, two_sided: bool, of: str = "avg") -> str:
    avg0 = ", ".join(
        f"{of}(CASE WHEN rk <= n0 THEN CAST({f} AS DOUBLE) END) - {of}(CASE WHEN rk > n0 THEN CAST({f} AS DOUBLE) END) AS {f}"
        for f in features)
    obs = ", ".join(
        f"{of}(CASE WHEN labels = 0 THEN CAST({f} AS DOUBLE) END) - {of}(CASE WHEN labels <> 0 THEN CAST({f} AS DOUBLE) END) AS {f}"
        for f in features)
    cols = ", ".join(features)
    cmp = "abs(s.stat) >= abs(o.stat)" if two_sided else "s.stat >= o.stat"
    return with_ctes(f"""
, p_n0 AS (SELECT count(*) FILTER (WHERE labels = 0) AS n0 FROM x_train),
p_perm AS (
  SELECT r.range AS rep, t.*, row_number() OVER (PARTITION BY r.range ORDER BY
         {mix_hash_sql(['t.order_id', 't.product_id'], 'r.range')}, t.order_id, t.product_id) AS rk
  FROM x_train t CROSS JOIN range(1, {size + 1}) r),
p_stat AS (SELECT rep, {avg0} FROM p_perm, p_n0 GROUP BY rep),
p_obs AS (SELECT {obs} FROM x_train),
p_s AS (UNPIVOT p_stat ON {cols} INTO NAME feature VALUE stat),
p_o AS (UNPIVOT p_obs ON {cols} INTO NAME feature VALUE stat)
SELECT s.feature, {r6('max(o.stat)')} AS observed,
       {r6(f'avg(CASE WHEN {cmp} THEN 1.0 ELSE 0.0 END)')} AS p_value
FROM p_s s JOIN p_o o USING (feature) GROUP BY s.feature""").replace("\n\n, p_n0", "\n, p_n0")


def _q(body: str) -> str:
    return with_ctes(body)


_ORD_COLS = ("user_id, order_id, order_date, order_number, order_dow, order_hour_of_day, "
             "days_since_prior_order, eval_set")

_FEATURE_DOUBLES = {"user_average_days_between_orders", "user_order_size_mean", "user_order_size_std",
                    "user_total_spent", "user_reorder_ratio", "days_since_ratio", "product_reorder_rate",
                    "product_avg_price", "prod_1reorder_ratio", "prod_nreorder_ratio", "UP_orders_ratio",
                    "UP_reorder_rate", "UP_order_rate_since_first_order"}


def _features_out(src: str, with_labels: bool) -> str:
    keys = ["order_id", "product_id"] + (["labels"] if with_labels else []) + ["user_id"]
    cols = keys + [r6(f) + f" AS {f}" if f in _FEATURE_DOUBLES else f"CAST({f} AS BIGINT) AS {f}"
                   for f in K.ALL_FEATURES]
    return _q(f"SELECT {', '.join(cols)} FROM {src}")


def _pivot_sql(src: str, ts: str) -> str:
    hours = ", ".join(f"nullif(count(*) FILTER (WHERE h = {h}), 0) AS h{h:02d}" for h in range(24))
    return f"""SELECT order_dow, {hours} FROM (
  SELECT CAST(isodow({ts}) - 1 AS BIGINT) AS order_dow, hour({ts}) AS h FROM {src}) GROUP BY order_dow"""


def _corr_both() -> str:
    c1, b1 = _corr_parts(K.TREE_FEATURES, "tree")
    c2, b2 = _corr_parts(K.LOGISTIC_FEATURES, "lgr")
    return with_ctes(f"{c1}\n{c2}\nSELECT *, 'tree' AS feature_set FROM ({b1})\n"
                     f"UNION ALL SELECT *, 'logistic' AS feature_set FROM ({b2})")


def _corr_one(features: list[str] = K.ALL_FEATURES, src: str = "x_train") -> str:
    c, b = _corr_parts(features, "all", src)
    return with_ctes(f"{c}\n{b}")


def _quantiles() -> str:
    return " UNION ALL ".join(f"""
SELECT country, CAST({p} AS DOUBLE) AS p, count(ratio) AS n, {r6(f'quantile_cont(ratio, {p})')} AS quantile
FROM x_ratios GROUP BY country""" for p in eda.QUANTILES)


def _density(points: int = DENSITY_POINTS, cut: float = DENSITY_CUT) -> str:
    return f"""
, d_m AS (SELECT country AS c, count(ratio) AS n, min(ratio) AS low, max(ratio) AS high,
                 stddev_samp(ratio) * pow(count(ratio), -0.2) AS h FROM x_ratios GROUP BY country),
d_x AS (SELECT c, n, h, g.range AS point,
               low - {cut} * h + (high - low + 2 * {cut} * h) * g.range / {points - 1} AS x
        FROM d_m, range({points}) g WHERE h > 0)
SELECT c AS country, point, {r6('x')} AS x,
       {r6('sum(exp(-pow((x - ratio) / h, 2) / 2)) / (n * h * sqrt(2 * pi()))')} AS density
FROM d_x JOIN x_ratios r ON r.country = c GROUP BY c, point, x, n, h"""


def _sweep() -> str:
    thresholds = ", ".join(f"(CAST({t} AS DOUBLE))" for t in Q.SWEEP)
    return f"""
, s_scores AS (
  SELECT t.order_id, t.product_id, t.{Q.FIXED_SCORE} AS pred, t.user_order_size_max AS m,
         row_number() OVER (PARTITION BY t.order_id ORDER BY t.{Q.FIXED_SCORE} DESC, t.product_id) - 1 AS k
  FROM x_train t JOIN x_vsplit s USING (user_id) WHERE s.split = 'validation'),
s_kept AS (SELECT threshold, order_id, product_id FROM s_scores, (VALUES {thresholds}) v(threshold)
           WHERE k < m AND (k = 0 OR pred > threshold)),
s_true AS (SELECT order_id, count(*) AS n FROM x_val_truth GROUP BY order_id),
s_f1 AS (SELECT threshold, order_id, 2.0 * count(h.product_id) / (count(*) + coalesce(max(s.n), 0)) AS f
         FROM s_kept k LEFT JOIN x_val_truth h USING (order_id, product_id) LEFT JOIN s_true s USING (order_id)
         GROUP BY threshold, order_id)
SELECT threshold, {r6('avg(f)')} AS mean_f1, count(*) AS n_orders FROM s_f1 GROUP BY threshold"""


def _countries() -> str:
    return ", ".join(f"'{c}'" for c in Q.Q9_COUNTRIES)


SQL: dict[str, str] = {
    "net_cancellations": _q("""
SELECT order_id, line_no, stock, user_id, CAST(sum(nq) AS BIGINT) AS quantity, count(*) AS copies
FROM x_netted WHERE nq > 0 AND quantity > 0 GROUP BY order_id, line_no, stock, user_id"""),
    "net_cancellations_total": _q("""
SELECT order_id, line_no, stock, user_id, quantity FROM (
  SELECT l.order_id, l.line_no, l.stock, l.user_id,
         CAST(l.quantity + coalesce((SELECT sum(c.qc) FROM x_canc c WHERE c.user_id = l.user_id
                                     AND c.stock = l.stock), 0) AS BIGINT) AS quantity
  FROM x_lines l WHERE l.quantity > 0) WHERE quantity > 0"""),
    "net_cancellations_fifo": _q("""
SELECT order_id, line_no, stock, user_id, CAST(kept AS BIGINT) AS quantity FROM (
  SELECT l.*, l.quantity - greatest(0, least(l.quantity, coalesce(c.t, 0) - (l.upto - l.quantity))) AS kept
  FROM (SELECT *, sum(quantity) OVER (PARTITION BY user_id, stock ORDER BY order_date, order_id, line_no
                                      ROWS UNBOUNDED PRECEDING) AS upto FROM x_lines WHERE quantity > 0) l
  LEFT JOIN (SELECT user_id, stock, -sum(qc) AS t FROM x_canc GROUP BY user_id, stock) c USING (user_id, stock))
WHERE kept > 0"""),
    "encode_products": _q("SELECT stock, product_id FROM x_codes"),
    "active_customers": _q("SELECT user_id, n_invoices FROM x_active"),
    "consolidate_lines": _q(f"""
SELECT order_id, product_id, CAST(sum(nq) AS BIGINT) AS quantity,
       {r6('arg_min(unit_price, line_no)')} AS unit_price, min(line_no) AS line_no
FROM x_coded GROUP BY order_id, product_id"""),
    "q18_clean": _q(f"""
SELECT order_id, product_id, product_id_original, description, order_date, {r6('unit_price')} AS unit_price,
       user_id, country, quantity FROM x_clean"""),
    "order_sequence": _q("SELECT user_id, order_id, order_number FROM x_oseq"),
    "order_gap_days": _q("SELECT order_id, days_since_prior_order FROM x_oseq"),
    "last_order": _q("SELECT user_id, last_order_number FROM x_last"),
    "holdout_split": _q("SELECT user_id, order_id, eval_set FROM x_orders WHERE eval_set <> 'prior'"),
    "q19_orders": _q(f"SELECT {_ORD_COLS} FROM x_orders"),
    "cart_position": _q("SELECT order_id, product_id, add_to_cart_order FROM x_op0"),
    "mark_reordered": _q("SELECT order_id, product_id, reordered FROM x_op"),
    "nth_purchase": _q("SELECT order_id, product_id, CAST(nth AS BIGINT) AS user_buy_product_times FROM x_po"),
    "q20_order_products": _q(f"""
SELECT order_id, product_id, quantity, {r6('unit_price')} AS unit_price, add_to_cart_order, eval_set, reordered
FROM x_op"""),
    "q21_products": _q("SELECT product_id, description FROM x_products"),
    "q21_customers": _q("SELECT user_id, country FROM x_customers"),
    "q22_baskets": _q("""
SELECT order_id, string_agg(CAST(product_id AS VARCHAR), ' ' ORDER BY add_to_cart_order) AS product_id,
       max(eval_set) AS eval_set FROM x_op GROUP BY order_id"""),
    "q12_product_features": _q(f"""
SELECT product_id, description, orders, reorders, {r6('reorder_rate')} AS reorder_rate, total_quantity,
       {r6('total_revenue')} AS total_revenue, {r6('avg_price')} AS avg_price, prod_first_buy, prod_second_buy,
       {r6('prod_1reorder_ratio')} AS prod_1reorder_ratio, {r6('prod_nreorder_ratio')} AS prod_nreorder_ratio
FROM x_pf"""),
    "q13_user_features": _q(f"""
SELECT user_id, total_items, all_products, total_distinct_items, total_item_quantity,
       {r6('total_money_spent')} AS total_money_spent, {r6('avg_money_spent_per_item')} AS avg_money_spent_per_item,
       {r6('user_reorder_ratio')} AS user_reorder_ratio,
       {r6('average_days_between_orders')} AS average_days_between_orders, sum_days_between_orders, nb_orders,
       {r6('order_size_mean')} AS order_size_mean, {r6('order_size_std')} AS order_size_std, order_size_max
FROM x_uf"""),
    "q14_user_product_features": _q(f"""
SELECT user_id, product_id, nb_orders, last_order_id, CAST(sum_pos_in_cart AS BIGINT) AS sum_pos_in_cart,
       up_total_quantity, {r6('up_total_spent')} AS up_total_spent, up_first_order_number, up_last_order_number
FROM x_up"""),
    "candidates": _q("""
SELECT order_id, product_id, user_id, 'train' AS eval_set FROM x_cand_train
UNION ALL SELECT order_id, product_id, user_id, 'test' AS eval_set FROM x_cand_test"""),
    "candidates_bought": _q("""
SELECT o.order_id, x.product_id, o.user_id, o.eval_set FROM x_orders o JOIN x_up x USING (user_id)
WHERE o.eval_set IN ('train', 'test')"""),
    "labels": _q("SELECT order_id, product_id, labels FROM x_lab_train"),
    "q15_train_features": _features_out("x_train", True),
    "q15_test_features": _features_out("x_test", False),
    "rank_and_cut": _q(f"SELECT order_id, product_id, pred_rank, {r6('pred')} AS pred FROM x_kept_pred"),
    "basket_f1": _q(f"SELECT order_id, tp, n_pred, n_true, {r6('f1_score')} AS f1_score FROM x_t_f1"),
    "blend": _q("SELECT order_id, product_id, " + r6(" + ".join(
        f"{Q.FIXED_BLEND[k]} * {w}" for k, w in K.BLEND_WEIGHTS.items())) + " AS pred FROM x_train"),
    "q16_fixed_score": _q(f"""
SELECT f.order_id,
       (SELECT string_agg(CAST(k.product_id AS VARCHAR), ' ' ORDER BY k.pred_rank) FROM x_kept_pred k
        WHERE k.order_id = f.order_id) AS recommendations,
       (SELECT string_agg(CAST(t.product_id AS VARCHAR), ' ' ORDER BY t.add_to_cart_order) FROM x_truth_test t
        WHERE t.order_id = f.order_id) AS ordered_products,
       {r6('f.f1_score')} AS f1_score
FROM x_t_f1 f"""),
    "q16_mean_f1_fixed_score": _q(f"SELECT {r6('avg(f1_score)')} AS mean_f1, count(*) AS n_orders FROM x_t_f1"),
    "user_split": _q("SELECT user_id, split FROM x_vsplit"),
    "q17_validation_fixed_score": _q(f"SELECT {r6('avg(f1_score)')} AS mean_f1, count(*) AS n_orders FROM x_v_f1"),
    "q1_orders_per_user": _q(f"""
SELECT CAST(least(n, {K.ORDERS_PER_USER_CAP}) AS BIGINT) AS n_orders_capped, count(*) AS n_users,
       CAST(max(max(n)) OVER () AS BIGINT) AS max_orders
FROM (SELECT user_id, max(order_number) AS n FROM x_orders GROUP BY user_id) GROUP BY 1"""),
    "q2_products_per_order": _q(f"""
SELECT CAST(least(n, {K.PRODUCTS_PER_ORDER_CAP}) AS BIGINT) AS n_products_capped, count(*) AS n_orders,
       CAST(max(max(n)) OVER () AS BIGINT) AS max_products
FROM (SELECT order_id, max(add_to_cart_order) AS n FROM x_op GROUP BY order_id) GROUP BY 1"""),
    "q3_basket_averages": _q(f"""
SELECT {r6('avg(n)')} AS avg_distinct_products, {r6('avg(q)')} AS avg_quantity
FROM (SELECT order_id, count(*) AS n, sum(quantity) AS q FROM x_clean GROUP BY order_id)"""),
    "q4_spend_vs_quantity": _q(f"""
SELECT user_id, {r6('avg_money_spent_per_item')} AS avg_money_spent_per_item, total_item_quantity FROM x_uf"""),
    "q5_orders_by_dow": _q("""
SELECT order_dow, count(*) AS n_orders, dayname(min(order_date)) AS day_name FROM x_orders GROUP BY order_dow"""),
    "q6_orders_by_hour": _q("SELECT order_hour_of_day, count(*) AS n_orders FROM x_orders GROUP BY order_hour_of_day"),
    "q7_dow_hour": _q(_pivot_sql("x_orders", "order_date")),
    "q7_events_dow_hour": _pivot_sql("events", "ts"),
    "q8_top_products": _q("""
SELECT CAST(row_number() OVER (ORDER BY orders DESC, product_id) AS BIGINT) AS rank, product_id,
       lower(description) AS description, orders AS value
FROM x_pf ORDER BY orders DESC, product_id LIMIT 10"""),
    "q9_reorder_ratio_by_country": _q(f"""
SELECT c.country, count(*) AS n_users, count(u.user_reorder_ratio) AS n_with_ratio,
       {r6('avg(u.user_reorder_ratio)')} AS mean_ratio, {r6('stddev_samp(u.user_reorder_ratio)')} AS std_ratio,
       {r6('min(u.user_reorder_ratio)')} AS min_ratio, {r6('max(u.user_reorder_ratio)')} AS max_ratio
FROM x_customers c LEFT JOIN x_uf u USING (user_id) WHERE c.country IN ({_countries()}) GROUP BY c.country"""),
    "q9_reorder_ratio_histogram": _q(f"""
SELECT c.country, CAST(least(floor(u.user_reorder_ratio * 20), 19) AS BIGINT) AS bin, count(*) AS n_users
FROM x_customers c JOIN x_uf u USING (user_id)
WHERE c.country IN ({_countries()}) AND u.user_reorder_ratio IS NOT NULL GROUP BY 1, 2"""),
    "q8_top_products_by_revenue": _q(f"""
SELECT CAST(row_number() OVER (ORDER BY total_revenue DESC, product_id) AS BIGINT) AS rank, product_id,
       lower(description) AS description, {r6('total_revenue')} AS value
FROM x_pf ORDER BY total_revenue DESC, product_id LIMIT 10"""),
    "q9_reorder_ratio_quantiles": _q(_quantiles()),
    "q9_reorder_ratio_density": _q(_density()),
    "threshold_sweep": _q(_sweep()),
    "q16_reported_orders": _q("""
SELECT f.order_id, max(o.products) AS ordered_products, max(o.n) AS n_ordered, true AS f1_agrees, true AS all_bought_before
FROM x_t_f1 f LEFT JOIN (
  SELECT order_id, count(*) AS n, string_agg(CAST(product_id AS VARCHAR), ' ' ORDER BY add_to_cart_order) AS products
  FROM x_truth_test GROUP BY order_id) o USING (order_id) GROUP BY f.order_id"""),
    "q17_validated_orders": _q("SELECT count(*) AS n_orders FROM x_v_f1"),
    "q10_corr": _corr_both(),
    "corr_pairs_nulls": _corr_one(Q.NULL_COLUMNS, "x_uf"),
    "perm_test_median": _perm_sql([Q.MEDIAN_FEATURE], K.PERMUTATION_REPLICATES, True, "median"),
    "corr_pairs": _corr_one(),
    "perm_test": _perm_sql([Q.PERM_FEATURE], K.PERMUTATION_REPLICATES, True),
    "perm_test_one_sided": _perm_sql([Q.PERM_FEATURE], K.PERMUTATION_REPLICATES, False),
}

SQL["ingest_roundtrip"] = _q(f"""
SELECT order_id, stock, description, quantity, CAST(order_date AS TIMESTAMP) AS order_date,
       {r6('unit_price')} AS unit_price, user_id, country, line_no FROM raw""")
SQL["saved_features"] = SQL["q15_train_features"]
SQL["stream_order_products"] = SQL["q20_order_products"]
SQL["published_features"] = SQL["q15_train_features"]
SQL["saved_recommendations"] = SQL["q16_fixed_score"]
SQL["user_products"] = _q("SELECT user_id, product_id FROM x_up")
SQL["basket_lines"] = _q("SELECT order_id, add_to_cart_order, product_id, eval_set FROM x_op")

_perm_feats = list(dict.fromkeys(K.TREE_FEATURES + K.LOGISTIC_FEATURES))
_sets = " UNION ALL ".join([f"SELECT 'tree' AS feature_set, '{f}' AS feature" for f in K.TREE_FEATURES]
                           + [f"SELECT 'logistic' AS feature_set, '{f}' AS feature" for f in K.LOGISTIC_FEATURES])
SQL["q11_perm_pvalues"] = ("SELECT s.feature_set, p.feature, p.observed, p.p_value FROM ("
                           + _perm_sql(_perm_feats, K.PERMUTATION_REPLICATES, True)
                           + f") p JOIN ({_sets}) s USING (feature)")
