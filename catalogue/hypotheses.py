"""Registered queries: hypothesis tests."""

from itertools import combinations, product

from pyspark.sql import functions as F

from catalogue.registry import query
from quadrat.operators import hypotheses, multiresponse


def groups_sql(source: str, y: str, group: str) -> str:
    """CTEs g (per group) and s (sums of squares)."""
    return f"""
g AS (SELECT {group} AS g, CAST(count(*) AS BIGINT) AS n, avg({y}) AS m, var_samp({y}) AS v FROM {source} GROUP BY 1),
gm AS (SELECT avg({y}) AS gm FROM {source}),
s AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n * (m - gm) * (m - gm)) AS ssb, sum((n - 1) * v) AS ssw FROM g, gm)"""


def simpson(expression: str, step: float | str, n: int) -> str:
    """Simpson's rule over ``u`` from 0 in ``n`` (even) steps; ``expression`` is a format of u."""
    weight = f"CASE WHEN i IN (0, {n}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"list_sum([{weight} * {expression.format(u=f'(i * {step})')} for i in range(0, {n + 1})]) * {step} / 3"


def f_tail(f: str, d1: str, d2: str) -> str:
    """Upper tail of the F distribution: the incomplete beta integral along t = x * exp(-u / a)."""
    a, b, x = f"({d2} / 2.0)", f"({d1} / 2.0)", f"({d2} / ({d2} + {d1} * {f}))"
    scale = f"lgamma({a} + {b}) - lgamma({a}) - lgamma({b})"
    return simpson(f"exp({a} * ln({x}) - {{u}} + ({b} - 1) * ln(1 - {x} * exp(-{{u}} / {a})) + {scale})", 0.01, 6000) + f" / {a}"


def chi2_tail(x: str, d: str) -> str:
    """Upper tail of the chi-square distribution: the incomplete gamma integral from x / 2 on."""
    at = f"({x} / 2.0 + {{u}})"
    return simpson(f"exp(({d} / 2.0 - 1) * ln({at}) - {at} - lgamma({d} / 2.0))", 0.02, 4000)


F_VALUE = "v AS (SELECT *, k - 1 AS d1, n - k AS d2, ssb / (k - 1) / (ssw / (n - k)) AS f FROM s)"

ANOVA = f"""
WITH {groups_sql("events", "value", "event_type")}, {F_VALUE}
SELECT 'event_type' AS source, d1 AS df, round(ssb, 4) + 0.0 AS sum_sq, round(ssb / d1, 4) + 0.0 AS mean_sq,
  round(f, 4) + 0.0 AS f, round({f_tail("f", "d1", "d2")}, 4) + 0.0 AS p FROM v
UNION ALL SELECT 'Residual', d2, round(ssw, 4) + 0.0, round(ssw / d2, 4) + 0.0, NULL, NULL FROM v"""


@query(ANOVA, digits=4)
def anova_oneway(t):
    return hypotheses.anova_oneway(t("events"), "value", "event_type")


@query(ANOVA, digits=4)
def anova_oneway_p(t):
    return hypotheses.anova_oneway(t("events"), "value", "event_type")


@query("""
SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority), 4) + 0.0 AS residual
FROM orders""", digits=4)
def residuals(t):
    rows = hypotheses.residuals(t("orders"), "o_totalprice", "o_orderpriority")
    return rows.select("o_orderkey", "residual")


@query(f"""
WITH {groups_sql("events", "value", "event_type")}, {F_VALUE}
SELECT 'event_type' AS source, d1 AS df, round(ssb, 4) + 0.0 AS sum_sq, round(ssb / d1, 4) + 0.0 AS mean_sq,
  round(f, 4) + 0.0 AS f, round({f_tail("f", "d1", "d2")}, 4) + 0.0 AS p, round(ssb / (ssb + ssw), 4) + 0.0 AS effect FROM v
UNION ALL SELECT 'Residual', d2, round(ssw, 4) + 0.0, round(ssw / d2, 4) + 0.0, NULL, NULL, NULL FROM v""", digits=4)
def anova_unbalanced(t):
    return hypotheses.anova_unbalanced(t("events"), "value", ["event_type"])


def f_tail_of_one(f: str, d: str) -> str:
    """Upper tail of F with 1 and ``d`` degrees of freedom: one less the t density's integral up to the root of F.

    ``f_tail`` has a singular end there when F is near 0.
    """
    scale = f"exp(lgamma(({d} + 1) / 2.0) - lgamma({d} / 2.0)) / sqrt({d} * pi())"
    density = f"exp(-({d} + 1) / 2.0 * ln(1 + {{u}} * {{u}} / {d}))"
    return f"greatest(1 - 2 * {scale} * {simpson(density, f'(sqrt({f}) / 4000)', 4000)}, 0)"


def orthogonal(table: str, columns: list[str]) -> str:
    """The cells with columns ``q0, q1, …``: Gram-Schmidt of 0/1 columns, weighted by ``n``; 0 where nothing is left."""
    for j, x in enumerate(columns):
        less = "".join(f" - q{k} * sum(n * {x} * q{k}) OVER ()" for k in range(j))
        left = f"(SELECT *, {x}{less} AS r{j} FROM {table})"
        size = f"sum(n * r{j} * r{j}) OVER ()"
        table = f"(SELECT *, CASE WHEN {size} > 1e-9 * sum(n) OVER () THEN r{j} / sqrt({size}) ELSE 0 END AS q{j} FROM {left})"
    return table


def type_two(cells: str, levels: list[int], names: list[str], partial: bool) -> str:
    """Type II table in SQL: Gram-Schmidt over the cells ``f0, f1, …, n, m, v``, levels numbered from 0.

    Each effect's 0/1 columns are made orthogonal to those of all terms that
    don't contain it; a column of which nothing is left counts for nothing.
    """
    places = range(len(levels))
    terms = [t for k in range(len(levels) + 1) for t in combinations(places, k)]

    def columns(term: tuple[int, ...]) -> list[str]:
        choices = product(*[range(1, levels[i]) for i in term])
        return ["*".join(["1.0", *[f"CAST(f{i} = {v} AS INTEGER)" for i, v in zip(term, choice)]]) for choice in choices]

    effects = []
    for term in terms[1:]:
        before = [c for t in terms if not set(term) <= set(t) for c in columns(t)]
        own = columns(term)
        table = orthogonal("c", [*before, *own])
        mine = range(len(before), len(before) + len(own))
        found = " + ".join(f"CAST(sum(abs(q{j})) > 0 AS BIGINT)" for j in mine)
        gain = " + ".join(f"pow(sum(n * q{j} * z), 2)" for j in mine)
        source = " * ".join(names[i] for i in term)
        effects.append(f"SELECT '{source}' AS source, {found} AS d1, {gain} AS ss FROM {table}")
    whole = "ss + w" if partial else "total + w"
    return f"""
WITH c0 AS ({cells}), c AS (SELECT *, m - (SELECT sum(n * m) / sum(n) FROM c0) AS z FROM c0),
w AS (SELECT CAST(sum(n) - count(*) AS BIGINT) AS d2, sum((n - 1) * v) AS w FROM c0),
e AS ({" UNION ALL ".join(effects)}),
t AS (SELECT *, sum(ss) OVER () AS total, CASE WHEN d1 > 0 THEN ss / d1 / (w / d2) END AS f FROM e, w)
SELECT source, CAST(d1 AS BIGINT) AS df, round(ss, 4) + 0.0 AS sum_sq, round(CASE WHEN d1 > 0 THEN ss / d1 END, 4) + 0.0 AS mean_sq,
  round(f, 4) + 0.0 AS f, round(CASE WHEN d1 = 1 THEN {f_tail_of_one("f", "d2")} WHEN d1 > 1 THEN {f_tail("f", "d1", "d2")} END, 4) + 0.0 AS p,
  round(ss / ({whole}), 4) + 0.0 AS effect FROM t
UNION ALL SELECT 'Residual', d2, round(w, 4) + 0.0, round(w / d2, 4) + 0.0, NULL, NULL, NULL FROM w"""


TWO = """SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS f0, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS f1,
  count(*) AS n, avg(l_extendedprice / 1000.0) AS m, var_samp(l_extendedprice / 1000.0) AS v FROM lineitem GROUP BY 1, 2"""


@query(type_two(TWO, [3, 2], ["l_returnflag", "l_linestatus"], partial=True), digits=4)
def anova_two_factors(t):
    lines = t("lineitem").withColumn("price", F.col("l_extendedprice") / 1000.0)
    return hypotheses.anova_unbalanced(lines, "price", ["l_returnflag", "l_linestatus"], "np2")


THREE = """SELECT CAST(l_linestatus = 'O' AS INTEGER) AS f0, CAST(l_quantity > 25 AS INTEGER) AS f1, CAST(l_discount > 0.05 AS INTEGER) AS f2,
  count(*) AS n, avg(l_extendedprice / 1000.0) AS m, var_samp(l_extendedprice / 1000.0) AS v FROM lineitem GROUP BY 1, 2, 3"""


@query(type_two(THREE, [2, 2, 2], ["l_linestatus", "bulk", "deal"], partial=False), digits=4)
def anova_three_factors(t):
    lines = t("lineitem").select(
        "l_linestatus", (F.col("l_quantity") > 25).alias("bulk"), (F.col("l_discount") > 0.05).alias("deal"),
        (F.col("l_extendedprice") / 1000.0).alias("price"),
    )
    return hypotheses.anova_unbalanced(lines, "price", ["l_linestatus", "bulk", "deal"])


MANOVA = """
c AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS a, avg(l_discount) AS b, covar_pop(l_quantity, l_quantity) AS aa,
  covar_pop(l_quantity, l_discount) AS ab, covar_pop(l_discount, l_discount) AS bb FROM lineitem GROUP BY 1),
m AS (SELECT avg(l_quantity) AS ma, avg(l_discount) AS mb FROM lineitem),
x AS (SELECT sum(n * aa) AS eaa, sum(n * ab) AS eab, sum(n * bb) AS ebb, sum(n * (a - ma) * (a - ma)) AS haa,
  sum(n * (a - ma) * (b - mb)) AS hab, sum(n * (b - mb) * (b - mb)) AS hbb FROM c, m),
d AS (SELECT *, eaa * ebb - eab * eab AS de, (eaa + haa) * (ebb + hbb) - (eab + hab) * (eab + hab) AS dt FROM x),
z AS (SELECT 'Wilks'' lambda' AS statistic, de / dt AS value FROM d
UNION ALL SELECT 'Pillai''s trace', (haa * (ebb + hbb) - 2 * hab * (eab + hab) + hbb * (eaa + haa)) / dt FROM d
UNION ALL SELECT 'Hotelling-Lawley trace', (haa * ebb - 2 * hab * eab + hbb * eaa) / de FROM d
UNION ALL SELECT 'Roy''s greatest root', (tr + sqrt(tr * tr - 4 * dd)) / 2 FROM (
  SELECT (haa * ebb - 2 * hab * eab + hbb * eaa) / de AS tr, (haa * hbb - hab * hab) / de AS dd FROM d))"""

# The F forms for two responses and three groups, with v the residual degrees of freedom.
MANOVA_F = MANOVA + """,
e AS (SELECT CAST(sum(n) - count(*) AS DOUBLE) AS v FROM c),
w AS (SELECT statistic, value, CASE WHEN statistic LIKE 'Roy%' THEN 2.0 ELSE 4.0 END AS d1,
  CASE left(statistic, 1) WHEN 'W' THEN 2 * v - 2 WHEN 'P' THEN 2 * v WHEN 'H' THEN 2 * v - 4 ELSE v END AS d2,
  CASE left(statistic, 1) WHEN 'W' THEN (1 / sqrt(value) - 1) * (2 * v - 2) / 4 WHEN 'P' THEN v / 2 * value / (2 - value)
    WHEN 'H' THEN (2 * v - 4) * value / 8 ELSE value * v / 2 END AS f FROM z, e)"""


@query(f"WITH {MANOVA} SELECT statistic, round(value, 8) + 0.0 AS value FROM z", digits=8)
def manova(t):
    rows = hypotheses.manova(t("lineitem"), ["l_quantity", "l_discount"], "l_returnflag")
    return rows.select("statistic", "value")


@query(f"""
WITH {MANOVA_F}
SELECT statistic, round(value, 6) + 0.0 AS value, CAST(d1 AS DOUBLE) AS df1, CAST(d2 AS DOUBLE) AS df2, round(f, 6) + 0.0 AS f,
  round({f_tail("f", "d1", "d2")}, 6) + 0.0 AS p FROM w""", digits=6)
def manova_p(t):
    return hypotheses.manova(t("lineitem"), ["l_quantity", "l_discount"], "l_returnflag")


def term_statistics(cells: str, terms: dict[str, list[str]]) -> str:
    """Four statistics per term for two responses, from cells ``n, a, b, aa, ab, bb`` (means and population covariances)."""
    every = orthogonal("c", [x for columns in terms.values() for x in columns])
    count = sum(map(len, terms.values()))
    hypotheses_ = []
    for name, own in terms.items():
        first = [x for other, columns in terms.items() if other != name for x in columns]
        mine = range(len(first), len(first) + len(own))
        parts = [" + ".join(f"sum(n * q{j} * {i}) * sum(n * q{j} * {k})" for j in mine) for i, k in ("aa", "ab", "bb")]
        hypotheses_.append(
            f"SELECT '{name}' AS term, {len(own)}.0 AS q, {parts[0]} AS haa, {parts[1]} AS hab, {parts[2]} AS hbb FROM {orthogonal('c', [*first, *own])}"
        )
    fitted = [" + ".join(["0"] + [f"sum(n * q{j} * ({i} - m{i})) * sum(n * q{j} * ({k} - m{k}))" for j in range(count)]) for i, k in ("aa", "ab", "bb")]
    return f"""
WITH c0 AS ({cells}), c AS (SELECT * FROM c0),
m AS (SELECT sum(n * a) / sum(n) AS ma, sum(n * b) / sum(n) AS mb FROM c0),
e AS (SELECT sum(n) - {count}.0 AS v, sum(n * (aa + (a - ma) * (a - ma))) - ({fitted[0]}) AS eaa,
  sum(n * (ab + (a - ma) * (b - mb))) - ({fitted[1]}) AS eab, sum(n * (bb + (b - mb) * (b - mb))) - ({fitted[2]}) AS ebb FROM {every}, m),
h AS ({" UNION ALL ".join(hypotheses_)}),
d AS (SELECT *, eaa * ebb - eab * eab AS de, (eaa + haa) * (ebb + hbb) - (eab + hab) * (eab + hab) AS dt,
  haa * ebb - 2 * hab * eab + hbb * eaa AS mix, haa * hbb - hab * hab AS dh FROM e, h),
s AS (SELECT *, least(2.0, q) AS s, (abs(2 - q) - 1) / 2 AS mm, (v - 3) / 2 AS nn, greatest(2.0, q) AS r,
  CASE WHEN q > 1 THEN sqrt((4 * q * q - 4) / (q * q - 1)) ELSE 1.0 END AS t FROM d),
z AS (SELECT *, t * (v + q - (q + 3) / 2) - (2 * q - 2) / 2 AS w2, 2 * mm + s + 1 AS k, de / dt AS wilks,
  (mix + 2 * dh) / dt AS pillai, mix / de AS hotelling, (mix / de + sqrt(greatest(pow(mix / de, 2) - 4 * dh / de, 0))) / 2 AS roy FROM s),
l AS (SELECT term, 'Wilks'' lambda' AS statistic, wilks AS value, 2 * q AS d1, w2 AS d2, (pow(wilks, -1 / t) - 1) * w2 / (2 * q) AS f FROM z
UNION ALL SELECT term, 'Pillai''s trace', pillai, s * k, s * (2 * nn + s + 1), (2 * nn + s + 1) / k * pillai / (s - pillai) FROM z
UNION ALL SELECT term, 'Hotelling-Lawley trace', hotelling, s * k, 2 * (s * nn + 1), 2 * (s * nn + 1) * hotelling / (s * s * k) FROM z
UNION ALL SELECT term, 'Roy''s greatest root', roy, r, v - r + q, roy * (v - r + q) / r FROM z)
SELECT term, statistic, round(value, 6) + 0.0 AS value, round(d1, 6) + 0.0 AS df1, round(d2, 6) + 0.0 AS df2, round(f, 6) + 0.0 AS f,
  round({f_tail("f", "d1", "d2")}, 6) + 0.0 AS p FROM l"""


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
TERMS = {
    "Intercept": ["1.0"],
    "o_orderstatus": ["CAST(f0 = 'O' AS INTEGER)", "CAST(f0 = 'P' AS INTEGER)"],
    "o_orderpriority": [f"CAST(f1 = '{x}' AS INTEGER)" for x in PRIORITIES[1:]],
}


@query(term_statistics("""SELECT o_orderstatus AS f0, o_orderpriority AS f1, CAST(count(*) AS DOUBLE) AS n, avg(o_totalprice / 1000.0) AS a,
  avg(CAST(day(o_orderdate) AS DOUBLE)) AS b, covar_pop(o_totalprice / 1000.0, o_totalprice / 1000.0) AS aa,
  covar_pop(o_totalprice / 1000.0, day(o_orderdate)) AS ab, covar_pop(day(o_orderdate), day(o_orderdate)) AS bb
  FROM orders GROUP BY 1, 2""", TERMS))
def manova_by_term(t):
    orders = t("orders").select(
        "o_orderstatus", "o_orderpriority", (F.col("o_totalprice") / 1000.0).alias("price"),
        F.dayofmonth("o_orderdate").cast("double").alias("day"),
    )
    return multiresponse.manova_terms(orders, ["price", "day"], ["o_orderstatus", "o_orderpriority"])


@query(f"""
WITH {groups_sql("orders", "o_totalprice", "o_orderpriority")}
SELECT a.g AS a, b.g AS b, round(b.m - a.m, 4) + 0.0 AS diff,
  round(sqrt(ssw / (s.n - k) / 2 * (1.0 / a.n + 1.0 / b.n)), 4) + 0.0 AS se FROM g a JOIN g b ON a.g < b.g, s""", digits=4)
def tukey_hsd(t):
    pairs = hypotheses.tukey_hsd(t("orders"), "o_totalprice", "o_orderpriority")
    return pairs.select("a", "b", "diff", "se")


@query(digits=4)
def tukey_hsd_p(t):
    return hypotheses.tukey_hsd(t("orders"), "o_totalprice", "o_orderpriority")


@query(f"""
WITH {groups_sql("orders", "o_totalprice", "o_orderpriority")}
SELECT a.g AS a, b.g AS b, round(a.m, 4) + 0.0 AS mean_a, round(b.m, 4) + 0.0 AS mean_b, round(a.m - b.m, 4) + 0.0 AS diff,
  round(sqrt(ssw / (s.n - k) * (1.0 / a.n + 1.0 / b.n)), 4) + 0.0 AS se,
  round((a.m - b.m) / sqrt(ssw / (s.n - k) * (1.0 / a.n + 1.0 / b.n)), 4) + 0.0 AS t,
  round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) * (1 - 3.0 / (4.0 * (a.n + b.n) - 9)), 4)
  + 0.0 AS hedges FROM g a JOIN g b ON a.g < b.g, s""", digits=4)
def pairwise_tukey(t):
    return hypotheses.pairwise_tukey(t("orders"), "o_totalprice", "o_orderpriority").drop("p_tukey")


@query(digits=4)
def tukey_intervals(t):
    return hypotheses.tukey_intervals(t("orders"), "o_totalprice", "o_orderpriority")


def p_values(t):
    """A family of p-values per status: a smooth function of the monthly order count."""
    months = t("orders").groupBy(
        F.col("o_orderstatus").alias("family"), F.month("o_orderdate").alias("month")
    ).agg(F.count(F.lit(1)).alias("orders"))
    return months.select(
        "family", "month", ((F.col("orders") % 97 + F.col("month") / 100.0) / 1000.0).alias("p")
    )


P_VALUES = """
p AS (SELECT o_orderstatus AS family, CAST(month(o_orderdate) AS INTEGER) AS month,
  (count(*) % 97 + CAST(month(o_orderdate) AS INTEGER) / 100.0) / 1000.0 AS p FROM orders GROUP BY o_orderstatus, CAST(month(o_orderdate) AS INTEGER)),
r AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p) AS i FROM p)"""


def adjusted(method: str, expression: str):
    """Register one correction method."""
    sql = f"""
WITH {P_VALUES}, c AS (SELECT family, month, p, least(CAST({expression} AS DOUBLE), 1.0) AS c FROM r)
SELECT family, month, round(p, 6) + 0.0 AS p, round(c, 6) + 0.0 AS corrected, c <= 0.05 AS reject FROM c"""

    def run(t):
        return hypotheses.adjust_pvalues(p_values(t), "p", method, family=["family"])

    run.__name__ = f"adjust_pvalues_{method}"
    query(sql)(run)


WINDOW = "OVER (PARTITION BY family ORDER BY p ROWS BETWEEN"
adjusted("bonferroni", "p * m")
adjusted("sidak", "1 - (1 - p) ^ m")
adjusted("holm", f"max(p * (m - i + 1)) {WINDOW} UNBOUNDED PRECEDING AND CURRENT ROW)")
adjusted("fdr_bh", f"min(p * m / i) {WINDOW} CURRENT ROW AND UNBOUNDED FOLLOWING)")
adjusted("fdr_by", f"min(p * m / i * list_sum([1.0 / k for k in range(1, m + 1)])) {WINDOW} CURRENT ROW AND UNBOUNDED FOLLOWING)")

MOMENTS = """
z AS (SELECT p_retailprice - (SELECT avg(p_retailprice) FROM part) AS d FROM part),
c AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(d ^ 3) / avg(d ^ 2) ^ 1.5 AS g1, avg(d ^ 4) / avg(d ^ 2) ^ 2 - 3 AS g2 FROM z),
jb AS (SELECT CAST(n AS BIGINT) AS n, n / 6 * (g1 * g1 + g2 * g2 / 4) AS statistic FROM c)"""

DAGOSTINO = """
k1 AS (SELECT n, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
  3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta,
  (g2 + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
  6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS s FROM c),
k2 AS (SELECT *, sqrt(2 * (beta - 1)) - 1 AS w2, 6 + 8 / s * (2 / s + sqrt(1 + 4 / (s * s))) AS a FROM k1),
k3 AS (SELECT n, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1,
  (1 - 2 / (9 * a) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS z2 FROM k2),
k AS (SELECT CAST(n AS BIGINT) AS n, z1 * z1 + z2 * z2 AS statistic FROM k3)"""


@query(f"WITH {MOMENTS} SELECT n, round(statistic, 4) + 0.0 AS statistic, round(exp(-statistic / 2), 4) + 0.0 AS p FROM jb", digits=4)
def jarque_bera(t):
    return hypotheses.jarque_bera(t("part"), "p_retailprice")


@query(f"WITH {MOMENTS}, {DAGOSTINO} SELECT n, round(statistic, 4) + 0.0 AS statistic, round(exp(-statistic / 2), 4) + 0.0 AS p FROM k", digits=4)
def dagostino(t):
    return hypotheses.dagostino(t("part"), "p_retailprice")


@query()
def shapiro_wilk(t):
    return hypotheses.shapiro_wilk(t("supplier"), "s_acctbal")


@query()
def feature_rank_shapiro(t):
    return hypotheses.feature_rank_shapiro(t("events").withColumn("half", F.sqrt("value")), ["value", "half"])


@query()
def normality_tests(t):
    return hypotheses.normality_tests(t("customer"), "c_acctbal")


LEVENE_SOURCE = """(SELECT event_type, abs(value - median(value) OVER (PARTITION BY event_type)) AS spread FROM events)"""


EQUAL_VARIANCE = f"""
WITH g0 AS (SELECT count(*) AS n, var_samp(value) AS v FROM events GROUP BY event_type),
b AS (SELECT count(*) AS k, sum(n) AS n, sum((n - 1) * v) AS w, sum((n - 1) * ln(v)) AS l, sum(1.0 / (n - 1)) AS h FROM g0),
x AS (SELECT k - 1 AS d, ((n - k) * ln(w / (n - k)) - l) / (1 + (h - 1.0 / (n - k)) / (3 * (k - 1))) AS x FROM b),
{groups_sql(LEVENE_SOURCE, "spread", "event_type")}, {F_VALUE},
q AS (SELECT 'Bartlett' AS test, x AS statistic, {chi2_tail("x", "d")} AS p FROM x
  UNION ALL SELECT 'Levene', f, {f_tail("f", "d1", "d2")} FROM v)
SELECT test, round(statistic, 4) + 0.0 AS statistic, round(p, 4) + 0.0 AS p, p > 0.05 AS equal_var FROM q"""


@query(EQUAL_VARIANCE, digits=4)
def equal_variance_tests(t):
    return hypotheses.equal_variance_tests(t("events"), "value", "event_type")


@query(EQUAL_VARIANCE, digits=4)
def equal_variance_tests_p(t):
    return hypotheses.equal_variance_tests(t("events"), "value", "event_type")


# Every order as a test of one family: a p-value that falls with the distance of its price from 250,000.
ORDERS = """
p AS (SELECT o_orderkey, round(exp(-abs(CAST(o_totalprice AS DOUBLE) - 250000) / 20000), 9) AS p FROM orders),
r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p) AS i FROM p)"""


def one_family(method: str, expression: str):
    """Register one ordered correction over all orders."""
    sql = f"""
WITH {ORDERS}, c AS (SELECT o_orderkey, p, least(CAST({expression} AS DOUBLE), 1.0) AS c FROM r)
SELECT o_orderkey, round(p, 9) + 0.0 AS p, round(c, 9) + 0.0 AS corrected, c <= 0.05 AS reject FROM c"""

    def run(t):
        gap = F.abs(F.col("o_totalprice").cast("double") - 250000)
        rows = t("orders").select("o_orderkey", F.round(F.exp(-gap / 20000), 9).alias("p"))
        return hypotheses.adjust_pvalues(rows, "p", method)

    run.__name__ = f"adjust_pvalues_{method}_orders"
    query(sql, digits=9)(run)


one_family("holm", "max(p * (m - i + 1)) OVER (ORDER BY p, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
one_family("fdr_bh", "min(p * m / i) OVER (ORDER BY p, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
