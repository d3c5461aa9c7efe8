"""SQL statements of the registered queries for an independent engine.

They restate each result from its definition (self-joins, row-by-row windows, whole
months at once), not from the way the Spark side computes it. ``PARTS`` are named
sub-selects; a statement pulls in the ones it mentions.
"""

from __future__ import annotations

import re


def r(*cols: str, digits: int = 8) -> str:
    """Rounded select items; ``expr>name`` renames. The offset keeps exact decimal
    halves off the rounding boundary."""
    out = []
    for c in cols:
        expr, _, name = c.rpartition(">") if ">" in c else (c, "", "")
        out.append(f"round(CAST({expr} AS DOUBLE) + 0.123e-{digits}, {digits}) + 0e0 AS {name or expr}")
    return ", ".join(out)


def frame(rows: int) -> str:
    return (f"(PARTITION BY signalname ORDER BY yyyymm "
            f"ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)")


def over(agg: str, seen: str, rows: int, least: int) -> str:
    w = frame(rows)
    return f"CASE WHEN count({seen}) OVER {w} >= {least} THEN {agg} OVER {w} END"


def _skew36() -> str:
    w = frame(36)
    m, m2, m3 = (f"avg({e}) OVER {w}" for e in ("ret", "ret*ret", "ret*ret*ret"))
    var = f"({m2} - {m} * {m})"
    return (f"CASE WHEN count(ret) OVER {w} >= 36 AND {var} > 0 THEN "
            f"({m3} - 3 * {m} * {m2} + 2 * {m} * {m} * {m}) / pow({var}, 1.5e0) END")


_RETURNS = ", ".join(f"exp({over('sum(lr)', 'lr', w, w)}) - 1 AS r_{w}" for w in (3, 6, 12, 24, 36, 60))
_VOLS = ", ".join(f"{over('stddev_samp(ret)', 'ret', w, w // 2)} AS vol_{w}" for w in (12, 36, 60))
_SIGNALS = ("sig_disc", "sig_price", "sig_qty", "sig_tax")

PARTS = {
    "rets": """
        SELECT CAST(l_suppkey AS VARCHAR) AS signalname,
               CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS yyyymm,
               year(l_shipdate) * 12 + month(l_shipdate) AS mi,
               CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE)
                   / (count(l_discount) * 1e2) - 5e-2 AS ret,
               ln(1e0 + count(*)) AS log_breadth
        FROM lineitem GROUP BY 1, 2, 3""",
    "meta": """
        SELECT CAST(s_suppkey AS VARCHAR) AS signalname, 1993e0 + s_suppkey % 3 AS pub_year,
               1980e0 + s_suppkey % 7 AS sample_start_year,
               1990e0 + s_suppkey % 3 AS sample_end_year, s_acctbal / 1e3 AS orig_tstat,
               CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal / 1e4 END AS orig_ret,
               CASE s_suppkey % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 6e0 ELSE 12e0 END AS holding_months,
               CASE WHEN s_suppkey % 4 = 0 THEN 5e0 ELSE 10e0 END AS ls_quantile,
               CASE WHEN s_suppkey % 2 = 0 THEN 'VW' ELSE 'EW' END AS stock_weight,
               r_name AS cat_economic, n_name AS cat_data,
               CASE WHEN s_acctbal < 0 THEN 'short' ELSE 'long' END AS cat_form
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
             JOIN region ON n_regionkey = r_regionkey""",
    "pit": """
        SELECT rets.* FROM rets JOIN meta USING (signalname)
        WHERE yyyymm BETWEEN 197301 AND 202312 AND yyyymm >= (pub_year + 1) * 100 + 1""",
    "feat0": f"""
        SELECT *, ret AS r_1, {_RETURNS},
               exp({over('sum(lr)', 'lr', 12, 12)} - lr) - 1 AS r_12_2, {_VOLS},
               {over('avg(ret)', 'ret', 36, 18)} AS mean_36,
               {over('avg(ret)', 'ret', 60, 30)} AS mean_60, {_skew36()} AS skew_36,
               sum(lr) OVER (PARTITION BY signalname ORDER BY yyyymm
                             ROWS UNBOUNDED PRECEDING) AS cum
        FROM (SELECT *, ln(1 + ret) AS lr FROM pit)""",
    "feat": f"""
        SELECT *, mean_36 / greatest(vol_36, 1e-6) * sqrt(12e0) AS sharpe_36,
               mean_60 / greatest(vol_60, 1e-6) * sqrt(12e0) AS sharpe_60,
               cum - {over('max(cum)', 'cum', 60, 12)} AS dd_60
        FROM feat0""",
    "idx": """
        SELECT yyyymm, avg(ret) AS idx_ret, count(*) AS n_available FROM pit GROUP BY yyyymm""",
    "idxfeat0": f"""
        SELECT signalname, yyyymm, idx_ret, n_available,
               {over('covar_samp(ret, idx_ret)', 'ret', 60, 24)} AS cov,
               {over('stddev_samp(idx_ret)', 'idx_ret', 60, 24)} AS sd_idx,
               {over('stddev_samp(ret)', 'ret', 60, 24)} AS sd_own,
               {over('sum(idx_ret)', 'idx_ret', 12, 12)} AS idx_r_12
        FROM pit JOIN idx USING (yyyymm)""",
    "idxfeat": """
        SELECT signalname, yyyymm, idx_ret, n_available, idx_r_12,
               cov / greatest(sd_idx * sd_idx, 1e-12) AS beta_idx,
               CASE WHEN cov IS NOT NULL THEN cov / greatest(sd_idx * sd_own, 1e-12) END AS corr_idx
        FROM idxfeat0""",
    "firm": """
        SELECT l_partkey AS permno,
               CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS yyyymm,
               year(l_shipdate) * 12 + month(l_shipdate) AS mi,
               CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE)
                   / (count(*) * 1e2) AS sig_disc,
               CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 1e2 AS sig_price,
               sum(l_quantity) / count(*) AS sig_qty,
               CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 1e2) AS sig_tax
        FROM lineitem GROUP BY 1, 2, 3""",
    "sigs": " UNION ALL ".join(
        f"SELECT '{s}' AS signalname, permno, yyyymm, mi, {s} AS value FROM firm" for s in _SIGNALS),
    "ranked_sigs": """
        SELECT *, row_number() OVER (PARTITION BY signalname, mi ORDER BY value, permno) AS k,
               count(*) OVER (PARTITION BY signalname, mi) AS n FROM sigs""",
    "sided_sigs": """
        SELECT *, CASE WHEN k * 10 > n * 9 THEN 1e0 WHEN k * 10 <= n THEN -1e0 ELSE 0e0 END AS side
        FROM ranked_sigs WHERE n >= 20""",
    "dbook": """
        SELECT signalname, permno, yyyymm, mi, side, k / CAST(n AS DOUBLE) AS u,
               side / greatest(sum(abs(side)) OVER (PARTITION BY signalname, mi), 1) * 2 AS w
        FROM sided_sigs""",
    "dmonths": "SELECT DISTINCT signalname, yyyymm, mi FROM dbook",
    "dvalid": """
        SELECT m.* FROM dmonths m JOIN dmonths p ON p.signalname = m.signalname AND p.mi = m.mi - 1""",
    "dturn": """
        SELECT v.signalname, v.yyyymm, v.mi, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) AS turnover
        FROM dvalid v JOIN (
            SELECT signalname, mi, permno FROM dbook
            UNION SELECT signalname, mi + 1, permno FROM dbook) k USING (signalname, mi)
        LEFT JOIN dbook a ON a.signalname = k.signalname AND a.mi = k.mi AND a.permno = k.permno
        LEFT JOIN dbook b ON b.signalname = k.signalname AND b.mi = k.mi - 1 AND b.permno = k.permno
        GROUP BY ALL""",
    "dcorr": """
        SELECT a.signalname, a.mi, CASE WHEN count(*) > 30 THEN corr(a.u, b.u) END AS rank_autocorr
        FROM dbook a JOIN dbook b ON b.signalname = a.signalname AND b.permno = a.permno
             AND b.mi = a.mi - 1 GROUP BY ALL""",
    "causal": """
        SELECT signalname, yyyymm, turnover, CASE WHEN count(turnover) OVER w >= 24
               THEN avg(turnover) OVER w END AS turnover_causal
        FROM dturn WINDOW w AS (PARTITION BY signalname ORDER BY yyyymm
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "filled": """
        SELECT p.signalname, p.yyyymm, last_value(c.turnover_causal IGNORE NULLS) OVER (
                   PARTITION BY p.signalname ORDER BY p.yyyymm
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tc
        FROM (SELECT *, list_extract(['sig_disc', 'sig_price', 'sig_qty', 'sig_tax'],
                                     CAST(signalname AS BIGINT) % 4 + 1) AS signal FROM pit) p
        LEFT JOIN causal c ON c.signalname = p.signal AND c.yyyymm = p.yyyymm""",
    "costed": """
        SELECT signalname, yyyymm, coalesce(tc, (SELECT median(tc) FROM filled))
               / greatest(coalesce(holding_months, 1), 1) AS turnover_raw
        FROM filled JOIN meta USING (signalname)""",
    "ahead": """
        SELECT * FROM (
            SELECT signalname, yyyymm, mi, ret, lead(ret) OVER a AS ret_next, lead(mi) OVER a AS mi_next
            FROM pit WINDOW a AS (PARTITION BY signalname ORDER BY yyyymm))
        WHERE mi_next = mi + 1""",
    "target": """
        SELECT signalname, yyyymm, ret, ret_next,
               ret_next - avg(ret_next) OVER (PARTITION BY yyyymm) AS ret_next_dm
        FROM ahead QUALIFY count(*) OVER (PARTITION BY yyyymm) >= 5""",
    "panel": """
        SELECT t.signalname, t.yyyymm, t.ret, t.ret_next, t.ret_next_dm, c.turnover_raw,
               c.turnover_raw * 25 / 1e4 AS carry_cost, 5e-3 AS switch_cost, i.n_available,
               i.idx_ret, i.idx_r_12, i.beta_idx, i.corr_idx,
               f.* EXCLUDE (signalname, yyyymm, mi, ret, mean_36, mean_60, cum, lr)
        FROM target t JOIN costed c USING (signalname, yyyymm)
             JOIN idxfeat i USING (signalname, yyyymm) JOIN feat f USING (signalname, yyyymm)""",
    "preds": """
        SELECT u.model, signalname, yyyymm, ret_next, ret_next_dm, carry_cost, turnover_raw,
               round(u.score, 10) + 0e0 AS score
        FROM panel, unnest([{'model': 'lowvol', 'score': -vol_12},
                            {'model': 'momentum', 'score': r_12_2},
                            {'model': 'reversal', 'score': -ret}]) AS t(u)
        WHERE r_12_2 IS NOT NULL AND vol_12 IS NOT NULL""",
    "ranked": """
        SELECT *, rank() OVER (PARTITION BY model, yyyymm ORDER BY score)
                  + (count(*) OVER (PARTITION BY model, yyyymm, score) - 1) / 2e0 AS k,
               row_number() OVER (PARTITION BY model, yyyymm ORDER BY score, signalname) AS o,
               count(*) OVER (PARTITION BY model, yyyymm) AS n,
               exp(score - max(score) OVER (PARTITION BY model, yyyymm)) AS e FROM preds""",
    "devs": """
        SELECT *, k - (n + 1) / 2e0 AS dev,
               sum(abs(k - (n + 1) / 2e0)) OVER (PARTITION BY model, yyyymm) AS l1,
               sum(e) OVER (PARTITION BY model, yyyymm) AS z FROM ranked""",
    "w_equal": """
        SELECT 'equal_weight' AS model, 'equal' AS scheme, yyyymm, signalname, 1e0 / n AS weight, n,
               ret_next, carry_cost, turnover_raw FROM devs WHERE model = 'momentum'""",
    "w_tilt": """
        SELECT model, 'tilt' AS scheme, yyyymm, signalname, 1e0 / n +
               CASE WHEN n < 2 OR l1 = 0 THEN 0 ELSE dev / l1 END AS weight, n,
               ret_next, carry_cost, turnover_raw FROM devs""",
    "w_neutral": """
        SELECT model, 'neutral' AS scheme, yyyymm, signalname,
               CASE WHEN n < 2 OR l1 = 0 THEN 0 ELSE 2 * dev / l1 END AS weight, n,
               ret_next, carry_cost, turnover_raw FROM devs""",
    "w_quantile": """
        SELECT model, 'quantile' AS scheme, yyyymm, signalname, CASE WHEN n < 5 THEN 1e0 / n
               WHEN o * 5 > n * 4 THEN 1e0 / sum(CASE WHEN o * 5 > n * 4 THEN 1 ELSE 0 END)
                    OVER (PARTITION BY model, yyyymm) ELSE 0 END AS weight, n,
               ret_next, carry_cost, turnover_raw FROM devs""",
    "w_simplex": """
        SELECT model, 'simplex' AS scheme, yyyymm, signalname, e / z AS weight, n,
               ret_next, carry_cost, turnover_raw FROM devs""",
    "factors": """
        SELECT yyyymm, mktrf, smb, hml FROM (
            SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS yyyymm,
                   sum(CAST(round(l_discount * 100) AS BIGINT)) / (count(*) * 1e2) - 5e-2 AS mktrf,
                   sum(CASE WHEN l_returnflag = 'A' THEN CAST(round(l_discount * 100) AS BIGINT) END)
                       / (count(CASE WHEN l_returnflag = 'A' THEN 1 END) * 1e2) - 5e-2 AS smb,
                   sum(CASE WHEN l_returnflag = 'R' THEN CAST(round(l_discount * 100) AS BIGINT) END)
                       / (count(CASE WHEN l_returnflag = 'R' THEN 1 END) * 1e2) - 5e-2 AS hml
            FROM lineitem GROUP BY 1)
        WHERE mktrf IS NOT NULL AND smb IS NOT NULL AND hml IS NOT NULL""",
    "book": "SELECT * FROM w_tilt UNION ALL SELECT * FROM w_equal",
}


def _accounting(book: str, p: str) -> dict[str, str]:
    """Parts turning the weight table ``book`` into monthly rows at multiple 1."""
    return {
        f"{p}mo": f"""
            SELECT model, scheme, yyyymm, sum(weight * coalesce(ret_next, 0)) AS gross,
                   sum(coalesce(carry_cost, 0) * abs(weight)) AS carrying,
                   sum(CASE WHEN weight < 0 THEN -weight ELSE 0 END) * 1e-2 / 12 AS borrow,
                   count(*) AS n,
                   row_number() OVER (PARTITION BY model, scheme ORDER BY yyyymm) AS o
            FROM {book} GROUP BY model, scheme, yyyymm""",
        f"{p}held": f"""
            SELECT b.model, b.scheme, b.signalname, m.o, b.weight,
                   b.weight * (1 + coalesce(b.ret_next, 0)) / (1 + m.gross) AS drifted
            FROM {book} b JOIN {p}mo m USING (model, scheme, yyyymm)""",
        f"{p}trade": f"""
            SELECT model, scheme, o, sum(abs(coalesce(a.weight, 0) - coalesce(b.drifted, 0))) AS turnover
            FROM {p}held a FULL JOIN (SELECT model, scheme, signalname, o + 1 AS o, drifted FROM {p}held) b
                 USING (model, scheme, signalname, o) GROUP BY ALL""",
        f"{p}base": f"""
            SELECT m.model, m.scheme, m.yyyymm AS formation_yyyymm,
                   CAST(CASE WHEN m.yyyymm % 100 = 12 THEN m.yyyymm + 89 ELSE m.yyyymm + 1 END
                        AS INTEGER) AS yyyymm, gross, turnover, turnover * 5e-3 AS switching,
                   carrying, borrow, n FROM {p}mo m JOIN {p}trade t USING (model, scheme, o)""",
        f"{p}netted": f"""
            SELECT b.* EXCLUDE (switching, carrying), x AS cost_mult, switching * x AS switching,
                   carrying * x AS carrying, (switching + carrying) * x + borrow AS cost,
                   gross - ((switching + carrying) * x + borrow) AS net
            FROM {p}base b, unnest([0e0, 5e-1, 1e0, 2e0, 3e0, 4e0]) AS t(x)""",
        f"{p}sd": f"""
            SELECT *, CASE WHEN count(net) OVER w >= 12 THEN stddev_samp(net) OVER w END AS sd
            FROM {p}netted WINDOW w AS (PARTITION BY model, scheme, cost_mult ORDER BY yyyymm
                                        ROWS BETWEEN 36 PRECEDING AND 1 PRECEDING)""",
        f"{p}swept": f"""
            SELECT * EXCLUDE (gross, cost, net, turnover, switching, carrying, lev), lev AS leverage,
                   gross * lev AS gross, cost * lev AS cost, net * lev AS net,
                   turnover * lev AS turnover, switching * lev AS switching, carrying * lev AS carrying
            FROM (SELECT *, CASE WHEN sd IS NULL THEN 1e0 WHEN sd = 0 THEN 3e0
                                 ELSE least(1e-1 / (sd * sqrt(12e0)), 3e0) END AS lev FROM {p}sd)""",
        f"{p}monthly": f"SELECT * FROM {p}swept WHERE cost_mult = 1",
    }


PARTS |= _accounting("book", "")


def t_stat(table: str, keys: str, value: str) -> str:
    """Newey-West t of the mean of ``value`` per ``keys``, by an explicit lag join."""
    k = keys.split(", ")
    same = " AND ".join(f"a.{c} = b.{c}" for c in k)
    a_keys = ", ".join(f"a.{c}" for c in k)
    rows = f"""
        SELECT {keys}, v - avg(v) OVER (PARTITION BY {keys}) AS e,
               avg(v) OVER (PARTITION BY {keys}) AS m, count(*) OVER (PARTITION BY {keys}) AS n,
               row_number() OVER (PARTITION BY {keys} ORDER BY yyyymm) AS o
        FROM (SELECT {keys}, yyyymm, {value} AS v FROM {table}) WHERE v IS NOT NULL"""
    lags = "floor(4 * pow(a.n / 1e2, 2e0 / 9))"
    return f"""
        SELECT {a_keys}, CASE WHEN max(a.n) >= 3 THEN max(a.m) / sqrt(greatest(sum(
                   CASE WHEN a.o = b.o THEN a.e * b.e
                        ELSE 2 * (1 - (a.o - b.o) / ({lags} + 1)) * a.e * b.e END) / max(a.n), 1e-18)
                   / max(a.n)) END AS t
        FROM ({rows}) a JOIN ({rows}) b ON {same} AND b.o <= a.o AND a.o - b.o <= {lags}
        GROUP BY {a_keys}"""


def performance(table: str, keys: str) -> str:
    on = f"USING ({keys})"
    return f"""
        SELECT {keys}, n_months, ret_gross, ret_net, vol, sharpe_gross, sharpe_net,
               CASE WHEN n_months >= 12 AND sd > 0 THEN sqrt(greatest((1 + 5e-1 * sr * sr - skew * sr
                    + ku / 4 * sr * sr) / n_months, 0) * 12) END AS sharpe_net_se,
               t AS t_net, max_dd, skew, turnover, cost_drag, hit_rate, breakeven_bps
        FROM (SELECT {keys}, count(net) AS n_months, avg(gross) * 12 AS ret_gross,
                     avg(net) * 12 AS ret_net, stddev_samp(net) * sqrt(12e0) AS vol,
                     stddev_samp(net) AS sd, avg(net) / stddev_samp(net) AS sr,
                     avg(gross) / stddev_samp(gross) * sqrt(12e0) AS sharpe_gross,
                     avg(net) / stddev_samp(net) * sqrt(12e0) AS sharpe_net,
                     kurtosis_pop(net) AS ku, avg(turnover) AS turnover, avg(cost) * 12 AS cost_drag,
                     avg(CASE WHEN net > 0 THEN 1e0 ELSE 0 END) AS hit_rate,
                     CASE WHEN avg(turnover) > 0 THEN avg(gross) / avg(turnover) * 1e4 END AS breakeven_bps
              FROM {table} GROUP BY {keys})
        JOIN ({t_stat(table, keys, 'net')}) {on}
        JOIN (SELECT {keys}, min(dd) AS max_dd FROM ({drawdowns(table, keys)}) GROUP BY {keys}) {on}
        JOIN (SELECT {keys}, avg(pow(net - m, 3)) / pow(avg(pow(net - m, 2)), 1.5e0) AS skew
              FROM (SELECT {keys}, net, avg(net) OVER (PARTITION BY {keys}) AS m FROM {table})
              GROUP BY {keys}) {on}"""


def drawdowns(table: str, keys: str) -> str:
    upto = f"(PARTITION BY {keys} ORDER BY yyyymm ROWS UNBOUNDED PRECEDING)"
    return f"""
        SELECT *, equity / max(equity) OVER {upto} - 1 AS dd
        FROM (SELECT *, product(1 + net) OVER {upto} AS equity FROM {table})"""


def statement(select: str, extra: dict[str, str] | None = None) -> str:
    """``select`` with every named part it needs, in dependency order."""
    parts = PARTS | (extra or {})
    order: list[str] = []

    def need(sql: str) -> None:
        for name in parts:
            if re.search(rf"\b{name}\b", sql) and name not in order:
                if re.search(rf"\b(FROM|JOIN|,)\s+{name}\b|\bFROM\s+\(?\s*{name}\b", sql):
                    need(parts[name])
                    if name not in order:
                        order.append(name)

    need(select)
    if not order:
        return select
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({parts[n]})" for n in order)
    return f"WITH {ctes}\n{select}"
