"""Registered queries of the learners: the whole slate against SQL, trees, objectives' gradients.

The SQL side solves every model on its own terms: elimination, rotations, coordinate
descent and reweighting as recursive statements over the moments or the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.operators import boosting, learners, objectives, transforms, universe
from panelyard.operators.boosting import Boosting
from panelyard.operators.objective_fit import linear_gradients, training_rows
from panelyard.plans.catalog import (_FOLD_PARTS, _OBJ_PARTS, _folds, _unit_rank_sql, SETTINGS,
                                     objective_rows, out, panel_stage, query, stage)
from panelyard.plans.oracle import r
from panelyard.plans.walk_forward import run_walk_forward

SLATE = ("r_1", "r_3", "r_12", "r_12_2", "vol_12", "beta_idx", "corr_idx")
K = len(SLATE)
SCALE = 10.0        # of the target, so that rounded results keep their figures


def slate_panel(spark, sf_dir) -> DataFrame:
    """Seven ranked features and the scaled target."""
    def build():
        df = panel_stage(spark, sf_dir).select(
            "signalname", "yyyymm", "ret_next", (F.col("ret_next_dm") * SCALE).alias("ret_next_dm"),
            *[F.round(c, 10).alias(c) for c in SLATE])
        return transforms.rank_normalise(df, list(SLATE))
    return stage(spark, sf_dir, "slate", build)


def feature_panel(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    """Every feature of the panel, flagged and ranked."""
    names: list[str] = []

    def build():
        panel = panel_stage(spark, sf_dir)
        return transforms.build_features(panel, list(universe.feature_columns(panel)))[0]
    df = stage(spark, sf_dir, "all-features", build)
    raw = set(universe.feature_columns(panel_stage(spark, sf_dir)))
    names = [c for c in df.columns if c in raw or c.endswith("_isna")]
    return df, sorted(names)


# ------------------------------------------------------------------ SQL parts
def _dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


_EYE = "[" + ", ".join("[" + ", ".join("1e0" if i == j else "0e0" for j in range(K)) + "]"
                       for i in range(K)) + "]"
_X = "[" + ", ".join(f"x{i}" for i in range(K)) + "]"
_PAIRS = [(p, q) for p in range(1, K + 1) for q in range(p + 1, K + 1)]
_TURNS = 12 * len(_PAIRS)
_SLATE_PARTS = _FOLD_PARTS | {
    "slin": "SELECT signalname, yyyymm, ret_next_dm, " + ", ".join(
        f"round({c}, 10) AS {c}" for c in SLATE) + " FROM panel",
    "slx": f"SELECT signalname, yyyymm, ret_next_dm * {SCALE:g} AS y, " + ", ".join(
        f"CAST({_unit_rank_sql(c).rpartition('>')[0]} AS DOUBLE) AS x{i}" for i, c in enumerate(SLATE))
        + " FROM slin",
    "sl": f"SELECT fold, role, yyyymm, signalname, y, {_X} AS x, slx.* EXCLUDE (yyyymm, signalname, y) "
          "FROM slx JOIN folds USING (yyyymm)",
    "slm": "SELECT fold, count(*) AS n, avg(y) AS my, [" + ", ".join(f"avg(x{i})" for i in range(K))
           + "] AS mx, [" + ", ".join("[" + ", ".join(
               f"covar_pop(x{i}, x{j}) * count(*)" for j in range(K)) + "]" for i in range(K))
           + "] AS c, [" + ", ".join(f"covar_pop(x{i}, y) * count(*)" for i in range(K))
           + "] AS b FROM sl WHERE role = 'train' GROUP BY fold",
    # Systems (c + a I | b), solved by elimination, one pivot a step.
    "slsys": f"""
        SELECT fold, model, param, list_transform(range(1, {K + 1}), lambda i: list_concat(
                   list_transform(range(1, {K + 1}), lambda j: c[i][j] + CASE WHEN i = j THEN a ELSE 0 END
                                  + u * n * mx[i] * mx[j]), [b[i] + u * n * mx[i] * my])) AS m
        FROM slm, (VALUES ('ols', '', 0e0, 0), ('ridge', '10', 1e1, 0), ('ridge', '100', 1e2, 0),
                          ('ridge', '1000', 1e3, 0), ('ridge', '10000', 1e4, 0), ('ridge', '100000', 1e5, 0),
                          ('lin_mse', '', 0e0, 1))
             AS t(model, param, a, u)""",
    "slgone": f"""
        SELECT * FROM (WITH RECURSIVE e AS (
            SELECT fold, model, param, 1 AS p, m FROM slsys
            UNION ALL
            SELECT fold, model, param, p + 1, list_transform(m, lambda row, i:
                       CASE WHEN i = p THEN list_transform(row, lambda v: v / row[p])
                       ELSE list_transform(row, lambda v, j: v - row[p] * m[p][j] / m[p][p]) END)
            FROM e WHERE p <= {K})
        SELECT * FROM e WHERE p = {K + 1})""",
    "slgrid": "SELECT a, l FROM unnest([1e-5, 1e-4, 1e-3]) AS t(a), unnest([1e-1, 5e-1, 9e-1]) AS u(l)",
    "slnet": f"""
        SELECT * FROM (WITH RECURSIVE d AS (
            SELECT fold, a, l, 0 AS i, list_transform(range({K}), lambda k: 0e0) AS w FROM slm, slgrid
            UNION ALL
            SELECT fold, a, l, i + 1, list_transform(w, lambda v, k: CASE WHEN k <> j THEN v ELSE
                       sign(pull) * greatest(abs(pull) - a * l, 0) / (c[j][j] / n + a * (1 - l)) END)
            FROM (SELECT d.*, n, c, 1 + i % {K} AS j,
                         (b[1 + i % {K}] - {_dot(f'c[1 + i % {K}]', 'w')} + c[1 + i % {K}][1 + i % {K}]
                          * w[1 + i % {K}]) / n AS pull
                  FROM d JOIN slm USING (fold) WHERE i < {K * 600}))
        SELECT * FROM d WHERE i = {K * 600})""",
    # Rotations make the products diagonal; what is left on the diagonal are the component sizes.
    "slturn": "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, {p}, {q})" for i, (p, q) in enumerate(_PAIRS)) + ") AS t(i, p, q)",
    "slspun": f"""
        SELECT * FROM (WITH RECURSIVE j AS (
            SELECT fold, 0 AS s, c AS a, {_EYE} AS v FROM slm
            UNION ALL
            SELECT fold, s + 1, list_transform(half, lambda row, i:
                       CASE WHEN i = p THEN list_transform(row, lambda z, k: co * z - si * half[q][k])
                            WHEN i = q THEN list_transform(row, lambda z, k: si * half[p][k] + co * z)
                            ELSE row END),
                   list_transform(v, lambda row: list_transform(row, lambda z, k:
                       CASE WHEN k = p THEN co * z - si * row[q] WHEN k = q THEN si * row[p] + co * z ELSE z END))
            FROM (SELECT *, list_transform(a, lambda row: list_transform(row, lambda z, k:
                       CASE WHEN k = p THEN co * z - si * row[q] WHEN k = q THEN si * row[p] + co * z
                            ELSE z END)) AS half
                  FROM (SELECT *, 1 / sqrt(1 + t * t) AS co, t / sqrt(1 + t * t) AS si
                        FROM (SELECT j.*, p, q, CASE WHEN abs(a[p][q]) < 1e-14 THEN 0e0 ELSE
                                     (CASE WHEN a[q][q] >= a[p][p] THEN 1e0 ELSE -1e0 END)
                                     / (abs((a[q][q] - a[p][p]) / (2 * a[p][q]))
                                        + sqrt(1 + pow((a[q][q] - a[p][p]) / (2 * a[p][q]), 2)))
                                     * sign(a[p][q]) END AS t
                              FROM j JOIN slturn ON slturn.i = j.s % {len(_PAIRS)} WHERE s < {_TURNS}))))
        SELECT * FROM j WHERE s = {_TURNS})""",
    "slaxis": f"""
        SELECT fold, k, w, size, row_number() OVER (PARTITION BY fold ORDER BY size DESC) AS o
        FROM (SELECT fold, k, a[k][k] AS size, list_transform(v, lambda row: row[k]) AS w
              FROM slspun, unnest(range(1, {K + 1})) AS t(k))""",
    "slpcr": f"""
        SELECT fold, 'pcr' AS model, m::varchar AS param, list_transform(range(1, {K + 1}), lambda d:
                   list_sum(list_transform(list(struct_pack(w := w, g := g)), lambda e: e.w[d] * e.g))) AS beta
        FROM (SELECT fold, o, w, {_dot('w', 'b')} / size AS g FROM slaxis JOIN slm USING (fold))
             JOIN (SELECT unnest([3, 5, {K}]) AS m) ON o <= m GROUP BY fold, m""",
    "slpls0": f"""
        SELECT * FROM (WITH RECURSIVE s AS (
            SELECT fold, 0 AS k, c, b, list_transform(range({K}), lambda d: 0e0) AS beta,
                   [list_transform(range({K}), lambda d: 0e0)] AS ps, [list_transform(range({K}), lambda d: 0e0)] AS rs
            FROM slm
            UNION ALL
            SELECT fold, k + 1, list_transform(c, lambda row, i: list_transform(row, lambda z, j:
                       z - tt * p[i] * p[j])),
                   list_transform(b, lambda z, i: z - p[i] * q * tt),
                   list_transform(beta, lambda z, i: z + q * r[i]), list_append(ps, p), list_append(rs, r)
            FROM (SELECT *, {_dot('b', 'w')} / tt AS q, list_transform(cw, lambda z: z / tt) AS p,
                         list_transform(w, lambda z, d: z - list_sum(list_transform(ps, lambda e, i:
                             {_dot('e', 'w')} * rs[i][d]))) AS r
                  FROM (SELECT *, {_dot('w', 'cw')} AS tt
                        FROM (SELECT *, list_transform(c, lambda row: {_dot('row', 'w')}) AS cw
                              FROM (SELECT *, list_transform(b, lambda z: z / sqrt({_dot('b', 'b')})) AS w
                                    FROM s WHERE k < {K})))))
        SELECT * FROM s WHERE k IN (1, 2, 3, 5, {K}))""",
    "slinv": f"""
        SELECT * FROM (WITH RECURSIVE e AS (
            SELECT fold, 1 AS p, list_transform(range(1, {K + 1}), lambda i: list_concat(c[i], {_EYE}[i])) AS m
            FROM slm
            UNION ALL
            SELECT fold, p + 1, list_transform(m, lambda row, i:
                       CASE WHEN i = p THEN list_transform(row, lambda v: v / row[p])
                       ELSE list_transform(row, lambda v, j: v - row[p] * m[p][j] / m[p][p]) END)
            FROM e WHERE p <= {K})
        SELECT fold, list_transform(m, lambda row: row[{K + 1}:{2 * K}]) AS inv FROM e WHERE p = {K + 1})""",
    # Robust fit: residuals clipped at 1.35 scales, put through the plain regression, again and again.
    "slhub": f"""
        SELECT * FROM (WITH RECURSIVE h AS (
            SELECT fold, 0 AS i, my AS b0, list_transform(range({K}), lambda d: 0e0) AS w,
                   (SELECT stddev_pop(y) FROM sl WHERE sl.fold = slm.fold AND role = 'train') AS sg FROM slm
            UNION ALL
            SELECT fold, i + 1, b0 + step0, list_transform(w, lambda z, d: z + {_dot('inv[d]', 'g')}),
                   sqrt(lost / (n - far * 1.35 * 1.35))
            FROM (SELECT t.*, inv, n, psi / n - {_dot('mx', "list_transform(inv, lambda row: " + _dot('row', 'g') + ")")}
                             AS step0
                  FROM (SELECT fold, any_value(i) AS i, any_value(b0) AS b0, any_value(w) AS w, sum(p) AS psi,
                               sum(CASE WHEN abs(e) <= 1.35 * sg THEN e * e ELSE 0 END) AS lost,
                               count(CASE WHEN abs(e) > 1.35 * sg THEN 1 END) AS far, any_value(n) AS n0,
                               [{", ".join(f"sum(p * (x[{d}] - mx[{d}])) - 1e-4 * any_value(sg) * any_value(w[{d}])"
                                            for d in range(1, K + 1))}] AS g
                        FROM (SELECT h.*, sl.x, slm.mx, slm.n, y - b0 - {_dot('w', 'sl.x')} AS e,
                                     greatest(least(y - b0 - {_dot('w', 'sl.x')}, 1.35 * sg), -1.35 * sg) AS p
                              FROM h JOIN sl USING (fold) JOIN slm USING (fold) WHERE role = 'train' AND i < 250)
                        GROUP BY fold) t JOIN slinv USING (fold) JOIN slm USING (fold)))
        SELECT * FROM h WHERE i = 250)""",
    "slcand": f"""
        SELECT fold, model, param, list_transform(m, lambda row: row[{K + 1}]) AS beta FROM slgone
        WHERE model <> 'lin_mse'
        UNION ALL SELECT fold, 'enet', a || '-' || l, w FROM slnet
        UNION ALL SELECT fold, model, param, beta FROM slpcr
        UNION ALL SELECT fold, 'pls', k::varchar, beta FROM slpls0""",
    "sltried": f"""
        SELECT c.*, my - {_dot('beta', 'mx')} AS b0, (
                   SELECT avg(pow(y - (my - {_dot('beta', 'mx')}) - {_dot('beta', 'sl.x')}, 2)) FROM sl
                   WHERE sl.fold = c.fold AND role = 'val') AS mse
        FROM slcand c JOIN slm USING (fold)""",
    "slfits": """
        SELECT fold, model, b0, beta FROM (SELECT * FROM sltried
            QUALIFY row_number() OVER (PARTITION BY fold, model ORDER BY mse) = 1)
        UNION ALL SELECT fold, 'ols_h', b0, w FROM slhub
        UNION ALL SELECT fold, 'mean', 0e0, list_transform(mx, lambda z: 0e0) FROM slm""",
}
MODELS = ("mean", "ols", "ols_h", "ridge", "enet", "pcr", "pls")
_SPECS = [learners.ModelSpec(m) for m in MODELS]


@query("slate_fits", "SELECT fold, model, " + r("b0>intercept", *[
    f"beta[{i + 1}]>b_{c}" for i, c in enumerate(SLATE)], digits=5) + " FROM slfits", _SLATE_PARTS)
def slate_fits(spark, sf_dir):
    """Coefficients of every linear model of the slate on every fold."""
    _, fits, _ = run_walk_forward(slate_panel(spark, sf_dir), list(SLATE), SETTINGS, _SPECS)
    flat = fits.withColumns({f"b_{c}": F.get("beta", i) for i, c in enumerate(SLATE)})
    return out(flat, "fold", "model", "intercept", *[f"b_{c}" for c in SLATE], digits=5)


@query("slate_predictions", f"""
    SELECT signalname, yyyymm, fold, model, {r(f'CAST(b0 + {_dot("beta", "x")} AS FLOAT)>score', digits=5)}
    FROM sl JOIN slfits USING (fold) WHERE role = 'test'""", _SLATE_PARTS)
def slate_predictions(spark, sf_dir):
    preds, _, _ = run_walk_forward(slate_panel(spark, sf_dir), list(SLATE), SETTINGS, _SPECS)
    return out(preds, "signalname", "yyyymm", "fold", "model", "score", digits=5)


@query("fit_timings", "SELECT DISTINCT fold, m.model, true AS timed FROM folds CROSS JOIN (SELECT unnest(["
       + ", ".join(f"'{m}'" for m in MODELS) + "]) AS model) m", _FOLD_PARTS)
def fit_timings(spark, sf_dir):
    """The log of fits: one row per fold and model, with the seconds each took."""
    _, _, took = run_walk_forward(slate_panel(spark, sf_dir), list(SLATE), SETTINGS, _SPECS)
    return took.select("fold", "model", (F.col("seconds") >= 0).alias("timed"))


@query("walk_forward_all_baselines")
def walk_forward_all_baselines(spark, sf_dir):
    """Every linear model on every fold and feature."""
    panel, names = feature_panel(spark, sf_dir)
    specs = [*_SPECS, learners.ModelSpec("lin_mse", "linear", loss="mse")]
    preds, _, _ = run_walk_forward(panel, names, SETTINGS, specs)
    return out(preds, "signalname", "yyyymm", "fold", "model", "score")


@query("huber_optimality", "SELECT DISTINCT fold, true AS met, true AS within_passes FROM folds", _FOLD_PARTS)
def huber_optimality(spark, sf_dir):
    """Whether each fold's robust fit on all features meets its first-order condition to 1e-3."""
    panel, names = feature_panel(spark, sf_dir)
    months: dict[str, dict[str, list[int]]] = {}
    for row in _folds(spark, sf_dir).collect():  # calendar-bounded
        months.setdefault(row["fold"], {}).setdefault(row["role"], []).append(row["yyyymm"])
    train = {f: m["train"] for f, m in months.items()}
    blocks = learners.month_blocks(months)
    design = learners.design(panel, names, blocks)
    sums = learners.block_moments(panel, names, blocks, rows=design)
    fits = learners.robust_fits(design, train, {f: learners.pool(sums, blocks, m) for f, m in train.items()})
    rows = [(f, fit.residual < 1e-3, fit.passes < 20) for f, fit in fits.items()]
    return spark.createDataFrame(rows, "fold string, met boolean, within_passes boolean")


# ----------------------------------------------------------------------- trees
TREES = Boosting(rounds=4, patience=4, rate=0.3, depth=2, delta=0.2, min_rows=40, row_share=1.0,
                 column_share=1.0, bins=8)
_EDGES = [-1 + 2 * i / TREES.bins for i in range(1, TREES.bins)]


def _tree_parts() -> dict[str, str]:
    """Trees one level at a time, from sums over all rows of a node."""
    one = float(1 << 30)
    bins = ", ".join("(" + " + ".join(f"(x{i} > {e!r})::int" for e in _EDGES) + f") AS b{i}"
                     for i in range(K))
    parts = {"tr0": f"""
        SELECT fold, role, signalname, yyyymm, y, {bins},
               (sum(CASE WHEN role = 'train' THEN round(y * {one})::bigint END) OVER f)::double / {one}
                   / count(CASE WHEN role = 'train' THEN 1 END) OVER f AS f0
        FROM sl WINDOW f AS (PARTITION BY fold)"""}
    worth = "pow({g} / " + repr(one) + ", 2) / ({n} + 1e0)"
    for t in range(TREES.rounds):
        parts[f"tn{t}l0"] = (f"SELECT *, round(greatest(least(y - f{t}, {TREES.delta!r}), {-TREES.delta!r})"
                             f" * {one})::bigint AS e{t}, 0 AS n{t} FROM tr{t}")
        for lev in range(TREES.depth):
            rows, lo, hi = f"tn{t}l{lev}", 2 ** lev - 1, 2 ** (lev + 1) - 2
            each = " UNION ALL ".join(
                f"SELECT fold, n{t} AS node, {i} AS feature, b{i} AS bin, e{t} AS e FROM {rows} "
                f"WHERE role = 'train' AND n{t} BETWEEN {lo} AND {hi}" for i in range(K))
            parts[f"th{t}l{lev}"] = (f"SELECT fold, node, feature, bin, sum(e)::double AS g, count(*) AS n "
                                     f"FROM ({each}) GROUP BY ALL")
            left = "(PARTITION BY fold, node, feature ORDER BY bin)"
            whole = "(PARTITION BY fold, node, feature)"
            parts[f"ts{t}l{lev}"] = f"""
                SELECT fold, node, feature, bin, gain FROM (
                    SELECT *, {worth.format(g='gl', n='nl')} + {worth.format(g='(gt - gl)', n='(nt - nl)')}
                              - {worth.format(g='gt', n='nt')} AS gain
                    FROM (SELECT *, sum(g) OVER {left} AS gl, sum(n) OVER {left} AS nl,
                                 sum(g) OVER {whole} AS gt, sum(n) OVER {whole} AS nt FROM th{t}l{lev}))
                WHERE nl >= {TREES.min_rows} AND nt - nl >= {TREES.min_rows} AND gain > 0
                QUALIFY row_number() OVER (PARTITION BY fold, node ORDER BY gain DESC, feature, bin) = 1"""
            value = "[" + ", ".join(f"b{i}" for i in range(K)) + "][s.feature + 1]"
            parts[f"tn{t}l{lev + 1}"] = f"""
                SELECT r.* EXCLUDE (n{t}), CASE WHEN s.node IS NULL THEN r.n{t} ELSE
                       2 * r.n{t} + 1 + ({value} > s.bin)::int END AS n{t}
                FROM {rows} r LEFT JOIN ts{t}l{lev} s ON s.fold = r.fold AND s.node = r.n{t}"""
        parts[f"tr{t + 1}"] = f"""
            SELECT r.* EXCLUDE (n{t}), f{t} + v AS f{t + 1}
            FROM tn{t}l{TREES.depth} r JOIN (
                SELECT fold, n{t}, {TREES.rate!r} * (sum(e{t})::double / {one}) / (count(*) + 1e0) AS v
                FROM tn{t}l{TREES.depth} WHERE role = 'train' GROUP BY fold, n{t}) USING (fold, n{t})"""
    last = TREES.rounds
    errors = " UNION ALL ".join(
        f"SELECT fold, {t} AS t, avg(pow(y - f{t}, 2)) AS mse FROM tr{last} WHERE role = 'val' GROUP BY fold"
        for t in range(1, last + 1))
    parts["tbest"] = (f"SELECT fold, t FROM ({errors}) "
                      "QUALIFY row_number() OVER (PARTITION BY fold ORDER BY mse, t) = 1")
    parts["tgains"] = " UNION ALL ".join(
        f"SELECT fold, {t} AS tree, feature, gain FROM ts{t}l{lev}"
        for t in range(last) for lev in range(TREES.depth))
    return parts


_TREE_PARTS = _SLATE_PARTS | _tree_parts()


def _small_forests(spark, sf_dir):
    panel = slate_panel(spark, sf_dir)
    found = _folds(spark, sf_dir)
    months: dict[str, dict[str, list[int]]] = {}
    for row in found.collect():  # calendar-bounded
        months.setdefault(row["fold"], {}).setdefault(row["role"], []).append(row["yyyymm"])
    rows, forests = boosting.fit_forests(panel, list(SLATE), months, TREES,
                                         edges={c: _EDGES for c in SLATE})
    return rows, forests, found.where("role = 'test'")


@query("boosted_trees", "SELECT fold, signalname, yyyymm, " + r(
    "[" + ", ".join(f"f{t}" for t in range(1, TREES.rounds + 1)) + "][t]>score", digits=7)
    + f" FROM tr{TREES.rounds} JOIN tbest USING (fold) WHERE role = 'test'", _TREE_PARTS)
def boosted_trees(spark, sf_dir):
    """Four trees of depth two with a Huber loss on every fold, the prefix that validates best."""
    rows, forests, tests = _small_forests(spark, sf_dir)
    scored = boosting.score_forests(rows, forests, tests, TREES.depth)
    return out(scored, "fold", "signalname", "yyyymm", "score", digits=7)


_NAMES = "[" + ", ".join(f"'{c}'" for c in SLATE) + "]"


@query("feature_importance", f"""
    SELECT fold, feature, place, n_splits, {r('share', digits=7)} FROM (
        SELECT fold, {_NAMES}[feature + 1] AS feature, count(*) AS n_splits,
               sum(gain) / sum(sum(gain)) OVER (PARTITION BY fold) AS share,
               CAST(row_number() OVER (PARTITION BY fold ORDER BY sum(gain) DESC, {_NAMES}[feature + 1])
                    AS INTEGER) AS place
        FROM tgains JOIN tbest USING (fold) WHERE tree < t GROUP BY fold, feature) WHERE place <= 3""",
       _TREE_PARTS)
def feature_importance(spark, sf_dir):
    """The three features of each fold whose splits gain most."""
    _, forests, _ = _small_forests(spark, sf_dir)
    top = boosting.importance(boosting.splits(spark, forests, list(SLATE)), 3)
    return out(top, "fold", "feature", "place", "n_splits", "share", digits=7)


_DEFAULT_SQL = f"""
    SELECT fold, signalname, yyyymm, model, {_dot('beta', 'x')} + b0 AS score FROM sl JOIN (
        SELECT fold, model, b0, beta FROM slfits WHERE model IN ('ols_h', 'ridge', 'enet', 'pls')
        UNION ALL SELECT fold, model, 0e0, list_transform(m, lambda row: row[{K + 1}]) FROM slgone
        WHERE model = 'lin_mse') USING (fold) WHERE role = 'test'
    UNION ALL
    SELECT fold, signalname, yyyymm, 'gbrt', [{", ".join(f"f{t}" for t in range(1, TREES.rounds + 1))}][t]
    FROM tr{TREES.rounds} JOIN tbest USING (fold) WHERE role = 'test'"""


@query("default_slate", f"SELECT fold, signalname, yyyymm, model, {r('score', digits=5)} FROM ({_DEFAULT_SQL})",
       _TREE_PARTS)
def default_slate(spark, sf_dir):
    """Every model of the default comparison on every fold, the trees few and shallow."""
    preds, _, _ = run_walk_forward(slate_panel(spark, sf_dir), list(SLATE), SETTINGS, learners.DEFAULT_SPECS,
                                   boosting=TREES, edges={c: _EDGES for c in SLATE})
    return out(preds, "fold", "signalname", "yyyymm", "model", "score", digits=5)


@query("walk_forward_gbrt")
def walk_forward_gbrt(spark, sf_dir):
    """Boosted trees on every fold and feature, up to 2000 rounds with patience."""
    panel, names = feature_panel(spark, sf_dir)
    preds, _, _ = run_walk_forward(panel, names, SETTINGS, [learners.ModelSpec("gbrt")])
    return out(preds, "signalname", "yyyymm", "fold", "model", "score")


# ------------------------------------------------------------------ objectives
PENALTY = 0.01
_REWARD = {
    "sharpe": "-sqrt(12e0) * (1e0 / months / greatest(sd, 1e-8) - CASE WHEN sd > 1e-8 THEN "
              "mean * (net - mean) / (sd * sd * sd * (months - 1)) ELSE 0 END)",
    "utility": "-(1e0 / months - 10 * (net - mean) / (months - 1))",
}


def slope_parts(p: str, rows: str, penalty: float) -> dict[str, str]:
    """Derivatives of both portfolio losses to every score, by scheme: month by month from the
    weights' moves, a weight's part in next month's starting point included.

    ``rows`` names a part with (model, win, pos, signalname, score, y, carry, sw, n, mean).
    """
    cell = "model, win, pos, scheme"
    parts = {
        f"{p}dev": f"""
            SELECT r.*, scheme, score - mean AS dev, CASE WHEN scheme = 'tilt' THEN 1e0 ELSE 2e0 END AS size,
                   greatest(sum(abs(score - mean)) OVER (PARTITION BY {cell}), 1e-8) AS l1
            FROM {rows} r, (SELECT unnest(['tilt', 'neutral']) AS scheme)""",
        f"{p}w": f"SELECT *, CASE WHEN scheme = 'tilt' THEN 1e0 / n ELSE 0 END + size * dev / l1 AS w FROM {p}dev",
        f"{p}nav": f"""
            SELECT *, greatest(earned, 1e-1) AS nav, earned > 1e-1 AS live
            FROM (SELECT *, 1 + sum(w * y) OVER (PARTITION BY {cell}) AS earned FROM {p}w)""",
        f"{p}held": f"""
            SELECT a.*, coalesce(b.w * (1 + b.y) / b.nav, 0) AS prior FROM {p}nav a LEFT JOIN {p}nav b
            ON b.model = a.model AND b.win = a.win AND b.scheme = a.scheme AND b.signalname = a.signalname
               AND b.pos = a.pos - 1""",
        f"{p}net": f"""
            SELECT {cell}, sum(w * y - (sw + {penalty!r}) * (sqrt(pow(w - prior, 2) + 1e-8) - 1e-4)
                               - carry * abs(w)) AS net FROM {p}held GROUP BY {cell}""",
        f"{p}pull": " UNION ALL ".join(f"""
            SELECT {cell}, '{name}' AS objective, {how} AS g
            FROM (SELECT *, count(*) OVER v AS months, avg(net) OVER v AS mean, stddev_samp(net) OVER v AS sd
                  FROM {p}net WINDOW v AS (PARTITION BY model, win, scheme))"""
                                       for name, how in _REWARD.items()),
        f"{p}pay": f"""
            SELECT h.*, objective, g, g * (sw + {penalty!r}) * (w - prior) / sqrt(pow(w - prior, 2) + 1e-8) AS pay
            FROM {p}held h JOIN {p}pull USING ({cell})""",
        f"{p}dw": f"""
            SELECT *, g * (y - carry * sign(w)) - pay + later * (1 + y) / nav - CASE WHEN live THEN
                   y * sum(later * w * (1 + y)) OVER (PARTITION BY {cell}, objective) / (nav * nav) ELSE 0 END AS dw
            FROM (SELECT a.*, coalesce(b.pay, 0) AS later FROM {p}pay a LEFT JOIN {p}pay b
                  ON b.model = a.model AND b.win = a.win AND b.scheme = a.scheme AND b.objective = a.objective
                     AND b.signalname = a.signalname AND b.pos = a.pos + 1)""",
        f"{p}slope": f"""
            SELECT *, dd - avg(dd) OVER (PARTITION BY {cell}, objective) AS ds
            FROM (SELECT *, size * (dw / l1 - CASE WHEN l1 > 1e-8 THEN sign(dev) * along / (l1 * l1) ELSE 0 END) AS dd
                  FROM (SELECT *, sum(dw * dev) OVER (PARTITION BY {cell}, objective) AS along FROM {p}dw))""",
    }
    return parts


_SLOPE_PARTS = _OBJ_PARTS | slope_parts("og", "orows", PENALTY)


def _portfolio_slopes(name: str):
    def run(spark, sf_dir):
        rows = objective_rows(spark, sf_dir)
        both = [objectives.score_gradient(rows, name, scheme=s, turnover_penalty=PENALTY).withColumn(
            "scheme", F.lit(s)) for s in ("tilt", "neutral")]
        return out(both[0].unionByName(both[1]), "model", "window", "pos", "signalname", "scheme", "ds",
                   digits=5)
    return run


for _name in _REWARD:
    query(f"objective_gradient_{_name}", f"""
        SELECT model, win AS "window", pos, signalname, scheme, {r('ds', digits=5)}
        FROM ogslope WHERE objective = '{_name}'""", _SLOPE_PARTS)(_portfolio_slopes(_name))


@query("evaluate_objective_penalised", f"""
    SELECT model, scheme, CAST(sum(n_months) AS BIGINT) AS n_months,
           {r('sum(loss * n_months) / sum(n_months)>loss', digits=6)}
    FROM (SELECT model, win, scheme, count(*) AS n_months, -avg(net) / greatest(stddev_samp(net), 1e-8) * sqrt(12e0)
                 AS loss FROM ognet GROUP BY ALL) GROUP BY model, scheme""", _SLOPE_PARTS)
def evaluate_objective_penalised(spark, sf_dir):
    rows = objective_rows(spark, sf_dir)
    both = [objectives.evaluate_objective(rows, "sharpe", scheme=s, turnover_penalty=PENALTY).withColumn(
        "scheme", F.lit(s)) for s in ("tilt", "neutral")]
    return out(both[0].unionByName(both[1]), "model", "scheme", "n_months", "loss", digits=6)


# Coefficient vectors whose gradients are compared: one for reversal, one that mixes signs.
_VECTORS = {"reversal": [-1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0],
            "mixed": [-0.5, 0.25, 0.5, 0.5, -1.0, 0.25, 0.1]}
_LINEAR_PARTS = _SLATE_PARTS | {
    "lwtrain": "SELECT fold, yyyymm, row_number() OVER (PARTITION BY fold ORDER BY yyyymm) AS k, "
               "count(*) OVER (PARTITION BY fold) AS months FROM folds WHERE role = 'train'",
    "lwstart": """
        SELECT DISTINCT fold, s AS win FROM (
            SELECT fold, unnest(list_append(range(0, greatest(max(months) - 24, 0) + 1, 12),
                                            greatest(max(months) - 24, 0))) AS s FROM lwtrain GROUP BY fold)""",
    "lwin": "SELECT fold, win, k - win AS pos, yyyymm FROM lwtrain JOIN lwstart USING (fold) "
            "WHERE k > win AND k <= win + 24",
    "lvec": "SELECT * FROM (VALUES " + ", ".join(f"('{m}', {v})" for m, v in _VECTORS.items())
            + ") AS t(vector, beta)",
    "lrows": f"""
        SELECT *, count(*) OVER m AS n, avg(score) OVER m AS mean
        FROM (SELECT fold || '/' || vector AS model, win, pos, signalname, x, {_dot('beta', 'x')} AS score,
                     slx.ret_next_dm * {SCALE:g} AS y, 25e-4 AS carry, 5e-3 AS sw
              FROM (SELECT *, {_X} AS x, y / {SCALE:g} AS ret_next_dm FROM slx) slx
                   JOIN lwin USING (yyyymm) CROSS JOIN lvec)
        WINDOW m AS (PARTITION BY model, win, pos)""",
} | slope_parts("lg", "lrows", 0.0)


@query("linear_objective_gradient", f"""
    SELECT split_part(model, '/', 1) AS fold, split_part(model, '/', 2) AS model, objective, feature, {r('gradient', digits=5)}
    FROM (SELECT model, objective, {'[' + ', '.join(f"'{c}'" for c in SLATE) + ']'}[i] AS feature,
                 sum(x[i] * ds) / count(DISTINCT win) AS gradient
          FROM lgslope, unnest(range(1, {K + 1})) AS t(i) WHERE scheme = 'tilt' GROUP BY model, objective, i)""",
       _LINEAR_PARTS)
def linear_objective_gradient(spark, sf_dir):
    """Gradients of net Sharpe and utility to linear coefficients, for all folds and vectors at once."""
    rows = training_rows(slate_panel(spark, sf_dir), list(SLATE), _folds(spark, sf_dir), 24)
    vectors = [(f["fold"], m, v) for f in _folds(spark, sf_dir).select("fold").distinct().collect()
               for m, v in _VECTORS.items()]
    table = spark.createDataFrame(vectors, "fold string, model string, beta array<double>")
    return out(linear_gradients(rows, list(SLATE), table, list(_REWARD)), "fold", "model", "objective",
               "feature", "gradient", digits=5)
