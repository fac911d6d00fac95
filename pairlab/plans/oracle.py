"""SQL twins of the registered queries, for DuckDB over the same parquet tables.

Views of the given tables are pre-registered by the checker under their table names. The
stand-in views (FIXTURES.md) are written here once as CTEs and prefixed to each query.
These strings are test oracles only; the library never parses or runs SQL itself.
"""

from __future__ import annotations

# ---------------------------------------------------------------- stand-in views as CTEs
CTE = {
    "emb": """emb AS (SELECT concat('v', CAST(vec_id AS VARCHAR)) AS seq,
                CAST(embedding AS DOUBLE[]) AS embedding, label AS emb_label FROM embeddings)""",
    "pairs": """pairs AS (
  SELECT o_orderkey AS row_id,
         concat('v', CAST((o_orderkey * 7919) % k.nk AS VARCHAR)) AS heavy_seq,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN ''
              ELSE concat('v', CAST((o_orderkey * 104729) % k.nk AS VARCHAR)) END AS light_seq,
         concat('v', CAST(o_custkey % k.nk AS VARCHAR)) AS antigen_seq,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'Spike RBD'
              WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'other' END AS antigen_name,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label
  FROM orders, (SELECT CAST(floor(count(*) * 12 / 10) AS BIGINT) AS nk FROM embeddings) AS k)""",
    "scores": """scores AS (SELECT event_id AS row_id,
         CASE WHEN event_type IN ('click','view') THEN 1 ELSE 0 END AS y,
         round(value / (value + 50.0), 2) AS p FROM events)""",
    "passes": """passes AS (SELECT user_id AS row_id, event_id AS pass, value / (value + 50.0) AS p FROM events)""",
    "results": """results AS (
  SELECT CASE WHEN l_linestatus = 'O' THEN 'rf' ELSE 'mlp_mcdropout' END AS model,
         CASE l_returnflag WHEN 'A' THEN 'random' WHEN 'R' THEN 'uncertainty' ELSE 'hybrid' END AS strategy,
         l_suppkey % 5 AS seed, l_linenumber - 1 AS round, 100 + 96 * (l_linenumber - 1) AS n_labeled,
         avg(1 - l_discount) AS accuracy, avg(1 - l_tax) AS f1, avg(l_quantity / 50.0) AS auprc
  FROM lineitem GROUP BY ALL)""",
    "epochs": """epochs AS (
  SELECT l_linenumber AS epoch, l_suppkey % 4 AS worker, sum(l_extendedprice) AS loss_sum,
         CAST(sum(floor(l_quantity * l_discount * 10)) AS BIGINT) AS correct,
         CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY ALL)""",
    "leaves": """leaves AS (
  SELECT o_orderkey AS row_id, t.tree, (o_orderkey * 7919 + t.tree * o_custkey) % 16 AS leaf
  FROM orders, (SELECT unnest(range(1, 6)) AS tree) AS t)""",
    "seqs": """seqs AS (SELECT doc_id AS row_id, text AS seq FROM documents)""",
    "tokens": """tokens AS (
  SELECT concat('t', CAST(floor(vec_id / 40) AS BIGINT), '_', CAST(label AS VARCHAR)) AS text,
         flatten(list(CAST(embedding AS DOUBLE[]) ORDER BY vec_id)) AS data,
         [count(*), max(len(embedding))]::BIGINT[] AS shape
  FROM embeddings GROUP BY 1)""",
}
# fixed-vector lookups used by several queries
CTE["lenient"] = """lenient AS (
  SELECT p.row_id, p.label, p.heavy_seq, p.light_seq, p.antigen_seq, p.antigen_name,
         h.embedding IS NOT NULL AS heavy_hit, l.embedding IS NOT NULL AS light_hit,
         a.embedding IS NOT NULL AS antigen_hit,
         coalesce(h.embedding, list_transform(range(d.dim), lambda i: 0.0::DOUBLE)) AS h,
         coalesce(l.embedding, list_transform(range(d.dim), lambda i: 0.0::DOUBLE)) AS l,
         coalesce(a.embedding, list_transform(range(d.dim), lambda i: 0.0::DOUBLE)) AS ag
  FROM pairs p
  CROSS JOIN (SELECT max(len(embedding)) AS dim FROM embeddings) d
  LEFT JOIN emb h ON h.seq = NULLIF(p.heavy_seq, '')
  LEFT JOIN emb l ON l.seq = NULLIF(p.light_seq, '')
  LEFT JOIN emb a ON a.seq = NULLIF(p.antigen_seq, '')
  WHERE h.embedding IS NOT NULL OR l.embedding IS NOT NULL OR a.embedding IS NOT NULL)"""
CTE["strict"] = """strict AS (
  SELECT p.row_id, p.label, p.heavy_seq, p.light_seq, p.antigen_seq, p.antigen_name,
         h.embedding AS heavy_emb, l.embedding AS light_emb, a.embedding AS antigen_emb,
         CASE WHEN coalesce(p.light_seq, '') = '' THEN 'empty'
              WHEN l.embedding IS NULL THEN 'missing' ELSE 'hit' END AS light_status
  FROM pairs p JOIN emb h ON h.seq = p.heavy_seq JOIN emb a ON a.seq = p.antigen_seq
  LEFT JOIN emb l ON l.seq = NULLIF(p.light_seq, ''))"""
CTE["interact"] = """interact AS (
  SELECT *, {had} AS hadamard, {ad} AS abs_diff, {cos} AS cosine FROM (
    SELECT *, CASE WHEN {hl} THEN list_transform(list_zip(h, l), lambda z: (z[1] + z[2]) / 2.0) ELSE h END AS ab,
           {hl} AS has_light FROM lenient))"""
CTE["cosine_scores"] = """cosine_scores AS (
  SELECT row_id, label, cosine, p, {ent} AS entropy FROM (
    SELECT row_id, label, cosine, (1.0 + cosine) / 2.0 AS p FROM (
      SELECT row_id, label, {cos} AS cosine FROM (
        SELECT row_id, label, antigen_emb AS ag,
               CASE WHEN coalesce(len(list_filter(light_emb, lambda x: x <> 0)) > 0, false)
                    THEN list_transform(list_zip(heavy_emb, light_emb), lambda z: (z[1] + z[2]) / 2.0)
                    ELSE heavy_emb END AS ab
        FROM strict))))"""

DEPS = {"pairs": [], "emb": [], "lenient": ["emb", "pairs"], "strict": ["emb", "pairs"],
        "interact": ["lenient"], "cosine_scores": ["strict"], "scores": [], "passes": [],
        "results": [], "epochs": [], "leaves": [], "seqs": [], "tokens": []}


# ---------------------------------------------------------------- SQL expression helpers
def vsum(a: str) -> str:
    return f"coalesce(list_sum({a}), CASE WHEN {a} IS NULL THEN NULL ELSE 0.0 END)"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


def norm(a: str) -> str:
    return f"sqrt(list_sum(list_transform({a}, lambda x: x * x)))"


def cos(a: str, b: str) -> str:
    return f"({dot(a, b)} / (({norm(a)} + 1e-10) * ({norm(b)} + 1e-10)))"


def ent(p: str) -> str:
    return f"(-({p} * ln({p} + 1e-10) + (1 - {p}) * ln(1 - {p} + 1e-10)))"


def r6_exact(e: str) -> str:
    """Rounded as a decimal of 12 digits, so that halves of the sixth digit round alike in both engines."""
    return f"CAST(round(CAST({e} AS DECIMAL(38, 12)), 6) AS DOUBLE)"


def r6(x: str) -> str:
    return f"(round(CAST({x} AS DOUBLE), 6) + 0.0)"


def stats(a: str, prefix: str) -> str:
    return (f"CAST(len({a}) AS INTEGER) AS {prefix}_n, {r6(vsum(a))} AS {prefix}_sum, "
            f"{r6(norm(a))} AS {prefix}_norm")


def _fmt(s: str) -> str:
    return s.format(had="list_transform(list_zip(ab, ag), lambda z: z[1] * z[2])",
                    ad="list_transform(list_zip(ab, ag), lambda z: abs(z[1] - z[2]))",
                    cos=cos("ab", "ag"), hl="coalesce(len(list_filter(l, lambda x: x <> 0)) > 0, false)",
                    ent=ent("p"))


def with_(*names: str) -> str:
    if not names:
        return ""
    order: list[str] = []

    def visit(n):
        for d in DEPS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)
    for n in names:
        visit(n)
    return "WITH " + ",\n".join(_fmt(CTE[n]) for n in order) + "\n"


ORACLE: dict[str, str] = {}


def sql(name: str, *views: str):
    def deco(fn):
        ORACLE[name] = with_(*views) + fn()
        return fn
    return deco


@sql("flagship", "cosine_scores")
def _():
    return (f"SELECT row_id, {r6('cosine')} AS cosine, {r6('p')} AS p, {r6('entropy')} AS entropy "
            "FROM cosine_scores ORDER BY round(entropy, 12) DESC, row_id LIMIT 96")


@sql("lookup_strict", "strict")
def _():
    return (f"SELECT row_id, label, light_status, {r6(vsum('heavy_emb'))} AS heavy_sum, "
            f"{r6(vsum('light_emb'))} AS light_sum, {r6(vsum('antigen_emb'))} AS antigen_sum FROM strict")


@sql("lookup_lenient", "lenient")
def _():
    return (f"SELECT row_id, label, heavy_hit, light_hit, antigen_hit, {r6(vsum('h'))} AS h_sum, "
            f"{r6(vsum('l'))} AS l_sum, {r6(vsum('ag'))} AS ag_sum FROM lenient")


@sql("lookup_coverage", "emb", "pairs")
def _():
    return """SELECT count(*) AS n_rows, count(*) FILTER (WHERE hh OR lh OR ah) AS kept,
       count(*) FILTER (WHERE NOT (hh OR lh OR ah)) AS skipped, count(*) FILTER (WHERE hh) AS heavy_hits,
       count(*) FILTER (WHERE lh) AS light_hits, count(*) FILTER (WHERE ah) AS antigen_hits,
       count(*) FILTER (WHERE hh AND ah) AS strict_kept
FROM (SELECT h.seq IS NOT NULL AS hh, l.seq IS NOT NULL AS lh, a.seq IS NOT NULL AS ah
      FROM pairs p LEFT JOIN emb h ON h.seq = NULLIF(p.heavy_seq, '')
      LEFT JOIN emb l ON l.seq = NULLIF(p.light_seq, '') LEFT JOIN emb a ON a.seq = NULLIF(p.antigen_seq, ''))"""


@sql("broadcast_lookup", "emb", "pairs")
def _():
    return (f"SELECT antigen_name, count(*) AS n, {r6('sum(' + vsum('a.embedding') + ')')} AS emb_sum "
            "FROM pairs p JOIN emb a ON a.seq = p.antigen_seq GROUP BY antigen_name")


@sql("concat_features", "lenient")
def _():
    return f"SELECT row_id, {stats('list_concat(h, l, ag)', 'x')} FROM lenient"


@sql("component_views", "lenient")
def _():
    return f"SELECT row_id, {stats('ag', 'antigen')}, {stats('list_concat(h, l)', 'antibody')} FROM lenient"


@sql("antibody_vector", "interact")
def _():
    return f"SELECT row_id, has_light, {stats('ab', 'ab')} FROM interact"


@sql("hadamard", "interact")
def _():
    return f"SELECT row_id, {stats('hadamard', 'had')} FROM interact"


@sql("abs_diff", "interact")
def _():
    return f"SELECT row_id, {stats('abs_diff', 'ad')} FROM interact"


@sql("cosine_pair", "interact")
def _():
    return f"SELECT row_id, {r6('cosine')} AS cosine FROM interact"


@sql("interaction_features", "interact")
def _():
    return f"SELECT row_id, label, {stats('list_concat(hadamard, abs_diff, [cosine])', 'xi')} FROM interact"


@sql("feature_block", "interact")
def _():
    return f"SELECT row_id, {stats('list_concat(h, l, ag, hadamard, abs_diff, [cosine])', 'xa')} FROM interact"


@sql("salience_norm", "interact")
def _():
    return f"SELECT row_id, {r6(norm('hadamard'))} AS salience FROM interact"


@sql("composite_key", "pairs")
def _():
    return ("SELECT row_id, concat(coalesce(heavy_seq, ''), coalesce(light_seq, ''), "
            "coalesce(antigen_seq, '')) AS pair_key FROM pairs")


@sql("sigmoid_score", "cosine_scores")
def _():
    return (f"SELECT row_id, {r6('4.0 * cosine')} AS logit, {r6('1.0 / (1.0 + exp(-(4.0 * cosine)))')} AS prob "
            "FROM cosine_scores")


@sql("entropy_binary", "cosine_scores")
def _():
    return f"SELECT row_id, {r6('p')} AS p, {r6('entropy')} AS entropy FROM cosine_scores"


@sql("threshold_decision", "scores")
def _():
    return f"SELECT row_id, y, {r6('p')} AS p, CAST(p >= 0.5 AS INTEGER) AS y_hat FROM scores"


@sql("label_masks", "pairs")
def _():
    return ("SELECT label, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS id_sum FROM pairs "
            "WHERE label IN (0, 1) GROUP BY label")


@sql("label_counts", "pairs")
def _():
    return "SELECT label, count(*) AS n FROM pairs GROUP BY label"


@sql("filter_prefix_split", "pairs")
def _():
    return "SELECT row_id, coalesce(starts_with(lower(antigen_name), 'spike'), false) AS is_prefix FROM pairs"


@sql("acquire_entropy", "cosine_scores")
def _():
    return (f"SELECT row_id, {r6('p')} AS p, {r6('entropy')} AS entropy FROM cosine_scores "
            "ORDER BY round(entropy, 12) DESC, row_id LIMIT 96")


@sql("acquire_short_batch", "cosine_scores")
def _():
    return f"SELECT row_id, {r6('entropy')} AS entropy FROM cosine_scores"


@sql("acquire_random", "pairs")
def _():
    return "SELECT row_id, label FROM pairs ORDER BY md5(concat('0:3:', row_id)), row_id LIMIT 96"


@sql("initial_batch", "pairs")
def _():
    return "SELECT row_id, label FROM pairs ORDER BY md5(concat('42:0:', row_id)), row_id LIMIT 1000"


# ---------------------------------------------------------------- sampling and splits
@sql("stratified_split", "pairs")
def _():
    return """SELECT row_id, label, rn <= round(n * 0.2) AS is_test FROM (
  SELECT row_id, label, count(*) OVER (PARTITION BY label) AS n,
         row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', row_id)), row_id) AS rn FROM pairs)"""


@sql("shuffle_split", "pairs")
def _():
    return """SELECT row_id, NOT (rn <= floor(n * 0.8)) AS is_test FROM (
  SELECT row_id, count(*) OVER () AS n,
         row_number() OVER (ORDER BY md5(concat('42:', row_id)), row_id) AS rn FROM pairs)"""


@sql("balanced_seed", "pairs")
def _():
    return """SELECT row_id, label FROM (
  SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('0:seed:', row_id)), row_id) AS rn
  FROM pairs) WHERE rn <= 50"""


@sql("subsample", "pairs")
def _():
    return "SELECT row_id, label FROM pairs ORDER BY md5(concat('42:sub:', row_id)), row_id LIMIT 5000"


# ---------------------------------------------------------------- metrics
CONF = """conf AS (SELECT count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp,
                     count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn, count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn
              FROM scores)"""
RUN = """d AS (SELECT p AS s, sum(y) AS pos, sum(1 - y) AS neg FROM scores GROUP BY p),
run AS (SELECT s, pos, neg, sum(pos) OVER (ORDER BY s DESC) AS ctp, sum(neg) OVER (ORDER BY s DESC) AS cfp,
               sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM d)"""
AP = "sum(pos * ctp / (ctp + cfp)) / P"
AUC = "sum(pos * (N - cfp + 0.5 * neg)) / (P * N)"


@sql("metric_accuracy", "scores")
def _():
    return f", {CONF} SELECT {r6('(tp + tn) / (tp + fp + fn + tn)')} AS accuracy FROM conf"


@sql("metric_f1", "scores")
def _():
    return (f", {CONF} SELECT {r6('CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END')}"
            " AS f1 FROM conf")


@sql("metric_average_precision", "scores")
def _():
    return f", {RUN} SELECT {r6(f'{AP}')} AS average_precision FROM run GROUP BY P"


@sql("metric_auroc", "scores")
def _():
    return f", {RUN} SELECT {r6(f'{AUC}')} AS auroc FROM run GROUP BY P, N"


@sql("evaluate_scores", "scores")
def _():
    return (f", {CONF}, {RUN}, rk AS (SELECT {AP} AS auprc, {AUC} AS auroc FROM run GROUP BY P, N) "
            f"SELECT tp + fp + fn + tn AS n, {r6('(tp + tn) / (tp + fp + fn + tn)')} AS accuracy, "
            f"{r6('CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END')} AS f1, "
            f"{r6('auprc')} AS auprc, {r6('auroc')} AS auroc FROM conf, rk")


@sql("evaluate_scores_grouped")
def _():
    return """ev AS (SELECT event_type, CASE WHEN value > 50 THEN 1 ELSE 0 END AS y,
                round(value / (value + 50.0), 2) AS p FROM events),
conf AS (SELECT event_type, count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp,
                count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn, count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn
         FROM ev GROUP BY event_type),
d AS (SELECT event_type, p AS s, sum(y) AS pos, sum(1 - y) AS neg FROM ev GROUP BY event_type, p),
run AS (SELECT event_type, s, pos, neg,
               sum(pos) OVER (PARTITION BY event_type ORDER BY s DESC) AS ctp,
               sum(neg) OVER (PARTITION BY event_type ORDER BY s DESC) AS cfp,
               sum(pos) OVER (PARTITION BY event_type) AS P, sum(neg) OVER (PARTITION BY event_type) AS N FROM d),
rk AS (SELECT event_type, CASE WHEN P = 0 THEN NULL ELSE sum(pos * ctp / (ctp + cfp)) / P END AS auprc,
              CASE WHEN P * N = 0 THEN NULL ELSE sum(pos * (N - cfp + 0.5 * neg)) / (P * N) END AS auroc
       FROM run GROUP BY event_type, P, N)
SELECT c.event_type, tp + fp + fn + tn AS n, round((tp + tn) / (tp + fp + fn + tn), 6) + 0.0 AS accuracy,
       round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) + 0.0 AS f1,
       round(auprc, 6) + 0.0 AS auprc, round(auroc, 6) + 0.0 AS auroc
FROM conf c JOIN rk USING (event_type)""".replace("ev AS", "WITH ev AS", 1)


@sql("classification_report", "scores")
def _():
    return f""", {CONF}, c AS (
  SELECT CASE WHEN tn + fn = 0 THEN 0.0 ELSE tn / (tn + fn) END AS p0, CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END AS r0,
         CASE WHEN 2 * tn + fn + fp = 0 THEN 0.0 ELSE 2.0 * tn / (2 * tn + fn + fp) END AS f0, tn + fp AS s0,
         CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p1, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS r1,
         CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1, tp + fn AS s1,
         tp + fp + fn + tn AS n, (tp + tn) / (tp + fp + fn + tn) AS acc FROM conf)
SELECT class, {r6('pr')} AS precision, {r6('rc')} AS recall, {r6('f')} AS f1_score, support FROM (
  SELECT '0' AS class, p0 AS pr, r0 AS rc, f0 AS f, s0 AS support FROM c UNION ALL
  SELECT '1', p1, r1, f1, s1 FROM c UNION ALL
  SELECT 'accuracy', NULL, NULL, acc, n FROM c UNION ALL
  SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM c UNION ALL
  SELECT 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n FROM c)"""


@sql("probability_histogram", "passes", "scores")
def _():
    return f""", hp AS (SELECT a.p, b.y FROM passes a JOIN scores b ON a.pass = b.row_id),
r AS (SELECT y, count(*) AS n, CASE WHEN min(p) = max(p) THEN min(p) - 0.5 ELSE min(p) END AS lo,
             CASE WHEN min(p) = max(p) THEN max(p) + 0.5 ELSE max(p) END AS hi FROM hp GROUP BY y),
b AS (SELECT hp.y, CAST(least(floor((hp.p - r.lo) / ((r.hi - r.lo) / 80)), 79) AS INTEGER) AS bin, r.lo, r.hi, r.n
      FROM hp JOIN r USING (y))
SELECT y, bin, {r6('lo + bin * ((hi - lo) / 80)')} AS bin_lo, {r6('lo + (bin + 1) * ((hi - lo) / 80)')} AS bin_hi,
       count(*) AS count, {r6('count(*) / (n * ((hi - lo) / 80))')} AS density
FROM b GROUP BY y, bin, lo, hi, n"""


@sql("learning_curve", "results")
def _():
    return (f"SELECT model, strategy, n_labeled, count(*) AS n_seeds, "
            f"{r6_exact('avg(accuracy)')} AS accuracy_mean, {r6_exact('stddev_samp(accuracy)')} AS accuracy_std, "
            f"{r6_exact('avg(f1)')} AS f1_mean, {r6_exact('stddev_samp(f1)')} AS f1_std, "
            f"{r6_exact('avg(auprc)')} AS auprc_mean, {r6_exact('stddev_samp(auprc)')} AS auprc_std "
            "FROM results GROUP BY model, strategy, n_labeled")


@sql("learning_curve_band", "results")
def _():
    return (f"SELECT model, strategy, n_labeled, {r6('avg(accuracy)')} AS mean, {r6('stddev_samp(accuracy)')} AS std, "
            f"{r6('avg(accuracy) - stddev_samp(accuracy)')} AS lower, {r6('avg(accuracy) + stddev_samp(accuracy)')} AS upper "
            "FROM results WHERE model = 'mlp_mcdropout' GROUP BY model, strategy, n_labeled")


@sql("final_round", "results")
def _():
    return (f"SELECT model, strategy, seed, max(round) AS last_round, {r6('max_by(accuracy, round)')} AS final_accuracy, "
            f"{r6('max_by(f1, round)')} AS final_f1, {r6('max_by(auprc, round)')} AS final_auprc "
            "FROM results GROUP BY model, strategy, seed")


EPOCH_SQL = """em AS (SELECT epoch, CASE WHEN sum(n) > 0 THEN sum(loss_sum) / sum(n) ELSE 0.0 END AS val_loss,
       CASE WHEN sum(n) > 0 THEN sum(correct) / sum(n) ELSE 0.0 END AS val_acc, CAST(sum(n) AS BIGINT) AS n
       FROM epochs GROUP BY epoch)"""


@sql("epoch_metrics", "epochs")
def _():
    return f", {EPOCH_SQL} SELECT epoch, {r6('val_loss')} AS val_loss, {r6('val_acc')} AS val_acc, n FROM em"


@sql("best_epoch", "epochs")
def _():
    return (f", {EPOCH_SQL} SELECT epoch, {r6('val_loss')} AS val_loss, {r6('val_acc')} AS val_acc, n FROM em "
            "ORDER BY val_acc DESC, epoch LIMIT 1")


# ---------------------------------------------------------------- MC passes, ensembles
MC_SQL = """mc AS (SELECT row_id, avg(p) AS mean_p, var_pop(p) AS var_p, stddev_pop(p) AS std_p, count(*) AS n_passes
       FROM passes GROUP BY row_id)"""


@sql("mc_mean", "passes")
def _():
    return (f", {MC_SQL} SELECT row_id, {r6('mean_p')} AS mean_p, n_passes, {r6(ent('mean_p'))} AS entropy FROM mc")


@sql("mc_variance", "passes")
def _():
    return f", {MC_SQL} SELECT row_id, {r6('var_p')} AS var_p FROM mc"


@sql("mc_std", "passes")
def _():
    return f", {MC_SQL} SELECT row_id, {r6('std_p')} AS std_p FROM mc"


@sql("acquire_mc_variance", "passes")
def _():
    return f", {MC_SQL} SELECT row_id, {r6('var_p')} AS var_p FROM mc ORDER BY round(var_p, 12) DESC, row_id LIMIT 96"


@sql("ensemble_variance", "passes")
def _():
    return (f", pm AS (SELECT row_id, pass % 3 AS model, avg(p) AS model_p FROM passes GROUP BY ALL) "
            f"SELECT row_id, count(*) AS n_models, {r6('avg(model_p)')} AS mean_p, {r6('var_pop(model_p)')} AS var_p "
            "FROM pm GROUP BY row_id")


# ---------------------------------------------------------------- weights, scaling, losses
@sql("class_weights", "pairs")
def _():
    return (f", c AS (SELECT label, count(*) AS n_c FROM pairs GROUP BY label) "
            f"SELECT label, n_c, {r6('(SELECT sum(n_c) FROM c) / ((SELECT count(*) FROM c) * n_c)')} AS weight FROM c")


@sql("pos_weight", "pairs")
def _():
    return (f"SELECT n_neg, n_pos, {r6('n_neg / greatest(n_pos, 1)')} AS pos_weight FROM ("
            "SELECT count(*) FILTER (WHERE label = 0) AS n_neg, count(*) FILTER (WHERE label = 1) AS n_pos FROM pairs)")


SCALE_SQL = """xs AS (SELECT row_id, list_concat(h, l, ag) AS x FROM lenient),
st AS (SELECT i - 1 AS i, avg(v) AS mean, stddev_pop(v) AS std FROM (
         SELECT unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM xs) GROUP BY i)"""


@sql("standard_scale_fit", "lenient")
def _():
    return f", {SCALE_SQL} SELECT CAST(i AS INTEGER) AS i, {r6('mean')} AS mean, {r6('std')} AS std FROM st"


@sql("standard_scale_apply", "lenient")
def _():
    return f""", {SCALE_SQL},
arr AS (SELECT list(mean ORDER BY i) AS m, list(CASE WHEN std = 0 THEN 1.0 ELSE std END ORDER BY i) AS s FROM st),
sc AS (SELECT row_id, list_transform(range(1, len(x) + 1), lambda k: (x[k] - arr.m[k]) / arr.s[k]) AS y FROM xs, arr)
SELECT row_id, {stats('y', 'xs')} FROM sc"""


@sql("bce_loss", "cosine_scores")
def _():
    z = "(4.0 * cosine)"
    sp = lambda t: f"(greatest({t}, 0.0) + ln(1 + exp(-abs({t}))))"
    return (", pw AS (SELECT count(*) FILTER (WHERE label = 0) / greatest(count(*) FILTER (WHERE label = 1), 1) AS w "
            "FROM cosine_scores) "
            f"SELECT row_id, {r6(f'pw.w * label * {sp(f"(-{z})")} + (1 - label) * {sp(z)}')} AS loss FROM cosine_scores, pw")


@sql("entropy_classes", "scores")
def _():
    return (f"SELECT row_id, {r6('-((1 - p) * ln((1 - p) + 1e-10) + p * ln(p + 1e-10))')} AS entropy FROM scores")


# ---------------------------------------------------------------- salience-weighted acquisition
CAND = """cand AS (SELECT row_id, {cos} AS cosine, sqrt(list_sum(list_transform(list_zip(ab, ag), lambda z: (z[1] * z[2]) * (z[1] * z[2])))) AS salience
  FROM (SELECT row_id, antigen_emb AS ag,
               CASE WHEN coalesce(len(list_filter(light_emb, lambda x: x <> 0)) > 0, false)
                    THEN list_transform(list_zip(heavy_emb, light_emb), lambda z: (z[1] + z[2]) / 2.0)
                    ELSE heavy_emb END AS ab FROM strict)),
cand2 AS (SELECT *, {ent} AS entropy FROM (SELECT *, (1.0 + cosine) / 2.0 AS p FROM cand)),
zc AS (SELECT *, (salience - (SELECT avg(salience) FROM cand2)) / ((SELECT stddev_pop(salience) FROM cand2) + 1e-8) AS z
       FROM cand2),
ws AS (SELECT *, entropy * (1.0 + 0.12 * tanh(z)) AS wscore FROM zc)"""


def _cand():
    return ", " + CAND.format(cos=cos("ab", "ag"), ent=ent("p")) + " "


@sql("salience_zscore", "strict")
def _():
    return _cand() + f"SELECT row_id, {r6('salience')} AS salience, {r6('z')} AS z FROM ws"


@sql("weighted_score", "strict")
def _():
    return _cand() + f"SELECT row_id, {r6('wscore')} AS wscore FROM ws"


@sql("acquire_weighted", "strict")
def _():
    return _cand() + f"SELECT row_id, {r6('wscore')} AS wscore FROM ws ORDER BY round(wscore, 12) DESC, row_id LIMIT 96"


@sql("acquire_hybrid", "strict")
def _():
    return _cand() + """, rnd AS (SELECT row_id FROM cand2 ORDER BY md5(concat('1:2:', row_id)), row_id LIMIT 48),
rest AS (SELECT * FROM cand2 WHERE row_id NOT IN (SELECT row_id FROM rnd)),
rz AS (SELECT *, entropy * (1.0 + 0.12 * tanh((salience - (SELECT avg(salience) FROM rest))
                 / ((SELECT stddev_pop(salience) FROM rest) + 1e-8))) AS wscore FROM rest)
SELECT row_id, 'random' AS part FROM rnd
UNION ALL
SELECT row_id, 'weighted' AS part FROM (SELECT row_id FROM rz ORDER BY round(wscore, 12) DESC, row_id LIMIT 48)"""


# ---------------------------------------------------------------- state moves and set operators
@sql("state_step", "pairs")
def _():
    return """, seeded AS (SELECT row_id FROM (
  SELECT row_id, row_number() OVER (PARTITION BY label ORDER BY md5(concat('0:seed:', row_id)), row_id) AS rn FROM pairs)
  WHERE rn <= 50),
pick AS (SELECT row_id FROM pairs WHERE row_id NOT IN (SELECT row_id FROM seeded)
         ORDER BY md5(concat('0:1:', row_id)), row_id LIMIT 96)
SELECT row_id, 0 AS round FROM seeded UNION ALL SELECT row_id, 1 AS round FROM pick"""


KEY3_SQL = "heavy_seq, coalesce(light_seq, '') AS light_key, antigen_seq"


@sql("pool_minus_selected", "pairs")
def _():
    return f""", picked AS (SELECT {KEY3_SQL} FROM pairs ORDER BY md5(concat('42:0:', row_id)), row_id LIMIT 1000)
SELECT p.row_id FROM pairs p ANTI JOIN picked s
  ON p.heavy_seq = s.heavy_seq AND coalesce(p.light_seq, '') = s.light_key AND p.antigen_seq = s.antigen_seq"""


@sql("gather_selected", "pairs")
def _():
    return """, ids AS (SELECT row_id FROM pairs ORDER BY md5(concat('7:0:', row_id)), row_id LIMIT 96)
SELECT row_id, heavy_seq, light_seq, antigen_seq, label FROM pairs WHERE row_id IN (SELECT row_id FROM ids)"""


@sql("distinct_keys", "pairs")
def _():
    return f"""SELECT DISTINCT * FROM (
  (SELECT {KEY3_SQL} FROM pairs ORDER BY md5(concat('42:0:', row_id)), row_id LIMIT 1000)
  UNION ALL
  (SELECT {KEY3_SQL} FROM pairs ORDER BY md5(concat('42:1:', row_id)), row_id LIMIT 1000))"""


# ---------------------------------------------------------------- sources and sinks (round trips)
@sql("src_csv_pairs", "pairs")
def _():
    return "SELECT * FROM pairs"


@sql("src_text_sequences", "seqs")
def _():
    return "SELECT seq FROM (SELECT unnest(string_split(seq, chr(10))) AS seq FROM seqs) WHERE length(trim(seq)) > 0"


TOK_STATS = lambda a, p: stats(a, p)


@sql("src_embeddings", "tokens")
def _():
    return f"SELECT text AS seq, shape, {stats('data', 'data')} FROM tokens"


@sql("sink_embeddings", "emb")
def _():
    return f"SELECT seq, {stats('embedding', 'data')} FROM emb"


@sql("feature_cache_roundtrip", "lenient")
def _():
    return f"SELECT row_id, label, {stats('list_concat(h, l, ag)', 'x')} FROM lenient"


@sql("results_csv_roundtrip", "results")
def _():
    return (f"SELECT model, strategy, seed, round, n_labeled, {r6('accuracy')} AS accuracy, {r6('f1')} AS f1, "
            f"{r6('auprc')} AS auprc FROM results")


@sql("report_json", "epochs")
def _():
    return (f", {EPOCH_SQL} SELECT CAST(epoch AS INTEGER) AS batch, 'passive' AS strategy, {r6('val_loss')} AS val_loss, "
            f"{r6('val_acc')} AS val_acc FROM em")


@sql("dedupe_last_wins")
def _():
    return ("SELECT md5(text) AS text_md5, max(doc_id) AS doc_id, arg_max(lang, doc_id) AS lang "
            "FROM documents GROUP BY text")


# ---------------------------------------------------------------- token matrices
TOKLONG = """tl AS (SELECT concat('t', CAST(floor(vec_id / 40) AS BIGINT), '_', CAST(label AS VARCHAR)) AS text,
                  vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"""


@sql("decode_tokens")
def _():
    return f"""WITH {TOKLONG}
SELECT text, CAST(count(*) AS INTEGER) AS n_tok, {r6('arg_min(list_sum(e), vec_id)')} AS first_sum,
       {r6('arg_max(list_sum(e), vec_id)')} AS last_sum FROM tl GROUP BY text"""


@sql("mean_pool")
def _():
    return f"""WITH {TOKLONG},
pd AS (SELECT text, j, avg(v) AS v FROM (SELECT text, unnest(e) AS v, unnest(range(len(e))) AS j FROM tl) GROUP BY text, j),
pl AS (SELECT text, list(v ORDER BY j) AS pooled FROM pd GROUP BY text)
SELECT text, {stats('pooled', 'pooled')} FROM pl"""


@sql("first_token_pool")
def _():
    return f"""WITH {TOKLONG}, f AS (SELECT text, arg_min(e, vec_id) AS cls FROM tl GROUP BY text)
SELECT text, {stats('cls', 'cls')} FROM f"""


@sql("pad_and_mask")
def _():
    return f"""WITH {TOKLONG}, g AS (SELECT text, count(*) AS n, sum(list_sum(e)) AS s FROM tl GROUP BY text)
SELECT text, CAST(ceil(n / 32.0) * 32 AS INTEGER) AS n_padded, CAST(n AS INTEGER) AS n_valid, {r6('s')} AS padded_sum FROM g"""


@sql("antibody_tokens")
def _():
    return f"""WITH {TOKLONG}, g AS (SELECT text, count(*) AS n, sum(list_sum(e)) AS s FROM tl GROUP BY text)
SELECT text, CAST(CASE WHEN n % 2 = 0 THEN 2 * n ELSE n END AS INTEGER) AS n_tok,
       {r6('CASE WHEN n % 2 = 0 THEN 2 * s ELSE s END')} AS ab_sum FROM g"""


@sql("attention_pool")
def _():
    return f"""WITH {TOKLONG},
sc AS (SELECT text, vec_id, e, list_sum(list_transform(range(1, len(e) + 1),
          lambda j: e[j] * ((((j - 1) % 7) - 3) / 10.0))) + 0.1 AS s FROM tl),
wt AS (SELECT text, vec_id, e, exp(s - max(s) OVER (PARTITION BY text)) AS ex FROM sc),
wn AS (SELECT text, vec_id, e, ex / sum(ex) OVER (PARTITION BY text) AS w FROM wt),
pd AS (SELECT text, j, sum(w * v) AS v FROM (SELECT text, w, unnest(e) AS v, unnest(range(len(e))) AS j FROM wn) GROUP BY text, j),
pl AS (SELECT text, list(v ORDER BY j) AS attn FROM pd GROUP BY text)
SELECT text, {stats('attn', 'attn')} FROM pl"""


@sql("lookup_tokens", "tokens")
def _():
    name = lambda g, l: f"concat('t', CAST(({g}) % k.nk AS VARCHAR), '_', CAST(({l}) % 11 AS VARCHAR))"
    return f""", tp AS (
  SELECT o_orderkey AS row_id, {name('o_orderkey * 7919', 'o_orderkey')} AS heavy_seq,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '' ELSE {name('o_orderkey * 31', 'o_orderkey * 3')} END AS light_seq,
         {name('o_custkey', 'o_custkey * 7')} AS antigen_seq, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label
  FROM orders, (SELECT CAST(floor(max(vec_id) / 40) AS BIGINT) + 2 AS nk FROM embeddings) AS k),
m AS (SELECT text, CAST(shape[1] AS INTEGER) AS n, list_sum(data) AS s FROM tokens)
SELECT p.row_id, p.label,
       CASE WHEN coalesce(p.light_seq, '') = '' THEN 'empty' WHEN l.text IS NULL THEN 'missing' ELSE 'hit' END AS light_status,
       h.n AS heavy_n, a.n AS antigen_n, CASE WHEN coalesce(p.light_seq, '') = '' THEN 0 ELSE l.n END AS light_n,
       {r6('h.s')} AS heavy_sum, {r6("CASE WHEN coalesce(p.light_seq, '') = '' THEN 0.0 ELSE l.s END")} AS light_sum, {r6('a.s')} AS antigen_sum
FROM tp p JOIN m h ON h.text = p.heavy_seq JOIN m a ON a.text = p.antigen_seq LEFT JOIN m l ON l.text = NULLIF(p.light_seq, '')"""


# ---------------------------------------------------------------- encoder job
@sql("extract_embeddings", "seqs")
def _():
    return f"""WITH ch AS (SELECT row_id, unicode(c) % 64 AS j FROM (SELECT row_id, unnest(string_split(seq, '')) AS c FROM seqs)),
cnt AS (SELECT row_id, j, count(*) AS k FROM ch GROUP BY row_id, j),
tot AS (SELECT row_id, length(seq) AS n FROM seqs)
SELECT t.row_id, t.n AS n_chars, 64 AS emb_n,
       {r6('coalesce(sum(c.k) / t.n, 0.0)')} AS emb_sum, {r6('coalesce(sqrt(sum((c.k / t.n) * (c.k / t.n))), 0.0)')} AS emb_norm
FROM tot t LEFT JOIN cnt c USING (row_id) GROUP BY t.row_id, t.n""".replace("WITH ch AS", ", ch AS", 1)


# ---------------------------------------------------------------- geometry
@sql("leaf_proximity", "leaves")
def _():
    return f""", occ AS (SELECT tree, leaf, count(*) AS n FROM leaves GROUP BY tree, leaf),
g AS (SELECT l.row_id, CAST(sum(o.n - 1) AS BIGINT) AS shared_leaves FROM leaves l JOIN occ o USING (tree, leaf) GROUP BY l.row_id)
SELECT row_id, shared_leaves,
       {r6('shared_leaves / ((SELECT count(DISTINCT tree) FROM leaves) * ((SELECT count(DISTINCT row_id) FROM leaves) - 1))')} AS mean_proximity
FROM g"""


@sql("proximity_totals", "leaves")
def _():
    return """, occ AS (SELECT tree, leaf, count(*) AS n FROM leaves GROUP BY tree, leaf)
SELECT tree, CAST(sum(n * (n - 1)) / 2 AS BIGINT) AS pairs_sharing, count(*) AS leaves_used, max(n) AS largest_leaf
FROM occ GROUP BY tree"""


@sql("neighbour_label_agreement", "leaves", "pairs")
def _():
    return f""", lv AS (SELECT l.row_id, l.tree, l.leaf, p.label FROM leaves l JOIN pairs p USING (row_id)),
occ AS (SELECT tree, leaf, count(*) AS n FROM lv GROUP BY tree, leaf),
occl AS (SELECT tree, leaf, label, count(*) AS n_same FROM lv GROUP BY tree, leaf, label),
g AS (SELECT lv.row_id, lv.label, CAST(sum(o.n - 1) AS BIGINT) AS neighbours, CAST(sum(ol.n_same - 1) AS BIGINT) AS same_label
      FROM lv JOIN occ o USING (tree, leaf) JOIN occl ol USING (tree, leaf, label) GROUP BY lv.row_id, lv.label)
SELECT row_id, label, neighbours, same_label,
       {r6('CASE WHEN neighbours = 0 THEN NULL ELSE same_label / neighbours END')} AS agreement FROM g"""


CENTROIDS = """e AS (SELECT CAST(vec_id AS BIGINT) AS row_id, concat('v', CAST(vec_id AS VARCHAR)) AS seq, label AS emb_label,
                CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
cd AS (SELECT emb_label, j, avg(x) AS m FROM (SELECT emb_label, unnest(v) AS x, unnest(range(len(v))) AS j FROM e)
       GROUP BY emb_label, j),
c AS (SELECT emb_label, list(m ORDER BY j) AS center FROM cd GROUP BY emb_label),
dist AS (SELECT e.row_id, e.seq, e.emb_label,
                sqrt(list_sum(list_transform(list_zip(e.v, c.center), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist
         FROM e JOIN c USING (emb_label))"""


@sql("nearest_to_center")
def _():
    return f"""WITH {CENTROIDS}
SELECT emb_label, arg_min(row_id, (dist, row_id)) AS row_id, {r6('min(dist)')} AS dist FROM dist GROUP BY emb_label"""


@sql("centroid_distance")
def _():
    return f"WITH {CENTROIDS} SELECT seq, emb_label, {r6('dist')} AS dist FROM dist"


KNN = """v AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT id, list_transform(e, lambda x: x / norm) AS u FROM (SELECT id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v) WHERE norm > 0)"""


@sql("knn_exact")
def _():
    return f"""WITH {KNN},
c AS (SELECT q.id, b.id AS neighbour, round(list_dot_product(q.u, b.u), 12) AS cosine FROM u q JOIN u b ON q.id <> b.id WHERE q.id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, neighbour) AS rank FROM c)
SELECT id, CAST(rank AS INTEGER) AS rank, neighbour, {r6('cosine')} AS cosine FROM r WHERE rank <= 30"""


@sql("knn_graph")
def _():
    return f"""WITH {KNN}, t AS (SELECT least(30, count(*) - 1) AS k FROM u)
SELECT id, k AS n, k AS n_distinct, k AS last_rank, true AS ordered FROM u, t WHERE k > 0"""


@sql("knn_recall")
def _():
    return f"""WITH {KNN}, t AS (SELECT least(30, count(*) - 1) AS k FROM u)
SELECT CAST(count(*) * max(k) AS BIGINT) AS true_neighbours, true AS recall_ok FROM u, t WHERE id % 20 = 0"""


# ---------------------------------------------------------------- models
@sql("mlp_forward", "strict")
def _():
    h = ("greatest(0.0, list_sum(list_transform(range(len(x)), lambda k: x[k + 1] * 0.1 * sin(0.37 * k + 0.11 * j)))"
         " + 0.01 * j - 0.05)")
    logit = f"list_sum(list_transform(range(16), lambda j: {h} * 0.1 * sin(0.37 * j + 0.5))) - 0.05"
    return (f", mx AS (SELECT row_id, list_concat(heavy_emb, antigen_emb) AS x FROM strict), "
            f"lg AS (SELECT row_id, {logit} AS logit FROM mx) "
            f"SELECT row_id, {r6('logit')} AS logit, {r6('1.0 / (1.0 + exp(-logit))')} AS p FROM lg")


@sql("frozen_batchnorm_score", "strict")
def _():
    def normed(table):
        return (f"SELECT z.row_id, z.j, greatest(0.0, (z.v - m.mean) / sqrt(m.var + 1e-5) * (1.0 + 0.05 * z.j) + 0.02 * z.j - 0.1) AS h "
                f"FROM {table} z JOIN (SELECT j, avg(v) AS mean, var_pop(v) AS var FROM {table} GROUP BY j) m ON z.j = m.j")

    first = "list_sum(list_transform(range(len(x)), lambda k: x[k + 1] * 0.1 * sin(0.37 * k + 0.11 * j))) + 0.01 * j - 0.05"
    return (f", mx AS (SELECT row_id, list_concat(heavy_emb, antigen_emb) AS x FROM strict), "
            f"z0 AS (SELECT row_id, j, {first} AS v FROM mx, range(16) t(j)), h0 AS ({normed('z0')}), "
            f"z1 AS (SELECT row_id, t.j, sum(h * 0.1 * sin(0.37 * h0.j + 0.11 * t.j + 0.5)) + 0.01 * t.j - 0.05 AS v "
            f"FROM h0, range(8) t(j) GROUP BY row_id, t.j), h1 AS ({normed('z1')}), "
            f"lg AS (SELECT row_id, sum(h * 0.1 * sin(0.37 * j + 1.0)) - 0.05 AS logit FROM h1 GROUP BY row_id) "
            f"SELECT row_id, {r6('logit')} AS logit, {r6('1.0 / (1.0 + exp(-logit))')} AS p FROM lg")


@sql("frozen_batchnorm_mc", "strict")
def _():
    return " SELECT row_id, true AS same, true AS in_range, true AS var_in_range FROM strict"

# a reloaded model scores exactly like the one that was saved
ORACLE["model_roundtrip"] = ORACLE["mlp_forward"]


# ---------------------------------------------------------------- fitted models: what holds whatever was learned
@sql("train_mlp")
def _():
    return "SELECT CAST(e AS INTEGER) AS epoch, true AS finite, true AS falls FROM range(1, 31) AS t(e)"


@sql("mc_dropout_score", "strict")
def _():
    return "SELECT row_id, true AS mean_ok, true AS var_ok, true AS entropy_ok FROM strict"


@sql("train_best_epoch")
def _():
    return "SELECT CAST(e AS INTEGER) AS epoch, true AS finite, true AS reloaded_ok, 1 AS n_chosen FROM range(1, 31) AS t(e)"


# the same bounds, over networks instead of passes
ORACLE["train_ensemble"] = ORACLE["mc_dropout_score"]


@sql("train_forest", "strict")
def _():
    return """SELECT row_id, label, true AS p_ok FROM (
  SELECT row_id, label, count(*) OVER (PARTITION BY label) AS n,
         row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', row_id)), row_id) AS rn FROM strict)
WHERE rn <= round(n * 0.2)"""


@sql("forest_leaf_proximity", "strict")
def _():
    return "SELECT row_id, 300 AS n_leaves, 300 AS n_trees, true AS leaf_ok, true AS proximity_ok FROM strict"


@sql("kmeans_slice", "cosine_scores")
def _():
    return "SELECT row_id, true AS cluster_ok FROM cosine_scores ORDER BY round(entropy, 12) DESC, row_id LIMIT 480"


@sql("acquire_badge", "strict")
def _():
    return 'SELECT count(*) > 0 AS size_ok, count(*) = count(DISTINCT row_id) AS "distinct", true AS inside FROM strict'


@sql("project_2d", "strict")
def _():
    return "SELECT count(*) AS n, true AS mean_a, true AS mean_b, true AS uncorrelated, true AS ordered FROM strict"


def _progress(model: str, strategy: str, seeds: str, batch: int, rounds: int | str) -> str:
    """Rounds of a loop: 100 labelled rows at first, then a batch more each time until the pool is empty."""
    return f""", pool AS (SELECT CAST(sum(n - round(n * 0.2)) AS BIGINT) AS total FROM (SELECT label, count(*) AS n FROM strict GROUP BY label))
SELECT '{model}' AS model, strategy, CAST(seed AS INTEGER) AS seed, {batch} AS batch_size, CAST(r AS INTEGER) AS round,
       least(100 + {batch} * r, total) AS n_labeled, total - least(100 + {batch} * r, total) AS pool_left, true AS metrics_ok
FROM pool, range(0, {rounds} + 1) AS g(r), (SELECT unnest({seeds}) AS seed) AS s, (SELECT unnest({strategy}) AS strategy) AS t
WHERE r = 0 OR 100 + {batch} * (r - 1) < total"""


@sql("al_loop_fixed", "strict")
def _():
    return _progress("forest", "['uncertainty']", "[0]", 96, 25)


@sql("al_loop_ensemble", "strict")
def _():
    return _progress("ensemble", "['ensemble']", "[0]", 96, 1)


@sql("al_loop_exhaust", "strict")
def _():
    return _progress("forest", "['random']", "[0]", 2000, 1_000_000)


@sql("al_loop_mlp", "strict")
def _():
    return _progress("mlp", "['weighted']", "[0]", 96, 1)


@sql("al_loop_hybrid", "strict")
def _():
    return _progress("mlp", "['hybrid']", "[1]", 96, 1)


@sql("experiment_grid", "strict")
def _():
    return _progress("forest", "['random', 'weighted']", "[0, 1, 2, 3, 4]", 96, 1)


@sql("al_loop_badge", "strict")
def _():
    return "SELECT 'mlp' AS model, 'badge' AS strategy, CAST(r AS INTEGER) AS round, true AS size_ok FROM range(0, 2) AS g(r)"


@sql("al_campaign", "strict")
def _():
    return """, n AS (SELECT floor(count(*) * 0.8) AS train FROM strict)
SELECT CAST(r AS INTEGER) AS batch, 'passive' AS strategy, 1000 + 96 * r AS n_labeled, true AS loss_ok, true AS acc_ok, true AS left_ok
FROM n, range(1, 22) AS g(r) WHERE 1000 + 96 * r <= train"""


@sql("feature_pipeline", "emb", "pairs")
def _():
    part = lambda c: f"coalesce(list_sum({c}), 0.0)"
    square = lambda c: f"coalesce(list_sum(list_transform({c}, lambda z: z * z)), 0.0)"
    return f""", e2 AS (SELECT seq, len(embedding) // 2 AS half, list_transform(range(1, len(embedding) // 2 + 1),
       lambda i: (embedding[i] + embedding[i + len(embedding) // 2]) / 2.0) AS v FROM emb)
SELECT p.row_id, p.label, p.heavy_seq, CAST(3 * (SELECT max(half) FROM e2) AS INTEGER) AS x_n,
       {r6(part('h.v') + ' + ' + part('l.v') + ' + ' + part('a.v'))} AS x_sum,
       {r6('sqrt(' + square('h.v') + ' + ' + square('l.v') + ' + ' + square('a.v') + ')')} AS x_norm
FROM pairs p LEFT JOIN e2 h ON h.seq = NULLIF(p.heavy_seq, '') LEFT JOIN e2 l ON l.seq = NULLIF(p.light_seq, '')
LEFT JOIN e2 a ON a.seq = NULLIF(p.antigen_seq, '')
WHERE h.v IS NOT NULL OR l.v IS NOT NULL OR a.v IS NOT NULL"""


@sql("extract_tokens", "seqs")
def _():
    return "SELECT row_id, CAST(length(seq) AS INTEGER) AS n_chars, true AS shape_ok FROM seqs"


# the same results by another way of running
ORACLE["extract_once"] = ORACLE["extract_embeddings"]
ORACLE["lookup_coverage_observed"] = ORACLE["lookup_coverage"]
ORACLE["project_sketch"] = ORACLE["project_2d"]


@sql("forest_roundtrip", "strict")
def _():
    return "SELECT row_id, true AS same, 200 AS trees FROM strict"


@sql("separability", "strict", "leaves")
def _():
    return f""", x AS (SELECT row_id, label, list_concat(heavy_emb, antigen_emb) AS x FROM strict),
u AS (SELECT row_id, label, unnest(x) AS v, unnest(range(len(x))) AS j FROM x),
cj AS (SELECT label, j, avg(v) AS m, count(*) AS n, sum(v * v) AS sq FROM u GROUP BY label, j),
g AS (SELECT j, sum(n * m) / sum(n) AS m FROM cj GROUP BY j),
sc AS (SELECT sum(sq - n * m * m) AS within FROM cj), bt AS (SELECT sum(cj.n * (cj.m - g.m) * (cj.m - g.m)) AS between_ FROM cj JOIN g USING (j)),
d AS (SELECT u.row_id, u.label, cj.label AS c, sqrt(sum((u.v - cj.m) * (u.v - cj.m))) AS d FROM u JOIN cj USING (j) GROUP BY u.row_id, u.label, cj.label),
ab AS (SELECT row_id, min(d) FILTER (WHERE label = c) AS a, min(d) FILTER (WHERE label <> c) AS b FROM d GROUP BY row_id),
sl AS (SELECT avg((b - a) / greatest(a, b)) AS silhouette FROM ab),
lv AS (SELECT l.row_id, l.tree, l.leaf, p.label FROM leaves l JOIN pairs p USING (row_id)),
lc AS (SELECT tree, leaf, label, count(*) AS n FROM lv GROUP BY tree, leaf, label),
lt AS (SELECT tree, leaf, sum(n) AS n FROM lc GROUP BY tree, leaf),
ag AS (SELECT sum(lc.n * (lc.n - 1)) / sum(lc.n * (lt.n - 1)) AS agreement FROM lc JOIN lt USING (tree, leaf))
SELECT (SELECT count(*) FROM x) AS n, {r6('within')} AS within, {r6('between_')} AS "between", {r6('between_ / within')} AS ratio,
       {r6('silhouette')} AS silhouette, {r6('agreement')} AS leaf_agreement FROM sc, bt, sl, ag"""
