"""Every registered query of the engine itself, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features
from ..operators import drift, incidents, links, metrics, partitioning, windows
from ..operators.components import ensure_checkpoint
from ..sources import attempts
from ..sources.sinks import replay_subset

DAY, LINK, CAP = 86_400.0, 21_600.0, 32
THRESHOLD = 0.9
ENTITIES = ("device_id", "ip_id")

EV = """
ev AS (
  SELECT event_id AS seq, epoch_us(ts) / 1e6::DOUBLE AS ts_s, value AS amount, CAST(event_id AS VARCHAR) AS card_id,
         'b' || (event_id % 40) AS bin_id, 'd' || user_id AS device_id, 'i' || regexp_extract(props, '[0-9]+') AS ip_id,
         event_type AS email_domain, event_type <> 'error' AS approved, CAST(user_id % 7 = 0 AS INTEGER) AS label,
         CASE WHEN user_id % 7 = 0 THEN 'c' || (user_id % 3) END AS campaign_id, (event_id * 7919 % 1000) / 1000.0::DOUBLE AS score
  FROM events
)"""
MET = """
met AS (
  SELECT l.doc_id AS seq, l.quality AS y, (d.n_chars % 997) / 997.0::DOUBLE AS score FROM labels l JOIN documents d USING (doc_id)
)"""


def _ev(spark, d):
    return attempts.from_events(spark, d)


def _alert():
    return metrics.alert(F.col("score"), THRESHOLD)


def _r(c, n=6):
    return F.round(c, n)


Q, O = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f
    return add


def _trail(key, w, table="ev", seq="seq"):
    return f"""(count(*) OVER (PARTITION BY {key} ORDER BY ts_s RANGE BETWEEN {w} PRECEDING AND CURRENT ROW)
      - count(*) OVER (PARTITION BY {key}, ts_s) + row_number() OVER (PARTITION BY {key}, ts_s ORDER BY {seq}))"""


# The least tau by a reverse cumulative count over the histogram, with 2 as a candidate of its own.
TAU_SQL = f"""WITH {EV}, c AS (
  SELECT 'device_id' AS entity, {_trail('device_id', DAY)} AS c FROM ev UNION ALL SELECT 'ip_id', {_trail('ip_id', DAY)} FROM ev
), h AS (SELECT entity, c, count(*) AS m FROM c GROUP BY 1, 2 UNION ALL SELECT 'device_id', 2, 0 UNION ALL SELECT 'ip_id', 2, 0),
a AS (SELECT h1.entity, h1.c, (SELECT coalesce(sum(m), 0) FROM h h2 WHERE h2.entity = h1.entity AND h2.c > h1.c) AS above FROM h h1),
tau AS (SELECT entity, CAST(min(c) AS BIGINT) AS tau FROM a WHERE c >= 2 AND above / (SELECT count(*) FROM ev)::DOUBLE <= 0.005 GROUP BY 1)"""


@query(TAU_SQL + " SELECT entity, tau FROM tau")
def tune_velocity(spark, d):
    return windows.tune_velocity(_ev(spark, d), ENTITIES, DAY)


@query(TAU_SQL + f""", v AS (SELECT seq, label, greatest({_trail('device_id', DAY)} - (SELECT tau FROM tau WHERE entity = 'device_id'),
  {_trail('ip_id', DAY)} - (SELECT tau FROM tau WHERE entity = 'ip_id'), 0) AS velocity FROM ev)
SELECT seq, CAST(velocity AS BIGINT) AS velocity, label FROM v WHERE velocity >= 1""")
def velocity_alerts(spark, d):
    e = _ev(spark, d)
    ensure_checkpoint(spark)
    counts = windows.counts_by_entity(e, ENTITIES, DAY).checkpoint()  # counted once: tuned on, then filtered
    taus = {r["entity"]: r["tau"] for r in windows.tune_velocity(e, ENTITIES, DAY, counts=counts).collect()}  # one row an entity
    return windows.multi_velocity(e, taus, DAY, counts).where("velocity >= 1").select("seq", F.col("velocity").cast("long"), "label")


for _k in ("device", "ip"):
    def _velocity(spark, d, k=f"{_k}_id"):
        return windows.multi_velocity(_ev(spark, d), {k: 2}, DAY).select("seq", F.col("velocity").cast("long"))
    _velocity.__name__ = f"velocity_{_k}"
    query(f"WITH {EV} SELECT seq, CAST(greatest({_trail(_k + '_id', DAY)} - 2, 0) AS BIGINT) AS velocity FROM ev")(_velocity)


@query(f"WITH {EV} SELECT seq, CAST(greatest({_trail('device_id', DAY)} - 2, {_trail('ip_id', DAY)} - 3, 0) AS BIGINT) AS velocity FROM ev")
def velocity_multi(spark, d):
    return windows.multi_velocity(_ev(spark, d), {"device_id": 2, "ip_id": 3}, DAY).select("seq", F.col("velocity").cast("long"))


@query(f"WITH {EV}, v AS (SELECT greatest({_trail('device_id', DAY)} - 2, 0) AS v FROM ev) SELECT round(avg(CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS false_positive_rate FROM v")
def false_positive_rate(spark, d):
    e = _ev(spark, d)
    return windows.multi_velocity(e, {"device_id": 2}, DAY).select(F.col("velocity").alias("v")).agg(_r(F.avg((F.col("v") > 0).cast("double"))).alias("false_positive_rate"))


@query(f"""WITH li AS (SELECT epoch_us(l_shipdate) / 1e6::DOUBLE AS ts_s, * FROM lineitem),
v AS (SELECT l_suppkey AS bin_id, {_trail('l_suppkey', 28 * DAY, seq='l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate')} AS c FROM li)
SELECT bin_id, count(*) AS n, CAST(sum(c) AS BIGINT) AS total, CAST(max(c) AS BIGINT) AS most FROM v GROUP BY 1""")
def velocity_ties_lineitem(spark, d):
    e = attempts.from_lineitem(spark, d)
    return e.withColumn("c", windows.trailing_count("bin_id", 28 * DAY)).groupBy("bin_id").agg(F.count("*").alias("n"), F.sum("c").alias("total"), F.max("c").cast("long").alias("most"))


EDGES_SQL = f"""{EV}, long AS (
  SELECT 'device_id' AS rel, device_id AS key, seq, ts_s FROM ev UNION ALL SELECT 'ip_id', ip_id, seq, ts_s FROM ev UNION ALL SELECT 'bin_id', bin_id, seq, ts_s FROM ev
), r AS (SELECT *, row_number() OVER (PARTITION BY rel, key ORDER BY ts_s, seq) AS rn FROM long),
edges AS (SELECT b.rel, a.seq AS src, b.seq AS dst FROM r b JOIN r a ON a.rel = b.rel AND a.key = b.key AND a.rn < b.rn AND a.rn >= b.rn - @CAP AND a.ts_s >= b.ts_s - {DAY})"""


def _edges_sql(cap):
    return EDGES_SQL.replace("@CAP", str(cap))


def _edges(spark, d, cap=CAP):
    return links.edges(_ev(spark, d), attempts.MODEL_RELATIONS, DAY, cap)


@query(f"WITH {_edges_sql(CAP)} SELECT rel, src, dst FROM edges")
def edges_by_relation(spark, d):
    return _edges(spark, d)


@query(f"WITH {_edges_sql(CAP)} SELECT src, dst FROM edges WHERE rel = 'device_id'")
def edges_device(spark, d):
    return links.edges(_ev(spark, d), ("device_id",), DAY).select("src", "dst")


@query(f"WITH {_edges_sql(4)} SELECT rel, count(*) AS edges, CAST(sum(dst - src) AS BIGINT) AS span FROM edges GROUP BY 1")
def edges_capped_k4(spark, d):
    return _edges(spark, d, 4).groupBy("rel").agg(F.count("*").alias("edges"), F.sum(F.col("dst") - F.col("src")).alias("span"))


@query(f"WITH {_edges_sql(CAP)} SELECT ev.seq, count(x.seq) AS degree FROM ev LEFT JOIN (SELECT src AS seq FROM edges UNION ALL SELECT dst FROM edges) x ON x.seq = ev.seq GROUP BY 1")
def node_degree(spark, d):
    return links.degrees(_ev(spark, d), _edges(spark, d))


@query(f"WITH {_edges_sql(CAP)} SELECT round(avg(CASE WHEN x.seq IS NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS isolated FROM ev LEFT JOIN (SELECT DISTINCT src AS seq FROM edges UNION SELECT dst FROM edges) x ON x.seq = ev.seq")
def isolation_rate(spark, d):
    return node_degree(spark, d).agg(_r(F.avg((F.col("degree") == 0).cast("double"))).alias("isolated"))


@query(f"""WITH {_edges_sql(CAP)}, deg AS (SELECT rel, dst AS seq, count(*) AS k FROM edges GROUP BY 1, 2), f AS (SELECT rel, key, count(*) AS n FROM long GROUP BY 1, 2)
SELECT l.seq, round(sum(coalesce(k, 0) / ln(1 + n::DOUBLE)), 6) AS shared FROM long l JOIN f ON f.rel = l.rel AND f.key = l.key LEFT JOIN deg ON deg.rel = l.rel AND deg.seq = l.seq GROUP BY 1""")
def shared_entity_score(spark, d):
    return links.shared_entity_score(_ev(spark, d), attempts.MODEL_RELATIONS, DAY).select("seq", _r("shared").alias("shared"))


@query(f"""WITH {_edges_sql(CAP)} SELECT dst AS seq, any_value(device_id) AS value, array_to_string(list(CAST(src AS VARCHAR) ORDER BY src DESC)[1:6], ',') AS ids, CAST(count(*) AS INTEGER) AS total
FROM edges JOIN ev ON ev.seq = dst WHERE rel = 'device_id' GROUP BY 1""")
def evidence_ids(spark, d):
    return links.evidence(_ev(spark, d), "device_id", DAY).withColumn("ids", F.array_join("ids", ","))


@query(f"WITH {_edges_sql(CAP)}, f AS (SELECT device_id, min(seq) AS seq FROM ev GROUP BY 1) SELECT count(*) AS devices, count(e.dst) AS linked FROM f LEFT JOIN (SELECT DISTINCT dst FROM edges WHERE rel = 'device_id') e ON e.dst = f.seq")
def first_event_links(spark, d):
    e = _ev(spark, d)
    first = e.groupBy("device_id").agg(F.min("seq").alias("seq"))
    got = links.edges(e, ("device_id",), DAY).select(F.col("dst").alias("seq")).distinct().withColumn("hit", F.lit(1))
    return first.join(got, "seq", "left").agg(F.count("*").alias("devices"), F.count("hit").alias("linked"))


@query(f"""WITH {EV} SELECT seq, round(sum(CASE WHEN approved THEN 0 ELSE 1 END) OVER w / (count(*) OVER w)::DOUBLE, 6) AS rate FROM ev WINDOW w AS (ORDER BY ts_s RANGE BETWEEN {LINK} PRECEDING AND CURRENT ROW)""")
def decline_burst(spark, d):
    e = _ev(spark, d).select("seq", "ts_s", F.coalesce(~F.col("approved"), F.lit(True)).alias("declined"))
    return windows.trailing_rate(e, F.col("declined"), LINK, peers=True).select("seq", _r("rate").alias("rate"))


@query(f"""WITH {EV} SELECT seq, CAST(sum(CASE WHEN score >= 0.9::DOUBLE THEN 1 ELSE 0 END) OVER w AS BIGINT) AS alerts, round(min(CASE WHEN score >= 0.9::DOUBLE THEN ts_s END) OVER w, 6) AS first_alert_s
FROM ev WINDOW w AS (ORDER BY ts_s RANGE BETWEEN {LINK} PRECEDING AND CURRENT ROW)""")
def ring_summary(spark, d):
    return windows.ring_summary(_ev(spark, d).select("seq", "ts_s", "score"), _alert(), LINK, peers=True).select("seq", "alerts", _r("first_alert_s").alias("first_alert_s"))


@query(f"WITH {EV} SELECT seq, round(ts_s - lag(ts_s, 1, ts_s) OVER (ORDER BY ts_s, seq), 6) AS gap_s FROM ev")
def interarrival(spark, d):
    return windows.interarrival(_ev(spark, d)).select("seq", _r("gap_s").alias("gap_s"))


HOUR_SQL = "(CAST(floor(ts_s / 3600) AS BIGINT) % 24)"


@query(f"""WITH {EV} SELECT seq, round(ln(1 + amount), 6) AS f_log_amount, CASE WHEN amount < 25 THEN 1.0::DOUBLE ELSE 0 END AS f_small, CASE WHEN approved THEN 1.0::DOUBLE ELSE 0 END AS f_approved,
round({HOUR_SQL} / 24.0::DOUBLE, 6) AS f_hour, CASE WHEN email_domain IN ('click', 'view') THEN 1.0::DOUBLE ELSE 0 END AS f_free_mail, 1.0::DOUBLE AS f_one FROM ev""")
def node_features(spark, d):
    got = features.node_features(_ev(spark, d), domains=("click", "view"))
    return got.withColumn("f_log_amount", _r("f_log_amount")).withColumn("f_hour", _r("f_hour"))


@query(f"""WITH {EV} SELECT seq, amount, round(ln(1 + amount), 6) AS log_amount, CAST({HOUR_SQL} AS DOUBLE) AS hour, CASE WHEN approved THEN 1.0::DOUBLE ELSE 0 END AS approved,
CASE WHEN amount < 25 THEN 1.0::DOUBLE ELSE 0 END AS small, CASE WHEN email_domain IN ('click', 'view', 'error') THEN 1.0::DOUBLE ELSE 0 END AS free_mail FROM ev""")
def txn_features(spark, d):
    return features.transaction_features(_ev(spark, d), ("click", "view", "error")).withColumn("log_amount", _r("log_amount"))


DIRTY = """dirty AS (SELECT seq, CASE WHEN seq % 11 = 0 THEN NULL WHEN seq % 13 = 0 THEN 'nan'::DOUBLE ELSE amount END AS amount, CASE WHEN seq % 17 = 0 THEN NULL ELSE approved END AS approved,
  CASE seq % 5 WHEN 0 THEN ' UNK ' WHEN 1 THEN '' WHEN 2 THEN device_id || ' ' ELSE device_id END AS device_id, CASE WHEN seq % 5 < 2 THEN 'n/a' ELSE ip_id END AS ip_id, CASE WHEN seq % 10 = 0 THEN '-' ELSE bin_id END AS bin_id,
  CASE WHEN seq % 10 = 0 THEN NULL ELSE email_domain END AS email_domain, ts_s FROM ev)"""
KEY_SQL = "CASE WHEN lower(trim({0})) IN ('', 'none', 'nan', 'null', 'na', 'n/a', 'unknown', 'unk', '-') THEN NULL ELSE trim({0}) END"


def _dirty(spark, d):
    s = F.col("seq")
    return _ev(spark, d).select("seq", F.when(s % 11 == 0, None).when(s % 13 == 0, float("nan")).otherwise(F.col("amount")).alias("amount"), F.when(s % 17 == 0, None).otherwise(F.col("approved")).alias("approved"),
                                F.when(s % 5 == 0, " UNK ").when(s % 5 == 1, "").when(s % 5 == 2, F.concat("device_id", F.lit(" "))).otherwise(F.col("device_id")).alias("device_id"), F.when(s % 5 < 2, "n/a").otherwise(F.col("ip_id")).alias("ip_id"),
                                F.when(s % 10 == 0, "-").otherwise(F.col("bin_id")).alias("bin_id"), F.when(s % 10 == 0, None).otherwise(F.col("email_domain")).alias("email_domain"), "ts_s")


@query(f"WITH {EV}, {DIRTY} SELECT seq, {KEY_SQL.format('device_id')} AS device_id, {KEY_SQL.format('ip_id')} AS ip_id FROM dirty")
def null_marker_normalise(spark, d):
    return _dirty(spark, d).select("seq", features.entity_key(F.col("device_id")).alias("device_id"), features.entity_key(F.col("ip_id")).alias("ip_id"))


REASONS_SQL = f"""{EV}, {DIRTY}, why AS (SELECT seq, concat_ws(',', CASE WHEN amount IS NULL OR NOT isfinite(amount) THEN 'amount not finite' END, CASE WHEN approved IS NULL THEN 'approved is null' END,
  CASE WHEN {' AND '.join('(' + KEY_SQL.format(c) + ') IS NULL' for c in attempts.RELATIONS)} THEN 'no usable entity' END) AS reasons FROM dirty)"""


@query(f"WITH {REASONS_SQL} SELECT seq, reasons FROM why WHERE reasons <> ''")
def quarantine_reasons(spark, d):
    x = _dirty(spark, d)
    return x.select("seq", F.array_join(features.reasons(x), ",").alias("reasons")).where("reasons != ''")


@query(f"WITH {REASONS_SQL} SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM why WHERE reasons <> '') GROUP BY 1")
def quarantine_counts(spark, d):
    x = _dirty(spark, d)
    return x.select(F.explode(features.reasons(x)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""WITH {MET}, g AS (SELECT score, sum(y) AS p, count(*) AS n FROM met GROUP BY 1), c AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS al, sum(p) OVER () AS t FROM g)
SELECT round(sum(p / t::DOUBLE * tp / al::DOUBLE), 6) AS average_precision FROM c""")
def average_precision(spark, d):
    return metrics.average_precision(attempts.from_labels(spark, d), "score", "y").select(_r("average_precision").alias("average_precision"))


REL_SQL = f"""{MET}, e AS (SELECT (score >= 0.1) ::INT + (score >= 0.2)::INT + (score >= 0.30000000000000004::DOUBLE)::INT + (score >= 0.4)::INT + (score >= 0.5)::INT + (score >= 0.6000000000000001::DOUBLE)::INT
  + (score >= 0.7000000000000001::DOUBLE)::INT + (score >= 0.8)::INT + (score >= 0.9)::INT AS bin, score, y FROM met),
rel AS (SELECT b.bin, avg(score) AS mean_score, avg(y::DOUBLE) AS mean_label, count(score) AS n FROM (SELECT CAST(unnest(range(10)) AS INTEGER) AS bin) b LEFT JOIN e ON e.bin = b.bin GROUP BY 1)"""


@query(f"WITH {REL_SQL} SELECT bin, round(mean_score, 6) AS mean_score, round(mean_label, 6) AS mean_label, n FROM rel")
def reliability_bins(spark, d):
    return metrics.reliability(attempts.from_labels(spark, d), "score", "y").select("bin", _r("mean_score").alias("mean_score"), _r("mean_label").alias("mean_label"), "n")


@query(f"WITH {REL_SQL} SELECT round(sum(abs(mean_score - mean_label) * n) / sum(n)::DOUBLE, 6) AS ece FROM rel WHERE n > 0")
def ece(spark, d):
    return metrics.calibration_error(metrics.reliability(attempts.from_labels(spark, d), "score", "y")).select(_r("ece").alias("ece"))


COST_SQL = f"""{MET}, c AS (SELECT DISTINCT round_even(score, 4) AS threshold FROM met),
cost AS (SELECT threshold, CAST(count(*) FILTER (score < threshold AND y = 1) AS BIGINT) AS missed, CAST(count(*) FILTER (score >= threshold AND y = 0) AS BIGINT) AS false_alarms FROM c, met GROUP BY 1)"""


@query(f"WITH {COST_SQL} SELECT threshold, missed * 73.0::DOUBLE + false_alarms * 40.0::DOUBLE AS cost FROM cost ORDER BY cost, threshold LIMIT 1")
def cost_optimal_threshold(spark, d):
    return metrics.best_threshold(metrics.threshold_costs(attempts.from_labels(spark, d), "score", "y"))


@query(f"WITH {COST_SQL} SELECT threshold, missed, false_alarms, missed * 73.0::DOUBLE + false_alarms * 40.0::DOUBLE AS cost FROM cost")
def threshold_costs(spark, d):
    return metrics.threshold_costs(attempts.from_labels(spark, d), "score", "y")


CONF_SQL = f"""{EV}, k AS (SELECT count(*) FILTER (score >= 0.9::DOUBLE AND label = 1) AS tp, count(*) FILTER (score >= 0.9::DOUBLE AND label = 0) AS fp, count(*) FILTER (score < 0.9::DOUBLE AND label = 1) AS fn FROM ev)"""


@query(f"WITH {CONF_SQL} SELECT tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, fn * 73.0::DOUBLE + fp * 40.0::DOUBLE AS decision_cost FROM k")
def confusion_metrics(spark, d):
    return metrics.confusion(_ev(spark, d), _alert(), F.col("label") == 1).withColumn("precision", _r("precision")).withColumn("recall", _r("recall"))


@query(f"""WITH {EV}, f AS (SELECT *, min(CASE WHEN score >= 0.9::DOUBLE THEN ts_s END) OVER (PARTITION BY campaign_id) AS first FROM ev WHERE campaign_id IS NOT NULL)
SELECT campaign_id, count(*) AS attempts, round(min(first) - min(ts_s), 6) AS detect_s, count(*) * 73.0::DOUBLE AS exposure, count(*) FILTER (ts_s > first) * 73.0::DOUBLE AS prevented FROM f GROUP BY 1""")
def detection_times(spark, d):
    return metrics.detection(_ev(spark, d), _alert()).withColumn("detect_s", _r("detect_s"))


CHECKPOINTS = (3600.0, 86_400.0, 604_800.0, 2_419_200.0)


@query(f"""WITH {EV}, o AS (SELECT min(ts_s) AS onset FROM ev WHERE campaign_id = 'c0'), t AS (SELECT unnest([3600.0::DOUBLE, 86400.0, 604800.0, 2419200.0]) AS t_seconds),
k AS (SELECT t_seconds, count(*) FILTER (score >= 0.9::DOUBLE AND label = 1) AS tp, count(*) FILTER (score >= 0.9::DOUBLE AND label = 0) AS fp, count(*) FILTER (score < 0.9::DOUBLE AND label = 1) AS fn FROM ev, o, t WHERE ts_s <= onset + t_seconds GROUP BY 1)
SELECT t_seconds, tp, fp, fn, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall FROM k""")
def latency_curve(spark, d):
    got = metrics.latency_curve(_ev(spark, d), _alert(), "c0", CHECKPOINTS)
    return got.withColumn("precision", _r("precision")).withColumn("recall", _r("recall"))


@query(f"WITH {EV} SELECT bin_id, round(quantile_cont(amount, 0.5), 6) AS median, round(quantile_cont(amount, 0.025), 6) AS low, round(quantile_cont(amount, 0.975), 6) AS high FROM ev GROUP BY 1")
def metric_medians(spark, d):
    return metrics.quantiles(_ev(spark, d), ["bin_id"], "amount").select("bin_id", _r("median").alias("median"), _r("low").alias("low"), _r("high").alias("high"))


@query(f"WITH {EV} SELECT bin_id, count(*) FILTER (email_domain = 'click') AS click, count(*) FILTER (email_domain = 'view') AS view, count(*) FILTER (email_domain = 'error') AS error FROM ev GROUP BY 1")
def metric_pivot(spark, d):
    got = _ev(spark, d).groupBy("bin_id").pivot("email_domain", ["click", "view", "error"]).agg(F.count("seq"))
    return got.na.fill(0).select("bin_id", "click", "view", "error")


@query(f"WITH {EV}, c AS (SELECT ip_id, count(*) AS n FROM ev GROUP BY 1), s AS (SELECT n / sum(n) OVER ()::DOUBLE AS share FROM c) SELECT round(max(share), 6) AS top_share, count(*) FILTER (share > 0.01::DOUBLE) AS above_cap, count(*) AS n_values FROM s")
def value_share(spark, d):
    c = _ev(spark, d).groupBy("ip_id").agg(F.count("*").alias("n"))
    t = c.agg(F.sum("n").alias("t"))
    s = c.join(F.broadcast(t)).withColumn("share", F.col("n") / F.col("t"))  # one row
    return s.agg(_r(F.max("share")).alias("top_share"), F.count_if(F.col("share") > 0.01).alias("above_cap"), F.count("*").alias("n_values"))


@query(f"WITH {EV}, c AS (SELECT bin_id, count(*) AS n FROM ev GROUP BY 1) SELECT bin_id AS winner, n FROM c ORDER BY n, bin_id LIMIT 1")
def winner_argmin(spark, d):
    c = _ev(spark, d).groupBy("bin_id").agg(F.count("*").alias("n"))
    return c.agg(F.min_by("bin_id", F.struct("n", "bin_id")).alias("winner"), F.min("n").alias("n"))


@query(f"WITH {EV}, l AS (SELECT ip_id, label FROM ev) SELECT count(*) AS shared_values FROM (SELECT ip_id FROM l WHERE label = 1 INTERSECT SELECT ip_id FROM l WHERE label = 0)")
def shared_label_values(spark, d):
    e = _ev(spark, d)
    return e.where("label = 1").select("ip_id").intersect(e.where("label = 0").select("ip_id")).agg(F.count("*").alias("shared_values"))


RELS = ("device_id", "ip_id", "bin_id", "email_domain")


def _long_sql(rels, gap):
    return f"""{EV}, long AS ({' UNION ALL '.join(f"SELECT seq, ts_s, score, '{r}' AS rel, {r} AS value FROM ev" for r in rels)}),
often AS (SELECT rel, value FROM long GROUP BY 1, 2 HAVING count(*) > greatest(0.02::DOUBLE * (SELECT count(*) FROM ev), 1)),
lk AS (SELECT seq, rel, value, ts_s - lag(ts_s) OVER (PARTITION BY rel, value ORDER BY ts_s, seq) AS gap, ts_s FROM long WHERE score >= 0.9::DOUBLE AND (rel, value) NOT IN (SELECT (rel, value) FROM often)),
sess AS (SELECT seq, rel, value, CAST(sum(CASE WHEN gap > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY rel, value ORDER BY ts_s, seq) AS BIGINT) AS session FROM lk)"""


LONG_SQL = _long_sql(RELS, LINK)


@query(f"WITH {LONG_SQL} SELECT seq, rel, value, session FROM sess")
def link_sessions(spark, d):
    return incidents.sessions(_ev(spark, d), _alert(), RELS, LINK)


@query(f"WITH {EV} SELECT email_domain AS value, count(*) AS n FROM ev GROUP BY 1 HAVING count(*) > greatest(0.02::DOUBLE * (SELECT count(*) FROM ev), 1)")
def link_cap_values(spark, d):
    return incidents.capped_values(_ev(spark, d), "email_domain")


# Components by a recursive walk from every alert over shared sessions.
def _inc_sql(rels, gap):
    return f"""RECURSIVE {_long_sql(rels, gap)}, pairs AS (SELECT DISTINCT a.seq AS a, b.seq AS b FROM sess a JOIN sess b USING (rel, value, session)),
walk AS (SELECT DISTINCT seq AS root, seq FROM sess UNION SELECT walk.root, pairs.b FROM walk JOIN pairs ON pairs.a = walk.seq),
comp AS (SELECT seq, min(root) AS component FROM walk GROUP BY 1),
al AS (SELECT ev.*, coalesce(comp.component, ev.seq) AS component FROM ev LEFT JOIN comp USING (seq) WHERE score >= 0.9::DOUBLE),
inc AS (SELECT component, count(*) AS n_attempts, min(ts_s) AS t_start, max(ts_s) AS t_end, count(DISTINCT device_id) AS n_devices, count(DISTINCT ip_id) AS n_ips, count(DISTINCT bin_id) AS n_bins,
  avg(score) AS mean_score, max(score) AS max_score, avg(label::DOUBLE) AS campaign_share FROM al GROUP BY 1)"""


INC_RELS, GAP = ("device_id", "ip_id"), 3600.0
_INC = _inc_sql(INC_RELS, GAP)


def _incidents(spark, d):
    return incidents.incidents(_ev(spark, d), _alert(), INC_RELS, GAP)


@query(f"WITH {_INC} SELECT component, n_attempts, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end, n_devices, n_ips, n_bins, round(mean_score, 6) AS mean_score, max_score, round(campaign_share, 6) AS campaign_share, campaign_share >= 0.5::DOUBLE AS is_true FROM inc")
def incident_table(spark, d):
    got = _incidents(spark, d)
    return got.select("component", "n_attempts", _r("t_start").alias("t_start"), _r("t_end").alias("t_end"), "n_devices", "n_ips", "n_bins", _r("mean_score").alias("mean_score"), "max_score", _r("campaign_share").alias("campaign_share"), "is_true")


@query(f"WITH {_INC} SELECT component, round(ln(1 + n_attempts), 6) AS log_n_attempts, round(ln(1 + n_devices), 6) AS log_n_devices, round(ln(1 + n_ips), 6) AS log_n_ips, round(ln(1 + n_bins), 6) AS log_n_bins, round(ln(1 + t_end - t_start), 6) AS log_duration, round(mean_score, 6) AS mean_score, max_score, 1.0::DOUBLE AS one FROM inc")
def incident_features(spark, d):
    got = incidents.incident_features(_incidents(spark, d))
    return got.select("component", *[_r(c).alias(c) for c in got.columns if c.startswith("log_")], _r("mean_score").alias("mean_score"), "max_score", "one")


ACTION_SQL = "a(ord, action, friction, harm, stops, minutes) AS (VALUES " + ", ".join(f"({i}, '{n}', {f}::DOUBLE, {h}::DOUBLE, {s}::DOUBLE, {m}::DOUBLE)" for i, (n, f, h, s, m) in enumerate(incidents.ACTIONS)) + ")"
GRID_SQL = f"""{EV}, g AS (SELECT seq, score AS risk, (seq % 400)::DOUBLE AS remaining FROM ev), {ACTION_SQL},
c AS (SELECT seq, ord, action, friction + 9 * minutes + risk * remaining * 73 * (1 - stops) + (1 - risk) * harm AS cost FROM g, a)"""


def _grid(spark, d):
    return _ev(spark, d).select("seq", F.col("score").alias("risk"), (F.col("seq") % 400).cast("double").alias("remaining"))


@query(f"WITH {GRID_SQL} SELECT seq, action, round(cost, 6) AS cost FROM c")
def expected_cost_grid(spark, d):
    return incidents.expected_costs(_grid(spark, d)).select("seq", "action", _r("cost").alias("cost"))


@query(f"WITH {GRID_SQL} SELECT seq, action, round(cost, 6) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY cost, ord) AS rn FROM c WHERE ord < 4) WHERE rn = 1")
def choose_action(spark, d):
    return incidents.choose(_grid(spark, d), "seq").withColumn("cost", _r("cost"))


@query(f"WITH {GRID_SQL}, b AS (SELECT seq, action FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY cost, ord) AS rn FROM c WHERE ord < 4) WHERE rn = 1) SELECT CASE WHEN seq % 2 = 0 AND action <> 'monitor' THEN 'review_only' ELSE action END AS action, count(*) AS n FROM b GROUP BY 1")
def drift_guard(spark, d):
    got = incidents.choose(_grid(spark, d), "seq")
    return got.select(incidents.guarded(F.col("action"), F.col("seq") % 2 == 0).alias("action")).groupBy("action").agg(F.count("*").alias("n"))


SNAP_SQL = f"""{_INC}, rk AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY ts_s, seq) AS rn, count(*) OVER (PARTITION BY component) AS len FROM al), m AS (SELECT unnest([3, 5, 8, 12, 20, 32, 50, 80, 128, 200, 320]) AS m)"""


@query(f"WITH {SNAP_SQL} SELECT component, m, round(max(ts_s) - min(ts_s), 6) AS span_s, count(DISTINCT device_id) AS n_devices, count(DISTINCT ip_id) AS n_ips, round(avg(score), 6) AS mean_score, max(score) AS max_score, max(len) - m AS target FROM rk, m WHERE m < len AND rn <= m GROUP BY component, m")
def snapshots(spark, d):
    e = _ev(spark, d)
    s = incidents.sessions(e, _alert(), INC_RELS, GAP)
    comp = incidents.label(s.select("seq", F.concat_ws("|", "rel", "value", F.col("session").cast("string")).alias("grp")))
    a = e.where(_alert()).join(comp, "seq", "left").withColumn("component", F.coalesce("component", "seq"))
    return incidents.snapshots(a).withColumn("span_s", _r("span_s")).withColumn("mean_score", _r("mean_score"))


SIG_SQL = f"""{EV}, sig AS (SELECT seq, ln(1 + amount) AS log_amount, CASE WHEN approved THEN 0.0::DOUBLE ELSE 1 END AS declined, (count(*) OVER (PARTITION BY device_id))::DOUBLE AS reuse_device, (count(*) OVER (PARTITION BY ip_id))::DOUBLE AS reuse_ip,
  (count(*) OVER (PARTITION BY bin_id))::DOUBLE AS reuse_bin, ln(1 + greatest(ts_s - lag(ts_s, 1, ts_s) OVER (ORDER BY ts_s, seq), 0)) AS log_interarrival FROM ev)"""


@query(f"WITH {SIG_SQL} SELECT seq, round(log_amount, 6) AS log_amount, declined, reuse_device, reuse_ip, reuse_bin, round(log_interarrival, 6) AS log_interarrival FROM sig")
def drift_signature(spark, d):
    return drift.signature(_ev(spark, d)).withColumn("log_amount", _r("log_amount")).withColumn("log_interarrival", _r("log_interarrival"))


PSI_SQL = f"""{SIG_SQL}, l AS ({' UNION ALL '.join(f"SELECT CASE WHEN seq % 3 = 0 THEN 'live' ELSE 'base' END AS which, '{f}' AS feature, {f} AS x FROM sig" for f in drift.FEATURES)}),
e AS (SELECT feature, list_sort(list_distinct([{', '.join(f'quantile_cont(x, {i / 10})' for i in range(11))}])) AS e FROM l WHERE which = 'base' GROUP BY 1),
h AS (SELECT l.feature, which, len(list_filter(e.e[2:len(e.e) - 1], lambda y: l.x >= y)) AS bin, len(e.e) AS edges, count(*) AS n FROM l JOIN e USING (feature) GROUP BY 1, 2, 3, 4),
s AS (SELECT feature, which, bin, edges, n / sum(n) OVER (PARTITION BY feature, which)::DOUBLE AS share FROM h),
p AS (SELECT feature, edges, bin, greatest(coalesce(max(share) FILTER (which = 'base'), 0), 1e-4::DOUBLE) AS b, greatest(coalesce(max(share) FILTER (which = 'live'), 0), 1e-4::DOUBLE) AS l FROM s GROUP BY 1, 2, 3),
psi AS (SELECT feature, sum(CASE WHEN edges >= 3 THEN (l - b) * ln(l / b) ELSE 0 END) AS psi FROM p GROUP BY 1)"""


def _psi(spark, d):
    s = drift.signature(_ev(spark, d))
    return drift.psi(s.where("seq % 3 != 0"), s.where("seq % 3 = 0"))


@query(f"WITH {PSI_SQL} SELECT feature, round(psi, 6) AS psi FROM psi")
def psi_feature(spark, d):
    return _psi(spark, d).select("feature", _r("psi").alias("psi"))


@query(f"WITH {PSI_SQL} SELECT round(avg(psi), 6) AS psi FROM psi")
def psi_overall(spark, d):
    return _psi(spark, d).agg(_r(F.avg("psi")).alias("psi"))


@query(f"WITH {_edges_sql(CAP)}, s AS (SELECT seq, seq % 8 AS shard FROM ev) SELECT rel, count(*) AS edges, CAST(sum(CASE WHEN a.shard = b.shard THEN 1 ELSE 0 END) AS BIGINT) AS kept, round(sum(CASE WHEN a.shard = b.shard THEN 1 ELSE 0 END) / count(*)::DOUBLE, 6) AS share FROM edges JOIN s a ON a.seq = src JOIN s b ON b.seq = dst GROUP BY 1")
def edges_preserved_mod_n(spark, d):
    return partitioning.edges_preserved(_ev(spark, d), F.col("seq") % 8, attempts.MODEL_RELATIONS, DAY, CAP).withColumn("share", _r("share"))


def _replicas():
    return {c: F.substring(c, 2, 30).cast("long") % 4 for c in ENTITIES}


@query(f"""WITH {EV}, p AS (SELECT seq, seq % 4 AS shard FROM ev UNION SELECT seq, length(device_id) + CAST(substr(device_id, 2) AS BIGINT) % 4 - length(device_id) FROM (SELECT *, count(*) OVER (PARTITION BY device_id) AS n FROM ev) WHERE n >= 2
UNION SELECT seq, CAST(substr(ip_id, 2) AS BIGINT) % 4 FROM (SELECT *, count(*) OVER (PARTITION BY ip_id) AS n FROM ev) WHERE n >= 2) SELECT seq, shard FROM p""")
def replication_placements(spark, d):
    return partitioning.placements(_ev(spark, d), F.col("seq") % 4, _replicas())


@query(f"""WITH {EV}, k AS (SELECT seq, {_trail('device_id', DAY)} AS pooled, {_trail('bin_id, device_id', DAY)} AS per_tenant FROM ev) SELECT count(*) AS n, CAST(sum(pooled) AS BIGINT) AS pooled, CAST(sum(per_tenant) AS BIGINT) AS per_tenant, count(*) FILTER (pooled > 3) AS pooled_alerts, count(*) FILTER (per_tenant > 3) AS tenant_alerts FROM k""")
def per_tenant_vs_pooled(spark, d):
    k = _ev(spark, d).withColumn("p", windows.trailing_count("device_id", DAY)).withColumn("t", windows.trailing_count(["bin_id", "device_id"], DAY))
    return k.agg(F.count("*").alias("n"), F.sum("p").alias("pooled"), F.sum("t").alias("per_tenant"), F.count_if(F.col("p") > 3).alias("pooled_alerts"), F.count_if(F.col("t") > 3).alias("tenant_alerts"))


@query(f"""WITH {EV}, f AS (SELECT min(ts_s) AS f FROM ev WHERE score >= 0.9::DOUBLE), t AS (SELECT ev.*, ts_s - f AS rel FROM ev, f),
n AS (SELECT seq, row_number() OVER (ORDER BY ts_s, seq) AS rn FROM t WHERE label = 0 AND NOT rel BETWEEN -3600 AND 7200 AND rel BETWEEN -86400 AND 864000)
SELECT seq, label FROM t WHERE label = 1 OR rel BETWEEN -3600 AND 7200 UNION ALL SELECT n.seq, t.label FROM n JOIN t USING (seq) WHERE (rn - 1) % 4 = 0""")
def replay_rows(spark, d):
    e = _ev(spark, d)
    first = e.where(_alert()).agg(F.min("ts_s")).first()[0]  # one number
    return replay_subset(e, first, -3600.0, 7200.0, (-86_400.0, 864_000.0), slice_s=DAY).select("seq", "label")


W_SELF, BIAS, W_REL, MIX = [[0.5, -0.25], [0.1, 0.3]], [0.05, -0.02], [[[0.2, 0.1], [0.0, 0.4]], [[0.3, -0.1], [0.25, 0.15]]], [0.5, 0.5]


@query(f"""WITH {_edges_sql(CAP)}, x0 AS (SELECT seq, ln(1 + amount) AS a, score AS b FROM ev), m AS (SELECT e.rel, e.dst AS seq, avg(a) AS a, avg(b) AS b FROM edges e JOIN x0 ON x0.seq = e.src GROUP BY 1, 2)
SELECT x.seq, round(greatest(0.5 * x.a - 0.25 * x.b + 0.05 + 0.5 * (0.2 * coalesce(d.a, 0) + 0.1 * coalesce(d.b, 0)) + 0.5 * (0.3 * coalesce(i.a, 0) - 0.1 * coalesce(i.b, 0)), 0), 5) AS h0,
round(greatest(0.1 * x.a + 0.3 * x.b - 0.02 + 0.5 * (0.4 * coalesce(d.b, 0)) + 0.5 * (0.25 * coalesce(i.a, 0) + 0.15 * coalesce(i.b, 0)), 0), 5) AS h1
FROM x0 x LEFT JOIN m d ON d.seq = x.seq AND d.rel = 'device_id' LEFT JOIN m i ON i.seq = x.seq AND i.rel = 'ip_id'""")
def message_pass_layer1(spark, d):
    e = _ev(spark, d).withColumn("x", F.array(F.log1p("amount"), F.col("score")))
    got = links.message_layer(e, "x", ENTITIES, W_SELF, BIAS, W_REL, MIX, DAY)
    return got.select("seq", _r(F.get("h", F.lit(0)), 5).alias("h0"), _r(F.get("h", F.lit(1)), 5).alias("h1"))


@query(f"WITH {EV} SELECT round(avg((1 - score) * label * 73 + score * (1 - label) * 40), 6) AS loss FROM ev")
def expected_cost_loss(spark, d):
    return metrics.cost_loss(_ev(spark, d), "score", "label").select(_r("loss").alias("loss"))


@query(f"WITH {EV} SELECT seq, round(1 / (1 + exp(-((amount - 50) / 20.0::DOUBLE * 0.7 + (score - 0.5) / 0.25::DOUBLE * -0.4))), 6) AS risk FROM ev")
def incident_risk_predict(spark, d):
    return _ev(spark, d).select("seq", _r(incidents.risk(("amount", "score"), (50.0, 0.5), (20.0, 0.25), (0.7, -0.4))).alias("risk"))


def queries():
    from . import extended

    return Q | extended.Q


def oracle_sql():
    from . import extended

    return O | extended.O
