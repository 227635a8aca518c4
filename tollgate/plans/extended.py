"""Queries of the gated network, sharded scoring, snapshots, forecasts and policies, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift, forecast, incidents, links, metrics, partitioning, policies, windows
from ..functions import features
from ..sources import attempts, json_lines
from . import catalog
from .catalog import CAP, DAY, ENTITIES, EV, LINK, _edges_sql, _ev, _r

Q, O = {}, {}


def query(sql: str):
    def add(f):
        Q[f.__name__], O[f.__name__] = f, sql
        return f
    return add


# Three gated layers of width two over two relations, with fixed weights.
LAYERS = [
    {"self": [[0.5, -0.25], [0.1, 0.3]], "bias": [0.05, -0.02], "rel": [[[0.2, 0.1], [0.0, 0.4]], [[0.3, -0.1], [0.25, 0.15]]], "att": [0.3, -0.2], "gate": [[0.6, -0.4], [0.2, 0.5]]},
    {"self": [[0.3, 0.2], [-0.1, 0.6]], "bias": [0.0, 0.1], "rel": [[[0.1, 0.3], [0.2, -0.1]], [[0.15, 0.05], [0.1, 0.2]]], "att": [0.0, 0.5], "gate": [[0.1, 0.2], [-0.3, 0.4]]},
    {"self": [[0.4, 0.1], [0.2, 0.2]], "bias": [0.02, 0.03], "rel": [[[0.25, 0.0], [0.05, 0.3]], [[0.2, 0.1], [0.0, 0.1]]], "att": [-0.1, 0.1], "gate": [[0.3, 0.3], [0.2, -0.2]]},
]


def _layer_sql(i: int, layer: dict) -> str:
    x, (m0, m1) = f"x{i}", links.softmax(layer["att"])
    gate = {r: f"1 / (1 + exp(-({g[0]!r}::DOUBLE * abs(s.a - t.a) + {g[1]!r}::DOUBLE * abs(s.b - t.b))))" for r, g in zip(ENTITIES, layer["gate"])}
    parts = " UNION ALL ".join(f"SELECT '{r}' AS rel, e.dst AS seq, {gate[r]} AS g, s.a, s.b FROM edges e JOIN {x} s ON s.seq = e.src JOIN {x} t ON t.seq = e.dst WHERE e.rel = '{r}'" for r in ENTITIES)
    row = lambda k: (f"{layer['self'][k][0]!r} * x.a + {layer['self'][k][1]!r} * x.b + {layer['bias'][k]!r}"
                     + "".join(f" + {m!r}::DOUBLE * ({w[k][0]!r} * coalesce({t}.a, 0) + {w[k][1]!r} * coalesce({t}.b, 0))" for m, w, t in zip((m0, m1), layer["rel"], ("d", "p"))))
    return f"""e{i} AS ({parts}), m{i} AS (SELECT rel, seq, sum(g * a) / greatest(sum(g), 1) AS a, sum(g * b) / greatest(sum(g), 1) AS b FROM e{i} GROUP BY 1, 2),
x{i + 1} AS (SELECT x.seq, greatest({row(0)}, 0)::DOUBLE AS a, greatest({row(1)}, 0)::DOUBLE AS b FROM {x} x LEFT JOIN m{i} d ON d.seq = x.seq AND d.rel = 'device_id' LEFT JOIN m{i} p ON p.seq = x.seq AND p.rel = 'ip_id')"""


def _net_sql(depth: int) -> str:
    return f"WITH {_edges_sql(CAP)}, x0 AS (SELECT seq, ln(1 + amount) AS a, score AS b FROM ev), " + ", ".join(_layer_sql(i, l) for i, l in enumerate(LAYERS[:depth])) + f" SELECT seq, round(a, 5) AS h0, round(b, 5) AS h1 FROM x{depth}"


def _net(spark, d, depth: int):
    e = _ev(spark, d).select("seq", "ts_s", *ENTITIES, F.array(F.log1p("amount"), F.col("score")).alias("x0"))
    for i, l in enumerate(LAYERS[:depth]):
        e = links.message_layer(e, f"x{i}", ENTITIES, l["self"], l["bias"], l["rel"], links.softmax(l["att"]), DAY, CAP, f"x{i + 1}", gate=l["gate"]).drop(f"x{i}")
    return e.select("seq", _r(F.get(f"x{depth}", F.lit(0)), 5).alias("h0"), _r(F.get(f"x{depth}", F.lit(1)), 5).alias("h1"))


@query(_net_sql(1))
def message_pass_gated(spark, d):
    return _net(spark, d, 1)


@query(_net_sql(3))
def message_pass_gated_3(spark, d):
    return _net(spark, d, 3)


# Links over values that mark absence in two of five rows: those rows have none.
CLEAN_SQL = f"""{EV}, {catalog.DIRTY}, keys AS ({" UNION ALL ".join(f"SELECT '{r}' AS rel, {catalog.KEY_SQL.format(r)} AS key, seq, ts_s FROM dirty" for r in ("device_id", "ip_id", "bin_id"))}),
rn AS (SELECT *, row_number() OVER (PARTITION BY rel, key ORDER BY ts_s, seq) AS rn FROM keys WHERE key IS NOT NULL),
le AS (SELECT b.rel, b.key, a.seq AS src, b.seq AS dst FROM rn b JOIN rn a ON a.rel = b.rel AND a.key = b.key AND a.rn < b.rn AND a.rn >= b.rn - {CAP} AND a.ts_s >= b.ts_s - {DAY})"""


@query(f"WITH {CLEAN_SQL} SELECT rel, src, dst FROM le")
def edges_markers(spark, d):
    return links.edges(catalog._dirty(spark, d), ("device_id", "ip_id", "bin_id"), DAY, CAP)


@query(f"""WITH {CLEAN_SQL}, k AS (SELECT rel, key, dst AS seq, count(*) AS k FROM le GROUP BY 1, 2, 3), n AS (SELECT rel, key, count(*) AS n FROM rn GROUP BY 1, 2),
s AS (SELECT seq, sum(k / ln(1 + n::DOUBLE)) AS s FROM k JOIN n USING (rel, key) GROUP BY 1) SELECT dirty.seq, round(coalesce(s, 0), 6) AS shared FROM dirty LEFT JOIN s USING (seq)""")
def shared_entity_markers(spark, d):
    return links.shared_entity_score(catalog._dirty(spark, d), ("device_id", "ip_id", "bin_id"), DAY, CAP).select("seq", _r("shared").alias("shared"))


@query(f"""WITH {CLEAN_SQL}, c AS (SELECT rel, seq, count(*) OVER (PARTITION BY rel, key ORDER BY ts_s RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY rel, key, ts_s) + row_number() OVER (PARTITION BY rel, key, ts_s ORDER BY seq) AS c FROM keys WHERE key IS NOT NULL)
SELECT dirty.seq, CAST(coalesce(max(greatest(c - CASE rel WHEN 'device_id' THEN 2 WHEN 'ip_id' THEN 3 END, 0)), 0) AS BIGINT) AS velocity FROM dirty LEFT JOIN c ON c.seq = dirty.seq AND rel <> 'bin_id' GROUP BY 1""")
def velocity_markers(spark, d):
    return windows.multi_velocity(catalog._dirty(spark, d), {"device_id": 2, "ip_id": 3}, DAY).select("seq", F.col("velocity").cast("long"))


SHARED = "round(sum(k / ln(1 + n::DOUBLE)), 6)"


def _shard_sql(placed: str) -> str:
    """Links and key counts within shards, for placements (seq, shard)."""
    return f"""WITH {EV}, pl AS ({placed}), long AS (SELECT x.*, shard FROM (SELECT 'device_id' AS rel, device_id AS key, seq, ts_s FROM ev UNION ALL SELECT 'ip_id', ip_id, seq, ts_s FROM ev) x JOIN pl USING (seq)),
r AS (SELECT *, row_number() OVER (PARTITION BY rel, shard, key ORDER BY ts_s, seq) AS rn, count(*) OVER (PARTITION BY rel, shard, key) AS n FROM long),
k AS (SELECT b.seq, b.shard, b.rel, any_value(b.n) AS n, count(a.seq) AS k FROM r b LEFT JOIN r a ON a.rel = b.rel AND a.shard = b.shard AND a.key = b.key AND a.rn < b.rn AND a.rn >= b.rn - {CAP} AND a.ts_s >= b.ts_s - {DAY} GROUP BY 1, 2, 3),
s AS (SELECT seq, shard, sum(k / ln(1 + n::DOUBLE)) AS shared FROM k GROUP BY 1, 2)"""


def _shared(d, also):
    return links.shared_entity_score(d, ENTITIES, DAY, CAP, also).withColumnRenamed("shared", "score_")


def _sharded(spark, d, placed):
    got = partitioning.score_sharded(_ev(spark, d).drop("score"), placed, _shared, "score_")
    return got.select("seq", _r("score_").alias("score"), "copies")


@query(_shard_sql("SELECT seq, seq % 8 AS shard FROM ev") + " SELECT seq, round(max(shared), 6) AS score, count(*) AS copies FROM s GROUP BY 1")
def score_sharded(spark, d):
    return _sharded(spark, d, _ev(spark, d).select("seq", (F.col("seq") % 8).alias("shard")))


PLACED_SQL = catalog.O["replication_placements"].split("SELECT seq, shard FROM p")[0].split(", p AS (", 1)[1].rsplit(")", 1)[0]


@query(_shard_sql(PLACED_SQL) + " SELECT seq, round(max(shared), 6) AS score, count(*) AS copies FROM s GROUP BY 1")
def score_replicated(spark, d):
    return _sharded(spark, d, catalog.replication_placements(spark, d))


@query(f"WITH {_edges_sql(CAP)}, p AS ({PLACED_SQL}) SELECT rel, count(*) AS edges, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM p a JOIN p b ON a.shard = b.shard WHERE a.seq = src AND b.seq = dst) THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM edges GROUP BY 1")
def edges_surviving_replication(spark, d):
    e = partitioning.places(_ev(spark, d), F.col("seq") % 4, catalog._replicas())
    return partitioning.edges_surviving(e, F.col("places"), attempts.MODEL_RELATIONS, DAY, CAP).select("rel", "edges", "kept")


# Snapshots of long groups: every user's events stand for an incident.
SNAP_SQL = f"""m AS (SELECT unnest([{', '.join(map(str, incidents.SNAPSHOT_SIZES))}]) AS m), x AS (SELECT rk.*, m, greatest(m // 2, 1) AS half FROM rk, m WHERE m < len AND rn <= m),
g AS (SELECT component, m, max(half)::DOUBLE AS half, min(ts_s) AS t0, max(ts_s) AS t1, max(CASE WHEN rn = half THEN ts_s END) AS th, avg(score) AS ms, avg(CASE WHEN rn > half THEN score END) AS late, avg(CASE WHEN rn <= half THEN score END) AS early,
  avg(CASE WHEN approved THEN 0.0::DOUBLE ELSE 1 END) AS dr, count(DISTINCT device_id)::DOUBLE AS nd, count(DISTINCT ip_id)::DOUBLE AS ni, count(DISTINCT bin_id)::DOUBLE AS nb, (max(len) - m)::DOUBLE AS remaining FROM x GROUP BY 1, 2)"""
SNAP_COLS = """component, m, m::DOUBLE AS n_observed, round(ln(1 + m::DOUBLE), 6) AS log_n, round(t1 - t0, 6) AS age_s, round(ln(1 + t1 - t0), 6) AS log_age, round(m / greatest(t1 - t0, 1), 6) AS rate,
round(half / greatest(t1 - th, 1e-6::DOUBLE) / greatest(half / greatest(th - t0, 1e-6::DOUBLE), 1e-9::DOUBLE), 4) AS rate_trend, round(ms, 6) AS mean_score, round(coalesce(late - early, 0), 6) AS score_trend, round(dr, 6) AS decline_ratio,
nd AS n_devices, ni AS n_ips, nb AS n_bins, round(m / greatest(nd + ni + nb, 1), 6) AS entity_density, remaining, round(t1, 6) AS t_snapshot"""
GROUP_SQL = f"""{EV}, rk AS (SELECT *, CAST(substr(device_id, 2) AS BIGINT) AS component, row_number() OVER (PARTITION BY device_id ORDER BY ts_s, seq) AS rn, count(*) OVER (PARTITION BY device_id) AS len FROM ev), {SNAP_SQL}"""
# Incidents over all four relations, linked up to a day apart, so that alerts do merge.
MERGED_SQL = catalog._inc_sql(catalog.RELS, DAY)


def _groups(spark, d):
    return _ev(spark, d).withColumn("component", F.substring("device_id", 2, 20).cast("long"))


def _snapshot_columns(got, *more):
    six = ("age_s", "log_n", "log_age", "rate", "mean_score", "score_trend", "decline_ratio", "entity_density", "t_snapshot")
    return got.select("component", "m", "n_observed", *[_r(c).alias(c) for c in six], _r("rate_trend", 4).alias("rate_trend"), "n_devices", "n_ips", "n_bins", "remaining", *more)


@query(f"WITH {GROUP_SQL} SELECT {SNAP_COLS} FROM g")
def snapshot_features(spark, d):
    return _snapshot_columns(incidents.snapshot_features(_groups(spark, d)))


@query(f"WITH {MERGED_SQL} SELECT component, n_attempts, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end, n_devices, n_ips, n_bins, round(mean_score, 6) AS mean_score, max_score, round(campaign_share, 6) AS campaign_share, campaign_share >= 0.5::DOUBLE AS is_true FROM inc")
def incidents_merged(spark, d):
    got = incidents.incidents(_ev(spark, d), catalog._alert(), catalog.RELS, DAY)
    return got.select("component", "n_attempts", _r("t_start").alias("t_start"), _r("t_end").alias("t_end"), "n_devices", "n_ips", "n_bins", _r("mean_score").alias("mean_score"), "max_score", _r("campaign_share").alias("campaign_share"), "is_true")


@query(f"""WITH {MERGED_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY ts_s, seq) AS rn, count(*) OVER (PARTITION BY component) AS len FROM al), {SNAP_SQL},
ids AS (SELECT component, format('events:INC-{{:03d}}', row_number() OVER (ORDER BY t_start, component) - 1) AS incident_id FROM inc) SELECT {SNAP_COLS}, incident_id FROM g JOIN ids USING (component)""")
def snapshots_merged(spark, d):
    return _snapshot_columns(incidents.build_snapshots(_ev(spark, d), "events", catalog._alert(), catalog.RELS, DAY), "incident_id")


FORECAST_SQL = f"{EV}, f AS (SELECT (seq % 60)::DOUBLE AS remaining, (seq % 40)::DOUBLE AS p50, (seq % 40 + seq % 25)::DOUBLE AS p90 FROM ev)"


def _forecasts(spark, d):
    s = F.col("seq")
    return _ev(spark, d).select("seq", (s % 60).cast("double").alias("remaining"), (s % 40).cast("double").alias("p50"), (s % 40 + s % 25).cast("double").alias("p90"))


@query(f"""WITH {FORECAST_SQL} SELECT count(*) AS n_snapshots, round(avg(CASE WHEN remaining <= p90 THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage_upper, round(avg(abs(remaining - p50)), 6) AS mae_p50, median(abs(remaining - p50)) AS median_abs_err_p50,
round(avg(remaining), 6) AS mean_true_remaining, round(avg(p50), 6) AS mean_p50, round(avg(p90), 6) AS mean_upper, round(avg(abs(remaining - p50)) * 73, 6) AS mae_exposure FROM f""")
def forecast_evaluation(spark, d):
    got = forecast.evaluate(_forecasts(spark, d))
    return got.select(*[c if c in ("n_snapshots", "median_abs_err_p50") else _r(c).alias(c) for c in got.columns])


POLICY_SQL = f"""{EV}, {catalog.ACTION_SQL},
i AS (SELECT seq, (seq % 50 + 1) AS n_attempts, score AS risk, (seq % 400) / 2.0::DOUBLE AS p50, (seq % 1400)::DOUBLE AS p90, label = 1 AS is_true, CASE WHEN label = 1 THEN (seq % 60)::DOUBLE ELSE 0 END AS rem FROM ev),
k AS (SELECT i.*, action, ord, friction + 9 * minutes + (1 - risk) * harm AS fixed, risk * 73 * (1 - stops) AS each FROM i, a WHERE ord < 4),
c AS (SELECT seq, any_value(n_attempts) AS n_attempts, any_value(risk) AS risk, any_value(p50) AS p50, any_value(p90) AS p90, any_value(is_true) AS is_true, any_value(rem) AS rem,
  min({{'cost': fixed + each * rem, 'ord': ord, 'action': action}}).action AS oracle, min({{'cost': fixed + each * round_even(p50, 0), 'ord': ord, 'action': action}}).action AS first FROM k GROUP BY seq),
d AS (SELECT *, CASE WHEN p90 > greatest(p50, 1) * 4 AND risk > 0.5 AND first = 'monitor' THEN 'hold_review' ELSE first END AS causal FROM c),
p AS (SELECT d.*, unnest(['always_allow', 'always_hold', 'event_thresholding', 'causal_policy', 'oracle_policy']) AS policy, unnest(['monitor', 'hold_review', causal, causal, oracle]) AS action FROM d),
g AS (SELECT policy, count(*) FILTER (action <> 'monitor') AS incidents_actioned, count(*) FILTER (action <> 'monitor' AND NOT is_true) AS false_incidents, sum(CASE WHEN is_true THEN rem * stops ELSE 0 END) AS stopped, sum(minutes) AS own,
  sum(n_attempts) AS alerts, sum(friction + 9 * minutes + CASE WHEN is_true THEN rem * 73 * (1 - stops) ELSE harm END) AS bill, count(*) FILTER (action = oracle) AS same, count(*) AS formed FROM p JOIN a USING (action) GROUP BY policy),
t AS (SELECT *, CASE WHEN policy = 'event_thresholding' THEN alerts * 0.5::DOUBLE ELSE own END AS mins, round(bill + CASE WHEN policy = 'event_thresholding' THEN alerts * 0.5::DOUBLE * 9 ELSE 0 END, 2) AS cost FROM g)"""


@query(f"""WITH {POLICY_SQL} SELECT policy, incidents_actioned, false_incidents, CAST(round_even(stopped, 0) AS BIGINT) AS campaign_attempts_stopped, round(mins, 1) AS analyst_minutes, cost AS merchant_cost,
  round(cost - (SELECT cost FROM t WHERE policy = 'oracle_policy'), 2) AS regret_vs_oracle, same AS actions_matching_oracle, CAST(alerts AS BIGINT) AS events_alerted, formed AS incidents_formed FROM t""")
def policy_costs(spark, d):
    s = F.col("seq")
    inc = _ev(spark, d).select(s.alias("component"), (s % 50 + 1).alias("n_attempts"), F.col("score").alias("risk"), ((s % 400) / F.lit(2.0)).alias("p50"), (s % 1400).cast("double").alias("p90"), (F.col("label") == 1).alias("is_true"), (s % 60).cast("double").alias("remaining"))
    return policies.evaluate(inc)


@query(f"""WITH {EV}, e AS (SELECT (score >= 0.2)::INT + (score >= 0.4)::INT + (score >= 0.6000000000000001::DOUBLE)::INT + (score >= 0.8)::INT AS bin, score, label FROM ev)
SELECT round((b.bin + 0.5) / 5, 6)::DOUBLE AS bin_mid, round(avg(score), 6) AS predicted, round(avg(label::DOUBLE), 6) AS observed, count(score) AS n FROM (SELECT unnest(range(5)) AS bin) b LEFT JOIN e ON e.bin = b.bin GROUP BY b.bin""")
def incident_reliability(spark, d):
    got = policies.incident_reliability(_ev(spark, d).select(F.col("score").alias("risk"), (F.col("label") == 1).alias("is_true")))
    return got.select(_r("bin_mid").alias("bin_mid"), _r("predicted").alias("predicted"), _r("observed").alias("observed"), "n")


@query(f"WITH {EV}, t AS (SELECT campaign_id, min(ts_s) + 604800 AS t FROM ev WHERE campaign_id IS NOT NULL GROUP BY 1) SELECT campaign_id, round(t, 6) AS t, count(*) FILTER (ts_s > t) AS remaining FROM t JOIN ev USING (campaign_id) GROUP BY 1, 2")
def remaining_after(spark, d):
    e = _ev(spark, d)
    moments = e.where("campaign_id is not null").groupBy("campaign_id").agg((F.min("ts_s") + 604800).alias("t"))
    return policies.remaining_after(e, moments).withColumn("t", _r("t"))


NUM_SQL = f"{EV}, inc AS (SELECT CAST(substr(device_id, 2) AS BIGINT) AS component, min(ts_s) AS t_start, count(*) AS n_attempts, max(score) AS risk, avg(label::DOUBLE) AS purity FROM ev WHERE score >= 0.9 GROUP BY 1)"


def _inc(spark, d):
    return _groups(spark, d).where("score >= 0.9").groupBy("component").agg(F.min("ts_s").alias("t_start"), F.count("*").alias("n_attempts"), F.max("score").alias("risk"))


@query(f"WITH {NUM_SQL} SELECT component, 'INC-' || CASE WHEN rn < 100 THEN lpad(rn::VARCHAR, 3, '0') ELSE rn::VARCHAR END AS incident_id FROM (SELECT component, row_number() OVER (ORDER BY t_start, component) - 1 AS rn FROM inc)")
def incident_numbers(spark, d):
    return incidents.numbered(_inc(spark, d)).select("component", "incident_id")


@query(f"WITH {NUM_SQL} SELECT component, n_attempts, risk FROM inc ORDER BY risk DESC, n_attempts DESC, component LIMIT 1")
def lead_incident(spark, d):
    return incidents.lead(_inc(spark, d)).select("component", "n_attempts", "risk")


@query(f"WITH {EV}, g AS (SELECT CAST(substr(device_id, 2) AS BIGINT) AS component, count(*) AS n, sum(label)::DOUBLE AS hit FROM ev WHERE score >= 0.9 GROUP BY 1) SELECT component, n, round(hit / n, 6) AS purity, round(hit / (SELECT sum(label) FROM ev), 6) AS recall FROM g ORDER BY n DESC, component LIMIT 1")
def largest_group(spark, d):
    e = _groups(spark, d)
    return incidents.largest_group(e.where("score >= 0.9").select("seq", "component"), e).select("component", "n", _r("purity").alias("purity"), _r("recall").alias("recall"))


@query(f"WITH {EV} SELECT round(quantile_cont(amount, 0.5), 6) AS p50, round(quantile_cont(amount, 0.95), 6) AS p95, round(quantile_cont(amount, 0.99), 6) AS p99, round(avg(amount), 6) AS mean, round(count(amount) * 1000 / sum(amount), 6) AS per_s FROM ev")
def latency_percentiles(spark, d):
    got = metrics.latency_percentiles(_ev(spark, d), "amount")
    return got.select(*[_r(c).alias(c) for c in got.columns])


@query(f"WITH {EV}, f AS (SELECT bin_id, count(*) FILTER (score >= 0.9 AND label = 0) AS fp, count(*) FILTER (score >= 0.5 AND label = 0) AS base FROM ev GROUP BY 1) SELECT bin_id, fp, round(CASE WHEN fp > 0 THEN base / fp::DOUBLE END, 6) AS ratio FROM f")
def against_baseline(spark, d):
    e = _ev(spark, d)
    of = lambda t: e.groupBy("bin_id").agg(F.count_if((F.col("score") >= t) & (F.col("label") == 0)).alias("fp"))
    return metrics.against_baseline(of(0.9), of(0.5), "bin_id").select("bin_id", "fp", _r("ratio").alias("ratio"))


TIES = "seq_, l_orderkey, l_linenumber"
LINE_SQL = f"""li AS (SELECT epoch_us(l_shipdate) / 1e6::DOUBLE AS ts_s, l_orderkey * 10 + l_linenumber AS seq, l_linenumber = 1 AS a FROM lineitem),
d AS (SELECT ts_s, count(*) FILTER (a) AS k, min(CASE WHEN a THEN ts_s END) AS t FROM li GROUP BY 1),
b AS (SELECT x.ts_s, coalesce(sum(y.k), 0) AS k, min(y.t) AS t FROM d x LEFT JOIN d y ON y.ts_s < x.ts_s AND y.ts_s >= x.ts_s - {DAY * 7} GROUP BY 1)"""


@query(f"""WITH {LINE_SQL}, u AS (SELECT seq, ts_s, count(*) FILTER (a) OVER w AS k, min(CASE WHEN a THEN ts_s END) OVER w AS t FROM li WINDOW w AS (PARTITION BY ts_s ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT seq, CAST(b.k + u.k AS BIGINT) AS alerts, coalesce(b.t, u.t) AS first_alert_s FROM u JOIN b USING (ts_s)""")
def ring_summary_ties(spark, d):
    l = attempts.table(spark, d, "lineitem")
    e = l.select((F.unix_micros(F.col("l_shipdate").cast("timestamp")) / F.lit(1e6)).alias("ts_s"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_linenumber") == 1).alias("first"))
    return windows.ring_summary(e, F.col("first"), DAY * 7).select("seq", "alerts", "first_alert_s")


@query(f"""WITH {EV}, {catalog.ACTION_SQL}, c AS (SELECT seq, action, ord, round(friction + 9 * minutes + score * (seq % 400) * 73 * (1 - stops) + (1 - score) * harm, 6) AS cost FROM ev, a WHERE ord < 4)
SELECT seq, array_to_string(list(action || '=' || CAST(CAST(round(cost) AS BIGINT) AS VARCHAR) ORDER BY action), ',') AS options FROM c GROUP BY 1""")
def option_costs(spark, d):
    got = incidents.option_costs(catalog._grid(spark, d), "seq")
    pairs = F.transform(F.array_sort(F.map_entries("costs")), lambda x: F.concat(x["key"], F.lit("="), F.round(F.round(x["value"], 6)).cast("long").cast("string")))
    return got.select("seq", F.array_join(pairs, ",").alias("options"))


# Base streams by the rest of seq by 3 (1 and 2), halves by what comes before it; the live stream has rest 0.
DRIFT_SQL = f"""{catalog.SIG_SQL}, lv AS ({' UNION ALL '.join(f"SELECT seq, '{f}' AS feature, {f} AS x FROM sig" for f in drift.FEATURES)}),
v AS (SELECT 'h' || (seq % 3) AS cmp, feature, x, ((seq // 3) % 2 = 0)::INT AS b, ((seq // 3) % 2 = 1)::INT AS l FROM lv WHERE seq % 3 <> 0
  UNION ALL SELECT 'p' || s, feature, x, 1, 0 FROM lv, (SELECT unnest([1, 2]) AS s) WHERE seq % 3 <> 0 UNION ALL SELECT 'p' || (seq % 3), feature, x, 0, 1 FROM lv WHERE seq % 3 <> 0
  UNION ALL SELECT 'live', feature, x, (seq % 3 <> 0)::INT, (seq % 3 = 0)::INT FROM lv),
e AS (SELECT cmp, feature, list_sort(list_distinct([{', '.join(f'quantile_cont(x, {i / 10})' for i in range(11))}])) AS e FROM v WHERE b = 1 GROUP BY ALL),
h AS (SELECT cmp, feature, len(list_filter(e.e[2:len(e.e) - 1], lambda y: v.x >= y)) AS bin, len(e.e) AS edges, sum(b) AS b, sum(l) AS l FROM v JOIN e USING (cmp, feature) GROUP BY ALL),
s AS (SELECT cmp, feature, edges, greatest(b / sum(b) OVER (PARTITION BY cmp, feature)::DOUBLE, 1e-4::DOUBLE) AS b, greatest(l / sum(l) OVER (PARTITION BY cmp, feature)::DOUBLE, 1e-4::DOUBLE) AS l FROM h),
f AS (SELECT cmp, feature, sum(CASE WHEN edges >= 3 THEN (l - b) * ln(l / b) ELSE 0 END) AS psi FROM s GROUP BY ALL),
o AS (SELECT cmp, sum(psi) / 6 AS psi FROM f GROUP BY cmp), t AS (SELECT quantile_cont(psi, 0.95) AS threshold FROM o WHERE cmp <> 'live'),
r AS (SELECT feature, round(avg(x) FILTER (seq % 3 = 0) / avg(x) FILTER (seq % 3 <> 0), 2) AS ratio FROM lv GROUP BY feature)"""


@query(f"""WITH {DRIFT_SQL} SELECT round(psi, 4) AS psi, round(threshold, 4) AS threshold, psi > threshold AS drifted, round(psi / threshold, 2) AS ratio, (SELECT arg_max(feature, psi) FROM f WHERE cmp = 'live') AS largest_shift,
{', '.join(f"(SELECT ratio FROM r WHERE feature = '{c}') AS {c}" for c in drift.REUSE)} FROM o, t WHERE cmp = 'live'""")
def drift_check(spark, d):
    s = drift.signature(_ev(spark, d))
    rest = F.col("seq") % 3
    base = drift.profile(s.where(rest != 0), rest, F.floor(F.col("seq") / 3) % 2 == 0).checkpoint()  # what a store would hold
    got = drift.check(base, drift.threshold(base), s.where(rest == 0))
    return got.select("psi", "threshold", "drifted", "ratio", "largest_shift", *[F.col("reuse_vs_base")[c].alias(c) for c in drift.REUSE])


SWEEP = {"one": "0", "by_bin": "CAST(substring(bin_id, 2) AS INT) % 4", "by_seq": "CAST(floor(seq / 7) % 4 AS INT)"}
SWEEP_SQL = f"""{_edges_sql(CAP)}, pl AS ({' UNION ALL '.join(f"SELECT seq, '{n}' AS routing, {c} AS shard FROM ev" for n, c in SWEEP.items())}),
lg AS (SELECT long.*, routing, shard FROM long JOIN pl USING (seq)), rr AS (SELECT *, row_number() OVER (PARTITION BY routing, shard, rel, key ORDER BY ts_s, seq) AS rn, count(*) OVER (PARTITION BY routing, shard, rel, key) AS n FROM lg),
lk AS (SELECT b.routing, b.seq, count(*) / ln(1 + any_value(b.n)::DOUBLE) AS s FROM rr b JOIN rr a ON a.routing = b.routing AND a.shard = b.shard AND a.rel = b.rel AND a.key = b.key AND a.rn < b.rn AND a.rn >= b.rn - {CAP} AND a.ts_s >= b.ts_s - {DAY} GROUP BY b.routing, b.rel, b.seq),
sc AS (SELECT pl.routing, pl.seq, any_value(ev.label) AS y, coalesce(sum(s), 0) AS score FROM pl JOIN ev USING (seq) LEFT JOIN lk ON lk.routing = pl.routing AND lk.seq = pl.seq GROUP BY 1, 2),
q AS (SELECT routing, count(*) FILTER (score >= 2 AND y = 1) AS tp, count(*) FILTER (score >= 2 AND y <> 1) AS fp, count(*) FILTER (score < 2 AND y = 1) AS fn, count(*) AS n, sum(y) AS pos FROM sc GROUP BY 1),
dd AS (SELECT routing, round(score, 9) AS s, sum(y) AS p, count(*) AS n FROM sc GROUP BY 1, 2),
cu AS (SELECT routing, p, sum(p) OVER w AS tp, sum(n) OVER w AS al FROM dd WINDOW w AS (PARTITION BY routing ORDER BY s DESC)), ap AS (SELECT routing, sum(p / pos::DOUBLE * cu.tp / cu.al) AS ap FROM cu JOIN q USING (routing) GROUP BY 1),
kp AS (SELECT a.routing, e.rel, count(*) AS k FROM edges e JOIN pl a ON a.seq = e.src JOIN pl b ON b.seq = e.dst AND b.routing = a.routing AND b.shard = a.shard GROUP BY 1, 2),
ks AS (SELECT routing, sum(k)::DOUBLE AS k, {', '.join(f"sum(k) FILTER (rel = '{r}')::DOUBLE AS {r}" for r in attempts.MODEL_RELATIONS)} FROM kp GROUP BY 1), al AS (SELECT count(*) AS k, {', '.join(f"count(*) FILTER (rel = '{r}') AS {r}" for r in attempts.MODEL_RELATIONS)} FROM edges),
ld AS (SELECT routing, max(c) AS most FROM (SELECT routing, shard, count(*) AS c FROM pl GROUP BY 1, 2) GROUP BY 1)"""


@query(f"""WITH {SWEEP_SQL} SELECT routing, round(ap, 4) AS pr_auc, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 4) AS precision, round(tp / pos::DOUBLE, 4) AS recall, fp AS false_positives, fn AS missed, round(fn * 73.0::DOUBLE + fp * 40, 1) AS decision_cost,
round(ks.k / al.k, 4) AS edges_kept, {', '.join(f"round(coalesce(ks.{r}, 0) / al.{r}, 4) AS {r[:-3]}_edges_kept" for r in attempts.MODEL_RELATIONS)}, round(most / n::DOUBLE, 4) AS largest_shard_share, 1.0::DOUBLE AS duplication FROM q JOIN ap USING (routing) JOIN ks USING (routing) JOIN ld USING (routing), al""")
def shard_sweep(spark, d):
    e = _ev(spark, d)
    return partitioning.sweep(e, partitioning.routed(e, {n: F.expr(c) for n, c in SWEEP.items()}), attempts.MODEL_RELATIONS, 2.0, DAY, CAP)


# Lines of JSON, some cut short, not JSON at all, without a field, or with null or text in place of a number.
LINE = """CASE WHEN seq % 13 = 0 THEN '{"seq": 1, "ts_s": ' WHEN seq % 17 = 0 THEN 'not json' ELSE '{"seq": ' || CAST(seq AS STRING)
 || CASE WHEN seq % 7 = 0 THEN '' ELSE ', "ts_s": ' || CASE WHEN seq % 11 = 0 THEN '"soon"' ELSE CAST(CAST(ts_s AS BIGINT) AS STRING) END END
 || ', "amount": ' || CASE WHEN seq % 19 = 0 THEN 'null' ELSE CAST(CAST(amount AS BIGINT) AS STRING) END
 || CASE WHEN seq % 5 = 0 THEN '' ELSE ', "approved": ' || CASE WHEN seq % 23 = 0 THEN 'null' WHEN approved THEN 'true' ELSE 'false' END END
 || ', "email_domain": "' || CASE WHEN seq % 3 = 0 THEN '-' ELSE email_domain END || '", "device_id": "' || CASE WHEN seq % 3 = 0 THEN ' UNK ' ELSE device_id END || '", "ip_id": null, "bin_id": "n/a"}' END"""
_KEY = "CASE WHEN lower(trim({0})) IN ('', 'none', 'nan', 'null', 'na', 'n/a', 'unknown', 'unk', '-') THEN NULL ELSE trim({0}) END"
_AT = "json_extract_string(j, '$.{}')"
LINE_SQL = f"""{EV}, ln AS (SELECT seq, TRY_CAST({LINE} AS JSON) AS j FROM ev), why AS (SELECT seq, CASE WHEN j IS NULL THEN ['malformed record'] ELSE list_filter([
  {', '.join(f"CASE WHEN NOT list_contains(json_keys(j), '{f}') THEN 'missing field {f}' END" for f in features.REQUIRED)},
  {', '.join(f"CASE WHEN list_contains(json_keys(j), '{f}') AND TRY_CAST({_AT.format(f)} AS DOUBLE) IS NULL THEN '{f} not finite' END" for f in ("ts_s", "amount"))},
  CASE WHEN list_contains(json_keys(j), 'approved') AND TRY_CAST({_AT.format('approved')} AS BOOLEAN) IS NULL THEN 'approved is null' END,
  CASE WHEN {' AND '.join('(' + _KEY.format(_AT.format(r)) + ') IS NULL' for r in attempts.RELATIONS)} THEN 'no usable entity' END], lambda x: x IS NOT NULL) END AS reasons FROM ln)"""


@query(f"WITH {LINE_SQL} SELECT seq, array_to_string(reasons, '; ') AS reasons FROM why")
def malformed_reasons(spark, d):
    # The line's number comes from the table, as a damaged line can't tell it.
    got = json_lines.parse(_ev(spark, d).select(F.col("seq").alias("line"), F.expr(LINE).alias("value")), keep=("line",))
    return got.select(F.col("line").alias("seq"), F.array_join("reasons", "; ").alias("reasons"))
