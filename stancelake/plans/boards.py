"""Queries over the boards: monitor, movers, overview, committee."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.operators import boards, committee, series
from stancelake.plans.registry import register
from stancelake.plans.roles import OBSERVATIONS_SQL, observations, rounded, rounded_sql
from stancelake.session import table

_two = lambda x: f"round(CAST(round({x}, 9) AS DECIMAL(18, 9)), 2)::DOUBLE + 0.0"

_STANDING = f"""{OBSERVATIONS_SQL},
lm AS (SELECT bank, member, month, arg_max(score, (ts, id)) AS score FROM o GROUP BY ALL),
iv AS (SELECT *, lead(month) OVER (PARTITION BY bank, member ORDER BY month) AS until FROM lm),
sp AS (SELECT bank, unnest(range(min(month), max(month) + 1)) AS month FROM lm GROUP BY bank),
st AS (SELECT sp.bank, CAST(sp.month AS INTEGER) AS month, sum(score::DECIMAL(18,10))::DOUBLE / count(*) AS stance, count(*) AS members FROM sp JOIN iv ON iv.bank = sp.bank AND iv.month <= sp.month AND (iv.until IS NULL OR sp.month < iv.until) GROUP BY ALL),
sd AS (SELECT st.*, st.stance - a.stance AS delta_1m, st.stance - c.stance AS delta_3m FROM st LEFT JOIN st a ON a.bank = st.bank AND a.month = st.month - 1 LEFT JOIN st c ON c.bank = st.bank AND c.month = st.month - 3),
latest AS (SELECT bank, member, arg_max(score, (ts, id)) AS score, max(ts) AS ts FROM o GROUP BY ALL),
bd AS (SELECT bank, avg(score) AS mean, count(*) AS members, count(*) FILTER (score > 0) AS hawks, count(*) FILTER (score < 0) AS doves, max(ts) AS last_spoke FROM latest GROUP BY bank),
mon AS (SELECT bd.bank, n.month, {_two('n.stance')} AS stance, {_two('n.delta_1m')} AS delta_1m, {_two('n.delta_3m')} AS delta_3m, bd.members, hawks, doves,
          least(hawks, doves) > 0 AND least(hawks, doves) * 2 >= greatest(hawks, doves) AS divided, last_spoke
        FROM bd JOIN (SELECT * FROM sd QUALIFY row_number() OVER (PARTITION BY bank ORDER BY month DESC) = 1) n USING (bank))"""


def _monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = boards.policy_monitor(observations(spark, sf_dir))
    return found.select("bank", "month", *rounded("stance", "delta_1m", "delta_3m"), "members", "hawks", "doves", "divided", "last_spoke")


@register("policy_monitor", f"WITH {_STANDING} SELECT bank, month, stance, delta_1m, delta_3m, members, hawks, doves, divided, epoch(last_spoke)::BIGINT AS last_spoke, row_number() OVER (ORDER BY stance DESC, members DESC, bank) AS position FROM mon")
def policy_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.sorted_monitor(_monitor(spark, sf_dir)).withColumn("last_spoke", F.unix_timestamp("last_spoke")).withColumn("position", F.col("position").cast("long"))


def _by(key: str) -> None:
    order = {"committee": "hawks - doves DESC, stance DESC", "bank": "bank"}.get(key, f"{key} DESC NULLS LAST")

    @register(f"monitor_sorted_{key}", f"WITH {_STANDING} SELECT bank, stance, delta_1m, delta_3m, row_number() OVER (ORDER BY {order}, members DESC, bank) AS position FROM mon")
    def sorted_by(spark: SparkSession, sf_dir: str) -> DataFrame:
        return boards.sorted_monitor(_monitor(spark, sf_dir), key).select("bank", "stance", "delta_1m", "delta_3m", F.col("position").cast("long").alias("position"))


for _key in ("delta_1m", "delta_3m", "committee", "bank"):
    _by(_key)


@register("standing_series_by_bank", f"WITH {_STANDING} SELECT bank, month, {rounded_sql('stance')}, members, {rounded_sql('delta_1m', 'delta_3m')} FROM sd")
def standing_series_by_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.standings(observations(spark, sf_dir)).select("bank", "month", *rounded("stance"), "members", *rounded("delta_1m", "delta_3m"))


@register("movers_top6", f"""WITH {_STANDING}, mv AS (SELECT *, {_two('stance - delta_1m')} AS prev FROM mon WHERE abs(delta_1m) > 0.02 ORDER BY abs(delta_1m) DESC, bank LIMIT 6)
SELECT bank, prev, stance, delta_1m AS delta, CASE WHEN delta_1m > 0 THEN 'hawk' ELSE 'dove' END AS side,
  CASE WHEN delta_1m > 0 THEN CASE WHEN prev > 0.02 THEN 'extending hawkish' ELSE 'turning hawkish' END WHEN prev < -0.02 THEN 'extending dovish' ELSE 'turning dovish' END AS word,
  round(abs(delta_1m) / max(abs(delta_1m)) OVER () * 100, 1) AS width FROM mv""")
def movers_top6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.movers(_monitor(spark, sf_dir)).withColumn("prev", F.col("prev") + F.lit(0.0))


@register("kpi_extremes", f"""WITH {_STANDING} SELECT (SELECT bank FROM mon ORDER BY stance DESC, bank LIMIT 1) AS most_hawkish, (SELECT max(stance) FROM mon) AS highest,
  (SELECT bank FROM mon ORDER BY stance, bank LIMIT 1) AS most_dovish, (SELECT min(stance) FROM mon) AS lowest,
  (SELECT bank FROM mon WHERE abs(delta_1m) > 0.02 ORDER BY abs(delta_1m) DESC, bank LIMIT 1) AS moved_most, (SELECT max(abs(delta_1m)) FROM mon WHERE abs(delta_1m) > 0.02) AS largest_move""")
def kpi_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.kpi_extremes(_monitor(spark, sf_dir))


@register("bank_boards", f"WITH {_STANDING} SELECT bank, {rounded_sql('mean')}, members, hawks, doves, least(hawks, doves) > 0 AND least(hawks, doves) * 2 >= greatest(hawks, doves) AS divided FROM bd")
def bank_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = boards.bank_boards(boards.latest_per_member(observations(spark, sf_dir)))
    return found.select("bank", *rounded("mean"), "members", "hawks", "doves", "divided")


@register("board_ranking", f"WITH {_STANDING} SELECT bank, member, score, CAST(row_number() OVER (PARTITION BY bank ORDER BY score DESC, member) AS INTEGER) AS rank FROM latest")
def board_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.ranked_members(boards.latest_per_member(observations(spark, sf_dir))).select("bank", "member", "score", "rank")


@register("corpus_overview", f"WITH {OBSERVATIONS_SQL} SELECT count(DISTINCT member) AS speakers, count(DISTINCT id % 997) AS speeches, count(*) AS observations, count(*) FILTER (needs_review) AS flagged, count(DISTINCT bank) AS banks, epoch(min(ts))::BIGINT AS first, epoch(max(ts))::BIGINT AS last FROM o")
def corpus_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.corpus_overview(observations(spark, sf_dir).withColumn("url", F.col("id") % 997)).withColumn("first", F.unix_timestamp("first")).withColumn("last", F.unix_timestamp("last"))


@register("desk_read", f"""WITH {_STANDING}, m AS (SELECT month, sum(score) AS total, count(*) AS n FROM o GROUP BY month ORDER BY month DESC LIMIT 4),
r AS (SELECT max(month) AS month, sum(total) FILTER (month = (SELECT max(month) FROM m)) / sum(n) FILTER (month = (SELECT max(month) FROM m)) AS now,
  sum(total) FILTER (month < (SELECT max(month) FROM m)) / sum(n) FILTER (month < (SELECT max(month) FROM m)) AS prior FROM m)
SELECT month, {rounded_sql('now', 'prior')}, 'The central-bank chorus is ' || CASE WHEN now > 0.08 THEN 'leaning hawkish' WHEN now < -0.08 THEN 'leaning dovish' ELSE 'broadly neutral' END
  || CASE WHEN prior IS NULL THEN '' WHEN now - prior > 0.05 THEN ' and drifting hawkish' WHEN now - prior < -0.05 THEN ' and drifting dovish' ELSE ' and holding steady' END || '.' AS headline,
  (SELECT bank FROM bd ORDER BY mean DESC, bank LIMIT 1) AS hawk_bank, (SELECT bank FROM bd ORDER BY mean, bank LIMIT 1) AS dove_bank FROM r""")
def desk_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.desk_read(observations(spark, sf_dir)).select("month", *rounded("now", "prior"), "headline", "hawk_bank", "dove_bank")


@register("recent_changes", f"""WITH {OBSERVATIONS_SQL}, c AS (SELECT *, 'https://example.org/' || (id % 997) AS url, {_two('score - lag(score) OVER (PARTITION BY member ORDER BY ts, id)')} AS change FROM o)
SELECT id, member, url, score, change FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts DESC, id DESC) = 1) ORDER BY ts DESC, id DESC LIMIT 10""")
def recent_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).withColumn("url", F.concat(F.lit("https://example.org/"), (F.col("id") % 997).cast("string")))
    return boards.recent_changes(rows).select("id", "member", "url", "score", (F.col("change") + F.lit(0.0)).alias("change"))


@register("flagged_splits", f"""WITH {OBSERVATIONS_SQL} SELECT id, bank, score, lexicon_score, round(abs(score - lexicon_score), 9) AS gap,
  id % 3 <> 0 AND (score * lexicon_score < 0 OR abs(score - lexicon_score) >= 0.5) AS disagree FROM o WHERE needs_review ORDER BY abs(score - lexicon_score) DESC, id LIMIT 8""")
def flagged_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = boards.flagged_splits(observations(spark, sf_dir))
    return found.select("id", "bank", "score", "lexicon_score", *rounded("gap"), boards.disagrees(F.col("score"), F.col("lexicon_score"), F.col("id") % 3 != 0).alias("disagree"))


_LAST_SQL = f"""WITH {OBSERVATIONS_SQL}, a AS (SELECT bank, arg_max(id, (ts, id)) AS ask, max(ts) AS as_of FROM o GROUP BY bank),
h AS (SELECT ask, o.bank, member, score, row_number() OVER (PARTITION BY ask, member ORDER BY ts DESC, id DESC) AS nth FROM o JOIN a ON o.bank = a.bank AND ts <= as_of),
p AS (SELECT ask, bank, member, max(score) FILTER (nth = 1) AS score, max(score) FILTER (nth = 2) AS previous, count(*) AS readings FROM h GROUP BY ALL),
d AS (SELECT *, score - previous AS delta FROM p)"""

_EVERY_SQL = f"""WITH {OBSERVATIONS_SQL}, n AS (SELECT *, lag(score) OVER (PARTITION BY bank, member ORDER BY ts, id) AS previous FROM o),
r AS (SELECT bank, member, ts, arg_max(score, id) AS score, arg_max(struct_pack(p := previous), id).p AS previous FROM n GROUP BY ALL),
i AS (SELECT DISTINCT bank, ts FROM o), q AS (SELECT i.bank, i.ts, m.member FROM i JOIN (SELECT DISTINCT bank, member FROM o) m USING (bank)),
j AS (SELECT q.bank, q.ts, r.score, r.score - r.previous AS delta FROM q ASOF JOIN r ON q.bank = r.bank AND q.member = r.member AND q.ts >= r.ts),
k AS (SELECT bank, ts, avg(score) AS standing, avg(delta) AS overall_move, count(*) AS members, count(delta) AS with_change, count(*) FILTER (abs(delta) > 0.02) AS movers FROM j GROUP BY bank, ts)
SELECT o.id AS ask, o.bank, {rounded_sql('standing', 'overall_move')}, members, with_change, movers FROM o JOIN k ON o.bank = k.bank AND o.ts = k.ts"""


@register("committee_movement", _LAST_SQL + f" SELECT ask, bank, member, score, previous, {rounded_sql('delta')}, readings, CAST(row_number() OVER (PARTITION BY ask ORDER BY delta IS NULL, abs(delta) DESC, CAST(member AS VARCHAR)) AS INTEGER) AS place FROM d")
def committee_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every member of every bank at the bank's last observation."""
    rows = observations(spark, sf_dir)
    asked = rows.groupBy("bank").agg(F.max(F.struct("ts", "id")).alias("last")).select(F.col("last.id").alias("ask"), "bank", F.col("last.ts").alias("as_of"))
    return committee.movement(rows, asked).select("ask", "bank", "member", "score", "previous", *rounded("delta"), "readings", "place")


def _every(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = committee.every_summary(observations(spark, sf_dir))
    return found.select("ask", "bank", *rounded("standing", "overall_move"), "members", "with_change", "movers")


@register("committee_movement_bulk", _EVERY_SQL)
def committee_movement_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked at every observation, by running sums of changes."""
    return _every(spark, sf_dir)


@register("committee_movement_every", _EVERY_SQL)
def committee_movement_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name that this had beside a query over fewer points."""
    return _every(spark, sf_dir)


@register("search_speakers", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_name), '00012') OR contains(lower(c_mktsegment), '00012')")
def search_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.search(table(spark, sf_dir, "customer"), " 00012 ", "c_name", "c_mktsegment").select("c_custkey", "c_name", "c_mktsegment")


@register("solo_speakers", "SELECT c_custkey, name FROM (SELECT c_custkey, c_name || CASE WHEN c_custkey % 7 = 0 THEN '; Guest' WHEN c_custkey % 11 = 0 THEN ', Jr' ELSE '' END AS name FROM customer) WHERE NOT regexp_matches(name, '[;,]')")
def solo_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.when(F.col("c_custkey") % 7 == 0, "; Guest").when(F.col("c_custkey") % 11 == 0, ", Jr").otherwise("")
    return boards.solo_speakers(table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", suffix).alias("name")))


@register("age_labels", """SELECT o_orderkey AS id, CASE WHEN d <= 0 THEN 'today' WHEN d < 14 THEN d || 'd ago' WHEN d < 60 THEN (d // 7) || 'w ago' WHEN d < 365 THEN (d // 30) || 'mo ago' ELSE (d // 365) || 'y ago' END AS age
FROM (SELECT o_orderkey, CAST(floor((epoch(TIMESTAMP '2001-08-01 12:00:00') - epoch(o_orderdate)) / 86400) AS INTEGER) AS d FROM orders)""")
def age_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock = F.lit("2001-08-01 12:00:00").cast("timestamp")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), boards.age_label(F.col("o_orderdate"), clock).alias("age"))
