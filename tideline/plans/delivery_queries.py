"""Queries over the outbox and delivery: scans, cursors, progress, parking, start positions, pruning, sinks, index, webhooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.images import value_of
from tideline.functions.masks import hmac_pads
from tideline.functions.rules import backoff_ms, clamp, host_allowed, http_outcome, public_target, refusal_class, sink_problems, standby_listed
from tideline.operators import dispatch, outbox, sinks
from tideline.operators.capture import identities
from tideline.operators.keystate import cells, fold_changes, materialize, merge_states
from tideline.plans.sql import over_log
from tideline.sources.change_log import TABLE, change_log

SINKS = [("table", "postgres", 60), ("search", "index", 30), ("hook", "webhook", 90)]


def _sinks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SINKS, "sink_id string, kind string, percent long")


def _cursors(spark: SparkSession, log: DataFrame) -> DataFrame:
    """Three sinks at 60, 30 and 90 percent of every source's head. Both tables are small: sinks and sources."""
    every = outbox.heads(log).withColumn("sink", F.explode(F.array(*[F.struct(F.lit(i).alias("sink_id"), F.lit(p).alias("percent")) for i, _, p in SINKS])))
    return every.select("sink.sink_id", "source", F.expr("head_seq * sink.percent div 100").alias("last_seq"))


def outbox_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.read_range(change_log(spark, sf_dir), "eu", 100, 5000, [TABLE], 200).select("seq", "commit_lsn", "key", "op")


RANGE_SQL = over_log("SELECT seq, commit_lsn, key, op FROM lg WHERE source = 'eu' AND seq > 100 AND commit_lsn >= 5000 ORDER BY seq LIMIT 200")


def outbox_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.heads(change_log(spark, sf_dir))


HEAD_SQL = over_log("SELECT source, max(seq) AS head_seq FROM lg GROUP BY source")


def last_seq_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir)
    asked = log.select("source").distinct().withColumn("lsn", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 100, 1234, 20000, 10**9)])))
    return outbox.last_seq_before(log, asked)


BEFORE_SQL = over_log("""SELECT s.source, CAST(a.lsn AS BIGINT) AS lsn, coalesce((SELECT arg_max(seq, commit_lsn * 1000000000 + seq) FROM lg WHERE lg.source = s.source AND commit_lsn < a.lsn), 0) AS seq
FROM (SELECT DISTINCT source FROM lg) s, (VALUES (0), (100), (1234), (20000), (1000000000)) a(lsn)""")


def outbox_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir)
    return outbox.positions(log, _cursors(spark, log))


POSITION_SQL = over_log("""SELECT sink_id, cu.source, max(seq) AS head_seq, max(commit_lsn) AS head_lsn,
  min(commit_lsn) FILTER (seq > last_seq) AS pending_lsn, arg_min(commit_ms, seq) FILTER (seq > last_seq) AS pending_ms
FROM cu JOIN lg ON cu.source = lg.source GROUP BY sink_id, cu.source""")


def epoch_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of every source written under three epochs, each of which owns the source until the next is claimed."""
    log = change_log(spark, sf_dir).select("source", F.col("seq").alias("at"), (F.col("seq") % 3).alias("epoch"))
    claims = spark.createDataFrame([(s, e, at) for s in ("eu", "us") for e, at in enumerate((0, 300, 600))], "source string, epoch long, at long")
    return outbox.accepted_batches(log, claims).groupBy("source", "epoch").agg(F.count(F.lit(1)).alias("rows"), F.max("at").alias("last"))


FENCE_SQL = over_log("""SELECT source, seq % 3 AS epoch, count(*) AS rows, max(seq) AS last FROM lg
WHERE seq % 3 = CASE WHEN seq >= 600 THEN 2 WHEN seq >= 300 THEN 1 ELSE 0 END GROUP BY source, seq % 3""")


def contiguous_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir)
    unfinished = (F.col("source") == "eu") & (F.col("seq") > 300) & (F.col("seq") % 101 == 0)
    return dispatch.marks(log.select("source", "seq", (~unfinished).alias("finished")))


MARK_SQL = over_log("""SELECT source, coalesce(max(seq) FILTER (seq < coalesce(o, 9000000000000000)), 0) AS mark, count(*) FILTER (u) AS in_flight FROM (
  SELECT *, min(CASE WHEN u THEN seq END) OVER (PARTITION BY source) AS o FROM (SELECT source, seq, source = 'eu' AND seq > 300 AND seq % 101 = 0 AS u FROM lg)) GROUP BY source""")


def cursor_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir)
    cursors = _cursors(spark, log)
    moves = cursors.withColumn("last_seq", F.when(F.col("sink_id") == "table", F.col("last_seq") + 50).otherwise(F.col("last_seq") - 50))
    return dispatch.advance_cursors(cursors, moves)


ADVANCE_SQL = over_log("SELECT sink_id, source, last_seq + CASE WHEN sink_id = 'table' THEN 50 ELSE 0 END AS last_seq FROM cu")


def cursor_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursors after one sink was set back to a position."""
    log = change_log(spark, sf_dir)
    cursors = _cursors(spark, log).withColumn("start_lsn", F.lit(0).cast("long"))
    return dispatch.set_cursors(cursors, dispatch.replay_cursors(log, "table", 10_000))


_BEFORE = "(SELECT source, max(seq) FILTER (commit_lsn < 10000) AS e FROM lg GROUP BY source)"
SET_SQL = over_log(f"""SELECT sink_id, cu.source, CASE WHEN sink_id = 'table' THEN coalesce(e, 0) ELSE last_seq END AS last_seq, CAST(CASE WHEN sink_id = 'table' THEN 10000 ELSE 0 END AS BIGINT) AS start_lsn
FROM cu JOIN {_BEFORE} b ON cu.source = b.source""")


def resume_after_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each sink goes on: the index, which holds nothing any more, from where it was first positioned."""
    log = change_log(spark, sf_dir)
    return dispatch.resume_positions(log, _cursors(spark, log).withColumn("start_lsn", F.lit(10_000).cast("long")), _sinks(spark))


RESUME_SQL = over_log(f"SELECT sink_id, cu.source, CASE WHEN kind = 'index' THEN coalesce(e, 0) ELSE last_seq END AS after_seq FROM cu JOIN {_BEFORE} b ON cu.source = b.source")



def refused() -> Column:
    """A constraint that the example table sink refuses."""
    return F.coalesce(F.col("cents") % 97 == 0, F.lit(False)) & (F.col("op") != "d")


REFUSED_SQL = "(op <> 'd' AND coalesce(cents % 97 = 0, false))"


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dispatch.dead_letters(change_log(spark, sf_dir), refused()).withColumn("attempts", F.col("attempts").cast("long"))


LETTERS = f"""(SELECT source, seq, key, cents, op, CASE WHEN {REFUSED_SQL} THEN 'refused' ELSE 'behind a refused change' END AS error
  FROM (SELECT *, min(CASE WHEN {REFUSED_SQL} THEN seq END) OVER (PARTITION BY key) AS f FROM lg) WHERE seq >= f)"""
LETTER_SQL = over_log(f"SELECT source, seq, key, error, CAST(1 AS BIGINT) AS attempts FROM {LETTERS}")


def blocked_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes delivered and held back while earlier letters (of the first third of the log) are open."""
    log = change_log(spark, sf_dir)
    early = dispatch.blocked_keys(dispatch.dead_letters(log.where("seq % 3 = 0"), refused()))
    rows = dispatch.parked(log.where("seq % 3 <> 0"), refused(), early)
    return rows.groupBy("key").agg(F.count_if("parked").alias("parked"), F.count_if(~F.col("parked")).alias("applied"))


BLOCKED_SQL = over_log(f"""SELECT key, count(*) FILTER (seq >= f OR b) AS parked, count(*) FILTER (NOT (coalesce(seq >= f, false) OR b)) AS applied FROM (
  SELECT *, min(CASE WHEN {REFUSED_SQL} THEN seq END) OVER (PARTITION BY key) AS f,
    key IN (SELECT key FROM lg WHERE seq % 3 = 0 AND {REFUSED_SQL}) AS b FROM lg WHERE seq % 3 <> 0) GROUP BY key""")


def dlq_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters tried again after the constraint was relaxed to every second of its cases."""
    log = change_log(spark, sf_dir)
    letters = dispatch.parked(log, refused()).where("parked").withColumn("attempts", F.lit(1))
    retried = dispatch.retry_letters(letters, refused() & (F.col("cents") % 2 == 0))
    after = dispatch.after_retry(letters, retried, 1_000)
    return after.groupBy("key").agg(F.count(F.lit(1)).alias("letters"), F.count("resolved_at").alias("resolved"), F.sum("attempts").alias("attempts"))


RETRY_SQL = over_log(f"""SELECT key, count(*) AS letters, CASE WHEN bool_or({REFUSED_SQL} AND coalesce(cents % 2 = 0, false)) THEN 0 ELSE count(*) END AS resolved,
  count(*) * CASE WHEN bool_or({REFUSED_SQL} AND coalesce(cents % 2 = 0, false)) THEN 2 ELSE 1 END AS attempts FROM {LETTERS} GROUP BY key""")


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of two sinks, every fifth of them resolved."""
    rows = dispatch.dead_letters(change_log(spark, sf_dir), refused())
    sink = F.when(F.col("seq") % 2 == 0, "table").otherwise("hook")
    return rows.withColumns({"id": F.col("seq"), "sink_id": sink, "resolved_at": F.when(F.col("seq") % 5 == 0, F.lit(1).cast("long")), "attempts": F.col("attempts").cast("long")})


_SINK_LETTERS = f"(SELECT seq AS id, CASE WHEN seq % 2 = 0 THEN 'table' ELSE 'hook' END AS sink_id, key, error, CASE WHEN seq % 5 = 0 THEN 1 END AS resolved_at FROM {LETTERS})"


def open_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a sink's open letters, and all of those of the row with the greatest key."""
    letters = _letters(spark, sf_dir)
    key = letters.where("sink_id = 'hook' and resolved_at is null").agg(F.max("key")).first()[0]
    pages = [("table", dispatch.open_letters(letters, "table", limit=50)), ("row", dispatch.open_letters(letters, "hook", key, 5000))]
    first, second = (page.select("id", "key", "error").withColumn("page", F.lit(name)) for name, page in pages)
    return first.unionByName(second)


OPEN_SQL = over_log(f"""SELECT * FROM (SELECT id, key, error, 'table' AS page FROM {_SINK_LETTERS} WHERE sink_id = 'table' AND resolved_at IS NULL ORDER BY id LIMIT 50)
UNION ALL SELECT * FROM (SELECT id, key, error, 'row' FROM {_SINK_LETTERS} WHERE sink_id = 'hook' AND resolved_at IS NULL
  AND key = (SELECT max(key) FROM {_SINK_LETTERS} WHERE sink_id = 'hook' AND resolved_at IS NULL) ORDER BY id LIMIT 1000)""")


def letter_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters after some were resolved, some tried again in vain, and one sink's were cleared."""
    letters = _letters(spark, sf_dir)
    letters = dispatch.resolve_letters(letters, letters.where("id % 7 = 0").select("id"), 9)
    letters = dispatch.record_attempts(letters, letters.where("id % 11 = 0").select("id"), "still refused")
    return dispatch.clear_letters(letters, "hook").select("id", "key", "error", "attempts", F.coalesce("resolved_at", F.lit(-1)).alias("resolved_at"))


UPDATES_SQL = over_log(f"""SELECT id, key, CASE WHEN id % 11 = 0 THEN 'still refused' ELSE error END AS error, CAST(1 + CASE WHEN id % 11 = 0 THEN 1 ELSE 0 END AS BIGINT) AS attempts,
  CAST(CASE WHEN id % 7 = 0 THEN 9 ELSE coalesce(resolved_at, -1) END AS BIGINT) AS resolved_at FROM {_SINK_LETTERS} WHERE sink_id <> 'hook'""")


def start_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir)
    modes = [dispatch.start_cursors(log, m, 10_000).withColumn("mode", F.lit(m)) for m in ("beginning", "now", "lsn", "snapshot")]
    return modes[0].unionByName(modes[1]).unionByName(modes[2]).unionByName(modes[3])


START_SQL = over_log("""SELECT m.mode, source, CAST(CASE m.mode WHEN 'beginning' THEN 0 WHEN 'now' THEN head ELSE coalesce(e, 0) END AS BIGINT) AS last_seq,
  CAST(CASE m.mode WHEN 'beginning' THEN 0 WHEN 'now' THEN l ELSE 10000 END AS BIGINT) AS start_lsn
FROM (SELECT source, max(seq) AS head, max(commit_lsn) AS l, max(seq) FILTER (commit_lsn < 10000) AS e FROM lg GROUP BY source), (VALUES ('beginning'), ('now'), ('lsn'), ('snapshot')) m(mode)""")


def replay_from_lsn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after the log from a position on was applied a second time: nothing changes."""
    log = change_log(spark, sf_dir)
    return cells(materialize(merge_states(fold_changes(log), fold_changes(dispatch.replay(log, 10_000)))))


MERGED_SQL = over_log("SELECT key, name AS column, value FROM mg")


def replay_with_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sink's cells, open letters and cursors after it was emptied and replayed from a position: it knows of nothing earlier."""
    log = change_log(spark, sf_dir).withColumn("columns", F.lit(None).cast("array<string>"))
    state = fold_changes(log)
    columns = {"kind": "string", "cents": "bigint", "props": "string"}
    empty = spark.createDataFrame([], "key string, kind string, cents bigint, props string")
    full = sinks.apply_to_table(empty, materialize(state), log.select("key"), columns, whole=True)
    table, state, letters = sinks.reset_sink("table", full, state, _letters(spark, sf_dir))
    again = dispatch.replay(log, 10_000)
    table = sinks.apply_to_table(table, materialize(merge_states(state, fold_changes(again))), again.select("key"), columns, whole=True)
    left = letters.groupBy("sink_id").agg(F.count(F.lit(1)).alias("n"))
    cursors = dispatch.replay_cursors(log, "table", 10_000)
    text = lambda *parts: F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    shown = table.select(F.lit("row").alias("what"), text(F.col("key"), F.col("kind"), F.col("cents"), F.col("props")).alias("value"))
    shown = shown.unionByName(left.select(F.lit("letters").alias("what"), text(F.col("sink_id"), F.col("n")).alias("value")))
    return shown.unionByName(cursors.select(F.lit("cursor").alias("what"), text(F.col("source"), F.col("last_seq"), F.col("start_lsn")).alias("value")))


RESET_SQL = over_log(f"""SELECT 'row' AS what, concat_ws('|', key, kind, coalesce(cents, '~'), coalesce(props, '~')) AS value FROM (
  SELECT key, max(value) FILTER (name = 'kind') AS kind, max(value) FILTER (name = 'cents') AS cents, max(value) FILTER (name = 'props') AS props FROM (
    SELECT ce.key, name, arg_max(value, v) AS value FROM ce LEFT JOIN (SELECT key, max(v) AS d FROM lg WHERE op = 'd' AND commit_lsn >= 10000 GROUP BY key) x ON ce.key = x.key
    WHERE seq >= 396 AND (d IS NULL OR v > d) GROUP BY ce.key, name) GROUP BY key)
UNION ALL SELECT 'letters', concat_ws('|', sink_id, count(*)) FROM {_SINK_LETTERS} WHERE sink_id <> 'table' GROUP BY sink_id
UNION ALL SELECT 'cursor', concat_ws('|', source, coalesce(e, 0), 10000) FROM {_BEFORE}""")


def snapshot_seam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest images as of a position, loaded with the lowest version, then all changes from that position on."""
    log = change_log(spark, sf_dir).withColumn("columns", F.lit(None).cast("array<string>"))
    rows = materialize(fold_changes(log.where("commit_lsn < 10000")))
    base = rows.select("key", F.lit("c").alias("op"), F.lit(0).cast("long").alias("hlc"), F.lit("snapshot").alias("source"), F.lit(0).alias("ordinal"), F.col("row").alias("after"), F.lit(None).cast("array<string>").alias("columns"))
    return cells(materialize(fold_changes(base.unionByName(log.where("commit_lsn >= 10000").select(*base.columns)))))


SEAM_SQL = over_log("""SELECT key, "column", arg_max(value, v) AS value FROM (
  SELECT key, name AS "column", arg_max(value, v) AS value, '' AS v FROM (
    SELECT ce.* FROM ce LEFT JOIN (SELECT key, max(v) AS d FROM lg WHERE op = 'd' AND commit_lsn < 10000 GROUP BY key) x ON ce.key = x.key
    WHERE (d IS NULL OR v > d) AND seq < 396) GROUP BY key, name
  UNION ALL SELECT key, name, value, v FROM ce WHERE seq >= 396) z
WHERE v > coalesce((SELECT max(lg.v) FROM lg WHERE lg.key = z.key AND lg.op = 'd' AND lg.commit_lsn >= 10000), '-')
   OR (v = '' AND NOT EXISTS (SELECT 1 FROM lg WHERE lg.key = z.key AND lg.op = 'd' AND lg.commit_lsn >= 10000))
GROUP BY ALL""")


def outbox_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir)
    cutoff = log.agg(F.expr("min(commit_ms) + (max(commit_ms) - min(commit_ms)) div 2").alias("at")).first()[0]
    return outbox.retained(log, _cursors(spark, log), _sinks(spark), cutoff).select("source", "seq")


PRUNE_SQL = over_log("""SELECT lg.source, seq FROM lg JOIN (SELECT source, min(last_seq) AS upto FROM cu WHERE kind <> 'index' GROUP BY source) f ON lg.source = f.source
WHERE NOT (commit_ms < (SELECT min(commit_ms) + (max(commit_ms) - min(commit_ms)) // 2 FROM lg) AND seq <= upto)""")


def table_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed table filled by the first half of the log, then brought up to date by the second."""
    log = change_log(spark, sf_dir)
    columns = {"kind": "string", "cents": "bigint", "props": "string"}
    first = fold_changes(log.where("seq % 2 = 0"))
    empty = spark.createDataFrame([], "key string, kind string, cents bigint, props string")
    base = sinks.apply_to_table(empty, materialize(first), log.where("seq % 2 = 0").select("key"), columns, whole=True)
    both = merge_states(first, fold_changes(log.where("seq % 2 = 1")))
    return sinks.apply_to_table(base, materialize(both), log.where("seq % 2 = 1").select("key"), columns, whole=True)


TABLE_SQL = over_log("""SELECT key, max(value) FILTER (name = 'kind') AS kind, CAST(max(value) FILTER (name = 'cents') AS BIGINT) AS cents, max(value) FILTER (name = 'props') AS props FROM mg GROUP BY key""")


def sink_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registering suppliers' hooks beside two sinks that exist, one of whose ids is asked for again; then one is removed."""
    have = spark.createDataFrame([("hook-1", "postgres"), ("search", "index")], "sink_id string, kind string")
    asked = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("hook-"), F.col("s_suppkey").cast("string")).alias("sink_id"), F.lit("webhook").alias("kind"))
    return sinks.remove_sink("hook-2", sinks.add_sinks(have, asked))[0]


CATALOG_SQL = "SELECT 'hook-' || s_suppkey AS sink_id, 'webhook' AS kind FROM supplier WHERE s_suppkey NOT IN (1, 2) UNION ALL VALUES ('hook-1', 'postgres'), ('search', 'index')"


def sink_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which requests a catalogue accepts: some ids are taken, and every third is asked for twice in one call."""
    have = spark.createDataFrame([("hook-1", "postgres"), ("hook-6", "index")], "sink_id string, kind string")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    own = F.concat(F.lit("hook-"), F.col("s_suppkey").cast("string")).alias("sink_id")
    asked = rows.select(own, F.lit("webhook").alias("kind")).unionByName(rows.where("s_suppkey % 3 = 0").select(own, F.lit("index").alias("kind")))
    return sinks.sink_requests(have, asked)


REQUESTS_SQL = """SELECT 'hook-' || s_suppkey AS sink_id, 'webhook' AS kind, s_suppkey <> 1 AND s_suppkey % 3 <> 0 AS accepted FROM supplier
UNION ALL SELECT 'hook-' || s_suppkey, 'index', s_suppkey <> 6 FROM supplier WHERE s_suppkey % 3 = 0"""


def sink_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each table after a sink went with its cursors and letters."""
    log = change_log(spark, sf_dir)
    names = ("sinks", "cursors", "letters")
    left = sinks.remove_sink("table", _sinks(spark), _cursors(spark, log), _letters(spark, sf_dir))
    counts = [t.groupBy("sink_id").agg(F.count(F.lit(1)).alias("rows")).withColumn("what", F.lit(name)) for name, t in zip(names, left, strict=True)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


REMOVED_SQL = over_log(f"""SELECT 'sinks' AS what, s AS sink_id, CAST(1 AS BIGINT) AS rows FROM (VALUES ('search'), ('hook')) t(s)
UNION ALL SELECT 'cursors', sink_id, count(*) FROM cu WHERE sink_id <> 'table' GROUP BY sink_id
UNION ALL SELECT 'letters', sink_id, count(*) FROM {_SINK_LETTERS} WHERE sink_id <> 'table' GROUP BY sink_id""")


def index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many current rows each token of their columns leads to."""
    rows = materialize(fold_changes(change_log(spark, sf_dir)))
    text = F.concat_ws(" ", F.transform("row", lambda e: F.coalesce(e["value"], F.lit(""))))
    return sinks.postings(rows, text).groupBy("token").agg(F.count(F.lit(1)).alias("rows"))


POSTING_SQL = over_log(r"""SELECT token, count(DISTINCT key) AS rows FROM (SELECT key, unnest(regexp_extract_all(lower(value), '[\p{L}\p{Nd}]+')) AS token FROM mg WHERE value IS NOT NULL) GROUP BY token""")


def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per token over whole texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("key"), "text")
    return sinks.postings(docs, F.col("text")).groupBy("token").agg(F.count(F.lit(1)).alias("documents"))


DOCUMENT_SQL = r"SELECT token, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')) AS token FROM documents) GROUP BY token"


def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("key"), "text")
    return sinks.search(sinks.postings(docs, F.col("text")), "The, AND of!", 50)


SEARCH_SQL = r"""SELECT doc_id AS key FROM documents WHERE list_has_all(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+'), ['the', 'and', 'of']) ORDER BY doc_id LIMIT 50"""


def index_search_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one of two tables that share an index, by table and key document."""
    table = F.when(F.col("doc_id") % 2 == 0, "public.even").otherwise("public.odd")
    document = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id")))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(table.alias("table_name"), document.alias("key"), "text")
    index = sinks.postings(docs, F.col("text"))
    return sinks.search(index, "of the", 30, "public.odd").withColumn("asked", F.lit("odd")).unionByName(sinks.search(index, "of the", 40).withColumn("asked", F.lit("any")))


_HITS = r"""(SELECT CASE WHEN doc_id % 2 = 0 THEN 'public.even' ELSE 'public.odd' END AS table_name, '{"id":"' || doc_id || '"}' AS key FROM documents WHERE list_has_all(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+'), ['the', 'of']))"""
TABLE_SEARCH_SQL = f"""SELECT *, 'odd' AS asked FROM (SELECT * FROM {_HITS} WHERE table_name = 'public.odd' ORDER BY key LIMIT 30)
UNION ALL SELECT *, 'any' FROM (SELECT * FROM {_HITS} ORDER BY table_name, key LIMIT 40)"""


def allowed_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of webhooks by whether their host may be called."""
    hosts = ["Hooks.Example.COM", "hooks.example.com.evil.test", "localhost", "hooks.example.com"]
    target = F.concat(F.lit("https://"), F.element_at(F.array(*[F.lit(h) for h in hosts]), (F.col("event_id") % 4 + 1).cast("int")), F.lit(":8443/in?h=hooks.example.com"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(target.alias("target"))
    return rows.groupBy("target").agg(F.count(F.lit(1)).alias("n")).withColumn("allowed", host_allowed(F.col("target"), ["HOOKS.example.com"]))


HOST_SQL = """SELECT 'https://' || h || ':8443/in?h=hooks.example.com' AS target, count(*) AS n, lower(h) = 'hooks.example.com' AS allowed
FROM (SELECT ['Hooks.Example.COM', 'hooks.example.com.evil.test', 'localhost', 'hooks.example.com'][event_id % 4 + 1] AS h FROM events) GROUP BY h"""


def webhook_payload_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads per source with the ids of the changes that their JSON holds, and the first id signed with the payload's number."""
    rows = identities(change_log(spark, sf_dir)).withColumn("lane", F.col("source"))
    bodies = sinks.webhook_payloads(rows, "hook", 100)
    schema = "sink string, changes array<struct<seq:bigint,eventId:string,op:string>>"
    back = bodies.select(F.col("lane").alias("source"), F.col("payload_no").cast("long").alias("payload_no"), F.from_json("body", schema).alias("b"))
    first_id = F.get(F.col("b.changes"), 0)["eventId"]
    return back.select("source", "payload_no", "b.sink", F.size("b.changes").cast("long").alias("changes"), first_id.alias("first_id"), sinks.signature(F.col("payload_no"), first_id, HOOK_KEY).alias("signed"))


HOOK_KEY = b"k" * 32
_INNER, _OUTER = hmac_pads(HOOK_KEY)
PAYLOAD_SQL = over_log(f"""SELECT *, sha256(unhex('{_OUTER}' || sha256(unhex('{_INNER}' || hex(encode(payload_no || '.' || first_id)))))) AS signed FROM (
  SELECT source, (r - 1) // 100 AS payload_no, 'hook' AS sink, count(*) AS changes,
    arg_min(source || '/' || upper(to_hex(commit_lsn >> 32)) || '/' || upper(to_hex(commit_lsn & 4294967295)) || '/' || ordinal, seq) AS first_id
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq) AS r FROM lg) GROUP BY 1, 2)""")


def http_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = (F.col("event_id") % 500 + 100).cast("int")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(http_outcome(status).alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


HTTP_SQL = """SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN s BETWEEN 200 AND 299 THEN 'ok' WHEN s IN (408, 429) OR s >= 500 THEN 'transient' ELSE 'permanent' END AS outcome
FROM (SELECT event_id % 500 + 100 AS s FROM events)) GROUP BY outcome"""


def sink_refusal_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(*[F.lit(c) for c in ("23514", "22001", "42P01", "40001", "08006", "57P01")]), (F.col("event_id") % 6 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(code.alias("code"), refusal_class(code).alias("kind"), backoff_ms(F.col("event_id") % 9).alias("wait_ms")).groupBy("code", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("wait_ms").alias("wait_ms"))


REFUSAL_SQL = """SELECT code, CASE WHEN code[1:2] IN ('22', '23', '42') THEN 'permanent' ELSE 'transient' END AS kind, count(*) AS n, CAST(sum(least(100 * pow(2, event_id % 9), 5000)) AS BIGINT) AS wait_ms
FROM (SELECT event_id, ['23514', '22001', '42P01', '40001', '08006', '57P01'][event_id % 6 + 1] AS code FROM events) GROUP BY 1, 2"""

DEFINITIONS = [
    ("orders", "postgres", ["public.orders"], "host=db"),
    ("Orders", "postgres", ["public.orders"], "host=db"),
    ("hook", "webhook", ["public.a", "public.b"], "https://example.com/in?x=1"),
    ("hook", "webhook", ["public.a"], "ftp://example.com"),
    ("find", "index", [], None),
    ("find", "index", ["orders"], None),
    ("find", "index", ["public.a", "public.a"], None),
    ("x", "kafka", ["public.a"], None),
    ("upper", "index", ["public.Orders"], None),
    ("long", "index", ["public." + "t" * 63], None),
    ("longer", "index", ["public." + "t" * 64], None),
    ("aimed", "index", ["public.a"], "host=db"),
    ("blank", "postgres", ["public.a"], "  "),
    ("loud", "webhook", ["_x.y_1"], "HTTPS://example.com/#top"),
]


def sink_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(DEFINITIONS, "sink_id string, kind string, tables array<string>, target string")
    problems = sink_problems(F.col("sink_id"), F.col("kind"), F.col("tables"), F.col("target"))
    return rows.select("sink_id", "kind", F.concat_ws(",", problems).alias("problems"), F.coalesce(public_target(F.col("target")), F.lit("-")).alias("shown"))


VALIDATION_SQL = """SELECT * FROM (VALUES ('orders', 'postgres', '', 'host=db'), ('Orders', 'postgres', 'id', 'host=db'), ('hook', 'webhook', '', 'https://example.com/in'), ('hook', 'webhook', 'target', 'ftp://example.com'),
('find', 'index', 'no tables', '-'), ('find', 'index', 'table name', '-'), ('find', 'index', 'table twice', '-'), ('x', 'kafka', 'kind', '-'), ('upper', 'index', 'table name', '-'), ('long', 'index', '', '-'), ('longer', 'index', 'table name', '-'),
('aimed', 'index', 'target', 'host=db'), ('blank', 'postgres', 'target', '  '), ('loud', 'webhook', '', 'HTTPS://example.com/')) t(sink_id, kind, problems, shown)"""

#: Settings are every name in every form.
STANDBY_NAMES = ["tide_b", "TIDE_B", '"tide_b"', "*", "tide_c", "tide", "tide_b2", ""]
STANDBY_FORMS = ["{}", "{}, spare", "spare,{}", "ANY 2 (spare, {}, other)", "FIRST 1 ({})"]


def standby_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(f.format(n),) for n in STANDBY_NAMES for f in STANDBY_FORMS], "setting string")
    return rows.select("setting", standby_listed(F.col("setting"), F.lit("tide_b")).alias("listed"), clamp(F.length("setting"), 1, 10).cast("long").alias("clamped"))


STANDBY_SQL = f"""SELECT replace(f, '{{}}', n) AS setting, lower(replace(n, '"', '')) IN ('tide_b', '*') AS listed, CAST(greatest(1, least(length(replace(f, '{{}}', n)), 10)) AS BIGINT) AS clamped
FROM (SELECT unnest({STANDBY_NAMES}) AS n) a, (SELECT unnest({STANDBY_FORMS}) AS f) b"""


def lane_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes per row key (always one) after dealing changes to lanes."""
    rows = dispatch.in_lanes(change_log(spark, sf_dir), 8).withColumn("lane", dispatch.lane(F.col("key"), 8))
    return rows.groupBy("key").agg(F.countDistinct("lane").alias("lanes"), F.count(F.lit(1)).alias("changes"))


LANE_SQL = over_log("SELECT key, CAST(1 AS BIGINT) AS lanes, count(*) AS changes FROM lg GROUP BY key")


def source_sink_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in which merged and newest-image results differ, either way."""
    log = change_log(spark, sf_dir)
    text = lambda rows: rows.select("key", value_of(F.col("row"), "kind").alias("kind"), value_of(F.col("row"), "cents").alias("cents"))
    return sinks.differences(text(materialize(fold_changes(log))), text(materialize(fold_changes(log.withColumn("columns", F.lit(None).cast("array<string>"))))))


DIFF_SQL = over_log("""SELECT side, CAST(n AS BIGINT) AS rows FROM (
  WITH a AS (SELECT key, max(value) FILTER (name = 'kind') AS kind, max(value) FILTER (name = 'cents') AS cents FROM mg GROUP BY key),
  b AS (SELECT key, max(value) FILTER (name = 'kind') AS kind, max(value) FILTER (name = 'cents') AS cents FROM (SELECT key, name, arg_max(value, v) AS value FROM lc GROUP BY key, name) GROUP BY key)
  SELECT 'left only' AS side, (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS n UNION ALL SELECT 'right only', (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)))""")

QUERIES = {
    "outbox_range": (outbox_range, RANGE_SQL),
    "outbox_head": (outbox_head, HEAD_SQL),
    "last_seq_before": (last_seq_before, BEFORE_SQL),
    "outbox_position": (outbox_position, POSITION_SQL),
    "epoch_fence": (epoch_fence, FENCE_SQL),
    "contiguous_mark": (contiguous_mark, MARK_SQL),
    "cursor_advance": (cursor_advance, ADVANCE_SQL),
    "cursor_set": (cursor_set, SET_SQL),
    "resume_after_restart": (resume_after_restart, RESUME_SQL),
    "open_letters": (open_letters, OPEN_SQL),
    "letter_updates": (letter_updates, UPDATES_SQL),
    "replay_with_reset": (replay_with_reset, RESET_SQL),
    "sink_requests": (sink_requests, REQUESTS_SQL),
    "sink_removed": (sink_removed, REMOVED_SQL),
    "index_search_table": (index_search_table, TABLE_SEARCH_SQL),
    "allowed_hosts": (allowed_hosts, HOST_SQL),
    "dead_letters": (dead_letters, LETTER_SQL),
    "blocked_keys": (blocked_keys, BLOCKED_SQL),
    "dlq_retry": (dlq_retry, RETRY_SQL),
    "start_modes": (start_modes, START_SQL),
    "replay_from_lsn": (replay_from_lsn, MERGED_SQL),
    "snapshot_seam": (snapshot_seam, SEAM_SQL),
    "outbox_prune": (outbox_prune, PRUNE_SQL),
    "table_sink": (table_sink, TABLE_SQL),
    "sink_catalog": (sink_catalog, CATALOG_SQL),
    "index_postings": (index_postings, POSTING_SQL),
    "index_documents": (index_documents, DOCUMENT_SQL),
    "index_search": (index_search, SEARCH_SQL),
    "webhook_payload_ids": (webhook_payload_ids, PAYLOAD_SQL),
    "http_classify": (http_classify, HTTP_SQL),
    "sink_refusal_class": (sink_refusal_class, REFUSAL_SQL),
    "sink_validation": (sink_validation, VALIDATION_SQL),
    "standby_match": (standby_match, STANDBY_SQL),
    "lane_routing": (lane_routing, LANE_SQL),
    "source_sink_diff": (source_sink_diff, DIFF_SQL),
}
