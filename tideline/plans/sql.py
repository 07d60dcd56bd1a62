"""SQL of the derived change log, shared by the counterparts of registered queries."""

from __future__ import annotations

EVENTS = """ev AS (
  SELECT event_id AS seq, event_id // 4 AS txn, CAST(event_id % 4 AS INTEGER) AS ordinal,
    CASE WHEN (event_id // 4) % 3 = 0 THEN 'us' ELSE 'eu' END AS source,
    (event_id // 4 + 1) * 100 AS commit_lsn, (event_id // 4 + 1) * 100 + 10 AS end_lsn,
    epoch_us(ts) // 1000 AS ms, CAST(user_id % 60 AS VARCHAR) AS key, CAST((user_id + 1) % 60 AS VARCHAR) AS other_key,
    CASE event_type WHEN 'error' THEN 'd' WHEN 'signup' THEN 'c' ELSE 'u' END AS op, event_type AS kind,
    CAST(round(value * 100) AS BIGINT) AS cents, props
  FROM events),
tx AS (
  SELECT source, txn, commit_lsn, end_lsn, max(ms) AS commit_ms, max(ms) - (txn * 7919000) % 43200000 AS wall_ms
  FROM ev GROUP BY source, txn, commit_lsn, end_lsn),
st AS (
  SELECT source, txn, commit_lsn, commit_ms, end_lsn, i + greatest(0, max(greatest(0, wall_ms) * 65536 - i) OVER (PARTITION BY source ORDER BY commit_lsn)) AS hlc
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY commit_lsn) AS i FROM tx)),
lg AS (
  SELECT ev.*, st.hlc, st.commit_ms,
    lpad(CAST(st.hlc AS VARCHAR), 20, '0') || '/' || ev.source || '/' || lpad(CAST(ev.ordinal AS VARCHAR), 6, '0') AS v
  FROM ev JOIN st ON ev.source = st.source AND ev.txn = st.txn),
ce AS (
  SELECT seq, key, v, hlc, source, ordinal, c.name, c.value, c.changed FROM (
    SELECT *, unnest([
      {'name': 'kind', 'value': kind, 'carried': true, 'changed': kind NOT IN ('click', 'purchase')},
      {'name': 'cents', 'value': CAST(cents AS VARCHAR), 'carried': true, 'changed': kind NOT IN ('view', 'purchase')},
      {'name': 'props', 'value': props, 'carried': seq % 5 <> 0, 'changed': kind NOT IN ('view', 'click')}]) AS c
    FROM lg WHERE op <> 'd') WHERE c.carried),
de AS (SELECT key, max(CASE WHEN op = 'd' THEN v END) AS d FROM lg GROUP BY key),
lw AS (SELECT lg.* FROM lg JOIN de ON lg.key = de.key WHERE op <> 'd' AND (d IS NULL OR v > d)),
nw AS (SELECT key, max(v) AS n FROM lw GROUP BY key),
lc AS (SELECT ce.* FROM ce JOIN de ON ce.key = de.key WHERE d IS NULL OR v > d),
rg AS (
  SELECT key, name, max(v) AS v, arg_max(value, v) AS value, arg_max(hlc, v) AS hlc, arg_max(source, v) AS source, arg_max(ordinal, v) AS ordinal
  FROM lc WHERE changed GROUP BY key, name),
mg AS (
  SELECT coalesce(i.key, rg.key) AS key, coalesce(i.name, rg.name) AS name, CASE WHEN rg.key IS NULL THEN i.value ELSE rg.value END AS value
  FROM (SELECT lc.key, lc.name, lc.value FROM lc JOIN nw ON lc.key = nw.key AND lc.v = nw.n) i
  FULL JOIN rg ON i.key = rg.key AND i.name = rg.name),
oc AS (
  SELECT g.seq, g.key, g.op, g.source, g.v > coalesce(g.deleted, '') AND (g.op = 'd' OR g.v > coalesce(g.written, '') OR coalesce(m.moved, false)) AS changed, g.winner
  FROM (
    SELECT *, max(CASE WHEN op = 'd' THEN v END) OVER b AS deleted, max(CASE WHEN op <> 'd' THEN v END) OVER b AS written,
      max(v) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS winner
    FROM lg WINDOW b AS (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) g
  LEFT JOIN (
    SELECT seq, bool_or(earlier IS NULL OR v > earlier) AS moved FROM (
      SELECT seq, v, max(v) OVER (PARTITION BY key, name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM ce WHERE changed)
    GROUP BY seq) m ON g.seq = m.seq),
cu AS (
  SELECT s.sink_id, s.kind, h.source, h.head * s.percent // 100 AS last_seq
  FROM (VALUES ('table', 'postgres', 60), ('search', 'index', 30), ('hook', 'webhook', 90)) s(sink_id, kind, percent),
    (SELECT source, max(seq) AS head FROM lg GROUP BY source) h)"""


def over_log(select: str, recursive: str = "") -> str:
    """recursive: further common tables, of which some refer to themselves."""
    return f"WITH RECURSIVE {EVENTS},\n{recursive}\n{select}" if recursive else f"WITH {EVENTS}\n{select}"
