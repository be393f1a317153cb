"""The catalogue's queries once more, as SQL that DuckDB runs over the same tables."""

from __future__ import annotations

EVENTS = """e AS (
  SELECT event_id, user_id AS u, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) AS us, day(ts) AS day
  FROM events
)"""


def facts(t: str = "us * 1000") -> str:
    return f"""{EVENTS}, f AS (
  SELECT event_id,
    'src-' || CAST(u % 3 AS VARCHAR) AS source_id,
    'org-' || CAST(CASE WHEN u % 10 = 0 THEN event_id % 2 ELSE 0 END AS VARCHAR) AS origin_id,
    event_id * 128 AS start_offset, event_id * 128 + 128 AS end_offset,
    'mx-' || CAST(u % 3 AS VARCHAR) AS instance,
    'A' || lpad(CAST(u AS VARCHAR), 4, '0') || lpad(CAST(day AS VARCHAR), 2, '0') AS queue_id,
    CASE WHEN event_id % 997 <> 0 THEN {t} END AS t,
    event_id % 997 = 0 OR event_id % 2 = 1 AS non_explicit,
    event_type = 'error' AS removed,
    event_type IN ('signup', 'view') AS receipt,
    event_type AS et,
    CASE WHEN event_type = 'signup' THEN 'm' || CAST(CASE WHEN u % 30 < 15 THEN u % 3 ELSE u END AS VARCHAR) || '-' || CASE WHEN event_id % 50 = 0 THEN CAST(event_id AS VARCHAR) ELSE '0' END || '@example.org' END AS mid,
    CASE WHEN event_type = 'view' THEN 'u' || CAST(CASE WHEN u % 30 < 15 THEN u % 3 ELSE u END AS VARCHAR) || '@example.org' END AS sender,
    event_type IN ('click', 'purchase') AS delivery,
    event_type = 'click' AND event_id % 5 = 0 AS is_hint,
    CASE WHEN event_type IN ('click', 'purchase') THEN CASE WHEN k % 23 = 0 THEN '' ELSE 'r' || CAST(k % 7 AS VARCHAR) || '@example.net' END END AS address,
    CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 5 = 0 THEN 'sent' ELSE 'deferred' END
         WHEN event_type = 'purchase' THEN CASE WHEN value > 100 THEN 'delivered' ELSE 'sent' END END AS status,
    'A' || lpad(CAST((u + 3) % 150 AS VARCHAR), 4, '0') || lpad(CAST(day AS VARCHAR), 2, '0') AS target
  FROM e
)"""


def cycles(t: str = "us * 1000") -> str:
    return f"""WITH {facts(t)}, x AS (
  SELECT *, count(DISTINCT source_id || '/' || origin_id) OVER (PARTITION BY instance, queue_id) > 1 AS cross_stream,
    last_value(CASE WHEN removed THEN t END IGNORE NULLS) OVER ph AS last_rm, max(t) OVER ph AS max_prev,
    coalesce(lag(removed) OVER tm, FALSE) AS prev_rm, lag(t) OVER tm AS prev_t, row_number() OVER tm AS place
  FROM f
  WINDOW ph AS (PARTITION BY instance, queue_id, source_id, origin_id ORDER BY start_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         tm AS (PARTITION BY instance, queue_id, source_id, origin_id ORDER BY t NULLS LAST, start_offset)
), y AS (
  SELECT *, CAST(sum(CASE WHEN prev_rm THEN 1 ELSE 0 END) OVER (PARTITION BY instance, queue_id, source_id, origin_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS INTEGER) AS cycle,
    coalesce(t <= last_rm, FALSE) OR (removed AND coalesce(max_prev > t, FALSE)) AS phys
  FROM x
), z AS (
  SELECT *, first_value(mid IGNORE NULLS) OVER (PARTITION BY instance, queue_id, source_id, origin_id, cycle ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS mid1 FROM y
), v AS (
  SELECT *, CASE WHEN prev_rm AND NOT (receipt AND coalesce(t > prev_t, FALSE)) THEN 'boundary_unproven' WHEN mid <> mid1 THEN 'conflicting_message_ids' END AS viol FROM z
), r AS (
  SELECT instance, queue_id, source_id, origin_id,
    CASE WHEN count(*) <> count(t) THEN 'undated' WHEN bool_or(phys) THEN 'boundary_unproven'
         ELSE coalesce(arg_min(viol, place) FILTER (WHERE viol IS NOT NULL), 'resolved') END AS reason
  FROM v GROUP BY ALL
), a AS (SELECT v.*, r.reason FROM v JOIN r USING (instance, queue_id, source_id, origin_id)),
g AS (
  SELECT instance, queue_id, source_id, origin_id, cycle, min(t) AS first_t, arg_min(start_offset, place) AS first_start,
    max(CASE WHEN removed THEN t END) AS removed_t, bool_or(receipt) AS receipt_observed, bool_or(non_explicit) AS non_explicit_time,
    bool_or(cross_stream) AS cross_stream_uncertain, count(*) AS n_facts
  FROM a WHERE reason = 'resolved' GROUP BY ALL
), d AS (
  SELECT *, t = max(t) OVER (PARTITION BY instance, queue_id, source_id, origin_id, cycle, address) AS latest
  FROM a WHERE reason = 'resolved' AND delivery
), p AS (
  SELECT instance, queue_id, source_id, origin_id, cycle, address, count(*) AS n_attempts, count(*) FILTER (WHERE latest) AS n_latest,
    CASE WHEN address = '' OR count(DISTINCT status) FILTER (WHERE latest) > 1 THEN 'unknown' ELSE max(status) FILTER (WHERE latest) END AS observed_status,
    count(DISTINCT status) FILTER (WHERE latest) > 1 AS order_uncertain, address = '' AS address_unspecified
  FROM d GROUP BY instance, queue_id, source_id, origin_id, cycle, address
)"""


_KEY = "instance, queue_id, source_id, origin_id, cycle"
HOUR = "(us - us % 3600000000) * 1000"
SUMMARY = f""", c AS (
  SELECT {_KEY}, count(*) AS n, count(*) FILTER (WHERE observed_status = 'sent') AS sent, count(*) FILTER (WHERE observed_status = 'delivered') AS delivered,
    count(*) FILTER (WHERE observed_status = 'deferred') AS deferred, count(*) FILTER (WHERE observed_status = 'bounced') AS bounced,
    count(*) FILTER (WHERE observed_status = 'unknown') AS unknown, bool_or(address_unspecified) AS unspec, bool_or(order_uncertain) AS unc
  FROM p GROUP BY ALL
), s AS (
  SELECT g.*, coalesce(n, 0) AS n_recipients, coalesce(sent, 0) AS sent, coalesce(delivered, 0) AS delivered, coalesce(deferred, 0) AS deferred,
    coalesce(bounced, 0) AS bounced, coalesce(unknown, 0) AS unknown, coalesce(unspec, FALSE) AS unspec, coalesce(unc, FALSE) AS unc
  FROM g LEFT JOIN c USING ({_KEY})
)"""

MARKS = "c AS (SELECT source_id, origin_id, max(end_offset) * 3 // 4 AS off FROM f GROUP BY ALL)"
LINKS = f""", doubt AS (SELECT DISTINCT instance, queue_id FROM a WHERE reason <> 'resolved'),
claim AS (
  SELECT {_KEY}, CASE WHEN count(DISTINCT sender) = 1 THEN min(sender) END AS sender, CASE WHEN count(DISTINCT mid) = 1 THEN min(mid) END AS mid, count(DISTINCT mid) > 1 AS mids
  FROM a WHERE reason = 'resolved' GROUP BY ALL
), gc AS (SELECT *, row_number() OVER (ORDER BY {_KEY}) AS gid FROM g JOIN claim USING ({_KEY})),
h AS (SELECT event_id, start_offset, instance, queue_id, source_id, origin_id, cycle, reason AS r0, cross_stream, t, target, address FROM a WHERE is_hint),
b AS (
  SELECT h.*, CASE WHEN h.r0 = 'resolved' THEN s.gid END AS sgid, s.first_t AS s_first, s.receipt_observed AS s_rec, s.sender AS s_sender, s.mid AS s_mid, s.mids AS s_mids, s.non_explicit_time AS s_ne,
    EXISTS (SELECT 1 FROM doubt WHERE doubt.instance = h.instance AND doubt.queue_id = h.queue_id) AS s_doubt, 'mx-' || right(h.instance, 1) AS to_instance
  FROM h LEFT JOIN gc s ON h.r0 = 'resolved' AND s.instance = h.instance AND s.queue_id = h.queue_id AND s.source_id = h.source_id AND s.origin_id = h.origin_id AND s.cycle = h.cycle
), m AS (
  SELECT b.event_id, count(*) AS n_target, count(*) FILTER (WHERE ok) AS n_ok, bool_or(t_cross) AS t_cross, max(gid) FILTER (WHERE ok) AS tgid
  FROM (SELECT b.*, x.gid, x.cross_stream_uncertain AS t_cross, b.s_rec AND x.receipt_observed AND x.first_t > b.s_first AND abs(x.first_t - b.t) <= 86400000000000 AS ok
        FROM b JOIN gc x ON x.instance = b.to_instance AND x.queue_id = b.target) b GROUP BY ALL
), known AS (SELECT DISTINCT gid, address FROM d JOIN gc USING ({_KEY})),
j AS (
  SELECT b.*, coalesce(m.n_target, 0) AS n_target, m.n_ok, coalesce(m.t_cross, FALSE) AS t_cross, CASE WHEN m.n_ok = 1 THEN m.tgid END AS tgid,
    EXISTS (SELECT 1 FROM doubt WHERE doubt.instance = b.to_instance AND doubt.queue_id = b.target) AS t_doubt
  FROM b LEFT JOIN m ON m.event_id = b.event_id
), k AS (
  SELECT j.*, x.sender AS t_sender, x.mid AS t_mid, x.mids AS t_mids, x.cycle AS t_cycle, x.non_explicit_time AS t_ne, known.gid IS NOT NULL AS told
  FROM j LEFT JOIN gc x ON x.gid = j.tgid LEFT JOIN known ON known.gid = j.tgid AND known.address = j.address
), w AS (
SELECT start_offset, instance, queue_id, target AS target_queue_id, s_ne, t_ne, t_cycle, CASE
  WHEN sgid IS NULL THEN 'source_unresolved' WHEN cross_stream OR s_doubt THEN 'source_ambiguous'
  WHEN to_instance = instance AND target = queue_id THEN 'self_reference' WHEN t_doubt THEN 'target_ambiguous' WHEN n_target = 0 THEN 'target_absent'
  WHEN n_ok = 0 THEN 'evidence_insufficient' WHEN n_ok > 1 OR t_cross THEN 'target_ambiguous'
  WHEN coalesce(s_sender = t_sender AND NOT s_mids AND NOT t_mids AND s_mid <> '' AND s_mid = t_mid AND told, FALSE) THEN 'corroborated' ELSE 'evidence_insufficient' END AS result
FROM k
)
SELECT start_offset, instance, queue_id, target_queue_id, result, CASE WHEN result = 'corroborated' THEN t_cycle END AS target_cycle, coalesce(s_ne, FALSE) OR (result = 'corroborated' AND coalesce(t_ne, FALSE)) AS non_explicit_time FROM w"""

SESSIONS = f"""WITH {EVENTS}, f AS (
  SELECT event_id * 128 AS start_offset, 'src-' || CAST(u % 3 AS VARCHAR) AS source_id, 'org-' || CAST(CASE WHEN u % 10 = 0 THEN event_id % 2 ELSE 0 END AS VARCHAR) AS origin_id,
    CAST(u AS VARCHAR) AS pid, CASE WHEN event_id % 997 <> 0 THEN us * 1000 END AS t,
    CASE event_type WHEN 'signup' THEN 'connect' WHEN 'error' THEN 'disconnect' END AS edge,
    'host' || CAST(u % 5 AS VARCHAR) || '[192.0.2.' || CASE WHEN event_id % 41 = 0 THEN '9' ELSE CAST(u % 5 AS VARCHAR) END || ']' AS client
  FROM e
), s AS (SELECT *, count(edge) OVER (PARTITION BY source_id, origin_id, pid ORDER BY start_offset) AS seg FROM f),
b AS (
  SELECT source_id, origin_id, pid, seg, edge AS opener, client AS oc, t AS ot,
    lead(edge) OVER w AS closer, lead(client) OVER w AS cc, lead(t) OVER w AS ct
  FROM s WHERE edge IS NOT NULL WINDOW w AS (PARTITION BY source_id, origin_id, pid ORDER BY seg)
), m AS (SELECT s.*, b.opener, b.oc, b.ot, b.closer, b.cc, b.ct FROM s LEFT JOIN b USING (source_id, origin_id, pid, seg) WHERE s.edge IS NULL),
q AS (
  SELECT *, CASE WHEN t IS NULL THEN 'undated' WHEN t < ot OR t > ct THEN 'time_conflict' END AS doubt,
    bool_or(client <> oc) OVER (PARTITION BY source_id, origin_id, pid, seg) AS differs FROM m
), n AS (SELECT source_id, origin_id, pid, seg, arg_min(doubt, start_offset) FILTER (WHERE doubt IS NOT NULL) AS first_doubt FROM q GROUP BY ALL)
SELECT start_offset, pid, client, CASE
  WHEN opener IS NULL OR opener <> 'connect' OR closer IS NULL OR closer <> 'disconnect' THEN 'boundary_unproven'
  WHEN differs OR cc <> oc THEN 'client_mismatch' WHEN ot IS NULL OR ct IS NULL THEN 'undated' WHEN ct <= ot THEN 'time_conflict'
  ELSE coalesce(first_doubt, 'assigned') END AS result
FROM q JOIN n USING (source_id, origin_id, pid, seg)"""

PAGE = "instance = 'mx-1' AND t >= 1704067200000000000 AND t < 1706745600000000000"
_DOMAIN = "^[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*$"


def _frame(x: str) -> str:
    # hex of a number in 16 digits
    return f"(unhex(lpad(printf('%X', octet_length(encode({x}))), 16, '0')) || encode({x}))"


ORACLE = {
    "facts_partition": f"WITH {facts()} SELECT instance, queue_id, source_id, origin_id, count(t) AS timed, count(*) - count(t) AS untimed, any_value(x) AS cross_stream FROM (SELECT *, count(DISTINCT source_id || '/' || origin_id) OVER (PARTITION BY instance, queue_id) > 1 AS x FROM f) GROUP BY instance, queue_id, source_id, origin_id",
    "generation_split": cycles() + f" SELECT {_KEY}, first_t, coalesce(removed_t, -1) AS removed_t, receipt_observed, non_explicit_time, cross_stream_uncertain, n_facts, first_start FROM g",
    "generation_reasons": cycles() + " SELECT reason, count(*) AS n_streams, CAST(sum(n) AS BIGINT) AS n_facts FROM (SELECT instance, queue_id, source_id, origin_id, reason, count(*) AS n FROM a GROUP BY ALL) GROUP BY reason",
    "queue_instances": cycles() + " SELECT instance, queue_id, source_id, origin_id, cycle, CAST(row_number() OVER (PARTITION BY instance, queue_id ORDER BY source_id, origin_id, cycle) - 1 AS INTEGER) AS generation FROM g",
    "recipient_latest": cycles() + f" SELECT {_KEY}, address, n_attempts, n_latest, observed_status, order_uncertain, address_unspecified FROM p",
    "recipient_ties": cycles(HOUR) + f" SELECT {_KEY}, address, n_attempts, n_latest, observed_status, order_uncertain, address_unspecified FROM p",
    "summary_counts": cycles() + SUMMARY + " SELECT count(*) AS n_generations, CAST(sum(n_recipients) AS BIGINT) AS recipients, CAST(sum(sent) AS BIGINT) AS sent, CAST(sum(delivered) AS BIGINT) AS delivered, CAST(sum(deferred) AS BIGINT) AS deferred, CAST(sum(bounced) AS BIGINT) AS bounced, CAST(sum(unknown) AS BIGINT) AS unknown FROM s",
    "summary_reserves": cycles(HOUR)
    + SUMMARY
    + f""" SELECT {_KEY}, n_recipients, sent, delivered, deferred, bounced, unknown, array_to_string(list_filter([
  'coverage_unproven', CASE WHEN NOT receipt_observed THEN 'receipt_not_observed' END, CASE WHEN removed_t IS NULL THEN 'removal_not_observed' END,
  CASE WHEN non_explicit_time THEN 'non_explicit_time' END, CASE WHEN cross_stream_uncertain THEN 'cross_stream_uncertain' END,
  CASE WHEN n_recipients = 0 THEN 'no_recipients_observed' END, CASE WHEN unspec THEN 'address_unspecified' END, CASE WHEN unc THEN 'latest_order_uncertain' END,
  CASE WHEN unknown > 0 THEN 'unknown_result' END], lambda v: v IS NOT NULL), ',') AS reserves FROM s""",
    "queue_hints": f"WITH {facts()} SELECT start_offset, instance, queue_id, 'smtp_queue_hint' AS hint_kind, target AS target_queue_id, 'peer[192.0.2.1]:25' AS relay FROM f WHERE is_hint",
    "queue_links": cycles() + LINKS,
    "prequeue_reports": f"WITH {EVENTS} SELECT event_id * 128 AS start_offset, CAST(u AS VARCHAR) AS pid, CASE WHEN event_type = 'view' THEN 'warning' ELSE 'rejected' END AS disposition, 'host' || CAST(u % 5 AS VARCHAR) || '[192.0.2.' || CASE WHEN event_id % 41 = 0 THEN '9' ELSE CAST(u % 5 AS VARCHAR) END || ']' AS client, 'a@example.org' AS sender, 'b@example.net' AS recipient FROM e WHERE event_type NOT IN ('signup', 'error')",
    "prequeue_sessions": SESSIONS,
    "search_exact": f"WITH {facts()} SELECT event_id, t AS time_utc_ns, start_offset, queue_id FROM f WHERE address = 'r3@example.net' AND {PAGE} ORDER BY t, event_id LIMIT 100",
    "search_domain": f"WITH {facts()} SELECT event_id, t AS time_utc_ns, start_offset, queue_id FROM f WHERE address LIKE '%@example.net' AND {PAGE} ORDER BY t, event_id LIMIT 200",
    "search_page_2": f"WITH {facts()} SELECT event_id, t AS time_utc_ns, start_offset, queue_id FROM f WHERE address = 'r3@example.net' AND {PAGE} ORDER BY t, event_id LIMIT 20 OFFSET 20",
    "search_all_fields": " UNION ALL ".join(
        f"SELECT '{n}' AS field, count(*) AS n, CAST(coalesce(sum(event_id), 0) AS BIGINT) AS ids FROM (WITH {facts()} SELECT event_id FROM f WHERE {c} AND {PAGE})"
        for n, c in (("sender", "sender = 'u1@example.org'"), ("recipient", "address = ''"), ("queue_id", "queue_id = 'A000102'"), ("message_id", "mid = 'm1-0@example.org'"), ("sender_domain", "sender LIKE '%@example.org'"), ("recipient_domain", "address LIKE '%@example.net'"))
    ),
    "origin_overlap": f"WITH {facts()}, o AS (SELECT *, end_offset + CASE WHEN event_id % 89 = 0 THEN 50000 ELSE 0 END AS e2 FROM f) SELECT start_offset, 'overlap' AS fault FROM (SELECT *, lag(e2) OVER (PARTITION BY source_id, origin_id ORDER BY start_offset) AS pe FROM o) WHERE pe > start_offset",
    "origin_extremities": f"WITH {facts()} SELECT source_id, origin_id, min(start_offset) AS first_start, max(end_offset) AS last_end FROM f GROUP BY ALL",
    "scope_semi_join": f"WITH {facts()} SELECT start_offset, instance, queue_id FROM f WHERE (instance = 'mx-1' AND queue_id IN ('A000102', 'A000110', 'A003105')) OR (instance = 'mx-2' AND queue_id = 'A000203')",
    "retention_preview": f"WITH {facts()}, {MARKS} SELECT start_offset, instance FROM f JOIN c USING (source_id, origin_id) WHERE t < 1705276800000000000 AND end_offset <= off AND NOT (source_id = 'src-1' AND origin_id = 'org-1')",
    "retention_purge": f"WITH {facts()}, {MARKS} SELECT start_offset, instance FROM f JOIN c USING (source_id, origin_id) WHERE t < 1705276800000000000 AND end_offset <= off AND (source_id = 'src-0' OR (source_id = 'src-2' AND origin_id = 'org-0'))",
    "replay_guard": f"WITH {facts()} SELECT start_offset, CASE WHEN event_id % 70 IN (3, 5) THEN 'collision' WHEN event_id % 10 = 3 THEN 'skipped' WHEN event_id % 10 = 5 THEN 'stored' ELSE 'new' END AS outcome FROM f",
    "revision_digest": f"WITH {facts()} SELECT start_offset, sha256({' || '.join(_frame(x) for x in ('source_id', 'origin_id', 'CAST(start_offset AS VARCHAR)', 'CAST(end_offset AS VARCHAR)', 'queue_id'))}) AS digest FROM f",
    "syslog_roundtrip": f"WITH {EVENTS} SELECT event_id, (us // 1000000) * 1000000000 AS time_utc_ns, 'mx-' || CAST(u % 3 AS VARCHAR) AS host, CASE event_type WHEN 'signup' THEN 'cleanup' WHEN 'click' THEN 'smtp' WHEN 'purchase' THEN 'local' ELSE 'qmgr' END AS service, CAST(u AS VARCHAR) AS pid, CASE WHEN event_id % 101 = 0 THEN 'invalid_syslog_envelope' ELSE '' END AS parse_error FROM e WHERE event_id % 101 <> 0 UNION ALL SELECT event_id, NULL, '', '', '', 'invalid_syslog_envelope' FROM events WHERE event_id % 101 = 0",
    "postfix_fields": f"WITH {facts()} SELECT event_id, CASE WHEN et = 'error' THEN 'removed' WHEN delivery THEN 'delivery' ELSE 'message' END AS kind, queue_id, mid AS message_id, sender, CASE WHEN delivery THEN address END AS recipient, CASE WHEN delivery THEN CASE WHEN is_hint OR et = 'purchase' THEN 'sent' ELSE 'deferred' END END AS status FROM f",
    "timeline_page": cycles() + " SELECT start_offset, n AS position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY instance, queue_id, source_id, origin_id, cycle ORDER BY place) - 1 AS INTEGER) AS n FROM a WHERE reason = 'resolved') WHERE n BETWEEN 2 AND 4",
    "address_domains": f"""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents), a AS (SELECT doc_id, w FROM w WHERE contains(w, '@'))
SELECT doc_id, w AS word, CASE WHEN len(w) - len(replace(w, '@', '')) = 1 AND NOT starts_with(w, '@') AND NOT regexp_matches(w, '[\\s\\x00-\\x1f\\x7f<>"]') AND len(split_part(w, '@', 2)) <= 253 AND regexp_matches(split_part(w, '@', 2), '{_DOMAIN}') THEN lower(split_part(w, '@', 2)) END AS domain FROM a""",
    "queue_id_grammar": r"SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE len(w) BETWEEN 3 AND 32 AND regexp_full_match(w, '[A-Za-z0-9]+') AND (regexp_matches(w, '[0-9]') OR regexp_full_match(w, '[A-F]+')) GROUP BY w",
    "left_join_checkpoints": f"WITH {facts()} SELECT source_id, origin_id, CASE WHEN source_id = 'src-0' THEN 'retired' ELSE 'following' END AS state, CASE WHEN origin_id = 'org-0' THEN off END AS \"offset\" FROM (SELECT source_id, origin_id, max(end_offset) * 3 // 4 AS off FROM f GROUP BY ALL) WHERE source_id <> 'src-2'",
    "import_runs": f"WITH {facts()}, m AS (SELECT source_id, origin_id, max(end_offset) * 3 // 4 AS off FROM f WHERE source_id = 'src-2' GROUP BY ALL) SELECT source_id, origin_id, 'complete' AS status, off AS end_offset, off AS \"offset\", '' AS fault FROM m UNION ALL SELECT source_id, origin_id, 'running', 0, off, '' FROM m WHERE origin_id = 'org-1'",
    "contiguity_check": f"WITH {facts()} SELECT source_id, origin_id, start_offset, expected FROM (SELECT *, coalesce(lag(end_offset) OVER (PARTITION BY source_id, origin_id ORDER BY start_offset), 0) AS expected FROM f) WHERE expected <> start_offset",
    "import_origin_ids": f"SELECT doc_id, 'import-v1:' || sha256({' || '.join(_frame(x) for x in (chr(39) + 'import-origin' + chr(39), 'source', 'sha256(text)'))}) AS origin_id FROM documents",
    "utf8_wire": "SELECT doc_id, 'utf8' AS encoding, text AS value FROM documents",
    "search_more": f"WITH {facts()} SELECT event_id, t AS time_utc_ns FROM f WHERE address = 'r3@example.net' AND {PAGE} ORDER BY t, event_id LIMIT 21",
    "continuity_chain": f"""WITH {facts()}, o AS (SELECT DISTINCT source_id, day(to_timestamp(t / 1000000000) AT TIME ZONE 'UTC') AS d FROM f WHERE t IS NOT NULL),
x AS (SELECT *, d <= 10 AS a, d BETWEEN 11 AND 20 AS b FROM o),
y AS (SELECT source_id, d, min(d) OVER w AS head, count(*) OVER w AS n, row_number() OVER (PARTITION BY source_id, a, b ORDER BY d) - 1 AS place FROM x WINDOW w AS (PARTITION BY source_id, a, b))
SELECT source_id, printf('d%02d', head) AS head, CAST(place AS INTEGER) AS place, printf('d%02d', d) AS origin_id FROM y WHERE n > 1""",
    "asof_last_boundary": f"""WITH {EVENTS}, f AS (SELECT event_id * 128 AS start_offset, CAST(u AS VARCHAR) AS pid, event_type IN ('signup', 'error') AS edge, CASE WHEN u % 10 = 0 THEN event_id % 2 ELSE 0 END AS org FROM e),
s AS (SELECT *, max(CASE WHEN edge THEN start_offset END) OVER (PARTITION BY pid, org ORDER BY start_offset) AS open_start FROM f) SELECT start_offset, pid, open_start FROM s WHERE NOT edge""",
    "expirations": cycles().replace("event_type IN ('signup', 'view') AS receipt", "event_type IN ('signup', 'view') AND NOT (event_type = 'view' AND event_id % 11 = 0) AS receipt") + f" SELECT {_KEY}, count(*) FILTER (WHERE et = 'view' AND event_id % 11 = 0) AS expiration_reports FROM a WHERE reason = 'resolved' GROUP BY ALL",
    "other_facts": f"WITH {facts()} SELECT source_id, origin_id, start_offset FROM f WHERE event_id % 13 = 0",
    "candidate_timeline": cycles() + """ SELECT CAST(start_offset AS VARCHAR) AS start_offset, n AS position, CASE WHEN removed THEN 'removed' WHEN delivery THEN 'delivery' ELSE 'message' END AS kind,
  CASE et WHEN 'signup' THEN 'cleanup' WHEN 'click' THEN 'smtp' WHEN 'purchase' THEN 'local' ELSE 'qmgr' END AS service
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY instance, queue_id, source_id, origin_id, cycle ORDER BY place) - 1 AS INTEGER) AS n FROM a WHERE reason = 'resolved' AND instance = 'mx-1' AND queue_id IN ('A000102', 'A003105')) WHERE n < 3""",
    "rfc5424_lines": f"""WITH {EVENTS}, l AS (
  SELECT event_id, event_id % 200 > 191 AS bad, event_id % 31 = 0 AS broken,
    (us - CASE WHEN event_id % 7 = 0 THEN us % 1000000 ELSE 0 END - CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 7200000000 ELSE -19800000000 END) * 1000 AS t,
    CASE event_id % 3 WHEN 0 THEN '+00:00' WHEN 1 THEN '+02:00' ELSE '-05:30' END AS z FROM e)
SELECT event_id, CASE WHEN NOT bad THEN t END AS time_utc_ns, CASE WHEN bad THEN 'unknown' ELSE 'explicit_offset' END AS time_quality, CASE WHEN bad THEN '' ELSE z END AS time_zone,
  CASE WHEN bad OR broken THEN '' ELSE 'hello ' || event_id END AS message,
  CASE WHEN bad THEN 'invalid_syslog_envelope' WHEN broken THEN 'invalid_syslog_structured_data' ELSE '' END AS parse_error FROM l""",
    "nearest_year": f"""WITH {EVENTS}, w AS (SELECT event_id, make_timestamp((us // 1000000) * 1000000) AS w FROM e),
y AS (SELECT event_id, y, epoch_us(w + to_years(CAST(y - 2024 AS INTEGER))) // 1000000 AS s FROM w, (VALUES (2023), (2024), (2025)) v(y)),
b AS (SELECT event_id, arg_min(s, abs(s - 1720569600)) AS s, arg_min(y, abs(s - 1720569600)) AS y FROM y GROUP BY event_id)
SELECT event_id, s * 1000000000 AS time_utc_ns, 'inferred_year_and_zone' AS time_quality, CAST(y AS INTEGER) AS time_year FROM b""",
    "dst_gap": """WITH l AS (SELECT event_id, event_id % 2 = 0 AS spring, event_id % 24 AS h, (event_id % 24) * 3600 + (event_id % 59) * 60 + event_id % 53 AS s FROM events)
SELECT event_id, CASE WHEN spring AND h = 2 THEN NULL WHEN spring THEN 1711843200 + s - CASE WHEN h < 2 THEN 3600 ELSE 7200 END ELSE 1729987200 + s - CASE WHEN h < 3 THEN 7200 ELSE 3600 END END * 1000000000 AS time_utc_ns,
  CASE WHEN spring AND h = 2 THEN 'year_without_zone' ELSE 'configured_year_and_zone' END AS time_quality FROM l""",
    "comma_fields": """SELECT event_id, CASE WHEN v < 2 THEN 'delivery' ELSE 'message' END AS kind,
  CASE v WHEN 0 THEN '"a,b"@example.net' WHEN 1 THEN 'first@example.net' WHEN 2 THEN '<open, status=sent' END AS "to", CASE v WHEN 0 THEN 'peer[192.0.2.1,x]:25' END AS relay,
  CASE v WHEN 0 THEN '(2, 3)' END AS conn_use, CAST(event_id AS VARCHAR) AS delay, CASE v WHEN 0 THEN 'deferred' WHEN 1 THEN 'sent' END AS status,
  CASE v WHEN 0 THEN 'host said: 450 (try, later)' WHEN 1 THEN '250 ok' END AS reply FROM (SELECT event_id, event_id % 4 AS v FROM events)""",
    "space_fields": """SELECT event_id, 'message' AS kind, CASE WHEN v < 2 THEN CAST(event_id AS VARCHAR) END AS uid, CASE v WHEN 0 THEN 'a b;c@example.org' END AS "from",
  CASE v WHEN 0 THEN '"q r"' END AS y, CAST(NULL AS VARCHAR) AS z FROM (SELECT event_id, event_id % 3 AS v FROM events)""",
    "reject_metadata": """SELECT event_id, 'reject' AS kind, TRUE AS no_queue, CASE v WHEN 0 THEN 'u' || event_id || '@example.org' WHEN 1 THEN '' WHEN 2 THEN 'a@example.org' END AS "from",
  CASE v WHEN 0 THEN 'b@example.net' WHEN 1 THEN 'b' || event_id || '@example.net' WHEN 2 THEN 'b@example.net' END AS "to", CASE v WHEN 0 THEN 'ESMTP' WHEN 1 THEN 'SMTP' WHEN 2 THEN 'ESMTP' END AS proto,
  CASE v WHEN 0 THEN 'h ' || event_id WHEN 2 THEN 'h' || event_id END AS helo FROM (SELECT event_id, event_id % 5 AS v FROM events)""",
    "field_key_grammar": "SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE regexp_full_match(w, '[A-Za-z][A-Za-z0-9_-]{0,31}') GROUP BY w",
    "ns_range": """SELECT event_id, CASE WHEN event_id % 10 < 8 THEN ns BETWEEN -9223372036854775808 AND 9223372036854775807 WHEN event_id % 2 = 0 THEN event_id % 9 + 1 <= 7 ELSE event_id % 9 + 1 <= 8 END AS fits
FROM (SELECT event_id, (event_id * 1000003 % 20000000000 - 10000000000) AS s, s::HUGEINT * 1000000000 + CASE WHEN s < 0 THEN -500000000 ELSE 500000000 END AS ns FROM events)""",
    "conversation_pages": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n BETWEEN 2 AND 3",
}
