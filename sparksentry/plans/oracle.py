"""The same results in DuckDB's SQL, over the same tables."""

from __future__ import annotations

from ..functions import rules
from ..functions.text import TOKEN_PATTERN
from ..operators import decision
from ..functions.augment import KEYWORD_PATTERN, STAND_INS
from ..sources import corpus
from ..sources.corpus import LABELS, SQLI_LABELS, XSS_LABELS
from ..sources.views import ADMIN_URLS, ADMINS, ALLOWED, DENIED, PAYLOADS_SQL, REQUESTS_SQL, TRUSTED, WEBSOCKET_PATHS, _sql, _sql_pick
from .queries import LIMITS, NOISY_LABELS, SETTINGS


def _list(values) -> str:
    return "(" + ", ".join(map(_sql, values)) + ")"


def _any(text: str, patterns) -> str:
    return f"regexp_matches({text}, {_sql('|'.join(f'(?:{p})' for p in patterns))}, 'i')"


def _signature(t: str) -> str:
    return f"CASE WHEN {t} IS NULL THEN NULL WHEN {_any(t, rules.SQLI_RULES.values())} THEN 'sqli' WHEN {_any(t, rules.XSS_RULES.values())} THEN 'xss' ELSE 'benign' END"


def _ratios(t: str) -> tuple[str, str]:
    return f"(len(regexp_extract_all({t}, '%[0-9A-Fa-f]{{2}}')) * 3.0 / length({t}))", f"(length(regexp_replace({t}, '[A-Za-z0-9\\s]', '', 'g')) * 1.0 / length({t}))"


def _anomaly(t: str) -> str:
    p, s = _ratios(t)
    return f"CASE WHEN {t} IS NULL THEN NULL WHEN length({t}) > 2048 OR (length({t}) >= 20 AND ({p} > 0.35 OR {s} > 0.5)) THEN 'anomalous' ELSE 'benign' END"


FOLDED = r"SELECT doc_id AS id, regexp_replace(text, '[^\x00-\x7F]', ' ', 'g') AS text, lang FROM documents"
_PATTERN = TOKEN_PATTERN.removeprefix("(?U)").replace("'", "''")
TOKENS = f"list_transform(regexp_extract_all(text, '{_PATTERN}', 1), lambda t: CASE WHEN regexp_matches(t, '^[a-zA-Z_][a-zA-Z0-9_]*$') THEN lower(t) ELSE t END)"
GRAMS = f"SELECT id, unnest(t || [t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))]) AS term FROM (SELECT id, {TOKENS} AS t FROM ({FOLDED}))"
_TFIDF = f"""counted AS MATERIALIZED (SELECT id, term, count(*) AS n FROM ({GRAMS}) GROUP BY ALL),
vocab AS MATERIALIZED (SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS total, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1.0 AS idf FROM counted GROUP BY term ORDER BY total DESC, term LIMIT 4000),
raw AS (SELECT id, term, (1.0 + ln(n)) * idf AS w FROM counted JOIN vocab USING (term)),
weights AS MATERIALIZED (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw)"""
_NB = f"""{_TFIDF},
prior AS (SELECT lang AS label, ln(count(*) / (SELECT count(*) FROM documents)::DOUBLE) AS prior FROM documents GROUP BY lang),
sums AS (SELECT lang AS label, term, sum(w) AS s FROM weights JOIN documents ON doc_id = id GROUP BY ALL),
grid AS (SELECT label, term, coalesce(s, 0) AS s FROM (SELECT label, term FROM prior, vocab) LEFT JOIN sums USING (label, term)),
model AS MATERIALIZED (SELECT term, label, ln((s + 1.0) / (sum(s) OVER (PARTITION BY label) + (SELECT count(*) FROM vocab))) AS logp FROM grid),
scored AS (SELECT id, label, sum(w * logp) AS s FROM weights JOIN model USING (term) GROUP BY ALL),
best AS (SELECT d.doc_id AS id, p.label, row_number() OVER (PARTITION BY d.doc_id ORDER BY round(coalesce(s.s, 0) + p.prior, 9) DESC, p.label) AS r FROM documents d CROSS JOIN prior p LEFT JOIN scored s ON s.id = d.doc_id AND s.label = p.label)"""

_AGENT = f"CASE WHEN {_any('user_agent', rules.SCANNER_AGENTS)} THEN 'scanner_user_agent:' || left(user_agent, 60) WHEN {_any('user_agent', rules.LIBRARY_AGENTS)} THEN 'low_confidence_ua:' || left(user_agent, 40) END"
_PLAIN_PATHS = [p for p in rules.SENSITIVE_PATHS if "(?!" not in p]
_PATH = f"CASE WHEN {_any('rel_url', _PLAIN_PATHS)} OR (contains(lower(rel_url), '/.well-known/') AND regexp_replace(lower(rel_url), '/\\.well-known/security\\.txt', '', 'g') LIKE '%/.well-known/%') THEN 'sensitive_path:' || left(rel_url, 80) END"
_spoof = lambda ip: f"CASE WHEN {ip} NOT IN {_list(TRUSTED)} AND xff IS NOT NULL THEN 'spoofed_forwarding_header:X-Forwarded-For=' || left(xff, 40) END"
_SPOOF = _spoof("remote")
_REASONS, _CLIENT_REASONS = (f"concat_ws(';', {_AGENT}, {_PATH}, {_spoof(ip)})" for ip in ("remote", "client"))
_CL, _TE = "coalesce(content_length, [])", "coalesce(transfer_encoding, [])"
_BAD_CL, _BAD_TE = f"list_filter({_CL}, lambda x: NOT regexp_full_match(trim(x), '[0-9]+'))", f"list_filter({_TE}, lambda x: lower(trim(x)) <> 'chunked')"
_INTEGRITY = f"""CASE WHEN len(list_distinct({_CL})) > 1 THEN 'conflicting Content-Length headers: ' || array_to_string(list_sort(list_distinct({_CL})), ',')
WHEN len({_BAD_CL}) > 0 THEN 'malformed Content-Length: ' || {_BAD_CL}[1] WHEN len({_CL}) > 0 AND len({_TE}) > 0 THEN 'both Content-Length and Transfer-Encoding present'
WHEN len({_BAD_TE}) > 0 THEN 'unsupported/malformed Transfer-Encoding: ' || {_BAD_TE}[1] END"""
_WS = "coalesce(lower(connection) LIKE '%upgrade%' AND lower(upgrade) LIKE '%websocket%', false)"
_V4 = r"((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_CLIENT = f"CASE WHEN remote IN {_list(TRUSTED)} AND regexp_full_match(trim(split_part(xff, ',', 1)), '{_V4}') THEN trim(split_part(xff, ',', 1)) ELSE remote END"
_SHOWN = "CASE WHEN coalesce(lower(content_type), '') LIKE '%application/x-www-form-urlencoded%' THEN url_decode(body) ELSE body END"
_TEXTS = f"list_filter([url_decode(rel_url), CASE WHEN length(body) > 0 THEN {_SHOWN} END], lambda x: x IS NOT NULL)"
_HEADS = "list_filter([user_agent, xff], lambda x: x IS NOT NULL AND x <> '')"


# the first text that a detector of the cascade blocks, as [label, detectors]: 'anomalous' comes before both other labels
_blocked = lambda texts: f"""list_filter(list_transform({texts}, lambda x: CASE WHEN {_anomaly('x')} <> 'benign' THEN ['anomalous', CASE WHEN {_signature('x')} <> 'benign' THEN 'signature_baseline;' ELSE '' END || 'anomaly'] WHEN {_signature('x')} <> 'benign' THEN [{_signature('x')}, 'signature_baseline'] END), lambda y: y IS NOT NULL)[1]"""
_HEAD = f"list_filter(list_transform({_HEADS}, lambda x: {_signature('x')}), lambda y: y <> 'benign')[1]"
# keys and strings of a JSON body in the order of the text
_LEAVES = "coalesce((SELECT flatten(list(list_filter([CASE WHEN key IS NOT NULL AND NOT regexp_full_match(key, '[0-9]+') THEN key END, CASE WHEN type = 'VARCHAR' THEN atom ->> '$' END], lambda x: x IS NOT NULL) ORDER BY id)) FROM json_tree(body0)), [])"
_path = lambda url: f"regexp_extract({url}, '^[^?#]*')"
_ADMIN_URL = f"CASE WHEN id % 5 = 0 THEN {_sql_pick(ADMIN_URLS, 'floor(id / 5)')} ELSE rel_url END"

_STEPS = f"""SELECT *, client IN {_list(DENIED)} AND client NOT IN {_list(ALLOWED)} AS deny, regexp_replace(reasons, 'low_confidence_ua:[^;]*;?', '') <> '' AS flagged,
{_path('rel_url')} IN {_list(WEBSOCKET_PATHS)} AS ws_ok, CASE WHEN is_json THEN {_blocked("list_filter(list_concat([url_decode(rel_url)], CASE WHEN json_ok THEN leaves WHEN length(body) > 0 THEN [body] ELSE [] END), lambda x: x <> '')")} ELSE {_blocked(f"list_filter({_TEXTS}, lambda x: x <> '')")} END AS hit
FROM (SELECT *, {_CLIENT_REASONS} AS reasons, {_LEAVES} AS leaves FROM (SELECT *, {_CLIENT} AS client, {_INTEGRITY} AS bad, {_WS} AS ws, {_HEAD} AS head_hit,
coalesce(content_type LIKE '%application/json%', false) AS is_json, coalesce(json_valid(body), false) AND length(body) > 0 AS json_ok, CASE WHEN json_valid(body) THEN body ELSE '{{}}' END AS body0 FROM ({REQUESTS_SQL})))"""
_BY = "CASE WHEN deny THEN {0} WHEN flagged THEN {1} WHEN bad IS NOT NULL THEN {2} WHEN ws AND ws_ok THEN {3} WHEN ws THEN {4} WHEN hit IS NOT NULL THEN {5} WHEN head_hit IS NOT NULL THEN {6} ELSE {7} END"
_DECIDED = f"""SELECT *, {_BY.format("'blocked_static_deny'", "'blocked_recon'", "'blocked_malformed'", "'allowed_websocket_passthrough'", "'blocked_websocket'", "'blocked'", "'blocked'", "'allowed'")} AS decision,
{_BY.format("'denylisted'", "'recon'", "'malformed_request'", "'benign'", "'websocket_not_allowed'", "hit[1]", "head_hit", "'benign'")} AS label,
{_BY.format(403, 403, 400, 200, 400, 403, 403, 200)} AS status, {_BY.format(0, 2, 2, 0, 0, 1, 1, 0)} AS offense_weight,
{_BY.format("'static_deny_list'", "reasons", "bad", "''", "'websocket_upgrade'", "hit[2]", "'signature_baseline'", "''")} AS triggered_by,
NOT deny AND NOT flagged AND bad IS NULL AND NOT ws AND is_json AND NOT json_ok AS malformed_json FROM ({_STEPS})"""

_VOTES = {"signature_baseline": _signature("payload"), "anomaly": _anomaly("payload"), "keyword": r"CASE WHEN regexp_matches(lower(payload), '\b(select|union|drop|script|alert)\b') THEN CASE WHEN contains(lower(payload), '<') THEN 'xss' ELSE 'sqli' END ELSE 'benign' END"}


def _ensemble(condition: str) -> str:
    votes = " UNION ALL ".join(f"SELECT id, {k} AS k, '{n}' AS d, {v} AS v FROM p" for k, (n, v) in enumerate(_VOTES.items()))
    return f"""WITH p AS ({PAYLOADS_SQL}), v AS ({votes}), h AS (SELECT id, count(*) AS n, string_agg(d, ',' ORDER BY k) AS ds FROM v WHERE v <> 'benign' GROUP BY id),
l AS (SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, v) AS r FROM v WHERE v <> 'benign' GROUP BY id, v)
SELECT p.id, coalesce(n, 0) {condition} AS blocked, CASE WHEN coalesce(n, 0) {condition} THEN l.v ELSE 'benign' END AS final_label, coalesce(ds, '') AS triggered_by FROM p LEFT JOIN h USING (id) LEFT JOIN l ON l.id = p.id AND l.r = 1"""


_EVALUATED = f"SELECT 'clean' AS split, label AS y_true, {_signature('payload')} AS y_pred FROM ({PAYLOADS_SQL}) UNION ALL SELECT 'encoded', label, {_signature('url_encode(payload)')} FROM ({PAYLOADS_SQL})"
_PER_LABEL = f"SELECT split, l, count(*) FILTER (y_true = l AND y_pred = l) AS tp, count(*) FILTER (y_pred = l) AS p, count(*) FILTER (y_true = l) AS t FROM e, (SELECT unnest({list(LABELS)}) AS l) GROUP BY ALL"
_METRICS = f"""WITH e AS ({_EVALUATED}), c AS ({_PER_LABEL}),
m AS (SELECT split, avg(CASE WHEN p > 0 THEN tp / p::DOUBLE ELSE 0 END) AS macro_precision, avg(CASE WHEN t > 0 THEN tp / t::DOUBLE ELSE 0 END) AS macro_recall, avg(CASE WHEN p + t > 0 THEN 2 * tp / (p + t)::DOUBLE ELSE 0 END) AS macro_f1 FROM c GROUP BY split),
a AS (SELECT split, avg((y_true = y_pred)::INT) AS accuracy FROM e GROUP BY split)"""


def _fold(rows: str, window: int, threshold: int, ban: int) -> str:
    """The limiter as a recursion over each client's rows; rows: id, ip, ts, w."""
    return f"""WITH RECURSIVE o AS MATERIALIZED (SELECT id, ip, epoch_us(ts) AS us, w, row_number() OVER (PARTITION BY ip ORDER BY ts, id) AS rn FROM ({rows})),
f(ip, rn, id, us, off, until, status) AS (SELECT DISTINCT ip, 0::BIGINT, NULL::BIGINT, 0::BIGINT, []::BIGINT[], 0::BIGINT, '' FROM o
UNION ALL SELECT ip, rn, id, us, CASE WHEN us < until OR w = 0 THEN off WHEN len(new) >= {threshold} THEN [] ELSE new END, CASE WHEN us >= until AND w > 0 AND len(new) >= {threshold} THEN us + {ban}000000 ELSE until END,
CASE WHEN us < until THEN 'banned' WHEN w = 0 THEN 'passed' WHEN len(new) >= {threshold} THEN 'ban_triggered' ELSE 'offence' END
FROM (SELECT o.ip, o.rn, o.id, o.us, o.w, f.off, f.until, list_filter(f.off || (CASE WHEN o.w = 2 THEN [o.us, o.us] ELSE [o.us] END), lambda x: x >= o.us - {window}000000) AS new FROM f JOIN o ON o.ip = f.ip AND o.rn = f.rn + 1))"""


_ERRORS = "SELECT event_id AS id, CAST(user_id AS VARCHAR) AS ip, ts, 1 AS w FROM events WHERE event_type = 'error'"
_WEIGHTED = "SELECT event_id AS id, CAST(user_id AS VARCHAR) AS ip, ts, CASE WHEN event_type = 'signup' THEN 2 ELSE 1 END AS w FROM events WHERE event_type IN ('error', 'signup')"
_NOISY = f"([{', '.join(map(_sql, NOISY_LABELS))}])[CAST(id AS BIGINT) % {len(NOISY_LABELS)} + 1]"
_COIN = lambda *parts: f"('0x' || left(md5(concat_ws('|', id, {', '.join(parts)})), 4))::INT"


_LIMITED = f"""{_fold("SELECT id, client AS ip, ts, offense_weight AS w FROM d WHERE decision <> 'blocked_static_deny'", LIMITS.window, LIMITS.threshold, LIMITS.ban).replace("WITH RECURSIVE", f"WITH RECURSIVE d AS MATERIALIZED ({_DECIDED}),", 1)},
b AS MATERIALIZED (SELECT d.* EXCLUDE (decision, label, status, offense_weight, triggered_by, malformed_json), coalesce(f.status, '') = 'banned' AS out, CASE WHEN out THEN 'blocked_ratelimit' ELSE decision END AS decision, CASE WHEN out THEN 'banned_ip' ELSE label END AS label,
CASE WHEN out THEN 429 ELSE d.status END AS status, CASE WHEN out THEN 0 ELSE offense_weight END AS offense_weight, CASE WHEN out THEN 'rate_limiter' ELSE triggered_by END AS triggered_by, malformed_json AND NOT out AS malformed_json,
coalesce(f.status, '') = 'ban_triggered' AND d.decision IN ('blocked_recon', 'blocked') AS ban_triggered, CAST(coalesce(greatest(0, until - us) // 1000000, 0) AS BIGINT) AS seconds_banned, coalesce(until, 0) AS until, coalesce(f.us, epoch_us(ts)) AS us FROM d LEFT JOIN (SELECT * FROM f WHERE rn > 0) f USING (id))"""
_COUNTERS = "SELECT count(*) FILTER (decision LIKE 'allowed%') AS allowed, count(*) FILTER (decision LIKE 'blocked%' AND decision <> 'blocked_static_deny') AS blocked, count(*) FILTER (ban_triggered) AS banned_ips_triggered, count(*) FILTER (decision = 'blocked_static_deny') AS static_denied, min(epoch_us(ts)) / 1e6 AS started_at, max(epoch_us(ts)) / 1e6 - min(epoch_us(ts)) / 1e6 AS uptime_seconds FROM b"
_SHOWN = "id, client, decision, label, status, offense_weight, triggered_by, malformed_json"
_EVENTS = "SELECT * FROM b UNION ALL SELECT * REPLACE ('note_malformed_json' AS decision, 'malformed_json' AS label, 'json_extraction' AS triggered_by) FROM b WHERE malformed_json"
_LOGGED = f"CASE WHEN decision IN ('blocked_websocket', 'allowed_websocket_passthrough') THEN {_path('rel_url')} ELSE rel_url END"
_METRIC_LINES = " || ".join(f"'# HELP {m} {text}' || chr(10) || '# TYPE {m} {kind}' || chr(10) || '{m} ' || {f"printf('%.1f', {c})" if kind == 'gauge' else c} || chr(10)" for m, (c, kind, text) in decision.METRICS.items())
_TAG = "CASE decision " + " ".join(f"WHEN '{d}' THEN '{t}'" for d, t in decision.TAGS.items()) + " END"
_wide = lambda c, n, pad: f"CASE WHEN length({c}) < {n} THEN {pad}({c}, {n}, ' ') ELSE {c} END"


def _drawn(key: str, *parts: str) -> str:
    """A coin of 16 bits, as augment.coin draws it."""
    return f"('0x' || left(md5(concat_ws('|', {', '.join([key, *parts])})), 4))::INT"


def _pick(values, key: str, name: str) -> str:
    return f"({list(values)})[{_drawn(key, _sql(name))} % {len(values)} + 1]" if all("'" not in v for v in values) else f"([{', '.join(map(_sql, values))}])[{_drawn(key, _sql(name))} % {len(values)} + 1]"


def _word(key: str, name: str) -> str:
    return f"ws[{_drawn(key, _sql(name))} % len(ws) + 1]"


def _filled(form: str, key: str) -> str:
    number = f"(('0x' || left(md5(concat_ws('|', {key}, 'n')), 7))::BIGINT % 9999 + 1)::VARCHAR"
    return f"replace(replace(replace({form}, '{{n}}', {number}), '{{word}}', {_word(key, 'word')}), '{{token}}', lower(left(md5(concat_ws('|', {key}, 'token')), 7)))"


def _attacks(kind: str, odd: int, forms) -> str:
    digits, key = [str(i) for i in range(1, 10)], "k"
    taut = f"CASE WHEN {_drawn(key, _sql('taut'))} < 19661 THEN {_pick(digits, key, 'l')} || '=' || {_pick(digits, key, 'r')} ELSE '1=1' END"
    options = f"list_filter([p, CASE WHEN contains(p, '1=1') THEN replace(p, '1=1', {taut}) END, CASE WHEN contains(p, '{corpus.HOSTS[0]}') THEN replace(p, '{corpus.HOSTS[0]}', {_pick(corpus.HOSTS[1:], key, 'host')}) END, CASE WHEN contains(p, 'SLEEP(5)') THEN replace(p, 'SLEEP(5)', 'SLEEP(' || ({_drawn(key, _sql('sleep'))} % 9 + 2) || ')') END], lambda x: x IS NOT NULL)"
    return f"SELECT o[{_drawn(key, _sql('option'))} % len(o) + 1] AS payload, '{kind}' AS label FROM (SELECT k, {options} AS o FROM (SELECT k, {_pick(forms, key, 'form')} AS p FROM (SELECT '42|{kind}|' || event_id AS k FROM events WHERE event_id % 2 = {odd})))"


_PART = "(k || '|' || i)"
_PAIR = f"{_word(_PART, 'name')} || '=' || {_filled(_pick(corpus.VALUE_SHAPES, _PART, 'shape'), _PART)}"
_BENIGN = f"""SELECT DISTINCT (SELECT string_agg(pair, '&' ORDER BY i) FROM (SELECT i, {_PAIR} AS pair FROM (SELECT unnest(range(1, {_drawn('k', _sql('parts'))} % 4 + 2)) AS i))) AS payload, 'benign' AS label
FROM (SELECT '42|benign|' || doc_id AS k, regexp_extract_all(text, '[a-z]{{3,12}}') AS ws FROM documents) WHERE len(ws) > 0"""
# a keyword's first place and the word there
_WORD = f"regexp_extract(payload, {_sql(KEYWORD_PATTERN)}, 0)"
_AT = f"(length(regexp_extract(payload, {_sql('(?s)^(.*?)' + KEYWORD_PATTERN.replace('(?i)', '(?i:') + ')')}, 1)) + 1)"
_CUT = f"({_drawn('id', _sql('cut'))} % greatest(length({_WORD}) - 3, 1) + 2)"
_CHARS = "string_split(payload, '')"
_SPECIAL = _sql(r"[<>'\"()]")
_STAND = f"CASE c {' '.join(f"WHEN {_sql(c)} THEN ([{', '.join(map(_sql, subs))}])[{_drawn('id', _sql('stand'), '(i - 1)')} % {len(subs)} + 1]" for c, subs in STAND_INS.items())} END"
_BEFORE = f"len(list_filter(list_slice({_CHARS}, 1, i - 1), lambda x: regexp_full_match(x, {_SPECIAL})))"

# what is inspected of a captured request
_CAPTURED = f"""SELECT '10.0.' || (u // 256) % 256 || '.' || u % 256 AS src, CAST(id % 60000 + 1024 AS INT) AS src_port, '192.168.' || (id // 15360000) % 256 || '.' || (id // 60000) % 256 AS dst, 0::BIGINT AS nth,
CASE WHEN method = 'GET' AND contains(rel_url, '?') THEN url_decode(regexp_replace(replace(rel_url, ' ', '%20'), '^[^?]*[?]', '')) WHEN method = 'POST' AND length(body) > 0 THEN url_decode(body) END AS payload
FROM (SELECT *, CAST(string_split(remote, '.')[4] AS BIGINT) AS u FROM ({REQUESTS_SQL}))"""

ORACLE_SQL: dict[str, str] = {
    "capture_requests": f"SELECT * FROM ({_CAPTURED}) WHERE payload IS NOT NULL",
    "capture_summary": f"SELECT 6 * count(*) AS packets, count(*) AS requests, count(*) FILTER ({_signature('payload')} <> 'benign') AS malicious FROM ({_CAPTURED})",
    "signature_by_lang": f"SELECT lang, {_signature('text')} AS verdict, {_anomaly('text')} AS anomaly, count(*) AS n FROM ({FOLDED}) GROUP BY ALL",
    "signature_verdicts": f"SELECT id, {_signature('payload')} AS verdict FROM ({PAYLOADS_SQL})",
    "signature_rule_hits": "SELECT rule, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{fam}/{name}' AS rule FROM ({PAYLOADS_SQL}) WHERE {_any('payload', [p])}" for fam, rs in (("sqli", rules.SQLI_RULES), ("xss", rules.XSS_RULES)) for name, p in rs.items()) + ") GROUP BY rule",
    "anomaly_verdicts": f"SELECT id, {_anomaly('text')} AS verdict FROM ({FOLDED})",
    "anomaly_reasons": "SELECT id, concat_ws(';', CASE WHEN length(payload) > 2048 THEN 'length=' || length(payload) || '>2048' END, CASE WHEN length(payload) >= 20 AND {0} > 0.35 THEN printf('percent_encoded_ratio=%.2f', {0}) END, CASE WHEN length(payload) >= 20 AND {1} > 0.5 THEN printf('special_char_ratio=%.2f', {1}) END) AS reasons FROM ({2})".format(*(f"{x}::DOUBLE" for x in _ratios("payload")), PAYLOADS_SQL),
    "recon_flags": f"SELECT id, regexp_replace(reasons, 'low_confidence_ua:[^;]*;?', '') <> '' AS flagged, reasons FROM (SELECT id, {_REASONS} AS reasons FROM ({REQUESTS_SQL}))",
    "recon_user_agent": f"SELECT {_AGENT} AS reason, count(*) AS n FROM ({REQUESTS_SQL}) GROUP BY ALL",
    "recon_sensitive_path": f"SELECT id, {_PATH} AS reason FROM ({REQUESTS_SQL}) WHERE {_PATH} IS NOT NULL",
    "recon_spoofed_headers": f"SELECT id, {_SPOOF} AS reasons FROM ({REQUESTS_SQL}) WHERE {_SPOOF} IS NOT NULL",
    "header_integrity": f"SELECT id, {_INTEGRITY} AS reason FROM ({REQUESTS_SQL})",
    "websocket_upgrade": f"SELECT id, {_WS} AS websocket FROM ({REQUESTS_SQL})",
    "client_ip_resolution": f"SELECT id, {_CLIENT} AS client FROM ({REQUESTS_SQL})",
    "inspectable_texts": f"SELECT id, (unnest(range(len(t))))::INT AS pos, unnest(t) AS text FROM (SELECT id, {_TEXTS} AS t FROM ({REQUESTS_SQL}))",
    "header_texts": f"SELECT id, (unnest(range(len(t))))::INT AS pos, unnest(t) AS text FROM (SELECT id, {_HEADS} AS t FROM ({REQUESTS_SQL}))",
    "http_payload_extract": f"SELECT * FROM (SELECT id, CASE WHEN method = 'GET' AND contains(rel_url, '?') AND rel_url NOT LIKE '% %' THEN url_decode(regexp_replace(rel_url, '^[^?]*[?]', '')) WHEN method = 'POST' AND length(body) > 0 AND rel_url NOT LIKE '% %' THEN url_decode(body) END AS payload FROM ({REQUESTS_SQL})) WHERE payload IS NOT NULL",
    "url_decode_lenient": f"SELECT id, url_decode(payload) AS decoded FROM ({PAYLOADS_SQL})",
    "url_encode_strict": "SELECT page_id, url_encode(url) AS encoded FROM pages",
    "url_encode_double": f"SELECT id, url_encode(url_encode(payload)) AS encoded FROM ({PAYLOADS_SQL})",
    "token_counts": f"SELECT id, CAST(len({TOKENS}) AS BIGINT) AS tokens FROM ({FOLDED})",
    "tokens_top": f"SELECT token, count(*) AS n FROM (SELECT unnest({TOKENS}) AS token FROM ({FOLDED})) GROUP BY token ORDER BY n DESC, token LIMIT 100",
    "ngrams_top": f"SELECT term AS gram, count(*) AS n FROM ({GRAMS}) GROUP BY term ORDER BY n DESC, term LIMIT 100",
    "tfidf_vocab": f"WITH {_TFIDF} SELECT term, df, total, round(idf, 6) AS idf FROM vocab",
    "tfidf_weights": f"WITH {_TFIDF} SELECT id, count(*) AS terms, round(sum(w), 6) AS weight, round(max(w), 6) AS largest FROM weights GROUP BY id",
    "nb_train": f"WITH {_NB} SELECT term, label, round(logp, 6) AS logp FROM model",
    "nb_predict": f"WITH {_NB} SELECT id, label AS predicted FROM best WHERE r = 1",
    "nb_confusion": f"WITH {_NB}, f AS (SELECT lang AS y_true, label AS y_pred FROM best JOIN documents ON doc_id = id WHERE r = 1), g AS (SELECT a.x AS y_true, b.x AS y_pred FROM (SELECT unnest(['de', 'en', 'es', 'fr']) AS x) a, (SELECT unnest(['de', 'en', 'es', 'fr']) AS x) b) SELECT g.y_true, g.y_pred, count(f.y_true) AS n FROM g LEFT JOIN f ON f.y_true = g.y_true AND f.y_pred = g.y_pred GROUP BY ALL",
    "ensemble_any": _ensemble(">= 1"),
    "ensemble_majority": _ensemble("* 2 > 3"),
    "ensemble_all": _ensemble("= 3"),
    "eval_metrics": f"{_METRICS} SELECT split, round(accuracy, 6) AS accuracy, round(macro_precision, 6) AS macro_precision, round(macro_recall, 6) AS macro_recall, round(macro_f1, 6) AS macro_f1 FROM m JOIN a USING (split)",
    "eval_confusion": f"WITH e AS ({_EVALUATED}), l AS (SELECT unnest({list(LABELS)}) AS x) SELECT s.split, a.x AS y_true, b.x AS y_pred, count(e.y_true) AS n FROM (SELECT DISTINCT split FROM e) s CROSS JOIN l a CROSS JOIN l b LEFT JOIN e ON e.split = s.split AND e.y_true = a.x AND e.y_pred = b.x GROUP BY ALL",
    "eval_f1_drop": f"{_METRICS} SELECT round(c.macro_f1, 6) AS f1_clean, round(d.macro_f1, 6) AS f1_encoded, round(c.macro_f1 - d.macro_f1, 6) AS f1_drop FROM m c, m d WHERE c.split = 'clean' AND d.split = 'encoded'",
    "eval_report_lines": f"WITH e AS (SELECT * FROM ({_EVALUATED}) WHERE split = 'clean') SELECT rpad(y_true, 10, ' ') || " + " || ".join(f"lpad((count(*) FILTER (y_pred = '{x}'))::VARCHAR, 10, ' ')" for x in LABELS) + " AS line FROM e GROUP BY y_true",
    "latency_quantiles": "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS longest FROM events GROUP BY event_type",
    "label_counts": f"SELECT label, count(*) AS n FROM ({PAYLOADS_SQL}) GROUP BY label",
    "cascade_decisions": f"SELECT {_SHOWN} FROM ({_DECIDED})",
    "cascade_with_bans": f"{_LIMITED} SELECT {_SHOWN}, ban_triggered, seconds_banned FROM b",
    "decision_counters": f"{_LIMITED} {_COUNTERS}",
    "prometheus_text": f"{_LIMITED} SELECT {_METRIC_LINES} AS exposition FROM ({_COUNTERS})",
    "admin_stats": f"""{_LIMITED}, t AS (SELECT client, count(*) FILTER (offense_weight > 0) AS n, max(until) AS until FROM b GROUP BY client), l AS (SELECT count(*) FILTER (n > 0) AS tracked_ips, count(*) FILTER (until > (SELECT max(epoch_us(ts)) FROM b)) AS active_bans FROM t)
SELECT to_json({{'allowed': allowed, 'blocked': blocked, 'banned_ips_triggered': banned_ips_triggered, 'static_denied': static_denied, 'started_at': floor(started_at)::BIGINT, 'uptime_seconds': round(uptime_seconds, 1), 'policy': '{SETTINGS.voting_policy}', 'detectors': {list(SETTINGS.models)}, 'rate_limiter': {{'backend': 'memory', 'tracked_ips': tracked_ips, 'active_bans': active_bans}}}})::VARCHAR AS stats FROM ({_COUNTERS}), l""",
    "admin_routes": f"SELECT id, url AS rel_url, (CASE WHEN client NOT IN {_list(ADMINS)} THEN 403 WHEN page IN ('health', 'stats', 'metrics') THEN 200 ELSE 404 END)::INT AS status, CASE WHEN client IN {_list(ADMINS)} AND page IN ('health', 'stats', 'metrics') THEN page END AS page FROM (SELECT id, url, client, substr({_path('url')}, 8) AS page FROM (SELECT *, {_ADMIN_URL} AS url, {_CLIENT} AS client FROM ({REQUESTS_SQL}))) WHERE {_path('url')} LIKE '/\\_\\_waf/%' ESCAPE '\\'",
    "decision_log_json": f"{_LIMITED} SELECT id, to_json({{'timestamp': strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'decision': decision, 'client_ip': client, 'method': method, 'path': left({_LOGGED}, 300), 'label': label, 'triggered_by': CASE decision WHEN 'blocked_recon' THEN list_filter([{_AGENT}, {_PATH}, {_spoof('client')}], lambda x: x IS NOT NULL) WHEN 'blocked' THEN string_split(triggered_by, ';') ELSE CASE WHEN triggered_by = '' THEN [] ELSE [triggered_by] END END, 'latency_ms': 0.0::DOUBLE}})::VARCHAR AS event FROM ({_EVENTS})",
    "console_lines": f"{_LIMITED} SELECT id, {_TAG} || ' ' || {_wide('client', 15, 'lpad')} || ' ' || {_wide('method', 6, 'rpad')} || ' ' || rpad(left({_LOGGED}, 60), 60, ' ') || ' label=' || {_wide('label', 8, 'rpad')} || ' latency=  0.00ms' AS line FROM ({_EVENTS})",
    "eval_table": f"""WITH p AS (SELECT 'clean' AS split, label AS y_true, payload FROM ({PAYLOADS_SQL}) UNION ALL SELECT 'obfuscated', label, url_encode(payload) FROM ({PAYLOADS_SQL})), e AS ({" UNION ALL ".join(f"SELECT split, y_true, '{n}' AS detector, {v} AS y_pred FROM p" for n, v in _VOTES.items())}),
c AS (SELECT detector, split, l, count(*) FILTER (y_true = l AND y_pred = l) AS tp, count(*) FILTER (y_pred = l) AS p, count(*) FILTER (y_true = l) AS t FROM e, (SELECT unnest({list(LABELS)}) AS l) GROUP BY ALL),
m AS (SELECT detector, split, avg(CASE WHEN p + t > 0 THEN 2 * tp / (p + t)::DOUBLE ELSE 0 END) AS f1 FROM c GROUP BY ALL), a AS (SELECT detector, split, avg((y_true = y_pred)::INT) AS acc FROM e GROUP BY ALL)
SELECT detector, round(max(acc) FILTER (split = 'clean'), 6) AS accuracy_clean, round(max(f1) FILTER (split = 'clean'), 6) AS f1_clean, round(max(acc) FILTER (split = 'obfuscated'), 6) AS accuracy_obfuscated, round(max(f1) FILTER (split = 'obfuscated'), 6) AS f1_obfuscated, round(max(f1) FILTER (split = 'clean') - max(f1) FILTER (split = 'obfuscated'), 6) AS f1_drop_evasion FROM m JOIN a USING (detector, split) GROUP BY detector""",
    "live_classify": f"SELECT 'signature_baseline' AS model, count(*) AS packets, count(*) FILTER ({_signature('payload')} <> 'benign') AS malicious FROM (SELECT CASE WHEN method = 'GET' AND contains(rel_url, '?') AND rel_url NOT LIKE '% %' THEN url_decode(regexp_replace(rel_url, '^[^?]*[?]', '')) WHEN method = 'POST' AND length(body) > 0 AND rel_url NOT LIKE '% %' THEN url_decode(body) END AS payload FROM ({REQUESTS_SQL})) WHERE payload IS NOT NULL",
    "cascade_status": f"SELECT decision, status, count(*) AS n, CAST(sum(offense_weight) AS BIGINT) AS weight FROM ({_DECIDED}) GROUP BY ALL",
    "ratelimit_fold": _fold(_ERRORS, 172_800, 3, 86_400) + " SELECT id, ip, status, greatest(0, until - us) // 1000000 AS seconds_banned FROM f WHERE rn > 0",
    "ratelimit_weighted": _fold(_WEIGHTED, 172_800, 5, 86_400) + " SELECT id, status FROM f WHERE rn > 0",
    "ratelimit_active_bans": _fold(_ERRORS, 172_800, 3, 86_400) + ", m AS (SELECT ip, max(until) AS until FROM f GROUP BY ip) SELECT count(*) AS tracked_ips, count(*) FILTER (until > (SELECT max(us) FROM o)) AS active_bans FROM m",
    "limiter_state": _fold(_ERRORS, 172_800, 3, 86_400) + ", m AS (SELECT ip, max(until) AS until FROM f GROUP BY ip) SELECT count(*) AS tracked_ips, count(*) FILTER (until > (SELECT max(us) FROM o)) AS active_bans FROM m",
    "cascade_stream": f"{_LIMITED} SELECT {_SHOWN}, ban_triggered, seconds_banned FROM b",
    "offense_sliding_count": f"SELECT id, CAST(sum(w) OVER (PARTITION BY ip ORDER BY ts RANGE BETWEEN INTERVAL 2 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS in_window FROM ({_WEIGHTED})",
    "json_string_leaves": "SELECT conv_id, turn, 'role|' || role || '|parts|text|' || text || '|turn' AS strings, 3 AS max_depth FROM conversations",
    "json_malformed": f"SELECT id, valid, CASE WHEN valid THEN (SELECT count(*) FILTER (type = 'VARCHAR') + count(*) FILTER (key IS NOT NULL AND NOT regexp_full_match(key, '[0-9]+')) FROM json_tree(body0)) WHEN length(body) > 0 THEN 1 ELSE 0 END AS n FROM (SELECT id, CASE WHEN json_valid(body) THEN body ELSE '{{}}' END AS body0, body, coalesce(json_valid(body), false) AND length(body) > 0 AS valid FROM ({REQUESTS_SQL}) WHERE content_type LIKE 'application/json%')",
    "split_exact": f"SELECT id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || id || '|' || payload), id) <= floor(count(*) OVER () * 0.25) THEN 'test' ELSE 'train' END AS split FROM ({PAYLOADS_SQL})",
    "shuffle_permutation": f"SELECT id, row_number() OVER (ORDER BY md5('42|' || id || '|' || payload), id) - 1 AS nth FROM ({PAYLOADS_SQL})",
    "stratified_folds": "SELECT id, label, CAST((row_number() OVER (ORDER BY label NULLS FIRST, md5('42|' || id), id) - 1) % 3 AS INT) AS fold FROM (SELECT doc_id AS id, lang AS label FROM documents)",
    "rank_in_group": "SELECT event_id AS id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS nth FROM events",
    "dedupe_benign": f"SELECT label, CASE WHEN label = 'benign' THEN count(DISTINCT payload) ELSE count(*) END AS n FROM ({PAYLOADS_SQL}) GROUP BY label",
    "label_normalise": f"SELECT CASE WHEN lower(trim({_NOISY})) IN {_list(SQLI_LABELS)} THEN 'sqli' ELSE 'benign' END AS label, count(*) AS n FROM ({PAYLOADS_SQL}) GROUP BY 1",
    "union_sources": f"WITH u AS (SELECT payload, label FROM ({PAYLOADS_SQL}) UNION ALL SELECT payload, CASE WHEN lower(trim({_NOISY})) IN {_list(XSS_LABELS)} THEN 'xss' ELSE 'benign' END FROM ({PAYLOADS_SQL})) SELECT label, CASE WHEN label = 'benign' THEN count(DISTINCT payload) ELSE count(*) END AS n, count(DISTINCT payload) AS payloads FROM u GROUP BY label",
    "aug_url_encode": f"SELECT id, url_encode(payload) AS variant FROM ({PAYLOADS_SQL})",
    "aug_partial": f"SELECT id, array_to_string(list_transform(string_split(payload, ''), lambda c, i: CASE WHEN NOT regexp_full_match(c, '[A-Za-z0-9]') AND {_COIN(chr(39) + 'partial' + chr(39), 'i - 1')} < 32768 THEN url_encode(c) ELSE c END), '') AS variant FROM ({PAYLOADS_SQL})",
    "aug_whitespace": f"SELECT id, array_to_string(list_transform(string_split(payload, ''), lambda c, i: CASE WHEN c = ' ' THEN [chr(9), chr(10), '/**/', '%09', '%0a'][{_COIN(chr(39) + 'space' + chr(39), 'i - 1')} % 5 + 1] ELSE c END), '') AS variant FROM ({PAYLOADS_SQL})",
    "aug_case_all": f"SELECT id, array_to_string(list_transform(string_split(payload, ''), lambda c, i: CASE WHEN {_COIN(chr(39) + 'all' + chr(39), 'i - 1')} < 32768 THEN upper(c) ELSE lower(c) END), '') AS variant FROM ({PAYLOADS_SQL})",
    "synthetic_corpus": f"{_BENIGN} UNION ALL {_attacks('sqli', 0, corpus.SQLI_FORMS)} UNION ALL {_attacks('xss', 1, corpus.XSS_FORMS)}",
    "aug_comment": f"SELECT id, CASE WHEN length({_WORD}) >= 4 THEN left(payload, {_AT} + {_CUT} - 1) || CASE WHEN {_drawn('id', _sql('version'))} < 32768 THEN '/**/' ELSE '/*!50000*/' END || substr(payload, {_AT} + {_CUT}) ELSE payload END AS variant FROM ({PAYLOADS_SQL})",
    "aug_unicode": f"SELECT id, array_to_string(list_transform({_CHARS}, lambda c, i: CASE WHEN regexp_full_match(c, {_SPECIAL}) AND ({_BEFORE} = {_drawn('id', _sql('forced'))} % greatest(len(regexp_extract_all(payload, {_SPECIAL})), 1) OR {_drawn('id', _sql('sub'), '(i - 1)')} < 45875) THEN {_STAND} ELSE c END), '') AS variant FROM ({PAYLOADS_SQL})",
    "recon_cube": f"SELECT method, decision, count(*) AS n FROM ({_DECIDED}) GROUP BY CUBE (method, decision)",
    "stream_window_counts": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_session_counts": "SELECT user_id, count(*) FILTER (gap IS NULL OR gap >= INTERVAL 1 DAY) AS sessions, count(*) AS n FROM (SELECT user_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) GROUP BY user_id",
    "stream_ratelimit": _fold(_ERRORS, 172_800, 3, 86_400) + " SELECT id, ip, status FROM f WHERE rn > 0",
}

# what a stream leaves behind is what the batch gives
ORACLE_SQL["decision_log_files"] = f"SELECT event FROM ({ORACLE_SQL['decision_log_json']})"
ORACLE_SQL["prometheus_live"] = ORACLE_SQL["prometheus_text"]
