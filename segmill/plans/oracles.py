"""The same results in the checking engine's SQL, one statement per query."""

from __future__ import annotations

from segmill.operators.catalogue import ERROR_RULES
from segmill.operators.glossary import BLOCKED_PHRASES, LATIN_STOP_WORDS, TECHNICAL_STOP_WORDS
from segmill.plans.views import phrase_hits, with_views

NW = r"[^\p{L}\p{N}_]"
# URL groups: scheme, user, host, port, path, query.
URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?([^?#]*)(\?[^#]*)?"


def _u(column: str, group: int) -> str:
    return f"regexp_extract({column}, '{URL}', {group})"


def _host(column: str) -> str:
    return rf"regexp_replace(lower({_u(column, 3)}), '\.+$', '')"


def _key(text: str) -> str:
    return (
        f"trim(regexp_replace(replace(replace(replace(lower({text}), 'ß', 'ss'), '+', ' plus '), '#', ' sharp '), "
        rf"'[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
    )


def _compact(text: str) -> str:
    return f"regexp_replace(replace(lower({text}), 'ß', 'ss'), '[^a-zа-яё0-9]+', '', 'g')"


def _clock(ms: str, sep: str | None = None) -> str:
    base = f"printf('%02d:%02d:%02d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60)"
    return base if sep is None else f"{base} || '{sep}' || printf('%03d', {ms} % 1000)"


def _list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _count(doubled: str, pattern: str) -> str:
    return f"len(regexp_extract_all({doubled}, {pattern}))"


# Texts with every separator doubled, so that whole-word matches never share one.
def _doubled(text: str) -> str:
    return rf"(' ' || regexp_replace({text}, '({NW})', '\1\1', 'g') || ' ')"


SQL: dict[str, str] = {}

SQL["read_captions"] = with_views("v_cues") + rf"""
SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY start_ms, end_ms, cue_idx) - 1 AS cue_idx, start_ms, end_ms, text
FROM (SELECT rec_id, cue_idx, start_ms, end_ms,
  trim(regexp_replace(regexp_replace(regexp_replace(text, '\{{\\[^}}]+\}}', '', 'g'), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS text
  FROM v_cues WHERE end_ms > start_ms) WHERE text <> ''"""

SQL["captions_reference_text"] = with_views("v_cues") + r"""
SELECT rec_id, coalesce(string_agg(text, ' ' ORDER BY cue_idx) FILTER (WHERE text <> '' AND NOT regexp_matches(text, '^[0-9]+$')
  AND NOT starts_with(text, 'Kind:') AND NOT starts_with(text, 'Language:') AND NOT starts_with(text, 'NOTE')
  AND text <> 'WEBVTT' AND NOT contains(text, '-->')), '') AS text
FROM (SELECT rec_id, cue_idx, trim(text) AS text FROM v_cues) GROUP BY rec_id"""

SQL["read_media_recordings"] = with_views("words") + """
SELECT CAST(doc_id AS VARCHAR) AS rec_id,
  CASE WHEN doc_id % 4 <> 0 AND array_to_string(w[1:6], ' ') <> '' THEN array_to_string(w[1:6], ' ') ELSE 'Без названия' END AS title,
  CASE WHEN doc_id % 3 = 0 OR source = '' THEN 'up ' || lang ELSE source END AS author,
  CASE WHEN doc_id % 7 <> 0 THEN n_chars END AS duration_s,
  CASE WHEN doc_id % 7 = 0 THEN 'Неизвестно' WHEN n_chars >= 3600
    THEN printf('%02d:%02d:%02d', n_chars // 3600, n_chars // 60 % 60, n_chars % 60)
    ELSE printf('%02d:%02d', n_chars // 60, n_chars % 60) END AS duration_text
FROM documents JOIN words USING (doc_id)"""

TRACKS = """
v_tracks AS (
  SELECT CAST(doc_id AS VARCHAR) AS rec_id, t.kind, t.ord, t.language, t.variant_ord, t.ext, t.file_format, t.name FROM (
    SELECT doc_id, unnest(
      CASE WHEN doc_id % 3 = 0 THEN [
        {'kind': 'manual', 'ord': 0, 'language': lang, 'variant_ord': 0, 'ext': 'json3', 'file_format': NULL, 'name': NULL},
        {'kind': 'manual', 'ord': 0, 'language': lang, 'variant_ord': 1, 'ext': 'vtt', 'file_format': 'vtt', 'name': source},
        {'kind': 'manual', 'ord': 1, 'language': '../../bad', 'variant_ord': 0, 'ext': 'vtt', 'file_format': 'vtt', 'name': 'x'}
      ] ELSE [] END
      || [{'kind': 'automatic', 'ord': 0, 'language': CASE WHEN doc_id % 2 = 0 THEN 'en-US' ELSE 'de' END, 'variant_ord': 0,
           'ext': NULL, 'file_format': 'srt', 'name': 'auto'}]
      || CASE WHEN doc_id % 5 = 0 THEN [
        {'kind': 'automatic', 'ord': 1, 'language': 'ru_RU', 'variant_ord': 0, 'ext': 'srt', 'file_format': 'srt', 'name': NULL},
        {'kind': 'automatic', 'ord': 1, 'language': 'ru_RU', 'variant_ord': 1, 'ext': 'vtt', 'file_format': 'vtt', 'name': 'ru'}
      ] ELSE [
        {'kind': 'automatic', 'ord': 1, 'language': 'ru_RU', 'variant_ord': 0, 'ext': 'ttml', 'file_format': NULL, 'name': 'no'}
      ] END) AS t FROM documents))"""

SQL["read_media_tracks"] = f"WITH {TRACKS} SELECT rec_id, kind, CAST(ord AS BIGINT) AS ord, language, CAST(variant_ord AS BIGINT) AS variant_ord, ext, file_format, name FROM v_tracks"


def _track(tiers: str) -> str:
    return f"""WITH {TRACKS}
SELECT rec_id, language, kind, file_format, name FROM (
  SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY tier, variant, code, ord,
    CASE file_format WHEN 'vtt' THEN 1 ELSE 2 END, variant_ord) AS rn
  FROM (SELECT *, {tiers} FROM v_tracks
    WHERE regexp_matches(language, '^[a-zA-Z]{{2,8}}(?:[-_][a-zA-Z0-9]{{1,12}})*$') AND file_format IN ('vtt', 'srt'))
  WHERE tier IS NOT NULL) WHERE rn = 1"""


_BASE = "split_part(lower(replace(language, '_', '-')), '-', 1)"
_AUTO = "CASE WHEN kind = 'automatic' THEN 1 ELSE 0 END"
SQL["choose_subtitle_track"] = _track(
    f"""CASE WHEN {_BASE} = 'ru' THEN 0 ELSE 2 END + {_AUTO} AS tier,
    {_BASE} = 'ru' AND lower(replace(language, '_', '-')) <> 'ru' AS variant, lower(language) AS code"""
)
SQL["choose_subtitle_track_requested"] = _track(
    f"""CASE WHEN {_BASE} = 'ru' THEN 0 WHEN {_BASE} = 'en' THEN 2 END + {_AUTO} AS tier,
    lower(replace(language, '_', '-')) NOT IN ('ru', 'en') AS variant,
    CASE WHEN lower(replace(language, '_', '-')) IN ('ru', 'en') THEN '' ELSE lower(language) END AS code"""
)

SQL["list_subtitle_options"] = f"""WITH {TRACKS},
listed AS (SELECT rec_id, kind = 'automatic' AS automatic, ord, trim(language) AS language, bool_or(ext IN ('vtt', 'srt')) AS usable,
    arg_min(name, variant_ord) FILTER (WHERE coalesce(name, '') <> '') AS name
  FROM v_tracks WHERE trim(language) <> '' AND length(trim(language)) <= 32 GROUP BY ALL)
SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY NOT starts_with(lower(language), 'ru'), automatic, lower(language)) AS option,
  language, coalesce(name, language) AS name, automatic
FROM listed WHERE usable"""

SQL["read_term_dictionary"] = with_views("dict_variants") + """
SELECT t.term_id, value, category, pos, key FROM dict_terms t JOIN dict_variants USING (term_id)"""

_BODY = "CASE WHEN speaker <> '' THEN {left} || speaker || {right} ELSE '' END || text"
SQL["write_transcripts"] = with_views("v_segments") + rf""",
cleaned AS (SELECT rec_id, seg_idx, start_ms, end_ms, speaker, text FROM (
  SELECT rec_id, seg_idx, start_ms, end_ms, speaker, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM v_segments)
  WHERE text <> '' AND (length(text) > 2 OR regexp_matches(text, '[\p{{L}}\p{{N}}]'))),
units AS (
  SELECT rec_id, 'txt' AS format, seg_idx AS unit, '[' || {_clock('start_ms')} || ']' || chr(10)
    || {_BODY.format(left="''", right="': '")} AS text FROM cleaned
  UNION ALL
  SELECT rec_id, 'md', seg_idx + 1, '### ' || {_clock('start_ms')} || chr(10) || chr(10)
    || {_BODY.format(left="'**'", right="':** '")} FROM cleaned
  UNION ALL
  SELECT CAST(doc_id AS VARCHAR), 'md', 0, array_to_string(['# Rec ' || doc_id, '', '- Link: https://host.example/' || doc_id,
    '- Автор: ' || CASE WHEN doc_id % 3 <> 0 AND source <> '' THEN source ELSE 'Не указан' END, '- Продолжительность: 00:10',
    '- Язык: ' || lang, '- Модель распознавания: model a', '- Дата транскрибации: 02.01.2024 03:04', '', '## Транскрибация'], chr(10))
  FROM documents
  UNION ALL
  SELECT rec_id, 'srt', seg_idx, row_number() OVER (PARTITION BY rec_id ORDER BY seg_idx) || chr(10) || {_clock('start_ms', ',')}
    || ' --> ' || {_clock('end_ms', ',')} || chr(10) || {_BODY.format(left="''", right="': '")} FROM cleaned
  UNION ALL
  SELECT rec_id, 'vtt', seg_idx + 1, {_clock('start_ms', '.')} || ' --> ' || {_clock('end_ms', '.')} || chr(10)
    || {_BODY.format(left="''", right="': '")} FROM cleaned
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 'vtt', 0, 'WEBVTT' FROM documents)
SELECT rec_id, format, CAST(0 AS BIGINT) AS part, string_agg(text, chr(10) || chr(10) ORDER BY unit) || chr(10) AS content
FROM units GROUP BY rec_id, format"""

SQL["clean_segments"] = with_views("v_segments") + r"""
SELECT rec_id, CAST(seg_idx AS BIGINT) AS seg_idx, greatest(0, s) AS start_ms, greatest(s, e) AS end_ms, text, speaker FROM (
  SELECT rec_id, seg_idx, speaker, start_ms - 5000 AS s,
    CASE WHEN seg_idx % 7 = 2 THEN start_ms - 5000 - 9000 + 5000 ELSE end_ms - 5000 END AS e,
    trim(regexp_replace(CASE WHEN seg_idx % 10 = 3 THEN ' .. ' WHEN seg_idx % 10 = 4 THEN chr(9) || text || '  ' || chr(10) || ' x'
      ELSE text END, '\s+', ' ', 'g')) AS text FROM v_segments)
WHERE text <> '' AND (length(text) > 2 OR regexp_matches(text, '[\p{L}\p{N}]'))"""

SQL["clip_time_range"] = with_views("v_segments") + """
SELECT rec_id, CAST(seg_idx AS BIGINT) AS seg_idx, greatest(start_ms, 30000) AS start_ms, least(end_ms, 90000) AS end_ms
FROM v_segments WHERE end_ms > 30000 AND start_ms < 90000 AND least(end_ms, 90000) > greatest(start_ms, 30000)"""

_RANGES = """
v_ranges AS (SELECT *, CASE WHEN duration_ms > 0 AND e IS NOT NULL THEN least(e, duration_ms) ELSE e END AS clamped FROM (
  SELECT CAST(doc_id AS VARCHAR) AS rec_id, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 11 * 1000 - 1000 END AS s,
    CASE WHEN doc_id % 6 <> 0 THEN doc_id % 11 * 1000 + doc_id % 13 * 300 END AS e,
    CASE WHEN doc_id % 7 <> 0 THEN n_chars * 3 END AS duration_ms FROM documents)),
v_checked AS (SELECT *, CASE WHEN s IS NULL AND e IS NULL THEN NULL WHEN s IS NULL OR e IS NULL THEN 'incomplete'
  WHEN s < 0 OR e - s < 500 THEN 'invalid' WHEN duration_ms > 0 AND s >= duration_ms THEN 'after_end'
  WHEN clamped - s < 500 THEN 'too_short' END AS reason FROM v_ranges)"""

SQL["validate_ranges"] = f"""WITH {_RANGES.strip()}
SELECT rec_id, s AS range_start_ms, CASE WHEN reason IS NULL THEN clamped ELSE e END AS range_end_ms, reason IS NULL AS valid, reason
FROM v_checked"""

SQL["clip_to_ranges"] = with_views("v_segments") + f""", {_RANGES.strip()}
SELECT rec_id, CAST(seg_idx AS BIGINT) AS seg_idx, greatest(start_ms, lo) AS start_ms, least(end_ms, hi) AS end_ms FROM (
  SELECT g.*, greatest(0, coalesce(s, 0)) AS lo, coalesce(CASE WHEN reason IS NULL THEN clamped END, 9000000000000000) AS hi
  FROM v_segments g LEFT JOIN (SELECT * FROM v_checked WHERE reason IS NULL) USING (rec_id))
WHERE end_ms > lo AND start_ms < hi AND least(end_ms, hi) > greatest(start_ms, lo)"""

SQL["shift_time"] = with_views("v_segments") + """
SELECT rec_id, CAST(seg_idx AS BIGINT) AS seg_idx, greatest(0, start_ms - 20000) AS start_ms,
  greatest(greatest(0, start_ms - 20000), end_ms - 20000) AS end_ms FROM v_segments"""

SQL["attribute_source"] = f"""
SELECT page_id, coalesce(name, 'Медиа') AS source_name, name IS NOT NULL AND scheme IN ('http', 'https') AS supported FROM (
  SELECT page_id, lower({_u('url', 1)}) AS scheme, CASE
    WHEN h = 'm.example.com' OR ends_with(h, '.m.example.com') THEN 'Mobile'
    WHEN h = 'blog.example.org' OR ends_with(h, '.blog.example.org') THEN 'Blog'
    WHEN h = 'example.com' OR ends_with(h, '.example.com') THEN 'Com'
    WHEN h = 'example.net' OR ends_with(h, '.example.net') THEN 'Net' END AS name
  FROM (SELECT page_id, url, {_host('url')} AS h FROM pages))"""


def _canonical(url: str, path: str) -> str:
    scheme, port, query = f"lower({_u(url, 1)})", _u(url, 4), _u(url, 6)
    return f"""{scheme} || '://' || {_host(url)}
    || CASE WHEN {port} IN ('', '0') OR ({scheme} = 'http' AND {port} = '80') OR ({scheme} = 'https' AND {port} = '443') THEN ''
       ELSE ':' || {port} END
    || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {query} = '?' THEN '' ELSE {query} END"""


_RULED = rf"""(CASE WHEN {_host('url')} = 'example.com' OR ends_with({_host('url')}, '.example.com')
      THEN regexp_replace({_u('url', 5)}, '(?i)/media\.m3u8$', '/master.m3u8')
    WHEN {_host('url')} = 'example.net' OR ends_with({_host('url')}, '.example.net')
      THEN regexp_replace({_u('url', 5)}, '^/en/', '/eng/') ELSE {_u('url', 5)} END)"""
SQL["canonicalize_url"] = with_views("v_media_list") + f"""
SELECT list_id, pos, {_canonical('url', _RULED)} AS canonical_url FROM v_media_list"""

SQL["dedupe_media_list"] = with_views("v_media_list") + f""",
firsts AS (SELECT list_id, min(pos) AS pos, arg_min(url, pos) AS url FROM (
    SELECT list_id, pos, trim(url) AS url, {_canonical('url', _u('url', 5))} AS identity FROM v_media_list) GROUP BY list_id, identity),
ranked AS (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY pos) AS rn, count(*) OVER (PARTITION BY list_id) AS n FROM firsts)
SELECT list_id, rn AS "index", pos, url,
  CASE WHEN pos % 4 <> 0 THEN 'page ' || pos ELSE 'Видео ' || rn END AS title,
  CASE WHEN pos % 6 <> 0 THEN pos % 10000 END AS duration_s,
  CASE WHEN pos % 6 = 0 THEN 'Неизвестно' WHEN pos % 10000 >= 3600
    THEN printf('%02d:%02d:%02d', pos % 10000 // 3600, pos % 10000 // 60 % 60, pos % 10000 % 60)
    ELSE printf('%02d:%02d', pos % 10000 // 60, pos % 10000 % 60) END AS duration_text,
  n > 50 AS truncated
FROM ranked WHERE rn <= 50"""

SQL["assign_output_names"] = r"""
WITH stems AS (SELECT page_id, CASE WHEN c = '' THEN 'video' ELSE c END AS stem FROM (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+(.*)$', 1),
    '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g') AS c FROM pages))
SELECT page_id, stem || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END || '.md' AS file_name
FROM (SELECT page_id, stem, row_number() OVER (PARTITION BY stem ORDER BY page_id) AS n FROM stems)"""

SQL["read_request_events"] = with_views("v_requests") + """
SELECT tab_id, seq, request_id, url, content_type FROM v_requests"""

SQL["classify_media"] = with_views("v_requests") + r"""
SELECT seq, CASE WHEN contains(b, '.m3u8') OR contains(b, 'mpegurl') THEN 'hls' WHEN contains(b, '.mpd') OR contains(b, 'dash+xml') THEN 'dash'
    WHEN contains(b, 'audio/') THEN 'audio' WHEN regexp_matches(url, '(?i)\.(?:mp4|webm|m4v|mov)(?:$|[?#])') OR contains(b, 'video/')
    THEN 'video' ELSE 'unknown' END AS kind,
  CAST(CASE WHEN event_type = 'view' THEN 1000 WHEN event_type = 'signup' THEN 900 WHEN event_type = 'click' THEN 200
    WHEN event_type = 'purchase' THEN 100 ELSE 0 END AS BIGINT) AS priority
FROM (SELECT *, lower(url || ' ' || content_type) AS b FROM v_requests)"""

SQL["scrub_headers"] = with_views("v_requests") + """
SELECT seq, 'agent/' || page_id AS user_agent, CASE WHEN seq % 3 = 0 THEN 'c=' || seq END AS cookie,
  CASE WHEN seq % 7 <> 0 THEN 'https://site.example' END AS origin, page_url AS referer,
  CAST(2 + CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN seq % 7 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS n_headers
FROM v_requests"""

SQL["guard_public_url"] = """
SELECT page_id, reason IS NULL AS public, reason FROM (SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'private_address'
  WHEN 2 THEN 'credentials' WHEN 3 THEN 'local_name'
  WHEN 4 THEN CASE WHEN page_id % 40 BETWEEN 16 AND 31 THEN 'private_address' END
  WHEN 5 THEN 'private_address' WHEN 6 THEN 'local_name' WHEN 7 THEN 'scheme' END AS reason FROM pages)"""


def _errors() -> str:
    message = """CASE event_type WHEN 'view' THEN 'ERROR: Private video' WHEN 'click' THEN 'Connection TIMED OUT'
    WHEN 'purchase' THEN 'HTTP Error 403: Forbidden by FFmpeg' WHEN 'signup' THEN 'No space left on device' ELSE props END"""
    parts = []
    for context, rules in ERROR_RULES.items():
        cases = " ".join(
            "WHEN " + " OR ".join(f"contains(m, '{n}')" for n in needles) + f" THEN '{name}'" for name, needles in rules
        )
        parts.append(f"SELECT '{context}' AS context, CASE {cases} ELSE 'other' END AS category, count(*) AS n FROM logs GROUP BY ALL")
    return f"WITH logs AS (SELECT lower({message}) AS m FROM events)\n" + "\nUNION ALL\n".join(parts)


SQL["classify_errors"] = _errors()

# --- speakers -----------------------------------------------------------------------

_OVERLAP = """
seg_bins AS MATERIALIZED (SELECT rec_id, seg_idx, start_ms, end_ms, unnest(range((start_ms - 1000) // 30000, (end_ms + 1000) // 30000 + 1)) AS bin FROM v_segments),
turn_bins AS MATERIALIZED (SELECT rec_id, start_ms, end_ms, speaker, unnest(range(start_ms // 30000, end_ms // 30000 + 1)) AS bin FROM v_turns),
met AS MATERIALIZED (SELECT s.rec_id, s.seg_idx, s.start_ms, s.end_ms, t.speaker, t.start_ms AS t0, t.end_ms AS t1
  FROM seg_bins s JOIN turn_bins t ON s.rec_id = t.rec_id AND s.bin = t.bin
  WHERE s.bin = greatest((s.start_ms - 1000) // 30000, t.start_ms // 30000)),
pairs AS MATERIALIZED (SELECT rec_id, seg_idx, speaker, least(end_ms, t1) - greatest(start_ms, t0) AS ov, greatest(start_ms, t0) AS first_ms
  FROM met WHERE t0 < end_ms AND t1 > start_ms),
best AS MATERIALIZED (SELECT rec_id, seg_idx, speaker FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, seg_idx
    ORDER BY ov DESC, first_ms, speaker) AS rn FROM (SELECT rec_id, seg_idx, speaker, sum(ov) AS ov, min(first_ms) AS first_ms
    FROM pairs WHERE ov > 0 GROUP BY ALL)) WHERE rn = 1)"""
_NEAR = """
near AS (SELECT rec_id, seg_idx, speaker, gap FROM (SELECT s.rec_id, s.seg_idx, s.speaker,
    greatest(t0 - s.end_ms, s.start_ms - t1, 0) AS gap,
    row_number() OVER (PARTITION BY s.rec_id, s.seg_idx ORDER BY greatest(t0 - s.end_ms, s.start_ms - t1, 0), t0, s.speaker) AS rn
  FROM met s ANTI JOIN best b ON b.rec_id = s.rec_id AND b.seg_idx = s.seg_idx) WHERE rn = 1 AND gap <= 1000)"""

SQL["assign_speakers"] = with_views("v_segments", "v_turns") + f""", {_OVERLAP.strip()}, {_NEAR.strip()}
SELECT s.rec_id, CAST(s.seg_idx AS BIGINT) AS seg_idx, CAST(coalesce(b.speaker, n.speaker) AS BIGINT) AS speaker
FROM v_segments s LEFT JOIN best b USING (rec_id, seg_idx) LEFT JOIN near n USING (rec_id, seg_idx)"""

SQL["assign_speakers_overlap"] = with_views("v_segments", "v_turns") + f""", {_OVERLAP.strip()}
SELECT s.rec_id, CAST(s.seg_idx AS BIGINT) AS seg_idx, CAST(b.speaker AS BIGINT) AS speaker
FROM v_segments s LEFT JOIN best b USING (rec_id, seg_idx)"""

SQL["assign_nearest_turn"] = with_views("v_segments", "v_turns") + f""", {_OVERLAP.strip()}, {_NEAR.strip()}
SELECT rec_id, CAST(seg_idx AS BIGINT) AS seg_idx, CAST(speaker AS BIGINT) AS speaker, CAST(gap AS BIGINT) AS gap_ms FROM near"""

SQL["speaker_stats"] = with_views("v_turns") + """
SELECT rec_id, CAST(speaker AS BIGINT) AS speaker, CAST(sum(end_ms - start_ms) AS BIGINT) AS speech_ms, count(*) AS turns,
  count(*) OVER (PARTITION BY rec_id) AS rec_speakers, CAST(sum(count(*)) OVER (PARTITION BY rec_id) AS BIGINT) AS rec_turns
FROM v_turns GROUP BY rec_id, speaker"""


def _renumber(table: str) -> str:
    return f"""
    SELECT t.rec_id, t.start_ms, t.end_ms, n.number AS speaker FROM {table} t JOIN (
      SELECT rec_id, speaker, row_number() OVER (PARTITION BY rec_id ORDER BY m.s, m.e, m.k) - 1 AS number FROM (
        SELECT rec_id, speaker, min({{'s': start_ms, 'e': end_ms, 'k': speaker}}) AS m FROM {table} GROUP BY rec_id, speaker)) n
    ON t.rec_id = n.rec_id AND t.speaker = n.speaker"""


SQL["renumber_speakers"] = with_views("v_turns") + f""",
messy AS (SELECT rec_id, greatest(0, start_ms - 700) AS start_ms, greatest(greatest(0, start_ms - 700), end_ms) AS end_ms,
  5 - speaker * 2 AS speaker FROM v_turns),
kept AS (SELECT * FROM messy WHERE end_ms > start_ms AND speaker >= 0)
{_renumber('kept')}"""

SQL["collapse_tiny_speakers"] = with_views("v_turns") + f""",
spoken AS (SELECT rec_id, speaker, sum(end_ms - start_ms) AS spoken FROM v_turns GROUP BY ALL),
marked AS (SELECT rec_id, speaker, spoken >= least(3000, greatest(1500, sum(spoken) OVER r * 0.03)) AS stable, count(*) OVER r AS n
  FROM spoken WINDOW r AS (PARTITION BY rec_id)),
decided AS (SELECT *, n > 2 AND k > 0 AND k < n AS applies FROM (
  SELECT *, sum(CASE WHEN stable THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id) AS k FROM marked)),
flagged AS (SELECT t.*, stable, applies FROM v_turns t JOIN decided USING (rec_id, speaker)),
tiny AS (SELECT DISTINCT rec_id, start_ms AS s0, end_ms AS s1 FROM flagged WHERE applies AND NOT stable),
nearest AS (SELECT rec_id, s0, s1, speaker AS new FROM (
  SELECT y.rec_id, s0, s1, f.speaker, row_number() OVER (PARTITION BY y.rec_id, s0, s1
    ORDER BY greatest(f.start_ms - s1, s0 - f.end_ms, 0), abs(f.start_ms + f.end_ms - s0 - s1), f.start_ms, f.end_ms, f.speaker) AS rn
  FROM tiny y JOIN flagged f ON f.rec_id = y.rec_id AND f.applies AND f.stable) WHERE rn = 1),
merged AS (SELECT f.rec_id, f.start_ms, f.end_ms, applies, CASE WHEN applies AND NOT stable THEN new ELSE speaker END AS speaker
  FROM flagged f LEFT JOIN nearest n ON n.rec_id = f.rec_id AND n.s0 = f.start_ms AND n.s1 = f.end_ms),
changed AS (SELECT rec_id, start_ms, end_ms, speaker FROM merged WHERE applies)
SELECT rec_id, start_ms, end_ms, CAST(speaker AS BIGINT) AS speaker FROM (
  {_renumber('changed')}
  UNION ALL SELECT rec_id, start_ms, end_ms, speaker FROM merged WHERE NOT applies)"""

# --- blocks -------------------------------------------------------------------------

BLOCKS = r"""
cleaned AS (SELECT rec_id, seg_idx, start_ms, end_ms, speaker, text, length(text) AS n FROM (
  SELECT rec_id, seg_idx, start_ms, end_ms, speaker, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM v_segments)
  WHERE text <> '' AND (length(text) > 2 OR regexp_matches(text, '[\p{L}\p{N}]'))),
prev AS (SELECT *, row_number() OVER w AS pos, lag(end_ms) OVER w AS pe, lag(speaker) OVER w AS ps, lag(text) OVER w AS pt
  FROM cleaned WINDOW w AS (PARTITION BY rec_id ORDER BY seg_idx)),
cut AS (SELECT *, sum(CASE WHEN pe IS NULL OR ps IS DISTINCT FROM speaker OR start_ms - pe >= 2500 THEN 1 ELSE 0 END)
  OVER (PARTITION BY rec_id ORDER BY pos) AS run FROM prev),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY rec_id, run ORDER BY pos) AS k FROM cut),
fold(rec_id, run, k, seg_idx, first_seg, begin_ms, chars) AS (
  SELECT rec_id, run, k, seg_idx, seg_idx, start_ms, n FROM numbered WHERE k = 1
  UNION ALL
  SELECT s.rec_id, s.run, s.k, s.seg_idx, CASE WHEN b THEN s.seg_idx ELSE f_first END, CASE WHEN b THEN s.start_ms ELSE f_begin END,
    CASE WHEN b THEN n ELSE f_chars + n + 1 END
  FROM (SELECT s.*, f.first_seg AS f_first, f.begin_ms AS f_begin, f.chars AS f_chars,
      s.end_ms - f.begin_ms >= 50000 OR f.chars + s.n + 1 > 650
      OR (f.chars >= 280 AND right(pt, 1) IN ('.', '!', '?', '…') AND s.start_ms - pe >= 500) AS b
    FROM fold f JOIN numbered s ON s.rec_id = f.rec_id AND s.run = f.run AND s.k = f.k + 1) s),
blocks AS (SELECT rec_id, first_seg, min(start_ms) FILTER (WHERE seg_idx = first_seg) AS start_ms, arg_max(end_ms, seg_idx) AS end_ms,
    string_agg(text, ' ' ORDER BY seg_idx) AS text, any_value(speaker) AS speaker, count(*) AS n_segments
  FROM fold JOIN numbered USING (rec_id, run, k, seg_idx) GROUP BY rec_id, first_seg)"""

SQL["build_blocks"] = with_views("v_segments", recursive=True) + f""", {BLOCKS.strip()}
SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY first_seg) - 1 AS block_idx, CAST(first_seg AS BIGINT) AS first_seg,
  start_ms, end_ms, text, speaker, n_segments FROM blocks"""

SQL["block_stats"] = with_views("v_segments", recursive=True) + f""", {BLOCKS.strip()}
SELECT lang, speaker, count(*) AS blocks, CAST(sum(n_segments) AS BIGINT) AS segments, CAST(sum(length(b.text)) AS BIGINT) AS chars,
  CAST(sum(end_ms - start_ms) AS BIGINT) AS duration_ms
FROM blocks b JOIN documents d ON CAST(d.doc_id AS VARCHAR) = b.rec_id GROUP BY lang, speaker"""

SQL["transcript_paragraphs_text"] = with_views("v_segments", recursive=True) + f""", {BLOCKS.strip()}
SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY first_seg) - 1 AS unit,
  '[' || {_clock('start_ms')} || ']' || chr(10) || {_BODY.format(left="''", right="': '")} AS text FROM blocks"""

# --- captions -----------------------------------------------------------------------

ROLLING = r"""
tok AS (SELECT *, string_split(text, ' ') AS raw, list_filter(list_transform(string_split(replace(lower(text), 'ß', 'ss'), ' '),
    lambda x: regexp_replace(x, '[^\p{L}\p{N}_+#.\-]+', '', 'g')), lambda x: x <> '') AS t FROM {source}),
prev AS (SELECT *, lag(t) OVER w AS p, lag(end_ms) OVER w AS pe FROM tok WINDOW w AS (PARTITION BY rec_id ORDER BY cue_idx)),
rolled AS (SELECT *, coalesce(start_ms <= pe + 50 AND len(p) > 0, false) AS rolling FROM prev),
ov AS (SELECT *, CASE WHEN rolling THEN coalesce(list_max(list_filter(range(1, least(len(p), len(t)) + 1),
    lambda k: p[len(p) - k + 1:len(p)] = t[1:k])), 0) ELSE 0 END AS o FROM rolled),
acted AS (SELECT *, CASE WHEN NOT rolling THEN 'new' WHEN t = p THEN 'same' WHEN len(t) >= len(p) AND t[1:len(p)] = p THEN 'grown'
    WHEN len(p) >= len(t) AND p[1:len(t)] = t THEN 'shrunk' WHEN o >= 2 OR (o = 1 AND length(p[len(p)]) >= 4) THEN 'shifted'
    ELSE 'new' END AS action FROM ov),
worded AS (SELECT *, CASE action WHEN 'same' THEN '' WHEN 'shrunk' THEN '' WHEN 'new' THEN text
    WHEN 'grown' THEN array_to_string(raw[len(p) + 1:], ' ') ELSE array_to_string(raw[o + 1:], ' ') END AS new_text FROM acted),
grouped AS (SELECT *, sum(CASE WHEN new_text <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY cue_idx) AS g FROM worded
  WHERE new_text <> '' OR action = 'same'),
rolled_out AS (SELECT rec_id, g - 1 AS seg_idx, min(start_ms) FILTER (WHERE new_text <> '') AS start_ms, max(end_ms) AS end_ms,
    max(new_text) AS text FROM grouped WHERE g > 0 GROUP BY rec_id, g)"""

SQL["dedupe_rolling_captions"] = with_views("v_cues") + ", " + ROLLING.strip().replace("{source}", "v_cues") + """
SELECT rec_id, CAST(seg_idx AS BIGINT) AS seg_idx, start_ms, end_ms, text FROM rolled_out"""

_CHOSEN = """
texts AS (SELECT rec_id, cue_idx, start_ms, end_ms, text FROM v_cues WHERE trim(text) <> ''
  AND rec_id IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE lang <> 'de'))"""
SQL["reconcile_text_source"] = with_views("v_cues", "v_segments") + f""", {_CHOSEN.strip()}
SELECT rec_id, CAST(cue_idx AS BIGINT) AS seg_idx, start_ms, end_ms, text, 'captions' AS source FROM texts
UNION ALL
SELECT rec_id, seg_idx, start_ms, end_ms, text, 'speech' FROM v_segments s
WHERE NOT EXISTS (SELECT 1 FROM texts t WHERE t.rec_id = s.rec_id)"""
SQL["reconcile_status"] = with_views("v_cues") + f""", {_CHOSEN.strip()}
SELECT CAST(doc_id AS VARCHAR) AS rec_id, CASE WHEN n > 0 THEN 'captions' END AS source, coalesce(n, 0) AS segments,
  CASE WHEN n IS NULL THEN 'no_captions' END AS error
FROM documents LEFT JOIN (SELECT rec_id, count(*) AS n FROM texts GROUP BY rec_id) ON rec_id = CAST(doc_id AS VARCHAR)"""

# --- terms --------------------------------------------------------------------------

def _term_hits(name: str, texts: str) -> str:
    return f"""{phrase_hits(name + '_phrases', texts, 'dict_variants')},
{name} AS MATERIALIZED (SELECT rec_id, term_id, max(hits) AS hits FROM {name}_phrases JOIN dict_variants USING (key) GROUP BY ALL)"""


SQL["match_terms"] = with_views("doc_keys", "dict_variants") + f""", {_term_hits("term_hits", "doc_keys")}
SELECT rec_id, term_id, hits FROM term_hits"""

def _scores(texts: str) -> str:
    return f"""{phrase_hits("keyword_phrases", texts, "dict_keywords")},
kw_hits AS (SELECT rec_id, category, sum(hits) AS score FROM keyword_phrases JOIN dict_keywords USING (key) GROUP BY ALL),
dict_defaults AS (SELECT category, min(pos) AS pos, arg_min(value, pos) AS value, arg_min(term_id, pos) AS term_id
  FROM dict_terms GROUP BY category)"""


SQL["expand_category_defaults"] = with_views("doc_keys", "dict_terms", "dict_keywords") + f""",
{_scores('doc_keys')}
SELECT rec_id, category, CAST(score AS BIGINT) AS score, term_id, value FROM kw_hits JOIN dict_defaults USING (category)"""


def _token_rows(name: str, longest: int, chars: str, source: str, at_sign: bool = True) -> str:
    """Tokens of ``source(rec_id, field, value)`` without look-around: characters that no token
    contains are doubled, so a match may consume one on either side."""
    cls = chars.replace("_", "")
    lead = NW[:-1] + "@]" if at_sign else NW
    return rf"""{name} AS (SELECT rec_id, field, unnest(r) AS token, unnest(range(1, len(r) + 1)) AS nth FROM (
  SELECT rec_id, field, regexp_extract_all(regexp_replace(value, '([^\p{{L}}\p{{N}}_{cls}])', '\1\1', 'g'),
    '(?:^|{lead})([A-Za-z][A-Za-z0-9{chars}]{{1,{longest}}})(?:$|[^\p{{L}}\p{{N}}_])', 1) AS r FROM {source}))"""


def _values(*values: str) -> str:
    return f"""meta_values AS (SELECT rec_id, unnest([{', '.join(values)}]) AS value, unnest(range(1, {len(values)} + 1)) AS field FROM (
  SELECT CAST(doc_id AS VARCHAR) AS rec_id, split_part(text, chr(10), 1) AS title, text, lang, source FROM documents))"""


_ASCII_KEY = "trim(regexp_replace(replace(replace(lower(value), '+', ' plus '), '#', ' sharp '), '[^a-z0-9_]+', ' ', 'g'))"


def _technical(description: str) -> str:
    return f"""{_values('title', 'source', description, 'lang', 'source', 'lang')},
{_token_rows('tech_tokens', 47, '.+#/_-', 'meta_values')},
tech_terms AS (SELECT rec_id, value, row_number() OVER (PARTITION BY rec_id ORDER BY field, nth) - 1 AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY rec_id, key ORDER BY field, nth) AS rn FROM (
    SELECT *, {_ASCII_KEY} AS key FROM (SELECT rec_id, field, nth, regexp_replace(token, '^[./_-]+|[./_-]+$', '', 'g') AS value FROM tech_tokens)
    WHERE length(value) >= 2 AND (upper(value) = value OR regexp_matches(value, '^.+[A-Z]') OR regexp_matches(value, '[0-9.+#/_-]')))
  WHERE key NOT IN {_list(TECHNICAL_STOP_WORDS)}) WHERE rn = 1)"""


LATIN = f"""{_values('title', 'lang', 'source', 'lang', 'text')},
{_token_rows('latin_tokens', 31, '.+#/_-', 'meta_values')},
latin_terms AS (SELECT rec_id, value, pos FROM (
  SELECT rec_id, value, row_number() OVER (PARTITION BY rec_id ORDER BY field, nth) - 1 AS pos FROM (
    SELECT *, row_number() OVER (PARTITION BY rec_id, lower(value) ORDER BY field, nth) AS rn FROM (
      SELECT rec_id, field, nth, regexp_replace(token, '^[-_/.]+|[-_/.]+$', '', 'g') AS value FROM latin_tokens)
    WHERE length(value) >= 2 AND lower(value) NOT IN {_list(LATIN_STOP_WORDS)} AND NOT regexp_matches(lower(value), '^(?:http|www)')
      AND NOT regexp_matches(value, '[_/.]')) WHERE rn = 1) WHERE pos < 64)"""

SQL["extract_metadata_terms"] = f"WITH {_technical('text')} SELECT rec_id, pos, value FROM tech_terms"
SQL["extract_latin_terms"] = f"WITH {LATIN} SELECT rec_id, pos, value FROM latin_terms"

_BLOCKED = " AND ".join(f"NOT contains(key, '{p}')" for p in BLOCKED_PHRASES)


def _custom(limit: int) -> str:
    return rf"""cand AS (SELECT rec_id, unnest(r) AS raw, unnest(range(0, len(r))) AS pos FROM (
  SELECT CAST(doc_id AS VARCHAR) AS rec_id, string_split_regex(text, '[\n,;]+') AS r FROM documents)),
cand_clean AS (SELECT rec_id, pos, CASE WHEN regexp_matches(v, '^[^.].*\.$') THEN regexp_replace(v, '\.+$', '') ELSE v END AS value FROM (
  SELECT rec_id, pos, regexp_replace(trim(regexp_replace(regexp_replace(raw, '[^\p{{L}}\p{{N}}_\s.+#/\-]', ' ', 'g'), '\s+', ' ', 'g')),
    '^[ /_-]+|[ /_-]+$', '', 'g') AS v FROM cand
  WHERE NOT regexp_matches(raw, '[<>{{}}`"'']') AND NOT contains(raw, '://') AND NOT contains(lower(raw), 'www.') AND NOT contains(raw, '..'))),
custom_terms AS (SELECT rec_id, rk - 1 AS pos, value FROM (
  SELECT *, sum(length(value)) OVER (PARTITION BY rec_id ORDER BY rk) AS total FROM (
    SELECT rec_id, value, row_number() OVER (PARTITION BY rec_id ORDER BY pos) AS rk FROM (
      SELECT *, row_number() OVER (PARTITION BY rec_id, key ORDER BY pos) AS rn FROM (
        SELECT *, {_key('value')} AS key FROM cand_clean
        WHERE value <> '' AND length(value) <= 64 AND len(string_split(value, ' ')) <= 5)
      WHERE key <> '' AND (length(key) > 1 OR key IN ('c', 'r')) AND {_BLOCKED}) WHERE rn = 1) WHERE rk <= {limit}) WHERE total <= 2048)"""


SQL["clean_custom_terms"] = f"WITH {_custom(64)} SELECT rec_id, pos, value FROM custom_terms"

SQL["merged_glossary"] = f"""WITH {_custom(64)}, {LATIN}
SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY part, pos) - 1 AS pos, value FROM (
  SELECT *, row_number() OVER (PARTITION BY rec_id, replace(lower(value), 'ß', 'ss') ORDER BY part, pos) AS rn FROM (
    SELECT rec_id, 0 AS part, pos, value FROM custom_terms UNION ALL SELECT rec_id, 1, pos, value FROM latin_terms)) WHERE rn = 1
QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY part, pos) <= 96"""

SQL["build_glossary"] = with_views("doc_keys", "dict_variants", "dict_keywords") + f""", {_term_hits("term_hits", "doc_keys")}, {_custom(64)}, {_technical('text')},
meta_keys AS MATERIALIZED (SELECT rec_id, {_key("title || ' ' || source || ' ' || text || ' ' || lang || ' ' || source || ' ' || lang")} AS key_text FROM (
  SELECT CAST(doc_id AS VARCHAR) AS rec_id, split_part(text, chr(10), 1) AS title, text, lang, source FROM documents)),
{_term_hits("meta_hits", "meta_keys")},
context AS MATERIALIZED (SELECT rec_id, trim(m.key_text || ' ' || d.key_text) AS key_text FROM meta_keys m JOIN doc_keys d USING (rec_id)),
{_scores('context')},
tiers AS (
  SELECT rec_id, value, 'custom' AS source, NULL AS category, 1000 AS score, 0 AS tier, pos AS r1, '' AS r2, 0 AS r3 FROM custom_terms
  UNION ALL SELECT rec_id, value, 'metadata', category, 100 + hits, 1, -hits, replace(lower(value), 'ß', 'ss'), 0 FROM meta_hits JOIN dict_terms USING (term_id)
  UNION ALL SELECT rec_id, value, 'metadata', NULL, 100, 2, pos, '', 0 FROM tech_terms
  UNION ALL SELECT rec_id, value, 'builtin', category, hits, 3, -hits, replace(lower(value), 'ß', 'ss'), 0 FROM term_hits JOIN dict_terms USING (term_id)
    WHERE NOT EXISTS (SELECT 1 FROM meta_hits m WHERE m.rec_id = term_hits.rec_id AND m.term_id = term_hits.term_id)
  UNION ALL SELECT rec_id, value, 'builtin', category, score, 4, -score, category, pos FROM kw_hits JOIN dict_defaults USING (category)),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, key ORDER BY tier, r1, r2, r3, value) AS rn FROM (
  SELECT *, {_key('value')} AS key FROM tiers)) WHERE rn = 1 AND key <> '')
SELECT rec_id, pos, value, source, category, CAST(score AS BIGINT) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY tier, r1, r2, r3, key) - 1 AS pos FROM firsts) WHERE pos < 80"""

# --- review -------------------------------------------------------------------------

CONFIDENCE = """conf AS (SELECT rec_id, seg_idx, start_ms, end_ms, trim(text) AS text, list_sum(logprobs) / len(logprobs) AS avg_logprob,
  list_min(logprobs) AS min_logprob, len(logprobs) AS token_count FROM v_asr WHERE trim(text) <> '')"""
LOW = """low AS (SELECT rec_id, seg_idx, avg_logprob <= threshold AS low_confidence FROM conf JOIN (
  SELECT rec_id, avg_logprob AS threshold FROM (SELECT rec_id, avg_logprob, row_number() OVER (PARTITION BY rec_id ORDER BY avg_logprob) AS rn,
    count(*) OVER (PARTITION BY rec_id) AS n FROM conf) WHERE rn = greatest(1, n // 4)) USING (rec_id))"""

SQL["confidence_summary"] = with_views("v_asr") + f""", {CONFIDENCE}
SELECT rec_id, CAST(seg_idx AS BIGINT) AS seg_idx, round(avg_logprob, 6) AS avg_logprob, min_logprob, token_count FROM conf"""
SQL["low_confidence_flag"] = with_views("v_asr") + f""", {CONFIDENCE}, {LOW}
SELECT rec_id, CAST(seg_idx AS BIGINT) AS seg_idx, low_confidence FROM low"""

_ORDINARY = _list(("and", "or", "the", "this", "it", "id"))


def _word(words: str, text: str = "text") -> str:
    return rf"regexp_matches(' ' || {text} || ' ', '(?i){NW}(?:{words}){NW}')"


FEATURES = rf"""{LATIN},
fseg AS (SELECT rec_id, seg_idx, start_ms, end_ms, text, replace(lower(text), 'ß', 'ss') AS folded FROM v_segments),
segwords AS (SELECT rec_id, seg_idx, unnest(regexp_extract_all(folded, '[\p{{L}}\p{{N}}_]+')) AS word FROM fseg),
plain_terms AS (SELECT rec_id, lower(value) AS value FROM latin_terms WHERE regexp_full_match(value, '[A-Za-z0-9]+')),
symbol_terms AS (SELECT rec_id, lower(value) AS value FROM latin_terms WHERE NOT regexp_full_match(value, '[A-Za-z0-9]+')),
hits AS (SELECT rec_id, seg_idx, sum(n) AS n FROM (
  SELECT segwords.rec_id, seg_idx, count(*) AS n FROM segwords JOIN plain_terms ON plain_terms.rec_id = segwords.rec_id AND value = word GROUP BY ALL
  UNION ALL
  SELECT rec_id, seg_idx, {_count(_doubled('folded'), rf"'{NW}' || regexp_escape(regexp_replace(value, '({NW})', '\1\1', 'g')) || '{NW}'")}
  FROM fseg JOIN symbol_terms USING (rec_id) WHERE contains(folded, value)) GROUP BY ALL),
segvals AS (SELECT rec_id, seg_idx AS field, text AS value FROM fseg),
{_token_rows('seg_tokens', 31, '.+#-', 'segvals', at_sign=False)},
known AS (SELECT DISTINCT rec_id, regexp_replace(lower(value), '^[-_/.]+|[-_/.]+$', '', 'g') AS k FROM latin_terms),
unknown AS (SELECT t.rec_id, t.field AS seg_idx, count(*) AS n FROM seg_tokens t
  LEFT JOIN known ON known.rec_id = t.rec_id AND k = regexp_replace(lower(token), '^[-_/.]+|[-_/.]+$', '', 'g')
  WHERE k IS NULL AND lower(token) NOT IN {_ORDINARY} GROUP BY ALL),
feat AS (SELECT f.rec_id, f.seg_idx, f.start_ms, f.end_ms, coalesce(h.n, 0) AS glossary_hits, coalesce(u.n, 0) AS unknown_latin,
    {_word('the|der|que|con')} AS suspicious_latin, {_word('and|und|les|el')} AS suspicious_term,
    (kt AND (contains(c, 'that') OR contains(c, 'thou'))) OR (kd AND contains(c, 'die')) OR (kl AND (contains(c, 'la') OR contains(c, 'les')))
      AS pronunciation,
    {_word('is|ist|dans|por')} AS technical_context, regexp_matches(text, '\d') AS has_numbers,
    length(trim(text)) / (greatest(100, end_ms - start_ms) / 1000.0::DOUBLE) < 1.1 AS sparse, length(c) AS compact_chars
  FROM (SELECT *, {_compact('text')} AS c FROM fseg) f
  LEFT JOIN hits h USING (rec_id, seg_idx) LEFT JOIN unknown u USING (rec_id, seg_idx)
  LEFT JOIN (SELECT rec_id, bool_or(k = 'the') AS kt, bool_or(k = 'der') AS kd, bool_or(k = 'le') AS kl FROM known GROUP BY rec_id) g USING (rec_id))"""

_FLAG = lambda name: f"coalesce({name}, false)"
SQL["segment_features"] = with_views("v_segments") + f""", {FEATURES}
SELECT rec_id, CAST(seg_idx AS BIGINT) AS seg_idx, CAST(glossary_hits AS BIGINT) AS glossary_hits, unknown_latin, suspicious_latin,
  suspicious_term, coalesce(pronunciation, false) AS pronunciation, technical_context, has_numbers, sparse, compact_chars FROM feat"""

SCORED = """scored AS (SELECT rec_id, seg_idx, start_ms, end_ms,
    CASE WHEN unknown_latin >= 2 THEN 2 WHEN unknown_latin = 1 THEN 1 ELSE 0 END + CASE WHEN suspicious_latin THEN 4 ELSE 0 END
    + CASE WHEN suspicious_term THEN 3 ELSE 0 END + CASE WHEN pronunciation THEN 3 ELSE 0 END + CASE WHEN low_confidence THEN 1 ELSE 0 END
    + CASE WHEN technical_context THEN 1 ELSE 0 END + CASE WHEN sparse THEN 1 ELSE 0 END AS score,
    concat_ws(',', CASE WHEN glossary_hits > 0 THEN 'glossary_term' END, CASE WHEN unknown_latin > 0 THEN 'unknown_latin' END,
      CASE WHEN suspicious_latin THEN 'suspicious_latin' END, CASE WHEN suspicious_term THEN 'suspicious_term' END,
      CASE WHEN pronunciation THEN 'glossary_pronunciation' END, CASE WHEN low_confidence THEN 'low_confidence' END,
      CASE WHEN technical_context THEN 'technical_context' END, CASE WHEN has_numbers THEN 'numbers' END,
      CASE WHEN sparse THEN 'sparse_text' END) AS reasons
  FROM feat JOIN low USING (rec_id, seg_idx))"""
_REVIEW = f"{FEATURES}, {CONFIDENCE}, {LOW}, {SCORED}"
SQL["review_scores"] = with_views("v_asr") + f""", {_REVIEW}
SELECT rec_id, CAST(seg_idx AS BIGINT) AS seg_idx, CAST(score AS BIGINT) AS score, reasons FROM scored"""

SQL["select_review_candidates"] = with_views("v_asr", recursive=True) + f""", {_REVIEW},
items AS MATERIALIZED (SELECT rec_id, seg_idx, score, greatest(0, end_ms - start_ms) AS ms, budget,
    row_number() OVER (PARTITION BY rec_id ORDER BY score DESC, seg_idx) AS k
  FROM scored JOIN (SELECT rec_id, greatest(0.0, (max(end_ms) - min(start_ms)) * 0.18::DOUBLE) AS budget FROM scored GROUP BY rec_id)
  USING (rec_id) WHERE score >= 3),
picked(rec_id, k, seg_idx, score, used, taken) AS (
  SELECT rec_id, k, seg_idx, score, ms, true FROM items WHERE k = 1
  UNION ALL
  SELECT i.rec_id, i.k, i.seg_idx, i.score, CASE WHEN p.used + i.ms <= i.budget THEN p.used + i.ms ELSE p.used END, p.used + i.ms <= i.budget
  FROM picked p JOIN items i ON i.rec_id = p.rec_id AND i.k = p.k + 1)
SELECT rec_id, CAST(seg_idx AS BIGINT) AS seg_idx, CAST(score AS BIGINT) AS score FROM picked WHERE taken"""

_PAIRS = rf"""rp AS (SELECT *, regexp_extract_all(o, '\d+(?:[.,:]\d+)*') AS onum, string_split(lower(r), ' ') AS ws, regexp_extract_all(r, '\d+(?:[.,:]\d+)*') AS rnum,
    {_compact('o')} AS oc, {_compact('r')} AS rc FROM (
  SELECT rec_id, seg_idx, start_ms, end_ms, text, trim(text) AS o, CASE seg_idx % 4 WHEN 0 THEN 'github ' || text
      WHEN 1 THEN array_to_string(string_split(text, ' ')[1:3], ' ') WHEN 2 THEN regexp_replace(text, '(?i)the|und|que', 'x', 'g')
      ELSE text || ' 7' END AS revised, CASE WHEN seg_idx % 9 = 0 THEN -1.5 WHEN seg_idx % 9 <> 1 THEN -0.2 END AS lp,
    trim(CASE seg_idx % 4 WHEN 0 THEN 'github ' || text WHEN 1 THEN array_to_string(string_split(text, ' ')[1:3], ' ')
      WHEN 2 THEN regexp_replace(text, '(?i)the|und|que', 'x', 'g') ELSE text || ' 7' END) AS r FROM v_segments))"""


def _per_text(alias: str, text: str) -> str:
    plain = _doubled(f"replace(lower({text}), 'ß', 'ss')")
    raw = _doubled(text)
    tokens = (
        rf"regexp_extract_all(regexp_replace({text}, '([^\p{{L}}\p{{N}}_.+#-])', '\1\1', 'g'), "
        rf"'(?:^|{NW})([A-Za-z][A-Za-z0-9.+#-]{{1,31}})(?:$|{NW})', 1)"
    )
    return rf"""{_count(plain, f"'{NW}(?:github){NW}'")} + {_count(plain, f"'{NW}(?:la){NW}'")} AS {alias}h,
    {_count(raw, f"'(?i){NW}(?:the|der|que|con){NW}'")} + {_count(raw, f"'(?i){NW}(?:and|und|les|el){NW}'")} AS {alias}s,
    len(list_filter({tokens}, lambda x: regexp_replace(lower(x), '^[-_/.]+|[-_/.]+$', '', 'g') NOT IN ('github', 'la')
      AND lower(x) NOT IN {_ORDINARY})) AS {alias}u"""


JUDGED = rf"""{_PAIRS},
judged AS (SELECT rec_id, seg_idx, start_ms, end_ms, text, revised, o <> '' AND r <> '' AND oc <> rc
    AND NOT coalesce(rep, false) AND length(rc) / greatest(1, length(oc))::DOUBLE BETWEEN 0.55 AND 1.70 AND coalesce(lp >= -1.0, true)
    AND (len(onum) = 0 OR onum = rnum) AND (rh > oh OR (rh >= oh AND (rs < os OR ru < ou))) AS accepted
  FROM (SELECT *, {_per_text('o', 'o')}, {_per_text('r', 'r')},
    list_bool_or(list_transform(range(1, len(ws) - 3), lambda k: ws[k+1] = ws[k+2] AND ws[k+1] = ws[k+3]
      AND length(ws[k+1]) >= 2 AND regexp_full_match(ws[k+1], '[\p{{L}}\p{{N}}_-]+') AND ends_with(ws[k], ws[k+1]) AND starts_with(ws[k+4], ws[k+1])
      AND NOT regexp_matches(left(right(' ' || ws[k], length(ws[k+1]) + 1), 1), '[\p{{L}}\p{{N}}_]')
      AND NOT regexp_matches(substr(ws[k+4] || ' ', length(ws[k+1]) + 1, 1), '[\p{{L}}\p{{N}}_]'))) AS rep FROM rp))"""
SQL["accept_revision"] = with_views("v_segments") + f""", {JUDGED}
SELECT rec_id, CAST(seg_idx AS BIGINT) AS seg_idx, accepted FROM judged"""
SQL["merge_revisions"] = with_views("v_segments") + f""", {JUDGED}
SELECT rec_id, CAST(seg_idx AS BIGINT) AS seg_idx, start_ms, end_ms, CASE WHEN accepted THEN revised ELSE text END AS text,
  accepted AS revised FROM judged"""

_WORDS = "'[A-Za-zА-Яа-яЁё0-9]+'"


def _aligned(pairs: str) -> str:
    """``aligned`` texts of the rows ``rec_id, seg_idx, o, r`` of ``pairs``, by all chains of runs."""

    def edge(o: str, r: str) -> str:
        had, has = (f"len(regexp_extract_all({x}, {_WORDS}))" for x in (o, r))
        return f"""CASE WHEN {had} = 0 THEN CASE WHEN {has} = 0 THEN {o} ELSE '' END WHEN {has} = 0 THEN {o}
    WHEN {has} >= greatest(1, floor({had} * 0.55::DOUBLE)) AND {has} <= greatest({had} + 3, ceil({had} * 1.7::DOUBLE)) THEN {r} ELSE {o} END"""

    def start(words: str, gaps: str, k: str) -> str:
        return f"length(array_to_string({gaps}[1:{k} + 1], '')) + length(array_to_string({words}[1:{k}], ''))"

    return f"""al_split AS MATERIALIZED (SELECT rec_id, seg_idx, o, r, regexp_extract_all(replace(lower(o), 'ё', 'е'), {_WORDS}) AS ow,
    regexp_extract_all(replace(lower(r), 'ё', 'е'), {_WORDS}) AS rw, regexp_split_to_array(o, {_WORDS}) AS og, regexp_split_to_array(r, {_WORDS}) AS rg
  FROM {pairs}),
al_a AS (SELECT rec_id, seg_idx, k AS a, array_to_string(ow[k + 1:k + 3], ' ') AS anchor FROM (
  SELECT *, unnest(range(greatest(0, len(ow) - 2))) AS k FROM al_split)),
al_b AS (SELECT rec_id, seg_idx, k AS b, array_to_string(rw[k + 1:k + 3], ' ') AS anchor FROM (
  SELECT *, unnest(range(greatest(0, len(rw) - 2))) AS k FROM al_split)),
al_runs AS MATERIALIZED (SELECT rec_id, seg_idx, min(a) AS a, min(b) AS b, count(*) + 2 AS size FROM (
  SELECT *, a - row_number() OVER (PARTITION BY rec_id, seg_idx, a - b ORDER BY a) AS island FROM al_a JOIN al_b USING (rec_id, seg_idx, anchor))
  GROUP BY rec_id, seg_idx, a - b, island),
al_chains AS (SELECT rec_id, seg_idx, size AS weight, a, b, a + size AS a_end, b + size AS b_end FROM al_runs
  UNION
  SELECT c.rec_id, c.seg_idx, c.weight + n.size - greatest(0, c.a_end - n.a, c.b_end - n.b), c.a, c.b, n.a + n.size, n.b + n.size
  FROM al_chains c JOIN al_runs n ON n.rec_id = c.rec_id AND n.seg_idx = c.seg_idx AND n.a + n.size > c.a_end AND n.b + n.size > c.b_end
    AND n.size - greatest(0, c.a_end - n.a, c.b_end - n.b) >= 3),
al_best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, seg_idx ORDER BY weight DESC, a, b, a_end, b_end) AS rn
  FROM al_chains) WHERE rn = 1),
al_cut AS (SELECT rec_id, seg_idx, o, r, {start("ow", "og", "a")} AS o_from, {start("rw", "rg", "b")} AS r_from,
    {start("ow", "og", "(a_end - 1)")} + length(ow[a_end]) AS o_to, {start("rw", "rg", "(b_end - 1)")} + length(rw[b_end]) AS r_to
  FROM al_split JOIN al_best USING (rec_id, seg_idx)),
al_parts AS (SELECT *, trim(left(o, o_from)) AS o1, trim(left(r, r_from)) AS r1, trim(substr(o, o_to + 1)) AS o2, trim(substr(r, r_to + 1)) AS r2,
    trim(substr(r, r_from + 1, r_to - r_from)) AS core FROM al_cut),
aligned AS (SELECT rec_id, seg_idx, coalesce(j, trim(r)) AS aligned FROM al_split LEFT JOIN (
  SELECT rec_id, seg_idx, trim(array_to_string(list_filter([{edge("o1", "r1")}, core, {edge("o2", "r2")}], lambda x: x <> ''), ' ')) AS j
  FROM al_parts) USING (rec_id, seg_idx))"""


SQL["align_revision_boundaries"] = with_views("v_segments", recursive=True) + f""", {_PAIRS},
al_pairs AS (SELECT rec_id, seg_idx, text AS o, revised AS r FROM rp), {_aligned("al_pairs")}
SELECT rec_id, CAST(seg_idx AS BIGINT) AS seg_idx, aligned FROM aligned"""

# --- evaluation ---------------------------------------------------------------------

SQL["pair_texts"] = with_views("v_pairs") + """
SELECT rec_id, reference, hypothesis, trim(reference) <> trim(hypothesis) AS differs FROM v_pairs"""

_WER = r"""wer AS (SELECT *, list_distinct(list_concat(rw, hw)) AS d FROM (
  SELECT rec_id, regexp_extract_all(replace(lower(reference), 'ß', 'ss'), '[a-zа-я0-9]+') AS rw,
    regexp_extract_all(replace(lower(hypothesis), 'ß', 'ss'), '[a-zа-я0-9]+') AS hw FROM v_pairs)),
edits AS (SELECT rec_id, len(rw) AS reference_words, len(hw) AS hypothesis_words, length(array_to_string(rw, '')) AS rc,
    levenshtein(array_to_string(list_transform(rw, lambda x: chr(CAST(32 + list_position(d, x) AS INTEGER))), ''),
      array_to_string(list_transform(hw, lambda x: chr(CAST(32 + list_position(d, x) AS INTEGER))), '')) AS word_edits,
    levenshtein(array_to_string(rw, ''), array_to_string(hw, '')) AS char_edits FROM wer)"""
SQL["word_error_rate"] = with_views("v_pairs") + f""", {_WER}
SELECT rec_id, word_edits, char_edits, reference_words, hypothesis_words,
  round_even(word_edits / greatest(1, reference_words) * 100, 2) AS wer_percent, round_even(char_edits / greatest(1, rc) * 100, 2) AS cer_percent
FROM edits"""
SQL["evaluation_report"] = with_views("v_pairs") + f""", {_WER}
SELECT rec_id, '{{"rec_id":"' || rec_id || '","reference_words":' || reference_words || ',"hypothesis_words":' || hypothesis_words || '}}' AS report
FROM edits"""

_ENGINES = """res AS (SELECT l_suppkey AS case_id, CASE l_returnflag WHEN 'A' THEN 'fast' WHEN 'R' THEN 'mixed' ELSE 'full' END AS engine,
  CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS seconds, max(l_partkey % 100) AS wer, max(l_orderkey % 100) AS cer FROM lineitem GROUP BY ALL),
cmp AS (SELECT case_id, """ + ", ".join(
    f"max({m}) FILTER (WHERE engine = '{e}') AS {m}_{e}" for e in ("fast", "mixed", "full") for m in ("seconds", "wer", "cer")
) + " FROM res GROUP BY case_id)"
SQL["engine_comparison"] = f"WITH {_ENGINES} SELECT * FROM cmp"
SQL["total_speedup"] = f"""WITH {_ENGINES}
SELECT count(*) AS cases, CAST(sum(seconds_full) AS BIGINT) AS slow_seconds, CAST(sum(seconds_mixed) AS BIGINT) AS fast_seconds,
  round(sum(seconds_full)::DOUBLE / sum(seconds_mixed)::DOUBLE, 6) AS speedup FROM cmp WHERE seconds_full IS NOT NULL AND seconds_mixed IS NOT NULL"""

SQL["batch_outcome"] = """
SELECT l_orderkey AS batch_id, count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'R') AS errors,
  count(*) FILTER (WHERE l_returnflag <> 'R') AS completed,
  CASE WHEN count(*) FILTER (WHERE l_returnflag <> 'R') > 0 THEN 'completed' ELSE 'failed' END AS status FROM lineitem GROUP BY 1"""

SQL["candidate_share"] = with_views("v_segments") + """
SELECT rec_id, count(*) FILTER (WHERE ends_with(text, '.')) AS candidates,
  CAST(coalesce(sum(end_ms - start_ms) FILTER (WHERE ends_with(text, '.')), 0) AS BIGINT) AS reviewed_ms FROM v_segments GROUP BY rec_id"""

# --- renditions ---------------------------------------------------------------------

_VIDEO = """video AS (SELECT rec_id, height, height || 'p' AS label, upper(ext) AS container, filesize AS approximate_size FROM (
  SELECT *, row_number() OVER (PARTITION BY rec_id, height ORDER BY (ext = 'mp4') DESC, (acodec <> 'none') DESC, (filesize > 0) DESC, tbr DESC, ord) AS rn
  FROM v_formats WHERE vcodec <> 'none') WHERE rn = 1)"""
SQL["select_video_renditions"] = with_views("v_formats") + f""", {_VIDEO}
SELECT rec_id, CAST(height AS BIGINT) AS height, label, container, approximate_size FROM video"""
SQL["default_quality"] = with_views("v_formats") + f""", {_VIDEO}
SELECT rec_id, CAST(coalesce(max(height) FILTER (WHERE height <= 1080), min(height)) AS BIGINT) AS default_quality FROM video GROUP BY rec_id"""
SQL["select_audio_options"] = with_views("v_formats") + """
SELECT rec_id, upper(ext) AS container, acodec AS codec, CAST(round_even(abr, 0) AS BIGINT) AS bitrate_kbps, filesize AS approximate_size FROM (
  SELECT *, row_number() OVER (PARTITION BY rec_id, lower(ext) ORDER BY abr DESC, ord) AS rn FROM v_formats WHERE vcodec = 'none' AND acodec <> 'none')
WHERE rn = 1"""

# --- events -------------------------------------------------------------------------

SQL["progress_and_eta"] = """
SELECT event_id, round(share * 100, 4) AS percent, CASE WHEN share >= 0.01 THEN round(elapsed * (1 - share) / share, 3) END AS eta_seconds FROM (
  SELECT event_id, least(1.0, value / 40.0) AS share,
    (epoch_us(ts) // 1000 - min(epoch_us(ts) // 1000) OVER (PARTITION BY user_id, event_type)) / 1000.0::DOUBLE AS elapsed FROM events)"""

_ALIVE = """alive AS (SELECT tab_id, url, max(seq) AS seq, arg_max(ts, seq) AS detected_at, 'agent/' || arg_max(page_id, seq) AS user_agent,
    any_value(CASE event_type WHEN 'view' THEN 1000 WHEN 'signup' THEN 900 WHEN 'click' THEN 200 ELSE 100 END) AS priority
  FROM v_requests r LEFT JOIN (SELECT tab_id, max(seq) AS reset_seq FROM v_requests WHERE kind = 'reset' GROUP BY tab_id) USING (tab_id)
  WHERE kind = 'candidate' AND (reset_seq IS NULL OR seq > reset_seq) GROUP BY tab_id, url)"""
_RANKED = f"""{_ALIVE},
ranked AS (SELECT *, row_number() OVER (PARTITION BY tab_id ORDER BY priority DESC, detected_at DESC, seq DESC) AS rank FROM alive)"""
SQL["rank_stream_candidates"] = with_views("v_requests") + f""", {_RANKED}
SELECT tab_id, rank, url, seq, CAST(priority AS BIGINT) AS priority, user_agent FROM ranked WHERE rank <= 24"""
SQL["stream_candidates_stream"] = with_views("v_requests") + f""", {_RANKED}
SELECT tab_id, rank, url, CAST(priority AS BIGINT) AS priority FROM ranked WHERE rank <= 24"""
SQL["prefer_complete"] = with_views("v_requests") + f""", {_ALIVE}
SELECT tab_id, url, complete FROM (SELECT tab_id, url, priority >= 900 AS complete, max(priority) OVER (PARTITION BY tab_id) AS best FROM alive)
WHERE complete OR best < 900"""

SQL["join_request_response"] = with_views("v_requests") + """
SELECT seq, tab_id, url, CASE WHEN seq % 10 <> 0 THEN 'agent/' || page_id END AS user_agent FROM v_requests WHERE kind = 'candidate'"""
SQL["join_request_response_stream"] = SQL["join_request_response"]

SQL["task_state"] = with_views("v_task_events") + """,
marks AS (SELECT task_id, min(seq) FILTER (WHERE kind IN ('failed', 'cancelled')) AS ended, min(seq) FILTER (WHERE kind = 'cancel') AS asked,
  min(seq) FILTER (WHERE kind = 'completed') AS done FROM v_task_events GROUP BY task_id),
live AS (SELECT e.*, done, CASE kind WHEN 'update' THEN stage WHEN 'cancel' THEN 'cancelling' WHEN 'failed' THEN 'error' ELSE kind END AS st
  FROM v_task_events e JOIN marks USING (task_id) WHERE NOT coalesce(seq > ended, false)
  AND NOT (coalesce(seq > asked, false) AND kind IN ('update', 'completed', 'cancel'))),
staged AS (SELECT *, lag(st) OVER (PARTITION BY task_id ORDER BY seq) AS before FROM live),
since AS (SELECT *, max(seq) FILTER (WHERE (kind = 'update' AND st IS DISTINCT FROM before) OR kind = 'cancelled') OVER (PARTITION BY task_id) AS since
  FROM staged)
SELECT task_id, coalesce(arg_max(status, seq), 'pending') AS status, arg_max(st, seq) AS stage,
  (max({'q': seq, 'p': percent}) FILTER (WHERE kind <> 'failed')).p AS progress,
  (max({'q': seq, 'b': bytes}) FILTER (WHERE kind = 'update' AND has_bytes AND (since IS NULL OR seq >= since))).b AS downloaded_bytes,
  max(seq) AS last_seq
FROM (SELECT *, CASE WHEN kind = 'update' THEN 'running' WHEN kind = 'cancel' THEN CASE WHEN done < seq THEN 'running' END ELSE kind END AS status,
    CASE WHEN kind = 'update' THEN least(100.0, greatest(0.0, round_even(progress, 1))) WHEN kind = 'completed' THEN 100.0 END AS percent FROM since)
GROUP BY task_id"""
SQL["task_state_stream"] = f"SELECT task_id, status, stage, progress, downloaded_bytes FROM ({SQL['task_state'].strip()})"

# Rows arrive in three turns; one is late if its time is not after the watermark that the turns before left.
_LATE = """,
arriving AS (SELECT *, CASE WHEN seq % 41 = 0 THEN INTERVAL 12 DAY WHEN seq % 3 = 0 THEN INTERVAL 9 MINUTE ELSE INTERVAL 0 MINUTE END + ts AS arrives
  FROM v_task_events),
span AS (SELECT epoch_us(min(ts)) AS first, (epoch_us(max(ts)) - epoch_us(min(ts))) // 3 AS third FROM v_task_events),
turned AS (SELECT *, CASE WHEN epoch_us(arrives) < first + third THEN 0 WHEN epoch_us(arrives) < first + 2 * third THEN 1 ELSE 2 END AS turn
  FROM arriving, span),
marked AS (SELECT *, epoch_us(ts) // 1000 AS at_ms,
  (SELECT max(epoch_us(e.ts) // 1000) - 600000 FROM turned e WHERE e.turn < t.turn) AS passed FROM turned t),
on_time AS (SELECT * EXCLUDE (passed) FROM marked WHERE passed IS NULL OR at_ms > passed)"""
SQL["late_task_events"] = with_views("v_task_events") + _LATE + " SELECT task_id, seq, at_ms FROM marked WHERE at_ms <= passed"
SQL["task_state_late_stream"] = (
    with_views("v_task_events") + _LATE + SQL["task_state"].removeprefix(with_views("v_task_events")).replace("v_task_events", "on_time")
).replace("SELECT task_id, coalesce(arg_max(status, seq)", "SELECT * EXCLUDE (last_seq) FROM (SELECT task_id, coalesce(arg_max(status, seq)") + ")"

SQL["job_state"] = """
WITH ev AS (SELECT CAST(user_id AS VARCHAR) AS owner, 'j' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 14) AS job_id, event_id AS seq,
    CASE WHEN event_type = 'signup' THEN 'create' WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'delete' ELSE 'patch' END AS kind,
    epoch_us(ts) // 1000 AS created_at,
    CASE WHEN event_type = 'error' AND event_id % 3 <> 0 THEN 'cancelling' WHEN event_type = 'purchase' THEN NULL ELSE event_type END AS stage,
    CASE WHEN event_id % 4 = 0 THEN 't' || event_id END AS task, CASE WHEN event_type = 'click' THEN 'running' END AS status,
    CASE WHEN event_type = 'view' THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS progress FROM events),
born AS (SELECT owner, job_id, max(seq) FILTER (WHERE kind = 'create') AS born, max(seq) FILTER (WHERE kind = 'delete') AS gone,
  arg_max(created_at, seq) FILTER (WHERE kind = 'create') AS made FROM ev GROUP BY ALL),
rows0 AS (SELECT ev.*, born, made FROM ev JOIN born USING (owner, job_id) WHERE born IS NOT NULL AND (gone IS NULL OR born > gone)
  AND seq >= born AND kind <> 'delete'),
rows1 AS (SELECT *, min(seq) FILTER (WHERE stage = 'cancelling') OVER (PARTITION BY owner, job_id) AS cancelled_at FROM rows0),
rows2 AS (SELECT *, coalesce(seq > cancelled_at, false) AS late, NOT coalesce(seq > cancelled_at, false) OR stage = 'cancelling' AS counts FROM rows1),
jobs AS (SELECT owner, job_id, max(made) AS created_at, arg_max(status, seq) FILTER (WHERE counts AND status IS NOT NULL) AS status,
    arg_max(stage, seq) FILTER (WHERE counts AND stage IS NOT NULL) AS stage, arg_max(progress, seq) FILTER (WHERE counts AND progress IS NOT NULL) AS progress,
    coalesce(arg_max(task, seq) FILTER (WHERE counts AND task IS NOT NULL), arg_min(task, seq) FILTER (WHERE late AND task IS NOT NULL)) AS task_id
  FROM rows2 GROUP BY owner, job_id)
SELECT owner, job_id, rank, created_at, status, stage, progress, task_id FROM (
  SELECT *, row_number() OVER (PARTITION BY owner ORDER BY created_at DESC, job_id DESC) AS rank FROM jobs) WHERE rank <= 10"""
SQL["job_state_stream"] = SQL["job_state"]

SQL["submit_once"] = """
SELECT seq, client_request_id, task_id, CASE WHEN client_request_id IS NULL THEN task_id
  ELSE first_value(task_id) OVER (PARTITION BY client_request_id ORDER BY seq) END AS effective_task_id
FROM (SELECT event_id AS seq, CASE WHEN event_type <> 'view' THEN 'r' || CAST(json_extract_string(props, '$.k') AS BIGINT) END AS client_request_id,
  't' || event_id AS task_id FROM events)"""
SQL["submit_once_stream"] = SQL["submit_once"]

# --- search -------------------------------------------------------------------------

SEARCH = """lines AS (SELECT rec_id, unnest(l) AS text, unnest(range(1, len(l) + 1)) AS line FROM (
  SELECT CAST(doc_id AS VARCHAR) AS rec_id, string_split(text, chr(10)) AS l FROM documents)),
found AS (SELECT rec_id, line, text, (length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 AS hits FROM lines
  WHERE contains(lower(text), 'the'))"""
SQL["search_transcripts"] = f"WITH {SEARCH} SELECT rec_id, line, text, hits FROM found"
SQL["search_top_documents"] = f"""WITH {SEARCH}
SELECT rec_id, CAST(sum(hits) AS BIGINT) AS hits, count(*) AS lines FROM found GROUP BY rec_id ORDER BY hits DESC, rec_id LIMIT 20"""
SQL["find_next"] = """
SELECT rec_id, p - 1 AS position, len(string_split(left(text, p - 1), chr(10))) AS line FROM (
  SELECT CAST(doc_id AS VARCHAR) AS rec_id, text, CASE WHEN instr(substr(lower(text), 501), 'der') > 0 THEN instr(substr(lower(text), 501), 'der') + 500
    ELSE instr(lower(text), 'der') END AS p FROM documents) WHERE p > 0"""
