"""Independent SQL for the queries of the catalog, to be run by another engine.

The texts are assembled from small fragments (one per measure) written in
that engine's own functions: lists and lambdas instead of Spark's
expressions.  Only the fixed values and the input views are shared.
"""

from __future__ import annotations

from postwarden.functions import fixed as fx
from postwarden.sources.views import CAMPAIGN_LOG, LINK_MAIL, MAIL, MAIL_LOG

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
BAD = "predicted_label IN ('spam', 'phishing')"
LOG = f"WITH log AS ({MAIL_LOG})"
MAILS = f"WITH mail AS ({MAIL})"
LINKS = f"WITH links AS ({LINK_MAIL})"

CHECKS: dict[str, str] = {}


def s(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def rx(pattern: str) -> str:
    return s(pattern)


def escaped(term: str) -> str:
    return "".join("\\" + c if c in r".$^*+?()[]{}|\-/" and c not in "-/" else c for c in term)


def either(terms, tail: str = "") -> str:
    return "(" + "|".join(escaped(t) for t in terms) + ")" + tail


W = fx.WHITE


def squeeze(t: str) -> str:
    return f"trim(regexp_replace({t}, {rx(f'[{W}]+')}, ' ', 'g'))"


def count_of(t: str, term: str) -> str:
    return f"CAST((length({t}) - length(replace({t}, {s(term)}, ''))) // {len(term)} AS INT)"


def sum_of(t: str, terms) -> str:
    return "(" + " + ".join(count_of(t, x) for x in terms) + ")"


def present(t: str, terms) -> str:
    return "(" + " + ".join(f"CAST(contains({t}, {s(x)}) AS INT)" for x in terms) + ")"


def any_in(t: str, terms) -> str:
    return "(" + " OR ".join(f"contains({t}, {s(x)})" for x in terms) + ")"


def matches(t: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({t}, {rx(pattern)})) AS INT)"


def flag(condition: str) -> str:
    return f"CAST(coalesce({condition}, false) AS INT)"


def tags_out(t: str) -> str:
    return f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"


# The named references that the given tables hold, with others that are common.
NAMED_ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ",
    "copy": "©", "reg": "®", "trade": "™", "middot": "·",
    "hellip": "…", "ndash": "–", "mdash": "—",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "laquo": "«", "raquo": "»", "bull": "•",
    "pound": "£", "euro": "€", "yen": "¥", "cent": "¢",
    "times": "×", "deg": "°", "sect": "§",
    "auml": "ä", "ouml": "ö", "uuml": "ü", "szlig": "ß",
    "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç",
    "ntilde": "ñ", "aacute": "á", "oacute": "ó", "uacute": "ú",
}


def unescape(t: str) -> str:
    out = t
    for name, char in NAMED_ENTITIES.items():
        out = f"replace({out}, '&{name};', {s(char)})"
    out = f"replace(replace({out}, '&#39;', ''''), '&#x27;', '''')"
    return f"regexp_replace({out}, '&(amp;?|#38;|#[xX]26;)', '&', 'g')"


def words(t: str) -> str:
    return f"regexp_extract_all({t}, {rx(f'[^{W}]+')})"


def stats(t: str, prefix: str, special: str) -> dict[str, str]:
    def share(cls: str) -> str:
        return (
            f"len(regexp_extract_all({t}, {rx(f'[{cls}]')}))::DOUBLE / greatest(1, length({t}))"
        )

    n = f"len({words(t)})"
    total = f"coalesce(list_sum(list_transform({words(t)}, lambda w: length(w))), 0)"
    return {
        f"{prefix}_text_length": f"CAST(length({t}) AS INT)",
        f"{prefix}_word_count": f"CAST({n} AS INT)",
        f"{prefix}_avg_word_length": f"{total}::DOUBLE / greatest(1, {n})",
        f"{prefix}_uppercase_ratio": share(r"\p{Lu}"),
        f"{prefix}_digit_ratio": share(fx.DIGIT),
        f"{prefix}_special_char_ratio": share(special),
        f"{prefix}_exclamation_count": count_of(t, "!"),
        f"{prefix}_question_count": count_of(t, "?"),
    }


def select(columns: dict[str, str]) -> str:
    return ",\n       ".join(f"{e} AS {n}" for n, e in columns.items())


def subject_stats(t: str) -> dict[str, str]:
    out = stats(t, "subject", r"!-/:-@\[-`{-~")
    del out["subject_special_char_ratio"], out["subject_question_count"]
    return out


def ascii_words(t: str) -> str:
    tokens = f"regexp_extract_all({t}, {rx(f'[{fx.WORD}]+')})"
    return f"CAST(len(list_filter({tokens}, lambda w: regexp_full_match(w, '[A-Z]{{2,}}'))) AS INT)"


def loud_words(t: str) -> str:
    return (
        f"CAST(len(list_filter({words(t)}, lambda w: length(w) > 3 AND regexp_matches(w, '\\p{{Lu}}') "
        f"AND NOT regexp_matches(w, '[\\p{{Ll}}\\p{{Lt}}]'))) AS INT)"
    )


# --- log reports ------------------------------------------------------------

LEVEL = """CASE WHEN phishing_count / total_emails > 0.3 OR spam_count / total_emails > 0.5 THEN 'critical'
     WHEN phishing_count / total_emails > 0.1 OR spam_count / total_emails > 0.3 THEN 'high'
     WHEN phishing_count / total_emails > 0.05 OR spam_count / total_emails > 0.15 THEN 'medium'
     ELSE 'low' END"""
COUNTS = """count(*) AS total_emails,
    CAST(sum(CASE WHEN predicted_label = 'ham' THEN 1 ELSE 0 END) AS BIGINT) AS ham_count,
    CAST(sum(CASE WHEN predicted_label = 'spam' THEN 1 ELSE 0 END) AS BIGINT) AS spam_count,
    CAST(sum(CASE WHEN predicted_label = 'phishing' THEN 1 ELSE 0 END) AS BIGINT) AS phishing_count"""
DOMAINS = f"""{LOG}, counts AS (
    SELECT domain, {COUNTS}, CAST(sum(risk_score) AS BIGINT) AS risk_total,
           min(classified_at) AS first_seen, max(classified_at) AS last_seen
    FROM log GROUP BY domain)"""
RISKY_END = r"\.(xyz|top|ru|cn|tk|ml|ga|cf|gq)$"
DOMAIN_ROWS = f"""SELECT domain, total_emails, ham_count, spam_count, phishing_count,
    {LEVEL} AS risk_level,
    CASE WHEN regexp_matches(domain, '{RISKY_END}') THEN 3 ELSE 0 END AS risk_score,
    risk_total / total_emails AS avg_risk_score, false AS is_free_provider,
    regexp_matches(domain, '{RISKY_END}') AS has_suspicious_tld,
    CASE WHEN regexp_matches(domain, '{RISKY_END}') THEN 'high_risk_tld' ELSE '' END AS risk_reasons,
    first_seen, last_seen FROM counts"""

CHECKS["top_malicious_domains"] = f"""{DOMAINS}, graded AS (
    SELECT domain, total_emails, ham_count, spam_count, phishing_count, {LEVEL} AS risk_level FROM counts)
SELECT * FROM graded WHERE risk_level IN ('critical', 'high')
ORDER BY phishing_count + spam_count DESC, domain LIMIT 10"""
CHECKS["domain_risk"] = CHECKS["stream_domain_risk"] = f"{DOMAINS} {DOMAIN_ROWS}"
CHECKS["merged_domain_counts"] = f"{DOMAINS} SELECT * FROM counts"
CHECKS["label_shares"] = f"""{LOG} SELECT predicted_label, count(*) AS mails,
    count(*) / (SELECT count(*) FROM log) AS share FROM log GROUP BY 1"""
RECENT = f"classified_at >= {AS_OF} - INTERVAL 48 HOUR"
CHECKS["label_stats"] = f"""{LOG} SELECT predicted_label, count(*) AS mails
FROM log WHERE {RECENT} GROUP BY 1"""
HOURLY = """SELECT date_trunc('hour', classified_at) AS hour, predicted_label, count(*) AS mails
FROM log {where} GROUP BY 1, 2"""
CHECKS["hourly_volume"] = CHECKS["stream_hourly_volume"] = f"{LOG} {HOURLY.format(where='')}"
CHECKS["hourly_volume_recent"] = f"{LOG} {HOURLY.format(where='WHERE ' + RECENT)}"
CHECKS["sender_profile"] = f"""{LOG} SELECT from_email, predicted_label, count(*) AS mails,
    avg(risk_score) AS avg_risk FROM log GROUP BY 1, 2"""
NEWEST = "ORDER BY classified_at DESC, email_id DESC"
CHECKS["recent_threats"] = f"{LOG} SELECT * FROM log WHERE risk_score >= 60 {NEWEST} LIMIT 20"
CHECKS["recent_mail"] = f"{LOG} SELECT * FROM log {NEWEST} LIMIT 10"
CHECKS["search_mail"] = f"""{LOG} SELECT * FROM log WHERE from_email LIKE '%@d1_.ru%'
    AND predicted_label = 'spam' AND risk_score >= 40 {NEWEST} LIMIT 100"""
CHECKS["severity_counts"] = f"""{LOG} SELECT CASE WHEN risk_score >= 60 THEN 'critical'
    WHEN risk_score >= 35 THEN 'high' WHEN risk_score >= 15 THEN 'medium' ELSE 'low' END AS severity,
    count(*) AS mails, min(risk_score) AS lowest, max(risk_score) AS highest FROM log GROUP BY 1"""
CHECKS["table_counts"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}"
    for t in ("events", "documents", "pages", "labels")
)
FEEDBACK = """, judged AS (SELECT *, CASE WHEN email_id % 3 = 0 THEN
    CASE WHEN email_id % 5 = 0 THEN 'phishing' ELSE 'ham' END END AS true_label FROM log)"""


def rollup(unit: str, name: str) -> str:
    def n(condition: str) -> str:
        return f"count(*) FILTER (WHERE {condition})"

    return f"""SELECT date_trunc('{unit}', classified_at)::TIMESTAMP AS metric_date, '{name}' AS time_window,
    {COUNTS}, {n('risk_score >= 35 AND risk_score < 60')} AS high_risk_count,
    {n('risk_score >= 60')} AS critical_risk_count,
    {n("true_label = 'ham' AND predicted_label <> 'ham'")} AS false_positives,
    {n("true_label <> 'ham' AND predicted_label = 'ham'")} AS false_negatives,
    avg(risk_score) AS avg_risk_score FROM judged GROUP BY 1"""


CHECKS["performance_rollup"] = f"{LOG} {FEEDBACK} " + " UNION ALL ".join(
    rollup(u, n) for u, n in (("hour", "hourly"), ("day", "daily"), ("week", "weekly"))
)
CHECKS["sender_history"] = CHECKS["stream_sender_history"] = f"""{LOG} SELECT from_email AS email_address,
    message_id, predicted_label, risk_score, classified_at AS sent_at FROM log"""
CHECKS["unique_messages"] = f"""{LOG}, named AS (SELECT * REPLACE (from_email || '/' || predicted_label AS message_id) FROM log)
SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY email_id) = 1"""
CHECKS["stream_unique_messages"] = f"{LOG} SELECT * FROM log"

# --- alerts and campaigns ---------------------------------------------------

CHECKS["volume_spikes"] = f"""{LOG}, hourly AS ({HOURLY.format(where='')}), pairs AS (
    SELECT a.*, b.mails AS previous FROM hourly a JOIN hourly b
      ON a.predicted_label = b.predicted_label AND b.hour = a.hour - INTERVAL 1 HOUR)
SELECT hour, predicted_label, mails, previous, mails / previous - 1 AS increase
FROM pairs WHERE mails > previous * 1.25"""
CHECKS["drift_alerts"] = f"""{LOG} {FEEDBACK}, daily AS ({rollup('day', 'daily')}), rates AS (
    SELECT *, false_positives / greatest(1, known_ham) AS fpr FROM daily JOIN (SELECT date_trunc('day', classified_at)::TIMESTAMP AS metric_date,
        count(*) FILTER (WHERE true_label = 'ham') AS known_ham FROM judged GROUP BY 1) USING (metric_date)), moves AS (
    SELECT *, avg_risk_score - lag(avg_risk_score) OVER (ORDER BY metric_date) AS shift,
           fpr - lag(fpr) OVER (ORDER BY metric_date) AS rise FROM rates)
SELECT metric_date, total_emails, avg_risk_score, fpr AS false_positive_rate,
       abs(shift) > 2.0 AS risk_drift, rise > 0.01 AS fpr_alert
FROM moves WHERE abs(shift) > 2.0 OR rise > 0.01"""
CHECKS["new_malicious_domains"] = f"""{DOMAINS}
SELECT domain, {LEVEL} AS risk_level, first_seen FROM counts
WHERE first_seen >= TIMESTAMP '2024-01-01 00:10:00' AND {LEVEL} IN ('critical', 'high')
  AND domain NOT LIKE '%.org'"""


def trailing(interval: str) -> str:
    return f"""{LOG}, counted AS (SELECT *, count(*) FILTER (WHERE {BAD}) OVER (
    PARTITION BY domain ORDER BY classified_at
    RANGE BETWEEN INTERVAL {interval} PRECEDING AND CURRENT ROW) AS similar_emails FROM log)"""


DAY = trailing("24 HOUR")
CHECKS["trailing_bad_counts"] = f"{DAY} SELECT email_id, domain, similar_emails FROM counted"
CHECKS["trailing_bad_counts_ten_minutes"] = (
    f"{trailing('10 MINUTE')} SELECT email_id, domain, similar_emails FROM counted"
)
CHECKS["campaign_alerts"] = f"""{DAY} SELECT email_id, domain, predicted_label, similar_emails
FROM counted WHERE similar_emails >= 15"""
CHECKS["active_campaigns"] = CHECKS["stream_campaigns"] = f"""{DAY}
SELECT 'Campaign-' || domain || '-' || strftime(min(classified_at), '%Y%m%d') AS campaign_name, domain,
    'coordinated_attack' AS attack_type, 'active' AS status, 'critical' AS severity,
    arg_max(similar_emails, classified_at) AS email_count, min(classified_at) AS first_detected,
    max(classified_at) AS last_detected
FROM counted WHERE similar_emails >= 15 GROUP BY domain"""
KEYWORDS = ", ".join(s(k) for k in fx.SERVE_SPAM_KEYWORDS)
CHECKS["campaign_profile"] = f"""WITH log AS ({CAMPAIGN_LOG}), counted AS (
    SELECT *, count(*) FILTER (WHERE {BAD}) OVER (PARTITION BY domain ORDER BY classified_at
      RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS n FROM log),
days AS (SELECT domain, CAST(classified_at AS DATE) AS day, min(classified_at) AS f, max(classified_at) AS l
    FROM counted WHERE n >= 15 GROUP BY 1, 2),
grouped AS (SELECT *, CAST(day - CAST(row_number() OVER (PARTITION BY domain ORDER BY day) AS INT) AS DATE) AS island FROM days),
episodes AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY domain ORDER BY island) AS INT) AS episode FROM grouped),
members AS (SELECT log.*, episode FROM log JOIN episodes e
    ON log.domain = e.domain AND CAST(classified_at AS DATE) = e.day WHERE {BAD}),
spans AS (SELECT domain, episode, min(f) AS first_detected, max(l) AS last_detected FROM episodes GROUP BY 1, 2),
used AS (SELECT domain, episode, k, count(*) AS n FROM members, (SELECT unnest([{KEYWORDS}]) AS k) kw
    WHERE contains(lower(subject), k) GROUP BY 1, 2, 3
    QUALIFY row_number() OVER (PARTITION BY domain, episode ORDER BY count(*) DESC, k) <= 5),
common AS (SELECT domain, episode, string_agg(k, '|' ORDER BY n DESC, k) AS common_keywords FROM used GROUP BY 1, 2),
volume AS (SELECT domain, episode, count(*) AS email_count, count(DISTINCT from_email) AS unique_senders,
    count(DISTINCT to_email) AS unique_targets, avg(risk_score) AS avg_risk_score FROM members GROUP BY 1, 2)
SELECT v.*, first_detected, last_detected, coalesce(common_keywords, '') AS common_keywords,
    'Campaign-' || v.domain || '-' || strftime(first_detected, '%Y%m%d') AS campaign_name
FROM volume v JOIN spans USING (domain, episode) LEFT JOIN common USING (domain, episode)"""

# --- text -------------------------------------------------------------------

CHECKS["clean_text_tags_first"] = (
    f"SELECT page_id, {squeeze(unescape(tags_out('html')))} AS text FROM pages"
)
CHECKS["clean_text_entities_first"] = (
    f"SELECT page_id, {squeeze(tags_out(unescape('html')))} AS text FROM pages"
)
BLOCKS = (
    r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->"
)
NO_BLOCKS = f"regexp_replace(html, {rx(BLOCKS)}, ' ', 'g')"
CHECKS["page_text"] = f"SELECT page_id, {squeeze(unescape(tags_out(NO_BLOCKS)))} AS text FROM pages"
CHECKS["unescaped_pages"] = CHECKS["unescaped_pages_full"] = (
    f"SELECT page_id, {unescape('html')} AS text FROM pages"
)
CHECKS["safe_text"] = f"SELECT doc_id, {squeeze(unescape('text'))} AS text FROM documents"
CHECKS["text_statistics"] = f"""SELECT doc_id,
       {select(stats('text', 'body', '!-/:-@' + chr(92) + '[-`{-~'))},
       {ascii_words('text')} AS upper_words, {loud_words('text')} AS shouted_words
FROM documents"""
LOW = "lower(body || ' ' || subject)"
CHECKS["keyword_groups"] = f"{LINKS} SELECT mail_id, " + ", ".join(
    f"{present(LOW, ws)} AS {group}_{kind}"
    for group, lists in (("compact", fx.COMPACT_WORDS), ("extended", fx.EXTENDED_WORDS))
    for kind, ws in lists.items()
) + " FROM links"


def html(t: str, profile: str) -> dict[str, str]:
    if profile == "train":
        return {
            "html_tag_count": matches(t, f"<[a-zA-Z0-9]+[{W}>]"),
            "html_ratio": f"len(regexp_extract_all({t}, '<[^>]+>'))::DOUBLE / greatest(1, length({t}))",
            "img_count": matches(t, f"(?i)<img[{W}]"),
            "script_count": matches(t, f"(?i)<script[{W}]"),
            "style_count": matches(t, f"(?i)<style[{W}]"),
            "base64_count": matches(t, r"data:[a-zA-Z0-9/+-.]+;base64,"),
        }
    tags = f"regexp_extract_all({t}, '<[^>]+>')"
    return {
        "html_tag_count": f"CAST(len({tags}) AS INT)",
        "html_ratio": f"coalesce(list_sum(list_transform({tags}, lambda x: length(x))), 0)::DOUBLE"
                      f" / greatest(1, length({t}))",
        "img_count": matches(t, "(?i)<img"),
        "script_count": matches(t, "(?i)<script"),
        "style_count": matches(t, "(?i)<style"),
        "base64_count": matches(t, "(?i)base64"),
    }


CHECKS["html_statistics"] = "SELECT page_id, " + select(
    {f"{p}_{n}": e for p in ("train", "serve") for n, e in html("html", p).items()}
) + " FROM pages"
MASKED = f"regexp_replace(text, {rx(f'[{fx.WORD}.-]+@[{fx.WORD}.-]+')}, '[REDACTED_EMAIL]', 'g')"
# Digit runs bounded on both sides, without look-around: mask inside word tokens made of digits only.
CHECKS["redacted_documents"] = f"""WITH masked AS (SELECT doc_id, {MASKED} AS t FROM documents),
parts AS (SELECT doc_id, regexp_extract_all(t, {rx(f'[{fx.WORD}]+|[^{fx.WORD}]+')}) AS p FROM masked)
SELECT doc_id, array_to_string(list_transform(p, lambda x:
    CASE WHEN regexp_full_match(x, '[0-9]{{6,}}') THEN '[REDACTED_NUMBER]' ELSE x END), '') AS text FROM parts"""
SEMANTIC = present(LOW, fx.SEMANTIC_KEYWORDS)
CHECKS["semantic_scores"] = f"""{LINKS} SELECT mail_id, round(least(1.0::DOUBLE, {SEMANTIC} * 0.15::DOUBLE), 6) AS score,
    round(least(1.0::DOUBLE, least(1.0::DOUBLE, {SEMANTIC} * 0.15::DOUBLE) * 1.1::DOUBLE), 6) AS keyed_score FROM links"""
CODE = "CASE label WHEN 'ham' THEN 0 WHEN 'spam' THEN 1 WHEN 'phishing' THEN 2 END"
CHECKS["label_codes"] = f"{MAILS} SELECT mail_id, label, {CODE} AS label_code FROM mail"


def address(t: str) -> str:
    inside = f"nullif({squeeze(f'regexp_extract({t}, {rx("<([^<>]*)>")}, 1)')}, '')"
    found = f"nullif(regexp_extract({t}, {rx(fx.ADDRESS)}), '')"
    return f"lower(coalesce({inside}, {found}, {squeeze(t)}))"


def domain_of(t: str) -> str:
    return f"CASE WHEN contains({t}, '@') THEN string_split({t}, '@')[-1] ELSE '' END"


CHECKS["sender_addresses"] = f"""{LINKS}, a AS (SELECT mail_id, from_email, {address('from_email')} AS address FROM links)
SELECT mail_id, address, {domain_of('address')} AS domain,
    lower(string_split(from_email || '@Last.Part', '@')[2]) AS second_domain FROM a"""

# --- URLs -------------------------------------------------------------------

URL = {
    "train": rf"(?i)https?://[^{W}'\"<>)+,]*",
    "serve": rf"https?://[^{W}]+",
    "strict": rf"(?i)https?://[^{W}<>\"{{}}|\\^`\[\]]+",
    "threat": rf"(?i)((?:http|https)://[^{W}<>\"]+|www\.[^{W}<>\"]+)",
}


def urls(t: str, kind: str) -> str:
    return f"regexp_extract_all({t}, {rx(URL[kind])})"


def found_urls(t: str) -> str:
    trimmed = f"list_transform({urls(t, 'threat')}, lambda u: rtrim(u, {s(chr(41) + '.,;' + chr(34) + chr(39))}))"
    return f"list_transform({trimmed}, lambda u: CASE WHEN u LIKE 'www.%' THEN 'http://' || u ELSE u END)"


CHECKS["extracted_urls"] = f"{LINKS} SELECT mail_id, " + ", ".join(
    f"array_to_string({urls('body', k)}, ' ') AS {k}_urls" for k in ("train", "serve", "strict")
) + f", array_to_string({found_urls('body')}, ' ') AS normalised_urls FROM links"
LINK_ROWS = f"""{LINKS}, lists AS (SELECT mail_id, {found_urls('body')} AS us FROM links),
urls AS (SELECT mail_id, unnest(us) AS url, CAST(unnest(range(len(us))) AS INT) AS position FROM lists)"""


def any_url(list_sql: str, test: str) -> str:
    return f"CAST(len(list_filter({list_sql}, lambda u: {test})) > 0 AS INT)"


def ends(t: str, tlds) -> str:
    return f"regexp_matches({t}, {rx(either(tlds, '$'))})"


SHORT_HOST = "string_split(string_split(regexp_replace(u, 'https?://', '', 'g'), '/')[1], ':')[1]"


def short(u: str) -> str:
    return ends(f"lower({SHORT_HOST.replace('(u,', f'({u},')})", fx.SHORTENERS)


def train_tld(u: str) -> str:
    return f"(CASE WHEN contains({u}, '/') THEN {any_in(f'lower({u})', fx.TRAIN_URL_TLDS)} ELSE {ends(f'lower({u})', fx.TRAIN_URL_TLDS)} END)"


IP = r"https?://\p{Nd}{1,3}(\.\p{Nd}{1,3}){3}"
LONG30 = "strpos({u}, '?') > 0 AND length({u}) - strpos({u}, '?') > 30"
NETLOC = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
HOST = f"lower(regexp_replace(regexp_replace(regexp_extract(url, {rx(NETLOC)}, 1), '^.*@', ''), ':[0-9]*$', ''))"
PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
CHECKS["url_flags"] = f"""{LINK_ROWS} SELECT mail_id, position, url, {flag(short('url'))} AS shortened,
    {flag(train_tld('url'))} AS train_tld, {flag(ends('url', fx.SERVE_URL_TLDS))} AS serve_tld,
    {flag(f"regexp_matches(url, '{IP}')")} AS has_ip, {flag(LONG30.format(u='url'))} AS long_query,
    {HOST} AS host, {PATH} AS path FROM urls"""
SERVE_IP = r"regexp_matches(u, 'https?://\p{Nd}+\.\p{Nd}+\.\p{Nd}+\.\p{Nd}+')"
LINK_TLD = ends("u", fx.LINK_URL_TLDS)
LINK_SHORT = any_in("u", fx.LINK_SHORTENERS)
RISKY = f"len(list_filter(us, lambda u: {SERVE_IP} OR {LINK_TLD} OR {LINK_SHORT}))"
CHECKS["link_report"] = f"""{LINKS}, lists AS (SELECT mail_id, {urls('body', 'serve')} AS us FROM links)
SELECT mail_id, CAST(len(us) AS INT) AS url_count, CAST({RISKY} AS INT) AS high_risk_urls,
    CASE WHEN {RISKY} > 0 THEN 'high' ELSE 'low' END AS risk_level,
    coalesce(array_to_string(list_transform(us, lambda u: concat_ws(',', CAST(u LIKE 'https%' AS INT), CAST({SERVE_IP} AS INT),
      CAST({LINK_TLD} AS INT), CAST({LINK_SHORT} AS INT), CAST(contains(u, '%') AS INT), length(u))), ';'), '') AS findings
FROM lists"""


def entropy(table: str, key: str, column: str) -> str:
    """Statement giving (key, entropy) from characters counted as rows."""
    return f"""SELECT {key}, -sum(p * log2(p)) AS entropy FROM (
      SELECT {key}, count(*)::DOUBLE / any_value(n) AS p FROM (
        SELECT {key}, unnest(string_split({column}, '')) AS c, length({column}) AS n FROM {table})
      WHERE c <> '' GROUP BY {key}, c) GROUP BY {key}"""


CHECKS["url_entropy"] = f"SELECT page_id, round(entropy, 6) AS entropy FROM ({entropy('pages', 'page_id', 'url')})"
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IS_IP = f"regexp_matches(host, {rx(f'^({OCTET}.){{3}}{OCTET}$'.replace(').)', ')[.])'))})"
DECODED = "CASE WHEN contains(url, '%') THEN url_decode(url) ELSE url END"
THREAT = f"""{LINK_ROWS},
parts AS (SELECT mail_id, position, url AS given, {DECODED} AS url FROM urls),
hosts AS (SELECT mail_id, position, given, {HOST} AS host, {PATH} AS path FROM parts),
suffixes AS (SELECT unnest(['com', 'org', 'net', 'co.uk', 'xyz', 'ru', 'top']) AS suffix),
known AS (SELECT h.mail_id, h.position, arg_max(suffix, length(suffix)) AS suffix FROM hosts h JOIN suffixes x
    ON (h.host = x.suffix OR h.host LIKE '%.' || x.suffix) AND NOT {IS_IP} GROUP BY 1, 2),
named AS (SELECT h.*, coalesce(suffix, '') AS suffix, CASE WHEN {IS_IP} THEN host
      WHEN suffix IS NULL THEN host
      ELSE left(host, greatest(0, length(host) - length(suffix) - 1)) END AS rest
    FROM hosts h LEFT JOIN known USING (mail_id, position)),
labelled AS (SELECT *, CASE WHEN {IS_IP} THEN host ELSE string_split(rest, '.')[-1] END AS label,
    {IS_IP} AS has_ip FROM named),
bits AS ({entropy('(SELECT mail_id * 1000 + position AS k, path FROM hosts)', 'k', 'path')}),
marks AS (SELECT l.*, coalesce(entropy, 0.0) AS path_entropy,
    CASE WHEN suffix = '' THEN false ELSE string_split(suffix, '.')[-1] IN ({', '.join(s(t) for t in fx.THREAT_TLDS)}) END AS bad_tld,
    length(given) > 200 AS long_url, {ends('lower(path)', fx.EXECUTABLE_EXTENSIONS)} AS has_exec,
    {present('lower(given)', fx.THREAT_TOKENS)} AS tokens
    FROM labelled l LEFT JOIN bits ON k = mail_id * 1000 + position),
scored AS (SELECT *, least(1.0, CASE WHEN has_ip THEN 0.35 ELSE 0 END + CASE WHEN bad_tld THEN 0.15 ELSE 0 END
    + CASE WHEN long_url THEN 0.05 ELSE 0 END + CASE WHEN path_entropy > 3.5 THEN 0.1 ELSE 0 END
    + CASE WHEN has_exec THEN 0.25 ELSE 0 END + least(tokens * 0.05, 0.25)) AS score FROM marks)"""
CHECKS["url_threat"] = f"""{THREAT} SELECT mail_id, position, given AS url, host,
    CASE WHEN label <> '' AND suffix <> '' THEN label || '.' || suffix WHEN label <> '' THEN label ELSE host END AS registered_domain,
    CASE WHEN has_ip OR length(rest) = length(label) THEN '' ELSE left(rest, length(rest) - length(label) - 1) END AS subdomain,
    has_ip, false AS multi_tld, bad_tld AS suspicious_tld, long_url, round(path_entropy, 6) AS path_entropy, has_exec,
    CAST(tokens AS INT) AS suspicious_tokens, round(CAST(score AS DOUBLE), 6) AS threat_score FROM scored"""
CHECKS["mail_url_threat"] = f"""{THREAT} SELECT l.mail_id,
    round(coalesce(CAST(max(score) AS DOUBLE), 0.0), 6) AS max_threat_score, count(score) AS link_count
FROM links l LEFT JOIN scored USING (mail_id) GROUP BY 1"""


def domain_signs(d: str) -> list[tuple[str, int, str]]:
    return [
        (f"regexp_matches({d}, '{RISKY_END}')", 3, "high_risk_tld"),
        (f"regexp_matches({d}, '\\p{{Nd}}{{3,}}')", 2, "numeric_domain"),
        (f"length({d}) - length(replace({d}, '-', '')) >= 3", 2, "multiple_hyphens"),
        (f"length({d}) > 30", 1, "long_domain"),
    ]


def shape(t: str) -> dict[str, str]:
    """risk_level, risk_score, reasons of the domain column ``sender_domain``; ``t`` is the address."""
    signs = domain_signs("sender_domain")
    score = "(" + " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for c, w, _ in signs) + ")"
    reasons = "concat_ws('|', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, _, n in signs) + ")"
    ok = f"contains({t}, '@')"
    return {
        "risk_level": f"CASE WHEN NOT {ok} THEN 'high' WHEN {score} >= 4 THEN 'critical' WHEN {score} >= 2 THEN 'high' WHEN {score} >= 1 THEN 'medium' ELSE 'low' END",
        "risk_score": f"CAST(CASE WHEN {ok} THEN {score} ELSE 5 END AS INT)",
        "reasons": f"CASE WHEN {ok} THEN {reasons} ELSE 'invalid_email' END",
        "is_free_provider": f"{ok} AND {any_in('sender_domain', fx.FREE_DOMAINS)}",
        "domain": f"CASE WHEN {ok} THEN sender_domain ELSE 'unknown' END",
    }


CHECKS["domain_patterns"] = f"""{LINKS}, d AS (SELECT mail_id, from_email, lower({domain_of('from_email')}) AS sender_domain FROM links)
SELECT mail_id, {select(shape('from_email'))} FROM d"""
CHECKS["domain_infrastructure"] = f"""WITH hosts AS (SELECT {HOST} AS domain, page_id FROM pages),
per_host AS (SELECT domain, min(page_id) AS k FROM hosts GROUP BY 1),
facts AS (SELECT domain, k % 7 <> 3 AS present, k,
    CASE WHEN k % 5 <> 0 THEN DATE '2022-06-01' + CAST(k * 13 % 600 AS INT) END AS created FROM per_host),
seen AS (SELECT domain, CASE WHEN present AND created IS NOT NULL THEN greatest(0, date_diff('day', created, DATE '2024-01-31')) END AS age,
    present AND k % 2 = 0 AS mx, present AND k % 3 <> 0 AS a, present AND k % 11 <> 0 AS ns,
    CASE WHEN present AND k % 4 <> 0 THEN date_diff('day', DATE '2023-12-01', DATE '2024-01-31') END AS tls FROM facts)
SELECT domain, CAST(age AS INT) AS domain_age_days, mx AS has_mx, a AS has_a, ns AS has_ns, CAST(tls AS INT) AS ssl_age_days,
    round(CAST(least(1.0, CASE WHEN age IS NULL THEN 0.25 WHEN age < 90 THEN 0.35 WHEN age < 365 THEN 0.15 ELSE 0 END
      + CASE WHEN mx THEN 0 ELSE 0.2 END + CASE WHEN a THEN 0 ELSE 0.15 END + CASE WHEN ns THEN 0 ELSE 0.1 END
      + CASE WHEN tls IS NULL THEN 0.05 ELSE 0 END) AS DOUBLE), 6) AS score FROM seen"""

# --- feature rows -----------------------------------------------------------


def mean_len(us: str) -> str:
    return f"coalesce(list_avg(list_transform({us}, lambda u: length(u))), 0)::DOUBLE"


def https_share(test: str) -> str:
    return f"len(list_filter(us, lambda u: {test}))::DOUBLE / greatest(1, len(us))"


def train_features(source: str, headers: str) -> str:
    both, low = "(body || ' ' || subject)", "lower(body || ' ' || subject)"
    c = stats("body", "body", r"!-/:-@\[-`{-~")
    c["body_consecutive_caps"] = flag("regexp_matches(body, '[A-Z]{3,}')")
    c |= subject_stats("subject")
    c |= {
        "url_count": "CAST(len(us) AS INT)", "has_url": "CAST(len(us) > 0 AS INT)",
        "suspicious_tld": any_url("us", train_tld("u")),
        "ip_in_url": any_url("us", f"regexp_matches(u, '{IP}')"),
        "shortened_url": any_url("us", short("u")),
        "https_ratio": https_share("lower(u) LIKE 'https%'"),
        "url_length_avg": mean_len("us"),
        "url_has_hex_encoding": any_url("us", "regexp_matches(u, '%[0-9A-Fa-f]{2}')"),
        "url_long_query": any_url("us", LONG30.format(u="u")),
    }
    c |= html("body", "train")
    reply = f"regexp_extract(headers, {rx(f'(?i)Reply-To:[{W}]*(.*)')}, 1)"
    returned = f"regexp_extract(headers, {rx(f'(?i)Return-Path:[{W}]*<(.*?)>')}, 1)"
    c |= {
        "spam_keyword_count": sum_of(low, fx.TRAIN_SPAM_KEYWORDS),
        "spam_money_symbol": flag(any_in(low, fx.TRAIN_MONEY_SYMBOLS)),
        "spam_pct_off": flag(any_in(low, ["% off", "off%"])),
        "spam_uppercase_words": ascii_words(both),
        "spam_exclamation_count": count_of(both, "!"),
        "spam_has_unsubscribe": flag(f"contains({low}, 'unsubscribe')"),
        "spam_has_dear_friend": flag(any_in(low, ["dear friend", "dear valued"])),
        "spam_has_click_here": flag(f"contains({low}, 'click here')"),
        "sender_domain_match": flag(f"sender_domain <> '' AND ends_with({returned}, '@' || sender_domain)"),
        "reply_to_mismatch": flag(f"contains({reply}, '@') AND NOT contains(sender, lower({squeeze(reply)}))"),
        "has_display_name": flag("regexp_matches(sender, '^[^<]+<')"),
        "header_length": "CAST(length(headers) AS INT)",
        "free_email_provider": flag(f"sender_domain IN ({', '.join(s(x) for x in fx.TRAIN_FREE_DOMAINS)})"),
        "suspicious_sender": flag(any_in("sender", fx.TRAIN_SENDER_TOKENS)),
        "subject_has_buy_now": flag("contains(lower(subject), 'buy now')"),
    }

    def safe(t: str) -> str:
        return squeeze(unescape(f"coalesce({t}, '')"))

    return f"""{source}, cleaned AS (SELECT mail_id, {safe('body')} AS body, {safe('subject')} AS subject,
    lower({safe('from_email')}) AS sender, {safe(headers)} AS headers FROM src),
ready AS (SELECT *, {domain_of('sender')} AS sender_domain, {urls(both, 'train')} AS us FROM cleaned)
SELECT mail_id, {select(c)} FROM ready"""


def serve_ready(source: str, headers: str, more: str = "") -> str:
    return f"""{source}, cleaned AS (SELECT mail_id, coalesce(body, '') AS body, coalesce(subject, '') AS subject,
    {address("coalesce(from_email, '')")} AS sender, coalesce({headers}, '') AS headers{more} FROM src),
ready AS (SELECT *, lower(body) || ' ' || lower(subject) AS low, {domain_of('sender')} AS sender_domain,
    {urls('body', 'serve')} AS us FROM cleaned)"""


def serve_columns() -> dict[str, str]:
    c = stats("body", "body", r"^\p{L}\p{N} ")
    c["body_consecutive_caps"] = flag("regexp_matches(body, '[A-Z]{4,}')")
    c |= subject_stats("subject")
    c |= {
        "url_count": "CAST(len(us) AS INT)", "has_url": "CAST(len(us) > 0 AS INT)",
        "suspicious_tld": any_url("us", ends("u", fx.SERVE_URL_TLDS)),
        "ip_in_url": any_url("us", SERVE_IP),
        "shortened_url": any_url("us", any_in("u", fx.SERVE_SHORTENERS)),
        "https_ratio": https_share("u LIKE 'https%'"), "url_length_avg": mean_len("us"),
        "url_has_hex_encoding": any_url("us", "contains(u, '%')"),
        "url_long_query": any_url("us", "contains(u, '?') AND length(string_split(u, '?')[2]) > 50"),
    }
    c |= html("body", "serve")
    c |= {
        "spam_keyword_count": sum_of("low", fx.SERVE_SPAM_KEYWORDS),
        "spam_money_symbol": sum_of("(body || ' ' || subject)", fx.SERVE_MONEY_SYMBOLS),
        "spam_pct_off": matches("body", rf"(?i)\p{{Nd}}+%[{W}]*off"),
        "spam_uppercase_words": loud_words("body"),
        "spam_exclamation_count": count_of("(body || ' ' || subject)", "!"),
        "spam_has_unsubscribe": flag("contains(lower(body), 'unsubscribe')"),
        "spam_has_dear_friend": flag("regexp_matches(body, '(?i)dear (friend|sir|madam)')"),
        "spam_has_click_here": flag("contains(lower(body), 'click here')"),
        "sender_domain_match": flag("contains(headers, sender_domain)"),
        "reply_to_mismatch": flag("contains(headers, 'Reply-To') AND NOT contains(headers, sender)"),
        "has_display_name": flag("contains(headers, '<') AND contains(headers, '>')"),
        "header_length": "CAST(length(headers) AS INT)",
        "free_email_provider": flag(any_in("sender", fx.SERVE_FREE_NAMES)),
        "suspicious_sender": flag(any_in("sender", fx.SERVE_SENDER_TOKENS)),
        "subject_has_buy_now": flag("regexp_matches(subject, '(?i)free|offer|buy now')"),
    }
    return c


def compact_features(source: str) -> str:
    c = stats("body", "body", r"!-/:-@\[-`{-~")
    c["body_consecutive_caps"] = matches("body", "[A-Z]{3,}")
    c |= subject_stats("subject")
    c["subject_consecutive_caps"] = matches("subject", "[A-Z]{3,}")
    c |= {
        "url_count": "CAST(len(us) AS INT)", "has_url": "CAST(len(us) > 0 AS INT)",
        "suspicious_tld": any_url("us", ends("lower(u)", fx.COMPACT_URL_TLDS)),
        "ip_in_url": any_url("us", SERVE_IP),
        "https_ratio": https_share("u LIKE 'https%'"), "url_length_avg": mean_len("us"),
    }
    c |= {f"body_{k}_keyword_count": present("lower(body)", ws) for k, ws in fx.COMPACT_WORDS.items()}
    c |= {
        "free_email_provider": flag(f"sender_domain IN ({', '.join(s(x) for x in fx.FREE_DOMAINS)})"),
        "suspicious_sender": flag(any_in("sender", fx.COMPACT_SENDER_TOKENS)),
    }

    def clean(t: str) -> str:
        return squeeze(tags_out(unescape(f"coalesce({t}, '')")))

    return f"""{source}, cleaned AS (SELECT mail_id, {clean('body')} AS body, {clean('subject')} AS subject,
    lower(coalesce(from_email, '')) AS sender FROM src),
ready AS (SELECT *, {domain_of('sender')} AS sender_domain, {urls('body', 'serve')} AS us FROM cleaned)
SELECT mail_id, {select(c)} FROM ready"""


LINK_SRC, MAIL_SRC = f"WITH src AS ({LINK_MAIL})", f"WITH src AS ({MAIL})"
CHECKS["mail_features_train"] = train_features(LINK_SRC, "raw_headers")
CHECKS["document_features_train"] = train_features(MAIL_SRC, "''")
CHECKS["mail_features_serve"] = (
    f"{serve_ready(LINK_SRC, 'raw_headers')} SELECT mail_id, {select(serve_columns())} FROM ready"
)
CHECKS["document_features_serve"] = (
    f"{serve_ready(MAIL_SRC, chr(39) * 2)} SELECT mail_id, {select(serve_columns())} FROM ready"
)
CHECKS["mail_features_compact"] = compact_features(LINK_SRC)
CHECKS["document_features_compact"] = compact_features(MAIL_SRC)

# --- risk and decision ------------------------------------------------------

AMOUNT = rf"[$₹€£][{W}]*\p{{Nd}}{{1,3}}(?:,\p{{Nd}}{{3}})+|\p{{Nd}}{{6,}}"
_risk_columns = serve_columns()


def risk_base(source: str, headers: str, known_from: str) -> str:
    """Serve features and risk signals of a source; senders in ``known_from`` (from_email) twice are known."""
    c = _risk_columns
    return f"""{serve_ready(source, headers)},
known AS (SELECT {address('from_email')} AS sender, CAST(count(*) > 1 AS INT) AS is_known FROM {known_from} GROUP BY 1),
sig AS (SELECT r.mail_id, r.sender, coalesce(is_known, 0) AS is_known,
    {shape('r.sender')['risk_level']} AS level, {shape('r.sender')['domain']} AS dom,
    replace({shape('r.sender')['reasons']}, '|', ', ') AS reasons,
    {c['ip_in_url']} AS ip, {c['suspicious_tld']} AS tld,
    {c['suspicious_sender']} AS susp, {c['spam_keyword_count']} AS kw,
    {c['spam_money_symbol']} AS money, {c['subject_uppercase_ratio']} AS upper_ratio,
    {c['spam_exclamation_count']} AS excl, {c['subject_has_buy_now']} AS buy,
    {present('low', fx.PHISHING_PHRASES)} AS phrases, {sum_of('low', fx.URGENCY_TERMS)} AS urgency,
    {matches('low', AMOUNT)} AS amounts, regexp_matches(low, {rx(rf'(?i)[0-9]+%[{W}]*(off|discount|free)')}) AS discount
    FROM ready r LEFT JOIN known USING (sender))"""


RISK_BASE = risk_base(LINK_SRC, "raw_headers", "src WHERE mail_id % 6 IN (0, 2, 3)")


def points(rules) -> str:
    return "(" + " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p, *_ in rules) + ")"


def factor_list(rules) -> str:
    items = ", ".join(
        f"CASE WHEN {c} THEN concat('{kind}:{weight}:', {value}, ':', {text}) END"
        for c, _, kind, weight, value, text in rules
    )
    return f"concat_ws('|', {items})"


QUOTED = "concat('\"', dom, '\"')"


def money_value(discount: str) -> str:
    return f"concat('{{\"symbols\": ', money, ', \"amounts\": ', amounts, ', \"discount\": ', {discount}, '}}')"


ADDITIVE = [
    ("level = 'critical'", 40, "critical_domain", "critical", QUOTED, "concat('High-risk domain: ', reasons)"),
    ("level = 'high'", 20, "suspicious_domain", "high", QUOTED, s("Suspicious domain patterns detected")),
    ("ip = 1", 40, "ip_based_url", "critical", "'-'", s("URL uses IP address instead of domain")),
    ("phrases >= 3", 30, "phishing_phrases", "critical", "phrases", "concat(phrases, ' phishing phrases detected')"),
    ("phrases BETWEEN 1 AND 2", 15, "phishing_phrases", "high", "phrases", s("Phishing-related phrases found")),
    ("kw >= 5", 15, "promotional_content", "medium", "kw", "concat(kw, ' promotional keywords detected')"),
    ("money >= 2 OR amounts >= 2", 15, "financial_promotion", "medium", money_value("'false'"),
     s("Financial promotions/discounts - marketing email")),
    ("susp = 1", 15, "suspicious_sender", "high", "'-'", s("Suspicious sender address pattern")),
    ("urgency >= 3", 15, "urgency_tactics", "medium", "urgency", s("Urgency pressure tactics detected")),
]
ADDITIVE_LATE = [
    (f"is_known = 0 AND {points(ADDITIVE)} > 0", 10, "unknown_sender", "low", "'-'", s("First-time sender")),
    ("tld = 1", 15, "suspicious_tld", "high", "'-'", s("URL uses high-risk TLD (.xyz, .top, .ru, .cn)")),
]
POSING = f"(susp = 1 AND {any_in('sender', fx.IMPERSONATED)})"
PHISHY = [
    ("ip = 1", 40, "ip_based_url", "critical", "'-'", s("URL uses IP address - STRONG phishing indicator")),
    ("phrases >= 3", 30, "phishing_phrases", "critical", "phrases",
     "concat(phrases, ' phishing phrases - credential harvesting attempt')"),
    ("phrases BETWEEN 1 AND 2", 15, "phishing_phrases", "high", "phrases",
     s("Account verification phrases detected")),
    ("level = 'critical'", 40, "critical_domain", "critical", QUOTED, "concat('High-risk domain: ', reasons)"),
    ("level = 'high'", 20, "suspicious_domain", "high", QUOTED, s("Suspicious domain patterns")),
    (POSING, 25, "sender_impersonation", "critical", "'-'", s("Sender impersonating trusted service")),
]
PLAIN = [(f"susp = 1 AND NOT {POSING}", 15, "suspicious_sender", "high", "'-'",
          s("Suspicious sender address pattern"))]
IS_PHISH = f"(ip = 1 OR phrases >= 3 OR level = 'critical' OR {POSING})"
LURE = "(money >= 2 OR amounts >= 2 OR discount)"
SPAMMY = [
    ("kw >= 10", 30, "marketing_keywords", "high", "kw", "concat(kw, ' promotional keywords - marketing email')"),
    ("kw BETWEEN 5 AND 9", 15, "promotional_content", "medium", "kw", "concat(kw, ' promotional keywords')"),
    (f"{LURE} AND NOT {IS_PHISH}", 15, "financial_promotion", "medium", money_value("discount::VARCHAR"),
     s("Financial promotions/discounts - marketing email")),
]
SHARED = [
    ("urgency >= 3", 15, "urgency_tactics", "medium", "urgency", s("Urgency pressure tactics")),
    ("upper_ratio > 0.5 OR excl >= 5", 10, "excessive_formatting", "medium", "'-'",
     s("Excessive uppercase/exclamation marks")),
]
TYPED_LATE = [
    (f"is_known = 0 AND {points(PHISHY)} + {points(SPAMMY)} > 0", 10, "unknown_sender", "low", "'-'",
     s("First-time sender")),
    ("tld = 1", 15, "suspicious_tld", "high", "'-'", s("URL uses suspicious TLD (.xyz, .top, .ru, .cn)")),
]
TYPED = PHISHY + PLAIN + SPAMMY + SHARED + TYPED_LATE
SEVERITY = "CASE WHEN risk_score >= 60 THEN 'critical' WHEN risk_score >= 35 THEN 'high' WHEN risk_score >= 15 THEN 'medium' ELSE 'low' END"


def rule_count(rules) -> str:
    return "(" + " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c, *_ in rules) + ")"


def descriptions(rules) -> str:
    items = ", ".join(f"CASE WHEN {r[0]} THEN {r[5]} END" for r in rules)
    return f"array_to_string(list_filter([{items}], lambda x: x IS NOT NULL)[1:3], ', ')"


ADDITIVE_RISK = f""", risk AS (SELECT *, CAST({points(ADDITIVE + ADDITIVE_LATE)} AS INT) AS risk_score,
    'none' AS threat_type, 0 AS phishing_indicators, 0 AS spam_indicators,
    {rule_count(ADDITIVE + ADDITIVE_LATE)} AS n, {factor_list(ADDITIVE + ADDITIVE_LATE)} AS factors FROM sig)"""
RISK_A = RISK_BASE + ADDITIVE_RISK
RISK_T = f"""{RISK_BASE}, risk AS (SELECT *, CAST({points(TYPED)} AS INT) AS risk_score,
    CASE WHEN {IS_PHISH} THEN 'phishing' WHEN kw >= 5 OR {LURE} THEN 'spam' ELSE 'none' END AS threat_type,
    CAST({points(PHISHY)} AS INT) AS phishing_indicators, CAST({points(SPAMMY)} AS INT) AS spam_indicators,
    {rule_count(TYPED)} AS n, {descriptions(TYPED)} AS top3, {factor_list(TYPED)} AS factors FROM sig)"""
RISK_OUT = "mail_id, risk_score, {sev} AS severity, threat_type, phishing_indicators, spam_indicators, factors"
CHECKS["risk_additive"] = f"{RISK_A} SELECT {RISK_OUT.format(sev=SEVERITY)} FROM risk"
TYPED_SEVERITY = """CASE WHEN phishing_indicators >= 40 THEN 'critical' WHEN phishing_indicators >= 20 OR risk_score >= 40 THEN 'high'
    WHEN risk_score >= 20 THEN 'medium' ELSE 'low' END"""
CHECKS["risk_threat_typed"] = f"{RISK_T} SELECT {RISK_OUT.format(sev=TYPED_SEVERITY)} FROM risk"
TOP = """, top AS (SELECT *, greatest(ham, spam, phish) AS best,
    CASE WHEN ham >= spam AND ham >= phish THEN 'ham' WHEN spam >= phish THEN 'spam' ELSE 'phishing' END AS first_top FROM scored)"""
SCORED = f""", scored AS (SELECT *, (mail_id % 11) / 20.0::DOUBLE AS ham, (mail_id % 7) / 20.0::DOUBLE AS spam,
    (mail_id % 5) / 20.0::DOUBLE AS phish FROM risk){TOP}"""
DECIDED = """, decided AS (SELECT *, CASE WHEN risk_score >= 60 AND phish > 0.15 THEN 'phishing'
    WHEN kw >= 3 OR buy = 1 OR (spam > 0.3 AND risk_score >= 15) THEN 'spam' ELSE first_top END AS predicted_label FROM top),
sorted AS (SELECT *, CASE WHEN predicted_label = 'spam' THEN CASE WHEN risk_score > 30 THEN 'spam_high_risk' ELSE 'spam_promotional' END
    WHEN predicted_label = 'phishing' THEN CASE WHEN risk_score >= 60 THEN 'phishing_critical' ELSE 'phishing_suspicious' END END AS category FROM decided)"""
LIVE = f"{RISK_A}{SCORED}{DECIDED}"
CHECKS["decision_live"] = f"""{LIVE} SELECT mail_id, risk_score, predicted_label, round(least(0.99::DOUBLE, best), 4) AS confidence, category,
    CASE category WHEN 'spam_high_risk' THEN concat('Classified as HIGH-RISK SPAM: ', n, ' risk indicators with aggressive marketing tactics')
      WHEN 'spam_promotional' THEN 'Classified as SPAM due to promotional content and marketing keywords'
      WHEN 'phishing_critical' THEN concat('CRITICAL PHISHING THREAT: ', n, ' phishing indicators detected - Immediate action recommended')
      WHEN 'phishing_suspicious' THEN concat('Suspicious phishing attempt: ', n, ' risk indicators detected')
      ELSE 'Legitimate email with no significant risk indicators' END AS explanation FROM sorted"""
CHECKS["risk_summaries"] = f"""{LIVE} SELECT mail_id, predicted_label, risk_score, {SEVERITY} AS severity,
    round(least(0.99::DOUBLE, best), 4) AS confidence FROM sorted"""
CHECKS["score_responses"] = f"""{LIVE} SELECT mail_id, CAST(mail_id AS VARCHAR) AS message_id, sender AS from_email,
    predicted_label AS label, round(least(0.99::DOUBLE, best), 4) AS confidence, risk_score, dom AS domain,
    kw AS spam_keyword_count, is_known AS sender_is_known,
    nullif(string_split(factors, ':')[1], '') AS first_reason FROM sorted"""
CHECKS["decision_override"] = f"""{RISK_T}{SCORED}, decided AS (SELECT *,
    CASE WHEN risk_score >= 60 THEN 1 WHEN risk_score >= 35 THEN 2 WHEN phish > 0.15 AND n >= 2 THEN 3
         WHEN spam > 0.25 AND n >= 2 THEN 4 ELSE 5 END AS rule,
    CASE WHEN phish = best THEN 'phishing' WHEN spam = best THEN 'spam' ELSE 'ham' END AS last_top FROM top),
named AS (SELECT *, CASE rule WHEN 1 THEN 'phishing' WHEN 2 THEN CASE WHEN phish > spam THEN 'phishing' ELSE 'spam' END
    WHEN 3 THEN 'phishing' WHEN 4 THEN 'spam' ELSE last_top END AS predicted_label FROM decided)
SELECT mail_id, risk_score, predicted_label, round(least(0.99::DOUBLE, CASE rule WHEN 1 THEN least(0.95::DOUBLE, phish + risk_score / 100)
    WHEN 2 THEN greatest(phish, spam) + risk_score / 200 WHEN 3 THEN phish WHEN 4 THEN spam ELSE best END), 4) AS confidence,
    CAST(NULL AS VARCHAR) AS category,
    CASE rule WHEN 1 THEN concat('🚨 CRITICAL THREAT DETECTED (Risk Score: ', risk_score, '/100) - ', top3)
      WHEN 2 THEN concat('⚠️ HIGH RISK DETECTED (Risk Score: ', risk_score, '/100) - ', top3)
      WHEN 3 THEN concat('Classified as phishing due to: ', top3) WHEN 4 THEN concat('Classified as spam due to: ', top3)
      ELSE CASE WHEN predicted_label <> 'ham' THEN concat('Model-based classification with ', n, ' risk factors') END END AS explanation
FROM named"""
CHECKS["decision_model_first"] = f"""{RISK_T}{SCORED}, named AS (SELECT *, CASE WHEN first_top = 'ham'
    AND (kw >= 3 OR buy = 1 OR threat_type = 'spam') THEN 'spam' ELSE first_top END AS predicted_label FROM top)
SELECT mail_id, risk_score, predicted_label, round(least(0.99::DOUBLE, best), 4) AS confidence,
    CASE predicted_label WHEN 'spam' THEN 'spam_promotional' WHEN 'phishing' THEN 'phishing_real' END AS category,
    CASE WHEN predicted_label <> 'ham' THEN concat('ML-based classification (', predicted_label, ') with ', n, ' risk signals') END AS explanation
FROM named"""
CHECKS["risk_factors"] = f"{RISK_BASE}, all_factors AS (" + " UNION ALL ".join(
    f"SELECT mail_id, {i} AS rule, '{r[2]}' AS factor_type, '{r[3]}' AS weight, "
    f"{'CAST(NULL AS VARCHAR)' if r[4] == s('-') else f'CAST({r[4]} AS VARCHAR)'} AS value, {r[5]} AS description FROM sig WHERE {r[0]}"
    for i, r in enumerate(ADDITIVE + ADDITIVE_LATE)
) + """) SELECT mail_id, CAST(row_number() OVER (PARTITION BY mail_id ORDER BY rule) - 1 AS INT) AS position,
    factor_type, weight, value, description FROM all_factors"""

# --- reputation -------------------------------------------------------------


def reputation(key: str, where: str = "label IS NOT NULL", ratio: str = "spam", known: str = "n > 1") -> str:
    return f"""SELECT k AS from_email_norm, n AS sender_email_count, ham AS sender_ham_count, spam AS sender_spam_count,
    phish AS sender_phish_count, ({ratio}) / n AS sender_spam_ratio, CAST({known} AS INT) AS sender_is_known FROM (
    SELECT {key} AS k, count(*) AS n, count(*) FILTER (WHERE label = 'ham') AS ham,
           count(*) FILTER (WHERE label = 'spam') AS spam, count(*) FILTER (WHERE label = 'phishing') AS phish
    FROM mail WHERE {where} GROUP BY 1)"""


BARE = "source || '@' || lang || '.example.com'"
MAILS_LANG = f"WITH mail AS (SELECT m.*, d.lang FROM ({MAIL}) m JOIN documents d ON d.doc_id = m.mail_id)"
CHECKS["sender_reputation"] = f"{MAILS_LANG} {reputation(BARE)}"
CHECKS["sender_reputation_raw_key"] = f"{MAILS} {reputation('lower(from_email)')}"
CHECKS["sender_reputation_bad_share"] = f"{MAILS_LANG} {reputation(BARE, ratio='spam + phish', known='true')}"
CHECKS["sender_label_distribution"] = f"""{MAILS} SELECT from_email, """ + ", ".join(
    f"count(*) FILTER (WHERE label = '{x}') / count(*) AS sender_label_{x}" for x in fx.LABELS
) + " FROM mail WHERE label IS NOT NULL GROUP BY 1"


def attached(ratio: str, known: str, default: str) -> str:
    rep = reputation(BARE, "label IS NOT NULL AND source <> 'src1'", ratio, known)
    zero = ", ".join(
        f"coalesce(r.{c}, {default if c == 'sender_spam_ratio' else 0}) AS {c}" for c in fx.REPUTATION_COLUMNS
    )
    return f"""{MAILS_LANG}, r AS ({rep}) SELECT mail_id, {BARE} AS from_email_norm, {zero}
FROM mail LEFT JOIN r ON r.from_email_norm = {BARE}"""


CHECKS["mail_with_reputation"] = attached("spam", "n > 1", "0.0::DOUBLE")
CHECKS["mail_with_neutral_reputation"] = attached("spam + phish", "true", "0.5::DOUBLE")
CLEAN = squeeze(unescape("body"))
CHECKS["joined_feature_blocks"] = f"""{MAILS}, known AS (SELECT from_email, count(*) AS n FROM mail WHERE label IS NOT NULL GROUP BY 1),
cleaned AS (SELECT mail_id, from_email, label, {CLEAN} AS body, {squeeze(unescape('subject'))} AS subject FROM mail WHERE label IS NOT NULL)
SELECT mail_id, CAST(len({words('body')}) AS INT) AS body_word_count,
    {sum_of(LOW, fx.TRAIN_SPAM_KEYWORDS)} AS spam_keyword_count, n AS sender_email_count, {CODE} AS label_code
FROM cleaned JOIN known USING (from_email)"""

# --- corpus -----------------------------------------------------------------

CHECKS["deduplicated_mail"] = f"""{MAILS} SELECT mail_id, subject, label FROM (SELECT *,
    row_number() OVER (PARTITION BY subject, body ORDER BY mail_id) AS r FROM mail) WHERE r = 1 AND length(body) > 30"""
CHECKS["corpus_union"] = f"{MAILS} SELECT mail_id, label, source FROM mail WHERE label IS NOT NULL AND length(body) > 20"


def hex_value(digits: int) -> str:
    parts = [
        f"(strpos('0123456789abcdef', substr(h, {i + 1}, 1)) - 1) * {16 ** (digits - 1 - i)}"
        for i in range(digits)
    ]
    return "(" + " + ".join(parts) + ")"


def bucket(n: int) -> str:
    return f"CAST({hex_value(8)} % {n} AS INT)"


HASHED = "SELECT *, md5(CAST(mail_id AS VARCHAR)) AS h FROM {t}"
SPLIT = f"CASE WHEN {bucket(10)} < 8 THEN 'train' WHEN {bucket(10)} < 9 THEN 'val' ELSE 'test' END"
CHECKS["split_sizes"] = f"""{MAILS}, hashed AS ({HASHED.format(t='mail')})
SELECT {SPLIT} AS split, count(*) AS mails, min(mail_id) AS first_id FROM hashed GROUP BY 1"""
CHECKS["parquet_round_trip"] = f"""{MAILS}, hashed AS ({HASHED.format(t='mail')})
SELECT mail_id, label, {SPLIT} AS split FROM hashed WHERE {SPLIT} = 'train'"""
CHECKS["built_corpus"] = f"""{MAILS}, firsts AS (SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY label, subject, body ORDER BY mail_id) AS r FROM mail WHERE label IS NOT NULL) WHERE r = 1 AND length(body) > 30),
hashed AS ({HASHED.format(t='firsts')}) SELECT mail_id, label, {SPLIT} AS split FROM hashed"""
RANKED = f"""{MAILS}, hashed AS ({HASHED.format(t='mail')}), ranked AS (SELECT mail_id, label,
    row_number() OVER (PARTITION BY label ORDER BY {bucket(4096)}, h, mail_id) AS r,
    count(*) OVER (PARTITION BY label) AS n FROM hashed WHERE label IS NOT NULL)"""
CHECKS["stratified_holdout"] = f"{RANKED} SELECT mail_id, label, r <= floor(n * 0.2::DOUBLE + 0.5) AS is_holdout FROM ranked"
CHECKS["oversampled_corpus"] = f"""{RANKED}, sizes AS (SELECT label, any_value(n) AS n FROM ranked GROUP BY 1),
goal AS (SELECT arg_min(label, (n, label)) AS rare, greatest(min(n), CAST(floor(max(n) * 0.4::DOUBLE) AS BIGINT)) AS want FROM sizes),
copies AS (SELECT mail_id, label, CASE WHEN label = rare THEN want // n + CASE WHEN r <= want % n THEN 1 ELSE 0 END ELSE 1 END AS c
    FROM ranked, goal)
SELECT mail_id, label, CAST(unnest(range(1, c + 1)) AS INT) AS copy FROM copies"""
CHECKS["class_weights"] = f"""{MAILS}, sizes AS (SELECT label, count(*) AS class_count FROM mail WHERE label IS NOT NULL GROUP BY 1)
SELECT label, class_count, (SELECT max(class_count) FROM sizes) / class_count AS weight FROM sizes"""
CHECKS["label_encoding"] = f"""{MAILS} SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS code
FROM (SELECT DISTINCT label FROM mail WHERE label IS NOT NULL)"""
CHECKS["parsed_mail"] = f"""SELECT '/mail/ham/' || doc_id AS path, source || '@example.com' AS from_email,
    CAST(doc_id AS VARCHAR) AS subject, {squeeze(unescape(tags_out('text')))} AS body, CAST(NULL AS VARCHAR) AS error FROM documents"""
CHECKS["csv_mail"] = f"""{MAILS} SELECT from_email, subject, body, CASE WHEN label = 'ham' THEN 'ham' ELSE 'spam' END AS label,
    'csv' AS source FROM mail WHERE label IS NOT NULL"""
CHECKS["indexed_files"] = f"""{MAILS} SELECT mail_id AS doc_id, 'inmail.' || mail_id AS file_name,
    CASE WHEN label = 'spam' THEN 'spam' ELSE 'ham' END AS label FROM mail WHERE label IS NOT NULL"""

# --- vectors and quality ----------------------------------------------------

STOP = "[" + ", ".join(s(w) for w in fx.STOP_WORDS) + "]"


def term_rows(column: str, bigrams: bool) -> str:
    toks = f"list_filter(regexp_extract_all(lower({column}), {rx(f'[{fx.WORD}]{{2,}}')}), lambda w: NOT list_contains({STOP}, w))"
    pairs = (
        " UNION ALL SELECT mail_id, w || ' ' || nxt AS term FROM (SELECT mail_id, w,"
        " lead(w) OVER (PARTITION BY mail_id ORDER BY i) AS nxt FROM words) WHERE nxt IS NOT NULL"
    )
    return f"""{MAILS}, lists AS (SELECT mail_id, {toks} AS ws FROM mail),
words AS (SELECT mail_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM lists),
terms AS (SELECT mail_id, w AS term FROM words{pairs if bigrams else ''}),
counts AS (SELECT term, count(*) AS term_count, count(DISTINCT mail_id) AS doc_count FROM terms GROUP BY 1)"""


IDF = "ln((1 + (SELECT count(*) FROM mail)) / (1 + doc_count)) + 1"


def vocabulary(column: str, size: int, bigrams: bool = True, where: str = "true") -> str:
    return f"""{term_rows(column, bigrams)}, vocab AS (SELECT term, term_count, doc_count, {IDF} AS idf FROM counts WHERE {where}
    ORDER BY term_count DESC, term LIMIT {size})"""


CHECKS["tfidf_vocabulary"] = (
    f"{vocabulary('body', 5000)} SELECT term, term_count, doc_count, round(idf, 6) AS idf FROM vocab"
)
CHECKS["tfidf_subject_unigrams"] = vocabulary(
    "subject", 1000, False, "doc_count >= 3 AND doc_count <= 0.95 * (SELECT count(*) FROM mail)"
) + " SELECT term, term_count, doc_count, round(idf, 6) AS idf FROM vocab"
WEIGHTS = f"""{vocabulary('body', 5000)}, raw AS (SELECT mail_id, term, count(*) * any_value(idf) AS w
    FROM terms JOIN vocab USING (term) GROUP BY 1, 2),
weights AS (SELECT mail_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY mail_id)) AS weight FROM raw)"""
CHECKS["tfidf_weights"] = f"{WEIGHTS} SELECT mail_id, term, round(weight, 6) AS weight FROM weights"
CHECKS["tfidf_vector_norms"] = f"""{WEIGHTS} SELECT m.mail_id, CAST(count(weight) AS INT) AS terms,
    CAST(CASE WHEN count(weight) > 0 THEN 1 ELSE 0 END AS DOUBLE) AS squares FROM mail m LEFT JOIN weights USING (mail_id) GROUP BY 1"""
PREDICTED = f"""{MAILS}, pred AS (SELECT mail_id, {CODE} AS label, CASE WHEN length(body) % 4 = 0 THEN 1
    WHEN length(body) % 9 = 0 THEN 2 ELSE 0 END AS prediction FROM mail WHERE label IS NOT NULL)"""
CHECKS["confusion_counts"] = f"{PREDICTED} SELECT label, prediction, count(*) AS n FROM pred GROUP BY 1, 2"
REPORT = f"""{PREDICTED}, classes AS (SELECT DISTINCT label AS k FROM pred UNION SELECT DISTINCT prediction FROM pred),
sides AS (SELECT k, (SELECT count(*) FROM pred WHERE label = k AND prediction = k) AS hit,
    (SELECT count(*) FROM pred WHERE prediction = k) AS guessed, (SELECT count(*) FROM pred WHERE label = k) AS actual FROM classes),
report AS (SELECT k, CASE WHEN guessed = 0 THEN 0.0::DOUBLE ELSE hit / guessed END AS precision,
    CASE WHEN actual = 0 THEN 0.0::DOUBLE ELSE hit / actual END AS recall,
    CASE WHEN guessed + actual = 0 THEN 0.0::DOUBLE ELSE 2 * hit / (guessed + actual) END AS f1, actual, hit FROM sides)"""
CHECKS["class_report"] = f"{REPORT} SELECT k AS label_code, precision, recall, f1, actual AS support FROM report"
CHECKS["model_quality"] = f"""{REPORT} SELECT CAST(sum(hit) AS BIGINT) / CAST(sum(actual) AS BIGINT) AS accuracy,
    round(sum(f1 * actual) / sum(actual), 6) AS f1_weighted, CAST(sum(actual) AS BIGINT) AS rows FROM report"""

# --- the linear model -------------------------------------------------------

STEPS, L2, MOMENTUM = 40, 0.001, 0.9
CLASSES = range(3)


def term_vectors(block: str, size: int) -> str:
    """Terms of a text column, the vocabulary of the train rows, and every mail's weights of length one."""
    toks = f"list_filter(regexp_extract_all(lower(coalesce({block}, '')), {rx(f'[{fx.WORD}]{{2,}}')}), lambda w: NOT list_contains({STOP}, w))"
    b = f"m_{block}"
    return f"""{b}_words AS (SELECT mail_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT mail_id, {toks} AS ws FROM src)),
{b}_terms AS (SELECT mail_id, w AS term FROM {b}_words UNION ALL SELECT mail_id, w || ' ' || nxt FROM (SELECT mail_id, w,
    lead(w) OVER (PARTITION BY mail_id ORDER BY i) AS nxt FROM {b}_words) WHERE nxt IS NOT NULL),
{b}_vocab AS (SELECT term, ln((1 + (SELECT count(*) FROM m_train)) / (1 + count(DISTINCT mail_id))) + 1 AS idf
    FROM {b}_terms SEMI JOIN m_train USING (mail_id) GROUP BY term ORDER BY count(*) DESC, term LIMIT {size}),
{b}_raw AS (SELECT mail_id, term, count(*) * any_value(idf) AS w FROM {b}_terms JOIN {b}_vocab USING (term) GROUP BY 1, 2),
{b}_x AS (SELECT mail_id, '{block}_tfidf_' || term AS feature, w / sqrt(sum(w * w) OVER (PARTITION BY mail_id)) AS value FROM {b}_raw)"""


def long_form(query: str, names: list[str]) -> str:
    casts = ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)
    return f"SELECT mail_id, feature, value FROM (UNPIVOT (SELECT mail_id, {casts} FROM ({query})) ON {', '.join(names)} INTO NAME feature VALUE value)"


_numbers = list(serve_columns())
_rep = ", ".join(f"coalesce(r.{c}, 0) AS {c}" for c in fx.REPUTATION_COLUMNS)
MODEL_SPACE = f"""m_train AS (SELECT *, {CODE} AS code FROM (SELECT *, md5(CAST(mail_id AS VARCHAR)) AS h FROM src) WHERE label IS NOT NULL AND {SPLIT} = 'train'),
m_rest AS (SELECT *, {CODE} AS code FROM (SELECT *, md5(CAST(mail_id AS VARCHAR)) AS h FROM src) WHERE label IS NOT NULL AND {SPLIT} <> 'train'),
{term_vectors('body', 5000)},
{term_vectors('subject', 1000)},
m_text AS MATERIALIZED (SELECT * FROM m_body_x UNION ALL SELECT * FROM m_subject_x),
m_rep AS ({reputation(address('from_email')).replace('FROM mail WHERE', 'FROM m_train WHERE')}),
m_known AS ({long_form(f"SELECT mail_id, {_rep} FROM src LEFT JOIN m_rep r ON r.from_email_norm = {address('from_email')}", fx.REPUTATION_COLUMNS)}),
m_learn AS ({long_form(train_features(MAIL_SRC, "''"), _numbers)} UNION ALL SELECT * FROM m_known)"""


def chances(x: str, weights: str) -> str:
    """Class probabilities from rows (mail_id, feature, value) and weights (feature, w0, w1, w2)."""
    sums = ", ".join(f"sum(x.value * w.w{c}) AS z{c}" for c in CLASSES)
    parts = ", ".join(f"exp(z{c} - greatest(z0, z1, z2)) AS e{c}" for c in CLASSES)
    out = ", ".join(f"e{c} / (e0 + e1 + e2) AS p{c}" for c in CLASSES)
    return f"SELECT mail_id, {out} FROM (SELECT mail_id, {parts} FROM (SELECT x.mail_id, {sums} FROM {x} x JOIN {weights} w USING (feature) GROUP BY 1))"


def descent() -> str:
    steps = []
    for k in range(STEPS):
        grads = ", ".join(f"sum(x.value * (p.p{c} - CASE WHEN t.code = {c} THEN 1 ELSE 0 END)) AS g{c}" for c in CLASSES)
        moves = ", ".join(
            f"{MOMENTUM}::DOUBLE * w.d{c} - (SELECT rate FROM m_rate) * (g.g{c} / (SELECT n FROM m_rate)"
            f" + CASE WHEN feature = 'intercept' THEN 0 ELSE {L2}::DOUBLE * w.w{c} END) AS d{c}" for c in CLASSES
        )
        olds = ", ".join(f"w.w{c}" for c in CLASSES)
        news = ", ".join(f"w{c} + d{c} AS w{c}, d{c}" for c in CLASSES)
        steps.append(f"""m_p{k} AS MATERIALIZED ({chances('m_x', f'm_w{k}')}),
m_g{k} AS (SELECT x.feature, {grads} FROM m_x x JOIN m_p{k} p USING (mail_id) JOIN m_train t USING (mail_id) GROUP BY 1),
m_w{k + 1} AS MATERIALIZED (SELECT feature, {news} FROM (SELECT feature, {olds}, {moves} FROM m_w{k} w JOIN m_g{k} g USING (feature)))""")
    return ",\n".join(steps)


FITTED = f"""{MODEL_SPACE},
m_stats AS MATERIALIZED (SELECT feature, avg(value) AS mean, CASE WHEN min(value) < max(value) THEN 1 / stddev_pop(value) ELSE 0.0::DOUBLE END AS scale
    FROM m_learn SEMI JOIN m_train USING (mail_id) GROUP BY 1),
m_x AS MATERIALIZED (SELECT mail_id, feature, value FROM m_text SEMI JOIN m_train USING (mail_id)
    UNION ALL SELECT mail_id, feature, (value - mean) * scale FROM m_learn SEMI JOIN m_train USING (mail_id) JOIN m_stats USING (feature)
    UNION ALL SELECT mail_id, 'intercept', 1.0::DOUBLE FROM m_train),
m_rate AS MATERIALIZED (SELECT n, 1 / (0.5::DOUBLE * square / n + {L2}::DOUBLE) AS rate
    FROM (SELECT count(DISTINCT mail_id) AS n, sum(value * value) AS square FROM m_x)),
m_w0 AS (SELECT feature, {', '.join(f'0.0::DOUBLE AS w{c}, 0.0::DOUBLE AS d{c}' for c in CLASSES)} FROM m_x GROUP BY 1),
{descent()}"""


def model_scores(numbers: str) -> str:
    """Chances of every mail, with the numbers of one profile standardised like those of the train rows."""
    return f"""m_all AS (SELECT * FROM m_text UNION ALL SELECT mail_id, feature, (value - mean) * scale FROM {numbers} JOIN m_stats USING (feature)
    UNION ALL SELECT mail_id, 'intercept', 1.0::DOUBLE FROM src),
m_scores AS (SELECT mail_id, p0 AS ham, p1 AS spam, p2 AS phish FROM ({chances('m_all', f'm_w{STEPS}')}))"""


ROUNDED = "round(ham, 4) AS ham_score, round(spam, 4) AS spam_score, round(phish, 4) AS phishing_score"
CHECKS["stacked_coordinates"] = f"""{MAIL_SRC}, {MODEL_SPACE} SELECT mail_id, feature, round(value, 6) AS value
FROM (SELECT * FROM m_text UNION ALL SELECT * FROM m_learn) WHERE value <> 0"""
CHECKS["trained_softmax"] = f"""{MAIL_SRC}, {FITTED}, {model_scores('m_learn')} SELECT mail_id, code AS label_code, {ROUNDED},
    CAST(CASE WHEN ham >= spam AND ham >= phish THEN 0 WHEN spam >= phish THEN 1 ELSE 2 END AS INT) AS prediction
FROM m_rest JOIN m_scores USING (mail_id)"""
CHECKS["softmax_importance"] = f"""{MAIL_SRC}, {FITTED}, m_sizes AS (SELECT feature, abs(w0) + abs(w1) + abs(w2) AS importance
    FROM m_w{STEPS} WHERE feature <> 'intercept')
SELECT feature, round(importance, 4) AS importance FROM m_sizes WHERE importance > 0 ORDER BY m_sizes.importance DESC, feature LIMIT 200"""
_model_live = f"""{risk_base(MAIL_SRC, "''", 'm_train')}{ADDITIVE_RISK},
m_serve AS ({long_form(f"SELECT mail_id, {select(serve_columns())} FROM ready", _numbers)} UNION ALL SELECT * FROM m_known),
{model_scores('m_serve')}, scored AS (SELECT * FROM risk JOIN m_scores USING (mail_id)){TOP}{DECIDED}"""
# The model has to stand before what reads it.
CHECKS["scored_by_model"] = CHECKS["scored_by_saved_model"] = f"""{MAIL_SRC}, {FITTED}, {_model_live.removeprefix(MAIL_SRC + ', ')}
SELECT mail_id, {ROUNDED}, round(least(0.99::DOUBLE, best), 4) AS model_confidence, predicted_label, risk_score,
    {SEVERITY} AS severity, category FROM sorted"""

# --- the store --------------------------------------------------------------

STORED = f"""{LIVE}, stored AS (SELECT mail_id AS email_id, '<' || mail_id || '@pages.example.org>' AS message_id, o.sender AS from_email,
    't' || (mail_id % 41) || '@example.org' AS to_email, c.subject, dom AS domain, predicted_label,
    round(ham, 4) AS ham_score, round(spam, 4) AS spam_score, round(phish, 4) AS phishing_score,
    least(0.99::DOUBLE, best) AS confidence, {s(fx.MODEL_NAME)} AS model_version, risk_score, {SEVERITY} AS severity,
    level AS domain_risk_level, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(mail_id) AS classified_at, n AS factors
    FROM sorted o JOIN cleaned c USING (mail_id))"""
CHECKS["stream_store"] = f"""{STORED} SELECT * REPLACE (round(confidence, 4) AS confidence, CAST(factors AS BIGINT) AS factors),
    classified_at - INTERVAL 5 MINUTE AS sent_at, CASE WHEN factors > 0 THEN classified_at END AS detected_at FROM stored"""
_shape = shape("'x@' || domain")
CHECKS["stream_store_domains"] = f"""{STORED}, counts AS (SELECT domain, {COUNTS}, CAST(sum(risk_score) AS BIGINT) AS risk_total,
    min(classified_at) AS first_seen, max(classified_at) AS last_seen FROM stored WHERE domain <> '' GROUP BY domain),
named AS (SELECT *, domain AS sender_domain FROM counts)
SELECT domain, total_emails, ham_count, spam_count, phishing_count, {LEVEL} AS risk_level, {_shape['risk_score']} AS risk_score,
    risk_total / total_emails AS avg_risk_score, {_shape['is_free_provider']} AS is_free_provider,
    contains({_shape['reasons']}, 'high_risk_tld') AS has_suspicious_tld, {_shape['reasons']} AS risk_reasons, first_seen, last_seen FROM named"""
CHECKS["stream_store_campaigns"] = f"""{STORED}, counted AS (SELECT *, count(*) FILTER (WHERE {BAD}) OVER (PARTITION BY domain
    ORDER BY classified_at RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS similar_emails FROM stored WHERE domain <> '')
SELECT 'Campaign-' || domain || '-' || strftime(min(classified_at), '%Y%m%d') AS campaign_name, domain,
    'coordinated_attack' AS attack_type, 'active' AS status, 'critical' AS severity,
    arg_max(similar_emails, classified_at) AS email_count, min(classified_at) AS first_detected, max(classified_at) AS last_detected
FROM counted WHERE similar_emails >= 15 GROUP BY domain"""


def stored_rollup(unit: str, name: str) -> str:
    return f"""SELECT date_trunc('{unit}', classified_at)::TIMESTAMP AS metric_date, '{name}' AS time_window, {COUNTS},
    count(*) FILTER (WHERE risk_score >= 35 AND risk_score < 60) AS high_risk_count, count(*) FILTER (WHERE risk_score >= 60) AS critical_risk_count,
    round(avg(risk_score), 6) AS avg_risk_score, round(avg(confidence), 6) AS avg_confidence, true AS was_timed FROM stored GROUP BY 1"""


CHECKS["stored_performance"] = f"{STORED} " + " UNION ALL ".join(
    stored_rollup(u, n) for u, n in (("hour", "hourly"), ("day", "daily"), ("week", "weekly"))
)
CHECKS["addressed_responses"] = f"""{LIVE} SELECT mail_id,
    CASE WHEN mail_id % 3 <> 0 THEN '<' || mail_id || '@pages.example.org>' ELSE CAST(mail_id AS VARCHAR) END AS message_id,
    CASE WHEN mail_id % 4 <> 0 THEN 'a@example.org,t' || mail_id || '@example.org' ELSE '' END AS to_email, predicted_label AS label FROM sorted"""

# --- files ------------------------------------------------------------------

CHECKS["mail_folders"] = CHECKS["stream_mail_folders"] = f"""{MAILS} SELECT mail_id, CASE WHEN label = 'ham' THEN 'ham' ELSE 'spam' END AS label,
    'spamassassin' AS source, md5(body || chr(10)) AS content_md5 FROM mail WHERE label IS NOT NULL"""
CHECKS["stream_mail_texts"] = f"{MAILS} SELECT DISTINCT md5(body || chr(10)) AS content_md5 FROM mail WHERE label IS NOT NULL"
CHECKS["csv_phishing"] = f"{MAILS} SELECT from_email, subject, body, 'phishing' AS label, 'nazario' AS source FROM mail"
CHECKS["top_terms_json"] = f"{vocabulary('body', 5000)} SELECT term, term_count FROM vocab ORDER BY term_count DESC, term LIMIT 200"
_manifest = [*serve_columns(), *fx.REPUTATION_COLUMNS]
CHECKS["feature_manifest"] = f"""WITH body AS ({vocabulary('body', 5000)} SELECT term FROM vocab), subject AS ({vocabulary('subject', 1000)} SELECT term FROM vocab),
names AS (SELECT 1 AS block, 0 AS i, 'body_tfidf_' || term AS feature FROM body UNION ALL SELECT 2, 0, 'subject_tfidf_' || term FROM subject
    UNION ALL SELECT 3, unnest(range({len(_manifest)})), unnest([{', '.join(s(n) for n in _manifest)}]))
SELECT CAST(row_number() OVER (ORDER BY block, i, feature) - 1 AS INT) AS position, feature FROM names"""
