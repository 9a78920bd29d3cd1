"""Views that present the given tables as mail data.

The same SQL text runs in Spark and in other engines, so that an independent
check can start from identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOMAIN = (
    "concat('d', user_id % 20, CASE user_id % 4 WHEN 0 THEN '.xyz' WHEN 1 THEN '.com' "
    "WHEN 2 THEN '.ru' ELSE '.org' END)"
)

MAIL_LOG = f"""
SELECT event_id AS email_id, concat('m-', event_id) AS message_id,
       concat('u', user_id, '@', {DOMAIN}) AS from_email, {DOMAIN} AS domain,
       CASE event_type WHEN 'error' THEN 'phishing' WHEN 'signup' THEN 'spam' ELSE 'ham' END
         AS predicted_label,
       CAST(floor(value) AS INT) AS risk_score, ts AS classified_at
FROM events
"""

MAIL = """
SELECT d.doc_id AS mail_id, d.text AS body, substring(d.text, 1, 60) AS subject, d.source,
       concat('"', d.source, '" <', d.source, '@', d.lang, '.example.com>') AS from_email,
       CASE WHEN l.toxic = 1 THEN 'phishing' WHEN l.quality = 0 THEN 'spam'
            WHEN l.quality = 1 THEN 'ham' END AS label
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

# Mails about the crawled pages: every link, header and wording rule occurs.
LINK_MAIL = """
SELECT page_id AS mail_id,
       CASE page_id % 6 WHEN 0 THEN concat('security@d', page_id % 7, '-verify.ru')
            WHEN 1 THEN concat('"Prize Desk" <winner@lottery-', page_id % 1000, '.xyz>')
            WHEN 2 THEN 'news@letters.example.org' WHEN 3 THEN 'Friend@Gmail.com'
            WHEN 4 THEN 'no address' ELSE concat('info@a-b-c-d', page_id, '.example.com') END
         AS from_email,
       CASE page_id % 5 WHEN 0 THEN 'URGENT: verify your account'
            WHEN 1 THEN 'Special OFFER - save 30% off today!'
            WHEN 2 THEN 'Minutes of the meeting' WHEN 3 THEN 'BUY NOW and WIN $5,000,000!!!'
            ELSE concat('Re: page ', page_id) END AS subject,
       concat(CASE page_id % 7
                WHEN 0 THEN 'Your account has been suspended. Click here immediately to confirm your identity: '
                WHEN 1 THEN 'Dear Sir, your inheritance of $2,500,000 and 1000000 more expires soon, act now! '
                WHEN 2 THEN '<p>Hello &amp; welcome</p><img src="a.png"><script src="b.js"></script> '
                WHEN 3 THEN 'Limited time offer, 20% off, free bonus, claim your prize, winner! unsubscribe '
                WHEN 4 THEN 'Notes from Tuesday attached.  See ' WHEN 5 THEN 'urgent urgent urgent: update payment at '
                ELSE 'HELLO WORLD ÀÉÎÕ data:image/png;base64,AAAA ' END,
              url, ' ',
              CASE page_id % 4 WHEN 0 THEN concat('http://192.168.', page_id % 256, '.1/login?next=', url)
                   WHEN 1 THEN concat('https://bit.ly/', page_id)
                   WHEN 2 THEN concat('http://files.example.top/%41/setup-', page_id, '.exe.')
                   ELSE concat('www.portal', page_id % 9, '.example.xyz') END) AS body,
       CASE page_id % 3
            WHEN 0 THEN concat('Return-Path: <security@d', page_id % 7, '-verify.ru> Reply-To: a@b.org')
            WHEN 1 THEN 'Received: from x.example.org Reply-To: "N" <news@letters.example.org>' END
         AS raw_headers,
       url
FROM pages
"""

# The log with recipients and subjects, which campaign profiles need.
CAMPAIGN_LOG = f"""
SELECT event_id AS email_id, concat('u', user_id, '@', {DOMAIN}) AS from_email,
       {DOMAIN} AS domain,
       CASE event_type WHEN 'error' THEN 'phishing' WHEN 'signup' THEN 'spam' ELSE 'ham' END
         AS predicted_label,
       CAST(floor(value) AS INT) AS risk_score, ts AS classified_at,
       concat('t', event_id % 41, '@example.org') AS to_email,
       CASE event_id % 4 WHEN 0 THEN 'Urgent: verify account' WHEN 1 THEN 'You are a winner, claim the prize'
            WHEN 2 THEN 'Limited offer' ELSE 'Hello' END AS subject
FROM events
"""

TEXT_TABLES = {"documents", "pages"}
TABLES = {
    "mail_log": (MAIL_LOG, ["events"]),
    "mail": (MAIL, ["documents", "labels"]),
    "link_mail": (LINK_MAIL, ["pages"]),
    "campaign_log": (CAMPAIGN_LOG, ["events"]),
}


#: A session setting: how many partitions text tables are dealt to.  Unset, scans stay as they are; it is
#: meant for small files whose single row group cannot be split.
TEXT_PARTITIONS = "spark.postwarden.textPartitions"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One given table."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    partitions = spark.conf.get(TEXT_PARTITIONS, None) if name in TEXT_TABLES else None
    return df.repartition(int(partitions)) if partitions else df


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the views above over the parquet tables in ``folder``."""
    text, needs = TABLES[name]
    return spark.sql(
        _as_arguments(text, needs), args=None, **{t: table(spark, folder, t) for t in needs}
    )


def _as_arguments(text: str, needs: list[str]) -> str:
    for t in needs:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return text
