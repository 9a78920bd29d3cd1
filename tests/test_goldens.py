"""Published sample values and hand-worked edge rows."""

import html
import random
import string
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from postwarden.functions import fixed as fx
from postwarden.functions import senders as sd
from postwarden.functions import text as tx
from postwarden.functions import urls as ur
from postwarden.operators.features import FEATURE_NAMES, mail_features
from postwarden.operators.reputation import sender_reputation
from postwarden.plans import scoring

ROWS = [
    ("g_ham", "colleague@company.com", "Q4 Report Review",
     "Hi team, please review the attached Q4 financial report before tomorrow's meeting. "
     "Let me know if you have questions."),
    ("g_phish", "security@bank-verify.ru", "⚠️ Account Suspended - Verify Now",
     "Your account has been suspended. Click here to verify: http://192.168.1.1/bank"),
    ("g_lottery", "winner@lottery-prize.xyz", "🎉 CONGRATULATIONS! You WON $5,000,000",
     "CONGRATULATIONS! You are our GRAND PRIZE WINNER! Click here to claim..."),
]
SCHEMA = "mail_id string, from_email string, subject string, body string"
GOLDEN = {
    "g_ham": dict(
        body_text_length=117, body_word_count=19, body_avg_word_length=5.2105263157894735,
        body_uppercase_ratio=0.02564102564102564, body_digit_ratio=0.008547008547008548,
        body_special_char_ratio=0.03418803418803419, subject_text_length=16, subject_word_count=3,
        subject_avg_word_length=4.666666666666667, subject_uppercase_ratio=0.1875,
        subject_digit_ratio=0.0625, url_count=0, ip_in_url=0, url_length_avg=0.0,
        spam_keyword_count=0, spam_has_click_here=0, suspicious_sender=0,
    ),
    "g_phish": dict(
        body_text_length=78, body_word_count=10, body_avg_word_length=6.9,
        body_uppercase_ratio=0.02564102564102564, body_digit_ratio=0.10256410256410256,
        body_special_char_ratio=0.11538461538461539, subject_text_length=33, subject_word_count=6,
        subject_avg_word_length=4.666666666666667, subject_uppercase_ratio=0.12121212121212122,
        subject_digit_ratio=0.0, url_count=1, ip_in_url=1, url_length_avg=23.0,
        spam_keyword_count=5, spam_has_click_here=1, suspicious_sender=1,
    ),
}


@pytest.fixture(scope="module")
def mails(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def nobody(spark):
    return sender_reputation(spark.createDataFrame([], SCHEMA + ", label string"))


def test_serve_features(mails):
    got = {r["mail_id"]: r.asDict() for r in mail_features(mails, "serve").collect()}
    for mail, values in GOLDEN.items():
        assert {k: got[mail][k] for k in values} == values
    assert got["g_lottery"]["spam_keyword_count"] == 6
    assert got["g_lottery"]["spam_exclamation_count"] == 3
    assert round(got["g_lottery"]["subject_uppercase_ratio"], 4) == 0.5135


@pytest.mark.parametrize("profile,scores", [
    ("additive", {"g_ham": (0, "low"), "g_phish": (100, "critical"), "g_lottery": (60, "critical")}),
    ("threat_typed", {"g_ham": (0, "low"), "g_phish": (110, "critical"), "g_lottery": (70, "high")}),
])
def test_risk(mails, nobody, profile, scores):
    got = scoring.risk_frame(mails, nobody, profile).collect()
    assert {r["mail_id"]: (r["risk_score"], r["severity"]) for r in got} == scores


def test_domain_shape(mails):
    r = mails.select("mail_id", sd.domain_pattern_risk("from_email").alias("r")).collect()
    got = {x["mail_id"]: (x["r"]["risk_level"], x["r"]["risk_score"], x["r"]["reasons"]) for x in r}
    assert got["g_ham"] == ("low", 0, [])
    assert got["g_phish"] == ("high", 3, ["high_risk_tld"])


def test_sample_decision(mails, nobody):
    """The sample's scores: ham leads, yet risk 100 with phishing above 0.15 decides."""
    scorer = scoring.constant_scorer(0.663409948348999, 0.04986248537898064, 0.2867276072502136)
    row = scoring.score_mail(mails, nobody, scorer).filter("mail_id = 'g_phish'").first()
    assert (row["predicted_label"], row["category"]) == ("phishing", "phishing_critical")
    assert row["model_confidence"] == pytest.approx(0.663409948348999)
    row = scoring.score_mail(mails, nobody, scorer, "threat_typed", "override").filter(
        "mail_id = 'g_phish'"
    ).first()
    assert row["model_confidence"] == pytest.approx(0.95)
    assert row["explanation"].startswith("🚨 CRITICAL THREAT DETECTED (Risk Score: 110/100) - URL uses")


def test_bad_rows_do_not_fail_a_batch(spark, nobody):
    rows = [("a", None, None, None, None), ("b", "x@y.org", "s", "hello", None),
            ("c", "x@y.org", "s", "hello", "ValueError: broken")]
    df = spark.createDataFrame(rows, SCHEMA + ", error string")
    got = {r["mail_id"]: r for r in scoring.score_mail(
        df, nobody, scoring.constant_scorer(1, 0, 0)).collect()}
    assert got["a"]["error"] == "empty message" and got["a"]["predicted_label"] is None
    assert got["c"]["error"] == "ValueError: broken"
    assert got["b"]["error"] is None and got["b"]["predicted_label"] == "ham"


# --- edge rows against plain Python -----------------------------------------

TEXTS = [
    "", " ", "a b c", "ÀÉÎ ẞ ǅ x", "x² ③ ٣ 7", "HELLO World ABC1 Ab ÄÖÜX 1234",
    "expires expire EXPIRES", "tab\tnew\nline\r\n", "!!??", "αβγ ΔΕΖΗ", "fünf €5 ¥", "_A_ AB_ AB",
]


def test_text_statistics_match_python(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").select(
        "i", "t", tx.squeeze("t").alias("q")
    )
    stats = tx.text_stats("t", "q", "x", fx.ASCII_PUNCT)
    rows = df.select("t", *[c.alias(n) for n, c in stats.items()],
                     tx.shouted_words("q").alias("shouted")).collect()
    for r in rows:
        t = r["t"]
        words, n = t.split(), max(1, len(t))
        assert r["x_text_length"] == len(t), t
        assert r["x_word_count"] == len(words), t
        mean = sum(map(len, words)) / len(words) if words else 0
        assert r["x_avg_word_length"] == pytest.approx(mean), t
        assert r["x_uppercase_ratio"] == sum(c.isupper() for c in t) / n, t
        assert r["x_digit_ratio"] == sum(c.isdigit() for c in t) / n, t
        assert r["x_special_char_ratio"] == sum(c in string.punctuation for c in t) / n, t
        assert r["shouted"] == sum(len(w) > 3 and w.isupper() for w in words), t


def test_keyword_counts_overlap(spark):
    t = "it expires soon; limited time, suspended account. special offer"
    want = sum(t.count(k) for k in fx.SERVE_SPAM_KEYWORDS)
    df = spark.createDataFrame([(t,)], "t string")
    got = df.select(tx.keyword_occurrences("t", fx.SERVE_SPAM_KEYWORDS),
                    tx.keyword_occurrences(F.col("t"), fx.SERVE_SPAM_KEYWORDS)).first()
    assert list(got) == [want, want]


def test_entities(spark):
    texts = ["&lt;b&gt; &amp;lt; &quot;x&quot; &#39;", "cut &amp</b> &ampx; &amplt;", "a &amp;amp; b", "no refs", "&euro;5 &copy;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", tx.unescape_html("t").alias("n"), tx.unescape_html(F.col("t")).alias("f")).collect():
        assert r["n"] == r["f"] == html.unescape(r["t"])


def test_every_named_reference(spark):
    texts = [f"a&{n}b &{n}" for n in html5] + [f"&{n.rstrip(';')}x;&{n[:-1]}" for n in html5]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", tx.unescape_html("t").alias("n")).collect():
        assert r["n"] == html.unescape(r["t"]), r["t"]


def test_numeric_references(spark):
    codes = [*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000,
             0x1F600, 0x1FFFE, 0x10FFFD, 0x10FFFF, 0x110000, 9_999_999, 10**30]
    texts = [f"{a}{n}{b}" for n in codes for a, b in (("&#", ";"), ("&#000", "x"), ("x&#", ""))]
    texts += [f"&#{x}{n:x};&#{x}00{n:X}g" for n in codes for x in "xX"]
    texts += ["&#;", "&#x;", "&#xg", "&#", "&", "&&amp;&", "&#٣;", "&#0000000000000000065;", "&#x00000000041", "&# 65;", "&#-1;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", tx.unescape_html("t").alias("n")).collect():
        assert r["n"] == html.unescape(r["t"]), r["t"]


def test_generated_references(spark):
    rng = random.Random(8)
    names = [n.rstrip(";") for n in html5]
    pieces = ["&", ";", "#", "x", "&#", "&#x", "amp", "lt", "not", "notin", "copy", " ", "\n", "é", "=", "12", "41", "😀"]
    texts = ["".join(rng.choice(pieces if rng.random() < 0.7 else names) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    texts += ["&" + "a" * k + ";" for k in (30, 31, 32, 33, 40)] + ["&amp;" * 20_000, "&" * 20_000, None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", tx.unescape_html("t").alias("n")).collect():
        assert r["n"] == (None if r["t"] is None else html.unescape(r["t"])), r["t"]


def test_references_are_decoded_without_python(spark):
    """The tables of names are constants of the plan."""
    texts = spark.createDataFrame([("&lt;",)], "t string").select(tx.clean_text("t"), tx.safe_text("t"))
    plan = texts._jdf.queryExecution().optimizedPlan().toString()
    assert "EvalPython" not in plan and "from_json" not in plan


def test_cleaning_order_differs(spark):
    df = spark.createDataFrame([("<p>a &lt;b&gt; c</p>",)], "t string")
    got = df.select(tx.clean_text("t"), tx.clean_text("t", "entities_first")).first()
    assert list(got) == ["a <b> c", "a c"]


def test_page_text(spark):
    page = "<style>p{}</style><p>Hi &amp; bye<script>var t='</p>';</script><!-- x -->!</p>"
    df = spark.createDataFrame([(page,)], "t string")
    assert df.select(tx.html_to_text("t")).first()[0] == "Hi & bye !"


def test_redaction(spark):
    df = spark.createDataFrame([("mail a.b-c@x.org or 1234567, not 12345 or a1234567",)], "t string")
    assert df.select(tx.redact_pii("t")).first()[0] == (
        "mail [REDACTED_EMAIL] or [REDACTED_NUMBER], not 12345 or a1234567"
    )


@pytest.mark.parametrize("raw,want", [
    ('"Desk" <Help@X.org>', "help@x.org"), ("plain@x.org", "plain@x.org"),
    ("write to a@b.co now", "a@b.co"), ("  Nobody ", "nobody"), ("", ""), (None, ""),
    ("a@b@c.org", "b@c.org"),
])
def test_addresses(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(sd.clean_address("t")).first()[0] == want


def test_domain_variants(spark):
    df = spark.createDataFrame([("a@b.org@C.net",)], "t string")
    assert list(df.select(sd.address_domain("t"), sd.second_domain("t")).first()) == ["C.net", "b.org"]


def test_url_rules(spark):
    cases = {
        "http://at.co/x": 1, "https://bit.ly:8080/a": 1, "http://example.com/bit.ly": 0,
    }
    df = spark.createDataFrame(list(cases.items()), "u string, want int")
    for r in df.select("u", "want", tx.flag(ur.is_shortened("u")).alias("got")).collect():
        assert r["got"] == r["want"], r["u"]
    text = 'See (https://a.org/x), www.b.com; "http://c.net/?q=1"'
    urls = spark.createDataFrame([(text,)], "t string").select(ur.find_urls("t")).first()[0]
    assert urls == ["https://a.org/x", "http://www.b.com", "http://c.net/?q=1"]
    parts = spark.createDataFrame([("http://u:p@Host.ORG:81/a/b.exe?x#y",)], "u string")
    assert list(parts.select(ur.url_host("u"), ur.url_path("u")).first()) == ["host.org", "/a/b.exe"]


def test_percent_decoding_keeps_bad_escapes(spark):
    df = spark.createDataFrame([("a%41+%zz%",)], "u string")
    assert df.select(ur.percent_decoded("u")).first()[0] == "aA+%zz%"


def test_entropy(spark):
    df = spark.createDataFrame([("/a/b.exe",), ("",), ("aaaa",)], "u string")
    assert [r[0] for r in df.select(ur.shannon_entropy("u")).collect()] == [2.5, 0.0, 0.0]


def test_header_map_text(spark):
    df = spark.createDataFrame([({"Reply-To": 'a"b'},), ({},), (None,)], "h map<string,string>")
    assert [r[0] for r in df.select(tx.map_text("h")).collect()] == ['{"Reply-To": "a\\"b"}', "", ""]


def test_labels(spark):
    values = [" Ham\n", "phish", "1", "other", None]
    df = spark.createDataFrame([(v,) for v in values], "l string")
    assert [r[0] for r in df.select(tx.label_code("l")).collect()] == [0, 2, 1, None, None]


def test_profiles_share_columns(mails):
    for profile in ("train", "serve"):
        assert mail_features(mails, profile).columns == ["mail_id", *FEATURE_NAMES]
    assert len(FEATURE_NAMES) == 45


def test_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"a\xff\xc3\xa9"),), (None,)], "b binary")
    assert [r[0] for r in df.select(tx.bytes_to_text("b")).collect()] == ["aé", None]


def test_only_keywords_that_occur_are_replaced(spark):
    terms, texts = ["free", "e f", "%", "über", "it's"], ["free free", "100% über über it's", "", "none", None, "fre e f"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", tx.keyword_occurrences("t", terms).alias("n"))
    want = {t: None if t is None else sum(t.count(x) for x in terms) for t in texts}
    assert {r.t: r.n for r in out.collect()} == want
    plan = out._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("contains(") == plan.count("replace(") == len(terms)
