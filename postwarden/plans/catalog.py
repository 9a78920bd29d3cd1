"""The queries the driver can run: name -> (spark, folder of the given tables) -> DataFrame."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from postwarden.functions import fixed as fx
from postwarden.functions import senders as sd
from postwarden.functions import text as tx
from postwarden.functions import urls as ur
from postwarden.operators import alerts, campaigns, dataset, domains, evaluation, linear, links, model
from postwarden.operators import reports, reputation, vectors
from postwarden.operators.features import FEATURE_NAMES, html_measures, mail_features
from postwarden.plans import corpus, scoring, training
from postwarden.session import materialise, shared_dir
from postwarden.sources import mail_files, tables
from postwarden.sources.views import table, view
from postwarden.streaming import jobs

AS_OF = "2024-01-31 00:00:00"
DAY = 86_400
SUFFIXES = ["com", "org", "net", "co.uk", "xyz", "ru", "top"]

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _log(spark, d):
    return view(spark, d, "mail_log")


def _mail(spark, d):
    return view(spark, d, "mail")


def _links(spark, d):
    return view(spark, d, "link_mail")


def _labelled(spark, d):
    return _mail(spark, d).filter(F.col("label").isNotNull())


def _joined(column: str):
    return F.array_join(column, "|").alias(column)


# --- reports over the log ---------------------------------------------------


@query
def top_malicious_domains(spark, d):
    return domains.top_malicious_domains(domains.domain_risk(_log(spark, d))).select(
        "domain", "total_emails", "ham_count", "spam_count", "phishing_count", "risk_level"
    )


@query
def domain_risk(spark, d):
    return domains.domain_risk(_log(spark, d)).withColumn("risk_reasons", _joined("risk_reasons"))


@query
def merged_domain_counts(spark, d):
    log, cut = _log(spark, d), F.lit("2024-01-15").cast("timestamp_ntz")
    old = domains.domain_counts(log.filter(F.col("classified_at") < cut))
    new = domains.domain_counts(log.filter(F.col("classified_at") >= cut))
    return domains.merge_domain_counts(old, new)


@query
def label_shares(spark, d):
    return reports.label_shares(_log(spark, d))


@query
def label_stats(spark, d):
    return reports.label_stats(_log(spark, d), AS_OF, 48)


@query
def hourly_volume(spark, d):
    return reports.hourly_volume(_log(spark, d))


@query
def hourly_volume_recent(spark, d):
    return reports.hourly_volume(_log(spark, d), AS_OF, 48)


@query
def sender_profile(spark, d):
    return reports.sender_profile(_log(spark, d))


@query
def recent_threats(spark, d):
    return reports.recent_threats(_log(spark, d))


@query
def recent_mail(spark, d):
    return reports.recent_mail(_log(spark, d))


@query
def search_mail(spark, d):
    return reports.search_mail(_log(spark, d), "@d1_.ru", "spam", 40)


@query
def severity_counts(spark, d):
    return _log(spark, d).groupBy(reports.severity(F.col("risk_score")).alias("severity")).agg(
        F.count(F.lit(1)).alias("mails"), F.min("risk_score").alias("lowest"),
        F.max("risk_score").alias("highest"),
    )


@query
def table_counts(spark, d):
    names = ["events", "documents", "pages", "labels"]
    return reports.table_counts({n: table(spark, d, n) for n in names})


@query
def performance_rollup(spark, d):
    return reports.performance_rollup(_log(spark, d), feedback=_feedback(spark, d)).drop(
        "avg_confidence", "avg_processing_time_ms", "true_negatives"
    )


def _feedback(spark, d):
    """Outcomes for every third mail: its real label is known to be ham or phishing."""
    return _log(spark, d).filter("email_id % 3 = 0").select(
        "message_id",
        F.when(F.col("email_id") % 5 == 0, "phishing").otherwise("ham").alias("true_label"),
    )


@query
def sender_history(spark, d):
    return jobs.sender_history(_log(spark, d))


@query
def unique_messages(spark, d):
    repeated = _log(spark, d).withColumn(
        "message_id", F.concat("from_email", F.lit("/"), "predicted_label")
    )
    return dataset.unique_messages(repeated)


# --- alerts and campaigns ---------------------------------------------------


@query
def volume_spikes(spark, d):
    return alerts.volume_spikes(_log(spark, d))


@query
def drift_alerts(spark, d):
    return alerts.drift_alerts(_log(spark, d), _feedback(spark, d), max_risk_shift=2.0).select(
        "metric_date", "total_emails", "avg_risk_score", "false_positive_rate",
        "risk_drift", "fpr_alert",
    )


@query
def new_malicious_domains(spark, d):
    since = F.lit("2024-01-01 00:10:00").cast("timestamp_ntz")
    known = _log(spark, d).filter(F.col("domain").like("%.org")).select("domain").distinct()
    return domains.new_malicious_domains(_log(spark, d), since, known).select(
        "domain", "risk_level", "first_seen"
    )


@query
def trailing_bad_counts(spark, d):
    return campaigns.trailing_bad_counts(_log(spark, d), DAY).select(
        "email_id", "domain", "similar_emails"
    )


@query
def trailing_bad_counts_ten_minutes(spark, d):
    return campaigns.trailing_bad_counts(_log(spark, d), 600).select(
        "email_id", "domain", "similar_emails"
    )


@query
def campaign_alerts(spark, d):
    return campaigns.campaign_alerts(_log(spark, d), DAY).select(
        "email_id", "domain", "predicted_label", "similar_emails"
    )


@query
def active_campaigns(spark, d):
    return campaigns.active_campaigns(campaigns.detect_campaigns(_log(spark, d), DAY))


@query
def campaign_profile(spark, d):
    profile = campaigns.campaign_profile(view(spark, d, "campaign_log"), DAY)
    return profile.withColumn("common_keywords", _joined("common_keywords"))


# --- text -------------------------------------------------------------------


@query
def clean_text_tags_first(spark, d):
    return table(spark, d, "pages").select("page_id", tx.clean_text("html").alias("text"))


@query
def clean_text_entities_first(spark, d):
    return table(spark, d, "pages").select(
        "page_id", tx.clean_text("html", "entities_first").alias("text")
    )


@query
def page_text(spark, d):
    return table(spark, d, "pages").select("page_id", tx.html_to_text("html").alias("text"))


@query
def unescaped_pages(spark, d):
    return table(spark, d, "pages").select("page_id", tx.unescape_html("html").alias("text"))


@query
def unescaped_pages_full(spark, d):
    """The whole table of names, which is what the default decodes."""
    return table(spark, d, "pages").select("page_id", tx.unescape_html(F.col("html")).alias("text"))


@query
def safe_text(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.safe_text("text").alias("text"))


@query
def text_statistics(spark, d):
    rows = table(spark, d, "documents").select(
        "doc_id", "text", tx.squeeze("text").alias("squeezed")
    )
    stats = tx.text_stats("text", "squeezed", "body", fx.ASCII_PUNCT)
    return rows.select(
        "doc_id", *[c.alias(n) for n, c in stats.items()],
        tx.upper_words("text").alias("upper_words"),
        tx.shouted_words("squeezed").alias("shouted_words"),
    )


@query
def keyword_groups(spark, d):
    low = F.lower(F.concat_ws(" ", "body", "subject"))
    rows = _links(spark, d).select("mail_id", low.alias("low"))
    found = [
        tx.keywords_present("low", words).alias(f"{group}_{kind}")
        for group, lists in (("compact", fx.COMPACT_WORDS), ("extended", fx.EXTENDED_WORDS))
        for kind, words in lists.items()
    ]
    return rows.select("mail_id", *found)


@query
def html_statistics(spark, d):
    rows = table(spark, d, "pages")
    out = [
        c.alias(f"{profile}_{n}")
        for profile in ("train", "serve") for n, c in html_measures("html", profile).items()
    ]
    return rows.select("page_id", *out)


@query
def redacted_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.redact_pii("text").alias("text"))


@query
def semantic_scores(spark, d):
    text = F.concat_ws(" ", "body", "subject")
    return _links(spark, d).select(
        "mail_id", F.round(tx.semantic_score(text), 6).alias("score"),
        F.round(tx.semantic_score(text, keyed=True), 6).alias("keyed_score"),
    )


@query
def label_codes(spark, d):
    good, bad = dataset.normalise_labels(_mail(spark, d))
    return good.select("mail_id", "label", "label_code").unionByName(
        bad.select("mail_id", "label", F.lit(None).cast("int").alias("label_code"))
    )


@query
def sender_addresses(spark, d):
    address = sd.clean_address("from_email")
    return _links(spark, d).select(
        "mail_id", address.alias("address"), sd.address_domain(address).alias("domain"),
        sd.second_domain(F.concat("from_email", F.lit("@Last.Part"))).alias("second_domain"),
    )


def _features(name: str, source: str, profile: str):
    def run(spark, d):
        return mail_features(view(spark, d, source), profile)

    run.__name__ = name
    QUERIES[name] = run


for _profile in ("train", "serve", "compact"):
    _features(f"mail_features_{_profile}", "link_mail", _profile)
    _features(f"document_features_{_profile}", "mail", _profile)


# --- URLs and domains -------------------------------------------------------


@query
def extracted_urls(spark, d):
    return _links(spark, d).select(
        "mail_id",
        F.array_join(ur.extract_urls("body", "train"), " ").alias("train_urls"),
        F.array_join(ur.extract_urls("body", "serve"), " ").alias("serve_urls"),
        F.array_join(ur.extract_urls("body", "strict"), " ").alias("strict_urls"),
        F.array_join(ur.find_urls("body"), " ").alias("normalised_urls"),
    )


@query
def url_flags(spark, d):
    u = F.col("url")
    urls = links.mail_links(_links(spark, d))
    return urls.select(
        "mail_id", "position", "url",
        tx.flag(ur.is_shortened(u)).alias("shortened"),
        tx.flag(ur.has_train_tld(u)).alias("train_tld"),
        tx.flag(ur.ends_with_tld(u, fx.SERVE_URL_TLDS)).alias("serve_tld"),
        tx.flag(u.rlike(fx.IP_URL_TRAIN)).alias("has_ip"),
        tx.flag(ur.query_longer_than(u, 30, True)).alias("long_query"),
        ur.url_host(u).alias("host"), ur.url_path(u).alias("path"),
    )


@query
def link_report(spark, d):
    report = links.analyze_links(_links(spark, d))
    return report.select(
        "mail_id", "url_count", "high_risk_urls", "risk_level",
        F.array_join(F.transform("urls", lambda x: F.concat_ws(
            ",", x["is_https"].cast("int"), x["has_ip"].cast("int"), x["suspicious_tld"].cast("int"),
            x["is_shortened"].cast("int"), x["has_hex_encoding"].cast("int"), x["length"],
        )), ";").alias("findings"),
    )


@query
def url_entropy(spark, d):
    return table(spark, d, "pages").select(
        "page_id", F.round(ur.shannon_entropy("url"), 6).alias("entropy")
    )


def _suffixes(spark):
    return spark.createDataFrame([(s,) for s in SUFFIXES], "suffix string")


@query
def url_threat(spark, d):
    urls = links.mail_links(_links(spark, d))
    scored = links.url_threat(urls, _suffixes(spark))
    return scored.withColumn("path_entropy", F.round("path_entropy", 6)).withColumn(
        "threat_score", F.round("threat_score", 6)
    )


@query
def mail_url_threat(spark, d):
    worst = links.max_url_threat(_links(spark, d), _suffixes(spark))
    return worst.select(
        "mail_id", F.round("max_threat_score", 6).alias("max_threat_score"), "link_count"
    )


@query
def domain_patterns(spark, d):
    r = sd.domain_pattern_risk("from_email")
    return _links(spark, d).select("mail_id", "from_email", r.alias("r")).select(
        "mail_id", "r.risk_level", "r.risk_score", F.array_join("r.reasons", "|").alias("reasons"),
        "r.is_free_provider", "r.domain",
    )


@query
def domain_infrastructure(spark, d):
    """Facts are derived per host from the pages: some hosts have none."""
    hosts = table(spark, d, "pages").select(ur.url_host("url").alias("domain"), "page_id")
    per_host = hosts.groupBy("domain").agg(F.min("page_id").alias("k"))
    facts = per_host.filter("k % 7 <> 3").select(
        "domain",
        F.when(F.col("k") % 5 != 0, F.date_add(F.lit("2022-06-01").cast("date"), (F.col("k") * 13 % 600).cast("int"))).alias("created"),
        (F.col("k") % 2 == 0).alias("has_mx"), (F.col("k") % 3 != 0).alias("has_a"),
        (F.col("k") % 11 != 0).alias("has_ns"),
        F.when(F.col("k") % 4 != 0, F.lit("2023-12-01").cast("date")).alias("tls_not_before"),
    )
    scored = domains.domain_infra_risk(hosts, facts, "2024-01-31")
    return scored.withColumn("score", F.round("score", 6))


# --- risk and decision ------------------------------------------------------


RISK_COLUMNS = [
    "mail_id", "risk_score", "severity", "threat_type", "phishing_indicators", "spam_indicators",
]


def _risk(spark, d, profile):
    rep = reputation.sender_reputation(_labelled_links(spark, d))
    return scoring.risk_frame(_links(spark, d), rep, profile)


def _labelled_links(spark, d):
    """Some link mails with known outcomes, so that some senders are known."""
    return _links(spark, d).filter("mail_id % 6 IN (0, 2, 3)").withColumn(
        "label", F.when(F.col("mail_id") % 6 == 0, "phishing").otherwise("ham")
    )


def _risk_rows(df):
    return df.select(
        *RISK_COLUMNS,
        F.array_join(F.transform("risk_factors", lambda f: F.concat_ws(
            ":", f["type"], f["weight"], F.coalesce(f["value"], F.lit("-")), f["description"]
        )), "|").alias("factors"),
    )


@query
def risk_additive(spark, d):
    return _risk_rows(_risk(spark, d, "additive"))


@query
def risk_threat_typed(spark, d):
    return _risk_rows(_risk(spark, d, "threat_typed"))


def _hashed_scorer(df):
    """Class scores spread by id, in place of a model."""
    k = F.col("mail_id")
    return df.select(
        "*", (k % 11 / 20.0).alias("ham_score"), (k % 7 / 20.0).alias("spam_score"),
        (k % 5 / 20.0).alias("phishing_score"),
    )


def _decide(name, risk_profile, decision):
    def run(spark, d):
        rep = reputation.sender_reputation(_labelled_links(spark, d))
        scored = scoring.score_mail(
            _links(spark, d), rep, _hashed_scorer, risk_profile, decision
        )
        return scored.select(
            "mail_id", "risk_score", "predicted_label",
            F.round("model_confidence", 4).alias("confidence"), "category", "explanation",
        )

    run.__name__ = name
    QUERIES[name] = run


_decide("decision_live", "additive", "live")
_decide("decision_override", "threat_typed", "override")
_decide("decision_model_first", "threat_typed", "model_first")


@query
def risk_factors(spark, d):
    return scoring.factor_rows(_risk(spark, d, "additive"))


@query
def score_responses(spark, d):
    """Fields read back from the nested answers."""
    rep = reputation.sender_reputation(_labelled_links(spark, d))
    scored = scoring.score_mail(_links(spark, d), rep, _hashed_scorer)

    def field(path: str, kind: str = "string"):
        return F.get_json_object("response", f"$.{path}").cast(kind)

    return scoring.responses(scored).select(
        "mail_id", field("message_id").alias("message_id"), field("from_email").alias("from_email"),
        field("predicted.predicted_label").alias("label"),
        field("predicted.model_confidence", "double").alias("confidence"),
        field("risk_analysis.risk_score", "int").alias("risk_score"),
        field("risk_analysis.domain_reputation.domain").alias("domain"),
        field("metadata.spam_keyword_count", "int").alias("spam_keyword_count"),
        field("reputation.sender_is_known", "int").alias("sender_is_known"),
        field("reasons[0].type").alias("first_reason"),
    )


@query
def risk_summaries(spark, d):
    rep = reputation.sender_reputation(_labelled_links(spark, d))
    return scoring.risk_summary(scoring.score_mail(_links(spark, d), rep, _hashed_scorer))


# --- reputation -------------------------------------------------------------


@query
def sender_reputation(spark, d):
    return reputation.sender_reputation(_mail(spark, d))


@query
def sender_reputation_raw_key(spark, d):
    return reputation.sender_reputation(_mail(spark, d), normalise="raw")


@query
def sender_reputation_bad_share(spark, d):
    return reputation.sender_reputation(_mail(spark, d), "bad_share")


@query
def sender_label_distribution(spark, d):
    return reputation.label_distribution(_mail(spark, d))


@query
def mail_with_reputation(spark, d):
    mail = _mail(spark, d)
    rep = reputation.sender_reputation(mail.filter("source <> 'src1'"))
    return reputation.with_sender_reputation(mail, rep).select(
        "mail_id", "from_email_norm", *fx.REPUTATION_COLUMNS
    )


@query
def mail_with_neutral_reputation(spark, d):
    mail = _mail(spark, d)
    rep = reputation.sender_reputation(mail.filter("source <> 'src1'"), "bad_share")
    return reputation.with_sender_reputation(mail, rep, 0.5, hot_share=None).select(
        "mail_id", "from_email_norm", *fx.REPUTATION_COLUMNS
    )


@query
def joined_feature_blocks(spark, d):
    mail = _labelled(spark, d)
    features = mail_features(mail, "train").select("mail_id", "body_word_count", "spam_keyword_count")
    rep = reputation.sender_reputation(mail)
    known = reputation.with_sender_reputation(mail, rep).select("mail_id", "sender_email_count")
    codes = mail.select("mail_id", tx.label_code("label").alias("label_code"))
    return model.join_blocks(features, known, codes)


# --- corpus -----------------------------------------------------------------


@query
def deduplicated_mail(spark, d):
    return dataset.dedupe_mail(_mail(spark, d), ids_unique=True).select("mail_id", "subject", "label")


@query
def corpus_union(spark, d):
    mail = _mail(spark, d)
    parts = [mail.filter(F.col("label") == x) for x in fx.LABELS]
    return dataset.min_length(dataset.union_corpora(*parts)).select("mail_id", "label", "source")


@query
def built_corpus(spark, d):
    mail = _labelled(spark, d)
    parts = [mail.filter(F.col("label") == x) for x in fx.LABELS]
    return corpus.build_corpus(*parts).select("mail_id", "label", "split")


@query
def split_sizes(spark, d):
    return dataset.split_mail(_mail(spark, d)).groupBy("split").agg(
        F.count(F.lit(1)).alias("mails"), F.min("mail_id").alias("first_id")
    )


@query
def stratified_holdout(spark, d):
    return dataset.stratified_holdout(_labelled(spark, d)).select("mail_id", "label", "is_holdout")


@query
def oversampled_corpus(spark, d):
    return dataset.oversample(_labelled(spark, d), 0.4).select("mail_id", "label", "copy")


@query
def class_weights(spark, d):
    return dataset.class_weights(_mail(spark, d))


@query
def label_encoding(spark, d):
    return dataset.label_encoding(_mail(spark, d))


@query
def parsed_mail(spark, d):
    """Documents written out as MIME messages, then decoded."""
    head = F.concat(
        F.lit("From: "), "source", F.lit("@example.com\nSubject: "), F.col("doc_id").cast("string"),
        F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"),
    )
    files = table(spark, d, "documents").select(
        F.concat(F.lit("/mail/ham/"), F.col("doc_id")).alias("path"),
        F.encode(F.concat(head, "text"), "UTF-8").alias("content"),
    )
    return mail_files.parse_mail(files).select("path", "from_email", "subject", "body", "error")


@query
def csv_mail(spark, d):
    """Documents written as CSV with 0/1 labels and read back as mail."""
    path = shared_dir(spark, "csv-mail")
    rows = _labelled(spark, d).select(
        F.col("from_email").alias("sender"), "subject", "body",
        (F.col("label") != "ham").cast("int").alias("label"),
    )
    tables.write_csv(rows, path)
    read = mail_files.read_csv_mail(spark, path, source="csv")
    return read.select("from_email", "subject", "body", "label", "source")


@query
def indexed_files(spark, d):
    """An index file written from the labels, read back and matched with the documents."""
    path = shared_dir(spark, "trec-index")
    lines = _labelled(spark, d).select(F.concat(
        F.when(F.col("label") == "spam", "SPAM").otherwise("ham"), F.lit(" ../data/inmail."),
        F.col("mail_id").cast("string"),
    ).alias("value"))
    lines.write.text(path)
    index = mail_files.read_trec_index(spark, path)
    files = table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("inmail."), F.col("doc_id")).alias("file_name")
    )
    return files.join(index, "file_name").select("doc_id", "file_name", "label")


def _mail_folders(spark, d):
    """The mails with a label as files of their own, in folders that are named for the label and the mail."""
    path = shared_dir(spark, "mail-folders")
    named = F.concat(F.when(F.col("label") == "ham", "ham").otherwise("spam"), F.lit("-"), "mail_id")
    mail_files.write_mail_dirs(_labelled(spark, d).select(named.alias("box"), F.col("body").alias("value")), path)
    return path


#: The streams over the folders take about so many files a batch at least, and so many batches at most.
FILES_PER_BATCH, BATCHES = 200, 4


def _mail_stream(spark, d):
    """The folders as a stream of several batches, whose number does not grow with the mails: each has a price of its own."""
    files = _labelled(spark, d).count()
    return mail_files.read_mail_dirs(
        spark, _mail_folders(spark, d), stream=True, files_per_batch=max(FILES_PER_BATCH, -(-files // BATCHES)), by_folder=True
    )


def _box_rows(files):
    box = F.element_at(F.split("path", "/"), -2)
    return files.select(
        F.element_at(F.split(box, "-"), -1).cast("bigint").alias("mail_id"), "label", "source",
        F.md5("content").alias("content_md5"),
    )


@query
def mail_folders(spark, d):
    return _box_rows(mail_files.read_mail_dirs(spark, _mail_folders(spark, d)))


@query
def stream_mail_folders(spark, d):
    """The folders as a stream of several batches."""
    home = jobs.new_home(spark, "folders")
    jobs.drain(jobs.append_job(_box_rows(_mail_stream(spark, d)), home))
    return spark.read.parquet(os.path.join(home, "rows"))


@query
def stream_mail_texts(spark, d):
    """The different texts among the files of a stream, each once over all batches."""
    home = jobs.new_home(spark, "texts")
    files = mail_files.without_repeats(_mail_stream(spark, d))
    jobs.drain(jobs.append_job(_box_rows(files).select("content_md5"), home))
    return spark.read.parquet(os.path.join(home, "rows"))


@query
def csv_phishing(spark, d):
    """A file without labels, whose mails all have the label that is given."""
    path = shared_dir(spark, "csv-phishing")
    rows = _mail(spark, d).select(F.col("from_email").alias("sender"), "subject", "body")
    tables.write_csv(rows, path)
    return mail_files.read_csv_mail(spark, path, label="phishing", source="nazario")


@query
def top_terms_json(spark, d):
    """The most frequent terms, written as JSON lines and read back."""
    path = shared_dir(spark, "top-terms")
    tables.write_top_json(vectors.fit_tfidf(_mail(spark, d), "body", 5000).select("term", "term_count"), path, "term_count")
    return spark.read.schema("term string, term_count bigint").json(path)


@query
def feature_manifest(spark, d):
    """Feature names in order, written and read back."""
    path, mail = shared_dir(spark, "manifest"), _mail(spark, d)
    names = vectors.feature_manifest(
        vectors.fit_tfidf(mail, "body", 5000), vectors.fit_tfidf(mail, "subject", 1000), FEATURE_NAMES
    )
    tables.write_manifest(spark, names, path)
    return spark.createDataFrame(list(enumerate(tables.read_manifest(spark, path))), "position int, feature string")


@query
def parquet_round_trip(spark, d):
    path = shared_dir(spark, "splits")
    tables.write_parquet(dataset.split_mail(_mail(spark, d)).select("mail_id", "label", "split"), path, ["split"])
    schema = "mail_id bigint, label string, split string"
    train = tables.read_or_empty(spark, path, schema).filter("split = 'train'")
    missing = tables.read_or_empty(spark, path + "-absent", schema)
    return train.unionByName(missing)


# --- vectors and models -----------------------------------------------------


@query
def tfidf_vocabulary(spark, d):
    vocab = vectors.fit_tfidf(_mail(spark, d), "body", 5000)
    return vocab.withColumn("idf", F.round("idf", 6))


@query
def tfidf_subject_unigrams(spark, d):
    vocab = vectors.fit_tfidf(
        _mail(spark, d), "subject", 1000, bigrams=False, min_df=3, max_df=0.95
    )
    return vocab.withColumn("idf", F.round("idf", 6))


@query
def tfidf_weights(spark, d):
    mail = _mail(spark, d)
    vocab = vectors.fit_tfidf(mail, "body", 5000)
    return vectors.tfidf(mail, vocab, "body").withColumn("weight", F.round("weight", 6))


@query
def tfidf_vector_norms(spark, d):
    from pyspark.ml.functions import vector_to_array

    mail = _mail(spark, d)
    vocab = vectors.fit_tfidf(mail, "body", 5000)
    out = vectors.tfidf_vectors(mail, vocab, "body").select(
        "mail_id", vector_to_array("features").alias("a")
    )
    return out.select(
        "mail_id", F.size(F.filter("a", lambda x: x > 0)).alias("terms"),
        F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + x * x), 4).alias("squares"),
    )


def _predictions(spark, d, algorithm, **options):
    rows = dataset.split_mail(_labelled(spark, d))
    return training.train_and_predict(
        rows.filter("split = 'train'"), rows.filter("split <> 'train'"), algorithm, **options
    )


@query
def trained_logistic(spark, d):
    return _predictions(spark, d, "logistic")


@query
def trained_forest(spark, d):
    return _predictions(spark, d, "forest")


@query
def trained_boosted(spark, d):
    val = dataset.split_mail(_labelled(spark, d)).filter("split = 'val'")
    return _predictions(spark, d, "boosted", validation=val)


#: Gradient steps of the registered linear models.
STEPS = 40


def _linear(spark, d):
    """What is learnt from the labelled mails of the train split: feature space, linear model, spreads of the numbers."""
    rows = dataset.split_mail(_labelled(spark, d)).filter("split = 'train'")
    space = training.fit_feature_space(rows)
    return space, *training.fit_linear(rows, space, STEPS)


def _scores(*more):
    return [F.round(c, 4).alias(c) for c in (*linear.SCORES, *more)]


@query
def stacked_coordinates(spark, d):
    """The stacked vectors of all mails, as rows, in the space of the train split."""
    rows = dataset.split_mail(_labelled(spark, d)).filter("split = 'train'")
    space = training.fit_feature_space(rows)
    mail = training.sparse_rows(_mail(spark, d), space)
    return training.coordinates(mail, space.names).withColumn("value", F.round("value", 6))


@query
def trained_softmax(spark, d):
    space, fitted, _ = _linear(spark, d)
    rest = dataset.split_mail(_labelled(spark, d)).filter("split <> 'train'")
    keep = ["mail_id", "label_code"]
    scored = training.linear_scores(training.sparse_rows(training.labelled(rest), space, keep=keep), fitted, keep)
    return scored.select(*keep, *_scores(), model.predicted_code().alias("prediction"))


@query
def softmax_importance(spark, d):
    space, fitted, spreads = _linear(spark, d)
    return linear.importance(fitted, spreads, spark).withColumn("importance", F.round("importance", 4))


def _scored_mails(mail, space, fitted):
    scored = scoring.score_mail(mail, space.reputation, scoring.ModelScorer(fitted, space))
    return scored.select(
        "mail_id", *_scores("model_confidence"), "predicted_label", "risk_score", "severity", "category"
    )


@query
def scored_by_model(spark, d):
    """Every mail scored by the fitted model: features, reputation, risk, decision."""
    space, fitted, _ = _linear(spark, d)
    return _scored_mails(_mail(spark, d), space, fitted)


@query
def scored_by_saved_model(spark, d):
    """The same by a model that was published, and loaded by another session."""
    space, fitted, _ = _linear(spark, d)
    root = shared_dir(spark, "models")
    training.save_model(space, fitted, root)
    loaded = training.load_model(spark.newSession(), root)
    found = _scored_mails(_mail(loaded[0].reputation.sparkSession, d), *loaded)
    path = shared_dir(spark, "saved-scores")
    found.write.parquet(path)
    return spark.read.parquet(path)


@query
def scored_by_forest(spark, d):
    """Every mail scored by a fitted forest, whose vectors are made beside the serve features."""
    rows = dataset.split_mail(_labelled(spark, d)).filter("split = 'train'")
    space = training.fit_feature_space(rows)
    learnt = materialise(training.feature_vectors(training.labelled(rows), space, keep=["mail_id", "label_code"]), "training")
    fitted = model.fit_classifier(training.dealt_for_trees(learnt, len(space.names)), "forest")
    scored = scoring.score_mail(_mail(spark, d), space.reputation, scoring.VectorScorer(fitted, space))
    return scored.select("mail_id", *_scores("model_confidence"), "predicted_label", "risk_score", "category")


@query
def forest_importance(spark, d):
    mail = training.labelled(_mail(spark, d))
    columns = [c for c in mail_features(mail, "train").columns if c != "mail_id"]
    rows = model.assemble(mail_features(mail, "train", ["mail_id", "label_code"]), columns)
    fitted = model.fit_classifier(
        materialise(rows.select("label_code", "features"), "importance"), "forest"
    )
    return model.feature_importance(spark, fitted, columns)


def _rule_predictions(spark, d):
    """A keyword rule as classifier, to have predictions next to labels."""
    code = tx.label_code("label")
    guess = F.when(F.length("body") % 4 == 0, 1).when(F.length("body") % 9 == 0, 2).otherwise(0)
    return _labelled(spark, d).select("mail_id", code.alias("label"), guess.alias("prediction"))


@query
def confusion_counts(spark, d):
    return evaluation.confusion_counts(_rule_predictions(spark, d))


@query
def class_report(spark, d):
    report = evaluation.class_report(_rule_predictions(spark, d)).drop("correct")
    return report.withColumnRenamed("class", "label_code")


@query
def model_quality(spark, d):
    q = evaluation.evaluate(_rule_predictions(spark, d))
    return q.withColumn("f1_weighted", F.round("f1_weighted", 6))


# --- streams over the log ---------------------------------------------------


LOG_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
    "props string"
)


def _log_stream(spark, d):
    from postwarden.sources.views import MAIL_LOG

    events = jobs.log_stream(spark, d, LOG_SCHEMA, "events.parquet")
    return spark.sql(MAIL_LOG.replace("FROM events", "FROM {events}"), events=events)


@query
def stream_hourly_volume(spark, d):
    home = jobs.new_home(spark, "volume")
    jobs.drain(jobs.upsert_job(jobs.hourly_volume_stream(_log_stream(spark, d)), home))
    return jobs.latest_rows(spark, home, ["hour", "predicted_label"])


@query
def stream_domain_risk(spark, d):
    home = jobs.new_home(spark, "domains")
    jobs.drain(jobs.domain_job(_log_stream(spark, d), home))
    graded = jobs.stored_domains(spark, home)
    return graded.withColumn("risk_reasons", _joined("risk_reasons"))


@query
def stream_campaigns(spark, d):
    home = jobs.new_home(spark, "campaigns")
    jobs.drain(jobs.campaign_job(_log_stream(spark, d), home, DAY))
    return jobs.campaign_table(spark, home)


@query
def stream_unique_messages(spark, d):
    home = jobs.new_home(spark, "unique")
    jobs.drain(jobs.append_job(jobs.unique_message_stream(_log_stream(spark, d)), home))
    return spark.read.parquet(os.path.join(home, "rows"))


@query
def stream_sender_history(spark, d):
    home = jobs.new_home(spark, "history")
    jobs.drain(jobs.append_job(jobs.sender_history(_log_stream(spark, d)), home))
    return spark.read.parquet(os.path.join(home, "rows"))


def _stored(spark, d):
    """The link mails as a stream of three batches, scored and stored; gives the store's folder."""
    folder, home = shared_dir(spark, "mail-files"), jobs.new_home(spark, "store")
    mails = _links(spark, d).withColumns({
        "message_id": F.concat(F.lit("<"), F.col("mail_id"), F.lit("@pages.example.org>")),
        "to_email": F.array(F.concat(F.lit("t"), F.col("mail_id") % 41, F.lit("@example.org"))),
        "classified_at": F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(mail_id AS INT), 0)"),
    }).withColumn("sent_at", F.col("classified_at") - F.expr("INTERVAL 5 MINUTES"))
    mails.repartitionByRange(3, "mail_id").write.parquet(folder)
    rep = reputation.sender_reputation(_labelled_links(spark, d))
    keep = ["mail_id", "message_id", "to_email", "classified_at", "sent_at"]
    stream = jobs.log_stream(spark, folder, mails.schema, files_per_batch=1)
    jobs.drain(jobs.store_job(
        stream, home, lambda df: scoring.score_mail(df, rep, _hashed_scorer, keep=keep), window_seconds=DAY,
        lateness_seconds=366 * DAY,
    ))
    return home


@query
def stream_store(spark, d):
    """What three committed batches hold: whole mail rows with the number of their factors."""
    home = _stored(spark, d)
    mails, factors = jobs.stored(spark, home, "mails"), jobs.stored(spark, home, "factors")
    counts = factors.groupBy("mail_id").agg(F.count(F.lit(1)).alias("factors"), F.min("detected_at").alias("detected_at"))
    told = mails.join(counts, mails["email_id"] == counts["mail_id"], "left")
    return told.select(
        "email_id", "message_id", "from_email", F.array_join("to_email", ",").alias("to_email"), "subject", "domain",
        "predicted_label", *_scores("confidence"), "model_version", "risk_score", "severity", "domain_risk_level",
        "classified_at", "sent_at", F.coalesce("factors", F.lit(0)).alias("factors"), "detected_at",
    )


@query
def stream_store_domains(spark, d):
    return jobs.stored_domains(spark, _stored(spark, d)).withColumn("risk_reasons", _joined("risk_reasons"))


@query
def stream_store_campaigns(spark, d):
    return jobs.campaign_table(spark, _stored(spark, d))


@query
def stored_performance(spark, d):
    """The rollup with the confidence of stored mails."""
    mails = jobs.stored(spark, _stored(spark, d), "mails")
    rolled = reports.performance_rollup(mails, confidence="confidence", millis="processing_ms")
    return rolled.select(
        "metric_date", "time_window", "total_emails", "ham_count", "spam_count", "phishing_count", "high_risk_count",
        "critical_risk_count", F.round("avg_risk_score", 6).alias("avg_risk_score"),
        F.round("avg_confidence", 6).alias("avg_confidence"),
        (F.col("avg_processing_time_ms") >= 0).alias("was_timed"),
    )


@query
def addressed_responses(spark, d):
    """Answers with the message's own id and recipients, read back from their JSON."""
    mails = _links(spark, d).withColumns({
        "message_id": F.when(F.col("mail_id") % 3 != 0, F.concat(F.lit("<"), F.col("mail_id"), F.lit("@pages.example.org>"))),
        "to_email": F.when(F.col("mail_id") % 4 != 0, F.array(F.lit("a@example.org"), F.concat(F.lit("t"), F.col("mail_id"), F.lit("@example.org")))),
    })
    rep = reputation.sender_reputation(_labelled_links(spark, d))
    scored = scoring.score_mail(mails, rep, _hashed_scorer, keep=["mail_id", "message_id", "to_email"])
    answer = F.from_json("response", "message_id string, `to` array<string>, predicted struct<predicted_label:string>")
    return scoring.responses(scored).select("mail_id", answer.alias("a")).select(
        "mail_id", "a.message_id", F.array_join("a.to", ",").alias("to_email"), F.col("a.predicted.predicted_label").alias("label")
    )
