"""Mail folders, index files, CSV and the corpus job, on small generated files."""

import json

import pytest

from postwarden.plans.corpus import build_corpus
from postwarden.plans.training import train_and_predict
from postwarden.sources import mail_files, tables
from postwarden.sources.views import view

PLAIN = b"From: A <a@x.org>\nTo: b@y.org\nDate: Mon, 1 Jan 2024 00:00:00 +0000\nSubject: Hi &amp; bye\n\nplain  body\nof some length\n"
MULTI = (
    b"From: s@spam.xyz\nSubject: two\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=q\n\n"
    b"--q\nContent-Type: text/plain\n\npart one \n--q\nContent-Type: text/html\n\n"
    b"<style>x</style><p>html &eacute; part</p>\n--q\nContent-Type: text/plain\n\npart two\n--q--\n"
)
BROKEN = b"From: c@x.org\nSubject: odd\nContent-Type: text/plain; charset=none-such\n\nbytes \xff\xfe here\n"


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for folder, name, content in (
        ("easy_ham", "1.eml", PLAIN), ("spam_2", "2.eml", MULTI), ("ham_spam", "3.eml", BROKEN),
        ("other", "4.eml", PLAIN),
    ):
        (root / "set" / folder).mkdir(parents=True, exist_ok=True)
        (root / "set" / folder / name).write_bytes(content)
    return root


def test_mail_folders(spark, corpus):
    files = mail_files.read_mail_dirs(spark, str(corpus / "set"))
    got = {r["path"].rsplit("/", 1)[1]: r for r in mail_files.parse_mail(files).collect()}
    assert {k: v["label"] for k, v in got.items()} == {"1.eml": "ham", "2.eml": "spam", "3.eml": "ham"}
    assert got["1.eml"]["subject"] == "Hi & bye" and got["1.eml"]["body"] == "plain body of some length"
    assert got["1.eml"]["recipients"] == "b@y.org" and got["1.eml"]["source"] == "spamassassin"
    assert got["2.eml"]["body"] == "part one part two"
    assert got["3.eml"]["body"] == "" and got["3.eml"]["error"] is None


def test_first_html_policy(spark, corpus):
    files = mail_files.read_mail_dirs(spark, str(corpus / "set"))
    got = {r["path"].rsplit("/", 1)[1]: r["body"] for r in mail_files.parse_mail(files, "first_html").collect()}
    assert got["2.eml"] == "html é part"
    assert got["1.eml"] == "plain body of some length"


def test_undecodable_mail_keeps_its_row(spark):
    files = spark.createDataFrame([("p", None), ("q", bytearray(PLAIN))], "path string, content binary")
    got = {r["path"]: r for r in mail_files.parse_mail(files).collect()}
    assert got["p"]["error"] and got["p"]["from_email"] is None
    assert got["q"]["error"] is None


def test_index_and_files(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "inmail.1").write_bytes(PLAIN)
    (tmp_path / "data" / "inmail.9").write_bytes(PLAIN)
    (tmp_path / "index").write_text(
        "spam ../data/inmail.1\nHAM ../data/inmail.2\nbroken\nspam a b\n", encoding="utf-8")
    index = mail_files.read_trec_index(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, index.collect())) == [("ham", "inmail.2"), ("spam", "inmail.1")]
    trec = mail_files.read_trec(spark, str(tmp_path / "index"), str(tmp_path / "data"))
    rows = trec.collect()
    assert [(r["label"], r["path"].rsplit("/", 1)[1]) for r in rows] == [("spam", "inmail.1")]


def test_csv(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text(
        'sender,subject,body,label\na@x.org,"one, two","line 1\nline ""2""",1\nb@x.org,s,b,0\n,,no sender,1\n',
        encoding="utf-8")
    got = sorted(map(tuple, mail_files.read_csv_mail(spark, str(path), source="ceas08").collect()))
    assert got == [("a@x.org", "one, two", 'line 1\nline "2"', "spam", "ceas08"),
                   ("b@x.org", "s", "b", "ham", "ceas08")]
    fixed = mail_files.read_csv_mail(spark, str(path), label="phishing", source="nazario")
    assert {r["label"] for r in fixed.collect()} == {"phishing"}
    ids = mail_files.with_mail_id(fixed)
    assert ids.select("mail_id").distinct().count() == ids.count()


def test_corpus_job(spark, corpus):
    parsed = mail_files.parse_mail(mail_files.read_mail_dirs(spark, str(corpus / "set")))
    built = build_corpus(parsed, parsed, min_chars=5, dedupe_chars=10)
    assert built.count() == 2  # the undecodable one has no body left
    assert set(built.columns) == {"mail_id", "from_email", "subject", "body", "label", "source", "split"}


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, "a"), (2, 0.9, "b")], "id int, v double, g string")
    tables.write_parquet(df, str(tmp_path / "t"), ["g"])
    assert tables.read_or_empty(spark, str(tmp_path / "t"), "id int, v double, g string").count() == 2
    empty = tables.read_or_empty(spark, str(tmp_path / "absent"), "id int")
    assert empty.count() == 0 and empty.columns == ["id"]
    tables.write_top_json(df, str(tmp_path / "j"), "v", 1)
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert lines == [{"id": 2, "v": 0.9, "g": "b"}]
    tables.write_manifest(spark, ["z", "a"], str(tmp_path / "m"))
    assert tables.read_manifest(spark, str(tmp_path / "m")) == ["z", "a"]


def test_mail_file_stream(spark, corpus, tmp_path):
    """The corpus reader as a stream of files."""
    files = mail_files.read_mail_files(spark, str(corpus / "set"), stream=True)
    query = (
        mail_files.parse_mail(files).writeStream.format("parquet").trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "c")).start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


@pytest.mark.parametrize("algorithm,options", [
    ("logistic", {"maxIter": 5}), ("forest", {"numTrees": 3, "maxDepth": 3}),
])
def test_training(spark, data, algorithm, options):
    rows = view(spark, data, "mail").filter("label IS NOT NULL")
    out = train_and_predict(
        rows.filter("mail_id % 5 > 0"), rows.filter("mail_id % 5 = 0"), algorithm, 50, 20, **options
    ).collect()
    assert out
    for r in out:
        assert r["ham_score"] + r["spam_score"] + r["phishing_score"] == pytest.approx(1.0)
        assert r["prediction"] in (0, 1, 2)


def test_mail_folders_as_a_stream(spark, corpus, tmp_path):
    """The stream over several batches equals the batch scan; repeated contents come once."""
    from postwarden.streaming import jobs

    root = str(corpus / "set")
    want = sorted(map(tuple, mail_files.read_mail_dirs(spark, root).select("path", "label", "source").collect()))
    stream = mail_files.read_mail_dirs(spark, root, stream=True, files_per_batch=1)
    jobs.drain(jobs.append_job(stream.select("path", "label", "source"), str(tmp_path / "home")))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "home/rows")).collect())) == want
    for i, data in enumerate((b"one", b"two", b"one", b"two", b"three")):
        (tmp_path / "files").mkdir(exist_ok=True)
        (tmp_path / "files" / f"{i}.eml").write_bytes(data)
    files = mail_files.read_mail_files(spark, str(tmp_path / "files"), stream=True, files_per_batch=1)
    jobs.drain(jobs.append_job(mail_files.without_repeats(files).select("content"), str(tmp_path / "other")))
    assert sorted(bytes(r[0]) for r in spark.read.parquet(str(tmp_path / "other/rows")).collect()) == [b"one", b"three", b"two"]
    (tmp_path / "index").write_text("spam x/0.eml\nham x/4.eml\nspam x/9.eml\n", encoding="utf-8")
    matched = mail_files.read_trec(spark, str(tmp_path / "index"), str(tmp_path / "files"), stream=True, files_per_batch=2)
    jobs.drain(jobs.append_job(matched.select("label", "path"), str(tmp_path / "third")))
    got = sorted((r.label, r.path[-5:]) for r in spark.read.parquet(str(tmp_path / "third/rows")).collect())
    assert got == [("ham", "4.eml"), ("spam", "0.eml")]


def test_mail_dirs_are_written_whole_and_nested(spark, tmp_path):
    """One file a mail, in few folders below the root; empty, repeated and long rows keep their content."""
    import os

    rows = [("ham-1", "a\nb"), ("spam-2", None), ("ham-3", ""), ("spam-4", "é" * 70_000), (None, "lost"), ("ham-1", "again")]
    root = str(tmp_path / "dirs")
    mails = spark.createDataFrame(rows + [(f"ham-{i}", f"text {i}") for i in range(10, 600)], "box string, value string")
    mail_files.write_mail_dirs(mails.coalesce(1), "file:" + root)
    assert len(os.listdir(root)) <= mail_files.BUCKETS
    files = mail_files.read_mail_dirs(spark, root)
    got = {r.path.split("=")[-1].split("/")[0]: bytes(r.content).decode() for r in files.collect()}
    want = {f"ham-{i}": f"text {i}\n" for i in range(10, 600)}
    assert got == want | {"ham-1": "a\nb\nagain\n", "spam-2": "\n", "ham-3": "\n", "spam-4": "é" * 70_000 + "\n"}
    assert files.filter("label = 'spam'").count() == 2 and not [f for _, _, n in os.walk(root) for f in n if f[0] == "."]


def test_streams_over_mail_folders_keep_folders_not_files(spark, tmp_path):
    """What the stream's source keeps on the driver is a few hundred folders, whatever the number of mails; rows are those of a scan."""
    import json

    from postwarden.streaming import jobs

    root, home = str(tmp_path / "dirs"), str(tmp_path / "home")
    rows = [(f"{'ham' if i % 3 else 'spam'}-{i}", None if i % 7 == 0 else f"text é {i % 50}\n") for i in range(900)]
    mail_files.write_mail_dirs(spark.createDataFrame(rows + [(None, "lost")], "box string, value string").repartition(3), root)
    (tmp_path / "dirs/bucket=0/box=ham-0").mkdir(parents=True, exist_ok=True)
    (tmp_path / "dirs/bucket=0/box=ham-0/.hidden").write_text("no")
    (tmp_path / "dirs/bucket=0/box=ham-0/empty.txt").write_text("")
    stream = mail_files.read_mail_dirs(spark, root, stream=True, files_per_batch=300, by_folder=True)
    jobs.drain(jobs.append_job(stream, home))
    got = spark.read.parquet(f"{home}/rows")
    want = mail_files.read_mail_dirs(spark, "file://" + root).select("path", "content", "label", "source")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) and got.count() == 900
    batches = list((tmp_path / "home/checkpoint/sources/0").glob("[0-9]*"))
    kept = [json.loads(line)["path"] for b in batches for line in b.read_text().splitlines()[1:]]
    assert 3 <= len(batches) <= 4 and len(set(kept)) == len(kept) <= mail_files.BUCKETS
    assert mail_files.read_mail_files(spark, root, stream=True).columns == ["path", "content"]


def test_streams_over_mail_folders_have_a_bounded_number_of_batches(spark, data, monkeypatch):
    """However many files there are, a stream takes them in at most ``BATCHES`` batches."""
    from postwarden.plans import catalog

    monkeypatch.setattr(catalog, "FILES_PER_BATCH", 20)
    seen = []
    real = mail_files.read_mail_dirs
    monkeypatch.setattr(mail_files, "read_mail_dirs", lambda *a, **k: seen.append(k["files_per_batch"]) or real(*a, **k))
    assert catalog._mail_stream(spark, data).isStreaming
    n = catalog._labelled(spark, data).count()
    assert n > 20 * catalog.BATCHES and n <= seen[0] * catalog.BATCHES < n + catalog.BATCHES


def test_texts_of_a_stream_come_once_and_keep_folders_only(spark, tmp_path, monkeypatch):
    """Repeated texts over all batches come once, and the source's log has folders, fewer than there are mails."""
    import hashlib
    import json

    from postwarden.plans import catalog

    docs = [(i, f"text {i % 90}" if i % 4 else None, "src", "en") for i in range(700)]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, int(i % 5 == 0), i % 3 % 2) for i in range(600)], "doc_id bigint, toxic int, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(catalog.jobs, "new_home", lambda spark, purpose: str(tmp_path / "home"))
    got = [r.content_md5 for r in catalog.stream_mail_texts(spark, str(tmp_path)).collect()]
    want = {hashlib.md5(f"{text or ''}\n".encode()).hexdigest() for i, text, *_ in docs if i < 600}
    assert sorted(got) == sorted(want)
    batches = list((tmp_path / "home/checkpoint/sources/0").glob("[0-9]*"))
    kept = [json.loads(line)["path"] for b in batches for line in b.read_text().splitlines()[1:]]
    assert 1 < len(batches) <= catalog.BATCHES and 0 < len(set(kept)) == len(kept) <= mail_files.BUCKETS
