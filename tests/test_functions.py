import pytest
from pyspark.sql import functions as F

from riskloom.functions import labels, lexicon, rates, redaction, text, web
from riskloom.operators import scoring


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("raw, clean, emails, phones", [
    ("write to a.b+c@mail.example.org now", "write to [EMAIL] now", 1, 0),
    ("call 555-123-4567 or (555) 123-4567", "call [PHONE] or ([PHONE]", 0, 2),
    ("+1 (743) 555-3824", "+1 ([PHONE]", 0, 1),
    ("+1 743 555-3824", "+[PHONE]", 0, 1),
    ("x@y.zz 1234567890 y@z.com", "[EMAIL] [PHONE] [EMAIL]", 2, 1),
    ("already [EMAIL] and [PHONE]; me@here.net", "already [EMAIL] and [PHONE]; [EMAIL]", 1, 0),
    ("٥٥٥-123-4567", "[PHONE]", 0, 1),
    ("é555-123-4567", "é555-123-4567", 0, 0),
    ("no digits 123-45", "no digits 123-45", 0, 0),
    ("", "", 0, 0),
])
def test_redaction(spark, raw, clean, emails, phones):
    import re

    df = redaction.redact(spark.createDataFrame([(raw,)], "text string"))
    row = df.first()
    # what Python's engine makes of the two patterns is the reference for both text and counts
    mailless, n_mail = re.subn(redaction.EMAIL_PATTERN, "[EMAIL]", raw)
    expected, n_phone = re.subn(redaction.PHONE_PATTERN, "[PHONE]", mailless)
    assert (row["redacted"], row["email_count"], row["phone_count"]) == (expected, n_mail, n_phone)
    assert (n_mail, n_phone) == (emails, phones)


def test_keyword_risk_levels_and_order(spark):
    texts = [
        (1, "I feel HOPELESS and think of an overdose, suicide"), (2, "feeling worthless, cutting class"),
        (3, "kill myself tonight"), (4, "all is fine"), (5, "I can't go on")]
    got = {r["id"]: r for r in scoring.keyword_risk(spark.createDataFrame(texts, "id int, text string")).collect()}
    assert (got[1]["risk_level"], got[1]["score"], got[1]["triggers"]) == ("HIGH", 0.95, ["suicide", "overdose"])
    assert (got[2]["risk_level"], got[2]["score"], got[2]["triggers"]) == ("MEDIUM", 0.6, ["cutting", "worthless"])
    assert got[3]["triggers"] == ["kill myself", "kill myself tonight"]
    assert (got[4]["risk_level"], got[4]["score"], got[4]["triggers"]) == ("LOW", 0.1, [])
    assert got[5]["risk_level"] == "MEDIUM"
    assert all(r["needs_human_review"] for r in got.values())


def test_whole_word_option(spark):
    df = spark.createDataFrame([(1, "a haircutting tool"), (2, "cutting, again")], "id int, text string")
    strict = lexicon.Lexicon(high=(), medium=("cutting",), whole_words=True)
    got = {r["id"]: r["risk_level"] for r in scoring.keyword_risk(df, strict).collect()}
    assert got == {1: "LOW", 2: "MEDIUM"}


@pytest.mark.parametrize("cls, conf, level, guidance, score", [
    (1, 0.95, "HIGH", lexicon.ALERT_GUIDANCE, 0.95), (1, 0.90, "HIGH", lexicon.ALERT_GUIDANCE, 0.90),
    (1, 0.75, "MEDIUM", lexicon.CHECK_IN_GUIDANCE, 0.75), (1, 0.55, "MEDIUM", lexicon.WEAK_SIGNAL_GUIDANCE, 0.55),
    (0, 0.99, "LOW", lexicon.NO_SIGNAL_GUIDANCE, 0.01),
])
def test_model_risk(spark, cls, conf, level, guidance, score):
    got = value(spark, scoring.model_risk(F.lit(cls), F.lit(conf)))
    assert (got["risk_level"], got["guidance"]) == (level, guidance)
    assert got["score"] == pytest.approx(score)
    assert got["prediction"] == ("suicide" if cls else "non-suicide")


def test_analysis_falls_back_per_row(spark):
    df = spark.createDataFrame(
        [(1, "me@x.org is hopeless", 1, 0.8), (2, "hopeless", None, None)], "id int, text string, c int, p double")
    got = {r["id"]: r for r in scoring.analyze(df, model_class="c", model_confidence="p").collect()}
    assert got[1]["method"] == "ml_model" and got[1]["risk"]["confidence"] == 0.8
    assert got[1]["pii_redacted"]["email"] == 1 and got[1]["sanitized_excerpt"] == "[EMAIL] is hopeless"
    assert got[2]["method"] == "keyword_fallback" and got[2]["process_method"] == "ml_model"
    assert got[2]["risk"]["triggers"] == ["hopeless"]
    assert "text" not in scoring.analyze(df).columns


def test_excerpt_and_preview(spark):
    assert value(spark, text.excerpt(F.lit("a" * 240))) == "a" * 240
    assert value(spark, text.excerpt(F.lit("a" * 241))) == "a" * 240 + "..."
    assert value(spark, text.preview(F.lit("ab"))) == "ab..."


@pytest.mark.parametrize("raw", [
    "", "  ", "one", " two\twords\n", "nbsp here", "em space　wide", "a\x1cb", "x​zero width", "tab\x0bvt\x85nel"])
def test_words_follow_python(spark, raw):
    assert value(spark, text.words(F.lit(raw))) == raw.split()
    assert value(spark, text.strip(F.lit(raw))) == raw.strip()
    assert value(spark, text.word_count(F.lit(raw))) == len(raw.split())


def test_whitespace_set_is_pythons():
    import sys

    assert {chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()} == set(text.WHITESPACE)


def test_sentences(spark):
    assert value(spark, text.sentences(F.lit(" One. Two!?  ... three "))) == ["One", "Two", "three"]
    assert value(spark, text.sentences(F.lit("?!"))) == []


@pytest.mark.parametrize("seconds, expected", [(3661.9, "1h 1m 1s"), (61, "1m 1s"), (59.9, "59s"), (0, "0s"), (7200, "2h 0m 0s")])
def test_duration(spark, seconds, expected):
    assert value(spark, rates.duration_text(F.lit(float(seconds)))) == expected


def test_rates_are_zero_without_a_denominator(spark):
    assert value(spark, rates.ratio(F.lit(3), F.lit(0))) == 0.0
    assert value(spark, rates.percent(F.lit(3), F.lit(0))) == 0.0
    assert value(spark, rates.f_score(F.lit(0.0), F.lit(0.0))) == 0.0


@pytest.mark.parametrize("good, all_rows, shown", [(140, 150, 93.33), (50, 52, 96.15), (112, 127, 88.19), (1, 8, 12.5)])
def test_documented_percentages(spark, good, all_rows, shown):
    assert value(spark, rates.percent(F.lit(good), F.lit(all_rows))) == shown


@pytest.mark.parametrize("ip, shown", [
    ("10.1.2.3", "10.1.2.xxx"), ("::1", "xxx.xxx.xxx.xxx"), ("1.2.3", "xxx.xxx.xxx.xxx"), ("1.2.3.4.5", "xxx.xxx.xxx.xxx"),
    ("", None), (None, None)])
def test_anonymize_ip(spark, ip, shown):
    assert value(spark, web.anonymize_ip(F.lit(ip).cast("string"))) == shown


@pytest.mark.parametrize("forwarded, peer, ip", [
    ("1.1.1.1, 2.2.2.2", "9.9.9.9", "1.1.1.1"), (" 1.1.1.1 ,x", "9.9.9.9", "1.1.1.1"), ("3.3.3.3", "9.9.9.9", "3.3.3.3"),
    (None, "9.9.9.9", "9.9.9.9"), (None, None, None)])
def test_client_ip(spark, forwarded, peer, ip):
    assert value(spark, web.client_ip(F.lit(forwarded).cast("string"), F.lit(peer).cast("string"))) == ip


@pytest.mark.parametrize("path, kept", [
    ("/", True), ("/admin", True), ("/api/v1/x", False), ("/static/a.css", False), ("/health", False), ("/healthy", True), ("/api", True)])
def test_page_view(spark, path, kept):
    assert value(spark, web.is_page_view(F.lit(path))) is kept


def test_labels(spark):
    assert value(spark, labels.class_of(F.lit("suicide"))) == 1
    assert value(spark, labels.class_of(F.lit("other"))) is None
    assert value(spark, labels.display_of(F.lit(0))) == "Not Suicidal"


def test_softmax_is_stable_and_argmax_takes_the_first(spark):
    probs = value(spark, scoring.softmax(F.array(F.lit(1000.0), F.lit(1001.0))))
    assert sum(probs) == pytest.approx(1.0) and probs[1] == pytest.approx(0.7310585786)
    p0, p1 = scoring.softmax2(F.lit(1000.0), F.lit(1001.0))
    assert value(spark, p1) == pytest.approx(0.7310585786) and value(spark, p0) == pytest.approx(0.2689414214)
    assert value(spark, scoring.argmax(F.array(F.lit(2.0), F.lit(2.0)))) == 0


@pytest.mark.parametrize("score, color", [(0.9, "red"), (0.89, "orange"), (0.7, "orange"), (0.5, "yellow")])
def test_severity(spark, score, color):
    assert value(spark, scoring.severity(F.lit(score))) == color


def test_iso_timestamp(spark):
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    assert value(spark, text.iso_timestamp(ts("2024-01-02 03:04:05"))) == "2024-01-02T03:04:05"
    assert value(spark, text.iso_timestamp(ts("2024-01-02 03:04:05.25"))) == "2024-01-02T03:04:05.250000"


def test_mail_redaction_is_linear_and_equals_the_plain_pattern(spark):
    import re
    import time

    from riskloom.functions import redaction as rd

    texts = ["a@b.cc@d.ee", "x.a@b.cc,b@c.dd", "a@b.ccd@e.ff", "a+b%c@h-i.jk.", "@a.bb", "a@@b.cc", "a@b.c1.dd@x.yy", "é@b.cc"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: (r["redacted"], r["email_count"]) for r in rd.redact(df).collect()}
    assert got == {t: re.subn(rd.EMAIL_PATTERN, rd.EMAIL_MARK, t) for t in texts}
    start = time.time()
    assert rd.redact(spark.createDataFrame([("a" * 1_000_000 + " @",)], "text string")).head()["email_count"] == 0
    assert time.time() - start < 5


def test_mobile_browser_families(spark):
    from riskloom.functions import web

    agents = {
        "Mozilla/5.0 (Linux; Android 14; Pixel 8) AppleWebKit/537.36 Chrome/120.0.0.0 Mobile Safari/537.36": "Chrome Mobile",
        "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605.1.15 Version/17.0 Mobile/15E148 Safari/604.1": "Mobile Safari",
        "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605.1.15 CriOS/120.0 Mobile/15E148 Safari/604.1": "Chrome Mobile iOS",
        "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605.1.15 FxiOS/120.0 Mobile/15E148 Safari/605.1.15": "Firefox iOS",
        "Mozilla/5.0 (Android 14; Mobile; rv:121.0) Gecko/121.0 Firefox/121.0": "Firefox Mobile",
        "Mozilla/5.0 (Linux; Android 10) AppleWebKit/537.36 Chrome/120.0.0.0 Mobile Safari/537.36 EdgA/120.0": "Edge Mobile",
        "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/120.0.0.0 Safari/537.36 Edg/120.0": "Edge",
        "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15) AppleWebKit/605.1.15 Version/17.0 Safari/605.1.15": "Safari",
    }
    df = spark.createDataFrame([(a,) for a in agents], "agent string")
    got = {r["agent"]: r["f"] for r in df.select("agent", web.family(F.col("agent"), web.BROWSER_RULES).alias("f")).collect()}
    assert got == agents
