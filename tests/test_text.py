from pyspark.sql import functions as F

from threadloom.functions import lexicon, scoring, text
from threadloom.functions import values as V


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "t string").select(build(F.col("t")).alias("x")).first()[0]


def redacted(spark, value, **kw):
    r = text.redact(spark.createDataFrame([(value,)], "t string"), "t", **kw).first()
    return r["redacted_text"], r["pii_count"], r["pii_types"]


def test_redaction_covers_each_type_and_order(spark):
    assert redacted(spark, "mail jo.doe+x@mail-host.org now") == ("mail [EMAIL_REDACTED] now", 1, ["email"])
    t, n, kinds = redacted(spark, "write a@b.co or call +1 415-555-0182, card 4000 1234 5678 9010")
    # The long number holds a phone-shaped part, and phones are redacted first.
    assert "[EMAIL_REDACTED]" in t and "[PHONE_REDACTED]" in t and n >= 3 and kinds[:2] == ["email", "phone_number"]
    assert redacted(spark, "acct 12345678901234567") [2] != []
    assert redacted(spark, "id 1 2 3 4 5 6 7 8 9 0 1 2")[2] == ["card_or_account_number"]


def test_device_id_is_removed_unless_kept(spark):
    assert redacted(spark, "my Serial: C02ABCDEFGH1 ok") == ("my [DEVICE_ID_REDACTED] ok", 1, ["device_identifier"])
    assert redacted(spark, "my Serial: C02ABCDEFGH1 ok", keep_device_id=True)[0] == "my C02ABCDEFGH1 [DEVICE_ID_REDACTED] ok"


def test_blank_and_null_text_are_unchanged(spark):
    assert redacted(spark, "  ") == ("  ", 0, [])
    assert redacted(spark, None) == (None, 0, [])


def test_redaction_is_idempotent(spark):
    once = redacted(spark, "a@b.co +1 415-555-0182 IMEI 49015420323751AB")[0]
    assert redacted(spark, once) == (once, 0, [])


def test_anonymize(spark):
    df = spark.createDataFrame([(" Hi @jo_9 see https://x.y/z mail a@b.co call 415-555-0182 ",), (None,)], "t string")
    got = [r[0] for r in text.anonymize(df, "t").select("anonymized_text").collect()]
    assert got == ["Hi @[USER] see [URL] mail [EMAIL_REDACTED] call [PHONE_REDACTED]", ""]


def test_normal_form(spark):
    f = text.normal_form
    assert one(spark, "  Hé, @Jöe_1! See HTTPS://a.b/c?d  and www.x.y\n\tNOW -- ok ", f) == "hé see and now ok"
    assert one(spark, None, f) == ""
    assert one(spark, "a  b", f) == "a b"


def test_tokens_and_ngrams(spark):
    t = text.tokens
    assert one(spark, "I can't été_1 go", t) == ["can", "été_1", "go"]
    assert one(spark, "aa bb cc", lambda c: text.ngrams(t(c))) == ["aa", "bb", "cc", "aa bb", "bb cc"]
    assert one(spark, "x", lambda c: text.ngrams(t(c))) == []
    assert one(spark, "aa the bb", lambda c: text.ngrams(text.drop_stop_words(t(c), ["the"]))) == ["aa", "bb", "aa bb"]


def test_word_and_substring_matching(spark):
    hit = lambda v, m="word": one(spark, v, lambda c: lexicon.mentions(c, ["sue", "not working"], m))
    assert hit("I will SUE you") and hit("it is Not Working.") and not hit("this issue") and not hit("ésue") and not hit(None)
    assert hit("this issue", "substring")


def test_topics_and_sarcasm(spark):
    n = lambda v: one(spark, v, lambda c: lexicon.topics_hit(c, V.TOPIC_WORDS))
    assert n("Battery drains and the WIFI drops") == 2 and n("hello") == 0
    s = lambda v: one(spark, v, lambda c: lexicon.sarcasm_risk(c, V.PRAISE_WORDS, V.FRUSTRATION_WORDS))
    assert s("Great, it froze again") and not s("great phone")


def test_cascade_and_severity(spark):
    label = lambda v: one(spark, v, lambda c: lexicon.cascade(c, [("battery_drain_power", 0.95, ["battery"]), ("connectivity_network", 0.94, ["wifi"])], ("other", 0.72))[0])
    assert label("battery and wifi") == "battery_drain_power" and label("nothing here") == "other"
    tone = lambda v: one(spark, v, lambda c: lexicon.severity(c, ["furious", "sue"], ["annoying"]))
    assert [tone("I am furious and annoying"), tone("so annoying"), tone("hello, an issue")] == ["severe", "frustrated", "routine"]


def test_pointer_ids(spark):
    assert one(spark, " 5, 12.0,,x ,7", scoring.pointer_ids) == [5, 12, 7]


def test_created_at(spark):
    got = one(spark, "Tue Oct 31 22:10:47 +0000 2017", lambda c: F.unix_seconds(scoring.parse_created_at(c)))
    assert got == 1509487847
    assert one(spark, "bad", scoring.parse_created_at) is None


def test_rounding_matches_binary_value(spark):
    values = [0.155, 0.125, 0.375, 0.97645, 0.51055, 2.675, 1.005, -0.125, 0.285, 0.295, 33.335, 0.0, 1e9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (2, 4):
        got = [r[0] for r in df.select(scoring.rounded(F.col("v"), digits)).collect()]
        assert got == [round(v, digits) if v < 1e8 else v for v in values]


def test_clamp_and_flags(spark):
    got = [one(spark, v, scoring.clamp_score) for v in ("9", "0", "4", "x", None, "2.7")]
    assert got == [5, 1, 4, 3, 3, 2]
    assert [one(spark, v, scoring.yes) for v in (" YES ", "no", None)] == [True, False, False]


def test_request_render_key_and_parse(spark):
    df = spark.createDataFrame([("m", "0.0", None, "p")], "m string, t string, s string, p string")
    import hashlib

    key = df.select(scoring.request_key(*[F.col(c) for c in "mtsp"])).first()[0]
    assert key == hashlib.sha256(b"m:::0.0::::::p").hexdigest()
    body = df.select(scoring.render_request("H\n", F.array(F.lit("a"), F.lit("b")), "%d) %s\n", F.col("p"))).first()[0]
    assert body == "H\n1) a\n2) b\np"
    rows = ['```json\n{"a": 1}\n```', '{"b": 2}', "junk", None]
    parsed = spark.createDataFrame([(r,) for r in rows], "r string")
    value, ok = scoring.parse_response(F.col("r"), "a int", ["a"])
    assert [tuple(x) for x in parsed.select(value["a"], ok).collect()] == [(1, True), (None, False), (None, False), (None, False)]
