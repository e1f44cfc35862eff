import pytest
from hypothesis import given, settings, strategies as st

from sendscope.functions.literals import required_literals
from sendscope.functions.regex import FLAG_NO, FLAG_YES, matches, unicode_case
from sendscope.operators import search


def test_unicode_case_rewrite():
    assert unicode_case("(?i)promo") == "(?iu)promo"
    assert unicode_case("(?iu)x") == "(?iu)x"
    assert unicode_case("plain") == "plain"


def test_flag_null_text_and_non_ascii_case(spark):
    df = spark.createDataFrame([("1", None), ("2", "ÉCOLE aberta"), ("3", "école"), ("4", "a\x0bb")],
                               "id string, text string")
    out = {r.id: r.f for r in search.keyword_flag(df, "(?i)école", "f").collect()}
    assert out == {"1": FLAG_NO, "2": FLAG_YES, "3": FLAG_YES, "4": FLAG_NO}  # M3, M5


def test_keyword_conversations_does_not_multiply(spark):
    conv = spark.createDataFrame([("s1", "m1", "use CUPOM26X"), ("s2", "m2", "cupom26x now"),
                                  ("s3", "m3", "nothing"), (None, "m4", "CUPOM26X")],
                                 "session_id string, message_id string, text string")
    camp = spark.createDataFrame([("s1",), ("s1",), ("s1",)], "session_id string")  # repeated session
    out = search.keyword_conversations(conv, camp, "(?i)CUPOM26X", "cupom").collect()
    assert sorted(r.message_id for r in out) == ["m1", "m2", "m4"]  # M6: no fan-out
    linked = {r.message_id: r.session_campanha for r in out}
    assert linked == {"m1": "s1", "m2": None, "m4": None}
    assert all(r.cupom == FLAG_YES for r in out)


def test_keyword_hits_one_scan_many_patterns(spark):
    conv = spark.createDataFrame([("s1", "m1", "Buy now or talk to an agent"), ("s2", "m2", "hello")],
                                 "session_id string, message_id string, text string")
    kws = [("buy", r"(?i)buy\s+now"), ("agent", r"(?i)talk\s+to\s+an\s+agent"), ("none", "zzz")]
    hits = sorted((r.message_id, r.keyword) for r in search.keyword_hits(conv, kws, keep_cols=["message_id"]).collect())
    assert hits == [("m1", "agent"), ("m1", "buy")]
    plan = search.keyword_hits(conv, kws)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # a single scan, no shuffle


def test_keyword_linkage_counts_and_zero_rows(spark):
    conv = spark.createDataFrame([("s1", "m1", "CUPOM26X"), ("s9", "m2", "CUPOM26X"), ("s9", "m3", "cupom26x")],
                                 "session_id string, message_id string, text string")
    camp = spark.createDataFrame([("s1",)], "session_id string")
    rows = {r.keyword: r for r in search.keyword_linkage(conv, camp, [("cupom", "(?i)cupom26x"),
                                                                      ("lu", "Falar com atendente")]).collect()}
    assert (rows["cupom"].n_hits, rows["cupom"].n_linked, rows["cupom"].n_unlinked,
            rows["cupom"].n_sessions) == (3, 1, 2, 2)
    assert rows["lu"].n_hits == 0


def test_keyword_logs(spark):
    logs = spark.createDataFrame([("cannot be deserialized: Comprar Fone X9",), ("ok",), (None,)],
                                 "message string")
    assert search.keyword_logs(logs, r"(?i)fone\s+x9", "fone").count() == 1


def test_word_boundaries_match_re2(spark):
    import duckdb

    from sendscope.functions.regex import ascii_word_boundaries
    texts = ["éthe of", "xthe of", "the of", "_the of", "1the of", "été the of", "çthe  of", "of the", None]
    patterns = [r"(?i)\bthe\s+of", r"\Bhe", r"[tx]he\b", r"\Q\b\E|of\b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    con = duckdb.connect()
    for p in patterns:
        got = [r.m for r in df.select(matches("t", p).alias("m")).collect()]
        want = [bool(con.execute("SELECT regexp_matches(?, ?)", [t, p]).fetchone()[0]) if t is not None else False
                for t in texts]
        assert got == want, p
    assert ascii_word_boundaries(r"[\b]") == r"[\b]"


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="thoféÉ_1 T", max_size=12), min_size=1, max_size=20))
def test_word_boundary_property_against_re2(spark, texts):
    import duckdb
    patterns = [r"(?i)\bthe\b", r"\Bhe", r"(?i)\bé", r"of\b", r"(?i)t\Bh"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    con = duckdb.connect()
    for p in patterns:
        got = [r.m for r in df.select(matches("t", p).alias("m")).collect()]
        want = [bool(con.execute("SELECT regexp_matches(?, ?)", [t, p]).fetchone()[0]) for t in texts]
        assert got == want, (p, [t for t, g, w in zip(texts, got, want) if g != w])


@pytest.mark.parametrize("pattern", [r"foo$", r"(?i)galaxy\s+s26", r"a\Sb", r"[\s,]+x", r"[^\S]y", r"\Qa$\E", r"[$]z", r"\$z"])
def test_classes_search_like_re2(spark, pattern):
    import duckdb
    texts = ["foo", "foo\n", "foo\nbar", "galaxy s26", "Galaxy\x0bS26", "galaxy\t\nS26", "galaxy\u00a0s26", "a\x0bb", "a b", "a\u00a0b",
             " x", "\x0bx", ",x", " y", "\x0by", "a$", "$z", "a\n"]
    con = duckdb.connect()
    want = [con.execute("SELECT regexp_matches(?, ?)", [t, pattern]).fetchone()[0] for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(matches("t", pattern)).collect()]
    assert got == want


def test_keyword_lists_and_tables_are_one(spark):
    df = spark.createDataFrame([(1, "buy now"), (2, "talk"), (3, None)], "id int, text string")
    pairs = [("b", "buy"), ("b", "buy"), ("t", "talk"), (None, "buy"), ("n", None)]
    table = spark.createDataFrame(pairs, "name string, pattern string")
    got = [sorted(map(tuple, search.keyword_hits(df, k, block=b).collect())) for k in (pairs, table) for b in (1, 10)]
    assert got == [[(1, "b"), (2, "t")]] * 4
    links = [sorted(map(tuple, search.keyword_linkage(df.withColumn("session_id", df.id.cast("string")),
                                                      spark.createDataFrame([("1",)], "session_id string"), k).collect()))
             for k in (iter(pairs), table)]
    assert links[0] == links[1] == [("b", 1, 1, 0, 1), ("t", 1, 0, 1, 1)]


PIECES = ["buy", "Now", r"\s+", r"\b", "[ab]", "(?:x|y)", "c{2,3}", "s?", "kin", r"\d*", ".", "(q|r)+", "ing$", "é", "ſ"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), min_size=1, max_size=4), st.booleans(),
       st.lists(st.sampled_from(["buy", "now", " ", "a", "x", "cc", "s", "kin", "KİN", "\u212ain", "ſ", "BUYNOW", "7", "qr", "ing", "é"]), max_size=8))
def test_required_literals_are_in_every_match(pieces, fold, words):
    import re
    pattern, text = ("(?i)" if fold else "") + "".join(pieces), "".join(words)
    found = re.search(pattern, text)
    plain = text.translate({0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}).lower()
    assert not found or all(lit in plain for lit in required_literals(pattern))


def test_unknown_regexes_require_nothing():
    assert [required_literals(p) for p in (r"\p{L}abc", "a|bcd", "(?x)a b c", "(abc)?", "[abc]{3}")] == [[]] * 5
    assert required_literals(r"\Qa.b(\E.*xyz\z") == ["a.b(", "xyz"]


def test_prefiltered_hits_equal_flagged_hits(spark, monkeypatch):
    from sendscope.operators import search
    texts = ["Buy now", "BUY  NOW\tthe coupon", "talk to an agent", None, "", "ab", "éthe of", "KİNd", "\u212aind ſale", "1234", "the the of"] * 2
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, _gram string")
    words = ["buy", "now", "the", "of", "agent", "kin", "sale", "coupon", "ind"]
    patterns = [(f"{a}{b}", rf"(?i)\b{a}\w*\s+{b}") for a in words for b in words]
    patterns += [(a, f"(?i){a}") for a in words] + [("digits", "[0-9]{4}"), ("same", "(?i)buy"), ("two", "ab"), ("case", "Buy")]
    many = search.keyword_hits(df, patterns, keep_cols=["id", "_gram"])
    monkeypatch.setattr(search, "MANY_PATTERNS", 10**9)
    few = search.keyword_hits(df, patterns, keep_cols=["id", "_gram"])
    got = sorted(map(tuple, many.collect()))
    assert got == sorted(map(tuple, few.collect())) and len(got) > 20
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    table = spark.createDataFrame(patterns, "name string, pattern string")
    monkeypatch.setattr(search, "MANY_PATTERNS", 64)
    assert sorted(map(tuple, search.keyword_hits(df, table, keep_cols=["id", "_gram"]).collect())) == got
