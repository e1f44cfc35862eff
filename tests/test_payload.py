from sendscope.operators import payload


def _logs(spark, msgs):
    return spark.createDataFrame([(None, f"l{i}", m) for i, m in enumerate(msgs)],
                                 "timestamp timestamp_ntz, insertId string, message string")


def test_non_json_and_schema_violations(spark):
    msgs = ["Comprar", "12", '{"a":1}', "[1]", '{"produto":"x"}', '  {"produto":"x","acao":"comprar"}']
    logs = _logs(spark, msgs)
    non_json = {r.message for r in payload.non_json_payloads(logs).collect()}
    assert non_json == {"Comprar", "12"}  # prefix rule, JSON scalars count as non-JSON
    parsed = {r.message for r in payload.non_json_payloads(logs, method="parser").collect()}
    assert parsed == {"Comprar"}  # the parser accepts the scalar 12
    v = {r.message: r.missing_fields for r in
         payload.payload_schema_violations(logs, {"produto": "string", "acao": "string"}).collect()}
    assert v["Comprar"] == "produto,acao"
    assert v['{"a":1}'] == "produto,acao"
    assert v['{"produto":"x"}'] == "acao"
    assert '  {"produto":"x","acao":"comprar"}' not in v


def test_error_payloads_and_cta_evidence(spark):
    logs = _logs(spark, ["It is not a JSON type and cannot be deserialized: Comprar Fone X9",
                         "It is not a JSON type and cannot be deserialized: Comprar Fone X9",
                         "It is not a JSON type and cannot be deserialized: Falar com atendente",
                         "info: Falar com atendente clicked", "ok"])
    got = {r.payload: r.n_errors for r in payload.error_payloads(logs).collect()}
    assert got == {"Comprar Fone X9": 2, "Falar com atendente": 1}
    ev = {r.cta: (r.n_log_hits, r.n_error_hits) for r in
          payload.cta_log_evidence(["Falar com atendente", "Comprar Fone X9", "Nada"], logs).collect()}
    assert ev == {"Falar com atendente": (2, 1), "Comprar Fone X9": (2, 2), "Nada": (0, 0)}


def test_contains_join_matches_literal_path(spark):
    import random
    rnd = random.Random(3)
    words = ["Buy now", "Talk to an agent", "Falar com atendente", "ab", "abc", "xyz", "now Buy"]
    msgs = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 6))) for _ in range(300)]
    msgs += ["Buy nowBuy now", "aaaaab", None, ""]
    logs = _logs(spark, msgs)
    ctas = spark.createDataFrame([(c,) for c in ["Buy now", "Talk to an agent", "ab", "Lu", "zz", "now Buy n"]],
                                 "cta string")
    literal = {r.cta: (r.n_log_hits, r.n_error_hits) for r in payload.cta_log_evidence(ctas, logs).collect()}
    joined = {r.cta: (r.n_log_hits, r.n_error_hits)
              for r in payload.cta_log_evidence(ctas, logs, block=2).collect()}
    assert literal == joined
    brute = {c: sum(1 for m in msgs if m is not None and c in m)
             for c in ["Buy now", "Talk to an agent", "ab", "Lu", "zz", "now Buy n"]}
    assert {c: v[0] for c, v in joined.items()} == brute
    pairs = payload.contains_join(logs.select("message"), ctas, "message", "cta").groupBy("cta").count().collect()
    assert {r["cta"]: r["count"] for r in pairs} == {c: n for c, n in brute.items() if n}


def test_error_payload_keeps_multi_line_text(spark):
    logs = _logs(spark, ["x cannot be deserialized: Comprar\nsegunda linha", "x cannot be deserialized: Lu\n"])
    got = sorted(r.payload for r in payload.error_payloads(logs).collect())
    assert got == ["Comprar\nsegunda linha", "Lu\n"]


def test_json_prefix_uses_json_whitespace(spark):
    logs = _logs(spark, [' \n{"k": 1}', '\x0b{"k": 1}'])
    assert [r.message for r in payload.non_json_payloads(logs).collect()] == ['\x0b{"k": 1}']


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="abc ", max_size=14), min_size=1, max_size=12),
       st.lists(st.text(alphabet="abc", min_size=1, max_size=6), min_size=1, max_size=5, unique=True))
def test_contains_join_property(spark, texts, patterns):
    # small alphabet → many overlaps and repeated grams; short patterns → q and stride at their limits
    tdf = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    pdf = spark.createDataFrame([(p,) for p in patterns], "p string")
    got = sorted((r.i, r.p) for r in payload.contains_join(tdf, pdf, "t", "p").collect())
    want = sorted((i, p) for i, t in enumerate(texts) for p in patterns if p in t)
    assert got == want


def test_a_gram_in_every_line_keys_nothing(spark):
    lines = spark.createDataFrame([(f'{{"key": {i % 300}, "x": 1}}',) for i in range(3000)], "message string")
    ctas = spark.createDataFrame([(f'"key": {i}',) for i in range(0, 900, 7)] + [('"x": 1',), ("",), (None,)], "cta string")
    keys = {r["_pat"]: r["_gram"] for r in payload.pattern_keys(lines, ctas, "message", "cta").collect()}
    every = {'"key":', 'key": ', '"x": 1'}
    assert len(keys) == len(range(0, 900, 7)) + 1
    assert not any(g in every for p, g in keys.items() if p != '"x": 1' and len(p) > 8)
    got = {(r.message, r.cta): r["count"] for r in
           payload.contains_join(lines, ctas, "message", "cta").groupBy("message", "cta").count().collect()}
    texts = [f'{{"key": {i % 300}, "x": 1}}' for i in range(3000)]
    want = {}
    for t in texts:
        for p in keys:
            if p in t:
                want[t, p] = want.get((t, p), 0) + 1
    assert got == want
