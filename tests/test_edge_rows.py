"""Hand-written edge rows with literal expected values (parsers and rules)."""

from pyspark.sql import functions as F

from graphwright.functions import constants as C
from graphwright.operators import authority as A, entities as E, links as L, relations as R
from graphwright.operators import replies as P, text as X, triples as T


def _responses(spark, replies):
    rows = [(0, i, "A sentence long enough.", r) for i, r in enumerate(replies)]
    return spark.createDataFrame(rows, "doc_id long, uid long, sentence string, response string")


def _atoms(spark, *replies):
    return R.atoms(_responses(spark, list(replies))).orderBy("uid", "atom_ix").collect()


def test_value_keeps_trailing_blank(spark):
    a = _atoms(spark, '{\n  "concept1": "A, B", \n"relationship": "related"\n}')
    assert a[0]["concept1"] == "A B "


def test_unquoted_value(spark):
    a = _atoms(spark, '{\n"concept1": "x",\n"importance": 4\n}')
    assert a[0]["importance"] == "4"


def test_no_space_after_colon_is_no_match(spark):
    a = _atoms(spark, '{\n"k":"v"\n"concept1": "long enough value"\n}')
    assert a[0]["n_keys"] == 1 and a[0]["concept1"] == "long enough value"


def test_one_line_record_takes_first_key_only(spark):
    a = _atoms(spark, '{"concept1": "A", "concept2": "B"}')
    assert a[0]["concept1"] == "A concept2: B" and a[0]["concept2"] is None


def test_repeated_key_last_wins_and_empty_blocks_dropped(spark):
    a = _atoms(spark, '{\n"concept1": "first",\n"concept1": "second"\n}\n}\n{\n}')
    assert len(a) == 1 and a[0]["concept1"] == "second"


def test_relationship_normalisation_exact(spark):
    a = _atoms(spark, '{\n"relationship": "is part of"\n}', '{\n"relationship": "is part of the line"\n}',
               '{\n"relationship": "Broader"\n}')
    assert [x["relationship"] for x in a] == ["owl:partOf", "is part of the line", "Broader"]


def test_swapped_fact(spark):
    rows = _responses(spark, ['{\n"concept1": "c1",\n"concept2": "c2",\n"entity": "e",\n'
                              '"relationship": "is part of the line",\n"importance": "1"\n}',
                              '{\n"concept1": "c1",\n"concept2": "c2",\n"entity": "e",\n'
                              '"relationship": "related",\n"importance": "1"\n}'])
    f = R.facts(R.atoms(rows)).orderBy("uid").collect()
    assert f[0]["fact"] == "c2 e (is part of the line) c1"
    assert f[1]["fact"] == "c1 e(skos:related) c2"


def test_skos_strict_and_broader(spark):
    rows = _responses(spark, ['{\n"concept1": "a",\n"concept2": "b",\n"relationship": "close match",\n'
                              '"importance": "1"\n}',
                              '{\n"concept1": "a",\n"concept2": "b",\n"relationship": "Broader",\n'
                              '"importance": "1"\n}'])
    t = T.kg_skos(R.atoms(rows)).collect()
    preds = sorted((r["p"], r["o_kind"]) for r in t)
    assert ("http://kg.ai/skos:closeMatch", "lit") in preds
    assert preds.count((C.SKOS + "broader", "lit")) == 1 and preds.count((C.SKOS + "broader", "iri")) == 1
    intent = T.kg_skos(R.atoms(rows), strict_case=False).collect()
    assert any(r["p"] == C.SKOS + "closeMatch" for r in intent)


def test_sentence_gate_is_strict(spark):
    s = spark.createDataFrame([(0, "Exactly10.")], "doc_id long, text string")
    g = X.sentence_gate(X.sentences(s)).collect()
    assert len(g) == 1 and g[0]["has_data"] is False


def test_reply_kv(spark):
    text = ("<|system|>\nx: y\n<|assistant|>\nEnglish: Fixed?\n\nUser's request in Dutch: Vast: x\n"
            "Description: d\nplain")
    df = spark.createDataFrame([(1, text)], "reply_id long, response string")
    kv = {r["key"]: r["value"] for r in P.reply_kv(df).collect()}
    assert kv == {"English": "Fixed?", "Dutch": "Vast: x", "Short description": "d", "summary": "plain"}


def test_keywords(spark):
    df = spark.createDataFrame([(1, '{"keywords": ["a b","c"]}')], "reply_id long, response string")
    assert [r["keyword"] for r in P.keywords(df).orderBy("pos").collect()] == ["a b", "c"]


def test_page_reference_shapes(spark):
    refs = ["https://en.wikipedia.org/wiki/Queen_(band)", "https://wikipedia.org/wiki/X",
            "https://www.wikipedia.org/wiki/X", "https://en.m.wikipedia.org/wiki/X",
            "https://www.en.wikipedia.org/wiki/X", "Queen"]
    df = spark.createDataFrame(list(enumerate(refs)), "ref_id long, ref string")
    got = {r["ref_id"]: (r["page"], r["lang"], r["key"]) for r in L.page_ref_parse(df).collect()}
    assert got[0][:2] == ("Queen_(band)", "en")
    assert got[1][:2] == ("X", "eu")
    assert 2 not in got and 5 not in got
    assert got[3][:2] == ("X", "en.m")
    assert got[4] == ("X", "en", "https://en.wikipedia.org/wiki/X")


def _pairs_from_members(rows):
    """Expand the membership form into pairs (test-side brute force)."""
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[2], r[1]))
    out = []
    for g, members in by.items():
        members.sort()
        for i in range(len(members)):
            for j in range(i + 1, len(members)):
                out.append((members[i][1], members[j][1]))
    return out


def test_group_pairs_first_position(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(["b", "a", "b", "c"])] +
                               [(1, i, v) for i, v in enumerate(["1", "23", "12", "3"])],
                               "g long, pos long, v string")
    m = A.group_members(df, "g", "v", "pos").select("g", "v", "first_pos").collect()
    pairs = _pairs_from_members([tuple(r) for r in m if r["g"] == 0])
    assert pairs == [("b", "a"), ("b", "c"), ("a", "c")]
    assert len(_pairs_from_members([tuple(r) for r in m if r["g"] == 1])) == 6


def test_top_identifier_empty_is_null(spark):
    df = spark.createDataFrame([(1, '{"a": "no-separator"}')], "record_id long, data string")
    top = E.top_identifier(E.identifier_stats(E.identifier_values(df))).collect()
    assert top[0]["identifier"] is None


def test_identifier_walk_ignores_bare_list_strings(spark):
    df = spark.createDataFrame([(1, '{"a":"x_y","b":{"c":"x/y_z"},"d":["in_list",{"e":"r_r"}],"n":5,'
                                    '"deep":{"l1":{"l2":{"l3":[{"l4":"deep_value"}]}}}}')],
                               "record_id long, data string")
    vals = sorted(r["value"] for r in E.identifier_values(df).collect())
    assert vals == ["deep_value", "r_r", "x_y"]


def test_local_time_text(spark):
    from graphwright.functions.timefmt import local_time_text
    df = spark.createDataFrame([("2024-07-01 10:00:00",), ("2024-01-15 10:00:00",)], "t string")
    out = [r[0] for r in df.select(local_time_text(F.col("t").cast("timestamp_ntz"))).collect()]
    assert out == ["Mon, 01 Jul 2024 12:00:00 CEST", "Mon, 15 Jan 2024 11:00:00 CET"]


def test_identifier_walk_deeper_than_one_pass(spark):
    import json
    deep = {"a": "x_1"}
    for i in range(20):  # 40 levels: objects inside lists inside objects
        deep = {f"k{i}": [deep, "bare_str"], f"v{i}": f"val_{i}"}
    df = spark.createDataFrame([(1, json.dumps(deep))], "record_id long, data string")
    vals = sorted(r["value"] for r in E.identifier_values(df).collect())
    assert vals == sorted(["x_1"] + [f"val_{i}" for i in range(20)])
