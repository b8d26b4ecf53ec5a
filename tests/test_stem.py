"""Porter stemmer on the example words of the 1980 paper, and the english analyzer."""

import pytest

from tracelens.functions.stem import porter_stem

CASES = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat",
    "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor",
    "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
    "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
    "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit",
    "rational": "ration", "valenci": "valenc", "digitizer": "digit", "conformabli": "conform",
    "radicalli": "radic", "differentli": "differ", "vileli": "vile", "analogousli": "analog",
    "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal",
    "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal",
    "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form",
    "formalize": "formal", "electriciti": "electr", "electrical": "electr", "hopeful": "hope",
    "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer",
    "airliner": "airlin", "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens",
    "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend",
    "adoption": "adopt", "homologou": "homolog", "communism": "commun", "activate": "activ",
    "angulariti": "angular", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler",
    "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
}


@pytest.mark.parametrize("word,stem", sorted(CASES.items()))
def test_porter(word, stem):
    assert porter_stem(word) == stem


def test_english_search(spark):
    import datetime as dt

    from tracelens.plans import search
    from tracelens.plans.catalog import Catalog

    msgs = spark.createDataFrame(
        [("m1", "s1", "user", dt.datetime(2026, 1, 1), None, "The tests are failing again", False, "local"),
         ("m2", "s1", "assistant", dt.datetime(2026, 1, 2), "x", "I fixed the failed test", False, "local"),
         ("m3", "s1", "user", dt.datetime(2026, 1, 3), None, "nothing relevant", False, "local")],
        "uuid string, session_id string, role string, timestamp timestamp, model string, text_content string, "
        "is_sidechain boolean, host string")
    sess = spark.createDataFrame([("s1", "/p", "local", 10)], "session_id string, project_path string, host string, cost_e4 long")
    c = Catalog.from_tables(spark, messages=msgs, sessions=sess)
    got = {r.uuid for r in search.search(c, "the failing tests", analyzer="english").collect()}
    assert got == {"m1", "m2"}  # 'the' is a stop word; fail/test stems match both forms
    assert {r.uuid for r in search.search(c, "failing tests").collect()} == {"m1"}  # simple analyzer
