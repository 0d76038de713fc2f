from datetime import date

import pytest
from pyspark.sql import functions as F

from folioscope.functions import questions as q
from folioscope.operators.questions import lexical_queries


@pytest.fixture(scope="module")
def of(spark):
    """The value of an expression of a question (and of keywords and proposed phrases)."""

    def value(make, text, keywords=None, proposed=None):
        df = spark.createDataFrame([(text, keywords, proposed)], "text string, keywords array<string>, proposed array<string>")
        return df.select(make(F.col("text")).alias("v")).first()["v"]

    return value


def test_identifiers(of):
    got = of(q.identifiers, "Is the eatn 2024 17 or bdns: 123456 open? See 2026/4148, codi 25I656 y el decreto 5/2020")
    assert {("code", "eatn/2024/17"), ("code", "eatn/2024"), ("bdns", "123456"), ("ref", "2026/4148"), ("code", "25i656"), ("norm", "decreto/5/2020")} <= {tuple(k) for k in got}
    assert not any(key.startswith("is/the/eatn") and "2024" not in key for _, key in got)
    assert of(q.identifiers, "año 2024 ab 2024 canción-2024") == [], "acronyms have three plain letters"
    assert of(q.identifiers, None) == of(q.identifiers, "") == []


def test_references(of):
    assert [tuple(r) for r in of(q.references, "Decreto 5/2020 y Orden 7/21, Decreto 5/2020")] == [("decreto", 5, 2020), ("orden", 7, 2021)]
    assert [tuple(r) for r in of(q.references, "el Decreto 3/2021 con la Orden 3/2021 y 4/95")] == [("decreto", 3, 2021), ("orden", 3, 2021), ("orden", 4, 1995)]
    assert [tuple(r) for r in of(q.references, "decreto-ley 9/2020; resolución 1/2020")] == [("decreto ley", 9, 2020), ("resolucion", 1, 2020)]
    assert [tuple(r) for r in of(q.references, "Ley, y de muchas otras cosas más 5/2020, 6/1900")] == [(None, 5, 2020)]
    many = " ".join(f"1/{y}" for y in range(1980, 2000))
    assert [r["year"] for r in of(q.references, "ley " + many)] == list(range(1980, 2000))
    assert [r["ref_type"] for r in of(q.references, "ley " + many)][:5] == ["ley"] * 4 + [None], "thirty characters reach over four numbers"


def test_phrases(of):
    got = of(q.phrases, 'Grants of the "rural plan" by Consell de Mallorca for irrigation works')
    assert got[:3] == ["rural plan", "grants of the", "consell de mallorca"] and "irrigation works" in got
    keyed = of(lambda t: q.phrases(t, F.col("keywords")), "x", ["water", "Water  Network", "a b", None])
    assert keyed == ["water network"], "too short, or of single letters, is no phrase"
    assert of(q.phrases, "alpha1 bravo charlie delta echo1 foxtrot hotels", None)[-1] == "foxtrot hotels"
    assert of(lambda t: q.phrases(t, weak=("dull", "things")), "dull things") == []
    assert of(q.phrases, None) == of(q.phrases, " ") == []


def test_content_phrases_by_definition(of):
    """Every pair of content words up to two apart in a stretch of at most five."""
    text = "water network of the rural plan and bridge tunnels canals dams are pumps valves"
    stop, conn, want, seq, at = set(q.STOP), set(q.CONNECTORS), [], [], []
    chunks = []
    for w in [*text.split(), "are"]:
        if w in conn:
            seq += [w] if seq else []
        elif w in stop or len(w) < 4:
            chunks.append((seq, at))
            seq, at = [], []
        else:
            at = [*at, len(seq)]
            seq = [*seq, w]
            if len(at) == 5:
                chunks.append((seq, at))
                seq, at = [], []
    for seq, at in chunks:
        want += [" ".join(seq[at[i] : at[j] + 1]) for i in range(len(at)) for j in range(i + 1, min(i + 3, len(at)))]
    assert of(lambda t: q.phrases(t, most_content=100), text) == list(dict.fromkeys(want))
    assert of(q.phrases, text) == list(dict.fromkeys(want[:8]))


def test_terms(of):
    assert of(lambda t: q.anchor_terms(t, most=2), "plan irrigation 2024 plan") == ["irrigation", "2024"]
    assert of(lambda t: q.anchor_terms(t, most=2), "zebra apple") == ["apple", "zebra"], "ties in alphabetical order"
    assert of(lambda t: q.anchor_terms(t, most=1, generic=("elephants",)), "elephants zebra") == ["elephants"]
    assert of(lambda t: q.anchor_terms(t, most=1, generic=("mammals",)), "mammals zebras") == ["zebras"]
    assert of(lambda t: q.anchor_terms(t, F.col("keywords"), weak=("zebras",)), "mammals zebras", ["lions", "two words"]) == ["mammals", "lions"]
    assert of(lambda t: q.anchor_terms(t, within=F.array(F.lit("zebra")), most=1), "apples zebra") == ["zebra"]
    assert of(q.entities, "Ayudas de la Conselleria de Norte y Plan Rural para Madrid") == ["ayudas de la conselleria de norte y plan rural"]
    assert of(q.entities, "La Orden de d'Aigua; el norte") == ["orden de d'aigua"] and of(q.entities, "Madrid") == []
    assert tuple(of(q.named_norm, "¿Qué dice la ley de vivienda pública?")) == ("ley", ["dice", "vivienda", "publica"])
    assert of(q.named_norm, "la ley 5/2020 de vivienda") is None and of(q.named_norm, "viviendas públicas") is None


def test_expansion(of):
    add = lambda t: q.expansion_terms(t, F.col("keywords"), F.col("proposed"), budget=5)
    got = of(add, "rural plan for water", ["Water", "canals", "canals", "of", "sum", "pumps", "dams", "x y"], ["rural plan", "Water  Network", "one", "plan for rural", "a b c d e f", "pumps in the dams"])
    assert (got["phrases"], got["keywords"]) == (["water network"], ["canals", "pumps", "dams"]), "the last phrase no longer fits, keywords have what is left"
    assert tuple(of(add, None)) == ([], [])


def test_queries(spark):
    rows = [(1, "irrigation works of rural plan", None), (2, "x", []), (3, None, None), (4, "canals", ["pumps"]), (5, "plan text grants", None)]
    got = {r["qid"]: r for r in lexical_queries(spark.createDataFrame(rows, "qid long, text string, keywords array<string>"), generic=("plan", "text", "grants"), weak=("plan", "text")).collect()}
    assert got[1]["broad"].startswith('"irrigation works" OR ') and got[1]["strict"] == "rural works irrigation plan", "two words are in four phrases, two in two"
    assert (got[2]["broad"], got[2]["strict"]) == ("x", None) and (got[3]["broad"], got[3]["strict"]) == ("", None)
    assert (got[4]["broad"], got[4]["strict"]) == ("canals OR pumps", "canals pumps")
    assert got[5]["broad"].endswith(" OR grants OR plan") and "text OR" not in got[5]["broad"], "two generic ones, weak ones last"


def test_clauses_and_fields(of):
    assert of(q.clauses, "What does Decreto 5/2020 demand and when does Orden 7/2021 finish? Tell me") == ["What does Decreto 5/2020 demand", "when does Orden 7/2021 finish"]
    assert of(q.clauses, "norte agua rural y sur, i quin sou base cobra el subgrup A1 y otro nivel") == ["norte agua rural y sur", "quin sou base cobra el subgrup A1 y otro nivel"]
    assert of(q.clauses, "ayudas para pueblos y agua y el Fondo de Cooperación Municipal") == ["ayudas para pueblos y agua", "el Fondo de Cooperación Municipal"]
    assert of(q.clauses, "When is it due and what is it?") == of(q.clauses, None) == of(q.clauses, "una sola") == []
    cues, grant, marks = {"amount": "import", "date": r"plazo|termini", "who": "requisit"}, r"\bbecas?\b", r"\bcuales?\b"
    assert of(lambda t: q.asked_fields(t, cues), "¿Qué IMPORTE y qué plazo?") == ["amount", "date"]
    many = "Estudio un máster de psicología en Norte. Dime de aquella beca: 1) requisitos, 2) importe; ¿cuál es el plazo y el importe?"
    assert of(lambda t: q.multi_field(t, cues, grant), many) and not of(lambda t: q.multi_field(t, cues, grant), "beca: plazo")
    assert not of(lambda t: q.multi_field(t, cues, grant, enumerates="aquella"), many) and not of(lambda t: q.multi_field(t, cues, grant), many + " ley 1/2020 y ley 2/2020")
    assert of(lambda t: q.identity_query(t, cues, grant, marks), many) == "Estudio un máster de psicología en Norte Dime de aquella beca"
    assert of(lambda t: q.facets(t, cues, grant, marks), many) == [many, "Estudio un máster de psicología en Norte Dime de aquella beca"]
    assert of(lambda t: q.facets(t, cues, grant, marks), "Norte agua; sur agua; Norte agua; oeste tierra") == ["Norte agua; sur agua; Norte agua; oeste tierra", "Norte agua", "sur agua"]
    assert of(lambda t: q.facets(t, cues, grant, marks), None) == [""]


def test_time_hints_and_windows(of):
    assert of(q.relative_phrase, "published Last 10 days") == "last 10 days" and of(q.relative_phrase, "recently") == "recent"
    assert of(q.relative_phrase, "last week, 2024-01-01") is None and of(q.relative_phrase, "lasting") is None and of(q.relative_phrase, None) is None
    assert of(lambda t: q.has_hint(t, "grant"), "a Grant for all") and not of(lambda t: q.has_hint(t, "grant"), "granted") and of(lambda t: q.has_hint(t, "public job"), "open public jobs")
    day = lambda m, d: F.lit(date(2024, m, d))
    none = F.lit(None).cast("date")
    assert tuple(of(lambda t: q.window(t, day(2, 1), day(1, 1), day(5, 15)), "x")) == (date(2024, 1, 1), date(2024, 2, 1))
    assert tuple(of(lambda t: q.window(t, day(2, 1), none, day(5, 15)), None)) == (date(2024, 2, 1), None)
    assert tuple(of(lambda t: q.window(t, day(2, 1), none, day(5, 15)), "last month")) == (date(2024, 4, 1), date(2024, 4, 30))


def test_long_text(of):
    """Runs of thousands of words neither nest patterns nor grow with the square."""
    text = "Plan Norte de " * 6000 + "ley 5/2020"
    assert len(of(q.phrases, text)[0]) > 80_000 and ("norm", "ley/5/2020") in {tuple(k) for k in of(q.identifiers, text)}
