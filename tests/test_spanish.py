from folioscope.operators.spanish import spanish_stems

#: Words and stems of the published sample vocabulary of the algorithm.
SAMPLE = """cheque chequ, chequeo cheque, cheques chequ, cheraw cheraw, chesca chesc, chester chest, chetumal chetumal, chetumaleños chetumaleñ, chevrolet chevrolet, cheyene cheyen, cheyenne cheyenn, chi chi, chía chi,
chiapaneca chiapanec, chiapas chiap, chiba chib, chic chic, chica chic, chicago chicag, chicana chican, chicano chican, chicas chic, chicharrones chicharron, chichen chich, chichimecas chichimec, chicles chicl, chico chic,
torá tor, tórax torax, torcer torc, toreado tor, toreados tor, toreándolo tor, torear tor, toreara tor, torearlo tor, toreó tore, torero torer, toreros torer, torio tori, tormenta torment, tormentas torment,
tornado torn, tornados torn, tornar torn, tornen torn, torneo torne, torneos torne, tornillo tornill, tornillos tornill, torniquete torniquet, torno torn, toro tor, toronto toront, toros tor, torpedearon torped, torpeza torpez,
torrado torr, torralba torralb, torre torr, torrencial torrencial, torrenciales torrencial, torrente torrent, torreon torreon, torreón torreon, torres torr, torrescano torrescan"""
#: By hand, rule by rule.
RULES = """rápidamente rapid, activamente activ, relativamente relat, generosamente gener, económicamente econom, probablemente probabl, constantemente constant, amabilidad amabil, responsabilidad respons, capacidad capac,
comunicación comun, aplicaciones aplic, biología biolog, sociologías sociolog, distribución distribu, distribuciones distribu, referencia referent, solución solucion, existencias existent, creativo creativ, administrativos administr, movimiento movimient, nacionalismo nacional,
importante import, construyendo constru, huyeron huyeron, pague pag, paguen pag, averigüe averigü, diciéndome dic, darle darl, comprándoselas compr, y y, a a, oí oi, él el, vivían viv, subconvocatoria subconvocatori"""


def pairs(text):
    return dict(x.split() for x in text.replace("\n", " ").split(","))


def test_published_stems(spark):
    df = spark.createDataFrame([(w,) for w in pairs(SAMPLE)], "lexeme string")
    assert {r["lexeme"]: r["stem"] for r in spanish_stems(df).collect()} == pairs(SAMPLE)


def test_rules(spark):
    df = spark.createDataFrame([(w,) for w in pairs(RULES)] + [(None,), ("",)], "lexeme string")
    got = {r["lexeme"]: r["stem"] for r in spanish_stems(df).collect()}
    assert got.pop(None) is None and got.pop("") == ""
    assert {k: (v, got[k]) for k, v in pairs(RULES).items() if got[k] != v} == {}
