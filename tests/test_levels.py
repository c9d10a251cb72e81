import pytest
from pyspark.sql import functions as F

from loglantern.functions import levels as lv
from loglantern.operators.projections import raw_level


def normalized(spark, rows, fuzzy="compat", event_type="string"):
    frame = spark.createDataFrame(
        [(i, e, t) for i, (e, t) in enumerate(rows)], f"id int, event_type {event_type}, type string"
    )
    found = frame.select("id", raw_level(frame, fuzzy).alias("level")).orderBy("id").collect()
    return [row.level for row in found]


def test_exact_names(spark):
    pairs = [(name, level) for level, names in lv.LEVEL_NAMES.items() for name in names]
    got = normalized(spark, [(None, name) for name, _ in pairs])
    assert got == [level for _, level in pairs]
    padded = normalized(spark, [(None, f" \t {name}　 ") for name, _ in pairs])
    assert padded == got


def test_sizes_of_the_vocabulary():
    assert [len(v) for v in lv.LEVEL_NAMES.values()] == [10, 11, 12, 18, 18]
    words = [
        lv.AUDIT_WORDS, lv.SUCCESS_WORDS, lv.FAILURE_WORDS,
        lv.ERROR_WORDS, lv.WARNING_WORDS, lv.INFORMATION_WORDS,
    ]
    assert [len(w) for w in words] == [13, 13, 14, 13, 13, 13]


@pytest.mark.parametrize(
    "words, level",
    [
        (lv.ERROR_WORDS, "Error"),
        (lv.WARNING_WORDS, "Warning"),
        (lv.INFORMATION_WORDS, "Information"),
    ],
)
def test_plain_keywords(spark, words, level):
    assert normalized(spark, [(None, f"<{w.upper()}>") for w in words]) == [level] * len(words)


def test_audit_keywords(spark):
    texts = [(None, f"{a} {w}!") for a in lv.AUDIT_WORDS for w in lv.SUCCESS_WORDS]
    assert set(normalized(spark, texts)) == {"AuditSuccess"}
    for fuzzy in lv.FUZZY_MODES:
        got = normalized(spark, [(None, f"audit {w}!") for w in lv.FAILURE_WORDS], fuzzy)
        swallowed = [
            fuzzy == "compat" and any(s in w for s in lv.SUCCESS_WORDS) for w in lv.FAILURE_WORDS
        ]
        assert got == ["AuditSuccess" if s else "AuditFailure" for s in swallowed]
        assert sum(swallowed) == (4 if fuzzy == "compat" else 0)


def test_audit_without_outcome_goes_on(spark):
    assert normalized(spark, [(None, "audit warning"), (None, "Audit")]) == ["Warning", "Other"]


def test_case_matters_for_exact_names_only(spark):
    # Not an exact name in this case, but found as a keyword.
    assert normalized(spark, [(None, "ERROR"), (None, "informações!")]) == ["Error", "Other"]


def test_event_type_numbers(spark):
    codes = ["1", "2", "3", "4", "5", " 3 ", "+1", "0", "6", "255", "256", "-1", "1.0", "x", "", None]
    got = normalized(spark, [(c, None) for c in codes])
    assert got == [
        "Error", "Warning", "Information", "AuditSuccess", "AuditFailure", "Information", "Error",
    ] + ["Unknown"] * 9
    assert normalized(spark, [(4, "4"), (9, "4"), (None, "4")], event_type="int") == [
        "AuditSuccess", "Information", "Information",
    ]


def test_type_numbers(spark):
    texts = ["1", "2", "3", "4", "8", "16", "004", "+8", "0", "5", "65535", "70000", "9" * 30, "-1"]
    got = normalized(spark, [(None, t) for t in texts])
    assert got == [
        "Error", "Warning", "Information", "Information", "AuditSuccess", "AuditFailure",
        "Information", "AuditSuccess",
    ] + ["Other"] * 6


def test_blank_and_unknown_texts(spark):
    rows = [(None, t) for t in [None, "", "   ", "\t  ", "Verbose"]]
    assert normalized(spark, rows) == ["Unknown"] * 4 + ["Other"]


def test_fixture_table(spark):
    table = {
        "Fehler": "Error",
        "Предупреждение": "Warning",
        "Success Audit": "AuditSuccess",
        "Échec de l'audit": "AuditFailure",
        "99": "Other",
        "ERREUR SYSTÈME": "Error",
        "neúspěšný audit (1)": "AuditSuccess",
        "監査の成功": "AuditSuccess",
        "Controllo non riuscito": "AuditFailure",
        "controllo NON riuscito": "AuditSuccess",
    }
    assert normalized(spark, [(None, t) for t in table]) == list(table.values())


def test_unknown_fuzzy_mode_is_refused():
    with pytest.raises(ValueError):
        lv.fuzzy_level(None, "other")


def test_priority_and_defaults(spark):
    frame = spark.createDataFrame([(x,) for x in [*lv.LEVEL_PRIORITY, "Other", None]], "level string")
    got = [r[0] for r in frame.select(lv.level_priority(F.col("level"))).collect()]
    assert got == [1, 2, 3, 4, 5, 99, 99]
    assert lv.default_levels("sECURITY") == ["AuditSuccess", "AuditFailure"]
    assert lv.default_levels("System") == ["Error", "Warning", "Information"]
