"""Edge rows of the column expressions, with literal expected values."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from dunlake.functions import accounts, amounts, bands, classes, contacts, dates, messages, names


def ones(values):
    return [(v,) for v in values]


def test_debt_band_edges(evaluate):
    values = ["20000", "20000.01", "2000000", "2000001", "0", "abc", None, "1.234,5"]
    assert evaluate(bands.debt_band("c0"), ones(values)) == [
        "1 Menos a 20 mil", "2 Entre 20 a 50 mil", "9 Entre 1 a 2 millones", "9.1 Mayor a 2 millones",
        "1 Menos a 20 mil", "9.1 Mayor a 2 millones", "9.1 Mayor a 2 millones", "9.1 Mayor a 2 millones",
    ]


def test_overdue_band(evaluate):
    values = ["-31", "-30", "0", "1", "31", "32", "100", "101", None]
    assert [v[0] for v in evaluate(bands.overdue_band("c0"), ones(values))] == list("F001899FN")


def test_contact_ranges(evaluate):
    values = [
        "3000000008", "3000000009", "3599999999", "3600000000", "6010000008", "6010000009", "6089999999", "6090000000",
        "1234567", "texto", "", None, " 3001234567 ", "+3001234567", "03001234567", "3001234567.0", "30012345a7", "3001234567.x",
    ]
    assert evaluate(contacts.contact_filter("c0"), ones(values)) == [
        False, True, True, False, False, True, True, False, False, False, False, False, True, True, True, True, False, False,
    ]


def test_contact_types(evaluate):
    values = ["a@b.c", "3001234567", "00 300-123 4567", "6011234567", "123", None]
    assert evaluate(contacts.contact_type("c0"), ones(values)) == ["email", "movil", "movil", "fijo", "errado", "errado"]


def test_landlines(evaluate):
    rows = [("1234567", "CALI/SUR"), ("1234567", None), ("11234567", "TUNJA"), ("11234567", "HUILA"), ("3001234567", "CALI")]
    assert evaluate(contacts.rebuild_landline("c0", "c1"), rows) == [
        "6021234567", "6011234567", None, "6011234567", None,
    ]
    pairs = [("1", "1234567"), ("", "1234567"), ("601.0", "1234567"), ("4", "1234567"), (None, "1234567"), ("x", "12345678"), ("1", "12")]
    assert evaluate(contacts.landline_from_pair("c0", "c1"), pairs) == [
        "6011234567", "6011234567", "6011234567", "6041234567", None, "6012345678", None,
    ]


def test_emails(evaluate):
    values = ["cinco@x.co", "seises@x.co", "unodos@x.co;otro@y.co", "NOTIENE@x.co", "sinarroba", None]
    assert evaluate(contacts.email_quality("c0"), ones(values)) == [
        "ERRADO", "CORREO UNICO", "CORREOS SIN DELIMITAR", "ERRADO", "ERRADO", "ERRADO",
    ]
    values = ["Ana Maria#1@X.co", "nocorreo@x.co", "x", "a@b@c"]
    assert evaluate(contacts.clean_email("c0"), ones(values)) == ["anamaria1@x.co", "0", "0", "a@b@c"]
    assert evaluate(contacts.email_channel("c0"), ones(values)) == ["EMAIL", "EMAIL", "DELIMITAR", "DELIMITAR"]


def test_names(evaluate):
    values = ["Sr. Juan Perez", "SRA MARIA", "Señor 12 Israel", "ana", "A LUIS 3 PEÑA", "LUZ & SOL", "X  Y", None]
    assert evaluate(names.clean_name("c0"), ones(values)) == [
        "JUAN PEREZ", "MARIA", "IEL", "ANA", "LUIS PENA", "LUZ & SOL", "XY", None,
    ]
    assert evaluate(names.short_name("c0"), ones(["DE LA ROSA ANA", "AB CD", "UNO", None])) == ["ROSA", "CD", "UNO", None]
    assert evaluate(names.given_names("c0"), ones(["A B C", "A B", "A"])) == ["A B", "A", "A"]
    assert evaluate(names.surnames("c0"), ones(["A B C", "A B", "A"])) == ["B C", "B", "A"]


def test_short_way_for_names_changes_nothing(evaluate, spark):
    """Names that skip the full cleaning come out as the full cleaning would give them."""
    values = ["JUAN PEREZ", "A ANA", "  ", " A  B", "ASR", "LUIS SENDA", "SEO R", "NNNNNN", "A", "AA A"]
    full = names._keep_letters(
        F.replace(
            F.replace(F.replace(F.upper(F.col("c0")), F.lit("NNNNN"), F.lit("N")), F.lit("SRA "), F.lit("")),
            F.lit("  "), F.lit(""),
        )
    )
    chosen = [v for v in values if not any(part in v for part in ("SR", "SEN", "SEO"))]
    assert evaluate(names.clean_name("c0"), ones(chosen)) == evaluate(full, ones(chosen))


def test_amounts(evaluate):
    rows = [("1000", "0%"), ("1000", None), ("1000", "N/A"), ("1000", "7"), ("1000.9", "50%"), ("abc", "7"), ("10", "x")]
    # double arithmetic, then truncation: 1000 * (1 - 0.07) is just below 930
    assert evaluate(amounts.discounted("c0", "c1"), rows) == [1000, 1000, 1000, 929, 500, None, None]
    assert evaluate(amounts.money_text("c0"), ones(["1234567.9", "12", None])) == ["$ 1.234.567", "$ 12", None]
    assert evaluate(amounts.parsed_amount("c0"), ones(["1,5", "1.5", "x", None])) == [1.5, 1.5, None, None]
    assert evaluate(amounts.usable_amount("c0"), ones(["0,01", "0.009", "x", None])) == [True, False, False, False]
    assert evaluate(amounts.without_thousands("c0"), ones(["1.234.567", "x"])) == [1234567, None]


def test_dates(evaluate):
    values = ["1/2/2024", "01/02/2024", "2024-02-01 10:00:00", "31/31/2024", "01-02-24", "01/02/99", None]
    assert evaluate(dates.iso_date("c0"), ones(values)) == [
        "2024-02-01", "2024-02-01", "2024-02-01", "31/31/2024", "2024-02-01", "1999-02-01", None,
    ]
    assert evaluate(dates.days_between("c0", "c1"), [("3/1/2024", "01/01/2024"), (None, "1/1/2024"), ("x", "1/1/2024")]) == [2, None, None]
    names_ = ["base_01022024_0930.csv", "base_31312024_2460.csv", "suelto.csv", "a_b_01022024_0930 copia.csv"]
    assert evaluate(dates.file_name_date("c0"), ones(names_)) == [date(2024, 2, 1), None, None, date(2024, 2, 1)]
    assert evaluate(dates.file_name_time("c0"), ones(names_)) == ["09:30", None, None, "09:30"]


def test_accounts(evaluate):
    assert evaluate(accounts.without_points("c0"), ones(["1.2-3", None])) == ["123", None]
    assert evaluate(accounts.without_zero_decimal("c0"), ones(["12.0", "12.05", "120"])) == ["12", "12.05", "120"]
    assert evaluate(accounts.last_nine("c0"), ones(["1234.567890123", "12"])) == ["567890123", "12"]
    assert evaluate(accounts.composite_key("c0", "c1"), [("a", "b"), ("a", None)]) == ["a-b", None]
    assert evaluate(accounts.joined_lines("c0", "c1", "c2"), [("1", None, "2"), (None, "", None)]) == ["1,2", ","]


def test_brands(evaluate):
    mark = classes.assign_brand("c0", "c1", F.lit("N"), F.lit("N"), F.lit("Y"), "c2", campaign=F.lit("x"))
    rows = [("BSCS", "Y", "30"), ("RR", "Y", "30"), ("ASCARD", "Y", "30"), ("RR", "N", "30"), ("RR", None, "150")]
    assert evaluate(mark, rows) == ["Potencial", "Churn", "Provision", "Potencial a Castigar", "120 - 180"]
    assert evaluate(classes.document_type("c0"), ones(["CC1", "1", None, "QQ1", "XPP9"])) == [
        "Cedula de Ciudadania", "Sin tipologia", "Sin tipologia", "Errado", "Permiso de Permanencia",
    ]


def test_keyword_groups_last_rule_wins(evaluate):
    values = ["Pash GM", "habi qnt", "Sin grupo", None]
    rules = (("uno", ("pash",)), ("dos", ("gm",)), ("tres", ("qnt",)))
    assert evaluate(classes.keyword_group("c0", rules), ones(values)) == ["dos", "tres", "Sin grupo", None]


def test_bucket_label(evaluate):
    values = ["030", " 30 ", "30.9", "churn", "-5.5"]
    assert evaluate(classes.bucket_label("c0"), ones(values)) == ["MORA 030", "MORA 30", "MORA 30", "CHURN", "MORA -5"]


def test_templates(evaluate):
    message = messages.fill_template("Hola (C0), debe (c1)!", ["c0", "c1"])
    assert evaluate(message, [("Ana", "5"), (None, "5")]) == ["Hola Ana, debe 5!", "Hola , debe 5!"]
    with pytest.raises(ValueError):
        messages.fill_template("(otra)", ["c0"])
