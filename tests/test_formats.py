"""Formats of text columns."""

import pytest
from helpers import rows

from plumbline.operators import formats


def told(spark, values, least_share=0.05):
    df = spark.createDataFrame([(v,) for v in values], "t string").repartition(3)
    found = {r["pattern"]: r for r in formats.text_formats(df, least_share=least_share).collect()}
    return found, rows(formats.off_format_values(df, "t", least_share), "value")


def test_mixed_dates_are_told_apart(spark):
    values = [f"2024-{m:02d}-{d:02d}" for m in range(1, 13) for d in range(1, 25)]
    values += [f"{d:02d}/{m:02d}/2024" for m in range(1, 13) for d in range(1, 25)]
    values += ["2O24-O1-O3", "2O24-O1-O4", None, None]
    found, off = told(spark, values)
    assert {p: r["format"] for p, r in found.items() if not r["is_off"]} == {"9999-99-99": "yyyy-MM-dd", "99/99/9999": "dd/MM/yyyy"}
    assert [(r["value"], r["count"]) for r in off] == [("2O24-O1-O3", 1), ("2O24-O1-O4", 1)]
    for text, name in (("13.02.2024", "dd.MM.yyyy"), ("02-13-2024", "MM-dd-yyyy"), ("02/03/2024", "dd/MM/yyyy or MM/dd/yyyy")):
        assert [r["format"] for r in told(spark, [text] * 9)[0].values()] == [name]
    assert [r["format"] for r in told(spark, ["13/02/2024", "02/13/2024"])[0].values()] == [None]


def test_numbers_of_any_length_are_one_pattern(spark):
    found, off = told(spark, [str(i * i) for i in range(1, 900)] + ["7O", "x", "O"] * 3)
    assert found["9+"]["format"] == "whole number" and found["9+"]["n"] == 899 and not found["9+"]["is_off"]
    assert {(r["value"], r["count"]) for r in off} == {("7O", 3), ("x", 3), ("O", 3)}
    found, _ = told(spark, [f"{i * i},{i % 10}" for i in range(1, 900)])
    assert [r["format"] for r in found.values()] == ["decimal comma"]
    found, _ = told(spark, ["AB-1234"] * 50)
    assert list(found) == ["AA-9999"]  # one shape stays as it is


def test_odd_texts(spark):
    found, off = told(spark, ["", "x" * 100, "y" * 65, "Éa", None, "a+b", "9+"], 0.2)
    assert found["*"]["n"] == 2 and found[""]["n"] == 1 and found["Aa"]["example"] == "Éa"
    assert sum(r["n"] for r in found.values()) == 6
    assert {r["value"] for r in off} == {"", "Éa", "a+b", "9+"}
    assert told(spark, [None])[0] == {}
    with pytest.raises(ValueError):
        formats.text_formats(spark.range(3))
