from decimal import Decimal

import pytest

from shelfwise.operators import cleaning
from shelfwise.schema import MANDATORY_COLUMNS, RAW_SCHEMA
from tests.data import SAMPLE, row


@pytest.fixture
def raw(spark):
    return lambda *rows: spark.createDataFrame(list(rows), RAW_SCHEMA)


@pytest.fixture(params=[cleaning.stage_sales, cleaning.clean_sales_impute], ids=["stage", "impute"])
def clean(request):
    return request.param


def test_mandatory_columns(spark, raw):
    cleaning.check_mandatory_columns(raw(*SAMPLE))
    with pytest.raises(ValueError, match="Missing mandatory columns"):
        cleaning.check_mandatory_columns(spark.createDataFrame([("P1", "Electronics")], "product_id string, category string"))
    assert len(MANDATORY_COLUMNS) == 9


def test_duplicates_collapse(raw, clean):
    assert clean(raw(row(), row())).count() == 1


def test_duplicates_are_raw_values(raw, clean):
    assert clean(raw(row(), row(category="electronics"))).count() == 2


@pytest.mark.parametrize("bad", [
    {"date": "not-a-date"}, {"date": None}, {"category": "InvalidCat"}, {"region": "Nowhere"}, {"category": None},
    {"units_sold": -5}, {"price": 0.0}, {"discount": -1.0}, {"discount": 101.0}, {"date": "2024-13-45"},
])
def test_bad_rows_are_dropped(raw, clean, bad):
    assert clean(raw(row(**bad))).count() == 0


def test_revenue_is_recomputed(raw):
    for r in cleaning.stage_sales(raw(*SAMPLE)).collect():
        exact = r.price * r.units_sold * (100 - r.discount) / 100
        assert abs(r.revenue - exact) <= Decimal("0.005")
    for r in cleaning.clean_sales_impute(raw(*SAMPLE)).collect():
        assert r.revenue == r.price * r.units_sold * (100 - r.discount) / 100  # not rounded


def test_names_are_normalised(raw, clean):
    got = clean(raw(row(product_id=" prod_9 ", store_id="\tstore_b", category="  toys\t", region=" nOrtheast "))).first()
    assert (got.product_id, got.store_id, got.category, got.region) == ("PROD_9", "STORE_B", "Toys", "Northeast")


def test_missing_discount_is_zero(raw, clean):
    assert clean(raw(row(discount=None))).first().discount == 0


def test_missing_numbers_drop_or_take_the_median(raw):
    rows = [row(price=10.0), row(price=20.0, units_sold=7), row(price=None, units_sold=9), row(price=30.0, units_sold=None)]
    assert cleaning.stage_sales(raw(*rows)).count() == 2
    got = {(float(r.price), float(r.units_sold)) for r in cleaning.clean_sales_impute(raw(*rows)).collect()}
    assert got == {(10.0, 5.0), (20.0, 7.0), (20.0, 9.0), (30.0, 7.0)}


def test_median_counts_rows_that_are_filtered_later(raw):
    rows = [row(price=10.0), row(price=50.0, category="Unknown"), row(price=None, units_sold=9)]
    got = {float(r.price) for r in cleaning.clean_sales_impute(raw(*rows)).collect()}
    assert got == {10.0, 30.0}


def test_null_product_is_kept(raw, clean):
    assert clean(raw(row(product_id=None))).first().product_id is None


def test_nan_price_is_missing(raw):
    assert cleaning.stage_sales(raw(row(price=float("nan")))).count() == 0


def test_large_amounts_and_decimals_are_kept(raw, clean):
    rows = [row(price=99999999999999.0), row(price=9e9, units_sold=2_000_000_000), row(price=0.004), row(discount=12.345), row(price=1.23456)]
    got = {(float(r.price), int(r.units_sold), float(r.discount)) for r in clean(raw(*rows)).collect()}
    first = row()
    assert got == {
        (99999999999999.0, first[7], 10.0), (9e9, 2_000_000_000, 10.0), (0.004, first[7], 10.0), (first[5], first[7], 12.345), (1.23456, first[7], 10.0),
    }


def test_what_no_type_holds_is_rejected_with_a_reason(raw):
    rows = [row(price=1e17), row()]
    for clean, rejects in ((cleaning.stage_sales, cleaning.quarantine_rejects), (cleaning.clean_sales_impute, cleaning.quarantine_imputed)):
        assert clean(raw(*rows)).count() == 1
        assert [(r.price, r.reason) for r in rejects(raw(*rows)).collect()] == [(1e17, "amount_out_of_range")]


def test_fractional_units_are_rejected_by_staging_and_kept_by_the_other_policy(spark):
    text = spark.createDataFrame([tuple(str(v) for v in row(units_sold="2.7"))], ", ".join(f"{n} string" for n in MANDATORY_COLUMNS))
    assert cleaning.stage_sales(text).count() == 0
    assert cleaning.quarantine_rejects(text).first().reason == "fractional_units"
    assert cleaning.clean_sales_impute(text).first().units_sold == Decimal("2.7")


def test_imputing_rejects_complete_the_policy(raw):
    rows = [row(), row(date="x"), row(price=None), row(price=-1.0), row(category="?"), row(region=None), row(discount=500.0), row(units_sold=-3)]
    rejects = cleaning.quarantine_imputed(raw(*rows))
    assert rejects.count() + cleaning.clean_sales_impute(raw(*rows)).count() == len(rows)
    assert {r.reason for r in rejects.collect()} == {
        "bad_date", "price_not_positive", "unknown_category", "unknown_region", "discount_out_of_range", "negative_units",
    }


def test_quarantine_completes_staging(raw):
    rows = [row(), row(date="x"), row(price=None), row(units_sold=None), row(category="?"), row(region=None), row(discount=500.0)]
    rejects = cleaning.quarantine_rejects(raw(*rows))
    assert rejects.count() + cleaning.stage_sales(raw(*rows)).count() == len(rows)
    assert {r.reason for r in rejects.collect()} == {
        "bad_date", "missing_price", "missing_units", "unknown_category", "unknown_region", "discount_out_of_range",
    }


def test_audit_revenue(raw):
    rows = [row(), row(revenue=455.0), row(revenue=449.0), row(revenue=400.0)]
    assert sorted(r.revenue for r in cleaning.audit_revenue(raw(*rows)).collect()) == [400.0, 455.0]


def test_inferred_text_columns_are_coerced(spark):
    text = spark.createDataFrame([tuple(str(v) for v in row(price="abc")), tuple(str(v) for v in row(price=12.5))],
                                 ", ".join(f"{n} string" for n in MANDATORY_COLUMNS))
    assert {float(r.price) for r in cleaning.clean_sales_impute(text).collect()} == {12.5}
