"""Ingest of the original file's form (A1, B2)."""

import pytest

from basketlab.sources.raw import RAW_COLUMNS, read_invoice_lines, load_lines, split_lines

HEAD = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"
LINES = ["536365,85123A,HOLDER,6,2010-12-01 08:26:00,2.55,17850,UK", "C536379,D,Discount,-1,2010-12-01 09:41:00,27.50,14527.0,UK",
         "536380,22961,JAM,x24,2010-12-01 09:41:00,1.45,17809,UK", "536381,POST,,1,2010-12-01 09:41:00,1.45,,UK",
         "536365,71053,LANTERN,6,2010-12-01 08:26:00,3.39,17850,UK", ",71053,LANTERN,6,2010-12-01 08:26:00,3.39,17850,UK"]


@pytest.fixture()
def csv(tmp_path):
    (tmp_path / "in.csv").write_text(HEAD + "\n".join(LINES) + "\n")
    return str(tmp_path / "in.csv")


def test_original_names_cancellations_and_rejects(spark, csv):
    lines, rejects = split_lines(load_lines(spark, csv, "csv"), ["StockCode"])
    got = {(r.order_id, r.stock): r for r in lines.collect()}
    assert lines.columns == RAW_COLUMNS and set(got) == {(536365, "85123A"), (536365, "71053"), (536379, "D"), (536381, "POST")}
    assert got[536379, "D"].quantity == -1 and got[536379, "D"].user_id == 14527
    assert got[536381, "POST"].user_id is None and got[536365, "85123A"].line_no == 2
    assert {(r.order_id, r.reject_reason) for r in rejects.collect()} == {("536380", "quantity"), (None, "order_id")}


def test_line_order_must_be_declared(spark, csv):
    with pytest.raises(ValueError, match="line_no"):
        read_invoice_lines(spark, csv, "csv")
    with pytest.raises(ValueError, match="country"):
        split_lines(load_lines(spark, csv, "csv").drop("Country"), ["StockCode"])
