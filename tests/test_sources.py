import os

from pyspark.sql import functions as F

from stockroom.sources import csv as csvsrc
from stockroom.sources import files, xml


def write(path, text, encoding="utf-8", bom=False):
    data = text.encode(encoding)
    if bom:
        data = ("﻿".encode(encoding)) + data
    with open(path, "wb") as f:
        f.write(data)


def test_load_csv_trims_headers_and_keeps_quoted_commas(spark, tmp):
    p = os.path.join(tmp, "stock.csv")
    write(p, ' Brand ,Brand_Category, Size_ML ,Date,Qty,Unnamed: 0\n"A, B",WHISKY,750,01/04/2026,3,0\nC,RUM,180,2/4/2026,0,1',
          bom=True)
    df = csvsrc.load_csv(spark, p, ["Brand", "Qty"])
    assert df.columns == ["Brand", "Brand_Category", "Size_ML", "Date", "Qty"]
    rows = sorted(tuple(r) for r in df.collect())
    assert rows[0][0] == "A, B" and rows[1][0] == "C"


def test_load_csv_missing_columns(spark, tmp):
    p = os.path.join(tmp, "x.csv")
    write(p, "Brand,Qty\nA,1\n")
    try:
        csvsrc.load_csv(spark, p, ["Brand", "Size_ML", "Date"])
    except csvsrc.MissingColumnsError as e:
        assert e.missing == ["Size_ML", "Date"]
    else:
        raise AssertionError("expected MissingColumnsError")


def test_load_folder_reports_bad_file_and_aligns_columns(spark, tmp):
    d = os.path.join(tmp, "daily")
    os.makedirs(d)
    write(os.path.join(d, "a.csv"), "Date,Brand_Category,Brand,Size_ML,Qty\n09/04/2026,WHISKY,X,750,2\n")
    write(os.path.join(d, "b.csv"), "Qty,Brand,Size_ML,Brand_Category,Date\n5,Y,180,RUM,10/04/2026\n")
    write(os.path.join(d, "c.csv"), "Date,Brand,Qty\n11/04/2026,Z,1\n")
    rows, report = csvsrc.load_folder(spark, d, ["Date", "Brand_Category", "Brand", "Size_ML", "Qty"])
    rep = {os.path.basename(r["file_path"]): r["status"] for r in report.collect()}
    assert rep == {"a.csv": "ok", "b.csv": "ok", "c.csv": "failed"}
    got = sorted((r["Brand"], r["Qty"], r["Date"]) for r in rows.collect())
    assert got == [("X", "2", "09/04/2026"), ("Y", "5", "10/04/2026")]


def test_file_hashes_and_guard(spark, tmp):
    d = os.path.join(tmp, "h")
    os.makedirs(d)
    write(os.path.join(d, "a.csv"), "x\n1\n")
    write(os.path.join(d, "b.csv"), "x\n2\n")
    h = files.file_hashes(spark, d)
    import hashlib
    got = {os.path.basename(r["file_path"]): r["file_hash"] for r in h.collect()}
    assert got["a.csv"] == hashlib.sha256(b"x\n1\n").hexdigest()
    log = h.filter(F.col("file_path").endswith("a.csv")).select("file_hash")
    left = [os.path.basename(r["file_path"]) for r in files.unprocessed(h, log).collect()]
    assert left == ["b.csv"]


VOUCHERS = """<ENVELOPE><BODY><DATA>
<VOUCHER VCHTYPE="Sales"><DATE>20260407</DATE><VOUCHERNUMBER>1</VOUCHERNUMBER><GUID>g-1</GUID>
<PARTYNAME>Cash</PARTYNAME><VOUCHERTYPENAME>Sales</VOUCHERTYPENAME>
<ALLINVENTORYENTRIES.LIST><STOCKITEMNAME>ROYAL STAG 750 - ML</STOCKITEMNAME><ACTUALQTY> 2 NOS</ACTUALQTY>
<BILLEDQTY> 2 NOS</BILLEDQTY><RATE>1,050.00/NOS</RATE><AMOUNT>-2100.00</AMOUNT>
<BATCHALLOCATIONS.LIST><GODOWNNAME>Main</GODOWNNAME><BATCHNAME>B1</BATCHNAME></BATCHALLOCATIONS.LIST>
<BATCHALLOCATIONS.LIST><GODOWNNAME>Other</GODOWNNAME></BATCHALLOCATIONS.LIST>
</ALLINVENTORYENTRIES.LIST>
<ALLINVENTORYENTRIES.LIST><STOCKITEMNAME>OLD MONK 180 - ML</STOCKITEMNAME><ACTUALQTY>1 NOS</ACTUALQTY>
<RATE>200.00/NOS</RATE><AMOUNT>-200.00&#4;</AMOUNT></ALLINVENTORYENTRIES.LIST>
</VOUCHER>
<VOUCHER><DATE>bad</DATE><VOUCHERNUMBER>2</VOUCHERNUMBER><GUID>g-2</GUID><PARTYNAME>Shop</PARTYNAME>
<VOUCHERTYPENAME>Receipt</VOUCHERTYPENAME>
<ALLINVENTORYENTRIES.LIST><STOCKITEMNAME>  </STOCKITEMNAME><ACTUALQTY>3</ACTUALQTY><AMOUNT>10</AMOUNT>
</ALLINVENTORYENTRIES.LIST></VOUCHER>
</DATA></BODY></ENVELOPE>"""


def test_sales_vouchers_utf16le_without_bom(spark, tmp):
    p = os.path.join(tmp, "sales.xml")
    write(p, VOUCHERS, encoding="utf-16-le")
    lines = xml.voucher_lines(xml.read_documents(spark, p, "UTF-16LE"), "sales")
    rows = sorted(lines.collect(), key=lambda r: (r["voucher_number"], r["line_no"]))
    assert len(rows) == 3
    first = rows[0]
    assert first["voucher_date"] == "2026-04-07" and first["brand"] == "ROYAL STAG" and first["size_ml"] == 750
    assert first["quantity"] == 2.0 and first["rate"] == 1.0 and first["amount"] == -2100.0
    assert rows[1]["amount"] == -200.0  # the &#4; reference was removed before parsing
    assert rows[2]["voucher_date"] == "bad"  # raw text kept when the date does not parse


def test_daybook_and_purchases_utf16_bom(spark, tmp):
    p = os.path.join(tmp, "daybook.xml")
    write(p, VOUCHERS, encoding="utf-16-le", bom=True)
    docs = xml.read_documents(spark, p, "UTF-16")
    day = sorted(xml.voucher_lines(docs, "daybook").collect(), key=lambda r: r["line_no"])
    assert [r["stock_item_name"] for r in day] == ["ROYAL STAG 750 - ML", "OLD MONK 180 - ML"]
    assert day[0]["rate"] == 1050.0 and day[0]["godown"] == "Main" and day[0]["batch_name"] == "B1"
    assert day[0]["amount"] == -2100.0 and day[0]["unit"] == "PCS"
    pur = xml.voucher_lines(docs, "purchase")
    assert sorted(r["amount"] for r in pur.collect()) == [10.0, 200.0, 2100.0]
    assert "supplier_name" in pur.columns


def test_files_are_read_in_splits(spark, tmp):
    one = VOUCHERS[VOUCHERS.index("<VOUCHER"):VOUCHERS.index("</DATA>")]
    many = "".join(one.replace("<VOUCHERNUMBER>1<", f"<VOUCHERNUMBER>{10 + n}<") for n in range(400))
    doc = VOUCHERS.replace(one, many)
    for codec, charset, bom in (("utf-16-le", "UTF-16", True), ("utf-8", "UTF-8", False), ("utf-16-be", "UTF-16BE", False)):
        p = os.path.join(tmp, codec + ".xml")
        write(p, doc, encoding=codec, bom=bom)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
        try:
            got = xml.split_elements(spark, p, "VOUCHER", charset)
            whole = xml.elements(xml.read_documents(spark, p, charset), "VOUCHER")
            assert got.rdd.getNumPartitions() > 4
            rows = sorted((r["pos"], r["xml"]) for r in got.collect())
            assert [x for _, x in rows] == [r["xml"] for r in whole.orderBy("pos").collect()] and len({p for p, _ in rows}) == len(rows) == 800
            lines = xml.voucher_lines(got, "sales")
            plain = lambda df: sorted(tuple(r)[3:] for r in df.collect())
            assert plain(lines) == plain(xml.voucher_lines(whole, "sales")) and lines.count() == 1200
            assert xml.stock_journal(got.withColumn("xml", F.regexp_replace("xml", "ALLINVENTORYENTRIES", "INVENTORYENTRIESIN")),
                                     first_only=True).select("voucher_number").distinct().collect() == [("10",)]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_broken_vouchers_are_reported(spark, tmp):
    good = "<VOUCHER><DATE>20260407</DATE><VOUCHERNUMBER>{}</VOUCHERNUMBER><ALLINVENTORYENTRIES.LIST><STOCKITEMNAME>A" \
           "</STOCKITEMNAME></ALLINVENTORYENTRIES.LIST></VOUCHER>"
    broken = "<VOUCHER><DATE>20260407<VOUCHERNUMBER>2</VOUCHERNUMBER></VOUCHER>"
    unclosed = "<VOUCHER><VOUCHERNUMBER>3</VOUCHERNUMBER>"
    p = os.path.join(tmp, "v.xml")
    write(p, "<E>" + good.format(1) + broken + good.format(4) + unclosed + good.format(5) + "<VOUCHER/>" + unclosed + "</E>")
    for source in (xml.split_elements(spark, p, "VOUCHER", "UTF-8"), xml.read_documents(spark, p, "UTF-8")):
        assert sorted(r["voucher_number"] for r in xml.voucher_lines(source).collect()) == ["1", "4", "5"]
        bad = sorted((r["reason"], r["xml"][:30]) for r in xml.rejects(source).collect())
        assert [r for r, _ in bad] == ["not closed", "not well-formed", "not well-formed"] or [r for r, _ in bad] == [
            "not closed", "not closed", "not well-formed"]
        assert all(x.startswith("<VOUCHER>") for _, x in bad)


def test_stock_summary_positional_pairs(spark, tmp):
    doc = ("<ENVELOPE><DSPACCNAME><DSPDISPNAME>ROYAL STAG 750 - ML</DSPDISPNAME></DSPACCNAME>"
           "<DSPSTKINFO><DSPSTKCL><DSPCLQTY>12 NOS</DSPCLQTY><DSPCLRATE>1,000.00</DSPCLRATE>"
           "<DSPCLAMTA>-12000.00</DSPCLAMTA></DSPSTKCL><DSPSTKOP><DSPOPQTY>5 NOS</DSPOPQTY>"
           "<DSPOPRATE>900</DSPOPRATE><DSPOPAMTA>-4500</DSPOPAMTA></DSPSTKOP></DSPSTKINFO>"
           "<DSPACCNAME><DSPDISPNAME>BLANK STOCK</DSPDISPNAME></DSPACCNAME></ENVELOPE>")
    p = os.path.join(tmp, "summary.xml")
    write(p, doc)
    docs = xml.read_documents(spark, p, "UTF-8")
    closing = xml.stock_summary(docs, "closing").collect()
    assert [(r["stock_item_name"], r["quantity"], r["rate"], r["amount"]) for r in closing] == \
        [("ROYAL STAG 750 - ML", 12.0, 1000.0, -12000.0)]
    opening = xml.stock_summary(docs, "opening").collect()
    assert [(r["quantity"], r["amount"]) for r in opening] == [(5.0, 4500.0)]


def test_price_list_first_level(spark, tmp):
    doc = ('<ENVELOPE><STOCKITEM NAME="ROYAL STAG 750 - ML"><FULLPRICELIST><PRICELEVEL>Retail</PRICELEVEL>'
           "<DATE>1-Apr-26</DATE><PRICELEVELLIST><RATE>2114.00/NOS</RATE><DISCOUNT>0</DISCOUNT></PRICELEVELLIST>"
           "<PRICELEVELLIST><RATE>1.00/NOS</RATE></PRICELEVELLIST></FULLPRICELIST>"
           "<FULLPRICELIST><PRICELEVEL>Empty</PRICELEVEL></FULLPRICELIST></STOCKITEM>"
           '<STOCKITEM NAME=""><FULLPRICELIST><PRICELEVELLIST><RATE>5</RATE></PRICELEVELLIST></FULLPRICELIST>'
           "</STOCKITEM></ENVELOPE>")
    p = os.path.join(tmp, "prices.xml")
    write(p, doc, encoding="utf-16-le", bom=True)
    rows = xml.price_list(xml.read_documents(spark, p, "UTF-16")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["brand"], r["size_ml"], r["price_level"], r["rate"], r["unit"]) == \
        ("ROYAL STAG", 750, "Retail", 2114.0, "NOS")
    assert str(r["price_date"]) == "2026-04-01" and r["price_date_text"] == "1-Apr-26"


def test_stock_journal_all_vouchers(spark, tmp):
    v = ("<VOUCHER><DATE>20260401</DATE><VOUCHERNUMBER>{n}</VOUCHERNUMBER><VOUCHERTYPENAME>Stock Journal"
         "</VOUCHERTYPENAME><GUID>j{n}</GUID><INVENTORYENTRIESIN.LIST><STOCKITEMNAME>MC 750ML</STOCKITEMNAME>"
         "<RATE>100.00/NOS</RATE><ACTUALQTY>-4 NOS</ACTUALQTY><AMOUNT>400&#13;</AMOUNT>"
         "<BATCHALLOCATIONS.LIST><GODOWNNAME>Main</GODOWNNAME></BATCHALLOCATIONS.LIST>"
         "</INVENTORYENTRIESIN.LIST></VOUCHER>")
    p = os.path.join(tmp, "journal.xml")
    write(p, "<ENVELOPE>" + v.format(n=1) + v.format(n=2) + "</ENVELOPE>", encoding="utf-16-le", bom=True)
    docs = xml.read_documents(spark, p, "UTF-16")
    allv = xml.stock_journal(docs).collect()
    assert len(allv) == 2 and allv[0]["size_ml"] == 750 and allv[0]["quantity"] == -4
    assert allv[0]["godown"] == "Main"
    assert len(xml.stock_journal(docs, first_only=True).collect()) == 1


def test_csv_to_json_new_path(spark, tmp):
    p = os.path.join(tmp, "prices.csv")
    write(p, "Brand,Size_ML,Mrp\nA,750,1050.00\n")
    out = os.path.join(tmp, "prices_json")
    csvsrc.csv_to_json(spark, p, out)
    rows = spark.read.json(out).collect()
    assert [(r["Brand"], r["Size_ML"], r["Mrp"]) for r in rows] == [("A", "750", "1050.00")]
    try:
        csvsrc.csv_to_json(spark, p, p)
    except ValueError:
        pass
    else:
        raise AssertionError("overwriting the source must be refused")


def test_self_closing_elements_do_not_swallow_the_next(spark):
    from stockroom.sources import xml
    doc = '<R><STOCKITEM NAME="A"/><STOCKITEM NAME="B/"><X>1</X></STOCKITEM><STOCKITEM NAME="C>"><X>2</X></STOCKITEM><STOCKITEM/></R>'
    got = xml.elements(spark.createDataFrame([("f", doc)], "file_path string, doc string"), "STOCKITEM").collect()
    assert [r.xml for r in got] == ['<STOCKITEM NAME="A"/>', '<STOCKITEM NAME="B/"><X>1</X></STOCKITEM>',
                                    '<STOCKITEM NAME="C>"><X>2</X></STOCKITEM>', "<STOCKITEM/>"]


def test_csv_in_another_encoding(spark, tmp):
    from stockroom.sources import csv
    with open(f"{tmp}/a.csv", "w", encoding="latin-1") as f:
        f.write('Brand,"Größe"\nKölsch,1\n')
    assert csv.load_csv(spark, tmp, encoding="ISO-8859-1").first()["Größe"] == "1"
    rows, report = csv.load_folder(spark, tmp, ["Brand", "Größe"], encoding="ISO-8859-1")
    assert rows.first()["Brand"] == "Kölsch" and report.first()["status"] == "ok"


def test_write_csv_sorts_all_rows(spark, tmp):
    from stockroom.sinks import export
    df = spark.createDataFrame([(i * 7 % 50, "x") for i in range(50)], "n int, t string").repartition(4)
    export.write_csv(df, f"{tmp}/out", order=["n"])
    import glob
    lines = [x for f in sorted(glob.glob(f"{tmp}/out/part-*.csv")) for x in open(f).read().splitlines()[1:]]
    assert [int(x.split(",")[0]) for x in lines] == list(range(50))
