"""Accounting XML exports.

Exports come as UTF-16 (with or without BOM) or UTF-8, sometimes with
character references that XML forbids (``&#4;``). ``split_elements`` reads them
with Spark's text source, whose records end at the repeated element's end tag
instead of at a line end: a file is cut into as many splits as any text file, and
a record is as large as one element, however large the file. Records are decoded with the
declared charset, stripped of invalid references (S10) and parsed one by one with
``from_xml`` and an all-text schema (numbers are parsed by our own rules afterwards).

Elements that do not parse, or are never closed, are no lines of any reader:
``rejects`` returns them with their place and the reason. The stock summary (S7) pairs
two lists by position and so takes whole documents (``read_documents``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse_d_mon_yy, parse_yyyymmdd
from ..functions.numbers import (first_number_plain, first_number_signed, quantity_signed_int,
                                 split_rate_unit)
from ..functions.text import brand_from_item, size_from_item

# XML 1.0 allows only tab, line feed and carriage return below code 32.
INVALID_CHAR_REF = r"&#(0*([0-8]|1[1-2]|1[4-9]|2[0-9]|3[0-1])|x0*([0-8]|[bBcC]|1[0-9a-fA-F]));"


def read_documents(spark: SparkSession, path: str, encoding: str = "UTF-16LE", pattern: str | None = None,
                   clean: bool = True) -> DataFrame:
    """(file_path, doc): each file decoded to text, BOM and invalid
    character references removed."""
    r = spark.read.format("binaryFile")
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    files = r.load(path)
    doc = F.regexp_replace(F.decode(F.col("content"), encoding), "^﻿", "")
    if clean:
        doc = F.regexp_replace(doc, INVALID_CHAR_REF, "")
    return files.select(F.col("path").alias("file_path"), doc.alias("doc"))


def clean_xml_text(c) -> Column:
    """Remove character references to code points XML forbids (the
    reference's pattern also removed the legal line feed / carriage return
    references; we keep those)."""
    return F.regexp_replace(c if isinstance(c, Column) else F.col(c), INVALID_CHAR_REF, "")


# an attribute value may hold '>' or '/'; a self-closing element ends at its own '/>'
ATTRIBUTES = r"""(?:\s(?:[^>"']|"[^"]*"|'[^']*')*?)?"""


def _elements(text: Column, tag: str) -> Column:
    """The elements of a text as an array: each from its opening tag up to its end, or to the next opening tag."""
    whole = rf"<{tag}{ATTRIBUTES}/>|<{tag}{ATTRIBUTES}>(?:(?!<{tag}[\s/>]).)*?(?:</{tag}>|(?=<{tag}[\s/>])|\z)"
    return F.regexp_extract_all(text, F.lit("(?s)" + whole), 0)


def elements(docs: DataFrame, tag: str) -> DataFrame:
    """Every ``<tag ...>...</tag>`` element of the documents, one per row,
    with its position in the file."""
    return docs.select("file_path", F.posexplode(_elements(F.col("doc"), tag)).alias("pos", "xml"))


def split_elements(spark: SparkSession, path: str, tag: str, encoding: str = "UTF-16LE", pattern: str | None = None) -> DataFrame:
    """(file_path, pos, xml): the elements of files of any size, read in splits.

    ``pos`` rises in file order and is unique in a file: the split's first byte plus a row number, which is below the
    split's size. UTF-16 without a named byte order is little-endian, as the exports are."""
    charset = "UTF-16LE" if encoding.upper() == "UTF-16" else encoding
    r = spark.read.option("lineSep", f"</{tag}>").option("encoding", charset)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    chunks = r.text(path).select(
        F.col("_metadata.file_path").alias("file_path"), (F.col("_metadata.file_block_start") + row).alias("pos"),
        F.concat(F.decode(F.col("value").cast("binary"), charset), F.lit(f"</{tag}>")).alias("text"))
    # a record may also hold self-closing and unclosed elements before its own: they share its place
    return chunks.select("file_path", "pos", F.explode(_elements(clean_xml_text("text"), tag)).alias("xml"))


def _parsed(source: DataFrame, tag: str, schema: str) -> DataFrame:
    """(file_path, pos, xml, v, reason): ``source`` has elements (``xml``) or documents (``doc``)."""
    e = elements(source, tag) if "doc" in source.columns else source
    read = e.withColumn("v", F.from_xml("xml", schema + ", _broken string", {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}))
    closed = F.rlike("xml", F.lit(rf"(?s)(</{tag}>|^<{tag}{ATTRIBUTES}/>)$"))
    reason = F.when(~closed, "not closed").when(F.col("v").isNull() | F.col("v._broken").isNotNull(), "not well-formed")
    return read.withColumn("reason", reason)


def _good(source: DataFrame, tag: str, schema: str) -> DataFrame:
    return _parsed(source, tag, schema).where("reason is null").drop("reason", "xml")


def rejects(source: DataFrame, tag: str = "VOUCHER") -> DataFrame:
    """(file_path, pos, xml, reason) of the elements that no reader gives lines of because they do not parse."""
    return _parsed(source, tag, VOUCHER_SCHEMA if tag == "VOUCHER" else PRICE_SCHEMA).where("reason is not null").select(
        "file_path", "pos", "xml", "reason")


ITEM_FIELDS = "STOCKITEMNAME string, ACTUALQTY string, BILLEDQTY string, RATE string, AMOUNT string"
BATCH = "`BATCHALLOCATIONS.LIST` array<struct<GODOWNNAME string, BATCHNAME string, DESTINATIONGODOWNNAME string>>"
VOUCHER_SCHEMA = (
    "DATE string, VOUCHERNUMBER string, GUID string, PARTYNAME string, VOUCHERTYPENAME string, "
    "PARTYLEDGERNAME string, PRICELEVEL string, "
    f"`ALLINVENTORYENTRIES.LIST` array<struct<{ITEM_FIELDS}, {BATCH}>>")
JOURNAL_SCHEMA = (
    "DATE string, VOUCHERNUMBER string, VOUCHERTYPENAME string, GUID string, DESTINATIONGODOWN string, "
    f"`INVENTORYENTRIESIN.LIST` array<struct<{ITEM_FIELDS}, {BATCH}>>")
PRICE_SCHEMA = ("_NAME string, FULLPRICELIST array<struct<PRICELEVEL string, DATE string, "
                "PRICELEVELLIST array<struct<RATE string, DISCOUNT string, STARTINGFROM string, ENDINGAT string>>>>")
SUMMARY_SCHEMA = ("DSPACCNAME array<struct<DSPDISPNAME string>>, "
                  "DSPSTKINFO array<struct<DSPSTKCL struct<DSPCLQTY string, DSPCLRATE string, DSPCLAMTA string>, "
                  "DSPSTKOP struct<DSPOPQTY string, DSPOPRATE string, DSPOPAMTA string>>>")


def _t(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def _amount(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)).try_cast("double"), F.lit(0.0))


def voucher_lines(docs: DataFrame, kind: str = "sales") -> DataFrame:
    """One row per inventory line of every voucher.

    - ``sales`` (S4): all vouchers; numbers = first run of digits;
    - ``daybook`` (S5): only vouchers whose type is 'sales' (any case);
      blank item names skipped; signed numbers with commas; godown / batch
      from the first batch allocation;
    - ``purchase`` (S6): supplier = party, ``amount = abs(amount)``.
    """
    v = _good(docs, "VOUCHER", VOUCHER_SCHEMA).select("file_path", F.col("pos").alias("voucher_pos"), "v.*")
    if kind == "daybook":
        v = v.filter(F.lower(_t("VOUCHERTYPENAME")) == "sales")
    items = v.select("*", F.posexplode_outer(F.col("`ALLINVENTORYENTRIES.LIST`")).alias("line_no", "it"))
    items = items.filter(F.col("it").isNotNull())
    name = F.trim(F.coalesce(F.col("it.STOCKITEMNAME"), F.lit("")))
    date_raw = _t("DATE")
    base = [F.col("file_path"), F.col("voucher_pos"), F.col("line_no"),
            F.coalesce(F.date_format(parse_yyyymmdd(date_raw), "yyyy-MM-dd"), date_raw).alias("voucher_date"),
            _t("VOUCHERNUMBER").alias("voucher_number"), _t("GUID").alias("guid")]
    if kind == "daybook":
        items = items.filter(name != "")
        batch = F.get(F.col("it.`BATCHALLOCATIONS.LIST`"), 0)
        return items.select(
            *base, _t("VOUCHERTYPENAME").alias("voucher_type"), _t("PARTYNAME").alias("party_name"),
            _t("PARTYLEDGERNAME").alias("party_ledger_name"), _t("PRICELEVEL").alias("price_level"),
            name.alias("stock_item_name"), brand_from_item(name).alias("brand"),
            size_from_item(name).alias("size_ml"),
            first_number_signed(F.col("it.ACTUALQTY")).alias("quantity"),
            first_number_signed(F.col("it.BILLEDQTY")).alias("billed_quantity"),
            first_number_signed(F.col("it.RATE")).alias("rate"),
            first_number_signed(F.col("it.AMOUNT")).alias("amount"), F.lit("PCS").alias("unit"),
            F.coalesce(F.trim(batch["GODOWNNAME"]), F.lit("")).alias("godown"),
            F.coalesce(F.trim(batch["DESTINATIONGODOWNNAME"]), F.lit("")).alias("destination_godown"),
            F.coalesce(F.trim(batch["BATCHNAME"]), F.lit("")).alias("batch_name"))
    party = _t("PARTYNAME").alias("supplier_name" if kind == "purchase" else "party_name")
    amount = _amount("it.AMOUNT")
    if kind == "purchase":
        amount = F.abs(amount)
    elif kind != "sales":
        raise ValueError(f"unknown voucher kind {kind!r}")
    return items.select(*base, party, name.alias("stock_item_name"), brand_from_item(name).alias("brand"),
                        size_from_item(name).alias("size_ml"),
                        first_number_plain(F.col("it.ACTUALQTY")).alias("quantity"),
                        first_number_plain(F.col("it.RATE")).alias("rate"), amount.alias("amount"),
                        F.lit("NOS").alias("unit"))


def stock_summary(docs: DataFrame, balance: str = "closing") -> DataFrame:
    """Stock summary pairs a name list with a stock list by position.

    ``closing`` reads DSPSTKCL (quantity, rate, amount); ``opening`` reads
    DSPSTKOP and takes ``abs(amount)``. Pairs with a missing side or a blank
    name are dropped (``arrays_zip`` pads where Python's ``zip`` stops)."""
    parsed = docs.select("file_path", F.from_xml("doc", SUMMARY_SCHEMA).alias("s"))
    z = parsed.select("file_path", F.posexplode(F.arrays_zip(F.col("s.DSPACCNAME").alias("n"),
                                                             F.col("s.DSPSTKINFO").alias("k"))).alias("pos", "p"))
    name = F.trim(F.col("p.n.DSPDISPNAME"))
    if balance == "closing":
        st, q, r, a = "DSPSTKCL", "DSPCLQTY", "DSPCLRATE", "DSPCLAMTA"
    elif balance == "opening":
        st, q, r, a = "DSPSTKOP", "DSPOPQTY", "DSPOPRATE", "DSPOPAMTA"
    else:
        raise ValueError("balance must be 'closing' or 'opening'")
    stock = F.col(f"p.k.{st}")
    out = z.filter(F.col("p.n").isNotNull() & F.col("p.k").isNotNull() & stock.isNotNull()
                   & (F.coalesce(name, F.lit("")) != ""))

    def num(field):
        return F.coalesce(stock[field], F.lit("0"))

    from ..functions.numbers import number_strip_units
    amount = number_strip_units(num(a))
    return out.select("file_path", "pos", name.alias("stock_item_name"), brand_from_item(name).alias("brand"),
                      size_from_item(name).alias("size_ml"), number_strip_units(num(q)).alias("quantity"),
                      F.lit("NOS").alias("unit"), number_strip_units(num(r)).alias("rate"),
                      (F.abs(amount) if balance == "opening" else amount).alias("amount"))


def price_list(docs: DataFrame) -> DataFrame:
    """Item x price list, first level entry of each list; items without
    a name or without a level list are skipped."""
    it = _good(docs, "STOCKITEM", PRICE_SCHEMA).select("file_path", F.col("v").alias("s"))
    name = F.trim(F.coalesce(F.col("s._NAME"), F.lit("")))
    it = it.filter(name != "").select("file_path", name.alias("stock_item_name"),
                                      F.explode(F.col("s.FULLPRICELIST")).alias("fp"))
    lvl = F.get(F.col("fp.PRICELEVELLIST"), 0)
    it = it.filter(lvl.isNotNull())
    rate, unit = split_rate_unit(lvl["RATE"])
    date_text = F.trim(F.coalesce(F.col("fp.DATE"), F.lit("")))
    return it.select("file_path", "stock_item_name",
                     brand_from_item("stock_item_name", trailing_only=True).alias("brand"),
                     size_from_item("stock_item_name").alias("size_ml"),
                     F.trim(F.coalesce(F.col("fp.PRICELEVEL"), F.lit(""))).alias("price_level"),
                     rate.alias("rate"), unit.alias("unit"), parse_d_mon_yy(date_text).alias("price_date"),
                     date_text.alias("price_date_text"),
                     F.trim(F.coalesce(lvl["STARTINGFROM"], F.lit(""))).alias("starting_from"),
                     F.trim(F.coalesce(lvl["ENDINGAT"], F.lit(""))).alias("ending_at"),
                     F.trim(F.coalesce(lvl["DISCOUNT"], F.lit(""))).alias("discount"))


def stock_journal(docs: DataFrame, first_only: bool = False) -> DataFrame:
    """S9: "in" entries of stock-journal vouchers (the reference read the
    first voucher only; ``first_only=True`` keeps that)."""
    v = _good(docs, "VOUCHER", JOURNAL_SCHEMA)
    if first_only:
        v = v.join(v.groupBy("file_path").agg(F.min("pos").alias("pos")), ["file_path", "pos"], "left_semi")
    e = v.select("file_path", F.col("pos").alias("voucher_pos"), "v.*",
                 F.posexplode(F.col("v.`INVENTORYENTRIESIN.LIST`")).alias("line_no", "it"))
    batch = F.get(F.col("it.`BATCHALLOCATIONS.LIST`"), 0)
    name = F.trim(F.coalesce(F.col("it.STOCKITEMNAME"), F.lit("")))
    date_raw = _t("DATE")
    return e.select("file_path", "voucher_pos", "line_no", _t("VOUCHERNUMBER").alias("voucher_number"),
                    _t("VOUCHERTYPENAME").alias("voucher_type"), parse_yyyymmdd(date_raw).alias("voucher_date"),
                    date_raw.alias("voucher_date_text"), _t("GUID").alias("guid"),
                    _t("DESTINATIONGODOWN").alias("destination_godown"), name.alias("stock_item_name"),
                    size_from_item(name, journal=True).alias("size_ml"),
                    first_number_signed(F.col("it.RATE")).alias("rate"),
                    quantity_signed_int(F.col("it.ACTUALQTY")).alias("quantity"),
                    quantity_signed_int(F.col("it.BILLEDQTY")).alias("billed_quantity"),
                    F.lit("NOS").alias("unit"),
                    F.coalesce(F.trim(F.col("it.AMOUNT")).try_cast("double"), F.lit(0.0)).alias("amount"),
                    F.coalesce(F.trim(batch["GODOWNNAME"]), F.lit("")).alias("godown"),
                    F.coalesce(F.trim(batch["BATCHNAME"]), F.lit("")).alias("batch_name"))
