import unicodedata

import pytest
from pyspark.sql import functions as F

from inkwell.functions import scan

# Notes and the amount that is to be read from them.
VIETNAMESE = {
    "cơm trưa 45k": "45k", "cafe 35 K": "35 K", "lương part time 2tr4": "2tr4", "đóng học phí 1tr150": "1tr150", "mua laptop 15,5 triệu": "15,5 triệu",
    "vay Thảo 1 triệu 2 mua gạo": "1 triệu 2", "tiền xe 2 triệu rưỡi": "2 triệu rưỡi", "bán nhà 1 tỷ 2": "1 tỷ 2", "mượn bạn 3 củ": "3 củ", "bảo hiểm chi trả 3 củ 5": "3 củ 5",
    "cho vay 5 xị": "5 xị", "nhờ mẹ 2 củ rưỡi": "2 củ rưỡi", "trả nợ 500 ngàn": "500 ngàn", "tiền gas 480.000": "480.000", "thanh toán 12.345.678 vnđ": "12.345.678 vnđ",
    "ăn tối 150.000đ": "150.000đ", "chuyển 1 500 000 vào tk": "1 500 000", "mượn mẹ 5000000 đóng tiền": "5000000", "tiền nhà bốn triệu": "bốn triệu", "quà hai trăm nghìn": "hai trăm nghìn",
    "mượn chị nửa củ": "nửa củ", "cơm tấm 100": "100", "muon ban 3 cu": "3 cu", "vay 1 trieu 2": "1 trieu 2", "tra 500 nghin": "500 nghin", "cho vay 2 ty ruoi": "2 ty ruoi",
    "cho a Nam vay 1 triệu 20/10": "1 triệu", "20/10 mua quà mẹ 500": "500", "ăn 2 tô phở 70": "70", "mua 3 vé 150k.": "150k", "đổ 5 lít xăng 120k": "120k", "cho anh Tu vay 3 lít sửa xe": "3 lít",
    "vay Hà 2 củ trả nợ": "2 củ", "mua 2 chai bia 90k": "90k", "tiền điện tháng 10 hết 612k": "612k", "trả góp kỳ 3 1tr5": "1tr5", "trả nợ Huy kỳ 3 2tr": "2tr", "nap dien thoai 0912345678 100": "100",
    "nạp 50k vào 0987 654 321": "50k", "tiền lãi tiết kiệm 5.5%/năm về 420": "420", "hoàn thuế thu nhập năm 2023 3.350.000": "3.350.000", "gửi sổ kỳ hạn 6 tháng 2000": "2000", "mua gạo 10kg 190k": "190k",
    "lẩu vs team 4 người chia 180k": "180k", "cho Lan mượn 300": "300", "trả nợ lần 2 500k": "500k", "sáng mùng 1 lì xì bà nội 200k lấy hên": "200k", "họp lúc 10h30 chi 400k": "400k", "hôm thứ 6 chi 70": "70",
    "tiền nhà t11 4tr2": "4tr2", "grabfood tối 89k ship 15k": "89k", "cho vay 3 100": "100", "mua 5 100k": "100k", "mượn 100 5 củ": "5 củ", "mượn mẹ 3tr đóng học kỳ 2": "3tr", "muon me 3tr dong hoc phi": "3tr",
    "tiền gửi xe 350.000 đồng": "350.000 đồng", "cho Hoa muon 250.000 dong": "250.000 dong", "  ship đồ ăn baemin 67k,  tối nay": "67k", "cho Lan 300": "300",
    **dict.fromkeys(["nạp momo", "shopee hoàn tiền rồi", "thưởng tết 2 tháng lương", "trích 20% lương để dành", "đóng tiền net.", "mua 2 chai bia", "họp lúc 10h30", "gọi 0912345678", "", "   "]),
}
ENGLISH = {
    "venmo'd mom 50": "50", "2 tacos 15": "15", "lunch $20 and tip 5": "$20", "20 bucks for gas": "20 bucks", "s$30 grab": "s$30", "rs 500 auto": "rs 500", "paid 20$": "20$", "3 grand for the car": "3 grand",
    "twenty quid on beer": "twenty quid", "rent 1.2k due": "1.2k", "put 500 in my 401k": "500", "s&p 500 fund 200": "200", "due in 4 weeks 80": "80", "born 1990": "1990", "a hundred for shoes": "a hundred", "one of us": "one",
    "twenty second street": None, "at five we met": None, "room 12a": None, "10:30 call": None, "1,00,000 loan": "1,00,000", "no amount": None, "": None, "two hundred and fifty dollars": "two hundred and fifty dollars",
    "4 u 30": "30", "50% off": None, "fiver for lunch": "fiver",
}


@pytest.mark.parametrize(("find", "choose", "cases"), [
    (scan.scan_vietnamese, scan.choose_vietnamese, VIETNAMESE), (scan.scan_english, scan.choose_english, ENGLISH)])
def test_amounts_of_literal_notes(spark, find, choose, cases):
    notes = spark.createDataFrame([(t,) for t in cases], "note string")
    got = {r.note: r.got for r in notes.select("note", choose(find(F.col("note"))).alias("got")).collect()}
    assert {t: (m.text if m else None) for t, m in got.items() if (m.text if m else None) != cases[t]} == {}
    assert all(t[m.start : m.end] == m.text for t, m in got.items() if m)


def test_offsets_of_decomposed_notes(spark):
    text = unicodedata.normalize("NFD", "mượn Lộc 6 xị đóng tiền học")
    made = scan.compose(F.col("note"))
    df = spark.createDataFrame([(text,), ("plain 45k",), (None,)], "note string").withColumn("made", made)
    got = [r.v for r in df.select(scan.value_span(F.col("note"), F.col("made"), scan.choose_vietnamese(scan.scan_vietnamese(F.col("made.text")))).alias("v")).collect()]
    assert unicodedata.normalize("NFC", got[0].text) == "6 xị" and text[got[0].start : got[0].end] == got[0].text
    assert got[0].end == len(unicodedata.normalize("NFD", "mượn Lộc 6 xị"))
    assert got[1].text == "45k" and got[2] is None


def test_loose_candidates_and_cores(spark):
    row = spark.createDataFrame([("room 12a, paid $20 (ref#7)", "Rs. 500", "20 bucks")], "a string, b string, c string").select(
        scan.loose_english(F.col("a")).alias("a"), scan.amount_core(F.col("b")).alias("b"), scan.amount_core(F.col("c")).alias("c")).first()
    assert [(m.text, m.kind) for m in row.a] == [("12a", "loose"), ("$20", "digit"), ("ref#7", "loose")]
    assert (row.b, row.c) == ("500", "20")


SF = "/root/testdata/sf0.001"


def document_lines():
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text", "source"]).to_pylist()
    return [(r["doc_id"], k, line) for r in rows for k, line in enumerate((r["text"] or "").split("\n"))], rows


def test_amounts_en_equal_a_python_twin(spark):
    import regex

    from inkwell.functions import amounts
    from inkwell.plans import catalogue

    catalogue.load()
    want = {}
    for doc, k, line in document_lines()[0]:
        found = [m[0] for m in regex.finditer(amounts.ENGLISH_NUMBER, line)]
        marked = [m for m in found if m.startswith("$") or regex.search(amounts.MONEY_WORD, m)]
        if found:
            best = (marked or found)[-1]
            want[doc, k] = regex.sub(amounts.MONEY_WORD, "", best.removeprefix("$"))
    got = {(r.doc_id, r.line_no): r.value for r in catalogue.QUERIES["amounts_en"](spark, SF).collect()}
    assert got == want and len(want) > 5


def test_number_roles_equal_a_python_twin(spark):
    from collections import Counter

    import regex

    from inkwell.plans import catalogue

    catalogue.load()
    number = r"(?:[$€£]\s?)?\d[\d.,:/]*\d\s?(?:%|€|\p{L}{1,4}\b)?|(?:[$€£]\s?)?\d\s?(?:%|€|\p{L}{1,4}\b)?"
    roles = [(r"\d:\d", "time"), (r"\d/\d", "date"), ("%", "percent"), (r"\A0\d{8,10}\b", "phone"), (r"(?i)\d(?:st|nd|rd|th)\b", "ordinal"), (r"(?i)[$€£]|\d\s?(?:usd|eur|k)\b", "money"),
             (r"(?i)\d\s?(?:kg|g|km|m|cm|ml|l|gb|mb)\b", "measure"), (r"\A(?:19|20)\d\d\b", "year"), ("", "plain")]
    want = Counter()
    for r in document_lines()[1]:
        for m in regex.finditer(number, r["text"] or "", flags=regex.ASCII):
            want[r["source"], next(name for p, name in roles if regex.search(p, m[0]))] += 1
    got = {(r.source, r.role): r.n for r in catalogue.QUERIES["number_roles"](spark, SF).collect()}
    assert got == dict(want)


def test_every_loose_candidate_is_found(spark):
    """Strict and loose candidates together hold every digit run of a line, and lie where they say."""
    from inkwell.plans import catalogue

    catalogue.load()
    lines = {(d, k): line for d, k, line in document_lines()[0]}
    covered = {}
    for r in catalogue.QUERIES["scan_english_lines"](spark, SF).collect():
        assert lines[r.doc_id, r.line_no][r.start : r.end] == r.text
        covered.setdefault((r.doc_id, r.line_no), set()).update(range(r.start, r.end))
    for key, line in lines.items():
        assert all(i in covered.get(key, ()) for i, c in enumerate(line) if c in "0123456789")
    for r in catalogue.QUERIES["amounts_vi"](spark, SF).collect():
        assert lines[r.doc_id, r.line_no][r.start : r.end] == r.text
