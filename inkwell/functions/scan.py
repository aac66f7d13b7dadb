"""Amounts of money as spans of short notes, in English and Vietnamese, as column expressions.

A text is cut by one regular expression into pieces that cover it: candidates first, then whole words, then single characters. Lengths add up to
offsets, so each piece is a span; the candidates among them are judged by what they are and by the words at their sides. All of it
stays in the JVM; only texts that are not composed (NFC) go through Arrow, for the way back to their own offsets.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from inkwell.functions.text import ACCENTED, PLAIN

# How English amounts are written.
PREFIX = r"(?:(?:us|s|a|c|nz|hk)?\$|£|€|₹|¥|₱|(?:rs|inr|usd|sgd|gbp|eur|aud|cad|rm|php|myr|thb|aed)\.?\s?)"
NUMBER = r"(?:\d{1,2}(?:,\d{2})+,\d{3}(?:\.\d+)?|\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)"
SCALE = r"(?:(?:k|mm|m|bn|b|cr|lacs|lac)|\s?(?:grand|thousand|million|mil|lakhs?|crores?|billion))"
MONEY = r"(?:bucks?|bux|dollars?|usd|sgd|gbp|eur|inr|quid|pounds?|euros?|rupees?|rs|cents?|pence)"
SUFFIX = rf"\s?(?:{MONEY}|(?:us|s|a|c|nz|hk)\$|\$|€|£)"
SMALL = "one|two|three|four|five|six|seven|eight|nine"
UNITS = SMALL + "|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety"
LARGE = "hundred|thousand|million|grand"
NAMED_BEFORE = r"(?i)(?:s&p|nifty|trading|nasdaq|dow|ftse|sti|msci)\s?\z"
DURATION_AFTER = r"(?i)^\s?(?:(?:weeks?|wks?|days?|months?|mos?|years?|yrs?|hours?|hrs?|mins?|minutes?|x)\b|%\b)"
ORDINAL_AFTER = r"(?i)^\s+(?:first|second|third|\w+th)\b"
CLOCK_BEFORE = r"(?i)\b(?:at|by|before|around)\s\z"
EDGES = r"()\[\]{}<>\"'.,;:!?*_"
CORE = rf"(?i)(?:us|s|a|c|nz|hk)?\$|[£€₹¥₱]|(?<![a-z])(?:{MONEY}|aed|php|myr|thb|rm)(?![a-z])\.?"

_EN_DIGIT = rf"(?<![\w.,$£€₹¥₱/:#@-]){PREFIX}?{NUMBER}{SCALE}?(?:{SUFFIX})?(?![\w%]|[/:]\d|\.\d)"
_RUN = rf"(?:(?:{UNITS}|{LARGE})(?:[\s-]+(?:and\s+)?(?:{UNITS}|{LARGE}))*|fiver|tenner)"
_EN_WORD = rf"(?<![\w-])(?:a\s+(?=hundred|thousand|grand))?{_RUN}(?:\s+{MONEY})?(?![\w-])"
_EN_PIECES = rf"(?i){_EN_DIGIT}|{_EN_WORD}|\w+|[\s\S]"

_MATCH = "array<struct<text:string,start:int,end:int>>"


def let(x: Column, body) -> Column:
    """``body`` of x, with x computed once for each row, however often the body reads it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def pieces(x: Column, pattern: str) -> Column:
    """The matches of a pattern that covers the text, as (text, start, end)."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_MATCH).alias("found"))
    return F.aggregate(
        F.regexp_extract_all(x, F.lit(pattern), 0), start,
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p)).alias("at"),
            F.array_append(acc["found"], F.struct(p.alias("text"), acc["at"].alias("start"), (acc["at"] + F.length(p)).alias("end"))).alias("found")))["found"]


def _before(text: Column, at: Column) -> Column:
    return F.substring(text, F.lit(1), at)


def _after(text: Column, at: Column) -> Column:
    return F.substring(text, at + 1, F.length(text))


def _tiered(m: Column, tier: Column, kind: Column | str) -> Column:
    return F.struct(m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"), tier.cast("int").alias("tier"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"))


def scan_english(text: Column) -> Column:
    """Every amount-shaped span in order as (text, start, end, tier, kind): tier 3 with a currency mark, 2 scaled, 1 plain, 0 a year, a
    lone 2 or 4, or a small number word. Names of plans and indices, durations, ordinals and clock times are not amounts. A text without
    digit or number word is not cut."""
    found = pieces(text, _EN_PIECES)

    def one(m: Column) -> Column:
        x = m["text"]
        # With the characters at its sides a piece that only looks like an amount tells itself from one.
        window = F.substring(text, F.greatest(m["start"], F.lit(1)), F.length(x) + F.when(m["start"] > 0, 3).otherwise(2))
        is_one = lambda pattern: F.regexp_extract(window, f"(?i){pattern}", 0) == x

        def as_digit(told: Column) -> Column:
            marked = (told["head"] != "") | x.rlike(rf"(?i){SUFFIX}\z")
            scaled = x.rlike(rf"(?i)\A{PREFIX}?{NUMBER}{SCALE}(?:{SUFFIX})?\z")
            plain = F.when(told["number"].rlike(r"\A(?:19|20)\d\d\z") | (x.isin("2", "4")), 0).otherwise(1)
            named = x.rlike(r"(?i)\A401k|\A403b") | _before(text, m["start"] + F.length(told["head"])).rlike(NAMED_BEFORE) | _after(text, m["end"]).rlike(DURATION_AFTER)
            return F.when(~named, _tiered(m, F.when(marked, 3).when(scaled, 2).otherwise(plain), "digit"))

        parts = F.struct(
            F.regexp_extract(x, rf"(?i)\A({PREFIX})?{NUMBER}", 1).alias("head"), F.regexp_extract(x, rf"(?i)\A{PREFIX}?({NUMBER})", 1).alias("number"))
        weak = x.rlike(rf"(?i)\A(?:{SMALL})\z")
        timed = _after(text, m["end"]).rlike(ORDINAL_AFTER) | _before(text, m["start"]).rlike(CLOCK_BEFORE)
        as_word = F.when(~timed, _tiered(m, F.when(x.rlike(rf"(?i)\s{MONEY}\z"), 3).when(weak, 0).otherwise(1), "word"))
        return F.when(x.rlike(r"\d"), F.when(is_one(_EN_DIGIT), let(parts, as_digit))).when(x.rlike(r"\A[A-Za-z]"), F.when(is_one(_EN_WORD), as_word))

    likely = text.rlike(rf"(?i)\d|\b(?:{UNITS}|{LARGE}|fiver|tenner)\b")
    return F.when(likely, F.array_compact(F.transform(found, one))).otherwise(F.array().cast("array<struct<text:string,start:int,end:int,tier:int,kind:string>>"))


def loose_english(text: Column) -> Column:
    """``scan_english`` and every other run without white space that holds a digit, trimmed of punctuation, as tier 0 and kind loose."""
    def trimmed(m: Column) -> Column:
        left = F.length(m["text"]) - F.length(F.regexp_replace(m["text"], rf"\A[{EDGES}]+", ""))
        right = F.length(m["text"]) - F.length(F.regexp_replace(m["text"], rf"[{EDGES}]+\z", ""))
        s, e = m["start"] + left, m["end"] - right
        return F.struct(F.substring(text, s + 1, e - s).alias("text"), s.alias("start"), e.alias("end"), F.lit(0).alias("tier"), F.lit("loose").alias("kind"))

    runs = F.transform(F.filter(pieces(text, r"\S+|\s+"), lambda m: m["text"].rlike(r"\d")), trimmed)
    order = lambda a, b: F.when((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["end"] < b["end"])), -1).when((a["start"] == b["start"]) & (a["end"] == b["end"]), 0).otherwise(1)

    def joined(strict: Column) -> Column:
        more = F.filter(runs, lambda m: (m["start"] < m["end"]) & ~F.exists(strict, lambda f: (f["start"] <= m["start"]) & (m["end"] <= f["end"])))
        return F.array_sort(F.concat(strict, more), order)

    return let(scan_english(text), joined)


def choose_english(found: Column) -> Column:
    """The first marked amount, else the first scaled one, else the last plain one, else the last weak one; null without any."""
    def pick(f: Column) -> Column:
        of = lambda tier: F.filter(f, lambda m: (m["tier"] == tier) & (m["kind"] != "loose"))
        return F.coalesce(F.get(of(3), F.lit(0)), F.get(of(2), F.lit(0)), F.try_element_at(of(1), F.lit(-1)), F.try_element_at(of(0), F.lit(-1)))

    return let(found, pick)


def amount_core(x: Column) -> Column:
    """An amount without currency marks, money words and white space, in lower case."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), CORE, ""), r"\s+", "")


# Folded Vietnamese words about amounts and what explains a number otherwise.
SLANG_QTY = "xang dau nhot nuoc bia ruou cafe coca pepsi gas khoai".split()
SLANG_QTY_ACCENTED = "sữa trà hành tỏi gừng cải".split()
NUMBER_WORDS = "mot hai ba bon nam sau bay tam chin muoi tram linh le lam".split()
PERIOD_BEFORE = "thang ky dot lan quy nam tuan ngay mung thu lop tang phong chia so hang".split()
NAME_LIKE = "lan thu nam quy tang phong dot".split()
QUANTITY_AFTER = (
    "thang ngay tuan nam quy gio phut giay buoi hom dem lan dot ky tieng tuoi t h p "
    "nguoi em be to ly coc ve phan suat cuon quyen mon cai chiec con cay bo doi cap goi hop thung lon lang chi phong tang tiet bai trang chuyen cuoc vien mieng "
    "trai bat dia tui cuc thanh sp kg kilo gam gram g mg can yen tan m km cm mm ml cc l m2 m3 inch gb tb mb").split()

_VI_NUM = r"(?:\d{1,3}(?: \d{3}){2,}(?!\d)|\d+(?:[.,]\d+)*)"
_VI_SLANG = r"(?:cu|xi|chai|lit)"
_VI_UNIT = rf"(?:k|nghin|ngan|trieu|tr|ty|{_VI_SLANG})(?!\p{{L}})"
_QTY = "|".join(sorted(QUANTITY_AFTER, key=len, reverse=True))
_STOP = r"(?![\d/:%\p{L}]|[.,]\d)"
_VI_TAIL = rf"(?: ruoi(?!\p{{L}})|(?<!k)\d{{1,3}}{_STOP}|(?<!k)(?<![^\p{{L}}]tr|\dtr) (?:\d|\d{{3}}){_STOP}(?! (?:{_QTY})(?!\p{{L}})))"
_VI_CUR = r"(?: ?₫| ?(?:vnd|dong|d)(?!\p{L}))"
_VI_WORDS = rf"(?:nua|(?:{'|'.join(NUMBER_WORDS)})(?: (?:{'|'.join(NUMBER_WORDS)}))*) (?:nghin|ngan|trieu|ty|{_VI_SLANG})(?!\p{{L}})"
_DIGITS = r"(?:\d(?:[ .-](?=\d{3}))?)"
_VI_PHONE = rf"(?:(?=0|84){_DIGITS}{{10}}\d(?!\d)|(?=0|84){_DIGITS}{{9}}\d(?!\d)|(?=0){_DIGITS}{{8}}\d(?!\d))"
_VI_PIECES = (
    rf"\p{{L}}+\d[\p{{L}}\d]*|(?<!\d){_VI_PHONE}|\d+(?:[.,]\d+)*[/:]\d[\d/:.]*|(?<=/)\d+(?:[.,]\d+)*|{_VI_NUM} ?%"
    rf"|{_VI_NUM} ?{_VI_UNIT}{_VI_TAIL}?{_VI_CUR}?|{_VI_NUM}{_VI_CUR}|{_VI_NUM}\p{{L}}[\p{{L}}\d]*|{_VI_NUM}|(?<!\p{{L}}){_VI_WORDS}{_VI_TAIL}?{_VI_CUR}?|\p{{L}}+|[\s\S]")


def shadow(x: Column) -> Column:
    """Lower case without accents, of the same length."""
    return F.translate(F.translate(F.lower(x), ACCENTED, PLAIN), "đ", "d")


def scan_vietnamese(text: Column) -> Column:
    """The candidates of a composed note in order as (text, start, end, tier, kind): tier 1 money-shaped or with a unit, 2 with a slang unit, 3 a bare
    number that nothing around it explains. Identifiers, phone numbers, dates, times, fractions, percentages, periods, counts of goods and
    numbers of more than ten digits are none."""
    def judged(folded: Column, m: Column) -> Column:
        x, s, e = m["text"], m["start"], m["end"]
        number = F.regexp_extract(x, rf"\A({_VI_NUM})", 1)
        unit = F.regexp_extract(x, rf"\A{_VI_NUM} ?({_VI_UNIT})", 1)
        cur = F.regexp_extract(x, rf"({_VI_CUR})\z", 1)
        written = F.substring(text, e - F.length(cur) + 1, F.length(cur))
        dong = F.lower(written).contains("ồ") | ((F.lower(F.btrim(written)) == "dong") & ~_after(text, e).rlike(r"[\p{L}\p{N}]"))
        grouped = number.rlike(r"\A\d{1,3}(?:[., ]\d{3})+\z")
        digits = F.length(F.translate(number, "., ", ""))
        real = F.when(cur.endswith("dong"), dong).when(cur == " d", grouped | (digits >= 5) | (unit != "")).otherwise(cur != "")
        parts = F.struct(
            number.alias("number"), digits.alias("digits"), grouped.alias("grouped"), unit.alias("unit"), real.alias("real"), F.when(real, e).otherwise(e - F.length(cur)).alias("stop"))

        def decide(t: Column) -> Column:
            stop = t["stop"]

            def span(tier: Column, kind: Column) -> Column:
                return F.struct(F.substring(text, s + 1, stop - s).alias("text"), s.alias("start"), stop.alias("end"), tier.alias("tier"), kind.alias("kind"))

            next_word = F.regexp_extract(_after(folded, stop), r"\A (\p{L}+)", 1)
            counted = next_word.isin(*SLANG_QTY) | F.lower(F.regexp_extract(_after(text, stop), r"\A (\p{L}+)", 1)).isin(*SLANG_QTY_ACCENTED)
            before = F.regexp_extract(_before(folded, s), r"(\p{L}+) \z", 1)
            before_written = F.regexp_extract(_before(text, s), r"(\p{L}+) \z", 1)
            single = t["number"].rlike(r"\A\d+\z")
            period = (
                F.when(before == "nam", ((t["digits"] == 4) & t["number"].rlike(r"\A(?:19|20)")) | ((F.lower(before_written) == "năm") & (t["digits"] <= 2)))
                .when(before == "thu", (t["digits"] == 1) & t["number"].rlike(r"\A[2-8]")).otherwise(t["digits"] <= 2))
            explained = before.isin(*PERIOD_BEFORE) & ~(before.isin(*NAME_LIKE) & before_written.rlike(r"\A\p{Lu}")) & single & period
            slang = t["unit"].rlike(rf"\A{_VI_SLANG}\z")
            in_words = x.rlike(r"\A\p{L}")
            word_slang = F.regexp_extract(x, rf"\A(?:nua|[\p{{L}} ]*?) ({_VI_SLANG})(?!\p{{L}})", 1) != ""
            big = t["grouped"] | (t["digits"] >= 5)
            tier = (
                F.when(in_words, F.when(~word_slang, 1).when(~counted, 2)).when(slang, F.when(~counted, 2)).when((t["unit"] != "") | t["real"] | big, 1)
                .when(~explained & ~next_word.isin(*QUANTITY_AFTER), 3))
            kind = (
                F.when(in_words, "word").when(slang, "slang").when(t["unit"] != "", "unit").when(t["real"], "currency").when(t["grouped"], "grouped").when(big, "plain")
                .otherwise("bare"))
            return F.when(~(single & (t["digits"] > 10)), let(F.struct(tier.alias("tier"), kind.alias("kind")), lambda k: F.when(k["tier"].isNotNull(), span(k["tier"], k["kind"]))))

        after_slash = (s > 0) & (F.substring(text, s, F.lit(1)) == "/")
        amount = x.rlike(rf"\A{_VI_NUM}(?: ?{_VI_UNIT}{_VI_TAIL}?)?{_VI_CUR}?\z") & ~after_slash & ~x.rlike(rf"\A{_VI_PHONE}\z")
        return F.when(amount | x.rlike(rf"\A{_VI_WORDS}"), let(parts, decide))

    none = F.array().cast("array<struct<text:string,start:int,end:int,tier:int,kind:string>>")
    likely = lambda folded: folded.rlike(r"\d| (?:nghin|ngan|trieu|ty|cu|xi|chai|lit)(?!\p{L})")
    return let(shadow(text), lambda folded: F.when(
        likely(folded), F.array_compact(F.transform(pieces(folded, _VI_PIECES), lambda m: judged(folded, m)))).otherwise(none))


def choose_vietnamese(found: Column) -> Column:
    """The first candidate of the best tier, the last among bare numbers; null without any."""
    def pick(f: Column) -> Column:
        ranked = F.transform(f, lambda m, i: F.struct(m["tier"].alias("tier"), F.when(m["tier"] == 3, -i).otherwise(i).alias("i")))
        return F.get(f, F.abs(F.array_min(ranked)["i"]))

    return let(found, pick)


def composed(text: str) -> tuple[str, list[int]]:
    """The NFC form of a text and, for each of its offsets, that in the text: clusters of a base and its marks are composed one by one."""
    out, places, at = [], [], 0
    while at < len(text):
        end = at + 1
        while end < len(text) and unicodedata.combining(text[end]):
            end += 1
        made = unicodedata.normalize("NFC", text[at:end])
        out.append(made)
        places += [at, *[end] * (len(made) - 1)] if len(made) != end - at else range(at, end)
        at = end
    return "".join(out), [*places, len(text)]


@pandas_udf(StructType([StructField("text", StringType()), StructField("places", ArrayType(IntegerType()))]))
def _composed(texts: pd.Series) -> pd.DataFrame:
    told = [composed(t) if t is not None else (None, None) for t in texts]
    return pd.DataFrame({"text": [t for t, _ in told], "places": [p for _, p in told]})


def compose(text: Column) -> Column:
    """(text, places) of ``composed``; places is null where the text has no combining mark and so stays as it is, but for
    characters that compose alone, which keep their place."""
    marked = text.rlike(r"\p{M}")
    return F.when(marked, _composed(F.when(marked, text))).otherwise(F.struct(text.alias("text"), F.lit(None).cast("array<int>").alias("places")))


def value_span(text: Column, made: Column, chosen: Column) -> Column:
    """A chosen candidate of the composed text as (text, start, end) of the caller's text."""
    s = F.coalesce(F.get(made["places"], chosen["start"]), chosen["start"])
    e = F.coalesce(F.get(made["places"], chosen["end"]), chosen["end"])
    return F.when(chosen.isNotNull(), F.struct(F.substring(text, s + 1, e - s).alias("text"), s.alias("start"), e.alias("end")))


def confidence(chosen: Column, found: Column, categories: Column) -> Column:
    """How sure a rule's proposal is: by the most doubtful category, less for several numbers, odd punctuation and missing accents."""
    has = lambda c: F.array_contains(categories, c)
    base = (
        F.when(has("no_candidate"), 0.25).when(~chosen, 0.3).when(has("bare_number"), 0.55).when(has("number_words"), 0.65).when(has("compound_amount"), 0.6)
        .when(has("slang"), 0.7).when(has("decimal_unit") | has("compact_unit"), 0.95).otherwise(0.97))
    capped = F.least(base, F.when(has("multi_number"), 0.6).otherwise(1.0), F.when(has("unusual_punctuation"), 0.5).otherwise(1.0))
    return F.round(F.greatest(F.when(chosen, capped - F.when(has("unaccented"), 0.02).otherwise(0.0)).otherwise(base), F.lit(0.0)), 2)
